"""Row filters, column resolution and the checks of a request."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class RequestError(ValueError):
    """A request that can't be carried out; code says why."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


#: Limits of a request.
MOST_FILTERS, MOST_VALUES, LONGEST_VALUE, MOST_TOP, MOST_TURNS = 5, 20, 512, 100, 8


@dataclass(frozen=True)
class RowFilter:
    """Rows whose trimmed cell is one of the values, exactly. Several filters must all hold."""

    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Conversation:
    """Which columns hold a conversation, and which rows are targets or context."""

    session: str
    order: str
    role: str
    message_type: str
    user_roles: tuple[str, ...] = ("user",)
    assistant_roles: tuple[str, ...] = ("assistant",)
    target_types: tuple[str, ...] = ("text",)
    context_types: tuple[str, ...] = ("text",)
    max_turns: int = 4
    max_tokens: int = 1500


@dataclass(frozen=True)
class Request:
    text_column: str
    filters: tuple[RowFilter, ...] = ()
    conversation: Conversation | None = None
    top_n: int = 10
    columns: tuple[str, ...] = field(default=())

    def check(self) -> Request:
        """Self, if limits hold and names don't collide."""
        names = [f.column for f in self.filters]
        if len(names) > MOST_FILTERS or len(set(names)) != len(names):
            raise RequestError("INVALID_FILTER", "too many filters, or a column twice")
        for f in self.filters:
            if not 1 <= len(f.values) <= MOST_VALUES or len(set(f.values)) != len(f.values) or any(not v.strip() or len(v) > LONGEST_VALUE for v in f.values):
                raise RequestError("INVALID_FILTER", f.column)
        if not 1 <= self.top_n <= MOST_TOP:
            raise RequestError("INVALID_TOP_N", str(self.top_n))
        if c := self.conversation:
            own = {c.session, c.order, c.role, c.message_type}
            if len(own) != 4 or own & {*names, self.text_column}:
                raise RequestError("INVALID_CONVERSATION", "columns must be distinct")
            if not set(c.target_types) <= set(c.context_types) or set(c.user_roles) & set(c.assistant_roles) or not 1 <= c.max_turns <= MOST_TURNS:
                raise RequestError("INVALID_CONVERSATION", "types, roles or turns")
        return self


def first_of_names(df: DataFrame) -> DataFrame:
    """df without the later ones of columns that have one name, as the first has it alone."""
    if len(set(df.columns)) == len(df.columns):
        return df
    first = [df.columns.index(n) for n in dict.fromkeys(df.columns)]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(df.columns[i]) for i in first))


def column(df: DataFrame, name: str, code: str = "COLUMN_NOT_FOUND") -> Column:
    """The first column of that name."""
    if name not in df.columns:
        raise RequestError(code, name)
    return F.col(f"`{name}`")


def check_selection(df: DataFrame, request: Request) -> None:
    """Every column that the request names must be there."""
    df = first_of_names(df)
    column(df, request.text_column)
    for f in request.filters:
        column(df, f.column, "FILTER_COLUMN_NOT_FOUND")
    if c := request.conversation:
        for name in (c.session, c.order, c.role, c.message_type):
            column(df, name, "CONVERSATION_COLUMN_NOT_FOUND")


#: Fixed value: what a selection is told that names what its file doesn't have.
NOT_FOUND = "SHEET_OR_COLUMN_NOT_FOUND"


def missing_selection(wanted: DataFrame, profile: DataFrame) -> DataFrame:
    """(request_id, sheet, name, what) of what requests name and the profile of their file doesn't have.

    wanted: (request_id, sheet, name, what), a row for each column that a request names, what being
    text, filter or conversation; profile: (request_id, sheet, name), a row for each column of
    each sheet. Of a request whose sheet is not there that alone is told, as what = sheet.
    """
    sheets = profile.select("request_id", "sheet").distinct().withColumn("_sheet", F.lit(True))
    told = wanted.join(sheets, ["request_id", "sheet"], "left").join(profile.select("request_id", "sheet", "name", F.lit(True).alias("_name")).distinct(), ["request_id", "sheet", "name"], "left")
    lost = told.where("_sheet is null").select("request_id", "sheet", F.lit(None).cast("string").alias("name"), F.lit("sheet").alias("what")).distinct()
    return lost.unionByName(told.where("_sheet and _name is null").select("request_id", "sheet", "name", "what"))


def check_against_profile(profile: DataFrame, sheet: str, request: Request) -> None:
    """A request's sheet and columns must be in the profile (sheet, name) of its file; the first that isn't is an error."""
    there = {r["name"] for r in profile.where(F.col("sheet") == sheet).select("name").collect()}
    if not there:
        raise RequestError(NOT_FOUND, f"sheet {sheet}")
    c = request.conversation
    for name in (request.text_column, *(f.column for f in request.filters), *((c.session, c.order, c.role, c.message_type) if c else ())):
        if name not in there:
            raise RequestError(NOT_FOUND, name)


def cell(c: Column) -> Column:
    """A cell as text without outer white space; blank is null."""
    return F.nullif(T.strip(c.cast("string")), F.lit(""))


def passes(df: DataFrame, filters: tuple[RowFilter, ...]) -> Column:
    """Whether a row passes all filters; a null cell passes none."""
    tests = [cell(column(df, f.column, "FILTER_COLUMN_NOT_FOUND")).isin(*f.values) for f in filters]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(True)


def values_keeping_rows(df: DataFrame, row_ix: Column, text_column: str, filters: tuple[RowFilter, ...] = ()) -> DataFrame:
    """(row_ix, value): the text of rows that pass, null for the others, so that totals stay."""
    df = first_of_names(df)
    return df.select(row_ix.cast("long").alias("row_ix"), F.when(passes(df, filters), column(df, text_column).cast("string")).alias("value"))


def conversation_rows(df: DataFrame, row_ix: Column, text_column: str, c: Conversation, filters: tuple[RowFilter, ...] = ()) -> DataFrame:
    """(source_row, included, session_id, message_order, role, message_type, text)."""
    df = first_of_names(df)
    named = {"session_id": c.session, "message_order": c.order, "role": c.role, "message_type": c.message_type, "text": text_column}
    return df.select(row_ix.cast("long").alias("source_row"), passes(df, filters).alias("included"), *[cell(column(df, n, "CONVERSATION_COLUMN_NOT_FOUND")).alias(k) for k, n in named.items()])


def without_blank_rows(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows with at least one cell that isn't blank."""
    cells = [cell(F.col(f"`{c}`")).isNotNull() for c in df.columns if c not in ignore]
    return df.where(reduce(lambda a, b: a | b, cells)) if cells else df
