"""What a model returns: its text as checked JSON, its counters, and calls that are repaired.

Stored responses are parsed as columns, natively. A call itself happens in a task, so there a
small helper checks the text before the next call is made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from .mapping import Merge, ModelClassifier, Usage, Used
from .prompts import CONTEXTUAL, DEFAULT, Prompt, prompt_for

#: Fixed value: how often a model is told what was wrong with its answer.
MAX_REPAIRS = 2

#: The shape of the answers: fields, and the one element of a list.
MAP_SHAPE = {"categories": [{"category_id": str, "canonical_question": str, "theme": str}], "assignments": [{"record_id": str, "category_id": str}]}
REDUCE_SHAPE = {"groups": [{"canonical_question": str, "theme": str, "member_category_ids": [str]}]}


# --- columns -----------------------------------------------------------------------------------


def unfenced(raw: Column) -> Column:
    """A model's text without white space and code fence around it."""
    text = T.strip(raw)
    inner = F.regexp_replace(text, "^`+|`+$", "")
    named = F.regexp_replace(inner, rf"(?i)^{T.SPACE}*json", "")
    return F.when(F.startswith(text, F.lit("```")), T.strip(named)).otherwise(text)


#: How the type of a JSON value is told that fits a column's type.
FITS = {
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "bigint": "^(BIGINT|INT|SMALLINT|TINYINT)$",
    "int": "^(BIGINT|INT|SMALLINT|TINYINT)$",
    "double": r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$",
}


def _typed(value: Column, kind: Y.DataType) -> Column:
    """Whether a JSON value, at any depth, has the types asked for; a missing field has none."""
    told = F.schema_of_variant(value)
    if isinstance(kind, Y.StructType):
        out = told.startswith("OBJECT")
        for f in kind.fields:
            out = out & F.coalesce(_typed(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType), F.lit(False))
        return out
    if isinstance(kind, Y.ArrayType):
        return told.startswith("ARRAY") & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_typed(x, kind.elementType), F.lit(False)))
    return told.rlike(FITS[kind.simpleString()])


def parsed(raw: Column, kind: Y.StructType) -> Column:
    """struct(status, data) of a model's text: status is ok, empty, invalid_json or schema; data only if ok.

    Every field of kind is required and must have its JSON type, as a call's answer must:
    neither numbers, flags nor objects are taken where texts are asked for. Other fields are passed over.
    """
    text = unfenced(F.coalesce(raw, F.lit("")))
    value = F.try_parse_json(text)
    ok = F.coalesce(_typed(value, kind), F.lit(False))
    status = F.when(text == "", "empty").when(value.isNull(), "invalid_json").when(~ok, "schema").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", F.try_variant_get(value, "$", kind.simpleString())).alias("data"))


def _counter(value: Column, path: str) -> Column:
    """A token counter: whole and not negative; 0 for what is no number."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    number = F.try_variant_get(value, path, "double")
    return F.when(kind.rlike(r"^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), F.greatest(F.lit(0), F.floor(F.greatest(F.lit(0.0), number)).cast("long"))).otherwise(F.lit(0).cast("long"))


def usage(payload: Column) -> Column:
    """struct of token counters and cost from a response as JSON text; bad counters are 0, a bad cost is null."""
    value = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(value, "$.usage.cost", "variant"))
    as_text = T.strip(F.try_variant_get(value, "$.usage.cost", "string"))
    cost = F.when(kind.rlike(r"^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL|STRING)"), as_text.try_cast("double"))
    cost = F.when((cost >= 0) & (cost < float("inf")), cost)
    return F.struct(
        _counter(value, "$.usage.prompt_tokens").alias("prompt_tokens"),
        _counter(value, "$.usage.completion_tokens").alias("completion_tokens"),
        _counter(value, "$.usage.prompt_tokens_details.cached_tokens").alias("cached_tokens"),
        _counter(value, "$.usage.prompt_tokens_details.cache_write_tokens").alias("cache_write_tokens"),
        cost.alias("cost"),
    )


# --- calls -------------------------------------------------------------------------------------


class SchemaViolation(ValueError):
    """Why an answer can't be used: fields and kinds of error alone, never what the answer says."""


class BadResponse(RuntimeError):
    """No usable answer after all repairs."""


@dataclass(frozen=True)
class Answer:
    """A model's text with what the call used."""

    text: str
    usage: Usage = Usage()


@dataclass(frozen=True)
class Completion:
    data: Any
    calls: int
    usage: Usage


def _wrong(value: Any, shape: Any, path: str) -> Iterator[str]:
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            yield f"{path or 'answer'}: object expected"
            return
        for name, inner in shape.items():
            at = f"{path}.{name}" if path else name
            if name not in value:
                yield f"{at}: missing"
            else:
                yield from _wrong(value[name], inner, at)
    elif isinstance(shape, list):
        if not isinstance(value, list):
            yield f"{path}: list expected"
            return
        for i, x in enumerate(value):
            yield from _wrong(x, shape[0], f"{path}.{i}")
    elif not isinstance(value, shape) or isinstance(value, bool):
        yield f"{path}: {shape.__name__} expected"


def read_answer(raw: str, shape: Any) -> Any:
    """The JSON value of a model's text, of the shape asked for."""
    text = raw.strip()
    if text.startswith("```"):
        text = text.strip("`").lstrip()
        text = (text[4:] if text[:4].lower() == "json" else text).strip()
    if not text:
        raise SchemaViolation("the answer is empty")
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise SchemaViolation(f"no valid JSON (place {e.pos})") from None
    if problems := list(_wrong(value, shape, "")):
        raise SchemaViolation("; ".join(problems[:5]))
    return value


def complete(call: Callable[[list[tuple[str, str]]], str | Answer], system: str, user: str, shape: Any, max_repairs: int = MAX_REPAIRS) -> Completion:
    """call(messages) -> text until an answer has the shape; each repair shows the model its answer and the problem.

    What all attempts used is summed.
    """
    messages, used = [("system", system), ("user", user)], None
    for attempt in range(max_repairs + 1):
        answer = call(messages)
        answer = answer if isinstance(answer, Answer) else Answer(answer)
        raw, used = answer.text, answer.usage if used is None else used + answer.usage
        try:
            return Completion(read_answer(raw, shape), attempt + 1, used)
        except SchemaViolation as e:
            messages = [*messages, ("assistant", raw), ("user", f"The answer did not have the JSON schema: {e}. Return valid JSON of the schema alone, without any text or code fence around it.")]
    raise BadResponse("the model gave no usable answer")


def map_call(call: Callable, prompt: Prompt, max_repairs: int = MAX_REPAIRS) -> Callable[[list[tuple[str, str]]], Used]:
    """A map call for ModelClassifier from a model's text completion; it gets records as the prompt shows them."""

    def over(records: list[tuple[str, str]]) -> Used:
        done = complete(call, prompt.map_system, prompt.map_user.format(records="\n".join(t for _, t in records)), MAP_SHAPE, max_repairs)
        catalog = {c["category_id"]: c for c in done.data["categories"]}
        # An assignment to a category that the answer doesn't list assigns nothing.
        found = ((a["record_id"], catalog.get(a["category_id"])) for a in done.data["assignments"])
        return Used(((r, c["canonical_question"], c["theme"]) for r, c in found if c), done.usage)

    over.rendered = True
    return over


def _unangled(text: str) -> str:
    return text.replace("<", " ").replace(">", " ")


def reduce_call(call: Callable, prompt: Prompt, max_repairs: int = MAX_REPAIRS) -> Callable[[list[tuple[int, str, str]]], Used]:
    """A reduce call for ModelClassifier from a model's text completion.

    Categories are shown by their place in the batch, so nothing that a model wrote can pass for
    an id or a tag; ids that are no places are passed over.
    """

    def over(categories: list[tuple[int, str, str]]) -> Used:
        places = {f"c{i}": p for i, (p, _, _) in enumerate(categories)}
        rendered = "\n".join(f'<kategori id="c{i}" tema="{_unangled(t)}">{_unangled(q)}</kategori>' for i, (_, q, t) in enumerate(categories))
        done = complete(call, prompt.reduce_system, prompt.reduce_user.format(categories=rendered), REDUCE_SHAPE, max_repairs)
        return Used((Merge([places[m] for m in g["member_category_ids"] if m in places], g["canonical_question"], g["theme"]) for g in done.data["groups"]), done.usage)

    return over


class TextClassifier(ModelClassifier):
    """ModelClassifier from a model's text completion, with the prompt that goes with what is analysed.

    Conversations, whose groups have a context, take the prompt of conversations; another
    version with them, or that one with messages, is an error.
    """

    def __init__(self, identifier: str, call: Callable, version: str | None = None, merge: bool = True, max_repairs: int = MAX_REPAIRS, **options) -> None:
        super().__init__(identifier, call, None, **options)
        self.call, self.version, self.merge, self.max_repairs = call, version, merge, max_repairs

    def classify(self, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        contextual = "context" in groups.columns
        prompt = prompt_for(self.version or (CONTEXTUAL if contextual else DEFAULT), contextual)
        self.call_map = map_call(self.call, prompt, self.max_repairs)
        self.call_reduce = reduce_call(self.call, prompt, self.max_repairs) if self.merge else None
        return super().classify(groups)


def fake_text_model(theme_words: dict[str, str], bad_first: int = 0, drop_every: int = 0) -> Callable[[list[tuple[str, str]]], str]:
    """A completion for tests: records by the first theme word they have; the first bad_first answers of a
    conversation are no JSON, and each drop_every-th record is left out."""
    import re

    def call(messages: list[tuple[str, str]]) -> str:
        if (len(messages) - 2) // 2 < bad_first:
            return "```json\n{broken"
        user, used, assigned = messages[1][1], {}, []
        for k, (record, text) in enumerate(re.findall(r'<kayit id="([^"]*)">(.*?)</kayit>', user, re.DOTALL)):
            theme = next((t for w, t in theme_words.items() if w in text.lower()), "Diğer")
            used[theme] = {"category_id": theme, "canonical_question": f"{theme} nedir?", "theme": theme}
            if not drop_every or (k + 1) % drop_every:
                assigned.append({"record_id": record, "category_id": theme})
        return "```json\n" + json.dumps({"categories": list(used.values()), "assignments": assigned}, ensure_ascii=False) + "\n```"

    return call
