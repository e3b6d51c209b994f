"""What a workbook's cells say as text: numbers in one canonical form, serial numbers as dates, text without phonetics."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree as X

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Built-in number formats that show dates or times, of these the one that shows a span, and the first id of a workbook's own formats.
DATES, SPANS, OWN_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47), (46,), 164
#: The day before the first of each calendar, and the text of a serial that is no date.
EPOCHS, NO_DATE = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}, "#VALUE!"
#: A day that the first calendar counts though it never was.
GHOST_DAY = 60
QUOTED = re.compile(r'"[^"]*"')
BRACKETED = re.compile(r"\[([^\]]*)\]")
SPAN_UNIT = re.compile(r"(?i)hh?|mm?|ss?")
NUMBER_WITH_POINT = re.compile(r"[.eE]")


def format_kind(code: str) -> str | None:
    """date, span or None: whether a format's first section shows a moment, a length of time, or neither."""
    section = QUOTED.sub("", code.split(";")[0])
    span = False
    for inner in BRACKETED.findall(section):
        span = span or bool(SPAN_UNIT.fullmatch(inner))
    letters = BRACKETED.sub(lambda m: m[1] if SPAN_UNIT.fullmatch(m[1]) else "", section)
    if not re.search(r"(?i)(?<![_\\])[dmhys]", letters):
        return None
    return "span" if span else "date"


class Styles:
    """How each cell style of a workbook shows numbers, and the calendar that serial numbers count in."""

    def __init__(self, styles: bytes | None, workbook: bytes) -> None:
        self.kinds: list[str | None] = []
        if styles:
            root = X.fromstring(styles)
            own = {int(f.get("numFmtId")): format_kind(f.get("formatCode") or "") for f in root.iter(f"{MAIN}numFmt")}
            for xf in next(root.iter(f"{MAIN}cellXfs"), ()):
                k = int(xf.get("numFmtId") or 0)
                self.kinds.append(own.get(k) if k >= OWN_FORMATS or k in own else "span" if k in SPANS else "date" if k in DATES else None)
        props = next(X.fromstring(workbook).iter(f"{MAIN}workbookPr"), None)
        self.late = props is not None and (props.get("date1904") or "0") in ("1", "true")

    def kind(self, style: str | None) -> str | None:
        k = int(style or 0)
        return self.kinds[k] if k < len(self.kinds) else None


def moment(value: float, late: bool) -> str:
    """A serial number as text: a time of day below one, else a date with its time."""
    days, part = divmod(value, 1)
    rest = timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= value < 1 and not rest.days:
        return str((datetime.min + rest).time())
    if 0 < value < GHOST_DAY and not late:
        days += 1
    try:
        return str(EPOCHS[late] + timedelta(days=days) + rest)
    except OverflowError:
        return NO_DATE


def span(value: float) -> str:
    """A length of time as text, to the millisecond."""
    try:
        t = timedelta(days=value)
    except OverflowError:
        return NO_DATE
    if t.microseconds:
        t = timedelta(seconds=t.total_seconds() // 1, microseconds=round(t.microseconds, -3))
    return str(t)


def number(text: str, kind: str | None = None, late: bool = False) -> str:
    """A number of the sheet as text: whole ones without a point, others by their shortest form; a date style makes it a date."""
    value = float(text) if NUMBER_WITH_POINT.search(text) else int(text)
    if kind == "date":
        return moment(value, late)
    if kind == "span":
        return span(value)
    return str(value)


def iso_moment(text: str) -> str:
    """An ISO 8601 cell as text, as the same moment's serial number would read."""
    text = text.removesuffix("Z")
    for read in (datetime.fromisoformat, date.fromisoformat, time.fromisoformat):
        try:
            got = read(text)
        except ValueError:
            continue
        return str(got)
    return text


def words(e: X.Element) -> str:
    """The text of a string item: its own and that of its runs; phonetic runs tell how it is read and are no part of it."""
    out = []
    for part in e:
        if part.tag == f"{MAIN}t":
            out.append(part.text or "")
        elif part.tag == f"{MAIN}r":
            out += [t.text or "" for t in part.iter(f"{MAIN}t")]
    return "".join(out)


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in X.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append(words(e))
                e.clear()
    return out


def cell(c: X.Element, shared: list[str], styles: Styles) -> tuple[str | None, bool]:
    """(text, whether it is a string) of a cell. Of a formula that is the value it had when saved."""
    kind = c.get("t") or "n"
    if kind == "inlineStr":
        inner = c.find(f"{MAIN}is")
        return (None, False) if inner is None else (words(inner), True)
    v = c.find(f"{MAIN}v")
    if v is None or v.text is None:
        return None, False
    if kind == "s":
        return shared[int(v.text)], True
    if kind == "b":
        return str(bool(int(v.text))), False
    if kind == "d":
        return iso_moment(v.text), False
    if kind == "n":
        return number(v.text.strip(), styles.kind(c.get("s")), styles.late), False
    return v.text, True


# --- ranges of one sheet -------------------------------------------------------------------------

ROW, ROOT, REST = re.compile(rb"<row[\s/>]"), re.compile(rb"<worksheet\b[^>]*>"), b"</sheetData>"
PIECE = 1 << 20


def _cuts(f) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a member as it unpacks, cut before a tag, so that no tag's name is torn."""
    held, at = b"", 0
    while piece := f.read(PIECE):
        held += piece
        if (cut := held.rfind(b"<")) > 0:
            yield at, held[:cut]
            held, at = held[cut:], at + cut
    if held:
        yield at, held


def row_elements(f, begin: int, end: int) -> Iterator[tuple[int, X.Element]]:
    """(rows before, row) of the rows that start in the unpacked bytes [begin, end) of a sheet.

    What stands before is unpacked and its rows are counted, but only these rows are parsed;
    the sheet is never held whole. Tags without prefixes alone are found.
    """
    before, root, parser = 0, None, None
    for at, text in _cuts(f):
        if root is None and (m := ROOT.search(text)):
            root = m[0]
        starts = [m.start() for m in ROW.finditer(text)] if root else []
        stop = next((s for s in starts if at + s >= end), text.find(REST) if root and REST in text else None)
        first = 0
        if parser is None:
            first = next((s for s in starts if at + s >= begin), None)
            before += len(starts) if first is None else starts.index(first)
            if first is not None and first != stop:
                parser = X.XMLPullParser(("start", "end"))
                parser.feed(root)
        if parser:
            parser.feed(text[first:stop])
            for event, e in parser.read_events():
                if event == "start" and e.tag == f"{MAIN}worksheet":
                    top = e
                elif event == "end" and e.tag == f"{MAIN}row":
                    yield before, e
                    before += 1
                    top.remove(e)
        if stop is not None:
            return


def prefixed_rows(f) -> Iterator[tuple[int, X.Element]]:
    """The same of a whole sheet whose tags have prefixes."""
    before = 0
    for _, e in X.iterparse(f):
        if e.tag == f"{MAIN}row":
            yield before, e
            before += 1
            e.clear()
