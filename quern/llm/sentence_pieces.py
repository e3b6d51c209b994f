"""Merge-type SentencePiece vocabularies: encoding by an agenda of adjacent pairs, and decoding.

The library reads nothing here but its model file's format; `mismatches` holds these ids
against the library's own, in the same Arrow batches.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise, repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Cached

#: What stands for a space inside pieces (U+2581).
SPACE = "▁"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fixed value: the type of merge models.
BPE = 2
#: ASCII punctuation, as a class of a pattern.
MARKS = r"!-/:-@\[-`{-~"
MARK = re.compile(f"[{MARKS}]")
#: A task keeps the ids of at most so many stretches of text that it has met.
KEPT = 400_000
#: Stretches longer than this are cut once more, wherever no piece spans two letters.
LONG = 24
#: What a pair costs that is no piece.
NEVER = float("inf")


class PieceBPE:
    """A merge-type model, read from a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != BPE:
            raise ValueError(f"{path} is not a merge-type model")
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        #: What a piece costs: its score, turned round for the heap.
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)}
        self.unused = {p.piece for p in proto.pieces if p.type == UNUSED}
        self.whole = sorted((p.piece for p in proto.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.normal_ids = frozenset(i for i, kind in enumerate(self.types) if kind in (NORMAL, USER_DEFINED, UNUSED))
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE} if proto.trainer_spec.byte_fallback else {}
        if self.byte and len(self.byte) < 256:
            raise ValueError(f"{path} falls back to bytes but has not all of them")
        self.value = {i: b for b, i in self.byte.items()}
        rules = proto.normalizer_spec
        self.prefixed, self.trimmed = rules.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix, rules.remove_extra_whitespaces
        self.plain = not rules.precompiled_charsmap and not self.trimmed and rules.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and not proto.denormalizer_spec.precompiled_charsmap
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Whether every pair has a cost below that of none, and no piece has a rule of its own.
        self.simple = not self.whole and not self.unused and all(c < NEVER for c in self.cost.values())
        #: Pairs of letters that some piece spans. No merge crosses any other pair.
        self.spans = {a + b for p in self.cost for a, b in pairwise(p)}
        #: Stretches that no merge crosses: spaces open them, and so do marks, unless a piece spans a mark and what stands before it.
        self.stretch = None
        if not self.whole and not any(b == SPACE != a for a, b in self.spans):
            bridges = "".join(re.escape(a) for a in sorted({a for a, b in self.spans if MARK.match(b) and not MARK.match(a)} - {SPACE}))
            other, unit = f"[^{SPACE}{MARKS}{bridges}]++", f"(?:[{MARKS}{bridges}]++|[^{SPACE}{MARKS}{bridges}]++(?![{MARKS}]))"
            self.stretch = re.compile(f"{SPACE}++{unit}*+(?:{other})?|{unit}++(?:{other})?|{other}")

    # --- encoding ----------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The text as the model sees it."""
        if not self.plain:
            return self.library.normalize(text)
        return (SPACE if self.prefixed else "") + text.replace(" ", SPACE) if text else ""

    def stretches(self, normal: str) -> list[str]:
        return self.stretch.findall(normal) if self.stretch else [normal] if normal else []

    def symbols(self, text: str) -> list[str]:
        """Letters, and the strings that the vocabulary wants whole."""
        if not self.whole:
            return list(text)
        return re.findall("|".join([*map(re.escape, self.whole), "."]), text, re.DOTALL)

    def merged(self, parts: list[str]) -> list[str]:
        """The pieces that are left when no adjacent pair joins to a piece any more.

        The agenda holds (score, place, joined text) of adjacent pairs, the highest score and
        then the leftmost first. An entry counts only if the pair at its place still reads so.
        """
        if self.simple and len(parts) <= LONG:
            return self.merged_few(parts)
        n, cost, whole, push, pop = len(parts), self.cost.get, self.whole, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        halves: dict[str, tuple[str, str]] = {}
        agenda = [(c, i, joined) for i, joined in enumerate(map(add, parts, parts[1:])) if (c := cost(joined)) is not None and not (whole and (parts[i] in whole or parts[i + 1] in whole))]
        if self.unused:
            halves |= {joined: (parts[i], parts[i + 1]) for _, i, joined in agenda if joined in self.unused}
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = pop(agenda)
            j = after[i]
            if j >= n or not parts[i] or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = right = after[j]
            left = before[i]
            if right < n:
                before[right] = i
                if (c := cost(both := joined + parts[right])) is not None and not (whole and (joined in whole or parts[right] in whole)):
                    push(agenda, (c, i, both))
                    if both in self.unused:
                        halves[both] = (joined, parts[right])
            if left >= 0 and (c := cost(both := parts[left] + joined)) is not None and not (whole and (joined in whole or parts[left] in whole)):
                push(agenda, (c, left, both))
                if both in self.unused:
                    halves[both] = (parts[left], joined)
        out = [p for p in parts if p]
        if not self.unused:
            return out
        return [x for p in out for x in self.resplit(p, halves)]

    def merged_few(self, parts: list[str]) -> list[str]:
        """The same for few letters: the cheapest pair, of equals the leftmost, is looked up in a list of all of them."""
        cost = self.cost.get
        costs = list(map(cost, map(add, parts, parts[1:]), repeat(NEVER)))
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], NEVER)
        return parts

    def resplit(self, piece: str, halves: dict[str, tuple[str, str]]) -> list[str]:
        """A piece that is marked unused falls back into the halves it was made of."""
        todo, out = [piece], []
        while todo:
            p = todo.pop()
            if p in self.unused and p in halves:
                todo += reversed(halves[p])
            else:
                out.append(p)
        return out

    def stretch_ids(self, text: str) -> list[int]:
        """Ids of a stretch of normal text. Long stretches are merged in parts that no piece joins."""
        if len(text) <= LONG or self.whole:
            found = self.merged(self.symbols(text))
        else:
            found, at, spans = [], 0, self.spans
            for k in range(1, len(text)):
                if text[k - 1 : k + 1] not in spans:
                    found += [text[at]] if k == at + 1 else self.merged(list(text[at:k]))
                    at = k
            found += self.merged(list(text[at:]))
        out = list(map(self.ids.get, found, repeat(self.unknown)))
        if self.unknown not in out:
            return out
        out = []
        for p in found:
            i = self.ids.get(p, self.unknown)
            if i != self.unknown:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def joined_unknown(self, ids: list[int]) -> list[int]:
        """Without bytes to fall back on, unknown pieces in a row are one."""
        return ids if self.byte else [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i]

    def encode(self, text: str) -> list[int]:
        return self.joined_unknown([i for s in self.stretches(self.normal(text)) for i in self.stretch_ids(s)])

    # --- decoding ----------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, the space put before the text taken off."""
        out: list[str] = []
        run = bytearray()
        opening = True
        if self.prefixed and not self.trimmed and self.normal_ids.issuperset(ids):
            text = "".join([self.pieces[i] for i in ids])
            return text[text.startswith(SPACE) :].replace(SPACE, " ")
        for i in ids:
            if (b := self.value.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
                opening = False
            kind, piece = self.types[i], self.pieces[i]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
                opening = False
                continue
            if opening and (self.prefixed or self.trimmed) and piece.startswith(SPACE):
                piece = piece[1:]
                opening = self.trimmed and not piece
            else:
                opening = False
            out.append(piece.replace(SPACE, " "))
        out.append(utf8(bytes(run)))
        return "".join(out)


def utf8(run: bytes) -> str:
    """Bytes as text; each byte that is part of no letter gives one replacement letter."""
    out, at = [], 0
    while at < len(run):
        try:
            return "".join(out) + run[at:].decode()
        except UnicodeDecodeError as e:
            out.append(run[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=1)
def load(path: str) -> PieceBPE:
    return PieceBPE(path)


def _coder(model: PieceBPE) -> tuple[Callable[[str], tuple[int, str, str]], Cached]:
    """text -> (number of ids, the ids in decimal joined by commas, their decoding), and what it keeps."""

    def of_stretch(stretch: str) -> tuple[int, str, str]:
        ids = model.stretch_ids(stretch)
        # A stretch of whole letters decodes alone; a leading id without text keeps its opening space.
        return len(ids), ",".join(map(str, ids)), model.decode([model.ids[SPACE], *ids])

    apart = model.plain and model.byte and model.prefixed and SPACE in model.ids
    known = Cached(of_stretch, KEPT)

    def coded(text: str) -> tuple[int, str, str]:
        if not text:
            return 0, "", ""
        if not apart:
            ids = model.encode(text)
            return len(ids), ",".join(map(str, ids)), model.decode(ids)
        counts, ids, decoded = zip(*map(known.__getitem__, model.stretches(model.normal(text))))
        return sum(counts), ",".join(ids), "".join(decoded)[1:]

    return coded, known


def _mapped(docs: DataFrame, path: str, row: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """row(text, coded) of each text, with its doc_id; texts go by in Arrow batches and aren't shuffled."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, known = _coder(load(path))
        # What is kept has no cycles: looking through hundreds of thousands of tuples for them finds nothing.
        collects = gc.isenabled()
        gc.disable()
        try:
            for b in batches:
                out = [row(t.as_py() or "", coded) for t in b.column(1)]
                columns = zip(*out) if out else [[] for _ in range(len(schema) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)
        finally:
            known.forget()
            if collects:
                gc.enable()

    return docs.select("doc_id", "text").mapInArrow(over, ddl)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every text, and their decoding.

    A null text counts as empty: no ids, an empty decoding. Rows are never shuffled or joined,
    so repeated rows, null ids and columns of other names have no effect; an empty table gives
    no rows. A text of any length is cut into stretches that no merge crosses, so the agenda
    is as long as a stretch, not as a text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def row(text: str, coded: Callable) -> tuple[list[int], str]:
        _, ids, decoded = coded(text)
        return list(map(int, ids.split(","))) if ids else [], decoded

    return _mapped(docs, path, row, schema, "doc_id bigint, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same, digested where it is made."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(text: str, coded: Callable) -> tuple[int, str, str]:
        n, ids, decoded = coded(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, path, row, schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def mismatches(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_library, decoded_alike) of the texts whose ids or decoding differ from the library's.

    The library encodes the whole batch at once; no row means that all agree.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_library", pa.int64()), ("decoded_alike", pa.bool_())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        coded, known = _coder(model)
        try:
            for b in batches:
                texts = [t.as_py() or "" for t in b.column(1)]
                theirs = model.library.encode(texts, num_threads=1)
                out = []
                for doc_id, text, ids in zip(b.column(0).to_pylist(), texts, theirs):
                    n, own, decoded = coded(text)
                    alike = decoded == model.library.decode(ids)
                    if own != ",".join(map(str, ids)) or not alike:
                        out.append((doc_id, n, len(ids), alike))
                columns = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        finally:
            known.forget()

    return docs.select("doc_id", "text").mapInArrow(over, "doc_id bigint, n_tokens bigint, n_library bigint, decoded_alike boolean")
