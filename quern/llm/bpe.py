"""Word-level BPE of a tokenizer file: encoding, decoding, and token counts of every prefix.

The tokenizer's own library normalises and splits any text outside plain Latin; the merging,
the counts and the decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import handed_back

NONE = 1 << 60
#: Words of at most so many symbols use the rank array; longer ones a heap, as repeated scans are quadratic.
SHORT = 128
#: Bounds of a task's caches, in entries of at most CACHED letters: words with their counts, prefixes with their states, words with their ids, pairs of tokens.
COUNTED, STATES, CODED, PAIRS, CACHED = 300_000, 300_000, 250_000, 200_000, 64
#: Texts of these characters need no other normalisation than white space and lower case.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ž]*")
#: Fixed value: the split of the tokenizer file, in this module's regex syntax.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(256 + others.index(b)) for b in range(256)]


class UnknownLetter(ValueError):
    """A word has a letter that the vocabulary lacks."""


class WordBPE:
    """A BPE model with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {v: k for k, v in (self.vocab | self.special).items()}
        own = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        self.known_split = SPLIT in own
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.longest = max(len(t) - len(self.end) * t.endswith(self.end) for t in self.vocab)
        self.states = Cached(self.prefix_state, STATES)
        self.pairs = Cached(lambda p: self.follows(p >> 32, p & 0xFFFFFFFF), PAIRS)

    def forget(self) -> None:
        """Drops what was kept of the words met, but not the model."""
        self.states.forget()
        self.pairs.forget()

    # --- words -------------------------------------------------------------------------

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, string) parts: special strings are found before any normalisation."""
        if self.specials is None or "<" not in text:
            yield False, text
            return
        for part in self.specials.split(text):
            if part:
                yield part in self.special, part

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, as letters of the vocabulary's alphabet."""
        if self.known_split and text.isascii() and text.islower():
            if text.isalpha():
                return [text]
            if text[-1] in ".,;:!?" and text[:-1].isalpha():
                return [text[:-1], text[-1]]
        if self.known_split and PLAIN.fullmatch(text):
            found = self.split.findall(text.lower())
            return found if text.isascii() else [w if w.isascii() else self.spelled(w) for w in found]
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def spelled(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    # --- encoding ----------------------------------------------------------------------

    def symbols(self, word: str, closed: bool = True) -> list[str]:
        parts = list(word)
        if closed:
            parts[-1] += self.end
        return parts

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of a word. parts holds the pieces between the boundaries, ranks[i] the
        rank of pieces i and i+1 joined; the least leftmost rank's boundary goes and its
        neighbours' ranks are looked up anew."""
        if len(parts) > SHORT:
            return self.merge_long(parts)
        get = self.rank.get
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((joined, parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((parts[i - 1], joined), NONE)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of (rank, place) and a linked list of pieces."""
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]), NONE)) < NONE]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or rank.get((parts[i], parts[j]), NONE) != r:
                continue
            parts[i] += parts[j]
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((parts[i], parts[after[i]]), NONE)) < NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank.get((parts[before[i]], parts[i]), NONE)) < NONE:
                heapq.heappush(heap, (r, before[i]))
        return [p for p, x in zip(parts, gone) if not x]

    def word_ids(self, word: str) -> list[int]:
        # Tokens outside the vocabulary are left out, as a model without an unknown token does.
        return [i for t in self.merge(self.symbols(word)) if (i := self.vocab.get(t)) is not None]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self.segments(text):
            if special:
                out.append(self.special[part])
            else:
                for w in self.words(part):
                    out += self.word_ids(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own the file's tokens are joined by spaces; unknown ids are skipped."""
        return " ".join(t for i in ids if (t := self.token.get(i)) is not None)

    # --- counts of prefixes --------------------------------------------------------------

    def sound(self, token: str) -> bool:
        """Whether BPE makes this token of its own letters, so that it can occur at all."""
        return self.merge(self.pieces(token)) == [token]

    def pieces(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            return self.symbols(token[: -len(self.end)])
        return list(token)

    @cached_property
    def opening(self) -> dict[str, int]:
        """The ids of sound tokens that go on."""
        return {t: i for t, i in self.vocab.items() if not t.endswith(self.end) and self.sound(t)}

    @cached_property
    def closing(self) -> dict[str, int]:
        """The ids of sound tokens that end a word, by what stands before the word end."""
        return {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end) and t != self.end and self.sound(t)}

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE keeps the boundary between tokens a and b."""
        x, y = self.token[a], self.token[b]
        return self.merge(list(x) + self.pieces(y)) == [x, y]

    def prefix_state(self, prefix: str) -> int:
        """Last token and number of tokens, as token << 32 | number, of a word's first letters.

        A run of tokens is the BPE of its letters exactly if each is sound and each pair of
        neighbours is; so the last token of a prefix is the one that follows the last token
        of what stands before it. States are kept by prefix, as words share most of theirs.
        """
        opening, pairs, states, n = self.opening, self.pairs, self.states, len(prefix)
        for at in range(n - self.longest if n > self.longest else 0, n):
            if (x := opening.get(prefix[at:])) is not None:
                if not at:
                    return x << 32 | 1
                before = states[prefix[:at]]
                if pairs[before >> 32 << 32 | x]:
                    return x << 32 | (before & 0xFFFFFFFF) + 1
        raise UnknownLetter(prefix)

    def closed_count(self, word: str) -> int:
        """The tokens of a whole word: its closing token, which has the word end, and those before it."""
        closing, pairs, states, n = self.closing, self.pairs, self.states, len(word)
        for at in range(n - self.longest if n > self.longest else 0, n):
            if (x := closing.get(word[at:])) is not None:
                if not at:
                    return 1
                before = states[word[:at]]
                if pairs[before >> 32 << 32 | x]:
                    return (before & 0xFFFFFFFF) + 1
        raise UnknownLetter(word)

    def prefix_counts(self, word: str) -> list[int]:
        """counts[i]: the tokens of a text that ends after the word's first i letters.

        A word with a letter that the vocabulary lacks has no such states: its prefixes are merged one by one.
        """
        if not self.known(word):
            return [0, *(len(self.word_ids(word[:i])) for i in range(1, len(word) + 1))]
        last, size = self.filled(word)
        return [0, *(self.closed(word[:i], last, size) for i in range(1, len(word) + 1))]

    def filled(self, word: str) -> tuple[list[int], list[int]]:
        """The states of all prefixes as two rows of numbers, filled from the left."""
        n, last, size = len(word), [-1] * len(word), [0] * len(word)
        for i in range(1, n):
            for at in range(max(0, i - self.longest), i):
                if (x := self.opening.get(word[at:i])) is not None and (not at or last[at] >= 0 and self.pairs[last[at] << 32 | x]):
                    last[i], size[i] = x, size[at] + 1
                    break
        return last, size

    def closed(self, word: str, last: list[int], size: list[int]) -> int:
        n = len(word)
        for at in range(max(0, n - self.longest), n):
            if (x := self.closing.get(word[at:])) is not None and (not at or last[at] >= 0 and self.pairs[last[at] << 32 | x]):
                return size[at] + 1
        raise UnknownLetter(word)

    def known(self, word: str) -> bool:
        """Whether the vocabulary has every letter of a word, inside it and at its end."""
        return all(c in self.opening for c in word[:-1]) and word[-1:] in self.closing

    def count(self, word: str) -> int:
        """The tokens of a whole word. The states of long words are not kept.

        Tokens outside the vocabulary don't count, as the encoding leaves them out.
        """
        try:
            return self.closed_count(word) if len(word) <= CACHED else self.closed(word, *self.filled(word))
        except UnknownLetter:
            return len(self.word_ids(word))


class Cached(dict):
    """What make gives for each key. Of two halves of the bound the older goes, unless used meanwhile."""

    def __init__(self, make, bound: int) -> None:
        super().__init__()
        self.make, self.half, self.old = make, bound // 2, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if isinstance(key, int) or len(key) <= CACHED:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got

    def forget(self) -> None:
        self.old = {}
        self.clear()


@lru_cache(maxsize=1)
def load(path: str) -> WordBPE:
    return WordBPE(path)


class PrefixCounts:
    """Exact token counts of every prefix of a text that ends between characters of its normal form.

    Built once, it answers without re-encoding: count(i), the tokens of the first i
    characters of `normal`, and longest(budget), the most characters with at most that many
    tokens. Special strings count one and can't be cut: a prefix that ends inside one counts
    what stands before it.
    """

    def __init__(self, model: WordBPE, text: str) -> None:
        self.normal, ends, counts, total = "", [0], [0], 0
        for special, part in model.segments(text or ""):
            if special:
                total += 1
                base = len(self.normal)
                ends.append(base + len(part))
                counts.append(total)
                self.normal += part
                continue
            base, norm = len(self.normal), model.tok.normalizer.normalize_str(part)
            for m in model.split.finditer(norm):
                letters = [model.spelled(c) for c in m[0]]
                by_letter = model.prefix_counts("".join(letters))
                at = 0
                for k, c in enumerate(letters):
                    at += len(c)
                    ends.append(base + m.start() + k + 1)
                    counts.append(total + by_letter[at])
                total += by_letter[at]
            self.normal += norm
        self.ends, self.counts = np.array(ends), np.array(counts)

    def count(self, n_chars: int) -> int:
        return int(self.counts[np.searchsorted(self.ends, n_chars, side="right") - 1])

    def longest(self, budget: int) -> int:
        """The longest prefix, in characters of `normal`, such that it has at most `budget` tokens."""
        fits = np.flatnonzero(self.counts <= budget)
        k = int(fits[-1])
        return len(self.normal) if k + 1 == len(self.ends) else int(self.ends[k + 1]) - 1


def _mapped(docs: DataFrame, path: str, row, schema: str, columns: list[str]) -> DataFrame:
    """Applies row(model)(text) to each text; texts go by in Arrow batches, a few MB of rows at a time.

    A Python worker serves other operators afterwards, so what a task kept of its words goes
    with the task; the model stays.
    """
    fields = pa.schema([("doc_id", pa.int64()), *columns])

    def over(batches):
        model = load(path)
        f = row(model)
        try:
            for b in batches:
                out = [f(t.as_py() or "") for t in b.column(1)]
                cols = list(zip(*out)) if out else [[] for _ in columns]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, fields.field(k + 1).type) for k, c in enumerate(cols))], schema=fields)
        finally:
            model.forget()

    return docs.select("doc_id", "text").mapInArrow(handed_back(over), f"doc_id bigint, {schema}")


def _runs(model: WordBPE, text: str) -> list[str]:
    """The runs of a text without white space in them, in normal form; special strings are runs of their own."""
    if PLAIN.fullmatch(text) and "<" not in text:
        return text.lower().split()
    return [s for special, part in model.segments(text) for s in ([part] if special else model.tok.normalizer.normalize_str(part).split(" ")) if s]


def _counter(model: WordBPE):
    """text -> number of tokens."""
    known = Cached(lambda run: 1 if run in model.special else sum(map(model.count, model.words(run))), COUNTED)
    return lambda text: sum(map(known.__getitem__, _runs(model, text)))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, by prefix counts of its words.

    A null text counts as empty and has no tokens; rows are never joined or shuffled, so
    repeated rows, null ids and other columns have no effect. A task keeps the
    counts of the words it has met, up to COUNTED of them.
    """

    def row(model: WordBPE):
        count = _counter(model)

        def one(text: str):
            n = count(text)
            return len(text.encode()), n, n > limit

        return one

    return _mapped(docs, path, row, "n_bytes bigint, n_tokens bigint, over_limit boolean", [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """(doc_id, n_tokens, text): the longest prefix of each normalised text within a budget of tokens."""

    def row(model: WordBPE):
        def one(text: str):
            p = PrefixCounts(model, text)
            cut = p.longest(budget)
            return p.count(cut), p.normal[:cut]

        return one

    return _mapped(docs, path, row, "n_tokens bigint, text string", [("n_tokens", pa.int64()), ("text", pa.string())])


def _coder(model: WordBPE):
    """text -> (its ids as bytes, their decoding)."""
    four = {t: i.to_bytes(4, "little") for t, i in (model.vocab | model.special).items()}

    def of_word(word: str) -> tuple[bytes, str]:
        tokens = model.merge(model.symbols(word))
        if not four.keys() >= set(tokens):
            tokens = [t for t in tokens if t in four]
        return b"".join([four[t] for t in tokens]), " ".join(tokens)

    by_word = Cached(of_word, CODED)

    def of_run(run: str) -> tuple[bytes, str]:
        if run in model.special:
            return four[run], run
        found = [by_word[w] for w in model.words(run)]
        return found[0] if len(found) == 1 else (b"".join([i for i, _ in found]), " ".join([d for _, d in found if d]))

    known = Cached(of_run, CODED)
    gaps = not all(c in model.vocab and c + model.end in model.vocab for c in model.letters)

    def coded(text: str) -> tuple[bytes, str]:
        runs = list(map(known.__getitem__, _runs(model, text)))
        return b"".join([i for i, _ in runs]), " ".join([d for _, d in runs if d] if gaps else [d for _, d in runs])

    return coded


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): token ids as little-endian unsigned 32-bit integers, and their decoding.

    A null text counts as empty: no ids, an empty decoding. Rows are never shuffled;
    repeated rows, null ids and other columns have no effect.
    """
    return _mapped(docs, path, _coder, "ids binary, decoded string", [("ids", pa.binary()), ("decoded", pa.string())])


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same, digested where it is made."""

    def row(model: WordBPE):
        coded = _coder(model)

        def one(text: str):
            ids, decoded = coded(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    return _mapped(docs, path, row, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
