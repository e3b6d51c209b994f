"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matching, scores normalised by length."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import handed_back, materialise

#: Letters of other scripts, and signs, that are read as Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "π": "n", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ø": "o", "ł": "i", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i",
}
#: Phrases in which lexicon words don't count, besides those that `learn` finds in any language.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "loser bracket", "stupid simple")
STEMS = (4, 5, 6)
#: The least log odds of an entry.
LEAST_W = 2.0
#: Clean sampled documents that a phrase needs at least to be an exception.
LEAST_CLEAN = 5
#: Features that a task counts before it hands them on.
FLUSH = 1 << 17


class Fold(dict):
    """A str.translate table that is filled as characters occur: lower case, no accents,
    lookalikes and digits as letters (i, l and 1 are one letter), all other characters as spaces;
    format characters and apostrophes go."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = ""
        for x in unicodedata.normalize("NFKD", c.lower()):
            if unicodedata.category(x) in ("Mn", "Cf") or x in "'’ʼ`":
                continue
            x = LOOKALIKES.get(x, x)
            out += x if x.isalpha() else " "
        self[code] = out
        return out


FOLD = Fold()


def folded(text: str | None) -> list[str]:
    """The words of a text in folded form."""
    return (text or "").translate(FOLD).split()


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and stems, both folded, and the curve from what matches to a score.

    A word matches whole, a stem the start of a word. curve has the constant and the factors
    of log(1 + sum of weights) and log(1 + sum of weights per 100 words).
    """

    words: tuple[tuple[str, float], ...] = ()
    stems: tuple[tuple[str, float], ...] = ()
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        """words of a text -> sum of weights of the entries that match outside exception phrases, each once."""
        import ahocorasick

        a = ahocorasick.Automaton()
        found: dict[str, float] = {}
        for p, w in [*((f" {x} ", w) for x, w in self.words), *((f" {x}", w) for x, w in self.stems)]:
            found[p] = max(w, found.get(p, 0.0))
        for p, w in found.items():
            a.add_word(p, (len(p), w, p))
        spared = [f" {' '.join(folded(x))} " for x in self.exceptions]
        for p in spared:
            a.add_word(p, (len(p), -1.0, p))
        if not len(a):
            return lambda words: 0.0
        a.make_automaton()

        def weigh(words: list[str]) -> float:
            hits = [(end - n + 1, end, w, k) for end, (n, w, k) in a.iter(" " + " ".join(words) + " ")]
            safe = [(s, e) for s, e, w, _ in hits if w < 0]
            if safe:
                hits = [(s, e, w, k) for s, e, w, k in hits if w > 0 and not any(x <= s and e <= y for x, y in safe)]
            return sum(dict((k, w) for _, _, w, k in hits).values())

        return weigh

    def score(self, weight: float, n_words: int) -> float:
        c, u, v = self.curve
        z = c + u * math.log1p(weight) + v * math.log1p(100 * weight / max(1, n_words))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _held(id_col) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of each labelled document that isn't held out; of differing labels toxic counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, k: int = 5) -> DataFrame:
    """(doc_id, text, toxic, half): of each label at most `most` documents that aren't held out, the least by a hash of doc_id.

    Copies and near copies are no evidence of their own: of sampled texts of one label whose
    least hash of k successive words is the same, only the one of least doc_id is returned,
    and that hash also deals texts to halves, so that copies don't lie in both.
    """
    known = _known(labels)
    ids = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    picked = ids[0].union(ids[1]).select(F.col("doc_id").alias("_id"), "toxic")
    # At most 2 * most ids of 12 bytes: a bound that does not grow with the tables.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    words = F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+")
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - F.lit(k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, k))))
    alike = rows.withColumn("_w", words).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), least.alias("_g"))
    first = alike.groupBy("_g", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("_r"))
    return first.select("_r.doc_id", "_r.text", "toxic", F.pmod(F.xxhash64("_g", F.lit(7)), F.lit(2)).cast("int").alias("half"))


def _counted(batches: Iterable[pa.RecordBatch], features) -> Iterable[pa.RecordBatch]:
    """(feature, n, toxic, half): in how many documents of each label and half a task meets each of features(words).

    Counts are handed on whenever FLUSH of them are held, so a task's memory doesn't grow with its documents.
    """
    found: dict[tuple[int, int], Counter] = {}

    def flush():
        for (toxic, half), c in found.items():
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([toxic] * len(keys), pa.int32()), pa.array([half] * len(keys), pa.int32())], names=["feature", "n", "toxic", "half"])
        found.clear()

    for b in batches:
        for text, toxic, half in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            found.setdefault((toxic, half), Counter()).update(features(folded(text.as_py())))
            if sum(map(len, found.values())) >= FLUSH:
                yield from flush()
    yield from flush()


def _features(words: list[str]) -> set[str]:
    """The words of a text as =word and the stems of its words as ^stem."""
    words = set(words)
    return {"=" + w for w in words if len(w) > 2} | {"^" + w[:n] for w in words for n in STEMS if len(w) > n}


def _phrases(lexicon: Lexicon):
    """words of a text -> the pairs of neighbouring words of which an entry matches one."""
    whole, stems = {w for w, _ in lexicon.words}, {w for w, _ in lexicon.stems}

    def of(words: list[str]) -> set[str]:
        hit = [w in whole or any(w[:n] in stems for n in STEMS) for w in words]
        return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}

    return of


def _lexicon(counts: list, totals: dict[int, int], least_z: float) -> Lexicon:
    """The words and stems that toxic documents have significantly more often, weighted by log odds."""
    scored = {}
    for feature, a, b in counts:
        w = math.log((a + 0.5) / (totals[1] + 1) / ((b + 0.5) / (totals[0] + 1)))
        z = w / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= 3 and w >= LEAST_W and z >= least_z:
            scored[feature] = (z, w)
    kept: dict[str, float] = {}
    # A stem speaks for the longer stems and words that begin with it, if they weigh no more.
    for feature, (_, w) in sorted(scored.items(), key=lambda x: (-x[1][0], len(x[0]), x[0])):
        if not any(kept.get("^" + feature[1 : 1 + n], -9.0) >= w - 0.2 for n in STEMS if n < len(feature) - (feature[0] == "^")):
            kept[feature] = w
    return Lexicon(tuple((f[1:], w) for f, w in kept.items() if f[0] == "="), tuple((f[1:], w) for f, w in kept.items() if f[0] == "^"))


def _exceptions(sample: DataFrame, lexicon: Lexicon, number: dict[int, int]) -> tuple[str, ...]:
    """Phrases with a lexicon word that clean documents of the sample have no less often than toxic ones.

    Only those that hold are collected; like the entries they are bounded by the sample.
    """
    if not lexicon.words and not lexicon.stems:
        return ()
    of = _phrases(lexicon)
    n = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias("ab"[1 - t])
    seen = sample.select("text", "toxic", "half").mapInArrow(handed_back(lambda b: _counted(b, of)), "feature string, n bigint, toxic int, half int").groupBy("feature").agg(n(1), n(0))
    clean = seen.where((F.col("b") >= LEAST_CLEAN) & ((F.col("a") + 0.5) / (number[1] + 1) <= (F.col("b") + 0.5) / (number[0] + 1)))
    return tuple(sorted(r.feature for r in clean.select("feature").collect()))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a small ridge, by Newton steps; slopes below 0 are left out."""
    b = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, most: int = 4000, least_z: tuple[float, ...] = (2.6, 3.3, 4.2, 5.5)) -> Lexicon:
    """A lexicon from labelled documents that aren't held out.

    most: the bound of the sample, in documents of each label. Document
    frequencies of words and stems are counted on the executors; the driver gets those of
    candidates and two numbers of each sampled document, both bounded by the sample. The curve
    is fitted crosswise: each half of the sample is matched with a lexicon from the other, and
    of the significance levels least_z that is taken whose crosswise fit is best. Pairs of
    words with an entry in them that are no sign of toxicity become exception phrases.
    Null labels are ignored. Without toxic or without clean samples every score is 0 or 1.
    """
    sample = materialise(labelled_sample(docs, labels, most), "toxic-sample")
    totals = {(t, h): n for t, h, n in sample.groupBy("toxic", "half").count().collect()}
    number = {t: sum(n for (a, _), n in totals.items() if a == t) for t in (0, 1)}
    if not number[0] or not number[1]:
        return Lexicon(curve=(30.0 if number[1] else -30.0, 0.0, 0.0))
    total = {(t, h): totals.get((t, h), 0) for t in (0, 1) for h in (0, 1)}
    # What no lexicon of a half or of all can take stays on the executors.
    counted = [("a0", "b0", total[1, 0], total[0, 0]), ("a1", "b1", total[1, 1], total[0, 1]), ("(a0 + a1)", "(b0 + b1)", number[1], number[0])]
    n = lambda t, h: F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), F.col("n")).otherwise(0))
    seen = (
        sample.select("text", "toxic", "half")
        .mapInArrow(handed_back(lambda b: _counted(b, _features)), "feature string, n bigint, toxic int, half int")
        .groupBy("feature")
        .agg(n(1, 0).alias("a0"), n(1, 1).alias("a1"), n(0, 0).alias("b0"), n(0, 1).alias("b1"))
        .where(" or ".join(f"({a} >= 3 and ln(({a} + 0.5) / ({b} + 0.5)) >= {LEAST_W + math.log((t + 1) / (c + 1)) - 1e-9!r})" for a, b, t, c in counted))
        .collect()
    )
    halves = [[_lexicon([(r.feature, r[f"a{1 - h}"], r[f"b{1 - h}"]) for r in seen], {t: total[t, 1 - h] for t in (0, 1)}, z) for z in least_z] for h in (0, 1)]
    crossed = [r for h in (0, 1) for r in _weighed(sample.where(F.col("half") == h), halves[h]).select("weights", "n_words", "toxic").collect()]
    prior = {t: c for t, c in _known(labels).groupBy("toxic").count().collect()}
    each = {t: prior.get(t, 0) / max(1, sum(prior.values())) / number[t] * sum(number.values()) for t in (0, 1)}
    y = np.array([t for _, _, t in crossed], float)
    share = np.where(y == 1, each[1], each[0])
    best = None
    for k, z in enumerate(least_z):
        x = np.array([[1, math.log1p(w[k]), math.log1p(100 * w[k] / max(1, n))] for w, n, _ in crossed])
        curve = _curve(x, y, share)
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        loss = -(share * np.log(np.where(y == 1, p, 1 - p))).sum()
        if best is None or loss < best[0]:
            best = (loss, z, curve)
    whole = _lexicon([(r.feature, r.a0 + r.a1, r.b0 + r.b1) for r in seen], number, best[1])
    return Lexicon(whole.words, whole.stems, best[2], (*EXCEPTIONS, *_exceptions(sample, whole, number)))


def _weighed(docs: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """docs' other columns with each lexicon's sum of matched weights and the number of words of each text."""
    rest = [c for c in docs.columns if c not in ("text", "weights", "n_words")]
    schema = docs.select(*rest).schema

    def over(batches):
        weighs = [x.matcher() for x in lexicons]
        for b in batches:
            words = [folded(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([[float(f(w)) for f in weighs] for w in words], pa.list_(pa.float64())), pa.array([len(w) for w in words], pa.int64())], names=[*rest, "weights", "n_words"])

    return docs.select("text", *rest).mapInArrow(handed_back(over), schema.add("weights", T.ArrayType(T.DoubleType())).add("n_words", "long"))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) of every row: predicted is 1 from a score of 0.5 on.

    Only the text counts; a null text is an empty one and has the score of no match. Rows are
    not shuffled; repeated rows, null ids and other columns have no effect.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def over(batches):
        weigh = lexicon.matcher()
        for b in batches:
            scores = [lexicon.score(weigh(w), len(w)) for t in b.column(1) for w in (folded(t.as_py()),)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(handed_back(over), "doc_id bigint, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a lexicon learned from the labels of rows not held out.

    Held out are rows whose crc32 of doc_id as text leaves 0 by 5 (a null id counts as empty text).
    """
    return score(docs, learn(docs, labels, **options)).select("doc_id", _held(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, all columns, whose texts score below 0.5."""
    lexicon = learn(docs, labels, **options)
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def over(batches):
        weigh = lexicon.matcher()
        for b in batches:
            clean = [lexicon.score(weigh(w), len(w)) < 0.5 for t in b.column(at) for w in (folded(t.as_py()),)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(handed_back(over), schema)
