"""Hashed word shingles of many texts at once, and distances between two texts' shingles."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of SplitMix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for name, b in (("p", _BASE | 1), ("q", pow(_BASE | 1, -1, 1 << 64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["q"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, and how many each text has.

    A word's hash is the difference of two prefix hashes shifted to its start, so equal words
    have equal hashes wherever they stand.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    p, q = _power(len(buf))
    x, prefix = buf.astype(np.uint64), np.zeros(len(buf) + 1, np.uint64)
    x += U(1)
    x *= p
    np.cumsum(x, out=prefix[1:])
    h = mix((prefix[ends] - prefix[starts]) * q[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    return h, np.diff(np.concatenate([[0], upto]))


def line_counts(texts: list[bytes]) -> np.ndarray:
    """How many words each line of all texts has."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[buf]])))[0::2]
    return np.diff(np.searchsorted(starts, np.flatnonzero(buf == 10)), prepend=0)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within each text; a text of 1 to k-1 words has one shingle of all of them."""
    n = np.where(counts > 0, np.maximum(1, counts - k + 1), 0)
    starts = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    s = np.zeros(len(h), np.uint64)
    for j in range(k):
        s = s * U(0xD6E8FEB86659FD93) + padded[j : j + len(h)]
    s = s[starts]
    # What is short of k words is filled up with numbers.
    short = np.flatnonzero(np.repeat(counts < k, n))
    if len(short):
        few, words = starts[short], np.repeat(counts, n)[short]
        s[short] = 0
        for j in range(k):
            s[short] = s[short] * U(0xD6E8FEB86659FD93) + np.where(j < words, padded[few + j], U(j + 1))
    return mix(s), n


def labelled(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shingles hashed with their number of occurrence in their text, so that each is unique there."""
    # Few stand more than once in all texts; only those are sorted by text and place.
    order = np.argsort(s)
    same = s[order][1:] == s[order][:-1]
    hit = np.zeros(len(s), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    some = np.flatnonzero(hit)
    out = s.copy()
    if not len(some):
        return out
    owner = np.repeat(np.arange(len(n)), n)[some]
    order = np.lexsort((s[some], owner))
    some, owner = some[order], owner[order]
    so, new = s[some], np.ones(len(some), bool)
    new[1:] = (so[1:] != so[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    nth = (np.arange(len(some)) - first).astype(np.uint64)
    out[some] = np.where(nth == 0, so, mix(so + nth * U(0xA24BAED4963EE407)))
    return out


class Prepared:
    """A text's labelled shingles, sorted, with their places."""

    def __init__(self, text: str | None, k: int, x: np.ndarray | None = None) -> None:
        if x is None:
            x = labelled(*shingles(*word_hashes([(text or "").lower().encode()]), k))
        self.n = len(x)
        self.place = np.argsort(x)
        self.sorted = x[self.place]


def prepared(texts: list[str | None], k: int) -> list[Prepared]:
    """Prepared of each text, hashed together."""
    s, n = shingles(*word_hashes([(t or "").lower().encode() for t in texts]), k)
    x, ends = labelled(s, n), np.cumsum(n).tolist()
    return [Prepared(t, k, x[e - m : e]) for t, e, m in zip(texts, ends, n.tolist())]


def common_counts(one: list[Prepared], other: list[Prepared], columns: int = 8192) -> np.ndarray:
    """How many labelled shingles each of one has in common with each of other.

    Shingles that stand on both sides are numbered and multiplied as 0/1 matrices, `columns` of them at a time.
    """
    sides = []
    for ready in (one, other):
        x = np.concatenate([p.sorted for p in ready] or [np.zeros(0, np.uint64)])
        sides.append((x, np.repeat(np.arange(len(ready)), [p.n for p in ready])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(one), len(other)), np.float32)
    if not len(both):
        return out
    if one is other:
        # What stands in a single text is common to none.
        names, times = np.unique(sides[0][0], return_counts=True)
        both = names[times > 1]
    placed = []
    for x, owner in sides:
        at = np.searchsorted(both, x)
        hit = (at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == x) if len(both) else np.zeros(len(x), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], owner[hit][order]))
    columns = min(columns, max(1, len(both)))
    for lo in range(0, len(both), columns):
        parts = []
        for (at, owner), ready in zip(placed, (one, other)):
            a, b = np.searchsorted(at, [lo, lo + columns])
            m = np.zeros((len(ready), columns), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising run of distinct numbers, in any gaps."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for x in places.tolist():
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def distance(a: Prepared, b: Prepared, ordered: bool, upto: float) -> float:
    """1 less the Jaccard index of labelled shingles; of those alone that align in order, if ordered.

    Both are metrics. Beyond `upto` any number above it may be returned: an alignment that is
    near enough leaves at most (n + m) * upto / (2 - upto) shingles out, which bounds how far
    partners' places can differ, and only partners within that band are aligned.
    """
    total = a.n + b.n
    if not a.n or not b.n:
        return 0.0 if a.n == b.n else 1.0
    if 1 - min(a.n, b.n) / max(a.n, b.n) > upto:
        return 1.0
    at = np.searchsorted(b.sorted, a.sorted)
    at[at == b.n] = 0
    hit = b.sorted[at] == a.sorted
    same = int(hit.sum())
    if not ordered or 1 - same / (total - same) > upto:
        return 1 - same / (total - same)
    i, j = a.place[hit], b.place[at[hit]]
    near = np.abs(i - j) <= total * upto / (2 - upto)
    i, j = i[near], j[near]
    same = _rising(j[np.argsort(i)])
    return 1 - same / (total - same)


def jaccard_distance(a: Prepared, b: Prepared) -> float:
    """1 less the Jaccard index of labelled shingles, exact at any distance."""
    if not a.n or not b.n:
        return 0.0 if a.n == b.n else 1.0
    at = np.searchsorted(b.sorted, a.sorted)
    at[at == b.n] = 0
    same = int((b.sorted[at] == a.sorted).sum())
    return 1 - same / (a.n + b.n - same)


def jaccard_distances(texts: list[str | None], u: list[int], v: list[int], k: int) -> np.ndarray:
    """`jaccard_distance` of the texts u[i] and v[i], for all i at once."""
    s, n = shingles(*word_hashes([(t or "").lower().encode() for t in texts]), k)
    names, rank = np.unique(labelled(s, n), return_inverse=True)
    has = np.sort(np.repeat(np.arange(len(n)), n) * len(names) + rank)
    a, b = np.array(u, np.int64), np.array(v, np.int64)
    sizes = n[a]
    pair = np.repeat(np.arange(len(a)), sizes)
    token = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (np.cumsum(n) - n)[a][pair]
    sought = b[pair] * len(names) + rank[token]
    at = np.minimum(np.searchsorted(has, sought), max(0, len(has) - 1))
    same = np.bincount(pair[has[at] == sought], minlength=len(a))
    return np.where((n[a] > 0) & (n[b] > 0), 1 - same / np.maximum(1, n[a] + n[b] - same), (n[a] != n[b]).astype(float))
