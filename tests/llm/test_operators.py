"""Each operator against brute force, a library, or SQL, on small tables with odd rows."""

import hashlib
import os
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, bwt_dedup, common, exact_dedup, fingerprints, mixing, near, order_minhash, paragraphs, passages, toxicity, warc_zip
from quern.llm.queries import ORACLE, QUERIES, tokenizer_path
from quern.llm.shingles import Prepared, distance, jaccard_distance, jaccard_distances, prepared

SF = "/root/testdata/sf0.001"
TABLES = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], KINDS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns of clashing names."""
    long = prose(1, 4000)
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (4, long, "b"), (4, long, "b"), (None, "x y", "a"), (5, long + " tail", "a"), (6, "word " * 300, "b"), (7, "İıŞ é 漢字 <|endoftext|>", "a"), (8, "x", None)]
    return documents(spark, rows)


def test_every_operator_takes_odd_rows_and_no_rows(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 0, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    for rows, n in ((odd, 10), (odd.limit(0), 0)):
        ps = pages if n else pages.limit(0)
        assert exact_dedup.with_groups(rows).count() == n
        assert mixing.mix(rows).count() == n
        assert bpe.token_counts(rows, path).count() == n
        assert bpe.encoded_digests(rows, path).count() == n
        assert bwt_dedup.without_repeats(rows).count() == n
        assert fingerprints.with_edits(rows).count() == n
        assert toxicity.scored(rows, labels if n else labels.limit(0)).count() == n
        assert paragraphs.without_repeats(rows).count() == n
        assert order_minhash.near_classes(rows).count() == n
        assert warc_zip.archived(ps).count() == n


@TABLES
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = QUERIES[name](spark, SF)
    order = ", ".join(sorted(got.columns))
    want = con.sql(ORACLE[name]).select(order).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want))


# --- archives -------------------------------------------------------------------------------


def test_zip64_directory_and_ranges(tmp_path, monkeypatch):
    path = tmp_path / "w.zip"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 64)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"x" * 200)
        z.writestr("b", b"y" * 300)
        z.comment = b"note"
    assert b"PK\x06\x06" in path.read_bytes()
    r = warc_zip.Ranges(f"file://{path}")
    members = {m[0]: m for m in warc_zip.directory(r)}
    at, n = warc_zip.stored_at(r, members["b"])
    assert r.read(at, n) == b"y" * 300
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 200)
    r = warc_zip.Ranges(f"file://{path}")
    with pytest.raises(ValueError, match="not stored"):
        warc_zip.stored_at(r, warc_zip.directory(r)[0])


def test_payloads_come_back(spark):
    html = "<p>" + "é" * 200
    pages = spark.createDataFrame([(3, "http://a b", html), (1, None, html), (2, "u", "short"), (4, "u", "short"), (5, "u", None)], "page_id long, url string, html string")
    packages = warc_zip.write_packages(pages, common.scratch_path(spark, "t"))
    got = {r.page_id: r for r in warc_zip.read_packages(packages, payloads=True).collect()}
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[3].payload is None and got[3].payload_bytes == len(html.encode())
    assert bytes(got[1].payload) == html.encode() and {got[k].record_type for k in (1, 2, 4, 5)} == {"response"}
    assert got[5].payload_bytes == 0 and got[5].payload_digest == hashlib.sha256(b"").hexdigest()


# --- repeated strings -------------------------------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_by_brute_force(spark):
    a, b = prose(2, 120), prose(3, 60)
    rows = [(9, a), (1, b + a[50:400]), (4, "é" * 150 + a[:99]), (5, a[:100]), (7, "ab" * 200), (8, a[:200] + "!" + a[201:] + b), (3, None), (6, a[20:160] + b[10:130] + a[300:420])]
    got = {r.doc_id: tuple(r)[1:] for r in bwt_dedup.without_repeats(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_repeats(rows)


def test_merged_transforms_give_sorted_suffixes():
    r = random.Random(5)
    contexts = [bytes(r.choice(b"ab") for _ in range(r.randrange(100, 170))) for _ in range(40)]
    contexts += [contexts[3][:140], contexts[7]]
    shards = bwt_dedup.shards_of(contexts)
    common_, context, at = bwt_dedup.merged(shards, 2)
    real = context >= 0
    texts = [contexts[c][p : p + 100] if p + 100 <= len(contexts[c]) else None for c, p in zip(context[real], at[real])]
    same = [x is not None and x == y for x, y in zip(texts[1:], texts)]
    full = common_[real][1:] == 2
    assert all(f for f, s in zip(full, same) if s)
    assert all(s for f, s, t in zip(full, same, texts[1:]) if f and t is not None)
    assert len(set(filter(None, texts))) == sum(1 for k, t in enumerate(texts) if t is not None and (k == 0 or not same[k - 1]))


# --- fingerprints -----------------------------------------------------------------------------


def test_fingerprints():
    texts = ["", "a", prose(1, 300), prose(1, 300), prose(2, 300), prose(1, 300)[:-5] + "other"]
    f = fingerprints.fingerprint(texts)
    assert f[2] == f[3] and len({len(x) for x in f}) == 1
    near = fingerprints.likeness([f[2]] * 3, [f[3], f[5], f[0]])
    assert near[0] == 1 and near[1] > 0.8 and 0 <= near[2] < 0.5
    assert fingerprints.fingerprint(["x" * 3_000_000, prose(1, 300)])[1] == f[2]


@TABLES
def test_edits_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.with_edits(df).collect()}
    for k, (i, t) in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fingerprints.fingerprint([t, edited, nxt])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b)
        assert got[i].near_next == pytest.approx(fingerprints.likeness([a], [c])[0])


# --- toxicity ---------------------------------------------------------------------------------


def test_folding_and_exceptions():
    assert toxicity.folded("1D10T!") == toxicity.folded("idiot") and toxicity.folded("ѕtupіd") == toxicity.folded("stupid") and toxicity.folded("don't") == ["dont"]
    w = toxicity.Lexicon(words=(("trash", 2.0),), stems=(("ciow", 3.0),), curve=(-2.0, 3.0, 0.0))
    weigh = w.matcher()
    assert weigh(toxicity.folded("you trash")) == 2.0 and weigh(toxicity.folded("the trash can is full")) == 0.0
    assert weigh(toxicity.folded("clowning trash trash")) == 5.0 and weigh([]) == 0.0
    assert w.score(5.0, 3) > 0.5 > w.score(0.0, 0)


def test_learned_scores_hold_out(spark):
    r = random.Random(1)
    rows = [(i, prose(i, 60) + (" vilest" + r.choice(["en", "er", "um"]) if i % 3 == 0 else ""), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.scored(documents(spark, rows), labels).collect()
    held = [x for x in got if x.held_out]
    assert len(held) > 40 and np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.97


# --- mixing -----------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 11 else None) for i in range(600)]
    got = mixing.mix(documents(spark, rows), block=16).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(t - n) <= 1 and t <= 3 * s for t, n, s in by.values())
    assert sum(t for t, _, _ in by.values()) == pytest.approx(sum(r.size for r in got))
    again = mixing.mix(documents(spark, rows).repartition(7), block=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_slots_are_well_spread(spark):
    sized = spark.createDataFrame([("a", 5000), ("b", 5000), ("c", 5000)], "source string, size long")
    slots = mixing.slot_schedule(mixing.source_targets(sized), 10).collect()
    first = [s for s in slots if s.slot < 150]
    assert sum(s.source_rank == 0 for s in first) / 150 == pytest.approx(5 / 8, abs=0.03)
    assert sorted(s.k for s in slots if s.source_rank == 1) == list(range(sum(s.source_rank == 1 for s in slots)))


# --- tokens -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return bpe.load(public_tokenizers.path("word_bpe_49k.json"))


ODD_TEXTS = ["", "Hello WORLD don't 123 é ß Σας <|endoftext|> x\x00y 漢字\n\t ok's<|startoftext|>", "İstanbul ŉ ǅ Ⅻ ﬁ é", "x" * 1000, "ab" * 700 + " ́", "a<b <|endoftext|", "  ", "　a　\x1cb\x1fc\x85d\xa0e", "😀🎉 ok", prose(4, 200)]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_coding_is_the_librarys(model, text):
    ids = model.tok.encode(text, add_special_tokens=False).ids
    assert model.encode(text) == ids
    got, decoded = bpe._coder(model)(text)
    assert np.frombuffer(got, "<u4").tolist() == ids and decoded == model.tok.decode(ids, skip_special_tokens=False)
    assert bpe._counter(model)(text) == len(ids)


def test_prefix_counts_are_exact(model):
    for text in ("Hello wonderful internationalization, don't you? été 123abc", "zzzqxj " * 3):
        p = bpe.PrefixCounts(model, text)
        for i in range(len(p.normal) + 1):
            assert p.count(i) == len(model.encode(p.normal[:i]))
        for budget in (0, 1, 5, 1000):
            cut = p.longest(budget)
            assert p.count(cut) <= budget and (cut == len(p.normal) or p.count(cut + 1) > budget)


def test_vocabulary_without_some_letters(model, monkeypatch):
    """A letter that the vocabulary lacks is left out of the ids, and doesn't count."""
    for t in ("q", "q" + model.end):
        monkeypatch.delitem(model.vocab, t)
    for kind in ("opening", "closing"):
        monkeypatch.delitem(model.__dict__, kind, raising=False)
    model.forget()
    for text in ("xqx q qq quiet", "q" * 200 + "x", "plain words"):
        n = len(model.encode(text))
        assert bpe._counter(model)(text) == n and len(bpe._coder(model)(text)[0]) == 4 * n
        assert bpe.PrefixCounts(model, text).count(len(text)) == n
    model.forget()
    for kind in ("opening", "closing"):
        model.__dict__.pop(kind, None)


def test_caches_are_bounded_and_forget():
    kept = bpe.Cached(lambda k: k, 10)
    for i in range(100):
        assert kept[str(i)] == str(i)
        assert len(kept) + len(kept.old) <= 10
    kept.forget()
    assert not kept and not kept.old


def test_plain_characters_need_no_library(model):
    plain = [chr(c) for c in range(0x250) if bpe.PLAIN.fullmatch(chr(c))]
    for c in plain:
        assert model.encode(f"a{c}B ") == model.tok.encode(f"a{c}B ", add_special_tokens=False).ids


# --- near duplicates --------------------------------------------------------------------------


def brute_classes(texts, k, least, ordered):
    ready = {i: Prepared(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if ready[i].n and ready[j].n and distance(ready[i], ready[j], ordered, 1 - least) <= 1 - least + 1e-12:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_family(n):
    r = random.Random(9)
    texts, base = {}, [prose(s, 90).split() for s in range(4)]
    for i in range(n):
        words = list(base[i % 4])
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"w{r.randrange(1000)}"
        texts[i] = " ".join(words)
    return texts | {n + 1: "one two three", n + 2: "one two  THREE", n + 3: ""}


def test_near_classes_by_brute_force(spark):
    texts = near_family(60)
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == brute_classes(texts, 5, 0.8, True)


@TABLES
def test_near_classes_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(df).collect()}
    assert got == brute_classes({r.doc_id: r.text for r in df.collect()}, 5, 0.8, True)


def jaccard(one, other, k=5):
    """Of word shingles that count as often as they occur; independent of the module's own hashing."""

    def bag(text):
        w = text.lower().split()
        return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()

    a, b = bag(one), bag(other)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_paragraphs(texts, least_words=20):
    """doc_id -> lines that go, by comparing all paragraphs with all others."""
    found = []
    for i, t in sorted(texts.items()):
        lines, start, mine = t.split("\n"), 0, []
        for at in range(len(lines)):
            if len(" ".join(lines[start : at + 1]).split()) >= least_words:
                mine.append((i, start, at + 1))
                start = at + 1
        if start < len(lines) and mine:
            mine[-1] = (*mine[-1][:2], len(lines))
        elif not mine and t.split():
            mine = [(i, 0, len(lines))]
        found += mine
    root = list(range(len(found)))
    said = ["\n".join(texts[i].split("\n")[a:b]) for i, a, b in found]
    for x in range(len(found)):
        for y in range(x):
            if root[x] != root[y] and jaccard(said[x], said[y]) >= 0.8:
                lo, hi = sorted((root[x], root[y]))
                root = [lo if r == hi else r for r in root]
    gone = {i: set() for i in texts}
    for x, (i, a, b) in enumerate(found):
        if (i, a, b) != min(found[y] for y in range(len(found)) if root[y] == root[x]):
            gone[i] |= set(range(a, b))
    return gone


def paragraph_documents():
    lines, r = list(near_family(24).values())[:24], random.Random(3)
    docs = {i: "\n".join([f"short line {i % 3}", lines[3 * i], "", lines[3 * i + 1], "one more", lines[3 * i + 2], f"end {i}"]) for i in range(8)}
    docs |= {20: "tiny text", 21: "Tiny  text", 22: "another\n\ntiny", 23: lines[0] + "\nshort line 0\n" + lines[0], 24: "\n".join(f"w{r.randrange(9)} x" for _ in range(30)), 25: "", 1 << 62: lines[5] + "\n" + lines[9]}
    return docs


def test_paragraphs_by_brute_force(spark):
    docs = paragraph_documents()
    got = {i: set() for i in docs}
    for r in paragraphs.removals(documents(spark, [(i, t, "s") for i, t in docs.items()])).collect():
        got[r.doc_id] |= set(range(r.a, r.b))
    want = brute_paragraphs(docs)
    assert got == want and sum(map(bool, want.values())) > 4


def near_windows(texts):
    """doc_id -> words in windows of 50 that may go: those linked, over others too, with a window that comes before, at 0.8 of their shingles."""
    windows = [(i, a, t.lower().split()[a : a + 50]) for i, t in sorted(texts.items()) for a in range(len(t.split()) - 49)]
    bags = [Counter(tuple(w[k : k + 5]) for k in range(46)) for _, _, w in windows]
    root = list(range(len(windows)))
    for x in range(len(windows)):
        for y in range(x):
            if root[x] != root[y] and 1.8 * sum((bags[x] & bags[y]).values()) >= 0.8 * 92:
                lo, hi = sorted((root[x], root[y]))
                root = [lo if r == hi else r for r in root]
    gone = {i: set() for i in texts}
    for x, (i, a, _) in enumerate(windows):
        if root[x] != x:
            gone[i] |= set(range(a, a + 50))
    return gone


def test_near_passages_inside_long_lines(spark):
    """Passages of later documents, some words changed: measured recall of those that are 0.8 alike, and no clean text cut."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, planted = [words(370) for _ in range(50)], {}
    for size, edits in ((60, 0), (60, 1), (70, 1), (90, 1), (110, 2), (200, 3)):
        for _ in range(30):
            a = r.randrange(370 - size)
            passage = r.choice(docs[:50])[a : a + size]
            for at in r.sample(range(size), edits):
                passage[at] = f"x{r.randrange(10**6)}"
            planted[len(docs)] = (size, edits)
            docs.append([*words(150), *passage, *words(150)])
    rows = documents(spark, [(i, " ".join(d), "s") for i, d in enumerate(docs)])
    got = {x.doc_id: (x.text.split(), x.removed_words) for x in paragraphs.without_repeats(rows).collect()}
    assert all(got[i][1] == 0 for i in range(50))
    found = Counter()
    for i, kind in planted.items():
        found[kind] += got[i][1] >= 50
        assert set(docs[i][:148]) <= set(got[i][0]) and set(docs[i][-148:]) <= set(got[i][0])
    assert found[60, 0] == 30 and all(n >= 27 for n in found.values()), found


def test_registered_columns_of_paragraphs(spark, tmp_path):
    docs = paragraph_documents()
    near = near_windows(docs)
    documents(spark, [(i, t, "s") for i, t in docs.items()] + [(30, None, "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_paragraph_minhash"](spark, str(tmp_path)).collect()}
    gone = brute_paragraphs(docs)
    assert got[30].n_removed == 0 and got[30].kept_sha256 == hashlib.sha256(b"").hexdigest()
    seen, exact = set(), 0
    for i, t in sorted(docs.items()):
        words, lines, lost = t.lower().split(), t.split("\n"), set()
        for a in range(len(words) - 49):
            w = tuple(words[a : a + 50])
            lost |= set(range(a, a + 50)) if w in seen else set()
            seen.add(w)
        at, touched, n_words, left = 0, 0, 0, []
        for x, line in enumerate(lines):
            n = len(line.split())
            hit = set(range(at, at + n)) & lost
            n_words += n if x in gone[i] else len(hit)
            touched += x in gone[i] or bool(hit)
            left += [] if x in gone[i] or (hit and len(hit) == n) else [line]
            at += n
        if near[i] - lost:
            # Windows near an earlier one may go as well, and nothing else.
            most = n_words + len(near[i] - lost)
            assert touched <= got[i].n_removed <= len(lines) and n_words <= got[i].removed_words <= most, i
            continue
        assert (got[i].n_removed, got[i].removed_words) == (touched, n_words), i
        if n_words == sum(len(x.split()) for x in lines) - sum(len(x.split()) for x in left):
            exact += touched > 0
            assert got[i].kept_sha256 == hashlib.sha256("\n".join(left).encode()).hexdigest(), i
            assert got[i].removed_bytes == len(t.encode()) - len("\n".join(left).encode())
    assert exact > 1


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 6), (None, 1)], "u long, v long")
    assert {(r.node, r.root) for r in common.components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (6, 2), (8, 8), (9, 8)}


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    rows = documents(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a", "s")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.with_groups(rows).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


def test_copies_count_once_in_the_toxicity_sample(spark):
    copy = "one text of many words that stands in the table thirty times"
    rows = [(i, copy) for i in range(30)] + [(100 + i, f"text {i} has words of its own number {i} here") for i in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 30 as int) as toxic")
    got = toxicity.labelled_sample(docs, labels, 100).collect()
    assert sum(r.text == copy for r in got) == 1
    assert len({(r.text, r.toxic) for r in got if r.text}) == sum(bool(r.text) for r in got)


@pytest.mark.parametrize("ordered", [False, True])
def test_links_far_from_a_short_leader(spark, ordered):
    """All share one key: of texts that are far from the least one, all that are alike must be linked."""
    words = [f"{w}{i}" for i in range(10) for w in WORDS]
    sizes = [59, 80, 100, 61, 74, 92, 118, 119, 150]
    texts = {i + 1: " ".join(words[: n + 4] if i < 6 else words[190 - n : 194]) for i, n in enumerate(sizes)}
    nodes = spark.createDataFrame([(i, 1, n) for i, n in zip(texts, sizes)], "node long, key long, n int")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    ready = {i: Prepared(t, 5) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in range(1, i):
            if distance(ready[i], ready[j], ordered, 1.0) <= 0.2 + 1e-12:
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    got = {r.node: r.root for r in near.similar(nodes, rows, 5, ordered, 0.8).collect()}
    assert {i: got.get(i, i) for i in texts} == root


def test_leader_contained_in_texts_that_are_alike(spark):
    words = [f"{w}{i}" for i in range(10) for w in WORDS]
    texts = {1: " ".join(words[:63]), 2: " ".join(words[:84]), 3: " ".join(words[:104])}
    nodes = spark.createDataFrame([(1, 1, 59), (2, 1, 80), (3, 1, 100)], "node long, key long, n int")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    for ordered in (False, True):
        assert {(r.node, r.root) for r in near.similar(nodes, rows, 5, ordered, 0.8).collect()} == {(2, 2), (3, 2)}


def test_passages_repeat_wherever_lines_end(spark):
    """By brute force over all windows of 50 words; passages start inside lines and run over short ones."""
    r = random.Random(5)
    passage = prose(7, 58).split()
    broken = lambda ws: "".join(w + r.choice([" ", " ", "\n", "  "]) for w in ws).strip()
    texts = {i: broken(prose(100 + i, r.randrange(1, 150)).split() + (passage[: r.choice([49, 50, 58])] if i % 2 else []) + prose(200 + i, 9).split()) for i in range(30)}
    texts[30] = texts[3].upper()
    seen, want = set(), {}
    for i, t in texts.items():
        ws = t.lower().split()
        lost = set()
        for a in range(len(ws) - 49):
            w = tuple(ws[a : a + 50])
            if w in seen:
                lost |= set(range(a, a + 50))
            seen.add(w)
        want[i] = lost
    got = {i: set() for i in texts}
    docs = documents(spark, [(i, t, "s") for i, t in texts.items()])
    for row in passages.repeated_spans(docs).collect():
        got[row.doc_id] |= set(range(row.a, row.b))
    assert got == want and any(want.values())
    gone = brute_paragraphs(texts)
    for row in paragraphs.without_repeats(docs).collect():
        lines = texts[row.doc_id].split("\n")
        ends = np.cumsum([len(x.split()) for x in lines]).tolist()
        lost = want[row.doc_id] | {w for x in gone[row.doc_id] for w in range(ends[x] - len(lines[x].split()), ends[x])}
        assert row.text.split() == [w for j, w in enumerate(texts[row.doc_id].split()) if j not in lost]
        assert row.removed_words == len(lost)


def test_entries_of_rare_toxic_labels(spark):
    """A word of 12 in 45 toxic and of 60 in 2,000 clean documents has log odds above 2."""
    ids = spark.range(4000).where(~toxicity._held(F.col("id"))).limit(2045).toPandas()["id"].tolist()
    rows = [(i, prose(i, 12) + (" grobian" if at < 12 or 45 <= at < 105 else ""), int(at < 45)) for at, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert any("grobian".startswith(w) for w, _ in lexicon.words + lexicon.stems)


def test_held_out_and_repeated_labels_do_not_move_the_curve(spark):
    rows = [(i, prose(i, 30) + (" vilest" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    held = toxicity._held(F.col("doc_id"))
    other = labels.where(~held).union(labels.where(held).select("doc_id", F.lit(1))).union(labels.where("toxic = 1"))
    assert toxicity.learn(docs, other).curve == pytest.approx(toxicity.learn(docs, labels).curve)


def test_ids_of_any_size(spark):
    """Ids at both ends of 64 bits, repeated and null ones: null counts as last."""
    line, lo, hi = prose(3, 30), -(1 << 63), (1 << 63) - 1
    docs = documents(spark, [(hi, line, "s"), (lo, line, "s"), (None, line, "s"), (5, "other " + line, "s"), (5, "other " + line, "s"), (1 << 42, prose(8, 40), "s")])
    got = {(r.doc_id, r.n_removed > 0) for r in bwt_dedup.without_repeats(docs).collect()}
    assert got == {(lo, False), (hi, True), (None, True), (5, True), (1 << 42, False)}
    gone = {(r.doc_id, r.kept_doc_id) for r in paragraphs.removals(docs).collect()}
    assert gone == {(hi, lo), (5, lo)}
    rows = sorted((r.doc_id if r.doc_id is not None else lo, r.n_chars) for r in fingerprints.with_edits(docs).collect())
    assert len(rows) == 6
    kept = {(r.doc_id, r.class_id, r.kept) for r in order_minhash.near_classes(docs).collect()}
    assert kept == {(lo, lo, True), (hi, lo, False), (5, lo, False), (None, None, True), (1 << 42, 1 << 42, True)}


def test_buckets_of_ids_are_even(spark):
    docs = documents(spark, [(i, "t", "s") for i in range(200)] + [(1 << 62, "t", "s")])
    keyed, _ = fingerprints._bucketed(docs, 8)
    assert max(r["count"] for r in keyed.groupBy("_b").count().collect()) <= 30


def test_private_names_of_columns(spark):
    names = ["_h", "_d", "_s", "_text", "_keep", "_n", "_id", "_src", "_size", "slots", "node", "root", "gone", "version", "_gone", "c0", "key", "nope"]
    docs = documents(spark, [(1, prose(1, 30), "a"), (2, prose(1, 30), "a"), (3, None, None)])
    docs = docs.select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    kept = ["doc_id", "text", "source", *names]
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    for got, n in ((exact_dedup.with_groups(docs), 3), (exact_dedup.exact_dedup(docs), 2), (mixing.mixed_documents(docs), None), (order_minhash.one_of_each(docs), 2), (paragraphs.without_repeats(docs), 3), (toxicity.without_toxic(docs, labels), 3)):
        rows = got.select(kept).collect()
        assert (n is None or len(rows) == n) and all(r[c] == c for r in rows for c in names)


def test_urls_that_would_break_an_index(spark):
    urls = ["http://a/{x}", "http://a/b\nc", "http://a/\r\n\x0b\x1c\x85\u2028 {\"offset\": 0}", "http://ü/漢 字", "", None]
    pages = spark.createDataFrame([(i, u, f"<p>{i}" * 50) for i, u in enumerate(urls)], "page_id long, url string, html string")
    packages = warc_zip.write_packages(pages, common.scratch_path(spark, "t"))
    got = {r.page_id: r for r in warc_zip.read_packages(packages, payloads=True).collect()}
    assert {i: bytes(r.payload) for i, r in got.items()} == {i: (f"<p>{i}" * 50).encode() for i in range(len(urls))}
    assert got[0].url == "http://a/{x}" and got[1].url == "http://a/b%0Ac"


def test_mix_comes_in_the_order_of_its_slots(spark):
    docs = documents(spark, [(i, f"w{i} " * (1 + i % 40), f"s{i % 5}") for i in range(300)])
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    want = sorted((slot, i) for i, r in rows.items() for slot in r.slots)
    assert sorted(got) == sorted(i for _, i in want)
    at = {s: {i for x, i in want if x == s} for s, _ in want}
    for slot in sorted(at):
        n = len([1 for x, _ in want if x == slot])
        assert set(got[:n]) == at[slot]
        got = got[n:]


def test_same_nodes_under_many_keys_are_compared_once(spark):
    """Near copies share most of their bands: nodes 1 to 3 under four keys, 4 and 5 under one, 6 and 7 alone."""
    rows = [(n, k) for n in (1, 2, 3) for k in (10, 20, 30, 40)] + [(4, 50), (5, 50), (6, 60), (7, 70)]
    got = near._buckets(spark.createDataFrame(rows, "node long, key long")).collect()
    assert sorted((r.key, r.node, r.leader) for r in got) == [(10, 1, 1), (10, 2, 1), (10, 3, 1), (50, 4, 4), (50, 5, 4)]


def test_spans_of_a_text_are_joined(spark):
    spans = [(1, 9, a, a + 50) for a in range(3, 700)] + [(1, 9, 900, 1100), (2, 9, 0, 50), (2, 9, 50, 100)]
    rows = passages.joined(spark.createDataFrame(spans, "doc_id long, version long, a int, b int")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.a, r.b))
    assert got == {1: {*range(3, 749), *range(900, 1100)}, 2: set(range(100))} and len(rows) < 20


def test_jaccard_distances_of_many_pairs():
    texts = ["", "a", "a b c d e", "a b c d e f", "A B C D E f", "a b c d e " * 4, None]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    ready = prepared(texts, 5)
    assert jaccard_distances(texts, *zip(*pairs), 5).tolist() == [jaccard_distance(ready[i], ready[j]) for i, j in pairs]
