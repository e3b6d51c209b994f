"""Encoding and decoding of merge-type sentence pieces against the library."""

import hashlib
import random

import pytest

from quern.llm import sentence_pieces as P
from quern.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LETTERS = " ▁ab\n\t<s>é漢字é😀0x0A'\"()\0　 ⁇eting_,.-²…”"


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "and", "tion", "Straße", "ünlü", "don't", "3.14", "</s>", "<0x0A>", "https://x.y/z?q=1"]
    out = ["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(n)]
    out += [" ".join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(r.randrange(30))) for _ in range(n)]
    return out + ["", " ", "  ", "▁", "▁▁a", " a", "a" * 3000, " " * 500, "\n" * 70, "漢字" * 800, "<unk> </s> <s>"]


@pytest.fixture(scope="module")
def changed(tmp_path_factory):
    """The model with some pieces unused, some user-defined, and once without bytes to fall back on."""
    from sentencepiece import sentencepiece_model_pb2

    folder, out = tmp_path_factory.mktemp("models"), {"as it is": PATH}
    for kind in ("unused", "user-defined", "no bytes", "trimmed"):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(PATH, "rb") as f:
            proto.ParseFromString(f.read())
        for i, p in enumerate(proto.pieces):
            if kind == "unused" and p.type == P.NORMAL and len(p.piece) > 2 and i % 7 == 0:
                p.type = P.UNUSED
            if kind == "user-defined" and p.piece in ("ing", "▁the", "tion"):
                p.type = P.USER_DEFINED
            if kind == "no bytes" and p.type == P.BYTE:
                p.type = P.NORMAL
        if kind == "no bytes":
            proto.trainer_spec.byte_fallback = False
        if kind == "trimmed":
            proto.normalizer_spec.remove_extra_whitespaces = True
        out[kind] = str(folder / kind.replace(" ", "-"))
        with open(out[kind], "wb") as f:
            f.write(proto.SerializeToString())
    return out


@pytest.mark.parametrize("kind", ["as it is", "unused", "user-defined", "no bytes", "trimmed"])
def test_ids_are_the_librarys(changed, kind):
    model = P.PieceBPE(changed[kind])
    coded, _ = P._coder(model)
    for t in texts(1, 1500):
        ids = model.library.encode(t)
        assert model.encode(t) == ids, t
        n, own, decoded = coded(t)
        assert (n, own, decoded) == (len(ids), ",".join(map(str, ids)), model.library.decode(ids)), t


def test_decoding_of_any_ids():
    model, r = P.load(PATH), random.Random(2)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(262), model.ids["▁"]]) for _ in range(r.randrange(9))]
        assert model.decode(ids) == model.library.decode(ids), ids


def test_rows_of_a_table(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts(3, 50))] + [(None, "no id", "x"), (5, None, "x"), (5, None, "x"), (1 << 62, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    model = P.load(PATH)

    def wanted(i, t):
        ids = model.library.encode(t or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.library.decode(ids).encode()).hexdigest()

    assert sorted(map(tuple, P.encoded_digests(df, PATH).collect()), key=repr) == sorted((wanted(i, t) for i, t, _ in rows), key=repr)
    whole = {(r.doc_id, tuple(r.ids), r.decoded) for r in P.encoded(df, PATH).collect()}
    assert whole == {(i, tuple(model.library.encode(t or "")), model.library.decode(model.library.encode(t or ""))) for i, t, _ in rows}
    assert P.mismatches(df, PATH).count() == 0
    assert P.encoded_digests(df.limit(0), PATH).count() == P.mismatches(df.limit(0), PATH).count() == 0


def test_what_is_kept_is_dropped_with_the_task():
    coded, known = P._coder(P.load(PATH))
    coded("some words that are met")
    assert len(known) > 3
    known.forget()
    assert not len(known) and not known.old


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="not a merge-type"):
        P.PieceBPE(str(tmp_path / "m"))


def test_few_letters_need_no_agenda(monkeypatch):
    model, r = P.PieceBPE(PATH), random.Random(9)
    words = ["".join(r.choice("▁aeinrst.thehe" if k % 2 else LETTERS) for _ in range(r.randrange(1, P.LONG + 1))) for k in range(3000)] + ["a" * n for n in range(1, P.LONG + 1)]
    model.simple = False
    agenda = [model.merged(list(w)) for w in words]
    model.simple = True
    monkeypatch.setattr(P.heapq, "heapify", lambda _: pytest.fail("an agenda was made"))
    assert [model.merged(list(w)) for w in words] == agenda
