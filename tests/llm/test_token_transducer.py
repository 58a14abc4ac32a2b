"""op13: counts against the sentencepiece library, chunk maps, edge rows."""

import os
import random

import pytest
import sentencepiece

from kernelspark.llm import token_transducer as X
from kernelspark.llm.piece_tokenizer import BYTE, CONTROL, NORMAL, UNIGRAM, UNKNOWN, PieceModel, parse_model
from kernelspark.llm.queries import QUERIES

from .test_piece_tokenizer import MODEL, texts


@pytest.fixture(scope="module")
def data():
    if not os.path.exists(MODEL):
        pytest.skip("no model file")
    with open(MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def machine(data):
    return X.Transducer(parse_model(data))


def test_counts_of_odd_texts(data, machine):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    for x in texts():
        n = len(theirs.encode(x))
        assert machine.count(x) == n and machine.count(x, 7) == n, x


def test_emissions_are_never_negative_and_tables_stay_bounded(data):
    m = X.Transducer(parse_model(data), max_states=50)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    for x in texts()[::7]:
        assert m.count(x, 16) == len(theirs.encode(x))
        assert len(m.states) <= 50 + 200        # one text's chunks at most beyond the limit
        for s in m.states.values():
            assert all(hit[1] >= 0 for ch, hit in s.items() if ch is not X.LIVE)


def toy(seed):
    """A random BPE vocabulary whose scores do not follow the order of building."""
    r = random.Random(seed)
    pieces = {c: -100.0 - i for i, c in enumerate("abc" + X.MARK)}
    while len(pieces) < 24:
        p = r.choice(list(pieces)) + r.choice([q for q in pieces if q[0] != X.MARK or seed % 2])
        if len(p) < 7:
            pieces[p] = -float(r.randrange(1, 40))
    rows = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL)] + [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    return PieceModel(rows + [(p, s, NORMAL) for p, s in pieces.items()], model_type=X.BPE, byte_fallback=True,
                      add_dummy_prefix=bool(seed % 3), remove_extra_whitespaces=False)


@pytest.mark.parametrize("seed", range(12))
def test_random_vocabularies_against_plain_merging(seed):
    """Equal scores, unreachable pieces and markers inside pieces included."""
    model, r = toy(seed), random.Random(seed)
    m = X.Transducer(model)
    for _ in range(150):
        x = "".join(r.choices("aabbc é" + X.MARK, k=r.randrange(0, 60)))
        spelt = m.encode(m.prefix + x.replace(" ", X.MARK)) if x else []
        want = sum(1 if p in m.score else len(p.encode()) for p in spelt)
        assert [m.count(x), m.count(x, 5)] == [want, want], x


def test_a_long_text_without_any_cut(machine, data):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    for x in ("ab" * 40_000, "日本語" * 30_000, " " * 70_000, "aaaa" * 20_000 + " b"):
        assert machine.count(x, 1000) == len(theirs.encode(x))


def test_prefix_scan_gives_every_prefix(machine):
    text = (machine.prefix + "the end of the token stream and more of it").replace(" ", X.MARK)
    maps = [X.ChunkMap(machine, c, e) for c, e in machine.chunks(text, 5)]
    ends = [len(c) for c, _ in machine.chunks(text, 5)]
    assert len(maps) > 4
    for k, m in enumerate(X.prefix_scan(maps)):
        live, n = m.at(machine.START)
        assert n + live[-1][2] == len(machine.encode(text[:sum(ends[:k + 1])]))


def test_other_models_raise():
    for other in (PieceModel(model_type=UNIGRAM, byte_fallback=True), PieceModel(model_type=X.BPE),
                  PieceModel([("x", 0.0, 4)], model_type=X.BPE, byte_fallback=True, remove_extra_whitespaces=False)):
        with pytest.raises(ValueError):
            X.Transducer(other)


def test_edge_rows(spark, data):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    big = "word é\n" * 30_000
    rows = [(0, None, 1, "x"), (1, "", 2, "x"), (2, "  a  b ", 3, "x"), (3, "<s>", 4, None), (4, big, 5, "x"), (4, big, 5, "x"),
            (None, "x", 6, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, _text string").repartition(2)
    got = X.count_tokens(df, data)
    assert got.columns == ["doc_id", "_text", "n_tokens"]
    want = sorted((str(r[0]), len(theirs.encode(r[1] or ""))) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want
    rep = {r.doc_id: r for r in X.token_report(df, data, limit=2).collect()}
    assert rep[0].n_bytes == 0 and not rep[0].over_limit and rep[4].n_bytes == len(big.encode()) and rep[4].over_limit
    assert X.token_report(df.limit(0), data).count() == 0


def test_query(spark, data):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_token_counts"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(theirs.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
