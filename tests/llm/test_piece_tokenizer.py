"""op4: parity with the sentencepiece library, round trips, edge rows."""

import os
import random
import struct

import pytest
import sentencepiece

from kernelspark.llm import piece_tokenizer as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  ", " a", "▁x", "a▁▁b ▁", "<s>hi</s>", "<unk>", "<0x41>", "\n\n", "é𝔸ﬁ", "日本語 テスト", "  a  b\n\nc\t", "🙂🙂", "\u0000x"]


@pytest.fixture(scope="module")
def data():
    if not os.path.exists(MODEL):
        pytest.skip("no model file")
    with open(MODEL, "rb") as f:
        return f.read()


def texts():
    r = random.Random(3)
    odd = ["".join(r.choice("ab c\n ▁é🙂<>s/0x1e  ") for _ in range(r.randrange(1, 60))) for _ in range(1000)]
    return ODD + odd + ["".join(r.choices("the and ing er on he in th aaaa oooo", k=40)) for _ in range(500)]


def test_parity_on_odd_texts(data):
    ours, theirs = P.build_tokenizer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for x in texts():
        ids = theirs.encode(x)
        assert ours.encode(x, add_special_tokens=False).ids == ids, x
        assert ours.decode(ids, skip_special_tokens=False) == theirs.decode(ids), x


def test_documents_parity_and_round_trip(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    got = P.decode_documents(P.encode_documents(docs, data), data)
    assert got.columns == [*docs.columns, "n_tokens", "token_ids", "round_trip", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == theirs.encode(r.text) and r.n_tokens == len(r.token_ids)
        assert r.round_trip and r.decoded == r.text


def test_edge_rows(spark, data, monkeypatch):
    monkeypatch.setattr(P, "BATCH_CHARS", 100)      # many calls a batch
    big = "word é\n" * 30000
    rows = [(0, None, 1), (1, "", 2), (2, "  a  b ", 3), (3, "▁", 4), (4, big, 5), (4, big, 5), (None, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(1)
    got = sorted(P.encode_documents(df, data).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert [r.n_tokens for r in got[:3]] == [len(got[0].token_ids), 0, 0] and all(r.round_trip for r in got)
    assert got[1].token_ids == [] and got[-1].token_ids == got[-2].token_ids
    assert P.encode_documents(df.limit(0), data).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def hand_made(model_type, squeeze):
    """A small model file written out by hand, with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "▁abc", "▁b", "▁c", "cc"]
    pieces += [(w, -1.0 - i / 2 if model_type == P.BPE else -len(words) / 2 - 1 / (i + 1) - 3 / len(w), 1) for i, w in enumerate(words)]
    return message(*[(1, message((1, p), (2, s), *([(3, k)] if k != 1 else []))) for p, s, k in pieces],
                   (2, message((3, model_type), (35, 1), (40, 0), (41, 1), (42, 2))),
                   (3, message((1, "identity"), (3, 1), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("model_type", [P.UNIGRAM, P.BPE])
@pytest.mark.parametrize("squeeze", [False, True])
def test_hand_made_models(model_type, squeeze):
    data = hand_made(model_type, squeeze)
    ours, theirs = P.build_tokenizer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    m = P.parse_model(data)
    assert m.model_type == model_type and m.byte_fallback and m.remove_extra_whitespaces == squeeze
    r = random.Random(1)
    for x in ["", "abc", "ab c", "a  b", " é ", "z"] + ["".join(r.choice("abc  z") for _ in range(r.randrange(12))) for _ in range(300)]:
        ids = ours.encode(x, add_special_tokens=False).ids
        assert ids == theirs.encode(x), x
        assert ours.decode(ids, skip_special_tokens=False) == theirs.decode(ids), x


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        P.build_tokenizer(message((1, message((1, "<unk>"), (3, 2))), (2, message((3, 4)))))
