"""SentencePiece models on the tokenizers library.

The model file is a protobuf message; its pieces, scores and settings are read
here field by field and rebuilt as normaliser, metaspace marker, BPE merges or
unigram scores, byte fallback and decoder. Batches of texts are encoded
multithreaded inside Arrow tasks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernelspark.session import ship_package

MARK = "▁"
# Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters handed to one call of the encoder, and its threads in each task.
BATCH_CHARS, THREADS = 1 << 21, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix_marker: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at:at + n]
        at += n


def parse_model(data: bytes) -> PieceModel:
    """The parts of a SentencePiece ModelProto that encoding needs."""
    m = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 24:
                    m.suffix_marker = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def _merges(m: PieceModel, ids: dict[str, int]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first."""
    found = []
    for piece, score, kind in m.pieces:
        if kind == NORMAL and len(piece) > 1:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-score, ids[piece], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(data: bytes):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the
    SentencePiece model does. Types other than BPE and unigram, and markers
    at word ends, raise ``ValueError``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse_model(data)
    if m.model_type not in (BPE, UNIGRAM) or m.suffix_marker or not m.escape_whitespaces:
        raise ValueError("only BPE and unigram models with markers before words are supported")
    kinds = {i: k for i, (_, _, k) in enumerate(m.pieces)}
    unk = next(i for i, k in kinds.items() if k == UNKNOWN)
    if m.model_type == BPE:
        usable = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER_DEFINED)}
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m, usable),
                           unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    inner = any(k in (NORMAL, USER_DEFINED) and any(a != MARK and b == MARK for a, b in zip(p, p[1:]))
                for p, _, k in m.pieces)
    if not inner:       # no piece crosses into the next marker: cut there, words are then cached
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    user = [AddedToken(p, normalized=False, special=False) for p, _, k in m.pieces if k == USER_DEFINED]
    if user:
        t.add_tokens(user)
    strip = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


_BUILT: dict[bytes, object] = {}


def _tokenizer(data: bytes):
    """Built once in each Python worker."""
    if data not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(THREADS)
        _BUILT[data] = build_tokenizer(data)
    return _BUILT[data]


def expected_text(text: str, m: PieceModel) -> str:
    """What decoding gives back for a text all of whose characters the model
    can spell: the marker reads as a space."""
    if m.remove_extra_whitespaces:
        while "  " in text:
            text = text.replace("  ", " ")
        text = text.strip(" ")
    return text.replace(MARK, " ")


def spelling(m: PieceModel) -> list[bytes]:
    """The bytes that each id stands for; markers are spaces, control pieces nothing."""
    def of(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()
    return [of(p, k) for p, _, k in m.pieces]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, token_ids and round_trip added (columns of
    these names are replaced).

    No begin or end token is added. Null texts count as empty, empty texts
    have no tokens. ``round_trip`` says that decoding the ids gives the text
    back, up to the model's own normalisation; it is null where the model
    has a character map or no byte fallback, since texts may then change.
    Repeated rows are encoded alike; an empty table gives an empty result.
    Very long texts are encoded whole, alone in their call.
    """
    ship_package(docs.sparkSession)
    new = ["n_tokens", "token_ids", "round_trip"]
    kept = docs.drop(*[c for c in docs.columns if c.lower() in new])
    names, at = [*kept.columns, *new], kept.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m = _tokenizer(model), parse_model(model)
        exact, spell = m.byte_fallback and not m.charsmap, spelling(m).__getitem__
        lead = int(m.add_dummy_prefix)

        def back(ids: list[int], text: str) -> bool:
            return b"".join(map(spell, ids)).decode("utf-8", "replace")[lead:] == expected_text(text, m)

        for b in batches:
            start = 0
            for texts in _chunks([x or "" for x in b.column(at).to_pylist()]):
                ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                same = [back(i, x) for i, x in zip(ids, texts)] if exact else [None] * len(ids)
                part = b.slice(start, len(texts))
                start += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(same, pa.bool_())], names)

    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return kept.mapInArrow(each, schema)


def decode_documents(encoded: DataFrame, model: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode to null."""
    ship_package(encoded.sparkSession)

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        t = _tokenizer(model)
        rows = [None if x is None else [int(i) for i in x] for x in column]
        texts = iter(t.decode_batch([r for r in rows if r is not None], skip_special_tokens=False))
        return pd.Series([None if r is None else next(texts) for r in rows], dtype=object)

    return encoded.withColumn(out, decode(F.col(ids)))
