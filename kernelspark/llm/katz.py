"""Katz backoff language model of any order, counted and evaluated in blocks.

Documents are cut into blocks of a bounded number of tokens. A block is its
vocabulary (64-bit word hashes) and its token sequence in local ids. It asks
for the training counts and the dense ids of its distinct words: the sorted
hashes go, packed, to the range they fall in; there the counts of all blocks
are summed and sent back in the order asked.

All histories of a token, short or long, end in the word before it. So the
distinct n-grams of a block (highest order) go, once and by the ids of their
words, to the range of that word, with the documents that hold them; there
counts, divisors and backoff weights of every order meet, and what goes back
is the sum of logarithms per document and range. The counts of counts are
taken over the same shuffled rows before. The followers of a word seen more
than ``HOT_TOKENS`` times are spread over ranges of their own, by the word
and the one that follows; what their histories miss there is exchanged order
by order, once per range and history.

    P(w | h) = d(c) c(hw) / c(h)         if c(hw) > 0     (d: Good-Turing, 1 above ``DISCOUNT_TO``)
             = alpha(h) P(w | h')         otherwise

``alpha(h)`` is the mass that the discounts leave over the mass that P(. | h')
gives to words not seen after h, so the probabilities of every history sum to
one over the vocabulary, the end token and one unknown word. A history whose
counts all lie above ``DISCOUNT_TO`` leaves no mass; its counts are then taken
over c(h) + 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelspark.session import ship_package

from .common import shared_table

ORDER = 2
DISCOUNT_TO = 5
#: A block is closed at this many tokens; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 20
#: Training tokens per range of words whose followers meet.
RANGE_TOKENS = 1 << 20
#: The followers of a word seen more often in training are spread over all ranges.
HOT_TOKENS = 2 << 20
#: The blocks of an input task are dealt over so many partitions.
DEALT = 4
#: Hash of the end token.
END = np.uint64(0x9E3779B97F4A7C15)
#: Ids in place of a word: before the start of a text, its start (both only in histories); words follow.
NONE, START, FIRST = 0, 1, 2


# ---- packing: sorted keys as deltas, all arrays compressed -------------------------------------------------------

_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an array, by byte planes, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = _ZSTD.decompress(b[8:], decompressed_size=n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _pack_small(a: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few byte planes as the largest needs."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return bytes([kind.itemsize]) + _pack(a.astype(kind))


def _unpack_small(b: bytes) -> np.ndarray:
    return _unpack(b[1:], f"u{b[0]}").astype(np.int64)


def _mix(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of its history and its last word."""
    with np.errstate(over="ignore"):
        x = (history ^ (word + np.uint64(0x9E3779B97F4A7C15) + (history << np.uint64(6)) + (history >> np.uint64(2))))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# ---- blocks ------------------------------------------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text, training to blocks of ``BLOCK_TOKENS`` tokens."""
    from pyspark import TaskContext
    task, number, total, kind = TaskContext.get().partitionId(), 0, 0, None
    ids: dict[bytes, int] = {}
    seq: list[np.ndarray] = []
    size: list[int] = []
    docs: list = []
    train: list[bool] = []

    def close() -> pa.RecordBatch:
        nonlocal number, total
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
        packed = [_pack(words), _pack_small(np.concatenate(seq)), _pack_small(np.array(size)), _pack(np.array(train, np.uint8))]
        out = pa.RecordBatch.from_arrays(
            [pa.array([task * DEALT + number % DEALT], pa.int32()), pa.array([f"{task}-{number}"]),
             *[pa.array([x], pa.binary()) for x in packed], pa.array([docs], pa.list_(kind))],
            ["home", "block", "words", "seq", "size", "train", "docs"])
        number, total = number + 1, 0
        for x in (ids, seq, size, docs, train):
            x.clear()
        return out

    for b in batches:
        kind = b.schema.field(0).type
        for d, t, k in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            words = (t or b"").lower().split()
            seq.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
            size.append(len(words))
            docs.append(d)
            train.append(k)
            total += len(words) + 1
            if total >= BLOCK_TOKENS:
                yield close()
    if docs:
        yield close()


@dataclass
class _Block:
    """Tokens of a block. ``line[m]`` is, per token, the word m places before
    it: ``FIRST`` plus its place in ``words``, ``START`` or ``NONE``."""
    words: np.ndarray       # sorted hashes, the end token's included
    end: int                # place of the end token's
    size: np.ndarray        # tokens per document, end included
    train: np.ndarray       # per token
    line: list[np.ndarray]


def _read(row, order: int) -> _Block:
    """From a row of the block table."""
    words, place = np.unique(np.append(_unpack(row["words"], np.uint64), END), return_inverse=True)
    seq, n = _unpack_small(row["seq"]), _unpack_small(row["size"])
    train = _unpack(row["train"], np.uint8).astype(bool)
    # each document: START, its words, END
    total = n + 2
    first = np.cumsum(total) - total
    line = np.empty(int(total.sum()), np.int32)
    inner = np.ones(len(line), bool)
    inner[first] = False
    inner[first + total - 1] = False
    line[first], line[first + total - 1] = START, FIRST + place[-1]
    line[inner] = FIRST + place[seq]
    before = np.arange(len(line)) - np.repeat(first, total)     # words before this one, START included
    use = before > 0                                            # START is never predicted
    back = [line[use]]
    for m in range(1, order):
        line = np.append(np.int32(NONE), line[:-1])
        back.append(np.where(before >= m, line, np.int32(NONE))[use])
    return _Block(words, int(place[-1]), n + 1, np.repeat(train, n + 1), back)


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Positions at which sorted keys pass from one key range to the next."""
    cuts = np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, cuts), len(keys))


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes of the values, in their order, and the first place of each."""
    order = np.argsort(x, kind="stable")    # fast on the sorted runs that blocks send
    new = _firsts(x[order])
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return at, order[new]


def _firsts(s: np.ndarray) -> np.ndarray:
    """Whether a sorted value is the first of its kind."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return new


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)


# ---- words: counts and ids ---------------------------------------------------------------------------------------

_ASKED = "home int, block string, p int, keys binary, counts binary"
#: Answers for blocks; a range's own row (block null) has the stats.
_WORDS = "home int, block string, p int, places binary, counts binary, stats array<bigint>"


def _ask(parts: int):
    """Per block and key range: the sorted word hashes and how often the
    block's training documents hold them."""
    def run(rows: Iterable) -> Iterator[tuple]:
        for _, row in rows:
            b = _read(row, 1)
            counts = np.bincount(b.line[0] - FIRST, weights=b.train, minlength=len(b.words)).astype(np.int64)
            cut = _ranges(b.words, parts)
            for p, (i, j) in enumerate(zip(cut, cut[1:])):
                if i < j:
                    yield row["home"], row["block"], p, _pack_sorted(b.words[i:j]), _pack_small(counts[i:j])
    return run


def _stats(total: np.ndarray) -> list[int]:
    """Total count, counts of counts 1..DISCOUNT_TO+1, number of distinct n-grams seen."""
    seen = total[total > 0]
    cc = np.bincount(np.minimum(seen, DISCOUNT_TO + 2), minlength=DISCOUNT_TO + 3)
    return [int(seen.sum()), *map(int, cc[1:DISCOUNT_TO + 2]), len(seen)]


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a range, their counts over the blocks, and the place of each key asked."""
    every, at = np.unique(np.concatenate([_unpack_sorted(r["keys"]) for r in rows]), return_inverse=True)
    mine = np.concatenate([_unpack_small(r["counts"]) for r in rows])
    return every, np.bincount(at, weights=mine, minlength=len(every)).astype(np.int64), at


def _merge(hot: int):
    """One key range: counts summed over the blocks and answered, with the
    place of the word in the range, in the order asked."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        every, total, at = _summed(rows)
        out, i = [], 0
        for r in rows:
            j = i + int.from_bytes(r["keys"][:8], "little")
            out.append((r["home"], r["block"], r["p"], _pack_sorted(at[i:j].astype(np.uint64)), _pack_small(total[at[i:j]]), None))
            i = j
        out.append((None, None, rows[0]["p"], None, None, [*_stats(total), len(every), int((total > hot).sum())]))
        return pa.Table.from_batches([_batch(_WORDS, out)])
    return run


# ---- the model's small part --------------------------------------------------------------------------------------

def discounts(cc: list[int], to: int = DISCOUNT_TO) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0..to+1 (1 beyond ``to``), from
    the counts of counts ``cc[1..to+1]``; a factor that they do not support
    (not in (0, 1]) is 1."""
    d = np.ones(to + 2)
    over = (to + 1) * cc[to + 1] / cc[1] if cc[1] else 1.0
    if over < 1:
        for r in range(1, to + 1):
            if cc[r] and cc[r + 1]:
                x = ((r + 1) * cc[r + 1] / (r * cc[r]) - over) / (1 - over)
                if 0 < x <= 1:
                    d[r] = x
    return d


@dataclass
class KatzModel:
    """The small part of a model: discount factors per order, N, V, the
    unknown word's probability and the unigram divisor. The counts are in
    tables."""
    order: int
    d: list[np.ndarray]
    n_tokens: int
    n_words: int
    unknown: float
    divisor: float

    def factor(self, m: int, c: np.ndarray) -> np.ndarray:
        return self.d[m][np.minimum(c, DISCOUNT_TO + 1)]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.factor(0, c) * c / self.divisor, self.unknown)

    def backoff(self, m: int, c: np.ndarray, rare: list[np.ndarray], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Divisor and alpha of histories: their counts, numbers of n-grams
        with counts 1..DISCOUNT_TO, the lower order's mass of the words seen."""
        freed = sum(((1 - self.d[m][k]) * k * rare[k - 1] for k in range(1, DISCOUNT_TO + 1)))
        rest = 1 - low                                  # the lower order's mass of the words not seen
        divisor = np.where(freed > 1e-9 * np.maximum(c, 1), c, c + 1)
        divisor = np.where(rest > 1e-12, divisor, np.maximum(c - freed, 1e-300))    # every word seen: nothing to back off to
        alpha = np.where(rest > 1e-12, (divisor - c + freed) / divisor / np.maximum(rest, 1e-12), 0.0)
        return np.where(c > 0, divisor, 1.0), np.where(c > 0, alpha, 1.0)           # history never seen


def model_from_stats(order: int, stats: dict[int, list[int]]) -> KatzModel:
    """``stats[m]``: total count, counts of counts 1..DISCOUNT_TO+1, number
    of distinct n-grams."""
    none = [0] * (DISCOUNT_TO + 3)
    cc = [stats.get(m, none) for m in range(order)]
    d = [discounts(c) for c in cc]
    n, v = cc[0][0], cc[0][-1]
    freed = float(sum((1 - d[0][r]) * r * cc[0][r] for r in range(1, DISCOUNT_TO + 1)))
    divisor = n if freed > 1e-9 else n + 1      # without discounted counts the unknown word gets one count
    return KatzModel(order, d, n, v, (divisor - n + freed) / divisor, float(divisor))


# ---- n-grams by the last word of their history -------------------------------------------------------------------

# What a block sends to a range: the last words of the histories; n-grams (that word's place, the predicted word's id);
# the words further back; training counts; tokens and their documents; training counts of the distinct predicted words.
# A row with docs is a block's own (sizes, known, base, unigram score), on its way to the sums.

_SUMS = "block string, g int, docs array<{}>, size binary, known binary, base binary, score binary"


@dataclass
class _Layout:
    """Ids and ranges: range p has the words before from id p * words / parts
    on; ranges from ``parts`` on have the hot ones, by hash."""
    order: int
    starts: dict[int, int]      # id of the first word of each range of hashes
    words: int                  # ids in use
    parts: int
    hot: int

    def range_of(self, last: np.ndarray, word: np.ndarray, is_hot: np.ndarray) -> np.ndarray:
        g = last * self.parts // self.words
        if is_hot.any():
            mixed = _mix(last[is_hot].astype(np.uint64), word[is_hot].astype(np.uint64))
            g[is_hot] = self.parts + (mixed % np.uint64(self.parts)).astype(np.int64)
        return g


def _send(model: KatzModel, lay: _Layout):
    """Blocks, behind the answers about their words: distinct n-grams to the ranges."""
    def run(rows: Iterable) -> Iterator[tuple]:
        answers = defaultdict(list)
        for _, row in rows:
            if "words" in row:
                yield from _sent(model, lay, row, sorted(answers.pop(row["block"]), key=lambda a: a["p"]))
            else:
                answers[row["block"]].append(row)
    return run


def _sent(model: KatzModel, lay: _Layout, row: dict, answers: list) -> Iterator[tuple[int, dict]]:
    b = _read(row, lay.order)
    count = np.concatenate([_unpack_small(a["counts"]) for a in answers])
    ids = np.concatenate([[NONE, START], *[lay.starts[a["p"]] + _unpack_sorted(a["places"]).astype(np.int64) for a in answers]])
    word = b.line[0]
    c = count[word - FIRST]
    first = np.cumsum(b.size) - b.size
    base = np.log10((c + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
    logs = np.log10(np.maximum(model.unigram(c), 1e-300)) if lay.order == 1 else np.zeros(len(c))
    yield int(ids[-1]) % lay.parts, {
        "block": row["block"], "docs": row["docs"], "size": _pack_small(b.size),
        "known": _pack_small(np.add.reduceat((c > 0).astype(np.int64), first)), "base": _pack(np.add.reduceat(base, first)),
        "score": _pack(np.add.reduceat(logs, first))}
    if lay.order == 1:
        return
    x = b.line[1] * np.int64(len(ids)) + word
    for back in b.line[2:]:
        if int(x.max()) >= (1 << 63) // len(ids) - 1:
            x = _codes(x)[0].astype(np.int64)
        x = x * len(ids) + back
    order = np.argsort(x)
    new = np.flatnonzero(_firsts(x[order]))
    one, held = order[new], np.diff(new, append=len(x))
    seen = np.add.reduceat(b.train[order].astype(np.int64), new)
    doc = np.repeat(np.arange(len(b.size), dtype=np.int32), b.size)[order]
    del x, order
    often = np.concatenate([[False, count[b.end] > lay.hot], count > lay.hot])      # each text has a start and an end
    back = [ids[w[one]] for w in b.line]
    g = lay.range_of(back[1], back[0], often[b.line[1][one]])
    if (g[1:] < g[:-1]).any():
        order = np.argsort(g, kind="stable")
        doc = _runs(doc, new, held, order)
        back, seen, held, g, one = [w[order] for w in back], seen[order], held[order], g[order], one[order]
    code = c[one]
    cut = np.append(np.flatnonzero(_firsts(g)), len(g))
    tokens = np.append(0, np.cumsum(held))
    for i, j in zip(cut, cut[1:]):
        place, new = _codes(back[1][i:j])
        which = np.unique(back[0][i:j], return_index=True)[1]
        yield int(g[i]), {
            "block": row["block"], "last": _pack_sorted(back[1][i:j][new].astype(np.uint64)),
            "grams": _pack_sorted((place * np.int64(lay.words) + back[0][i:j]).astype(np.uint64)),
            "more": _pack_small(np.concatenate([w[i:j] for w in back[2:]])) if lay.order > 2 else None,
            "seen": _pack_small(seen[i:j]), "held": _pack_small(held[i:j]), "at": _pack_small(doc[tokens[i]:tokens[j]]),
            "counts": _pack_small(code[i:j][which])}


def _runs(a: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``a`` (first place and size of each) in another order."""
    f, n = first[order], size[order]
    return a[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


@dataclass
class _Level:
    """An order's n-grams in a range: entries that have one, codes of n-gram
    and history per entry, an entry of each, training count per n-gram."""
    place: np.ndarray
    gram: np.ndarray
    history: np.ndarray
    one: np.ndarray
    one_history: np.ndarray
    count: np.ndarray


class _Range:
    """The n-grams that all blocks sent to a range."""

    def __init__(self, rows: list[dict], lay: _Layout):
        self.lay = lay
        self.rows = sorted(rows, key=lambda r: r["block"])
        last, word, more = [], [], []
        for r in self.rows:
            x = _unpack_sorted(r["grams"]).astype(np.int64)
            last.append(_unpack_sorted(r["last"]).astype(np.int64)[x // lay.words])
            word.append(x % lay.words)
            if lay.order > 2:
                more.append(_unpack_small(r["more"]).reshape(lay.order - 2, -1))
        self.lens = np.cumsum([0, *map(len, word)])
        self.word = np.concatenate(word)
        self.back = [np.concatenate(last), *(np.concatenate(more, axis=1) if more else [])]
        seen = np.concatenate([_unpack_small(r["seen"]) for r in self.rows])
        place = np.arange(len(self.word))
        history, one_history = _codes(self.back[0])
        gram, one = _codes(history * np.int64(lay.words) + self.word)
        self.levels: list[_Level | None] = [None]
        for m in range(1, lay.order):
            if m > 1:
                back = self.back[m - 1][place]
                ok = back != NONE
                place, back = place[ok], back[ok]
                gram, one = _codes(gram[ok] * np.int64(lay.words) + back)
                history, one_history = _codes(history[ok] * np.int64(lay.words) + back)
            count = np.bincount(gram, weights=seen[place], minlength=len(one)).astype(np.int64)
            self.levels.append(_Level(place, gram, history, one, one_history, count))

    def history_keys(self, m: int) -> np.ndarray:
        """64-bit keys of the distinct histories of an order."""
        at = self.levels[m].place[self.levels[m].one_history]
        key = np.zeros(len(at), np.uint64)
        for back in self.back[:m]:
            key = _mix(key, back[at].astype(np.uint64))
        return key

    def unigram(self, model: KatzModel) -> np.ndarray:
        counts = [_unpack_small(r["counts"])[np.unique(self.word[i:j], return_inverse=True)[1]]
                  for r, i, j in zip(self.rows, self.lens, self.lens[1:])]
        return model.unigram(np.concatenate(counts))

    def sums(self, m: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per history: count, numbers of n-grams with counts 1..DISCOUNT_TO,
        the lower order's mass of the words seen after it."""
        v = self.levels[m]
        n, held = len(v.one_history), v.count > 0
        one, c = v.one[held], v.count[held]
        at = v.history[one]
        rare = np.stack([np.bincount(at[c == r], minlength=n) for r in range(1, DISCOUNT_TO + 1)])
        return (np.bincount(at, weights=c, minlength=n).astype(np.int64), rare,
                np.bincount(at, weights=lower[v.place[one]], minlength=n))

    def probability(self, model: KatzModel, upto: int, given: dict[int, tuple] | None = None) -> np.ndarray:
        """P(word | its last ``upto`` words) of every entry, order by order:
        seen n-grams by their discounted share, the others by backing off.
        ``given``: divisors and alphas of histories that other ranges share."""
        p = self.unigram(model)
        for m in range(1, upto + 1):
            v = self.levels[m]
            if not len(v.place):
                continue
            divisor, alpha = model.backoff(m, *self.sums(m, p)) if given is None else given[m]
            c = v.count[v.gram]
            p[v.place] = np.where(c > 0, model.factor(m, c) * c / divisor[v.history], alpha[v.history] * p[v.place])
        return p


def _split(rows: Iterable) -> tuple[int, list[dict], list[dict], list[dict]]:
    """A partition of ``_beside``: its range, n-grams, answers, blocks' own rows."""
    g, grams, answers, own = 0, [], [], []
    for g, r in rows:
        (own if "docs" in r else grams if "grams" in r else answers).append(r)
    return g, grams, answers, own


def _range_stats(lay: _Layout):
    def run(rows: Iterable) -> Iterator[tuple]:
        _, grams, _, _ = _split(rows)
        if grams:
            t = _Range(grams, lay)
            yield from ((m, _stats(t.levels[m].count)) for m in range(1, lay.order))
    return run


_SHARED = "g int, m int, q int, keys binary, c binary, rare binary, low binary"
_GIVEN = "g int, m int, q int, divisor binary, alpha binary"


def _given(t: _Range, answers: list) -> dict[int, tuple]:
    """Answers about histories, in the order of their codes."""
    out = {}
    for m in {a["m"] for a in answers}:
        mine = sorted((a for a in answers if a["m"] == m), key=lambda a: a["q"])
        back = np.argsort(np.argsort(t.history_keys(m), kind="stable"), kind="stable")
        out[m] = tuple(np.concatenate([_unpack(a[k], np.float64) for a in mine])[back] for k in ("divisor", "alpha"))
    return out


def _shared_histories(model: KatzModel, lay: _Layout, m: int):
    """What a range of hot words adds to its histories of an order."""
    def run(rows: Iterable) -> Iterator[tuple]:
        g, grams, answers, _ = _split(x for x in rows if x[0] >= lay.parts)
        if not grams:
            return
        t = _Range(grams, lay)
        if not len(t.levels[m].place):
            return
        c, rare, low = t.sums(m, t.probability(model, m - 1, _given(t, answers)))
        keys = t.history_keys(m)
        order = np.argsort(keys, kind="stable")
        keys, c, rare, low = keys[order], c[order], rare[:, order], low[order]
        cut = _ranges(keys, lay.parts)
        for q, (i, j) in enumerate(zip(cut, cut[1:])):
            if i < j:
                yield (g, m, q, _pack_sorted(keys[i:j]), _pack_small(c[i:j]), _pack_small(rare[:, i:j].ravel()),
                       _pack(low[i:j]))
    return run


def _backoff(model: KatzModel):
    """One key range of histories: divisor and alpha of each, answered in the order asked."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["g"])
        asked = [_unpack_sorted(r["keys"]) for r in rows]
        lens = np.cumsum([0, *map(len, asked)])
        every, at = np.unique(np.concatenate(asked), return_inverse=True)

        def total(parts: list[np.ndarray]) -> np.ndarray:
            return np.bincount(at, weights=np.concatenate(parts), minlength=len(every))
        rare = [_unpack_small(r["rare"]).reshape(DISCOUNT_TO, -1) for r in rows]
        divisor, alpha = model.backoff(rows[0]["m"], total([_unpack_small(r["c"]) for r in rows]),
                                       [total([x[k] for x in rare]) for k in range(DISCOUNT_TO)],
                                       total([_unpack(r["low"], np.float64) for r in rows]))
        return pa.Table.from_batches([_batch(_GIVEN, [
            (r["g"], r["m"], r["q"], _pack(divisor[at[i:j]]), _pack(alpha[at[i:j]]))
            for r, i, j in zip(rows, lens, lens[1:])])])
    return run


def _evaluate(model: KatzModel, lay: _Layout):
    """The n-grams of a range to sums of logarithms per block and document."""
    def run(rows: Iterable) -> Iterator[tuple]:
        g, grams, answers, own = _split(rows)
        for r in own:
            yield r["block"], -1, r["docs"], r["size"], r["known"], r["base"], r["score"]
        if not grams:
            return
        t = _Range(grams, lay)
        logs = np.log10(np.maximum(t.probability(model, lay.order - 1, _given(t, answers) if g >= lay.parts else None), 1e-300))
        for r, i, j in zip(t.rows, t.lens, t.lens[1:]):
            doc = _unpack_small(r["at"])
            total = np.bincount(doc, weights=np.repeat(logs[i:j], _unpack_small(r["held"])))
            some = np.flatnonzero(np.bincount(doc))
            yield r["block"], g, None, _pack_sorted(some.astype(np.uint64)), None, None, _pack(total[some])
    return run


def _scores(names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.drop_columns(["docs"]).to_pylist(), key=lambda r: r["g"])
        docs = t.filter(pa.compute.equal(t.column("g"), -1)).column("docs").combine_chunks().values
        score = _unpack(rows[0]["score"], np.float64).copy()
        for r in rows[1:]:
            score[_unpack_sorted(r["size"])] += _unpack(r["score"], np.float64)
        return pa.Table.from_arrays([
            docs, pa.array(_unpack_small(rows[0]["size"])), pa.array(_unpack_small(rows[0]["known"])),
            pa.array(np.round(_unpack(rows[0]["base"], np.float64), 6)), pa.array(np.round(score, 6))], names)
    return run


# ---- the jobs ----------------------------------------------------------------------------------------------------

def _same(partition: int) -> int:
    return partition


def _dealt(df: DataFrame, to: str, parts: int) -> RDD:
    """Rows by partition number. The shuffled rows serve every job on the RDD."""
    return df.rdd.map(lambda r: (r[to], r.asDict())).partitionBy(parts, _same)


def _beside(answers: RDD | None, rows: RDD) -> RDD:
    """Each partition's answers and, behind them, its rows; nothing is shuffled."""
    return rows if answers is None else answers.union(rows)


@dataclass
class KatzTables:
    model: KatzModel
    layout: _Layout
    asked: DataFrame            # sorted word hashes and training counts per block and range
    grams: RDD                  # n-grams of the blocks, partitioned by the last word of their history
    given: RDD | None           # divisors and alphas of histories that ranges of hot words share, partitioned like grams
    doc_type: str

    def ngrams(self) -> DataFrame:
        """The counts as rows: m (order - 1), key (the hash of a word, a hash
        of the words' ids for longer ones), count."""
        lay, fields = self.layout, "m int, key bigint, count bigint"

        def table(m: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
            seen = counts > 0
            return pa.Table.from_arrays([pa.array(np.full(int(seen.sum()), m, np.int32)), pa.array(keys[seen].view(np.int64)),
                                         pa.array(counts[seen])], ["m", "key", "count"])

        def words(t: pa.Table) -> pa.Table:
            return table(0, *_summed(t.to_pylist())[:2])

        def longer(rows: Iterable) -> Iterator[tuple]:
            _, grams, _, _ = _split(rows)
            t = _Range(grams, lay) if grams else None
            for m in range(1, lay.order if grams else 1):
                v = t.levels[m]
                keys = _mix(t.history_keys(m)[v.history[v.one]], t.word[v.place[v.one]].astype(np.uint64))
                yield from zip([m] * len(keys), keys.view(np.int64).tolist(), v.count.tolist())
        spark = self.asked.sparkSession
        out = self.asked.groupBy("p").applyInArrow(words, fields)
        return out.unionByName(spark.createDataFrame(self.grams.mapPartitions(longer), fields, verifySchema=False)
                               .filter("count > 0"))


def train_katz(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> KatzTables:
    """Count and normalise a model on the rows where ``training`` holds."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    typ = docs.schema[doc_id].dataType.simpleString()

    def frame(rows: RDD, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema, verifySchema=False)
    given_docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.coalesce(training, F.lit(True)).alias("k"))
    cut = given_docs.mapInArrow(
        _blocks, f"home int, block string, words binary, seq binary, size binary, train binary, docs array<{typ}>")
    most = max(1, min(given_docs.rdd.getNumPartitions(), docs.count()))
    blocks = _dealt(cut, "home", most * DEALT)
    asked = frame(blocks.mapPartitions(_ask(2 * most)), _ASKED)
    words = shared_table(asked.groupBy("p").applyInArrow(_merge(HOT_TOKENS), _WORDS), "katz-words")
    ranges = sorted((r["p"], list(r["stats"])) for r in words.filter("block IS NULL").select("p", "stats").collect())
    starts, ids = {}, FIRST
    for p, s in ranges:
        starts[p], ids = ids, ids + s[-2]
    stats = {0: [sum(x) for x in zip(*[s[:-2] for _, s in ranges])]} if ranges else {}
    hot = sum(s[-1] for _, s in ranges) > 0
    model = model_from_stats(order, stats)
    lay = _Layout(order, starts, ids, max(1, -(-model.n_tokens // RANGE_TOKENS)), HOT_TOKENS)
    answers = _dealt(words.filter("block IS NOT NULL"), "home", most * DEALT)
    parts = lay.parts * (2 if hot else 1)
    grams = _beside(answers, blocks).mapPartitions(_send(model, lay)).partitionBy(parts, _same)
    for m, s in grams.mapPartitions(_range_stats(lay)).collect() if order > 1 else ():
        stats[m] = [a + b for a, b in zip(stats.get(m, [0] * len(s)), s)]
    model = model_from_stats(order, stats)
    given, tables = None, None
    for m in range(1, order if hot else 1):
        shared = frame(_beside(given, grams).mapPartitions(_shared_histories(model, lay, m)), _SHARED)
        more = shared_table(shared.groupBy("q").applyInArrow(_backoff(model), _GIVEN), "katz-histories")
        tables = more if tables is None else tables.unionByName(more)
        given = _dealt(tables, "g", parts)
    return KatzTables(model, lay, asked, grams, given, typ)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1


def katz_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10).

    Tokens are the lower-cased words and one end. Learned from the rows whose
    ``crc32(doc_id) % 5`` is not 1 (a null id is learned from). Null texts
    count as empty: one token, the end. Repeated rows are counted and scored
    each. Without training rows every token has the unknown word's
    probability 1. Empty table: empty result. A document of more than
    ``BLOCK_TOKENS`` tokens is a block of its own, held whole by a task.
    Columns other than id and text are left aside.
    """
    t = train_katz(docs, ~held_out(doc_id), text, doc_id, order)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    sums = docs.sparkSession.createDataFrame(
        _beside(t.given, t.grams).mapPartitions(_evaluate(t.model, t.layout)), _SUMS.format(t.doc_type), verifySchema=False)
    scored = sums.groupBy("block").applyInArrow(
        _scores(names), f"doc_id {t.doc_type}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         F.lit(t.model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
