"""Substring dedup by collinear chaining.

Seeds are all k-word grams of a text: with ``K`` = 4, ``MIN_WORDS`` words of
which ``MIN_IDENTITY`` agree place by place hold at least ``MIN_CHAIN`` words in
seeds wherever the others lie. All seeds with the same hash are joined to the
first of them (least document, least position), a star and never all pairs. As
the seeds of one passage may have their firsts in many documents, two seeds
with different firsts and no more than ``REACH`` words between them are one more
key, whose holders are joined to the first that has both: what a document has
in common with any other one over such a pair is found, whoever had its grams.
Between a document and such a first document the matches are merged along
diagonals, chained in order with gap costs through a Fenwick tree of prefix
maxima, and the chains are aligned word by word in their gaps and at their
ends, for which only those words are fetched from the texts. The length of a
passage is judged last, over the pieces of all first documents.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.session import ship_package

from .common import drop_shared, shared_table
from .katz import _mix, _pack, _unpack

K = 4
#: A passage: fewest words, least share of matching words.
MIN_WORDS, MIN_IDENTITY = 50, 0.8
#: A chain: fewest words in seeds, cost of a skipped word on either side, widest gap, words tried beyond each end.
MIN_CHAIN, GAP_COST, MAX_GAP, FLANK = 2 * K, 0.2, 40, 14
#: Words between two seeds that are joined as a pair: with them, the seeds still make up ``MIN_IDENTITY`` of the stretch.
REACH = 2
#: Seeds that are packed together.
BLOCK_SEEDS = 1 << 18
#: Counters that tell seeds which stand alone, bytes of packed seeds kept in memory meanwhile.
SLOTS, SPOOL_BYTES = 1 << 24, 32 << 20
#: Seeds of which the firsts are taken at a time.
FIRST_ROWS = 1 << 19
#: Rows of an Arrow batch that are Python objects at a time, words whose hashes are kept meanwhile.
SLICE_ROWS, CACHE_WORDS = 500, 50_000
#: Pieces of one document closer than this are one passage, even if different documents hold them; a side of
#: fewer than ``JOIN_FULL`` words joins over a proportionally smaller gap.
JOIN_GAP, JOIN_FULL = 14, 20


def _slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows; after each batch, and at the end,
    Arrow's unused memory goes back, which a worker would keep between tasks."""
    for b in batches:
        yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))
        del b
        pa.default_memory_pool().release_unused()


def word_list(text: bytes) -> list[bytes]:
    return text.lower().split()


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, words) of the grams of a sequence of word hashes, at
    every position; a gram that recurs inside itself is one range of words."""
    n = len(words) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for i in range(K):
            g = (g ^ words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    g &= np.uint64(0xFFFFFFFFFFFFFF00)      # 56 bits travel; a gram that collides meets a document at random, where no chain grows
    at = np.argsort(g, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (g[at[1:]] != g[at[:-1]]) | (np.diff(at) >= K)
    lo = np.flatnonzero(new)
    return g[at[lo]].view(np.int64), at[lo], at[np.append(lo[1:], n) - 1] + K - at[lo]


def _range_start(part: int, parts: int) -> np.uint64:
    """A hash not above any of a range's: what is packed are distances to it,
    whose first bytes are few different ones."""
    return np.uint64(((int(part) << 32) // parts) << 32)


def _seed_blocks(parts: int):
    """Texts to seeds, packed per block of documents and hash range: 64-bit
    hashes in the order of the places, which then pack as small steps."""
    def pack(ids: pa.Array, which: list, hashes: list, places: list, sizes: list) -> pa.RecordBatch:
        w, h, p, n = (np.concatenate(c) for c in (which, hashes, places, sizes))
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        base = np.cumsum([0, *(int(c.max()) + 1 for c in places[:-1])])
        order = np.argsort(part << 40 | np.repeat(base, [len(c) for c in places]) + p)        # by part, document, place
        w, h, p, n, part = (c[order] for c in (w, h, p, n, part))
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rows = []
        for i, j in zip(at, np.append(at[1:], len(part))):
            docs, local = np.unique(w[i:j], return_inverse=True)
            rows.append((int(part[i]), ids.take(pa.array(docs)), _pack(h[i:j] - _range_start(part[i], parts)), _pack(np.diff(local, prepend=0).astype(np.int32)),
                         _pack(np.diff(p[i:j], prepend=0).astype(np.int32)), _pack(n[i:j].astype(np.int32))))
        cols = list(zip(*rows))
        ends = np.cumsum([0, *map(len, cols[1])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(cols[1])),
             *[pa.array(c, pa.binary()) for c in cols[2:]]], ["p", "docs", "h", "doc", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cache: dict[bytes, int] = {}
            total, block = 0, [[], [], [], []]
            for i, t in enumerate(b.column(1)):
                ws = word_list(t.as_buffer().to_pybytes() if t.is_valid else b"")
                if len(ws) < K:
                    continue
                for w in set(ws).difference(cache):
                    cache[w] = xxhash.xxh64_intdigest(w)
                h, p, n = seeds(np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws)))
                for c, v in zip(block, (np.full(len(h), i, np.int32), h.view(np.uint64), p.astype(np.int32), n.astype(np.int32))):
                    c.append(v)
                total += len(h)
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                if total >= BLOCK_SEEDS:
                    yield pack(b.column(0), *block)
                    total, block = 0, [[], [], [], []]
            if total:
                yield pack(b.column(0), *block)
            del b
            pa.default_memory_pool().release_unused()
    return run


def _seed_rows(parts: int):
    """Packed seeds to tables of hash, document and place (position and words).
    Most seeds stand alone; a first pass counts them by slots of their hash,
    and those alone in their slot, which have nothing to join, are left out."""
    def hashes(b: pa.RecordBatch, i: int) -> np.ndarray:
        return _unpack(b.column(2)[i].as_py(), np.uint64) + _range_start(b.column(0)[i].as_py(), parts)

    def slots(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(8) & np.uint64(SLOTS - 1)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, writer = np.zeros(SLOTS, np.uint8), None          # 2: twice or more
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as kept:
            for b in _slices(batches):
                writer = writer or pa.ipc.new_stream(kept, b.schema)
                writer.write_batch(b)
                for i in range(b.num_rows):
                    at = np.sort(slots(hashes(b, i)))
                    seen[at] = np.minimum(seen[at] + 1, 2)
                    seen[at[1:][at[1:] == at[:-1]]] = 2
            if writer is None:
                return
            writer.close()
            kept.seek(0)
            for b in pa.ipc.open_stream(kept):
                for i in range(b.num_rows):
                    h, (doc, pos, n) = hashes(b, i), (_unpack(b.column(k)[i].as_py(), np.int32) for k in (3, 4, 5))
                    more = np.flatnonzero(seen[slots(h)] > 1)
                    place = (np.cumsum(pos, dtype=np.int64) << 32 | n)[more]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[more].view(np.int64)), b.column(1)[i].values.take(pa.array(np.cumsum(doc, dtype=np.int64)[more])),
                         pa.array(place)], ["h", "doc", "at"])
    return run


def _firsts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row a hash, in its order: the first by document and place, and
    whether any row is of another document. ``many`` says so of rows that stand for several."""
    docs = pc.dictionary_encode(rows.column(1))
    rank = np.empty(len(docs.dictionary), np.int64)
    rank[pc.sort_indices(docs.dictionary).to_numpy()] = np.arange(len(rank))
    h, at, rank = rows.column(0).to_numpy(), rows.column(2).to_numpy(), rank[docs.indices.to_numpy()]
    order = np.lexsort((rank << 32 | at >> 32, h))
    new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    many = rows.column(3).to_numpy(zero_copy_only=False)[order] | (rank[order] != np.repeat(rank[order][new], np.diff(np.append(new, len(h)))))
    out = rows.take(pa.array(order[new]))
    return pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(np.logical_or.reduceat(many, new))], rows.schema.names)


def _to_first(parts: int):
    """Packed seeds to the matches of all seeds that more than one document has
    with the first of their hash (least document, least position), the first
    itself included. No more is held than the firsts and ``FIRST_ROWS`` seeds:
    the seeds pass by twice, so a frequent one takes no room."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, held, writer = None, [], None
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as kept:
            for b in _seed_rows(parts)(batches):
                writer = writer or pa.ipc.new_stream(kept, b.schema)
                writer.write_batch(b)
                held.append(b.append_column("many", pa.array(np.zeros(b.num_rows, bool))))
                if sum(z.num_rows for z in held) >= FIRST_ROWS:
                    held = [_firsts(pa.concat_batches(held))]
                    firsts, held = _firsts(pa.concat_batches([firsts, *held])) if firsts else held[0], []
            if writer is None:
                return
            firsts = _firsts(pa.concat_batches([firsts, *held] if firsts else held))
            firsts = firsts.filter(firsts.column(3))
            hashes, to = (firsts.column(k).to_numpy() for k in (0, 2))
            writer.close()
            kept.seek(0)
            for b in pa.ipc.open_stream(kept) if len(hashes) else ():
                h, at = b.column(0).to_numpy(), b.column(2).to_numpy()
                first = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                mine = np.flatnonzero(hashes[first] == h)
                first, at = first[mine], at[mine]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(pa.array(mine)), firsts.column(1).take(pa.array(first)), pa.array((at >> 32) << 32 | to[first] >> 32),
                     pa.array(np.minimum(at & 0xFFFFFFFF, to[first] & 0xFFFFFFFF), pa.int32())], ["doc", "other", "yx", "n"])
            pa.default_memory_pool().release_unused()
    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, in batches that end with a value of it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.asarray(pc.run_end_encode(b.column(0)).run_ends)
        cut = int(ends[-2]) if len(ends) > 1 else 0         # the last value may go on in the next batch
        if held and (cut or held[0].column(0)[0] != b.column(0)[0]):
            held.append(b.slice(0, cut))
            yield pa.concat_batches(held)
            held.clear()
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by doc to one packed row a document: the documents they
    lead to, and for each match, in the order of y, which of those, y, x and words."""
    for b in _whole(batches):
        yield _packed_documents(b, [0, *pc.run_end_encode(b.column(0)).run_ends.to_pylist()])


def _packed_documents(b: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
    order = np.lexsort((b.column(2).to_numpy(), np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
    others = pc.dictionary_encode(b.column(1))
    which, yx, n = (c.to_numpy()[order] for c in (others.indices, b.column(2), b.column(3)))
    y, x = yx >> 32, yx & 0xFFFFFFFF
    used, sizes, packed = [], [0], []
    for i, j in zip(ends, ends[1:]):
        own, local = np.unique(which[i:j], return_inverse=True)
        used.append(own)
        sizes.append(sizes[-1] + len(own))
        packed.append(_pack(np.concatenate([local, np.diff(y[i:j], prepend=0), np.diff(x[i:j] - y[i:j], prepend=0), n[i:j]]).astype(np.int32)))
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), others.dictionary.take(pa.array(np.concatenate([np.zeros(0, np.int64), *used]))))
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ends[:-1], pa.int64())), lists, pa.array(packed, pa.binary())], ["doc", "others", "m"])


def _unpacked(others: pa.ListArray, packed: pa.Array) -> list[np.ndarray]:
    """(row, place in the flattened lists of others, y, x, words) of the matches of packed rows."""
    cols, lists = [[np.zeros(0, np.int64)] for _ in range(5)], others.offsets.to_numpy() - others.offsets[0].as_py()
    for i, m in enumerate(packed):
        local, y, lag, n = _unpack(m.as_py(), np.int32).reshape(4, -1).astype(np.int64)
        y = np.cumsum(y)
        for c, v in zip(cols, (np.full(len(y), i), local + lists[i], y, y + np.cumsum(lag), n)):
            c.append(v)
    return [np.concatenate(c) for c in cols]


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed matches to pairs of seeds at most ``REACH`` words apart, keyed by
    the firsts of both, with document and places. Where both lead to the same
    stretch of one document, that one is the first to hold the pair, and the
    seeds are joined to it already."""
    for b in _slices(batches):
        row, which, y, x, _ = _unpacked(b.column(1), b.column(2))
        others = pc.dictionary_encode(b.column(1).flatten())
        values = np.array([xxhash.xxh64_intdigest(repr(v).encode()) for v in others.dictionary.to_pylist()], np.uint64)
        code, place = others.indices.to_numpy()[which], row << 32 | y
        key = _mix(values[code], x.astype(np.uint64))
        for d in range(K, K + REACH + 1):
            j = np.searchsorted(place, place + d)
            i = np.flatnonzero(place[np.minimum(j, len(place) - 1)] == place + d)
            j = j[i]
            i, j = (c[(code[i] != code[j]) | (x[j] - x[i] < K) | (x[j] - x[i] > K + REACH)] for c in (i, j))
            yield pa.RecordBatch.from_arrays([pa.array(_mix(key[i], key[j]).view(np.int64)), b.column(0).take(pa.array(row[i])),
                                              pa.array(y[i] << 32 | y[j])], ["h", "doc", "at"])


def _pairs_to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs sorted by (h, doc, at) beside the first of their key, which is
    carried along: a frequent pair is never held in memory."""
    carried = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if carried is None else pa.concat_batches([carried, b])
        h, row = b.column(0).to_numpy(), np.arange(b.num_rows)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), row, 0))
        carried = b.take(pa.array(first[-1:]))
        later = np.flatnonzero(first != row)
        mine, of = b.take(pa.array(later)), b.take(pa.array(first[later]))
        yield pa.RecordBatch.from_arrays([mine.column(1), of.column(1), mine.column(2), of.column(2)], ["doc", "other", "at", "to"])


class PrefixMax:
    """Fenwick tree: (value, payload) maxima over prefixes."""

    def __init__(self, n: int):
        self.v = [float("-inf")] * (n + 1)
        self.at = [-1] * (n + 1)

    def put(self, i: int, value: float, payload: int) -> None:
        i += 1
        while i < len(self.v):
            if value > self.v[i]:
                self.v[i], self.at[i] = value, payload
            i += i & -i

    def best(self, n: int) -> tuple[float, int]:
        """Largest value among the first n places."""
        value, payload = float("-inf"), -1
        while n > 0:
            if self.v[n] > value:
                value, payload = self.v[n], self.at[n]
            n -= n & -n
        return value, payload


def chain(segments: list[tuple[int, int, int]]) -> list[list[int]]:
    """Disjoint best chains over segments (x, y, words), as index lists.

    A chain's score is its words less ``GAP_COST`` for each word skipped on
    either side; a link needs both x and y to move on past the segment's end.
    Segments start in the order of y; ends are entered into the tree, at the
    rank of their x end, before any start behind them asks. Where the best of
    all ends lies farther back than ``MAX_GAP``, those within it are compared.
    """
    n = len(segments)
    ends = sorted({x + w for x, _, w in segments})
    rank = {e: i for i, e in enumerate(ends)}
    tree, score, link = PrefixMax(len(ends)), [0.0] * n, [-1] * n
    events = sorted([(y, 1, i) for i, (_, y, _) in enumerate(segments)] + [(y + w, 0, i) for i, (_, y, w) in enumerate(segments)])
    starts = np.searchsorted(ends, [s[0] for s in segments], side="right").tolist()
    ended: list[tuple[int, int, float, int]] = []       # (x end, y end, value, segment), in the order of y
    for _, is_start, i in events:
        x, y, w = segments[i]
        if is_start:
            value, j = tree.best(starts[i])
            if value > GAP_COST * (x + y) and max(x - segments[j][0] - segments[j][2], y - segments[j][1] - segments[j][2]) > MAX_GAP:
                value, j = float("-inf"), -1
                for a, b, v, k in reversed(ended):
                    if y - b > MAX_GAP:
                        break
                    if 0 <= x - a <= MAX_GAP and v > value:
                        value, j = v, k
            value -= GAP_COST * (x + y)
            if j >= 0 and value > 0:
                score[i], link[i] = w + value, j
            else:
                score[i] = float(w)
        else:
            value = score[i] + GAP_COST * (x + w + y + w)
            tree.put(rank[x + w], value, i)
            ended.append((x + w, y + w, value, i))
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = link[i]
        if path:
            out.append(path[::-1])
    return out



def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc, the packed matches of a document (kind 0) and the
    pairs of it (kind 1), to chains of at least MIN_CHAIN words in seeds."""
    for b in _whole(_slices(batches, 10 * SLICE_ROWS)):         # most of the rows are pairs
        yield from _chain_documents(b)


def _chain_documents(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Chains of the seeds by themselves, and of the seeds with the pairs where
    those reach further in the document. The latter have y0 below zero (-1 - y0),
    as a chain is known by its start."""
    kind = b.column(1).to_numpy()
    whole, pairs = (b.filter(pa.array(kind == k)) for k in (0, 1))
    row, which, y, x, n = _unpacked(whole.column(2), whole.column(3))
    at, to = (pairs.column(k).to_numpy() for k in (5, 6))
    doc = pa.concat_arrays([whole.column(0).take(pa.array(row)), pairs.column(0), pairs.column(0)])
    other = pa.concat_arrays([whole.column(2).flatten().take(pa.array(which)), pairs.column(4), pairs.column(4)])
    y, x = np.concatenate([y, at >> 32, at & 0xFFFFFFFF]), np.concatenate([x, to >> 32, to & 0xFFFFFFFF])
    seeds = len(n)
    n = np.concatenate([n, np.full(2 * len(at), K)])
    codes = pc.dictionary_encode(pa.concat_arrays([doc, other]))
    doc_code, other_code = codes.indices.to_numpy().reshape(2, -1).astype(np.int64)
    both = doc_code * len(codes.dictionary) + other_code
    order = np.argsort(both, kind="stable")
    order = order[doc_code[order] != other_code[order]]

    def chains(take: np.ndarray) -> pa.RecordBatch:
        return _chain_pairs(*(c.take(pa.array(take)).to_numpy(zero_copy_only=False) for c in (doc, other)), y[take], x[take], n[take])

    reach: dict[tuple, list[tuple[int, int]]] = {}
    if len(alone := order[order < seeds]):
        found = chains(alone)
        yield found
        for d, o, y0, segments in zip(*(found.column(k).to_pylist() for k in (0, 1, 2, 4))):
            reach.setdefault((d, o), []).append((y0, segments[-2] + segments[-1]))
    if len(joined := order[np.isin(both[order], both[seeds:])]):
        found = chains(joined)
        more = [not any(lo <= y0 and segments[-2] + segments[-1] <= hi for lo, hi in reach.get((d, o), ()))
                for d, o, y0, segments in zip(*(found.column(k).to_pylist() for k in (0, 1, 2, 4)))]
        found = found.filter(pa.array(more, pa.bool_()))
        yield found.set_column(2, "y0", pa.array(-1 - found.column(2).to_numpy()))


def _chain_pairs(doc: np.ndarray, other: np.ndarray, y: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    pair = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])) - 1
    order = np.lexsort((y, x - y, pair))
    doc, other, y, x, n, pair = (c[order] for c in (doc, other, y, x, n, pair))
    turn = np.concatenate([[True], (pair[1:] != pair[:-1]) | ((x - y)[1:] != (x - y)[:-1])])
    line = np.cumsum(turn) << 32
    end = np.maximum.accumulate(line + y + n)           # furthest end on the diagonal so far
    s = np.flatnonzero(turn | np.concatenate([[True], (line + y)[1:] > end[:-1]]))      # segments: a diagonal without a hole
    words = (end - line)[np.append(s[1:], len(y)) - 1] - y[s]
    s, words = s[(by := np.lexsort((y[s], pair[s])))], words[by]
    p = np.flatnonzero(np.concatenate([[True], pair[s][1:] != pair[s][:-1]]))
    many = np.add.reduceat(words, p) >= MIN_CHAIN
    sx, sy, words = x[s].tolist(), y[s].tolist(), words.tolist()
    rows = []
    for i, j in zip(p[many].tolist(), np.append(p[1:], len(s))[many].tolist()):
        segments = list(zip(sx[i:j], sy[i:j], words[i:j]))
        for path in [[0]] if j - i == 1 else chain(segments):
            picked = [segments[k] for k in path]
            if sum(t[2] for t in picked) >= MIN_CHAIN:
                rows.append((s[i], picked[0][1], picked[0][0], [int(v) for t in picked for v in t]))
    at = np.array([r[0] for r in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at]), pa.array(other[at]), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)],
         pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["doc", "other", "y0", "x0", "segments"])


def _gaps(segments: list[int], side: int) -> list[tuple[int, int]]:
    """Word ranges to align on one side (0: other, 1: doc): before the first
    segment, between segments, after the last. A short chain gets flanks in
    which it can grow to ``MIN_WORDS``."""
    at, n = segments[side::3], segments[2::3]
    ends = [a + w for a, w in zip(at, n)]
    flank = max(FLANK, MIN_WORDS - (ends[-1] - at[0]))
    return [(max(0, at[0] - flank), at[0]), *zip(ends, at[1:]), (ends[-1], ends[-1] + flank)]


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way to their requests."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in _slices(batches):
        texts = [squeeze.compress(t.as_buffer()) if t.is_valid else None for t in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["id", "t"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (id, kind): a text, then the requests for its words.
    Words are answered as 32-bit checksums, each range led by its length."""
    current, text, words = None, b"", None
    expand = zstandard.ZstdDecompressor()
    names = ["doc", "other", "y0", "x0", "side", "words"]
    for b in _slices(batches):
        out = []
        texts = b.column(2)
        for i, (key, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if not kind:
                packed = texts[i].as_py()
                if key != current:
                    current, text, words = key, packed, None
                elif packed is not None and text is not None:       # rows that repeat an id: the first by text
                    text = min(text, packed, key=expand.decompress)
                else:
                    text = None
                continue
            if words is None:
                words = word_list(b"" if text is None else expand.decompress(text))
            row = [b.column(j)[i].as_py() for j in range(3, 8)]
            got = []
            for lo, hi in _gaps(row[4], 0 if kind == 2 else 1):
                part = [zlib.crc32(w) for w in words[lo:hi]]
                got += [len(part), *part]
            out.append((*row[:4], kind, np.array(got, np.uint32).tobytes()))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.column(3).type), pa.array(cols[1], b.column(4).type), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], names)


def _ranges(b: bytes) -> list[list[int]]:
    flat, out, i = np.frombuffer(b, np.uint32).tolist(), [], 0
    while i < len(flat):
        out.append(flat[i + 1:i + 1 + flat[i]])
        i += 1 + flat[i]
    return out


def matching_words(a: list[int], b: list[int]) -> int:
    """Matches of a global alignment with fewest edits (most matches among
    those); equal lengths without shifted words align place by place."""
    same = sum(map(int.__eq__, a, b))
    if len(a) == len(b) and (same >= len(a) - 1 or not set(a) & set(b)):
        return same
    row = [(j, 0) for j in range(len(b) + 1)]           # (edits, -matches)
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], (i, 0)
        for j, z in enumerate(b, 1):
            take = (diagonal[0], diagonal[1] - 1) if x == z else (diagonal[0] + 1, diagonal[1])
            diagonal = row[j]
            row[j] = min(take, (row[j][0] + 1, row[j][1]), (row[j - 1][0] + 1, row[j - 1][1]))
    return -row[-1][1]


def _grow(agree: list[bool]) -> tuple[int, int]:
    """(words, matches) of the best way on from an end: a changed word must be
    made up for by as many matching ones as ``MIN_IDENTITY`` asks."""
    best, out, value, matches = 0.0, (0, 0), 0.0, 0
    for n, same in enumerate(agree, 1):
        matches += same
        value += 1 - MIN_IDENTITY if same else -MIN_IDENTITY
        if same and value >= best - 1e-9:
            best, out = value, (n, matches)
    return out


def _stretch(words: int, matches: int, left: list[bool], right: list[bool]) -> tuple[int, int]:
    """Words to add on either side so that a short piece has ``MIN_WORDS``
    and keeps ``MIN_IDENTITY``, those that keep most of it; (0, 0) if none do."""
    best, out = MIN_IDENTITY - 1e-9, (0, 0)
    if matches + sum(left) + sum(right) < MIN_IDENTITY * MIN_WORDS:
        return out
    a, b = [[(0, 0), *((n, sum(z[:n])) for n in range(1, len(z) + 1) if z[n - 1])] for z in (left, right)]
    for n, m in a:
        for k, q in b:
            if words + n + k >= MIN_WORDS and (matches + m + q) / (words + n + k) > best:
                best, out = (matches + m + q) / (words + n + k), (n, k)
    return out


def align(segments: list[int], other: bytes, doc: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, matching words) of the pieces of
    a chain: gaps aligned, ends carried on word by word. A chain that agrees
    less than ``MIN_IDENTITY`` is cut at the gap with most edits."""
    a, b = _ranges(other), _ranges(doc)
    xs, ys, ws = segments[0::3], segments[1::3], segments[2::3]
    inner = [matching_words(p, q) for p, q in zip(a[1:-1], b[1:-1])]
    edits = [max(len(p), len(q)) - m for p, q, m in zip(a[1:-1], b[1:-1], inner)]
    todo, out = [(0, len(ws))], []
    while todo:
        i, j = todo.pop()
        size = [z[j - 1] + ws[j - 1] - z[i] for z in (ys, xs)]
        match = sum(ws[i:j]) + sum(inner[i:j - 1])
        if j - i > 1 and match < MIN_IDENTITY * max(size):
            k = max(range(i, j - 1), key=edits.__getitem__) + 1
            todo += [(k, j), (i, k)]
            continue
        # only the outer ends of the chain have flanks
        left = [p == q for p, q in zip(a[0][::-1], b[0][::-1])] if i == 0 else []
        right = [p == q for p, q in zip(a[-1], b[-1])] if j == len(ws) else []
        (n, m), (k, q) = _grow(left), _grow(right)
        match += m + q
        if max(size) + n + k < MIN_WORDS:
            more = _stretch(max(size) + n + k, match, left[n:], right[k:])
            match += sum(left[n:n + more[0]]) + sum(right[k:k + more[1]])
            n, k = n + more[0], k + more[1]
        out.append((ys[i] - n, ys[i] + size[0] + k, xs[i] - n, xs[i] + size[1] + k, match))
    return out


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["start", "end", "other_start", "other_end", "matched", "joined"]
    for b in _slices(batches):
        got = [align(s, o, d) for s, o, d in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
        at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]).astype(np.int64))
        cols = list(zip(*(r for g in got for r in g))) if got else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(c, pa.int64()) for c in cols],
                                          pc.less(b.column(5).take(at), 0)],
                                         ["doc_id", "other_id", *names])


def _longest(rows: pa.RecordBatch) -> list[int]:
    """Pieces of an island without those of a pair's chain (joined) that lie
    inside another piece, and those that such a chain made longer."""
    cols = [rows.column(c).to_pylist() for c in ("start", "end", "other_id", "other_start", "joined")]
    order = sorted(range(rows.num_rows), key=lambda i: (cols[0][i], -cols[1][i], cols[4][i], i))
    far, best, out = -1, {}, []
    for i in order:
        lo, hi, other, at, joined = (c[i] for c in cols)
        if not joined:
            if best.get((other, at - lo), -1) < hi:
                out.append(i)
        elif far < hi:
            best[other, at - lo] = hi
            out.append(i)
        far = max(far, hi)
    return sorted(out)


def _islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (doc_id, start): those of islands of at least
    ``MIN_WORDS`` words, with the island's words. An island joins on as long
    as the gap is small for the shorter of its covered words and the piece."""
    held: list[pa.RecordBatch] = []
    key, first, far, covered = None, 0, 0, 0

    def close() -> Iterator[pa.RecordBatch]:
        if far - first >= MIN_WORDS:
            rows = pa.concat_batches(held)
            rows = rows.take(pa.array(_longest(rows), pa.int64())) if pc.any(rows.column("joined")).as_py() else rows
            yield rows.drop_columns(["joined"]).append_column("passage_words", pa.array([far - first] * rows.num_rows, pa.int64()))
        held.clear()

    for b in batches:
        begun = 0
        for i, (d, lo, hi) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("end").to_pylist())):
            gap = lo - far
            if d != key or gap > JOIN_GAP * min(1.0, min(covered, hi - lo) / JOIN_FULL):
                if key is not None:
                    if i > begun:
                        held.append(b.slice(begun, i - begun))
                    yield from close()
                key, first, far, covered, begun = d, lo, hi, hi - lo, i
            else:
                covered, far = covered + max(0, hi - max(lo, far)), max(far, hi)
        if b.num_rows > begun:
            held.append(b.slice(begun))
    if key is not None:
        yield from close()


def shared_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per passage that a document shares with the first document
    that has it: doc_id, start, end (words, end exclusive), other_id,
    other_start, other_end, matched, identity, passage_words.

    Words are lower-cased (A-Z). A passage has at least ``MIN_WORDS`` words,
    of which at least ``MIN_IDENTITY`` match; parts that lie next to each
    other in the document but have different first documents count together
    (``passage_words``), and every copy in a document has its row. Passages
    inside one document are no match. Null and
    empty texts share nothing; rows with a null id are left out; rows that
    repeat an id are taken as that one document, by the text that sorts
    first. Empty table: empty result. Very long texts are read whole; of
    equally good chains the one that begins first is taken, of several first
    documents of a seed the smallest id. A passage is found whatever documents
    hold its grams first, as long as it has two grams with different firsts no
    more than ``REACH`` words apart, or eight words in grams with firsts in one
    document; what is only in grams farther apart, each first elsewhere, is not.
    Other columns are left aside.
    """
    ship_package(docs.sparkSession)
    typ = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_seed_blocks(parts), f"p int, docs array<{typ}>, h binary, doc binary, pos binary, n binary")
    matches = packed.repartitionById(parts, F.col("p")).mapInArrow(_to_first(parts), f"doc {typ}, other {typ}, yx bigint, n int")
    by_doc = shared_table(matches.repartition("doc").sortWithinPartitions("doc").mapInArrow(
        _by_document, f"doc {typ}, others array<{typ}>, m binary"), "matches")
    pairs = by_doc.mapInArrow(_pair_rows, f"h bigint, doc {typ}, at bigint").repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(
        _pairs_to_first, f"doc {typ}, other {typ}, at bigint, to bigint").filter("doc != other")
    seeds_and_pairs = by_doc.selectExpr("doc", "0 AS kind", "others", "m", f"CAST(NULL AS {typ}) AS other", "0L AS at", "0L AS to").union(
        pairs.selectExpr("doc", "1 AS kind", f"CAST(NULL AS array<{typ}>) AS others", "CAST(NULL AS binary) AS m", "other", "at", "to"))
    chains = shared_table(seeds_and_pairs.repartition("doc").sortWithinPartitions("doc").mapInArrow(
        _chains, f"doc {typ}, other {typ}, y0 bigint, x0 bigint, segments array<int>"), "chains")
    drop_shared(by_doc)
    ask = ["doc", "other", "y0", "x0", "segments"]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(ask, (typ, typ, "bigint", "bigint", "array<int>"))]
    requests = [chains.select(F.col(c).alias("id"), F.lit(k).alias("kind"), F.lit(None).cast("binary").alias("t"), *ask)
                for c, k in (("doc", 1), ("other", 2))]
    texts = rows.mapInArrow(_squeezed, f"id {typ}, t binary").select("id", F.lit(0).alias("kind"), "t", *none)
    both = texts.union(requests[0]).union(requests[1])
    words = both.repartition("id").sortWithinPartitions("id", "kind").mapInArrow(
        _cut, f"doc {typ}, other {typ}, y0 bigint, x0 bigint, side int, words binary")
    key = ["doc", "other", "y0", "x0"]
    sides = words.groupBy(*key).agg(F.max(F.when(F.col("side") == 2, F.col("words"))).alias("a"),
                                    F.max(F.when(F.col("side") == 1, F.col("words"))).alias("b"))
    aligned = chains.join(sides, key).select("doc", "other", "segments", "a", "b", "y0").mapInArrow(
        _align_rows, f"doc_id {typ}, other_id {typ}, start bigint, end bigint, other_start bigint, other_end bigint, matched bigint, joined boolean")
    longest = F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    good = aligned.withColumn("identity", F.round(F.col("matched") / longest, 6)).filter(F.col("identity") >= MIN_IDENTITY)
    out = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "matched", "identity", "joined"]
    good = good.select(*out).repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "other_id", "other_start")
    return good.mapInArrow(_islands, f"doc_id {typ}, start bigint, end bigint, other_id {typ}, other_start bigint, "
                                     "other_end bigint, matched bigint, identity double, passage_words bigint")
