"""Token counts by a deterministic transducer compiled from a BPE vocabulary.

Reading a text from the left, every prefix has one BPE encoding, and its last
token is the only token at its end that is *compatible* with the last token of
the prefix before it: two tokens are compatible if encoding their joint text
gives the two back, and an encoding is right exactly if all its neighbours are.
(A merge across a border depends on the two tokens beside it only.) So a
prefix's token count follows from the counts of the few prefixes that an
unfinished piece may still begin at. Those prefixes are a state of a
transducer: for each, the place in the trie of pieces, its last token and its
count above the least of them. A transition emits by how much that least count
grows, which is never negative; the end of a text emits the rest.

States and transitions are made when first met and kept in a bounded table.
Texts are cut into chunks, each chunk is a map from entry states to exit
states and counts, and the maps compose in a prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernelspark.session import ship_package

from .common import free_name
from .piece_tokenizer import BPE, MARK, NORMAL, UNUSED, USER_DEFINED, PieceModel, parse_model

#: Most states a worker keeps; beyond, it starts a new table between two chunks.
MAX_STATES = 200_000
#: Characters of a chunk, and the characters read ahead of a cut that has no fixed state.
CHUNK, WARM = 1 << 16, 64
#: Key of a state's own live prefixes in its table of transitions.
LIVE = None


class Transducer:
    """A counting transducer for a SentencePiece BPE model with byte fallback.

    A state is a dict from characters to (next state, emitted count); under
    ``LIVE`` it holds its prefixes as (trie node, last token, count).
    """

    def __init__(self, model: PieceModel, max_states: int = MAX_STATES):
        if model.model_type != BPE or not model.byte_fallback or model.charsmap or model.remove_extra_whitespaces \
                or model.suffix_marker or not model.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and without text changes can be compiled")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in model.pieces):
            raise ValueError("user-defined and unused pieces cannot be compiled")
        self.score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        self.prefix = MARK if model.add_dummy_prefix else ""
        self.max_states = max_states
        self.child: dict[tuple[int, str], int] = {}
        self.piece: dict[int, str] = {}         # trie node -> the piece that ends there
        self.inner: set[str] = set()            # character pairs inside pieces
        parents = set()
        for p in self.score:
            node = 0
            for ch in p:
                parents.add(node)
                node = self.child.setdefault((node, ch), len(self.child) + 1)
            self.piece[node] = p
            self.inner.update(map(str.__add__, p, p[1:]))
        self.open = parents                     # nodes that a longer piece goes through
        #: Does the marker always begin a piece after another character? Then texts can be cut there.
        self.cuts = not any(pair[1] == MARK and pair[0] != MARK for pair in self.inner)
        self._joins: dict[tuple[str, str], bool] = {}
        self.flush()

    def flush(self) -> None:
        """Forget all states (they are made again when met)."""
        for s in getattr(self, "states", {}).values():
            s.clear()
        self.states: dict[tuple, dict] = {}
        self._joins.clear()

    def state(self, live: tuple) -> dict:
        s = self.states.get(live)
        if s is None:
            s = self.states[live] = {LIVE: live}
        return s

    def encode(self, text: str) -> list[str]:
        """BPE by definition: the best-scored pair first, the leftmost among equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """May token b follow token a? An empty a asks for b alone."""
        hit = self._joins.get((a, b))
        if hit is None:
            hit = self._joins[a, b] = self.encode(a + b) == ([a, b] if a else [b])
        return hit

    def step(self, state: dict, ch: str) -> tuple[dict, int]:
        """The transition of ``state`` under ``ch``, made and kept."""
        live, found = [], None
        for node, last, count in state[LIVE]:
            if not node and last and last[-1] + ch not in self.inner:
                last = ""               # no merge crosses here: whatever stood before
            to = self.child.get((node, ch))
            if to in self.open:
                live.append((to, last, count))
            token = self.piece.get(to) if node or to in self.piece else ch
            if found is None and token is not None and self.compatible(last, token):
                found = (0, token, count + (1 if token in self.score else len(ch.encode("utf-8", "replace"))))
        live.append(found)
        base = min(c for _, _, c in live)
        out = state[ch] = (self.state(tuple((n, t, c - base) for n, t, c in live)), base)
        return out

    def run(self, live: tuple, text: str) -> tuple[tuple, int]:
        """(exit state, emitted count) of a chunk entered in state ``live``."""
        state, n = self.state(live), 0
        for ch in text:
            hit = state.get(ch)
            if hit is None:
                hit = self.step(state, ch)
            state, k = hit
            n += k
        return state[LIVE], n

    START = ((0, "", 0),)

    def chunks(self, text: str, size: int = CHUNK) -> Iterator[tuple[str, tuple]]:
        """(chunk, expected entry state): cut behind a marker that follows
        another character, where the state does not depend on what came
        before; in a stretch without one, at ``size``, where the state is
        guessed from the ``WARM`` characters before."""
        at, entry = 0, self.START
        while at < len(text):
            end = min(at + size, len(text))
            cut = None
            if end < len(text) and self.cuts:
                for m in re.finditer(f"[^{MARK}]{MARK}", text[max(at, end - size // 2):end]):
                    cut = m
                if cut:
                    end = max(at, end - size // 2) + cut.end()
            yield text[at:end], entry
            if end < len(text):
                entry = self.run(self.START, text[max(0, end - 2):end] if cut else text[max(0, end - WARM):end])[0]
            at = end

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        maps = []
        for chunk, entry in self.chunks(self.prefix + text.replace(" ", MARK), size):
            if len(self.states) > self.max_states:
                self.flush()
            maps.append(ChunkMap(self, chunk, entry))
        live, n = prefix_scan(maps)[-1].at(self.START)
        return n + live[-1][2]


class ChunkMap:
    """A chunk as a map from entry states to (exit state, count). The
    expected entry is evaluated at once, from the chunk alone; another one
    only if the chunk before turns out to end in it."""

    def __init__(self, machine: Transducer, text: str, entry: tuple):
        self._machine, self._text = machine, text
        self._map = {entry: machine.run(entry, text)}

    def at(self, entry: tuple) -> tuple[tuple, int]:
        if entry not in self._map:
            self._map[entry] = self._machine.run(entry, self._text)
        return self._map[entry]


class Composed:
    """One map after another; associative."""

    def __init__(self, first, second):
        self._first, self._second, self._map = first, second, {}

    def at(self, entry: tuple) -> tuple[tuple, int]:
        if entry not in self._map:
            middle, a = self._first.at(entry)
            end, b = self._second.at(middle)
            self._map[entry] = end, a + b
        return self._map[entry]


def prefix_scan(maps: list) -> list:
    """All prefixes' compositions, by doubling: log2(chunks) rounds of
    independent compositions."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = out[:reach] + [Composed(out[i - reach], out[i]) for i in range(reach, len(out))]
        reach *= 2
    return out


_BUILT: dict[bytes, Transducer] = {}


def _machine(model: bytes) -> Transducer:
    """Compiled once in each Python worker."""
    if model not in _BUILT:
        _BUILT[model] = Transducer(parse_model(model))
    return _BUILT[model]


def count_tokens(docs: DataFrame, model: bytes, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` without its text and with the number of tokens of each text
    added as ``out``; no shuffle, rows stay where they are.

    Null texts count as empty, empty texts have no tokens, strings of special
    tokens are ordinary text, and every text is read whole: a very long one
    is held once, as chunks, in the task that has its row. Repeated rows
    count alike, ties do not arise, an empty table gives an empty result. A
    column that is already called ``out`` is replaced.
    """
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), out.lower())]
    t = free_name(docs, "_text")
    kept = docs.select(*rest, F.col(text).alias(t))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for b in batches:
            counts = [machine.count(x.as_py() or "") for x in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*rest, out])

    return kept.mapInArrow(each, T.StructType([*kept.schema.fields[:-1], T.StructField(out, T.LongType())]))


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, null counting as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def token_report(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens),
    one row per document; edge rows as in ``count_tokens``."""
    sized = docs.select("doc_id", text_bytes().alias("n_bytes"), "text")
    return count_tokens(sized, model).withColumn("over_limit", F.col("n_tokens") > limit)
