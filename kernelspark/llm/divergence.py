"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are compared
with its language's references by the Jensen-Shannon distance (base 2, in
[0, 1]). The references come from the corpus: a language's common words are
those that most of its documents hold, and a reference is the mean histogram of
the documents that pass the base rules. Short texts, whose histograms say
little, are guarded by minimum lengths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelspark.session import ship_package

from .common import shared_table

#: Character classes; the last two: the other ASCII characters, and all others (counted once a code point).
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\t\n\x0b\x0c\r ", b".,;:?", b"!",
           b"#*$%&", b"|<>")
N_CLASSES = len(CLASSES) + 2
_CLASS = np.zeros((256, N_CLASSES))
_CLASS[:128, -2] = 1
_CLASS[0xC0:, -1] = 1
for _j, _c in enumerate(CLASSES):
    _CLASS[list(_c), -2] = 0
    _CLASS[list(_c), _j] = 1
_SYMBOLS = list(b"#*$%&|<>")
_SPACE = [9, 10, 11, 12, 13, 32]
#: Bins of the word histogram: this many common words of the language, and the rest.
COMMON = 40
#: Base rules: fewest words, largest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Largest distances, and the least words (characters) at which each histogram is judged.
MAX_CLASS_DISTANCE, MIN_CLASS_CHARS = 0.2, 400
MAX_WORD_DISTANCE, MIN_WORD_WORDS = 0.34, 100


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by ``size``-word windows that occur at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    grams = list(zip(*[words[i:] for i in range(size)]))
    if len(set(grams)) == n:
        return 0
    seen = Counter(grams)
    hit = np.fromiter((seen[g] > 1 for g in grams), bool, n)
    cover = np.zeros(n + size - 1, bool)
    for i in range(size):
        cover[i:i + n] |= hit
    return int(cover.sum())


def base_counts(text: bytes) -> tuple[list[bytes], np.ndarray, list[int]]:
    """Words, byte counts, and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words of a whole text."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(counts[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return words, counts, [len(words), points - int(counts[_SPACE].sum()), int(counts[_SYMBOLS].sum()),
                           len(lines) - len(set(lines)), repeated_words(words)]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of ``p`` to ``q``; rows
    of zeros have distance 0."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-300)
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(axis=-1)
    js = (part(p) + part(np.broadcast_to(q, p.shape))) / 2
    return np.where(p.sum(axis=-1) > 0, np.sqrt(np.clip(js, 0, 1)), 0)


def common_words(docs: DataFrame, text: str, lang: str, top: int = COMMON) -> dict[str | None, list[bytes]]:
    """Per language the ``top`` words with the most documents (ties: the
    smaller word); ``top`` rows a language reach the driver."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(
                [r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])
        for b in batches:
            for t, k in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(k, Counter()).update(set((t or b"").lower().split()))
            if sum(map(len, seen.values())) > 200_000:
                yield out()
                seen.clear()
        yield out()

    counts = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(
        each, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counts.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top).orderBy("lang", "k").collect()
    words: dict[str | None, list[bytes]] = {}
    for r in best:
        words.setdefault(r["lang"], []).append(bytes(r["word"]))
    return words


def histograms(docs: DataFrame, words: dict, text: str, doc_id: str, lang: str) -> DataFrame:
    """doc_id, lang, the base counts, h (class counts and common-word counts
    as doubles)."""
    index = {k: {w: i for i, w in enumerate(ws)} for k, ws in words.items()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, hist = [], []
            for t, k in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                ws, counts, row = base_counts(t or b"")
                h = np.zeros(N_CLASSES + COMMON + 1, np.float32)
                h[:N_CLASSES] = counts @ _CLASS
                own, rest = index.get(k, {}), len(ws)
                for w, n in Counter(filter(own.__contains__, (t or b"").lower().split())).items():
                    h[N_CLASSES + own[w]] = n
                    rest -= n
                h[-1] = rest
                base.append(row)
                hist.append(h.tobytes())
            cols = list(zip(*base)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols], pa.array(hist, pa.binary())],
                ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "h"])

    typ = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(
        each, f"doc_id {typ}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
              "n_repeat_words bigint, h binary")


def _shares(h: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(h), np.float32).reshape(len(h), N_CLASSES + COMMON + 1).astype(np.float64)
    for a, b in ((0, N_CLASSES), (N_CLASSES, x.shape[1])):
        x[:, a:b] /= np.maximum(x[:, a:b].sum(axis=1, keepdims=True), 1e-300)
    return x


def references(table: DataFrame) -> dict[str | None, np.ndarray]:
    """Mean histogram per language over the documents that pass the base
    rules; summed per task first, then per language."""
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        total: dict = {}
        for f in frames:
            x = _shares(f["h"])
            for k, i in f.groupby("lang", dropna=False).indices.items():
                k = None if k != k else k
                n, s = total.get(k, (0, 0.0))
                total[k] = (n + len(i), s + x[i].sum(axis=0))
        yield pd.DataFrame([(k, TaskContext.get().partitionId(), n, s.tobytes()) for k, (n, s) in total.items()],
                           columns=["lang", "p", "n", "s"])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("p")
        s = sum((np.frombuffer(x) for x in f["s"]), np.zeros(N_CLASSES + COMMON + 1))
        return pd.DataFrame({"lang": [f["lang"].iloc[0]], "s": [(s / f["n"].sum()).tobytes()]})

    good = table.filter("NOT base_failed").select("lang", "h").mapInPandas(each, "lang string, p int, n bigint, s binary")
    return {r["lang"]: np.frombuffer(r["s"]) for r in good.groupBy("lang").applyInPandas(meet, "lang string, s binary").collect()}


def divergence_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
    kept.

    Null texts count as empty (and fail the base rule on length). A null
    language is a language of its own; one without a single document that
    passes the base rules has no reference, distances are null there and
    only the base rules count. Repeated rows are judged alike. Empty table:
    empty result. The number of languages is taken to be small. Very long
    texts are read whole, one at a time; of words in equally many documents
    the smaller one is common. Other columns are left aside.
    """
    ship_package(docs.sparkSession)
    words = common_words(docs, text, lang)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    table = shared_table(histograms(docs, words, text, doc_id, lang).withColumn("base_failed", failed), "divergence")
    ref = references(table)

    @F.pandas_udf("class_distance double, word_distance double")
    def distances(lang: pd.Series, h: pd.Series) -> pd.DataFrame:
        x = _shares(h)
        out = np.full((len(h), 2), np.nan)
        for k, q in ref.items():
            i = np.flatnonzero(lang.isna() if k is None else lang == k)
            out[i, 0] = distance(x[i, :N_CLASSES], q[:N_CLASSES])
            out[i, 1] = distance(x[i, N_CLASSES:], q[N_CLASSES:])
        return pd.DataFrame({"class_distance": out[:, 0], "word_distance": out[:, 1]}).round(9)

    judged = table.withColumn("d", distances("lang", "h")).select(
        "*", *[F.nanvl(F.col(f"d.{c}"), F.lit(None).cast("double")).alias(c) for c in ("class_distance", "word_distance")])
    strange = (((F.col("word_chars") >= MIN_CLASS_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE))
               | ((F.col("n_words") >= MIN_WORD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "class_distance", "word_distance",
                         (~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).alias("kept"))
