"""Registered queries of the operators (``opN_<name>``) with production
parameters over whole tables, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (conversation_repair, divergence, exact_dedup, katz, mixing, passages, pii, piece_tokenizer, quality,
               runs, sharding, simhash, token_transducer)


#: The model file of operator 4, read by the driver (a public one that the box provides).
TOKENIZER_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive-unlabelled quality classifier over all documents."""
    return quality.quality_scores(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of all documents by a trigram model."""
    return katz.katz_scores(_docs(spark, sf_dir), order=3)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced label propagation of equal texts over 24 shards."""
    return sharding.shard_documents(_docs(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again and compared."""
    with open(TOKENIZER_MODEL, "rb") as f:
        model = f.read()
    return piece_tokenizer.encode_documents(_docs(spark, sf_dir).select("doc_id", "text"), model).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and their components over anchor points."""
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution divergence against language references."""
    return divergence.divergence_rules(_docs(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: patterns, checksums, context."""
    return pii.pii_report(_docs(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup by content sort."""
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages shared across documents, by collinear chaining."""
    return passages.shared_passages(_docs(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights at their exact budgets."""
    return mixing.mix(_docs(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired with the cheapest edits."""
    return conversation_repair.repair_report(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words by Lyndon roots."""
    return runs.run_report(_docs(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text by the compiled transducer."""
    with open(TOKENIZER_MODEL, "rb") as f:
        model = f.read()
    return token_transducer.token_report(_docs(spark, sf_dir), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_katz, op3_sharding, op4_sentencepiece, op5_simhash, op6_divergence, op7_pii,
                              op8_exact_dedup, op9_passages, op10_mixing, op11_conversation_repair,
                              op12_periodic_runs, op13_token_counts)
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLE_SQL["op10_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
num AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
lv AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cb, coalesce(sum(w) OVER b, 0)::BIGINT AS wb,
         (sum(source_size) OVER ())::BIGINT AS t, (sum(w) OVER ())::BIGINT AS tw FROM num
  WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
op AS (
  SELECT (t - cb)::DOUBLE / (tw - wb) AS level FROM lv WHERE cap::DOUBLE / w > (t - cb)::DOUBLE / (tw - wb)
  ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
tg AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, level * w), cap::DOUBLE) AS target
  FROM num LEFT JOIN op ON true),
p AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre,
         floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - pre)))::BIGINT AS taken,
       (epochs + CASE WHEN pre < budget - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""


def _sql_divergence() -> str:
    """Twin of op6: the same histograms, references and distances from
    regular expressions and grouped sums."""
    v = divergence
    sets = ["a-z", "A-Z", "0-9", r"\x09-\x0D ", ".,;:?", "!", "#*$%&", "|<>"]
    count = [f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))" for c in sets]
    other = "length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))"
    classes = ", ".join([*count, f"{other} - ({' + '.join(count)})", f"length(t) - {other}"])
    word = r"[^\x20\x09-\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT rid, regexp_extract_all(t, '{word}') AS ws FROM d)),
g AS (
  SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM hit, range(3) r(k) GROUP BY rid),
ln AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY rid),
b AS MATERIALIZED (
  SELECT d.rid, doc_id, lang, len(regexp_extract_all(t, '{word}'))::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, [{classes}] AS h
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
f AS MATERIALIZED (
  SELECT *, n_words < {v.MIN_WORDS} OR 100 * n_repeat_words > {v.MAX_REPEAT} * n_words AS base_failed FROM b),
lw AS MATERIALIZED (
  SELECT rid, translate(word, '{upper}', '{lower}') AS word FROM w),
top AS MATERIALIZED (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM
   (SELECT lang, word, count(DISTINCT rid) AS n FROM lw JOIN d USING (rid) GROUP BY lang, word)
  QUALIFY k <= {v.COMMON}),
bins AS MATERIALIZED (
  SELECT rid, lang, base_failed, 0 AS kind, unnest(range(len(h))) AS k, unnest(h)::DOUBLE AS n, list_sum(h)::DOUBLE AS total FROM f
  UNION ALL
  SELECT f.rid, f.lang, base_failed, 1, q.k, coalesce(c.n, 0), n_words
  FROM f, range(1, {v.COMMON} + 1) q(k) LEFT JOIN
   (SELECT rid, t.k, count(*) AS n FROM lw JOIN d USING (rid) JOIN top t ON t.lang IS NOT DISTINCT FROM d.lang AND t.word = lw.word GROUP BY rid, t.k) c
   ON c.rid = f.rid AND c.k = q.k
  UNION ALL
  SELECT f.rid, f.lang, base_failed, 1, 0, n_words - coalesce(c.n, 0), n_words
  FROM f LEFT JOIN (SELECT rid, count(*) AS n FROM lw JOIN d USING (rid) JOIN top t ON t.lang IS NOT DISTINCT FROM d.lang AND t.word = lw.word GROUP BY rid) c
   ON c.rid = f.rid),
sh AS MATERIALIZED (
  SELECT *, CASE WHEN total > 0 THEN n / total ELSE 0 END AS p FROM bins),
ref AS MATERIALIZED (
  SELECT lang, kind, k, avg(p) AS q FROM sh WHERE NOT base_failed GROUP BY lang, kind, k),
js AS (
  SELECT rid, sh.kind, max(total) AS total,
         sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js
  FROM sh JOIN ref ON sh.lang IS NOT DISTINCT FROM ref.lang AND sh.kind = ref.kind AND sh.k = ref.k GROUP BY rid, sh.kind),
dist AS (
  SELECT rid, round(max(CASE WHEN kind = 0 THEN x END), 9) AS class_distance, round(max(CASE WHEN kind = 1 THEN x END), 9) AS word_distance
  FROM (SELECT rid, kind, CASE WHEN total > 0 THEN sqrt(least(greatest(js, 0), 1)) ELSE 0 END AS x FROM js) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
       NOT base_failed AND NOT coalesce((word_chars >= {v.MIN_CLASS_CHARS} AND class_distance > {v.MAX_CLASS_DISTANCE}::DOUBLE)
         OR (n_words >= {v.MIN_WORD_WORDS} AND word_distance > {v.MAX_WORD_DISTANCE}::DOUBLE), false) AS kept
FROM f LEFT JOIN dist USING (rid)
"""


ORACLE_SQL["op6_divergence"] = _sql_divergence()


#: Rounds that the twin of op3 spells out; those behind the last one of the query change nothing.
SQL_ROUNDS = {"b": 8, "s": 24}


def _sql_sharding() -> str:
    """Twin of op3: the rounds of label propagation as chained CTEs."""
    n = sharding.SHARDS

    def unit(key: str) -> str:
        return f"(('0x' || substr({key}, 1, 13))::BIGINT::DOUBLE / {2 ** 52}::DOUBLE)"

    def phase(t: str, start: str, quota: str) -> list[str]:
        out = [f"{t}l0 AS MATERIALIZED ({start})", f"{t}n AS MATERIALIZED (SELECT count(*) AS n, true AS go FROM {t}l0)"]
        for r in range(SQL_ROUNDS[t]):
            k = f"{t}{r}"
            out.append(f"""room{k} AS MATERIALIZED (
  SELECT shard, greatest(0, quota - coalesce(n, 0)) AS room FROM {quota} LEFT JOIN (SELECT shard, count(*) AS n FROM {t}l{r} GROUP BY shard) USING (shard)),
tally{k} AS MATERIALIZED (
  SELECT block, shard, count(*) AS m, sum(count(*)) OVER (PARTITION BY block) AS members FROM {t}l{r} GROUP BY block, shard),
ask{k} AS MATERIALIZED (
  SELECT block, y.shard, dest, m FROM tally{k} y JOIN (
    SELECT block, shard AS dest FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY room >= members - m DESC, m DESC,
      md5(block || '|' || shard || '|{k}') DESC, shard DESC) AS p FROM tally{k} JOIN room{k} USING (shard)) WHERE p = 1) USING (block) WHERE y.shard <> dest),
flow{k} AS MATERIALIZED (SELECT shard, dest, sum(m) AS n FROM ask{k} GROUP BY shard, dest),
extra{k} AS MATERIALIZED (
  SELECT f.shard, f.dest, f.n, greatest(0, f.n - coalesce(b.n, 0)) AS surplus FROM flow{k} f LEFT JOIN flow{k} b ON b.shard = f.dest AND b.dest = f.shard),
share{k} AS MATERIALIZED (
  SELECT e.shard, e.dest, (n - surplus + surplus * CASE WHEN w > 0 THEN least(1.0::DOUBLE, room::DOUBLE / w::DOUBLE) ELSE 0.0::DOUBLE END) / n::DOUBLE AS share
  FROM (SELECT *, sum(surplus) OVER (PARTITION BY dest) AS w FROM extra{k}) e JOIN room{k} ON room{k}.shard = e.dest),
move{k} AS MATERIALIZED (
  SELECT block, a.shard, a.dest, m FROM ask{k} a JOIN share{k} USING (shard, dest), {t + 'n' if r == 0 else f'go{t}{r - 1}'} g
  WHERE go AND {unit(f"md5(block || '|' || a.shard || '|{k}')")} < share),
go{k} AS MATERIALIZED (SELECT coalesce(sum(m), 0) > 0 AND coalesce(sum(m), 0) * {sharding.LEAST_MOVED} >= (SELECT n FROM {t}n) AS go FROM move{k}),
{t}l{r + 1} AS MATERIALIZED (SELECT rid, block, coalesce(dest, shard) AS shard FROM {t}l{r} LEFT JOIN move{k} USING (block, shard))""")
        return out

    out = [f"""b AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS t,
         sha256(coalesce(text, '')) AS g, {unit("md5('shard|' || coalesce(doc_id::VARCHAR, 'null'))")} AS u FROM documents),
q AS MATERIALIZED (
  SELECT j::INTEGER AS shard, (SELECT count(*) FROM b) // {n} + CASE WHEN j < (SELECT count(*) FROM b) % {n} THEN 1 ELSE 0 END AS quota FROM range({n}) r(j)),
gr AS MATERIALIZED (
  SELECT g, count(*) AS members, ceil(count(*) / (SELECT greatest(2, count(*) // {n}) FROM b)::DOUBLE) AS blocks FROM b GROUP BY g HAVING count(*) > 1),
p AS MATERIALIZED (
  SELECT rid, doc_id, size, t, u, floor(u * {n})::INTEGER AS shard, coalesce(members * {sharding.BIG} > (SELECT greatest(2, count(*) // {n}) FROM b), false) AS big,
         CASE WHEN blocks IS NOT NULL THEN md5(g || '|' || floor((u * {n} - floor(u * {n})) * blocks)::BIGINT) END AS block
  FROM b LEFT JOIN gr USING (g))""",
           *phase("b", "SELECT rid, block, shard FROM p WHERE big", "q"),
           f"""lq AS MATERIALIZED (
  SELECT shard, greatest(0, quota - coalesce(n, 0)) AS quota FROM q LEFT JOIN (SELECT shard, count(*) AS n FROM bl{SQL_ROUNDS['b']} GROUP BY shard) USING (shard)),
cuts AS MATERIALIZED (
  SELECT shard AS again, sum(quota) OVER w - quota AS lo, sum(quota) OVER w AS hi, (sum(quota) OVER ())::DOUBLE AS total FROM lq WINDOW w AS (ORDER BY shard))""",
           *phase("s", "SELECT rid, block, coalesce(again, shard) AS shard FROM p LEFT JOIN cuts ON u * total >= lo AND u * total < hi WHERE block IS NOT NULL AND NOT big", "lq"),
           f"done AS MATERIALIZED (SELECT *, 0 AS kind FROM bl{SQL_ROUNDS['b']} UNION ALL SELECT *, 1 FROM sl{SQL_ROUNDS['s']})"]
    # CRC-32 by the table rule: polynomial 0xEDB88320, bytes from the hex form
    out.append(f"""tbl AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crc AS MATERIALIZED (
  SELECT rid, xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(regexp_extract_all(hex(t), '..'), lambda h: ('0x' || h)::BIGINT)),
                              lambda c, v: xor(c >> 8, tbl[(xor(c, v) & 255) + 1])), {0xFFFFFFFF}::BIGINT) AS text_crc32 FROM b, tbl)""")
    return "WITH " + ",\n".join(out) + f""",
x AS MATERIALIZED (
  SELECT p.rid, coalesce(l.shard, p.shard) AS shard,
         row_number() OVER (PARTITION BY coalesce(l.shard, p.shard) ORDER BY coalesce(l.kind, 2), u, doc_id) - 1 AS rank
  FROM p LEFT JOIN done l ON l.rid = p.rid),
over_ AS (
  SELECT rid, row_number() OVER (ORDER BY shard, rank) - 1 AS k FROM x JOIN q USING (shard) WHERE rank >= quota),
free AS (
  SELECT shard, slot, row_number() OVER (ORDER BY shard, slot) - 1 AS k FROM
   (SELECT shard, unnest(range(coalesce(n, 0), quota)) AS slot FROM q LEFT JOIN (SELECT shard, count(*) AS n FROM x GROUP BY shard) USING (shard))),
moved AS (SELECT rid, free.shard, slot FROM over_ JOIN free USING (k))
SELECT doc_id, size, text_crc32, 'rows' AS law, coalesce(moved.shard, x.shard)::INTEGER AS shard, coalesce(slot, rank)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM p JOIN x USING (rid) LEFT JOIN moved USING (rid) JOIN crc USING (rid)
"""


ORACLE_SQL["op3_sharding"] = _sql_sharding()


def _sql_repair() -> str:
    """Row by row over all conversations at once: the least (cost, audit) of
    each state of the pattern, as a string of eight digits and the audit."""
    def add(v: str, cost: str, letter: str) -> str:
        return f"lpad((substr({v}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({v}, 9) || '{letter}'"

    def role(frm: int, initial: str) -> str:
        kept = f"CASE WHEN c = '{initial}' THEN {add(f'v{frm}', 'stay', 'K')} END"
        return kept if initial == "s" else f"{kept}, CASE WHEN c <> 'd' THEN {add(f'v{frm}', 'stay + 1', 'R')} END"

    ways = {0: "", 1: role(0, "s"), 2: ", ".join(role(f, "u") for f in (0, 1, 3)), 3: role(2, "a")}
    step = ", ".join(f"least({add(f'v{t}', '2', 'D')}{', ' if w else ''}{w}) AS v{t}" for t, w in ways.items())
    two = f"least(v2, {add('v0', '5', 'I')}, {add('v1', '5', 'I')}, {add('v3', '5', 'I')})"
    return f"""
WITH RECURSIVE tbl AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (
  SELECT raw.*, xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(regexp_extract_all(hex(k), '..'), lambda h: ('0x' || h)::BIGINT)),
                                lambda c, v: xor(c >> 8, tbl[(xor(c, v) & 255) + 1])), {0xFFFFFFFF}::BIGINT) % 20 AS f FROM raw, tbl),
after AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM after),
judged AS MATERIALIZED (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
faults AS MATERIALIZED (
  SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM judged),
conv AS MATERIALIZED (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list(CASE WHEN blank OR dup THEN 'd' ELSE initial END ORDER BY i) AS codes,
         list(CASE WHEN cut THEN 5 ELSE 0 END ORDER BY i) AS stays FROM faults GROUP BY conv_id),
dp AS (
  SELECT conv_id, 1 AS pos, codes, stays, codes[1] AS c, stays[1] AS stay, '00000000' AS v0, NULL::VARCHAR AS v1,
         {add("'00000000'", '5', 'I')} AS v2, {add(add("'00000000'", '5', 'I'), '5', 'I')} AS v3 FROM conv
  UNION ALL
  SELECT conv_id, pos + 1, codes, stays, codes[pos + 1], stays[pos + 1], v0, v1, v2, least(v3, {add('v2', '5', 'I')}) FROM
   (SELECT conv_id, pos, codes, stays, v0, v1, v3, {two} AS v2 FROM (SELECT conv_id, pos, codes, stays, {step} FROM dp WHERE pos <= len(codes)))),
won AS MATERIALIZED (
  SELECT conv_id, substr(least(v0, v3), 1, 8)::BIGINT AS cost, substr(least(v0, v3), 9) AS audit FROM dp WHERE pos = len(codes) + 1),
letters AS (
  SELECT conv_id, e, p, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM
   (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM won WHERE audit <> '')),
kept AS (
  SELECT l.conv_id, p, e, r.role, r.text, row_number() OVER w - 1 AS j,
         first_value(e = 'K' AND r.initial = 's') OVER w AS system FROM letters l
  LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND e <> 'I' WHERE e <> 'D'
  WINDOW w AS (PARTITION BY l.conv_id ORDER BY p)),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - system::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END
                             || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN conv ON conv.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL["op11_conversation_repair"] = _sql_repair()
