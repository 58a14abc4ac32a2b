"""Personal data: patterns propose spans, checksums confirm them, nearby
context words adjust a score. DataFrame operations only.

A pattern's matches come from ``regexp_extract_all`` and the gaps between them
from ``split`` with the same pattern; lengths of gaps and matches, summed up,
are the positions in code points. Patterns carry possessive quantifiers and
start either at the border of their character class or where the last match
ended (``\\G``): the matches of the plain leftmost search, in linear time also
on long runs of one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The four base patterns, in the order in which kinds are listed.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds. Country code, check digits and 11 to 30 more; three groups of a social security number; a
# ten-digit number without country code.
# An IBAN is proposed by its country code; group 1 is what may follow, looked at but not consumed, so that neighbours
# propose theirs.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}(?=([0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))"
IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
#: Registered lengths of IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"

#: kind: (rank in the listing, pattern, cheap condition on the text, score without context, context words)
KINDS = {
    "email": (0, EMAIL, "contains(t, '@')", 0.9, "e-?mail|mail|contact|write to"),
    "ip": (1, IP, "contains(t, '.')", 0.6, "ip|host|server|address|login"),
    "card": (2, CARD, "true", 0.8, "card|visa|mastercard|credit|payment|karte|tarjeta|carte"),
    "phone": (3, PHONE, "contains(t, '+')", 0.7, "phone|tel|call|mobile|fax|whatsapp"),
    "iban": (4, IBAN, "true", 0.8, "iban|account|bank|konto|cuenta|compte"),
    "ssn": (5, SSN, "contains(t, '-')", 0.3, "ssn|social security|taxpayer"),
    "local_phone": (6, LOCAL, "true", 0.3, "phone|tel|call|mobile|fax|whatsapp"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Code points of context on either side, what a context word adds, and the score an added span needs.
CONTEXT, CONTEXT_BONUS, MIN_SCORE = 40, 0.3, 0.5

_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
# Luhn: from the right, every second digit doubled, its digits summed
_LUHN = (f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + "
         f"int(int(substring({_DIGITS}, -i, 1)) * (2 - i % 2) / 10) + (int(substring({_DIGITS}, -i, 1)) * (2 - i % 2) % 10)"
         f") % 10 = 0")
# mod-97: the first four characters go last, letters count 10 to 35, the remainder is 1
_IBAN = "regexp_replace(x.m, ' ', '')"
_MOD97 = (f"aggregate(split(concat(substring({_IBAN}, 5), substring({_IBAN}, 1, 4)), '(?<=.)(?=.)'), 0, (s, c) -> "
          "if(c <= '9', (s * 10 + int(c)) % 97, (s * 100 + ascii(c) - 55) % 97)) = 1")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": "true",
    "ip": f"x.m rlike r'^{_PART}(?:[.]{_PART}){{3}}$'",
    "card": f"if(length({_DIGITS}) between 14 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 10 and 15",
    "iban": f"if(length({_IBAN}) between 15 and 34, {_MOD97}, false)",
    "ssn": "x.m rlike r'^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'",
    "local_phone": "true",
}


def _sql_text(s: str) -> str:
    return "r'" + s + "'"


def _iban_spans() -> str:
    """Spans of IBANs, confirmed: of each proposal the words that make up the
    country's length, else the whole run; none inside the one before."""
    size = " ".join(f"when m_iban[i] in ({', '.join(repr(c) for c in codes.split())}) then '{n - 1}'" for n, codes in IBAN_LENGTHS.items())
    line = "concat(m_iban[i], r_iban[i])"
    fixed = f"regexp_extract({line}, concat(r'^[A-Z0-9](?:\x20?[A-Z0-9]){{', case {size} end, r'}}(?![A-Za-z0-9])'), 0)"
    run = f"regexp_extract({line}, {_sql_text(IBAN_RUN)}, 0)"
    picked = (f"transform(sequence(0, size(m_iban) - 1), i -> named_struct('i', i, 'm', coalesce(get(filter(array("
              f"named_struct('m', coalesce({fixed}, '')), named_struct('m', {run})), x -> {VALID['iban']}), 0).m, '')))")
    # p: end of the last code, e: end of the last IBAN; context on the left begins behind it
    at = "acc.p + length(g_iban[z.i])"
    return (f"aggregate({picked}, "
            f"named_struct('p', 0, 'e', 0, 'a', cast(array() as array<struct<s:int,m:string,b:string,n:string>>)), "
            f"(acc, z) -> named_struct('p', {at} + 2, 'e', if(z.m != '' and {at} >= acc.e, {at} + length(z.m), acc.e), "
            f"'a', if(z.m != '' and {at} >= acc.e, concat(acc.a, array(named_struct('s', {at}, 'm', z.m, "
            f"'b', right(substring(g_iban[z.i], greatest(acc.e - acc.p, 0) + 1), {CONTEXT}), "
            f"'n', substring(g_iban[z.i + 1], length(z.m) - 1, {CONTEXT})))), acc.a)), acc -> acc.a)")


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, spans (array of start, rank, end, kind,
    score; code points, end exclusive; ordered by start, then kind).

    Base kinds whose check holds are always in; an added kind (iban, ssn,
    local_phone) needs ``MIN_SCORE`` after context and must not overlap a
    base span. Null texts count as empty; a text without personal data has
    an empty array; repeated rows give repeated rows.
    """
    df = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    df = df.select("*", *[F.expr(f"if({cheap}, regexp_extract_all(t, {_sql_text(p)}, 0), array())").alias(f"m_{k}")
                          for k, (_, p, cheap, _, _) in KINDS.items()],
                   F.expr(f"regexp_extract_all(t, {_sql_text(IBAN)}, 1)").alias("r_iban"))
    df = df.select("*", *[F.expr(f"if(size(m_{k}) > 0, split(t, {_sql_text(p)}, -1), array())").alias(f"g_{k}")
                          for k, (_, p, _, _, _) in KINDS.items()]).drop("t")
    found = []
    for k, (rank, _, _, score, words) in KINDS.items():
        hit = f"(?i)(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"
        spans = (f"aggregate(sequence(0, size(m_{k}) - 1), "
                 f"named_struct('p', 0, 'a', cast(array() as array<struct<s:int,m:string,b:string,n:string>>)), "
                 f"(acc, i) -> named_struct('p', acc.p + length(g_{k}[i]) + length(m_{k}[i]), 'a', concat(acc.a, array("
                 f"named_struct('s', acc.p + length(g_{k}[i]), 'm', m_{k}[i], 'b', right(g_{k}[i], {CONTEXT}), "
                 f"'n', left(g_{k}[i + 1], {CONTEXT}))))), acc -> acc.a)")
        checked = _iban_spans() if k == "iban" else f"filter({spans}, x -> {VALID[k]})"
        scored = (f"transform({checked}, x -> named_struct('start', x.s, 'rank', {rank}, "
                  f"'end', x.s + length(x.m), 'kind', '{k}', 'score', least(1.0D, {score}D + if("
                  f"x.b rlike {_sql_text(hit)} or x.n rlike {_sql_text(hit)}, {CONTEXT_BONUS}D, 0.0D))))")
        empty = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string,score:double>>)"
        found.append(F.expr(f"if(size(m_{k}) > 0, {scored}, {empty})").alias(f"f_{k}"))
    df = df.select("doc_id", *found)
    base = "concat(" + ", ".join(f"f_{k}" for k in BASE_KINDS) + ")"
    more = "concat(" + ", ".join(f"f_{k}" for k in KINDS if k not in BASE_KINDS) + ")"
    df = df.select("doc_id", F.expr(base).alias("base"), F.expr(more).alias("more"))
    return df.select("doc_id", F.expr(
        f"if(size(base) + size(more) = 0, base, sort_array(concat(base, filter(more, x -> x.score >= {MIN_SCORE}D and "
        "not exists(base, y -> y.start < x.end and x.start < y.end)))))").alias("spans"))


def pii_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The digest of ``find_pii``: counts per base kind, the SHA-256 of the
    base spans, all spans and their scores as strings; edge rows as in
    ``find_pii``. Very long texts are searched whole; spans that start
    together come in the order of their kinds; other columns are left
    aside."""
    def joined(arr: str) -> str:
        return f"array_join(transform({arr}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(spans, x -> x.rank < " + str(len(BASE_KINDS)) + ")"
    found = find_pii(docs, text, doc_id)
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(joined(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
        F.expr("array_join(transform(spans, x -> cast(round(x.score, 2) as string)), ',')").alias("scores"))
