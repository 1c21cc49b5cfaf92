"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is DataFrame functions on the JVM. Spans are code-point offsets, end exclusive, leftmost and
non-overlapping within a kind. The patterns use possessive quantifiers and anchors at the start of a run, so a long run
that matches nothing is scanned once and no match recurses.

Edge cases: a null text is empty and gives no span; an empty table gives an empty result; rows that repeat give one
result each; further columns of the input are kept by ``detect`` and dropped by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an IBAN by country; a number of these ends there, whatever follows. Others are taken as far as they go,
#: but not beyond what looks like the start of another.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_KNOWN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
#: The look ahead spares most places in a text the countries one by one.
_IBAN = rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_IBAN_KNOWN})(?![A-Z0-9])|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20[A-Z]{{2}}[0-9]{{2}})\x20?[A-Z0-9]){{11,30}})"
#: kind -> (pattern, score of a confirmed match, context words). Base kinds come first and always stay.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|tel|call|mobile"),
    "iban": (_IBAN, 0.8, r"iban|account|bank"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, r"ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS, CONTEXT_BONUS, KEEP_SCORE = 40, 0.2, 0.5
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN, _CHUNK = "array<struct<start:int,end:int,hit:string>>", 128


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit): the text between matches gives the offsets. Matches are added up in chunks of _CHUNK, as an
    array that grows by one costs its whole length each time."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    whole = F.filter(pairs, lambda x: x["hit"].isNotNull())
    parts = F.transform(F.array(whole), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(_CHUNK)), lambda i: F.slice(w, i + 1, _CHUNK)))[0]
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """The remainder of ISO 7064: the first four characters go last, letters count from A = 10."""
    code = F.regexp_replace(hit, r"\x20", "")
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.ascii(c).cast("int")
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(value(c) < 58, (r * 10 + value(c) - 48) % 97).otherwise((r * 100 + value(c) - 55) % 97))


def _confirmed(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "ip": hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(n.between(16, 19), F.call_function("luhn_check", _digits(hit))).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
        "iban": F.when(F.length(F.regexp_replace(hit, r"\x20", "")).between(15, 34), _mod97(hit) == 1).otherwise(F.lit(False)),
    }.get(kind, F.lit(True))


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii_spans: array of (kind, start, end, score), by kind in the order of PATTERNS, then by start."""
    raw = {k: f"__pii_{k}" for k in PATTERNS}
    whole = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumns({raw[k]: _located(whole, p) for k, (p, _, _) in PATTERNS.items()})

    def spans(kind: str) -> Column:
        _, score, words = PATTERNS[kind]

        def scored(x: Column) -> Column:
            left = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
            near = F.lower(F.concat(F.substring(whole, left + 1, x["start"] - left), F.lit(" "), F.substring(whole, x["end"] + 1, F.lit(CONTEXT_CHARS))))
            total = F.lit(score) + F.when(near.rlike(words), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(F.least(total, F.lit(1.0)), 2).alias("score"))

        out = F.transform(F.filter(F.col(raw[kind]), lambda x: _confirmed(kind, x["hit"])), scored)
        return out if kind in BASE else F.filter(out, lambda x: x["score"] >= KEEP_SCORE)

    return found.withColumn("pii_spans", F.concat(*map(spans, PATTERNS))).drop(*raw.values())


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of pii_spans by [KIND]; of spans that overlap, the one that starts first stands."""
    order = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.coalesce(F.col(text), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, put).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return df.withColumn(text, clean)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    spans = detect(docs.select("doc_id", "text"))
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
