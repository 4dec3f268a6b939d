"""Personal data (operator 12): patterns propose spans, checksums confirm them, words nearby move their scores. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values. Possessive forms of the plain patterns, with the same matches: what follows a part never takes back what it
#: took, and a match can begin only where its first run of symbols does, or where the match before ended.
EMAIL = r"(?:[A-Za-z0-9._%+-](?<![A-Za-z0-9._%+-]{2})|\G[A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}+"
CARD = r"[0-9](?<![0-9][\x20-]?[0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What the method adds: a card's number among digits that go on, account numbers, and numbers that only their context tells.
CARD_PART = r"[0-9]{4}(?<![A-Za-z0-9][0-9]{4})(?:[0-9]{9,15}|(?:[\x20-][0-9]{4}){3})(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?<![A-Za-z0-9][A-Z]{2}[0-9]{2})(?:\x20?[A-Z0-9]){11,30}+"
SSN = r"(?!000|666|9)[0-9]{3}-(?<![0-9-][0-9]{3}-)(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
ROUTING = r"[0-9]{9}(?<![A-Za-z0-9.-][0-9]{9})(?![A-Za-z0-9.-])"
#: A sign without which there is no match.
SIGNS = {EMAIL: "@", IP: ".", PHONE: "+", SSN: "-"}
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2}+|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2}+|)){3}$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6)"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CR CH HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV NI", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing")
#: By kind: the score of a bare match, and what a confirming checksum adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.2, "phone": 0.6, "iban": 0.3, "ssn": 0.35, "routing": 0.1}
CHECKED = {"email": 0.0, "ip": 0.0, "card": 0.4, "phone": 0.0, "iban": 0.6, "ssn": 0.0, "routing": 0.2}
FOR_IT, AGAINST, NEAR, LEAST = 0.25, -0.25, 50, 0.5
#: Words that speak for a kind, and those that speak against numbers of any kind.
CONTEXT = {
    "email": "e-?mails?|mail|contact|reply|from|correo|courriel",
    "ip": "ip|ips|address|addr|host|server|client|login|dirección|adresse",
    "card": "card|cards|visa|mastercard|amex|credit|debit|payment|tarjeta|carte|karte|kreditkarte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|teléfono|téléphone|telefon|handy",
    "iban": "iban|account|bank|transfer|cuenta|compte|konto|überweisung",
    "ssn": "ssn|social|security|taxpayer",
    "routing": "routing|aba|transit|bank|wire",
}
OTHERWISE = "version|isbn|issn|order|invoice|serial|model|build|sku|ticket|reference"
SPAN = "array<struct<start:int,end:int,kind:int,base:boolean,value:string,near:string>>"
BLOCK = 256  # matches whose offsets are added up together


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def offsets(sizes: Column) -> Column:
    """The sum of all sizes before each, in two levels, so that no list is copied once for each of its elements."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    before = lambda xs, low: F.aggregate(xs, F.struct(low.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    firsts = lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = let(sizes, lambda s: F.transform(firsts(s), lambda i: F.slice(s, i, F.lit(BLOCK))))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, total), F.lit(0)), before)))


def proposed(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Spans of a pattern's matches with their values, and what stands up to NEAR code points before and behind, as far as the next match."""
    split = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    sizes = lambda x: F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m))
    parts = let(split, lambda x: F.arrays_zip(offsets(sizes(x)).alias("at"), F.slice(x["g"], F.lit(1), F.size(x["m"])).alias("g"), x["m"].alias("m"), F.slice(x["g"], F.lit(2), F.size(x["m"])).alias("h")))
    near = lambda x: F.concat(F.right(x["g"], F.lit(NEAR)), F.lit(" "), F.left(x["h"], F.lit(NEAR)))
    low = lambda x: x["at"] + F.length(x["g"])
    spans = F.transform(parts, lambda x: F.struct(low(x).alias("start"), (low(x) + F.length(x["m"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), x["m"].alias("value"), near(x).alias("near")))
    some = F.contains(text, F.lit(SIGNS[pattern])) & text.rlike(pattern) if pattern in SIGNS else text.rlike(pattern)
    return F.when(some, spans).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


def iban_length(value: Column) -> Column:
    lengths = F.create_map(*(F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)))
    return F.try_element_at(lengths, F.left(value, F.lit(2)))


def iban_of(value: Column) -> Column:
    """As much of a match as its country's account numbers are long; null where that ends inside a word, or the country has none."""
    n = iban_length(value)
    return F.when(n.isNotNull(), F.regexp_substr(value, F.concat(F.lit(r"^(?:[A-Z0-9]\x20?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Z0-9])"))))


def mod_97(value: Column) -> Column:
    """Whether an account number, its first four symbols last and letters as 10 to 35, is 1 modulo 97."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.left(flat, F.lit(4)))
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(code(c) >= 65, (a * 100 + code(c) - 55) % 97).otherwise((a * 10 + code(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def routing_sum(value: Column) -> Column:
    """Whether a bank's number, its digits weighted by 3, 7 and 1 in turn, is 0 modulo 10."""
    d = lambda i: F.substring(value, i + 1, 1).cast("int")
    return sum((d(i) * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0)) % 10 == 0


def score(s: Column, kind: str) -> Column:
    """From 0 to 1 for a span that passed its kind's checks: the kind's prior, its checksum's share, and the share of words nearby."""
    words = lambda w: rf"(?iu)(?<![\p{{L}}0-9])(?:{w})(?![\p{{L}}0-9])"
    moved = F.lit(PRIOR[kind] + CHECKED[kind]) + F.when(s["near"].rlike(words(CONTEXT[kind])), FOR_IT).otherwise(0.0) + F.when(s["near"].rlike(words(OTHERWISE)), AGAINST).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 2)


def scored(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["base"], s["value"], score(s, kind).alias("score")))


def personal_spans(docs: DataFrame, carry: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The column `carry` of docs(text, ...) with spans: array of start, end (code points, end exclusive), kind (place in KINDS),
    base, value and score, by kind and start.

    Base spans are those of the four plain patterns that pass their own conditions (parts up to 255, 16 to 19 digits with a
    Luhn sum, 8 to 15 digits): they stay whatever their score. Others are added if their score is `least` or more: cards of 13
    to 19 digits that stand among more digits, with an issuer's first digits and a Luhn sum; account numbers of their country's
    length, right modulo 97; social security and routing numbers, which need a word nearby that speaks for them. Spans of two
    kinds may overlap; an added card never overlaps a base card. A null text has no spans, an empty table gives an empty one,
    repeated rows are scanned each for itself, and other columns are left out. One pass without a shuffle; no pattern goes back
    over a long run of symbols, so a text's time grows with its length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = {
        "email": proposed(text, EMAIL, "email", True),
        "ip": F.filter(proposed(text, IP, "ip", True), lambda s: s["value"].rlike(OCTETS)),
        "card": F.filter(proposed(text, CARD, "card", True), lambda s: luhn(s["value"])),
        "phone": F.filter(proposed(text, PHONE, "phone", True), lambda s: F.length(digits(s["value"])).between(8, 15)),
        "part": F.filter(proposed(text, CARD_PART, "card", False), lambda s: luhn(s["value"]) & digits(s["value"]).rlike(ISSUERS)),
        "iban": proposed(text, IBAN, "iban", False),
        "ssn": proposed(text, SSN, "ssn", False),
        "routing": F.filter(proposed(text, ROUTING, "routing", False), lambda s: routing_sum(s["value"])),
    }
    cut = lambda s: F.struct(s["start"], (s["start"] + F.length(iban_of(s["value"]))).alias("end"), s["kind"], s["base"], iban_of(s["value"]).alias("value"), s["near"])
    named["iban"] = F.filter(F.transform(named["iban"], cut), lambda s: s["value"].isNotNull() & F.coalesce(mod_97(s["value"]), F.lit(False)))

    def all_spans(x: Column) -> Column:
        alone = lambda s: ~F.exists(x["card"], lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"]))
        base = [scored(x[k], k) for k in ("email", "ip", "card", "phone")]
        more = [F.filter(scored(spans, k), lambda s: s["score"] >= least) for spans, k in ((F.filter(x["part"], alone), "card"), (x["iban"], "iban"), (x["ssn"], "ssn"), (x["routing"], "routing"))]
        order = lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"], s["value"], s["score"])
        return F.transform(F.array_sort(F.transform(F.concat(*base, *more), order)), lambda s: F.struct(s["start"], s["end"], s["kind"], s["base"], s["value"], s["score"]))

    return docs.select(carry, let(F.struct(*(spans.alias(k) for k, spans in named.items())), all_spans).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, as they stand."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("own", F.filter("spans", lambda s: s["base"]))
    n = lambda kind: F.size(F.filter("own", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return out.select("doc_id", *(n(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")), F.sha2(joined(F.col("own")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
