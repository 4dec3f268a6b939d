"""Secret scan (operator 3): patterns, and a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, stored, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"  # maximal runs: the same as longer ones of [0-9a-f]+
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
#: The symbols of each encoding in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS = 8  # cells of the chi-squared test; each holds an eighth of the alphabet
LENGTHS = (24, 32, 48, 64, 128)  # lengths from which another family of tests begins
STEPS = 400  # steps of 0.05 in -ln p, in which p-values are counted
SPAN = "array<struct<start:int,end:int,rank:int,value:string>>"


def found(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches, leftmost first: their texts, and the texts between them, give the offsets."""
    match, other = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(match.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)).alias("g"), other.alias("v"))
    span = lambda low, x: F.struct(low.alias("start"), (low + F.length(x["m"])).alias("end"), F.lit(rank).alias("rank"), x["v"].alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    step = lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.when(F.length(x["v"]) >= least, F.array_append(a["out"], span(a["at"] + F.length(x["g"]), x))).otherwise(a["out"]).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    order = lambda s: F.struct(s["start"], s["rank"], s["end"])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def tail(z: Column) -> Column:
    """P(Z > z) for a normal Z, by the logistic approximation; its error is below 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def randomness(runs: DataFrame) -> DataFrame:
    """Adds n, p of runs(value): the encoding is inferred from the symbols, then three tests ask whether they are random.

    chi-squared uniformity over eight cells of the alphabet (by the cube-root approximation), the number of runs above and
    below the alphabet's middle, and the lag-one serial correlation. p is three times the least of the three, at most 1.
    """
    body = F.regexp_replace(F.translate("value", "-_", "+/"), "=+$", "")
    which = F.when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    letters = F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv))[which]
    df = runs.withColumn("body", F.regexp_replace(body, "=", "")).withColumn("abc", letters)
    df = df.withColumn("wide", F.length("abc").cast("double")).withColumn("codes", F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: F.call_function("instr", F.col("abc"), c).cast("double") - 1))
    df = df.withColumn("n", F.size("codes").cast("double")).where("n >= 16")
    cells = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.size(F.filter("codes", lambda c: F.floor(c * BINS / F.col("wide")) == b)).cast("double"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    chi = total(cells, lambda o: (o - F.col("n") / BINS) * (o - F.col("n") / BINS)) * BINS / F.col("n")
    freedom = BINS - 1.0
    z_chi = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / (2 / (9 * freedom)) ** 0.5
    pairs = F.arrays_zip(F.slice("codes", F.lit(1), F.size("codes") - 1).alias("a"), F.slice("codes", F.lit(2), F.size("codes") - 1).alias("b"))
    df = df.withColumn("mean", (F.col("wide") - 1) / 2)
    high = total(F.col("codes"), lambda c: (c > F.col("mean")).cast("double"))
    df = df.withColumn("z_chi", z_chi).withColumn("high", high).withColumn("runs", 1 + total(pairs, lambda x: ((x["a"] > F.col("mean")) != (x["b"] > F.col("mean"))).cast("double")))
    expected = 1 + (F.col("n") - 1) / 2
    variance = (F.col("n") - 1) / 4
    serial = total(pairs, lambda x: (x["a"] - F.col("mean")) * (x["b"] - F.col("mean"))) / ((F.col("wide") * F.col("wide") - 1) / 12)
    two = lambda z: F.least(F.lit(1.0), 2 * tail(F.abs(z)))
    p = 3 * F.least(tail(F.col("z_chi")), two((F.col("runs") - expected) / F.sqrt(variance)), two(serial / F.sqrt(F.col("n") - 1)))
    return df.withColumn("p", F.least(F.lit(1.0), p)).drop("body", "abc", "codes", "mean", "wide", "z_chi", "high", "runs")


def still_random(tested: DataFrame, rate: float) -> DataFrame:
    """Rows of tested(n, p) whose randomness isn't rejected: Benjamini and Hochberg's procedure at `rate` within each
    family of lengths, on counts of p-values in fixed steps (families x STEPS rows, whatever the input)."""
    family = sum(((F.col("n") >= x).cast("int") for x in LENGTHS), F.lit(0))
    step = F.least(F.lit(STEPS - 1), F.floor(-F.log(F.greatest("p", F.lit(1e-12))) / 0.05).cast("int"))
    rows = tested.withColumn("family", family).withColumn("step", step)
    counts = rows.groupBy("family", "step").agg(F.count("*").alias("k"))
    own = Window.partitionBy("family")
    ranked = counts.withColumn("rank", F.sum("k").over(own.orderBy(F.desc("step")))).withColumn("m", F.sum("k").over(own))
    limit = ranked.where(F.exp(-0.05 * F.col("step")) <= rate * F.col("rank") / F.col("m")).groupBy("family").agg(F.min("step").alias("limit"))
    return rows.join(F.broadcast(limit), "family", "left").where("limit is null or step < limit").drop("family", "step", "limit")


def secret_spans(docs: DataFrame, rate: float = 0.05, carry: str = "doc_id") -> DataFrame:
    """The column `carry` of docs(text, ...) with base (spans of the three patterns) and spans (these, and random runs), in code points, ends exclusive.

    Runs of 20 or more encoding symbols are tested for randomness; those that stay random are added, and base spans
    always stay. Only runs are shuffled, never texts. A null text has no spans; repeated rows are scanned each for itself;
    an empty table gives an empty one; other columns of docs are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(found(text, ASSIGN, 0, 2, 6), found(text, ACCESS, 1, 0, 20), found(text, HEX, 2, 0, 24))
    scanned = stored(docs.select(F.monotonically_increasing_id().alias("__rid"), carry, base.alias("base"), found(text, RUN, 3).alias("runs")))
    runs = scanned.select("__rid", F.explode("runs").alias("s")).select("__rid", "s", F.col("s.value").alias("value"))
    tested = stored(randomness(runs).select("__rid", "s", "n", "p"))
    kept = still_random(tested, rate).groupBy("__rid").agg(F.collect_list("s").alias("more"))
    return scanned.join(kept.hint("shuffle_merge"), "__rid", "left").select(carry, "base", F.concat("base", F.coalesce("more", F.array().cast(SPAN))).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """docs with every span in text replaced by `mark`, and n_chars that of the new text; rows without spans as they are."""
    key, place = free(docs, "__key"), free(docs, "__spans")
    held = docs.withColumn(key, F.md5(F.encode(F.concat_ws("\n", F.col("doc_id").cast("string"), F.length("text").cast("string"), "text"), "UTF-8")))
    spans = secret_spans(held.select(key, "text"), rate, key).where(F.size("spans") > 0).dropDuplicates([key])
    spans = stored(spans.select(key, F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"]))).alias(place)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.array_append(F.array_append(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"])), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    text = F.aggregate(place, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text", a["at"] + 1, F.length("text"))))
    joined_ = held.join(spans.hint("shuffle_hash"), key, "left")
    new = F.when(F.col(place).isNull(), F.col("text")).otherwise(text)
    return joined_.withColumn("text", new).withColumn("n_chars", F.when(F.col(place).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)
