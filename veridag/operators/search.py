"""Library search, facets and names (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import GRAM, bucket_of, postings_of
from ..functions.refs import fold_ascii
from ..plans.registry import operator
from ..plans.staging import parted
from ..sources.testbed import Library
from .graph import landing_order, ranks

BLOB = "select p.*, lower(concat_ws(' ', ck, title, author, journal, cast(year as string))) as blob, substr(ck, 12) as token from tb_papers p where okey % 7 <> 0"


def index(lib: Library) -> DataFrame:
    """Papers with a lower-cased text to search in and the venue token of their key; those of the work list are left out."""
    listed = lib.papers.where("okey % 7 = 0").select("ck")
    blob = F.lower(F.concat_ws(" ", "ck", "title", "author", "journal", F.col("year").cast("string")))
    return lib.papers.join(listed, "ck", "left_anti").withColumn("blob", blob).withColumn("token", venue_token_of_key(F.col("ck")))


def venue_token_of_key(ck: Column) -> Column:
    token = F.regexp_extract(ck, r"\d{4}([A-Za-z][A-Za-z0-9]*)$", 1)
    return F.when(token != "", token)


def holds_all(blob: Column, terms: list[str]) -> Column:
    """Every term stands somewhere in blob."""
    return F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(blob, t)) if terms else F.lit(True)


def gram_table(blobs: DataFrame) -> DataFrame:
    """(bucket, gram, ck) of blobs(ck, blob): each paper under the grams of three characters that its blob has, in folders by a
    hash of the gram and sorted by it."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("blob") - GRAM + 1, F.lit(1))), lambda i: F.substring("blob", i, GRAM)))
    each = blobs.select(F.explode(grams).alias("gram"), "ck").select(bucket_of("gram").alias("bucket"), "gram", "ck")
    return parted(each.repartition("bucket").sortWithinPartitions("gram", "ck"), "bucket")


def grams_of_blobs(lib: Library) -> DataFrame:
    if "_grams" not in lib.__dict__:
        lib._grams = gram_table(index(lib))
    return lib._grams


def found(blobs: DataFrame, grams: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of blobs(ck, blob, ...) that hold every term. Papers that have all grams of all terms come from the gram table, of
    which only those grams are read; their blobs are then searched for the terms. Without a term of three characters all are."""
    wanted = sorted({t[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if wanted:
        have = postings_of(grams, wanted).groupBy("ck").agg(F.count("*").alias("k")).where(F.col("k") == len(wanted)).select("ck")
        blobs = blobs.join(have.hint("shuffle_merge"), "ck", "left_semi")
    return blobs.where(holds_all(F.col("blob"), terms))


@operator("J1_search_index", f"select ck, blob from ({BLOB}) b")
def search_index(lib: Library) -> DataFrame:
    return index(lib).select("ck", "blob")


@operator("J2_search", f"select ck, greatest(count(*) over () - 12, 0) as more from ({BLOB}) b where strpos(blob, 'order') > 0 and strpos(blob, '1995') > 0 order by curated desc, case when curated then coalesce(pass, -1) else 0 end desc, coalesce(year, 0) desc, ck limit 12")
def search(lib: Library, query: str = "Order 1995", first: int = 12) -> DataFrame:
    """The first hits of all terms, curated papers first, and how many more there are beyond them; none below."""
    hits = found(index(lib), grams_of_blobs(lib), query.lower().split())
    n = hits.agg(F.count("*").alias("n"))  # one row
    return hits.orderBy(*landing_order(hits)).limit(first).join(F.broadcast(n)).select("ck", F.greatest(F.col("n") - first, F.lit(0)).alias("more"))


@operator("J3_topic_search", f"select ck from ({BLOB}) b where curated and nkey in (select cast(substr(keyword, 2) as int) from tb_topics where broader = 'reg-2')")
def topic_search(lib: Library, topic: str = "reg-2") -> DataFrame:
    from .outline import papers_in

    return index(lib).join(papers_in(lib).where(F.col("slug") == topic), "ck", "left_semi").select("ck")


PASS = f"select *, curated as p_scope, token = 'BUIL' as p_token, nkey % 5 = 1 as p_nation, strpos(blob, 'order') > 0 as p_terms from ({BLOB}) b"


def passes(lib: Library, token: str = "BUIL") -> DataFrame:
    """The index with a flag for each filter."""
    return index(lib).withColumns({"p_scope": F.col("curated"), "p_token": F.col("token") == token, "p_nation": F.col("nkey") % 5 == 1, "p_terms": holds_all(F.col("blob"), ["order"])})


@operator("J4_filtered", f"select ck from ({PASS}) x where p_scope and p_token and p_nation and p_terms")
def filtered(lib: Library) -> DataFrame:
    return passes(lib).where("p_scope and p_token and p_nation and p_terms").select("ck")


FACETS = f"select 'journal' as facet, token as value, count(*) as n from ({PASS}) x where p_scope and p_nation and p_terms and token <> '' group by token union all select 'nation', cast(nkey as string), count(*) from ({PASS}) y where p_scope and p_token and p_terms group by nkey"


@operator("J5_facet_counts", FACETS)
def facet_counts(lib: Library) -> DataFrame:
    """Counts of each facet's values under the other filters, its own lifted, in one scan."""
    values = F.array(F.struct(F.lit("journal").alias("facet"), F.col("token").alias("value"), F.expr("p_scope and p_nation and p_terms and token is not null").alias("in")), F.struct(F.lit("nation").alias("facet"), F.col("nkey").cast("string").alias("value"), F.expr("p_scope and p_token and p_terms").alias("in")))
    return passes(lib).select(F.explode(values).alias("v")).where("v.in").groupBy("v.facet", "v.value").agg(F.count("*").alias("n"))


@operator("J6_ranked_facet", f"select * from (select facet, value, n, row_number() over (partition by facet order by n desc, value) as pos from ({FACETS}) f) r where pos <= 3 or value = '9'")
def ranked_facet(lib: Library, most: int = 3, pinned: str = "9") -> DataFrame:
    """The first values of each facet, by count and name, and the selected one wherever it stands."""
    r = facet_counts(lib).withColumn("pos", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")).cast("long"))
    return r.where((F.col("pos") <= most) | (F.col("value") == pinned))


# Particles that belong to a family name.
PARTICLES = ["van", "von", "de", "der", "den", "du", "del", "della", "di", "da", "dos", "la", "le", "ter", "ten"]


def author_id(name: Column) -> Column:
    """family|initial, accents and case folded: "Family, Given", or the last word with the particles before it, of which the
    first word is none. Null for an empty name."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(name, "[\u2010-\u2015]", "-"), r"\s+", " "))
    comma = F.contains(flat, F.lit(","))
    pattern = rf"(?i)^(\S+(?: \S+)*?) ((?:(?:{'|'.join(PARTICLES)})\.? )*\S+)$"
    several = flat.rlike(pattern)
    family = F.when(comma, F.trim(F.split(flat, ",", 2)[0])).when(several, F.regexp_extract(flat, pattern, 2)).otherwise(flat)
    given = F.when(comma, F.trim(F.split(flat, ",", 2)[1])).when(several, F.regexp_extract(flat, pattern, 1)).otherwise("")
    fold = lambda c: F.lower(fold_ascii(c))
    return F.when(family != "", F.concat_ws("|", fold(family), fold(F.regexp_extract(given, "[A-Za-z\u00c0-\u024f]", 0))))


@operator("J7_author_id", """
select c_custkey, case c_custkey % 5 when 0 then concat('den b', w, '|j') when 1 then concat('dos s', w, '|a') when 2 then concat('o''simek', w, '|k') when 3 then concat('beethoven-', w, '|') else concat('der b', w, '|v') end as id
from (select c_custkey, translate(cast(c_custkey as string), '0123456789', 'abcdefghij') as w from customer) c""")
def author_ids(lib: Library) -> DataFrame:
    c = lib.given("customer").select("c_custkey", F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij").alias("w"))
    forms = [F.concat(F.lit(a), "w", F.lit(b)) for a, b in (("Jan den  B", ""), ("Anna Maria dos S", ""), ("O'Šimek", ", Karel"), ("Beethoven\u2011", ""), ("van der B", ""))]
    return c.select("c_custkey", author_id(F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int"))).alias("id"))


@operator("J8_distinct_authors", "select distinct segment as ck, author as id from tb_papers")
def distinct_authors(lib: Library) -> DataFrame:
    return lib.papers.select(F.col("segment").alias("ck"), F.explode(F.array("author", "author")).alias("id")).dropDuplicates(["ck", "id"])


@operator("J9_venue_token", "select ck, substr(ck, 12) as token from tb_papers")
def venue_tokens(lib: Library) -> DataFrame:
    return lib.papers.select("ck", venue_token_of_key(F.col("ck")).alias("token"))


@operator("J10_venue_names", "select token, journal from (select token, journal, row_number() over (partition by token order by count(*) desc, length(journal), journal) as r from (select substr(ck, 12) as token, journal from tb_papers where not curated) s group by token, journal) x where r = 1")
def venue_names(lib: Library) -> DataFrame:
    """A token's most frequent spelling among stubs; the shortest of equals."""
    s = lib.papers.where("not curated").select(venue_token_of_key(F.col("ck")).alias("token"), "journal")
    n = s.groupBy("token", "journal").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), F.length("journal"), "journal"))).where("r = 1").select("token", "journal")


@operator("J11_sorts", """
select a.ck, a.pos as by_pass, b.pos as by_year, c.pos as by_title from (select ck, row_number() over (order by curated desc, case when curated then coalesce(pass, -1) else 0 end desc, coalesce(year, 0) desc, ck) as pos from tb_papers) a
join (select ck, row_number() over (order by coalesce(year, 0) desc, title, ck) as pos from tb_papers) b on b.ck = a.ck join (select ck, row_number() over (order by title, ck) as pos from tb_papers) c on c.ck = a.ck""")
def sorts(lib: Library) -> DataFrame:
    """The three orders of a list: as it lands, by falling year, by title."""
    p = lib.papers
    place = lambda order, name: ranks(p, order, name).select("ck", name)
    return place(landing_order(p), "by_pass").join(place([F.coalesce("year", F.lit(0)).desc(), F.col("title"), F.col("ck")], "by_year"), "ck").join(place([F.col("title"), F.col("ck")], "by_title"), "ck")


@operator("J12_n_of_m", f"select count(*) filter (where p_scope and p_token) as n, count(*) as m from ({PASS}) x")
def n_of_m(lib: Library) -> DataFrame:
    return passes(lib).agg(F.count_if(F.expr("p_scope and p_token")).alias("n"), F.count("*").alias("m"))


def byline(names: Column, corresponding: Column) -> Column:
    """All names, or of six and more the first and the corresponding one (or the last) around an ellipsis."""
    last = F.coalesce(corresponding, F.element_at(names, -1))
    return F.when(F.size(names) >= 6, F.concat_ws(" · ", names[0], F.lit("…"), last)).otherwise(F.array_join(names, " · "))


@operator("J13_byline", """
with a as (select distinct segment, nkey, author from tb_papers), c as (select segment, nkey, min(author) as corr from tb_papers where okey % 7 = 3 group by segment, nkey), g as (select segment, nkey, count(*) as n, min(author) as first, max(author) as last, string_agg(author, ' · ' order by author) as all_ from a group by segment, nkey)
select g.segment, g.nkey, case when n >= 6 then concat(first, ' · … · ', coalesce(corr, last)) else all_ end as line from g left join c on c.segment = g.segment and c.nkey = g.nkey""")
def bylines(lib: Library) -> DataFrame:
    """The authors of each segment and nation. A long list keeps its ends alone, which are minima and maxima; only the first six
    names, enough to tell that it is long, are gathered."""
    each = lib.papers.groupBy("segment", "nkey", "author").agg(F.bool_or(F.col("okey") % 7 == 3).alias("corr"))
    few = each.withColumn("r", F.row_number().over(Window.partitionBy("segment", "nkey").orderBy("author"))).where("r <= 6")
    names = few.groupBy("segment", "nkey").agg(F.array_sort(F.collect_list("author")).alias("names"))
    ends = each.groupBy("segment", "nkey").agg(F.max("author").alias("last"), F.min(F.when(F.col("corr"), F.col("author"))).alias("corr"))
    return names.join(ends.hint("shuffle_merge"), ["segment", "nkey"]).select("segment", "nkey", byline(F.col("names"), F.coalesce("corr", "last")).alias("line"))
