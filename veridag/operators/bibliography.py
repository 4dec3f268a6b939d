"""Bibliographic reconciliation (M)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.refs import fold_ascii, work_type
from ..plans.registry import operator
from ..plans.staging import staged
from ..sources.testbed import Library
from .graph import ranks_within
from .text import MARKS_SQL, marked


def from_inverted_index(works: DataFrame, key: str = "doi") -> DataFrame:
    """(key, abstract) of works(key, index map<word, positions>)."""
    words = works.select(key, F.explode("index").alias("word", "places")).select(key, "word", F.explode("places").alias("place"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"])
    return words.groupBy(key).agg(F.array_join(ordered, " ").alias("abstract"))


@operator("M1_abstracts", "select doc_id, array_to_string(string_split_regex(text, '[ \\n]+'), ' ') as abstract from documents")
def abstracts(lib: Library) -> DataFrame:
    """Each document as an inverted index of its words, and back."""
    words = lib.given("documents").select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("place", "word"))
    inverted = words.groupBy("doc_id", "word").agg(F.collect_list("place").alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return from_inverted_index(inverted, "doc_id")


def normal_doi(c: Column) -> Column:
    """Without resolver or prefix, lower-cased; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"(?i)^\s*(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))), F.lit(""))


@operator("M2_normal_doi", "select seq, lower(doi) as doi from tb_works")
def normal_dois(lib: Library) -> DataFrame:
    raw = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://doi.org/"), F.upper("doi"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("DOI: "), "doi")).otherwise(F.col("doi"))
    return lib.works.select("seq", normal_doi(raw).alias("doi"))


def split_name(name: Column) -> Column:
    """(given, family): the last word is the family name."""
    words = F.split(F.trim(name), r"\s+")
    return F.struct(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("given"), F.element_at(words, -1).alias("family"))


@operator("M3_split_name", """
select distinct venue, author, array_to_string(list_slice(w, 1, len(w) - 1), ' ') as given, w[len(w)] as family from (select venue, author, string_split_regex(concat(venue, ' ', author), '\\s+') as w from tb_works) x""")
def split_names(lib: Library) -> DataFrame:
    n = split_name(F.concat_ws(" ", "venue", "author"))
    return lib.works.select("venue", "author", n["given"].alias("given"), n["family"].alias("family")).distinct()


def first_year(*years: Column) -> Column:
    """The first year that isn't missing; 0 counts as missing."""
    return F.coalesce(*[F.nullif(y, F.lit(0)) for y in years])


@operator("M4_year", "select ck, coalesce(year, 1900) as year from tb_papers")
def years(lib: Library) -> DataFrame:
    return lib.papers.select("ck", first_year(F.lit(0), F.col("year"), F.lit(1900)).alias("year"))


def plain_abstract(c: Column) -> Column:
    """Text of marked-up abstracts: tags and a leading label out, white space as single spaces; null if nothing is left."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    return F.nullif(F.regexp_replace(flat, r"(?i)^abstract\b[:.\s]*", ""), F.lit(""))


@operator("M5_plain_abstract", "select page_id, nullif(regexp_replace(trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '(?i)^abstract\\b[:.\\s]*', ''), '') as abstract from (select page_id, case when page_id % 3 = 0 then concat('<jats:title>ABSTRACT</jats:title>: ', html) else html end as h from pages) p")
def plain_abstracts(lib: Library) -> DataFrame:
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<jats:title>ABSTRACT</jats:title>: "), "html")).otherwise(F.col("html"))
    return lib.given("pages").select("page_id", plain_abstract(html).alias("abstract"))


def found_by_doi(want: DataFrame, openalex: DataFrame, crossref: DataFrame) -> DataFrame:
    """want(..., doi) with (seq, metadata_source) of its work: of OpenAlex, else of Crossref; others are dropped."""
    w = want.withColumn("__doi", normal_doi(F.col("doi")))
    one = lambda df, name: df.select(normal_doi(F.col("doi")).alias("__doi"), F.struct("seq", F.lit(name).alias("metadata_source")).alias(name))
    both = w.join(one(openalex, "openalex"), "__doi", "left").join(one(crossref, "crossref"), "__doi", "left")
    return both.withColumn("f", F.coalesce("openalex", "crossref")).where("f is not null").select(*want.columns, "f.*")


def focal_works(papers: DataFrame, openalex: DataFrame, crossref: DataFrame) -> DataFrame:
    """(ck, seq, doi_source, metadata_source) of papers(ck, given, printed, title): by the DOI that was given, which must
    then resolve; else by the one printed in the paper; else by its title, in OpenAlex alone."""
    given = found_by_doi(papers.where("given is not null").select("ck", F.col("given").alias("doi"), F.lit(1).alias("prio"), F.lit("given").alias("doi_source")), openalex, crossref)
    printed = found_by_doi(papers.where("given is null and printed is not null").select("ck", F.col("printed").alias("doi"), F.lit(2).alias("prio"), F.lit("pdf").alias("doi_source")), openalex, crossref)
    titles = openalex.groupBy(F.lower("title").alias("t")).agg(F.min("seq").alias("seq"))
    by_title = papers.where("given is null").join(titles, F.lower("title") == F.col("t")).select("ck", F.lit(3).alias("prio"), F.lit("title-search").alias("doi_source"), "seq", F.lit("openalex").alias("metadata_source"))
    rows = given.drop("doi").unionByName(printed.drop("doi")).unionByName(by_title)
    return rows.groupBy("ck").agg(F.min(F.struct("prio", "seq", "doi_source", "metadata_source")).alias("b")).select("ck", "b.seq", "b.doi_source", "b.metadata_source")


def openalex_part(lib: Library) -> DataFrame:
    """What one source knows: two works of three."""
    return lib.works.where("seq % 3 <> 0")


def crossref_part(lib: Library) -> DataFrame:
    """What the other knows: four of five."""
    return lib.works.where("seq % 5 <> 0")


FOCAL = """
select ck, seq, doi_source, metadata_source from (select *, row_number() over (partition by ck order by prio, seq) as r from (
  select p.ck, 1 as prio, 'given' as doi_source, w.seq, case when w.seq % 3 <> 0 then 'openalex' else 'crossref' end as metadata_source from tb_papers p join tb_works w on w.seq = p.okey where okey % 4 = 0 and (w.seq % 3 <> 0 or w.seq % 5 <> 0)
  union all select p.ck, 2, 'pdf', w.seq, case when w.seq % 3 <> 0 then 'openalex' else 'crossref' end from tb_papers p join tb_works w on w.seq = p.okey where okey % 4 = 1 and (w.seq % 3 <> 0 or w.seq % 5 <> 0)
  union all select p.ck, 3, 'title-search', w.seq, 'openalex' from tb_papers p join (select lower(title) as t, min(seq) as seq from tb_works where seq % 3 <> 0 group by 1) w on w.t = lower(p.title) where okey % 4 <> 0) c) x where r = 1"""


@operator("M6_focal_lookup", FOCAL)
def focal_lookup(lib: Library) -> DataFrame:
    """A quarter of the papers with a given DOI, a quarter with a printed one, in mixed casing."""
    doi = lambda k, prefix: F.when(F.col("okey") % 4 == k, F.concat(F.lit(prefix), F.col("okey").cast("string")))
    p = lib.papers.select("ck", doi(0, "https://doi.org/10.1000/W").alias("given"), doi(1, "10.1000/W").alias("printed"), "title")
    return focal_works(p, openalex_part(lib), crossref_part(lib))


REFS = "select distinct l.ck, p.okey as ref, q.okey as own from tb_links l join tb_papers p on p.ck = l.key join tb_papers q on q.ck = l.ck where l.field = 'grounded_in' and l.form in ('container', 'sharpened')"


def cited(lib: Library) -> DataFrame:
    """(ck, own, ref): the orders that each paper cites, and its own."""
    key = lib.papers.select(F.col("ck").alias("key"), F.col("okey").alias("ref"))
    own = lib.papers.select("ck", F.col("okey").alias("own"))
    return lib.links.where("field = 'grounded_in' and form in ('container', 'sharpened')").select("ck", "key").distinct().join(key, "key").select("ck", "ref").distinct().join(own, "ck")


def resolved_references(papers: DataFrame, ids: DataFrame, stated: DataFrame, printed: DataFrame, openalex: DataFrame, crossref: DataFrame) -> DataFrame:
    """(ck, seq, via) of papers(ck, doi): by the work ids of ids(ck, id), looked up in OpenAlex; for papers without any, by
    the DOIs of stated(ck, doi); for papers without these too, by printed(ck, doi) except the paper's own."""
    by_id = ids.join(openalex.select(F.col("seq").alias("id"), "seq"), "id").select("ck", "seq", F.lit("ids").alias("via"))
    later = stated.join(ids.select("ck").distinct(), "ck", "left_anti")
    last = printed.join(ids.select("ck").union(stated.select("ck")).distinct(), "ck", "left_anti").join(papers.select("ck", normal_doi(F.col("doi")).alias("own")), "ck", "left").where(F.col("own").isNull() | (normal_doi(F.col("doi")) != F.col("own"))).select("ck", "doi")
    doi = later.select("ck", "doi", F.lit("stated").alias("via")).unionByName(last.select("ck", "doi", F.lit("printed").alias("via")))
    return by_id.unionByName(found_by_doi(doi, openalex, crossref).select("ck", "seq", "via")).distinct()


REFERENCES = f"""
select ck, ref as seq, 'ids' as via from ({REFS}) a where own % 3 = 0 and ref % 3 <> 0
union select ck, ref, 'stated' from ({REFS}) b where own % 3 = 1 and (ref % 3 <> 0 or ref % 5 <> 0)
union select ck, ref, 'printed' from ({REFS}) c where own % 3 = 2 and ref <> own and (ref % 3 <> 0 or ref % 5 <> 0)"""


@operator("M7_references", REFERENCES)
def references(lib: Library) -> DataFrame:
    """A third of the papers with work ids, a third with stated DOIs, a third with a printed list that has their own too."""
    c = cited(lib)
    own = lib.papers.select("ck", F.concat(F.lit("10.1000/w"), F.col("okey").cast("string")).alias("doi"), "okey")
    doi = lambda prefix: F.concat(F.lit(prefix), F.col("ref").cast("string")).alias("doi")
    printed = c.where("own % 3 = 2").select("ck", doi("10.1000/W")).unionByName(own.where("okey % 3 = 2").select("ck", "doi"))
    return resolved_references(own.select("ck", "doi"), c.where("own % 3 = 0").select("ck", F.col("ref").alias("id")), c.where("own % 3 = 1").select("ck", doi("https://doi.org/10.1000/W")), printed, openalex_part(lib), crossref_part(lib))


def take_names(ours: Column, theirs: Column) -> Column:
    """The other source's names where it has as many authors."""
    return F.when(F.size(ours) == F.size(theirs), theirs).otherwise(ours)


@operator("M8_enriched_names", "select seq, case when seq % 2 = 0 then upper(author) else author end as name from tb_works")
def enriched_names(lib: Library) -> DataFrame:
    theirs = F.when(F.col("seq") % 2 == 0, F.array(F.upper("author"))).otherwise(F.array("author", "venue"))
    return lib.works.select("seq", take_names(F.array("author"), theirs)[0].alias("name"))


def author_roles(authors: DataFrame, marks: DataFrame) -> DataFrame:
    """(ck, pos, family, position, corresponding) of authors(ck, pos, family, flagged) with marks(ck, family, corresponding,
    equal): first is the first and who contributed equally, last the last of the others; corresponding is who is flagged or
    marked so. Names are compared without accents and case."""
    key = lambda c: F.trim(F.lower(fold_ascii(c)))
    m = marks.groupBy("ck", key(F.col("family")).alias("k")).agg(F.bool_or("corresponding").alias("c"), F.bool_or("equal").alias("e"))
    n = authors.groupBy("ck").agg(F.max("pos").alias("end"))
    a = authors.withColumn("k", key(F.col("family"))).join(n.hint("shuffle_merge"), "ck").join(m.hint("shuffle_merge"), ["ck", "k"], "left")
    no, named = F.lit(False), F.col("k") != ""
    first = (F.col("pos") == 0) | (named & F.coalesce("e", no))
    position = F.when(first, "first").when(F.col("pos") == F.col("end"), "last").otherwise("middle")
    return a.select("ck", "pos", "family", position.alias("position"), (F.col("flagged") | (named & F.coalesce("c", no))).alias("corresponding"))


ROLES = f"""
with mk as ({MARKS_SQL}), au as (select ck, 0 as pos, fam1 as family, false as flagged from tb_bylines union all select ck, 1, fam2, false from tb_bylines union all select ck, 2, fam3, cast(substr(ck, 4) as int) % 6 = 5 from tb_bylines)
select au.ck, pos, au.family, case when pos = 0 or equal then 'first' when pos = 2 then 'last' else 'middle' end as position, flagged or corresponding as corresponding from au join mk on mk.ck = au.ck and mk.family = au.family"""


@operator("M9_author_roles", ROLES)
def roles(lib: Library) -> DataFrame:
    """The authors of every order's byline: a source flags some last ones, and the page marks others."""
    b = lib.bylines
    flagged = F.substring("ck", 4, 20).cast("int") % 6 == 5
    names = F.array(F.struct(F.col("fam1").alias("family"), F.lit(False).alias("flagged")), F.struct(F.col("fam2").alias("family"), F.lit(False).alias("flagged")), F.struct(F.col("fam3").alias("family"), F.coalesce(flagged, F.lit(False)).alias("flagged")))
    authors = b.select("ck", F.posexplode(names).alias("pos", "a")).select("ck", "pos", "a.*")
    return author_roles(authors, marked(b.select("ck", "text", F.array("fam1", "fam2", "fam3").alias("families"))))


@operator("D10_authors", f"select family as author, count(distinct ck) as papers, string_agg(distinct position, ',' order by position) as positions, count(*) filter (where corresponding) as corresponding from ({ROLES}) r group by family")
def authors(lib: Library) -> DataFrame:
    """Authors as nodes: papers, positions and how often they correspond. A name of very many papers is combined before
    the shuffle, and has four positions at most."""
    r = roles(lib)
    one = r.groupBy("family", "ck").agg(F.collect_set("position").alias("p"), F.count_if("corresponding").alias("c"))
    return one.groupBy(F.col("family").alias("author")).agg(F.count("*").alias("papers"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))), ",").alias("positions"), F.sum("c").alias("corresponding"))


def family_token(family: Column) -> Column:
    """Words of a family name without accents, each with a capital: VanDerBerg, OBrien."""
    words = F.regexp_extract_all(fold_ascii(family), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def base_key(family: Column, year: Column, venue: Column) -> Column:
    """FamilyYearVenue; what is missing is left out."""
    return F.concat(family_token(F.coalesce(family, F.lit(""))), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(venue, F.lit("")))


FAMILIES = ["van der Berg", "O'Brien", "Wörthmüller", "Méry"]
BASE = """select doi, seq, concat(case seq % 4 when 0 then 'VanDerBerg' when 1 then 'OBrien' when 2 then 'Worthmuller' else 'Mery' end, cast(year as string), concat(upper(venue[1]), lower(substr(venue, 2, 3)))) as base from tb_works"""


def based(lib: Library) -> DataFrame:
    token = F.initcap(F.substring("venue", 1, 4))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("seq") % 4 + 1).cast("int"))
    return lib.works.select("doi", "seq", base_key(family, F.col("year"), token).alias("base"))


@operator("M10_base_key", BASE)
def base_keys(lib: Library) -> DataFrame:
    return based(lib)


# Fixed value: letters of the longest suffix; more slots than rows can be.
LETTERS = 10
#: suffix() in SQL: slots of i letters and more begin at 1 + 26 + ... + 26 ** (i - 1).
SUFFIX_SQL = "concat(" + ", ".join(f"case when k >= {(26 ** (i + 1) - 1) // 25} then chr(cast(97 + (k - {(26 ** (i + 1) - 1) // 25}) // {26**i} % 26 as int)) else '' end" for i in reversed(range(LETTERS))) + ")"


@operator("M11_disambiguated", f"select doi, concat(base, {SUFFIX_SQL}) as ck from (select doi, base, row_number() over (partition by base order by seq) - 1 as k from ({BASE}) b) x")
def disambiguated(lib: Library) -> DataFrame:
    """Distinct keys for all works: the base, then a to z, aa and so on in the order of coming."""
    return ranks_within(based(lib), "base", [F.col("seq")], "r").select("doi", F.concat("base", suffix(F.col("r") - 1)).alias("ck"))


def suffix(slot: Column) -> Column:
    """The letters of a slot of a base: none for 0, a to z for 1 to 26, then aa, ab and so on."""
    firsts = [(26 ** (i + 1) - 1) // 25 for i in range(LETTERS)]
    letters = [F.when(slot >= s, F.char((97 + F.floor((slot - s) / 26**i) % 26).cast("int"))).otherwise("") for i, s in enumerate(firsts)]
    return F.concat(*reversed(letters))


def slot_of(letters: Column) -> Column:
    """The slot whose suffix() is letters."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 96)


def free_slots(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(doi, ck) for every row of wanted(doi, base, seq), each DOI once: its key of taken(ck, doi) with the same base and
    DOI, else the next free slot of the base in the order of seq: the base itself, then a to z, aa and so on."""
    wanted = wanted.withColumn("__doi", normal_doi(F.col("doi")))
    cut = F.explode(F.sequence(F.lit(0), F.least(F.length(F.regexp_extract("ck", "[a-z]*$", 0)), F.lit(LETTERS)))).alias("n")
    parts = taken.select("ck", normal_doi(F.col("doi")).alias("__doi"), cut).selectExpr("ck", "__doi", "left(ck, length(ck) - n) as base", "right(ck, n) as letters")
    held = staged(parts.join(wanted.select("base").distinct().hint("shuffle_merge"), "base").select("base", "__doi", "ck", slot_of(F.col("letters")).alias("slot")))
    own = held.where("__doi is not null").groupBy("base", "__doi").agg(F.min_by("ck", "slot").alias("ck"))
    both = staged(wanted.join(own.hint("shuffle_merge"), ["base", "__doi"], "left").select("doi", "base", "seq", "ck"))
    # the r-th new row stands behind as many taken slots as have at most r free ones before them
    full = ranks_within(held.select("base", "slot").distinct(), "base", [F.col("slot")], "i").select("base", (F.col("slot") - F.col("i") + 1).alias("at"), F.lit(0).alias("new"), F.lit(None).cast("string").alias("doi"))
    new = ranks_within(both.where("ck is null").drop("ck"), "base", [F.col("seq")], "r").select("base", (F.col("r") - 1).alias("at"), F.lit(1).alias("new"), "doi")
    placed = ranks_within(full.unionByName(new), "base", [F.col("at"), F.col("new")], "slot").where("new = 1")
    return both.where("ck is not null").select("doi", "ck").unionByName(placed.select("doi", F.concat("base", suffix(F.col("slot") - 1)).alias("ck")))


@operator("M17_keys_kept", f"""
with b as ({BASE}), t as (select doi, base, 2 * row_number() over (partition by base order by seq) - 1 as k from b where seq % 3 = 0), o as (select doi, base, row_number() over (partition by base order by seq) - 1 as j from b where seq % 3 <> 0), n as (select base, count(*) as n from t group by base),
slots as (select doi, base, k from t union all select doi, o.base, case when j <= coalesce(n, 0) then 2 * j else coalesce(n, 0) + j end from o left join n on n.base = o.base)
select doi, concat(base, {SUFFIX_SQL}) as ck from slots""")
def keys_kept(lib: Library) -> DataFrame:
    """All works once a third of them is in the library: that third keeps its keys, the others get what is free."""
    b = based(lib)
    taken = ranks_within(b.where("seq % 3 = 0"), "base", [F.col("seq")], "r").select(F.concat("base", suffix(2 * F.col("r") - 1)).alias("ck"), "doi")
    return free_slots(b, taken)


def venue_tokens_of(venues: DataFrame, overrides: DataFrame, words: DataFrame) -> DataFrame:
    """(venue, token) of venues(venue): the token of overrides(name, token), else the venue's words as words(word, short)
    shortens them or with capitals, joined; letters and digits alone. An empty venue has an empty token."""
    name = F.trim(F.regexp_replace(F.lower("venue"), r"\s+", " "))
    v = venues.select("venue", name.alias("name")).distinct()
    parts = v.select("venue", F.posexplode(F.split("name", " ")).alias("i", "word")).join(words.hint("shuffle_merge"), "word", "left")
    piece = F.regexp_replace(F.coalesce("short", F.initcap("word")), "[^A-Za-z0-9]", "")
    joined = parts.groupBy("venue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"]), "").alias("own"))
    return v.join(overrides.hint("shuffle_merge"), "name", "left").join(joined.hint("shuffle_merge"), "venue", "left").select("venue", F.coalesce("token", "own", F.lit("")).alias("token"))


@operator("M12_venue_token", """
select venue, coalesce(o.token, own) as token from (select venue, string_agg(coalesce(short, concat(upper(word[1]), substr(word, 2))), '' order by i) as own from
  (select venue, unnest(string_split(lower(venue), ' ')) as word, generate_subscripts(string_split(lower(venue), ' '), 1) as i from tb_venues) w left join tb_venue_words using (word) group by venue) x left join tb_venue_overrides o on o.name = lower(venue)""")
def venue_tokens(lib: Library) -> DataFrame:
    return venue_tokens_of(lib.venues, lib.venue_overrides, lib.venue_words)


@operator("M13_stubs", "select doi, title, year from tb_works where seq % 4 <> 0 or seq % 3 <> 0")
def stubs(lib: Library) -> DataFrame:
    """Works as stubs; those without author and year are skipped (every fourth lacks the one, every third the other here)."""
    w = lib.works.withColumn("author", F.when(F.col("seq") % 4 != 0, F.col("author"))).withColumn("y", F.when(F.col("seq") % 3 != 0, F.col("year")))
    return w.where("author is not null or y is not null").select("doi", "title", "year")


@operator("M14_enrich_status", "select status, count(*) as n from (select case when okey % 6 = 0 then 'no_doi' when okey % 5 = 0 then 'already' when okey % 7 = 0 then 'unmatched' else 'enriched' end as status from tb_papers where not curated) x group by status")
def enrich_status(lib: Library) -> DataFrame:
    """What becomes of each stub: no DOI, already rich, unmatched or enriched."""
    s = lib.papers.where("not curated").select("okey", F.when(F.col("okey") % 6 != 0, F.concat(F.lit("10.1000/w"), F.col("okey").cast("string"))).alias("doi"), (F.col("okey") % 5 == 0).alias("rich"))
    known = lib.works.where("seq % 7 <> 0").select("doi", F.lit(1).alias("hit"))
    status = F.when(F.col("doi").isNull(), "no_doi").when(F.col("rich"), "already").when(F.col("hit").isNull(), "unmatched").otherwise("enriched")
    return s.join(known, "doi", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def keep_casing(ours: Column, theirs: Column) -> Column:
    return F.when(F.lower(ours) == F.lower(theirs), ours).otherwise(theirs)


@operator("M15_doi_casing", "select seq, case when seq % 2 = 0 then upper(doi) else doi end as doi from tb_works")
def doi_casing(lib: Library) -> DataFrame:
    ours = F.when(F.col("seq") % 2 == 0, F.upper("doi")).otherwise(F.lit("10.1/other"))
    return lib.works.select("seq", keep_casing(ours, F.col("doi")).alias("doi"))


@operator("M16_ingest_report", f"""
select 'doi_source' as what, doi_source as value, count(*) as n from ({FOCAL}) f group by doi_source union all select 'metadata_source', metadata_source, count(*) from ({FOCAL}) f group by metadata_source
union all select 'unresolved', '', count(*) from tb_papers p where not exists (select 1 from ({FOCAL}) f where f.ck = p.ck) having count(*) > 0
union all select 'references', via, count(*) from ({REFERENCES}) r group by via
union all select case when p_type in ('PROMO', 'STANDARD') then 'type' else 'type_defaulted' end, 'original', count(*) from part group by 1
union all select 'stubs', case when seq % 12 = 0 then 'skipped' else 'added' end, count(*) from tb_works group by 2""")
def ingest_report(lib: Library) -> DataFrame:
    """A run in counts: where DOIs, metadata and references come from, what has no work, types that are the default because
    the source names another, stubs added and those skipped for want of author and year.

    The counts are observed while the run's tables are written, so that none of them is read or derived again for the report.
    """
    known = F.lower("p_type").isin("promo", "standard", "article", "journal-article", "original")
    bare = (F.col("seq") % 4 == 0) & (F.col("seq") % 3 == 0)
    each = lambda what, c, values: {(what, v): F.col(c) == v for v in values}
    runs = [
        (focal_lookup(lib), each("doi_source", "doi_source", ["given", "pdf", "title-search"]) | each("metadata_source", "metadata_source", ["openalex", "crossref"]) | {("resolved", ""): F.lit(True)}),
        (references(lib), each("references", "via", ["ids", "stated", "printed"])),
        (lib.given("part").select(known.alias("known"), work_type(F.col("p_type")).alias("kind")), {("type" if k else "type_defaulted", v): (F.col("known") == k) & (F.col("kind") == v) for k in (True, False) for v in ("original", "review")}),
        (lib.works.select("doi", "seq"), {("stubs", "skipped"): bare, ("stubs", "added"): ~bare}),
        (lib.papers.select("ck"), {("unresolved", ""): F.lit(True)}),
    ]
    counts = reduce(lambda x, y: x | y, (written_with(df, wanted)[1] for df, wanted in runs))
    counts["unresolved", ""] -= counts.pop(("resolved", ""))
    return lib.spark.createDataFrame([(what, value, n) for (what, value), n in counts.items() if n], "what string, value string, n long")


def written_with(df: DataFrame, wanted: dict[tuple, Column]) -> tuple[DataFrame, dict[tuple, int]]:
    """df as a stored table, and how many of its rows meet each condition, counted in the pass that writes it."""
    seen = Observation()
    out = staged(df.observe(seen, *(F.count_if(c).alias(f"n{i}") for i, c in enumerate(wanted.values()))))
    return out, dict(zip(wanted, (seen.get[f"n{i}"] for i in range(len(wanted))), strict=True))
