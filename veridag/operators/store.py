"""Sources and sinks (A): loading records, and updates that keep what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.refs import valid_rects
from ..plans.registry import operator
from ..plans.staging import shared_folder, staged
from ..sources.testbed import Library
from .bibliography import first_year, normal_doi, plain_abstract
from .programme import FACTS, REPORT, report
from .text import IS_LEGACY_SQL, LEGACY_SQL, NORMAL_SQL, normal_text, repaired

_REFS = [T.StructField(f, T.ArrayType(T.StringType())) for f in ("grounded_in", "leads_to", "corroborates", "contradicts", "answers", "discriminates", "enabled_by")]
LOC = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("rects", T.ArrayType(T.ArrayType(T.DoubleType())))])
SLICE = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), *_REFS, T.StructField("floor", T.BooleanType()), T.StructField("quote", T.StringType()), T.StructField("quote_loc", LOC)])
AUTHOR = T.StructType([T.StructField("name", T.StringType()), T.StructField("position", T.StringType()), T.StructField("corresponding", T.BooleanType())])
GROUPS = {"claims": "claim", "questions": "question", "methods": "method", "tests": "test", "capabilities": "capability"}
PAPER = T.StructType([*[T.StructField(c, T.StringType()) for c in ("title", "type", "doi", "note", "abstract", "journal")], T.StructField("year", T.IntegerType()), T.StructField("pass", T.IntegerType()), T.StructField("authors", T.ArrayType(AUTHOR)), T.StructField("tags", T.ArrayType(T.StringType())), *[T.StructField(g, T.ArrayType(SLICE)) for g in GROUPS]])
BIB = T.StructType([T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("journal", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("doi", T.StringType()), T.StructField("type", T.StringType())])
OPENALEX = "id string, doi string, title string, display_name string, publication_year int, type string, authorships array<struct<author:struct<display_name:string>,is_corresponding:boolean>>, primary_location struct<source:struct<display_name:string>>, referenced_works array<string>, abstract_inverted_index map<string,array<int>>"
CROSSREF = "DOI string, title array<string>, `container-title` array<string>, type string, issued struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>, author array<struct<family:string,given:string>>, reference array<struct<DOI:string>>, abstract string"


def with_defaults(papers: DataFrame) -> DataFrame:
    """type original, titles empty, lists empty, authors in the middle: where a record says nothing."""
    none = F.array()
    lists = {c: F.coalesce(c, none.cast(papers.schema[c].dataType)) for c in ["tags", "authors", *GROUPS] if c in papers.columns}
    out = papers.withColumns({"type": F.coalesce("type", F.lit("original")), "title": F.coalesce("title", F.lit("")), **lists})
    author = lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["position"], F.lit("middle")).alias("position"), F.coalesce(a["corresponding"], F.lit(False)).alias("corresponding"))
    return out.withColumn("authors", F.transform("authors", author))


def named(df: DataFrame, key: str, files: bool) -> DataFrame:
    """df with its records' key: the file's name where each file is a record, else what the record says."""
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.\w+$", 1)) if files else df


def records(spark: SparkSession, path: str, schema: T.StructType, key: str, files: bool) -> DataFrame:
    whole = T.StructType([T.StructField(key, T.StringType()), *schema.fields])
    return named(spark.read.schema(schema if files else whole).option("multiLine", files).json(path), key, files)


def load_papers(spark: SparkSession, path: str, files: bool = True) -> DataFrame:
    """Curated papers in JSON, a record a file or a line. One that plans tests or capabilities raises: these are an aim's."""
    raw = records(spark, path, PAPER, "ck", files).withColumn("curated", F.lit(True))
    planned = (F.coalesce(F.size("tests"), F.lit(0)) > 0) | (F.coalesce(F.size("capabilities"), F.lit(0)) > 0)
    error = F.raise_error(F.concat("ck", F.lit(": tests and capabilities belong to an aim, not a paper"))).cast("string")
    return with_defaults(raw.withColumn("ck", F.when(planned, error).otherwise(F.col("ck"))))


def load_aims(spark: SparkSession, path: str, files: bool = True) -> DataFrame:
    """Aims in JSON, like papers; their keys get the sign of aims where it is missing."""
    raw = with_defaults(records(spark, path, PAPER, "ck", files))
    return raw.withColumn("ck", F.when(F.startswith("ck", F.lit("@")), F.col("ck")).otherwise(F.concat(F.lit("@"), "ck")))


def load_stubs(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Maps of keys to bibliographic records in JSON, a map a file or a line."""
    text = spark.read.text(path, wholetext=whole)
    pairs = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), BIB))).alias("ck", "bib"))
    return pairs.select("ck", F.lit(False).alias("curated"), F.coalesce("bib.title", F.lit("")).alias("title"), F.coalesce("bib.type", F.lit("original")).alias("type"), "bib.year", "bib.doi", "bib.journal", F.transform(F.coalesce("bib.authors", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit("").alias("position"), F.lit(False).alias("corresponding"))).alias("authors"))


NODE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("leads_to", T.ArrayType(T.StringType()))])


def load_broad(spark: SparkSession, path: str, files: bool = True) -> DataFrame:
    """Broad nodes of the folders claims, questions and methods below path; the folder is the kind."""
    one = lambda folder, kind: records(spark, f"{path}/{folder}", NODE, "slug", files).select("slug", F.lit(f"broad {kind}").alias("kind"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("leads_to", F.array().cast("array<string>")).alias("leads_to"))
    return one("claims", "claim").unionByName(one("questions", "question")).unionByName(one("methods", "method"))


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics in JSON lines; an empty table where there are none."""
    schema = "slug string, title string, note string, keywords array<string>, broader array<string>"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def written(df: DataFrame, name: str = "") -> str:
    """df as JSON lines in the shared folder; the path."""
    path = f"{shared_folder(df.sparkSession)}/records-{uuid.uuid4().hex}{name}"
    df.write.json(path)
    return path


def load_openalex(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(OPENALEX).json(path)
    return raw.select(F.regexp_replace("id", "^.*/", "").alias("id"), F.lower(F.regexp_replace("doi", r"^https?://(?:dx\.)?doi\.org/", "")).alias("doi"), F.coalesce("title", "display_name", F.lit("")).alias("title"), F.col("publication_year").alias("year"), F.col("type").alias("type_raw"), F.col("primary_location.source.display_name").alias("venue"), F.transform("authorships", lambda a: F.struct(a["author"]["display_name"].alias("name"), a["is_corresponding"].alias("corresponding"))).alias("authors"), F.transform("referenced_works", lambda w: F.regexp_replace(w, "^.*/", "")).alias("referenced_works"), F.col("abstract_inverted_index").alias("index"))


def load_crossref(spark: SparkSession, path: str) -> DataFrame:
    """Works of Crossref messages: the first date that has a year, references that have a DOI, abstracts without markup."""
    raw = spark.read.schema(CROSSREF).json(path)
    first = lambda c: F.get(c, F.lit(0))
    year = first_year(*[first(first(F.col(f"`{c}`")["date-parts"])) for c in ("issued", "published-print", "published-online", "published")])
    stated = F.filter("reference", lambda r: r["DOI"].isNotNull())
    return raw.select(normal_doi(F.col("DOI")).alias("doi"), F.coalesce(first(F.col("title")), first(F.col("container-title")), F.lit("")).alias("title"), first(F.col("container-title")).alias("venue"), F.col("type").alias("type_raw"), year.alias("year"), F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"), F.transform(stated, lambda r: normal_doi(r["DOI"])).alias("referenced_dois"), plain_abstract(F.col("abstract")).alias("abstract"))


def flat_slices(papers: DataFrame) -> DataFrame:
    """(ck, ord, kind, id, ...) of papers with slice lists, claims, questions, methods, tests, capabilities in order."""
    lists = [F.transform(g, (lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))(kind)) for g, kind in GROUPS.items() if g in papers.columns]
    return papers.select("ck", F.posexplode(F.concat(*lists)).alias("ord", "x")).select("ck", "ord", "x.kind", "x.s.*")


def nested(slices: DataFrame, order: str) -> DataFrame:
    """(ck, claims, questions, ...): slices as lists of records by group."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(order, "id")))), lambda s: F.struct(s["id"].alias("id")))
    return slices.groupBy("ck").agg(*[of(kind).alias(group) for group, kind in GROUPS.items()])


@operator("A1_load_papers", "select ck, id, kind from tb_slices")
def papers_from_records(lib: Library) -> DataFrame:
    """Papers written as nested records with a key that no one knows, loaded and flattened."""
    path = written(nested(lib.slices, "ln").withColumn("unknown_key", F.lit(1)))
    return flat_slices(load_papers(lib.spark, path, files=False)).select("ck", "id", "kind")


@operator("A2_load_stubs", "select ck, title, year from tb_papers where not curated")
def stubs_from_map(lib: Library) -> DataFrame:
    path = f"{shared_folder(lib.spark)}/stubs-{uuid.uuid4().hex}"
    lib.papers.where("not curated").select(F.to_json(F.create_map("ck", F.struct("title", "year"))).alias("value")).write.text(path)
    return load_stubs(lib.spark, path, whole=False).select("ck", "title", "year")


@operator("A3_load_broad", "select slug, kind, leads_to from tb_broad")
def broad_by_folder(lib: Library) -> DataFrame:
    base = f"{shared_folder(lib.spark)}/broad-{uuid.uuid4().hex}"
    up = F.when(F.col("leads_to").isNotNull(), F.array("leads_to")).alias("leads_to")
    for folder in ("claims", "questions", "methods"):
        lib.broad.where(F.col("kind") == f"broad {folder[:-1]}").select("slug", up).write.json(f"{base}/{folder}")
    return load_broad(lib.spark, base, files=False).select("slug", "kind", F.explode_outer("leads_to").alias("leads_to"))


@operator("A4_load_aims", "select ck, id, kind from tb_aim_slices")
def aims(lib: Library) -> DataFrame:
    """Aims written without their sign, loaded and flattened."""
    bare = nested(lib.aim_slices.withColumn("ck", F.regexp_replace("ck", "^@", "")), "n")
    return flat_slices(load_aims(lib.spark, written(bare), files=False)).select("ck", "id", "kind")


@operator("A5_load_topics", "select slug, broader, keyword from tb_topics")
def topic_table(lib: Library) -> DataFrame:
    one = lambda c, name: F.when(F.col(c).isNotNull(), F.array(c)).alias(name)
    path = written(lib.topics.select("slug", one("broader", "broader"), one("keyword", "keywords")))
    return load_topics(lib.spark, path).select("slug", F.explode_outer("broader").alias("broader"), "keywords").select("slug", "broader", F.explode_outer("keywords").alias("keyword"))


@operator("A6_load_narratives", "select author as grant_, coalesce(year, 0) as sec_title, ck as text, row_number() over (partition by author, coalesce(year, 0) order by ck) - 1 as bul_no from tb_papers")
def narrative_bullets(lib: Library) -> DataFrame:
    """Grants as nested sections and bullets, exploded twice."""
    p = lib.papers.select(F.col("author").alias("grant_"), F.coalesce("year", F.lit(0)).alias("title"), "ck")
    sections = p.groupBy("grant_", "title").agg(F.array_sort(F.collect_list("ck")).alias("bullets"))
    grants = sections.groupBy("grant_").agg(F.array_sort(F.collect_list(F.struct("title", "bullets"))).alias("sections"))
    s = grants.select("grant_", F.posexplode("sections").alias("sec_no", "s"))
    return s.select("grant_", F.col("s.title").alias("sec_title"), F.posexplode("s.bullets").alias("bul_no", "text")).withColumn("bul_no", F.col("bul_no").cast("long"))


@operator("A11_keys_in_use", "select ck, concat('10.1/', cast(okey as string)) as doi from tb_papers")
def keys_in_use(lib: Library) -> DataFrame:
    """Every key with its DOI; a stub wins where both have one."""
    p = lib.papers.select("ck", F.concat(F.lit("10.1/"), F.col("okey").cast("string")).alias("doi"), "curated")
    return p.groupBy("ck").agg(F.min_by("doi", "curated").alias("doi"))


def write_new(existing: DataFrame, new: DataFrame, key: str = "ck", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """existing with new rows, and (key, outcome) of each new row: written, or refused where its key exists; with force replaced."""
    known = existing.select(key, F.lit(True).alias("known"))
    asked = new.join(known.hint("shuffle_merge"), key, "left")
    outcome = asked.select(key, F.when(F.col("known").isNull(), "written").otherwise("replaced" if force else "refused").alias("outcome"))
    if force:
        return existing.join(new.select(key).hint("shuffle_merge"), key, "left_anti").unionByName(new), outcome
    return existing.unionByName(asked.where("known is null").select(*existing.columns)), outcome


@operator("A14_write_curated", """
select p.ck, case when okey % 6 = 3 then 'new' else segment end as v, case when okey % 6 = 0 then 'refused' when okey % 6 = 3 then 'replaced' end as outcome from tb_papers p
union all select concat('New', substr(ck, 4)), 'new', 'written' from tb_papers where okey % 6 in (1, 4) order by 1""")
def write_curated(lib: Library) -> DataFrame:
    """Records before and after two writes: one that refuses keys in use, and one that replaces them."""
    old = lib.papers.select("ck", "okey", F.col("segment").alias("v"))
    fresh = old.where("okey % 6 in (1, 4)").withColumn("ck", F.concat(F.lit("New"), F.substring("ck", 4, 100)))
    new = lambda df: df.withColumn("v", F.lit("new"))
    first, told = write_new(old, new(fresh.where("okey % 6 = 1").unionByName(old.where("okey % 6 = 0"))))
    second, more = write_new(first, new(fresh.where("okey % 6 = 4").unionByName(old.where("okey % 6 = 3"))), force=True)
    return second.join(told.unionByName(more).hint("shuffle_merge"), "ck", "left").select("ck", "v", "outcome")


@operator("A15_merge_stubs", "select ck, curated or okey % 2 = 0 as known from tb_papers where not curated or okey % 5 = 0")
def merge_stubs(lib: Library) -> DataFrame:
    """Offered stubs with whether they were known: among stubs (even orders here) or curated papers. The first of a key counts."""
    offered = lib.papers.where("not curated or okey % 5 = 0").select("ck").withColumn("k", F.lit(1)).dropDuplicates(["ck"])
    known = lib.papers.where("curated").select("ck").union(lib.papers.where("not curated and okey % 2 = 0").select("ck")).withColumn("known", F.lit(True))
    return offered.join(known.distinct(), "ck", "left").select("ck", F.coalesce("known", F.lit(False)).alias("known"))


@operator("A16_prune_stubs", "select ck from tb_papers where okey % 2 = 0 and not curated")
def prune_stubs(lib: Library) -> DataFrame:
    return lib.papers.where("okey % 2 = 0").select("ck").join(lib.papers.where("curated").select("ck"), "ck", "left_anti")


def write_locations(slices: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """slices(ck, id, ...) with page and rects of places(ck, id, page, rects) where they are valid, and (ck, written, skipped): how
    many were written in each container, and how many name no slice of it or no place on a page."""
    named = places.join(slices.select("ck", "id", F.lit(True).alias("known")).hint("shuffle_merge"), ["ck", "id"], "left")
    fine = F.col("known").isNotNull() & F.coalesce(F.col("page") >= 0, F.lit(False)) & valid_rects(F.col("rects"))
    told = named.groupBy("ck").agg(F.count_if(fine).alias("written"), F.count_if(~fine).alias("skipped"))
    put = named.where(fine).select("ck", "id", "page", "rects")
    return slices.join(put.hint("shuffle_merge"), ["ck", "id"], "left"), told


def located_quotes(lib: Library) -> tuple[DataFrame, DataFrame]:
    """Stored places written to quotes: those of even documents as c1's, those of odd ones under an id that nothing has."""
    id_ = F.when(F.substring("ck", 4, 8).cast("int") % 2 == 0, "c1").otherwise("zz")
    return write_locations(lib.quotes.select("ck", "id"), lib.places.select("ck", id_.alias("id"), "page", "rects"))


PLACED_SQL = "pl as (select p.ck, p.page, count(r.ln) as n, coalesce(bool_and(a0 between 0 and 1 and a1 between 0 and 1 and b0 between 0 and 1 and b1 between 0 and 1), false) as inside from tb_places p left join tb_rects r on r.ck = p.ck group by p.ck, p.page)"


@operator("A17_quote_locations", f"with {PLACED_SQL} select q.ck, q.id, case when fine then page end as page, case when fine then n end as rects from tb_quotes q left join (select *, page is not null and inside as fine from pl where cast(substr(ck, 4) as int) % 2 = 0) p on p.ck = q.ck and q.id = 'c1'")
def quote_locations(lib: Library) -> DataFrame:
    """Pages and rectangles put on quotes; unknown ids are passed over."""
    return located_quotes(lib)[0].select("ck", "id", F.col("page").cast("long").alias("page"), F.when(F.col("rects").isNotNull(), F.size("rects")).cast("long").alias("rects"))


@operator("A17_locations_written", f"with {PLACED_SQL} select ck, cast(sum(case when page is not null and inside and cast(substr(ck, 4) as int) % 2 = 0 then 1 else 0 end) as bigint) as written, cast(sum(case when page is not null and inside and cast(substr(ck, 4) as int) % 2 = 0 then 0 else 1 end) as bigint) as skipped from pl group by ck")
def locations_written(lib: Library) -> DataFrame:
    return located_quotes(lib)[1]


def add_tags(tags: Column, new: Column) -> Column:
    return F.concat(tags, F.array_except(new, tags))


def drop_tags(tags: Column, drop: Column) -> Column:
    return F.filter(tags, lambda t: ~F.array_contains(drop, t))


@operator("A18_tags", "select ck, case when segment = 'BUILDING' then concat('n', cast(nkey as string), ',new') else concat('n', cast(nkey as string), ',', segment, ',new') end as tags from tb_papers")
def tags(lib: Library) -> DataFrame:
    t = add_tags(F.array(F.concat(F.lit("n"), F.col("nkey").cast("string")), F.col("segment")), F.array(F.lit("new"), F.col("segment")))
    return lib.papers.select("ck", F.array_join(drop_tags(t, F.array(F.lit("BUILDING"))), ",").alias("tags"))


@operator("A19_fill_abstracts", "select ck, case when okey % 2 = 0 then title else 'new' end as abstract from tb_papers")
def fill_abstracts(lib: Library) -> DataFrame:
    p = lib.papers.withColumn("abstract", F.when(F.col("okey") % 2 == 0, F.col("title")).when(F.col("okey") % 3 == 0, "  "))
    return p.select("ck", F.when(F.trim(F.coalesce("abstract", F.lit(""))) == "", "new").otherwise(F.col("abstract")).alias("abstract"))


# A report's sections in order, their headings and notes.
SECTIONS = {
    "assumptions": ("load-bearing assumptions", "ranked by blast radius — what you rely on with no test"),
    "speculation": ("speculation", "no evidence, no test"),
    "at_risk": ("tests at risk", "a capability is claimed but not evidenced"),
    "aspirational": ("aspirational capabilities", ""),
    "open_questions": ("open questions", ""),
    "orphans": ("orphans", "nothing points at these"),
}
HEADS_SQL = " union all ".join(f"select '{s}' as section, '  {h} (' as head, ')' || '{' — ' + n if n else ''}' as note" for s, (h, n) in SECTIONS.items())


@operator("A20_report_table", f"""
with recursive {FACTS}, lines as (select section, row_number() over (partition by section order by weight desc, node) as rank, concat('    ', node, case when detail = '' then '' else concat('  [', detail, ']') end) as line from ({REPORT}) x)
select section, rank, line from lines union all select h.section, 0, concat(head, cast(n as string), note) from ({HEADS_SQL}) h join (select section, count(*) as n from lines group by section) k on k.section = h.section""")
def report_table(lib: Library) -> DataFrame:
    """The programme's report as lines: a heading with its count, and a line for each finding; empty sections have none."""
    r = report(lib)
    tail = F.when(F.col("detail") == "", "").otherwise(F.concat(F.lit("  ["), "detail", F.lit("]")))
    lines = r.select("section", "rank", F.concat(F.lit("    "), "node", tail).alias("line"))
    n = r.groupBy("section").agg(F.count("*").cast("string").alias("n"))
    head = lambda s, h, note: F.when(F.col("section") == s, F.concat(F.lit(f"  {h} ("), "n", F.lit(")" + (f" — {note}" if note else ""))))
    heads = n.select("section", F.lit(0).cast("long").alias("rank"), F.coalesce(*[head(s, *x) for s, x in SECTIONS.items()]).alias("line"))
    return heads.unionByName(lines)


@operator("A7_fulltext", f"select ck, length({NORMAL_SQL.replace('__text', f'(case when {IS_LEGACY_SQL} then {LEGACY_SQL} else text end)')}) as n from tb_raw")
def full_texts(lib: Library) -> DataFrame:
    """Full texts, repaired and normalised, by length."""
    return lib.raw.select("ck", F.length(normal_text(repaired(F.col("text")))).cast("long").alias("n"))


@operator("A8_openalex_works", "select doi, title, year, venue, author from tb_works")
def openalex_works(lib: Library) -> DataFrame:
    """Works written as a dump of OpenAlex records, and loaded."""
    name = lambda c: F.struct(F.col(c).alias("display_name"))
    path = written(lib.works.select(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.array(F.struct(name("author").alias("author"), F.lit(True).alias("is_corresponding"))).alias("authorships"), F.struct(name("venue").alias("source")).alias("primary_location")))
    return load_openalex(lib.spark, path).select("doi", "title", "year", "venue", F.col("authors")[0]["name"].alias("author"))


@operator("A9_crossref_works", "select doi, title, year, venue, author from tb_works")
def crossref_works(lib: Library) -> DataFrame:
    """Works written as a dump of Crossref messages, and loaded; the year stands in one of four dates."""
    date = lambda k: F.struct(F.array(F.array(F.when(F.col("seq") % 4 == k, F.col("year")))).alias("date-parts"))
    dates = [date(k).alias(c) for k, c in enumerate(("issued", "published-print", "published-online", "published"))]
    path = written(lib.works.select(F.upper("doi").alias("DOI"), F.array("title").alias("title"), F.array("venue").alias("container-title"), *dates, F.array(F.struct(F.col("author").alias("family"))).alias("author")))
    return load_crossref(lib.spark, path).select("doi", "title", "year", "venue", F.col("authors")[0].alias("author"))


@operator("A10_page_words", "select ck, page, count(*) as n, max(t) as last from (select concat('Doc', lpad(cast(doc_id as string), 8, '0')) as ck, unnest(string_split_regex(text, '[ \\n]+')) as t, (generate_subscripts(string_split_regex(text, '[ \\n]+'), 1) - 1) // 200 as page from documents) w where t <> '' group by ck, page")
def page_word_table(lib: Library) -> DataFrame:
    """Words in reading order without control characters; blank ones are dropped."""
    w = lib.page_words.withColumn("t", F.regexp_replace("t", r"\p{Cc}", "")).where(F.trim("t") != "")
    return w.groupBy(F.col("ck"), F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"), F.max("t").alias("last"))
