"""Topics (F) and narratives (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import closure
from ..plans.registry import operator
from ..plans.staging import staged
from ..sources.testbed import Library
from .programme import FACTS, bearing

DOWN = "down(root, node) as (select slug, slug from tb_topics union select d.root, t.slug from down d join tb_topics t on t.broader = d.node)"


def below(lib: Library) -> DataFrame:
    """(root, node): every topic with itself and all under it."""
    own = lib.topics.select(F.col("slug").alias("root"), F.col("slug").alias("node"))
    steps = lib.topics.where("broader is not null").select(F.col("broader").alias("src"), F.col("slug").alias("dst"))
    return own.union(closure(own.select("node"), steps)).distinct()


def tagged(lib: Library) -> DataFrame:
    """(ck, tag) of curated papers: here the customer's nation."""
    return lib.papers.where("curated").select("ck", F.concat(F.lit("N"), "nkey").alias("tag"))


@operator("F1_topic_children", "select broader as slug, string_agg(slug, ',' order by slug) as children from tb_topics where broader is not null group by broader")
def children(lib: Library) -> DataFrame:
    return lib.topics.where("broader is not null").groupBy(F.col("broader").alias("slug")).agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("children"))


@operator("F2_topic_roots", "select slug from tb_topics where broader is null")
def roots(lib: Library) -> DataFrame:
    return lib.topics.where("broader is null").select("slug")


@operator("F3_keyword_closure", f"with recursive {DOWN} select distinct root as slug, lower(keyword) as keyword from down join tb_topics t on t.slug = node where keyword is not null")
def keyword_closure(lib: Library) -> DataFrame:
    words = lib.topics.where("keyword is not null").select(F.col("slug").alias("node"), F.lower("keyword").alias("keyword"))
    return below(lib).join(words, "node").select(F.col("root").alias("slug"), "keyword").distinct()


PAPERS_IN = f"with recursive {DOWN} select distinct root as slug, ck from down join tb_topics t on t.slug = node join tb_papers p on concat('n', cast(nkey as string)) = lower(keyword) where curated"


@operator("F4_papers_in_topic", PAPERS_IN)
def papers_in(lib: Library) -> DataFrame:
    return keyword_closure(lib).join(tagged(lib).withColumn("keyword", F.lower("tag")), "keyword").select("slug", "ck").distinct()


@operator("F5_coverage", """
with own as (select lower(keyword) as k from tb_topics where keyword is not null), tag as (select ck, concat('n', cast(nkey as string)) as k from tb_papers where curated)
select 'unfiled' as what, k as item from (select distinct k from tag except select k from own) x union all select 'dead', k from (select k from own except select k from tag) y
union all select 'stranded', ck from tag where k not in (select k from own)""")
def coverage(lib: Library) -> DataFrame:
    """Tags of no topic, keywords of no paper, and papers no topic holds, by topics' own keywords."""
    own = lib.topics.where("keyword is not null").select(F.lower("keyword").alias("k"))
    tag = tagged(lib).select("ck", F.lower("tag").alias("k"))
    row = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).alias("item"))
    return row(tag.select("k").distinct().exceptAll(own), "unfiled", "k").unionAll(row(own.select("k").subtract(tag.select("k")), "dead", "k")).unionAll(row(tag.join(own, "k", "left_anti"), "stranded", "ck"))


TALLEST = 200


@operator("F6_topic_tree", f"""
with recursive t(slug, depth, path) as (select slug, 0, slug from tb_topics where broader is null union all select c.slug, depth + 1, concat(path, '/', c.slug) from t join tb_topics c on c.broader = t.slug),
{DOWN}, n as (select root, count(distinct ck) as papers from down join tb_topics k on k.slug = node left join tb_papers p on concat('n', cast(nkey as string)) = keyword and curated group by root)
select t.slug, t.depth, row_number() over (order by path) as pos, n.papers, 1 as seen from t join n on n.root = t.slug""")
def topic_tree(lib: Library) -> DataFrame:
    """The topics in pre-order with the number of papers in each; seen counts a topic's places so far."""
    level = staged(lib.topics.where("broader is null").select("slug", F.lit(0).alias("depth"), F.col("slug").alias("path")))
    tree = level
    for _ in range(TALLEST):
        level = staged(lib.topics.join(level.select(F.col("slug").alias("broader"), "depth", "path"), "broader").select("slug", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "slug").alias("path")))
        if level.isEmpty():
            break
        tree = tree.unionByName(level)
    else:
        raise RuntimeError(f"a cycle of topics, or a tree of more than {TALLEST} levels")
    n = papers_in(lib).groupBy("slug").agg(F.count("*").alias("papers"))
    out = tree.join(n, "slug", "left").na.fill(0, ["papers"])
    return out.select("slug", "depth", F.row_number().over(Window.orderBy("path")).cast("long").alias("pos"), "papers", F.row_number().over(Window.partitionBy("slug").orderBy("path")).alias("seen"))


@operator("F7_topic_payload", f"with recursive {DOWN} select root as slug, count(distinct t.keyword) as keywords, count(distinct ck) as papers, bool_or(r.broader is null) as is_root from down join tb_topics t on t.slug = node left join tb_papers p on concat('n', cast(nkey as string)) = t.keyword and curated join tb_topics r on r.slug = root group by root")
def topic_payload(lib: Library) -> DataFrame:
    words = keyword_closure(lib).groupBy("slug").agg(F.count("*").alias("keywords"))
    n = papers_in(lib).groupBy("slug").agg(F.count("*").alias("papers"))
    return lib.topics.select("slug", F.col("broader").isNull().alias("is_root")).join(words, "slug", "left").join(n, "slug", "left").na.fill(0)


@operator("F8_leaves_by_root", f"with recursive {DOWN} select root as heading, node as leaf, row_number() over (partition by root order by node) as pos from down where root in (select slug from tb_topics where broader is null) and node not in (select broader from tb_topics where broader is not null)")
def leaves_by_root(lib: Library) -> DataFrame:
    b = below(lib).join(roots(lib).withColumnRenamed("slug", "root"), "root", "left_semi")
    leaves = b.join(lib.topics.select(F.col("broader").alias("node")), "node", "left_anti")
    return leaves.select(F.col("root").alias("heading"), F.col("node").alias("leaf"), F.row_number().over(Window.partitionBy("root").orderBy("node")).cast("long").alias("pos"))


@operator("F9_topics_of_paper", PAPERS_IN.replace("select distinct root as slug, ck", "select ck, string_agg(distinct root, ',' order by root) as topics") + " group by ck")
def topics_of_paper(lib: Library) -> DataFrame:
    return papers_in(lib).groupBy("ck").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("topics"))


# -- narratives: a grant for each customer, a section for each year, a bullet for each order, backed by what its lines cite


BULLETS = """bul as (select ck, okey, author as grant_, coalesce(year, 0) as sec, row_number() over (partition by author, coalesce(year, 0) order by ck) - 1 as b, dense_rank() over (partition by author order by coalesce(year, 0)) - 1 as s from tb_papers),
refs as (select bul.*, dst as ref from bul join tb_links l on l.ck = bul.ck and l.field = 'grounded_in' and l.form in ('container', 'sharpened'))"""


def bullets(lib: Library) -> DataFrame:
    """(ck, grant, s, b, refs): narratives as sections and bullets, with what backs each."""
    refs = lib.links.where("field = 'grounded_in' and form in ('container', 'sharpened')").groupBy("ck").agg(F.array_sort(F.collect_list("dst")).alias("refs"))
    sec = F.coalesce("year", F.lit(0))
    p = lib.papers.select("ck", F.col("author").alias("grant_"), sec.alias("sec"))
    w = Window.partitionBy("grant_")
    return p.join(refs, "ck", "left").select("ck", "grant_", (F.dense_rank().over(w.orderBy("sec")) - 1).alias("s"), (F.row_number().over(Window.partitionBy("grant_", "sec").orderBy("ck")) - 1).alias("b"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


@operator("G1_bullet_slices", f"with {BULLETS} select grant_, concat('s', cast(s as string), 'b', cast(b as string)) as id, count(ref) as n_edges, count(ref) filter (where strpos(ref, ':') > 0) as sharp from (select bul.grant_, bul.s, bul.b, bul.ck, ref from bul left join refs on refs.ck = bul.ck) x group by grant_, s, b")
def bullet_slices(lib: Library) -> DataFrame:
    b = bullets(lib)
    return b.select("grant_", F.format_string("s%db%d", "s", "b").alias("id"), F.size("refs").cast("long").alias("n_edges"), F.size(F.filter("refs", lambda r: F.contains(r, F.lit(":")))).cast("long").alias("sharp"))


@operator("G2_unbacked_bullets", f"with {BULLETS} select grant_, s, b from bul where ck not in (select ck from refs)")
def unbacked(lib: Library) -> DataFrame:
    return bullets(lib).where(F.size("refs") == 0).select("grant_", F.col("s").cast("long"), F.col("b").cast("long"))


@operator("G3_first_cited_order", f"with {BULLETS}, f as (select grant_, split_part(ref, ':', 1) as key, min(row(s, b)) as at_ from refs group by all) select grant_, key, row_number() over (partition by grant_ order by at_, key) as pos from f")
def first_cited(lib: Library) -> DataFrame:
    """What a narrative cites, in the order of first citation."""
    cited = bullets(lib).select("grant_", F.struct("s", "b").alias("at"), F.explode("refs").alias("ref")).groupBy("grant_", F.split("ref", ":")[0].alias("key")).agg(F.min("at").alias("at"))
    return cited.select("grant_", "key", F.row_number().over(Window.partitionBy("grant_").orderBy("at", "key")).cast("long").alias("pos"))


@operator("G4_uncovered_bearing", f"with recursive {FACTS} select ck, id from bearing b where not exists (select 1 from tb_named n where n.ref = b.node)")
def uncovered(lib: Library) -> DataFrame:
    """Load-bearing assumptions that no bullet names."""
    return bearing(lib).join(lib.named.select(F.col("ref").alias("node")).hint("shuffle_merge"), "node", "left_anti").select("ck", "id")
