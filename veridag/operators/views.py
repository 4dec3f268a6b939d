"""Graph analytics that the reading views rest on (I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import longest
from ..plans.registry import operator
from ..plans.staging import bucketed, staged
from ..sources.testbed import Library
from .graph import answered, landing_order, ranks

BROAD_FIELDS = "field in ('leads_to', 'corroborates', 'contradicts', 'answers')"


def ids(lib: Library) -> DataFrame:
    return lib.slices.select(F.concat_ws(":", "ck", "id").alias("node"), "ck", "id", "kind", "ln")


@operator("I1_broad_links", f"select ref as slug, string_agg(distinct ck, ',' order by ck) as papers from tb_links where form = 'broad' and {BROAD_FIELDS} group by ref")
def broad_links(lib: Library) -> DataFrame:
    return lib.links.where("form = 'broad'").where(BROAD_FIELDS).groupBy(F.col("ref").alias("slug")).agg(F.array_join(F.array_sort(F.collect_set("ck")), ",").alias("papers"))


@operator("I2_broad_tier", "with recursive lp(node, level) as (select slug, 0 from tb_broad union select b.leads_to, level + 1 from lp join tb_broad b on b.slug = lp.node where b.leads_to is not null) select node, max(level) as tier from lp group by node")
def broad_tier(lib: Library) -> DataFrame:
    """A broad node's height over its children, along the longest path."""
    steps = lib.broad.where("leads_to is not null").select(F.col("slug").alias("src"), F.col("leads_to").alias("dst"))
    return longest(lib.broad.select(F.col("slug").alias("node")), steps).select("node", F.col("level").alias("tier"))


HOST = "up(node, root) as (select slug, slug from tb_broad where leads_to is null union select b.slug, up.root from up join tb_broad b on b.leads_to = up.node)"


@operator("I3_family_host", f"with recursive {HOST} select b.slug as node, b.leads_to as host, root from tb_broad b join up on up.node = b.slug")
def family_host(lib: Library) -> DataFrame:
    """The first parent of each broad node, and the top of its family by pointer jumping."""
    at = staged(lib.broad.select(F.col("slug").alias("node"), F.coalesce("leads_to", "slug").alias("up")))
    for _ in range(64):  # each round doubles the steps
        new = staged(at.join(at.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        if new.exceptAll(at).isEmpty():
            break
        at = new
    else:
        raise RuntimeError("the ladder has a cycle")
    return lib.broad.select(F.col("slug").alias("node"), F.col("leads_to").alias("host")).join(at.select("node", F.col("up").alias("root")), "node")


@operator("I4_family_order", f"with recursive {HOST} select root, n, row_number() over (order by n desc, root) as pos from (select root, count(*) as n from up group by root) x")
def family_order(lib: Library) -> DataFrame:
    n = family_host(lib).groupBy("root").agg(F.count("*").alias("n"))
    return ranks(staged(n), [F.desc("n"), F.col("root")])


LOCAL = "select distinct on (l.ck, a, b) l.ck, a, b, l.kind from (select ck, src as a, ref as b, case field when 'grounded_in' then 'gen' else 'answers' end as kind, case field when 'grounded_in' then 1 else 2 end as prio from tb_links where form = 'local' and field in ('grounded_in', 'answers')) l join tb_slices t on t.ck = l.ck and t.id = l.b order by l.ck, a, b, prio"


def local_dag(lib: Library) -> DataFrame:
    """Links within a paper, one for each pair: grounds go before answers."""
    kind = F.when(F.col("field") == "grounded_in", "gen").otherwise("answers")
    x = lib.links.where("form = 'local' and field in ('grounded_in', 'answers')").select("ck", F.col("src").alias("a"), F.col("ref").alias("b"), kind.alias("kind"), (F.col("field") != "grounded_in").alias("late"))
    x = x.join(lib.slices.select("ck", F.col("id").alias("b")), ["ck", "b"], "left_semi")
    return x.groupBy("ck", "a", "b").agg(F.min_by("kind", "late").alias("kind"))


@operator("I5_local_dag", LOCAL)
def local_links(lib: Library) -> DataFrame:
    return local_dag(lib)


LEVEL = f"ld as materialized (select * from ({LOCAL}) q), lp(ck, id, level) as (select ck, id, 0 from tb_slices union select ld.ck, ld.a, level + 1 from lp join ld on ld.ck = lp.ck and ld.b = lp.id), lv as materialized (select ck, id, max(level) as level from lp group by ck, id)"


def support_levels(lib: Library) -> DataFrame:
    d = local_dag(lib).select(F.concat_ws(":", "ck", "b").alias("src"), F.concat_ws(":", "ck", "a").alias("dst"))
    return longest(ids(lib).select("node"), d)


@operator("I7_support_level", f"with recursive {LEVEL} select ck, id, level from lv")
def support_level(lib: Library) -> DataFrame:
    """The longest chain of local links below a slice."""
    return ids(lib).join(support_levels(lib), "node").select("ck", "id", "level")


@operator("I6_reading_order", f"""
with recursive {LEVEL}, b as (select s.ck, s.id, s.ln, lv.level, case when kind = 'question' and a.gid is not null then 0 when kind = 'claim' and bo.id is null then 1 when kind = 'claim' then 2 when kind = 'method' then 3 else 4 end as bucket
  from tb_slices s join lv on lv.ck = s.ck and lv.id = s.id left join tb_borrowed bo on bo.ck = s.ck and bo.id = s.id left join (select distinct dst as gid from tb_links where field = 'answers') a on a.gid = concat(s.ck, ':', s.id))
select ck, id, row_number() over (partition by ck order by level desc, bucket, ln) as pos from b""")
def reading_order(lib: Library) -> DataFrame:
    """By falling support, then answered questions, own claims, borrowed ones, methods, open questions, then as authored."""
    far = lib.links.where("field = 'grounded_in' and form in ('container', 'sharpened')").select(F.col("gid").alias("node"), F.lit(1).alias("far")).distinct()
    s = ids(lib).join(support_levels(lib), "node").join(far, "node", "left").join(answered(lib).select(F.col("gid").alias("node"), F.lit(1).alias("ans")), "node", "left")
    bucket = F.when((F.col("kind") == "question") & F.col("ans").isNotNull(), 0).when((F.col("kind") == "claim") & F.col("far").isNull(), 1).when(F.col("kind") == "claim", 2).when(F.col("kind") == "method", 3).otherwise(4)
    return s.select("ck", "id", F.row_number().over(Window.partitionBy("ck").orderBy(F.desc("level"), bucket, "ln")).cast("long").alias("pos"))


ADJ = """adj as materialized (
select distinct l.gid as a, case when s.ck is not null then l.dst else l.key end as b, 'grounds' as rel from tb_links l left join tb_slices s on concat(s.ck, ':', s.id) = l.dst join tb_papers p on p.ck = l.key where l.field = 'grounded_in'
union select l.dst, l.gid, 'builds' from tb_links l join tb_slices s on concat(s.ck, ':', s.id) = l.dst where l.field = 'grounded_in'
union select l.gid, l.ref, 'gen' from tb_links l join tb_broad b on b.slug = l.ref where l.field = 'leads_to'
union select l.gid, l.dst, 'answers' from tb_links l join tb_slices s on concat(s.ck, ':', s.id) = l.dst where l.field = 'answers'
union select x, y, rel from (select l.gid as x, l.dst as y, case l.field when 'corroborates' then 'corr' else 'contra' end as rel from tb_links l where l.field in ('corroborates', 'contradicts')
  union select l.dst, l.gid, case l.field when 'corroborates' then 'corr' else 'contra' end from tb_links l where l.field in ('corroborates', 'contradicts')) z)"""


def adjacency(lib: Library) -> DataFrame:
    """(a, b, rel): six relations, lateral ones both ways; a reference goes to the sharpest node that exists."""
    nodes = ids(lib).select(F.col("node").alias("dst"), F.lit(1).alias("is"))
    known = lib.papers.select(F.col("ck").alias("key"))
    g = lib.links.where("field = 'grounded_in'").join(nodes, "dst", "left")
    row = lambda df, a, b, rel: df.select(a.alias("a"), b.alias("b"), rel.alias("rel"))
    side = F.when(F.col("field") == "corroborates", "corr").otherwise("contra")
    lateral = lib.links.where("field in ('corroborates', 'contradicts')")
    parts = [
        row(g.join(known, "key", "left_semi"), F.col("gid"), F.when(F.col("is").isNotNull(), F.col("dst")).otherwise(F.col("key")), F.lit("grounds")),
        row(g.where("is is not null"), F.col("dst"), F.col("gid"), F.lit("builds")),
        row(lib.links.where("field = 'leads_to'").join(lib.broad.select(F.col("slug").alias("ref")), "ref", "left_semi"), F.col("gid"), F.col("ref"), F.lit("gen")),
        row(lib.links.where("field = 'answers'").join(nodes, "dst", "left_semi"), F.col("gid"), F.col("dst"), F.lit("answers")),
        row(lateral, F.col("gid"), F.col("dst"), side),
        row(lateral, F.col("dst"), F.col("gid"), side),
    ]
    return reduce(DataFrame.unionAll, parts).distinct()


@operator("I9_adjacency", f"with {ADJ} select a, b, rel from adj")
def adjacent(lib: Library) -> DataFrame:
    return adjacency(lib)


@operator("I10_relation_counts", f"with {ADJ} select a, count(*) filter (where rel = 'grounds') as grounds, count(*) filter (where rel = 'builds') as builds, count(*) filter (where rel = 'gen') as gen, count(*) filter (where rel = 'answers') as answers, count(*) filter (where rel = 'corr') as corr, count(*) filter (where rel = 'contra') as contra from adj group by a")
def relation_counts(lib: Library) -> DataFrame:
    return adjacency(lib).groupBy("a").agg(*[F.count_if(F.col("rel") == r).alias(r) for r in ("grounds", "builds", "gen", "answers", "corr", "contra")])


@operator("I11_stance", f"with {ADJ} select split_part(a, ':', 1) as node, count(*) filter (where rel = 'corr') as corr, count(*) filter (where rel = 'contra') as contra from adj where rel in ('corr', 'contra') group by 1")
def stance(lib: Library) -> DataFrame:
    """A paper's stance over its slices, a broad node's own."""
    x = adjacency(lib).where("rel in ('corr', 'contra')")
    return x.groupBy(F.split("a", ":")[0].alias("node")).agg(F.count_if(F.col("rel") == "corr").alias("corr"), F.count_if(F.col("rel") == "contra").alias("contra"))


@operator("I12_fan_out", f"with {ADJ} select split_part(a, ':', 1) as ck, count(distinct split_part(b, ':', 1)) as cards, count(*) as edges from adj group by 1")
def fan_out(lib: Library) -> DataFrame:
    return adjacency(lib).groupBy(F.split("a", ":")[0].alias("ck")).agg(F.count_distinct(F.split("b", ":")[0]).alias("cards"), F.count("*").alias("edges"))


@operator("I13_citation_wall", "select l.ck, count(distinct l.key) as wall from tb_links l where l.field = 'grounded_in' and l.form in ('container', 'sharpened') and l.key not in (select ck from tb_papers where curated) group by l.ck")
def citation_wall(lib: Library) -> DataFrame:
    """Sources a paper cites that aren't curated."""
    done = lib.papers.where("curated").select(F.col("ck").alias("key"))
    far = lib.links.where("field = 'grounded_in' and form in ('container', 'sharpened')").join(done, "key", "left_anti")
    return far.groupBy("ck").agg(F.count_distinct("key").alias("wall"))


@operator("I14_unwired", f"with {ADJ} select kind, count(*) as n, count(*) filter (where concat(ck, ':', id) not in (select a from adj)) as unwired from tb_slices group by kind")
def unwired(lib: Library) -> DataFrame:
    """Slices by kind, and those without any relation."""
    wired = adjacency(lib).select(F.col("a").alias("node"), F.lit(1).alias("w")).distinct()
    return ids(lib).join(wired, "node", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("w").isNull()).alias("unwired"))


def bounded_walk(edges: DataFrame, starts: DataFrame, depth: int = 2, wide: int = 2) -> DataFrame:
    """(start, node, depth, parent): breadth first from starts(node), at most `wide` new nodes below each (in binary order),
    first visits only."""
    level = staged(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    known = level
    for d in range(1, depth + 1):
        new = level.select("start", F.col("node").alias("parent")).join(edges.select(F.col("a").alias("parent"), F.col("b").alias("node")).distinct(), "parent").join(known.select("start", "node"), ["start", "node"], "left_anti")
        new = new.groupBy("start", "node").agg(F.min("parent").alias("parent"))
        new = new.withColumn("r", F.row_number().over(Window.partitionBy("start", "parent").orderBy("node"))).where(F.col("r") <= wide)
        level = staged(new.select("start", "node", F.lit(d).alias("depth"), "parent"))
        known = known.unionByName(level)
    return known


WALK1 = "n{k} as materialized (select start, node, {k} as depth, parent from (select start, node, parent, row_number() over (partition by start, parent order by node) as r from (select w.start, adj.b as node, min(w.node) as parent from n{j} w join adj on adj.a = w.node where w.depth = {j} and not exists (select 1 from n{j} v where v.start = w.start and v.node = adj.b) group by w.start, adj.b) x) y where r <= 2 union all select * from n{j})"


@operator("I15_bounded_walk", f"with {ADJ}, n0 as materialized (select concat(s.ck, ':', s.id) as start, concat(s.ck, ':', s.id) as node, 0 as depth, cast(null as string) as parent from tb_slices s join tb_papers p on p.ck = s.ck where okey % 50 = 0), {WALK1.format(k=1, j=0)}, {WALK1.format(k=2, j=1)} select start, node, depth, parent from n2")
def walk(lib: Library) -> DataFrame:
    starts = ids(lib).join(lib.papers.where("okey % 50 = 0").select("ck"), "ck", "left_semi")
    return bounded_walk(staged(adjacency(lib)), starts)


@operator("I16_landing_keys", "select ck from tb_papers where curated or ck in (select key from tb_links where field in ('corroborates', 'contradicts', 'answers'))")
def landing_keys(lib: Library) -> DataFrame:
    named = lib.links.where("field in ('corroborates', 'contradicts', 'answers') and key is not null").select(F.col("key").alias("ck"))
    return lib.papers.where("curated").select("ck").union(lib.papers.select("ck").join(named, "ck", "left_semi")).distinct()


@operator("I17_why_shown", "select key as ck, string_agg(distinct tid, ',' order by tid) as named from tb_links where field in ('corroborates', 'contradicts') and tid is not null group by key")
def why_shown(lib: Library) -> DataFrame:
    x = lib.links.where("field in ('corroborates', 'contradicts') and tid is not null")
    return x.groupBy(F.col("key").alias("ck")).agg(F.array_join(F.array_sort(F.collect_set("tid")), ",").alias("named"))


@operator("I18_hoisted", "select ck, row_number() over (order by first_, curated desc, case when curated then coalesce(pass, -1) else 0 end desc, coalesce(year, 0) desc, ck) as pos from (select p.*, coalesce(f.first_, 99) as first_ from tb_papers p left join (select ck, min(ln) as first_ from tb_slices where kind = 'claim' group by ck) f using (ck)) x")
def hoisted(lib: Library) -> DataFrame:
    """Papers whose claims were clicked first (a claim's line here) come first."""
    clicks = lib.slices.where("kind = 'claim'").groupBy("ck").agg(F.min("ln").alias("first_"))
    p = lib.papers.join(clicks, "ck", "left").na.fill(99, ["first_"])
    return ranks(p, [F.col("first_"), *landing_order(p)]).select("ck", "pos")


@operator("I19_top_answers", f"with recursive ld as materialized (select * from ({LOCAL}) q where kind = 'gen'), an as materialized (select ck, src as a, ref as q from tb_links where field = 'answers') select ck, a, q from an where not exists (select 1 from an b join ld on ld.ck = b.ck and ld.a = b.a and ld.b = an.a where b.ck = an.ck and b.q = an.q)")
def top_answers(lib: Library) -> DataFrame:
    """Answers to a question that no other answer to it rests on directly."""
    an = lib.links.where("field = 'answers'").select("ck", F.col("src").alias("a"), F.col("ref").alias("q"))
    rests = local_dag(lib).where("kind = 'gen'").select("ck", F.col("a").alias("top"), F.col("b").alias("a"))
    under = an.select("ck", F.col("a").alias("top"), "q").join(rests, ["ck", "top"]).select("ck", "a", "q")
    return an.join(under, ["ck", "a", "q"], "left_anti")


@operator("I20_entry_rows", "select ck, id from tb_slices s where kind = 'question' or (kind = 'claim' and not exists (select 1 from tb_links l where l.ck = s.ck and l.ref = s.id and field = 'grounded_in' and form = 'local') and not exists (select 1 from tb_links l where l.ck = s.ck and l.src = s.id and field = 'leads_to'))")
def entry_rows(lib: Library) -> DataFrame:
    """Questions, and claims that nothing in the paper rests on and that lead nowhere."""
    used = lib.links.where("field = 'grounded_in' and form = 'local'").select("ck", F.col("ref").alias("id")).union(lib.links.where("field = 'leads_to'").select("ck", "src"))
    top = lib.slices.where("kind = 'claim'").select("ck", "id").join(used, ["ck", "id"], "left_anti")
    return lib.slices.where("kind = 'question'").select("ck", "id").unionAll(top)


@operator("I21_chain_up", f"with recursive ld as materialized (select ck, b, min(a) as up from ({LOCAL}) q where kind = 'gen' group by ck, b), ch(ck, id, at_, n) as (select ck, id, id, 0 from tb_slices union all select ch.ck, ch.id, ld.up, n + 1 from ch join ld on ld.ck = ch.ck and ld.b = ch.at_ where n < 64) select ck, id, max(n) as steps, max_by(at_, n) as top from ch group by ck, id")
def chain_up(lib: Library) -> DataFrame:
    """From each slice to the row it is entered by: the first dependent (in binary order) at each step, 64 at most."""
    up = bucketed(local_dag(lib).where("kind = 'gen'").groupBy("ck", F.col("b").alias("at")).agg(F.min("a").alias("up")).select(F.concat_ws(":", "ck", "at").alias("node"), "up"), "node")
    live = lib.slices.select("ck", "id", F.col("id").alias("at"))
    done = None
    for k in range(1, 65):
        # Rows are written once a round, ended or not; those that go on are read back, and alone move to their next row's bucket.
        moved = staged(live.withColumn("node", F.concat_ws(":", "ck", "at")).hint("shuffle_merge").join(up, "node", "left").select("ck", "id", "at", "up"))
        end = moved.where("up is null").select("ck", "id", F.col("at").alias("top"), F.lit(k - 1).alias("steps"))
        done = end if done is None else done.unionByName(end)
        live = moved.where("up is not null").select("ck", "id", F.col("up").alias("at"))
        if live.isEmpty():
            return done
    return done.unionByName(live.select("ck", "id", F.col("at").alias("top"), F.lit(64).alias("steps")))
