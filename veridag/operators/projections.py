"""Projections of the graph and their depths (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import Known, bfs, closure, grow, longest
from ..plans.registry import operator
from ..plans.staging import bucketed, dropped, shared, staged
from ..sources.testbed import Library
from .graph import flags, ranks, ranks_within

PAIRS = "select distinct ck, key as target from tb_links where field = 'grounded_in' and form in ('container', 'sharpened')"


def citation_pairs(lib: Library) -> DataFrame:
    return lib.links.where("field = 'grounded_in' and form in ('container', 'sharpened')").select("ck", F.col("key").alias("target")).distinct()


@operator("K1_grounding_projection", f"select coalesce(a.node, b.node) as node, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out from (select target as node, count(*) as n_in from ({PAIRS}) p group by target) a full join (select ck as node, count(*) as n_out from ({PAIRS}) p group by ck) b on a.node = b.node")
def grounding_projection(lib: Library) -> DataFrame:
    """In and out degrees of papers over distinct citations. Where an estimate will do, sketches spare the distinct."""
    p = citation_pairs(lib)
    ends = p.select(F.explode(F.array(F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("ck").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def degree_sketches(pairs: DataFrame, batch: str) -> DataFrame:
    """(batch, node, sketch) of pairs(ck, target, batch): how many papers cite each node in a batch, as sketches that merge.

    A sketch of 2 ** 12 registers has a standard error of 1.6 % and is at most 4 KB, however often a node is cited; citations
    that come again, in any batch, don't count again."""
    return pairs.groupBy(batch, F.col("target").alias("node")).agg(F.hll_sketch_agg("ck", F.lit(12)).alias("sketch"))


def sketched_degrees(sketches: DataFrame) -> DataFrame:
    """(node, degree) over all batches of sketches(node, sketch)."""
    return sketches.groupBy("node").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("degree"))


@operator("K1_sketched_degrees", f"select target as node, count(*) as degree from ({PAIRS}) p group by target")
def merged_degrees(lib: Library) -> DataFrame:
    """In degrees from the sketches of two batches that overlap, without a distinct; exact for nodes of few citations."""
    pairs = lib.links.where("field = 'grounded_in' and form in ('container', 'sharpened')").select("ck", F.col("key").alias("target"))
    half = F.pmod(F.xxhash64("ck"), F.lit(3))
    batches = pairs.where(half < 2).withColumn("batch", F.lit(0)).unionByName(pairs.where(half > 0).withColumn("batch", F.lit(1)))
    return sketched_degrees(staged(degree_sketches(batches, "batch")))


SUPPORT = "select distinct ck, ref as slug from tb_links where form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts')"
COSUPPORT = f"select a.ck as a, b.ck as b, count(*) as weight from ({SUPPORT}) a join ({SUPPORT}) b on a.slug = b.slug and a.ck < b.ck group by a.ck, b.ck"


def supports(lib: Library) -> DataFrame:
    return lib.links.where("form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts')").select("ck", F.col("ref").alias("slug")).distinct()


@operator("K2_cosupport", COSUPPORT)
def cosupport(lib: Library) -> DataFrame:
    s = supports(lib)
    return s.select(F.col("ck").alias("a"), "slug").join(s.select(F.col("ck").alias("b"), "slug"), "slug").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


@operator("K3_off_graph", f"select ck from tb_papers where curated and ck not in (select a from ({COSUPPORT}) x union select b from ({COSUPPORT}) y)")
def off_graph(lib: Library) -> DataFrame:
    s = supports(lib)
    shared = s.groupBy("slug").agg(F.count("*").alias("k")).where("k > 1")  # no pairs are needed to see who has a partner
    return lib.papers.where("curated").select("ck").join(s.join(shared, "slug", "left_semi"), "ck", "left_anti")


@operator("K4_lateral_pairs", "select distinct least(ck, key) as a, greatest(ck, key) as b, case field when 'corroborates' then 'corr' else 'contra' end as sign from tb_links where field in ('corroborates', 'contradicts') and key is not null and key <> ck")
def lateral_pairs(lib: Library) -> DataFrame:
    x = lib.links.where("field in ('corroborates', 'contradicts') and key is not null and key <> ck")
    return x.select(F.least("ck", "key").alias("a"), F.greatest("ck", "key").alias("b"), F.when(F.col("field") == "corroborates", "corr").otherwise("contra").alias("sign")).distinct()


@operator("K5_threshold", f"select p.ck, p.target from ({PAIRS}) p join (select target from ({PAIRS}) q group by target having count(*) >= 2) t on t.target = p.target")
def threshold(lib: Library, least: int = 2) -> DataFrame:
    """Citations whose target is cited by `least` papers or more."""
    p = citation_pairs(lib)
    return p.join(p.groupBy("target").agg(F.count("*").alias("k")).where(F.col("k") >= least), "target", "left_semi").select("ck", "target")


@operator("K6_degree_radius", f"select node, d, round(sqrt(d / max(d) over ()), 6) as r from (select node, count(*) as d from (select ck as node from ({PAIRS}) p union all select target from ({PAIRS}) q) x group by node) y")
def degree_radius(lib: Library) -> DataFrame:
    d = citation_pairs(lib).select(F.explode(F.array("ck", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    most = d.agg(F.max("d").alias("most"))  # one row
    return d.join(F.broadcast(most)).select("node", "d", F.round(F.sqrt(F.col("d") / F.col("most")), 6).alias("r"))


@operator("K7_pin_neighbours", f"select distinct pin, node from (select ck as pin, target as node from ({PAIRS}) p union all select target, ck from ({PAIRS}) q) x where pin in (select ck from tb_papers where okey % 50 = 0)")
def pin_neighbours(lib: Library) -> DataFrame:
    """One step around pinned papers (every fiftieth order here)."""
    p = citation_pairs(lib)
    both = p.select(F.col("ck").alias("pin"), F.col("target").alias("node")).union(p.select("target", "ck"))
    return both.join(lib.papers.where("okey % 50 = 0").select(F.col("ck").alias("pin")), "pin", "left_semi").distinct()


@operator("K8_next_to_curate", f"select target, count(*) as n from ({PAIRS}) p where target not in (select ck from tb_papers where curated) group by target order by n desc, target limit 20")
def next_to_curate(lib: Library, most: int = 20) -> DataFrame:
    """A report: the first `most` of what isn't curated, by how many papers cite it."""
    p = citation_pairs(lib).join(lib.papers.where("curated").select(F.col("ck").alias("target")), "target", "left_anti")
    return p.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(most)


#: Typed edges of the model, with both ends resolved: a claim leads up to what it is grounded in, to broad nodes, and along the ladder.
MODEL = """
select l.gid as src, l.dst as dst, 'up' as kind from tb_links l join tb_slices t on concat(t.ck, ':', t.id) = l.dst where l.field = 'grounded_in' and l.form = 'local'
union all select l.gid, l.dst, 'cite' from tb_links l join tb_slices t on concat(t.ck, ':', t.id) = l.dst where l.field = 'grounded_in' and l.form = 'sharpened'
union all select l.gid, l.ref, 'cons' from tb_links l join tb_broad b on b.slug = l.ref where l.field = 'leads_to'
union all select l.gid, l.dst, 'lateral' from tb_links l join tb_slices t on concat(t.ck, ':', t.id) = l.dst where l.field in ('corroborates', 'contradicts')
union all select slug, leads_to, 'ladder' from tb_broad where leads_to is not null"""


def model(lib: Library) -> DataFrame:
    return shared(lib, "model", lambda: resolved(lib))


def resolved(lib: Library) -> DataFrame:
    nodes = lib.slices.select(F.concat_ws(":", "ck", "id").alias("dst")).hint("shuffle_merge")
    slugs = lib.broad.select(F.col("slug").alias("dst")).hint("shuffle_merge")
    field, form = F.col("field"), F.col("form")
    kind = F.when((field == "grounded_in") & (form == "local"), "up").when((field == "grounded_in") & (form == "sharpened"), "cite").when(field.isin("corroborates", "contradicts"), "lateral")
    edges = lib.links.select(F.col("gid").alias("src"), "dst", kind.alias("kind"), "field")
    parts = [
        edges.where("kind is not null").join(nodes, "dst", "left_semi").select("src", "dst", "kind"),
        edges.where("field = 'leads_to'").join(slugs, "dst", "left_semi").select("src", "dst", F.lit("cons").alias("kind")),
        lib.broad.where("leads_to is not null").select(F.col("slug").alias("src"), F.col("leads_to").alias("dst"), F.lit("ladder").alias("kind")),
    ]
    return reduce(DataFrame.unionAll, parts)


@operator("K9_typed_model", MODEL)
def typed_model(lib: Library) -> DataFrame:
    return model(lib)


def floors(lib: Library) -> DataFrame:
    held = lib.links.where("field = 'grounded_in' and form = 'local'").select("ck", F.col("src").alias("id"))
    methods = lib.slices.where("kind = 'method'").select("ck", "id").join(held.hint("shuffle_merge"), ["ck", "id"], "left_anti")
    return methods.unionByName(lib.slices.where("axiom").select("ck", "id")).select(F.concat_ws(":", "ck", "id").alias("node"))


def upward(lib: Library, kinds: str) -> DataFrame:
    """Edges from what is rested on to what rests on it; broad nodes rest on what leads to them."""
    m = model(lib).where(f"kind in ({kinds})")
    flip = F.col("kind").isin("up", "cite")
    return m.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def ranks_sql(kinds: str) -> str:
    return f"""with recursive m as materialized ({MODEL}), st as materialized (select distinct case when kind in ('up', 'cite') then dst else src end as src, case when kind in ('up', 'cite') then src else dst end as dst from m where kind in ({kinds})),
fl as materialized (select concat(ck, ':', id) as node from tb_floor), w(node, d) using key (node) as (select distinct node, 0 from fl union select st.dst, min(w.d) + 1 from w join st on st.src = w.node left join recurring.w k on k.node = st.dst where k.node is null group by st.dst), rk as materialized (select node, d from w)"""


WALK = "'up', 'cite', 'cons', 'ladder'"


def distances(lib: Library) -> DataFrame:
    return shared(lib, "distances", lambda: bfs(floors(lib), upward(lib, WALK)), lambda df: bucketed(df, "node"))


@operator("K10_distance_to_floor", ranks_sql(WALK) + " select node, d from rk")
def distance_to_floor(lib: Library) -> DataFrame:
    """The least number of steps from a floor, through local and cited grounds, broad nodes and the ladder."""
    return distances(lib)


NODES = "select concat(ck, ':', id) as node from tb_slices union all select slug from tb_broad"


def all_nodes(lib: Library) -> DataFrame:
    return lib.slices.select(F.concat_ws(":", "ck", "id").alias("node")).unionAll(lib.broad.select("slug"))


@operator("K11_unfloored", ranks_sql(WALK) + f" select node from ({NODES}) n where node not in (select node from rk)")
def unfloored(lib: Library) -> DataFrame:
    return all_nodes(lib).join(distances(lib).hint("shuffle_merge"), "node", "left_anti")


@operator("K12_unfloored_depth", ranks_sql(WALK) + f", un as materialized (select node from ({NODES}) n where node not in (select node from rk)), lp(node, level) as (select node, 0 from un union select st.dst, level + 1 from lp join st on st.src = lp.node join un on un.node = st.dst) select node, max(level) as level from lp group by node")
def unfloored_depth(lib: Library) -> DataFrame:
    """The longest path that ends in a node, among nodes that no floor reaches."""
    nodes = staged(unfloored(lib))
    edges = upward(lib, WALK).join(nodes.select(F.col("node").alias("src")).hint("shuffle_merge"), "src", "left_semi")
    return longest(nodes, edges)  # which leaves out edges that end elsewhere


@operator("K13_ladder_tier", "with recursive lp(node, level) as (select slug, 0 from tb_broad where leads_to is null union select b.slug, level + 1 from lp join tb_broad b on b.leads_to = lp.node) select node, max(level) as level from lp group by node")
def ladder_tier(lib: Library) -> DataFrame:
    """Steps from a broad node to the top of its ladder, along the longest path."""
    steps = lib.broad.where("leads_to is not null").select(F.col("leads_to").alias("src"), F.col("slug").alias("dst"))
    return longest(lib.broad.select(F.col("slug").alias("node")), steps)


@operator("K14_columns", ranks_sql(WALK) + f" select n.node, coalesce(cast(d as string), 'none') as col, row_number() over (partition by d order by n.node) as pos from ({NODES}) n left join rk on rk.node = n.node")
def columns(lib: Library) -> DataFrame:
    """Each node's column (its distance) and place there, in binary order."""
    x = all_nodes(lib).join(distances(lib).hint("shuffle_merge"), "node", "left")
    return ranks_within(x.select("node", F.coalesce(F.col("d").cast("string"), F.lit("none")).alias("col")), "col", [F.col("node")])


PINS = "select concat(s.ck, ':', s.id) as node from tb_slices s join tb_papers p on p.ck = s.ck where p.okey % 200 = 0"


@operator("K15_walk_neighbours", f"""
with recursive m as materialized ({MODEL}), st as materialized (select distinct case when kind in ('up', 'cite') then dst else src end as src, case when kind in ('up', 'cite') then src else dst end as dst from m where kind <> 'lateral'),
pin as materialized ({PINS}), dn(pin, node) as (select pin.node, st.dst from pin join st on st.src = pin.node union select dn.pin, st.dst from dn join st on st.src = dn.node),
an(pin, node) as (select pin.node, st.src from pin join st on st.dst = pin.node union select an.pin, st.src from an join st on st.dst = an.node) select pin, node from dn union select pin, node from an""")
def walk_neighbours(lib: Library) -> DataFrame:
    """All above and all below pinned nodes (those of every 200th order here), lateral links apart."""
    pins = lib.slices.join(lib.papers.where("okey % 200 = 0").select("ck"), "ck", "left_semi").select(F.concat_ws(":", "ck", "id").alias("node"))
    st = staged(upward(lib, WALK).distinct())
    both = closure(pins, st).union(closure(pins, st.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return both.select(F.col("root").alias("pin"), "node").distinct()


@operator("K16_rank_histogram", ranks_sql(WALK) + " select d, count(*) as n from rk group by d")
def rank_histogram(lib: Library) -> DataFrame:
    return distances(lib).groupBy("d").agg(F.count("*").alias("n"))


@operator("K16_reach_mismatch", ranks_sql("'up'") + """, c as (select concat(s.ck, ':', s.id) as node, r.id is not null as grounded from tb_slices s left join tb_reach r on r.ck = s.ck and r.id = s.id where kind = 'claim')
select 'grounded' as what, count(*) filter (where grounded) as n from c union all select 'mismatch', count(*) from c where grounded <> (node in (select node from rk))""")
def reach_mismatch(lib: Library) -> DataFrame:
    """The walk over local grounds must reach exactly the claims that are flagged as grounded."""
    walked = bfs(floors(lib), upward(lib, "'up'")).select("node", F.lit(True).alias("walked"))
    f = flags(lib).where("kind = 'claim'").select("node", "grounded").join(walked, "node", "left")
    return f.agg(F.count_if("grounded").alias("g"), F.count_if(F.col("grounded") != F.coalesce("walked", F.lit(False))).alias("m")).select(F.explode(F.array(F.struct(F.lit("grounded").alias("what"), F.col("g").alias("n")), F.struct(F.lit("mismatch").alias("what"), F.col("m").alias("n")))).alias("x")).select("x.*")


@operator("K17_slice_distance", ranks_sql("'up', 'cite'") + " select node, d from rk")
def slice_distance(lib: Library) -> DataFrame:
    """Distances that don't pass through broad nodes."""
    return bfs(floors(lib), upward(lib, "'up', 'cite'"))


@operator("K18_tier_from_top", "with recursive w(node, d) as (select slug, 0 from tb_broad where leads_to is null union select b.slug, d + 1 from w join tb_broad b on b.leads_to = w.node) select node, min(d) as d from w group by node")
def tier_from_top(lib: Library) -> DataFrame:
    steps = lib.broad.where("leads_to is not null").select(F.col("leads_to").alias("src"), F.col("slug").alias("dst"))
    return bfs(lib.broad.where("leads_to is null").select(F.col("slug").alias("node")), steps)


FAMILY = "anc(node, up) as (select distinct slug, slug from tb_broad union select anc.node, b.leads_to from anc join tb_broad b on b.slug = anc.up where b.leads_to is not null), fam as materialized (select distinct node, up as family from anc where up in (select slug from tb_broad where leads_to is null))"


def families(lib: Library) -> DataFrame:
    """(node, family): the top-level nodes above each broad node, itself if it is one."""
    steps = lib.broad.where("leads_to is not null").select(F.col("slug").alias("src"), F.col("leads_to").alias("dst"))
    tops = lib.broad.where("leads_to is null").select(F.col("slug").alias("family"))
    all_ = closure(lib.broad.select(F.col("slug").alias("node")), steps).select(F.col("root").alias("node"), F.col("node").alias("family")).union(tops.select("family", "family"))
    return all_.join(tops.hint("shuffle_merge"), "family", "left_semi").select("node", "family").distinct()


@operator("K19_families", f"with recursive {FAMILY} select node, family from fam")
def broad_families(lib: Library) -> DataFrame:
    return families(lib)


def slice_families(lib: Library, rounds: int = 6, most: int = 2) -> DataFrame:
    """(node, families, round): authored by what a slice leads to, else inherited from neighbours, in rounds that all
    nodes take together; the first `most` of the sorted families are kept."""
    m = model(lib)
    cons = m.where("kind = 'cons'").join(families(lib).withColumnRenamed("node", "dst").hint("shuffle_merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.slice(F.array_sort(F.collect_set("family")), 1, most).alias("families"))
    near = m.where("kind in ('up', 'cite', 'lateral')").select("src", "dst")
    near = bucketed(near.union(near.select("dst", "src")), "src", once=True)
    keep = lambda df: bucketed(df, "node")
    new = keep(cons.withColumn("round", F.lit(0)))
    known = Known(new, keep)
    for k in range(1, rounds + 1):
        # What an older node is next to took its families a round ago: the newest alone have neighbours without.
        led = new.select(F.col("node").alias("src"), F.explode("families").alias("f")).hint("shuffle_merge").join(near, "src")
        found = led.groupBy(F.col("dst").alias("node")).agg(F.slice(F.array_sort(F.collect_set("f")), 1, most).alias("families"))
        new = keep(known.without(found, ["node"]).withColumn("round", F.lit(k)))
        if not (n := new.count()):
            break
        known.add(n, new)
    dropped(near)
    return known.all()


def slice_families_sql() -> str:
    head = f"with recursive {FAMILY}, m as materialized ({MODEL}), nb as materialized (select src, dst from m where kind in ('up', 'cite', 'lateral') union select dst, src from m where kind in ('up', 'cite', 'lateral')), f0 as materialized (select node, unnest(list_slice(list_sort(list_distinct(list(family))), 1, 2)) as f, 0 as round from (select m.src as node, family from m join fam on fam.node = m.dst where kind = 'cons') x group by node)"
    for k in range(1, 7):
        head += f", f{k} as materialized (select * from f{k - 1} union all select node, unnest(list_slice(list_sort(list_distinct(list(f))), 1, 2)), {k} from (select nb.dst as node, p.f from nb join f{k - 1} p on p.node = nb.src where nb.dst not in (select node from f{k - 1})) y group by node)"
    return head + " select node, string_agg(f, ',' order by f) as families, max(round) as round from f6 group by node"


@operator("K20_slice_families", slice_families_sql())
def inherited_families(lib: Library) -> DataFrame:
    return slice_families(lib).select("node", F.array_join("families", ",").alias("families"), "round")


@operator("K21_forward_coverage", f"""
with recursive {FAMILY}, m as materialized ({MODEL}), fw as materialized (select distinct case when kind in ('up', 'cite') then dst else src end as src, case when kind in ('up', 'cite') then src else dst end as dst from m where kind in ('up', 'cite')),
cv(node, family) as (select m.src, family from m join fam on fam.node = m.dst where kind = 'cons' union select fw.src, cv.family from cv join fw on fw.dst = cv.node) select family, count(distinct node) as n from cv group by family""")
def forward_coverage(lib: Library) -> DataFrame:
    """Slices of each family by one rule alone: what an anchored slice rests on belongs to its families."""
    anchors = staged(model(lib).where("kind = 'cons'").join(families(lib).withColumnRenamed("node", "dst"), "dst").select("family", F.col("src").alias("node")).distinct())
    rests = upward(lib, "'up', 'cite'").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    held = grow(anchors, rests, ["family", "node"], lambda j, k: j.select("family", F.col("dst").alias("node")))
    return held.groupBy("family").agg(F.count("*").alias("n"))


@operator("K22_generality_radius", ranks_sql(WALK) + ", g as (select node, d, max(d) over () as gmax from rk) select node, round(0.13 + (1 - d / gmax) * 0.87, 6) as r, d = 0 as halo from g")
def generality_radius(lib: Library) -> DataFrame:
    d = distances(lib)
    top = d.agg(F.max("d").alias("gmax"))  # one row
    return d.join(F.broadcast(top)).select("node", F.round(0.13 + (1 - F.col("d") / F.col("gmax")) * 0.87, 6).alias("r"), (F.col("d") == 0).alias("halo"))


AXES = """ax as materialized (select family, 1 - 2 * (i + 0.5) / n as y, i * pi() * (3 - sqrt(5.0)) as t from (select family, row_number() over (order by family) - 1 as i, count(*) over () as n from (select distinct family from fam) f) g),
xyz as materialized (select family, cos(t) * sqrt(1 - y * y) as x, y, sin(t) * sqrt(1 - y * y) as z from ax)"""


@operator("K23_family_axes", f"with recursive {FAMILY}, {AXES} select node, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from fam join xyz using (family) group by node")
def family_axes(lib: Library) -> DataFrame:
    """Directions of the families, even on a sphere, and of each broad node as their mean."""
    fam = staged(families(lib))
    tops = staged(fam.select("family").distinct())
    axes = ranks(tops, [F.col("family")], "i").withColumn("i", F.col("i") - 1).join(F.broadcast(tops.agg(F.count("*").alias("n"))))  # one row
    y, t = 1 - 2 * (F.col("i") + 0.5) / F.col("n"), F.col("i") * F.pi() * (3 - F.sqrt(F.lit(5.0)))
    axes = axes.select("family", (F.cos(t) * F.sqrt(1 - y * y)).alias("x"), y.alias("y"), (F.sin(t) * F.sqrt(1 - y * y)).alias("z"))
    return fam.join(axes, "family").groupBy("node").agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"])


@operator("K24_model_stats", f"with m as ({MODEL}) select coalesce(kind, 'all') as kind, count(*) as n from m group by grouping sets ((kind), ())")
def model_stats(lib: Library) -> DataFrame:
    return model(lib).rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@operator("K25_shell_window", ranks_sql(WALK) + " select node from rk where d between 1 and 2 and (strpos(node, ':') = 0 or node in (select dst from tb_links where field = 'grounded_in'))")
def shell_window(lib: Library, low: int = 1, high: int = 2) -> DataFrame:
    """Nodes between two shells: the broad ones, and those that something cites."""
    d = staged(distances(lib).where(F.col("d").between(low, high)).select("node"))
    cited = lib.links.where("field = 'grounded_in'").select(F.col("dst").alias("node"))
    return d.where(~F.contains("node", F.lit(":"))).union(d.where(F.contains("node", F.lit(":"))).join(cited.hint("shuffle_merge"), "node", "left_semi"))


def invariants(edges: DataFrame, nodes: DataFrame, placed: DataFrame, floor: DataFrame, steps: DataFrame) -> DataFrame:
    """(rule, node): what breaks a rule of the model.

    edges(src, dst, kind) join two different nodes(node), and the ladder joins broad ones. placed(node, d, r) has one row for a
    node, with a radius from 0.13 to 1 that is 1 for floors and falls with the distance; its floors(node) are at distance 0 and
    nothing else is; every other one has a step from a node that is one nearer.
    """
    row = lambda df, rule, c="node": df.select(F.lit(rule).alias("rule"), F.col(c).alias("node"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    gone = lambda df, other: df.join(other.hint("shuffle_merge"), "node", "left_anti")
    nearer = steps.join(placed.select(F.col("node").alias("src"), (F.col("d") + 1).alias("d")).hint("shuffle_merge"), "src").select(F.col("dst").alias("node"), "d")
    order = placed.groupBy("d").agg(F.min("r").alias("low"))
    # A row for each distance, of which a walk has a thousand at most: a join that merges would put all nodes in as few tasks.
    mixed = placed.join(F.broadcast(order.select((F.col("d") + 1).alias("d"), F.col("low").alias("inner"))), "d").where("r >= inner")
    parts = [
        row(edges.where("src = dst").select("src").distinct(), "self link", "src"),
        row(gone(ends, nodes), "unknown end"),
        row(edges.where("kind = 'ladder' and (contains(src, ':') or contains(dst, ':'))").select("src").distinct(), "ladder off broad", "src"),
        row(placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "placed twice"),
        row(gone(placed, nodes), "unknown node"),
        row(placed.where("r < 0.13 or r > 1 or r is null"), "radius out of range"),
        row(placed.where("d = 0 and r <> 1"), "floor off the rim"),
        row(gone(placed.where("d = 0"), floor), "no floor at 0"),
        row(gone(floor, placed.where("d = 0")), "floor not at 0"),
        row(placed.where("d > 0").join(nearer.distinct().hint("shuffle_merge"), ["node", "d"], "left_anti"), "no step from a nearer node"),
        row(mixed, "radius does not fall"),
    ]
    return reduce(DataFrame.unionByName, parts)


def seeded(lib: Library) -> tuple[DataFrame, ...]:
    """The model with an error of each kind: links to itself and to nothing, slices on the ladder, nodes that are placed twice, too far or too near."""
    s = lib.slices.select(F.concat_ws(":", "ck", "id").alias("node"), "pk")
    link = lambda n, dst, kind: s.where(F.col("pk") % n == 0).select(F.col("node").alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    edges = model(lib).select("src", "dst", "kind").unionByName(link(101, F.col("node"), "up")).unionByName(link(103, F.concat(F.lit("ghost-"), F.col("pk")), "cite")).unionByName(link(107, F.lit("fam-0"), "ladder"))
    d = distances(lib).join(s.hint("shuffle_merge"), "node", "left")
    top = distances(lib).agg(F.max("d").alias("gmax"))  # one row
    off = F.col("d") + F.when(F.col("pk") % 109 == 0, 5).when(F.col("pk") % 113 == 0, -1).otherwise(0)
    moved = d.select("node", "pk", off.alias("d"))
    more = s.where("pk % 127 = 0").select("node", "pk", F.lit(0).alias("d")).unionByName(s.where("pk % 131 = 0").select(F.concat(F.lit("lost-"), "node").alias("node"), "pk", F.lit(1).alias("d")))
    placed = moved.unionByName(more).join(F.broadcast(top)).select("node", "d", F.round(0.13 + (1 - F.col("d") / F.col("gmax")) * 0.87, 6).alias("r"))
    return edges, all_nodes(lib), placed, floors(lib), upward(lib, WALK)


@operator("K26_model_invariants", ranks_sql(WALK) + f""",
s as materialized (select concat(ck, ':', id) as node, pk from tb_slices), nodes as materialized ({NODES}),
e as materialized (select src, dst, kind from m union all select node, node, 'up' from s where pk % 101 = 0 union all select node, concat('ghost-', cast(pk as string)), 'cite' from s where pk % 103 = 0 union all select node, 'fam-0', 'ladder' from s where pk % 107 = 0),
pl as materialized (select node, d, round(0.13 + (1 - d / gmax) * 0.87, 6) as r from (select rk.node, d + case when pk % 109 = 0 then 5 when pk % 113 = 0 then -1 else 0 end as d from rk left join s on s.node = rk.node
  union all select node, 0 from s where pk % 127 = 0 union all select concat('lost-', node), 1 from s where pk % 131 = 0) x, (select cast(max(d) as double) as gmax from rk) g),
v as (select 'self link' as rule, src as node from e where src = dst group by src
union all select 'unknown end', node from (select src as node from e union select dst from e) x where node not in (select node from nodes)
union all select 'ladder off broad', src from e where kind = 'ladder' and (strpos(src, ':') > 0 or strpos(dst, ':') > 0) group by src
union all select 'placed twice', node from pl group by node having count(*) > 1
union all select 'unknown node', node from pl where node not in (select node from nodes)
union all select 'radius out of range', node from pl where r < 0.13 or r > 1
union all select 'floor off the rim', node from pl where d = 0 and r <> 1
union all select 'no floor at 0', node from pl where d = 0 and node not in (select node from fl)
union all select 'floor not at 0', node from fl where node not in (select node from pl where d = 0)
union all select 'no step from a nearer node', node from pl where d > 0 and not exists (select 1 from st join pl q on q.node = st.src where st.dst = pl.node and q.d = pl.d - 1)
union all select 'radius does not fall', pl.node from pl join (select d, min(r) as low from pl group by d) o on o.d = pl.d - 1 where pl.r >= low)
select rule, count(*) as n from v group by rule""")
def model_invariants(lib: Library) -> DataFrame:
    """What breaks a rule in a model with seeded errors, by rule."""
    return invariants(*seeded(lib)).groupBy("rule").agg(F.count("*").alias("n"))
