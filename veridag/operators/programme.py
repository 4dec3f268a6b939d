"""A programme of proposed work (E): what is tested, what is relied on silently, what is at risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import aim_label, is_programme
from ..plans.fixpoint import radius, reach
from ..plans.registry import operator
from ..plans.staging import shared
from ..sources.testbed import Library
from .graph import ranks_within


def gid() -> Column:
    return F.concat_ws(":", "ck", "id")


def is_test() -> Column:
    """A reference to a test, by its local id."""
    return F.col("form").isin("local", "sharpened") & F.col("tid").rlike(r"^t\d+$")


TESTED = """
select distinct l.dst as node from tb_aim_links l join tb_aim_slices s on s.ck = l.ck and s.id = l.src where l.field = 'discriminates' and s.kind = 'test'
union select l.gid from tb_aim_links l join tb_aim_slices s on s.ck = l.ck and s.id = l.src where l.field = 'grounded_in' and l.tid like 't%' and s.kind = 'claim'"""
DEPENDS = "select dst as src, gid as dst from tb_aim_links where field = 'grounded_in' union select gid, dst from tb_aim_links where field = 'leads_to'"
AIM_FLOOR = "select concat(ck, ':', id) as node, kind from tb_aim_slices s where axiom or (kind = 'method' and not exists (select 1 from tb_aim_links l where l.ck = s.ck and l.src = s.id and field = 'grounded_in' and form = 'local'))"
#: What the rules on evidence and tests give, as common tables.
FACTS = f"""
tested as materialized ({TESTED}),
aim_floor as materialized ({AIM_FLOOR}),
solid as (select node from aim_floor union select gid from tb_aim_links where field = 'grounded_in' and form in ('container', 'sharpened') and ref[1] <> '@'),
evid(node) as (select node from solid where node not in (select concat(ck, ':', id) from tb_aim_slices where kind = 'test') union select l.gid from tb_aim_links l join evid e on l.dst = e.node where l.field = 'grounded_in' and l.form = 'local' and l.ref not like 't%'),
based(node) as (select node from aim_floor union select l.gid from tb_aim_links l join based e on l.dst = e.node where l.field = 'grounded_in' and l.form = 'local' and l.ref not like 't%'),
rests(node) as (select concat(ck, ':', id) from tb_aim_slices where kind = 'test' union select node from tested union select l.gid from tb_aim_links l join rests r on l.dst = r.node where l.field = 'grounded_in' and l.form = 'local'),
modal as materialized (select s.ck, s.id, concat(s.ck, ':', s.id) as node, case when r.node is not null then 'proposed' when e.node is not null then 'established' else 'speculation' end as modality
  from tb_aim_slices s left join rests r on r.node = concat(s.ck, ':', s.id) left join evid e on e.node = concat(s.ck, ':', s.id) where s.kind = 'claim'),
dep as materialized ({DEPENDS}),
bearing as materialized (select m.* from modal m where modality = 'speculation' and node not in (select node from tested) and node in (select src from dep)),
blast(root, node) as (select node, dep.dst from bearing join dep on dep.src = bearing.node union select b.root, d.dst from blast b join dep d on d.src = b.node)"""


@operator("E1_tested_claims", TESTED)
def tested(lib: Library) -> DataFrame:
    """What a test discriminates, and claims that are grounded in a test. A broad slug that starts with t is no test."""
    of = lambda kind: lib.aim_slices.where(F.col("kind") == kind).select(gid().alias("gid"))
    a = lib.aim_links.where("field = 'discriminates'").join(of("test").hint("shuffle_merge"), "gid", "left_semi").select(F.col("dst").alias("node"))
    return a.union(lib.aim_links.where("field = 'grounded_in'").where(is_test()).join(of("claim").hint("shuffle_merge"), "gid", "left_semi").select("gid")).distinct()


@operator("E2_dependents", DEPENDS)
def dependents(lib: Library) -> DataFrame:
    a = lib.aim_links.where("field = 'grounded_in'").select(F.col("dst").alias("src"), F.col("gid").alias("dst"))
    return a.union(lib.aim_links.where("field = 'leads_to'").select("gid", "dst")).distinct()


def local_up(lib: Library, without_tests: bool) -> DataFrame:
    g = lib.aim_links.where("field = 'grounded_in' and form = 'local'")
    return (g.where(~is_test()) if without_tests else g).select(F.col("dst").alias("src"), F.col("gid").alias("dst"))


def nodes_of(lib: Library, kind: str) -> DataFrame:
    return lib.aim_slices.where(F.col("kind") == kind).select(gid().alias("node"))


@operator("E4_rests_on_test", f"with recursive {FACTS} select r.node from rests r join tb_aim_slices s on concat(s.ck, ':', s.id) = r.node where kind = 'claim'")
def rests_on_test(lib: Library) -> DataFrame:
    return reach(nodes_of(lib, "test").union(tested(lib)), local_up(lib, False)).join(nodes_of(lib, "claim").hint("shuffle_merge"), "node", "left_semi")


def aim_floors(lib: Library) -> DataFrame:
    """(node, kind): methods without local grounds, and axioms."""
    held = lib.aim_links.where("field = 'grounded_in' and form = 'local'").select(F.col("gid").alias("node"))
    s = lib.aim_slices.select(gid().alias("node"), "kind", "axiom")
    return s.where("kind = 'method'").join(held.hint("shuffle_merge"), "node", "left_anti").unionByName(s.where("axiom")).select("node", "kind")


def solid(lib: Library) -> DataFrame:
    cited = lib.aim_links.where("field = 'grounded_in'").where(F.col("form").isin("container", "sharpened") & ~is_programme(F.col("ref"))).select(F.col("gid").alias("node"))
    return aim_floors(lib).select("node").union(cited).distinct()


@operator("E5_reaches_evidence", f"with recursive {FACTS} select distinct e.node from evid e join tb_aim_slices s on concat(s.ck, ':', s.id) = e.node where kind = 'claim'")
def reaches_evidence(lib: Library) -> DataFrame:
    seeds = solid(lib).join(nodes_of(lib, "test").hint("shuffle_merge"), "node", "left_anti")
    return reach(seeds, local_up(lib, True)).join(nodes_of(lib, "claim").hint("shuffle_merge"), "node", "left_semi")


def modalities(lib: Library) -> DataFrame:
    return shared(lib, "modalities", lambda: judged(lib))


def judged(lib: Library) -> DataFrame:
    a, b = rests_on_test(lib).withColumn("a", F.lit(1)), reaches_evidence(lib).withColumn("b", F.lit(1))
    claims = lib.aim_slices.where("kind = 'claim'").select("ck", "id", gid().alias("node"))
    return claims.join(a.hint("shuffle_merge"), "node", "left").join(b.hint("shuffle_merge"), "node", "left").select("ck", "id", "node", F.when(F.col("a").isNotNull(), "proposed").when(F.col("b").isNotNull(), "established").otherwise("speculation").alias("modality"))


@operator("E6_modality", f"with recursive {FACTS} select ck, id, modality from modal")
def modality(lib: Library) -> DataFrame:
    return modalities(lib).select("ck", "id", "modality")


@operator("E7_programme_flags", f"""
with recursive {FACTS} select concat(s.ck, ':', id) as node, s.kind, f.node is not null as is_floor,
  s.kind = 'claim' and exists (select 1 from tb_aim_links l where l.ck = s.ck and l.src = s.id and field = 'grounded_in' and form in ('container', 'sharpened')) as borrowed, s.kind = 'claim' and g.node is not null as grounded
from tb_aim_slices s left join aim_floor f on f.node = concat(s.ck, ':', s.id) left join based g on g.node = concat(s.ck, ':', s.id)""")
def programme_flags(lib: Library) -> DataFrame:
    """Floors, borrowed claims, and claims that reach a floor where tests are left out: a planned test is a hollow floor."""
    yes = F.lit(True)
    far = lib.aim_links.where("field = 'grounded_in' and form in ('container', 'sharpened')").select(F.col("gid").alias("node"), yes.alias("far")).distinct()
    floor = aim_floors(lib).select("node", yes.alias("is_floor"))
    based = reach(floor, local_up(lib, True)).withColumn("based", yes)
    s = lib.aim_slices.select(gid().alias("node"), "kind").join(floor.hint("shuffle_merge"), "node", "left").join(far.hint("shuffle_merge"), "node", "left").join(based.hint("shuffle_merge"), "node", "left").na.fill(False)
    claim = F.col("kind") == "claim"
    return s.select("node", "kind", "is_floor", (claim & F.col("far")).alias("borrowed"), (claim & F.col("based")).alias("grounded"))


def bearing(lib: Library) -> DataFrame:
    """Speculative, untested claims that something depends on."""
    m = modalities(lib).where("modality = 'speculation'").join(tested(lib).hint("shuffle_merge"), "node", "left_anti")
    return m.join(dependents(lib).select(F.col("src").alias("node")).hint("shuffle_merge"), "node", "left_semi")


@operator("E3_blast_radius", f"with recursive {FACTS} select root as node, count(*) as radius from blast group by root")
def blast_radius(lib: Library) -> DataFrame:
    """How many nodes depend on each load-bearing claim, directly or through others; only these claims are walked."""
    return shared(lib, "radius", lambda: radius(bearing(lib), dependents(lib)))


@operator("E8_load_bearing", f"with recursive {FACTS} select ck, id from bearing")
def load_bearing(lib: Library) -> DataFrame:
    return bearing(lib).select("ck", "id")


ORPHANS = f"""
select kind, concat(ck, ':', id) as node from tb_aim_slices s where
  (kind = 'claim' and not exists (select 1 from ({DEPENDS}) d where d.src = concat(s.ck, ':', s.id)) and not exists (select 1 from tb_aim_links l where l.gid = concat(s.ck, ':', s.id) and field = 'answers') and not exists (select 1 from ({TESTED}) t where t.node = concat(s.ck, ':', s.id)))
  or (kind = 'test' and not exists (select 1 from tb_aim_links l where l.gid = concat(s.ck, ':', s.id) and field = 'discriminates') and not exists (select 1 from ({DEPENDS}) d where d.src = concat(s.ck, ':', s.id)))
  or (kind = 'capability' and not exists (select 1 from tb_aim_links l join tb_aim_slices t on t.ck = l.ck and t.id = l.src where l.dst = concat(s.ck, ':', s.id) and l.field = 'enabled_by' and t.kind = 'test'))"""


@operator("E9_orphans", ORPHANS)
def orphans(lib: Library) -> DataFrame:
    """Untested claims that nothing depends on and that answer nothing, tests that discriminate nothing and that nothing
    depends on, capabilities that no test uses."""
    s = lib.aim_slices.select("kind", gid().alias("node"))
    links = lambda field, end: lib.aim_links.where(F.col("field") == field).select(F.col(end).alias("node"))
    leaned = dependents(lib).select(F.col("src").alias("node"))
    used = lib.aim_links.where("field = 'enabled_by'").join(nodes_of(lib, "test").withColumnRenamed("node", "gid").hint("shuffle_merge"), "gid", "left_semi").select(F.col("dst").alias("node"))
    why = {"claim": [leaned, links("answers", "gid"), tested(lib)], "test": [links("discriminates", "gid"), leaned], "capability": [used]}
    left = lambda kind: reduce(lambda x, y: x.join(y.hint("shuffle_merge"), "node", "left_anti"), why[kind], s.where(F.col("kind") == kind))
    return reduce(DataFrame.unionByName, map(left, why)).select("kind", "node")


ASPIRE = "select concat(ck, ':', id) as node from tb_aim_slices s where kind = 'capability' and not exists (select 1 from tb_aim_links l where l.gid = concat(s.ck, ':', s.id) and field = 'grounded_in')"


@operator("E10_aspirational", ASPIRE)
def aspirational(lib: Library) -> DataFrame:
    grounds = lib.aim_links.where("field = 'grounded_in'").select(F.col("gid").alias("node"))
    return nodes_of(lib, "capability").join(grounds.hint("shuffle_merge"), "node", "left_anti")


RISK = f"select l.gid as node, string_agg(l.ref, ', ' order by l.ref) as needs from tb_aim_links l join ({ASPIRE}) a on a.node = l.dst join tb_aim_slices t on t.ck = l.ck and t.id = l.src where l.field = 'enabled_by' and t.kind = 'test' group by l.gid"


@operator("E11_tests_at_risk", RISK)
def tests_at_risk(lib: Library) -> DataFrame:
    """Tests that an aspirational capability of their own or another aim enables, with the references that block them."""
    j = lib.aim_links.where("field = 'enabled_by'").join(nodes_of(lib, "test").withColumnRenamed("node", "gid").hint("shuffle_merge"), "gid", "left_semi").join(aspirational(lib).withColumnRenamed("node", "dst").hint("shuffle_merge"), "dst", "left_semi")
    return j.groupBy(F.col("gid").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("ref")), ", ").alias("needs"))


@operator("E12_enabled_tests", "select dst as node, string_agg(gid, ',' order by gid) as tests from tb_aim_links where field = 'enabled_by' group by dst")
def enabled_tests(lib: Library) -> DataFrame:
    return lib.aim_links.where("field = 'enabled_by'").groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("gid")), ",").alias("tests"))


@operator("E13_answered_in_aims", "select distinct l.dst as gid from tb_aim_links l join tb_aim_slices s on concat(s.ck, ':', s.id) = l.gid where s.kind = 'claim' and l.field = 'answers'")
def answered_in_aims(lib: Library) -> DataFrame:
    """What claims of aims answer."""
    claims = nodes_of(lib, "claim").withColumnRenamed("node", "gid")
    return lib.aim_links.where("field = 'answers'").join(claims.hint("shuffle_merge"), "gid", "left_semi").select(F.col("dst").alias("gid")).distinct()


ANSWERED = "select l.dst from tb_aim_links l join tb_aim_slices s on concat(s.ck, ':', s.id) = l.gid where s.kind = 'claim' and l.field = 'answers'"
REPORT = f"""
select 'assumptions' as section, root as node, concat(cast(count(*) as string), ' dependent', case when count(*) = 1 then '' else 's' end, ', no test') as detail, count(*) as weight from blast group by root
union all select 'speculation', node, '', 0 from modal where modality = 'speculation' and node not in (select node from bearing)
union all select 'at_risk', node, concat('needs ', needs), 0 from ({RISK}) r
union all select 'aspirational', node, 'no evidence it exists', 0 from ({ASPIRE}) a
union all select 'open_questions', concat(ck, ':', id), '', 0 from tb_aim_slices where kind = 'question' and concat(ck, ':', id) not in ({ANSWERED})
union all select 'orphans', node, case kind when 'claim' then 'nothing depends on it' when 'test' then 'discriminates nothing' else 'no test uses it' end, 0 from ({ORPHANS}) o"""


def report_rows(lib: Library) -> DataFrame:
    """(section, node, detail, weight): all findings; weight is the blast radius of an assumption, else 0."""
    row = lambda df, section, detail: df.select(F.lit(section).alias("section"), "node", detail.alias("detail"), F.lit(0).cast("long").alias("weight"))
    n = F.col("radius")
    empty = F.lit("")
    quiet = modalities(lib).where("modality = 'speculation'").join(bearing(lib).select("node").hint("shuffle_merge"), "node", "left_anti")
    open_ = nodes_of(lib, "question").join(answered_in_aims(lib).withColumnRenamed("gid", "node").hint("shuffle_merge"), "node", "left_anti")
    why = F.when(F.col("kind") == "claim", "nothing depends on it").when(F.col("kind") == "test", "discriminates nothing").otherwise("no test uses it")
    parts = [
        blast_radius(lib).select(F.lit("assumptions").alias("section"), "node", F.concat(n.cast("string"), F.when(n == 1, " dependent").otherwise(" dependents"), F.lit(", no test")).alias("detail"), n.alias("weight")),
        row(quiet, "speculation", empty),
        row(tests_at_risk(lib), "at_risk", F.concat(F.lit("needs "), "needs")),
        row(aspirational(lib), "aspirational", F.lit("no evidence it exists")),
        row(open_, "open_questions", empty),
        row(orphans(lib), "orphans", why),
    ]
    return reduce(DataFrame.unionAll, parts)


@operator("E14_report", f"with recursive {FACTS} select section, row_number() over (partition by section order by weight desc, node) as rank, node, detail from ({REPORT}) x")
def report(lib: Library) -> DataFrame:
    """Sections of a report; assumptions go by falling radius, the others by node."""
    return ranks_within(report_rows(lib), "section", [F.desc("weight"), F.col("node")], "rank").select("section", "rank", "node", "detail")


@operator("E15_clean", f"with recursive {FACTS}, r as ({REPORT}) select s.ck, count(r.node) as findings, count(r.node) = 0 as clean from (select distinct ck from tb_aim_slices) s left join r on split_part(r.node, ':', 1) = s.ck and section <> 'open_questions' group by s.ck")
def clean(lib: Library) -> DataFrame:
    """Findings of each aim; open questions do not count."""
    found = report_rows(lib).where("section <> 'open_questions'").groupBy(F.split("node", ":")[0].alias("ck")).agg(F.count("*").alias("findings"))
    return lib.aim_slices.select("ck").distinct().join(found.hint("shuffle_merge"), "ck", "left").na.fill(0, ["findings"]).withColumn("clean", F.col("findings") == 0)


@operator("E16_aim_stats", "select ck, count(*) filter (where kind = 'claim') as claims, count(*) filter (where kind = 'test') as tests, count(*) filter (where kind = 'capability') as capabilities, count(*) filter (where kind = 'method') as methods from tb_aim_slices group by ck")
def aim_stats(lib: Library) -> DataFrame:
    names = {"claim": "claims", "test": "tests", "capability": "capabilities", "method": "methods"}
    return lib.aim_slices.groupBy("ck").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in names.items()])


@operator("E17_claim_groups", f"""
with recursive {FACTS}, g as (select m.ck, m.id, coalesce(r.radius, 0) as radius, case when m.node in (select node from tested) then 'argued' when b.node is not null then 'assumption' when m.modality = 'established' then 'literature' else 'rest' end as grp
  from modal m left join bearing b on b.node = m.node left join (select root, count(*) as radius from blast group by root) r on r.root = m.node)
select ck, id, grp, row_number() over (partition by ck, grp order by radius desc, id) as pos from g""")
def claim_groups(lib: Library) -> DataFrame:
    """The first group that fits: argued, assumption (by falling radius), literature, rest."""
    t, r = tested(lib).withColumn("t", F.lit(1)), blast_radius(lib)
    m = modalities(lib).join(t.hint("shuffle_merge"), "node", "left").join(r.hint("shuffle_merge"), "node", "left")
    g = m.withColumn("grp", F.when(F.col("t").isNotNull(), "argued").when(F.col("radius").isNotNull(), "assumption").when(F.col("modality") == "established", "literature").otherwise("rest"))
    return g.select("ck", "id", "grp", F.row_number().over(Window.partitionBy("ck", "grp").orderBy(F.coalesce("radius", F.lit(0)).desc(), "id")).cast("long").alias("pos"))


@operator("E18_tests_of_claims", "select dst as claim, string_agg(gid, ',' order by gid) as tests from tb_aim_links where field = 'discriminates' group by dst")
def tests_of_claims(lib: Library) -> DataFrame:
    return lib.aim_links.where("field = 'discriminates'").groupBy(F.col("dst").alias("claim")).agg(F.array_join(F.array_sort(F.collect_list("gid")), ",").alias("tests"))


@operator("B9_programme_label", f"""
with recursive {FACTS} select s.ck, s.id, case s.kind when 'claim' then m.modality when 'test' then case when r.node is null then 'test' else 'test-at-risk' end
  when 'capability' then case when a.node is null then 'capability' else 'capability-aspirational' end when 'question' then 'question' else case when f.node is null then 'model' else 'floor' end end as label
from tb_aim_slices s left join ({RISK}) r on r.node = concat(s.ck, ':', s.id) left join ({ASPIRE}) a on a.node = concat(s.ck, ':', s.id) left join aim_floor f on f.node = concat(s.ck, ':', s.id) left join modal m on m.node = concat(s.ck, ':', s.id)""")
def programme_labels(lib: Library) -> DataFrame:
    flag = lambda df, name: df.select("node", F.lit(True).alias(name)).hint("shuffle_merge")
    s = lib.aim_slices.select("ck", "id", "kind", gid().alias("node"))
    for df, name in ((tests_at_risk(lib), "risk"), (aspirational(lib), "dream"), (aim_floors(lib), "floor")):
        s = s.join(flag(df, name), "node", "left")
    s = s.na.fill(False).join(modalities(lib).select("node", "modality").hint("shuffle_merge"), "node", "left")
    return s.select("ck", "id", aim_label(F.col("kind"), F.col("risk"), F.col("dream"), F.col("floor"), F.col("modality")).alias("label"))
