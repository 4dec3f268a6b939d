"""Validation (C): every rule gives its violations as rows (ck, id, field, ref); none are hidden by the first.

A rule takes any container of the frames papers(ck, curated, type, given_keys), aims(ck), slices(ck, id, kind, axiom),
links (long edges), broad(slug, kind, leads_to), topics(slug, broader) and refs(bullet, ref). The queries apply the rules
to the draft of the derived library, which has errors in all of these.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import ref_form
from ..plans.fixpoint import simple_cycles
from ..plans.registry import operator
from ..plans.staging import staged
from ..sources.testbed import Library

Container = Any
RULES: dict[str, tuple[Callable[[Container], DataFrame], str]] = {}
TEXTS: dict[str, str] = {}


def rule(name: str, sql: str, message: str):
    """Register a rule, and the query that applies it to the draft."""

    def register(find: Callable[[Container], DataFrame]) -> Callable[[Container], DataFrame]:
        def rows(lib: Container) -> DataFrame:
            df = find(lib)
            return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("ck", "id", "field", "ref")])

        RULES[name], TEXTS[name] = (rows, message), sql
        operator(name, sql)(lambda lib: rows(lib.draft))
        return rows

    return register


def of_links(df: DataFrame) -> DataFrame:
    return df.select("ck", F.col("src").alias("id"), "field", "ref")


def has_broad() -> Column:
    """Tests and capabilities have no broad tier; their rules are others."""
    return ~F.col("kind").isin("test", "capability")


KIND = "(select concat(ck, ':', id) as gid, min(kind) as kind from tb_draft_slices group by ck, id)"
OWN = f"tb_draft_links l join {KIND} s on s.gid = l.gid"
END = f"join {KIND} t on t.gid = l.dst"


def own_kind(lib: Container) -> DataFrame:
    """(gid, kind) of each slice; the smallest kind where an id is given twice."""
    return lib.slices.groupBy(F.concat_ws(":", "ck", "id").alias("gid")).agg(F.min("kind").alias("kind"))


def of_kind(lib: Container, fields: list[str]) -> DataFrame:
    """Links of these fields with the kind of the slice that they stand on."""
    return lib.links.where(F.col("field").isin(fields)).join(own_kind(lib).hint("shuffle_merge"), "gid")


def to_kind(lib: Container, links: DataFrame, how: str = "inner") -> DataFrame:
    """Links with the kind of the slice that they name; a plain join passes over what isn't resolved."""
    return links.join(own_kind(lib).select(F.col("gid").alias("dst"), F.col("kind").alias("dst_kind")).hint("shuffle_merge"), "dst", how)


def to_broad(lib: Container, links: DataFrame) -> DataFrame:
    return links.where("form = 'broad'").join(lib.broad.select(F.col("slug").alias("ref"), F.regexp_replace("kind", "^broad ", "").alias("dst_kind")).hint("shuffle_merge"), "ref")


@rule("C1_duplicate_ids", "select ck, id, cast(null as string) as field, cast(null as string) as ref from tb_draft_slices group by ck, id having count(*) > 1", "a duplicate local id")
def duplicate_ids(lib: Container) -> DataFrame:
    return lib.slices.groupBy("ck", "id").agg(F.count("*").alias("n")).where("n > 1")


@rule("C2_curated_and_stub", "select ck, cast(null as string) as id, cast(null as string) as field, cast(null as string) as ref from tb_draft_papers group by ck having bool_or(curated) and bool_or(not curated)", "both a curated paper and a stub")
def curated_and_stub(lib: Container) -> DataFrame:
    return lib.papers.groupBy("ck").agg(F.bool_or("curated").alias("c"), F.bool_or(~F.col("curated")).alias("s")).where("c and s")


@rule("C3_paper_and_aim", "select ck, cast(null as string) as id, cast(null as string) as field, cast(null as string) as ref from (select ck from tb_draft_papers intersect select ck from tb_draft_aims) x", "both a paper and an aim")
def paper_and_aim(lib: Container) -> DataFrame:
    return lib.papers.select("ck").intersect(lib.aims.select("ck"))


DANGLING = """
select l.ck, l.src as id, field, ref from tb_draft_links l where
  (form = 'local' and not exists (select 1 from tb_draft_slices s where s.ck = l.ck and s.id = l.ref))
  or (form = 'broad' and not exists (select 1 from tb_draft_broad b where b.slug = l.ref))
  or (form in ('container', 'sharpened') and not exists (select 1 from tb_draft_papers p where p.ck = l.key) and not exists (select 1 from tb_draft_aims a where a.ck = l.key))"""


@rule("C4_dangling_refs", DANGLING, "a dangling reference")
def dangling(lib: Container) -> DataFrame:
    """A sharpened reference needs its container alone."""
    local = lib.links.where("form = 'local'").join(lib.slices.select("ck", F.col("id").alias("ref")).hint("shuffle_merge"), ["ck", "ref"], "left_anti")
    broad = lib.links.where("form = 'broad'").join(lib.broad.select(F.col("slug").alias("ref")).hint("shuffle_merge"), "ref", "left_anti")
    keys = lib.papers.select(F.col("ck").alias("key")).union(lib.aims.select("ck")).distinct()
    far = lib.links.where("form in ('container', 'sharpened')").join(keys.hint("shuffle_merge"), "key", "left_anti")
    return reduce(DataFrame.unionByName, [of_links(x) for x in (local, broad, far)])


UPPER = "s.kind not in ('test', 'capability')"


@rule("C5_leads_to_form", f"select l.ck, l.src as id, field, ref from {OWN} where field = 'leads_to' and form in ('container', 'sharpened') and {UPPER}", "leads_to names another paper; author it there as grounded_in")
def leads_to_form(lib: Container) -> DataFrame:
    return of_links(of_kind(lib, ["leads_to"]).where(has_broad()).where("form in ('container', 'sharpened')"))


@rule("C6_leads_to_kind", f"select l.ck, l.src as id, field, ref from {OWN} left {END} where field = 'leads_to' and form = 'local' and {UPPER} and coalesce(t.kind, s.kind) <> s.kind union all select l.ck, l.src, field, ref from {OWN} left join tb_draft_broad b on b.slug = l.ref where field = 'leads_to' and form = 'broad' and {UPPER} and coalesce(b.kind, concat('broad ', s.kind)) <> concat('broad ', s.kind)", "leads_to joins slices of one kind")
def leads_to_kind(lib: Container) -> DataFrame:
    led = of_kind(lib, ["leads_to"]).where(has_broad())
    both = of_links(to_kind(lib, led.where("form = 'local'")).where("kind <> dst_kind"))
    return both.unionByName(of_links(to_broad(lib, led).where("kind <> dst_kind")))


def target_sql(fields: str, kind: str) -> str:
    return f"select l.ck, l.src as id, field, ref from {OWN} {END} where field in ({fields}) and form in ('local', 'sharpened') and {UPPER} and t.kind <> '{kind}' union all select l.ck, l.src, field, ref from {OWN} join tb_draft_broad b on b.slug = l.ref where field in ({fields}) and form = 'broad' and {UPPER} and b.kind <> 'broad {kind}'"


def wrong_target(lib: Container, fields: list[str], kind: str) -> DataFrame:
    """Links of these fields to a slice or broad node of another kind; containers, and what isn't resolved, may pass."""
    x = of_kind(lib, fields).where(has_broad())
    ends = of_links(to_kind(lib, x.where("form in ('local', 'sharpened')")).where(F.col("dst_kind") != kind))
    return ends.unionByName(of_links(to_broad(lib, x).where(F.col("dst_kind") != kind)))


@rule("C7_answers_target", target_sql("'answers'", "question"), "answers names no question")
def answers_target(lib: Container) -> DataFrame:
    return wrong_target(lib, ["answers"], "question")


@rule("C8_lateral_target", target_sql("'corroborates', 'contradicts'", "claim"), "a lateral link names no claim")
def lateral_target(lib: Container) -> DataFrame:
    return wrong_target(lib, ["corroborates", "contradicts"], "claim")


@rule("C9_floor_on_claims", "select ck, id, cast(null as string) as field, cast(null as string) as ref from tb_draft_slices where axiom and kind <> 'claim'", "floor: true stands on claims alone")
def floor_on_claims(lib: Container) -> DataFrame:
    return lib.slices.where("axiom and kind <> 'claim'")


@rule("C10_tests_in_papers", "select ck, id, cast(null as string) as field, cast(null as string) as ref from tb_draft_slices s where kind in ('test', 'capability') and exists (select 1 from tb_draft_papers p where p.ck = s.ck)", "tests and capabilities belong to aims")
def tests_in_papers(lib: Container) -> DataFrame:
    return lib.slices.where("kind in ('test', 'capability')").join(lib.papers.select("ck").hint("shuffle_merge"), "ck", "left_semi")


@rule("C11_test_fields", f"select l.ck, l.src as id, field, ref from {OWN} where field in ('discriminates', 'enabled_by') and s.kind <> 'test'", "a field of tests alone")
def test_fields(lib: Container) -> DataFrame:
    return of_links(of_kind(lib, ["discriminates", "enabled_by"]).where("kind <> 'test'"))


@rule("C12_fields_on_tests", f"select l.ck, l.src as id, field, ref from {OWN} where field in ('answers', 'corroborates', 'contradicts', 'leads_to') and s.kind in ('test', 'capability')", "not a field of tests and capabilities")
def fields_on_tests(lib: Container) -> DataFrame:
    return of_links(of_kind(lib, ["answers", "corroborates", "contradicts", "leads_to"]).where("kind in ('test', 'capability')"))


@rule("C13_lonely_tests", f"select l.ck, l.src as id, min(field) as field, min(ref) as ref from {OWN} where field = 'discriminates' and s.kind = 'test' group by l.ck, l.src having count(*) = 1", "a test discriminates two targets or more; one is plain grounding")
def lonely_tests(lib: Container) -> DataFrame:
    x = of_kind(lib, ["discriminates"]).where("kind = 'test'")
    return x.groupBy("ck", F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("field").alias("field"), F.min("ref").alias("ref")).where("n = 1")


@rule("C14_discriminates_claims", f"select l.ck, l.src as id, field, ref from {OWN} {END} where field = 'discriminates' and form in ('local', 'sharpened') and s.kind = 'test' and t.kind <> 'claim'", "a test discriminates claims")
def discriminates_claims(lib: Container) -> DataFrame:
    return of_links(to_kind(lib, of_kind(lib, ["discriminates"]).where("kind = 'test' and form in ('local', 'sharpened')")).where("dst_kind <> 'claim'"))


@rule("C15_enabled_by_capability", f"select l.ck, l.src as id, field, ref from {OWN} left {END} where field = 'enabled_by' and s.kind = 'test' and (form not in ('local', 'sharpened') or t.kind is null or t.kind <> 'capability')", "enabled_by names a capability")
def enabled_by_capability(lib: Container) -> DataFrame:
    """Here an unresolved reference is an error too."""
    x = to_kind(lib, of_kind(lib, ["enabled_by"]).where("kind = 'test'"), "left")
    return of_links(x.where("form not in ('local', 'sharpened') or dst_kind is null or dst_kind <> 'capability'"))


@rule("C16_broad_ladder", "select b.slug as ck, cast(null as string) as id, 'leads_to' as field, b.leads_to as ref from tb_draft_broad b left join tb_draft_broad p on p.slug = b.leads_to where b.leads_to is not null and (p.slug is null or p.kind <> b.kind)", "a step to an unknown slug or another kind")
def broad_ladder(lib: Container) -> DataFrame:
    known = lib.broad.select(F.col("slug").alias("leads_to"), F.col("kind").alias("up"))
    x = lib.broad.where("leads_to is not null").join(known.hint("shuffle_merge"), "leads_to", "left").where("up is null or up <> kind")
    return x.select(F.col("slug").alias("ck"), F.lit("leads_to").alias("field"), F.col("leads_to").alias("ref"))


def cycle_sql(steps: str) -> str:
    return f"""with recursive s as ({steps}),
p(first, last, path) as (select a, b, concat(a, ' -> ', b) from s union all select first, s.b, concat(path, ' -> ', s.b) from p join s on s.a = p.last where p.first <> p.last and (s.b = p.first or strpos(concat(' ', path, ' '), concat(' ', s.b, ' ')) = 0))
select distinct first as ck, cast(null as string) as id, '__field' as field, path as ref from p where first = last"""


def cycle_rows(steps: DataFrame, field: str) -> DataFrame:
    return simple_cycles(steps).select(F.col("path")[0].alias("ck"), F.lit(field).alias("field"), F.array_join("path", " -> ").alias("ref"))


@rule("C17_broad_cycles", cycle_sql("select slug as a, leads_to as b from tb_draft_broad where leads_to is not null").replace("__field", "leads_to"), "a cycle of the ladder")
def broad_cycles(lib: Container) -> DataFrame:
    """Cycles of the ladder from each of their nodes, with their paths; a step to itself is one."""
    return cycle_rows(lib.broad.where("leads_to is not null").select(F.col("slug").alias("src"), F.col("leads_to").alias("dst")), "leads_to")


@rule("C18_topics", "select slug as ck, cast(null as string) as id, 'slug' as field, slug as ref from tb_draft_topics t where exists (select 1 from tb_draft_broad b where b.slug = t.slug) union all select t.slug, null, 'broader', t.broader from tb_draft_topics t where broader is not null and not exists (select 1 from tb_draft_topics u where u.slug = t.broader)", "a topic's slug names a broad node, or its broader topic is unknown")
def topic_rules(lib: Container) -> DataFrame:
    clash = lib.topics.join(lib.broad.select("slug").hint("shuffle_merge"), "slug", "left_semi").select(F.col("slug").alias("ck"), F.lit("slug").alias("field"), F.col("slug").alias("ref"))
    lost = lib.topics.where("broader is not null").join(lib.topics.select(F.col("slug").alias("broader")).hint("shuffle_merge"), "broader", "left_anti").select(F.col("slug").alias("ck"), F.lit("broader").alias("field"), F.col("broader").alias("ref"))
    return clash.unionByName(lost)


@rule("C18_topic_cycles", cycle_sql("select slug as a, broader as b from tb_draft_topics where broader is not null").replace("__field", "broader"), "a cycle of broader topics")
def topic_cycles(lib: Container) -> DataFrame:
    return cycle_rows(lib.topics.where("broader is not null").select(F.col("slug").alias("src"), F.col("broader").alias("dst")), "broader")


NARRATIVE = """(select bullet as ck, ref, case when strpos(ref, ':') > 0 then 'sharpened' when ref[1] = '@' then 'container' when regexp_matches(ref, '^(oq|[bcqmtk])[0-9]+$') then 'local'
  when regexp_matches(ref, '^[A-Z][A-Za-z]*[0-9]{4}') then 'container' else 'broad' end as form from tb_draft_refs)"""


@rule("C19_narrative_refs", f"""
select ck, cast(null as string) as id, case form when 'local' then 'ambiguous' else 'dangling' end as field, ref from {NARRATIVE} l
where form = 'local' or (form = 'sharpened' and not exists (select 1 from tb_draft_slices s where concat(s.ck, ':', s.id) = l.ref)) or (form = 'broad' and not exists (select 1 from tb_draft_broad b where b.slug = l.ref))
  or (form = 'container' and not exists (select 1 from tb_draft_papers p where p.ck = l.ref) and not exists (select 1 from tb_draft_aims a where a.ck = l.ref))""", "a narrative's reference is local, or resolves to nothing")
def narrative_refs(lib: Container) -> DataFrame:
    """A narrative is no container, so a local reference is ambiguous; a sharpened one must name a slice that exists."""
    x = lib.refs.select(F.col("bullet").alias("ck"), "ref", ref_form(F.col("ref")).alias("form"))
    out = lambda df, why: df.select("ck", F.lit(why).alias("field"), "ref")
    slices, keys = lib.slices.select(F.concat_ws(":", "ck", "id").alias("ref")), lib.papers.select(F.col("ck").alias("ref")).union(lib.aims.select("ck"))
    known = {"sharpened": slices, "broad": lib.broad.select(F.col("slug").alias("ref")), "container": keys}
    lost = [out(x.where(F.col("form") == form).join(df.distinct().hint("shuffle_merge"), "ref", "left_anti"), "dangling") for form, df in known.items()]
    return reduce(DataFrame.unionByName, lost, out(x.where("form = 'local'"), "ambiguous"))


# The types a paper may have, and the keys that are derived and never authored.
TYPES = ["original", "review", "methods", "perspective", "commentary"]
DERIVED = ["status", "evidence", "role", "polarity"]


@rule("C20_enums_and_keys", """
select ck, cast(null as string) as id, 'type' as field, type as ref from tb_draft_papers where type not in ('original', 'review', 'methods', 'perspective', 'commentary')
union all select ck, null, 'key', k from (select ck, unnest(string_split(given_keys, ',')) as k from tb_draft_papers) x where k in ('status', 'evidence', 'role', 'polarity')""", "a value beyond its enumeration, or a derived key that is authored")
def enums_and_keys(lib: Container) -> DataFrame:
    """Optional: what the schema says of values and keys."""
    types = lib.papers.where(~F.col("type").isin(TYPES)).select("ck", F.lit("type").alias("field"), F.col("type").alias("ref"))
    keys = lib.papers.select("ck", F.lit("key").alias("field"), F.explode(F.split("given_keys", ",")).alias("ref")).where(F.col("ref").isin(DERIVED))
    return types.unionByName(keys)


@rule("C20_leads_to_cycles", cycle_sql("select distinct gid as a, dst as b from tb_draft_links where field = 'leads_to' and form = 'local'").replace("__field", "leads_to"), "a cycle of leads_to")
def leads_to_cycles(lib: Container) -> DataFrame:
    """Optional: slices that lead to each other within a container."""
    return cycle_rows(lib.links.where("field = 'leads_to' and form = 'local'").select(F.col("gid").alias("src"), "dst"), "leads_to")


def violations(lib: Container) -> DataFrame:
    """(rule, ck, id, field, ref, message): what every rule finds; the first error hides none of the others."""
    return reduce(DataFrame.unionByName, [find(lib).select(F.lit(name.split("_")[0]).alias("rule"), "*", F.lit(message).alias("message")) for name, (find, message) in RULES.items()])


@operator("C_all_violations", lambda: "select rule, cast(sum(n) as bigint) as n from (" + " union all ".join(f"select '{name.split('_')[0]}' as rule, count(*) as n from ({text}) q" for name, text in TEXTS.items()) + ") v group by rule")
def all_violations(lib: Library) -> DataFrame:
    """How much each rule finds, 0 for one that finds nothing. Rules are counted one after the other: a plan of all of them at once
    has the broadcasts, joins and loops of each in the driver's memory."""
    counts = [staged(find(lib.draft).agg(F.count("*").alias("n")).select(F.lit(name.split("_")[0]).alias("rule"), "n")) for name, (find, _) in RULES.items()]
    return reduce(DataFrame.unionByName, counts).groupBy("rule").agg(F.sum("n").alias("n"))


def assert_valid(lib: Container, most: int = 10) -> None:
    """Raise with the first violations, if there are any."""
    if bad := violations(lib).limit(most).collect():
        raise ValueError("; ".join(f"{r['rule']} {r['ck']}:{r['id']} {r['field']} {r['ref']}: {r['message']}" for r in bad))
