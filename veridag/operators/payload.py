"""Payload tables and subgraphs (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import operator
from ..sources.testbed import Library
from .graph import LABEL, broad_meter, flags


def links_of(lib: Library, *fields: str) -> DataFrame:
    return lib.links.where(F.col("field").isin(*fields))


GROUNDS = "select ck, key, tid, src as via from tb_links where field = 'grounded_in' and form in ('container', 'sharpened')"


@operator("H1_grounds", GROUNDS)
def grounds(lib: Library) -> DataFrame:
    return links_of(lib, "grounded_in").where("form in ('container', 'sharpened')").select("ck", "key", "tid", F.col("src").alias("via"))


LATERAL = "select ck, src as via, case field when 'corroborates' then 'corr' else 'contra' end as sign, key, tid, case when form = 'broad' then ref end as slug from tb_links where field in ('corroborates', 'contradicts')"


@operator("H2_lateral", LATERAL)
def lateral(lib: Library) -> DataFrame:
    sign = F.when(F.col("field") == "corroborates", "corr").otherwise("contra")
    return links_of(lib, "corroborates", "contradicts").select("ck", F.col("src").alias("via"), sign.alias("sign"), "key", "tid", F.when(F.col("form") == "broad", F.col("ref")).alias("slug"))


@operator("H3_contributions", "select ck, src as via, ref as slug from tb_links where field = 'leads_to' and form = 'broad'")
def contributions(lib: Library) -> DataFrame:
    return links_of(lib, "leads_to").where("form = 'broad'").select("ck", F.col("src").alias("via"), F.col("ref").alias("slug"))


@operator("H4_answers", "select ck, src as via, key, tid from tb_links where field = 'answers' and key <> ck")
def far_answers(lib: Library) -> DataFrame:
    """Answers to another paper's questions."""
    return links_of(lib, "answers").where("key <> ck").select("ck", F.col("src").alias("via"), "key", "tid")


@operator("H5_builds", f"select g.key as ck, string_agg(concat(g.ck, ':', via), ',' order by g.ck, via) as builders from ({GROUNDS}) g join tb_papers p on p.ck = g.key and p.curated group by g.key")
def builds(lib: Library) -> DataFrame:
    g = grounds(lib).join(lib.papers.where("curated").select(F.col("ck").alias("key")), "key", "left_semi")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("ck", "via"))), lambda s: F.concat_ws(":", s["ck"], s["via"]))
    return g.groupBy(F.col("key").alias("ck")).agg(F.array_join(pairs, ",").alias("builders"))


METER = "select ref, count(distinct gid) filter (where field in ('leads_to', 'corroborates')) as support, count(distinct gid) filter (where field = 'contradicts') as contradict from tb_links where form = 'broad' and field <> 'grounded_in' group by ref"


@operator("H8_broad_record", f"select slug, kind, case when kind = 'broad claim' then coalesce(support, 0) end as support, case when kind = 'broad claim' then coalesce(contradict, 0) end as contradict from tb_broad b left join ({METER}) m on m.ref = b.slug")
def broad_records(lib: Library) -> DataFrame:
    """Broad nodes with their meters, which only claims have."""
    b = lib.broad.select("slug", "kind").join(broad_meter(lib).hint("shuffle_merge"), "slug", "left")
    return b.select("slug", "kind", *[F.when(F.col("kind") == "broad claim", F.coalesce(c, F.lit(0))).alias(c) for c in ("support", "contradict")])


@operator("H9_worklist", "select pos, w.ck from (select okey as pos, ck from tb_papers where okey % 7 = 0) w join tb_papers p on p.ck = w.ck and curated")
def worklist(lib: Library) -> DataFrame:
    """A work list (every seventh order here) kept to curated papers."""
    listed = lib.papers.where("okey % 7 = 0").select(F.col("okey").alias("pos"), "ck")
    return listed.join(lib.papers.where("curated").select("ck"), "ck", "left_semi").select("pos", "ck")


@operator("H10_stub_record", "select ck, title, year, journal from tb_papers where not curated")
def stub_records(lib: Library) -> DataFrame:
    return lib.papers.where("not curated").select("ck", "title", "year", "journal")


FOCUS = "(select ck from tb_papers where okey % 97 = 0)"


def focus(lib: Library) -> DataFrame:
    """Focal containers: every 97th order here."""
    return lib.papers.where("okey % 97 = 0").select("ck")


@operator("H11_isolate", f"select 'paper' as what, ck as node from {FOCUS} f union select 'paper', key from tb_links where key is not null and ck in {FOCUS} union select 'broad', ref from tb_links where form = 'broad' and ck in {FOCUS}")
def isolate(lib: Library) -> DataFrame:
    near = lib.links.join(focus(lib), "ck", "left_semi")
    row = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).alias("node"))
    return row(focus(lib), "paper", "ck").union(row(near.where("key is not null"), "paper", "key")).union(row(near.where("form = 'broad'"), "broad", "ref")).distinct()


@operator("H12_cited_neighbours", f"select l.key as ck, string_agg(distinct tid, ',' order by tid) as cited from tb_links l join tb_papers p on p.ck = l.key and p.curated where l.ck in {FOCUS} and l.key <> l.ck group by l.key")
def cited_neighbours(lib: Library) -> DataFrame:
    """Curated papers that the focal ones cite, whole, with the slices cited."""
    far = lib.links.join(focus(lib), "ck", "left_semi").where("key <> ck").groupBy(F.col("key").alias("ck")).agg(F.array_sort(F.collect_set("tid")).alias("cited"))
    return lib.papers.where("curated").join(far, "ck").select("ck", F.when(F.size("cited") > 0, F.array_join("cited", ",")).alias("cited"))


@operator("H15_target_lookup", """
select distinct l.dst as spec, case when s.ck is not null then 'slice' when p.ck is not null and strpos(l.dst, ':') > 0 then 'paper, slice missing' when p.ck is not null then 'paper' when b.slug is not null then 'broad' else 'unknown' end as found
from tb_links l left join tb_slices s on concat(s.ck, ':', s.id) = l.dst left join tb_papers p on p.ck = split_part(l.dst, ':', 1) left join tb_broad b on b.slug = l.dst""")
def target_lookup(lib: Library) -> DataFrame:
    spec = lib.links.select(F.col("dst").alias("spec")).distinct().withColumn("ck", F.split("spec", ":")[0])
    s = lib.slices.select(F.concat_ws(":", "ck", "id").alias("spec"), F.lit(1).alias("s"))
    p = lib.papers.select("ck", F.lit(1).alias("p"))
    b = lib.broad.select(F.col("slug").alias("spec"), F.lit(1).alias("b"))
    sharp = F.contains("spec", F.lit(":"))
    found = F.when(F.col("s").isNotNull(), "slice").when(F.col("p").isNotNull() & sharp, "paper, slice missing").when(F.col("p").isNotNull(), "paper").when(F.col("b").isNotNull(), "broad").otherwise("unknown")
    return spec.join(s, "spec", "left").join(p, "ck", "left").join(b, "spec", "left").select("spec", found.alias("found"))
