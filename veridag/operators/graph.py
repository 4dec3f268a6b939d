"""References, edges and the properties that follow from them (B and D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import ref_form, short_text, slice_label, valid_rects, work_type
from ..plans.fixpoint import reach
from ..plans.registry import operator
from ..plans.staging import dropped, shared, staged
from ..sources.testbed import Library

FIELDS = ["grounded_in", "leads_to", "corroborates", "contradicts", "answers", "discriminates", "enabled_by"]


def long_from_wide(slices: DataFrame) -> DataFrame:
    """(ck, src, field, ref_pos, ref) of slices(ck, id, one list for each field), in authored order."""
    fields = [f for f in FIELDS if f in slices.columns]
    lists = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("refs")) for f in fields]))
    return slices.select("ck", F.col("id").alias("src"), lists.alias("f")).select("ck", "src", "f.field", F.posexplode("f.refs").alias("ref_pos", "ref"))


def wide(lib: Library) -> DataFrame:
    """Slices with their reference lists, sorted."""
    lists = lib.edges.groupBy("ck", F.col("src").alias("id")).agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("ref")))).alias(f) for f in FIELDS[:5]])
    empty = F.array().cast("array<string>")
    return lib.slices.join(lists, ["ck", "id"], "left").withColumns({f: F.coalesce(f, empty) for f in FIELDS[:5]})


@operator("B1_ref_form", "select field, form, count(*) as n from tb_links group by all")
def ref_forms(lib: Library) -> DataFrame:
    return lib.links.groupBy("field", "form").agg(F.count("*").alias("n"))


@operator("B2_global_ref", "select distinct ck, ref, dst from tb_links where field = 'grounded_in'")
def global_refs(lib: Library) -> DataFrame:
    return lib.links.where("field = 'grounded_in'").select("ck", "ref", "dst").distinct()


@operator("B3_key_tid", "select distinct ref, key, tid from tb_links where form in ('sharpened', 'container', 'broad')")
def keys_and_tids(lib: Library) -> DataFrame:
    return lib.links.where("form <> 'local'").select("ref", "key", "tid").distinct()


@operator("B4_long_edges", "select ck, src, field, row_number() over (partition by ck, src, field order by ref) - 1 as ref_pos, ref from tb_edges")
def long_edge_table(lib: Library) -> DataFrame:
    return long_from_wide(wide(lib)).withColumn("ref_pos", F.col("ref_pos").cast("long"))


@operator("B5_slices_of_papers", "select ck, row_number() over (partition by ck order by case kind when 'claim' then 0 when 'question' then 1 else 2 end, ln) - 1 as ord, id, kind from tb_slices")
def slices_of_papers(lib: Library) -> DataFrame:
    """Groups of a paper as slices: claims, then questions, then methods."""
    groups = ["claim", "question", "method"]
    papers = lib.slices.groupBy("ck").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ln", "id")))), lambda s: s["id"]).alias(k) for k in groups])
    of = lambda k: F.transform(k, lambda i: F.struct(F.lit(k).alias("kind"), i.alias("id")))
    flat = papers.select("ck", F.posexplode(F.concat(*map(of, groups))).alias("ord", "s"))
    return flat.select("ck", F.col("ord").cast("long").alias("ord"), "s.id", "s.kind")


@operator("B6_kind_by_prefix", "select ref, case substr(coalesce(tid, ref), 1, 1) when 't' then 'test' when 'k' then 'capability' when 'm' then 'method' when 'c' then 'claim' when 'q' then 'question' end as kind from (select distinct ref, tid from tb_aim_links where form = 'local') r")
def kinds_by_prefix(lib: Library) -> DataFrame:
    from ..functions.refs import kind_by_prefix

    return lib.aim_links.where("form = 'local'").select("ref", kind_by_prefix(F.col("ref")).alias("kind")).distinct()


def unquoted_refs(files: DataFrame) -> DataFrame:
    """(file, line, ref) of sharpened references that stand unquoted in a reference list of files(file, text)."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    lists = lines.where(F.col("s").rlike(r"^\s*(?:grounded_in|leads_to|corroborates|contradicts|answers|discriminates|enabled_by)\s*:\s*\[|^\s*-\s+@?[A-Za-z]"))
    found = F.regexp_extract_all("s", F.lit(r"""(?<![\w:"'@])(@?[A-Za-z][\w-]*:[ ]?(?:oq|[bcqmtk])\d+)(?![\w"'])"""), F.lit(1))
    return lists.select("file", (F.col("i") + 1).alias("line"), F.explode(found).alias("ref"))


@operator("B7_unquoted_refs", "select ck as file, src as ref, cast(1 as bigint) as line from (select ck, concat(key, ':', tid) as src from tb_links where form = 'sharpened' and field = 'grounded_in') x")
def unquoted_ref_lint(lib: Library) -> DataFrame:
    files = lib.links.where("form = 'sharpened' and field = 'grounded_in'").select(F.col("ck").alias("file"), F.concat(F.lit("  grounded_in: ["), "ref", F.lit("]")).alias("text"))
    return unquoted_refs(files).select("file", "ref", F.col("line").cast("long"))


def flags(lib: Library) -> DataFrame:
    """Slices with is_floor, borrowed, grounded and label."""
    return shared(lib, "flags", lambda: flagged(lib))


def flagged(lib: Library) -> DataFrame:
    ground = lib.links.where("field = 'grounded_in'")
    # Both joins are by node, which slices are moved by once.
    rests = ground.groupBy(F.col("gid").alias("node")).agg(F.max(F.col("form") == "local").alias("has_local"), F.max(F.col("form").isin("container", "sharpened")).alias("borrowed"))
    s = lib.slices.withColumn("node", F.concat_ws(":", "ck", "id")).join(rests.hint("shuffle_merge"), "node", "left").na.fill(False, ["has_local", "borrowed"])
    s = s.withColumn("is_floor", F.col("axiom") | ((F.col("kind") == "method") & ~F.col("has_local"))).withColumn("borrowed", F.col("borrowed") & (F.col("kind") == "claim"))
    reached = reach(s.where("is_floor").select("node"), ground.where("form = 'local'").select(F.col("dst").alias("src"), F.col("gid").alias("dst"))).withColumn("reached", F.lit(True))
    s = s.join(reached.hint("shuffle_merge"), "node", "left").withColumn("grounded", F.coalesce("reached", F.lit(False)) & (F.col("kind") == "claim"))
    return s.withColumn("label", slice_label(F.col("kind"), F.col("is_floor"), F.col("borrowed"), F.col("grounded"))).drop("has_local", "reached")


LABEL = """
select s.ck, s.id, case when kind = 'question' then 'question' when f.id is not null then 'floor' when kind = 'method' then 'model'
  when b.id is not null then 'borrowed' when r.id is not null then 'grounded' else 'plausible' end as label
from tb_slices s left join tb_floor f on f.ck = s.ck and f.id = s.id left join tb_borrowed b on b.ck = s.ck and b.id = s.id left join tb_reach r on r.ck = s.ck and r.id = s.id"""


@operator("B8_slice_label", LABEL)
def slice_labels(lib: Library) -> DataFrame:
    return flags(lib).select("ck", "id", "label")


@operator("q_grounding", f"select label, count(*) as n from ({LABEL}) x group by label")
def grounding(lib: Library) -> DataFrame:
    """Which claims are grounded, borrowed or merely plausible?"""
    return flags(lib).groupBy("label").agg(F.count("*").alias("n"))


@operator("B10_work_type", "select p_type as raw, case when lower(trim(p_type)) in ('review', 'review-article') then 'review' else 'original' end as type from (select distinct p_type from part union all values ('Review'), (' review-article '), ('article')) p")
def work_types(lib: Library) -> DataFrame:
    raw = lib.given("part").select("p_type").distinct().unionAll(lib.spark.createDataFrame([("Review",), (" review-article ",), ("article",)], "p_type string"))
    return raw.select(F.col("p_type").alias("raw"), work_type(F.col("p_type")).alias("type"))


@operator("B11_local_refs", "select ck, src, count(*) filter (where form = 'local') as n_local, string_agg(ref, ',' order by ref) filter (where form = 'local') as refs from tb_links where field = 'grounded_in' group by ck, src")
def local_ref_lists(lib: Library) -> DataFrame:
    from ..functions.refs import local_refs

    kept = local_refs(F.array_sort(F.collect_list("ref")))
    out = lib.edges.where("field = 'grounded_in'").groupBy("ck", "src").agg(kept.alias("refs"))
    return out.select("ck", "src", F.size("refs").cast("long").alias("n_local"), F.when(F.size("refs") > 0, F.array_join("refs", ",")).alias("refs"))


@operator("B12_valid_rects", "select distinct page_x as x, page_x >= 0 and page_x <= 0.99 as ok from (select round(l_discount * 12, 2) as page_x from lineitem) l")
def rect_checks(lib: Library) -> DataFrame:
    x = lib.given("lineitem").select(F.round(F.col("l_discount") * 12, 2).alias("x")).distinct()
    rect = F.array(F.array("x", F.lit(0.0), F.col("x") + 0.01, F.lit(1.0)))
    return x.select("x", valid_rects(rect).alias("ok"))


@operator("B13_short_text", "select doc_id, case when length(t) > 88 then concat(rtrim(substr(t, 1, 87)), '…') else t end as short from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents) d")
def short_texts(lib: Library) -> DataFrame:
    return lib.given("documents").select("doc_id", short_text(F.col("text"), 88).alias("short"))


@operator("D1_method_floor", "select f.ck, f.id from tb_floor f join tb_slices s on s.ck = f.ck and s.id = f.id where kind = 'method'")
def method_floors(lib: Library) -> DataFrame:
    local = lib.links.where("field = 'grounded_in' and form = 'local'").select("ck", F.col("src").alias("id"))
    return lib.slices.where("kind = 'method'").join(local, ["ck", "id"], "left_anti").select("ck", "id")


@operator("D2_axiom_floor", "select f.ck, f.id from tb_floor f join tb_slices s on s.ck = f.ck and s.id = f.id where kind = 'claim'")
def axiom_floors(lib: Library) -> DataFrame:
    """Claims flagged as axioms are floors."""
    return lib.slices.where("kind = 'claim' and axiom").select("ck", "id")


@operator("D3_grounded", "select s.ck, s.id from tb_slices s join tb_reach r on r.ck = s.ck and r.id = s.id where kind = 'claim'")
def grounded(lib: Library) -> DataFrame:
    return flags(lib).where("grounded").select("ck", "id")


@operator("D4_borrowed", "select b.ck, b.id from tb_borrowed b join tb_slices s on s.ck = b.ck and s.id = b.id where kind = 'claim'")
def borrowed(lib: Library) -> DataFrame:
    far = F.exists("grounded_in", lambda r: ref_form(r).isin("container", "sharpened"))
    return wide(lib).where((F.col("kind") == "claim") & far).select("ck", "id")


@operator("D5_answered", "select distinct dst as gid from tb_links l join tb_slices s on s.ck = l.ck and s.id = l.src where field = 'answers' and kind = 'claim'")
def answered(lib: Library) -> DataFrame:
    claims = lib.slices.where("kind = 'claim'").select("ck", F.col("id").alias("src"))
    return lib.links.where("field = 'answers'").join(claims.hint("shuffle_merge"), ["ck", "src"], "left_semi").select(F.col("dst").alias("gid")).distinct()


@operator("D6_broad_meter", """
select ref as slug, count(distinct gid) filter (where field in ('leads_to', 'corroborates')) as support, count(distinct gid) filter (where field = 'contradicts') as contradict
from tb_links l join tb_slices s on s.ck = l.ck and s.id = l.src and kind = 'claim' where form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts') group by ref""")
def broad_meter(lib: Library) -> DataFrame:
    claims = lib.slices.where("kind = 'claim'").select("ck", F.col("id").alias("src"))
    votes = lib.links.where("form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts')").join(claims.hint("shuffle_merge"), ["ck", "src"], "left_semi")
    side = F.when(F.col("field") == "contradicts", "no").otherwise("yes")
    once = votes.select(F.col("ref").alias("slug"), "gid", side.alias("side")).distinct()
    return once.groupBy("slug").agg(F.count_if(F.col("side") == "yes").alias("support"), F.count_if(F.col("side") == "no").alias("contradict"))


@operator("D7_head", "select ck, string_agg(id, ',' order by ln) as head from tb_slices s where kind = 'claim' and not exists (select 1 from tb_edges e where e.ck = s.ck and e.src = s.id and field = 'leads_to') group by ck")
def heads(lib: Library) -> DataFrame:
    led = lib.edges.where("field = 'leads_to'").select("ck", F.col("src").alias("id"))
    top = lib.slices.where("kind = 'claim'").join(led, ["ck", "id"], "left_anti")
    return top.groupBy("ck").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "id"))), lambda s: s["id"]), ",").alias("head"))


def landing_order(papers: DataFrame) -> list:
    """Curated first: pass down (null as -1), year down (null as 0), key; then stubs by year down, key."""
    return [F.col("curated").cast("int").desc(), F.when(F.col("curated"), F.coalesce("pass", F.lit(-1))).otherwise(0).desc(), F.coalesce("year", F.lit(0)).desc(), F.col("ck")]


def ranks(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """df with each row's place in a global order, from 1: rows are sorted by ranges, and the sizes of the ranges before
    are added, so that no task sees all rows."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    held = staged(sorted_)
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id") - F.col("__low") + 1).drop("__part", "__id", "__low", "__n", "__before")


def ranks_within(df: DataFrame, group: str, order: list, name: str = "pos", few: int = 1 << 16) -> DataFrame:
    """df with each row's place in its group, from 1: rows are sorted by ranges, and the sizes of the group's pieces in the
    ranges before are added. No task sees a whole group, nor does a join by group: its keys are pieces, broadcast if few."""
    by = [F.col(group), *order]
    given = staged(df)  # ranges are sampled first, and would derive df twice
    held = staged(given.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    dropped(given)
    pieces = held.groupBy(F.col(group).alias("__of"), F.col("__part").alias("__in")).agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__of").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(pieces.select("__of", "__in", (before - F.col("__low") + 1).alias("__start")))
    starts = starts.hint("broadcast" if starts.count() <= few else "shuffle_merge")
    placed = held.join(starts, F.col(group).eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    return placed.withColumn(name, F.col("__id") + F.col("__start")).drop("__part", "__id", "__of", "__in", "__start")


@operator("D8_landing_order", "select ck, row_number() over (order by curated desc, case when curated then coalesce(pass, -1) else 0 end desc, coalesce(year, 0) desc, ck) as pos from tb_papers")
def landing(lib: Library) -> DataFrame:
    return ranks(lib.papers, landing_order(lib.papers)).select("ck", "pos")


@operator("D9_assembled", f"""
select p.ck, count(s.id) as slices, count(*) filter (where x.label = 'grounded') as grounded, count(*) filter (where x.label = 'borrowed') as borrowed, count(a.gid) as answered
from tb_papers p left join tb_slices s on s.ck = p.ck left join ({LABEL}) x on x.ck = s.ck and x.id = s.id
left join (select distinct dst as gid from tb_links where field = 'answers') a on a.gid = concat(s.ck, ':', s.id) where p.curated group by p.ck""")
def assembled(lib: Library) -> DataFrame:
    f = flags(lib).join(answered(lib).select(F.col("gid").alias("node"), F.lit(1).alias("a")), "node", "left")
    per = f.groupBy("ck").agg(F.count("*").alias("slices"), F.count_if(F.col("label") == "grounded").alias("grounded"), F.count_if(F.col("label") == "borrowed").alias("borrowed"), F.count("a").alias("answered"))
    return lib.papers.where("curated").select("ck").join(per, "ck", "left").na.fill(0)


@operator("D11_claim_balance", "select dst, count(*) filter (where field = 'corroborates') as corr, count(*) filter (where field = 'contradicts') as contra from tb_links where field in ('corroborates', 'contradicts') group by dst")
def claim_balance(lib: Library) -> DataFrame:
    votes = lib.links.where("field in ('corroborates', 'contradicts')")
    return votes.groupBy("dst").agg(F.count_if(F.col("field") == "corroborates").alias("corr"), F.count_if(F.col("field") == "contradicts").alias("contra"))


@operator("D12_prefix_disagreement", "select b.ck, b.id from tb_borrowed b join tb_slices s on s.ck = b.ck and s.id = b.id where kind = 'claim' and s.id[1] <> 'b'")
def prefix_disagreement(lib: Library) -> DataFrame:
    f = borrowed(lib).withColumn("is", F.lit(True))
    claims = lib.slices.where("kind = 'claim'").select("ck", "id").join(f, ["ck", "id"], "left")
    says = F.startswith(F.col("id"), F.lit("b"))
    return claims.where(says != F.coalesce("is", F.lit(False))).select("ck", "id")


@operator("D13_thin_broad", "select b.slug, count(distinct c.slug) + count(distinct l.gid) as children from tb_broad b left join tb_broad c on c.leads_to = b.slug left join tb_links l on l.ref = b.slug and l.field = 'leads_to' group by b.slug having count(distinct c.slug) + count(distinct l.gid) < 2")
def thin_broad(lib: Library) -> DataFrame:
    ends = lib.broad.select(F.col("leads_to").alias("slug"), F.col("slug").alias("child")).unionAll(lib.links.where("field = 'leads_to' and form = 'broad'").select("ref", "gid"))
    n = ends.distinct().groupBy("slug").agg(F.count("*").alias("children"))
    return lib.broad.select("slug").join(n, "slug", "left").na.fill(0).where("children < 2")
