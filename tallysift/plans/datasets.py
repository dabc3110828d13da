"""Registered queries on contracts, manifests, splits, sweeps, crops, sources and sinks, and their DuckDB forms.

As in ``catalogue``, the driver's tables stand for files: orders for images, order lines for boxes, documents for scored images.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallysift.functions import scalar as fn
from tallysift.operators import fusion, isolate, metrics, neardup, proposals, quality, sweep, validate
from tallysift.plans.catalogue import DOCS_SQL, EDGE, NEAR, _CLOSE, _GROUPS, _HASH, _REGROUP, counts_sql, docs, grouped, hashes, query, ratios_sql, regrouped
from tallysift.session import scratch, table
from tallysift.sources import readers, sinks

# --- decisions and details --------------------------------------------------------------------------------


@query(f"with {DOCS_SQL} select doc_id, case when score is null then '' else printf('%.8f', score) end as score, case when crop is null then '' else printf('%.8f', crop) end as crop, replace(printf('%.2f', veto), '.', 'p') as veto_name, final from d")
def detail_text(spark, sf):
    return docs(spark, sf).select("doc_id", *fusion.details_text("score", "crop"), fusion.threshold_name(F.col("veto")).alias("veto_name"), "final")


@query(f"with {DOCS_SQL} select doc_id, (votes >= 1 and score >= 0.22::double and (doc_id % 4 = 0 or veto >= 0.08::double) or coalesce(crop >= 0.97::double, false))::int as decided from d")
def decide_from_details(spark, sf):
    """The details as text; every fourth row was made with the veto off."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("m", "s", "sa", "score", "crop")]
    veto = F.when(F.pmod("doc_id", F.lit(4)) == 0, "").otherwise(F.col("veto").cast("string"))
    stored = docs(spark, sf).select("doc_id", *text, veto.alias("veto"))
    return stored.select("doc_id", fusion.from_details(stored).alias("decided"))


@query(f"with {DOCS_SQL}, b as (select doc_id, (votes >= 1 and score >= 0.22::double)::int as base, veto from d) select doc_id, base, (base = 1 and veto >= 0.3::double)::int as vetoed from b where base <> (base = 1 and veto >= 0.3::double)::int")
def veto_changes(spark, sf):
    stored = docs(spark, sf).select("doc_id", fusion.Rule(veto=None, crop=None).decide(F.col("votes"), F.col("score"), F.col("veto"), F.col("crop")).alias("base"), "veto")
    return fusion.changed(stored.withColumn("vetoed", fusion.vetoed(F.col("base"), F.col("veto"), 0.3)), "base", "vetoed").select("doc_id", "base", "vetoed")


@query("select l_returnflag, count(*) as n from lineitem where l_linenumber <> 7 and abs(l_tax - 0.05::double) < 1e-6 and abs(l_discount - 0.07::double) < 1e-6 group by all")
def rows_at_parameters(spark, sf):
    text = table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_tax").cast("string")).alias("tax"), F.col("l_discount").cast("string").alias("discount"))
    return metrics.counts_by(fusion.at_parameters(text, tax=0.05, discount=0.07), "l_returnflag")


# --- key sets ---------------------------------------------------------------------------------------------


@query(f"with {DOCS_SQL} select doc_id, m, score, final from d")
def guarded_join(spark, sf):
    d = docs(spark, sf)
    return validate.joined({"votes": d.select("doc_id", "m"), "scores": d.select("doc_id", "score"), "decisions": d.select("doc_id", "final")}, "doc_id")


@query("select doc_id, quality from labels where doc_id % 2 = 0")
def restricted_labels(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return validate.restricted(labels, labels.filter(F.pmod("doc_id", F.lit(2)) == 0).select("doc_id"), "doc_id")


@query("""
with n as (select count(distinct doc_id) as n, count(distinct doc_id) filter (doc_id not in (select doc_id from documents)) as o from labels),
m as (select count(distinct doc_id) as n, count(distinct doc_id) filter (doc_id not in (select doc_id from labels)) as o from documents)
select 'labels' as part, n, o as outside, o = 0 as is_subset from n union all select 'documents', n, o, o = 0 from m
""")
def subset_tests(spark, sf):
    labels, documents = table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id")
    one = validate.subset(labels, documents, "doc_id").withColumn("part", F.lit("labels"))
    return one.unionByName(validate.subset(documents, labels, "doc_id").withColumn("part", F.lit("documents")))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'val' when o_orderkey % 5 = 1 then 'calib' else 'train' end as split from orders")
def union_of_splits(spark, sf):
    keys, part = table(spark, sf, "orders").select("o_orderkey"), F.pmod("o_orderkey", F.lit(5))
    return validate.union_of_splits({"val": keys.filter(part == 0), "calib": keys.filter(part == 1), "train": keys.filter(part > 1)}, "o_orderkey")


@query("""
with k as (select doc_id as k, 1 as a, 0 as b, 0 as c, 0 as d from documents union all select doc_id, 0, 1, 0, 0 from labels union all select item_id, 0, 0, 1, 0 from benchmark union all select page_id, 0, 0, 0, 1 from pages),
p as (select k, max(a) as disk, max(b) as labels, max(c) as coco, max(d) as txt from k group by k)
select disk, labels, coco, txt, count(*) as n from p group by all
""")
def four_way_difference(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).alias("k"))
    return validate.difference_report({"disk": key("documents", "doc_id"), "labels": key("labels", "doc_id"), "coco": key("benchmark", "item_id"), "txt": key("pages", "page_id")}, "k")


_NAMES = """names as (select c_name, case when c_custkey % 7 = 0 then upper(c_name) when c_custkey % 11 = 0 then c_name || 'x' else c_name end as given, c_custkey, c_acctbal from customer)"""


def given_names(spark, sf):
    """Canonical names and the given ones, of which some differ by case and some altogether."""
    key, name = F.col("c_custkey"), F.col("c_name")
    given = F.when(F.pmod(key, F.lit(7)) == 0, F.upper(name)).when(F.pmod(key, F.lit(11)) == 0, F.concat(name, F.lit("x"))).otherwise(name)
    return table(spark, sf, "customer").select(key, name, given.alias("given"))


@query(f"with {_NAMES} select given as key, case when c_custkey % 7 = 0 then c_name end as canonical from names where given <> c_name")
def case_matches(spark, sf):
    n = given_names(spark, sf)
    return validate.case_matches(n.select(F.col("given").alias("name")), n.select(F.col("c_name").alias("name")), "name")


@query("select sha256(string_agg(n, chr(10) order by n)) as names_sha256, count(*) as n from (select distinct n_name as n from nation)")
def names_digest(spark, sf):
    return validate.names_digest(table(spark, sf, "nation"), "n_name")


# --- manifests and verdicts -------------------------------------------------------------------------------


_FROZEN = """select (select count(*) from customer) as universe, (select count(*) from customer where c_custkey % 50 = 0) as no_label, (select count(*) from customer where c_custkey % 60 = 1) as no_annotation,
  0::bigint as not_on_disk, 0::bigint as repeated, (select count(*) from customer where c_custkey % 50 <> 0 and c_acctbal > 0) as positives, 0::bigint as case_pairs,
  (select sha256(string_agg(c_name, chr(10) order by c_name)) from customer where c_custkey % 50 <> 0) as names_sha256, false as ok"""


def frozen(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).cast("int").alias("label"))
    labels = c.filter(F.pmod("c_custkey", F.lit(50)) != 0)
    return validate.freeze(labels.select("name", "label"), c.filter(F.pmod("c_custkey", F.lit(60)) != 1).select("name"), c.select("name"), "name", "label")


@query(_FROZEN)
def freeze_manifest(spark, sf):
    return frozen(spark, sf)


@query("select 'positives' as field, (count(*) filter (c_custkey % 50 <> 0 and c_acctbal > 0))::varchar as frozen, (count(*) filter (c_custkey % 50 <> 0 and c_acctbal > 0) + 1)::varchar as now from customer")
def manifest_drift(spark, sf):
    was = frozen(spark, sf)
    return validate.drift(was, was.withColumn("positives", F.col("positives") + 1))


_SUBMITTED = f"""{_NAMES}, p as (select given as k, case when c_custkey % 13 = 0 then null else (c_acctbal > 500)::int end as label, c_custkey % 13 = 0 as bad from names where c_custkey % 9 <> 0),
e as (select c_name as k, (c_acctbal > 0)::int as truth from customer)"""


def submitted(spark, sf):
    """Predictions with unreadable values, missing and extra names; truth."""
    key, score = F.col("c_custkey"), table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    rows = given_names(spark, sf).join(score, "c_custkey")
    bad = F.pmod(key, F.lit(13)) == 0
    predicted = rows.filter(F.pmod(key, F.lit(9)) != 0).select(F.col("given").alias("image_name"), F.when(~bad, (F.col("c_acctbal") > 500).cast("int")).alias("label"), F.when(bad, "float").alias("problem"))
    return predicted, rows.select(F.col("c_name").alias("image_name"), (F.col("c_acctbal") > 0).cast("int").alias("truth"))


@query(f"""
with {_SUBMITTED}, g as (select k, label from p where not bad), r as (select e.k, truth, g.label as q from e left join g on g.k = e.k),
errors as (select (select count(*) from p where bad) + (select count(*) from e where k not in (select k from p)) + (select count(*) from p where k not in (select k from e)) as errors),
cover as (select (select count(*) from e) as universe, (select count(*) from g) as parsed, (select count(*) from e where k not in (select k from g)) as missing, (select count(*) from g where k not in (select k from e)) as extra),
c as (select {counts_sql('q')} from r),
m as (select 'strict' as policy, tp, fp, fn, tn, {ratios_sql('(tp + fn + missing_positive)')} from c union all select 'intersection', tp, fp, fn, tn, {ratios_sql('(tp + fn)')} from c)
select policy, case when errors = 0 then 'PASS' else 'FAIL' end as verdict, errors, universe, parsed, missing, extra, tp, fp, fn, tn, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1 from m, errors, cover
""")
def validator_verdict(spark, sf):
    predicted, truth = submitted(spark, sf)
    return validate.verdict(predicted, truth.select("image_name"), truth)


@query(f"""
with {_SUBMITTED} select 'none_missing' as "check", not exists (select 1 from e where k not in (select k from p)) as ok union all select 'none_extra', not exists (select 1 from p where k not in (select k from e))
union all select 'none_repeated', not exists (select k from p group by k having count(*) > 1) union all select 'labels_binary', not exists (select 1 from p where label is null or label not in (0, 1))
""")
def submission_checks(spark, sf):
    predicted, truth = submitted(spark, sf)
    return validate.submission_checks(predicted, truth.select("image_name"), "image_name", "label")


@query(f"with {DOCS_SQL}, c as (select {counts_sql('p')} from (select truth, case when doc_id % 3 <> 0 then final end as p from d)), m as (select 'strict' as policy, *, {ratios_sql('(tp + fn + missing_positive)')} from c union all select 'intersection', *, {ratios_sql('(tp + fn)')} from c) select policy, tp, fp, fn, tn, missing, missing_positive, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1 from m")
def both_policies(spark, sf):
    rows = docs(spark, sf).select("truth", F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("final")).alias("p"))
    return metrics.both_policies(rows, "truth", "p")


@query(f"with {DOCS_SQL}, k as (select doc_id from d where truth is not null order by md5('drop-' || doc_id), doc_id limit 5), c as (select {counts_sql('p')} from (select truth, case when doc_id not in (select doc_id from k) then final end as p from d where truth is not null)), m as (select 'strict' as policy, *, {ratios_sql('(tp + fn + missing_positive)')} from c union all select 'intersection', *, {ratios_sql('(tp + fn)')} from c) select policy, tp, fp, fn, tn, missing, missing_positive, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1 from m")
def metric_demo(spark, sf):
    rows = docs(spark, sf).filter("truth is not null").select("doc_id", "truth", F.col("final").alias("p"))
    return metrics.both_policies(metrics.without_rows(rows, "doc_id", "p", 5), "truth", "p")


@query("""
with b as (select l_orderkey, count(*) as n from lineitem group by all), i as (select o_orderkey as key, case when o_orderkey % 10 <> 0 then (o_orderstatus = 'F')::int end as y, coalesce(n, 0) as n from orders left join b on l_orderkey = o_orderkey)
select key, case when y = 1 and n = 0 then 'positive_without_box' when y = 0 and n > 0 then 'negative_with_box' when y is null then 'no_label' end as problem from i where y is null or y = 1 and n = 0 or y = 0 and n > 0
""")
def box_label_problems(spark, sf):
    boxes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    label = F.when(F.pmod("o_orderkey", F.lit(10)) != 0, (F.col("o_orderstatus") == "F").cast("int"))
    images = table(spark, sf, "orders").select("o_orderkey", label.alias("label")).join(boxes, "o_orderkey", "left")
    return validate.box_label_problems(images, "o_orderkey", "label", "n")


@query("select p_partkey::varchar as file, 'precision' as key, p_size / 100::double as value from part union all select p_partkey::varchar, 'recall', p_retailprice from part")
def json_numbers(spark, sf):
    """A report of each part: recall two levels down and, deeper and so without effect, under another spelling."""
    deep = F.struct(F.struct(F.lit(0.5).alias("RECALL")).alias("z"))
    report = F.struct(F.array(F.struct(F.col("p_retailprice").alias("Recall"))).alias("runs"), (F.col("p_size") / 100).alias("precision"), F.struct(F.array(deep).alias("more")).alias("old"))
    return validate.json_numbers(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file"), F.to_json(report).alias("content")))


# --- images, labels, boxes --------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'N'")
def manifest_yolo(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "yolo").when(F.col("l_returnflag") == "A", "gt").otherwise("negative_tile")
    return proposals.of_type(table(spark, sf, "lineitem").withColumn("proposal_type", kind)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, count(l_orderkey) as n_boxes, coalesce(string_agg(l_partkey::varchar, ',' order by l_partkey), '') as parts from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def images_with_boxes(spark, sf):
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    rows = proposals.with_boxes(table(spark, sf, "orders").select("o_orderkey"), boxes, "o_orderkey", "l_partkey")
    return rows.select("o_orderkey", F.col("n_boxes").cast("long").alias("n_boxes"), F.array_join("boxes", ",").alias("parts"))


_TEXTS = """a as (select l_orderkey as k, string_agg(case when l_quantity > 45 then '0 0.5 0.5 1 1' else ' ' end, chr(10)) as t from lineitem where l_orderkey % 3 <> 0 group by l_orderkey),
b as (select l_orderkey as k, '0 0.1 0.1 1 1' as t from lineitem where l_orderkey % 3 <> 1 group by l_orderkey)"""


@query(f"with {_TEXTS} select o_orderkey, (trim(coalesce(a.t, b.t, ''), ' ' || chr(10)) <> '')::int as label, a.t is null and b.t is null as missing from orders left join a on a.k = o_orderkey left join b on b.k = o_orderkey")
def text_labels(spark, sf):
    """Label texts in two folders: the first holds two of three orders, some of them blank."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    first = lines.filter(F.pmod("o_orderkey", F.lit(3)) != 0).groupBy("o_orderkey").agg(F.array_join(F.collect_list(F.when(F.col("l_quantity") > 45, "0 0.5 0.5 1 1").otherwise(" ")), "\n").alias("content"))
    second = lines.filter(F.pmod("o_orderkey", F.lit(3)) != 1).select("o_orderkey", F.lit("0 0.1 0.1 1 1").alias("content")).distinct()
    return proposals.text_labels(table(spark, sf, "orders"), first, second, "o_orderkey")


@query("""
with b as (select l_orderkey, l_linenumber, l_quantity / 100 as cx, l_tax * 10 as cy, l_discount + 0.0 as w, l_quantity / 200 as h from lineitem)
select o_orderkey, l_linenumber as line_no, (cx - w / 2) * 640 as x1, (cy - h / 2) * 480 as y1, (cx + w / 2) * 640 as x2, (cy + h / 2) * 480 as y2 from orders left join b on l_orderkey = o_orderkey
""")
def pixel_boxes(spark, sf):
    labels = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line_no"), (F.col("l_quantity") / 100).alias("cx"), (F.col("l_tax") * 10).alias("cy"), (F.col("l_discount") + 0.0).alias("w"), (F.col("l_quantity") / 200).alias("h")
    )
    images = table(spark, sf, "orders").select("o_orderkey", F.lit(640).alias("width"), F.lit(480).alias("height"))
    return proposals.pixel_boxes(images, labels, "o_orderkey")


@query("""
with i as (select p_partkey, 100 + p_size * 13 as w, 80 + (p_partkey % 900)::int as h from part), g as (select *, w // 160 as a, h // 160 as d from i),
t as (select p_partkey, a, unnest(range(0, a * d)) as tile from g)
select p_partkey, tile::int as tile, (tile % a * 160)::int as x1, (tile // a * 160)::int as y1, (tile % a * 160 + 160)::int as x2, (tile // a * 160 + 160)::int as y2 from t
""")
def image_tiles(spark, sf):
    images = table(spark, sf, "part").select("p_partkey", (100 + F.col("p_size") * 13).alias("width"), (80 + F.pmod("p_partkey", F.lit(900))).cast("int").alias("height"))
    return proposals.tiles(images, "p_partkey", 160)


@query("select c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::ubigint::decimal(20, 0) as seed from customer")
def hash_seeds(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", proposals.hash_seed(F.col("c_name")).alias("seed"))


@query("select n_boxes, count(*) as images from (select o_orderkey, count(l_orderkey) as n_boxes from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey) group by n_boxes")
def boxes_per_image(spark, sf):
    return quality.boxes_per_image(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("select l_returnflag, count(*) as n, quantile_cont(l_quantity * l_extendedprice, 0.5) as median_area from lineitem group by l_returnflag")
def category_areas(spark, sf):
    return quality.median_area(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_quantity") * F.col("l_extendedprice"))


@query("select count(*) as boxes, count(*) filter (l_linenumber = 3 or l_linenumber = 5) as incomplete, count(*) filter (l_linenumber not in (3, 5) and l_quantity <= 2) as no_area, count(*) filter (l_linenumber not in (3, 5) and l_extendedprice + l_quantity - 2 > 60002) as outside from lineitem")
def incomplete_annotations(spark, sf):
    n = F.col("l_linenumber")
    b = table(spark, sf, "lineitem").select(
        F.when(n != 3, F.col("l_extendedprice")).alias("x"), F.lit(1.0).alias("y"), (F.col("l_quantity") - 2).alias("w"), F.when(n != 5, F.lit(2.0)).alias("h"), F.lit(60000).alias("width"), F.lit(8).alias("height")
    )
    return quality.annotation_audit(b)


@query("""
select l_returnflag as cls, count(*) as boxes, count(distinct l_orderkey) as images, count(distinct l_orderkey) as with_box from lineitem group by l_returnflag
union all select null, count(*), (select count(*) from orders), count(distinct l_orderkey) from lineitem
""")
def detection_totals(spark, sf):
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return metrics.detection_totals(table(spark, sf, "orders").select("o_orderkey"), boxes, "o_orderkey", "l_returnflag")


@query("""
with d as (select l_orderkey::varchar as image_name, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as o, l_linenumber as c, l_discount + 0.00005 as s, l_quantity + 0.9 as x, -l_tax * 100 as y from lineitem)
select image_name, o::int as ordinal, c as class, round_even(s, 4) as score, trunc(x)::int as x1, trunc(y)::int as y1, trunc(x * 2)::int as x2, trunc(x + 8)::int as y2 from d
""")
def detections_flat(spark, sf):
    x = F.col("l_quantity") + 0.9
    box = F.array(x, -F.col("l_tax") * 100, x * 2, x + 8)
    d = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.struct(F.col("l_linenumber").alias("class_id"), (F.col("l_discount") + 0.00005).alias("score"), box.alias("bbox")).alias("d"))
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("image_name")).agg(F.array_sort(F.collect_list(d)).alias("all"))
    return sinks.detections_flat(per.select("image_name", F.transform("all", lambda r: r["d"]).alias("detections")))


# --- counts and reports -----------------------------------------------------------------------------------


@query("select lang, source, quality, count(*) as n from documents left join labels using (doc_id) group by all")
def outcome_counts(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.counts_by(rows, "lang", "source", "quality")


@query("select distinct array_to_string(string_split(replace(p_type || ' ' || p_name, ' ', '_'), '_')[1:2], '_') as family from part")
def name_families(spark, sf):
    return metrics.families(table(spark, sf, "part").select(F.replace(F.concat_ws(" ", "p_type", "p_name"), F.lit(" "), F.lit("_")).alias("name")), "name")


@query("select event_type, count(value) as n, quantile_cont(value, 0.5) as median, max(value) as peak from events group by event_type")
def stage_latency(spark, sf):
    return quality.stage_latency(table(spark, sf, "events"), "event_type", "value", "value")


@query("select o_orderkey::varchar as path, o_orderdate as modified from orders order by o_orderdate desc, o_orderkey::varchar desc limit 1")
def newest_file(spark, sf):
    return quality.newest(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified")))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y%m%d_%H%M%S') as stamp from orders")
def date_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"))


@query("""
select l_orderkey::varchar || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as file, case when l_linenumber = 4 then null else l_quantity / (l_linenumber - 4) end as result, l_linenumber::bigint as index,
  case when l_linenumber = 4 then 'inference' end as stage, case when l_linenumber = 4 then 'ZeroDivisionError' end as exception_type, case when l_linenumber = 4 then 'float division by zero' end as message from lineitem
""")
def isolated_items(spark, sf):
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").select(name.alias("name"), "l_quantity", F.col("l_linenumber").cast("long").alias("no"))

    def worker(row):
        if row["no"] == 4:
            raise ZeroDivisionError("float division by zero")
        return row["l_quantity"] / (row["no"] - 4)

    return isolate.run_isolated(rows, worker, "name", "inference", index="no")


# --- sweeps -----------------------------------------------------------------------------------------------


@query(f"""with {DOCS_SQL}, t as (select i::int as step, i / 1000::double as threshold from range(0, 1001) r(i)),
c as (select step, threshold, count(*) filter (truth = 1 and score >= threshold) as tp, count(*) filter (truth = 0 and score >= threshold) as fp, count(*) filter (truth = 1 and score < threshold) as fn, count(*) filter (truth = 0 and score < threshold) as tn from t, d where truth is not null group by all)
select * from c""")
def grid_sweep_1001(spark, sf):
    return sweep.grid_sweep(docs(spark, sf), "truth", "score", 1001)


@query(f"""with {DOCS_SQL}, t as (select (i * 5) / 100::double as value from range(1, 20) r(i)),
c as (select value, count(*) filter (truth = 1 and p) as tp, count(*) filter (truth = 0 and p) as fp, count(*) filter (truth = 1 and not p) as fn, count(*) filter (truth = 0 and not p) as tn
  from (select value, truth, votes >= 1 and score >= value and veto >= 0.08::double or coalesce(crop >= 0.97::double, false) as p from t, d where truth is not null) group by value)
select *, {ratios_sql('(tp + fn)', zero=True)} from c""")
def calibration_panel(spark, sf):
    cells = [(5 * i) / 100 for i in range(1, 20)]
    decide = lambda v: fusion.Rule(score=v).decide(F.col("votes"), F.col("score"), F.col("veto"), F.col("crop"))
    return sweep.scored(sweep.rule_sweep(docs(spark, sf), "truth", cells, decide))


def _stage_sql(steps: int, least: float, most: float, rule: str) -> str:
    return f"""with {DOCS_SQL}, t as (select {least}::double + i / {steps - 1}::double * {most - least}::double as value from range(0, {steps}) r(i)),
c as (select value, count(*) filter (truth = 1 and p) as tp, count(*) filter (truth = 0 and p) as fp, count(*) filter (truth = 1 and not p) as fn, count(*) filter (truth = 0 and not p) as tn
  from (select value, truth, {rule} as p from t, d where truth is not null) group by value)
select *, {ratios_sql('(tp + fn)', zero=True)} from c"""


@query(_stage_sql(31, 0.0, 0.3, "votes >= 1 and score >= 0.22::double and veto >= value"))
def veto_sweep(spark, sf):
    cells = [0.0 + i / 30 * (0.3 - 0.0) for i in range(31)]
    decide = lambda v: fusion.Rule(veto=v, crop=None).decide(F.col("votes"), F.col("score"), F.col("veto"), F.col("crop"))
    return sweep.scored(sweep.rule_sweep(docs(spark, sf), "truth", cells, decide))


@query(_stage_sql(11, 0.9, 1.0, "votes >= 1 and score >= 0.22::double and veto >= 0.08::double or coalesce(crop >= value, false)"))
def crop_sweep(spark, sf):
    cells = [0.9 + i / 10 * (1.0 - 0.9) for i in range(11)]
    decide = lambda v: fusion.Rule(crop=v).decide(F.col("votes"), F.col("score"), F.col("veto"), F.col("crop"))
    return sweep.scored(sweep.rule_sweep(docs(spark, sf), "truth", cells, decide))


_AREAS = ", ".join(f"({a / 10}::double)" for a in range(0, 12, 2))
_CELLS = f"""with g as (select c / 100::double as confidence, a.a as area from range(1, 11) r(c), (values {_AREAS}) a(a)),
o as (select o_orderkey, (o_orderstatus = 'F')::int as truth from orders),
l as (select l_orderkey, l_discount + 0.0 as s, l_quantity / 50 as a from lineitem),
h as (select g.confidence, g.area, l_orderkey from g join l on s >= g.confidence and a >= g.area group by all),
c as (select g.confidence, g.area, count(*) filter (truth = 1 and h.l_orderkey is not null) as tp, count(*) filter (truth = 0 and h.l_orderkey is not null) as fp, count(*) filter (truth = 1 and h.l_orderkey is null) as fn, count(*) filter (truth = 0 and h.l_orderkey is null) as tn
  from g cross join o left join h on h.confidence = g.confidence and h.area = g.area and h.l_orderkey = o.o_orderkey group by all)
select *, {ratios_sql('(tp + fn)', zero=True)} from c"""


@query(_CELLS)
def conf_area_sweep_60(spark, sf):
    """Ten confidences by six areas: of each order the largest area among its boxes from each confidence on, no arrays of boxes."""
    confidences, areas = [c / 100 for c in range(1, 11)], [a / 10 for a in range(0, 12, 2)]
    s, a = F.col("l_discount") + 0.0, F.col("l_quantity") / 50
    tops = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(s >= c, a)).alias(f"t{i}") for i, c in enumerate(confidences)])
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("truth")).join(tops, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cells = [F.struct(F.lit(c).alias("confidence"), F.lit(x).alias("area"), F.coalesce(F.col(f"t{i}") >= x, F.lit(False)).cast("int").alias("p")) for i, c in enumerate(confidences) for x in areas]
    flat = rows.select("truth", F.explode(F.array(*cells)).alias("x")).select("truth", "x.*")
    return metrics.confusion(flat, "truth", "p", missing="drop", undefined="zero", by=["confidence", "area"]).drop("missing", "missing_positive")


@query(_CELLS + " order by f1 desc, recall desc, precision desc, confidence, area limit 10")
def conf_area_top10(spark, sf):
    order = [F.col(c).desc() for c in ("f1", "recall", "precision")]
    return conf_area_sweep_60(spark, sf).orderBy(*order, "confidence", "area").limit(10)


# --- near duplicates and splits ---------------------------------------------------------------------------


@query(f"with {_HASH} select id from h a where side = 'val' and exists (select 1 from h b where b.side = 'train' and bit_count(xor(a.h, b.h)) <= {EDGE})")
def near_any(spark, sf):
    h = hashes(spark, sf)
    return neardup.within(h.filter("side = 'val'").select("id", "h"), h.filter("side = 'train'").select("id", "h"), EDGE).select("id")


@query(f"""with recursive {_GROUPS}, q as (select a.id as a, b.id as b, bit_count(xor(a.h, b.h))::int as d from h a join h b on a.id < b.id where bit_count(xor(a.h, b.h)) <= {EDGE}),
l as (select least(x.root, y.root) as x, greatest(x.root, y.root) as y, min(d) as d from q join g x on x.id = q.a join g y on y.id = q.b where x.root <> y.root group by all)
select x, y, d from l order by d, x, y limit 8""")
def closest_groups(spark, sf):
    h, g = grouped(spark, sf)
    return neardup.closest_near_groups(h.join(g, "id").select("id", "h", "root"), EDGE)


@query(f"""with recursive {_REGROUP} select 'before' as state, side as split, count(*) as n, count(*) filter (id % 3 = 0) as pos, round_even(count(*) filter (id % 3 = 0) / count(*)::double, 4) as pos_rate from n group by side
union all select 'after', new_side, count(*), count(*) filter (id % 3 = 0), round_even(count(*) filter (id % 3 = 0) / count(*)::double, 4) from n group by new_side""")
def split_before_after(spark, sf):
    rows = regrouped(spark, sf).withColumn("y", (F.pmod("id", F.lit(3)) == 0).cast("int"))
    return quality.split_summary(rows, "side", "new_side", "y")


_PARTS = f"""{_CLOSE}, c as (select n.root, count(*) as n, count(*) filter (n.id % 3 = 0) as pos, count(*) filter (n.id % 3 <> 0) as neg, bool_and(new_side = 'train' and n.id not in (select id from q)) as free from n group by n.root),
o as (select root, coalesce(sum(n) over w, 0) as hn, coalesce(sum(pos) over w, 0) as hp, coalesce(sum(neg) over w, 0) as hg from c where free window w as (order by n desc, root rows between unbounded preceding and 1 preceding)),
t as (select root from o where not (hn >= 90 and hp >= 30 and hg >= 15)),
parts as (select id, root, case when id in (select id from q) then 'quarantine' when new_side = 'val' then 'holdout' when root in (select root from t) then 'calibration' else 'train' end as part, (id % 3 = 0)::int as label, h from n)"""
FLOORS = {"n": 90, "pos": 30, "neg": 15}


def parts(spark, sf):
    label = (F.pmod("id", F.lit(3)) == 0).cast("int")
    rows = regrouped(spark, sf).select("id", "h", "root", F.col("new_side").alias("side"), label.alias("label"))
    return rows, neardup.three_way(rows, EDGE, FLOORS)


@query(f"with recursive {_PARTS} select id, root, part from parts")
def three_way_split(spark, sf):
    return parts(spark, sf)[1]


@query(f"""with recursive {_PARTS}, k as (select part, count(*) as n, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from parts group by part),
f(part, what, floor) as (values ('calibration', 'n', 90::bigint), ('calibration', 'pos', 30), ('holdout', 'n', 10), ('train', 'neg', 100)),
crossing as (select count(*) as v from parts a join parts b on a.id < b.id and bit_count(xor(a.h, b.h)) <= {NEAR} and (a.part = 'holdout' and b.part in ('train', 'calibration') or b.part = 'holdout' and a.part in ('train', 'calibration')))
select f.part || '_' || what as gate, coalesce(case what when 'n' then n when 'pos' then pos else neg end, 0) as value, floor, coalesce(case what when 'n' then n when 'pos' then pos else neg end, 0) >= floor as ok from f left join k using (part)
union all select 'cross_links', v, 0, v = 0 from crossing""")
def split_gates(spark, sf):
    rows, found = parts(spark, sf)
    floors = {"calibration": {"n": 90, "pos": 30}, "holdout": {"n": 10}, "train": {"neg": 100}}
    return neardup.near_gates(found.join(rows.select("id", "h", "label"), "id"), NEAR, floors)


# --- sources and sinks, written to the shared folder and read again -----------------------------------------


@query("select l_returnflag as stem, l_linenumber::int as cls, count(*) as n from lineitem group by all")
def label_files_round_trip(spark, sf):
    """Label files of a folder, one an order flag, each line a box, written by tasks and read again."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("stem"), F.concat_ws(" ", "l_linenumber", F.lit("0.5 0.5 0.25 0.25")).alias("line"))
    content = rows.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content"))
    folder = scratch(spark, "labels")
    sinks.write_label_folders(content.select("stem", F.lit("train").alias("split")), content, folder, ["fire"])
    return metrics.counts_by(readers.label_boxes(spark, f"{folder}/train/labels", only_class=None), "stem", "cls")


@query("select p_partkey::varchar as image_name, p_name as image_path, p_size as label, p_retailprice as score, null::int as prediction_best from part")
def csv_round_trip(spark, sf):
    """A score table as CSV files with a header, written and read with its schema; an absent number is an empty field."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("image_name"), F.col("p_name").alias("image_path"), F.col("p_size").cast("int").alias("label"), F.col("p_retailprice").alias("score"), F.lit(None).cast("int").alias("prediction_best"))
    folder = scratch(spark, "scores")
    part.write.csv(folder, header=True)
    return readers.require_rows(readers.csv_table(spark, folder, readers.SCORES), folder)


@query("select vec_id, len(embedding)::int as dimension, label::int as label from embeddings")
def embedding_cache_round_trip(spark, sf):
    folder = scratch(spark, "cache")
    rows = table(spark, sf, "embeddings")
    sinks.write_embeddings(rows, folder, "m", "train", 64, True)
    assert readers.embedding_cache(spark, folder, "other", rows.count()) is None
    return readers.embedding_cache(spark, folder, "m", rows.count()).select("vec_id", F.size("embedding").alias("dimension"), F.col("label").cast("int").alias("label"))


@query("select c_custkey, c_name, c_acctbal as balance, null::varchar as segment from customer union all select c_custkey, null, null, c_mktsegment from customer")
def union_of_columns(spark, sf):
    c = table(spark, sf, "customer")
    return sinks.union_columns(c.select("c_custkey", "c_name", F.col("c_acctbal").alias("balance")), c.select("c_custkey", F.col("c_mktsegment").alias("segment")), first_seen=True)


@query("select regexp_replace(url, '^.*/', '') as name, len(regexp_replace(url, '^.*/', '')) as n from pages")
def file_names(spark, sf):
    name = F.substring_index("url", "/", -1)
    return table(spark, sf, "pages").select(name.alias("name"), F.length(name).cast("long").alias("n"))


@query("select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as frame_idx from events qualify (row_number() over (partition by user_id order by ts, event_id) - 1) % 5 = 1")
def sampled_frames(spark, sf):
    frames = table(spark, sf, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame_idx"))
    return readers.sampled_frames(frames, 5)


@query("select o_orderkey, case when o_orderstatus = 'F' then 1e-8 + 2 * 0.5 else 0 end as zero, abs((l_n::double / (l_n + 1 + 1e-8) * l_n / (l_n + 2 + 1e-8) * 2 / (l_n / (l_n + 1 + 1e-8) + l_n / (l_n + 2 + 1e-8) + 1e-8))) as f1 from (select o_orderkey, o_orderstatus, count(l_orderkey) as l_n from orders left join lineitem on l_orderkey = o_orderkey group by all)")
def box_level_f1(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(n, "o_orderkey", "left").withColumn("tp", F.coalesce("n", F.lit(0)).cast("double"))
    zero = F.when(F.col("o_orderstatus") == "F", F.lit(1e-8) + 1).otherwise(F.lit(0.0))
    return rows.select("o_orderkey", zero.alias("zero"), metrics.box_f1(F.col("tp"), F.lit(1.0), F.lit(2.0)).alias("f1"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, l_quantity * 2) * greatest(0, l_tax * 100) / (640 * 480) as area, (0.5 - l_discount / 2) * 640 as x1, (0.5 + l_discount / 2) * 640 as x2 from lineitem")
def relative_boxes(spark, sf):
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_quantity") * 2).alias("x2"), (F.col("l_tax") * 100).alias("y2"))
    corners = fn.centre_box_to_corners(F.lit(0.5), F.lit(0.5), F.col("l_discount"), F.lit(1.0), F.lit(640), F.lit(480))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.area_ratio(box, F.lit(640), F.lit(480)).alias("area"), corners["x1"].alias("x1"), corners["x2"].alias("x2"))
