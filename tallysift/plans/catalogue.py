"""Registered queries over the driver's tables and their DuckDB forms.

The tables hold no images, so scores and votes are fixed functions of keys: ``id_score`` gives a number
in [0, 1) for a document, votes are cuts of its length, and truth is its ``quality`` label, which
only some documents have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysift.functions import scalar as fn
from tallysift.operators import bootstrap, fusion, metrics, neardup, proposals, quality, sweep, validate, windows
from tallysift.session import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


# --- scored documents -------------------------------------------------------------------------------------

#: n_chars above which each of the three models votes.
CUTS = {"m": 400, "s": 900, "sa": 2000}


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, truth, m, s, sa, votes, score, veto, crop, final, base, app); a third of crop scores are absent."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    y = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"))
    crop = fn.id_score("c-", F.col("doc_id"))
    rows = d.join(y, "doc_id", "left").select(
        "doc_id",
        "truth",
        *[(F.col("n_chars") > cut).cast("int").alias(k) for k, cut in CUTS.items()],
        fn.id_score("s-", F.col("doc_id")).alias("score"),
        fn.id_score("d-", F.col("doc_id")).alias("veto"),
        F.when(crop >= 1 / 3, crop).alias("crop"),
    )
    rows = rows.withColumn("votes", fusion.vote_count(F.col("m"), F.col("s"), F.col("sa")))
    args = F.col("votes"), F.col("score"), F.col("veto"), F.col("crop")
    return rows.select("*", *[rule.decide(*args).alias(name) for name, rule in fusion.PANEL.items()])


def unit_sql(prefix: str, key: str = "doc_id") -> str:
    return f"(('0x' || substr(md5('{prefix}' || {key}), 1, 8))::bigint / 4294967296::double)"


DOCS_SQL = f"""
d0 as (
  select d.doc_id, l.quality as truth, (n_chars > 400)::int as m, (n_chars > 900)::int as s, (n_chars > 2000)::int as sa,
    {unit_sql('s-', 'd.doc_id')} as score, {unit_sql('d-', 'd.doc_id')} as veto, {unit_sql('c-', 'd.doc_id')} as c0
  from documents d left join labels l on l.doc_id = d.doc_id
),
d1 as (select *, m + s + sa as votes, case when c0 >= 1/3::double then c0 end as crop from d0),
d as (
  select *, (votes >= 1 and score >= 0.22::double and coalesce(veto >= 0.08::double, true) or coalesce(crop >= 0.97::double, false))::int as final,
    (votes >= 1 and score >= 0.22::double and coalesce(veto >= 0.08::double, true))::int as base,
    (votes >= 1 and score >= 0.22::double and coalesce(veto >= 0.08::double, true) or (score >= 0.85::double and veto >= 0.70::double))::int as app
  from d1
)
"""


def counts_sql(prediction: str, truth: str = "truth") -> str:
    return (
        f"count(*) filter ({truth} = 1 and {prediction} = 1) as tp, count(*) filter ({truth} = 0 and {prediction} = 1) as fp, "
        f"count(*) filter ({truth} = 1 and {prediction} = 0) as fn, count(*) filter ({truth} = 0 and {prediction} = 0) as tn, "
        f"count(*) filter ({truth} is not null and {prediction} is null) as missing, count(*) filter ({truth} = 1 and {prediction} is null) as missing_positive"
    )


def ratios_sql(positives: str, zero: bool = False, harmonic: bool = False) -> str:
    p, r = "tp / nullif(tp + fp, 0)::double", f"tp / nullif({positives}, 0)::double"
    f = f"case when tp + fp > 0 and {positives} > 0 then 2 * tp / (tp + fp + {positives})::double end"
    if harmonic:
        f = f"case when {p} > 0 and {r} > 0 then 2 * ({p}) * ({r}) / ({p} + {r}) end"
    wrap = (lambda x: f"coalesce({x}, 0)") if zero else (lambda x: x)
    return f"{wrap(p)} as precision, {wrap(r)} as recall, {wrap(f)} as f1"


@query(f"with {DOCS_SQL} select doc_id, votes::bigint as votes, final from d")
def fusion_decision(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("votes").cast("long").alias("votes"), "final")


@query(f"with {DOCS_SQL} select doc_id, final, base, app, score, (score >= 0.22::double)::int as score_positive, veto, (veto >= 0.08::double)::int as veto_positive, crop, (crop >= 0.97::double)::int as crop_rescue, votes, m, s, sa from d")
def fusion_details(spark, sf):
    return docs(spark, sf).select(
        "doc_id", "final", "base", "app", "score", (F.col("score") >= 0.22).cast("int").alias("score_positive"), "veto",
        (F.col("veto") >= 0.08).cast("int").alias("veto_positive"), "crop", (F.col("crop") >= 0.97).cast("int").alias("crop_rescue"), "votes", "m", "s", "sa",
    )


@query(f"with {DOCS_SQL} select doc_id, base, final from d where base <> final")
def changed_rows(spark, sf):
    return fusion.changed(docs(spark, sf), "base", "final").select("doc_id", "base", "final")


@query(f"with {DOCS_SQL} select doc_id, least(coalesce(m, 0), coalesce(final, 0)) as both_, greatest(coalesce(m, 0), coalesce(final, 0)) as either_ from d")
def and_or_fusion(spark, sf):
    return docs(spark, sf).select("doc_id", fusion.both(F.col("m"), F.col("final")).alias("both_"), fusion.either(F.col("m"), F.col("final")).alias("either_"))


_PANEL = " union all ".join(f"select '{r}' as rule, {counts_sql(r)} from d" for r in ("final", "base", "app"))


@query(f"with {DOCS_SQL}, c as ({_PANEL}) select *, {ratios_sql('(tp + fn)', harmonic=True)} from c")
def rule_panel_metrics(spark, sf):
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("p")) for r in fusion.PANEL]))
    rows = docs(spark, sf).select("truth", rules.alias("x")).select("truth", "x.rule", "x.p")
    return metrics.confusion(rows, "truth", "p", missing="drop", f1="ratios", by=["rule"])


def covered(spark, sf):
    """Predictions for two of three labelled documents: the others are missing."""
    return docs(spark, sf).select("truth", F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("final")).alias("p"))


_COVERED = f"with {DOCS_SQL}, p as (select truth, case when doc_id % 3 <> 0 then final end as p from d)"


@query(f"{_COVERED}, c as (select {counts_sql('p')} from p) select *, {ratios_sql('(tp + fn + missing_positive)')} from c")
def confusion_strict(spark, sf):
    return metrics.confusion(covered(spark, sf), "truth", "p", missing="strict")


@query(f"{_COVERED}, c as (select {counts_sql('p')} from p) select *, {ratios_sql('(tp + fn)', zero=True)} from c")
def confusion_intersection(spark, sf):
    return metrics.confusion(covered(spark, sf), "truth", "p", missing="drop", undefined="zero")


@query(f"{_COVERED}, c as (select {counts_sql('coalesce(p, 0)')} from p) select *, {ratios_sql('(tp + fn)', harmonic=True)} from c")
def confusion_missing_negative(spark, sf):
    return metrics.confusion(covered(spark, sf), "truth", "p", missing="negative", f1="ratios")


# --- key sets ---------------------------------------------------------------------------------------------


@query("""
select 'missing' as kind, doc_id as key from documents where doc_id not in (select doc_id from labels)
union all select 'extra', doc_id + 1000000 from labels where doc_id % 10 = 0
""")
def missing_extra_keys(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    have = labels.unionByName(labels.filter("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id")))
    return validate.key_report(have, table(spark, sf, "documents"), "doc_id")


@query("""
with v as (select doc_id from documents where doc_id % 5 = 0), t as (select doc_id from documents where doc_id % 5 in (0, 1, 2) and doc_id % 7 <> 0), u as (select doc_id from documents),
x as (select doc_id, doc_id in (select doc_id from v) as l, doc_id in (select doc_id from t) as r from u)
select count(*) filter (l) as n_left, count(*) filter (r) as n_right, count(*) filter (l and r) as n_both,
  count(*) filter (not l and not r) as n_uncovered, 0::bigint as n_outside, count(*) filter (l and r) + count(*) filter (not l and not r) = 0 as tiles from x
""")
def keyset_tiling(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return validate.tiling(d.filter("doc_id % 5 = 0"), d.filter("doc_id % 5 in (0, 1, 2) and doc_id % 7 <> 0"), d, "doc_id")


@query("select lower(source) as folded, count(distinct source) as n, list_sort(list(distinct source)) as names from (select source from documents union all select upper(source) from documents where lang = 'en') group by all having count(distinct source) > 1")
def case_collisions(spark, sf):
    d = table(spark, sf, "documents")
    return validate.collisions(d.select("source").unionByName(d.filter("lang = 'en'").select(F.upper("source").alias("source"))), "source")


@query("select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by text having count(*) > 1")
def exact_duplicates(spark, sf):
    per = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")).groupBy("digest")
    return per.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"""
with {DOCS_SQL}, n as (select doc_id, score, veto, truth from d), o as (select doc_id, score + 0.0005::double as score, case when doc_id % 11 <> 0 then veto end as veto, truth from d where doc_id % 13 <> 0)
select n.doc_id, coalesce(n.truth = o.truth, false) as same_bit, coalesce(abs(n.score - o.score) <= 0.001::double, true) and coalesce(abs(n.veto - o.veto) <= 0.001::double, true) as close from n left join o using (doc_id)
""")
def reproduction_diff(spark, sf):
    n = docs(spark, sf).select("doc_id", "score", "veto", "truth")
    o = n.filter("doc_id % 13 <> 0").select("doc_id", (F.col("score") + 0.0005).alias("score"), F.when(F.col("doc_id") % 11 != 0, F.col("veto")).alias("veto"), "truth")
    return fusion.agreement(n, o, "doc_id", "truth", ["score", "veto"])


@query("""
with i as (select doc_id from documents), a as (select doc_id, quality from labels where doc_id % 2 = 0), b as (select doc_id, n_chars from documents where doc_id % 3 = 0)
select i.doc_id, array_to_string(list_filter([case when a.doc_id is null then 'quality' end, case when b.doc_id is null then 'n_chars' end], lambda x: x is not null), ',') as missing
from i left join a using (doc_id) left join b using (doc_id)
""")
def missing_inputs(spark, sf):
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = fusion.missing_inputs(d.select("doc_id"), {"quality": y.filter("doc_id % 2 = 0"), "n_chars": d.filter("doc_id % 3 = 0")}, "doc_id")
    return out.select("doc_id", F.array_join("missing_inputs", ",").alias("missing"))


@query("""
with s as (select source, count(*) as n from documents where lang = 'en' group by source)
select array_to_string(list(source || '=' || n order by source), ', ') as by_stage from s
""")
def failures_by_stage(spark, sf):
    return validate.summary(table(spark, sf, "documents").filter("lang = 'en'").select(F.col("source").alias("stage")))


# --- sweeps -----------------------------------------------------------------------------------------------


@query("""
with v as (select distinct value as v from events), m as (select (v + lead(v) over (order by v)) / 2 as v from v)
select distinct v as threshold from (select v from v union all select v from m union all values (0::double), (1::double)) where v is not null
""")
def threshold_candidates(spark, sf):
    return sweep.threshold_candidates(table(spark, sf, "events"), "value")


_SWEEP = f"""with {DOCS_SQL}, t as (select distinct score as threshold from d where truth is not null),
c as (select threshold, count(*) filter (truth = 1 and score >= threshold) as tp, count(*) filter (truth = 0 and score >= threshold) as fp,
  count(*) filter (truth = 1 and score < threshold) as fn, count(*) filter (truth = 0 and score < threshold) as tn from t, d group by threshold)"""


@query(f"{_SWEEP} select * from c")
def threshold_sweep(spark, sf):
    return sweep.threshold_sweep(docs(spark, sf), "truth", "score")


@query(f"{_SWEEP}, r as (select *, {ratios_sql('(tp + fn)', zero=True)} from c) select * from r order by f1 desc, recall desc, precision desc, threshold limit 1")
def best_threshold(spark, sf):
    return sweep.best_threshold(sweep.scored(sweep.threshold_sweep(docs(spark, sf), "truth", "score")))


@query(f"""{_SWEEP}, r as (select *, {ratios_sql('(tp + fn)', zero=True)} from c)
(select 'recall' as goal, threshold, precision, recall from r where recall >= 0.9 order by precision desc, threshold limit 1)
union all (select 'precision', threshold, precision, recall from r where precision >= 0.85 order by recall desc, threshold limit 1)""")
def threshold_choices(spark, sf):
    rows = sweep.scored(sweep.threshold_sweep(docs(spark, sf), "truth", "score"))
    goals = (("recall", F.col("recall") >= 0.9, F.col("precision")), ("precision", F.col("precision") >= 0.85, F.col("recall")))
    out = None
    for goal, floor, order in goals:
        part = sweep.best(rows.filter(floor), [order, -F.col("threshold")], keep=["threshold", "precision", "recall"]).withColumn("goal", F.lit(goal))
        out = part if out is None else out.unionByName(part)
    return out.filter("threshold is not null").select("goal", "threshold", "precision", "recall")


GRID = {"m": [300, 400], "s": [800, 900, 1000], "sa": [1500, 2000, 2500], "vote_k": [1, 2, 3]}


_SEARCH = f"""
with {DOCS_SQL}, g as (select m.m as gm, s.s as gs, sa.sa as gsa, k.k as vote_k from (values (300), (400)) m(m), (values (800), (900), (1000)) s(s), (values (1500), (2000), (2500)) sa(sa), (values (1), (2), (3)) k(k)),
t as (select i / 20::double as threshold from range(0, 21) r(i)),
x as (select g.gm, g.gs, g.gsa, g.vote_k, d.truth, d.score, ((n.n_chars > gm)::int + (n.n_chars > gs)::int + (n.n_chars > gsa)::int >= vote_k) as yolo from g, d join documents n using (doc_id) where truth is not null),
r as (
  select 'yolo_only' as rule, gm, gs, gsa, vote_k, null::double as threshold, {counts_sql('yolo::int')} from x group by all
  union all select 'and', gm, gs, gsa, vote_k, threshold, {counts_sql('(yolo and score >= threshold)::int')} from x, t group by gm, gs, gsa, vote_k, threshold
  union all select 'or', gm, gs, gsa, vote_k, threshold, {counts_sql('(yolo or score >= threshold)::int')} from x, t group by gm, gs, gsa, vote_k, threshold
),
f as (select *, {ratios_sql('(tp + fn)', zero=True)} from r),
b as (select *, row_number() over (partition by rule, gm, gs, gsa, vote_k order by f1 desc, recall desc, precision desc, threshold) as n from f)
select rule, gm, gs, gsa, vote_k, threshold, tp, fp, fn, tn, precision, recall, f1 from b where n = 1
"""


@query(_SEARCH)
def fusion_search(spark, sf):
    """All rows of the search: the best threshold of each combination of cuts, votes and rule."""
    rows = docs(spark, sf).filter("truth is not null").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    # distinct scores are not needed: thresholds are a small grid, and each document is counted once for all of them
    grid = sweep.grid(spark, gm=GRID["m"], gs=GRID["s"], gsa=GRID["sa"], vote_k=GRID["vote_k"])
    cell = F.floor(F.col("score") * 20).cast("int")
    yolo = sum(((F.col("n_chars") > F.col(c)).cast("int") for c in ("gm", "gs", "gsa")), F.lit(0)) >= F.col("vote_k")
    counted = rows.crossJoin(F.broadcast(grid)).groupBy("gm", "gs", "gsa", "vote_k", yolo.alias("yolo"), cell.alias("cell")).agg(
        F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg")
    )
    steps = spark.range(21).select(F.col("id").cast("int").alias("step"))
    cases = counted.crossJoin(F.broadcast(steps)).withColumn("above", F.col("cell") >= F.col("step"))
    keys = ["gm", "gs", "gsa", "vote_k"]

    def rule(frame, name, hit, by):
        y = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(F.lit(0)))
        return frame.groupBy(*by).agg(y("pos", hit).alias("tp"), y("neg", hit).alias("fp"), y("pos", ~hit).alias("fn"), y("neg", ~hit).alias("tn")).withColumn("rule", F.lit(name))

    alone = rule(counted, "yolo_only", F.col("yolo"), keys).withColumn("threshold", F.lit(None).cast("double"))
    swept = rule(cases, "and", F.col("yolo") & F.col("above"), [*keys, "step"]).unionByName(rule(cases, "or", F.col("yolo") | F.col("above"), [*keys, "step"]))
    swept = swept.withColumn("threshold", F.col("step") / F.lit(20.0)).drop("step")
    best = sweep.best_threshold(sweep.scored(swept), by=["rule", *keys])
    out = best.unionByName(sweep.scored(alone).select(best.columns))
    return out.select("rule", *keys, "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


@query(_SEARCH + "order by f1 desc, recall desc, precision desc, gm, gs, gsa, vote_k, rule limit 20")
def grid_search_top20(spark, sf):
    order = [F.col("f1").desc(), F.col("recall").desc(), F.col("precision").desc(), "gm", "gs", "gsa", "vote_k", "rule"]
    return fusion_search(spark, sf).orderBy(*order).limit(20)


@query("""
with g as (select c.c as confidence, a.a as area from (values (0.02::double), (0.04), (0.06), (0.08)) c(c), (values (0::double), (0.2), (0.5), (0.8)) a(a)),
o as (select o_orderkey, (o_orderstatus = 'F')::int as truth from orders),
h as (select g.confidence, g.area, o.o_orderkey, o.truth, coalesce((select bool_or(l_discount >= g.confidence and l_quantity / 50 >= g.area) from lineitem where l_orderkey = o.o_orderkey), false)::int as p from g, o),
c as (select confidence, area, count(*) filter (truth = 1 and p = 1) as tp, count(*) filter (truth = 0 and p = 1) as fp, count(*) filter (truth = 1 and p = 0) as fn, count(*) filter (truth = 0 and p = 0) as tn from h group by all)
select *, """ + ratios_sql("(tp + fn)", zero=True) + " from c")
def conf_area_sweep(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_discount").alias("score"), (F.col("l_quantity") / 50).alias("area_ratio")).alias("b"))
    boxes = lines.groupBy("l_orderkey").agg(F.collect_list("b").alias("boxes"))
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("truth"))
    rows = orders.join(boxes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cells = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(a).alias("area"), fusion.any_box(F.col("boxes"), c, a).cast("int").alias("p")) for c in (0.02, 0.04, 0.06, 0.08) for a in (0.0, 0.2, 0.5, 0.8)])
    flat = rows.select("truth", F.explode(cells).alias("x")).select("truth", "x.*")
    return metrics.confusion(flat, "truth", "p", missing="drop", undefined="zero", by=["confidence", "area"]).drop("missing", "missing_positive")


# --- boxes ------------------------------------------------------------------------------------------------


@query("""
with b as (select l_orderkey as k, l_linenumber as n, l_discount + 0.0 as score from lineitem),
r as (select *, row_number() over (partition by k order by score desc, n) as o from b)
select o_orderkey, coalesce(score, -1.0::double) as max_crop, 'line' || n as crop_name, (o_orderstatus = 'F' or coalesce(score, -1.0::double) >= 0.09::double)::int as rescued
from orders left join r on r.k = o_orderkey and o = 1
""")
def max_crop_rescue(spark, sf):
    crops = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("line"), "l_linenumber").alias("crop_name"), (F.col("l_discount") + 0.0).alias("score"), F.col("l_linenumber").alias("ordinal")
    )
    # line numbers repeat within orders: equal scores of equal numbers are equal rows
    out = fusion.best_crop(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), crops, "o_orderkey")
    return out.select("o_orderkey", "max_crop", "crop_name", ((F.col("o_orderstatus") == "F") | (F.col("max_crop") >= 0.09)).cast("int").alias("rescued"))


def line_boxes(spark, sf):
    """Boxes of order lines: (l_orderkey, no, confidence, x1, y1, x2, y2), numbered within the order."""
    lines = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    x, y = F.pmod("l_partkey", F.lit(60)).cast("double"), F.pmod("l_suppkey", F.lit(60)).cast("double")
    return lines.select(
        "l_orderkey", F.row_number().over(order).alias("no"), (F.col("l_discount") + 0.0).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 40 + F.col("l_quantity")).alias("x2"), (y + 80).alias("y2")
    )


_BOXES = """b as (
  select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as no, l_discount + 0.0 as confidence,
    (l_partkey % 60)::double as x1, (l_suppkey % 60)::double as y1, (l_partkey % 60)::double + 40 + l_quantity as x2, (l_suppkey % 60)::double + 80 as y2 from lineitem
)"""
_IOU = """(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) /
  (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"""


@query(f"""
with recursive {_BOXES}, s as (select *, row_number() over (partition by l_orderkey order by confidence desc, no) as o from b),
k(l_orderkey, o, kept) as (
  select l_orderkey, 1::bigint, [{{'no': no, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] from s where o = 1
  union all
  select k.l_orderkey, s.o, case when len(kept) < 3 and not list_bool_or(list_transform(kept, lambda t: {_IOU.format(a='t', b='s')} >= 0.5))
    then list_append(kept, {{'no': s.no, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) else kept end
  from k join s on s.l_orderkey = k.l_orderkey and s.o = k.o + 1
)
select l_orderkey, array_to_string(list_transform(kept, lambda t: t.no::varchar), ',') as kept from (select *, row_number() over (partition by l_orderkey order by o desc) as r from k) where r = 1
""")
def greedy_nms(spark, sf):
    kept = proposals.greedy_nms(line_boxes(spark, sf).withColumnRenamed("no", "ordinal"), "l_orderkey", overlap=0.5, keep=3)
    return kept.select("l_orderkey", F.array_join(F.transform("kept", lambda k: k["ordinal"].cast("string")), ",").alias("kept"))


@query(f"""
with {_BOXES}, p as (select b.*, (o_orderstatus = 'F')::int as image_label from b join orders on o_orderkey = l_orderkey where no > 1), t as (select * from b where no = 1),
x as (select p.l_orderkey, p.no, p.image_label, coalesce(max({_IOU.format(a='p', b='t')}), 0) as max_iou from p left join t using (l_orderkey) group by all)
select l_orderkey, no, max_iou, case when max_iou >= 0.3::double then 1 when max_iou <= 0.05::double and image_label = 0 then 0 end as label from x
""")
def proposal_iou_label(spark, sf):
    box = F.struct("x1", "y1", "x2", "y2").alias("box")
    b = line_boxes(spark, sf)
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").cast("int").alias("image_label"))
    return proposals.overlap_labels(b.filter("no > 1").join(status, "l_orderkey").select("l_orderkey", "no", "image_label", box), b.filter("no = 1").select("l_orderkey", box), "l_orderkey", "no")


@query("""
select p_partkey, greatest(0, least(1, (p_size * 7 + p_size * 4 / 2::double) / 300)) as cx, greatest(0, least(1, (p_partkey % 250 + p_size / 2::double) / 200)) as cy,
  greatest(0, least(1, p_size * 4 / 300::double)) as bw, greatest(0, least(1, p_size / 200::double)) as bh from part
""")
def bbox_normalise(spark, sf):
    size, key = F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(250)).cast("double")
    parts = fn.corner_box_to_centre(size * 7, key, size * 4, size, F.lit(300), F.lit(200))
    return table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in parts.items()])


@query("""
with b as (select p_partkey, (p_size * 7)::double as x1, (p_partkey % 150)::double as y1, (p_size * 11)::double as x2, (p_partkey % 150 + p_size)::double as y2 from part),
s as (select *, greatest(greatest(1, x2 - x1) * 1.5::double, greatest(1, y2 - y1) * 1.5::double, 64) as side from b),
c as (select *, least(640, side) as w, least(160, side) as h from s),
e as (select *, least(greatest(0, (x1 + x2) / 2 - w / 2), 640 - w) as l, least(greatest(0, (y1 + y2) / 2 - h / 2), 160 - h) as t from c)
select p_partkey, round_even(l, 0)::int as cx1, round_even(t, 0)::int as cy1, round_even(l + w, 0)::int as cx2, round_even(t + h, 0)::int as cy2, greatest(0, (x2 - x1) * (y2 - y1)) / (640 * 160) as area from e
""")
def expanded_box(spark, sf):
    size, key = F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(150)).cast("double")
    rows = table(spark, sf, "part").withColumn("b", F.struct((size * 7).alias("x1"), key.alias("y1"), (size * 11).alias("x2"), (key + size).alias("y2")))
    e = fn.expanded_box(F.col("b"), F.lit(640), F.lit(160), 0.25, 64)
    return rows.withColumn("e", e).select("p_partkey", *[F.col(f"e.{c}").alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")], fn.area_ratio(F.col("b"), F.lit(640), F.lit(160)).alias("area"))


@query("""
with i as (select p_partkey, 100 + p_size * 13 as w, 80 + (p_partkey % 900)::int as h from part), g as (select *, least(640::double / h, 640::double / w) as scale from i),
n as (select *, trunc(w * scale)::int as new_w, trunc(h * scale)::int as new_h from g)
select p_partkey, scale, new_w, new_h, ((640 - new_w) // 2)::int as pad_x, ((640 - new_h) // 2)::int as pad_y,
  greatest(0, least(w::double, (100 - (640 - w * scale) / 2) / scale)) as x1, greatest(0, least(h::double, (600 - (640 - h * scale) / 2) / scale)) as y2 from n
""")
def letterbox(spark, sf):
    w, h = F.lit(100) + F.col("p_size") * 13, F.lit(80) + F.pmod("p_partkey", F.lit(900)).cast("int")
    parts = fn.letterbox(w, h, 640)
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x1", 100), ("y1", 50), ("x2", 500), ("y2", 600))])
    back = fn.unletterbox(box, w, h, 640)
    return table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in parts.items()], back["x1"].alias("x1"), back["y2"].alias("y2"))


@query("""
with b as (select l_extendedprice as x, l_tax * 100 - 0.5::double as y, l_quantity - 2 as w, (l_linenumber - 1)::double as h, 60000 as width, 8 as height from lineitem)
select count(*) as boxes, 0::bigint as incomplete, count(*) filter (w <= 0 or h <= 0) as no_area,
  count(*) filter (x < -1e-6::double or y < -1e-6::double or x + w > width + 2 or y + h > height + 2) as outside from b
""")
def annotation_audit(spark, sf):
    b = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("x"), (F.col("l_tax") * 100 - 0.5).alias("y"), (F.col("l_quantity") - 2).alias("w"), (F.col("l_linenumber") - 1).cast("double").alias("h"), F.lit(60000).alias("width"), F.lit(8).alias("height")
    )
    return quality.annotation_audit(b)


@query("""
select l_orderkey, string_agg(printf('%d %.6f', l_linenumber, l_quantity), chr(10) order by l_linenumber, l_quantity) as content from (select distinct l_orderkey, l_linenumber, l_quantity from lineitem) group by l_orderkey
""")
def label_lines(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    line = F.format_string("%d %.6f", "l_linenumber", "l_quantity")
    per = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", line.alias("line")))).alias("lines"))
    return per.select("l_orderkey", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


# --- near duplicates --------------------------------------------------------------------------------------

#: Distances that give results on the test vectors, whose hashes are far apart.
NEAR, EDGE = 20, 22


def hashes(spark, sf):
    """(id, h, side): sign hashes of the vectors; every fifth vector is in val."""
    side = F.when(F.pmod("vec_id", F.lit(5)) == 0, "val").otherwise("train")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), fn.sign_hash(F.col("embedding")).alias("h"), side.alias("side"))


_HASH = """h as (
  select vec_id as id, list_aggregate(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then (case when i = 1 then -9223372036854775808 else (1::bigint << (64 - i)) end)::hugeint else 0::hugeint end), 'sum')::bigint as h,
    case when vec_id % 5 = 0 then 'val' else 'train' end as side from embeddings
)"""
_PAIRS = f"{_HASH}, p as (select a.id as a, b.id as b, bit_count(xor(a.h, b.h))::int as d from h a join h b on a.id < b.id where bit_count(xor(a.h, b.h)) <= {NEAR})"
_GROUPS = f"""{_PAIRS}, e as (select a as x, b as y from p union all select b, a from p),
w(x, y) as (select id, id from h union select w.x, e.y from w join e on e.x = w.y),
g as (select x as id, min(y) as root from w group by x)"""
_REGROUP = f"""{_GROUPS}, m as (select g.id, g.root, h.side, h.h from g join h using (id)),
v as (select root, count(*) filter (side = 'val') as v, count(*) filter (side = 'train') as t, min_by(side, id) as s from m group by root),
n as (select m.id, m.root, m.side, m.h, case when v.v > v.t then 'val' when v.v = v.t then v.s else 'train' end as new_side from m join v using (root))"""


@query(f"with {_PAIRS} select * from p")
def hamming_pairs(spark, sf):
    h = hashes(spark, sf)
    return neardup.hamming_pairs(h, h, NEAR)


@query(f"with {_HASH}, x as (select a.id, b.id as nearest, bit_count(xor(a.h, b.h))::int as d, row_number() over (partition by a.id order by bit_count(xor(a.h, b.h)), b.id) as r from h a, h b where a.side = 'val' and b.side = 'train') select id, nearest, d from x where r = 1")
def nearest_hash(spark, sf):
    h = hashes(spark, sf)
    return neardup.nearest(h.filter("side = 'val'"), h.filter("side = 'train'"))


@query(f"with {_HASH}, x as (select a.id, b.id as nearest, bit_count(xor(a.h, b.h))::int as d, row_number() over (partition by a.id order by bit_count(xor(a.h, b.h)), b.id) as r from h a, h b where a.side = 'val' and b.side = 'train') select id, nearest, d from x where r = 1 order by d, id limit 12")
def nearest_top12(spark, sf):
    return nearest_hash(spark, sf).orderBy("d", "id").limit(12)


@query(f"with {_HASH} select count(distinct a.id) as n_left, max(bit_count(xor(a.h, b.h)))::int as max_d, count(*) as pairs from h a join h b on a.side = 'val' and b.side = 'train' and bit_count(xor(a.h, b.h)) <= {EDGE}")
def cross_side_pairs(spark, sf):
    h = hashes(spark, sf)
    pairs = neardup.hamming_pairs(h.filter("side = 'val'"), h.filter("side = 'train'"), EDGE)
    return pairs.agg(F.countDistinct("a").alias("n_left"), F.max("d").alias("max_d"), F.count("*").alias("pairs"))


def grouped(spark, sf):
    h = settle(hashes(spark, sf), "hashes")
    return h, settle(neardup.near_groups(h, NEAR), "groups")


@query(f"with recursive {_GROUPS} select * from g")
def neardup_components(spark, sf):
    return grouped(spark, sf)[1]


@query(f"with recursive {_GROUPS}, s as (select root, count(*) as n from g group by root) select count(*) as clusters, count(*) filter (n = 1) as singletons, array_to_string(list(n order by n desc)[1:10], ',') as top from s")
def cluster_stats(spark, sf):
    sizes = grouped(spark, sf)[1].groupBy("root").agg(F.count("*").alias("n"))
    stats = sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"))
    top = sizes.orderBy(F.col("n").desc()).limit(10).agg(F.array_join(F.sort_array(F.collect_list("n"), asc=False), ",").alias("top"))
    return stats.crossJoin(F.broadcast(top))


@query(f"with recursive {_REGROUP} select id, root, side, new_side from n")
def majority_regroup(spark, sf):
    h, g = grouped(spark, sf)
    return neardup.majority_regroup(g.join(h.select("id", "side"), "id"))


_CLOSE = f"""{_REGROUP}, x as (select a.id, b.id as nearest, bit_count(xor(a.h, b.h))::int as d, row_number() over (partition by a.id order by bit_count(xor(a.h, b.h)), b.id) as r from n a, n b where a.new_side = 'val' and b.new_side = 'train'),
q as (select id from x where r = 1 and d <= {EDGE} union select nearest from x where r = 1 and d <= {EDGE})"""


def regrouped(spark, sf):
    h, g = grouped(spark, sf)
    return settle(neardup.majority_regroup(g.join(h.select("id", "side"), "id")).join(h.select("id", "h"), "id"), "regrouped")


@query(f"with recursive {_CLOSE} select id from q")
def quarantine(spark, sf):
    return neardup.quarantine(regrouped(spark, sf).select("id", "h", F.col("new_side").alias("side")), EDGE)


FLOORS = {"n": 90, "pos": 30, "neg": 15}


@query(f"""
with recursive {_CLOSE}, c as (select n.root, count(*) as n, count(*) filter (n.id % 3 = 0) as pos, count(*) filter (n.id % 3 <> 0) as neg, bool_and(new_side = 'train' and n.id not in (select id from q)) as free from n group by n.root),
o as (select root, n, pos, neg, coalesce(sum(n) over w, 0) as hn, coalesce(sum(pos) over w, 0) as hp, coalesce(sum(neg) over w, 0) as hg from c where free window w as (order by n desc, root rows between unbounded preceding and 1 preceding))
select root, n, pos, neg from o where not (hn >= 90 and hp >= 30 and hg >= 15)
""")
def greedy_calibration(spark, sf):
    rows = regrouped(spark, sf)
    held = neardup.quarantine(rows.select("id", "h", F.col("new_side").alias("side")), EDGE).withColumn("held", F.lit(True))
    free = (F.col("new_side") == "train") & F.col("held").isNull()
    third = F.pmod("id", F.lit(3)) == 0
    clusters = rows.join(held, "id", "left").groupBy("root").agg(F.count("*").alias("n"), F.count_if(third).alias("pos"), F.count_if(~third).alias("neg"), F.bool_and(free).alias("free"))
    return neardup.greedy_until(clusters.filter("free").drop("free"), FLOORS)


BINS = [("0", 0, 0), ("1-4", 1, 4), ("5-8", 5, 8), ("9-12", 9, 12), ("13-16", 13, 16), (">16", 17, 64)]


@query(f"""
with {_HASH}, x as (select a.id, min(bit_count(xor(a.h, b.h))) as d from h a, h b where a.side = 'val' and b.side = 'train' group by a.id),
b(ordinal, bin, lo, hi) as (values (0, '0', 0, 0), (1, '1-4', 1, 4), (2, '5-8', 5, 8), (3, '9-12', 9, 12), (4, '13-16', 13, 16), (5, '>16', 17, 64))
select ordinal, bin, count(d) as n from b left join x on d between lo and hi group by all
""")
def hamming_histogram(spark, sf):
    return metrics.histogram(nearest_hash(spark, sf), "d", BINS)


# --- statistics -------------------------------------------------------------------------------------------


@query("select lang, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percent from documents group by lang")
def label_distribution(spark, sf):
    return metrics.share_of_total(table(spark, sf, "documents"), "lang")


@query("select c.label, count(quality) as n, sum(count(quality)) over () / (3.0::double * greatest(count(quality), 1)) as weight from (values (0::bigint), (1), (2)) c(label) left join labels on quality = label group by c.label")
def class_weights(spark, sf):
    return metrics.class_weights(table(spark, sf, "labels"), "quality", classes=3)


@query("select lang, median(n_chars) as median, list_sort(list(n_chars))[count(*) // 2 + 1] as upper, avg(n_chars) as mean, min(n_chars) as least, max(n_chars) as most from documents group by lang")
def size_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.median("n_chars").alias("median"), metrics.upper_median("n_chars").cast("long").alias("upper"), F.avg("n_chars").alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")
    )


@query("select source as split, count(*) as n, count(*) filter (quality = 1) as pos, count(*) filter (quality = 0) as neg, count(*) filter (quality is null) as missing, round_even(count(*) filter (quality = 1) / count(*)::double, 4) as pos_rate from documents left join labels using (doc_id) group by source")
def split_stats(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return quality.split_stats(rows.withColumnRenamed("source", "split"), "split", "quality")


@query("with r as (select doc_id, row_number() over (order by md5('42-' || doc_id), doc_id) as r, greatest(1, trunc(count(*) over () * 0.2::double)) as v from documents) select doc_id, case when r <= v then 'val' else 'train' end as side from r")
def random_split(spark, sf):
    return quality.random_split(table(spark, sf, "documents"), "doc_id")


_BOOT = f"""with {DOCS_SQL}, u as (select doc_id as unit, row_number() over (order by doc_id) - 1 as no from d where truth is not null), k as (select count(*) as n from u),
w as (select rep, ('0x' || substr(md5(concat_ws('-', 'boot', rep, j)), 1, 12))::bigint % k.n as no, count(*) as k from range(0, 40) r(rep), k, range(0, 100000) x(j) where j < k.n group by all),
m as (select rep, sum(k) filter (truth = 1 and final = 1) as tp, sum(k) filter (truth = 0 and final = 1) as fp, sum(k) filter (truth = 1 and final = 0) as fn from w join u using (no) join d on doc_id = unit group by rep),
r as (select rep, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from m)"""


@query(f"{_BOOT} select quantile_cont(p, 0.025) as p_low, quantile_cont(p, 0.975) as p_high, quantile_cont(r, 0.025) as r_low, quantile_cont(r, 0.975) as r_high, count(*) as reps from r")
def bootstrap_ci(spark, sf):
    rows = docs(spark, sf).filter("truth is not null").select("doc_id", "truth", "final")
    reps = bootstrap.replicates(bootstrap.numbered(rows, "doc_id"), "boot", 40)
    m = bootstrap.replicate_metrics(rows, "doc_id", "truth", "final", reps)
    return _intervals(m)


def _intervals(m):
    both = m.agg(bootstrap.interval(m, "precision").alias("p"), bootstrap.interval(m, "recall").alias("r"), F.count("*").alias("reps"))
    return both.select(F.col("p")[0].alias("p_low"), F.col("p")[1].alias("p_high"), F.col("r")[0].alias("r_low"), F.col("r")[1].alias("r_high"), "reps")


@query(f"""with {DOCS_SQL}, t as (select d.*, source from d join documents using (doc_id) where truth is not null), u as (select unit, row_number() over (order by unit) - 1 as no from (select distinct source as unit from t)), k as (select count(*) as n from u),
w as (select rep, ('0x' || substr(md5(concat_ws('-', 'family', rep, j)), 1, 12))::bigint % k.n as no, count(*) as k from range(0, 200) r(rep), k, range(0, 1000) x(j) where j < k.n group by all),
m as (select rep, sum(k) filter (truth = 1 and final = 1) as tp, sum(k) filter (truth = 0 and final = 1) as fp, sum(k) filter (truth = 1 and final = 0) as fn from w join u using (no) join t on source = unit group by rep),
r as (select rep, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from m)
select quantile_cont(p, 0.025) as p_low, quantile_cont(p, 0.975) as p_high, quantile_cont(r, 0.025) as r_low, quantile_cont(r, 0.975) as r_high, count(*) as reps from r""")
def cluster_bootstrap_ci(spark, sf):
    rows = docs(spark, sf).filter("truth is not null").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    reps = bootstrap.replicates(bootstrap.numbered(rows, "source"), "family", 200)
    return _intervals(bootstrap.replicate_metrics(rows, "source", "truth", "final", reps))


@query(f"""
with {DOCS_SQL}, r as (select doc_id, truth, final as prediction, score, coalesce(crop, -1) as crop,
  least(case when abs(score - 0.22::double) <= 0.03::double then abs(score - 0.22::double) end, case when coalesce(crop, -1) >= 0 and abs(crop - 0.97::double) <= 0.02::double then abs(crop - 0.97::double) end) as margin from d where truth is not null),
p as (select doc_id, 'false_positive' as bucket from (select * from r where truth = 0 and prediction = 1 order by score desc, doc_id limit 4) union all select doc_id, 'false_negative' from r where truth = 1 and prediction = 0)
select * from p union all select doc_id, 'boundary' from (select * from r where margin is not null and doc_id not in (select doc_id from p) order by margin, doc_id limit 5)
""")
def sample_manifest(spark, sf):
    rows = docs(spark, sf).filter("truth is not null").select("doc_id", "truth", F.col("final").alias("prediction"), "score", F.coalesce("crop", F.lit(-1.0)).alias("crop"))
    return quality.sample_manifest(rows, "doc_id")


# --- windows and folds ------------------------------------------------------------------------------------


@query("""
with n as (select c_custkey as id, 'cust_' || (c_custkey % 40) || '_' || lpad((c_custkey // 40)::varchar, 4, '0') as stem, case when (c_custkey // 40) % 5 = 0 then 'val' else 'train' end as side from customer),
s as (select regexp_extract(stem, '^(.+?)[-_](\\d{2,})$', 1) as base, regexp_extract(stem, '^(.+?)[-_](\\d{2,})$', 2)::bigint as no, side from n)
select a.base, min(b.no - a.no) as min_gap, count(*) filter (b.no - a.no < 10) as below_10, count(*) filter (b.no - a.no < 50) as below_50
from s a join s b on a.base = b.base and a.side = 'train' and b.side = 'val' group by a.base
""")
def sequence_gap(spark, sf):
    key = F.col("c_custkey")
    stem = F.concat(F.lit("cust_"), F.pmod(key, F.lit(40)).cast("string"), F.lit("_"), F.lpad(F.floor(key / 40).cast("string"), 4, "0"))
    rows = table(spark, sf, "customer").select(stem.alias("stem"), F.when(F.pmod(F.floor(key / 40), F.lit(5)) == 0, "val").otherwise("train").alias("side"))
    rows = rows.select(fn.sequence_base(F.col("stem")).alias("base"), fn.sequence_number(F.col("stem")).alias("no"), "side")
    return windows.sequence_gaps(rows, "base", "no", "side")


def hits(spark, sf):
    value = F.coalesce(F.col("value") >= 20, F.lit(False))
    return table(spark, sf, "events").withColumn("hit", (F.col("event_type") != "view") & value)


@query("""
with recursive f as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, event_type <> 'view' and coalesce(value >= 20, false) as hit from events),
s(user_id, n, c, k, l) as (
  select distinct user_id, 0::bigint, 0, 0, 'safe' from f
  union all
  select s.user_id, f.n,
    case when f.hit then (case when s.k = 0 then s.c + 1 else s.c end) else greatest(0, s.c - 1) end,
    case when f.hit then greatest(0, s.k - 1) when s.c > 0 then 30 else s.k end,
    case when f.hit then (case when (case when s.k = 0 then s.c + 1 else s.c end) >= 5 then 'danger' else s.l end)
      when greatest(0, s.c - 1) = 0 then 'safe' when greatest(0, s.c - 1) >= 2 then 'warning' else s.l end
  from s join f on f.user_id = s.user_id and f.n = s.n + 1
)
select user_id, max(n) as frames, max_by(c, n) as count, max_by(k, n) as cooldown, max_by(l, n) as level from s group by user_id
""")
def alarm_batch(spark, sf):
    return windows.alarm_batch(hits(spark, sf), "user_id", ["ts", "event_id"], "hit")


@query("""
with g as (select event_id, user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6::double as gap from events)
select event_id, 1 / nullif(avg(gap) over (partition by user_id order by ts, event_id rows between 29 preceding and current row), 0) as rate from g
""")
def fps_moving_avg(spark, sf):
    return windows.moving_rate(table(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"]).select("event_id", "rate")


@query("select event_id, last_value(case when event_id % 3 = 1 then value end ignore nulls) over (partition by user_id order by ts, event_id) as carried from events")
def carry_forward(spark, sf):
    rows = table(spark, sf, "events").withColumn("seen", F.when(F.pmod("event_id", F.lit(3)) == 1, F.col("value")))
    return windows.carry_forward(rows, "user_id", ["ts", "event_id"], "seen").select("event_id", "carried")


@query("select user_id, count(*) filter (event_type = 'error') as hits, count(*) as frames, count(*) filter (event_type = 'error') / count(*)::double as ratio from events group by user_id")
def hit_ratio(spark, sf):
    hit = F.count_if(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(hit.alias("hits"), F.count("*").alias("frames"), F.try_divide(hit, F.count("*")).alias("ratio"))


def losses(spark, sf):
    """A loss a user and month: the mean of values over 10, by fixed cents."""
    e = table(spark, sf, "events").filter("value is not null")
    return e.groupBy(F.pmod("user_id", F.lit(20)).alias("run"), F.pmod("event_id", F.lit(25)).alias("epoch")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 1000.0).alias("loss"))


_LOSS = "l as (select user_id % 20 as run, event_id % 25 as epoch, sum(round(value * 100)::bigint)::double / count(*) / 1000.0::double as loss from events where value is not null group by all)"


@query(f"""
with recursive {_LOSS}, o as (select *, row_number() over (partition by run order by epoch) as n from l),
s(run, n, best, found, bad, stop) as (
  select distinct run, 0::bigint, 'infinity'::double, null::bigint, 0, null::bigint from o
  union all
  select s.run, o.n, case when s.stop is null and o.loss < s.best - 1e-6::double then o.loss else s.best end,
    case when s.stop is null and o.loss < s.best - 1e-6::double then o.epoch else s.found end,
    case when s.stop is not null then s.bad when o.loss < s.best - 1e-6::double then 0 else s.bad + 1 end,
    case when s.stop is not null then s.stop when not (o.loss < s.best - 1e-6::double) and s.bad + 1 >= 5 then o.epoch end
  from s join o on o.run = s.run and o.n = s.n + 1
)
select run, max_by(found, n) as best_epoch, max_by(best, n) as best_loss, arg_max_null(stop, n) as stop_epoch from s group by run
""")
def early_stop(spark, sf):
    return windows.early_stop(losses(spark, sf), "run", "epoch", "loss", patience=5)


@query(f"with {_LOSS}, r as (select *, row_number() over (partition by run order by loss desc, epoch) as r, row_number() over (partition by run order by epoch desc) as e, max(loss) over (partition by run) as top from l) select run, max(epoch) filter (r = 1) as best_epoch, max(top) as best, max(loss) filter (e = 1) / 3600 as hours from r group by run")
def best_epoch(spark, sf):
    return quality.best_epoch(losses(spark, sf), "run", "epoch", "loss", "loss")


# --- documents as JSON, scores of vectors -----------------------------------------------------------------


@query("select json_type(props, '$.k') as kind, count(*) as n from events group by all")
def value_type_census(spark, sf):
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    names = F.when(kind == "BIGINT", "UBIGINT").when(kind == "STRING", "VARCHAR").otherwise(kind)
    return table(spark, sf, "events").groupBy(names.alias("kind")).agg(F.count("*").alias("n"))


#: Files of every kind of problem, as a reader meets them.
FILES = [
    ("ok", '{"a.jpg": 1, "b.jpg": 0}'), ("twice", '{"a.jpg": 1, "a.jpg": 0}'), ("true", '{"a.jpg": true}'), ("float", '{"a.jpg": 1.0}'), ("text", '{"a.jpg": "1"}'),
    ("nan", '{"a.jpg": NaN}'), ("range", '{"a.jpg": 2}'), ("null", '{"a.jpg": null}'), ("list", "[1]"), ("nested", '{"a.jpg": {"label": 1}}'), ("broken", '{"a.jpg": 1'),
]


@query("""
select * from (values ('ok', 'a.jpg', 1, null), ('ok', 'b.jpg', 0, null), ('twice', null, null, 'duplicate_key'), ('true', 'a.jpg', null, 'boolean_not_int'), ('float', 'a.jpg', null, 'float_not_int'),
('text', 'a.jpg', null, 'string_value'), ('nan', null, null, 'syntax'), ('range', 'a.jpg', null, 'value_out_of_range'), ('null', 'a.jpg', null, 'null_value'), ('list', null, null, 'shape'),
('nested', 'a.jpg', null, 'unsupported_value_type'), ('broken', null, null, 'syntax')) t(file, image_name, label, problem)
""")
def strict_json(spark, sf):
    return validate.strict_labels(spark.createDataFrame(FILES, "file string, content string"))


#: Head weights: alternating in sign, falling in size.
WEIGHTS = [(-1) ** i / (i + 1) for i in range(64)]


@query("""
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), m as (select *, list_avg(v) as mu from e), s as (select *, list_avg(list_transform(v, lambda x: (x - mu) * (x - mu))) as var from m)
select vec_id, list_sum(list_transform(range(0, 64), lambda i: (v[i + 1] - mu) / sqrt(var + 1e-5::double) * (case when i % 2 = 0 then 1 else -1 end) / (i + 1)::double)) + 0.1::double as logit from s
""")
def zscore_head(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fn.normed_linear(F.col("embedding"), WEIGHTS, 0.1).alias("logit"))


@query("select vec_id, 1 / (1 + exp(embedding[1]::double - embedding[2]::double)) as share, 1 / (1 + exp(-(list_avg(list_transform(embedding[1:8], lambda x: x::double)) - list_avg(list_transform(embedding[9:24], lambda x: x::double))))) as zero_shot from embeddings")
def softmax_score(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").withColumn("v", v).select(
        "vec_id", fn.positive_share(F.col("v")[0], F.col("v")[1]).alias("share"), fn.zero_shot(F.slice("v", 1, 8), F.slice("v", 9, 16)).alias("zero_shot")
    )


@query("select vec_id, list_sum(list_transform(embedding, lambda x: x::double * x::double)) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings")
def unit_vectors(spark, sf):
    dot = F.aggregate(F.zip_with(F.transform("embedding", lambda x: x.cast("double")), fn.unit(F.col("embedding")), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return table(spark, sf, "embeddings").select("vec_id", dot.alias("norm"))
