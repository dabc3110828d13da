"""Contract checks: strict label files, key sets, reports of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.functions.scalar import key_kind, value_kind
from tallysift.operators import metrics


def strict_labels(files: DataFrame) -> DataFrame:
    """(file, image_name, label, problem) of rows (file, content): one JSON object {name: 0 or 1} each.

    content may be binary. A file that is no such object gives one row with a problem and no name: encoding,
    bom, syntax, duplicate_key or shape. A value other than the integers 0 and 1 gives its kind as problem.
    """
    is_binary = dict(files.dtypes)["content"] == "binary"
    raw = F.col("content") if is_binary else F.col("content").cast("binary")
    staged = files.select(
        "file",
        raw.alias("raw"),
        F.is_valid_utf8(raw.cast("string")).alias("valid"),
        (F.hex(F.substring(raw, 1, 3)) == "EFBBBF").alias("bom"),
    ).withColumn("text", F.try_validate_utf8(F.col("raw").cast("string")))
    staged = staged.withColumn("v", F.try_parse_json("text")).withColumn("keys", F.json_object_keys("text"))
    whole = (
        F.when(~F.col("valid"), "encoding")
        .when(F.col("bom"), "bom")
        .when(F.col("v").isNull() & (F.size("keys") != F.size(F.array_distinct("keys"))), "duplicate_key")
        .when(F.col("v").isNull(), "syntax")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "shape")
    )
    staged = staged.withColumn("problem", whole)
    bad = staged.filter("problem is not null").select("file", F.lit(None).cast("string").alias("image_name"), F.lit(None).cast("int").alias("label"), "problem")
    good = staged.filter("problem is null").select("file", "v")
    # lateral views need a name in SQL; the argument of sql() gives one that nothing else sees
    rows = good.sparkSession.sql("select file, key, value from {good}, lateral variant_explode(v)", good=good)
    kind = value_kind(F.col("value"))
    labels = rows.select(
        "file",
        F.col("key").alias("image_name"),
        F.when(kind == "ok", F.try_variant_get("value", "$", "int")).alias("label"),
        F.when(kind != "ok", kind).alias("problem"),
    )
    return labels.unionByName(bad)


def key_report(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(kind, key): names expected but missing, or extra; extra names that differ only by case are case_mismatch."""
    have, want = predicted.select(key).distinct(), expected.select(key).distinct()
    missing = want.join(have, key, "left_anti").select(F.lit("missing").alias("kind"), F.col(key).alias("key"))
    extra = have.join(want, key, "left_anti")
    folded = want.select(F.lower(F.col(key).cast("string")).alias("low")).distinct().withColumn("hit", F.lit(True))
    extra = extra.withColumn("low", F.lower(F.col(key).cast("string"))).join(folded, "low", "left")
    return missing.unionByName(extra.select(F.when(F.col("hit"), "case_mismatch").otherwise("extra").alias("kind"), F.col(key).alias("key")))


def tiling(left: DataFrame, right: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """One row: sizes, overlap, keys of the universe in neither, keys outside it, and whether both tile it."""
    tagged = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("u"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"), F.lit(0).alias("u")))
        .unionByName(universe.select(key, F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(1).alias("u")))
    )
    per = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max("u").alias("u"))
    counts = per.agg(
        F.count_if(F.col("l") == 1).alias("n_left"),
        F.count_if(F.col("r") == 1).alias("n_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"),
        F.count_if((F.col("u") == 1) & (F.col("l") + F.col("r") == 0)).alias("n_uncovered"),
        F.count_if((F.col("u") == 0)).alias("n_outside"),
    )
    return counts.withColumn("tiles", (F.col("n_both") + F.col("n_uncovered") + F.col("n_outside")) == 0)


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """(folded, n, names): names that are equal but for case."""
    per = rows.select(F.col(key).alias("name")).distinct().groupBy(F.lower("name").alias("folded"))
    return per.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names")).filter("n > 1")


def name_problems(rows: DataFrame, key: str) -> DataFrame:
    kind = key_kind(F.col(key))
    return rows.select(F.col(key).alias("key"), kind.alias("problem")).filter("problem <> 'ok'")


def validate(predicted: DataFrame, expected: DataFrame, key: str = "image_name") -> DataFrame:
    """(stage, code, key, message) of everything wrong with a prediction table (key, label, problem)."""
    values = predicted.filter("problem is not null").select(
        F.lit("values").alias("stage"), F.col("problem").alias("code"), F.col(key).alias("key"), F.lit("not an integer 0 or 1, or an unreadable file").alias("message")
    )
    names = name_problems(predicted.filter(F.col(key).isNotNull()), key).select(
        F.lit("keys").alias("stage"), F.col("problem").alias("code"), "key", F.lit("not a bare file name").alias("message")
    )
    cover = key_report(predicted.filter(F.col(key).isNotNull()), expected, key).select(
        F.lit("coverage").alias("stage"), F.col("kind").alias("code"), F.col("key").cast("string").alias("key"), F.lit("key sets differ").alias("message")
    )
    twins = collisions(predicted.filter(F.col(key).isNotNull()), key).select(
        F.lit("keys").alias("stage"), F.lit("case_pair").alias("code"), F.col("folded").alias("key"), F.array_join("names", ",").alias("message")
    )
    return values.unionByName(names).unionByName(cover).unionByName(twins)


def summary(failures: DataFrame) -> DataFrame:
    """One row: failures by stage as 'stage=n, stage=n' in order of stage."""
    per = failures.groupBy("stage").agg(F.count("*").alias("n")).select(F.struct("stage", F.concat_ws("=", "stage", "n").alias("t")).alias("s"))
    return per.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), ", ").alias("by_stage"))


# --- key sets ---------------------------------------------------------------------------------------------


class KeySetsDiffer(ValueError):
    """Tables that must have the same keys do not."""


def membership(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one count a table): how often each key of any table occurs in each of them."""
    tagged = None
    for name, t in tables.items():
        part = t.select(F.col(key).alias("key"), *[F.lit(int(name == n)).alias(n) for n in tables])
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("key").agg(*[F.sum(n).cast("long").alias(n) for n in tables])


def difference_report(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(one 0 or 1 a table, n): the number of keys by the tables that have them."""
    flags = [(F.col(n) > 0).cast("int").alias(n) for n in tables]
    return membership(tables, key).select("key", *flags).groupBy(*tables).agg(F.count("*").alias("n"))


def require_same_keys(tables: dict[str, DataFrame], key: str) -> None:
    """Fails with the numbers of missing and repeated keys unless every table has every key exactly once."""
    member = membership(tables, key)
    counts = member.agg(F.count("*").alias("all"), *[F.count_if(F.col(n) == 0).alias(f"no_{n}") for n in tables], *[F.count_if(F.col(n) > 1).alias(f"many_{n}") for n in tables]).first()
    wrong = [f"{n}: {counts['no_' + n]} missing, {counts['many_' + n]} repeated" for n in tables if counts["no_" + n] or counts["many_" + n]]
    if wrong:
        raise KeySetsDiffer(f"of {counts['all']} keys: " + "; ".join(wrong))


def joined(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """The tables joined on their key, which must be the same set in all of them."""
    require_same_keys(tables, key)
    out = None
    for t in tables.values():
        out = t if out is None else out.join(t, key)
    return out


def restricted(labels: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The labels of the names; fails if a name has none."""
    wanted = names.select(key).distinct()
    gaps = wanted.join(labels, key, "left_anti").agg(F.count("*").alias("n"), F.min(key).alias("first")).first()
    if gaps["n"]:
        raise KeySetsDiffer(f"{gaps['n']} names have no label, the first is {gaps['first']}")
    return labels.join(wanted, key, "left_semi")


def subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: keys of part, those that whole lacks, and whether there are none."""
    have, want = part.select(key).distinct(), whole.select(key).distinct().withColumn("found", F.lit(True))
    counts = have.join(want, key, "left").agg(F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("outside"))
    return counts.withColumn("is_subset", F.col("outside") == 0)


def union_of_splits(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of the splits with their split's name; fails if a key is in two of them or twice in one."""
    out = None
    for name, t in splits.items():
        part = t.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    twice = out.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n")).first()["n"]
    if twice:
        raise KeySetsDiffer(f"{twice} keys occur more than once over all splits")
    return out


def case_matches(predicted: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """(key, canonical): predicted keys that no canonical key equals, and the least one that is equal but for case (null: none)."""
    alone = predicted.select(key).distinct().join(canonical, key, "left_anti").withColumn("low", F.lower(F.col(key)))
    folded = canonical.select(F.lower(F.col(key)).alias("low"), F.col(key).alias("name")).groupBy("low").agg(F.min("name").alias("canonical"))
    return alone.join(folded, "low", "left").select(F.col(key).alias("key"), "canonical")


def names_digest(rows: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 of the distinct names in order, joined by line ends. The names of a manifest are held in one row."""
    names = F.array_sort(F.collect_set(F.col(key).cast("string")))
    return rows.agg(F.sha2(F.array_join(names, "\n"), 256).alias("names_sha256"), F.count_distinct(key).alias("n"))


# --- manifests and verdicts -------------------------------------------------------------------------------


def freeze(labels: DataFrame, annotated: DataFrame, disk: DataFrame, key: str, label: str) -> DataFrame:
    """One row that describes a dataset: keys by source, differences between them, positives, case pairs, digest of names, ok.

    ok: the three have the same keys, and no two are equal but for case.
    """
    member = membership({"labels": labels, "annotated": annotated, "disk": disk}, key)
    differ = member.agg(
        F.count("*").alias("universe"),
        F.count_if(F.col("labels") == 0).alias("no_label"),
        F.count_if(F.col("annotated") == 0).alias("no_annotation"),
        F.count_if(F.col("disk") == 0).alias("not_on_disk"),
        F.count_if(F.greatest("labels", "annotated", "disk") > 1).alias("repeated"),
    )
    positive = labels.agg(F.count_if(F.col(label) == 1).alias("positives"))
    pairs = collisions(labels.select(F.col(key).cast("string").alias(key)), key).agg(F.count("*").alias("case_pairs"))
    out = differ.crossJoin(F.broadcast(positive)).crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(names_digest(labels, key).select("names_sha256")))
    return out.withColumn("ok", (F.col("no_label") + F.col("no_annotation") + F.col("not_on_disk") + F.col("repeated") + F.col("case_pairs")) == 0)


def drift(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(field, frozen, now) of the fields of two descriptions, a row each, that are not the same."""
    fields = lambda t, name: t.select(F.explode(F.create_map(*[x for c in t.columns for x in (F.lit(c), F.col(c).cast("string"))]))).select(F.col("key").alias("field"), F.col("value").alias(name))
    both = fields(frozen, "frozen").join(fields(now, "now"), "field", "full")
    return both.filter(~F.col("frozen").eqNullSafe(F.col("now")))


def require_frozen(frozen: DataFrame, now: DataFrame) -> None:
    """Fails with the fields of two descriptions that are not the same."""
    wrong = drift(frozen, now).orderBy("field").collect()
    if wrong:
        raise ValueError("; ".join(f"{r['field']}: {r['frozen']} is now {r['now']}" for r in wrong))


def verdict(predicted: DataFrame, expected: DataFrame, truth: DataFrame, key: str = "image_name") -> DataFrame:
    """(policy, verdict, errors, universe, parsed, missing, extra, tp, fp, fn, tn, precision, recall, f1): a row a metric policy.

    predicted: (key, label, problem); expected: (key); truth: (key, truth). The verdict is FAIL if ``validate`` finds anything.
    """
    good = predicted.filter("problem is null").select(key, "label")
    want = expected.select(key).distinct()
    failures = validate(predicted, expected, key).agg(F.count("*").alias("errors"))
    cover = membership({"parsed": good.distinct(), "universe": want}, key).agg(
        F.sum("universe").alias("universe"),
        F.count_if(F.col("parsed") > 0).alias("parsed"),
        F.count_if(F.col("parsed") == 0).alias("missing"),
        F.count_if(F.col("universe") == 0).alias("extra"),
    )
    rows = truth.join(want, key, "left_semi").join(good, key, "left")
    measured = metrics.both_policies(rows, "truth", "label").drop("missing")
    out = measured.crossJoin(F.broadcast(failures)).crossJoin(F.broadcast(cover))
    return out.select("policy", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL").alias("verdict"), "errors", "universe", "parsed", "missing", "extra", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def submission_checks(predicted: DataFrame, expected: DataFrame, key: str, label: str) -> DataFrame:
    """(check, ok) of a prediction table: no key missing, none extra, none repeated, all labels 0 or 1."""
    member = membership({"p": predicted, "e": expected.select(key).distinct()}, key)
    counts = member.agg(F.count_if(F.col("p") == 0).alias("a"), F.count_if(F.col("e") == 0).alias("b"), F.count_if(F.col("p") > 1).alias("c"))
    labels = predicted.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("d"))
    names = (("none_missing", "a"), ("none_extra", "b"), ("none_repeated", "c"), ("labels_binary", "d"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), (F.col(c) == 0).alias("ok")) for n, c in names])
    return counts.crossJoin(F.broadcast(labels)).select(F.explode(checks).alias("x")).select("x.*")


def box_label_problems(images: DataFrame, key: str, label: str, boxes: str) -> DataFrame:
    """(key, problem) of images whose label and number of boxes contradict each other."""
    n, y = F.coalesce(F.col(boxes), F.lit(0)), F.col(label)
    problem = F.when((y == 1) & (n == 0), "positive_without_box").when((y == 0) & (n > 0), "negative_with_box").when(y.isNull(), "no_label")
    return images.select(F.col(key).alias("key"), problem.alias("problem")).filter("problem is not null")


def json_numbers(files: DataFrame, names: tuple[str, ...] = ("precision", "recall"), depth: int = 16) -> DataFrame:
    """(file, key, value): numbers under these keys, at any level of a JSON text (file, content) down to ``depth``.

    Of a key that occurs several times, by its lower case, the occurrence nearest to the root counts, then the first by path.
    """
    spark = files.sparkSession
    level = files.select("file", F.try_parse_json(F.col("content")).alias("v"), F.lit("").alias("path"))
    found = None
    for at in range(depth):
        opened = spark.sql("select file, path, pos, key, value from {level}, lateral variant_explode(v)", level=level)
        opened = opened.select("file", F.concat("path", F.format_string("/%06d", "pos")).alias("path"), "key", F.col("value").alias("v"), F.lit(at).alias("at"))
        hits = opened.filter(F.lower("key").isin(*names)).select("file", F.lower("key").alias("key"), "at", "path", F.try_variant_get("v", "$", "double").alias("value"))
        found = hits if found is None else found.unionByName(hits)
        level = opened.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select("file", "v", "path")
    first = found.filter("value is not null").groupBy("file", "key").agg(F.min_by("value", F.struct("at", "path")).alias("value"))
    return first
