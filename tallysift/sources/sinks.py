"""Sinks: single-file reports that appear whole or not at all, tables, label files."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stages a failure can name.
STAGES = ("load_preprocess", "inference", "postprocess", "fusion")
#: Rows up to which a single-file report is written by the driver.
REPORT_ROWS = 1_000_000


def whole_file(path: str, text: str, bom: bool = False) -> None:
    """Writes beside the target and renames: readers see the old file or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, early = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as out:
            out.write(text)
        os.replace(early, path)
    except BaseException:
        os.unlink(early)
        raise


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows is not written as one file; write a table")
    return found


def write_label_map(rows: DataFrame, path: str) -> None:
    """{image_name: label} with sorted names."""
    labels = {r["image_name"]: r["label"] for r in _bounded(rows.select("image_name", "label"))}
    whole_file(path, json.dumps(labels, ensure_ascii=False, indent=2, sort_keys=True))


def write_json(path: str, value) -> None:
    whole_file(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header and a byte order mark; nulls are empty."""
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(rows.columns)
    writer.writerows([["" if v is None else v for v in r] for r in _bounded(rows)])
    whole_file(path, out.getvalue(), bom=True)


def union_columns(*tables: DataFrame, first_seen: bool = False) -> DataFrame:
    """All rows with the columns of all tables, in order of name or of first occurrence; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out if first_seen else out.select(*sorted(out.columns))


def failure(file: str, stage: str, error: BaseException, index: int | None = None) -> dict:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return {"file": file, "stage": stage, "exception_type": type(error).__name__, "message": str(error)[:200], "index": index}


def commit(labels: DataFrame, details: DataFrame, failures: DataFrame, path: str) -> bool:
    """Writes path and its details if nothing failed; else only files named PARTIAL and the failures. True if whole."""
    stem = path[: -len(".json")] if path.endswith(".json") else path
    failed = [r.asDict() for r in _bounded(failures)]
    whole = not failed
    write_label_map(labels, path if whole else f"{stem}_PARTIAL.json")
    write_csv(details, f"{stem}_details.csv" if whole else f"{stem}_PARTIAL_details.csv")
    if failed:
        write_json(f"{stem}_failures.json", failed)
    return whole


def label_lines(boxes: DataFrame) -> DataFrame:
    """(stem, content): a line ``cls cx cy w h`` a box of (stem, ordinal, cls, cx, cy, bw, bh), in order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "bw", "bh")
    per = boxes.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    return per.select("stem", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


def detections_json(rows: DataFrame) -> DataFrame:
    """(image_name, json): detections [{class, score}] with scores rounded to 4 places."""
    parts = F.transform("detections", lambda d: F.struct(d["class_id"].alias("class"), F.bround(d["score"], 4).alias("score")))
    return rows.select("image_name", F.to_json(parts).alias("json"))


def detections_flat(rows: DataFrame) -> DataFrame:
    """(image_name, ordinal, class, score, x1, y1, x2, y2): a row a detection of (image_name, detections), scores rounded to 4 places, corners cut to whole pixels."""
    flat = rows.select("image_name", F.posexplode("detections").alias("ordinal", "d"))
    corners = [F.get("d.bbox", i).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return flat.select("image_name", "ordinal", F.col("d.class_id").alias("class"), F.bround("d.score", 4).alias("score"), *corners)


def write_label_folders(images: DataFrame, labels: DataFrame, folder: str, names: list[str]) -> dict[str, int]:
    """Label files ``split/labels/stem.txt`` below a folder URI, one an image of (stem, split), empty without a row in labels
    (stem, content), and data.yaml; returns the number of files by split. Tasks write their files themselves; a task that runs again
    writes the same files again."""
    rows = images.select("stem", "split").join(labels.select("stem", "content"), "stem", "left")

    def write(batches):
        for batch in batches:
            for stem, split, content in batch.itertuples(index=False):
                _put(f"{folder}/{split}/labels/{stem}.txt", content or "")
            yield batch[["split"]]

    done = rows.mapInPandas(write, "split string").groupBy("split").count().collect()
    found = {r["split"]: r["count"] for r in done}
    lines = [f"path: {folder}", *[f"{split}: {split}/images" for split in sorted(found)], f"nc: {len(names)}", f"names: {json.dumps(names)}"]
    _put(f"{folder}/data.yaml", "\n".join(lines) + "\n")
    return found


def _put(uri: str, text: str) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(text.encode())


def write_once(rows: DataFrame, path: str) -> None:
    """Writes a table that must not be there yet: the second of two runs fails, whatever it found."""
    rows.write.mode("errorifexists").parquet(path)


def write_embeddings(rows: DataFrame, path: str, model: str, split: str, dimension: int, normalized: bool) -> None:
    """Features and, when they are there, a row of metadata that makes them valid."""
    rows.write.mode("overwrite").parquet(f"{path}/features")
    n = rows.sparkSession.read.parquet(f"{path}/features").count()
    meta = rows.sparkSession.createDataFrame([(model, split, n, dimension, normalized)], "model string, split string, rows long, feature_dimension int, normalized boolean")
    meta.write.mode("overwrite").parquet(f"{path}/metadata")
