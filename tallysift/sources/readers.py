"""Sources: image folders, label files, manifests, score tables, annotations, frame streams."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Image file extensions.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")

COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, "
    "categories array<struct<id:bigint,name:string>>"
)
SCORES = "image_name string, image_path string, label int, score double, prediction_best int"
MANIFEST = "image_path string, image_name string, label int, split string, label_path string"
CROPS = (
    "image_path string, image_name string, label int, split string, source_image string, source_path string, proposal_type string, "
    "model string, confidence double, max_iou double, x1 int, y1 int, x2 int, y2 int"
)
DETAILS = (
    "image_name string, prediction int, siglip_score double, siglip_positive int, dino_score double, dino_positive int, crop_score double, "
    "crop_rescue int, yolo_votes int, yolo26m int, yolo26s int, yolo26s_aug int"
)
HISTORY = "epoch int, train_loss double, val_loss double, precision_0_5 double, recall_0_5 double, f1_0_5 double"


FILES = "path string, image_name string, length bigint, modified timestamp"


def empty_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, image_name, length, modified) of files without bytes, which the binary reader leaves out."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    listing = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, recursive)
    found = []
    while listing.hasNext():
        status = listing.next()
        if not status.getLen():
            found.append((status.getPath().toString(), status.getPath().getName(), 0, datetime.fromtimestamp(status.getModificationTime() / 1000)))
    return spark.createDataFrame(found, FILES)


def list_images(spark: SparkSession, path: str, extensions: Iterable[str] = EXTENSIONS, recursive: bool = True, exclude: str | None = None, unique: bool = True) -> DataFrame:
    """(path, image_name, length, modified). Contents are not read. ``unique``: fail if a name occurs twice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.substring_index("path", "/", -1)
    out = files.select("path", name.alias("image_name"), "length", F.col("modificationTime").alias("modified")).unionByName(empty_files(spark, path, recursive))
    out = out.filter(F.lower(F.substring_index("image_name", ".", -1)).isin(*[e.lower() for e in extensions]))
    if exclude:
        out = out.filter(~F.contains("image_name", F.lit(exclude)))
    if unique:
        twice = out.groupBy("image_name").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"more than one image is named {twice[0]['image_name']}")
    return out


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, width, height, decoded): what the image reader makes of each file; it leaves out empty files."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(path).select(
        F.substring_index("image.origin", "/", -1).alias("image_name"), "image.width", "image.height", (F.col("image.height") > 0).alias("decoded")
    )


def preflight(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, problem) of files that are empty or cannot be decoded."""
    files = list_images(spark, path, unique=False)
    empty = files.filter("length = 0").select("image_name", F.lit("zero_byte").alias("problem"))
    bad = image_sizes(spark, path).filter("not decoded").select("image_name", F.lit("decode_failure").alias("problem"))
    return empty.unionByName(bad)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, sha256_16) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256")).withColumn("sha256_16", F.substring("sha256", 1, 16))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; a byte order mark is skipped and '' is null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="")


def require_rows(rows: DataFrame, name: str) -> DataFrame:
    """rows, or an error if there are none."""
    if rows.isEmpty():
        raise ValueError(f"{name} is empty")
    return rows


def directory_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: images that are read, files that are not, least, greatest and mean width and height. Empty files are not read."""
    sizes = image_sizes(spark, path)
    w, h = (F.when(F.col("decoded"), F.col(c)) for c in ("width", "height"))
    stats = sizes.agg(F.count_if("decoded").alias("images"), F.count_if(~F.col("decoded")).alias("undecoded"), *[f(c).alias(f"{n}_{k}") for k, c in (("width", w), ("height", h)) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    empty = empty_files(spark, path).agg(F.count("*").alias("empty"))
    return stats.crossJoin(F.broadcast(empty)).withColumn("unread", F.col("undecoded") + F.col("empty")).drop("undecoded", "empty")


def progress_stream(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """Rows of training histories as files of them arrive below a folder."""
    return spark.readStream.option("header", "true").schema(schema).csv(path)


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of whole files, for ``validate.strict_labels``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, label) of {name: label} files, label a number or an object with ``label``."""
    files = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = spark.sql("select key, value from {files}, lateral variant_explode(v)", files=files)
    label = F.coalesce(F.try_variant_get("value", "$.label", "int"), F.try_variant_get("value", "$", "int"))
    return rows.select(F.col("key").alias("image_name"), label.alias("label"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images (id, file_name, width, height), annotations (image_id, category_id, x, y, w, h), categories (id, name, dense)."""
    raw = spark.read.json(path, multiLine=True, schema=COCO)
    images = raw.select(F.explode("images").alias("i")).select("i.*")
    notes = raw.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", *[F.get("a.bbox", i).alias(c) for i, c in enumerate("xywh")])
    ordered = raw.select(F.posexplode(F.array_sort("categories")).alias("dense", "c")).select("c.id", "c.name", "dense")
    return images, notes, ordered


def label_boxes(spark: SparkSession, path: str, only_class: int | None = 0) -> DataFrame:
    """(stem, line_no, cls, cx, cy, w, h) of box label files; lines of fewer than five tokens are skipped."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.[^.]*$", "").alias("stem"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
    )
    tokens = F.split(F.trim("line"), r"\s+")
    boxes = lines.withColumn("p", tokens).filter(F.size("p") >= 5).select(
        "stem", "line_no", F.try_element_at("p", F.lit(1)).cast("double").cast("int").alias("cls"), *[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))]
    )
    return boxes if only_class is None else boxes.filter(F.col("cls") == only_class)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the top-level lines ``key: value`` of a YAML file."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^[^\s#][^:]*:"))
    return lines.select(F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.regexp_replace("value", r"^[^:]*:", "")).alias("value"))


def sha_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, name) of lines of two tokens."""
    tokens = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).withColumn("p", tokens).filter(F.size("p") == 2).select(F.col("p")[0].alias("sha256"), F.col("p")[1].alias("name"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("image_name")).filter("image_name <> ''")


def embedding_cache(spark: SparkSession, path: str, model: str, rows: int) -> DataFrame | None:
    """The cached embeddings if their metadata name this model and number of rows, else None: a miss."""
    try:
        meta = spark.read.parquet(f"{path}/metadata").filter((F.col("model") == model) & (F.col("rows") == rows)).limit(1).collect()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/features") if meta else None


FRAMES = "camera string, frame_idx bigint, ts timestamp, detections array<struct<class_id:int,score:double,bbox:array<double>>>"


def frame_stream(spark: SparkSession, path: str, schema: str = FRAMES) -> DataFrame:
    """Frames of all cameras as they arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def sampled_frames(frames: DataFrame, every: int) -> DataFrame:
    """Frames 1, 1 + every, ...: ``every=1`` keeps all."""
    return frames.filter(F.pmod(F.col("frame_idx") - 1, F.lit(every)) == 0)


def latest(history: DataFrame, epoch: str = "epoch") -> DataFrame:
    """The row of the last epoch."""
    return history.agg(F.max_by(F.struct(*history.columns), epoch).alias("r")).select("r.*")
