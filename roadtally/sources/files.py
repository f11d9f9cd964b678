"""Readers of track and detection files, start times from file paths, and the ledger of imported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK_FILE = "fps double, width int, height int, frames long, tracks map<string, struct<clases: map<string, bigint>, p: array<array<double>>>>"
# Class ids of the detector.
CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}


def read_track_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each point of each track, with its file's rate and size."""
    files = spark.read.schema(TRACK_FILE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    each = files.select("file", "fps", "width", "height", "frames", F.explode("tracks").alias("track_id", "track"))
    points = each.select("file", "fps", "width", "height", "frames", F.col("track_id").cast("long"), F.explode("track.p").alias("p"))
    box = {n: F.col("p")[i + 1] for i, n in enumerate(("x1", "y1", "x2", "y2", "confidence"))}
    return points.select("file", "fps", "width", "height", "frames", "track_id", F.col("p")[0].cast("long").alias("frame"), *[c.alias(n) for n, c in box.items()])


def read_detection_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each box of each frame: frame, box_no, corners, confidence and class_name."""
    files = spark.read.schema("frames array<array<array<double>>>").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    each = files.select("file", F.posexplode("frames").alias("frame", "boxes")).select("file", "frame", F.posexplode("boxes").alias("box_no", "b"))
    names = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    box = [F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "confidence"))]
    return each.select("file", "frame", "box_no", *box, names[F.col("b")[5].cast("int")].alias("class_name"))


def path_date(path: Column) -> Column:
    """A date in the path: 2026-10-05, 20261005 or 05-10-2026; the last one wins."""
    iso = F.regexp_extract(path, r".*(?<!\d)(20\d{2})-?(\d{2})-?(\d{2})(?!\d)", 0)
    y, m, d = (F.regexp_extract(path, r".*(?<!\d)(20\d{2})-?(\d{2})-?(\d{2})(?!\d)", i) for i in (1, 2, 3))
    d2, m2, y2 = (F.regexp_extract(path, r".*(?<!\d)(\d{2})-(\d{2})-(20\d{2})(?!\d)", i) for i in (1, 2, 3))
    text = F.when(iso != "", F.concat_ws("-", y, m, d)).when(y2 != "", F.concat_ws("-", y2, m2, d2))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def path_seconds(path: Column) -> Column:
    """Seconds of the day that the path names: 14-56-00.mp4, or hour folder and minute file 14/05.mp4; dates are taken out first."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?<!\d)20\d{2}-?\d{2}-?\d{2}(?!\d)", ""), r"(?<!\d)\d{2}-\d{2}-20\d{2}(?!\d)", "")
    whole = r".*(?<!\d)([01]\d|2[0-3])[-_.]?([0-5]\d)[-_.]?([0-5]\d)(?!\d)"
    short = r".*(?<!\d)([01]\d|2[0-3])/([0-5]\d)\.\w+$"
    part = lambda p, i: F.regexp_extract(bare, p, i)
    number = lambda c: c.cast("int")
    return F.when(part(whole, 1) != "", number(part(whole, 1)) * 3600 + number(part(whole, 2)) * 60 + number(part(whole, 3))).when(part(short, 1) != "", number(part(short, 1)) * 3600 + number(part(short, 2)) * 60)


def fingerprint(project: Column, path: Column, size: Column, mtime: Column) -> Column:
    """28 hexadecimal digits that name a file's version."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit("entrada"), project, path, size, mtime), 256), 1, 28)


def new_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files (project_id, path, size, mtime) that are not in the ledger (fingerprint) yet."""
    marked = listing.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("project_id", "path", "size", "mtime")]))
    return marked.join(known, "fingerprint", "left_anti")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a table's declared columns: missing ones null, extra ones left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: str, geometry: dict[str, str] | None = None) -> DataFrame:
    """A stored table in its declared columns; geometry kept as JSON text (column -> new name) becomes arrays of points.

    Text that is no JSON gives null, as does a missing column; extra columns are left out."""
    geometry = geometry or {}
    text = T.StructType([T.StructField(c, T.StringType()) for c in geometry])
    rows = typed(spark.read.parquet(path), T.StructType(T.StructType.fromDDL(schema).fields + text.fields))
    shapes = {n: F.from_json(c, "array<array<double>>") for c, n in geometry.items()}
    return rows.withColumns(shapes).drop(*geometry) if geometry else rows
