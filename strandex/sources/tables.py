"""Readers and writers: label files, playlists, evaluation tables, staged replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR_LABELS = "seed_track_id long, candidate_track_id long, rating int, reason_tags string, notes string, source string"
TRANSITION_LABELS = "outgoing_track_id long, incoming_track_id long, rating int, risk_tags string, notes string, source string"


def _checked(rows: DataFrame, ids: tuple[str, str], tags: str) -> DataFrame:
    """Positive ids and ratings from 0 to 3, or an error that names the row."""
    bad = ~((F.col(ids[0]) > 0) & (F.col(ids[1]) > 0) & F.col("rating").between(0, 3))
    what = F.concat(F.lit("bad label: "), F.to_json(F.struct(*rows.columns)))
    ok = rows.withColumn("rating", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(what).cast("int")).otherwise(F.col("rating")))
    split = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return ok.withColumn(tags, split).withColumn("source", F.coalesce("source", F.lit("manual")))


def read_labels(spark: SparkSession, path: str, transitions: bool = False) -> DataFrame:
    """Feedback labels from CSV with a header, or from JSON lines if the path ends in ``.jsonl``."""
    schema = TRANSITION_LABELS if transitions else PAIR_LABELS
    if path.endswith(".jsonl"):
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    first, second, *_ = rows.columns
    return _checked(rows, (first, second), "risk_tags" if transitions else "reason_tags")


def read_seed_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("track_id").cast("long").alias("track_id")).distinct()


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """(position, artist, title, path) of an M3U list: each path with the line before it, if that names it.

    One list is one file, read whole; lists are matched by name with wildcards.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos")
    rows = lines.where(F.trim("line") != "").withColumn("before", F.lag("line").over(w)).where(~F.col("line").startswith("#"))
    name = F.when(F.col("before").startswith("#EXTINF"), F.regexp_extract("before", r"^#EXTINF:[^,]*,(.*)$", 1))
    artist = F.when(name.rlike(" [-—] "), F.trim(F.regexp_extract(name, r"^(.*?) [-—] ", 1)))
    title = F.when(name.rlike(" [-—] "), F.trim(F.regexp_extract(name, r" [-—] (.*)$", 1))).otherwise(name)
    return rows.select(F.row_number().over(w).alias("position"), artist.alias("artist"), title.alias("title"), F.trim("line").alias("path"))


def write_playlist(rows: DataFrame, path: str) -> None:
    """``#EXTM3U``, then a name and a path line for each row in order of position."""
    body = rows.select("position", F.explode(F.array(F.concat(F.lit("#EXTINF:-1,"), F.concat_ws(" - ", "artist", "title")), F.col("path"))).alias("value"), F.monotonically_increasing_id().alias("at"))
    head = rows.sparkSession.createDataFrame([(-1, "#EXTM3U", 0)], "position int, value string, at long")
    head.unionByName(body).orderBy("position", "at").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; missing values are empty."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def append_events(rows: DataFrame, path: str, by: str = "mode") -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length, modified) of files below ``root``; hidden resource forks are left out, content is not read."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("._")).select("path", "length", F.col("modificationTime").alias("modified"))
