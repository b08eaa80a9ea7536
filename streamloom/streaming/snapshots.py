"""Live playlists as a stream: each file that arrives is a snapshot of one playlist; the lexer and scan run per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators import lex


def read_snapshots(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(snapshot, seen_at, body) of the text files that arrive under ``path``."""
    schema = "value string"
    files = spark.readStream.format("text").schema(schema).option("wholetext", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(path)
    return files.select(F.col("_metadata.file_path").alias("snapshot"), F.col("_metadata.file_modification_time").alias("seen_at"), F.col("value").alias("body"))


def snapshot_lines(snapshots: DataFrame) -> DataFrame:
    """Lines without state: row by row, so any output mode will do."""
    split = snapshots.filter("body <> ''").select("snapshot", "seen_at", F.posexplode(lex.whole_lines(F.col("body"))).alias("line_no", "raw"))
    kind = F.when(F.col("raw") == "", "blank").when(F.col("raw").startswith("#EXT"), "tag").when(F.col("raw").startswith("#"), "comment").otherwise("uri")
    return split.withColumn("kind", kind).withColumn("tag_name", F.when(F.col("kind") == "tag", F.regexp_extract("raw", "^#EXT([^:]*)", 1)))


def media_rate(snapshots: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Segments and parts seen per window of arrival time; late files count until the watermark passes."""
    rows = snapshot_lines(snapshots.withWatermark("seen_at", late))
    return rows.groupBy(F.window("seen_at", window)).agg(F.sum((F.col("kind") == "uri").cast("long")).alias("n_uris"), F.sum((F.col("tag_name") == "-X-PART").cast("long")).alias("n_parts"))


def stateful(snapshots: DataFrame, sink) -> object:
    """Runs ``sink(batch, scanned)`` on each micro-batch with the full state of its playlists."""
    from streamloom.operators import state

    def each(batch: DataFrame, number: int) -> None:
        sink(number, state.scan(lex.lines(batch.select(F.col("snapshot").alias("playlist_url"), "body"))))

    return snapshots.writeStream.foreachBatch(each)
