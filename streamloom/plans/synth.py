"""Playlists and media files made of table rows, so that queries read real texts and bytes whose contents SQL knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that become media files, or lines of playlists, in one task, about.
TASK_FILES, TASK_LINES = 4_000, 100_000


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of about ``rows`` rows; the rows of a Parquet file are counted by its footers."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame, key: str, rows: int = TASK_FILES) -> DataFrame:
    """The rows dealt over tasks by their key: else each row group is one task, whatever is made of its rows, and a file has few."""
    return df.repartition(tasks(df, rows), key)


def be(value, size: int) -> Column:
    """A number as big-endian bytes."""
    value = F.col(value) if isinstance(value, str) else F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def raw(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def box(fourcc: str, *body: Column) -> Column:
    body = F.concat(*body) if body else raw("")
    return F.concat(be(F.length(body) + 8, 4), F.encode(F.lit(fourcc), "UTF-8"), body)


def bodies(lines: DataFrame) -> DataFrame:
    """(playlist_url, body) of (playlist_url, ord, lines array<string>) rows, behind the header line.

    Callers deal the rows over tasks by ``playlist_url`` first; all that is done to a playlist then needs no other exchange.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "lines"))), lambda r: r["lines"])
    return lines.groupBy("playlist_url").agg(F.array_join(F.concat(F.array(F.lit("#EXTM3U")), F.flatten(rows)), "\n").alias("body"))


def ordered(items: DataFrame, key: str) -> DataFrame:
    """Line items with ``ord``, their place in their order, which ``key`` tells apart."""
    order = Window.partitionBy(key).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return items.select(*{key: 0, "l_orderkey": 0}, "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty"), "l_returnflag", F.row_number().over(order).alias("ord"))


def ordered_lineitem(spark, sf_dir: str) -> DataFrame:
    return ordered(table(spark, sf_dir, "lineitem"), "l_orderkey")


def segment_playlists(spark, sf_dir: str) -> DataFrame:
    """One media playlist per order: line items are segments; the return flag tells how their byte range is given."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    items = dealt(items.withColumn("playlist_url", F.col("l_orderkey").cast("string")), "playlist_url", TASK_LINES)
    rows = ordered(items, "playlist_url")
    span = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("#EXT-X-BYTERANGE:"), F.col("qty"), F.lit("@"), F.col("l_partkey"))).when(F.col("l_returnflag") == "N", F.concat(F.lit("#EXT-X-BYTERANGE:"), F.col("qty")))
    first = F.when(F.col("ord") == 1, F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), F.col("l_orderkey") % 1000))
    lines = F.filter(F.array(first, F.lit("#EXTINF:6,"), span, F.concat(F.lit("seg-"), F.col("ord"), F.lit(".m4s"))), lambda x: x.isNotNull())
    return bodies(rows.select("playlist_url", "ord", lines.alias("lines")))


def part_playlists(spark, sf_dir: str) -> DataFrame:
    """One playlist per user: events are parts (with offset, with length only, without range) or the uri that ends them."""
    e = table(spark, sf_dir, "events")
    size, kind = (F.col("event_id") % 100 + 1).cast("string"), F.col("event_type")
    tag = lambda rest: F.concat(F.lit('#EXT-X-PART:DURATION=1,URI="p.m4s"'), rest)
    line = (
        F.when(kind == "purchase", F.concat(F.lit("seg-"), F.col("event_id"), F.lit(".m4s")))
        .when(kind == "signup", tag(F.concat(F.lit(',BYTERANGE="'), size, F.lit("@"), F.col("event_id").cast("string"), F.lit('"'))))
        .when(kind == "error", tag(F.lit("")))
        .otherwise(tag(F.concat(F.lit(',BYTERANGE="'), size, F.lit('"'))))
    )
    return bodies(dealt(e.select(F.col("user_id").cast("string").alias("playlist_url"), F.col("event_id").alias("ord"), F.array(line).alias("lines")), "playlist_url", TASK_LINES))


def fragments(spark, sf_dir: str) -> DataFrame:
    """One fragment per order: ``moof`` with a run of its line items, then ``mdat``."""
    rows = ordered_lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", "qty", "l_partkey", "l_suppkey"))).alias("items"))
    samples = F.transform("items", lambda i: F.concat(be(i["qty"], 4), be(i["l_partkey"], 4), be(i["l_suppkey"], 4)))
    entries = F.aggregate(samples, raw(""), lambda a, x: F.concat(a, x))
    count = F.size("items")
    trun = box("trun", raw("01000B01"), be(count, 4), be(F.lit(100), 4), entries)
    traf = box("traf", box("tfhd", raw("00020000"), be("l_orderkey", 4)), box("tfdt", raw("01000000"), be(F.col("l_orderkey") * 1000, 8)), trun)
    moof = box("moof", box("mfhd", raw("00000000"), be("l_orderkey", 4)), traf)
    return rows.select(F.col("l_orderkey").cast("string").alias("media_id"), F.concat(box("styp", F.encode(F.lit("msdh"), "UTF-8"), be(0, 4), F.encode(F.lit("msdhmsix"), "UTF-8")), moof, box("mdat", entries)).alias("content"))
