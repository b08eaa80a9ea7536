"""The state of a playlist at each line as window columns: media sequence, part index, byte-range carries, definitions.

All windows of the scan partition by ``playlist_url`` and order by ``line_no``: one exchange and one sort serve them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators import lex

MAP, PART, DEFINE = "-X-MAP", "-X-PART", "-X-DEFINE"


def _over(*more: str):
    return Window.partitionBy("playlist_url", *more).orderBy("line_no")


def _upto(*more: str):
    return _over(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(*more: str):
    return _over(*more).rowsBetween(Window.unboundedPreceding, -1)


def scan(rows: DataFrame) -> DataFrame:
    """Adds to lines: is_media, media_sequence, part_index, range_start, range_end and error flags of empty ranges.

    Ranges stand at the lines they belong to: segment uris, maps and parts. A range of length 0 is NULL, ``empty_range``, and
    so is one whose end is no 63-bit number.

    Every state is a running sum, from a base that some lines set anew: at such a line the base is the value it sets less the
    sum so far, and the state is the last base plus the sum. So all windows share one order, and a playlist is sorted once.
    """
    if "attrs" not in rows.columns:
        rows = lex.with_attributes(rows, MAP, PART)
    tag = F.col("kind") == "tag"
    named = lambda name: tag & (F.col("tag_name") == name)
    seg_len, seg_off = lex.length_and_offset(F.col("value"))
    att_len, att_off = lex.length_and_offset(lex.first_quoted(F.col("attrs"), "BYTERANGE"))
    ranged = tag & F.col("tag_name").isin(MAP, PART)
    rows = rows.withColumns({
        "_uri": F.col("kind") == "uri",
        "_mval": F.when(named("-X-MEDIA-SEQUENCE"), lex.byte_count(F.col("value"))),
        "_part": F.coalesce(named(PART), F.lit(False)),
        "_map": F.coalesce(named(MAP), F.lit(False)),
        "_len": F.when(named("-X-BYTERANGE"), seg_len).when(ranged, att_len),
        "_off": F.when(named("-X-BYTERANGE"), seg_off).when(ranged, att_off),
        "_media": F.coalesce(tag & F.col("tag_name").isin(*lex.MEDIA_TAGS), F.lit(False)),
        "_br": F.coalesce(named("-X-BYTERANGE") & seg_len.isNotNull(), F.lit(False)),
    })
    rows = rows.withColumn("_pr", F.col("_part") & F.col("_len").isNotNull())
    count = lambda flag: F.coalesce(F.count_if(F.col(flag)).over(_before()), F.lit(0))
    total = lambda flag: F.coalesce(F.try_sum(F.when(F.col(flag), F.col("_len"))).over(_before()), F.lit(0))
    rows = rows.withColumns({"_uris": count("_uri"), "_parts": count("_part"), "_brs": count("_br"), "_seglen": total("_br"), "_partlen": total("_pr"), "is_media": F.max("_media").over(_upto())})
    last = lambda value, window: F.coalesce(F.last(value, ignorenulls=True).over(window), F.lit(0))
    base = lambda flag, total: F.try_subtract(F.when(flag, F.coalesce("_off", F.lit(0))).otherwise(F.lit(0)), F.col(total))
    part_anchor = (F.col("_pr") & F.col("_off").isNotNull()) | (F.col("_part") & ~F.col("_pr")) | F.col("_uri")
    rows = rows.withColumns({
        "media_sequence": F.try_add(last(F.try_subtract(F.col("_mval"), F.col("_uris")), _upto()), F.col("_uris")),
        "part_index": F.col("_parts") - last(F.when(F.col("_uri"), F.col("_parts")), _before()),
        "_nbr": F.col("_brs") - last(F.when(F.col("_uri"), F.col("_brs")), _before()),
        "_pstart": F.try_add(last(F.when(part_anchor, base(F.col("_pr"), "_partlen")), _upto()), F.col("_partlen")),
    })
    seg_anchor = (F.col("_br") & F.col("_off").isNotNull()) | (F.col("_uri") & (F.col("_nbr") == 0))
    rows = rows.withColumn("_sstart", F.try_add(last(F.when(seg_anchor, base(F.col("_br"), "_seglen")), _upto()), F.col("_seglen")))
    pair = lambda start: F.struct(F.col(start).alias("start"), F.col("_len").alias("length"))
    bound = F.last(F.when(F.col("_br"), pair("_sstart")), ignorenulls=True).over(_before())
    mapped = F.col("_map") & F.col("_off").isNotNull() & F.col("_len").isNotNull()
    rows = rows.withColumn("_range", F.when(F.col("_uri") & (F.col("_nbr") > 0), bound).when(F.col("_pr"), pair("_pstart")).when(mapped, pair("_off")))
    end = F.when(F.col("_range.length") > 0, F.try_add(F.col("_range.start"), F.col("_range.length") - 1))
    rows = rows.withColumns({"range_start": F.when(end.isNotNull(), F.col("_range.start")), "range_end": end, "empty_range": F.coalesce(F.col("_range.length") == 0, F.lit(False))})
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def definitions(rows: DataFrame) -> DataFrame:
    """Adds ``definitions``: the variables in force at each line, as (name, value) in order of first declaration.

    NAME declares a value; IMPORT copies one of ``imported_definitions`` and QUERYPARAM one of ``viewer_query`` (maps,
    where the playlists have them). A later declaration of a name replaces its value. ``define_error`` tells of a lookup
    that finds nothing.
    """
    attrs = F.when((F.col("kind") == "tag") & (F.col("tag_name") == DEFINE), lex.attributes(F.col("value")))
    rows = rows.withColumn("_d", attrs)
    look = lambda table, name: F.try_element_at(F.col(table), name) if table in rows.columns else F.lit(None).cast("string")
    name, imported, param = (lex.first_quoted(F.col("_d"), n) for n in ("NAME", "IMPORT", "QUERYPARAM"))
    value = lex.first_quoted(F.col("_d"), "VALUE")
    rows = rows.withColumn("_def", F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(value, F.lit("")).alias("value"))).when(imported.isNotNull(), F.struct(imported.alias("name"), look("imported_definitions", imported).alias("value"))).when(param.isNotNull(), F.struct(param.alias("name"), look("viewer_query", param).alias("value"))))
    rows = rows.withColumn("define_error", F.when(F.col("_def").isNotNull() & F.col("_def.value").isNull(), F.concat(F.lit("no value for "), F.col("_def.name"))))
    # Only lines that define fold what was defined so far; every line then takes the last fold before it.
    valid = F.when(F.col("_def.value").isNotNull(), F.struct(F.col("_def.name").alias("name"), F.col("_def.value").alias("value")))
    rows = rows.withColumns({"_valid": valid, "_defines": F.col("_d").isNotNull()})
    rows = rows.withColumn("_seen", F.when(F.col("_defines"), F.collect_list("_valid").over(_upto("_defines"))))
    names = F.array_distinct(F.transform("_seen", lambda d: d["name"]))
    folded = F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter("_seen", lambda d: d["name"] == n), -1)["value"].alias("value")))
    rows = rows.withColumn("_now", F.when(F.col("_defines"), folded))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return rows.withColumn("definitions", F.coalesce(F.last("_now", ignorenulls=True).over(_before()), none)).drop("_d", "_def", "_valid", "_defines", "_seen", "_now")
