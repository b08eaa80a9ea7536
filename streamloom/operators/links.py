"""Links of a playlist: every uri, map, part, rendition and date-range attribute as a resolved address and a viewer link.

One row per link. Highlights are a boolean column over a chosen context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions import codec, urls
from streamloom.operators import lex, state

# Tags, attributes and classes of the playlist format.
PLAYLIST_TAGS = ("-X-MEDIA", "-X-I-FRAME-STREAM-INF", "-X-IMAGE-STREAM-INF")
DATERANGE = "-X-DATERANGE"
LINK_ATTRIBUTES = ("SCTE35-OUT", "SCTE35-IN", "SCTE35-CMD", "X-ASSET-URI", "X-ASSET-LIST", "X-URI")
PRELOAD, INTERSTITIAL, SCHEDULE = "com.apple.hls.preload", "com.apple.hls.interstitial", "com.apple.hls.daterange-schedule"


def extension(uri: Column) -> Column:
    """What follows the last dot of the last path part before the first ``?``, in lower case; a name without dot is all."""
    path = F.element_at(F.split(F.get(F.split(uri, r"\?"), F.lit(0)), "/"), -1)
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def daterange_target(name: Column, value: Column, has_id: Column, cls: Column, target: Column) -> Column:
    """What a date-range attribute leads to: SCTE35, PLAYLIST, ASSET_LIST, DATERANGE_SCHEDULE, or NULL for no link."""
    preload = F.when((target == INTERSTITIAL) & (extension(value) == "json"), "ASSET_LIST").when((target == INTERSTITIAL) & (extension(value) == "m3u8"), "PLAYLIST").when(target == SCHEDULE, "DATERANGE_SCHEDULE")
    return (
        F.when(name == "X-ASSET-URI", "PLAYLIST")
        .when(~has_id, F.lit(None))
        .when(name.startswith("SCTE35-"), "SCTE35")
        .when(name == "X-ASSET-LIST", "ASSET_LIST")
        .when((name == "X-URI") & (cls == PRELOAD), preload)
        .when((name == "X-URI") & (cls == SCHEDULE), "DATERANGE_SCHEDULE")
    )


def link_rows(playlists: DataFrame) -> DataFrame:
    """(playlist_url, line_no, ordinal, attribute, link_type, text, resolved, href, ...) of every link.

    ``playlists`` may have ``definitions_query``, the raw parameter that the viewer was called with.
    """
    rows = state.definitions(state.scan(lex.with_attributes(lex.lines(playlists), *PLAYLIST_TAGS, state.MAP, state.PART, DATERANGE)))
    if "definitions_query" not in rows.columns:
        rows = rows.withColumn("definitions_query", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    candidate = lambda ordinal, attribute, kind, text: F.struct(ordinal.cast("int").alias("ordinal"), attribute.cast("string").alias("attribute"), kind.alias("link_type"), text.alias("text"))
    uri_line = F.array(candidate(F.lit(0), none, F.when(F.col("is_media"), "SEGMENT").otherwise("PLAYLIST"), F.col("raw")))
    kind_of = F.when(F.col("tag_name") == state.MAP, "MAP").when(F.col("tag_name") == state.PART, "PART").otherwise("PLAYLIST")
    uri_attrs = F.transform("attrs", lambda a, i: candidate(i, a["name"], F.when(a["name"] == "URI", kind_of), a["value"]))
    of_range = {f"_{k}": F.when(F.col("tag_name") == DATERANGE, lex.last_quoted(F.col("attrs"), name)) for k, name in (("id", "ID"), ("class", "CLASS"), ("target", "X-TARGET-CLASS"))}
    rows = rows.withColumns(of_range)
    target_of = lambda a: daterange_target(a["name"], a["value"], F.col("_id").isNotNull(), F.col("_class"), F.col("_target"))
    range_attrs = F.transform("attrs", lambda a, i: candidate(i, a["name"], F.when(a["name"].isin(*LINK_ATTRIBUTES), target_of(a)), a["value"]))
    found = F.when(F.col("kind") == "uri", uri_line).when(F.col("tag_name") == DATERANGE, range_attrs).when(F.col("attrs").isNotNull(), uri_attrs)
    rows = rows.withColumn("_l", F.explode(F.filter(found, lambda c: c["link_type"].isNotNull())))
    rows = rows.select("*", "_l.*", F.col("_id").alias("daterange_id")).drop("_l", "attrs", "_id", "_class", "_target")
    needs = F.col("link_type") != "SCTE35"
    # Python stands behind all windows, as the planner takes its output to be dealt over tasks in no known way.
    rows = rows.withColumns({"resolved": urls.resolve_once(F.col("playlist_url"), F.when(needs, urls.replace_variables("text", "definitions"))), "base_url": urls.normal(F.col("playlist_url"))})
    sequence = (F.col("media_sequence"), "range_start", "range_end")
    kind = F.col("link_type")
    plain = (
        F.when(kind == "SEGMENT", codec.segment_context("SEGMENT", "resolved", *sequence))
        .when(kind == "MAP", codec.segment_context("MAP", "resolved", *sequence))
        .when(kind == "PART", codec.segment_context("PART", "resolved", *sequence, "part_index"))
        .when(kind == "SCTE35", codec.scte35_context("text", "daterange_id", F.substring("attribute", 8, 3)))
        .when(kind == "ASSET_LIST", codec.json_context("ASSET_LIST", "resolved", "daterange_id"))
        .when(kind == "DATERANGE_SCHEDULE", codec.json_context("DATERANGE_SCHEDULE", "resolved", "daterange_id"))
    )
    # Texts stand in columns of their own before they are encoded, so that each is put together once.
    rows = rows.withColumns({"_plain": plain, "_url": F.when(kind == "PLAYLIST", F.col("resolved")).otherwise(F.col("base_url"))})
    # A link that has no text to be encoded has no address; filtering by the address itself would work it out twice.
    rows = rows.filter(F.col("_url").isNotNull() & ((kind == "PLAYLIST") | F.col("_plain").isNotNull()))
    rows = rows.withColumns({"context": codec.percent_encode("_plain"), "_url": codec.percent_encode("_url")})
    own = F.when(F.size("definitions") > 0, F.concat(F.lit("&imported_definitions="), codec.encode_definitions("definitions"))).otherwise("")
    href = F.when(kind == "PLAYLIST", F.concat(F.lit("?playlist_url="), F.col("_url"), own)).otherwise(urls.context_link("_url", "definitions_query", "context", encoded=True))
    return rows.withColumn("href", href).drop("kind", "value", "error", "define_error", "_plain", "_url")


def highlighted(links: DataFrame, context_type: str, media_sequence: int | None = None, url: str | None = None, part_index: int | None = None, daterange_id: str | None = None, command: str | None = None, first_only: bool = False) -> DataFrame:
    """Adds ``is_highlighted`` for a chosen context. Maps match from the chosen sequence on, all of them unless ``first_only``."""
    kind = F.col("link_type")
    if context_type == "SEGMENT":
        match = F.col("attribute").isNull() & (F.col("media_sequence") == media_sequence)
    elif context_type == "MAP":
        match = (kind == "MAP") & (F.col("media_sequence") >= media_sequence) & (F.col("resolved") == url)
    elif context_type == "PART":
        match = (kind == "PART") & (F.col("media_sequence") == media_sequence) & (F.col("part_index") == part_index)
    elif context_type == "SCTE35":
        match = (F.col("daterange_id") == daterange_id) & (F.col("attribute") == f"SCTE35-{command}")
    elif context_type == "ASSET_LIST":
        match = (F.col("daterange_id") == daterange_id) & (F.col("attribute") == "X-ASSET-LIST")
    elif context_type == "DATERANGE_SCHEDULE":
        match = (F.col("daterange_id") == daterange_id) & (F.col("attribute") == "X-URI")
    else:
        raise ValueError(f"unknown context type: {context_type}")
    out = links.withColumn("is_highlighted", F.coalesce(match, F.lit(False)))
    if first_only and context_type == "MAP":
        from pyspark.sql import Window

        before = Window.partitionBy("playlist_url").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("is_highlighted", F.col("is_highlighted") & ~F.coalesce(F.max("is_highlighted").over(before), F.lit(False)))
    return out


def with_highlights(links: DataFrame, context: str = "context_asked") -> DataFrame:
    """Adds ``is_highlighted`` for the decoded context in a column of each row; rows without one have none."""
    c, kind, name = F.col(context), F.col("link_type"), F.col("attribute")
    same = F.col("media_sequence") == c["media_sequence"]
    of_range = F.col("daterange_id") == c["daterange_id"]
    match = (
        F.when(c["context_type"] == "SEGMENT", name.isNull() & same)
        .when(c["context_type"] == "MAP", (kind == "MAP") & (F.col("media_sequence") >= c["media_sequence"]) & (F.col("resolved") == c["url"]))
        .when(c["context_type"] == "PART", (kind == "PART") & same & (F.col("part_index") == c["part_index"]))
        .when(c["context_type"] == "SCTE35", of_range & (name == F.concat(F.lit("SCTE35-"), c["command_type"])))
        .when(c["context_type"] == "ASSET_LIST", of_range & (name == "X-ASSET-LIST"))
        .when(c["context_type"] == "DATERANGE_SCHEDULE", of_range & (name == "X-URI"))
    )
    return links.withColumn("is_highlighted", F.coalesce(match, F.lit(False)))
