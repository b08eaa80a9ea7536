"""What a viewer shows for a request, as plans: the playlist with links, a segment by its kind, messages and JSON views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions import codec
from streamloom.operators import boxes, classify, jsonviews, lex, links, scte35, state

UNSUPPORTED = "Error: unsupported segment type"
BAD_CONTEXT = "Error: unable to parse query parameter for supplemental view"
UNSUPPORTED_DETAIL = "Currently only WebVTT and Fragmented MPEG-4 segments are supported"


def playlist(playlists: DataFrame) -> DataFrame:
    """Lines with state: (playlist_url, line_no, raw, kind, tag_name, media_sequence, part_index, range_start, range_end, ...)."""
    return state.scan(lex.lines(playlists))


def links_of(playlists: DataFrame) -> DataFrame:
    return links.link_rows(playlists)


def rendered(playlists: DataFrame, context: str | None = None) -> DataFrame:
    """(playlist_url, line_no, kind, runs): each line as it is shown, with links and, for a decoded context, highlights.

    ``runs`` are (kind, text, href, highlighted). Texts stay as written; a tag whose attributes are not read is one run.
    """
    found = links.link_rows(playlists)
    found = links.with_highlights(found, context) if context else found.withColumn("is_highlighted", F.lit(False))
    link = F.struct("href", F.col("is_highlighted").alias("highlighted"))
    per_line = found.groupBy(F.col("playlist_url").alias("_url"), F.col("line_no").alias("_line")).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", link))).alias("_links"))
    shown = lex.with_attributes(lex.lines(playlists), *links.PLAYLIST_TAGS, state.MAP, state.PART, links.DATERANGE)
    shown = shown.join(per_line, (F.col("playlist_url") == F.col("_url")) & (F.col("line_no") == F.col("_line")), "left")
    of_attrs = F.transform("attrs", lambda a, i: F.try_element_at("_links", i))
    of_uri = F.try_element_at("_links", F.lit(0))
    run = lambda kind, href, lit: F.array(F.struct(F.lit(kind).alias("kind"), F.col("raw").alias("text"), href.alias("href"), lit.alias("highlighted")))
    plain = run("string", F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    linked = run("link", of_uri["href"], of_uri["highlighted"])
    runs = F.when(F.col("attrs").isNotNull(), lex.markup(F.col("raw"), F.col("tag_name"), F.col("attrs"), of_attrs)).when((F.col("kind") == "uri") & of_uri.isNotNull(), linked).otherwise(plain)
    return shown.select("playlist_url", "line_no", "kind", runs.alias("runs"))


def dispatch(rows: DataFrame) -> DataFrame:
    """What each request shows, from its ``fetch_error`` (error, extra_info) and decoded ``context`` (NULL if none is asked for).

    Adds view (FAILED, PLAYLIST, BAD_CONTEXT or the context's type), shows_playlist, target (the address to fetch for the view),
    range_header, error and detail. No row is dropped.
    """
    failed, context = F.col("fetch_error").isNotNull(), F.col("context")
    view = F.when(failed, "FAILED").when(context.isNull(), "PLAYLIST").when(context["error"].isNotNull(), "BAD_CONTEXT").otherwise(context["context_type"])
    texts = F.create_map(*(F.lit(x) for pair in codec.CONTEXT_ERRORS.items() for x in pair))
    rows = rows.withColumn("view", view)
    bad, ranged = F.col("view") == "BAD_CONTEXT", F.col("view").isin("SEGMENT", "MAP", "PART") & context["range_start"].isNotNull()
    return rows.withColumns({
        "shows_playlist": ~failed,
        "target": F.when(~failed & ~bad, context["url"]),
        "range_header": F.when(ranged, codec.range_header(context["range_start"], context["range_end"])),
        "error": F.when(failed, F.col("fetch_error.error")).when(bad, BAD_CONTEXT),
        "detail": F.when(failed, F.col("fetch_error.extra_info")).when(bad, F.try_element_at(texts, context["error"])),
    })


def segments(playlists: DataFrame) -> DataFrame:
    """(playlist_url, ordinal, uri, media_sequence, range_start, range_end) of every uri line."""
    from pyspark.sql import Window

    rows = playlist(playlists).filter("kind = 'uri'")
    order = F.row_number().over(Window.partitionBy("playlist_url").orderBy("line_no"))
    return rows.select("playlist_url", order.alias("ordinal"), F.col("raw").alias("uri"), "media_sequence", "range_start", "range_end", "is_media")


def summary(playlists: DataFrame) -> DataFrame:
    """Counts of lines, uris, parts and maps, covered bytes and kind of each playlist."""
    rows = playlist(playlists)
    tag = lambda name: F.sum((F.col("tag_name") == name).cast("long"))
    return rows.groupBy("playlist_url").agg(
        F.count("*").alias("n_lines"),
        F.sum((F.col("kind") == "uri").cast("long")).alias("n_uris"),
        F.coalesce(tag("-X-PART"), F.lit(0)).alias("n_parts"),
        F.coalesce(tag("-X-MAP"), F.lit(0)).alias("n_maps"),
        F.coalesce(F.sum(F.when(F.col("kind") == "uri", F.col("range_end") - F.col("range_start") + 1)), F.lit(0)).alias("ranged_bytes"),
        F.max("is_media").alias("is_media"),
    )


def segment_views(responses: DataFrame) -> DataFrame:
    """(…, segment_type, text, data_uri, error, detail) of (url, content_type, content) rows; box tables come from ``media_boxes``."""
    typed = responses.withColumn("segment_type", classify.segment_type("content_type", "url", "content"))
    kind = F.col("segment_type")
    return typed.withColumns({
        "text": F.when(kind == "WebVtt", codec.lossy_utf8("content")),
        "data_uri": F.when(kind == "Image", classify.data_uri("content_type", "content")),
        "error": F.when(kind == "Unknown", UNSUPPORTED).when((kind == "Image") & F.col("content_type").isNull(), "Error: unknown content type for image segment"),
        "detail": F.when(kind == "Unknown", UNSUPPORTED_DETAIL),
    })


def media_boxes(responses: DataFrame) -> DataFrame:
    """Box properties of those responses that are fragmented MP4."""
    typed = responses.withColumn("segment_type", classify.segment_type("content_type", "url", "content")).filter("segment_type = 'Mp4'")
    return boxes.box_properties(typed, id_col="url")


def scte35_view(contexts: DataFrame) -> DataFrame:
    return scte35.table(contexts)


def asset_list_view(responses: DataFrame, json_col: str = "json") -> DataFrame:
    return jsonviews.asset_links(jsonviews.asset_rows(responses, json_col))


def schedule_view(responses: DataFrame, json_col: str = "json") -> DataFrame:
    return jsonviews.schedule_rows(responses, json_col)


def error_view(rows: DataFrame, detail_col: str = "extra_info") -> DataFrame:
    """Adds ``shown``: the detail, indented if it is JSON."""
    return rows.withColumn("shown", jsonviews.pretty_json(F.col(detail_col)))
