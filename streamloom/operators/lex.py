"""Playlists as lines: classification, tag names, ordered attribute lists and the media flag, all by column expressions.

Input: ``playlist_url``, ``body`` and any other columns. A body that is empty gives no lines; one whose first line is not
the header gives one row with ``error`` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_ERROR = "Error: playlist identifier (#EXTM3U) not present"
#: Tags that are parsed when met; all others stay raw until a later operator asks.
PARSED = ("M3U", "-X-MEDIA-SEQUENCE", "-X-BYTERANGE", "-X-DEFINE")
#: Raw tags of media segments and media metadata; any of them marks a media playlist from there on.
MEDIA_TAGS = ("INF", "-X-DISCONTINUITY", "-X-KEY", "-X-MAP", "-X-PROGRAM-DATE-TIME", "-X-GAP", "-X-BITRATE", "-X-PART", "-X-DATERANGE", "-X-SKIP", "-X-PRELOAD-HINT", "-X-RENDITION-REPORT")
_PAIR = r'([A-Z0-9-]+)=("[^"]*"|[^,]*)'
_LIST = r'^[A-Z0-9-]+=("[^"]*"|[^",]*)(,[A-Z0-9-]+=("[^"]*"|[^",]*))*$'


def attributes(value) -> Column:
    """(name, value, quoted) in order; NULL if the text is no attribute list. Quotes are not part of the value."""
    names = F.regexp_extract_all(value, F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all(value, F.lit(_PAIR), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.when(v.startswith('"'), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v).alias("value"), v.startswith('"').alias("quoted")))
    return F.when(value.rlike(_LIST), pairs)


def first_quoted(attrs, name: str) -> Column:
    """The first attribute of that name, if it is quoted."""
    found = F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))
    return F.when(found["quoted"], found["value"])


def last_quoted(attrs, name: str) -> Column:
    """The last attribute of that name, if it is quoted: an unquoted one hides earlier quoted ones."""
    found = F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))
    return F.when(found["quoted"], found["value"])


def byte_count(text: Column) -> Column:
    """A whole number below 2^63; NULL for anything else."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))


def length_and_offset(text: Column) -> tuple[Column, Column]:
    """``length`` or ``length@offset``."""
    parts = F.split(text, "@", 2)
    return byte_count(F.get(parts, F.lit(0))), byte_count(F.get(parts, F.lit(1)))


def whole_lines(body: Column) -> Column:
    """The lines up to the first that cannot be read: one with a carriage return that no line feed follows."""
    readable = F.split(F.get(F.split(body, "\r(?!\n)", 2), F.lit(0)), "\r?\n")
    return F.when(body.rlike("\r(?!\n)"), F.slice(readable, F.lit(1), F.size(readable) - 1)).otherwise(F.split(body, "\r?\n"))


def lines(playlists: DataFrame) -> DataFrame:
    """One row per line: line_no, raw, kind (tag, comment, blank, uri), tag_name (without ``#EXT``), value, error.

    A line that cannot be read ends the playlist silently; the lines before it are kept.
    """
    rows = playlists.filter(F.col("body") != "").withColumn("_lines", whole_lines(F.col("body"))).withColumn("_headed", F.coalesce(F.get("_lines", F.lit(0)) == "#EXTM3U", F.lit(False)))
    first = F.array(F.get(F.split("body", "\r?\n", 2), F.lit(0)))
    rows = rows.select("*", F.posexplode(F.when(F.col("_headed"), F.col("_lines")).otherwise(first)).alias("line_no", "raw"))
    rows = rows.withColumn("error", F.when(~F.col("_headed"), HEADER_ERROR)).drop("body", "_lines", "_headed")
    kind = F.when(F.col("raw") == "", "blank").when(F.col("raw").startswith("#EXT"), "tag").when(F.col("raw").startswith("#"), "comment").otherwise("uri")
    is_tag = F.col("kind") == "tag"
    return rows.withColumn("kind", kind).withColumns({
        "tag_name": F.when(is_tag, F.regexp_extract("raw", "^#EXT([^:]*)", 1)),
        "value": F.when(is_tag & F.col("raw").contains(":"), F.regexp_extract("raw", "(?s)^[^:]*:(.*)$", 1)),
    })


def with_attributes(rows: DataFrame, *tag_names: str) -> DataFrame:
    """Adds ``attrs``, parsed for the named tags only (all tags if none is named)."""
    wanted = F.col("kind") == "tag"
    if tag_names:
        wanted &= F.col("tag_name").isin(*tag_names)
    return rows.withColumn("attrs", F.when(wanted, attributes(F.col("value"))))


def markup(raw: Column, tag_name: Column, attrs: Column, links: Column) -> Column:
    """Text and link runs of a tag. ``links``: for each attribute in order a (href, highlighted) struct, NULL for none.

    Quotes stand outside of links; a run of text that would be empty at the end is left out.
    """
    seed = F.struct(F.array().cast("array<struct<kind:string,text:string,href:string,highlighted:boolean>>").alias("runs"), F.concat(F.lit("#EXT"), tag_name, F.lit(":")).alias("text"), F.lit("").alias("comma"))
    run = lambda kind, text, href, lit: F.struct(F.lit(kind).alias("kind"), text.alias("text"), href.alias("href"), lit.alias("highlighted"))
    none = F.lit(None)

    def step(acc: Column, pair: Column) -> Column:
        a, link = pair["a"], pair["l"]
        quote = F.when(a["quoted"], '"').otherwise("")
        head = F.concat(acc["text"], acc["comma"], a["name"], F.lit("="), quote)
        linked = F.array(run("string", head, none.cast("string"), none.cast("boolean")), run("link", a["value"], link["href"], link["highlighted"]))
        with_link = link["href"].isNotNull()
        return F.struct(F.when(with_link, F.concat(acc["runs"], linked)).otherwise(acc["runs"]).alias("runs"), F.when(with_link, quote).otherwise(F.concat(head, a["value"], quote)).alias("text"), F.lit(",").alias("comma"))

    def finish(acc: Column) -> Column:
        return F.when(acc["text"] != "", F.concat(acc["runs"], F.array(run("string", acc["text"], none.cast("string"), none.cast("boolean"))))).otherwise(acc["runs"])

    pairs = F.zip_with(attrs, links, lambda a, k: F.struct(a.alias("a"), k.alias("l")))
    whole = F.array(run("string", raw, none.cast("string"), none.cast("boolean")))
    return F.when(attrs.isNull(), whole).otherwise(F.aggregate(pairs, seed, step, finish))
