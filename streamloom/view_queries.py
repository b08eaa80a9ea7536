"""Queries over playlists and views: links, highlights, markup, definitions, requests, answers, messages and headers.

Texts are built from table columns, read back by the operators, and compared with what SQL works out from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.box_queries import box, content
from streamloom.functions import codec, urls
from streamloom.operators import boxes, classify, drm, jsonviews, lex, links, scte35, state
from streamloom.plans import synth, views
from streamloom.plans.synth import be, dealt, raw, table
from streamloom.registry import query
from streamloom.sources import readers

HLS = "https://example.com/hls/"


def text(*parts) -> F.Column:
    """Literal texts and columns (as texts) put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def long(name: str) -> F.Column:
    return F.col(name).cast("bigint").alias(name)


# --- media playlists: one per customer, a block of lines per order


def media_playlists(spark, sf_dir: str) -> DataFrame:
    """Each order is a map, a part, and a segment whose uri holds a variable; the variable is defined in the second line."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    url = text(HLS, F.col("c"), "/live.m3u8")
    first = o.select("c").distinct().select(url.alias("playlist_url"), F.lit(-1).cast("bigint").alias("ord"), F.array(text('#EXT-X-DEFINE:NAME="V",VALUE="v', F.col("c"), '"')).alias("lines"))
    block = F.array(
        text('#EXT-X-MAP:URI="init-{$V}.mp4",BYTERANGE="', F.col("k") % 90 + 1, "@", F.col("k"), '"'),
        text('#EXT-X-PART:DURATION=1,URI="../p', F.col("k"), '.m4s",BYTERANGE="', F.col("k") % 80 + 1, "@", F.col("k") * 2, '"'),
        F.lit("#EXTINF:6,"),
        text("{$V}/seg-", F.col("k"), ".m4s?a=", F.col("k"), "&b"),
    )
    lines = first.unionByName(o.select(url.alias("playlist_url"), F.col("k").alias("ord"), block.alias("lines")))
    # An order is four lines.
    return synth.bodies(lines.repartition(synth.tasks(o, synth.TASK_LINES // 4), "playlist_url"))


MEDIA_SQL = """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders),
base AS (SELECT *, 'https://example.com/hls/' || c || '/live.m3u8' AS playlist_url, '?playlist_url=https://example.com/hls/' || c || '/live.m3u8&supplemental_view_context=' AS head,
  'https://example.com/hls/' || c || '/init-v' || c || '.mp4' AS map_url, 'https://example.com/hls/p' || k || '.m4s' AS part_url, 'https://example.com/hls/' || c || '/v' || c || '/seg-' || k || '.m4s?a=' || k || '&b' AS seg_url FROM o),
l AS (
  SELECT c, k, seq, CAST(2 + 4 * seq AS BIGINT) AS line_no, 'MAP' AS link_type, 'URI' AS attribute, CAST(0 AS BIGINT) AS part_index, map_url AS resolved, head || 'MAP,' || seq || ',' || k || '-' || (k + k % 90) || ',' || map_url AS href FROM base
  UNION ALL SELECT c, k, seq, 3 + 4 * seq, 'PART', 'URI', 0, part_url, head || 'PART,0,' || seq || ',' || (2 * k) || '-' || (2 * k + k % 80) || ',' || part_url FROM base
  UNION ALL SELECT c, k, seq, 5 + 4 * seq, 'SEGMENT', NULL, 1, seg_url, head || 'SEGMENT,' || seq || ',-,' || replace(replace(seg_url, '=', '%3D'), '&', '%26') FROM base)
"""


@query(MEDIA_SQL + "SELECT c AS o_custkey, line_no, link_type, attribute, CAST(seq AS BIGINT) AS media_sequence, part_index, resolved, href FROM l")
def media_links(spark, sf_dir: str) -> DataFrame:
    """Map, part and segment links with byte ranges, sequence numbers and a variable."""
    rows = links.link_rows(media_playlists(spark, sf_dir))
    return rows.select(F.regexp_extract("playlist_url", "/([0-9]+)/live", 1).cast("bigint").alias("o_custkey"), long("line_no"), "link_type", "attribute", long("media_sequence"), long("part_index"), "resolved", "href")


@query(MEDIA_SQL + """
SELECT c AS o_custkey, line_no, CASE c % 4 WHEN 0 THEN link_type = 'SEGMENT' AND seq = 1 WHEN 1 THEN link_type = 'MAP' AND seq >= 1 WHEN 2 THEN link_type = 'PART' AND seq = 2 ELSE false END AS is_highlighted FROM l
""")
def media_highlights(spark, sf_dir: str) -> DataFrame:
    """Which links a chosen segment, map or part lights up; the choice differs by playlist."""
    playlists = media_playlists(spark, sf_dir).withColumn("c", F.regexp_extract("playlist_url", "/([0-9]+)/live", 1).cast("bigint"))
    init = text(HLS, F.col("c"), "/init-v", F.col("c"), ".mp4")
    asked = F.when(F.col("c") % 4 == 0, "SEGMENT,1,-,x").when(F.col("c") % 4 == 1, text("MAP,1,-,", init)).when(F.col("c") % 4 == 2, "PART,0,2,-,x")
    rows = codec.decode_contexts(playlists.withColumn("asked", asked), "asked", "context_asked")
    out = links.with_highlights(links.link_rows(rows))
    return out.select(F.col("c").alias("o_custkey"), long("line_no"), "is_highlighted")


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders),
h AS (SELECT *, '?playlist_url=https://example.com/hls/' || c || '/live.m3u8&supplemental_view_context=' AS head, 'https://example.com/hls/' || c || '/init-v' || c || '.mp4' AS m FROM o),
r AS (
  SELECT c, CAST(0 AS BIGINT) AS line_no, 'string|#EXTM3U||' AS runs FROM o WHERE seq = 0
  UNION ALL SELECT c, 1, 'string|#EXT-X-DEFINE:NAME="V",VALUE="v' || c || '"||' FROM o WHERE seq = 0
  UNION ALL SELECT c, 2 + 4 * seq, 'string|#EXT-X-MAP:URI="||;link|init-{$V}.mp4|' || head || 'MAP,' || seq || ',' || k || '-' || (k + k % 90) || ',' || m || '|' || (seq >= 1) || ';string|",BYTERANGE="' || (k % 90 + 1) || '@' || k || '"||' FROM h
  UNION ALL SELECT c, 3 + 4 * seq, 'string|#EXT-X-PART:DURATION=1,URI="||;link|../p' || k || '.m4s|' || head || 'PART,0,' || seq || ',' || (2 * k) || '-' || (2 * k + k % 80) || ',https://example.com/hls/p' || k || '.m4s|false;string|",BYTERANGE="' || (k % 80 + 1) || '@' || (2 * k) || '"||' FROM h
  UNION ALL SELECT c, 4 + 4 * seq, 'string|#EXTINF:6,||' FROM h
  UNION ALL SELECT c, 5 + 4 * seq, 'link|{$V}/seg-' || k || '.m4s?a=' || k || '&b|' || head || 'SEGMENT,' || seq || ',-,https://example.com/hls/' || c || '/v' || c || '/seg-' || k || '.m4s?a%3D' || k || '%26b|false' FROM h)
SELECT c AS o_custkey, line_no, runs FROM r
""")
def rendered_playlists(spark, sf_dir: str) -> DataFrame:
    """Every line as runs of text and links, texts as written, with the maps of a chosen context lit up."""
    playlists = media_playlists(spark, sf_dir).withColumn("c", F.regexp_extract("playlist_url", "/([0-9]+)/live", 1))
    asked = playlists.withColumn("asked", text("MAP,1,-,", HLS, F.col("c"), "/init-v", F.col("c"), ".mp4")).drop("c")
    rows = views.rendered(codec.decode_contexts(asked, "asked", "context_asked"), "context_asked")
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws("|", r["kind"], r["text"], F.coalesce(r["href"], F.lit("")), F.coalesce(r["highlighted"].cast("string"), F.lit("")))), ";")
    return rows.select(F.regexp_extract("playlist_url", "/([0-9]+)/live", 1).cast("bigint").alias("o_custkey"), long("line_no"), shown.alias("runs"))


# --- multivariant playlists: one per nation, a block per supplier


@query("""
WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
d AS (SELECT *, 'https://example.com/hls/' || n || '/' AS u, '&imported_definitions=A%253Da' || k || '%2526%22B%253D' AS defs FROM s),
l AS (
  SELECT n, 1 + 6 * i AS line_no, 'URI' AS attribute, 'a-{$A}.m3u8' AS text, u || 'a-' || CASE WHEN i = 0 THEN '%7B$A%7D' ELSE 'a' || lag(k) OVER (PARTITION BY n ORDER BY k) || '%26' END || '.m3u8' AS resolved, CASE WHEN i > 0 THEN lag(defs) OVER (PARTITION BY n ORDER BY k) ELSE '' END AS defs FROM d
  UNION ALL SELECT n, 3 + 6 * i, 'URI', 'i.m3u8', u || 'i.m3u8', CASE WHEN i = 0 THEN replace(defs, '%22B%253D', '') ELSE defs END FROM d
  UNION ALL SELECT n, 5 + 6 * i, 'URI', '/t-{$A}', 'https://example.com/t-a' || k || '&', defs FROM d
  UNION ALL SELECT n, 6 + 6 * i, NULL, 'v{$B}.m3u8#t', u || 'v.m3u8#t', defs FROM d)
SELECT n AS s_nationkey, CAST(line_no AS BIGINT) AS line_no, 'PLAYLIST' AS link_type, attribute, text, '?playlist_url=' || replace(replace(replace(CASE WHEN text = 'a-{$A}.m3u8' THEN replace(resolved, '%26', '&') ELSE resolved END, '%', '%25'), '#', '%23'), '&', '%26') || defs AS href FROM l
""")
def variant_links(spark, sf_dir: str) -> DataFrame:
    """Renditions, I-frame and image streams and variants, with the definitions in force at each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))
    block = F.array(
        F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="a-{$A}.m3u8"'),
        text('#EXT-X-DEFINE:NAME="A",VALUE="a', F.col("k"), '&"'),
        F.lit('#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=1,URI="i.m3u8"'),
        F.lit('#EXT-X-DEFINE:NAME="B",VALUE=""'),
        F.lit('#EXT-X-IMAGE-STREAM-INF:BANDWIDTH=1,URI="/t-{$A}"'),
        F.lit("v{$B}.m3u8#t"),
    )
    rows = links.link_rows(synth.bodies(s.select(text(HLS, F.col("n"), "/main.m3u8").alias("playlist_url"), F.col("k").alias("ord"), block.alias("lines"))))
    return rows.select(F.regexp_extract("playlist_url", "/([0-9]+)/main", 1).cast("int").alias("s_nationkey"), long("line_no"), "link_type", "attribute", "text", "href")


@query("""
WITH e AS (SELECT user_id AS u, event_id AS id, event_type AS t FROM events),
d AS (
  SELECT u, id, CASE t WHEN 'click' THEN 'n' || id % 3 WHEN 'view' THEN 'imp' WHEN 'signup' THEN 'q' END AS name, CASE t WHEN 'click' THEN CAST(id AS VARCHAR) WHEN 'view' THEN 'I' || u WHEN 'signup' THEN 'Q' || u END AS value FROM e WHERE t IN ('click', 'view', 'signup')),
p AS (SELECT e.u, e.id, d.name, min(d.id) AS first, arg_max(d.value, d.id) AS value FROM e JOIN d ON d.u = e.u AND d.id < e.id WHERE e.t IN ('purchase', 'error') GROUP BY 1, 2, 3),
g AS (SELECT u, id, string_agg(name || '=' || value, ';' ORDER BY first) AS definitions FROM p GROUP BY 1, 2)
SELECT e.u AS user_id, e.id AS event_id, coalesce(g.definitions, '') AS definitions, CASE WHEN e.t = 'error' THEN 'no value for none' END AS define_error FROM e LEFT JOIN g ON g.u = e.u AND g.id = e.id WHERE e.t IN ('purchase', 'error')
""")
def definitions_in_force(spark, sf_dir: str) -> DataFrame:
    """Variables named, imported and taken from the viewer's query, as they stand at uris and at definitions that fail."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    line = (
        F.when(kind == "click", text('#EXT-X-DEFINE:NAME="n', F.col("event_id") % 3, '",VALUE="', F.col("event_id"), '"'))
        .when(kind == "view", '#EXT-X-DEFINE:IMPORT="imp"')
        .when(kind == "signup", '#EXT-X-DEFINE:QUERYPARAM="q"')
        .when(kind == "error", text('#EXT-X-DEFINE:IMPORT="none",X-ID=', F.col("event_id")))
        .otherwise(text("u", F.col("event_id")))
    )
    given = synth.bodies(e.select(F.col("user_id").cast("string").alias("playlist_url"), F.col("event_id").alias("ord"), F.array(line).alias("lines")))
    given = given.withColumns({"imported_definitions": F.create_map(F.lit("imp"), text("I", F.col("playlist_url"))), "viewer_query": F.create_map(F.lit("q"), text("Q", F.col("playlist_url")))})
    rows = state.definitions(lex.lines(given)).filter(F.col("define_error").isNotNull() | (F.col("kind") == "uri"))
    shown = F.array_join(F.transform("definitions", lambda d: F.concat(d["name"], F.lit("="), d["value"])), ";")
    return rows.select(long("playlist_url").alias("user_id"), F.regexp_extract("raw", "([0-9]+)$", 1).cast("bigint").alias("event_id"), shown.alias("definitions"), "define_error")


@query("""
WITH e AS (SELECT user_id AS u, event_id AS id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events),
bad AS (SELECT u, min(line) AS line FROM e WHERE t = 'signup' AND id % 5 = 0 GROUP BY u)
SELECT e.u AS user_id, CAST(e.line AS BIGINT) AS line_no, 'u' || e.id AS raw FROM e LEFT JOIN bad ON bad.u = e.u WHERE e.line < coalesce(bad.line, 1000000000)
""")
def truncated_playlists(spark, sf_dir: str) -> DataFrame:
    """A line with a carriage return of its own ends a playlist without a word; line ends of both kinds are read."""
    e = table(spark, sf_dir, "events")
    odd = (F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0)
    line = F.concat(F.lit("u"), F.col("event_id").cast("string"), F.when(odd, "\rrest").when(F.col("event_id") % 2 == 0, "\r").otherwise(""))
    rows = lex.lines(synth.bodies(e.select(F.col("user_id").cast("string").alias("playlist_url"), F.col("event_id").alias("ord"), F.array(line).alias("lines"))).withColumn("body", F.concat("body", F.lit("\n"))))
    return rows.filter("line_no > 0 AND raw <> ''").select(long("playlist_url").alias("user_id"), long("line_no"), "raw")


# --- date ranges and schedules


def asset_ranges(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    tag = F.concat(
        F.lit("#EXT-X-DATERANGE:"),
        F.when(F.col("k") % 4 != 0, text('ID="d', F.col("k"), '",')).otherwise(""),
        text(f'CLASS="{links.SCHEDULE}",X-URI="s', F.col("k"), '",X-ASSET-URI="ad/', F.col("k"), '.m3u8",X-ASSET-LIST="list?n=', F.col("k"), '",SCTE35-IN=0xFC01,SCTE35-CMD="0xFC', F.col("k"), '"'),
    )
    return synth.bodies(dealt(o.select(text(HLS, F.col("c"), "/live.m3u8").alias("playlist_url"), F.col("k").alias("ord"), F.array(tag).alias("lines")), "playlist_url", synth.TASK_LINES))


ASSET_SQL = """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no FROM orders),
b AS (SELECT *, k % 4 <> 0 AS has_id, '?playlist_url=https://example.com/hls/' || c || '/live.m3u8&imported_definitions=X%253D1&supplemental_view_context=' AS head FROM o),
l AS (
  SELECT c, k, line_no, 'X-ASSET-URI' AS attribute, 'PLAYLIST' AS link_type, '?playlist_url=https://example.com/hls/' || c || '/ad/' || k || '.m3u8' AS href FROM b
  UNION ALL SELECT c, k, line_no, 'X-ASSET-LIST', 'ASSET_LIST', head || 'ASSET_LIST,d' || k || '%22https://example.com/hls/' || c || '/list?n%3D' || k FROM b WHERE has_id
  UNION ALL SELECT c, k, line_no, 'X-URI', 'DATERANGE_SCHEDULE', head || 'DATERANGE_SCHEDULE,d' || k || '%22https://example.com/hls/' || c || '/s' || k FROM b WHERE has_id
  UNION ALL SELECT c, k, line_no, 'SCTE35-IN', 'SCTE35', head || 'SCTE35,IN,d' || k || '%220xFC01' FROM b WHERE has_id
  UNION ALL SELECT c, k, line_no, 'SCTE35-CMD', 'SCTE35', head || 'SCTE35,CMD,d' || k || '%220xFC' || k FROM b WHERE has_id)
"""


@query(ASSET_SQL + "SELECT c AS o_custkey, CAST(line_no AS BIGINT) AS line_no, attribute, link_type, href FROM l")
def daterange_assets(spark, sf_dir: str) -> DataFrame:
    """Assets, asset lists and splice messages of date ranges; the definitions of the viewer's address pass as they came."""
    rows = links.link_rows(asset_ranges(spark, sf_dir).withColumn("definitions_query", F.lit("X%253D1")))
    return rows.select(F.regexp_extract("playlist_url", "/([0-9]+)/live", 1).cast("bigint").alias("o_custkey"), long("line_no"), "attribute", "link_type", "href")


@query(ASSET_SQL + """
, f AS (SELECT c, min(k) AS k FROM b WHERE has_id GROUP BY c)
SELECT l.c AS o_custkey, CAST(line_no AS BIGINT) AS line_no, attribute, coalesce(l.k = f.k AND attribute = CASE l.c % 3 WHEN 0 THEN 'SCTE35-CMD' WHEN 1 THEN 'X-ASSET-LIST' ELSE 'X-URI' END, false) AS is_highlighted FROM l LEFT JOIN f ON f.c = l.c
""")
def daterange_highlights(spark, sf_dir: str) -> DataFrame:
    """Which attributes a chosen message, asset list or schedule lights up."""
    first = table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    chosen = first.select(text(HLS, F.col("o_custkey"), "/live.m3u8").alias("url"), F.when(F.col("o_custkey") % 3 == 0, text("SCTE35,CMD,d", F.col("k"), '"0x')).when(F.col("o_custkey") % 3 == 1, text("ASSET_LIST,d", F.col("k"), '"x')).otherwise(text("DATERANGE_SCHEDULE,d", F.col("k"), '"x')).alias("asked"))
    playlists = asset_ranges(spark, sf_dir).join(chosen, F.col("playlist_url") == F.col("url"), "left").drop("url")
    rows = codec.decode_contexts(playlists, "asked", "context_asked")
    out = links.with_highlights(links.link_rows(rows))
    return out.select(F.regexp_extract("playlist_url", "/([0-9]+)/live", 1).cast("bigint").alias("o_custkey"), long("line_no"), "attribute", "is_highlighted")


@query("""
WITH o AS (SELECT o_orderkey AS k, '?playlist_url=https://example.com/a/live.m3u8' AS base FROM orders)
SELECT k AS o_orderkey, 'ID' AS name, NULL AS link_type, NULL AS href FROM o
UNION ALL SELECT k, 'X-ASSET-LIST', 'ASSET_LIST', base || '&supplemental_view_context=ASSET_LIST,s' || k || '%22https://example.com/l?k%3D' || k FROM o
UNION ALL SELECT k, 'X-ASSET-URI', 'PLAYLIST', '?playlist_url=https://example.com/a/' || k || '.m3u8' FROM o
UNION ALL SELECT k, 'X-NESTED', NULL, NULL FROM o
""")
def schedule_links(spark, sf_dir: str) -> DataFrame:
    """Rows of schedules with the links of their assets."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    doc = text('{"DATERANGES":[{"X-ASSET-URI":"', F.col("k"), '.m3u8","X-NESTED":{"b":[1,2],"a":null},"ID":"s', F.col("k"), '","X-ASSET-LIST":"/l?k=', F.col("k"), '"}]}')
    rows = views.schedule_view(o.select("k", doc.alias("json"), F.lit("https://example.com/a/live.m3u8").alias("playlist_url")))
    return rows.select(F.col("k").alias("o_orderkey"), "name", "link_type", "href")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'ad.m3u8' END AS uri, CASE WHEN o_orderkey % 5 IN (0, 1) THEN CAST(o_orderkey % 30 AS DOUBLE) END AS duration,
       CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey AS BIGINT) END AS skip_offset, CASE WHEN o_orderkey % 5 = 1 THEN CAST(7 AS BIGINT) END AS skip_duration, CASE WHEN o_orderkey % 5 = 1 THEN 'L' END AS skip_label_id, CASE WHEN o_orderkey % 5 > 1 THEN 'not an asset list' END AS error FROM orders
""")
def asset_list_controls(spark, sf_dir: str) -> DataFrame:
    """Asset lists with and without a skip control, and documents that are none: a label missing, a uri missing, no JSON."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    assets = text('{"ASSETS":[{"URI":"ad.m3u8","DURATION":', k % 30, "}]")
    doc = F.when(k % 5 == 0, F.concat(assets, F.lit(',"X":1}'))).when(k % 5 == 1, text(assets, ',"SKIP-CONTROL":{"OFFSET":', k, ',"DURATION":7,"LABEL-ID":"L"}}')).when(k % 5 == 2, F.concat(assets, F.lit(',"SKIP-CONTROL":{"OFFSET":1,"DURATION":7}}'))).when(k % 5 == 3, '{"ASSETS":[{"DURATION":1}]}').otherwise("{")
    rows = jsonviews.asset_rows(o.select("o_orderkey", doc.alias("json")))
    return rows.select("o_orderkey", "uri", "duration", long("skip_offset"), long("skip_duration"), "skip_label_id", "error")


# --- requests and answers

#: (context after decoding, type, error): every kind and every error.
CONTEXTS = [
    ("SEGMENT,7,1-2,https://x/a,b", "SEGMENT", None),
    ("MAP,+7,-,u", "MAP", None),
    ("PART,3,7,5-4,u", "PART", None),
    ('SCTE35,OUT,id,1"0xFC"x', "SCTE35", None),
    ('SCTE35,IN,"0x', "SCTE35", None),
    ('SCTE35,CMD,id"', "SCTE35", None),
    ('ASSET_LIST,id"https://x/?a=b', "ASSET_LIST", None),
    ('DATERANGE_SCHEDULE,id,"u', "DATERANGE_SCHEDULE", None),
    ("segment,7,-,u", None, "UnknownContextType"),
    ("", None, "UnknownContextType"),
    ("SEGMENT", None, "EmptyContextValue"),
    ("SEGMENT,x,-,u", None, "MediaSequencePartParseIntFailure"),
    ("SEGMENT,18446744073709551616,-,u", None, "MediaSequencePartParseIntFailure"),
    ("SEGMENT, 7,-,u", None, "MediaSequencePartParseIntFailure"),
    ("MAP,7", None, "MissingRangePart"),
    ("MAP,7,1_2,u", None, "RangeParseFailure"),
    ("MAP,7,1-x,u", None, "RangeParseFailure"),
    ("MAP,7,-", None, "MissingUrlPart"),
    ("PART,4294967296,7,-,u", None, "PartIndexParseIntFailure"),
    ("PART,3", None, "MissingMediaSequencePart"),
    ("SCTE35,out,id", None, "InvalidCommandType"),
    ("SCTE35,OUT", None, "MissingDaterangeId"),
    ("SCTE35,OUT,id", None, "MissingScte35Message"),
    ("ASSET_LIST,id", None, "MissingAssetListUrl"),
]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


CONTEXT_VALUES = ", ".join(f"({k}, {_quoted(c)}, {_quoted(t)}, {_quoted(e)}, {_quoted(codec.CONTEXT_ERRORS.get(e))})" for k, (c, t, e) in enumerate(CONTEXTS))


def requests(spark, sf_dir: str) -> DataFrame:
    """One request per event: its context by turns, its playlist and definitions by its user."""
    e = table(spark, sf_dir, "events").withColumn("turn", (F.col("event_id") % (len(CONTEXTS) + 1)).cast("int"))
    asked = F.get(F.array(*(F.lit(c) for c, _, _ in CONTEXTS)), F.col("turn"))
    context = F.coalesce(F.concat(F.lit("&supplemental_view_context="), codec.percent_encode(asked)), F.lit(""))
    address = F.concat(F.lit("https://viewer.example/?bare&playlist_url="), codec.percent_encode(text("https://e.com/?u=", F.col("user_id"), "&é")), F.lit("&imported_definitions=a%253Db"), context, F.lit("&playlist_url=second#f"))
    failed = F.when(F.col("event_id") % 7 == 0, F.struct(F.lit("Bad HTTP status code: 404 Not Found").alias("error"), F.lit("gone").alias("extra_info")))
    return readers.requests(e.select("event_id", "user_id", address.alias("url"), failed.alias("fetch_error")))


@query(f"""
WITH c(turn, asked, kind, error, message) AS (VALUES {CONTEXT_VALUES})
SELECT event_id, 'https://e.com/?u=' || user_id || '&é' AS playlist_url, 'a%253Db' AS definitions_query, kind AS context_type, error FROM events LEFT JOIN c ON c.turn = event_id % {len(CONTEXTS) + 1}
""")
def request_contexts(spark, sf_dir: str) -> DataFrame:
    """What addresses ask for: the first of equal parameters, decoded once; every kind of context and every error of one."""
    rows = requests(spark, sf_dir)
    return rows.select("event_id", "playlist_url", "definitions_query", "context.context_type", "context.error")


@query(f"""
WITH c(turn, asked, kind, error, message) AS (VALUES {CONTEXT_VALUES}),
r AS (SELECT event_id, asked, kind, error, message, event_id % 7 = 0 AS failed FROM events LEFT JOIN c ON c.turn = event_id % {len(CONTEXTS) + 1})
SELECT event_id, CASE WHEN failed THEN 'FAILED' WHEN asked IS NULL THEN 'PLAYLIST' WHEN error IS NOT NULL THEN 'BAD_CONTEXT' ELSE kind END AS view, NOT failed AS shows_playlist,
  CASE WHEN failed THEN NULL ELSE CASE asked WHEN 'SEGMENT,7,1-2,https://x/a,b' THEN 'https://x/a,b' WHEN 'MAP,+7,-,u' THEN 'u' WHEN 'PART,3,7,5-4,u' THEN 'u' WHEN 'ASSET_LIST,id"https://x/?a=b' THEN 'https://x/?a=b' WHEN 'DATERANGE_SCHEDULE,id,"u' THEN 'u' END END AS target,
  CASE WHEN failed THEN NULL ELSE CASE asked WHEN 'SEGMENT,7,1-2,https://x/a,b' THEN 'bytes=1-2' WHEN 'PART,3,7,5-4,u' THEN 'bytes=5-4' END END AS range_header,
  CASE WHEN failed THEN 'Bad HTTP status code: 404 Not Found' WHEN error IS NOT NULL THEN 'Error: unable to parse query parameter for supplemental view' END AS error, CASE WHEN failed THEN 'gone' ELSE message END AS detail FROM r
""")
def viewer_dispatch(spark, sf_dir: str) -> DataFrame:
    """Which view each request leads to; contexts that cannot be read keep the playlist, failed fetches show the error alone."""
    return views.dispatch(requests(spark, sf_dir)).select("event_id", "view", "shows_playlist", "target", "range_header", "error", "detail")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TypeError: Failed to fetch' WHEN 1 THEN 'AbortError: aborted ' || event_id WHEN 2 THEN 'Fetch failed: JsValue(' || event_id || ')' END AS error FROM events
""")
def fetch_failures(spark, sf_dir: str) -> DataFrame:
    """Requests without an answer, by what stopped them."""
    turn, k = F.col("event_id") % 4, F.col("event_id")
    kind = F.when(turn == 0, "TypeError").when(turn == 1, "DOMException").when(turn == 2, "other")
    name = F.when(turn == 0, "TypeError").when(turn == 1, "AbortError")
    message = F.when(turn == 0, "Failed to fetch").when(turn == 1, text("aborted ", k)).when(turn == 2, text("JsValue(", k, ")"))
    return table(spark, sf_dir, "events").select("event_id", classify.fetch_failure(kind, name, message)["error"].alias("error"))


@query("""
WITH u AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://e.com/a b?u=' || user_id WHEN 1 THEN 'http://e.com/' || user_id WHEN 2 THEN 'ftp://e.com/' || user_id WHEN 3 THEN 'e.com/' || user_id WHEN 4 THEN 'https://' ELSE 'HTTPS://e.com/' END AS typed, user_id FROM events)
SELECT event_id, event_id % 6 < 2 AS accepted, CASE event_id % 6 WHEN 0 THEN '?playlist_url=https%3A%2F%2Fe.com%2Fa+b%3Fu%3D' || user_id WHEN 1 THEN '?playlist_url=http%3A%2F%2Fe.com%2F' || user_id END AS href FROM u
""")
def url_form(spark, sf_dir: str) -> DataFrame:
    """Which addresses the form takes, and where it leads."""
    turn, u = F.col("event_id") % 6, F.col("user_id")
    typed = F.when(turn == 0, text("https://e.com/a b?u=", u)).when(turn == 1, text("http://e.com/", u)).when(turn == 2, text("ftp://e.com/", u)).when(turn == 3, text("e.com/", u)).when(turn == 4, "https://").otherwise("HTTPS://e.com/")
    return table(spark, sf_dir, "events").select("event_id", readers.is_playlist_address(typed).alias("accepted"), readers.submitted(typed).alias("href"))


@query("""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, doc_id % 50 AS a, doc_id % 50 + doc_id % 400 AS z FROM documents)
SELECT doc_id, 'bytes=' || a || '-' || z AS range, CAST(greatest(0, least(z + 1, octet_length(b)) - a) AS BIGINT) AS n_bytes, lower(substr(hex(b), CAST(2 * a + 1 AS INTEGER), CAST(2 * (z - a + 1) AS INTEGER))) AS part FROM d
""")
def byte_ranges(spark, sf_dir: str) -> DataFrame:
    """Parts of every document's bytes, both ends counted, cut at the end of the bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), (F.col("doc_id") % 50).alias("range_start"), (F.col("doc_id") % 50 + F.col("doc_id") % 400).alias("range_end"))
    rows = readers.byte_range(d)
    return rows.select("doc_id", codec.range_header("range_start", "range_end").alias("range"), F.length("content").cast("bigint").alias("n_bytes"), codec.hex_encode("content").alias("part"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part)
SELECT k AS p_partkey, CASE k % 5 WHEN 0 THEN 'WebVtt' WHEN 1 THEN 'Image' WHEN 2 THEN 'Image' WHEN 3 THEN 'Unknown' ELSE 'Mp4' END AS segment_type, CASE WHEN k % 5 = 0 THEN 'WEBVTT ' || n || chr(65533) END AS text,
  CASE WHEN k % 5 = 1 THEN 'data:image/png;base64,' || to_base64(encode(n)) END AS data_uri, CASE k % 5 WHEN 3 THEN 'Error: unsupported segment type' END AS error,
  CASE WHEN k % 5 = 3 THEN 'Currently only WebVTT and Fragmented MPEG-4 segments are supported' END AS detail FROM p WHERE k % 5 <> 2
UNION ALL SELECT k, 'Image', NULL, 'data:image/jpeg;base64,' || to_base64(encode(repeat(n, 9))), NULL, NULL FROM p WHERE k % 5 = 2
""")
def segment_views(spark, sf_dir: str) -> DataFrame:
    """Segments as captions, images or media, and those that no view supports."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"))
    turn, name = F.col("k") % 5, F.encode("n", "UTF-8")
    kind = F.when(turn == 0, "text/vtt").when(turn == 1, "image/png").when(turn == 2, "image/jpeg").when(turn == 3, "video/mp2t")
    body = F.when(turn == 0, F.concat(F.encode(F.lit("WEBVTT "), "UTF-8"), name, raw("FF"))).when(turn == 2, F.encode(F.expr("repeat(n, 9)"), "UTF-8")).when(turn == 4, box("moof", content("#00"))).otherwise(name)
    rows = views.segment_views(p.select("k", F.lit("https://e.com/s.ts").alias("url"), kind.alias("content_type"), body.alias("content")))
    return rows.select(F.col("k").alias("p_partkey"), "segment_type", "text", "data_uri", "error", "detail")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' WHEN 1 THEN 'no {json' ELSE '[]' END AS shown FROM events
""")
def error_views(spark, sf_dir: str) -> DataFrame:
    """Details of errors, indented where they are JSON."""
    detail = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "no {json").otherwise("[ ]")
    return views.error_view(table(spark, sf_dir, "events").select("event_id", detail.alias("extra_info"))).select("event_id", "shown")


@query("""
SELECT p_partkey, p_name || chr(65533) || 'é' || chr(65533) AS lossy FROM part
""")
def lossy_text(spark, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 stand as U+FFFD, one for each cut-off sequence."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", codec.lossy_utf8(F.concat(F.encode("p_name", "UTF-8"), raw("FF"), raw("C3A9"), raw("E282"))).alias("lossy"))


JOINS = [
    ("https://e.com/a/b/c.m3u8?q#f", "d.ts", "https://e.com/a/b/d.ts"),
    ("https://e.com/a/b/c.m3u8", "/d.ts?x=1", "https://e.com/d.ts?x=1"),
    ("https://e.com/a/b/c.m3u8", "//other.org", "https://other.org/"),
    ("https://e.com/a/b/c.m3u8", "HTTP://Other.ORG:80/x/../y", "http://other.org/y"),
    ("https://e.com/a/b/c.m3u8", "../../../d", "https://e.com/d"),
    ("https://e.com/a/b/c.m3u8", "./", "https://e.com/a/b/"),
    ("https://e.com/a/b/c.m3u8", "..", "https://e.com/a/"),
    ("https://e.com/a/b/c.m3u8?q=1", "", "https://e.com/a/b/c.m3u8?q=1"),
    ("https://e.com/a/b/c.m3u8?q=1", "?r=2", "https://e.com/a/b/c.m3u8?r=2"),
    ("https://e.com/a/b/c.m3u8?q=1", "#frag", "https://e.com/a/b/c.m3u8?q=1#frag"),
    ("https://e.com/a b/é", "x y\"<>`{}", "https://e.com/a%20b/x%20y%22%3C%3E%60%7B%7D"),
    ("https://e.com", "a%2e%2E/b%2Fc", "https://e.com/a%2e%2E/b%2Fc"),
    ("https://e.com/x/y/", "%2e%2E/b", "https://e.com/x/b"),
    ("https://e.com:8443/x", "y", "https://e.com:8443/y"),
    ("https://u:p@e.com/x", "y", "https://u:p@e.com/y"),
    ("https://e.com/x", "a:b", "a:b"),
    ("not a url", "y", None),
    ("https://e.com/x", "\\d\\e", "https://e.com/d/e"),
    ("https://e.com/x", " y\t\n", "https://e.com/y"),
]


@query(f"WITH j(k, base, relative, resolved) AS (VALUES {', '.join(f'({k}, {_quoted(b)}, {_quoted(r)}, {_quoted(w)})' for k, (b, r, w) in enumerate(JOINS))}) SELECT p_partkey, replace(resolved, 'e.com', 'e' || p_size || '.com') AS resolved FROM part JOIN j ON j.k = p_partkey % {len(JOINS)}")
def url_join_shapes(spark, sf_dir: str) -> DataFrame:
    """Relative addresses of every shape against bases of every shape."""
    p = table(spark, sf_dir, "part")
    pick = lambda n: F.get(F.array(*(F.lit(j[n]) for j in JOINS)), (F.col("p_partkey") % len(JOINS)).cast("int"))
    base = F.replace(pick(0), F.lit("e.com"), text("e", F.col("p_size"), ".com"))
    return p.select("p_partkey", urls.resolve(base, pick(1)).alias("resolved"))


@query("""
SELECT p_partkey, [true, false, true, false, true, true, false, false][p_partkey % 8 + 1] AS probed, [true, false, true, false, false, true, false, false][p_partkey % 8 + 1] AS is_mp4 FROM part
""")
def mp4_probes(spark, sf_dir: str) -> DataFrame:
    """Which bodies pass for media: brands that can be read, a fragment on sight, and boxes before them, read into or passed over."""
    fine, odd, fragment = box("ftyp", content("'isom' 1:4 'iso5'")), box("ftyp", content("'isom' 1:4 'iso'")), box("moof", content("#00"))
    hidden, behind = box("free", fragment), F.concat(box("free", content("")), fragment)
    cases = [fine, odd, fragment, box("mdat", content("#0000")), hidden, behind, content("#00000008"), content("")]
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*cases), (F.col("p_partkey") % 8).cast("int")).alias("c"))
    return p.select("p_partkey", classify.is_mp4_probe(F.col("c")).alias("probed"), classify.is_mp4(F.col("c")).alias("is_mp4"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 200 END AS status, CASE WHEN event_id % 3 < 2 THEN 0 END AS n_bytes, CASE WHEN event_id % 3 = 2 THEN 'TypeError: no http address: blob:' || user_id END AS error FROM events
""")
def fetches_without_request(spark, sf_dir: str) -> DataFrame:
    """An empty address is an empty answer; one that no request can go to is an error. Neither is asked for."""
    url = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, text("blob:", F.col("user_id")))
    rows = readers.fetch(table(spark, sf_dir, "events").select("event_id", url.alias("url")))
    return rows.select("event_id", "status", F.length("content").alias("n_bytes"), F.col("fetch_error.error").alias("error"))


# --- messages and headers


@query("""
SELECT o_orderkey, 'd' || o_orderkey AS id, 'SCTE35-' || ['OUT', 'IN', 'CMD'][o_orderkey % 3 + 1] AS type, CASE WHEN o_orderkey % 4 = 3 THEN '0xFC3' ELSE '0xFC301100000000000000FFFFFF0000004F253396' END AS message,
  CASE WHEN o_orderkey % 4 <> 3 THEN 'splice_null' END AS decoded_command, CASE WHEN o_orderkey % 4 <> 3 THEN true END AS crc_ok, CASE WHEN o_orderkey % 4 = 3 THEN 'Error reading hex string' END AS error FROM orders
""")
def splice_tables(spark, sf_dir: str) -> DataFrame:
    """Requests for splice messages as the table that is shown: id, type, message, and the message decoded."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("OUT", "IN", "CMD"))), (k % 3).cast("int"))
    # A published example of a message: splice_null with its checksum.
    message = F.when(k % 4 == 3, "0xFC3").otherwise("0xFC301100000000000000FFFFFF0000004F253396")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", text("SCTE35,", kind, ",d", k, '"', message).alias("asked"))
    rows = views.scte35_view(codec.decode_contexts(asked, "asked").select("o_orderkey", "context.*"))
    return rows.select("o_orderkey", "id", "type", "message", F.get_json_object("decoded", "$.command").alias("decoded_command"), (F.get_json_object("decoded", "$.crc_ok") == "true").alias("crc_ok"), "error")


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'splice_insert' WHEN 1 THEN 'splice_schedule' WHEN 2 THEN 'time_signal' WHEN 3 THEN 'private_command' END AS command,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey END AS splice_event_id, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey * 3 WHEN 2 THEN 8589934591 END AS pts_time, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS break_duration,
  CASE WHEN o_orderkey % 6 = 1 THEN o_orderkey * 2 || '@' || o_orderkey || ',' || o_custkey || '@cancelled' END AS scheduled,
  CASE WHEN o_orderkey % 6 = 2 THEN '48:' || o_orderkey % 200 || '/3:7/9:ABC' || ':' || o_custkey END AS segmentation,
  CASE WHEN o_orderkey % 6 = 3 THEN 'TEST:' || lower(lpad(hex(o_orderkey), 8, '0')) END AS private, CASE o_orderkey % 6 WHEN 4 THEN 'Hex' WHEN 5 THEN 'Scte35' END AS error FROM orders
""")
def splice_commands(spark, sf_dir: str) -> DataFrame:
    """Inserts, schedules, segmentation with sub-segments and private commands, and messages that cannot be read."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c, turn = F.col("k"), F.col("c"), F.col("k") % 6
    insert = F.concat(be("k", 4), raw("7F"), raw("EF"), raw("FE"), be(k * 3, 4), raw("FE"), be("c", 4), raw("000A0102"))
    schedule = F.concat(raw("02"), be(k * 2, 4), raw("7F"), raw("DF"), be("k", 4), raw("00010000"), be("c", 4), raw("FF"))
    signal = raw("FFFFFFFFFF")
    descriptor = F.concat(F.encode(F.lit("CUEI"), "UTF-8"), be("c", 4), raw("7F"), raw("BF"), raw("0903"), F.encode(F.lit("ABC"), "UTF-8"), raw("30"), be(k % 200, 1), raw("03"), raw("0709"))
    private = F.concat(F.encode(F.lit("TEST"), "UTF-8"), be("k", 4))
    body = F.when(turn == 0, insert).when(turn == 1, schedule).when(turn == 2, signal).otherwise(private)
    kind = F.when(turn == 0, raw("05")).when(turn == 1, raw("04")).when(turn == 2, raw("06")).otherwise(raw("FF"))
    loop = F.when(turn == 2, F.concat(raw("02"), be(F.length(descriptor), 1), descriptor)).otherwise(raw(""))
    rest = F.concat(raw("00000000000000"), be(F.lit(0xFFF000) + F.length(body), 3), kind, body, be(F.length(loop), 2), loop)
    section = F.concat(raw("FC"), be(F.length(rest) + 4 + 0x3000, 2), rest, raw("00000000"))
    message = F.when(turn == 4, "0xFC3").when(turn == 5, "0XFB30").otherwise(F.concat(F.lit("0x"), F.hex(section)))
    s = o.select("k", "c", scte35.scte35_decode(message).alias("s"))
    d = F.get("s.descriptors", F.lit(0))
    seg = F.concat_ws("", d["type_id"].cast("string"), F.lit(":"), d["segment_num"].cast("string"), F.lit("/"), d["segments_expected"].cast("string"), F.lit(":"), d["sub_segment_num"].cast("string"), F.lit("/"), d["sub_segments_expected"].cast("string"), F.lit(":"), d["upid"], F.lit(":"), d["segmentation_event_id"].cast("string"))
    return s.select(
        F.col("k").alias("o_orderkey"), "s.command", F.when(F.col("s.command") == "splice_insert", F.col("s.splice_event_id")).alias("splice_event_id"), "s.pts_time", "s.break_duration",
        F.array_join(F.transform("s.splices", lambda x: F.concat(x["splice_event_id"].cast("string"), F.lit("@"), F.coalesce(x["utc_splice_time"].cast("string"), F.lit("cancelled")))), ",").alias("scheduled"),
        F.when(d.isNotNull(), seg).alias("segmentation"), F.concat("s.private_identifier", F.lit(":"), "s.private_bytes").alias("private"), F.regexp_extract("s.error", "^[A-Za-z0-9]+", 0).alias("error"),
    )


def varint(value: int) -> str:
    """A number as a protocol buffer writes it, in hex."""
    return "".join(f"{(value >> s & 127) | (128 if value >> s + 7 else 0):02X}" for s in range(0, max(1, value.bit_length()), 7))


NAMESPACE = drm.PLAYREADY_NAMESPACE


@query(f"""
WITH p AS (SELECT p_partkey AS k, p_size AS s, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x, p_name AS n FROM part)
SELECT k AS p_partkey, CASE k % 4
  WHEN 0 THEN 'type=RightsManagement;xmlns={NAMESPACE};version=4.0.0.0;KID 1=;kid=K' || k || ';checksum=C' || s || ';la_url=http://la/?a=1&b=' || k || ';lui_url=http://lui/;ds_id=D;custom_attributes=<CUSTOMATTRIBUTES><A x="1">y</A></CUSTOMATTRIBUTES>;decryptor_setup=ONDEMAND'
  WHEN 1 THEN 'type=RightsManagement;xmlns={NAMESPACE};version=4.3.0.0;KID 1=;algid=AESCBC;kid=K' || k || ';KID 2=;algid=AESCTR;keylen=16;checksum=S;kid=P' || s || ';custom_attributes='
  WHEN 2 THEN 'Record 1=;type=RightsManagement;xmlns={NAMESPACE};version=4.0.0.0;custom_attributes=;Record 2=;type=RightsManagement;xmlns=urn:x;version=1;custom_attributes='
  ELSE 'Missing WRMDATA' END AS rows FROM p
""")
def playready_headers(spark, sf_dir: str) -> DataFrame:
    """PlayReady objects in protection headers: records of two header versions, two records, and one without data."""
    p = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")), "k")
    k, s, turn = F.col("k"), F.col("s"), F.col("k") % 4
    head = f'<WRMHEADER xmlns="{NAMESPACE}" version="4.0.0.0"><DATA>'
    old = text(head, "<PROTECTINFO><KEYLEN>16</KEYLEN><ALGID>AESCTR</ALGID></PROTECTINFO><KID>K", k, "</KID><CHECKSUM>C", s, "</CHECKSUM><LA_URL>http://la/?a=1&amp;b=", k, "</LA_URL><LUI_URL>http://lui/</LUI_URL><DS_ID>D</DS_ID><CUSTOMATTRIBUTES><A x=\"1\">y</A></CUSTOMATTRIBUTES><DECRYPTORSETUP>ONDEMAND</DECRYPTORSETUP></DATA></WRMHEADER>")
    new = text('<WRMHEADER version="4.3.0.0"><DATA><KID ALGID="AESCBC" VALUE="K', k, '"></KID><KID VALUE="ignored"/><PROTECTINFO><ALGID>AESCTR</ALGID><KEYLEN>16</KEYLEN><KIDS><KID CHECKSUM="S" VALUE="P', s, '"></KID></KIDS></PROTECTINFO></DATA></WRMHEADER>')
    none = F.lit('<WRMHEADER version="1"></WRMHEADER>')
    le = lambda value, size: F.concat(*(be(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(size)))
    record = lambda xml: F.concat(raw("0100"), le(F.length(F.encode(xml, "UTF-16LE")).cast("bigint"), 2), F.encode(xml, "UTF-16LE"))
    two = F.concat(record(F.lit(f"{head}</DATA></WRMHEADER>")), record(F.lit('<WRMHEADER xmlns="urn:x" version="1"><DATA></DATA></WRMHEADER>')))
    records = F.when(turn == 0, record(old)).when(turn == 1, record(new)).when(turn == 2, two).otherwise(record(none))
    data = F.concat(le((F.length(records) + 6).cast("bigint"), 4), F.when(turn == 2, raw("0200")).otherwise(raw("0100")), records)
    body = F.concat(raw("00000000"), raw(drm.PLAYREADY.hex()), be(F.length(data), 4), data)
    rows = boxes.box_properties(p.select("k", box("pssh", body).alias("content")), id_col="k").filter("key = 'pssh_data' OR error IS NOT NULL")
    shown = F.array_join(F.transform("rows", lambda r: F.array_join(r, "=")), ";")
    return rows.select(long("media_id").alias("p_partkey"), F.coalesce(shown, "error").alias("rows"))


@query("""
SELECT p_partkey, 'key_id 0=' || lower(lpad(hex(p_partkey), 8, '0')) || ';key_id 1=0a;content_id=c;crypto_period_index=' || p_size || ';protection_scheme=' || CASE p_partkey % 3 WHEN 0 THEN 'CENC' WHEN 1 THEN 'CBCS' ELSE 'Unknown: 5' END
  || ';crypto_period_seconds=9;type=ENTITLEMENT;key_sequence=3;group_id 1=g;entitled_key 1=;entitlement_key_id=e;key_id=k;key=y;iv=v;entitlement_key_size_bytes=32;video_feature=f;algorithm=AESCTR;provider=p;track_type=HD;policy=o;grouped_license=l' AS rows FROM part
""")
def widevine_headers(spark, sf_dir: str) -> DataFrame:
    """Widevine messages with every field."""
    p = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")), "k")
    scheme = F.when(F.col("k") % 3 == 0, raw("48" + varint(1667591779))).when(F.col("k") % 3 == 1, raw("48" + varint(1667392371))).otherwise(raw("4805"))
    entitled = raw("0A0165" "12016B" "1A0179" "220176" "2820")
    message = F.concat(
        raw("0801"), raw("1204"), be("k", 4), raw("12010A"), raw("1A0170"), raw("220163"), raw("2A024844"), raw("32016F"), raw("38"), be("s", 1), raw("42016C"), scheme,
        raw("5009"), raw("5801"), raw("6003"), raw("6A0167"), raw("720E"), entitled, raw("7A0166"),
    )
    body = F.concat(raw("00000000"), raw(drm.WIDEVINE.hex()), be(F.length(message), 4), message)
    rows = boxes.box_properties(p.select("k", box("pssh", body).alias("content")), id_col="k").filter("key = 'pssh_data' OR error IS NOT NULL")
    shown = F.array_join(F.transform("rows", lambda r: F.array_join(r, "=")), ";")
    return rows.select(long("media_id").alias("p_partkey"), F.coalesce(shown, "error").alias("rows"))
