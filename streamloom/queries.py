"""Named queries over the test tables, each over whole tables and whole texts, and the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom import box_queries, view_queries  # noqa: F401 - they register their queries
from streamloom.functions import codec, urls
from streamloom.operators import boxes, classify, drm, lex, links, scte35
from streamloom.plans import synth, views
from streamloom.plans.synth import be, box, dealt, raw, table
from streamloom.registry import ORACLES, QUERIES, query
from streamloom.sources import readers

# --- playlists

_SEGMENTS_SQL = """
WITH RECURSIVE seg AS (
  SELECT l_orderkey AS p, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord,
         CAST(l_quantity AS BIGINT) AS len, l_partkey AS off, l_returnflag AS f FROM lineitem),
sim(p, ord, s, e, carry) AS (
  SELECT p, ord, CASE f WHEN 'A' THEN off WHEN 'N' THEN CAST(0 AS BIGINT) END, CASE f WHEN 'A' THEN off + len - 1 WHEN 'N' THEN len - 1 END,
         CASE f WHEN 'A' THEN off + len WHEN 'N' THEN len ELSE CAST(0 AS BIGINT) END FROM seg WHERE ord = 1
  UNION ALL
  SELECT g.p, g.ord, CASE f WHEN 'A' THEN off WHEN 'N' THEN carry END, CASE f WHEN 'A' THEN off + len - 1 WHEN 'N' THEN carry + len - 1 END,
         CASE f WHEN 'A' THEN off + len WHEN 'N' THEN carry + len ELSE CAST(0 AS BIGINT) END
  FROM sim JOIN seg AS g ON g.p = sim.p AND g.ord = sim.ord + 1)
"""


@query(_SEGMENTS_SQL + "SELECT p AS playlist_id, ord AS ordinal, p % 1000 + ord - 1 AS media_sequence, s AS range_start, e AS range_end FROM sim")
def playlist_segments(spark, sf_dir: str) -> DataFrame:
    """Which byte range and media sequence each segment has."""
    rows = views.segments(synth.segment_playlists(spark, sf_dir))
    return rows.select(F.col("playlist_url").cast("bigint").alias("playlist_id"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("media_sequence").cast("bigint").alias("media_sequence"), "range_start", "range_end")


@query(_SEGMENTS_SQL + "SELECT p AS playlist_id, count(*) AS n_uris, CAST(sum(coalesce(e - s + 1, 0)) AS BIGINT) AS ranged_bytes, true AS is_media FROM sim GROUP BY p")
def playlist_summary(spark, sf_dir: str) -> DataFrame:
    """Segments and covered bytes of each playlist."""
    rows = views.summary(synth.segment_playlists(spark, sf_dir))
    return rows.select(F.col("playlist_url").cast("bigint").alias("playlist_id"), "n_uris", F.col("ranged_bytes").cast("bigint").alias("ranged_bytes"), "is_media")


@query("""
WITH RECURSIVE ev AS (
  SELECT user_id AS p, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS ord, event_id, event_id % 100 + 1 AS len, event_type AS t FROM events),
sim(p, ord, event_id, t, idx, s, len, next_idx, carry) AS (
  SELECT p, ord, event_id, t, CAST(0 AS BIGINT), CASE WHEN t = 'signup' THEN event_id WHEN t IN ('click', 'view') THEN CAST(0 AS BIGINT) END, len,
         CAST(CASE WHEN t = 'purchase' THEN 0 ELSE 1 END AS BIGINT), CASE WHEN t = 'signup' THEN event_id + len WHEN t IN ('click', 'view') THEN len ELSE CAST(0 AS BIGINT) END
  FROM ev WHERE ord = 1
  UNION ALL
  SELECT e.p, e.ord, e.event_id, e.t, next_idx, CASE WHEN e.t = 'signup' THEN e.event_id WHEN e.t IN ('click', 'view') THEN carry END, e.len,
         CASE WHEN e.t = 'purchase' THEN CAST(0 AS BIGINT) ELSE next_idx + 1 END,
         CASE WHEN e.t = 'signup' THEN e.event_id + e.len WHEN e.t IN ('click', 'view') THEN carry + e.len ELSE CAST(0 AS BIGINT) END
  FROM sim JOIN ev AS e ON e.p = sim.p AND e.ord = sim.ord + 1)
SELECT p AS playlist_id, ord AS line_no, idx AS part_index, s AS range_start, s + len - 1 AS range_end FROM sim WHERE t <> 'purchase'
""")
def playlist_parts(spark, sf_dir: str) -> DataFrame:
    """Index and byte range of every part."""
    rows = views.playlist(synth.part_playlists(spark, sf_dir)).filter("tag_name = '-X-PART'")
    return rows.select(F.col("playlist_url").cast("bigint").alias("playlist_id"), F.col("line_no").cast("bigint").alias("line_no"), F.col("part_index").cast("bigint").alias("part_index"), "range_start", "range_end")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS raw FROM documents)
SELECT doc_id, count(*) FILTER (WHERE raw = '') AS n_blank, count(*) FILTER (WHERE raw LIKE '#EXT%') AS n_tag, count(*) FILTER (WHERE raw LIKE '#%' AND raw NOT LIKE '#EXT%') AS n_comment,
       count(*) FILTER (WHERE raw <> '' AND raw NOT LIKE '#%') AS n_uri FROM l GROUP BY doc_id
""")
def line_classes(spark, sf_dir: str) -> DataFrame:
    """Kinds of the lines of every document, read as the body of a playlist."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("playlist_url"), F.concat(F.lit("#EXTM3U\n"), F.coalesce("text", F.lit(""))).alias("body"))
    kind = lambda k: F.sum((F.col("kind") == k).cast("bigint"))
    rows = lex.lines(docs).groupBy("playlist_url").agg(kind("blank").alias("n_blank"), (kind("tag") - 1).alias("n_tag"), kind("comment").alias("n_comment"), kind("uri").alias("n_uri"))
    return rows.withColumnRenamed("playlist_url", "doc_id")


@query("SELECT doc_id, CASE WHEN NOT (text = '#EXTM3U' OR starts_with(text, '#EXTM3U' || chr(10))) THEN 'Error: playlist identifier (#EXTM3U) not present' END AS error FROM documents WHERE text <> ''")
def playlist_header_check(spark, sf_dir: str) -> DataFrame:
    """Which documents are no playlists."""
    rows = lex.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("playlist_url"), F.col("text").alias("body")))
    return rows.groupBy(F.col("playlist_url").alias("doc_id")).agg(F.max("error").alias("error"))


@query("SELECT user_id AS playlist_id, event_id, bool_or(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_media FROM events")
def playlist_kind(spark, sf_dir: str) -> DataFrame:
    """From which line on a playlist is known to be one of segments."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("#EXTINF:1,"), F.col("event_id"))).otherwise(F.concat(F.lit("u"), F.col("event_id")))
    rows = views.playlist(synth.bodies(e.select(F.col("user_id").cast("string").alias("playlist_url"), F.col("event_id").alias("ord"), F.array(line).alias("lines")))).filter("line_no > 0")
    return rows.select(F.col("playlist_url").cast("bigint").alias("playlist_id"), F.regexp_extract("raw", "([0-9]+)$", 1).cast("bigint").alias("event_id"), "is_media")


def _daterange_lines(spark, sf_dir: str) -> DataFrame:
    """One date-range tag per order, in the playlist of its customer; the order's key is an attribute of its own."""
    o = table(spark, sf_dir, "orders")
    cls = F.when(F.col("o_orderstatus") == "O", links.PRELOAD).when(F.col("o_orderstatus") == "F", links.SCHEDULE).otherwise("other")
    target = F.when(F.col("o_orderkey") % 3 == 0, links.INTERSTITIAL).when(F.col("o_orderkey") % 3 == 1, links.SCHEDULE)
    ext = F.when(F.col("o_orderkey") % 2 == 0, "m3u8").otherwise("JSON")
    given = lambda name, value: F.coalesce(F.concat(F.lit(f'{name}="'), value, F.lit('",')), F.lit(""))
    tag = F.concat(
        F.lit("#EXT-X-DATERANGE:"),
        given("ID", F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("o"), F.col("o_orderkey")))),
        given("CLASS", cls),
        given("X-TARGET-CLASS", target),
        F.concat(F.lit("X-KEY="), F.col("o_orderkey"), F.lit(",DURATION="), F.col("o_orderkey") % 60),
        F.concat(F.lit(',X-URI="ads/'), F.col("o_custkey"), F.lit("."), ext, F.lit('?a=1&b=2",SCTE35-OUT="0xFC30"')),
    )
    return dealt(o.select(F.concat(F.lit("https://example.com/hls/"), F.col("o_custkey"), F.lit("/live.m3u8")).alias("playlist_url"), F.col("o_orderkey").alias("ord"), F.array(tag).alias("lines")), "playlist_url", synth.TASK_LINES)


@query("""
WITH o AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'com.apple.hls.preload' WHEN 'F' THEN 'com.apple.hls.daterange-schedule' ELSE 'other' END AS cls FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'o' || o_orderkey END AS id, cls, CASE o_orderkey % 3 WHEN 0 THEN 'com.apple.hls.interstitial' WHEN 1 THEN 'com.apple.hls.daterange-schedule' END AS target_class,
       CAST(o_orderkey % 60 AS VARCHAR) AS duration, CAST(5 + CAST(o_orderkey % 5 <> 0 AS INTEGER) + CAST(o_orderkey % 3 <> 2 AS INTEGER) AS INTEGER) AS n_attrs FROM o
""")
def attr_parse(spark, sf_dir: str) -> DataFrame:
    """Attribute lists of date ranges back into columns."""
    rows = lex.with_attributes(lex.lines(synth.bodies(_daterange_lines(spark, sf_dir))), links.DATERANGE).filter(F.col("tag_name") == links.DATERANGE)
    plain = lambda name: F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]
    quoted = lambda name: lex.last_quoted(F.col("attrs"), name)
    return rows.select(plain("X-KEY").cast("bigint").alias("o_orderkey"), quoted("ID").alias("id"), quoted("CLASS").alias("cls"), quoted("X-TARGET-CLASS").alias("target_class"), plain("DURATION").alias("duration"), F.size("attrs").alias("n_attrs"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, o_orderkey % 5 <> 0 AS has_id, o_orderkey % 2 = 0 AS m3u8, o_orderkey % 3 AS t, o_orderstatus AS st FROM orders),
k AS (SELECT *, CASE WHEN NOT has_id THEN NULL WHEN st = 'O' THEN CASE WHEN t = 0 AND m3u8 THEN 'PLAYLIST' WHEN t = 0 THEN 'ASSET_LIST' WHEN t = 1 THEN 'DATERANGE_SCHEDULE' END WHEN st = 'F' THEN 'DATERANGE_SCHEDULE' END AS kind FROM o),
base AS (SELECT *, 'https://example.com/hls/' || o_custkey || '/ads/' || o_custkey || '.' || CASE WHEN m3u8 THEN 'm3u8' ELSE 'JSON' END || '?a%3D1%26b%3D2' AS u, '?playlist_url=https://example.com/hls/' || o_custkey || '/live.m3u8&supplemental_view_context=' AS c FROM k)
SELECT o_custkey, line_no, 'X-URI' AS attribute, kind AS link_type, CASE kind WHEN 'PLAYLIST' THEN '?playlist_url=' || u ELSE c || kind || ',o' || o_orderkey || '%22' || u END AS href FROM base WHERE kind IS NOT NULL
UNION ALL
SELECT o_custkey, line_no, 'SCTE35-OUT', 'SCTE35', c || 'SCTE35,OUT,o' || o_orderkey || '%220xFC30' FROM base WHERE has_id
""")
def daterange_links(spark, sf_dir: str) -> DataFrame:
    """What the attributes of date ranges lead to."""
    rows = links.link_rows(synth.bodies(_daterange_lines(spark, sf_dir)))
    return rows.select(F.regexp_extract("playlist_url", "/([0-9]+)/live", 1).cast("bigint").alias("o_custkey"), F.col("line_no").cast("bigint").alias("line_no"), "attribute", "link_type", "href")


# --- text codecs


@query("""
WITH b AS (SELECT 'p' || page_id AS key, coalesce(url, '') AS t FROM pages UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents),
e AS (SELECT key, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CASE WHEN h < '21' OR h >= '7F' OR h IN ('22', '23', '3C', '3E', '26', '3D', '25') THEN '%' || h ELSE chr(CAST('0x' || h AS INTEGER)) END) AS parts FROM b)
SELECT key, sha256(array_to_string(parts, '')) AS encoded_sha256, CAST(length(array_to_string(parts, '')) AS BIGINT) AS encoded_chars FROM e
""")
def percent_encode(spark, sf_dir: str) -> DataFrame:
    """Escapes of every page url and document."""
    texts = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("url").alias("t")).unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("t")))
    encoded = texts.select("key", codec.percent_encode(F.coalesce("t", F.lit(""))).alias("e"))
    return encoded.select("key", F.sha2("e", 256).alias("encoded_sha256"), F.length("e").cast("bigint").alias("encoded_chars"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def percent_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(codec.percent_decode(codec.percent_encode(F.coalesce("text", F.lit("")))), 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(2 * octet_length(encode(coalesce(text, ''))) AS BIGINT) AS digits FROM documents")
def hex_roundtrip(spark, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", codec.hex_encode(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))
    return docs.select("doc_id", F.sha2(codec.hex_decode("h"), 256).alias("text_sha256"), F.length("h").cast("bigint").alias("digits"))


@query("""
WITH h AS (SELECT item_id, regexp_extract_all(hex(encode(text)), '.{1,32}') AS l FROM benchmark)
SELECT item_id, array_to_string(list_transform(l, lambda x: array_to_string(list_transform(regexp_extract_all(x, '.{1,8}'), lambda g: array_to_string(regexp_extract_all(g, '..'), ' ')), '  ')), chr(10)) AS dump FROM h
""")
def hex_dump(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", codec.hex_dump(F.encode("text", "UTF-8")).alias("dump"))


@query("SELECT o_orderkey, lpad(bin((o_orderkey // 65536) % 256), 8, '0') || ' ' || lpad(bin((o_orderkey // 256) % 256), 8, '0') || ' ' || lpad(bin(o_orderkey % 256), 8, '0') AS mask FROM orders")
def binary_mask(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.binary_mask(be("o_orderkey", 3)).alias("mask"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'SEGMENT' WHEN 'N' THEN 'MAP' ELSE 'PART' END AS context_type, 'https://example.com/' || l_partkey || '.mp4?a=1&b=' || l_suppkey || ',2' AS url,
       l_orderkey AS media_sequence, CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) END AS part_index, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS range_start, CASE WHEN l_linestatus = 'O' THEN l_partkey + CAST(l_quantity AS BIGINT) END AS range_end FROM lineitem
""")
def context_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Segment, map and part contexts encoded, percent-decoded once and decoded."""
    li = table(spark, sf_dir, "lineitem")
    url = F.concat(F.lit("https://example.com/"), "l_partkey", F.lit(".mp4?a=1&b="), "l_suppkey", F.lit(",2"))
    span = (F.when(F.col("l_linestatus") == "O", F.col("l_partkey")), F.when(F.col("l_linestatus") == "O", F.col("l_partkey") + F.col("l_quantity").cast("bigint")))
    kinds = {k: codec.segment_context(k, url, F.col("l_orderkey"), *span, F.col("l_linenumber")) for k in ("SEGMENT", "MAP", "PART")}
    plain = F.when(F.col("l_returnflag") == "A", kinds["SEGMENT"]).when(F.col("l_returnflag") == "N", kinds["MAP"]).otherwise(kinds["PART"])
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", plain.alias("p")).withColumn("e", codec.percent_encode("p")).withColumn("d", codec.percent_decode("e"))
    rows = codec.decode_contexts(rows, "d", "c")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.context_type", "c.url", F.col("c.media_sequence").cast("bigint").alias("media_sequence"), "c.part_index", F.col("c.range_start").cast("bigint").alias("range_start"), F.col("c.range_end").cast("bigint").alias("range_end"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment || '=<&>' AS segment FROM customer")
def definitions_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Variable definitions encoded twice and decoded."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    c = table(spark, sf_dir, "customer").withColumn("d", F.array(pair("name", F.col("c_name")), pair("# <seg>&", F.concat("c_mktsegment", F.lit("=<&>")))))
    back = c.withColumn("m", codec.decode_definitions(codec.encode_definitions("d")))
    return back.select("c_custkey", F.try_element_at("m", F.lit("name")).alias("name"), F.try_element_at("m", F.lit("# <seg>&")).alias("segment"))


@query("SELECT page_id, url FROM pages")
def variables(spark, sf_dir: str) -> DataFrame:
    """Urls with host and path as variables, put together again."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    text = F.when(host != "", F.replace("url", host, F.lit("{$HOST}"))).otherwise(F.col("url"))
    return p.select("page_id", urls.replace_variables(text, F.array(pair("HOST", host), pair("UNUSED", F.lit("x")))).alias("url"))


@query("SELECT page_id, 'https://example.com/hls/' || page_id || '/media/seg.m4s?n=' || page_id AS resolved FROM pages")
def url_join(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.resolve(F.concat(F.lit("HTTPS://Example.com:443/hls/"), "page_id", F.lit("/main/mvp.m3u8?x=1")), F.concat(F.lit("../media/./seg.m4s?n="), "page_id")).alias("resolved"))


# --- classification and answers


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'Mp4' WHEN 'view' THEN 'WebVtt' WHEN 'error' THEN 'Image' WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'Mp4' WHEN 1 THEN 'WebVtt' ELSE 'Unknown' END ELSE CASE WHEN event_id % 2 = 0 THEN 'WebVtt' ELSE 'Mp4' END END AS segment_type FROM events
""")
def classify_segments(spark, sf_dir: str) -> DataFrame:
    """By content type, then url, then first bytes."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    ctype = F.when(kind == "click", "video/mp4").when(kind == "view", "text/vtt").when(kind == "error", "image/png").when(kind == "signup", "text/vtt; charset=utf-8")
    ext = F.when(F.col("event_id") % 3 == 0, ".m4s").when(F.col("event_id") % 3 == 1, ".vtt").otherwise(".MP4")
    url = F.concat(F.lit("https://example.com/a.b/f"), F.when(kind == "signup", ext).otherwise(""), F.lit("?x=y.mp4"))
    data = F.when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, F.encode(F.lit("\ufeffWEBVTT"), "UTF-8")).otherwise(F.concat(box("moof", box("mfhd", be(0, 8)))))).otherwise(raw(""))
    return e.select("event_id", classify.segment_type(ctype, url, data).alias("segment_type"))


@query("""
WITH s AS (SELECT event_id, CAST(200 + (event_id % 4) * 100 + event_id % 7 AS INTEGER) AS status, CASE event_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json; charset=utf-8' END AS ct, props FROM events)
SELECT event_id, CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'Bad HTTP status code: ' || status || ' Text' END AS error, CASE WHEN status NOT BETWEEN 200 AND 299 AND ct LIKE '%application/json%' THEN props END AS extra_info FROM s
""")
def http_status(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"status": (200 + (F.col("event_id") % 4) * 100 + F.col("event_id") % 7).cast("int"), "status_text": F.lit("Text"), "content_type": F.when(F.col("event_id") % 3 == 0, "text/html").when(F.col("event_id") % 3 == 1, "application/json; charset=utf-8"), "body": F.col("props")})
    return readers.with_fetch_errors(e).select("event_id", "fetch_error.error", "fetch_error.extra_info")


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ordinal, 'ad-' || o_orderkey || '.m3u8' AS uri, CAST(o_orderkey % 90 AS DOUBLE) + 0.5 AS duration,
       '?playlist_url=https://example.com/live/ad-' || o_orderkey || '.m3u8' AS href FROM orders
""")
def asset_list(spark, sf_dir: str) -> DataFrame:
    """One asset list per customer, parsed and linked."""
    o = table(spark, sf_dir, "orders")
    asset = F.struct(F.concat(F.lit("ad-"), "o_orderkey", F.lit(".m3u8")).alias("URI"), ((F.col("o_orderkey") % 90).cast("double") + 0.5).alias("DURATION"), F.lit(True).alias("EXTRA"))
    docs = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", asset.alias("a")))).alias("x")).select("o_custkey", F.to_json(F.struct(F.transform("x", lambda x: x["a"]).alias("ASSETS"))).alias("json"), F.lit("https://example.com/live/main.m3u8").alias("playlist_url"))
    rows = views.asset_list_view(docs)
    return rows.select("o_custkey", F.regexp_extract("uri", "([0-9]+)", 1).cast("bigint").alias("o_orderkey"), "ordinal", "uri", "duration", "href")


@query("""
SELECT event_id, 'e' || event_id AS daterange_id, 'ID' AS name, 'e' || event_id AS value, CAST(0 AS INTEGER) AS ordinal FROM events
UNION ALL SELECT event_id, 'e' || event_id, 'N', CAST(event_id % 100 AS VARCHAR), 1 FROM events
UNION ALL SELECT event_id, 'e' || event_id, 'NONE', 'null', 2 FROM events
UNION ALL SELECT event_id, 'e' || event_id, 'X-ASSET-URI', event_type, 3 FROM events
""")
def daterange_schedule(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"DATERANGES":[{"X-ASSET-URI":"'), "event_type", F.lit('","N":'), (F.col("event_id") % 100).cast("string"), F.lit(',"NONE":null,"ID":"e'), "event_id", F.lit('"}]}'))
    return views.schedule_view(e.select("event_id", text.alias("json"))).select("event_id", "daterange_id", "name", "value", "ordinal")


# --- media


@query("""
WITH n AS (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1),
s AS (SELECT k, 12 * c AS run, 12 * c + 8 AS mdat, 20 + 12 * c + 8 AS d FROM n)
SELECT k AS media_id, i AS box_index, f AS fourcc, dep AS depth, b AS body_size FROM (
  SELECT k, 0 AS i, 'styp' AS f, 0 AS dep, 16 AS b FROM s UNION ALL SELECT k, 1, 'moof', 0, 16 + 8 + 16 + 20 + 20 + run + 8 - 8 FROM s UNION ALL SELECT k, 2, 'mfhd', 1, 8 FROM s
  UNION ALL SELECT k, 3, 'traf', 1, 16 + 20 + 20 + run FROM s UNION ALL SELECT k, 4, 'tfhd', 2, 8 FROM s UNION ALL SELECT k, 5, 'tfdt', 2, 12 FROM s UNION ALL SELECT k, 6, 'trun', 2, 12 + run FROM s UNION ALL SELECT k, 7, 'mdat', 0, run FROM s)
""")
def box_walk(spark, sf_dir: str) -> DataFrame:
    """The box tree of every fragment."""
    rows = boxes.box_rows(synth.fragments(spark, sf_dir))
    return rows.select(F.col("media_id").cast("bigint").alias("media_id"), "box_index", "fourcc", "depth", "body_size")


@query("""
SELECT l_orderkey AS media_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS sample, CAST(l_quantity AS BIGINT) AS duration, l_partkey AS size, l_suppkey AS cts FROM lineitem
""")
def trun_samples(spark, sf_dir: str) -> DataFrame:
    """Samples of every track run."""
    rows = boxes.track_runs(boxes.box_rows(synth.fragments(spark, sf_dir), fourccs=("trun",)))
    return rows.select(F.col("media_id").cast("bigint").alias("media_id"), "sample", "duration", "size", "cts")


@query("SELECT DISTINCT l_orderkey AS media_id, l_orderkey AS sequence_number FROM lineitem")
def box_mfhd(spark, sf_dir: str) -> DataFrame:
    rows = boxes.view(boxes.box_rows(synth.fragments(spark, sf_dir), fourccs=("mfhd",)), "mfhd")
    return rows.select(F.col("media_id").cast("bigint").alias("media_id"), "sequence_number")


@query("SELECT DISTINCT l_orderkey AS media_id, l_orderkey * 1000 AS base_media_decode_time FROM lineitem")
def box_tfdt(spark, sf_dir: str) -> DataFrame:
    rows = boxes.view(boxes.box_rows(synth.fragments(spark, sf_dir), fourccs=("tfdt",)), "tfdt")
    return rows.select(F.col("media_id").cast("bigint").alias("media_id"), F.col("base_media_decode_time").cast("bigint").alias("base_media_decode_time"))


@query("""
SELECT p_partkey, key, value FROM (
  SELECT p_partkey, 'btrt.avg_bitrate' AS key, CAST(p_partkey * 3 AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'pasp.h_spacing', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'clap.horiz_off_n', CAST(-p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'hdlr.name', p_name FROM part UNION ALL SELECT p_partkey, 'stri.has_left_eye_view', CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END FROM part
  UNION ALL SELECT p_partkey, 'schm.scheme_version', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'trex.default_sample_flags', CAST(p_partkey AS VARCHAR) FROM part)
""")
def box_properties(spark, sf_dir: str) -> DataFrame:
    """Properties of boxes of several layouts, built from the columns of ``part``."""
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    size, zero = F.col("p_size"), raw("00000000")
    content = F.concat(
        box("btrt", be(0, 4), be(1, 4), be(F.col("p_partkey") * 3, 4)),
        box("pasp", be(size, 4), be(1, 4)),
        box("clap", *[be(1, 4)] * 4, be((1 << 32) - size.cast("bigint"), 4), be(1, 4), be(0, 4), be(1, 4)),
        box("hdlr", zero, zero, F.encode(F.lit("vide"), "UTF-8"), raw("00" * 12), F.encode("p_name", "UTF-8"), raw("00")),
        box("stri", zero, be(size % 16, 1)),
        box("schm", zero, F.encode(F.lit("cenc"), "UTF-8"), be(size, 4)),
        box("trex", zero, *[be(1, 4)] * 4, be("p_partkey", 4)),
    )
    rows = boxes.box_properties(p.select(F.col("p_partkey").cast("string").alias("media_id"), content.alias("content")))
    key = F.concat("fourcc", F.lit("."), "key")
    wanted = ("btrt.avg_bitrate", "pasp.h_spacing", "clap.horiz_off_n", "hdlr.name", "stri.has_left_eye_view", "schm.scheme_version", "trex.default_sample_flags")
    return rows.select(F.col("media_id").cast("bigint").alias("p_partkey"), key.alias("key"), "value").filter(F.col("key").isin(*wanted))


_SYSTEMS = sorted(drm.SYSTEMS.items())


@query(f"WITH s(i, h, n) AS (VALUES {', '.join(f'({k}, {chr(39)}{h}{chr(39)}, {chr(39)}{n}{chr(39)})' for k, (h, n) in enumerate(_SYSTEMS))}) SELECT p_partkey, coalesce(n, '0123456789abcdef') AS system_ref FROM part LEFT JOIN s ON p_partkey % 30 = i")
def drm_lookup(spark, sf_dir: str) -> DataFrame:
    """Names of protection systems; two of thirty ids are not registered."""
    ids = F.array(*(F.lit(h) for h, _ in _SYSTEMS), *[F.lit(b"0123456789abcdef".hex())] * 2)
    p = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.get(ids, (F.col("p_partkey") % 30).cast("int"))).alias("system_id"))
    return drm.with_system_name(p).select("p_partkey", "system_ref")


@query("""
WITH b AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part), c AS (SELECT *, (v // 32) % 32 AS code FROM b)
SELECT p_partkey, CAST(v // 4194304 AS VARCHAR) AS fscod, CAST((v // 2048) % 8 AS VARCHAR) AS acmod,
       CAST(CASE WHEN code < 19 THEN [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640][code + 1] ELSE 0 END AS VARCHAR) AS bit_rate FROM c
""")
def dac3_bits(spark, sf_dir: str) -> DataFrame:
    p = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").cast("string").alias("media_id"), box("dac3", be(F.col("p_partkey") * 7919 % 16777216, 3)).alias("content"))
    rows = boxes.box_properties(p).groupBy("media_id").pivot("key", ["fscod", "acmod", "bit_rate"]).agg(F.first("value"))
    return rows.select(F.col("media_id").cast("bigint").alias("p_partkey"), "fscod", "acmod", "bit_rate")


@query()
def scte35_messages(spark, sf_dir: str) -> DataFrame:
    """A splice message per order, built from its columns and decoded: a time signal at its key."""
    o = table(spark, sf_dir, "orders")
    body = F.concat(raw("00"), raw("0000000000"), raw("00"), raw("00C005"), raw("06"), raw("FE"), be("o_orderkey", 4), raw("0000"))
    section = F.concat(raw("FC"), be(F.length(body) + 4 + 0x3000, 2), body, raw("00000000"))
    decoded = o.select("o_orderkey", scte35.scte35_decode(F.concat(F.lit("0x"), F.hex(section))).alias("s"))
    return decoded.select("o_orderkey", "s.command", "s.pts_time", "s.tier", "s.error")


ORACLES["scte35_messages"] = "SELECT o_orderkey, 'time_signal' AS command, o_orderkey AS pts_time, CAST(12 AS INTEGER) AS tier, CAST(NULL AS VARCHAR) AS error FROM orders"


@query("SELECT 'spatial' AS section, 6 AS n UNION ALL SELECT 'advanced', 3 UNION ALL SELECT 'packager', 3 UNION ALL SELECT 'drm and low latency', 3")
def example_catalogue(spark, sf_dir: str) -> DataFrame:
    return readers.examples(spark).groupBy("section").agg(F.count("*").cast("int").alias("n"))


@query("""
SELECT p_partkey, CAST(p_size % 128 AS VARCHAR) AS dv_profile, CAST(p_partkey % 64 AS VARCHAR) AS dv_level, CASE WHEN p_partkey % 2 = 1 THEN 'true' ELSE 'false' END AS el_present_flag, CAST(p_size % 16 AS VARCHAR) AS dv_bl_signal_compatibility_id FROM part
""")
def dolby_vision_bits(spark, sf_dir: str) -> DataFrame:
    """Dolby Vision records packed from the columns of ``part``."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    packed = size % 128 * 512 + key % 64 * 8 + 4 + key % 2 * 2 + 1
    body = F.concat(raw("0100"), be(packed, 2), be(size % 16 * 16, 1), raw("00" * 19))
    rows = boxes.box_properties(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(key.cast("string").alias("media_id"), box("dvvC", body).alias("content")))
    wanted = ["dv_profile", "dv_level", "el_present_flag", "dv_bl_signal_compatibility_id"]
    return rows.groupBy("media_id").pivot("key", wanted).agg(F.first("value")).select(F.col("media_id").cast("bigint").alias("p_partkey"), *wanted)


@query("""
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS ordinal, l_suppkey AS count, CAST(l_quantity AS BIGINT) AS delta, l_partkey AS sample_size FROM lineitem
""")
def sample_tables(spark, sf_dir: str) -> DataFrame:
    """Times and sizes of the samples of each order, out of ``stts`` and ``stsz`` boxes."""
    items = synth.ordered_lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", "qty", "l_partkey", "l_suppkey"))).alias("items"))
    joined = lambda f: F.aggregate(F.transform("items", f), raw(""), lambda a, x: F.concat(a, x))
    stts = box("stts", raw("00000000"), be(F.size("items"), 4), joined(lambda i: F.concat(be(i["l_suppkey"], 4), be(i["qty"], 4))))
    stsz = box("stsz", raw("0000000000000000"), be(F.size("items"), 4), joined(lambda i: be(i["l_partkey"], 4)))
    rows = boxes.box_properties(items.select(F.col("l_orderkey").cast("string").alias("media_id"), F.concat(stts, stsz).alias("content")))
    per = rows.groupBy("media_id").agg(F.first(F.when(F.col("key") == "entries", F.col("rows")), ignorenulls=True).alias("times"), F.first(F.when(F.col("key") == "sample_sizes", F.split("value", ", ")), ignorenulls=True).alias("sizes"))
    each = per.select("media_id", "sizes", F.posexplode("times").alias("k", "time"))
    number = lambda c: c.cast("bigint")
    return each.select(number(F.col("media_id")).alias("l_orderkey"), (F.col("k") + 1).alias("ordinal"), number(F.col("time")[0]).alias("count"), number(F.col("time")[1]).alias("delta"), number(F.get("sizes", F.col("k"))).alias("sample_size"))


@query("""
SELECT o_orderkey, lower(lpad(hex(o_orderkey), 16, '0')) AS iv, CAST(o_custkey % 60000 AS VARCHAR) || '/' || CAST(o_orderkey % 1000 AS VARCHAR) AS clear_and_protected FROM orders
""")
def sample_encryption(spark, sf_dir: str) -> DataFrame:
    """The only sample of a ``senc`` box per order: its IV and its one subsample."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    body = F.concat(raw("0000000200000001"), be("o_orderkey", 8), be(1, 2), be(F.col("o_custkey") % 60000, 2), be(F.col("o_orderkey") % 1000, 4))
    rows = boxes.box_properties(o.select(F.col("o_orderkey").cast("string").alias("media_id"), box("senc", body).alias("content"))).filter("rows IS NOT NULL")
    return rows.select(F.col("media_id").cast("bigint").alias("o_orderkey"), F.substring(F.col("rows")[0][1], 3, 16).alias("iv"), F.col("rows")[1][1].alias("clear_and_protected"))


@query("SELECT p_partkey, lower(lpad(hex(p_partkey), 32, '0')) AS key_id, 'Widevine Content Protection' AS system_ref, lower(hex(encode(p_name))) AS content_key FROM part")
def protection_headers(spark, sf_dir: str) -> DataFrame:
    """A Widevine header per part: its key id, and the name carried as a key id of the message."""
    p, size = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"), F.octet_length("p_name")
    # A length is written seven bits a byte, the lowest first; names of up to 2^14 bytes need two.
    length = F.when(size < 128, be(size, 1)).otherwise(F.concat(be(size % 128 + 128, 1), be(F.shiftright(size, 7), 1)))
    message = F.concat(raw("12"), length, F.encode("p_name", "UTF-8"))
    body = F.concat(raw("01000000"), raw(drm.WIDEVINE.hex()), be(1, 4), be("p_partkey", 16), be(F.length(message), 4), message)
    rows = boxes.box_properties(p.select(F.col("p_partkey").cast("string").alias("media_id"), box("pssh", body).alias("content")))
    value = lambda key, c: F.first(F.when(F.col("key") == key, c), ignorenulls=True)
    out = rows.groupBy("media_id").agg(value("key_ids", F.col("rows")[0][0]).alias("key_id"), value("system_ref", F.col("value")).alias("system_ref"), value("pssh_data", F.col("rows")[0][1]).alias("content_key"))
    return out.select(F.col("media_id").cast("bigint").alias("p_partkey"), "key_id", "system_ref", "content_key")
