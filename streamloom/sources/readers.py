"""Sources and sinks: playlists as text, media as bytes, catalogues, and writers of the derived tables."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from streamloom.functions import codec, urls
from streamloom.operators import classify

# Public sample streams, by section.
EXAMPLES = [
    ("spatial", "Apple Immersive Video stream", "https://devstreaming-cdn.apple.com/videos/streaming/examples/immersive-media/apple-immersive-video/primary.m3u8"),
    ("spatial", "Spatial video stream", "https://devstreaming-cdn.apple.com/videos/streaming/examples/immersive-media/spatialLighthouseFlowersWaves/mvp.m3u8"),
    ("spatial", "Apple Projected Media Profile stream (180)", "https://devstreaming-cdn.apple.com/videos/streaming/examples/immersive-media/180Lighthouse/mvp.m3u8"),
    ("spatial", "3D movie stream", "https://devstreaming-cdn.apple.com/videos/streaming/examples/historic_planet_content_2023-10-26-3d-video/main.m3u8"),
    ("spatial", "Apple Projected Media Profile stream (360)", "https://devstreaming-cdn.apple.com/videos/streaming/examples/immersive-media/360Lighthouse/mvp.m3u8"),
    ("spatial", "Apple Projected Media Profile stream", "https://devstreaming-cdn.apple.com/videos/streaming/examples/immersive-media/wfovCausewayWalk/mvp.m3u8"),
    ("advanced", "BipBop, AVC + HEVC, AAC-LC + AC-3 + E-AC-3, WebVTT + CEA-608, 30fps + 60fps", "https://devstreaming-cdn.apple.com/videos/streaming/examples/bipbop_adv_example_hevc/master.m3u8"),
    ("advanced", "Becoming You trailer (many renditions)", "https://devstreaming-cdn.apple.com/videos/streaming/examples/adv_dv_atmos/main.m3u8"),
    ("advanced", "BipBop (segments addressed with EXT-X-BYTERANGE)", "https://devstreaming-cdn.apple.com/videos/streaming/examples/img_bipbop_adv_example_fmp4/master.m3u8"),
    ("packager", "Trickplay with byterange addressing", "https://demo.unified-streaming.com/k8s/features/stable/no-handler-origin/tears-of-steel/tears-of-steel-trickplay.m3u8"),
    ("packager", "AV1", "https://demo.unified-streaming.com/k8s/features/stable/video/tears-of-steel/tears-of-steel-av1.ism/.m3u8"),
    ("packager", "Live with SCTE35 messages in EXT-X-DATERANGE tags (TS segments)", "https://demo.unified-streaming.com/k8s/vod2live/stable/unified-learning.isml/.m3u8"),
    ("drm and low latency", "FairPlay + PlayReady encrypted stream with byterange addressing on segments (offsets for segments after the first are omitted which is another interesting use case to test byterange handling)", "https://media.axprod.net/TestVectors/Cmaf/protected_1080p_h264_cbcs/manifest.m3u8"),
    ("drm and low latency", "Low Latency - AirenSoft", "https://llhls-demo.ovenmediaengine.com/app/stream/llhls.m3u8"),
    ("drm and low latency", "Low Latency - Nimble Streamer", "https://ll-hls.softvelum.com/sldp/bbloop/playlist.m3u8"),
]


def read_playlists(spark: SparkSession, path: str, base_url: str | None = None) -> DataFrame:
    """Playlist files as (playlist_url, body). The url is the file's, or its name under ``base_url``."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select((F.concat(F.lit(base_url.rstrip("/") + "/"), name) if base_url else F.col("path")).alias("playlist_url"), "body")


def read_media(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Media files as (media_id, length, content); path and length filters reach the file listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("media_id"), "length", "content")


def byte_range(media: DataFrame, start_col: str = "range_start", end_col: str = "range_end") -> DataFrame:
    """The asked part of each content: both ends count; without a range all of it. What lies beyond the content is empty."""
    size = F.length("content").cast("bigint")
    start, end = F.least(F.col(start_col), size), F.least(F.col(end_col) + 1, size)
    part = F.substr("content", (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    return media.withColumn("content", F.when(F.col(start_col).isNull() | F.col(end_col).isNull(), F.col("content")).otherwise(part))


def fetch(rows: DataFrame, url_col: str = "url", start_col: str | None = None, end_col: str | None = None, timeout: float = 30.0) -> DataFrame:
    """Adds status, status_text, content_type, final_url, content and fetch_error: one request a row, made where the row is.

    An empty url is an empty answer without a request. Both ends of a range count; without both, all is asked for. An answer that
    is no success, and a request without an answer, are errors in ``fetch_error`` (error, extra_info). Partition the rows as
    widely as the servers can bear.
    """
    names = {"status": "int", "status_text": "string", "content_type": "string", "final_url": "string", "content": "binary", "failure": "struct<kind:string,name:string,message:string>"}
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.struct([(k, pa.string()) for k in ("kind", "name", "message")])]
    span = [F.col(c).cast("bigint") if c else F.lit(None).cast("bigint") for c in (start_col, end_col)]
    asked = rows.withColumns({"_asked": F.col(url_col), "_start": span[0], "_end": span[1]})
    keep = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                url, start, end = (one.column(len(keep) + c)[0].as_py() for c in range(3))
                got = _request(url, start, end, timeout)
                yield pa.RecordBatch.from_arrays([*one.columns[: len(keep)], *(pa.array([v], t) for v, t in zip(got, kinds, strict=True))], [*keep, *names])

    schema = StructType(rows.schema.fields + [StructField(n, DataType.fromDDL(t)) for n, t in names.items()])
    out = asked.mapInArrow(run, schema)
    refused = classify.fetch_error("status", "status_text", "content_type", codec.lossy_utf8("content"))
    failed = classify.fetch_failure("failure.kind", "failure.name", "failure.message")
    return out.withColumn("fetch_error", F.coalesce(failed, refused)).drop("failure")


def _request(url: str | None, start: int | None, end: int | None, timeout: float) -> tuple:
    """(status, status text, content type, final url, content, failure)."""
    if not url:
        return 200, "", None, url, b"", None
    headers = {"Range": f"bytes={start}-{end}"} if start is not None and end is not None else {}
    try:
        if not url.startswith(("http://", "https://")):
            raise ValueError(f"no http address: {url}")
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.reason, answer.headers.get("Content-Type"), answer.url, answer.read(), None
    except urllib.error.HTTPError as e:
        with e:
            return e.code, e.reason, e.headers.get("Content-Type"), e.url, e.read(), None
    except (OSError, ValueError, http.client.HTTPException) as e:
        kind = "DOMException" if isinstance(e, TimeoutError) else "TypeError" if isinstance(e, OSError | ValueError) else "other"
        return None, None, None, None, None, {"kind": kind, "name": "TimeoutError" if kind == "DOMException" else "TypeError", "message": str(getattr(e, "reason", e))}


def is_playlist_address(value) -> Column:
    """Whether a reader's input is an address that the form takes: http or https, and parsed as a url."""
    value = codec._col(value)
    return F.coalesce(value.rlike("^https?://.*$") & urls.resolve(value, F.lit("")).isNotNull(), F.lit(False))


def submitted(value) -> Column:
    """The viewer's address after the form is sent; NULL if the form does not take the input."""
    return F.when(is_playlist_address(value), F.concat(F.lit("?playlist_url="), F.url_encode(codec._col(value))))


def examples(spark: SparkSession) -> DataFrame:
    """The catalogue with each stream's link; the address stands in it as it is."""
    rows = spark.createDataFrame(EXAMPLES, "section string, description string, playlist_url string")
    return rows.withColumn("href", F.concat(F.lit("?playlist_url="), F.col("playlist_url")))


def requests(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """What a viewer's address asks for: playlist_url and context decoded once (NULL without one), definitions as they stand."""
    rows = rows.withColumns({
        "playlist_url": codec.percent_decode(urls.query_value(url_col, "playlist_url")),
        "definitions_query": urls.query_value(url_col, "imported_definitions"),
        "_asked": codec.percent_decode(urls.query_value(url_col, "supplemental_view_context")),
    })
    rows = codec.decode_contexts(rows, "_asked")
    return rows.withColumn("context", F.when(F.col("_asked").isNotNull(), F.col("context"))).drop("_asked")


def with_fetch_errors(responses: DataFrame) -> DataFrame:
    """Adds ``fetch_error`` to (status, status_text, content_type, body) rows."""
    return responses.withColumn("fetch_error", classify.fetch_error("status", "status_text", "content_type", "body"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """A derived table as Parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
