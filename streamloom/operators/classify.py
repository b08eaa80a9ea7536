"""What a fetched resource is: by content type, then url, then first bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from streamloom.functions.codec import _col
from streamloom.functions.lazy import lazy_udf

MP4_TYPES = ("video/mp4", "video/iso.segment", "audio/mp4", "application/mp4")
TEXT_TYPES = ("text/vtt", "text/plain")
#: Body types whose text explains a failed request.
DETAIL_TYPES = ("text/plain", "application/json", "application/x-www-form-urlencoded")


def by_content_type(content_type) -> Column:
    """Exact, case-sensitive names; images by prefix. Parameters make a type unknown."""
    c = _col(content_type)
    return F.when(c.isin(*MP4_TYPES), "Mp4").when(c.isin(*TEXT_TYPES), "WebVtt").when(c.startswith("image/"), "Image")


def by_url(url) -> Column:
    """The extension of the last path part: mp4 or m4s, vtt; case-sensitive. Texts without a scheme are no urls."""
    path = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    ext = F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), -1)
    return F.when(ext.isin("mp4", "m4s"), "Mp4").when(ext == "vtt", "WebVtt")


def is_webvtt(content) -> Column:
    """``WEBVTT`` at the start, behind a byte-order mark or not."""
    head = F.substring(F.hex(F.substring(_col(content), 1, 9)), 1, 18)
    return head.startswith("574542565454") | head.startswith("EFBBBF574542565454")


def _boxes(data: bytes, skip_bodies: bool) -> bool:
    at = 0
    while at + 8 <= len(data):
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            if at + 16 > len(data):
                return False
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        if size < head:
            return False
        if kind == b"moof":
            return True
        if kind == b"ftyp":
            return size - head >= 8 and at + size <= len(data) and (size - head) % 4 == 0
        at += size if skip_bodies else head
    return False


@lazy_udf("boolean")
def is_mp4_probe(content: pd.Series) -> pd.Series:
    """A readable ``ftyp`` or a ``moof``; bodies of other boxes are read on as headers."""
    return content.map(lambda c: c is not None and _boxes(bytes(c), False))


@lazy_udf("boolean")
def is_mp4(content: pd.Series) -> pd.Series:
    """The same with bodies skipped."""
    return content.map(lambda c: c is not None and _boxes(bytes(c), True))


def segment_type(content_type, url, content) -> Column:
    """WebVtt, Mp4, Image or Unknown."""
    told = F.coalesce(by_content_type(content_type), by_url(url), F.when(is_webvtt(content), "WebVtt"))
    # A body goes to Python only where nothing else tells; a NULL is no body.
    probed = is_mp4_probe(F.when(told.isNull(), _col(content)))
    return F.coalesce(told, F.when(probed, "Mp4"), F.lit("Unknown"))


def fetch_error(status, status_text, content_type, body) -> Column:
    """(error, extra_info) of an answer that is no success; NULL for 200 to 299. Only readable bodies are passed on."""
    status, content_type = _col(status), _col(content_type)
    detail = F.lit(False)
    for kind in DETAIL_TYPES:
        detail |= F.coalesce(content_type.contains(kind), F.lit(False))
    bad = F.struct(F.concat(F.lit("Bad HTTP status code: "), status.cast("string"), F.lit(" "), _col(status_text)).alias("error"), F.when(detail, _col(body)).alias("extra_info"))
    return F.when(~status.between(200, 299), bad)


def fetch_failure(kind, name, message) -> Column:
    """(error, extra_info) of a request without an answer: type and DOM errors show as ``name: message``, others as they are."""
    known = _col(kind).isin("TypeError", "DOMException")
    shown = F.concat_ws(": ", _col(name), F.nullif(_col(message), F.lit("")))
    return F.when(_col(kind).isNotNull(), F.struct(F.when(known, shown).otherwise(F.concat(F.lit("Fetch failed: "), F.coalesce(_col(message), F.lit("")))).alias("error"), F.lit(None).cast("string").alias("extra_info")))


def data_uri(content_type, content) -> Column:
    return F.concat(F.lit("data:"), _col(content_type), F.lit(";base64,"), F.regexp_replace(F.base64(_col(content)), r"[\r\n]", ""))
