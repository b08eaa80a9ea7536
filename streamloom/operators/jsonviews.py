"""Interstitial asset lists and date-range schedules: JSON texts as columns. A document that does not fit is rejected whole."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions import codec, urls
from streamloom.functions.codec import _col
from streamloom.functions.lazy import lazy_udf

ASSET_LIST = "struct<ASSETS:array<struct<URI:string,DURATION:double>>,`SKIP-CONTROL`:struct<OFFSET:decimal(20,0),DURATION:decimal(20,0),`LABEL-ID`:string>>"


def _number(value) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 64


def _asset_list(text: str | None) -> str | None:
    """The document's known members as compact JSON; None if it is no asset list."""
    try:
        doc = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(doc, dict) or not isinstance(doc.get("ASSETS"), list):
        return None
    if not all(isinstance(a, dict) and isinstance(a.get("URI"), str) and _number(a.get("DURATION")) for a in doc["ASSETS"]):
        return None
    skip, out = doc.get("SKIP-CONTROL"), {"ASSETS": [{"URI": a["URI"], "DURATION": float(a["DURATION"])} for a in doc["ASSETS"]]}
    if skip is not None:
        if not (isinstance(skip, dict) and _whole(skip.get("OFFSET")) and _whole(skip.get("DURATION")) and isinstance(skip.get("LABEL-ID"), str)):
            return None
        out["SKIP-CONTROL"] = {k: skip[k] for k in ("OFFSET", "DURATION", "LABEL-ID")}
    return json.dumps(out)


@lazy_udf("string")
def sound_asset_list(text: pd.Series) -> pd.Series:
    return text.map(_asset_list)


def asset_list(text) -> Column:
    """The typed document, or NULL. Extra keys are passed over."""
    return F.from_json(sound_asset_list(_col(text)), ASSET_LIST)


def asset_rows(df: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per asset with ordinal, uri, duration; rejected documents give one row with an error."""
    doc = df.withColumn("_doc", asset_list(json_col))
    out = doc.select("*", F.posexplode_outer("_doc.ASSETS").alias("ordinal", "_asset"))
    skip = {f"skip_{k.lower().replace('-', '_')}": F.col(f"_doc.SKIP-CONTROL.{k}") for k in ("OFFSET", "DURATION", "LABEL-ID")}
    return out.withColumns(skip | {"uri": F.col("_asset.URI"), "duration": F.col("_asset.DURATION"), "error": F.when(F.col("_doc").isNull(), "not an asset list")}).drop("_doc", "_asset")


def asset_links(df: DataFrame, playlist_col: str = "playlist_url") -> DataFrame:
    """Adds ``href``: each asset as a playlist, resolved against the playlist; no variables."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    return df.withColumn("href", urls.playlist_link(urls.resolve(F.col(playlist_col), F.col("uri")), none))


def _schedule(text: str | None):
    try:
        doc = json.loads(text or "")
    except ValueError:
        return None
    ranges = doc.get("DATERANGES") if isinstance(doc, dict) else None
    if not isinstance(ranges, list) or not all(isinstance(d, dict) and isinstance(d.get("ID"), str) for d in ranges):
        return None
    show = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    return [{"id": d["ID"], "attributes": [{"name": k, "value": show(d[k])} for k in sorted(d)]} for d in ranges]


SCHEDULE = "array<struct<id:string,attributes:array<struct<name:string,value:string>>>>"


@lazy_udf(SCHEDULE)
def schedule(text: pd.Series) -> pd.Series:
    """The date ranges of a schedule with their attributes by key: texts raw, other values as compact JSON; else NULL."""
    return text.map(_schedule)


def schedule_rows(df: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per attribute: daterange_id, ordinal, name, value, what it links to, and (with a playlist_url) its href."""
    ranges = df.withColumn("_r", F.explode(schedule(F.col(json_col))))
    rows = ranges.select("*", F.col("_r.id").alias("daterange_id"), F.posexplode("_r.attributes").alias("ordinal", "_a")).drop("_r")
    kind = F.when(F.col("name") == "X-ASSET-URI", "PLAYLIST").when(F.col("name") == "X-ASSET-LIST", "ASSET_LIST")
    rows = rows.withColumns({"name": F.col("_a.name"), "value": F.col("_a.value")}).drop("_a").withColumn("link_type", kind)
    if "playlist_url" not in rows.columns:
        return rows
    # Addresses are resolved against the playlist; no variables.
    rows = rows.withColumns({"_url": urls.resolve(F.col("playlist_url"), F.when(F.col("link_type").isNotNull(), F.col("value"))), "_base": urls.resolve(F.col("playlist_url"), F.lit(""))})
    given = F.col("definitions_query") if "definitions_query" in rows.columns else F.lit(None).cast("string")
    listed = urls.context_link("_base", given, codec.encode_json("ASSET_LIST", "_url", "daterange_id"))
    href = F.when(F.col("_url").isNotNull(), F.when(F.col("link_type") == "PLAYLIST", F.concat(F.lit("?playlist_url="), codec.percent_encode("_url"))).otherwise(listed))
    return rows.withColumn("href", href).drop("_url", "_base")


@lazy_udf("string")
def pretty_json(text: pd.Series) -> pd.Series:
    """Indented JSON if the text is JSON, else the text."""

    def one(t):
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except (TypeError, ValueError):
            return t

    return text.map(one)
