"""Protection system headers: the system dimension, key ids, PlayReady objects and Widevine messages."""

from __future__ import annotations

import struct
from typing import Any
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions import codec

# The public registry of content protection system ids and their names.
SYSTEMS = {
    "6dd8b3c345f44a68bf3a64168d01a4a6": "ABV DRM (MoDRM)",
    "f239e769efa348509c16a903c6932efb": "Adobe Primetime DRM version 4",
    "616c7469636173742d50726f74656374": "Alticast",
    "94ce86fb07ff4f43adb893d2fa968ca2": "Apple FairPlay",
    "279fe473512c48feade8d176fee6b40f": "Arris Titanium",
    "3d5e6d359b9a41e8b843dd3c6e72c42c": "ChinaDRM",
    "3ea8778f77424bf9b18be834b2acbd47": "Clear Key AES-128",
    "be58615b19c4468488b3c8c57e99e957": "Clear Key SAMPLE-AES",
    "e2719d58a985b3c9781ab030af78d30e": "Clear Key DASH-IF",
    "644fe7b5260f4fad949a0762ffb054b4": "CMLA (OMA DRM)",
    "37c332587b994c7eb15d19af74482154": "Commscope Titanium V3",
    "45d481cb8fe049c0ada9ab2d2455b2f2": "CoreCrypt",
    "dcf4e3e362f158187ba60a6fe33ff3dd": "DigiCAP SmartXess",
    "35bf197b530e42d78b651b4bf415070f": "DivX DRM Series 5",
    "80a6be7e14484c379e70d5aebe04c8d2": "Irdeto Content Protection",
    "5e629af538da4063897797ffbd9902d4": "Marlin Adaptive Streaming Simple Profile V1.0",
    "9a04f07998404286ab92e65be0885f95": "Microsoft PlayReady",
    "6a99532d869f59229a91113ab7b1e2f3": "MobiTV DRM",
    "adb41c242dbf4a6d958b4457c0d27b95": "Nagra MediaAccess PRM 3.0",
    "1f83e1e86ee94f0dba2f5ec4e3ed1a66": "SecureMedia",
    "992c46e6c4374899b6a050fa91ad0e39": "SecureMedia SteelKnot",
    "a68129d3575b4f1a9cba3223846cf7c3": "Synamedia/Cisco/NDS VideoGuard DRM",
    "aa11967fcc014a4a8e99c5d3dddfea2d": "Unitend DRM (UDRM)",
    "9a27dd82fde247258cbc4234aa06ec09": "Verimatrix VCAS",
    "b4413586c58cffb094a5d4896c1af6c3": "Viaccess-Orca DRM (VODRM)",
    "793b79569f944946a94223e7ef7e44b4": "VisionCrypt",
    "1077efecc0b24d02ace33c1e52e2fb4b": "W3C Common PSSH box",
    "edef8ba979d64acea3c827dcd51d21ed": "Widevine Content Protection",
}
PLAYREADY, WIDEVINE = bytes.fromhex("9a04f07998404286ab92e65be0885f95"), bytes.fromhex("edef8ba979d64acea3c827dcd51d21ed")
#: Limits that a header must keep.
MOST_KEYS = MOST_DATA = 4096
PLAYREADY_NAMESPACE = "http://schemas.microsoft.com/DRM/2007/03/PlayReadyHeader"
#: Protection schemes of Widevine headers.
SCHEMES = {0: "Unspecified", 1667591779: "CENC", 1667392305: "CBC1", 1667591795: "CENS", 1667392371: "CBCS"}


class BadHeader(ValueError):
    pass


def system_name(system_id: bytes) -> str:
    return SYSTEMS.get(system_id.hex()) or system_id.decode("utf-8", "replace")


def systems(spark: SparkSession) -> DataFrame:
    """The dimension: (system_hex, system_name), as many rows as ``SYSTEMS`` has."""
    return spark.createDataFrame(list(SYSTEMS.items()), "system_hex string, system_name string")


def with_system_name(df: DataFrame, system_col: str = "system_id") -> DataFrame:
    """Adds ``system_ref``: the registered name, or the id's bytes as text."""
    names = F.broadcast(systems(df.sparkSession))  # a constant of 28 rows
    joined = df.withColumn("_hex", codec.hex_encode(system_col)).join(names, F.col("_hex") == F.col("system_hex"), "left")
    return joined.withColumn("system_ref", F.coalesce("system_name", codec.lossy_utf8(system_col))).drop("_hex", "system_hex", "system_name")


def parse_pssh(body: bytes, most_keys: int = MOST_KEYS, most_data: int = MOST_DATA) -> dict[str, Any]:
    """system_id, key_ids and data of a box body (version and flags first)."""
    if len(body) < 24:
        raise BadHeader("header is cut off")
    version, system, at, keys = body[0], body[4:20], 20, []
    if version:
        (count,) = struct.unpack_from(">I", body, at)
        if count > most_keys:
            raise BadHeader(f"{count} key ids; at most {most_keys} are read")
        at += 4
        keys = [body[at + 16 * k : at + 16 * k + 16] for k in range(count)]
        at += 16 * count
    if at + 4 > len(body):
        raise BadHeader("header is cut off")
    (size,) = struct.unpack_from(">I", body, at)
    if size > most_data:
        raise BadHeader(f"{size} bytes of data; at most {most_data} are read")
    if at + 4 + size > len(body):
        raise BadHeader("data is cut off")
    return {"system_id": system, "key_ids": keys, "data": body[at + 4 : at + 4 + size]}


def playready_xml(data: bytes) -> list[str]:
    """The rights management records of a PlayReady object, as XML text."""
    if len(data) < 6 or struct.unpack_from("<I", data)[0] != len(data):
        raise BadHeader("unexpected length of a PlayReady object")
    out, at = [], 6
    for _ in range(struct.unpack_from("<H", data, 4)[0]):
        if at + 4 > len(data):
            raise BadHeader("record is cut off")
        kind, size = struct.unpack_from("<HH", data, at)
        if kind != 1:
            raise BadHeader("unknown record type")
        raw = data[at + 4 : at + 4 + size]
        if len(raw) % 2:
            raise BadHeader("odd number of bytes of UTF-16")
        try:
            out.append(raw.decode("utf-16-le"))
        except UnicodeDecodeError as e:
            raise BadHeader("bad UTF-16") from e
        at += 4 + size
    return out


def playready_header(xml: str) -> dict[str, Any]:
    """Version, key ids and texts of one record. Key elements that close themselves do not count, as players see them."""
    out: dict[str, Any] = {"xmlns": None, "version": None, "kids": [], "protected": None, "custom_attributes": ""}
    path: list[str] = []
    texts = {"LA_URL": "la_url", "LUI_URL": "lui_url", "DS_ID": "ds_id", "CHECKSUM": "checksum", "DECRYPTORSETUP": "decryptor_setup"}
    seen_data, now = False, None
    parser = expat.ParserCreate()
    raw = xml.encode("utf-8")

    def closes_itself() -> bool:
        end = raw.find(b">", parser.CurrentByteIndex)
        return raw[end - 1 : end] == b"/"

    def start(name: str, attrs: dict) -> None:
        nonlocal seen_data, now
        path.append(name)
        if name == "WRMHEADER":
            out["xmlns"], out["version"] = attrs.get("xmlns"), attrs.get("version")
        elif name == "DATA":
            seen_data = True
        elif name == "PROTECTINFO":
            out["protected"] = {"algid": None, "keylen": None, "kids": []}
        elif name == "KID" and not closes_itself():
            now = {"value": attrs.get("VALUE"), "algid": attrs.get("ALGID"), "checksum": attrs.get("CHECKSUM")}
            (out["protected"]["kids"] if out["protected"] is not None and "PROTECTINFO" in path else out["kids"]).append(now)
        if "CUSTOMATTRIBUTES" in path:
            out["custom_attributes"] += f"<{name}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">"

    def chars(text: str) -> None:
        text, top = text.strip(), path[-1] if path else ""
        if not text:
            return
        if "CUSTOMATTRIBUTES" in path:
            out["custom_attributes"] += text
        elif top == "KID" and now is not None:
            now["value"] = (now["value"] or "") + text
        elif top in ("ALGID", "KEYLEN") and out["protected"] is not None:
            out["protected"][top.lower()] = (out["protected"][top.lower()] or "") + text
        elif top in texts:
            out[texts[top]] = out.get(texts[top], "") + text

    def end(name: str) -> None:
        if "CUSTOMATTRIBUTES" in path:
            out["custom_attributes"] += f"</{name}>"
        path.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.buffer_text = True
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise BadHeader(f"bad XML: {e}") from e
    if not seen_data:
        raise BadHeader("Missing WRMDATA")
    if out["version"] is None:
        raise BadHeader("Missing version")
    out["xmlns"] = out["xmlns"] or PLAYREADY_NAMESPACE
    return out


def playready_rows(data: bytes) -> list[list[Any]]:
    records, rows = [playready_header(x) for x in playready_xml(data)], []
    add = lambda key, value: rows.append([key, value]) if value is not None else None
    for n, h in enumerate(records):
        if len(records) > 1:
            rows.append([f"Record {n + 1}", ""])
        rows += [["type", "RightsManagement"], ["xmlns", h["xmlns"]], ["version", h["version"]]]
        for k, kid in enumerate(h["kids"]):
            rows.append([f"KID {k + 1}", ""])
            for key, name in (("algid", "algid"), ("checksum", "checksum"), ("kid", "value")):
                add(key, kid[name])
        if h["protected"]:
            for k, kid in enumerate(h["protected"]["kids"], len(h["kids"])):
                rows.append([f"KID {k + 1}", ""])
                add("algid", h["protected"]["algid"] or kid["algid"])
                keylen = h["protected"]["keylen"]
                add("keylen", int(keylen) if keylen and keylen.isdigit() else None)
                add("checksum", kid["checksum"])
                add("kid", kid["value"])
        for key in ("checksum", "la_url", "lui_url", "ds_id", "custom_attributes", "decryptor_setup"):
            add(key, h.get(key))
    return rows


def wire_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message, in order."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise BadHeader("message is cut off")
            b, at = data[at], at + 1
            value |= (b & 127) << shift
            shift += 7
            if not b & 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind in (1, 5, 2):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            if at + size > len(data):
                raise BadHeader("message is cut off")
            value = data[at : at + size]
            at += size
        else:
            raise BadHeader(f"wire type {kind}")
        out.append((key >> 3, value))
    return out


def widevine_rows(data: bytes) -> list[list[Any]]:
    """Rows of a Widevine header by the public field numbers of its message; absent fields give none."""
    fields = wire_fields(data)
    text = lambda b: b.decode("utf-8", "replace") if isinstance(b, bytes) else str(b)
    every = lambda n: [v for k, v in fields if k == n]
    rows: list[list[Any]] = [[f"key_id {k}", v.hex()] for k, v in enumerate(every(2))]

    def one(n: int, name: str, show=lambda v: v) -> None:
        if every(n):
            rows.append([name, show(every(n)[-1])])

    one(4, "content_id", text)
    one(7, "crypto_period_index")
    one(9, "protection_scheme", lambda v: SCHEMES.get(v, f"Unknown: {v}"))
    one(10, "crypto_period_seconds")
    one(11, "type", lambda v: {0: "SINGLE", 1: "ENTITLEMENT", 2: "ENTITLED_KEY"}.get(v, str(v)))
    one(12, "key_sequence")
    rows += [[f"group_id {k + 1}", text(v)] for k, v in enumerate(every(13))]
    for k, message in enumerate(every(14)):
        rows.append([f"entitled_key {k + 1}", ""])
        inner = dict(wire_fields(message))
        rows += [[name, text(inner[n])] for n, name in ((1, "entitlement_key_id"), (2, "key_id"), (3, "key"), (4, "iv")) if n in inner]
        if 5 in inner:
            rows.append(["entitlement_key_size_bytes", inner[5]])
    one(15, "video_feature", text)
    one(1, "algorithm", lambda v: {0: "UNENCRYPTED", 1: "AESCTR"}.get(v, str(v)))
    one(3, "provider", text)
    one(5, "track_type", text)
    one(6, "policy", text)
    one(8, "grouped_license", text)
    return rows


def payload_rows(header: dict[str, Any]) -> list[list[Any]] | None:
    """Rows of a payload of a known system; None for raw bytes."""
    if header["data"] and header["system_id"] == PLAYREADY:
        return playready_rows(header["data"])
    if header["data"] and header["system_id"] == WIDEVINE:
        return widevine_rows(header["data"])
    return None
