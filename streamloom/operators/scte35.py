"""SCTE-35 splice messages: hex text to a structured column, by the public ANSI/SCTE 35 layout."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions.lazy import lazy_udf
from streamloom.operators.box_fields import Malformed, Reader

#: Splice command and segmentation type names.
COMMANDS = {0: "splice_null", 4: "splice_schedule", 5: "splice_insert", 6: "time_signal", 7: "bandwidth_reservation", 255: "private_command"}
SEGMENT_ENDS = {0x34, 0x30, 0x32, 0x36, 0x38, 0x3A, 0x44, 0x46}  # types that may carry sub-segment numbers

_SPLICE = (
    "splice_event_id:bigint,splice_event_cancelled:boolean,event_id_compliance:boolean,out_of_network:boolean,program_splice:boolean,utc_splice_time:bigint,"
    "components:array<struct<component_tag:int,utc_splice_time:bigint>>,auto_return:boolean,break_duration:bigint,unique_program_id:int,avail_num:int,avails_expected:int"
)
_DESCRIPTOR = {
    "tag": "int", "identifier": "string", "segmentation_event_id": "bigint", "cancelled": "boolean", "duration": "bigint", "upid_type": "int", "upid": "string", "type_id": "int", "segment_num": "int", "segments_expected": "int",
    "sub_segment_num": "int", "sub_segments_expected": "int", "event_id_compliance": "boolean", "program_segmentation": "boolean", "components": "array<struct<component_tag:int,pts_offset:bigint>>",
    "delivery_not_restricted": "boolean", "web_delivery_allowed": "boolean", "no_regional_blackout": "boolean", "archive_allowed": "boolean", "device_restrictions": "int",
    "provider_avail_id": "bigint", "preroll": "int", "dtmf": "string", "tai_seconds": "bigint", "tai_ns": "bigint", "utc_offset": "int",
    "audio": "array<struct<component_tag:int,iso_code:string,bit_stream_mode:int,num_channels:int,full_service:boolean>>", "private_bytes": "string",
}
_SECTION = {
    "table_id": "int", "protocol_version": "int", "section_length": "int", "encrypted": "boolean", "pts_adjustment": "bigint", "cw_index": "int", "tier": "int",
    "command_type": "int", "command": "string", "pts_time": "bigint", "splice_event_id": "bigint", "out_of_network": "boolean", "break_duration": "bigint", "crc_ok": "boolean",
    "section_syntax": "boolean", "private_indicator": "boolean", "sap_type": "int", "encryption_algorithm": "int", "command_length": "int", "crc": "bigint",
    "splice_event_cancelled": "boolean", "event_id_compliance": "boolean", "program_splice": "boolean", "splice_immediate": "boolean", "components": "array<struct<component_tag:int,pts_time:bigint>>",
    "auto_return": "boolean", "unique_program_id": "int", "avail_num": "int", "avails_expected": "int", "splices": f"array<struct<{_SPLICE}>>",
    "private_identifier": "string", "private_bytes": "string", "stuffing": "string",
    "descriptors": f"array<struct<{','.join(f'{k}:{t}' for k, t in _DESCRIPTOR.items())}>>", "error": "string",
}
SCHEMA = ", ".join(f"{k} {t}" for k, t in _SECTION.items())


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        crc = n << 24
        for _ in range(8):
            crc = crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        table.append(crc & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def message_bytes(text: str) -> bytes:
    digits = text[2:] if text[:2] in ("0x", "0X") else text
    if len(digits) % 2:
        raise Malformed("Hex: odd number of digits")
    if re.search("[^0-9A-Fa-f]", digits):
        raise Malformed("Hex: invalid digit")
    return bytes.fromhex(digits)


def _time(r: Reader) -> int | None:
    if r.bits(1):
        r.bits(6)
        return r.bits(33)
    r.bits(7)
    return None


def _event(r: Reader, out: dict, scheduled: bool) -> None:
    """One event of a splice_insert or, with times in UTC seconds and never at once, of a splice_schedule."""
    out["splice_event_id"] = r.u(4)
    out["splice_event_cancelled"] = bool(r.bits(1))
    compliance = r.bits(7) >> 6
    if scheduled:
        out["event_id_compliance"] = bool(compliance)
    if out["splice_event_cancelled"]:
        return
    out["out_of_network"] = bool(r.bits(1))
    program, duration = r.bits(1), r.bits(1)
    out["program_splice"] = bool(program)
    if scheduled:
        r.bits(5)
        key, time = "utc_splice_time", lambda: r.u(4)
    else:
        immediate = out["splice_immediate"] = bool(r.bits(1))
        out["event_id_compliance"] = bool(r.bits(1))
        r.bits(3)
        key, time = "pts_time", lambda: None if immediate else _time(r)
    if program:
        out[key] = time()
    else:
        out["components"] = [{"component_tag": r.u(1), key: time()} for _ in range(r.u(1))]
    if duration:
        out["auto_return"] = bool(r.bits(1))
        r.bits(6)
        out["break_duration"] = r.bits(33)
    out["unique_program_id"], out["avail_num"], out["avails_expected"] = r.u(2), r.u(1), r.u(1)


def _schedule(r: Reader, out: dict) -> None:
    out["splices"] = []
    for _ in range(r.u(1)):
        out["splices"].append({})
        _event(r, out["splices"][-1], scheduled=True)


def _segmentation(r: Reader, out: dict) -> None:
    out["segmentation_event_id"] = r.u(4)
    out["cancelled"], out["event_id_compliance"] = bool(r.bits(1)), bool(r.bits(1))
    r.bits(6)
    if out["cancelled"]:
        return
    program, timed, free = r.bits(1), r.bits(1), r.bits(1)
    out["program_segmentation"], out["delivery_not_restricted"] = bool(program), bool(free)
    if free:
        r.bits(5)
    else:
        for key in ("web_delivery_allowed", "no_regional_blackout", "archive_allowed"):
            out[key] = bool(r.bits(1))
        out["device_restrictions"] = r.bits(2)
    if not program:
        out["components"] = [{"component_tag": r.u(1), "pts_offset": r.u(5) & ((1 << 33) - 1)} for _ in range(r.u(1))]
    if timed:
        out["duration"] = r.u(5)
    out["upid_type"] = r.u(1)
    upid = r.take(r.u(1))
    out["upid"] = upid.decode("ascii") if upid and all(32 <= b < 127 for b in upid) else upid.hex()
    out["type_id"], out["segment_num"], out["segments_expected"] = r.u(1), r.u(1), r.u(1)
    if out["type_id"] in SEGMENT_ENDS and r.left >= 2:  # older messages end before them
        out["sub_segment_num"], out["sub_segments_expected"] = r.u(1), r.u(1)


def _avail(r: Reader, out: dict) -> None:
    out["provider_avail_id"] = r.u(4)


def _dtmf(r: Reader, out: dict) -> None:
    out["preroll"] = r.u(1)
    count = r.bits(3)
    r.bits(5)
    out["dtmf"] = r.take(count).decode("ascii", "replace")


def _tai(r: Reader, out: dict) -> None:
    out["tai_seconds"], out["tai_ns"], out["utc_offset"] = r.u(6), r.u(4), r.u(2)


def _audio(r: Reader, out: dict) -> None:
    count = r.bits(4)
    r.bits(4)
    out["audio"] = [{"component_tag": r.u(1), "iso_code": r.take(3).decode("ascii", "replace"), "bit_stream_mode": r.bits(3), "num_channels": r.bits(4), "full_service": bool(r.bits(1))} for _ in range(count)]


_DESCRIPTORS = {0: _avail, 1: _dtmf, 2: _segmentation, 3: _tai, 4: _audio}


def decode(data: bytes) -> dict[str, Any]:
    """The fields of a splice_info_section."""
    r = Reader(data)
    out: dict[str, Any] = {"table_id": r.u(1)}
    if out["table_id"] != 0xFC:
        raise Malformed(f"Scte35: table id {out['table_id']}")
    out["section_syntax"], out["private_indicator"], out["sap_type"] = bool(r.bits(1)), bool(r.bits(1)), r.bits(2)
    out["section_length"] = r.bits(12)
    out["protocol_version"], out["encrypted"], out["encryption_algorithm"] = r.u(1), bool(r.bits(1)), r.bits(6)
    out["pts_adjustment"], out["cw_index"], out["tier"] = r.bits(33), r.u(1), r.bits(12)
    length = out["command_length"] = r.bits(12)
    out["command_type"] = r.u(1)
    out["command"] = COMMANDS.get(out["command_type"], "reserved")
    end = 3 + out["section_length"]
    out["crc_ok"] = crc32_mpeg(data[:end]) == 0
    out["crc"] = int.from_bytes(data[end - 4 : end], "big") if 4 <= end <= len(data) else None
    out["descriptors"] = []
    if out["encrypted"]:
        out["private_bytes"] = data[r.bit // 8 : max(end - 4, r.bit // 8)].hex()  # commands and descriptors that only the key opens
        return out
    start = r.bit
    known = length != 0xFFF
    if out["command_type"] == 6:
        out["pts_time"] = _time(r)
    elif out["command_type"] == 5:
        _event(r, out, scheduled=False)
    elif out["command_type"] == 4:
        _schedule(r, out)
    elif known:
        body = r.take(length)
        if out["command_type"] == 255:
            out["private_identifier"], body = body[:4].decode("ascii", "replace"), body[4:]
        if body:
            out["private_bytes"] = body.hex()
    if known:
        r.bit = start + 8 * length
    left = r.u(2)
    loop = Reader(r.take(left))
    while loop.left >= 2:
        tag, body = loop.u(1), Reader(loop.take(loop.u(1)))
        item: dict[str, Any] = {"tag": tag, "identifier": body.take(4).decode("ascii", "replace")}
        if item["identifier"] == "CUEI" and tag in _DESCRIPTORS:
            _DESCRIPTORS[tag](body, item)
        if body.left:
            item["private_bytes"] = body.rest().hex()
        out["descriptors"].append(item)
    if end - 4 > r.bit // 8:
        out["stuffing"] = data[r.bit // 8 : end - 4].hex()
    return out


def decode_text(text: str | None) -> dict[str, Any] | None:
    if text is None:
        return None
    try:
        return decode(message_bytes(text))
    except Malformed as e:
        message = str(e)
        return {"error": message if message.startswith(("Hex", "Scte35")) else f"Scte35: {message}"}


@lazy_udf(SCHEMA)
def scte35_decode(message: pd.Series) -> pd.DataFrame:
    rows = []
    for text in message:
        got = decode_text(text) or {}
        items = got.get("descriptors")
        rows.append({k: got.get(k) for k in _SECTION} | {"descriptors": None if items is None else [{k: d.get(k) for k in _DESCRIPTOR} for d in items]})
    out = pd.DataFrame(rows, columns=list(_SECTION), dtype=object)
    return out


@lazy_udf("string")
def scte35_json(message: pd.Series) -> pd.Series:
    """The decoded message as indented JSON, or NULL if it cannot be decoded."""
    show = lambda got: None if got is None or "error" in got else json.dumps(got, indent=2)
    return message.map(lambda m: show(decode_text(m)))


@lazy_udf("decoded string, error string")
def scte35_shown(message: pd.Series) -> pd.DataFrame:
    """The decoded message as indented JSON, or why it cannot be decoded."""
    got = [decode_text(m) or {} for m in message]
    return pd.DataFrame({"decoded": [json.dumps(g, indent=2) if g and "error" not in g else None for g in got], "error": [g.get("error") for g in got]}, dtype=object)


def table(contexts: DataFrame) -> DataFrame:
    """Adds id, type, decoded, error and detail to rows with daterange_id, command_type and message: what is shown of a message."""
    rows = contexts.drop("error").withColumn("_shown", scte35_shown(F.col("message")))
    why = F.col("_shown.error")
    return rows.withColumns({
        "id": F.col("daterange_id"),
        "type": F.concat(F.lit("SCTE35-"), "command_type"),
        "decoded": F.col("_shown.decoded"),
        "error": F.when(why.startswith("Hex"), "Error reading hex string").when(why.isNotNull(), "Error parsing SCTE35 data"),
        "detail": why,
    }).drop("_shown")


def messages(contexts: DataFrame) -> DataFrame:
    """Adds the decoded ``splice`` to rows with daterange_id, command_type and message."""
    return contexts.withColumn("splice", scte35_decode(F.col("message")))
