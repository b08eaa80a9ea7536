"""ID3v2 frames of event messages, by the public ID3v2.3 and v2.4 layouts."""

from __future__ import annotations

SCHEME = "https://aomedia.org/emsg/ID3"
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _syncsafe(data: bytes) -> int:
    value = 0
    for b in data:
        value = value << 7 | b & 127
    return value


def _text(data: bytes) -> str:
    if not data:
        return ""
    return data[1:].decode(ENCODINGS.get(data[0], "latin-1"), "replace").strip("\0﻿")


def _content(frame_id: str, data: bytes) -> str:
    if frame_id == "PRIV":
        owner, _, rest = data.partition(b"\0")
        return f"{owner.decode('latin-1')}: {len(rest)} bytes"
    if frame_id in ("TXXX", "WXXX"):
        parts = _text(data).split("\0")
        return ": ".join(parts)
    if frame_id == "COMM":
        return _text(data[:1] + data[4:]).split("\0")[-1]
    if frame_id.startswith("T"):
        return _text(data).replace("\0", ", ")
    if frame_id.startswith("W"):
        return data.decode("latin-1").strip("\0")
    return f"{len(data)} bytes"


def frames(data: bytes) -> list[tuple[str, str]] | None:
    """(frame id, content) of a tag; None if the bytes are no tag."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (3, 4):
        return None
    end, at, out = 10 + _syncsafe(data[6:10]), 10, []
    if data[5] & 0x40:
        at += _syncsafe(data[at : at + 4]) if data[3] == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    end = min(end, len(data))
    while at + 10 <= end and data[at]:
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if at + 10 + size > end:
            return None
        out.append((name, _content(name, data[at + 10 : at + 10 + size])))
        at += 10 + size
    return out
