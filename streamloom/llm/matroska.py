"""Media columns: Matroska files in a binary column, written from and parsed into packets.

``parse`` reads variable-length EBML elements: ids and sizes (unknown sizes too), clusters, simple blocks and block
groups, all four kinds of lacing (none, Xiph, fixed, EBML), and cues. Each frame becomes a packet with its track,
timestamp, byte range in the file and key-frame mark. A packet's timestamp is its block's, in ticks; its time is its own, in
nanoseconds: the block's timestamp times TimestampScale and, for frame k of a lace, k times the track's DefaultDuration
(the block's time where a track has none). ``mux`` writes 8-bit PCM into laced blocks with cues.

Nulls: a null text is an empty payload before padding; a null media value gives no packets. Broken files give the
packets read so far and an error text; a master element that passes the end of a file is read as far as it goes. Long
payloads are written cluster by cluster, each in memory once more. Equal input, equal bytes; repeated rows and ids of any
type are kept, each row on its own, so nothing can tie. An empty table gives none; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import column, map_arrow, plus, slices, table

#: Samples of a frame, frames of a block, blocks of a cluster.
FRAME, LACE, CLUSTER = 576, 8, 32
#: Samples a second; a timestamp tick is one millisecond.
RATE = 8000

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, FLAG_LACING, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
CLUSTER_ID, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER_ID, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER_ID, CUES}
LACINGS = ("none", "xiph", "fixed", "ebml")


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int
    time: int


# --- writing


def vint(value: int, length: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """The head of a laced block and its frames."""
    if kind == "none":
        return b"".join(frames)
    sizes, out = [len(f) for f in frames[:-1]], bytearray([len(frames) - 1])
    if kind == "xiph":
        for n in sizes:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == "ebml" and sizes:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            d = b - a
            length = next(n for n in range(1, 9) if abs(d) < (1 << 7 * n - 1) - 1)
            out += vint(d + (1 << 7 * length - 1) - 1, length)
    return bytes(out) + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, per_block: int = LACE, per_cluster: int = CLUSTER, lacing: str = "ebml") -> bytes:
    """A Matroska file of one PCM track; frame k starts at k * frame samples, blocks in milliseconds rounded down."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    at, clusters, cues, flags = len(info) + len(tracks), [], [], 0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing]
    per_block = 1 if lacing == "none" else per_block
    for c in range(0, len(frames), per_block * per_cluster):
        start = c * frame * 1000 // RATE
        body = [uint(TIMESTAMP, start)]
        for b in range(c, min(c + per_block * per_cluster, len(frames)), per_block):
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b * frame * 1000 // RATE - start, flags) + lace(frames[b : b + per_block], lacing)))
        clusters.append(element(CLUSTER_ID, b"".join(body)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return head + element(SEGMENT, b"".join([info, tracks, *clusters, element(CUES, b"".join(cues))]))


# --- parsing


class Broken(ValueError):
    pass


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and the place behind it; None: all ones, an unknown size."""
    if at >= len(data) or not data[at]:
        raise Broken(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise Broken(f"integer at {at} is cut off")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def _block(data: bytes, at: int, end: int, base: int, key: bool | None, cluster: int) -> tuple[list[Packet], str]:
    track, at = read_vint(data, at)
    if at + 3 > end:
        raise Broken(f"block at {at} is cut off")
    delta, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind, key = {0: "none", 2: "xiph", 4: "fixed", 6: "ebml"}[flags & 6], bool(flags & 0x80) if key is None else key
    sizes = [end - at]
    if kind != "none":
        n, at = data[at] + 1, at + 1
        if kind == "fixed":
            if (end - at) % n:
                raise Broken(f"fixed lacing at {at} leaves a rest")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if kind == "xiph":
                    size = 0
                    while at < end:
                        size, at = size + data[at], at + 1
                        if data[at - 1] != 255:
                            break
                else:
                    start = at
                    size, at = read_vint(data, at)
                    if size is None:
                        raise Broken(f"lace size at {start} is unknown")
                    if k:
                        size += sizes[-1] - (1 << 7 * (at - start) - 1) + 1
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Broken(f"laces at {at} pass the block's end")
    out = []
    for k, size in enumerate(sizes):
        out.append(Packet(track or 0, base + delta, at, size, key, kind, cluster, k))  # the time is put in when all tracks are read
        at += size
    return out, kind


class Parsed:
    """Packets, cues [(time, track, byte offset of the cluster)], tracks {number: {...}}, nanoseconds of a frame by track, and the first error."""

    def __init__(self, data: bytes):
        self.packets: list[Packet] = []
        self.cues: list[tuple[int, int, int]] = []
        self.tracks: dict[int, dict] = {}
        self.durations: dict[int, int] = {}
        self.scale, self.clusters, self.error = 1_000_000, 0, None
        self.cluster_at: list[int] = []
        try:
            self._read(data)
        except (Broken, IndexError) as e:
            self.error = self.error or str(e)
        self.packets = [Packet(*p[:-1], p.timestamp * self.scale + p.time * self.durations.get(p.track, 0)) for p in self.packets]

    def _read(self, data: bytes) -> None:
        at, stack, segment, base = 0, [], 0, 0
        entry: dict = {}
        duration = 0
        cue = [0, 0]
        group_at, group_end, group_key = 0, 0, True

        def close(eid: int) -> None:
            nonlocal entry
            if eid == TRACK_ENTRY:
                self.tracks[entry.get("number", 0)] = entry
                self.durations[entry.get("number", 0)] = duration
            if eid == BLOCK_GROUP and group_end:
                self.packets += _block(data, group_at, group_end, base, group_key, self.clusters - 1)[0]

        while at < len(data):
            while stack and stack[-1][1] is not None and at >= stack[-1][1]:
                close(stack.pop()[0])
            eid, body = read_vint(data, at, keep_marker=True)
            size, body = read_vint(data, body)
            while stack and stack[-1][1] is None and stack[-1][0] != SEGMENT and eid in TOP_LEVEL:
                close(stack.pop()[0])  # an element of unknown size ends where one of its parent's begins
            end = None if size is None else body + size
            if end is not None and end > len(data):
                if eid not in MASTERS:
                    raise Broken(f"element {eid:X} at {at} passes the end")
                self.error, end = self.error or f"element {eid:X} at {at} passes the end", len(data)
            if eid in MASTERS:
                stack.append((eid, end))
                if eid == SEGMENT:
                    segment = body
                elif eid == CLUSTER_ID:
                    self.clusters, base = self.clusters + 1, 0
                    self.cluster_at.append(at)
                elif eid == TRACK_ENTRY:
                    entry, duration = {}, 0
                elif eid == BLOCK_GROUP:
                    group_end, group_key = 0, True
                at = body
                continue
            if end is None:
                raise Broken(f"element {eid:X} at {at} has no size")
            number = int.from_bytes(data[body:end], "big") if size <= 8 else 0
            if eid == TIMESTAMP:
                base = number
            elif eid == SIMPLE_BLOCK:
                self.packets += _block(data, body, end, base, None, self.clusters - 1)[0]
            elif eid == BLOCK:
                group_at, group_end = body, end
            elif eid == REFERENCE_BLOCK:
                group_key = False
            elif eid == TIMESTAMP_SCALE:
                self.scale = number
            elif eid == TRACK_NUMBER:
                entry["number"] = number
            elif eid == TRACK_TYPE:
                entry["type"] = number
            elif eid == DEFAULT_DURATION:
                duration = number
            elif eid == CODEC_ID:
                entry["codec"] = data[body:end].decode("ascii", "replace")
            elif eid == BIT_DEPTH:
                entry["bits"] = number
            elif eid == CUE_TIME:
                cue[0] = number
            elif eid == CUE_TRACK:
                cue[1] = number
            elif eid == CUE_CLUSTER_POSITION:
                self.cues.append((cue[0], cue[1], segment + number))
            at = end
        while stack:
            close(stack.pop()[0])

    def payload(self, data: bytes, track: int = 1) -> bytes:
        return b"".join([data[p.offset : p.offset + p.size] for p in self.packets if p.track == track])


# --- operators


def padded(text: str | None, unit: int = FRAME) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (unit * max(1, -(-len(raw) // unit)) - len(raw))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: str = "ebml") -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes, padded with bytes 255 to whole frames, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made = [padded(t) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p, lacing=lacing) for _, p in made], pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


PACKET_DDL = "track int, timestamp long, offset long, size long, keyframe boolean, lacing string, cluster int, time long"


def packets(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """The packet table: (id, packet_no, track, timestamp, offset, size, keyframe, lacing, cluster, time, cued).

    ``cued``: the first packet that a cue leads to, by track, time and the place of its cluster. Times beyond 64 bits are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            out: list[tuple] = []
            for row, data in enumerate(column(b, "media").to_pylist()):
                parsed = Parsed(data or b"")
                open_cues = set(parsed.cues)
                for k, p in enumerate(parsed.packets):
                    time = p.time if -(1 << 63) <= p.time < 1 << 63 else None
                    cue = (p.timestamp, p.track, parsed.cluster_at[p.cluster] if p.cluster >= 0 else -1)
                    out.append((row, k, *p[:-1], time, cue in open_cues))
                    open_cues.discard(cue)
            if out:
                rows_of, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([column(b, "id").take(pa.array(rows_of)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    names = ["id", "packet_no", *(c.split()[0] for c in PACKET_DDL.split(", ")), "cued"]
    id_type = rows.schema["id"].dataType.simpleString()
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
    return map_arrow(rows, run, f"id {id_type}, packet_no long, {PACKET_DDL}, cued boolean")


def feature(parsed: Parsed, payload: bytes) -> str:
    """Counts of packets, clusters and cues, the last packet's time in ticks, and mean, spread and turns of the samples."""
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    squares = int((x.astype(np.int64) ** 2).sum())
    turns = int(np.count_nonzero(np.diff(x > 127)))
    last = parsed.packets[-1].time // max(1, parsed.scale) if parsed.packets else -1
    return f"packets={len(parsed.packets)};clusters={parsed.clusters};cues={len(parsed.cues)};last={last};sum={total};squares={squares};turns={turns}"


def read_back(df: DataFrame, id_col: str = "id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(id, kept columns, media, payload binary, feature, error): the track's samples as the packets give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            payloads, features, errors = [], [], []
            for data in column(b, "media").to_pylist():
                parsed = Parsed(data or b"")
                payloads.append(parsed.payload(data or b""))
                features.append(feature(parsed, payloads[-1]))
                errors.append(parsed.error)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("id", *keep, "media")), pa.array(payloads, pa.binary()), pa.array(features), pa.array(errors, pa.string())], ["id", *keep, "media", "payload", "feature", "error"])

    rows = df.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("media"))
    return map_arrow(rows, run, plus(rows.schema, payload="binary", feature="string", error="string"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(store(table(spark, sf_dir, "documents")))
    return back.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
