"""Media files as relations: the box tree, its properties, and typed views of boxes.

``walk`` flattens the tree in pre-order; bodies of ``mdat`` are never copied. A file that breaks gives its boxes up to
there and one row with ``error``; ``strict`` drops such files whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators import box_groups
from streamloom.operators.box_fields import FIXED, VARIABLE, Malformed, Mask, Reader, Table, described, render
from streamloom.operators.drm import BadHeader

# Fixed values, down to ``AUDIO``: FourCC -> name of boxes that only hold boxes, then of sample entries.
CONTAINERS = {
    "meta": "MetaBox", "iprp": "ItemPropertiesBox", "ipco": "ItemPropertyContainerBox", "ilst": "MetadataItemList", "moov": "MovieBox", "udta": "UserDataBox", "trak": "TrackBox", "mdia": "MediaBox",
    "minf": "MediaInformationBox", "stbl": "SampleTableBox", "stsd": "SampleDescriptionBox", "dinf": "DataInformationBox", "edts": "EditBox", "mvex": "MovieExtendsBox", "moof": "MovieFragmentBox", "traf": "TrackFragmentBox",
    "sinf": "ProtectionSchemeInfoBox", "schi": "SchemeInformationBox", "vexu": "VideoExtendedUsageBox", "eyes": "StereoViewBox", "cams": "StereoCameraSystemBox", "cmfy": "StereoComfortBox", "proj": "ProjectionBox",
    "pack": "ViewPackingBox", "lnsc": "CameraSystemLensCollectionBox", "lens": "CameraSystemLensBox", "lnex": "CameraSystemLensExtrinsicsBox", "cxfm": "CameraSystemTransformBox",
}
#: Containers whose body begins with a version and flags.
WITH_VERSION = ("meta", "stsd", "lens")
VISUAL = {
    "avc1": "AVCSampleEntryBox", "hev1": "HEVCSampleEntryBox", "hvc1": "HEVCSampleEntryBox", "dvhe": "DolbyVisionHEVCSampleEntryBox", "dvh1": "DolbyVisionHVC1SampleEntryBox", "vp08": "VP08SampleEntryBox",
    "vp09": "VP09SampleEntryBox", "av01": "AV1SampleEntryBox", "uncv": "UncompressedFrameSampleEntryBox", "encv": "EncryptedVisualSampleEntryBox",
}
AUDIO = {"mp4a": "MP4AudioSampleEntryBox", "Opus": "OpusSampleEntryBox", "ac-3": "AC3SampleEntryBox", "ec-3": "EC3SampleEntryBox", "ac-4": "AC4SampleEntryBox", "enca": "EncryptedAudioSampleEntryBox"}


class Box(NamedTuple):
    box_index: int
    fourcc: str
    depth: int
    header_offset: int
    body_offset: int
    body_size: int
    to_end: bool
    head_size: int  # bytes of the body before its children; -1 for a leaf
    error: str | None = None


def _head(fourcc: str) -> int:
    if fourcc in WITH_VERSION:
        return 8 if fourcc == "stsd" else 4
    return 0 if fourcc in CONTAINERS else 78 if fourcc in VISUAL else 28 if fourcc in AUDIO else -1


def walk(data: bytes) -> Iterator[Box]:
    at, ends, index = 0, [], 0
    if not data:
        yield Box(0, "", 0, 0, 0, 0, False, -1, "no box header")
    while at < len(data):
        while ends and at >= ends[-1]:
            ends.pop()
        if at + 8 > len(data):
            yield Box(index, "", len(ends), at, at, 0, False, -1, "box header is cut off")
            return
        size, fourcc, body = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1"), at + 8
        to_end = size == 0
        if size == 1:
            size, body = int.from_bytes(data[at + 8 : at + 16], "big"), at + 16
        end = len(data) if to_end else at + size
        if end < body or body > len(data):
            yield Box(index, fourcc, len(ends), at, body, 0, False, -1, "box is smaller than its header")
            return
        head = _head(fourcc)
        if fourcc == "meta" and data[body + 4 : body + 8] in (b"hdlr", b"ilst", b"keys"):
            head = 0  # a movie's own metadata may leave version and flags out
        if end > len(data) and fourcc != "mdat" and head < 0:
            yield Box(index, fourcc, len(ends), at, body, end - body, to_end, head, "box is cut off")
            return
        yield Box(index, fourcc, len(ends), at, body, end - body, to_end, head)
        index += 1
        if head >= 0:
            ends.append(end)
            at = min(body + head, end)
        else:
            at = end


def box_name(fourcc: str) -> str | None:
    if fourcc == "mdat":
        return "MediaDataBox"
    leaf = FIXED.get(fourcc) or VARIABLE.get(fourcc)
    return CONTAINERS.get(fourcc) or VISUAL.get(fourcc) or AUDIO.get(fourcc) or (leaf[0] if leaf else None)


def _own(data: bytes, box: Box) -> bytes:
    """What a box says itself: of a container only what stands before its children is copied."""
    return data[box.body_offset : box.body_offset + _own_size(box)]


def _own_size(box: Box) -> int:
    return 0 if box.fourcc == "mdat" else box.body_size if box.head_size < 0 else min(box.body_size, box.head_size)


def properties(data: bytes, box: Box) -> tuple[str, list]:
    """Name and fields of a box; a box that cannot be read raises."""
    return _read(box, Reader(_own(data, box)))


def _read(box: Box, r: Reader) -> tuple[str, list]:
    size = [("size", "Extends to end of file" if box.to_end else box.body_size + 8)]
    if box.fourcc == "mdat":
        return "MediaDataBox", size
    if box.head_size < 0:
        name, fields = described(box.fourcc, r)
        return name, size + fields
    fields = []
    if box.fourcc in WITH_VERSION and box.head_size:
        fields = [("version", r.u(1)), ("flags", Mask(r.take(3)))]
    elif box.fourcc in VISUAL:
        r.take(6)
        fields = [("data_reference_index", r.u(2))]
        r.take(16)
        fields += [("width", r.u(2)), ("height", r.u(2)), ("horizresolution", f"{r.u(4) / 65536:g}"), ("vertresolution", f"{r.u(4) / 65536:g}")]
        r.take(4)
        fields.append(("frame_count", r.u(2)))
        name = r.take(32)
        fields += [("compressor", name[1 : 1 + name[0]].decode("utf-8", "replace")), ("depth", r.u(2))]
    elif box.fourcc in AUDIO:
        r.take(6)
        fields = [("data_reference_index", r.u(2))]
        r.take(8)
        fields += [("channel_count", r.u(2)), ("sample_size", r.u(2))]
        r.take(4)
        fields.append(("sample_rate", f"{r.u(4) / 65536:g}"))
    return box_name(box.fourcc), size + fields


BOX_DDL = "box_index int, fourcc string, depth int, header_offset long, body_offset long, body_size long, to_end boolean"


def _media(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("media_id"), F.col(content_col).alias("content"))


def box_rows(df: DataFrame, id_col: str = "media_id", content_col: str = "content", fourccs: tuple[str, ...] | None = None) -> DataFrame:
    """The box table: one row per box with its place, depth and (for leaves) body. ``fourccs``: only these boxes leave Python."""
    names = ["media_id", *(c.split()[0] for c in BOX_DDL.split(", ")), "box_name", "body", "error"]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.string()]
    wanted = set(fourccs) if fourccs else None

    def boxes_of(media: str | None, data: bytes) -> Iterator[tuple]:
        for x in walk(data):
            if wanted is None or x.fourcc in wanted or x.error:
                leaf = x.head_size < 0 and x.fourcc != "mdat" and not x.error
                yield media, *x[:7], box_name(x.fourcc), data[x.body_offset : x.body_offset + x.body_size] if leaf else None, x.error

    return _media(df, id_col, content_col).mapInArrow(_gathered(boxes_of, names, types), f"media_id string, {BOX_DDL}, box_name string, body binary, error string")


#: Rows and bytes of an output batch, about.
OUT_ROWS, OUT_BYTES = 20_000, 16 << 20


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
    """(media, data) of each file; few of a batch stand in Python at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for media, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield media, data or b""


def _gathered(rows_of, names: list[str], types: list[pa.DataType]):
    """Runs ``rows_of(media, data)`` on every file; output batches hold the rows of many files, but not more than they should."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for media, data in _files(batches):
            out += rows_of(media, data)
            held += len(data)
            if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


#: Boxes of an output batch of properties, about, and bytes of a box that is read together with others of its kind.
OUT_BOXES, GROUPED_BYTES = 8_000, 512
#: What a box's own bytes say, of the columns of ``box_properties``.
_SAID = ("fourcc", "box_name", "ordinal", "key", "value", "headers", "rows", "error")


def _said(data: bytes, x: Box) -> list[tuple]:
    """The rows of a box without its place: the columns of ``_SAID``."""
    rows = []
    try:
        if x.error:
            raise Malformed(x.error)
        name, fields = properties(data, x)
        for n, (key, value) in enumerate(fields):
            if isinstance(value, Table):
                rows.append((x.fourcc, name, n, key, None, value.headers, [[render(v) for v in r] for r in value.rows], None))
            else:
                rows.append((x.fourcc, name, n, key, None if value is None else render(value), None, None, None))
    except (Malformed, BadHeader, IndexError, UnicodeDecodeError, ValueError) as e:
        rows.append((x.fourcc, box_name(x.fourcc), 0, None, None, None, None, str(e)))
    return rows


def box_properties(df: DataFrame, id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """Every property of every box in order: key with its text value, or with a table (headers, rows of texts).

    The boxes of many files are read in groups of one kind and size; rows that say the same are written once and repeated by Arrow.
    """
    ddl = "media_id string, box_index int, fourcc string, depth int, box_name string, ordinal int, key string, value string, headers array<string>, rows array<array<string>>, error string"
    texts = pa.list_(pa.string())
    types = dict(zip(_SAID, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), texts, pa.list_(texts), pa.string()), strict=True))
    names = [c.split()[0] for c in ddl.split(", ")]

    def batch_of(media: list, boxes: list[Box], owner: list[int], bodies: list[bytes | None], said_of) -> pa.RecordBatch:
        """``bodies``: what the boxes say themselves; None for those whose rows ``said_of`` gives from the file."""
        said, first, count = [], np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
        alone, groups, several = [], {}, []
        for k, (x, body) in enumerate(zip(boxes, bodies, strict=True)):
            if body is None:
                alone.append(k)
            else:
                groups.setdefault((x.fourcc, x.head_size, x.to_end, x.body_size, len(body)), []).append(k)
        for members in groups.values():
            x, size = boxes[members[0]], len(bodies[members[0]])
            members = np.array(members)
            table = np.frombuffer(b"".join(bodies[k] for k in members), np.uint8).reshape(len(members), size)
            for part, found in box_groups.read(table, lambda r, x=x: _read(x, r)):
                if found is None:
                    alone += members[part].tolist()
                    continue
                texts_, tables = box_groups.texts_of(found[1], len(part))
                several.append((members[part], texts_, tables))
                first[members[part]], count[members[part]] = len(said), len(found[1])
                for n, (key, value) in enumerate(found[1]):
                    is_table = isinstance(value, Table)
                    rows = [[render(v) for v in r] for r in value.rows] if is_table and n not in tables else None
                    text = None if is_table or value is None or n in texts_ else render(value)
                    said.append((x.fourcc, found[0], n, key, text, value.headers if is_table else None, rows, None))
        where: dict = {}
        for k in alone:
            x = boxes[k]
            known = k if bodies[k] is None else (x.fourcc, x.head_size, x.to_end, x.body_size, bodies[k])
            at = where.get(known)
            if at is None:
                own = said_of(k)
                at = where[known] = len(said), len(own)
                said += own
            first[k], count[k] = at
        end = np.cumsum(count)
        start = end - count
        box = pa.array(np.repeat(np.arange(len(count)), count))
        row = np.arange(end[-1]) + np.repeat(first - start, count)
        stored = {c: [pa.array(v, types[c])] for c, v in zip(_SAID, zip(*said, strict=True), strict=True)}
        at = {"value": row.copy(), "rows": row.copy()}
        for members, *own in several:
            for c, found in zip(at, own, strict=True):
                for n, values in found.items():
                    at[c][start[members] + n] = sum(map(len, stored[c])) + np.arange(len(members))
                    stored[c].append(values)
        columns = {"media_id": pa.array([media[k] for k in owner], pa.string()).take(box), "box_index": pa.array([x.box_index for x in boxes], pa.int32()).take(box), "depth": pa.array([x.depth for x in boxes], pa.int32()).take(box)}
        columns |= {c: pa.concat_arrays(v).take(pa.array(at.get(c, row))) for c, v in stored.items()}
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media, files, boxes, owner, bodies, held = [], [], [], [], [], 0
        for name, data in _files(batches):
            for x in walk(data):
                boxes.append(x)
                owner.append(len(media))
                bodies.append(None if x.error or _own_size(x) > GROUPED_BYTES else _own(data, x))
            media.append(name)
            files.append(data)
            held += len(data)
            if len(boxes) >= OUT_BOXES or held >= OUT_BYTES:
                if boxes:
                    yield batch_of(media, boxes, owner, bodies, lambda k: _said(files[owner[k]], boxes[k]))
                media, files, boxes, owner, bodies, held = [], [], [], [], [], 0
        if boxes:
            yield batch_of(media, boxes, owner, bodies, lambda k: _said(files[owner[k]], boxes[k]))

    return _media(df, id_col, content_col).mapInArrow(run, ddl)


def strict(rows: DataFrame) -> DataFrame:
    """Without the media of which any row has an error."""
    bad = F.max(F.col("error").isNotNull()).over(Window.partitionBy("media_id"))
    return rows.withColumn("_bad", bad).filter(~F.col("_bad")).drop("_bad")


def outline(rows: DataFrame) -> DataFrame:
    """Adds ``line``: the FourCC, two spaces deeper at each level."""
    return rows.withColumn("line", F.concat(F.expr("repeat('  ', depth)"), F.col("fourcc")))


# --- typed views by column expressions


def unsigned(body: Column, offset: int, size: int) -> Column:
    """A big-endian number of up to 7 bytes as a long, of 8 as a decimal."""
    text = F.conv(F.hex(F.substring(body, offset + 1, size)), 16, 10)
    return text.cast("decimal(20,0)" if size > 7 else "bigint")


def signed(body: Column, offset: int, size: int) -> Column:
    value = unsigned(body, offset, size)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << 8 * size)).otherwise(value).cast("bigint")


def view(rows: DataFrame, fourcc: str) -> DataFrame:
    """A fixed box's fields as columns, without Python: whole-byte layouts of ``FIXED`` only."""
    sizes = {"u8": 1, "u16": 2, "u24": 3, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "cc": 4}
    body, at, columns = F.col("body"), 0, {}
    later = None  # a version-dependent field can only be the last
    for item in FIXED[fourcc][1].split():
        if item == "F":
            at += 4
            continue
        name, kind = item.split(":")
        if kind == "v":
            later = name
            columns[name] = F.when(unsigned(body, 0, 1) > 0, unsigned(body, at, 8)).otherwise(unsigned(body, at, 4).cast("decimal(20,0)"))
            continue
        if kind not in sizes or later:
            raise ValueError(f"{fourcc} has no fixed whole-byte layout")
        if name != "-":
            columns[name] = F.substring(body, at + 1, 4).cast("string") if kind == "cc" else (signed if kind[0] == "i" else unsigned)(body, at, sizes[kind])
        at += sizes[kind]
    return rows.filter(F.col("fourcc") == fourcc).select("media_id", "box_index", "depth", *(c.alias(n) for n, c in columns.items()))


def track_runs(rows: DataFrame) -> DataFrame:
    """One row per sample of every ``trun``: media_id, box_index, sample, duration, size, flags, cts."""
    names = ["media_id", "box_index", "sample", "duration", "size", "flags", "cts"]
    optional = (("duration", 0x100), ("size", 0x200), ("flags", 0x400), ("cts", 0x800))

    def run_of(body: bytes) -> dict[str, np.ndarray] | None:
        """The numbers of each field that the run has; None for a body that ends before its samples do."""
        if len(body) < 8:
            return None
        flags, count = int.from_bytes(body[1:4], "big"), int.from_bytes(body[4:8], "big")
        start = 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4)
        there = [name for name, bit in optional if flags & bit]
        if start + 4 * len(there) * count > len(body) or (not there and count > 1 << 20):
            return None
        table = np.frombuffer(body, ">u4", count * len(there), start).reshape(count, -1).astype(np.int64)
        out = {"n": np.full(count, 0)} | dict(zip(there, table.T, strict=True))
        if "cts" in out and body[0]:
            out["cts"] = out["cts"].astype(np.uint32).view(np.int32).astype(np.int64)
        if flags & 4 and "flags" not in out and count:
            out["first"] = int.from_bytes(body[start - 4 : start], "big")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                runs = [run_of(x or b"") for x in part.column(2).to_pylist()]
                counts = np.array([0 if r is None else len(r["n"]) for r in runs], np.int64)
                if not counts.sum():
                    continue
                owner = pa.array(np.repeat(np.arange(len(runs)), counts))
                runs = [r for r, n in zip(runs, counts, strict=True) if n]
                columns = []
                for name, _ in optional:
                    has = np.repeat([name in r for r in runs], [len(r["n"]) for r in runs])
                    values = np.concatenate([r.get(name, r["n"]) for r in runs])
                    if name == "flags":
                        begin = np.cumsum([0, *(len(r["n"]) for r in runs[:-1])])
                        first = [(a, r["first"]) for a, r in zip(begin, runs, strict=True) if "first" in r]
                        for a, value in first:
                            values[a], has[a] = value, True
                    columns.append(pa.array(values, pa.int64(), mask=~has))
                sample = np.concatenate([np.arange(1, len(r["n"]) + 1) for r in runs])
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(sample), *columns], names)

    runs = rows.filter("fourcc = 'trun'").select("media_id", "box_index", "body")
    return runs.mapInArrow(run, "media_id string, box_index int, sample long, duration long, size long, flags long, cts long")
