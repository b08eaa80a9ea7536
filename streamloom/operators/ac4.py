"""AC-4 specific boxes, by the public ETSI TS 103 190-2 layout: rows are written down as the bits are read."""

from __future__ import annotations

from typing import Any

#: Labels of a bit-rate mode and of a group's content.
BIT_RATE_MODES = ["not specified", "constant (1)", "average (2)", "variable (3)"]
CONTENTS = ["complete main (0)", "music and effects (1)", "visually impaired (2)", "hearing impaired (3)", "dialogue (4)", "commentary (5)", "emergency (6)", "voice over (7)"]
#: Substream groups of a presentation by its configuration; 5 has a count of its own, all others but 31 skip bytes.
GROUPS = {0: 2, 1: 2, 2: 2, 3: 3, 4: 3, 31: 1}
EMDF_ONLY, COUNTED, SINGLE = 6, 5, 31


class Rows(list):
    """[key, value] rows; a value is anything the box renderer knows."""

    def put(self, key: str, value: Any) -> Any:
        self.append([key, value])
        return value


def _align(r) -> None:
    r.bit += -r.bit % 8


def _mask(r):
    from streamloom.operators.box_fields import Mask

    return Mask(r.bits(24).to_bytes(3, "big"))


def _bytes(r, n: int) -> bytes:
    return bytes(r.bits(8) for _ in range(n))


def _substream(r, rows: Rows, at: str, channels: bool) -> None:
    rows.put(f"{at} sf_multiplier", r.bits(2))
    if r.bits(1):
        rows.put(f"{at} bitrate_indicator", r.bits(5))
    if channels:
        rows.put(f"{at} channel_mask", _mask(r))
        return
    if r.bits(1):  # joint object coding
        if not r.bits(1):
            rows.put(f"{at} n_dmx_objects", r.bits(4) + 1)
        rows.put(f"{at} n_umx_objects", r.bits(6) + 1)
    for kind in ("bed", "dynamic", "isf"):
        rows.put(f"{at} contains_{kind}_objects", bool(r.bits(1)))
    r.bits(1)


def _group(r, rows: Rows, i: int) -> None:
    r.bits(1)
    rows.put(f"g[{i}] hsf_ext", bool(r.bits(1)))
    channels = rows.put(f"g[{i}] channel_coded", bool(r.bits(1)))
    count = r.bits(8)
    if count:
        rows.put(f"g[{i}] substreams", f"s.len() == {count}")
    for j in range(count):
        _substream(r, rows, f"g[{i}]s[{j}]", channels)
    if r.bits(1):
        rows.put(f"g[{i}] content_classifier", CONTENTS[r.bits(3)])
        if r.bits(1):
            rows.put(f"g[{i}] language_tag", _bytes(r, r.bits(6)).decode("utf-8", "replace"))


def _groups(r, rows: Rows, config: int) -> None:
    count = r.bits(3) + 2 if config == COUNTED else GROUPS.get(config)
    if count is None:
        _bytes(r, r.bits(7))
        return
    rows.put("substream_groups", f"g.len() == {count}")
    for i in range(count):
        _group(r, rows, i)


def _channels(r, rows: Rows) -> None:
    """What a presentation of version 1 or 2 tells of its channels, core and filter."""
    from streamloom.operators.box_fields import Hex

    if rows.put("channel_coded", bool(r.bits(1))):
        if 11 <= rows.put("ch_mode", r.bits(5)) <= 14:
            rows.put("4_back_channels", bool(r.bits(1)))
            rows.put("top_channel_pairs", r.bits(2))
        rows.put("channel_mask", _mask(r))
    if rows.put("core_differs", bool(r.bits(1))) and rows.put("core_channel_coded", bool(r.bits(1))):
        rows.put("channel_mode_core", r.bits(2))
    if rows.put("presentation_filter", bool(r.bits(1))):
        rows.put("enable_presentation", bool(r.bits(1)))
        rows.put("filter_data", Hex(_bytes(r, r.bits(8))))


def _emdf(r, rows: Rows) -> None:
    count = r.bits(7)
    if count:
        rows.put("emdf_substreams", "")
    for i in range(count):
        rows.put(f"[{i}] version", r.bits(5))
        rows.put(f"[{i}] key_id", r.bits(10))


def _rates(r, rows: Rows) -> None:
    rows.put("bit_rate_mode", BIT_RATE_MODES[r.bits(2)])
    rows.put("bit_rate", r.bits(32))
    rows.put("bit_rate_precision", r.bits(32))


def _alternative(r, rows: Rows) -> None:
    _align(r)
    rows.put("alternative_info", "")
    rows.put("name", _bytes(r, r.bits(16)).decode("utf-8", "replace"))
    count = r.bits(5)
    if count:
        rows.put("alternative_info_targets", "")
    for i in range(count):
        rows.put(f"[{i}] md_compat", r.bits(3))
        rows.put(f"[{i}] device_category", r.bits(8))


def presentation(r, version: int, size: int) -> Rows:
    """Rows of one presentation of ``size`` bytes; the reader is left somewhere inside of it."""
    rows, start = Rows(), r.bit
    rows.put("version", version)
    config, more = rows.put("config", r.bits(5)), True
    if config != EMDF_ONLY:
        rows.put("md_compat", r.bits(3))
        if r.bits(1):
            rows.put("id", r.bits(5))
        rows.put("dsi_frame_rate_multiply_info", r.bits(2))
        if version:
            rows.put("dsi_frame_rate_fraction_info", r.bits(2))
        rows.put("emdf_version", r.bits(5))
        rows.put("key_id", r.bits(10))
        if version:
            _channels(r, rows)
        else:
            rows.put("channel_mask", _mask(r))
        if config != SINGLE:
            rows.put("multi_pid" if version else "hsf_ext", bool(r.bits(1)))
        _groups(r, rows, config)
        rows.put("pre_virtualized", bool(r.bits(1)))
        more = r.bits(1)
    if more:
        _emdf(r, rows)
    if not version:
        _align(r)
        return rows
    if r.bits(1):
        _rates(r, rows)
    if r.bits(1):
        _alternative(r, rows)
    _align(r)
    if r.bit - start <= 8 * (size - 1):  # older writers end here
        rows.put("dialogue_enancement", "true" if r.bits(1) else "false")
        rows.put("dolby_atmos" if version == 2 else "immersive_audio", "true" if r.bits(1) else "false")
        r.bits(4)
        if r.bits(1):
            rows.put("extended_id", str(r.bits(9)))
        else:
            r.bits(1)
    return rows


def specific_box(r) -> list[tuple[str, Any]]:
    from streamloom.operators.box_fields import Malformed, Table

    out = Rows()
    out.put("ac4_dsi_version", r.bits(3))
    stream = out.put("bitstream_version", r.bits(7))
    out.put("fs_index", r.bits(1))
    out.put("frame_rate_index", r.bits(4))
    count = r.bits(9)
    if stream > 1 and r.bits(1):
        out.put("short_program_id", r.bits(16))
        if r.bits(1):
            out.put("program_uuid", _bytes(r, 16).decode("utf-8", "replace"))
    _rates(r, out)
    _align(r)
    for k in range(count):
        version, size = r.bits(8), r.bits(8)
        if size == 255:
            size += r.bits(16)
        start = r.bit
        rows = presentation(r, version, size) if version <= 2 else [["unhandled version", version]]
        if r.bit > start + 8 * size:
            raise Malformed("dac4 pres_bytes < presentation_bytes")
        r.bit = start
        r.bits(8 * size)
        out.put(f"presentation #{k + 1}", Table(None, rows))
    return [tuple(x) for x in out]
