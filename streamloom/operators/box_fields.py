"""Fields of ISO base media boxes: one short layout per fixed box, one function per box of variable shape.

``describe(fourcc, body)`` gives the box's name and its ordered (key, value) pairs. A value is None, a number, a boolean,
text, ``Hex`` bytes, a ``Mask`` of bits, or a ``Table`` with optional headers. ``render`` turns any of these into text.

A layout is a string of ``name:type`` items. Types: u8 u16 u24 u32 u64 i8 i16 i32 f32, bN (N bits), v (u32, or u64 from
version 1 on), cc (four characters), z (text up to a NUL), rest (all bytes left), fx16 and fx8 (fixed point); ``-`` as a
name reads past. ``F`` at the start is a version byte and 24 flags.
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from streamloom.operators import ac4, drm, id3


class Hex(bytes):
    """Rendered as a dump."""


class Mask(bytes):
    """Rendered as binary digits."""


class Table(NamedTuple):
    headers: list[str] | None
    rows: list[list[Any]]


class Malformed(ValueError):
    pass


class TooMany(Malformed):
    """More entries than a reader takes."""


class Reader:
    """Big-endian numbers and bit fields; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.bit = data, 0

    def bits(self, n: int) -> int:
        end = self.bit + n
        if end > 8 * len(self.data):
            raise Malformed(f"box ends after {len(self.data)} bytes")
        a, b = self.bit // 8, -(-end // 8)
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - end)
        self.bit = end
        return value & ((1 << n) - 1)

    def u(self, size: int) -> int:
        at, odd = divmod(self.bit, 8)
        if odd:
            return self.bits(8 * size)
        if at + size > len(self.data):
            raise Malformed(f"box ends after {len(self.data)} bytes")
        self.bit += 8 * size
        return int.from_bytes(self.data[at : at + size], "big")

    def i(self, size: int) -> int:
        value = self.u(size)
        return value - (1 << 8 * size) if value >> (8 * size - 1) else value

    def f32(self) -> float:
        return struct.unpack(">f", self.u(4).to_bytes(4, "big"))[0]

    def take(self, n: int) -> bytes:
        at = self.bit // 8
        if n < 0 or at + n > len(self.data):
            raise Malformed(f"box ends after {len(self.data)} bytes")
        self.bit += 8 * n
        return self.data[at : at + n]

    @property
    def left(self) -> int:
        return len(self.data) - self.bit // 8

    def rest(self) -> bytes:
        return self.take(self.left)

    def cc(self) -> str:
        return text_of(self.take(4))

    def z(self) -> str:
        at = self.bit // 8
        end = self.data.find(b"\0", at)
        out = self.take((len(self.data) if end < 0 else end) - at)
        if end >= 0:
            self.bit += 8
        return text_of(out)

    def full(self) -> tuple[int, int]:
        return self.u(1), self.u(3)


def text_of(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def fixed(value: int, fraction: int) -> str:
    return format(value / (1 << fraction), "g")


def float_text(x: float) -> str:
    """Shortest digits that give the same 32-bit float back."""
    import numpy as np

    text = np.format_float_positional(np.float32(x), trim="-") if x == x and abs(x) != float("inf") else {"inf": "inf", "-inf": "-inf"}.get(str(x), "NaN")
    return text


def dump(data: bytes) -> str:
    group = lambda g: " ".join(f"{b:02X}" for b in g)
    lines = [data[i : i + 16] for i in range(0, len(data), 16)]
    return "\n".join("  ".join(group(line[k : k + 4]) for k in range(0, len(line), 4)) for line in lines)


def render(value: Any) -> str:
    kind = type(value)
    if kind is str:
        return value
    if kind is int:
        return str(value)
    if value is None:
        return ""
    if isinstance(value, Mask):
        return " ".join(f"{b:08b}" for b in value)
    if isinstance(value, Hex):
        return dump(value)
    if isinstance(value, bytes):
        return f"Data<{len(value)}>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, list | tuple):
        return ", ".join(map(render, value))
    return str(value)


_SIZES = {"u8": 1, "u16": 2, "u24": 3, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4}
Fields = list[tuple[str, Any]]


@functools.cache
def _steps(layout: str) -> list[tuple[str, str, int]]:
    """(name, type, size in bytes or bits) of each item."""
    pairs = [item.split(":") for item in layout.split() if item != "F"]
    out = [(name, "i" if kind[0] == "i" else "u", _SIZES[kind]) if kind in _SIZES else (name, "b", int(kind[1:])) if kind[0] == "b" else (name, kind, 0) for name, kind in pairs]
    return [("", "F", 0), *out] if layout.startswith("F") else out


def read_layout(layout: str, r: Reader) -> Fields:
    out, version = [], 0
    for name, kind, size in _steps(layout):
        if kind == "u":
            value = r.u(size)
        elif kind == "F":
            version, _ = r.full()
            continue
        elif kind == "b":
            value = r.bits(size)
        elif kind == "i":
            value = r.i(size)
        elif kind == "v":
            value = r.u(8 if version else 4)
        elif kind == "f32":
            value = r.f32()
        elif kind == "cc":
            value = r.cc()
        elif kind == "z":
            value = r.z()
        elif kind == "rest":
            value = r.rest()
        elif kind == "flag":
            value = bool(r.bits(1))
        else:
            value = fixed(r.i(4 if kind == "fx16" else 2), int(kind[2:]))
        if name != "-":
            out.append((name, value))
    return out


#: FourCC -> (name, layout) of boxes of fixed shape.
FIXED: dict[str, tuple[str, str]] = {
    "blin": ("StereoCameraSystemBaselineBox", "F baseline_value:u32"),
    "btrt": ("BitRateBox", "buffer_size_db:u32 max_bitrate:u32 avg_bitrate:u32"),
    "ccst": ("CodingConstraintsBox", "F all_ref_pics_intra:flag intra_pred_used:flag max_ref_per_pic:b4 -:b26"),
    "clap": ("CleanApertureBox", " ".join(f"{k}:u32" for k in ("clean_aperture_width_n", "clean_aperture_width_d", "clean_aperture_height_n", "clean_aperture_height_d")) + " horiz_off_n:i32 horiz_off_d:u32 vert_off_n:i32 vert_off_d:u32"),
    "corg": ("CameraSystemOriginSourceBox", "F source_of_origin:cc"),
    "dadj": ("StereoComfortDisparityAdjustmentBox", "F disparity_adjustment:i32"),
    "dOps": ("OpusSpecificBox", "-:u8 output_channel_count:u8 pre_skip:u16 input_sample_rate:u32 output_gain:i16"),
    "equi": ("FullEquirectangularProjectionBox", ""),
    "fish": ("FisheyeProjectionBox", ""),
    "free": ("FreeSpaceBox", ""),
    "frma": ("OriginalFormatBox", "data_format:cc"),
    "hdlr": ("HandlerBox", "F -:u32 handler:cc -:u64 -:u32 name:z"),
    "hequ": ("HalfEquirectangularProjectionBox", ""),
    "hfov": ("HorizontalFieldOfViewBox", "field_of_view:u32"),
    "idat": ("ItemDataBox", "data:rest"),
    "imir": ("ImageMirror", "-:b7 axis:b1"),
    "irot": ("ImageRotation", "-:b6 angle:b2"),
    "iscl": ("ImageScaling", "F target_width_numerator:u16 target_width_denominator:u16 target_height_numerator:u16 target_height_denominator:u16"),
    "ispe": ("ImageSpatialExtentProperty", "F width:u32 height:u32"),
    "mehd": ("MovieExtendsHeaderBox", "F fragment_duration:v"),
    "mfhd": ("MovieFragmentHeaderBox", "F sequence_number:u32"),
    "pasp": ("PixelAspectRatioBox", "h_spacing:u32 v_spacing:u32"),
    "pkin": ("ViewPackingInformationBox", "F view_packing_kind:cc"),
    "prim": ("ParametricImmersiveMediaProjectionBox", ""),
    "prji": ("ProjectionInformationBox", "F projection_kind:cc"),
    "rdim": ("CameraSystemLensReferenceDimensionsBox", "F reference_width:u32 reference_height:u32"),
    "lnhd": ("CameraSystemLensHeaderBox", "F lens_identifier:u32 lens_algorithm_kind:cc lens_domain:cc lens_role:cc"),
    "rect": ("RectilinearProjectionBox", ""),
    "skip": ("FreeSpaceBox", ""),
    "smhd": ("SoundMediaHeaderBox", "F balance:fx8"),
    "stri": ("StereoViewInformationBox", "F -:b4 eye_views_reversed:flag has_additional_views:flag has_right_eye_view:flag has_left_eye_view:flag"),
    "taic": ("TAIClockInfoBox", "F time_uncertainty:u64 clock_resolution:u32 clock_drift_rate:i32 clock_type:b2 -:b6"),
    "tfdt": ("TrackFragmentBaseMediaDecodeTimeBox", "F base_media_decode_time:v"),
    "trex": ("TrackExtendsBox", "F track_id:u32 default_sample_description_index:u32 default_sample_duration:u32 default_sample_size:u32 default_sample_flags:u32"),
    "auxC": ("AuxiliaryTypeProperty", "F aux_type:z aux_subtype:rest"),
}
VARIABLE: dict[str, tuple[str, Callable[[Reader], Fields]]] = {}


def box(fourcc: str, name: str):
    def register(decode):
        VARIABLE[fourcc] = (name, decode)
        return decode

    return register


def many(r: Reader, count: int, each: Callable[[], Any]) -> list:
    if count > 8 * len(r.data):
        raise Malformed(f"{count} entries do not fit")
    return [each() for _ in range(count)]


def _numbers(name: str, size: int):
    def decode(r: Reader) -> Fields:
        r.full()
        return [(name, many(r, r.u(4), lambda: r.u(size)))]

    return decode


box("stco", "ChunkOffsetBox")(_numbers("entries", 4))
box("co64", "ChunkLargeOffsetBox")(_numbers("entries", 8))
box("stss", "SyncSampleBox")(_numbers("entries", 4))


def _rows(headers: list[str], widths: tuple[int, ...], signed_from: int = 9):
    def decode(r: Reader) -> Fields:
        version, _ = r.full()
        one = lambda: [r.i(w) if k >= signed_from and version else r.u(w) for k, w in enumerate(widths)]
        return [("entries", Table(headers, many(r, r.u(4), one)))]

    return decode


box("stts", "TimeToSampleBox")(_rows(["count", "delta"], (4, 4)))
box("stsc", "SampleToChunkBox")(_rows(["first_chunk", "samples_per_chunk", "sample_description_index"], (4, 4, 4)))


@box("ctts", "CompositionOffsetBox")
def _ctts(r):
    version, _ = r.full()
    return [("entries", many(r, r.u(4), lambda: f"(count: {r.u(4)}, offset: {r.i(4) if version else r.u(4)})"))]


@box("stsz", "SampleSizeBox")
def _stsz(r):
    r.full()
    size, count = r.u(4), r.u(4)
    return [("sample_count", count), ("sample_size", size) if size else ("sample_sizes", many(r, count, lambda: r.u(4)))]


@box("elst", "EditListBox")
def _elst(r):
    version, _ = r.full()
    w = 8 if version else 4
    return [("entries", Table(["segment_duration", "media_time", "media_rate", "media_rate_fraction"], many(r, r.u(4), lambda: [r.u(w), r.i(w), r.i(2), r.i(2)])))]


@box("trun", "TrackRunBox")
def _trun(r):
    version, flags = r.full()
    count = r.u(4)
    offset = r.i(4) if flags & 1 else None
    first = r.u(4) if flags & 4 else None
    rows = []

    def one():
        duration = r.u(4) if flags & 0x100 else None
        size = r.u(4) if flags & 0x200 else None
        own = r.u(4) if flags & 0x400 else first if not rows else None
        cts = (r.i(4) if version else r.u(4)) if flags & 0x800 else None
        rows.append([len(rows) + 1, duration, size, None if own is None else Hex(own.to_bytes(4, "big")), cts])

    if not flags & 0xF00 and count > 1 << 20:
        raise Malformed(f"{count} samples without fields")
    many(r, count if flags & 0xF00 else 0, one) if flags & 0xF00 else [one() for _ in range(count)]
    return [("data_offset", offset), ("sample_count", count), ("entries", Table(["#", "duration", "size", "flags", "cts"], rows))]


@box("tfhd", "TrackFragmentHeaderBox")
def _tfhd(r):
    _, flags = r.full()
    out = [("track_id", r.u(4))]
    optional = [("base_data_offset", 1, 8), ("sample_description_index", 2, 4), ("default_sample_duration", 8, 4), ("default_sample_size", 16, 4), ("default_sample_flags", 32, 4)]
    return out + [(name, r.u(width) if flags & bit else None) for name, bit, width in optional]


def _brands(r):
    return [("major_brand", r.cc()), ("minor_version", r.u(4)), ("compatible_brands", many(r, r.left // 4, r.cc))]


box("ftyp", "FileTypeBox")(_brands)
box("styp", "SegmentTypeBox")(_brands)


def _language(code: int) -> str:
    return "".join(chr(0x60 + (code >> s & 31)) for s in (10, 5, 0))


@box("mdhd", "MediaHeaderBox")
def _mdhd(r):
    version, _ = r.full()
    w = 8 if version else 4
    return [("creation_time", r.u(w)), ("modification_time", r.u(w)), ("timescale", r.u(4)), ("duration", r.u(w)), ("language", _language(r.u(2)))]


def _matrix(r) -> Table:
    m = [r.i(4) for _ in range(9)]
    return Table(None, [[fixed(m[3 * k], 16), fixed(m[3 * k + 1], 16), fixed(m[3 * k + 2], 30)] for k in range(3)])


@box("mvhd", "MovieHeaderBox")
def _mvhd(r):
    version, _ = r.full()
    w = 8 if version else 4
    out = [("creation_time", r.u(w)), ("modification_time", r.u(w)), ("timescale", r.u(4)), ("duration", r.u(w)), ("rate", fixed(r.i(4), 16)), ("volume", fixed(r.i(2), 8))]
    r.take(10)
    out.append(("matrix", _matrix(r)))
    r.take(24)
    return [*out, ("next_track_id", r.u(4))]


@box("tkhd", "TrackHeaderBox")
def _tkhd(r):
    version, flags = r.full()
    w = 8 if version else 4
    out = [("creation_time", r.u(w)), ("modification_time", r.u(w)), ("track_id", r.u(4))]
    r.take(4)
    out.append(("duration", r.u(w)))
    r.take(8)
    out += [("layer", r.i(2)), ("alternate_group", r.i(2)), ("enabled", bool(flags & 1)), ("volume", fixed(r.i(2), 8))]
    r.take(2)
    return [*out, ("matrix", _matrix(r)), ("width", fixed(r.u(4), 16)), ("height", fixed(r.u(4), 16))]


@box("vmhd", "VideoMediaHeaderBox")
def _vmhd(r):
    r.full()
    return [("graphics_mode", r.u(2)), ("op_color", f"r:{r.u(2)}, g:{r.u(2)}, b:{r.u(2)}")]


@box("dref", "DataReferenceBox")
def _dref(r):
    r.full()
    urls = []

    def one():
        size, kind = r.u(4), r.cc()
        body = Reader(r.take(size - 8))
        body.full()
        urls.append([body.z() if kind == "url " and body.left else ""])

    many(r, r.u(4), one)
    return [("urls", Table(None, urls))]


@box("esds", "ElementaryStreamDescriptorBox")
def _esds(r):
    r.full()
    out: dict[str, Any] = dict.fromkeys(("es_id", "decoder_config_object_type_indication", "decoder_config_stream_type", "decoder_config_up_stream", "decoder_config_buffer_size_db", "decoder_config_max_bitrate", "decoder_config_avg_bitrate", "decoder_specific_profile", "decoder_specific_freq_index", "decoder_specific_chan_conf"))

    def descriptor(d: Reader) -> None:
        tag, size = d.u(1), 0
        while True:
            b = d.u(1)
            size = size << 7 | b & 127
            if not b & 128:
                break
        body = Reader(d.take(size))
        if tag == 3:
            out["es_id"] = body.u(2)
            flags = body.u(1)
            body.take(2 * bool(flags & 0x80))
            if flags & 0x40:
                body.take(body.u(1))
            body.take(2 * bool(flags & 0x20))
            while body.left:
                descriptor(body)
        elif tag == 4:
            out["decoder_config_object_type_indication"] = body.u(1)
            out["decoder_config_stream_type"], out["decoder_config_up_stream"] = body.bits(6), bool(body.bits(1))
            body.bits(1)
            for key, width in (("buffer_size_db", 3), ("max_bitrate", 4), ("avg_bitrate", 4)):
                out[f"decoder_config_{key}"] = body.u(width)
            while body.left:
                descriptor(body)
        elif tag == 5 and size:
            profile = body.bits(5)
            out["decoder_specific_profile"] = 32 + body.bits(6) if profile == 31 else profile
            index = body.bits(4)
            out["decoder_specific_freq_index"] = index
            if index == 15:
                body.bits(24)
            out["decoder_specific_chan_conf"] = body.bits(4)

    while r.left:
        descriptor(r)
    return list(out.items())


@box("avcC", "AVCConfigurationBox")
def _avcc(r):
    head = [("configuration_version", r.u(1)), ("avc_profile_indication", r.u(1)), ("profile_compatibility", r.u(1)), ("avc_level_indication", r.u(1)), ("length_size", (r.u(1) & 3) + 1)]
    sets = lambda n: Table(None, [[Hex(r.take(r.u(2)))] for _ in range(n)])
    out = [*head, ("sequence_parameter_sets", sets(r.u(1) & 31)), ("picture_parameter_sets", sets(r.u(1)))]
    extended = head[1][1] in (100, 110, 122, 144) and r.left >= 4
    chroma, luma, depth = (r.u(1) & 3, (r.u(1) & 7) + 8, (r.u(1) & 7) + 8) if extended else (None, None, None)
    return [*out, ("ext_chroma_format", chroma), ("ext_bit_depth_luma", luma), ("ext_bit_depth_chroma", depth), ("ext_sequence_parameter_sets", sets(r.u(1)) if extended else None)]


def _nal_arrays(r) -> Table:
    rows = []
    for _ in range(r.u(1)):
        head = r.u(1)
        nalus = [r.take(r.u(2)) for _ in range(r.u(2))]
        rows.append([bool(head & 0x80), head & 0x3F, Hex(b"".join(nalus))])
    return Table(["completeness", "nal_unit_type", "nalus"], rows)


def _hvcc(r):
    out = [("configuration_version", r.u(1)), ("general_profile_space", r.bits(2)), ("general_tier_flag", bool(r.bits(1))), ("general_profile_idc", r.bits(5))]
    out += [("general_profile_compatibility_flags", list(r.take(4))), ("general_constraint_indicator_flags", list(r.take(6))), ("general_level_idc", r.u(1)), ("min_spatial_segmentation_idc", r.u(2) & 0xFFF)]
    out += [("parallelism_type", r.u(1) & 3), ("chroma_format_idc", r.u(1) & 3), ("bit_depth_luma_minus8", r.u(1) & 7), ("bit_depth_chroma_minus8", r.u(1) & 7), ("avg_frame_rate", r.u(2))]
    out += [("constant_frame_rate", r.bits(2)), ("num_temporal_layers", r.bits(3)), ("temporal_id_nested", bool(r.bits(1))), ("length_size_minus_one", r.bits(2))]
    return [*out, ("arrays", _nal_arrays(r))]


box("hvcC", "HEVCConfigurationBox")(_hvcc)
box("hvcE", "DolbyVisionELHEVCConfigurationBox")(_hvcc)


@box("lhvC", "LayeredHEVCConfigurationBox")
def _lhvc(r):
    out = [("configuration_version", r.u(1)), ("min_spatial_segmentation_idc", r.u(2) & 0xFFF), ("parallelism_type", r.u(1) & 3)]
    r.bits(2)
    return [*out, ("num_temporal_layers", r.bits(3)), ("temporal_id_nested", bool(r.bits(1))), ("length_size_minus_one", r.bits(2)), ("arrays", _nal_arrays(r))]


@box("av1C", "AV1CodecConfigurationBox")
def _av1c(r):
    r.bits(8)
    out = [("seq_profile", r.bits(3)), ("seq_level_idx_0", r.bits(5))]
    out += [(k, bool(r.bits(1))) for k in ("seq_tier_0", "high_bitdepth", "twelve_bit", "monochrome", "chroma_subsampling_x", "chroma_subsampling_y")]
    out.append(("chroma_sample_position", r.bits(2)))
    r.bits(3)
    present, delay = r.bits(1), r.bits(4)
    return [*out, ("initial_presentation_delay", delay + 1 if present else None), ("config_obus", Hex(r.rest()))]


@box("vpcC", "VPCodecConfigurationBox")
def _vpcc(r):
    r.full()
    out = [("profile", r.u(1)), ("level", r.u(1)), ("bit_depth", r.bits(4)), ("chroma_subsampling", r.bits(3)), ("video_full_range_flag", bool(r.bits(1)))]
    return [*out, ("color_primaries", r.u(1)), ("transfer_characteristics", r.u(1)), ("matrix_coefficients", r.u(1)), ("codec_initialization_data", Hex(r.take(r.u(2))))]


@box("colr", "ColourInformationBox")
def _colr(r):
    kind = r.cc()
    if kind == "nclx":
        return [("colour_type", kind), ("colour_primaries", r.u(2)), ("transfer_characteristics", r.u(2)), ("matrix_coefficients", r.u(2)), ("full_range_flag", r.u(1) == 0x80)]
    if kind in ("rICC", "prof"):
        return [("colour_type", "ricc" if kind == "rICC" else kind), ("profile", Hex(r.rest()))]
    if kind == "nclc":
        return [("colour_type", kind), ("primaries_index", r.u(2)), ("transfer_function_index", r.u(2)), ("matrix_index", r.u(2))]
    return [("colour_type", kind), ("bytes", Hex(r.rest()))]


#: Kilobits a second of an AC-3 bit rate code.
AC3_RATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]


@box("dac3", "AC3SpecificBox")
def _dac3(r):
    out = read_layout("fscod:b2 bsid:b5 bsmod:b3 acmod:b3 lfeon:b1 code:b5 -:b5", r)
    code = out.pop()[1]
    return [*out, ("bit_rate", AC3_RATES[code] if code < len(AC3_RATES) else 0)]


#: Channel locations of an enhanced AC-3 dependent substream, from bit 0 on.
CHANNEL_LOCATIONS = ["Lc/Rc", "Lrs/Rrs", "Cs", "Ts", "Lsd/Rsd", "Lw/Rw", "Lvh/Rvh", "Cvh", "LFE2"]


@box("dec3", "EC3SpecificBox")
def _dec3(r):
    rate, count = r.bits(13), r.bits(3) + 1
    out = [("data_rate", rate)]
    for k in range(count):
        rows = read_layout("fscod:b2 bsid:b5 -:b1 asvc:flag bsmod:b3 acmod:b3 lfeon:flag -:b3 num_dep_sub:b4", r)
        if rows[-1][1]:
            mask = r.bits(9)
            names = [n for b, n in enumerate(CHANNEL_LOCATIONS) if mask >> b & 1]
            rows.append(("chan_loc", f"{mask:09b} ({' + '.join(names)})"))
        else:
            r.bits(1)
        out.append((f"independent_substream #{k}", Table(None, [list(x) for x in rows])))
    return out


box("dac4", "AC4SpecificBox")(ac4.specific_box)


def _dolby_vision(r):
    out = read_layout("dv_version_major:u8 dv_version_minor:u8 dv_profile:b7 dv_level:b6 rpu_present_flag:flag el_present_flag:flag bl_present_flag:flag dv_bl_signal_compatibility_id:b4 dv_md_compression:b2 -:b2", r)
    r.take(19)
    return out


for _cc in ("dvvC", "dvcC", "dvwC"):
    box(_cc, "DOVIDecoderConfigurationRecord")(_dolby_vision)


@box("hero", "HeroStereoEyeDescriptionBox")
def _hero(r):
    r.full()
    eye = r.u(1)
    return [("hero_eye_indicator", eye), ("description", {0: "none", 1: "left", 2: "right"}.get(eye, "reserved"))]


@box("must", "RequiredBoxTypesBox")
def _must(r):
    r.full()
    return [("required_box_types", many(r, r.left // 4, r.cc))]


@box("rref", "RequiredReferenceTypesProperty")
def _rref(r):
    r.full()
    return [("reference_types", many(r, r.u(1), r.cc))]


@box("lac4", "AC4PresentationLabelBox")
def _lac4(r):
    r.full()
    count = r.u(2)
    tag = r.z()
    return [("language_tag", tag), ("labels", Table(["id", "label"], many(r, count, lambda: [r.u(2), r.z()])))]


@box("ldst", "CameraSystemLensDistortionsBox")
def _ldst(r):
    _, flags = r.full()
    out = [(k, r.f32()) for k in ("k1", "k2", "p1", "p2")]
    return [*out, ("calibration_limit_radial_angle", r.f32())] if flags & 1 else out


@box("lfad", "CameraSystemLensFrameAdjustmentBox")
def _lfad(r):
    r.full()
    floats = lambda: "[" + ", ".join(float_text(r.f32()) for _ in range(3)) + "]"
    return [("polynomial_parameters_x", floats()), ("polynomial_parameters_y", floats())]


@box("uqua", "CameraSystemUnitQuaternionTransformBox")
def _uqua(r):
    r.full()
    return [("xyz", "[" + ", ".join(float_text(r.f32()) for _ in range(3)) + "]")]


@box("lnin", "CameraSystemLensIntrinsicsBox")
def _lnin(r):
    _, flags = r.full()
    out = [("denominator_shift_operand", r.i(2)), ("skew_denominator_shift_operand", r.i(2)), ("focal_length_x", r.i(4)), ("principal_point_x", r.i(4)), ("principal_point_y", r.i(4))]
    if flags & 1:
        out += [("focal_length_y", r.i(4)), ("skew_factor", r.i(4))]
    return [*out, ("projection_offset", r.f32())] if flags & 2 else out


# What the time of a producer reference stands for, by the box's flags.
PRFT_TIMES = {
    0: "The UTC time is the time at which the frame belonging to the reference track in the following movie fragment and whose presentation time is media_time was input to the encoder.",
    1: "The UTC time is the time at which the frame belonging to the reference track in the following movie fragment and whose presentation time is `media_time` was output from the encoder.",
    2: "The UTC time is the time at which the following MovieFragmentBox was finalized. `media_time` is set to the presentation of the earliest frame of the reference track in presentation order of the movie fragment.",
    4: "The UTC time is the time at which the following MovieFragmentBox was written to file. `media_time` is set to the presentation of the earliest frame of the reference track in presentation order of the movie fragment.",
    8: "The association between the `media_time` and UTC time is arbitrary but consistent between multiple occurrences of this box in the same track",
    24: "The UTC time has a consistent, small (ideally zero), offset from the real-time of the experience depicted in the media at `media_time`",
}
PRFT_UNKNOWN = "The association is unknown because an unknown flag was set in the `prft` atom."


@box("prft", "ProducerReferenceTimeBox")
def _prft(r):
    version, flags = r.full()
    return [("reference_track_id", r.u(4)), ("ntp_timestamp", r.u(8)), ("media_time", r.u(8 if version else 4)), ("ntp_timestamp_media_time_association", PRFT_TIMES.get(flags, PRFT_UNKNOWN))]


@box("saio", "SampleAuxiliaryInformationOffsetsBox")
def _saio(r):
    version, flags = r.full()
    kind, parameter = (r.cc(), r.u(4)) if flags & 1 else (None, None)
    return [("aux_info_type", kind), ("aux_info_type_parameter", parameter), ("offsets", many(r, r.u(4), lambda: r.u(8 if version else 4)))]


@box("saiz", "SampleAuxiliaryInformationSizesBox")
def _saiz(r):
    _, flags = r.full()
    kind, parameter = (r.cc(), r.u(4)) if flags & 1 else (None, None)
    size, count = r.u(1), r.u(4)
    return [("aux_info_type", kind), ("aux_info_type_parameter", parameter), ("default_sample_info_size", size), ("sample_count", count), ("sample_info_size", [] if size else many(r, count, lambda: r.u(1)))]


@box("sbgp", "SampleToGroupBox")
def _sbgp(r):
    version, _ = r.full()
    return [("grouping_type", r.cc()), ("grouping_type_parameter", r.u(4) if version == 1 else None), ("entries", Table(["sample_count", "group_description_index"], many(r, r.u(4), lambda: [r.u(4), r.u(4)])))]


@box("sgpd", "SampleGroupDescriptionBox")
def _sgpd(r):
    version, flags = r.full()
    kind = r.cc()
    length = r.u(4) if version >= 1 else None
    index = r.u(4) if version >= 2 else None
    rows = []

    def one():
        size = r.u(4) if version >= 1 and length == 0 else length
        rows.append([size if length == 0 else None, kind, Hex(r.take(size) if size is not None else r.rest())])

    many(r, r.u(4), one)
    return [("grouping_type", kind), ("default_length", length), ("default_group_description_index", index), ("static_group_description", bool(flags & 1)), ("static_mapping", bool(flags & 2)), ("essential", bool(flags & 4)), ("entries", Table(["description_length", "4CC", "data"], rows))]


@box("subs", "SubSampleInformationBox")
def _subs(r):
    version, flags = r.full()
    rows = []

    def one():
        delta, row = r.u(4), []
        for _ in range(r.u(2)):
            row += [delta, r.u(4 if version else 2), r.u(1), bool(r.u(1)), Hex(r.take(4))]
        rows.append(row)

    many(r, r.u(4), one)
    return [("flags", Hex(flags.to_bytes(3, "big"))), ("entries", Table(["sample_delta", "size", "priority", "discardable", "params"], rows))]


@box("schm", "SchemeTypeBox")
def _schm(r):
    _, flags = r.full()
    return [("scheme_type", r.cc()), ("scheme_version", r.u(4)), ("scheme_uri", r.z() if flags & 1 else None)]


@box("tenc", "TrackEncryptionBox")
def _tenc(r):
    version, _ = r.full()
    r.u(1)
    crypt, skip = r.bits(4), r.bits(4)
    protected, size, kid = r.u(1), r.u(1), r.take(16)
    constant = r.take(r.u(1)) if protected == 1 and size == 0 and r.left else None
    sizes = {8: "64-bit", 16: "128-bit"}
    own = {0: "Not protected" if protected == 0 else "Constant IV"} | sizes
    out = [
        ("default_isProtected", f"{protected} ({ {0: 'Not protected', 1: 'Protected'}.get(protected, 'Reserved')})"),
        ("default_Per_Sample_IV_Size", f"{size} ({own.get(size, 'Undocumented in ISO/IEC 23001-7:2016')})"),
        ("default_KID", kid.hex()),
    ]
    if constant is not None:
        out += [("default_constant_IV_size", f"{len(constant)} ({sizes.get(len(constant), 'Undocumented size in ISO/IEC 23001-7:2016')})"), ("default_constant_IV", constant.hex())]
    return out + ([("default_crypt_byte_block", crypt), ("default_skip_byte_block", skip)] if version else [])


#: Limits that a sample encryption box must keep.
MOST_SAMPLES = MOST_SUBSAMPLES = 4096


def sample_encryption(body: bytes, iv_size: int | None = None, most_samples: int = MOST_SAMPLES, most_subsamples: int = MOST_SUBSAMPLES) -> list[tuple[str, list[tuple[int, int]]]]:
    """(iv, [(clear, protected)]) of each sample. Without a known IV size, 0, 8 and 16 are tried for an exact fit."""
    r = Reader(body)
    _, flags = r.full()
    count = r.u(4)
    if count > most_samples:
        raise TooMany(f"{count} samples; at most {most_samples} are read")
    if not count:
        return []
    start, crowded = r.bit, None
    if not flags & 2:
        sizes = [iv_size] if iv_size is not None else [r.left // count] if r.left % count == 0 else []
    else:
        sizes = [iv_size] if iv_size is not None else [0, 8, 16]
    for size in sizes:
        if size not in (0, 8, 16):
            continue
        r.bit, out = start, []
        try:
            for _ in range(count):
                iv = r.take(size)
                parts = []
                if flags & 2:
                    n = r.u(2)
                    if n > most_subsamples:
                        raise TooMany(f"{n} subsamples; at most {most_subsamples} are read")
                    parts = [(r.u(2), r.u(4)) for _ in range(n)]
                out.append((f"0x{iv.hex()}" if iv else "", parts))
        except TooMany as e:
            crowded = e  # unless another size fits
            continue
        except Malformed:
            continue
        if not r.left:
            return out
    raise crowded or Malformed("Unsupported size")


@box("senc", "SampleEncryptionBox")
def _senc(r):
    try:
        samples = sample_encryption(r.rest())
    except TooMany:
        raise
    except Malformed:
        return [("IV", "Unsupported size")]
    if not samples:
        return [("IV", "Constant")]
    return [("", Table(None, [[f"sample {k + 1} IV", iv], *[["subsample 🔓/🔒", f"{c}/{p}"] for c, p in parts]])) for k, (iv, parts) in enumerate(samples)]


@box("emsg", "EventMessageBox")
def _emsg(r):
    version, _ = r.full()
    if version == 0:
        scheme, value = r.z(), r.z()
        scale, time = r.u(4), ("presentation_time_delta", r.u(4))
        duration, ident = r.u(4), r.u(4)
    else:
        scale, time = r.u(4), ("presentation_time", r.u(8))
        duration, ident = r.u(4), r.u(4)
        scheme, value = r.z(), r.z()
    data = r.rest()
    frames = id3.frames(data) if scheme == id3.SCHEME else None
    message = text_of(data) if frames is None else Table(["id3 frame ID", "Value"], [list(f) for f in frames])
    return [("timescale", scale), time, ("event_duration", duration), ("id", ident), ("scheme_id_uri", scheme), ("value", value), ("message_data", message)]


@box("pssh", "ProtectionSystemSpecificHeaderBox")
def _pssh(r):
    header = drm.parse_pssh(r.rest())
    out = [("system_id", header["system_id"].hex()), ("system_ref", drm.system_name(header["system_id"]))]
    if header["key_ids"]:
        out.append(("key_ids", Table(None, [[k.hex()] for k in header["key_ids"]])))
    rows = drm.payload_rows(header)
    return [*out, ("pssh_data", Table(None, rows) if rows is not None else Hex(header["data"]))]


@box("pitm", "PrimaryItemBox")
def _pitm(r):
    version, _ = r.full()
    return [("item_id", r.u(4 if version else 2))]


@box("pixi", "PixelInformationProperty")
def _pixi(r):
    r.full()
    return [("bits_per_channel", many(r, r.u(1), lambda: r.u(1)))]


@box("iloc", "ItemLocationBox")
def _iloc(r):
    version, _ = r.full()
    offset_size, length_size, base_size, index_size = (r.bits(4) for _ in range(4))
    rows = []

    def one():
        item = r.u(4 if version == 2 else 2)
        method = r.u(2) & 15 if version else 0
        reference, base = r.u(2), r.u(base_size)
        extents = [f"({r.u(index_size) if version and index_size else 0},{r.u(offset_size)},{r.u(length_size)})" for _ in range(r.u(2))]
        rows.append([item, method, reference, base, ", ".join(extents)])

    many(r, r.u(4 if version == 2 else 2), one)
    return [("item_locations", Table(["item_id", "construction_method", "data_reference_index", "base_offset", "extents"], rows))]


@box("iinf", "ItemInfoBox")
def _iinf(r):
    version, _ = r.full()
    rows = []

    def one():
        size, _ = r.u(4), r.cc()
        e = Reader(r.take(size - 8))
        v, flags = e.full()
        item, protection = e.u(4 if v == 3 else 2), e.u(2)
        kind = e.cc() if v >= 2 else None
        name = e.z()
        mime = kind == "mime" or v < 2
        rows.append([item, protection, kind, name, e.z() if mime and e.left else None, e.z() if mime and e.left else None, bool(flags & 1)])

    many(r, r.u(4 if version else 2), one)
    return [("item_infos", Table(["item_id", "item_protection_index", "item_type", "item_name", "content_type", "content_encoding", "item_not_in_presentation"], rows))]


@box("ipma", "ItemPropertyAssociationBox")
def _ipma(r):
    version, flags = r.full()
    rows = []

    def one():
        item = r.u(4 if version else 2)
        wide = flags & 1
        pairs = [(r.bits(1), r.bits(15 if wide else 7)) for _ in range(r.u(1))]
        rows.append([item, ", ".join(f"{index}{' (essential)' if essential else ''}" for essential, index in pairs)])

    many(r, r.u(4), one)
    return [("item_properties", Table(["item_id", "associations"], rows))]


@box("iref", "ItemReferenceBox")
def _iref(r):
    version, _ = r.full()
    w, rows = (4 if version else 2), []
    while r.left >= 8:
        r.u(4)
        rows.append([r.cc(), r.u(w), ", ".join(str(r.u(w)) for _ in range(r.u(2)))])
    return [("references", Table(["reference_type", "from_item_id", "to_item_ids"], rows))]


@box("cmpd", "ComponentDefinitionBox")
def _cmpd(r):
    def one():
        kind = r.u(2)
        return [kind, r.z() if kind >= 0x8000 else None]

    return [("components", Table(["type", "type_uri"], many(r, r.u(4), one)))]


@box("uncC", "UncompressedFrameConfigBox")
def _uncc(r):
    version, _ = r.full()
    profile = r.cc()
    if version == 1:
        return [("profile", profile)]
    parts = Table(["index", "bit_depth_minus_one", "format", "align_size"], many(r, r.u(4), lambda: [r.u(2), r.u(1), r.u(1), r.u(1)]))
    out = [("profile", profile), ("components", parts), ("sampling_type", r.u(1)), ("interleave_type", r.u(1)), ("block_size", r.u(1))]
    out += [(k, bool(r.bits(1))) for k in ("components_little_endian", "block_pad_lsb", "block_little_endian", "block_reversed", "pad_unknown")]
    r.bits(3)
    return out + [(k, r.u(4)) for k in ("pixel_size", "row_align_size", "tile_align_size", "num_tile_cols_minus_one", "num_tile_rows_minus_one")]


@box("tx3g", "3GPP Timed Text")
def _tx3g(r):
    r.take(6)
    out = [("data_reference_index", r.u(2)), ("display_flags", r.u(4)), ("horizontal_justification", r.i(1)), ("vertical_justification", r.i(1))]
    out.append(("bg_color_rgba", "r:{},g:{},b:{},a:{}".format(*r.take(4))))
    return [*out, ("box_record", [r.i(2) for _ in range(4)]), ("style_record", list(r.take(12)))]


def _metadata(key: str, as_text: bool):
    def decode(r: Reader) -> Fields:
        while r.left >= 16:
            size, kind = r.u(4), r.cc()
            body = r.take(size - 8)
            if kind == "data":
                return [(key, text_of(body[8:]) if as_text else body[8:])]
        return [(key, None)]

    return decode


for _cc, _key, _name, _text in (("covr", "covr", "Covr", False), ("desc", "desc", "Desc", True), ("©nam", "name", "Name", True), ("name", "name", "Name", True), ("©day", "year", "Year", True), ("year", "year", "Year", True)):
    box(_cc, f"{_name} MetadataItem")(_metadata(_key, _text))


@box("uuid", "UserTypeBox")
def _uuid(r):
    return [("user_type", str(uuid.UUID(bytes=r.take(16)))), ("data", r.rest())]


def describe(fourcc: str, body: bytes) -> tuple[str, Fields]:
    """The name and fields of a leaf box; a box without layout has only the size of its data."""
    return described(fourcc, Reader(body))


def described(fourcc: str, r: Reader) -> tuple[str, Fields]:
    if fourcc in FIXED:
        name, layout = FIXED[fourcc]
        return name, read_layout(layout, r)
    if fourcc in VARIABLE:
        name, decode = VARIABLE[fourcc]
        return name, decode(r)
    return "Unknown (unhandled box parsing)", [("data", r.rest())]
