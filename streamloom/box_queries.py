"""Queries over media boxes: every layout is built from the columns of ``part``, read back, and compared property by property.

A case is a box: its FourCC and name, its body, and the properties that must come out. A body is a text of items parted by
spaces: ``expr:size`` (a number as big-endian bytes), ``#hex``, ``'text'``, or ``n`` (the part's name). A property's value is
an SQL expression. Both sorts of expression see ``k`` (the part's key), ``s`` (its size, 1 to 50) and ``n``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.operators import box_fields, boxes
from streamloom.plans.synth import be, dealt, table
from streamloom.registry import query

P_SQL = "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, coalesce(p_name, '') AS n FROM part"


class Case(NamedTuple):
    fourcc: str
    name: str
    body: str
    want: dict[str, str] | list[tuple[str, str]]


def items(body: str) -> list[str]:
    return re.findall(r"'[^']*'|\S+", body)


def content(body: str) -> Column:
    def one(item: str) -> Column:
        if item[0] == "#":
            return F.unhex(F.lit(item[1:]))
        if item[0] == "'":
            return F.encode(F.lit(item[1:-1]), "UTF-8")
        if item == "n":
            return F.encode("n", "UTF-8")
        expr, size = item.rsplit(":", 1)
        return be(F.expr(expr), int(size))

    parts = [one(i) for i in items(body)]
    return F.concat(*parts) if parts else F.unhex(F.lit(""))


def fixed_size(body: str) -> int:
    """The number of bytes of a body, without names."""
    return sum(0 if i == "n" else len(i[1:]) // 2 if i[0] == "#" else len(i) - 2 if i[0] == "'" else int(i.rsplit(":", 1)[1]) for i in items(body))


def size_sql(body: str) -> str:
    return f"{fixed_size(body)} + {items(body).count('n')} * octet_length(encode(n))"


def box(fourcc: str, body: Column) -> Column:
    return F.concat(be(F.length(body) + 8, 4), F.encode(F.lit(fourcc), "ISO-8859-1"), body)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle(cases: list[Case]) -> str:
    rows = []
    for k, c in enumerate(cases):
        want = [("size", f"8 + {size_sql(c.body)}"), *(c.want.items() if isinstance(c.want, dict) else c.want)]
        rows += [f"struct_pack(box_index := CAST({k} AS INTEGER), fourcc := {text(c.fourcc)}, box_name := {text(c.name)}, ordinal := CAST({o} AS INTEGER), key := {text(key)}, value := CAST({v} AS VARCHAR))" for o, (key, v) in enumerate(want)]
    return f"WITH p AS ({P_SQL}) SELECT k AS p_partkey, unnest([{', '.join(rows)}], recursive := true) FROM p"


def shown(rows: DataFrame) -> DataFrame:
    """Tables as text: headers, ``=``, rows parted by ``;`` and cells by ``|``."""
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    whole = F.concat(F.coalesce(F.array_join("headers", "|"), F.lit("")), F.lit("="), lines)
    return rows.withColumn("value", F.coalesce(F.col("value"), whole))


def parts(spark, sf_dir: str) -> DataFrame:
    """What the expressions of a case see, dealt over tasks."""
    return dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"), F.coalesce("p_name", F.lit("")).alias("n")), "k")


def properties(spark, sf_dir: str, cases: list[Case]) -> DataFrame:
    p = parts(spark, sf_dir)
    files = p.select("k", F.concat(*(box(c.fourcc, content(c.body)) for c in cases)).alias("content"))
    rows = shown(boxes.box_properties(files, id_col="k"))
    return rows.select(F.col("media_id").cast("bigint").alias("p_partkey"), "box_index", "fourcc", "box_name", "ordinal", "key", F.coalesce("value", "error").alias("value"))


IDENTITY = "#00010000 #0000000000000000 #00000000 #00010000 #0000000000000000 #00000000 #40000000"
MATRIX = "'=1|0|0;0|1|0;0|0|1'"

MOVIE = [
    Case("ftyp", "FileTypeBox", "'isom' s:4 'isomiso5'", {"major_brand": "'isom'", "minor_version": "s", "compatible_brands": "'isom, iso5'"}),
    Case("styp", "SegmentTypeBox", "'msdh' k:4", {"major_brand": "'msdh'", "minor_version": "k", "compatible_brands": "''"}),
    Case("mvhd", "MovieHeaderBox", f"#00000000 k:4 k+1:4 s*1000:4 k*2:4 #00018000 #0080 #0000 #0000000000000000 {IDENTITY} #{'00' * 24} s:4", {"creation_time": "k", "modification_time": "k + 1", "timescale": "s * 1000", "duration": "k * 2", "rate": "'1.5'", "volume": "'0.5'", "matrix": MATRIX, "next_track_id": "s"}),
    Case("mvhd", "MovieHeaderBox", f"#01000000 k:8 k+1:8 s*1000:4 k*5000000000:8 #00010000 #0100 #0000 #0000000000000000 {IDENTITY} #{'00' * 24} s:4", {"creation_time": "k", "modification_time": "k + 1", "timescale": "s * 1000", "duration": "k * 5000000000", "rate": "'1'", "volume": "'1'", "matrix": MATRIX, "next_track_id": "s"}),
    Case("tkhd", "TrackHeaderBox", f"#00000003 k:4 k+1:4 s:4 #00000000 k*2:4 #0000000000000000 65536-s:2 s%2:2 #0100 #0000 {IDENTITY} s*65536:4 s*65536+32768:4", {"creation_time": "k", "modification_time": "k + 1", "track_id": "s", "duration": "k * 2", "layer": "-s", "alternate_group": "s % 2", "enabled": "true", "volume": "'1'", "matrix": MATRIX, "width": "s", "height": "s || '.5'"}),
    Case("tkhd", "TrackHeaderBox", f"#01000002 k:8 k+1:8 s:4 #00000000 k*2:8 #0000000000000000 0:2 0:2 #0000 #0000 {IDENTITY} 0:4 0:4", {"creation_time": "k", "modification_time": "k + 1", "track_id": "s", "duration": "k * 2", "layer": "0", "alternate_group": "0", "enabled": "false", "volume": "'0'", "matrix": MATRIX, "width": "0", "height": "0"}),
    Case("mdhd", "MediaHeaderBox", "#00000000 k:4 k+1:4 s:4 k*2:4 #55C4 #0000", {"creation_time": "k", "modification_time": "k + 1", "timescale": "s", "duration": "k * 2", "language": "'und'"}),
    Case("mdhd", "MediaHeaderBox", "#01000000 k:8 k+1:8 s:4 k*3:8 #15C7 #0000", {"creation_time": "k", "modification_time": "k + 1", "timescale": "s", "duration": "k * 3", "language": "'eng'"}),
    Case("mehd", "MovieExtendsHeaderBox", "#00000000 k:4", {"fragment_duration": "k"}),
    Case("mehd", "MovieExtendsHeaderBox", "#01000000 k*5000000000:8", {"fragment_duration": "k * 5000000000"}),
    Case("mfhd", "MovieFragmentHeaderBox", "#00000000 k:4", {"sequence_number": "k"}),
    Case("hdlr", "HandlerBox", "#00000000 #00000000 'soun' #000000000000000000000000 n #00", {"handler": "'soun'", "name": "n"}),
    Case("vmhd", "VideoMediaHeaderBox", "#00000001 s:2 k%256:2 1:2 2:2", {"graphics_mode": "s", "op_color": "'r:' || k % 256 || ', g:1, b:2'"}),
    Case("smhd", "SoundMediaHeaderBox", "#00000000 s*256:2 #0000", {"balance": "s"}),
    Case("trex", "TrackExtendsBox", "#00000000 s:4 1:4 k:4 k+1:4 k+2:4", {"track_id": "s", "default_sample_description_index": "1", "default_sample_duration": "k", "default_sample_size": "k + 1", "default_sample_flags": "k + 2"}),
    Case("dref", "DataReferenceBox", "#00000000 2:4 12:4 'url ' #00000001 20:4 'url ' #00000000 'http:/' #6100", {"urls": "'=;http:/a'"}),
    Case("elst", "EditListBox", "#00000000 2:4 k:4 #FFFFFFFF 1:2 0:2 s:4 7:4 65535:2 3:2", {"entries": "'segment_duration|media_time|media_rate|media_rate_fraction=' || k || '|-1|1|0;' || s || '|7|-1|3'"}),
    Case("elst", "EditListBox", "#01000000 1:4 k*5000000000:8 s:8 1:2 0:2", {"entries": "'segment_duration|media_time|media_rate|media_rate_fraction=' || k * 5000000000 || '|' || s || '|1|0'"}),
    Case("btrt", "BitRateBox", "s:4 k:4 k*2:4", {"buffer_size_db": "s", "max_bitrate": "k", "avg_bitrate": "k * 2"}),
    Case("pasp", "PixelAspectRatioBox", "s:4 k:4", {"h_spacing": "s", "v_spacing": "k"}),
    Case("clap", "CleanApertureBox", "s:4 1:4 k:4 2:4 4294967296-s:4 3:4 s:4 4:4", {"clean_aperture_width_n": "s", "clean_aperture_width_d": "1", "clean_aperture_height_n": "k", "clean_aperture_height_d": "2", "horiz_off_n": "-s", "horiz_off_d": "3", "vert_off_n": "s", "vert_off_d": "4"}),
    Case("colr", "ColourInformationBox", "'nclx' s:2 k%65536:2 9:2 128:1", {"colour_type": "'nclx'", "colour_primaries": "s", "transfer_characteristics": "k % 65536", "matrix_coefficients": "9", "full_range_flag": "true"}),
    Case("colr", "ColourInformationBox", "'nclx' 1:2 2:2 3:2 129:1", {"colour_type": "'nclx'", "colour_primaries": "1", "transfer_characteristics": "2", "matrix_coefficients": "3", "full_range_flag": "false"}),
    Case("colr", "ColourInformationBox", "'rICC' s:1 #AB", {"colour_type": "'ricc'", "profile": "lpad(hex(s), 2, '0') || ' AB'"}),
    Case("colr", "ColourInformationBox", "'prof' #0102030405", {"colour_type": "'prof'", "profile": "'01 02 03 04  05'"}),
    Case("colr", "ColourInformationBox", "'nclc' s:2 1:2 2:2", {"colour_type": "'nclc'", "primaries_index": "s", "transfer_function_index": "1", "matrix_index": "2"}),
    Case("colr", "ColourInformationBox", "'else' #FF", {"colour_type": "'else'", "bytes": "'FF'"}),
    Case("frma", "OriginalFormatBox", "'avc1'", {"data_format": "'avc1'"}),
    Case("ccst", "CodingConstraintsBox", "#00000000 #B4000000", {"all_ref_pics_intra": "true", "intra_pred_used": "false", "max_ref_per_pic": "13"}),
    Case("free", "FreeSpaceBox", "n", {}),
    Case("skip", "FreeSpaceBox", "", {}),
    Case("zzzz", "Unknown (unhandled box parsing)", "s:4 n", {"data": "'Data<' || (4 + octet_length(encode(n))) || '>'"}),
]

SAMPLES = [
    Case("stts", "TimeToSampleBox", "#00000000 2:4 s:4 k:4 1:4 2:4", {"entries": "'count|delta=' || s || '|' || k || ';1|2'"}),
    Case("ctts", "CompositionOffsetBox", "#00000000 2:4 s:4 k:4 1:4 4294967295:4", {"entries": "'(count: ' || s || ', offset: ' || k || '), (count: 1, offset: 4294967295)'"}),
    Case("ctts", "CompositionOffsetBox", "#01000000 1:4 k:4 4294967296-s:4", {"entries": "'(count: ' || k || ', offset: -' || s || ')'"}),
    Case("stsc", "SampleToChunkBox", "#00000000 1:4 s:4 k:4 1:4", {"entries": "'first_chunk|samples_per_chunk|sample_description_index=' || s || '|' || k || '|1'"}),
    Case("stsz", "SampleSizeBox", "#00000000 s:4 k:4", {"sample_count": "k", "sample_size": "s"}),
    Case("stsz", "SampleSizeBox", "#00000000 0:4 3:4 s:4 k:4 9:4", {"sample_count": "3", "sample_sizes": "s || ', ' || k || ', 9'"}),
    Case("stco", "ChunkOffsetBox", "#00000000 2:4 k:4 s:4", {"entries": "k || ', ' || s"}),
    Case("co64", "ChunkLargeOffsetBox", "#00000000 2:4 k*5000000000:8 s:8", {"entries": "k * 5000000000 || ', ' || s"}),
    Case("stss", "SyncSampleBox", "#00000000 1:4 s:4", {"entries": "s"}),
    Case("saio", "SampleAuxiliaryInformationOffsetsBox", "#00000001 'cenc' s:4 2:4 k:4 k+1:4", {"aux_info_type": "'cenc'", "aux_info_type_parameter": "s", "offsets": "k || ', ' || (k + 1)"}),
    Case("saio", "SampleAuxiliaryInformationOffsetsBox", "#01000000 1:4 k*5000000000:8", {"aux_info_type": "NULL", "aux_info_type_parameter": "NULL", "offsets": "k * 5000000000"}),
    Case("saiz", "SampleAuxiliaryInformationSizesBox", "#00000000 0:1 2:4 s:1 8:1", {"aux_info_type": "NULL", "aux_info_type_parameter": "NULL", "default_sample_info_size": "0", "sample_count": "2", "sample_info_size": "s || ', 8'"}),
    Case("saiz", "SampleAuxiliaryInformationSizesBox", "#00000001 'cbcs' k:4 16:1 s:4", {"aux_info_type": "'cbcs'", "aux_info_type_parameter": "k", "default_sample_info_size": "16", "sample_count": "s", "sample_info_size": "''"}),
    Case("sbgp", "SampleToGroupBox", "#00000000 'roll' 1:4 s:4 k:4", {"grouping_type": "'roll'", "grouping_type_parameter": "NULL", "entries": "'sample_count|group_description_index=' || s || '|' || k"}),
    Case("sbgp", "SampleToGroupBox", "#01000000 'seig' k:4 2:4 s:4 1:4 3:4 0:4", {"grouping_type": "'seig'", "grouping_type_parameter": "k", "entries": "'sample_count|group_description_index=' || s || '|1;3|0'"}),
    Case("sgpd", "SampleGroupDescriptionBox", "#01000000 'roll' 2:4 2:4 s:2 #BEEF", {"grouping_type": "'roll'", "default_length": "2", "default_group_description_index": "NULL", "static_group_description": "false", "static_mapping": "false", "essential": "false", "entries": "'description_length|4CC|data=|roll|00 ' || lpad(hex(s), 2, '0') || ';|roll|BE EF'"}),
    Case("sgpd", "SampleGroupDescriptionBox", "#02000005 'seig' 0:4 s:4 1:4 3:4 #010203", {"grouping_type": "'seig'", "default_length": "0", "default_group_description_index": "s", "static_group_description": "true", "static_mapping": "false", "essential": "true", "entries": "'description_length|4CC|data=3|seig|01 02 03'"}),
    Case("subs", "SubSampleInformationBox", "#00000000 1:4 s:4 2:2 k%65536:2 1:1 1:1 #00000001 7:2 0:1 0:1 #0A0B0C0D", {"flags": "'00 00 00'", "entries": "'sample_delta|size|priority|discardable|params=' || s || '|' || k % 65536 || '|1|true|00 00 00 01|' || s || '|7|0|false|0A 0B 0C 0D'"}),
    Case("subs", "SubSampleInformationBox", "#01000002 1:4 3:4 1:2 k:4 s:1 0:1 #00000000", {"flags": "'00 00 02'", "entries": "'sample_delta|size|priority|discardable|params=3|' || k || '|' || s || '|false|00 00 00 00'"}),
]

KID = "lower(lpad(hex(k), 32, '0'))"
LOCKS = "subsample 🔓/🔒"
FRAGMENTS = [
    Case("tfhd", "TrackFragmentHeaderBox", "#0000003B s:4 k*5000000000:8 1:4 k:4 k+1:4 k+2:4", {"track_id": "s", "base_data_offset": "k * 5000000000", "sample_description_index": "1", "default_sample_duration": "k", "default_sample_size": "k + 1", "default_sample_flags": "k + 2"}),
    Case("tfhd", "TrackFragmentHeaderBox", "#00020010 s:4 k:4", {"track_id": "s", "base_data_offset": "NULL", "sample_description_index": "NULL", "default_sample_duration": "NULL", "default_sample_size": "k", "default_sample_flags": "NULL"}),
    Case("tfdt", "TrackFragmentBaseMediaDecodeTimeBox", "#00000000 k:4", {"base_media_decode_time": "k"}),
    Case("tfdt", "TrackFragmentBaseMediaDecodeTimeBox", "#01000000 k*5000000000:8", {"base_media_decode_time": "k * 5000000000"}),
    Case("trun", "TrackRunBox", "#00000305 2:4 #FFFFFFFF #02000000 s:4 k:4 1:4 2:4", {"data_offset": "-1", "sample_count": "2", "entries": "'#|duration|size|flags|cts=1|' || s || '|' || k || '|02 00 00 00|;2|1|2||'"}),
    Case("trun", "TrackRunBox", "#01000F00 1:4 s:4 k:4 #0101FFFF 4294967296-s:4", {"data_offset": "NULL", "sample_count": "1", "entries": "'#|duration|size|flags|cts=1|' || s || '|' || k || '|01 01 FF FF|-' || s"}),
    Case("prft", "ProducerReferenceTimeBox", "#00000000 s:4 k:8 k+1:4", {"reference_track_id": "s", "ntp_timestamp": "k", "media_time": "k + 1", "ntp_timestamp_media_time_association": text(box_fields.PRFT_TIMES[0])}),
    Case("prft", "ProducerReferenceTimeBox", "#01000018 s:4 k:8 k*5000000000:8", {"reference_track_id": "s", "ntp_timestamp": "k", "media_time": "k * 5000000000", "ntp_timestamp_media_time_association": text(box_fields.PRFT_TIMES[24])}),
    Case("prft", "ProducerReferenceTimeBox", "#01000003 s:4 k:8 1:8", {"reference_track_id": "s", "ntp_timestamp": "k", "media_time": "1", "ntp_timestamp_media_time_association": text(box_fields.PRFT_UNKNOWN)}),
    Case("emsg", "EventMessageBox", "#00000000 'urn:x' #00 'v' #00 s:4 k:4 1:4 k:4 n", {"timescale": "s", "presentation_time_delta": "k", "event_duration": "1", "id": "k", "scheme_id_uri": "'urn:x'", "value": "'v'", "message_data": "n"}),
    Case("emsg", "EventMessageBox", "#01000000 s:4 k*5000000000:8 1:4 k:4 'https://aomedia.org/emsg/ID3' #0000 'ID3' #040000 #0000001A 'TIT2' #00000006 #0000 #03 'hello' 'TPE1' #00000000 #0000", {"timescale": "s", "presentation_time": "k * 5000000000", "event_duration": "1", "id": "k", "scheme_id_uri": "'https://aomedia.org/emsg/ID3'", "value": "''", "message_data": "'id3 frame ID|Value=TIT2|hello;TPE1|'"}),
    Case("emsg", "EventMessageBox", "#01000000 s:4 k:8 1:4 k:4 'https://aomedia.org/emsg/ID3' #0000 'no tag'", {"timescale": "s", "presentation_time": "k", "event_duration": "1", "id": "k", "scheme_id_uri": "'https://aomedia.org/emsg/ID3'", "value": "''", "message_data": "'no tag'"}),
    Case("senc", "SampleEncryptionBox", "#00000000 2:4 k:8 s:8", [("", "'=sample 1 IV|0x' || lower(lpad(hex(k), 16, '0'))"), ("", "'=sample 2 IV|0x' || lower(lpad(hex(s), 16, '0'))")]),
    Case("senc", "SampleEncryptionBox", "#00000002 1:4 k:8 1:2 s:2 k:4", {"": f"'=sample 1 IV|0x' || lower(lpad(hex(k), 16, '0')) || ';{LOCKS}|' || s || '/' || k"}),
    Case("senc", "SampleEncryptionBox", "#00000000 0:4", {"IV": "'Constant'"}),
    Case("senc", "SampleEncryptionBox", "#00000000 1:4 #010203", {"IV": "'Unsupported size'"}),
    Case("tenc", "TrackEncryptionBox", "#00000000 #0000 1:1 8:1 k:16", {"default_isProtected": "'1 (Protected)'", "default_Per_Sample_IV_Size": "'8 (64-bit)'", "default_KID": KID}),
    Case("tenc", "TrackEncryptionBox", "#01000000 #0019 1:1 0:1 k:16 8:1 s:8", {"default_isProtected": "'1 (Protected)'", "default_Per_Sample_IV_Size": "'0 (Constant IV)'", "default_KID": KID, "default_constant_IV_size": "'8 (64-bit)'", "default_constant_IV": "lower(lpad(hex(s), 16, '0'))", "default_crypt_byte_block": "1", "default_skip_byte_block": "9"}),
    Case("tenc", "TrackEncryptionBox", "#00000000 #0000 0:1 0:1 k:16", {"default_isProtected": "'0 (Not protected)'", "default_Per_Sample_IV_Size": "'0 (Not protected)'", "default_KID": KID}),
    Case("schm", "SchemeTypeBox", "#00000001 'cbcs' s:4 n #00", {"scheme_type": "'cbcs'", "scheme_version": "s", "scheme_uri": "n"}),
    Case("schm", "SchemeTypeBox", "#00000000 'cenc' 65536:4", {"scheme_type": "'cenc'", "scheme_version": "65536", "scheme_uri": "NULL"}),
    Case("pssh", "ProtectionSystemSpecificHeaderBox", "#01000000 #1077EFECC0B24D02ACE33C1E52E2FB4B 2:4 k:16 s:16 0:4", {"system_id": "'1077efecc0b24d02ace33c1e52e2fb4b'", "system_ref": "'W3C Common PSSH box'", "key_ids": f"'=' || {KID} || ';' || lower(lpad(hex(s), 32, '0'))", "pssh_data": "''"}),
    Case("pssh", "ProtectionSystemSpecificHeaderBox", "#00000000 'no system at all' 3:4 #0A0B s:1", {"system_id": "'6e6f2073797374656d20617420616c6c'", "system_ref": "'no system at all'", "pssh_data": "'0A 0B ' || lpad(hex(s), 2, '0')"}),
]

NALS = "#01 #A0 1:2 2:2 #ABCD"
NAL_ROWS = "'completeness|nal_unit_type|nalus=true|32|AB CD'"
HEVC = f"#0122600000009000000000 #00 s:1 #F00F #FD #FE #F8 #FA k%65536:2 #57 {NALS}"
HEVC_WANT = {
    "configuration_version": "1", "general_profile_space": "0", "general_tier_flag": "true", "general_profile_idc": "2", "general_profile_compatibility_flags": "'96, 0, 0, 0'", "general_constraint_indicator_flags": "'144, 0, 0, 0, 0, 0'", "general_level_idc": "s",
    "min_spatial_segmentation_idc": "15", "parallelism_type": "1", "chroma_format_idc": "2", "bit_depth_luma_minus8": "0", "bit_depth_chroma_minus8": "2", "avg_frame_rate": "k % 65536", "constant_frame_rate": "1", "num_temporal_layers": "2", "temporal_id_nested": "true", "length_size_minus_one": "3", "arrays": NAL_ROWS,
}
DOLBY = {"dv_version_major": "1", "dv_version_minor": "0", "dv_profile": "s", "dv_level": "k % 64", "rpu_present_flag": "true", "el_present_flag": "s % 2 = 1", "bl_present_flag": "false", "dv_bl_signal_compatibility_id": "s % 16", "dv_md_compression": "2"}
DOLBY_BODY = f"#0100 s*512+k%64*8+4+s%2*2:2 s%16*16+8:1 #{'00' * 19}"


def bits(digits: str) -> str:
    """Binary digits, filled up to whole bytes, as hex."""
    digits = digits.replace(" ", "")
    digits += "0" * (-len(digits) % 8)
    return f"#{int(digits, 2):0{len(digits) // 4}X}"


# Two published examples of the box, with one and with two presentations.
AC4_ONE = "#20A601400000001FFFFFFFE0010FF98000004800008E501000008F0080"
AC4_TWO = "#20A602400000001FFFFFFFE0020FF880000042000002501000000308C0010FF88000004200000250100000030080"
AC4_HEAD = {"ac4_dsi_version": "1", "bitstream_version": "2", "fs_index": "1", "frame_rate_index": "3", "bit_rate_mode": "'average (2)'", "bit_rate": "0", "bit_rate_precision": "4294967295"}


def ac4_rows(version: int, compat: int, mode: int, mask: str, virtual: str, last: str) -> str:
    mask = f"00000000 00000000 {mask}"
    return text(f"=version|{version};config|31;md_compat|{compat};id|0;dsi_frame_rate_multiply_info|0;dsi_frame_rate_fraction_info|0;emdf_version|0;key_id|0;channel_coded|true;ch_mode|{mode};channel_mask|{mask};core_differs|false;presentation_filter|false;substream_groups|g.len() == 1;g[0] hsf_ext|false;g[0] channel_coded|true;g[0] substreams|s.len() == 1;g[0]s[0] sf_multiplier|0;g[0]s[0] channel_mask|{mask};g[0] content_classifier|complete main (0);pre_virtualized|{virtual};dialogue_enancement|true;{last}")


#: A presentation of version 0: two groups, the first of objects, with a language and EMDF substreams.
AC4_OBJECTS = bits(
    "00101 010 1 00111 01 00001 0000000101 000000000000000000000011 1 000"  # configuration to the number of groups
    "1 0 0 00000001 10 1 00011 1 0 0011 000100 1 0 1 0 1 010 1 000010 01100101 01101110"  # a group of objects
    "1 0 1 00000000 0"  # an empty group of channels
    "1 1 0000001 00010 0000000011"  # pre-virtualized, EMDF
)
AC4_OBJECT_ROWS = text("=version|0;config|5;md_compat|2;id|7;dsi_frame_rate_multiply_info|1;emdf_version|1;key_id|5;channel_mask|00000000 00000000 00000011;hsf_ext|true;substream_groups|g.len() == 2;g[0] hsf_ext|false;g[0] channel_coded|false;g[0] substreams|s.len() == 1;g[0]s[0] sf_multiplier|2;g[0]s[0] bitrate_indicator|3;g[0]s[0] n_dmx_objects|4;g[0]s[0] n_umx_objects|5;g[0]s[0] contains_bed_objects|true;g[0]s[0] contains_dynamic_objects|false;g[0]s[0] contains_isf_objects|true;g[0] content_classifier|visually impaired (2);g[0] language_tag|en;g[1] hsf_ext|false;g[1] channel_coded|true;pre_virtualized|true;emdf_substreams|;[0] version|2;[0] key_id|3")
CODECS = [
    Case("avcC", "AVCConfigurationBox", "#016400 s:1 #FFE1 3:2 #AABBCC #01 2:2 #DDEE #FDF9FA00", {"configuration_version": "1", "avc_profile_indication": "100", "profile_compatibility": "0", "avc_level_indication": "s", "length_size": "4", "sequence_parameter_sets": "'=AA BB CC'", "picture_parameter_sets": "'=DD EE'", "ext_chroma_format": "1", "ext_bit_depth_luma": "9", "ext_bit_depth_chroma": "10", "ext_sequence_parameter_sets": "'='"}),
    Case("avcC", "AVCConfigurationBox", "#0142C0 s:1 #FDE0 #00", {"configuration_version": "1", "avc_profile_indication": "66", "profile_compatibility": "192", "avc_level_indication": "s", "length_size": "2", "sequence_parameter_sets": "'='", "picture_parameter_sets": "'='", "ext_chroma_format": "NULL", "ext_bit_depth_luma": "NULL", "ext_bit_depth_chroma": "NULL", "ext_sequence_parameter_sets": "NULL"}),
    Case("hvcC", "HEVCConfigurationBox", HEVC, HEVC_WANT),
    Case("hvcE", "DolbyVisionELHEVCConfigurationBox", HEVC, HEVC_WANT),
    Case("lhvC", "LayeredHEVCConfigurationBox", f"#01 #F00F #FE #CF {NALS}", {"configuration_version": "1", "min_spatial_segmentation_idc": "15", "parallelism_type": "2", "num_temporal_layers": "1", "temporal_id_nested": "true", "length_size_minus_one": "3", "arrays": NAL_ROWS}),
    Case("av1C", "AV1CodecConfigurationBox", "#81 #28 #CE #14 #0A s:1", {"seq_profile": "1", "seq_level_idx_0": "8", "seq_tier_0": "true", "high_bitdepth": "true", "twelve_bit": "false", "monochrome": "false", "chroma_subsampling_x": "true", "chroma_subsampling_y": "true", "chroma_sample_position": "2", "initial_presentation_delay": "5", "config_obus": "'0A ' || lpad(hex(s), 2, '0')"}),
    Case("vpcC", "VPCodecConfigurationBox", "#01000000 s:1 31:1 #A3 9:1 16:1 9:1 2:2 #0102", {"profile": "s", "level": "31", "bit_depth": "10", "chroma_subsampling": "1", "video_full_range_flag": "true", "color_primaries": "9", "transfer_characteristics": "16", "matrix_coefficients": "9", "codec_initialization_data": "'01 02'"}),
    Case("esds", "ElementaryStreamDescriptorBox", "#00000000 #0319 s:2 #00 #0411 #40 #15 k:3 k*2:4 k*3:4 #0502 #1210 #060102", {"es_id": "s", "decoder_config_object_type_indication": "64", "decoder_config_stream_type": "5", "decoder_config_up_stream": "false", "decoder_config_buffer_size_db": "k", "decoder_config_max_bitrate": "k * 2", "decoder_config_avg_bitrate": "k * 3", "decoder_specific_profile": "2", "decoder_specific_freq_index": "4", "decoder_specific_chan_conf": "2"}),
    Case("dOps", "OpusSpecificBox", "#00 2:1 312:2 48000:4 65536-s:2 #00", {"output_channel_count": "2", "pre_skip": "312", "input_sample_rate": "48000", "output_gain": "-s"}),
    Case("dac3", "AC3SpecificBox", "#103DC0", {"fscod": "0", "bsid": "8", "bsmod": "0", "acmod": "7", "lfeon": "1", "bit_rate": "384"}),
    Case("dec3", "EC3SpecificBox", "s*8+1:2 #200F00 #200F0203", {"data_rate": "s", "independent_substream #0": "'=fscod|0;bsid|16;asvc|false;bsmod|0;acmod|7;lfeon|true;num_dep_sub|0'", "independent_substream #1": "'=fscod|0;bsid|16;asvc|false;bsmod|0;acmod|7;lfeon|true;num_dep_sub|1;chan_loc|000000011 (Lc/Rc + Lrs/Rrs)'"}),
    Case("dac4", "AC4SpecificBox", "#20A600 274877906944+k*32+31:5 #FFFFFFE0", {"ac4_dsi_version": "1", "bitstream_version": "2", "fs_index": "1", "frame_rate_index": "3", "bit_rate_mode": "'average (2)'", "bit_rate": "k", "bit_rate_precision": "4294967295"}),
    Case("dac4", "AC4SpecificBox", AC4_ONE, AC4_HEAD | {"presentation #1": ac4_rows(1, 1, 4, "01000111", "false", "immersive_audio|false")}),
    Case("dac4", "AC4SpecificBox", AC4_TWO, AC4_HEAD | {"presentation #1": ac4_rows(2, 0, 1, "00000001", "true", "dolby_atmos|true"), "presentation #2": ac4_rows(1, 0, 1, "00000001", "false", "immersive_audio|false")}),
    Case("dac4", "AC4SpecificBox", f"{bits('001 0000001 0 0010 000000001')} 549755813888+k*64+63:5 #FFFFFFC0 #00 {len(AC4_OBJECTS) // 2}:1 {AC4_OBJECTS}", {"ac4_dsi_version": "1", "bitstream_version": "1", "fs_index": "0", "frame_rate_index": "2", "bit_rate_mode": "'average (2)'", "bit_rate": "k", "bit_rate_precision": "4294967295", "presentation #1": AC4_OBJECT_ROWS}),
    Case("lac4", "AC4PresentationLabelBox", "#00000000 2:2 'en' #00 s:2 n #00 7:2 'b' #00", {"language_tag": "'en'", "labels": "'id|label=' || s || '|' || n || ';7|b'"}),
    Case("dvcC", "DOVIDecoderConfigurationRecord", DOLBY_BODY, DOLBY),
    Case("dvvC", "DOVIDecoderConfigurationRecord", DOLBY_BODY, DOLBY),
    Case("dvwC", "DOVIDecoderConfigurationRecord", DOLBY_BODY, DOLBY),
]

SPATIAL = [
    Case("blin", "StereoCameraSystemBaselineBox", "#00000000 k:4", {"baseline_value": "k"}),
    Case("corg", "CameraSystemOriginSourceBox", "#00000000 'blin'", {"source_of_origin": "'blin'"}),
    Case("dadj", "StereoComfortDisparityAdjustmentBox", "#00000000 4294967296-s:4", {"disparity_adjustment": "-s"}),
    Case("equi", "FullEquirectangularProjectionBox", "#00000000", {}),
    Case("fish", "FisheyeProjectionBox", "#00000000", {}),
    Case("hequ", "HalfEquirectangularProjectionBox", "#00000000", {}),
    Case("prim", "ParametricImmersiveMediaProjectionBox", "#00000000", {}),
    Case("rect", "RectilinearProjectionBox", "#00000000", {}),
    Case("hero", "HeroStereoEyeDescriptionBox", "#00000000 s%4:1", {"hero_eye_indicator": "s % 4", "description": "['none', 'left', 'right', 'reserved'][s % 4 + 1]"}),
    Case("hfov", "HorizontalFieldOfViewBox", "k:4", {"field_of_view": "k"}),
    Case("lnhd", "CameraSystemLensHeaderBox", "#00000000 s:4 'ksm1' 'colr' 'left'", {"lens_identifier": "s", "lens_algorithm_kind": "'ksm1'", "lens_domain": "'colr'", "lens_role": "'left'"}),
    Case("lnin", "CameraSystemLensIntrinsicsBox", "#00000000 s:2 65535:2 k:4 4294967295-k:4 1:4", {"denominator_shift_operand": "s", "skew_denominator_shift_operand": "-1", "focal_length_x": "k", "principal_point_x": "-k - 1", "principal_point_y": "1"}),
    Case("lnin", "CameraSystemLensIntrinsicsBox", "#00000003 s:2 0:2 k:4 2:4 3:4 k+1:4 4294967295:4 #3F000000", {"denominator_shift_operand": "s", "skew_denominator_shift_operand": "0", "focal_length_x": "k", "principal_point_x": "2", "principal_point_y": "3", "focal_length_y": "k + 1", "skew_factor": "-1", "projection_offset": "'0.5'"}),
    Case("ldst", "CameraSystemLensDistortionsBox", "#00000000 #3F800000 #3DCCCCCD #C0200000 #00000000", {"k1": "'1'", "k2": "'0.1'", "p1": "'-2.5'", "p2": "'0'"}),
    Case("ldst", "CameraSystemLensDistortionsBox", "#00000001 #3F800000 #3F800000 #3F800000 #3F800000 #42B40000", {"k1": "'1'", "k2": "'1'", "p1": "'1'", "p2": "'1'", "calibration_limit_radial_angle": "'90'"}),
    Case("lfad", "CameraSystemLensFrameAdjustmentBox", "#00000000 #3F800000 #3DCCCCCD #C0200000 #00000000 #40400000 #BF800000", {"polynomial_parameters_x": "'[1, 0.1, -2.5]'", "polynomial_parameters_y": "'[0, 3, -1]'"}),
    Case("uqua", "CameraSystemUnitQuaternionTransformBox", "#00000000 #3F800000 #00000000 #BF000000", {"xyz": "'[1, 0, -0.5]'"}),
    Case("must", "RequiredBoxTypesBox", "#00000000 'eyes' 'proj'", {"required_box_types": "'eyes, proj'"}),
    Case("pkin", "ViewPackingInformationBox", "#00000000 'side'", {"view_packing_kind": "'side'"}),
    Case("prji", "ProjectionInformationBox", "#00000000 'hequ'", {"projection_kind": "'hequ'"}),
    Case("rdim", "CameraSystemLensReferenceDimensionsBox", "#00000000 s:4 k:4", {"reference_width": "s", "reference_height": "k"}),
    Case("stri", "StereoViewInformationBox", "#00000000 s%16:1", {"eye_views_reversed": "s % 16 >= 8", "has_additional_views": "s % 8 >= 4", "has_right_eye_view": "s % 4 >= 2", "has_left_eye_view": "s % 2 = 1"}),
]

ITEMS = [
    Case("pitm", "PrimaryItemBox", "#00000000 s:2", {"item_id": "s"}),
    Case("pitm", "PrimaryItemBox", "#01000000 k:4", {"item_id": "k"}),
    Case("pixi", "PixelInformationProperty", "#00000000 3:1 s:1 8:1 10:1", {"bits_per_channel": "s || ', 8, 10'"}),
    Case("iloc", "ItemLocationBox", "#00000000 #4440 1:2 s:2 0:2 k:4 2:2 1:4 2:4 k:4 4:4", {"item_locations": "'item_id|construction_method|data_reference_index|base_offset|extents=' || s || '|0|0|' || k || '|(0,1,2), (0,' || k || ',4)'"}),
    Case("iloc", "ItemLocationBox", "#01000000 #4404 1:2 s:2 #0001 5:2 1:2 9:4 k:4 7:4", {"item_locations": "'item_id|construction_method|data_reference_index|base_offset|extents=' || s || '|1|5|0|(9,' || k || ',7)'"}),
    Case("iloc", "ItemLocationBox", "#02000000 #8800 1:4 k:4 #0002 0:2 1:2 k*5000000000:8 s:8", {"item_locations": "'item_id|construction_method|data_reference_index|base_offset|extents=' || k || '|2|0|0|(0,' || k * 5000000000 || ',' || s || ')'"}),
    Case("iinf", "ItemInfoBox", "#00000000 2:2 22:4 'infe' #02000001 s:2 1:2 'hvc1' #6100 35:4 'infe' #02000000 2:2 0:2 'mime' 'b' #00 'text/plain' #00 #6700", {"item_infos": "'item_id|item_protection_index|item_type|item_name|content_type|content_encoding|item_not_in_presentation=' || s || '|1|hvc1|a|||true;2|0|mime|b|text/plain|g|false'"}),
    Case("ipma", "ItemPropertyAssociationBox", "#00000000 1:4 s:2 2:1 #81 #02", {"item_properties": "'item_id|associations=' || s || '|1 (essential), 2'"}),
    Case("ipma", "ItemPropertyAssociationBox", "#01000001 1:4 k:4 1:1 #8105", {"item_properties": "'item_id|associations=' || k || '|261 (essential)'"}),
    Case("iref", "ItemReferenceBox", "#00000000 16:4 'dimg' s:2 2:2 3:2 4:2", {"references": "'reference_type|from_item_id|to_item_ids=dimg|' || s || '|3, 4'"}),
    Case("iref", "ItemReferenceBox", "#01000000 18:4 'thmb' k:4 1:2 s:4", {"references": "'reference_type|from_item_id|to_item_ids=thmb|' || k || '|' || s"}),
    Case("idat", "ItemDataBox", "n", {"data": "'Data<' || octet_length(encode(n)) || '>'"}),
    Case("imir", "ImageMirror", "s%2:1", {"axis": "s % 2"}),
    Case("irot", "ImageRotation", "s%4:1", {"angle": "s % 4"}),
    Case("iscl", "ImageScaling", "#00000000 s:2 1:2 2:2 3:2", {"target_width_numerator": "s", "target_width_denominator": "1", "target_height_numerator": "2", "target_height_denominator": "3"}),
    Case("ispe", "ImageSpatialExtentProperty", "#00000000 k:4 s:4", {"width": "k", "height": "s"}),
    Case("rref", "RequiredReferenceTypesProperty", "#00000000 2:1 'dimg' 'thmb'", {"reference_types": "'dimg, thmb'"}),
    Case("auxC", "AuxiliaryTypeProperty", "#00000000 'urn:alpha' #00 #0102", {"aux_type": "'urn:alpha'", "aux_subtype": "'Data<2>'"}),
    Case("taic", "TAIClockInfoBox", "#00000000 k*5000000000:8 s:4 4294967296-s:4 #80", {"time_uncertainty": "k * 5000000000", "clock_resolution": "s", "clock_drift_rate": "-s", "clock_type": "2"}),
    Case("cmpd", "ComponentDefinitionBox", "3:4 4:2 s:2 32769:2 'urn:c' #00", {"components": "'type|type_uri=4|;' || s || '|;32769|urn:c'"}),
    Case("uncC", "UncompressedFrameConfigBox", "#00000000 'rgb3' 1:4 s:2 7:1 0:1 0:1 1:1 2:1 4:1 #A8 k:4 1:4 2:4 3:4 4:4", {"profile": "'rgb3'", "components": "'index|bit_depth_minus_one|format|align_size=' || s || '|7|0|0'", "sampling_type": "1", "interleave_type": "2", "block_size": "4", "components_little_endian": "true", "block_pad_lsb": "false", "block_little_endian": "true", "block_reversed": "false", "pad_unknown": "true", "pixel_size": "k", "row_align_size": "1", "tile_align_size": "2", "num_tile_cols_minus_one": "3", "num_tile_rows_minus_one": "4"}),
    Case("uncC", "UncompressedFrameConfigBox", "#01000000 'rgba'", {"profile": "'rgba'"}),
    Case("covr", "Covr MetadataItem", "18:4 'data' #0000000D #00000000 #FFD8", {"covr": "'Data<2>'"}),
    Case("desc", "Desc MetadataItem", "16+octet_length(n):4 'data' #00000001 #00000000 n", {"desc": "n"}),
    Case("name", "Name MetadataItem", "16+octet_length(n):4 'data' #00000001 #00000000 n", {"name": "n"}),
    Case("©nam", "Name MetadataItem", "17:4 'data' #00000001 #00000000 'x'", {"name": "'x'"}),
    Case("year", "Year MetadataItem", "20:4 'data' #00000001 #00000000 '2024'", {"year": "'2024'"}),
    Case("©day", "Year MetadataItem", "20:4 'data' #00000001 #00000000 '2025'", {"year": "'2025'"}),
    Case("tx3g", "3GPP Timed Text", "#000000000000 1:2 s:4 1:1 255:1 #01020304 0:2 65535:2 s:2 k%32768:2 #0102030405060708090A0B0C", {"data_reference_index": "1", "display_flags": "s", "horizontal_justification": "1", "vertical_justification": "-1", "bg_color_rgba": "'r:1,g:2,b:3,a:4'", "box_record": "'0, -1, ' || s || ', ' || k % 32768", "style_record": "'1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12'"}),
]


@query(oracle(MOVIE))
def boxes_of_movies(spark, sf_dir: str) -> DataFrame:
    """Headers, brands, edit lists, colour and geometry, free space, and a box without layout."""
    return properties(spark, sf_dir, MOVIE)


@query(oracle(SAMPLES))
def boxes_of_samples(spark, sf_dir: str) -> DataFrame:
    """Sample tables, groups and auxiliary information."""
    return properties(spark, sf_dir, SAMPLES)


@query(oracle(FRAGMENTS))
def boxes_of_fragments(spark, sf_dir: str) -> DataFrame:
    """Track fragments, clocks, event messages with ID3 tags, and encryption."""
    return properties(spark, sf_dir, FRAGMENTS)


@query(oracle(CODECS))
def boxes_of_codecs(spark, sf_dir: str) -> DataFrame:
    """Decoder configurations."""
    return properties(spark, sf_dir, CODECS)


@query(oracle(SPATIAL))
def boxes_of_spatial_video(spark, sf_dir: str) -> DataFrame:
    """Projections, lenses, stereo views."""
    return properties(spark, sf_dir, SPATIAL)


@query(oracle(ITEMS))
def boxes_of_items(spark, sf_dir: str) -> DataFrame:
    """Image items, their properties, metadata and timed text."""
    return properties(spark, sf_dir, ITEMS)


# --- containers and sample entries

VISUAL_BODY = "#000000000000 s:2 #00000000000000000000000000000000 k%65536:2 s:2 #00480000 #00488000 #00000000 1:2 #04 'test' #000000000000000000000000000000000000000000000000000000 24:2 #FFFF"
AUDIO_BODY = "#000000000000 1:2 #0000000000000000 s:2 16:2 #00000000 #BB800000"
VISUAL_WANT = {"data_reference_index": "s", "width": "k % 65536", "height": "s", "horizresolution": "72", "vertresolution": "'72.5'", "frame_count": "1", "compressor": "'test'", "depth": "24"}
AUDIO_WANT = {"data_reference_index": "1", "channel_count": "s", "sample_size": "16", "sample_rate": "48000"}
ENTRIES = [
    *(Case(f, n, VISUAL_BODY, VISUAL_WANT) for f, n in boxes.VISUAL.items()),
    *(Case(f, n, AUDIO_BODY, AUDIO_WANT) for f, n in boxes.AUDIO.items()),
    Case("meta", "MetaBox", "#00000000", {"version": "0", "flags": "'00000000 00000000 00000000'"}),
    Case("stsd", "SampleDescriptionBox", "#01000005 0:4", {"version": "1", "flags": "'00000000 00000000 00000101'"}),
    Case("lens", "CameraSystemLensBox", "#02800000", {"version": "2", "flags": "'10000000 00000000 00000000'"}),
]


@query(oracle(ENTRIES))
def sample_entries(spark, sf_dir: str) -> DataFrame:
    """Fields of visual and audio sample entries and of containers with a version."""
    return properties(spark, sf_dir, ENTRIES)


#: A tree of boxes: (FourCC, name, head of the body before the children, children).
TREE = [
    ("moov", "MovieBox", "", [
        ("udta", "UserDataBox", "", [("meta", "MetaBox", "#00000000", [("ilst", "MetadataItemList", "", []), ("iprp", "ItemPropertiesBox", "", [("ipco", "ItemPropertyContainerBox", "", [])])])]),
        ("trak", "TrackBox", "", [
            ("edts", "EditBox", "", []),
            ("mdia", "MediaBox", "", [("minf", "MediaInformationBox", "", [("dinf", "DataInformationBox", "", []), ("stbl", "SampleTableBox", "", [("stsd", "SampleDescriptionBox", "#0000000000000010", [
                *((f, n, VISUAL_BODY, [("sinf", "ProtectionSchemeInfoBox", "", [("schi", "SchemeInformationBox", "", [])])] if f == "encv" else []) for f, n in boxes.VISUAL.items()),
                *((f, n, AUDIO_BODY, []) for f, n in boxes.AUDIO.items()),
            ])])])]),
        ]),
        ("mvex", "MovieExtendsBox", "", []),
    ]),
    ("moof", "MovieFragmentBox", "", [("traf", "TrackFragmentBox", "", [])]),
    ("vexu", "VideoExtendedUsageBox", "", [("eyes", "StereoViewBox", "", [("cams", "StereoCameraSystemBox", "", []), ("cmfy", "StereoComfortBox", "", [])]), ("proj", "ProjectionBox", "", []), ("pack", "ViewPackingBox", "", [])]),
    ("lnsc", "CameraSystemLensCollectionBox", "", [("lens", "CameraSystemLensBox", "#00000000", [("lnex", "CameraSystemLensExtrinsicsBox", "", [("cxfm", "CameraSystemTransformBox", "", [])])])]),
]


def _bytes_of(node) -> int:
    return 8 + fixed_size(node[2]) + sum(map(_bytes_of, node[3]))


def _tree_rows(nodes, depth: int = 0, at: int = 0):
    """(fourcc, depth, name, offset, size) of each box, parents first."""
    for node in nodes:
        yield node[0], depth, node[1], at, _bytes_of(node)
        yield from _tree_rows(node[3], depth + 1, at + _bytes_of(node) - sum(map(_bytes_of, node[3])))
        at += _bytes_of(node)


def _tree_content(nodes) -> Column:
    made = [box(fourcc, F.concat(content(head), _tree_content(children))) for fourcc, _, head, children in nodes]
    return F.concat(*made) if made else F.unhex(F.lit(""))


_TREE_ROWS = list(_tree_rows(TREE))
_TREE_END = sum(map(_bytes_of, TREE))
_TREE_SQL = ", ".join(f"struct_pack(box_index := CAST({k} AS INTEGER), fourcc := '{f}', depth := CAST({d} AS INTEGER), line := '{'  ' * d}{f}', box_name := '{n}', header_offset := CAST({at} AS BIGINT), body_size := CAST({size - 8} AS BIGINT))" for k, (f, d, n, at, size) in enumerate(_TREE_ROWS))


@query(f"""
WITH p AS ({P_SQL})
SELECT k AS p_partkey, unnest([{_TREE_SQL}, struct_pack(box_index := CAST({len(_TREE_ROWS)} AS INTEGER), fourcc := 'mdat', depth := CAST(0 AS INTEGER), line := 'mdat', box_name := 'MediaDataBox', header_offset := CAST({_TREE_END} AS BIGINT), body_size := CAST(octet_length(encode(n)) AS BIGINT))], recursive := true) FROM p
""")
def box_containers(spark, sf_dir: str) -> DataFrame:
    """Places, depths and indented lines of a tree with every container, in order, and media data behind it."""
    p = parts(spark, sf_dir)
    rows = boxes.outline(boxes.box_rows(p.select("k", F.concat(_tree_content(TREE), box("mdat", content("n"))).alias("content")), id_col="k"))
    return rows.select(F.col("media_id").cast("bigint").alias("p_partkey"), "box_index", "fourcc", "depth", "line", "box_name", "header_offset", "body_size")


@query(f"""
WITH p AS ({P_SQL}), b AS (SELECT k, s % 4 AS kind FROM p)
SELECT k AS p_partkey, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS n_boxes, CAST(kind IN (1, 2, 3) AS BOOLEAN) AS broken, kind = 0 AS in_strict,
       CASE kind WHEN 1 THEN 'box header is cut off' WHEN 2 THEN 'box is cut off' WHEN 3 THEN 'no box header' END AS error FROM b
""")
def broken_media(spark, sf_dir: str) -> DataFrame:
    """Whole files, files with a header cut off, with a box cut off, and empty ones; the strict view has only whole ones."""
    p = parts(spark, sf_dir).withColumn("n", F.lit(""))
    two = F.concat(box("mfhd", content("#00000000 k:4")), box("tfdt", content("#00000000 k:4")))
    kind = F.col("s") % 4
    data = F.when(kind == 0, two).when(kind == 1, content("#000000")).when(kind == 2, F.substring(two, 1, 31)).otherwise(content(""))
    rows = boxes.box_rows(p.select("k", data.alias("content")), id_col="k")
    kept = boxes.strict(rows).select(F.col("media_id").alias("kept")).distinct()
    per = rows.groupBy("media_id").agg(F.count("*").alias("n_boxes"), F.max("error").alias("error"))
    out = per.join(kept, F.col("media_id") == F.col("kept"), "left")
    return out.select(F.col("media_id").cast("bigint").alias("p_partkey"), F.col("n_boxes").cast("int").alias("n_boxes"), F.col("error").isNotNull().alias("broken"), F.col("kept").isNotNull().alias("in_strict"), "error")
