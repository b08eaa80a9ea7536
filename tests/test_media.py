"""Boxes: golden vectors, every layout read without error, broken files, protection headers, messages, JSON views."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from streamloom.operators import box_fields, boxes, drm, id3, jsonviews, scte35
from streamloom.plans import synth, views
from streamloom.sources import readers


def box(kind, body=b""):
    return struct.pack(">I", len(body) + 8) + kind.encode("latin-1") + body


def fields(kind, body):
    return dict(box_fields.describe(kind, body)[1])


def rendered(kind, body):
    return {k: box_fields.render(v) for k, v in box_fields.describe(kind, body)[1] if not isinstance(v, box_fields.Table)}


@pytest.mark.parametrize(("hex_text", "want"), [("01000D100000", (1, 0, 8, 1, True, False, True, 0, 0)), ("01000A0D0000", (1, 0, 5, 1, True, False, True, 0, 0)), ("0100101D1000", (1, 0, 8, 3, True, False, True, 1, 0))])
def test_dolby_vision_bits(hex_text, want):
    body = bytes.fromhex(hex_text)[:5] + bytes(19)
    assert fields("dvvC", body)["dv_version_major"] == want[0]
    with pytest.raises(box_fields.Malformed):
        box_fields.describe("dvcC", body[:10])


def test_dolby_vision_golden():
    golden = bytes.fromhex("000000206476764301 00100D100000".replace(" ", "")).ljust(32, b"\0")
    got = fields("dvvC", golden[8:])
    assert tuple(got.values()) == (1, 0, 8, 1, True, False, True, 1, 0)
    golden = bytes.fromhex("000000206476634301000A0D000000").ljust(32, b"\0")
    assert tuple(fields("dvcC", golden[8:]).values()) == (1, 0, 5, 1, True, False, True, 0, 0)


def test_ac4_golden():
    one = bytes.fromhex("0000002564616334 20A601400000001FFFFFFFE0010FF98000004800008E50100000 8F0080".replace(" ", ""))
    got = fields("dac4", one[8:])
    assert (got["ac4_dsi_version"], got["bitstream_version"], got["fs_index"], got["frame_rate_index"], got["bit_rate_mode"], got["bit_rate"], got["bit_rate_precision"]) == (1, 2, 1, 3, "average (2)", 0, 4294967295)
    rows = {k: box_fields.render(v) for k, v in got["presentation #1"].rows}
    mask = "00000000 00000000 01000111"
    assert rows["version"] == "1" and rows["config"] == "31" and rows["md_compat"] == "1" and rows["id"] == "0"
    assert rows["channel_coded"] == "true" and rows["ch_mode"] == "4" and rows["channel_mask"] == mask
    assert rows["substream_groups"] == "g.len() == 1" and rows["g[0]s[0] channel_mask"] == mask and rows["g[0] content_classifier"] == "complete main (0)"
    assert rows["dialogue_enancement"] == "true" and rows["immersive_audio"] == "false" and rows["pre_virtualized"] == "false"
    two = bytes.fromhex("0000003664616334 20A602400000001FFFFFFFE0 020FF88000004200000250100000 0308C0010FF88000004200000250100000030080".replace(" ", ""))
    got = fields("dac4", two[8:])
    first, second = ({k: box_fields.render(v) for k, v in got[f"presentation #{n}"].rows} for n in (1, 2))
    assert (first["version"], first["md_compat"], first["ch_mode"], first["pre_virtualized"], first["dialogue_enancement"], first["dolby_atmos"]) == ("2", "0", "1", "true", "true", "true")
    assert (second["version"], second["pre_virtualized"], second["immersive_audio"]) == ("1", "false", "false")


def test_every_box_rejects_or_reads_any_bytes():
    for kind in [*box_fields.FIXED, *box_fields.VARIABLE]:
        for body in (b"", bytes(200), bytes(range(120)), b"\xff" * 64):
            try:
                name, rows = box_fields.describe(kind, body)
            except (box_fields.Malformed, drm.BadHeader):
                continue
            assert name and all(isinstance(k, str) for k, _ in rows)
            for _, v in rows:
                box_fields.render(v) if not isinstance(v, box_fields.Table) else [[box_fields.render(c) for c in r] for r in v.rows]


def test_fixed_and_optional_fields():
    full = bytes(4)
    assert rendered("tfhd", bytes.fromhex("00000029") + struct.pack(">IQI I".replace(" ", ""), 7, 9, 11, 13))["base_data_offset"] == "9"
    assert fields("mdhd", full + struct.pack(">IIIIHH", 1, 2, 3, 4, 0x55C4, 0))["language"] == "und"
    assert fields("stsz", full + struct.pack(">III", 0, 2, 5) + struct.pack(">I", 6)) == {"sample_count": 2, "sample_sizes": [5, 6]}
    assert fields("stsz", full + struct.pack(">II", 9, 3)) == {"sample_count": 3, "sample_size": 9}
    assert fields("elst", b"\1\0\0\0" + struct.pack(">IQqhh", 1, 5, -1, 1, 0))["entries"].rows == [[5, -1, 1, 0]]
    assert fields("colr", b"nclx" + struct.pack(">HHHB", 1, 2, 3, 0x81))["full_range_flag"] is False
    assert fields("hero", full + b"\2")["description"] == "right"
    assert rendered("lfad", full + struct.pack(">6f", 1, 0.1, -2.5, 0, 1e-3, 3))["polynomial_parameters_x"] == "[1, 0.1, -2.5]"
    assert rendered("prft", b"\1\0\0\x18" + struct.pack(">IQQ", 1, 2, 3))["media_time"] == "3"
    assert fields("schm", b"\0\0\0\1cenc" + struct.pack(">I", 65536) + b"u\0")["scheme_uri"] == "u"
    tenc = fields("tenc", b"\1\0\0\0\0\x19\1\0" + bytes(16) + b"\x08" + bytes(8))
    assert (tenc["default_Per_Sample_IV_Size"], tenc["default_constant_IV_size"], tenc["default_crypt_byte_block"]) == ("0 (Constant IV)", "8 (64-bit)", 1)
    dec3 = fields("dec3", bytes([0x06, 0x00, 0x20, 0x0F, 0x02, 0x02]))
    assert dec3["data_rate"] == 192 and dict(map(tuple, dec3["independent_substream #0"].rows))["chan_loc"] == "000000010 (Lrs/Rrs)"


def test_sample_encryption_sizes():
    full = b"\0\0\0\2" + struct.pack(">I", 2)
    one = struct.pack(">HHI", 1, 3, 5)
    for n in (0, 8, 16):
        got = box_fields.sample_encryption(full + 2 * (bytes(n) + one))
        assert got == [("0x" + "00" * n if n else "", [(3, 5)])] * 2
    assert box_fields.sample_encryption(bytes(8)) == []
    assert fields("senc", bytes(4) + struct.pack(">I", 1) + bytes(5)) == {"IV": "Unsupported size"}
    assert fields("senc", bytes(8)) == {"IV": "Constant"}


def test_walk_shapes():
    stsd = box("stsd", bytes(4) + struct.pack(">I", 1) + box("avc1", bytes(78) + box("pasp", struct.pack(">II", 1, 1))))
    file = box("moov", box("trak", stsd)) + struct.pack(">I4sQ", 1, b"free", 20) + bytes(4) + struct.pack(">I4s", 0, b"mdat") + b"xyz"
    got = [(b.fourcc, b.depth, b.body_size, b.to_end) for b in boxes.walk(file)]
    assert got == [("moov", 0, 8 + 8 + 8 + 86 + 16, False), ("trak", 1, 8 + 8 + 86 + 16, False), ("stsd", 2, 8 + 86 + 16, False), ("avc1", 3, 78 + 16, False), ("pasp", 4, 8, False), ("free", 0, 4, False), ("mdat", 0, 3, True)]
    assert [b.error for b in boxes.walk(b"")] == ["no box header"]
    assert [b.error for b in boxes.walk(box("free") + b"abc")] == [None, "box header is cut off"]
    assert next(boxes.walk(struct.pack(">I4s", 99, b"mdat"))).error is None
    assert next(boxes.walk(struct.pack(">I4s", 99, b"free"))).error == "box is cut off"


def test_box_tables(spark):
    good, bad = box("mfhd", bytes(4) + struct.pack(">I", 5)) + box("zzzz", b"abc"), box("mfhd", b"\0")
    df = spark.createDataFrame([("good", good), ("bad", bad), ("null", None)], "media_id string, content binary")
    props = boxes.box_properties(df)
    got = {(r.media_id, r.fourcc, r.key): r.value for r in props.filter("error IS NULL").collect()}
    assert got[("good", "mfhd", "sequence_number")] == "5" and got[("good", "mfhd", "size")] == "16" and got[("good", "zzzz", "data")] == "Data<3>"
    assert {r.media_id for r in boxes.strict(props).collect()} == {"good"}
    rows = boxes.box_rows(df, fourccs=("mfhd",))
    assert boxes.view(rows.filter("media_id = 'good'"), "mfhd").first().sequence_number == 5
    assert boxes.outline(boxes.box_rows(df)).filter("fourcc = 'zzzz'").first().line == "zzzz"


def wrm(xml):
    raw = xml.encode("utf-16-le")
    record = struct.pack("<HH", 1, len(raw)) + raw
    return struct.pack("<IH", 6 + len(record), 1) + record


def test_playready():
    xml = '<WRMHEADER xmlns="n" version="4.0.0.0"><DATA><PROTECTINFO><KEYLEN>16</KEYLEN><ALGID>AESCTR</ALGID></PROTECTINFO><KID>abc==</KID><KID VALUE="x"/><LA_URL>http://l</LA_URL><CUSTOMATTRIBUTES><A>1</A></CUSTOMATTRIBUTES></DATA></WRMHEADER>'
    body = bytes(4) + drm.PLAYREADY + struct.pack(">I", len(wrm(xml))) + wrm(xml)
    got = fields("pssh", body)
    assert got["system_ref"] == "Microsoft PlayReady"
    assert got["pssh_data"].rows == [["type", "RightsManagement"], ["xmlns", "n"], ["version", "4.0.0.0"], ["KID 1", ""], ["kid", "abc=="], ["la_url", "http://l"], ["custom_attributes", "<CUSTOMATTRIBUTES><A>1</A></CUSTOMATTRIBUTES>"]]
    for broken in (b"\1\2", wrm("<WRMHEADER version='1'></WRMHEADER>"), wrm("<WRMHEADER><DATA></DATA></WRMHEADER>"), wrm("<oops")):
        with pytest.raises(drm.BadHeader):
            drm.playready_rows(broken)


def test_widevine_and_limits():
    message = b"\x12\x02\xab\xcd" + b"\x22\x02id" + b"\x48" + bytes([0xE3, 0xDC, 0x95, 0x9B, 0x06]) + b"\x1a\x01p"
    rows = drm.widevine_rows(message)
    assert rows == [["key_id 0", "abcd"], ["content_id", "id"], ["protection_scheme", "CENC"], ["provider", "p"]]
    kids = b"\1\0\0\0" + bytes(16) + struct.pack(">I", 1) + b"k" * 16 + struct.pack(">I", 0)
    assert drm.parse_pssh(kids)["key_ids"] == [b"k" * 16]
    for bad in (b"\0" * 10, bytes(4) + bytes(16) + struct.pack(">I", 5000) + bytes(5000), b"\1\0\0\0" + bytes(16) + struct.pack(">I", 5000)):
        with pytest.raises(drm.BadHeader):
            drm.parse_pssh(bad)


OUT = "0xFC303E00000000000000C00506FE702F4C3A0028022643554549000000017FFF0000E297D00E1270636B5F455030343435303730333036393522040600000000"


def test_scte35():
    body = "00" + "0000000000" + "00" + "00C005" + "06" + "FE702F3F7A" + "0028" + "02264355454900000001" + "7FFF" + "0000E297D0" + "0E12" + b"pck_EP044507030695".hex() + "220406"
    data = bytes.fromhex("FC" + f"{0x3000 + len(body) // 2 + 4:04X}" + body)
    crc = scte35.crc32_mpeg(data)
    got = scte35.decode(data + struct.pack(">I", crc))
    assert (got["section_length"], got["tier"], got["command"], got["pts_time"], got["crc_ok"]) == (62, 12, "time_signal", 0x702F3F7A, True)
    (d,) = got["descriptors"]
    assert (d["tag"], d["identifier"], d["segmentation_event_id"], d["duration"], d["upid_type"], d["upid"], d["type_id"], d["segment_num"], d["segments_expected"]) == (2, "CUEI", 1, 14850000, 14, "pck_EP044507030695", 0x22, 4, 6)
    assert scte35.decode_text("abc")["error"].startswith("Hex") and scte35.decode_text("0xZZ")["error"].startswith("Hex")
    assert scte35.decode_text("00")["error"].startswith("Scte35") and scte35.decode_text("FC30")["error"].startswith("Scte35")


def test_scte35_column(spark):
    df = spark.createDataFrame([("FC30110000000000000000FFFF0000004F253396".replace("FFFF0000", "FFF00000"),), (None,), ("0x0",)], "message string")
    got = [r.splice for r in scte35.messages(df).collect()]
    assert got[2].error.startswith("Hex") and got[1].command is None


def splice(command, body, *descriptors):
    loop = b"".join(bytes([tag, len(b) + 4]) + b"CUEI" + b for tag, b in descriptors)
    part = bytes(7) + b"\0" + struct.pack(">I", 0x00C << 20 | len(body) << 8 | command)[:4] + body + struct.pack(">H", len(loop)) + loop
    data = b"\xfc" + struct.pack(">H", 0x3000 | len(part) + 3) + part[1:]
    return data + struct.pack(">I", scte35.crc32_mpeg(data))


def test_scte35_whole_sections(spark):
    tail = bytes.fromhex("0102" + "03" + "04")
    timed = splice(5, bytes.fromhex("00000007 7F EF FE00000100 FE00015F90") + tail)
    immediate_components = splice(5, bytes.fromhex("00000008 7F 9F 02 0A 0B") + tail)
    timed_components = splice(5, bytes.fromhex("00000009 7F 8F 02 0A FF00000005 0B 7F") + tail)
    schedule = splice(4, bytes.fromhex("02 00000001 7F FF 00000064 7E00000200") + tail + bytes.fromhex("00000002 FF"))
    private = splice(255, b"ABCDxyz")
    marks = splice(
        6,
        bytes.fromhex("FE00000001"),
        (0, bytes.fromhex("000000FF")),
        (1, b"\x05\x7f12#"),
        (2, bytes.fromhex("00000003 7F 4B 01 2A FF00000006 000000000A 00 00 34 01 02 03 04")),
        (2, bytes.fromhex("00000004 7F BF 00 00 34 01 02")),
        (3, bytes.fromhex("000000000010 00000020 0025")),
        (4, b"\x1f\x07eng" + bytes([0b010_0011_1])),
        (9, b"\xab"),
    )
    texts = [d.hex() for d in (timed, immediate_components, timed_components, schedule, private, marks)]
    got = [r.s for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, m string").select("k", scte35.scte35_decode("m").alias("s")).orderBy("k").collect()]
    assert [s.error for s in got] == [None] * 6 and all(s.crc_ok and s.stuffing is None for s in got)
    a, b, c, d, e, f = got
    for s in (a, b, c, d.splices[0]):
        assert (s.unique_program_id, s.avail_num, s.avails_expected) == (0x102, 3, 4)
    assert (a.splice_event_id, a.out_of_network, a.program_splice, a.splice_immediate, a.pts_time, a.auto_return, a.break_duration) == (7, True, True, False, 256, True, 90000)
    assert b.splice_immediate and [tuple(x) for x in b.components] == [(10, None), (11, None)] and b.break_duration is None
    assert not c.splice_immediate and [tuple(x) for x in c.components] == [(10, 0x100000005), (11, None)]
    assert (d.splices[0].utc_splice_time, d.splices[0].auto_return, d.splices[0].break_duration) == (100, False, 512)
    assert (d.splices[1].splice_event_id, d.splices[1].splice_event_cancelled, d.splices[1].avail_num) == (2, True, None)
    assert (e.private_identifier, e.private_bytes) == ("ABCD", b"xyz".hex())
    avail, dtmf, seg, old, tai, audio, other = f.descriptors
    assert avail.provider_avail_id == 255 and (dtmf.preroll, dtmf.dtmf) == (5, "12#")
    assert (seg.delivery_not_restricted, seg.web_delivery_allowed, seg.no_regional_blackout, seg.archive_allowed, seg.device_restrictions) == (False, False, True, False, 3)
    assert [tuple(x) for x in seg.components] == [(42, 0x100000006)] and (seg.duration, seg.sub_segment_num, seg.sub_segments_expected) == (10, 3, 4)
    assert (old.delivery_not_restricted, old.segments_expected, old.sub_segment_num) == (True, 2, None)
    assert (tai.tai_seconds, tai.tai_ns, tai.utc_offset) == (16, 32, 37)
    assert [tuple(x) for x in audio.audio] == [(7, "eng", 2, 3, True)] and other.private_bytes == "ab"
    shown = spark.createDataFrame([(texts[3],)], "m string").select(scte35.scte35_json("m")).first()[0]
    assert json.loads(shown)["splices"][0]["utc_splice_time"] == 100


def test_id3():
    frame = b"TIT2" + struct.pack(">I", 6) + b"\0\0" + b"\3title"
    tag = b"ID3\4\0\0" + bytes([0, 0, 0, len(frame)]) + frame
    assert id3.frames(tag) == [("TIT2", "title")]
    assert id3.frames(b"none") is None
    emsg = b"\1\0\0\0" + struct.pack(">IQII", 1000, 5, 6, 7) + b"https://aomedia.org/emsg/ID3\0v\0"
    assert fields("emsg", emsg + tag)["message_data"].rows == [["TIT2", "title"]]
    assert fields("emsg", emsg + b"\xffx")["message_data"] == "�x"
    assert fields("emsg", bytes(4) + b"s\0v\0" + struct.pack(">IIII", 1, 2, 3, 4))["presentation_time_delta"] == 2


def test_json_views(spark):
    docs = ['{"ASSETS":[{"URI":"a.m3u8","DURATION":5,"X":1}],"SKIP-CONTROL":{"OFFSET":1,"DURATION":2,"LABEL-ID":"l"}}', '{"ASSETS":[{"URI":"a"}]}', "no", None, '{"ASSETS":[],"SKIP-CONTROL":{"OFFSET":1}}']
    df = spark.createDataFrame([(k, d, "https://e.com/m/p.m3u8") for k, d in enumerate(docs)], "k int, json string, playlist_url string")
    got = views.asset_list_view(df).orderBy("k").collect()
    assert [(r.k, r.uri, r.duration, r.error is None) for r in got] == [(0, "a.m3u8", 5.0, True)] + [(k, None, None, False) for k in range(1, 5)]
    assert got[0].href == "?playlist_url=https://e.com/m/a.m3u8"
    schedules = ['{"DATERANGES":[{"ID":"x","n":1.50,"o":{"b":[1, null],"a":"é"},"X-ASSET-LIST":"l","z":null}]}', '{"DATERANGES":[{"n":1}]}', "[]"]
    rows = jsonviews.schedule_rows(spark.createDataFrame([(k, s) for k, s in enumerate(schedules)], "k int, json string")).orderBy("ordinal").collect()
    assert [(r.k, r.name, r.value, r.link_type) for r in rows] == [(0, "ID", "x", None), (0, "X-ASSET-LIST", "l", "ASSET_LIST"), (0, "n", "1.5", None), (0, "o", '{"a":"é","b":[1,null]}', None), (0, "z", "null", None)]


def test_segment_views_and_sources(spark, tmp_path):
    (tmp_path / "a.m3u8").write_text("#EXTM3U\nseg.ts\n")
    (tmp_path / "m.bin").write_bytes(bytes(range(20)))
    assert readers.read_playlists(spark, str(tmp_path / "*.m3u8"), "https://e.com/x").first().playlist_url == "https://e.com/x/a.m3u8"
    media = readers.read_media(spark, str(tmp_path), "*.bin").withColumns({"range_start": F.lit(2), "range_end": F.lit(4)})
    assert bytes(readers.byte_range(media).first().content) == b"\2\3\4"
    rows = spark.createDataFrame([("https://e/x.vtt", None, b"WEBVTT"), ("https://e/x", "image/png", b"\x89" * 100), ("https://e/x", None, b"??")], "url string, content_type string, content binary")
    got = {r.segment_type: r for r in views.segment_views(rows).collect()}
    assert got["WebVtt"].text == "WEBVTT" and got["Unknown"].error == views.UNSUPPORTED
    assert got["Image"].data_uri.startswith("data:image/png;base64,") and "\n" not in got["Image"].data_uri
    asked = readers.requests(spark.createDataFrame([("https://v/?playlist_url=https://c/a%3Fx&supplemental_view_context=MAP,1,-,u%26v&imported_definitions=A%253D1",)], "url string")).first()
    assert (asked.playlist_url, asked.definitions_query, asked.context.url) == ("https://c/a?x", "A%253D1", "u&v")
    assert views.error_view(spark.createDataFrame([('{"a":1}',), ("plain",)], "extra_info string")).collect()[0].shown == '{\n  "a": 1\n}'
    assert readers.examples(spark).count() == 15 and drm.systems(spark).count() == 28


def test_fragment_samples(spark, sf_dir):
    rows = boxes.box_properties(synth.fragments(spark, sf_dir).limit(3)).filter("fourcc = 'trun' AND key = 'entries'").collect()
    assert len(rows) == 3 and all(r.headers == ["#", "duration", "size", "flags", "cts"] and r.rows[0][0] == "1" for r in rows)
