"""Percent, hex, context and definition codecs; joining of urls; links."""

import pytest
from pyspark.sql import functions as F

from streamloom.functions import codec, urls
from streamloom.operators import classify

URL = "https://media.test/clip-7.m4s?key=a b&sig=x/y"


def context(spark, text):
    return codec.decode_contexts(spark.createDataFrame([(text,)], "t string").withColumn("t", codec.percent_decode("t")), "t").first()["context"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("kind", "index", "head"), [("SEGMENT", None, "SEGMENT,"), ("MAP", None, "MAP,"), ("PART", 12, "PART,12,")])
@pytest.mark.parametrize(("span", "shown"), [((17, 2048), "17-2048"), ((None, None), "-"), ((5, 5), "5-5")])
def test_media_contexts(spark, kind, index, head, span, shown):
    a, b = (F.lit(v).cast("bigint") for v in span)
    encoded = one(spark, codec.encode_segment(kind, F.lit(URL), F.lit(4321), a, b, F.lit(index)))
    assert encoded == f"{head}4321,{shown},https://media.test/clip-7.m4s?key%3Da%20b%26sig%3Dx/y"
    back = context(spark, encoded)
    assert (back.context_type, back.url, back.media_sequence, back.part_index, back.range_start, back.range_end, back.error) == (kind, URL, 4321, index, *span, None)


@pytest.mark.parametrize(("command", "ident", "shown"), [("OUT", "break-77", "break-77"), ("IN", "", ""), ("CMD", "k=v <1>", "k%3Dv%20%3C1%3E")])
def test_scte35_context(spark, command, ident, shown):
    encoded = one(spark, codec.encode_scte35(F.lit('0xFC,"A1'), F.lit(ident), F.lit(command)))
    assert encoded == f"SCTE35,{command},{shown}%220xFC,%22A1"
    back = context(spark, encoded)
    assert (back.context_type, back.daterange_id, back.command_type, back.message) == ("SCTE35", ident, command, '0xFC,"A1')


@pytest.mark.parametrize("kind", ["ASSET_LIST", "DATERANGE_SCHEDULE"])
def test_json_context(spark, kind):
    encoded = one(spark, codec.encode_json(kind, F.lit(URL), F.lit("night & day")))
    assert encoded == f"{kind},night%20%26%20day%22https://media.test/clip-7.m4s?key%3Da%20b%26sig%3Dx/y"
    back = context(spark, encoded)
    assert (back.daterange_id, back.url) == ("night & day", URL)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("nonsense", "UnknownContextType"), ("SEGMENT", "EmptyContextValue"), ("SEGMENT,x", "MediaSequencePartParseIntFailure"), ("SEGMENT,1", "MissingRangePart"), ("SEGMENT,1,5", "RangeParseFailure"),
        ("SEGMENT,1,5-x,u", "RangeParseFailure"), ("SEGMENT,1,-", "MissingUrlPart"), ("SEGMENT, 1,-,u", "MediaSequencePartParseIntFailure"), ("PART,x,1,-,u", "PartIndexParseIntFailure"), ("PART,1", "MissingMediaSequencePart"),
        ("SCTE35,out,i\"m", "InvalidCommandType"), ("SCTE35,OUT", "MissingDaterangeId"), ("SCTE35,OUT,id", "MissingScte35Message"), ("ASSET_LIST,id", "MissingAssetListUrl"), ("SEGMENT,18446744073709551616,-,u", "MediaSequencePartParseIntFailure"),
    ],
)
def test_malformed_contexts(spark, text, error):
    assert context(spark, text).error == error
    assert error in codec.CONTEXT_ERRORS


def test_context_with_large_numbers(spark):
    back = context(spark, "SEGMENT,18446744073709551615,9-3,a,b")
    assert (int(back.media_sequence), int(back.range_start), int(back.range_end), back.url) == (2**64 - 1, 9, 3, "a,b")


@pytest.mark.parametrize(
    ("pairs", "encoded"),
    [
        ([("LANG", "fi")], "LANG%253Dfi"),
        ([("z", "1"), ("a", ""), ("HOST", "cdn-3.test")], "z%253D1%22a%253D%22HOST%253Dcdn-3.test"),
        ([("x y", "50% & <more>"), ("q", 'a"b#c')], "x%2520y%253D50%2525%2520%2526%2520%253Cmore%253E%22q%253Da%2522b%2523c"),
        ([("odd", "\ufffd é")], "odd%253D%25EF%25BF%25BD%2520%25C3%25A9"),
    ],
)
def test_definitions(spark, pairs, encoded):
    column = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in pairs))
    assert one(spark, codec.encode_definitions(column)) == encoded
    assert one(spark, codec.decode_definitions(F.lit(encoded))) == dict(pairs)


def test_definitions_edges(spark):
    assert one(spark, codec.decode_definitions(F.lit(""))) == {"": ""}
    assert one(spark, codec.decode_definitions(F.lit("a%253D1%22a%253D2%22b"))) == {"a": "2", "b": ""}
    assert one(spark, codec.decode_definitions(F.lit("%FF"))) is None
    assert one(spark, codec.decode_definitions(F.lit("a=\ufffd"))) == {"a": "\ufffd"}


def percent(text):
    return "".join(chr(b) if 0x20 < b < 0x7F and chr(b) not in codec.ESCAPED else f"%{b:02X}" for b in text.encode())


EVERY = "".join(map(chr, [*range(128), 0xE9, 0x20AC, 0x1F642]))


@pytest.mark.parametrize(("text", "want"), [("a b/é=", "a%20b/%C3%A9%3D"), ("\x00\x7f~", "%00%7F~"), ("plain+/:?,", "plain+/:?,"), ("", ""), (EVERY, percent(EVERY)), (EVERY[32:127], percent(EVERY[32:127])), ("%21 é %2521+", percent("%21 é %2521+"))])
def test_percent_encode(spark, text, want):
    assert one(spark, codec.percent_encode(F.lit(text))) == want
    assert one(spark, codec.percent_decode(F.lit(want))) == text


@pytest.mark.parametrize(("text", "want"), [("a+b%2", "a+b%2"), ("%zz%41", "%zzA"), ("%ff", "�"), ("100%", "100%"), ("%e4%bd%a0", "你"), ("%e4+%zz", "�+%zz"), ("%e4%bd%a0 \ufffd%ff", "你 \ufffd�"), ("%c3%a9+%-1", "é+%-1"), ("%é41", "%é41")])
def test_percent_decode_is_lossy(spark, text, want):
    assert one(spark, codec.percent_decode(F.lit(text))) == want


def test_hex(spark):
    assert one(spark, codec.hex_decode(F.lit("00ff"))) == b"\x00\xff"
    assert one(spark, codec.hex_decode(F.lit("abc"))) is None
    assert one(spark, codec.hex_decode(F.lit("zz"))) is None
    assert one(spark, codec.hex_dump(F.unhex(F.lit("000102030405060708090A0B0C0D0E0F1011")))) == "00 01 02 03  04 05 06 07  08 09 0A 0B  0C 0D 0E 0F\n10 11"
    assert one(spark, codec.binary_mask(F.unhex(F.lit("0047")))) == "00000000 01000111"


@pytest.mark.parametrize(
    ("base", "relative", "want"),
    [
        ("https://tv.test/live/index.m3u8", "low/v1.m3u8", "https://tv.test/live/low/v1.m3u8"),
        ("https://tv.test/live/index.m3u8", "http://other.test/x/y.m3u8?z", "http://other.test/x/y.m3u8?z"),
        ("https://tv.test/9/8/index.m3u8", "../7/v.m3u8", "https://tv.test/9/7/v.m3u8"),
        ("HTTP://EXAMPLE.com:80", "a b.m3u8?x y#f g", "http://example.com/a%20b.m3u8?x%20y#f%20g"),
        ("https://e.com/a/b?q=1#f", "", "https://e.com/a/b?q=1"),
        ("https://e.com/a/b?q=1", "?z", "https://e.com/a/b?z"),
        ("https://e.com/a/b", "//other.com", "https://other.com/"),
        ("https://e.com/a/b", "/../../c/./d/..", "https://e.com/c/"),
        ("https://e.com/a/b", "#x", "https://e.com/a/b#x"),
        ("https://e.com/", "data:text/plain,hi", "data:text/plain,hi"),
        ("nonsense", "a", None),
        ("https://e.com/é", "ü.ts", "https://e.com/%C3%BC.ts"),
    ],
)
def test_join(base, relative, want):
    assert urls.join(base, relative) == want


def test_variables_and_links(spark):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    defs = F.array(pair("EDGE", "https://e7.test"), pair("SIG", "p=q"))
    text = one(spark, urls.replace_variables(F.lit("{$EDGE}/v.m3u8?sig={$SIG}&x={$NO}"), defs))
    assert text == "https://e7.test/v.m3u8?sig=p=q&x={$NO}"
    assert one(spark, urls.playlist_link(F.lit("https://c.com/a?t=1"), defs)) == "?playlist_url=https://c.com/a?t%3D1&imported_definitions=EDGE%253Dhttps://e7.test%22SIG%253Dp%253Dq"
    assert one(spark, urls.context_link(F.lit("https://c.com/a"), F.lit("D%3D1"), F.lit("MAP,1,-,u"))) == "?playlist_url=https://c.com/a&imported_definitions=D%3D1&supplemental_view_context=MAP,1,-,u"


def test_query_values(spark):
    assert one(spark, urls.query_value(F.lit("https://a/?x&playlist_url=u%3D1&playlist_url=2#f"), "playlist_url")) == "u%3D1"
    assert one(spark, urls.query_value(F.lit("https://a/"), "playlist_url")) is None


@pytest.mark.parametrize(("url", "want"), [("https://tv.test/a.b/init.mp4?x=y.vtt", "Mp4"), ("https://tv.test/9.m4s", "Mp4"), ("https://tv.test/subs/en.vtt#t", "WebVtt"), ("https://tv.test/v.M4S", None), ("https://tv.test/mp4/", None), ("/rel/9.mp4", None)])
def test_url_probe(spark, url, want):
    assert one(spark, classify.by_url(F.lit(url))) == want


def test_data_probes(spark):
    ftyp = bytes.fromhex("00000010667479706D736468000000006D736468".replace("00000010", "00000014"))
    rows = spark.createDataFrame([(b"WEBVTT\n",), (b"\xef\xbb\xbfWEBVTT",), (ftyp,), (b"",), (b"\x00\x00\x00\x08free" + ftyp,)], "c binary")
    got = rows.select(classify.is_webvtt("c"), classify.is_mp4_probe(F.col("c")), classify.is_mp4(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, False, False), (False, True, True), (False, False, False), (False, True, True)]
