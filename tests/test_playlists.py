"""The scanner against a step-by-step simulation on random playlists; markup, date ranges, links and highlights."""

import random

import pytest
from pyspark.sql import functions as F

from streamloom.operators import lex, links, state
from streamloom.plans import views
from streamloom.streaming import snapshots

TAG = "#EXT-X-TEST:"


def frame(spark, *bodies):
    return spark.createDataFrame([(f"https://example.com/hls/{k}.m3u8", b) for k, b in enumerate(bodies)], "playlist_url string, body string")


def simulate(body):
    """(line_no, kind, media_sequence, part_index, start, end, media) for uris, parts and maps, by walking the lines."""
    seq = part = carry = pcarry = 0
    span, media, out = None, False, []
    number = lambda t: int(t) if t.lstrip("+").isdigit() else None
    for n, line in enumerate(body.split("\n")):
        if line.startswith("#EXT-X-MEDIA-SEQUENCE:"):
            seq = int(line.split(":")[1])
        elif line.startswith("#EXT-X-BYTERANGE:"):
            size, _, offset = line.split(":")[1].partition("@")
            start = int(offset) if offset else carry
            span, carry = (start, start + int(size) - 1), start + int(size)
        elif line.startswith("#EXT-X-PART:"):
            media = True
            got = line.partition('BYTERANGE="')[2].rstrip('"')
            r = None
            if got:
                size, _, offset = got.partition("@")
                start = number(offset) if offset else pcarry
                r, pcarry = (start, start + int(size) - 1), start + int(size)
            else:
                pcarry = 0
            out.append((n, seq, part, *(r or (None, None)), media))
            part += 1
        elif line.startswith("#EXTINF"):
            media = True
        elif line and not line.startswith("#"):
            out.append((n, seq, part, *(span or (None, None)), media))
            if span is None:
                carry = 0
            span, seq, part, pcarry = None, seq + 1, 0, 0
    return out


def random_body(rng):
    lines = ["#EXTM3U"]
    for _ in range(rng.randint(0, 25)):
        size, offset = rng.randint(1, 50), rng.randint(0, 99)
        lines.append(rng.choice([
            f"#EXT-X-BYTERANGE:{size}", f"#EXT-X-BYTERANGE:{size}@{offset}", "seg.m4s", "#EXTINF:4,", "# note", "", f"#EXT-X-MEDIA-SEQUENCE:{offset}",
            '#EXT-X-PART:DURATION=1,URI="p"', f'#EXT-X-PART:DURATION=1,URI="p",BYTERANGE="{size}"', f'#EXT-X-PART:URI="p",BYTERANGE="{size}@{offset}"',
        ]))
    return "\n".join(lines)


def test_scan_equals_simulation(spark):
    rng = random.Random(5)
    bodies = [random_body(rng) for _ in range(150)]
    rows = state.scan(lex.lines(frame(spark, *bodies))).filter("kind = 'uri' OR tag_name = '-X-PART'").collect()
    got = sorted((int(r.playlist_url.split("/")[-1][:-5]), r.line_no, r.media_sequence, r.part_index, r.range_start, r.range_end, r.is_media) for r in rows)
    want = sorted((k, *x) for k, b in enumerate(bodies) for x in simulate(b))
    assert got == want


def test_scan_shuffles_once(spark):
    plan = state.scan(lex.lines(frame(spark, "#EXTM3U\na")))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_header_empty_and_endings(spark):
    got = lex.lines(frame(spark, "", "seg\n#EXTM3U", "#EXTM3U\r\nseg.ts\r\n#c\r\n")).orderBy("playlist_url", "line_no").collect()
    assert [(r.raw, r.kind, r.error) for r in got] == [("seg", "uri", lex.HEADER_ERROR), ("#EXTM3U", "tag", None), ("seg.ts", "uri", None), ("#c", "comment", None), ("", "blank", None)]


def test_empty_range_is_flagged(spark):
    r = views.playlist(frame(spark, "#EXTM3U\n#EXT-X-BYTERANGE:0@5\nseg")).filter("kind = 'uri'").first()
    assert (r.range_start, r.range_end, r.empty_range) == (None, None, True)


def test_map_ranges_need_both_numbers(spark):
    got = views.playlist(frame(spark, '#EXTM3U\n#EXT-X-MAP:URI="i",BYTERANGE="10@5"\n#EXT-X-MAP:URI="i",BYTERANGE="10"\n#EXT-X-MAP:URI="i",BYTERANGE=10@5')).filter("tag_name = '-X-MAP'").orderBy("line_no").collect()
    assert [(r.range_start, r.range_end) for r in got] == [(5, 14), (None, None), (None, None)]


@pytest.mark.parametrize(
    ("value", "attr", "href", "want"),
    [
        ("ONE=1,TWO=2,THREE=3", "FOUR", "test", [("string", TAG + "ONE=1,TWO=2,THREE=3")]),
        ("ONE=1,TWO=2,THREE=3", "TWO", None, [("string", TAG + "ONE=1,TWO=2,THREE=3")]),
        ("ONE=1,TWO=2,THREE=3", "ONE", "test", [("string", TAG + "ONE="), ("link", "1"), ("string", ",TWO=2,THREE=3")]),
        ('ONE="1",TWO="2",THREE="3"', "ONE", "test", [("string", TAG + 'ONE="'), ("link", "1"), ("string", '",TWO="2",THREE="3"')]),
        ('ONE="1",TWO="2",THREE="3"', "TWO", "test", [("string", TAG + 'ONE="1",TWO="'), ("link", "2"), ("string", '",THREE="3"')]),
        ("ONE=1,TWO=2,THREE=3", "THREE", "test", [("string", TAG + "ONE=1,TWO=2,THREE="), ("link", "3")]),
        ('ONE="1",TWO="2",THREE="3"', "THREE", "test", [("string", TAG + 'ONE="1",TWO="2",THREE="'), ("link", "3"), ("string", '"')]),
        ("no list", "ONE", "test", [("string", TAG + "no list")]),
    ],
)
def test_markup(spark, value, attr, href, want):
    rows = lex.with_attributes(lex.lines(frame(spark, f"#EXTM3U\n{TAG}{value}"))).filter("line_no = 1")
    chosen = F.transform("attrs", lambda a: F.when(a["name"] == attr, F.struct(F.lit(href).cast("string").alias("href"), F.lit(True).alias("highlighted"))))
    got = rows.select(lex.markup(F.col("raw"), F.col("tag_name"), F.col("attrs"), chosen).alias("m")).first()["m"]
    assert [(r.kind, r.text) for r in got] == want
    assert all((r.href, r.highlighted) == ("test", True) for r in got if r.kind == "link")


def test_definitions_are_seen_by_later_lines_only(spark):
    body = '#EXTM3U\n{$A}x\n#EXT-X-DEFINE:NAME="A",VALUE="1"\n{$A}x\n#EXT-X-DEFINE:NAME="A",VALUE="2"\n#EXT-X-DEFINE:IMPORT="B"\n#EXT-X-DEFINE:QUERYPARAM="Q"\n#EXT-X-DEFINE:IMPORT="C"\n{$A}{$B}{$Q}{$C}'
    p = frame(spark, body).withColumns({"imported_definitions": F.create_map(F.lit("B"), F.lit("b")), "viewer_query": F.create_map(F.lit("Q"), F.lit("q"))})
    rows = state.definitions(lex.lines(p))
    assert [r.define_error for r in rows.filter("define_error IS NOT NULL").collect()] == ["no value for C"]
    got = links.link_rows(p).orderBy("line_no").collect()
    assert [r.resolved.split("/hls/")[1] for r in got] == ["%7B$A%7Dx", "1x", "2bq%7B$C%7D"]
    assert got[0].href.startswith("?playlist_url=https://example.com/hls/%257B$A%257Dx")


RULES = [
    ('ID="a",CLASS="com.apple.hls.preload",X-TARGET-CLASS="com.apple.hls.interstitial",X-URI="x/y.M3U8?z=/a.json"', "X-URI", "PLAYLIST"),
    ('ID="a",CLASS="com.apple.hls.preload",X-TARGET-CLASS="com.apple.hls.interstitial",X-URI="x/json"', "X-URI", "ASSET_LIST"),
    ('ID="a",CLASS="com.apple.hls.preload",X-TARGET-CLASS="com.apple.hls.interstitial",X-URI="x/y.txt"', "X-URI", None),
    ('ID="a",CLASS="com.apple.hls.preload",X-TARGET-CLASS="com.apple.hls.daterange-schedule",X-URI="x"', "X-URI", "DATERANGE_SCHEDULE"),
    ('ID="a",CLASS="com.apple.hls.preload",X-URI="x.m3u8"', "X-URI", None),
    ('ID="a",CLASS="com.apple.hls.daterange-schedule",X-URI="x"', "X-URI", "DATERANGE_SCHEDULE"),
    ('CLASS="com.apple.hls.daterange-schedule",X-URI="x"', "X-URI", None),
    ('X-ASSET-URI="x"', "X-ASSET-URI", "PLAYLIST"),
    ('X-ASSET-LIST="x"', "X-ASSET-LIST", None),
    ('ID="a",X-ASSET-LIST="x"', "X-ASSET-LIST", "ASSET_LIST"),
    ('ID="a",ID=b,SCTE35-IN="0x1"', "SCTE35-IN", None),
    ('ID=b,ID="a",SCTE35-IN="0x1"', "SCTE35-IN", "SCTE35"),
]


def test_daterange_rules(spark):
    body = "#EXTM3U\n" + "\n".join(f"#EXT-X-DATERANGE:{v}" for v, _, _ in RULES)
    got = {(r.line_no, r.attribute): r.link_type for r in links.link_rows(frame(spark, body)).collect()}
    assert got == {(k + 1, a): t for k, (_, a, t) in enumerate(RULES) if t}


def test_highlights(spark):
    body = '#EXTM3U\n#EXTINF:1,\na\n#EXT-X-MAP:URI="i"\n#EXT-X-PART:URI="p"\n#EXT-X-PART:URI="q"\nb\n#EXT-X-MAP:URI="i"\n#EXT-X-DATERANGE:ID="d",SCTE35-OUT="0x1",X-ASSET-LIST="l"\nc'
    found = links.link_rows(frame(spark, body)).cache()
    lit = lambda **k: sorted((r.line_no, r.text) for r in links.highlighted(found, **k).filter("is_highlighted").collect())
    url = "https://example.com/hls/i"
    assert lit(context_type="SEGMENT", media_sequence=1) == [(6, "b")]
    assert lit(context_type="MAP", media_sequence=1, url=url) == [(3, "i"), (7, "i")]
    assert lit(context_type="MAP", media_sequence=1, url=url, first_only=True) == [(3, "i")]
    assert lit(context_type="PART", media_sequence=1, part_index=1) == [(5, "q")]
    assert lit(context_type="SCTE35", daterange_id="d", command="OUT") == [(8, "0x1")]
    assert lit(context_type="ASSET_LIST", daterange_id="d") == [(8, "l")]


def test_stream_of_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.m3u8").write_text("#EXTM3U\n#EXTINF:1,\nseg\n")
    seen = {}
    rows = snapshots.read_snapshots(spark, str(tmp_path / "in"))
    query = snapshots.stateful(rows, lambda n, df: seen.update({r.raw: r.media_sequence for r in df.filter("kind = 'uri'").collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert seen == {"seg": 0}
    rate = snapshots.media_rate(snapshots.read_snapshots(spark, str(tmp_path / "in")))
    query = rate.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [r.n_uris for r in spark.table("rate").collect()] == [1]
