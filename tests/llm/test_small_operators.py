"""BPE, chat formatting, Matroska, URL filter: against the library, round trips, brute force and edge cases."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamloom.llm import bpe, chat, matroska, urls

TEXTS = [None, "", "   \n", "Hello it's we'll ÉÀß", "<|endoftext|>a<|startoftext|> B", "<|EndOfText|>", "x" * 3000, "ΑΣ İ é 가 ١٢ ²½", "a\x00b\x1f\x7f", "🙂 naïve 'tis 12345", "the the the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def documents(spark, texts):
    return spark.createDataFrame([(k, t, None, "s", -1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, ids long")


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdefgh '.,!\n<|>tionÉß0") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    got = {r.id: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == want, t
        assert got[k].decoded == library.decode(want, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe.digests(documents(spark, texts[:4])).collect()}
    assert digest[0].n_tokens == 0 and digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(documents(spark, [])).count() == 0


def test_bpe_parts(spark, library):
    codec = bpe.ForcedBoundaryBPE(open(bpe.default_path(), encoding="utf-8").read())
    words = ["zqxjk" * 40, "antidisestablishment", "qqqq", "a" * 500, "ab" * 300, "thethethe" * 50, "ab" * 15, "a", "ж" * 30, "aaaaaaa", "lossless"]
    asked = {f" {w}" for w in words}  # a space marks a word as it is
    for got in (codec._learn(asked), {w: codec._learn({w})[w] for w in asked}):  # side by side and each alone
        for word in words:
            ids = [*(codec.inner[b] for b in word.encode()[:-1]), codec.final[word.encode()[-1]]]
            assert np.frombuffer(got[f" {word}"], np.int32).tolist() == _plain_merge(codec, ids), word
    for text in ("a" * 500, "ab" * 300, "thethethe" * 50):
        ids = [int(codec.inner[b]) for b in text.encode()]
        assert codec._merge_long(list(ids)) == _plain_merge(codec, list(ids))
    back = bpe.decode(bpe.encode(documents(spark, ["hello there"])), id_col="id").first()
    assert back.decoded == "hello</w> there</w>"


def test_bpe_runs_equal_the_library(library):
    """Runs of all kinds of characters that stand side by side."""
    codec = bpe.ForcedBoundaryBPE(open(bpe.default_path(), encoding="utf-8").read())
    rng = random.Random(5)
    chars = ["a", "b", "the", "ing", "é", "ß", "ž", "Ł", "1", "23", "_", ".", ",", "'", "'s", "'re", "'ll", "-", "–", "—", "’", "“", "…", "&", "<", ">", " ", "\n", "  "]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["'", "''", "'s's", "–", "é–é", "…'t", "\t", " x ", "5'd6"]
    got = codec.encode_all(pa.array([*texts, None]))
    assert got[-1].tolist() == []
    for text, ids in zip(texts, got, strict=False):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_ranks_of_pairs():
    """Pairs are found by a hash; those of slots that several share are the only ones bisected, and few."""
    codec = bpe.ForcedBoundaryBPE(open(bpe.default_path(), encoding="utf-8").read())
    rng = np.random.default_rng(4)
    pairs = np.concatenate([codec.pairs, codec.pairs + 1, codec.pairs - 1, rng.integers(0, 49408, 50000) << 32 | rng.integers(0, 49408, 50000)])
    want = [codec.ranks.get(k, bpe.NEVER) for k in pairs.tolist()]
    assert codec._ranks(pairs >> 32, pairs & 0xFFFFFFFF).tolist() == want
    shared = codec.slot_pair[bpe.slots(codec.pairs)] == bpe.SHARED
    assert 0 < shared.mean() < 0.15


def test_bpe_store(monkeypatch, library):
    codec = bpe.ForcedBoundaryBPE(open(bpe.default_path(), encoding="utf-8").read())
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 4)
    texts = ["one, two three four", "five six seven, eight two", "", "one two <|endoftext|> nine", "привет one, two"]
    for _ in range(3):
        for t in texts:
            assert codec.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert max(map(len, codec.store.young)) <= 4 and len(codec.store.young) <= 5 + 5


def _plain_merge(codec, ids):
    while True:
        found = [(codec.ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (a << 32 | b) in codec.ranks]
        if not found:
            return ids
        rank, i = min(found)
        ids[i : i + 2] = [codec.merged[rank]]


def test_op1_over_the_table(spark, sf_dir, library):
    rows = bpe.op1_bpe(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- chat


LAYOUTS = {
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}': [("user", "a"), ("assistant", "")],
    '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': [("user", "a"), ("assistant", "b")],
    '{"prompt":"a","response":"b"}': [("user", "a"), ("assistant", "b")],
    '{"output":"b","input":"","instruction":"a"}': [("user", "a"), ("assistant", "b")],
    '{"data":{"input":{"text":"a"},"target":{"text":7}}}': [("user", "a"), ("assistant", "7")],
    '{"strange":1}': None,
    "[1]": None,
    "no json": None,
}


def test_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(k, r) for k, r in enumerate([*LAYOUTS, None])], "conv_id int, record string")
    got = {r.conv_id: r for r in chat.canonical(df).collect()}
    for k, want in enumerate([*LAYOUTS.values(), None]):
        assert (None if got[k].turns is None else [(t.role, t.text) for t in got[k].turns]) == want
    assert got[5].fingerprint and got[6].fingerprint is None
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b", "a"])
    own = chat.mappings([(["strange"], chat.layout(fixed=[("user", ["strange"])]))])
    assert chat.canonical(df, known=own).filter("turns IS NOT NULL").count() == 1


MORE = {
    '{"id":7,"prompt":"p","response":"r","meta":{"tags":["x"]}}': [("user", "p"), ("assistant", "r")],
    '{"messages":[{"role":"user","content":"a","name":"n"},{"role":"assistant","content":"b"}],"source":"s"}': [("user", "a"), ("assistant", "b")],
    '{"messages":[]}': [],
    '{"id":1,"conversations":[]}': [],
    '{"messages":[{"role":"user","content":"a"}],"system":"kept whole or not at all"}': None,
    '{"messages":[{"role":"user","content":"a"},{"role":"user","content":[{"type":"text"}]}]}': None,
    '{"messages":[{"role":"user","text":"a"},"b",[]]}': None,
    '{"prompt":"p","response":"r","completion":"which"}': None,
    '{"messages":[{"role":[],"text":"a"},{"role":5,"text":"b"}]}': [("[]", "a"), ("5", "b")],
}


def test_fields_without_mapping_are_ignored(spark):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(MORE)], "conv_id int, record string")
    got = {r.conv_id: r for r in chat.canonical(df).collect()}
    for k, want in enumerate(MORE.values()):
        assert (None if got[k].turns is None else [(t.role, t.text) for t in got[k].turns]) == want
    assert got[0].fingerprint == chat.fingerprint(["prompt", "response"])
    assert chat.format_chats(df).filter("conv_id = 2").first().formatted == ""


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "\\", "\\<|end|>\\", "<|end", "<<|end|>", "<\\|end|>", "<<SYS>><</SYS>>", "a\\\\b", "", "é🙂\n<|im_start|>", "[[INST]]"]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


def test_formatted_reads_back(spark):
    rng = random.Random(4)
    convs = {k: [(rng.choice(["user", "assistant", "system"]), "".join(rng.choice([*NASTY, "word "]) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 6))] for k in range(40)}
    rows = [(k, n, r, t) for k, v in convs.items() for n, (r, t) in enumerate(v)]
    rng.shuffle(rows)
    out = chat.format_chats(chat.conversations_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("back", chat.read_turns(F.col("formatted")))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.back] == convs[r.conv_id]
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        assert len(masked) == sum(role == "assistant" for role, _ in convs[r.conv_id])


def test_ties_nulls_and_empty_conversations(spark):
    rows = [(1, 5, "user", "b"), (1, 5, "user", "a"), (1, None, "assistant", None), (1, 9, None, "c"), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.turns for r in chat.canonical(chat.conversations_to_records(df)).collect()}
    assert [(m.role, m.text) for m in got[1]] == [("assistant", ""), ("user", "a"), ("user", "b"), ("user", "c")]
    assert [(m.role, m.text) for m in got[None]] == [("user", "n")]
    assert chat.format_chats(chat.conversations_to_records(df.limit(0))).count() == 0


def test_roles_of_rows_stay(spark, duck, tmp_path):
    said = [("human", "a"), ("gpt", "b"), ("", "c"), (None, "d"), ("Assistant", "e"), ("user", "x" * 300_000)]
    rows = [(k, n, r, t) for k in range(24) for n, (r, t) in enumerate(said[k % 5 : k % 5 + 2])]
    rows += [(100 + k, n, r, t) for k in range(24) for n, (r, t) in enumerate([("user", "q"), ("assistant", None)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    duck.execute(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    try:
        for conv, n_turns, turns, loss_chars, loss, chars in duck.execute(chat.OP3_SQL).fetchall():
            r = got.pop(conv)
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (n_turns, turns, loss_chars, loss, chars)
    finally:
        duck.execute("DROP VIEW temp.conversations")
    assert not got
    layouts = chat.canonical(chat.conversations_to_records(df).withColumn("turns", F.lit(1))).groupBy("fingerprint").count().collect()
    assert {r.fingerprint for r in layouts} == {chat.fingerprint(n) for n in (["prompt", "response"], ["messages[].role", "messages[].text"], ["messages[].role", "messages[].content"], ["dialog[].speaker", "dialog[].utterance"])}


def test_op3_over_the_table(spark, sf_dir):
    rows = {r.conv_id: r for r in chat.op3_chat(spark, sf_dir).collect()}
    said = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    said[-7] = [(0, "user", NASTY[0]), (1, "assistant", NASTY[0])]
    assert rows.keys() == said.keys()
    for k, turns in said.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (rows[k].n_turns, rows[k].loss_chars) == (len(turns), len(loss))
        assert rows[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert rows[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- Matroska


@pytest.mark.parametrize("lacing", matroska.LACINGS)
def test_mux_and_parse(lacing):
    rng = random.Random(1)
    for size in (1, 575, 576, 577, 576 * 8, 576 * 300 + 5):
        payload = bytes(rng.randrange(256) for _ in range(size)) if size < 6000 else bytes(size)
        if lacing == "fixed" and size % 576:
            payload = payload.ljust(-(-size // 576) * 576, b"\xff")
        data = matroska.mux(payload, lacing=lacing)
        parsed = matroska.Parsed(data)
        assert parsed.error is None and parsed.payload(data) == payload
        assert {p.lacing for p in parsed.packets} == {lacing} and all(p.keyframe for p in parsed.packets)
        assert [p.timestamp for p in parsed.packets[:3]] == [0, 0 if lacing != "none" else 72, 0 if lacing != "none" else 144][: len(parsed.packets)]
        assert len(parsed.cues) == parsed.clusters and all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in parsed.cues)
        assert parsed.tracks == {1: {"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "bits": 8}}


@pytest.mark.parametrize("lacing", matroska.LACINGS)
def test_times_of_laced_frames(spark, lacing):
    data = matroska.mux(bytes(576 * 300), lacing=lacing)
    parsed = matroska.Parsed(data)
    assert [p.time for p in parsed.packets] == [k * 72_000_000 for k in range(300)] and parsed.durations == {1: 72_000_000}
    assert ";last=21528;" in matroska.feature(parsed, parsed.payload(data))
    table = matroska.packets(spark.createDataFrame([(1, bytearray(data))], "id int, media binary"))
    assert [r.time for r in table.orderBy("packet_no").limit(9).collect()] == [k * 72_000_000 for k in range(9)]
    scaled = data.replace(matroska.uint(matroska.TIMESTAMP_SCALE, 1_000_000), matroska.uint(matroska.TIMESTAMP_SCALE, 2_000_000), 1)
    assert [p.time for p in matroska.Parsed(scaled).packets[:: 8 if lacing != "none" else 1][:2]] == [0, 2 * parsed.packets[8 if lacing != "none" else 1].time]


def test_unequal_laces_and_groups():
    frames = [b"a" * 300, b"b" * 1, b"c" * 900, b"d" * 255, b"e" * 7]
    el = matroska.element
    for kind, flag in (("xiph", 2), ("ebml", 6)):
        block = matroska.vint(2) + struct.pack(">hB", -5, flag) + matroska.lace(frames, kind)
        group = el(matroska.BLOCK_GROUP, el(matroska.BLOCK, block) + el(matroska.REFERENCE_BLOCK, b"\1"))
        cluster = matroska.CLUSTER_ID.to_bytes(4, "big") + b"\xff" + matroska.uint(matroska.TIMESTAMP, 100) + group
        data = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
        parsed = matroska.Parsed(data)
        assert parsed.error is None and parsed.clusters == 2
        assert [(p.track, p.timestamp, p.size, p.keyframe) for p in parsed.packets[:5]] == [(2, 95, len(f), False) for f in frames]
        assert parsed.payload(data, 2) == b"".join(frames) * 2


def test_broken_media():
    data = matroska.mux(bytes(576 * 20))
    for cut in (1, 5, 60, 300, len(data) - 3):
        parsed = matroska.Parsed(data[:cut])
        assert parsed.error
    data = matroska.mux(bytes(range(256)) * 2000)  # 889 packets in four clusters
    whole = matroska.Parsed(data).packets
    for cut in (len(data) - 3, len(data) - 200, len(data) * 2 // 3, len(data) // 5):
        parsed = matroska.Parsed(data[:cut])
        least = sum(p.offset + p.size <= cut for p in whole) - matroska.LACE  # all but those of the block that is cut
        assert "passes the end" in parsed.error and parsed.packets == whole[: len(parsed.packets)] and len(parsed.packets) >= max(1, least)
    assert matroska.Parsed(b"").error is None and matroska.Parsed(b"\0\0").error


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 1000, "a", "z" * 40000]
    df = documents(spark, texts)
    stored = matroska.store(df)
    got = {r.id: r for r in matroska.read_back(stored).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert bytes(got[k].payload) == raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw)) and got[k].error is None
    assert got[2].feature == got[4].feature and bytes(got[2].media) == bytes(got[4].media)
    packets = matroska.packets(stored)
    assert packets.filter("id = 5").count() == -(-40000 // 576)
    assert packets.filter("cued").groupBy("id").count().filter("id = 1").first()["count"] == 1
    short = matroska.packets(stored.filter("id = 5").withColumn("id", F.col("id").cast("smallint")))
    assert short.schema["id"].dataType.simpleString() == "smallint" and {r.id for r in short.collect()} == {5}
    moved = stored.filter("id = 5").first().media
    at = matroska.Parsed(bytes(moved)).cues[0][2]
    cue = matroska.uint(matroska.CUE_CLUSTER_POSITION, at - moved.index(matroska.uint(matroska.TIMESTAMP_SCALE, 1_000_000)) + 5)
    assert cue in bytes(moved)  # a cue that leads elsewhere marks nothing
    astray = bytes(moved).replace(cue, matroska.uint(matroska.CUE_CLUSTER_POSITION, at - moved.index(matroska.uint(matroska.TIMESTAMP_SCALE, 1_000_000)) + 6))
    assert matroska.packets(spark.createDataFrame([(1, bytearray(astray))], "id int, media binary")).filter("cued").count() == 0
    assert matroska.packets(stored.limit(0)).count() == 0 and matroska.packets(stored.withColumn("media", F.lit(None).cast("binary"))).count() == 0


def test_op4_over_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = matroska.op4_matroska(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, payload = matroska.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(matroska.mux(payload)).hexdigest()


# --- urls


URLS = ["https://A.Example.ORG/es/x?y", "http://example.org/en/123#t", "http://example.org/en/", "http://org/", "http://org", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "ftp://com/xx", "no url", None, "", "a://b://c/d", "http://user@com:80/fr/", "http://x.com//fr/", "//x.com/fr/"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def test_url_rules(spark):
    rng = random.Random(9)
    made = [f"http://{'.'.join(rng.choice(['a', 'b', 'com', 'org']) for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(['a', 'ab', 'abc', '']) for _ in range(rng.randint(0, 4)))}" for _ in range(200)]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in ("a", "com", "a.com", "b.a.com", "org") for p in ("", "/", "/a", "/ab/", "/ab/a", "/a/ab/abc")}.values())
    for chosen, texts in ((urls.RULES, URLS), (rules, made)):
        df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(texts)], "page_id int, url string, host string")
        trie = urls.judge(df, chosen)
        asked = df.drop("host").withColumns(dict(zip(("host", "path"), urls.host_and_path(F.col("url")), strict=True)))
        joined = urls._judge_by_join(asked, spark.createDataFrame(chosen, "verdict string, host string, path string"), "allow")
        for out in (trie, joined):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
            assert got == {k: brute(u, chosen) for k, u in enumerate(texts)}
    frame = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    assert urls.judge(df, frame).count() == len(made) and urls.judge(df, []).filter("verdict = 'allow'").count() == len(made)
    assert urls.judge(df.limit(0), urls.RULES).count() == 0


def test_op5_equals_its_sql(spark, sf_dir, duck):
    got = sorted((tuple(r) for r in urls.op5_url_filter(spark, sf_dir).collect()), key=str)
    assert got == sorted(duck.execute(urls.OP5_SQL).fetchall(), key=str)
