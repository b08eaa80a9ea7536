"""Packing: the tree against a scan, and every document put together again from its rows."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from streamloom.llm import bpe, packing


def scan_fit(lengths, most):
    rows, room = [], []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in room if c >= lengths[k]]
        if fits:
            n = room.index(min(fits))
        else:
            n = len(rows)
            rows.append([])
            room.append(most)
        rows[n].append(k)
        room[n] -= lengths[k]
    return room


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_the_best_fit(seed):
    rng = random.Random(seed)
    most = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, most) for _ in range(300)]
    rows = packing.best_fit(lengths, most)
    assert sorted(k for r in rows for k in r) == list(range(300))
    room = [most - sum(lengths[k] for k in r) for r in rows]
    assert min(room) >= 0 and sorted(room) == sorted(scan_fit(lengths, most))
    assert packing.best_fit([], most) == []


def unpacked(rows):
    found = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.segments) == r.n_segments
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert b - a == s.length and positions[a:b].tolist() == list(range(s.length))
            found.setdefault(s.doc_id, {})[s.offset] = ids[a:b].tolist()
        assert (ids[r.n_tokens :] == packing.PAD).all() and (positions[r.n_tokens :] == 0).all()
    return {d: [i for at in sorted(parts) for i in parts[at]] for d, parts in found.items()}


def test_documents_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 300)
    texts = [None, "", "one two", "word " * 700, "a b c d e f g", "x", "x"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    want = {r.id: r.ids for r in bpe.encode(df).collect() if r.ids}
    assert unpacked(packing.pack(df, row_tokens=64).collect()) == want
    assert packing.pack(df.limit(0)).count() == 0
    nameless = packing.pack(df.withColumn("doc_id", F.lit(None).cast("long")), row_tokens=64)
    assert nameless.agg(F.sum("n_tokens")).first()[0] == sum(map(len, want.values()))
    assert {s.doc_id for r in nameless.collect() for s in r.segments} == {None}


def test_op2_over_the_table(spark, sf_dir):
    rows = packing.op2_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert unpacked(rows) == {r.id: r.ids for r in bpe.encode(docs).collect() if r.ids}
    assert len({r.row_id for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) / (len(rows) * packing.ROW_TOKENS) > 0.95
