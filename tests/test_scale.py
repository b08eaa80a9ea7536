"""Work on a table of one row group is dealt over tasks in proportion to its rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from streamloom import box_queries
from streamloom.operators import box_fields, box_groups
from streamloom.plans import synth
from streamloom.queries import QUERIES

PARTS = 9_000


def test_media_of_one_row_group_are_many_tasks(spark, tmp_path):
    keys = list(range(1, PARTS + 1))
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_name": ["a"] * PARTS, "p_size": pa.array([1] * PARTS, pa.int32())}), tmp_path / "part.parquet")
    rows = box_queries.properties(spark, str(tmp_path), box_queries.MOVIE[:1])
    assert rows.rdd.getNumPartitions() >= 3
    found = rows.groupBy("p_partkey").count().collect()
    assert sorted(r["p_partkey"] for r in found) == keys and {r["count"] for r in found} == {4}


def exchanges(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1] for line in plan.split("\n") if "Exchange hashpartitioning(playlist_url" in line]


@pytest.mark.parametrize("name", ["playlist_segments", "playlist_summary", "daterange_links", "daterange_assets", "daterange_highlights", "media_links", "media_highlights"])
def test_playlists_are_dealt_over_tasks_once(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(synth, "TASK_LINES", 800)
    found = exchanges(QUERIES[name](spark, sf_dir))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]
    rows = 6000 if name.startswith("playlist") else 6000 if name.startswith("media") else 1500
    assert f", {-(-rows // 800)})" in found[0]


def test_boxes_of_one_kind_are_read_together_as_one_by_one():
    calls = []

    def decode(r):
        calls.append(1)
        return box_fields.described("tfhd", r)

    bodies = [bytes.fromhex("00000009") + k.to_bytes(4, "big") + bytes(7) + b"\5" + (2 * k).to_bytes(4, "big") for k in range(100)]
    table = np.frombuffer(b"".join(bodies), np.uint8).reshape(100, -1)
    [(members, (_, fields))] = box_groups.read(table, decode)
    assert len(calls) == 1 and members.tolist() == list(range(100))
    texts, tables = box_groups.texts_of(fields, 100)
    assert texts[0].to_pylist() == [str(k) for k in range(100)] and texts[3].to_pylist() == [str(2 * k) for k in range(100)] and not tables
    # Flags that differ part the group; numbers that decoders cannot reckon with leave boxes to be read one by one.
    odd = [bytes([0, 0, 0, 8 * (k % 2)]) + k.to_bytes(8, "big") for k in range(100)]
    found = box_groups.read(np.frombuffer(b"".join(odd), np.uint8).reshape(100, -1), decode)
    assert sorted(len(m) for m, _ in found) == [50, 50] and all(f for _, f in found)
    huge = np.frombuffer(b"".join(bytes([1, 0, 0, 0]) + (2**63 + k).to_bytes(8, "big") for k in range(100)), np.uint8).reshape(100, -1)
    assert [f for _, f in box_groups.read(huge, lambda r: box_fields.described("tfdt", r))] == [None]
