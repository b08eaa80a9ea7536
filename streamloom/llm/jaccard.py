"""N-gram Jaccard join by T-occurrence search: which documents share so many word shingles that they are one.

A document's set holds the hashes of its distinct k-word shingles (fewer words: the whole sequence as one). Two sets of
a and b elements link when 100 * intersection >= percent * union, so they differ in at most
d = (a + b)(100 - percent) / (100 + percent) elements.

1. Candidates, without loss. Sets of a size class are cut by hash range into d + t segments, of which linked sets have t
   in common at least; fewer than t segments of a set that hold next to nothing may be left out. Equal segments are
   found by sorting (key, document) pairs, range-partitioned by both, so that a key of any frequency is spread over
   tasks. The first document of a key is its hub; the others become pairs with it: as many as there are postings.
2. A parity bitmap of each set bounds from below in how many elements two sets differ, and drops false pairs.
3. T-occurrence search decides each hub's pairs: over the hub's inverted lists, the short ones are merged with a heap
   (skipping what cannot reach the required overlap less the number of long ones), the long ones are probed by binary
   search (DivideSkip).
4. Around hubs whose documents are not all connected yet, the bitmaps compare documents of different components block by
   block. Those that they don't tell apart, directly or by way of others, are a team; pairs are never written down. Each
   team's sets are searched together until no two of its components link, and a link is kept only where it connects two
   of them. Then no linked pair of different components is left.

A node is a distinct set, named by a hash of all its elements: documents with equal sets are one node from the start.
Results are classes, never all pairs within a group.

Null and empty texts have no shingles and link with nothing; a null id links with nothing and has a null component.
Repeated rows are kept by ``classes``; different texts under one id link as one document there, while ``one_of_each`` asks
only whether texts are alike. Very long texts have larger sets and more segments; nothing is cut off. Ties of ids go by a hash
of the row. Empty tables give empty results. Other columns are kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import Scratch, apart, byte_spans, column, free_name, map_arrow, slices, table
from streamloom.llm.graph import components
from streamloom.llm.words import U, mix, shingles

#: Documents of a search block and of a side of a comparison block, about.
STAR, SIDE = 256, 1024
#: Bytes of sets that are searched at a time (one set may be larger).
STAR_BYTES = 32 << 20
#: Bits of the largest bitmap of document ids that is broadcast (32 MB).
MOST_BITS = 1 << 28
#: Weight of a heap step against a probe in the choice of long lists.
MU = 0.02


class Rule(NamedTuple):
    words: int = 5
    percent: int = 80

    def apart(self, size_sum):
        """In how many elements linked sets of these sizes together may differ."""
        return size_sum * (100 - self.percent) // (100 + self.percent)

    def overlap(self, size_sum):
        """The least intersection of linked sets of these sizes together."""
        return -(-size_sum * self.percent // (100 + self.percent))


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


#: First sizes of the size classes.
EDGES = _edges()


def segments(rule: Rule) -> tuple[np.ndarray, np.ndarray, int]:
    """For each size class: segments, how many of them linked sets share; and the least size of a segment that counts."""
    d = rule.apart(2 * (EDGES[1:] - 1))
    full = 2 if rule.percent >= 88 else 1
    spare = 3 + d * (5 if full == 2 else 15) // 100
    return np.where(d > 0, d + spare, 0), spare, full


def salt_of(cls: np.ndarray) -> np.ndarray:
    return cls.astype(U) * U(0x9FB21C651E98DF25)


def keys_of(values: np.ndarray, offsets: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Segment keys of sets (sorted hashes, row after row) and the row of each key."""
    per_class, spare, full = segments(rule)
    n = np.diff(offsets)
    cls = np.searchsorted(EDGES, n, "right") - 1
    mixed = mix(values)
    owner = np.repeat(np.arange(len(n)), n)
    out_keys, out_rows = [], []
    ahead = 0
    while True:  # a set meets its own class and those above whose sizes it can still link with
        at = cls + ahead
        rows = np.flatnonzero((n > 0) & (100 * n >= rule.percent * EDGES[np.maximum(at, 0)] if ahead else n > 0))
        if not len(rows):
            break
        rows = rows[per_class[at[rows]] > 0]
        if len(rows):
            used = np.zeros(len(n), bool)
            used[rows] = True
            pick = used[owner]
            v, m, o = values[pick], mixed[pick], owner[pick]
            seg = ((v >> U(32)) * per_class[at[o]].astype(U)) >> U(32)
            new = np.ones(len(v), bool)
            new[1:] = (o[1:] != o[:-1]) | (seg[1:] != seg[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(v)))
            sums, row, seg = np.add.reduceat(m, first), o[first], seg[first]
            solid = count >= full
            weak = per_class[at] - np.bincount(row[solid], minlength=len(n))
            few = weak < spare[at]
            keep = solid | ~few[row]
            salt = salt_of(at[row])
            key = mix(sums + mix(seg * U(0xA24BAED4963EE407) + salt) + count.astype(U))
            out_keys.append(key[keep])
            out_rows.append(row[keep])
            for r in rows[~few[rows]]:  # so many weak segments that the empty ones count as well
                there = seg[row == r]
                empty = np.setdiff1d(np.arange(per_class[at[r]]).astype(U), there)
                out_keys.append(mix(mix(empty * U(0xA24BAED4963EE407) + salt_of(at[r : r + 1]))))
                out_rows.append(np.full(len(empty), r))
        ahead += 1
    if not out_keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys, rows = np.concatenate(out_keys), np.concatenate(out_rows)
    order = np.argsort(rows, kind="stable")
    return keys[order], rows[order]


def bitmap(values: np.ndarray) -> bytes:
    """Parities of the counts of hashes by their low bits; between two and six bits for each element."""
    width = max(64, 1 << int(2 * int(EDGES[np.searchsorted(EDGES, len(values), "right") - 1]) - 1).bit_length())
    return np.packbits((np.bincount((values & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (last axis: bytes) as if made ``width`` bytes wide."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def can_link(na, nb, differ, rule: Rule):
    """Whether sets of these sizes that differ in ``differ`` elements at least may link."""
    return (differ <= rule.apart(na + nb)) & (100 * np.minimum(na, nb) >= rule.percent * np.maximum(na, nb))


# --- stages


def set_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set: of two independent sums over its elements and their number."""
    n, sums = np.diff(offsets), []
    for salt in (U(0x2545F4914F6CDD1D), U(0x5851F42D4C957F2D)):
        acc = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ salt))])
        sums.append(acc[offsets[1:]] - acc[offsets[:-1]])
    return mix(mix(sums[0] + n.astype(U)) ^ sums[1]).view(np.int64)


def _sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, mark, n, node, bits, keys) of each row's set; ``mark`` passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            values, offsets = shingles(*byte_spans(column(b, "text")), rule.words)
            n = np.diff(offsets)
            bits = [bitmap(values[a:z]) if z > a else b"" for a, z in zip(offsets, offsets[1:], strict=False)]
            keys, rows = keys_of(values, offsets, rule)
            at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "mark"), pa.array(n.astype(np.int64)), pa.array(set_ids(values, offsets)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64)))], ["doc_id", "mark", "n", "node", "bits", "keys"])

    return map_arrow(docs.select("doc_id", "mark", "text"), run, "doc_id long, mark long, n long, node long, bits binary, keys array<long>")


def _hub_pairs(postings: DataFrame) -> DataFrame:
    """(a, b): for each key its first node with each of the others. ``postings``: (key, node), not null."""
    names, ddl = ["cut", "key", "hub", "doc"], "cut boolean, key long, hub long, doc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = None
        in_first = True

        def rows(cut: bool, keys, hubs, docs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), cut)), pa.array(keys), pa.array(hubs), pa.array(docs)], names)

        for b in batches:
            if not b.num_rows:
                continue
            k, d = column(b, "key").to_numpy(), column(b, "node").to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = key is None or k[0] != key
            begin = np.flatnonzero(new)
            hubs = np.concatenate([[hub if hub is not None else d[0]], d[begin]])[np.cumsum(new)]
            start = 0
            if in_first:  # the first key may have begun in the task before: its rows are settled by key
                later = begin[1:] if key is None else begin
                start = int(later[0]) if len(later) else len(k)
                in_first = not len(later)
                yield rows(True, k[:start], d[:start], d[:start])
            differ = np.flatnonzero(hubs[start:] != d[start:]) + start
            if len(differ):
                pairs = np.unique(np.stack([hubs[differ], d[differ]], 1), axis=0)
                yield rows(False, np.zeros(len(pairs), np.int64), np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
            key, hub = int(k[-1]), int(hubs[-1])
        if key is not None and not in_first:  # the last key may go on in the next task
            yield rows(True, np.array([key]), np.array([hub]), np.array([hub]))

    dealt = postings.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return map_arrow(dealt, run, ddl)


def _settled(found: DataFrame) -> DataFrame:
    cut = found.filter("cut").select("key", "doc")
    first = cut.groupBy(F.col("key").alias("cut_key")).agg(F.min("doc").alias("hub"))
    # A task has one first key and one last key, so there are no more of them than twice the tasks.
    across = cut.join(F.broadcast(first), F.col("key") == F.col("cut_key")).select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    return found.filter("NOT cut").select(F.col("hub").alias("a"), F.col("doc").alias("b")).unionByName(across).filter("a <> b").distinct()


def _with_node(df: DataFrame, name: str, nodes: DataFrame, **columns: str) -> DataFrame:
    """Joins ``nodes`` on df[name]; ``columns``: new name -> column of nodes."""
    right = nodes.select(F.col(nodes.columns[0]).alias("_node"), *(F.col(c).alias(new) for new, c in columns.items()))
    return df.join(right, df[name] == right["_node"]).drop("_node")


def _by_bitmap(pairs: DataFrame, info: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't exclude."""
    both = _with_node(_with_node(pairs.select("a", "b"), "a", info, na="n", bits_a="bits"), "b", info, nb="n", bits_b="bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            na, nb = column(b, "na").to_numpy(), column(b, "nb").to_numpy()
            xs, ys = column(b, "bits_a").to_pylist(), column(b, "bits_b").to_pylist()
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(x), len(y))
                keep[i] = can_link(na[i], nb[i], int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum()), rule)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return map_arrow(both.select("a", "b", "na", "nb", "bits_a", "bits_b"), run, "a long, b long")


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], rule: Rule) -> list[int]:
    """Places in ``sets`` of those that link with the query, by DivideSkip over the query's inverted lists."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = len(query) + sizes
    fits = 100 * np.minimum(sizes, len(query)) >= rule.percent * np.maximum(sizes, len(query))
    if not len(query) or not fits.any():
        return []
    need = int(rule.overlap(total[fits]).min())
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = np.searchsorted(query, tokens)
    hit = query[np.minimum(place, len(query) - 1)] == tokens
    posts = np.sort(place[hit] * len(sets) + owner[hit])  # inverted lists, one after the other
    length = np.bincount(posts // len(sets), minlength=len(query))
    begin = np.concatenate([[0], np.cumsum(length)])
    n_long = min(need - 1, int(need / (MU * np.log2(max(1, length.max())) + 1)))
    order = np.argsort(length, kind="stable")
    short, long = order[: len(query) - n_long], order[len(query) - n_long :]
    lists = [(posts[begin[i] : begin[i + 1]] - i * len(sets)).tolist() for i in short if length[i]]
    found = merge_skip(lists, need - n_long)
    if not found:
        return []
    docs = np.array(list(found), np.int64)
    counts = np.array(list(found.values()), np.int64)
    for a in range(0, len(docs), 64):
        part = slice(a, a + 64)
        probe = long[None, :] * len(sets) + docs[part, None]
        at = np.minimum(np.searchsorted(posts, probe), len(posts) - 1)
        counts[part] += (posts[at] == probe).sum(1)
    union = total[docs] - counts
    return docs[100 * counts >= rule.percent * union].tolist()


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """How often each number stands in sorted lists, for those in at least ``least`` of them: a heap merge with skips."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while len(heap) >= least:
        doc, popped = heap[0][0], []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out[doc] = len(popped)
            goal = doc + 1
        else:  # no document before the next one on the heap, after as many more pops, can reach ``least``
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            goal = max(heap[0][0], doc + 1)
        for _, i, at in popped:
            at = bisect_left(lists[i], goal, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


def _sets(nodes: DataFrame, sketch: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, elements binary): the sets of ``nodes`` (one column, distinct), made where the texts are.

    A bitmap of the hashes of one text for each node goes to the tasks that read the texts; only sets of texts that it shows are
    sent on and joined. Its size follows the number of nodes up to a bound, beyond which more texts pass it, not fewer.
    """
    texts = sketch.join(nodes, sketch["node"] == nodes[nodes.columns[0]], "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
    n = nodes.count()
    bits = min(MOST_BITS, max(1 << 20, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("mark", F.lit(77)), F.lit(bits))
    marked = texts.select(place.alias("place")).groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    shipped = docs.sparkSession.sparkContext.broadcast({int(r["bucket"]) - 1: bytes(r["bits"]) for r in marked.collect()})
    per = 8 * 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((bits // per + 1) * 4096, np.uint8)
        for bucket, raw in shipped.value.items():
            table[bucket * 4096 : bucket * 4096 + len(raw)] = np.frombuffer(raw, np.uint8)
        for whole in batches:
            at = column(whole, "place").to_numpy()
            shown = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for b in slices(iter([whole.filter(pa.array(shown.astype(bool)))]), "text", 1 << 20):
                values, offsets = shingles(*byte_spans(column(b, "text")), rule.words)
                yield pa.RecordBatch.from_arrays([column(b, "mark"), pa.array(set_ids(values, offsets)), pa.array([values[x:y].tobytes() for x, y in zip(offsets, offsets[1:], strict=False)], pa.binary())], ["mark", "node", "elements"])

    made = map_arrow(docs.filter("doc_id IS NOT NULL").select("mark", "text", place.alias("place")), run, "mark long, node long, elements binary")
    # Of the rows that share a text, one is enough; most are dropped before anything is sent on.
    asked = texts.select(F.col("node").alias("asked"), F.col("mark").alias("asked_mark"))
    return made.join(asked, (F.col("node") == F.col("asked")) & (F.col("mark") == F.col("asked_mark")), "left_semi").dropDuplicates(["node"]).select("node", "elements")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link, by a search of each hub's set among those of its partners."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("blocks")).select(apart("a").alias("hub"), "blocks")
    member = pairs.join(hubs, F.col("a") == F.col("hub")).select(F.col("b").alias("doc"), "hub", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.lit(True).alias("member"))
    head = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("hub").alias("doc"), "hub", "block", F.lit(False).alias("member"))
    asked = member.unionByName(head)
    made = sets.join(asked, F.col("node") == F.col("doc")).select("hub", "block", "member", "doc", "elements")
    names = ["hub", "block", "member", "doc", "elements"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, members, ids, held = None, [], [], [], 0

        def done() -> pa.RecordBatch:
            hits = sorted({j for q in heads for j in t_occurrence(q, members, rule)}) if members else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(hits), pa.int64()), pa.array([ids[j] for j in hits], pa.int64())], ["a", "b"])

        for b in batches:
            for hub, block, is_member, doc, raw in zip(*(column(b, c).to_pylist() for c in names), strict=True):
                if (hub, block) != now:
                    if now:
                        yield done()
                    now, heads, members, ids, held = (hub, block), [], [], [], 0
                elif held >= STAR_BYTES:
                    yield done()
                    members, ids, held = [], [], 0
                (members if is_member else heads).append(np.frombuffer(raw, U))  # heads come first
                if is_member:
                    ids.append(doc)
                    held += len(raw)
        if now:
            yield done()

    return map_arrow(made.repartition("hub", "block").sortWithinPartitions("hub", "block", "member"), search, "a long, b long")


def _ends(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes that are in a pair."""
    return scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())


def teams(root: np.ndarray, n: np.ndarray, bits: np.ndarray, rule: Rule, most: int = STAR_BYTES // 16) -> list[np.ndarray]:
    """Places of the sets that bitmaps (rows of 64-bit numbers) don't tell from one of another root, or from a chain of such.

    A team of more than ``most`` elements is cut into parts, and every two parts are a team.
    """
    label, out = np.arange(len(root)), []
    for x in range(len(root)):
        others = np.flatnonzero((root[x + 1 :] != root[x]) & (label[x + 1 :] != label[x])) + x + 1
        others = others[100 * np.minimum(n[others], n[x]) >= rule.percent * np.maximum(n[others], n[x])]
        if len(others):
            differ = np.bitwise_count(bits[others] ^ bits[x]).sum(1, dtype=np.int64)
            _unite(label, x, others[can_link(n[others], n[x], differ, rule)])
    order = np.argsort(label, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(places) > 1:
            part = np.cumsum(n[places]) // most
            parts = np.split(places, np.flatnonzero(np.diff(part)) + 1)
            out += [places] if len(parts) == 1 else map(np.concatenate, combinations(parts, 2))
    return out


def _unite(label: np.ndarray, x: int, others: np.ndarray) -> None:
    """Gives the labels (below their number) of ``others`` up for that of ``x``."""
    gone = np.zeros(len(label), bool)
    gone[label[others]] = True
    label[gone[label]] = label[x]


def stack(raw: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit numbers, as wide as the least of them."""
    width = min(map(len, raw))
    return np.stack([fold(np.frombuffer(r, np.uint8), width) for r in raw]).view(np.uint64)


def connect(sets: list[np.ndarray], root: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Places of pairs that link, as many as it takes to connect all roots that linked pairs connect."""
    n, bits, out = np.array([len(s) for s in sets], np.int64), stack([bitmap(s) for s in sets]), []
    label = np.unique(root, return_inverse=True)[1]
    for x in range(len(sets)):
        others = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
        differ = np.bitwise_count(bits[others] ^ bits[x]).sum(1, dtype=np.int64)
        others = others[can_link(n[others], n[x], differ, rule)]
        if len(others):
            hits = others[t_occurrence(sets[x], [sets[y] for y in others], rule)]
            out += [(x, int(hits[k])) for k in np.unique(label[hits], return_index=True)[1]]
            _unite(label, x, hits)
    return out


def _rest_teams(pairs: DataFrame, roots: DataFrame, info: DataFrame, rule: Rule) -> DataFrame:
    """(team, doc, root): documents of different components, around hubs with several of them, that the bitmaps don't tell apart.

    A team is named by a hash of its documents, so one that is met around several hubs is searched once.
    """
    root = lambda df, name: df.join(roots.select(F.col("node").alias(f"{name}_node"), F.col("root").alias(f"{name}_root")), F.col(name) == F.col(f"{name}_node"), "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name)).drop(f"{name}_node")
    known = root(root(pairs.select("a", "b"), "a"), "b")
    hubs = known.groupBy("a").agg(F.max(F.col("a_root") != F.col("b_root")).alias("open"), F.ceil((F.count("*") + 1) / SIDE).cast("int").alias("sides"), F.count("*").alias("n_pairs")).filter("open AND n_pairs > 1").select(apart("a").alias("hub"), "sides")
    member = known.join(hubs, F.col("a") == F.col("hub")).select("hub", "sides", F.col("b").alias("doc"), F.col("b_root").alias("root"))
    head = root(hubs.select("hub", "sides", F.col("hub").alias("doc")), "doc").select("hub", "sides", "doc", F.col("doc_root").alias("root"))
    all_of = _with_node(member.unionByName(head), "doc", info, n="n", bits="bits")
    side = F.pmod(F.xxhash64("doc"), "sides").cast("int")
    blocks = all_of.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("hub", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "doc", "root", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            ids, root, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            found = teams(root, n, stack([r[3] for r in rows]), rule)
            places = np.concatenate([np.zeros(0, np.int64), *found])
            offsets = np.cumsum([0, *map(len, found)])
            names = np.repeat(set_ids(ids[places].view(U), offsets), np.diff(offsets))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids[places]), pa.array(root[places])], ["team", "doc", "root"])

        for b in batches:
            for hub, i, j, *row in zip(*(column(b, c).to_pylist() for c in ("hub", "i", "j", "doc", "root", "n", "bits")), strict=True):
                if (hub, i, j) != now:
                    if now:
                        yield done()
                    now, rows = (hub, i, j), []
                rows.append(row)
        if now:
            yield done()

    found = map_arrow(blocks.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "doc"), run, "team long, doc long, root long")
    return found.distinct()


def _connected(found: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect, in each team (team, doc, root), all roots that linked pairs of it connect."""
    made = sets.join(found, F.col("node") == F.col("doc")).select("team", "doc", "root", "elements")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            out = connect([np.frombuffer(r[2], U) for r in rows], np.array([r[1] for r in rows], np.int64), rule)
            return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][0] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for team, *row in zip(*(column(b, c).to_pylist() for c in ("team", "doc", "root", "elements")), strict=True):
                if team != now:
                    if rows:
                        yield done()
                    now, rows = team, []
                rows.append(row)
        if rows:
            yield done()

    return map_arrow(made.repartition("team").sortWithinPartitions("team", "doc"), search, "a long, b long").distinct()


def _linked(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, node) of every row, node null without shingles or id; and links (a, b) that connect all linked nodes."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    sketch = scratch.save(_sketches(docs, rule))
    sets = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    named = scratch.save(sketch.select("doc_id", "mark", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    found = scratch.save(_hub_pairs(sets.select(F.explode("keys").alias("key"), "node")))
    pairs = scratch.save(_settled(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(found)
    info = scratch.save(sets.select("node", "n", "bits").dropDuplicates(["node"]))
    scratch.drop(sketch)
    known = named.filter("node IS NOT NULL").select("node", "mark")
    likely = scratch.save(_by_bitmap(pairs, info, rule))
    first = scratch.save(_verified(likely, scratch.save(_sets(_ends(likely, scratch), known, docs, rule)), rule))
    more = scratch.save(_rest_teams(pairs, components(first, scratch), info, rule))
    second = _connected(more, scratch.save(_sets(scratch.save(more.select("doc").distinct()), known, docs, rule)), rule)
    return named, scratch.save(first.unionByName(second))


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest doc_id reachable by links."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    named, links = _linked(docs, rule, scratch)
    # An id that stands on different sets links them: each with the least of them.
    several = named.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    several = several.select(apart("doc_id").alias("of"), "least")
    alike = named.filter("node IS NOT NULL").join(several, F.col("doc_id") == F.col("of")).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    roots = components(links.unionByName(alike), scratch)
    rooted = named.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    rooted = scratch.save(rooted)
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component")).select(apart("root").alias("of"), "component")
    scratch.keep(rooted)
    out = rooted.join(least, F.col("root") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """One row of each class of alike texts: the one of the smallest id, with the same columns. Rows without id stay.

    Rows without shingles stay too, one of each id. Of rows with the same id and text, the one whose columns have the smallest
    hash is kept: any order of the rows gives the same.
    """
    scratch, name, mark = Scratch(docs.sparkSession, "distinct"), free_name(docs, "kept_id"), free_name(docs, "kept_mark")
    named, links = _linked(docs, rule, scratch)
    roots = components(links, scratch)
    rooted = named.filter("doc_id IS NOT NULL").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    first = F.min(F.struct("doc_id", "mark"))
    kept = rooted.filter("node IS NOT NULL").groupBy(F.coalesce("root", "node")).agg(first.alias("r"))
    kept = kept.select("r").unionByName(rooted.filter("node IS NULL").groupBy("doc_id").agg(first.alias("r")).select("r"))
    kept = scratch.save(kept.select(F.col("r.doc_id").alias(name), F.col("r.mark").alias(mark)).distinct())
    scratch.keep(kept)
    rows = docs.filter("doc_id IS NOT NULL").join(kept, (F.col("doc_id") == F.col(name)) & (F.xxhash64("text") == F.col(mark)))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = rows.groupBy(name, mark).agg(F.min_by(whole, F.xxhash64(whole)).alias("_row")).select("_row.*")
    return best.unionByName(docs.filter("doc_id IS NULL"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), Rule(words=3, percent=90))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
