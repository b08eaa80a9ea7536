"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are word counts. A source's target is its weight's share of the total, at most ``MAX_EPOCHS`` times its own size;
the excess is shared again by weight until none is above. Whole passes over a source come first. For the rest of its
budget, its documents are counted by exact length; a common share of every length is taken, and bounded-knapsack
dynamic programming over the lengths left fits the remaining words. Which documents of a length are taken is decided by
a seeded hash of their ids, so reruns agree.

Counting by (source, length, hash bucket) is a pre-aggregated shuffle; only the one bucket of a length that is taken in
part is ranked, so neither a hot source nor a hot length meets in one task. The dynamic programme of a source sees the
counts of its lengths, never its documents.

Null texts have size 0 and are taken 0 times; a null source is a source, last in order. Documents of equal id and size
are ranked as equals and share a rank by their order in the bucket; repeated rows count each. A text of any length is one
length among its source's. Empty tables give none. Other columns are not read by ``mix`` and kept by ``apply_mix``, which
tells rows apart by all their columns: rows that share an id, or have none, are taken each as often as the mix says, and
rows that are alike in everything share what is taken of them.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.llm.common import Scratch, free_name, table

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hash buckets of a length: the ranked part of a hot length is about this fraction of it.
BUCKETS = 256
#: Words that dynamic programming fits exactly, at most; larger rests are first filled length by length.
FIT_WORDS = 1 << 15
SEED = 20240


def size_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, weight): weights repeat over the sources by code point, null last.

    Ranks come from a range partitioning of the distinct sources: place in the partition plus the partition's offset.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = scratch.save(totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # One row for each partition, not for each source.
    counts = dict(sorted(placed.groupBy(part.alias("part")).count().collect()))
    before, offsets = 0, []
    for p, n in counts.items():
        offsets += [F.lit(p), F.lit(before)]
        before += n
    rank = (F.col("place") - F.shiftleft(part, 33) + (F.create_map(*offsets)[part] if offsets else F.lit(0))).cast("long")
    return placed.select("source", "source_size", F.array(*map(F.lit, map(float, weights)))[(rank % len(weights)).cast("int")].alias("weight"))


def with_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``. Only sums travel to the driver; a round fixes at least one more source at its cap or is the last."""
    cap = F.col("source_size") * float(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = cap <= F.col("weight") * level
        fixed, weight = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            break
        now = max(0.0, total - (fixed or 0.0)) / weight
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(cap, F.col("weight") * level))


def fit(counts: dict[int, int], budget: int, order: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be found.

    ``order``: a seeded number for each length, to break ties without favouring any length.
    """
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(counts)
    taken = {n: c * budget // total for n, c in counts.items()}
    rest = budget - sum(n * t for n, t in taken.items())
    by_seed = sorted(counts, key=lambda n: (order[n], n))
    progress = True
    while rest > FIT_WORDS and progress:
        progress = False
        for n in by_seed:
            if n <= rest - FIT_WORDS // 2 and taken[n] < counts[n]:
                taken[n] += 1
                rest -= n
                progress = True
    best, off = taken, rest
    while True:
        found = _nearest([(n, counts[n] - taken[n]) for n in by_seed if counts[n] > taken[n]], rest)
        now = abs(rest - sum(n * k for n, k in found.items()))
        if now < off:
            best, off = {n: t + found.get(n, 0) for n, t in taken.items()}, now
        # Not met: documents are handed back, so that more sums are open, until the rest is as large as may be.
        goal, taken = 2 * max(rest, 1), dict(taken)
        while off and rest < min(goal, FIT_WORDS) and any(taken.values()):
            for n in by_seed:
                if taken[n] and rest < goal:
                    taken[n] -= 1
                    rest += n
        if not off or rest < goal:
            return {n: t for n, t in best.items() if t}


def _nearest(left: list[tuple[int, int]], rest: int) -> dict[int, int]:
    """Which of (length, documents left) to take so that their words come nearest to ``rest``."""
    # Taking none more is ``rest`` words off, so the nearest sum is at most twice ``rest``.
    if rest > 2 * FIT_WORDS:
        # All documents left are longer than rest - FIT_WORDS / 2: any two are further off than the best one or none.
        one = min((n for n, _ in left), key=lambda n: (abs(n - rest), n), default=0)
        return {one: 1} if abs(one - rest) < rest else {}
    return _knapsack([(n, c) for n, c in left if n <= 2 * rest], rest, 2 * rest)


def _knapsack(items: list[tuple[int, int]], target: int, reach: int) -> dict[int, int]:
    """Bounded subset sum: sums up to ``reach`` as bits of an integer, counts split into powers of two."""
    mask, sums, steps = (1 << reach + 1) - 1, 1, []
    for n, c in items:
        c, unit = min(c, reach // n), 1
        while c > 0:
            k = min(unit, c)
            steps.append((sums, n, k))
            sums |= (sums << n * k) & mask
            c, unit = c - k, unit * 2
        if sums >> target & 1:
            break
    best = next(s for d in range(target + 1) for s in (target - d, target + d) if s <= reach and sums >> s & 1)
    out: Counter = Counter()
    for before, n, k in reversed(steps):
        if not before >> best & 1:
            best -= n * k
            out[n] += k
    return out


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each length of a source: how often all of its documents are taken, and how many of them once more."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(min(MAX_EPOCHS, target // size)) if size else 0
    counts = {int(n): int(c) for n, c in zip(pdf["size"], pdf["n"], strict=True) if n > 0}
    order = {n: (n * 2654435761 + SEED) % (1 << 32) for n in counts}
    more = fit(counts, round(target - passes * size), order) if passes < MAX_EPOCHS else {}
    takes = {n: c * passes + more.get(n, 0) for n, c in counts.items()}
    off = lambda t: abs(sum(n * k for n, k in t.items()) - target)
    if passes and off(takes) > 0.5:  # takes that are less even may come nearer
        uneven = fit({n: MAX_EPOCHS * c for n, c in counts.items()}, round(target), order)
        takes = min(takes, uneven, key=off)
    each = [divmod(takes.get(int(n), 0), counts.get(int(n), 1)) for n in pdf["size"]]
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": [p for p, _ in each], "want": [w for _, w in each]})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, times): how often the mix takes each document."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(BUCKETS)).cast("int")
    sizes = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")).withColumn("bucket", bucket))
    sources = scratch.save(with_targets(weighted_sources(sizes, scratch)))
    buckets = sizes.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    lengths = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.join(sources, lengths["source"].eqNullSafe(sources["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    plan = scratch.save(lengths.groupBy("source").applyInPandas(_plan_source, "source string, size long, passes int, want long"))
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "passes", "want")
    up_to = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    buckets = buckets.withColumn("before", up_to)
    buckets = buckets.join(p, buckets["source"].eqNullSafe(p["p_source"]) & (buckets["size"] == p["p_size"]))
    share = F.greatest(F.col("want") - F.col("before"), F.lit(0))
    b = buckets.select("p_source", "p_size", F.col("bucket").alias("p_bucket"), "passes", (share >= F.col("n")).alias("whole"), F.when(share < F.col("n"), share).otherwise(0).alias("part"))
    joined = sizes.join(b, sizes["source"].eqNullSafe(b["p_source"]) & (sizes["size"] == b["p_size"]) & (sizes["bucket"] == b["p_bucket"])).drop("p_source", "p_size", "p_bucket")
    luck = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id")
    # Only the buckets that are taken in part are ranked.
    ranked = joined.filter("part > 0").withColumn("more", (F.row_number().over(luck) <= F.col("part")).cast("int"))
    plain = joined.filter("part = 0").withColumn("more", F.col("whole").cast("int"))
    out = ranked.unionByName(plain).withColumn("times", F.col("passes") + F.col("more"))
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target")
    return out.join(F.broadcast(s) if _few(s) else s, out["source"].eqNullSafe(s["s_source"])).select("doc_id", "size", "source", "source_size", "target", "times")


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    return len(sources.select(F.lit(1)).limit(most + 1).collect()) <= most


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with the same columns."""
    mark, times, rows, copy = (free_name(docs, f"mix_{n}") for n in ("mark", "times", "rows", "copy"))
    marked = docs.withColumn(mark, F.xxhash64(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    plan = mix(marked, id_col=mark).groupBy(F.col("doc_id").alias(mark)).agg(F.sum("times").alias(times), F.count("*").alias(rows)).filter(F.col(times) > 0)
    out = marked.join(plan, mark)
    # Rows that are alike share their takes evenly; the join has put them in order already.
    place = F.row_number().over(Window.partitionBy(mark).orderBy(mark))
    share = F.floor(F.col(times) / F.col(rows)) + (place <= F.col(times) % F.col(rows)).cast("int")
    out = out.withColumn(copy, share).filter(F.col(copy) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).drop(mark, times, rows, copy)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
