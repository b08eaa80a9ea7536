"""Classifiers by held-out figures and edge cases; mixing by totals; top-k and joins by brute force; the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamloom.llm import graph, jaccard, langid, mixing, quality, topk, words
from streamloom.llm.common import Scratch, byte_spans, fold_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None, None, None) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").cache()


def test_hashes_of_words():
    texts = ["A b\tc", "a  b c ", "", None, "x", "x\x1fy x", "É é", "a b a b a b"]
    h, rows = words.word_hashes(*byte_spans(pa.array(texts, pa.string())))
    per = [h[rows == k].tolist() for k in range(len(texts))]
    assert [len(p) for p in per] == [3, 3, 0, 0, 1, 2, 2, 6] and per[0] == per[1] and per[4][0] == per[5][1] and per[6][0] != per[6][1]
    v, at = words.shingles(*byte_spans(pa.array(texts, pa.string())), 3)
    assert np.diff(at).tolist() == [1, 1, 0, 0, 1, 1, 1, 2]
    morse = ""
    for k in range(1024):
        morse += "ab"[k.bit_count() & 1]
    odd = [morse, morse.translate(str.maketrans("ab", "ba")), *("x" * n for n in (7, 8, 9, 16, 17, 63, 64, 65, 66, 300)), "x" * 8 + "\0", "x" * 64 + "y", "x" * 65 + "y"]
    assert len(set(words.word_hashes(*byte_spans(pa.array(odd)))[0].tolist())) == len(odd)
    alone = [words.word_hashes(*byte_spans(pa.array([w.upper()])))[0][0] for w in odd]
    assert alone == words.word_hashes(*byte_spans(pa.array(odd)))[0].tolist()


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = quality.op7_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = rows.join(labels, "doc_id").filter("held_out").select("quality", "score", "predicted").collect()
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in got if a.quality for b in got if not b.quality]
    assert sum(pairs) / len(pairs) > 0.95
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.filter("score NOT BETWEEN 0 AND 1 OR score IS NULL OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0
    assert all(r.held_out == (fold_of(r.doc_id) == 0) for r in rows.collect())


def test_quality_edges(spark):
    docs = documents(spark, [(1, None, None, None), (2, "", None, None), (None, "plain text here", None, None), (2, "", None, None), (3, "word " * 40000, None, None)])
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs.drop("score"), quality.train(docs, labels))
    assert scored.count() == 5 and scored.filter("score IS NULL").count() == 0
    assert quality.train(docs, labels.limit(0)) is None and quality.score(docs.drop("score"), None).filter("score = 0.5").count() == 5
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_risk_turns_back_when_negative():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, 5)), rng.normal(-1, 1, (100, 5))
    scorer = quality.fit_nnpu(good[:200].astype(np.float32), np.concatenate([good[200:], bad]).astype(np.float32), 2 / 3, steps=300)
    assert scorer(good).mean() > 0.8 and scorer(bad).mean() < 0.4


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior_comes_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(int(prior * 10))
    positive = rng.normal(0, 1, (2000, 6)) + 1.5
    hidden = rng.random(4000) < prior
    unlabelled = rng.normal(0, 1, (4000, 6)) + np.where(hidden, 1.5, -1.5)[:, None]
    estimate = quality.estimate_prior(positive, unlabelled)
    assert abs(estimate - prior) < 0.05
    told = quality.fit_nnpu(positive, unlabelled, estimate)(unlabelled) >= 0.5
    assert (told == hidden).mean() > 0.97


def test_risk_by_brute_force():
    """No point of a grid has a lower non-negative risk than the weights that training ends with."""
    rng = np.random.default_rng(2)
    positive = rng.normal(1, 1, (300, 1))
    unlabelled = np.concatenate([rng.normal(1, 1, (150, 1)), rng.normal(-1, 1, (150, 1))])
    got = quality.fit_nnpu(positive, unlabelled, 0.5, steps=4000, rate=0.005, decay=0.0)

    def risk(w, b):
        loss = lambda x, sign: quality.sigmoid(-sign * ((x - got.mean) / got.scale @ w + b)).mean()
        return 0.5 * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - 0.5 * loss(positive, -1))

    reached = risk(got.weight, got.bias)
    grid = [(np.array([w]), b) for w in np.linspace(-6, 6, 25) for b in np.linspace(-3, 3, 25)]
    assert reached <= min(risk(w, b) for w, b in grid if abs(w[0]) <= abs(got.weight[0])) + 0.01


def test_features_piece_by_piece(monkeypatch):
    texts = pa.array(["ab" * 50, "", None, "x y y z" * 30, "É\n!"], pa.string())
    whole = quality.features(*byte_spans(texts))
    for piece in (1, 7, 64):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert np.array_equal(whole, quality.features(*byte_spans(texts)))


def test_names_that_clash(spark):
    docs = documents(spark, [(k, "some words here " * 5, "en", "s") for k in range(6)])
    assert quality.score(docs, None).columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert quality.score(docs, None).filter("score = 0.5").count() == 6
    told = langid.identify(docs, langid.train(docs))
    assert told.filter("lang_pred = 'en'").count() == 6 and sorted(told.columns) == sorted(docs.columns)


def test_language_held_out(spark, sf_dir, table):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = langid.op9_langid(spark, sf_dir).join(table.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(k, f"the cat and the dog number {k} went to the house", "en", "s") for k in range(30)] + [(100 + k, f"der hund und die katze nummer {k} gingen nach haus", "de", "s") for k in range(30)]
    odd = [(200, None, "en", None), (201, "", None, None), (202, "12 %% \n", "en", None), (None, "the dog", "en", None), (203, "the cat " * 30000, None, None), (203, "the cat " * 30000, None, None)]
    docs = documents(spark, rows + odd)
    net = langid.train(docs)
    assert net.languages == ["de", "en"]
    got = langid.identify(docs.drop("score", "lang_pred"), net).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (200, 201, 202)] == [("und", 0.0)] * 3
    assert sum(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 200) > 55
    assert {r.lang_pred for r in got if r.doc_id == 203} == {"en"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (200, 201, 202)").count() == 0
    empty = docs.limit(0)
    assert langid.train(empty) is None and langid.identify(docs.drop("score", "lang_pred"), None).filter("lang_pred = 'und'").count() == docs.count()


def test_folded_tables_change_nothing():
    net = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    plain = net.logits(x)
    net.fold()
    assert np.allclose(plain, net.logits(x), atol=1e-4)


# --- mixing


def water_fill(sizes, weights, cap=3):
    total, fixed, left = sum(sizes.values()), {}, dict(weights)
    while left:
        level = (total - sum(fixed.values())) / sum(left.values())
        full = [s for s in left if left[s] * level > cap * sizes[s]]
        if not full:
            return fixed | {s: left[s] * level for s in left}
        for s in full:
            fixed[s] = cap * sizes[s]
            del left[s]
    return fixed


def test_mixing_totals(spark):
    rng = random.Random(3)
    sources = {"a": 300, "b": 3, None: 200, "Z": 40, "é": 25}
    rows, k = [], 0
    for s, n in sources.items():
        for _ in range(n):
            rows.append((k, " ".join("w" * rng.randint(0, 60)), None, s))
            k += 1
    rows += [(k, None, None, "a"), (k + 1, " \n ", None, "b"), (None, "one two", None, "a"), (0, rows[0][1], None, "a")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(size, {s: 1.0 + i % 3 for i, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.times <= 3
        taken[r.source] += r.size * r.times
    assert all(abs(taken[s] - want[s]) <= 1 for s in sources), (taken, want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.apply_mix(docs.filter("doc_id > 0"))
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    rows = [(None if k % 3 == 0 else k % 7, " ".join("w" * rng.randint(1, 9)), None, "ab"[k % 2]) for k in range(60)]
    rows += [(None, "the same row", None, "a")] * 7 + [(5, "again", None, None)] * 3 + [(None, None, None, None)]
    docs = documents(spark, rows)
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.size * r.times
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    copies = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    for (_, text, source), n in copies.items():
        got[source] += len((text or "").split()) * n
    of_source = lambda s: sum(len((t or "").split()) for _, t, _, x in rows if x == s)
    target = water_fill({s: of_source(s) for s in ("a", "b", None)}, {"a": 1.0, "b": 2.0, None: 3.0})
    assert all(abs(got[s] - target[s]) <= 1 and abs(want[s] - target[s]) <= 1 for s in target), (got, want, target)
    there = Counter((i, t, s) for i, t, _, s in rows)
    assert all(n <= 3 * there[key] for key, n in copies.items())
    assert copies == Counter((r.doc_id, r.text, r.source) for r in mixing.apply_mix(docs.repartition(5)).collect())


def test_op10_over_the_table(spark, sf_dir):
    """Each source's words are as near to its target as any choice of whole documents comes, none twice unless all are needed."""
    rows = mixing.op10_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, targets, lengths = Counter(), Counter(), {}, {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len((d.text or "").encode().split())
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        targets[d.source] = r.target
        lengths.setdefault(d.source, []).append(r.size)
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(sizes, {s: 1.0 + i % 3 for i, s in enumerate(order)})
    for s in order:
        assert abs(targets[s] - want[s]) < 1e-6
        sums = 1
        for n in [n for n in lengths[s] for _ in range(3 if want[s] >= sizes[s] else 1) if n]:
            sums |= sums << n
        least = min(abs(k - want[s]) for k in range(sums.bit_length()) if sums >> k & 1)
        assert abs(taken[s] - want[s]) <= least + 1e-6, s


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_exact_where_it_can_be(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(6)}
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    for budget in range(0, sum(n * c for n, c in counts.items()) + 3, 3):
        got = mixing._knapsack(list(counts.items()), budget, budget + 45)
        total = sum(n * k for n, k in got.items())
        assert all(k <= counts[n] for n, k in got.items())
        assert abs(total - budget) == min(abs(s - budget) for s in sums if s <= budget + 45)
        whole = mixing.fit(counts, budget, {n: n for n in counts})
        assert all(k <= counts[n] for n, k in whole.items()) and abs(sum(n * k for n, k in whole.items()) - budget) <= max(counts)


@pytest.mark.parametrize(
    ("counts", "budget", "want"),
    [
        ({200_000: 1}, 180_000, {200_000: 1}),
        ({200_000: 1}, 100_000, {}),
        ({100_000: 3}, 180_000, {100_000: 2}),
        ({70_000: 1, 95_000: 1}, 80_000, {70_000: 1}),
        ({10_000_000: 1, 9_000_000: 2}, 6_000_000, {9_000_000: 1}),
        ({5: 1, 94: 1}, 50, {94: 1}),
    ],
)
def test_fit_of_few_long_documents(counts, budget, want):
    assert mixing.fit(counts, budget, {n: n for n in counts}) == want
    if len(counts) == 1 and want:
        plan = mixing._plan_source(mixing.pd.DataFrame({"source": ["a"], "size": list(counts), "n": list(counts.values()), "source_size": [sum(n * c for n, c in counts.items())], "target": [float(budget)]}))
        assert {n: p * counts[n] + w for n, p, w in zip(plan["size"], plan["passes"], plan["want"], strict=True)} == want


# --- top-k


@pytest.mark.parametrize("shape", ["random", "equal", "ties"])
def test_top_k_equals_brute_force(spark, shape, monkeypatch):
    rng = np.random.default_rng(7)
    x = {"random": rng.normal(0, 1, (300, 6)), "equal": np.ones((150, 3)), "ties": rng.integers(-1, 2, (250, 2)) / 8}[shape]
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(-20, None), (400, [float("nan")] * 6), (420, [None] * 6), (None, rows[0][1]), (440, [1.0]), (460, [2.0]), (441, [])]
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "LEAF", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    sound = [(k, [int(np.floor(64 * v)) for v in r]) for k, r in rows if k is not None and r is not None and all(v is not None and np.isfinite(v) for v in r)]
    want = []
    for qid, q in sound:
        if qid % 20 == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), k) for k, v in sound if k != qid and len(v) == len(q))[:20]
            want += [(qid, n + 1, k, -s) for n, (s, k) in enumerate(hits)]
    assert got == sorted(want)


def test_top_k_of_wide_components(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (200, 4))
    x[[20, 33, 140]] = [[3e6, 0, 1, 0], [5e6, 4e6, 0, -3e6], [2.5e6, -3e6, 0, 0]]
    x[57] = [-1e12, 0, 0, 0]  # scores beyond 64 bits with wide queries, never among the best
    x[60] = [0, 2.0**27, 0, 0]  # of scores over 2^53
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)] + [(201, [float("inf")] * 4)]
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    whole = [(k, [int(np.floor(64 * v)) for v in r]) for k, r in rows[:-1]]
    want = []
    for qid, q in whole[::20]:
        hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), k) for k, v in whole if k != qid)[:20]
        want += [(qid, n + 1, k, -s) for n, (s, k) in enumerate(hits)]
    assert got == sorted(want)
    for far in (1e12, 1e30):
        more = df.unionByName(spark.createDataFrame([(202, [far, 0.0, 0.0, 0.0])], df.schema))
        with pytest.raises(Exception, match="does not fit into 64 bits"):
            topk.top_k(more, F.col("vec_id") % 20 == 0).collect()


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0


# --- joins


def brute_classes(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}


def corpus(seed, n=180):
    """Copies, near copies at all distances, short texts, shared passages, chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([1, 2, 3, 4, 9, 30, 80, 200]))] for _ in range(25)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w = w + passage
        rows.append((k * 3, (rng.choice([" ", "\n"])).join(w).upper() if rng.random() < 0.1 else " ".join(w), None, None))
    return rows + [(1, None, None, None), (2, "", None, None), (4, " \t", None, None)]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 80, 3)])
def test_classes_equal_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(spark, rows), jaccard.Rule(k, percent)).collect()}
    assert got == brute_classes(rows, k, percent)


def test_links_of_a_large_group_grow_in_proportion(spark):
    """Copies about the limit of likeness: many pairs are like each other, but not like their hub, and none of them is written down."""
    rng, n = random.Random(3), 1000
    rows = [(k, " ".join(f"w{k}x{i}" if i in drop else f"b{i}" for i in range(100)), None, None) for k in range(n) for drop in [rng.sample(range(100), rng.randint(5, 7))]]
    docs, rule = documents(spark, rows), jaccard.Rule(1, 80)
    scratch = Scratch(spark, "test")
    links = jaccard._linked(docs, rule, scratch)[1]
    assert links.count() < 6 * n
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, rule).collect()} == brute_classes(rows, 1, 80)


@pytest.mark.parametrize("seed", range(4))
def test_teams_lose_no_link(seed):
    rng = random.Random(seed)
    rule, most = jaccard.Rule(1, 80), 300
    sets = []
    for base in range(3):
        for _ in range(20):
            drop = rng.sample(range(60), rng.randint(1, 8))
            sets.append(np.array(sorted({hash((base, i, rng.random() if i in drop else 0)) & (1 << 64) - 1 for i in range(60)}), np.uint64))
    root = np.array([rng.randrange(40) for _ in sets], np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    linked = [(x, y) for x in range(len(sets)) for y in range(x) if 100 * (both := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (len(sets[x]) + len(sets[y]) - both)]

    def classes(pairs):
        label = root.copy()
        for x, y in pairs:
            label[label == label[x]] = label[y]
        return {tuple(np.flatnonzero(label == c)) for c in label}

    found = jaccard.teams(root, size, jaccard.stack([jaccard.bitmap(s) for s in sets]), rule, most)
    assert all(size[places].sum() <= 2 * (most + 60) for places in found) and len(found) > 3
    links = [(places[x], places[y]) for places in found for x, y in jaccard.connect([sets[k] for k in places], root[places], rule)]
    assert set(map(frozenset, links)) <= set(map(frozenset, linked)) and classes(links) == classes(linked)
    alone = jaccard.connect(sets, root, rule)
    assert len(alone) < len(sets) and classes(alone) == classes(linked)


def test_classes_of_odd_tables(spark):
    rows = [(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None), (7, "a b c d e f", None, None), (9, "z " * 30000, None, None)]
    docs = documents(spark, rows)
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in jaccard.classes(docs).collect())))
    assert got == sorted(map(str, [(1, 1), (1, 1), (None, None), (7, 1), (9, 9)]))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "9", "None"]
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_ids_on_different_texts(spark):
    """An id's texts link all they are like; ``one_of_each`` keeps one of each kind of text."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts = [[word() for _ in range(60)] for _ in range(6)]
    near = lambda t: " ".join([*t[:-1], word()])
    rows = [(10, near(texts[0])), (11, near(texts[0])), (11, near(texts[1])), (12, near(texts[1])), (13, near(texts[2])), (9, near(texts[3])), (9, near(texts[4])), (9, near(texts[4])), (14, near(texts[4])), (15, near(texts[5])), (9, None), (16, "")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = {(r.doc_id, r.component_id) for r in jaccard.classes(docs).filter("n_shingles > 0").collect()}
    assert got == {(10, 10), (11, 10), (12, 10), (13, 13), (9, 9), (14, 9), (15, 15)}
    kept = sorted((str(r.doc_id), r.text or "") for r in jaccard.one_of_each(docs).collect())
    assert [i for i, _ in kept] == ["10", "11", "13", "15", "16", "9", "9", "9"]
    like = lambda t, k: sum(w in texts[k] for w in t.split()) > 50
    for k, least in ((0, "10"), (1, "11"), (2, "13"), (3, "9"), (4, "9"), (5, "15")):
        assert [i for i, t in kept if like(t, k)] == [least]
    assert kept == sorted((str(r.doc_id), r.text or "") for r in jaccard.one_of_each(docs.repartition(7)).collect())


def test_no_linked_pair_misses_a_key():
    rng = random.Random(8)
    for percent, k in ((90, 3), (80, 5)):
        rule = jaccard.Rule(k, percent)
        for _ in range(150):
            n = rng.choice([5, 12, 20, 40, 100, 400])
            a = {rng.getrandbits(64) for _ in range(n)}
            most = rule.apart(2 * n)
            b = set(a)
            for _ in range(rng.randint(0, most)):
                b.symmetric_difference_update({rng.choice(sorted(a)) if rng.random() < 0.5 else rng.getrandbits(64)})
            both = len(a & b)
            if not b or 100 * both < percent * len(a | b) or a == b:
                continue
            values = np.concatenate([np.array(sorted(s), np.uint64) for s in (a, b)])
            keys, rows = jaccard.keys_of(values, np.array([0, len(a), len(a) + len(b)]), rule)
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
            bits = [np.frombuffer(jaccard.bitmap(np.array(sorted(s), np.uint64)), np.uint8) for s in (a, b)]
            width = min(map(len, bits))
            assert np.bitwise_count(jaccard.fold(bits[0], width) ^ jaccard.fold(bits[1], width)).sum() <= len(a ^ b)
            found = jaccard.t_occurrence(np.array(sorted(a), np.uint64), [np.array(sorted(b), np.uint64), np.array([1], np.uint64)], rule)
            assert found == [0]


def test_merge_skip():
    rng = random.Random(0)
    for _ in range(100):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        count = Counter(x for li in lists for x in li)
        for least in (1, 2, 3, 5):
            assert jaccard.merge_skip([list(li) for li in lists], least) == {d: c for d, c in count.items() if c >= least}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# --- pipeline


def test_pipeline(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 2:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(v == i for i, (_, v) in brute_classes(rows, 5, 80).items())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    total = corpus_pipeline.run(spark, sf_dir)
    assert total.count() == counts[5] and {"doc_id", "n_tokens"} <= set(total.columns)


def test_pipeline_on_odd_tables(spark, sf_dir):
    """Nulls in any column, repeated rows, clashing names, an empty table: every stage keeps its columns and nothing fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = documents(spark, [(None, "one two three four five six", "en", None), (None, None, None, None), (-1, "", "en", "s"), (-2, "the cat sat on the mat " * 9, None, None), (-2, "the cat sat on the mat " * 9, None, None), (-3, "1 2 3", "xx", "")])
    named = {"score": F.lit("a"), "lang_pred": F.lit(1), "kept_id": F.lit(2), "mix_mark": F.lit(3), "mark": F.lit(4), "node": F.lit(5), "size": F.lit(6), "id": F.lit(7), "text2": F.lit(None).cast("string")}
    wide = docs.select(*docs.columns).unionByName(odd.select(*docs.columns)).withColumns(named)
    for table in (wide, wide.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, table = table, stage(spark, table, sf_dir).cache()
            n = table.count()
            if k < 4:
                assert table.columns == before.columns and (n > 0) == (before.count() > 0)
                if n:
                    assert {tuple(r) for r in table.select("score", "lang_pred", "kept_id", "mix_mark").distinct().collect()} == {("a", 1, 2, 3)}
            else:
                assert n == before.count()
