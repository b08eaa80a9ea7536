"""Language ID by a byte convolutional network: filters of several widths, max pooling and softmax, trained in numpy.

A text's UTF-8 bytes (A-Z as a-z) are cut into windows of a fixed length, all of them, the last one padded. A filter of
width w has a weight for each of 256 bytes at each of w places, so its response is a sum of table entries; pairs of
places are folded into one table for speed. Window logits are averaged by the bytes that a window holds.

Training takes a bounded sample (``MAX_TEXTS`` texts, smallest hashes of their ids, ``SAMPLE_CHARS`` characters of each
from a hashed place) of rows with a language whose crc32(doc_id as text) mod 5 is not 0. Prediction covers whole texts.
Null texts and texts without a letter are ``und`` with score 0; so is all if nothing could be learned. Ties go to the
language that sorts first. Repeated rows are told each; an empty table gives none. Windows pass the network ``CHUNK`` at a
time, whatever a text's length. Other columns are kept, and columns that have the new names are replaced.

The network has an output for each language, so their number is bounded: beyond ``MAX_LANGUAGES`` different values, the most
frequent are learned, and texts of the others are told as one of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import byte_spans, column, free_name, held_out, map_arrow, plus, slices, table

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
MAX_TEXTS, MAX_LANGUAGES, SAMPLE_CHARS = 6000, 2000, 600
UNKNOWN = "und"
#: Updates that training makes at least.
LEAST_STEPS = 400
#: The pipeline keeps texts of a language with at least this score.
LEAST_SCORE = 0.4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = np.arange(97, 123)
#: Windows that pass the network at a time.
CHUNK = 256


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, row of each, bytes in each): every text's bytes, padded with 0."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + at * WINDOW
    size = np.minimum(WINDOW, offsets[1:][row] - start)
    place = np.arange(WINDOW)
    index = np.minimum(start[:, None] + place, max(len(raw) - 1, 0))
    out = LOWER[raw[index]] if len(raw) else np.zeros((0, WINDOW), np.uint8)
    out[place >= size[:, None]] = 0
    return out, row, size


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.conv = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out = np.zeros(len(languages), np.float32)
        self.tables: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def fold(self) -> None:
        """Pairs of places become tables over 65,536 byte pairs."""
        self.tables = [[(k, (w[k][:, None, :] + w[k + 1][None, :, :]).reshape(-1, FILTERS)) if k + 1 < len(w) else (k, w[k]) for k in range(0, len(w), 2)] for w in self.conv]

    def _responses(self, x: np.ndarray, i: int) -> np.ndarray:
        w, steps = self.conv[i], WINDOW - WIDTHS[i] + 1
        if self.tables is None:
            return sum(w[k][x[:, k : k + steps]] for k in range(len(w)))
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = None
        for k, tab in self.tables[i]:
            part = np.take(tab, pair[:, k : k + steps] if len(tab) > 256 else x[:, k : k + steps], axis=0)
            out = part if out is None else np.add(out, part, out=out)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        pooled = [np.maximum(self._responses(x, i).max(1) + self.bias[i], 0) for i in range(len(WIDTHS))]
        return np.concatenate(pooled, 1) @ self.dense + self.out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adagrad; through max pooling only the places that won get a gradient. Small sets get more epochs."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, len(x))))
        params = [*self.conv, self.bias, self.dense, self.out]
        seen = [np.full(p.shape, 1e-3, np.float32) for p in params]

        def step(k: int, where, g: np.ndarray) -> None:
            seen[k][where] += g * g
            params[k][where] -= rate * 3 * g / np.sqrt(seen[k][where])

        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                bx, by = x[order[a : a + batch]], y[order[a : a + batch]]
                n = np.arange(len(bx))
                best, pooled = [], []
                for i in range(len(WIDTHS)):
                    r = self._responses(bx, i)
                    best.append(r.argmax(1))
                    pooled.append(np.take_along_axis(r, best[i][:, None, :], 1)[:, 0] + self.bias[i])
                h = np.maximum(np.concatenate(pooled, 1), 0)
                z = h @ self.dense + self.out
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[n, by] -= 1
                p /= len(bx)
                back = (p @ self.dense.T) * (h > 0)
                step(len(WIDTHS) + 1, ..., h.T @ p)
                step(len(WIDTHS) + 2, ..., p.sum(0))
                step(len(WIDTHS), ..., back.reshape(len(bx), len(WIDTHS), FILTERS).sum(0))
                for i, width in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(width):
                        byte = bx[n[:, None], best[i] + k]
                        full = np.zeros((256, FILTERS), np.float32)
                        np.add.at(full, (byte, np.arange(FILTERS)[None, :]), g)
                        step(i, k, full)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for every text; rows without bytes get zeros."""
        if self.tables is None:
            self.fold()
        x, row, size = windows(raw, offsets)
        z = np.zeros((len(offsets) - 1, len(self.languages)))
        for a in range(0, len(x), CHUNK):
            part = slice(a, a + CHUNK)
            np.add.at(z, row[part], self.logits(x[part]) * size[part, None])
        length = np.diff(offsets)[:, None]
        p = np.exp((z - z.max(1, keepdims=True)) / np.maximum(length, 1))
        return np.where(length > 0, p / p.sum(1, keepdims=True), 0)


def train(docs: DataFrame) -> ByteCNN | None:
    """A network from a bounded sample of the training folds, with equal shares of the languages as far as rows go."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    # The most frequent languages only, so that the list is bounded.
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.3 * MAX_TEXTS / len(counts) / r["count"]))])
    luck = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(47)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int")
    picked = rows.filter(luck < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("doc_id", "lang", F.col("text").substr(place, F.lit(SAMPLE_CHARS)).alias("part"))
    got = picked.orderBy(F.xxhash64("doc_id", F.lit(53)), "doc_id", "part").limit(MAX_TEXTS).collect()
    net = ByteCNN(sorted({r["lang"] for r in got}))
    x, row, size = windows(*byte_spans(pa.array([r["part"] for r in got], pa.string())))
    y = np.array([net.languages.index(r["lang"]) for r in got])
    enough = (size >= 64) | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]  # rests of longer texts teach little
    if not enough.any():
        return None
    net.fit(x[enough], y[row[enough]])
    return net


def identify(df: DataFrame, net: ByteCNN | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``df`` with each whole text's language and its probability, in place of any columns of these names."""
    df = df.drop(lang_name, score_name)
    shipped, keep = df.sparkSession.sparkContext.broadcast(net), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in slices(batches, text_col, 1 << 20):
            texts = column(b, text_col)
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()])
            if model is None or not letters.any():
                langs, scores = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            else:
                p = model.predict(*byte_spans(texts))
                langs = np.where(letters, np.array(model.languages, object)[p.argmax(1)], UNKNOWN)
                scores = np.where(letters, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64())], [*keep, lang_name, score_name])

    return map_arrow(df, run, plus(df.schema, **{lang_name: "string", score_name: "double"}))


def keep_known(df: DataFrame) -> DataFrame:
    """The rows whose text has a letter and a language told with at least ``LEAST_SCORE``, with the same columns."""
    lang, score = free_name(df, "lang_pred"), free_name(df, "score")
    told = identify(df, train(df.select("doc_id", "text", "lang")), lang_name=lang, score_name=score)
    return told.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.select("doc_id", "text", "lang"))
    told = identify(docs.select("doc_id", "text"), net)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
