"""BPE encoding and decoding with forced boundaries.

A byte pair that stands inside no vocabulary token can never be merged over. Each word is therefore cut at every such
pair, the fragments are encoded on their own, and their ids are concatenated. A batch of texts is encoded at once: its
distinct runs of non-space characters are looked up in a bounded store, the words of those not met before are cut into
fragments, and all fragments are merged side by side in numpy, a merge of each a round.

Supports the word-end kind of BPE file: normaliser, word pattern, byte alphabet, merges with an end-of-word suffix, no
decoder. Special tokens standing in a text become their ids, as the file says.

Nulls count as empty texts: no ids, empty decoded text. Very long fragments are merged with a heap, so time stays near
linear. Of merges of equal rank the leftmost comes first. Repeated rows give repeated results; empty tables give empty
tables; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import column, map_arrow, slices, table

#: A tokenizer file larger than this is refused rather than broadcast.
MAX_FILE_BYTES = 64 << 20
#: Runs that a Python worker's store remembers in each of two generations (some 30 MB), and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 64
#: Fragments of more bytes than this are merged with a heap.
LONG = 40
#: Kinds of the bytes of SIMPLE texts that words end between; the marks outside ASCII are three bytes from 0xE2 on.
LETTER, DIGIT, MARK = range(3)
KINDS = np.full(256, LETTER, np.uint8)
KINDS[:128] = [LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(128)]
KINDS[0xE2] = MARK
#: The rank of pairs that do not merge.
NEVER = np.int64(1 << 62)
#: Slots of the hash of pairs; what stands in one without a pair, and in one of several.
SLOT_BITS, NO_PAIR, SHARED = 19, np.int64(-1), np.int64(-2)
#: Texts of these characters need no library normaliser: they are composed already, and their classes never changed.
SIMPLE_CHARS = "\\t\\n\\r\\x20-\\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e\u2013\u2014\u2018-\u201e\u2026"
SIMPLE, SIMPLE_PATTERN = re.compile(f"[{SIMPLE_CHARS}]*"), f"^[{SIMPLE_CHARS}]*$"
#: The word pattern of the file, and the same over SIMPLE texts in terms of the standard library.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


class Store:
    """Ids by text in two generations: what is met goes to the young one; when that is full, the old one is forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def take(self, wanted: list[str], make) -> list[bytes]:
        """The ids of each text wanted; what the store lacks is made, long texts each time."""
        if len(self.young) >= CACHE_ENTRIES:
            self.young, self.old = {"": b""}, self.young
        out = list(map(self.young.get, wanted))
        if lacking := [k for k, ids in enumerate(out) if ids is None]:
            texts = [wanted[k] for k in lacking]
            found = list(map(self.old.get, texts))
            made = make({t for t, ids in zip(texts, found, strict=True) if ids is None})
            found = [made[t] if ids is None else ids for t, ids in zip(texts, found, strict=True)]
            for k, ids in zip(lacking, found, strict=True):
                out[k] = ids
            self.young.update(zip(texts, found, strict=True) if max(map(len, texts)) <= CACHE_CHARS else ((t, ids) for t, ids in zip(texts, found, strict=True) if len(t) <= CACHE_CHARS))
        return out


class ForcedBoundaryBPE:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        raw = json.loads(spec)
        model = raw["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        split = next(p for p in raw["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"] != {"Regex": WORD_PATTERN} or not self.suffix or raw["decoder"] is not None:
            raise ValueError("only word-end BPE files with the known word pattern are supported")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: left id * 2**32 + right id -> rank; rank -> merged id
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        pairs = np.array(list(self.ranks), np.int64)
        by_pair = np.argsort(pairs)
        self.pairs, self.rank_of_pair = pairs[by_pair], np.array(list(self.ranks.values()), np.int64)[by_pair]
        #: Pairs by a hash; a slot that several share says so, and these are found by bisection.
        slot = slots(self.pairs)
        self.slot_pair, self.slot_rank = np.full(1 << SLOT_BITS, NO_PAIR), np.full(1 << SLOT_BITS, NEVER)
        self.slot_pair[slot], self.slot_rank[slot] = self.pairs, self.rank_of_pair
        self.slot_pair[np.bincount(slot, minlength=1 << SLOT_BITS) > 1] = SHARED
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.token_of = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.inner = np.array([self.vocab[c] for c in self.alphabet], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in self.alphabet], np.int64)
        library = Tokenizer.from_str(spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.joined = self._pairs_inside_tokens()
        #: Ids of runs as 32-bit numbers, one after the other.
        self.store = Store()

    def _pairs_inside_tokens(self) -> np.ndarray:
        """[a, b] is True where byte b follows byte a inside some vocabulary token; all other pairs are certain cuts."""
        joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token.removesuffix(self.suffix)
            data = [self.byte_of[c] for c in body]
            if len(data) > 1:
                joined[data[:-1], data[1:]] = True
        return joined

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER for pairs that do not merge."""
        key = left << 32 | right
        slot = slots(key)
        pair = self.slot_pair[slot]
        rank = np.where(pair == key, self.slot_rank[slot], NEVER)
        if len(shared := np.flatnonzero(pair == SHARED)):
            key = key[shared]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank[shared] = np.where(self.pairs[at] == key, self.rank_of_pair[at], NEVER)
        return rank

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """The ids of runs: all are cut into words and fragments, and merged, at once."""
        odd = [r for r in runs if "'" in r or r[0] == " "]
        plain = list(runs.difference(odd))
        out = {r: np.int32(self.special[r[2:]]).tobytes() for r in odd if r.startswith("  ")}
        odd = [r for r in odd if r not in out]
        # Words of these are known or need the pattern; those of all others begin where the kind of character changes.
        words = [[r[1:]] if r[0] == " " else SIMPLE_WORDS.findall(r) for r in odd]
        pieces = [*plain, *chain.from_iterable(words)]
        if not pieces:
            return out
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        first = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # bytes that characters begin with
        ends = first[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        start = np.zeros(len(raw), bool)
        start[0], start[ends[:-1]] = True, True
        upto = int(ends[len(plain) - 1]) if plain else 0
        kind = KINDS[raw[:upto]]
        lead = np.flatnonzero(raw[:upto] == 0xE2)
        kind[lead + 1], kind[lead + 2] = MARK, MARK
        start[1:upto] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        ids, last = self.inner[raw], np.append(np.flatnonzero(start)[1:], len(raw)) - 1
        ids[last] = self.final[raw[last]]
        start[1:] |= ~self.joined[raw[:-1], raw[1:]]
        place, ids = self._merge(ids, start)
        n_pieces = np.cumsum([1] * len(plain) + list(map(len, words)))
        data, at = ids.astype(np.int32).tobytes(), 0
        for run, end in zip(chain(plain, odd), (np.searchsorted(place, ends[n_pieces - 1]) * 4).tolist(), strict=True):
            out[run], at = data[at:end], end
        return out

    def _merge(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges inside fragments, which begin at ``cut``: by lowest rank, leftmost first. Places (of first bytes) and ids."""
        place, begin = np.arange(len(ids)), np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(ids)))
        done = []
        if (length > LONG).any():
            for a, n in zip(begin[length > LONG].tolist(), length[length > LONG].tolist(), strict=True):
                merged = np.array(self._merge_long(ids[a : a + n].tolist()), np.int64)
                done.append((np.arange(a, a + len(merged)), merged))
            short = np.repeat(length <= LONG, length)
            ids, place, length = ids[short], place[short], length[length <= LONG]
        begin = np.cumsum(length) - length
        rank = np.full(len(ids), NEVER)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[begin[1:] - 1] = NEVER
        rank[-1:] = NEVER
        while len(ids):
            least = np.minimum.reduceat(rank, begin)
            if (idle := least == NEVER).any():
                over = np.repeat(idle, length)
                done.append((place[over], ids[over]))
                ids, place, rank, length, least = ids[~over], place[~over], rank[~over], length[~idle], least[~idle]
                begin = np.cumsum(length) - length
                if not len(ids):
                    break
            fragment = np.repeat(np.arange(len(length)), length)
            at = np.flatnonzero(rank == least[fragment])
            first = np.ones(len(at), bool)
            first[1:] = fragment[at[1:]] != fragment[at[:-1]]
            at = at[first]  # one of each fragment
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # NEVER if the pair stood last; else put right below
            ids, place, rank = ids[keep], place[keep], rank[keep]
            at -= np.arange(len(at))  # as many places before each went
            length = length - 1
            begin = np.cumsum(length) - length
            right = at[at < begin + length - 1]
            left = at[at > begin] - 1
            rank[right] = self._ranks(ids[right], ids[right + 1])
            rank[left] = self._ranks(ids[left], ids[left + 1])
        if not done:
            return place, ids
        place, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return place[order], ids[order]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n instead of n squared."""
        n, rank = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def _runs(self, text: str) -> list[str]:
        """Runs of non-space characters in lower case; behind one space: a word as it is; behind two: a special token."""
        if self.specials is None or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._plain(text[at : m.start()]), f"  {m.group()}"]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return text.lower().split()
        # Any other script: the library's own normaliser and word splitter.
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [" " + bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array (null: none)."""
        texts = pc.fill_null(texts, "")
        simple = pc.match_substring_regex(texts, SIMPLE_PATTERN).to_numpy(zero_copy_only=False)
        if self.specials is not None:
            for k in np.flatnonzero(pc.match_substring(texts, "<").to_numpy(zero_copy_only=False) & simple).tolist():
                simple[k] = not self.specials.search(texts[k].as_py())
        out: list = [None] * len(texts)
        # Simple texts are cut, and their distinct runs found, by Arrow: no run becomes an object of its own.
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(simple))))
        runs = lists.flatten().dictionary_encode()
        names, code = runs.dictionary.to_numpy(zero_copy_only=False).tolist(), runs.indices.to_numpy()
        found = self.store.take(names, self._learn)  # the empty one is what stands beside outer white space
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, begin = np.frombuffer(b"".join(found), np.int32), np.cumsum(length) - length
        each = length[code]
        ends = np.cumsum(each)
        flat = pool[np.repeat(begin[code] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
        at = 0
        for k, end in zip(np.flatnonzero(simple).tolist(), upto, strict=True):
            out[k], at = flat[at:end], end
        if len(upto) < len(out):
            odd = [k for k, v in enumerate(out) if v is None]
            parts = [self._runs(texts[k].as_py()) for k in odd]
            names = list(set(chain.from_iterable(parts)))
            ids_of = dict(zip(names, self.store.take(names, self._learn), strict=True)).__getitem__
            for k, part in zip(odd, parts, strict=True):
                out[k] = np.frombuffer(b"".join(map(ids_of, part)), np.int32)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text]))[0]

    def decode(self, ids) -> str:
        """Tokens joined by one space, special ones kept; ids outside the vocabulary give nothing."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        try:
            return " ".join(map(self.token_of.__getitem__, ids))
        except KeyError:
            return " ".join(self.token_of[i] for i in ids if i in self.token_of)


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def _codec(spec: str) -> ForcedBoundaryBPE:
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = ForcedBoundaryBPE(spec)
    return _LOADED[spec]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _shipped(spark: SparkSession, path: str):
    """The tokenizer file, read by the driver and sent to each executor once; its size is checked."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(spec)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    spec = _shipped(df.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(b, "id"), _lists(codec.encode_all(column(b, "text")))], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string): encoding and then decoding of the ids, in one pass over the texts."""
    spec = _shipped(df.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in slices(batches, "text"):
            ids = codec.encode_all(column(b, "text"))
            yield pa.RecordBatch.from_arrays([column(b, "id"), _lists(ids), pa.array([codec.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded string) of every row's ids (null: empty)."""
    spec = _shipped(df.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([codec.decode(i or ()) for i in column(b, "ids").to_pylist()], pa.string())], ["id", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, decoded string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """What the query reports of ``round_trip``."""
    return round_trip(df, id_col, text_col, path).select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
