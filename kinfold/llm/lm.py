"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

The model is a folder of sorted arrays in shards:

* words: sorted 64-bit word hashes (a shard is a range of hashes) and their counts. A word's id is its rank.
* pairs: sorted keys (id of the word before << 32 | id) with counts, in a byte each and a list of the larger ones. A shard is a
  range of the word before; the pairs of a word with more than a shard's share of the tokens are dealt to shards of their own by the
  word after. The word before the first is the id V; the last token of a text is an end token.
* before: per word before, how often it was followed and by how many words once, twice, and more often. Of the frequent words these
  are sums over their shards, in the model itself: there are no more such shards than twice the others.
* after: per word, how many different words it follows.

Each map task counts its part in sorted arrays and sends one compressed block to each shard; a shard's task merges the blocks and
writes a file. So nothing but block sizes and shard totals reaches the driver, and a hot word is one entry of a block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared
from .tokens import SPACED, Words, column, mix, slices

_U = np.uint64
END = mix(np.array([0x656E64], _U))[0]
#: A map task sends what it has counted once it holds so many different keys.
HELD = 3_000_000


class Counter:
    """Sorted distinct keys with counts, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merged(self.parts)
        self.parts, self.size = [(k, c)], len(k)
        return k, c


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, _U), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(k) else c)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, compressed; then the counts."""
    gaps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    wide = counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    a, b = (pa.compress(x, codec="zstd", asbytes=True) for x in (gaps, wide))
    return struct.pack("<QQ", len(keys), len(a)) + a + b


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<QQ", data)
    a = pa.decompress(data[16 : 16 + size], decompressed_size=8 * n, codec="zstd", asbytes=True)
    b = pa.decompress(data[16 + size :], decompressed_size=8 * n, codec="zstd", asbytes=True)
    keys = np.cumsum(np.ascontiguousarray(np.frombuffer(a, np.uint8).reshape(8, n).T).view(_U).reshape(-1), dtype=_U)
    return keys, np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).view(np.uint64).reshape(-1).astype(np.int64)


BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.binary())])


def blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard that has keys; keys ascend."""
    if len(keys):
        if (shard[1:] < shard[:-1]).any():
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
        at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        rows = [{"shard": int(shard[i]), "block": pack(keys[i:j], counts[i:j])} for i, j in zip(at, [*at[1:], len(keys)])]
        yield pa.RecordBatch.from_pylist(rows, schema=BLOCKS)


def per_shard(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(shard, keys, counts) -> dict for each shard of block rows; a task holds one shard at a time."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, out = None, [], 0, []
        for b in batches:
            for shard, block in zip(b.column("shard").to_pylist(), b.column("block").to_pylist()):
                if shard != now:
                    if held:
                        out.append(work(now, *merged(held)))
                    now, held, size = shard, [], 0
                held.append(unpack(block))
                size += len(held[-1][0])
                if size > 4 * HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            out.append(work(now, *merged(held)))
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


@dataclass
class Model:
    """Where the arrays are and what is known of all of them; small, and sent to the workers."""

    folder: str
    bits: int
    words: dict[int, int]
    pair_shards: int
    pairs: dict[int, int] = field(default_factory=dict)
    tokens: int = 0
    discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    low_discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    low_spread: float = 0.0
    kinds: int = 0
    #: Frequent words before: ids, the first of their own shards, how many they have, and their rows of BEFORE.
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hot_first: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hot_parts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hot_rows: np.ndarray | None = None

    def __post_init__(self):
        self.size = sum(self.words.values())
        self.base, at = {}, 0
        for s in sorted(self.words):
            self.base[s], at = at, at + self.words[s]

    # -- ranges of ids that a shard of pairs has
    def shard_of(self, before: np.ndarray) -> np.ndarray:
        return (before.astype(_U) * _U(self.pair_shards) // _U(self.size + 1)).astype(np.int64)

    def hot_of(self, before: np.ndarray) -> np.ndarray:
        """Which of the frequent words each is, or -1."""
        if not len(self.hot):
            return np.full(len(before), -1, np.int64)
        at = np.searchsorted(self.hot, before)
        at[at == len(self.hot)] = 0
        return np.where(self.hot[at] == before, at, -1)

    def own_shard(self, which: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The shard of a frequent word's pair with `now`."""
        return self.hot_first[which] + (mix(now.astype(_U)) % self.hot_parts[which].astype(_U)).astype(np.int64)

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        before = (keys >> _U(32)).astype(np.int64)
        out, which = self.shard_of(before), self.hot_of(before)
        own = np.flatnonzero(which >= 0)
        out[own] = self.own_shard(which[own], keys[own] & _U(0xFFFFFFFF))
        return out

    def split(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Gives words with more than a shard's share of the tokens shards of their own."""
        share = max(1, self.tokens // self.pair_shards)
        keep = np.argsort(ids)[counts[np.argsort(ids)] > share]
        self.hot, parts = ids[keep], -(-counts[keep] // share)
        self.hot_parts, self.hot_first = parts, self.pair_shards + np.cumsum(parts) - parts

    def pair_counts(self, shard: int, at: np.ndarray) -> np.ndarray:
        """Counts at places of a shard's pairs."""
        c = self.array("paircounts", shard, np.uint8)[at].astype(np.int64)
        large = np.flatnonzero(c == 255)
        if len(large):
            c[large] = self.array("largecounts", shard, "<i8")[np.searchsorted(self.array("largeplaces", shard, "<i8"), at[large])]
        return c

    def first_of(self, shard: int) -> int:
        return -(-shard * (self.size + 1) // self.pair_shards)

    def array(self, name: str, shard: int, dtype) -> np.ndarray:
        uri = f"{self.folder}/{name}-{shard:06d}"
        if uri not in _mapped:
            if len(_mapped) > 20_000:
                _mapped.clear()
            _mapped[uri] = shared.map_array(uri, dtype)
        return _mapped[uri]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 for a word that isn't known."""
        out = np.full(len(hashes), -1, np.int64)
        shard = (hashes >> _U(64 - self.bits)).astype(np.int64)
        for s, i, j in _segments(shard):
            if s in self.words:
                a = self.array("words", s, "<u8")
                at = np.searchsorted(a, hashes[i:j])
                at[at == len(a)] = 0
                out[i:j] = np.where(a[at] == hashes[i:j], at + self.base[s], -1)
        return out

    def by_word(self, name: str, ids: np.ndarray, dtype) -> np.ndarray:
        """Values of sorted ids from arrays in shards of words."""
        out = np.zeros(len(ids), dtype)
        starts = np.array([self.base[s] for s in sorted(self.words)], np.int64)
        names = sorted(self.words)
        for k, i, j in _segments(np.searchsorted(starts, ids, "right") - 1):
            out[i:j] = self.array(name, names[k], dtype)[ids[i:j] - starts[k]]
        return out


_mapped: dict[str, np.ndarray] = {}


def _segments(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        at = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(sorted_values)]):
            yield int(sorted_values[i]), i, j


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes, where each text's tokens begin): words, then one end."""
    for i, j, buf, base in slices(texts):
        w = Words(buf, base, SPACED)
        h = np.insert(w.hashes(), w.off[1:], END)
        yield i, h, w.off + np.arange(len(w.off))


def before_after(model: Model, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its id, the id before it, and nothing else; unknown is -1 and a text's first token has V before it."""
    kinds, inverse = np.unique(h, return_inverse=True)
    ids = model.ids(kinds)
    now = ids[inverse]
    prev = np.empty_like(now)
    prev[1:] = now[:-1]
    prev[off[:-1]] = model.size
    return now, prev, kinds


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many keys have counts 1, 2, 3 and 4; 0.5, 1 and 1.5 where that is undefined."""
    n1, n2, n3, n4 = n
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(raw))


def fit(docs: DataFrame, folder: str) -> Model:
    """Counts the texts of docs (null: empty) and writes the model's arrays to folder."""
    spark = docs.sparkSession
    shared.make_dir(folder)
    texts = docs.select("text")
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter()
        send = lambda k, n: blocks(k, n, (k >> _U(64 - bits)).astype(np.int64))
        for b in batches:
            for _, h, _ in tokens_of(column(b, "text")):
                c.add(h)
            if c.size > HELD and len(c.merge()[0]) > HELD:
                yield from send(*c.merge())
                c = Counter()
        yield from send(*c.merge())

    def write_words(shard, keys, counts):
        shared.write_file(folder, f"words-{shard:06d}", keys.astype("<u8").tobytes())
        shared.write_file(folder, f"counts-{shard:06d}", counts.astype("<u8").tobytes())
        total = int(counts.sum())
        often = np.flatnonzero(counts > total >> bits)  # may have more than a shard's share of all; 2 ** bits at most
        return {"shard": shard, "n": len(keys), "total": total, "often": often.tolist(), "times": counts[often].tolist()}

    found = per_shard(texts.mapInArrow(count_words, "shard long, block binary"), write_words, "shard long, n long, total long, often array<long>, times array<long>").collect()
    model = Model(folder, bits, {r["shard"]: r["n"] for r in found}, 1 << bits)
    model.tokens = sum(r["total"] for r in found)
    ends = model.by_word("counts", model.ids(np.array([END])), "<u8").astype(np.int64) if model.size else np.empty(0, np.int64)
    often = [np.array([model.base[r["shard"]] + k for k in r["often"]], np.int64) for r in found]
    times = [np.array(r["times"], np.int64) for r in found]
    model.split(np.concatenate([*often, np.full(len(ends), model.size)]), np.concatenate([*times, ends]))
    if model.size >= (1 << 32) - 1:
        raise ValueError("more different words than 32-bit ids")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter()
        send = lambda k, n: blocks(k, n, model.pair_shard(k))
        for b in batches:
            for _, h, off in tokens_of(column(b, "text")):
                now, prev, _ = before_after(model, h, off)
                c.add(prev.astype(_U) << _U(32) | now.astype(_U))
            if c.size > HELD and len(c.merge()[0]) > HELD:
                yield from send(*c.merge())
                c = Counter()
        yield from send(*c.merge())

    def write_pairs(shard, keys, counts):
        row = {"total": int(counts.sum()), "one": int((counts == 1).sum()), "two": int((counts == 2).sum()), "more": int((counts > 2).sum())}
        if shard < model.pair_shards:
            first, end = model.first_of(shard), model.first_of(shard + 1)
            before = (keys >> _U(32)).astype(np.int64) - first
            table = np.zeros(end - first, BEFORE)
            np.add.at(table["total"], before, counts)
            for name, chosen in (("one", counts == 1), ("two", counts == 2), ("more", counts > 2)):
                table[name] = np.bincount(before[chosen], minlength=end - first)
            shared.write_file(folder, f"before-{shard:06d}", table.tobytes())
        large = np.flatnonzero(counts >= 255)
        shared.write_file(folder, f"pairs-{shard:06d}", keys.astype("<u8").tobytes())
        shared.write_file(folder, f"paircounts-{shard:06d}", np.minimum(counts, 255).astype(np.uint8).tobytes())
        shared.write_file(folder, f"largeplaces-{shard:06d}", large.astype("<i8").tobytes())
        shared.write_file(folder, f"largecounts-{shard:06d}", counts[large].astype("<i8").tobytes())
        out = {"shard": shard, "n": len(keys), **row} | {f"n{k}": int((counts == k).sum()) for k in range(1, 5)}
        after, times = np.unique(keys & _U(0xFFFFFFFF), return_counts=True)
        return out | {"after": pack(after, times)}

    columns = "shard long, n long, total long, one long, two long, more long, n1 long, n2 long, n3 long, n4 long, after binary"
    shared.ensure_checkpoint(spark)
    made = per_shard(texts.mapInArrow(count_pairs, "shard long, block binary"), write_pairs, columns).checkpoint()
    stats = made.drop("after").collect()
    model.pairs = {r["shard"]: r["n"] for r in stats}
    model.discounts = discounts([sum(r[f"n{k}"] for r in stats) for k in range(1, 5)])
    model.hot_rows = np.zeros(len(model.hot), BEFORE)
    for r in stats:
        if r["shard"] >= model.pair_shards:
            k = np.searchsorted(model.hot_first, r["shard"], "right") - 1
            for name in BEFORE.names:
                model.hot_rows[name][k] += r[name]
    starts = np.array([model.base[s] for s in sorted(model.words)] or [0], np.int64)
    shards = np.array(sorted(model.words) or [0], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        send = lambda k, n: blocks(k, n, shards[np.searchsorted(starts, k.astype(np.int64), "right") - 1])
        for b in batches:
            for block in b.column("after").to_pylist():
                held.append(unpack(block))
                size += len(held[-1][0])
                if size > 4 * HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:  # a task's counts together, so that blocks number tasks times shards
            yield from send(*merged(held))

    def write_after(shard, keys, counts):
        table = np.zeros(model.words[shard], "<u4")
        table[keys.astype(np.int64) - model.base[shard]] = counts
        shared.write_file(folder, f"after-{shard:06d}", table.tobytes())
        return {"shard": shard, "kinds": int(counts.sum())} | {f"n{k}": int((counts == k).sum()) for k in range(1, 5)} | {"n": len(counts)}

    low = per_shard(made.select("after").mapInArrow(deal, "shard long, block binary"), write_after, "shard long, kinds long, n1 long, n2 long, n3 long, n4 long, n long").collect()
    model.kinds = sum(r["kinds"] for r in low)
    n = [sum(r[f"n{k}"] for r in low) for k in range(1, 5)]
    model.low_discounts = discounts(n)
    d1, d2, d3 = model.low_discounts
    model.low_spread = d1 * n[0] + d2 * n[1] + d3 * (sum(r["n"] for r in low) - n[0] - n[1])
    return model


BEFORE = np.dtype([("total", "<i8"), ("one", "<i8"), ("two", "<i8"), ("more", "<i8")])


def _less(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def probabilities(model: Model, now: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """p(now | prev) of pairs of ids; -1 is an unknown word. All words, the end and unknown add up to 1."""
    uniform = 1.0 / (model.size + 1)
    if not model.kinds:
        return np.full(len(now), uniform)
    ids, inverse = np.unique(now, return_inverse=True)
    after = np.zeros(len(ids), np.int64)
    known = ids >= 0
    after[known] = model.by_word("after", ids[known], "<u4")
    low = ((_less(after, model.low_discounts) + model.low_spread * uniform) / model.kinds)[inverse]
    p = low.copy()
    keys, back = np.unique(np.where(prev < 0, _U(0xFFFFFFFF), prev.astype(_U)) << _U(32) | np.where(now < 0, _U(0xFFFFFFFF), now.astype(_U)), return_inverse=True)
    before = (keys >> _U(32)).astype(np.int64)
    usable = np.flatnonzero(before <= model.size)
    high, spread = np.zeros(len(keys)), np.ones(len(keys))
    d1, d2, d3 = model.discounts

    def add(own: np.ndarray, table: np.ndarray, shard: int | None) -> None:
        total = table["total"]
        count = np.zeros(len(own), np.int64)
        if shard in model.pairs:
            a = model.array("pairs", shard, "<u8")
            at = np.searchsorted(a, keys[own])
            at[at == len(a)] = 0
            hit = a[at] == keys[own]
            count[hit] = model.pair_counts(shard, at[hit])
        seen, whole = total > 0, np.maximum(total, 1)
        high[own] = np.where(seen, _less(count, model.discounts) / whole, 0.0)
        spread[own] = np.where(seen, (d1 * table["one"] + d2 * table["two"] + d3 * table["more"]) / whole, 1.0)

    which = model.hot_of(before[usable])
    plain, often = usable[which < 0], usable[which >= 0]
    for s, i, j in _segments(model.shard_of(before[plain])):
        if s in model.pairs:
            add(plain[i:j], model.array("before", s, BEFORE)[before[plain[i:j]] - model.first_of(s)], s)
    which = which[which >= 0]
    shard = model.own_shard(which, keys[often] & _U(0xFFFFFFFF))
    order = np.argsort(shard, kind="stable")
    for s, i, j in _segments(shard[order]):
        add(often[order[i:j]], model.hot_rows[which[order[i:j]]], s)
    return high[back] + spread[back] * p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row doc_id, n_tokens, n_known, base_score (add-0.1 unigrams), score (the model's) and perplexity; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, "text")
            size = len(texts)
            n, known, base, full = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            for at, h, off in tokens_of(texts):
                rows = slice(at, at + len(off) - 1)
                now, prev, _ = before_after(model, h, off)
                ids, inverse = np.unique(now, return_inverse=True)
                c = np.zeros(len(ids), np.int64)
                c[ids >= 0] = model.by_word("counts", ids[ids >= 0], "<u8")
                logs = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.size + 1)))
                n[rows] = np.diff(off)
                known[rows] = np.add.reduceat((now >= 0).astype(np.int64), off[:-1])
                base[rows] = np.add.reduceat(logs[inverse], off[:-1])
                full[rows] = np.add.reduceat(np.log10(probabilities(model, now, prev)), off[:-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(known), pa.array(base), pa.array(full), pa.array(10.0 ** (-full / np.maximum(n, 1)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) mod 10 isn't 0 and scores all; rows without doc_id are held out.

    Null and empty texts are one end token. Repeated rows count each in training and get equal scores, as do ties; very long texts are
    read whole, some megabytes at a time. Without training texts all words are equally likely; an empty table gives no rows. Other columns
    aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    model = fit(docs.where(~held), shared.shared_dir(docs.sparkSession))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
