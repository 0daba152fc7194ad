"""Benchmark decontamination with spaced seeds.

A seed is a mask over neighbouring words whose zeros are ignored. Tasks hash the benchmark's words under the masks and write sorted
arrays to the shared folder, in blocks that workers memory-map; words of the documents are hashed under the same masks and joined with
these by search. Around each hit the document and the item are laid side by side, and the longest stretch is taken in which at
least PERCENT of the words agree. A document is contaminated by an item if that has LEAST words, or the item's length if it is
shorter. The masks find every stretch of 8 to 13 words with so many equal words (a test proves it), and so also longer ones, which hold
such a stretch. Items of fewer than SHORT words are too short for masks with gaps: they contaminate documents that hold them word for
word, found by the hash of the whole item.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from . import shared
from .tokens import ALNUM, Words, column, mix, slices

_U = np.uint64
MASKS = ("110111", "11001011", "11111")
LEAST, SHORT, PERCENT = 13, 8, 80
#: Bytes of the benchmark's texts in a block of the index, about; hits that are looked at together.
BLOCK_BYTES, HITS = 10_000_000, 1_000_000


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at each word that has enough words after it; a mask that ends in `!` is a whole item."""
    n = len(h) - len(mask.rstrip("!")) + 1
    if n <= 0:
        return np.empty(0, _U)
    key = np.full(n, len(mask) * 1000 + int(mask.replace("!", "0"), 2), _U)
    for k, c in enumerate(mask.rstrip("!")):
        if c == "1":
            key = key * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(key)


@dataclass
class Index:
    folder: str
    blocks: list[str]
    text_ids: bool = False

    @property
    def id_type(self) -> T.DataType:
        return T.StringType() if self.text_ids else T.LongType()

    def array(self, name: str, block: str, dtype) -> np.ndarray:
        return self._get(f"{self.folder}/{name}-{block}", lambda uri: shared.map_array(uri, dtype))

    def ids(self, block: str) -> list:
        return self._get(f"{self.folder}/ids-{block}", lambda uri: json.loads(shared.read_file(uri)))

    def _get(self, uri: str, load):
        if uri not in _mapped:
            if len(_mapped) > 5000:
                _mapped.clear()
            _mapped[uri] = load(uri)
        return _mapped[uri]


_mapped: dict[str, np.ndarray] = {}


def build(benchmark: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> Index:
    """Writes the index of items (item_id, text); items without id, text or words are left out. Ids are whole numbers or texts.

    Each task writes the block of its items, so that the driver sees block names alone. Repeated items count once each.
    """
    shared.make_dir(folder)
    kind = benchmark.schema["item_id"].dataType
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        raise TypeError(f"item_id is {kind.simpleString()}, not a whole number or a text")
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = [], []
        for b in batches:
            ids += b.column("item_id").to_pylist()
            for _, _, buf, base in slices(column(b, "text")):
                w = Words(buf, base, ALNUM)
                words += np.split(w.hashes(), w.off[1:-1])
        own = [k for k, w in enumerate(words) if len(w)]
        if not own:
            return
        words = [words[k] for k in own]
        n = np.array([len(w) for w in words])
        off = np.concatenate(([0], np.cumsum(n))).astype("<i8")
        all_ = np.concatenate(words)
        keys, at = [], []
        for mask in MASKS:
            k = seeds(all_, mask)
            item = np.repeat(np.arange(len(n)), n)[: len(k)]
            fits = (np.arange(len(k)) + len(mask) <= off[1:][item]) & (n[item] >= SHORT)
            keys.append(k[fits])
            at.append(np.flatnonzero(fits))
        for length in range(1, SHORT):
            first = off[:-1][n == length]
            if len(first):
                keys.append(seeds(all_, "1" * length + "!")[first])
                at.append(first)
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        sieve = np.zeros(1 << 22, bool)
        sieve[(keys >> _U(42)).astype(np.int64)] = True
        lengths = np.unique(n[n < SHORT])
        name = f"{TaskContext.get().partitionId():06d}"
        shared.write_file(folder, f"ids-{name}", json.dumps([ids[k] for k in own]).encode())
        for what, a in (("off", off), ("words", all_.astype("<u8")), ("keys", keys[order].astype("<u8")), ("at", at[order].astype("<i8")), ("short", lengths.astype("<i8")), ("sieve", sieve)):
            shared.write_file(folder, f"{what}-{name}", a.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["block"])

    blocks = items.repartition(int(max(1, -(-size // block_bytes)))).mapInArrow(shared.released(write), "block string").collect()
    return Index(folder, sorted(r["block"] for r in blocks), isinstance(kind, T.StringType))


def longest(equal: np.ndarray) -> int:
    """The length of the longest stretch with at least PERCENT of its places equal."""
    p = np.concatenate(([0], np.cumsum(np.where(equal, 100 - PERCENT, -PERCENT))))
    after = np.maximum.accumulate(p[::-1])[::-1]  # falling: the last place that is high enough
    lows = np.flatnonzero(np.concatenate(([True], p[1:] < np.minimum.accumulate(p)[:-1])))
    ends = np.searchsorted(-after, -p[lows], "right") - 1
    return int((ends - lows).max(initial=0))


def hits(index: Index, words: Words) -> dict[int, dict]:
    """For each text with hits the items that contaminate it and their longest stretch."""
    found: dict[int, dict] = {}
    h = words.hashes()
    keys = {m: seeds(h, m) for m in MASKS}
    doc = words.doc()
    for b in index.blocks:
        known, at = index.array("keys", b, "<u8"), index.array("at", b, "<i8")
        sieve = index.array("sieve", b, bool)
        off, item_ids, own = index.array("off", b, "<i8"), index.ids(b), index.array("words", b, "<u8")
        for length in index.array("short", b, "<i8").tolist():
            mask = "1" * length + "!"
            if mask not in keys:
                keys[mask] = seeds(h, mask)
        pairs = np.empty((0, 3), np.int64)
        for mask, k in keys.items():
            span = len(mask.rstrip("!"))
            place = np.flatnonzero(sieve[(k >> _U(42)).astype(np.int64)])
            if not len(place):
                continue
            place = place[place + span <= words.off[1:][doc[place]]]
            lo, hi = np.searchsorted(known, k[place], "left"), np.searchsorted(known, k[place], "right")
            place, lo, n = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            begin = 0
            total = np.cumsum(n)
            while begin < len(n):  # some hits at a time: words that repeat in a text and in an item make many on few diagonals
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, "right")))
                m = n[begin:end]
                w = np.repeat(place[begin:end], m)
                x = at[np.repeat(lo[begin:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                new = np.stack((doc[w], np.searchsorted(off, x, "right") - 1, w - x), axis=1)
                pairs = np.unique(np.concatenate((pairs, new)), axis=0)
                begin = end
        for d, i, shift in pairs:  # each text, item and diagonal once
            lo, hi = max(int(words.off[d]), int(off[i] + shift)), min(int(words.off[d + 1]), int(off[i + 1] + shift))
            equal, size = h[lo:hi] == own[lo - shift : hi - shift], int(off[i + 1] - off[i])
            n = longest(equal) if size >= SHORT else size * bool(len(equal) == size and equal.all())
            if n >= min(LEAST, size):
                mine = found.setdefault(int(d), {})
                key = item_ids[int(i)]
                mine[key] = max(n, mine.get(key, 0))
    return found


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """`row`, a struct of a row of docs as it is, and `hits`: an array of (item_id, words) of the items that contaminate it.

    Null and empty texts have none; repeated rows have the same ones; very long texts are searched whole. Other columns, whatever their
    names, are only passed on.
    """
    at = docs.columns.index("text")
    kind = T.ArrayType(T.StructType([T.StructField("item_id", index.id_type), T.StructField("words", T.LongType())]))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("hits", kind)])
    arrow = pa.list_(pa.struct([("item_id", pa.string() if index.text_ids else pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            texts = b.column("row").field(at).cast(pa.large_string()).fill_null("")
            for i, _, buf, base in slices(texts):
                for d, items in hits(index, Words(buf, base, ALNUM)).items():
                    out[i + d] = [{"item_id": k, "words": n} for k, n in sorted(items.items())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, arrow)], names=["row", "hits"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(shared.released(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids (ascending) and longest (words of the longest stretch, 0 without).

    An empty benchmark contaminates nothing, and empty documents give no rows. Repeated rows are judged one by one.
    """
    index = build(benchmark, shared.shared_dir(docs.sparkSession))
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), index)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["words"])), F.lit(0)).alias("longest"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, as they are."""
    index = build(benchmark, shared.shared_dir(docs.sparkSession))
    return scan(docs, index).where(F.size("hits") == 0).select("row.*")
