"""Near-duplicates by banded MinHash candidates that odd sketches estimate and full shingle sets confirm.

Per text one pass makes its set of w-word shingles (64-bit hashes), a fingerprint of the set, the keys of its bands, and an odd
sketch: the set's one-permutation MinHash samples, each flipping one of SKETCH bits. The XOR of two sketches counts the samples
that differ, so that similarities near 1 are estimated precisely.

1. Equal sets are one class (represented by its smallest id).
2. Classes that share a band form a bucket. A bucket has up to CENTRES centres; each member is a candidate with its centres:
   stars, never all pairs. Sizes and sketches discard, full sets confirm, and components follow.
3. That settles buckets of up to CENTRES + 1 members. Larger ones that hold several components get other centres once more, and
   members that still lie in different components are compared by sketch, each pair in the first band it shares; what the sketch doesn't rule out is confirmed on full sets. So no link of a
   bucket is lost. A bucket of any size is a join that can be split, and members of one component aren't compared.

Steps hand over narrow tables in the shared folder. Texts move only for the pairs to be confirmed: a bitmap of their ids, in files
that workers memory-map, holds back the others where they are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared
from .tokens import SPACED, Words, column, mix, slices

_U = np.uint64
BINS, SKETCH = 16384, 2048
CENTRES = 3


@dataclass(frozen=True)
class Params:
    """Shingle length, similarity as percent, bands and rows a band (3 and 21 miss 3 in 10 million pairs at 0.8)."""

    words: int = 2
    percent: int = 80
    bands: int = 21
    rows: int = 3

    @property
    def factors(self) -> np.ndarray:
        return mix(np.arange(1, self.bands * self.rows + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)


def shingle_sets(texts: pa.Array, w: int, docs: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct shingle hashes of some texts, where each text's begin); A-Z count as a-z.

    A text with fewer than w words but at least one has its whole sequence as one shingle; without words it has none.
    """
    for lo in range(0, len(texts), docs):
        part = texts.slice(lo, docs)
        for i, j, buf, base in slices(part):
            words = Words(buf, base, SPACED)
            h = words.hashes()
            n = np.diff(words.off)
            if len(h) >= w:
                s = h[: len(h) - w + 1].copy()
                for k in range(1, w):
                    s = mix(s * _U(0x9E3779B97F4A7C15) + h[k : len(h) - w + 1 + k])
            else:
                s = np.empty(0, _U)
            doc = words.doc()[: len(s)]
            last = words.off[1:][doc] if len(s) else doc
            keep = np.arange(len(s)) + w <= last
            s, doc = s[keep], doc[keep]
            few = np.flatnonzero((n > 0) & (n < w))
            if len(few):
                short = np.empty(len(few), _U)
                for k, d in enumerate(few):
                    x = np.array([n[d]], _U)
                    for v in h[words.off[d] : words.off[d + 1]]:
                        x = mix(x * _U(0xD1342543DE82EF95) ^ v)
                    short[k] = x[0]
                s, doc = np.concatenate((s, short)), np.concatenate((doc, few))
            bits = max(1, int(j - i - 1).bit_length())
            key = (doc.astype(_U) << _U(64 - bits)) | (mix(s) >> _U(bits))
            key.sort()
            key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
            edges = np.searchsorted(key >> _U(64 - bits), np.arange(j - i + 1, dtype=_U)) if j - i < 1 << bits else np.append(np.searchsorted(key >> _U(64 - bits), np.arange(j - i, dtype=_U)), len(key))
            # the low bits of the hash, the same whatever the slice: at least 52 of them
            yield lo + i, (key << _U(bits)) & ~_U(0xFFF), edges



def signatures(batch: pa.RecordBatch, p: Params) -> pa.RecordBatch:
    """doc_id, text_hash, n, f1, f2, occ (the samples in the sketch), bands and sketch of each row."""
    texts = column(batch, "text")
    size = len(texts)
    n, f1, f2, occ = (np.zeros(size, np.int64) for _ in range(4))
    bands = np.zeros((size, p.bands), np.int64)
    sketch = np.zeros((size, SKETCH // 64), np.int64)
    factors = p.factors
    for at, h, edges in shingle_sets(texts, p.words):
        count = np.diff(edges)
        full = np.flatnonzero(count)
        rows = at + full
        if not len(full):
            continue
        starts = edges[:-1][full]
        n[rows] = count[full]
        f1[rows] = np.add.reduceat(mix(h ^ _U(0x1234567)), starts).view(np.int64)
        f2[rows] = np.add.reduceat(mix(h ^ _U(0x89ABCDEF01)), starts).view(np.int64)
        g = mix(h)
        for b in range(p.bands):
            key = np.full(len(full), b + 1, _U)
            for r in range(p.rows):
                key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(g * factors[b * p.rows + r], starts))
            bands[rows, b] = key.view(np.int64)
        doc = np.repeat(np.arange(len(full)), count[full])
        bin_ = (h >> _U(64 - int(math.log2(BINS)))).astype(np.int64) + doc * BINS
        sample = np.concatenate(([True], bin_[1:] != bin_[:-1]))  # sorted: the first of a bin is its smallest
        where = (mix(h[sample] ^ _U(0x5DEECE66D)) >> _U(64 - int(math.log2(SKETCH)))).astype(np.int64)
        occ[rows] = np.bincount(doc[sample], minlength=len(full))
        odd = np.bincount(doc[sample] * SKETCH + where, minlength=len(full) * SKETCH).astype(np.uint8) & 1
        sketch[rows] = np.packbits(odd.reshape(len(full), SKETCH), axis=1).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("text_hash"),
            *(pa.array(x, pa.int64()) for x in (n, f1, f2, occ)),
            *(pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1)) for x in (bands, sketch)),
        ],
        names=["doc_id", "text_hash", "n", "f1", "f2", "occ", "bands", "sketch"],
    )


def estimate_at_least(a: str, b: str, percent: int):
    """Whether the sketches of two rows leave it possible that their similarity reaches percent.

    At just that similarity t the union has (nx + ny) / (1 + t) shingles, of which those that the larger set lacks fall into the
    bins at random; so many bins u are occupied by either set. The smallest shingle of a bin is in both sets in a share t of
    them, so that d = both - 2tu samples differ, and d samples leave SKETCH/2 (1 - (1 - 2/SKETCH)^d) odd bits, and never more
    than d. More similar sets have fewer. Allowed are 4.5 standard errors (of what is drawn of the union, of u, and of the
    sketch), and 3 bits at least, for sets so small that a few shared bins decide.
    """
    t = percent / 100
    x = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    an, bn, aocc, bocc = (F.col(c).cast("double") for c in (f"{a}n", f"{b}n", f"{a}occ", f"{b}occ"))
    smaller, larger = F.least(an, bn), F.greatest(an, bn)
    union = (an + bn) / (1 + t)
    lacks, free = F.greatest(union - larger, F.lit(0.0)), BINS - F.when(an >= bn, aocc).otherwise(bocc)
    empty = free * F.exp(lacks * math.log1p(-1 / BINS))  # bins of neither set
    u = BINS - empty
    drawn = t * (1 - t) * u * F.greatest(1 - u / union, F.lit(0.0)) + t * t * F.greatest(empty * (1 - empty / F.greatest(free, F.lit(1.0))) - empty * empty * lacks / BINS**2, F.lit(0.0))
    d = F.greatest(aocc + bocc - 2 * t * u, F.lit(0.0))
    even = F.exp(d * math.log1p(-2 / SKETCH))
    odd = SKETCH / 2 * (1 - even)
    error = F.sqrt(F.greatest(SKETCH / 4 * (1 - even * even * (1 + 4 / SKETCH * d)), F.lit(0.0)) + 4 * even * even * drawn)
    return x <= F.least(d + F.greatest(9 * F.sqrt(drawn), F.lit(3.0)), odd + 4.5 * error + 3)


#: Bits of a bitmap's file, and files at most (1 GB in all); a fuller bitmap holds back fewer rows but never a needed one.
FILE_BITS, FILES = 1 << 23, 1024


def only(docs: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, text) of docs whose id is among `ids` (id), and a few others: those that a bitmap of the ids doesn't tell apart."""
    n = ids.count()
    files = min(FILES, max(1, -(-16 * n // FILE_BITS)))
    bit = lambda c: F.pmod(F.xxhash64(F.lit(31), F.col(c)), F.lit(files * FILE_BITS))
    part = lambda c: F.floor(bit(c) / FILE_BITS).cast("int").alias("_file")
    place = lambda c: F.pmod(bit(c), F.lit(FILE_BITS)).cast("int").alias("_place")
    shared.make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(FILE_BITS // 8, np.uint8)

        def flush() -> None:
            if now is not None:
                shared.write_file(folder, f"bits-{now:06d}", bits.tobytes())
                bits[:] = 0

        for b in batches:
            which, at = b.column("_file").to_numpy(), b.column("_place").to_numpy()
            for f in dict.fromkeys(which.tolist()):
                if f != now:
                    flush()
                    now = f
                own = at[which == f]
                np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1 if now is None else now], pa.int32())], names=["file"])

    ids.select(part("id"), place("id")).repartition(files, "_file").sortWithinPartitions("_file").mapInArrow(shared.released(write), "file int").collect()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            which, at = b.column("_file").to_numpy(), b.column("_place").to_numpy()
            hit = np.zeros(b.num_rows, bool)
            for f in np.unique(which).tolist():
                if f not in maps:
                    uri = f"{folder}/bits-{f:06d}"
                    maps[f] = shared.map_array(uri, np.uint8) if shared.exists(uri) else np.zeros(FILE_BITS // 8, np.uint8)
                own = np.flatnonzero(which == f)
                hit[own] = maps[f][at[own] >> 3] >> (at[own] & 7).astype(np.uint8) & 1
            if hit.any():
                yield b.select(["doc_id", "text"]).filter(pa.array(hit))

    return docs.where("doc_id is not null").select("doc_id", "text", part("doc_id"), place("doc_id")).mapInArrow(shared.released(keep), "doc_id long, text string")


def confirm(pairs: DataFrame, docs: DataFrame, p: Params, tables: shared.Tables) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough. A row of `a` meets its partners in parts of some hundreds."""
    spark = docs.sparkSession
    part = 256
    n_pairs = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    text = only(docs, ids, tables.folder()).withColumnRenamed("doc_id", "_id")
    many = pairs.groupBy("a").count().where(F.col("count") > part)
    spread = pairs.join(many.select(F.col("a").alias("big"), "count"), F.col("a") == F.col("big"), "left").select(
        "a", "b", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / part))).cast("long").alias("salt")
    )
    centres = spread.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("_of"))
    wanted = spread.select("a", "salt", "b", F.col("b").alias("_of")).unionByName(centres)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = wanted.join(text, F.col("_of") == F.col("_id")).select("a", "salt", "b", "text").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            out_a, out_b = [], []
            a, s, b = (batch.column(k).to_pylist() for k in ("a", "salt", "b"))
            for at, h, edges in shingle_sets(column(batch, "text"), p.words):
                for k in range(len(edges) - 1):
                    i, x = at + k, h[edges[k] : edges[k + 1]]
                    if b[i] is None:
                        if (a[i], s[i]) != now:
                            now, sets = (a[i], s[i]), []
                        sets.append(x.copy())
                    elif (a[i], s[i]) == now:
                        for y in sets:
                            small, large = (x, y) if len(x) < len(y) else (y, x)
                            if len(small) and 100 * len(small) >= p.percent * len(large):
                                place = np.searchsorted(large, small)
                                place[place == len(large)] = 0
                                same = int(np.count_nonzero(large[place] == small))
                                if 100 * same >= p.percent * (len(x) + len(y) - same):
                                    out_a.append(a[i])
                                    out_b.append(b[i])
                                    break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return tables.save(rows.mapInArrow(shared.released(run), "a long, b long"), n_pairs)


def components(edges: DataFrame, tables: shared.Tables) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the smallest node that can be reached.

    Each round takes the least label among neighbours and then the label's own label; what a round finds is written, and no group is
    gathered: minima are pre-aggregated and the join of a node with many neighbours can be split.
    """
    n = 2 * edges.count()
    both = tables.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), n)
    labels = tables.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), n)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        up = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        roots = labels.select(F.col("node").alias("r"), F.col("label").alias("root"))
        after = tables.save(up.join(roots, F.col("label") == F.col("r"), "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")), n)
        labels = after.select("node", "label")
        if not after.where("label <> old").limit(1).count():
            return labels


def merged(labels: DataFrame, pairs: DataFrame, tables: shared.Tables) -> DataFrame:
    """labels (node, label) after the pairs (a, b) have joined components; nodes without a label are their own."""
    side = lambda x: labels.select(F.col("node").alias(f"n{x}"), F.col("label").alias(f"l{x}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("na"), "left").join(side("b"), F.col("b") == F.col("nb"), "left")
    found = components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), tables)
    over = found.select(F.col("node").alias("m"), F.col("label").alias("over"))
    old = labels.join(over, F.col("label") == F.col("m"), "left").select("node", F.coalesce("over", "label").alias("label"))
    return tables.save(old.union(found.join(labels.select(F.col("node").alias("x")), F.col("node") == F.col("x"), "left_anti")))


def links(classes: DataFrame, docs: DataFrame, p: Params, tables: shared.Tables) -> DataFrame:
    """(rep, component) of the classes (rep, n, occ, bands, sketch) that link with another."""
    alike = lambda a, b: 100 * F.least(a, b) >= p.percent * F.greatest(a, b)
    banded = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared_keys = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select(F.col("key").alias("k"), "members")
    buckets = tables.save(banded.join(shared_keys, F.col("key") == F.col("k")).select("key", F.col("band").cast("byte").alias("band"), "rep", F.col("n").cast("int").alias("n"), "members"))
    side = lambda x: classes.select(F.col("rep").alias(f"{x}id"), F.col("n").alias(f"{x}n"), F.col("occ").alias(f"{x}occ"), F.col("sketch").alias(f"{x}sketch"))

    def stars(rows: DataFrame, first: int) -> DataFrame:
        """Confirmed links between members of buckets (key, rep, n, label) and centres, CENTRES by hash from seed `first` on, of other labels."""
        rank = lambda k: F.struct(F.xxhash64(F.lit(first + k), "rep").alias("h"), "rep", "n", "label")
        centres = rows.groupBy(F.col("key").alias("k")).agg(*[F.min(rank(k)).alias(f"c{k}") for k in range(CENTRES)])
        all_ = F.array_distinct(F.array(*[F.struct(*[F.col(f"c{k}.{x}").alias(x) for x in ("rep", "n", "label")]) for k in range(CENTRES)]))
        near = F.filter(all_, lambda c: (c["label"] != F.col("label")) & alike(c["n"], F.col("n")))
        pairs = rows.join(centres, F.col("key") == F.col("k")).select("rep", F.explode(near).alias("c")).select(F.least("rep", "c.rep").alias("lo"), F.greatest("rep", "c.rep").alias("hi"), F.col("c.rep").alias("c"))
        pairs = pairs.groupBy("lo", "hi").agg(F.min("c").alias("a")).select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b"))
        likely = pairs.join(side("x"), F.col("b") == F.col("xid")).join(side("y"), F.col("a") == F.col("yid")).where(estimate_at_least("x", "y", p.percent)).select("a", "b")
        return confirm(tables.save(likely), docs, p, tables)

    def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets with more than one component, each with its label."""
        state = rows.join(labels, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "n", F.coalesce("label", "rep").alias("label"))
        several = state.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k")
        return tables.save(state.join(several, F.col("key") == F.col("k")).select("key", "band", "rep", "n", "label"))

    labels = components(stars(buckets.withColumn("label", F.col("rep")), 0), tables)
    # what the stars leave in larger buckets: once more with other centres, then members in different components with each other
    open_ = still_open(buckets.where(F.col("members") > CENTRES + 1), labels)
    labels = merged(labels, stars(open_, CENTRES), tables)
    open_ = still_open(open_.drop("label"), labels)
    sizes = labels.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("size"))
    wide = classes.select(F.col("rep").alias("c"), "occ", "sketch", "bands")
    left = open_.join(sizes, F.col("label") == F.col("l"), "left").join(wide, F.col("rep") == F.col("c"))
    left = tables.save(left.select("key", "band", "rep", "label", F.coalesce("size", F.lit(1)).alias("size"), "n", "occ", "sketch", "bands"))
    one = lambda x: left.select(*[F.col(c).alias(f"{x}{c}") for c in left.columns])
    same = F.lit(None).cast("int")
    for i in reversed(range(p.bands)):
        same = F.when(F.col("xbands")[i] == F.col("ybands")[i], F.lit(i)).otherwise(same)
    order = (F.col("xsize") < F.col("ysize")) | ((F.col("xsize") == F.col("ysize")) & (F.col("xlabel") > F.col("ylabel")))
    rest = one("x").join(
        one("y"),
        (F.col("xkey") == F.col("ykey")) & (F.col("xlabel") != F.col("ylabel")) & order & alike(F.col("xn"), F.col("yn")) & (same == F.col("xband").cast("int")) & estimate_at_least("x", "y", p.percent),
    )
    last = confirm(tables.save(rest.select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct()), docs, p, tables)
    return merged(labels, last, tables).select(F.col("node").alias("rep"), F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, p: Params = Params(), tables: shared.Tables | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (whether it is that one) and
    text_hash (xxhash64 of the text, which with doc_id tells rows with equal ids apart).

    Null and empty texts and texts without words have no shingles and link with nothing; equal sets always link, whatever their
    length. Rows with equal doc_ids and texts are one document: all of them are kept or none. Rows with equal doc_ids and different
    sets are judged each by its own set (if their id is the smallest of several sets, these count as linked). Rows without doc_id link
    with nothing and are kept. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    tables = tables or shared.Tables(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield signatures(b, p)

    sig = tables.save(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(shared.released(run), "doc_id long, text_hash long, n long, f1 long, f2 long, occ long, bands array<long>, sketch array<long>"))
    real = sig.where("n > 0 and doc_id is not null")
    classes = tables.save(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.max("occ").alias("occ"), F.max("bands").alias("bands"), F.max("sketch").alias("sketch"), F.count("*").alias("copies")))
    final = tables.save(links(classes, docs, p, tables))
    per_class = tables.save(classes.where("copies > 1").select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.col("n").alias("size"), "rep"))
    tables.keep(sig, final, per_class)
    rows = sig.select("doc_id", "text_hash", "n", "f1", "f2")
    rows = rows.join(per_class, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & (F.col("n") == F.col("size")), "left")
    rows = rows.select("doc_id", "text_hash", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("mine"))
    rows = rows.join(final.withColumnRenamed("rep", "of"), F.col("mine") == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "mine")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
