"""Toxicity: a bidirectional gated recurrent network with attention pooling, over windows of words that overlap.

A word's input adds up learned vectors of the whole word and of its first and last characters (hashed), so that inflected and glued forms
of a stem share what is learned. Attention weighs a window's states into one logit; a text's score is its highest window's. Labels
are of whole texts: training takes 1 - product of (1 - p) over a text's windows as its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import gru
from .tokens import _TABLE, ALNUM, HASH_BYTES, Words, column, mix, powers, slices

f32, _U = np.float32, np.uint64
WINDOW, STRIDE, HIDDEN, WIDTH, BUCKETS = 32, 16, 8, 8, 1 << 13
#: First bytes of a word that are inputs, last bytes, and the word itself.
FIRST, LAST = (3, 4, 5, 6, 7), (4,)
KINDS = len(FIRST) + len(LAST) + 1
GROUP = 2048
#: The training sample: texts of each label. All their windows count; a step's gradient goes through a text's highest STEP_WINDOWS.
MAX_TOXIC, MAX_CLEAN, STEP_WINDOWS = 1000, 2000, 24
THRESHOLD = 0.7
#: Part of a word's inputs that a training step leaves out.
DROP = 0.3


def inputs(words: Words) -> np.ndarray:
    """(words, KINDS) rows of the input table."""
    out = np.empty((len(words.starts), KINDS), np.int32)
    at = 0
    while at < len(words.starts):  # some bytes at a time, so that memory doesn't grow with a text
        end = max(at + 1, int(np.searchsorted(words.ends, words.starts[at] + HASH_BYTES, "right")))
        lo = int(words.starts[at])
        buf = words.buf[lo : int(words.ends[end - 1])]
        s, e = words.starts[at:end] - lo, words.ends[at:end] - lo
        p, inv = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, _U)
        np.cumsum(_TABLE[True][buf] * p[: len(buf)], out=total[1:])
        spans = [(s, np.minimum(s + k, e)) for k in FIRST] + [(np.maximum(e - k, s), e) for k in LAST] + [(s, e)]
        for k, (a, b) in enumerate(spans):
            h = (total[b] - total[a]) * inv[a]
            out[at:end, k] = (mix(h + _U(k)) >> _U(51)).astype(np.int32) + k * BUCKETS
        at = end
    return out


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each window; every word is in one, and a text without words has none."""
    n = np.diff(words.off)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = words.off[:-1][doc] + nth * STRIDE
    return doc, first, np.minimum(words.off[1:][doc] - first, WINDOW)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    #: Subtracted from logits, so that a score of 0.7 is the best cut on the training texts.
    cut: float = 0.0

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        small = lambda *s: r.normal(0, 0.2, s).astype(f32)
        h = HIDDEN
        return cls(
            {"table": small(KINDS * BUCKETS, WIDTH) * f32(0.5), "wf": small(WIDTH, 3 * h), "wb": small(WIDTH, 3 * h), "uf": small(h, 3 * h), "ub": small(h, 3 * h), "bf": np.zeros(3 * h, f32), "bb": np.zeros(3 * h, f32), "att": small(2 * h), "out": small(2 * h), "bias": np.full(1, -3, f32)}
        )

    def embed(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the input table's rows."""
        e = self.p["table"].take(rows[:, 0], axis=0)
        for k in range(1, KINDS):
            e += self.p["table"].take(rows[:, k], axis=0)
        return e

    def train(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], toxic: np.ndarray, clean_weight: float = 1.0, epochs: int = 6, batch: int = 16, seed: int = 3) -> None:
        """texts: of each the input rows of its words, and its windows' first words and lengths.

        clean_weight: how many texts a clean one of the sample stands for, against a toxic one.
        """
        r, p = np.random.default_rng(seed), self.p
        adam = gru.Adam(p, 0.01)
        usable = [i for i, t in enumerate(texts) if len(t[1])]
        # every fifth text of each label sets the cut, the others train
        pos, neg = [i for i in usable if toxic[i]], [i for i in usable if not toxic[i]]
        order = [*pos[::5], *neg[::5]]
        pos, neg = [x for k, x in enumerate(pos) if k % 5], [x for k, x in enumerate(neg) if k % 5]
        rounds = max(150, epochs * -(-(len(pos) + len(neg)) // batch))
        for k in range(rounds if pos and neg else 0):
            adam.rate = 0.01 * (1 - k / rounds) + 0.0005
            chosen = [*r.choice(pos, batch // 2), *r.choice(neg, batch // 2)]
            rows, first, length, doc = [], [], [], []
            others = np.zeros(len(chosen), np.float64)  # what a text's further windows add to -log of no toxic window
            at = 0
            for d, i in enumerate(chosen):
                w, f, n = texts[i]
                if len(f) > STEP_WINDOWS:
                    low = self.logits(w, f, n)
                    top = np.argpartition(-low, STEP_WINDOWS)
                    others[d] = np.logaddexp(0, low[top[STEP_WINDOWS:]]).sum()
                    f, n = f[top[:STEP_WINDOWS]], n[top[:STEP_WINDOWS]]
                rows.append(w)
                first.append(f + at)
                length.append(n)
                doc.append(np.full(len(f), d))
                at += len(w)
            rows, first, length, doc = (np.concatenate(x) for x in (rows, first, length, doc))
            y = np.array([toxic[i] for i in chosen], f32)
            place = np.minimum(first[:, None] + np.arange(WINDOW), first[:, None] + length[:, None] - 1).T
            mask = (np.arange(WINDOW)[:, None] < length).astype(f32)
            keep = (r.random(rows.shape) > DROP).astype(f32) / f32(1 - DROP)
            e = (p["table"][rows] * keep[:, :, None]).sum(1)
            x = e[place] * mask[:, :, None]
            sf, cf = gru.forward(x @ p["wf"] + p["bf"], p["uf"])
            sb, cb = gru.forward((x @ p["wb"] + p["bb"])[::-1], p["ub"])
            s = np.concatenate((sf, sb[::-1]), axis=2)
            a = s @ p["att"] + (mask - 1) * f32(1e4)
            a = np.exp(a - a.max(0))
            a /= a.sum(0)
            pooled = (a[:, :, None] * s).sum(0)
            logit = pooled @ p["out"] + p["bias"]
            soft = np.logaddexp(0, logit)
            none = np.bincount(doc, soft, len(chosen)) + others  # -log of the probability that no window is toxic
            weight = np.where(y > 0, -1.0 / np.expm1(np.maximum(none, 1e-4)), 1.0)
            d = (np.clip(weight, -50, 50)[doc] * gru.sigmoid(logit) / batch).astype(f32)
            grads = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
            dp = d[:, None] * p["out"]
            da = (s * dp).sum(2)
            da = a * (da - (a * da).sum(0))
            ds = a[:, :, None] * dp + da[:, :, None] * p["att"]
            grads["att"] = np.einsum("tbh,tb->h", s, da)
            xf, grads["uf"] = gru.backward(ds[:, :, :HIDDEN], p["uf"], cf)
            xb, grads["ub"] = gru.backward(np.ascontiguousarray(ds[::-1, :, HIDDEN:]), p["ub"], cb)
            xb = xb[::-1]
            flat = x.reshape(-1, WIDTH)
            for way, g in (("f", xf), ("b", xb)):
                g2 = g.reshape(-1, 3 * HIDDEN)
                grads[f"w{way}"], grads[f"b{way}"] = flat.T @ g2, g2.sum(0)
            dx = ((xf @ p["wf"].T + xb @ p["wb"].T) * mask[:, :, None]).reshape(-1, WIDTH)
            of = rows[place.reshape(-1)].reshape(-1)
            spread = (dx[:, None, :] * keep[place.reshape(-1)][:, :, None]).reshape(-1, WIDTH)
            grads["table"] = np.stack([np.bincount(of, spread[:, j], len(p["table"])) for j in range(WIDTH)], axis=1).astype(f32)
            adam.update(grads)
        if pos and neg and 0 < sum(toxic[i] for i in order) < len(order):
            best = np.array([self.logits(t[0], t[1], t[2]).max() for t in (texts[i] for i in order)])
            self.cut = _best_cut(best, np.array([toxic[i] for i in order]), clean_weight)

    def logits(self, rows: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of windows over input rows of words."""
        out = np.empty(len(first), f32)
        e = self.embed(rows)
        p = self.p
        order = np.argsort(-length, kind="stable")
        for g in range(0, len(order), GROUP):
            own = order[g : g + GROUP]
            f, n = first[own], length[own]
            steps = int(n[0])
            active = np.searchsorted(-n, -np.arange(steps), "left")
            sides = []
            for way in "fb":
                w, b, u = p[f"w{way}"], p[f"b{way}"], p[f"u{way}"]
                h = np.zeros((len(own), HIDDEN), f32)
                states = np.zeros((steps, len(own), HIDDEN), f32)
                for t in range(steps):
                    m = int(active[t])
                    at = f[:m] + t if way == "f" else f[:m] + n[:m] - 1 - t
                    h[:m] = gru.step(h[:m], e.take(at, axis=0) @ w + b, u)
                    states[t, :m] = h[:m]
                sides.append(states)
            back = sides[1][np.maximum(n - 1 - np.arange(steps)[:, None], 0), np.arange(len(own))]
            a = sides[0] @ p["att"][:HIDDEN] + back @ p["att"][HIDDEN:]
            a = np.exp(np.where(np.arange(steps)[:, None] < n, a, f32(-1e4)) - a.max(0))
            v = sides[0] @ p["out"][:HIDDEN] + back @ p["out"][HIDDEN:]
            out[own] = (a * v).sum(0) / a.sum(0) + p["bias"]
        return out

    def texts(self, column_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, and its windows; a text without words has score 0."""
        score, count = np.zeros(len(column_)), np.zeros(len(column_), np.int64)
        for i, j, buf, base in slices(column_):
            words = Words(buf, base, ALNUM)
            doc, first, length = windows(words)
            if len(doc):
                l = self.logits(inputs(words), first, length)
                begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                top = np.maximum.reduceat(l, begin).astype(float) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
                score[i + doc[begin]] = 1 / (1 + np.exp(-np.clip(top, -50, 50)))
                count[i : j] = np.bincount(doc, minlength=j - i)
        return score, count


def _best_cut(logits: np.ndarray, toxic: np.ndarray, clean_weight: float = 1.0) -> float:
    """The cut of best F1, in the middle between the logits around it."""
    order = np.argsort(-logits, kind="stable")
    hits, wrong = np.cumsum(toxic[order]), np.cumsum(1 - toxic[order]) * clean_weight
    f1 = 2 * hits / (hits + wrong + toxic.sum())
    k = int(np.argmax(f1))
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 2
    return float((logits[order[k]] + low) / 2)


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """(toxic, text) of at most MAX_TOXIC and MAX_CLEAN labelled texts by a hash of doc_id.

    Of rows with an equal doc_id one counts; a doc_id with both labels is toxic.
    """
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    top = lambda y, n: chosen.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    few = F.broadcast(top(1, MAX_TOXIC).unionByName(top(0, MAX_CLEAN)))
    rows = docs.join(few, F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    return [(r["toxic"], r["text"] or "") for r in sorted(rows.select("_id", "toxic", "one.text").collect(), key=lambda r: r["_id"])]


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A trained network; with no labels of one kind it stays as it begins and finds nothing."""
    net, texts, toxic = Network.new(), [], []
    for y, text in sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels):
        raw = np.frombuffer(text.encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]), ALNUM)
        texts.append((inputs(words), *windows(words)[1:]))
        toxic.append(y)
    if not (0 < sum(toxic) < len(toxic)):
        net.cut = 100.0
        return net
    all_ = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    part = [toxic.count(y) / max(1, all_.get(y, 0)) for y in (0, 1)]
    net.train(texts, np.array(toxic), part[1] / part[0])
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, predicted and windows of every row; null and empty texts have score 0 and no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = net.texts(column(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(n)], names=["doc_id", "score", "predicted", "windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, windows long")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns labels of rows whose crc32(doc_id as text) mod 3 isn't 1 and scores all documents; rows without doc_id are held out.

    A score depends on the text alone: repeated rows and ties get equal ones, null and empty texts 0, and texts of any length are
    scored over all their windows. Null labels don't count; without labels of both kinds all scores are near 0. An empty table gives no
    rows; other columns aren't read.
    """
    remainder = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    net = fit(docs.where(~remainder()), labels.where(~remainder()))
    return score(docs, net).select("doc_id", remainder().alias("held_out"), "score", "predicted", "windows")
