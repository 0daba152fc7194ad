"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text in pieces of CHUNK bytes, gives each byte a probability of each language, and a text's are their means. It is
trained on the driver by backpropagation through time, on windows of bytes from at most MAX_DOCS documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import gru
from .tokens import column, parts_of, slices

f32 = np.float32
CHUNK, HIDDEN, GROUP = 192, 8, 1536
#: The training sample: documents, in equal parts of each language, and windows of so many bytes, drawn from all of each text.
MAX_DOCS, WINDOWS, PIECE = 4000, 3, 320
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        h, k = HIDDEN, max(1, len(langs))
        small = lambda *s: r.normal(0, 0.3, s).astype(f32)
        p = {"xf": small(256, 3 * h), "xb": small(256, 3 * h), "uf": small(h, 3 * h), "ub": small(h, 3 * h), "vf": small(h, k), "vb": small(h, k), "c": np.zeros(k, f32)}
        return cls(langs, p)

    def train(self, pieces: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 300, batch: int = 128, steps: int = 80, seed: int = 11) -> None:
        """pieces: (n, longest) bytes. Each byte of a batch is to get its text's label."""
        r, p = np.random.default_rng(seed), self.p
        adam = gru.Adam(p, 0.02)
        for k in range(rounds):
            adam.rate = 0.02 * (1 - k / rounds) + 0.001
            rows = r.integers(0, len(pieces), batch)
            at = (r.random(batch) * np.maximum(lengths[rows] - steps + 1, 1)).astype(np.int64)
            x = pieces[rows[:, None], np.minimum(at[:, None] + np.arange(steps), pieces.shape[1] - 1)].T
            mask = (at[:, None] + np.arange(steps) < lengths[rows][:, None]).T.astype(f32)
            sf, cf = gru.forward(p["xf"][x], p["uf"])
            sb, cb = gru.forward(p["xb"][x[::-1]], p["ub"])
            logits = sf @ p["vf"] + sb[::-1] @ p["vb"] + p["c"]
            e = np.exp(logits - logits.max(-1, keepdims=True))
            d = e / e.sum(-1, keepdims=True)
            d[:, np.arange(batch), labels[rows]] -= 1
            d *= mask[:, :, None] / f32(max(mask.sum(), 1) / steps)
            df, uf = gru.backward(d @ p["vf"].T, p["uf"], cf)
            db, ub = gru.backward((d @ p["vb"].T)[::-1], p["ub"], cb)
            flat = d.reshape(-1, d.shape[-1])
            one = np.eye(256, dtype=f32)
            grads = {
                "xf": one[x.reshape(-1)].T @ df.reshape(-1, df.shape[-1]),
                "xb": one[x[::-1].reshape(-1)].T @ db.reshape(-1, db.shape[-1]),
                "uf": uf,
                "ub": ub,
                "vf": sf.reshape(-1, HIDDEN).T @ flat,
                "vb": sb[::-1].reshape(-1, HIDDEN).T @ flat,
                "c": flat.sum(0),
            }
            adam.update(grads)

    def labels(self, chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each piece's sum of its bytes' probabilities. chunks: (n, CHUNK) bytes, longest pieces first."""
        p, k = self.p, len(self.langs)
        n, steps = len(chunks), int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # pieces longer than t
        turned = chunks[np.arange(n)[:, None], np.maximum(lengths[:, None] - 1 - np.arange(steps), 0)]
        sides = []
        for seen, x, u, v in ((chunks, "xf", "uf", "vf"), (turned, "xb", "ub", "vb")):
            h = np.zeros((n, HIDDEN), f32)
            out = np.zeros((steps, n, k), f32)
            by_step = np.ascontiguousarray(seen[:, :steps].T)
            for t in range(steps):
                m = int(active[t])
                h[:m] = gru.step(h[:m], p[x].take(by_step[t, :m], axis=0), p[u])
                np.matmul(h[:m], p[v], out=out[t, :m])
            sides.append(out)
        logits = sides[0]
        logits += sides[1][np.maximum(lengths - 1 - np.arange(steps)[:, None], 0), np.arange(n)]
        logits += p["c"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        logits *= (np.arange(steps)[:, None] < lengths)[:, :, None]
        return logits.sum(0)

    def texts(self, column_: pa.Array) -> np.ndarray:
        """Probabilities of each text of a column, pooled over all its bytes; an empty text has zeros."""
        out = np.zeros((len(column_), len(self.langs)))
        for i, j, buf, base in slices(column_):
            size = np.diff(base)
            pieces = -(-size // CHUNK)
            doc = np.repeat(np.arange(j - i), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = base[:-1][doc] + nth * CHUNK
            length = np.minimum(size[doc] - nth * CHUNK, CHUNK)
            order = np.argsort(-length, kind="stable")
            padded = np.concatenate((buf, np.zeros(CHUNK, np.uint8)))
            for g in range(0, len(order), GROUP):
                rows = order[g : g + GROUP]
                chunks = padded[start[rows][:, None] + np.arange(CHUNK)]
                np.add.at(out, i + doc[rows], self.labels(chunks, length[rows]))
        total = out.sum(1, keepdims=True)
        return out / np.where(total > 0, total, 1)


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> list[tuple[str, bytes]]:
    """(lang, window) of at most max_docs documents with a language, by a hash of doc_id, as many of each language as there are.

    Windows begin anywhere in the text, also inside a character, as the network's pieces do. Of rows with an equal doc_id one counts.
    """
    rows = docs.where("lang is not null and doc_id is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(1, max_docs // len(counts))
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.3 * each / n)))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    raw = F.encode("text", "utf-8")
    at = lambda s: F.pmod(F.xxhash64("doc_id", F.lit(s)), F.greatest(F.octet_length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.where(u < share[F.col("lang")]).select("doc_id", "lang", F.xxhash64("text").alias("h"), F.array(*[F.substring(raw, at(s), F.lit(PIECE)) for s in range(WINDOWS)]).alias("pieces"))
    one = chosen.groupBy("doc_id").agg(F.min(F.struct("h", "lang", "pieces")).alias("one")).select("doc_id", "one.*")
    by: dict[str, list] = {}
    for r in sorted(one.collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)):
        by.setdefault(r["lang"], []).append([bytes(x) for x in r["pieces"]])
    return [(k, piece) for k in sorted(by) for pieces in by[k][:each] for piece in dict.fromkeys(pieces) if piece]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Network:
    """A network for the languages of docs; without labelled texts it knows none."""
    found = sample(docs, max_docs)
    langs = sorted({k for k, _ in found})
    net = Network.new(langs)
    if len(langs) > 1:
        raw = [x for _, x in found]
        lengths = np.array([len(x) for x in raw])
        pieces = np.zeros((len(raw), lengths.max()), np.uint8)
        for row, x in zip(pieces, raw):
            row[: len(x)] = np.frombuffer(x, np.uint8)
        net.train(pieces, lengths, np.array([langs.index(k) for k, _ in found]))
    return net


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numbers and marks aren't."""
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score. Null texts and texts without letters are `und` with score 0, as is all if no language is known.

    A text's prediction depends on the text alone, so repeated rows get equal ones; of languages with equal scores the first by name wins.
    Texts of any length are read to their end, some megabytes at a time. An empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts_of(whole, "text", 8_000_000)):
            texts = column(b, "text")
            p = net.texts(texts)
            letters = [bool(net.langs) and has_letter(t.as_py()) for t in texts]
            best = p.argmax(1) if net.langs else np.zeros(len(p), int)
            names = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            score = [min(1.0, float(p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 4 isn't 2 and predicts all; rows without doc_id are held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    net = fit(docs.select("doc_id", "text", "lang").where(~held))
    return predict(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
