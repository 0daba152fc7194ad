"""Token ids: encoding with a public tokenizer, Simple-8b files, and reading them back.

A file: the magic bytes KFS8, then seven little-endian uint64 (version, documents, ids, ids a block, blocks, words,
end id), the documents' id counts and doc_ids, the first word of each block, the words, and a bit for each document whose doc_id is
null. A block holds the same number
of ids in every file (the last one may be shorter) and starts on a word of its own, so that blocks decode by themselves
and all at once.

Simple-8b: the top 4 bits of a word select how many values of how many bits the other 60 bits hold, lowest first.
Selector 15 is an escape: the next word holds one value of up to 64 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shared
from .tokens import _TABLE, SECOND, column, slices, span_hashes

MAGIC, VERSION, BLOCK = b"KFS8", 2, 512
#: Selector k holds COUNTS[k] values of 60 // COUNTS[k] bits; fixed values of the coding.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // c for c in COUNTS)
ESCAPE = 15
_U = np.uint64


_SMALL = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    if values.max(initial=0) < len(_SMALL):
        return _SMALL[values]
    out = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = rest >> _U(k) != 0
        out += big.astype(np.uint8) * np.uint8(k)
        rest = np.where(big, rest >> _U(k), rest)
    return out + (rest != 0)


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each place the selector that takes most values from there; no word passes the end of its block."""
    n = len(values)
    need = np.full(-(-n // block) * block, 64, np.uint8)  # what lies past the end fits nowhere
    need[:n] = _bits(values)
    need = need.reshape(-1, block)
    best = np.where(need <= BITS[-1], np.uint8(len(COUNTS) - 1), np.uint8(ESCAPE))
    widest = {1: need}  # of the next 1, 2, 4, ... values
    for k in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[k]
        if count > block:
            break
        p = 1 << (count.bit_length() - 1)
        if p not in widest:
            a = widest[p // 2]
            widest[p] = np.maximum(a[:, : a.shape[1] - p // 2], a[:, p // 2 :])
        a = widest[p]
        most = np.maximum(a[:, : block - count + 1], a[:, count - p : block - p + 1])
        np.copyto(best[:, : block - count + 1], k, where=most <= BITS[k])
    return best.reshape(-1)[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values and the first word of each block."""
    values = np.ascontiguousarray(values, dtype=_U)
    n = len(values)
    if not n:
        return np.empty(0, _U), np.empty(0, _U)
    firsts = np.arange(0, n, block)
    lasts = np.minimum(firsts + block, n)
    chosen = _selectors(values, block)
    take = np.array([*COUNTS, 0, 1])[chosen]
    starts = np.zeros(n, bool)
    at, end = firsts, lasts
    while len(at):  # one word further in all blocks at a time
        starts[at] = True
        at = at + take[at]
        open_ = at < end
        at, end = at[open_], end[open_]
    at = np.flatnonzero(starts)
    picked = chosen[at]
    size = np.where(picked == ESCAPE, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), _U)
    for k, (count, bits) in enumerate(zip(COUNTS, BITS)):
        own = np.flatnonzero(picked == k)
        if len(own):
            w = np.full(len(own), k << 60, _U)
            for j in range(count):
                w |= values[at[own] + j] << _U(bits * j)
            words[where[own]] = w
    own = np.flatnonzero(picked == ESCAPE)
    words[where[own]] = _U(ESCAPE << 60)
    words[where[own] + 1] = values[at[own]]
    return words, where[np.searchsorted(at, firsts)].astype(_U)


def decode(words: np.ndarray, blocks: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of all blocks. A raw word after an escape isn't mistaken for a selector."""
    if not n:
        return np.empty(0, _U)
    kind = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    firsts = np.zeros(len(words), bool)
    firsts[blocks.astype(np.int64)] = True
    for i in np.flatnonzero(kind == ESCAPE):  # in order: a raw word may look like an escape
        if not raw[i]:
            raw[i + 1] = True
    sizes = np.array([*COUNTS, 0, 1])[kind]
    sizes[raw] = 0
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), _U)
    for k, (count, bits) in enumerate(zip(COUNTS, BITS)):
        own = np.flatnonzero((kind == k) & ~raw)
        if len(own):
            mask = _U((1 << bits) - 1)
            for j in range(count):
                out[start[own] + j] = words[own] >> _U(bits * j) & mask
    own = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[start[own]] = words[own + 1]
    if len(out) != n:
        raise ValueError(f"{len(out)} values, not {n}")
    return out


class File:
    """A file in the making: ids are packed as they come, so that what is held is compressed."""

    def __init__(self, end_id: int, block: int = BLOCK):
        self.end_id, self.block = end_id, block
        self.words: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rest = np.empty(0, np.uint32)
        self.size = self.ids = 0

    def add(self, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, null, counts))
        self.ids += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // self.block * self.block
        self.pack(ids[:whole])
        self.rest = ids[whole:]

    def pack(self, ids: np.ndarray) -> None:
        words, firsts = encode(ids, self.block)
        self.words.append(words)
        self.firsts.append(firsts + _U(self.size))
        self.size += len(words)

    def bytes(self) -> bytes:
        self.pack(self.rest)
        doc_ids, null, counts = (np.concatenate(x) for x in zip(*self.docs))
        blocks = np.concatenate(self.firsts)
        head = MAGIC + struct.pack("<7Q", VERSION, len(counts), self.ids, self.block, len(blocks), self.size, self.end_id)
        parts = (counts.astype("<u8"), doc_ids.astype("<i8"), blocks.astype("<u8"), *(w.astype("<u8", copy=False) for w in self.words), np.packbits(null))
        return b"".join((head, *(x.tobytes() for x in parts)))


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which of them are null, id counts and ids of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, docs, n, block, blocks, words, _ = struct.unpack_from("<7Q", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version}")
    at = 4 + 56
    parts = []
    for count, kind in ((docs, "<u8"), (docs, "<i8"), (blocks, "<u8"), (words, "<u8")):
        parts.append(np.frombuffer(data, kind, count, at))
        at += 8 * count
    counts, doc_ids, first, w = parts
    null = np.unpackbits(np.frombuffer(data, np.uint8, -1, at), count=docs).astype(bool)
    return doc_ids, null, counts.astype(np.int64), decode(w.astype(_U, copy=False), first, n, block)


class Encoder:
    """Ids of whole texts, as encode(text, add_special_tokens=False) of the tokenizers library gives them.

    A byte-level tokenizer with the usual pattern always cuts at some places, whatever stands around them: before a space that
    something visible follows, between an ASCII letter and ASCII punctuation, and after a line's end between something visible
    and a letter. Texts are cut there, and each different part is encoded once while it is remembered; the parts of a batch are
    told apart by Arrow's dictionary, the remembered ones by two 64-bit hashes. Texts with a special token's name, and all texts of
    other kinds of tokenizers, are one part each.
    """

    #: Parts and ids that are remembered; beyond that all are forgotten.
    CACHE, IDS = 600_000, 4_000_000

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        cutter = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        self.cuttable = self.tok.normalizer is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True and not cutter.get("add_prefix_space")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.clear()

    def clear(self) -> None:
        """Of the known parts, sorted by the first hash: both hashes, and where in flat their ids are."""
        self.first, self.second = np.empty(0, _U), np.empty(0, _U)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def borders(self, texts: pa.Array, buf: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Where parts begin, and the end of the last."""
        n = len(buf)
        starts = np.zeros(n + 1, bool)
        if self.cuttable and n:
            kind = _KIND[buf]
            after = np.empty(n, np.uint8)
            after[:-1], after[-1:] = kind[1:], 0
            after[base[1:][base[1:] > 0] - 1] = 0  # nothing follows the last character of a text
            starts[:n] = (buf == 0x20) & (after & _SOLID != 0)
            starts[1:n] |= (kind[:-1] & _LETTER != 0) & (kind[1:] & _SIGN != 0)
            starts[2:n] |= (kind[:-2] & (_LETTER | _SIGN | _DIGIT) != 0) & (buf[1:-1] == 0x0A) & (kind[2:] & _LETTER != 0)
            for name in self.special:
                for k in np.flatnonzero(pc.match_substring(texts, name).to_numpy(zero_copy_only=False)):
                    starts[base[k] : base[k + 1]] = False
        starts[base] = True
        return np.flatnonzero(starts)

    def encode_parts(self, parts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each has. plain: a word of letters, perhaps after a space."""
        out: list[list[int]] = [[]] * len(parts)
        where = np.flatnonzero(plain).tolist()
        if where:  # such a part isn't cut further: the model's merges are all there is to do
            spelled = _SPELL[np.frombuffer(b"\n".join([parts[k] for k in where]), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            tokenize = self.model.tokenize
            for k, x in zip(where, spelled):
                out[k] = [t.id for t in tokenize(x)]
        rest = np.flatnonzero(~plain).tolist()
        spaced = [k for k in rest if parts[k][:1] == b" " and not any(s.encode() in parts[k] for s in self.special)] if self.cuttable else []
        for i in range(0, len(spaced), 4000):  # many in one call, told apart by the tokens that begin with a space
            some = spaced[i : i + 4000]
            ids = np.array(self.tok.encode_batch_fast([b"".join([parts[k] for k in some]).decode()], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some) and not at[0]:
                for k, x in zip(some, np.split(ids, at[1:])):
                    out[k] = x.tolist()
        each = [k for k in rest if not out[k]]
        for k, e in zip(each, self.tok.encode_batch_fast([parts[k].decode() for k in each], add_special_tokens=False)):
            out[k] = e.ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes

    def learn(self, data: np.ndarray, edges: np.ndarray, new: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Encodes the parts `new` of data (cut at edges) and remembers them."""
        odd = np.concatenate(([0], np.cumsum(~_PLAIN[data] | _cross(data))))
        lo, hi = edges[:-1][new], edges[1:][new]
        begin = lo + (data[np.minimum(lo, max(0, len(data) - 1))] == 0x20)
        plain = (odd[hi] == odd[begin]) & (hi > begin) & self.cuttable
        raw = data.tobytes()
        ids, sizes = self.encode_parts([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())], plain)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        all_ = np.concatenate((self.first, first[new]))
        order = np.argsort(all_, kind="stable")
        self.first = all_[order]
        self.second = np.concatenate((self.second, second[new]))[order]
        self.begin = np.concatenate((self.begin, self.used + np.cumsum(sizes) - sizes))[order]
        self.size = np.concatenate((self.size, sizes))[order]
        self.used += len(ids)

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where the parts of these hashes are among the known ones, or -1."""
        if not len(self.first):
            return np.full(len(first), -1, np.int64)
        at = np.searchsorted(self.first, first)
        at[at == len(self.first)] = 0
        known = self.first[at] == first
        for k in np.flatnonzero(known & (self.second[at] != second)):  # parts with the same first hash stand side by side
            same = np.arange(at[k], np.searchsorted(self.first, first[k], "right"))
            match = same[self.second[same] == second[k]]
            known[k] = len(match) > 0
            at[k] = match[0] if len(match) else 0
        return np.where(known, at, -1)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; texts: large_string without nulls."""
        counts, all_ids = [], []
        for i, j, buf, base in slices(texts, 4_000_000):
            if len(self.first) > self.CACHE or self.used > self.IDS:
                self.clear()
            edges = self.borders(texts.slice(i, j - i), buf, base)
            ids = np.empty(0, np.uint32)
            ends = np.zeros(1, np.int64)
            if len(edges) > 1:
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(buf)]).dictionary_encode()
                codes, kinds = parts.indices.to_numpy(), parts.dictionary
                off = np.frombuffer(kinds.buffers()[1], np.int64, len(kinds) + 1)
                data = np.frombuffer(kinds.buffers()[2], np.uint8)[: off[-1]]
                first, second = (span_hashes(data, off[:-1], off[1:], t) for t in (_TABLE[False], SECOND))
                at = self.places(first, second)
                if (at < 0).any():
                    self.learn(data, off, np.flatnonzero(at < 0), first, second)
                    at = self.places(first, second)
                begin, took = self.begin[at][codes], self.size[at][codes]
                ends = np.concatenate((ends, np.cumsum(took)))
                ids = self.flat[np.repeat(begin - ends[:-1], took) + np.arange(int(ends[-1]))]
            counts.append(np.diff(ends[np.searchsorted(edges, base)]))
            all_ids.append(ids)
        return (np.concatenate(all_ids) if all_ids else np.empty(0, np.uint32)), (np.concatenate(counts) if counts else np.empty(0, np.int64))


def _cross(data: np.ndarray) -> np.ndarray:
    """The signs for times and division, which share their first byte with letters."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    return out


# Classes of bytes: ASCII letters, digits and other visible signs, and what surely begins something visible. Lead bytes of characters
# that may be white space aren't among the last.
_LETTER, _DIGIT, _SIGN, _SOLID = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
for _b in range(0x21, 0x7F):
    _KIND[_b] = _SOLID | (_LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _SIGN)
for _b in range(0xC3, 0xF5):
    _KIND[_b] = 0 if _b in (0xE1, 0xE2, 0xE3) else _SOLID
#: Bytes of ASCII and Latin-1 letters.
_PLAIN = np.array([chr(b).isalpha() and b < 128 or b == 0xC3 or 0x80 <= b < 0xC0 for b in range(256)])
#: How a byte-level vocabulary spells the bytes that aren't visible (fixed values of the coding); a line's end tells words apart here.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100), 0x0A}
_SPELL = np.arange(256, dtype="<u4")
for _k, _b in enumerate(b for b in range(256) if b not in _SHOWN - {0x0A}):
    _SPELL[_b] = 0x0A if _b == 0x0A else 256 + _k


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs, folder: str, tokenizer: str, end_id: int = 2, file_ids: int = 4_000_000, id_column: str = "doc_id", text_column: str = "text"):
    """Writes documents in ascending order of id as files of about file_ids ids; returns the manifest, a list of dicts in order.

    Null texts are empty (the end id only), null ids come first, rows with equal ids stand in order of a hash of their text, and
    repeated rows stay. Texts of any length are encoded whole. An empty table gives no file. Each task writes the files of one range
    of ids, named by range and number, under temporary names and renames them; the same rows give the same files. Of the table no
    other column is read.
    """
    from pyspark.sql import functions as F

    from .ranges import by_range, place

    spark = docs.sparkSession
    shared.make_dir(folder)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    key, tie = place(F.col("doc_id"), F.col("text"))
    ordered = by_range(rows.select("doc_id", "text", key.alias("_id"), tie.alias("_tie")), F.octet_length("text") + 8)
    ordered = ordered.sortWithinPartitions("_shard", F.col("doc_id").asc_nulls_first(), "_tie", "text").select("_shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        now, part, held, files = None, 0, None, []

        def flush() -> None:
            nonlocal held, part
            if held is None:
                return
            data = held.bytes()
            name = f"{now:06d}-{part:05d}.kfs8"
            shared.write_file(folder, name, data)
            files.append({"file": name, "docs": sum(len(d[0]) for d in held.docs), "ids": held.ids, "bytes": len(data), "crc": zlib.crc32(data)})
            held, part = None, part + 1
            shared.release()

        for b in batches:
            shards = b.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
            for i, j in zip(cuts, cuts[1:]):
                if shards[i] != now:
                    flush()
                    now, part = int(shards[i]), 0
                own = b.slice(i, j - i)
                texts, keys = column(own, "text"), own.column("doc_id")
                null = keys.is_null().to_numpy(zero_copy_only=False)
                keys = keys.fill_null(0).to_numpy()
                for lo, hi, _, _ in slices(texts, 4_000_000):
                    ids, counts = enc.batch(texts.slice(lo, hi - lo))
                    held = held or File(end_id)
                    held.add(keys[lo:hi], null[lo:hi], counts + 1, np.insert(ids, np.cumsum(counts), end_id))
                    if held.ids >= file_ids:
                        flush()
        flush()
        yield pa.RecordBatch.from_pylist(files, schema=MANIFEST)

    found = sorted((r.asDict() for r in ordered.mapInArrow(shared.released(run), "file string, docs long, ids long, bytes long, crc long").collect()), key=lambda r: r["file"])
    start = 0
    for r in found:
        r["start"] = start
        start += r["ids"]
    import json

    shared.write_file(folder, "manifest.json", json.dumps(found).encode())
    return found


MANIFEST = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("crc", pa.int64())])


def read(spark, folder: str, manifest: list[dict]):
    """Per document of the files: doc_id, start, n_tokens and ids_crc32; several files are decoded in a task at most."""
    from pyspark.sql import functions as F

    listed = spark.createDataFrame([(r["file"], r["start"], r["crc"]) for r in manifest], "file string, start long, crc long")
    n = max(1, min(len(manifest), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # all is written
        shared.release()
        for b in batches:
            for name, start, sum_ in zip(*(b.column(k).to_pylist() for k in ("file", "start", "crc"))):
                data = shared.read_file(f"{folder}/{name}")
                if zlib.crc32(data) != sum_:
                    raise ValueError(f"{name} isn't as it was written")
                doc_ids, null, counts, ids = unpack_file(data)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64(), mask=null),
                        pa.array(start + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listed.repartition(n, F.col("file")).mapInArrow(shared.released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs, tokenizer: str, end_id: int = 2):
    """The documents' digests (doc_id, start, n_tokens, ids_crc32) from files that are written to the shared folder first.

    A row for each row of docs, also for repeated ones and for null ids and texts; none for an empty table.
    """
    spark = docs.sparkSession
    folder = shared.shared_dir(spark)
    return read(spark, folder, write(docs, folder, tokenizer, end_id))
