"""Secrets: fixed patterns, and values in a credential's place that would take many guesses.

guess_log10 gives the least number of guesses (as log10) over all ways to cut a value into words, dates, repeats, keyboard walks
and spans to be tried by brute force, found by dynamic programming over the value's places, in time that grows with its length. Words
are ranked: a few that passwords are made of come first, then the whole words of a public tokenizer's vocabulary in its order, which is
that of their frequency; the vocabulary's path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import column, parts_of

KINDS = ("assign", "access", "hex", "guess")
#: From this many guesses on (log10), a value of GUESS_CHARS or more is a secret.
GUESS_LOG10, GUESS_CHARS = 9.0, 6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Places where a credential stands: its name, a sign or word between, and the value, which a quote before it may end.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|credentials?|private_?key|access_?key|auth)["']?[\x20\t]*(?P<sign>:=|=>|[:=]|\bis\b[\x20\t]*:?)[\x20\t]*(?:bearer[\x20]+|basic[\x20]+)?(?:"(?P<a>[^"\n]+)"|'(?P<b>[^'\n]+)'|`(?P<c>[^`\n]+)`|["'`]?(?P<d>[^\s"'`,;<>(){}\[\]]+))""",
    re.IGNORECASE | re.ASCII,
)
NAMES = ("pass", "pwd", "secret", "token", "api_key", "apikey", "credential", "private_key", "privatekey", "access_key", "accesskey", "auth")

# Common words of passwords, most common first.
WORDS = """password admin welcome login letmein master hello monkey dragon secret user test root guest default changeme pass love
shadow sunshine princess football baseball iloveyou superman batman trustno access hunter flower summer winter spring autumn
monday friday january december company server database token example sample demo temp public private none null true false
your here value string key my the""".split()
LEET = str.maketrans("4@310$57!", "aaeiossti")
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?\d\d|(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
)
#: log10 of the guesses for a walk's first key, its direction and a turn, and for going on straight.
WALK, TURN, ON = math.log10(47 * 8), math.log10(8), 0.1
#: Places this far inside a run of one character aren't tried as borders: no word has so many equal characters.
MARGIN = 16


@lru_cache(maxsize=4)
def ranks(vocabulary: str | None = None) -> tuple[dict[str, int], int]:
    """Each word's rank, from 1, and the longest word's length."""
    out = {w: i + 1 for i, w in enumerate(WORDS)}
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        for token in sorted(vocab, key=vocab.get):
            word = token[1:].lower()
            if token[0] == "Ġ" and len(word) > 2 and word.isascii() and word.isalpha():
                out.setdefault(word, len(out) + 1)
    return out, max(map(len, out))


def _alphabet(value: str) -> float:
    """log10 of the characters that a guesser of the value would try at each place."""
    n = 0
    if re.search("[0-9]", value):
        n += 10
    if re.search("[g-z]", value):
        n += 26
    elif re.search("[a-f]", value):
        n += 6
    if re.search("[A-Z]", value):
        n += 26
    if re.search("[^0-9A-Za-z]", value):
        n += 33 + 100 * (not value.isascii())
    return math.log10(max(n, 2))


def _repeats(codes: np.ndarray, unit: int) -> np.ndarray:
    """For each place, where whole repeats of the `unit` characters that begin there end."""
    n = len(codes)
    same = np.zeros(n + 1, bool)
    same[: max(0, n - unit)] = codes[: max(0, n - unit)] == codes[unit:]
    breaks = np.where(same, n + 1, np.arange(n + 1))
    run = np.minimum.accumulate(breaks[::-1])[::-1][:n] - np.arange(n)
    return np.minimum(np.arange(n) + unit * (1 + run // unit), n)


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from a key to a neighbouring one."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return q[0] - p[0], q[1] - p[1]
    return None


def guess_log10(value: str, vocabulary: str | None = None) -> float:
    """log10 of the least guesses; an empty value takes one. Values of any length are cut as a whole."""
    n = len(value)
    if not n:
        return 0.0
    rank, longest = ranks(vocabulary)
    low = value.lower()
    if len(low) != n:  # characters that lower case makes longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    each = _alphabet(value)
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    units = [(u, _repeats(codes, u).tolist()) for u in (1, 2, 3, 4)]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], codes[1:] != codes[:-1])), np.arange(n), 0))
    end = np.array(units[0][1])
    inner = (np.arange(n) - start >= MARGIN) & (end - np.arange(n) > MARGIN)
    cut, two = math.log10(2), math.log10(2)  # a guesser must also choose where a piece ends
    best = [math.inf] * (n + 1)
    walking = [math.inf] * (n + 1)  # of a walk whose last key so far is just before the place
    best[0] = 0.0
    last = None
    for i in np.flatnonzero(~inner).tolist():
        b = best[i]
        # a walk goes on with this key, or has its first three here
        way = _step(low[i - 1], low[i]) if i else None
        if way and i > 1:
            before = _step(low[i - 2], low[i - 1])
            if before:
                go = ON if before == way else TURN
                walking[i + 1] = min(walking[i] + go, best[i - 2] + cut + WALK + go)
                best[i + 1] = min(best[i + 1], walking[i + 1])
        if b == math.inf:
            continue
        if b + each < best[i + 1]:  # one more place by brute force
            best[i + 1] = b + each
        if plain[i].isalpha():
            for j in range(i + 2, min(n, i + longest) + 1):
                piece = plain[i:j]
                r = rank.get(piece)
                back = rank.get(piece[::-1])
                if r or back:
                    cost = math.log10(min(r + 1 if r else math.inf, 2 * back + 2 if back else math.inf))
                    part = value[i:j]
                    if part != piece:
                        upper = sum(map(str.isupper, part))
                        cost += (0.0 if not upper else two if upper in (1, j - i) else two * (j - i)) + two * sum(x != y for x, y in zip(low[i:j], piece))
                    if b + cost + cut < best[j]:
                        best[j] = b + cost + cut
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            cost = math.log10(119) if m.end() - i == 4 and value[i : i + 2] in ("19", "20") else math.log10(365 * 119)
            best[m.end()] = min(best[m.end()], b + cost + cut)
            year = value[i : i + 4]
            if m.end() - i > 4 and year.isdigit() and year[:2] in ("19", "20"):
                best[i + 4] = min(best[i + 4], b + math.log10(119) + cut)
        for u, ends in units:
            e = ends[i]
            if e - i >= max(3, 2 * u):
                cost = b + each * u + math.log10((e - i) / u) + cut
                if cost < best[e]:
                    best[e] = cost
                if u == 1 and e - i > MARGIN:  # the run's last places may begin another piece
                    for k in range(max(i + 3, e - MARGIN), e):
                        best[k] = min(best[k], b + each + math.log10(k - i) + cut)
    return best[n]


def find(text: str, vocabulary: str | None = None) -> tuple[list[tuple[int, str, int]], list[float]]:
    """All spans (start, kind, end) in order, ends exclusive, and the guesses (log10) of each value in a credential's place."""
    spans = [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    costs = []
    if any(w in low for w in NAMES):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        for m in CONTEXT.finditer(text):
            kind = m.lastgroup
            value = m.group(kind) if kind != "d" else m.group("d").rstrip(".!?:")
            costs.append(guess_log10(value, vocabulary))
            if kind == "d" and m.group("sign")[0] in "iI" and not OTHER.search(value):
                continue  # "the password is required": prose, in whatever language
            if len(value) >= GUESS_CHARS and costs[-1] >= GUESS_LOG10:
                spans.append((m.start(kind), "guess", m.start(kind) + len(value)))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return spans, costs


#: What words of prose lack: anything but letters, dashes and apostrophes.
OTHER = re.compile(r"[^\W\d_].*[\d_]|[\d_].*[^\W\d_]|[^\w\-'’.]")


def scan(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, spans (start, kind, end of each), guesses of the values in credential places; null texts are empty.

    Every row is scanned by itself: repeated rows and ties give equal results, and no other column is read. Very long texts are scanned
    whole; a batch's texts become Python strings a few megabytes at a time. An empty table gives no rows. vocabulary: a tokenizer's file
    that all workers can read, whose words a guesser knows.
    """

    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts_of(whole, "text"):
                found = [find(t, vocabulary) for t in column(b, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([[dict(zip(("start", "kind", "end"), s)) for s in f[0]] for f in found], kind), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                    names=["doc_id", "spans", "guesses"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long>>, guesses array<double>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"), count("guess"), F.array_max("guesses").alias("most_guesses"))
