"""NAME_FIELDS of strips of pairs, in numpy: what name_features says in expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common_values import Values

#: Pairs of strings that are compared at a time; different strings of which all pairs are compared once.
PAIRS, ALL = 20_000, 700
TEXTS = ("fullname_joined", "name_first", "name_middle", "name_last", "name_suffix", "fullname", "affiliation", "iFfL", "metaphone_fullname")
NUMBERS = ("lastname_idf", "iFfL_idf")
WHOLE = ("exact", "mid", "first", "last", "has_affil", "suffix", "firstmidswap", "metaphone", "subsetprefix", "offbylastone")


def jaro(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """strings.jaro of pairs of different strings that aren't blank: a and b are matrices of characters, a row for each place, la and lb their lengths."""
    reach, n = np.maximum(np.maximum(la, lb) // 2 - 1, 0), len(la)
    free, found = np.arange(len(b))[:, None] < lb, np.zeros(a.shape, bool)
    most = int(reach.max(initial=0))
    for i in range(len(a)):
        todo = i < la
        for j in range(max(0, i - most), min(len(b), i + most + 1)):
            hit = todo & free[j] & (a[i] == b[j])
            if abs(i - j):
                hit &= abs(i - j) <= reach
            free[j] ^= hit
            todo ^= hit
            found[i] |= hit
    m = found.sum(0)
    sides = []
    for s, used in ((a, found), (b, (np.arange(len(b))[:, None] < lb) & ~free)):
        in_order = np.zeros((int(m.max(initial=0)), n), s.dtype)
        place, pair = np.nonzero(used)
        in_order[(np.cumsum(used, 0) - 1)[place, pair], pair] = s[place, pair]
        sides.append(in_order)
    swapped = (sides[0] != sides[1]).sum(0) // 2
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / la + m / lb + (m - swapped) / some) / 3, 0.0)


class Strings:
    """A string of each record, with its code among different ones."""

    def __init__(self, texts: list[str]):
        found, self.code = np.unique(np.array(texts, object), return_inverse=True)
        self.size = np.array([len(s) for s in found], "int64")
        width = max(int(self.size.max(initial=0)), 1)
        self.chars = np.zeros((width, len(found)), "uint32")
        for k, s in enumerate(found):
            self.chars[: len(s), k] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "uint32")
        self.length, self.colon = self.size[self.code], np.array([":" in s for s in found], bool)[self.code]
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.code[x] == self.code[y]

    def start(self, p: np.ndarray, q: np.ndarray, most: int | None = None) -> np.ndarray:
        """How many characters two codes' strings have in common at the beginning, up to `most`."""
        least, out, going = np.minimum(self.size[p], self.size[q]), np.zeros(len(p), "int64"), np.ones(len(p), bool)
        for k in range(min(most or len(self.chars), int(least.max(initial=0)))):
            going &= (k < least) & (self.chars[k, p] == self.chars[k, q])
            out += going
        return out

    def _compared(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.where(self.size[p] > 0, (p == q).astype(float), 0.0)
        some = np.flatnonzero((p != q) & (self.size[p] > 0) & (self.size[q] > 0))
        for at in range(0, len(some), PAIRS):
            k = some[at : at + PAIRS]
            la, lb = self.size[p[k]], self.size[q[k]]
            out[k] = jaro(self.chars[: la.max(), p[k]], la, self.chars[: lb.max(), q[k]], lb)
        return out, np.where(out > 0.7, out + 0.1 * self.start(p, q, 4) * (1 - out), out)

    def alike(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaro and Jaro-Winkler."""
        p, q, n = self.code[x], self.code[y], len(self.size)
        if n > ALL:
            return self._compared(p, q)
        if self.all is None:
            self.all = self._compared(*(k.ravel() for k in np.indices((n, n))))
        return self.all[0][p * n + q], self.all[1][p * n + q]


def _vectors(rows: pa.Table, name: str, n: int) -> Values:
    lists = rows[f"v_{name}"].combine_chunks()
    many = np.array([len(v) if v.is_valid else 0 for v in lists], "int64")
    flat = lists.flatten()
    term, weight = (flat.field(k) for k in ("term", "weight"))
    return Values(np.repeat(np.arange(n), many), term.dictionary_encode().indices.to_numpy().astype("int64"), weight.to_numpy(zero_copy_only=False), n)


class Names:
    """Records (TEXTS, NUMBERS and vectors v_affil and v_names, arrays of term and weight) by place."""

    def __init__(self, rows: pa.Table):
        texts = {c: [s or "" for s in rows[f"r_{c}"].to_pylist()] for c in TEXTS}
        self.s = {c: Strings(v) for c, v in texts.items()}
        first, middle, last = (texts[f"name_{c}"] for c in ("first", "middle", "last"))
        self.s["firstmid"], self.s["midlast"] = (Strings([p + q for p, q in zip(*x)]) for x in ((first, middle), (middle, last)))
        both = np.unique(np.array(first + middle, object), return_inverse=True)[1]
        self.first, self.middle = both[: len(first)], both[len(first) :]
        self.initial = {c: np.unique(np.array([s[:1] for s in texts[f"name_{c}"]], object), return_inverse=True)[1] for c in ("first", "middle", "last")}
        self.idf = {c: rows[f"r_{c}"].to_numpy() for c in NUMBERS}
        self.vectors = {c: _vectors(rows, c, len(rows)) for c in ("affil", "names")}

    def _code(self, c: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = self.s[f"name_{c}"]
        a, b, same = s.length[x], s.length[y], s.equal(x, y)
        cases = [((a == 0) & (b == 0), 3), ((a == 0) | (b == 0), 2), (same & (a > 1), 5), (same, 4), ((a > 1) & (b > 1), 0), (self.initial[c][x] == self.initial[c][y], 4)]
        return np.select([k for k, _ in cases], [v for _, v in cases], 1)

    def _shared(self, c: str, low: int, high: int, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        v = self.vectors[c]
        common = v.sums(low, high, ("left",))["left"].ravel()[cells]
        left = np.maximum(np.minimum(v.total[x], v.total[y]) - common, 0.0)
        return np.where((v.k[x] > 0) & (v.k[y] > 0), common - np.log10(1.0 + left), 0.0)

    def values(self, low: int, high: int, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        s = self.s
        equal = lambda c: s[c].equal(x, y) & (s[c].length[x] > 0)
        full = s["fullname"]
        out = {"exact": equal("fullname_joined"), "suffix": equal("name_suffix"), "metaphone": equal("metaphone_fullname")}
        out |= {n: self._code(c, x, y) for n, c in (("mid", "middle"), ("first", "first"), ("last", "last"))}
        out["lastidf"] = np.where(equal("name_last"), self.idf["lastname_idf"][x], 0.0)
        out["iFfLidf"] = np.where(s["iFfL"].equal(x, y), self.idf["iFfL_idf"][x], 0.0)
        placed = (s["affiliation"].length > 0).astype(int)
        out["has_affil"] = placed[x] + placed[y]
        out["fullname_sharedidf"] = self._shared("names", low, high, cells, x, y)
        out["affil_sharedidf"] = np.where(out["has_affil"] == 2, self._shared("affil", low, high, cells, x, y), np.nan)
        real = ~full.colon[x] & ~full.colon[y]
        out["jaro_distance"], out["jaro_winkler"] = (np.where(real, v, 0.0) for v in full.alike(x, y))
        for n, c in (("first", "name_first"), ("mid", "name_middle"), ("last", "name_last"), ("firstmid", "firstmid"), ("midlast", "midlast")):
            out[f"jarow_{n}"] = s[c].alike(x, y)[1]
        blank = s["name_middle"].length == 0
        hit = s["name_last"].equal(x, y) & (((self.first[x] == self.middle[y]) & blank[x]) | ((self.first[y] == self.middle[x]) & blank[y]))
        out["firstmidswap"] = np.where(hit, np.where(s["name_first"].length[x] > 1, 2, 1), 0)
        a, b = full.length[x], full.length[y]
        least, gap = np.minimum(a, b), np.abs(a - b)
        prefix = full.start(full.code[x], full.code[y]) == least
        out["subsetprefix"], out["offbylastone"] = np.where(prefix, least, 0), np.where(prefix & (gap <= 2), 3 - gap, 0)
        return {c: v.astype("int32") if c in WHOLE else v for c, v in out.items()}
