"""Sums over the values that two records of a block have in common, for strips of pairs, in numpy."""

from __future__ import annotations

import numpy as np

#: Pairs of entries that are laid out at a time; columns of a dense part; values that a share of 1 / OFTEN of the records have are dense.
ENTRIES, COLUMNS, OFTEN = 400_000, 512, 8
#: What is summed over common values: 1, the lesser count, the lesser share, both shares, the left record's count.
KINDS = ("n", "min", "min_share", "shares", "left")


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def counted(who: np.ndarray, value: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (who, code) with their counts added up, and the values by code."""
    values, code = np.unique(value, return_inverse=True)
    key, at = np.unique(who.astype("int64") * max(len(values), 1) + code, return_inverse=True)
    who, code = np.divmod(key, max(len(values), 1))
    return who, code, np.bincount(at, cnt, len(key)), values


class Values:
    """Values of one field: entries (who, code, cnt) that differ in the first two, `who` being places of n records."""

    def __init__(self, who: np.ndarray, code: np.ndarray, cnt: np.ndarray, n: int):
        self.n, self.k, self.total = n, np.bincount(who, minlength=n), np.bincount(who, cnt, minlength=n)
        self.top, self.whole = cnt.max(initial=0), not (cnt % 1).any()
        size = np.bincount(code)[code]
        keep = np.flatnonzero(size > 1)  # the others meet nothing
        order = keep[np.lexsort((who[keep], code[keep]))]
        self.who, self.cnt, size, code = who[order].astype("int32"), cnt[order].astype(float), size[order], code[order]
        start = np.flatnonzero(np.diff(code, prepend=-1))
        self.end = np.repeat(start + size[start], size[start]).astype("int32") if len(start) else np.zeros(0, "int32")
        often = size * OFTEN > n
        self.mine = np.flatnonzero(~often)
        self.mine = self.mine[np.argsort(self.who[self.mine], kind="stable")].astype("int32")
        self.first = np.searchsorted(self.who[self.mine], np.arange(n + 1))
        self.dense = np.flatnonzero(often)
        self.column = np.unique(code[self.dense], return_inverse=True)[1]  # ascending, as entries are
        self.share = self.cnt / self.total[self.who]
        self.last = None

    def sums(self, low: int, high: int, kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
        """[x - low, y]: the sums over common values for x from low to high and all y > x."""
        if self.last and self.last[0] == (low, high, kinds):
            return self.last[1]
        m, n = high - low, self.n
        out = {k: np.zeros(m * n) for k in kinds}
        own = self.mine[self.first[low] : self.first[high]].astype("int64")
        size = self.end[own] - own - 1  # entries of one value are in order of who
        own, size = own[size > 0], size[size > 0]
        upto = np.cumsum(size)
        for part in np.split(np.arange(len(own)), np.searchsorted(upto, np.arange(ENTRIES, upto[-1], ENTRIES))) if len(own) else ():
            if not len(part):
                continue
            x, many = own[part], size[part]
            y = ranges(x + 1, many)
            cell = np.repeat((self.who[x].astype("int64") - low) * n, many) + self.who[y]
            left = lambda a: np.repeat(a[x], many)
            for k in kinds:
                if k == "n":
                    w = None
                elif k == "min":
                    w = np.minimum(left(self.cnt), self.cnt[y])
                elif k == "min_share":
                    w = np.minimum(left(self.share), self.share[y])
                else:
                    w = left(self.share) + self.share[y] if k == "shares" else left(self.cnt)
                out[k] += np.bincount(cell, w, m * n)
        out = {k: v.reshape(m, n) for k, v in out.items()}
        for at in range(0, self.column.max(initial=-1) + 1, COLUMNS):
            lo, hi = np.searchsorted(self.column, [at, at + COLUMNS])
            self._dense(self.dense[lo:hi], self.column[lo:hi] - at, low, high, out)
        self.last = ((low, high, kinds), out)
        return out

    def _dense(self, entries: np.ndarray, column: np.ndarray, low: int, high: int, out: dict[str, np.ndarray]) -> None:
        def table(of: np.ndarray) -> np.ndarray:
            t = np.zeros((self.n - low, column.max() + 1))
            some = self.who[entries] >= low
            t[self.who[entries[some]] - low, column[some]] = of[entries[some]]
            return t

        m, cnt = high - low, table(self.cnt)
        have = (cnt > 0).astype("float32")
        share = table(self.share) if {"min_share", "shares"} & set(out) else None
        for k, v in out.items():
            to = v[:, low:]
            if k == "n":
                to += have[:m] @ have.T
            elif k == "left":
                to += cnt[:m] @ have.T.astype(float)
            elif k == "shares":
                wide = have.astype(float)
                to += share[:m] @ wide.T + wide[:m] @ share.T
            elif k == "min" and self.whole and self.top <= 64:
                for level in range(1, int(self.top) + 1):
                    some = (cnt >= level).astype("float32")
                    to += some[:m] @ some.T
            else:
                of = cnt if k == "min" else share
                for c in range(of.shape[1]):
                    to += np.minimum(of[:m, c, None], of[None, :, c])


def spans(who: np.ndarray, number: np.ndarray, cnt: np.ndarray, n: int, share: float) -> np.ndarray:
    """Percentiles of numeric values by record, each as often as it is counted; NaN without values."""
    order = np.lexsort((number, who))
    number, upto, total = number[order], np.cumsum(cnt[order]), np.bincount(who, cnt, minlength=n)
    at = np.cumsum(total) - total + share * (total - 1)
    low, high = np.floor(at), np.ceil(at)
    if not len(number):
        return np.full(n, np.nan)
    x, y = (number[np.minimum(np.searchsorted(upto, k, "right"), len(number) - 1)] for k in (low, high))
    return np.where(total > 0, np.where(low == high, x, (high - at) * x + (at - low) * y), np.nan)


class Owned:
    """How large a part of a record's counts is a value that another one owns. own: a code of Values' entries by record, -1 for none."""

    def __init__(self, who: np.ndarray, code: np.ndarray, cnt: np.ndarray, own: np.ndarray, n: int):
        self.n, share = n, cnt / np.bincount(who, cnt, minlength=n)[who]
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], code), np.searchsorted(own[order], code, "right")
        self.has, self.owner = np.repeat(who, hi - lo), order[ranges(lo, hi - lo)]  # (record, owner of one of its values)
        self.share = np.repeat(share, hi - lo)

    def sums(self, low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, self.n))
        for x, y in ((self.has, self.owner), (self.owner, self.has)):
            some = np.flatnonzero((x >= low) & (x < high))
            np.add.at(out, (x[some] - low, y[some]), self.share[some])
        return out
