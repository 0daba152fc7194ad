"""Quality rules: base statistics as Spark expressions, and a decision list learned by sequential covering.

Native: every statistic is a DataFrame expression; the learner sees at most `max_rows` labelled rows of numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Labelled rows that the learner may read; chosen by a hash of doc_id.
MAX_ROWS = 4000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also if body uses it many times or in a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes are of all windows, in order."""
    n = F.size(hashes)
    at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def repeated(s):
        m = F.size(s)
        same = F.filter(
            F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < m - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])),
            lambda x: x.isNotNull(),
        )
        return F.aggregate(
            F.sort_array(same),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n")),
        )["n"]

    return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("long")).otherwise(let(F.sort_array(at), repeated))


def repeat_words(words: Column) -> Column:
    """How many words stand in a window of 8 words that the text has twice or more."""

    def pair(step):
        return lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 1 - step), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + step)))

    def windows(w):  # of 2, 4 and then 8 words
        return let(pair(1)(w), lambda two: let(pair(2)(two), lambda four: let(pair(4)(four), _covered)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(windows(words))


FEATURES = ("n_words", "word_len", "symbols", "bangs", "bars", "upper", "digits", "dup_lines", "repeats")


def statistics(column: Column) -> Column:
    """A struct of the base counts and the learner's ratios of a whole text; null is empty."""
    text = F.coalesce(column, F.lit(""))
    few = F.regexp_replace(text, r"[\x20a-z\x80-\x{10FFFF}]+", "")  # what is counted below stays

    def with_words(ws):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("chars"),
            repeat_words(ws).alias("n_repeat_words"),
        )

    def with_lines(ls):
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def final(w, x, l):
        chars, words = w["chars"], w["n_words"]
        ratio = lambda a, b: a.cast("double") / F.greatest(b, F.lit(1)).cast("double")
        return F.struct(
            words.alias("words"),
            chars.alias("word_chars"),
            x["symbols"].alias("n_symbols"),
            l["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            words.cast("double").alias("n_words"),
            ratio(chars, words).alias("word_len"),
            ratio(x["symbols"], chars).alias("symbols"),
            ratio(x["bangs"], chars).alias("bangs"),
            ratio(x["bars"], chars).alias("bars"),
            ratio(x["upper"], chars).alias("upper"),
            ratio(x["digits"], chars).alias("digits"),
            ratio(l["n_dup_lines"], l["n_lines"]).alias("dup_lines"),
            ratio(w["n_repeat_words"], words).alias("repeats"),
        )

    def with_few(t):
        return F.struct(
            count_chars(t, "#*$%&|<>").cast("long").alias("symbols"),
            count_chars(t, "!").alias("bangs"),
            count_chars(t, "|").alias("bars"),
            count_chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
            count_chars(t, "0123456789").alias("digits"),
        )

    parts = F.struct(let(words_of(text), with_words).alias("w"), let(few, with_few).alias("x"), let(lines, with_lines).alias("l"))
    return let(parts, lambda v: final(v["w"], v["x"], v["l"]))


@dataclass
class Rule:
    """Rows that meet all conditions (feature, '<=' or '>', threshold) are rejected."""

    conditions: list[tuple[str, str, float]]
    hits: int = 0
    wrong: int = 0

    def column(self, value) -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            out = out & ((value(name) <= F.lit(t)) if op == "<=" else (value(name) > F.lit(t)))
        return out

    def holds(self, row: dict) -> bool:
        return all(row[n] <= t if op == "<=" else row[n] > t for n, op, t in self.conditions)


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, and no rule means keep."""

    rules: list[Rule] = field(default_factory=list)

    def column(self, value) -> Column:
        """The number of the first rule that holds, from 1, or null."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(value), F.lit(k)).otherwise(out)
        return out

    def first(self, row: dict) -> int | None:
        return next((k for k, r in enumerate(self.rules, 1) if r.holds(row)), None)


def _best(values: np.ndarray, bad: np.ndarray) -> tuple[float, str, float] | None:
    """(gain, operator, threshold) of the best condition on one statistic; thresholds are the middles of all neighbouring values."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], bad[order]
    ends = np.flatnonzero(v[1:] > v[:-1])
    if not len(ends):
        return None
    p0, n0 = int(y.sum()), int(len(y) - y.sum())
    p, n = np.cumsum(y)[ends].astype(float), np.cumsum(1 - y)[ends].astype(float)
    found = None
    for op, p, n in (("<=", p, n), (">", p0 - p, n0 - n)):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -np.inf)
        k = int(np.argmax(gain))
        if found is None or gain[k] > found[0] + 1e-12:
            found = (float(gain[k]), op, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return found


def _grow(bad: list[dict], good: list[dict], names) -> Rule:
    """Adds the condition of largest information gain until the rule covers no good row."""
    conditions: list[tuple[str, str, float]] = []
    while bad and good and len(conditions) < 4:
        y = np.array([1] * len(bad) + [0] * len(good))
        best, gain = None, 1e-9
        for name in names:
            found = _best(np.array([r[name] for r in bad + good], float), y)
            if found and found[0] > gain:
                best, gain = (name, *found[1:]), found[0]
        if best is None:
            break
        conditions.append(best)
        one = Rule([best])
        bad, good = [r for r in bad if one.holds(r)], [r for r in good if one.holds(r)]
    return Rule(conditions)


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """Drops last conditions while the rule does better on rows that it wasn't grown on."""

    def worth(r):
        p, n = sum(map(r.holds, bad)), sum(map(r.holds, good))
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        short = Rule(rule.conditions[:k])
        if worth(short) >= worth(best):
            best = short
    return best


def learn(rows: list[tuple[dict, int]], names=FEATURES, precision: float = 0.95, support: float = 0.01) -> DecisionList:
    """Sequential covering over (statistics, quality) rows; quality 0 is to be rejected.

    Every third row prunes, the others grow. A rule stays if it covers at least `support` of the rejected rows (3 at
    least) and at least `precision` of what it covers is rejected. No rows, or one class only: an empty list.
    """
    out = DecisionList()
    bad, good = [r for r, y in rows if y == 0], [r for r, y in rows if y == 1]
    least = max(3, math.ceil(support * len(bad)))
    while len(bad) >= least and good and len(out.rules) < 12:
        grow = lambda x: [r for i, r in enumerate(x) if i % 3]
        check = lambda x: [r for i, r in enumerate(x) if i % 3 == 0]
        rule = _prune(_grow(grow(bad), grow(good), names), check(bad), check(good))
        rule.hits, rule.wrong = sum(map(rule.holds, bad)), sum(map(rule.holds, good))
        if not rule.conditions or rule.hits < least or rule.hits < precision * (rule.hits + rule.wrong):
            break
        out.rules.append(rule)
        bad, good = [r for r in bad if not rule.holds(r)], [r for r in good if not rule.holds(r)]
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DecisionList:
    """The decision list from at most max_rows labelled documents, chosen by a hash of doc_id.

    Null labels don't count, nor do documents that fail the base anyway. Empty tables give an empty list. A doc_id with several
    rows counts with one of them, the first by a hash of its text; one with several labels counts with the least.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = texts.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("_id", "_y", F.col("first.text").alias("text"))
    # what fails the base is left out below: as a filter here, Spark would compute the statistics of all documents, ahead of the join
    rows = one.select("_id", "_y", statistics(F.col("text")).alias("_stats")).select("_id", "_y", "_stats.*").collect()
    found = sorted((r.asDict() for r in rows if not (r["words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["words"])), key=lambda r: (r["_id"], r["_y"]))
    return learn([(r, r["_y"]) for r in found])


def base_failed(value) -> Column:
    return (value("words") < 20) | (100 * value("n_repeat_words") > 30 * value("words"))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """`row`, a struct of a row of docs as it is, and `q`: the base counts, base_failed, rule (the first that rejects, or null), kept.

    Null and empty texts have no words, so they fail the base; ties and repeated rows are judged one by one, very long texts as a
    whole; an empty table gives no rows. Other columns, whatever their names, are only passed on.
    """
    s = docs.select(F.struct("*").alias("row"), statistics(F.col("text")).alias("stats"))
    value = lambda n: F.col("stats")[n]
    failed = base_failed(value)
    rule = rules.column(value)
    counts = [value("words").alias("n_words"), *[value(n).alias(n) for n in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    return s.select("row", F.struct(*counts, failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept")).alias("q"))


def kept(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that pass, as they are."""
    return judge(docs, rules).where("q.kept").select("row.*")
