"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The punctuation that names lose. The deleting forms also take the backslash.
PUNCTUATION = ".;,'~:_@?|/\"+)}{(&$*%=>^-"
DELETED = PUNCTUATION + "\\"
# Token patterns of texts and of names.
TEXT_TOKEN = r"\b[0-9]*[a-zA-Z]+[a-zA-Z0-9]+\b"
NAME_TOKEN = r"\b[a-zA-Z][a-zA-Z]+\b"


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def punctuation_to_space(s: Column) -> Column:
    """Punctuation becomes a space; runs of white space collapse, the ends are trimmed."""
    spaced = F.translate(s, PUNCTUATION, " " * len(PUNCTUATION))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def without_punctuation(s: Column, keep_spaces: bool = False) -> Column:
    """Punctuation, and unless kept spaces, deleted."""
    return F.translate(s, DELETED + ("" if keep_spaces else " "), "")


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, r"<[^<]+?>", " ")


def normal_name(s: Column) -> Column:
    """Lower case, trimmed of spaces, without semicolons."""
    return F.lower(F.trim(F.replace(s, F.lit(";"), F.lit(""))))


def number(s: Column) -> Column:
    """A number from text: blank is 0, anything else that isn't a number is an error."""
    return F.when(F.trim(s) == "", F.lit(0.0)).otherwise(s.cast("double"))


def tokens(s: Column, pattern: str = TEXT_TOKEN) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def word_ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of low to high words, joined by spaces."""

    def runs(w, n):
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    def of(w):
        return F.concat(*[runs(w, n) for n in range(low, high + 1)])

    return let(words, of)


def char_ngrams(s: Column, n: int) -> Column:
    """All substrings of n characters."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n))).otherwise(F.array().cast("array<string>"))


def drop_last(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - 1)


def inverse_frequency(total: Column, count: Column) -> Column:
    return F.log(total / count)


def penalty(x: Column) -> Column:
    return F.log10(F.lit(1.0) + x)


def _lost(a: Column, b: Column) -> Column:
    """What the rounded product of two doubles lacks, exactly: both are split into halves whose products are exact."""
    half = lambda x: x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    ah, bh = half(a), half(b)
    al, bl = a - ah, b - bh
    return ((ah * bh - a * b) + ah * bl + al * bh) + al * bl


def six_digits(x: Column) -> Column:
    """x rounded to six significant digits as %g prints it: half to even, where the number is just half."""

    def rounded(v):
        size, power, y, off = v["size"], v["power"], v["y"], v["off"]
        whole = F.floor(y)
        up = F.when(y - whole != 0.5, y - whole > 0.5).when(off != 0, off > 0).otherwise(F.pmod(whole, F.lit(2)) == 1)
        digits = (whole + up.cast("long")).cast("double")
        return F.signum(v["x"]) * F.when(power >= 0, digits / size).otherwise(digits * size)

    def scaled(v):
        a, size, power = F.abs(v["x"]), v["size"], v["power"]
        y = F.when(power >= 0, a * size).otherwise(a / size)
        off = F.when(power >= 0, _lost(a, size)).otherwise((a - a / size * size) - _lost(a / size, size))
        return F.struct(v["x"].alias("x"), size.alias("size"), power.alias("power"), y.alias("y"), off.alias("off"))

    power = F.lit(5) - F.floor(F.log10(F.abs(x)))
    first = F.struct(x.alias("x"), F.pow(F.lit(10.0), F.abs(power)).alias("size"), power.alias("power"))
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).otherwise(let(first, lambda v: let(scaled(v), rounded)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def name_keys(first: Column, last: Column, id_: Column) -> dict[str, Column]:
    """The blocking keys of a parsed name: initial + last, first + last, first + initial of last. Without parts: marked keys with a colon."""
    has_first, has_last = first != "", last != ""
    initial_last = (
        F.when(has_last & has_first, F.concat(F.substring(first, 1, 1), last))
        .when(has_last, F.concat(F.lit("L:"), last))
        .when(has_first, F.concat(F.lit("F:"), first))
        .otherwise(F.concat(F.lit("ID:"), id_.cast("string")))
    )
    both = has_first & has_last
    return {
        "iFfL": initial_last,
        "fFfL": F.when(both, F.concat(first, last)).otherwise(initial_last),
        "fFiL": F.when(both, F.concat(first, F.substring(last, 1, 1))).otherwise(initial_last),
    }


def or_id(s: Column, id_: Column) -> Column:
    """s, or `ID:<id>` if it is blank."""
    return F.when(s == "", F.concat(F.lit("ID:"), id_.cast("string"))).otherwise(s)
