"""Mixing: token weights raked to source, language and topic marginals, and a sample by calibrated probabilities.

Native: counting, raking, calibrating and sampling are DataFrame expressions. Documents are summed up to cells, the combinations of
their three dimensions that occur. Iterative proportional fitting runs over the table of cells, one dimension after the other, until
each value's weighted tokens have its target share. The probability of a cell is its weight times a common factor, 1 at most;
where that cuts off, the other cells are raked again, so that the sample meets the targets as well as whole documents can. Cells are
joined back to documents; what the targets can't be met by is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

DIMENSIONS = ("source", "lang", "topic")
#: Rounds at most, rounds of a job, and the error of a share that ends them. Up to so many cells are one task's.
ROUNDS, STEP, CLOSE, ONE_TASK = 60, 4, 1e-4, 200_000
#: Without targets, a value's share goes as its tokens to this power; the sample has this part of all tokens.
POWER, KEEP = 0.7, 0.5
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's layout, for tables that have none of their own."""
    marks = F.regexp_replace(text, r"[\x20a-z\x80-\x{10FFFF}]+", "")
    n = F.greatest(F.length(text), F.lit(1))
    part = lambda chars: (F.length(marks) - F.length(F.translate(marks, chars, ""))) / n
    return (
        F.when(part("|") > 0.02, "table")
        .when(part("#*$%&<>") > 0.03, "symbols")
        .when(part("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "capitals")
        .when(part("0123456789") > 0.05, "numbers")
        .when(part("\n") > 0.02, "lines")
        .otherwise("prose")
    )


def dimensions(topic: str | None = None) -> list[Column]:
    """A document's source, lang and topic (null: a value of its own) and n_tokens (words; null text has none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.col(topic).cast("string") if topic else topic_of(text)
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(d) for d, c in zip(DIMENSIONS, (F.col("source"), F.col("lang"), own))]
    return [*named, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens")]


@dataclass
class Plan:
    """cells: source, lang, topic, n (tokens), weight, prob. off: per dimension the largest error of a share that weights leave."""

    cells: DataFrame
    total: float
    off: dict[str, float]
    wanted: dict[str, DataFrame]

    def report(self) -> DataFrame:
        """Of each value of each dimension its share of the tokens, its target, and its shares by weight and in the expected sample."""
        kept = self.cells.agg(F.sum(F.col("n") * F.col("prob"))).first()[0] or 1.0
        out = None
        for d in DIMENSIONS:
            have = self.cells.groupBy(F.col(d).alias("value")).agg(
                (F.sum("n") / self.total).alias("share"), (F.sum(F.col("n") * F.col("weight")) / self.total).alias("weighted"), (F.sum(F.col("n") * F.col("prob")) / kept).alias("sampled")
            )
            want = self.wanted[d].select(F.col("v").alias("value"), F.col("t").alias("target"))
            one = have.join(want, "value", "full").select(F.lit(d).alias("dimension"), "value", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("share", "target", "weighted", "sampled")])
            out = one if out is None else out.union(one)
        return out


def _targets(cells: DataFrame, d: str, given: dict[str, float] | None, power: float) -> DataFrame:
    """(v, t): the target share of each value. Given shares are scaled to add up to 1; values without one have 0."""
    spark = cells.sparkSession
    if given:
        whole = sum(given.values())
        pairs = F.array(*[F.struct(F.lit(k).alias("v"), F.lit(float(x) / whole).alias("t")) for k, x in sorted(given.items())])
        return spark.range(1).select(F.explode(pairs).alias("x")).select("x.*")
    t = cells.groupBy(F.col(d).alias("v")).agg(F.pow(F.sum("n"), F.lit(power)).alias("t"))
    return t.join(t.agg(F.sum("t").alias("whole")).hint("broadcast"), F.col("whole").isNotNull()).select("v", (F.col("t") / F.col("whole")).alias("t"))


def _rake(cells: DataFrame, size: int, column: str, weight: Column, aim: float, tables: shared.Tables, close: float) -> tuple[DataFrame, dict[str, float]]:
    """cells with `column` raked until `weight` (of it) times n has the wanted shares of `aim`; and the errors that are left.

    A round is three sums over windows; several rounds are one job. Cells in one partition need no exchange.
    """
    off = dict.fromkeys(DIMENSIONS, 0.0)
    for _ in range(0, ROUNDS, STEP):
        now = cells
        for k in range(STEP):
            last = k == STEP - 1
            for d in DIMENSIONS:
                now = now.withColumn("have", F.sum(F.col("n") * weight).over(Window.partitionBy(d)))
                if last:
                    now = now.withColumn(f"off_{d}", F.abs(F.col("have") / aim - F.col(f"t_{d}")))
                by = F.when(F.col("have") > 0, F.least(F.col(f"t_{d}") * aim / F.col("have"), F.lit(1e6))).otherwise(F.lit(0.0))
                now = now.withColumn(column, F.least(F.col(column) * by, F.lit(1e30))).drop("have")
        now = tables.save(now, size)
        left = now.agg(*[F.max(f"off_{d}").alias(d) for d in DIMENSIONS]).first().asDict()
        cells = _together(now.select(*cells.columns), size)
        gain = max(abs(off[d] - (left[d] or 0.0)) for d in DIMENSIONS)
        off = {d: left[d] or 0.0 for d in DIMENSIONS}
        if max(off.values()) < close or gain < close / 10:  # met, or the targets contradict one another
            break
    return cells, off


def _together(cells: DataFrame, size: int) -> DataFrame:
    """Few cells in one partition; many stay as they are."""
    return cells.coalesce(1) if size <= ONE_TASK else cells


def plan(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, keep: float = KEEP, tables: shared.Tables | None = None) -> Plan:
    """Weights and probabilities of the cells of rows (the columns of dimensions()).

    targets: wanted shares of tokens by dimension and value, e.g. {"lang": {"en": 0.6, "de": 0.4}}; of a dimension that isn't given, a
    value's share goes as its tokens to the power. Values that the rows lack can't be met and count in Plan.off.
    """
    tables = tables or shared.Tables(rows.sparkSession)
    cells = tables.save(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("n")).where("n > 0"))
    size = cells.count()
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    wanted = {d: tables.save(_targets(cells, d, (targets or {}).get(d), power), size) for d in DIMENSIONS}
    if not total:
        return Plan(tables.save(cells.select(*DIMENSIONS, "n", F.lit(0.0).alias("weight"), F.lit(0.0).alias("prob"))), 1.0, dict.fromkeys(DIMENSIONS, 0.0), wanted)
    known = cells
    for d, want in wanted.items():
        known = known.join(want.select(F.col("v").alias("v"), F.col("t").alias(f"t_{d}")), F.col(d) == F.col("v"), "left").drop("v").fillna(0.0, [f"t_{d}"])
    cells = _together(tables.save(known.withColumn("weight", F.lit(1.0)), size), size)
    cells, off = _rake(cells, size, "weight", F.col("weight"), total, tables, CLOSE)
    for d, want in wanted.items():  # values that no row has
        lacks = want.join(cells.select(F.col(d).alias("_v")).distinct(), F.col("v") == F.col("_v"), "left_anti").agg(F.max("t")).first()[0]
        off[d] = max(off[d], lacks or 0.0)
    # the factor that keeps the wanted part: solved for the cells that it doesn't cut off, until these are the same
    c, cut = keep, -1.0
    while True:
        r = cells.agg(F.sum(F.when(F.col("weight") * c >= 1, F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(F.col("weight") * c < 1, F.col("n") * F.col("weight")).otherwise(0.0)).alias("rest")).first()
        if r["full"] <= cut or r["rest"] <= 0:
            break
        c, cut = max(c, (keep * total - r["full"]) / r["rest"]), r["full"]
    cells = cells.withColumn("odds", F.col("weight") * c)
    if cut > 0:  # some documents are kept for sure: the others make up for what these lack
        cells, _ = _rake(cells, size, "odds", F.least(F.col("odds"), F.lit(1.0)), keep * total, tables, 1e-3)
    return Plan(tables.save(cells.select(*DIMENSIONS, "n", "weight", F.least("odds", F.lit(1.0)).alias("prob"))), total, off, wanted)


def uniform(seed: int = 17) -> Column:
    """A number in [0, 1) from doc_id: a row is drawn alike however the table is dealt out, and rows with equal ids alike."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _joined(rows: DataFrame, p: Plan) -> DataFrame:
    """rows (the columns of dimensions() and others) with weight and prob of their cells; 0 without tokens."""
    cells = p.cells.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], F.col("weight").alias("c_weight"), F.col("prob").alias("c_prob"))
    on = [F.col(d) == F.col(f"c_{d}") for d in DIMENSIONS]
    has = F.col("n_tokens") > 0
    value = lambda c: F.when(has, F.coalesce(f"c_{c}", F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
    return rows.join(cells, on, "left").select(*rows.columns, value("weight"), value("prob"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, keep: float = KEEP, topic: str | None = None) -> DataFrame:
    """Per row doc_id, source, lang, topic, n_tokens, weight, prob and kept.

    Texts without words have no tokens to weigh: weight 0 and never kept. Null dimensions are values of their own; an empty table
    gives no rows; repeated rows count each and are drawn alike; very long texts count with all their words. topic: the column that
    has it, else it comes from the text's layout. Other columns aren't read.
    """
    tables = shared.Tables(docs.sparkSession)
    slim = tables.save(docs.select("doc_id", *dimensions(topic)))
    p = plan(slim, targets, power, keep, tables)
    tables.keep(slim, p.cells)
    return _joined(slim, p).withColumn("kept", uniform() < F.col("prob"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, keep: float = KEEP, topic: str | None = None) -> DataFrame:
    """The sampled rows of docs as they are, whatever the names of their columns."""
    tables = shared.Tables(docs.sparkSession)
    p = plan(docs.select(*dimensions(topic)), targets, power, keep, tables)
    tables.keep(p.cells)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *dimensions(topic))
    return _joined(rows, p).where(uniform() < F.col("prob")).select("row.*")
