"""Readers and writers of the file forms that the stages exchange; all are plain DataFrame sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import schemas


def read_edges(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    """(a, b[, prob]) rows without header."""
    return spark.read.schema(schemas.WEIGHTED_EDGE if weighted else schemas.EDGE).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, header: bool = True, comment: str | None = None) -> DataFrame:
    """CSV with quoted commas and doubled quotes; comment: lines that begin so are skipped, as blank ones are."""
    options = {"header": header, "quote": '"', "escape": '"'} | ({"comment": comment} if comment else {})
    return spark.read.schema(schema).options(**options).csv(path)


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.AUTHOR)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (value) without blank ones and those that begin with #, their ends trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and value not like '#%'")


def after_meta(line: Column) -> Column:
    """What follows the `meta;` of a line, or the whole line."""
    return F.when(F.contains(line, F.lit(";")), F.get(F.split(line, ";"), F.lit(1))).otherwise(line)


def read_clusters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, ids) of ragged `meta;id,id,...` lines; line_no follows the file's order and isn't dense."""
    numbered = read_lines(spark, path).withColumn("line_no", F.monotonically_increasing_id())
    return numbered.select("line_no", F.transform(F.split(after_meta(F.col("value")), ","), lambda x: F.trim(x).try_cast("long")).alias("ids"))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(cluster_id, author_id) of ragged clusters; a cluster's id is its line."""
    return clusters.select(F.col("line_no").alias("cluster_id"), F.explode("ids").alias("author_id"))


def read_titles(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(kind, id, title) of several title files: kind -> path. The pair (kind, id) tells rows of different files apart."""
    out = None
    for kind, path in files.items():
        one = read_csv(spark, path, schemas.PUBLICATION).select(F.lit(kind).alias("kind"), F.col("Id").alias("id"), F.col("Title").alias("title"))
        out = one if out is None else out.unionByName(one)
    return out


def publications_by_author(counts: DataFrame) -> DataFrame:
    """(author_id, kind, pub_id, cnt) from count relations of conferences and journals."""
    kind = F.when(F.col("field") == "conferences", "conference").when(F.col("field") == "journals", "journal")
    return counts.select("author_id", kind.alias("kind"), F.col("value").cast("long").alias("pub_id"), "cnt").where("kind is not null")


def paper_titles(papers: DataFrame) -> DataFrame:
    """(id, text): title and keywords of papers that have any, markup cut out."""
    from ..functions.text import strip_tags

    joined = F.concat_ws(" ", F.coalesce("Title", F.lit("")), F.coalesce("Keyword", F.lit("")))
    return papers.select(F.col("Id").alias("id"), strip_tags(joined).alias("text")).where(F.trim("text") != "")


def paper_ids_by_author(paper_author: DataFrame) -> DataFrame:
    return paper_author.select(F.col("AuthorId").alias("author_id"), F.col("PaperId").alias("paper_id")).distinct()


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(label, a, b) of hand-made pair files with # comments."""
    return read_csv(spark, path, schemas.LABELLED_PAIR, header=False, comment="#")


def read_cannot_link(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(a, b), a < b, of lines `a,b` and of lines `label,a,b` whose label is 0."""
    parts = F.split("value", ",")
    rows = read_lines(spark, path).select(F.transform(parts, lambda x: F.trim(x).try_cast("long")).alias("v"))
    rows = rows.select(F.when(F.size("v") == 2, F.col("v")).when(F.get("v", F.lit(0)) == 0, F.slice("v", 2, 2)).alias("v")).where("v is not null")
    return rows.select(F.least(F.col("v")[0], F.col("v")[1]).alias("a"), F.greatest(F.col("v")[0], F.col("v")[1]).alias("b")).distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(F.col("value").try_cast("long").alias("id"))


def read_words(spark: SparkSession, path: str | list[str]) -> list[str]:
    """A word list; these lists are hand-made and short."""
    return sorted({r["value"].lower() for r in read_lines(spark, path).collect()})


def read_name_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(name, freq) of files whose lines end in a carriage return only."""
    return spark.read.schema(schemas.NAME_FREQUENCY).option("lineSep", "\r").csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Pair features as parquet, or as tab-separated text whose first column is "a,b" and whose cells may be blank (0)."""
    from ..functions.text import number

    if not path.endswith((".tsv", ".feat")):
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    key = F.split("authors", ",")
    return raw.select(key[0].cast("long").alias("a"), key[1].cast("long").alias("b"), *[number(F.coalesce(c, F.lit(""))).alias(c) for c in raw.columns if c != "authors"])


def write_features(features: DataFrame, path: str, tsv: bool = False) -> None:
    """Parquet, or text whose numbers keep six significant digits; null is a blank cell."""
    if not tsv:
        features.write.mode("overwrite").parquet(path)
        return
    from ..functions.text import six_digits

    values = [six_digits(F.col(c).cast("double")).cast("string").alias(c) for c in features.columns if c not in ("a", "b")]
    features.select(F.concat_ws(",", "a", "b").alias("authors"), *values).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows with a header, quotes doubled; for records with name parts and keys too."""
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_edges(edges: DataFrame, path: str, gzip: bool = False, digits: bool = False) -> None:
    """Sorted (a, b[, prob]) rows without header; digits: prob keeps six significant ones."""
    from ..functions.text import six_digits

    options = {"compression": "gzip"} if gzip else {}
    if digits:
        edges = edges.withColumn("prob", six_digits(F.col("prob")))
    edges.orderBy("a", "b").write.mode("overwrite").options(**options).csv(path)


def write_ranked(scores: DataFrame, path: str) -> None:
    """(a, b, prob), most likely first, with six significant digits."""
    from ..functions.text import six_digits

    scores.withColumn("prob", six_digits(F.col("prob"))).orderBy(F.desc("prob"), "a", "b").write.mode("overwrite").csv(path)


def bin_lines(keys: DataFrame) -> DataFrame:
    """`label;id,id,...` of each block, large blocks first, then labels descending; ids ascend."""
    grouped = keys.groupBy("bin_key").agg(F.array_sort(F.collect_set("author_id")).alias("ids"))
    line = F.concat(F.col("bin_key"), F.lit(";"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    return grouped.orderBy(F.desc(F.size("ids")), F.desc("bin_key")).select(line.alias("value"))


def write_lines(lines: DataFrame, path: str, gzip: bool = False) -> None:
    lines.write.mode("overwrite").options(**({"compression": "gzip"} if gzip else {})).text(path)


def cluster_lines(members: DataFrame) -> DataFrame:
    """`id,id,...` of each cluster, large clusters first."""
    grouped = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list("author_id")).alias("ids"))
    return grouped.orderBy(F.desc(F.size("ids")), "cluster_id").select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("value"))


def register(spark: SparkSession, tables: dict[str, str | DataFrame]) -> None:
    """Temp views over parquet paths or DataFrames: the database connections of the engine."""
    for name, t in tables.items():
        (spark.read.parquet(t) if isinstance(t, str) else t).createOrReplaceTempView(name)


def select(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    """A query with bound parameters."""
    return spark.sql(sql, args=args)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose joins on key need no shuffle; stands for an indexed table."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place in that order, from 1, as column `name`. Partitions are sorted by range and numbered one by one; only
    how many rows each has meets in one place."""
    from pyspark.sql import Window

    from ..operators.graph import checkpointed

    out = checkpointed(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = out.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return out.withColumn("_row", place).join(F.broadcast(before), F.col("_part") == F.col("_p")).select(*rows.columns, (F.col("_before") + F.col("_row")).cast("long").alias(name))


def index_column(df: DataFrame, column: str, first_seen: str) -> DataFrame:
    """df with `column` replaced by dense ids from 0, in order of the smallest first_seen (a row number) of each value."""
    firsts = df.groupBy(F.col(column).alias("_v")).agg(F.min(first_seen).alias("_first"))
    ids = numbered(firsts, "_id", "_first").select("_v", (F.col("_id") - 1).alias("_id"))
    return df.join(ids, F.col(column).eqNullSafe(F.col("_v"))).withColumn(column, F.col("_id")).drop("_v", "_id")
