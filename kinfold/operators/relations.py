"""Count relations (author_id, field, value, cnt) and the relational queries around them.

Inputs: paper_author(PaperId, AuthorId, name, affiliation), paper(Id, Title, Year, ConferenceId, JournalId, Keyword), authors with papers (Id),
and repeated pairs dup(PaperId, AuthorId, Count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normal_name

YEARS = (1600, 2013)


def counts(rows: DataFrame, value: Column, field: str | None = None, author: str = "AuthorId") -> DataFrame:
    """(author_id[, field], value, cnt): how often each author has each value."""
    out = rows.groupBy(F.col(author).alias("author_id"), value.alias("value")).agg(F.count("*").alias("cnt"))
    return out if field is None else out.select("author_id", F.lit(field).alias("field"), F.col("value").cast("string").alias("value"), "cnt")


def repeated_pairs(paper_author: DataFrame) -> DataFrame:
    """(PaperId, AuthorId, Count) of pairs that occur more than once."""
    return paper_author.groupBy("PaperId", "AuthorId").agg(F.count("*").alias("Count")).where("Count > 1")


def only(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key occurs."""
    return rows.join(keys.select(*on), list(on), "left_semi")


def only_authors(rows: DataFrame, awp: DataFrame, author: str = "AuthorId") -> DataFrame:
    return rows.join(awp.select(F.col("Id").alias(author)), author, "left_semi")


def names(pa: DataFrame, field: str | None = None) -> DataFrame:
    """Normalised names an author goes by on papers."""
    return counts(pa.where("name <> ''"), normal_name(F.col("name")), field)


def affiliations(pa: DataFrame, field: str | None = None) -> DataFrame:
    return counts(pa.where("affiliation <> ''"), F.lower("affiliation"), field)


def paper_values(pa: DataFrame, paper: DataFrame, column: str, keep: Column, field: str | None = None) -> DataFrame:
    """Counts of an attribute of an author's papers."""
    return counts(pa.join(paper.where(keep).select(F.col("Id").alias("PaperId"), column), "PaperId"), F.col(column), field)


def years(pa: DataFrame, paper: DataFrame, field: str | None = None) -> DataFrame:
    return paper_values(pa, paper, "Year", F.col("Year").between(*YEARS), field)


def conferences(pa: DataFrame, paper: DataFrame, field: str | None = None) -> DataFrame:
    return paper_values(pa, paper, "ConferenceId", F.col("ConferenceId") > 0, field)


def journals(pa: DataFrame, paper: DataFrame, field: str | None = None) -> DataFrame:
    return paper_values(pa, paper, "JournalId", F.col("JournalId") > 0, field)


def titles(pa: DataFrame, paper: DataFrame, field: str | None = None) -> DataFrame:
    return paper_values(pa, paper, "Title", F.col("Title") != "", field)


def paper_ids(pa: DataFrame, field: str | None = None) -> DataFrame:
    return counts(pa, F.col("PaperId"), field)


def paper_ids_titled(pa: DataFrame, paper: DataFrame, field: str | None = None) -> DataFrame:
    return paper_ids(pa.join(paper.where("Title <> ''").select(F.col("Id").alias("PaperId")), "PaperId", "left_semi"), field)


def shared_titles(paper: DataFrame) -> DataFrame:
    """Papers whose title, not blank, other papers have too: one pre-aggregated pass over titles, then a semi join."""
    many = paper.where("Title <> ''").groupBy("Title").agg(F.min("Id").alias("lo"), F.max("Id").alias("hi")).where("lo <> hi")
    return paper.join(many.select("Title"), "Title", "left_semi")


def titles_shared(pa: DataFrame, paper: DataFrame, field: str | None = None) -> DataFrame:
    return titles(pa, shared_titles(paper), field)


def coauthors(pa: DataFrame, awp: DataFrame | None = None, by_name: bool = False, field: str | None = None) -> DataFrame:
    """How often each author shares a paper with each other author, by id or by normalised name.

    Repeated (paper, author[, name]) rows are counted first, so that the self-join on papers meets each only once and the counts multiply.
    """
    other = normal_name(F.col("name")) if by_name else F.col("AuthorId")
    base = pa.where("name <> ''") if by_name else pa
    left = (only_authors(pa, awp) if awp is not None else pa).groupBy("PaperId", F.col("AuthorId").alias("author_id")).agg(F.count("*").alias("n1"))
    right = base.groupBy(F.col("PaperId").alias("p"), F.col("AuthorId").alias("o"), other.alias("value")).agg(F.count("*").alias("n2"))
    pairs = left.join(right, (F.col("PaperId") == F.col("p")) & (F.col("author_id") != F.col("o")))
    out = pairs.groupBy("author_id", "value").agg(F.sum(F.col("n1") * F.col("n2")).alias("cnt"))
    return out if field is None else out.select("author_id", F.lit(field).alias("field"), F.col("value").cast("string").alias("value"), "cnt")


def summed(rows: DataFrame) -> DataFrame:
    """Counts of values that were renamed to the same one, added up."""
    return rows.groupBy("author_id", "value").agg(F.sum("cnt").alias("cnt"))


def totals(av: DataFrame) -> DataFrame:
    """Per author (and field): different values and the sum of counts."""
    keys = [c for c in ("author_id", "field") if c in av.columns]
    return av.groupBy(*keys).agg(F.count("*").alias("cnt"), F.sum("cnt").alias("total"))


def all_relations(pa: DataFrame, paper: DataFrame, awp: DataFrame, dup: DataFrame) -> DataFrame:
    """The long relation of all fields that pair features read."""
    mine = only_authors(pa, awp)
    again = only(mine, dup, "PaperId", "AuthorId")
    shared_pa = only(pa, dup, "PaperId", "AuthorId")
    parts = [
        names(mine, "fullname"),
        names(again, "fullname_dup"),
        affiliations(mine, "affiliation"),
        years(mine, paper, "years"),
        conferences(mine, paper, "conferences"),
        journals(mine, paper, "journals"),
        paper_ids(mine, "paperids"),
        paper_ids(again, "paperids_dup"),
        paper_ids_titled(mine, paper, "paperids_titled"),
        titles_shared(mine, paper, "titles_shared"),
        coauthors(pa, awp, True, "coauthors"),
        coauthors(pa, awp, False, "coauthors_ids"),
        coauthors(shared_pa, awp, True, "coauthors_dup"),
        coauthors(shared_pa, awp, False, "coauthors_ids_dup"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- ad hoc queries


def details(author: DataFrame, pa: DataFrame, paper: DataFrame, limit: int = 2) -> DataFrame:
    """Authors with up to `limit` of their papers each; authors without papers stay."""
    rows = author.join(pa, author["Id"] == pa["AuthorId"], "left").join(paper.select(F.col("Id").alias("paper_id"), "Title", "Year", "ConferenceId", "JournalId"), F.col("PaperId") == F.col("paper_id"), "left")
    order = Window.partitionBy(author["Id"]).orderBy("PaperId", "Year")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def author_by_id(author: DataFrame, ids: list[int]) -> DataFrame:
    return author.where(F.col("Id").isin(ids))


def blank_but_named(author: DataFrame, pa: DataFrame) -> DataFrame:
    """Authors without a name whose papers give one."""
    named = pa.where("name <> ''")
    return author.where("Name = ''").join(named, author["Id"] == named["AuthorId"]).orderBy("Id", "PaperId", named["name"])


def shared_names(pa: DataFrame, dup: DataFrame) -> DataFrame:
    """(name, authors) of names that several authors of repeated pairs go by, most first."""
    rows = only(pa, dup, "PaperId", "AuthorId").select("AuthorId", "name").distinct()
    return rows.groupBy("name").agg(F.count("*").alias("authors")).where("authors > 1").orderBy(F.desc("authors"), "name")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of a that b lacks."""
    return a.subtract(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def with_partner(rows: DataFrame, key: str, inside: DataFrame | None = None, *outside: DataFrame) -> DataFrame:
    """Rows whose key is in `inside` (if given) and in none of `outside`."""
    out = rows if inside is None else rows.join(inside.select(key), key, "left_semi")
    for o in outside:
        out = out.join(o.select(key), key, "left_anti")
    return out


def groups_having(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def papers_to_parse(paper: DataFrame, pa: DataFrame, names: DataFrame) -> DataFrame:
    """How many different papers have an author of the listed names."""
    return paper.join(pa, paper["Id"] == pa["PaperId"]).join(names, "name", "left_semi").agg(F.countDistinct(paper["Id"]).alias("papers"))


def counts_of(rows: DataFrame, ids: list[int], key: str = "AuthorId") -> DataFrame:
    return rows.where(F.col(key).isin(ids)).groupBy(key).agg(F.count("*").alias("cnt"))
