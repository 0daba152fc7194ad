"""The features of pairs field by field, as the operators give them and as SQL that is put together from their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import features, relations, tfidf
from ..sources import files
from . import tables as T
from .queries import query, six, with_

_NAME = "lower(trim(replace({}name, ';', '')))"
_COUNT = "SELECT '{field}' AS field, {author} AS author_id, CAST({value} AS VARCHAR) AS value, count(*) AS cnt FROM {rows} GROUP BY ALL"
_MINE = "mine AS (SELECT pa.* FROM pa WHERE AuthorId IN (SELECT Id FROM awp))"
_DPA = "dpa AS (SELECT pa.* FROM pa JOIN dup ON pa.PaperId = dup.PaperId AND pa.AuthorId = dup.AuthorId)"
_AGAIN = "again AS (SELECT * FROM dpa WHERE AuthorId IN (SELECT Id FROM awp))"
_SHARED = "shared AS (SELECT * FROM paper WHERE Title <> '' AND Title IN (SELECT Title FROM paper GROUP BY Title HAVING min(Id) <> max(Id)))"
_ON_PAPER = "mine JOIN {1} p ON mine.PaperId = p.Id WHERE {0}"


def _coauthors(field: str, left: str, right: str, by_name: bool) -> str:
    rows = f"{left} x JOIN {right} y ON x.PaperId = y.PaperId AND x.AuthorId <> y.AuthorId" + (" WHERE y.name <> ''" if by_name else "")
    return _COUNT.format(field=field, author="x.AuthorId", value=_NAME.format("y.") if by_name else "y.AuthorId", rows=rows)


_RELATIONS = [
    _COUNT.format(field="fullname", author="AuthorId", value=_NAME.format(""), rows="mine WHERE name <> ''"),
    _COUNT.format(field="fullname_dup", author="AuthorId", value=_NAME.format(""), rows="again WHERE name <> ''"),
    _COUNT.format(field="affiliation", author="AuthorId", value="lower(affiliation)", rows="mine WHERE affiliation <> ''"),
    _COUNT.format(field="years", author="AuthorId", value="Year", rows=_ON_PAPER.format("Year BETWEEN 1600 AND 2013", "paper")),
    _COUNT.format(field="conferences", author="AuthorId", value="ConferenceId", rows=_ON_PAPER.format("ConferenceId > 0", "paper")),
    _COUNT.format(field="journals", author="AuthorId", value="JournalId", rows=_ON_PAPER.format("JournalId > 0", "paper")),
    _COUNT.format(field="paperids", author="AuthorId", value="PaperId", rows="mine"),
    _COUNT.format(field="paperids_dup", author="AuthorId", value="PaperId", rows="again"),
    _COUNT.format(field="paperids_titled", author="AuthorId", value="PaperId", rows=_ON_PAPER.format("Title <> ''", "paper")),
    _COUNT.format(field="titles_shared", author="AuthorId", value="Title", rows=_ON_PAPER.format("Title <> ''", "shared")),
    _coauthors("coauthors", "mine", "pa", True),
    _coauthors("coauthors_ids", "mine", "pa", False),
    _coauthors("coauthors_dup", "again", "dpa", True),
    _coauthors("coauthors_ids_dup", "again", "dpa", False),
]
_AV = "av AS (" + " UNION ALL ".join(_RELATIONS) + ")"
_TOTAL = "tot AS (SELECT field, author_id, count(*) AS k, sum(cnt) AS t FROM av GROUP BY ALL)"
_SIMS = """sims AS (SELECT a, b, field, count(*) / min(least(p.k, q.k)) AS set_sim, sum(least(x.cnt, y.cnt)) / min(least(p.t, q.t)) AS weighted_sim,
  sum(least(x.cnt / p.t, y.cnt / q.t)) AS freq_min, sum(x.cnt / p.t + y.cnt / q.t) AS freq_sum, sum(least(x.cnt, y.cnt)) AS common_weight
  FROM spairs JOIN av x ON x.author_id = a JOIN av y USING (field, value) JOIN tot p USING (field) JOIN tot q USING (field)
  WHERE y.author_id = b AND p.author_id = a AND q.author_id = b GROUP BY ALL)"""
_OWN = "own AS (SELECT s_suppkey AS author_id, lower(s_name) AS fullname, lower(n_name) AS affiliation FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_SPANS = "spans AS (SELECT author_id, quantile_cont(CAST(value AS INTEGER), 0.1) AS lo, quantile_cont(CAST(value AS INTEGER), 0.9) AS hi FROM (SELECT author_id, value, unnest(range(cnt)) FROM av WHERE field = 'years') GROUP BY ALL)"
_TOKENS = r"regexp_extract_all(lower({}), '\b[0-9]*[a-zA-Z]+[a-zA-Z0-9]+\b')"


def _vectors(name: str, texts: str, members: str) -> str:
    """Vectors of authors: sums over their different members (author_id, id) of the weights of the texts' (id, text) terms."""
    return f"""{name}_t AS (SELECT DISTINCT id, unnest({_TOKENS.format('text')}) AS term FROM ({texts})),
{name}_w AS (SELECT term, ln((1 + (SELECT count(*) FROM ({texts}))) / (1 + count(*))) + 1 AS w FROM {name}_t GROUP BY ALL HAVING count(*) >= 2),
{name}_v AS (SELECT author_id, term, sum(w) AS w FROM (SELECT DISTINCT author_id, id FROM ({members})) JOIN {name}_t USING (id) JOIN {name}_w USING (term) GROUP BY ALL),
{name}_s AS (SELECT a, b, sum(x.w) AS s FROM spairs JOIN {name}_v x ON x.author_id = a JOIN {name}_v y ON y.author_id = b AND x.term = y.term GROUP BY ALL)"""


_PUBS = "SELECT c_custkey AS id, c_mktsegment || ' ' || c_name AS text FROM customer"
_PAPERS = "SELECT Id AS id, Title || ' ' || Keyword AS text FROM paper"
_TEXT_VECTORS = [
    _vectors("pub", _PUBS, "SELECT author_id, CAST(value AS BIGINT) AS id FROM av WHERE field = 'conferences'"),
    _vectors("title", _PAPERS, "SELECT AuthorId AS author_id, PaperId AS id FROM mine"),
    _vectors("dup_title", _PAPERS, "SELECT AuthorId AS author_id, PaperId AS id FROM again"),
]
_BOTH_HAVE = "(a IN (SELECT Id FROM awp) AND b IN (SELECT Id FROM awp))"


def _value(field: str, column: str) -> str:
    return f"coalesce((SELECT {column} FROM sims s WHERE s.a = spairs.a AND s.b = spairs.b AND s.field = '{field}'), 0)"


def _feature(sql: str, name: str) -> str:
    return f"round(CASE WHEN {_BOTH_HAVE} THEN CAST({sql} AS DOUBLE) ELSE 0.0::DOUBLE END, 5) AS \"{name}\""


def _share(name: str, field: str, column: str) -> str:
    one = "coalesce((SELECT cnt / t FROM av JOIN tot USING (field, author_id) JOIN own ON own.author_id = {1} WHERE av.field = '{2}' AND av.author_id = {0} AND av.value = own.{3} AND own.{3} <> ''), 0)"
    return f"round(CAST({one.format('a', 'b', field, column)} + {one.format('b', 'a', field, column)} AS DOUBLE), 5) AS {name}"


_YEARS = "coalesce((SELECT least(p.hi, q.hi) - greatest(p.lo, q.lo) + 1 FROM spans p, spans q WHERE p.author_id = spairs.a AND q.author_id = spairs.b), 0)"
_text = lambda n: f"coalesce((SELECT s FROM {n}_s x WHERE x.a = spairs.a AND x.b = spairs.b), 0)"
_CTES = [T.SPAIRS, T.PA, T.AWP, T.PAPER, T.DUP, _MINE, _DPA, _AGAIN, _SHARED, _AV, _TOTAL, _SIMS, _OWN, _SPANS, *_TEXT_VECTORS]
_PAPER_SQL = with_(*_CTES) + "SELECT a, b, CAST(CAST(a IN (SELECT Id FROM awp) AS INTEGER) + CAST(b IN (SELECT Id FROM awp) AS INTEGER) AS INTEGER) AS has_papers, " + ", ".join(
    [
        *[_share(n, f, c) for n, f, c in (("pa_fullname", "fullname", "fullname"), ("pa_fullname_dup", "fullname_dup", "fullname"), ("pa_affil", "affiliation", "affiliation"))],
        *[_feature(_value(f, c), n) for n, f, c in features.OVERLAPS],
        _feature(_YEARS, "yearscore"),
        _feature(f"{_value('titles_shared', 'common_weight')} - {_value('paperids_titled', 'common_weight')}", "titles_dupW"),
        *[_feature(_text(v), n) for v, n in zip(("pub", "title", "dup_title"), features.TEXTS)],
    ]
) + " FROM spairs"


def conferences(spark, d):
    """(pub_id, text) of the publications that papers are in."""
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("pub_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("text"))


@query(_PAPER_SQL)
def paper_feature_values(spark, d):
    """Every paper feature of all pairs of suppliers of one nation."""
    rows = T.table(spark, d, "supplier").join(T.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("fullname"), F.lower("n_name").alias("affiliation"))
    return features.block_listed_features(T.supplier_blocks(spark, d), rows, T.lines(spark, d), T.people(spark, d), T.paper(spark, d), T.with_papers(spark, d), conferences(spark, d), digits=5)


_REC = T.REC.replace("rec AS (SELECT *,", "rec AS (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE 'brand ' || p_brand || ' ' || p_type END AS affiliation, CASE WHEN id % 2 = 0 THEN 'jr' ELSE '' END AS name_suffix,").replace("AS name_last FROM part", "AS name_last, p_brand, p_type FROM part")
_GRAMS = "coalesce(list_distinct(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))), [])"


def _shared(name: str, rows: str) -> str:
    """shared_terms of (id, w), lists of tokens."""
    return f"""{name}_x AS ({rows}), {name}_g AS (SELECT id, unnest({_GRAMS}) AS term FROM {name}_x),
{name}_d AS (SELECT term, ln((1 + (SELECT count(*) FROM {name}_x)) / (1 + count(*))) + 1 AS w FROM {name}_g GROUP BY ALL HAVING count(*) >= 2),
{name}_v AS (SELECT id, term, w FROM {name}_g JOIN {name}_d USING (term)), {name}_tot AS (SELECT id, sum(w) AS t FROM {name}_v GROUP BY ALL),
{name}_c AS (SELECT a, b, sum(x.w) AS c FROM pairs JOIN {name}_v x ON x.id = a JOIN {name}_v y ON y.id = b AND x.term = y.term GROUP BY ALL),
{name}_s AS (SELECT a, b, coalesce(c, 0) - log10(1 + greatest(least(p.t, q.t) - coalesce(c, 0), 0)) AS s FROM pairs JOIN {name}_tot p ON p.id = a JOIN {name}_tot q ON q.id = b LEFT JOIN {name}_c USING (a, b))"""


_JW = "round(CASE WHEN length({0}) = 0 OR length({1}) = 0 THEN 0 ELSE jaro_winkler_similarity({0}, {1}) END, 6) AS {2}"
_NAME_SQL = (
    with_(_REC, T.PAIRS, _shared("aff", "SELECT id, " + _TOKENS.format("affiliation") + " AS w FROM rec WHERE affiliation <> ''"), _shared("nam", r"SELECT id, regexp_extract_all(lower(fullname), '\b[a-zA-Z][a-zA-Z]+\b') AS w FROM rec"),
          "n1 AS (SELECT name_last, ln((SELECT count(*) FROM rec) / count(*)) AS idf FROM rec GROUP BY ALL), n2 AS (SELECT iFfL, ln((SELECT count(*) FROM rec) / count(*)) AS idf FROM rec GROUP BY ALL)")
    + "SELECT a, b, CAST(CASE WHEN x.affiliation <> '' AND y.affiliation <> '' THEN 2 WHEN x.affiliation <> '' OR y.affiliation <> '' THEN 1 ELSE 0 END AS INTEGER) AS has_affil,"
    + " CAST(x.name_suffix = y.name_suffix AND x.name_suffix <> '' AS INTEGER) AS suffix, round(CASE WHEN x.name_last = y.name_last THEN n1.idf ELSE 0 END, 6) AS lastidf, round(CASE WHEN x.iFfL = y.iFfL THEN n2.idf ELSE 0 END, 6) AS \"iFfLidf\","
    + " round(coalesce(nam_s.s, 0), 5) AS fullname_sharedidf, round(CASE WHEN x.affiliation <> '' AND y.affiliation <> '' THEN coalesce(aff_s.s, 0) ELSE -1 END, 5) AS affil_sharedidf, "
    + ", ".join(_JW.format(*[" || ".join(f"{s}.name_{p}" for p in ps) for s in "xy"], f"jarow_{n}") for n, ps in (("first", ["first"]), ("mid", ["middle"]), ("last", ["last"]), ("firstmid", ["first", "middle"]), ("midlast", ["middle", "last"])))
    + " FROM pairs JOIN rec x ON a = x.id JOIN rec y ON b = y.id JOIN n1 ON n1.name_last = x.name_last JOIN n2 ON n2.iFfL = x.iFfL LEFT JOIN nam_s USING (a, b) LEFT JOIN aff_s USING (a, b)"
)


@query(_NAME_SQL)
def name_feature_values(spark, d):
    """The name features of candidate pairs of parts that other queries don't have, affiliations being brands and types."""
    p = T.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lit("brand"), "p_brand", "p_type").alias("b"))
    rows = T.parts(spark, d).join(p, F.col("id") == F.col("p_partkey")).withColumns(
        {"affiliation": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("b")), "name_suffix": F.when(F.col("id") % 2 == 0, "jr").otherwise(""), "metaphone_fullname": F.lit("")}
    ).drop("p_partkey", "b")
    text = lambda c: rows.select(F.col(c).alias("text"))
    whole = tfidf.key_idf(tfidf.key_idf(rows, "iFfL", "iFfL_idf"), "name_last", "lastname_idf")
    values = [
        F.col("has_affil"), F.col("suffix"), six("lastidf", "lastidf"), six("iFfLidf", "iFfLidf"), F.round("fullname_sharedidf", 5).alias("fullname_sharedidf"),
        F.round(F.nanvl("affil_sharedidf", F.lit(-1.0)), 5).alias("affil_sharedidf"), *[six(f"jarow_{n}", f"jarow_{n}") for n in ("first", "mid", "last", "firstmid", "midlast")],
    ]
    return features.block_name_features(whole, "iFfL", text("affiliation").where("text <> ''"), text("fullname"), values=values)


# ---- text functions one by one


@query("SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))))) AS term FROM (SELECT p_partkey AS doc_id, " + _TOKENS.format("p_name || ' ' || p_type || ' ' || p_brand") + " AS w FROM part))")
def name_ngrams(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return tfidf.terms(rows, key=["doc_id"])


@query("SELECT c_custkey, CASE WHEN l <> '' AND f <> '' THEN substr(f, 1, 1) || l WHEN l <> '' THEN 'L:' || l WHEN f <> '' THEN 'F:' || f ELSE 'ID:' || c_custkey END AS \"iFfL\", CASE WHEN f <> '' AND l <> '' THEN f || l WHEN l <> '' THEN 'L:' || l WHEN f <> '' THEN 'F:' || f ELSE 'ID:' || c_custkey END AS \"fFfL\", CASE WHEN f <> '' AND l <> '' THEN f || substr(l, 1, 1) WHEN l <> '' THEN 'L:' || l WHEN f <> '' THEN 'F:' || f ELSE 'ID:' || c_custkey END AS \"fFiL\", CASE WHEN f = '' THEN 'ID:' || c_custkey ELSE f END AS own FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END AS f, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_name) END AS l FROM customer)")
def key_fallbacks(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.lower("c_mktsegment")).alias("f"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.lower("c_name")).alias("l"))
    keys = t.name_keys(F.col("f"), F.col("l"), F.col("c_custkey"))
    return c.select("c_custkey", *[v.alias(k) for k, v in keys.items()], t.or_id(F.col("f"), F.col("c_custkey")).alias("own"))


@query("SELECT p_partkey, round((2 * s + 2 * r) / (sqrt(s * s + r * r + 1) * sqrt(5 + s * s)), 9) AS cosine, r AS number FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice::DOUBLE AS r FROM part)")
def cosine_and_numbers(spark, d):
    p = T.table(spark, d, "part")
    n = lambda *x: F.array(*[F.col(c).cast("double") if isinstance(c, str) else F.lit(c) for c in x])
    return p.select("p_partkey", F.round(t.cosine(n("p_size", "p_retailprice", 1.0), n(1.0, 2.0, "p_size")), 9).alias("cosine"), t.number(F.col("p_retailprice").cast("string")).alias("number"))


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.5e', l_extendedprice / 7.0::DOUBLE) AS DOUBLE) AS six FROM lineitem")
def six_digit_numbers(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.six_digits(F.col("l_extendedprice") / F.lit(7.0)).alias("six"))
