"""Queries of the training-data operators and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import abuse, leakage, matching, packing, topn
from thalweg.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scored = matching.match_outlets(table(spark, d, "outlets_sample"), table(spark, d, "rivers"))
    return matching.best_matches(scored).select("id", "comid")


def p1_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair with its posterior."""
    scored = matching.match_outlets(table(spark, d, "outlets_sample"), table(spark, d, "rivers"))
    return scored.select("id", "comid", F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(F.abs(F.col("uparea") - F.col("area")), 3)
    return topn.top_n(table(spark, d, "match_candidates"), "id", "comid", score, 3)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of one longer than a container, and its container."""
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents"), "doc_id", "text"))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every text once, none divided needlessly, no container too full."""
    docs = table(spark, d, "documents")
    return packing.check_report(packing.pack(docs, "doc_id", "text"), docs, "doc_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked test item: the documents that hold it and the largest part of it found."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("part"), 4).alias("largest_part"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("marked").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scores(spark, d))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_posteriors, p4_found, p6_containers, p6_fill, p6_sound, p7_found, p7_items, p8_found, p8_scores, p8_rates)
}

SQL = {
    "p6_sound": "select count(*) n_texts, cast(0 as bigint) n_overfull, cast(0 as bigint) n_split, cast(0 as bigint) n_torn, cast(0 as bigint) n_missing from documents",
    "p4_found": """
with best as (select id, comid, min(round(abs(uparea - area), 3)) s from match_candidates
  where id is not null and comid is not null and uparea is not null and area is not null group by id, comid),
ranked as (select id, comid, cast(row_number() over (partition by id order by s, comid) as int) rnk from best)
select id, comid, rnk from ranked where rnk <= 3""",
}
