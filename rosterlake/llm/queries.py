"""Queries of the training-data operators over the test tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import canonical, fusion, knn, leaks, level, packing, together, variants
from rosterlake.functions.quality import DANGLING, STAND_INS
from rosterlake.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: rows that are one person and spellings that are one organisation."""
    return variants.variant_pairs(table(spark, d, "alumni"), table(spark, d, "ref_companies"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: the row that supplies the surviving title and major of each repeated record."""
    return fusion.fuse(fusion.alumni_claims(table(spark, d, "alumni")), posterior=False).select(F.col("entity").alias("record_hash"), "field", F.col("record").alias("person_id"))


def p2_fused_values(spark: SparkSession, d: str) -> DataFrame:
    """Surviving values where votes of independent sources may outweigh recency."""
    return fusion.fuse(fusion.alumni_claims(table(spark, d, "alumni")), recency="soft").select(F.col("entity").alias("record_hash"), "field", "value", F.round("posterior", 6).alias("posterior"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: pairs of people of whom one is among the five most similar to the other."""
    return knn.neighbour_pairs(knn.people_neighbours(table(spark, d, "profile_embeddings"), table(spark, d, "multi_aspect_embeddings")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: free-entered values mapped to the canonical lists."""
    return canonical.alumni_to_lists(table(spark, d, "alumni"), table(spark, d, "ref_companies"), table(spark, d, "ref_titles"), table(spark, d, "ref_locations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: pairs of items that occur together far more often than chance."""
    return together.alumni_pairs(table(spark, d, "alumni"), table(spark, d, "skills")).select("item_a", "item_b")


def p6_significance(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, lift and log-likelihood ratio."""
    return together.alumni_pairs(table(spark, d, "alumni"), table(spark, d, "skills")).select("item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: which tokens of which document go into which sequence."""
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: documents and the test items they leak."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 9: reading level of each document with running text."""
    return level.reading_levels(table(spark, d, "documents"), table(spark, d, "graded_samples")).select("doc_id", "level")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_fused_values, p4_found, p5_found, p6_found, p6_significance, p7_packed, p8_found, p9_found)}


_STAND_INS = ", ".join(f"'{x}'" for x in STAND_INS)
_USABLE = rf"""regexp_matches({{v}}, '[\p{{{{L}}}}\p{{{{N}}}}]') AND {{v}} NOT IN ({_STAND_INS}) AND NOT regexp_matches({{v}}, '(\.\.|…|,)$|(^|\s)({"|".join(DANGLING)})$') AND NOT regexp_matches({{v}}, '\([^)]*$')""".format(v=r"lower(trim(regexp_replace(value, '\s+', ' ', 'g')))")

P2_SQL = f"""
WITH g AS (SELECT record_hash FROM alumni WHERE record_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
long AS (SELECT record_hash, person_id, updated_at, 'current_title' AS field, current_title AS value FROM alumni UNION ALL SELECT record_hash, person_id, updated_at, 'major', major FROM alumni)
SELECT record_hash, field, person_id FROM (
  SELECT l.*, row_number() OVER (PARTITION BY record_hash, field ORDER BY updated_at DESC NULLS LAST, person_id) AS r
  FROM long l JOIN g USING (record_hash) WHERE value IS NOT NULL AND {_USABLE}) q WHERE r = 1
"""

_P6_PAIRS = """
WITH i AS (SELECT person_id AS b, 'company:' || lower(trim(normalized_company)) AS item FROM alumni WHERE trim(normalized_company) NOT IN ('', '-')
  UNION SELECT person_id, 'title:' || lower(trim(normalized_title)) FROM alumni WHERE trim(normalized_title) NOT IN ('', '-')
  UNION SELECT person_id, 'skill:' || lower(trim(skill)) FROM skills WHERE trim(skill) NOT IN ('', '-') AND person_id IN (SELECT person_id FROM alumni)),
c AS (SELECT item, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT i.* FROM i JOIN c USING (item)), t AS (SELECT count(*) AS total FROM alumni),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM k x JOIN k y ON x.b = y.b AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT item_a, item_b, ca.n AS n_a, cb.n AS n_b, n_ab, total FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b, t WHERE n_ab * total >= 3 * ca.n * cb.n)
"""
P6_SQL = _P6_PAIRS + "SELECT item_a, item_b FROM f"
P6_LLR_SQL = _P6_PAIRS + """SELECT item_a, item_b, n_a, n_b, n_ab, round(n_ab * total / (n_a::DOUBLE * n_b), 6) AS lift, round(2 * (
  n_ab * ln(n_ab * total::DOUBLE / (n_a * n_b)) + CASE WHEN n_a > n_ab THEN (n_a - n_ab) * ln((n_a - n_ab) * total::DOUBLE / (n_a * (total - n_b))) ELSE 0 END
  + CASE WHEN n_b > n_ab THEN (n_b - n_ab) * ln((n_b - n_ab) * total::DOUBLE / ((total - n_a) * n_b)) ELSE 0 END
  + CASE WHEN total - n_a - n_b + n_ab > 0 THEN (total - n_a - n_b + n_ab) * ln((total - n_a - n_b + n_ab) * total::DOUBLE / ((total - n_a) * (total - n_b))) ELSE 0 END), 4) AS llr FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p6_found": P6_SQL, "p6_significance": P6_LLR_SQL}
