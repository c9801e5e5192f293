"""Queries over whole tables of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import skew
from ..session import table

P3_SHARE = 0.02


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    edges = table(spark, sf_dir, "edges")
    return skew.key_rows(edges, "subject_id", "object_id", F.col("predicate"), F.col("confidence")), edges.count()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that hold at least 2 % of all edge rows at one end."""
    keys, total = _ends(spark, sf_dir)
    return skew.hot_keys(keys, total, P3_SHARE).select("node_id", "end_role")


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, distinct partners, most frequent predicate and hotness of every id and end."""
    keys, total = _ends(spark, sf_dir)
    return skew.key_profile(keys, total, P3_SHARE)


def p3_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of edge confidence of every id and end."""
    keys, _ = _ends(spark, sf_dir)
    return skew.key_quantiles(keys, ["node_id", "end_role"], "confidence", [0.25, 0.5, 0.75])


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p3_quantiles": p3_quantiles}

_ENDS = """
WITH e AS (
  SELECT subject_id AS node_id, 'subject' AS end_role, object_id AS partner, predicate, confidence FROM edges WHERE subject_id IS NOT NULL
  UNION ALL SELECT object_id, 'object', subject_id, predicate, confidence FROM edges WHERE object_id IS NOT NULL)
"""

ORACLE = {
    "p3_found": _ENDS + f"SELECT node_id, end_role FROM e GROUP BY ALL HAVING count(*) >= {P3_SHARE} * (SELECT count(*) FROM edges)",
    "p3_profile": _ENDS
    + f""", c AS (SELECT node_id, end_role, count(*) AS n_rows, count(DISTINCT partner) AS n_partners FROM e GROUP BY ALL),
p AS (SELECT node_id, end_role, predicate, count(*) AS n FROM e WHERE predicate IS NOT NULL GROUP BY ALL),
t AS (SELECT node_id, end_role, predicate, n FROM p QUALIFY row_number() OVER (PARTITION BY node_id, end_role ORDER BY n DESC, predicate) = 1)
SELECT c.node_id, c.end_role, n_rows, n_partners, t.predicate AS top_predicate, t.n AS top_predicate_rows,
  n_rows >= {P3_SHARE} * (SELECT count(*) FROM edges) AS is_hot
FROM c LEFT JOIN t ON t.node_id = c.node_id AND t.end_role = c.end_role""",
    "p3_quantiles": _ENDS
    + """, v AS (SELECT node_id, end_role, confidence, row_number() OVER (PARTITION BY node_id, end_role ORDER BY confidence) AS r,
  count(*) OVER (PARTITION BY node_id, end_role) AS n FROM e WHERE confidence IS NOT NULL)
SELECT node_id, end_role, q.q, n, confidence AS value FROM v, (VALUES (0.25::DOUBLE), (0.5), (0.75)) q(q) WHERE r = greatest(1, ceil(q.q * n))""",
}
