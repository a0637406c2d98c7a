"""Parts that the query modules share: rounding, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded, so that the order of additions doesn't show."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Cells of all chips: view px in SQL.
PX = """
e AS (SELECT vec_id AS chip_id, label, embedding, unnest(range(64)) AS pos FROM embeddings WHERE len(embedding) = 64),
px AS (SELECT chip_id, ['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'][label % 4 + 1] AS sza_bin, CASE WHEN label % 2 = 1 THEN 'SK' ELSE 'KQ' END AS region,
 CASE WHEN label < 5 THEN 'expert' ELSE 'crowd' END AS source, pos, CAST(pos // 8 AS INT) AS "row", CAST(pos % 8 AS INT) AS col,
 CAST(embedding[pos + 1] AS DOUBLE) + 0.5 AS b08, CAST(embedding[64 - pos] AS DOUBLE) + 0.5 AS b03, CAST(embedding[(pos + 32) % 64 + 1] AS DOUBLE) + 0.5 AS b04 FROM e),
cells AS (SELECT *, CASE WHEN b08 >= 0.60 THEN 1 WHEN b08 >= 0.57 THEN 2 ELSE 0 END AS cls, 1 / (1 + exp(-((b08 - 0.5) * 8 + (b03 - 0.5) * 4))) AS p FROM px)"""

PAIRS = """
pr AS (SELECT l_orderkey AS ref_id, l_linenumber AS pred_id, CASE l_returnflag WHEN 'A' THEN 'OT' WHEN 'N' THEN 'TR' ELSE 'UNet' END AS method,
 CASE l_linestatus WHEN 'O' THEN 'KQ' ELSE 'SK' END AS region, ['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'][l_suppkey % 4 + 1] AS sza_bin,
 CAST(55 + 2 * (l_partkey % 15) AS INT) AS sza_deg, 400 * CAST(l_quantity AS DOUBLE) * CAST(l_quantity AS DOUBLE) AS a_ref,
 400 * CAST(l_quantity AS DOUBLE) * CAST(l_quantity AS DOUBLE) * (CAST(0.7 AS DOUBLE) + (l_orderkey % 97) / CAST(150.0 AS DOUBLE)) AS a_pred, CAST(0.3 AS DOUBLE) + 7 * CAST(l_discount AS DOUBLE) AS iou FROM lineitem)"""

INVENTORY = """
inv AS (SELECT CAST(p_partkey AS BIGINT) AS chip, CASE WHEN p_partkey % 23 = 0 THEN 'unknown' ELSE ['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'][p_size % 4 + 1] END AS sza_bin,
 CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE (p_partkey * 7 + p_size) % 6 END AS INT) AS n_objects, CAST(CASE WHEN p_size = 1 AND p_partkey % 16 > 0 THEN 120 ELSE 20 * p_size END AS DOUBLE) AS max_rl,
 CASE WHEN p_partkey % 3 = 0 THEN 'crowd' ELSE 'expert' END AS source FROM part)"""
