"""Configuration predicates and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import cfg
from factloom.registry import _query
from factloom.sources.tables import read


@_query("""
WITH atoms AS (SELECT p_partkey AS id, p_partkey % 4 AS shape, p_partkey % 3 AS context, p_size FROM part),
truth AS (SELECT id, shape, context,
  CASE p_size % 5 WHEN 0 THEN CASE context WHEN 0 THEN true END WHEN 1 THEN NULL WHEN 2 THEN false ELSE CASE context WHEN 0 THEN true WHEN 1 THEN false END END AS a,
  CASE p_size % 3 WHEN 0 THEN CASE context WHEN 0 THEN true END WHEN 1 THEN false ELSE CASE context WHEN 0 THEN true WHEN 1 THEN false END END AS b, CASE p_size % 2 WHEN 0 THEN false END AS c FROM atoms),
value AS (SELECT id, context, CASE shape WHEN 0 THEN a AND b WHEN 1 THEN a OR NOT b WHEN 2 THEN NOT (a AND (b OR c)) ELSE a END AS v FROM truth)
SELECT id, context, CASE WHEN v THEN 'active' WHEN NOT v THEN 'inactive' ELSE 'unknown' END AS status FROM value""")
def cfg_status(spark, d):
    rows = read(spark, d, "v_cfg")
    context = F.col("context")
    text = F.lit(None).cast("string")
    keys = F.when(context == 0, F.create_map(F.lit("unix"), text, F.lit("target_os"), F.lit("linux"))).when(context == 1, F.create_map(F.lit("target_os"), F.lit("none"))).otherwise(F.create_map().cast("map<string,string>"))
    features = F.when(context == 0, F.array(F.lit("std"))).otherwise(F.array().cast("array<string>"))
    found = rows.join(cfg.parsed(rows), "predicate", "left")
    return found.select("id", "context", cfg.evaluate(F.col("steps"), keys, features, context == 2).alias("status"))


@_query("""
WITH RECURSIVE closure AS (
  SELECT DISTINCT package, feature FROM v_features WHERE CAST(substr(feature, 2) AS BIGINT) % 5 = 0
  UNION SELECT v.package, v.enables FROM closure AS c JOIN v_features AS v ON v.package = c.package AND v.feature = c.feature WHERE c.feature NOT LIKE 'dep:%')
SELECT package, feature, package NOT IN (SELECT package FROM closure WHERE feature LIKE 'dep:%') AS known FROM closure WHERE feature NOT LIKE 'dep:%'""")
def feature_closure(spark, d):
    declared = read(spark, d, "v_features")
    return cfg.feature_closure(declared.where("CAST(substr(feature, 2) AS BIGINT) % 5 = 0"), declared)
