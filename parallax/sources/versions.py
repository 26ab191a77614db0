"""Two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The part table and a changed copy: rows dropped, added, renamed and modified by remainders of their key."""
    a = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    k = F.col("p_partkey")
    kept = a.where(k % 17 != 0)
    added = a.where(k % 19 == 0).withColumn("p_partkey", k + 1_000_000)
    changed = kept.withColumn("p_name", F.when(k % 13 == 0, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name"))).withColumn("p_type", F.when(k % 7 == 0, "X").otherwise(F.col("p_type")))
    return a, changed.unionByName(added)


PART_B = """
part_b as (
  select p_partkey, case when p_partkey % 13 = 0 then p_name || ' v2' else p_name end as p_name, case when p_partkey % 7 = 0 then 'X' else p_type end as p_type, p_brand, p_size from part where p_partkey % 17 <> 0
  union all select p_partkey + 1000000, p_name, p_type, p_brand, p_size from part where p_partkey % 19 = 0)
"""
