"""Deterministic samples: by hash, and stratified by largest remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of least SHA-256 of seed:key; a top-n per task, then one merge."""
    return rows.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("hash", key).limit(n)


def seeded_rank(key: Column, seed: int) -> Column:
    """A pseudo-rank from 0 to 65,535."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"m6pilot:{seed}:"), key.cast("string")), 256), 1, 4), 16, 10).cast("int")


def quotas(strata: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """(stratum, size, quota) of strata (stratum, size): one each, the rest in proportion by largest remainder.

    With more strata than target, the first by seeded rank get one. A quota is not more than the stratum has.
    """
    ranked = strata.withColumn("place", seeded_rank(F.col("stratum"), seed))
    total = strata.agg(F.count("*").alias("k"), F.sum("size").alias("all"))
    s = ranked.crossJoin(F.broadcast(total))  # one row
    s = s.withColumn("rest", F.lit(target) - F.col("k")).withColumn("ideal", F.col("rest") * F.col("size") / F.col("all")).withColumn("whole", F.floor("ideal"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left", F.col("rest") - F.sum("whole").over(everything))
    by_rest = F.row_number().over(W.orderBy(F.desc(F.col("ideal") - F.col("whole")), "place", "stratum"))
    by_place = F.row_number().over(W.orderBy("place", "stratum"))
    quota = F.when(F.col("k") > target, (by_place <= target).cast("long")).otherwise(F.lit(1) + F.col("whole") + (by_rest <= F.col("left")).cast("long"))
    return s.select("stratum", "size", F.least("size", quota).alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """The rows of a stratified sample, with their stratum's quota and their place in it."""
    wanted = quotas(rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size")), target, seed)
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(stratum).orderBy(seeded_rank(F.col(key), seed), key))).filter(F.col("place") <= target)
    return placed.join(F.broadcast(wanted.select(F.col("stratum").alias(stratum), "quota")), stratum).filter("place <= quota")
