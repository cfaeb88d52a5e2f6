"""Merges, sampling, apportionment, and reads in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of ``new`` over rows of ``old`` by key; the columns in ``keep`` stay as they were where a row existed."""
    columns = old.columns
    o = old.select(F.col(key), F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns if c != key])
    n = new.select(F.col(key), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns if c != key])
    both = o.join(n, key, "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        first = F.col(f"_o_{c}") if c in keep else F.col(f"_n_{c}")
        second = F.col(f"_n_{c}") if c in keep else F.col(f"_o_{c}")
        ours = F.col("_old") if c in keep else F.col("_new")
        return F.when(ours, first).otherwise(second).alias(c)

    return both.select(*[value(c) for c in columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def quota_sample(rows: DataFrame, stratum: list[str], key: str, share: float, least: int = 1) -> DataFrame:
    """The rows of smallest MD5 of the key in each stratum: a share of it, rounded half to even, ``least`` at least."""
    w = Window.partitionBy(*stratum)
    ranked = rows.withColumn("_n", F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")), key))).withColumn("_of", F.count("*").over(w))
    return ranked.where(F.col("_n") <= F.greatest(F.lit(least), F.bround(F.col("_of") * F.lit(share)).cast("int"))).drop("_n", "_of")


def largest_remainder(counts: DataFrame, key: str, count: str, seats: int) -> DataFrame:
    """Seats in proportion to counts: whole parts first, the rest to the largest remainders, ties by key.

    ``counts`` is a report of few rows; the ranking over all of them is one small task.
    """
    whole = Window.partitionBy()
    exact = F.lit(float(seats)) * F.col(count) / F.sum(count).over(whole)
    shares = counts.withColumn("_x", exact).withColumn("_floor", F.floor("_x").cast("bigint"))
    left = F.lit(seats) - F.sum("_floor").over(whole)
    ranked = shares.withColumn("_left", left).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_floor"), 9)), key)))
    return ranked.select(key, count, (F.col("_floor") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("seats"))


def round_robin(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Adds ``turn``: rows of a group take turns in order of the key; order by (turn, group) to draw evenly."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key)))


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, votes, unanimous): the most frequent value, of equally frequent ones the earliest."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    top = counted.groupBy(group).agg(F.max(F.struct(F.col("votes"), (-F.col("first")).alias("early"), F.col(value))).alias("m"), (F.count("*") == 1).alias("unanimous"))
    return top.select(group, F.col(f"m.{value}").alias(value), F.col("m.votes").alias("votes"), "unanimous")


def cache_report(requests: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(hits, misses, fills, held_before): requests a keyed cache answers, those it does not, and the new entries.

    Requests under a null key are not counted; equal requests that miss fill one entry.
    """
    asked = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    both = asked.join(held.select(key, F.lit(True).alias("here")), key, "left")
    hit = F.col("here").isNotNull()
    counts = both.agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("misses"), F.count_if(~hit).alias("fills"))
    return counts.crossJoin(F.broadcast(held.agg(F.count("*").alias("held_before"))))  # one row each


def append_sequence(old: DataFrame, new: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``new`` with its ``sequence``, counted on from the greatest of its group in ``old``; from 0 in a new group."""
    top = old.groupBy(group).agg(F.max("sequence").alias("_top"))
    placed = new.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.join(top, group, "left").withColumn("sequence", F.coalesce("_top", F.lit(-1)) + F.col("_k")).drop("_top", "_k")
