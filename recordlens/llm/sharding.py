"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Built-in functions only. A row's shard and slot follow from its row number and the number of
rows by arithmetic, so any reader can compute where a row is, and the other way round.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.scratch import Scratch

#: A prime below 2^31, so that products of two residues fit into a long.
PRIME = 2_147_483_647
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A factor and a summand per round, both below the prime."""
    def number(tag: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}/{tag}".encode()).digest()[:8], "big")

    return [(1 + number(f"a{i}") % (PRIME - 1), number(f"b{i}") % PRIME) for i in range(ROUNDS)]


def feistel(x: Column, side: int, seed: int) -> Column:
    """A permutation of 0 .. side^2 - 1: x is (left, right) in base ``side``; every round adds a
    non-linear function of one half to the other, modulo ``side``."""
    keys = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                     for a, b in round_keys(seed)])

    def step(state: Column, key: Column) -> Column:
        t = (state["r"] * key["a"].cast("long") + key["b"].cast("long")) % PRIME
        t = (t * t + key["b"].cast("long")) % PRIME
        return F.struct(state["r"].alias("l"), ((state["l"] + t * t % PRIME) % side).alias("r"))

    start = F.struct(F.call_function("div", x, F.lit(side)).alias("l"), (x % side).alias("r"))
    return F.aggregate(keys, start, step, lambda s: s["l"] * side + s["r"])


def walk(x: Column, rows: int, side: int, steps: int, seed: int) -> Column:
    """Cycle walking: permute once, and again while the value is outside 0 .. rows - 1."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), feistel(x, side, seed),
                       lambda y, _: F.when(y < rows, y).otherwise(feistel(y, side, seed)))


def walk_steps(spark, rows: int, side: int, seed: int) -> int:
    """A number of steps after which every walk has ended, found by walking from each of the
    values outside; there are at most 2 * sqrt(rows) + 1 of them."""
    steps = 1
    while spark.range(rows, side * side).where(
            walk(F.col("id"), rows, side, steps, seed) >= rows).limit(1).count():
        steps *= 2
    return steps + 1


def numbered(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Adds ``row_number``, from 0 in the given order, without sorting in one task.

    The rows are sorted by range and written; then each partition's rows follow those of the
    partitions before it. The joined table has one row per partition.
    """
    sorted_rows = scratch.keep(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sorted")
    counts = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return sorted_rows.join(F.broadcast(starts), "_part") \
        .withColumn("row_number", F.col("_start") + F.col("_at")) \
        .drop("_part", "_at", "_n", "_start"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Deal all rows out over ``shards``, with counts at most one apart (law ``rows``).

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Rows are numbered by id,
    size and checksum; equal rows are interchangeable, null ids come first. A null text has no
    bytes. The permuted number modulo ``shards`` is the shard, its quotient the slot, gapless
    from 0. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = scratch.keep(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")), "narrow")
    rows, total = numbered(narrow, ["doc_id", "size", "text_crc32"], scratch)
    side = max(1, isqrt(max(total, 1) - 1) + 1)
    steps = walk_steps(docs.sparkSession, total, side, seed) if total else 1
    place = walk(F.col("row_number"), total, side, steps, seed)
    return rows.withColumn("_place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
