"""Sharding: a global shuffle in two passes, by built-in functions alone.

First pass: a seeded hash scatters the rows uniformly over buckets of a size that fits in memory, in
one shuffle. Second pass: each bucket, put in a fixed order first, is permuted by Fisher-Yates (Spark's ``shuffle``) and written to
the shared folder. A bucket's place in the whole order is the number of rows in the buckets before
it, so that every row has a global place, and shards are equal ranges of it: their counts differ
by one at most.

The hash takes the row's place in its input partition with the id: rows that repeat, ids that do and
null ids are spread like others, and no group of rows weighs on a bucket. The order is a
function of the seed, the rows and how the input is partitioned; neither settings of shuffles nor the order in which their blocks arrive
matter. Buckets and tasks follow the bytes of the input.

Defined results: a null text has no bytes and no checksum; a null id is a value like others;
repeated rows are dealt out one by one; equal hashes are ordered by place; an empty table gives an empty result; all columns of the
input are carried, those named like an added one with ``_input`` behind their name.
Buckets hold whole rows, however long: their number follows the bytes of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, running_base, set_aside

#: Bytes of texts in a bucket.
BUCKET_BYTES = 4 << 20
#: Bytes of texts in the buckets of a task of the second pass; tasks at most. Beyond them (1 TB) tasks grow: their rows are sorted,
#: on disk where memory ends, and the aggregate holds 128 buckets at most.
TASK_BYTES, MOST_TASKS = 32 << 20, 32_768


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffled(df: DataFrame, n_shards: int, *, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The input's columns with shard (int) and slot (long): gapless from 0 in each shard, in random order."""
    df = set_aside(df, ("shard", "slot"))
    scratch = Scratch(df.sparkSession, "sharding")
    size = df.agg(F.coalesce(F.sum(text_size(F.col(text_col)) + 64), F.lit(0))).first()[0]
    n_buckets, n_tasks = size // bucket_bytes + 1, min(size // task_bytes + 1, MOST_TASKS)
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)))
    numbered = df.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), row.alias("row"))
    scattered = numbered.select(F.xxhash64(F.lit(seed), F.col("id"), F.col("place")).alias("h"), "place", "row").withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    # Each task's buckets in order, each bucket's rows in order: so the aggregate's lists and the random numbers that
    # shuffle draws one after another are the same whenever the task runs.
    dealt = scattered.repartition(n_tasks, "bucket").sortWithinPartitions("bucket", "h", "place")
    permuted = dealt.groupBy("bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows"))
    buckets = scratch.cut(permuted.select("bucket", F.posexplode("rows").alias("at", "row")), "buckets")
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total = buckets.count()
    offsets = running_base(counts, "bucket", "n")
    rows = buckets.join(F.broadcast(offsets) if n_buckets <= BROADCAST_KEYS else offsets, "bucket").select((F.col("base") + F.col("at")).alias("place"), "row")
    # The first total % n_shards shards have one row more than the others.
    least, more = divmod(total, n_shards)
    ahead = more * (least + 1)
    place = F.col("place")
    early = place < ahead
    shard = F.when(early, F.expr(f"place div {least + 1}")).otherwise(more + F.expr(f"(place - {ahead}) div {max(1, least)}"))
    start = F.when(early, F.col("shard") * (least + 1)).otherwise(ahead + (F.col("shard") - more) * least)
    return rows.withColumn("shard", shard.cast("int")).select(
        *(F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)), "shard", (F.col("place") - start).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write ``path/shard=0`` and so on as Parquet, rows of a file in the order of their slots.

    The buckets are in the order of the shards already; each task writes its range of slots."""
    rows = shuffled(df, n_shards, **options)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
