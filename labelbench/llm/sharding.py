"""Extendible hashing into shards of bounded bytes (native).

A shard is a prefix of the bits of a row's hash.  The directory starts with one bucket; only a
bucket above the byte limit splits on one more bit, until every shard fits.  Splitting is
decided on byte sums alone: rounds of ``STRIDE`` bits aggregate (prefix, bytes) of the rows that
still lie in oversized buckets, so a round shuffles sums, never texts.  Rows that no bit can
tell apart (equal keys) go to overflow pages of the last bucket, numbered by a two-level count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import as_docs, numbered

HASH_BITS = 60
STRIDE = 12
LIMIT_BYTES = 256 * 1024


def hash_of(key: str) -> F.Column:
    """The first 60 bits of the md5 of the key as text (null key: as the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(depth: F.Column | int) -> F.Column:
    return F.expr(f"shiftright(h, cast({HASH_BITS} - ({depth}) as int))")


def directory(sized: DataFrame, limit_bytes: int) -> DataFrame:
    """(depth, prefix_bits, n_bytes): the leaf buckets.  ``sized`` has h and n_bytes per row.

    The oversized buckets after a round are a table of their own; the rows of the next round
    are found by a semi join on the prefix.  Depth ends at the hash's bits.
    """
    leaves, rest, depth = [], sized, 0
    while depth < HASH_BITS:
        top = min(depth + STRIDE, HASH_BITS)
        fine = rest.groupBy(prefix(top).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(top))).alias("depth"), "p", "n_bytes")
        sums = levels.groupBy("depth", F.expr(f"shiftright(p, {top} - depth)").alias("prefix_bits")).agg(F.sum("n_bytes").alias("n_bytes"))
        sums = land(sums.withColumn("over", F.col("n_bytes") > limit_bytes), "shard-sums")
        if sums.isEmpty():
            break
        # a leaf fits (or has no more bits) under a parent that does not
        parent = sums.filter("over").select((F.col("depth") + 1).alias("depth"), F.col("prefix_bits").alias("up"))
        fits = sums.filter(~F.col("over") | (F.col("depth") == HASH_BITS)).withColumn("up", F.shiftright("prefix_bits", 1))
        root = fits.filter(F.col("depth") == depth) if depth == 0 else fits.filter("false")
        leaves.append(root.select("depth", "prefix_bits", "n_bytes"))
        leaves.append(fits.filter(F.col("depth") > depth).join(parent, ["depth", "up"], "left_semi").select("depth", "prefix_bits", "n_bytes"))
        big = sums.filter(F.col("over") & (F.col("depth") == top)).select(F.col("prefix_bits").alias("p"))
        if top == HASH_BITS or big.isEmpty():
            break
        rest = land(rest.withColumn("p", prefix(top)).join(big, "p", "left_semi").select("h", "n_bytes"), "shard-rest")
        depth = top
    if not leaves:
        return sized.select(F.lit(0).alias("depth"), F.col("h").alias("prefix_bits"), "n_bytes").limit(0)
    return land(reduce(DataFrame.unionByName, leaves), "shard-directory")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(key, n_bytes, depth, shard_bits, page): the shard of every row.

    ``shard_bits`` is the bucket's prefix as a string of ``depth`` bits; ``page`` is 0 but for rows
    of one and the same hash that together exceed the limit: those fill numbered pages, of mixed
    sizes, at least half full on the whole.  The key
    column keeps its name.  Null text has 0 bytes; null keys share one hash; a single row above
    the limit has a page of its own.  An empty table has no shard.
    """
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint")
    rows = as_docs(docs, key, text).select(F.col(f"`{key}`").alias("k"), n_bytes.alias("n_bytes"), F.monotonically_increasing_id().alias("row_no"))
    return _assigned(rows, limit_bytes).select(F.col("k").alias(key), "n_bytes", "depth", "shard_bits", "page")


def _assigned(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(k, n_bytes, depth, shard_bits, page, row_no) for rows of k, n_bytes and row_no."""
    rows = land(rows.withColumn("h", hash_of("k")).withColumn("salt", F.spark_partition_id()), "shard-rows")
    leaf = directory(rows.select("h", "n_bytes"), limit_bytes)
    depths = [r[0] for r in leaf.select("depth").distinct().orderBy("depth").collect()]  # at most 61 numbers
    # the depth of a row's leaf differs between rows, so a row looks up every depth in use at once
    probe = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>"))) \
        .withColumn("prefix_bits", prefix("depth"))
    found = probe.join(leaf.withColumnRenamed("n_bytes", "leaf_bytes"), ["depth", "prefix_bits"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.lpad(F.conv(F.col("prefix_bits").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    found = found.withColumn("shard_bits", bits)
    # overflow pages: rows of an oversized last-level bucket, numbered in two levels.  Rows above half the
    # limit have a page each.  Of the others a page takes those whose first byte, in the running sum of their
    # sizes, lies in one stretch of (limit - largest + 1) bytes: whatever their sizes, they fit the limit.
    over = F.col("leaf_bytes") > limit_bytes
    alone = F.col("n_bytes") * 2 > limit_bytes
    small = found.filter(~over).withColumn("page", F.lit(0).cast("bigint"))
    large = land(found.filter(over).withColumns({"alone": alone, "shared": F.when(alone, F.lit(0)).otherwise(F.col("n_bytes"))}), "shard-overflow")
    per = large.groupBy("shard_bits", "salt").agg(F.sum(F.col("alone").cast("bigint")).alias("own"), F.sum("shared").alias("sum_shared"), F.max("shared").alias("most"))
    shard = Window.partitionBy("shard_bits")
    upto = shard.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard_bits", "salt", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("own_before"),
                     F.coalesce(F.sum("sum_shared").over(upto), F.lit(0)).alias("bytes_before"),
                     F.sum("own").over(shard).alias("all_own"), (F.lit(limit_bytes + 1) - F.max("most").over(shard)).alias("room"))
    inside = Window.partitionBy("shard_bits", "salt").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumns({"own_here": F.coalesce(F.sum(F.col("alone").cast("bigint")).over(inside), F.lit(0)),
                               "bytes_here": F.coalesce(F.sum("shared").over(inside), F.lit(0))}).join(per, ["shard_bits", "salt"])
    page = F.when(F.col("alone"), F.col("own_before") + F.col("own_here")).otherwise(
        F.col("all_own") + F.floor((F.col("bytes_before") + F.col("bytes_here")) / F.col("room")))
    large = large.withColumn("page", page.cast("bigint"))
    cols = ["k", "n_bytes", F.col("depth").cast("int").alias("depth"), "shard_bits", "page", "row_no"]
    return small.select(*cols).unionByName(large.select(*cols))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Write the whole rows as Parquet, one folder per shard and page, and return the assignment.

    Every row goes to the page that the assignment gives it, by a number landed with the row:
    rows of one key, or of none, that exceed the limit together lie in several folders.
    """
    whole = numbered(docs)
    of = lambda c: F.col("row").getField(c)
    sized = whole.select(of(key).alias("k"), F.coalesce(F.octet_length(of("text")), F.lit(0)).cast("bigint").alias("n_bytes"), "row_no")
    plan = land(_assigned(sized, limit_bytes), "shard-plan")
    folder = F.concat_ws("-", F.concat(F.lit("b"), F.col("shard_bits")), F.col("page").cast("string"))
    out = whole.join(plan.select("row_no", folder.alias("_shard")), "row_no").select(*[of(c).alias(c) for c in docs.columns], "_shard")
    out.repartition("_shard").write.mode("overwrite").partitionBy("_shard").parquet(path)
    return plan.select(F.col("k").alias(key), "n_bytes", "depth", "shard_bits", "page")
