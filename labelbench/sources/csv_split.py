"""Records of quoted CSV files read in splits, also where quoted values hold line breaks.

Whether a line break ends a record depends on the number of quotes before it, from the file's
beginning.  Every split counts on its own: for each of its lines the parity of the quotes before it
in the split, and how many records would have begun by then if the split began outside quotes, and if
inside.  A running sum over one row per split gives the parity that each split begins with, and
with it the number of records before; both numbers are then right for every line.  Records of one
line are ready; the lines of others are grouped, across splits where need be.  A quote inside a
value is doubled, so it does not change the parity.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import land

_LINES = "file string, block long, line string, odd int, before int, even long, uneven long"


def _count_in_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running numbers of each split's lines, which come in order: quotes before, and records begun, by either parity."""
    last, quotes, even, uneven = None, 0, 0, 0
    for b in batches:
        if not len(b):
            continue
        line = b.column("value")
        odd = pc.count_substring(line, '"').to_numpy(zero_copy_only=False).astype(np.int64) % 2
        blank = pc.is_in(line, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        keys = list(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True))
        cut = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        cols = []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            if keys[a] != last:
                last, quotes, even, uneven = keys[a], 0, 0, 0
            before = (quotes + np.cumsum(odd[a:z]) - odd[a:z]) % 2
            begun = [n + np.cumsum((before == p) & ~blank[a:z]) for p, n in ((0, even), (1, uneven))]
            cols.append((before, *begun))
            quotes, even, uneven = (quotes + int(odd[a:z].sum())) % 2, int(begun[0][-1]), int(begun[1][-1])
        before, begun_even, begun_uneven = (np.concatenate(x) for x in zip(*cols, strict=True))
        yield pa.record_batch([b.column("file"), b.column("block"), line, pa.array(odd, pa.int32()), pa.array(before, pa.int32()),
                               pa.array(begun_even), pa.array(begun_uneven)], names=["file", "block", "line", "odd", "before", "even", "uneven"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text) of every record: numbered from 1 in each file, blank lines left out.

    A file that ends inside quotes ends in a record of all lines from there.  Lands the lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = land(lines.mapInArrow(_count_in_splits, _LINES).withColumn("at", F.monotonically_increasing_id()), "csv-lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = lines.groupBy("file", "block").agg(F.sum("odd").alias("n"), F.max("even").alias("even_n"), F.max("uneven").alias("uneven_n")) \
        .withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("inside") == 0, F.col("even_n")).otherwise(F.col("uneven_n"))
    splits = splits.select("file", "block", "inside", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("earlier"))
    lines = lines.join(splits, ["file", "block"]).select(
        "file", "at", "line", "odd", ((F.col("before") + F.col("inside")) % 2).alias("open"),
        (F.col("earlier") + F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("uneven"))).alias("record"))
    alone = (F.col("open") == 0) & (F.col("odd") == 0)
    one = lines.filter(alone & ~F.col("line").isin("", "\r")).select("file", "record", F.col("line").alias("text"))
    many = lines.filter(~alone).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("parts")) \
        .select("file", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
    return one.unionByName(many).withColumn("text", F.regexp_replace("text", "\r\\z", ""))


def read_csv(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The files' columns as text by their common header, with ``_file`` and ``_scan`` (consecutive in a file).  Runs jobs."""
    rows = land(records(spark, path), "csv-records")
    heads = [r.text for r in rows.filter("record = 1").select("text").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError("the files have different headers" if heads else f"no header in {path}")
    names = next(csv.reader([heads[0]]))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    some = {k: v for k, v in options.items() if k != "header"}
    cells = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), some)
    return rows.filter("record > 1").select(cells.alias("c"), "file", "record").select(
        *[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)], F.col("file").alias("_file"), F.col("record").alias("_scan"))
