"""Result tables: per-sentence results and confusion rows, partitioned by experiment.

The workbook pair of the studied workflow (a results sheet and a confusion sheet per
experiment) becomes two Parquet tables partitioned by ``experiment``, published together: both are
written to a folder of their own version, and then a manifest that names the version of every
experiment is put in place by one rename.  A reader takes the newest manifest, so it sees both
tables of an experiment or neither, and a failure before the rename leaves the pair that was there.
Writing one experiment replaces only that experiment's entry.  Manifests are numbered: of two
writers at a time one gets the next number and the other raises.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULTS = "results"
CONFUSION = "confusion"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the newest manifest under ``path`` (0: none), and the version folder of every experiment."""
    fs, folder = _hadoop(spark, f"{path.rstrip('/')}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    if not number:
        return 0, {}
    text = spark.read.option("wholetext", "true").text(f"{folder.toString()}/{number:08d}.json").first()[0]
    return number, json.loads(text)


def write_results(results: DataFrame, confusion: DataFrame, path: str, key: str = "experiment") -> str:
    """Publish both tables of the experiments they hold; the folder of this version.  Experiments without results keep what they had."""
    spark, path = results.sparkSession, path.rstrip("/")
    version = f"versions/{uuid.uuid4().hex[:12]}"
    for name, df in ((RESULTS, results), (CONFUSION, confusion)):
        df.write.partitionBy(key).parquet(f"{path}/{version}/{name}")
    written = [r[0] for r in _table(spark, f"{path}/{version}", RESULTS, key).select(key).distinct().collect()]  # experiment names
    number, entries = manifest(spark, path)
    entries |= {e: version for e in written}
    fs, part = _hadoop(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(json.dumps(entries).encode())
    out.close()
    target = _hadoop(spark, f"{path}/manifests/{number + 1:08d}.json")[1]
    if fs.exists(target) or not fs.rename(part, target):
        raise RuntimeError(f"another writer published to {path} meanwhile")
    return f"{path}/{version}"


def _table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A version's table; experiment names stay text, also those that look like numbers or dates."""
    fields = spark.read.parquet(f"{folder}/{name}").schema.fields
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == key else f for f in fields])
    return spark.read.schema(typed).parquet(f"{folder}/{name}")


def read_results(spark: SparkSession, path: str, key: str = "experiment") -> tuple[DataFrame, DataFrame]:
    """Both tables as published last, every experiment from its own version."""
    _, entries = manifest(spark, path)
    if not entries:
        raise FileNotFoundError(f"nothing is published under {path}")
    versions: dict[str, list[str]] = {}
    for e, v in entries.items():
        versions.setdefault(v, []).append(e)

    def read(name: str) -> DataFrame:
        parts = [_table(spark, f"{path.rstrip('/')}/{v}", name, key).filter(F.col(key).isin(es)) for v, es in versions.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return read(RESULTS), read(CONFUSION)
