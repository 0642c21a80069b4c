"""Typed CSV scan round trip with dirty text, and the partitioned result sink."""
import math

import pytest
from pyspark.sql import functions as F

from labelbench.constants import LABELS
from labelbench.plans import experiment as ex
from labelbench.session import shared_path
from labelbench.sources import csv as csvsrc
from labelbench.sources import results as results_sink
from labelbench.sources.results import read_results, write_results


def test_csv_roundtrip_dirty_text(spark):
    texts = ['a, "quoted"\nnext line', "\t  lead and trail  \n", "n/a", "", None, "plain"]
    rows = [(str(i), t, "s", "1" if i % 2 else "0", None, None, *(["1"] * len(LABELS)), "n/a") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, csvsrc.raw_schema())
    path = shared_path(spark, "test-csv", unique=True)
    csvsrc.write_csv(df, path)
    out = {r.row_id: r for r in csvsrc.scan_csv_typed(spark, path).collect()}
    assert out[0].description == texts[0] and out[1].description == texts[1]
    assert out[2].description is None and out[3].description is None and out[4].description is None
    assert out[1].ambuiguity == 1 and out[0].ambiguity_type is None and out[5].goal is None
    assert all(out[i].compute == 1 for i in out)


def test_csv_columns_by_header_and_rows_in_file_order(spark, tmp_path):
    cols = ["network", "description", "ambuiguity", "extra"] + [x for x in LABELS if x != "network"]
    for name, start in (("a.csv", 0), ("b.csv", 3)):
        rows = [["1", f'"text {k},\nsecond line"', ["", "yes", "0.5"][k % 3], "x"] + ["0"] * 5 for k in range(start, start + 3)]
        (tmp_path / name).write_text("\n".join(",".join(r) for r in [cols, *rows]) + "\n")
    out = sorted(csvsrc.scan_csv_typed(spark, str(tmp_path)).collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in out] == list(range(6)) and [r.description for r in out] == [f"text {k},\nsecond line" for k in range(6)]
    assert all(r.network == 1 and r.compute == 0 and r.extra == "x" for r in out)
    assert out[0].ambuiguity is None and math.isnan(out[1].ambuiguity) and out[2].ambuiguity == 0.5
    with pytest.raises(Exception, match="malformed"):
        csvsrc.scan_csv_typed(spark, str(tmp_path), strict_annotations=True).collect()
    (tmp_path / "c.csv").write_text(",".join(reversed(cols)) + "\n" + ",".join(["0"] * 9) + "\n")
    with pytest.raises(Exception, match="(?i)header|conform"):
        csvsrc.scan_csv_typed(spark, str(tmp_path)).collect()


def test_experiment_names_stay_text(spark):
    path = shared_path(spark, "test-results", unique=True)
    r = spark.range(2).select(F.when(F.col("id") == 0, "2024").otherwise("007").alias("experiment"), F.col("id").alias("row_id"), F.lit(True).alias("correctness"))
    write_results(r, r.withColumns({c: F.lit(0) for c in ("TP", "TN", "FP", "FN")}), path)
    assert {x.experiment_key for x in ex.artifact_summary(spark, path).collect()} == {"2024", "007"}


def test_result_sink_dynamic_overwrite(spark):
    path = shared_path(spark, "test-results", unique=True)

    def tables(exp, n):
        r = spark.range(n).select(F.lit(exp).alias("experiment"), F.col("id").alias("row_id"),
                                  F.lit(True).alias("correctness"))
        c = r.select("experiment", "row_id", F.lit(1).alias("TP"))
        return r, c

    write_results(*tables("a", 3), path)
    write_results(*tables("b", 2), path)
    write_results(*tables("a", 1), path)  # replaces only experiment a
    res, conf = read_results(spark, path)
    counts = dict(res.groupBy("experiment").count().collect())
    assert counts == {"a": 1, "b": 2}
    assert conf.count() == 3


def test_a_failure_between_the_tables_leaves_the_old_pair(spark, monkeypatch):
    path = shared_path(spark, "test-results", unique=True)

    def tables(n):
        r = spark.range(n).select(F.lit("a").alias("experiment"), F.col("id").alias("row_id"), F.lit(True).alias("correctness"))
        return r, r.select("experiment", "row_id", F.lit(n).alias("TP"))

    write_results(*tables(3), path)
    good, bad = tables(5)
    with pytest.raises(Exception, match="(?i)stopped"):
        write_results(good, bad.withColumn("TP", F.raise_error(F.lit("stopped"))), path)
    res, conf = read_results(spark, path)
    assert res.count() == 3 and {r.TP for r in conf.collect()} == {3}
    # a writer that finds its number taken raises, and what is published stays
    number, entries = results_sink.manifest(spark, path)
    monkeypatch.setattr(results_sink, "manifest", lambda *a: (number - 1, dict(entries)))
    with pytest.raises(RuntimeError, match="another writer"):
        write_results(*tables(7), path)
    monkeypatch.undo()
    assert read_results(spark, path)[0].count() == 3
    with pytest.raises(FileNotFoundError):
        read_results(spark, path + "-none")
