"""The scan in splits against Spark's serial scan and Python's csv module, with splits of a few bytes."""
import csv
import io
import random

import pytest

from labelbench.constants import LABELS
from labelbench.sources import csv as csvsrc
from labelbench.sources import csv_split


@pytest.fixture
def tiny_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "500")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def text_of(rows, **kw):
    out = io.StringIO()
    csv.writer(out, **kw).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_splits(spark, tmp_path, tiny_splits, end):
    random.seed(2)
    cell = lambda: "".join(random.choice(['a', 'bc ', '"', '""', "\n", "\n\n", ",", "é", "\r\n"]) for _ in range(random.randint(0, 12)))
    rows = {f"{k}.csv": [["x", "y", "z"], *[[f"k{i}", cell(), cell()] for i in range(n)]] for k, n in (("a", 60), ("b", 1), ("c", 25))}
    for name, some in rows.items():
        (tmp_path / name).write_bytes((text_of(some, lineterminator=end) + end + end).encode())
    got = csv_split.records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 3
    out = {}
    for r in got.collect():
        out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.record, r.text))
    for name, some in rows.items():
        assert [k for k, _ in sorted(out[name])] == list(range(1, len(some) + 1))
        assert [next(csv.reader(io.StringIO(t, newline=""))) for _, t in sorted(out[name])] == some


def test_equals_the_serial_scan(spark, tmp_path, tiny_splits):
    random.seed(3)
    cols = ["description", "ambuiguity", "extra"] + LABELS
    for name in "ab":
        rows = [[random.choice(['plain', 'two\nlines', 'say "so", then\n\n', ' lead', "n/a", ""]), random.choice(["", "1", "0.5", "yes"]), f"{name}{k}"] + ["1"] * len(LABELS)
                for k in range(40)]
        (tmp_path / f"{name}.csv").write_text(text_of([cols, *rows], lineterminator="\n", quoting=csv.QUOTE_ALL))
    both = [sorted(map(str, csvsrc.scan_csv_typed(spark, str(tmp_path), in_splits=s).select("row_id", *cols).collect())) for s in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 80
    (tmp_path / "c.csv").write_text("other\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        csvsrc.scan_csv_typed(spark, str(tmp_path), in_splits=True)


def test_open_quote_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"never\nclosed\n')
    assert sorted((r.record, r.text) for r in csv_split.records(spark, str(tmp_path)).collect()) == [(1, "x,y"), (2, '1,"never\nclosed')]
    (tmp_path / "a.csv").write_text("x,y\n")
    assert csv_split.read_csv(spark, str(tmp_path), {}).count() == 0


def test_query_writes_more_files_for_more_text(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from labelbench.plans import registry

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit('say "so"\n'), F.col("id").cast("string")).alias("text"), F.lit("web").alias("source"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    paths, write = [], csvsrc.write_csv
    monkeypatch.setattr(csvsrc, "write_csv", lambda df, path: (paths.append(path), write(df, path)))
    rows = {}
    for size in (1 << 20, 150):
        monkeypatch.setattr(registry, "CSV_FILE_BYTES", size)
        rows[size] = sorted(map(str, registry.REGISTRY["scan_csv_splits"](spark, str(tmp_path)).collect()))
    files = [spark.read.text(p).select(F.col("_metadata.file_path")).distinct().count() for p in paths]
    assert files[0] == 1 and files[1] == 3 and rows[150] == rows[1 << 20] and len(rows[150]) == 48
