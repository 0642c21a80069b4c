"""Keep-first de-duplication, null-keeping subset filters, suite sizes, overlay."""
from pyspark.sql import functions as F

from labelbench.constants import LABELS
from labelbench.operators import clean, subsets as sb


def _table(spark, rows):
    cols = "row_id long, description string, ambuiguity int, ambiguity_type int, " + \
        ", ".join(f"{l} int" for l in LABELS)
    return spark.createDataFrame([(*r, *([0] * len(LABELS))) for r in rows], cols)


def test_keep_first_case_insensitive_and_nulls(spark):
    df = _table(spark, [(5, "Hello", 0, None), (2, "hello", 1, 2), (9, "HELLO", 0, None),
                        (3, None, 0, None), (1, None, 1, 1), (7, "other", 0, None)])
    kept = sorted(r.row_id for r in clean.dedupe_keep_first(df).collect())
    assert kept == [1, 2, 7]  # first of 'hello', first NULL, 'other'
    assert clean.duplicate_count(df).first().duplicates == 3
    flags = dict(clean.duplicate_flags(df).select("row_id", "is_duplicate").collect())
    assert flags == {1: False, 2: False, 3: True, 5: True, 7: False, 9: True}


def test_keep_first_by_repeats(spark):
    """Same rows as the semi join, also with a key of a third of all rows, and no shuffle of the table while repeats are few."""
    df = _table(spark, [(5, "Hello", 0, None), (2, "hello", 1, 2), (9, "HELLO", 0, None), (3, None, 0, None), (1, None, 1, 1), (7, "other", 0, None)])
    assert sorted(r.row_id for r in clean.dedupe_keep_first(df, land_repeats=True).collect()) == [1, 2, 7]
    many = spark.range(6000).select(F.col("id").alias("row_id"), F.expr("case when id % 3 = 0 then 'Hot' when id % 3 = 1 then concat('u', id % 900) end").alias("description"))
    kept = sorted(r.row_id for r in clean.dedupe_keep_first(many, land_repeats=True).collect())
    assert kept == sorted(r.row_id for r in clean.dedupe_keep_first(many).collect()) and len(kept) == 302
    plan = clean.dedupe_keep_first(many, land_repeats=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "hashpartitioning" not in plan
    assert clean.dedupe_keep_first(df.limit(0), land_repeats=True).count() == 0


def test_landed_subset_counts_and_session_still_trains(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df = _table(spark, [(1, "a", 0, None), (2, "b", 1, 2), (3, "c", 1, 1), (4, "d", 0, None)])
    out, n = sb.landed_subset(df, condition=F.col("row_id") > 1, query="ambiguity_type is null or ambiguity_type <> 2")
    assert n == 2 and sorted(r.row_id for r in out.collect()) == [3, 4]
    assert sb.landed_subset(df, condition=F.col("row_id") > 9)[1] == 0
    points = spark.range(40).select(array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    assert LogisticRegression(maxIter=2).fit(points).numFeatures == 1


def test_null_keeping_type_filter(spark):
    df = _table(spark, [(1, "a", 0, None), (2, "b", 1, 1), (3, "c", 1, 2), (4, "d", None, None)])
    suite = sb.subset_suite(df)
    got = {}
    for r in suite.collect():
        got.setdefault(r.experiment, set()).add(r.row_id)
    assert got["baseline"] == {1, 2, 3, 4}
    assert got["no_ambiguity"] == {1}                       # NULL annotation is not 0
    assert got["no_lexical_ambiguity"] == {1, 3, 4}         # NULL type is kept
    sizes = dict(sb.subset_sizes(df).collect())
    assert sizes["benchmark_all"] == 4 and sizes["no_pragmatic_ambiguity"] == 4
    assert len(sizes) == 7


def test_empty_subset_size_is_zero(spark):
    df = _table(spark, [(1, "a", 1, 1)])
    sizes = dict(sb.subset_sizes(df).collect())
    assert sizes["no_ambiguity"] == 0 and sizes["no_lexical_ambiguity"] == 0


def test_prepare_baseline_drops_and_casts(spark):
    df = _table(spark, [(1, "a", 0, None)]).withColumn("goal", F.lit("1"))
    out = sb.prepare_baseline(df, labels=[], metadata=[])  # empty lists fall back to defaults
    assert out.columns == ["row_id", "description", *LABELS]


def test_overlay_rewrites(spark):
    df = _table(spark, [(1, "a", 1, 1), (2, "b", 1, 2), (3, "c", 0, None)])
    rw = spark.createDataFrame([(1, "A!"), (2, "B!"), (3, "C!")], "row_id long, rewritten string")
    allr = dict(sb.overlay_rewrites(df, rw).select("row_id", "description").collect())
    assert allr == {1: "A!", 2: "B!", 3: "c"}
    one = dict(sb.overlay_rewrites(df, rw, only_type=2).select("row_id", "description").collect())
    assert one == {1: "a", 2: "B!", 3: "c"}


def test_filter_subset_observed_count(spark):
    from pyspark.sql import Observation
    # own session: an observation registered on a session later breaks the serialisation of
    # Spark ML training closures in that session (Spark 4.1), so keep the shared one clean
    spark = spark.newSession()
    df = _table(spark, [(1, "a", 0, None), (2, "b", 1, 2), (3, "c", 1, 1), (4, "d", 0, None)])
    obs = Observation("subset")
    out = sb.filter_subset(df, condition=F.col("row_id") > 1, query="ambiguity_type is null or ambiguity_type <> 2",
                           observation=obs)
    assert sorted(r.row_id for r in out.collect()) == [3, 4]
    assert obs.get["rows"] == 2
