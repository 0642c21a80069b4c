"""Golden edge rows for text normalisation, names and casts (FIXTURES F7)."""
import pytest
from pyspark.sql import functions as F

from labelbench.functions import casts, text as tx

TEXTS = ["\t a..\n", "foo ...", "x.\n", "\xa0a ", "  b  c\xa0", "", "...", None, None]


def _py_title(s):
    return s.title()


def test_strip_dots_collapse_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", tx.strip_ws("t").alias("s"), tx.normalize_description("t").alias("n"),
                     tx.collapse_ws("t").alias("c")).orderBy("i").collect()
    for r in rows:
        t = TEXTS[r.i]
        if t is None:
            assert r.s is None and r.n is None and r.c is None
            continue
        assert r.s == t.strip()
        assert r.n == t.strip().rstrip(".")
        assert r.c == " ".join(t.split())
    # a space before removed dots stays ("foo ..." -> "foo ")
    assert rows[1].n == "foo "


@pytest.mark.parametrize("name,expected", [("  a/b  ", "a_b"), ("..x..", "x"), ("***", "experiment"), ("no_lexical_ambiguity", "no_lexical_ambiguity"), ("Exp 1 (final)!", "Exp_1_final")])
def test_sanitize_name(spark, name, expected):
    got = spark.range(1).select(tx.sanitize_name(F.lit(name)).alias("s")).first().s
    assert got == expected


@pytest.mark.parametrize("key,expected", [("baseline", "Benchmark all"), ("no_ambiguity", "No ambiguity"), ("my_new_subset", "My New Subset"),
                                          ("src0_set", "Src0 Set"), ("a1b_c2d", "A1B C2D")])
def test_display_names(spark, key, expected):
    got = spark.range(1).select(tx.experiment_display_name(F.lit(key)).alias("d")).first().d
    assert got == expected


LENIENT = [("1", 1), (" 1 ", 1), ("1.0", 1), ("1.0d", 0), ("1f", 0), ("x", 0), ("", 0), (None, 0), ("-2.7", -2),
           ("1e2", 100), (".5", 0), ("1e10", 10_000_000_000), ("1e30", 0)]


def test_lenient_int(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(LENIENT)], "i int, v string")
    got = dict(df.select("i", casts.lenient_int("v").alias("o")).collect())
    assert [got[i] for i in range(len(LENIENT))] == [e for _, e in LENIENT]


def test_strict_int_raises_on_null_and_malformed(spark):
    ok = spark.createDataFrame([("1",), ("0",), ("1.0",)], "v string")
    assert [r.o for r in ok.select(casts.strict_int("v").alias("o")).collect()] == [1, 0, 1]
    for bad in [None, "x"]:
        df = spark.createDataFrame([(bad,)], "v string")
        with pytest.raises(Exception):
            df.select(casts.strict_int("v").alias("o")).collect()


def test_na_tokens_to_null(spark):
    from labelbench.constants import NA_TOKENS
    df = spark.createDataFrame([(t,) for t in NA_TOKENS + ["ok", " NA"]], "v string")
    out = [r.o for r in df.select(casts.na_to_null("v").alias("o")).collect()]
    assert out[: len(NA_TOKENS)] == [None] * len(NA_TOKENS)
    assert out[-2:] == ["ok", " NA"]


def test_feature_width_follows_the_vocabulary(spark):
    from labelbench.operators import train as tr

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), (F.col("id") * 200 + i).cast("string"))), " ")
    df = spark.range(4000).select(words.alias("description"))
    assert tr.feature_width(df) == 1 << 21


def test_safe_name_replaces_once(spark):
    """The replacement over the whole text stands once in the plan, and an empty name is found without it."""
    texts = ["", " ", "._-", "__a__", "é", "é1", " \n.Z.\n", None, "-_ 9", "ß x ", "a" * 5000 + " "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.sanitize_name("t").alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    want = ["experiment", "experiment", "experiment", "a", "experiment", "1", "Z", None, "9", "x", "a" * 5000]
    assert [r.n for r in df.orderBy("i").collect()] == want
