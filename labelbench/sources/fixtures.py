"""Test inputs derived from the driver tables (FIXTURES.md F0-F6) as Spark plans.

Every fixture is a plain projection / join of the given tables, so its size grows with
them.  ``hex8`` is an unsigned 32-bit number taken from an md5 of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS
from ..operators.metrics import to_long
from .tables import read_table

# cut-offs of the synthetic labels (out of 10), in label order
LABEL_CUTOFFS = {
    "compute": 3,
    "data_handling": 2,
    "network": 2,
    "security_compliance": 4,
    "management_monitoring": 1,
    "cloud_service_essentials": 3,
}


def hex8(x: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(x), start, 8), 16, 10).cast("bigint")


def _label_value(row_id: Column, label: str) -> Column:
    h = hex8(F.concat(row_id.cast("string"), F.lit(":"), F.lit(label)), 1)
    return F.when(h % 10 < LABEL_CUTOFFS[label], 1).otherwise(0)


def _score(row_id: Column, label: str, y: Column) -> Column:
    h = hex8(F.concat(row_id.cast("string"), F.lit(":"), F.lit(label)), 9)
    return ((h % 700) + 300 * y).cast("double") / 1000


def req(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per sentence with labels, ambiguity annotation and dirty copies."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # one scan: every document once, plus a case/whitespace/dots variant of every 10th and
    # a ' ..' variant (must stay distinct) of the next one
    variants = F.array(
        F.struct(F.col("doc_id").alias("row_id"), F.col("text").alias("t")),
        F.when(F.col("doc_id") % 10 == 0, F.struct(
            (F.col("doc_id") + 1000000).alias("row_id"),
            F.concat(F.lit("\t  "), F.replace(F.col("text"), F.lit("the"), F.lit("THE")),
                     F.lit("..\n")).alias("t"))),
        F.when(F.col("doc_id") % 10 == 1, F.struct(
            (F.col("doc_id") + 2000000).alias("row_id"),
            F.concat(F.col("text"), F.lit(" ..")).alias("t"))),
    )
    raw = docs.select(F.col("doc_id").alias("base_id"), F.col("source"),
                      F.explode(F.filter(variants, lambda v: v.isNotNull())).alias("v")) \
        .select(F.col("v.row_id").alias("row_id"), "base_id", F.col("v.t").alias("description"), "source")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("base_id"), "toxic")
    y = raw.join(labels, "base_id", "left")
    rid = F.col("row_id")
    cols = [rid, F.col("description"), F.col("source"),
            F.col("toxic").cast("int").alias("ambuiguity"),
            F.when(F.col("toxic") == 1, (1 + F.col("base_id") % 5).cast("int")).alias("ambiguity_type"),
            F.lit(None).cast("string").alias("comments")]
    cols += [_label_value(rid, lab).alias(lab) for lab in LABELS]
    out = y.select(*cols)
    any_label = sum((F.col(lab) for lab in LABELS[1:]), F.col(LABELS[0])) > 0
    goal = (F.when(rid % 37 == 0, F.lit("n/a")).when(rid % 41 == 0, F.lit(None).cast("string"))
            .when(any_label, F.lit("1")).otherwise(F.lit("0")))
    return out.withColumn("goal", goal)


def _scored(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with labels -> wide predictions (keys, row_id, cells of label, y, p)."""
    cells = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(lab).cast("int").alias("y"),
                               _score(F.col("row_id"), lab, F.col(lab)).alias("p")) for lab in LABELS])
    return df.select(*keys, "row_id", cells.alias("cells"))


def pred_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 with all cells of a sentence in one row, as a model scores it."""
    return _scored(req(spark, sf_dir).filter(F.col("ambuiguity").isNotNull()))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions over the annotated sentences, one row per cell."""
    return to_long(pred_wide(spark, sf_dir))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logits whose sigmoid crosses 0.5 where p crosses 0.2."""
    return pred(spark, sf_dir).select("row_id", "label", "y",
                                      ((F.col("p") - F.lit(0.2).cast("double")) * 10).alias("x"))


def pred_big_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions over every order (performance input), all cells of an order in one row."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    wide = o.select("row_id", *[_label_value(F.col("row_id"), lab).alias(lab) for lab in LABELS])
    return _scored(wide)


def pred_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, one row per cell."""
    return to_long(pred_big_wide(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss histories, one experiment per order, one epoch per line number (<= 7).

    Losses are the smallest tax / discount of the line, so ties are frequent.
    """
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_orderkey", "l_linenumber")
            .agg(F.min("l_tax").alias("train_loss"), F.min("l_discount").alias("valid_loss"))
            .select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("experiment"),
                    F.col("l_linenumber").cast("int").alias("epoch"), "train_loss", "valid_loss"))


def rewrites(spark: SparkSession, sf_dir: str, req_df: DataFrame | None = None) -> DataFrame:
    """rewritten texts for every second ambiguous sentence."""
    r = req_df if req_df is not None else req(spark, sf_dir)
    return (r.filter((F.col("ambuiguity") == 1) & (F.col("row_id") % 2 == 0))
            .select("row_id", F.concat(F.lit("rewritten "), F.col("row_id").cast("string")).alias("rewritten")))


def raw_strings(req_df: DataFrame) -> DataFrame:
    """the raw, all-text shape of the main table as it lands in a CSV file."""
    return req_df.select(*[F.col(c).cast("string").alias(c) for c in req_df.columns])


def hash_scorer(split_df: DataFrame, key: str = "experiment") -> DataFrame:
    """Deterministic stand-in for a model: F2's scores on every validation row, keyed by
    experiment.  Lets the evaluation half of an experiment be checked against SQL."""
    return _scored(split_df.filter(F.col("split") == "valid"), key)
