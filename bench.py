"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line {"metric", "value", "unit", "queries", "sf", ...}.  Like a pipeline,
the cleaned sentence table and the prediction table (F4: every order x 6 labels) are landed
once as Parquet (timed as ``prepare_dedupe`` and ``pred_big_write``); every other query
reads them and runs to completion into the ``noop`` sink (every row computed, nothing
collected).  The value is the sum of the per-query wall times after one warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelbench.config import ExperimentConfig  # noqa: E402
from labelbench.operators import encode, history, metrics, roc  # noqa: E402
from labelbench.plans import experiment as ex  # noqa: E402
from labelbench.plans import registry as R  # noqa: E402
from labelbench.session import get_session, shared_path  # noqa: E402
from labelbench.sources import fixtures as fx  # noqa: E402


def _queries(prep, pb):
    """prep: landed cleaned sentences; pb: landed predictions (row_id, cells of label, y, p)."""
    thr = ExperimentConfig().threshold
    return {
        # seven tagged subsets and their exact seeded split
        "subset_split": lambda s, d: ex.sp.split_exact(ex.sb.prepare_baseline(ex.sb.subset_suite(prep().drop("description"))), 0.15, 42,
                                                       by=["experiment"]),
        # evaluation over F4
        "classification_report": lambda s, d: metrics.classification_report(pb(), thr),
        "exact_match": lambda s, d: metrics.exact_match(pb(), thr),
        "hamming_loss": lambda s, d: metrics.hamming_loss(pb(), thr),
        "binary_report": lambda s, d: metrics.binary_report(pb(), thr),
        "label_lists": lambda s, d: metrics.label_lists(pb(), thr),
        "roc_auc_all": lambda s, d: roc.roc_summary(metrics.to_long(pb())),
        "roc_macro_curve": lambda s, d: roc.roc_macro_curve(metrics.to_long(pb())),
        # losses
        "best_epoch": lambda s, d: history.best_epoch(fx.history(s, d)),
        "bce_batch_mean": lambda s, d: history.bce_batch_mean(metrics.to_long(pb()).withColumn("x", (fx.F.col("p") - 0.2) * 10)),
        # encoding job over whole texts
        "vocab_encode": lambda s, d: (lambda t: encode.encode_tokens(t, encode.build_vocab(t)))(encode.tokenised(prep())),
        # evaluation half of the experiment suite (hash scorer), summary per experiment
        "experiment_summary": lambda s, d: ex.run_suite(prep(), ExperimentConfig(), export=False,
                                                        scorer=fx.hash_scorer).summary,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = get_session(f"local[{cpus}]", app_name="labelbench-bench", shuffle_partitions=int(cpus) * 2)
    # warm-up (JVM, codegen, file listing)
    R.prepared(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    prep_path, pb_path = shared_path(spark, "bench", "prepared", unique=True), shared_path(spark, "bench", "pred", unique=True)
    t0 = time.time()
    R.prepared(spark, sf_dir).write.mode("overwrite").parquet(prep_path)
    times["prepare_dedupe"] = round(time.time() - t0, 3)
    t0 = time.time()
    fx.pred_big_wide(spark, sf_dir).write.mode("overwrite").parquet(pb_path)
    times["pred_big_write"] = round(time.time() - t0, 3)
    qs = _queries(lambda: spark.read.parquet(prep_path), lambda: spark.read.parquet(pb_path))
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
