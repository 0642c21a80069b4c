"""Hot groups, very long rows and many ranges: what must hold when one key has most of the rows."""
from collections import defaultdict
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelbench.llm import chat, lm, mixing, quality, rules, sharding, simhash, substring
from labelbench.llm import sql as S
from labelbench.llm import words
from labelbench.session import land
from tests.conftest import SF_SMALL

from . import brute


def test_pages_mix_sizes(spark):
    rows = [(7, "t" * (1 + k % 500)) for k in range(5000)]
    limit, total = 100_000, sum(len(t) for _, t in rows)
    pages = defaultdict(int)
    for r in sharding.assign_shards(land(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "sizes"), limit_bytes=limit).collect():
        pages[r.page] += r.n_bytes
    assert sum(pages.values()) == total and max(pages.values()) <= limit and len(pages) == -(-total // limit)


def test_pages_of_large_small_and_empty_rows(spark):
    sizes = [900, 0, 501, 30, 500, 0, 1500, 499, 1000, 2, 0, 998] * 20
    rows = land(spark.createDataFrame([(None, "t" * n) for n in sizes], "doc_id long, text string").repartition(3), "sizes")
    pages = defaultdict(list)
    for r in sharding.assign_shards(rows, limit_bytes=1000).collect():
        pages[r.page].append(r.n_bytes)
    assert sorted(n for p in pages.values() for n in p) == sorted(sizes) and sorted(pages) == list(range(len(pages)))
    assert all(sum(p) <= 1000 or p == [1500] for p in pages.values()) and len(pages) <= 2 * sum(sizes) / 1000 + 1


def test_chat_of_many_turns(spark):
    said = ["plain", "<turn user>\n\\", "", "🜁é" * 900, "x" * 5000]
    turns = [(1, k, ("user", "assistant")[k % 2], said[(k * 7 // 3) % 5] + str(k)) for k in range(3000)] + [(2, 0, "assistant", "y" * chat.BLOCK), (2, 1, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in (1, 2):
        r, at, spans = got[conv], 0, []
        for s in r.segments:
            if s.loss:
                spans.append((at, len(s.text)))
            at += len(s.text)
        assert [tuple(s) for s in r.loss_spans] == spans and at == len(r.formatted)
        assert r.loss == "".join(t for c, _, role, t in turns if c == conv and role == "assistant")


def test_running_sums_over_steps(spark):
    for n in (0, 1, chat.STEP - 1, chat.STEP, chat.STEP + 1, 5 * chat.STEP + 3):
        x = [(k * 37) % 101 for k in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(chat.starts(F.col("x"))).first()[0]
        assert got == list(np.cumsum([0, *x])[:-1])


def test_mixing_with_hot_and_null_ids(spark):
    rows = [(None, f"s{k % 4}", "w " * (k % 9)) for k in range(700)] + [(5, "s1", "v " * (k % 3)) for k in range(600)] + [(k, f"s{k % 3}", "u " * (k % 17)) for k in range(900)]
    rows += [(None, None, None)] * 5
    table = land(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6), "hot")
    out = mixing.mix_plan(table)
    con = duckdb.connect()
    con.register("documents", table.toPandas().astype({"doc_id": "Int64"}))
    cur = con.execute(S.MIX)
    names = [d[0] for d in cur.description]

    def norm(rows):
        return sorted(tuple((x is None, 0 if x is None else round(float(x), 6)) for x in r) for r in rows)

    assert norm(out.select(*names).collect()) == norm(cur.fetchall())
    assert norm(mixing.mix_plan(table.repartition(2)).select(*names).collect()) == norm(out.select(*names).collect())


def test_language_model_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_BYTES", 400)
    monkeypatch.setattr(lm, "FAN", 2)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) % 300) for _ in range(60)]
    table = land(spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, `a b` double"), "ranges")
    model = lm.train(table)
    assert len(model.pair_sizes) > 8
    got = {r.doc_id: r for r in lm.score(table, model, carry=("a b",)).collect()}
    for k, want in enumerate(brute.kneser_ney(texts, texts)):
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == want[:3] and np.allclose((got[k].base_score, got[k].score), want[3:])


def test_golay_keys_cover_every_spread_of_three_bits():
    """A pair meets under some choice of segments wherever its three bits or fewer lie."""
    rng = np.random.default_rng(9)
    keys = lambda fps, left: [set(zip(*(c.to_pylist() for c in b.columns))) for b in simhash._keys(left)([pa.record_batch([pa.array(fps)], names=["fp"])])][0]
    sides = [s for n in range(4) for s in combinations_with_replacement(range(4), n)]
    for segments in sides:
        for base in rng.integers(-2**63, 2**63, 30, dtype=np.int64):
            other = base.view(np.uint64)
            for bit in {16 * s + int(b) for s, b in zip(segments, rng.choice(16, 3, replace=False))}:
                other = other ^ np.uint64(1 << bit)
            pair = np.array([base, other.view(np.int64)])
            for a, b in (pair, pair[::-1]):
                assert {k for k, _ in keys(np.array([a]), True)} & {k for k, _ in keys(np.array([b]), False)}


def test_golay_candidates_stay_few(spark):
    """Unrelated fingerprints hardly ever meet."""
    fps = land(spark.range(60_000).select(F.xxhash64("id").alias("fp")), "random-fps")
    left, right = (fps.mapInArrow(simhash._keys(side), "key long, fp long") for side in (True, False))
    met = left.join(right.withColumnRenamed("fp", "other"), "key").filter("fp < other").count()
    assert met < 60_000 * 0.01 and left.count() < 45 * 60_000


def test_carried_names_are_quoted(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y")], "doc_id long, text string, `a b` string")
    assert sorted((r["a b"], r.component_id) for r in simhash.simhash_groups(df, carry=("a b",)).collect()) == [("x", 1), ("y", 1)]


def bucket_bytes(rows, n_buckets, hot):
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "row_no": list(range(len(rows))), "block": [0] * len(rows)})
    sent, out = substring._cutter(n_buckets, b"", hot)(table), defaultdict(int)
    for bucket, blob in zip(sent["bucket"].to_pylist(), sent["blob"].to_pylist(), strict=True):
        out[bucket] += len(substring._unpack(b"", blob, np.int64, np.int64, np.int32, np.uint8)[3])
    return out


def test_substring_splits_a_hot_minimiser(spark, monkeypatch):
    """One run of four words that most windows share does not make one bucket."""
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(4000)]
    # the run of smallest hash among many, so that it is the minimiser of nearly every window that holds it
    runs = [[f"a{k}", "common", "little", "phrase"] for k in range(3000)]
    data = np.frombuffer(" ".join(" ".join(r) for r in runs).encode() + b" ", np.uint8)
    end = np.flatnonzero(data == 32)
    h = words.hash_spans(data, np.concatenate([[0], end[:-1] + 1]), end)
    phrase = runs[int(np.argmin(substring.run_hashes(h, np.arange(0, len(h), 4), 4)))]
    rows = []
    for k in range(400):
        text = [w for _ in range(12) for w in [*(names[int(i)] for i in rng.integers(0, 4000, 9)), *phrase]]
        rows.append((k, " ".join(text)))
    rows += [(400 + k, rows[k][1]) for k in range(0, 60, 2)]
    monkeypatch.setattr(substring, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(substring, "CELL_BYTES", 30_000)
    table = land(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "hot-run")
    n_buckets = -(-int(sum(len(t) for _, t in rows) * substring.SPREAD) // 60_000)
    hot = substring.hot_cells(table, n_buckets)
    assert len(hot.cells) and hot.parts.sum() > 10
    before, after = bucket_bytes(rows, n_buckets, substring.Hot()), bucket_bytes(rows, n_buckets, hot)
    assert max(before.values()) > 300_000 and max(after.values()) < 90_000
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(table).collect()}
    want = brute.repeats(rows)
    assert got == {i: (w[0], w[1], w[3]) for i, w in want.items()} and sum(w[1] > 0 for w in want.values()) >= 30


def test_substring_all_cells_hot(spark, monkeypatch):
    """Every window on its own gives the same result."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(substring, "CELL_BYTES", 100)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 200_000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs).collect()}
    assert got == {i: (w[0], w[1], w[3]) for i, w in brute.repeats([(r.doc_id, r.text) for r in docs.collect()]).items()}


def test_very_long_texts(spark):
    """A text of 200,000 words, with a passage of a short one, is counted, cut, hashed and scored whole."""
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{k}" for k in range(40))
    body = [f"w{int(k)}" for k in rng.integers(0, 30_000, 200_000)]
    body[150_000:150_000] = passage.split(" ")
    text = "\n".join(" ".join(body[k:k + 20]) + "." for k in range(0, len(body), 20))
    rows = [(1, "head " + passage + " tail"), (2, text), (3, None)]
    table = land(spark.createDataFrame(rows, "doc_id long, text string"), "very-long")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(table).collect()}
    want = brute.repeats(rows)
    assert got == {i: (w[0], w[1], w[3]) for i, w in want.items()} and want[2][1] >= 26 and want[2][0] == 200_040
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.simhash_groups(table).collect()} == {i: brute.fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.n_words for r in rules.clean_lines(table).collect()} == {1: 42, 2: 200_040, 3: 0}
    assert {r.doc_id: r.n_tokens for r in lm.score(table, lm.train(table)).collect()} == {1: 43, 2: 200_041, 3: 1}
    model = quality.train(table, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert {r.doc_id: (r.n_passages, 0 <= r.score <= 1) for r in quality.score(table, model).collect()} == {1: (1, True), 2: (3126, True), 3: (1, True)}


def test_only_short_texts(spark):
    """A block without any window, and a range without pairs of some count."""
    rows = [(1, "one two three"), (2, "one two three"), (3, ""), (4, None)]
    table = land(spark.createDataFrame(rows, "doc_id long, text string"), "short")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(table).collect()} == {
        1: (3, 0, "one two three"), 2: (3, 0, "one two three"), 3: (0, 0, ""), 4: (0, 0, "")}
    for own in (table, table.filter("doc_id = 1"), table.filter("doc_id = 4")):
        own = land(own, "short-own")
        assert {r.doc_id: r.n_tokens for r in lm.score(own, lm.train(own)).collect()} == {r.doc_id: 1 + len(brute.words(r.text)) for r in own.collect()}


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_golay_keys_are_never_broadcast(spark):
    """A side has 42 rows to a fingerprint, but Spark sizes it as one: however small that is, both sides are exchanged."""
    rng = np.random.default_rng(5)
    fps = land(spark.createDataFrame([(int(x),) for x in rng.integers(-2**63, 2**63, 300)] + [(1,), (3,)], "fp long"), "fps")
    links = simhash.near_links(fps)
    plan = _final_plan(links)
    assert {(r.a, r.b) for r in links.collect()} == {(1, 3)}
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_mix_cells_are_never_broadcast(spark):
    """There are as many cells as rows: the join with them is an exchange of both sides, however small Spark takes them for."""
    rows = [(i, f"s{i % 2}", "w " * (i % 9)) for i in range(200)]
    plan = _final_plan(mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "Join" in line and "before_cell" not in line and "key_c" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
