import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from twinlens.operators import bootstrap as B
from twinlens.operators import metrics as M
from twinlens.operators import resample as R
from twinlens.operators.ranking import exact_quantiles, number_rows, ordered_scan


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    if not pos or not neg:
        return math.nan
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    rows = [("ties", rng.choice([0.1, 0.2, 0.2, 0.5, 0.9]), rng.randint(0, 1)) for _ in range(400)]
    rows += [("fine", rng.random(), rng.randint(0, 1)) for _ in range(700)] + [("one", rng.random(), 1) for _ in range(20)]
    got = {r["g"]: r["auroc"] for r in M.auroc(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", ["g"]).collect()}
    for g in ("ties", "fine"):
        part = [r for r in rows if r[0] == g]
        assert got[g] == pytest.approx(brute_auc([r[1] for r in part], [r[2] for r in part]), abs=1e-12)
    assert math.isnan(got["one"])


def test_auroc_weights_equal_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.randint(0, 1), rng.randint(1, 4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s double, y int, m int")
    flat = [(s, y) for s, y, m in rows for _ in range(m)]
    got = M.auroc(df, "s", "y", weight="m").first()["auroc"]
    assert got == pytest.approx(brute_auc([s for s, _ in flat], [y for _, y in flat]), abs=1e-12)


def test_macro_f1_covers_labels_of_both_sides(spark):
    # 2 is predicted but never true, 1 is true but never predicted
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (0, 2)], "y_true int, y_pred int")
    s = M.summary(M.confusion(df)).first()
    assert s["macro_f1"] == pytest.approx((2 * 2 / 6 + 0 + 0) / 3)
    assert s["accuracy"] == 0.5
    report = {r["label"]: r for r in M.class_report(M.confusion(df)).collect()}
    assert report[2]["recall"] == 0 and report[1]["precision"] == 0


@pytest.mark.parametrize(("n", "few"), [(1, 10_000), (2, 10_000), (37, 10_000), (399, 3), (5000, 10_000), (5000, 50), (45_000, 10_000), (45_000, 2)])
def test_exact_quantiles(spark, n, few):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 3)  # with ties
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", float("nan")), ("b", 5.0)], "g string, v double")
    qs = [0.0, 0.025, 0.5, 0.95, 0.975, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, "v", qs, ["g"], few=few).collect()}
    for q in qs:
        assert got["a", q] == pytest.approx(np.quantile(values, q), abs=1e-9)
        assert got["b", q] == 5.0


def test_brackets_that_miss_are_opened(spark):
    """With a sketch of low accuracy the first brackets miss their ranks."""
    values = np.concatenate([np.arange(3000) ** 2.0, np.full(2000, 7.0), [1e300, -1e300]])
    df = spark.createDataFrame([(None, float(v)) for v in values], "g string, v double").repartition(5)
    for accuracy in (20, 100):
        got = {r["q"]: r["value"] for r in exact_quantiles(df, "v", [0.0, 0.3, 0.41, 0.9, 1.0], ["g"], accuracy, 10).collect()}
        assert got == {q: pytest.approx(np.quantile(values, q)) for q in got} and len(got) == 5


def test_ordered_scan_against_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", None, "b"][int(rng.integers(3)) if i % 3 else 0], int(rng.integers(50)), int(rng.integers(9)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, w int, i int").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that groups go over several tasks
    try:
        out = ordered_scan(df, ["g"], [F.col("v").desc(), "i"], {"s": F.col("w"), "c": F.lit(1)}, {"top": F.col("w")}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(out) == 600
    for g in ("a", None, "b"):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: (-r["v"], r["i"]))
        w = [r["w"] for r in mine]
        assert [r["c"] for r in mine] == list(range(len(mine))) and {r["c_all"] for r in mine} == {len(mine)} and {r["s_all"] for r in mine} == {sum(w)}
        assert [r["s"] for r in mine] == [sum(w[:k]) for k in range(len(w))] and [r["top"] for r in mine] == [max(w[:k], default=None) for k in range(len(w))]


def test_number_rows_is_dense_and_contiguous(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") % 3 == 0, "x").otherwise(F.when(F.col("id") % 7 == 0, "y").otherwise("z")))
    rows = number_rows(df, "id", ["c"]).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(3000))
    order = [r["c"] for r in sorted(rows, key=lambda r: r["row_id"])]
    assert order == sorted(order)
    again = {r["id"]: r["row_id"] for r in number_rows(df.repartition(7), "id", ["c"]).collect()}
    assert again == {r["id"]: r["row_id"] for r in rows}


def predictions(spark, n=60, classes=2, parts=1):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        p = rng.dirichlet(np.ones(classes))
        rows.append((i, int(rng.integers(classes)), int(p.argmax()), [float(x) for x in p]))
    return spark.createDataFrame(rows, "sample_id long, y_true int, y_pred int, probs array<double>").repartition(parts), rows


def brute_draws(n, samples, seed=2026):
    """Row counts of the replicates, by a walk down the tree that splits with plain sums of probabilities."""

    def mix(h):
        h ^= h >> 16
        h = h * 2246822507 % 2**32
        h ^= h >> 13
        h = h * 3266489909 % 2**32
        return h ^ h >> 16

    def uniform(replicate, lo, hi):
        out = []
        for h in (1, 2):
            for word in (seed, lo, 0, hi, 0, replicate):
                h = mix((h * 31 + word) % 2**32)
            out.append(h)
        return (out[0] * 2**21 + (out[1] >> 11) + 0.5) / 2**53

    def walk(replicate, lo, hi, m):
        if hi - lo == 1:
            return [m]
        a, u, k, total = (hi - lo) // 2, uniform(replicate, lo, hi), 0, 0.0
        p = a / (hi - lo)
        while k < m:
            total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
            if total >= u:
                break
            k += 1
        return walk(replicate, lo, lo + a, k) + walk(replicate, lo + a, hi, m - k)

    return np.array([walk(b, 0, n, n) for b in range(samples)])


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_draws_are_the_splits_of_a_tree(spark, n):
    want = brute_draws(n, 20)
    assert (R.row_counts(n, np.arange(n), np.arange(20), 2026) == want).all()
    got = np.zeros((20, n), int)
    for r in R.bootstrap_draws(spark, n, 20, block=16).collect():
        got[r["replicate"], r["row_id"]] = r["n"]
    assert (got == want).all()


def test_draws_of_many_rows_are_those_of_independent_draws():
    """Ranges and rows agree, and means and variances are those of n draws with replacement, also for a billion rows."""
    count = R.row_counts(500, np.arange(500), np.arange(400), 7)
    assert (count.sum(1) == 500).all() and count.var() == pytest.approx(1, abs=0.02)
    ends = np.array([0, 100, 101, 350, 500])
    assert (np.diff(R.drawn_below(500, ends, np.arange(400), 7), axis=1) == np.add.reduceat(count, ends[:-1], axis=1)).all()
    n = 10**9
    part = np.diff(R.drawn_below(n, np.array([0, 3 * 10**8, n]), np.arange(300), 1), axis=1)[:, 0]
    assert part.mean() == pytest.approx(0.3 * n, rel=1e-4) and part.std() == pytest.approx(math.sqrt(n * 0.21), rel=0.15)


def test_binary_bootstrap_against_brute_force(spark):
    df, rows = predictions(spark)
    draws = 40
    ids = {r["sample_id"]: r["row_id"] for r in B.numbered(df, "sample_id", ["y_true", "y_pred"]).collect()}
    ranked = sorted(rows, key=lambda r: ids[r[0]])
    assert [r[1:3] for r in ranked] == sorted(r[1:3] for r in rows)
    drawn = [[r for r, k in zip(ranked, counts) for _ in range(k)] for counts in brute_draws(len(rows), draws)]
    acc = [np.mean([r[1] == r[2] for r in d]) for d in drawn]
    auc = [brute_auc([r[3][1] for r in d], [r[1] for r in d]) for d in drawn]
    got = {r["metric"]: r for r in B.metric_intervals(df, "sample_id", draws).collect()}
    assert got["accuracy"]["ci_low"] == pytest.approx(np.quantile(acc, 0.025))
    assert got["auroc"]["ci_low"] == pytest.approx(np.nanquantile(auc, 0.025))
    assert got["auroc"]["ci_high"] == pytest.approx(np.nanquantile(auc, 0.975))
    assert got["auroc"]["estimate"] == pytest.approx(brute_auc([r[3][1] for r in rows], [r[1] for r in rows]))


def test_many_tables_in_one_run_are_as_each_alone(spark, monkeypatch):
    """Groups of different sizes, one with a null name, a hot score over several ranges, and cells in several blocks."""
    monkeypatch.setattr(R, "CELLS", 2)
    tables = {}
    for name, n, parts in (("a", 40, 1), ("b", 7, 2), (None, 25, 3)):
        df, _ = predictions(spark, n=n, classes=3, parts=parts)
        tables[name] = df.withColumn("probs", F.when(F.col("sample_id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))).otherwise(F.col("probs")))
    every = None
    for name, df in tables.items():
        one = df.select(F.lit(name).cast("string").alias("method"), "*")
        every = one if every is None else every.unionByName(one)
    got = {}
    for r in B.metric_intervals(every, "sample_id", 30, groups=["method"]).collect():
        got[r["method"], r["metric"]] = tuple(r)[2:]
    for name, df in tables.items():
        for r in B.metric_intervals(df, "sample_id", 30).collect():
            assert got.pop((name, r["metric"])) == pytest.approx(tuple(r)[1:], nan_ok=True)
    assert not got


@pytest.mark.parametrize("counts", [1 << 26, 1])
def test_auroc_of_draws_against_brute_force(spark, monkeypatch, counts):
    """Groups that share their draws, ties longer than a run of rows, a label without a positive row; the second way is by ranges of the score."""
    monkeypatch.setattr(R, "COUNTS", counts)
    monkeypatch.setattr(R, "REPLICATES", (2, 8))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rng = np.random.default_rng(3)
        n, rows, want = 90, [], {}
        for g in ("a", "b", None):
            score = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 2))
            positive = (rng.random(n) < 0.3).astype(int) * (g != "b")
            rows += [(g, i, n, float(score[i]), int(positive[i])) for i in range(n)]
            for k, count in enumerate(R.row_counts(n, np.arange(n), np.arange(20), 2026)):
                want[g, k] = brute_auc(np.repeat(score, count), np.repeat(positive, count))
        df = spark.createDataFrame(rows, "g string, row_id long, size long, score double, positive int").repartition(4)
        got = {(r["g"], r["replicate"]): r["auroc"] for r in R.auroc_draws(df, 20, groups=["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-12, nan_ok=True) for k, v in want.items())


def test_long_runs_of_one_score():
    rng = np.random.default_rng(4)
    n = 3000
    score = np.sort(np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 3)))
    positive, counts = rng.random(n) < 0.2, R.counts_of(n, np.arange(6), 1)
    wins = R._Wins(counts, 0, [])
    for at in range(0, n, 700):
        x = score[at : at + 700]
        wins.add(np.arange(at, at + len(x), dtype=np.int32), positive[at : at + 700], np.append(True, x[1:] != x[:-1]), x[0], x[-1])
    for k, got in enumerate(wins.result(["replicate", "auroc"]).column(1).to_pylist()):
        each = np.repeat(np.arange(n), counts[:, k])
        p, m = score[each[positive[each]]], np.sort(score[each[~positive[each]]])
        assert got == pytest.approx((np.searchsorted(m, p) + np.searchsorted(m, p, "right")).sum() / 2 / len(p) / len(m), abs=1e-13)


def test_few_cells_are_many_tasks(spark):
    """All replicates of a block of cells are long work, however few bytes its rows have."""
    df, _ = predictions(spark)
    draws = R.cell_draws(df, ["y_true", "y_pred"], 2000)
    task = draws.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("replicate").alias("n"))
    assert max(r["n"] for r in task.collect()) < 2000


def test_quantiles_of_unlike_nodes():
    m, a, s = np.array([0, 5, 5, 40, 3, 100_000]), np.array([1, 1, 2, 7, 1, 3]), np.array([2, 2, 3, 15, 2, 7])
    u = np.array([0.4, 0.99, 0.2, 0.5, 1e-9, 0.731])
    for got, n, p, x in zip(R.binomial_quantiles(m, a, s, u), m.tolist(), a / s, u, strict=True):
        below = np.cumsum([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(n + 1)])
        assert got == min(n, int(np.searchsorted(below, x)))


def test_number_of_cases_is_checked(spark):
    df, _ = predictions(spark, classes=3)
    cases = df.select(F.lit("x").alias("dataset"), (F.col("sample_id") % 2).alias("model"), "y_true", "y_pred")
    with pytest.raises(B.CaseCountError):
        B.answer_intervals(cases, 5, groups=["dataset", "model"], expected=8)
    for options in ({"expected": 8, "partial": True}, {"expected": 2}, {}):
        assert B.answer_intervals(cases, 5, groups=["dataset", "model"], **options).count() == 4


def test_comparisons_want_equal_labels_and_single_rows(spark):
    df, _ = predictions(spark, n=30, classes=3)
    tag = lambda d, m, frame: frame.select(F.lit(d).alias("dataset"), F.lit("b").alias("backbone"), F.lit(m).alias("method"), "*")
    other = df.withColumn("y_pred", (F.col("y_pred") + 1) % 3)
    runs = tag("d", "mlp_late", df).unionByName(tag("d", "gated_attention", other)).unionByName(tag("e", "mcr_late", df)).unionByName(tag("e", "mlp_late", df.where("sample_id > 3")))
    out = {(r["dataset"], r["metric"]): r for r in B.compare_runs(runs, 10).collect()}
    assert len(out) == 6 and out["d", "accuracy"]["comparison"] == "gated_attention - mlp_late"
    assert out["e", "accuracy"]["ci_low"] == out["e", "accuracy"]["ci_high"] == 0.0
    with pytest.raises(Exception, match="labels"):
        B.compare_runs(runs.withColumn("y_true", F.when(F.col("method") == "mlp_late", 0).otherwise(F.col("y_true"))), 10)
    with pytest.raises(Exception):  # noqa: B017
        B.compare_runs(runs.unionByName(tag("d", "mlp_late", df.limit(1))), 10)
    with pytest.raises(ValueError, match="both methods"):
        B.compare_runs(tag("d", "linear", df), 10)


def test_draws_do_not_depend_on_partitions(spark):
    one, _ = predictions(spark, classes=3)
    many, _ = predictions(spark, classes=3, parts=7)
    a = B.metric_intervals(one, "sample_id", 20).orderBy("metric").collect()
    b = B.metric_intervals(many, "sample_id", 20).orderBy("metric").collect()
    for x, y in zip(a, b):
        assert x["metric"] == y["metric"] and tuple(x)[1:] == pytest.approx(tuple(y)[1:])


def test_nan_replicates_are_dropped(spark):
    df = spark.createDataFrame([(float("nan"),), (0.2,), (0.4,)], "auroc double")
    r = B.interval(df, ["auroc"]).first()
    assert r["ci_low"] == pytest.approx(0.205) and r["ci_high"] == pytest.approx(0.395)


def test_pairs_of_equal_methods_have_no_difference(spark):
    df, _ = predictions(spark, classes=3)
    from twinlens.operators.joins import paired_predictions

    for r in B.paired_differences(paired_predictions(df, df), 15).collect():
        assert r["difference"] == r["ci_low"] == r["ci_high"] == 0.0
