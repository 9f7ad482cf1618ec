"""Heads against finite differences, the trainer on separable data, scoring and storage."""

import tracemalloc

import numpy as np
import pytest

from twinlens.plans import classic as K
from twinlens.plans import heads as H
from twinlens.plans import train as TR


def batch(n, y, rng):
    return {"text": rng.normal(size=(n, 5)), "image": rng.normal(size=(n, 4)), "row": rng.integers(-(2**62), 2**62, n), "y": y}


def loss_and_grads(spec, params, data, weights, total, drop, cut=10):
    """The batch in two tasks, as the trainer adds them."""
    n = len(data["text"])
    parts = [{k: v[a:b] for k, v in data.items()} for a, b in ((0, cut), (cut, n))]
    sums, moments = {}, {}
    if spec.branches():
        for d in parts:
            for k, v in H.Pass(spec, params, d, drop=drop).branch_moments().items():
                sums[k] = sums.get(k, 0) + v
        moments = H.batch_moments(spec, sums, n)
    grads, loss = {}, 0.0
    for d in parts:
        one = H.Pass(spec, params, d, moments, drop)
        loss += one.loss_and_grads(n, total, weights)
        for k, v in one.grads.items():
            grads[k] = grads.get(k, 0) + v
    return loss, H.finish_branches(spec, params, grads, moments, n)


@pytest.mark.parametrize("case", [*H.METHODS, "bce", "bce_one"])
def test_gradient_is_the_slope_of_the_loss(case):
    rng = np.random.default_rng(3)
    n = 23
    if case.startswith("bce"):
        c = 3 if case == "bce" else 1
        spec = H.Spec("mlp_late", 5, 4, c, hidden=6, loss="bce")
        data = batch(n, rng.integers(0, 2, (n, c)).astype(float), rng)
        weights, total = (np.arange(1.0, c + 1), np.full(c, 2.5)), 0.0
    else:
        spec = H.Spec(case, 5, 4, 3, hidden=6)
        data = batch(n, rng.integers(0, 3, (n, 1)).astype(float), rng)
        weights = np.array([0.5, 1, 2])
        total = weights[data["y"][:, 0].astype(int)].sum()
    params, _ = spec.start(1)
    params = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in params.items()}
    _, grads = loss_and_grads(spec, params, data, weights, total, (7, 3))
    assert set(grads) == set(params)
    for k in params:
        at = tuple(rng.integers(0, s) for s in params[k].shape)
        ends = []
        for sign in (1, -1):
            moved = dict(params, **{k: params[k].copy()})
            moved[k][at] += sign * 1e-6
            ends.append(loss_and_grads(spec, moved, data, weights, total, (7, 3))[0])
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grads[k][at], abs=1e-6, rel=1e-4)


def test_sums_do_not_depend_on_the_cut():
    rng = np.random.default_rng(4)
    spec = H.Spec("i2moe", 5, 4, 3, hidden=6)
    data = batch(23, rng.integers(0, 3, (23, 1)).astype(float), rng)
    params, _ = spec.start(2)
    a = loss_and_grads(spec, params, data, np.ones(3), 23.0, (1, 1), cut=5)
    b = loss_and_grads(spec, params, data, np.ones(3), 23.0, (1, 1), cut=17)
    assert a[0] == pytest.approx(b[0])
    for k in params:
        np.testing.assert_allclose(a[1][k], b[1][k], atol=1e-12)


def test_parameter_counts():
    # published sizes of the heads for 512 + 512 inputs and two classes
    sizes = {"image_only": 1026, "text_only": 1026, "linear": 2050, "mlp_early": 131714, "mlp_late": 132354, "gated_attention": 165252, "mcr_late": 132870, "i2moe": 661132}
    for method, n in sizes.items():
        assert sum(int(np.prod(s)) for s in H.Spec(method, 512, 512, 2).shapes().values()) == n


def test_dropout_keeps_the_right_share():
    m = H.keep_mask(np.arange(4000), 50, 42, 1, 0, 0.2)
    assert abs((m > 0).mean() - 0.8) < 0.01 and set(np.unique(m)) == {0.0, 1.25}
    other = H.keep_mask(np.arange(4000), 50, 42, 2, 0, 0.2)
    assert abs(((m > 0) == (other > 0)).mean() - 0.68) < 0.01


def blobs(spark, n=240, parts=3):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        y = i % 3
        text, image = rng.normal(size=6) * 0.3, rng.normal(size=5) * 0.3
        text[y] += 2
        image[y] += 2
        rows.append((i, f"c{y}", "test" if i % 5 == 0 else "train", text.tolist(), image.tolist()))
    df = spark.createDataFrame(rows, "id long, label string, split string, text array<double>, image array<double>")
    return TR.Experiment(df.repartition(parts), "id", "label", "text", "image")


@pytest.mark.parametrize("method", ["linear", "mlp_early", "gated_attention", "i2moe"])
def test_training_learns_separable_classes(spark, method):
    e = blobs(spark)
    model, predictions = e.run(TR.Options(method, epochs=12, lr=0.05, hidden=8, patience=12))
    assert model.history[-1]["train_loss"] < model.history[0]["train_loss"]
    m = e.metrics(predictions).first()
    assert m["accuracy"] > 0.9 and m["n_test"] == 48 and m["auc"] > 0.95
    assert ("gates" in predictions.columns) == (method == "gated_attention")


def test_training_does_not_depend_on_partitions(spark):
    a, _ = blobs(spark, parts=1).run(TR.Options("mlp_late", epochs=2, hidden=4))
    b, _ = blobs(spark, parts=7).run(TR.Options("mlp_late", epochs=2, hidden=4))
    for k in a.params:
        np.testing.assert_allclose(a.params[k], b.params[k], atol=1e-9)


def test_early_stopping_and_batches(spark):
    model, _ = blobs(spark).run(TR.Options("linear", epochs=30, lr=0.0, patience=3, batch_size=64))
    assert len(model.history) == 4 and model.epochs_run == 1  # no gain after the first epoch


def test_parameters_survive_storage(spark, tmp_path):
    from twinlens.sources import sinks

    e = blobs(spark)
    model, predictions = e.run(TR.Options("mlp_late", epochs=1, hidden=4))
    sinks.write_params(model.table(spark), str(tmp_path / "p"))
    back = TR.Model.from_table(sinks.read_params(spark, str(tmp_path / "p")), model.spec, model.labels)
    parts, _ = e.encoded()
    a = {r["sample_id"]: r["probs"] for r in predictions.collect()}
    b = {r["sample_id"]: r["probs"] for r in TR.predict(back, parts["test"]).collect()}
    assert a == b


def test_experiment_guards(spark):
    df = blobs(spark).df
    with pytest.raises(ValueError, match="embedding column"):
        TR.Experiment(df, "id", "label", "absent", "image")
    with pytest.raises(ValueError, match="single-label"):
        TR.Experiment(df, "id", "label", "text", "image").run(TR.Options("linear", loss="bce"))
    with pytest.raises(ValueError):
        H.Spec("unknown", 2, 2, 2).shapes()


@pytest.mark.parametrize("pivots, block", [(4, 7), (16, 4096), (1, 50)])
def test_neighbours_against_brute_force(spark, pivots, block):
    rng = np.random.default_rng(11)
    # a third of the training rows sit on one spot
    x = np.vstack([rng.normal(size=(120, 3)), np.tile([[0.5, 0.5, 0.5]], (60, 1))])
    q = rng.normal(size=(25, 3))
    train = spark.createDataFrame([(i, int(i % 4), v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>")
    test = spark.createDataFrame([(1000 + i, 0, v.tolist()) for i, v in enumerate(q)], "id long, label int, v array<double>")
    got = {}
    for r in K.knn_neighbours(train, test, "id", "v", "label", k=5, pivots=pivots, block=block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    d = np.round(np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)), 9)
    for i in range(len(q)):
        want = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:5]
        assert [n for _, n in sorted(got[1000 + i])] == want


def test_neighbours_and_visits_in_bounded_memory():
    rng = np.random.default_rng(13)
    q, x = rng.normal(size=(4096, 4)), np.round(rng.normal(size=(4096, 4)), 1)
    tracemalloc.start()
    place, distance = K._closest(q, x, 5)
    visits, most, seen = 0, 0, 0
    for row, cell in K._open_cells(q[:600], np.zeros(600, int), np.full(600, np.inf), x, np.zeros(4096), np.ones(4096, int)):
        assert len(row) and (cell > 0).all()
        visits, most, seen = visits + len(row), max(most, len(row)), max(seen, row.max())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the whole matrix of distances has 134 MB
    assert peak < 80_000_000 and most * 4 <= K.TOGETHER
    assert (visits, seen) == (600 * 4095, 599)
    for i in range(0, 4096, 97):
        d = np.round(np.sqrt(((q[i] - x) ** 2).sum(1)), 9)
        want = np.lexsort((np.arange(4096), d))[:5]
        assert place[i].tolist() == want.tolist() and distance[i] == pytest.approx(d[want])
    assert [a.shape for a in K._closest(q[:3], x[:2], 5)] == [(3, 2), (3, 2)]


def test_components_against_the_exact_axes(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    train, other = df.filter("id < 60"), df.filter("id >= 60")
    got = {r["id"]: r["components"] for r in K.principal_components(train, other, "v", 2, ["id"]).collect()}
    centre = x[:60].mean(0)
    axes = np.linalg.svd(x[:60] - centre)[2][:2]
    for i in range(60, 80):
        np.testing.assert_allclose(np.abs(got[i]), np.abs((x[i] - centre) @ axes.T), atol=1e-8)


def test_library_models_learn_separable_classes(spark):
    df = blobs(spark).df.selectExpr("id", "int(substring(label, 2, 1)) as y0", "split", "concat(text, image) as v")
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    bench = {r["model"]: r for r in K.model_bench(train, test, "v", "y0", "id", trees=5, max_iter=10).collect()}
    assert set(bench) == set(K.BENCH_MODELS) and all(r["accuracy"] > 0.9 and r["n"] == 48 for r in bench.values())
    ovr = K.one_vs_rest_models(train, test, "v", "y0", "id", trees=5, max_iter=10).groupBy("model").agg({"*": "count"}).collect()
    assert {r["model"]: r[1] for r in ovr} == dict.fromkeys(K.OVR_MODELS, 48)
