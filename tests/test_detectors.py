import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fraudloom import session
from fraudloom.operators import autoencoder as ae
from fraudloom.operators import dbscan, flags, iforest, refine, search, silhouette
from fraudloom.operators.components import connected_components
from fraudloom.operators.iforest import ForestModel, average_path, isolation_forest_fit, isolation_forest_score
from fraudloom.plans import queries_detect

NAMES = ["a", "b", "c"]
SCHEMA = "id long, user_id long, a double, b double, c double"


def frame(spark, x, parts=4):
    rows = [(i, i % 5, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    return np.round(np.vstack([
        rng.normal(0, 0.3, (220, 3)), rng.normal(4, 0.5, (180, 3)), np.repeat([[9.0, 9.0, 9.0]], 5, axis=0),
        rng.uniform(-6, 12, (40, 3)), [[40.0, -40.0, 40.0]],
    ]), 6)


def brute(x, eps, least):
    near = [np.flatnonzero(((x - r) ** 2).sum(axis=1) <= eps * eps) for r in x]
    core = np.array([len(n) >= least for n in near])
    labels, count = np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i], todo = count, [i]
        while todo:
            j = todo.pop()
            if core[j]:
                for k in near[j]:
                    if labels[k] == -1:
                        labels[k] = count
                        todo.append(k)
        count += 1
    return labels


@pytest.mark.parametrize("eps,least", [(0.5, 5), (0.25, 3), (1.0, 7)])
def test_dbscan_equals_brute_force(spark, blobs, eps, least):
    df = frame(spark, blobs)
    want = brute(blobs, eps, least)
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan_clusters(df, NAMES, eps, least).collect()}
    assert [got[i] for i in range(len(blobs))] == want.tolist()
    noise = {r["id"]: r["DBSCAN"] for r in dbscan.dbscan_noise(df, NAMES, eps, least).collect()}
    assert [noise[i] for i in range(len(blobs))] == (want == -1).astype(int).tolist()


@pytest.mark.parametrize("eps,least,leaf", [(0.5, 5, 24), (0.3, 60, 16)])
def test_dense_cells_equal_brute_force(spark, eps, least, leaf):
    rng = np.random.default_rng(8)
    x = np.zeros((1000, 3))
    x[:500, :2] = rng.uniform(0, 1, (500, 2))
    x[500:700, :2] = rng.uniform(0, 0.2, (200, 2)) + [1.6, 0.4]  # a second group, just about out of reach
    x[700:800, :2] = np.exp(-rng.uniform(0, 4, (100, 2))) * 0.4 + [0, 2.2]  # denser and denser towards one corner
    x[800:900] = x[rng.integers(0, 500, 100)]
    x[900:, :2] = rng.uniform(-1, 4, (100, 2))
    x = np.round(x, 9)
    df, want = frame(spark, x), brute(x, eps, least)
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan_clusters(df, NAMES, eps, least, leaf=leaf).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
    noise = {r["id"]: r["DBSCAN"] for r in dbscan.dbscan_noise(df, NAMES, eps, least, leaf=leaf).collect()}
    assert [noise[i] for i in range(len(x))] == (want == -1).astype(int).tolist()


def test_trees_split_until_leaves_are_small(spark):
    x = np.vstack([np.random.default_rng(1).uniform(0, 1, (300, 2)), np.zeros((50, 2)), [[5.0, 5.0]]])
    df = spark.createDataFrame([(i, "c" if i < 350 else "far", *map(float, r)) for i, r in enumerate(x)], "v long, cell string, a double, b double")
    trees = refine.grow(df.dropDuplicates(["a", "b"]), ["a", "b"], 10)
    leaves = refine._leaves(refine.placed(df.dropDuplicates(["a", "b"]), trees)).groupBy("node").agg(F.count("*").alias("n"), F.min("cell").alias("cell")).collect()
    assert max(r["n"] for r in leaves) <= 10 and sum(r["n"] for r in leaves) == 302 and {"far"} == {r["node"] for r in leaves if r["cell"] == "far"}
    assert refine.grow(df.filter("v > 349"), ["a", "b"]).paths is None


def test_dbscan_search_equals_single_runs(spark, blobs):
    found = dbscan.dbscan_search(frame(spark, blobs), NAMES, target_outliers=40)
    runs = {(r["eps"], r["min_samples"]): r["n_outliers"] for r in found.runs.collect()}
    want = {(e, m): int((brute(blobs, e, m) == -1).sum()) for e, m in runs}
    assert runs == want
    assert found.best == min(runs, key=lambda k: abs(runs[k] - 40))


def test_who_has_enough_within_a_radius_seeks_in_no_larger_one(spark):
    """Every vector of the line has seven within the least radius, though no cell holds seven of them."""
    x = np.zeros((208, 3))
    x[:200, 0] = np.arange(200) * 0.04
    x[200:, 1] = [-0.4, -0.6, -0.9, 5.0, 5.25, 5.6, 6.2, 40.0]
    settings = [(e, m) for e in (0.3, 0.5, 0.7) for m in (3, 5, 7)]
    run = dbscan.find_noise(frame(spark, x), NAMES, settings)
    assert run.outliers() == [int((brute(x, e, m) == -1).sum()) for e, m in settings]
    assert run.vectors.table.groupBy("cell").count().agg(F.max("count")).first()[0] < 7
    line = [r["cell"] for r in run.vectors.table.filter("x1 = 0").select("cell").distinct().collect()]
    seekers = [r["a"] for r in run.pairs.select("a").distinct().collect()]
    assert seekers and not set(seekers) & set(line)


def test_dbscan_of_copies_and_of_nothing(spark):
    same = frame(spark, np.ones((6, 3)))
    assert {r["cluster"] for r in dbscan.dbscan_clusters(same, NAMES, 0.5, 5).collect()} == {0}
    assert dbscan.dbscan_noise(same.limit(0), NAMES).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(200, 100)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 200, 300]], "node long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(31, 61)} == {31}
    assert got[200] == got[100] == 100 and got[300] == 300


def test_forest_finds_the_outlier_under_any_partitioning(spark, blobs):
    scores = []
    for parts in (1, 4, 16):
        df = frame(spark, blobs, parts)
        model = isolation_forest_fit(df, NAMES, 60, seed=7)
        rows = isolation_forest_score(model, df).orderBy("id").collect()
        scores.append([r["anomaly_score"] for r in rows])
    assert scores[0] == scores[1] == scores[2]
    assert min(scores[0]) == scores[0][-1] and -1 <= min(scores[0]) and max(scores[0]) <= 0


def test_forest_flags_save_and_missing(spark, blobs, tmp_path):
    df = frame(spark, blobs)
    model = isolation_forest_fit(df, NAMES, 50, bootstrap=True, seed=1)
    scored = isolation_forest_score(model, df)
    flagged = flags.contamination_flag(scored, "anomaly_score", 0.02)
    assert abs(flagged.agg(F.sum("fraud_flag")).first()[0] - 0.02 * len(blobs)) <= 1
    model.save(spark, str(tmp_path / "m"))
    again = isolation_forest_score(ForestModel.load(spark, str(tmp_path / "m")), df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))
    holed = spark.createDataFrame([(1, 1, None, 0.0, 0.0)], SCHEMA)
    assert isolation_forest_score(model, holed).first()["anomaly_score"] is None
    assert average_path(2) == 1 and average_path(1) == 0


def test_forest_on_large_sample_path(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(6000, 3)), [[25, 25, 25]]])
    df = frame(spark, x)
    model = isolation_forest_fit(df, NAMES, 40, 64)
    assert model.nodes.groupby("tree_id")["size"].max().eq(64).all()
    assert isolation_forest_score(model, df).orderBy("anomaly_score").first()["id"] == 6000


def test_forest_search(spark, blobs):
    found = search.isolation_forest_search(frame(spark, blobs), NAMES, [10, 20], [0.01, 0.05], ["auto", 50])
    runs = found.runs.collect()
    assert len(runs) == 8
    assert found.best["silhouette"] == max(r["silhouette"] for r in runs if r["silhouette"] is not None)
    assert found.scored.filter("IsolationForest = 1").count() > 0


def slow_silhouette(x, labels, power):
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2) ** power
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = gap[i][same].sum() / (same.sum() - 1)
        b = min(gap[i][labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("metric,power", [("squared", 1.0), ("euclidean", 0.5)])
def test_silhouette(spark, blobs, metric, power, monkeypatch):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 100)
    labels = np.digitize(blobs[:, 0], [2.0, 30.0])
    df = frame(spark, blobs).withColumn("l", F.when(F.col("a") < 2, 0).when(F.col("a") < 30, 1).otherwise(2))
    assert silhouette.silhouette(df, NAMES, "l", metric) == pytest.approx(slow_silhouette(blobs, labels, power))
    assert silhouette.silhouette(df.withColumn("l", F.lit(1)), NAMES, "l", metric) is None


def test_gradient_and_forward_pass():
    net = ae.Network(hidden=(4, 3, 4), l2={0: 0.01})
    shapes = ae._shapes(5, net.hidden)
    rng = np.random.default_rng(1)
    flat, x = rng.normal(size=sum(n * m + m for n, m in shapes)), rng.normal(size=(7, 5))
    grad, _ = ae._gradient(flat, shapes, x, net, None)
    step = 1e-6
    slopes = [
        (ae._gradient(flat + d, shapes, x, net, None)[1] - ae._gradient(flat - d, shapes, x, net, None)[1]) / (2 * step)
        for d in np.eye(len(flat)) * step
    ]
    assert np.allclose(grad, slopes, atol=1e-6)
    y = x
    layers = ae._unpack(flat, shapes)
    for w, b in layers[:-1]:
        y = np.maximum(y @ w + b, 0)
    y = 1 / (1 + np.exp(-(y @ layers[-1][0] + layers[-1][1])))
    assert np.allclose(ae._forward(layers, x, net)[0][-1], y)


def test_autoencoder(spark, blobs, tmp_path):
    x = (blobs - blobs.mean(axis=0)) / blobs.std(axis=0)
    net = ae.Network(hidden=(8, 2, 8), output="linear", epochs=15, validation=0.2, patience=10)
    models = [ae.autoencoder_fit(frame(spark, x, parts), NAMES, net, slot=150) for parts in (2, 7)]
    assert np.array_equal(models[0].weights, models[1].weights)
    history = models[0].history
    assert history[-1]["loss"] < history[0]["loss"] and history[0]["val_loss"] is not None
    errors = ae.autoencoder_error(models[0], frame(spark, x))
    flagged = flags.percentile_flag(errors, "Autoencoder_Error", 98, "Autoencoder")
    assert flagged.filter(f"id = {len(x) - 1}").first()["Autoencoder"] == 1
    models[0].save(spark, str(tmp_path / "net"))
    again = ae.autoencoder_error(ae.Autoencoder.load(spark, str(tmp_path / "net")), frame(spark, x))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, errors.collect()))


def test_early_stopping_restores_the_best(spark, blobs):
    x = (blobs - blobs.mean(axis=0)) / blobs.std(axis=0)
    net = ae.Network(hidden=(4,), epochs=40, validation=0.3, patience=2, min_delta=10.0, restore_best=True)
    model = ae.autoencoder_fit(frame(spark, x), NAMES, net, slot=250)
    assert len(model.history) == 3


def test_pca_error(spark, blobs):
    df = frame(spark, blobs)
    got = [r[2] for r in ae.pca_error(ae.pca_fit(df, NAMES, 2), df).orderBy("id").collect()]
    centred = blobs - blobs.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.allclose(got, ((centred - centred @ v @ v.T) ** 2).mean(axis=1), atol=1e-8)


def test_pca_query_keeps_rows_that_lack_a_feature(spark, sf_dir):
    rows, names = queries_detect.scaled_rows(spark, sf_dir, every=True)
    lacking = {(r.id, r.user_id) for r in rows.filter(" OR ".join(f"`{n}` IS NULL" for n in names)).select("id", "user_id").collect()}
    got = queries_detect.pca_reconstruction(spark, sf_dir).collect()
    assert lacking and len(got) == rows.count()
    assert {(r.id, r.user_id) for r in got if r.Autoencoder is None} == lacking
    assert {(r.id, r.user_id) for r in got if r.Autoencoder_Error is None} == lacking


def plain_training(slots, net, seed):
    """Two-layer training written out: each slot by itself from the shared weights, then the mean weighted by rows."""
    width, hidden = slots[0].shape[1], net.hidden[0]
    sizes = [width * hidden, hidden, hidden * width, width]
    cuts = np.cumsum(sizes)
    shared = [ae._start([(width, hidden), (hidden, width)], seed), np.zeros(cuts[-1]), np.zeros(cuts[-1])]
    step = 0
    for epoch in range(net.epochs):
        made = []
        for number, rows in enumerate(slots):
            w, m, v = (x.copy() for x in shared)
            rows = rows[np.random.default_rng([seed, epoch, number]).permutation(len(rows))]
            for t, at in enumerate(range(0, len(rows), net.batch), step + 1):
                x = rows[at : at + net.batch]
                w1, b1, w2, b2 = np.split(w, cuts[:-1])
                w1, w2 = w1.reshape(width, hidden), w2.reshape(hidden, width)
                h = np.maximum(x @ w1 + b1, 0)
                y = 1 / (1 + np.exp(-(h @ w2 + b2)))
                d2 = 2 * (y - x) / x.size * y * (1 - y)
                d1 = (d2 @ w2.T) * (h > 0)
                g = np.concatenate([(x.T @ d1).ravel(), d1.sum(0), (h.T @ d2).ravel(), d2.sum(0)])
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - net.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-7)
            made.append((len(rows), np.array([w, m, v])))
        shared = list(sum(n * s for n, s in made) / sum(n for n, _ in made))
        step += max(-(-n // net.batch) for n, _ in made)
    return shared[0]


@pytest.mark.parametrize("slot,fold", [(10_000, 64), (64, 2)])
def test_training_equals_a_plain_loop(spark, blobs, monkeypatch, slot, fold):
    monkeypatch.setattr(ae, "FOLD", fold)
    net = ae.Network(hidden=(4,), epochs=3, batch=16)
    x = (blobs - blobs.min(axis=0)) / (blobs.max(axis=0) - blobs.min(axis=0))
    order = frame(spark, x).select(F.xxhash64(F.lit(42), "id", "user_id").alias("h"), "id").orderBy("h").collect()
    ranked = x[[r["id"] for r in order]]
    want = plain_training([ranked[i : i + slot] for i in range(0, len(ranked), slot)], net, 42)
    for parts in (1, 5):
        got = ae.autoencoder_fit(frame(spark, x, parts), NAMES, net, slot=slot)
        assert np.allclose(got.weights, want, rtol=0, atol=1e-12)
    rows = [r for r in got.history]
    assert [r["epoch"] for r in rows] == [0, 1, 2] and rows[2]["loss"] < rows[0]["loss"]


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    shapes = ae._shapes(3, (4, 2))
    for net in (ae.Network(hidden=(4, 2), l2={0: 0.1}), ae.Network(hidden=(4, 2), output="linear")):
        w, x = ae._start(shapes, 3) + rng.normal(0, 0.1, sum(n * m + m for n, m in shapes)), rng.uniform(0, 1, (6, 3))
        grad, _ = ae._gradient(w, shapes, x, net, None)
        for i in range(len(w)):
            step = np.zeros(len(w))
            step[i] = 1e-6
            rise = (ae._gradient(w + step, shapes, x, net, None)[1] - ae._gradient(w - step, shapes, x, net, None)[1]) / 2e-6
            assert grad[i] == pytest.approx(rise, abs=1e-6)


def test_splits_do_not_depend_on_partitions(spark, blobs):
    parts = [
        sorted(r["id"] for r in flags.split_train_test(frame(spark, blobs, p), ["id", "user_id"])[1].collect())
        for p in (1, 9)
    ]
    assert parts[0] == parts[1] and 0.1 < len(parts[0]) / len(blobs) < 0.3


def test_dbscan_does_not_round(spark):
    x = np.zeros((200, 3))
    x[:, 0] = np.arange(200) * 1e-7
    df = frame(spark, x)
    assert dbscan.dbscan_noise(df, NAMES, 5e-8, 2).agg(F.sum("DBSCAN")).first()[0] == 200
    assert dbscan.dbscan_noise(df, NAMES, 1.5e-7, 2).agg(F.sum("DBSCAN")).first()[0] == 0


def test_dbscan_keeps_incomplete_rows(spark, blobs):
    df = frame(spark, blobs).withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    for got, out in ((dbscan.dbscan_noise(df, NAMES), "DBSCAN"), (dbscan.dbscan_clusters(df, NAMES), "cluster")):
        assert got.count() == len(blobs) and got.filter(f"{out} IS NULL").count() == len(range(0, len(blobs), 10))


def test_flags_reach_rows_with_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id long, user_id long")
    found = rows.withColumn("f", F.lit(1))
    assert flags.attach_flags(rows, found, ["id", "user_id"], "f").count() == 3
    scored = rows.withColumn("s", F.when(F.col("id") > 1, F.col("id").cast("double")))
    got = {r["id"]: r["fraud_flag"] for r in flags.percentile_flag(scored, "s", 50).collect()}
    assert got == {1: None, 2: 0, 3: 1}


def test_percentiles_by_weight_and_by_rank(spark, blobs):
    from fraudloom.operators.quantile import exact_percentiles

    df = frame(spark, blobs).withColumn("none", F.lit(None).cast("double"))
    ps = [0.0, 0.01, 0.5, 0.98, 1.0]
    for limit in (10**6, 0):
        got = exact_percentiles(df, [*NAMES, "none"], ps, limit)
        assert got["none"] == [None] * 5
        for i, c in enumerate(NAMES):
            assert np.allclose(got[c], np.percentile(blobs[:, i], [100 * p for p in ps]))


def test_forest_draws_again_when_short(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(4000, 3)))
    model = isolation_forest_fit(df, NAMES, 60, 4)
    assert model.nodes[model.nodes["depth"] == 0]["size"].eq(4).all()


def test_euclidean_silhouette_keeps_digits_far_from_the_origin(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(1e6 + np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(0, 1e-4, (60, 3)), np.zeros((20, 3))]), 6)
    labels = rng.integers(0, 3, len(x))
    x, labels = np.concatenate([x, x[:10]]), np.concatenate([labels, labels[:10]])
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(silhouette._distances(x[:50] - x[0], x - x[0]), gap[:50], rtol=1e-9, atol=1e-9)
    total, n = np.stack([gap[:, labels == k].sum(axis=1) for k in range(3)], axis=1), np.bincount(labels)
    line, mean = np.arange(len(x)), total / n
    a = total[line, labels] / (n[labels] - 1)
    mean[line, labels] = np.inf
    b = mean.min(axis=1)
    frame = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, labels)], "a double, b double, c double, label long")
    found = []
    for rows in (4096, 16):  # one block, then many
        monkeypatch.setattr(silhouette, "BLOCK_ROWS", rows)
        found.append(silhouette.silhouette(frame, ["a", "b", "c"], "label", "euclidean"))
    assert np.allclose(found, ((b - a) / np.maximum(a, b)).mean(), atol=1e-9)


@pytest.mark.parametrize("net", [ae.STANDALONE, ae.REGULARISED, ae.Network(hidden=(3,), output="linear", batch=7, dropout={0: 0.1})])
def test_slots_side_by_side_train_as_each_alone(net):
    rng = np.random.default_rng(2)
    shapes = ae._shapes(5, net.hidden)
    start = np.concatenate([ae._start(shapes, 1), rng.random(2 * len(ae._start(shapes, 1))) * 0.01])
    # one slot is empty, one has a rest only, and their numbers of full batches differ
    for lengths in ([300, 300, 291], [300, 130, 5], [64, 0, 200]):
        xs = [rng.normal(size=(n, 5)) * 3 for n in lengths]
        fresh = lambda: [np.random.default_rng([9, i]) for i in range(len(xs))]
        together = np.tile(start, (len(xs), 1))
        told = ae._train(together, 3, xs, net, shapes, fresh())
        for i, x in enumerate(xs):
            alone = start[None].copy()
            assert ae._train(alone, 3, [x], net, shapes, [fresh()[i]]) == [told[i]]
            assert (alone[0] == together[i]).all()
    # the first step goes along the gradient of a single network
    plain = ae.Network(hidden=net.hidden, output=net.output, batch=net.batch, l2=net.l2)
    state = np.concatenate([start[:len(start) // 3], np.zeros(2 * len(start) // 3)])[None].copy()
    grad, loss = ae._gradient(state[0, :len(start) // 3].copy(), shapes, xs[0][:net.batch], plain, None)
    assert ae._train(state, 0, [xs[0][:net.batch]], plain, shapes, [fresh()[0]]) == [(1, loss * min(net.batch, len(xs[0])))]
    assert (state[0, len(start) // 3:2 * len(start) // 3] == 0.1 * grad).all()


def test_steps_side_by_side_follow_a_plain_loop():
    """Dropout, penalties and rests of a batch, written out for one table: each product and draw in its place."""
    net = ae.Network(hidden=(6, 4), batch=16, dropout={0: 0.3, 1: 0.1}, l2={1: 0.02})
    shapes, x = ae._shapes(3, net.hidden), np.random.default_rng(1).normal(size=(ae.PIECE * 16 + 37, 3))
    start = ae._start(shapes, 2)
    w, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    rng, losses = np.random.default_rng(4), 0.0
    for t, at in enumerate(range(0, len(x), net.batch), 1):
        g, loss = ae._gradient(w, shapes, x[at:at + net.batch], net, rng)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - net.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-7)
        losses += loss * len(x[at:at + net.batch])
    for others in (0, 2):  # by itself, and beside tables that end before and after it
        xs = [x, x[:40], np.tile(x, (2, 1))][:1 + others]
        states = np.tile(np.concatenate([start, np.zeros(2 * len(start))]), (len(xs), 1))
        told = ae._train(states, 0, xs, net, shapes, [np.random.default_rng(4 + i) for i in range(len(xs))])
        assert told[0][0] == t and np.isclose(told[0][1], losses, rtol=1e-12)
        assert np.allclose(states[0], np.concatenate([w, m, v]), rtol=0, atol=1e-12)


def test_columns_of_one_train_alike_side_by_side():
    net = ae.Network(hidden=(4, 1, 4), batch=16, dropout={1: 0.2})
    shapes = ae._shapes(3, net.hidden)
    xs = [np.random.default_rng(i).normal(size=(n, 3)) for i, n in enumerate((100, 70, 9))]
    start = np.concatenate([ae._start(shapes, 1), np.zeros(2 * len(ae._start(shapes, 1)))])
    together = np.tile(start, (3, 1))
    told = ae._train(together, 0, xs, net, shapes, [np.random.default_rng(i) for i in range(3)])
    for i, x in enumerate(xs):
        alone = start[None].copy()
        assert ae._train(alone, 0, [x], net, shapes, [np.random.default_rng(i)]) == [told[i]]
        assert (alone[0] == together[i]).all()


def test_every_core_gets_as_many_slots(spark, blobs):
    # files of the slot table: a multiple of the cores, none too large, and slots dealt evenly
    for count, size, cores in ((3, 800_000, 8), (8, 800_000, 8), (5281, 800_000, 12), (352, 800_000, 8), (7, 1, 3), (0, 800_000, 4)):
        files = ae._files(count, size, cores)
        assert 1 <= files <= max(count, 1) and -(-count // files) * size <= ae.FILE_BYTES + size
        assert files == max(count, 1) or files % cores == 0
    rows = frame(spark, blobs, 3).withColumn("is_validation", F.col("id") % 5 == 0)
    slots, count = ae._slots(rows, NAMES, ["id", "user_id"], 42, 20)
    held = [list(r["s"]) for r in slots.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("slot").alias("s")).collect()]
    assert sorted(x for s in held for x in s) == list(range(count))
    assert len(held) == ae._files(count, 20 * (8 * len(NAMES) + 1), spark.sparkContext.defaultParallelism)
    assert max(map(len, held)) - min(map(len, held)) <= 1
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with session.a_task_per_file(spark):
        assert slots.rdd.getNumPartitions() == len(held)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_path_lengths_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(6)
    rows = np.where(rng.random((700, 4)) < 0.5, rng.integers(0, 4, (700, 4)), rng.normal(size=(700, 4)))
    rows[3, 1], rows[5, 0], rows[6, 2] = np.nan, np.inf, -np.inf
    grown = [iforest._grow(t, rows[10:][rng.choice(690, 40)] if t else rows[10:11], 6, rng) for t in range(5)]  # the first tree is one leaf
    flat = iforest._flatten(ForestModel(list("abcd"), 40, 1, pd.concat(grown, ignore_index=True)))
    want = np.empty((len(rows), len(grown)))
    for t, nodes in enumerate(grown):
        for i, row in enumerate(rows):
            node = nodes.iloc[0]
            while node["feature"] >= 0:
                node = nodes.iloc[int(node["left"] if row[int(node["feature"])] <= node["threshold"] else node["right"])]
            want[i, t] = node["depth"] + average_path(node["size"])
    assert (iforest._path_lengths(flat, rows) == want).all()
    assert iforest._path_lengths(flat, rows[:0]).shape == (0, 5)
    # a batch of many rows must not make arrays of rows x trees for every look-up
    tracemalloc.start()
    iforest._path_lengths(flat, np.tile(rows, (40, 1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28_000 * 8 * 20
