"""The learners against plain versions of themselves and against MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tallymark.learn import blocks as bl
from tallymark.learn import boosting, forest, linear
from tallymark.learn.moments import Moments, collect_moments

FOLDS, NAMES = 3, ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 900
    x = np.stack([rng.integers(0, 6, n), rng.integers(0, 40, n), rng.integers(0, 3, n),
                  np.zeros(n)]).astype(float)
    y = x[0] * 3 - (x[1] > 17) * x[2] * 4 + rng.normal(0, 1, n)
    part = rng.integers(0, FOLDS + 1, n)
    part = np.where(part == FOLDS, bl.TEST, part)
    return x, y, (y > np.median(y)).astype(float), part


def table(spark, x, label, part):
    rows = [(int(i), float(label[i]), int(part[i]), *map(float, x[:, i])) for i in range(len(label))]
    return spark.createDataFrame(rows, "k long, label double, part int, " + ", ".join(
        f"{c} double" for c in NAMES))


@pytest.fixture(scope="module")
def made(spark, data):
    x, y, label, part = data
    out = {}
    for name, values in (("y", y), ("label", label)):
        df = table(spark, x, values, part).repartition(5)
        mean, std = collect_moments(df.where(F.col("part") != bl.TEST), NAMES).scale()
        cuts = bl.cut_points(df.where(F.col("part") != bl.TEST), NAMES)
        old, bl.BLOCK_ROWS = bl.BLOCK_ROWS, 200
        try:
            out[name] = bl.make_blocks(df, NAMES, cuts, mean, std, len(values), "k")
        finally:
            bl.BLOCK_ROWS = old
    return out


def rows_of(blocks):
    held = sorted((bl.Block(r.asDict()) for r in blocks.collect()), key=lambda b: b.id)
    return (np.concatenate([b.x for b in held], 1), np.concatenate([b.z for b in held], 1),
            np.concatenate([b.y for b in held]), np.concatenate([b.part for b in held]), held)


def side(part, model):
    return (part != bl.TEST) & (part != model - 1) if model else part != bl.TEST


# -- blocks and moments -----------------------------------------------------------

def test_blocks_hold_every_row_in_bins(made, data):
    x, z, y, part, held = rows_of(made["y"])
    assert len(held) > 3 and x.shape == (4, 900) and sorted(y) == sorted(data[1])
    assert [len(np.unique(c)) for c in x] == [6, 40, 3, 1]
    train = part != bl.TEST
    assert z[:3, train].mean(1) == pytest.approx(0, abs=1e-9)
    assert z[:3, train].std(1, ddof=1) == pytest.approx(1) and not z[3].any()


def test_a_null_is_an_error(spark, data):
    df = table(spark, *data[:2], data[3]).withColumn("b", F.when(F.col("b") > 1, F.col("b")))
    with pytest.raises(Exception, match="null or NaN"):
        bl.make_blocks(df, NAMES, [np.zeros(0)] * 4, np.zeros(4), np.ones(4), 900, "k").count()


def test_moments_of_complete_pairs(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(1e6, 1, (500, 3))  # far from zero
    values[:, 2] = values[:, 0] * 2 + rng.normal(0, 1, 500)
    values[rng.random((500, 3)) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (5.0,) for r in values]
    found = collect_moments(spark.createDataFrame(rows, "a double, b double, c double, d double")
                            .repartition(7), ["a", "b", "c", "d"])
    r = found.correlations()
    for i in range(3):
        for j in range(3):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            assert r[i, j] == pytest.approx(np.corrcoef(values[both, i], values[both, j])[0, 1], abs=1e-9)
            assert found.n[i, j] == both.sum()
    assert np.isnan(r[3]).all() and np.isnan(r[:, 3]).all()
    mean, std = found.scale()
    assert mean[:3] == pytest.approx(np.nanmean(values, 0))
    assert std[:3] == pytest.approx(np.nanstd(values, 0, ddof=1))
    none = collect_moments(spark.createDataFrame([], "a double, b double"), ["a", "b"])
    assert not none.n.any() and np.isnan(none.correlations()).all()


def test_moments_do_not_depend_on_how_rows_are_dealt():
    values = np.random.default_rng(2).normal(50, 3, (400, 3))
    whole, parts = Moments.of(values), Moments.empty(3)
    for part in np.split(values, [1, 60, 60, 399]):
        parts = parts.joined(Moments.unpacked(Moments.of(part).packed()))
    for name in ("n", "mean", "square", "product"):
        assert getattr(parts, name) == pytest.approx(getattr(whole, name), rel=1e-10)


# -- linear models -----------------------------------------------------------------

def test_linear_models_of_all_folds(made):
    _, z, y, part, _ = rows_of(made["y"])
    weights = linear.fit_linear(made["y"], 1 + FOLDS)
    for model in range(1 + FOLDS):
        own = side(part, model)
        x = np.concatenate([z, np.ones((1, len(y)))])
        want = x.T @ np.linalg.lstsq(x[:, own].T, y[own], rcond=None)[0]
        assert weights[model] @ x == pytest.approx(want, abs=1e-8)


def test_logistic_models_of_all_folds(made):
    _, z, y, part, _ = rows_of(made["label"])
    weights = linear.fit_logistic(made["label"], 1 + FOLDS)
    x = np.concatenate([z, np.ones((1, len(y)))])
    for model in range(1 + FOLDS):
        own = side(part, model)
        slope = x[:, own] @ (linear.probability(weights[model] @ x[:, own]) - y[own])
        slope[:-1] += weights[model][:-1]
        assert slope == pytest.approx(0, abs=1e-5)  # the loss is convex, so this is its minimum


def test_logistic_of_separable_labels_ends(spark, data):
    x, part = data[0], data[3]
    df = table(spark, x, (x[0] > 2).astype(float), part)
    scale = collect_moments(df, NAMES).scale()
    blocks = bl.make_blocks(df, NAMES, bl.cut_points(df, NAMES), *scale, 900, "k")
    assert np.isfinite(linear.fit_logistic(blocks, 1)).all()


# -- boosting ------------------------------------------------------------------------

def slow_tree(x, slope, bend, depth):
    """Predictions of the best tree by trying every cut; `x` features by rows."""
    out = np.full(len(slope), slope.sum() / bend.sum())
    if not depth:
        return out
    best = (1e-9, None)
    for f in range(len(x)):
        for c in range(int(x[f].max())):
            left = x[f] <= c
            if 0 < left.sum() < len(left):
                gain = sum(slope[s].sum() ** 2 / s.sum() for s in (left, ~left)) - slope.sum() ** 2 / len(slope)
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is not None:
        for s in (best[1], ~best[1]):
            out[s] = slow_tree(x[:, s], slope[s], bend[s], depth - 1)
    return out


@pytest.mark.parametrize("name,logistic", [("y", False), ("label", True)])
def test_boosting_of_all_folds(made, name, logistic, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    x, _, y, part, held = rows_of(made[name])
    fitted = boosting.fit_boosted(made[name], 1 + FOLDS, 5, 2, 0.3, logistic)
    for model in range(1 + FOLDS):
        own = side(part, model)
        score = np.full(own.sum(), fitted.start[model])
        for _ in range(5):
            p = linear.probability(score) if logistic else score
            bend = p * (1 - p) if logistic else np.ones(len(p))
            score = score + 0.3 * slow_tree(x[:, own], y[own] - p, bend, 2)
        got = np.concatenate([fitted.raw(b, model) for b in held])[own]
        assert got == pytest.approx(score, abs=1e-6)
    assert fitted.importances().sum() == pytest.approx(1) and fitted.importances()[3] == 0


def test_jobs_do_not_grow_with_folds(made, monkeypatch):
    calls = []
    real = boosting.sum_over_blocks
    monkeypatch.setattr(boosting, "sum_over_blocks", lambda *a, **k: calls.append(1) or real(*a, **k))
    boosting.fit_boosted(made["label"], 1, 2, 2, 0.1, True)
    one = len(calls)
    boosting.fit_boosted(made["label"], 1 + FOLDS, 2, 2, 0.1, True)
    assert len(calls) == 2 * one == 2 * (1 + 2 * 2)


def test_boosting_is_as_good_as_mllib(spark, made, data):
    """Same rounds, depth, rate and bins: test R² and AUC within 0.02 of the library's. It gives
    its first tree the weight 1, ours start at the mean; at rate 0.3 that has faded."""
    x, y, label, part = data
    vector = array_to_vector(F.array(*NAMES)).alias("features")
    common = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.3, "maxBins": 64, "seed": 1}
    for name, values in (("y", y), ("label", label)):
        df = table(spark, x, values, part).select("label", "part", vector)
        train, test = df.where(F.col("part") != bl.TEST), df.where(F.col("part") == bl.TEST)
        fitted = boosting.fit_boosted(made[name], 1, 20, 3, 0.3, name == "label")
        ours = bl.scored_rows(made[name], lambda b, m, f=fitted: f.raw(b, m), 1, boosting.COLUMNS)
        if name == "y":
            theirs = GBTRegressor(**common).fit(train).transform(test).select("label", F.col("prediction").alias("score"))
            r2 = [1 - r["e"] / r["s"] for r in (d.agg(
                F.sum((F.col("label") - F.col("score")) ** 2).alias("e"),
                F.regr_syy("label", "label").alias("s")).first() for d in (ours, theirs))]
            assert abs(r2[0] - r2[1]) < 0.02
        else:
            theirs = GBTClassifier(**common).fit(train).transform(test).select(
                "label", vector_to_array("rawPrediction")[1].alias("score"))
            judge = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
            assert abs(judge.evaluate(ours) - judge.evaluate(theirs)) < 0.02


# -- forests ---------------------------------------------------------------------------

def slow_forest_tree(x, y, w):
    out = np.full(len(y), np.average(y, weights=w))
    best = (-np.inf, None)
    if len(np.unique(y)) > 1:
        for f in range(len(x)):
            for c in range(256):
                left = x[f] <= c
                if 0 < left.sum() < len(left):
                    m = y - np.average(y, weights=w)
                    gain = sum((w[s] * m[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
    if best[1] is not None:
        for s in (best[1], ~best[1]):
            out[s] = slow_forest_tree(x[:, s], y[s], w[s])
    return out


def test_grown_tree_is_the_plain_one():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 256, 300), rng.integers(0, 5, 300)]).astype(np.uint8)
    y, w = rng.normal(0, 1, 300).round(1) + x[1], rng.integers(1, 4, 300)
    tree = forest.grow(x, y, w, 2, rng)
    assert forest.walk(tree, x) == pytest.approx(slow_forest_tree(x, y, w))
    assert (tree["feature"] >= 0).sum() * 2 + 1 == len(tree["value"])
    flat = forest.grow(x, y, w, 2, rng, depth=1)
    assert len(flat["value"]) == 3
    one = forest.grow(x, y, w, 1, np.random.default_rng(4))
    assert forest.walk(one, x) == pytest.approx(slow_forest_tree(x, y, w))  # pure leaves all the same
    assert len(forest.grow(x[:, :0], y[:0], w[:0], 2, rng)["value"]) == 0


def test_forest_scores_are_means_over_drawn_trees(spark, made):
    x, _, y, part, held = rows_of(made["y"])
    fitted = forest.fit_forest(made["y"], 2, 3, 4, 900)
    got = forest.score_forest(made["y"], fitted).toPandas()
    for model in (0, 1):
        total = 0
        for tree in range(3):
            w = np.concatenate([forest.generator(42, model, tree, b.id).poisson(1.0, b.n) for b in held])
            own = side(part, model) & (w > 0)
            grown = forest.grow(x[:, own], y[own], w[own], 4, np.random.default_rng(0))
            total = total + forest.walk(grown, x)
        judged = part == (bl.TEST if not model else model - 1)
        mine = got[got.model == model]
        assert sorted(mine.score) == pytest.approx(sorted(total[judged] / 3))
        assert sorted(mine.label) == pytest.approx(sorted(y[judged]))
    assert fitted.importances().sum() == pytest.approx(1)


def test_large_nodes_are_split_over_tasks(made, monkeypatch):
    """With all features tried at every node, trees don't depend on where they are grown."""
    whole = forest.fit_forest(made["y"], 2, 3, 4, 900)
    want = forest.score_forest(made["y"], whole).toPandas().sort_values(["model", "label", "score"])
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 60)
    parts = forest.fit_forest(made["y"], 2, 3, 4, 900)
    assert len(parts.splits) > 3 * 2 * 4 and parts.subtrees.count() > 3 * 2 * 5
    got = forest.score_forest(made["y"], parts).toPandas().sort_values(["model", "label", "score"])
    assert got.score.to_numpy() == pytest.approx(want.score.to_numpy())
    assert parts.importances() == pytest.approx(whole.importances())


def test_forest_of_random_features_is_repeatable_and_learns(made):
    runs = [forest.score_forest(made["label"], forest.fit_forest(made["label"], 1, 20, 2, 900)).toPandas()
            for _ in range(2)]
    first, again = (sorted(zip(r.label, r.score)) for r in runs)
    assert first == again
    assert runs[0][runs[0].label == 1].score.mean() > runs[0][runs[0].label == 0].score.mean() + 0.5


def written_below(spark, path, run):
    """Bytes that `run` leaves in the shared folder, without the tables that it returns."""
    before = {p for p in path.iterdir()}
    run()
    return {p.name.rsplit("-", 1)[0] for p in path.iterdir() if p not in before}


def test_large_nodes_write_no_rows(spark, made, monkeypatch):
    """Rows of large nodes used to be written again at every level, for every tree."""
    from pathlib import Path

    from tallymark.session import shared_folder
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 60)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    assert written_below(spark, folder, lambda: forest.fit_forest(made["y"], 2, 3, 4, 900)) == {"subtrees"}


def test_few_bytes_of_histograms_at_a_time_make_the_same_trees(made, monkeypatch):
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 60)
    whole = forest.fit_forest(made["label"], 2, 3, 2, 900)
    monkeypatch.setattr(forest, "HELD_BYTES", 2 * 3 * 256 * 8 * 2)
    parts = forest.fit_forest(made["label"], 2, 3, 2, 900)
    assert parts.splits == whole.splits and len(whole.splits) > 2 * 3


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_rows_end_where_the_cuts_lead(depth):
    rng = np.random.default_rng(depth)
    x, tree = rng.integers(0, 256, (5, 400)).astype(np.uint8), boosting.Tree(depth)
    inner = 2 ** depth - 1
    tree.feature[:inner] = rng.integers(-1, 5, inner)
    tree.cut[:inner], tree.value[:] = rng.integers(0, 256, inner), rng.normal(0, 1, 2 * inner + 1)
    want = []
    for row in x.T:
        at = 0
        while at < inner and tree.feature[at] >= 0:
            at = 2 * at + 1 + (row[tree.feature[at]] > tree.cut[at])
        want.append(at)
    assert tree.places(x).tolist() == want
    assert (tree.predict(x) == tree.value[want]).all()


def test_settings_for_blocks_do_not_outlast_a_fit(spark, made):
    before = {key: spark.conf.get(key) for key in bl.FEW}
    fitted = boosting.fit_boosted(made["y"], 1, 2, 2, 0.1)
    bl.scored_rows(made["y"], lambda b, m: fitted.raw(b, m), 1, boosting.COLUMNS)
    assert {key: spark.conf.get(key) for key in bl.FEW} == before


def test_each_large_node_gets_a_task_of_its_own(made):
    """As many tasks as nodes: none waits for a second one while others are idle."""
    fitted = forest.fit_forest(made["label"], 1, 8, 2, 900)
    files = fitted.subtrees.select("model", F.input_file_name().alias("file")).groupBy("file").count().collect()
    assert [r["count"] for r in files] == [1] * 8


def test_nodes_are_shared_out_by_rows():
    rows = {(0, 0, k): n for k, n in enumerate([50.0, 10, 10, 10, 10, 10])}
    task = forest.shared_out(rows, 2)
    assert task[0, 0, 0] == 0 and {task[0, 0, k] for k in range(1, 6)} == {1}


@pytest.mark.parametrize("labels", [2, 10_000])
def test_cuts_found_by_few_rows_at_a_time_are_the_same(labels, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, [[3], [256], [40]], (3, 5000)).astype(np.uint8)
    y, w = rng.integers(0, labels, 5000).astype(float), rng.integers(1, 4, 5000).astype(np.uint8)
    whole = forest.grow(x, y, w, 2, np.random.default_rng(1))
    monkeypatch.setattr(forest, "HELD_ROWS", 100)
    monkeypatch.setattr(forest, "SORTED_ROWS", 30)
    parts = forest.grow(x, y, w, 2, np.random.default_rng(1))
    assert all((whole[k] == parts[k]).all() for k in whole)


def test_rows_are_put_in_order_of_node_and_bin():
    rng = np.random.default_rng(6)
    size = np.array([1, 7000, 2, 3, 900])
    bins = rng.integers(0, 256, size.sum()).astype(np.uint8)
    key = np.repeat(np.arange(5), size) * 256 + bins
    got, place = forest.in_order(np.repeat(np.arange(5), size), bins, np.cumsum(size))
    assert (place == np.argsort(key, kind="stable")).all() and (got == key[place]).all()


def test_scores_of_one_model_are_written_half_as_often(spark, made, monkeypatch):
    from tallymark import session
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    written = []
    for models in (1, 2):
        mark = session.intermediates()
        boosting.fit_boosted(made["y"], models, 9, 3, 0.1)
        written.append(len(session._made) - mark)
    assert written == [2, 4]
