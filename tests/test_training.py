"""Training, saved models and the sentence stage."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import models, stats, trees
from parlance.plans import catalog
from parlance.plans.pipeline import Paths, load_models, rescore, save_models, sentences_stage, train_job
from parlance.schema import KEY
from parlance.session import scratch_path

FEATURES = ("a", "b")
SPACE = {"n_estimators": (3,), "max_depth": (2,), "learning_rate": (0.3,), "gamma": (0.0,)}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        y = i % 2
        label = "langue_de_bois" if y else "non_langue_de_bois"
        rows.append((f"d_{i}", rng.gauss(2.0 * y, 1), rng.gauss(0, 1), label, [rng.gauss(y, 1), 0.5]))
    return spark.createDataFrame(rows, f"{KEY} string, a double, b double, label string, embedding array<double>")


def test_saved_models_score_the_same(spark, labelled):
    out = Paths(scratch_path(spark, "models"))
    fitted = train_job(labelled, FEATURES, SPACE, 1)
    save_models(fitted, out)
    again = load_models(spark, out)
    assert again.scorer == fitted.logistic.scorer and again.threshold == fitted.logistic.threshold
    assert again.trees_threshold == fitted.trees_threshold and again.cv_auc == fitted.trees.cv_auc > 0.6
    first = sorted(tuple(r) for r in fitted.metrics.drop("roc_auc").collect())
    assert sorted(tuple(r) for r in rescore(fitted.splits, again).select(*fitted.metrics.drop("roc_auc").columns).collect()) == first

    gap = labelled.limit(1).selectExpr(f"'none' AS {KEY}", "a", "b", "label", "CAST(NULL AS array<double>) AS embedding")
    scored = {r[KEY]: r for r in again.predict(labelled.unionByName(gap)).collect()}
    assert len(scored) == 161
    assert scored["none"].proba_xgb is None and scored["none"].pred_xgb is None and scored["none"].embedding is None
    assert scored["none"].proba_lr is not None and scored["d_1"].pred_xgb is not None and len(scored["d_1"].embedding) == 2


def test_a_cap_goes_by_the_full_file_name(spark, tmp_path):
    folder = tmp_path / "1981" / "legislatives"
    other = tmp_path / "1988" / "legislatives"
    folder.mkdir(parents=True)
    other.mkdir(parents=True)
    line = "Nous voulons une politique nouvelle pour le pays.\n"
    (folder / "a.txt").write_text(line * 2)
    (folder / "a-1.txt").write_text(line * 2)
    (other / "a.txt").write_text(line * 2)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        done = sentences_stage(spark, str(tmp_path), Paths(scratch_path(spark, "stages")), max_sentences=2)
    assert {r.doc_id for r in done.select("doc_id").distinct().collect()} == {"a-1"}
    assert "file_name" not in done.columns and any("more than once" in str(w.message) for w in said)


def test_registered_training_takes_all_labelled_rows_and_the_full_search(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    seen = {}

    def search(rows, space=models.SEARCH_SPACE, n_draws=models.N_DRAWS, **other):
        seen["rows"], seen["space"], seen["draws"] = rows, space, n_draws
        return models.TreeSearch(None, {}, 0.5, [({"n_estimators": 100}, 0.5)])

    monkeypatch.setattr(models, "train_gbt", search)
    catalog.QUERIES["train_gbt"](spark, folder)
    assert seen["space"] == models.SEARCH_SPACE and seen["draws"] == 30
    got = {r.doc_id: r.embedding for r in seen["rows"].select("doc_id", "embedding").collect()}
    labelled = {str(r.doc_id) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    with_text = {str(r.doc_id) for r in catalog.q.sentences(spark, folder).select("doc_id").distinct().collect()}
    known = {str(r.vec_id) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    assert set(got) == labelled & with_text and not set(got) <= known
    assert all(v[-1] == (i in known) and (i in known or not any(v)) for i, v in got.items())


def test_the_search_scores_with_the_exact_auc():
    rng = random.Random(5)
    rows = [(i % 2, rng.gauss(i % 2, 1)) for i in range(6000)]
    order = sorted(rows, key=lambda r: r[1])
    wins = before = 0
    for y, _ in order:
        wins, before = wins + before * y, before + 1 - y
    y, score = (np.array(c) for c in zip(*rows))
    assert abs(trees.exact_auc(y, score) - wins / 3000**2) < 1e-12
    assert trees.exact_auc(np.array([0, 1, 1, 0]), np.array([1.0, 1.0, 2.0, 0.0])) == 0.875
    assert np.isnan(trees.exact_auc(np.array([1, 1]), np.array([0.0, 1.0])))


SETTING = trees.DEFAULTS | {"max_depth": 2, "learning_rate": 0.5}


def least_loss(codes, g, h, setting, depth):
    """The same splits by trying every cut of every node, one by one."""
    alpha, penalty = setting["reg_alpha"], setting["reg_lambda"]
    shrunk = lambda v: np.sign(v) * max(abs(v) - alpha, 0)
    value = lambda rows: shrunk(g[rows].sum()) ** 2 / (h[rows].sum() + penalty)

    def walk(rows, depth):
        best = (setting["gamma"], None)
        for f in range(codes.shape[1] if depth else 0):
            for b in range(trees.BINS - 1):
                low = rows[codes[rows, f] <= b]
                high = rows[codes[rows, f] > b]
                if min(h[low].sum(), h[high].sum()) >= trees.LEAST_HESSIAN:
                    gain = (value(low) + value(high) - value(rows)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (low, high))
        if best[1] is None:
            return {r: -shrunk(g[rows].sum()) / (h[rows].sum() + penalty) * setting["learning_rate"] for r in rows.tolist()}
        return walk(best[1][0], depth - 1) | walk(best[1][1], depth - 1)

    return walk(np.arange(len(codes)), depth)


@pytest.mark.parametrize("more", [{}, {"reg_alpha": 1.0, "reg_lambda": 5.0}, {"gamma": 1.5}])
def test_a_tree_is_the_best_by_every_cut(more):
    rng = np.random.default_rng(6)
    setting = SETTING | more
    x = np.stack([rng.normal(size=80), rng.integers(0, 3, 80), np.zeros(80)], axis=1)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=80) > 1).astype(int)
    codes = trees.binned(x, [trees.bin_edges(c) for c in x.T])
    g, h = 0.5 - y, np.full(80, 0.25)
    tree, leaf = trees.grow(codes, g, h, np.arange(3), setting)
    want = least_loss(codes, g, h, setting, 2)
    assert np.allclose(tree.value[leaf], [want[i] for i in range(80)])
    assert (trees.leaves(tree, codes) == leaf).all()


def test_one_split_has_the_closed_form(spark):
    """One 0/1 feature: both leaves follow from the four counts."""
    rows = [(f"k{i}", [float(i % 3 == 0)], int(i % 3 == 0) if i % 5 else 1 - int(i % 3 == 0), 1.0, i % 2) for i in range(300)]
    data = spark.createDataFrame(rows, "k string, vector array<double>, y int, weight double, fold int")
    sample = trees.gathered(data, "k")
    model = trees.refit(spark, sample, {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0}, 1)
    for bit in (0.0, 1.0):
        ys = [r[2] for r in rows if r[1] == [bit]]
        assert np.isclose(model.margins(np.array([[bit]]))[0], (sum(ys) - 0.5 * len(ys)) / (0.25 * len(ys) + 1.0))
    again = trees.from_rows(model.table(spark).collect(), 1)
    scored = data.select(again.proba(spark, F.when(F.col("k") != "k7", F.col("vector"))).alias("p"), "k", F.col("vector")[0].alias("x")).collect()
    for r in scored:
        assert r.p is None if r.k == "k7" else np.isclose(r.p, 1 / (1 + np.exp(-model.margins(np.array([[r.x]]))[0])))


def test_draws_that_differ_in_the_number_of_trees_share_a_fit(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(np.int64)
    sample = trees.Sample(x, y, np.ones(300), np.arange(300) % 3)
    draws = [{"n_estimators": n, "max_depth": 3, "subsample": 0.8} for n in (5, 20)] + [{"n_estimators": 5, "max_depth": 1}]
    got = trees.cross_validate(spark, sample, draws, 3, 4)
    alone = [trees.cross_validate(spark, sample, [d], 3, 4)[0] for d in draws[:2]]
    assert got[:2] == alone and got[1] > 0.85 > 0.65 > got[2]


def test_the_sample_is_bounded_and_the_same_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(trees, "MAX_TRAINING_ROWS", 50)
    rows = [(f"k{i}", [float(i)], i % 2, 1.0, i % 3) for i in range(200)]
    data = spark.createDataFrame(rows, "k string, vector array<double>, y int, weight double, fold int")
    first, second = trees.gathered(data, "k"), trees.gathered(data.repartition(7), "k")
    assert len(first.x) == 50 and (first.x == second.x).all() and (first.y == second.y).all()


def test_the_split_as_an_expression_is_the_ranked_one(spark):
    rows = [(f"k{i}", i % 3 % 2, i) for i in range(3000)] + [(None, 1, 3000 + i) for i in range(5)]
    data = spark.createDataFrame(rows, f"{KEY} string, y int, row long").repartition(5)
    split = stats.split_column(data, "row")
    got = {r.row: r.s for r in data.select("row", split.alias("s")).collect()}
    ranked = {r.row: r.split for r in stats.stratified_split(data).collect()}
    assert got == ranked and set(got.values()) == {"train", "val", "test"}

    copies = data.withColumn(KEY, F.lit("one"))
    for sizes in ({}, {"test_size": 0.9, "val_size": 0.1}, {"test_size": 0.0}):
        split = stats.split_column(copies, "row", **sizes)
        shares = copies.groupBy("y", split.alias("split")).count().collect()
        assert sorted(map(tuple, shares)) == sorted(map(tuple, stats.stratified_split(copies, **sizes).groupBy("y", "split").count().collect()))


def test_only_rows_near_the_sample_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(trees, "MAX_TRAINING_ROWS", 50)
    data = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.array(F.col("id").cast("double")).alias("vector"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("weight"))
    near = [r.k for r in data.where(trees.early(data, "k")).collect()]
    first = [r.k for r in data.orderBy(F.xxhash64("k"), "k").limit(50).collect()]
    assert set(first) <= set(near) and len(near) < 60
    folds = data.select("k", "y", (F.col("vector")[0] % 3).cast("int").alias("fold"))
    sample = trees.gathered(data, "k", folds.repartition(3))
    assert [f"k{int(v)}" for v in sample.x[:, 0]] == first
    assert (sample.fold == sample.x[:, 0] % 3).all() and (sample.y == sample.x[:, 0] % 2).all()


def test_training_scores_every_row_once_and_reads_the_labelled_rows_once(spark, labelled, monkeypatch):
    read, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(total, value):
        def count(x):
            total.add(1)
            return x

        return F.udf(count, "double")(value)

    monkeypatch.setattr(trees.BoostedTrees, "proba", lambda self, spark, vector: counted(scored, vector[0]) * 0 + 0.5)
    rows = labelled.withColumn("a", counted(read, F.col("a")))
    found = {r.split: r for r in train_job(rows, FEATURES, SPACE, 1).metrics.where("model = 'trees'").collect()}
    assert set(found) == {"train", "val", "test"} and {r.auc_roc for r in found.values()} == {0.5}
    assert read.value == scored.value == 160


def test_margins_are_the_sums_of_a_plain_walk(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 70))
    x[::5, 0], x[::7, 1], x[::11, 2] = np.nan, np.inf, x[3, 2]
    model = catalog.q.fixed_trees()
    grown = [catalog.q.fixed_trees() for _ in range(2)]
    many = trees.BoostedTrees(  # the same trees twice, behind a tree that is a leaf
        *[np.concatenate([[v], *(getattr(m, c) + (1 + i * len(m.left) if c in ("left", "right") else 0) for i, m in enumerate(grown))]) for c, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.5))],
        np.concatenate([[0], *(m.roots + 1 + i * len(m.left) for i, m in enumerate(grown))]), model.n_features,
    )

    def walk(model, row):
        total = 0.0
        for node in model.roots.tolist():
            while model.feature[node] >= 0:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return total

    wide = np.concatenate([x, rng.normal(size=(700, model.n_features - 70))], axis=1)
    monkeypatch.setattr(trees, "CUT_CELLS", 1)
    for m in (model, many):
        assert m.margins(wide).tolist() == [walk(m, r) for r in wide]
