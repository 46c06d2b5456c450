"""All stages from corpus files to predictions, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.vectors import HashingEncoder
from parlance.plans import pipeline as pl
from parlance.schema import KEY, LINGUISTIC_FEATURES
from parlance.session import scratch_path
from parlance.sources import tables

SPACE = {"n_estimators": (4, 8), "max_depth": (2,), "learning_rate": (0.3,), "subsample": (1.0,)}


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    rng, root = random.Random(2), tmp_path_factory.mktemp("corpus")
    plain, vague = "Nous donnons 12 euros en 1981 pour {}.", "Il faut une grande politique nouvelle et {}."
    for i in range(30):
        folder = root / ("1981" if i % 2 else "1988") / "legislatives"
        folder.mkdir(parents=True, exist_ok=True)
        lines = [(vague if (i + k) % 3 else plain).format(rng.choice(["la paix", "les routes", "la France"])) for k in range(6)]
        (folder / f"doc{i}.txt").write_text("\n".join(lines), "utf-8")
    out = pl.Paths(scratch_path(spark, "chain"))
    rows = pl.sentences_stage(spark, str(root), out)
    features = pl.features_stage(spark, rows, out, ["grande", "nouvelle"], [("la France", "LOC")], ["paix"], ["faut"])
    embeddings = pl.embeddings_stage(spark, rows, out, HashingEncoder(8))
    final = pl.merge_stage(spark, features, embeddings, out)
    label = F.when(F.col("sentence").contains("politique"), "langue_de_bois").otherwise("non_langue_de_bois")
    sheet = final.withColumn("label", F.when(F.substring("doc_id", -1, 1) != "7", label)).select(KEY, "label")
    tables.write_labels(sheet, f"{out.root}/labels")
    labelled, two = pl.label_stage(spark, final, f"{out.root}/labels", out)
    return out, rows, final, labelled, two


def test_stages_keep_every_sentence(chain):
    _, rows, final, labelled, two = chain
    assert rows.count() == final.count() == labelled.count() == two.count() == 180
    assert final.where("embedding is null").count() == 0 and set(LINGUISTIC_FEATURES) <= set(final.columns)
    assert labelled.where("label is null").count() == 18
    first = final.where("doc_id = 'doc0'").orderBy("sent_idx").first()
    assert (first.n_digits, first.n_vague_words, first.date, first.classe) == (2, 0, "1988", "legislatives")


def test_training_predicts_the_whole_corpus_and_saves_everything(spark, chain):
    out, _, final, _, two = chain
    predicted = pl.train_stage(two, final, out, space=SPACE, n_draws=2)
    assert predicted.count() == 180
    assert {"proba_lr", "pred_lr", "proba_xgb", "pred_xgb"} <= set(predicted.columns)
    right = predicted.where((F.col("pred_xgb") == "langue_de_bois") == F.col("sentence").contains("politique")).count()
    assert right > 165
    metrics = spark.read.json(out.models + "/evaluation")
    assert {(r.split, r.model) for r in metrics.select("split", "model").collect()} == {(s, m) for s in ("train", "val", "test") for m in ("logistic", "trees")}
    again = pl.load_models(spark, out).predict(final).select(KEY, "proba_lr", "proba_xgb")
    both = again.join(predicted.select(KEY, F.col("proba_lr").alias("a"), F.col("proba_xgb").alias("b")), KEY)
    assert both.where("proba_lr <> a or proba_xgb <> b").count() == 0 and both.count() == 180
    assert spark.read.json(out.models + "/features").where("selected").count() > 0
