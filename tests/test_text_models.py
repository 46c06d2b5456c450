"""Learnt vectors, model adapters, labels without training rows, and learnt abbreviations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions.text import split_sentences
from parlance.operators import abbreviations, features, vectors
from parlance.operators.adapter import BatchModelEncoder, StructModel, TextModel
from parlance.operators.corpus_vectors import CorpusVectorEncoder
from parlance.operators.zero_shot import zero_shot_scores
from parlance.schema import KEY


def sentences(spark, texts):
    return spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], f"{KEY} string, sentence string")


TEXTS = ["le chat mange du poisson", "le chien mange du poisson", "le chat boit du lait", "le chien boit du lait",
         "la loi fixe un impôt", "le décret fixe un impôt", "la loi vote un budget", "le décret vote un budget"] * 5


def test_words_of_equal_neighbours_have_near_vectors(spark):
    encoder = CorpusVectorEncoder(dimensions=6, min_count=2, rounds=6)
    corpus = sentences(spark, TEXTS)
    table = encoder.fit(corpus)
    vector = {r.w: np.array([r[f"v{i}"] for i in range(6)]) for r in table.collect()}
    gram = sum(np.outer(v, v) for v in vector.values())
    assert np.allclose(gram, np.eye(6), atol=1e-6)
    near = lambda a, b: vector[a] @ vector[b] / np.linalg.norm(vector[a]) / np.linalg.norm(vector[b])
    assert near("chat", "chien") > 0.9 > near("chat", "impôt") and near("impôt", "budget") > near("impôt", "lait")
    done = {r[KEY]: r.embedding for r in encoder.apply(sentences(spark, ["le chat", "inconnu", "", None, "chat chat le"]), table).collect()}
    assert np.allclose(done["k0"], (vector["le"] + vector["chat"]) / 2, atol=1e-6)
    assert np.allclose(done["k4"], (vector["le"] + 2 * vector["chat"]) / 3, atol=1e-6)
    assert all(done[k] == [0.0] * 6 for k in ("k1", "k2", "k3"))


def test_a_corpus_without_words_gives_zero_vectors(spark):
    done = CorpusVectorEncoder(dimensions=2).encode(sentences(spark, ["", None])).collect()
    assert [r.embedding for r in done] == [[0.0, 0.0]] * 2


def test_models_give_vectors_scores_maps_and_columns(spark):
    def lengths():  # local, so that workers get it whole
        return lambda texts: np.array([[len(t), len(t.split())] for t in texts], float)

    def both():
        return lambda texts: {"a": np.array([len(t) for t in texts], float), "b": np.array([-1.0] * len(texts))}

    frame, model = sentences(spark, ["un deux", "", None]), TextModel(lengths, batch_size=2)
    rows = frame.select(
        KEY, model.vector(F.col("sentence")).alias("v"), model.scores(F.col("sentence")).alias("s"),
        model.score_map(F.col("sentence"), ["Positive", "NEGATIVE"]).alias("m"), StructModel(both, ("a", "b")).predict(F.col("sentence")).alias("c"),
    ).collect()
    assert [r.v for r in rows] == [r.s for r in rows] == [[7.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
    assert rows[0].m == {"Positive": 7.0, "NEGATIVE": 2.0} and tuple(rows[0].c) == (7.0, -1.0)
    encoded = BatchModelEncoder(model).encode(frame)
    assert encoded.columns == [KEY, "sentence", "embedding"] and dict(encoded.dtypes)["embedding"] == "array<float>"
    felt = features.add_sentiment(frame, model.score_map(F.col("sentence"), ["Positive", "NEGATIVE"])).first()
    assert (felt.sentiment_positive, felt.sentiment_negative, felt.sentiment_intensity) == (7.0, 2.0, 5.0)


def test_zero_shot_scores_are_cosines(spark):
    texts = ["impôt impôt loi", "chat", "", None, "loi chat"]
    labels = {"a": "impôt loi", "b": "chat absent", "c": "inconnu"}
    got = {r[KEY]: r.scores for r in zero_shot_scores(sentences(spark, texts), labels).collect()}
    df = {"impôt": 1, "loi": 2, "chat": 2}
    idf = {w: np.log(6 / (1 + n)) + 1 for w, n in df.items()}
    vector = lambda text: np.array([text.split().count(w) * idf[w] for w in idf])
    for i, text in enumerate(texts):
        v = vector(text or "")
        for k, words in enumerate(labels.values()):
            u = vector(words)
            want = v @ u / np.linalg.norm(v) / np.linalg.norm(u) if v.any() and u.any() else 0.0
            assert abs(got[f"k{i}"][k] - want) < 1e-12


def test_abbreviations_are_learnt_and_used(spark):
    texts = ["le dr. Martin et la dr. Petit parlent. la fin.", "voir le dr. Blanc, p.ex. ici et p.ex. là. la fin", None, ""] * 6
    documents = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    learnt = {r.word: r for r in abbreviations.learn_abbreviations(documents).collect()}
    assert {"dr", "p.ex"} <= set(learnt) and not {"fin", "la", "le", "et"} & set(learnt)
    assert learnt["dr"].with_period == 18 and learnt["dr"].without == 0
    known = abbreviations.abbreviation_list(abbreviations.learn_abbreviations(documents))
    assert {"dr", "Dr", "p.ex", "P.ex"} <= set(known)
    text = "Nous avons vu le Dr. Martin hier, p.ex. au marché. Il va bien."
    frame = spark.createDataFrame([(text,)], "t string")
    assert len(frame.select(split_sentences(F.col("t"), known, 1).alias("s")).first().s) == 2
    assert len(frame.select(split_sentences(F.col("t"), ["zz"], 1).alias("s")).first().s) == 4


@pytest.mark.parametrize("limit", [10, 0])
def test_polar_words_inlined_or_joined(spark, limit):
    frame = sentences(spark, ["bon bon mal", "rien", "", None])
    words = [spark.createDataFrame([(w,)], "entry string") for w in ("bon", "mal")]
    got = {r[KEY]: (round(r.sentiment_positive, 6), round(r.sentiment_negative, 6)) for r in features.add_lexicon_sentiment(frame, *words, limit).collect()}
    assert got == {"k0": (0.666667, 0.333333), "k1": (0, 0), "k2": (0, 0), "k3": (0, 0)}


def test_hashed_vectors_keep_their_width(spark):
    done = vectors.HashingEncoder(8).encode(sentences(spark, ["a b a", ""])).collect()
    assert [len(r.embedding) for r in done] == [8, 8] and sum(done[0].embedding) == pytest.approx(1) and sum(done[1].embedding) == 0
