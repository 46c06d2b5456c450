import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.operators import labels as lb
from parlance.operators import lexicon as lx
from parlance.operators import stats as st
from parlance.operators.diagnostics import chi2_upper_tail
from parlance.operators.prefix import quantile_edges, range_prefix, seeded_rank, value_counts
from parlance.operators.sentences import cap_sentences, sentence_table
from parlance.schema import validate_schema
from parlance.sources.corpus import corpus_rejects, read_text_corpus, scan_corpus


def test_corpus_folder(spark, tmp_path):
    folder = tmp_path / "1981" / "legislatives"
    folder.mkdir(parents=True)
    (folder / "doc a+1.txt").write_text("Nous avons un grand projet ici.", encoding="utf-8")
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    docs = read_text_corpus(spark, str(tmp_path))
    row = sentence_table(docs).first()
    assert (row.PRIMARY_KEY, row.date, row.classe) == ("doc a+1_0", "1981", "legislatives")
    assert corpus_rejects(scan_corpus(spark, str(tmp_path))).count() == 1
    with pytest.raises(FileNotFoundError):
        read_text_corpus(spark, str(tmp_path / "missing"))
    (tmp_path / "empty").mkdir()
    assert read_text_corpus(spark, str(tmp_path / "empty")).count() == 0


def test_schema_error_names_columns(spark):
    with pytest.raises(ValueError, match="label"):
        validate_schema(spark.range(1), ["label"], "x")


def test_cap_stops_at_the_first_overflow(spark):
    sizes = {"a": 3, "b": 4, "c": 1}
    rows = [(d, "1981", "l", f"{d}_{i}") for d, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, date string, classe string, PRIMARY_KEY string")
    kept = {r.doc_id for r in cap_sentences(df, 5).select("doc_id").distinct().collect()}
    assert kept == {"a"}
    assert cap_sentences(df, 0).count() == 8


def test_range_prefix_equals_a_plain_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), float(i), rng.randrange(5)) for i in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r.g, r.v): (r.before, r.total) for r in range_prefix(df, ["g"], ["v"], "n", 8).collect()}
    for g in "xy":
        run, mine = 0, sorted(r for r in rows if r[0] == g)
        total = sum(r[2] for r in mine)
        for _, v, n in mine:
            assert got[g, v] == (run, total)
            run += n


def test_seeded_rank_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("y"))
    ranks = seeded_rank(df, ["y"], "k", 7).groupBy("y").agg(F.countDistinct("before").alias("d"), F.max("before").alias("m"), F.max("total").alias("t"))
    assert all(r.d == r.t and r.m == r.t - 1 for r in ranks.collect())


def test_quantile_edges_match_pandas(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(2, 777), 1)
    df = spark.createDataFrame([(float(v), "f") for v in values], "value double, feature string")
    got = quantile_edges(value_counts(df, "feature", "value")).first().edges
    want = np.unique(pd.Series(values).quantile(np.linspace(0, 1, 11)))
    assert np.allclose(got, want, atol=1e-12)


def test_information_value(spark):
    rng = np.random.default_rng(0)
    y = np.array([0] * 500 + [1] * 500)
    rows = [(float(s), 1.0, float(z), int(t)) for s, z, t in zip(rng.normal(y * 2.0), rng.normal(size=1000), y)]
    df = spark.createDataFrame(rows, "strong double, flat double, noise double, y int")
    iv = {r.feature: r.iv for r in st.information_value(df, ["strong", "flat", "noise"]).collect()}
    assert iv["strong"] > 0.5 and iv["flat"] == 0 and iv["noise"] < 0.1


def test_threshold_and_auc(spark):
    rng = random.Random(2)
    rows = [(y, round(min(max(rng.gauss(0.35 + 0.3 * y, 0.2), 0.0), 1.0), 2)) for y in (0, 1) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, proba double")
    best = min((sum(4 * (p >= t and y == 0) + (p < t and y == 1) for y, p in rows), t) for t in st.threshold_grid())
    got = st.calibrate_threshold(df, cost_fp=4.0).first()
    assert (got.risk, got.threshold) == (best[0], best[1])
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    assert math.isclose(st.roc_auc(df).first().auc_roc, sum(pairs) / len(pairs))
    assert math.isnan(st.roc_auc(df.where("y = 1")).first().auc_roc)


def test_labels(spark):
    rows = [("a", " ", 0), ("a", "autre", 2), ("a", "langue_de_bois", 1), ("b", None, 3), ("c", "NA", 4)]
    sheet = spark.createDataFrame(rows, "PRIMARY_KEY string, label string, line int")
    assert [tuple(r) for r in lb.clean_labels(sheet, "line").collect()] == [("a", "langue_de_bois")]
    with pytest.raises(ValueError, match="oops"):
        lb.check_labels(spark.createDataFrame([("oops",)], "label string"))


def test_lexicon_join_equals_inline(spark):
    docs = spark.createDataFrame([("a", "le bien commun du pays"), ("b", "")], "doc_id string, lemma_text string")
    entries = ["bien commun", "en", "pays", "zzz", "d"]
    table = spark.createDataFrame([(e,) for e in entries], "entry string")
    one = sorted(map(tuple, lx.lexicon_score(docs, entries).select("doc_id", "n_hits", "score").collect()))
    two = sorted(map(tuple, lx.lexicon_score(docs, table, max_inline=0).select("doc_id", "n_hits", "score").collect()))
    assert one == two == [("a", 4, 80.0), ("b", 0, 0.0)]


def test_chi_square_tail():
    assert math.isclose(chi2_upper_tail(15.507313, 8), 0.05, rel_tol=1e-5)
    assert math.isclose(chi2_upper_tail(14.067140, 7), 0.05, rel_tol=1e-5)
