"""Steps that were changed to scale: whole results, bounded batches, rows that stay where they are."""

import os
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.operators import patterns
from parlance.operators.corpus_vectors import CorpusVectorEncoder
from parlance.operators.entities import entity_counts
from parlance.operators.features import add_lexicon_hits
from parlance.operators.vectors import HashingEncoder
from parlance.operators.zero_shot import zero_shot_scores
from parlance.plans import catalog
from parlance.schema import ENTITY_FEATURES, KEY
from parlance.session import scratch_path
from parlance.sources import tables
from parlance.sources.corpus import scan_corpus

TEXTS = ["a b a c", "b c d", "a a b", "d e f a", "a b a c", "", "c b a d e"]


def sentences(spark):
    return spark.createDataFrame([(str(i % 6), t) for i, t in enumerate(TEXTS)], f"{KEY} string, sentence string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_held_and_joined_vocabularies_give_the_same_vectors(spark):
    got = [
        sorted((r[0], r.sentence, [round(abs(x), 4) for x in r.embedding]) for r in CorpusVectorEncoder(2, 2, 1, 2, max_held=m).encode(sentences(spark)).collect())
        for m in (100, 0)
    ]
    assert got[0] == got[1] and len(got[0]) == len(TEXTS)


def test_zero_shot_scores_do_not_depend_on_how_many_words_are_held(spark):
    labels = {"x": "a b", "y": "e missing"}
    got = [
        sorted((r[0], r.sentence, [round(x, 9) for x in r.scores]) for r in zero_shot_scores(sentences(spark), labels, max_held=m).collect())
        for m in (100, 1, 0)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(TEXTS)


def test_corpus_files_are_listed_by_tasks(spark, tmp_path):
    folder = tmp_path / "1981" / "x"
    folder.mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("_b.txt", "no"), (".c.txt", "no"), ("d.md", "no"), ("e.txt", ""), ("f.txt", "two")):
        (folder / name).write_text(text)
    files = scan_corpus(spark, str(tmp_path))
    assert {(r.path, bytes(r.content)) for r in files.collect()} == {(f"file:{folder}/{n}.txt", c) for n, c in (("a", b"one"), ("f", b"two"))}
    assert "binaryFile" not in plan(files)


def test_contexts_go_on_in_bounded_batches():
    class Held:
        value = (patterns.automaton(["aa", "bb"]), ["aa", "bb"])

    n = 20_000
    batch = pa.record_batch([pa.array(range(n)), pa.array(["aa bb"] * n), pa.array(["aa bb"] * n)], names=["doc_id", "_text", "lemma_text"])
    sizes = [b.num_rows for b in patterns._contexts(Held, 60)(iter([batch]))]
    assert sum(sizes) == 2 * n and max(sizes) <= patterns.RESULT_ROWS + 2


def test_hashed_means_are_not_worked_out_place_by_place(spark):
    encoded = HashingEncoder(8).encode(sentences(spark))
    assert "transform(" not in plan(encoded.select("embedding"))
    totals = {r.sentence: round(sum(r.embedding), 6) for r in encoded.collect()}
    assert all(total == (1.0 if text else 0.0) for text, total in totals.items())


def test_joined_hits_move_rows_but_not_texts_of_tokens(spark):
    hits = add_lexicon_hits(sentences(spark), ["a", "e"], "n", "r", max_inline=0)
    got = sorted((r.sentence, r.n, round(r.r, 6)) for r in hits.collect())
    assert got == sorted((t, sum(w in "ae" for w in t.split()), round(sum(w in "ae" for w in t.split()) / max(len(t.split()), 1), 6)) for t in TEXTS)
    assert "sha2" not in plan(hits)


def test_overlapping_entities_inlined_and_walked(spark):
    phrases = [("a", "ORG"), ("a b", "LOC"), ("b a", "LAW"), ("a b a", "GPE"), ("c", "PER")]
    one, two = (sorted(tuple(r) for r in entity_counts(sentences(spark), phrases, m).select(KEY, "sentence", *ENTITY_FEATURES).collect()) for m in (100, 0))
    assert one == two
    assert [r[2:] for r in one if r[1] == "a b a c"] == [(0, 1, 0, 2)] * 2


def _shuffled(spark):
    """Shuffle files that are still on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stage_in_slices_is_whole_and_leaves_no_shuffle_files(spark, monkeypatch):
    left = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("k"), F.col("id") % 1000)).alias(KEY), F.repeat(F.lit("x"), 90).alias("text"))
    right = spark.range(500).select(F.concat(F.lit("k"), F.col("id") * 2).alias(KEY), F.array(F.col("id").cast("float")).alias("embedding"))
    joined = left.hint("merge").join(right, KEY, "left")
    before, marked = _shuffled(spark), []
    path = scratch_path(spark, "slices")
    tables.write_stage(joined, path, slices=3)
    deadline = time.monotonic() + 20  # executors delete them a moment later
    while not _shuffled(spark) <= before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert _shuffled(spark) <= before
    got = spark.read.parquet(path)
    assert got.exceptAll(joined).count() == 0 and got.count() == joined.count() == 3000
    assert os.path.exists(f"{path.removeprefix('file:')}/_SUCCESS")

    class Stopped(Exception):
        pass

    def stop_after_one(*_):
        if marked:
            raise Stopped
        marked.append(1)
        return xxhash64(KEY)

    xxhash64 = F.xxhash64
    monkeypatch.setattr(tables.F, "xxhash64", stop_after_one)
    path = scratch_path(spark, "slices")
    with pytest.raises(Stopped):
        tables.write_stage(joined, path, slices=3)
    assert not os.path.exists(f"{path.removeprefix('file:')}/_SUCCESS")


def test_the_chain_keeps_only_what_is_read_again(spark, tmp_path, monkeypatch):
    text = "Nous voulons une politique nouvelle pour le pays. Il faut une grande paix pour la France."
    docs = [(i, text, ("fr", "en")[i % 2], "web", len(text)) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 3 % 2, int(i == 5)) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(tables, "_SLICE_BYTES", 1000)
    root = scratch_path(spark, "one-chain")
    monkeypatch.setattr(catalog, "scratch_path", lambda *_: root)
    done = catalog.QUERIES["chain_labelled"](spark, str(tmp_path))
    kept = {str(p.relative_to(root.removeprefix("file:"))) for p in Path(root.removeprefix("file:")).glob("*/*") if p.is_dir()}
    assert kept == {"stages/final", "stages/final_labeled", "stages/final_labeled_2class"}
    label = lambda i: ("non_langue_de_bois", "langue_de_bois")[i % 3 % 2] if i < 30 else None
    want = sorted((f"{i}_{k}", label(i)) for i in range(40) if i != 5 for k in range(2))
    assert sorted((r[KEY], r.label) for r in done.collect()) == want
    assert {(r.n_dims, r.total) for r in done.collect()} == {(16, 1.0)}
