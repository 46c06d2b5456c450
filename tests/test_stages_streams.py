"""Stage tables, corpus files, the event stream and grouped splits."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import labels, sentences, stats, views
from parlance.schema import KEY
from parlance.sources import corpus, tables
from parlance.streaming import events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- stages -------------------------------------------------------------------------


def test_a_stage_is_skipped_forced_and_written_again_when_half_done(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert tables.materialize(spark, lambda: build(3), path).count() == 3
    assert tables.materialize(spark, lambda: build(4), path).count() == 3 and built == [3]
    assert tables.materialize(spark, lambda: build(5), path, True).count() == 5 and built == [3, 5]
    os.remove(f"{path}/_SUCCESS")  # as after a job that died while writing
    assert tables.materialize(spark, lambda: build(6), path).count() == 6 and built == [3, 5, 6]
    with pytest.raises(ZeroDivisionError):
        tables.materialize(spark, lambda: build(1 // 0), path, True)
    assert spark.read.parquet(path).count() == 6


def test_norms_are_read_from_tab_separated_lines(spark, tmp_path):
    (tmp_path / "norms.tsv").write_text('Word\tConc.M\tother\nchaise\t4.9\tx\nidée\t1.6\ty\n"mot"\tn/a\tz\nvide\t\t\n', "utf-8")
    rows = tables.read_norms(spark, str(tmp_path / "norms.tsv")).orderBy("line").collect()
    assert [(r.word, r.conc_m) for r in rows] == [("chaise", 4.9), ("idée", 1.6), ("mot", None), ("vide", None)]
    with pytest.raises(FileNotFoundError):
        tables.read_norms(spark, str(tmp_path / "absent.tsv"))


def test_bucketed_stages_merge_without_exchange_and_prune_folders(spark, tmp_path):
    rows = [(f"k{i}", "fr" if i % 3 else "en", "s", float(i)) for i in range(200)]
    features = spark.createDataFrame(rows, f"{KEY} string, date string, classe string, x double")
    vectors = features.where("x % 5 > 0").select(KEY, F.array("x").alias("embedding"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = tables.write_bucketed(features, "t_features", str(tmp_path / "f"), KEY, 4, ["date", "classe"])
        right = tables.write_bucketed(vectors, "t_vectors", str(tmp_path / "v"), KEY, 4)
        sheet = tables.write_bucketed(features.select(KEY, F.lit("autre").alias("label")), "t_labels", str(tmp_path / "l"), KEY, 4)
        merged = labels.merge_features(left, right)
        done = labels.apply_labels(merged, sheet)
        assert "Exchange" not in plan(merged) and "Exchange" not in plan(done)
        assert done.count() == 200 and done.where("embedding is null").count() == 40
        view = views.filter_corpus(left, date="fr")
        assert "PartitionFilters: [isnotnull(date" in plan(view).replace("\n", " ") and view.count() == 133
        spark.sql("DROP TABLE t_features")
        again = tables.open_bucketed(spark, "t_features", str(tmp_path / "f"), features.schema, KEY, 4, ["date", "classe"])
        assert "Exchange" not in plan(labels.merge_features(again, right)) and again.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("t_features", "t_vectors", "t_labels"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- corpus files -------------------------------------------------------------------


def test_corpus_files_are_written_and_scanned(spark, tmp_path):
    texts = [("1981/legislatives/a.txt", "Un texte.".encode()), ("1988/presidentielle/b-1.txt", "été".encode()), ("1988/presidentielle/bad.txt", b"x\xff"),
             ("1988/presidentielle/note.md", b"no text"), ("1988/presidentielle/empty.txt", None)]
    root = f"file://{tmp_path}/corpus"
    assert corpus.write_corpus(spark.createDataFrame(texts, "path string, content binary"), root) == 5
    got = {(r.date, r.classe, r.doc_id, r.file_name, r.text) for r in corpus.read_text_corpus(spark, root).collect()}
    assert got == {
        ("1981", "legislatives", "a", "a.txt", "Un texte."), ("1988", "presidentielle", "b-1", "b-1.txt", "été"),
    }  # Spark's file listing leaves out files of no length
    levels = {(r.level, r.date, r.classe): r for r in sentences.noise_rollup(corpus.scan_corpus(spark, root)).collect()}
    assert set(levels) == {(0, "1981", "legislatives"), (0, "1988", "presidentielle"), (1, "1981", None), (1, "1988", None), (3, None, None)}
    whole = levels[3, None, None]
    assert (whole.n_files, whole.n_unreadable) == (3, 1) and levels[1, "1988", None].n_unreadable == 1


# --- event stream -------------------------------------------------------------------

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_drops_repeats_counts_late_rows_and_survives_a_replay(spark, tmp_path):
    rng = random.Random(3)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(i, START + dt.timedelta(hours=i), rng.choice("ab"), float(i)) for i in range(24 * 8)]
    schema = spark.createDataFrame([], SCHEMA).schema
    write(spark, rows[:100] + rows[50:100], source)
    run = events.start_totals(spark, source, out, state, schema)
    run.awaitTermination()
    first = events.read_totals(spark, out).count()
    assert events.late_rows(run) == 0 and 0 < first
    write(spark, rows[90:], source)
    write(spark, [(1000 + i, *rows[i][1:]) for i in range(30)] + [(9999, START + dt.timedelta(days=20), "a", 0.0)], source)
    run = events.start_totals(spark, source, out, state, schema)
    run.awaitTermination()
    assert events.late_rows(run) == 30 and events.state_rows(run) < 5  # old keys and windows are gone
    got = sorted((r.start, r.kind, r.n, r.total) for r in events.read_totals(spark, out).collect())
    want = {}
    for _, ts, kind, value in rows:
        n, total = want.get((ts.replace(hour=0), kind), (0, 0.0))
        want[ts.replace(hour=0), kind] = (n + 1, total + value)
    assert got == sorted((*k, *v) for k, v in want.items())

    batches = sorted((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    os.remove(f"{state}/commits/{batches[-1]}")  # the last batch looks unfinished and runs again
    for extra in (f"{state}/commits/.{batches[-1]}.crc",):
        if os.path.exists(extra):
            os.remove(extra)
    run = events.start_totals(spark, source, out, state, schema)
    run.awaitTermination()
    assert sorted((r.start, r.kind, r.n, r.total) for r in events.read_totals(spark, out).collect()) == got


# --- grouped splits -----------------------------------------------------------------


@pytest.mark.parametrize("sizes", [[1] * 50, [30, 1, 1, 2, 9, 9, 4], [5]])
def test_groups_stay_whole_and_shares_are_near(spark, sizes):
    rng = random.Random(1)
    rows, kinds = [], {}
    for g, n in enumerate(sizes * 3):
        kind = g % 3
        ys = [kind] * n if kind < 2 else [j % 2 for j in range(max(n, 2))]
        kinds[str(g)] = (kind, len(ys))
        rows += [(f"{g}_{j}", str(g), y) for j, y in enumerate(ys)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, f"{KEY} string, doc_id string, y int")
    split = stats.stratified_split(frame, group_by="doc_id").select("doc_id", "split").distinct().collect()
    fold = stats.stratified_folds(frame, 3, group_by="doc_id").select("doc_id", "fold").distinct().collect()
    assert len(split) == len(fold) == len(kinds)
    for kind in range(3):
        mine = {g: n for g, (k, n) in kinds.items() if k == kind}
        total, most = sum(mine.values()), max(mine.values())
        for name, share in (("test", 0.15), ("val", 0.15), ("train", 0.7)):
            assert abs(sum(mine.get(r.doc_id, 0) for r in split if r.split == name) - share * total) <= most
        for k in range(3):
            assert abs(sum(mine.get(r.doc_id, 0) for r in fold if r.fold == k) - total / 3) <= most


def test_rows_without_a_group_are_one_group(spark):
    frame = spark.createDataFrame([(f"k{i}", None if i % 2 else f"g{i}", i % 2) for i in range(40)], f"{KEY} string, doc_id string, y int")
    done = stats.grouped_folds(frame, "doc_id").where("doc_id is null")
    assert done.count() == 20 and done.select("fold").distinct().count() == 1
