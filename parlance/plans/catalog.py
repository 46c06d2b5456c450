"""Registered queries: every operator on the given tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import features as fx
from parlance.functions.text import tokens
from parlance.operators import abbreviations as ab
from parlance.operators import diagnostics as dg
from parlance.operators import features as ft
from parlance.operators import labels as lb
from parlance.operators import lexicon as lx
from parlance.operators import models as md
from parlance.operators import sentences as sn
from parlance.operators import stats as st
from parlance.operators import vectors as vc
from parlance.operators import views as vw
from parlance.operators.adapter import BatchModelEncoder, StructModel, TextModel
from parlance.operators.corpus_vectors import CorpusVectorEncoder
from parlance.operators.entities import entity_counts
from parlance.operators.zero_shot import zero_shot_scores
from parlance.plans import inputs as q
from parlance.plans import pipeline as pl
from parlance.plans.pipeline import train_job
from parlance.schema import (
    ENTITY_FEATURES,
    KEY,
    LINGUISTIC_FEATURES,
    META,
    SENTIMENT_FEATURES,
    VAGUE_FEATURES,
)
from parlance.schema import NEG_LABEL, POS_LABEL
from parlance.session import release, scratch_path
from parlance.sources import corpus as cp
from parlance.sources import tables as tb
from parlance.streaming.annotate import read_annotations, start_annotation
from parlance.streaming.events import RESULT, late_rows, read_totals, start_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAP = 2_500
SAMPLE_TARGET = 1_100


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


# --- sources, sinks -----------------------------------------------------------------


def _corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents as the files of a corpus folder; toxic ones get a broken byte."""
    toxic = (
        q.document_labels(spark, d).where(F.col("toxic") == 1).select("doc_id", F.lit(1).alias("bad"))
    )
    docs = q.documents(spark, d).join(toxic, "doc_id", "left")
    path = F.concat(F.lit("file:/corpus/"), "date", F.lit("/"), "classe", F.lit("/"), "doc_id", F.lit(".txt"))
    content = F.encode("text", "UTF-8")
    broken = F.concat(content, F.unhex(F.lit("FF")))
    return docs.select(
        path.alias("path"), F.when(F.col("bad") == 1, broken).otherwise(content).alias("content")
    )


@query
def read_text_corpus(spark, d):
    """The documents written as files of a corpus folder, and the folder scanned."""
    root = scratch_path(spark, "corpus")
    relative = F.regexp_replace("path", "^file:/corpus/", "").alias("path")
    cp.write_corpus(_corpus_files(spark, d).select(relative, "content"), root)
    return cp.read_text_corpus(spark, root)


@query
def corpus_rejects(spark, d):
    return cp.corpus_rejects(_corpus_files(spark, d))


def _pages(spark, d):
    """Turns as pages; every other page has an earlier transcription too."""
    turns = q.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")
    first = turns.select("doc", "page_no", F.lit(7).alias("transcription_id"), "text")
    earlier = turns.where("page_no % 2 = 1").select("doc", "page_no", F.lit(3), F.concat("text", F.lit(" (first)")))
    return first.union(earlier)


@query
def assemble_documents(spark, d):
    return cp.assemble_documents(_pages(spark, d))


@query
def element_counts(spark, d):
    pages = q.table(spark, d, "conversations")
    elements = (
        pages.select("conv_id").distinct().select(F.lit("document").alias("type"))
        .union(pages.select(F.lit("page")))
        .union(pages.where(F.col("text") != "").select(F.lit("transcription")))
    )
    return cp.element_counts(elements)


@query
def stage_roundtrip(spark, d):
    path = scratch_path(spark, "sentences")
    tb.materialize(spark, lambda: q.sentences(spark, d), path, partition_by=["date"])
    stored = tb.read_partitioned(spark, path, ["date"])
    return stored.select("doc_id", KEY, "date", "classe", "sent_idx", "sentence", "filter_ratio")


def _sheet(spark, d):
    """Label rows with an order column: blanks, repeats and a second opinion."""
    labels = q.table(spark, d, "labels")
    key = F.col("doc_id").cast("string").alias(KEY)
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), POS_LABEL)
        .when(F.col("toxic") == 0, NEG_LABEL)
        .when(F.col("quality") == 1, "  ")
        .alias("label")
    )
    first = labels.select(key, label, F.col("doc_id").alias("ord"))
    second = labels.select(key, F.lit("autre").alias("label"), (F.col("doc_id") + 10**9).alias("ord"))
    return first.union(second)


@query
def read_labels(spark, d):
    path = scratch_path(spark, "labels")
    tb.write_labels(_sheet(spark, d).select(KEY, "label", "ord"), path)
    return tb.read_labels(spark, path, [KEY, "label"]).select(KEY, "label", "ord")


@query
def load_lexicon(spark, d):
    lines = q.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lx.parse_lexicon(lines)


def _part_lexicons(spark, d):
    part = q.table(spark, d, "part")
    return (
        part.select(F.lower("p_name").alias("entry")),
        part.select(F.lower("p_type").alias("entry")),
        part.select(F.lower("p_brand").alias("entry")),
    )


@query
def merge_lexicons(spark, d):
    return lx.merge_lexicons(*_part_lexicons(spark, d))


# --- cleaning and segmentation ------------------------------------------------------


@query
def admin_lines(spark, d):
    return sn.administrative_lines(q.documents(spark, d)).select("doc_id", "line_no", "is_admin")


@query
def filter_ratio(spark, d):
    return sn.clean_documents(q.documents(spark, d)).select("doc_id", "filter_ratio")


@query
def clean_text(spark, d):
    pages = q.table(spark, d, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("doc_id"), F.col("html").alias("text")
    )
    everything = q.documents(spark, d).select("doc_id", "text").union(pages)
    return sn.clean_documents(everything).select("doc_id", "text")


@query
def split_sentences(spark, d):
    return q.sentences(spark, d).select(KEY, "sentence")


@query
def sentences_table(spark, d):
    return q.sentences(spark, d)


@query
def cap_sentences(spark, d):
    return sn.cap_sentences(q.stored_sentences(spark, d), CAP).select(KEY, "doc_id", "date", "classe")


@query
def stratum_noise(spark, d):
    return sn.stratum_noise(q.documents(spark, d))


@query
def noise_rollup(spark, d):
    return sn.noise_rollup(_corpus_files(spark, d))


@query
def corpus_noise(spark, d):
    return sn.corpus_noise(q.sentences(spark, d))


# --- features -----------------------------------------------------------------------


@query
def concreteness(spark, d):
    return ft.add_concreteness(q.sentences(spark, d)).select(
        KEY, "n_digits", "n_dates", "n_money", "n_percent", *_rounded("numeric_ratio")
    )


@query
def vague_words(spark, d):
    return ft.add_vague_words(q.sentences(spark, d), q.VAGUE).select(
        KEY, "n_vague_words", *_rounded("vague_ratio")
    )


@query
def modal_verbs(spark, d):
    return ft.add_modal_verbs(q.sentences(spark, d), q.MODAL).select(
        KEY, "n_modal_verbs", *_rounded("modal_ratio")
    )


@query
def entity_counts_(spark, d):
    return entity_counts(q.sentences(spark, d), q.GAZETTEER).select(KEY, *ENTITY_FEATURES)


QUERIES["entity_counts"] = QUERIES.pop("entity_counts_")


@query
def entity_counts_large(spark, d):
    """Words of the benchmark as places, pairs of neighbouring words as organisations."""
    words = q.table(spark, d, "benchmark").select(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0)").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    one = words.select(F.explode("w").alias("phrase"), F.lit("LOC").alias("type"))
    two = words.where(F.size("w") > 1).select(F.explode(pairs).alias("phrase"), F.lit("ORG").alias("type"))
    counts = entity_counts(q.sentences(spark, d), one.unionByName(two).distinct(), max_inline=100)
    return counts.select(KEY, *ENTITY_FEATURES)


@query
def vague_words_table(spark, d):
    hits = ft.add_lexicon_hits(q.sentences(spark, d), q.VAGUE, *VAGUE_FEATURES, max_inline=0)
    return hits.select(KEY, "n_vague_words", *_rounded("vague_ratio"))


@query
def entity_counts_table(spark, d):
    counts = entity_counts(q.sentences(spark, d), q.GAZETTEER, max_inline=0)
    return counts.select(KEY, *ENTITY_FEATURES)


@query
def sentiment_scores(spark, d):
    words = tokens(F.lower("sentence"))
    tokenised = q.sentences(spark, d).withColumn("_tokens", words)
    scores = fx.lexicon_sentiment_scores(F.col("_tokens"), q.POSITIVE, q.NEGATIVE)
    return ft.add_sentiment(tokenised, scores).select(KEY, *_rounded(*SENTIMENT_FEATURES))


@query
def feature_table(spark, d):
    counts = [f for f in LINGUISTIC_FEATURES if f.startswith("n_")]
    ratios = [f for f in LINGUISTIC_FEATURES if not f.startswith("n_")]
    return q.full_features(q.sentences(spark, d)).select(
        KEY, *META, "sentence", *counts, *_rounded(*ratios)
    )


@query
def encode_sentences(spark, d):
    encoded = vc.HashingEncoder().encode(q.sentences(spark, d))
    # Zeros add nothing, and nearly all places of a hashed vector are zero.
    total = F.aggregate(F.array_remove("embedding", F.lit(0.0).cast("float")), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return encoded.select(
        KEY, F.size("embedding").cast("long").alias("n_dims"), F.round(total, 3).alias("total")
    )


@query
def encode_corpus_vectors(spark, d):
    encoder = CorpusVectorEncoder(dimensions=2, window=2, min_count=20, rounds=2)
    encoded = encoder.encode(q.sentences(spark, d))
    return encoded.select(KEY, *[F.round(F.col("embedding")[i].cast("double"), 5).alias(f"v{i}") for i in range(2)])


def _letters():
    return TextModel(q.letter_shares)


@query
def model_embedding(spark, d):
    encoded = BatchModelEncoder(_letters()).encode(q.sentences(spark, d))
    cells = encoded.select(KEY, F.posexplode("embedding").alias("dim", "value"))
    return cells.select(KEY, F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def model_label_scores(spark, d):
    scored = q.sentences(spark, d).withColumn("scores", _letters().scores(F.col("sentence")))
    kept = F.slice("scores", 1, 3)
    return scored.select(KEY, lb.argmax_label(kept).alias("label"), F.round(F.array_max(kept), 6).alias("score"))


@query
def model_sentiment(spark, d):
    scores = _letters().score_map(F.col("sentence"), q.SENTIMENT_LABELS)
    return ft.add_sentiment(q.sentences(spark, d), scores).select(KEY, *_rounded(*SENTIMENT_FEATURES))


@query
def model_struct(spark, d):
    model = StructModel(q.letter_totals, ("vowels", "letters"))
    return q.sentences(spark, d).select(KEY, model.predict(F.col("sentence")).alias("m")).select(KEY, "m.*")


@query
def zero_shot_label(spark, d):
    scored = zero_shot_scores(q.sentences(spark, d), q.DESCRIPTIONS)
    rounded = F.transform("scores", lambda x: F.round(x, 6))
    return scored.withColumn("scores", rounded).select(KEY, lb.argmax_label(F.col("scores")).alias("label"), F.array_max("scores").alias("score"))


@query
def learn_abbreviations(spark, d):
    return ab.learn_abbreviations(q.documents(spark, d)).select("word", "with_period", "without", *_rounded("score"))


@query
def sentences_learnt(spark, d):
    docs = q.documents(spark, d)
    known = ab.abbreviation_list(ab.learn_abbreviations(docs))
    return sn.sentence_table(docs, abbreviations=known).select(KEY, "sentence")


@query
def mean_pooling(spark, d):
    vectors = q.document_vectors(spark, d)
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding"), i * 8 + 1, 8)
    )
    mask = F.transform(F.col("token_vectors"), lambda v: (F.get(v, F.lit(0)) > 0).cast("int"))
    shaped = vectors.select(KEY, rows.alias("token_vectors")).withColumn("mask", mask)
    pooled = shaped.select(KEY, vc.mean_pooling(F.col("token_vectors"), F.col("mask")).alias("v"))
    return pooled.select(KEY, F.posexplode("v").alias("dim", "value")).select(
        KEY, F.col("dim").cast("long").alias("dim"), *_rounded("value")
    )


def _document_rows(spark, d):
    """Documents as the rows to join on, keyed by their id."""
    return q.documents(spark, d).select(
        F.col("doc_id").alias(KEY), "doc_id", "date", "classe", F.col("text").alias("sentence")
    )


@query
def embedding_table(spark, d):
    encoded = _document_rows(spark, d).join(q.document_vectors(spark, d), KEY, "left")
    stored = vc.embedding_table(encoded)
    return stored.select(KEY, *META, F.posexplode_outer("embedding").alias("dim", "value")).select(
        KEY, *META, F.col("dim").cast("long").alias("dim"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


def _with_document_vectors(spark, d, df):
    """All rows; those of a document without a vector have a null one."""
    vectors = q.document_vectors(spark, d).withColumnRenamed(KEY, "doc_id")
    return df.join(vectors, "doc_id", "left")


def _by_place(values):
    """Sum of the values times their places: tells the order."""
    pairs = F.transform(values, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


@query
def assemble_vector(spark, d):
    full = _with_document_vectors(spark, d, q.full_features(q.sentences(spark, d)))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), q.VECTOR_SIZE)
    filled = full.withColumn("has_vector", F.col("embedding").isNotNull()).withColumn("embedding", F.coalesce("embedding", zeros))
    values = vc.assemble_vector(filled).select(KEY, "has_vector", vector_to_array("features").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return values.select(
        KEY, "has_vector", F.size("v").cast("long").alias("n_dims"), F.round(total + q.OFF_TIES, 4).alias("total"),
        F.round(_by_place(F.col("v")) + q.OFF_TIES, 3).alias("by_place"),
    )


# --- joins, labels, sampling --------------------------------------------------------


@query
def merge_features(spark, d):
    merged = lb.merge_features(_document_rows(spark, d), q.document_vectors(spark, d))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return merged.select(
        KEY, *META, F.size("embedding").cast("long").alias("n_dims"), F.round(total, 4).alias("total")
    )


@query
def key_gaps(spark, d):
    return lb.key_gaps(_document_rows(spark, d), q.document_vectors(spark, d))


def _clean(spark, d):
    return lb.clean_labels(_sheet(spark, d), "ord")


@query
def clean_labels(spark, d):
    return _clean(spark, d)


@query
def invalid_labels(spark, d):
    label = F.when(F.col("toxic") == 1, F.concat(F.lit("toxic "), "quality")).otherwise(POS_LABEL)
    return lb.invalid_labels(q.table(spark, d, "labels").select(label.alias("label")))


def _labelled_documents(spark, d):
    rows = _document_rows(spark, d).drop("sentence")
    return lb.apply_labels(rows, _clean(spark, d))


@query
def apply_labels(spark, d):
    return _labelled_documents(spark, d)


@query
def labelled_counts(spark, d):
    return lb.labelled_counts(_labelled_documents(spark, d))


@query
def two_class_view(spark, d):
    return lb.two_class_view(_labelled_documents(spark, d))


@query
def label_counts(spark, d):
    return lb.label_counts(_clean(spark, d))


@query
def sample_documents(spark, d):
    return lb.sample_documents(q.stored_sentences(spark, d), SAMPLE_TARGET).select(KEY, *META)


@query
def annotation_sheet(spark, d):
    return lb.annotation_sheet(lb.sample_documents(q.stored_sentences(spark, d), SAMPLE_TARGET))


def _label_scores(df):
    return df.withColumn(
        "scores",
        F.array(
            F.round("vague_ratio", 6),
            F.round(F.col("numeric_ratio") + F.col("modal_ratio"), 6),
            F.round(F.col("filter_ratio") / 2, 6),
        ),
    )


@query
def argmax_label(spark, d):
    scored = _label_scores(q.rule_features(q.sentences(spark, d)))
    return scored.select(KEY, lb.argmax_label(F.col("scores")).alias("label"))


def _half_sheet(spark, d):
    """An annotation sheet over the documents, filled where a label is known."""
    labels = _clean(spark, d)
    rows = lb.apply_labels(_document_rows(spark, d), labels)
    return rows.withColumn("label", F.coalesce("label", F.lit(" ")))


@query
def pending_annotations(spark, d):
    return lb.pending_annotations(_half_sheet(spark, d)).select(KEY, "date", "classe", "label")


@query
def merge_bucketed(spark, d):
    """Features and vectors as bucketed stages, merged without an exchange; French rows only."""
    root = scratch_path(spark, "bucketed")
    rows = q.rule_features(q.sentences(spark, d))
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("features", "vectors")]
    buckets = max(8, spark.sparkContext.defaultParallelism)
    features = tb.write_bucketed(rows, names[0], f"{root}/features", KEY, buckets, ["date"])
    vectors = features.select(KEY, F.array(F.col("n_digits").cast("float"), F.col("vague_ratio").cast("float")).alias("embedding"))
    embeddings = tb.write_bucketed(vectors, names[1], f"{root}/vectors", KEY, buckets)
    merged = lb.merge_features(vw.filter_corpus(features, date="fr"), embeddings)
    return merged.select(KEY, "date", "classe", F.size("embedding").cast("long").alias("n_dims"), *_rounded("vague_ratio"))


@query
def update_labels(spark, d):
    new = q.table(spark, d, "labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias(KEY), F.lit("autre").alias("label")
    )
    return lb.update_labels(_half_sheet(spark, d), new).select(KEY, "label")


@query
def annotation_stats(spark, d):
    return lb.annotation_stats(_half_sheet(spark, d))


@query
def stream_annotate(spark, d):
    source, output, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "state"))
    featured = _label_scores(q.rule_features(q.sentences(spark, d))).select(KEY, "scores")
    featured.write.parquet(source)
    run = start_annotation(
        spark, source, output, checkpoint, lb.argmax_label(F.col("scores")), featured.schema,
        files_per_trigger=4,
    )
    run.awaitTermination()
    return read_annotations(spark, output)


@query
def stream_event_totals(spark, d):
    """Events in files by time, each with its repeats, and old rows at the end; see EventTime."""
    source, output, checkpoint = (scratch_path(spark, n) for n in ("events-in", "events-out", "events-state"))
    instant = F.expr("cast(convert_timezone('UTC', current_timezone(), cast(ts AS timestamp_ntz)) AS timestamp)")
    events = q.table(spark, d, "events").select("event_id", instant.alias("ts"), "event_type", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    n = 5
    edges = [first + (last - first) * i / n for i in range(n + 1)]
    late = events.where(F.col("ts") < edges[1]).select((F.col("event_id") + 10**9).alias("event_id"), "ts", "event_type", "value")
    for i in range(n):  # files come in the order in which they were written
        here = (F.col("ts") >= F.lit(edges[i])) & ((F.col("ts") < F.lit(edges[i + 1])) if i < n - 1 else F.lit(True))
        part = events.where(here)
        repeats = part.where(F.col("ts") >= F.lit(edges[i + 1]) - F.expr("INTERVAL 12 HOURS"))
        rows = part.unionByName(part).unionByName(late) if i == n - 1 else part.unionByName(repeats)
        rows.coalesce(1).write.mode("append").parquet(source)
    run = start_totals(spark, source, output, checkpoint, events.schema)
    run.awaitTermination()
    n_late = spark.createDataFrame([(None, "late", late_rows(run), None)], RESULT)
    start = F.expr("convert_timezone(current_timezone(), 'UTC', cast(start AS timestamp_ntz))").alias("start")
    return read_totals(spark, output).unionByName(n_late).select(start, "kind", "n", *_rounded("total", digits=4))


@query
def chain_labelled(spark, d):
    """Corpus files to the two-class table, stage by stage: every sentence has its document's label.

    Every stage is written whole; one that no later stage reads goes before the next one comes.
    """
    root = scratch_path(spark, "chain")
    relative = F.regexp_replace("path", "^file:/corpus/", "").alias("path")
    slices = tb.slices_of(spark, f"{d}/documents.parquet")
    cp.write_corpus(_corpus_files(spark, d).select(relative, "content"), f"{root}/corpus", slices)
    out = pl.Paths(f"{root}/stages")
    rows = pl.sentences_stage(spark, f"{root}/corpus", out)
    release(spark, f"{root}/corpus")
    features = pl.features_stage(spark, rows, out, q.VAGUE, q.GAZETTEER, q.POSITIVE, q.NEGATIVE)
    embeddings = pl.embeddings_stage(spark, rows, out, vc.HashingEncoder(16))
    final = pl.merge_stage(spark, features, embeddings, out)
    sheet = rows.join(q.document_labels(spark, d).select("doc_id", "label"), "doc_id").select(KEY, "label")
    tb.write_labels(sheet, f"{root}/labels.csv")
    for stage in (out.sentences, out.features, out.embeddings):
        release(spark, stage)
    _, two = pl.label_stage(spark, final, f"{root}/labels.csv", out)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return two.select(KEY, "date", "classe", "label", "n_vague_words", F.size("embedding").cast("long").alias("n_dims"), F.round(total, 3).alias("total"))


# --- splits, selection, training ----------------------------------------------------


@query
def labeled_target(spark, d):
    return st.labelled_target(q.labelled_sentences(spark, d)).select(KEY, "label", "y")


@query
def stratified_split(spark, d):
    return st.stratified_split(st.labelled_target(q.labelled_sentences(spark, d))).select(
        KEY, "y", "split"
    )


@query
def stratified_folds(spark, d):
    return st.stratified_folds(st.labelled_target(q.labelled_sentences(spark, d))).select(
        KEY, "y", F.col("fold").cast("long").alias("fold")
    )


@query
def grouped_split(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    return st.stratified_split(rows, group_by="doc_id").select(KEY, "y", "split")


@query
def grouped_folds(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    return st.stratified_folds(rows, group_by="doc_id").select(KEY, "y", F.col("fold").cast("long").alias("fold"))


@query
def quantile_bins(spark, d):
    labelled = q.labelled_sentences(spark, d)
    return st.quantile_bins(labelled, q.STAT_FEATURES).select(
        "feature", "bin", "total", *_rounded("min_value", "max_value")
    )


@query
def event_value_bins(spark, d):
    return st.quantile_bins(q.table(spark, d, "events"), ["value"]).select(
        "feature", "bin", "total", *_rounded("min_value", "max_value")
    )


def _iv(spark, d):
    return st.information_value(st.labelled_target(q.labelled_sentences(spark, d)), q.STAT_FEATURES)


@query
def information_value(spark, d):
    return _iv(spark, d).select("feature", *_rounded("iv"))


@query
def select_by_iv(spark, d):
    return st.select_by_iv(_iv(spark, d)).select("feature", *_rounded("iv"))


@query
def standardize(spark, d):
    return st.standardize(q.labelled_sentences(spark, d), q.STAT_FEATURES).select(
        KEY, *_rounded(*[f + "_z" for f in q.STAT_FEATURES])
    )


@query
def wald_select(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    return md.wald_select(rows, q.STAT_FEATURES).select("feature", *_rounded("p_value"), "selected")


@query
def train_lr(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    scorer, _ = md.train_lr(rows, q.STAT_FEATURES)
    values = {**scorer.coefficients, "(intercept)": scorer.intercept}
    return spark.createDataFrame(list(values.items()), "term string, coefficient double")


@query
def class_weights(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    return st.class_weights(rows).select(
        "n_neg", "n_pos", *_rounded("weight_neg", "weight_pos", "positive_scale")
    )


@query
def calibrate_threshold(spark, d):
    return st.calibrate_threshold(q.labelled_scores(spark, d), cost_fn=1.0, cost_fp=4.0).select(
        *_rounded("threshold", "risk", "f1")
    )


@query
def classification_report(spark, d):
    return st.classification_report(q.labelled_scores(spark, d)).select(
        "entry", *_rounded("precision", "recall", "f1"), "support"
    )


@query
def roc_auc(spark, d):
    return st.roc_auc(q.labelled_scores(spark, d)).select(*_rounded("auc_roc"))


def _training_rows(spark, d):
    """Labelled sentences with all features and the vector of their document.

    A vector ends in a flag: one if the document has a vector, or zeros throughout.
    """
    labels = q.document_labels(spark, d).select("doc_id", "label")
    vectors = q.document_vectors(spark, d).withColumnRenamed(KEY, "doc_id")
    size = vectors.select(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    flagged = vectors.where("embedding is not null").select("doc_id", F.concat("embedding", F.array(F.lit(1.0))).alias("embedding"))
    # Vectors are joined by document, so that no sentence moves. A number of partitions that is
    # given stays as it is, so the text is dealt evenly over the cores.
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    labelled = q.documents(spark, d).join(labels, "doc_id").repartition(parts, "doc_id")
    docs = labelled.join(flagged, "doc_id", "left")
    known = docs.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), size + 1)))
    return q.full_features(sn.sentence_table(known, keep=("label", "embedding")))


@query
def train_gbt(spark, d):
    rows = st.labelled_target(_training_rows(spark, d))
    search = md.train_gbt(rows)
    trials = [(str(sorted(s.items())), auc, s == search.settings) for s, auc in search.trials]
    return spark.createDataFrame(trials, "settings string, cv_auc double, best boolean")


@query
def predict_all(spark, d):
    corpus = _with_document_vectors(spark, d, q.full_features(q.sentences(spark, d)))
    done = md.predict_all(corpus, q.fixed_scorer(), q.THRESHOLD, q.fixed_trees(), 0.55)
    return done.select(KEY, *_rounded("proba_lr", "proba_xgb"), "pred_lr", "pred_xgb")


@query
def prediction_distribution(spark, d):
    return st.prediction_distribution(q.scored_sentences(spark, d)).select(
        "label", "n", *_rounded("share")
    )


def _training(spark, d):
    return train_job(_training_rows(spark, d))


@query
def train_job_(spark, d):
    return _training(spark, d).metrics


QUERIES["train_job"] = QUERIES.pop("train_job_")


# --- diagnostics --------------------------------------------------------------------


@query
def metrics_table(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    split = st.stratified_split(q.scored(rows).select(KEY, "y", "proba"))
    return dg.metrics_table(split, q.THRESHOLD)


@query
def pearson_residuals(spark, d):
    return dg.residuals(q.labelled_scores(spark, d)).select(KEY, *_rounded("pearson"))


@query
def deviance_residuals(spark, d):
    return dg.residuals(q.labelled_scores(spark, d)).select(KEY, *_rounded("deviance"))


@query
def residual_summary(spark, d):
    return dg.residual_summary(q.labelled_scores(spark, d)).select(
        *_rounded("pearson_mean", "pearson_std", "deviance_mean", "deviance_std")
    )


@query
def hosmer_lemeshow(spark, d):
    return dg.hosmer_lemeshow(q.labelled_scores(spark, d)).select(
        F.round("chi2", 3).alias("chi2"), "n_groups", *_rounded("p_value"), "verdict"
    )


@query
def hosmer_lemeshow_odd(spark, d):
    """Nine groups: an odd number of degrees of freedom."""
    return dg.hosmer_lemeshow(q.labelled_scores(spark, d), n_groups=9).select(
        F.round("chi2", 3).alias("chi2"), "n_groups", *_rounded("p_value"), "verdict"
    )


@query
def hosmer_lemeshow_table(spark, d):
    return dg.hosmer_lemeshow_table(q.labelled_scores(spark, d)).select(
        "decile", "obs_pos", "obs_neg", "total", *_rounded("mean_p"),
        *_rounded("exp_pos", "exp_neg", digits=4),
    )


@query
def calibration_curve(spark, d):
    return dg.calibration_curve(q.labelled_scores(spark, d)).select(
        "bin", *_rounded("mean_pred", "frac_pos"), "n"
    )


@query
def residual_histogram(spark, d):
    return dg.residual_histogram(q.labelled_scores(spark, d)).select(
        "bin", *_rounded("left_edge"), "n"
    )


@query
def proba_by_class(spark, d):
    return dg.proba_by_class(q.labelled_scores(spark, d)).select(
        "y", "bin", *_rounded("left_edge"), "n"
    )


@query
def feature_table_report(spark, d):
    rows = st.labelled_target(q.labelled_sentences(spark, d))
    scores = st.information_value(rows, q.STAT_FEATURES)
    passed = [r.feature for r in st.select_by_iv(scores).collect()]
    return md.feature_report(scores, md.wald_select(rows, passed)).select(
        "feature", *_rounded("iv", "p_value", digits=4), "selected"
    )


# --- document views -----------------------------------------------------------------


@query
def filter_corpus(spark, d):
    return vw.filter_corpus(q.scored_sentences(spark, d), date="fr", classe="src3").select(
        KEY, "date", "classe", "proba", "pred"
    )


@query
def doc_list(spark, d):
    return vw.doc_list(q.documents(spark, d))


@query
def display_labels(spark, d):
    return vw.display_labels(q.scored_sentences(spark, d), 0.7).select(KEY, "pred")


@query
def doc_scores(spark, d):
    return vw.doc_scores(q.scored_sentences(spark, d), 0.7).select(
        "doc_id", "n_positive", "n_sentences", *_rounded("share")
    )


@query
def doc_sentences(spark, d):
    return vw.doc_sentences(q.scored_sentences(spark, d)).select(
        "doc_id", "sent_idx", KEY, "sentence", "proba", "pred"
    )


@query
def top_sentences(spark, d):
    return vw.top_sentences(q.scored_sentences(spark, d), 3)


@query
def corpus_totals(spark, d):
    return vw.corpus_totals(q.scored_sentences(spark, d)).select(
        "n_sentences", "n_positive", *_rounded("share"), "n_documents"
    )


@query
def render_documents(spark, d):
    return vw.render_documents(q.scored_sentences(spark, d), 0.7)


@query
def doc_header(spark, d):
    return vw.doc_header(q.sentences(spark, d))


# --- lexicon construction -----------------------------------------------------------


def _abstract(spark, d):
    norms = q.table(spark, d, "part").select(
        F.col("p_name").alias("word"), (F.col("p_size") / 10.0).alias("conc_m"), "p_partkey"
    )
    return lx.abstract_words(norms, "p_partkey", first=None)


@query
def abstract_words(spark, d):
    return _abstract(spark, d)


@query
def translate_terms(spark, d):
    terms = q.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("term"))
    economy = q.table(spark, d, "part").where(F.col("p_type") == "ECONOMY")
    table = economy.where(F.col("p_size") <= 4).select(
        F.col("p_name").alias("source"), F.lower("p_brand").alias("target")
    )
    return lx.translate_terms(terms, table)


def _lemmas(spark):
    return spark.createDataFrame(list(q.LEMMAS), "form string, lemma string")


def _lemmatized(spark, d):
    return lx.lemmatize(q.documents(spark, d), _lemmas(spark))


@query
def lemmatize(spark, d):
    return _lemmatized(spark, d).select("doc_id", "lemma_text")


def _derived_pairs(spark, d):
    """Words of the benchmark that are another one with an ending, with that one as lemma."""
    word = F.explode(tokens(F.lower("text")))
    words = q.table(spark, d, "benchmark").select(word.alias("form")).where("length(form) > 3").distinct()
    cut = F.explode(F.array(*[F.struct(F.lit(len(e)).alias("n"), F.lit(e).alias("e")) for e in q.ENDINGS]))
    cut_forms = words.select("form", cut.alias("c")).where(F.col("form").endswith(F.col("c.e")))
    stems = cut_forms.select("form", F.expr("left(form, length(form) - c.n)").alias("lemma"))
    derived = stems.join(words.select(F.col("form").alias("lemma")), "lemma", "left_semi")
    return derived.select("form", "lemma").unionByName(_lemmas(spark))


@query
def lemma_rules(spark, d):
    return lx.lemma_rules(_derived_pairs(spark, d))


@query
def lemmatize_unseen(spark, d):
    pairs = _derived_pairs(spark, d)
    done = lx.lemmatize(q.documents(spark, d), pairs, lx.lemma_rules(pairs))
    return done.select("doc_id", "lemma_text")


@query
def lexicon_score(spark, d):
    return lx.lexicon_score(_lemmatized(spark, d), q.ENTRIES).select("doc_id", "n_hits", "score")


@query
def kwic(spark, d):
    return lx.keyword_in_context(_lemmatized(spark, d), q.ENTRIES)


@query
def lexicon_score_table(spark, d):
    scores = lx.lexicon_score(_lemmatized(spark, d), q.ENTRIES, max_inline=0)
    return scores.select("doc_id", "n_hits", "score")


@query
def kwic_table(spark, d):
    return lx.keyword_in_context(_lemmatized(spark, d), q.ENTRIES, max_inline=0)


def _large_lexicon(spark, d):
    """Names and types of all parts, and every longer word of the benchmark."""
    names, kinds, _ = _part_lexicons(spark, d)
    word = F.explode(tokens(F.lower("text")))
    words = q.table(spark, d, "benchmark").select(word.alias("entry")).where("length(entry) > 4")
    return lx.merge_lexicons(names, kinds, words)


@query
def lexicon_score_large(spark, d):
    scores = lx.lexicon_score(_lemmatized(spark, d), _large_lexicon(spark, d))
    return scores.select("doc_id", "n_hits", "score")


@query
def kwic_large(spark, d):
    return lx.keyword_in_context(_lemmatized(spark, d), _large_lexicon(spark, d))


@query
def adjust_lexicon(spark, d):
    names, kinds, brands = _part_lexicons(spark, d)
    wrong = q.table(spark, d, "part").where(F.col("p_size") == 50).select(
        F.lower("p_name").alias("entry")
    )
    return lx.adjust_lexicon(lx.merge_lexicons(names, kinds), wrong, brands)


def _adjusted():
    return sorted((set(q.ENTRIES) - set(q.FALSE_POSITIVES)) | set(q.FALSE_NEGATIVES))


@query
def lexicon_delta(spark, d):
    return lx.lexicon_delta(_lemmatized(spark, d), q.ENTRIES, _adjusted()).select(
        "doc_id", "score_before", "score_after", "delta"
    )


@query
def lexicon_validation(spark, d):
    scores = lx.lexicon_score(_lemmatized(spark, d), q.ENTRIES)
    expected = q.document_labels(spark, d).select(
        "doc_id", F.when(F.col("label") == POS_LABEL, "high").otherwise("low").alias("expected")
    )
    return lx.lexicon_validation(scores, expected).select(
        "expected", "n_documents", *_rounded("mean_score", "min_score", "max_score")
    )


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Vague and concrete language per stratum, from raw text in one pass and one shuffle."""
    return (
        q.rule_features(q.sentences(spark, d))
        .groupBy("date", "classe")
        .agg(
            F.count("*").alias("n_sentences"),
            F.round(F.avg("vague_ratio"), 6).alias("mean_vague_ratio"),
            F.round(F.avg("numeric_ratio"), 6).alias("mean_numeric_ratio"),
            F.count_if(F.col("n_digits") > 0).alias("n_concrete"),
        )
    )


QUERIES["stratum_rhetoric"] = flagship
