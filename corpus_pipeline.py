"""The corpus pipeline: five stages of the llm operators, each on all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder and
reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import minhash, mixing, quality, sentencepiece_codec, suffix_dedup
from parlance.llm.store import discard, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the likelihood ratio, unchanged; null texts fail."""
    return quality.keep_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every near-duplicate group, unchanged.

    Rows that are equal in id and text count once, with the least language, source and length.
    Rows of one id with different texts are one document for the links of others and all stay
    if it does; rows without an id all stay.
    """
    good = stored(minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    rows = docs.select(*COLUMNS)
    known = rows.where("doc_id is not null").join(good, "doc_id", "left_semi")
    one = known.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").unionByName(rows.where("doc_id is null"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with repeated byte strings cut out; ``n_chars`` is that of what is left.

    A character that a cut went through is dropped. Texts that lose nothing stay as they are
    (a null text as an empty one); documents cut to nothing keep their row.
    """
    cut = suffix_dedup.dedup_suffixes(docs, carry=("lang", "source", "n_chars")).drop("removed", "n_bytes")
    schema = cut.select("doc_id", "n_removed", F.lit("").alias("kept"), "lang", "source", "n_chars").schema
    text = cut.select("doc_id", "n_removed", "kept", "lang", "source", "n_chars").mapInArrow(suffix_dedup.whole_characters, schema)
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return text.select("doc_id", F.col("kept").alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights and dealt out anew.

    A null source is one source. Equal rows repeat alike; rows without an id share one draw. No
    rows give no rows.
    """
    return mixing.mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; copies are numbered and each draws its own dropout.

    Rows equal in id and text are copies of one another, those without an id too. A null or
    empty text has no tokens. No rows give no rows.
    """
    equal = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))  # equal rows, so any order
    numbered = docs.select("doc_id", "text", F.row_number().over(equal).alias("copy"))
    return sentencepiece_codec.encode_texts(numbered, copy_col="copy")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Min-max hashing, the likelihood ratio and the piece merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
