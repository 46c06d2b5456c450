"""Entity counts per sentence from a gazetteer of (phrase, type)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.lexicon import text_key
from parlance.operators.patterns import automaton, pattern_slices, phrase_hits
from parlance.schema import ENTITY_FEATURES

# Largest gazetteer that is inlined into the plan; a larger one is walked by automata.
MAX_INLINE_PHRASES = 5_000

_WORD = r"[\p{L}\p{N}_]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _normalised(gazetteer: DataFrame) -> DataFrame:
    phrase = F.array_join(_words(F.col("phrase")), " ")
    return (
        gazetteer.select(phrase.alias("phrase"), F.upper("type").alias("type"))
        .where(F.col("phrase") != "")
        .groupBy("phrase")
        .agg(F.min("type").alias("type"))
    )


def _swept(hits: Column) -> Column:
    """Counts of the hits that lie inside no longer one, in one sweep along the text.

    Hits come by their start, the longest first. A hit lies inside a longer one exactly if it
    ends no later than the last one kept; two of equal extent are both kept.
    """
    zero = F.lit(0).cast("long")
    first = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("stop"), *[zero.alias(n) for n in ("org", "loc", "law", "total")])

    def sweep(a: Column, h: Column) -> Column:
        def plus(name: str, *kinds: str) -> Column:
            return (a[name] + F.when(h["type"].isin(*kinds), 1).otherwise(0)).alias(name)

        kept = F.struct(
            h["start"].alias("start"), h["stop"].alias("stop"),
            plus("org", "ORG"), plus("loc", "LOC", "GPE"), plus("law", "LAW"), (a["total"] + 1).alias("total"),
        )
        same = (h["start"] == a["start"]) & (h["stop"] == a["stop"])
        return F.when(same | (h["stop"] > a["stop"]), kept).otherwise(a)

    return F.aggregate(hits, first, sweep)


def _with_counts(located: DataFrame) -> DataFrame:
    """Add the counts of ``_hits``; the sweep gets a column of its own, so that it runs once."""
    swept = located.withColumn("_swept", _swept(F.col("_hits")))
    names = zip(ENTITY_FEATURES, ("org", "loc", "law", "total"))
    return swept.withColumns({n: F.col("_swept")[c] for n, c in names}).drop("_hits", "_swept")


def gazetteer_table(
    like: DataFrame, gazetteer: DataFrame | Iterable[tuple[str, str]]
) -> DataFrame:
    """Distinct phrases of lower-cased words with one type each, the least; lists and tables alike."""
    if not isinstance(gazetteer, DataFrame):
        gazetteer = like.sparkSession.createDataFrame(list(gazetteer), "phrase string, type string")
    return _normalised(gazetteer)


def gazetteer_list(gazetteer: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same for a list, on the driver and without a job."""
    least: dict[str, str] = {}
    for phrase, kind in gazetteer:
        words = " ".join(regex.findall(_WORD, phrase.lower()))
        if words:
            least[words] = min(least.get(words, kind.upper()), kind.upper())
    return sorted(least.items())


def entity_counts(
    sentences: DataFrame,
    gazetteer: DataFrame | Iterable[tuple[str, str]],
    max_inline: int = MAX_INLINE_PHRASES,
) -> DataFrame:
    """Add ORG, LOC/GPE, LAW and total counts; 0 where nothing is found.

    Up to ``max_inline`` phrases are inlined into the plan, more are walked by automata.
    """
    if isinstance(gazetteer, DataFrame):
        phrases = gazetteer_table(sentences, gazetteer)
        rows = [tuple(r) for r in phrases.limit(max_inline + 1).collect()]
    else:
        rows = gazetteer_list(gazetteer)
        phrases = None
    if len(rows) <= max_inline:
        return inlined_entity_counts(sentences, rows)
    if phrases is None:
        phrases = sentences.sparkSession.createDataFrame(rows, "phrase string, type string")
    return walked_entity_counts(sentences, phrases)


def inlined_entity_counts(
    sentences: DataFrame, phrases: Iterable[tuple[str, str]]
) -> DataFrame:
    """No shuffle: positions whose word starts a normalised phrase are tried at each length."""
    by_size: dict[int, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
    firsts: set[str] = set()
    for phrase, kind in phrases:
        words = phrase.lower().split()
        if words:
            by_size[len(words)][kind.upper()].add(" ".join(words))
            firsts.add(words[0])
    if not firsts:
        zero = F.lit(0).cast("long")
        return sentences.withColumns({n: zero for n in ENTITY_FEATURES})
    first_words = sorted(firsts)
    words = F.col("_words")

    def hits_at(i: Column) -> Column:
        found = []
        for size, kinds in sorted(by_size.items(), reverse=True):
            phrase = F.get(words, i) if size == 1 else F.array_join(F.slice(words, i + 1, size), " ")
            each = [
                F.when(
                    phrase.isin(sorted(names)),
                    F.struct(i.alias("start"), (i + size).alias("stop"), F.lit(kind).alias("type")),
                )
                for kind, names in sorted(kinds.items())
            ]
            # Most places hold no phrase: one probe tells, and only then which type it is.
            known = phrase.isin(sorted(set().union(*kinds.values())))
            found.append(F.when((i + size <= F.size(words)) & known, F.array_compact(F.array(*each))))
        return F.flatten(F.array_compact(F.array(*found)))

    positions = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.get(words, i).isin(first_words),
    )
    hits = F.when(F.size(words) > 0, F.flatten(F.transform(positions, hits_at)))
    located = sentences.withColumn("_words", _words(F.col("sentence"))).withColumn(
        "_hits", F.coalesce(hits, F.array().cast("array<struct<start:int,stop:int,type:string>>"))
    )
    return _with_counts(located).drop("_words")


def walked_entity_counts(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """For normalised gazetteers of any size: automata over slices of the phrases.

    One slice needs no shuffle. With more, the hits of a sentence meet by a key of it, for a
    phrase of one slice may lie in one of another.
    """
    send = sentences.sparkSession.sparkContext.broadcast
    held = []
    for rows in pattern_slices(phrases, "phrase"):
        held.append(send((automaton(f" {r.phrase} " for r in rows), [(r.phrase, r.type) for r in rows])))
    words = _words(F.coalesce("sentence", F.lit("")))
    none = F.array().cast("array<struct<start:int,stop:int,type:string>>")
    if len(held) < 2:
        located = sentences.withColumn("_hits", phrase_hits(held[0], words) if held else none)
    else:
        keyed = sentences.withColumn("_text_key", text_key("sentence"))
        once = keyed.select("_text_key", "sentence").dropDuplicates(["_text_key"])
        parts = [once.select("_text_key", F.explode(phrase_hits(one, words)).alias("_hit")) for one in held]
        placed = F.struct("_hit.start", (-F.col("_hit.stop")).alias("back"), "_hit.type")
        hits = reduce(DataFrame.unionByName, parts).groupBy("_text_key").agg(F.array_sort(F.collect_list(placed)).alias("_placed"))
        ordered = F.transform("_placed", lambda h: F.struct(h["start"].alias("start"), (-h["back"]).alias("stop"), h["type"].alias("type")))
        hits = hits.select("_text_key", ordered.alias("_hits"))
        located = keyed.join(hits, "_text_key", "left").withColumn("_hits", F.coalesce("_hits", none)).drop("_text_key")
    return _with_counts(located)
