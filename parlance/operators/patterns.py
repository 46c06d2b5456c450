"""Many patterns in one walk over a text: Aho–Corasick automata over slices of the patterns.

A slice holds patterns of a bounded number of characters, is built into one automaton on the
driver and broadcast. Every slice walks each text once; nothing of a text is shuffled, and the
patterns of a text are never gathered from a table. Patterns beyond one slice go round slice
by slice, in scans of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton; about forty bytes of memory each.
SLICE_CHARS = 4 << 20
#: Rows of contexts after which a batch of results goes on.
RESULT_ROWS = 8192


def pattern_slices(patterns: DataFrame, column: str, limit: int | None = None) -> Iterator[list[Row]]:
    """The rows of ``patterns`` in groups of about ``limit`` characters, by a hash of the pattern."""
    limit = limit or SLICE_CHARS
    total = patterns.agg(F.sum(F.length(column) + 1)).first()[0] or 0
    n = 1 + total // limit
    for k in range(n):
        rows = patterns.where(F.pmod(F.xxhash64(column), F.lit(n)) == k).collect()
        if rows:
            yield rows


def automaton(words: Iterable[str]):
    """Automaton whose hits are ``(last character, place of the word)``; ``words`` are distinct."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, word in enumerate(words):
        made.add_word(word, i)
    made.make_automaton()
    return made


def _distinct_hits(held, text: Column) -> Column:
    """How many of the automaton's words the text has."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        walk = held.value.iter
        bodies = (t.as_py() for t in texts)  # one text at a time outside the batch
        return pa.array([len({i for _, i in walk(t)}) if t else 0 for t in bodies], pa.int64())

    return count(text)


def count_present(documents: DataFrame, entries: DataFrame, text: str, key: Column) -> DataFrame:
    """Add ``n_hits``: how many distinct ``entry`` values occur in ``text`` as a substring.

    ``key`` tells texts apart; it is used only when there is more than one slice, to add up
    the slices' counts.
    """
    send = documents.sparkSession.sparkContext.broadcast
    held = [send(automaton(r.entry for r in rows)) for rows in pattern_slices(entries, "entry")]
    if not held:
        return documents.withColumn("n_hits", F.lit(0).cast("long"))
    if len(held) == 1:
        return documents.withColumn("n_hits", _distinct_hits(held[0], F.col(text)))
    keyed = documents.withColumn("_text_key", key)
    once = keyed.select("_text_key", F.col(text).alias("_text")).dropDuplicates(["_text_key"])
    parts = [once.select("_text_key", _distinct_hits(one, F.col("_text")).alias("_n")).where("_n > 0") for one in held]
    sums = reduce(DataFrame.unionByName, parts).groupBy("_text_key").agg(F.sum("_n").alias("_n"))
    joined = keyed.join(sums, "_text_key", "left")
    return joined.withColumn("n_hits", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n", "_text_key")


def first_places(walk, text: str | None) -> dict[int, int]:
    """Where each word that occurs in a text ends for the first time."""
    places: dict[int, int] = {}
    for end, word in walk(text) if text else ():
        places.setdefault(word, end)
    return places


def _contexts(held, window: int):
    def made_batch(ids: pa.Array, rows: list, entries: list, sources: list, contexts: list) -> pa.RecordBatch:
        return pa.record_batch(
            [ids.take(pa.array(rows, pa.int64())), pa.array(entries, pa.string()), pa.array(sources, pa.string()), pa.array(contexts, pa.string())],
            names=["doc_id", "entry", "source", "context"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, words = held.value
        for batch in batches:
            ids = batch.column(0)
            rows, entries, sources, contexts = [], [], [], []
            # Texts leave the batch one at a time, and results go on in batches of their own.
            for row, (text, lemmas) in enumerate(zip(batch.column(1), batch.column(2))):
                text, lemmas = text.as_py(), lemmas.as_py()
                wanted = first_places(made.iter, lemmas)
                original = first_places(made.iter, text) if wanted else {}
                for word, end in wanted.items():
                    body, stop = (text, original[word]) if word in original else (lemmas, end)
                    begin = max(stop + 1 - len(words[word]) - window, 0)
                    rows.append(row)
                    entries.append(words[word])
                    sources.append("original" if word in original else "lemma")
                    contexts.append(body[begin : stop + 1 + window])
                if len(rows) >= RESULT_ROWS:
                    yield made_batch(ids, rows, entries, sources, contexts)
                    rows, entries, sources, contexts = [], [], [], []
            yield made_batch(ids, rows, entries, sources, contexts)

    return run


def contexts(documents: DataFrame, entries: DataFrame, window: int) -> DataFrame:
    """``doc_id, entry, source, context`` of the first occurrence of each entry of a document.

    ``documents`` has ``doc_id``, the lower-cased ``_text`` and ``lemma_text``.
    """
    rows = documents.select("doc_id", "_text", "lemma_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, entry string, source string, context string"
    parts = []
    for held in pattern_slices(entries, "entry"):
        words = [r.entry for r in held]
        sent = documents.sparkSession.sparkContext.broadcast((automaton(words), words))
        parts.append(rows.mapInArrow(_contexts(sent, window), schema))
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def phrase_hits(held, words: Column) -> Column:
    """Hits ``(start, stop, type)`` of whole-word phrases in an array of words.

    They come by their start, the longest first.
    The words are walked between blanks, so a phrase begins and ends where a word does.
    """

    @F.arrow_udf("array<struct<start:int,stop:int,type:string>>")
    def find(texts: pa.Array) -> pa.Array:
        made, phrases = held.value
        starts, stops, kinds, ends = [], [], [], [0]
        for text in texts:
            text = text.as_py()
            found = [(end - len(phrases[i][0]), -end, phrases[i][1]) for end, i in made.iter(f" {text} ")] if text else []
            for start, end, kind in sorted(found):
                starts.append(start - 1)
                stops.append(-end - 1)
                kinds.append(kind)
            ends.append(len(starts))
        hits = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(kinds, pa.string())], names=["start", "stop", "type"]
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)

    return find(F.array_join(words, " "))
