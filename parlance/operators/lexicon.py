"""Lexicon loading, construction, adjustment and document scores."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip, tokens
from parlance.operators.patterns import contexts, count_present

# Largest lexicon that is inlined as literals; a larger one is joined.
MAX_INLINE_ENTRIES = 10_000
# The same for entries that are looked for as substrings, each in a pass of its own.
MAX_INLINE_PATTERNS = 100
# Lemmas that go into the plan, and those that go to every worker; more are joined.
MAX_INLINE_LEMMAS = 64
MAX_HELD_LEMMAS = 1_000_000


def lexicon_entries(
    lexicon: DataFrame | Iterable[str], limit: int = MAX_INLINE_ENTRIES
) -> list[str] | None:
    """The entries, blanks left out, as a sorted list when there are at most ``limit``, else None."""
    if isinstance(lexicon, DataFrame):
        rows = lexicon.select("entry").where("entry <> ''").distinct().limit(limit + 1).collect()
        entries = [r.entry for r in rows]
    else:
        entries = list({e for e in lexicon if e})
    return sorted(entries) if len(entries) <= limit else None


def lexicon_table(like: DataFrame, lexicon: DataFrame | Iterable[str]) -> DataFrame:
    """The distinct entries as a table, blanks left out."""
    if not isinstance(lexicon, DataFrame):
        rows = [(e,) for e in sorted({e for e in lexicon if e})]
        lexicon = like.sparkSession.createDataFrame(rows, "entry string")
    return lexicon.select("entry").where("entry <> ''").distinct()


def text_key(text: str) -> Column:
    """Stands for the text where its results meet; those that depend on a text alone share it."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def parse_lexicon(raw_lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines to entries: strip, lower, drop blanks and lines that start with ``#``."""
    line = F.col(column)
    return (
        raw_lines.where(~line.startswith("#"))
        .select(F.lower(strip(line)).alias("entry"))
        .where(F.col("entry") != "")
        .distinct()
    )


def merge_lexicons(*lexicons: DataFrame) -> DataFrame:
    """Union of lexicons without repeats."""
    merged = lexicons[0].select("entry")
    for other in lexicons[1:]:
        merged = merged.union(other.select("entry"))
    return merged.distinct()


def abstract_words(
    norms: DataFrame, order: str, max_concreteness: float = 2.0, first: int | None = 2000
) -> DataFrame:
    """Words with mean concreteness up to the bound; the first ones in source order.

    ``first`` is the size of the list wanted (None keeps all); top-k per task, then merged.
    """
    chosen = norms.where(F.col("conc_m") <= max_concreteness)
    return chosen if first is None else chosen.orderBy(order).limit(first)


def translate_terms(terms: DataFrame, translations: DataFrame) -> DataFrame:
    """Target words of a ``(source, target)`` table; null where there is none."""
    table = translations.groupBy("source").agg(F.min("target").alias("target"))
    return terms.join(table, terms["term"] == table["source"], "left").drop("source")


def adjust_lexicon(
    lexicon: DataFrame, false_positives: DataFrame, false_negatives: DataFrame
) -> DataFrame:
    """Take out the false positives, put in the false negatives."""
    kept = lexicon.select("entry").join(false_positives.select("entry"), "entry", "left_anti")
    return merge_lexicons(kept, false_negatives)


def lemma_rules(lemmas: DataFrame, longest: int = 4, least: int = 2) -> DataFrame:
    """Rewrite rules ``(suffix, strip, append, n)`` learnt from ``(form, lemma)`` pairs.

    A form whose first letters are its lemma's turns into it by losing ``strip`` letters and
    getting ``append``. Every suffix of the form that holds the lost letters, ``longest``
    letters at most, votes for that rewrite; per suffix the most frequent one wins, then the
    least, if ``least`` pairs agree. Forms that are their own lemma vote for staying.
    """
    pairs = lemmas.where("form <> ''").groupBy("form").agg(F.min("lemma").alias("lemma"))
    size = F.length("form")
    places = F.sequence(F.lit(1), F.greatest(F.least(size, F.length("lemma")), F.lit(1)))
    alike = F.filter(places, lambda i: F.col("form").substr(F.lit(1), i) == F.col("lemma").substr(F.lit(1), i))
    cut = pairs.withColumn("_same", F.size(alike)).select(
        "form", (size - F.col("_same")).alias("strip"), F.expr("substring(lemma, _same + 1)").alias("append")
    )
    low, high = F.greatest("strip", F.lit(1)), F.least(F.lit(longest), size - 1)
    keys = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.right("form", k)))
    votes = cut.select(F.explode(keys).alias("suffix"), "strip", "append")
    counted = votes.groupBy("suffix", "strip", "append").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counted.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("m"), "strip", "append")).alias("b"))
    return best.select("suffix", F.col("b.strip").alias("strip"), F.col("b.append").alias("append"), (-F.col("b.m")).alias("n"))


def _bounded(table: DataFrame, limit: int) -> list | None:
    """The rows of a table when there are at most ``limit``, else None."""
    rows = table.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def rewritten(token: str, rules: dict[str, tuple[int, str]], longest: int) -> str:
    """A token by the rule of its longest suffix that has one; two letters stay at least."""
    for k in range(min(longest, len(token)), 0, -1):
        rule = rules.get(token[-k:])
        if rule is not None:
            return token[: len(token) - rule[0]] + rule[1] if len(token) - rule[0] >= 2 else token
    return token


def _lemma_udf(held):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        table, rules = held.value
        longest = max(map(len, rules), default=0)
        made: dict[str, str] = {}  # forms of this batch that the table lacks

        def lemma(token: str) -> str:
            known = table.get(token) or made.get(token)
            if known is None:
                known = made[token] = rewritten(token, rules, longest)
            return known

        return pa.array([" ".join(map(lemma, t.split(" "))) if t else "" for t in texts.to_pylist()], pa.string())

    return run


def lemmatize(
    documents: DataFrame,
    lemmas: DataFrame,
    rules: DataFrame | None = None,
    max_inline: int = MAX_INLINE_LEMMAS,
    max_held: int = MAX_HELD_LEMMAS,
) -> DataFrame:
    """Add ``lemma_text``: every lower-cased token replaced by its lemma, in order.

    ``lemmas`` is ``(form, lemma)``; the smallest lemma of a form wins. A form that is not
    there is rewritten by ``rules`` (see :func:`lemma_rules`), if given, else stays. A small
    table goes into the plan as a map, one of up to ``max_held`` rows to the workers; rows
    stay where they are. Only a larger one is joined.
    """
    table = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    words = tokens(F.lower("text"))
    ending = [] if rules is None else _bounded(rules, max_held)
    rows = _bounded(table, max_held)
    if rows is None or ending is None:
        return _joined_lemmatize(documents, table, rules)
    if len(rows) <= max_inline and rules is None:
        if not rows:
            return documents.withColumn("lemma_text", F.coalesce(F.array_join(words, " "), F.lit("")))
        held = F.create_map(*[F.lit(x) for r in rows for x in r])
        done = F.transform(words, lambda t: F.coalesce(F.try_element_at(held, t), t))
        return documents.withColumn("lemma_text", F.coalesce(F.array_join(done, " "), F.lit("")))
    sent = documents.sparkSession.sparkContext.broadcast(
        ({r.form: r.lemma for r in rows}, {r.suffix: (r.strip, r.append) for r in ending})
    )
    return documents.withColumn("lemma_text", F.coalesce(_lemma_udf(sent)(F.array_join(words, " ")), F.lit("")))


def _joined_lemmatize(documents: DataFrame, table: DataFrame, rules: DataFrame | None) -> DataFrame:
    """The same for tables of any size.

    Distinct forms are looked up once. The lemma text depends on the text alone, so tokens
    meet again by a key of the text: equal ids do not mix, and equal texts are done once.
    """
    keyed = documents.withColumn("_text_key", text_key("text"))
    once = keyed.select("_text_key", "text").dropDuplicates(["_text_key"])
    placed = once.select("_text_key", F.posexplode(tokens(F.lower("text"))).alias("pos", "form"))
    if rules is not None:
        forms = placed.select("form").distinct().join(table, "form", "left")
        ends = F.transform(F.sequence(F.lit(1), F.length("form")), lambda k: F.right("form", k))
        longest = rules.agg(F.max(F.length("suffix"))).first()[0] or 1
        tried = forms.where("lemma is null").select("form", F.explode(F.slice(ends, 1, longest)).alias("suffix"))
        hit = tried.join(rules, "suffix").groupBy("form").agg(F.max_by(F.struct("strip", "append"), F.length("suffix")).alias("r"))
        left = F.length("form") - F.col("r.strip")
        made = hit.where(left >= 2).select("form", F.concat(F.col("form").substr(F.lit(1), left), F.col("r.append")).alias("lemma"))
        table = table.unionByName(made)
    lemmas = placed.join(table, "form", "left").select("_text_key", "pos", F.coalesce("lemma", "form").alias("lemma"))
    texts = lemmas.groupBy("_text_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_placed")
    ).select(
        "_text_key",
        F.array_join(F.transform("_placed", lambda p: p["lemma"]), " ").alias("lemma_text"),
    )
    return keyed.join(texts, "_text_key", "left").select(
        *documents.columns, F.coalesce("lemma_text", F.lit("")).alias("lemma_text")
    )


def _present(text: Column, entries: list[str]) -> Column:
    """Entries that occur in the text as a substring."""
    if not entries:
        return F.array().cast("array<string>")
    literal = F.array(*[F.lit(e) for e in entries])
    return F.filter(literal, lambda e: F.contains(text, e))


def _score(n_hits: Column, text: Column) -> Column:
    n_tokens = F.size(tokens(text)).cast("double")
    return F.coalesce(F.round(F.try_divide(n_hits * 100.0, n_tokens), 2), F.lit(0.0))


def lexicon_score(
    documents: DataFrame,
    lexicon: DataFrame | Iterable[str],
    text: str = "lemma_text",
    max_inline: int = MAX_INLINE_PATTERNS,
) -> DataFrame:
    """``score`` = 100 × entries found as substrings / tokens, to two decimals.

    A lexicon of more than ``max_inline`` entries is walked by an automaton; the result is
    the same.
    """
    entries = lexicon_entries(lexicon, max_inline)
    if entries is None:
        counted = count_present(documents, lexicon_table(documents, lexicon), text, text_key(text))
        return counted.withColumn("score", _score(F.col("n_hits"), F.col(text)))
    if not entries:
        return documents.withColumns({"n_hits": F.lit(0).cast("long"), "score": F.lit(0.0)})
    return documents.withColumn(
        "n_hits", F.size(_present(F.col(text), entries)).cast("long")
    ).withColumn("score", _score(F.col("n_hits"), F.col(text)))


def keyword_in_context(
    documents: DataFrame,
    lexicon: DataFrame | Iterable[str],
    window: int = 60,
    max_inline: int = MAX_INLINE_PATTERNS,
) -> DataFrame:
    """First occurrence of each entry of a document, with ``window`` characters around.

    An entry counts when the lemma text has it; the context comes from the lower-cased
    original text when that has it too, else from the lemma text. A lexicon of more than
    ``max_inline`` entries is walked by an automaton; the result is the same.
    """
    entries = lexicon_entries(lexicon, max_inline)
    bodies = documents.select("doc_id", F.lower("text").alias("_text"), "lemma_text")
    if entries is None:
        return contexts(bodies, lexicon_table(documents, lexicon), window)
    found = bodies.withColumn("entry", F.explode(_present(F.col("lemma_text"), entries)))
    in_original = F.contains(F.col("_text"), F.col("entry"))
    body = F.when(in_original, F.col("_text")).otherwise(F.col("lemma_text"))
    placed = found.select(
        "doc_id",
        "entry",
        F.when(in_original, "original").otherwise("lemma").alias("source"),
        body.alias("_body"),
    ).withColumn("_at", F.instr(F.col("_body"), F.col("entry")))
    start = F.greatest(F.col("_at") - window, F.lit(1))
    stop = F.col("_at") + F.length("entry") + window
    return placed.select(
        "doc_id",
        "entry",
        "source",
        F.substring(F.col("_body"), start, stop - start).alias("context"),
    )


def lexicon_delta(
    documents: DataFrame, before: DataFrame | Iterable[str], after: DataFrame | Iterable[str]
) -> DataFrame:
    """Scores with two lexicons and their difference, in one pass over the documents."""
    first = lexicon_score(documents, before).withColumnsRenamed(
        {"score": "score_before", "n_hits": "_hits_before"}
    )
    both = lexicon_score(first, after).withColumnsRenamed({"score": "score_after"})
    return both.withColumn(
        "delta", F.round(F.col("score_after") - F.col("score_before"), 2)
    ).drop("_hits_before", "n_hits")


def lexicon_validation(scores: DataFrame, expectation: DataFrame) -> DataFrame:
    """Documents, mean, lowest and highest score per expected group."""
    return (
        scores.join(expectation.select("doc_id", "expected"), "doc_id")
        .groupBy("expected")
        .agg(
            F.count("*").alias("n_documents"),
            F.avg("score").alias("mean_score"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
        )
    )
