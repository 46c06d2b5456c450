"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Each source gets a mean number of repetitions: its weight times the target size over its
rows. A document's count inverts that Poisson distribution at a uniform number hashed from
the seed and the id, so the same document always gets the same count. Documents are exploded
by their counts and dealt out by a hash of seed, id and copy: a global shuffle in one pass.

A mean above ``STEP`` is a sum of equal smaller means, each with a uniform number of its own,
so no distribution table is longer than about ``STEP`` entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.store import place

#: Largest mean of one inverted distribution.
STEP = 500
#: Up to so many sources their tables (under 8 KB each) are broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 1000
SALTS = 64


def uniform(seed: int, id_: F.Column, part: F.Column) -> F.Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), part.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def repetition_rates(
    docs: DataFrame, weights: dict[str, float] | None, power: float, target_rows: float | None
) -> DataFrame:
    """``(source, n, rate)``: the mean repetitions of each source; ``docs`` has ``source``."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    elif weights:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    whole = Window.partitionBy(F.lit(0))  # one row per source
    rows = F.sum("n").over(whole) if target_rows is None else F.lit(float(target_rows))
    weighted = counts.withColumn("w", weight)
    rate = F.col("w") / F.sum("w").over(whole) * rows / F.col("n")
    return weighted.select("source", "n", F.when(F.col("w") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def distribution_tables(rates: DataFrame) -> DataFrame:
    """``(source, rate, parts, cdf)``: the distribution function of ``rate / parts``."""
    small = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    small = small.withColumn("mean", F.col("rate") / F.col("parts"))
    small = small.withColumn("top", F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int"))
    cdf = F.expr(
        "aggregate(sequence(1, top), named_struct('p', exp(-mean), 'c', exp(-mean), 'cdf', array(exp(-mean))),"
        " (a, k) -> named_struct('p', a.p * mean / k, 'c', a.c + a.p * mean / k,"
        " 'cdf', array_append(a.cdf, a.c + a.p * mean / k)), a -> a.cdf)"
    )
    return small.select("source", "rate", "parts", cdf.alias("cdf"))


def mix_sources(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    target_rows: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy",
) -> DataFrame:
    """All columns of ``df`` and ``copy_col`` (1, 2, …), rows repeated towards the target weights.

    Without ``weights`` a source weighs its number of rows to ``power``; with them, sources that
    are not named weigh nothing. ``target_rows`` is the mean size of the result, by default
    that of the input.

    Rows without a source are a source of their own (named ``""`` in ``weights``). Equal ids
    get equal counts, and all rows without an id count as one id. An input column named
    ``copy_col`` in any case is replaced; other columns may clash, they are kept by position.
    An empty input gives an empty result.
    """
    names = df.columns
    keep = [i for i, n in enumerate(names) if n.lower() != copy_col.lower()]
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    id_, source = F.col(f"_c{place(names, id_col)}"), F.col(f"_c{place(names, source_col)}")
    rates = repetition_rates(plain.select(source.cast("string").alias("source")), weights, power, target_rows)
    tables = distribution_tables(rates).withColumnsRenamed({c: f"_{c}" for c in ("source", "rate", "parts", "cdf")})
    rows = plain.withColumn("_source", source.cast("string"))
    if rates.count() <= BROADCAST_SOURCES:
        known = rows.join(F.broadcast(tables), rows["_source"].eqNullSafe(tables["_source"]))
    else:
        salted = tables.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int"))
        known = rows.join(salted, rows["_source"].eqNullSafe(salted["_source"]) & (rows["_salt"] == salted["_salt"]))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0),
        lambda n, part: n + F.size(F.filter(F.col("_cdf"), lambda c: c <= uniform(seed, id_, part))),
    )
    counted = known.withColumn("_n", count).where("_n > 0")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    dealt = copies.withColumn("_order", F.xxhash64(F.lit(seed), id_, "_copy"))
    mixed = dealt.repartition("_order").sortWithinPartitions("_order")
    return mixed.select(*[F.col(f"_c{i}").alias(names[i]) for i in keep], F.col("_copy").alias(copy_col))


ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * sum(n) OVER () / n AS mean FROM counts
),
steps AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
),
marked AS (
  SELECT *, (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|1'), 1, 13))::BIGINT + 0.5)
         / 4503599627370496.0 AS u
  FROM documents
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, s.n
  FROM marked d JOIN (SELECT source AS src, list(c) AS cs FROM steps GROUP BY source) t
    ON d.source IS NOT DISTINCT FROM t.src,
  LATERAL (SELECT len(list_filter(t.cs, lambda c: c <= d.u)) AS n) s
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM counted WHERE n > 0
"""
