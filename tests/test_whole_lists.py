"""Queries over lists return the whole list."""

from parlance.plans.catalog import QUERIES


def test_abstract_words_returns_every_word_up_to_the_bound(spark, tmp_path):
    parts = [(i, f"word {i}", 1 + i % 25) for i in range(3000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey for r in QUERIES["abstract_words"](spark, str(tmp_path)).collect()}
    assert got == {i for i, _, size in parts if size / 10 <= 2.0}
