"""Vectors whose norms a double cannot hold, against directions computed by hand."""

from parlance.llm import embedding_dedup


def test_very_large_and_small_vectors_link_by_direction(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1e-200, 2e-200, 3e-200]), (3, [1e200, 2e200, 3e200]), (4, [5e-324, 0.0, 0.0]), (5, [1e308, 1e-308, 0.0]),
            (6, [3.0, -2.0, 1.0]), (7, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}
