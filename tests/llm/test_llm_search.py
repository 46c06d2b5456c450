"""Ranked search against scoring every document, and the tree's bounds against every vector."""

import math
import random
import re

import numpy as np
import pytest

from parlance.llm import ball_tree, lexical_search
from parlance.llm.oracle import SEARCH

RNG = random.Random(8)
WORDS = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "İx", "a\x7fb", "É", "é"]
TEXTS = [None, "", " ,.- \n", "one", "x" * 200000 + " w1", " ".join(RNG.choice(WORDS) for _ in range(30000))]
TEXTS += [" ".join(RNG.choice(WORDS[RNG.randrange(40) :]) for _ in range(RNG.randrange(1, 90))) for _ in range(300)]
TEXTS += ["w1 W2 w3-w4"] * 40  # ties
ROWS = [*enumerate(TEXTS), (3, "again w1"), (5, "w1"), (None, "w1 w2"), (None, None)]
ITEMS = [(1, "w1, W2 w2 nowhere"), (1, "w1, W2 w2 nowhere"), (1, "É 日本"), (2, None), (3, " ".join(WORDS)), (4, "absent"), (None, "w3 w4"), (5, "")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, TEXT_ string, score int").repartition(5)
    return docs, spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, rank int")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def by_hand(top):
    docs = [(i, words_of(t)) for i, t in ROWS]
    docs = [(i, w) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in set(ITEMS):
        scored = []
        for i, words in docs:
            score = 0
            for term in set(words_of(text)):
                df, tf = sum(term in w for _, w in docs), words.count(term)
                m = 100 - 50 + (50 * len(words) * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m)) if tf else 0
            if score:
                scored.append((-score, math.inf if i is None else i))
        out += [(item, rank + 1, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top", [7, 50])
def test_search_matches_scoring_everything(tables, top, monkeypatch):
    monkeypatch.setattr(lexical_search, "PART_BYTES", 1000)
    monkeypatch.setattr(lexical_search, "TREE_ROWS", 100)
    got = lexical_search.search(*tables, top=top).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(top)


def test_several_passes_find_the_same(tables, monkeypatch):
    monkeypatch.setattr(lexical_search, "PASS_BYTES", 100)
    assert sorted((tuple(r) for r in lexical_search.search(*tables).collect()), key=repr) == by_hand(50)


def test_sql_twin_agrees_on_awkward_rows(tables):
    import duckdb

    con = duckdb.connect()
    for name, rows, key in (("documents", ROWS, "doc_id"), ("benchmark", ITEMS, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(con.execute(SEARCH).fetchall(), key=repr) == by_hand(50)


def test_empty_tables(tables):
    docs, items = tables
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    n_terms, sets = 400, [rng.choice(400, 12, replace=False) for _ in range(20)]
    kinds = [rng.choice(400, 30, replace=False) for _ in range(8)]
    rows = [np.sort(rng.choice(kinds[i % 8], rng.integers(1, 20), replace=False)) for i in range(2000)] + [kinds[0][:5]] * 100
    limits = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    terms = np.concatenate(rows)
    impacts = rng.integers(1, 5 * 10**10, len(terms))
    impacts[-500:] = np.tile(impacts[-5:], 100)  # copies: no radius but that of rounding
    queries = ball_tree.Queries(sets, n_terms)
    tree = ball_tree.BallTree(limits, terms, impacts, queries, n_terms)
    seen = 0
    for q, mine in enumerate(sets):
        mask = np.zeros(n_terms, np.int64)
        mask[mine] = 1
        scores = np.add.reduceat(impacts * mask[terms], limits[:-1])
        for (lo, hi), bound in zip(tree.spans, tree.bounds[:, q]):
            assert bound >= scores[tree.order[lo:hi]].max()
        best = ball_tree.Best(5)
        best.names = np.arange(len(rows))
        seen += tree.search(q, mask, best)
        top = np.lexsort((np.arange(len(rows)), -scores))[:5]
        assert best.ids.tolist() == top[scores[top] > 0].tolist()
    leaves = sum(c is None for c in tree.children)
    assert seen < 0.9 * leaves * len(sets)
