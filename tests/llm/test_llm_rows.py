"""Pieces, vectors, archives, chat and mixing on awkward rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import chat, embedding_dedup, mixing, pieces, sentencepiece_codec, token_counts, warc
from parlance.llm.graph import components
from parlance.session import scratch_path

TEXTS = [
    None, "", " ", "a", " a  b\tc\n\nd ﬁ é é", "▁x ▁▁ y", "a" * 500 + " " * 70 + "b", "\n", "日本語 𝔘nicode\x00z <s> <0x41>",
    "The quick brown fox jumps over the lazy dog. " * 40,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9], 6), (None, "null id", 7), (None, None, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_pieces_without_dropout_are_the_vocabulary_s_own(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.PIECE_MODEL)
    for r in sentencepiece_codec.encode_texts(texts, rate=0.0).collect():
        text = "null id" if r.doc_id is None and r.n_tokens else "" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.lossless and r.n_tokens == len(r.token_ids)
        if "▁" not in text:
            assert r.token_ids == model.encode(text)


def test_dropout_varies_is_repeatable_and_decodes(texts):
    coded = sentencepiece_codec.encode_texts(texts, rate=0.3, seed=5)
    first = [(r.doc_id, r.token_ids) for r in coded.collect()]
    assert sorted(first, key=str) == sorted([(r.doc_id, r.token_ids) for r in sentencepiece_codec.encode_texts(texts.repartition(5), rate=0.3, seed=5).collect()], key=str)
    other = {r.doc_id: r.token_ids for r in sentencepiece_codec.encode_texts(texts, rate=0.3, seed=6).collect()}
    assert other[9] != dict(first)[9]
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_tokens(coded.where("doc_id is not null")).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    one = next(t for i, t in first if i == 9)
    vocab = pieces.load_vocabulary()
    said = [vocab.pieces[t] for t in one]
    assert said.count("▁brown") < 40 and "▁brown" in said  # more than one segmentation of a word


def test_queue_and_side_by_side_merge_alike():
    vocab, rng = pieces.load_vocabulary(), random.Random(1)
    for rate in (0.0, 0.3):
        for _ in range(60):
            codes = np.array([ord(rng.choice("▁theandionsxé")) for _ in range(rng.randint(1, 40))])
            symbols, key = vocab.char_ids[codes].astype(np.int64), np.uint64(rng.getrandbits(60))
            grid, size = sentencepiece_codec.merge_side_by_side(vocab, symbols[None, :], np.array([len(codes)]), np.array([key]), rate)
            assert grid[0, : size[0]].tolist() == sentencepiece_codec.merge_by_queue(vocab, symbols.tolist(), key, rate)


def count_by_hand(scores: dict, pretoken: list[int]) -> int:
    """Best path over one pre-token, without a trie."""
    best = [(0.0, 0)]
    for end in range(1, len(pretoken) + 1):
        options = []
        for begin in range(max(0, end - 16), end):
            score = scores.get(tuple(pretoken[begin:end]))
            if score is not None:
                options.append((best[begin][0] + score, -best[begin][1] - 1))
        code = pretoken[end - 1]
        spelled = 3 if code == pieces.LITERAL else len(chr(code).encode())
        options.append((best[end - 1][0] + token_counts.BYTE_SCORE * spelled, -best[end - 1][1] - spelled))
        score, tokens = max(options)
        best.append((score, -tokens))
    return best[-1][1]


def test_token_counts_match_brute_force(texts):
    vocab = pieces.load_vocabulary()
    ids = sorted(vocab.known.values(), key=lambda i: vocab.priority[i])
    scores = {tuple(map(ord, vocab.pieces[i])): -float(np.log(k + 1.0)) for k, i in enumerate(ids)}
    for r in token_counts.count_tokens(texts).collect():
        text = TEXTS[r.doc_id] or "" if r.doc_id is not None else "null id" if r.n_tokens else ""
        codes = np.array([ord(c) for c in text], np.int64)
        marked, starts, _ = pieces.chunks(codes, np.array([0, len(codes)]))
        parts = [marked[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
        assert (r.n_pretokens, r.n_tokens) == (len(parts), sum(count_by_hand(scores, p) for p in parts)), text


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.3])).tolist(), i % 3) for i in range(400)]
    hot = rng.standard_normal(16)
    rows += [(1000 + i, (hot + rng.standard_normal(16) * 0.13).tolist(), 1) for i in range(700)]
    rows += [(2000 + i, hot.tolist(), 1) for i in range(4)] + [(2004, (hot * 3).tolist(), 1), (2005, hot.tolist(), 2)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [math.nan] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1)]
    rows += [(3004, [], 1), (3005, hot.tolist(), None), (None, hot.tolist(), 1), (3006, [1.0, 0.0], 1), (3007, [1.0, 1e-3], 1)]
    rows += [(2000, hot.tolist(), 1), (3008, [math.inf] * 16, 1)]
    return rows


def test_vector_links_match_brute_force(spark):
    rows = vectors()
    usable = [
        (i, np.array(v), l) for i, v, l in rows
        if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links, root = {}, {i: i for i, _, _ in usable}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, v, l) in enumerate(usable):
        links[a] = 0
        for b, (j, w, m) in enumerate(usable):
            if a != b and l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[a] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = sorted((i, links[a], top(i), top(i) == i) for a, (i, _, _) in enumerate(usable))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = [tuple(r) for r in embedding_dedup.near_vectors(frame).collect()]
    known = {i for i, _, _ in usable}
    assert sorted(g for g in got if g[0] in known) == want
    rest = [g for g in got if g[0] not in known]
    assert len(rest) == len(rows) - len(usable) and all(n == 0 and c == i and kept for i, n, c, kept in rest)
    assert embedding_dedup.near_vectors(frame.limit(0)).collect() == []


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(70, 70), (49, 60), (60, 61)]
    random.Random(2).shuffle(chain)
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in [*range(1, 50), 60, 61]}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


PAGES = [
    (5, "http://a/1", "x" * 200), (3, "http://a/2\r\nWARC-Type: evil", "x" * 200), (9, None, "x" * 200), (4, "u", "y" * 99),
    (6, "u", "y" * 99), (7, "u", None), (8, "u", ""), (10, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n\r\n" + "é" * 50),
    (11, "u", "\r\n\r\n" * 60), (2, "u", "\r\n\r\n" * 60), (12, "u", "é" * 50), (1, "u", "é" * 50), (3, "http://a/2", "x" * 200),
    (None, "u", "x" * 200), (20, "u", "z" * 300_000),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, compression):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("original", F.lit(1))
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame, path, compression=compression)
    archive = warc.read_archives(spark, path)
    revisits = archive.where("record_type = 'revisit'")
    assert archive.count() == len(PAGES) and revisits.where("octet_length(payload) > 0").count() == 0
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(archive).collect()}
    import hashlib

    first: dict = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, html in PAGES:
        data = (html or "").encode()
        to = first.get(data)
        to = None if to == i else to
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to)


def test_no_pages_no_records(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read_archives(spark, path)).collect() == []


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_tool_calls_are_linked_ordered_and_checked(spark):
    good = json.dumps({"turn": 1, "question": "é \"q\""})
    calls = [
        (1, "a", 0, "answer", good, None), (1, "b", 2, "answer", good, "a"), (1, "c", 4, "answer", good, "b"),
        (1, "a", 9, "answer", "{}", "c"), (1, "d", 5, "answer", '{"turn": 1.5, "question": 3}', None), (1, "e", 6, "nope", good, "gone"),
        (1, "f", 7, "answer", "{not json", None), (1, "g", 8, "answer", good, "h"), (1, "h", 8, "answer", good, "g"), (1, "i", 8, "answer", good, "h"),
        (None, "a", 0, "answer", good, None), (1, None, 0, "answer", good, None), (2, "a", 0, "answer", None, None),
        (2, "n", 0, "answer", '{"turn": NaN, "question": "x"}', None), (1, "c", 4, "answer", good, "b"),
    ]
    calls += [(7, f"k{i:03}", i, "setup", '{"prompt": "p"}', f"k{i - 1:03}") for i in range(40)]
    results = [(1, "a", 1, "one"), (1, "a", 3, "later"), (1, "b", 3, None), (1, "z", 3, "alone"), (None, "a", 1, "x")]
    got = chat.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
    ).collect()
    aside = sorted((r.status, r.conv_id or 0, r.call_id or "") for r in got if r.status in ("superseded", "unlinked"))
    assert aside == [("superseded", 1, "a")] * 2 + [("unlinked", 0, "a")] * 2 + [("unlinked", 1, "")]
    got = [r for r in got if r.status not in ("superseded", "unlinked")]
    status = {(r.conv_id, r.call_id): (r.status, r.depth) for r in got}
    assert len(got) == len(status) == 12 + 40
    assert status[1, "a"] == ("ok", 0) and status[1, "b"] == ("ok", 1) and status[1, "c"] == ("no_result", 2)
    assert status[1, "d"] == ("invalid_arguments", 0) and status[1, "e"] == ("unknown_tool", 0) and status[1, "f"] == ("invalid_json", 0)
    assert {status[1, x] for x in "ghi"} == {("cycle", None)} and status[1, "z"] == ("orphan_result", None)
    assert status[2, "a"][0] == status[2, "n"][0] == "invalid_json"
    assert [r.depth for r in got if r.conv_id == 7] == list(range(40))
    assert next(r.message for r in got if (r.conv_id, r.call_id) == (1, "a")) == '{"arguments":{"question":"é \\"q\\"","turn":1},"id":"a","name":"answer","result":"one"}'
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link_tool_calls(*chat.calls_of_turns(empty)).collect() == []


def test_mixing_follows_the_weights(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 7}", 1) for i in range(6000)] + [(None, "n", None, 1), (None, "m", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, Copy int")
    weights = {"big": 1.0, "s0": 3.0, "s1": 0.0, "": 0.001}
    mixed = mixing.mix_sources(frame, weights, target_rows=20_000)
    assert mixed.columns == ["doc_id", "text", "source", "copy"]
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] - 5000) < 4 * 71 and abs(counts["s0"] - 15_000) < 4 * 123 and set(counts) <= {"big", "s0", None}
    per = [r["count"] for r in mixed.where("source = 's0'").groupBy("doc_id").count().collect()]
    assert abs(np.var(per) / np.mean(per) - 1) < 0.3  # Poisson
    again = mixing.mix_sources(frame.repartition(7), weights, target_rows=20_000)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))
    assert mixing.mix_sources(frame.limit(0)).collect() == [] and mixing.mix_sources(frame, {}).collect() == []


def test_mixing_large_rates_and_many_sources_take_the_same_way(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (2, "b", "y")], "doc_id long, text string, source string")
    few = mixing.mix_sources(frame, {"x": 1.0, "y": 1.0}, target_rows=3000).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in few}
    assert abs(counts["x"] - 1500) < 160 and abs(counts["y"] - 1500) < 160
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = mixing.mix_sources(frame, {"x": 1.0, "y": 1.0}, target_rows=3000).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in salted} == counts
