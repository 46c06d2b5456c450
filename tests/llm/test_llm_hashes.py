"""Different texts whose hashes a power-of-two modulus would confuse: the Thue-Morse word and its mirror."""

import numpy as np
import pytest

from parlance.llm import blocks, minhash, pieces, quality, sentencepiece_codec, token_counts, windows

MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 12))
MIRROR = MORSE.translate(str.maketrans("ab", "ba"))
COMMON = " ".join(f"w{i}" for i in range(49))


@pytest.fixture(scope="module", params=[1024, 4096])
def pair(spark, request):
    n = request.param
    rows = [(1, f"{COMMON} {MORSE[:n]}"), (2, f"{COMMON} {MIRROR[:n]}"), (3, f"{MORSE[:n]}\n{MIRROR[:n]}\nx")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_products_and_spans_modulo_the_prime():
    rng = np.random.default_rng(3)
    edge = np.array([0, 1, blocks.PRIME - 1, blocks.PRIME // 2], np.uint64)
    a = np.concatenate((np.repeat(edge, 4), rng.integers(0, blocks.PRIME, 5000, dtype=np.uint64)))
    b = np.concatenate((np.tile(edge, 4), rng.integers(0, blocks.PRIME, 5000, dtype=np.uint64)))
    assert blocks.times(a, b).tolist() == [int(x) * int(y) % blocks.PRIME for x, y in zip(a, b)]
    for high in (256, 2**21, 2**63):
        values = rng.integers(0, high, 900).astype(np.uint64)
        want = [sum(int(v) * pow(blocks.BASE, k, blocks.PRIME) for k, v in enumerate(values[s:e])) % blocks.PRIME for s, e in ((0, 900), (13, 14), (40, 700))]
        got = blocks.span_hash(blocks.prefix_hash(values), np.array([0, 13, 40]), np.array([900, 14, 700]))
        assert got.tolist() == blocks.mix(np.array(want, np.uint64)).tolist()


@pytest.mark.parametrize("length", [1, 3, 5, 8, 11, 16, 50])
def test_runs_are_equal_exactly_where_the_bytes_are(length):
    data = np.frombuffer((MORSE + "abc" * 50 + MIRROR).encode(), np.uint8)
    for hashes in (blocks.byte_runs(data, length), blocks.run_hashes(blocks.mix(data.astype(np.uint64)), length)):
        runs = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(hashes) == len(runs) and len(set(zip(runs, hashes.tolist()))) == len(set(runs)) == len(set(hashes.tolist()))


def test_windows_with_different_words_stay(pair):
    assert {r.doc_id: r.n_removed for r in windows.digest(windows.dedup_windows(pair)).collect()} == {1: 0, 2: 0, 3: 0}


def test_different_sets_do_not_link(spark, pair):
    short = pair.selectExpr("doc_id", "regexp_replace(text, '^(w\\\\d+ )+', '') as text")
    assert all(r.kept for r in minhash.near_duplicates(short).collect())


def test_different_lines_are_no_duplicates(pair):
    got = {r.doc_id: r.n_dup_lines for r in quality.score_documents(pair, None).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


def test_different_chunks_decode_to_themselves(pair):
    assert all(r.lossless for r in sentencepiece_codec.encode_texts(pair).collect())


def test_names_that_collide_do_not_merge_chunks(monkeypatch):
    monkeypatch.setattr(blocks, "quick_names", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    text = np.array([ord(c) for c in "abababcdab"])
    _, place, which = pieces.distinct(text, np.array([0, 2, 4, 6, 8, 10]))
    assert place.tolist() == [0, 3] and which.tolist() == [0, 0, 0, 1, 0]


def test_token_counts_tell_the_words_apart(spark):
    from test_llm_rows import count_by_hand

    vocab = pieces.load_vocabulary()
    order = sorted(vocab.known.values(), key=lambda i: vocab.priority[i])
    scores = {tuple(map(ord, vocab.pieces[i])): -np.log(k + 1.0) for k, i in enumerate(order)}
    texts = {1: MORSE[:1024], 2: MIRROR[:1024], 3: "x"}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: count_by_hand(scores, [pieces.SPACE, *map(ord, t)]) for i, t in texts.items()}


def test_long_pretokens_walk_as_the_trie_does(monkeypatch):
    scores = token_counts.Scores(pieces.load_vocabulary())
    rng = np.random.default_rng(4)
    codes = [ord(c) for c in "theandionsxé日\u2581"]
    size = rng.integers(1, 300, 40)
    text = rng.choice(codes, size.sum())
    begin = np.cumsum(size) - size
    monkeypatch.setattr(token_counts, "LONG", 1000)
    levels = token_counts.terminal_counts(scores, text, begin, size)
    monkeypatch.setattr(token_counts, "LONG", 0)
    assert token_counts.terminal_counts(scores, text, begin, size).tolist() == levels.tolist()
    long = rng.choice(codes, 100_000)
    assert 0 < token_counts.terminal_counts(scores, long, np.array([0]), np.array([100_000]))[0] <= 300_000
