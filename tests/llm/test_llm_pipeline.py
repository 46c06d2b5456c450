"""The corpus pipeline against a plain version of its five stages, and its registration."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from parlance.llm import blocks, quality, sentencepiece_codec
from test_llm_text import awkward, base, least_starts, near, removed


def grams(text):
    """Counters of the byte n-grams, as the definition has them: by their hash."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Counter((blocks.byte_runs(data, quality.GRAM) >> np.uint64(48)).tolist())


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", low))


def ratios(rows, trusted):
    """Both scores of every row, one text at a time, and the two cuts."""

    def of(kind, smooth):
        corpus, good = Counter(), Counter()
        for i, t in rows:
            corpus.update(kind(t))
            if i in trusted:
                good.update(kind(t))
        share = sum(good.values()) / max(sum(corpus.values()), 1)
        return lambda own, i: {
            g: (math.log((good[g] - n * (i in trusted) + smooth) / (share * (corpus[g] - n) + smooth)), n) for g, n in own.items()
        }

    byte, word, out = of(grams, quality.SMOOTH_BYTES), of(words, quality.SMOOTH_WORDS), []
    for i, t in rows:
        logs = byte(grams(t), i).values()
        low = sorted(x for x, _ in word(words(t), i).values() if x <= -quality.TELLING)[: quality.LOWEST]
        out.append((sum(x * n for x, n in logs) / max(sum(n for _, n in logs), 1), sum(low) / quality.LOWEST))
    held = [s for (i, t), s in zip(rows, out) if i in trusted and not base(t)[5]]
    cuts = [(np.quantile(x, quality.CUT_QUANTILE) if held else 0.0) - max(len(held), 1) ** -0.5 for x in (zip(*held) if held else ([], []))]
    return out, cuts


def verdicts(rows, trusted):
    scores, cuts = ratios(rows, trusted)
    return [not base(t)[5] and s[0] >= cuts[0] and s[1] >= cuts[1] for (_, t), s in zip(rows, scores)]


@pytest.mark.parametrize("n_trusted", [0, 1, 7, 90])
def test_quality_scores_and_verdicts_match_brute_force(spark, n_trusted):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([30, 400])]) for _ in range(rng.randrange(5, 90)))
    rows = [(i, text()) for i in range(150)]
    rows += [(i, f"{text()} vile Vile awful nasty {text()}") for i in range(150, 180)] + [(200 + i, "|| $$ ~~ " * 9 + text()) for i in range(9)]
    rows += [(3, "a second row of one id " + text()), (None, text()), (None, None), (201, ""), (8, rows[8][1])]
    labels = [(i, 1, 0) for i in range(n_trusted)] + [(i, 0, 0) for i in range(200, 204)] + [(i, 1, 1) for i in range(150, 160)]
    labels += [(4, 1, 0), (4, 1, 1), (None, 1, 0), (999, 1, 0)] if n_trusted else []
    trusted = set(range(n_trusted)) - {4}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    scores, _ = ratios(rows, trusted)
    want = sorted(((i, round(a, 9), round(b, 9), v) for (i, _), (a, b), v in zip(rows, scores, verdicts(rows, trusted))), key=repr)
    assert sorted(((r.doc_id, round(r.llr, 9), round(r.low_llr, 9), r.kept) for r in done), key=repr) == want
    if n_trusted == 90:
        kept = {i: v for (i, _), v in zip(rows, verdicts(rows, trusted))}
        assert not any(kept[i] for i in range(200, 209)) and sum(kept[i] for i in range(150, 180)) < 8
        assert sum(kept[i] for i in range(100)) > 90


def copies(doc_id: int, mean: float) -> int:
    u = (int(hashlib.md5(f"17|{doc_id}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p = p * mean / k
        c += p
    return k


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    rows = list({i: (i, t) for i, t in reversed(awkward()) if i is not None}.values())
    rows += [(500 + i, "||| " * 20 + f"z{i} y{i} x{i} " * 9 + "$$$ ### " * 30) for i in range(5)]
    source = {i: f"s{i % 3}" if i % 4 else "big" for i, _ in rows}
    data = [(i, t, "xx", source[i], None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    trusted = {i for i, _ in rows if i < 310}
    labels = [(i, int(i in trusted), 0) for i, _ in rows if i < 310 or i >= 500]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left = [row for row, kept in zip(rows, verdicts(rows, trusted)) if kept]
    _, parts = near(left)
    left = [(i, t) for i, t in left if parts[i] == i]
    least = least_starts(left, 50, str.encode)
    cut = []
    for i, t in left:
        gone = removed(least, 50, i, t.encode())
        cut.append((i, bytes(b for b, g in zip(t.encode(), gone) if not g).decode("utf-8", "ignore")))
    size = Counter(source[i] for i, _ in cut)
    share = {s: math.sqrt(n) / sum(map(math.sqrt, size.values())) * len(cut) / n for s, n in size.items()}
    want = Counter((i, t) for i, t in cut for _ in range(copies(i, share[source[i]])))

    done = corpus_pipeline.run(spark, str(tmp_path)).persist()
    assert done.where("not lossless").count() == 0
    got = Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode_tokens(done).collect())
    assert got == want and len(want) < len(rows)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, empty, str(tmp_path))
        assert done.columns == corpus_pipeline.COLUMNS and done.collect() == []


def test_near_dedup_stage_loses_no_text_of_a_repeated_id(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one text here", "b", "s", 3), (1, "one text here", "a", "t", 4), (1, "another text", "a", "s", 1), (1, None, None, None, None)]
    rows += [(2, long, "a", "s", 1), (3, long + " end", "a", "s", 1), (None, "x", "a", "s", 1), (None, "x", "a", "s", 1)]
    done = corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted(map(tuple, done), key=repr) == sorted([*rows[1:5], *rows[6:]], key=repr)


def test_every_operator_is_registered():
    known = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in known) == 1
    assert "pipeline" in known and set(__spark_entry__.oracle_sql()) <= set(known)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "suffix-array dedup", "mixing sources", "SentencePiece encoding",
    ]


def test_every_occurrence_and_copy_draws_its_own_dropout(spark, tmp_path):
    """Far more than four segmentations of one word, and copies that differ."""
    text = "understanding " * 50
    docs = spark.createDataFrame([(i // 3, text, "xx", "s", len(text)) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert all(r.lossless for r in done) and len({tuple(r.token_ids) for r in done}) == 60
    vocab = sentencepiece_codec.load_vocabulary()
    ways = set()
    for r in done:
        words = "|".join(vocab.pieces[t] for t in r.token_ids).split("\u2581")
        ways.update(w.strip("|") for w in words[1:-1])
    assert len(ways) > 20
    plain = sentencepiece_codec.encode_texts(docs).collect()
    assert len({tuple(r.token_ids) for r in plain}) == 20
