"""Removal, near-duplicates and quality against brute force, on rows made to be awkward."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from parlance.llm import minhash, quality, suffix_dedup, windows

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("TEXT", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("id", T.StringType()),
])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(120)
    rows = [(i, text(rng.randint(1, 160))) for i in range(20)]
    rows += [(100 + i, f"{text(30)}\n{passage}\t{text(20)}") for i in range(12)]
    rows += [(200 + i, base) for i in range(6)]
    for i in range(10):
        parts = base.split()
        for _ in range(i // 2):
            parts[rng.randrange(len(parts))] = "neu"
        rows.append((300 + i, " ".join(parts)))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "ein"), (404, "ein"), (405, "zwei drei vier fünf")]
    rows += [(406, text(9000)), (407, "A" * 3000), (408, "a" * 60), (409, passage), (410, "x\x00y " * 40)]
    rows += [(0, rows[0][1]), (205, base), (None, base), (None, None), (-3, passage)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "other", 9, "z") for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def last(i):
    return 2**63 - 1 if i is None else i


def removed(units: dict, length: int, i: int, own) -> list[bool]:
    gone = [False] * len(own)
    for p in range(len(own) - length + 1):
        if units.get(tuple(own[p : p + length]), i) < i:
            gone[p : p + length] = [True] * length
    return gone


def least_starts(rows, length, split) -> dict:
    least = {}
    for i, t in rows:
        own = split(t)
        for p in range(len(own) - length + 1):
            key = tuple(own[p : p + length])
            least[key] = min(least.get(key, last(i)), last(i))
    return least


def compare(got: list[tuple], want: list[tuple]) -> None:
    assert Counter(got) == Counter(want)


def test_suffix_removal_matches_brute_force(docs, rows):
    split = lambda t: (t or "").encode()
    least = least_starts(rows, 50, split)
    want = []
    for i, t in rows:
        gone = removed(least, 50, last(i), split(t))
        runs = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        left = bytes(b for b, g in zip(split(t), gone) if not g)
        want.append((i, len(gone), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    compare([tuple(r) for r in suffix_dedup.digest(suffix_dedup.dedup_suffixes(docs)).collect()], want)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for text in (rng.integers(0, 3, 400).astype(np.uint8), np.zeros(90, np.uint8), np.frombuffer(b"abab" * 40 + b"\0\0", np.uint8)):
        raw = text.tobytes()
        order = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        shared = suffix_dedup.common_prefixes(text, order, np.array([0, 10]), np.array([10, len(raw)]), 50)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while n < 50 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert shared[b] == n or max(a, b) + n == len(raw)


@pytest.mark.parametrize("limit", [1 << 22, 200])
def test_suffix_shards_are_merged_by_search(limit):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2, 64).astype(np.uint8)
    parts = [np.roll(pool, -k)[: 50 + k % 14] for k in rng.integers(0, 40, 60)]
    docs = rng.integers(0, 9, 60)
    got = suffix_dedup.least_documents(np.concatenate(parts), np.array([len(p) for p in parts]), docs, 50, limit)
    least: dict = {}
    keys = [(p[k : k + 50].tobytes(), d) for p, d in zip(parts, docs.tolist()) for k in range(len(p) - 49)]
    for key, d in keys:
        least[key] = min(least.get(key, d), d)
    assert got.tolist() == [least[k] for k, _ in keys]


def test_suffix_carries_columns_and_cuts_whole_characters(spark):
    text = "é" * 60
    data = spark.createDataFrame([(1, text, "a", 1), (2, "x" + text + "y", "b", 2)], "doc_id long, text string, lang string, n long")
    got = suffix_dedup.dedup_suffixes(data, carry=("lang", "n")).orderBy("doc_id").collect()
    assert [(r.lang, r.n) for r in got] == [("a", 1), ("b", 2)]
    assert got[1].kept.decode("utf-8", "ignore") == "xy"


def test_window_removal_matches_brute_force(docs, rows):
    split = lambda t: (t or "").encode().split()
    least = least_starts(rows, 50, split)
    want = []
    for i, t in rows:
        gone = removed(least, 50, last(i), split(t))
        left = b" ".join(w for w, g in zip(split(t), gone) if not g)
        want.append((i, len(gone), sum(gone), hashlib.sha256(left).hexdigest()))
    done = windows.dedup_windows(docs)
    compare([tuple(r) for r in windows.digest(done).collect()], want)
    spans = {r.doc_id: r.removed for r in done.where("n_removed > 0").collect()}
    assert all(sum(s.end - s.start for s in x) >= 50 for x in spans.values())


def near(rows, percent=75):
    sets = {}
    for i, t in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        sets.setdefault(i, shingles)
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sets, {i: top(i) for i in ids}


def test_near_duplicates_match_brute_force(docs, rows):
    sets, parts = near([r for r in rows if r[0] is not None])
    got = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    known = [g for g in got if g[0] is not None]
    compare(known, [(i, len(sets[i]), parts[i], parts[i] == i) for i, _ in rows if i is not None])
    assert all(c is None and kept for i, _, c, kept in got if i is None)


def test_near_duplicates_reach_over_members_that_their_key_does_not_link(spark):
    """Documents that share a passage and little else, and a chain of copies of copies."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(25)])) for i in range(60)]
    text = [word() for _ in range(100)]
    for i in range(30):
        rows.append((1000 - i, " ".join(text)))
        text[rng.randrange(100)] = word()
    sets, parts = near(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    compare([tuple(r) for r in got.collect()], [(i, len(sets[i]), parts[i], parts[i] == i) for i, _ in rows])
    assert len(set(parts.values())) < len(rows)


def test_band_misses_are_rare():
    """Of pairs at the limit, the bands and the signature find nearly all."""
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 62, 240).astype(np.uint64)
        b = a.copy()
        b[:34] = rng.integers(0, 1 << 62, 34).astype(np.uint64)  # 206 of 274 in common
        grams = np.concatenate((np.sort(a), np.sort(b)))
        _, _, _, marks, bands = minhash.sketch(grams, np.array([0, 240, 480]))
        missed += not (bands[0] == bands[1]).any() or (marks[0] == marks[1]).mean() < minhash.RULED_OUT
    assert missed == 0


def base(t):
    words = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = [False] * len(words)
    for k in range(len(words) - 4):
        if count[tuple(words[k : k + 5])] > 1:
            again[k : k + 5] = [True] * 5
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(again), n < 10 or 100 * sum(again) > 20 * n


def test_base_rules_match_brute_force(spark):
    rows = awkward() + [(900, "# a|b\n\n x y z z z\n# a|b\n# a|b \nq"), (901, "a b c d e f " * 9), (902, "ä" * 20 + " & <p>\n" * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.score_documents(docs, None).drop("llr", "low_llr", "kept").collect()
    compare([tuple(r) for r in got], [(i, *base(t)) for i, t in rows])


def test_likelihood_ratio_separates_junk(spark):
    rng = random.Random(8)
    good = [f"g{k}" for k in range(300)]
    bad = [f"b{k}" for k in range(300)]
    turn = lambda words, k: " ".join((words + words)[k : k + 200])
    rows = [(i, turn(bad if i % 5 == 0 else good, rng.randrange(300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    verdict = {r.doc_id: r.kept for r in quality.score_documents(docs, labels).collect()}
    assert all(verdict[i] == (i % 5 > 0) for i in verdict)
    kept = quality.keep_documents(docs.withColumnRenamed("text", "Text"), labels)
    assert kept.columns == ["doc_id", "Text"] and {r.doc_id for r in kept.collect()} == {i for i in verdict if verdict[i]}
    assert all(r.kept for r in quality.score_documents(docs, labels.limit(0)).collect())


@pytest.mark.parametrize("n", [150, 1500])
def test_production_settings_refuse_junk_and_toxic_words_on_any_size(spark, n):
    """One document in ten is junk and one in ten has a telling word; half are labelled."""
    rng = random.Random(n)
    parts, odd = ["ba", "ne", "ri", "to", "lu", "me"], ["xq", "zk", "|w", "vj"]
    text = lambda syllables: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(80))
    rows = [(i, text(odd if i % 10 == 0 else parts) + (" Trash " + text(parts) if i % 10 == 5 else "")) for i in range(n)]
    labels = [(i, int(i % 10 > 0), int(i % 10 == 5)) for i in range(n // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert not any(r.base_failed for r in done)
    assert not any(r.kept for r in done if r.doc_id % 5 == 0)
    clean = [r.kept for r in done if r.doc_id % 5]
    assert sum(clean) >= 0.98 * len(clean)


@pytest.mark.parametrize("operator", [
    suffix_dedup.dedup_suffixes, windows.dedup_windows, minhash.near_duplicates, lambda d: quality.score_documents(d, None),
])
def test_empty_tables_give_empty_results(none, operator):
    assert operator(none).collect() == []
