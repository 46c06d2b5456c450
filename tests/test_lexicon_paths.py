"""Lexicon and gazetteer operators give one result, inlined or joined, list or table."""

import pytest

from parlance.operators import entities, features, labels, lexicon, patterns, prefix
from parlance.schema import KEY

ENTRIES = ["chose", "bien-être", "", "la chose", "é", "chose"]
PHRASES = [("Saint-Étienne", "LOC"), ("P.S.", "ORG"), ("p s", "LAW"), ("de", "ORG"), ("la loi de finances", "law"), ("", "ORG")]
TEXTS = ["La chose, chose du bien-être", "La chose, chose du bien-être", "", None, "Le P.S. de Saint-Étienne, la loi de finances", "été & loi"]


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [("same", TEXTS[0]), ("same", TEXTS[1]), *((f"k{i}", t) for i, t in enumerate(TEXTS))]
    return spark.createDataFrame(rows, f"{KEY} string, sentence string")


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("a", t, (t or "").lower()) for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id string, text string, lemma_text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_token_hits(spark, sentences):
    names = ("n_vague_words", "vague_ratio")
    entries = ["chose", "du", "", "été"]
    held = table(spark, [(e,) for e in entries], "entry string")
    want = rows(features.add_lexicon_hits(sentences, entries, *names))
    for given in (entries, held):
        assert rows(features.add_lexicon_hits(sentences, given, *names, max_inline=0)) == want
    assert rows(features.add_lexicon_hits(sentences, held, *names)) == want


def test_entity_counts(spark, sentences):
    held = table(spark, PHRASES, "phrase string, type string")
    want = rows(entities.entity_counts(sentences, PHRASES))
    for given in (PHRASES, held):
        for limit in (0, 100):
            assert rows(entities.entity_counts(sentences, given, max_inline=limit)) == want
    both = next(r for r in entities.entity_counts(sentences, PHRASES).collect() if r.sentence and r.sentence.startswith("Le P.S."))
    # "P.S." and "p s" are one phrase with the least of its types
    assert (both.n_ent_org, both.n_ent_loc, both.n_ent_law, both.n_ent_total) == (1, 1, 2, 4)


def test_scores_and_contexts(spark, documents):
    held = table(spark, [(e,) for e in ENTRIES], "entry string")
    want, context = rows(lexicon.lexicon_score(documents, ENTRIES)), rows(lexicon.keyword_in_context(documents, ENTRIES))
    assert context
    for given in (ENTRIES, held):
        assert rows(lexicon.lexicon_score(documents, given, max_inline=0)) == want
        assert rows(lexicon.keyword_in_context(documents, given, max_inline=0)) == context
    assert rows(lexicon.keyword_in_context(documents, [])) == []


def test_lemmatize_keeps_documents_of_one_name_apart(spark):
    documents = table(spark, [("a", "1981", "Les bons mots"), ("a", "1988", "la loi dure"), ("b", "1988", None)], "doc_id string, date string, text string")
    lemmas = table(spark, [("les", "le"), ("bons", "bon"), ("bons", "bonne"), ("mots", "mot")], "form string, lemma string")
    got = {(r.doc_id, r.date): r.lemma_text for r in lexicon.lemmatize(documents, lemmas).collect()}
    assert got == {("a", "1981"): "le bon mot", ("a", "1988"): "la loi dure", ("b", "1988"): ""}


PAIRS = [("chevaux", "cheval"), ("journaux", "journal"), ("canaux", "canal"), ("tables", "table"), ("portes", "porte"), ("bras", "bras"),
         ("gras", "gras"), ("aux", "à"), ("mots", "mot"), ("mots", "mots")]


@pytest.mark.parametrize("limits", [(64, 10**6), (0, 10**6), (0, 0)])
def test_unseen_forms_are_rewritten_by_the_longest_suffix(spark, limits):
    lemmas = table(spark, PAIRS, "form string, lemma string")
    rules = lexicon.lemma_rules(lemmas)
    learnt = {r.suffix: (r.strip, r.append) for r in rules.collect()}
    assert learnt["aux"] == (2, "l") and learnt["ras"] == (0, "") and learnt["es"] == (1, "")
    texts = [("1", "a", "Les canaux Locaux, les locaux et tables rases"), ("1", "b", "locaux as ux s"), ("2", "a", None), ("3", "a", " ")]
    documents = table(spark, texts, "doc_id string, date string, text string")
    got = {(r.doc_id, r.date): r.lemma_text for r in lexicon.lemmatize(documents, lemmas, rules, *limits).collect()}
    assert got == {("1", "a"): "le canal locaux, le local et table rase", ("1", "b"): "local as ux s", ("2", "a"): "", ("3", "a"): ""}
    plain = {(r.doc_id, r.date): r.lemma_text for r in lexicon.lemmatize(documents, lemmas, None, *limits).collect()}
    assert plain["1", "a"] == "les canal locaux, les locaux et table rases"


def test_lemmas_scores_and_contexts_need_no_exchange(spark, documents):
    lemmas = table(spark, PAIRS, "form string, lemma string")
    held = table(spark, [(e,) for e in ENTRIES], "entry string")
    frames = [lexicon.lemmatize(documents, lemmas, *more) for more in ((), (lexicon.lemma_rules(lemmas),))]
    frames += [lexicon.lexicon_score(documents, held, max_inline=0), lexicon.keyword_in_context(documents, held, max_inline=0)]
    for frame in frames:
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_several_slices_find_the_same(spark, documents, sentences, monkeypatch):
    want = rows(lexicon.lexicon_score(documents, ENTRIES)), rows(lexicon.keyword_in_context(documents, ENTRIES))
    counts = rows(entities.entity_counts(sentences, PHRASES))
    monkeypatch.setattr(patterns, "SLICE_CHARS", 4)
    held = table(spark, [(e,) for e in ENTRIES], "entry string")
    assert len(list(patterns.pattern_slices(lexicon.lexicon_table(documents, held), "entry"))) > 1
    assert rows(lexicon.lexicon_score(documents, held, max_inline=0)) == want[0]
    assert rows(lexicon.keyword_in_context(documents, held, max_inline=0)) == want[1]
    assert rows(entities.entity_counts(sentences, PHRASES, max_inline=0)) == counts


def test_normalised_lists_and_tables_agree(spark, sentences):
    phrases = [*PHRASES, ("İstanbul ΣΑΣ", "loc"), ("  ", "x"), ("été_1", "Org"), ("ÉTÉ_1", "law")]
    made = entities.gazetteer_table(sentences, phrases)
    assert entities.gazetteer_list(phrases) == sorted(map(tuple, made.collect()))


def test_all_unknown_labels_are_listed(spark):
    sheet = table(spark, [(str(i), f"wrong{i}") for i in range(150)], f"{KEY} string, label string")
    with pytest.raises(ValueError) as caught:
        labels.check_labels(sheet)
    assert all(f"wrong{i}'" in str(caught.value) for i in range(150))


def test_small_running_totals_need_no_join(spark):
    frame = table(spark, [(i % 7, i) for i in range(50)] + [(None, 3)], "g int, v long")
    done = prefix.range_prefix(frame, [], ["v", "g"], "v")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    ordered = sorted((r.v, -1 if r.g is None else r.g, r.before, r.total) for r in done.collect())
    total = 0
    for v, _, before, whole in ordered:
        assert (before, whole) == (total, sum(range(50)) + 3)
        total += v
