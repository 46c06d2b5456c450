"""The registered queries once more, as SQL for an independent engine (RE2 regexes)."""

from __future__ import annotations

from parlance.functions import fixed_values as fv
from parlance.operators.stats import threshold_grid
from parlance.plans import inputs as q
from parlance.schema import LINGUISTIC_FEATURES

CAP = 2_500
SAMPLE_TARGET = 1_100

_SPACE = r"[\t-\r\x1c-\x20\x{85}\pZ]"
_WORD = r"[^\t-\r\x1c-\x20\x{85}\pZ]+"
_BREAKS = r"[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LETTER = r"[\pL\pN_]"
_EDGE = r"(?:^|[^\pL\pN_])"
_END = r"(?:$|[^\pL\pN_])"


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _re2(regex: str) -> str:
    return regex.replace(r"\s", _SPACE).replace(r"\d", r"\p{Nd}")


def _n_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{_WORD}'))"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{_WORD}')"


_MARKER = "(?i)" + _re2("|".join(fv.ADMIN_MARKERS))
_AGE = _EDGE + _re2(r"\d{2}\s+ans") + _END
_NAME = _re2(fv.BIOGRAPHY_PATTERNS[1])
_VERB = (
    f"(?i){_EDGE}(?:{_LETTER}+(?:{'|'.join(fv.VERB_ENDINGS)})|(?:{'|'.join(fv.AUXILIARIES)})){_END}"
)
_ADMIN = f"""(regexp_matches(line, '{_MARKER}') OR regexp_matches(line, '{_AGE}')
  OR regexp_matches(line, '{_NAME}')
  OR ({_n_tokens('line')} < {fv.MIN_LINE_WORDS} AND NOT regexp_matches(line, '{_VERB}')))"""


def _line_array(text: str) -> str:
    return (
        f"list_filter(string_split_regex({text}, '{_BREAKS}'), "
        f"lambda l: regexp_matches(l, '{_WORD}'))"
    )


def _clean(text: str) -> str:
    joined = f"array_to_string({_line_array(text)}, ' ')"
    untagged = f"regexp_replace({joined}, '<[^>]+>', '', 'g')"
    unnoted = rf"regexp_replace({untagged}, '\[.*?\]', '', 'g')"
    return f"trim(regexp_replace({unnoted}, '{_SPACE}+', ' ', 'g'))"


_SHORT = "'" + "|".join(sorted(fv.ABBREVIATIONS, key=len, reverse=True)) + "'"


def _split(text: str, short: str = _SHORT) -> str:
    out = text
    for _ in range(2):
        out = rf"regexp_replace({out}, '(^|[^\pL\pN])(' || {short} || '|\p{{Lu}})\.', '\1\2' || chr(64977), 'g')"
    out = rf"""regexp_replace({out}, '((?:\.{{2,}}|…|\p{{Nd}}\.)[»")\]]*) (\p{{Ll}})',
      '\1' || chr(64978) || '\2', 'g')"""
    out = rf"""regexp_replace({out}, '([.!?…]+[»")\]]*) ', '\1' || chr(64976), 'g')"""
    out = f"replace(replace({out}, chr(64977), '.'), chr(64978), ' ')"
    return (
        f"list_filter(list_transform(string_split({out}, chr(64976)), lambda s: trim(s)), "
        f"lambda s: {_n_tokens('s')} >= {fv.MIN_SENTENCE_WORDS})"
    )


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS date, source AS classe, text FROM documents)"
_LINES = f"""line_lists AS (SELECT doc_id, {_line_array('text')} AS ls FROM docs),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS line_no,
  unnest(ls) AS line FROM line_lists),
judged AS (SELECT doc_id, line_no, {_ADMIN} AS is_admin FROM lines),
ratios AS (SELECT d.doc_id, coalesce(round(max(j.r), 4), 0.0) AS filter_ratio FROM docs d
  LEFT JOIN (SELECT doc_id, count(*) FILTER (is_admin) / CAST(count(*) AS DOUBLE) AS r
    FROM judged GROUP BY doc_id) j USING (doc_id) GROUP BY d.doc_id)"""
_SENTS = f"""cleaned AS (SELECT doc_id, date, classe, {_clean('text')} AS text FROM docs),
pieces AS (SELECT doc_id, date, classe, {_split('text')} AS ss FROM cleaned),
numbered AS (SELECT doc_id, date, classe, unnest(range(len(ss))) AS sent_idx,
  unnest(ss) AS sentence FROM pieces),
sents AS (SELECT doc_id, doc_id || '_' || sent_idx AS "PRIMARY_KEY", date, classe, sent_idx, sentence,
  filter_ratio FROM numbered JOIN ratios USING (doc_id))"""
TEXT = f"WITH {_DOCS},\n{_LINES},\n{_SENTS}"


def _count(regex: str) -> str:
    return f"len(regexp_extract_all(sentence, '{regex}'))"


def _hits(words) -> str:
    return f"len(list_filter(toks, lambda t: t IN ({_quoted(sorted(set(words)))})))"


_N = "greatest(len(toks), 1)"
_FEATS = rf"""tokenised AS (SELECT *, {_tokens('lower(sentence)')} AS toks FROM sents),
feats AS (SELECT *,
  {_count(r'\p{Nd}+')} AS n_digits,
  {_count(r'(?i)' + _re2('|'.join(fv.DATE_PATTERNS)))} AS n_dates,
  {_count(r'(?i)' + _re2(fv.MONEY_PATTERN))} AS n_money,
  {_count(_re2(fv.PERCENT_PATTERN))} AS n_percent,
  {_count(r'\p{Nd}+')} / CAST({_N} AS DOUBLE) AS numeric_ratio,
  {_hits(q.VAGUE)} AS n_vague_words, {_hits(q.VAGUE)} / CAST({_N} AS DOUBLE) AS vague_ratio,
  {_hits(q.MODAL)} AS n_modal_verbs, {_hits(q.MODAL)} / CAST({_N} AS DOUBLE) AS modal_ratio
  FROM tokenised)"""
FEATURES = f"{TEXT},\n{_FEATS}"

_GAZ = ", ".join(f"('{p}', '{t}', {len(p.split())})" for p, t in q.GAZETTEER)


def _entities(gazetteer: str) -> str:
    return rf"""gaz(phrase, type, size) AS ({gazetteer}),
worded AS (SELECT "PRIMARY_KEY", regexp_extract_all(lower(sentence), '[\pL\pN_]+') AS ws FROM sents),
placed AS (SELECT "PRIMARY_KEY", ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
sized AS (SELECT *, unnest((SELECT list(DISTINCT size) FROM gaz)) AS size FROM placed),
hits AS (SELECT "PRIMARY_KEY", i, i + size AS j, type FROM sized JOIN gaz USING (size)
  WHERE phrase = array_to_string(ws[i:i + size - 1], ' ') AND i + size - 1 <= len(ws)),
longest AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o
  WHERE o."PRIMARY_KEY" = h."PRIMARY_KEY" AND o.i <= h.i AND o.j >= h.j AND o.j - o.i > h.j - h.i)),
ents AS (SELECT "PRIMARY_KEY", count(*) FILTER (type = 'ORG') AS org,
  count(*) FILTER (type IN ('LOC', 'GPE')) AS loc, count(*) FILTER (type = 'LAW') AS law, count(*) AS n
  FROM longest GROUP BY 1),
ent_counts AS (SELECT "PRIMARY_KEY", coalesce(org, 0) AS n_ent_org, coalesce(loc, 0) AS n_ent_loc,
  coalesce(law, 0) AS n_ent_law, coalesce(n, 0) AS n_ent_total FROM sents LEFT JOIN ents USING ("PRIMARY_KEY"))"""


_ENTITIES = _entities(f"VALUES {_GAZ}")
_BENCHMARK_GAZ = r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM benchmark)
  SELECT DISTINCT unnest(w), 'LOC', 1 FROM b
  UNION SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 'ORG', 2 FROM b WHERE len(w) > 1"""
_SENTIMENT = f"""polar AS (SELECT "PRIMARY_KEY", CAST({_hits(q.POSITIVE)} AS DOUBLE) AS p,
  CAST({_hits(q.NEGATIVE)} AS DOUBLE) AS n FROM tokenised),
senti AS (SELECT "PRIMARY_KEY", p / greatest(p + n, 1) AS sentiment_positive,
  n / greatest(p + n, 1) AS sentiment_negative,
  abs(p / greatest(p + n, 1) - n / greatest(p + n, 1)) AS sentiment_intensity FROM polar)"""
_FULL = f"""{FEATURES},
{_ENTITIES},
{_SENTIMENT},
full_feats AS (SELECT f.*, e.* EXCLUDE ("PRIMARY_KEY"), s.* EXCLUDE ("PRIMARY_KEY") FROM feats f
  JOIN ent_counts e USING ("PRIMARY_KEY") JOIN senti s USING ("PRIMARY_KEY"))"""

_Z = f"{q.INTERCEPT} + " + " + ".join(f"{n} * ({w})" for n, w in q.WEIGHTS.items())
_POS, _NEG = "'langue_de_bois'", "'non_langue_de_bois'"


def _tree(node) -> str:
    if not isinstance(node, tuple):
        return str(node)
    name, threshold, low, high = node
    place = name.replace("[", "").replace("]", "").replace("embedding", "")
    value = f"embedding[{int(place) + 1}]" if name.startswith("embedding") else name
    return f"CASE WHEN {value} <= {threshold} THEN {_tree(low)} ELSE {_tree(high)} END"


_TREES = " + ".join(_tree(t) for t in q.TREES)
SCORED = f"""{FEATURES},
scored AS (SELECT *, CASE WHEN proba >= {q.THRESHOLD} THEN {_POS} ELSE {_NEG} END AS pred
  FROM (SELECT *, round(1 / (1 + exp(-({_Z}))), 6) AS proba FROM feats))"""
_DOC_LABELS = f"""doc_labels AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN quality = 1 THEN {_POS} ELSE {_NEG} END AS label FROM labels)"""
LABELLED = f"""{SCORED},
{_DOC_LABELS},
lab AS (SELECT s.*, label, CAST(label = {_POS} AS INTEGER) AS y FROM scored s JOIN doc_labels USING (doc_id)),
ys AS (SELECT "PRIMARY_KEY", doc_id, y, proba, CAST(proba >= {q.THRESHOLD} AS INTEGER) AS pred FROM lab)"""

_SHEET = f"""sheet AS (SELECT CAST(doc_id AS VARCHAR) AS "PRIMARY_KEY",
  CASE WHEN quality = 1 AND toxic = 0 THEN {_POS} WHEN toxic = 0 THEN {_NEG}
    WHEN quality = 1 THEN '  ' END AS label, doc_id AS ord FROM labels
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'autre', doc_id + 1000000000 FROM labels),
clean AS (SELECT "PRIMARY_KEY", label FROM (SELECT *, row_number() OVER (PARTITION BY "PRIMARY_KEY" ORDER BY ord) AS rn
  FROM sheet WHERE trim(label) <> '') WHERE rn = 1)"""
SHEET = f"WITH {_DOCS},\n{_SHEET}"
HALF = f"""{SHEET},
half AS (SELECT doc_id AS "PRIMARY_KEY", date, classe, coalesce(label, ' ') AS label
  FROM docs LEFT JOIN clean ON doc_id = "PRIMARY_KEY")"""


def _seeded(seed: int = 42, key: str = '"PRIMARY_KEY"') -> str:
    return f"md5('{seed}:' || {key}), {key}"


_RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_seeded()}) - 1 AS rk,
  count(*) OVER (PARTITION BY y) AS total FROM lab),
tests AS (SELECT *, round(total * 0.15) AS n_test FROM ranked),
vals AS (SELECT *, round((total - n_test) * (0.15 / 0.85)) AS n_val FROM tests),
split AS (SELECT *, CASE WHEN rk < n_test THEN 'test' WHEN rk < n_test + n_val THEN 'val'
  ELSE 'train' END AS split FROM vals)"""

_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, y FROM lab" for f in q.STAT_FEATURES
)
_DECILES = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def _binned(source: str, steps: str = _DECILES) -> str:
    return f"""edges AS (SELECT feature,
  list_sort(list_distinct(quantile_cont(value, {steps}))) AS es FROM {source} GROUP BY feature),
binned AS (SELECT v.*, CASE WHEN len(es) > 1 THEN
  CAST(len(list_filter(es[2:len(es) - 1], lambda e: e < value)) AS BIGINT) END AS bin
  FROM {source} v JOIN edges USING (feature))"""


_IV = f"""{LABELLED},
long AS ({_UNPIVOT}),
{_binned('long')},
bins AS (SELECT feature, bin, count(*) AS total, sum(y) AS ev FROM binned WHERE bin IS NOT NULL GROUP BY ALL),
shares AS (SELECT feature, ev / sum(ev) OVER w AS d1, (total - ev) / sum(total - ev) OVER w AS d0
  FROM bins WINDOW w AS (PARTITION BY feature)),
found AS (SELECT feature, sum((d1 - d0) * ln(d1 / d0)) AS iv FROM shares WHERE d1 > 0 AND d0 > 0 GROUP BY feature),
ivs AS (SELECT feature, coalesce(iv, 0.0) AS iv FROM edges LEFT JOIN found USING (feature))"""


def _bin_range(source: str) -> str:
    return (
        "SELECT feature, bin, count(*) AS total, round(min(value), 6) AS min_value, "
        f"round(max(value), 6) AS max_value FROM {source} WHERE bin IS NOT NULL GROUP BY ALL"
    )


_P = "greatest(least(proba, 1 - 1e-8), 1e-8)"
RESIDUALS = f"""{LABELLED},
res AS (SELECT *, (y - p) / sqrt(p * (1 - p)) AS pearson,
  sign(y - p) * sqrt(greatest(-2 * (y * ln(p) + (1 - y) * ln(1 - p)), 0)) AS deviance
  FROM (SELECT *, {_P} AS p FROM ys))"""


def _equal_width(source: str, column: str, n: int) -> str:
    """Edges as numbers, value to the first bin whose upper edge reaches it."""
    return f"""span AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
cut AS (SELECT s.*, lo, (hi - lo) / {n} AS width,
  CAST(len(list_filter(range(1, {n}), lambda i: lo + (hi - lo) / {n} * i < {column})) AS BIGINT) AS bin
  FROM {source} s, span)"""


def _groups(n: int) -> str:
    steps = "[" + ", ".join(repr(i / n) for i in range(n + 1)) + "]"
    return f"""{LABELLED},
ps AS (SELECT 'p' AS feature, proba AS value, y FROM ys),
{_binned('ps', steps)},
grp AS (SELECT bin AS decile, CAST(sum(y) AS BIGINT) AS obs_pos, count(*) AS total, avg(value) AS mean_p
  FROM binned WHERE bin IS NOT NULL GROUP BY 1),
hl AS (SELECT decile, obs_pos, total - obs_pos AS obs_neg, total, mean_p, total * mean_p AS exp_pos,
  total * (1 - mean_p) AS exp_neg FROM grp)"""


HL = _groups(10)


def _hosmer(n: int) -> str:
    """The upper tail of chi-square is one less the series of the incomplete gamma function."""
    return f"""{_groups(n)}, t AS (SELECT sum((obs_pos - exp_pos) ** 2 / greatest(exp_pos, 1e-8)
    + (obs_neg - exp_neg) ** 2 / greatest(exp_neg, 1e-8)) AS chi2, count(*) AS n_groups FROM hl),
  p AS (SELECT *, CASE WHEN chi2 > 400 THEN 0.0 ELSE 1 - list_sum(list_transform(range(400), lambda i: exp(((n_groups - 2) / 2.0 + i) * ln(chi2 / 2)
    - chi2 / 2 - lgamma((n_groups - 2) / 2.0 + i + 1)))) END AS p_value FROM t)
  SELECT round(chi2, 3) AS chi2, n_groups, round(p_value, 6) AS p_value,
    CASE WHEN p_value < 0.05 THEN 'poor calibration' ELSE 'acceptable calibration' END AS verdict FROM p"""


_GRID = "[" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in threshold_grid()) + "]"


def _metrics(by: str) -> str:
    return f"""conf AS (SELECT {by}count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM judged_rows
  {'GROUP BY ' + by.rstrip(', ') if by else ''})"""


def _auc(source: str) -> str:
    return f"""(SELECT sum(CASE WHEN y = 1 THEN r END) FROM (SELECT y,
    rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0 AS r FROM {source}))"""


_LEMMA = f"""lemmas(form, lemma) AS (VALUES {", ".join(str(p) for p in q.LEMMAS)}),
toks AS (SELECT doc_id, {_tokens('lower(text)')} AS ts FROM docs),
tok AS (SELECT doc_id, unnest(range(len(ts))) AS i, unnest(ts) AS form FROM toks),
texts AS (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY i) AS lemma_text
  FROM tok LEFT JOIN lemmas USING (form) GROUP BY doc_id),
lem AS (SELECT d.doc_id, text, coalesce(lemma_text, '') AS lemma_text FROM docs d LEFT JOIN texts USING (doc_id))"""
LEMMAS = f"WITH {_DOCS},\n{_LEMMA}"
_PAIRS = f"""lemmas(form, lemma) AS (VALUES {", ".join(str(p) for p in q.LEMMAS)}),
bench AS (SELECT DISTINCT w FROM (SELECT unnest({_tokens('lower(text)')}) AS w FROM benchmark) WHERE length(w) > 3),
known AS (SELECT form, min(lemma) AS lemma FROM (SELECT * FROM lemmas UNION SELECT a.w, b.w FROM bench a JOIN bench b
  ON list_contains([{_quoted(q.ENDINGS)}], substr(a.w, length(b.w) + 1)) AND a.w[:length(b.w)] = b.w) GROUP BY form),
common AS (SELECT form, lemma, len(list_filter(range(1, least(length(form), length(lemma)) + 1),
  lambda i: form[:i] = lemma[:i])) AS same FROM known),
votes AS (SELECT right(form, k::INT) AS suffix, (length(form) - same)::INT AS strip, substr(lemma, same::INT + 1) AS append FROM (
  SELECT *, unnest(range(greatest(length(form) - same, 1), least(4, length(form) - 1) + 1)) AS k FROM common)),
rules AS (SELECT suffix, strip, append, n FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, strip, append) AS r
  FROM (SELECT suffix, strip, append, count(*) AS n FROM votes GROUP BY ALL HAVING count(*) >= 2)) WHERE r = 1)"""
_UNSEEN = f"""toks AS (SELECT doc_id, {_tokens('lower(text)')} AS ts FROM docs),
tok AS (SELECT doc_id, unnest(range(len(ts))) AS i, unnest(ts) AS form FROM toks),
tried AS (SELECT form, r.strip, r.append, row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC) AS best
  FROM (SELECT DISTINCT form FROM tok WHERE form NOT IN (SELECT form FROM known)) JOIN rules r ON r.suffix = right(form, length(r.suffix)::INT)),
made AS (SELECT form, form[:length(form) - strip] || append AS lemma FROM tried WHERE best = 1 AND length(form) - strip >= 2),
texts AS (SELECT doc_id, string_agg(coalesce(k.lemma, m.lemma, form), ' ' ORDER BY i) AS lemma_text
  FROM tok LEFT JOIN known k USING (form) LEFT JOIN made m USING (form) GROUP BY doc_id)
SELECT d.doc_id, coalesce(lemma_text, '') AS lemma_text FROM docs d LEFT JOIN texts USING (doc_id)"""
LARGE = f"""{LEMMAS}, large AS (SELECT lower(p_name) AS entry FROM part UNION SELECT lower(p_type) FROM part
  UNION SELECT entry FROM (SELECT unnest({_tokens('lower(text)')}) AS entry FROM benchmark) WHERE length(entry) > 4)"""
_ADJUSTED = sorted((set(q.ENTRIES) - set(q.FALSE_POSITIVES)) | set(q.FALSE_NEGATIVES))


def _lexicon_hits(entries) -> str:
    return f"len(list_filter([{_quoted(entries)}], lambda e: contains(lemma_text, e)))"


def _lexicon_score(entries) -> str:
    n = _n_tokens("lemma_text")
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE round({_lexicon_hits(entries)} * 100.0 / {n}, 2) END"


_SAMPLE = f"""sizes AS (SELECT doc_id, date, classe, count(*) AS n FROM sents GROUP BY ALL),
goals AS (SELECT date, classe, floor({SAMPLE_TARGET} * sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM sizes)) AS goal
  FROM sizes GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY date, classe ORDER BY {_seeded(key='doc_id')}) AS cum FROM sizes),
taken AS (SELECT doc_id FROM running JOIN goals USING (date, classe) WHERE cum <= goal * 1.15)"""

_SCORE_ARRAY = """[round(vague_ratio, 6), round(numeric_ratio + modal_ratio, 6), round(filter_ratio / 2, 6)]"""
_ARGMAX = f"""SELECT "PRIMARY_KEY", ['langue_de_bois', 'non_langue_de_bois', 'autre'][
  list_position({_SCORE_ARRAY}, list_max({_SCORE_ARRAY}))] AS label FROM feats"""

_ALPHA = "format('{:.2f}', 0.25 + proba * 0.65)"
_SPAN = f"""'<mark data-p="' || format('{{:.3f}}', proba) || '" style="background: rgba(255,'
  || greatest(50, 220 - CAST(floor(proba * 200) AS BIGINT)) || ',' || greatest(0, 100 - CAST(floor(proba * 100) AS BIGINT))
  || ',' || {_ALPHA} || ')">'"""
_ESCAPED = "replace(replace(replace(sentence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

_STORED = "WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS \"PRIMARY_KEY\", embedding FROM embeddings)"
_TOTAL = "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4)"
_COUNTS = "n_digits, n_dates, n_money, n_percent, n_vague_words, n_modal_verbs, n_ent_org, n_ent_loc, n_ent_law, n_ent_total"
_RATIOS = (
    "numeric_ratio", "vague_ratio", "modal_ratio", "sentiment_positive",
    "sentiment_negative", "sentiment_intensity", "filter_ratio",
)


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_ABSTRACT = """abstract AS (SELECT p_name AS word, p_size / 10.0 AS conc_m, p_partkey FROM part
  WHERE p_size / 10.0 <= 2.0)"""

_PLACED = f"""sizes AS (SELECT doc_id, count(*) AS n, CASE WHEN min(y) = max(y) THEN min(y) ELSE 2 END AS kind FROM lab GROUP BY doc_id),
placed AS (SELECT doc_id, sum(n) OVER (PARTITION BY kind ORDER BY {_seeded(key='doc_id')}) - n / 2.0 AS mid,
  sum(n) OVER (PARTITION BY kind) AS total FROM sizes)"""


def _letters(letters: str) -> str:
    return "(" + " + ".join(f"length(sentence) - length(replace(sentence, '{c}', ''))" for c in letters) + ")"


_SHARES = ", ".join(f"{_letters(c)} / CAST(greatest(length(sentence), 1) AS DOUBLE)" for c in q.LETTERS)
_DESCRIBED = ", ".join(f"('{label}', '{w}')" for label, text in q.DESCRIPTIONS.items() for w in text.split())
_LABEL_ORDER = ", ".join(f"('{label}', {i})" for i, label in enumerate(q.DESCRIPTIONS))
_ALL_FEATURES = ", ".join(f"CAST({f} AS DOUBLE)" for f in LINGUISTIC_FEATURES)
_ABBREVIATIONS = rf"""bare AS (SELECT regexp_replace(t, '^["''«»()\[\],;:]+|["''«»()\[\],;:!?]+$', '', 'g') AS t
  FROM (SELECT unnest({_tokens('lower(text)')}) AS t FROM docs)),
counted AS (SELECT CASE WHEN ends_with(t, '.') THEN t[:length(t) - 1] ELSE t END AS word,
  count(*) FILTER (ends_with(t, '.')) AS with_period, count(*) FILTER (NOT ends_with(t, '.')) AS without FROM bare GROUP BY 1),
words AS (SELECT * FROM counted WHERE word <> ''),
chance AS (SELECT sum(with_period) / CAST(sum(with_period + without) AS DOUBLE) AS p FROM words),
ratios AS (SELECT words.*, length(regexp_replace(word, '[^.]', '', 'g')) AS inner_,
  -2 * ((with_period * ln(p) + without * ln(1 - p)) - (with_period * ln(0.99) + without * ln(1 - 0.99))) AS ratio FROM words, chance),
scores AS (SELECT word, with_period, without, ratio * exp(-(length(word) - inner_)) * (inner_ + 1)
    * power(CAST(length(word) - inner_ AS DOUBLE), -without) AS score FROM ratios
  WHERE regexp_matches(word, '^\pL+(\.\pL+)*$') AND with_period >= 2),
learnt AS (SELECT * FROM scores WHERE score >= 0.3)"""


def _corpus_vectors(least: int, rounds: int) -> str:
    """Neighbour counts, mutual information and orthogonal iteration for two columns."""
    start = lambda i: f"CAST(CAST('0x' || md5('42:{i}:' || w)[1:8] AS BIGINT) AS DOUBLE) / 2147483648.0 - 1"
    sql = rf"""{TEXT}, t AS (SELECT "PRIMARY_KEY", unnest(range(len(ws))) AS i, unnest(ws) AS w
  FROM (SELECT "PRIMARY_KEY", {_tokens('lower(sentence)')} AS ws FROM sents)),
known AS (SELECT w FROM t GROUP BY w HAVING count(*) >= {least}),
near AS (SELECT a.w, b.w AS c FROM t a JOIN t b ON a."PRIMARY_KEY" = b."PRIMARY_KEY" AND (b.i = a.i + 1 OR b.i = a.i + 2)
  WHERE a.w IN (FROM known) AND b.w IN (FROM known)),
cells AS (SELECT w, c, count(*) AS n FROM (SELECT w, c FROM near UNION ALL SELECT c, w FROM near) GROUP BY ALL),
sums AS (SELECT w, sum(n) AS n FROM cells GROUP BY w),
m AS (SELECT * FROM (SELECT x.w, x.c, ln(x.n * CAST((SELECT sum(n) FROM cells) AS DOUBLE) / (CAST(a.n AS DOUBLE) * b.n)) AS value
  FROM cells x JOIN sums a ON a.w = x.w JOIN sums b ON b.w = x.c) WHERE value > 0),
q0 AS (SELECT w, {start(0)} AS a, {start(1)} AS b FROM (SELECT DISTINCT w FROM m))"""
    for k in range(1, rounds + 1):
        sql += f""",
y{k} AS (SELECT m.w, sum(value * a) AS a, sum(value * b) AS b FROM m JOIN q{k - 1} p ON p.w = m.c GROUP BY m.w),
g{k} AS (SELECT sqrt(sum(a * a)) AS r, sum(a * b) / sqrt(sum(a * a)) AS s, sum(b * b) AS bb FROM y{k}),
q{k} AS (SELECT w, a / r AS a, (b - a / r * s) / sqrt(bb - s * s) AS b FROM y{k}, g{k})"""
    return f"""{sql}, e AS (SELECT "PRIMARY_KEY", avg(a) AS a, avg(b) AS b FROM t JOIN q{rounds} USING (w) GROUP BY 1)
SELECT "PRIMARY_KEY", round(CAST(CAST(coalesce(a, 0) AS FLOAT) AS DOUBLE), 5) AS v0,
  round(CAST(CAST(coalesce(b, 0) AS FLOAT) AS DOUBLE), 5) AS v1 FROM sents LEFT JOIN e USING ("PRIMARY_KEY")"""


ORACLE: dict[str, str] = {
    "read_text_corpus": f"""WITH {_DOCS} SELECT doc_id, date, classe, doc_id || '.txt' AS file_name, text FROM docs
      WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
    "corpus_rejects": """SELECT 'file:/corpus/' || lang || '/' || source || '/' || doc_id || '.txt' AS path,
      'invalid UTF-8' AS reason FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "assemble_documents": """SELECT * FROM (SELECT conv_id AS doc, string_agg(text || CASE WHEN turn % 2 = 1 THEN ' (first)' ELSE '' END, '' ORDER BY turn) AS text
      FROM conversations GROUP BY conv_id) WHERE text <> ''""",
    "element_counts": """SELECT 'document' AS type, count(DISTINCT conv_id) AS n FROM conversations
      UNION ALL SELECT 'page', count(*) FROM conversations
      UNION ALL SELECT 'transcription', count(*) FROM conversations WHERE text <> ''""",
    "stage_roundtrip": f'{TEXT} SELECT doc_id, "PRIMARY_KEY", date, classe, sent_idx, sentence, filter_ratio FROM sents',
    "read_labels": f'{SHEET} SELECT "PRIMARY_KEY", label, CAST(ord AS VARCHAR) AS ord FROM sheet',
    "load_lexicon": f"""SELECT DISTINCT entry FROM (SELECT lower(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS entry
      FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line NOT LIKE '#%') WHERE entry <> ''""",
    "merge_lexicons": """SELECT lower(p_name) AS entry FROM part UNION SELECT lower(p_type) FROM part
      UNION SELECT lower(p_brand) FROM part""",
    "admin_lines": f"WITH {_DOCS}, {_LINES} SELECT doc_id, line_no, is_admin FROM judged",
    "filter_ratio": f"WITH {_DOCS}, {_LINES} SELECT doc_id, filter_ratio FROM ratios",
    "clean_text": f"""WITH {_DOCS} SELECT doc_id, {_clean('text')} AS text FROM docs
      UNION ALL SELECT 'p' || page_id, {_clean('html')} FROM pages""",
    "split_sentences": f'{TEXT} SELECT "PRIMARY_KEY", sentence FROM sents',
    "sentences_table": f"{TEXT} SELECT * FROM sents",
    "cap_sentences": f"""{TEXT}, sizes AS (SELECT doc_id, date, classe, count(*) AS n FROM sents GROUP BY ALL),
      running AS (SELECT *, sum(n) OVER (ORDER BY date, classe, doc_id) AS cum FROM sizes)
      SELECT "PRIMARY_KEY", doc_id, date, classe FROM sents
      WHERE doc_id IN (SELECT doc_id FROM running WHERE cum <= {CAP})""",
    "stratum_noise": f"""WITH {_DOCS}, {_LINES} SELECT date, classe, count(*) AS n_files,
      CAST(sum(CAST(round(filter_ratio * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) / count(*) AS mean_ratio,
      min(filter_ratio) AS min_ratio, max(filter_ratio) AS max_ratio FROM docs JOIN ratios USING (doc_id) GROUP BY date, classe""",
    "noise_rollup": f"""WITH {_DOCS}, {_LINES}, f AS (SELECT date, classe, CASE WHEN doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR)
        FROM labels WHERE toxic = 1) THEN filter_ratio END AS r FROM docs JOIN ratios USING (doc_id))
      SELECT date, classe, CAST(GROUPING(date, classe) AS BIGINT) AS level, count(*) AS n_files, count(*) FILTER (r IS NULL) AS n_unreadable,
        CAST(sum(CAST(round(r * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) / count(r) AS mean_ratio, min(r) AS min_ratio, max(r) AS max_ratio
      FROM f GROUP BY ROLLUP (date, classe)""",
    "chain_labelled": f"""{FEATURES}, {_DOC_LABELS} SELECT "PRIMARY_KEY", date, classe, label, n_vague_words, CAST(16 AS BIGINT) AS n_dims, 1.0::DOUBLE AS total
      FROM feats LEFT JOIN doc_labels USING (doc_id) WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
    "merge_bucketed": f"""{FEATURES} SELECT "PRIMARY_KEY", date, classe, CAST(2 AS BIGINT) AS n_dims, round(vague_ratio, 6) AS vague_ratio
      FROM feats WHERE date = 'fr'""",
    "grouped_split": f"""{LABELLED}, {_PLACED} SELECT "PRIMARY_KEY", y, CASE WHEN mid < total * 0.15 THEN 'test' WHEN mid < total * 0.3 THEN 'val'
      ELSE 'train' END AS split FROM lab JOIN placed USING (doc_id)""",
    "grouped_folds": f"""{LABELLED}, {_PLACED} SELECT "PRIMARY_KEY", y, CAST(least(floor(mid * 3 / total), 2) AS BIGINT) AS fold
      FROM lab JOIN placed USING (doc_id)""",
    "stream_event_totals": """WITH span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
      over_ AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total
        FROM events GROUP BY ALL)
      SELECT start, kind, n, total FROM over_, span WHERE start + INTERVAL 1 DAY <= hi - INTERVAL 1 DAY
      UNION ALL SELECT NULL, 'late', count(*), NULL FROM events, span WHERE ts < lo + (hi - lo) / 5""",
    "corpus_noise": f"""{TEXT}, per AS (SELECT doc_id, count(*) AS n, max(filter_ratio) AS r FROM sents GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS n_sentences, count(*) AS n_documents, CAST(sum(CAST(round(r * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE) / count(*) AS mean_ratio,
      count(*) FILTER (r > 0.5) AS n_noisy FROM per""",
    "concreteness": f'{FEATURES} SELECT "PRIMARY_KEY", n_digits, n_dates, n_money, n_percent, {_r("numeric_ratio")} FROM feats',
    "vague_words": f'{FEATURES} SELECT "PRIMARY_KEY", n_vague_words, {_r("vague_ratio")} FROM feats',
    "modal_verbs": f'{FEATURES} SELECT "PRIMARY_KEY", n_modal_verbs, {_r("modal_ratio")} FROM feats',
    "entity_counts": f"{TEXT}, {_ENTITIES} SELECT * FROM ent_counts",
    "entity_counts_large": f"{TEXT}, {_entities(_BENCHMARK_GAZ)} SELECT * FROM ent_counts",
    "sentiment_scores": f"""{FEATURES}, {_SENTIMENT} SELECT "PRIMARY_KEY",
      {_r("sentiment_positive", "sentiment_negative", "sentiment_intensity")} FROM senti""",
    "feature_table": f"""{_FULL} SELECT "PRIMARY_KEY", doc_id, date, classe, sentence, {_COUNTS}, {_r(*_RATIOS)}
      FROM full_feats""",
    "encode_sentences": f'{TEXT} SELECT "PRIMARY_KEY", CAST(768 AS BIGINT) AS n_dims, 1.0::DOUBLE AS total FROM sents',
    "encode_corpus_vectors": _corpus_vectors(20, 2),
    "model_embedding": f"""{TEXT} SELECT "PRIMARY_KEY", unnest(range({len(q.LETTERS)})) AS dim, round(CAST(CAST(unnest([{_SHARES}]) AS FLOAT) AS DOUBLE), 5) AS value FROM sents""",
    "model_label_scores": f"""{TEXT}, m AS (SELECT "PRIMARY_KEY", ([{_SHARES}])[:3] AS s FROM sents)
      SELECT "PRIMARY_KEY", (['langue_de_bois', 'non_langue_de_bois', 'autre'])[list_position(s, list_max(s))] AS label, round(list_max(s), 6) AS score FROM m""",
    "model_sentiment": f"""{TEXT}, m AS (SELECT "PRIMARY_KEY", [{_SHARES}] AS s FROM sents)
      SELECT "PRIMARY_KEY", round(s[1], 6) AS sentiment_positive, round(s[2], 6) AS sentiment_negative, round(abs(s[1] - s[2]), 6) AS sentiment_intensity FROM m""",
    "model_struct": f"""{TEXT} SELECT "PRIMARY_KEY", CAST({_letters('aeio')} AS DOUBLE) AS vowels, CAST({_letters('aeionrst')} AS DOUBLE) AS letters FROM sents""",
    "zero_shot_label": f"""{TEXT}, t AS (SELECT "PRIMARY_KEY", unnest({_tokens('lower(sentence)')}) AS w FROM sents),
      df AS (SELECT w, ln((1 + (SELECT count(*) FROM sents)) / CAST(1 + count(DISTINCT "PRIMARY_KEY") AS DOUBLE)) + 1 AS idf FROM t GROUP BY w),
      d AS (SELECT label, w, count(*) * any_value(idf) AS x FROM (SELECT * FROM (VALUES {_DESCRIBED}) AS a(label, w)) JOIN df USING (w) GROUP BY label, w),
      u AS (SELECT label, w, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM d),
      tf AS (SELECT "PRIMARY_KEY", w, count(*) * any_value(idf) AS x FROM t JOIN df USING (w) GROUP BY "PRIMARY_KEY", w),
      norms AS (SELECT "PRIMARY_KEY", sqrt(sum(x * x)) AS norm FROM tf GROUP BY 1),
      dots AS (SELECT "PRIMARY_KEY", label, sum(tf.x * u.x) AS dot FROM tf JOIN u USING (w) GROUP BY ALL),
      ls AS (SELECT * FROM (VALUES {_LABEL_ORDER}) AS a(label, o)),
      s AS (SELECT s."PRIMARY_KEY", label, o, coalesce(round(dot / norm, 6), 0.0) AS score FROM sents s CROSS JOIN ls
        LEFT JOIN dots USING ("PRIMARY_KEY", label) LEFT JOIN norms USING ("PRIMARY_KEY"))
      SELECT "PRIMARY_KEY", label, score FROM (SELECT *, row_number() OVER (PARTITION BY "PRIMARY_KEY" ORDER BY score DESC, o) AS r FROM s) WHERE r = 1""",
    "learn_abbreviations": f"WITH {_DOCS}, {_ABBREVIATIONS} SELECT word, with_period, without, round(score, 6) AS score FROM learnt",
    "sentences_learnt": f"""WITH {_DOCS}, {_ABBREVIATIONS},
      best AS (SELECT word FROM learnt ORDER BY score DESC, word LIMIT 1000),
      forms AS (SELECT DISTINCT replace(unnest([word, upper(word[1]) || word[2:]]), '.', '\\.') AS f FROM best),
      known AS (SELECT coalesce(string_agg(f, '|' ORDER BY length(f) DESC), 'M') AS short FROM forms),
      cleaned AS (SELECT doc_id, {_clean('text')} AS text, short FROM docs, known),
      pieces AS (SELECT doc_id, {_split('text', 'short')} AS ss FROM cleaned)
      SELECT doc_id || '_' || unnest(range(len(ss))) AS "PRIMARY_KEY", unnest(ss) AS sentence FROM pieces""",
    "mean_pooling": f"""{_STORED}, cells AS (SELECT "PRIMARY_KEY", unnest(range(64)) AS c, unnest(embedding) AS x,
        embedding AS e FROM v),
      parts AS (SELECT "PRIMARY_KEY", c % 8 AS dim, CAST(x AS DOUBLE) AS x, CAST(e[(c // 8) * 8 + 1] > 0 AS INTEGER) AS m FROM cells)
      SELECT "PRIMARY_KEY", dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS value FROM parts GROUP BY ALL""",
    "embedding_table": f"""{_STORED}, {_DOCS}, e AS (SELECT "PRIMARY_KEY", unnest(range(64)) AS dim,
        round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM v)
      SELECT doc_id AS "PRIMARY_KEY", doc_id, date, classe, dim, value FROM docs LEFT JOIN e ON doc_id = "PRIMARY_KEY" """,
    "assemble_vector": f"""{_FULL}, v AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      a AS (SELECT "PRIMARY_KEY", e IS NOT NULL AS has_vector, [{_ALL_FEATURES}] || coalesce(e, list_transform(range(64), lambda x: 0.0)) AS f
        FROM full_feats LEFT JOIN v USING (doc_id))
      SELECT "PRIMARY_KEY", has_vector, len(f) AS n_dims, round(list_sum(f) + {q.OFF_TIES}, 4) AS total,
        round(list_sum(list_transform(f, lambda x, i: x * i)) + {q.OFF_TIES}, 3) AS by_place FROM a""",
    "merge_features": f"""{_STORED}, {_DOCS} SELECT doc_id AS "PRIMARY_KEY", doc_id, date, classe,
      len(embedding) AS n_dims, {_TOTAL} AS total FROM docs LEFT JOIN v ON doc_id = "PRIMARY_KEY" """,
    "key_gaps": """SELECT (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS only_left,
      (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS only_right""",
    "clean_labels": f"{SHEET} SELECT * FROM clean",
    "invalid_labels": "SELECT DISTINCT 'toxic ' || quality AS label FROM labels WHERE toxic = 1",
    "apply_labels": f"""{SHEET} SELECT doc_id AS "PRIMARY_KEY", doc_id, date, classe, label
      FROM docs LEFT JOIN clean ON doc_id = "PRIMARY_KEY" """,
    "labelled_counts": f"""{SHEET} SELECT count(label) AS n_labelled, count(*) - count(label) AS n_unlabelled
      FROM docs LEFT JOIN clean ON doc_id = "PRIMARY_KEY" """,
    "two_class_view": f"""{SHEET} SELECT doc_id AS "PRIMARY_KEY", doc_id, date, classe, label
      FROM docs LEFT JOIN clean ON doc_id = "PRIMARY_KEY" WHERE label IS NULL OR label <> 'autre'""",
    "label_counts": f"{SHEET} SELECT label, count(*) AS n FROM clean GROUP BY label",
    "sample_documents": f"""{TEXT}, {_SAMPLE} SELECT "PRIMARY_KEY", doc_id, date, classe FROM sents
      WHERE doc_id IN (SELECT doc_id FROM taken)""",
    "annotation_sheet": f"""{TEXT}, {_SAMPLE} SELECT "PRIMARY_KEY", doc_id, date, classe, sentence, '' AS label FROM sents
      WHERE doc_id IN (SELECT doc_id FROM taken)""",
    "argmax_label": f"{FEATURES} {_ARGMAX}",
    "pending_annotations": f"{HALF} SELECT * FROM half WHERE trim(label) = ''",
    "update_labels": f"""{HALF} SELECT "PRIMARY_KEY", CASE WHEN "PRIMARY_KEY" IN
      (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) THEN 'autre' ELSE label END AS label FROM half""",
    "annotation_stats": f"""{HALF}, n AS (SELECT label, count(*) AS n FROM half WHERE trim(label) <> '' GROUP BY 1)
      SELECT label, n, round(n / (SELECT sum(n) FROM n) * 100.0, 1) AS pct FROM n
      UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), 100.0 FROM n
      UNION ALL SELECT 'UNANNOTATED', count(*), NULL FROM half WHERE trim(label) = ''""",
    "stream_annotate": f"{FEATURES} {_ARGMAX}",
    "labeled_target": f'{LABELLED} SELECT "PRIMARY_KEY", label, y FROM lab',
    "stratified_split": f'{LABELLED}, {_RANKED} SELECT "PRIMARY_KEY", y, split FROM split',
    "stratified_folds": f'{LABELLED}, {_RANKED} SELECT "PRIMARY_KEY", y, rk % 3 AS fold FROM ranked',
    "quantile_bins": f"{LABELLED}, long AS ({_UNPIVOT}), {_binned('long')} {_bin_range('binned')}",
    "event_value_bins": f"WITH vals AS (SELECT 'value' AS feature, value FROM events), {_binned('vals')} {_bin_range('binned')}",
    "information_value": f"{_IV} SELECT feature, round(iv, 6) AS iv FROM ivs",
    "select_by_iv": f"""{_IV} SELECT feature, round(iv, 6) AS iv FROM ivs
      WHERE iv >= 0.02 OR (SELECT max(iv) FROM ivs) < 0.02""",
    "standardize": f"""{LABELLED} SELECT "PRIMARY_KEY", {", ".join(
        f"round(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () > 1e-12 THEN stddev_pop({f}) OVER () ELSE 1 END, 6) AS {f}_z"
        for f in q.STAT_FEATURES)} FROM lab""",
    "class_weights": f"""{LABELLED}, c AS (SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos FROM lab)
      SELECT n_neg, n_pos, round((n_neg + n_pos) / (2.0 * n_neg), 6) AS weight_neg,
      round((n_neg + n_pos) / (2.0 * n_pos), 6) AS weight_pos, round(n_neg / greatest(n_pos, 1), 6) AS positive_scale FROM c""",
    "calibrate_threshold": f"""{LABELLED}, grid AS (SELECT unnest({_GRID}) AS t),
      per AS (SELECT proba, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM ys GROUP BY proba),
      risks AS (SELECT t, CAST(coalesce(sum(neg) FILTER (proba >= t), 0) AS DOUBLE) AS fp,
        CAST(coalesce(sum(pos) FILTER (proba < t), 0) AS DOUBLE) AS fn,
        CAST(coalesce(sum(pos) FILTER (proba >= t), 0) AS DOUBLE) AS tp FROM grid, per GROUP BY t)
      SELECT round(t, 6) AS threshold, round(4 * fp + fn, 6) AS risk,
        CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1
      FROM risks ORDER BY 4 * fp + fn, t LIMIT 1""",
    "classification_report": f"""{LABELLED}, judged_rows AS (SELECT * FROM ys), {_metrics('')},
      cls AS (SELECT '0' AS entry, tn AS hit, fn AS wrong, fp AS lost FROM conf UNION ALL SELECT '1', tp, fp, fn FROM conf),
      prf AS (SELECT entry, coalesce(hit / nullif(hit + wrong, 0), 0) AS precision, coalesce(hit / nullif(hit + lost, 0), 0) AS recall,
        coalesce(2 * hit / nullif(2 * hit + wrong + lost, 0), 0) AS f1, hit + lost AS support FROM cls)
      SELECT entry, {_r('precision', 'recall', 'f1')}, support FROM prf
      UNION ALL SELECT 'accuracy', round((tp + tn) / (tp + tn + fp + fn), 6), round((tp + tn) / (tp + tn + fp + fn), 6),
        round((tp + tn) / (tp + tn + fp + fn), 6), tp + tn + fp + fn FROM conf
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM prf
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf""",
    "roc_auc": f"""{LABELLED}, c AS (SELECT CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n FROM ys)
      SELECT round(({_auc('ys')} - p * (p + 1) / 2) / (p * n), 6) AS auc_roc FROM c""",
    "predict_all": f"""{_FULL}, v AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
      p AS (SELECT "PRIMARY_KEY", 1 / (1 + exp(-({_Z}))) AS lr, CASE WHEN embedding IS NOT NULL THEN 1 / (1 + exp(-({_TREES}))) END AS xgb
        FROM full_feats LEFT JOIN v USING (doc_id))
      SELECT "PRIMARY_KEY", round(lr, 6) AS proba_lr, round(xgb, 6) AS proba_xgb, CASE WHEN lr >= {q.THRESHOLD} THEN {_POS} ELSE {_NEG} END AS pred_lr,
        CASE WHEN xgb >= 0.55 THEN {_POS} WHEN xgb IS NOT NULL THEN {_NEG} END AS pred_xgb FROM p""",
    "prediction_distribution": f"""{SCORED} SELECT pred AS label, count(*) AS n,
      round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM scored), 6) AS share FROM scored GROUP BY pred""",
    "metrics_table": f"""{LABELLED}, {_RANKED},
      judged_rows AS (SELECT split, y, proba, CAST(proba >= {q.THRESHOLD} AS INTEGER) AS pred FROM split), {_metrics('split, ')},
      ranks AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY proba)
        + (count(*) OVER (PARTITION BY split, proba) - 1) / 2.0 AS r FROM judged_rows),
      aucs AS (SELECT split, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
        / (count(*) FILTER (y = 1) * CAST(count(*) FILTER (y = 0) AS DOUBLE)) AS auc FROM ranks GROUP BY split)
      SELECT split, round(auc, 4) AS auc_roc, round(CAST({q.THRESHOLD} AS DOUBLE), 3) AS threshold,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
        round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy
      FROM conf JOIN aucs USING (split)""",
    "pearson_residuals": f'{RESIDUALS} SELECT "PRIMARY_KEY", {_r("pearson")} FROM res',
    "deviance_residuals": f'{RESIDUALS} SELECT "PRIMARY_KEY", {_r("deviance")} FROM res',
    "residual_summary": f"""{RESIDUALS} SELECT round(avg(pearson), 6) AS pearson_mean, round(stddev_pop(pearson), 6) AS pearson_std,
      round(avg(deviance), 6) AS deviance_mean, round(stddev_pop(deviance), 6) AS deviance_std FROM res""",
    "hosmer_lemeshow": _hosmer(10),
    "hosmer_lemeshow_odd": _hosmer(9),
    "hosmer_lemeshow_table": f"""{HL} SELECT decile, obs_pos, obs_neg, total, round(mean_p, 6) AS mean_p,
      {_r('exp_pos', 'exp_neg', digits=4)} FROM hl""",
    "calibration_curve": f"""{LABELLED}, {_equal_width('ys', 'proba', 10)} SELECT bin, round(avg(proba), 6) AS mean_pred,
      round(avg(y), 6) AS frac_pos, count(*) AS n FROM cut GROUP BY bin""",
    "residual_histogram": f"""{RESIDUALS}, {_equal_width('res', 'pearson', 50)} SELECT bin,
      round(min(lo + width * bin), 6) AS left_edge, count(*) AS n FROM cut GROUP BY bin""",
    "proba_by_class": f"""{LABELLED}, {_equal_width('ys', 'proba', 40)} SELECT y, bin,
      round(min(lo + width * bin), 6) AS left_edge, count(*) AS n FROM cut GROUP BY y, bin""",
    "filter_corpus": f"""{SCORED} SELECT "PRIMARY_KEY", date, classe, proba, pred FROM scored
      WHERE date = 'fr' AND classe = 'src3'""",
    "doc_list": f"WITH {_DOCS} SELECT DISTINCT doc_id FROM docs",
    "display_labels": f"""{SCORED} SELECT "PRIMARY_KEY", CASE WHEN proba < 0.7 THEN {_NEG} ELSE pred END AS pred FROM scored""",
    "doc_scores": f"""{SCORED} SELECT doc_id, count(*) FILTER (proba >= 0.7 AND pred = {_POS}) AS n_positive, count(*) AS n_sentences,
      round(count(*) FILTER (proba >= 0.7 AND pred = {_POS}) / CAST(count(*) AS DOUBLE), 6) AS share FROM scored GROUP BY doc_id""",
    "doc_sentences": f'{SCORED} SELECT doc_id, sent_idx, "PRIMARY_KEY", sentence, proba, pred FROM scored',
    "top_sentences": f"""{SCORED} SELECT doc_id, rank, "PRIMARY_KEY", sentence, proba, pred FROM (SELECT *,
      row_number() OVER (PARTITION BY doc_id ORDER BY proba DESC, sent_idx) AS rank FROM scored) WHERE rank <= 3""",
    "corpus_totals": f"""{SCORED} SELECT count(*) AS n_sentences, count(*) FILTER (pred = {_POS}) AS n_positive,
      round(count(*) FILTER (pred = {_POS}) / CAST(count(*) AS DOUBLE), 6) AS share, count(DISTINCT doc_id) AS n_documents FROM scored""",
    "render_documents": f"""{SCORED} SELECT doc_id, '<article>' || string_agg(
      CASE WHEN proba >= 0.7 AND pred = {_POS} THEN {_SPAN} || {_ESCAPED} || '</mark>' ELSE {_ESCAPED} END, ' ' ORDER BY sent_idx)
      || '</article>' AS markup FROM scored GROUP BY doc_id""",
    "doc_header": f"""{TEXT} SELECT doc_id, arg_min(date, sent_idx) AS date, arg_min(classe, sent_idx) AS classe,
      count(*) AS n_sentences FROM sents GROUP BY doc_id""",
    "abstract_words": f"WITH {_ABSTRACT} SELECT * FROM abstract",
    "translate_terms": """SELECT p_partkey, p_name AS term, target FROM part LEFT JOIN (SELECT p_name AS source,
      min(lower(p_brand)) AS target FROM part WHERE p_type = 'ECONOMY' AND p_size <= 4 GROUP BY 1) ON p_name = source""",
    "lemmatize": f"{LEMMAS} SELECT doc_id, lemma_text FROM lem",
    "lemma_rules": f"WITH {_PAIRS} SELECT * FROM rules",
    "lemmatize_unseen": f"WITH {_DOCS},\n{_PAIRS},\n{_UNSEEN}",
    "lexicon_score": f"{LEMMAS} SELECT doc_id, {_lexicon_hits(q.ENTRIES)} AS n_hits, {_lexicon_score(q.ENTRIES)} AS score FROM lem",
    "kwic": f"""{LEMMAS}, e AS (SELECT unnest([{_quoted(q.ENTRIES)}]) AS entry),
      h AS (SELECT doc_id, entry, contains(lower(text), entry) AS orig,
        CASE WHEN contains(lower(text), entry) THEN lower(text) ELSE lemma_text END AS body FROM lem JOIN e ON contains(lemma_text, entry)),
      located AS (SELECT *, strpos(body, entry) AS pos FROM h)
      SELECT doc_id, entry, CASE WHEN orig THEN 'original' ELSE 'lemma' END AS source,
        substring(body, greatest(pos - 60, 1), pos + length(entry) + 60 - greatest(pos - 60, 1)) AS context FROM located""",
    "lexicon_score_large": f"""{LARGE}, n AS (SELECT doc_id, lemma_text, count(entry) AS n_hits
      FROM lem LEFT JOIN large ON contains(lemma_text, entry) GROUP BY doc_id, lemma_text)
      SELECT doc_id, n_hits, coalesce(round(n_hits * 100.0 / nullif({_n_tokens('lemma_text')}, 0), 2), 0.0) AS score FROM n""",
    "kwic_large": f"""{LARGE}, h AS (SELECT doc_id, entry, contains(lower(text), entry) AS orig,
        CASE WHEN contains(lower(text), entry) THEN lower(text) ELSE lemma_text END AS body FROM lem JOIN large ON contains(lemma_text, entry)),
      located AS (SELECT *, strpos(body, entry) AS pos FROM h)
      SELECT doc_id, entry, CASE WHEN orig THEN 'original' ELSE 'lemma' END AS source,
        substring(body, greatest(pos - 60, 1), pos + length(entry) + 60 - greatest(pos - 60, 1)) AS context FROM located""",
    "adjust_lexicon": """SELECT entry FROM (SELECT lower(p_name) AS entry FROM part UNION SELECT lower(p_type) FROM part)
      WHERE entry NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 50) UNION SELECT lower(p_brand) FROM part""",
    "lexicon_delta": f"""{LEMMAS}, s AS (SELECT doc_id, {_lexicon_score(q.ENTRIES)} AS score_before,
      {_lexicon_score(_ADJUSTED)} AS score_after FROM lem) SELECT *, round(score_after - score_before, 2) AS delta FROM s""",
    "lexicon_validation": f"""{LEMMAS}, s AS (SELECT doc_id, {_lexicon_score(q.ENTRIES)} AS score FROM lem),
      x AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS expected FROM labels)
      SELECT expected, count(*) AS n_documents, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score,
      round(max(score), 6) AS max_score FROM s JOIN x USING (doc_id) GROUP BY expected""",
    "stratum_rhetoric": f"""{FEATURES} SELECT date, classe, count(*) AS n_sentences, round(avg(vague_ratio), 6) AS mean_vague_ratio,
      round(avg(numeric_ratio), 6) AS mean_numeric_ratio, count(*) FILTER (n_digits > 0) AS n_concrete
      FROM feats GROUP BY date, classe""",
}

# The joined forms of these operators give the results of the inlined ones.
for _name in ("vague_words", "entity_counts", "lexicon_score", "kwic"):
    ORACLE[f"{_name}_table"] = ORACLE[_name]
