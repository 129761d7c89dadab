"""Fragments of DuckDB SQL for the checks. Fixed values are stated here anew, not taken from the operators that are checked."""
from __future__ import annotations

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')"


def lines(t: str) -> str:
    parts = f"regexp_split_to_array({t}, '{BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def solid(t: str) -> str:
    return f"list_filter(list_transform({lines(t)}, lambda y: {strip('y')}), lambda y: y <> '')"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END)"


#: The stop words of the quality rules.
_STOP_WORDS = """the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or
an will my one all would there their what so up out if about who get which go me when make can like time no just
him know take people into year your good some could them see other than then now look only come its over think also
back after use two how our work first well way even new want because any these give day most us"""
STOP = "[" + ", ".join(f"'{w}'" for w in _STOP_WORDS.split()) + "]"
#: Listed words of addresses, limits of repeated n-grams, markers of the two Chinese scripts.
URL_WORDS = "porn|xxx|adult|sex|nude|naked|casino|slots|gambling|poker|spam|phishing|malware|payday-loan|paydayloan|viagra|cialis|pharmacy"
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TRADITIONAL = "們來時這個說國後會對應也從於他她學現發問題與為話體樣進過點還實際間愛藝術電語書報紙習工作生活歷史關係政治經濟文化社展變"
SIMPLIFIED = "们来时这个说国后会对应也从于他她学现发问题与为话实际间点体样进过还爱艺术电语书报纸习工作生活历史关系政治经济文化社展变"
TERMINAL = "['.', '?', '!', '\"', '''', '»', '…']"


def stop_count(t: str) -> str:
    return f"""len(list_filter({words(f'lower({t})')}, lambda w: list_contains({STOP}, regexp_replace(w, '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g'))))"""


def sentence_length(t: str) -> str:
    pieces = f"list_filter(regexp_split_to_array({t}, '[.!?]+'), lambda s: {strip('s')} <> '')"
    return f"coalesce(list_avg(list_transform({pieces}, lambda s: len({words('s')}))), 0.0)"


def alpha(t: str) -> str:
    return ratio(count(t, r"\p{L}"), f"length({t})")


def dup_share(a: str) -> str:
    return ratio(f"(len({a}) - len(list_distinct({a})))", f"len({a})")


def metrics(source: str, base: str = "base", out: str = "m") -> str:
    """CTEs ``base`` and ``out``: the rows of ``source``, which has a text ``t`` without nulls, with their measures."""
    letters = "[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + WS[1:-1] + "]"
    return rf"""
{base} AS ({source}),
{out} AS (SELECT *, len({words('t')})::BIGINT AS n_words, {lines('t')} AS ls, {solid('t')} AS sl, {words('t')} AS ws, {alpha('t')} AS alpha_ratio, {stop_count('t')}::BIGINT AS stop_words, {sentence_length('t')} AS avg_sentence,
 {ratio(count('t', letters), 'length(t)')} AS special_ratio, {ratio(count('t', '[0-9]'), 'length(t)')} AS digit_ratio, length(regexp_replace(t, '{WS}', '', 'g')) AS visible FROM {base})
"""


#: Documents with their measures; the rule queries build on it.
METRICS = metrics("SELECT doc_id, source, lang, url, segment, title, prompt, coalesce(text, '') AS t FROM documents")

GOPHER = rf"""CASE WHEN n_words < 50 THEN 'too_short' WHEN n_words > 100000 THEN 'too_long' WHEN avg_sentence < 3 THEN 'avg_sentence_too_short' WHEN avg_sentence > 1000 THEN 'avg_sentence_too_long'
 WHEN alpha_ratio < 0.5 THEN 'low_alpha_ratio' WHEN stop_words < 2 THEN 'too_few_stop_words'
 WHEN {ratio(f"len(list_filter(ls, lambda y: ends_with(regexp_replace(y, '{WS}+$', ''), '...')))", "len(ls)")} > 0.3 THEN 'too_many_ellipsis_lines'
 WHEN {ratio("len(list_filter(ws, lambda y: NOT regexp_matches(y, '^" + chr(92) + "p{L}')))", "len(ws)")} > 0.2 THEN 'too_many_non_alpha_words' END"""
_CONTENT = f"list_filter(sl, lambda y: len({words('y')}) > 10)"
C4 = rf"""CASE WHEN len(sl) < 3 THEN 'too_few_lines' WHEN contains(lower(t), 'javascript') THEN 'contains_javascript' WHEN contains(lower(t), 'lorem ipsum') THEN 'contains_lorem_ipsum'
 WHEN len({_CONTENT}) = 0 THEN 'no_content_lines'
 WHEN {ratio(f"len(list_filter({_CONTENT}, lambda z: list_contains({TERMINAL}, right(z, 1))))", f"len({_CONTENT})")} < 0.3 THEN 'low_terminal_punct_ratio'
 WHEN {ratio(f"len(list_filter(sl, lambda y: len({words('y')}) < 3))", "len(sl)")} > 0.5 THEN 'too_many_short_lines' END"""
_NB = f"list_filter(ls, lambda y: {strip('y')} <> '')"
LISTLIKE = rf"""CASE WHEN len({_NB}) = 0 THEN 'empty_text'
 WHEN {ratio(f"len(list_filter({_NB}, lambda y: regexp_matches(y, '^" + chr(92) + "s*[•" + chr(92) + "-*+►▸▶◆◇○●]" + chr(92) + "s')))", f"len({_NB})")} > 0.9 THEN 'too_many_bullet_lines'
 WHEN {ratio(f"len(list_filter({_NB}, lambda y: ends_with(regexp_replace(y, '{WS}+$', ''), '...')))", f"len({_NB})")} > 0.3 THEN 'too_many_ellipsis_endings'
 WHEN n_words > 0 AND {ratio("len(list_filter(ws, lambda y: regexp_matches(y, '" + chr(92) + "p{L}')))", "len(ws)")} < 0.6 THEN 'low_alpha_word_ratio' END"""
RULES = f"""{METRICS.rstrip()},
r AS (SELECT *, {GOPHER} AS gopher, {C4} AS c4, {LISTLIKE} AS listlike FROM m),
q AS (SELECT *, coalesce('gopher:' || gopher, 'c4:' || c4, 'third:' || listlike) AS quality FROM r)"""
#: The stored models: constant, then letters, stop words, log of words, sentence, marks, word length, digits.
MODELS = {
    "edu": [0.9289, 3.0934, 2.9505, 0.0083, -4.2817, -12.9015, 0.0923, -24.4367],
    "reference": [-11.117, 9.3894, 7.2862, 0.0425, -1.0488, -26.2495, -0.0753, -15.9947],
    "wiki": [26.2963, -19.4711, 6.2266, -2.8026, 0.6733, -34.5875, -0.7112, -51.7739],
    "evaluation": [-27.5235, 16.6115, 8.9114, 1.8437, -2.642, -29.2368, -0.0056, 5.6705],
}


def model(name: str) -> str:
    """The score of a stored model over the columns of ``metrics``."""
    xs = ["alpha_ratio", ratio("stop_words", "n_words"), "ln(n_words + 1)", "least(avg_sentence, 100.0) / 100", "special_ratio", f"({ratio('visible', 'n_words')}) / 10", "digit_ratio"]
    z = " + ".join([f"({MODELS[name][0]})::DOUBLE", *(f"({x}) * ({w})::DOUBLE" for x, w in zip(xs, MODELS[name][1:]))])
    return f"round(1 / (1 + exp(-({z}))), 4)"


SCORE = model("edu")
SCORED = f"{METRICS.rstrip()}, s AS (SELECT doc_id, source, lang, segment, t, n_words, {SCORE} AS score, {model('evaluation')} AS eval_score FROM m)"
DOMAIN = r"regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?', 1)), '^www\.', '')"


def domain(u: str) -> str:
    return DOMAIN.replace("{u}", strip(f"coalesce({u}, '')"))
