"""Queries of the text measures and rule filters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators import chinese, ngrams, pii, quality
from gristmill.plans import sqlparts as S
from gristmill.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", *columns), "doc_id")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(rf"""WITH {S.METRICS} SELECT doc_id, n_words, len(ls)::BIGINT AS n_lines, round(alpha_ratio, 6) AS alpha_ratio, stop_words, round(avg_sentence, 6) AS avg_sentence,
 round({S.ratio(S.count('t', '[A-Za-z]'), 'length(t)')}, 6) AS latin_ratio, round({S.ratio(S.count('t', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + S.WS[1:-1] + ']'), 'length(t)')}, 6) AS special_ratio FROM m""")
def text_metrics(spark, sf):
    c = F.col("text")
    return docs(spark, sf, "text").select(
        "doc_id", T.n_words(c).cast("bigint").alias("n_words"), T.n_lines(c).cast("bigint").alias("n_lines"), r6(T.alpha_ratio(c), "alpha_ratio"), T.stop_word_count(c).cast("bigint").alias("stop_words"),
        r6(T.avg_sentence_length(c), "avg_sentence"), r6(T.latin_ratio(c), "latin_ratio"), r6(T.special_ratio(c), "special_ratio"),
    )


@query(rf"""WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, {S.solid('t')} AS sl, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda y: {S.strip('y')}), lambda y: y <> '') AS ps FROM base)
 SELECT doc_id, round({S.dup_share('sl')}, 6) AS dup_lines, round({S.dup_share('ps')}, 6) AS dup_paragraphs FROM l""")
def duplicate_lines(spark, sf):
    c = F.col("text")
    return docs(spark, sf, "text").select("doc_id", r6(T.duplicate_line_fraction(c), "dup_lines"), r6(T.duplicate_paragraph_fraction(c), "dup_paragraphs"))


_EACH_N = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, total, gram FROM (SELECT doc_id, total, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS gram FROM u) WHERE i <= total - {n} + 1" for n in ngrams.SIZES
)
_GRAMS = rf"""gbase AS (SELECT doc_id, {S.words("lower(coalesce(text, ''))")} AS w FROM documents),
 sizes AS (SELECT unnest(range(2, 11)) AS n),
 u AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM gbase),
 g AS ({_EACH_N}),
 c AS (SELECT doc_id, n, gram, max(total) AS total, count(*) AS k FROM g GROUP BY ALL),
 f AS (SELECT doc_id, n::BIGINT AS n, max(k) * any_value(n) / max(total)::DOUBLE AS top_fraction, coalesce(sum(k) FILTER (k > 1), 0) * any_value(n) / max(total)::DOUBLE AS dup_fraction FROM c GROUP BY doc_id, n),
 fr AS (SELECT b.doc_id, s.n::BIGINT AS n, coalesce(f.top_fraction, 0.0) AS top_fraction, coalesce(f.dup_fraction, 0.0) AS dup_fraction FROM gbase b CROSS JOIN sizes s LEFT JOIN f ON f.doc_id = b.doc_id AND f.n = s.n)"""


@query(f"WITH {_GRAMS} SELECT doc_id, n, round(top_fraction, 6) AS top_fraction, round(dup_fraction, 6) AS dup_fraction FROM fr")
def ngram_fractions(spark, sf):
    rows = ngrams.with_fractions(docs(spark, sf, "text"))
    each = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"), r6(ngrams.top(n), "top_fraction"), r6(ngrams.duplicate(n), "dup_fraction")) for n in ngrams.SIZES])
    return rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


_REPETITION = " ".join(f"WHEN t{n} > {v} THEN 'top_{n}gram_fraction'" for n, v in S.TOP_LIMITS.items()) + " " + " ".join(f"WHEN d{n} > {v} THEN 'dup_{n}gram_fraction'" for n, v in S.DUPLICATE_LIMITS.items())
_REASONS = rf"""{_GRAMS}, wide AS (SELECT doc_id, {", ".join(f"max(top_fraction) FILTER (n = {n}) AS t{n}, max(dup_fraction) FILTER (n = {n}) AS d{n}" for n in range(2, 11))} FROM fr GROUP BY doc_id),
 tx AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, {S.solid('t')} AS sl, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda y: {S.strip('y')}), lambda y: y <> '') AS ps FROM tx),
 rep AS (SELECT doc_id, CASE WHEN {S.dup_share('sl')} > 0.3 THEN 'dup_line_fraction' WHEN {S.dup_share('ps')} > 0.3 THEN 'dup_para_fraction' WHEN len({S.words('t')}) = 0 THEN 'empty' {_REPETITION} END AS repetition FROM l JOIN wide USING (doc_id))"""


@query(f"WITH {_REASONS} SELECT doc_id, repetition FROM rep")
def repetition_reasons(spark, sf):
    return ngrams.with_fractions(docs(spark, sf, "text")).select("doc_id", ngrams.reason(F.col("text")).alias("repetition"))


@query(f"WITH {S.RULES} SELECT doc_id, gopher FROM q")
def gopher_quality(spark, sf):
    return quality.prepared(docs(spark, sf, "text")).select("doc_id", quality.gopher(F.col("text")).alias("gopher"))


@query(f"WITH {S.RULES} SELECT doc_id, c4 FROM q")
def c4_quality(spark, sf):
    return quality.prepared(docs(spark, sf, "text")).select("doc_id", quality.c4(F.col("text")).alias("c4"))


@query(f"WITH {S.RULES} SELECT doc_id, listlike FROM q")
def listlike_quality(spark, sf):
    return quality.prepared(docs(spark, sf, "text")).select("doc_id", quality.listlike(F.col("text")).alias("listlike"))


@query(f"WITH {S.RULES} SELECT doc_id, quality FROM q")
def quality_reasons(spark, sf):
    return docs(spark, sf, "text").select("doc_id", quality.quality_in_batches(F.col("text")).alias("quality"))


@query(f"WITH {S.RULES} SELECT count(*)::BIGINT AS total, count(quality)::BIGINT AS filtered, round(1 - count(quality) / count(*)::DOUBLE, 6) AS retention, (count(*) FILTER (quality LIKE 'gopher:%'))::BIGINT AS gopher, (count(*) FILTER (quality LIKE 'c4:%'))::BIGINT AS c4, (count(*) FILTER (quality LIKE 'third:%'))::BIGINT AS listlike FROM q")
def quality_statistics(spark, sf):
    q = docs(spark, sf, "text").select(quality.quality_in_batches(F.col("text")).alias("q"))
    part = F.substring_index("q", ":", 1)
    return q.agg(
        F.count("*").alias("total"), F.count("q").alias("filtered"), r6(1 - F.count("q") / F.count("*"), "retention"),
        F.count_if(part == "gopher").alias("gopher"), F.count_if(part == "c4").alias("c4"), F.count_if(part == "third").alias("listlike"),
    )


@query(f"""WITH {S.RULES}, g AS (SELECT quality AS k, doc_id FROM q WHERE quality IS NOT NULL), x AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY k) AS n FROM g)
 SELECT k AS rule, n::BIGINT AS n, doc_id AS example FROM x WHERE rn = 1""")
def rule_attribution(spark, sf):
    """Rows and the first example of every rule."""
    q = docs(spark, sf, "text").select("doc_id", quality.quality_in_batches(F.col("text")).alias("q")).where("q IS NOT NULL")
    return q.groupBy(F.col("q").alias("rule")).agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


#: Fixed values, stated anew for the check: type, pattern (that of identity numbers without look-ahead) and placeholder.
_PII_STEPS = [
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    ("phone_us", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    ("ip_v4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_ADDRESS]"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "[CREDIT_CARD]"),
    ("ssn", r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])[-\s]?(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b", "[SSN]"),
]


def pii_cte(source: str = "gen1_output", key: str = "rec_id") -> str:
    sql = f"p0 AS (SELECT {key}, coalesce(text, '') AS orig, coalesce(text, '') AS t FROM {source})"
    for k, (name, pattern, hold) in enumerate(_PII_STEPS, 1):
        earlier = "".join(f", n_{n}" for n, _, _ in _PII_STEPS[: k - 1])
        sql += f", p{k} AS (SELECT {key}, orig, regexp_replace(t, '{pattern}', '{hold}', 'g') AS t{earlier}, len(regexp_extract_all(t, '{pattern}'))::BIGINT AS n_{name} FROM p{k - 1})"
    total = " + ".join(f"n_{n}" for n, _, _ in _PII_STEPS)
    return sql + f", pii AS (SELECT *, ({total})::BIGINT AS n_pii, {S.ratio(f'({total})', f'len({S.words(chr(111) + chr(114) + chr(105) + chr(103))})')} AS density FROM p{len(_PII_STEPS)})"


_PII_ACTION = "CASE WHEN n_pii = 0 THEN 'kept' WHEN density > 0.3 THEN 'filtered_high_density' ELSE 'masked' END"


def _pii(spark, sf):
    return pii.masked(spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id"))


@query(f"WITH {pii_cte()} SELECT rec_id, {', '.join(f'n_{n}' for n, _, _ in _PII_STEPS)}, round(density, 6) AS density, {_PII_ACTION} AS action FROM pii")
def pii_counts(spark, sf):
    return _pii(spark, sf).select("rec_id", *[F.col(f"n_{n}").cast("bigint").alias(f"n_{n}") for n, _, _ in pii.PATTERNS], r6(F.col("pii_density"), "density"), F.col("pii_action").alias("action"))


@query(f"WITH {pii_cte()} SELECT rec_id, t AS masked_text FROM pii WHERE n_pii > 0")
def pii_masked_texts(spark, sf):
    return _pii(spark, sf).where("n_pii > 0").select("rec_id", "masked_text")


@query(f"WITH {pii_cte()} SELECT {_PII_ACTION} AS action, count(*)::BIGINT AS n_docs, {', '.join(f'sum(n_{n})::BIGINT AS n_{n}' for n, _, _ in _PII_STEPS)} FROM pii GROUP BY 1")
def pii_statistics(spark, sf):
    return _pii(spark, sf).groupBy(F.col("pii_action").alias("action")).agg(F.count("*").alias("n_docs"), *[F.sum(f"n_{n}").cast("bigint").alias(f"n_{n}") for n, _, _ in pii.PATTERNS])


_NET = r"lower(regexp_extract(" + S.strip("coalesce(url, '')") + r", '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?', 1))"
_URL_RULE = rf"""CASE WHEN low = '' THEN 'empty_url' WHEN regexp_extract(net, '(\.tk|\.ml|\.ga|\.cf|\.gq)$', 1) <> '' THEN 'blacklist_tld:' || regexp_extract(net, '(\.tk|\.ml|\.ga|\.cf|\.gq)$', 1)
 WHEN regexp_extract(low, '({S.URL_WORDS})', 1) <> '' THEN 'blacklist_keyword:' || regexp_extract(low, '({S.URL_WORDS})', 1)
 WHEN regexp_matches(net, '^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') THEN 'ip_address_url' WHEN net = '' THEN 'no_domain' END"""


@query(f"WITH u AS (SELECT rec_id, lower({S.strip(chr(99) + 'oalesce(url, ' + chr(39) * 2 + ')')}) AS low, {_NET} AS net FROM gen1_output) SELECT rec_id, {_URL_RULE} AS reason FROM u")
def url_filter(spark, sf):
    return table(spark, sf, "gen1_output").select("rec_id", quality.url(F.col("url")).alias("reason"))


_NORM = rf"""CASE WHEN u = '' THEN '' WHEN net = '' THEN 'https://' || regexp_replace(path, '^/', '') || q ELSE 'https://' || regexp_replace(lower(regexp_replace(regexp_replace(net, '^.*@', ''), ':[0-9]*$', '')), '^www\.', '') || path || q END"""
def normalized_cte(source: str = "gen1_output", rec_id: str = "rec_id") -> str:
    return rf"""u0 AS (SELECT {rec_id}, text, {S.strip("coalesce(url, '')")} AS u FROM {source}),
 u1 AS (SELECT {rec_id}, text, u, regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?', 1) AS net, regexp_replace(regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') AS p,
  list_sort(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> '')) AS qs FROM u0),
 u2 AS (SELECT {rec_id}, text, u, net, CASE WHEN p = '' THEN '/' WHEN left(p, 1) = '/' THEN p ELSE '/' || p END AS path, CASE WHEN len(qs) = 0 THEN '' ELSE '?' || array_to_string(list_transform(qs, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END AS q FROM u1),
 norm AS (SELECT {rec_id}, text, {_NORM} AS normalized FROM u2)"""


NORMALIZED = normalized_cte()


@query(f"WITH {NORMALIZED} SELECT rec_id, normalized FROM norm")
def url_normalize(spark, sf):
    return table(spark, sf, "gen1_output").select("rec_id", U.normalized(F.col("url")).alias("normalized"))


@query(f"SELECT rec_id, {S.domain('url')} AS domain FROM gen1_output")
def url_domain(spark, sf):
    return table(spark, sf, "gen1_output").select("rec_id", U.domain(F.col("url")).alias("domain"))


@query(rf"""WITH b AS (SELECT rec_id, coalesce(text, '') AS t FROM gen1_output), w AS (SELECT rec_id, t, {S.words('t')} AS ws FROM b)
 SELECT rec_id, CASE WHEN len(ws) > 50 THEN array_to_string(ws[1:50], ' ') ELSE t END AS truncated, translate(left(t, 500), chr(10), ' ') AS preview, left({S.strip('t')}, 200) AS match_key FROM w""")
def text_cuts(spark, sf):
    """Truncation to fifty words, preview and match key."""
    c = T.text_of(F.col("text"))
    return table(spark, sf, "gen1_output").select("rec_id", T.truncated(c, 50).alias("truncated"), T.preview(c).alias("preview"), T.match_key(c).alias("match_key"))


_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{F900}-\x{FAFF}"


def _zh(spark, sf):
    return spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id")


_SIMP = "".join(x for x in S.SIMPLIFIED if x not in S.TRADITIONAL)


@query(rf"""WITH b AS (SELECT rec_id, coalesce(text, '') AS t FROM gen1_output), c AS (SELECT rec_id, {S.count('t', '[' + _CJK + ']')}::BIGINT AS n_chinese, length(t) AS n, {S.count('t', '[' + S.TRADITIONAL + ']')} AS tr, {S.count('t', '[' + _SIMP + ']')} AS si FROM b)
 SELECT rec_id, n_chinese, round({S.ratio('n_chinese', 'n')}, 4) AS chinese_ratio, round({S.ratio('n_chinese', 'n')}, 4) >= 0.15 AS is_chinese, CASE WHEN tr + si = 0 THEN 'unknown' WHEN tr / (tr + si)::DOUBLE > 0.65 THEN 'traditional' WHEN si / (tr + si)::DOUBLE > 0.65 THEN 'simplified' ELSE 'mixed' END AS script FROM c""")
def chinese_detect(spark, sf):
    c = F.col("text")
    share = chinese.char_ratios(c)["chinese"]
    return _zh(spark, sf).select("rec_id", chinese.n_chinese(c).cast("bigint").alias("n_chinese"), share.alias("chinese_ratio"), (share >= 0.15).alias("is_chinese"), chinese.script(c).alias("script"))


#: Fixed values, stated anew: weight and pattern of the spam signals; runs of five equal characters are counted apart, as RE2 has no back-references.
_SPAM = [
    (0.5, "[★☆]{3,}"), (2.0, "(点击|立即|马上|快速)(下载|购买|领取|注册|登录)"), (2.0, "(免费|优惠|折扣|特价).{0,5}(领取|获取|下载)"), (3.0, "(加微信|加QQ|加我|扫码).{0,10}(咨询|了解|获取)"),
    (0.5, "[0-9]{11}"), (0.3, r"(http|https|www)[^\s]{3,50}"), (3.0, "(转发|分享|点赞).{0,5}(抽奖|免费|赢)"), (1.5, "(?i:SEO|关键词优化|百度排名|搜索引擎优化)"),
]


def zh_cte(source: str, out: str = "zq") -> str:
    """CTEs ending in ``out``: measures, reason and script of the texts ``t`` of ``source (rec_id, t)``."""
    letters, digit, punct = chr(92) + "p{L}", chr(92) + "p{Nd}", chr(92) + "p{P}"
    spam = " + ".join(f"least(len(regexp_extract_all(t, '{p}')), 5) * {w}::DOUBLE" for w, p in _SPAM)
    return rf"""z0 AS ({source}), zl AS (SELECT rec_id, t, len(regexp_extract_all(t, '[{_CJK}]')) AS zh, length(t) AS n, list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS ls, regexp_extract_all(t, '[{_CJK}]') AS cs, {S.count('t', '[' + S.TRADITIONAL + ']')} AS tr, {S.count('t', '[' + _SIMP + ']')} AS si FROM z0),
 zch AS (SELECT rec_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM z0), zrun AS (SELECT rec_id, c, i - row_number() OVER (PARTITION BY rec_id, c ORDER BY i) AS g FROM zch WHERE c <> chr(10)), zrep AS (SELECT rec_id, count(*) AS runs FROM (SELECT rec_id, c, g FROM zrun GROUP BY ALL HAVING count(*) >= 5) GROUP BY 1),
 zb AS (SELECT rec_id, unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) AS b FROM zl), zbt AS (SELECT rec_id, max(k) / sum(k)::DOUBLE AS top FROM (SELECT rec_id, b, count(*) AS k FROM zb GROUP BY ALL) GROUP BY 1),
 zm AS (SELECT zl.*, round({S.ratio('zh', 'n')}, 4) AS r_zh, round({S.ratio("(len(regexp_extract_all(t, '" + letters + "')) - zh)", 'n')}, 4) AS r_latin, round({S.ratio("len(regexp_extract_all(t, '" + digit + "'))", 'n')}, 4) AS r_digit, round({S.ratio("len(regexp_extract_all(t, '" + punct + "|～'))", 'n')}, 4) AS r_punct,
  {S.ratio("len(list_filter(ls, lambda x: right(x, 1) IN ('。', '！', '？', '…')))", 'len(ls)')} AS term, {S.dup_share('list_filter(ls, lambda x: length(x) > 3)')} AS dups, coalesce(top, 0.0) AS top, least(({spam} + least(coalesce(runs, 0), 5) * 1.0) / 20, 1.0) AS spam,
  len(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')) AS paras, len(regexp_extract_all(t, '([{_CJK}]|[{letters}{chr(92)}p{{N}}]+)')) AS n_tokens,
  CASE WHEN tr + si = 0 THEN 'unknown' WHEN tr / (tr + si)::DOUBLE > 0.65 THEN 'traditional' WHEN si / (tr + si)::DOUBLE > 0.65 THEN 'simplified' ELSE 'mixed' END AS script FROM zl LEFT JOIN zrep USING (rec_id) LEFT JOIN zbt USING (rec_id)),
 {out} AS (SELECT *, floor(zh * 1.5 + floor(n * r_latin) / 5 * 1.3 + floor(n * r_digit))::BIGINT AS est, CASE WHEN zh < 100 THEN 'zh_too_short' WHEN zh > 50000 THEN 'zh_too_long' WHEN r_zh < 0.20 THEN 'low_zh_ratio' WHEN term < 0.20 THEN 'low_terminal_punct' WHEN dups > 0.50 THEN 'high_dup_lines' WHEN top > 0.30 THEN 'high_bigram_rep' WHEN spam > 0.35 THEN 'spam_score' WHEN {S.strip('t')} = '' THEN 'too_few_paragraphs' END AS reason FROM zm)"""


_ZH_NORMAL = S.strip("regexp_replace(regexp_replace(translate(t, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_ZH_ROWS = f"SELECT rec_id, t FROM (SELECT rec_id, coalesce(text, '') AS t FROM gen1_output) WHERE round({S.ratio(S.count('t', '[' + _CJK + ']'), 'length(t)')}, 4) >= 0.15"


@query(f"WITH {zh_cte(_ZH_ROWS)} SELECT rec_id, reason, round(spam, 6) AS spam, est AS est_tokens, n_tokens::BIGINT AS n_tokens, length({_ZH_NORMAL})::BIGINT AS n_chars, round(top, 6) AS top_bigram FROM zq")
def chinese_quality(spark, sf):
    """Reasons, spam scores and token estimates of the Chinese rows."""
    c = F.col("text")
    return _zh(spark, sf).where(chinese.char_ratios(c)["chinese"] >= 0.15).select(
        "rec_id", chinese.quality(c).alias("reason"), r6(chinese.spam_score(c), "spam"), chinese.estimated_tokens(c).alias("est_tokens"), F.size(chinese.tokens(c)).cast("bigint").alias("n_tokens"), F.length(chinese.normalized(c)).cast("bigint").alias("n_chars"), r6(chinese.top_bigram_ratio(c), "top_bigram"),
    )


@query(f"WITH {zh_cte(_ZH_ROWS)} SELECT rec_id, zh::BIGINT AS zh_char_count, n::BIGINT AS total_chars, r_zh AS zh_char_ratio, r_latin AS latin_ratio, r_digit AS digit_ratio, r_punct AS punct_ratio, round(term, 4) AS terminal_punct_ratio, round(dups, 4) AS duplicate_line_ratio, round(top, 4) AS top_bigram_ratio, round(spam, 4) AS spam_score, paras::BIGINT AS paragraph_count, len(ls)::BIGINT AS line_count, est AS estimated_tokens, script AS script_type FROM zq")
def chinese_scores(spark, sf):
    """The fourteen measures of the Chinese rows."""
    c = F.col("text")
    return _zh(spark, sf).where(chinese.char_ratios(c)["chinese"] >= 0.15).select("rec_id", *[v.alias(k) for k, v in chinese.scores(c).items()])
