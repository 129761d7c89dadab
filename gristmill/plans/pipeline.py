"""The three generations of curation over the documents: cascade, score cut, and routes with rewriting; with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import cascade, measures, quality, rewrite
from gristmill.operators.components import checkpointed
from gristmill.plans import rules
from gristmill.plans import sqlparts as S
from gristmill.plans.rules import docs, r6
from gristmill.scorers import language, linear, toxicity
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


# ---- SQL shared by the queries -------------------------------------------------------------

#: Fixed values, stated anew: function words that tell a language.
_LANG_WORDS = {
    "en": "the of and to is that for with was as at by from this have are not", "de": "der das und ist nicht mit von den ein eine auf für dem sich im zu",
    "fr": "le les des est une dans pour du et qui sur au pas avec il", "es": "el los las una del por con para como más pero y su fue",
}


def lang_sql(source: str, key: str, t: str = "t", out: str = "lg") -> str:
    """CTEs ending in ``out (key, dl, dc)``: detected language and confidence."""
    count = lambda ws: f"len(list_filter(regexp_split_to_array(h, '[^\\p{{L}}]+'), lambda w: list_contains([{', '.join(repr(w) for w in ws.split())}], w)))"
    most = "greatest(" + ", ".join(f"c_{k}" for k in _LANG_WORDS) + ")"
    total = " + ".join(f"c_{k}" for k in _LANG_WORDS)
    return rf"""{out}0 AS (SELECT {key}, lower(left({S.strip(f"translate({t}, chr(10), ' ')")}, 1000)) AS h FROM {source}),
 {out}1 AS (SELECT {key}, h, {', '.join(f'{count(ws)} AS c_{k}' for k, ws in _LANG_WORDS.items())}, {S.count('h', chr(92) + 'p{L}')} AS letters, {S.count('h', '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} AS han FROM {out}0),
 {out}2 AS (SELECT *, CASE WHEN length(h) < 10 THEN 'unknown' WHEN letters > 0 AND han >= letters * 0.3 THEN 'zh' WHEN {most} = 0 THEN 'unknown' {' '.join(f"WHEN c_{k} = {most} THEN '{k}'" for k in _LANG_WORDS)} END AS dl FROM {out}1),
 {out} AS (SELECT {key}, dl, round(CASE WHEN dl = 'unknown' THEN 0.0 WHEN dl = 'zh' THEN han / letters::DOUBLE ELSE {most} / ({total})::DOUBLE END, 4) AS dc FROM {out}2)"""


_LANG_REASON = "CASE WHEN dl = 'en' AND dc >= 0.65 THEN NULL WHEN dl = 'en' THEN 'en:unsure' ELSE dl END"
#: Fixed values, stated anew: terms of the toxicity dimensions.
_TERMS = {
    "severe_toxicity": "motherfucker|cunt|kill yourself|filthy whore", "obscene": "fuck|fucking|shit|asshole|bitch|cunt|cock|bastard|motherfucker",
    "threat": "kill you|hurt you|beat you|shoot you|find you|kill yourself", "insult": "idiot|moron|stupid|loser|scum|pathetic|worthless",
    "identity_attack": "vermin|subhuman|inferior race|go back to your country|filthy foreigners",
}


def tox_sql(source: str, keep: str, t: str, out: str = "tx") -> str:
    """CTE ``out``: columns ``keep`` and a column for each dimension."""
    one = lambda p: f"round(1 - power(0.45, len(regexp_extract_all(lower({t}), '{chr(92)}b(?:{p}){chr(92)}b'))), 4)"
    dims = ", ".join(f"{one(p)} AS {k}" for k, p in _TERMS.items())
    return f"{out}0 AS (SELECT {keep}, {dims} FROM {source}), {out} AS (SELECT *, greatest({', '.join(_TERMS)}) AS toxicity FROM {out}0)"


_U = r"lower(regexp_extract(" + S.strip("coalesce(url, '')") + r", '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?', 1))"
_TEXT_KEY = f"array_to_string({S.words('lower(coalesce(text, ' + chr(39) * 2 + '))')}, ' ')"
#: Every document with measures, scores and the first step and reason that drops it.
STATE = rf"""{S.RULES}, {rules._REASONS}, {rules.normalized_cte("documents", "doc_id")},
 uk AS (SELECT doc_id, CASE WHEN normalized = '' THEN 't' || {_TEXT_KEY} ELSE 'u' || normalized END AS k FROM norm), firsts AS (SELECT min(doc_id) AS doc_id FROM uk GROUP BY k),
 ur0 AS (SELECT doc_id, lower({S.strip("coalesce(url, '')")}) AS low, {_U} AS net FROM documents), ur AS (SELECT doc_id, {rules._URL_RULE} AS ureason FROM ur0),
 {lang_sql("base", "doc_id")}, {rules.pii_cte("documents", "doc_id")}, {tox_sql("pii", "doc_id, t AS masked, n_pii, density", "t", "tox")},
 st0 AS (SELECT q.*, {S.model("edu")} AS s_edu, {S.model("reference")} AS s_ref, {S.model("wiki")} AS s_wiki, {S.model("evaluation")} AS s_eval, dl, dc, masked, n_pii, toxicity,
  CASE WHEN firsts.doc_id IS NULL THEN 'url_dedup:copy' WHEN ureason IS NOT NULL THEN 'url_filter:' || ureason WHEN {_LANG_REASON} IS NOT NULL THEN 'lang:' || {_LANG_REASON} WHEN quality IS NOT NULL THEN 'quality:' || quality
   WHEN repetition IS NOT NULL THEN 'repetition:' || repetition WHEN density > 0.3 THEN 'pii_density:filtered_high_density' WHEN toxicity > 0.85 OR severe_toxicity > 0.5 THEN 'toxicity:score' END AS reason
  FROM q JOIN rep USING (doc_id) JOIN ur USING (doc_id) JOIN lg USING (doc_id) JOIN tox USING (doc_id) LEFT JOIN firsts USING (doc_id)),
 st AS (SELECT *, split_part(reason, ':', 1) AS step, greatest(s_edu, s_ref, s_wiki) AS ens FROM st0)"""
_STEP_LIST = ["url_dedup", "url_filter", "lang", "quality", "repetition", "pii_density", "toxicity"]


def annotated(spark, sf, *columns: str) -> DataFrame:
    """Documents through the cascade, with ``columns`` of the table kept."""
    return cascade.whole(docs(spark, sf, "text", "url", *[c for c in columns if c not in ("text", "url")]))


def state(spark, sf, *columns: str) -> DataFrame:
    """The same with all scores and the number of words, in the one pass that reads the texts."""
    df = linear.with_scores(annotated(spark, sf, *columns)).withColumn("n_words", T.n_words(F.col("text")))
    return df.withColumn("ensemble", F.greatest("score_edu", "score_reference", "score_wiki"))


# ---- the cascade ---------------------------------------------------------------------------


@query(f"WITH {STATE} SELECT doc_id, reason FROM st")
def gen1_cascade(spark, sf):
    """The first step that drops every document: copies of an address, its filter, language, quality, repetition, personal information, toxicity."""
    return annotated(spark, sf).select("doc_id", "reason")


@query(f"WITH {STATE} SELECT coalesce(step, 'kept') AS step, coalesce(split_part(reason, ':', 2), 'kept') AS category, count(*)::BIGINT AS n FROM st GROUP BY ALL")
def gen1_cascade_counts(spark, sf):
    part = lambda k: F.coalesce(F.split_part("reason", F.lit(":"), F.lit(k)), F.lit("kept"))
    return annotated(spark, sf).groupBy(part(1).alias("step"), part(2).alias("category")).agg(F.count("*").alias("n"))


_STEPS_SQL = ", ".join(f"({i}, '{s}')" for i, s in enumerate(_STEP_LIST))


@query(f"""WITH {STATE}, steps(k, step) AS (VALUES {_STEPS_SQL}), ct AS (SELECT s.k AS k, count(*) AS n FROM st JOIN steps s ON s.step = st.step GROUP BY 1),
 b AS (SELECT k, step, (SELECT count(*) FROM st) - coalesce((SELECT sum(n) FROM ct WHERE ct.k < steps.k), 0) AS before, coalesce((SELECT n FROM ct WHERE ct.k = steps.k), 0) AS filtered FROM steps)
 SELECT step, before::BIGINT AS before, (before - filtered)::BIGINT AS after, filtered::BIGINT AS filtered, round(CASE WHEN before > 0 THEN filtered / before::DOUBLE ELSE 0 END, 6) AS filter_rate FROM b""")
def gen1_step_statistics(spark, sf):
    """Rows before and after each of the seven steps."""
    return cascade.step_statistics(annotated(spark, sf))


@query(f"WITH {STATE} SELECT doc_id, masked AS masked_text, n_pii, dl AS lang, dc AS conf, toxicity FROM st WHERE reason IS NULL")
def gen1_output_texts(spark, sf):
    """What the cascade leaves, personal information masked, with the attributes it adds."""
    kept = annotated(spark, sf).where("reason IS NULL")
    return kept.select("doc_id", "masked_text", F.col("n_pii").cast("bigint").alias("n_pii"), F.col("detected_lang").alias("lang"), F.col("lang_conf").alias("conf"), "toxicity")


@query(f"""WITH {STATE}, rd_ AS (SELECT step, reason, count(*) AS n FROM st WHERE reason IS NOT NULL GROUP BY ALL), rr_ AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, reason) AS k FROM rd_)
 SELECT step, reason, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY step), 6) AS of_step FROM rr_ WHERE k <= 100""")
def gen1_reason_details(spark, sf):
    """The hundred most frequent reasons of every step, with their shares of it; reasons are few, whatever the corpus."""
    from pyspark.sql import Window

    d = annotated(spark, sf).where("reason IS NOT NULL").groupBy("step", "reason").agg(F.count("*").alias("n"))
    w = Window.partitionBy("step")
    r = d.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "reason"))).where("k <= 100")
    return r.select("step", "reason", "n", r6(F.col("n") / F.sum("n").over(w), "of_step"))


@query(f"WITH base AS (SELECT rec_id, coalesce(text, '') AS t FROM gen1_output), {lang_sql('base', 'rec_id')} SELECT rec_id, dl AS lang, dc AS conf, {_LANG_REASON} AS reason FROM lg")
def detected_languages(spark, sf):
    """Language, confidence and the reason of the language filter for every row."""
    g = spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id").withColumn("d", language.detected(F.col("text")))
    return g.select("rec_id", "d.lang", "d.conf", language.reason(F.col("d.lang"), F.col("d.conf")).alias("reason"))


@query(f"""WITH base AS (SELECT rec_id, coalesce(text, '') AS t FROM gen1_output), {lang_sql('base', 'rec_id')}, g AS (SELECT CASE WHEN dc < 0.5 THEN 'uncertain' ELSE dl END AS lang, count(*) AS n, avg(dc) AS c FROM lg GROUP BY 1)
 SELECT lang, n::BIGINT AS n, round(n / (SELECT sum(n) FROM g), 6) AS rate, round(c, 6) AS mean_confidence, lang = 'en' AS is_target, (SELECT count(*) FROM g)::BIGINT AS n_languages FROM g ORDER BY n DESC, lang LIMIT 20""")
def language_statistics(spark, sf):
    """The twenty most frequent detected languages with their rates, the target's marked."""
    d = spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id").select(language.detected(F.col("text")).alias("d"))
    g = d.groupBy(F.when(F.col("d.conf") < 0.5, "uncertain").otherwise(F.col("d.lang")).alias("lang")).agg(F.count("*").alias("n"), r6(F.avg("d.conf"), "mean_confidence"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t"), F.count("*").alias("n_languages"))))  # one row
    return g.select("lang", "n", r6(F.col("n") / F.col("t"), "rate"), "mean_confidence", (F.col("lang") == "en").alias("is_target"), "n_languages").orderBy(F.desc("n"), "lang").limit(20)


_TOX = tox_sql("(SELECT rec_id, coalesce(text, '') AS t FROM gen1_output)", "rec_id", "t")


def _toxicity(spark, sf) -> DataFrame:
    return toxicity.with_scores(spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id"))


@query(f"WITH {_TOX} SELECT rec_id, toxicity, {', '.join(_TERMS)}, toxicity > 0.85 OR severe_toxicity > 0.5 AS is_toxic FROM tx")
def toxicity_scores(spark, sf):
    """Six dimensions for every row, and whether the filter would mark it."""
    return toxicity.filtered(_toxicity(spark, sf)).select("rec_id", *toxicity.DIMENSIONS, "is_toxic")


@query(f"WITH {_TOX} SELECT CASE WHEN toxicity > 0.85 OR severe_toxicity > 0.5 THEN 'flagged' ELSE 'kept' END AS action, count(*)::BIGINT AS n, round(avg(toxicity), 6) AS mean_toxicity FROM tx GROUP BY 1")
def toxicity_filter_statistics(spark, sf):
    """Rows by what the toxicity filter does; flagging never drops."""
    return toxicity.filtered(_toxicity(spark, sf)).groupBy(F.col("toxicity_action").alias("action")).agg(F.count("*").alias("n"), r6(F.avg("toxicity"), "mean_toxicity"))


_QS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(f"""WITH {_TOX}, l AS (UNPIVOT (SELECT toxicity, {', '.join(_TERMS)} FROM tx) ON COLUMNS(*) INTO NAME dimension VALUE x)
 SELECT dimension, round(avg(x), 6) AS mean, {', '.join(f'round(quantile_cont(x, {q}), 6) AS {k}' for k, q in _QS.items())}, round(avg((x > 0.5)::INT), 6) AS rate_50, round(avg((x > 0.8)::INT), 6) AS rate_80 FROM l GROUP BY dimension""")
def toxicity_by_dimension(spark, sf):
    """Mean, quantiles and rates of the six dimensions. Scores have four places, so that the quantiles' tables stay small."""
    x = F.col("x")
    rows = _toxicity(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("x")) for d in toxicity.DIMENSIONS])).alias("s")).select("s.*")
    return rows.groupBy("dimension").agg(r6(F.avg(x), "mean"), *[r6(F.percentile(x, F.lit(q)), k) for k, q in _QS.items()], r6(F.avg((x > 0.5).cast("int")), "rate_50"), r6(F.avg((x > 0.8).cast("int")), "rate_80"))


# ---- learned scores, cuts and routes -------------------------------------------------------


@query(f"WITH {S.METRICS} SELECT doc_id, {S.model('edu')} AS edu, {S.model('reference')} AS reference, {S.model('wiki')} AS wiki, {S.model('evaluation')} AS evaluation FROM m")
def quality_scores(spark, sf):
    """The four stored models on every document."""
    return linear.with_scores(docs(spark, sf, "text")).select("doc_id", *[F.col(f"score_{n}").alias(n) for n in linear.STORED])


_ENSEMBLE = f"{S.METRICS.rstrip()}, e AS (SELECT doc_id, {S.model('edu')} AS a, {S.model('reference')} AS b, {S.model('wiki')} AS c FROM m)"


def _ensemble(spark, sf):
    return linear.with_scores(docs(spark, sf, "text"), names=("edu", "reference", "wiki")).select("doc_id", F.col("score_edu").alias("a"), F.col("score_reference").alias("b"), F.col("score_wiki").alias("c"))


@query(f"WITH {_ENSEMBLE} SELECT doc_id, greatest(a, b, c) AS union_score, least(a, b, c) AS intersection_score, round((0.4 * a + 0.4 * b + 0.2 * c) / (0.4 + 0.4 + 0.2), 4) AS weighted_score, greatest(a, b, c) >= 0.5 AS is_high FROM e")
def ensemble_scores(spark, sf):
    """Three models together: by the greatest, the least and the weighted mean of their scores."""
    return _ensemble(spark, sf).select(
        "doc_id", F.greatest("a", "b", "c").alias("union_score"), F.least("a", "b", "c").alias("intersection_score"), F.round((F.lit(0.4) * F.col("a") + F.lit(0.4) * F.col("b") + F.lit(0.2) * F.col("c")) / F.lit(0.4 + 0.4 + 0.2), 4).alias("weighted_score"),
        (F.greatest("a", "b", "c") >= 0.5).alias("is_high"),
    )


@query(f"WITH {_ENSEMBLE}, x AS (SELECT count(*) FILTER (a >= 0.5) AS na, count(*) FILTER (b >= 0.5) AS nb, count(*) FILTER (c >= 0.5) AS nc, count(*) FILTER (greatest(a, b, c) >= 0.5) AS nu, count(*) AS n FROM e) SELECT na::BIGINT AS na, nb::BIGINT AS nb, nc::BIGINT AS nc, nu::BIGINT AS n_union, (nu - greatest(na, nb, nc))::BIGINT AS gain, round(na / n::DOUBLE, 4) AS rate_a, round(nb / n::DOUBLE, 4) AS rate_b, round(nc / n::DOUBLE, 4) AS rate_c, round(nu / n::DOUBLE, 4) AS rate FROM x")
def coverage_gain(spark, sf):
    """How many documents each model and the union take for good, and what the union adds to the best."""
    at = lambda *c: F.count_if((F.greatest(*c) if len(c) > 1 else F.col(c[0])) >= 0.5)
    x = _ensemble(spark, sf).agg(at("a").alias("na"), at("b").alias("nb"), at("c").alias("nc"), at("a", "b", "c").alias("n_union"), F.count("*").alias("n"))
    rate = lambda c, name: F.round(F.col(c) / F.col("n"), 4).alias(name)
    return x.select("na", "nb", "nc", "n_union", (F.col("n_union") - F.greatest("na", "nb", "nc")).alias("gain"), rate("na", "rate_a"), rate("nb", "rate_b"), rate("nc", "rate_c"), rate("n_union", "rate"))


_ROUTE = "CASE WHEN {x} >= 0.7 THEN 'high_quality' WHEN {x} >= 0.3 THEN 'medium_quality' WHEN {x} >= 0.1 THEN 'to_rephrase' ELSE 'discarded' END"
#: The three generations as rows ``gen, doc_id, score, n_words, n_tokens``; rewritten documents with the measures of their new text.
_NEW_TEXT = f"array_to_string(list_filter(sl, lambda y: len({S.words('y')}) >= 4), chr(10))"
GENERATIONS = rf"""{STATE}, k1 AS (SELECT * FROM st WHERE reason IS NULL), cut AS (SELECT quantile_cont(s_edu, 0.9) AS threshold FROM k1), routed AS (SELECT *, {_ROUTE.format(x="ens")} AS route FROM k1),
 rw0 AS (SELECT doc_id, t AS old, n_words AS old_words, s_eval AS old_eval, ens AS old_ens, {_NEW_TEXT} AS t FROM routed WHERE route = 'to_rephrase'),
 {S.metrics("SELECT * FROM rw0", "rwb", "rwm").strip()}, {lang_sql("rwm", "doc_id", "t", "ln")}, {lang_sql("rwm", "doc_id", "old", "lo")},
 rw AS (SELECT rwm.*, greatest({S.model("edu")}, {S.model("reference")}, {S.model("wiki")}) AS new_ens, {S.model("evaluation")} AS new_eval,
  CASE WHEN old_words < 30 THEN 'too_short' WHEN n_words < 20 THEN 'empty_result' WHEN ln.dl <> lo.dl THEN 'lang_mismatch' WHEN greatest({S.model("edu")}, {S.model("reference")}, {S.model("wiki")}) < 0.4 THEN 'quality_filtered' ELSE 'success' END AS status
  FROM rwm JOIN ln USING (doc_id) JOIN lo USING (doc_id)),
 gen AS (SELECT 'raw' AS gen, doc_id, s_eval AS score, n_words, octet_length(encode(t)) AS bytes, FALSE AS is_synthetic FROM st UNION ALL SELECT 'gen1', doc_id, s_eval, n_words, octet_length(encode(t)), FALSE FROM k1
  UNION ALL SELECT 'gen2', doc_id, s_eval, n_words, octet_length(encode(t)), FALSE FROM k1, cut WHERE s_edu >= threshold UNION ALL SELECT 'gen3', doc_id, s_eval, n_words, octet_length(encode(t)), FALSE FROM routed WHERE route IN ('high_quality', 'medium_quality')
  UNION ALL SELECT 'gen3', doc_id, new_eval, n_words, octet_length(encode(t)), TRUE FROM rw WHERE status = 'success')"""


def scored_state(spark, sf) -> DataFrame:
    """One row per document: steps, scores, route, and the outcome of rewriting; texts are read once and not kept."""
    df = state(spark, sf).withColumn("route", F.when(F.col("reason").isNull(), measures.route(F.col("ensemble"))))
    strict = quality.quality_in_batches(F.when(F.col("reason").isNull(), F.col("text")), min_alpha=0.7)
    df = df.withColumn("fails_strict", F.col("reason").isNull() & strict.isNotNull()).withColumn("_old", F.when(F.col("route") == "to_rephrase", F.col("text")))
    df = rewrite.rewritten(df, "_old").withColumn("rewrite_status", F.when(F.col("route") == "to_rephrase", F.col("rewrite_status")))
    new = F.when(F.col("rewrite_status").isNotNull(), F.col("new_text"))
    df = df.withColumns({"new_eval": T.let(linear.measured(new), lambda x: linear.score("evaluation", {k: x[k] for k in linear.FEATURES})), "new_words": T.n_words(new), "new_bytes": F.octet_length(new), "bytes": F.octet_length(T.text_of(F.col("text")))})
    keep = ("doc_id", "url", "step", "reason", "score_edu", "score_evaluation", "ensemble", "toxicity", "n_words", "bytes", "route", "fails_strict", "rewrite_status", "new_score", "new_eval", "new_words", "new_bytes")
    return checkpointed(df.select(*keep))


def generations(rows: DataFrame) -> DataFrame:
    """``gen, doc_id, score, n_words, bytes, is_synthetic`` of raw, gen1, gen2 and gen3 from ``scored_state``."""
    kept = rows.where("reason IS NULL")
    good = measures.top_fraction(kept.select("doc_id", "score_edu", "score_evaluation", "n_words", "bytes"), "score_edu", 0.1)
    as_gen = lambda df, gen: df.select(F.lit(gen).alias("gen"), "doc_id", F.col("score_evaluation").alias("score"), F.col("n_words").cast("bigint").alias("n_words"), F.col("bytes").cast("bigint").alias("bytes"), F.lit(False).alias("is_synthetic"))
    new = kept.where("rewrite_status = 'success'").select(F.lit("gen3").alias("gen"), "doc_id", F.col("new_eval").alias("score"), F.col("new_words").cast("bigint").alias("n_words"), F.col("new_bytes").cast("bigint").alias("bytes"), F.lit(True).alias("is_synthetic"))
    return as_gen(rows, "raw").unionByName(as_gen(kept, "gen1")).unionByName(as_gen(good, "gen2")).unionByName(as_gen(kept.where("route IN ('high_quality', 'medium_quality')"), "gen3")).unionByName(new)


@query(f"WITH {GENERATIONS} SELECT doc_id, s_edu AS score FROM k1, cut WHERE s_edu >= threshold")
def gen2_pipeline(spark, sf):
    """Cascade, then the best tenth by the learned score. Texts are read once: ids and scores are written, the cut is made on them."""
    kept = checkpointed(linear.with_scores(annotated(spark, sf).where("reason IS NULL"), names=("edu",)).select("doc_id", F.col("score_edu").alias("score")))
    return measures.top_fraction(kept, "score", 0.1).select("doc_id", "score")


@query(f"WITH {GENERATIONS} SELECT doc_id, ens AS score, route, FALSE AS is_rewritten FROM routed WHERE route IN ('high_quality', 'medium_quality') UNION ALL SELECT doc_id, old_ens, 'to_rephrase', TRUE FROM rw WHERE status = 'success'")
def gen3_pipeline(spark, sf):
    """Cascade, routes by the ensemble, and the union of what is kept and what was rewritten well."""
    rows = scored_state(spark, sf).where("reason IS NULL")
    good = rows.where("route IN ('high_quality', 'medium_quality')").select("doc_id", F.col("ensemble").alias("score"), "route", F.lit(False).alias("is_rewritten"))
    return good.unionByName(rows.where("rewrite_status = 'success'").select("doc_id", F.col("ensemble").alias("score"), "route", F.lit(True).alias("is_rewritten")))


@query(f"WITH {S.METRICS}, e AS (SELECT doc_id, greatest({S.model('edu')}, {S.model('reference')}, {S.model('wiki')}) AS score FROM m) SELECT doc_id, score, {_ROUTE.format(x='score')} AS route FROM e")
def routing(spark, sf):
    """The route of every document by the ensemble."""
    return _ensemble(spark, sf).select("doc_id", F.greatest("a", "b", "c").alias("score")).select("doc_id", "score", measures.route(F.col("score")).alias("route"))


@query(f"""WITH {S.METRICS}, e AS (SELECT greatest({S.model('edu')}, {S.model('reference')}, {S.model('wiki')}) AS score FROM m), g AS (SELECT {_ROUTE.format(x='score')} AS route, count(*) AS n FROM e GROUP BY 1)
 SELECT route, n::BIGINT AS n, round(n / (SELECT sum(n) FROM g), 6) AS rate, (SELECT coalesce(sum(n), 0) FROM g WHERE route IN ('high_quality', 'medium_quality'))::BIGINT AS total_kept FROM g""")
def routing_summary(spark, sf):
    """Documents by route, and how many are kept without rewriting."""
    g = _ensemble(spark, sf).groupBy(measures.route(F.greatest("a", "b", "c")).alias("route")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col("route").isin("high_quality", "medium_quality"), F.col("n"))), F.lit(0)).alias("total_kept"))
    return g.crossJoin(F.broadcast(total)).select("route", "n", r6(F.col("n") / F.col("t"), "rate"), "total_kept")  # four rows


@query(f"WITH {GENERATIONS}, h AS (SELECT * FROM routed WHERE route = 'high_quality') SELECT count(*)::BIGINT AS n_high, (count(*) FILTER (alpha_ratio < 0.7))::BIGINT AS would_be_dropped, round(count(*) FILTER (alpha_ratio < 0.7) / nullif(count(*), 0)::DOUBLE, 6) AS rate FROM h")
def bypass_value(spark, sf):
    """Documents routed as good that the strict rules, with a share of letters of 0.7, would drop."""
    h = scored_state(spark, sf).where("route = 'high_quality'")
    return h.agg(F.count("*").alias("n_high"), F.count_if("fails_strict").alias("would_be_dropped"), r6(F.count_if("fails_strict") / F.nullif(F.count("*"), F.lit(0)), "rate"))


@query(f"WITH {S.METRICS}, x0 AS (SELECT doc_id, t AS old, n_words AS old_words, {_NEW_TEXT} AS t FROM m), {S.metrics('SELECT * FROM x0', 'xb', 'xm').strip()}, {lang_sql('xm', 'doc_id', 't', 'ln')}, {lang_sql('xm', 'doc_id', 'old', 'lo')} SELECT CASE WHEN old_words < 30 THEN 'too_short' WHEN n_words < 20 THEN 'empty_result' WHEN ln.dl <> lo.dl THEN 'lang_mismatch' WHEN greatest({S.model('edu')}, {S.model('reference')}, {S.model('wiki')}) < 0.4 THEN 'quality_filtered' ELSE 'success' END AS status, count(*)::BIGINT AS n FROM xm JOIN ln USING (doc_id) JOIN lo USING (doc_id) GROUP BY 1")
def rewrite_gates(spark, sf):
    """What the gates around the deterministic rewriter say about every document."""
    return rewrite.rewritten(docs(spark, sf, "text")).groupBy(F.col("rewrite_status").alias("status")).agg(F.count("*").alias("n"))


def _evaluated(c):
    return T.let(linear.measured(c), lambda x: linear.score("evaluation", {k: x[k] for k in linear.FEATURES}))


@query(f"WITH {S.METRICS}, x0 AS (SELECT doc_id, n_words AS old_words, length(t) AS old_chars, {S.model('evaluation')} AS old_eval, {_NEW_TEXT} AS t FROM m WHERE n_words >= 30), {S.metrics('SELECT * FROM x0', 'xb', 'xm').strip()}, y AS (SELECT *, {S.model('evaluation')} AS new_eval FROM xm WHERE n_words >= 20) SELECT count(*)::BIGINT AS n, round(avg(old_eval), 4) AS before_mean, round(avg(new_eval), 4) AS after_mean, round(avg(new_eval - old_eval), 4) AS gain_mean, round(quantile_cont(round(new_eval - old_eval, 4), 0.5), 4) AS gain_p50, round(avg((new_eval > old_eval)::INT), 4) AS improved, round(avg(length(t)) / avg(old_chars), 4) AS length_ratio FROM y")
def rewrite_before_after(spark, sf):
    """Scores of documents before and after rewriting, paired by id, and how long they became."""
    d = docs(spark, sf, "text").where(T.n_words(F.col("text")) >= rewrite.MIN_BEFORE).withColumn("new", rewrite.without_boilerplate(F.col("text"))).where(T.n_words(F.col("new")) >= rewrite.MIN_AFTER)
    d = d.select(_evaluated(F.col("text")).alias("a"), _evaluated(F.col("new")).alias("b"), F.length(T.text_of(F.col("text"))).alias("la"), F.length("new").alias("lb"))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    gain = F.col("b") - F.col("a")
    return d.agg(F.count("*").alias("n"), r4(F.avg("a"), "before_mean"), r4(F.avg("b"), "after_mean"), r4(F.avg(gain), "gain_mean"), r4(F.percentile(F.round(gain, 4), F.lit(0.5)), "gain_p50"), r4(F.avg((gain > 0).cast("int")), "improved"), r4(F.avg("lb") / F.avg("la"), "length_ratio"))
