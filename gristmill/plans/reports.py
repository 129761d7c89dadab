"""Reports over the generations: stage metrics, profiles, ablations, golden validation, audits, perplexities; with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators import lm, measures
from gristmill.operators.components import checkpointed
from gristmill.plans import pipeline as P
from gristmill.plans import sqlparts as S
from gristmill.plans.pipeline import GENERATIONS, STATE, generations, scored_state
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


def r4(c, name: str):
    return F.round(c, 4).alias(name)


def long(df: DataFrame, dimension: str, *metrics: str) -> DataFrame:
    """``dimension, metric, value`` of the columns ``metrics`` of a frame of one row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(dimension).alias("dimension"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")


# ---- generations side by side --------------------------------------------------------------

_GEN_TOTAL = "(SELECT count(*) FROM st)::DOUBLE"


@query(f"WITH {GENERATIONS} SELECT gen, count(*)::BIGINT AS n, round(count(*) / {_GEN_TOTAL}, 4) AS retention, round(avg(score), 4) AS quality_mean, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.9), 4) AS p90, round(quantile_cont(score, 0.9) - quantile_cont(score, 0.5), 4) AS spread, round(avg((score < 0.2)::INT), 4) AS garbage_rate, round(avg(score) * count(*) / {_GEN_TOTAL}, 4) AS value, (sum(bytes) // 4)::BIGINT AS est_tokens FROM gen GROUP BY gen")
def generation_quality(spark, sf):
    """Size, retention, independent quality, spread, share of garbage and value (quality times share) of each generation."""
    rows = scored_state(spark, sf)
    total = rows.agg(F.count("*").alias("t"))
    s = F.col("score")
    p = lambda q: F.percentile(s, F.lit(q))
    g = generations(rows).groupBy("gen").agg(F.count("*").alias("n"), F.avg(s).alias("m"), r4(p(0.5), "p50"), r4(p(0.9), "p90"), r4(p(0.9) - p(0.5), "spread"), r4(F.avg((s < 0.2).cast("int")), "garbage_rate"), F.floor(F.sum("bytes") / 4).alias("est_tokens"))
    share = F.col("n") / F.col("t")
    return g.crossJoin(F.broadcast(total)).select("gen", "n", r4(share, "retention"), r4(F.col("m"), "quality_mean"), "p50", "p90", "spread", "garbage_rate", r4(F.col("m") * F.col("n") / F.col("t"), "value"), "est_tokens")  # one row


@query(f"WITH {GENERATIONS} SELECT gen, doc_id, score, n_words, is_synthetic FROM gen WHERE score < 0.2")
def garbage_documents(spark, sf):
    """Every document of a generation that the independent evaluation finds worthless."""
    return generations(scored_state(spark, sf)).where("score < 0.2").select("gen", "doc_id", "score", "n_words", "is_synthetic")


@query(f"WITH {GENERATIONS} SELECT gen, round(quantile_cont(n_words, 0.25), 4) AS p25, round(quantile_cont(n_words, 0.5), 4) AS p50, round(quantile_cont(n_words, 0.75), 4) AS p75, round(quantile_cont(score, 0.9) - quantile_cont(score, 0.5), 4) AS separation, CASE WHEN quantile_cont(score, 0.9) - quantile_cont(score, 0.5) > 0.2 THEN 'healthy' WHEN quantile_cont(score, 0.9) - quantile_cont(score, 0.5) >= 0.05 THEN 'weak' ELSE 'abnormal' END AS band FROM gen GROUP BY gen")
def generation_lengths(spark, sf):
    """Quartiles of the number of words and the separation of the scores of each generation."""
    w = lambda q: r4(F.percentile("n_words", F.lit(q)), f"p{round(q * 100)}")
    sep = F.percentile("score", F.lit(0.9)) - F.percentile("score", F.lit(0.5))
    return generations(scored_state(spark, sf)).groupBy("gen").agg(w(0.25), w(0.5), w(0.75), r4(sep, "separation"), F.when(sep > 0.2, "healthy").when(sep >= 0.05, "weak").otherwise("abnormal").alias("band"))


@query(f"""WITH {GENERATIONS}, x_ AS (SELECT gen, min(score) AS lo, max(score) AS hi, count(*) AS n FROM gen GROUP BY gen), b_ AS (SELECT gen, CASE WHEN hi > lo THEN least(floor((score - lo) / ((hi - lo) / 50)), 49) ELSE 0 END::INT AS bin FROM gen JOIN x_ USING (gen)), c_ AS (SELECT gen, bin, count(*) AS k FROM b_ GROUP BY ALL)
 SELECT gen, bin, k::BIGINT AS n, round(CASE WHEN hi > lo THEN k / (x_.n * (hi - lo) / 50) ELSE 0 END, 6) AS density FROM c_ JOIN x_ USING (gen)""")
def generation_density(spark, sf):
    """Histograms of the scores of each generation as densities, fifty bins between its least and greatest score, empty ones left out."""
    g = checkpointed(generations(scored_state(spark, sf)).select("gen", "score"))
    x = g.groupBy("gen").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / 50
    b = g.join(F.broadcast(x), "gen").select("gen", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(49))).otherwise(0).cast("int").alias("bin"), "lo", "hi", "total")  # four rows
    return b.groupBy("gen", "bin", "lo", "hi", "total").agg(F.count("*").alias("n")).select("gen", "bin", "n", r6(F.when(F.col("hi") > F.col("lo"), F.col("n") / (F.col("total") * width)).otherwise(0.0), "density"))


@query(f"WITH {GENERATIONS} SELECT gen, round(quantile_cont(score, 0.1), 4) AS p10, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.9), 4) AS p90, round(quantile_cont(score, 0.9) - quantile_cont(score, 0.1), 4) AS width FROM gen GROUP BY gen")
def generation_widths(spark, sf):
    """Tenth, middle and ninetieth percentile of the scores of each generation, and their width."""
    p = lambda q: F.percentile("score", F.lit(q))
    return generations(scored_state(spark, sf)).groupBy("gen").agg(r4(p(0.1), "p10"), r4(p(0.5), "p50"), r4(p(0.9), "p90"), r4(p(0.9) - p(0.1), "width"))


_FIRST = 200


def _gen_texts_sql() -> str:
    return f"""{GENERATIONS}, gt AS (SELECT gen, doc_id, t FROM (SELECT 'raw' AS gen, doc_id, t FROM st UNION ALL SELECT 'gen1', doc_id, t FROM k1 UNION ALL SELECT 'gen2', doc_id, t FROM k1, cut WHERE s_edu >= threshold
 UNION ALL SELECT 'gen3', doc_id, t FROM routed WHERE route IN ('high_quality', 'medium_quality') UNION ALL SELECT 'gen3', doc_id, t FROM rw WHERE status = 'success') QUALIFY row_number() OVER (PARTITION BY gen ORDER BY doc_id) <= {_FIRST})"""


@query(f"""WITH {_gen_texts_sql()}, w_ AS (SELECT gen, {S.words('lower(t)')} AS w FROM gt), g_ AS (SELECT gen, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS gram FROM w_ WHERE len(w) >= 3)
 SELECT gen, count(DISTINCT gram)::BIGINT AS n_unique, count(*)::BIGINT AS n_total, round(count(DISTINCT gram) / count(*)::DOUBLE, 4) AS trigram_diversity FROM g_ GROUP BY gen""")
def generation_diversity(spark, sf):
    """Share of distinct trigrams in the first 200 documents, by id, of each generation: the head is the measure's own definition."""
    rows = scored_state(spark, sf)
    g = generations(rows).select("gen", "doc_id", "is_synthetic")
    # the 200 least ids of each generation: a bounded top-k for each, no window over a generation
    heads = None
    for name in ("raw", "gen1", "gen2", "gen3"):
        part = g.where(F.col("gen") == name).orderBy("doc_id").limit(_FIRST)
        heads = part if heads is None else heads.unionByName(part)
    from gristmill.operators import rewrite

    t = docs(spark, sf, "text").join(F.broadcast(heads), "doc_id")  # 800 rows
    t = t.select("gen", F.when(F.col("is_synthetic"), rewrite.without_boilerplate(F.col("text"))).otherwise(F.col("text")).alias("text"))
    grams = t.select("gen", F.explode(measures.word_ngrams(F.col("text"), 3)).alias("gram")).groupBy("gen", "gram").agg(F.count("*").alias("c"))
    return grams.groupBy("gen").agg(F.count("*").alias("n_unique"), F.sum("c").alias("n_total")).select("gen", "n_unique", "n_total", r4(F.col("n_unique") / F.col("n_total"), "trigram_diversity"))


_ABLATIONS = f"""{GENERATIONS}, c62 AS (SELECT quantile_cont(s_edu, 0.62) AS cut62 FROM k1),
 ab AS (SELECT 'baseline' AS config, score FROM gen WHERE gen = 'gen3' UNION ALL SELECT 'no_ensemble', s_eval FROM k1, c62 WHERE s_edu >= cut62 UNION ALL SELECT 'no_bypass', s_eval FROM routed WHERE ens >= 0.3 AND alpha_ratio >= 0.7 UNION ALL SELECT 'no_rewrite', s_eval FROM routed WHERE route IN ('high_quality', 'medium_quality')
  UNION ALL SELECT 'no_toxicity', s_eval FROM st WHERE (reason IS NULL OR step = 'toxicity') AND ens >= 0.3),
 ag AS (SELECT config, count(*)::BIGINT AS n, round(count(*) / nullif((SELECT count(*) FROM k1), 0)::DOUBLE, 4) AS retention, round(avg(score), 4) AS quality_mean FROM ab GROUP BY config)"""


def _ablations(spark, sf) -> DataFrame:
    rows = scored_state(spark, sf)
    kept = rows.where("reason IS NULL")
    cut = kept.agg(F.percentile("score_edu", F.lit(0.62)).alias("t"))
    one = lambda df, name, s="score_evaluation": df.select(F.lit(name).alias("config"), F.col(s).alias("score"))
    parts = [
        one(generations(rows).where("gen = 'gen3'"), "baseline", "score"), one(kept.crossJoin(F.broadcast(cut)).where("score_edu >= t"), "no_ensemble"), one(kept.where("ensemble >= 0.3 AND NOT fails_strict"), "no_bypass"),
        one(kept.where("route IN ('high_quality', 'medium_quality')"), "no_rewrite"), one(rows.where("(reason IS NULL OR step = 'toxicity') AND ensemble >= 0.3"), "no_toxicity"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = kept.agg(F.count("*").alias("t"))
    return out.groupBy("config").agg(F.count("*").alias("n"), r4(F.avg("score"), "quality_mean")).crossJoin(F.broadcast(total)).select("config", "n", r4(F.col("n") / F.nullif(F.col("t"), F.lit(0)), "retention"), "quality_mean")  # one row


@query(f"WITH {_ABLATIONS} SELECT * FROM ag")
def ablations(spark, sf):
    """What the third generation becomes without the ensemble, the bypass, rewriting, or the toxicity step."""
    return _ablations(spark, sf)


@query(f"WITH {_ABLATIONS}, b AS (SELECT * FROM ag WHERE config = 'baseline') SELECT ag.config, round(ag.retention - b.retention, 4) AS retention_delta, round(ag.quality_mean - b.quality_mean, 4) AS quality_delta, row_number() OVER (ORDER BY abs(ag.retention - b.retention) DESC, ag.config)::INT AS rank FROM ag, b WHERE ag.config <> 'baseline'")
def ablation_ranking(spark, sf):
    """The ablations by how much they change the retention."""
    a = _ablations(spark, sf)
    b = a.where("config = 'baseline'").select(F.col("retention").alias("br"), F.col("quality_mean").alias("bq"))
    d = a.where("config <> 'baseline'").crossJoin(F.broadcast(b))  # one row
    delta = F.col("retention") - F.col("br")
    return d.select("config", r4(delta, "retention_delta"), r4(F.col("quality_mean") - F.col("bq"), "quality_delta"), F.row_number().over(Window.orderBy(F.desc(F.abs(delta)), "config")).alias("rank"))  # four rows


@query(f"WITH {GENERATIONS}, lt_ AS (SELECT gen, count(*)::DOUBLE AS docs, round(avg(score), 4) AS quality, round(avg(n_words), 4) AS words, (sum(bytes) // 4)::DOUBLE AS tokens FROM gen GROUP BY gen), ut_ AS (UNPIVOT lt_ ON docs, quality, words, tokens INTO NAME metric VALUE v) SELECT metric, max(v) FILTER (gen = 'raw') AS raw, max(v) FILTER (gen = 'gen1') AS gen1, max(v) FILTER (gen = 'gen2') AS gen2, max(v) FILTER (gen = 'gen3') AS gen3 FROM ut_ GROUP BY metric")
def comparison_table(spark, sf):
    """The generations as columns, their measures as rows."""
    g = generations(scored_state(spark, sf)).groupBy("gen").agg(F.count("*").cast("double").alias("docs"), r4(F.avg("score"), "quality"), r4(F.avg("n_words"), "words"), F.floor(F.sum("bytes") / 4).cast("double").alias("tokens"))
    u = g.select("gen", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("docs", "quality", "words", "tokens")])).alias("x")).select("gen", "x.*")
    return u.groupBy("metric").pivot("gen", ["raw", "gen1", "gen2", "gen3"]).agg(F.max("v"))


@query(f"WITH {GENERATIONS}, n AS (SELECT (SELECT count(*) FROM gen WHERE gen = 'gen3') AS out, (SELECT count(*) FROM k1) AS mid, (SELECT count(*) FROM st) AS inp) SELECT inp::BIGINT AS n_input, mid::BIGINT AS n_gen1, out::BIGINT AS n_gen3, round(out / inp::DOUBLE, 6) AS end_to_end, round(out / nullif(mid, 0)::DOUBLE, 6) AS of_gen1 FROM n")
def end_to_end_retention(spark, sf):
    """What the third generation keeps of the input and of the first."""
    rows = scored_state(spark, sf)
    n = rows.agg(F.count("*").alias("n_input"), F.count_if(F.col("reason").isNull()).alias("n_gen1"), F.count_if(F.col("reason").isNull() & (F.col("route").isin("high_quality", "medium_quality") | F.coalesce(F.col("rewrite_status") == "success", F.lit(False)))).alias("n_gen3"))
    return n.select("n_input", "n_gen1", "n_gen3", r6(F.col("n_gen3") / F.col("n_input"), "end_to_end"), r6(F.col("n_gen3") / F.nullif(F.col("n_gen1"), F.lit(0)), "of_gen1"))


@query(f"""WITH {GENERATIONS}, kept AS (SELECT DISTINCT left(t, 100) AS p FROM routed WHERE route IN ('high_quality', 'medium_quality')), a AS (SELECT 'dropped_high' AS kind, doc_id, ens AS score FROM routed WHERE ens > 0 AND left(t, 100) NOT IN (SELECT p FROM kept) ORDER BY ens DESC, doc_id LIMIT 5),
 b AS (SELECT 'kept_low' AS kind, doc_id, ens AS score FROM routed WHERE route IN ('high_quality', 'medium_quality') ORDER BY ens, doc_id LIMIT 5) FROM a UNION ALL FROM b""")
def gen3_error_analysis(spark, sf):
    """The five best dropped documents, told from kept ones by their first 100 characters, and the five worst kept ones."""
    d = P.state(spark, sf).where("reason IS NULL").select("doc_id", F.col("ensemble").alias("score"), F.md5(F.left(T.text_of(F.col("text")), F.lit(100))).alias("p"))
    d = checkpointed(d.withColumn("route", measures.route(F.col("score"))))
    kept = d.where("route IN ('high_quality', 'medium_quality')")
    low = kept.orderBy("score", "doc_id").limit(5).select(F.lit("kept_low").alias("kind"), "doc_id", "score")
    high = d.where("score > 0").join(kept.select("p").distinct(), "p", "left_anti").orderBy(F.desc("score"), "doc_id").limit(5).select(F.lit("dropped_high").alias("kind"), "doc_id", "score")
    return high.unionByName(low)


# ---- stages and profile --------------------------------------------------------------------

_STAGES = ["gen1_input", "gen1_after_lang", "gen1_after_quality", "gen1_output"]
_DEPTH_SQL = "CASE WHEN reason IS NULL THEN 4 WHEN step IN ('url_dedup', 'url_filter', 'lang') THEN 1 WHEN step = 'quality' THEN 2 ELSE 3 END"


@query(f"""WITH {STATE}, sg(k, stage) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(_STAGES, 1))}), {P.tox_sql("base", "doc_id", "t", "txi")}, dp AS (SELECT st.*, {_DEPTH_SQL} AS depth, nullif({S.domain('url')}, '') AS host, txi.toxicity AS tx_score, octet_length(encode(t)) AS bytes FROM st JOIN txi USING (doc_id)),
 m1 AS (SELECT stage, k, count(*) AS n, avg(s_eval) AS qm, quantile_cont(s_eval, 0.5) AS q50, quantile_cont(s_eval, 0.9) AS q90, stddev_pop(s_eval) AS qs, quantile_cont(tx_score, 0.9) AS t90, avg(tx_score) AS tm, avg((tx_score > 0.5)::INT) AS t50, sum(bytes) // 4 AS tokens FROM dp JOIN sg ON depth >= k GROUP BY ALL),
 h_ AS (SELECT stage, host, count(*) AS c FROM dp JOIN sg ON depth >= k WHERE host IS NOT NULL GROUP BY ALL), h50 AS (SELECT *, count(*) OVER (PARTITION BY stage) AS nd FROM h_ QUALIFY row_number() OVER (PARTITION BY stage ORDER BY c DESC, host) <= 50), e_ AS (SELECT stage, any_value(nd) AS nd, -sum(p * log2(p)) AS ent FROM (SELECT stage, nd, c / sum(c) OVER (PARTITION BY stage) AS p FROM h50) GROUP BY stage),
 w_ AS (SELECT depth, {S.words('lower(t)')} AS w FROM dp), gr AS (SELECT depth, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM w_, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
 u_ AS (SELECT stage, n, count(DISTINCT gram) / count(*)::DOUBLE AS r FROM gr JOIN sg ON depth >= k GROUP BY ALL)
 SELECT stage, n::BIGINT AS doc_count, round(n / (SELECT n FROM m1 WHERE k = 1)::DOUBLE, 4) AS retention_rate, round(qm, 4) AS quality_score_mean, round(q50, 4) AS quality_score_p50, round(q90, 4) AS quality_score_p90, round(qs, 4) AS quality_score_std, round(t90, 4) AS toxicity_p90, round(tm, 4) AS toxicity_mean, round(t50, 4) AS toxicity_rate_50,
  round((SELECT r FROM u_ WHERE u_.stage = m1.stage AND u_.n = 1), 4) AS unigram_unique_ratio, round((SELECT r FROM u_ WHERE u_.stage = m1.stage AND u_.n = 2), 4) AS bigram_unique_ratio, round((SELECT r FROM u_ WHERE u_.stage = m1.stage AND u_.n = 3), 4) AS trigram_unique_ratio,
  tokens::BIGINT AS estimated_total_tokens, round(tokens / n::DOUBLE, 1) AS avg_tokens_per_doc, round(ent, 4) AS domain_entropy, coalesce(nd, 0)::BIGINT AS n_unique_domains FROM m1 LEFT JOIN e_ USING (stage)""")
def stage_metrics(spark, sf):
    """The metrics of every stage of the cascade over all its documents, in one pass that reads the texts and one that counts n-grams by the deepest stage of their documents.

    Toxicity is that of the text as it came in; a token is taken for four bytes.
    """
    depth = F.when(F.col("reason").isNull(), 4).when(F.col("step").isin("url_dedup", "url_filter", "lang"), 1).when(F.col("step") == "quality", 2).otherwise(3)
    s = P.annotated(spark, sf).withColumn("depth", depth)
    s = linear.with_scores(s, names=("evaluation",)).withColumn("tox", toxicity.scored(F.col("text"))["toxicity"])
    base = s.select("doc_id", "depth", F.col("score_evaluation").alias("q"), "tox", F.octet_length(T.text_of(F.col("text"))).alias("bytes"), F.nullif(U.domain(F.col("url")), F.lit("")).alias("host"))
    base = checkpointed(base)
    grams = docs(spark, sf, "text").join(base.select("doc_id", "depth"), "doc_id")
    g = grams.select("depth", F.posexplode(measures.hashed_ngrams(F.col("text"), (1, 2, 3))).alias("i", "g")).select("depth", (F.col("i") + 1).alias("n"), F.explode("g").alias("h")).groupBy("n", "h").agg(F.max("depth").alias("top"), *[F.count_if(F.col("depth") >= k).alias(f"c{k}") for k in range(1, 5)])
    g = g.groupBy("n").agg(*[x for k in range(1, 5) for x in (F.count_if(F.col("top") >= k).alias(f"u{k}"), F.sum(f"c{k}").alias(f"c{k}"))])
    ratios = g.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r4(F.col(f"u{k}") / F.nullif(F.col(f"c{k}"), F.lit(0)), "r")) for k in range(1, 5)])).alias("x")).select("n", "x.*").groupBy("k").agg(*[F.max(F.when(F.col("n") == n, F.col("r"))).alias(f"{w}_unique_ratio") for n, w in ((1, "unigram"), (2, "bigram"), (3, "trigram"))])
    at = base.select("*", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("k"))
    q, t = F.col("q"), F.col("tox")
    m = at.groupBy("k").agg(
        F.count("*").alias("doc_count"), r4(F.avg(q), "quality_score_mean"), r4(F.percentile(q, F.lit(0.5)), "quality_score_p50"), r4(F.percentile(q, F.lit(0.9)), "quality_score_p90"), r4(F.stddev_pop(q), "quality_score_std"),
        r4(F.percentile(t, F.lit(0.9)), "toxicity_p90"), r4(F.avg(t), "toxicity_mean"), r4(F.avg((t > 0.5).cast("int")), "toxicity_rate_50"), F.floor(F.sum("bytes") / 4).alias("estimated_total_tokens"),
    )
    # hosts: each stage's fifty most frequent, by a bounded top-k
    h = at.where("host IS NOT NULL").groupBy("k", "host").agg(F.count("*").alias("c"))
    ents = None
    for k in range(1, 5):
        one = measures.entropy(h.where(F.col("k") == k), "host").select(F.lit(k).alias("k"), F.col("entropy").alias("domain_entropy"), F.col("n_keys").alias("n_unique_domains"))
        ents = one if ents is None else ents.unionByName(one)
    first = m.where("k = 1").select(F.col("doc_count").alias("first"))
    out = m.join(F.broadcast(ratios), "k").join(F.broadcast(ents), "k", "left").crossJoin(F.broadcast(first))  # four rows each
    stage = F.element_at(F.array(*[F.lit(s) for s in _STAGES]), F.col("k"))
    return out.select(
        stage.alias("stage"), "doc_count", r4(F.col("doc_count") / F.col("first"), "retention_rate"), "quality_score_mean", "quality_score_p50", "quality_score_p90", "quality_score_std", "toxicity_p90", "toxicity_mean", "toxicity_rate_50",
        "unigram_unique_ratio", "bigram_unique_ratio", "trigram_unique_ratio", "estimated_total_tokens", F.round(F.col("estimated_total_tokens") / F.col("doc_count"), 1).alias("avg_tokens_per_doc"), "domain_entropy", F.coalesce("n_unique_domains", F.lit(0)).alias("n_unique_domains"),
    )


_LONG = "SELECT '{d}' AS dimension, metric, round(value, 4) AS value FROM (UNPIVOT (SELECT {cols} FROM {t}) ON COLUMNS(*) INTO NAME metric VALUE value)"


@query(f"""WITH {S.METRICS}, {P.lang_sql("base", "doc_id")}, {P.tox_sql("base", "doc_id", "t", "tox")}, ev AS (SELECT {S.model("evaluation")} AS q FROM m),
 g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM (SELECT {S.words('lower(t)')} AS w FROM base), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n), gd AS (SELECT n, count(DISTINCT gram) / count(*)::DOUBLE AS r FROM g GROUP BY n),
 h AS (SELECT {S.domain('url')} AS host, count(*) AS c FROM base GROUP BY 1 HAVING {S.domain('any_value(url)')} <> ''), h50 AS (SELECT * FROM h WHERE host <> '' ORDER BY c DESC, host LIMIT 50), he AS (SELECT -sum(p * log2(p)) AS e FROM (SELECT c / sum(c) OVER () AS p FROM h50))
 {_LONG.format(d='scale', cols='count(*)::DOUBLE AS n_docs, sum(n_words)::DOUBLE AS total_words, avg(n_words)::DOUBLE AS avg_words, quantile_cont(n_words, 0.5)::DOUBLE AS median_words', t='m')}
 UNION ALL {_LONG.format(d='quality', cols='avg(q)::DOUBLE AS mean, quantile_cont(q, 0.5)::DOUBLE AS p50, quantile_cont(q, 0.9)::DOUBLE AS p90', t='ev')}
 UNION ALL {_LONG.format(d='language', cols="avg((dl = 'en')::INT)::DOUBLE AS en_ratio, avg(dc)::DOUBLE AS avg_confidence, count(DISTINCT dl)::DOUBLE AS n_languages", t='lg')}
 UNION ALL {_LONG.format(d='toxicity', cols='avg(toxicity)::DOUBLE AS mean, quantile_cont(toxicity, 0.9)::DOUBLE AS p90, avg((toxicity > 0.5)::INT)::DOUBLE AS rate_50', t='tox')}
 UNION ALL SELECT 'diversity', CASE n WHEN 1 THEN 'unigram' WHEN 2 THEN 'bigram' WHEN 3 THEN 'trigram' ELSE '4gram' END, round(r, 4) FROM gd
 UNION ALL SELECT 'diversity', 'domain_entropy', round(e, 4) FROM he""")
def five_dimension_profile(spark, sf):
    """Scale, quality, language, diversity and toxicity of the whole corpus, one measure a row."""
    d = docs(spark, sf, "text", "url")
    s = linear.with_scores(d, names=("evaluation",)).withColumn("l", T.fixed(language.detected(F.col("text")))).withColumn("tox", toxicity.scored(F.col("text"))["toxicity"])
    s = checkpointed(s.select(T.n_words(F.col("text")).alias("w"), F.col("score_evaluation").alias("q"), F.col("l.lang").alias("lang"), F.col("l.conf").alias("conf"), "tox"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    v = lambda c, name: F.round(c.cast("double"), 4).alias(name)
    out = long(s.agg(v(F.count("*"), "n_docs"), v(F.sum("w"), "total_words"), v(F.avg("w"), "avg_words"), v(p("w", 0.5), "median_words")), "scale", "n_docs", "total_words", "avg_words", "median_words")
    out = out.unionByName(long(s.agg(v(F.avg("q"), "mean"), v(p("q", 0.5), "p50"), v(p("q", 0.9), "p90")), "quality", "mean", "p50", "p90"))
    out = out.unionByName(long(s.agg(v(F.avg((F.col("lang") == "en").cast("int")), "en_ratio"), v(F.avg("conf"), "avg_confidence"), v(F.countDistinct("lang"), "n_languages")), "language", "en_ratio", "avg_confidence", "n_languages"))
    out = out.unionByName(long(s.agg(v(F.avg("tox"), "mean"), v(p("tox", 0.9), "p90"), v(F.avg((F.col("tox") > 0.5).cast("int")), "rate_50")), "toxicity", "mean", "p90", "rate_50"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("unigram", "bigram", "trigram", "4gram")]), F.col("n"))
    out = out.unionByName(measures.ngram_diversity(docs(spark, sf, "text")).select(F.lit("diversity").alias("dimension"), names.alias("metric"), F.col("diversity").cast("double").alias("value")))
    hosts = d.select(U.domain(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("c"))
    return out.unionByName(measures.entropy(hosts, "host").select(F.lit("diversity").alias("dimension"), F.lit("domain_entropy").alias("metric"), F.col("entropy").alias("value")))


# ---- classifier reports --------------------------------------------------------------------


@query(f"""WITH {S.SCORED}, x AS (SELECT avg(score) AS m, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90 FROM s) SELECT round(m, 4) AS mean, round(p50, 4) AS p50, round(p90, 4) AS p90, round(p90 - p50, 4) AS spread, CASE WHEN p90 - p50 >= 0.2 THEN 'good' WHEN p90 - p50 >= 0.05 THEN 'warn' ELSE 'bad' END AS spread_band, CASE WHEN p90 >= 0.7 THEN 'good' WHEN p90 >= 0.5 THEN 'warn' ELSE 'bad' END AS top_band FROM x""")
def classifier_health(spark, sf):
    """Spread of the scores and traffic lights for it."""
    s = linear.with_scores(docs(spark, sf, "text"), names=("edu",)).agg(F.avg("score_edu").alias("m"), F.percentile("score_edu", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    p50, p90 = F.col("q")[0], F.col("q")[1]
    band = lambda c, good, warn, name: F.when(c >= good, "good").when(c >= warn, "warn").otherwise("bad").alias(name)
    return s.select(r4(F.col("m"), "mean"), r4(p50, "p50"), r4(p90, "p90"), r4(p90 - p50, "spread"), band(p90 - p50, 0.2, 0.05, "spread_band"), band(p90, 0.7, 0.5, "top_band"))


_PN = f"{S.METRICS.rstrip()}, pn AS (SELECT {S.model('reference')} AS score, n_words, (title IS NOT NULL OR prompt IS NOT NULL) AS pos FROM m)"


def _posneg(spark, sf) -> DataFrame:
    d = linear.with_scores(docs(spark, sf, "text", "title", "prompt"), names=("reference",))
    return checkpointed(d.select(F.col("score_reference").alias("score"), T.n_words(F.col("text")).alias("n_words"), (F.col("title").isNotNull() | F.col("prompt").isNotNull()).alias("pos")))


@query(f"WITH {_PN}, q AS (SELECT quantile_cont(score, 0.25) FILTER (pos) AS p25, quantile_cont(score, 0.75) FILTER (NOT pos) AS n75, quantile_cont(score, 0.9) FILTER (pos) - quantile_cont(score, 0.5) FILTER (pos) AS sp, quantile_cont(score, 0.9) FILTER (NOT pos) - quantile_cont(score, 0.5) FILTER (NOT pos) AS sn FROM pn) SELECT round((count(*) FILTER (pos AND score < n75) + count(*) FILTER (NOT pos AND score > p25)) / count(*)::DOUBLE, 6) AS overlap, round(any_value(sp), 6) AS spread_pos, round(any_value(sn), 6) AS spread_neg, round(avg(score) FILTER (pos) - avg(score) FILTER (NOT pos), 6) AS separation FROM pn, q")
def training_overlap(spark, sf):
    """How far the scores of both training classes overlap."""
    d = _posneg(spark, sf)
    pos, s = F.col("pos"), F.col("score")
    on = lambda c, q: F.percentile(F.when(c, s), F.lit(q))
    q = d.agg(on(pos, 0.25).alias("p25"), on(~pos, 0.75).alias("n75"), (on(pos, 0.9) - on(pos, 0.5)).alias("sp"), (on(~pos, 0.9) - on(~pos, 0.5)).alias("sn"))
    x = d.crossJoin(F.broadcast(q))  # one row
    return x.agg(r6((F.count_if(pos & (s < F.col("n75"))) + F.count_if(~pos & (s > F.col("p25")))) / F.count("*"), "overlap"), r6(F.first("sp"), "spread_pos"), r6(F.first("sn"), "spread_neg"), r6(F.avg(F.when(pos, s)) - F.avg(F.when(~pos, s)), "separation"))


@query(f"""WITH {S.METRICS}, k AS (SELECT CASE WHEN title IS NOT NULL THEN 'abstracts' WHEN prompt IS NOT NULL THEN 'textbook' ELSE 'crawl' END AS kind, n_words FROM m), c AS (SELECT quantile_cont(n_words, 0.9) AS cut, avg(n_words) AS pm FROM k WHERE kind <> 'crawl')
 SELECT kind, round(avg(n_words), 4) AS mean, round(quantile_cont(n_words, 0.5), 4) AS p50, round(quantile_cont(n_words, 0.9), 4) AS p90, round(avg((n_words > cut)::INT), 6) AS beyond_cut, round(avg(n_words) / any_value(pm), 6) AS ratio_to_positives FROM k, c GROUP BY kind""")
def distribution_shift(spark, sf):
    """Lengths of the sources of training texts, how many lie beyond the positives' ninetieth percentile, and their ratio to the positives."""
    kind = F.when(F.col("title").isNotNull(), "abstracts").when(F.col("prompt").isNotNull(), "textbook").otherwise("crawl")
    k = checkpointed(docs(spark, sf, "text", "title", "prompt").select(kind.alias("kind"), T.n_words(F.col("text")).alias("n")))
    c = k.where("kind <> 'crawl'").agg(F.percentile("n", F.lit(0.9)).alias("cut"), F.avg("n").alias("pm"))
    return k.crossJoin(F.broadcast(c)).groupBy("kind").agg(r4(F.avg("n"), "mean"), r4(F.percentile("n", F.lit(0.5)), "p50"), r4(F.percentile("n", F.lit(0.9)), "p90"), r6(F.avg((F.col("n") > F.col("cut")).cast("int")), "beyond_cut"), r6(F.avg("n") / F.first("pm"), "ratio_to_positives"))  # one row


@query("SELECT doc_id, 1 AS label FROM documents WHERE title IS NOT NULL OR prompt IS NOT NULL UNION ALL SELECT doc_id, 0 FROM documents WHERE title IS NULL AND prompt IS NULL AND url IS NOT NULL")
def training_union(spark, sf):
    """Positives and negatives of a classifier together, labelled."""
    d = table(spark, sf, "documents").select("doc_id", "title", "prompt", "url")
    pos = d.where("title IS NOT NULL OR prompt IS NOT NULL").select("doc_id", F.lit(1).alias("label"))
    return pos.unionByName(d.where("title IS NULL AND prompt IS NULL AND url IS NOT NULL").select("doc_id", F.lit(0).alias("label")))


# ---- audits and judgements -----------------------------------------------------------------

_CATEGORY = "split_part(_filter_reason, ':', 1)"
_DETAIL = "split_part(_filter_reason, ':', 2)"


@query(f"WITH r AS (SELECT {_CATEGORY} AS filter_name, rec_id, url, _filter_reason AS filter_reason, translate(left(coalesce(text, ''), 500), chr(10), ' ') AS text_preview, len({S.words('coalesce(text, ' + chr(39) * 2 + ')')})::BIGINT AS text_length_words, count(*) OVER (PARTITION BY {_CATEGORY}) AS total_filtered, row_number() OVER (PARTITION BY {_CATEGORY} ORDER BY md5('42:' || rec_id), rec_id) AS k FROM gen1_rejected WHERE _filter_reason IS NOT NULL) SELECT filter_name, rec_id, text_preview, text_length_words, url, filter_reason, total_filtered::BIGINT AS total_filtered FROM r WHERE k <= 50")
def audit_sample(spark, sf):
    """Fifty rejected rows of each filter, by hash, as a table to be labelled, with the true totals.

    Every task hands on at most fifty rows of a filter (a limit on each group goes before the
    shuffle), so that a filter with a third of all rows is no more work than others.
    """
    g = table(spark, sf, "gen1_rejected").where("_filter_reason IS NOT NULL").withColumn("filter_name", F.split_part("_filter_reason", F.lit(":"), F.lit(1)))
    total = g.groupBy("filter_name").agg(F.count("*").alias("total_filtered"))
    ids = g.select("filter_name", "rec_id").withColumn("r", F.row_number().over(Window.partitionBy("filter_name").orderBy(measures.hash_order(42, "rec_id"), "rec_id"))).where("r <= 50").select("rec_id")
    c = F.col("text")
    rows = g.join(F.broadcast(ids), "rec_id", "left_semi").join(F.broadcast(total), "filter_name")  # fifty rows a filter
    return rows.select("filter_name", "rec_id", T.preview(c).alias("text_preview"), T.n_words(c).cast("bigint").alias("text_length_words"), "url", F.col("_filter_reason").alias("filter_reason"), "total_filtered")


@query(f"WITH d AS (SELECT {_CATEGORY} AS category, {_DETAIL} AS detail, rec_id FROM gen1_rejected WHERE _filter_reason IS NOT NULL), r AS (SELECT *, count(*) OVER (PARTITION BY category, detail) AS n, row_number() OVER (PARTITION BY category, detail ORDER BY rec_id) AS k FROM d) SELECT category, detail, n::BIGINT AS n, rec_id AS example FROM r WHERE k <= 5")
def rule_examples(spark, sf):
    """Up to five examples, those of the least ids, of every reason, with its rows; groups are limited before the shuffle."""
    d = table(spark, sf, "gen1_rejected").where("_filter_reason IS NOT NULL").select(F.split_part("_filter_reason", F.lit(":"), F.lit(1)).alias("category"), F.split_part("_filter_reason", F.lit(":"), F.lit(2)).alias("detail"), "rec_id")
    n = d.groupBy("category", "detail").agg(F.count("*").alias("n"))
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("category", "detail").orderBy("rec_id"))).where("r <= 5")
    return first.join(F.broadcast(n), ["category", "detail"]).select("category", "detail", "n", F.col("rec_id").alias("example"))  # reasons, not rows


@query(f"WITH {S.metrics("SELECT audit_id, filter_name, coalesce(text_preview, '') AS t FROM repetition_filter_audit", 'ab', 'am')}, s AS (SELECT filter_name, {S.model('evaluation')} AS score FROM am) SELECT filter_name, count(*)::BIGINT AS n, (count(*) FILTER (score > 0.7))::BIGINT AS likely_false, round(avg((score > 0.7)::INT), 6) AS false_kill_rate FROM s GROUP BY filter_name")
def estimated_false_kills(spark, sf):
    """Share of audited drops that the independent evaluation finds good."""
    a = linear.with_scores(table(spark, sf, "repetition_filter_audit").select("filter_name", "text_preview"), "text_preview", ("evaluation",))
    bad = F.col("score_evaluation") > 0.7
    return a.groupBy("filter_name").agg(F.count("*").alias("n"), F.count_if(bad).alias("likely_false"), r6(F.avg(bad.cast("int")), "false_kill_rate"))


_JUDGED = "judged AS (SELECT llm_score / 5.0 AS q, CASE WHEN llm_score / 5.0 > 0.7 THEN 'high' WHEN llm_score / 5.0 >= 0.3 THEN 'medium' ELSE 'low' END AS label FROM llm_labels WHERE llm_score IS NOT NULL)"


@query(f"WITH {_JUDGED} SELECT count(*)::BIGINT AS total_evaluated, (count(*) FILTER (label = 'high'))::BIGINT AS high, (count(*) FILTER (label = 'medium'))::BIGINT AS medium, (count(*) FILTER (label = 'low'))::BIGINT AS low, round(avg(q), 3) AS mean_score, round(avg((label = 'high')::INT), 3) AS true_false_kill_rate FROM judged")
def judgement_summary(spark, sf):
    """Judged rows by label, their mean score, and the share of good ones among them; failed judgements are left out."""
    q = F.col("llm_score") / 5.0
    j = table(spark, sf, "llm_labels").where("llm_score IS NOT NULL").select(q.alias("q"), F.when(q > 0.7, "high").when(q >= 0.3, "medium").otherwise("low").alias("label"))
    n = lambda k: F.count_if(F.col("label") == k).alias(k)
    return j.agg(F.count("*").alias("total_evaluated"), n("high"), n("medium"), n("low"), F.round(F.avg("q"), 3).alias("mean_score"), F.round(F.avg((F.col("label") == "high").cast("int")), 3).alias("true_false_kill_rate"))


@query("SELECT count(*)::BIGINT AS total_processed, count(llm_score)::BIGINT AS success_count, (count(*) - count(llm_score))::BIGINT AS error_count, round((count(*) - count(llm_score)) / count(*)::DOUBLE, 4) AS error_rate, count(*) >= 10 AND (count(*) - count(llm_score)) / count(*)::DOUBLE > 0.2 AS stopped_early FROM llm_labels")
def labelling_errors(spark, sf):
    """Failed rows of the labelling, and whether so many would have stopped it."""
    l = table(spark, sf, "llm_labels")  # noqa: E741
    n, bad = F.count("*"), F.count("*") - F.count("llm_score")
    return l.agg(n.alias("total_processed"), F.count("llm_score").alias("success_count"), bad.alias("error_count"), r4(bad / n, "error_rate"), ((n >= 10) & (bad / n > 0.2)).alias("stopped_early"))


@query(f"WITH t AS (SELECT octet_length(encode(coalesce(text, ''))) // 4 AS k FROM documents ORDER BY doc_id LIMIT 1000) SELECT round(avg(k), 4) AS mean_tokens, floor(avg(k) * (SELECT count(*) FROM documents))::BIGINT AS estimated_total FROM t")
def token_total(spark, sf):
    """Estimated tokens of the table, from the mean of its first thousand rows by id: the head is the estimate's own definition; ``stage_metrics`` sums over all."""
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.octet_length(T.text_of(F.col("text"))) / 4).alias("k"))
    n = d.agg(F.count("*").alias("n"))
    return d.orderBy("doc_id").limit(1000).agg(F.avg("k").alias("m")).crossJoin(F.broadcast(n)).select(r4(F.col("m"), "mean_tokens"), F.floor(F.col("m") * F.col("n")).alias("estimated_total"))  # one row


@query("WITH a AS (SELECT CASE WHEN _lang_confidence < 0.5 THEN 'uncertain' ELSE coalesce(nullif(regexp_extract(lower(trim(_detected_lang)), '^([a-z]+)', 1), ''), 'unknown') END AS lang, 'output' AS side FROM gen1_output UNION ALL SELECT CASE WHEN _lang_confidence < 0.5 THEN 'uncertain' ELSE coalesce(nullif(regexp_extract(lower(trim(_detected_lang)), '^([a-z]+)', 1), ''), 'unknown') END, 'rejected' FROM gen1_rejected) SELECT lang, (count(*) FILTER (side = 'output'))::BIGINT AS output, (count(*) FILTER (side = 'rejected'))::BIGINT AS rejected FROM a GROUP BY lang ORDER BY output DESC, lang LIMIT 15")
def languages_side_by_side(spark, sf):
    """The fifteen most frequent languages of the output beside those of the rejected rows."""
    code = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("_detected_lang")), "^([a-z]+)", 1), F.lit("")), F.lit("unknown"))
    lang = F.when(F.col("_lang_confidence") < 0.5, "uncertain").otherwise(code).alias("lang")
    a = table(spark, sf, "gen1_output").select(lang, F.lit("output").alias("side")).unionByName(table(spark, sf, "gen1_rejected").select(lang, F.lit("rejected").alias("side")))
    n = lambda k: F.count_if(F.col("side") == k).alias(k)
    return a.groupBy("lang").agg(n("output"), n("rejected")).orderBy(F.desc("output"), "lang").limit(15)


@query(f"WITH k AS (SELECT {P._TEXT_KEY} AS k, nullif({S.domain('url')}, '') AS host FROM gen1_output), g AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1) SELECT host, count(*)::BIGINT AS n FROM k SEMI JOIN g USING (k) WHERE host IS NOT NULL GROUP BY host ORDER BY n DESC, host LIMIT 10")
def duplicate_domains(spark, sf):
    """The ten hosts with the most rows among copies of a content."""
    from gristmill.operators import dedup

    return dedup.top_domains(table(spark, sf, "gen1_output").select("text", "url"), dedup.content_key(F.col("text")), F.col("url"))


# ---- golden samples ------------------------------------------------------------------------

_GOLDEN = rf"""{STATE}, cutg AS (SELECT quantile_cont(s_edu, 0.9) AS threshold FROM st WHERE reason IS NULL), st2 AS (SELECT *, reason IS NULL AND s_edu >= threshold AS in_gen2 FROM st, cutg),
 golden AS (SELECT * FROM (SELECT doc_id, 'high_quality' AS category, 'pass_all' AS expected FROM st2 WHERE in_gen2 ORDER BY s_eval DESC, doc_id LIMIT 3)
  UNION ALL FROM (SELECT doc_id, 'low_quality', 'filter_gen1' FROM st2 WHERE reason IS NOT NULL ORDER BY s_eval, doc_id LIMIT 3)
  UNION ALL FROM (SELECT doc_id, 'boundary', 'borderline' FROM st2 WHERE reason IS NULL ORDER BY s_eval, doc_id LIMIT 2)
  UNION ALL FROM (SELECT doc_id, 'boundary', 'filter_gen2' FROM st2 WHERE reason IS NULL AND NOT in_gen2 ORDER BY s_eval DESC, doc_id LIMIT 2))"""


def _golden(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(rows of all documents with their steps; the ten samples)."""
    s = scored_state(spark, sf).select("doc_id", "step", "reason", "score_edu", F.col("score_evaluation").alias("e"))
    cut = s.where("reason IS NULL").agg(F.percentile("score_edu", F.lit(0.9)).alias("t"))
    s = s.crossJoin(F.broadcast(cut)).withColumn("in_gen2", F.col("reason").isNull() & (F.col("score_edu") >= F.col("t")))  # one row
    pick = lambda cond, order, n, cat, exp: s.where(cond).orderBy(order, "doc_id").limit(n).select("doc_id", F.lit(cat).alias("category"), F.lit(exp).alias("expected"))
    out = pick("in_gen2", F.desc("e"), 3, "high_quality", "pass_all").unionByName(pick("reason IS NOT NULL", F.asc("e"), 3, "low_quality", "filter_gen1"))
    return s, out.unionByName(pick("reason IS NULL", F.asc("e"), 2, "boundary", "borderline")).unionByName(pick("reason IS NULL AND NOT in_gen2", F.desc("e"), 2, "boundary", "filter_gen2"))


@query(f"WITH {_GOLDEN} SELECT * FROM golden")
def golden_samples(spark, sf):
    """Ten samples: the best of the second generation, the worst of what was dropped, and cases at the boundary."""
    return _golden(spark, sf)[1]


_STAGE_ORDER = ["url_dedup", "url_filter", "lang", "quality", "repetition", "pii_density", "toxicity", "gen2"]
_VERDICT = "CASE WHEN expected = 'borderline' THEN 'info' WHEN (expected = 'pass_all') = (filtered_at IS NULL) THEN 'pass' ELSE 'fail' END"
_GOLDEN_RUN = f"{_GOLDEN}, run AS (SELECT g.doc_id, category, expected, coalesce(step, CASE WHEN NOT in_gen2 THEN 'gen2' END) AS filtered_at FROM golden g JOIN st2 USING (doc_id)), vd AS (SELECT *, {_VERDICT} AS verdict FROM run)"


def _verdicts(spark, sf, without: str | None = None) -> DataFrame:
    """``doc_id, category, expected, filtered_at, verdict``; ``without`` leaves a step out, as an earlier run might."""
    s, g = _golden(spark, sf)
    step = F.col("step") if without is None else F.when(F.col("step") != without, F.col("step"))
    at = F.coalesce(step, F.when(~F.col("in_gen2"), "gen2"))
    run = s.join(F.broadcast(g), "doc_id").select("doc_id", "category", "expected", at.alias("filtered_at"))  # ten rows
    v = F.when(F.col("expected") == "borderline", "info").when((F.col("expected") == "pass_all") == F.col("filtered_at").isNull(), "pass").otherwise("fail")
    return run.withColumn("verdict", v)


@query(f"WITH {_GOLDEN_RUN} SELECT doc_id, category, expected, filtered_at, verdict FROM vd")
def golden_verdicts(spark, sf):
    """For each sample the first stage that drops it, and whether that is what was expected."""
    return _verdicts(spark, sf)


@query(f"WITH {_GOLDEN_RUN} SELECT category, (count(*) FILTER (verdict = 'pass'))::BIGINT AS n_pass, (count(*) FILTER (verdict = 'fail'))::BIGINT AS n_fail, (count(*) FILTER (verdict = 'info'))::BIGINT AS n_info, round((count(*) FILTER (verdict = 'pass')) / nullif(count(*) FILTER (verdict IN ('pass', 'fail')), 0)::DOUBLE, 4) AS pass_rate FROM vd GROUP BY category")
def golden_summary(spark, sf):
    n = lambda k: F.count_if(F.col("verdict") == k)
    return _verdicts(spark, sf).groupBy("category").agg(n("pass").alias("n_pass"), n("fail").alias("n_fail"), n("info").alias("n_info"), r4(n("pass") / F.nullif(n("pass") + n("fail"), F.lit(0)), "pass_rate"))


@query(f"WITH {_GOLDEN_RUN}, sg(k, stage) AS (VALUES {', '.join(f'({i}, ' + repr(s) + ')' for i, s in enumerate(_STAGE_ORDER))}), pos AS (SELECT doc_id, coalesce(k, 99) AS at FROM run LEFT JOIN sg ON stage = filtered_at) SELECT stage, (count(*) FILTER (\"at\" >= k))::BIGINT AS in_input, (count(*) FILTER (\"at\" > k))::BIGINT AS survived, (count(*) FILTER (\"at\" = k))::BIGINT AS filtered FROM sg, pos GROUP BY stage")
def golden_stages(spark, sf):
    """How many samples reach, survive and fall at every stage."""
    names = F.array(*[F.lit(s) for s in _STAGE_ORDER])
    at = F.coalesce(F.nullif(F.array_position(names, F.col("filtered_at")), F.lit(0)), F.lit(100))
    v = _verdicts(spark, sf).select(at.alias("at"), F.posexplode(names).alias("k", "stage"))
    k = F.col("k") + 1
    return v.groupBy("stage").agg(F.count_if(F.col("at") >= k).alias("in_input"), F.count_if(F.col("at") > k).alias("survived"), F.count_if(F.col("at") == k).alias("filtered"))


@query(f"WITH {_GOLDEN_RUN}, old AS (SELECT g.doc_id, category, expected, coalesce(nullif(step, 'quality'), CASE WHEN NOT in_gen2 THEN 'gen2' END) AS filtered_at FROM golden g JOIN st2 USING (doc_id)), ov AS (SELECT doc_id, {_VERDICT} AS verdict FROM old) SELECT vd.doc_id, ov.verdict AS previous, vd.verdict AS current, CASE WHEN ov.verdict = 'pass' AND vd.verdict = 'fail' THEN 'regression' WHEN ov.verdict = 'fail' AND vd.verdict = 'pass' THEN 'improvement' ELSE 'unchanged' END AS change FROM vd JOIN ov USING (doc_id)")
def golden_regressions(spark, sf):
    """Verdicts against those of a run without the quality step; samples that one of both lacks are left out."""
    now = _verdicts(spark, sf).select("doc_id", F.col("verdict").alias("current"))
    old = _verdicts(spark, sf, without="quality").select("doc_id", F.col("verdict").alias("previous"))
    change = F.when((F.col("previous") == "pass") & (F.col("current") == "fail"), "regression").when((F.col("previous") == "fail") & (F.col("current") == "pass"), "improvement").otherwise("unchanged")
    return now.join(F.broadcast(old), "doc_id").select("doc_id", "previous", "current", change.alias("change"))  # ten rows


# ---- language models -----------------------------------------------------------------------

_PAIRS = rf"""tok AS (SELECT doc_id, {S.words("lower(coalesce(text, ''))")} AS w, title IS NOT NULL OR prompt IS NOT NULL AS ref FROM documents), uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM tok WHERE ref) GROUP BY 1), tot AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*) AS v FROM uni),
 pr AS (SELECT doc_id, ref, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1]))) AS p FROM tok WHERE len(w) > 1), bi AS (SELECT p, count(*) AS c FROM pr WHERE ref GROUP BY 1), head AS (SELECT p.a AS a, sum(c) AS c FROM bi GROUP BY 1),
 lp AS (SELECT pr.doc_id, ln(0.7 * coalesce(bi.c, 0) / greatest(coalesce(head.c, 0), 1) + 0.3 * (coalesce(uni.c, 0) + 1) / (n + v + 1)) AS l FROM pr LEFT JOIN bi ON bi.p = pr.p LEFT JOIN head ON head.a = pr.p.a LEFT JOIN uni ON uni.w = pr.p.b, tot),
 pp AS (SELECT tok.doc_id, round(CASE WHEN len(any_value(tok.w)) >= 5 THEN exp(-avg(l)) END, 3) AS ppl FROM tok LEFT JOIN lp USING (doc_id) GROUP BY tok.doc_id)"""


def _perplexity(spark, sf) -> DataFrame:
    d = docs(spark, sf, "text", "title", "prompt")
    return lm.bigram_perplexity(d.where("title IS NOT NULL OR prompt IS NOT NULL"), d, "doc_id").select("doc_id", F.round("ppl", 3).alias("ppl"))


@query(f"WITH {_PAIRS} SELECT doc_id, ppl FROM pp")
def bigram_perplexity(spark, sf):
    """Perplexity of every document under smoothed pairs of words of the reference texts; null for fewer than five words."""
    return _perplexity(spark, sf)


_PPL_QS = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query(f"WITH {_PAIRS} SELECT round(avg(ppl), 2) AS mean, {', '.join(f'round(quantile_cont(ppl, {q}), 2) AS {k}' for k, q in _PPL_QS.items())}, count(ppl)::BIGINT AS n_valid, (count(*) - count(ppl))::BIGINT AS n_inf FROM pp")
def perplexity_statistics(spark, sf):
    p = checkpointed(_perplexity(spark, sf))
    return p.agg(F.round(F.avg("ppl"), 2).alias("mean"), *[F.round(F.percentile("ppl", F.lit(q)), 2).alias(k) for k, q in _PPL_QS.items()], F.count("ppl").alias("n_valid"), (F.count("*") - F.count("ppl")).alias("n_inf"))


@query(f"WITH {_PAIRS}, b AS (SELECT CASE WHEN ppl < 300 THEN 'head' WHEN ppl < 1000 THEN 'middle' ELSE 'tail' END AS bucket, count(*) AS n FROM pp WHERE ppl IS NOT NULL GROUP BY 1) SELECT bucket, n::BIGINT AS n, round(n / (SELECT sum(n) FROM b), 6) AS ratio FROM b")
def perplexity_bucket_ratios(spark, sf):
    p = F.col("ppl")
    b = _perplexity(spark, sf).where("ppl IS NOT NULL").groupBy(F.when(p < 300, "head").when(p < 1000, "middle").otherwise("tail").alias("bucket")).agg(F.count("*").alias("n"))
    b = checkpointed(b)
    return b.crossJoin(F.broadcast(b.agg(F.sum("n").alias("t")))).select("bucket", "n", r6(F.col("n") / F.col("t"), "ratio"))  # three rows


@query(f"WITH {_PAIRS}, k AS (SELECT doc_id, ppl, CASE WHEN ppl < 10 THEN 'too_low' WHEN ppl > 5000 THEN 'too_high' END AS kind FROM pp), r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS r FROM k WHERE kind IS NOT NULL) SELECT kind, n::BIGINT AS n, doc_id, ppl FROM r WHERE r <= 5")
def perplexity_anomalies(spark, sf):
    """How many perplexities are suspiciously low or high, and the five first documents of each."""
    p = F.col("ppl")
    k = checkpointed(_perplexity(spark, sf).withColumn("kind", F.when(p < 10, "too_low").when(p > 5000, "too_high")).where("kind IS NOT NULL"))
    n = k.groupBy("kind").agg(F.count("*").alias("n"))
    first = k.where("kind = 'too_low'").orderBy("doc_id").limit(5).unionByName(k.where("kind = 'too_high'").orderBy("doc_id").limit(5))
    return first.join(F.broadcast(n), "kind").select("kind", "n", "doc_id", "ppl")  # two rows


@query(f"WITH {GENERATIONS}, {_PAIRS.replace('head AS', 'hd AS').replace('head.', 'hd.').replace('JOIN head', 'JOIN hd').replace('tot AS', 'tt AS').replace(', tot)', ', tt)')}, md AS (SELECT gen, quantile_cont(ppl, 0.5) AS m, count(ppl) AS k FROM gen JOIN pp USING (doc_id) WHERE NOT is_synthetic GROUP BY gen) SELECT gen, k::BIGINT AS n, round(m, 2) AS median, round((1 - m / (SELECT m FROM md WHERE gen = 'raw')) * 100, 2) AS reduction FROM md")
def perplexity_reduction(spark, sf):
    """Median perplexity of the documents of each generation under the same reference model, and how much lower than that of the input; rewritten texts are left out."""
    g = generations(scored_state(spark, sf)).where("NOT is_synthetic").select("gen", "doc_id").join(_perplexity(spark, sf), "doc_id")
    m = checkpointed(g.groupBy("gen").agg(F.percentile("ppl", F.lit(0.5)).alias("m"), F.count("ppl").alias("n")))
    raw = m.where("gen = 'raw'").select(F.col("m").alias("rm"))
    return m.crossJoin(F.broadcast(raw)).select("gen", "n", F.round("m", 2).alias("median"), F.round((1 - F.col("m") / F.col("rm")) * 100, 2).alias("reduction"))  # one row


@query(rf"""WITH {_PAIRS}, it AS (SELECT item_id, answer AS t, TRUE AS correct FROM eval_items UNION ALL SELECT item_id, unnest(wrong_answers), FALSE FROM eval_items), iw AS (SELECT item_id, correct, row_number() OVER () AS a, {S.words("lower(coalesce(t, ''))")} AS w FROM it),
 ip AS (SELECT item_id, correct, a, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1]))) AS p FROM iw WHERE len(w) > 1),
 il AS (SELECT item_id, correct, ip.a, avg(ln(0.7 * coalesce(bi.c, 0) / greatest(coalesce(head.c, 0), 1) + 0.3 * (coalesce(uni.c, 0) + 1) / (n + v + 1))) AS l FROM ip LEFT JOIN bi ON bi.p = ip.p LEFT JOIN head ON head.a = ip.p.a LEFT JOIN uni ON uni.w = ip.p.b, tot GROUP BY ALL),
 r AS (SELECT item_id, max(l) FILTER (correct) AS good, max(l) FILTER (NOT correct) AS bad FROM il GROUP BY item_id) SELECT suite, count(*)::BIGINT AS n, round(avg((good > bad)::INT), 4) AS accuracy FROM r JOIN eval_items USING (item_id) WHERE good IS NOT NULL AND bad IS NOT NULL GROUP BY suite""")
def completion_accuracy(spark, sf):
    """How often a model of the reference texts finds the right completion likelier, for each of its pairs of words, than every wrong one."""
    d = docs(spark, sf, "text", "title", "prompt").where("title IS NOT NULL OR prompt IS NOT NULL")
    items = table(spark, sf, "eval_items")
    a = items.select("item_id", F.col("answer").alias("text"), F.lit(True).alias("correct"), F.lit(-1).alias("k"))
    b = items.select("item_id", F.posexplode("wrong_answers").alias("k", "text")).select("item_id", "text", F.lit(False).alias("correct"), "k")
    rows = a.unionByName(b).withColumn("id", F.concat_ws(":", "item_id", "k"))
    lp = lm.bigram_perplexity(d, rows.select("id", "text"), "id", min_tokens=2)
    r = rows.select("id", "item_id", "correct").join(lp, "id").groupBy("item_id").agg(F.min(F.when(F.col("correct"), F.col("ppl"))).alias("good"), F.min(F.when(~F.col("correct"), F.col("ppl"))).alias("bad"))
    return r.where("good IS NOT NULL AND bad IS NOT NULL").join(items.select("item_id", "suite"), "item_id").groupBy("suite").agg(F.count("*").alias("n"), r4(F.avg((F.col("good") < F.col("bad")).cast("int")), "accuracy"))


# ---- samples, corpora and Chinese scores ---------------------------------------------------


@query("WITH k AS (SELECT rec_id, url, segment, length(coalesce(text, '')) AS n, CASE WHEN trim(coalesce(url, '')) = '' THEN 'id:' || rec_id ELSE lower(trim(url)) END AS u FROM gen1_output WHERE length(coalesce(text, '')) >= 50), s AS (SELECT DISTINCT segment FROM gen1_output WHERE segment IS NOT NULL ORDER BY md5('42:' || segment), segment LIMIT 5), f AS (SELECT min_by(rec_id, md5('42:' || rec_id)) AS rec_id FROM k SEMI JOIN s USING (segment) GROUP BY u) SELECT rec_id FROM f ORDER BY md5('42:' || rec_id), rec_id LIMIT 200")
def crawl_sample(spark, sf):
    """A seeded sample of a crawl: five segments, one row for each address, shuffled by hash, trimmed to 200."""
    g = table(spark, sf, "gen1_output").select("rec_id", "url", "segment", F.length(T.text_of(F.col("text"))).alias("n"))
    s = g.where("segment IS NOT NULL").select("segment").distinct().orderBy(measures.hash_order(42, "segment"), "segment").limit(5)
    u = F.when(F.trim(T.text_of(F.col("url"))) == "", F.concat(F.lit("id:"), F.col("rec_id"))).otherwise(F.lower(F.trim("url")))
    k = g.where("n >= 50").join(F.broadcast(s), "segment", "left_semi").groupBy(u.alias("u")).agg(F.min_by("rec_id", measures.hash_order(42, "rec_id")).alias("rec_id"))  # five rows
    return k.select("rec_id").orderBy(measures.hash_order(42, "rec_id"), "rec_id").limit(200)


@query(f"WITH a AS (SELECT doc_id, title, {S.strip('string_split(text, chr(10) || chr(10))[1]')} AS abstract FROM documents WHERE title IS NOT NULL) SELECT doc_id, title, abstract FROM a WHERE length(abstract) > 100")
def encyclopedia_abstracts(spark, sf):
    """First paragraphs of encyclopedia articles, if longer than 100 characters."""
    a = table(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", "title", T.strip(F.split(F.col("text"), "\n\n")[0]).alias("abstract"))
    return a.where(F.length("abstract") > 100)


@query(f"SELECT doc_id, prompt, length({S.strip('text')})::BIGINT AS n_chars FROM documents WHERE prompt IS NOT NULL AND length({S.strip('text')}) > 200")
def textbook_samples(spark, sf):
    """Textbook samples longer than 200 characters."""
    d = table(spark, sf, "documents").where("prompt IS NOT NULL").select("doc_id", "prompt", F.length(T.strip(F.col("text"))).cast("bigint").alias("n_chars"))
    return d.where("n_chars > 200")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200")
def head_documents(spark, sf):
    """The first 200 documents by id."""
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(200)


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i::BIGINT AS i FROM o WHERE i % greatest(1, n // 200) = 0")
def downsampled_curve(spark, sf):
    """Every k-th point of a long curve, so that about 200 remain, by place in the order of ids; ranks come from range partitions, not from one window."""
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = table(spark, sf, "documents").select("doc_id").repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("r"))
    d = checkpointed(d)
    per = d.groupBy("r").agg(F.count("*").alias("k"))
    base = per.select("r", (F.sum("k").over(Window.orderBy("r")) - F.col("k")).alias("base"), F.sum("k").over(Window.partitionBy()).alias("n"))  # one row for each partition
    i = F.row_number().over(Window.partitionBy("r").orderBy("doc_id")) - 1 + F.col("base")
    return d.join(F.broadcast(base), "r").select("doc_id", i.alias("i"), "n").where("i % greatest(1, floor(n / 200)) = 0").select("doc_id", F.col("i").cast("bigint").alias("i"))
