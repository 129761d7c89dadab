"""Queries that measure classifiers, audits, stages and language models."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import lm, measures
from gristmill.operators.components import checkpointed
from gristmill.plans import sqlparts as S
from gristmill.plans.curation import scored
from gristmill.plans.rules import docs, r6
from gristmill.scorers import ensemble, linear
from gristmill.scorers import quality as clf
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


_LABEL = "CASE trim(human_label) WHEN '0' THEN 0 WHEN '1' THEN 1 END"


@query(f"""WITH a AS (SELECT filter_name, {_LABEL} AS y FROM repetition_filter_audit), g AS (SELECT filter_name, count(*) AS n, count(y) AS labeled, count(*) FILTER (y = 0) AS correct FROM a GROUP BY 1)
 SELECT filter_name, n::BIGINT AS n, labeled::BIGINT AS labeled, correct::BIGINT AS correct, (labeled - correct)::BIGINT AS false_kills, round(correct / labeled::DOUBLE, 6) AS precision FROM g WHERE labeled > 0""")
def audit_precision(spark, sf):
    """Share of audited drops that people found right; unlabelled filters are left out."""
    y = F.when(F.trim("human_label") == "0", 0).when(F.trim("human_label") == "1", 1)
    g = table(spark, sf, "repetition_filter_audit").groupBy("filter_name").agg(F.count("*").alias("n"), F.count(y).alias("labeled"), F.count_if(y == 0).alias("correct"))
    return g.where("labeled > 0").select("filter_name", "n", "labeled", "correct", (F.col("labeled") - F.col("correct")).alias("false_kills"), r6(F.col("correct") / F.col("labeled"), "precision"))


@query("SELECT llm_score, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM llm_labels)::DOUBLE, 6) AS rate FROM llm_labels GROUP BY llm_score")
def label_statistics(spark, sf):
    l = table(spark, sf, "llm_labels")  # noqa: E741
    total = l.agg(F.count("*").alias("t"))
    return l.groupBy("llm_score").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("llm_score", "n", r6(F.col("n") / F.col("t"), "rate"))


@query("""WITH g AS (SELECT split_part(_filter_reason, ':', 1) AS category, split_part(_filter_reason, ':', 2) AS detail, count(*) AS n FROM gen1_rejected GROUP BY ALL), w AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY category) AS step FROM g)
 SELECT category, detail, n::BIGINT AS n, round(n / total, 6) AS of_all, round(n / step, 6) AS of_step FROM w ORDER BY n DESC, category, detail LIMIT 100""")
def filter_contribution(spark, sf):
    """The hundred most frequent reasons with their shares of all drops and of the step's."""
    p = lambda k: F.split_part("_filter_reason", F.lit(":"), F.lit(k))
    g = table(spark, sf, "gen1_rejected").groupBy(p(1).alias("category"), p(2).alias("detail")).agg(F.count("*").alias("n"))
    step = g.groupBy("category").agg(F.sum("n").alias("step"))
    out = g.join(F.broadcast(step), g["category"].eqNullSafe(step["category"])).drop(step["category"]).crossJoin(F.broadcast(g.agg(F.sum("n").alias("total"))))  # reasons, not rows
    return out.orderBy(F.desc("n"), "category", "detail").limit(100).select("category", "detail", "n", r6(F.col("n") / F.col("total"), "of_all"), r6(F.col("n") / F.col("step"), "of_step"))


@query("""WITH o AS (SELECT segment, stage, max(doc_count) AS n, CASE stage WHEN 'gen1_input' THEN 1 WHEN 'gen1_after_lang' THEN 2 WHEN 'gen1_after_quality' THEN 3 WHEN 'gen1_output' THEN 4 END AS k FROM gen1_stage_metrics WHERE doc_count IS NOT NULL AND segment IS NOT NULL GROUP BY ALL)
 SELECT segment, stage, n, round(n / nullif(first_value(n) OVER (PARTITION BY segment ORDER BY k), 0)::DOUBLE, 6) AS retention FROM o""")
def stage_retention(spark, sf):
    """Documents of every stage against the first stage of the segment; of repeated reports the greatest count."""
    order = F.when(F.col("stage") == "gen1_input", 1).when(F.col("stage") == "gen1_after_lang", 2).when(F.col("stage") == "gen1_after_quality", 3).when(F.col("stage") == "gen1_output", 4)
    o = table(spark, sf, "gen1_stage_metrics").where("doc_count IS NOT NULL AND segment IS NOT NULL").groupBy("segment", "stage").agg(F.max("doc_count").alias("n"))
    return o.select("segment", "stage", "n", r6(F.col("n") / F.nullif(F.first("n").over(Window.partitionBy("segment").orderBy(order)), F.lit(0)), "retention"))


_TOX = "FROM gen1_output WHERE _toxicity_score IS NOT NULL"


@query(f"SELECT count(*)::BIGINT AS n, round(avg(_toxicity_score), 6) AS mean, round(quantile_cont(_toxicity_score, 0.5), 6) AS p50, round(quantile_cont(_toxicity_score, 0.9), 6) AS p90, round(quantile_cont(_toxicity_score, 0.95), 6) AS p95, round(quantile_cont(_toxicity_score, 0.99), 6) AS p99, round(avg((_toxicity_score > 0.5)::INT), 6) AS rate_50, round(avg((_toxicity_score > 0.8)::INT), 6) AS rate_80 {_TOX}")
def toxicity_statistics(spark, sf):
    x = F.col("_toxicity_score")
    return table(spark, sf, "gen1_output").where("_toxicity_score IS NOT NULL").agg(F.count("*").alias("n"), r6(F.avg(x), "mean"), *measures.distribution(x, (0.5, 0.9, 0.95, 0.99)), r6(F.avg((x > 0.5).cast("int")), "rate_50"), r6(F.avg((x > 0.8).cast("int")), "rate_80"))


@query(f"WITH t AS (SELECT unnest([0.3, 0.5, 0.7, 0.85, 0.9, 0.95])::DOUBLE AS threshold), x AS (SELECT _toxicity_score AS x {_TOX}) SELECT threshold, (count(*) FILTER (x > threshold))::BIGINT AS n_toxic, round(avg((x > threshold)::INT), 6) AS rate FROM x, t GROUP BY threshold")
def toxicity_sweep(spark, sf):
    x = F.col("_toxicity_score")
    cuts = [0.3, 0.5, 0.7, 0.85, 0.9, 0.95]
    one = table(spark, sf, "gen1_output").where("_toxicity_score IS NOT NULL").agg(F.array(*[F.struct(F.lit(c).alias("threshold"), F.count_if(x > c).alias("n_toxic"), r6(F.avg((x > c).cast("int")), "rate")) for c in cuts]).alias("a"))
    return one.select(F.explode("a").alias("x")).select("x.*")


_G = f"""{S.metrics("SELECT rec_id, coalesce(text, '') AS t FROM gen1_output", "g", "gm").strip()}, gs AS (SELECT rec_id, n_words, {S.model("edu")} AS score FROM gm),
 lb AS (SELECT rec_id, max(llm_score) AS s FROM llm_labels WHERE llm_score IS NOT NULL GROUP BY 1), ev AS (SELECT gs.rec_id, score, n_words, (s >= 3)::INT AS y FROM gs JOIN lb USING (rec_id))"""


def _labelled(spark, sf):
    l = table(spark, sf, "llm_labels").where("llm_score IS NOT NULL").groupBy("rec_id").agg((F.max("llm_score") >= 3).cast("int").alias("y"))  # noqa: E741
    g = spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id").join(l, "rec_id").withColumn("n_words", T.n_words(F.col("text")))
    return checkpointed(linear.with_scores(g, names=("edu",)).select("rec_id", "n_words", "y", F.col("score_edu").alias("score")))


@query(f"""WITH {_G}, b AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM ev GROUP BY 1), r AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, (SELECT sum(p) FROM b) AS np, (SELECT sum(q) FROM b) AS nq FROM b WINDOW w AS (ORDER BY score DESC)),
 s AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, coalesce(lag(tp / (tp + fp)::DOUBLE) OVER (ORDER BY score DESC), 1.0) AS last FROM r)
 SELECT round(sum(q * (tp - p / 2.0)) / (max(np) * max(nq)), 6) AS roc_auc, round(sum(p / np::DOUBLE * (pr + last) / 2), 6) AS pr_auc, max(np)::BIGINT AS n_pos, max(nq)::BIGINT AS n_neg FROM s""")
def classifier_auc(spark, sf):
    return measures.auc(_labelled(spark, sf), "score", "y")


@query(f"WITH {_G}, c AS (SELECT quantile_cont(score, 0.9) AS t FROM ev) SELECT round(avg(y) FILTER (score >= t), 6) AS precision_top10, round(avg(score) FILTER (y = 1), 6) AS mean_pos, round(avg(score) FILTER (y = 0), 6) AS mean_neg, round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 6) AS separation, round(avg((score BETWEEN 0.4 AND 0.6)::INT) FILTER (y = 1), 6) AS ambiguous_pos, round(avg((score BETWEEN 0.4 AND 0.6)::INT) FILTER (y = 0), 6) AS ambiguous_neg FROM ev, c")
def classifier_separation(spark, sf):
    e = _labelled(spark, sf)
    e = e.crossJoin(F.broadcast(e.agg(F.percentile("score", F.lit(0.9)).alias("t"))))  # one row
    on = lambda cond, x: F.avg(F.when(cond, x))
    mid = F.col("score").between(0.4, 0.6).cast("int")
    pos, neg = F.col("y") == 1, F.col("y") == 0
    return e.agg(r6(on(F.col("score") >= F.col("t"), F.col("y")), "precision_top10"), r6(on(pos, F.col("score")), "mean_pos"), r6(on(neg, F.col("score")), "mean_neg"), r6(on(pos, F.col("score")) - on(neg, F.col("score")), "separation"), r6(on(pos, mid), "ambiguous_pos"), r6(on(neg, mid), "ambiguous_neg"))


@query(f"WITH {_G}, q AS (SELECT avg(n_words) FILTER (y = 1) AS mp, avg(n_words) FILTER (y = 0) AS mn, quantile_cont(n_words, [0.9, 0.95]) FILTER (y = 1) AS qp, quantile_cont(n_words, [0.9, 0.95]) FILTER (y = 0) AS qn FROM ev), r AS (SELECT *, greatest(mp, mn) / least(mp, mn) AS ratio, CASE WHEN mp >= mn THEN qn ELSE qp END AS s, CASE WHEN mp >= mn THEN 'positive' ELSE 'negative' END AS longer FROM q) SELECT longer, round(ratio, 6) AS ratio, (CASE WHEN ratio > 3 THEN greatest(100, floor(s[1])) WHEN ratio > 2 THEN greatest(100, floor(s[2])) END)::BIGINT AS max_words FROM r")
def adaptive_truncation(spark, sf):
    """The class to be cut and the length to cut it to, where lengths differ too much."""
    on = lambda y, f: f(F.when(F.col("y") == y, F.col("n_words")))
    qs = F.array(F.lit(0.9), F.lit(0.95))
    q = _labelled(spark, sf).agg(on(1, F.avg).alias("mp"), on(0, F.avg).alias("mn"), on(1, lambda c: F.percentile(c, qs)).alias("qp"), on(0, lambda c: F.percentile(c, qs)).alias("qn"))
    r = q.withColumn("ratio", F.greatest("mp", "mn") / F.least("mp", "mn")).withColumn("s", F.when(F.col("mp") >= F.col("mn"), F.col("qn")).otherwise(F.col("qp")))
    cut = lambda k: F.greatest(F.lit(100), F.floor(F.col("s")[k]))
    return r.select(F.when(F.col("mp") >= F.col("mn"), "positive").otherwise("negative").alias("longer"), r6(F.col("ratio"), "ratio"), F.when(F.col("ratio") > 3, cut(0)).when(F.col("ratio") > 2, cut(1)).cast("bigint").alias("max_words"))


@query(f"WITH {S.SCORED}, c AS (SELECT quantile_cont(score, 0.9) AS t FROM s), f AS (SELECT doc_id, score, n_words, score >= c.t AS kept, abs(score - c.t) < 0.05 AS near FROM s, c) SELECT (count(*) FILTER (near))::BIGINT AS n_boundary, round(avg(n_words) FILTER (near), 6) AS words_inside, round(avg(n_words) FILTER (NOT near), 6) AS words_outside, (count(*) FILTER (kept))::BIGINT AS n_kept FROM f")
def boundary_band(spark, sf):
    s = checkpointed(scored(spark, sf).select("score", "n_words"))
    s = s.crossJoin(F.broadcast(s.agg(F.percentile("score", F.lit(0.9)).alias("t"))))  # one row
    near = F.abs(F.col("score") - F.col("t")) < 0.05
    return s.agg(F.count_if(near).alias("n_boundary"), r6(F.avg(F.when(near, F.col("n_words"))), "words_inside"), r6(F.avg(F.when(~near, F.col("n_words"))), "words_outside"), F.count_if(F.col("score") >= F.col("t")).alias("n_kept"))


@query(f"WITH {S.SCORED}, c AS (SELECT quantile_cont(score, 0.9) AS t FROM s), a AS (SELECT 'rejected_high' AS kind, doc_id, score FROM s, c WHERE score < c.t ORDER BY score DESC, doc_id LIMIT 5), b AS (SELECT 'kept_low' AS kind, doc_id, score FROM s, c WHERE score >= c.t ORDER BY score, doc_id LIMIT 5) FROM a UNION ALL FROM b")
def error_analysis(spark, sf):
    """The five best rejected and the five worst kept documents of the top tenth."""
    s = checkpointed(scored(spark, sf).select("doc_id", "score"))
    s = s.crossJoin(F.broadcast(s.agg(F.percentile("score", F.lit(0.9)).alias("t"))))  # one row
    pick = lambda kind, cond, order: s.where(cond).orderBy(order, "doc_id").limit(5).select(F.lit(kind).alias("kind"), "doc_id", "score")
    return pick("rejected_high", "score < t", F.desc("score")).unionByName(pick("kept_low", "score >= t", F.asc("score")))


@query(f"WITH {S.SCORED}, x AS (SELECT count(*) AS n, avg(score) AS mu, stddev_pop(score) AS sd FROM s) SELECT count(*)::BIGINT AS n, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(power((score - mu) / sd, 3)) * sqrt(any_value(n) * (any_value(n) - 1.0)) / (any_value(n) - 2), 4) AS skew, round(avg((score < 0.1)::INT), 6) AS below, round(avg((score > 0.9)::INT), 6) AS above, round(any_value(sd), 6) AS std FROM s, x")
def score_shape(spark, sf):
    x, n = F.col("score"), F.count("*")
    return scored(spark, sf).agg(n.alias("n"), r6(F.min(x), "least"), r6(F.max(x), "most"), F.round(F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2), 4).alias("skew"), r6(F.avg((x < 0.1).cast("int")), "below"), r6(F.avg((x > 0.9).cast("int")), "above"), r6(F.stddev_pop(x), "std"))


@query(rf"""WITH b AS (SELECT coalesce(text, '') AS t, coalesce(source, 'unknown') AS source FROM gen1_rejected), k AS (SELECT source, CASE WHEN regexp_matches(lower(t), 'porn|xxx|nude|sexy|granny|amateur') THEN 'adult' WHEN length(t) < 300 THEN 'too_short' WHEN len(list_filter(string_split(t, chr(10)), lambda y: length({S.strip('y')}) < 30)) > 0.7 * (length(t) - length(replace(t, chr(10), ''))) AND contains(t, chr(10)) THEN 'navigation' WHEN regexp_matches(lower(t), 'buy now|click here|subscribe|sign up|free shipping') THEN 'marketing' ELSE 'content' END AS kind FROM b)
 SELECT kind, count(*)::BIGINT AS n FROM k GROUP BY kind""")
def content_kinds(spark, sf):
    c = T.text_of(F.col("text"))
    short = F.size(F.filter(F.split(c, "\n"), lambda x: F.length(T.strip(x)) < 30))
    breaks = F.length(c) - F.length(F.translate(c, "\n", ""))
    kind = F.when(F.rlike(F.lower(c), F.lit("porn|xxx|nude|sexy|granny|amateur")), "adult").when(F.length(c) < 300, "too_short").when((breaks > 0) & (short > breaks * 0.7), "navigation").when(F.rlike(F.lower(c), F.lit("buy now|click here|subscribe|sign up|free shipping")), "marketing").otherwise("content")
    return spread(table(spark, sf, "gen1_rejected").select("rec_id", "text"), "rec_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {S.SCORED}, g AS (SELECT segment, avg(score) AS q, count(*) AS n, avg((eval_score < 0.2)::INT) AS garbage FROM s GROUP BY segment) SELECT segment, round(q, 6) AS mean_score, n::BIGINT AS n, round(garbage, 6) AS garbage_rate, round(q * n / (SELECT sum(n) FROM g), 4) AS value FROM g")
def value_ranking(spark, sf):
    """Mean score, garbage rate and quality times share of every segment."""
    g = scored(spark, sf).groupBy("segment").agg(F.avg("score").alias("q"), F.count("*").alias("n"), r6(F.avg((F.col("eval_score") < 0.2).cast("int")), "garbage_rate"))
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("segment", r6(F.col("q"), "mean_score"), "n", "garbage_rate", F.round(F.col("q") * F.col("n") / F.col("t"), 4).alias("value"))


_W = S.words("lower(coalesce(text, ''))")
_PPL = f"""w AS (SELECT doc_id, unnest({_W}) AS w FROM documents), c AS (SELECT w, count(*) AS c FROM w GROUP BY 1), n AS (SELECT sum(c)::DOUBLE AS n, count(*) AS v FROM c),
 ppl AS (SELECT doc_id, CASE WHEN count(*) >= 5 THEN exp(-avg(ln((c + 1) / (n + v + 1)))) END AS ppl FROM w JOIN c USING (w), n GROUP BY doc_id)"""


def _ppl(spark, sf):
    return lm.unigram_perplexity(docs(spark, sf, "text"), docs(spark, sf, "text"), "doc_id")


@query(f"WITH {_PPL} SELECT doc_id, round(ppl, 3) AS ppl FROM ppl")
def unigram_perplexity(spark, sf):
    return _ppl(spark, sf).select("doc_id", F.round("ppl", 3).alias("ppl"))


@query(f"WITH {_PPL} SELECT CASE WHEN ppl < 300 THEN 'head' WHEN ppl < 1000 THEN 'middle' ELSE 'tail' END AS bucket, count(*)::BIGINT AS n FROM ppl WHERE ppl IS NOT NULL GROUP BY 1")
def perplexity_buckets(spark, sf):
    p = F.col("ppl")
    return _ppl(spark, sf).where("ppl IS NOT NULL").groupBy(F.when(p < 300, "head").when(p < 1000, "middle").otherwise("tail").alias("bucket")).agg(F.count("*").alias("n"))


@query()
def quality_classifier(spark, sf):
    """Scores of a learned classifier (words and pairs of words, logistic regression) for every row."""
    g = spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id")
    model = clf.train(g.join(F.broadcast(clf.labels(table(spark, sf, "llm_labels"))), "rec_id"))  # 20,000 labels at most
    return clf.score(model, g).select("rec_id", F.round("score", 4).alias("score"))


@query()
def tfidf_classifier(spark, sf):
    """Scores of a classifier over weighted words and pairs, abstracts and textbook samples against crawled documents, for every document."""
    d = docs(spark, sf, "text", "title", "prompt", "url")
    pos = d.where("title IS NOT NULL OR prompt IS NOT NULL").withColumn("label", F.lit(1.0))
    neg = d.where("title IS NULL AND prompt IS NULL AND url IS NOT NULL").withColumn("label", F.lit(0.0))
    # at most 20,000 of each class, by hash
    cut = lambda x: x.orderBy(measures.hash_order(44, "doc_id"), "doc_id").limit(20_000).select("doc_id", "label")
    some = d.join(F.broadcast(cut(pos).unionByName(cut(neg))), "doc_id").select("label", "text")
    model = ensemble.Weighted.fit(some)
    return model.score(d.select("doc_id", "text")).select("doc_id", F.round("score", 4).alias("score"))


@query()
def evaluation_classifier(spark, sf):
    """Scores of the classifier that never filters, trained on other positives: textbook samples against crawled documents."""
    d = docs(spark, sf, "text", "title", "prompt", "url")
    pos = d.where("prompt IS NOT NULL").withColumn("label", F.lit(1.0))
    neg = d.where("title IS NULL AND prompt IS NULL AND url IS NOT NULL").withColumn("label", F.lit(0.0))
    cut = lambda x: x.orderBy(measures.hash_order(43, "doc_id"), "doc_id").limit(20_000).select("doc_id", "label")
    some = d.join(F.broadcast(cut(pos).unionByName(cut(neg))), "doc_id").select("label", "text")  # 20,000 of each class at most
    return ensemble.evaluation_scores(ensemble.evaluation_classifier(some), d.select("doc_id", "text")).select("doc_id", F.round("score", 4).alias("score"))
