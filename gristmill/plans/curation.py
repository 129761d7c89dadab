"""Queries of deduplication, cascades, cuts, routes and corpus statistics."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators import chinese, dedup, measures, minhash
from gristmill.operators.components import checkpointed
from gristmill.plans import rules
from gristmill.plans import sqlparts as S
from gristmill.plans.rules import docs, r6
from gristmill.scorers import linear
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


_NORM_TEXT = f"array_to_string({S.words('lower(coalesce(text, ' + chr(39) * 2 + '))')}, ' ')"


@query(f"WITH {rules.NORMALIZED}, k AS (SELECT rec_id, CASE WHEN normalized = '' THEN 't' || {_NORM_TEXT} ELSE 'u' || normalized END AS k FROM norm) SELECT min(rec_id) AS rec_id, count(*)::BIGINT AS n FROM k GROUP BY k")
def url_dedup(spark, sf):
    g = table(spark, sf, "gen1_output").select("rec_id", "url", "text")
    return dedup.representatives(g, dedup.url_key(F.col("url"), F.col("text")), "rec_id").select("rec_id", "n")


@query(f"WITH k AS (SELECT rec_id, coalesce(nullif(url, ''), {_NORM_TEXT}) AS k FROM gen1_output) SELECT min(rec_id) AS rec_id, count(*)::BIGINT AS n FROM k GROUP BY k")
def url_dedup_raw(spark, sf):
    g = table(spark, sf, "gen1_output").select("rec_id", "url", "text")
    key = F.md5(F.coalesce(F.nullif("url", F.lit("")), T.fingerprint_text(F.col("text"))))
    return dedup.representatives(g, key, "rec_id").select("rec_id", "n")


@query(f"WITH k AS (SELECT doc_id, lang, {_NORM_TEXT} AS k FROM documents), r AS (SELECT min(doc_id) AS doc_id FROM k GROUP BY k) SELECT doc_id, lang FROM k SEMI JOIN r USING (doc_id)")
def exact_dedup_first(spark, sf):
    return dedup.keep_one(table(spark, sf, "documents").select("doc_id", "text", "lang"), dedup.content_key(F.col("text")), "doc_id").select("doc_id", "lang")


@query(f"WITH k AS (SELECT doc_id, lang, {_NORM_TEXT} AS k FROM documents), r AS (SELECT max(doc_id) AS doc_id FROM k GROUP BY k) SELECT doc_id, lang FROM k SEMI JOIN r USING (doc_id)")
def exact_dedup_last(spark, sf):
    return dedup.keep_one(table(spark, sf, "documents").select("doc_id", "text", "lang"), dedup.content_key(F.col("text")), "doc_id", "last").select("doc_id", "lang")


@query(f"WITH g AS (SELECT {_NORM_TEXT} AS k, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*)::BIGINT AS groups, (count(*) FILTER (n > 1))::BIGINT AS dup_groups, round(1 - count(*) / sum(n)::DOUBLE, 6) AS dup_rate FROM g")
def duplicate_statistics(spark, sf):
    g = dedup.representatives(table(spark, sf, "documents").select("doc_id", "text"), dedup.content_key(F.col("text")), "doc_id")
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("dup_groups"), r6(1 - F.count("*") / F.sum("n"), "dup_rate"))


@query(f"WITH g AS (SELECT {_NORM_TEXT} AS k, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1), top AS (SELECT * FROM g WHERE n > 1 ORDER BY n DESC, doc_id LIMIT 5) SELECT doc_id, n::BIGINT AS n, left(d.text, 100) AS sample FROM top JOIN documents d USING (doc_id)")
def most_duplicated(spark, sf):
    """The five contents with the most copies."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    top = dedup.representatives(d, dedup.content_key(F.col("text")), "doc_id").where("n > 1").orderBy(F.desc("n"), "doc_id").limit(5)
    return d.join(F.broadcast(top), "doc_id").select("doc_id", "n", F.left("text", F.lit(100)).alias("sample"))


@query(f"""WITH k AS (SELECT {_NORM_TEXT} AS k, nullif({S.domain('url')}, '') AS host, rec_id FROM gen1_output), g AS (SELECT min(rec_id) AS first_id, count(*) AS n, count(DISTINCT host) AS n_domains FROM k GROUP BY k HAVING count(*) > 1)
 SELECT CASE WHEN n_domains = 1 THEN 'same_domain' ELSE 'cross_domain' END AS kind, count(*)::BIGINT AS groups, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1""")
def duplicate_sources(spark, sf):
    g = table(spark, sf, "gen1_output").select("url", "text")
    return dedup.duplicate_sources(g, dedup.content_key(F.col("text")), F.col("url")).groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n").alias("n_rows"))


@query(f"SELECT (count(*) - count(DISTINCT lower({S.strip(chr(39) * 0 + 'coalesce(text, ' + chr(39) * 2 + ')')})))::BIGINT AS n_duplicates FROM documents")
def duplicates_by_stripped_text(spark, sf):
    return table(spark, sf, "documents").select(F.md5(F.lower(T.strip(T.text_of(F.col("text"))))).alias("k")).agg((F.count("*") - F.countDistinct("k")).alias("n_duplicates"))


_A, _B = minhash.coefficients(128)
#: Signatures of all documents in SQL; coefficients by the rule of the affine family.
_SIGS = f"""shg AS (SELECT doc_id, {_NORM_TEXT} AS t FROM documents), shs AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, length(t) - 4) + 1), lambda i: substring(t, i, 5))) AS s FROM shg),
 shh AS (SELECT DISTINCT doc_id, coalesce(list_reduce(list_transform(string_split(x, ''), lambda c: unicode(c)::BIGINT), lambda p, c: (p * 1000003 + c) % 4294967291), 0) AS h FROM (SELECT doc_id, unnest(s) AS x FROM shs)), cf AS (SELECT unnest(range(0, 128)) AS i, unnest({_A}) AS a, unnest({_B}) AS b),
 sv AS (SELECT doc_id, i::BIGINT AS i, min((a * h + b) % {minhash.PRIME})::BIGINT AS v FROM shh, cf GROUP BY ALL)"""


@query(f"WITH {_SIGS} SELECT doc_id, i, v FROM sv")
def minhash_signatures(spark, sf):
    """All 128 hashes of every document."""
    sigs = minhash.signatures(table(spark, sf, "documents"), "doc_id", "text")
    return sigs.select(F.col("id").alias("doc_id"), F.posexplode("sig").alias("i", "v")).select("doc_id", F.col("i").cast("bigint").alias("i"), "v")


def _links_sql(bands: int) -> str:
    """CTEs ending in ``lnk (a, b, sim)`` between class representatives, and ``mem (doc_id, rep)``."""
    width = 128 // bands
    return f"""{_SIGS}, sg AS (SELECT doc_id, list(v ORDER BY i) AS s FROM sv GROUP BY doc_id), mem AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sg), rp AS (SELECT * FROM sg WHERE doc_id IN (SELECT rep FROM mem)),
 bnd AS (SELECT doc_id, k, s[k * {width} + 1 : k * {width} + {width}] AS b FROM rp, (SELECT unnest(range(0, {bands})) AS k)), cnd AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bnd x JOIN bnd y ON x.k = y.k AND x.b = y.b AND x.doc_id < y.doc_id),
 lnk AS (SELECT * FROM (SELECT cnd.a, cnd.b, len(list_filter(list_zip(x.s, y.s), lambda p: p[1] = p[2])) / 128.0::DOUBLE AS sim FROM cnd JOIN rp x ON x.doc_id = cnd.a JOIN rp y ON y.doc_id = cnd.b) WHERE sim >= 0.8)"""


def _clusters_sql(bands: int) -> str:
    """CTE ``cl (doc_id, cluster)``: the least id that links reach."""
    return f"""RECURSIVE {_links_sql(bands)}, both_ AS (SELECT a, b FROM lnk UNION ALL SELECT b, a FROM lnk), reach AS (SELECT rep AS x, rep AS y FROM mem UNION SELECT r.x, e.b FROM reach r JOIN both_ e ON e.a = r.y), low AS (SELECT x, min(y) AS cluster FROM reach GROUP BY x), cl AS (SELECT mem.doc_id, low.cluster FROM mem JOIN low ON low.x = mem.rep)"""


@query(f"WITH {_links_sql(8)} SELECT a, b, sim FROM lnk")
def minhash_links(spark, sf):
    """Similar pairs of class representatives, eight bands of sixteen."""
    member, reps = minhash.classes(minhash.checkpointed(minhash.signatures(table(spark, sf, "documents"), "doc_id", "text")))
    return minhash.similar_pairs(reps)


@query(f"WITH {_clusters_sql(8)} SELECT doc_id, cluster FROM cl")
def minhash_clusters(spark, sf):
    """The cluster of every document, by the reference's bands (8 of 16): a pair at similarity 0.8 is found with probability 0.20, at 0.88 with 0.67, at 0.9 with 0.81."""
    return minhash.clusters(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "cluster")


@query(f"WITH {_clusters_sql(32)} SELECT doc_id, cluster FROM cl")
def minhash_clusters_dense(spark, sf):
    """The cluster of every document by 32 bands of 4, which miss next to no pair at similarity 0.8."""
    return minhash.clusters(table(spark, sf, "documents"), bands=32).select(F.col("id").alias("doc_id"), "cluster")


@query(f"WITH {_clusters_sql(8)} SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM cl GROUP BY cluster")
def two_stage_dedup(spark, sf):
    """What is left after exact, then near duplicates are taken out; the first of each cluster stays."""
    c = minhash.clusters(table(spark, sf, "documents"))
    return c.groupBy("cluster").agg(F.min("id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


def scored(spark, sf):
    """Documents with the learned score, the evaluation score and the number of words."""
    rows = linear.with_scores(docs(spark, sf, "text", "lang", "source", "segment"), names=("edu", "evaluation")).withColumn("n_words", T.n_words(F.col("text")))
    return rows.withColumnRenamed("score_edu", "score").withColumnRenamed("score_evaluation", "eval_score")


@query(f"WITH {S.SCORED}, c AS (SELECT quantile_cont(score, 0.9) AS threshold FROM s) SELECT doc_id, score, round(threshold, 6) AS threshold FROM s, c WHERE score >= threshold")
def top_fraction_cut(spark, sf):
    """The best tenth by score, ties at the cut included; scores are written once, so that texts are read once."""
    return measures.top_fraction(checkpointed(scored(spark, sf).select("doc_id", "score")), "score", 0.1).select("doc_id", "score", r6(F.col("threshold"), "threshold"))


#: Fractions of the sweeps; a token is taken for four bytes.
FRACTIONS = [0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 0.70, 1.0]
_SWEEP = f"""{S.SCORED}, th AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0])::DOUBLE AS fraction, unnest(quantile_cont(score, [0.95, 0.9, 0.85, 0.8, 0.7, 0.5, 0.3, 0.0])) AS threshold FROM s),
 sweep AS (SELECT fraction, round(threshold, 6) AS threshold, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS retention, sum(n_words)::BIGINT AS n_words, (sum(octet_length(encode(t))) // 4)::BIGINT AS est_tokens, round(avg(score), 6) AS mean_score, round(avg(eval_score), 6) AS eval_mean, round(quantile_cont(eval_score, 0.9), 6) AS eval_p90, round(quantile_cont(eval_score, 0.5), 6) AS eval_p50 FROM s, th WHERE score >= threshold GROUP BY fraction, threshold)"""


def _sweep(spark, sf):
    s = checkpointed(scored(spark, sf).select("score", "eval_score", "n_words", F.octet_length(T.text_of(F.col("text"))).alias("bytes")))
    cuts = s.agg(F.percentile("score", F.array(*[F.lit(round(1 - f, 2)) for f in FRACTIONS])).alias("t"), F.count("*").alias("total"))
    cuts = cuts.select(F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in FRACTIONS]).alias("fraction"), F.col("t").alias("threshold"))).alias("x"), "total").select("x.fraction", "x.threshold", "total")
    rows = s.join(F.broadcast(cuts), F.col("score") >= F.col("threshold"))  # eight rows
    out = rows.groupBy("fraction", "threshold", "total").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("n_words"), F.floor(F.sum("bytes") / 4).alias("est_tokens"), r6(measures.mean_of_scores("score"), "mean_score"), r6(measures.mean_of_scores("eval_score"), "eval_mean"),
        r6(F.percentile("eval_score", F.lit(0.9)), "eval_p90"), r6(F.percentile("eval_score", F.lit(0.5)), "eval_p50"),
    )
    return out.select("fraction", F.round("threshold", 6).alias("threshold"), "n", r6(F.col("n") / F.col("total"), "retention"), "n_words", "est_tokens", "mean_score", "eval_mean", "eval_p90", "eval_p50")


@query(f"WITH {_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    """What remains, how good the independent evaluation finds it, and how many tokens it has, for eight fractions."""
    return _sweep(spark, sf)


@query(f"WITH {_SWEEP} SELECT fraction, n, round(eval_mean / est_tokens * 1000000, 6) AS per_million FROM sweep ORDER BY eval_mean / est_tokens DESC, fraction LIMIT 1")
def best_threshold(spark, sf):
    """The fraction of the most quality for a million tokens, the smallest of equals."""
    s = _sweep(spark, sf)
    return s.orderBy(F.desc(F.col("eval_mean") / F.col("est_tokens")), "fraction").limit(1).select("fraction", "n", r6(F.col("eval_mean") / F.col("est_tokens") * 1_000_000, "per_million"))


@query(f"""WITH {S.SCORED}, x AS (SELECT min(score) AS lo, max(score) AS hi FROM s), b AS (SELECT least(floor((score - lo) / ((hi - lo) / 50)), 49)::INT AS bin FROM s, x), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
 SELECT r::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM range(50) t(r) LEFT JOIN c ON bin = r""")
def score_histogram(spark, sf):
    return measures.histogram(checkpointed(scored(spark, sf).select("score")), "score", 50)


@query(f"WITH b AS (SELECT doc_id, len({S.words('coalesce(text, ' + chr(39) * 2 + ')')}) + 1 AS n FROM documents), o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS e FROM b), f AS (SELECT max(e) // 513 AS n_full FROM o) SELECT doc_id, ((e - n) // 513)::BIGINT AS first_chunk, least((e - 1) // 513, n_full - 1)::BIGINT AS last_chunk FROM o, f WHERE (e - n) // 513 < n_full")
def chunk_packing(spark, sf):
    """The full chunks of 513 that every document's words and end mark fall into, documents in the order of their ids; what falls into the unfinished last chunk is dropped.

    Documents are split into ranges of ids by Spark's range partitioning. Running totals
    go inside of a range, the totals of the ranges, one row for each partition, are added
    up apart; no window goes over all rows.
    """
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs(spark, sf, "text").select("doc_id", (T.n_words(F.col("text")) + 1).alias("n"))
    rows = checkpointed(rows.repartitionByRange(parts, "doc_id").select("doc_id", "n", F.spark_partition_id().alias("r")))
    per = rows.groupBy("r").agg(F.sum("n").alias("t"))
    base = per.select("r", (F.sum("t").over(Window.orderBy("r")) - F.col("t")).alias("base"))  # one row for each partition
    full = per.agg(F.floor(F.sum("t") / 513).alias("full"))
    e = rows.withColumn("e", F.sum("n").over(Window.partitionBy("r").orderBy("doc_id"))).join(F.broadcast(base), "r").crossJoin(F.broadcast(full))
    end = F.col("base") + F.col("e")
    out = e.select("doc_id", F.floor((end - F.col("n")) / 513).alias("first_chunk"), F.least(F.floor((end - 1) / 513), F.col("full") - 1).alias("last_chunk"), "full")
    return out.where("first_chunk < full").drop("full")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 500")
def seeded_sample(spark, sf):
    """Five hundred documents by chance, the same ones every time."""
    return table(spark, sf, "documents").select("doc_id").orderBy(measures.hash_order(42, "doc_id"), "doc_id").limit(500)


@query("""WITH l AS (SELECT rec_id, max(llm_score) AS s FROM llm_labels WHERE llm_score IS NOT NULL GROUP BY 1), c AS (SELECT rec_id, CASE WHEN s >= 3 THEN 'high' ELSE 'low' END AS label FROM l WHERE s >= 3 OR s <= 1),
 x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('43:' || rec_id), rec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM c) SELECT rec_id, label FROM x WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY label))""")
def class_balance(spark, sf):
    """As many labelled rows of either class."""
    l = table(spark, sf, "llm_labels").where("llm_score IS NOT NULL").groupBy("rec_id").agg(F.max("llm_score").alias("s"))  # noqa: E741
    c = l.where("s >= 3 OR s <= 1").select("rec_id", F.when(F.col("s") >= 3, "high").otherwise("low").alias("label"))
    # the n-th hash of the larger class is the cut; a range join against it needs no ordered window over a class
    n = c.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("m"))
    ranked = c.withColumn("h", measures.hash_order(43, "rec_id"))
    bucket = ranked.withColumn("b", F.substring("h", 1, 3))
    sizes = bucket.groupBy("label", "b").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(Window.partitionBy("label").orderBy("b")) - F.col("k")).drop("k")  # 4096 rows a class
    rn = F.row_number().over(Window.partitionBy("label", "b").orderBy("h", "rec_id"))
    return bucket.join(F.broadcast(before), ["label", "b"]).withColumn("rn", rn + F.col("before")).crossJoin(F.broadcast(n)).where("rn <= m").select("rec_id", "label")


@query(f"WITH o AS (SELECT DISTINCT left({S.strip('coalesce(text, ' + chr(39) * 2 + ')')}, 200) AS k FROM gen1_output) SELECT rec_id FROM gen1_rejected r WHERE left({S.strip('coalesce(r.text, ' + chr(39) * 2 + ')')}, 200) NOT IN (SELECT k FROM o)")
def rejected_not_in_output(spark, sf):
    """Rejected rows whose beginning stands in no row of the output."""
    key = F.md5(T.match_key(F.col("text"))).alias("k")
    return table(spark, sf, "gen1_rejected").select("rec_id", key).join(table(spark, sf, "gen1_output").select(key), "k", "left_anti").select("rec_id")


@query("SELECT rec_id, source FROM gen1_output UNION ALL SELECT rec_id, source FROM gen1_rejected")
def all_crawled(spark, sf):
    """Output and rejected rows together; columns that only one of them has become null."""
    return table(spark, sf, "gen1_output").unionByName(table(spark, sf, "gen1_rejected"), allowMissingColumns=True).select("rec_id", "source")


def _diversity_sql(source: str) -> str:
    return rf"""b AS (SELECT {S.words("lower(coalesce(text, ''))")} AS w FROM {source}), z AS (SELECT unnest([1, 2, 3, 4]) AS n),
 g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM b, z WHERE len(w) >= n), c AS (SELECT n, gram, count(*) AS c FROM g GROUP BY ALL)"""


@query(f"WITH {_diversity_sql('documents')} SELECT n::INT AS n, count(*)::BIGINT AS n_unique, sum(c)::BIGINT AS n_total, round(count(*) / sum(c)::DOUBLE, 4) AS diversity FROM c GROUP BY n")
def ngram_diversity(spark, sf):
    return measures.ngram_diversity(docs(spark, sf, "text"))


@query(f"WITH {_diversity_sql('documents')}, r AS (SELECT n, gram, c, row_number() OVER (PARTITION BY n ORDER BY c DESC, gram) AS k FROM c WHERE n <= 2) SELECT n::INT AS n, gram, c::BIGINT AS c FROM r WHERE k <= 10")
def top_ngrams(spark, sf):
    """The ten most frequent words and pairs of words; ties by spelling."""
    c = measures.ngram_counts(docs(spark, sf, "text"), (1, 2))
    # an aggregate of bounded memory instead of an ordered window over all n-grams
    top = [c.where(F.col("n") == n).orderBy(F.desc("c"), "gram").limit(10) for n in (1, 2)]
    return top[0].unionByName(top[1])


@query(f"""WITH d AS (SELECT {S.domain('url')} AS dom FROM gen1_output), c AS (SELECT dom, count(*) AS c FROM d WHERE dom <> '' GROUP BY 1), h AS (SELECT * FROM c ORDER BY c DESC, dom LIMIT 50), p AS (SELECT c / sum(c) OVER () AS p FROM h), e AS (SELECT -sum(p * log2(p)) AS e, count(*) AS k FROM p)
 SELECT round(e, 4) AS entropy, round(CASE WHEN k > 1 THEN log2(k) ELSE 0 END, 4) AS max_entropy, round(CASE WHEN k > 1 THEN e / log2(k) ELSE 0 END, 4) AS normalized, (SELECT count(*) FROM c)::BIGINT AS n_keys FROM e""")
def domain_entropy(spark, sf):
    c = table(spark, sf, "gen1_output").select(U.domain(F.col("url")).alias("dom")).where("dom <> ''").groupBy("dom").agg(F.count("*").alias("c"))
    return measures.entropy(c, "dom")


_LENGTHS = f"SELECT coalesce(nullif(lower(trim(source)), ''), 'unknown') AS source, len({S.words('coalesce(text, ' + chr(39) * 2 + ')')}) AS n FROM documents"


@query(f"WITH l AS ({_LENGTHS}) SELECT source, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total_words, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, " + ", ".join(f"round(quantile_cont(n, {q}), 6) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM l GROUP BY source")
def length_distribution(spark, sf):
    n = T.n_words(F.col("text"))
    rows = docs(spark, sf, "text", "source").select(F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown")).alias("source"), n.alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("total_words"), F.min("n").cast("bigint").alias("least"), F.max("n").cast("bigint").alias("most"), r6(F.avg("n"), "mean"), *measures.distribution(F.col("n"), (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)))


@query("""WITH l AS (SELECT CASE WHEN _lang_confidence < 0.5 THEN 'uncertain' ELSE coalesce(nullif(regexp_extract(lower(trim(_detected_lang)), '^([a-z]+)', 1), ''), 'unknown') END AS lang, _lang_confidence AS c FROM gen1_output), g AS (SELECT lang, count(*) AS n, avg(c) AS conf FROM l GROUP BY 1)
 SELECT lang, n::BIGINT AS n, round(conf, 6) AS mean_confidence, round(n / (SELECT sum(n) FROM g)::DOUBLE, 6) AS rate FROM g ORDER BY n DESC, lang LIMIT 20""")
def language_distribution(spark, sf):
    code = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("_detected_lang")), "^([a-z]+)", 1), F.lit("")), F.lit("unknown"))
    g = table(spark, sf, "gen1_output").groupBy(F.when(F.col("_lang_confidence") < 0.5, "uncertain").otherwise(code).alias("lang")).agg(F.count("*").alias("n"), r6(F.avg("_lang_confidence"), "mean_confidence"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("lang", "n", "mean_confidence", r6(F.col("n") / F.col("t"), "rate")).orderBy(F.desc("n"), "lang").limit(20)


@query("SELECT count(DISTINCT segment)::BIGINT AS n_segments, count(DISTINCT " + S.domain("url") + ")::BIGINT AS n_domains, round(avg(length(coalesce(text, ''))), 6) AS mean_length FROM gen1_output")
def crawl_statistics(spark, sf):
    g = table(spark, sf, "gen1_output").select("segment", U.domain(F.col("url")).alias("d"), F.length(T.text_of(F.col("text"))).alias("n"))
    return g.agg(F.countDistinct("segment").alias("n_segments"), F.countDistinct("d").alias("n_domains"), r6(F.avg("n"), "mean_length"))


_ZH_NORMALIZED = f"SELECT rec_id, {rules._ZH_NORMAL} AS t FROM ({rules._ZH_ROWS})"


@query(f"WITH {rules.zh_cte(_ZH_NORMALIZED)} SELECT rec_id, reason, script FROM zq")
def gen1_zh_pipeline(spark, sf):
    """Chinese rows after detection, normal form and quality rules, with their script."""
    c = F.col("text")
    g = spread(table(spark, sf, "gen1_output").select("rec_id", "text"), "rec_id").where(chinese.char_ratios(c)["chinese"] >= 0.15)
    g = g.select("rec_id", chinese.normalized(c).alias("text"))
    return g.select("rec_id", chinese.quality(c).alias("reason"), chinese.script(c).alias("script"))
