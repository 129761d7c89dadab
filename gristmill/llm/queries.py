"""The queries of the problems, and SQL for those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import abuse, leaks, main_body, near_duplicates, packing, personal, prose, repetition, stuffing, tokens
from gristmill.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf, "gen1_output"), n=3, threshold=0.6)


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups at the usual five words and a similarity of 0.8."""
    return near_duplicates.near_duplicate_groups(table(spark, sf, "gen1_output"), n=5, threshold=0.8)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "gen1_output").where("text IS NOT NULL AND text <> ''")
    return prose.text_statistics(docs).where("verdict IN ('list', 'junk')").select("rec_id").distinct()


def p2_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and verdict of every row."""
    return prose.text_statistics(table(spark, sf, "gen1_output"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "gen1_output")
    return tokens.implausible_runs(docs, table(spark, sf, "gen1_stage_metrics"), tokens.fit(docs)).select("run_id").distinct()


def p3_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens by source, language and domain."""
    docs = table(spark, sf, "gen1_output")
    return tokens.token_budget(docs, tokens.fit(docs))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.furniture(table(spark, sf, "gen1_output")).distinct()


def p4_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with only its main body."""
    return main_body.main_text(table(spark, sf, "gen1_output"))


def _p5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "gen1_output")
    return abuse.abuse_scores(docs, abuse.fit_table(table(spark, sf, "tox_labels"), docs))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf).where("is_abusive").select("rec_id").distinct()


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every row."""
    return _p5(spark, sf).select("rec_id", F.round("score", 4).alias("score"))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and share of abusive rows by source, sources trimmed and in lower case."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    return _p5(spark, sf).groupBy(source.alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("is_abusive").cast("long")).alias("n_abusive"), F.round(F.avg(F.col("is_abusive").cast("double")), 6).alias("rate")
    )


def _p6(spark: SparkSession, sf: str) -> DataFrame:
    gen1 = table(spark, sf, "gen1_output").select(F.lit("gen1_output").alias("table_name"), F.col("rec_id").alias("row_id"), "text")
    audit = table(spark, sf, "repetition_filter_audit").select(F.lit("repetition_filter_audit").alias("table_name"), F.col("audit_id").alias("row_id"), F.col("text_preview").alias("text"))
    trusted = table(spark, sf, "llm_labels").where("llm_score >= 3").select(F.lit("gen1_output").alias("table_name"), F.col("rec_id").alias("row_id"))
    return repetition.repetition(gen1.unionByName(audit), trusted)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(spark, sf).where("is_repetitive").select("table_name", "row_id").distinct()


def p6_share(spark: SparkSession, sf: str) -> DataFrame:
    """The repeated share of every row of both tables."""
    return _p6(spark, sf).select("table_name", "row_id", F.col("n_words").cast("bigint").alias("n_words"), F.round("repeated_share", 6).alias("repeated_share"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.personal_types(table(spark, sf, "gen1_output")).distinct()


def p7_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with placeholders for personal information."""
    return personal.masked_texts(table(spark, sf, "gen1_output"))


def _p8(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(packing.sizes(table(spark, sf, "documents")), table(spark, sf, "pack_specs"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing had to split over containers of the long window."""
    long = table(spark, sf, "pack_specs").where("spec_name = 'long_window'").select("spec_id", "capacity_tokens")
    return _p8(spark, sf).where("n_parts > 1").join(F.broadcast(long), "spec_id").where("n_tokens > capacity_tokens").select("doc_id").distinct()


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The containers of every document, for each spec."""
    return _p8(spark, sf)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and the share of their room that is used, by spec."""
    specs = table(spark, sf, "pack_specs").select("spec_id", "spec_name", "capacity_tokens", "separator_tokens")
    used = _p8(spark, sf).groupBy("spec_id", "container_id").agg(F.sum("part_tokens").alias("t"), F.count("*").alias("n"))
    return used.join(F.broadcast(specs), "spec_id").groupBy("spec_id", "spec_name").agg(
        F.count("*").alias("n_containers"), F.round(F.sum(F.col("t") + F.col("n") * F.col("separator_tokens")) / F.sum("capacity_tokens"), 4).alias("fill")
    )


def _p9(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p9(spark, sf).select("doc_id", "item_id").distinct()


def p9_leaks_by_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items and affected documents of each suite."""
    suites = table(spark, sf, "eval_items").select("item_id", "suite")
    return _p9(spark, sf).join(suites, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"), F.max("verbatim_words").alias("longest"))


def p9_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the documents that hold no passage of a test item."""
    return table(spark, sf, "documents").select("doc_id").join(_p9(spark, sf).select("doc_id").distinct(), "doc_id", "left_anti")


def _p10(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p10(spark, sf).where("is_stuffed").select("doc_id").distinct()


def p10_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log-perplexity and share of abnormal windows of every document."""
    return _p10(spark, sf).select("doc_id", F.round("log_perplexity", 4).alias("log_perplexity"), F.round("abnormal_share", 4).alias("abnormal_share"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_WORD = r"[\p{L}\p{N}]+"
_IDEOGRAPH = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}])"
#: Share of the words of every row of both tables that lie in a run of four words occurring more than once.
_SHARES = rf"""rows_ AS (SELECT 'gen1_output' AS table_name, rec_id AS row_id, text FROM gen1_output UNION ALL SELECT 'repetition_filter_audit', audit_id, text_preview FROM repetition_filter_audit),
 w AS (SELECT table_name, row_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS ws FROM rows_), g AS (SELECT table_name, row_id, unnest(range(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 4), k AS (SELECT table_name, row_id, i, array_to_string(ws[i : i + 3], ' ') AS gram FROM g),
 r AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY table_name, row_id, gram) > 1), c AS (SELECT table_name, row_id, count(DISTINCT i + d) AS covered FROM r, (SELECT unnest([0, 1, 2, 3]) AS d) GROUP BY ALL),
 sh AS (SELECT table_name, row_id, len(ws)::BIGINT AS n_words, CASE WHEN len(ws) > 0 THEN coalesce(covered, 0) / len(ws)::DOUBLE ELSE 0.0 END AS share FROM w LEFT JOIN c USING (table_name, row_id))"""
#: Pairs by brute force over sets of ``n`` consecutive words, ideographs as words of their own.
_PAIRS = rf"""w AS (SELECT rec_id, text, regexp_extract_all(lower(regexp_replace(text, '{_IDEOGRAPH}', ' \1 ', 'g')), '{_WORD}') AS ws FROM gen1_output WHERE text <> ''),
 s AS (SELECT DISTINCT rec_id, CASE WHEN len(ws) < 3 THEN text ELSE array_to_string(ws[i : i + 2], ' ') END AS sh, len(ws) < 3 AS short FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 2))) AS i)),
 n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.short = y.short AND x.rec_id < y.rec_id GROUP BY ALL)
 SELECT b.a AS rec_a, b.b AS rec_b FROM b JOIN n p ON p.rec_id = b.a JOIN n q ON q.rec_id = b.b WHERE k >= 0.6 * (p.n + q.n - k)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose result is a plain count or comparison; models, estimates and packings have none."""
    return {
        "p1_found": f"WITH {_PAIRS}",
        "p6_found": f"WITH {_SHARES} SELECT DISTINCT table_name, row_id FROM sh WHERE n_words >= 5 AND share >= 0.3",
        "p6_share": f"WITH {_SHARES} SELECT table_name, row_id, n_words, round(share, 6) AS repeated_share FROM sh",
    }
