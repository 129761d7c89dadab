"""The queries over small tables of their own: equal to SQL on odd rows, and without a crash on empty tables."""
import math
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gristmill.plans import catalog, curation

GOOD = "\n".join([
    "The old boat stood beside the quay, and nobody at the museum had ever seen such a quiet harbour in the winter.", "Then a painter came from the north with two bags of brushes and asked for a room above the bakery.",
    "She stayed until spring, when the ice had gone and the first ships could leave for the islands again.", "Her pictures hang in the town hall today, although few of those who pass by know where they come from.",
])
TEXTS = [None, "", " \n", GOOD, GOOD, GOOD.upper(), "word " * 80, "a b c", GOOD + "\nWrite to a.b@c.org or call 415-555-2671 now.", "Der Mann ist nicht mit dem Boot an den Steg gekommen und das war gut für ihn.", "今天的天气很好。" * 20, GOOD.replace("boat", "ship"), "x" * 3000, "é e f", GOOD * 30]
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, url string, segment string, title string, prompt string",
    "gen1_output": "rec_id bigint, text string, url string, source string, segment string, _detected_lang string, _lang_confidence double, _pii_masked map<string,int>, _toxicity_score double, fetch_ts timestamp_ntz, ingest_ts timestamp_ntz",
    "gen1_rejected": "rec_id bigint, text string, url string, source string, segment string, _detected_lang string, _lang_confidence double, _filter_reason string, fetch_ts timestamp_ntz, ingest_ts timestamp_ntz",
    "gen1_stage_metrics": "run_id bigint, segment string, stage string, doc_count bigint, estimated_total_tokens bigint",
    "repetition_filter_audit": "audit_id bigint, filter_name string, text_preview string, text_length_words int, url string, filter_reason string, human_label string, human_comment string",
    "llm_labels": "rec_id bigint, url string, llm_score int",
    "eval_items": "item_id bigint, suite string, prompt string, answer string, wrong_answers array<string>",
}
URLS = ["http://a.example/x", "HTTP://www.A.example/x/", None, "", "http://casino.example/", "http://b.example:80/y?b=1&a=2", "/rel", "http://c.tk/"]


def rows():
    docs, out, bad = [], [], []
    for i, t in enumerate(TEXTS):
        u = URLS[i % len(URLS)] if i != 3 else "http://good.example/one"
        docs.append((i, t, ["en", None, "DE-at"][i % 3], ["web", None, " Web "][i % 3], len(t or ""), u, f"s{i % 2}", "A title" if i % 5 == 3 else None, "A prompt" if i % 5 == 4 else None))
        out.append((i, t, u, ["web", None][i % 2], f"s{i % 2}", ["en", None, "fr"][i % 3], [0.9, None, 0.3][i % 3], None, [0.1, None, 0.9][i % 3], None, None))
        bad.append((100 + i, t, u, "web", "s0", ["en", None][i % 2], 0.4, ["gopher:too_short:1<50", "c4:too_few_lines", None][i % 3], None, None))
    metrics = [(k, f"s{k % 2}", s, n, 1000) for k, (s, n) in enumerate([("gen1_input", 10), ("gen1_input", 20), ("gen1_output", 5), ("gen1_output", None)])]
    audit = [(i, f"f{i % 2}", t, 3, None, "r", ["0", "1", None, " 1 ", "?"][i % 5], None) for i, t in enumerate(TEXTS)]
    return {
        "documents": docs, "gen1_output": out, "gen1_rejected": bad, "gen1_stage_metrics": metrics, "repetition_filter_audit": audit,
        "llm_labels": [(i, None, [0, 3, None, 5, 2][i % 5]) for i in range(len(TEXTS))] + [(3, None, 1)], "eval_items": [(1, "s", "p", "the old boat stood", ["boat the old zebra", "x"]), (2, "s", "p", None, None), (3, "t", "p", "a room", [])],
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for name, data in rows().items():
        df = spark.createDataFrame(data, SCHEMAS[name])
        df.coalesce(1).write.parquet(str(full / f"{name}.parquet"))
        df.limit(0).coalesce(1).write.parquet(str(empty / f"{name}.parquet"))
    return str(full), str(empty)


CHECKED = [
    "gen1_cascade", "gen1_step_statistics", "gen1_output_texts", "detected_languages", "toxicity_by_dimension", "quality_scores", "gen2_pipeline", "gen3_pipeline", "rewrite_gates", "generation_quality", "ablations", "stage_metrics", "audit_sample", "rule_examples",
    "golden_verdicts", "bigram_perplexity", "completion_accuracy", "chunk_packing", "downsampled_curve", "exact_dedup_first", "url_dedup", "text_metrics", "chinese_scores", "minhash_clusters_dense", "unigram_perplexity", "crawl_sample", "encyclopedia_abstracts",
]


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_equal_to_sql_on_odd_rows(spark, folders, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folders[0]}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, folders[0])
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    theirs = sorted(([_plain(r[columns.index(c)]) for c in order] for r in want.fetchall()), key=key)
    ours = sorted(([_plain(r[c]) for c in order] for r in got.collect()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", ["gen1_step_statistics", "gen2_pipeline", "gen3_pipeline", "stage_metrics", "five_dimension_profile", "golden_summary", "perplexity_statistics", "chunk_packing", "threshold_sweep", "audit_sample", "minhash_clusters", "two_stage_dedup", "completion_accuracy", "generation_density", "classifier_health", "classifier_auc", "language_statistics", "domain_entropy"])
def test_empty_tables(spark, folders, name):
    assert catalog.queries()[name](spark, folders[1]).count() >= 0


@pytest.mark.parametrize("seed", [4, 14])
def test_sweep_means_do_not_depend_on_the_order_of_rows(spark, monkeypatch, seed):
    r = random.Random(seed)
    scores = [r.randint(0, 9999) for _ in range(200)]
    # the mean lies halfway between two numbers of six places, so that an error in the sum shows in one of the two orders
    want = math.floor(Fraction(sum(scores), 200 * 10_000) * 10**6 + Fraction(1, 2)) / 10**6
    for rows in (scores, scores[::-1]):
        df = spark.createDataFrame([(x / 10_000, x / 10_000, 1, "t") for x in rows], "score double, eval_score double, n_words bigint, text string").coalesce(1)
        monkeypatch.setattr(curation, "scored", lambda spark, sf, df=df: df)
        got = curation.threshold_sweep(spark, "").where(F.col("fraction") == 1.0).first()
        assert (got["n"], got["mean_score"], got["eval_mean"]) == (200, want, want)


def test_every_query_has_sql_but_learned_ones():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"quality_classifier", "tfidf_classifier", "evaluation_classifier"}
    assert os.path.exists(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "pyproject.toml"))
