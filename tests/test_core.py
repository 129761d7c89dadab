"""Rule filters, addresses, patterns, deduplication and measures on small fixtures."""
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators import cascade, chinese, dedup, measures, minhash, ngrams, pii, quality
from gristmill.operators.components import connected_components
from gristmill.sources import crawl


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("url, want", [
    ("HTTP://WWW.Ex.com:8080/A/b/?z=1&a=2&a=1&k#frag", "https://ex.com/A/b?a=2&a=1&k=&z=1"), ("http://u:p@ex.com", "https://ex.com/"),
    ("https://ex.com/p;jsid=1?q=a b%2Fc", "https://ex.com/p?q=a+b%2Fc"), ("//ex.com/y/", "https://ex.com/y"), ("ex.com/x", "https://ex.com/x"), ("", ""), (None, ""),
])
def test_normalized(spark, url, want):
    assert one(spark, U.normalized, url) == want


@pytest.mark.parametrize("url, want", [
    ("", "empty_url"), ("http://a.tk/x", "blacklist_tld:.tk"), ("http://a.tk:80/x", None), ("https://essex.ac.uk/", "blacklist_keyword:sex"), ("http://1.2.3.4/p", "ip_address_url"), ("/rel/path", "no_domain"), (None, "empty_url"),
])
def test_url_rules(spark, url, want):
    assert one(spark, quality.url, url) == want


@pytest.mark.parametrize("text, masked, action", [
    ("Mail a.b@x.org or call 415-555-2671 from 10.0.0.1", "Mail [EMAIL] or call [PHONE] from [IP_ADDRESS]", "filtered_high_density"), ("card 4111111111111111 ssn 123-45-6789", "card [CREDIT_CARD] ssn [SSN]", "filtered_high_density"),
    ("ssn 000-12-3456", "ssn 000-12-3456", "kept"), ("(415) 555-2671", "([PHONE]", "filtered_high_density"), (None, "", "kept"),
])
def test_pii(spark, text, masked, action):
    r = pii.masked(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["masked_text"], r["pii_action"]) == (masked, action)


def test_repetition_fractions():
    assert ngrams.fractions("word " * 10)[0] == 1.8
    assert ngrams.fractions("word " * 10)[9 + 3] == 3.0
    assert ngrams.fractions("a b c d")[9 + 3] == 0
    assert ngrams.fractions("a\na\nb")[18] == pytest.approx(1 / 3)
    assert ngrams.fractions(None) == [0.0] * 20


def _texts():
    r = random.Random(3)
    pieces = ["the", "of", "and", "be", "Word,", "x1", "42", "(foo)", "...", "end.", "\n", "\n\n", " ", "- item", "javascript", "•", "e...\n", "The cat sat on the mat and it was good.\n"]
    return [None, "", " ", "\n"] + [" ".join(r.choice(pieces) for _ in range(r.choice([3, 40, 120, 400]))) for _ in range(150)]


def test_quality_in_batches_equals_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "i int, text string")
    rows = quality.prepared(df).select("i", quality.quality(F.col("text")).alias("a"), quality.quality_in_batches(F.col("text")).alias("b")).collect()
    assert [r for r in rows if r["a"] != r["b"]] == []
    assert len({r["a"] for r in rows}) > 4


def test_routes_and_cut(spark):
    df = spark.createDataFrame([(x,) for x in (0.7, 0.6999, 0.3, 0.2999, 0.1, 0.0999)], "s double")
    assert [r[0] for r in df.select(measures.route(F.col("s"))).collect()] == ["high_quality", "medium_quality", "medium_quality", "to_rephrase", "to_rephrase", "discarded"]
    scores = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "s double")
    assert measures.top_fraction(scores, "s", 0.1).count() == 1
    assert measures.top_fraction(spark.createDataFrame([(0.5,)] * 10, "s double"), "s", 0.1).count() == 10


def test_exact_dedup(spark):
    df = spark.createDataFrame([(0, "A  b", 1), (1, "a b", 1), (2, "c", 1), (3, "a B\n", 1)], "id int, text string, key int")
    key = dedup.content_key(F.col("text"))
    assert sorted(r["id"] for r in dedup.keep_one(df, key, "id").collect()) == [0, 2]
    assert sorted(r["id"] for r in dedup.keep_one(df, key, "id", "last").collect()) == [2, 3]
    assert dedup.keep_one(df.limit(0), key, "id").count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), (3, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 5: 5} | {100 + i: 100 for i in range(31)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_minhash_clusters(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefghij") * r.randint(2, 6) for _ in range(80)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " tail") for i, t in enumerate(base[:3])] + [(20, base[0]), (21, None), (22, "")]
    got = {x["id"]: x["cluster"] for x in minhash.clusters(spark.createDataFrame(rows, "doc_id bigint, text string"), bands=32).collect()}
    assert [got[i] for i in (0, 10, 20)] == [0, 0, 0] and got[11] == 1 and got[4] == 4 and got[21] == got[22]


def test_entropy(spark):
    c = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "k string, c bigint")
    assert tuple(measures.entropy(c, "k").first()) == (1.5, 1.585, 0.9464, 3)


def test_cascade_handles_nulls(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "short text", None), (3, "", "DE-at")], "doc_id bigint, text string, lang string")
    rows = cascade.whole(df, lang_col="lang", url_col=None)
    assert {r["doc_id"]: r["reason"] for r in rows.collect()} == {1: "quality:gopher:too_short", 2: "lang:unknown", 3: "lang:de"}
    assert {r["step"]: r["filtered"] for r in cascade.step_statistics(rows).collect()} == {"url_dedup": 0, "url_filter": 0, "lang": 2, "quality": 1, "repetition": 0, "pii_density": 0, "toxicity": 0}
    assert cascade.whole(df.limit(0), lang_col="lang", url_col=None).count() == 0


def test_chinese(spark):
    assert one(spark, chinese.tokens, "中abc文") == ["中", "abc文"]
    assert one(spark, chinese.spam_score, "立即下载 加微信咨询") == pytest.approx(0.25)
    assert one(spark, chinese.normalized, "ＡＢ１　x") == "AB1　x"
    assert one(spark, chinese.script, "们来时这") == "simplified" and one(spark, chinese.script, "們來時這個") == "traditional" and one(spark, chinese.script, "abc") == "unknown"


def test_white_space(spark):
    t = "a\xa0b　c\x1cd\x85e f"
    assert one(spark, T.words, t) == t.split()
    lines = "a\r\nb\x0bc d\n\n"
    assert one(spark, T.lines, lines) == lines.splitlines()


def _record(kind, url, body):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: " + url + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_crawl_sources(spark, tmp_path):
    import gzip

    body = ("word " * 30).encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    plain = _record(b"conversion", b"http://a.example/", body) + _record(b"conversion", b"http://b.example/", b"w\xfford " * 40) + _record(b"conversion", b"http://c.example/", b"short")
    (tmp_path / "x.warc.wet").write_bytes(info + plain)
    # members of their own, as crawls are packed, and a body of more than a block
    (tmp_path / "y.warc.wet.gz").write_bytes(gzip.compress(info) + gzip.compress(plain) + gzip.compress(_record(b"conversion", b"http://d.example/", b"long word " * 300_000)))
    rows = crawl.read_wet(spark, str(tmp_path)).collect()
    assert sorted(r["url"] for r in rows) == ["http://a.example/"] * 2 + ["http://b.example/"] * 2 + ["http://d.example/"]
    assert {len(r["text"]) for r in rows if "d.example" in r["url"]} == {2_999_999} and all(r["text"].startswith("w\ufffdord") for r in rows if "b.example" in r["url"])
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html><body><nav>menu <nav>inner</nav> more</nav><p>" + body + b"</p><aside>x<table><tr><td>y</td></tr></table></aside></body></html>"
    (tmp_path / "z.warc").write_bytes(info + _record(b"response", b"http://e.example/", page) + _record(b"request", b"http://e.example/", page) + _record(b"response", b"http://f.example/", b"HTTP/1.1 200 OK\r\n\r\nplain " + body))
    got = crawl.read_warc(spark, str(tmp_path / "z.warc")).collect()
    assert [(r["url"], r["text"]) for r in got] == [("http://e.example/", body.decode().strip())]
    assert crawl.read_warc(spark, str(tmp_path / "z.warc"), min_chars=500).count() == 0


@pytest.mark.parametrize("html, want", [
    ("<html><head><style>x{}</style></head><body><nav>menu</nav><p>Hello &amp; <b>you</b></p><script>1</script></body></html>", "Hello & you"),
    ("<nav>a<nav>b</nav>c</nav>kept<aside>d<table><tr><td>e</table>f</aside> too", "kept too"), ("<div>one<br/>two</div>three", "one\ntwo\nthree"), ("a<nav>never closed", "a"), ("</nav>x", "x"), ("", ""), (None, ""),
])
def test_html_text(spark, html, want):
    assert one(spark, crawl.html_text, html) == want


def test_inputs_and_settings(spark, tmp_path, monkeypatch):
    from gristmill import config

    with pytest.raises(FileNotFoundError):
        crawl.choose_input(str(tmp_path), 10)
    (tmp_path / "other.jsonl").write_text('{"text": "a", "url": "u"}\nnot json\n{"text": "b"}\n')
    assert crawl.choose_input(str(tmp_path), 10).endswith("other.jsonl")
    (tmp_path / "cc_wet_sample.jsonl").write_text("")
    (tmp_path / "cc_wet_full.jsonl").write_text("")
    assert crawl.choose_input(str(tmp_path), 12_000).endswith("sample.jsonl") and crawl.choose_input(str(tmp_path), 12_001).endswith("full.jsonl")
    assert [r["text"] for r in crawl.read_jsonl(spark, str(tmp_path / "other.jsonl"), "text string, url string", 1, "text").collect()] == ["a"]
    assert crawl.read_input(spark, str(tmp_path / "other.jsonl")).count() == 2
    with pytest.raises(ValueError):
        crawl.read_input(spark, "x.doc")
    monkeypatch.setenv("PIPELINE_API_KEY", "k")
    r = config.run({"doc_limit": 1, "full_run": {"audit_sample_size": 7}}, "full_run", 2)
    assert (r.doc_limit, r.audit_sample_size, r.eval_sample_size, r.api_key, r.output_dir) == (100_000, 7, 2_000, "k", "data/gen2_output/full_run")
    assert config.gen1({"extra_domains": ["a"], "unknown": 1}).extra_domains == ("a",) and config.gen1().min_confidence == 0.65
    (tmp_path / "c.json").write_text('{"min_words": 3}')
    assert config.gen1(config.read(str(tmp_path / "c.json"))).min_words == 3
    with pytest.raises(ValueError):
        config.run({}, "other")


def test_sinks(spark, tmp_path):
    import json

    from gristmill.sources import sinks

    df = spark.createDataFrame([(1, "é", "high"), (2, None, "low")], "doc_id bigint, text string, route string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    (tmp_path / "j" / "part-bad.json").write_text('{"doc_id": oops\n')
    assert sorted(r["doc_id"] for r in crawl.read_jsonl(spark, str(tmp_path / "j"), "doc_id bigint, text string").collect()) == [1, 2]
    sinks.write_routed(df, str(tmp_path / "r"))
    assert (tmp_path / "r" / "route=high").exists() and spark.read.parquet(str(tmp_path / "r")).count() == 2
    audit = spark.createDataFrame([("c4", 'a "quoted", line', 3)], "filter_name string, text_preview string, text_length_words int")
    sinks.write_audit(audit, str(tmp_path / "a"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "a"))
    assert back.columns == list(sinks.AUDIT) and back.first()["text_preview"] == 'a "quoted", line' and back.first()["human_label"] is None
    sinks.write_statistics(df, str(tmp_path / "s"), counts=df.groupBy("route").count())
    assert {x["route"]: x["count"] for x in json.loads(spark.read.text(str(tmp_path / "s")).first()["value"])["counts"]} == {"high": 1, "low": 1}
    t = {r["doc_id"]: r["tokens"] for r in sinks.token_arrays(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string"), lambda s: [len(w) for w in s.split()], max_len=2, end=9).collect()}
    assert t == {1: [1, 1, 9], 2: [9]}
    for labels in ([(1, 3), (2, 4)], [(2, 0), (3, 5)]):
        sinks.add_labels(spark.createDataFrame(labels, "rec_id bigint, llm_score int"), str(tmp_path / "l"))
    assert sorted((r["rec_id"], r["llm_score"]) for r in spark.read.json(str(tmp_path / "l")).collect()) == [(1, 3), (2, 4), (3, 5)]
    assert sinks.markdown(spark.createDataFrame([("a", 1.5, None)], "x string, y double, z int")) == "| x | y | z |\n|-|-|-|\n| a | 1.5 |  |"


@pytest.mark.parametrize("reply, want", [("Score: 4 out of 5", 4), ("none", None), (None, None), ("7 then 2", 2), ("0", 0)])
def test_labels_of_replies(spark, reply, want):
    from gristmill.functions import replies

    assert one(spark, replies.label, reply) == want


def test_judgements(spark):
    from gristmill.functions import replies

    good = '[{"doc_id": 1, "quality_score": 0.8, "quality_label": "high", "brief_reason": "ok"}]'
    for r in (good, "Here:\n```json\n" + good + "\n```\nbye", "```\n" + good + "\n```"):
        assert [(j["doc_id"], j["quality_score"], j["quality_label"]) for j in one(spark, replies.judgements, r)] == [(1, 0.8, "high")]
    for r in ("no json", "", None):
        assert [j["quality_score"] for j in one(spark, replies.judgements, r)] == [-1.0]

    def ask(t):
        if t == "bad":
            raise ValueError("service down")
        return t.upper()

    rows = replies.asked(spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, text string"), ask, retries=2, delay=0).collect()
    assert {r["id"]: (r["reply"], r["reply_error"]) for r in rows} == {1: ("A", None), 2: (None, "service down"), 3: ("", None)}


def test_stream_equals_batch(spark, tmp_path):
    from gristmill.streaming import rules

    texts = _texts()[:40]
    rows = [(i, t, "en", f"2031-01-01 00:00:{i % 60:02d}", f"http://h{i % 3}.example/{i}") for i, t in enumerate(texts)] + [(100 + i, t, "en", "2031-01-01 00:01:00", None) for i, t in enumerate(texts[:5])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, ts string, url string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name, mode):
        q = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    batch = {r["doc_id"]: r["reason"] for r in cascade.whole(df, lang_col="lang", url_col=None).collect()}
    assert {r["doc_id"]: r["reason"] for r in run(rules.stream_reasons, "reasons", "append")} == batch
    assert {r["doc_id"] for r in run(lambda s: rules.stream_reasons(s, url_col="url"), "addressed", "append") if r["reason"] == "url_filter:empty_url"} == set(range(100, 105))
    got = run(rules.stream_dedup, "once", "append")
    assert len(got) == len({" ".join((t or "").lower().split()) for t in texts})
    counts = run(rules.stream_counts, "counts", "complete")
    want = {}
    for r in batch.values():
        k = r.split(":")[0] if r else "kept"
        want[k] = want.get(k, 0) + 1
    assert {r["step"]: r["n"] for r in counts} == want


def test_quality_classifier_reads_whole_texts(spark):
    from gristmill.scorers import quality as clf

    head = "word " * 600
    rows = [(i, head + ("careful study evidence" if i % 2 else "cheap casino pills"), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, label double")
    s = {r["rec_id"]: r["score"] for r in clf.score(clf.train(df), df).select("rec_id", "score").collect()}
    assert min(s[i] for i in s if i % 2) > 0.5 > max(s[i] for i in s if i % 2 == 0)
    labels = spark.createDataFrame([(i, 3) for i in range(200)], "rec_id bigint, llm_score int")
    picked = {r["rec_id"] for r in clf.labels(labels, limit=20).collect()}
    assert len(picked) == 20 and picked != set(range(20))


def test_whole_cascade(spark):
    good = "\n".join([
        "The old boat stood beside the quay, and nobody at the museum had ever seen such a quiet harbour in the winter.", "Then a painter came from the north with two bags of brushes and asked for a room above the bakery.",
        "She stayed until spring, when the ice had gone and the first ships could leave for the islands again.", "Her pictures hang in the town hall today, although few of those who pass by know where they come from.",
        "One of them shows the lighthouse keeper with his dog, looking at a storm that has not yet begun.",
    ])
    rows = [(1, good + " Write to a.b@c.org now.", "en", "http://a.org/x", 0.1), (2, good + " More of it here.", "en", "http://a.org/x", 0.1), (3, good, "en", "http://casino.org/y", 0.1), (4, good + " So be it.", "en", None, 0.1), (5, good + " End of it.", "en", "http://a.org/z", 0.9), (6, good, "de", "http://a.org/w", 0.1)]
    df = spark.createDataFrame([r[:4] for r in rows] + [(7, good + " You fucking idiot, you bitch, you bastard, what shit.", "en", "http://a.org/t")], "doc_id bigint, text string, lang string, url string")
    base = {r["doc_id"]: r["reason"] for r in cascade.whole(df, lang_col="lang", url_col=None).collect()}
    assert base[1] is None and base[7] == "toxicity:score"
    got = {r["doc_id"]: r for r in cascade.whole(df, lang_col="lang").collect()}
    assert len(got) == 7 and got[1]["reason"] is None and "[EMAIL]" in got[1]["masked_text"] and "a.b@c.org" not in got[1]["masked_text"] and got[7]["masked_text"] is None
    assert [got[i]["step"] for i in (2, 3, 4, 6, 7)] == ["url_dedup", "url_filter", "url_filter", "lang", "toxicity"] and got[5]["reason"] is None
    assert {r["doc_id"]: r["step"] for r in cascade.whole(df, lang_col="lang", action="flag").collect()}[7] is None
    # the language is found in the text where no column names it
    assert {r["doc_id"]: (r["detected_lang"], r["reason"]) for r in cascade.whole(df, url_col=None).where("doc_id = 6").collect()} == {6: ("en", None)}
    many = df.withColumn("extra", F.lit(1)).withColumn("_first", F.lit(2))
    assert cascade.whole(many, lang_col="lang").select("extra", "_first").distinct().count() == 1


def test_fixed_values():
    """The values that results depend on, stated here by themselves."""
    assert T.STOP_WORDS == (
        "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me when make can like time no just "
        "him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us"
    ).split() and len(T.STOP_WORDS) == 99
    assert set(T.TERMINAL) == set(".?!\"'»…")
    assert quality.URL_KEYWORDS == ["porn", "xxx", "adult", "sex", "nude", "naked", "casino", "slots", "gambling", "poker", "spam", "phishing", "malware", "payday-loan", "paydayloan", "viagra", "cialis", "pharmacy"]
    assert quality.URL_TLDS == [".tk", ".ml", ".ga", ".cf", ".gq"]
    assert ngrams.TOP_LIMITS == {2: 0.20, 3: 0.18, 4: 0.16} and ngrams.DUPLICATE_LIMITS == {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    assert [(n, h) for n, _, h in pii.PATTERNS] == [("email", "[EMAIL]"), ("phone_us", "[PHONE]"), ("ip_v4", "[IP_ADDRESS]"), ("credit_card", "[CREDIT_CARD]"), ("ssn", "[SSN]")]
    assert set(chinese.TRADITIONAL) == set("們來時這個說國後會對應也從於他她學現發問題與為話體樣進過點還實際間愛藝術電語書報紙習工作生活歷史關係政治經濟文化社展變")
    assert set(chinese.SIMPLIFIED) == set("们来时这个说国后会对应也从于他她学现发问题与为话实际间点体样进过还爱艺术电语书报纸习工作生活历史关系政治经济文化社展变")
    assert [(n, w) for n, w, _ in chinese.SPAM] == [("star_rating_spam", 0.5), ("click_bait", 2.0), ("promo_lure", 2.0), ("wechat_drain", 3.0), ("phone_number", 0.5), ("url_count", 0.3), ("char_repetition", 1.0), ("share_lucky_draw", 3.0), ("seo_terms", 1.5)]
    assert (minhash.N_HASHES, minhash.BANDS, minhash.SHINGLE, minhash.THRESHOLD) == (128, 8, 5, 0.8)


@pytest.mark.parametrize("text, lang", [
    ("The boat was at the quay and the men of the town had gone to the inn for the night.", "en"), ("Das Boot war an dem Steg und die Leute sind nicht mit dem Wagen gekommen.", "de"),
    ("Le bateau est dans le port et les gens du village sont partis pour une fête.", "fr"), ("El barco está en el puerto y los hombres del pueblo se fueron a una fiesta con su gente.", "es"),
    ("老渔夫说今年的鱼比去年少了一半。", "zh"), ("short", "unknown"), ("1234 5678 9012 3456", "unknown"), (None, "unknown"), ("", "unknown"),
])
def test_language(spark, text, lang):
    from gristmill.scorers import language

    got = one(spark, language.detected, text)
    assert got["lang"] == lang and (got["conf"] > 0.6) == (lang != "unknown")


def test_toxicity(spark):
    from gristmill.scorers import toxicity

    df = spark.createDataFrame([(1, "You stupid idiot, you worthless loser."), (2, "A calm day."), (3, None), (4, "cunt cunt")], "id int, text string")
    rows = {r["id"]: r for r in toxicity.filtered(toxicity.with_scores(df)).collect()}
    assert rows[1]["insult"] == rows[1]["toxicity"] == round(1 - 0.45**4, 4) and rows[1]["is_toxic"] and rows[1]["toxicity_action"] == "flagged" and rows[4]["severe_toxicity"] > 0.5 and rows[4]["is_toxic"]
    assert not rows[2]["is_toxic"] and rows[3]["toxicity"] == 0.0
    assert {r["id"]: r["toxicity_action"] for r in toxicity.filtered(toxicity.with_scores(df), "filter").collect()}[1] == "filtered"
    own = toxicity.with_scores(df, scorer=lambda texts: {"toxicity": [0.9 if "calm" in t else 0.1 for t in texts]}, batch=3)
    assert {r["id"]: r["toxicity"] for r in own.collect()} == {1: 0.1, 2: 0.9, 3: 0.1, 4: 0.1} and toxicity.with_scores(df.limit(0)).count() == 0


def test_rewriting(spark):
    from gristmill.operators import rewrite

    body = "\n".join("The old boat was at the quay and the men of the town had gone to the inn for the night" for _ in range(3))
    df = spark.createDataFrame([(1, "too few words"), (2, None), (3, "Menu\n" + body + "\nHome"), (4, "one two\n" * 20)], "id int, text string")
    rows = {r["id"]: r for r in rewrite.rewritten(df).collect()}
    assert rows[1]["rewrite_status"] == rows[2]["rewrite_status"] == "too_short" and rows[4]["rewrite_status"] == "empty_result" and rows[1]["new_text"] is None
    assert rows[3]["new_text"] == body and rows[3]["rewrite_status"] in ("success", "quality_filtered")
    assert {r["id"]: r["rewrite_status"] for r in rewrite.rewritten(df, score=lambda m: F.lit(0.4)).collect()}[3] == "success"
    assert {r["id"]: r["rewrite_status"] for r in rewrite.rewritten(df, score=lambda m: F.lit(0.39)).collect()}[3] == "quality_filtered"


def test_language_models(spark):
    import math

    from gristmill.operators import lm

    train = spark.createDataFrame([(1, "a b a b c")], "id int, text string")
    df = spark.createDataFrame([(1, "a b a b c"), (2, "a b"), (3, None), (4, "x y z u v")], "id int, text string")
    got = {r["id"]: r["ppl"] for r in lm.bigram_perplexity(train, df, "id").collect()}
    uni = lambda w: ("a b a b c".split().count(w) + 1) / (5 + 3 + 1)
    p = lambda cb, ca, w: 0.7 * (cb / ca if ca else 0) + 0.3 * uni(w)
    want = math.exp(-sum(map(math.log, [p(2, 2, "b"), p(1, 2, "a"), p(2, 2, "b"), p(1, 2, "c")])) / 4)
    assert got[1] == pytest.approx(want) and got[2] is None and got[3] is None and got[4] == pytest.approx(1 / (0.3 * uni("x")))
    u = {r["id"]: r["ppl"] for r in lm.unigram_perplexity(train, df, "id").collect()}
    assert u[1] == pytest.approx(math.exp(-sum(math.log(uni(w)) for w in "a b a b c".split()) / 5)) and u[2] is None and 3 not in u


def test_dedup_keeps_rows_without_id(spark, monkeypatch):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (None, "x"), (2, "y")], "id int, text string")
    key = dedup.content_key(F.col("text"))
    want = [None, 0, 2]
    assert sorted((r["id"] for r in dedup.keep_one(df, key, "id").collect()), key=lambda i: (i is not None, i)) == want
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)  # the way for many ids
    assert sorted((r["id"] for r in dedup.keep_one(df, key, "id").collect()), key=lambda i: (i is not None, i)) == want


def test_similarity_and_small_helpers(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 4])], "a array<int>, b array<int>").select(minhash.similarity(F.col("a"), F.col("b"))).first()
    assert row[0] == 0.75
    assert one(spark, T.lm_normal, " a\t12  b3 ") == "a 00 b0" and one(spark, lambda c: T.truncated(c, 2), "a  b c") == "a b" and one(spark, lambda c: T.truncated(c, 5), "a  b c") == "a  b c"
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 5)], "k int, v int")
    assert sorted(map(tuple, dedup.first_by(df, ["k"], [F.col("v")]).collect())) == [(1, 1), (2, 5)]
    broken = spark.createDataFrame([(bytearray(b"a\xed\xa0\x80b"),)], "x binary").select(crawl.sanitized(F.col("x").cast("string")).alias("y")).first()["y"]
    assert broken.startswith("a\ufffd") and broken.endswith("b") and one(spark, crawl.sanitized, "ok") == "ok"


def test_dense_bands_find_links_at_the_threshold(spark):
    import random

    from gristmill.plans import catalog

    assert "minhash_clusters_dense" in catalog.queries()
    r = random.Random(3)
    rows = []
    for i in range(30):
        sig = [r.randrange(1 << 32) for _ in range(128)]
        other = list(sig)
        for k in r.sample(range(128), 25):
            other[k] = r.randrange(1 << 32)
        rows += [(2 * i, sig), (2 * i + 1, other)]
    sigs = spark.createDataFrame(rows, "id bigint, sig array<bigint>")
    assert {(x["a"], x["b"]) for x in minhash.similar_pairs(sigs, bands=32).collect()} == {(2 * i, 2 * i + 1) for i in range(30)}
