"""The operators for training text on small fixtures: brute force, round trips, and odd rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import abuse, labelled_pii, leaks, lex, main_body, near_duplicates, packing, personal, prose, repetition, stuffing, tokens

SCHEMA = "rec_id bigint, text string, url string, source string, _detected_lang string, segment string, n int, key string, id string, bucket int, doc_id bigint"
PROSE = "The old boat stood beside the quay, and nobody at the museum had ever seen such a quiet harbour in the winter. "


def frame(spark, texts, schema=SCHEMA):
    """Rows with the odd ones first: nulls, no text, a very long text, a repeated id; and columns whose names might clash."""
    odd = [(None, PROSE, None), (1, None, "http://a.example/x"), (2, "", None), (3, PROSE * 2000, ""), (4, "\n \n", None), (4, "one two", "x")]
    rows = odd + [(10 + i, t, f"http://www.site{i % 3}.example/p") for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, u, None, None, "s", 1, "k", "i", 2, i) for i, t, u in rows], schema)


def words(r, n):
    return [f"w{r.randint(0, 400)}" for _ in range(n)]


def brute_pairs(rows, n, threshold):
    sets = {}
    for i, t in rows:
        w = lex.words_han(t)
        sets[i] = set(zip(*(w[k:] for k in range(n)))) or {("", t)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = []
    for g in range(25):
        base = words(r, 120)
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 99))
            rows.append(" ".join(w) if r.random() < 0.9 else " ".join(base))
    rows += ["a b", "a b", "b a", "中文" * 30, "中文" * 30 + "字"]
    data = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "rec_id bigint, text string")
    want = brute_pairs(data, 3, 0.6)
    assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(df, n=3, threshold=0.6).collect()} == want
    # the same with buckets split into blocks
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(df, n=3, threshold=0.6).collect()} == want
    # and with every text of two copies taken for one of very many
    monkeypatch.setattr(near_duplicates, "HOT", 1)
    assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(df, n=3, threshold=0.6).collect()} == want
    groups = {x["rec_id"]: x["group_id"] for x in near_duplicates.near_duplicate_groups(df, n=3, threshold=0.6).collect()}
    assert len(groups) == len(rows) and all(groups[a] == groups[b] for a, b in want)


def test_bit_sliced_distances():
    r = np.random.default_rng(0)
    sketches = r.integers(0, 256, (200, near_duplicates.BITS // 8), dtype=np.uint8)
    sketches[100:] = sketches[:100]
    sketches[100:, 0] ^= 7
    bits = np.unpackbits(sketches, axis=1).astype(int)
    order = r.permutation(200)
    b = np.sort(r.integers(0, 3, 200))
    a1, a2 = near_duplicates.bucket_pairs(b, np.zeros(200, int), np.arange(200), sketches[order], radius=50)
    got = set(zip(a1.tolist(), a2.tolist()))
    s = bits[order]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if b[i] == b[j] and (s[i] != s[j]).sum() <= 50}
    assert got == want and want


def test_near_duplicates_odd_rows(spark):
    df = frame(spark, [PROSE * 3, PROSE * 3])
    assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(df, n=3, threshold=0.6).collect()} >= {(10, 11)}
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0 and near_duplicates.near_duplicate_groups(df.limit(0)).count() == 0


def test_statistics_do_not_depend_on_chunks():
    r = random.Random(2)
    for _ in range(60):
        t = "".join(r.choice(["the ", "Boat", "-", "\n", "\n\n", "42", ". ", "中文。", "Home\n", "é", "!"]) for _ in range(r.randint(0, 80)))
        whole = prose.statistics(t, 10**6)
        assert all(prose.statistics(t, k) == whole for k in (1, 2, 3, 7, 20))


def test_prose_of_other_languages():
    texts = [
        "O velho barco estava parado junto ao cais, e ninguém no museu tinha visto um porto tão calmo no inverno. A água subia devagar. Quando o sol se pôs, os homens foram para casa.",
        "Stara łódź stała przy nabrzeżu i nikt w muzeum nie widział tak cichego portu w zimie. Woda powoli się podnosiła. Gdy słońce zaszło, ludzie poszli do domu i nic już nie mówili.",
        "Старая лодка стояла у причала, и никто в музее не видел такой тихой гавани зимой. Вода медленно поднималась. Когда солнце село, люди ушли по домам и больше не говорили о ней.",
        "Il vecchio battello era fermo presso il molo e nessuno al museo aveva mai visto un porto così quieto. L'acqua saliva piano. Al tramonto gli uomini tornarono a casa.",
    ]
    assert [prose.verdict(prose.statistics(t)[1]) for t in texts] == ["prose"] * 4
    lists = ["\n".join(f"czerwona lampa {i}" for i in range(20)), "barco velho, porto calmo, lua nova, " * 20, "лодка / причал / музей\n" * 20, "12.5, 13.7, 99.1\n" * 20]
    assert "prose" not in [prose.verdict(prose.statistics(t)[1]) for t in lists]


def test_prose_statistics(spark):
    items = "\n".join(f"narrow pear {i} cm" for i in range(30))
    df = frame(spark, [PROSE * 5, items, PROSE * 5])
    rows = prose.text_statistics(df, chunk=500).collect()
    assert len(rows) == df.count()
    by = {}
    for x in rows:
        by.setdefault(x["rec_id"], []).append(x)
    assert by[10][0]["verdict"] == by[3][0]["verdict"] == "prose" and by[11][0]["verdict"] == "list" and by[1][0]["verdict"] == "empty" and len(by[4]) == 2
    assert by[3][0]["n_words"] == len(lex.words(PROSE)) * 2000
    assert prose.text_statistics(df.limit(0)).count() == 0


def test_token_estimates(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(PROSE.split() + ["1234", "gate-keeper's"]) for _ in range(r.randint(20, 200))) for _ in range(120)]
    df = frame(spark, texts).withColumn("_detected_lang", F.lit("en-GB"))
    model = tokens.fit(df)
    est = df.select("text", tokens.estimated(F.col("text"), F.col("_detected_lang"), model).alias("e")).collect()
    true = tokens.count_tokens([x["text"] for x in est])
    assert abs(sum(x["e"] for x in est) / sum(true) - 1) < 0.1
    assert all(x["e"] == 0 for x in est if not x["text"])
    assert tokens.token_budget(df, model).agg(F.sum("n_docs")).first()[0] == df.count()
    metrics = spark.createDataFrame([(1, "s", "gen1_output", sum(true)), (2, "s", "gen1_output", sum(true) * 3), (3, "s", "gen1_output", None), (4, None, "gen1_output", 5)], "run_id bigint, segment string, stage string, estimated_total_tokens bigint")
    assert {x["run_id"] for x in tokens.implausible_runs(df, metrics, model).collect()} == {2, 4}
    assert tokens.fit(df.limit(0)).keys() == model.keys()


PAGE = """Silver Otter
Home
Otters
About us
Contact

The Odd Rainfall Of Hillford

The old boat stood beside the quay, and nobody at the museum had ever seen such a quiet harbour in the winter.
Tweet this page | Pin it | E-mail to a friend
They opened the gate before noon and painted it.

Related articles
Narrow Harbour In Westmoor
> A thin nurse and a vivid council

© 2029 Silver Otter. All rights reserved."""


def test_main_body(spark):
    assert main_body.furniture_lines(PAGE, "http://www.silver-otter.example/x") == [1, 2, 3, 4, 5, 10, 13, 14, 15, 17]
    df = frame(spark, [PAGE])
    kept = {x["rec_id"]: x["text"] for x in main_body.main_text(df).collect()}
    assert kept[1] is None and kept[2] == "" and kept[10].startswith("The Odd Rainfall") and "Silver Otter" not in kept[10] and kept[10].endswith("painted it.")
    assert main_body.furniture(df.limit(0)).count() == 0


def test_furniture_of_unseen_wording():
    """Lines that stand in no table of the library, long ones included, among paragraphs; and body lines that look a little like them."""
    bad = [
        "To make your stay on our pages pleasant, we place small cookies on your device; by browsing further you consent to their use, which our privacy statement explains.",
        "Cookies: accept everything | only what is needed", "Sign up to our newsletter and get our stories by email", "Log in or create an account to post your comment",
        "Share on Chatter | Print this article", "Copyright 2017-2023 Amber Fox Ltd, all rights reserved", "Privacy notice | Terms of use | Contact us | Site map",
        "Previous story | Next story", "Page 3 of 9 | Next page »", "Diese Webseite verwendet Cookies, Details in unserer Datenschutzerklärung. Akzeptieren",
        "Bitte melden Sie sich an, um einen Kommentar zu schreiben.", "Ce site utilise des cookies, consultez notre politique de confidentialité.", "Suscríbase gratis a nuestro boletín", "本网站使用Cookie，请阅读隐私政策。 接受",
    ]
    good = [PROSE.strip(), "The cookies were warm, and the children ate them before the guests came.", "He would not comment on the price of the boat.", "Why the harbour was closed", "They share the print shop with a baker, who pays the rent."]
    found = [i for i, line in enumerate(bad) if main_body.furniture_lines("\n\n".join([good[0], line, good[0]])) != [3]]
    assert len(found) <= 1
    assert main_body.furniture_lines("\n".join(good), "https://amber-fox.example") == []


def test_the_region_decides():
    # a weak line between good ones stays, a weak good one among bad ones goes, the same scores at the edge are cut
    assert main_body.best_regions([4.0, -1.0, 4.0]) == [(0, 3)] and main_body.best_regions([-1.0, 4.0, -1.0]) == [(1, 2)]
    assert main_body.best_regions([-5.0, 1.0, -5.0, 4.0]) == [(3, 4)] and main_body.best_regions([4.0, -5.0, 4.0]) == [(0, 1), (2, 3)]
    assert main_body.best_regions([]) == [] and main_body.best_regions([-1.0, 0.0]) == []
    r = np.random.default_rng(2)
    changed = 0
    for _ in range(60):
        s = r.normal(0, 2, 9).round(1)
        best = 0.0
        for mask in range(1 << 9):
            keep = [bool(mask >> i & 1) for i in range(9)]
            n = sum(k and not (i and keep[i - 1]) for i, k in enumerate(keep))
            best = max(best, s[keep].sum() - main_body.PRICE * n)
        got = main_body.best_regions(s.tolist())
        assert sum(s[b:e].sum() - main_body.PRICE for b, e in got) == pytest.approx(best)
        kept = {i for b, e in got for i in range(b, e)}
        changed += kept != {i for i in range(9) if s[i] > 0}
        # without the right to break it up, the one maximum-scoring run
        one = main_body.best_regions(s.tolist(), 0.001)
        assert one or s.max() <= 0.001
    assert changed > 30


@pytest.fixture(scope="module")
def machine():
    own = [("Shut up, you moron, nobody wants you here.", True), ("The barge was moved by hand.", False)] * 20
    return abuse.fit(own, [PROSE] * 20)


def test_abuse(spark, machine):
    bad = ["Halt die Fresse, du verdammter Vollidiot.", "you are a stupid m0r0n", "shut up you i d i o t", PROSE * 3 + "You useless piece of shit, go to hell. " + PROSE * 3]
    good = ["Her bitch had a litter of five puppies in the kennel.", "Great tits and blue tits nested in the box near the pond.", PROSE, None, ""]
    s = machine.score(bad + good)
    assert (s[:4] >= abuse.THRESHOLD).all() and (s[4:] < abuse.THRESHOLD).all()
    u = machine.score([abuse.url_words(x) for x in ("http://a.example/porn-tube-hd/x", "https://a.example/middlesex-lines/x", None)])
    assert u[0] >= abuse.THRESHOLD > u[1]
    df = frame(spark, [t or "" for t in bad])
    assert abuse.abuse_scores(df, machine).where("is_abusive").select("rec_id").distinct().count() == 4
    assert abuse.abuse_scores(df.limit(0), machine).count() == 0


def test_windows_of_light_terms_count():
    r = np.random.default_rng(6)
    names = [f"t{i}" for i in range(30)]
    v = np.zeros((31, abuse.RANK))
    v[1:7, 0] = 0.35**0.5  # six terms that weigh little alone and much together
    v[7:] = r.normal(0, 0.3, (24, abuse.RANK))
    w = np.concatenate([[0], np.full(6, 0.05), r.normal(0, 0.5, 24)])
    model = abuse.Model({abuse.term(x): i for i, x in enumerate(names, 1)}, w, v, -1.0, {})
    docs = [names[:6], ["x"] * 5, []] + [[str(x) for x in r.choice([*names, "x", "y"], r.integers(1, 40))] for _ in range(60)]

    def brute(d):
        rows = [model.cache[x] for x in d]
        best = model.w0 if d else -np.inf
        for e in range(len(d)):
            if rows[e]:
                for b in range(max(0, e - abuse.WINDOW + 1), e + 1):
                    before = next((j for j in range(b - 1, -1, -1) if rows[j]), -99)
                    if rows[b] and (e - before >= abuse.SHORTEST):
                        t = sorted({x for x in rows[b : e + 1] if x})
                        best = max(best, model.w0 + w[t].sum() + 0.5 * (v[t].sum(axis=0) ** 2 - (v[t] ** 2).sum(axis=0)).sum())
        return best

    got = model.window_scores(docs)
    assert got[0] == pytest.approx(-1 + 0.3 + 15 * 0.35)
    assert got == pytest.approx(np.array([brute(d) for d in docs]))


def brute_share(text):
    w = lex.words(text)
    grams = list(zip(w, w[1:], w[2:], w[3:]))
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(4)}) / len(w) if w else 0.0


def test_repetition(spark, monkeypatch):
    r = random.Random(5)
    texts = []
    for _ in range(150):
        loop = " ".join(words(r, r.randint(4, 9))) + " "
        texts.append(loop * r.choice([0, 0, 0, 2, 4]) + " ".join(words(r, r.randint(5, 120))) + " " + loop * r.choice([0, 0, 3]))
    texts = [t for t in texts if not 0.2 < brute_share(t) < 0.4]
    df = frame(spark, texts).select(F.lit("t").alias("table_name"), F.col("rec_id").alias("row_id"), "text", "n")
    trusted = df.where("row_id % 3 = 1")
    rows = repetition.repetition(df, trusted).collect()
    assert len(rows) == df.count()
    by = {x["row_id"]: x for x in rows}
    for i, t in enumerate(texts):
        x = by[10 + i]
        assert x["repeated_share"] == pytest.approx(brute_share(t)) and x["is_repetitive"] == (brute_share(t) >= 0.3)
    assert by[3]["is_repetitive"] and not by[1]["is_repetitive"] and not by[2]["is_repetitive"] and not by[4]["is_repetitive"]
    # without trusted rows the texts without repeats are the target
    assert {x["row_id"]: x["is_repetitive"] for x in repetition.repetition(df, df.limit(0)).collect()} == {i: x["is_repetitive"] for i, x in by.items()}
    assert repetition.repetition(df.limit(0), df.limit(0)).count() == 0
    # the ratio decides: where it tells nothing, nothing is flagged
    monkeypatch.setattr(repetition, "log_ratios", lambda raw, target: np.ones(len(raw)))
    monkeypatch.setattr(repetition, "cut_at", lambda raw, ratio, share: 0.5)
    assert repetition.repetition(df, trusted).where("is_repetitive").count() == 0


def test_repetition_counts_every_trusted_row(spark, monkeypatch):
    known, real = [], repetition.log_ratios
    monkeypatch.setattr(repetition, "log_ratios", lambda raw, target: known.append((raw, target)) or real(raw, target))
    rows = spark.range(24_000).select(F.lit("t").alias("table_name"), F.col("id").alias("row_id"), F.format_string("w%d v%d", "id", F.col("id") % 7).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([("t", 24_000, "a b c d " * 5), ("t", None, "null id")], "table_name string, row_id bigint, text string"))
    trusted = rows.where("row_id < 22000 OR row_id >= 24000 OR row_id IS NULL").select("table_name", "row_id")
    got = repetition.repetition(rows, trusted.unionByName(trusted.where("row_id < 500")))
    assert got.count() == 24_002 and [x["row_id"] for x in got.where("is_repetitive").collect()] == [24_000]
    # a row labelled twice counts once, one that repeats itself or has no id not at all
    (raw, target), = known
    assert raw.sum() == 2 * 24_000 + 20 + 2 and target.sum() == 2 * 22_000


def test_ratios_are_of_hashed_ngrams():
    raw = np.zeros(2 * repetition.BUCKETS)
    raw[[0, 1, 2, 3]] = 50_000, 20_000, 50_000, 20_000
    target = np.zeros_like(raw)
    target[[0, 2]] = 900_000, 100_000
    ratio = repetition.log_ratios(raw, target)
    # what comes again speaks against the target; of what doesn't, the target's n-grams speak for it
    assert ratio[1] == ratio[3] == pytest.approx(np.log(repetition.MIX)) and ratio[0] > 0 > ratio[2] > ratio[1]
    assert repetition.cut_at(raw, ratio, 0.3) == pytest.approx(0.3 * ratio[1] + 0.7 * (ratio[0] + ratio[2]) / 2)
    docs = [["a", "b", "c", "d", "x", "a", "b", "c", "d"], [], ["a", "b", "c", "d"]]
    events, starts = repetition.hashed_events(docs, lex.Hashes())
    assert (events & 1).tolist() == [1, 1, 1, 1, 0, 1, 1, 1, 1] + [0] * 4 and starts.tolist() == [0, 9, 9, 13]
    assert events[0] >> 1 == events[5] >> 1 == events[9] >> 1 and events[0] >> 1 != events[1] >> 1


def test_personal(spark):
    t = "Write to Emil Brandmann at emil.b@mail.example; call 212-555-0142.\nApplicant with SSN 912 34 5678, file closed. Home address: 12 Willow Drive, Hillford\nContact [EMAIL] for a copy. The Hillford Union gave 300 coins."
    tagger = personal.trained()
    kinds = {k for _, _, _, k in personal.entities(tagger, [t])}
    assert kinds == set(personal.TYPES)
    m = personal.mask(tagger, [t, PROSE, None, ""])
    assert m[1:] == [PROSE, None, ""] and "Brandmann" not in m[0] and "[EMAIL] for a copy" in m[0] and "Hillford Union gave 300 coins" in m[0] and "[NAME]" in m[0]
    df = frame(spark, [t])
    assert {x["pii_type"] for x in personal.personal_types(df).where("rec_id = 10").collect()} == set(personal.TYPES)
    assert personal.masked_texts(df).count() == df.count() and personal.personal_types(df.limit(0)).count() == 0


def test_names_that_are_not_listed():
    given = "Zebulon Thessaly Ephraim Ottilie Casimir Yolanda Fergus Marisol Ludovic Perpetua Tadeusz Xiomara Barnaby Seraphina Evander Nkechi Oisín Rosalind Wendell Zsófia".split()
    surnames = "Ashgrove Trevelyan Kowalczyk Penhaligon Delacroix Oyelaran Bergqvist Marchetti Szabo Hollis".split()
    assert not {*given} & {*labelled_pii.GIVEN, *labelled_pii._OTHER_GIVEN} and not {*surnames} & {*labelled_pii._SURNAMES}
    places = ["Sincerely, {}", "My name is {} and I live here.", "The seller, {}, waited.", "Posted by {} on a rainy day.", "Ich heiße {} und wohne hier.", "Je m'appelle {} et j'écris."]

    def recall(names, places):
        got = personal.mask(personal.trained(), [p.format(n) for p in places for n in names])
        return np.mean([a == p.format("[NAME]") for a, (p, n) in zip(got, [(p, n) for p in places for n in names])])

    assert recall([f"{g} {surnames[i % 10]}" for i, g in enumerate(given)], places) >= 0.9
    assert recall([f"{g[0]}. {surnames[i % 10]}" for i, g in enumerate(given)], places) >= 0.8
    assert recall(["王小明", "李建国", "赵雅婷"], ["联系人：{}", "我叫{}，住在这里。", "{}先生住在河边。"]) >= 0.8
    plain = ["The Kelmark Laboratory gave 300 coins.", "Narrow Harbour In Westmoor", "两周以前，工程师听到钟声。", "Home | News | Shop | All Kettles"]
    assert personal.mask(personal.trained(), plain) == plain


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(1)
    tagger = personal.trained()
    e = r.normal(0, 2, (4, personal.N)).astype(np.float32)
    got = tagger.viterbi(e, np.array([0]), np.array([4]))[0].tolist()
    best = max(itertools.product(range(personal.N), repeat=4), key=lambda p: tagger.first[p[0]] + sum(e[i, p[i]] for i in range(4)) + sum(tagger.trans[a, b] for a, b in zip(p, p[1:])))
    assert got == list(best)


def test_packing(spark):
    r = random.Random(6)
    sizes = [r.randint(0, 300) for _ in range(2000)] + [1500, 511, 512, 513]
    out = packing.pack(sizes, 513, 1)
    load = {}
    for n, pieces in zip(sizes, out):
        assert sum(k for _, k in pieces) == n and (len(pieces) > 1) == (n + 1 > 513)
        for b, k in pieces:
            load[b] = load.get(b, 0) + k + 1
    assert max(load.values()) <= 513 and sum(load.values()) / (513 * len(load)) > 0.95
    df = frame(spark, [PROSE * 400])
    specs = spark.createDataFrame([(1, "a", 513, 1), (2, "b", 2048, 1)], "spec_id bigint, spec_name string, capacity_tokens bigint, separator_tokens bigint")
    rows = packing.packed(packing.sizes(df), specs)
    assert rows.groupBy("spec_id").agg(F.count_if(F.col("part_no") == 0).alias("n")).where(f"n = {df.count()}").count() == 2
    assert rows.groupBy("spec_id", "container_id").agg(F.sum(F.col("part_tokens") + 1).alias("u")).where("u > IF(spec_id = 1, 513, 2048)").count() == 0
    assert packing.packed(packing.sizes(df.limit(0)), specs).count() == 0


def test_leaks(spark):
    r = random.Random(7)
    item = words(r, 40)
    half = item[10:32]
    changed = list(item)
    changed[8] = changed[20] = changed[30] = "other"
    few = item[:8]
    docs = [" ".join(words(r, 50) + item + words(r, 50)), " ".join(words(r, 30) + half), ". ".join(changed).upper(), " ".join(few + words(r, 60)), " ".join(words(r, 100))]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, "")], "item_id bigint, prompt string")
    df = frame(spark, docs)
    assert {(x["doc_id"], x["item_id"]) for x in leaks.leaked_items(df, items).collect()} == {(10, 7), (11, 7), (12, 7)}
    assert leaks.leaked_items(df.limit(0), items).count() == 0 and leaks.leaked_items(df, items.limit(0)).count() == 0


def test_suffix_array():
    r = np.random.default_rng(3)
    seq = r.integers(0, 4, 300).astype(np.uint64)
    a = leaks.SuffixArray(seq)
    q = np.array([[0, 1, 2, 3], [1, 1, 1, 1], [2, 0, 3, 1]])
    lo, hi = a.find(q)
    for row, x, y in zip(q, lo, hi):
        want = [i for i in range(297) if (seq[i : i + 4] == row).all()]
        assert sorted(a.order[x:y].tolist()) == want


NOUNS = "boat quay museum harbour winter bell gate road tower bridge lantern meadow orchard cellar violin kettle saddle anchor ladder basket".split()


def prose_pages(r, n):
    say = ["The {} of the {} was moved by the {}, and nobody in the {} had seen it.", "When we came to the {}, a {} stood there and the {} was gone.", "It is not clear why the {} should have been under the {} for so many years.", "She gave them {} and {} after the {} had closed."]
    return ["\n".join(" ".join(r.choice(say).format(*(r.choice(NOUNS) for _ in range(4))) for _ in range(6)) for _ in range(4)) for _ in range(n)]


def stuffed(r):
    links = "\n".join(f"[{r.choice(NOUNS)} buy](http://a{i}.example/x)" for i in range(30))
    keywords = ", ".join(f"velvet kettle {r.choice(NOUNS)}town" for _ in range(60))
    tags = " ".join(f"#own{r.choice(NOUNS)}{i}" for i in range(50))
    turned = " ".join("Looking for a velvet kettle? Every velvet kettle is the velvet kettle you want." for _ in range(25))
    polish = ", ".join(f"tani czajnik {r.choice(NOUNS)}owo" for _ in range(60))
    return [links, keywords, tags, turned, polish]


def test_stuffed_pages(spark, monkeypatch):
    r = random.Random(8)
    pages = prose_pages(r, 300)
    recipe = pages[0] + "\n" + "\n".join(f"{r.randint(1, 900)} ml {r.choice(NOUNS)}" for i in range(8)) + "\n" + pages[1]
    df = frame(spark, pages + [recipe, *stuffed(r)]).cache()
    rows = stuffing.stuffed_pages(df).collect()
    assert len(rows) == df.count()
    assert {x["doc_id"] for x in rows if x["is_stuffed"] and x["doc_id"] is not None and x["doc_id"] >= 10} == {311, 312, 313, 314, 315}
    assert {(x["log_perplexity"], x["abnormal_share"]) for x in rows if x["doc_id"] == 2} == {(0.0, 0.0)}
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0
    # the perplexity decides: where every one of them is usual, nothing is flagged
    monkeypatch.setattr(stuffing, "TAIL", 0.0)
    monkeypatch.setattr(stuffing, "usual_range", lambda pages, model: {False: (0.0, 99.0), True: (0.0, 99.0)})
    assert stuffing.stuffed_pages(df).where("is_stuffed").count() == 0


def test_stuffed_pages_model_is_of_all_prose(spark):
    df = frame(spark, prose_pages(random.Random(9), 40))
    pages = stuffing.read_pages(df)
    model = stuffing.counted(pages)
    assert model.pair.sum() == model.triple.sum() == sum(len(x["ids"]) // 2 for x in pages.where("is_prose").collect())
    # batches of rows don't change the sequences
    texts = [x["text"] or "" for x in df.select("text").collect()]
    ids, begin = stuffing.sequences(stuffing._Classes(), texts)
    for t, a, b in zip(texts, begin[:-1], begin[1:]):
        assert stuffing.sequences(stuffing._Classes(), [t])[0].tolist() == ids[a:b].tolist()
    # surprise of a text alone and among others
    whole = model.surprise(ids, begin)
    assert np.allclose(whole[begin[6] : begin[7]], model.surprise(ids[begin[6] : begin[7]], np.array([0, begin[7] - begin[6]])))


def test_leaks_with_insertions_and_short_items(spark):
    r = random.Random(11)
    data, want = [], set()
    for n, size in enumerate((40, 80, 160, 320, 640)):
        item = words(r, size)
        put_in = [w for k, w in enumerate(item) for w in ([w, f"new{r.randint(0, 99)}"] if k % 9 == 8 else [w])]
        left_out = [w for k, w in enumerate(item) if k % 9 != 8]
        clustered = list(item)
        for k in range(size // 8):  # all changes in one place, four words apart
            clustered[min(size - 1, size // 4 + 4 * k)] = "other"
        spoiled = [w if k % 4 else "other" for k, w in enumerate(item)]
        for j, ws in enumerate((put_in, left_out, clustered, item[: size // 2 + 1], spoiled)):
            data.append((100 * n + j, " ".join(words(r, 300) + ws + words(r, 200))))
            if j < 4:
                want.add((100 * n + j, n))
        data.append((100 * n + 9, None))
        if n == 0:
            items = []
        items.append((n, " ".join(item)))
    items += [(50, "zebra quartz"), (51, "lone")]
    data += [(900, "a zebra, quartz b"), (901, "quartz zebra"), (902, "so lone it was")]
    want |= {(900, 50), (902, 51)}
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = leaks.leaked_items(docs, spark.createDataFrame(items, "item_id bigint, prompt string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == want
    assert all(x["verbatim_words"] == 8 or x["verbatim_words"] == 9 for x in rows if x["doc_id"] % 100 == 0 and x["doc_id"] < 500)
    assert all(x["verbatim_words"] >= (100 * 0 + 21) for x in rows if x["doc_id"] % 100 == 3)


def test_abuse_of_unseen_wording(machine):
    bad = [
        "What a stupid moron you are, shut up already.", "You filthy bastard, I will break your legs.", "These foreigners are vermin, drive them out of the town.", "Such an idiot, nobody asked you, worthless loser.",
        "Fuck off, you ugly cunt.", "Du bist doch ein Arschloch, halt die Fresse.", "Quel connard, ferme ta gueule.", "Cállate ya, hijo de puta.", "You are s t u p i d, you m o r o n.", "what an 1d10t, you st*pid m0ron",
    ]
    good = [
        "You are the best of the class and we are proud of you.", "They are all welcome, and every one of them brings a cake.", "The vermin in the barn were driven out by two cats.", "A stupid mistake in the plan cost them a week.", "What they did to the bridge was a shame.",
        "The film shows how cruel the guards were to the prisoners.", "Breast milk is best for the baby in the first months.", "Only a few of them are left.", "Adult education and evening classes in Middlesex", "Shut the gate, you may lose a goat.",
    ]
    s = machine.score(bad + good)
    assert (s[: len(bad)] >= abuse.THRESHOLD).sum() >= 8 and (s[len(bad) :] < abuse.THRESHOLD).sum() >= 8
    # pairs of words decide: without their vectors fewer are found
    alone = abuse.Model(machine.rows, machine.w, np.zeros_like(machine.v), machine.w0, machine.masked)
    assert (alone.score(bad) >= abuse.THRESHOLD).sum() < (s[: len(bad)] >= abuse.THRESHOLD).sum()
