"""Rules against plain versions over lists: blocking, clusters, variants of handles, chains, registrations, website forms."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_engine import clusters_by_hand

from attestor.functions import ids, text, times, urls
from attestor.operators import catalog, discovery, graph, identity, reports
from attestor.plans import catalogue, lead_queries, views
from attestor.sources import landed, steps

RECORD = "case_id long, ord long, platform string, username string, display_name string, organization string, location string, domain string, public_id string, email string, url string, avatar string, bio string, profile_url string, links array<string>"


def records(spark, rng, n=60):
    pick = lambda *xs: rng.choice(xs)
    bios = ["I write about distributed storage engines and kernels", "Storage engines and kernels, distributed, about which I write", "none", None, ""]
    rows = [
        (k % 2, k, f"p{k}", pick("u", "v", ""), pick("Ann Lee", "Bob Ray", "x", None, ""), pick("o1", "o2", None), pick("l1", "l2", None), pick("d1", "d2", None, None, None, None), pick("i1", "i2", None, None, None, None), pick("e1", "e2", None, None, None, None), pick("w1", "w2", None, None, None, None), pick("a1", "a2", None), pick(*bios), f"https://s/{k}", pick(None, [], [f"https://s/{rng.randrange(n)}"]))
        for k in range(n)
    ]
    return spark.createDataFrame(rows, RECORD)


def test_blocking_loses_no_notable_pair(spark):
    rng = random.Random(3)
    for drop in ([], ["bio"], ["avatar", "links"], ["url", "avatar", "bio", "links", "profile_url"]):
        r = records(spark, rng).drop(*drop)
        left, right = r.select("case_id", F.col("ord").alias("a")), r.select("case_id", F.col("ord").alias("b"))
        every = left.join(right, "case_id").where("a < b")
        want = sorted(map(tuple, identity.compare(r, every).where("score >= 30").collect()))
        assert sorted(map(tuple, identity.notable_pairs(r).collect())) == want and want


def test_clusters_of_tables_are_those_of_lists(spark):
    rng = random.Random(5)
    scores = {(c, a, b): rng.choice([20, 40, 60, 61, 80]) for c in range(3) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.5}
    pairs = spark.createDataFrame([(c, a, b, s, f"e{s}" if s != 61 else "", "x,y" if s == 80 else "", False) for (c, a, b), s in scores.items()], "case_id long, left_ord long, right_ord long, score long, evidence string, conflicts string, strong_conflict boolean")
    groups = {}
    rows = identity.clusters(pairs).collect()
    for r in rows:
        groups.setdefault((r["case_id"], r["cluster"]), []).append(r["ord"])
    for case in range(3):
        of = {(a, b): s for (c, a, b), s in scores.items() if c == case}
        assert sorted(sorted(g) for (c, _), g in groups.items() if c == case) == clusters_by_hand(of, 14)
    for r in rows:
        inside = [s for (c, a, b), s in scores.items() if c == r["case_id"] and {a, b} <= set(groups[c, r["cluster"]])]
        assert r["score"] == min(inside) and r["evidence"] == ",".join(sorted({f"e{s}" for s in inside if s != 61})) and r["conflicts"] == ("x,y" if 80 in inside else "")


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {90: 90, 100: 90}
    assert graph.components(edges.limit(0)).count() == 0


def test_variants_of_handles_meet(spark):
    rng = random.Random(8)
    words, seps = ["ann", "bo", "shop", "x1", "12", "real", "1"], ["_", "-", ".", "", "__"]
    handle = lambda: rng.choice(["", "@", ""]) + rng.choice(seps).join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "7", "_9"])
    asked, seen = sorted({handle() for _ in range(60)}), sorted({handle() for _ in range(150)} | {"1abc", "21abc", "Ann.Official", "", "ann_abcdef", "ann_abcdefg"})
    req, obs = spark.createDataFrame([(x,) for x in asked], "requested string"), spark.createDataFrame([(x,) for x in seen], "observed string")
    every = req.crossJoin(obs).withColumn("match", ids.username_match(F.col("requested"), F.col("observed"))).where("match <> 'UNRELATED'")
    assert sorted(map(tuple, discovery.similar_handles(req, obs).collect())) == sorted(map(tuple, every.collect()))
    one = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(ids.username_match(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert one("1abc", "21abc") == "SIMILAR_CANDIDATE" and one("abc", "abcd") == "UNRELATED"


def test_mentions_need_whole_leads(spark):
    pages = spark.createDataFrame([("a", "Joann Leeds", "", "", ""), ("b", "", "see @bob_x or bobx", "http://h/", ""), ("c", "", "", "https://www.sub.x.com/q?user=bobx", ""), ("d", "", "mail mann@b.com.br now", "", ""), ("e", None, "notx.com x.com.", None, "Bob"), ("f", "Zoé  LÉE and bob", "", "", "bob"), ("g", "", "", "", "")], "id string, title string, snippet string, url string, author string")
    leads = spark.createDataFrame([("name", "ann lee"), ("name", "Zoe Lee"), ("name", "bob"), ("username", "bobx"), ("username", "bo"), ("username", "@Bob"), ("domain", "x.com"), ("email", "ann@b.com"), ("email", "nobody"), ("domain", None)], "kind string, lead string")
    got = {(r["id"], r["lead"]): (r["field"], r["relevance"], r["reason"]) for r in discovery.mention_matches(pages, leads).collect()}
    assert got == {
        ("a", "ann lee"): ("title", "AMBIGUOUS", "full_name_only"), ("b", "bobx"): ("snippet", "DIRECT", "exact_username"), ("c", "bobx"): ("url", "DIRECT", "username_path"), ("c", "x.com"): ("url", "DIRECT", "exact_domain"),
        ("d", "ann@b.com"): ("snippet", "DIRECT", "exact_email"), ("e", "x.com"): ("snippet", "DIRECT", "exact_domain"), ("e", "@Bob"): ("author", "DIRECT", "exact_username"), ("f", "Zoe Lee"): ("title", "ASSOCIATED", "name_plus_username"), ("f", "@Bob"): ("title", "DIRECT", "exact_username"),
    }
    assert discovery.mention_matches(pages, leads.limit(0)).count() == discovery.mention_matches(pages.limit(0), leads).count() == 0


def test_small_rules(spark):
    at = lambda f, *vs: [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "k int, v string").coalesce(1).select(f(F.col("v"))).collect()]
    assert at(urls.registrable, "a.b.co.uk", "x.ru", "a.edu", "co.uk", "www.x.com", "localhost", "a.unknownsuffix") == ["b.co.uk", "x.ru", "a.edu", None, "x.com", None, None]
    assert at(urls.host_of, "https://[2001:db8::1]:8080/x", "http://U:p@H.example:80", "nohost") == ["2001:db8::1", "h.example", ""]
    assert at(urls.profile_shape, "https://s/en/users/bob/posts", "https://s/p/1", "https://s/authors/x", "https://s/@bob", "https://s/users") == [True, True, False, True, False]
    assert at(lambda c: urls.candidate_handle(c, F.lit("@Bob")), "https://s/en/user/Al/x", "https://s/x/@Cy", "https://s/zzz/bob", "https://s/ab/bob99", "https://s/zzz", "https://s/") == ["al", "cy", "bob", "bob99", "zzz", ""]
    assert [str(x) for x in at(times.parse_instant, "20241105", "20240305", "20240115996000", "202401150700001", "2024", " 20240229 ", "20230229")] == ["2024-01-10 05:00:00", "2024-03-05 00:00:00", "2024-01-15 00:00:00", "2024-01-15 07:00:00", "None", "2024-02-02 09:00:00", "2023-02-02 09:00:00"]
    assert at(lambda c: text.excerpt(c, F.lit("B")), "a b c", "x" * 200, "", None, "y" * 60 + "b" + "z" * 60) == ["a b c", "x" * 180, "", "", "…" + "y" * 45 + "b" + "z" * 45 + "…"]
    assert at(urls.unwrapped, "//d/l/?uddg=https%3A%2F%2Fx.com%2F%3Fa%3D1&r=2", " https://x ") == ["https://x.com/?a=1", "https://x"]
    assert at(reports.mention_key, "HTTPS://X.com/a//?Q=1#f", "X/Y/") == ["https://x.com/a?Q=1", "x/y"]
    assert at(catalog.slug_of, " Dev.to — x ", "") == ["dev-to-x", ""]


def test_registration_falls_back(spark):
    body = '{"arin_originas0_originautnum": 7, "entities": [{"handle": "AS9", "roles": ["registrant"]}], "nameservers": null}'
    r = landed.registrations(spark.createDataFrame([(1, body), (2, '{"entities":[{"handle":"x"},{"handle":"as9"}]}'), (3, None)], "id int, body string")).orderBy("id").collect()
    assert [x["asn"] for x in r] == ["AS7", "AS9", None]


def test_chains_of_any_length(spark):
    line = [(0, None), *((k, k - 1) for k in range(1, 101)), (500, 499)]
    circle = [(200, 202), (201, 200), (202, 201), (203, 202), (300, 300)]
    runs = spark.createDataFrame([*line, *circle, (7, 6)], "run_id long, parent_run_id long").repartition(3)
    want = {(k, 0, k, False) for k in range(101)} | {(500, 500, 0, False)} | {(k, None, None, True) for k, _ in circle}
    assert {tuple(r) for r in reports.run_chains(runs).collect()} == want
    assert reports.run_chains(runs.limit(0)).collect() == []


def test_leads_of_any_script_and_ids_that_repeat(spark):
    text = "мой иван! и (___) на пример.рф, ждиван x@рф.рф - а -.-"
    pages = spark.createDataFrame([(1, "", text, "", ""), (1, "", "иван", "", ""), (1, "", "иван", "", ""), (2, "", "", "https://www.пример.рф/q", "$$$"), (3, "", "Ｗｉｄｅ ﬁrst", "", "a___")], "id long, title string, snippet string, url string, author string")
    leads = spark.createDataFrame([("username", "Иван"), ("username", "___"), ("domain", "пример.рф"), ("email", "x@рф.рф"), ("username", "-.-"), ("username", "$$$"), ("name", "wide first"), ("username", "- -")], "kind string, lead string")
    got = sorted((r["id"], r["lead"], r["field"]) for r in discovery.mention_matches(pages, leads).collect())
    assert got == sorted([(1, "Иван", "snippet")] * 3 + [(1, "___", "snippet"), (1, "пример.рф", "snippet"), (1, "x@рф.рф", "snippet"), (1, "-.-", "snippet"), (2, "пример.рф", "url"), (2, "$$$", "author"), (3, "wide first", "snippet")])


def test_decomposition_is_unicodes(spark):
    import unicodedata

    points = [k for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    df = spark.createDataFrame([(k, f"a{chr(k)}\u0301\u0323") for k in points], "k long, t string").select("k", text.decomposed(F.col("t")).alias("d"), text.unmarked(F.col("t")).alias("u"))
    for r in df.toLocalIterator():
        d = unicodedata.normalize("NFKD", f"a{chr(r['k'])}\u0301\u0323")
        assert r["d"] == d and r["u"] == "".join(c for c in d if not unicodedata.combining(c)), hex(r["k"])


def test_a_pattern_that_is_none_stands_for_itself(spark):
    from attestor.operators import checks

    lists = {c: [] for c in ("captcha_patterns", "challenge_patterns", "blocked_patterns", "login_patterns", "soft_404_patterns", "profile_markers")}
    row = {"name": "S", "check_method": "html", "requires_auth": False, "expected_status": [200], "not_found_status": [404], "not_found_patterns": ["gone (", "nobody[ ]here"], "redirect_home": None, "redirect_search": None, "confidence_strategy": None} | lists
    pages = spark.createDataFrame([(1, "GONE ( for good"), (2, "gone"), (3, "Nobody here")], "id long, html string").selectExpr("id", "'S' AS site", "'https://s.example/bob' AS url", "'https://s.example/bob' AS final_url", "200 AS status", "html", "'bob' AS handle")
    got = {r["id"]: r["check_status"] for r in checks.classify_pages(pages, spark.createDataFrame([row], checks.SITE)).collect()}
    assert got == {1: "NOT_FOUND", 2: "INCONCLUSIVE", 3: "NOT_FOUND"}


def test_steps_are_removed_but_for_what_is_kept(spark):
    import os

    with steps.passing(spark) as kept:
        a = steps.cut(spark.range(5), "a")
        path = a.inputFiles()[0]
        b = kept(a.where("id > 1"))
    assert b.count() == 3 and not os.path.exists(path.removeprefix("file://"))


def test_planned_queries_have_all_families(spark):
    leads = [(1, "username", "bob", 1), (1, "username", "al", 2), (1, "name", "Ann Lee", 3), (1, "email", "a@b.c", 4), (1, "domain", "x.com", 5), (1, "domain", "y.com", 6)]
    got = [r["text"] for r in discovery.query_plan(spark.createDataFrame(leads, "case long, kind string, lead string, ord long"), 50).orderBy("place").collect()]
    assert got == ['"bob"', '"a@b.c"', '"x.com"', '"y.com"', '"Ann Lee"', '"al"', "@bob", "@al", "inurl:bob", "inurl:al", '"bob" profile', '"al" profile', '"Ann Lee" "bob"', '"Ann Lee" "al"', '"bob" "x.com"', '"bob" "y.com"', '"al" "x.com"', '"al" "y.com"', '"Ann Lee" "x.com"', '"Ann Lee" "y.com"']
    assert lead_queries.LEADS


def test_equal_records_are_compared_once(spark):
    """F5 to F8: copies of records are a class each; two classes give their pairs without being compared for each, and count them without making any."""
    rows = [(1, k, f"p{k % 17}", f"u{k % 3}", f"ann lee{k % 2}", None if k % 3 else "", "d.example" if k % 2 else None) for k in range(120)]
    r = spark.createDataFrame(rows, "case_id long, ord long, platform string, username string, display_name string, organization string, domain string")
    r = r.withColumns({c: F.lit(None).cast("string") for c in ("location", "public_id", "email")})
    each, members = identity.classes(r)
    assert (each.count(), members.count(), identity.class_scores(each).count()) == (6, 120, 9)
    every = r.select("case_id", F.col("ord").alias("a")).join(r.select("case_id", F.col("ord").alias("b")), "case_id").where("a < b")
    want = identity.compare(r, every).where("score >= 30")
    assert sorted(map(tuple, identity.notable_pairs(r).collect())) == sorted(map(tuple, want.collect()))
    by_band = {b["band"]: b["count"] for b in want.groupBy("band").count().collect()}
    got = identity.band_counts(r).first()
    assert got["pairs"] == 7140 and [got[b.lower()] for b in ("STRONG", "LIKELY", "POSSIBLE")] == [by_band.get(b, 0) for b in ("STRONG", "LIKELY", "POSSIBLE")]
    assert got["max_score"] == want.agg(F.max("score")).first()[0] and sum(by_band.values()) == 1770


def test_handles_are_not_sent_through_the_driver(spark):
    """keys of handles are many times their table's files; none of the tables is broadcast."""
    plan = lead_queries.username_match_class(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_pairs_of_a_large_class_are_made_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(identity, "PAIRS_A_TASK", 1_000, raising=False)
    monkeypatch.setattr(identity, "BLOCK", 10, raising=False)
    rows = [(1, k, f"p{k:03}", "u", "Ann Lee", None, None, "d.example", None, None) for k in range(150)]
    r = spark.createDataFrame(rows, "case_id long, ord long, platform string, username string, display_name string, organization string, location string, domain string, public_id string, email string")
    got = identity.notable_pairs(r).withColumn("task", F.spark_partition_id()).select("left_ord", "right_ord", "task").collect()
    assert sorted((a, b) for a, b, _ in got) == [(a, b) for a in range(150) for b in range(a + 1, 150)]
    most = max(sum(t == task for _, _, t in got) for task in {t for _, _, t in got})
    assert most < len(got) / 2


def test_an_address_after_another_and_addresses_in_one_run_are_met(spark):
    texts = ["x a@b@c.dd", "a@b.com.x@y.zz, q@w.ee", "ab@cd.ef@gh.ij -@k.lm"]
    pages = spark.createDataFrame([(k, "", t, "", "") for k, t in enumerate(texts)], "id long, title string, snippet string, url string, author string")
    leads = spark.createDataFrame([("email", "b@c.dd"), ("email", "q@w.ee"), ("email", "-@k.lm")], "kind string, lead string")
    assert sorted((r["id"], r["lead"]) for r in discovery.mention_matches(pages, leads).collect()) == [(0, "b@c.dd"), (1, "q@w.ee"), (2, "-@k.lm")]
    found = lambda p: F.regexp_extract_all("snippet", F.lit(f"({p})"), F.lit(1))
    assert all(a == b and a for a, b in pages.select(found(text.EMAIL_IN_TEXT), found(text.EMAIL_RUN)).collect())


def test_clusters_of_classes_are_those_of_their_records():
    """which records join follows the order of all pairs, though no pair is made."""
    rng = random.Random(11)
    several = 0
    for _ in range(400):
        n, names = rng.randrange(2, 40), rng.sample(range(1000), rng.randrange(1, 9))
        of = [rng.choice(names) for _ in range(n)]
        names = rng.sample(sorted(set(of)), len(set(of)))
        scores = {(a, b): rng.choice([60, 61, 80]) for k, a in enumerate(names) for b in names[k:] if rng.random() < rng.choice([0.3, 0.9])}
        ords = rng.sample(range(1000), n)
        ords = rng.choice([ords, sorted(ords), sorted(ords)[::-1]])
        score = lambda a, b: scores.get((a, b), scores.get((b, a)))
        want = identity.greedy_clusters([(score(of[x], of[y]), ords[x], ords[y]) for x in range(n) for y in range(x + 1, n) if score(of[x], of[y])])
        got = identity.class_clusters(scores, np.array(ords), np.array(of), rng.choice([1, 3, 1000]))
        assert got.tolist() == [want.get(k, k) for k in ords]
        several += len(set(want.values())) > 1
    assert several > 100


def test_clusters_of_records_are_those_of_their_pairs(spark):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    rows = [(k % 2, 3 * k, f"p{rng.randrange(50)}", pick("u", "v"), pick("Ann Lee", "Bob Ray", None), pick("o1", None), pick("l1", None), pick("d1", "d2"), pick("i1", None, None), pick("e1", "e2", None), *[None] * 3, f"https://s/{k % 9}", pick(None, [f"https://s/{rng.randrange(9)}"])) for k in range(240)]
    full = spark.createDataFrame(rows, RECORD)
    for r in (full, full.drop("profile_url", "links"), full.drop("profile_url", "links").limit(0)):
        want = sorted(map(tuple, identity.clusters(identity.notable_pairs(r)).collect()))
        assert sorted(map(tuple, identity.record_clusters(r).collect())) == want
        assert (len({(w[0], w[2]) for w in want}) > 5) == bool(want)


def test_clusters_of_a_large_class_write_no_pairs(spark, monkeypatch):
    """300 equal records make 44,850 pairs; no step of the query is longer than the records."""
    written = []

    def counted(cut):
        def step(df, what="step"):
            out = cut(df, what)
            written.append(out.count())
            return out

        return step

    for module in (identity, graph):
        monkeypatch.setattr(module, "cut", counted(module.cut))
    rows = [(1, k, f"p{k}", "u", "Ann Lee", None, None, "d.example", None, None) for k in range(300)]
    r = spark.createDataFrame(rows, "case_id long, ord long, platform string, username string, display_name string, organization string, location string, domain string, public_id string, email string")
    monkeypatch.setattr(views, "records", lambda s, d: r)
    got = catalogue.QUERIES["identity_clusters"](spark, "").collect()
    assert sorted(map(tuple, got)) == [(1, k, 0, 64, "LIKELY", "same_display_name,same_personal_domain,same_username", "") for k in range(300)]
    assert max(written) == 300
