"""The engine on small tables: rules, merges, windows, sources and sinks."""

import datetime as dt
import importlib
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import ids, text, times, urls
from attestor.operators import checks, discovery, findings, graph, identity, merging, runs, scoring
from attestor.sources import landed, sinks
from attestor.streaming import windows


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "kind"),
    [("d41d8cd98f00b204e9800998ecf8427e", "HASH"), ("8.8.8.8", "IP"), ("256.1.1.1", "USERNAME"), ("a@b.co", "EMAIL"), ("https://x.example/a", "URL"), ("AS123", "ASN"), ("12345", "ASN"), ("Example.com", "DOMAIN"), ("a.notasuffix", "USERNAME"), ("under_score", "USERNAME"), ("+49 (30) 1234567", "PHONE"), ("Some Company", "COMPANY"), ("", None)],
)
def test_entity_type(spark, value, kind):
    assert one(spark, value, ids.entity_type) == kind


def test_entity_id(spark):
    assert one(spark, "example.com", lambda v: ids.entity_id(F.lit("DOMAIN"), v)) == "fb40cbd06d305d196dc4ac5c"


@pytest.mark.parametrize(
    ("url", "want"),
    [("Example.COM", "https://example.com/"), ("HTTP://User:pw@Host.com:80/A?q=1#f", "http://host.com/A?q=1"), ("https://h:8443", "https://h:8443/")],
)
def test_canonical(spark, url, want):
    assert one(spark, url, urls.canonical) == want


def test_urls(spark):
    assert one(spark, "http://www.h.com/a/?utm_source=x&b=1#f", urls.identity) == "https://h.com/a?b=1"
    assert one(spark, "http://xn--a.zip/%41", urls.risk_flags) == ["punycode", "suspicious_tld.zip", "encoded_url"]
    assert [one(spark, u, urls.syntax_reason) for u in ("ftp://a", "http://u@h/", "http://10.1.2.3/", "http://localhost", "https://ok.example/")] == ["scheme", "credentials", "blocked_ip", "blocked_host", None]
    assert one(spark, "a.b.co.uk", urls.registrable) == "b.co.uk" and one(spark, "a.b.com", urls.registrable) == "b.com" and one(spark, "a.nope", urls.registrable) is None
    assert [one(spark, i, urls.private_ipv4) for i in ("192.168.1.1", "8.8.8.8", "x")] == [True, False, None]


@pytest.mark.parametrize(
    ("obs", "want"),
    [("Alice_Shop", "EXACT_MATCH"), ("@alice_shop", "EXACT_MATCH"), ("alice-shop", "SIMILAR_CANDIDATE"), ("aliceshop", "SIMILAR_CANDIDATE"), ("alice_shop99", "SIMILAR_CANDIDATE"), ("12.alice_shop", "SIMILAR_CANDIDATE"), ("alice_shop.dev", "SIMILAR_CANDIDATE"), ("shop_alice", "SIMILAR_CANDIDATE"), ("alice_shop_nyc", "SIMILAR_CANDIDATE"), ("bob", "UNRELATED"), ("", "UNRELATED"), ("malice_shopper", "UNRELATED")],
)
def test_username_match(spark, obs, want):
    row = spark.createDataFrame([("alice_shop", obs)], "a string, b string").select(ids.username_match(F.col("a"), F.col("b")).alias("m")).first()
    assert row["m"] == want


def test_times(spark):
    got = [one(spark, v, times.parse_instant) for v in ("20240115", "2024011507", "20240115073000", "202401159", "nope", "2024-01-15T10:00:00Z")]
    d = dt.datetime
    assert got == [d(2024, 1, 1, 5), d(2024, 1, 15, 7), d(2024, 1, 15, 7, 30), d(2024, 1, 15), None, d(2024, 1, 15, 10)]
    assert [one(spark, s, times.duration_text, "long") for s in (5, 65, 3700, -1)] == ["5s", "1m 5s", "1h 1m 40s", "0s"]


def test_text(spark):
    assert one(spark, "secretvalue", ids.mask) == "se*******ue" and one(spark, "abc", ids.mask) == "***"
    assert one(spark, "token = abc123 sk-abcdefghijkl", sinks.redacted) == "token = **** ****"
    spf = one(spark, "v=spf1 include:_spf.x.com -all", text.spf_terms)
    assert [(t["qualifier"], t["mechanism"], t["value"]) for t in spf] == [("+", "include", "_spf.x.com"), ("-", "all", "")]
    assert one(spark, "v=DMARC1; p=reject; RUA=mailto:a@b.c", text.dmarc_tags) == {"v": "DMARC1", "p": "reject", "rua": "mailto:a@b.c"}
    assert one(spark, "mx1.Google.com", text.mail_provider) == "Google Workspace"
    m = spark.createDataFrame([({"password": "hunter22", "a": "b"},)], "m map<string,string>").select(sinks.masked_map(F.col("m")).alias("k"), sinks.stripped_map(F.col("m")).alias("s")).first()
    assert m["k"] == {"password": "hu****22", "a": "b"} and m["s"] == {"a": "b"}


F_SCHEMA = "case_id long, ord long, target_type string, module string, title string, check_status string, status string, confidence string, detections long, n_flags long, abuse double, has_evidence boolean"


def finding(ord_, detections=None, flags=0, abuse=None, case=1, target="USERNAME", status="FOUND", check="CONFIRMED"):
    return (case, ord_, target, "username", f"s{ord_}", check, status, None, detections, flags, abuse, False)


def level_by_fold(rows):
    level = "LOW"
    for r in sorted(rows, key=lambda r: r[1]):
        d, f, a = r[8], r[9], r[10]
        if d and d >= 5:
            level = "CONFIRMED_BY_PROVIDER"
        elif d and level == "LOW":
            level = "HIGH_RISK"
        if f and level == "LOW":
            level = "SUSPICIOUS"
        if a and a >= 75:
            level = "CONFIRMED_BY_PROVIDER"
        elif a and a >= 25 and level == "LOW":
            level = "SUSPICIOUS"
    return level


def test_risk_level_is_the_fold(spark):
    rng, rows = random.Random(1), []
    for case in range(300):
        rows += [finding(o, rng.choice([None, None, 0, 1, 4, 5]), rng.choice([0, 0, 2]), rng.choice([None, None, 24.0, 25.0, 74.0, 75.0]), case) for o in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    got = {r["case_id"]: r["risk_level"] for r in scoring.score_cases(spark.createDataFrame(rows, F_SCHEMA).repartition(3)).collect()}
    assert got == {c: level_by_fold([r for r in rows if r[0] == c]) for c in got}


def test_scores(spark):
    rows = [finding(k, check="CONFIRMED" if k < 9 else "LIKELY") for k in range(20)] + [finding(99, 50, 9, 39.9, check="NOT_FOUND", status="NOT_FOUND")]
    r = scoring.score_cases(spark.createDataFrame(rows, F_SCHEMA)).first()
    assert (r["confidence_score"], r["risk_score"], r["reputation_score"]) == (56, 100, 30)
    v = findings.view_partition(spark.createDataFrame(rows, F_SCHEMA), "case_id").first()
    assert v["whole"] and v["checked"] == 21 and v["found"] == 20


def clusters_by_hand(scores, n, least=60):
    groups = [{k} for k in range(n)]
    for a, b in sorted(scores, key=lambda p: (-scores[p], p)):
        x, y = (next(g for g in groups if k in g) for k in (a, b))
        if scores[a, b] >= least and x is not y and all(scores.get((min(i, j), max(i, j)), 0) >= least for i in x for j in y):
            groups.remove(y)
            x |= y
    return sorted(sorted(g) for g in groups if len(g) > 1)


def test_clusters_are_complete_link():
    rng = random.Random(3)
    for _ in range(200):
        n = 8
        scores = {(a, b): rng.randrange(40, 100) for a in range(n) for b in range(a + 1, n)}
        of = identity.greedy_clusters((s, a, b) for (a, b), s in scores.items() if s >= 60)
        groups = {}
        for k, c in of.items():
            groups.setdefault(c, []).append(k)
        assert sorted(sorted(g) for g in groups.values()) == clusters_by_hand(scores, n)


def test_compare(spark):
    rows = [(1, 1, "p1", "u", "Ann Lee", "org", None, "d.example", None, "a@x.example"), (1, 2, "p2", "u", "Ann Lee", "org", None, "d.example", None, "a@x.example"), (1, 3, "p3", "u", "Bob Ray", None, None, "d.example", None, "b@x.example"), (1, 4, "p4", "u", None, None, None, None, None, None)]
    rec = spark.createDataFrame(rows, "case_id long, ord long, platform string, username string, display_name string, organization string, location string, domain string, public_id string, email string")
    got = {(r["left_ord"], r["right_ord"]): r for r in identity.compare(rec, identity.candidate_pairs(rec)).collect()}
    assert got[1, 2]["score"] == 100 and got[1, 2]["band"] == "STRONG"
    assert got[1, 3]["strong_conflict"] and got[1, 3]["score"] <= 24 and (1, 4) not in got
    assert identity.clusters(identity.notable_pairs(rec)).count() == 2


def test_compare_optional_fields(spark):
    n = None
    bio = "I write about distributed storage engines and kernels"
    rows = [
        (1, 1, "p1", "u", n, "org", "loc", n, n, n, "https://a.example/x", "k1", bio, "https://s.example/u1", ["https://t.example/u2"]),
        (1, 2, "p2", "u", n, "org", "loc", n, n, n, "https://a.example/x", n, bio + " too", "https://t.example/u2", n),
        (1, 3, "p3", "v", n, n, n, n, n, n, n, "k1", "hello", "https://r.example/u3", n),
        (1, 4, "p4", "u", n, "org", "loc", n, n, n, n, n, bio, n, n),
    ]
    cols = "case_id long, ord long, platform string, username string, display_name string, organization string, location string, domain string, public_id string, email string, url string, avatar string, bio string, profile_url string, links array<string>"
    rec = spark.createDataFrame(rows, cols)
    got = {(r["left_ord"], r["right_ord"]): r for r in identity.compare(rec, identity.candidate_pairs(rec)).collect()}
    assert got[1, 2]["score"] == 100 and got[1, 2]["evidence"] == "cross_profile_link,same_location,same_organization,same_personal_url,same_username,similar_bio"
    assert (1, 3) not in got, "an avatar alone (18) can't reach a band"
    assert got[1, 4]["score"] == 34 and got[1, 4]["band"] == "POSSIBLE"
    assert (2, 3) not in got


def test_graph(spark):
    e = spark.createDataFrame([(1, "a", "b", "X", "Y", "R1", "s", "LOW", "ev1"), (2, "a", "b", "X", "Y", "R2", "t", "HIGH", None), (3, "b", "c", "Y", "Z", "R1", "s", "LOW", None), (4, "c", "a", "Z", "X", "R1", "s", "LOW", None)], "ord long, src string, dst string, src_type string, dst_type string, relation string, source string, confidence string, evidence_id string")
    g = graph.build(e)
    r = g.where("src = 'a'").first()
    assert (r["relation"], r["confidence"], r["evidence_id"], r["observed"]) == ("R2", "HIGH", "ev1", 2)
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert sorted((x["id"], x["depth"]) for x in graph.reach(g, seeds, 5).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.cytoscape(g).count() == 6 and not any("None" in x["line"] for x in graph.graphml(g).collect())


def test_merges(spark):
    rows = [("e", 1, dt.datetime(2024, 1, 2), "LOW", "s1", "t1"), ("e", 2, dt.datetime(2024, 1, 1), "HIGH", "s2", "t2")]
    seen = spark.createDataFrame(rows, "entity string, ord long, ts timestamp_ntz, confidence string, source string, tag string")
    r = merging.merge_entities(seen).first()
    assert (r["confidence"], r["tags"]) == ("LOW", "t1,t2")
    up = merging.upsert_entities(seen.where("ord = 2"), seen.where("ord = 1")).first()
    assert up["confidence"] == "LOW" and not up["inserted"]
    m = spark.createDataFrame([(k, "p", f"u{k // 2}", 1) for k in range(20)], "ord long, provider string, url string, query long")
    assert sorted(r["ord"] for r in merging.dedupe_mentions(m, ["url", "query"]).collect()) == [0, 2, 4, 6, 8]


def test_pivots_are_the_loop(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice(["username", "url", "email"]), f"v{rng.randrange(6)}", *rng.choice([("NOVEL", 100), ("NOVEL", 50), ("REDUNDANT", 0), ("KNOWN", 0)]), k) for k in range(90)]
    got = {r["ord"]: r["reason"] for r in discovery.propose_pivots(spark.createDataFrame(rows, "c long, kind string, norm string, novelty string, priority long, ord long"), "c", 4).collect()}
    for case in range(3):
        seen, accepted = set(), 0
        for _, kind, norm, novelty, _, o in sorted((r for r in rows if r[0] == case), key=lambda r: (-r[4], r[1], r[5])):
            if novelty != "NOVEL":
                want = "redundant" if novelty == "REDUNDANT" else "not_novel"
            elif (kind, norm) in seen:
                want = "duplicate"
            elif accepted >= 4:
                want = "budget"
            else:
                want, accepted = None, accepted + 1
                seen.add((kind, norm))
            assert got[o] == want


def test_spacing_and_streaks(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, rng.randrange(1000), rng.random() < 0.4) for k in range(90)]
    df = spark.createDataFrame(rows, "key long, ord long, at_us long, ok boolean")
    got = {r["ord"]: r["release"] for r in runs.spaced(df, "key", 50).collect()}
    streaks = {r["ord"]: (r["streak"], r["open"]) for r in runs.failure_streaks(df, "key").collect()}
    for key in range(3):
        last, streak = None, 0
        for _, o, at, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            last = at if last is None else max(at, last + 50)
            assert got[o] == last
        for _, o, _, ok in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            streak = 0 if ok else streak + 1
            assert streaks[o] == (streak, streak >= 3)


def test_landed(spark):
    body = '[{"id":1,"name_value":"a.x.com\\n*.x.com","issuer_name":"i","not_before":"2024"},{"id":1,"name_value":"dup"},{"id":null,"name_value":"n1"},{"id":null,"name_value":"n2"}]'
    df = spark.createDataFrame([("q", body), ("bad", "no json")], "id string, body string")
    certs = landed.certificates(df)
    assert certs.count() == 2
    names = {(r["name"], r["kind"]) for r in landed.certificate_names(certs.withColumn("domain", F.lit("x.com"))).collect()}
    assert names == {("a.x.com", "SUBDOMAIN")}, "a domain is no name of its own, and n1 is no host"
    rdap = '{"ldhName":"X.COM","status":["active"],"nameservers":[{"ldhName":"NS1.X.COM."}],"events":[{"eventAction":"registration","eventDate":"2020"}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Reg Inc"]]]}]}'
    r = landed.registrations(spark.createDataFrame([("q", rdap)], "id string, body string")).first()
    assert (r["domain"], r["nameservers"], r["registered"]) == ("x.com", ["ns1.x.com"], "2020")
    c = landed.archive_captures(spark.createDataFrame([("q", '[["urlkey","timestamp"],["k","2020"],["k","2019"]]')], "id string, body string")).first()
    assert (c["count"], c["first"], c["last"]) == (2, "2019", "2020")
    dns = spark.createDataFrame([("x.com", "A", "1.2.3.4"), ("x.com", "MX", "10 aspmx.l.google.com."), ("x.com", "TXT", "v=spf1 -all")], "domain string, rrtype string, value string")
    assert {(r["target"], r["relation"]) for r in landed.dns_entities(dns).collect()} == {("1.2.3.4", "RESOLVES_TO"), ("aspmx.l.google.com", "HAS_MX"), ("Google Workspace", "USES")}
    assert landed.mail_policies(dns).count() == 1
    vt = '{"data":{"attributes":{"last_analysis_stats":{"malicious":3,"suspicious":2}}}}'
    rep = landed.reputation(spark.createDataFrame([("e", "virustotal", vt), ("e", "abuseipdb", '{"data":{"abuseConfidenceScore":80}}')], "id string, provider string, body string"))
    assert {(r["provider"], r["detections"], r["abuse"]) for r in rep.collect()} == {("virustotal", 5, None), ("abuseipdb", 0, 80.0)}
    assert landed.threat_panel(rep, ["virustotal", "abuseipdb"]).first()["virustotal"] == 5


def test_checks(spark):
    from attestor.plans.check_queries import SITES

    u, handle = "https://s.example/ann_1", "@Ann_1"
    t = lambda title, extra="": f"<title>{title}</title>{extra}"
    rows = [("Plain", u, u, 200, t("ann_1 here"), handle), ("Plain", u, u, 200, None, handle), ("Plain", u, u, 200, t("joann_12"), handle), ("Plain", u, "https://s.example/", 200, t("x y"), handle), ("Plain", None, u, 200, t("ann_1", "captcha"), handle), ("Plain", u, u, 200, t("ann_1"), None), ("Nowhere", u, u, 200, "", handle)]
    got = [(r["check_status"], r["reason"]) for r in checks.classify_pages(spark.createDataFrame(rows, "site string, url string, final_url string, status int, html string, handle string").coalesce(1), spark.createDataFrame(SITES, checks.SITE)).collect()]
    assert got == [("LIKELY", "username in title/og:title"), ("INCONCLUSIVE", "HTTP 200 is not proof (final_url_only)"), ("INCONCLUSIVE", "HTTP 200 is not proof (final_url_only)"), ("NOT_FOUND", "redirect_home"), ("CAPTCHA_REQUIRED", "captcha presented — not solved"), ("INCONCLUSIVE", "HTTP 200 is not proof (http_200_not_proof)")]
    js = [(200, '{"user":{"login":"Ann"}}', "$.user.login", "@ann"), (200, '{"them":[{"id":"bob"}]}', "$.them[0].id", "ann"), (200, "{}", "$.user.login", "ann"), (200, "oops", "$.a", "ann")]
    got = [r["check_status"] for r in checks.classify_json(spark.createDataFrame(js, "status int, body string, id_path string, handle string").coalesce(1)).collect()]
    assert got == ["CONFIRMED", "LIKELY", "NOT_FOUND", "INCONCLUSIVE"]
    cat = spark.createDataFrame([("s", "https://s.example/{username}", True), ("t", "x", False)], "site string, url_template string, enabled boolean")
    assert [r["profile_url"] for r in checks.handles_by_site(spark.createDataFrame([("@Ann",)], "handle string"), cat).collect()] == ["https://s.example/ann"]


def test_streams_agree_with_tables(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(600)), k % 4, rng.choice(["view", "error"]), float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "1 hour", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    table = {(r["window_start"], r["event_type"]): (r["n"], r["total"]) for r in windows.tumbling(df, "1 hour").collect()}
    assert {(r["window_start"], r["event_type"]): (r["n"], r["total"]) for r in spark.sql("SELECT * FROM w").collect()} == table
    ok = stream.select("user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "view").alias("ok"))
    q = windows.circuit_stream(ok).writeStream.format("memory").queryName("c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = df.select("user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "view").alias("ok"))
    want = {(r["ord"], r["streak"], r["open"]) for r in runs.failure_streaks(batch, "user_id").collect()}
    assert {(r["ord"], r["streak"], r["open"]) for r in spark.sql("SELECT * FROM c").collect()} == want


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("DOMAIN", "x.com", "HIGH", "dns", ["b", "a"], "token = abcdef")], "type string, value string, confidence string, source string, tags array<string>, note string")
    assert sinks.csv_rows(e).first()["tags"] == "b,a"
    assert "abcdef" not in sinks.json_lines(e).first()["value"]
    for fmt in ("parquet", "json", "csv", "orc"):
        sinks.write(e.drop("tags"), f"{tmp_path}/{fmt}", fmt)
        assert landed.read_table(spark, f"{tmp_path}/{fmt}", fmt).count() == 1


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 55
    assert entry.entry(spark).count() > 0
