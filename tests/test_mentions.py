"""Landed mentions: broken answers, a fold over services against a walk, leads of cases, what is read of a table by service."""

import json
import random
import tempfile

from pyspark.sql import functions as F

from attestor.functions import results
from attestor.operators import mentions
from attestor.sources import mentions as landed

HIT = "case long, kind string, query string, id long, provider string, place int, title string, url string, snippet string, author string"


def test_result_pages():
    nested = '<div class=result><a class=result__a href=/1>A <i>b</i><script>x</script></a><div class="result z"><span class="result__snippet">s<br>t</span><a class="result__a" href="/2">C</a></div></span></div>'
    assert results.results(nested) == [{"title": "A b", "href": "/1", "snippet": "s t"}, {"title": "C", "href": "/2", "snippet": "s t"}]
    assert results.results("<p class=result><a class=result__a>no href") == [{"title": "no href", "href": "", "snippet": None}]
    assert results.results("</div><a class=result__a href=/x>outside</a><div class='results'>") == []
    assert len(results.results("<div class=result>" * 3000 + "</p>" * 3000 + "<a class=result__a href=/x>y</a>")) == 3000


def test_answers_of_any_shape(spark):
    bodies = {
        "hn-algolia": [json.dumps({"hits": [{"objectID": "7", "title": "", "story_title": " a  b "}, 3, None, {"url": "u", "title": "x" * 300}]}), '{"hits":{}}', "[]", "none", None, ""],
        "reddit-search": [json.dumps({"data": {"children": [{"data": {"permalink": "/r/x", "url": "u", "title": "t"}}, {"data": 3}, {"data": {"permalink": "r", "url": "u2"}}]}})],
        "searxng": [json.dumps({"results": [{"href": "h"}, {"title": "none"}] + [{"url": f"u{k}"} for k in range(9)]})],
        "duckduckgo-html": ["<p class=result><a class=result__a href='//d/l/?uddg=https%3A%2F%2Fx.example%2F'>t</a></p>" * 12 + "<p class=result></p>"],
        "unknown": ['{"items":[{"title":"t"}]}'],
    }
    rows = [(k, p, 200, b) for p, bs in bodies.items() for k, b in enumerate(bs)] + [(9, "hn-algolia", 503, '{"hits":[{"url":"u"}]}'), (10, "hn-algolia", None, '{"hits":[{"url":"u"}]}')]
    got = landed.hits(spark.createDataFrame(rows, "id long, provider string, status int, body string")).orderBy("provider", "id", "place").collect()
    of = lambda p, i=0: [(r["place"], r["read"], r["url"]) for r in got if r["provider"] == p and r["id"] == i]
    assert of("hn-algolia") == [(0, True, "https://news.ycombinator.com/item?id=7"), (1, False, None), (2, False, None), (3, True, "u")]
    assert [r["title"] for r in got if r["provider"] == "hn-algolia" and r["id"] == 0] == ["a b", None, None, "x" * 180]
    assert all(of("hn-algolia", i) == [(None, False, None)] for i in (1, 2, 3, 4, 5, 9, 10)) and of("unknown") == [(None, False, None)]
    assert of("reddit-search") == [(0, True, "https://www.reddit.com/r/x"), (1, False, None), (2, True, "u2")]
    assert [r["snippet"] for r in got if r["provider"] == "reddit-search"] == ["t", None, ""]
    assert [u for _, read, u in of("searxng") if read] == ["h", "u0", "u1", "u2", "u3"] and len(of("searxng")) == 11
    page = of("duckduckgo-html")
    assert [u for _, read, u in page if read] == ["https://x.example/"] * 10 and len(page) == 13
    assert landed.hits(spark.createDataFrame([], "id long, provider string, status int, body string, extra int")).count() == 0


def test_services_are_folders(spark):
    path = tempfile.mkdtemp() + "/landed"
    spark.range(20).select(F.col("id").cast("string"), F.lit(200).alias("status"), F.lit('{"items":[{"link":"https://a.example/"}]}').alias("body"), F.when(F.col("id") % 2 == 0, "google-cse").otherwise("searxng").alias("provider")).write.partitionBy("provider").parquet(path)
    some = landed.read(spark, path, ("google-cse",))
    assert "PartitionFilters: [isnotnull(provider" in some._jdf.queryExecution().toString()
    assert landed.hits(some).where("read").count() == 10 and landed.read(spark, path).count() == 20


def test_requests(spark):
    q = spark.createDataFrame([(1, "@nick"), (2, " "), (3, None)], "id long, text string")
    got = landed.requests(q).collect()
    assert [r["provider"] for r in got] == [p for p in landed.PROVIDERS if p != "google-cse"] and all(r["id"] == 1 for r in got)
    assert dict(got[2]["params"]) == {"q": "nick in:title,body", "per_page": "5"} and got[1]["params"]["hitsPerPage"] == "20"


def walked(rows, order, cap):
    """One service after the other, as a person would."""
    seen, sources, dup = {}, {}, {}
    for provider in order:
        taken = 0
        for _, p, place, key in sorted(r for r in rows if r[1] == provider):
            if key in seen:
                dup[provider] = dup.get(provider, 0) + 1
                if provider not in sources[key]:
                    sources[key].append(provider)
            elif taken < cap:
                taken, seen[key], sources[key] = taken + 1, (provider, place), [provider]
    return {(*seen[k], k, tuple(sources[k])) for k in seen}, dup


def test_hits_that_stay(spark):
    rnd = random.Random(3)
    order, rows = tuple("abcd"), []
    for case in range(12):
        for provider in "abcdz":
            # the last cases have long answers with few different pages
            rows += [(case, provider, place, f"https://x.example/{rnd.randrange(40 if case < 9 else 400)}") for place in range(rnd.randrange(30 if case < 9 else 300))]
    m = spark.createDataFrame([(c if c else None, p, k, u) for c, p, k, u in rows], "case long, provider string, place int, url string").repartition(5)
    got = mentions.collected(m, ["case"], 3, order).collect()
    answers = m.withColumn("status", F.lit(200))
    counted = {(r["case"], r["provider"]): r for r in mentions.collection_coverage(answers, m, ["case"], 3, order).collect()}
    for case in range(12):
        want, dup = walked([r for r in rows if r[0] == case], order, 3)
        key = case if case else None
        assert {(r["provider"], r["place"], r["url"], tuple(r["sources"])) for r in got if r["case"] == key} == want
        for p in order:
            r = counted.get((key, p))
            assert r is None or (r["rejected_duplicate"], r["deduped"]) == (dup.get(p, 0), sum(w[0] == p for w in want))
    assert len(got) == sum(len(walked([r for r in rows if r[0] == c], order, 3)[0]) for c in range(12))


def test_leads_of_cases(spark):
    rows = [(1, ["@a", " a ", None, "b"], "b", "X Y", "HTTPS://www.Site.example:8/p", None), (1, None, "@@c", None, " ", "e@x.example"), (2, None, None, None, None, None)]
    got = mentions.case_leads(spark.createDataFrame(rows, "case long, usernames array<string>, username string, name string, website string, email string")).orderBy("ord").collect()
    assert {(r["case"], r["kind"], r["lead"]) for r in got} == {(1, "username", "a"), (1, "username", "b"), (1, "username", "c"), (1, "name", "X Y"), (1, "domain", "site.example"), (1, "email", "e@x.example")}
    assert mentions.case_leads(spark.range(3).withColumnRenamed("id", "case")).count() == 0


def test_hits_are_judged_by_their_own_query(spark):
    rows = [
        (1, "name", "Ann Lee", 5, "a", 0, "Ánn  LEE and nick1", "https://s.example/", "mail q@x.example", None),
        (1, "name", "Ann Lee", 5, "a", 1, "nick1 only", "https://s.example/", None, None),
        (None, "name", "Ann Lee", 6, "a", 0, "ann lee, nick1", "https://s.example/", None, None),
        (2, "username", "@nick1", 7, "a", 0, "Ann Lee", "https://s.example/@Nick1?x", "", ""),
        (2, "username", "@nick1", 7, "a", 1, "nick12 nick1_", "https://s.example/", "", "nick1"),
        (2, "website", "https://www.s.example/q", 8, "b", 0, "t", "http://sub.S.example/", None, None),
        (2, "email", "q@x.example", 9, "b", 0, "Q@X.example", "ftp://s.example/", None, None),
        (2, None, "nick1", 10, "b", 0, "nick1", "https://s.example/", None, None),
    ]
    leads = spark.createDataFrame([(1, "username", "nick1", 0), (1, "email", "q@x.example", 1), (2, "email", "none@x.example", 0)], "case long, kind string, lead string, ord long")
    m = mentions.judged(spark.createDataFrame(rows, HIT), leads)
    got = {(r["id"], r["place"]): r for r in mentions.as_findings(m).collect()}
    assert set(got) == {(5, 0), (6, 0), (7, 0), (7, 1), (8, 0), (10, 0)}
    assert (got[5, 0]["relevance"], got[5, 0]["reason"], got[5, 0]["associated"]) == ("ASSOCIATED", "name_plus_username", ["nick1", "q***@x.example"])
    assert (got[6, 0]["relevance"], got[6, 0]["associated"]) == ("AMBIGUOUS", [])
    assert (got[7, 0]["match_type"], got[7, 0]["confidence"], got[7, 1]["matched_field"], got[7, 1]["confidence"]) == ("url_path_segment", "MEDIUM", "author", "LOW")
    assert (got[8, 0]["kind"], got[8, 0]["excerpt"], got[8, 0]["domain"]) == ("domain", "sub.s.example", "sub.s.example")
    assert got[7, 0]["match_class"] == "EXACT_MATCH" and got[10, 0]["kind"] == "username"
    assert mentions.judged(spark.createDataFrame([], HIT), leads).count() == 0


def test_masked_addresses(spark):
    got = spark.createDataFrame([("ann@x.example",), ("@x",), ("nick",), ("a@b@c",)], "t string").select(mentions.masked_address(F.col("t")).alias("m"))
    assert [r["m"] for r in got.collect()] == ["a***@x.example", "****@x", "nick", "a***@b@c"]


def test_cases_do_not_meet_each_others_hits(spark, monkeypatch):
    """names of all cases share a key, and a hit still meets the leads of its own case only."""
    from attestor.operators import discovery, mentions

    met = []

    def counted(df, what="step", real=discovery.cut):
        out = real(df, what)
        if what == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(discovery, "cut", counted)
    rows = [(c if c else None, "name", f"Ann Lee{c}", f"h{c}", "hn-algolia", 200, 0, f"Ann Lee{c}", f"https://a.example/{c}", "", "") for c in range(40)]
    hits = spark.createDataFrame(rows, "case long, kind string, query string, id string, provider string, status int, place int, title string, url string, snippet string, author string")
    leads = spark.createDataFrame([(c, "name", f"Ann Lee{c}", 0) for c in range(1, 40)], "case long, kind string, lead string, ord long")
    got = {(r["case"], r["lead"], r["matched_field"]) for r in mentions.judged(hits, leads).collect()}
    assert got == {(c if c else None, f"Ann Lee{c}", "title") for c in range(40)} and met == [40]


def test_items_of_long_answers_are_made_once(spark):
    body = json.dumps({"results": [{"url": f"u{k}" if k % 2 else ""} for k in range(20)]})
    df = landed.hits(spark.createDataFrame([(0, "searxng", 200, body)], "id long, provider string, status int, body string"))
    assert [(r["place"], r["url"]) for r in df.orderBy("place").collect() if r["read"]] == [(1, "u1"), (3, "u3"), (5, "u5"), (7, "u7"), (9, "u9")]
    # no item is made inside of what is done for each other item
    assert df._jdf.queryExecution().optimizedPlan().toString().count("$.results") == 1
