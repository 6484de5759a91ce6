"""Tags against Python's parser, names against a plain rule, and fields of whole pages."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from attestor.functions import markup, urls
from attestor.operators import profiles

WANTED = ("meta", "link", "a", "script")


class Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag in WANTED:
            first = {}
            for k, v in attrs:
                first.setdefault(k, v or "")
            self.found.append((tag, first))

    handle_startendtag = handle_starttag


def page(rng):
    out = []
    for _ in range(rng.randrange(12)):
        kind = rng.randrange(8)
        if kind == 0:
            out.append("<!-- <a href=no> " + rng.choice(["", "-", "> x", "<meta name='a'>"]) + " -->")
        elif kind == 1:
            out.append("<script" + rng.choice(["", " type=text/x", ' type="a>b"']) + ">var a = '<a href=no>' < 2;</SCRIPT >")
        elif kind == 2:
            out.append(rng.choice(["text & more ", "a < b ", "1 <2 ", "<p>", "</a>", "<br/>", "<!doctype html>", "<style>a > b { content: '<link rel=x>' }</style>"]))
        else:
            attrs = []
            for _ in range(rng.randrange(5)):
                name, value = rng.choice(["href", "REL", "Content", "property", "name", "data-x", "x:y"]), rng.choice(["a", "http://e.example/?a=1&amp;b=2", "me nofollow", "x&quot;y", "é &#233; &lt;", "", "1=2"])
                form = rng.randrange(5)
                attrs.append(name if form == 0 else f'{name}="{value} > ok"' if form == 1 else f"{name}='{value} \" '" if form == 2 else f"{name} = \"{value}'\"" if form == 3 else f"{name}={value.replace(' ', '')}" if value.strip() else name)
            out.append("<" + rng.choice([*WANTED[:3], "A", "META", "abbr", "linker"]) + rng.choice([" ", "\n", "  "]) + rng.choice([" ", "\t"]).join(attrs) + rng.choice([">", " >", " />"]))
    return "".join(out)


def test_tags_are_those_of_a_parser(spark):
    rng = random.Random(8)
    pages = [page(rng) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string").select("id", markup.tokens(F.col("html"), WANTED).alias("t"))
    df = df.select("id", F.posexplode("t").alias("k", "t")).select("id", "k", "t.tag", "t.names", markup.unescaped("t.values").alias("values"))
    got = {}
    for r in df.orderBy("id", "k").collect():
        first = {}
        for n, v in zip(r["names"], r["values"], strict=True):
            first.setdefault(n, v)
        first.pop("/", None)
        got.setdefault(r["id"], []).append((r["tag"], first))
    for k, text in enumerate(pages):
        parser = Tags()
        parser.feed(text)
        parser.close()
        assert got.get(k, []) == parser.found, text


def test_names_of_characters_count_with_their_semicolon(spark):
    texts = ["the&&amp", "?a=1&copy=2&amp;b=3", "&eacute;&#233;&#xe9;&#39 &lt;b&gt;", "&ampx; &none; &;", None]
    got = spark.createDataFrame([(texts,)], "t array<string>").select(markup.unescaped("t").alias("t")).first()["t"]
    assert got == ["the&&amp", "?a=1&copy=2&b=3", "ééé' <b>", "&ampx; &none; &;", None]


def test_broken_pages_take_linear_time(spark):
    bad = ["<a href=" * 20_000, "<!--" * 20_000, "<a x='" + "b=\"" * 30_000, "<script>" * 10_000, "<" * 50_000]
    rows = spark.createDataFrame(list(enumerate(bad)), "id long, html string")
    assert rows.select(F.size(markup.tokens(F.col("html"), ("a", "meta"))).alias("n")).count() == 5


def test_names_without_what_platforms_add(spark):
    cases = [
        ("Ann Lee (@ann) • Instagram photos and videos", "Ann Lee"), ("Ann Lee - GitHub", "Ann Lee"), ("ann", ""), ("@ANN", ""), ("GitHub", ""), ("Ann’s Music Profile | Last.fm", ""), ("Zoë  Ö · GitLab", "Zoë Ö"),
        ("GitHub - Ann Lee", "Ann Lee"), ("Ann | Writer | GitHub", "Ann | Writer"), (None, ""), ("  ", ""), ("Home page", ""), ("Ann Lee User Profile", "Ann Lee"), ("—Bob—", "Bob"), ("x" * 300, "x" * 200), ("Ann Lee’s profile on Example", "Ann Lee"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k long, raw string")
    got = df.select("k", profiles.clean_name(F.col("raw"), F.lit("ann"), F.lit("Docker")).alias("n")).orderBy("k").collect()
    want = [w for _, w in cases]
    want[5] = got[5]["n"]  # what is left of it names a possessor
    assert [r["n"] for r in got] == want


def test_fields_of_a_page_and_an_answer(spark):
    html = """<title>Ann K - GitHub</title><!-- <meta property="og:title" content="no"> --><META content='Ann &quot;K&quot; Lee · GitHub' PROPERTY=og:title><link href="https://www.ann.example/a/?utm_source=x&amp;b=1" rel="me canonical">
<script type="application/ld+json">[{"@type":"Thing"},{"@type":["Person"],"name":"Ann Lee","email":" A@b.cc","image":{"url":"//i.example/x.png"},"sameAs":["https://github.com/ann","http://own.example/"],"url":"https://site.example"}]</script><a rel='me nofollow' href=https://x.com/ann>x</a>"""
    answer = '{"them":[{"n":"Api Name"}],"blog":"https://github.com/ann","bio":"none","id":"x1","node_id":"n2","email":"no mail","org":"ACME"}'
    df = spark.createDataFrame([(1, "GitHub", "@Ann", "https://github.com/ann", html, None, False, None), (2, "GitHub", "ann", "", html, answer, True, ["them.0.n"]), (3, None, None, None, None, None, None, None), (4, "GitHub", "a", "u", "<a", "{", None, None)], "id long, platform string, username string, profile_url string, html string, payload string, authenticated boolean, name_fields array<string>")
    got = {}
    for r in profiles.enrich_pages(df).select("id", F.explode("observed").alias("o")).select("id", "o.*").collect():
        got.setdefault(r["id"], {})[r["field"]] = (r["value"], r["source"], r["method"], r["rejected_by"])
    assert list(got[1]) == ["display_name", "username", "website", "personal_domain", "public_email", "avatar_url", "external_links", "social_links"]
    assert got[1]["display_name"] == ("Ann Lee", "html_jsonld.name", "HTML", None) and got[1]["website"][:2] == ("https://own.example/", "html_jsonld.sameAs")
    assert got[1]["personal_domain"][2] == "DERIVED" and got[1]["public_email"][0] == "a@b.cc" and got[1]["avatar_url"][0] == "https://i.example/x.png"
    assert got[2]["display_name"] == ("Api Name", "github_api.them.0.n", "JSON_API", None) and got[2]["website"][2] == "AUTHENTICATED_PUBLIC"
    assert got[2]["organization"][0] == "ACME" and "bio" not in got[2] and got[2]["public_id"][:2] == ("x1", "github_api.id")
    assert 3 not in got and list(got[4]) == ["username"]


def test_urls_as_evidence(spark):
    cases = {"HTTP://WWW.A.example:443/x/?b=1&utm_source=q&c=&d=a%20b*~#f": "https://a.example/x?b=1&d=a+b%2A~", "a.example": "https://a.example/", "//a.example:8080": "https://a.example:8080/", " ": None, "https://": None, "https://u:p@a.example/é": "https://a.example/é"}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.normalized(F.col("u")).alias("n"))
    assert {r["u"]: r["n"] for r in df.collect()} == cases
