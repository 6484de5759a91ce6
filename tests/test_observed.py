"""Observed fields and indicators on small rows."""

from pyspark.sql import functions as F

from attestor.operators import observed

ROW = "id long, field string, value string, values array<string>, source string, source_url string, method string, derived_from string, rejected_by string"


def test_contract_and_activity(spark):
    rows = [
        (1, "bio", "hi", None, "s", None, "JSON", None, None),
        (2, "bio", None, ["x"], "s", None, "JSON", None, None),
        (3, "external_links", "x", None, "s", None, "JSON", None, None),
        (4, "bio", "x", None, "s", "http://u", "INPUT", None, None),
        (5, "bio", "x", None, "s", None, "DERIVED", None, None),
        (6, "display_name", "x", None, "s", None, "html_title", None, None),
        (7, "bio", "x", None, "s", None, "JSON", None, ""),
        (8, "bio", "x", None, None, None, "JSON", None, None),
    ]
    df = spark.createDataFrame(rows, ROW)
    reasons = {r["id"]: r["reason"] for r in observed.valid(df).collect()}
    assert reasons == {1: None, 2: "scalar_as_list", 3: "list_as_scalar", 4: "input_with_url", 5: "derived_from_nothing", 6: None, 7: None, 8: "no_source"}
    assert [r["id"] for r in observed.active(df).collect()] == [1], "an empty rejected_by is a rejection"


def test_enrich_and_flatten(spark):
    c = spark.createDataFrame([(1, "bio", 2, "later", "b"), (1, "bio", 1, "first", "a"), (1, "bio", 0, " ", "z"), (1, "external_links", 1, "l1", "a"), (1, "external_links", 3, "l1", "b"), (1, "external_links", 2, "l2", "b")], "id long, field string, prio int, value string, source string")
    f = observed.enrich(c, ["id"])
    r = observed.flatten(f, ["id"]).first()
    assert r["bio"] == "first" and r["external_links"] == "l1,l2" and r["location"] is None


def test_names(spark):
    df = spark.createDataFrame([("Éva  Ünal-Öz", "eva", "github"), ("Eva", "@eva", "github"), ("User profile", "x", "y"), ("GitHub", "x", "github"), (None, "x", "y")], "n string, h string, p string").coalesce(1)
    rows = df.select(observed.generic_name(F.col("n"), F.col("h"), F.col("p")).alias("g")).collect()
    assert [r["g"] for r in rows] == [False, True, True, True, True]


def test_indicators(spark):
    p = spark.createDataFrame([(1, "https://s.example/u/ann", "https://Ann.example", "A@b.co", "mail me @ann_dev or x@y.z @ab", ["https://l.example/", "https://L.example/"])], "id long, profile_url string, website string, public_email string, bio string, links array<string>")
    got = {(r["kind"], r["value"], r["rule"]) for r in observed.indicators(p).collect()}
    assert got == {("url", "https://s.example/u/ann", "profile_url"), ("domain", "s.example", "profile_host"), ("url", "https://Ann.example", "website"), ("domain", "ann.example", "personal_domain"), ("email", "a@b.co", "public_email"), ("url", "https://l.example/", "external_links"), ("username", "ann_dev", "bio_handle")}
