"""What keeps work spread and bounded as tables grow: plans and partitions, besides the same rows."""

from __future__ import annotations

from attestor.operators import checks
from attestor.plans import check_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_answers_are_parsed_once_and_in_all_tasks(spark):
    rows = [(200, '{"login": "Ann"}', "$.login", "@ann"), (200, "no", "$.login", "ann"), (200, '{"login": true}', "$.login", "ann"), (404, None, "$.x", "ann")]
    got = checks.classify_json(spark.createDataFrame(rows, "status int, body string, id_path string, handle string"))
    assert plan(got).count("parse_json") + plan(got).count("ParseJson") <= 1 and got.columns == ["status", "body", "id_path", "handle", "observed", "check_status"]
    assert [(r["check_status"], r["observed"]) for r in got.collect()] == [("CONFIRMED", "Ann"), ("INCONCLUSIVE", None), ("NOT_FOUND", None), ("NOT_FOUND", None)]
    assert check_queries.json_cascade(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_site_of_many_pages_is_not_one_task(spark):
    site = lambda n: (n, "generic_html", False, [200], [404], [], [], [], [], ["gone"], [], [], None, None, None)
    pages = spark.createDataFrame([("A" if k % 9 else "B", f"https://s.example/u{k}", f"https://s.example/u{k}", 200, "gone" if k % 2 else "", f"u{k}") for k in range(90)], "site string, url string, final_url string, status int, html string, handle string")
    sites = spark.createDataFrame([site("A"), site("B")], checks.SITE)
    got = checks.classify_pages(pages, sites)
    assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString() and got.where("check_status = 'NOT_FOUND'").count() == 45
    # of a catalog that is too large each row meets a share of its site's pages, and each page its site once
    dealt = checks.with_sites(pages, sites, megabytes=0)
    assert dealt.count() == 90 and dealt.select("site", "handle").distinct().count() == 90


def test_facts_of_runs_are_dealt_by_their_number(spark):
    from attestor.plans import lead_queries
    from attestor.sources.steps import shares

    assert shares(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 100
    assert "RepartitionByExpression [run_id" in plan(lead_queries.rollback_view(spark, SF))


def test_names_of_certificates_are_computed_once(spark):
    from attestor.sources import landed

    body = '[{"id":2,"name_value":"*.B.example.com\\nb.example.com\\nnone"},{"id":1,"name_value":"x"},{"min_cert_id":2,"name_value":"late.example.com"},{"name_value":"n.example.com"},{"name_value":"m.example.com"}]'
    got = landed.certificates(spark.createDataFrame([(1, body), (2, "no json"), (3, "[]")], "id int, body string"))
    assert sorted((r["ord"], r["cert_id"], r["names"]) for r in got.collect()) == [(0, 2, ["b.example.com"]), (1, 1, []), (3, None, ["n.example.com"])]
    assert plan(got).count("regexp_replace") <= 2 and plan(got).count("from_json") + plan(got).count("jsontostructs") <= 1
