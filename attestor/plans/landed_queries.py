"""Queries over landed answers of services. The answers are JSON made from the test tables; the SQL says what must come out, from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import redaction, text
from attestor.sources import landed, sinks

from . import views
from .views import table


def _text(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _s(c: str):
    return F.col(c).cast("string")





def _certs(s, d):
    """A landing for each supplier: a certificate for each line, numbers of certificates repeat."""
    apex = _text("d", _s("l_suppkey"), ".example")
    names = F.concat_ws("\n", apex, _text("*.", apex), _text("m", _s("l_partkey"), ".", apex), F.lit(" not a host "), _text("  WWW.", F.upper(apex), " "), F.lit("other.example"))
    day = F.when(F.col("l_linenumber") != 7, F.date_format("l_shipdate", "yyyy-MM-dd"))
    c = F.struct((F.col("l_partkey") % 50).alias("id"), names.alias("name_value"), _text("CN", _s("l_linenumber")).alias("common_name"), F.lit("CA").alias("issuer_name"), _s("l_orderkey").alias("serial_number"), day.alias("not_before"), day.alias("not_after"))
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", c.alias("c")))).alias("r"))
    return rows.select("id", F.to_json(F.transform("r", lambda x: x["c"])).alias("body"))


CERTS = """v_line AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS ord FROM lineitem),
v_cert AS (SELECT l_suppkey AS id, l_partkey % 50 AS cert_id, min(ord) AS ord, min_by(l_partkey, ord) AS part, min_by('cn' || l_linenumber, ord) AS common_name, min_by(l_orderkey::VARCHAR, ord) AS serial,
  arg_min_null(CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate, '%Y-%m-%d') END, ord) AS not_before, 'd' || l_suppkey || '.example' AS apex FROM v_line GROUP BY ALL),
v_names AS (SELECT *, [apex, 'm' || part || '.' || apex, 'other.example', 'www.' || apex] AS names FROM v_cert)"""


def landed_certificates(s, d):
    c = landed.certificates(_certs(s, d))
    return c.select("id", "cert_id", F.col("ord").cast("long").alias("ord"), F.array_join("names", ",").alias("names"), "common_name", "serial", "not_before")


def _domained(s, d):
    return landed.certificates(_certs(s, d)).withColumn("domain", _text("d", _s("id"), ".example"))


def _registration_bodies(s, d):
    """A landing for each customer; every part is missing now and then."""
    k = F.col("c_custkey")
    when = lambda m, c: F.when(k % m != 0, c)
    card = lambda *lines: F.concat(F.lit('["vcard",['), F.concat_ws(",", *lines), F.lit("]]"))
    line = lambda name, value: _text(f'["{name}",{{}},"text",', value, "]")
    quoted = lambda *parts: _text('"', *parts, '"')
    registrar = card(line("version", F.lit('"4.0"')), F.when(k % 4 != 0, line("fn", quoted("Registrar ", (k % 6).cast("string")))), line("email", quoted("abuse", (k % 6).cast("string"), "@r.example")))
    registrant = card(line("fn", quoted("c", k.cast("string"))), line("org", quoted("Org ", (k % 9).cast("string"))), line("adr", _text('["","","Street 1","","","",', quoted("N", F.col("c_nationkey").cast("string")), "]")), line("email", quoted("b", k.cast("string"), "@o.example")), line("email", quoted("a", k.cast("string"), "@o.example")))
    entity = lambda handle, role, text, more: _text('{"handle":', quoted(*handle), f',"roles":["{role}"],"vcardArray":', text, ',"entities":[', more, "]}")
    nested = _text('{"vcardArray":', card(line("email", quoted("z", k.cast("string"), "@o.example"))), "}")
    entities = F.concat_ws(",", entity(["R", (k % 6).cast("string")], "registrar", registrar, F.lit("")), when(3, entity(["as", (k % 100).cast("string")], "registrant", registrant, nested)))
    body = _text(
        '{"ldhName":', quoted("NAME", k.cast("string"), ".Example"), ',"name":"NET","country":"XX","status":["active"],"nameservers":[{"ldhName":', quoted("NS1.N", k.cast("string"), ".example."), '},{"unicodeName":"ns2.example"},{}],"events":[',
        F.coalesce(when(5, F.lit('{"eventAction":"registration","eventDate":"2020-01-01"},')), F.lit("")), '{"eventAction":"expiration","eventDate":"2030-01-01"}],"entities":[', entities, "]",
        F.when(k % 7 == 0, F.lit(',"arin_originas0_originautnums":[65000]')).when(k % 7 == 1, F.lit(',"remarks":[{"description":["see AS1"]}]')).otherwise(F.lit("")),
        F.when(k % 8 < 4, F.lit(',"cidr0_cidrs":[{"v4prefix":"10.0.0.0","length":8}]')).when(k % 8 == 4, F.lit(',"cidr0_cidrs":[{"v6prefix":"2001:db8::","length":32}]')).otherwise(F.lit("")), ',"objectClassName":"domain"}',
    )
    return table(s, d, "customer").select(k.alias("id"), F.when(k % 41 != 0, body).otherwise(F.lit("no json")).alias("body"))


def registrations(s, d):
    r = landed.registrations(_registration_bodies(s, d))
    return r.select("id", "domain", F.array_join("status", ",").alias("status"), F.array_join("nameservers", ",").alias("nameservers"), "registered", "expires", "changed", "registrar", "name", "organization", "country", F.array_join("emails", ",").alias("emails"), "cidr", "type", "asn")


REGISTRATIONS = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 41 <> 0 AS ok, c_custkey % 3 <> 0 AS owned FROM customer)
SELECT k AS id, CASE WHEN ok THEN 'name' || k || '.example' END AS domain, CASE WHEN ok THEN 'active' END AS status, CASE WHEN ok THEN 'ns1.n' || k || '.example,ns2.example' END AS nameservers, CASE WHEN ok AND k % 5 <> 0 THEN '2020-01-01' END AS registered, CASE WHEN ok THEN '2030-01-01' END AS expires, NULL::VARCHAR AS changed,
  CASE WHEN ok THEN CASE WHEN k % 4 <> 0 THEN 'Registrar ' || k % 6 ELSE 'R' || k % 6 END END AS registrar, CASE WHEN ok THEN CASE WHEN owned THEN 'c' || k ELSE 'NET' END END AS name, CASE WHEN ok THEN CASE WHEN owned THEN 'Org ' || k % 9 ELSE 'NET' END END AS organization,
  CASE WHEN ok THEN CASE WHEN owned THEN 'N' || n ELSE 'XX' END END AS country, CASE WHEN ok THEN CASE WHEN owned THEN 'a' || k || '@o.example,abuse' || k % 6 || '@r.example,b' || k || '@o.example,z' || k || '@o.example' ELSE 'abuse' || k % 6 || '@r.example' END END AS emails,
  CASE WHEN ok THEN CASE WHEN k % 8 < 4 THEN '10.0.0.0/8' WHEN k % 8 = 4 THEN '2001:db8::/32' END END AS cidr, CASE WHEN ok THEN 'domain' END AS type, CASE WHEN ok THEN CASE WHEN k % 7 = 0 THEN 'AS65000' WHEN k % 7 = 1 THEN NULL WHEN owned THEN 'AS' || k % 100 END END AS asn FROM c"""


def _archive_bodies(s, d):
    """Orders of a customer as captures of a page."""
    cell = lambda c: F.coalesce(c, F.lit(""))
    row = F.array(cell(F.date_format("o_orderdate", "yyyyMMddHHmmss")), _text("http://c", _s("o_custkey"), ".example/"), F.when(F.col("o_orderstatus") == "F", "200").otherwise("301"))
    rows = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("r"))
    return rows.select("id", F.to_json(F.concat(F.array(F.array(*map(F.lit, ("timestamp", "original", "statuscode")))), F.transform("r", lambda x: x["r"]))).alias("body"))


def _dns(s, d):
    """Records of a domain for each supplier."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    mail = F.element_at(F.array(*map(F.lit, ("ASPMX.L.Google.com.", "mx.zoho.eu.", "mail.other.example."))), (k % 3 + 1).cast("int"))
    rec = lambda t, v: F.struct(F.lit(t).alias("rrtype"), v.alias("value"))
    policy = F.element_at(F.array(*map(F.lit, ("v=spf1 include:_spf.google.com ip4:10.0.0.0/8 -all", "V=SPF1 a mx ~all", "plain text"))), (k % 3 + 1).cast("int"))
    tags = F.concat(F.lit("v=DMARC1; P=reject; rua=mailto:d"), n, F.lit("@x.example; pct = 50;"))
    rows = F.array(rec("A", _text("192.0.2.", (k % 200).cast("string"))), rec("AAAA", F.lit("2001:db8::1")), rec("MX", _text("10 ", mail)), rec("NS", _text("NS", n, ".Example.")), rec("TXT", policy), rec("TXT", F.when(k % 2 == 0, tags).otherwise(F.lit("nothing"))))
    return table(s, d, "supplier").select(_text("d", n, ".example").alias("domain"), F.explode(rows).alias("r")).select("domain", "r.*")


def mail_policies(s, d):
    p = landed.mail_policies(_dns(s, d))
    return p.select("domain", F.array_join(F.transform("spf", lambda t: F.concat(t["qualifier"], t["mechanism"], F.lit("="), t["value"])), " ").alias("spf"), F.element_at("dmarc", "p").alias("policy"), F.element_at("dmarc", "pct").alias("pct"), F.element_at("dmarc", "rua").alias("rua"))


def _verdicts(s, d):
    """Three services' answers for each part."""
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("string")
    made = F.array(
        F.struct(F.lit("virustotal").alias("provider"), _text('{"data":{"attributes":{"last_analysis_stats":{"malicious":', n(7), ',"suspicious":', n(3), "}}}}").alias("body")),
        F.struct(F.lit("alienvault").alias("provider"), F.when(k % 5 != 0, _text('{"pulse_info":{"count":', n(11), "}}")).otherwise(F.lit("{}")).alias("body")),
        F.struct(F.lit("abuseipdb").alias("provider"), F.when(k % 4 != 0, _text('{"data":{"abuseConfidenceScore":', n(101), "}}")).otherwise(F.lit("broken")).alias("body")),
    )
    return table(s, d, "part").select(k.alias("id"), F.explode(made).alias("a")).select("id", "a.*")


def _hosts(s, d):
    """A host record for each part: some are not found, some answers are broken."""
    k = F.col("p_partkey")
    body = F.to_json(F.struct(F.col("p_brand").alias("org"), F.col("p_type").alias("isp"), _text("AS", _s("p_size")).alias("asn"), F.when(k % 3 == 0, F.lit("linux")).alias("os"), F.array((k % 100).cast("int"), F.lit(443)).alias("ports"), F.array(F.lit("a"), F.lit("b")).alias("hostnames")))
    status = F.when(k % 10 == 0, 404).when(k % 10 == 1, 503).otherwise(200)
    return table(s, d, "part").select(k.alias("id"), status.alias("status"), F.when(k % 10 == 2, F.lit("<html>")).otherwise(body).alias("body"))


def _scans(s, d):
    """Events of a user as observations of a page."""
    page = F.struct(_text("http://", "event_type", ".example/", _s("event_id")).alias("url"), F.lit("192.0.2.1").alias("ip"), F.when(F.col("event_id") % 2 == 0, "DE").alias("country"))
    o = F.struct(page.alias("page"), F.struct(F.date_format("ts", "yyyy-MM-dd").alias("time")).alias("task"))
    rows = table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", o.alias("o")))).alias("r"))
    return rows.select("id", F.to_json(F.struct(F.size("r").alias("total"), F.transform("r", lambda x: x["o"]).alias("results"))).alias("body"))


def _breaches(s, d):
    b = F.struct(_text("B", _s("o_orderkey")).alias("Name"), F.lower("o_orderpriority").alias("Domain"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("BreachDate"), F.array(F.lit("Emails"), F.col("o_orderstatus")).alias("DataClasses"))
    rows = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", b.alias("b")))).alias("r"))
    return rows.select("id", F.to_json(F.transform("r", lambda x: x["b"])).alias("body"))


def _code(s, d):
    """Lines of an order as files that name a domain."""
    path = F.element_at(F.array(F.lit("src/main.py"), F.lit("config/API_KEY.txt"), F.lit("my-secrets.yml"), F.lit("docs/readme.md")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    i = F.struct(path.alias("path"), _text("http://x/", _s("l_partkey")).alias("html_url"), F.struct(_text("org/r", _s("l_suppkey")).alias("full_name")).alias("repository"), _text("u", _s("l_suppkey")).alias("login"))
    rows = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", i.alias("i")))).alias("r"))
    return rows.select("id", F.to_json(F.struct(F.transform("r", lambda x: x["i"]).alias("items"))).alias("body"))


CODE = "v_code AS (SELECT l_orderkey % 500 AS id, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place, l_partkey, l_suppkey, ['src/main.py', 'config/API_KEY.txt', 'my-secrets.yml', 'docs/readme.md'][l_linenumber % 4 + 1] AS path FROM lineitem)"


def answer_statuses(s, d):
    status = F.element_at(F.array(*map(F.lit, (200, 204, 301, 401, 403, 404, 429, 500))), (F.col("event_id") % 8 + 1).cast("int"))
    error = F.when(F.col("event_id") % 24 == 2, "skipped").when(F.col("event_id") % 24 == 5, "not_configured")
    return table(s, d, "events").groupBy(landed.answer_status(status, F.coalesce(error, F.lit(""))).alias("health")).agg(F.count("*").alias("n"))


def report_json(s, d):
    """Documents as report lines; secrets in texts are masked."""
    t = table(s, d, "documents").select("doc_id", F.col("text").alias("summary"), F.create_map(F.lit("api_key"), F.lit("abcdefgh"), F.lit("x-apikey"), F.lit("zz"), F.lit("note"), F.lit("plain")).alias("data"))
    j = t.select("doc_id", sinks.redacted(F.col("summary")).alias("summary"), sinks.masked_map(F.col("data")).alias("masked"), sinks.stripped_map(F.col("data")).alias("stripped"))
    left = sum((F.regexp_count("summary", F.lit(p)) for p in (text.SECRETS["ghp"], text.SECRETS["google"], text.SECRETS["sk"])), F.lit(0))
    return j.select("doc_id", F.to_json("masked").alias("masked"), F.to_json("stripped").alias("stripped"), left.cast("long").alias("secrets_left"))


def _nested(s, d):
    """Documents as findings four levels deep, with lists in lists and secrets under keys and in texts."""
    k = _s("doc_id")
    deep = F.array(F.struct(F.struct(F.concat(F.lit("pw"), k).alias("Password"), F.col("doc_id").alias("token_id"), F.lit(None).cast("string").alias("cookie")).alias("deep")))
    return table(s, d, "documents").select(
        "doc_id",
        F.struct(F.array(F.struct(F.concat(F.lit("K"), k, F.lit("xyz")).alias("api_key"), F.concat(F.lit("see token=abc"), k, F.lit("def or ?key=q"), k).alias("note"), deep.alias("list"))).alias("found"), F.col("lang").alias("lang")).alias("data"),
    )


def report_nested(s, d):
    lines = sinks.json_lines(_nested(s, d))
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "value")


def report_stripped(s, d):
    return _nested(s, d).select("doc_id", redaction.stripped_json(F.to_json("data")).alias("value"))


def report_csv(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("value"), F.lit("HIGH").alias("confidence"), _s("p_partkey").alias("source"), F.array(F.col("p_type"), F.lit("a"), _s("p_size")).alias("tags"))
    return sinks.csv_rows(p)


def report_markdown(s, d):
    from attestor.operators import scoring

    return sinks.markdown(scoring.score_cases(views.findings(s, d))).withColumn("line_no", F.col("line_no").cast("long"))


def _markdown_sql():
    from .case_queries import MEASURES

    return f"""WITH {views.FINDINGS}, {MEASURES} SELECT case_id, unnest(range(0, 4)) AS line_no, unnest(['# Case ' || case_id, '- Confidence: ' || confidence_score, '- Risk: ' || risk_score || ' (' || risk_level || ')', '- Reputation: ' || reputation_score]) AS line FROM v_scores"""


_MASKED = "CASE WHEN length({x}) <= 4 THEN repeat('*', length({x})) ELSE left({x}, 2) || repeat('*', greatest(4, length({x}) - 4)) || right({x}, 2) END"
_ALL = {
    "landed_certificates": (landed_certificates, f"WITH {CERTS} SELECT id, cert_id, ord, array_to_string(list_sort(names), ',') AS names, common_name, serial, not_before FROM v_names"),
    "certificate_names": (
        lambda s, d: landed.certificate_names(_domained(s, d)),
        f"WITH {CERTS}, n AS (SELECT DISTINCT id, apex AS domain, unnest(names) AS name FROM v_names), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS k FROM n) SELECT id, domain, name, CASE WHEN ends_with(name, domain) THEN 'SUBDOMAIN' ELSE 'DOMAIN' END AS kind, CASE WHEN ends_with(name, domain) THEN 'HAS_SUBDOMAIN' ELSE 'HAS_CERTIFICATE' END AS relation FROM p WHERE k <= 200 AND name <> domain",
    ),
    "certificate_timeline": (
        lambda s, d: landed.certificate_timeline(_domained(s, d)),
        f"WITH {CERTS}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(not_before, '') DESC, ord) AS place FROM v_cert) SELECT id, place, not_before AS date, 'Certificate issued CN=' || common_name AS label, 'crt.sh' AS source FROM p WHERE place <= 50 AND not_before IS NOT NULL",
    ),
    "registrations": (registrations, REGISTRATIONS),
    "archive_captures": (
        lambda s, d: landed.archive_captures(_archive_bodies(s, d)),
        "SELECT o_custkey AS id, count(*) AS count, min(strftime(o_orderdate, '%Y%m%d%H%M%S')) AS first, max(strftime(o_orderdate, '%Y%m%d%H%M%S')) AS last FROM orders GROUP BY 1",
    ),
    "capture_list": (
        lambda s, d: landed.capture_list(_archive_bodies(s, d)),
        "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders) SELECT o_custkey AS id, place, strftime(o_orderdate, '%Y%m%d%H%M%S') AS timestamp, 'http://c' || o_custkey || '.example/' AS original, CASE WHEN o_orderstatus = 'F' THEN '200' ELSE '301' END AS statuscode FROM o WHERE place < 100",
    ),
    "dns_entities": (
        lambda s, d: landed.dns_entities(_dns(s, d)),
        """WITH k AS (SELECT s_suppkey AS k, 'd' || s_suppkey || '.example' AS domain FROM supplier) SELECT domain, unnest(['192.0.2.' || k % 200, '2001:db8::1', ['aspmx.l.google.com', 'mx.zoho.eu', 'mail.other.example'][k % 3 + 1], 'ns' || k || '.example']) AS target, unnest(['IP', 'IP', 'DOMAIN', 'DOMAIN']) AS type, unnest(['RESOLVES_TO', 'RESOLVES_TO', 'HAS_MX', 'HAS_NS']) AS relation FROM k
UNION ALL SELECT domain, ['Google Workspace', 'Zoho'][k % 3 + 1], 'TECHNOLOGY', 'USES' FROM k WHERE k % 3 < 2""",
    ),
    "mail_policies": (
        mail_policies,
        """WITH k AS (SELECT s_suppkey AS k, 'd' || s_suppkey || '.example' AS domain FROM supplier) SELECT domain, ['+include=_spf.google.com +ip4=10.0.0.0/8 -all=', '+a= +mx= ~all='][k % 3 + 1] AS spf, CASE WHEN k % 2 = 0 THEN 'reject' END AS policy, CASE WHEN k % 2 = 0 THEN '50' END AS pct, CASE WHEN k % 2 = 0 THEN 'mailto:d' || k || '@x.example' END AS rua FROM k WHERE k % 3 < 2 OR k % 2 = 0""",
    ),
    "reputation": (
        lambda s, d: landed.reputation(_verdicts(s, d)),
        "SELECT p_partkey AS id, unnest(['virustotal', 'alienvault', 'abuseipdb']) AS provider, unnest([p_partkey % 7 + p_partkey % 3, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 ELSE 0 END, 0])::BIGINT AS detections, unnest([NULL, NULL, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 101 END])::DOUBLE AS abuse FROM part",
    ),
    "threat_panel": (
        lambda s, d: landed.threat_panel(landed.reputation(_verdicts(s, d)), ["virustotal", "alienvault", "abuseipdb"]),
        "SELECT p_partkey AS id, (p_partkey % 7 + p_partkey % 3)::BIGINT AS virustotal, (CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 ELSE 0 END)::BIGINT AS alienvault, 0::BIGINT AS abuseipdb FROM part",
    ),
    "host_records": (
        lambda s, d: landed.answer_fields(_hosts(s, d), "shodan"),
        """WITH p AS (SELECT *, CASE p_partkey % 10 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'PROVIDER_UNAVAILABLE' WHEN 2 THEN 'PROVIDER_UNAVAILABLE' ELSE 'FOUND' END AS answer, p_partkey % 10 > 2 AS ok FROM part)
SELECT p_partkey AS id, answer, CASE WHEN ok THEN 'HIGH' END AS confidence, CASE WHEN ok THEN p_brand END AS org, CASE WHEN ok THEN p_type END AS isp, CASE WHEN ok THEN 'AS' || p_size END AS asn, CASE WHEN ok AND p_partkey % 3 = 0 THEN 'linux' END AS os, NULL::VARCHAR AS last_update, CASE WHEN ok THEN '[' || p_partkey % 100 || ',443]' END AS ports, CASE WHEN ok THEN '["a","b"]' END AS hostnames, NULL::VARCHAR AS tags FROM p""",
    ),
    "scan_observations": (
        lambda s, d: landed.scan_observations(_scans(s, d)),
        "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id AS id, total, place, 'http://event_type.example/' || event_id AS url, '192.0.2.1' AS ip, CASE WHEN event_id % 2 = 0 THEN 'DE' END AS country, NULL::VARCHAR AS server, NULL::VARCHAR AS asn, strftime(ts, '%Y-%m-%d') AS time FROM e WHERE place < 20",
    ),
    "result_keys": (
        lambda s, d: landed.result_keys(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.lit("{}")).otherwise(_text('{"result":{"ip":"1.2.3.4","k', _s("p_size"), '":{},"services":[]}}')).alias("body"))),
        "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ip,k' || p_size || ',services' END AS keys FROM part",
    ),
    "breaches": (
        lambda s, d: landed.breaches(_breaches(s, d)),
        "SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, 'B' || o_orderkey AS name, lower(o_orderpriority) AS domain, strftime(o_orderdate, '%Y-%m-%d') AS breach_date, 'Emails,' || o_orderstatus AS data_classes FROM orders",
    ),
    "possible_accounts": (lambda s, d: landed.possible_accounts(_code(s, d)), f"WITH {CODE} SELECT id, place, 'u' || l_suppkey AS login, 'http://x/' || l_partkey AS html_url, 'MEDIUM' AS confidence, 'INFERENCE' AS answer FROM v_code WHERE place < 10"),
    "code_references": (
        lambda s, d: landed.code_references(_code(s, d)),
        f"WITH {CODE} SELECT id, place, 'org/r' || l_suppkey AS repo, path, 'http://x/' || l_partkey AS html_url, path IN ('config/API_KEY.txt', 'my-secrets.yml') AS secret_hint, CASE path WHEN 'config/API_KEY.txt' THEN 'config******EY.txt' WHEN 'my-secrets.yml' THEN 'my-sec****ts.yml' END AS preview FROM v_code WHERE place < 20",
    ),
    "answer_statuses": (
        answer_statuses,
        "WITH e AS (SELECT [200, 204, 301, 401, 403, 404, 429, 500][event_id % 8 + 1] AS status, CASE event_id % 24 WHEN 2 THEN 'skipped' WHEN 5 THEN 'not_configured' ELSE '' END AS error FROM events) SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'ONLINE' WHEN status = 429 THEN 'RATE LIMITED' WHEN status IN (401, 403) THEN 'AUTH REJECTED' WHEN error = 'skipped' THEN 'SKIPPED' WHEN error = 'not_configured' THEN 'NOT_CONFIGURED' ELSE 'UNAVAILABLE' END AS health, count(*) AS n FROM e GROUP BY 1",
    ),
    "report_json": (report_json, """SELECT doc_id, '{"api_key":"ab****gh","x-apikey":"**","note":"plain"}' AS masked, '{"note":"plain"}' AS stripped, 0::BIGINT AS secrets_left FROM documents"""),
    "report_nested": (
        report_nested,
        f"""SELECT doc_id, '{{"doc_id":' || doc_id || ',"data":{{"found":[{{"api_key":"' || {_MASKED.format(x="'K' || doc_id || 'xyz'")} || '","note":"see token=' || {_MASKED.format(x="'abc' || doc_id || 'def'")} || ' or ?key=' || {_MASKED.format(x="'q' || doc_id")}
  || '","list":[{{"deep":{{"Password":"' || {_MASKED.format(x="'pw' || doc_id")} || '","token_id":"' || {_MASKED.format(x="doc_id::VARCHAR")} || '"}}}}]}}]' || coalesce(',"lang":"' || lang || '"', '') || '}}}}' AS value FROM documents""",
    ),
    "report_stripped": (
        report_stripped,
        f"""SELECT doc_id, '{{"found":[{{"note":"see token=' || {_MASKED.format(x="'abc' || doc_id || 'def'")} || ' or ?key=' || {_MASKED.format(x="'q' || doc_id")} || '","list":[{{"deep":{{"token_id":' || doc_id || '}}}}]}}]' || coalesce(',"lang":"' || lang || '"', '') || '}}' AS value FROM documents""",
    ),
    "report_csv": (report_csv, "SELECT p_brand AS type, p_name AS value, 'HIGH' AS confidence, p_partkey::VARCHAR AS source, p_type || ',a,' || p_size AS tags FROM part"),
    "report_markdown": (report_markdown, _markdown_sql()),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
