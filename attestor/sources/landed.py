"""Landed answers of public services, as JSON text in a column, flattened into rows.

Nothing is fetched here: a landing job writes (id, body) tables, and these
functions give the engine's rows. A body that is no JSON gives nulls and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import text as text_
from attestor.functions.ids import known_domains, mask, plain_host
from attestor.functions.markup import let

CERTS = "array<struct<id:bigint,min_cert_id:bigint,name_value:string,common_name:string,issuer_name:string,serial_number:string,not_before:string,not_after:string>>"
RDAP = """struct<handle:string,ldhName:string,name:string,country:string,type:string,objectClassName:string,port43:string,startAddress:string,endAddress:string,
  status:array<string>,nameservers:array<struct<ldhName:string,unicodeName:string>>,events:array<struct<eventAction:string,eventDate:string>>,
  entities:array<struct<handle:string,roles:array<string>,vcardArray:string,entities:array<struct<vcardArray:string>>>>,
  cidr0_cidrs:array<struct<v4prefix:string,v6prefix:string,length:int>>,remarks:array<struct<description:array<string>>>,
  arin_originas0_originautnums:array<bigint>,arin_originas0_originautnum:bigint>"""


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A landed table in any format that Spark reads: parquet, orc, json, csv, text, binaryFile, jdbc."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def certificates(landed: DataFrame, body: str = "body") -> DataFrame:
    """One row for each certificate id of a landing, the first in order; those without id share one place. Names are its hosts, wildcards by what they stand for."""
    # of a landing only the first of each number leaves its row: numbers are sorted with their places
    key = lambda c, at: F.struct(F.coalesce(c["id"], c["min_cert_id"]).alias("cert_id"), at.alias("ord"))
    new = lambda ks: F.filter(ks, lambda k, at: (at == 0) | ~k["cert_id"].eqNullSafe(F.get(ks, at - 1)["cert_id"]))
    firsts = lambda cs: F.transform(let(F.sort_array(F.transform(cs, key)), new), lambda k: F.struct(k["cert_id"].alias("cert_id"), k["ord"].alias("ord"), F.get(cs, k["ord"]).alias("c")))
    rows = landed.select("id", F.inline(let(F.from_json(body, CERTS), firsts)))
    first = rows.groupBy("id", "cert_id").agg(F.min_by("c", "ord").alias("c"), F.min("ord").alias("ord"))
    host = lambda n: plain_host(F.regexp_replace(F.lower(F.trim(n)), r"^[*.]+", ""))
    names = F.array_sort(known_domains(F.transform(F.split(F.coalesce("c.name_value", F.lit("")), "\n"), host)))
    columns = {"issuer": "issuer_name", "serial": "serial_number", "not_before": "not_before", "not_after": "not_after"}
    return first.select("id", "cert_id", "ord", names.alias("names"), F.lower(F.coalesce("c.common_name", F.lit(""))).alias("common_name"), *(F.col(f"c.{c}").alias(n) for n, c in columns.items()))


def certificate_names(certs: DataFrame, domain: str = "domain", limit: int = 200) -> DataFrame:
    """The first ``limit`` names, in order, in certificates of a domain, but for itself: SUBDOMAIN and an edge to it if they end in it, else DOMAIN."""
    n = certs.select("id", domain, F.explode("names").alias("name")).distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    n = n.withColumn("place", place).where((F.col("place") <= limit) & (F.col("name") != F.col(domain)))
    below = F.endswith("name", domain)
    return n.select("id", domain, "name", F.when(below, "SUBDOMAIN").otherwise("DOMAIN").alias("kind"), F.when(below, "HAS_SUBDOMAIN").otherwise("HAS_CERTIFICATE").alias("relation"))


def certificate_timeline(certs: DataFrame, limit: int = 50) -> DataFrame:
    """Of the newest certificates of each landing by their start, those that have one, as dated lines."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.coalesce("not_before", F.lit(""))), "ord"))
    newest = certs.withColumn("place", place).where((F.col("place") <= limit) & (F.coalesce("not_before", F.lit("")) != ""))
    return newest.select("id", F.col("place").cast("long").alias("place"), F.col("not_before").alias("date"), F.concat(F.lit("Certificate issued CN="), F.col("common_name")).alias("label"), F.lit("crt.sh").alias("source"))


def vcard_values(card: Column, name: str) -> Column:
    """The values of a property of a jCard in JSON text, in order; an array's value is its last part."""
    props = F.from_json(F.get_json_object(card, "$[1]"), "array<array<string>>")
    named = F.filter(props, lambda p: (F.size(p) >= 4) & (F.lower(F.get(p, F.lit(0))) == name))
    value = F.transform(named, lambda p: F.get(p, F.lit(3)))
    return F.transform(value, lambda v: F.when(v.startswith("["), F.element_at(F.from_json(v, "array<string>"), -1)).otherwise(v))


def registrations(landed: DataFrame, body: str = "body") -> DataFrame:
    """Registration data: name, status, name servers, dates, registrar, registrant, range and number of the network."""
    r = landed.select("id", F.from_json(body, RDAP).alias("r"))
    date = lambda action: F.get(F.transform(F.filter("r.events", lambda e: e["eventAction"] == action), lambda e: e["eventDate"]), F.lit(0))
    # of several entities in one role, or several lines of one name, the last counts
    last = lambda card, name: F.try_element_at(vcard_values(card, name), F.lit(-1))
    of = lambda role: F.try_element_at(F.filter("r.entities", lambda e: F.array_contains(e["roles"], role)), F.lit(-1))
    registrar, registrant = of("registrar"), of("registrant")
    cards = F.flatten(F.transform("r.entities", lambda e: F.concat(F.array(e["vcardArray"]), F.coalesce(F.transform(e["entities"], lambda x: x["vcardArray"]), F.array().cast("array<string>")))))
    emails = F.array_sort(F.array_distinct(F.flatten(F.transform(cards, lambda c: F.coalesce(vcard_values(c, "email"), F.array().cast("array<string>"))))))
    cidr = F.get("r.cidr0_cidrs", F.lit(0))
    number = F.coalesce(F.get("r.arin_originas0_originautnums", F.lit(0)), F.col("r.arin_originas0_originautnum"))
    remarked = F.exists(F.col("r.remarks"), lambda x: F.array_join(x["description"], " ").contains("AS"))
    handles = F.filter(F.transform("r.entities", lambda e: F.upper(e["handle"])), lambda h: h.rlike("^AS[0-9]+$"))
    asn = F.when(number.isNotNull(), F.concat(F.lit("AS"), number.cast("string"))).when(~F.coalesce(remarked, F.lit(False)), F.get(handles, F.lit(0)))
    servers = F.filter(F.transform("r.nameservers", lambda n: F.rtrim(F.lower(F.coalesce(n["ldhName"], n["unicodeName"], F.lit(""))), F.lit("."))), lambda n: n != "")
    return r.select(
        "id",
        F.lower("r.ldhName").alias("domain"),
        F.col("r.status").alias("status"),
        servers.alias("nameservers"),
        date("registration").alias("registered"),
        date("expiration").alias("expires"),
        date("last changed").alias("changed"),
        F.coalesce(last(registrar["vcardArray"], "fn"), registrar["handle"]).alias("registrar"),
        F.coalesce(last(registrant["vcardArray"], "fn"), F.col("r.name")).alias("name"),
        F.coalesce(last(registrant["vcardArray"], "org"), F.col("r.name")).alias("organization"),
        F.coalesce(last(registrant["vcardArray"], "adr"), F.col("r.country")).alias("country"),
        emails.alias("emails"),
        F.concat(F.coalesce(cidr["v4prefix"], cidr["v6prefix"]), F.lit("/"), cidr["length"].cast("string")).alias("cidr"),
        F.coalesce("r.type", "r.objectClassName").alias("type"),
        asn.alias("asn"),
    )


def _captures(landed: DataFrame, body: str) -> DataFrame:
    """Captures as maps, from a table whose first row names the columns."""
    t = landed.select("id", F.from_json(body, "array<array<string>>").alias("r")).where("size(r) > 0")
    cells = F.slice("r", F.lit(2), F.greatest(F.lit(0), F.size("r") - 1))
    n = F.size(F.get("r", F.lit(0)))
    return t.select("id", F.transform(cells, lambda x: F.map_from_arrays(F.slice(F.get("r", F.lit(0)), F.lit(1), F.least(n, F.size(x))), F.slice(x, F.lit(1), F.least(n, F.size(x))))).alias("m"))


def archive_captures(landed: DataFrame, body: str = "body") -> DataFrame:
    """Captures of each landing: number, first and last instant."""
    times = F.filter(F.transform("m", lambda m: F.try_element_at(m, F.lit("timestamp"))), lambda t: t != "")
    return _captures(landed, body).select("id", F.size("m").cast("long").alias("count"), F.array_min(times).alias("first"), F.array_max(times).alias("last"))


def capture_list(landed: DataFrame, body: str = "body", limit: int = 100) -> DataFrame:
    """The first ``limit`` captures of each landing, in order."""
    each = _captures(landed, body).select("id", F.posexplode(F.slice("m", 1, limit)).alias("place", "m"))
    return each.select("id", F.col("place").cast("long").alias("place"), *(F.try_element_at("m", F.lit(c)).alias(c) for c in ("timestamp", "original", "statuscode")))


#: Where single values are in the answers of services.
FIELDS = {
    "ipinfo": {c: f"$.{c}" for c in "hostname city region country org postal timezone loc anycast privacy".split()},
    "greynoise": {c: f"$.{c}" for c in "classification noise riot name last_seen link".split()},
    "shodan": {c: f"$.{c}" for c in "org isp asn os last_update ports hostnames tags".split()},
    "github_user": {c: f"$.{c}" for c in "login name company blog bio location public_repos html_url type created_at".split()},
    "github_org": {c: f"$.{c}" for c in "login name blog html_url public_repos created_at".split()},
}
#: What a service's answer counts as.
CONFIDENCE = {"ipinfo": "HIGH", "greynoise": "HIGH", "shodan": "HIGH", "github_user": "HIGH", "github_org": "HIGH", "urlscan": "HIGH", "censys": "HIGH", "hibp": "CONFIRMED", "github_email": "MEDIUM", "github_code": "MEDIUM"}


def answer_fields(landed: DataFrame, provider: str, body: str = "body") -> DataFrame:
    """landed(id, status, body) -> the service's fields, with status and confidence: NOT_FOUND for 404, PROVIDER_UNAVAILABLE for other errors and what is no JSON."""
    parsed = F.try_parse_json(body)
    status = F.when(F.col("status") == 404, "NOT_FOUND").when((F.col("status") >= 400) | parsed.isNull(), "PROVIDER_UNAVAILABLE").otherwise("FOUND")
    found = status == "FOUND"
    fields = (F.when(found, F.get_json_object(body, path)).alias(c) for c, path in FIELDS[provider].items())
    return landed.select("id", status.alias("answer"), F.when(found, CONFIDENCE[provider]).alias("confidence"), *fields)


def scan_observations(landed: DataFrame, body: str = "body", limit: int = 20) -> DataFrame:
    """The first ``limit`` observations of a scanning service."""
    shape = "struct<total:bigint,results:array<struct<page:struct<url:string,ip:string,country:string,server:string,asn:string>,task:struct<time:string>>>>"
    each = landed.select("id", F.from_json(body, shape).alias("r")).select("id", "r.total", F.posexplode(F.slice("r.results", 1, limit)).alias("place", "o"))
    return each.select("id", "total", F.col("place").cast("long").alias("place"), *(F.col(f"o.page.{c}").alias(c) for c in ("url", "ip", "country", "server", "asn")), F.col("o.task.time").alias("time"))


def result_keys(landed: DataFrame, body: str = "body", limit: int = 30) -> DataFrame:
    """Which fields a host's record has, without their contents."""
    return landed.select("id", F.array_join(F.slice(F.coalesce(F.json_object_keys(F.get_json_object(body, "$.result")), F.array().cast("array<string>")), 1, limit), ",").alias("keys"))


def breaches(landed: DataFrame, body: str = "body") -> DataFrame:
    """Breaches that an address is in."""
    each = landed.select("id", F.posexplode(F.from_json(body, "array<struct<Name:string,Domain:string,BreachDate:string,DataClasses:array<string>>>")).alias("place", "b"))
    return each.where("b IS NOT NULL").select("id", F.col("place").cast("long").alias("place"), F.col("b.Name").alias("name"), F.col("b.Domain").alias("domain"), F.col("b.BreachDate").alias("breach_date"), F.array_join("b.DataClasses", ",").alias("data_classes"))


def possible_accounts(landed: DataFrame, body: str = "body", limit: int = 10) -> DataFrame:
    """Accounts that a search for an address turns up: inferences, never confirmations."""
    each = landed.select("id", F.posexplode(F.slice(F.from_json(body, "struct<items:array<struct<login:string,html_url:string>>>")["items"], 1, limit)).alias("place", "i"))
    return each.select("id", F.col("place").cast("long").alias("place"), "i.login", "i.html_url", F.lit("MEDIUM").alias("confidence"), F.lit("INFERENCE").alias("answer"))


#: Names of files that may hold secrets.
SECRET_PATHS = r"(?i)(api[_-]?key|secret|token|password|BEGIN (RSA |OPENSSH )?PRIVATE KEY)"


def code_references(landed: DataFrame, body: str = "body", limit: int = 20) -> DataFrame:
    """Public code that names a domain; of paths that hint at secrets a masked preview, never a content."""
    each = landed.select("id", F.posexplode(F.slice(F.from_json(body, "struct<items:array<struct<path:string,html_url:string,repository:struct<full_name:string>>>>")["items"], 1, limit)).alias("place", "i"))
    path = F.coalesce("i.path", F.lit(""))
    hint = path.rlike(SECRET_PATHS)
    return each.select("id", F.col("place").cast("long").alias("place"), F.col("i.repository.full_name").alias("repo"), path.alias("path"), "i.html_url", hint.alias("secret_hint"), F.when(hint, mask(path, 6)).alias("preview"))


def dns_entities(records: DataFrame) -> DataFrame:
    """records(domain, rrtype, value) -> edges from the domain to addresses, mail hosts, name servers and mail services."""
    host = F.rtrim(F.lower(F.regexp_extract("value", r"(\S+)$", 1)), F.lit("."))
    edge = lambda kinds, dst, kind, relation: records.where(F.col("rrtype").isin(*kinds)).select("domain", dst.alias("target"), F.lit(kind).alias("type"), F.lit(relation).alias("relation"))
    service = text_.mail_provider(host)
    return (
        edge(("A", "AAAA"), F.col("value"), "IP", "RESOLVES_TO")
        .unionByName(edge(("MX",), host, "DOMAIN", "HAS_MX"))
        .unionByName(edge(("NS",), host, "DOMAIN", "HAS_NS"))
        .unionByName(edge(("MX",), service, "TECHNOLOGY", "USES").where("target IS NOT NULL"))
        .distinct()
    )


def mail_policies(records: DataFrame) -> DataFrame:
    """SPF terms and DMARC tags of each domain's TXT records."""
    txt = records.where("rrtype = 'TXT'").select("domain", text_.spf_terms(F.col("value")).alias("spf"), text_.dmarc_tags(F.col("value")).alias("dmarc"))
    return txt.where("spf IS NOT NULL OR dmarc IS NOT NULL").groupBy("domain").agg(F.first("spf", ignorenulls=True).alias("spf"), F.first("dmarc", ignorenulls=True).alias("dmarc"))


#: Where the numbers of scanning and reputation services are in their answers.
MEASURES = {
    "virustotal": {"malicious": "$.data.attributes.last_analysis_stats.malicious", "suspicious": "$.data.attributes.last_analysis_stats.suspicious"},
    "alienvault": {"pulses": "$.pulse_info.count"},
    "abuseipdb": {"abuse_score": "$.data.abuseConfidenceScore"},
}


def reputation(landed: DataFrame) -> DataFrame:
    """landed(id, provider, body) -> detections and abuse score, missing numbers as 0 detections and no score."""
    n = lambda path: F.coalesce(F.get_json_object("body", path).cast("long"), F.lit(0))
    vt, av = MEASURES["virustotal"], MEASURES["alienvault"]
    detections = F.when(F.col("provider") == "virustotal", n(vt["malicious"]) + n(vt["suspicious"])).when(F.col("provider") == "alienvault", n(av["pulses"])).otherwise(0)
    abuse = F.when(F.col("provider") == "abuseipdb", F.get_json_object("body", MEASURES["abuseipdb"]["abuse_score"]).cast("double"))
    return landed.select("id", "provider", detections.alias("detections"), abuse.alias("abuse"))


def threat_panel(measures: DataFrame, providers: list[str]) -> DataFrame:
    """One row for each entity, one column for each provider."""
    return measures.groupBy("id").pivot("provider", providers).agg(F.max("detections"))


def answer_status(status: Column, error: Column) -> Column:
    """What a provider's answer means for its health."""
    return F.when(status.between(200, 299), "ONLINE").when(status == 429, "RATE LIMITED").when(status.isin(401, 403), "AUTH REJECTED").when(error == "skipped", "SKIPPED").when(error == "not_configured", "NOT_CONFIGURED").otherwise("UNAVAILABLE")
