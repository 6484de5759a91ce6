"""Mentions out of landed answers: leads of cases, what a hit says of its query, and which hits stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import ids
from attestor.functions.redaction import redacted_text
from attestor.functions.text import excerpt
from attestor.functions.urls import host_of
from attestor.operators import discovery
from attestor.operators.reports import mention_key
from attestor.sources.mentions import PROVIDERS
from attestor.sources.steps import cut

#: Which inputs of a case are leads of which kind, in their order.
INPUTS = {"username": ("usernames", "username", "aliases"), "name": ("names", "display_name", "name"), "email": ("emails", "email"), "domain": ("domains", "domain", "website")}
#: Matches that stand for more than a word in a text.
FIRM = ("url_path_segment", "exact_email", "exact_host")


def lead_host(value: Column) -> Column:
    """The host of a URL or of what starts like one, without www.; in lower case."""
    raw = F.trim(value)
    host = host_of(F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw)))
    return F.regexp_replace(F.lower(F.coalesce(F.nullif(host, F.lit("")), raw)), r"^www\.", "")


def lead_of(kind: Column, value: Column) -> Column:
    """What of a query is searched for: a handle without its @, a host of an address."""
    raw = F.trim(value)
    return F.when(kind == "username", F.regexp_replace(raw, "^@+", "")).when(kind == "domain", lead_host(raw)).otherwise(raw)


def case_leads(inputs: DataFrame, case: str = "case") -> DataFrame:
    """inputs(case, and any of the columns that ``INPUTS`` names: texts or arrays of texts) -> case, kind, lead, ord: each lead once, in order.

    Synonyms are one kind; nulls and blanks are none; a case in several rows has the leads of all.
    """
    types = dict(inputs.dtypes)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if types[c].startswith("array") else F.array(F.col(c))
    # a lead's place: the kind's, then the one among its inputs
    led = lambda k, kind: lambda v, at: F.struct(F.lit(kind).alias("kind"), lead_of(F.lit(kind), v).alias("lead"), (F.lit(k * 1_000_000).cast("long") + at).alias("ord"))
    parts = []
    for k, (kind, names) in enumerate(INPUTS.items()):
        have = [listed(n) for n in names if n in types]
        if have:
            parts.append(F.transform(F.concat(*have), led(k, kind)))
    if not parts:
        return inputs.select(case, F.lit("").alias("kind"), F.lit("").alias("lead"), F.lit(0).cast("long").alias("ord")).where("false")
    each = inputs.select(case, F.inline(F.concat(*parts))).where("lead <> ''")
    return each.groupBy(case, "kind", "lead").agg(F.min("ord").alias("ord"))


def masked_address(value: Column) -> Column:
    """An address of which the first letter and the domain are left; other texts as they are."""
    at = F.instr(value, "@")
    first = F.when(at > 1, F.left(value, F.lit(1))).otherwise("*")
    return F.when(at > 0, F.concat(first, F.lit("***@"), F.substr(value, at + 1))).otherwise(value)


def judged(hits: DataFrame, leads: DataFrame) -> DataFrame:
    """hits(case, kind, query, provider, id, place, title, url, snippet, author, ...), leads(case, kind, lead, ord) -> the hits that hold their query.

    ``id`` is the answer's. Added: lead, matched_field, match_type, matched_value, excerpt, relevance,
    reason, associated (the case's handles, addresses and hosts beside a name, addresses masked) and confidence.
    A hit meets, by keys, the queries and leads of its own case only; what of them is the hit's own query, or a lead of
    its case, is told by equality. Null cases have no leads beside the query. Hits without a web address don't count.
    """
    kind = F.when(F.col("kind").isin("url", "website"), "domain").otherwise(F.coalesce(F.nullif(F.lower("kind"), F.lit("")), F.lit("username")))
    rows = hits.where(F.trim("url").rlike(r"^https?://[^/]")).withColumn("kind", kind).withColumn("lead", lead_of(F.col("kind"), F.col("query")))
    rows = cut(rows.withColumn("hit", F.concat_ws(":", F.col("id").cast("string"), "provider", F.col("place").cast("string"))), "hits")
    scope = F.concat_ws(":", F.lit("case"), F.col("case").cast("string")).alias("scope")  # null cases are one
    asked = rows.select(scope, "kind", "lead").unionByName(leads.select(scope, "kind", "lead")).distinct()
    found = cut(discovery.lead_fields(rows.select(scope, F.col("hit").alias("id"), *discovery.FIELDS), asked, ("scope",)).drop("version").distinct().withColumnRenamed("id", "hit"), "found")

    names = rows.where("kind = 'name'").select("hit", "case").distinct()
    beside = found.where(F.col("kind").isin(*discovery.DIRECT_KINDS)).select("hit", "kind", "lead").join(names, "hit").join(leads, ["case", "kind", "lead"])
    rank = F.array_position(F.array(*map(F.lit, discovery.ASSOCIATIONS)), F.col("kind"))
    beside = beside.groupBy("hit").agg(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "ord", "kind", "lead"))).alias("beside"))

    own = rows.join(found.withColumnRenamed("field", "matched_field"), ["hit", "kind", "lead"]).join(beside, "hit", "left")
    value = F.when(F.col("kind") == "email", F.lower("lead")).otherwise(F.col("lead"))
    text = F.col("url")
    for c in discovery.FIELDS:
        text = F.when(F.col("matched_field") == c, F.col(c)).otherwise(text)
    around = F.when((F.col("kind") == "domain") & (F.col("matched_field") == "url"), lead_host(F.col("url"))).otherwise(excerpt(text, F.col("lead")))
    others = F.coalesce(F.col("beside"), F.array().cast("array<struct<rank:bigint,ord:bigint,kind:string,lead:string>>"))
    named, has = F.col("kind") == "name", F.size(others) > 0
    label = F.element_at(F.create_map(*(F.lit(x) for kv in discovery.ASSOCIATIONS.items() for x in kv)), F.get(others, F.lit(0))["kind"])
    direct = F.when(F.col("match_type") == "exact_token", "exact_username").when(F.col("match_type") == "url_path_segment", "username_path").when(F.col("match_type") == "exact_email", "exact_email").otherwise("exact_domain")
    return own.select(
        *hits.columns[: hits.columns.index("kind")],
        "kind",
        *(c for c in hits.columns[hits.columns.index("kind") + 1 :]),
        "lead",
        "matched_field",
        "match_type",
        value.alias("matched_value"),
        around.alias("excerpt"),
        F.when(~named, "DIRECT").when(has, "ASSOCIATED").otherwise("AMBIGUOUS").alias("relevance"),
        F.when(~named, direct).when(has, label).otherwise("full_name_only").alias("reason"),
        F.transform(others, lambda x: masked_address(x["lead"])).alias("associated"),
        F.when(F.col("match_type").isin(*FIRM), "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def accepted(matches: DataFrame, by: list[str], cap: int = 5, order: tuple[str, ...] = tuple(PROVIDERS)) -> DataFrame:
    """matches(*by, provider, place, url) -> by, key, rank, at, sources: of each query the pages that stay, in whose answer and where.

    Services come in their order; each gives its first ``cap`` pages that none before it gave. What a
    service has no room for may still come from the next. Before it, a service loses at most ``cap``
    pages to each, so its first ``cap`` times the number of services are all that can stay: a
    query's fold is over a bounded list, however long its answers are. ``sources`` are the service and
    all later ones that have the page too. Services that aren't in the order come in none.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("provider")).cast("int")
    first = matches.withColumn("rank", rank).where("rank > 0").groupBy(*by, mention_key(F.col("url")).alias("key"), "rank").agg(F.min("place").alias("at"))
    nth = F.row_number().over(Window.partitionBy(*by, "rank").orderBy("at", "key"))
    few = first.withColumn("nth", nth).where(F.col("nth") <= cap * len(order))
    listed = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "at", "key"))).alias("keys"))

    def step(state: Column, x: Column) -> Column:
        used = F.size(F.filter(state, lambda y: y["rank"] == x["rank"]))
        fresh = (used < cap) & ~F.exists(state, lambda y: y["key"] == x["key"])
        return F.when(fresh, F.array_append(state, x)).otherwise(state)

    kept = listed.select(*by, F.inline(F.aggregate("keys", F.filter("keys", lambda x: F.lit(False)), step)))
    kept = kept.select(*by, "key", F.col("rank").alias("by_rank"), F.col("at"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    also = kept.alias("k").join(first.alias("f"), [*same, F.col("k.key") == F.col("f.key"), F.col("f.rank") >= F.col("k.by_rank")])
    names = F.array(*map(F.lit, order))
    return also.groupBy(*(F.col(f"k.{c}") for c in by), "k.key", F.col("k.by_rank").alias("rank"), F.col("k.at")).agg(F.transform(F.array_sort(F.collect_list("f.rank")), lambda r: F.element_at(names, r)).alias("sources"))


def _with_accepted(matches: DataFrame, by: list[str], cap: int, order: tuple[str, ...]) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("provider")).cast("int")
    stay = accepted(matches, by, cap, order)
    m = matches.withColumn("key", mention_key(F.col("url"))).withColumn("own_rank", rank)
    on = [*(F.col(f"m.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by), F.col("m.key") == F.col("a.key")]
    return m.alias("m").join(stay.alias("a"), on, "left").select("m.*", "a.rank", "a.at", "a.sources")


def collected(matches: DataFrame, by: list[str], cap: int = 5, order: tuple[str, ...] = tuple(PROVIDERS)) -> DataFrame:
    """The matches that stay, with their sources. Two hits of one service at one place (a landing that came twice) both stay."""
    return _with_accepted(matches, by, cap, order).where("rank = own_rank AND at = place").drop("key", "own_rank", "rank", "at")


def collection_coverage(hits: DataFrame, matches: DataFrame, by: list[str], cap: int = 5, order: tuple[str, ...] = tuple(PROVIDERS)) -> DataFrame:
    """hits as ``sources.mentions.hits`` gives them -> for each query and service: raw, parsed, matched, deduped, what was rejected and why, errors."""
    valid = F.coalesce(F.trim("url").rlike(r"^https?://[^/]"), F.lit(False))
    n = hits.groupBy(*by, "provider").agg(F.count("place").alias("raw"), F.count_if(valid).alias("parsed"), F.max(F.when(F.col("status").between(200, 299), 0).otherwise(1)).cast("long").alias("errors"))
    m = _with_accepted(matches, by, cap, order)
    stays = F.coalesce((F.col("rank") == F.col("own_rank")) & (F.col("at") == F.col("place")), F.lit(False))
    k = m.groupBy(*by, "provider").agg(F.count("*").alias("matched"), F.count_if(stays).alias("deduped"), F.count_if(~stays & F.coalesce(F.col("rank") <= F.col("own_rank"), F.lit(False))).alias("duplicate"))
    on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*by, "provider")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return n.alias("n").join(k.alias("k"), on, "left").select(
        *(F.col(f"n.{c}") for c in (*by, "provider")), "raw", "parsed", zero("matched").alias("matched"), zero("deduped").alias("deduped"),
        (F.col("parsed") - zero("matched")).alias("rejected_no_exact_match"), (F.col("raw") - F.col("parsed")).alias("rejected_invalid_url"), zero("duplicate").alias("rejected_duplicate"), "errors",
    )


def as_findings(mentions: DataFrame) -> DataFrame:
    """Mentions as findings and as entities: status, a summary that names the query, the class of a handle's match, the entity's type and id, tags.

    A mention is never a profile nor a proof of identity, and the tags say so.
    """
    handle = F.col("kind") == "username"
    match = F.when(handle, ids.username_match(F.col("query"), F.col("matched_value")))
    similar = F.coalesce(match == ids.SIMILAR, F.lit(False))
    safe = F.when(F.col("kind") == "email", redacted_text(F.trim("query"))).otherwise(F.trim("query"))
    m = mentions.select("*", F.inline(F.array(F.struct(safe.alias("safe_query"), F.when(handle, F.when(similar, ids.SIMILAR).otherwise(ids.EXACT)).otherwise(F.col("match_type")).alias("match_class"), mention_key(F.col("url")).alias("canonical_url")))))
    title = F.coalesce(F.col("title"), F.lit(""))
    similar = F.col("match_class") == ids.SIMILAR
    of = F.when(handle & similar, F.concat(F.lit("similar candidate @"), "matched_value", F.lit(" (lead: @"), F.trim("query"), F.lit(")"))).when(handle, F.concat(F.lit("@"), F.trim("query"))).otherwise(F.col("safe_query"))
    tags = F.concat(F.array(F.lit("public-mention"), F.lit("not-profile")), F.when(similar, F.array(F.lit("similar-candidate"))).otherwise(F.array().cast("array<string>")))
    value = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("title"))
    return m.select(
        *mentions.columns, "safe_query", "match_class", "canonical_url",
        F.lit("OBSERVED").alias("status"),
        F.concat(F.lit("OBSERVED mention of "), of, F.lit(": "), title).alias("summary"),
        F.when(similar, "LOW").otherwise(F.col("confidence")).alias("finding_confidence"),
        F.lower(host_of(F.col("canonical_url"))).alias("domain"),
        F.concat(F.col("match_type"), F.lit(" in "), F.col("matched_field")).alias("why"),
        F.lit("PUBLIC_MENTION").alias("entity_type"), ids.entity_id(F.lit("PUBLIC_MENTION"), value).alias("entity_id"), tags.alias("tags"),
    )
