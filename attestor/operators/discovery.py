"""Leads and what they turn up: mentions, novelty of indicators, pivots within a budget, query plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.ids import AFFIXES, PLATFORM_HOSTS, UNRELATED, username_match
from attestor.functions.text import folded
from attestor.functions.urls import bare_host, host_of, path_segments, query_of
from attestor.sources.steps import cut, fits, spread

#: Hosts that list a person's links.
LINK_HUBS = "linktr.ee beacons.ai lnk.bio carrd.co about.me bio.link campsite.bio solo.to heylink.me".split()
#: Which novelty holds when sights of one indicator differ.
NOVELTY_RANK = {"NOVEL": 5, "DERIVED": 4, "OBSERVED": 3, "KNOWN": 2, "OPERATOR_INPUT": 1, "REDUNDANT": 0}
PRIORITY_HIGH, PRIORITY_MEDIUM, PRIORITY_LOW, PRIORITY_NONE = 100, 50, 10, 0
DERIVED_RULES = "bio_handle website personal_domain external_links social_links public_email".split()
DIRECT_KINDS = ("username", "email", "domain")
ACTIONS = {"username": "search username", "domain": "inspect domain", "email": "search exact email", "url": "inspect public URL"}


def host_in(value: Column) -> Column:
    """The host of a URL or of a bare domain, without www."""
    h = bare_host(value)
    return F.when(h != "", h).otherwise(F.regexp_replace(F.lower(F.split_part(value, F.lit("/"), F.lit(1))), r"^www\.", ""))


def on_platform(host: Column) -> Column:
    """Whether a host or one of its parent domains is a platform's."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.arrays_overlap(parents, F.array(*map(F.lit, PLATFORM_HOSTS)))


def norm_value(kind: Column, value: Column) -> Column:
    """What makes two indicators one: URLs and domains by host, handles without @."""
    return F.when(kind.isin("url", "domain"), host_in(value)).when(kind == "username", F.lower(F.regexp_replace(F.trim(value), "^@+", ""))).otherwise(F.lower(F.trim(value)))


def annotate(indicators: DataFrame, leads: DataFrame, known_urls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """indicators(kind, value, rule, source, ord), leads(kind, norm), known_urls(url) -> one row for each (kind, norm) with novelty and priority.

    The novelty of highest rank holds; the rest is the first sight's. Columns in ``by``, such as a case, are part of all keys.
    """
    i = indicators.withColumn("norm", norm_value(F.col("kind"), F.col("value"))).where("norm <> ''").withColumn("host", F.when(F.col("kind").isin("url", "domain"), host_in(F.col("value"))).otherwise(""))
    own = lambda prefix: [F.col(c).alias(f"{prefix}{c}") for c in by]
    alike = lambda prefix, on: reduce(lambda a, c: a & (F.col(c) == F.col(f"{prefix}{c}")), by, on)
    i = i.join(leads.select(*own("l_"), F.col("kind").alias("l_kind"), F.col("norm").alias("l_norm")).distinct(), alike("l_", (F.when(F.col("kind") == "url", "domain").otherwise(F.col("kind")) == F.col("l_kind")) & (F.col("norm") == F.col("l_norm"))), "left")
    i = i.join(known_urls.select(*own("k_"), F.lower(F.regexp_replace("url", "/+$", "")).alias("k_url")).distinct(), alike("k_", (F.col("kind") == "url") & (F.lower(F.regexp_replace("value", "/+$", "")) == F.col("k_url"))), "left")
    plain_platform = F.col("kind").isin("url", "domain") & on_platform(F.col("host")) & ~F.col("host").isin(LINK_HUBS)
    novelty = (
        F.when(F.col("l_norm").isNotNull(), "OPERATOR_INPUT")
        .when(F.col("k_url").isNotNull(), "KNOWN")
        .when(plain_platform, "REDUNDANT")
        .when(F.col("rule").isin(DERIVED_RULES), "DERIVED")
        .when(F.col("rule").startswith("discovered_"), F.when(F.col("kind") == "username", "DERIVED").otherwise("NOVEL"))
        .otherwise("NOVEL")
    )
    i = i.withColumn("novelty", novelty)
    rank = F.lit(0)
    for name, r in NOVELTY_RANK.items():
        rank = F.when(F.col("novelty") == name, r).otherwise(rank)
    g = i.groupBy(*by, "kind", "norm").agg(F.max_by("novelty", rank).alias("novelty"), F.min_by(F.struct("value", "rule", "host", "source"), "ord").alias("f"), F.min("ord").alias("ord"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))
    return g.select(*by, "kind", "norm", "ord", F.col("f.value").alias("value"), F.col("f.rule").alias("rule"), "novelty", priority(F.col("kind"), F.col("f.host"), F.col("novelty")).cast("long").alias("priority"), "sources", "n")


def priority(kind: Column, host: Column, novelty: Column) -> Column:
    """How much a follow-up is worth."""
    return (
        F.when(novelty.isin("REDUNDANT", "OPERATOR_INPUT", "KNOWN"), PRIORITY_NONE)
        .when(kind.isin("email", "username"), PRIORITY_HIGH)
        .when(kind.isin("domain", "url") & (host != "") & (host.isin(LINK_HUBS) | ~on_platform(host)), PRIORITY_HIGH)
        .when(kind == "url", PRIORITY_MEDIUM)
        .otherwise(PRIORITY_LOW)
    )


def propose_pivots(indicators: DataFrame, case: str, budget: int, known: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    """indicators(case, kind, norm, novelty, priority, ord) -> accepted or the reason why not, for each.

    known(case, kind, norm) counts as accepted before; spent(case, spent) is taken from the budget.

    In order of priority and kind: what isn't new is refused first, then what was
    accepted before, then what is over the budget, then what has no priority. Only
    accepted ones count as seen, so of equal keys the first that may be accepted is.

    Keys are grouped with partial sums; of a case's fresh keys only the first
    ``budget`` are ranked, which a window with a limit does within each task
    first, so a case that holds a third of all rows isn't sorted in one.
    """
    useful = F.col("novelty").isin("NOVEL", "DERIVED") & (F.col("priority") > 0)
    i = indicators.where(F.col("kind").isin(*ACTIONS)).withColumn("useful", useful)
    key, place = [case, "kind", "norm"], F.struct((-F.col("priority")).alias("p"), F.col("ord").alias("o"))
    old = F.lit(False)
    if known is not None:
        i = i.join(known.select(*(F.col(c).alias(f"k_{c}") for c in key)).distinct(), (F.col(case) == F.col(f"k_{case}")) & (F.col("kind") == F.col("k_kind")) & (F.col("norm") == F.col("k_norm")), "left")
        i = i.withColumn("old", F.col("k_norm").isNotNull()).drop(*(f"k_{c}" for c in key))
        old = F.col("old")
    first = i.where(F.col("useful") & ~old).groupBy(*key).agg(F.min(place).alias("first"))
    rank = F.row_number().over(Window.partitionBy(case).orderBy("first.p", "kind", "first.o", "norm"))
    taken = first.withColumn("k", rank).where(F.col("k") <= budget)
    if spent is not None:
        taken = taken.join(spent, case, "left").where(F.col("k") <= budget - F.coalesce("spent", F.lit(0)))
    taken = taken.select(*(F.col(c).alias(f"t_{c}") for c in key), "first")
    same = (F.col(case) == F.col(f"t_{case}")) & (F.col("kind") == F.col("t_kind")) & (F.col("norm") == F.col("t_norm"))
    i = i.join(taken, same, "left")
    kept = F.col("first").isNotNull()
    is_first = F.coalesce(place == F.col("first"), F.lit(False))
    # a repeat is a duplicate only of what was accepted; of one over the budget it is over the budget too
    reason = F.when(~F.col("useful"), F.when(F.col("novelty") == "REDUNDANT", "redundant").otherwise("not_novel")).when(old, "duplicate").when(~kept, "budget").when(~is_first, "duplicate")
    action = F.lit(None).cast("string")
    for kind, name in ACTIONS.items():
        action = F.when(F.col("kind") == kind, name).otherwise(action)
    return i.select(case, "kind", "norm", "ord", "priority", action.alias("action"), reason.isNull().alias("accepted"), reason.alias("reason"))


def metrics(indicators: DataFrame, pivots: DataFrame, case: str) -> DataFrame:
    """What was extracted, what of it is new, and what was followed."""
    useful = F.col("novelty").isin("NOVEL", "DERIVED") & (F.col("priority") > 0)
    a = indicators.groupBy(case).agg(
        F.count("*").alias("indicators_extracted"),
        F.count_if(F.col("novelty").isin("NOVEL", "DERIVED")).alias("novel_indicators"),
        F.count_if(F.col("novelty") == "REDUNDANT").alias("redundant_indicators"),
        F.count_if(useful & (F.col("kind") == "username")).alias("new_handles"),
        F.count_if(useful & (F.col("kind") == "domain")).alias("new_domains"),
    )
    b = pivots.groupBy(case).agg(F.count("*").alias("pivots_proposed"), F.count_if("accepted").alias("pivots_executed"), F.count_if(~F.col("accepted")).alias("pivots_suppressed"))
    return a.join(b, case)


FIELDS = ("title", "snippet", "url", "author")
#: Query parameters whose value names a user.
USER_PARAMETERS = "id user username u".split()
MATCH_TYPES = {"name": "full_name", "email": "exact_email", "domain": "exact_host"}
ASSOCIATIONS = {"username": "name_plus_username", "email": "name_plus_email", "domain": "name_plus_domain"}


#: Three characters in a row that are neither a to z, digits nor gaps; places may overlap.
TRIPLES = r"(?=([^a-z0-9\s]{3}))"


def usable_leads(leads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """leads(kind, lead) -> kind, lead, form, key of those that can match: handles of three characters, names of two words, addresses with a domain, hosts with a dot.

    ``form`` is what is looked for, ``key`` what every text with it has: a run of a
    to z and digits, or the first three characters where it has none; the letters
    around its first space; or what is next to its @.
    """
    l = leads.select(*by, "kind", F.trim("lead").alias("lead")).distinct()  # noqa: E741
    name = F.lower(folded(F.col("lead")))
    form = (
        F.when(F.col("kind") == "username", F.lower(F.regexp_replace("lead", "^@+", "")))
        .when(F.col("kind") == "name", name)
        .when(F.col("kind") == "domain", F.regexp_replace(F.lower("lead"), r"^www\.", ""))
        .otherwise(F.lower("lead"))
    )
    fits = (
        F.when(F.col("kind") == "username", F.length("form") >= 3)
        .when(F.col("kind") == "name", F.col("form").contains(" "))
        .when(F.col("kind") == "domain", F.col("form").contains(".") & ~F.col("form").contains(" "))
        .otherwise(F.col("form").rlike(r"@[^@]*\.[^@]*$"))
    )
    run, triple = F.regexp_extract("form", "[a-z0-9]+", 0), F.regexp_extract("form", r"[^a-z0-9\s]{3}", 0)
    word = F.when(run != "", run).when(triple != "", triple).otherwise(ANY)
    at = F.regexp_extract("form", "[a-z0-9]*@[a-z0-9]*", 0)
    first, second = F.split_part("form", F.lit(" "), F.lit(1)), F.split_part("form", F.lit(" "), F.lit(2))
    gap = F.concat(F.right(first, F.lit(3)), F.lit(" "), F.left(second, F.lit(3)))
    return l.withColumn("form", form).where(fits).withColumn("key", F.when(F.col("kind") == "name", gap).when(F.col("kind") == "email", at).otherwise(word))


#: So many keys are looked for one by one.
FEW_KEYS = 40
#: The key of leads that have none, such as one of two marks around a space; every text has it.
ANY = " "


def _shapes(leads: DataFrame) -> list[str]:
    """The shapes of keys that leads have; ``leads`` are written, so these are cheap to ask for: there are at most fourteen."""
    n = F.instr("key", " ")
    other = F.when(F.col("kind") == "email", "email").when(F.col("key") == ANY, "any").when(F.col("key").rlike("^[a-z0-9]"), "run").otherwise("triple")
    shapes = leads.select(F.when(F.col("kind") == "name", F.concat_ws(",", n - 1, F.length("key") - n)).otherwise(other).alias("s")).distinct().collect()
    return sorted(r["s"] for r in shapes)


def _keys(shapes: list[str], low: Column, plain: Column) -> Column:
    """All keys of a text that leads of these shapes can have."""
    around = lambda a, b: F.regexp_extract_all(plain, F.lit(rf"(?=(\S{{{a}}} \S{{{b}}}))"), F.lit(1))
    # an address may follow letters that aren't its own, so what stands before an @ counts from each of its letters
    begun = lambda m: F.transform(F.sequence(F.lit(1), F.instr(m, "@")), lambda k: F.substr(m, k))
    forms = {
        "run": F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)),
        "triple": F.regexp_extract_all(low, F.lit(TRIPLES), F.lit(1)),
        "email": F.when(low.contains("@"), F.flatten(F.transform(F.regexp_extract_all(low, F.lit("(?<![a-z0-9])(?=([a-z0-9]*+@[a-z0-9]*))"), F.lit(1)), begun))).otherwise(F.array().cast("array<string>")),
        "any": F.array(F.lit(ANY)),
    }
    parts = [forms[s] if s in forms else around(*map(int, s.split(","))) for s in shapes]
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def _few_keys(leads: DataFrame) -> Column | None:
    """Which keys of handles, names and hosts a text holds, if these are few: each is looked for, and a text's other words are never written out. What stands inside of a word is told when fields are compared."""
    few = leads.where((F.col("kind") != "email") & (F.col("key") != ANY)).select("key", (F.col("kind") == "name").alias("named")).distinct().limit(FEW_KEYS + 1).collect()
    held = [F.when(F.col("plain" if r["named"] else "low").contains(r["key"]), r["key"]) for r in sorted(few)]
    return None if len(few) > FEW_KEYS else F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")


def lead_fields(pages: DataFrame, leads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pages(id, title, snippet, url, author), leads(kind, lead) -> id, version, kind, lead, field, match_type: each page's leads.

    Leads and pages meet by equality: each lead has a key, and a page has all keys
    that it could meet. Leads are written once. If they are small (by measured bytes) they are sent to all
    tasks, and what meets is compared where the page is, in one pass in which no text is shuffled; else
    keys meet leads by shuffle, and what met is joined with the pages' texts as they came. What meets is compared with the page's fields, in their
    order, URLs first for handles and hosts. A page that comes twice, or two with
    one id, are a page each. Columns in ``by`` (texts, none null) are both tables': a page meets only leads that
    agree in these, so that cases whose leads share a key don't meet each other's pages.
    """
    l = cut(usable_leads(leads, by), "leads")  # noqa: E741
    shapes = _shapes(l)
    names = any("," in s for s in shapes)
    version = F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in FIELDS))
    f = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = spread(pages.select(*by, "id", *FIELDS))
    plain = [F.when(f(c) == "", F.lit("")).otherwise(F.lower(folded(f(c)))).alias(f"plain_{c}") for c in FIELDS] if names else [F.lower(f(c)).alias(f"plain_{c}") for c in FIELDS]
    # a generator stands between, so that texts are folded once and not for each of their keys
    shown = rows.select(*by, "id", version.alias("version"), *(f(c).alias(c) for c in FIELDS), F.inline(F.array(F.struct(*(F.lower(f(c)).alias(f"low_{c}") for c in FIELDS), *plain))))
    joined = lambda p: F.concat_ws("\n", *(f"{p}_{c}" for c in FIELDS))
    few = _few_keys(l)
    found = _keys(shapes if few is None else [s for s in shapes if s in ("email", "any")], F.col("low"), F.col("plain"))
    if few is not None:
        found = F.array_distinct(F.concat(few, found))
    keyed = lambda df, kept: df.select(*kept, F.inline(F.array(F.struct(joined("low").alias("low"), joined("plain").alias("plain"))))).select(*kept, F.explode(found).alias("key"))
    small = fits(l)
    if small:
        both = keyed(shown, shown.columns).join(F.broadcast(l), [*by, "key"])
    else:
        met = keyed(shown, [*by, "id", "version"]).join(l, [*by, "key"])
        met = cut(met.select("id", "version", "kind", "lead", "form").distinct(), "met").select(F.col("id").alias("m_id"), F.col("version").alias("m_version"), "kind", "lead", "form")
        both = shown.join(met, (F.col("version") == F.col("m_version")) & F.col("id").eqNullSafe(F.col("m_id")))

    parts = F.transform(path_segments(F.lower("url")), lambda x: F.regexp_replace(x, "^@+", ""))
    asked = F.exists(F.split(F.lower(query_of(F.col("url"))), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)).isin(USER_PARAMETERS) & p.contains("=") & (F.substring_index(p, "=", -1) == F.col("form")))
    in_url = F.array_contains(parts, F.col("form")) | asked
    host = F.regexp_replace(host_of(F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url")))), r"^www\.", "")
    at_host = (host == F.col("form")) | F.endswith(host, F.concat(F.lit("."), F.col("form")))
    literal = F.concat(F.lit(r"\Q"), F.col("form"), F.lit(r"\E"))
    edged = lambda c, edge: c.contains(F.col("form")) & F.regexp_like(c, F.concat(F.lit(f"(?<![{edge}])"), literal, F.lit(f"(?![{edge}])")))

    def holds(c: str):
        text = F.col(f"low_{c}")
        return (
            F.when(F.col("kind") == "username", F.lit(c != "url") & edged(text, "a-z0-9_"))
            .when(F.col("kind") == "domain", F.lit(c != "url") & edged(text, "a-z0-9-"))
            .when(F.col("kind") == "name", F.col(f"plain_{c}").contains(F.col("form")))
            .otherwise(text.contains(F.col("form")))
        )

    field = F.when((F.col("kind") == "username") & in_url, "url").when((F.col("kind") == "domain") & at_host, "url")
    for c in FIELDS:
        field = field.when(holds(c), c)
    # what met is written with its field but without texts, as it is read more than once
    found = cut(both.select("id", "version", "kind", "lead", field.alias("field")), "met" if small else "fields").where("field IS NOT NULL")
    match_type = F.when(F.col("kind") == "username", F.when(F.col("field") == "url", "url_path_segment").otherwise("exact_token"))
    for kind, name in MATCH_TYPES.items():
        match_type = match_type.when(F.col("kind") == kind, name)
    return found.withColumn("match_type", match_type)


def mention_matches(pages: DataFrame, leads: DataFrame) -> DataFrame:
    """pages(id, title, snippet, url, author), leads(kind, lead) -> id, kind, lead, field, match_type, relevance, reason, associated."""
    return related(lead_fields(pages, leads)).drop("version")


def related(found: DataFrame) -> DataFrame:
    """found(id, kind, lead, match_type) with relevance: handles, addresses and hosts speak for themselves; a name is associated if one of these is on its page too, else ambiguous."""
    page = ["id", "version"] if "version" in found.columns else ["id"]
    beside = found.where(F.col("kind").isin(*DIRECT_KINDS)).groupBy(*page).agg(F.collect_set(F.struct("kind", "lead")).alias("others"))
    of = lambda kind: F.transform(F.array_sort(F.filter("others", lambda x: x["kind"] == kind)), lambda x: x["lead"])
    others = F.coalesce(F.concat(*(of(k) for k in ASSOCIATIONS)), F.array().cast("array<string>"))
    direct = F.col("kind").isin(*DIRECT_KINDS)
    beside_it = lambda kind: F.exists("others", lambda x: x["kind"] == kind)
    label = F.coalesce(*(F.when(beside_it(kind), name) for kind, name in ASSOCIATIONS.items()))
    reasons = {"exact_token": "exact_username", "url_path_segment": "username_path", "exact_email": "exact_email", "exact_host": "exact_domain"}
    reason = F.lit(None).cast("string")
    for match, name in reasons.items():
        reason = F.when(F.col("match_type") == match, name).otherwise(reason)
    f = found.join(beside.select(*(F.col(c).alias(f"b_{c}") for c in page), "others"), reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"b_{c}")), page, F.lit(True)), "left")
    has = F.size(others) > 0
    return f.select(
        *found.columns,
        F.when(direct, "DIRECT").when(has, "ASSOCIATED").otherwise("AMBIGUOUS").alias("relevance"),
        F.when(direct, reason).when(has, label).otherwise("full_name_only").alias("reason"),
        F.when(~direct, F.array_join(others, ",")).otherwise("").alias("associated"),
    )


def similar_handles(requested: DataFrame, observed: DataFrame) -> DataFrame:
    """requested(requested), observed(observed) -> the pairs that ``username_match`` doesn't call unrelated.

    Each observed handle names all forms of which it can be a variant: itself, its
    letters without separators or with fewer digits at an end, every two of its words, and
    what is left when a short end goes; requested handles meet these by
    equality, by their first two words, in a shuffle whose size is that of the keys. So no handle is held against all others.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), "^@+", ""))
    joined = lambda c: F.regexp_replace(c, r"[-_.]+", "")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[-_.]+"), lambda t: t != ""))
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    keys = lambda c: F.array(tagged("j:", joined(c)), tagged("r:", c))
    first_two = lambda c: tagged("w:", F.array_join(F.slice(F.array_sort(words(c)), 1, 2), " "))

    o, j, w = F.col("o"), joined(F.col("o")), words(F.col("o"))
    ends = F.transform(F.sequence(F.lit(1), F.length(j)), lambda k: F.when(F.substr(j, k + 1).rlike("^[0-9]+$"), tagged("j:", F.left(j, k))))
    # without an end: cut before or after each place; what is right among these is told by ``username_match``
    heads = F.transform(F.sequence(F.lit(1), F.length(o)), lambda k: F.when(F.substr(o, k + 1).rlike(r"^[_.-]?[0-9]+$|^[_.-].{0,8}$"), tagged("r:", F.left(o, k))))
    tails = F.transform(F.sequence(F.lit(1), F.length(o)), lambda k: F.when(F.left(o, k).rlike(r"^[0-9]+[_.-]?$|^.{0,8}[_.-]$"), tagged("r:", F.substr(o, k + 1))))
    pairs = F.flatten(F.transform(w, lambda x: F.transform(F.filter(w, lambda y: y > x), lambda y: tagged("w:", F.concat(x, F.lit(" "), y)))))
    singles = F.transform(w, lambda x: tagged("w:", x))
    made = F.array_distinct(F.array_compact(F.concat(keys(o), ends, heads, tails, pairs, singles)))
    left = spread(requested).select("requested", plain(F.col("requested")).alias("q")).where("q <> ''").select("requested", F.explode(F.array_distinct(F.array_append(keys(F.col("q")), first_two(F.col("q"))))).alias("key"))
    right = spread(observed).select("observed", plain(F.col("observed")).alias("o")).where("o <> ''").select("observed", F.explode(made).alias("key"))
    match = username_match(F.col("requested"), F.col("observed"))
    # Spark judges the exploded keys by the files they come from and would send all of them through the driver
    return left.join(right.hint("merge"), "key").select("requested", "observed").distinct().withColumn("match", match).where(F.col("match") != UNRELATED)


def query_plan(leads: DataFrame, budget: int = 12, per_lead: int = 4) -> DataFrame:
    """leads(case, kind, lead, ord) -> queries in tiers, without repeats, at most ``per_lead`` of one family for each lead and ``budget`` for each case.

    Tiers: the first handle; addresses and domains in turn; names; further
    handles; forms of each handle; handles with names; handles with domains; names with domains.
    """
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    l = leads.withColumn("nth", F.row_number().over(Window.partitionBy("case", "kind").orderBy("ord", "lead")))  # noqa: E741
    handle, first = F.col("kind") == "username", F.col("nth") == 1
    q = lambda tier, kind, text, when: F.when(when, F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("family"), text.alias("text")))
    lead = F.col("lead")
    made = F.array_compact(
        F.array(
            q(0, "username", quoted(lead), handle & first),
            q(1, "email", quoted(lead), F.col("kind") == "email"),
            q(1, "domain", quoted(lead), F.col("kind") == "domain"),
            q(2, "name", quoted(lead), F.col("kind") == "name"),
            q(3, "username", quoted(lead), handle & ~first),
            q(4, "username", F.concat(F.lit("@"), lead), handle),
            q(5, "username", F.concat(F.lit("inurl:"), lead), handle),
            q(6, "username", F.concat(quoted(lead), F.lit(" profile")), handle),
        )
    )
    single = l.select("case", "lead", F.col("nth").alias("i"), F.when(F.col("kind") == "domain", 1).otherwise(0).alias("j"), F.explode(made).alias("q")).select("case", "lead", "i", "j", "q.*")

    # of each kind only the first ``budget`` leads can get into a plan, so pairs are few whatever the case holds
    few = l.where(F.col("nth") <= budget)

    def paired(tier: int, family: str, one: str, other: str) -> DataFrame:
        a = few.where(F.col("kind") == one).select("case", "lead", F.col("nth").alias("i"))
        b = few.where(F.col("kind") == other).select("case", F.col("lead").alias("more"), F.col("nth").alias("j"))
        both = [quoted(F.col("lead")), quoted(F.col("more"))]
        # a name stands before the handle whose query it is
        text = F.concat_ws(" ", *(reversed(both) if other == "name" else both))
        return a.join(b, "case").select("case", "lead", "i", "j", F.lit(tier).alias("tier"), F.lit(family).alias("family"), text.alias("text"))

    rows = single.unionByName(paired(7, "pair", "username", "name")).unionByName(paired(8, "domain", "username", "domain")).unionByName(paired(9, "domain", "name", "domain"))
    place = F.struct("tier", "i", "j")
    once = rows.groupBy("case", F.lower("text").alias("key")).agg(F.min_by(F.struct("tier", "i", "j", "family", "lead", "text"), place).alias("r")).select("case", "r.*")
    capped = once.withColumn("k", F.row_number().over(Window.partitionBy("case", "family", "lead").orderBy("tier", "i", "j"))).where(F.col("k") <= per_lead)
    nth = F.row_number().over(Window.partitionBy("case").orderBy("tier", "i", "j"))
    return capped.withColumn("place", nth).where(F.col("place") <= budget).select("case", "family", "lead", "tier", "text", "place")
