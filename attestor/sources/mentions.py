"""Landed answers of the services that are searched for mentions, in one shape.

A landing job sends what ``requests`` lists and writes (id, provider, status, body);
``hits`` reads all services' answers in one pass. A table that is written with
``partitionBy("provider")`` is read for some services only: the filter is on the folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.results import result_list
from attestor.functions.text import squeezed
from attestor.functions.urls import unwrapped
from attestor.sources.steps import spread

LANDED = "id string, status int, body string, provider string"
#: Services in the order in which they are asked. A local meta search comes last.
PROVIDERS = "duckduckgo-html hn-algolia github-search reddit-search public-documents google-cse searxng".split()
#: Services that need a key, so not asked unless the caller says that there is one.
KEYED = ("google-cse",)
#: Services whose answer is a page.
PAGES = ("duckduckgo-html", "public-documents")
#: Where a JSON answer's hits are, and in each the fields by preference.
SHAPES = {
    "hn-algolia": {"rows": "$.hits", "title": ("title", "story_title"), "url": ("url",), "snippet": ("story_text", "comment_text"), "author": ("author",), "published_at": ("created_at",)},
    "github-search": {"rows": "$.items", "title": ("title",), "url": ("html_url",), "snippet": ("body",), "author": ("user.login",), "published_at": ("created_at",)},
    "reddit-search": {"rows": "$.data.children", "inner": "$.data", "title": ("title",), "url": ("url",), "snippet": ("selftext", "title"), "author": ("author",), "published_at": ("created_utc",)},
    "google-cse": {"rows": "$.items", "title": ("title",), "url": ("link",), "snippet": ("snippet",)},
    "searxng": {"rows": "$.results", "title": ("title",), "url": ("url", "href"), "snippet": ("content", "snippet")},
}
LENGTHS = {"title": 180, "snippet": 240, "author": 80}
FIELDS = ("title", "url", "snippet", "author", "published_at")


def requests(queries: DataFrame, limit: int = 5, providers: tuple[str, ...] = tuple(p for p in PROVIDERS if p not in KEYED)) -> DataFrame:
    """queries(..., text) -> each query for each service, in their order, with the parameters to send; keys are the landing job's.

    Services are literals that each row is multiplied by, so nothing is joined. Queries without text ask nothing.
    """
    term = F.regexp_replace(F.trim("text"), "^@+", "")
    n = lambda k, most: F.lit(str(max(1, min(k, most))))
    sent = {
        "duckduckgo-html": {"q": term},
        "hn-algolia": {"query": term, "hitsPerPage": n(4 * limit, 20)},
        "github-search": {"q": F.concat(term, F.lit(" in:title,body")), "per_page": n(limit, 10)},
        "reddit-search": {"q": term, "limit": n(limit, 10), "sort": F.lit("relevance")},
        "public-documents": {"q": F.concat(term, F.lit(" (filetype:pdf OR filetype:doc OR filetype:docx)"))},
        "google-cse": {"q": term, "num": n(limit, 10)},
        "searxng": {"q": term, "format": F.lit("json")},
    }
    unknown = set(providers) - set(sent)
    if unknown:
        raise ValueError(f"no such services: {sorted(unknown)}")
    params = lambda p: F.create_map(*(x for k, v in sent[p].items() for x in (F.lit(k), v)))
    each = F.array(*(F.struct(F.lit(PROVIDERS.index(p)).alias("rank"), F.lit(p).alias("provider"), params(p).alias("params")) for p in PROVIDERS if p in providers))
    return queries.where(F.coalesce(F.trim("text"), F.lit("")) != "").select(*queries.columns, F.inline(each))


def read(spark: SparkSession, path: str, providers: tuple[str, ...] = ()) -> DataFrame:
    """Landed answers in Parquet by provider; of the named services only, if any are named."""
    landed = spark.read.schema(LANDED).parquet(path)
    return landed.where(F.col("provider").isin(*providers)) if providers else landed


def _first(v: Column, paths: tuple[str, ...]) -> Column:
    """The first of these values that is neither missing, null nor empty; '' without one."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths), F.lit(""))


def _json_hit(provider: str, limit: int):
    shape = SHAPES[provider]

    def one(v: Column, at: Column) -> Column:
        inner = F.try_variant_get(v, shape["inner"], "variant") if "inner" in shape else v
        url = _first(inner, shape["url"])
        if provider == "hn-algolia":
            number = _first(inner, ("objectID",))
            url = F.when(number != "", F.concat(F.lit("https://news.ycombinator.com/item?id="), number)).otherwise(url)
        if provider == "reddit-search":
            link = _first(inner, ("permalink",))
            url = F.when(link.startswith("/"), F.concat(F.lit("https://www.reddit.com"), link)).otherwise(url)
        value = {c: _first(inner, shape[c]) if c in shape else F.lit("") for c in FIELDS} | {"url": url}
        value |= {c: F.left(squeezed(value[c]), F.lit(n)) for c, n in LENGTHS.items()}
        isread = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
        if provider == "searxng":
            isread &= url != ""
        return F.struct(at.alias("place"), isread.alias("read"), *(F.when(isread, value[c]).alias(c) for c in FIELDS))

    return one


def _page_hit(r: Column, at: Column) -> Column:
    isread = r["href"].isNotNull()
    short = lambda c: F.left(squeezed(F.coalesce(r[c], F.lit(""))), F.lit(LENGTHS[c]))
    value = {"title": short("title"), "url": unwrapped(r["href"]), "snippet": short("snippet"), "author": F.lit(""), "published_at": F.lit("")}
    return F.struct(at.alias("place"), isread.alias("read"), *(F.when(isread, value[c]).alias(c) for c in FIELDS))


def _within(items: Column, last: Column) -> Column:
    """Items that are read after the place ``last`` count as unread."""
    blank = lambda x: F.struct(x["place"].alias("place"), F.lit(False).alias("read"), *(F.lit(None).cast("string").alias(c) for c in FIELDS))
    return F.transform(items, lambda x: F.when(x["read"] & (x["place"] > last), blank(x)).otherwise(x))


def hits(landed: DataFrame, limit: int = 5) -> DataFrame:
    """landed(..., provider, status, body) -> a row for each entry of an answer: place, read, title, url, snippet, author, published_at.

    Entries that are no objects, have no link, or come after as many as are taken of a service
    (twice ``limit`` of a page, ``limit`` of the local search) aren't read and have no
    fields. Answers are few bytes for what reading them costs, so they are dealt over all tasks. An answer without entries, an error, a body of another shape, or one of an unknown
    service is one row without place. Numbers are written as Spark writes them; null and empty
    fields give way to the next. Other columns, but for body and those above, are handed on.
    """
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    tree = F.try_parse_json(F.when(ok & F.col("provider").isin(*SHAPES), F.col("body")))
    page = F.when(ok & F.col("provider").isin(*PAGES), F.col("body"))
    kept = [c for c in landed.columns if c not in ("body", "place", "read", *FIELDS)]
    if not landed.isStreaming:
        landed = spread(landed)
    # what is parsed is parsed once, however many columns ask for it
    parsed = landed.select(*kept, F.inline(F.array(F.struct(tree.alias("tree"), F.when(page.isNotNull(), result_list(page)).alias("results")))))
    made = F.when(F.col("provider").isin(*PAGES), F.transform("results", _page_hit))
    for provider, shape in SHAPES.items():
        items = F.transform(F.try_variant_get("tree", shape["rows"], "array<variant>"), _json_hit(provider, limit))
        made = made.when(F.col("provider") == provider, items)
    # items are made once, and the place of the last that is taken is found once for all of them
    most = F.when(F.col("provider").isin(*PAGES), 2 * limit).when(F.col("provider") == "searxng", max(1, limit))
    listed = parsed.select(*kept, F.inline(F.array(F.struct(made.alias("items"))))).withColumn("last", F.get(F.filter("items", lambda x: x["read"]), most - 1)["place"])
    return listed.select(*kept, F.inline_outer(_within(F.col("items"), F.col("last")))).withColumn("read", F.coalesce("read", F.lit(False)))
