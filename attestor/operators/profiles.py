"""Profile fields from landed pages and JSON answers, each with where it comes from.

A page is read once, into tokens; every reader names candidates in the order in
which they count, and a field takes the first, or of links all. All of that is
expressions over one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import markup, urls
from attestor.functions.ids import PLATFORM_HOSTS, plain_name
from attestor.functions.markup import let
from attestor.functions.text import folded_latin, squeezed
from attestor.operators.observed import PLATFORM_NAMES, TITLE_PARTS, generic_name

#: The fields, in the order in which they are shown.
FIELD_ORDER = "display_name username bio location organization website personal_domain public_email avatar_url public_id external_links social_links".split()
LINKS = ("external_links", "social_links")
UNVERIFIED = "page_title_unverified"
#: Texts that stand for a bio and say nothing.
GENERIC_BIO = ["", "no bio", "none", "n/a", "na", "hello", "hello world", "hey", "available", "this is my bio", "gitlab.com", "github.com", "dev community", "dev.to"]
#: What platforms add to a name in a page's title.
TITLE_SUFFIXES = [
    r"\s*[·|—–-]\s*gitlab(?:\.com)?$",
    r"\s*[·|—–-]\s*github(?:\.com)?$",
    r"\s*[·|—–-]\s*dev community(?: profile)?$",
    r"\s+on instagram$",
    r"\s*[•·].*instagram.*$",
    r"\s*[·|—–-]\s*chess\.com$",
    r"\s*[·|—–-]\s*docker hub$",
    r"\s*[·|—–-]\s*wordpress(?:\.org)?$",
    r"\s*[·|—–-]\s*gog(?:\.com)?$",
    r"\s*[|·—–-]\s*last\.fm$",
    r"'s music profile.*$",
    r"’s music profile.*$",
    r"'s profile on .+$",
    r"’s profile on .+$",
    r"\s+[–—-]\s*wordpress user profile$",
    r"\s+user profile$",
]
#: Keys of JSON answers that are tried where a site names none.
JSON_FALLBACKS = {"organization": ("company", "org", "organization"), "public_email": ("email",), "public_id": ("id", "uuid", "node_id"), "avatar_url": ("avatar_url", "avatar", "gravatar_url", "profile_image")}
NAME_KEYS, WEBSITE_KEYS = ("name", "displayName"), ("blog", "website")



def handle_of(username: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(username, F.lit(""))), "^@+", ""))


def clean_name(raw: Column, handle: Column, platform: Column, names: list[str] = PLATFORM_NAMES) -> Column:
    """A display name without what platforms add to it; empty if it says nothing. ``names`` are those of the platforms that are known."""
    low = lambda c: F.lower(F.trim(c))
    known = lambda c: low(c).isin(names) | F.coalesce(low(c) == low(platform), F.lit(False))

    def without_suffixes(text: Column) -> Column:
        out = F.trim(F.regexp_replace(text, F.concat(F.lit(r"(?iu)\s*\(@\Q"), handle, F.lit(r"\E\)\s*")), F.lit(" ")))
        for pattern in TITLE_SUFFIXES:
            out = F.trim(F.regexp_replace(out, "(?iu)" + pattern, ""))
        return out

    def without_platform(text: Column) -> Column:
        return let(F.filter(F.transform(F.split(text, TITLE_PARTS), F.trim), lambda p: p != ""), lambda parts: let(rest(parts), lambda r: F.when((r != "") & ~generic_name(r, handle, platform), r).otherwise(text)))

    def rest(parts: Column) -> Column:
        n = F.size(parts)
        last = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), " | ")
        first = F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), " | ")
        return F.when((n >= 2) & known(F.get(parts, n - 1)), last).when((n >= 2) & known(F.get(parts, F.lit(0))), first).otherwise("")

    def judged(text: Column) -> Column:
        same = (F.lower(F.regexp_replace(text, "^@+", "")) == handle) | (plain_name(text, folded_latin) == plain_name(handle, folded_latin))
        return F.when((text == "") | same | generic_name(text, handle, platform), "").otherwise(F.left(text, F.lit(200)))

    text = let(squeezed(F.coalesce(raw, F.lit(""))), without_suffixes)
    return let(let(text, without_platform), lambda t: let(F.btrim(t, F.lit(" ·|-—–:")), judged))


def looks_like_email(value: Column) -> Column:
    v = F.trim(value)
    return v.rlike(r"^[^@]+@.*\..*$") & ~v.contains(" ")


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, behind a generator, so that the optimizer doesn't write them out wherever they are used."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _text(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("string")


def _raw(field: str, raw: Column, source, method, original: Column | None = None, rejected_by=None) -> Column:
    return F.struct(F.lit(field).alias("field"), _text(raw).alias("raw"), _text(source).alias("source"), _text(method).alias("method"), _text(raw if original is None else original).alias("original"), _text(rejected_by).alias("rejected_by"))


def enrich_pages(profiles: DataFrame, names: list[str] = PLATFORM_NAMES) -> DataFrame:
    """All columns of profiles(platform, username, profile_url, html, payload, authenticated, ...) and ``observed``: the fields that are found, in their order.

    ``html`` and ``payload`` (a JSON answer) may be null; ``authenticated`` tells which
    kind of fetch the page comes from. Optional columns ``name_fields`` and
    ``website_fields`` (arrays of paths) and ``bio_field``, ``location_field`` and
    ``avatar_field`` say where a site's answers have them. A field is a struct of
    field, value (the first), items (of links: all that differ in value or
    source, with their sources), original, source, method, source_url,
    derived_from and rejected_by. A name from a title is unverified.

    Names, URLs and other texts are three lists of candidates, in the order in
    which they count; all of a list are cleaned by one expression.
    """
    own = profiles.columns
    path_in = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in own else F.lit(default)
    paths_in = lambda c, default: F.coalesce(F.col(c), F.array(*map(F.lit, default))) if c in own else F.array(*map(F.lit, default))
    slug = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col("platform"), F.lit("profile"))), "[^a-z0-9]+", "_"), F.lit("_"))
    p = staged(
        profiles,
        _handle=handle_of(F.col("username")),
        _key=F.when(slug == "", "profile").otherwise(slug),
        _page=F.when(F.coalesce(F.col("authenticated"), F.lit(False)), "AUTHENTICATED_PUBLIC").otherwise("HTML"),
        _tokens=markup.tokens(F.col("html"), ("meta", "link", "a", "script", "title")),
        _json=F.col("payload"),
    )
    t, none = F.col("_tokens"), F.array().cast("array<string>")
    plain = [F.get(F.transform(F.filter(t, lambda x: x["tag"] == "title"), lambda x: x["body"]), F.lit(0)), *(markup.meta(t, f"og:{m}") for m in ("title", "url", "image")), markup.first_of(t, "link", lambda x: markup.rel(x, "canonical"), "href")]
    me = F.transform(F.filter(t, lambda x: (x["tag"] == "a") & F.coalesce(markup.rel(x, "me"), F.lit(False))), lambda x: F.trim(F.coalesce(markup.attribute(x, "href"), F.lit(""))))
    kind = lambda b: F.lower(F.coalesce(F.get_json_object(b, "$['@type']"), F.get_json_object(b, "$.type"), F.lit("")))
    person = F.get(F.filter(markup.json_blocks(t), lambda b: kind(b).contains("person")), F.lit(0))
    p = staged(p, _person=person, _said=F.concat(F.array(*(F.coalesce(c, F.lit("")) for c in plain)), F.coalesce(me, none))).drop("_tokens")
    p = p.withColumn("_texts", markup.unescaped("_said"))

    h, api, page = F.col("_handle"), lambda k: F.concat("_key", F.lit("_api."), k), F.col("_page")
    text = lambda k: F.get("_texts", F.lit(k))
    dig = lambda k: F.call_function("get_json_object", F.col("_json"), F.concat(F.lit("$"), F.regexp_replace(F.concat(F.lit("."), k), r"\.([0-9]+)(?=\.|$)", "[$1]")))
    top = lambda k: F.get_json_object("_json", f"$.{k}")
    of = lambda k: F.get_json_object("_person", f"$.{k}")
    each = lambda c, default, field: F.transform(paths_in(c, default), lambda k: _raw(field, dig(k), api(k), "JSON_API"))
    bound = F.coalesce((F.lower(F.trim("platform")) == "instagram") & (h != "") & F.lower(text(1)).contains(F.concat(F.lit("(@"), h, F.lit(")"))), F.lit(False))
    called = F.concat(
        each("name_fields", NAME_KEYS, "display_name"),
        F.array(
            _raw("display_name", of("name"), "html_jsonld.name", page),
            _raw("display_name", text(1), F.when(bound, "instagram_og.title").otherwise("html_og.title"), page, None, F.when(~bound, UNVERIFIED)),
            _raw("display_name", text(0), "html_title", page, None, UNVERIFIED),
        ),
    )
    # a picture, a site, or a link, which is a site too unless it is a platform's
    face = path_in("avatar_field", "avatar_url")
    tweets = F.coalesce(F.nullif(top("twitter_username"), F.lit("")), F.nullif(top("twitter"), F.lit("")))
    image = F.coalesce(of("image.url"), F.when(~F.coalesce(of("image").startswith("{"), F.lit(False)), of("image")))
    same = F.when(of("sameAs").startswith("["), F.from_json(of("sameAs"), "array<string>")).otherwise(F.array_compact(F.array(of("sameAs"))))
    links = lambda hrefs, source: F.coalesce(F.transform(hrefs, lambda x: _raw("link", x, source, page)), F.array())
    at = F.concat(
        each("website_fields", WEBSITE_KEYS, "site"),
        F.array(_raw("avatar_url", dig(face), api(face), "JSON_API"), *(_raw("avatar_url", top(k), api(F.lit(k)), "JSON_API") for k in JSON_FALLBACKS["avatar_url"])),
        F.array(_raw("link", F.concat(F.lit("https://x.com/"), F.regexp_replace(tweets, "^@+", "")), api(F.lit("twitter_username")), "JSON_API"), _raw("avatar_url", image, "html_jsonld.image", page)),
        links(same, "html_jsonld.sameAs"),
        F.array(_raw("site", of("url"), "html_jsonld.url", page)),
        links(F.slice("_texts", F.lit(len(plain) + 1), F.greatest(F.size("_texts") - len(plain), F.lit(0))), "html_rel_me"),
        F.array(_raw("avatar_url", text(3), "html_og.image", page), _raw("site", text(4), "html_canonical", page), _raw("site", text(2), "html_og.url", page)),
    )
    bio, place = path_in("bio_field", "bio"), path_in("location_field", "location")
    told, number = F.trim(dig(bio)), top("id")
    mail = lambda c: F.when(looks_like_email(c), F.lower(F.trim(c)))
    others = F.array(
        _raw("username", h, F.concat("_key", F.lit(".username")), "INPUT", F.col("username")),
        _raw("bio", F.when(~plain_name(told, folded_latin).isin(GENERIC_BIO) & (F.length(told) >= 8), F.left(told, F.lit(300))), api(bio), "JSON_API"),
        _raw("location", F.left(dig(place), F.lit(120)), api(place), "JSON_API"),
        _raw("public_id", F.when(number.rlike("^-?[0-9]+$"), number), api(F.lit("id")), "JSON_API"),
        *(_raw("organization", F.left(top(k), F.lit(120)), api(F.lit(k)), "JSON_API") for k in JSON_FALLBACKS["organization"]),
        *(_raw("public_email", mail(top(k)), api(F.lit(k)), "JSON_API") for k in JSON_FALLBACKS["public_email"]),
        *(_raw("public_id", top(k), api(F.lit(k)), "JSON_API") for k in JSON_FALLBACKS["public_id"]),
        _raw("public_email", mail(of("email")), "html_jsonld.email", page),
    )
    p = staged(p, _called=called, _at=at, _others=others)
    valued = lambda c, value: F.struct(*(c[k].alias(k) for k in ("field", "source", "method", "original", "rejected_by")), F.trim(value).alias("value"))
    p = staged(
        p,
        _named=F.transform("_called", lambda c: valued(c, clean_name(c["raw"], h, F.col("platform"), names))),
        _placed=F.transform("_at", lambda c: valued(c, urls.normalized(c["raw"]))),
        _plain=F.transform("_others", lambda c: valued(c, c["raw"])),
    )
    p = staged(p, _sited=F.transform("_placed", lambda c: F.struct(c.alias("c"), urls.bare_host(c["value"]).alias("host"), urls.bare_host(c["value"]).isin(PLATFORM_HOSTS).alias("platform"))))
    is_ = lambda c, *fields: c["field"].isin(*fields) & F.coalesce(c["value"] != "", F.lit(False))
    site = F.filter("_sited", lambda x: is_(x["c"], "site", "link") & ~x["platform"])

    def found(name: str) -> Column:
        if name == "website":
            mine = F.transform(site, lambda x: x["c"])
        elif name == "personal_domain":
            mine = F.transform(site, lambda x: x["c"].withField("value", x["host"]).withField("method", F.lit("DERIVED")).withField("original", x["host"]))
        elif name in LINKS:
            mine = F.transform(F.filter("_sited", lambda x: is_(x["c"], "link") & (x["platform"] == (name == "social_links"))), lambda x: x["c"].withField("original", x["c"]["value"]))
        else:
            mine = F.filter({"display_name": "_named", "avatar_url": "_placed"}.get(name, "_plain"), lambda c: is_(c, name))
        items = F.array_distinct(F.transform(mine, lambda c: F.struct(c["value"], c["source"]))) if name in LINKS else F.lit(None).cast("array<struct<value:string,source:string>>")
        url = lambda c: F.when(c["method"] != "INPUT", F.nullif(F.col("profile_url"), F.lit("")))
        first = lambda c: F.struct(F.lit(name).alias("field"), c["value"].alias("value"), items.alias("items"), c["original"].alias("original"), c["source"].alias("source"), c["method"].alias("method"), url(c).alias("source_url"), F.lit("website" if name == "personal_domain" else None).cast("string").alias("derived_from"), c["rejected_by"].alias("rejected_by"))
        return F.get(F.transform(F.slice(mine, 1, 1), first), F.lit(0))

    return p.select(*own, F.array_compact(F.array(*map(found, FIELD_ORDER))).alias("observed"))
