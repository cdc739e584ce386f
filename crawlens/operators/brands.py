"""Brand profiles: validation, defaults, and the guard over post texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.scale import first_n, lookup

MAX_NAME, MAX_AUDIENCE, MAX_CONTEXT = 200, 1024, 2000
MAX_PHRASES, MAX_PHRASE_CHARS, MAX_TAGS, MAX_TAG_CHARS, MAX_HANDLE = 50, 100, 10, 50, 100
NO_BRAND = "none"
_STRINGS = "array<string>"


def contains_turkish(text: Column, phrase: Column) -> Column:
    """Substring match without case under Turkish rules (I/ı and İ/i are different letters)."""
    return F.contains(T.turkish_lower(text), T.turkish_lower(phrase))


def has_banned(text: Column, banned: Column) -> Column:
    needles = F.filter(F.transform(F.coalesce(banned, F.array().cast(_STRINGS)), T.collapse_ws), lambda p: p != "")
    return F.coalesce(F.exists(needles, lambda p: contains_turkish(T.collapse_ws(text), p)), F.lit(False))


def is_banned_tag(tag: Column, banned: Column) -> Column:
    bare = F.regexp_replace(tag, "^#+", "")
    needles = F.filter(
        F.transform(F.coalesce(banned, F.array().cast(_STRINGS)), lambda p: F.replace(p, F.lit(" "), F.lit(""))),
        lambda p: p != "",
    )
    return (bare != "") & F.coalesce(F.exists(needles, lambda p: contains_turkish(bare, p)), F.lit(False))


def guard(posts: DataFrame) -> DataFrame:
    """Adds ``passes`` and cleans body, cta, description and hashtags by the brand's rules.

    Needs ``brand_id``, ``emoji_usage`` and ``banned_phrases`` (null brand: everything passes).
    """
    strip = F.col("brand_id").isNotNull() & (F.col("emoji_usage") == "none")
    blank_to_null = lambda c: F.when(c != "", c)
    cleaned = posts.withColumns(
        {
            "body": F.when(strip, T.strip_emoji(F.col("body"))).otherwise(F.col("body")),
            "cta": F.when(strip, blank_to_null(T.strip_emoji(F.col("cta")))).otherwise(F.col("cta")),
            "description": F.when(strip, blank_to_null(T.strip_emoji(F.col("description")))).otherwise(F.col("description")),
        }
    )
    banned = F.col("banned_phrases")
    hit = has_banned(F.col("body"), banned) | has_banned(F.col("cta"), banned) | has_banned(F.col("description"), banned)
    return cleaned.withColumns(
        {
            "passes": F.col("brand_id").isNull() | ((F.col("body") != "") & ~hit),
            "hashtags": F.filter("hashtags", lambda t: F.col("brand_id").isNull() | ~is_banned_tag(t, banned)),
            "char_count": F.length("body"),
        }
    )


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Normalised profile columns and ``errors``; a profile with errors is for quarantine.

    Input: name, target_audience, extra_context, banned_phrases, default_hashtags,
    primary_color, secondary_color, social_handles (map).
    """
    arr = lambda c: F.coalesce(F.col(c), F.array().cast(_STRINGS))
    name = U.trim_ws(F.col("name"))
    text = lambda c: F.when(~T.is_blank(F.col(c)), U.trim_ws(F.col(c)))
    phrases = T.distinct_ci(F.filter(F.transform(arr("banned_phrases"), lambda p: T.collapse_ws(F.coalesce(p, F.lit("")))), lambda p: p != ""))
    bare_tags = F.filter(
        F.transform(arr("default_hashtags"), lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}\p{Nd}_]", "")),
        lambda t: t != "",
    )
    tags = T.distinct_ci(F.transform(bare_tags, lambda t: F.concat(F.lit("#"), t)))
    hex_of = lambda c: F.upper(F.regexp_replace(U.trim_ws(F.col(c)), "^#+", ""))
    color = lambda c: F.when(~T.is_blank(F.col(c)), F.concat(F.lit("#"), hex_of(c)))
    bad_color = lambda c: ~T.is_blank(F.col(c)) & ~hex_of(c).rlike("^[0-9A-F]{6}$")

    def handle(raw: Column) -> Column:
        trimmed = U.trim_ws(raw)
        last = F.element_at(F.split(F.regexp_replace(U.path_of(trimmed), "^/+|/+$", ""), "/"), -1)
        account = F.when(trimmed.rlike("(?i)^https?://"), last).otherwise(trimmed)
        return U.trim_ws(F.regexp_replace(account, "^@+", ""))

    entries = F.transform(
        F.map_entries(F.coalesce("social_handles", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(
            F.lower(U.trim_ws(e["key"])).alias("code"), handle(F.coalesce(e["value"], F.lit(""))).alias("handle")
        ),
    )
    codes = [p[0] for p in catalogue.PLATFORMS]
    given = F.filter("_handles", lambda e: e["handle"] != "")
    codes_given = F.transform(given, lambda e: e["code"])
    last_given = F.filter(
        given, lambda e, i: F.array_position(F.reverse(codes_given), e["code"]) == F.size(codes_given) - i
    )
    out = profiles.withColumns({"_phrases": phrases, "_bare": bare_tags, "_tags": tags, "_handles": entries})
    problems = [
        (T.is_blank(F.col("name")), "name is required"),
        (F.length(name) > MAX_NAME, "name is too long"),
        (F.length(text("target_audience")) > MAX_AUDIENCE, "target_audience is too long"),
        (F.length(text("extra_context")) > MAX_CONTEXT, "extra_context is too long"),
        (F.exists("_phrases", lambda p: F.length(p) > MAX_PHRASE_CHARS), "a banned phrase is too long"),
        (F.size("_phrases") > MAX_PHRASES, "too many banned phrases"),
        (F.exists("_bare", lambda t: F.length(t) > MAX_TAG_CHARS), "a hashtag is too long"),
        (F.size("_tags") > MAX_TAGS, "too many hashtags"),
        (bad_color("primary_color"), "primary_color is no #RRGGBB value"),
        (bad_color("secondary_color"), "secondary_color is no #RRGGBB value"),
        (F.exists("_handles", lambda e: ~e["code"].isin(codes)), "unknown platform in social_handles"),
        (F.exists(given, lambda e: (F.length(e["handle"]) > MAX_HANDLE) | ~e["handle"].rlike(r"^[A-Za-z0-9._-]+$")),
         "invalid account name in social_handles"),
    ]
    errors = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(note)) for bad, note in problems]), lambda e: e.isNotNull()
    )
    return out.withColumn("errors", errors).withColumns(
        {
            "name": name, "target_audience": text("target_audience"), "extra_context": text("extra_context"),
            "banned_phrases": F.col("_phrases"), "default_hashtags": F.col("_tags"),
            "primary_color": color("primary_color"), "secondary_color": color("secondary_color"),
            "social_handles": F.map_from_entries(last_given),
        }
    ).drop("_phrases", "_bare", "_tags", "_handles")


def set_defaults(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """Make the requested profiles the default of their scope and clear the others there.

    ``requests(brand_id, requested_at)``; the scope is (tenant, site or none) and
    the newest request of a scope wins.
    """
    asked = requests.join(profiles.select("brand_id", "tenant_id", "site_id"), "brand_id")
    winners = asked.groupBy(F.col("tenant_id").alias("_tenant"), F.col("site_id").alias("_site")).agg(
        F.max(F.struct("requested_at", "brand_id"))["brand_id"].alias("_default")
    )
    same = F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("site_id").eqNullSafe(F.col("_site"))
    chosen = F.when(F.col("_default").isNull(), F.col("is_default")).otherwise(F.col("brand_id") == F.col("_default"))
    return profiles.join(winners, same, "left").withColumn("is_default", chosen).select(*profiles.columns)


def resolve_brands(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``brand_id`` and ``brand_error`` to jobs with ``requested_brand``.

    "none" means no brand; an explicit id must belong to the tenant and, when
    it is bound to a site, to that site; otherwise the site's default beats the
    tenant's. Default lists hold one row per scope, so nothing multiplies.
    """
    explicit = profiles.select(
        F.col("brand_id").alias("requested_brand"), F.col("tenant_id").alias("_t"), F.col("site_id").alias("_s")
    )
    defaults = first_n(profiles.where("is_default"), ["tenant_id", "site_id"], [F.col("created_at").desc(), F.col("brand_id")], 1)
    of_site = defaults.where(F.col("site_id").isNotNull()).select("tenant_id", "site_id", F.col("brand_id").alias("_site_default"))
    of_tenant = defaults.where(F.col("site_id").isNull()).select("tenant_id", F.col("brand_id").alias("_tenant_default"))
    by_job = F.xxhash64("job_id") if "job_id" in jobs.columns else F.xxhash64(*jobs.columns[:4])
    joined = lookup(lookup(jobs.join(explicit, "requested_brand", "left"), of_site, ["tenant_id", "site_id"], by_job, "left"), of_tenant, ["tenant_id"], by_job, "left")
    asked = F.col("requested_brand")
    foreign = asked.isNotNull() & (asked != NO_BRAND) & ~F.coalesce(F.col("_t") == F.col("tenant_id"), F.lit(False))
    elsewhere = F.col("_s").isNotNull() & F.col("site_id").isNotNull() & (F.col("_s") != F.col("site_id"))
    error = F.when(foreign, F.lit("not found")).when(asked.isNotNull() & elsewhere, F.lit("belongs to another site"))
    return joined.withColumn("brand_error", error).withColumn(
        "brand_id",
        F.when(asked == NO_BRAND, F.lit(None)).when(F.col("brand_error").isNotNull(), F.lit(None)).when(asked.isNotNull(), asked)
        .otherwise(F.coalesce("_site_default", "_tenant_default")),
    ).drop("_t", "_s", "_site_default", "_tenant_default")


def brand_order() -> list[Column]:
    return [F.col("is_default").desc(), F.col("created_at").desc(), F.col("brand_id")]


def list_brands(profiles: DataFrame, tenant_id: str, site_id: str | None = None) -> DataFrame:
    """Profiles of a tenant; with a site also the tenant-wide ones. Defaults first, newest first."""
    mine = profiles.where(F.col("tenant_id") == tenant_id)
    if site_id is not None:
        mine = mine.where(F.col("site_id").isNull() | (F.col("site_id") == site_id))
    return mine.orderBy(*brand_order())
