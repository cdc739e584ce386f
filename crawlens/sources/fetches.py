"""Fetched documents -> page facts (one Arrow stage, the rest Column expressions)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.scale import spread_lookup
from crawlens.sources import markup


@dataclass(frozen=True)
class Limits:
    """What a page may hold; None is no limit. Lengths that are stored beside a text are always those of the whole."""

    html_bytes: int | None = None
    text_chars: int | None = None
    field_chars: int | None = None
    url_chars: int | None = None
    images: int | None = None
    measured_images: int | None = None
    anchor_chars: int | None = None


NO_LIMITS = Limits()

FETCH_SCHEMA = (
    "crawl_id string, site_id string, base_url string, fetch_seq bigint, url string, final_url string, "
    "status_code int, content_type string, redirect_count int, invalid_redirect_target string, "
    "response_time_ms int, fetched_at timestamp, x_robots_tag string, html string, is_seed boolean, depth_hint int"
)

RAW_FIELDS = (
    "title string, description string, h1 array<string>, h2_count int, heading_levels array<int>, "
    "base_href string, canonical_href string, links array<struct<href:string,text:string,rel:string>>, "
    "robots string, og array<struct<k:string,v:string>>, schema_types array<string>, invalid_schema_blocks int, "
    "images_total int, images_no_alt int, images array<string>, lang string, main_text string"
)
_RAW_NAMES = [field.split()[0] for field in RAW_FIELDS.replace("<struct<k:string,v:string>>", "")
              .replace("<struct<href:string,text:string,rel:string>>", "").split(", ")]


def is_parsable_html(status: Column, content_type: Column) -> Column:
    """Only 2xx answers that declare html are parsed."""
    return status.between(200, 299) & F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def cap_body(html: Column, most: int | None, binary: bool = False) -> Column:
    """First ``most`` bytes of the document, all of it without a limit; shorter bodies are not touched.

    A character that the limit falls into goes as a whole.
    """
    if most is None:
        return html
    head = html if binary else F.encode(html, "utf-8")
    # Back from the limit to the first byte of a character (in UTF-8 the others are 80 to BF).
    inside = lambda n: F.hex(F.substring(head, n + 1, 1)).between("80", "BF")
    size = F.when(~inside(most), F.lit(most)).when(~inside(most - 1), F.lit(most - 1)).when(~inside(most - 2), F.lit(most - 2)).otherwise(F.lit(most - 3))
    cut = F.substring(head, F.lit(1), size)
    return F.when(F.octet_length(html) > most, cut if binary else F.decode(cut, "utf-8")).otherwise(html)


def closed_references(html: Column) -> Column:
    """Markup in which a character reference without its semicolon is plain text.

    HTML itself reads some without one (``&amp`` at the end of a title that was cut is an ampersand), and so does the
    default extractor; this is for sources whose own readers do not.
    """
    return F.regexp_replace(html, "&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def _clip(value: Column, most: int | None) -> Column:
    return value if most is None else F.substring(value, 1, most)


def scan_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Default extractor: adds the raw markup facts to each row, drops the document."""
    for batch in batches:
        sources = [
            markup.decode(body, ctype) if isinstance(body, (bytes, bytearray)) else (body or "")
            for body, ctype in zip(batch["html"], batch["content_type"])
        ]
        raw = [markup.scan(s) for s in sources]
        out = batch.drop(columns=["html"])
        for name in _RAW_NAMES:
            values = [r[name] for r in raw]
            if name == "og":
                values = [[{"k": k, "v": v} for k, v in pairs] for pairs in values]
            out[name] = pd.Series(values, index=out.index, dtype="object")
        yield out


def extract(
    fetches: DataFrame,
    extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = scan_documents,
    limits: Limits = NO_LIMITS,
) -> DataFrame:
    """Raw facts per fetch. ``extractor`` may be replaced by any function with the same columns.

    Nothing is shuffled. Documents that are not parsable go in as empty text.
    """
    parsable = is_parsable_html(F.col("status_code"), F.col("content_type"))
    binary = dict(fetches.dtypes)["html"] == "binary"
    body = cap_body(F.col("html"), limits.html_bytes, binary)
    ready = fetches.withColumn("html", F.when(parsable, body))
    kept = ", ".join(f"`{c}` {t}" for c, t in ready.dtypes if c != "html")
    return ready.mapInPandas(extractor, f"{kept}, {RAW_FIELDS}")


def page_facts(raw: DataFrame) -> DataFrame:
    """Typed page columns from raw facts (URLs resolved, texts normalised), links still nested."""
    document = F.coalesce(U.normalize_url(F.col("final_url")), F.col("url"))
    resolved = raw.withColumn("document_url", document).withColumn(
        "link_base", F.coalesce(U.normalize_url(F.col("base_href"), F.col("document_url")), F.col("document_url"))
    )
    valid_og = F.filter("og", lambda p: ~T.is_blank(p["k"]) & ~T.is_blank(p["v"]))
    og_pairs = F.transform(valid_og, lambda p: F.struct(U.trim_ws(p["k"]).alias("k"), U.trim_ws(p["v"]).alias("v")))
    first_og = U.let(
        F.struct(og_pairs.alias("p"), F.transform(og_pairs, lambda p: F.lower(p["k"])).alias("keys")),
        lambda s: F.filter(
            s["p"], lambda p, i: F.array_position(s["keys"], F.lower(p["k"])) == i + 1
        ),
    )
    robots_parts = F.filter(
        F.array(F.col("robots"), F.col("x_robots_tag")), lambda p: F.coalesce(~T.is_blank(p), F.lit(False))
    )
    robots = F.array_join(F.transform(robots_parts, U.trim_ws), ", ")
    images = F.array_distinct(
        F.filter(F.transform("images", lambda i: U.normalize_url(i, F.col("link_base"))), lambda i: i.isNotNull())
    )
    return resolved.withColumns(
        {
            "page_id": U.page_key(F.col("crawl_id"), F.col("url")),
            "url_hash": U.url_hash(F.col("url")),
            "redirect_to": F.when(F.col("redirect_count") > 0, F.col("final_url")),
            "canonical_url": U.normalize_url(F.col("canonical_href"), F.col("link_base")),
            "robots_meta": F.when(robots != "", robots),
            "og": F.map_from_entries(first_og),
            "image_urls": images,
            "word_count": T.word_count(F.col("main_text")),
            "content_hash": F.when(F.col("main_text") != "", F.sha2(F.col("main_text"), 256)),
        }
    )


def page_rows(facts: DataFrame, keep: Sequence[str] = (), limits: Limits = NO_LIMITS) -> DataFrame:
    """Stored page columns, within ``limits``; ``keep`` passes more columns on."""
    clip = lambda name, n=limits.field_chars: _clip(F.col(name), n)
    images = F.col("image_urls") if limits.url_chars is None else F.filter("image_urls", lambda u: F.length(u) <= limits.url_chars)
    return facts.select(
        "crawl_id", "site_id", "base_url", "page_id", "fetch_seq",
        clip("url", limits.url_chars).alias("url"), "url_hash",
        F.col("depth_hint").alias("depth"), "is_seed", "status_code",
        clip("content_type").alias("content_type"),
        clip("redirect_to", limits.url_chars).alias("redirect_to"), "redirect_count", "invalid_redirect_target",
        "response_time_ms", "fetched_at",
        clip("title").alias("title"), F.length("title").alias("title_length"),
        clip("description").alias("meta_description"), F.length("description").alias("meta_desc_length"),
        "h1", "h2_count", "heading_levels", "word_count",
        clip("canonical_url", limits.url_chars).alias("canonical_url"),
        clip("robots_meta").alias("robots_meta"),
        F.when(F.size("og") > 0, F.to_json("og")).alias("og_data"), F.map_keys("og").alias("og_tags"),
        "schema_types", "invalid_schema_blocks", "images_total", "images_no_alt",
        (images if limits.images is None else F.slice(images, 1, limits.images)).alias("image_urls"),
        F.col("image_urls").alias("all_image_urls"),
        "content_hash",
        F.when(F.col("main_text") != "", clip("main_text", limits.text_chars)).alias("main_text"),
        clip("lang").alias("lang"),
        is_parsable_html(F.col("status_code"), F.col("content_type")).alias("is_html"),
        *keep,
    )


def link_rows(facts: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """One row per distinct target of a page, first occurrence wins; redirecting pages have none.

    Repeats are removed inside the page's own array (sort, then compare with the
    neighbour), so nothing is shuffled.
    """
    targets = F.transform(
        "links",
        lambda l, i: F.struct(
            U.normalize_url(l["href"], F.col("link_base")).alias("to_url"),
            i.alias("pos"),
            F.when(~T.is_blank(l["text"]), _clip(T.collapse_ws(l["text"]), limits.anchor_chars)).alias("anchor_text"),
            F.lower(l["rel"]).contains("nofollow").alias("is_nofollow"),
        ),
    )
    fits = lambda url: F.lit(True) if limits.url_chars is None else F.length(url) <= limits.url_chars
    usable = F.filter(targets, lambda t: t["to_url"].isNotNull() & fits(t["to_url"]))
    firsts = U.let(
        F.array_sort(usable),
        lambda s: F.filter(s, lambda t, i: (i == 0) | (F.get(s, i - 1)["to_url"] != t["to_url"])),
    )
    rows = facts.where(F.col("redirect_to").isNull()).select(
        "crawl_id", "site_id", "base_url", "page_id", "fetch_seq", "url", "depth_hint", F.explode(firsts).alias("t")
    )
    return rows.select(
        "crawl_id", "site_id", F.col("page_id").alias("from_page_id"), F.col("url").alias("from_url"),
        F.col("fetch_seq").alias("from_seq"), F.col("depth_hint").alias("from_depth"), "t.pos", "t.to_url",
        U.url_hash(F.col("t.to_url")).alias("to_hash"), "t.anchor_text",
        F.coalesce(U.is_internal(F.col("t.to_url"), F.col("base_url")), F.lit(False)).alias("is_internal"),
        "t.is_nofollow", "base_url",
    )


def measured_images(pages: DataFrame, sizes: DataFrame, blocked: DataFrame | None = None, limits: Limits = NO_LIMITS) -> DataFrame:
    """``image_sizes`` per page: the allowed images with a known size, the first ones if limited.

    ``sizes(crawl_id, url, bytes)`` is shared by all pages of a crawl and
    ``blocked(crawl_id, url)`` lists images robots.txt forbids. The images of a page
    come back into the array that they came from, so no row outgrows its page. A
    logo is on every page of its crawl: such keys are split.
    """
    wanted = pages.select("crawl_id", "page_id", F.posexplode("all_image_urls").alias("pos", "url"))
    if blocked is not None:
        wanted = wanted.join(blocked.select("crawl_id", "url").distinct(), ["crawl_id", "url"], "left_anti")
    known = sizes.groupBy("crawl_id", "url").agg(F.max("bytes").alias("bytes"))
    per_page = (
        spread_lookup(wanted, known, ["crawl_id", "url"], F.col("page_id"))
        .groupBy("crawl_id", "page_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "url", "bytes"))).alias("m"))
    )
    if limits.measured_images is not None:
        per_page = per_page.withColumn("m", F.slice("m", 1, limits.measured_images))
    measured = F.transform(
        F.filter("m", lambda s: s["bytes"].isNotNull()),
        lambda s: F.struct(s["url"].alias("url"), s["bytes"].alias("bytes")),
    )
    empty = F.array().cast("array<struct<url:string,bytes:bigint>>")
    return pages.join(
        per_page.select("crawl_id", "page_id", measured.alias("image_sizes")), ["crawl_id", "page_id"], "left"
    ).withColumn("image_sizes", F.coalesce("image_sizes", empty))
