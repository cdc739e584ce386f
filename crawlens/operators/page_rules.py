"""Page rules: each is a predicate and a message over one page row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.functions import text as T
from crawlens.functions import url as U

MIN_TITLE, MAX_TITLE, MAX_DESCRIPTION = 30, 60, 160
MIN_WORDS = 300
MAX_IMAGE_BYTES = 200 * 1024
REQUIRED_OG = ["og:title", "og:description", "og:image"]

# Anchor texts that say nothing about their target.
GENERIC_ANCHORS = [
    "tikla", "tiklayin", "tiklayiniz", "buraya tikla", "buraya tiklayin", "buraya",
    "devam", "devami", "devamini oku", "daha fazla", "daha fazlasi", "detay", "detaylar",
    "oku", "incele", "goruntule", "link", "bu sayfa", "bu link",
    "click", "click here", "here", "read more", "more", "learn more", "this page", "this link",
]


@dataclass(frozen=True)
class Rule:
    """A page rule; add your own to the list given to ``page_findings``.

    ``message`` yields the finding text where the page violates the rule and
    null where it passes. It may be any Column, including a pandas UDF.
    """

    code: str
    category: str
    severity: str
    weight: int
    message: Callable[[], Column]


def _rule(code: str, message: Callable[[], Column]) -> Rule:
    known = next(r for r in catalogue.RULES if r[0] == code)
    return Rule(code, known[1], known[2], known[3], message)


def _c(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _trimmed_length(name: str) -> Column:
    return F.length(U.trim_ws(F.coalesce(F.col(name), F.lit(""))))


def _hierarchy() -> Column:
    pairs = F.transform("heading_levels", lambda level, i: F.struct(F.get(F.col("heading_levels"), i - 1).alias("a"), level.alias("b")))
    bad = F.get(F.filter(pairs, lambda p: (p["a"] > 0) & (p["b"] > p["a"] + 1)), F.lit(0))
    return F.when(
        bad.isNotNull(),
        _c("Başlık seviyesi atlanmış: h", bad["a"].cast("string"), " sonrası h", bad["b"].cast("string"), " geliyor."),
    )


def _generic_anchors() -> Column:
    hits = T.distinct_ci(
        F.filter(F.transform("internal_anchor_texts", T.fold_anchor), lambda a: F.lower(a).isin(GENERIC_ANCHORS))
    )
    return U.let(
        hits,
        lambda h: F.when(
            F.size(h) > 0,
            _c(F.size(h).cast("string"), " iç linkte açıklayıcı olmayan anchor metni var: ",
               F.array_join(F.slice(h, 1, 5), ", "), "."),
        ),
    )


def _large_images() -> Column:
    big = F.filter("image_sizes", lambda i: i["bytes"] > MAX_IMAGE_BYTES)
    return U.let(
        big,
        lambda b: F.when(
            F.size(b) > 0,
            _c(F.size(b).cast("string"), f" görsel {MAX_IMAGE_BYTES // 1024} KB'ı aşıyor (en büyüğü ",
               F.floor(F.array_max(F.transform(b, lambda i: i["bytes"])) / 1024).cast("string"), " KB)."),
        ),
    )


def _missing_og() -> Column:
    present = F.transform(F.coalesce("og_tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    missing = F.array_except(F.array(*[F.lit(t) for t in REQUIRED_OG]), present)
    return U.let(
        missing, lambda m: F.when(F.size(m) > 0, _c("Open Graph etiketleri eksik: ", F.array_join(m, ", "), "."))
    )


DEFAULT_RULES: list[Rule] = [
    _rule("BROKEN_PAGE_4XX", lambda: F.when(F.col("status_code").between(400, 499), _c("Sayfa ", _s("status_code"), " dönüyor."))),
    _rule("SERVER_ERROR_5XX", lambda: F.when(F.col("status_code") == 0, F.lit("Sayfa getirilemedi (bağlantı hatası / zaman aşımı)."))
          .when(F.col("status_code") >= 500, _c("Sayfa ", _s("status_code"), " dönüyor."))),
    _rule("REDIRECT_CHAIN", lambda: F.when(F.col("redirect_count") > 1, _c("Sayfaya ", _s("redirect_count"), " yönlendirme sonrası ulaşılıyor (en fazla 1 olmalı)."))),
    _rule("REDIRECT_TARGET_INVALID", lambda: _c("Yönlendirme HTTP olmayan bir hedefe gidiyor: ", F.col("invalid_redirect_target"))),
    _rule("ROBOTS_NOINDEX", lambda: F.when(F.lower("robots_meta").contains("noindex"), _c('robots direktifi noindex içeriyor: "', F.col("robots_meta"), '".'))),
    _rule("CANONICAL_MISSING", lambda: F.when(T.is_blank(F.col("canonical_url")), F.lit("rel=canonical link yok."))),
    _rule("CANONICAL_POINTS_ELSEWHERE", lambda: F.when(
        ~T.is_blank(F.col("canonical_url"))
        & (F.lower(U.trim_slash(F.col("canonical_url"))) != F.lower(U.trim_slash(F.col("url")))),
        _c("Canonical başka adresi gösteriyor: ", F.col("canonical_url"), "."))),
    _rule("META_TITLE_MISSING", lambda: F.when(T.is_blank(F.col("title")), F.lit("Sayfada <title> etiketi yok."))),
    _rule("META_TITLE_TOO_SHORT", lambda: F.when(_trimmed_length("title").between(1, MIN_TITLE - 1),
          _c("Title çok kısa (", _trimmed_length("title").cast("string"), f" krk). En az {MIN_TITLE} karakter olmalı."))),
    _rule("META_TITLE_TOO_LONG", lambda: F.when(_trimmed_length("title") > MAX_TITLE,
          _c("Title çok uzun (", _trimmed_length("title").cast("string"), f" krk). En fazla {MAX_TITLE} karakter olmalı."))),
    _rule("META_DESC_MISSING", lambda: F.when(T.is_blank(F.col("meta_description")), F.lit("Meta description yok."))),
    _rule("META_DESC_TOO_LONG", lambda: F.when(_trimmed_length("meta_description") > MAX_DESCRIPTION,
          _c("Meta description çok uzun (", _trimmed_length("meta_description").cast("string"), f" krk). En fazla {MAX_DESCRIPTION} karakter olmalı."))),
    _rule("H1_MISSING", lambda: F.when(F.size("h1") == 0, F.lit("Sayfada H1 yok."))),
    _rule("H1_MULTIPLE", lambda: F.when(F.size("h1") > 1, _c("Sayfada ", F.size("h1").cast("string"), " adet H1 var, tek olmali."))),
    _rule("THIN_CONTENT", lambda: F.when(F.col("word_count") < MIN_WORDS, _c("İçerik zayıf (", _s("word_count"), f" kelime, min {MIN_WORDS})."))),
    _rule("HEADING_HIERARCHY_BROKEN", _hierarchy),
    _rule("GENERIC_ANCHOR_TEXT", _generic_anchors),
    _rule("IMAGE_MISSING_ALT", lambda: F.when(F.col("images_no_alt") > 0, _c(_s("images_total"), " görselin ", _s("images_no_alt"), " tanesinde alt metni yok."))),
    _rule("IMAGE_TOO_LARGE", _large_images),
    _rule("SCHEMA_MISSING", lambda: F.when(F.size("schema_types") == 0, F.lit("Sayfada schema.org isaretlemesi bulunamadi."))),
    _rule("INVALID_STRUCTURED_DATA", lambda: F.when(F.col("invalid_schema_blocks") > 0,
          _c(_s("invalid_schema_blocks"), " JSON-LD bloğu geçersiz biçimde (bozuk JSON ya da tek script içinde birden fazla kök nesne)."))),
    _rule("OG_TAGS_MISSING", _missing_og),
    _rule("LANG_ATTR_MISSING", lambda: F.when(T.is_blank(F.col("lang")), F.lit("<html> etiketinde lang niteligi yok."))),
]


def rule_input(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Adds what the rules read besides page columns: anchors of internal links, image sizes.

    A page has a bounded number of links, so its anchors fit one array.
    """
    out = pages
    if "internal_anchor_texts" not in out.columns:
        if links is None:
            out = out.withColumn("internal_anchor_texts", F.array().cast("array<string>"))
        else:
            anchors = (
                links.where("is_internal and anchor_text is not null")
                .groupBy("crawl_id", F.col("from_page_id").alias("page_id"))
                .agg(F.array_sort(F.collect_list(F.struct("pos", "anchor_text"))).alias("a"))
                .select("crawl_id", "page_id", F.transform("a", lambda x: x["anchor_text"]).alias("internal_anchor_texts"))
            )
            out = out.join(anchors, ["crawl_id", "page_id"], "left").withColumn(
                "internal_anchor_texts", F.coalesce("internal_anchor_texts", F.array().cast("array<string>"))
            )
    if "image_sizes" not in out.columns:
        out = out.withColumn("image_sizes", F.array().cast("array<struct<url:string,bytes:bigint>>"))
    return out


def page_findings(pages: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """One row per violated rule.

    All rules are evaluated in one projection; nothing is shuffled. Rows that
    answered 2xx with something other than html are not evaluated, and pages
    that are not 2xx or redirect keep transport findings only.
    """
    ok = F.col("status_code").between(200, 299)
    content_counts = ok & F.col("redirect_to").isNull()
    checks = []
    for rule in rules:
        message = rule.message()
        if rule.code not in catalogue.TRANSPORT_CODES:
            message = F.when(content_counts, message)
        checks.append(
            F.struct(
                F.lit(rule.code).alias("rule_code"), F.lit(rule.category).alias("category"),
                F.lit(rule.severity).alias("severity"), F.lit(rule.weight).alias("weight"), message.alias("found"),
            )
        )
    evaluated = pages.where(~ok | F.col("is_html")).select(
        "crawl_id", "site_id", "page_id", "url", "fetch_seq",
        F.explode(F.filter(F.array(*checks), lambda c: c["found"].isNotNull())).alias("f"),
    )
    return evaluated.select("crawl_id", "site_id", "page_id", "url", "fetch_seq", "f.*")
