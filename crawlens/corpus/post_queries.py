"""Queries that pick pages, write posts, guard brands and handle content jobs; text and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.corpus import inputs, stage
from crawlens.corpus.oracle import sql
from crawlens.corpus.registry import query
from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.operators import brands, content, crawl_rules, headlines, posts, selection
from crawlens.plans.audit import audit_tables
from crawlens.scale import cut, shared_dir, spread
from crawlens.sources import sinks
from crawlens.streaming import jobs as streams

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_BREAKS = "'[ \\n\\r\\t.,;:!?()\"''\\-/]+'"


def _pages(spark, sf):
    return stage.graph(spark, sf)


def _tidy(x: str) -> str:
    return f"rtrim(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '.,;: …')"


def _sentence(x: str, n: int) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?\\n]'), lambda s: trim(s)), lambda s: length(s) >= {n})[1]"


def _headline(title: str = "title", description: str = "description", text: str = "main_text", h1: str = "h1[1]") -> str:
    return f"coalesce(nullif({_tidy(h1)}, ''), nullif({_tidy(f'string_split({title}, chr(124))[1]')}, ''), {_tidy(_sentence(description, 25))}, {_tidy(_sentence(text, 25))})"


def _clip(x: str, limit: int, cut: int) -> str:
    sub = f"substr({x}, 1, {cut})"
    last = f"(length({sub}) - strpos(reverse({sub}), ' '))"
    word = f"CASE WHEN strpos({sub}, ' ') > 0 AND {last} > {limit // 2} THEN substr({sub}, 1, {last}) ELSE {sub} END"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE rtrim({word}, ' ,.;:') || '…' END"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {_BREAKS}), lambda w: length(w) >= 4 AND regexp_full_match(w, '\\pL+') AND lower(w) NOT IN ({_STOP}))"


def _tr_lower(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


# --- selection -----------------------------------------------------------

_USABLE = """
SELECT *, list_has_any(schema_types, ['Article', 'BlogPosting']) OR og_article AS marked FROM graph
WHERE status_code = 200 AND redirect_to IS NULL AND (main_text <> '' OR coalesce(title, '') <> '') AND NOT no_index AND (idx = 0 OR idx % 8 <> 5)
"""
_KINDS = """
SELECT u.*, CASE WHEN t.trusted AND u.marked THEN 'article' WHEN idx = 0 THEN 'other' WHEN idx % 8 IN (0, 2, 7) THEN 'article' WHEN idx % 8 = 3 THEN 'listing' ELSE 'other' END AS kind
FROM usable u JOIN (SELECT crawl_id, count(*) < 4 OR count(*) FILTER (marked) <= count(*) * 0.5 AS trusted FROM usable GROUP BY 1) t ON t.crawl_id = u.crawl_id
"""
_USAGE = """
SELECT site_id, url_key, count(*) AS used FROM (
  SELECT site_id, job_id, lower(coalesce(page_url, input ->> '$.pageUrl')) AS url_key, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, job_id DESC) AS rn
  FROM jobs WHERE type = 'social_kit' AND status <> 'failed') x GROUP BY 1, 2
"""


@query("page_kind", sql("SELECT crawl_id, url, kind FROM kinds", usable=_USABLE, kinds=_KINDS))
def page_kind(spark, sf):
    usable = selection.usable_pages(_pages(spark, sf))
    return usable.join(selection.markup_trust(usable), "crawl_id").select("crawl_id", "url", selection.page_kind(F.col("trust_markup")).alias("kind"))


def _history(spark, sf):
    return selection.post_history(inputs.load(spark, sf, "jobs"), stage.post_variants(spark, sf))


@query("page_usage", sql("SELECT site_id, url_key, used FROM usage_", usage_=_USAGE))
def page_usage(spark, sf):
    return selection.page_usage(_history(spark, sf))


def _selected(spark, sf, n=None):
    return selection.select_pages(_pages(spark, sf), n, selection.page_usage(_history(spark, sf)))


_SELECTED = """
SELECT * FROM (SELECT k.*, coalesce(u.used, 0) AS used, row_number() OVER (PARTITION BY crawl_id ORDER BY coalesce(u.used, 0), CASE WHEN kind = 'article' THEN 0 ELSE 1 END,
  CASE WHEN length(main_text) >= 200 THEN 0 ELSE 1 END, CASE WHEN kind = 'listing' THEN 1 ELSE 0 END, CASE WHEN kind = 'article' THEN 0 ELSE depth END,
  CASE WHEN kind = 'article' THEN word_count ELSE inlink_count END DESC, word_count DESC, depth, url) AS place
FROM kinds k LEFT JOIN usage_ u ON u.site_id = k.site_id AND u.url_key = lower(k.url)) x
"""


@query("select_pages", sql("SELECT crawl_id, url, kind, used, place FROM selected WHERE place <= 12", usable=_USABLE, kinds=_KINDS, usage_=_USAGE, selected=_SELECTED))
def select_pages(spark, sf):
    return _selected(spark, sf, 12).select("crawl_id", "url", "kind", "used", "place")


_CODES = ["instagram", "x"]


@query(
    "post_jobs",
    sql("SELECT s.crawl_id, s.url, p.code AS platform_code, CAST(s.place - 1 + s.used + p.pos AS INT) AS post_index, p.max_hashtags, p.supports_links FROM selected s, (VALUES (0, 'instagram', 30, false), (1, 'x', 2, true)) p(pos, code, max_hashtags, supports_links)",
        usable=_USABLE, kinds=_KINDS, usage_=_USAGE, selected=_SELECTED),
)
def post_jobs(spark, sf):
    rows = posts.post_jobs(_selected(spark, sf), [" Instagram", "x", "X"])
    return rows.select("crawl_id", "url", "platform_code", "post_index", "max_hashtags", "supports_links")


_IMAGES = "SELECT DISTINCT crawl_id, url, unnest(list_concat(CASE WHEN og_image IS NULL THEN [] ELSE [og_image] END, image_urls)) AS image FROM graph"
_WIDE = """SELECT i.crawl_id, i.image FROM images i JOIN (SELECT crawl_id, count(*) AS n FROM graph GROUP BY 1) p ON p.crawl_id = i.crawl_id
GROUP BY i.crawl_id, i.image, p.n HAVING p.n >= 4 AND count(*) > p.n * 0.3"""


@query("site_wide_images", sql("SELECT crawl_id, image FROM wide", images=_IMAGES, wide=_WIDE))
def site_wide_images(spark, sf):
    return selection.site_wide_images(stage.page_rows(spark, sf))


@query(
    "image_candidates",
    sql("""SELECT g.crawl_id, g.url, coalesce(c.candidates, '') AS candidates FROM graph g LEFT JOIN (
      SELECT crawl_id, url, array_to_string(list_slice(list(image ORDER BY CASE WHEN contains(image, '/og-') THEN 0 ELSE 1 END, CASE WHEN contains(image, '/p-') THEN 0 ELSE 1 END), 1, 5), '|') AS candidates
      FROM images i WHERE NOT contains(image, 'logo') AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.crawl_id = i.crawl_id AND w.image = i.image) GROUP BY 1, 2) c
    ON c.crawl_id = g.crawl_id AND c.url = g.url""", images=_IMAGES, wide=_WIDE),
)
def image_candidates(spark, sf):
    pages = _pages(spark, sf)
    rows = selection.image_candidates(pages, selection.site_wide_images(pages))
    return rows.join(pages.select("crawl_id", "page_id", "url"), ["crawl_id", "page_id"]).select("crawl_id", "url", F.array_join("candidates", "|").alias("candidates"))


# --- headline, keywords, brief, caption ----------------------------------

_G = "SELECT crawl_id, url, h1, title, nullif(description, '') AS description, nullif(main_text, '') AS main_text, og_title, site_no, idx, contains(doc, 'OG metni') AS has_og_text FROM graph"


@query("headline", sql(f"SELECT crawl_id, url, {_headline()} AS headline FROM g", g=_G))
def headline(spark, sf):
    return _pages(spark, sf).select("crawl_id", "url", headlines.meaningful_headline().alias("headline"))


def _documents(spark, sf):
    """Documents as pages without markup: language is the crawl, the text is the page."""
    none = F.lit(None).cast("string")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("lang").alias("crawl_id"), F.col("doc_id").cast("string").alias("page_id"), "doc_id", F.col("source").alias("site_id"), "lang",
        F.concat(F.lit("https://docs.example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.array().cast("array<string>").alias("h1"), none.alias("title"), none.alias("meta_description"), none.alias("og_data"),
        F.col("text").alias("main_text"),
    )


_DOC_HEAD = _headline("NULL::VARCHAR", "NULL::VARCHAR", "text", "NULL::VARCHAR")


@query("document_headlines", f"SELECT doc_id, {_DOC_HEAD} AS headline FROM documents")
def document_headlines(spark, sf):
    return _documents(spark, sf).select("doc_id", headlines.meaningful_headline().alias("headline"))


def _keyword_sql(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, array_to_string(list(word ORDER BY rn), '|') AS keywords FROM (
      SELECT {key}, word, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, word) AS rn
      FROM (SELECT {key}, unnest({_words(f'lower({text})')}) AS word FROM {source}) w GROUP BY {key}, word) x WHERE rn <= 4 GROUP BY {key}"""


@query("keywords", f"SELECT d.doc_id, coalesce(k.keywords, '') AS keywords FROM documents d LEFT JOIN ({_keyword_sql('documents', 'doc_id', 'text')}) k ON k.doc_id = d.doc_id")
def keywords(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(headlines.page_keywords(), "|").alias("keywords"))


_HEADING = f"coalesce({_headline()}, og_title)"
_CONTEXT = f"coalesce(trim(description), CASE WHEN has_og_text THEN 'OG metni' END, {_sentence('main_text', 21)})"
_SUBJECT = f"""CASE WHEN head IS NULL AND ctx IS NULL THEN '{headlines.FALLBACK_SUBJECT}' WHEN head IS NULL THEN rtrim(substr(ctx, 1, 180)) WHEN ctx IS NULL THEN rtrim(substr(head, 1, 180))
  WHEN length(rtrim(head, '.!? …') || '. ' || rtrim(ctx, '.!? …')) <= 180 THEN rtrim(head, '.!? …') || '. ' || rtrim(ctx, '.!? …')
  ELSE rtrim(substr(rtrim(head, '.!? …') || '. ' || rtrim(ctx, '.!? …'), 1, 180)) END"""


@query(
    "image_briefs",
    sql(f"""SELECT b.crawl_id, b.url, {_SUBJECT} || CASE WHEN k.keywords IS NULL THEN '' ELSE '. Konu: ' || replace(k.keywords, '|', ', ') END || '. {headlines.STYLE}' AS image_brief,
    coalesce(head || ' konusunu temsil eden görsel', 'Gönderiye eşlik eden temsili görsel') AS image_alt
    FROM (SELECT crawl_id || ' ' || url AS k, crawl_id, url, {_HEADING} AS head, {_CONTEXT} AS ctx FROM g) b LEFT JOIN kw k ON k.k = b.k""",
        g=_G, kw=_keyword_sql("(SELECT crawl_id || ' ' || url AS k, main_text FROM g) gg", "k", "main_text")),
)
def image_briefs(spark, sf):
    return headlines.image_briefs(_pages(spark, sf)).select("crawl_id", "url", "image_brief", "image_alt")


@query(
    "captions",
    sql(f"""SELECT crawl_id, url, {_clip('head', 60, 60)} AS caption_headline, CASE WHEN head IS NOT NULL THEN CASE WHEN site_no % 2 = 0 THEN 'Marka ' || site_no ELSE 'site' || site_no || '.example.com' END END AS caption_brand,
    CASE WHEN length({_tidy('description')}) >= 20 AND NOT starts_with(lower({_tidy('description')}), lower(rtrim({_clip('head', 60, 60)}, '…'))) THEN {_clip(_tidy('description'), 140, 140)} END AS caption_subline
    FROM (SELECT *, coalesce({_headline()}, 'Govde satiri') AS head FROM g) h""", g=_G),
)
def captions(spark, sf):
    rows = _pages(spark, sf).withColumns(
        {
            "body": F.lit("\n Govde satiri.\nikinci"), "description": F.lit(None).cast("string"),
            "brand_name": F.when(F.expr("CAST(substr(site_id, 2) AS INT) % 2 = 0"), F.concat(F.lit(" Marka  "), F.expr("substr(site_id, 2)"), F.lit("."))),
        }
    )
    return headlines.captions(rows).select("crawl_id", "url", "caption_headline", "caption_brand", "caption_subline")


@query(
    "template_choice",
    sql("""SELECT crawl_id, url, CASE WHEN len(pool) = 0 THEN CASE WHEN photo THEN 'overlay' ELSE 'poster' END ELSE pool[CAST(idx % len(pool) AS INT) + 1] END AS template, aspect FROM (
      SELECT *, CASE WHEN photo OR len(list_intersect(usable, ['poster', 'quote'])) = 0 THEN list_filter(usable, lambda t: t IN ('overlay', 'split', 'framed', 'label')) ELSE list_filter(usable, lambda t: t IN ('poster', 'quote')) END AS pool FROM (
        SELECT *, list_filter(CASE WHEN len(allowed) = 0 THEN ['overlay', 'split', 'framed', 'label', 'poster', 'quote'] ELSE allowed END, lambda t: t <> 'quote' OR subline) AS usable FROM (
          SELECT crawl_id, url, idx, idx % 3 = 0 AS photo, idx % 2 = 0 AS subline, CASE idx % 4 WHEN 0 THEN [] WHEN 1 THEN ['quote'] WHEN 2 THEN ['framed', 'poster'] ELSE ['split', 'label', 'quote'] END AS allowed,
            CASE idx % 3 WHEN 0 THEN '1:1' WHEN 1 THEN '16:9' ELSE '1:1' END AS aspect FROM facts) a) b) c"""),
)
def template_choice(spark, sf):
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    idx = F.col("idx")
    allowed = F.when(idx % 4 == 0, strings()).when(idx % 4 == 1, strings("quote")).when(idx % 4 == 2, strings("framed", "poster")).otherwise(strings("split", "label", "quote"))
    platform = F.when(idx % 3 == 0, F.lit("instagram")).when(idx % 3 == 1, F.lit("X")).otherwise(F.lit("other"))
    return stage.page_rows(spark, sf).select(
        "crawl_id", "url", headlines.image_template(allowed, idx % 3 == 0, idx % 2 == 0, idx).alias("template"), catalogue.aspect_ratio(platform).alias("aspect")
    )


# --- hashtags, guard, posts ----------------------------------------------

def _doc_posts(spark, sf):
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    n = F.col("doc_id")
    code = F.when(n % 4 == 0, F.lit("instagram")).when(n % 4 == 1, F.lit("facebook")).when(n % 4 == 2, F.lit("x")).otherwise(F.lit("linkedin"))
    return posts.page_parts(_documents(spark, sf)).withColumns(
        {
            "platform_code": code, "default_hashtags": F.when(n % 2 == 0, strings("#Marka", " iyi fikir ")).otherwise(strings()),
            "banned_phrases": F.when(F.col("lang") == "en", strings("the")).otherwise(strings()),
        }
    ).withColumns({"max_hashtags": catalogue.platform_attribute(F.col("platform_code"), "max_hashtags"), "job_id": F.col("page_id")})


_TAG = f"regexp_replace(translate({_tr_lower('word')}, 'çğıöşüâ', 'cgiosua'), '[^a-z0-9]', '', 'g')"


@query(
    "hashtags",
    f"""WITH base AS (SELECT doc_id, lang, text, coalesce({_clip('head', 400, 399)}, 'https://docs.example.com/' || lang || '/' || doc_id) AS heading,
      CASE doc_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 5 END AS lim FROM (SELECT doc_id, lang, text, {_DOC_HEAD} AS head FROM documents) d),
    hw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_words('heading')} AS w FROM base) x),
    tw AS (SELECT doc_id, arg_min(word, pos) AS word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_words('text')} AS w FROM base) x) y GROUP BY doc_id, lower(word)),
    every AS (
      SELECT doc_id, 0 AS tier, 0 AS o1, '' AS o2, '#Marka' AS tag FROM base WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, 1, '', '#iyifikir' FROM base WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 1, pos, '', '#' || {_TAG} FROM hw WHERE length({_TAG}) >= 4
      UNION ALL SELECT doc_id, 2, -n, word, '#' || {_TAG} FROM tw WHERE length({_TAG}) >= 4),
    once AS (SELECT e.doc_id, b.lim, arg_min(tag, (tier, o1, o2)) AS tag, min((tier, o1, o2)) AS o FROM every e JOIN base b ON b.doc_id = e.doc_id
      WHERE NOT (b.lang = 'en' AND contains({_tr_lower('tag')}, 'the')) GROUP BY e.doc_id, b.lim, lower(tag))
    SELECT b.doc_id, coalesce(t.hashtags, '') AS hashtags FROM base b LEFT JOIN (SELECT doc_id, array_to_string(list_slice(list(tag ORDER BY o), 1, lim), ' ') AS hashtags FROM once GROUP BY doc_id, lim) t ON t.doc_id = b.doc_id""",
)
def hashtags(spark, sf):
    return posts.with_hashtags(_doc_posts(spark, sf)).select("doc_id", F.array_join("hashtags", " ").alias("hashtags"))


_PASSES = f"""CASE WHEN lang = 'fr' THEN NOT (contains({_tr_lower("regexp_replace(body, '\\s+', ' ', 'g')")}, 'eau mentle') OR contains({_tr_lower("regexp_replace(body, '\\s+', ' ', 'g')")}, 'de la')) ELSE true END"""


@query(
    "brand_guard",
    f"""SELECT doc_id, sha256(body) AS body_hash, length(body) AS char_count, cta, {_PASSES} AS passes, CASE WHEN lang = 'fr' THEN '#xyz' ELSE '#xyz #DElaX' END AS hashtags FROM (
      SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN trim(array_to_string(list_transform(string_split(text || ' son', chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'))), chr(10)), chr(10) || ' ')
        ELSE '🎉 ' || text || '  ⭐ son' END AS body, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE '👉' END AS cta FROM documents) x""",
)
def brand_guard(spark, sf):
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    rows = _documents(spark, sf).select(
        "doc_id", F.concat(F.lit("🎉 "), "main_text", F.lit("  ⭐ son")).alias("body"), F.lit("👉").alias("cta"), F.lit(None).cast("string").alias("description"),
        strings("#xyz", "#DElaX").alias("hashtags"), F.lit("b").alias("brand_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("none")).otherwise(F.lit("light")).alias("emoji_usage"),
        F.when(F.col("lang") == "fr", strings(" EAU  mentle", "de la", "  ")).otherwise(strings()).alias("banned_phrases"),
    )
    return brands.guard(rows).select("doc_id", F.sha2("body", 256).alias("body_hash"), "char_count", "cta", "passes", F.array_join("hashtags", " ").alias("hashtags"))


def _branded_jobs(spark, sf):
    jobs = posts.post_jobs(posts.page_parts(_selected(spark, sf)), _CODES)
    sites = inputs.load(spark, sf, "sites").select("site_id", "tenant_id")
    resolved = brands.resolve_brands(jobs.join(sites, "site_id").withColumn("requested_brand", F.lit(None).cast("string")), stage.brands(spark, sf))
    return posts.with_brand(resolved, stage.brands(spark, sf))


_POST_COLUMNS = ["crawl_id", "url", "platform_code", "post_index", "angle", "body", "cta", "char_count", "description"]


@query("social_posts")
def social_posts(spark, sf):
    """Template posts of all usable pages; checked against a plain implementation in the tests."""
    return posts.template_posts(_branded_jobs(spark, sf)).select(*_POST_COLUMNS)


@query("unique_posts")
def unique_posts(spark, sf):
    known = selection.known_bodies(_history(spark, sf))
    # Posts without hashtags: the jobs are written without what only those and other queries read of a page.
    jobs = _branded_jobs(spark, sf).drop("p_tag_words", "main_text", "image_urls", "all_image_urls", "image_sizes", "og_data")
    return posts.unique_posts(jobs, known).select(*_POST_COLUMNS, "attempt", "repeated")


@query("prompts")
def prompts(spark, sf):
    """Prompt texts for offline inference: job, page, platform, brand and earlier posts."""
    jobs = inputs.load(spark, sf, "jobs").withColumn("url_key", F.lower("page_url"))
    resolved = brands.resolve_brands(jobs, stage.brands(spark, sf))
    profiles = stage.brands(spark, sf).select("brand_id", F.col("name").alias("brand_name"), "tone", "address_form", "emoji_usage", "banned_phrases",
                                              "default_hashtags", "social_handles", "target_audience", "extra_context")
    usable = selection.usable_pages(_pages(spark, sf))
    # A page's newest crawl speaks for it; markup counts where its crawl's pages differ in it.
    pages = (
        usable.join(selection.markup_trust(usable), "crawl_id").withColumn("kind", selection.page_kind(F.col("trust_markup"))).withColumn("url_key", F.lower("url"))
        .groupBy("site_id", "url_key").agg(F.max_by(F.struct("url", "title", "meta_description", "h1", "main_text", "kind"), F.struct("crawl_no", "url")).alias("p"))
        .select("site_id", "url_key", "p.*")
    )
    rows = (
        resolved.join(profiles, "brand_id", "left")
        .join(F.broadcast(catalogue.platforms(spark)), "platform_code", "left")
        .join(pages, ["site_id", "url_key"], "left")
        .join(content.previous_posts(_history(spark, sf)), ["site_id", "url_key"], "left")
    )
    return content.prompts(rows).select("job_id", "system_text", "user_text")


# --- brands --------------------------------------------------------------

@query(
    "brand_default",
    sql("""SELECT j.job_id, CASE WHEN requested_brand = 'none' THEN NULL WHEN requested_brand IS NOT NULL THEN CASE WHEN requested_brand = 'b-' || j.site_id THEN requested_brand END
      WHEN d.site_id IS NOT NULL THEN 'b-' || j.site_id ELSE 'b-' || j.tenant_id END AS brand_id,
    CASE WHEN requested_brand IS NULL OR requested_brand = 'none' OR requested_brand = 'b-' || j.site_id THEN NULL ELSE 'not found' END AS brand_error
    FROM jobs j LEFT JOIN (SELECT site_id FROM brands0 WHERE is_default AND site_id IS NOT NULL) d ON d.site_id = j.site_id"""),
)
def brand_default(spark, sf):
    rows = brands.resolve_brands(inputs.load(spark, sf, "jobs"), inputs.load(spark, sf, "brands0"))
    return rows.select("job_id", "brand_id", "brand_error")


@query(
    "brand_set_default",
    sql("""SELECT brand_id, site_id, CASE WHEN site_id IS NULL THEN is_default ELSE true END AS is_default FROM brands0"""),
)
def brand_set_default(spark, sf):
    """Every site asks for its own profile to be the default; tenant-wide profiles are another scope."""
    profiles = inputs.load(spark, sf, "brands0")
    asked = profiles.where(F.col("site_id").isNotNull()).select("brand_id", F.col("created_at").alias("requested_at"))
    return brands.set_defaults(profiles, asked).select("brand_id", "site_id", "is_default")


@query(
    "brand_list",
    sql("SELECT brand_id, is_default, row_number() OVER (ORDER BY is_default DESC, created_at DESC, brand_id) AS place FROM brands0 WHERE tenant_id = 't0' AND (site_id IS NULL OR site_id = 's0')"),
)
def brand_list(spark, sf):
    # The list of one tenant and site is a handful of profiles.
    from pyspark.sql import Window

    rows = brands.list_brands(inputs.load(spark, sf, "brands0"), "t0", "s0")
    return rows.select("brand_id", "is_default", F.row_number().over(Window.partitionBy("tenant_id").orderBy(*brands.brand_order())).alias("place"))


_RAW_PROFILES = """
SELECT doc_id, source, n_chars, lang, CASE WHEN doc_id % 7 = 3 THEN '  ' ELSE ' ' || source || ' ' END AS name, text AS audience FROM documents
"""


@query(
    "brand_validate",
    f"""SELECT doc_id, trim(name) AS name, array_to_string(list_filter([
      CASE WHEN trim(name) = '' THEN 'name is required' END,
      CASE WHEN length(trim(audience, chr(10) || ' ')) > 1024 THEN 'target_audience is too long' END,
      CASE WHEN doc_id % 3 = 1 THEN 'primary_color is no #RRGGBB value' END,
      CASE WHEN lang = 'de' THEN 'unknown platform in social_handles' END,
      CASE WHEN lang = 'es' THEN 'invalid account name in social_handles' END], lambda e: e IS NOT NULL), '|') AS errors,
    CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 3 = 1 THEN '#RED' ELSE '#12AB9F' END AS primary_color, 'Bir ifade' AS banned_phrases, '#' || source || ' #İyi_fikir' AS default_hashtags,
    CASE lang WHEN 'de' THEN 'acct' WHEN 'es' THEN 'a b' WHEN 'fr' THEN 'page_1' ELSE 'me.x' END AS handle FROM ({_RAW_PROFILES}) p""",
)
def brand_validate(spark, sf):
    strings = lambda *v: F.array(*[F.lit(x) if isinstance(x, str) else x for x in v]).cast("array<string>")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang, n = F.col("lang"), F.col("doc_id")
    handle = F.when(lang == "de", F.create_map(F.lit("myspace"), F.lit("acct"))).when(lang == "es", F.create_map(F.lit(" X "), F.lit("a b"))).when(
        lang == "fr", F.create_map(F.lit("linkedin"), F.lit("https://www.linkedin.com/in/page_1/?x=1"))).otherwise(F.create_map(F.lit("Instagram"), F.lit(" @me.x ")))
    profiles = docs.select(
        "doc_id", F.when(n % 7 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("name"), F.col("text").alias("target_audience"),
        F.lit(None).cast("string").alias("extra_context"), strings(" Bir  ifade", "bir IFADE", " ").alias("banned_phrases"),
        strings(F.concat(F.lit("# "), "source"), "İyi_fikir!", F.concat(F.lit("#"), F.upper("source"))).alias("default_hashtags"),
        F.when(n % 3 == 2, F.lit(None)).when(n % 3 == 1, F.lit("red")).otherwise(F.lit(" #12ab9F")).alias("primary_color"), F.lit(None).cast("string").alias("secondary_color"),
        handle.alias("social_handles"),
    )
    rows = brands.validate_profiles(profiles)
    return rows.select("doc_id", "name", F.array_join("errors", "|").alias("errors"), "primary_color", F.array_join("banned_phrases", "|").alias("banned_phrases"),
                       F.array_join("default_hashtags", " ").alias("default_hashtags"), F.map_values("social_handles")[0].alias("handle"))


# --- content jobs --------------------------------------------------------

@query("job_list", sql("SELECT job_id, site_id, status, type FROM jobs WHERE tenant_id = 't1' AND type = 'social_kit' AND platform_code = 'x' AND status = 'done'"))
def job_list(spark, sf):
    rows = content.filter_jobs(inputs.load(spark, sf, "jobs"), "t1", type="social_kit", platform_code="x", status="done", site_id=None)
    return rows.select("job_id", "site_id", "status", "type")


@query(
    "ai_quota",
    sql("""SELECT tenant_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS used, greatest(0, 20 - count(*)) AS remaining FROM jobs
    WHERE type = 'social_kit' AND input ->> '$.imageSource' = 'ai' GROUP BY 1, 2"""),
)
def ai_quota(spark, sf):
    return content.ai_quota(inputs.load(spark, sf, "jobs"), 20).withColumn("day", F.col("day").cast("string"))


@query(
    "ai_quota_check",
    sql("""SELECT j.job_id, (1 + length(j.job_id) % 3) * (1 + length(coalesce(j.page_url, '')) % 6) AS wanted, greatest(0, 20 - coalesce(u.used, 0)) AS remaining,
      (1 + length(j.job_id) % 3) * (1 + length(coalesce(j.page_url, '')) % 6) <= greatest(0, 20 - coalesce(u.used, 0)) AS allowed
    FROM jobs j LEFT JOIN (SELECT tenant_id, CAST(created_at AS DATE) AS day, count(*) AS used FROM jobs WHERE type = 'social_kit' AND input ->> '$.imageSource' = 'ai' GROUP BY 1, 2) u
    ON u.tenant_id = j.tenant_id AND u.day = CAST(j.created_at AS DATE)"""),
)
def ai_quota_check(spark, sf):
    """Each job as a request for pictures: as many platforms and pages as its names' lengths say."""
    jobs = inputs.load(spark, sf, "jobs")
    asked = jobs.select(
        "job_id", "tenant_id", F.to_date("created_at").alias("day"), (1 + F.length("job_id") % 3).alias("n_platforms"),
        (1 + F.length(F.coalesce("page_url", F.lit(""))) % 6).alias("n_pages"),
    )
    return content.check_quota(asked, jobs, 20).select("job_id", "wanted", "remaining", "allowed")


@query(
    "asset_gallery",
    sql("SELECT asset_id, job_id, kind FROM assets a WHERE kind = 'captioned' OR NOT EXISTS (SELECT 1 FROM assets c WHERE c.source_asset_id = a.asset_id)"),
)
def asset_gallery(spark, sf):
    return content.display_assets(inputs.load(spark, sf, "assets")).select("asset_id", "job_id", "kind")


@query(
    "page_jobs",
    sql("""SELECT j.job_id, j.page_url, coalesce(v.n, 0) AS variants, coalesce(v.chars, 0) AS chars FROM jobs j LEFT JOIN (
    SELECT job_id, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS chars FROM variants GROUP BY 1) v ON v.job_id = j.job_id"""),
)
def page_jobs(spark, sf):
    rows = content.job_details(inputs.load(spark, sf, "jobs"), stage.post_variants(spark, sf), inputs.load(spark, sf, "assets"))
    variants = F.coalesce("variants", F.array().cast("array<struct<variant_index:int,angle:string,body:string,char_count:int,storage_key:string>>"))
    return rows.select("job_id", "page_url", F.size(variants).cast("bigint").alias("variants"),
                       F.aggregate(variants, F.lit(0).cast("bigint"), lambda a, v: a + v["char_count"]).alias("chars"))


@query(
    "batch_jobs",
    sql("""SELECT crawl_id || '/' || k AS request_id, page_id, CASE WHEN n > 50 THEN 'too many pages' END AS error FROM (
    SELECT DISTINCT crawl_id, k, page_id, count(DISTINCT page_id) OVER (PARTITION BY crawl_id, k) AS n FROM (
      SELECT crawl_id, idx // 60 AS k, sha256(crawl_id || '|' || url) AS page_id FROM facts) a) b"""),
)
def batch_jobs(spark, sf):
    """Each crawl asks for its pages sixty at a time, every page twice; requests over the limit are rejected."""
    pages = _pages(spark, sf).select("crawl_id", F.floor(F.col("idx") / 60).alias("k"), "page_id")
    requests = pages.unionByName(pages).groupBy(F.concat("crawl_id", F.lit("/"), F.col("k").cast("string")).alias("request_id")).agg(F.collect_list("page_id").alias("page_ids"))
    return content.batch_jobs(requests).select("request_id", "page_id", "error")


@query(
    "model_answers",
    sql("""SELECT response_id, CAST(i AS INT) AS variant_index, body, angle, cta, hashtags, image_brief, length(body) AS char_count FROM (
      SELECT response_id, 0 AS i, words AS body, NULL AS angle, NULL AS cta, '' AS hashtags, NULL AS image_brief FROM responses WHERE (conv_id + turn) % 7 IN (0, 3) AND FALSE
      UNION ALL SELECT response_id, 0, trim(response), NULL, NULL, '', NULL FROM responses WHERE (conv_id + turn) % 7 IN (0, 4)
      UNION ALL SELECT response_id, 0, words, 'a1', 'git', '#x', NULL FROM responses WHERE (conv_id + turn) % 7 = 1
      UNION ALL SELECT response_id, 1, 'iki', NULL, NULL, '', NULL FROM responses WHERE (conv_id + turn) % 7 = 1
      UNION ALL SELECT response_id, 0, words, NULL, NULL, '', NULL FROM responses WHERE (conv_id + turn) % 7 = 2
      UNION ALL SELECT response_id, 1, 'duz metin', NULL, NULL, '', NULL FROM responses WHERE (conv_id + turn) % 7 = 2
      UNION ALL SELECT response_id, 2, '#a #b', NULL, NULL, '#a #b', NULL FROM responses WHERE (conv_id + turn) % 7 = 2
      UNION ALL SELECT response_id, 0, words, NULL, NULL, '', 'sahne' FROM responses WHERE (conv_id + turn) % 7 = 3
      UNION ALL SELECT response_id, u - 1, CAST(u AS VARCHAR), NULL, NULL, '', NULL FROM responses, (SELECT unnest(range(1, 12)) AS u) n WHERE (conv_id + turn) % 7 = 5) x"""),
)
def model_answers(spark, sf):
    rows = content.answer_variants(inputs.load(spark, sf, "responses"))
    return rows.select("response_id", "variant_index", "body", "angle", "cta", F.array_join("hashtags", " ").alias("hashtags"), "image_brief", "char_count")


@query(
    "export_rows",
    sql("""SELECT j.job_id, j.type, j.platform_code, coalesce(j.page_url, '') AS page_url, j.status, strftime(j.created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS created_at,
    coalesce(CAST(v.variant_index AS VARCHAR), '') AS variant_index, coalesce(v.angle, '') AS angle, coalesce(v.body, '') AS body,
    CASE WHEN v.job_id IS NULL THEN '' ELSE '#' || v.lang || ' #' || v.source END AS hashtags, coalesce(v.cta, '') AS cta, coalesce(CAST(v.char_count AS VARCHAR), '') AS char_count,
    coalesce(CAST(v.is_favorite AS VARCHAR), '') AS is_favorite FROM jobs j LEFT JOIN variants v ON v.job_id = j.job_id"""),
)
def export_rows(spark, sf):
    return sinks.export_rows(inputs.load(spark, sf, "jobs"), stage.post_variants(spark, sf))


# --- text functions ------------------------------------------------------

@query(
    "text_functions",
    f"""SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS body_key,
    sha256(trim(regexp_replace(strip_accents(replace(lower(trim(text, chr(10) || ' ')), 'ı', 'i')), '[^\\pL\\p{{Nd}} ]', '', 'g'))) AS folded,
    translate({_tr_lower("source")}, 'çğıöşüâîû', 'cgiosuaiu') AS headline_key, {_clip("trim(regexp_replace(text, '\\s+', ' ', 'g'))", 140, 139)} AS clipped_post,
    {_clip("trim(regexp_replace(text, '\\s+', ' ', 'g'))", 60, 60)} AS clipped_caption, {_sentence('text', 25)} AS sentence,
    CASE lang WHEN 'en' THEN 'satis_odakli' WHEN 'de' THEN 'samimi' WHEN 'fr' THEN NULL ELSE 'teknik' END AS tone, 'structured_data' AS category FROM documents""",
)
def text_functions(spark, sf):
    x, squeezed = F.col("text"), T.collapse_ws(F.col("text"))
    raw = F.when(F.col("lang") == "en", F.lit("Satis-Odakli")).when(F.col("lang") == "de", F.lit("SAMIMI")).when(F.col("lang") == "fr", F.lit(" ")).otherwise(F.lit("teknik"))
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.sha2(squeezed, 256).alias("collapsed"), F.sha2(T.body_key(x), 256).alias("body_key"), F.sha2(T.fold_anchor(x), 256).alias("folded"),
        T.fold_headline(F.col("source")).alias("headline_key"), T.clip_post(squeezed, 140).alias("clipped_post"), T.clip_caption(squeezed, 60).alias("clipped_caption"),
        T.first_sentence(x, 25).alias("sentence"), T.parse_enum(raw, ["kurumsal", "samimi", "teknik", "satis_odakli"]).alias("tone"), T.snake_case(F.lit("StructuredData")).alias("category"),
    )


@query(
    "indexable_pages",
    sql("""SELECT crawl_id, url, lower(rtrim(url, '/')) = lower(rtrim(canonical_url, '/')) AS is_canonical, indexable FROM graph"""),
)
def indexable_pages(spark, sf):
    return _pages(spark, sf).select(
        "crawl_id", "url", (F.lower(U.trim_slash(F.col("url"))) == F.lower(U.trim_slash(F.col("canonical_url")))).alias("is_canonical"),
        crawl_rules.is_indexable().alias("indexable"),
    )


# --- streaming -----------------------------------------------------------

def _arrived(spark, sf):
    """The fetches as a stream of many small files in no order, some URLs twice, over several triggers."""
    root = f"{shared_dir(spark)}/crawlens/stream-{uuid.uuid4().hex}"
    rows = inputs.load(spark, sf, "fetches").select(*[f.split()[0] for f in streams.FS.FETCH_SCHEMA.split(", ")])
    rows.unionByName(rows.where("is_seed")).repartition(6, F.xxhash64("url", "crawl_id")).write.parquet(f"{root}/in")
    return root, streams.unique_fetches(streams.read_fetches(spark, f"{root}/in", files_per_trigger=2))


def _sizes(spark, sf):
    """Written once: every micro-batch looks them up."""
    return stage.once(spark, sf, "sizes", lambda: cut(stage.image_sizes(stage.page_rows(spark, sf)), "sizes"))


@query("streaming_audit", sql("SELECT crawl_id, url, rule_code, found FROM page_findings"))
def streaming_audit(spark, sf):
    """Findings are written per micro-batch and read back; images are measured as their pages arrive."""
    root, arriving = _arrived(spark, sf)
    sizes = _sizes(spark, sf)
    streams.persist_batches(arriving, f"{root}/out", f"{root}/checkpoint", made=lambda batch: streams.stream_findings(batch, image_sizes=sizes)).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("crawl_id", "url", "rule_code", "found")


@query("streaming_crawl_end", sql("SELECT crawl_id, rule_code, severity, url, found, array_to_string(samples, '|') AS samples FROM issues"))
def streaming_crawl_end(spark, sf):
    """Documents arrive in no order, some twice, then the ends of their crawls: each crawl is audited whole when it ends."""
    root = f"{shared_dir(spark)}/crawlens/stream-{uuid.uuid4().hex}"
    columns = [f.split()[0] for f in streams.FS.FETCH_SCHEMA.split(", ")]
    rows = inputs.load(spark, sf, "fetches").select(*columns, F.lit(None).cast("string").alias("event"))
    rows.unionByName(rows.where("is_seed")).repartition(6, F.xxhash64("url", "crawl_id")).write.parquet(f"{root}/in")
    crawls = inputs.load(spark, sf, "crawls0")
    kinds = dict(rows.dtypes)
    blank = {"bigint": F.lit(0).cast("bigint"), "int": F.lit(0), "boolean": F.lit(False)}
    ends = crawls.select(*[F.col(c) if c in ("crawl_id", "site_id", "base_url") else F.lit(streams.END).alias(c) if c == "event"
                           else blank.get(kinds[c], F.lit(None).cast(kinds[c])).alias(c) for c in rows.columns])
    ends.coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run(ended, facts):
        pages = streams.FS.page_rows(facts).withColumn("is_asset", F.lit(False))
        pages = cut(streams.FS.measured_images(pages, stage.image_sizes(pages)), "pages")
        own = crawls.join(ended, "crawl_id", "left_semi")
        found = audit_tables(pages, cut(streams.FS.link_rows(facts), "links"), own, inputs.load(spark, sf, "robots"), stage.sitemaps(spark, sf), stage.crawl_vitals(spark, sf), most_blocked=stage.MOST_BLOCKED)
        return found.issues.join(found.pages.select("crawl_id", "page_id", "url"), ["crawl_id", "page_id"])

    events = streams.read_fetches(spark, f"{root}/in", streams.EVENT_SCHEMA, files_per_trigger=3)
    streams.audit_on_end(events, f"{root}/out", f"{root}/checkpoint", run, parts=4).awaitTermination()
    return spark.read.parquet(f"{root}/out/audited").select(
        "crawl_id", "rule_code", "severity", "url", F.col("evidence.found").alias("found"), F.array_join("evidence.sample_urls", "|").alias("samples")
    )


def _counted(spark, sf, made, running):
    """What a second stream counts over the rows that a first one writes.

    Its files are as many as the first one's shuffle has partitions, for each of its micro-batches; a micro-batch here
    takes a quarter of them, as each one opens the state of all partitions, however few its rows are.
    """
    root, arriving = _arrived(spark, sf)
    streams.persist_batches(arriving, f"{root}/rows", f"{root}/checkpoint", made=made).awaitTermination()
    written = spark.read.parquet(f"{root}/rows")
    quarter = max(4, -(-len(written.inputFiles()) // 4))
    rows = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", quarter).parquet(f"{root}/rows")
    streams.persist_batches(running(rows), f"{root}/counts", f"{root}/checkpoint-counts", mode="update").awaitTermination()
    return spark.read.parquet(f"{root}/counts")


@query("streaming_progress", sql("SELECT crawl_id, count(*) AS pages_crawled FROM facts GROUP BY 1"))
def streaming_progress(spark, sf):
    """The last of the running page counts of each crawl."""
    return streams.latest(_counted(spark, sf, lambda a: streams.stream_pages(a).select("crawl_id", "page_id"), streams.progress), ["crawl_id"])


@query("streaming_issue_counts", sql("""SELECT f.crawl_id, r.severity, count(*) AS issues FROM page_findings f JOIN rules r ON r.rule_code = f.rule_code
GROUP BY 1, 2"""))
def streaming_issue_counts(spark, sf):
    """The last of the running issue counts of each crawl and severity."""
    found = lambda batch: streams.stream_findings(batch, image_sizes=_sizes(spark, sf)).select("crawl_id", "rule_code", "severity")
    return streams.latest(_counted(spark, sf, found, streams.running_issue_counts), ["crawl_id", "severity"])
