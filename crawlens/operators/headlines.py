"""Headline, keywords, image brief, caption and image template of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.functions import text as T
from crawlens.functions import url as U
from crawlens.functions import words
from crawlens.operators.selection import og_value

MAX_SUBJECT, KEYWORDS = 180, 4
MAX_HEADLINE, MAX_BRAND_LINE, MIN_SUBLINE, MAX_SUBLINE = 60, 40, 20, 140

# Headings that only name a place in the navigation.
NAVIGATIONAL = [
    "hakkimizda", "hakkinda", "biz kimiz", "kurumsal", "sirketimiz",
    "anasayfa", "ana sayfa", "baslangic", "giris",
    "iletisim", "bize ulasin", "iletisim bilgileri",
    "urunler", "urun", "hizmetler", "hizmetlerimiz", "cozumler", "cozumlerimiz",
    "blog", "haberler", "duyurular", "basin", "basinda biz", "makaleler", "yazilar",
    "galeri", "foto galeri", "video galeri", "referanslar", "musterilerimiz",
    "sss", "s.s.s", "sikca sorulan sorular", "yardim", "destek",
    "misyon", "vizyon", "misyon ve vizyon", "degerlerimiz", "tarihce",
    "kariyer", "insan kaynaklari", "bayilik", "bayiler", "katalog", "kataloglar",
    "sertifikalar", "belgelerimiz", "kalite", "politikalarimiz",
    "home", "about", "about us", "contact", "contact us", "products", "services",
    "news", "gallery", "references", "faq", "support", "careers",
]
STYLE = (
    "professional commercial photography, natural lighting, shallow depth of field, "
    "clean composition, high detail, no text, no letters, no watermark, no logo"
)
FALLBACK_SUBJECT = "a modern workspace representing an online business"

PHOTO_TEMPLATES = ["overlay", "split", "framed", "label"]
CARD_TEMPLATES = ["poster", "quote"]


def is_navigational(x: Column) -> Column:
    return T.fold_headline(T.rtrim_chars(T.tidy(x), "!?.")).isin(NAVIGATIONAL)


def meaningful_headline() -> Column:
    """First candidate that says something: headings, title part, description, text."""
    title_part = F.when(F.length("title") > 0, F.split_part(F.regexp_replace("title", "[—–]", "|"), F.lit("|"), F.lit(1)))
    candidates = F.concat(
        F.coalesce(F.col("h1"), F.array().cast("array<string>")),
        F.array(title_part, T.first_sentence(F.col("meta_description"), 25), T.first_sentence(F.col("main_text"), 25)),
    )
    tidied = F.filter(F.transform(candidates, T.tidy), lambda c: c.isNotNull() & (c != "") & ~is_navigational(c))
    return F.get(tidied, F.lit(0))


def heading() -> Column:
    og = U.trim_ws(og_value("og:title"))
    return F.coalesce(meaningful_headline(), F.when((og != "") & ~is_navigational(og), og))


def context() -> Column:
    og = U.trim_ws(og_value("og:description"))
    return F.coalesce(
        F.when(F.length("meta_description") > 0, U.trim_ws(F.col("meta_description"))),
        F.when(og != "", og),
        T.first_sentence(F.col("main_text"), 21),
    )


def page_keywords(most: int = KEYWORDS) -> Column:
    """The most frequent words of the whole ``main_text``."""
    return words.keywords(F.col("main_text"), most)


def image_briefs(pages: DataFrame) -> DataFrame:
    """Adds ``keywords``, ``image_brief`` and ``image_alt``."""
    bare = lambda x: T.rtrim_chars(x, r".!? …")
    clip = lambda x: F.when(F.length(x) <= MAX_SUBJECT, x).otherwise(
        F.regexp_replace(F.substring(x, 1, MAX_SUBJECT), r"(?U)\s+$", "")
    )
    named = pages.withColumns({"keywords": page_keywords(), "_h": heading(), "_c": context()})
    subject = (
        F.when(F.col("_h").isNull() & F.col("_c").isNull(), F.lit(FALLBACK_SUBJECT))
        .when(F.col("_h").isNull(), clip(F.col("_c")))
        .when(F.col("_c").isNull(), clip(F.col("_h")))
        .otherwise(clip(F.concat(bare(F.col("_h")), F.lit(". "), bare(F.col("_c")))))
    )
    topic = F.when(F.size("keywords") > 0, F.concat(F.lit(". Konu: "), F.array_join("keywords", ", "))).otherwise(F.lit(""))
    return named.withColumns(
        {
            "image_brief": F.concat(subject, topic, F.lit(f". {STYLE}")),
            "image_alt": F.coalesce(
                F.concat("_h", F.lit(" konusunu temsil eden görsel")), F.lit("Gönderiye eşlik eden temsili görsel")
            ),
        }
    ).drop("_h", "_c")


def caption_headline(body: Column) -> Column:
    lines = F.filter(F.transform(F.split(body, "\n"), T.tidy), lambda l: l != "")
    first = F.get(lines, F.lit(0))
    return T.clip_caption(
        F.coalesce(meaningful_headline(), F.when(~is_navigational(first), first)), MAX_HEADLINE
    )


def captions(posts: DataFrame) -> DataFrame:
    """Adds caption columns to posts that carry page columns, ``body``, ``description`` and ``brand_name``.

    Without a headline there is no caption at all.
    """
    host = U.strip_www(U.host_of(F.col("url")))
    brand = F.when(F.length("brand_name") > 0, T.clip_caption(T.tidy(F.col("brand_name")), MAX_BRAND_LINE)).otherwise(
        F.when(host != "", T.clip_caption(host, MAX_BRAND_LINE))
    )
    staged = posts.withColumn("caption_headline", caption_headline(F.col("body")))
    start = F.lower(T.rtrim_chars(F.col("caption_headline"), "…"))
    texts = F.transform(
        F.filter(F.array("description", "meta_description"), lambda t: F.length(t) > 0), T.tidy
    )
    fitting = F.filter(texts, lambda t: (F.length(t) >= MIN_SUBLINE) & ~F.lower(t).startswith(start))
    shown = F.col("caption_headline").isNotNull()
    return staged.withColumns(
        {
            "caption_brand": F.when(shown, brand),
            "caption_subline": F.when(shown, T.clip_caption(F.get(fitting, F.lit(0)), MAX_SUBLINE)),
        }
    )


def image_template(allowed: Column, photo: Column, has_subline: Column, index: Column) -> Column:
    """Template by rotation over the allowed ones that suit a photo or a card."""
    every = F.array(*[F.lit(t) for t in PHOTO_TEMPLATES + CARD_TEMPLATES])
    usable = F.filter(
        F.when(F.size(allowed) > 0, allowed).otherwise(every), lambda t: (t != "quote") | has_subline
    )
    photos = F.filter(usable, lambda t: t.isin(PHOTO_TEMPLATES))
    cards = F.filter(usable, lambda t: t.isin(CARD_TEMPLATES))
    pool = F.when(photo | (F.size(cards) == 0), photos).otherwise(cards)
    return U.let(
        pool,
        lambda p: F.when(F.size(p) == 0, F.when(photo, F.lit("overlay")).otherwise(F.lit("poster"))).otherwise(
            F.get(p, F.pmod(F.abs(index), F.size(p)).cast("int"))
        ),
    )
