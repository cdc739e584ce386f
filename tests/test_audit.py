"""A small site end to end; expected numbers follow from its pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from crawlens.operators import frontier
from crawlens.plans.audit import audit
from crawlens.sources import fetches as FS

O = "https://t.example"


def _doc(title, body, desc=None, canonical=None, schema=None, robots=None):
    head = f"<title>{title}</title>"
    if desc:
        head += f'<meta name="description" content="{desc}">'
    if robots:
        head += f'<meta name="robots" content="{robots}">'
    if canonical:
        head += f'<link rel="canonical" href="{canonical}">'
    if schema:
        head += '<script type="application/ld+json">{"@type":"%s"}</script>' % schema
    return f'<!doctype html><html lang="tr"><head>{head}</head><body>{body}</body></html>'


DESC = "A description that is long enough to be useful for a reader of the result list, number "
HOME = _doc(
    "Home page with a title of useful length", "<h1>Home</h1><p>Start here.</p><h2>Part</h2><img src='/logo.png' alt='logo'>"
    "<a href='/a'>first page</a><a href='/b'>second page</a><a href='/old'>moved page</a><a href='/gone'>dead end</a>"
    "<a href='/private/x'>private</a><a href='/files/list.pdf'>list</a><a href='/files/none.pdf'>no list</a>"
    "<a href='https://out.example/x' rel='nofollow'>elsewhere</a>", DESC + "one", "/", "WebSite")
TWIN = _doc("The same title on two different pages", "<h1>Twin</h1><p>The same body.</p><img src='/x.png' alt='x'><a href='/c'>third page</a>",
            DESC + "two", "/a", "Article")
CLOSED = _doc("Closed page with a title of useful length", "<h1>Closed</h1><p>Not for the index.</p>", DESC + "three", "/c", "WebPage", "noindex, follow")
LONELY = _doc("Only found in the sitemap now", "<h1>Only found in the sitemap now</h1><p>Nobody links here.</p>")


@pytest.fixture(scope="module")
def result(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for seq, (path, status, html, final, seed, depth) in enumerate([
        ("/", 200, HOME, None, True, 0), ("/sitemap-only", 200, LONELY, None, True, 0), ("/a", 200, TWIN, None, False, 1),
        ("/b", 200, TWIN, None, False, 1), ("/old", 200, TWIN, "/a", False, 1), ("/gone", 404, LONELY, None, False, 1),
        ("/c", 200, CLOSED, None, False, 2),
    ]):
        rows.append(("c1", "s1", O, seq, O + path, O + (final or path), status, "text/html; charset=utf-8", 1 if final else 0,
                     None, 10, at, None, html, seed, depth))
    fetches = spark.createDataFrame(rows, FS.FETCH_SCHEMA)
    crawls = spark.createDataFrame([("c1", "s1", O, False, False)], "crawl_id string, site_id string, base_url string, truncated boolean, cancelled boolean")
    robots = spark.createDataFrame([("s1", f"User-agent: *\nDisallow: /private\nSitemap: {O}/sitemap.xml")], "site_id string, body string")
    xml = f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>{O}/</loc></url><url><loc>{O}/sitemap-only</loc></url></urlset>'
    sitemaps = spark.createDataFrame([("s1", f"{O}/sitemap.xml", xml)], "site_id string, sitemap_url string, xml string")
    assets = spark.createDataFrame(
        [("c1", "s1", O, f"{O}/files/list.pdf", 200), ("c1", "s1", O, f"{O}/files/none.pdf", 404)],
        "crawl_id string, site_id string, base_url string, url string, status_code int",
    ).withColumns({
        "page_id": F.sha2(F.concat("crawl_id", F.lit("|"), "url"), 256), "url_hash": F.sha2("url", 256), "is_asset": F.lit(True),
        "depth": F.lit(1), "is_seed": F.lit(False), "fetch_seq": F.lit(100).cast("bigint"), "redirect_count": F.lit(0),
        "redirect_to": F.lit(None).cast("string"), "robots_meta": F.lit(None).cast("string"),
    })
    return audit(fetches, crawls, robots, sitemaps, assets=assets)


def test_graph(result):
    pages = {r.url.removeprefix(O): r for r in result.pages.collect()}
    assert {p: pages[p].depth for p in ("/", "/a", "/b", "/c", "/old", "/gone", "/sitemap-only")} == {
        "/": 0, "/a": 1, "/b": 1, "/c": 2, "/old": 1, "/gone": 1, "/sitemap-only": 0}
    assert {p: pages[p].inlink_count for p in ("/", "/a", "/b", "/c", "/old", "/gone", "/sitemap-only")} == {
        "/": 0, "/a": 2, "/b": 1, "/c": 2, "/old": 0, "/gone": 1, "/sitemap-only": 0}
    assert (pages["/"].outlink_internal, pages["/"].outlink_external) == (7, 1)
    private = result.links.where(F.col("to_url").endswith("/private/x")).first()
    assert private.to_page_id is None


def test_findings(result):
    found = {}
    urls = {r.page_id: r.url.removeprefix(O) for r in result.pages.collect()}
    for r in result.issues.collect():
        found.setdefault(r.rule_code, []).append((urls[r.page_id], len(r.evidence.sample_urls)))
    found = {k: sorted(v) for k, v in found.items()}
    thin = [(p, 0) for p in ("/", "/a", "/b", "/c", "/sitemap-only")]
    assert found == {
        "THIN_CONTENT": thin, "OG_TAGS_MISSING": thin, "CANONICAL_POINTS_ELSEWHERE": [("/b", 0)], "ROBOTS_NOINDEX": [("/c", 0)],
        "BROKEN_PAGE_4XX": [("/gone", 0)], "CANONICAL_MISSING": [("/sitemap-only", 0)], "META_TITLE_TOO_SHORT": [("/sitemap-only", 0)],
        "META_DESC_MISSING": [("/sitemap-only", 0)], "SCHEMA_MISSING": [("/sitemap-only", 0)],
        "DUPLICATE_CONTENT": [("/a", 2)], "META_TITLE_DUPLICATE": [("/a", 2)], "META_DESC_DUPLICATE": [("/a", 2)],
        "BROKEN_INTERNAL_LINK": [("/", 2)], "ORPHAN_PAGE": [("/sitemap-only", 1)],
        "PAGE_NOT_IN_SITEMAP": [("/a", 1), ("/b", 1)], "BLOCKED_BY_ROBOTS_TXT": [("/", 1)],
    }


def test_scores(result):
    crawl = result.crawls.first()
    assert crawl.status == "completed" and crawl.pages_crawled == 7
    assert {k: float(v) for k, v in crawl.category_scores.items()} == {
        "indexability": 73.29, "meta": 85.71, "content": 79.29, "links": 77.0, "performance": 100.0, "images": 100.0,
        "structured_data": 97.43, "i18n": 100.0}
    assert float(crawl.overall_score) == 54.52
    assert len(crawl.scoring_snapshot) == 14 and sum(crawl.issue_counts.values()) == result.issues.count()


def test_blocked(result):
    assert [r.url for r in result.blocked.collect()] == [f"{O}/private/x"]


def test_pattern_filter(spark):
    rows = spark.createDataFrame([("https://e.com/Blog/1",), ("https://e.com/shop/2",)], "url string")
    ok = lambda i, e: [r[0] for r in rows.select(frontier.passes_patterns(F.col("url"), i, e)).collect()]
    assert ok([], []) == [True, True]
    assert ok(["/blog/"], ["("]) == [True, False]
    assert ok(["e.com"], ["/SHOP/"]) == [True, False]
