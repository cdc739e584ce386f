"""From fetched documents to scored crawls in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.operators import crawl_rules, frontier, issues, links, page_rules, scoring
from crawlens.scale import cut
from crawlens.sources import fetches as FS
from crawlens.sources import robots as R
from crawlens.sources import sitemap as S


@dataclass(frozen=True)
class Audit:
    pages: DataFrame
    links: DataFrame
    issues: DataFrame
    crawls: DataFrame
    blocked: DataFrame


def extract_tables(
    fetches: DataFrame, image_sizes: DataFrame | None = None, extractor=FS.scan_documents
) -> tuple[DataFrame, DataFrame]:
    """(pages, links) written once; everything later reads narrow columns of these tables."""
    facts = cut(FS.page_facts(FS.extract(fetches, extractor)), "facts")
    pages = FS.page_rows(facts).withColumn("is_asset", F.lit(False))
    if image_sizes is not None:
        pages = FS.measured_images(pages, image_sizes)
    return pages, FS.link_rows(facts)


def audit(
    fetches: DataFrame,
    crawls: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    vitals: DataFrame | None = None,
    image_sizes: DataFrame | None = None,
    assets: DataFrame | None = None,
    settings: frontier.CrawlSettings = frontier.CrawlSettings(),
    rules=page_rules.DEFAULT_RULES,
    most_blocked: int | None = None,
) -> Audit:
    """Audit every crawl found in ``fetches``.

    ``crawls(crawl_id, site_id, base_url, truncated, cancelled, ...)``;
    ``assets`` are probed downloads with page columns: link targets that are
    neither evaluated nor counted as pages.
    ``most_blocked`` bounds the number that the finding on blocked URLs names.
    """
    pages, links_ = extract_tables(fetches, image_sizes)
    links_ = cut(links_, "links")
    pages = cut(pages, "pages")
    return audit_tables(pages, links_, crawls, robots, sitemaps, vitals, assets, settings, rules, most_blocked)


def graph_tables(pages: DataFrame, links_: DataFrame, assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with link counts, click depth and home flag; links with their targets), both written.

    What needs no findings needs no more of an audit than this.
    """
    every = pages if assets is None else pages.unionByName(assets, allowMissingColumns=True)
    resolved = cut(links.resolve_links(links_, every), "resolved")
    depths = links.click_depths(resolved, pages)
    graph = links.graph_pages(every, resolved, depths)
    return cut(crawl_rules.with_home_flag(graph, crawl_rules.home_pages(pages)), "graph"), resolved


def audit_tables(
    pages: DataFrame,
    links_: DataFrame,
    crawls: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    vitals: DataFrame | None = None,
    assets: DataFrame | None = None,
    settings: frontier.CrawlSettings = frontier.CrawlSettings(),
    rules=page_rules.DEFAULT_RULES,
    most_blocked: int | None = None,
    made: tuple[DataFrame, DataFrame] | None = None,
) -> Audit:
    """The set-level part of ``audit`` over stored page and link tables; ``made``: their ``graph_tables``, where there are some."""
    single = page_rules.page_findings(page_rules.rule_input(pages, links_), rules)
    graph, resolved = made or graph_tables(pages, links_, assets)
    homes = crawl_rules.home_pages(pages)

    listed = blocked = None
    if robots is not None:
        sites = crawls.select("site_id", "base_url").distinct()
        roots = R.sitemap_urls(robots)
        if sitemaps is not None:
            own = roots.select("site_id").distinct()
            standard = sites.join(own, "site_id", "left_anti").select(
                "site_id", F.concat("base_url", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(0).alias("n")
            )
            listed = cut(S.sitemap_pages(sitemaps, roots.unionByName(standard), sites), "listed")
        asked = frontier.blockable_urls(links_, crawls, pages, listed)
        blocked = cut(frontier.blocked_urls(asked, robots, settings), "blocked")
    whole = crawl_rules.crawl_findings(graph, resolved, homes, listed, blocked, vitals, most_blocked)

    counted = crawls.join(
        pages.groupBy("crawl_id").agg(F.count(F.lit(1)).cast("int").alias("pages_crawled")), "crawl_id", "left"
    ).withColumn("pages_crawled", F.coalesce("pages_crawled", F.lit(0)))
    found = cut(issues.issue_rows(single, whole, crawls), "issues")
    scores = scoring.crawl_scores(scoring.category_scores(found, counted))
    done = (
        frontier.crawl_status(counted.withColumn("error", F.lit(None).cast("string")))
        .join(scores, "crawl_id", "left")
        .join(scoring.issue_counts(found), "crawl_id", "left")
        .withColumn("issue_counts", F.coalesce("issue_counts", F.create_map().cast("map<string,int>")))
        .drop("error")
    )
    return Audit(graph, resolved, found, done, blocked)
