"""Queries over stored audit tables: lists, groups, comparison, dashboard, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlens import catalogue
from crawlens.corpus import inputs, stage
from crawlens.corpus.oracle import sql
from crawlens.corpus.registry import query
from crawlens.operators import compare, issues, reports
from crawlens.operators.issues import IssueQuery, PageQuery
from crawlens.scale import first_n

_ISSUE = ["crawl_id", "url", "rule_code", "severity", "status", "found"]


def _issues(spark, sf):
    return stage.stored_issues(spark, sf).withColumn("found", F.col("evidence.found"))


def _pages(spark, sf):
    return stage.graph(spark, sf)


def _rules(spark):
    return catalogue.rules(spark)


# --- issue lists ---------------------------------------------------------

@query("issue_list", sql("SELECT crawl_id, url, rule_code, severity, status, found FROM issues WHERE category = 'links' AND status = 'open'"))
def issue_list(spark, sf):
    return issues.filter_issues(_issues(spark, sf), IssueQuery(category="links", status="open")).select(*_ISSUE)


@query("issue_list_min_severity", sql("SELECT crawl_id, url, rule_code, severity, status, found FROM issues WHERE severity IN ('high', 'critical')"))
def issue_list_min_severity(spark, sf):
    return issues.filter_issues(_issues(spark, sf), IssueQuery(min_severity="high")).select(*_ISSUE)


@query("issue_list_by_code", sql("SELECT crawl_id, url, rule_code, severity, status, found FROM issues WHERE severity = 'low' AND rule_code = 'SCHEMA_MISSING'"))
def issue_list_by_code(spark, sf):
    return issues.filter_issues(_issues(spark, sf), IssueQuery(severity="low", rule_code=" schema_missing ")).select(*_ISSUE)


_ORDER = "severity_rank DESC, rule_code, url, found"


@query(
    "issue_list_page",
    sql(f"SELECT * FROM (SELECT crawl_id, url, rule_code, found, row_number() OVER (PARTITION BY crawl_id ORDER BY {_ORDER}) AS place FROM issues) x WHERE place BETWEEN 21 AND 40"),
)
def issue_list_page(spark, sf):
    """Second page of twenty issues of every crawl."""
    rows = issues.paged_per_key(_issues(spark, sf), ["crawl_id"], issues.issue_order("url", "found"), 2, 20)
    return rows.select("crawl_id", "url", "rule_code", "found", F.col("rn").alias("place"))


@query(
    "issue_last_page",
    sql(f"SELECT crawl_id, url, rule_code, found, place FROM (SELECT crawl_id, url, rule_code, found, row_number() OVER (ORDER BY {_ORDER}, crawl_id) AS place, count(*) OVER () AS n FROM issues) x WHERE place > (n - 1) // 40 * 40"),
)
def issue_last_page(spark, sf):
    """The last page of forty of the list over all crawls."""
    rows = _issues(spark, sf)
    order = [-F.col("severity_rank"), F.col("rule_code"), F.col("url"), F.col("found"), F.col("crawl_id")]
    return issues.page_at(rows, order, ["issue_id"], -(-rows.count() // 40), 40).select("crawl_id", "url", "rule_code", "found", "place")


@query(
    "issue_top_page",
    sql(f"SELECT crawl_id, url, rule_code, found FROM issues ORDER BY {_ORDER}, crawl_id LIMIT 50 OFFSET 50"),
)
def issue_top_page(spark, sf):
    """Second page of the list over all crawls: a distributed top-n."""
    rows = issues.paged(_issues(spark, sf), [*issues.issue_order("url", "found"), F.col("crawl_id")], 2)
    return rows.select("crawl_id", "url", "rule_code", "found")


@query(
    "issue_groups",
    sql("""SELECT crawl_id, rule_code, title, category, severity, weight, count(*) FILTER (status = 'open') AS open_count, count(*) FILTER (status = 'ignored') AS ignored_count
    FROM issues GROUP BY 1, 2, 3, 4, 5, 6"""),
)
def issue_groups(spark, sf):
    return issues.issue_groups(_issues(spark, sf), _rules(spark)).drop("severity_rank")


@query(
    "issue_groups_ranked",
    sql("""SELECT crawl_id, rule_code, open_count, ignored_count, row_number() OVER (PARTITION BY crawl_id ORDER BY severity_rank DESC, open_count + ignored_count DESC, rule_code) AS place FROM (
    SELECT crawl_id, rule_code, severity_rank, count(*) FILTER (status = 'open') AS open_count, count(*) FILTER (status = 'ignored') AS ignored_count
    FROM issues WHERE severity_rank >= 2 AND category = 'meta' GROUP BY 1, 2, 3) x"""),
)
def issue_groups_ranked(spark, sf):
    groups = issues.issue_groups(_issues(spark, sf), _rules(spark), IssueQuery(min_severity="medium", category="meta"))
    ranked = issues.paged_per_key(groups, ["crawl_id"], issues.group_order(), 1, 200)
    return ranked.select("crawl_id", "rule_code", "open_count", "ignored_count", F.col("rn").alias("place"))


@query(
    "crawl_summary_top_issues",
    sql(f"SELECT crawl_id, url, rule_code, severity, title, place FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY {_ORDER}) AS place FROM issues) x WHERE place <= 100"),
)
def crawl_summary_top_issues(spark, sf):
    named = issues.with_rule_and_page(_issues(spark, sf).drop("url"), _rules(spark), _pages(spark, sf)).withColumn("url", F.col("page_url"))
    top = issues.top_issues(named, tie_break=("url", "found"))
    return top.select("crawl_id", "url", "rule_code", "severity", "title", F.col("rn").alias("place"))


@query("open_rule_issues", sql("SELECT site_id, crawl_id, url FROM issues WHERE rule_code = 'THIN_CONTENT' AND status = 'open'"))
def open_rule_issues(spark, sf):
    rule = "THIN_CONTENT"  # needs page columns alone
    return issues.open_site_issues(stage.page_rule_issues(spark, sf, rule), rule).select("site_id", "crawl_id", "url")


@query(
    "paged_totals",
    sql("""SELECT p.crawl_id, p.pages, i.issues FROM (SELECT crawl_id, count(*) AS pages FROM facts GROUP BY 1) p JOIN (SELECT crawl_id, count(*) AS issues FROM issues GROUP BY 1) i ON i.crawl_id = p.crawl_id"""),
)
def paged_totals(spark, sf):
    pages = issues.totals(_pages(spark, sf), ["crawl_id"]).withColumnRenamed("total", "pages")
    return pages.join(issues.totals(_issues(spark, sf), ["crawl_id"]).withColumnRenamed("total", "issues"), "crawl_id")


@query(
    "tenant_guard",
    sql("SELECT i.crawl_id, i.rule_code, count(*) AS issues FROM issues i JOIN sites s ON s.site_id = i.site_id WHERE s.tenant_id = 't0' GROUP BY 1, 2"),
)
def tenant_guard(spark, sf):
    mine = issues.tenant_guard(_issues(spark, sf), inputs.load(spark, sf, "sites"), "t0")
    return mine.groupBy("crawl_id", "rule_code").agg(F.count(F.lit(1)).alias("issues"))


# --- page lists ----------------------------------------------------------

@query(
    "page_list",
    sql("""SELECT * FROM (SELECT crawl_id, url, depth, status_code, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, url) AS place FROM graph WHERE contains(lower(url), 'haber') AND status_code BETWEEN 200 AND 404) x WHERE place <= 50"""),
)
def page_list(spark, sf):
    rows = issues.filter_pages(_pages(spark, sf), PageQuery(url_contains=" HABER ", min_status_code=200, max_status_code=404))
    return issues.paged_per_key(rows, ["crawl_id"], issues.page_order()).select("crawl_id", "url", "depth", "status_code", F.col("rn").alias("place"))


@query("page_list_exact", sql("SELECT crawl_id, url, inlink_count, outlink_internal FROM graph WHERE status_code = 404 AND depth = 3"))
def page_list_exact(spark, sf):
    return issues.filter_pages(_pages(spark, sf), PageQuery(status_code=404, depth=3)).select("crawl_id", "url", "inlink_count", "outlink_internal")


@query("pages_with_issues", sql("SELECT crawl_id, url FROM facts f WHERE EXISTS (SELECT 1 FROM issues i WHERE i.crawl_id = f.crawl_id AND i.url = f.url)"))
def pages_with_issues(spark, sf):
    return issues.filter_pages(_pages(spark, sf), PageQuery(has_issues=True), stage.found(spark, sf).issues).select("crawl_id", "url")


@query("pages_without_issues", sql("SELECT crawl_id, url FROM facts f WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.crawl_id = f.crawl_id AND i.url = f.url)"))
def pages_without_issues(spark, sf):
    return issues.filter_pages(_pages(spark, sf), PageQuery(has_issues=False), stage.found(spark, sf).issues).select("crawl_id", "url")


@query(
    "page_detail",
    sql("""SELECT g.crawl_id, g.url, g.depth, g.inlink_count, length(g.t) AS text_length, coalesce(i.n, 0) AS issues, coalesce(i.codes, '') AS codes
    FROM (SELECT *, nullif(main_text, '') AS t FROM graph) g LEFT JOIN (
      SELECT crawl_id, url, count(*) AS n, string_agg(rule_code, '|' ORDER BY severity_rank DESC, rule_code) AS codes FROM issues GROUP BY 1, 2) i ON i.crawl_id = g.crawl_id AND i.url = g.url"""),
)
def page_detail(spark, sf):
    rows = issues.page_detail(_pages(spark, sf), _issues(spark, sf))
    return rows.select(
        "crawl_id", "url", "depth", "inlink_count", F.length("main_text").alias("text_length"), F.size("issues").cast("bigint").alias("issues"),
        F.array_join(F.transform("issues", lambda i: i["rule_code"]), "|").alias("codes"),
    )


# --- ignore and reopen ---------------------------------------------------

def _requests(spark, sf, every: bool):
    """Users ignore canonical issues: site-wide where the rule is about its absence, else for the page."""
    rows = _issues(spark, sf).where(F.col("rule_code").startswith("CANONICAL") if every else F.col("rule_code") == "CANONICAL_MISSING")
    return rows.select(
        "issue_id", F.concat(F.lit(" "), "url", F.lit(" ")).alias("reason"), (F.col("rule_code") == "CANONICAL_MISSING").alias("apply_to_site"),
        F.lit("u1").alias("created_by"), F.lit("2024-05-01").cast("timestamp").alias("created_at"),
    )


def _ignores(spark, sf):
    """Existing ignore rows: every page with an ignored issue of the rule."""
    rows = _issues(spark, sf).where((F.col("status") == "ignored") & F.col("rule_code").isin("CANONICAL_MISSING", "CANONICAL_POINTS_ELSEWHERE"))
    return rows.groupBy("site_id", "rule_code", F.col("url").alias("url_pattern")).agg(
        F.lit("old").alias("reason"), F.lit("u0").alias("created_by"), F.lit("2024-04-01").cast("timestamp").alias("created_at")
    )


@query(
    "issue_ignore",
    sql("""SELECT crawl_id, url, rule_code, CASE WHEN rule_code = 'CANONICAL_POINTS_ELSEWHERE' THEN 'ignored'
      WHEN rule_code = 'CANONICAL_MISSING' THEN 'ignored' ELSE status END AS status FROM issues WHERE category = 'indexability'"""),
)
def issue_ignore(spark, sf):
    updated, _ = issues.ignore_issues(_issues(spark, sf), _ignores(spark, sf), _requests(spark, sf, True), _pages(spark, sf))
    return updated.where(F.col("category") == "indexability").select("crawl_id", "url", "rule_code", "status")


_OLD = "SELECT DISTINCT site_id, rule_code, url AS url_pattern FROM issues WHERE status = 'ignored' AND rule_code LIKE 'CANONICAL%'"
_NEW = """SELECT site_id, rule_code, CASE WHEN rule_code <> 'CANONICAL_MISSING' THEN url END AS url_pattern, max(url) AS reason FROM issues WHERE rule_code LIKE 'CANONICAL%' GROUP BY 1, 2, 3"""


@query(
    "issue_ignore_rows",
    sql("""SELECT coalesce(o.site_id, n.site_id) AS site_id, coalesce(o.rule_code, n.rule_code) AS rule_code, coalesce(o.url_pattern, n.url_pattern) AS url_pattern,
    coalesce(n.reason, 'old') AS reason, CASE WHEN o.site_id IS NOT NULL THEN 'u0' ELSE 'u1' END AS created_by
    FROM old_rows o FULL JOIN new_rows n ON o.site_id = n.site_id AND o.rule_code = n.rule_code AND o.url_pattern IS NOT DISTINCT FROM n.url_pattern""",
        old_rows=_OLD, new_rows=_NEW),
)
def issue_ignore_rows(spark, sf):
    _, merged = issues.ignore_issues(_issues(spark, sf), _ignores(spark, sf), _requests(spark, sf, True), _pages(spark, sf))
    return merged.select("site_id", "rule_code", "url_pattern", "reason", "created_by")


@query(
    "issue_reopen",
    sql("SELECT crawl_id, url, rule_code, CASE WHEN rule_code = 'CANONICAL_MISSING' THEN 'open' ELSE status END AS status FROM issues WHERE category = 'indexability'"),
)
def issue_reopen(spark, sf):
    updated, _ = issues.reopen_issues(_issues(spark, sf), _ignores(spark, sf), _requests(spark, sf, False), _pages(spark, sf))
    return updated.where(F.col("category") == "indexability").select("crawl_id", "url", "rule_code", "status")


@query("issue_reopen_rows", sql("SELECT site_id, rule_code, url_pattern FROM old_rows WHERE rule_code = 'CANONICAL_POINTS_ELSEWHERE'", old_rows=_OLD))
def issue_reopen_rows(spark, sf):
    _, kept = issues.reopen_issues(_issues(spark, sf), _ignores(spark, sf), _requests(spark, sf, False), _pages(spark, sf))
    return kept.select("site_id", "rule_code", "url_pattern")


# --- comparison and dashboard -------------------------------------------

def _crawls(spark, sf):
    return stage.audited(spark, sf).crawls


def _keyed(spark, sf):
    return compare.issue_keys(_issues(spark, sf), _pages(spark, sf))


_CHANGES = """
SELECT site_id, rule_code, url, 'new' AS change FROM issues c WHERE c.crawl_id LIKE '%-c2'
  AND NOT EXISTS (SELECT 1 FROM issues p WHERE p.site_id = c.site_id AND p.crawl_id LIKE '%-c1' AND p.rule_code = c.rule_code AND p.url = c.url)
UNION ALL
SELECT site_id, rule_code, url, 'resolved' FROM issues p WHERE p.crawl_id LIKE '%-c1'
  AND NOT EXISTS (SELECT 1 FROM issues c WHERE p.site_id = c.site_id AND c.crawl_id LIKE '%-c2' AND p.rule_code = c.rule_code AND p.url = c.url)
"""


@query("crawl_compare_issues", sql("SELECT site_id, rule_code, url, change FROM changes", changes=_CHANGES))
def crawl_compare_issues(spark, sf):
    rows = compare.issue_changes(_keyed(spark, sf), compare.crawl_pairs(_crawls(spark, sf)))
    return rows.select("site_id", "rule_code", F.col("key_url").alias("url"), "change")


@query(
    "crawl_compare_summary",
    sql("""SELECT b.site_id, b.crawl_id AS current_id, a.crawl_id AS previous_id, (b.o100 - a.o100) / 100.0 AS score_delta, b.pages_crawled AS current_pages, a.pages_crawled AS previous_pages,
    n.new_issues, n.resolved_issues, t.n - n.new_issues AS unchanged_issues
    FROM crawls b JOIN crawls a ON a.site_id = b.site_id AND a.crawl_no = 1
    JOIN (SELECT site_id, count(*) FILTER (change = 'new') AS new_issues, count(*) FILTER (change = 'resolved') AS resolved_issues FROM changes GROUP BY 1) n ON n.site_id = b.site_id
    JOIN (SELECT crawl_id, count(*) AS n FROM issues GROUP BY 1) t ON t.crawl_id = b.crawl_id WHERE b.crawl_no = 2""", changes=_CHANGES),
)
def crawl_compare_summary(spark, sf):
    crawls, keyed = _crawls(spark, sf), _keyed(spark, sf)
    pairs = compare.crawl_pairs(crawls)
    rows = compare.compare_crawls(crawls, pairs, compare.issue_changes(keyed, pairs), keyed)
    return rows.select(
        "site_id", "current_id", "previous_id", F.col("score_delta").cast("double").alias("score_delta"), F.col("current_pages_crawled").alias("current_pages"),
        F.col("previous_pages_crawled").alias("previous_pages"), "new_issues", "resolved_issues", "unchanged_issues",
    )


@query(
    "crawl_compare_scores",
    sql("""SELECT coalesce(b.site_id, a.site_id) AS site_id, coalesce(b.kind, a.kind) AS kind, coalesce(b.name, a.name) AS name, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta
    FROM (SELECT * FROM measures WHERE crawl_id LIKE '%-c2') b FULL JOIN (SELECT * FROM measures WHERE crawl_id LIKE '%-c1') a
    ON a.site_id = b.site_id AND a.kind = b.kind AND a.name = b.name""",
        measures="""SELECT crawl_id, site_id, 'issues' AS kind, severity AS name, CAST(count(*) AS DOUBLE) AS v FROM issues GROUP BY 1, 2, 3, 4
        UNION ALL SELECT crawl_id, split_part(crawl_id, '-', 1), 'score', category, s100 / 100.0 FROM scores"""),
)
def crawl_compare_scores(spark, sf):
    crawls, keyed = _crawls(spark, sf), _keyed(spark, sf)
    pairs = compare.crawl_pairs(crawls)
    rows = compare.compare_crawls(crawls, pairs, compare.issue_changes(keyed, pairs), keyed)
    flat = lambda column, kind: rows.select("site_id", F.lit(kind).alias("kind"), F.explode(column).alias("name", "delta")).withColumn("delta", F.col("delta").cast("double"))
    return flat("issue_count_delta", "issues").unionByName(flat("category_delta", "score"))


@query(
    "dashboard_sites",
    sql("""SELECT s.tenant_id, s.site_id, s.name, s.is_active, b.crawl_id AS last_crawl_id, b.status AS last_status, b.overall_score AS last_score, (b.o100 - a.o100) / 100.0 AS score_delta,
    CAST(coalesce(b.finished_at, b.started_at, b.created_at) AS VARCHAR) AS last_time, i.n AS issues
    FROM sites s JOIN crawls b ON b.site_id = s.site_id AND b.crawl_no = 2 JOIN crawls a ON a.site_id = s.site_id AND a.crawl_no = 1
    JOIN (SELECT crawl_id, count(*) AS n FROM issues GROUP BY 1) i ON i.crawl_id = b.crawl_id"""),
)
def dashboard_sites(spark, sf):
    cards = compare.site_cards(inputs.load(spark, sf, "sites"), _crawls(spark, sf))
    total = F.aggregate(F.map_values("issue_counts"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return cards.select(
        "tenant_id", "site_id", "name", "is_active", "last_crawl_id", "last_status", F.col("last_score").cast("double").alias("last_score"),
        F.col("score_delta").cast("double").alias("score_delta"), F.date_format("last_time", "yyyy-MM-dd HH:mm:ss").alias("last_time"), total.alias("issues"),
    )


@query(
    "dashboard_totals",
    sql("""SELECT s.tenant_id, s.site_count, s.q / 10.0 AS average_score, i.severity, i.n AS issues FROM (
      SELECT tenant_id, n AS site_count, total // (n * 10) + CASE WHEN 2 * (total % (n * 10)) > n * 10 OR (2 * (total % (n * 10)) = n * 10 AND (total // (n * 10)) % 2 = 1) THEN 1 ELSE 0 END AS q
      FROM (SELECT s.tenant_id, count(*) AS n, CAST(sum(c.o100) AS BIGINT) AS total FROM sites s JOIN crawls c ON c.site_id = s.site_id AND c.crawl_no = 2 GROUP BY 1) x) s
    JOIN (SELECT s.tenant_id, i.severity, count(*) AS n FROM issues i JOIN sites s ON s.site_id = i.site_id WHERE i.crawl_id LIKE '%-c2' GROUP BY 1, 2) i ON i.tenant_id = s.tenant_id"""),
)
def dashboard_totals(spark, sf):
    totals = compare.dashboard_totals(compare.site_cards(inputs.load(spark, sf, "sites"), _crawls(spark, sf)))
    return totals.select("tenant_id", "site_count", F.col("average_score").cast("double").alias("average_score"), F.explode("issue_totals").alias("severity", "issues"))


@query(
    "recent_crawls",
    sql("SELECT tenant_id, crawl_id, place FROM (SELECT s.tenant_id, c.crawl_id, row_number() OVER (PARTITION BY s.tenant_id ORDER BY c.created_at DESC, c.crawl_id DESC) AS place FROM crawls0 c JOIN sites s ON s.site_id = c.site_id) x WHERE place <= 10"),
)
def recent_crawls(spark, sf):
    rows = compare.recent_crawls(inputs.load(spark, sf, "crawls0"), inputs.load(spark, sf, "sites"))
    return rows.select("tenant_id", "crawl_id", F.col("rn").alias("place"))


@query(
    "latest_crawls",
    sql("SELECT site_id, crawl_id, place FROM (SELECT site_id, crawl_id, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, crawl_id DESC) AS place FROM crawls0) x WHERE place <= 2"),
)
def latest_crawls(spark, sf):
    return compare.latest_crawls(inputs.load(spark, sf, "crawls0")).select("site_id", "crawl_id", F.col("rn").alias("place"))


@query(
    "recent_jobs",
    sql("SELECT tenant_id, job_id, place FROM (SELECT tenant_id, job_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, job_id DESC) AS place FROM jobs) x WHERE place <= 5"),
)
def recent_jobs(spark, sf):
    return compare.recent_jobs(inputs.load(spark, sf, "jobs")).select("tenant_id", "job_id", F.col("rn").alias("place"))


@query(
    "vitals_history",
    sql("SELECT site_id, vital_id, lcp, place FROM (SELECT site_id, vital_id, lcp, row_number() OVER (PARTITION BY site_id ORDER BY collected_at DESC, vital_id DESC) AS place FROM vitals) x WHERE place <= 30"),
)
def vitals_history(spark, sf):
    return compare.vitals_history(stage.vitals(spark, sf)).select("site_id", "vital_id", "lcp", F.col("rn").alias("place"))


# --- reports -------------------------------------------------------------

def _previous(spark, sf):
    pairs = compare.crawl_pairs(_crawls(spark, sf))
    scores = _crawls(spark, sf).select(F.col("crawl_id").alias("previous_id"), F.col("overall_score").alias("previous_score"))
    return pairs.join(scores, "previous_id").select(F.col("current_id").alias("crawl_id"), "previous_score")


@query(
    "report_hero",
    sql("""SELECT c.crawl_id, c.pages_crawled, c.overall_score, i.open_count, i.critical_count, i.high_count, i.ignored_count, (c.o100 - p.o100) / 100.0 AS score_delta,
    CASE WHEN c.o100 > p.o100 THEN '▲' WHEN c.o100 < p.o100 THEN '▼' WHEN c.o100 = p.o100 THEN '=' END AS arrow
    FROM crawls c LEFT JOIN crawls p ON p.site_id = c.site_id AND p.crawl_no = 1 AND c.crawl_no = 2
    JOIN (SELECT crawl_id, count(*) FILTER (status = 'open') AS open_count, count(*) FILTER (status = 'open' AND severity = 'critical') AS critical_count,
      count(*) FILTER (status = 'open' AND severity = 'high') AS high_count, count(*) FILTER (status = 'ignored') AS ignored_count FROM issues GROUP BY 1) i ON i.crawl_id = c.crawl_id"""),
)
def report_hero(spark, sf):
    rows = reports.hero(_crawls(spark, sf), _issues(spark, sf), _previous(spark, sf))
    return rows.select(
        "crawl_id", "pages_crawled", F.col("overall_score").cast("double").alias("overall_score"), "open_count", "critical_count", "high_count",
        "ignored_count", F.col("score_delta").cast("double").alias("score_delta"), "arrow",
    )


@query(
    "report_scorecard",
    sql("SELECT s.crawl_id, row_number() OVER (PARTITION BY s.crawl_id ORDER BY s.s100, s.category) AS place, s.category, s.s100 / 100.0 AS score, w.weight FROM scores s JOIN weights w ON w.category = s.category"),
)
def report_scorecard(spark, sf):
    return reports.scorecard(_crawls(spark, sf)).withColumn("score", F.col("score").cast("double"))


# Impact times the page count, as an exact integer.
_IMPACT = """
SELECT x.crawl_id, x.rule_code, x.severity_rank, x.issue_count, c.pages_crawled AS n, x.penalty_sum * w.weight AS impact_n, x.how_to_fix, x.title
FROM (SELECT i.crawl_id, i.rule_code, i.category, i.title, i.how_to_fix, max(severity_rank) AS severity_rank, count(*) AS issue_count,
    CAST(sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END) AS BIGINT) AS penalty_sum
  FROM issues i WHERE status = 'open' GROUP BY 1, 2, 3, 4, 5) x
JOIN crawls c ON c.crawl_id = x.crawl_id JOIN weights w ON w.category = x.category
"""
_TOP = "SELECT *, max(impact_n) OVER (PARTITION BY crawl_id) AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY impact_n DESC, severity_rank DESC, issue_count DESC, rule_code) AS place FROM impacts) y WHERE place <= 5"


@query("report_impacts", sql("SELECT crawl_id, rule_code, issue_count, round(impact_n / n, 6) AS impact FROM impacts", impacts=_IMPACT))
def report_impacts(spark, sf):
    rows = reports.rule_impacts(_issues(spark, sf), _crawls(spark, sf))
    return rows.select("crawl_id", "rule_code", "issue_count", F.round(F.col("impact").cast("double"), 6).alias("impact"))


@query(
    "report_impacts_by_scope",
    sql("""SELECT x.crawl_id, x.rule_code, x.issue_count, round(CASE WHEN x.is_crawl_level THEN x.worst ELSE x.total / c.pages_crawled END * w.weight, 6) AS impact
    FROM (SELECT crawl_id, rule_code, category, is_crawl_level, count(*) AS issue_count, sum(p) AS total, max(p) AS worst
      FROM (SELECT *, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END AS p FROM issues WHERE status = 'open') o GROUP BY 1, 2, 3, 4) x
    JOIN crawls c ON c.crawl_id = x.crawl_id JOIN weights w ON w.category = x.category"""),
)
def report_impacts_by_scope(spark, sf):
    rows = reports.rule_impacts(_issues(spark, sf), _crawls(spark, sf), "scope")
    return rows.select("crawl_id", "rule_code", "issue_count", F.round(F.col("impact").cast("double"), 6).alias("impact"))


def _top(spark, sf):
    return reports.priorities(reports.rule_impacts(_issues(spark, sf), _crawls(spark, sf)), _rules(spark))


@query(
    "report_priorities",
    sql("""SELECT crawl_id, place, rule_code, title, issue_count, issue_count || ' sayfa' AS scope,
    CAST(CASE WHEN top_n <= 0 THEN 0 ELSE (impact_n * 100) // top_n + CASE WHEN 2 * ((impact_n * 100) % top_n) > top_n OR (2 * ((impact_n * 100) % top_n) = top_n AND ((impact_n * 100) // top_n) % 2 = 1) THEN 1 ELSE 0 END END AS INT) AS bar_width,
    split_part(how_to_fix, chr(10), 1) AS first_step, len(string_split(how_to_fix, chr(10))) - 1 AS more_steps FROM top""", impacts=_IMPACT, top=_TOP),
)
def report_priorities(spark, sf):
    return _top(spark, sf).select("crawl_id", "place", "rule_code", "title", "issue_count", "scope", "bar_width", "first_step", "more_steps")


@query(
    "report_examples",
    sql("""SELECT t.crawl_id, t.rule_code, array_to_string(list_slice(list_sort(list_distinct(list(i.url))), 1, 2), '|') AS examples
    FROM top t JOIN issues i ON i.crawl_id = t.crawl_id AND i.rule_code = t.rule_code AND i.status = 'open' GROUP BY 1, 2""", impacts=_IMPACT, top=_TOP),
)
def report_examples(spark, sf):
    return reports.priority_examples(_top(spark, sf), _keyed(spark, sf)).withColumn("examples", F.array_join("examples", "|"))


@query(
    "report_rest",
    sql("""SELECT a.crawl_id, a.r - t.r AS rest_rules, a.i - t.i AS rest_issues FROM (SELECT crawl_id, count(*) AS r, sum(issue_count) AS i FROM impacts GROUP BY 1) a
    JOIN (SELECT crawl_id, count(*) AS r, sum(issue_count) AS i FROM top GROUP BY 1) t ON t.crawl_id = a.crawl_id""", impacts=_IMPACT, top=_TOP),
)
def report_rest(spark, sf):
    impacts = reports.rule_impacts(_issues(spark, sf), _crawls(spark, sf))
    return reports.rest_note(impacts, _top(spark, sf))


@query("report_documents")
def report_documents(spark, sf):
    """One text per crawl; its numbers are checked by the report_* queries it is made of."""
    crawls, found = _crawls(spark, sf), _issues(spark, sf)
    impacts = reports.rule_impacts(found, crawls)
    top = reports.priorities(impacts, _rules(spark))
    return reports.report_documents(reports.hero(crawls, found, _previous(spark, sf)), reports.scorecard(crawls), top, reports.rest_note(impacts, top))


_PERIODS = """SELECT r.request_id, r.site_id, r.crawl_id, CAST(least(s, e) AS VARCHAR) AS period_start, CAST(greatest(s, e) AS VARCHAR) AS period_end FROM (
      SELECT 'r' || j.page_id AS request_id, j.site_id, CASE WHEN j.type = 'title' THEN j.site_id || '-c1' ELSE j.site_id || '-c2' END AS crawl_id, j.type, j.status, j.site_no,
        CASE WHEN j.status = 'queued' THEN DATE '2024-06-01' ELSE CAST(c.started_at AS DATE) END AS s,
        CASE WHEN j.status = 'failed' THEN DATE '2024-01-15' ELSE DATE '2024-05-20' END AS e
      FROM jobs j JOIN crawls0 c ON c.crawl_id = CASE WHEN j.type = 'title' THEN j.site_id || '-c1' ELSE j.site_id || '-c2' END
      WHERE j.type <> 'meta_description') r"""


def _reports(spark, sf):
    """Report requests derived from jobs; those that name another site's crawl are invalid."""
    jobs = inputs.load(spark, sf, "jobs")
    other = F.concat(F.lit("s"), (F.col("site_no") + 1).cast("string"), F.lit("-c1"))
    requests = jobs.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("request_id"), "site_id",
        F.when(F.col("type") == "title", F.concat("site_id", F.lit("-c1"))).when(F.col("type") == "meta_description", other).alias("crawl_id"),
        F.when(F.col("type") == "title", F.concat("site_id", F.lit("-c2"))).alias("compare_crawl_id"),
        F.when(F.col("status") == "queued", F.lit("2024-06-01")).cast("date").alias("period_start"),
        F.when(F.col("status") == "failed", F.lit("2024-01-15")).cast("date").alias("period_end"), F.lit("2024-05-20").cast("date").alias("today"),
    )
    rows = reports.report_requests(requests, inputs.load(spark, sf, "sites"), inputs.load(spark, sf, "crawls0"))
    return rows.select("request_id", "site_id", "crawl_id", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"))


@query("report_period", sql(_PERIODS))
def report_period(spark, sf):
    return _reports(spark, sf)


@query("report_list", sql(f"SELECT * FROM (SELECT site_id, request_id, period_end, row_number() OVER (PARTITION BY site_id ORDER BY period_end DESC, request_id DESC) AS place FROM ({_PERIODS}) p) x WHERE place <= 20"))
def report_list(spark, sf):
    """The newest twenty reports of every site."""
    return first_n(_reports(spark, sf), ["site_id"], reports.report_order(), 20, "place").select("site_id", "request_id", "period_end", "place")
