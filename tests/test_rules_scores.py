"""Rules by one-field changes of a healthy page, score examples, skew helpers, stored-crawl operators."""

import random

import pytest
from pyspark.sql import functions as F

from crawlens import catalogue, scale
from crawlens.operators import brands, compare, crawl_rules, issues, links, page_rules, scoring
from crawlens.scale import bucketed, first_n, ranked, sample_lists, spread_lookup

HEALTHY = {
    "url": "https://example.com/", "status_code": 200, "title": "A page title of a sensible length here", "meta_description": "a" * 120, "h1": ["One"],
    "internal_anchor_texts": ["about the company"], "word_count": 500, "canonical_url": "https://example.com/", "redirect_count": 0, "redirect_to": None,
    "invalid_redirect_target": None, "invalid_schema_blocks": 0, "robots_meta": None, "heading_levels": [1, 2, 3, 2], "images_total": 2, "images_no_alt": 0,
    "image_sizes": [("https://example.com/a.jpg", 40000)], "schema_types": ["Article"], "og_tags": ["OG:title", "og:description", "og:image"], "lang": "tr", "is_html": True,
}
SCHEMA = (
    "case string, url string, status_code int, title string, meta_description string, h1 array<string>, internal_anchor_texts array<string>, word_count int, "
    "canonical_url string, redirect_count int, redirect_to string, invalid_redirect_target string, invalid_schema_blocks int, robots_meta string, "
    "heading_levels array<int>, images_total int, images_no_alt int, image_sizes array<struct<url:string,bytes:bigint>>, schema_types array<string>, "
    "og_tags array<string>, lang string, is_html boolean"
)
CHANGES = [
    ({}, set()), ({"status_code": 404}, {"BROKEN_PAGE_4XX"}), ({"status_code": 0}, {"SERVER_ERROR_5XX"}), ({"status_code": 503, "title": None}, {"SERVER_ERROR_5XX"}),
    ({"status_code": 301, "invalid_redirect_target": "javascript:;"}, {"REDIRECT_TARGET_INVALID"}),
    ({"redirect_count": 2, "redirect_to": "https://example.com/x", "title": None}, {"REDIRECT_CHAIN"}), ({"redirect_count": 1, "redirect_to": "https://example.com/x", "lang": ""}, set()),
    ({"robots_meta": "NoIndex, follow"}, {"ROBOTS_NOINDEX"}), ({"canonical_url": " "}, {"CANONICAL_MISSING"}), ({"canonical_url": "https://EXAMPLE.com"}, set()),
    ({"canonical_url": "https://example.com/b"}, {"CANONICAL_POINTS_ELSEWHERE"}), ({"title": "  "}, {"META_TITLE_MISSING"}), ({"title": "x" * 29}, {"META_TITLE_TOO_SHORT"}),
    ({"title": "x" * 30}, set()), ({"title": "x" * 60 + " "}, set()), ({"title": "x" * 61}, {"META_TITLE_TOO_LONG"}), ({"meta_description": None}, {"META_DESC_MISSING"}),
    ({"meta_description": "x" * 161}, {"META_DESC_TOO_LONG"}), ({"h1": []}, {"H1_MISSING"}), ({"h1": ["a", "b"]}, {"H1_MULTIPLE"}), ({"word_count": 299}, {"THIN_CONTENT"}),
    ({"heading_levels": [1, 3]}, {"HEADING_HIERARCHY_BROKEN"}), ({"heading_levels": [3, 1, 2]}, set()), ({"heading_levels": []}, set()),
    ({"internal_anchor_texts": ["TIKLAYIN!", "Devamını oku", None]}, {"GENERIC_ANCHOR_TEXT"}), ({"images_no_alt": 1}, {"IMAGE_MISSING_ALT"}),
    ({"image_sizes": [("u", 204801)]}, {"IMAGE_TOO_LARGE"}), ({"image_sizes": [("u", 204800)]}, set()), ({"image_sizes": []}, set()), ({"schema_types": []}, {"SCHEMA_MISSING"}),
    ({"invalid_schema_blocks": 1}, {"INVALID_STRUCTURED_DATA"}), ({"og_tags": ["og:title"]}, {"OG_TAGS_MISSING"}), ({"lang": None}, {"LANG_ATTR_MISSING"}), ({"is_html": False, "title": None}, set()),
]


def test_page_rules(spark):
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    rows = [(str(i), *[{**HEALTHY, **change}[n] for n in names]) for i, (change, _) in enumerate(CHANGES)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"crawl_id": F.lit("c"), "site_id": F.lit("s"), "page_id": F.col("case"), "fetch_seq": F.lit(0)})
    got = {}
    for r in page_rules.page_findings(pages).collect():
        got.setdefault(r.page_id, set()).add(r.rule_code)
    assert [got.get(str(i), set()) for i in range(len(CHANGES))] == [codes for _, codes in CHANGES]


def _scores(spark, found, pages):
    rows = [("c", code, code in catalogue.CRAWL_LEVEL_CODES, *catalogue.rule_constants(code)[:2]) for code in found]
    findings = spark.createDataFrame(rows, "crawl_id string, rule_code string, is_crawl_level boolean, category string, severity string")
    crawls = spark.createDataFrame([("c", pages)], "crawl_id string, pages_crawled int")
    return {r.category: float(r.score) for r in scoring.category_scores(findings, crawls).collect()}


def test_category_scores(spark):
    assert _scores(spark, ["META_TITLE_TOO_SHORT"], 2)["meta"] == 96
    assert _scores(spark, ["SITEMAP_MISSING"], 60)["indexability"] == 92
    assert _scores(spark, ["ORPHAN_PAGE"] * 5, 5)["links"] == 92
    assert _scores(spark, ["META_TITLE_TOO_SHORT", "META_DESC_DUPLICATE"], 2)["meta"] == 93
    assert _scores(spark, ["SCHEMA_MISSING"], 1) == {**{c: 100.0 for c in catalogue.CATEGORY_WEIGHTS}, "structured_data": 97.0}
    assert _scores(spark, ["SCHEMA_MISSING"], 0) == {}


@pytest.mark.parametrize(("given", "overall"), [
    ({"indexability": 10}, 50), ({"indexability": 0}, 47.37), ({c: 92 for c in catalogue.CATEGORY_WEIGHTS}, 69.23), ({c: 50 for c in catalogue.CATEGORY_WEIGHTS}, 26.47),
    ({c: 20 for c in catalogue.CATEGORY_WEIGHTS}, 18.37), ({"meta": 50}, 66.67), ({c: 100 for c in catalogue.CATEGORY_WEIGHTS}, 100), ({}, 0),
])
def test_overall(spark, given, overall):
    frame = spark.createDataFrame([({k: v for k, v in given.items()},)], "m map<string,int>")
    scores = F.transform_values("m", lambda k, v: v.cast("decimal(5,2)"))
    assert float(frame.select(scoring.overall_from_map(scores)).first()[0]) == overall


def test_rounding_modes(spark):
    frame = spark.createDataFrame([(1,)], "x int").select(F.lit("2.125").cast("decimal(20,6)").alias("v"))
    assert [float(v) for v in frame.select(scoring._round2(F.col("v"), "half_even"), scoring._round2(F.col("v"), "half_up")).first()] == [2.12, 2.13]


def test_rescore(spark):
    found = ["META_TITLE_MISSING"] * 2 + ["SITEMAP_MISSING"] + ["ORPHAN_PAGE"] * 3
    high = [("c1", c, "high" if c == "META_TITLE_MISSING" else catalogue.rule_constants(c)[1]) for c in found]
    rows = spark.createDataFrame(high, "crawl_id string, rule_code string, severity string")
    crawls = spark.createDataFrame([("c1", 10, 1.0), ("c2", 5, 2.0), ("c3", 5, None)], "crawl_id string, pages_crawled int, o double").select(
        "crawl_id", "pages_crawled", F.col("o").cast("decimal(5,2)").alias("overall_score"), F.lit(None).cast("map<string,decimal(5,2)>").alias("category_scores"),
        F.lit(None).cast("map<string,int>").alias("scoring_snapshot"))
    got = {r.crawl_id: r for r in scoring.rescore(crawls, rows).collect()}
    assert float(got["c1"].overall_score) == 84.67 and {k: float(got["c1"].category_scores[k]) for k in ("meta", "indexability", "links", "images")} == {
        "meta": 97, "indexability": 92, "links": 92, "images": 100}
    assert float(got["c2"].overall_score) == 100 and len(got["c2"].category_scores) == 8
    assert got["c3"].overall_score is None and got["c3"].scoring_snapshot is None


def test_hot_keys_are_split_without_losing_rows(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 700, F.lit("hot")).when(F.col("id") < 990, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(5)]], "k string, v int")
    plain = {tuple(r) for r in facts.join(lookup, "k", "left").select("id", "k", "v").collect()}
    spread = spread_lookup(facts, lookup, ["k"], F.col("id"), share=50).select("id", "k", "v").collect()
    assert len(spread) == 1000 and {tuple(r) for r in spread} == plain
    inner = spread_lookup(facts, lookup, ["k"], F.col("id"), "inner", share=50).count()
    assert inner == facts.join(lookup, "k").count()


def test_samples_use_a_group_limit(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")).alias("k"), "id")
    got = {r.k: r.s for r in sample_lists(rows, ["k"], [F.col("id").desc()], F.col("id"), 3, "s").collect()}
    assert got == {"a": [498, 495, 492], "b": [499, 497, 496]}
    plan = first_n(rows, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _graph(spark, parts):
    edges = [("c", str(a), str(b)) for a, b in [(0, 1), (0, 2), (1, 3), (3, 4), (4, 0), (2, 4), (5, 6), (4, 4)]]
    resolved = spark.createDataFrame(edges, "crawl_id string, from_page_id string, to_page_id string").repartition(parts)
    pages = spark.createDataFrame([("c", str(i), i == 0) for i in range(7)], "crawl_id string, page_id string, is_seed boolean")
    return {r.page_id: r.depth for r in links.click_depths(resolved, pages).collect()}


def test_depth_does_not_depend_on_partitions(spark):
    expected = {"0": 0, "1": 1, "2": 1, "3": 2, "4": 2}
    assert _graph(spark, 1) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert _graph(spark, 8) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _plain_depths(edges, seeds):
    reached, front, level = dict.fromkeys(seeds, 0), set(seeds), 0
    while front:
        level += 1
        front = {b for a, b in edges if a in front} - set(reached)
        reached.update(dict.fromkeys(front, level))
    return reached


def test_depths_over_blocks_and_rounds(spark):
    """A chain of 200 pages with links home, shortcuts that cross blocks forwards and back, and a small crawl beside it."""
    rng = random.Random(4)
    big = [(i, i + 1) for i in range(199)] + [(i, 0) for i in range(200)] + [(rng.randrange(200, 400), rng.randrange(400)) for _ in range(300)] + [(199, 399), (399, 390), (390, 200), (3, 3)]
    small = [(0, 1), (1, 2), (2, 0), (7, 8)]
    rows = [("big", a, b) for a, b in big] + [("small", a, b) for a, b in small] + [("big", 5, None)]
    resolved = spark.createDataFrame(rows, "crawl_id string, from_page_id long, to_page_id long")
    pages = spark.createDataFrame([("big", i, f"u{i:04}", i in (0, 250)) for i in range(400)] + [("small", i, f"u{i}", i == 0) for i in range(9)], "crawl_id string, page_id long, url string, is_seed boolean")
    expected = {("big", p): d for p, d in _plain_depths(big, [0, 250]).items()} | {("small", p): d for p, d in _plain_depths(small, [0]).items()}
    for block, most in ((1000, 1), (50, 14), (25, 30)):
        rounds = []
        assert {(r.crawl_id, r.page_id): r.depth for r in links.click_depths(resolved, pages, block, rounds).collect()} == expected
        assert rounds[0] <= most
    none = links.click_depths(resolved, pages.withColumn("is_seed", F.lit(False)), 50)
    assert none.collect() == [] and links.click_depths(resolved.limit(0), pages, 50).count() == 3


def test_rounds_leave_links_in_their_buckets(spark):
    edges = spark.range(100).select((F.col("id") % 9).alias("crawl_id"), F.lit(0).cast("long").alias("block"), F.col("id").alias("page_id"))
    with bucketed(edges, ["crawl_id", "block"], "probe") as stored:
        few = stored.where("page_id < 3").groupBy("crawl_id", "block").agg(F.max("page_id").alias("m"))
        plan = stored.groupBy("crawl_id", "block").cogroup(few.groupBy("crawl_id", "block")).applyInArrow(lambda a, b: a.select(["page_id"]), "page_id long")
        assert plan.count() == 100
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        name = [t.name for t in spark.catalog.listTables() if t.name.startswith("crawlens_probe")]
    assert len(name) == 1 and not spark.catalog.tableExists(name[0])


def test_ranks_are_places_in_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 211).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s")).repartition(7)
    got = ranked(rows, ["k", "s"], "probe").collect()
    assert [(r.k, r.s) for r in sorted(got, key=lambda r: r.rank)] == sorted([(r.k, r.s) for r in got], key=lambda v: (v[0], v[1] is not None, v[1] or "")) and sorted(r.rank for r in got) == list(range(500))
    assert ranked(rows.limit(0), ["k"], "probe").collect() == []


def test_redirects_are_followed_to_their_end(spark):
    rows = [("c", f"p{i}", f"u{i}", f"u{i + 1}" if i < 8 else None) for i in range(9)] + [("c", "x", "ux", "uy"), ("c", "y", "uy", "ux"), ("c", "z", "uz", "uz")]
    pages = spark.createDataFrame(rows, "crawl_id string, page_id string, url string, redirect_to string")
    got = {r.page_id: r.final_id for r in links.redirect_targets(pages).collect()}
    assert all(got[f"p{i}"] == "p8" for i in range(8)) and got["x"] in ("x", "y") and "z" not in got


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_look_ups_split_hot_keys(spark, monkeypatch, most):
    """One key holds nine of ten rows: each operator gives the same by either way, and no task gets that key whole."""
    monkeypatch.setattr(scale, "BROADCAST_BYTES", most)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "16")):
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        facts = spark.range(20_000).select("id", n.cast("string").alias("issue_id"), F.when(n % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), n % 70)).alias("site_id"))
        facts = facts.withColumns({"crawl_id": F.concat("site_id", F.lit("-1")), "page_id": F.concat(F.lit("p"), n % 999), "rule_code": F.lit("H1_MISSING"), "key_url": F.col("issue_id"), "status": F.lit("open")}).drop("id")
        sites = facts.select("site_id", "crawl_id").distinct().withColumn("tenant_id", F.when(F.col("site_id") == "k0", F.lit("other")).otherwise(F.lit("t")))
        mine = issues.tenant_guard(facts, sites, "t")
        assert mine.count() == facts.where("site_id <> 'k0'").count() and mine.columns == facts.columns
        found = scale.lookup(facts, sites.select("crawl_id", "tenant_id"), ["crawl_id"], F.xxhash64("issue_id"), "left")
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 20_000 and max(per_task) < 20_000 / 3
        pairs = spark.createDataFrame([("hot", "hot-1", "hot-0"), ("k7", "k7-1", "k7-1")], "site_id string, current_id string, previous_id string")
        changed = compare.issue_changes(facts, pairs).groupBy("site_id", "change").count().collect()
        assert [tuple(r) for r in changed] == [("hot", "new", 18_000)]
        statuses = crawl_rules.link_statuses(facts.select("crawl_id", F.lit("p1").alias("to_page_id"), F.col("issue_id").alias("from_page_id")), sites.select("crawl_id", F.lit("p1").alias("page_id"), F.lit(404).alias("status_code")))
        assert statuses.where("target_status = 404").count() == 20_000
        profiles = spark.createDataFrame([("b1", "t", None, True, 1), ("b2", "t", "hot", True, 1)], "brand_id string, tenant_id string, site_id string, is_default boolean, created_at int")
        jobs = facts.select(F.col("issue_id").alias("job_id"), "site_id", F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("requested_brand"))
        assert {tuple(r) for r in brands.resolve_brands(jobs, profiles).groupBy("brand_id").count().collect()} == {("b2", 18_000), ("b1", 2_000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_deep_pages_read_their_ranges(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("rank"), F.concat(F.lit("u"), F.col("id") * 31 % 101).alias("url"), F.lit("x" * 50).alias("text")).repartition(6)
    order = [-F.col("rank"), F.col("url")]
    whole = [r.id for r in sorted(rows.collect(), key=lambda r: (-r.rank, r.url, r.id))]
    for page, size in ((1, 40), (2, 40), (25, 40), (26, 40), (13, 77), (1, 5000)):
        got = sorted(issues.page_at(rows, order, ["id"], page, size).collect(), key=lambda r: r.place)
        assert [r.id for r in got] == whole[(page - 1) * size : page * size] and [r.place for r in got] == list(range((page - 1) * size + 1, (page - 1) * size + 1 + len(got)))
    plan = issues.page_at(rows, order, ["id"], 20, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and ("_range#" in plan and (" IN (" in plan or " = " in plan))
    last, seen = None, []
    while page := issues.page_after(rows, [*order, F.col("id")], last, 170).collect():
        last = page[-1]
        seen += [r.id for r in page]
    assert seen == whole and issues.page_at(rows.limit(0), order, ["id"], 3, 40).collect() == []


def test_paging_bounds():
    assert issues.page_bounds(2, 999, None) == (999, 999)
    assert issues.page_bounds(None, None) == (0, 50) and issues.page_bounds(3, 10) == (20, 10)
    assert issues.page_bounds(0, 0) == issues.page_bounds(1, -3) == (0, 50) and issues.page_bounds(2, 999) == (200, 200)


def test_ignore_needs_a_reason(spark):
    base = spark.createDataFrame([(1, "s", "c", "p", "R", "open")], "issue_id long, site_id string, crawl_id string, page_id string, rule_code string, status string")
    pages = spark.createDataFrame([("c", "p", "u")], "crawl_id string, page_id string, url string")
    none = spark.createDataFrame([], "site_id string, rule_code string, url_pattern string, reason string, created_by string, created_at timestamp")
    asked = spark.createDataFrame([(1, "  ", False, "u")], "issue_id long, reason string, apply_to_site boolean, created_by string").withColumn("created_at", F.current_timestamp())
    _, merged = issues.ignore_issues(base, none, asked, pages)
    with pytest.raises(Exception, match="a reason is required"):
        merged.collect()


def test_number_of_blocked_urls_in_its_finding(spark):
    blocked = spark.range(130).select(F.lit("c").alias("crawl_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("id").alias("seq"))
    homes = spark.createDataFrame([("c", "home")], "crawl_id string, page_id string")
    for most, n in ((None, 130), (100, 100), (200, 130)):
        found = crawl_rules.blocked_by_robots(blocked, homes, most).collect()
        assert [(r.found, len(r.sample_urls)) for r in found] == [(f"robots.txt {n} iç adresin taranmasını engelliyor.", 10)]
