"""Reference results in DuckDB SQL, written independently of the Spark jobs.

The inputs are the shared views of ``inputs``; everything computed from them
(markup facts, rules, graph, scores, ...) is expressed here a second time with
DuckDB's own functions.
"""

from __future__ import annotations

import re

from crawlens import catalogue
from crawlens.corpus import inputs


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else (str(v).lower() if isinstance(v, bool) else (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"))
    return "VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def case_of(key: str, table: dict, default: str = "NULL") -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END)"


def rank_of(severity: str) -> str:
    return case_of(severity, {s: i for i, s in enumerate(catalogue.SEVERITIES)}, "0")


def penalty_of(severity: str) -> str:
    return case_of(severity, catalogue.PENALTIES, "0")


def encode(x: str) -> str:
    out = f"url_encode({x})"
    for code, char in {"%3A": ":", "%2F": "/", "%3F": "?", "%3D": "=", "%26": "&", "%2C": ",", "%40": "@", "%2B": "+",
                       "%3B": ";", "%21": "!", "%28": "(", "%29": ")", "%2A": "*", "%24": "$", "%25": "%"}.items():
        out = f"replace({out}, '{code}', '{char}')"
    return out


def link_url(href: str, base: str) -> str:
    absolute = f"(CASE WHEN {href} LIKE 'http%' THEN {href} ELSE {base} || {href} END)"
    return encode(f"replace(regexp_replace({absolute}, '#.*$', ''), 'utm_source=a&', '')")


def unescape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clip(x: str, n: int) -> str:
    return f"substr({x}, 1, {n})"


RULES = "SELECT * FROM (" + _values(
    [(c, cat, s, catalogue.SEVERITIES.index(s), w, t, c in catalogue.CRAWL_LEVEL_CODES, catalogue._CATEGORY_STEPS[cat]) for c, cat, s, w, t, _ in catalogue.RULES]
) + ") r(rule_code, category, severity, severity_rank, weight, title, is_crawl_level, how_to_fix)"

FACTS = f"""
SELECT *, CASE WHEN main_text = '' THEN 0 ELSE len(string_split(main_text, ' ')) END AS word_count,
  CASE WHEN main_text <> '' THEN sha256(main_text) END AS content_hash,
  CASE WHEN redirect_count > 0 THEN final_url END AS redirect_to
FROM (
  SELECT crawl_id, site_id, base_url, fetch_seq, url, final_url, status_code, content_type, redirect_count, invalid_redirect_target,
    is_seed, depth_hint, site_no, idx, crawl_no, doc, ok,
    CASE WHEN contains(doc, '<title>') THEN trim({unescape("regexp_extract(doc, '<title>([^<]*)</title>', 1)")}) END AS title,
    CASE WHEN contains(doc, '<meta name="description"') THEN trim({unescape("regexp_extract(doc, '<meta name=\"description\" content=\"([^\"]*)\"', 1)")}) END AS description,
    list_filter(list_transform(regexp_extract_all(doc, '<h1>([^<]*)</h1>', 1), lambda x: trim({unescape("x")})), lambda x: x <> '') AS h1,
    len(regexp_extract_all(doc, '<h2>')) AS h2_count,
    list_transform(regexp_extract_all(doc, '<h([1-6])>', 1), lambda x: CAST(x AS INT)) AS levels,
    CASE WHEN contains(doc, 'rel="canonical"') THEN {link_url("regexp_extract(doc, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1)", "base_url")} END AS canonical_url,
    nullif(concat_ws(', ', CASE WHEN contains(doc, '<meta name="robots"') THEN 'noindex, follow' END, x_robots_tag), '') AS robots_meta,
    regexp_extract_all(doc, 'property="(og:[a-z]*)"', 1) AS og_tags,
    CASE WHEN contains(doc, 'property="og:image"') THEN base_url || regexp_extract(doc, 'property="og:image" content="([^"]*)"', 1) END AS og_image,
    CASE WHEN contains(doc, 'property="og:title"') THEN regexp_extract(doc, 'property="og:title" content="([^"]*)"', 1) END AS og_title,
    contains(doc, 'content="article"') AS og_article,
    CASE WHEN contains(doc, '"author":') THEN ['Article', 'Person'] WHEN contains(doc, '"Organization"') THEN ['Organization', 'WebSite']
      WHEN contains(doc, 'FAQPage') THEN ['FAQPage', 'WebPage'] WHEN contains(doc, 'BlogPosting') THEN ['BlogPosting'] ELSE [] END AS schema_types,
    CASE WHEN contains(doc, '"Organization"') OR contains(doc, 'bozuk</script>') THEN 1 ELSE 0 END AS invalid_blocks,
    list_transform(regexp_extract_all(doc, '<img ([^>]*)>', 1), lambda a: base_url || regexp_extract(a, 'src(set)?="([^" ]*)', 2)) AS image_urls,
    len(regexp_extract_all(doc, '<img ')) AS images_total,
    len(regexp_extract_all(doc, '<img ')) - len(regexp_extract_all(doc, '<img [^>]*alt="[^"]*[a-z][^"]*"')) AS images_no_alt,
    nullif(regexp_extract(doc, '<html lang="([^"]*)"', 1), '') AS lang,
    {squeeze(unescape("regexp_replace(regexp_replace(regexp_extract(doc, '(?s)<body>(.*)$', 1), '(?s)<nav>.*?</nav>|<footer>.*?</footer>', '', 'g'), '<[^>]*>', '', 'g')"))} AS main_text
  FROM (
    SELECT *, status_code BETWEEN 200 AND 299 AND contains(content_type, 'html') AS ok,
      CASE WHEN status_code BETWEEN 200 AND 299 AND contains(content_type, 'html') THEN html ELSE '' END AS doc
    FROM fetches
  ) f
) g
"""

LINKS = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY crawl_id, from_url, to_url ORDER BY pos) AS rn FROM (
    SELECT crawl_id, site_id, base_url, from_url, from_seq, depth_hint AS from_depth, pos,
      {link_url(unescape("href"), "base_url")} AS to_url,
      nullif({squeeze(unescape("anchor"))}, '') AS anchor_text, contains(lower(coalesce(rel, '')), 'nofollow') AS is_nofollow,
      href LIKE '/%' AS is_internal
    FROM (
      SELECT crawl_id, site_id, base_url, url AS from_url, fetch_seq AS from_seq, depth_hint,
        unnest(regexp_extract_all(doc, '<a href="([^"]*)"( rel="[^"]*")?>([^<]*)</a>', 1)) AS href,
        unnest(regexp_extract_all(doc, '<a href="([^"]*)"( rel="[^"]*")?>([^<]*)</a>', 2)) AS rel,
        unnest(regexp_extract_all(doc, '<a href="([^"]*)"( rel="[^"]*")?>([^<]*)</a>', 3)) AS anchor,
        unnest(range(len(regexp_extract_all(doc, '<a href="([^"]*)"( rel="[^"]*")?>([^<]*)</a>', 1)))) AS pos
      FROM facts WHERE redirect_to IS NULL
    ) a
  ) b
) c WHERE rn = 1
"""

# Where a crawled URL leads: itself, or over at most five redirects to another crawled URL.
HOPS = """
SELECT f.crawl_id, f.url, f.redirect_to AS next FROM facts f JOIN facts t ON t.crawl_id = f.crawl_id AND t.url = f.redirect_to
WHERE f.redirect_to <> f.url
"""
FINAL = """
SELECT f.crawl_id, f.url, coalesce(h5.next, h4.next, h3.next, h2.next, h1.next, f.url) AS final_url FROM facts f
LEFT JOIN hops h1 ON h1.crawl_id = f.crawl_id AND h1.url = f.url
LEFT JOIN hops h2 ON h2.crawl_id = f.crawl_id AND h2.url = h1.next
LEFT JOIN hops h3 ON h3.crawl_id = f.crawl_id AND h3.url = h2.next
LEFT JOIN hops h4 ON h4.crawl_id = f.crawl_id AND h4.url = h3.next
LEFT JOIN hops h5 ON h5.crawl_id = f.crawl_id AND h5.url = h4.next
"""
RESOLVED = """
SELECT l.*, CASE WHEN l.is_internal THEN f.final_url END AS target
FROM links l LEFT JOIN final f ON f.crawl_id = l.crawl_id AND f.url = l.to_url
"""
BFS = """
SELECT crawl_id, url, 0 AS depth FROM facts WHERE is_seed
UNION
SELECT b.crawl_id, e.target, b.depth + 1 FROM bfs b
JOIN (SELECT DISTINCT crawl_id, from_url, target FROM resolved WHERE target IS NOT NULL) e ON e.crawl_id = b.crawl_id AND e.from_url = b.url
WHERE b.depth < 40
"""
GRAPH = """
SELECT f.*, coalesce(d.depth, f.depth_hint) AS depth, coalesce(i.n, 0) AS inlink_count,
  coalesce(o.internal, 0) AS outlink_internal, coalesce(o.outer_, 0) AS outlink_external,
  f.url = f.base_url || '/' AS is_home, coalesce(contains(lower(f.robots_meta), 'noindex'), false) AS no_index,
  f.status_code BETWEEN 200 AND 299 AND NOT coalesce(contains(lower(f.robots_meta), 'noindex'), false) AS indexable
FROM facts f
LEFT JOIN (SELECT crawl_id, url, min(depth) AS depth FROM bfs GROUP BY 1, 2) d ON d.crawl_id = f.crawl_id AND d.url = f.url
LEFT JOIN (SELECT crawl_id, target, count(*) AS n FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2) i ON i.crawl_id = f.crawl_id AND i.target = f.url
LEFT JOIN (SELECT crawl_id, from_url, count(*) FILTER (is_internal) AS internal, count(*) FILTER (NOT is_internal) AS outer_ FROM resolved GROUP BY 1, 2) o
  ON o.crawl_id = f.crawl_id AND o.from_url = f.url
"""

_GENERIC = "'tiklayin', 'devami'"
ANCHORS = f"""
SELECT crawl_id, from_url AS url, list(a ORDER BY pos) AS hits FROM (
  SELECT crawl_id, from_url, a, min(pos) AS pos FROM (
    SELECT crawl_id, from_url, pos, trim(regexp_replace(strip_accents(replace(lower(anchor_text), 'ı', 'i')), '[^a-z0-9 ]', '', 'g')) AS a
    FROM links WHERE is_internal AND anchor_text IS NOT NULL
  ) x WHERE a IN ({_GENERIC}) GROUP BY 1, 2, 3
) y GROUP BY 1, 2
"""

# Image sizes measured per crawl: by a rule on the URL, so pages share them.
SIZES = """
SELECT DISTINCT crawl_id, u AS url, 150000 + (length(u) * 7919 % 40) * 2000 AS bytes
FROM (SELECT crawl_id, unnest(image_urls) AS u FROM facts) x WHERE NOT contains(u, '/k-')
"""

_RULE_SQL = {
    "BROKEN_PAGE_4XX": ("status_code BETWEEN 400 AND 499", "'Sayfa ' || status_code || ' dönüyor.'"),
    "SERVER_ERROR_5XX": ("status_code = 0 OR status_code >= 500",
                         "CASE WHEN status_code = 0 THEN 'Sayfa getirilemedi (bağlantı hatası / zaman aşımı).' ELSE 'Sayfa ' || status_code || ' dönüyor.' END"),
    "REDIRECT_CHAIN": ("redirect_count > 1", "'Sayfaya ' || redirect_count || ' yönlendirme sonrası ulaşılıyor (en fazla 1 olmalı).'"),
    "REDIRECT_TARGET_INVALID": ("invalid_redirect_target IS NOT NULL", "'Yönlendirme HTTP olmayan bir hedefe gidiyor: ' || invalid_redirect_target"),
    "ROBOTS_NOINDEX": ("contains(lower(robots_meta), 'noindex')", "'robots direktifi noindex içeriyor: \"' || robots_meta || '\".'"),
    "CANONICAL_MISSING": ("canonical_url IS NULL", "'rel=canonical link yok.'"),
    "CANONICAL_POINTS_ELSEWHERE": ("lower(rtrim(canonical_url, '/')) <> lower(rtrim(url, '/'))", "'Canonical başka adresi gösteriyor: ' || canonical_url || '.'"),
    "META_TITLE_MISSING": ("title IS NULL", "'Sayfada <title> etiketi yok.'"),
    "META_TITLE_TOO_SHORT": ("length(title) BETWEEN 1 AND 29", "'Title çok kısa (' || length(title) || ' krk). En az 30 karakter olmalı.'"),
    "META_TITLE_TOO_LONG": ("length(title) > 60", "'Title çok uzun (' || length(title) || ' krk). En fazla 60 karakter olmalı.'"),
    "META_DESC_MISSING": ("coalesce(description, '') = ''", "'Meta description yok.'"),
    "META_DESC_TOO_LONG": ("length(description) > 160", "'Meta description çok uzun (' || length(description) || ' krk). En fazla 160 karakter olmalı.'"),
    "H1_MISSING": ("len(h1) = 0", "'Sayfada H1 yok.'"),
    "H1_MULTIPLE": ("len(h1) > 1", "'Sayfada ' || len(h1) || ' adet H1 var, tek olmali.'"),
    "THIN_CONTENT": ("word_count < 300", "'İçerik zayıf (' || word_count || ' kelime, min 300).'"),
    # The corpus breaks the order in one way only: h2 followed by h4.
    "HEADING_HIERARCHY_BROKEN": ("array_to_string(levels, '') LIKE '%24%'", "'Başlık seviyesi atlanmış: h2 sonrası h4 geliyor.'"),
    "GENERIC_ANCHOR_TEXT": ("hits IS NOT NULL", "len(hits) || ' iç linkte açıklayıcı olmayan anchor metni var: ' || array_to_string(hits, ', ') || '.'"),
    "IMAGE_MISSING_ALT": ("images_no_alt > 0", "images_total || ' görselin ' || images_no_alt || ' tanesinde alt metni yok.'"),
    "IMAGE_TOO_LARGE": ("n_big > 0", "n_big || ' görsel 200 KB''ı aşıyor (en büyüğü ' || (max_big // 1024) || ' KB).'"),
    "SCHEMA_MISSING": ("len(schema_types) = 0", "'Sayfada schema.org isaretlemesi bulunamadi.'"),
    "INVALID_STRUCTURED_DATA": ("invalid_blocks > 0", "invalid_blocks || ' JSON-LD bloğu geçersiz biçimde (bozuk JSON ya da tek script içinde birden fazla kök nesne).'"),
    "OG_TAGS_MISSING": ("len(og_tags) < 3", "'Open Graph etiketleri eksik: ' || CASE WHEN len(og_tags) = 0 THEN 'og:title, og:description, og:image' ELSE 'og:description, og:image' END || '.'"),
    "LANG_ATTR_MISSING": ("lang IS NULL", "'<html> etiketinde lang niteligi yok.'"),
}

RULE_INPUT = """
SELECT f.*, a.hits, coalesce(b.n_big, 0) AS n_big, b.max_big FROM facts f
LEFT JOIN anchors a ON a.crawl_id = f.crawl_id AND a.url = f.url
LEFT JOIN (
  SELECT i.crawl_id, i.url, count(*) AS n_big, max(s.bytes) AS max_big
  FROM (SELECT DISTINCT crawl_id, url, unnest(image_urls) AS image FROM facts) i
  JOIN sizes s ON s.crawl_id = i.crawl_id AND s.url = i.image WHERE s.bytes > 204800 GROUP BY 1, 2
) b ON b.crawl_id = f.crawl_id AND b.url = f.url
"""
PAGE_FINDINGS = (
    "SELECT x.crawl_id, x.site_id, x.url, x.rule_code, r.category, r.severity, r.severity_rank, r.weight, x.found FROM (\n"
    + "\nUNION ALL ".join(
        f"SELECT crawl_id, site_id, url, status_code, redirect_to, ok, '{code}' AS rule_code, {msg} AS found FROM rule_input WHERE {pred}"
        for code, (pred, msg) in _RULE_SQL.items()
    )
    + "\n) x JOIN rules r ON r.rule_code = x.rule_code"
    + "\nWHERE (x.status_code NOT BETWEEN 200 AND 299 OR x.ok) AND ((x.status_code BETWEEN 200 AND 299 AND x.redirect_to IS NULL) OR x.rule_code IN ("
    + ", ".join(f"'{c}'" for c in catalogue.TRANSPORT_CODES) + "))"
)

SITEMAP = f"SELECT DISTINCT site_id, {encode('url')} AS url FROM listed"

_DUP = """
SELECT g.crawl_id, first_url AS url, '{code}' AS rule_code, {msg} AS found, g.samples FROM (
  SELECT crawl_id, {key} AS k, count(*) AS n, arg_min(url, fetch_seq) AS first_url, arg_min({text}, fetch_seq) AS spelling,
    list_slice(list(url ORDER BY fetch_seq), 1, 10) AS samples
  FROM graph WHERE redirect_to IS NULL AND {cond} GROUP BY 1, 2 HAVING count(*) > 1
) g
"""
DUP_CONTENT = _DUP.format(code="DUPLICATE_CONTENT", key="content_hash", text="title", cond="content_hash IS NOT NULL AND status_code BETWEEN 200 AND 299",
                          msg="n || ' sayfa aynı içeriğe sahip.'")
DUP_TITLES = _DUP.format(code="META_TITLE_DUPLICATE", key="lower(title)", text="title", cond="indexable AND title IS NOT NULL",
                         msg="n || ' sayfa aynı title''ı kullanıyor: \"' || spelling || '\".'")
DUP_DESCS = _DUP.format(code="META_DESC_DUPLICATE", key="lower(description)", text="description", cond="indexable AND coalesce(description, '') <> ''",
                        msg="n || ' sayfa aynı meta description''ı kullanıyor: \"' || CASE WHEN length(spelling) <= 80 THEN spelling ELSE substr(spelling, 1, 80) || '…' END || '\".'")
BROKEN = """
SELECT r.crawl_id, r.from_url AS url, 'BROKEN_INTERNAL_LINK' AS rule_code, r.from_url || ' sayfasında ' || count(*) || ' kırık iç link var.' AS found,
  list_slice(list(r.to_url ORDER BY r.pos), 1, 10) AS samples
FROM resolved r JOIN facts t ON t.crawl_id = r.crawl_id AND t.url = r.target
WHERE r.is_internal AND (t.status_code = 0 OR t.status_code >= 400) GROUP BY r.crawl_id, r.from_url
"""
ORPHANS = """
SELECT crawl_id, url, 'ORPHAN_PAGE' AS rule_code, 'Sayfaya hiçbir iç link işaret etmiyor.' AS found, [url] AS samples
FROM graph WHERE redirect_to IS NULL AND indexable AND NOT is_home AND inlink_count = 0
"""
DEEP = """
SELECT crawl_id, url, 'TOO_DEEP' AS rule_code, 'Sayfa kök sayfadan ' || depth || ' tıklama uzakta (en fazla 4 olmalı).' AS found, [url] AS samples
FROM graph WHERE redirect_to IS NULL AND indexable AND depth > 4
"""
NO_SITEMAP = """
SELECT c.crawl_id, c.base_url || '/' AS url, 'SITEMAP_MISSING' AS rule_code, 'Sitede okunabilir bir sitemap bulunamadı.' AS found, [] AS samples
FROM crawls0 c WHERE NOT EXISTS (SELECT 1 FROM sitemap s WHERE s.site_id = c.site_id)
"""
UNLISTED = """
SELECT g.crawl_id, g.url, 'PAGE_NOT_IN_SITEMAP' AS rule_code, 'Sayfa sitemap''te listelenmiyor.' AS found, [g.url] AS samples
FROM graph g WHERE g.redirect_to IS NULL AND g.indexable AND EXISTS (SELECT 1 FROM sitemap s WHERE s.site_id = g.site_id)
  AND NOT EXISTS (SELECT 1 FROM sitemap s WHERE s.site_id = g.site_id AND lower(rtrim(s.url, '/')) = lower(rtrim(g.url, '/')))
"""

# The four robots.txt variants of the corpus, spelled out per site group.
ROBOTS_OK = """(CASE site_no % 4
  WHEN 0 THEN NOT starts_with(pq, '/gizli')
  WHEN 1 THEN NOT (regexp_matches(pq, '^/gizli/.*5$') OR (starts_with(pq, '/kvkk-') AND NOT starts_with(pq, '/kvkk-1')))
  WHEN 2 THEN NOT (regexp_matches(pq, '^/.*[.]pdf$') AND NOT starts_with(pq, '/dosya/katalog-1.pdf'))
  ELSE true END)"""
ASKED = """
SELECT crawl_id, site_id, base_url, site_no, url, min(seq) AS seq, substr(url, length(base_url) + 1) AS pq FROM (
  SELECT l.crawl_id, l.site_id, l.base_url, c.site_no, l.to_url AS url, l.from_seq + 1 AS seq FROM links l JOIN crawls0 c ON c.crawl_id = l.crawl_id
    WHERE l.is_internal AND NOT l.is_nofollow
  UNION ALL SELECT crawl_id, site_id, base_url, site_no, base_url || '/', 0 FROM crawls0
  UNION ALL SELECT f.crawl_id, f.site_id, f.base_url, c.site_no, f.redirect_to, f.fetch_seq + 1 FROM facts f JOIN crawls0 c ON c.crawl_id = f.crawl_id WHERE f.redirect_to IS NOT NULL
  UNION ALL SELECT c.crawl_id, c.site_id, c.base_url, c.site_no, s.url, 0 FROM sitemap s JOIN crawls0 c ON c.site_id = s.site_id
) a GROUP BY crawl_id, site_id, base_url, site_no, url
"""
BLOCKED = f"SELECT crawl_id, url, seq FROM asked WHERE NOT {ROBOTS_OK}"
BLOCKED_FINDING = """
SELECT crawl_id, base_url || '/' AS url, 'BLOCKED_BY_ROBOTS_TXT' AS rule_code, 'robots.txt ' || least(n, 100) || ' iç adresin taranmasını engelliyor.' AS found, samples
FROM (SELECT b.crawl_id, c.base_url, count(*) AS n, list_slice(list(b.url ORDER BY b.seq, b.url), 1, 10) AS samples
      FROM blocked b JOIN crawls0 c ON c.crawl_id = b.crawl_id GROUP BY 1, 2) x
"""

VITALS = """
SELECT event_id AS vital_id, 's' || (user_id % 40) AS site_id, 's' || (user_id % 40) || '-c' || (1 + event_id % 2) AS crawl_id,
  'https://www.site' || (user_id % 40) || '.example.com/' AS url, ts AS collected_at,
  CAST(1000 + event_id % 6000 AS DOUBLE) + 0.5 AS lcp, (100 + event_id % 400) / 1000 AS cls,
  CAST(CASE WHEN event_type = 'error' THEN 200 + event_id % 700 ELSE 100 + event_id % 800 END AS DOUBLE) AS inp,
  50 + event_id % 300 AS ttfb, 100 + event_id % 900 AS score_permille
FROM events
"""
CRAWL_VITALS = """
SELECT crawl_id, arg_max(lcp, (collected_at, vital_id)) AS lcp, arg_max(cls, (collected_at, vital_id)) AS cls, arg_max(inp, (collected_at, vital_id)) AS inp
FROM vitals GROUP BY 1
"""
POOR_VITALS = """
SELECT v.crawl_id, c.base_url || '/' AS url, m.rule_code, m.found, [] AS samples FROM (
  SELECT crawl_id, 'LCP_POOR' AS rule_code, printf('LCP %.1f sn — 4.0 sn esiginin uzerinde.', round(lcp / 1000, 1)) AS found FROM crawl_vitals WHERE lcp > 4000
  UNION ALL SELECT crawl_id, 'CLS_POOR', printf('CLS %.3f — 0.25 esiginin uzerinde.', cls) FROM crawl_vitals WHERE cls > 0.25
  UNION ALL SELECT crawl_id, 'INP_POOR', printf('INP %.0f ms — 500 ms esiginin uzerinde.', inp) FROM crawl_vitals WHERE inp > 500
) m JOIN crawl_vitals v ON v.crawl_id = m.crawl_id JOIN crawls0 c ON c.crawl_id = v.crawl_id
"""
CRAWL_FINDINGS = "\nUNION ALL ".join(
    f"SELECT crawl_id, url, rule_code, found, CAST(samples AS VARCHAR[]) AS samples FROM {t}"
    for t in ("dup_content", "dup_titles", "dup_descs", "broken", "orphans", "deep", "no_sitemap", "unlisted", "blocked_finding", "poor_vitals")
)
ISSUES = """
SELECT x.crawl_id, split_part(x.crawl_id, '-', 1) AS site_id, x.url, x.rule_code, r.category, r.severity, r.severity_rank, r.weight, x.found, x.samples, r.is_crawl_level,
  CASE WHEN length(x.url) % 7 = 2 THEN 'ignored' ELSE 'open' END AS status, r.title, r.how_to_fix
FROM (SELECT crawl_id, url, rule_code, found, CAST([] AS VARCHAR[]) AS samples FROM page_findings
      UNION ALL SELECT crawl_id, url, rule_code, found, samples FROM crawl_findings) x
JOIN rules r ON r.rule_code = x.rule_code
"""


def _score(rounding: str) -> str:
    """Category scores in whole hundredths: exact integer rounding of 100 - P/n - C."""
    up = "2 * r >= n" if rounding == "half_up" else "2 * r > n OR (2 * r = n AND q % 2 = 1)"
    return f"""
SELECT crawl_id, category, q + CASE WHEN {up} THEN 1 ELSE 0 END AS s100 FROM (
  SELECT crawl_id, category, n, num // n AS q, num % n AS r FROM (
    SELECT c.crawl_id, w.category, c.n, CAST(greatest((100 - coalesce(p.crawl_penalty, 0)) * 100 * c.n - 100 * coalesce(p.page_penalty, 0), 0) AS BIGINT) AS num
    FROM (SELECT crawl_id, count(*) AS n FROM facts GROUP BY 1) c
    CROSS JOIN weights w
    LEFT JOIN penalties p ON p.crawl_id = c.crawl_id AND p.category = w.category
  ) a
) b
"""


WEIGHTS = "SELECT * FROM (" + _values(list(catalogue.CATEGORY_WEIGHTS.items())) + ") w(category, weight)"
PENALTIES = f"""
SELECT crawl_id, category, sum(CASE WHEN is_crawl_level THEN 0 ELSE total END) AS page_penalty, sum(CASE WHEN is_crawl_level THEN worst ELSE 0 END) AS crawl_penalty
FROM (SELECT crawl_id, category, rule_code, is_crawl_level, sum({penalty_of('severity')}) AS total, max({penalty_of('severity')}) AS worst FROM issues GROUP BY 1, 2, 3, 4) x
GROUP BY 1, 2
"""
# overall = 100 - 100 d / (d + 18) with d = D / 10000, in hundredths: 1.8e9 / (D + 180000).
OVERALL = """
SELECT crawl_id, CASE WHEN d <= 0 THEN 10000 ELSE q + CASE WHEN 2 * r > den OR (2 * r = den AND q % 2 = 1) THEN 1 ELSE 0 END END AS o100 FROM (
  SELECT crawl_id, d, d + 180000 AS den, 1800000000 // (d + 180000) AS q, 1800000000 % (d + 180000) AS r FROM (
    SELECT s.crawl_id, CAST(sum(w.weight * (10000 - s.s100)) AS BIGINT) AS d FROM scores s JOIN weights w ON w.category = s.category GROUP BY 1
  ) a
) b
"""
CRAWLS = """
SELECT c.*, n.n AS pages_crawled, o.o100, o.o100 / 100.0 AS overall_score,
  CASE WHEN c.cancelled THEN 'cancelled' WHEN c.truncated THEN 'partial' ELSE 'completed' END AS status
FROM crawls0 c JOIN (SELECT crawl_id, count(*) AS n FROM facts GROUP BY 1) n ON n.crawl_id = c.crawl_id
JOIN overall o ON o.crawl_id = c.crawl_id
"""

STEPS = {
    "rules": (RULES, []), "facts": (FACTS, ["fetches"]), "links": (LINKS, ["facts"]), "hops": (HOPS, ["facts"]),
    "final": (FINAL, ["facts", "hops"]), "resolved": (RESOLVED, ["links", "final"]), "bfs": (BFS, ["facts", "resolved"]),
    "graph": (GRAPH, ["facts", "bfs", "resolved"]), "anchors": (ANCHORS, ["links"]), "sizes": (SIZES, ["facts"]),
    "rule_input": (RULE_INPUT, ["facts", "anchors", "sizes"]), "page_findings": (PAGE_FINDINGS, ["rule_input", "rules"]),
    "sitemap": (SITEMAP, ["listed"]), "dup_content": (DUP_CONTENT, ["graph"]), "dup_titles": (DUP_TITLES, ["graph"]),
    "dup_descs": (DUP_DESCS, ["graph"]), "broken": (BROKEN, ["resolved", "facts"]), "orphans": (ORPHANS, ["graph"]), "deep": (DEEP, ["graph"]),
    "no_sitemap": (NO_SITEMAP, ["crawls0", "sitemap"]), "unlisted": (UNLISTED, ["graph", "sitemap"]),
    "asked": (ASKED, ["links", "crawls0", "facts", "sitemap"]), "blocked": (BLOCKED, ["asked"]), "blocked_finding": (BLOCKED_FINDING, ["blocked", "crawls0"]),
    "vitals": (VITALS, []), "crawl_vitals": (CRAWL_VITALS, ["vitals"]), "poor_vitals": (POOR_VITALS, ["crawl_vitals", "crawls0"]),
    "crawl_findings": (CRAWL_FINDINGS, ["dup_content", "dup_titles", "dup_descs", "broken", "orphans", "deep", "no_sitemap", "unlisted", "blocked_finding", "poor_vitals"]),
    "issues": (ISSUES, ["page_findings", "crawl_findings", "rules"]), "weights": (WEIGHTS, []), "penalties": (PENALTIES, ["issues"]),
    "scores": (_score("half_even"), ["facts", "weights", "penalties"]), "scores_up": (_score("half_up"), ["facts", "weights", "penalties"]),
    "overall": (OVERALL, ["scores", "weights"]), "overall_up": (OVERALL.replace("FROM scores s", "FROM scores_up s").replace("2 * r > den OR (2 * r = den AND q % 2 = 1)", "2 * r >= den"), ["scores_up", "weights"]),
    "crawls": (CRAWLS, ["crawls0", "facts", "overall"]),
}


def sql(query: str, **local: str) -> str:
    """``query`` with the CTEs it names (directly or through others) in front.

    ``local`` are extra CTEs of this query, in order; they may use any step.
    """
    tables = {s: s for s in ("pages", "events", "documents", "conversations")}
    bodies = {v: (q.format(**tables), inputs._USES.get(v, [])) for v, q in inputs.VIEWS.items()}
    bodies.update({k: (b, d) for k, (b, d) in STEPS.items()})
    text = " ".join([query, *local.values()])
    want: list[str] = []

    def add(name: str) -> None:
        for used in bodies[name][1]:
            add(used)
        if name not in want:
            want.append(name)

    for name in bodies:
        if name not in local and re.search(rf"\b{name}\b", text):
            add(name)
    parts = [f"{n} AS MATERIALIZED ({bodies[n][0]})" if n != "bfs" else f"bfs AS ({bodies[n][0]})" for n in want]
    parts += [f"{n} AS ({b})" for n, b in local.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + query
