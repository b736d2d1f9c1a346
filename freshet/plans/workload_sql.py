"""The same results in plain SQL over the test tables, as DuckDB runs it; see ``workload.py`` for what each means."""

from __future__ import annotations

from freshet.functions.urls import TRACKING_PARAMS
from freshet.operators import reader, report
from freshet.operators.extract import DEFAULT_EXCLUDES, NO_LINKS, SKIP_SUFFIXES

_SUFFIXES = "|".join(SKIP_SUFFIXES)
_EXCLUDED = "|".join(DEFAULT_EXCLUDES)
_NO_LINKS = NO_LINKS
_TRACKING = ", ".join(f"'{name}'" for name in TRACKING_PARAMS)

# Pages as runs, and the anchors of each with their order. Every href of these pages is a rooted path.
_PAGE = r"""
page AS (
  SELECT page_id, url AS page_url, html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
         lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS run_ts
  FROM pages)"""
_ANCHOR = (
    _PAGE
    + r""",
anchor AS (
  SELECT page_id, site_id, run_ts, scheme, page_url,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title,
         unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos
  FROM page)"""
)


def _links(where: str = "TRUE") -> str:
    return (
        _ANCHOR
        + f""",
link AS (
  SELECT site_id, page_id, run_ts, scheme || '://' || site_id || href AS url, min(pos)::INTEGER AS pos,
         coalesce(arg_min(title, pos) FILTER (title <> ''), '') AS title
  FROM anchor
  WHERE href <> '/' AND NOT regexp_matches(lower(href), '\\.({_SUFFIXES})$')
    AND NOT regexp_matches(href, '(?i){_EXCLUDED}')
    AND ({where})
  GROUP BY ALL)"""
    )


_URL = "(scheme || '://' || site_id || href)"
_INCLUDE = f"contains({_URL}, '/th') OR contains({_URL}, '/e')"


def _replayed(where: str = "TRUE", max_items: int = 50) -> str:
    """Closed form of the whole history; no site outgrows its limit on these pages."""
    return (
        _links(where)
        + f""",
seed AS (SELECT site_id, min(run_ts) AS seed_ts, max(run_ts) AS last_ok FROM link GROUP BY site_id),
sighting AS (
  SELECT site_id, url, min(run_ts) AS first_seen, arg_min(pos, run_ts) AS pos, arg_min(title, run_ts) AS first_title,
         coalesce(arg_min(title, run_ts) FILTER (title <> ''), '') AS title
  FROM link GROUP BY site_id, url),
fresh AS (
  SELECT s.site_id, url, first_title AS title, pos, first_seen
  FROM sighting s JOIN seed USING (site_id) WHERE first_seen > seed_ts),
recent AS (
  SELECT * FROM (
    SELECT site_id, url, title, first_seen,
           (row_number() OVER (PARTITION BY site_id ORDER BY first_seen DESC, pos) - 1)::INTEGER AS ord
    FROM fresh) WHERE ord < {max_items}),
outcome AS (
  SELECT p.site_id, p.run_ts, coalesce(n, 0)::INTEGER AS link_count, CASE WHEN n IS NULL THEN '{_NO_LINKS}' END AS error
  FROM page p LEFT JOIN (SELECT page_id, count(*) AS n FROM link GROUP BY page_id) c USING (page_id)),
site AS (
  SELECT o.site_id, max(last_ok) IS NOT NULL AS seeded, any_value(seed_ts) AS first_checked, max(run_ts) AS last_checked,
         any_value(updated) AS last_update,
         CASE WHEN max(run_ts) = any_value(last_ok) THEN 'ok' ELSE 'error' END AS last_status,
         CASE WHEN max(run_ts) = any_value(last_ok) THEN NULL ELSE '{_NO_LINKS}' END AS last_error,
         count(*) FILTER (last_ok IS NULL OR run_ts > last_ok)::INTEGER AS consecutive_errors
  FROM outcome o LEFT JOIN seed USING (site_id)
       LEFT JOIN (SELECT site_id, max(first_seen) AS updated FROM fresh GROUP BY site_id) u USING (site_id)
  GROUP BY o.site_id),
result AS (
  SELECT s.site_id, s.last_checked AS run_ts, s.last_status AS status, s.last_error AS error,
         (SELECT max(link_count) FROM outcome o WHERE o.site_id = s.site_id AND o.run_ts = s.last_checked)::INTEGER AS link_count,
         (SELECT count(*) FROM fresh f WHERE f.site_id = s.site_id AND f.first_seen = s.last_checked)::INTEGER AS new_count,
         coalesce(s.last_checked = s.first_checked, FALSE) AS seeded_now
  FROM site s),
listed AS (SELECT site_id, min(page_id) AS ord FROM page GROUP BY site_id),
timeline AS (
  SELECT r.*, r.site_id AS site_name FROM recent r JOIN listed l USING (site_id)
  ORDER BY first_seen DESC, l.ord, r.ord LIMIT 300),
reads AS (SELECT url, max(first_seen) AS read_at FROM sighting WHERE length(url) % 3 = 0 GROUP BY url),
unread AS (SELECT site_id, count(*) AS unread FROM recent WHERE url NOT IN (SELECT url FROM reads) GROUP BY site_id)"""
    )


def _ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column.split('.')[-1]}"


_NEW = f"site_id, url, title, pos, {_ts('first_seen')}"
_KNOWN = f"site_id, url, title, {_ts('first_seen')}, pos::BIGINT AS seq"
_SITE = (
    f"site_id, seeded, {_ts('first_checked')}, {_ts('last_checked')}, {_ts('last_update')}, "
    "last_status, last_error, consecutive_errors"
)
_MIDDLE = "(SELECT to_timestamp((epoch(max(run_ts)) + epoch(min(run_ts))) / 2) AT TIME ZONE 'UTC' FROM page)"
_COM = "site_id LIKE '%.com'"

_RAW = r"""
raw AS (
  SELECT page_id AS ord, page_id AS i,
    CASE WHEN i % 11 <> 0 THEN url WHEN i % 22 = 11 THEN 'ftp://x.example/' END AS url,
    CASE WHEN i % 3 = 0 THEN 'Page No. ' || (i % 40) END AS given_name,
    CASE WHEN i % 2 = 0 THEN 'p-' || i END AS given_id
  FROM (SELECT page_id, page_id AS i, url FROM pages)),
entry AS (
  SELECT *, coalesce(given_name, url, '') AS name,
    coalesce(given_id,
             nullif(trim(regexp_replace(lower(coalesce(given_name, url, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''),
             'site') AS site_id
  FROM raw)"""

_EVENT_URL = "'https://read.example/' || event_type || '/' || floor(value)::BIGINT"

ORACLE: dict[str, str] = {
    "page_links": f"WITH {_links()} SELECT site_id, {_ts('run_ts')}, pos, url, title FROM link",
    "page_outcomes": f"WITH {_replayed()} SELECT site_id, {_ts('run_ts')}, link_count, error FROM outcome",
    "page_links_default_nav": f"""
WITH outside AS (
  SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g'), '<a href=')) AS n FROM pages)
SELECT CASE WHEN n = 0 THEN '{_NO_LINKS}' END AS error, count(*) AS pages, sum(n)::BIGINT AS links FROM outside GROUP BY 1""",
    "page_links_filtered": f"""
WITH {_links(f"(contains({_URL}, '/t') OR contains({_URL}, '/a') OR contains({_URL}, '/e')) AND NOT contains({_URL}, 'tion') AND NOT contains({_URL}, '.org/') AND length(title) >= 4")}
SELECT site_id, {_ts("run_ts")}, pos, url, title FROM link""",
    "page_links_selector": f"""
WITH {_links()}, counted AS (
  SELECT p.site_id, p.run_ts, CASE WHEN p.site_id LIKE '%.net' THEN 0 ELSE count(l.url) END AS n
  FROM page p LEFT JOIN link l USING (page_id) WHERE p.site_id NOT LIKE '%.org' GROUP BY p.page_id, p.site_id, p.run_ts)
SELECT site_id, {_ts("run_ts")}, n::INTEGER AS link_count, CASE WHEN n = 0 THEN '{_NO_LINKS}' END AS error FROM counted""",
    "canonical_urls": rf"""
WITH part AS (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query
  FROM pages), cleaned AS (
  SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
    AND split_part(lower(x), '=', 1) NOT IN ({_TRACKING})), '&') AS q
  FROM part)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url
FROM cleaned""",
    "joined_urls": r"""
SELECT page_id,
  regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || 'x' || path || '?k=1' AS joined_url
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
    "same_site_hosts": r"""
WITH host AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages),
base AS (SELECT h, regexp_replace(h, '^www\.', '') AS b FROM host)
SELECT p.h AS page_host, l.h AS link_host FROM base p, base l WHERE l.b = p.b OR ends_with(l.h, '.' || p.b)""",
    "link_path_prefixes": f"""
WITH {_links()}, split AS (
  SELECT *, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM link),
prefixed AS (
  SELECT *, '/' || array_to_string((CASE WHEN contains(seg[-1], '.') THEN seg[:-2] ELSE seg END)[:2], '/') AS prefix FROM split),
counted AS (SELECT site_id, prefix, count(*) AS n, min((run_ts, pos)) AS met FROM prefixed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, met)::INTEGER AS rank FROM counted)
SELECT site_id, prefix, n, rank FROM ranked WHERE rank <= 10""",
    "page_path_prefixes": f"""
WITH {_PAGE}, split AS (
  SELECT *, list_filter(string_split(regexp_extract(page_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM page),
prefixed AS (
  SELECT *, '/' || array_to_string((CASE WHEN contains(coalesce(seg[-1], ''), '.') THEN seg[:-2] ELSE seg END)[:2], '/') AS prefix FROM split),
counted AS (SELECT site_id, prefix, count(*) AS n, min(run_ts) AS met FROM prefixed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, met)::INTEGER AS rank FROM counted)
SELECT site_id, prefix, n, rank FROM ranked WHERE rank <= 10""",
    "inspected_links": f"""
WITH {_links()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INTEGER AS rank FROM link)
SELECT site_id, {_ts("run_ts")}, rank, CASE WHEN title = '' THEN '(タイトルなし)' ELSE left(title, 70) END AS title, url FROM ranked WHERE rank <= 3""",
    "charset_hints": "SELECT doc_id, nullif(lang, '') AS hint FROM documents",
    "fetch_resolution": r"""
WITH tried AS (
  SELECT user_id::VARCHAR AS site_id, date_trunc('day', ts) AS run_ts,
    row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) - 1 AS attempt,
    CASE WHEN event_type = 'error' AND value >= 10 AND value < 25 THEN 503 WHEN value > 30 AND event_type <> 'error' THEN 404
         WHEN event_type = 'error' AND value > 30 THEN 404 ELSE 200 END AS http_status,
    CASE WHEN event_type = 'error' AND value < 10 THEN 'Timeout' WHEN event_type = 'error' AND value >= 25 THEN 'ConnectionError' END AS failure
  FROM events),
allowed AS (SELECT *, failure IS NOT NULL OR http_status = 503 AS again FROM tried WHERE attempt <= 2),
judged AS (
  SELECT *, CASE WHEN failure = 'Timeout' THEN 'タイムアウト（20秒）' WHEN failure IS NOT NULL THEN '接続エラー: ' || failure
                 WHEN http_status >= 400 THEN 'HTTP ' || http_status END AS error FROM allowed),
folded AS (
  SELECT site_id, run_ts, min(attempt) FILTER (NOT again) AS final_attempt, max(attempt) AS last_attempt,
    arg_min({'s': http_status, 'e': error}, attempt) FILTER (NOT again) AS final, arg_max({'e': error}, attempt) AS last,
    arg_max(http_status, attempt) FILTER (failure IS NULL) AS last_status
  FROM judged GROUP BY ALL)
SELECT site_id, strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run_ts, (coalesce(final_attempt, last_attempt) + 1)::INTEGER AS attempts,
  CASE WHEN final_attempt IS NOT NULL THEN final.s ELSE last_status END::INTEGER AS http_status,
  CASE WHEN final_attempt IS NOT NULL THEN final.e ELSE last.e END AS error
FROM folded""",
    "new_links": f"WITH {_replayed()} SELECT {_NEW} FROM fresh",
    "new_links_step": f"WITH {_replayed()} SELECT {_NEW} FROM fresh WHERE first_seen > {_MIDDLE}",
    "known_urls": f"WITH {_replayed()} SELECT {_KNOWN} FROM sighting",
    "known_retained": f"""
WITH {_replayed()}, last AS (SELECT site_id, max(run_ts) AS last_run FROM page GROUP BY site_id),
on_page AS (SELECT DISTINCT l.site_id, url FROM link l JOIN last USING (site_id) WHERE run_ts = last_run),
sized AS (
  SELECT s.*, o.url IS NOT NULL AS stays, count(*) OVER (PARTITION BY s.site_id) - 5 AS excess,
         last_run = last_ok AS last_is_ok
  FROM sighting s JOIN last USING (site_id) JOIN seed USING (site_id) LEFT JOIN on_page o USING (site_id, url)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, stays ORDER BY first_seen, pos) AS age FROM sized)
SELECT {_KNOWN} FROM ranked WHERE stays OR NOT last_is_ok OR age > excess""",
    "recent_per_site": f"WITH {_replayed(max_items=7)} SELECT site_id, ord, url, title, {_ts('first_seen')} FROM recent",
    "site_state": f"WITH {_replayed(_INCLUDE)} SELECT {_SITE} FROM site",
    "run_results": f"WITH {_replayed(_INCLUDE)} SELECT site_id, {_ts('run_ts')}, status, error, link_count, new_count, seeded_now FROM result",
    "error_streaks": f"""
WITH ok AS (SELECT user_id, event_type, min(ts) AS first_seen FROM events WHERE event_type <> 'error' GROUP BY ALL),
span AS (SELECT user_id, min(ts) AS first_ok, max(ts) AS last_ok FROM events WHERE event_type <> 'error' GROUP BY user_id),
site AS (
  SELECT e.user_id::VARCHAR AS site_id, any_value(last_ok) IS NOT NULL AS seeded, any_value(first_ok) AS first_checked,
    max(ts) AS last_checked,
    (SELECT max(first_seen) FROM ok WHERE ok.user_id = e.user_id AND ok.first_seen > any_value(s.first_ok)) AS last_update,
    CASE WHEN max(ts) = any_value(last_ok) THEN 'ok' ELSE 'error' END AS last_status,
    CASE WHEN max(ts) = any_value(last_ok) THEN NULL ELSE 'HTTP 503' END AS last_error,
    count(*) FILTER (last_ok IS NULL OR ts > last_ok)::INTEGER AS consecutive_errors
  FROM events e LEFT JOIN span s USING (user_id) GROUP BY e.user_id)
SELECT {_SITE} FROM site""",
    "after_reset": f"""
WITH {_replayed()}
SELECT site_id, seeded, CASE WHEN {_COM} THEN NULL ELSE strftime(last_update, '%Y-%m-%d %H:%M:%S') END AS last_update,
  (SELECT nullif(count(*), 0) FROM recent r WHERE r.site_id = s.site_id AND NOT s.{_COM}) AS recent,
  (SELECT nullif(count(*), 0) FROM sighting k WHERE k.site_id = s.site_id) AS known
FROM site s""",
    "reset_changes": f"WITH {_replayed()} SELECT site_id FROM site WHERE {_COM} AND last_update IS NOT NULL",
    "after_refill": f"""
WITH {_replayed()}, late AS (
  SELECT site_id, url, min(run_ts) AS first_seen, arg_min(pos, run_ts) AS pos, arg_min(title, run_ts) AS title
  FROM link WHERE run_ts > {_MIDDLE} GROUP BY site_id, url)
SELECT {_NEW} FROM late WHERE {_COM}
UNION ALL SELECT {_NEW} FROM fresh WHERE NOT {_COM} AND first_seen > {_MIDDLE}""",
    "after_prune": f"WITH {_replayed()} SELECT {_KNOWN} FROM sighting WHERE site_id NOT LIKE '%.org'",
    "partial_run": f"""
WITH {_replayed()},
seen AS (SELECT * FROM outcome WHERE run_ts <= {_MIDDLE} OR {_COM}),
state AS (
  SELECT o.site_id, max(run_ts) AS last_checked, min(run_ts) FILTER (error IS NULL) AS seed_ts,
    CASE WHEN arg_max(error IS NULL, run_ts) THEN 'ok' ELSE 'error' END AS status, arg_max(link_count, run_ts) AS n
  FROM seen o GROUP BY o.site_id),
found AS (SELECT f.* FROM fresh f WHERE first_seen <= {_MIDDLE} OR {_COM})
SELECT l.site_id, coalesce(status, 'pending') AS status, {_ts("s.last_checked")},
  (SELECT strftime(max(first_seen), '%Y-%m-%d %H:%M:%S') FROM found f WHERE f.site_id = l.site_id) AS last_update,
  CASE WHEN checked THEN (SELECT count(*) FROM found f WHERE f.site_id = l.site_id AND f.first_seen = s.last_checked) ELSE 0 END::INTEGER AS new_count,
  CASE WHEN checked THEN n ELSE 0 END::INTEGER AS link_count,
  coalesce(checked AND seed_ts = s.last_checked, FALSE) AS seeded_now,
  l.ord + CASE WHEN checked THEN 0 ELSE 1099511627776 END AS result_ord
FROM (SELECT site_id, ord, EXISTS (SELECT 1 FROM page p WHERE p.site_id = listed.site_id AND p.run_ts > {_MIDDLE}) AND {_COM} AS checked FROM listed) l
LEFT JOIN state s ON s.site_id = l.site_id""",
    "timeline_300": f"WITH {_replayed()} SELECT site_id, site_name, title, url, {_ts('first_seen')}, ord FROM timeline",
    "feed_sites": f"""
WITH {_replayed()}
SELECT s.site_id, s.site_id AS name, 'https://' || s.site_id || '/' AS url, s.last_status AS status, s.last_error AS error,
  s.consecutive_errors, {_ts("s.last_checked")}, {_ts("s.last_update")}, r.new_count, r.link_count, r.seeded_now,
  (SELECT count(*) FROM recent x WHERE x.site_id = s.site_id)::INTEGER AS item_count,
  coalesce((SELECT string_agg(url, ' ' ORDER BY ord) FROM recent x WHERE x.site_id = s.site_id), '') AS item_urls
FROM site s JOIN result r USING (site_id)""",
    "feed_totals": f"""
WITH {_replayed(_INCLUDE)}
SELECT count(*) AS site_count, sum(new_count)::BIGINT AS new_count, count(*) FILTER (status = 'error') AS error_count FROM result""",
    "run_summary": f"""
WITH {_replayed(_INCLUDE)}
SELECT site_id,
  CASE WHEN status = 'error' THEN '{report.FAILED}' WHEN seeded_now THEN '{report.FIRST_RUN}' WHEN new_count > 0 THEN '{report.FOUND_NEW}' ELSE '{report.UNCHANGED}' END AS label,
  CASE WHEN status = 'error' THEN error WHEN seeded_now THEN link_count || '件のリンクを記録（新着判定は次回から）'
       WHEN new_count > 0 THEN new_count || '件' ELSE '' END AS detail, ord,
  row_number() OVER (ORDER BY status <> 'error', new_count DESC, ord) AS summary_ord
FROM result JOIN listed USING (site_id)""",
    "run_summary_titles": f"""
WITH {_replayed()}, ranked AS (
  SELECT f.site_id, title, new_count, row_number() OVER (PARTITION BY f.site_id ORDER BY pos)::INTEGER AS rank
  FROM fresh f JOIN result r ON r.site_id = f.site_id AND r.run_ts = f.first_seen)
SELECT site_id, rank, CASE WHEN title = '' THEN '(タイトルなし)' ELSE left(title, 60) END AS title, greatest(new_count - 5, 0)::INTEGER AS more
FROM ranked WHERE rank <= 5""",
    "unread_timeline": f"""
WITH {_replayed()} SELECT site_id, title, url, {_ts("first_seen")} FROM timeline
WHERE url NOT IN (SELECT url FROM reads) AND contains(lower(title || ' ' || site_name), 'th')""",
    "unread_per_site": f"WITH {_replayed()} SELECT site_id, unread FROM unread",
    "reader_header": f"""
WITH {_replayed(_INCLUDE)}
SELECT count(*) AS site_count, (SELECT count(*) FROM timeline WHERE url NOT IN (SELECT url FROM reads)) AS unread,
  count(*) FILTER (status = 'error') AS error_count FROM result""",
    "site_ranking": f"""
WITH {_replayed(_INCLUDE)}
SELECT site_id, coalesce(unread, 0) AS unread, last_status AS status,
  row_number() OVER (ORDER BY coalesce(unread, 0) DESC, last_status <> 'error', site_id, ord) AS rank
FROM site LEFT JOIN unread USING (site_id) JOIN listed USING (site_id)""",
    "site_search": f"""
WITH {_replayed()} SELECT s.site_id FROM site s
WHERE contains(lower(s.site_id || ' https://' || s.site_id || '/'), 'tion')
   OR EXISTS (SELECT 1 FROM recent r WHERE r.site_id = s.site_id AND contains(lower(r.title), 'tion'))""",
    "site_badges": f"""
WITH {_replayed(_INCLUDE)}
SELECT s.site_id,
  CASE WHEN status = 'error' THEN '{reader.BADGE_ERROR}' WHEN r.seeded_now THEN '{reader.BADGE_SEEDED}' WHEN coalesce(unread, 0) > 0 THEN '{reader.BADGE_UNREAD[:-2]}' || unread ELSE '{reader.BADGE_NONE}' END AS badge,
  coalesce(unread, 0) > 0 OR status = 'error' AS is_open,
  CASE WHEN status = 'error' THEN '取得に失敗しました: ' || r.error || CASE WHEN s.consecutive_errors > 1 THEN '（' || s.consecutive_errors || '回連続）' ELSE '' END
       WHEN r.seeded_now THEN '初回巡回のため ' || r.link_count || ' 件のリンクを記録しました。新着の検知は次回からです。' END AS message
FROM site s JOIN result r USING (site_id) LEFT JOIN unread USING (site_id)""",
    "card_items": f"""
WITH {_replayed()} SELECT site_id, ord, title AS display_title FROM recent
WHERE url NOT IN (SELECT url FROM reads) AND contains(lower(title), 'th')""",
    "marked_read": f"""
SELECT user_id::VARCHAR AS reader_id, {_EVENT_URL} AS url,
  {_ts("coalesce(min(ts) FILTER (event_id % 2 = 0), min(ts))", "read_at")} FROM events GROUP BY 1, 2""",
    "all_marked_read": f"""
WITH {_replayed()}
SELECT 'r' AS reader_id, url, CASE WHEN url IN (SELECT url FROM timeline) THEN '2025-01-01 00:00:00' ELSE strftime(read_at, '%Y-%m-%d %H:%M:%S') END AS read_at
FROM (SELECT url, read_at FROM reads UNION SELECT url, NULL FROM timeline WHERE url NOT IN (SELECT url FROM reads))""",
    "read_retention": f"""
WITH read AS (SELECT user_id::VARCHAR AS reader_id, {_EVENT_URL} AS url, min(ts) AS read_at FROM events GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY read_at DESC, url) AS rank FROM read)
SELECT reader_id, url, {_ts("read_at")} FROM ranked WHERE rank <= 20""",
    "age_buckets": r"""
WITH aged AS (SELECT ts, floor((epoch_ms(TIMESTAMP '2024-02-15 12:00:00') - epoch_ms(ts)) / 1000.0)::BIGINT AS s FROM events)
SELECT CASE WHEN s < 60 THEN 'たった今' WHEN s < 3600 THEN (s // 60) || '分前' WHEN s < 86400 THEN (s // 3600) || '時間前'
            WHEN s < 2592000 THEN (s // 86400) || '日前' ELSE strftime(ts, '%Y/%m/%d %H:%M') END AS age, count(*) AS events
FROM aged GROUP BY 1""",
    "display_titles": r"""
SELECT page_id, CASE WHEN contains(url, '//www.') THEN url
  ELSE coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') END AS display_title FROM pages""",
    "site_defaults": f"""
WITH {_RAW}
SELECT ord, site_id, name, coalesce(url, '') AS url, CASE WHEN i % 8 = 4 THEN 'ul a' ELSE 'main a' END AS selector,
  CASE WHEN i % 6 = 0 THEN '/news/' WHEN i % 6 = 1 THEN '' WHEN i % 6 = 2 THEN '/a|1|True' ELSE '/x/' END AS include,
  '' AS exclude, i % 7 <> 0 AS enabled, TRUE AS skip_navigation,
  CASE WHEN i % 5 = 1 THEN i ELSE 30 END::INTEGER AS timeout, 2 AS retries,
  CASE WHEN i % 4 = 1 THEN 2 WHEN i % 4 = 2 THEN 100 ELSE 10 END AS max_items,
  greatest(1000, 40 * CASE WHEN i % 4 = 1 THEN 2 WHEN i % 4 = 2 THEN 100 ELSE 10 END) AS known_limit
FROM entry""",
    "site_violations": f"""
WITH {_RAW}
SELECT ord, 'url_missing' AS code, NULL AS detail FROM entry WHERE url IS NULL
UNION ALL SELECT ord, 'url_scheme', url FROM entry WHERE NOT regexp_matches(url, '^https?://')
UNION ALL SELECT ord, 'not_a_list', 'exclude' FROM entry WHERE i % 50 = 7
UNION ALL SELECT ord, 'not_a_number', 'retries' FROM entry WHERE i % 35 = 3
UNION ALL SELECT ord, 'duplicate_id', site_id
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ord) AS nth FROM entry WHERE url IS NOT NULL) WHERE nth > 1""",
    "checked_twice": f"WITH {_replayed()} SELECT {_NEW} FROM fresh WHERE first_seen > {_MIDDLE} AND site_id NOT LIKE '%.org'",
}
# Run by run: the known URLs of a site as a list, one step for each of its runs.
_LIMIT = 5
ORACLE["known_overflowing"] = f"""
WITH RECURSIVE {_links()},
ok AS (
  SELECT site_id, run_ts, list(struct_pack(url := url, title := title, pos := pos) ORDER BY pos) AS links,
    row_number() OVER (PARTITION BY site_id ORDER BY run_ts) AS n
  FROM link GROUP BY site_id, run_ts),
step AS (
  SELECT site_id, n, run_ts, list_transform(links, lambda x: struct_pack(seen := run_ts, pos := x.pos, url := x.url)) AS known, links[1:0] AS fresh
  FROM ok WHERE n = 1
  UNION ALL
  SELECT site_id, n, run_ts,
    list_concat(list_filter(merged, lambda k: list_contains(urls, k.url)),
      list_sort(list_filter(merged, lambda k: NOT list_contains(urls, k.url)))[greatest(0, len(merged) - {_LIMIT}) + 1:]) AS known, fresh
  FROM (
    SELECT *, list_transform(links, lambda x: x.url) AS urls,
      list_concat(known, list_transform(fresh, lambda x: struct_pack(seen := run_ts, pos := x.pos, url := x.url))) AS merged
    FROM (
      SELECT o.site_id, o.n, o.run_ts, o.links, s.known,
        list_filter(o.links, lambda x: NOT list_contains(list_transform(s.known, lambda k: k.url), x.url)) AS fresh
      FROM step s JOIN ok o ON o.site_id = s.site_id AND o.n = s.n + 1)))
SELECT site_id, x.url AS url, x.title AS title, x.pos AS pos, {_ts("run_ts", "first_seen")} FROM (SELECT site_id, run_ts, unnest(fresh) AS x FROM step)"""
ORACLE["late_snapshots"] = f"""
WITH {_PAGE} SELECT site_id, {_ts('run_ts')}, page_url FROM page WHERE run_ts <= {_MIDDLE} AND site_id NOT LIKE '%.org'"""
ORACLE["run_totals"] = f"""
WITH {_replayed()}
SELECT count(*) AS site_count, sum(new_count)::BIGINT AS new_count, count(*) FILTER (status = 'error') AS error_count FROM result"""
ORACLE["read_log_after_marks"] = f"""
WITH click AS (SELECT user_id::VARCHAR AS reader_id, {_EVENT_URL} AS url, ts, event_id % 2 AS later FROM events),
first AS (SELECT reader_id, url, min(ts) AS read_at FROM click WHERE later = 0 GROUP BY 1, 2),
log AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY read_at DESC, url) <= 20),
added AS (SELECT reader_id, url, min(ts) AS read_at FROM click c WHERE later = 1 AND NOT EXISTS (SELECT 1 FROM log WHERE log.reader_id = c.reader_id AND log.url = c.url) GROUP BY 1, 2),
whole AS (SELECT * FROM log UNION ALL SELECT * FROM added)
SELECT reader_id, url, {_ts('read_at')} FROM whole QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY read_at DESC, url) <= 20"""
ORACLE["selected_links"] = ORACLE["page_links"]
ORACLE["stored_state"] = ORACLE["known_urls"]
ORACLE["exported_state"] = ORACLE["recent_per_site"]
ORACLE["feed_tables"] = ORACLE["timeline_300"]
ORACLE["stream_new_links"] = ORACLE["new_links"]
ORACLE["state_document"] = f"""
WITH {_replayed()}
SELECT site_id, url, title, {_ts('first_seen')}, row_number() OVER (PARTITION BY site_id ORDER BY first_seen, pos, url) - 1 AS seq FROM sighting"""
ORACLE["state_document_sites"] = ORACLE["site_state"]
ORACLE["feed_document"] = f"""
WITH {_replayed()}, placed AS (
  SELECT t.*, row_number() OVER (ORDER BY first_seen DESC, l.ord, t.ord) - 1 AS place FROM timeline t JOIN listed l USING (site_id))
SELECT site_id, site_name, title, url, {_ts('first_seen')}, place AS ord FROM placed"""
ORACLE["feed_document_sites"] = f"""
WITH {_replayed()}
SELECT s.site_id, 'https://' || s.site_id || '/' AS url, s.last_status AS status, s.last_error AS error,
  s.consecutive_errors, {_ts("s.last_checked")}, {_ts("s.last_update")}, r.new_count, r.link_count, r.seeded_now,
  coalesce((SELECT string_agg(concat_ws(' ', url, title, strftime(first_seen, '%Y-%m-%d %H:%M:%S')), '|' ORDER BY ord) FROM recent x WHERE x.site_id = s.site_id), '') AS items,
  row_number() OVER (ORDER BY l.ord) - 1 AS result_ord
FROM site s JOIN result r USING (site_id) JOIN listed l USING (site_id)"""
ORACLE["feed_document_totals"] = f"""
WITH {_replayed()}
SELECT count(*) AS site_count, sum(new_count)::BIGINT AS new_count, count(*) FILTER (status = 'error') AS error_count FROM result"""

# Dressed pages: what is put before a page's own anchors, as it should come out. Own anchors stand 21 places later.
_DRESSED = (
    _links()
    + """,
dress AS (
  SELECT *, scheme || '://' || site_id AS origin, regexp_replace(site_id, '^www\\.', '') AS root, page_id % 17 = 3 AS broken,
    CASE WHEN page_id % 5 = 0 THEN '/b' || page_id || '/'
         ELSE coalesce(nullif(regexp_replace(regexp_extract(page_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') END AS dir
  FROM page),
put AS (
  SELECT page_id, site_id, run_ts, broken, origin, unnest([
    {'pos': 0, 'url': origin || dir || 'rel/x', 'title': 'rel', 'way': 'own'},
    {'pos': 7, 'url': origin || '/doc.pdf', 'title': 'doc', 'way': 'own'},
    {'pos': 8, 'url': origin || '/feed', 'title': 'feed', 'way': 'excluded'},
    {'pos': 9, 'url': 'http://' || site_id || '/Upper', 'title': 'upper', 'way': 'own'},
    {'pos': 10, 'url': 'http://' || site_id || '/Port', 'title': 'port', 'way': 'external'},
    {'pos': 11, 'url': origin || '/t?id=3', 'title': 'tracked', 'way': 'own'},
    {'pos': 12, 'url': origin || '/img-x', 'title': 'A picture', 'way': 'own'},
    {'pos': 13, 'url': origin || '/ta-x', 'title': 'By title', 'way': 'own'},
    {'pos': 14, 'url': origin || '/late-x', 'title': CASE WHEN page_id % 3 = 0 THEN 'Late' ELSE '' END, 'way': 'own'},
    {'pos': 15, 'url': 'https://partner.example/p', 'title': 'partner', 'way': 'listed'},
    {'pos': 16, 'url': 'https://sub.partner.example/s', 'title': 'partner sub', 'way': 'listed'},
    {'pos': 17, 'url': 'https://other.test/o', 'title': 'other', 'way': 'external'},
    {'pos': 18, 'url': 'http://sub.' || root || '/s', 'title': 'sub', 'way': 'own'},
    {'pos': 19, 'url': origin || '/ok-x', 'title': 'ok', 'way': 'own'}]) AS x FROM dress),
both_kinds AS (
  SELECT page_id, site_id, run_ts, x.pos::INTEGER AS pos, x.url AS url, x.title AS title, x.way AS way, broken FROM put
  UNION ALL SELECT l.page_id, l.site_id, l.run_ts, pos + 21, url, title, 'own', broken FROM link l JOIN dress d USING (page_id)),
web AS (
  SELECT page_id, site_id, run_ts, unnest([
    {'pos': 0, 'host': site_id}, {'pos': 3, 'host': site_id}, {'pos': 4, 'host': site_id}, {'pos': 5, 'host': site_id}, {'pos': 6, 'host': site_id},
    {'pos': 7, 'host': site_id}, {'pos': 8, 'host': site_id}, {'pos': 9, 'host': site_id}, {'pos': 10, 'host': site_id || ':80'}, {'pos': 11, 'host': site_id},
    {'pos': 12, 'host': site_id}, {'pos': 13, 'host': site_id}, {'pos': 14, 'host': site_id}, {'pos': 15, 'host': 'partner.example'},
    {'pos': 16, 'host': 'sub.partner.example'}, {'pos': 17, 'host': 'other.test'}, {'pos': 18, 'host': 'sub.' || root}, {'pos': 19, 'host': site_id},
    {'pos': 20, 'host': site_id}]) AS x, root FROM dress WHERE NOT broken
  UNION ALL SELECT a.page_id, a.site_id, a.run_ts, {'pos': pos + 21, 'host': a.site_id}, root FROM anchor a JOIN dress d USING (page_id) WHERE NOT broken)"""
)
ORACLE["dressed_links"] = f"WITH {_DRESSED} SELECT site_id, {_ts('run_ts')}, pos, url, title FROM both_kinds WHERE NOT broken AND way IN ('own', 'listed')"
ORACLE["dressed_links_external"] = f"""
WITH {_DRESSED}, unexcluded AS (
  SELECT page_id, site_id, run_ts, pos::INTEGER + 21 AS pos, scheme || '://' || site_id || href AS url, title FROM anchor
  WHERE href <> '/' AND NOT regexp_matches(lower(href), '\\.({_SUFFIXES})$') AND length(title) >= 3),
whole AS (
  SELECT site_id, page_id, run_ts, pos, url, title FROM both_kinds WHERE pos < 21 AND length(title) >= 3
  UNION ALL SELECT site_id, page_id, run_ts, pos, url, title FROM unexcluded)
SELECT site_id, {_ts('run_ts')}, min(w.pos)::INTEGER AS pos, url, arg_min(title, w.pos) AS title
FROM whole w JOIN (SELECT page_id, broken FROM dress) USING (page_id) WHERE NOT broken GROUP BY page_id, site_id, w.run_ts, url"""
ORACLE["dressed_outcomes"] = f"""
WITH {_DRESSED}
SELECT site_id, {_ts('run_ts')}, CASE WHEN broken THEN 0 ELSE count(*) FILTER (way = 'own') END::INTEGER AS link_count, CASE WHEN broken THEN '解析エラー: ValueError' END AS error
FROM both_kinds GROUP BY page_id, site_id, run_ts, broken"""
ORACLE["same_site_links"] = f"""
WITH {_DRESSED}
SELECT site_id, {_ts('run_ts')}, x.pos::INTEGER AS pos, x.host AS link_host,
  x.host = site_id OR ends_with(x.host, '.' || root) AS same_site,
  x.host = site_id OR ends_with(x.host, '.' || root) OR x.host = 'partner.example' OR ends_with(x.host, '.partner.example') AS allowed FROM web"""
ORACLE["titles_filled_later"] = f"""
WITH {_DRESSED}, late AS (SELECT * FROM both_kinds WHERE pos = 14 AND NOT broken),
seeds AS (SELECT site_id, min(run_ts) AS seed FROM page WHERE page_id % 17 <> 3 GROUP BY site_id)
SELECT site_id, url, CASE WHEN max(title) = '' THEN '' ELSE 'Late' END AS title, CASE WHEN min(run_ts) > any_value(seed) THEN arg_min(title, run_ts) END AS item_title
FROM late JOIN seeds USING (site_id) GROUP BY site_id, url"""
ORACLE["page_bytes"] = ORACLE["page_links"]
_FIRST_HALF = f"""
first_half AS (SELECT * FROM link WHERE run_ts <= {_MIDDLE}),
half_seed AS (SELECT site_id, min(run_ts) AS seed_ts FROM first_half GROUP BY site_id),
half_known AS (
  SELECT site_id, url, min(run_ts) AS first_seen, arg_min(pos, run_ts) AS pos, coalesce(arg_min(title, run_ts) FILTER (title <> ''), '') AS title,
    arg_min(title, run_ts) AS first_title FROM first_half GROUP BY site_id, url)"""
ORACLE["checked_in_part"] = f"""
WITH {_replayed()}, {_FIRST_HALF}
SELECT {_KNOWN} FROM sighting WHERE {_COM}
UNION ALL SELECT {_KNOWN} FROM half_known WHERE NOT {_COM} AND site_id NOT LIKE '%.org'"""
ORACLE["feed_after_reset"] = f"""
WITH {_replayed()}, {_FIRST_HALF},
item AS (
  SELECT site_id, url, first_title AS title, first_seen, pos, row_number() OVER (PARTITION BY site_id ORDER BY first_seen DESC, pos) AS n
  FROM half_known JOIN half_seed USING (site_id) WHERE first_seen > seed_ts AND NOT {_COM} AND site_id NOT LIKE '%.org'),
shown AS (SELECT i.*, row_number() OVER (ORDER BY first_seen DESC, l.ord, n) - 1 AS place FROM item i JOIN listed l USING (site_id) WHERE n <= 50)
SELECT site_id, title, url, {_ts('first_seen')}, place AS ord FROM shown WHERE place < 300"""
ORACLE["dry_run"] = f"""
WITH {_replayed()}, {_FIRST_HALF},
late AS (
  SELECT site_id, url, min(run_ts) AS first_seen, arg_min(pos, run_ts) AS pos, arg_min(title, run_ts) AS title FROM link
  WHERE run_ts > {_MIDDLE} AND {_COM} GROUP BY site_id, url),
seeds AS (SELECT site_id, min(run_ts) AS seed_ts FROM link GROUP BY site_id)
SELECT {_NEW}, 0 AS version FROM late JOIN seeds USING (site_id)
WHERE first_seen > seed_ts AND NOT EXISTS (SELECT 1 FROM half_known k WHERE k.site_id = late.site_id AND k.url = late.url)"""
ORACLE["replaced_sites"] = f"""
WITH {_replayed()}, {_FIRST_HALF}, org AS (SELECT DISTINCT site_id FROM page WHERE site_id LIKE '%.org' AND run_ts <= {_MIDDLE})
SELECT {_KNOWN} FROM sighting WHERE site_id NOT IN (SELECT site_id FROM org)
UNION ALL SELECT {_KNOWN} FROM half_known WHERE site_id IN (SELECT site_id FROM org)"""
# Outcomes as ``_attempts`` in the queries makes them; the epoch's second of a page is its id and the first run's second.
_TRIED = f"""
moment AS (SELECT *, epoch(run_ts)::BIGINT AS e FROM page),
told AS (
  SELECT a.page_id, a.site_id, a.run_ts, a.e, CASE WHEN e % 7 = 0 THEN 'タイムアウト（20秒）' WHEN e % 11 = 0 THEN 'HTTP 404' WHEN n IS NULL THEN '{_NO_LINKS}' END AS error, coalesce(n, 0) AS n
  FROM moment a LEFT JOIN (SELECT page_id, count(*) AS n FROM link GROUP BY page_id) c USING (page_id))"""
ORACLE["attempts_to_pages"] = f"""
WITH {_links()}, {_TRIED}
SELECT site_id, {_ts('run_ts')}, CASE WHEN error IS NULL THEN n ELSE 0 END::INTEGER AS link_count, error FROM told"""
ORACLE["checked_attempts"] = f"""
WITH {_links()}, {_TRIED}, span AS (SELECT site_id, min(run_ts) AS first_ok, max(run_ts) AS last_ok FROM told WHERE error IS NULL GROUP BY site_id),
seen AS (SELECT l.site_id, url, min(l.run_ts) AS first_seen FROM link l JOIN told t USING (page_id) WHERE t.error IS NULL GROUP BY l.site_id, url),
site AS (
  SELECT t.site_id, any_value(last_ok) IS NOT NULL AS seeded, any_value(first_ok) AS first_checked, max(t.run_ts) AS last_checked,
    (SELECT max(first_seen) FROM seen WHERE seen.site_id = t.site_id AND seen.first_seen > any_value(s.first_ok)) AS last_update,
    CASE WHEN max(t.run_ts) = any_value(last_ok) THEN 'ok' ELSE 'error' END AS last_status, arg_max({{'e': t.error}}, t.run_ts).e AS last_error,
    count(*) FILTER (last_ok IS NULL OR t.run_ts > last_ok)::INTEGER AS consecutive_errors
  FROM told t LEFT JOIN span s USING (site_id) WHERE t.site_id NOT LIKE '%.org' GROUP BY t.site_id)
SELECT {_SITE} FROM site"""
ORACLE["pages_within_a_second"] = f"""
WITH {_PAGE}, sec AS (SELECT site_id, page_id // 500 AS s, count(*) AS n FROM page WHERE site_id NOT LIKE '%.org' GROUP BY 1, 2)
SELECT site_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(max(s)), '%Y-%m-%d %H:%M:%S') AS last_checked, nullif(sum(n - 1), 0)::BIGINT AS aside FROM sec GROUP BY site_id"""
ORACLE["read_log_compacted"] = ORACLE["read_log_after_marks"]
ORACLE["site_search_indexed"] = ORACLE["site_search"]
ORACLE["card_items_indexed"] = f"""
WITH {_replayed()} SELECT site_id, ord, title AS display_title FROM recent
WHERE url NOT IN (SELECT url FROM reads) AND contains(lower(title), 'the')"""
