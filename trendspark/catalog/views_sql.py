"""The test-table adapter views in plain SQL (DuckDB dialect), for the oracle.

They mirror ``trendspark.sources.adapters`` and the feature builders column by
column; ``with_views(...)`` emits a WITH clause holding the views a query needs
plus their dependencies, in dependency order.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


_view("videos", [], """
SELECT o.o_orderkey AS video_id, o.o_custkey AS channel_id, c.c_name AS channel_title,
       r.r_name AS region, substr(o.o_orderpriority, 1, 1) AS category_id,
       c.c_mktsegment AS category_name, CAST(floor(o.o_totalprice) AS BIGINT) AS views,
       coalesce(l.likes, 0) AS likes, coalesce(l.comments, 0) AS comments,
       coalesce(l.duration_seconds, 0) AS duration_seconds, coalesce(l.tag_count, 0) AS tag_count,
       o.o_orderdate AS publish_time, TIMESTAMP '2002-01-01 00:00:00' AS fetch_time
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS likes, count(*) AS comments,
                  CAST(floor(sum(l_extendedprice) / 100) AS BIGINT) AS duration_seconds,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS tag_count
           FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
""")

# F3 / F4 on videos
_view("ve", ["videos"], """
SELECT *,
       least(100.0, likes / greatest(views, 1) * 100) AS like_view_ratio,
       least(100.0, comments / greatest(views, 1) * 100) AS comment_view_ratio,
       least(100.0, (likes + comments * 5) / greatest(views, 1) * 100) AS engagement_score
FROM videos
""")

# F28 hours since published + F5-F7 + popularity score (declared formula)
_view("vf", ["ve"], """
SELECT *,
       date_diff('microsecond', publish_time, fetch_time) / 3.6e9 AS hours_since_published,
       views / greatest(date_diff('microsecond', publish_time, fetch_time) / 3.6e9, 1.0 / 60) AS views_per_hour,
       likes / greatest(date_diff('microsecond', publish_time, fetch_time) / 3.6e9, 1.0 / 60) AS likes_per_hour,
       comments / greatest(date_diff('microsecond', publish_time, fetch_time) / 3.6e9, 1.0 / 60) AS comments_per_hour
FROM ve
""")

_view("snapshots", [], """
SELECT e.event_id AS snapshot_id, e.user_id AS video_id, e.event_type AS category_id,
       r.r_name AS region, e.ts AS fetch_time, f.publish_time, CAST(round(e.value * 100) AS BIGINT) AS views,
       TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS likes,
       CAST(floor(e.value / 10) AS BIGINT) AS comments, e.props
FROM events e
JOIN (SELECT user_id, event_type, min(ts) AS publish_time FROM events GROUP BY 1, 2) f
  ON e.user_id = f.user_id AND e.event_type = f.event_type
JOIN region r ON (e.user_id % 5) = r.r_regionkey
""")

_view("texts", [], r"""
SELECT doc_id, trim(regexp_extract(text, '^([^.\n]*)', 1)) AS title, text AS description,
       regexp_extract(text, '\n([^\n]*)', 1) AS tags, source AS channel_title, lang AS region
FROM documents
""")

_view("parts", [], """
SELECT p_partkey AS video_id, p_name AS title, p_type AS category_name,
       CAST(p_size AS BIGINT) * 120 AS duration_seconds, p_retailprice AS engagement_score
FROM part
""")


_view("wide_videos", ["videos", "texts"], """
SELECT v.* EXCLUDE (category_id),
       ['1', '10', '15', '17', '19', '2', '20', '22', '23', '24', '25', '26', '27', '28'][v.channel_id % 14 + 1] AS category_id,
       t.title
FROM videos v LEFT JOIN texts t ON t.doc_id = v.video_id % (SELECT max(doc_id) + 1 FROM documents)
""")

_REQ_CATS = "['1', '10', '17', '20', '22', '23', '24', '25', '26', '27', '28']"


def _requests_body() -> str:
    from trendspark.catalog.sql_text import parse_tags
    return f"""
SELECT t.doc_id, t.title, t.description, {parse_tags('t.tags')} AS tags,
       CAST(t.size AS BIGINT) * 30 AS duration_seconds, {_REQ_CATS}[t.size % 11 + 1] AS category_id,
       CAST(t.size % 24 AS INTEGER) AS publish_hour, CAST(t.size % 7 AS INTEGER) AS publish_weekday,
       CAST(t.size % 12 + 1 AS INTEGER) AS publish_month
FROM (SELECT *, doc_id * 7919 % 50 + 1 AS size FROM texts) t
"""


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    if "requests" in names and "requests" not in VIEWS:
        _view("requests", ["texts"], _requests_body())
    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n"
