"""Test-table adapters: the driver's TPC-H-ish tables seen as content snapshots.

The same views are written in SQL in ``trendspark.catalog.oracle`` so the
DuckDB oracle computes on identical inputs.

videos     orders + customer + nation + region, lineitem sums per order
           video_id=o_orderkey, channel_id=o_custkey, channel_title=c_name,
           region=r_name, category_name=c_mktsegment,
           category_id=first char of o_orderpriority, views=floor(o_totalprice),
           likes=sum(l_quantity), comments=count(lines), duration_seconds=
           floor(sum(l_extendedprice)/100), tag_count=lines with l_returnflag 'R'
           (all 0 when an order has no lines), publish_time=o_orderdate,
           fetch_time=2002-01-01 (after every order date).
snapshots  events: video_id=user_id, category_id=event_type, region=region of
           user_id mod 5, fetch_time=ts, publish_time=first ts of (user, type),
           views=round(value*100) (a count), likes=props $.k, comments=floor(value/10).
texts      documents (+ labels): title=trimmed text before the first '.' or
           newline, description=text, tags=second line of the text,
           channel_title=source, region=lang.
parts      part: duration_seconds=p_size*120, category_name=p_type.
wide_videos  videos with title = that of document video_id mod (number of document ids) and
           category_id = one of 14 ids by channel_id mod 14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.sources.tables import read_table, spread

FETCH_TIME_SQL = "TIMESTAMP_NTZ '2002-01-01 00:00:00'"


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region name. Both are fixed-size TPC-H dimensions (25 and 5 rows)."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("region"))


def order_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order sums of lineitem (partial aggregation before the shuffle)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"])
    return li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("bigint").alias("likes"),
        F.count(F.lit(1)).alias("comments"),
        F.floor(F.sum("l_extendedprice") / 100).cast("bigint").alias("duration_seconds"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("tag_count"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    geo = geography(spark, sf_dir)
    lines = order_line_stats(spark, sf_dir)
    v = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(geo), F.col("c_nationkey") == geo.n_nationkey)
         .join(lines, o.o_orderkey == lines.l_orderkey, "left"))
    return v.select(
        F.col("o_orderkey").alias("video_id"),
        F.col("o_custkey").alias("channel_id"),
        F.col("c_name").alias("channel_title"),
        F.col("region"),
        F.substring("o_orderpriority", 1, 1).alias("category_id"),
        F.col("c_mktsegment").alias("category_name"),
        F.floor("o_totalprice").cast("bigint").alias("views"),
        F.coalesce("likes", F.lit(0).cast("bigint")).alias("likes"),
        F.coalesce("comments", F.lit(0).cast("bigint")).alias("comments"),
        F.coalesce("duration_seconds", F.lit(0).cast("bigint")).alias("duration_seconds"),
        F.coalesce("tag_count", F.lit(0).cast("bigint")).alias("tag_count"),
        F.col("o_orderdate").alias("publish_time"),
        F.expr(FETCH_TIME_SQL).alias("fetch_time"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    first_seen = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("publish_time"))
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    s = (e.join(first_seen, ["user_id", "event_type"])
         .join(F.broadcast(r), F.pmod(F.col("user_id"), F.lit(5)) == r.r_regionkey))
    return s.select(
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("video_id"),
        F.col("event_type").alias("category_id"),
        F.col("r_name").alias("region"),
        F.col("ts").alias("fetch_time"),
        F.col("publish_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("views"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("likes"),
        F.floor(F.col("value") / 10).cast("bigint").alias("comments"),
        F.col("props"),
    )


TITLE_PATTERN = r"^([^.\n]*)"
TAGS_PATTERN = r"\n([^\n]*)"


def texts(spark: SparkSession, sf_dir: str, with_labels: bool = False) -> DataFrame:
    d = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]))
    t = d.select(
        "doc_id",
        F.trim(F.regexp_extract("text", TITLE_PATTERN, 1)).alias("title"),
        F.col("text").alias("description"),
        F.regexp_extract("text", TAGS_PATTERN, 1).alias("tags"),
        F.col("source").alias("channel_title"),
        F.col("lang").alias("region"),
    )
    if with_labels:
        lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
        t = t.join(lab, "doc_id", "left")
    return t


WIDE_CATEGORIES = ["1", "10", "15", "17", "19", "2", "20", "22", "23", "24", "25", "26", "27", "28"]


def wide_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``videos`` with a title (of the document whose id is the video's modulo the number of ids) and a
    category id picked by the channel, for the wide feature table."""
    v = videos(spark, sf_dir)
    ids = read_table(spark, sf_dir, "documents", ["doc_id"]).select(F.max("doc_id") + 1).scalar()
    titles = texts(spark, sf_dir).select(F.col("doc_id").alias("_doc"), "title")
    cats = F.array(*[F.lit(c) for c in WIDE_CATEGORIES])
    picked = F.element_at(cats, (F.pmod("channel_id", F.lit(len(WIDE_CATEGORIES))) + 1).cast("int"))
    return v.withColumn("category_id", picked).withColumn("_doc", F.pmod(F.col("video_id"), ids)).join(titles, "_doc", "left").drop("_doc")


REQUEST_CATEGORIES = ["1", "10", "17", "20", "22", "23", "24", "25", "26", "27", "28"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests: one for each text.

    title/description/tags from the text; a size of 1 to 50 from the id; duration = size * 30 s;
    category id picked from the ids the scoring rules know (size mod 11); hour/weekday/month
    from the size.
    """
    from trendspark.functions.arrays import parse_tags
    t = texts(spark, sf_dir)
    j = t.withColumn("size", F.pmod(F.col("doc_id") * 7919, F.lit(50)) + 1)
    cats = F.array(*[F.lit(c) for c in REQUEST_CATEGORIES])
    return j.select(
        "doc_id", "title", "description", parse_tags("tags").alias("tags"),
        (F.col("size").cast("bigint") * 30).alias("duration_seconds"),
        F.element_at(cats, (F.col("size") % 11 + 1).cast("int")).alias("category_id"),
        (F.col("size") % 24).cast("int").alias("publish_hour"),
        (F.col("size") % 7).cast("int").alias("publish_weekday"),
        (F.col("size") % 12 + 1).cast("int").alias("publish_month"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
    return p.select(
        F.col("p_partkey").alias("video_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category_name"),
        (F.col("p_size").cast("bigint") * 120).alias("duration_seconds"),
        F.col("p_retailprice").alias("engagement_score"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
