"""Schemas and fixed values.

The values in the FIXED VALUES block must equal the ones the analysed application
uses, otherwise feature values and scores differ. They are stated plainly, in
their natural order, and are passed to the column builders as parameters.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's values)
# ---------------------------------------------------------------------------

# Category id -> name dimension (32 rows; "Comedy" appears under 23 and 34).
CATEGORY_NAMES = {
    "1": "Film & Animation",
    "2": "Autos & Vehicles",
    "10": "Music",
    "15": "Pets & Animals",
    "17": "Sports",
    "18": "Short Movies",
    "19": "Travel & Events",
    "20": "Gaming",
    "21": "Videoblogging",
    "22": "People & Blogs",
    "23": "Comedy",
    "24": "Entertainment",
    "25": "News & Politics",
    "26": "Howto & Style",
    "27": "Education",
    "28": "Science & Technology",
    "29": "Nonprofits & Activism",
    "30": "Movies",
    "31": "Anime/Animation",
    "32": "Action/Adventure",
    "33": "Classics",
    "34": "Comedy",
    "35": "Documentary",
    "36": "Drama",
    "37": "Family",
    "38": "Foreign",
    "39": "Horror",
    "40": "Sci-Fi/Fantasy",
    "41": "Thriller",
    "42": "Shorts",
    "43": "Shows",
    "44": "Trailers",
}
UNKNOWN_CATEGORY = "Unknown"

# Clickbait phrases; 'shocking' is listed twice on purpose (it weighs 2).
CLICKBAIT_PHRASES = [
    "you won't believe", "mind blowing", "amazing", "shocking", "insane",
    "unbelievable", "won't believe", "must see", "mind-blowing", "incredible",
    "shocking", "secret", "surprising", "revealed", "miracle", "revolutionary",
]

POSITIVE_WORDS = [
    "amazing", "awesome", "beautiful", "best", "brilliant", "congrats",
    "excellent", "exciting", "fantastic", "fun", "glad", "good", "great",
    "happy", "impressive", "love", "perfect", "remarkable", "spectacular",
    "super", "terrific", "wonderful",
]

NEGATIVE_WORDS = [
    "angry", "awful", "bad", "disappointing", "disaster", "disturbing",
    "fail", "horrible", "negative", "sad", "scary", "shocked", "terrible",
    "tragic", "ugly", "unfortunate", "upset", "worst", "wrong",
]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SOCIAL_PLATFORMS = ["facebook", "twitter", "instagram", "tiktok", "linkedin", "snapchat", "youtube"]

# Case-insensitive title patterns.
PATTERN_PART_NUMBER = r"part\s*\d+|pt\.?\s*\d+|\(\s*\d+\s*\)|#\s*\d+"
PATTERN_YEAR = r"\b20\d{2}\b|\b19\d{2}\b"
PATTERN_TUTORIAL = r"tutorial|how\s+to|guide|tips|tricks|learn|course"
PATTERN_REVIEW = r"review|unboxing|vs\.?|versus"
PATTERN_REACTION = r"react|reaction|watching"
PATTERN_CLICKBAIT = (r"you won't believe|mind blowing|amazing|shocking|insane|unbelievable|"
                     r"must see|incredible|shocking|secret|revealed")
# Description patterns.
PATTERN_TIMESTAMP = r"\d{1,2}:\d{2}"
PATTERN_MUSIC = r"music|song|track|artist|album|composer|producer"
PATTERN_SPONSOR = r"sponsor|partner|promotion|discount|code|affiliate|deal"

# Heuristic trending score (0-10): category popularity factors.
CATEGORY_FACTORS = {
    "10": 0.8, "24": 0.7, "20": 0.6, "23": 0.5, "22": 0.4, "28": 0.4,
    "27": 0.3, "25": 0.2, "1": 0.2, "26": 0.2, "17": 0.1,
}

# Bin edges (right-closed) and labels.
TITLE_LENGTH_EDGES = [0, 20, 40, 60, 80, 100, 120, 140, 160]
TITLE_LENGTH_LABELS = ["0-20", "21-40", "41-60", "61-80", "81-100", "101-120", "121-140", "141-160"]
DURATION_MINUTE_EDGES = [0, 2, 5, 10, 15, 20, 30, 45, 60]
DURATION_MINUTE_LABELS = ["0-2", "2-5", "5-10", "10-15", "15-20", "20-30", "30-45", "45-60"]

# Duration category thresholds in seconds (left-closed): <60, <300, <1200, <3600, else.
DURATION_CATEGORY_BOUNDS = [(60, "very_short"), (300, "short"), (1200, "medium"), (3600, "long")]
DURATION_CATEGORY_ELSE = "very_long"

# Trending delay thresholds in hours: <24, <48, <168, else.
DELAY_BOUNDS = [(24, "same_day"), (48, "next_day"), (168, "same_week")]
DELAY_ELSE = "later"

# Feature-name lists of the serving request (columns the numeric "norm" applies to).
LEGACY_NORM_COLUMNS = ["duration_seconds", "title_length", "tag_count", "description_length"]
# Recommendation texts of the serving endpoint.
API_RECOMMENDATIONS = {
    "title_short": "Consider using a longer title (30-70 characters)",
    "title_long": "Consider using a slightly shorter title (30-70 characters)",
    "punctuation": "Adding a question mark or exclamation point might increase engagement",
    "tags_few": "Add more tags (aim for 5-15 relevant tags)",
    "tags_many": "Too many tags might dilute relevance. Focus on 5-15 highly relevant tags",
    "music_long": "Music videos tend to perform better when under 10 minutes",
    "gaming_short": "Gaming videos tend to perform better between 10-20 minutes",
    "entertainment_faces": "Entertainment videos with thumbnails featuring faces tend to perform better",
}

# Recommendation texts of the predictor.
PREDICTOR_RECOMMENDATIONS = {
    "title_short": "Make your title longer (30-70 characters is optimal)",
    "title_long": "Consider shortening your title (30-70 characters is optimal)",
    "punctuation": "Add a question mark or exclamation point to your title to increase engagement",
    "music_duration": "Music videos tend to perform better when they're shorter (under 5 minutes)",
    "entertainment_duration": "Entertainment videos tend to perform best between 8-15 minutes",
    "gaming_duration": "Gaming videos tend to perform best between 10-25 minutes",
    "education_duration": "Educational videos tend to perform best between 7-20 minutes",
    "tags_few": "Add more tags (aim for 8-15 relevant tags)",
    "tags_many": "Too many tags might dilute relevance. Focus on 8-15 highly relevant tags",
    "description_short": "Add a more detailed description (200+ characters recommended)",
    "music_day": "Music videos typically perform better when published on Friday or Saturday",
    "music_hour": "Music videos typically perform better when published between 3pm-8pm",
    "gaming_hour": "Gaming videos typically perform better when published between 2pm-10pm",
    "entertainment_day": "Entertainment videos often perform better when published Thursday-Saturday",
    "news_hour": "News videos typically perform better in the morning (7am-11am) or early evening (5pm-8pm)",
}

# Advice tiers by trending score (F21): >= 8, >= 6, >= 4, else.
ADVICE_TIERS = [(8, "excellent"), (6, "good"), (4, "moderate")]
ADVICE_ELSE = "low"
# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------

# Silver table of snapshots (one row = one item in one snapshot in one region).
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("video_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("channel_id", T.StringType()),
    T.StructField("channel_title", T.StringType()),
    T.StructField("publish_time", T.TimestampType()),
    T.StructField("fetch_time", T.TimestampType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("views", T.LongType()),
    T.StructField("likes", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("duration", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("thumbnail_url", T.StringType()),
    T.StructField("region", T.StringType()),
])

# Scoring request record.
REQUEST_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("duration_seconds", T.LongType(), False),
    T.StructField("category_id", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("thumbnail_url", T.StringType()),
    T.StructField("channel_title", T.StringType()),
    T.StructField("publish_hour", T.IntegerType()),
    T.StructField("publish_weekday", T.IntegerType()),
    T.StructField("publish_month", T.IntegerType()),
])


def category_dimension(spark):
    """The 32-row category dimension as a DataFrame (fixed size: safe to broadcast)."""
    rows = [(k, v) for k, v in CATEGORY_NAMES.items()]
    return spark.createDataFrame(rows, "category_id string, category_name string")
