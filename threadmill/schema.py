"""Explicit schemas of the stored tables, as DDL."""

PLATFORMS = ("facebook", "instagram", "twitter", "linkedin", "google")

AUTHOR = "STRUCT<platform_id: STRING, username: STRING, display_name: STRING, profile_url: STRING, is_verified: BOOLEAN>"
POSTS = "client STRING, platform STRING, platform_id STRING, account_id STRING, url STRING, text STRING, published_at TIMESTAMP, likes BIGINT, comments_count BIGINT, shares BIGINT, media_type STRING, media_urls ARRAY<STRING>, raw_data STRING"
COMMENTS = f"seq BIGINT, client STRING, platform STRING, platform_id STRING, post_id STRING, text STRING, author {AUTHOR}, published_at TIMESTAMP, likes BIGINT, replies_count BIGINT, parent_id STRING, raw_data STRING"
PROFILES = "client STRING, platform STRING, platform_id STRING, username STRING, display_name STRING, description STRING, url STRING, profile_image STRING, cover_image STRING, followers_count BIGINT, following_count BIGINT, posts_count BIGINT, is_verified BOOLEAN, raw_data STRING, updated_at TIMESTAMP"
HISTORY = "client STRING, platform STRING, account_id STRING, posts_scraped BIGINT, comments_found BIGINT, new_comments_saved BIGINT, duplicates_skipped BIGINT, last_post_date TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP, error STRING"
RUNS = "client STRING, platform STRING, account STRING, started_at TIMESTAMP, completed_at TIMESTAMP, duration_seconds DOUBLE, posts_extracted INT, comments_extracted INT, errors INT, rate_limits INT"
EVENTS = "event_type STRING, timestamp TIMESTAMP, source STRING, data MAP<STRING, STRING>"
