"""Schemas of the stored tables. Counts are bigints; every fact carries the tokenizer's version."""

from __future__ import annotations

TABLES = {
    "ngram_counts": "tokenizer_version string, n tinyint, ngram string, bucket date, count bigint",
    "bucket_totals": "tokenizer_version string, n tinyint, bucket date, total_count bigint",
    "ngram_vocabulary": "tokenizer_version string, n tinyint, ngram string, global_count bigint, admitted_at timestamp",
    "global_counts": "tokenizer_version string, n tinyint, ngram string, count bigint",
}
LOG = (
    "run_seq bigint, batch_id string, tokenizer_version string, command string, last_ingested_ts bigint, comments_processed bigint, ngram_counts_inserted bigint, "
    "bucket_totals_inserted bigint, vocabulary_inserted bigint, start_month string, end_month string, duration_ms bigint, created_at timestamp, "
    "first_ingested_ts bigint, state_rows bigint"
)
FEEDBACK = "tokenizer_version string, phrases array<string>, granularity string, start_date date, smoothing tinyint, user_agent string, created_at timestamp"
#: Where an n-gram occurs in several rows of a table, the row with the greatest of these counts. Other tables' rows add up.
VERSION_COLUMN = {"ngram_vocabulary": "admitted_at"}
