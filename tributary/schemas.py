"""Schemas of the review stream and of the tables that the pipelines write."""

from __future__ import annotations

PAYLOAD = "review_id string, user_id string, business_id string, stars double, text string, event_time string, date string"
REVIEW = "review_id string, user_id string, business_id string, stars double, text string, event_time timestamp, ingest_time timestamp"

TABLES = {
    "bronze_reviews": REVIEW,
    "metrics_1m": "window_start timestamp, window_end timestamp, n_reviews long, avg_stars double",
    "dup_bloom": "event_time timestamp, review_id string, user_id string, business_id string, stars double, text string, dup_key string",
    "gold_dup_rate_1m": "window_start timestamp, total long, dup_count long, dup_rate double",
    "reservoir_samples": "event_time timestamp, review_id string, user_id string, business_id string, stars double, text string, window_start timestamp",
    "fm_distinct_users": "window_start timestamp, distinct_users_estimate double, distinct_users_exact long, raw_distinct_users_estimate double, error_percent double, max_trailing_zeros long, num_hash_functions long",
    "performance_metrics": "window_start timestamp, total_events long, total_processing_time double, avg_throughput double, max_throughput double, avg_latency double, p50_latency double, p95_latency double, p99_latency double, max_latency double, avg_event_delay double, max_event_delay double, num_batches long",
    "storage_metrics": "timestamp timestamp, checkpoint_name string, checkpoint_path string, size_bytes long, size_mb double",
    "gold_dgim_highstar": "ts timestamp, window_minutes int, estimate long, exact long",
    "accuracy_fm_summary": "report_timestamp timestamp, data_source string, total_windows long, windows_with_exact long, avg_estimate double, avg_exact double, avg_abs_error double, avg_rel_error double, median_rel_error double, p95_rel_error double, p99_rel_error double, max_rel_error double, min_rel_error double",
    "accuracy_bloom_summary": "report_timestamp timestamp, data_source string, windows_analyzed long, avg_bloom_flagged double, avg_exact_duplicates double, avg_true_positives double, avg_false_positives double, avg_false_negatives double, avg_precision double, avg_recall double, avg_f1_score double, median_precision double, median_recall double",
    "dup_lsh_raw": "batch_id string, processing_time timestamp, review_id string, business_id string, review_event_time timestamp, similar_review_id string, similar_business_id string, similar_event_time timestamp, approx_jaccard double, review_stars double, similar_review_stars double, review_keywords string, similar_keywords string",
    "dup_lsh_bug_summary": "business_id string, bug_pair_count long, avg_review_stars double, avg_similar_stars double, avg_jaccard double, avg_star_gap double, max_noisy_frequency double, low_star_pair_rate double, keyword_coverage long",
}
TABLES["dup_lsh_dp"] = TABLES["dup_lsh_raw"] + ", noisy_frequency double"
#: Tables that also exist for the segment of highly rated reviews.
SEGMENTED = ["metrics_1m", "dup_bloom", "gold_dup_rate_1m", "fm_distinct_users", "performance_metrics", "accuracy_fm_summary", "accuracy_bloom_summary"]
TABLES |= {f"{t}_high_rated": TABLES[t] for t in SEGMENTED}
