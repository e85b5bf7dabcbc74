"""Declared schemas of the engine's tables; closed vocabularies are strings checked by value."""

from __future__ import annotations

SCHEMAS = {
    "sources": "id long, name string, type string, trust_level decimal(2,1), disabled boolean, tier short, min_request_interval_seconds decimal(4,2), deleted_at timestamp_ntz",
    "source_urls": "id long, source_id long, url string, js_code string, sort_order int, deleted_at timestamp_ntz",
    "crawl_configs": "id long, source_id long, crawl_frequency int, crawl_after date, force_crawl boolean, last_crawled_at timestamp_ntz, crawl_mode string, json_api_config string, default_tags array<string>, num_clicks int, max_pages int, max_batches int, notes string",
    "crawl_jobs": "id long, status string, started_at timestamp_ntz, completed_at timestamp_ntz",
    "crawl_results": "id long, crawl_job_id long, source_id long, status string, crawled_at timestamp_ntz, extracted_at timestamp_ntz, processed_at timestamp_ntz, error_message string, extraction_provider string, extraction_model string, extraction_attempts int, extraction_fallbacks int, created_at timestamp_ntz",
    "crawl_contents": "crawl_result_id long, crawled_content string, extracted_content string",
    "crawl_url_results": "id long, crawl_result_id long, url string, status string, crawled_content string, error_message string, created_at timestamp_ntz, crawled_at timestamp_ntz",
    "crawl_summaries": "crawl_job_id long, api_calls int, input_tokens long, output_tokens long, thinking_tokens long, estimated_cost decimal(10,6), providers_used map<string,int>, rate_limited_count int, created_at timestamp_ntz",
    "extracted_events": "id long, crawl_result_id long, location_id long, name string, short_name string, location_name string, sublocation string, description string, emoji string, url string, occurrences string, tags string",
    "extracted_event_logs": "extracted_event_id long, status string, event_id long, message string",
    "events": "id long, name string, short_name string, description string, emoji string, location_id long, sublocation string, status string, reviewed boolean, created_at timestamp_ntz, deleted_at timestamp_ntz",
    "event_occurrences": "id long, event_id long, start_date date, start_time string, end_date date, end_time string",
    "event_urls": "id long, event_id long, url string",
    "event_tags": "event_id long, tag_id long",
    "location_tags": "location_id long, tag_id long",
    "event_sources": "id long, event_id long, extracted_event_id long, source_id long, trust_score decimal(2,1), is_primary boolean, created_at timestamp_ntz",
    "locations": "id long, name string, short_name string, very_short_name string, address string, description string, lat decimal(10,6), lng decimal(10,6), emoji string, alt_emoji string, website_url string, type string, deleted_at timestamp_ntz",
    "location_alternate_names": "id long, location_id long, alternate_name string",
    "tags": "id long, name string",
    "tag_rules": "id long, rule_type string, pattern string, replacement string, deleted_at timestamp_ntz",
}

# Closed vocabularies in their declared order, which is also their sort order.
VOCABULARIES = {
    "crawl_results.status": ["pending", "crawled", "extracted", "processed", "failed"],
    "crawl_jobs.status": ["running", "completed", "failed"],
    "events.status": ["active", "archived", "draft", "cancelled"],
    "tag_rules.rule_type": ["rewrite", "exclude", "remove"],
    "extracted_event_logs.status": ["created", "merged", "skipped_no_location", "skipped_no_occurrences", "skipped_duplicate", "skipped_tag_removed"],
}
