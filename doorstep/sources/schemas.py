"""Declared schemas of the domain tables and the raw payloads."""

from __future__ import annotations

# One DDL string per table; reads project these columns and nothing else.
TABLES = {
    "businesses": (
        "id string, place_id string, name string, niche_id string, country string, "
        "state string, city string, search_area string, address string, lat double, "
        "lng double, phone string, email string, website string, instagram_handle string, "
        "facebook_url string, first_seen_at timestamp, last_seen_at timestamp, dedupe_key string"
    ),
    "contacts": (
        "id bigint, business_id string, name string, role string, phone string, email string, "
        "source string, source_url string, confidence float, found_at timestamp"
    ),
    "enrichments": (
        "id bigint, business_id string, source string, status string, data string, "
        "source_url string, fetched_at timestamp, run_id string"
    ),
    "scores": (
        "id bigint, business_id string, scorer_version string, total int, demand int, "
        "website_gap int, budget int, reachability int, signals string, evidence string, "
        "scored_at timestamp, audience_index double"
    ),
    "verdicts": (
        "business_id string, my_verdict string, notes string, contacted_on date, "
        "channel string, outcome string, updated_at timestamp"
    ),
    "outreach": (
        "id bigint, business_id string, kind string, channel string, body string, "
        "evidence string, created_at timestamp"
    ),
    "automation_opportunities": (
        "id bigint, business_id string, opportunity_id string, confidence float, "
        "trigger_signals string, evidence string, detected_at timestamp"
    ),
    "goals": (
        "id string, name string, spec string, schedule string, status string, "
        "created_at timestamp"
    ),
    "runs": (
        "id string, goal_id string, status string, trigger string, stats string, "
        "started_at timestamp, finished_at timestamp"
    ),
    "tasks": (
        "id bigint, run_id string, type string, idem_key string, payload string, "
        "status string, priority int, available_at timestamp, attempts int, "
        "max_attempts int, locked_by string, lease_expires timestamp, result string, "
        "error string"
    ),
    "events": (
        "id bigint, run_id string, task_id bigint, seq int, type string, payload string, "
        "created_at timestamp"
    ),
    "search_cells": (
        "id bigint, goal_id string, niche_id string, area string, tile_lat double, "
        "tile_lng double, tile_radius_m int, query_variant string, next_page int, "
        "status string, new_yield int, total_yield int, last_searched_at timestamp, "
        "exhausted_at timestamp"
    ),
    "geo_cache": (
        "query string, formatted string, lat double, lng double, country_code string, "
        "resolver string, resolved_at timestamp"
    ),
    "negative_cache": (
        "business_id string, source string, misses int, retry_after timestamp, "
        "updated_at timestamp"
    ),
    "memories": (
        "id bigint, scope string, scope_id string, kind string, content string, "
        "embedding array<float>, confidence float, source_run string, expires_at timestamp, "
        "created_at timestamp"
    ),
    "run_summaries": (
        "run_id string, narrative string, decisions string, open_issues string, "
        "embedding array<float>"
    ),
    "agent_notes": "id bigint, run_id string, key string, value string, updated_at timestamp",
    "llm_calls": (
        "id bigint, prompt_hash string, provider string, model string, input_tokens int, "
        "output_tokens int, cost_usd decimal(10,6), latency_ms int, status string, "
        "response string, created_at timestamp"
    ),
    "llm_rate_buckets": (
        "provider string, tokens double, refilled_at timestamp, circuit_state string, "
        "consecutive_failures int, opened_at timestamp"
    ),
    "search_budget": (
        "provider string, purpose string, key_fingerprint string, limit_total int, used int, "
        "updated_at timestamp"
    ),
    "niche_status": (
        "niche_id string, state string, qualified int, rejected int, rejected_types string, "
        "last_seen_at timestamp"
    ),
}

# Raw payloads. Fields that arrive as text or number are read as text.
LISTING_PLACE = (
    "struct<position int, title string, place_id string, "
    "gps_coordinates struct<latitude string, longitude string>, rating string, "
    "reviews string, type string, types array<string>, address string, phone string, "
    "website string>"
)
SEARCH_RESPONSE = (
    "query string, results array<struct<position int, site_name string, title string, "
    "snippet string, url string, date string>>"
)
FETCH_RESPONSE = (
    "results array<struct<url string, final_url string, title string, text string>>, "
    "errors array<struct<url string, error string, status int>>"
)
