"""Schemas of the event log and the dimension tables, and the driver tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row per version of a fact; (source, source_id, payload_hash) tells versions apart.
EVENTS = "source string, source_id string, entity_id string, event_type string, observed_at timestamp, occurred_at timestamp, payload_hash string, payload string, schema_version int"

TABLES = {
    "events": EVENTS,
    "adapter_cursor": "source string, cursor string, updated_at timestamp",
    "cache": "cache_key string, payload string, fetched_at timestamp, expires_at timestamp",
    "legislators": "bioguide_id string, first_name string, last_name string, full_name string, chamber string, state string, district int, party string, served_from date, served_until date, ids string, updated_at timestamp",
    "bills": "bill_id string, congress int, bill_type string, number int, title string, sponsor_bioguide string, introduced_date date, latest_action_date date, latest_action_text string, policy_area string, url string, text_versions string, cosponsor_count int, updated_at timestamp",
    "committees": "committee_code string, name string, chamber string, committee_type string, parent_code string, url string, updated_at timestamp",
    "committee_assignments": "bioguide_id string, committee_code string, party string, rank_in_party int, title string, updated_at timestamp",
    "lda_filings": "filing_uuid string, filing_year int, filing_period string, dt_posted timestamp, income decimal(18,3), expenses decimal(18,3), registrant_id string, registrant_name string, client_id string, client_name string, activity_count int, issue_codes array<string>, bill_refs array<string>, raw_url string, updated_at timestamp",
    "funding_totals": "bioguide_id string, cycle int, fec_id string, receipts decimal(18,3), disbursements decimal(18,3), cash_on_hand decimal(18,3), debts decimal(18,3), individual decimal(18,3), coverage_start date, coverage_end date, last_report_label string, fetched_at timestamp",
    "fec_id_resolutions": "bioguide_id string, cycle int, fec_id string, source string, resolved_at timestamp",
    "district_pvi": "congress int, state string, district int, pvi string, score int, source string, updated_at timestamp",
    "legislator_social": "bioguide_id string, twitter string, twitter_id bigint, youtube string, youtube_id string, instagram string, instagram_id bigint, facebook string, updated_at timestamp",
    "bill_text": "bill_id string, version_code string, version_label string, body string, line_count int, sha256 string, package string, source_url string, last_modified timestamp, fetched_at timestamp",
    "bill_summaries": "bill_id string, version_code string, action_date date, action_desc string, summary_text string, update_date timestamp",
    "bill_text_summary": "bill_id string, from_code string, to_code string, sha256_pair string, model string, tier string, summary_md string, input_tokens int, output_tokens int, chunk_count int, generated_at timestamp",
    "photo_cache": "bioguide_id string, size string, url string, source string, fetched_at timestamp",
    "page_view": "ts timestamp, path string, status smallint, method string, referer_host string, ua string, is_bot boolean, visitor_hash string, dur_ms int",
}

KEYS = {
    "adapter_cursor": ["source"], "cache": ["cache_key"], "legislators": ["bioguide_id"], "bills": ["bill_id"], "committees": ["committee_code"],
    "committee_assignments": ["bioguide_id", "committee_code"], "lda_filings": ["filing_uuid"], "funding_totals": ["bioguide_id", "cycle"],
    "fec_id_resolutions": ["bioguide_id", "cycle"], "district_pvi": ["congress", "state", "district"], "legislator_social": ["bioguide_id"],
    "bill_text": ["bill_id", "version_code"], "bill_summaries": ["bill_id", "version_code", "action_date"],
    "bill_text_summary": ["bill_id", "from_code", "to_code"], "photo_cache": ["bioguide_id", "size"], "events": ["source", "source_id", "payload_hash"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
