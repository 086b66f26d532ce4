"""Declared schemas of every table the library reads or writes."""

from __future__ import annotations

PULSE = (
    "id string, name string, description string, created string, tags array<string>, "
    "references array<string>, author struct<username: string>"
)
PULSE_PAGE = f"results array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in PULSE.split(', '))}>>"

THREAT = (
    "row_id bigint, id string, name string, description string, tags string, created_date string, "
    "references string, source string, author string"
)
SCORES = (
    "risk_score double, similarity_score double, keyword_score double, novelty_score double, "
    "most_similar_idx int, matched_keywords string, num_keywords_matched int, cluster int"
)
SCORED = f"{THREAT}, {SCORES}"
CLUSTER_STATS = (
    "cluster_id int, size bigint, percentage double, top_tags string, sample_threats string, std_dev double"
)
DUPLICATE_REPORT = (
    "original_idx bigint, duplicate_idx bigint, similarity double, original_name string, duplicate_name string"
)
INCIDENT = (
    "idx int, id string, name string, date date, description string, severity string, "
    "mitre_tactics array<string>"
)
METRICS = "run_id string, key string, value double"
