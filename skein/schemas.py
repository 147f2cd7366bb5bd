"""Schemas of the engine's tables; reads never infer them."""

from __future__ import annotations

MESSAGES = "store_id long, session_id string, source string, conversation_id string, role string, content string, tool_call_id string, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>, tool_name string, timestamp double, token_estimate int, pinned boolean, ingested_at double, observed_at double, observed_at_source string"
NODES = "node_id long, session_id string, depth int, summary string, token_count long, source_token_count long, source_ids array<long>, source_type string, created_at double, earliest_at double, latest_at double, expand_hint string"
VECTORS = "row_id long, kind string, session_id string, embedding array<double>, archived boolean, timestamp double"
ROLLUPS = "scope string, period_kind string, period_start date, summary string, token_count int, status string, source_fingerprint string, generation int"
INVALIDATIONS = "event_id long, scope string, covered_start double, covered_end double, next_day date, operation string"
ASSERTIONS = "assertion_id string, source_store_id long, subject_key string, predicate_key string, object_json string, value_text string, kind string, polarity string, scope_key string, speaker_role string, observed_at double, event_at double, valid_from double, valid_to double, span_start int, span_end int, quote string, confidence double"
RELATIONS = "relation_id string, from_id string, type string, to_id string, source_store_id long"
STATES = "trajectory_id string, ordinal int, state_index int, step int, url string, incoming_action string, thoughts string, text string, observed_at double, occurred_at double"
PAYLOADS = "ref string, kind string, session_id string, tool_call_id string, role string, content string, chars long, bytes long"
