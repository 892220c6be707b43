"""Schemas of the tables that the library reads and writes, as DDL."""

from __future__ import annotations

BASE = "datokode string, source struct<lti: string, urn: string, page: int, booklet: string, llm: boolean, llm_model: string>, base_as_of string, provisions map<string, string>"
PROVISION = "law string, para string, ordinal int, text string"
RAW_OP = "act_refid string, act_title string, target_law string, target string, paragraph string, change_type string, instruction string, new_text string, date_in_force_resolved string, date_in_force string, date_published string, source string"
OP = "law string, act string, para string, change_type string, instruction string, new_text string, date string, stream_rank int, line_no long, piece_no int"
OVERRIDE = "act_refid string, target_law string, instruction string, new_text string"
REFORM = "act_refid string, target_law string, term_old string, term_new string, change_type string, date_in_force_resolved string, date_in_force string, source string"
IN_FORCE = "datokode string, own_date string, trigger_dates array<string>, resolved string, status string"
PAGE = "issue_id string, urn string, page int, text string"
CATALOGUE = "id string, title string, issued string, pageCount int, isDigital boolean, license string"
EDGE = "act_id string, act_title string, act_date string, target_law string, target_law_title string, provision string, change_type string, verb_raw string, in_force string, source_ref string, provenance string"
TRUTH_INDEX = "datokode string, valid_from_date string, filename string, source string, era string, size_class string, amendment_intensity string"
FLAG = "law string, para string, why string, date string, instruction string"
