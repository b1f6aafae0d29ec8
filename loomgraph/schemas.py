"""Schemas of the tables that operators exchange."""

from __future__ import annotations

TYPE = "struct<label:string,uri:string,description:string>"
TERM = f"struct<surface_form:string,uri:string,description:string,type:{TYPE},provenance_ids:array<string>>"
CORPUS = f"id string, text string, terms array<{TERM}>"
MENTIONS = "doc_id string, ord long, surface_form string, uri string, description string, type_label string, type_uri string, provenance_ids array<string>"
TRIPLES = "doc_id string, ord long, subject_sf string, subject_uri string, predicate_sf string, predicate_uri string, object_sf string, object_uri string, provenance_ids array<string>"
ONTO_TRIPLE = "s string, p string, o string, o_kind string, lang string"
CLUSTERS = "canonical string, member string"
JOB_STATE = "job_id string, status string, total_docs long, processed_docs long, attempts int, created_at double, started_at double, finished_at double, error string, status_code int"
