"""Explicit schemas of the inputs and of the long tables that the operators exchange."""

from __future__ import annotations

RAW_PAPER = "id STRING, title STRING, abstract STRING, authors STRING, categories STRING, update_date STRING"
PAPER = "paper_id STRING, title STRING, abstract STRING, authors STRING, category STRING, year INT"
POINT = f"vec_id BIGINT, embedding ARRAY<FLOAT>, {PAPER}, institution_label STRING, affiliations ARRAY<STRING>"
QUERY_AUDIT = "query STRING, relevant_ids ARRAY<STRING>"
QUERY_STANCE = "id INT, category STRING, query STRING"
QRELS_FLAT = "query STRING, paper_id STRING, title STRING, relevance INT"
_JUDGMENT = "ARRAY<STRUCT<paper_id: STRING, doc_id: STRING, title: STRING, relevance: INT>>"
QRELS_NESTED = f"query STRING, judgments {_JUDGMENT}, candidates {_JUDGMENT}, paper_id STRING, title STRING, relevance INT"
AFFILIATION_CACHE = "MAP<STRING, ARRAY<STRING>>"
WORK_GRAPH = (
    "title STRING, authorships ARRAY<STRUCT<institutions: ARRAY<STRUCT<display_name: STRING>>, raw_affiliation_strings: ARRAY<STRING>>>, "
    "locations ARRAY<STRUCT<landing_page_url: STRING, source: STRUCT<display_name: STRING, host_organization_name: STRING, type: STRING>>>"
)
WORK_AUTHORS = "authors ARRAY<STRUCT<affiliations: ARRAY<STRING>>>"
WORK_DOI = "message STRUCT<author: ARRAY<STRUCT<affiliation: ARRAY<STRUCT<name: STRING>>>>>"
LABELS = ("privileged", "underrepresented", "unknown")
