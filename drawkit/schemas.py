"""Schemas of the tables, with their logical keys."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "drawings": "id long, filename string, original_filename string, file_type string, file_size long, upload_time timestamp_ntz, title_text string, tech_text string, all_text string, layout string, batch_id string, page_count int, pages_processed int, ocr_errors array<string>",
    "segments": "id long, drawing_id long, segment_key string, section string, ordinal int, label string, source_text string, source_hash string, translatable boolean",
    "translations": "segment_id long, target_lang string, provider string, model string, translated_text string, status string, source_hash string, glossary_hash string, error string, input_tokens int, output_tokens int, updated_at timestamp_ntz",
    "checks": "check_id long, mode string, status string, drawing_ids array<long>, root_drawing_ids array<long>, current_step string, processed_drawings int, error string, created_at timestamp_ntz, updated_at timestamp_ntz, finished_at timestamp_ntz",
    "check_drawings": "check_id long, drawing_id long, discovery string, depth int, parent_item_ids array<long>, status string, page_count int, pages_processed int, table_code string, table_name string, issues array<string>",
    "items": "id long, check_id long, drawing_id long, page_number int, row_index int, sequence_no string, code string, name string, note string, quantity string, raw_text string, extraction_status string, extraction_issue string, exempt_reason string, match_status string, matches array<struct<drawing_id:long,matched_filename:string,match_form:string>>, candidates array<struct<drawing_id:long,matched_filename:string>>, edited boolean, original struct<code:string,name:string,note:string,quantity:string>",
    "extractions": "drawing_id long, signature string, status string, rows array<struct<page_number:int,row_index:int,sequence_no:string,code:string,name:string,note:string,quantity:string,raw_text:string>>, updated_at timestamp_ntz",
    "scans": "drawing_id long, signature string, scanner string, blocks_json string, updated_at timestamp_ntz",
    "blocks": "drawing_id long, page int, pos int, text string, x double, y double, w double, h double, confidence double",
    "glossary": "source_lang string, target_lang string, source string, target string, enabled boolean, note string",
    "outcomes": "batch_id string, filename string, ok boolean, error string, ts timestamp_ntz",
}
KEYS = {
    "drawings": ["id"], "segments": ["drawing_id", "segment_key"], "translations": ["segment_id", "target_lang", "provider"], "checks": ["check_id"], "check_drawings": ["check_id", "drawing_id"],
    "items": ["id"], "extractions": ["drawing_id"], "scans": ["drawing_id"], "glossary": ["source_lang", "target_lang", "source"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
