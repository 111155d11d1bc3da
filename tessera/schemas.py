"""Schemas of the engine's tables; nothing is ever inferred."""

from __future__ import annotations

CHUNKS = "file_path string, start_line int, end_line int, content string, language string, chunk_type string, symbol_name string, parent_scope string, qualified_name string, documentation string, context_imports array<string>, tokens long"
NODES = "node_id long, name string, qualified_name string, file_path string, start_line int, end_line int, symbol_type string, chunk_id string"
EDGES = "src long, dst long, rel string, weight double"
EMBEDDINGS = "chunk_id string, model_id string, template_hash string, doc_hash string, vector array<float>"
FILE_STATE = "file_path string, mtime_ms long"
WATERMARK = "kind string, git_head string, git_dirty boolean, dirty_hash string, file_count long, max_mtime_ms long, total_bytes long"
CASES = "case_id string, query string, expected_paths array<string>, expected_symbols array<string>, intent string"
ANCHORS = "anchor_id string, kind string, file_path string, start_line int, end_line int, sha256 string"
EVENTS = "path string, ts timestamp"
