"""The actions of the engine, as functions from tables to tables."""

from __future__ import annotations

from tessera.functions.paths import path_allowed
from tessera.operators.actions import freshness_gate, list_symbols, onboarding_pack, read_pack, run_batch, run_within, task_items, task_pack
from tessera.operators.aggregates import directory_map, directory_symbols, index_stats, overview, repo_signals, rolling_percentile
from tessera.operators.ann import GraphIndex
from tessera.operators.ann import add as add_vectors
from tessera.operators.ann import build_index as build_vector_index
from tessera.operators.ann import remove as remove_vectors
from tessera.operators.ann import search as search_vectors
from tessera.operators.anchors import anchor_hits, detect_anchor, direct_paths, direct_symbols, first_source, focus_related, graph_boost, guard, lexical_fallback, parse_directives, reasons
from tessera.operators.chunking import ChunkConfig, chunk_by_lines, chunk_by_tokens, chunk_files, chunk_stats, drop_shadowed
from tessera.operators.configs import asyncapi_flows, build_steps, config_entries, pipeline_steps
from tessera.operators.evaluate import compare, compare_summary, map_noise, overlap_with_baseline, precision_at_k, run_summary, score_cases, summarize, token_saved
from tessera.operators.graph import assemble, build_graph, context_nodes, entry_points, explain, graph_docs, hotspots, impact, impact_report, mermaid, neighbours, reach, related_tests, search_doc_store, shortest_paths, text_usages, update_doc_store, usages_with_text
from tessera.operators.lines import enclosing_chunks, evidence, grep_hunks, grep_page, line_window, literal_search, merge_intervals, overlap_dedupe, similar_neighbours
from tessera.operators.orient import classify_files, directory_rows, meaning_focus, meaning_pack, notebook_staleness, select_anchors, worktree_pack
from tessera.operators.packing import context_pack, decode_cursor, encode_cursor, memory_rank, resolve_refs, shrink_to
from tessera.operators.packs import orientation_pack, pack_texts, shrink_packs
from tessera.operators.ranking import normalize_scores, round_robin, rrf, running_budget
from tessera.operators.retrieval import bm25, fuzzy_match, hybrid_search, term_hits
from tessera.operators.routed import arrange_primaries, routed_search, search_by_text, without_docs
from tessera.operators.syntax import build_code_graph, code_references, code_scopes, within_scopes
from tessera.operators.vector import embed_missing, multi_model, recall_at_k, vector_topk
from tessera.profile import FAST, GENERAL, QUALITY, Profile, load_profile
from tessera.sources.files import filter_paths, list_directory, load_cases, scan
from tessera.sources.git import changed_paths, copy_areas, git_watermark, working_copies
from tessera.sources.ignore import drop_ignored, ignore_rules
from tessera.sources.sinks import changed_files, filesystem_watermark, missing_vectors, purge_missing, replace_table, staleness, upsert_files
from tessera.sources.snapshots import SnapshotLog, index_cycle, index_on_batches
from tessera.streaming.debounce import debounce_batch, debounce_stream, dedup_stream, run_cycles
from tessera.streaming.windows import change_windows

#: Action names with the function that answers them.
ACTIONS = {
    "search": routed_search, "search_with_context": assemble, "context_pack": context_pack, "meaning_pack": orientation_pack, "meaning_focus": meaning_focus,
    "task_pack": task_pack, "text_search": literal_search, "grep": grep_page, "evidence_fetch": evidence, "index": chunk_files, "get_context": enclosing_chunks,
    "list_symbols": list_symbols, "compare_search": overlap_with_baseline, "map": directory_map, "repo_onboarding_pack": onboarding_pack, "eval": score_cases,
    "eval_compare": compare, "impact": impact_report, "trace": shortest_paths, "explain": explain, "overview": overview, "ls": list_directory, "cat": line_window,
    "worktree_pack": worktree_pack, "notebook_pack": notebook_staleness, "batch": run_batch, "read_pack": read_pack,
}

__all__ = [name for name in dir() if not name.startswith("_")]
