"""Actions that put others together: packs for a task and for a newcomer, batches, reading by intent, guards of an index."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.aggregates import directory_map
from tessera.operators.lines import line_window
from tessera.operators.packing import decode_cursor, fit, json_chars, resolve_refs
from tessera.operators.routed import trimmed

TOP_FILES = 3


def task_items(pack: DataFrame) -> DataFrame:
    """pack (query_id, position, role, file_path, symbol, relation, distance, ...) with `why`: what speaks for each item."""
    filled = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    role = F.when(F.col("role") == "primary", "Primary match").otherwise("Related context")
    distance = F.concat(F.lit("Graph distance: "), F.col("distance").cast("string"))
    return pack.withColumn("why", F.array_compact(F.array(role, filled("Symbol: ", "symbol"), filled("Relationship: ", "relation"), distance)))


def task_pack(pack: DataFrame, intents: DataFrame) -> DataFrame:
    """query_id, digest, next_files: for each intent (query_id, query) what its pack holds, and the first files to open.

    A blank intent is an error; one without items has an empty pack.
    """
    counts = pack.groupBy("query_id").agg(F.count_if(F.col("role") == "primary").alias("primary"), F.count_if(F.col("role") != "primary").alias("related"))
    files = pack.where("role = 'primary'").groupBy("query_id", "file_path").agg(F.min("position").alias("position"))
    first = files.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("position", "file_path"))).where(F.col("_n") <= TOP_FILES)
    top = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "file_path"))), lambda x: x["file_path"]).alias("next_files"))
    rows = trimmed(intents.select("query_id", "query")).join(counts, "query_id", "left").join(top, "query_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    listed = F.when(F.col("next_files").isNotNull(), F.concat(F.lit(" Top files: "), F.array_join("next_files", ", "), F.lit("."))).otherwise("")
    digest = F.concat(F.lit("Intent: "), F.col("query"), F.lit(". Pack: "), number("primary"), F.lit(" primary / "), number("related"), F.lit(" related."), listed)
    return rows.select("query_id", digest.alias("digest"), F.coalesce("next_files", F.array().cast("array<string>")).alias("next_files"))


def onboarding_pack(chunks: DataFrame, files: DataFrame, candidates: list[str], next_actions: list[str], max_chars: int = 20_000, depth: int = 2, map_limit: int = 20, docs_limit: int = 5, doc_lines: int = 120, doc_chars: int = 4000) -> dict[str, Any]:
    """What a newcomer reads first: a map of the largest directories and the starts of the documents among `candidates`, in that order.

    Over the budget the map goes first, then all next actions but one, then the documents but one, then that one too.
    Only the map's and documents' limits of rows come to the driver.
    """
    largest = directory_map(chunks, depth).orderBy(F.desc("lines"), "directory").limit(max(1, map_limit))
    wanted = candidates[:1000]
    windows = line_window(files.where(F.col("file_path").isin(wanted)).dropDuplicates(["file_path"]), 1, doc_lines, doc_chars)
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("file_path")) if wanted else F.lit(0)
    docs = [r.asDict() for r in windows.orderBy(place).limit(docs_limit).collect()] if wanted and docs_limit else []
    value = {"map": [r.asDict() for r in largest.collect()], "docs": docs, "next_actions": list(next_actions)}
    order = [("map", 0), ("next_actions", 1)]
    try:
        return fit(value, [*order, ("docs", min(1, len(docs)))], max_chars)
    except ValueError:
        out = fit(value | {"map": [], "next_actions": value["next_actions"][:1], "docs": []}, [], max_chars) | {"truncated": True}
        json_chars(out)
        return out


def rows_of(result: Any, max_chars: int) -> Any:
    """A result as a JSON value: of a table as many rows as can fit a budget, in which a row has two characters at least."""
    if isinstance(result, DataFrame):
        return [json.loads(r) for r in result.select(F.to_json(F.struct("*")).alias("j")).limit(max_chars // 2 + 1).toPandas()["j"]]
    return result


def run_batch(items: list[dict[str, Any]], actions: dict[str, Callable[..., Any]], max_chars: int = 20_000, stop_on_error: bool = False) -> dict[str, Any]:
    """Runs items (id, action, payload) in order: payloads may refer to earlier results by {"$ref": "#/items/<id>/data/..."}.

    Empty ids, repeated ids, nested batches, unknown actions and failures give items with status "error"; the others go on
    unless stop_on_error. The first item that does not fit the budget ends the batch.
    """
    out: dict[str, Any] = {"items": [], "truncated": True}
    if json_chars(out) > max_chars:
        raise ValueError(f"a budget of {max_chars} characters is too small")
    out["truncated"] = False
    context: dict[str, Any] = {"items": {}}
    for item in items:
        key = str(item.get("id", "")).strip()
        result = {"id": key, "status": "error", "message": None, "data": None}
        if not key:
            result["message"] = "the id of an item must not be empty"
        elif key in context["items"]:
            result["message"] = f"the id {key} occurs twice"
        elif item["action"] == "batch":
            result["message"] = "batches do not nest"
        elif item["action"] not in actions:
            result["message"] = f"unknown action {item['action']}"
        else:
            try:
                payload = resolve_refs(item.get("payload", {}), context)
                result |= {"status": "ok", "data": rows_of(actions[item["action"]](**payload), max_chars)}
            except Exception as e:  # an item's failure is its result
                result["message"] = str(e)
        out["items"].append(result)
        if json_chars(out) > max_chars:
            out["items"].pop()
            out["truncated"] = True
            json_chars(out)
            break
        if key:
            context["items"][key] = {"status": result["status"], "message": result["message"], "data": result["data"]}
        if stop_on_error and result["status"] == "error":
            break
    return out


# Parts of questions that ask for an introduction.
ONBOARDING = (
    "onboarding", "getting started", "quick start", "where to start", "repo structure", "project structure", "architecture", "entry point", "entrypoints",
    "how to run", "how do i run", "run tests", "how to test", "build and run", "setup", "install", "ci", "deploy",
    "онбординг", "с чего начать", "как запустить", "как собрать", "как установить", "как прогнать тест", "как запустить тест", "архитектура",
    "структура репозит", "точка входа",
)
# The intent that goes on from another action's cursor.
CURSORS = {"cat": "file", "file_slice": "file", "rg": "grep", "grep": "grep", "grep_context": "grep"}


def read_intent(request: dict[str, Any]) -> str:
    """file, grep, query, onboarding, memory or recall: as told, else by the cursor, the questions, the query, the pattern and the file."""
    intent = request.get("intent") or "auto"
    if intent != "auto":
        return intent
    given = lambda name: (request.get(name) or "").strip()
    if given("cursor"):
        cursor = decode_cursor(given("cursor"))
        found = cursor.get("mode") if cursor.get("tool") == "read_pack" else CURSORS.get(cursor.get("tool", ""))
        if found not in ("file", "grep", "recall", "memory"):
            raise ValueError("invalid cursor")
        return found
    questions = [q.strip() for q in request.get("questions") or [] if q.strip()]
    asked = [t for t in (given("ask"), *questions, given("query")) if t]
    if any(needle in t.lower() for t in asked for needle in ONBOARDING):
        return "onboarding"
    if given("ask") or questions:
        return "recall"
    return next((intent for name, intent in (("query", "query"), ("pattern", "grep"), ("file", "file")) if given(name)), "memory")


def read_pack(request: dict[str, Any], readers: dict[str, Callable[[dict[str, Any]], Any]], max_chars: int = 20_000) -> dict[str, Any]:
    """Reads by intent under one budget: `readers` give a table or a list for a request; rows go from the end until all fits."""
    intent = read_intent(request)
    if intent not in readers:
        raise ValueError(f"unknown intent {intent}")
    return fit({"intent": intent, "items": rows_of(readers[intent](request), max_chars)}, [("items", 0)], max_chars)


def list_symbols(chunks: DataFrame) -> DataFrame:
    """file_path, symbol_name, chunk_type, start_line: the named chunks, in order."""
    return chunks.where(F.col("symbol_name").isNotNull()).select("file_path", "symbol_name", "chunk_type", "start_line").orderBy("file_path", "start_line", "symbol_name")


def freshness_gate(exists: bool, reasons: list[str], policy: str, reindex: Callable[[], tuple[bool, list[str]]] | None = None) -> list[str]:
    """Warnings for working with an index of which it is known whether it exists and why it is stale.

    With policy "auto" a missing or stale index is built anew first, by `reindex`, which gives its state thereafter. An
    index that does not exist is an error, and so is with "fail" a stale one; else staleness is a warning.
    """
    if policy not in ("auto", "warn", "fail"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "auto" and reindex and (reasons or not exists):
        exists, reasons = reindex()
    if not exists:
        raise LookupError("there is no index")
    if not reasons:
        return []
    if policy == "fail":
        raise LookupError(f"the index is stale ({', '.join(reasons)})")
    return [f"the index is stale ({', '.join(reasons)}); going on by policy {policy}"]


def run_within(spark: SparkSession, seconds: float, work: Callable[[Callable[[], None]], Any]) -> Any:
    """What `work` gives, if that takes no more than `seconds`; else its running jobs are cancelled and TimeoutError is raised.

    `work` gets a function to call between its steps, which raises when time is over.
    """
    group, over = f"within-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    def check() -> None:
        if over.is_set():
            raise TimeoutError(f"not done within {seconds} s")

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "time-budgeted run", interruptOnCancel=True)
    timer.start()
    try:
        result = work(check)
        check()
        return result
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"not done within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
