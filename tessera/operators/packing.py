"""Packs under a budget of characters."""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.ranking import OTHER_CAP, QUERY_BLOCK, RELATION_CAPS, against_all
from tessera.sources.work import held

ITEM_COST = 128
PACK = "query_id long, position int, role string, item string, relation string, cost long, used long, truncated boolean"


def item_cost(content: str, imports: list[str]) -> int:
    return len(content.encode()) + sum(len(i.encode()) + 1 for i in imports) + ITEM_COST


def pack_items(primaries: list[dict], related: dict[str, list[dict]], max_chars: int, per_primary: int) -> list[dict]:
    """Primaries in order up to the first over the budget, which also ends the pack; else related items in turns.

    In a turn each primary gives its next item that is new and within the cap of its relation.
    """
    out, used, seen, full, taken = [], 0, set(), False, []
    for p in primaries:
        if p["item"] in seen:
            continue
        seen.add(p["item"])
        if used + p["cost"] > max_chars:
            full = True
            break
        used += p["cost"]
        out.append({"role": "primary", "relation": None, "used": used} | p)
        taken.append((iter(related.get(p["item"], [])), {}))
    counts = [0] * len(taken)
    while not full:
        before = len(out)
        for i, (queue, by_relation) in enumerate(taken):
            if counts[i] >= per_primary:
                continue
            for r in queue:
                n = by_relation.get(r["relation"], 0)
                if n >= RELATION_CAPS.get(r["relation"], OTHER_CAP) or r["item"] in seen:
                    continue
                seen.add(r["item"])
                if used + r["cost"] > max_chars:
                    full = True
                    break
                used += r["cost"]
                out.append({"role": "related", "used": used} | r)
                by_relation[r["relation"]] = n + 1
                counts[i] += 1
                break
            if full:
                break
        if len(out) == before:
            break
    return [o | {"position": i, "truncated": full} for i, o in enumerate(out)]


def context_pack(primaries: DataFrame, related: DataFrame, max_chars: int = 20_000, per_primary: int = 3) -> DataFrame:
    """Packs each query's primaries (query_id, item, rank, cost) and related items (query_id, primary, item, relation, relevance, cost).

    The greedy choice is made on what it can come to of a query: primaries up to the first over the budget and, where there is none, of each
    relation of a primary the first distinct items, as many as may be taken or be in the pack already. Related items of no primary of their query go.
    """
    place = lambda c: F.when(~F.isnan(c), c).alias("order")
    ordered = [F.col("order").asc_nulls_last(), F.col("item").asc_nulls_last(), F.col("cost")]
    rank = F.col("rank").cast("double")
    first = primaries.select("query_id", "item", place(rank), "cost").withColumn("_n", F.row_number().over(W.partitionBy("query_id", "item").orderBy(*ordered))).where("_n = 1").drop("_n")
    so_far = W.partitionBy("query_id").orderBy(*ordered).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = first.withColumn("_over", F.sum("cost").over(so_far) > max_chars).withColumn("_overs", F.count_if("_over").over(so_far)).where("_overs <= 1")
    first = held(first.select("query_id", "item", "order", "cost", "_over"), "pack-primaries")

    # what a pack may hold bounds how many items of a queue are passed over
    fits = first.groupBy("query_id").agg(F.bool_or("_over").alias("_full"), F.count(F.lit(1)).alias("_many")).where("NOT _full")
    fits = fits.select(F.col("query_id").alias("_query"), (F.col("_many") * (1 + per_primary) + per_primary + 1).alias("_most"))
    fits = first.join(fits, F.col("query_id").eqNullSafe(F.col("_query"))).select("_query", F.col("item").alias("_item"), "_most")
    met = related.join(fits, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("primary") == F.col("_item")))
    met = met.select("query_id", "primary", "item", "relation", place(-F.col("relevance").cast("double")), "cost", "_most")
    queue = W.partitionBy("query_id", "primary", "relation")
    once = met.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "primary", "relation", "item").orderBy(*ordered))).where("_n = 1")
    near = once.withColumn("_n", F.row_number().over(queue.orderBy(*ordered))).where("_n <= _most").drop("_n", "_most")
    none = F.lit(None).cast("string")
    rows = first.select("query_id", none.alias("primary"), "item", none.alias("relation"), "order", "cost").unionByName(near)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "item", "relation", "cost"])
        queues: dict[str, list[dict]] = {}
        for r in part[part["primary"].notna()].to_dict("records"):
            queues.setdefault(r["primary"], []).append({"item": r["item"], "relation": r["relation"], "cost": r["cost"]})
        first = [{"item": r["item"], "cost": r["cost"]} for r in part[part["primary"].isna()].to_dict("records")]
        out = pd.DataFrame(pack_items(first, queues, max_chars, per_primary), columns=["position", "role", "item", "relation", "cost", "used", "truncated"])
        out.insert(0, "query_id", part["query_id"].iloc[0])
        return out[[c.split()[0] for c in PACK.split(", ")]]

    return rows.groupBy("query_id").applyInPandas(pack, PACK)


def term_hits(records: DataFrame, queries: DataFrame, text: str) -> DataFrame:
    """query_id, the columns of records but `text`, _hits: how many of a query's terms stand in the text, where any does.

    Queries (query_id, terms) go to the tasks in blocks of QUERY_BLOCK; a block's terms are found in one pass over each text, whatever their number.
    """
    rest = [c for c in records.columns if c != text]
    schema = StructType([queries.schema["query_id"], *(records.schema[c] for c in rest), StructField("_hits", IntegerType())])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        by_term: dict[str, list] = {}
        for r in own.select("query_id", "terms").collect():
            for term in r.terms or ():
                by_term.setdefault(term, []).append(r.query_id)
        empty = by_term.pop("", [])  # stands in every text

        def run(batches: Iterator[pa.RecordBatch], by_term=by_term, empty=empty) -> Iterator[pa.RecordBatch]:
            finder = ahocorasick.Automaton()
            for term, asked in by_term.items():
                finder.add_word(term, (term, asked))
            finder.make_automaton()
            for batch in batches:
                at, query_ids, hits = [], [], []
                for i, said in enumerate(batch.column(text).to_pylist()):
                    found = Counter(empty)
                    if by_term and said is not None:
                        found.update(q for asked in dict(v for _, v in finder.iter(said)).values() for q in asked)
                    at += [i] * len(found)
                    query_ids += found.keys()
                    hits += found.values()
                own = [c.take(pa.array(at, pa.int64())) for c in batch.select(rest).columns]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids, to_arrow_type(schema[0].dataType)), *own, pa.array(hits, pa.int32())], names=schema.names)

        found = records.select(*rest, text).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def memory_rank(candidates: DataFrame, queries: DataFrame, priority: dict[str, int], k: int = 3, per_kind: int = 2) -> DataFrame:
    """query_id, conv_id, turn, rank: records (conv_id, turn, kind, text) with words of the query first, then the rest by priority and recency.

    At most per_kind of a kind, k in all. Records without such words rank alike for all queries, so that only the
    first of each kind meet the queries: a kind with fewer than per_kind hits is filled from twice as many.
    """
    order = F.lit(99)
    for kind, p in priority.items():
        order = F.when(F.col("kind") == kind, p).otherwise(order)
    rows = candidates.select("conv_id", "turn", "kind", order.alias("_p"), F.lower("text").alias("_low"))
    first = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("turn"), "conv_id"))
    fill = rows.withColumn("_n", first).where(F.col("_n") < 2 * per_kind).drop("_n")
    hits = F.coalesce(F.size(F.filter("terms", lambda t: F.contains("_low", t))), F.lit(0))

    def met(records: DataFrame) -> DataFrame:
        return against_all(records, queries.select("query_id", "terms")).select("query_id", "conv_id", "turn", "kind", "_p", hits.alias("_hits"))

    scored = term_hits(rows, queries, "_low").unionByName(met(fill).where("_hits = 0"))
    best = [F.desc(F.col("_hits") > 0), F.col("_p"), F.desc("_hits"), F.desc("turn"), F.col("conv_id")]
    capped = scored.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "kind").orderBy(*best))).where(F.col("_n") <= per_kind)
    return capped.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "conv_id", "turn", "rank")


def json_chars(value: dict[str, Any]) -> int:
    """Characters of a value's JSON; its used_chars is set such that it counts itself."""
    value["used_chars"] = 0
    for _ in range(8):
        size = len(json.dumps(value, ensure_ascii=False))
        if value["used_chars"] == size:
            break
        value["used_chars"] = size
    return value["used_chars"]


def fit(value: dict[str, Any], lists: list[tuple[str, int]], max_chars: int) -> dict[str, Any]:
    """Pops items from lists in `value` until its JSON fits, from the first list that has more than its least number; too small a budget is an error."""
    out = value | {name: list(value[name]) for name, _ in lists} | {"truncated": False}
    while json_chars(out) > max_chars:
        name = next((name for name, least in lists if len(out[name]) > least), None)
        if name is None:
            raise ValueError(f"a budget of {max_chars} characters is too small")
        out[name].pop()
        out["truncated"] = True
    return out


def shrink_to(value: dict[str, Any], items: str, max_chars: int) -> dict[str, Any]:
    """Pops items from one list in `value` until its JSON fits, with used_chars as what that JSON has."""
    return fit(value, [(items, 0)], max_chars)


def encode_cursor(cursor: dict) -> str:
    """URL-safe token of a JSON value, deflated where that is shorter."""
    raw = json.dumps(cursor, separators=(",", ":")).encode()
    if len(raw) > 4096:
        raise ValueError("cursor too long")
    packed = zlib.compress(raw)
    body = b"z" + packed if len(packed) < len(raw) else b"j" + raw
    return base64.urlsafe_b64encode(body).decode().rstrip("=")


def decode_cursor(token: str) -> dict:
    if len(token) > 8192:
        raise ValueError("cursor too long")
    body = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    return json.loads(zlib.decompress(body[1:]) if body[:1] == b"z" else body[1:])


def resolve_refs(value: Any, context: Any, depth: int = 64) -> Any:
    """Replaces {"$ref": "#/pointer", "$default": x} within a JSON value by what the pointer finds in the context."""
    if depth < 0:
        raise ValueError("references nest too deeply")
    if isinstance(value, list):
        return [resolve_refs(v, context, depth - 1) for v in value]
    if not isinstance(value, dict):
        return value
    if "$ref" not in value:
        return {k: resolve_refs(v, context, depth - 1) for k, v in value.items()}
    found = context
    for part in value["$ref"].removeprefix("#").strip("/").split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            found = found[int(part)] if isinstance(found, list) else found[part]
        except (KeyError, IndexError, ValueError, TypeError):
            if "$default" in value:
                return value["$default"]
            raise ValueError(f"unresolved reference {value['$ref']}") from None
    return found
