"""Hybrid retrieval: lexical statistics, fuzzy matching, boosts, reranking, and the whole search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from tessera.functions import paths, text
from tessera.operators.alignment import aligned_pairs, matches
from tessera.operators.ranking import ADAPTIVE_K, QUERY_BLOCK, against_all, normalize_scores, passes_thresholds, ranked, rrf, top_k
from tessera.operators.vector import vector_topk
from tessera.profile import GENERAL, Profile
from tessera.sources.work import held

PREVIEW = 200
MIN_AVGDL = 1e-3
#: Distinct terms of all queries that are sent to the tasks.
MANY_TERMS = 100_000


def term_hits(chunks: DataFrame, queries: DataFrame, window: int) -> DataFrame:
    """query_id, item, hits: the query terms of each chunk in order, the first `window` of them.

    chunks: item, content; queries: query_id, terms. Words meet terms by an equi-join, so only rows with a
    term leave their task; up to MANY_TERMS terms are sent to the tasks first, so that other words are no rows at all.
    """
    terms = queries.select("query_id", F.explode("terms").alias("term"))
    known = [r.term for r in terms.select("term").distinct().limit(MANY_TERMS + 1).collect()]
    said = chunks.select("item", text.words_of(F.col("content")).alias("words"))
    words = said.select("item", F.posexplode("words").alias("pos", "term")) if len(known) > MANY_TERMS else _known_words(said, known)
    found = words.join(terms, "term").groupBy("query_id", "item").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("all"))
    return found.select("query_id", "item", F.transform(F.slice("all", 1, window), lambda x: x["term"]).alias("hits"))


def _known_words(said: DataFrame, known: list[str]) -> DataFrame:
    """item, pos, term: the places of known words in lists of words."""
    schema = StructType([said.schema["item"], StructField("pos", IntegerType()), StructField("term", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known, pa.string())
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten()
            at = pc.indices_nonzero(pc.is_in(flat, value_set=wanted)).to_numpy()
            ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            row = np.searchsorted(ends, at, side="right")
            pos = at.astype(np.int64) - np.concatenate(([0], ends))[row]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(pos, pa.int32()), flat.take(pa.array(at)).cast(pa.string())], names=schema.names)

    return said.mapInArrow(run, schema)


def bm25(hits: DataFrame, k1: float, b: float, weight: float) -> DataFrame:
    """query_id, item, bm25: statistics over the candidates with a hit; a length is the number of hits."""
    rows = hits.where(F.size("hits") > 0)
    stats = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.size("hits")), F.lit(MIN_AVGDL)).alias("avgdl"))
    tf = rows.select("query_id", "item", F.size("hits").alias("dl"), F.explode("hits").alias("term")).groupBy("query_id", "item", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, ["query_id", "term"]).join(stats, "query_id")
    return scored.groupBy("query_id", "item").agg((F.sum(part) * weight).alias("bm25"))


def target_points(target: str, atoms: list[str]) -> int:
    """Points of a target for a query's atoms: the length of each, fourfold if equal, threefold for a
    prefix, twofold within, else once for a subsequence; 0 if one is none of these."""
    low, total = target.lower(), 0
    for atom in atoms:
        if low == atom:
            tier = 4
        elif low.startswith(atom):
            tier = 3
        elif atom in low:
            tier = 2
        else:
            rest = iter(low)
            tier = int(all(c in rest for c in atom))
        if not tier:
            return 0
        total += tier * len(atom)
    return total


@F.pandas_udf(IntegerType())
def best_points(query: pd.Series, path: pd.Series, symbol: pd.Series, preview: pd.Series) -> pd.Series:
    """The best target's points, 0 for no match."""
    atoms = {q: q.lower().split() for q in query.unique()}
    found = [max(target_points(t or "", atoms[q]) for t in targets) for q, *targets in zip(query, path, symbol, preview, strict=True)]
    return pd.Series(found, dtype="int32")


def fuzzy_pairs(small: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, item, _points, _exact of all matches of chunks (item, file_path, symbol, _preview) and queries.

    A block of queries goes to the tasks as it is, so that a chunk moves once and only matches come back;
    a larger set of queries meets the chunks block by block.
    """
    block = queries.limit(QUERY_BLOCK + 1).collect()
    exact = F.coalesce(F.lower("symbol") == F.lower("query"), F.lit(False)).alias("_exact")
    if len(block) > QUERY_BLOCK:
        pairs = against_all(small, queries)
        return pairs.select("query_id", "item", best_points("query", "file_path", "symbol", "_preview").alias("_points"), exact).where("_points > 0")
    asked = [(r.query_id, r.query.lower(), r.query.lower().split()) for r in block]
    schema = StructType([queries.schema["query_id"], small.schema["item"], StructField("_points", IntegerType()), StructField("_exact", BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            items, targets = part["item"].to_numpy(), [[t or "" for t in part[c]] for c in ("file_path", "symbol", "_preview")]
            named, best = [t.lower() for t in targets[1]], {}
            # every kind of match is a subsequence
            for texts in targets:
                for i, rows in matches([t.lower() for t in texts], [atoms for _, _, atoms in asked]):
                    for row in rows.tolist():
                        best[i, row] = max(best.get((i, row), 0), target_points(texts[row], asked[i][2]))
            yield pd.DataFrame([(asked[i][0], items[row], points, named[row] == asked[i][1]) for (i, row), points in best.items() if points], columns=schema.names)

    return small.mapInPandas(run, schema)


def fuzzy_match(chunks: DataFrame, queries: DataFrame, limit: int | Column, aligned: bool = False) -> DataFrame:
    """query_id, item, fuzzy, rank: path, symbol and the start of the content of each chunk against each query.

    Points of the best target, in shares of the query's best; an equal symbol is 1 and comes first; chunks
    without a match are left out. Points are those of alignments (alignment.py) or, which SQL can express and so
    the hybrid queries use, of target_points().
    """
    small = chunks.select("item", "file_path", "symbol", F.substring("content", 1, PREVIEW).alias("_preview"))
    asked = queries.select("query_id", "query").where(F.trim("query") != "")
    pairs = aligned_pairs(small, asked, limit if isinstance(limit, int) else None) if aligned else fuzzy_pairs(small, asked)
    matched = pairs.join(queries, "query_id")
    first = ranked(matched, ["query_id"], F.desc("_exact"), F.desc("_points"), "item").withColumn("_most", F.max("_points").over(W.partitionBy("query_id")))
    share = F.when(F.col("_exact"), 1.0).otherwise(F.col("_points") / F.col("_most"))
    return first.where(F.col("rank") < limit).withColumn("fuzzy", share).drop("_points", "_exact", "_most")


def structure_boost(path: Column, chunk_type: Column, documented: Column, in_context: Column) -> Column:
    """Weight of a chunk by its type, documentation, context and place."""
    by_type = (
        F.when(chunk_type.isNull(), 1.0).when(chunk_type.isin("function", "method"), 1.18).when(chunk_type.isin("struct", "class", "enum", "interface"), 1.05)
        .when(chunk_type.isin("variable", "const"), 0.9).otherwise(paths.type_priority(chunk_type) / 100.0)
    )
    low = F.lower(path)
    has = lambda *needles: low.rlike("|".join(needles))
    place = (
        F.when(has("/agents/", "/tests/", "/test/"), 0.6).otherwise(1.0) * F.when(has("/scripts/", "docker", "/db/", "/deploy/", "/infra/"), 0.7).otherwise(1.0)
        * F.when(has("packages/utils", "/utils", "src/lib"), 1.25).otherwise(1.0)
    )
    return by_type * F.when(documented, 1.1).otherwise(1.0) * F.when(in_context, 1.05).otherwise(1.0) * place


def lexical_bonus(path: Column, symbol: Column, terms: Column, profile: Profile) -> Column:
    """Added points for terms within the path (more for YAML) and the symbol."""
    low = text.ascii_lower(path)
    in_path = F.exists(terms, lambda t: F.contains(low, t))
    in_symbol = F.coalesce(F.exists(terms, lambda t: F.contains(text.ascii_lower(symbol), t)), F.lit(False))
    yaml = F.when(low.rlike(r"[^/]\.ya?ml$"), profile.yaml_boost).otherwise(0.0)
    return F.when(in_path, profile.path_boost + yaml).otherwise(0.0) + F.when(in_symbol, profile.symbol_boost).otherwise(0.0)


def must_hits(chunks: DataFrame, queries: DataFrame, profile: Profile) -> DataFrame:
    """query_id, item, boost: chunks on paths that a rule wants for queries with all its tokens."""
    if not profile.must_hit:
        return chunks.select("item").limit(0).withColumn("query_id", F.lit(None).cast("long")).withColumn("boost", F.lit(None).cast("double")).select("query_id", "item", "boost")
    low = text.ascii_lower(F.col("file_path"))
    fired = F.filter(F.array(*(F.when(paths.rule_matches(low, r), F.lit(i)) for i, r in enumerate(profile.must_hit))), lambda x: x.isNotNull())
    wanted = chunks.select("item", F.explode(fired).alias("rule"))
    asks = F.filter(F.array(*(F.when(F.size(F.array_except(F.array(*map(F.lit, r.tokens)), "terms")) == 0, F.lit(i)) for i, r in enumerate(profile.must_hit))), lambda x: x.isNotNull())
    asking = queries.select("query_id", F.explode(asks).alias("rule"))
    boosts = F.create_map(*(F.lit(x) for i, r in enumerate(profile.must_hit) for x in (i, max(r.weight, 1.0))))
    return wanted.join(asking, "rule").groupBy("query_id", "item").agg(F.max(boosts[F.col("rule")]).alias("boost"))


def inject_must_hits(scored: DataFrame, hits: DataFrame, bonus: float) -> DataFrame:
    """query_id, item, score: wanted items get at least (best score + bonus) times their boost; queries without candidates stay empty."""
    base = scored.groupBy("query_id").agg(F.max("score").alias("_best"))
    raised = hits.join(base, "query_id").select("query_id", "item", ((F.col("_best") + max(bonus, 0.0)) * F.greatest("boost", F.lit(1.0))).alias("score"))
    return scored.select("query_id", "item", "score").unionByName(raised).groupBy("query_id", "item").agg(F.max("score").alias("score"))


def has_overlap(path: Column, content: Column, symbol: Column, terms: Column) -> Column:
    """Whether a term is within the path, content or symbol; queries without terms pass."""
    hay = [text.ascii_lower(F.coalesce(c, F.lit(""))) for c in (path, content, symbol)]
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(hay[0], t) | F.contains(hay[1], t) | F.contains(hay[2], t))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, profile: Profile = GENERAL, batch: bool = False) -> DataFrame:
    """query_id, item, score, rank: the best chunks for each query.

    chunks: item, file_path, symbol, content, chunk_type, documented, in_context; vectors: item, embedding;
    queries: query_id, query, q (vector, null for none: then the fuzzy list stands alone) and, if the fuzzy
    matcher is to look for something else than the query, fuzzy_query. Both lists are cut to the query's
    pool, fused by rank with the weights of its kind, boosted, filtered, reranked by lexical statistics over
    the candidates, weighted by path and scaled per query.
    Intermediate lists, a pool for each query, are written and read again: each is used more than once.
    In batch mode all queries have the largest pool, and candidates must share a term with the query.
    """
    weights = text.query_weights(F.col("query"))
    fuzzy_query = F.coalesce("fuzzy_query", "query") if "fuzzy_query" in queries.columns else F.col("query")
    asked = held(queries.select("query_id", "query", "q", fuzzy_query.alias("fuzzy_query"), text.query_kind(F.col("query")).alias("kind"), text.query_tokens(F.col("query")).alias("terms"), weights["semantic"].alias("w_sem"), weights["fuzzy"].alias("w_fuz"), (F.greatest(weights["multiplier"], F.lit(4)) * max(limit, 1)).alias("pool")), "queries")
    if batch:
        most = asked.agg(F.max("pool")).first()[0] or 0
        asked = asked.withColumn("pool", F.lit(most))
    allowed = chunks.where(~paths.any_rule(F.col("file_path"), profile.reject))
    pools = asked.select("query_id", "pool", "w_sem", "w_fuz")
    semantic = vector_topk(vectors, asked.where("q IS NOT NULL").select("query_id", "q"), 6 * max(limit, 1), "item").join(pools, "query_id").where(F.col("rank") < F.col("pool"))
    semantic = held(semantic.join(allowed.select("item"), "item", "left_semi"), "semantic")
    fuzzy = fuzzy_match(chunks, asked.select("query_id", F.col("fuzzy_query").alias("query"), "pool"), F.col("pool")).where(F.col("fuzzy") >= profile.min_fuzzy)
    fuzzy = held(fuzzy.join(allowed.select("item"), "item", "left_semi"), "fuzzy")
    # ranks count what is left of each list
    sem_list = top_k(semantic.select("query_id", "item", "score"), ["query_id"], 2**31 - 1, F.desc("score"), "item").join(pools, "query_id").select("query_id", "item", "rank", F.col("w_sem").alias("weight"))
    fuz_list = top_k(fuzzy.select("query_id", "item", "fuzzy", F.col("rank").alias("_r")), ["query_id"], 2**31 - 1, "_r").join(pools, "query_id").select("query_id", "item", "rank", F.col("w_fuz").alias("weight"))
    fused = rrf(sem_list.unionByName(fuz_list), ADAPTIVE_K)
    signals = fused.join(semantic.select("query_id", "item", F.col("score").alias("semantic")), ["query_id", "item"], "left").join(fuzzy.select("query_id", "item", "fuzzy"), ["query_id", "item"], "left")
    wanted = must_hits(allowed, asked, profile)
    kept = signals.join(wanted.select("query_id", "item", F.lit(True).alias("_must")), ["query_id", "item"], "left")
    kept = held(kept.where(F.col("_must").isNotNull() | passes_thresholds(F.col("semantic"), F.col("fuzzy"), profile.min_semantic, profile.min_fuzzy)), "candidates")
    rows = kept.join(chunks, "item").join(asked.select("query_id", "kind", "terms"), "query_id")
    if batch:
        rows = rows.where(has_overlap(F.col("file_path"), F.col("content"), F.col("symbol"), F.col("terms")))
    hits = held(rows.select("query_id", "item", text.content_tokens(F.col("content"), F.col("terms"), profile.window).alias("hits")), "hits")
    lexical = bm25(hits, profile.k1, profile.b, profile.bm25_weight)
    boost = structure_boost(F.col("file_path"), F.col("chunk_type"), F.col("documented"), F.col("in_context"))
    base = rows.select("query_id", "item", (F.col("fused") * boost + lexical_bonus(F.col("file_path"), F.col("symbol"), F.col("terms"), profile)).alias("base"))
    scored = held(base.join(lexical, ["query_id", "item"], "left").select("query_id", "item", (F.col("base") + F.coalesce("bm25", F.lit(0.0))).alias("score")), "scored")
    final = inject_must_hits(scored, wanted, profile.must_hit_bonus).join(chunks.select("item", "file_path"), "item").join(asked.select("query_id", "kind"), "query_id")
    weighted = held(final.select("query_id", "item", (F.col("score") * paths.path_weight(F.col("file_path"), profile, F.col("kind"))).alias("score")), "weighted")
    return top_k(normalize_scores(weighted), ["query_id"], limit, F.desc("score"), "item")
