"""The whole search: queries that name a path or a symbol are answered directly, the others by ranked retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import paths, text
from tessera.operators.anchors import direct_paths, direct_symbols, symbol_anchor
from tessera.operators.ranking import top_k
from tessera.operators.retrieval import hybrid_search
from tessera.operators.vector import vector_topk
from tessera.profile import GENERAL, Profile
from tessera.sources.work import held

#: Routes in order of precedence.
ROUTES = ("path", "anchor", "symbol", "ranked")


def expanded(query: Column) -> Column:
    """A query with its words and their synonyms, as one text."""
    return F.array_join(text.expand_query(query), " ")


def embedding_text(query: Column) -> Column:
    """What is embedded for a query: its expansion, for identifiers that of the symbol in it."""
    return F.when(text.query_kind(query) == "identifier", expanded(F.coalesce(symbol_anchor(query), query))).otherwise(expanded(query))


def embed_queries(queries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """queries (query_id, query, ...) with q, the vector of their embedding_text()."""
    return queries.withColumn("q", embed(embedding_text(F.col("query"))))


def search_by_text(vectors: DataFrame, queries: DataFrame, embed: Callable[[Column], Column], k: int, id_col: str = "vec_id") -> DataFrame:
    """query_id, item, score, rank: the k nearest vectors of each query's text."""
    return vector_topk(vectors, embed_queries(queries.select("query_id", "query"), embed).select("query_id", "q"), k, id_col)


def trimmed(queries: DataFrame) -> DataFrame:
    """queries without white space around them; a blank or null one is an error."""
    bare = F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", "")
    return queries.withColumn("query", F.when(bare == "", F.raise_error(F.lit("empty query"))).otherwise(bare))


def direct_hits(chunks: DataFrame, queries: DataFrame, limit: int = 10, profile: Profile = GENERAL) -> DataFrame:
    """query_id, item, score, rank, route: queries of one path meet the chunks of that path, those that name a symbol the chunks that define it.

    Of several routes the first in ROUTES that finds something answers a query. Hits are in order of path
    and item and lose a thousandth of score for each place.
    """
    allowed = chunks.where(~paths.any_rule(F.col("file_path"), profile.reject)).select("item", "file_path", "symbol")
    asked = queries.select("query_id", "query", text.query_kind(F.col("query")).alias("kind"), symbol_anchor(F.col("query")).alias("anchor"))
    by_path = direct_paths(allowed.select("file_path").distinct(), asked.where("kind = 'path'").select("query_id", "query")).select("query_id", "file_path").join(allowed, "file_path")
    within = asked.where((F.col("anchor") != F.col("query")) & (text.query_kind(F.col("anchor")) == "identifier")).select("query_id", F.col("anchor").alias("query"))
    whole = asked.where((F.col("kind") == "identifier") & ~F.col("query").rlike(r"\s")).select("query_id", "query")
    found = None
    for i, hits in enumerate((by_path, direct_symbols(allowed, within), direct_symbols(allowed, whole))):
        own = hits.select("query_id", "item", "file_path", F.lit(i).alias("_route"))
        found = own if found is None else found.unionByName(own)
    first = found.withColumn("_first", F.min("_route").over(W.partitionBy("query_id"))).where("_route = _first")
    route = F.element_at(F.array(*map(F.lit, ROUTES)), F.col("_route") + 1)
    ranked = top_k(first, ["query_id"], max(limit, 1), "file_path", "item")
    return ranked.select("query_id", "item", F.greatest(1 - 0.001 * F.col("rank"), F.lit(0.0)).alias("score"), "rank", route.alias("route"))


def routed_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, embed: Callable[[Column], Column] | None, limit: int = 10, profile: Profile = GENERAL) -> DataFrame:
    """query_id, item, score, rank, route: direct_hits() for the queries that have any, hybrid_search() for the others.

    `embed` makes the queries' vectors; without it they are given as q. Identifier queries look for the
    symbol in them, by meaning and by spelling.
    """
    asked = trimmed(queries)
    direct = held(direct_hits(chunks, asked, limit, profile), "direct")
    rest = asked.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    rest = rest if embed is None else embed_queries(rest, embed)
    named = F.when(text.query_kind(F.col("query")) == "identifier", expanded(symbol_anchor(F.col("query"))))
    ranked = hybrid_search(chunks, vectors, rest.withColumn("fuzzy_query", named), limit, profile)
    return direct.unionByName(ranked.select("query_id", "item", "score", "rank", F.lit(ROUTES[-1]).alias("route")))


#: Places of kinds in a pack, code or docs first.
CODE_FIRST = ("code", "test", "config", "other", "docs")
DOCS_FIRST = ("docs", "code", "test", "config", "other")


def arrange_primaries(rows: DataFrame, limit: int, prefer_code: bool = True, include_docs: bool = True) -> DataFrame:
    """Primaries (query_id, file_path, start_line, score, ...) by kind, then score, path and line, `limit` of a query, with `rank`."""
    kind = paths.path_kind(F.col("file_path"))
    kept = rows if include_docs else without_docs(rows)
    place = F.array_position(F.array(*map(F.lit, CODE_FIRST if prefer_code else DOCS_FIRST)), kind)
    return top_k(kept, ["query_id"], limit, place, F.desc("score"), "file_path", "start_line")


def without_docs(rows: DataFrame) -> DataFrame:
    """rows (file_path, ...) but those of documentation."""
    return rows.where(paths.path_kind(F.col("file_path")) != "docs")
