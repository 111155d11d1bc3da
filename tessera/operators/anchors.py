"""Anchors of queries (quoted text, paths, identifiers), direct matches, guards and recall directives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import ascii_lower, word_position
from tessera.operators.lines import grep_hunks
from tessera.operators.ranking import RRF_K, against_all, normalize_scores, rrf


@dataclass(frozen=True)
class Anchor:
    """What a query is about: kind is quoted, path or identifier."""

    kind: str
    text: str


def detect_anchor(query: str) -> Anchor | None:
    """Quoted text comes before paths, these before identifiers; of a kind the longest, of equal ones the last; line numbers are cut off."""
    quoted = [m[1] or m[2] or m[3] for m in re.finditer(r'"([^"]+)"|`([^`]+)`|\'([^\']+)\'', query)]
    tokens = [re.sub(r"(:\d+(-\d+)?|#L\d+(-L?\d+)?)$", "", t.strip(",;()[]{}?!")) for t in query.split()]
    paths = [t for t in tokens if "/" in t or re.search(r"\w\.[A-Za-z0-9]{1,6}$", t)]
    names = [t for t in tokens if re.fullmatch(r"[A-Za-z_]\w*(::\w+)*", t) and (re.search(r"[_\d]|::", t) or re.search(r"[a-z][A-Z]", t))]
    for kind, found in (("quoted", quoted), ("path", paths), ("identifier", names)):
        found = [f.strip() for f in found if len(f.strip()) >= 2]
        if found:
            return Anchor(kind, max(reversed(found), key=len))
    return None


def symbol_anchor(query: Column) -> Column:
    """The token of a query that looks most like an identifier, null if none does: by length in bytes, and more
    for underscores, digits and mixed case, of equal ones the first. Of a qualified name the last part counts."""
    bare = F.transform(F.split(query, r"\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^A-Za-z0-9_:]+|[^A-Za-z0-9_:]+$", ""), "^.*::", ""))
    mixed = lambda t: t.rlike("[a-z]") & t.rlike("[A-Z]")
    score = lambda t: F.octet_length(t) + F.when(F.contains(t, F.lit("_")), 50).otherwise(0) + F.when(t.rlike("[0-9]"), 20).otherwise(0) + F.when(mixed(t), 30).otherwise(0)
    named = F.filter(F.transform(bare, lambda t, i: F.struct(score(t).alias("score"), (-i).alias("place"), t.alias("token"))), lambda x: x["token"].rlike("[_0-9]") | mixed(x["token"]))
    return F.array_max(named)["token"]


def mentions(anchor: Anchor, path: Column, content: Column) -> Column:
    """Whether an item mentions the anchor."""
    needle = F.lit(anchor.text.lower())
    if anchor.kind == "identifier":
        return word_position(content, anchor.text) > 0
    within = F.contains(F.lower(content), needle)
    return within | F.contains(F.lower(path), needle) if anchor.kind == "path" else within


def guard(results: DataFrame, anchor: Anchor | None) -> DataFrame:
    """The results of a query, none of them if it has an anchor that no item mentions."""
    if anchor is None:
        return results
    hit = F.max(mentions(anchor, F.col("file_path"), F.col("content"))).over(W.partitionBy("query_id"))
    return results.withColumn("_hit", hit).where("_hit").drop("_hit")


def anchor_hits(results: DataFrame, anchor: Anchor, k: int) -> DataFrame:
    """query_id, hit: whether one of the first k results mentions the anchor."""
    return results.where(F.col("rank") < k).groupBy("query_id").agg(F.bool_or(mentions(anchor, F.col("file_path"), F.col("content"))).alias("hit"))


def normal_path(path: Column) -> Column:
    """A path for comparisons: without quotes around it and ./ before it, with slashes, ASCII letters in lower case."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    return ascii_lower(F.regexp_replace(F.translate(bare, "\\", "/"), r"^(\./)+", ""))


def direct_paths(files: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, file_path, tier, score: files for queries of one path, only those of the best tier (0 equal, 1 suffix, 2 within).

    Equal paths meet by an equi-join; only the queries without one are compared with every path.
    """
    token = F.regexp_replace("query", r"^\s+|\s+$", "")
    asked = queries.where(token.rlike(r"^\S+$") & (token.rlike(r"[/\\]") | token.rlike(r"\.[A-Za-z0-9]{1,6}$"))).select("query_id", normal_path(F.col("query")).alias("_q")).where("_q <> ''")
    own = files.select("file_path", normal_path(F.col("file_path")).alias("_path"))
    equal = own.join(asked, F.col("_path") == F.col("_q")).select("query_id", "file_path", F.lit(0).alias("tier"))
    rest = asked.join(equal.select("query_id").distinct(), "query_id", "left_anti")
    within = against_all(own, rest).where(F.contains("_path", F.col("_q"))).select("query_id", "file_path", F.when(F.endswith("_path", F.col("_q")), 1).otherwise(2).alias("tier"))
    best = equal.unionByName(within).withColumn("_best", F.min("tier").over(W.partitionBy("query_id"))).where(F.col("tier") == F.col("_best")).drop("_best")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("file_path")) - 1
    return best.withColumn("score", F.greatest(1 - 0.001 * rank, F.lit(0.0)))


def direct_symbols(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, item, file_path: chunks named like the query; a lone hit in a mod.rs gives way to the chunks of the sibling file of the symbol's name, if there are any."""
    asked = queries.select("query_id", ascii_lower("query").alias("_q"))
    hits = chunks.select("item", "file_path", ascii_lower("symbol").alias("_q")).join(asked, "_q")
    lone = hits.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("query_id"))).where((F.col("_n") == 1) & F.endswith("file_path", F.lit("/mod.rs")))
    sibling = F.concat(F.regexp_replace("file_path", "mod.rs$", ""), F.col("_q"), F.lit(".rs"))
    moved = lone.select("query_id", sibling.alias("file_path")).join(chunks.select("item", "file_path"), "file_path").select("query_id", "item", "file_path")
    kept = hits.join(moved.select("query_id").distinct(), "query_id", "left_anti")
    return kept.select("query_id", "item", "file_path").unionByName(moved)


def reasons(query: Column, content: Column, symbol: Column) -> Column:
    """Why a result is there: term+semantic if it has the query itself, else semantic."""
    low = F.lower(query)
    return F.when(F.contains(F.lower(content), low) | F.coalesce(F.contains(F.lower(symbol), low), F.lit(False)), "term+semantic").otherwise("semantic")


def graph_boost(primaries: DataFrame, graph_hits: DataFrame, rejected: DataFrame, weight: float, limit: int) -> DataFrame:
    """query_id, item, score, rank: primaries (query_id, item, rank) fused with hits on graph documents; new items are appended unless rejected."""
    allowed = graph_hits.join(rejected.select("item"), "item", "left_anti")
    lists = primaries.select("query_id", "item", "rank", F.lit(1.0).alias("weight")).unionByName(allowed.select("query_id", "item", "rank", F.lit(weight).alias("weight")))
    scored = normalize_scores(rrf(lists, RRF_K).withColumnRenamed("fused", "score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")) - 1
    return scored.withColumn("rank", rank).where(F.col("rank") < limit)


def focus_related(related: DataFrame, terms: Column) -> DataFrame:
    """Related rows (query_id, primary, item, distance, relevance, content) in focus: within two hops, those with a term first,
    at most two without one, and these only as direct neighbours if any has a term."""
    hit = F.exists(terms, lambda t: F.contains(F.lower("content"), t))
    own = W.partitionBy("query_id", "primary")
    marked = related.where("distance <= 2").withColumn("hit", hit).withColumn("_any", F.max("hit").over(own))
    kept = marked.where(F.col("hit") | ~F.col("_any") | (F.col("distance") <= 1))
    order = F.row_number().over(own.orderBy(F.desc("hit"), F.desc("relevance"), "item"))
    misses = F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(own.orderBy(F.desc("hit"), F.desc("relevance"), "item").rowsBetween(W.unboundedPreceding, 0))
    return kept.withColumn("rank", order).withColumn("_m", misses).where(F.col("hit") | (F.col("_m") <= 2)).drop("_any", "_m")


def lexical_fallback(files: DataFrame, query: str) -> DataFrame:
    """Hunks around the words of a query, for when there is no index."""
    words = [w for w in re.findall(r"[A-Za-z0-9_]{3,}", query)]
    return grep_hunks(files, "(?i)" + "|".join(map(re.escape, words)), 2, 2) if words else grep_hunks(files.limit(0), "x", 0, 0)


@dataclass
class Directives:
    """What a recall question asks for beside its text."""

    text: str
    mode: str | None = None
    index_ms: int | None = None
    k: int | None = None
    context: int | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    pattern: str | None = None
    files: list[str] = field(default_factory=list)
    regex: str | None = None
    literal: str | None = None


def duration_ms(text: str) -> int:
    """5s, 250ms or 2m in milliseconds."""
    found = re.fullmatch(r"(\d+)(ms|s|m)?", text)
    if not found:
        raise ValueError(f"no duration: {text}")
    return int(found[1]) * {"ms": 1, "s": 1000, "m": 60_000, None: 1}[found[2]]


def parse_directives(question: str) -> Directives:
    """fast, deep, index:5s, k:3, ctx:2, in:dir, not:dir, fp:glob, file:path, re:pattern and lit:text; the last two take the rest."""
    out = Directives("")
    rest = question.split()
    words: list[str] = []
    while rest:
        word = rest.pop(0)
        key, colon, value = word.partition(":")
        if word in ("fast", "deep") and not words:
            out.mode = word
        elif key == "index" and colon:
            out.index_ms = duration_ms(value) if value else None
            out.mode = out.mode or "deep"
        elif key in ("k", "ctx") and value.isdigit():
            setattr(out, {"k": "k", "ctx": "context"}[key], int(value))
        elif key in ("in", "not", "file") and value:
            {"in": out.include, "not": out.exclude, "file": out.files}[key].append(value)
        elif key == "fp" and value:
            out.pattern = value
        elif key in ("re", "lit") and colon:
            setattr(out, {"re": "regex", "lit": "literal"}[key], " ".join([value, *rest]).strip())
            break
        else:
            words.append(word)
    out.text = " ".join(words)
    return out


def first_source(sources: list[DataFrame]) -> DataFrame:
    """Per question, the rows of the first source that has any: sources are DataFrames with question_id, in order of priority."""
    every = None
    for i, source in enumerate(sources):
        own = source.withColumn("_source", F.lit(i))
        every = own if every is None else every.unionByName(own)
    best = F.min("_source").over(W.partitionBy("question_id"))
    return every.withColumn("_best", best).where("_source = _best").drop("_best").withColumnRenamed("_source", "source")
