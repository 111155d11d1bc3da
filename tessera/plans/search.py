"""Queries of vector search, ranking and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.vectors import stub_embed
from tessera.operators import ann, ranking, retrieval, vector
from tessera.plans.base import FILES, LOWERED, QUERIES as QUERY_TABLE, files, queries, table, words_sql
from tessera.plans.scalars import any_sql, weight_sql
from tessera.profile import GENERAL
from tessera.sources.work import held

DIMENSION = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vector of the least id as a query."""
    return vectors(spark, sf_dir).groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("v")).select(F.col("label").cast("bigint").alias("query_id"), F.col("v.embedding").alias("q"))


def _rounded(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.round(column, 6)).withColumn("rank", F.col("rank").cast("bigint"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vector.vector_topk(vectors(spark, sf_dir), asked(spark, sf_dir), 10))


def vector_zero_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = asked(spark, sf_dir).withColumn("q", F.transform("q", lambda x: F.lit(0.0).cast("float")))
    return _rounded(vector.vector_topk(vectors(spark, sf_dir), zero, 3))


def rrf_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion over three models: the vectors, those turned by half, and their first half."""
    base, q, half = vectors(spark, sf_dir), asked(spark, sf_dir), DIMENSION // 2
    turned = lambda c: F.concat(F.slice(c, half + 1, half), F.slice(c, 1, half))
    models = {"whole": lambda c: F.col(c), "turned": turned, "half": lambda c: F.slice(c, 1, half)}
    found = None
    for name, form in models.items():
        # the queries of the turned model are not turned
        own = vector.vector_topk(base.withColumn("embedding", form("embedding")), q.withColumn("q", F.col("q") if name == "turned" else form("q")), 20).withColumn("model", F.lit(name))
        found = own if found is None else found.unionByName(own)
    fused = vector.multi_model(found.select("query_id", "model", "item", "score"))
    return fused.select("query_id", "item", F.round("fused", 9).alias("fused"), F.round("score", 6).alias("score"))


#: Vectors of a cell of the index, so that these tables have several.
CELL_ROWS = 256


def _ann(index: ann.GraphIndex, base: DataFrame) -> DataFrame:
    """One row: whether 0.9 of the ten nearest of every twentieth vector are found, whether what a query met keeps within its bound, and the number of results looked for."""
    q = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = ann.calibrated(index)
    found = held(ann.search(index, q, 10), "ann-recall")
    bound = index.probes * (ann.BEAM + ann.LAYER**2) * ann.MOST
    met = found.agg((F.coalesce(F.max("met"), F.lit(0)) <= bound).alias("bounded"))
    both = vector.recall_at_k(found, vector.vector_topk(base, q, 10)).withColumn("row", F.lit(1)).join(met.withColumn("row", F.lit(1)), "row")
    return both.select((F.col("recall") >= 0.9).alias("reached"), "bounded", "n")


def _index(base: DataFrame) -> ann.GraphIndex:
    return ann.build_index(base.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), DIMENSION, CELL_ROWS)


def ann_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return _ann(_index(base), base)


def ann_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after every third vector was removed, with cells built again, and every ninth was put back."""
    base = vectors(spark, sf_dir)
    gone, back = base.where("vec_id % 3 = 0"), base.where("vec_id % 9 = 0")
    pairs = lambda df: df.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    index = ann.add(ann.remove(_index(base), pairs(gone), tombstones=16), pairs(back))
    return _ann(index, base.where("vec_id % 3 <> 0 OR vec_id % 9 = 0"))


def stub_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeds all documents; every second one is found in the cache."""
    docs = files(spark, sf_dir).select(F.col("file_path").alias("chunk_id"), F.col("content").alias("rendered"))
    fresh = docs.select("chunk_id", F.sha2("rendered", 256).alias("doc_hash"), stub_embed(32)(F.col("rendered")).alias("vector"))
    cache = fresh.where(F.crc32("chunk_id") % 2 == 0).select("doc_hash", "vector", F.lit("stub").alias("model_id"), F.lit("t1").alias("template_hash"))
    return vector.embed_missing(docs, cache, "stub", "t1", 32)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select("query_id", text.query_tokens(F.col("query")).alias("terms"))
    hits = retrieval.term_hits(files(spark, sf_dir).select(F.col("doc_id").alias("item"), "content"), asked, GENERAL.window)
    scored = retrieval.bm25(hits, GENERAL.k1, GENERAL.b, GENERAL.bm25_weight).withColumn("score", F.round("bm25", 6)).drop("bm25")
    return _rounded(ranking.top_k(scored, ["query_id"], 10, F.desc("score"), "item"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, with their first capitalised word as symbol; code files are functions, those with a line feed are documented."""
    f, first = files(spark, sf_dir), F.regexp_extract("content", "([A-Z][a-z]+)", 1)
    kind = F.when(F.col("file_path").rlike(r"\.(py|rs)$"), "function")
    return f.select(F.col("doc_id").alias("item"), "file_path", F.nullif(first, F.lit("")).alias("symbol"), "content", kind.alias("chunk_type"), F.contains("content", F.lit("\n")).alias("documented"), F.lit(False).alias("in_context"))


def fuzzy_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.fuzzy_match(chunks(spark, sf_dir), queries(spark, sf_dir), 40), "fuzzy").select("query_id", "item", "fuzzy", "rank")


def fuzzy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by alignments, which the tests hold against a plain programme."""
    return _rounded(retrieval.fuzzy_match(chunks(spark, sf_dir), queries(spark, sf_dir), 40, aligned=True), "fuzzy").select("query_id", "item", "fuzzy", "rank")


def normalize_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances by nation; every seventh is not a number, one nation has equal ones."""
    c = table(spark, sf_dir, "customer")
    score = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_nationkey") == 3, 5.0).otherwise(F.col("c_acctbal"))
    rows = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item"), score.alias("score"))
    return ranking.normalize_scores(rows).select("query_id", "item", F.round("score", 6).alias("score"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    share = F.col("o_totalprice") / 500000.0
    sem = F.when(F.col("o_orderkey") % 3 != 0, share)
    fuz = F.when(F.col("o_orderkey") % 5 != 0, 1 - share)
    return o.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("query_id"), sem.alias("semantic"), fuz.alias("fuzzy"))


def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = ranking.passes_thresholds(F.col("semantic"), F.col("fuzzy"), GENERAL.min_semantic, GENERAL.min_fuzzy)
    return _signals(spark, sf_dir).where(passes).select("item")


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of two orders of each customer's orders, of which one lacks some."""
    rows = _signals(spark, sf_dir)
    lists = None
    for name, weight in (("semantic", 0.8), ("fuzzy", 0.2)):
        own = ranking.ranked(rows.where(F.col(name).isNotNull()), ["query_id"], F.desc(name), "item").select("query_id", "item", "rank", F.lit(weight).alias("weight"))
        lists = own if lists is None else lists.unionByName(own)
    return ranking.rrf(lists).select("query_id", "item", F.round("fused", 9).alias("fused"))


def must_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _signals(spark, sf_dir).where("semantic IS NOT NULL").select("query_id", "item", F.col("semantic").alias("score"))
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.lit(1.5).alias("boost"))
    return retrieval.inject_must_hits(scored, wanted, 25.0).select("query_id", "item", "score")


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("cost"))
    return ranking.running_budget(l, ["l_orderkey"], "cost", 100, "l_linenumber", F.col("cost"))


def round_robin_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as related items of suppliers, by ship mode of the line."""
    l = table(spark, sf_dir, "lineitem")
    relation = F.when(F.col("l_linenumber") == 1, "Calls").when(F.col("l_linenumber") == 2, "Extends").otherwise("TestedBy")
    rows = l.select((F.col("l_suppkey") % 5).alias("query_id"), F.col("l_suppkey").alias("primary_rank"), relation.alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("related_id"), F.col("l_extendedprice").alias("relevance"))
    return ranking.round_robin(rows, 8).select("query_id", "primary_rank", "relation", "related_id", F.col("turn").cast("bigint").alias("turn"))


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, their vectors (a document has that of its id) and queries (an item has that of its id)."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("item"), "embedding")
    q = queries(spark, sf_dir).join(v.select(F.col("item").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    return chunks(spark, sf_dir), v, q


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.hybrid_search(*_with_vectors(spark, sf_dir)))


def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.hybrid_search(*_with_vectors(spark, sf_dir), batch=True))


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_zero_norm, rrf_multi, ann_recall_at_k, ann_after_changes, stub_embedding, bm25_topk, fuzzy_sql, fuzzy_alignment, normalize_scores, threshold_filter, rrf_weighted, must_hit,
    budget_prefix, round_robin_related, hybrid_search, hybrid_batch,
)}

_SUM = "coalesce(list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 0)"
_COS = "CASE WHEN {s00} * {s11} = 0 THEN 0.0 ELSE {s01} / (sqrt({s00}) * sqrt({s11})) END"


def cos_sql(a: str, b: str) -> str:
    return _COS.format(s00=_SUM.format(a, a), s11=_SUM.format(b, b), s01=_SUM.format(a, b))


_ASKED = "q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1)"
_CHUNKS = FILES + r""", chunks AS (SELECT doc_id AS item, file_path, nullif(regexp_extract(content, '([A-Z][a-z]+)', 1), '') AS symbol, content,
  CASE WHEN ends_with(file_path, '.py') OR ends_with(file_path, '.rs') THEN 'function' END AS chunk_type, contains(content, chr(10)) AS documented FROM files)"""


def _topk_sql(v: str, q: str, k: int) -> str:
    return f"SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank FROM (SELECT query_id, vec_id AS item, {cos_sql(q, v)} AS score FROM q, embeddings WHERE embedding IS NOT NULL) QUALIFY rank < {k}"


_TERMS = f"terms AS (SELECT query_id, query, list_sort(list_distinct({words_sql('query')})) AS terms FROM queries)"
_HITS = f"""t AS (SELECT query_id, unnest(terms) AS term FROM terms), w AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {words_sql('content')} AS l FROM files)),
  h AS (SELECT query_id, doc_id AS item, term, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS n FROM w JOIN t USING (term)), hits AS (SELECT * FROM h WHERE n <= {GENERAL.window})"""
_BM25 = f"""tf AS (SELECT query_id, item, term, count(*) AS tf FROM hits GROUP BY ALL), dl AS (SELECT query_id, item, sum(tf) AS dl FROM tf GROUP BY ALL),
  st AS (SELECT query_id, count(*) AS n, greatest(avg(dl), 1e-3) AS avgdl FROM dl GROUP BY 1), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
  bm AS (SELECT query_id, item, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {GENERAL.k1 + 1} / (tf + {GENERAL.k1} * (1 - {GENERAL.b} + {GENERAL.b} * dl / avgdl))) * {GENERAL.bm25_weight} AS bm25
         FROM tf JOIN dl USING (query_id, item) JOIN st USING (query_id) JOIN df USING (query_id, term) GROUP BY ALL)"""
_TIER = "CASE WHEN lower({0}) = a THEN 4 WHEN starts_with(lower({0}), a) THEN 3 WHEN contains(lower({0}), a) THEN 2 WHEN regexp_matches(lower({0}), '(?s)' || array_to_string(string_split(a, ''), '.*')) THEN 1 ELSE 0 END"
_POINTS = "CASE WHEN len(list_filter(atoms, lambda a: " + _TIER + " = 0)) = 0 THEN list_sum(list_transform(atoms, lambda a: " + _TIER + " * length(a))) END"
_FUZZY = f"""fa AS (SELECT *, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '') AS atoms FROM queries),
  fp AS (SELECT query_id, item, greatest({_POINTS.format('file_path')}, {_POINTS.format('symbol')}, {_POINTS.format('substr(content, 1, 200)')}) AS points, coalesce(lower(symbol) = lower(query), false) AS exact FROM fa, chunks WHERE len(atoms) > 0),
  fm AS (SELECT *, max(points) OVER (PARTITION BY query_id) AS most, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, points DESC, item) - 1 AS rank FROM fp WHERE points IS NOT NULL),
  fz AS (SELECT query_id, item, rank, CASE WHEN exact THEN 1.0 WHEN most > 0 THEN points / most ELSE 0.0 END AS fuzzy FROM fm)"""
_SIG = "s AS (SELECT o_orderkey AS item, o_custkey AS query_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 500000.0 END AS semantic, CASE WHEN o_orderkey % 5 <> 0 THEN 1 - o_totalprice / 500000.0 END AS fuzzy FROM orders)"
_LOWPATH = LOWERED.format("file_path")
_KIND = "CASE WHEN contains(query, '_') OR regexp_matches(query, '[0-9]') AND NOT contains(query, ' ') THEN 'identifier' ELSE 'conceptual' END"


def hybrid_sql(batch: bool, chunks: str = _CHUNKS, queries: str = QUERY_TABLE) -> str:
    """Queries of the benchmark are plain lower-case words without digits, so all of them are conceptual."""
    words = "len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> ''))"
    overlap = f"AND (len(terms) = 0 OR len(list_filter(terms, lambda t: contains({_LOWPATH}, t) OR contains({LOWERED.format('content')}, t) OR contains({LOWERED.format(chr(99) + 'oalesce(symbol, ' + chr(39) * 2 + ')')}, t))) > 0)" if batch else ""
    rejected = any_sql(GENERAL.reject, _LOWPATH)
    boost = f"""(CASE WHEN chunk_type = 'function' THEN 1.18 ELSE 1.0 END * CASE WHEN documented THEN 1.1 ELSE 1.0 END)::DOUBLE"""
    bonus = f"""(CASE WHEN len(list_filter(terms, lambda t: contains({_LOWPATH}, t))) > 0 THEN {GENERAL.path_boost} + CASE WHEN ends_with(file_path, '.yaml') THEN {GENERAL.yaml_boost} ELSE 0 END ELSE 0 END
      + CASE WHEN len(list_filter(terms, lambda t: contains({LOWERED.format('symbol')}, t))) > 0 THEN {GENERAL.symbol_boost} ELSE 0 END)::DOUBLE"""
    return f"""WITH {chunks}, {queries}, {_TERMS}, ok AS (SELECT item FROM chunks WHERE NOT {rejected}),
  q AS (SELECT query_id, e.embedding AS q FROM queries JOIN embeddings e ON e.vec_id = query_id AND e.embedding IS NOT NULL),
  wt AS (SELECT query_id, CASE WHEN {words} >= 4 THEN 0.9 ELSE 0.8 END::DOUBLE AS w_sem, CASE WHEN {words} >= 4 THEN 0.1 ELSE 0.2 END::DOUBLE AS w_fuz FROM queries),
  sm AS (SELECT * FROM ({_topk_sql('embedding', 'q.q', 60)}) SEMI JOIN ok USING (item)), {_FUZZY},
  fk AS (SELECT query_id, item, fuzzy, rank FROM fz SEMI JOIN ok USING (item) WHERE rank < 60 AND fuzzy >= {GENERAL.min_fuzzy}),
  ls AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank, w_sem AS weight FROM sm JOIN wt USING (query_id)
    UNION ALL SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1, w_fuz FROM fk JOIN wt USING (query_id)),
  fu AS (SELECT query_id, item, sum(weight / (100 + rank + 1)) AS fused FROM ls GROUP BY ALL),
  ca AS (SELECT fu.*, sm.score AS semantic, fk.fuzzy, c.file_path, c.symbol, c.content, c.chunk_type, c.documented, terms.terms FROM fu LEFT JOIN sm USING (query_id, item) LEFT JOIN fk USING (query_id, item) JOIN chunks c USING (item) JOIN terms USING (query_id)),
  kp AS (SELECT * FROM ca WHERE NOT coalesce((semantic IS NULL AND fuzzy < {GENERAL.min_fuzzy}) OR (semantic < {GENERAL.min_semantic} AND fuzzy IS NULL) OR (semantic < {GENERAL.min_semantic} AND fuzzy < {GENERAL.min_fuzzy}), false) {overlap}),
  ww AS (SELECT query_id, item, terms, {words_sql('content')} AS l FROM kp), w AS (SELECT query_id, item, unnest(list_filter(l, lambda x: list_contains(terms, x))[1:{GENERAL.window}]) AS term FROM ww), hits AS (SELECT * FROM w), {_BM25},
  sc AS (SELECT kp.query_id, kp.item, (fused * {boost} + {bonus} + coalesce(bm25, 0)) * {weight_sql([*GENERAL.boost, *GENERAL.penalty], _LOWPATH)} AS score FROM kp LEFT JOIN bm ON bm.query_id = kp.query_id AND bm.item = kp.item),
  mm AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM sc),
  nn AS (SELECT query_id, item, CASE WHEN hi - lo < 1e-6 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM mm),
  rr AS (SELECT query_id, item, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank FROM nn)
SELECT * FROM rr WHERE rank < 10"""


_HALF = "embedding[{}:{}]"
_ANN = "SELECT true AS reached, true AS bounded, sum(least(10, (SELECT count(*) FROM v)))::BIGINT AS n FROM v WHERE vec_id % 20 = 0"

ORACLE_SQL = {
    "ann_recall_at_k": f"WITH v AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL) {_ANN}",
    "ann_after_changes": f"WITH v AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND (vec_id % 3 <> 0 OR vec_id % 9 = 0)) {_ANN}",
    "vector_topk": f"WITH {_ASKED} SELECT query_id, item, round(score, 6) AS score, rank FROM ({_topk_sql('embedding', 'q', 10)})",
    "vector_zero_norm": f"WITH {_ASKED}, r AS (SELECT query_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) - 1 AS rank FROM q, embeddings WHERE embedding IS NOT NULL) SELECT query_id, item, 0.0::DOUBLE AS score, rank FROM r WHERE rank < 3",
    "rrf_multi": f"""WITH {_ASKED}, m AS (SELECT *, 'whole' AS model FROM ({_topk_sql('embedding', 'q', 20)}) UNION ALL SELECT *, 'turned' FROM ({_topk_sql('list_concat(embedding[33:64], embedding[1:32])', 'q', 20)}) UNION ALL SELECT *, 'half' FROM ({_topk_sql('embedding[1:32]', 'q[1:32]', 20)}))
        SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS fused, round(max(score), 6) AS score FROM m GROUP BY ALL""",
    "bm25_topk": f"""WITH {FILES}, {QUERY_TABLE}, {_TERMS}, {_HITS}, {_BM25}, r AS (SELECT query_id, item, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, item) - 1 AS rank FROM bm) SELECT * FROM r WHERE rank < 10""",
    "fuzzy_sql": f"WITH {_CHUNKS}, {QUERY_TABLE}, {_FUZZY} SELECT query_id, item, round(fuzzy, 6) AS fuzzy, rank FROM fz WHERE rank < 40",
    "normalize_scores": """WITH s AS (SELECT c_nationkey AS query_id, c_custkey AS item, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey = 3 THEN 5.0 ELSE c_acctbal END AS score FROM customer),
        m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, bool_or(score IS NULL) OVER w AS odd FROM s WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, item, round(CASE WHEN lo IS NULL THEN 0 WHEN odd AND hi = lo THEN CASE WHEN score IS NULL THEN 0 ELSE 1 END WHEN hi - lo < 1e-6 THEN 1 ELSE (coalesce(score, lo) - lo) / (hi - lo) END, 6)::DOUBLE AS score FROM m""",
    "threshold_filter": f"WITH {_SIG} SELECT item FROM s WHERE NOT coalesce((semantic IS NULL AND fuzzy < {GENERAL.min_fuzzy}) OR (semantic < {GENERAL.min_semantic} AND fuzzy IS NULL) OR (semantic < {GENERAL.min_semantic} AND fuzzy < {GENERAL.min_fuzzy}), false)",
    "rrf_weighted": f"""WITH {_SIG}, l AS (SELECT query_id, item, 0.8 AS weight, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, item) - 1 AS rank FROM s WHERE semantic IS NOT NULL
        UNION ALL SELECT query_id, item, 0.2, row_number() OVER (PARTITION BY query_id ORDER BY fuzzy DESC, item) - 1 FROM s WHERE fuzzy IS NOT NULL) SELECT query_id, item, round(sum(weight::DOUBLE / (60 + rank + 1)), 9) AS fused FROM l GROUP BY ALL""",
    "must_hit": f"""WITH {_SIG}, c AS (SELECT query_id, item, semantic AS score FROM s WHERE semantic IS NOT NULL), b AS (SELECT query_id, max(score) AS best FROM c GROUP BY 1),
        u AS (SELECT * FROM c UNION ALL SELECT o_custkey, o_orderkey, (best + 25) * 1.5::DOUBLE FROM orders JOIN b ON b.query_id = o_custkey WHERE o_orderkey % 50 = 0) SELECT query_id, item, max(score)::DOUBLE AS score FROM u GROUP BY ALL""",
    "budget_prefix": "WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity AS cost, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) SELECT * FROM w WHERE used <= 100",
    "round_robin_related": """WITH r AS (SELECT l_suppkey % 5 AS query_id, l_suppkey AS primary_rank, CASE l_linenumber WHEN 1 THEN 'Calls' WHEN 2 THEN 'Extends' ELSE 'TestedBy' END AS relation, l_orderkey * 10 + l_linenumber AS related_id, l_extendedprice AS relevance FROM lineitem),
        c AS (SELECT *, row_number() OVER (PARTITION BY query_id, primary_rank, relation ORDER BY relevance DESC, related_id) AS n FROM r), k AS (SELECT * FROM c WHERE n <= CASE relation WHEN 'Calls' THEN 6 WHEN 'Extends' THEN 3 ELSE 2 END),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id, primary_rank ORDER BY relevance DESC, related_id) - 1 AS turn FROM k) SELECT query_id, primary_rank, relation, related_id, turn FROM t WHERE turn < 8""",
    "hybrid_search": hybrid_sql(False),
    "hybrid_batch": hybrid_sql(True),
}
