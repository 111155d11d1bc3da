"""Queries over chunks and lines of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import directory_key, language_of
from tessera.operators import aggregates, chunking, lines
from tessera.plans.base import CHUNK_LINES, FILES, LINES, TARGET_TOKENS, files, table

L = CHUNK_LINES


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_by_lines(files(spark, sf_dir), L)


CHUNKS = LINES + f""", chunks AS (
  SELECT doc_id, file_path, ((n - 1) // {L}) * {L} + 1 AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS content FROM lines GROUP BY doc_id, file_path, (n - 1) // {L}
)"""
TOKENS = "greatest(CAST(floor(strlen({}) / 4) AS BIGINT), 1)"


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.chunk_by_tokens(files(spark, sf_dir), TARGET_TOKENS)
    return cut.select("doc_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(files(spark, sf_dir).select("file_path", "content"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(files(spark, sf_dir).select("file_path", "content"), chunking.ChunkConfig(*chunking.PRESETS["embedding"], overlap="lines:2"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunks(spark, sf_dir))


def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_window(files(spark, sf_dir), 2, 5, 400).drop("sha256")


def enclosing_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = files(spark, sf_dir).select("file_path", F.explode(F.array(*(F.lit(n).cast("bigint") for n in (1, 7, 60, 500)))).alias("line"))
    met = lines.enclosing_chunks(points, chunks(spark, sf_dir))
    return met.select("file_path", "line", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def text_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.literal_search(files(spark, sf_dir), "token", 1000)
    return found.select("file_path", F.col("n").cast("bigint").alias("n"), F.col("column").cast("bigint").alias("column"), "line")


def grep_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = lines.grep_hunks(files(spark, sf_dir), r"(?i)\bthe\b.*\bof\b", 1, 2)
    return hunks.select("file_path", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n_matches")


def grep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the same lines."""
    page = lines.grep_page(files(spark, sf_dir), r"(?i)\bthe\b.*\bof\b", 1, 2, 60, 20, 12_000)
    return page.select("file_path", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n_matches", "content", "complete")


def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lines.similar_neighbours(chunking.chunk_by_lines(files(spark, sf_dir), 10))
    return near.select("file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("next_start").cast("bigint").alias("next_start"), "similarity", "similar")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two sizes: short ones with a type, long ones without."""
    short = chunking.chunk_by_lines(files(spark, sf_dir), 9).withColumn("chunk_type", F.lit("function"))
    return short.unionByName(chunking.chunk_by_lines(files(spark, sf_dir), 10).withColumn("chunk_type", F.lit(None).cast("string")))


def shadowed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = chunking.drop_shadowed(_typed(spark, sf_dir))
    return left.select("file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "chunk_type")


def dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _typed(spark, sf_dir).withColumn("start_line", F.col("start_line") + F.when(F.col("chunk_type").isNull(), 4).otherwise(0)).where("start_line <= end_line")
    merged = lines.merge_intervals(spans, ["file_path"], "start_line", "end_line")
    return merged.select("file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "n")


def overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = _typed(spark, sf_dir).withColumn("tier", F.when(F.col("chunk_type").isNull(), 1).otherwise(0)).withColumn("key", F.concat_ws(":", "start_line", "end_line", "tier"))
    return lines.overlap_dedupe(tiers, "key").select("file_path", "key")


def dir_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.directory_map(chunks(spark, sf_dir), 2)


def dir_top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = chunks(spark, sf_dir).withColumn("symbol", F.regexp_extract("content", r"([A-Z][a-z]+)", 1))
    named = named.withColumn("symbol", F.nullif("symbol", F.lit("")))
    return aggregates.directory_symbols(named, "symbol", 1).select("directory", "symbol", "score", F.col("rank").cast("bigint").alias("rank"))


def overview_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.overview(chunks(spark, sf_dir))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.index_stats(chunks(spark, sf_dir).withColumn("language", language_of(F.col("file_path"))), "language")


def repo_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.repo_signals(files(spark, sf_dir))


def evidence_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers into every document; those of even ids carry the hash of a text that has changed since."""
    f = files(spark, sf_dir)
    old = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 2 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.sha2("content", 256))
    pointers = f.select(F.col("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"), old.alias("sha256"))
    found = lines.evidence(pointers, f)
    return found.select("file_path", "stale", "missing", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 100 files after a key (L9)."""
    return files(spark, sf_dir).where(F.col("file_path") > "src1/en").orderBy("file_path").limit(100).select("file_path")


QUERIES = {f.__name__: f for f in (
    chunk_lines, chunk_tokens, chunk_source, chunk_stats, line_window, enclosing_chunk, text_search_literal, grep_hunks, grep_page, near_dup_jaccard, shadowed_chunks,
    dedup_spans, overlap_dedupe, dir_map, dir_top_symbols, overview_layers, index_stats, repo_signals, evidence_fetch, keyset_page,
)} | {"chunk_overlap_fixed_lines": chunk_overlap}

_DIR = "array_to_string(string_split(file_path, '/')[1:{}], '/')"
_SIZED = "SELECT file_path, ((n - 1) // {0}) * {0} + 1 AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS content FROM lines GROUP BY doc_id, file_path, (n - 1) // {0}"
_TYPED = f"{LINES}, typed AS (SELECT file_path, start_line, end_line, 'function' AS chunk_type FROM ({_SIZED.format(9)}) UNION ALL SELECT file_path, start_line, end_line, NULL FROM ({_SIZED.format(10)}))"
_ISLANDS = """i AS (SELECT *, CASE WHEN {s} <= max({e}) OVER (PARTITION BY file_path ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM {t}),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS island FROM i)"""
_OVER = "least(c.end_line, t.end_line) - greatest(c.start_line, t.start_line) + 1"

ORACLE_SQL = {
    "chunk_lines": f"WITH {CHUNKS} SELECT doc_id, start_line, end_line, {TOKENS.format('content')} AS tokens, md5(content) AS content_md5 FROM chunks",
    "chunk_tokens": f"""WITH RECURSIVE {LINES}, t AS (SELECT *, {TOKENS.format('line')} AS k, max(n) OVER (PARTITION BY doc_id) AS last FROM lines),
        r AS (SELECT doc_id, n, k AS total, 1 AS start_line, k >= {TARGET_TOKENS} AS cut FROM t WHERE n = 1 UNION ALL
              SELECT t.doc_id, t.n, t.k + CASE WHEN r.cut THEN 0 ELSE r.total END, CASE WHEN r.cut THEN t.n ELSE r.start_line END, t.k + CASE WHEN r.cut THEN 0 ELSE r.total END >= {TARGET_TOKENS}
              FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n + 1),
        b AS (SELECT doc_id, start_line, max(n) AS end_line, bool_or(cut) AS cut, max(total) AS total FROM r GROUP BY 1, 2),
        c AS (SELECT b.doc_id, b.start_line, b.end_line, b.cut, b.total, string_agg(line, chr(10) ORDER BY n) AS content FROM b JOIN lines l ON l.doc_id = b.doc_id AND n BETWEEN b.start_line AND b.end_line GROUP BY ALL)
        SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(CASE WHEN cut THEN total ELSE {TOKENS.format('content')} END AS BIGINT) AS tokens, md5(content) AS content_md5 FROM c""",
    "chunk_stats": f"""WITH {CHUNKS}, t AS (SELECT *, {TOKENS.format('content')} AS k FROM chunks)
        SELECT count(*) AS chunks, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(k) // count(*) AS BIGINT) AS avg_tokens, min(k) AS min_tokens, max(k) AS max_tokens FROM t""",
    "line_window": f"""WITH {LINES}, w AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY file_path ORDER BY n ROWS UNBOUNDED PRECEDING) AS used FROM lines WHERE n BETWEEN 2 AND 6),
        a AS (SELECT file_path, max(n) AS n FROM lines GROUP BY 1)
        SELECT w.file_path, CAST(2 AS BIGINT) AS first, max(w.n) AS last, string_agg(line, chr(10) ORDER BY w.n) AS content, max(w.n) < max(a.n) AS truncated FROM w JOIN a USING (file_path) WHERE used <= 400 GROUP BY 1""",
    "enclosing_chunk": f"""WITH {CHUNKS}, p AS (SELECT file_path, unnest([1, 7, 60, 500])::BIGINT AS line FROM files)
        SELECT p.file_path, p.line, c.start_line, c.end_line FROM p LEFT JOIN chunks c ON c.file_path = p.file_path AND p.line BETWEEN c.start_line AND c.end_line""",
    "text_search_literal": f"WITH {LINES} SELECT file_path, n, instr(line, 'token') AS \"column\", line FROM lines WHERE contains(line, 'token') ORDER BY file_path, n LIMIT 1000",
    "grep_hunks": f"""WITH {LINES}, a AS (SELECT file_path, max(n) AS total FROM lines GROUP BY 1),
        m AS (SELECT file_path, greatest(n - 1, 1) AS first, least(n + 2, total) AS last FROM lines JOIN a USING (file_path) WHERE regexp_matches(line, '(?i)\\bthe\\b.*\\bof\\b')), {_ISLANDS.format(s='first', e='last', t='m')}
        SELECT file_path, min(first) AS first, max(last) AS last, count(*) AS n_matches FROM g GROUP BY file_path, island""",
    "grep_page": f"""WITH {LINES}, a AS (SELECT file_path, max(n) AS total FROM lines GROUP BY 1),
        h AS (SELECT file_path, n FROM lines WHERE regexp_matches(line, '(?i)\\bthe\\b.*\\bof\\b') ORDER BY file_path, n LIMIT 60),
        m AS (SELECT file_path, greatest(n - 1, 1) AS first, least(n + 2, total) AS last FROM h JOIN a USING (file_path)), {_ISLANDS.format(s='first', e='last', t='m')},
        k AS (SELECT file_path, min(first) AS first, max(last) AS ende FROM g GROUP BY file_path, island ORDER BY 1, 2 LIMIT 20),
        s AS (SELECT k.*, n, regexp_matches(line, '(?i)\\bthe\\b.*\\bof\\b') AS hit, n || CASE WHEN hit THEN ':* ' ELSE ':  ' END || line AS text FROM k JOIN lines l ON l.file_path = k.file_path AND n BETWEEN first AND ende),
        u AS (SELECT *, 12000 - sum(length(text) + 1) OVER (ORDER BY file_path, n) + length(text) AS rest FROM s)
        SELECT file_path, first, max(n) AS last, count(*) FILTER (hit) AS n_matches, string_agg(CASE WHEN length(text) <= rest THEN text ELSE left(text, rest::BIGINT) END, chr(10) ORDER BY n) AS content, max(n) = ende AND bool_and(length(text) <= rest) AS complete
        FROM u WHERE length(text) <= rest OR (hit AND rest > 0) GROUP BY file_path, first, ende HAVING count(*) FILTER (hit) > 0""",
    "near_dup_jaccard": rf"""WITH {LINES}, c AS ({_SIZED.format(10)}), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS words FROM c),
        p AS (SELECT *, lead(start_line) OVER o AS next_start, lead(words) OVER o AS nxt FROM w WINDOW o AS (PARTITION BY file_path ORDER BY start_line, end_line)),
        s AS (SELECT file_path, start_line, next_start, len(list_intersect(words, nxt)) AS shared, len(list_distinct(list_concat(words, nxt))) AS either FROM p WHERE next_start <= end_line + 10)
        SELECT file_path, start_line, next_start, round(CASE WHEN either = 0 THEN 0.0 ELSE shared / either END, 6) AS similarity, round(CASE WHEN either = 0 THEN 0.0 ELSE shared / either END, 6) >= 0.8 AS similar FROM s""",
    "shadowed_chunks": f"""WITH {_TYPED} SELECT file_path, start_line, end_line, chunk_type FROM typed c WHERE chunk_type IS NOT NULL OR NOT EXISTS (
        SELECT 1 FROM typed t WHERE t.file_path = c.file_path AND t.chunk_type IS NOT NULL AND ({_OVER}) * 10 >= (c.end_line - c.start_line + 1) * 9)""",
    "dedup_spans": f"""WITH {_TYPED}, m AS (SELECT file_path, start_line + CASE WHEN chunk_type IS NULL THEN 4 ELSE 0 END AS start_line, end_line FROM typed), v AS (SELECT * FROM m WHERE start_line <= end_line), {_ISLANDS.format(s='start_line', e='end_line', t='v')}
        SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS n FROM g GROUP BY file_path, island""",
    "overlap_dedupe": f"""WITH {_TYPED}, k AS (SELECT *, CASE WHEN chunk_type IS NULL THEN 1 ELSE 0 END AS tier, start_line || ':' || end_line || ':' || CASE WHEN chunk_type IS NULL THEN 1 ELSE 0 END AS key FROM typed)
        SELECT file_path, key FROM k c WHERE NOT EXISTS (SELECT 1 FROM k t WHERE t.file_path = c.file_path AND {_OVER} >= 0.7 * (least(c.end_line - c.start_line, t.end_line - t.start_line) + 1) AND (t.tier > c.tier OR (t.tier = c.tier AND t.key < c.key)))""",
    "dir_map": f"""WITH {CHUNKS}, d AS (SELECT {_DIR.format(2)} AS directory, count(*) AS chunks, count(DISTINCT file_path) AS files, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines FROM chunks GROUP BY 1)
        SELECT *, round(floor(lines * 10000 / sum(lines) OVER ()) / 100, 6) AS coverage FROM d""",
    "dir_top_symbols": f"""WITH {CHUNKS}, r AS (SELECT {_DIR.format(1)} AS directory, file_path, nullif(regexp_extract(content, '([A-Z][a-z]+)', 1), '') AS symbol, end_line - start_line + 1 AS n, end_line FROM chunks),
        z AS (SELECT file_path, max(end_line) AS size FROM r GROUP BY 1), p AS (SELECT directory, file_path, symbol, max(n) AS n FROM r WHERE symbol IS NOT NULL GROUP BY ALL),
        s AS (SELECT directory, symbol, round(sum(least(n, size) / size), 6) AS score FROM p JOIN z USING (file_path) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY score DESC, symbol) AS rank FROM s)
        SELECT * FROM k WHERE rank <= 5""",
    "overview_layers": f"WITH {CHUNKS} SELECT string_split(file_path, '/')[1] AS layer, count(DISTINCT file_path) AS files, 'Module' AS role FROM chunks GROUP BY 1",
    "index_stats": f"""WITH {CHUNKS} SELECT CASE regexp_extract(file_path, '[^.]*$') WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'yaml' THEN 'yaml' WHEN 'rs' THEN 'rust' ELSE 'unknown' END AS language,
        count(DISTINCT file_path) AS files, count(*) AS chunks, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines FROM chunks GROUP BY 1""",
    "repo_signals": f"""WITH {FILES} SELECT count(*) AS files, count(*) FILTER (ends_with(file_path, '.md')) AS docs, count(*) FILTER (ends_with(file_path, '.yaml')) AS configs,
        count(*) FILTER (ends_with(file_path, '.py') OR ends_with(file_path, '.rs')) AS code, CAST(0 AS BIGINT) AS data, CAST(0 AS BIGINT) AS manifest_scopes FROM files""",
    "evidence_fetch": f"""WITH {LINES}, c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS cut FROM lines WHERE n BETWEEN 2 AND 4 GROUP BY 1)
        SELECT file_path, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS stale, false AS missing, md5(coalesce(cut, '')) AS content_md5 FROM files LEFT JOIN c USING (doc_id)""",
    "keyset_page": f"WITH {FILES} SELECT file_path FROM files WHERE file_path > 'src1/en' ORDER BY file_path LIMIT 100",
}
