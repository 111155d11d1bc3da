"""Queries of evaluation, incremental tables, event streams (as finished tables), packs and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.paths import changed_area, path_kind
from tessera.functions.vectors import stub_embed
from tessera.operators import aggregates, evaluate, orient, packing, ranking, vector
from tessera.operators.chunking import chunk_by_lines
from tessera.plans.base import CHUNK_LINES, FILES, LOWERED, QUERIES as QUERY_TABLE, files, queries, table, words_sql
from tessera.plans.chunks import CHUNKS
from tessera.plans.search import _ASKED, _topk_sql, asked, vectors
from tessera.sources import notebook, sinks
from tessera.sources.snapshots import SnapshotLog
from tessera.sources.snapshots import index_cycle as cycle
from tessera.sources.work import held_path
from tessera.streaming import debounce

GAP_S, CAP_S, REPEAT_S = 3600, 14_400, 7200


def _run(spark, sf_dir, form) -> DataFrame:
    found = vector.vector_topk(vectors(spark, sf_dir).withColumn("embedding", form("embedding")), asked(spark, sf_dir).withColumn("q", form("q")), 10)
    return found.withColumnRenamed("query_id", "case_id")


def _expected(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("label").cast("bigint").alias("case_id"), F.col("vec_id").alias("item"))


def _cases(spark, sf_dir, half=False) -> DataFrame:
    form = (lambda c: F.slice(c, 1, 32)) if half else F.col
    return evaluate.score_cases(_run(spark, sf_dir, form), _expected(spark, sf_dir))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def eval_cases(spark, sf_dir):
    return _round(_cases(spark, sf_dir), "mrr", "recall", "overlap")


def eval_summary(spark, sf_dir):
    return _round(evaluate.summarize(_cases(spark, sf_dir)), "mean_mrr", "mean_recall", "mean_overlap", "p50_recall", "p95_recall")


def eval_compare(spark, sf_dir):
    return _round(evaluate.compare(_cases(spark, sf_dir), _cases(spark, sf_dir, half=True)), "delta_mrr", "delta_recall")


def precision_at_k(spark, sf_dir):
    return _round(evaluate.precision_at_k(_run(spark, sf_dir, F.col), _expected(spark, sf_dir), 5), "precision")


def compare_overlap(spark, sf_dir):
    return _round(evaluate.overlap_with_baseline(_run(spark, sf_dir, F.col), _run(spark, sf_dir, lambda c: F.slice(c, 1, 32)), 10), "overlap")


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(live, stored) file states: Spanish files are new, those of even length have changed, French ones are gone."""
    d = table(spark, sf_dir, "documents").join(files(spark, sf_dir), "doc_id")
    state = d.select("doc_id", "file_path", "lang", F.col("n_chars").alias("mtime_ms"), F.octet_length("content").cast("bigint").alias("bytes"))
    live = state.where("lang <> 'fr'")
    stored = state.where("lang <> 'es'").withColumn("mtime_ms", F.when(F.col("mtime_ms") % 2 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")))
    return live, stored


def purge_missing(spark, sf_dir):
    live, stored = _states(spark, sf_dir)
    return sinks.purge_missing(stored, live).select("doc_id")


def changed_files(spark, sf_dir):
    live, stored = _states(spark, sf_dir)
    return sinks.changed_files(live, stored.select("file_path", "mtime_ms")).select("doc_id", "mtime_ms")


def corpus_upsert(spark, sf_dir):
    live, stored = _states(spark, sf_dir)
    return sinks.upsert_files(stored.select("file_path", "mtime_ms"), sinks.changed_files(live, stored.select("file_path", "mtime_ms")).select("file_path", "mtime_ms"))


def drift_repair(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    return sinks.missing_vectors(files(spark, sf_dir).select("doc_id", "file_path"), v, "doc_id")


def fs_watermark(spark, sf_dir):
    return sinks.filesystem_watermark(_states(spark, sf_dir)[0])


def staleness(spark, sf_dir):
    """Every order as an index whose watermark may be missing, corrupt or outdated."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def mark(moved):
        git = k % 2 == 0
        return F.struct(F.when(git, "git").otherwise("filesystem").alias("kind"), F.concat(F.lit("h"), F.when(moved & (k % 3 == 0), 1).otherwise(0)).alias("git_head"), (k % 5 == 0).alias("git_dirty"), F.when(moved & (k % 7 == 0), "x").otherwise("y").alias("dirty_hash"), (k + F.when(moved & (k % 11 == 0), 1).otherwise(0)).alias("file_count"), F.lit(1).cast("long").alias("max_mtime_ms"), F.lit(1).cast("long").alias("total_bytes"))

    index = F.when(k % 13 != 0, mark(F.lit(True)))
    reasons = sinks.staleness(F.col("now"), F.col("then"), k % 17 != 0, k % 19 == 0)
    return o.select(k, mark(F.lit(False)).alias("now"), index.alias("then")).select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


def _events(spark, sf_dir) -> DataFrame:
    """Events with their times taken as UTC, whatever the session's time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(micros))


def debounce_batch(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts")
    found = debounce.debounce_batch(e, GAP_S * 1000, CAP_S * 1000)
    return found.select("key", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "events")


def event_dedup(spark, sf_dir):
    return debounce.repeats_dropped(_events(spark, sf_dir), ["user_id", "event_type"], REPEAT_S * 1000).select("event_id")


def session_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    sessions = e.groupBy("user_id", F.session_window("ts", f"{GAP_S} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("largest"))


def rolling_p95(spark, sf_dir):
    e = _events(spark, sf_dir).where("value IS NOT NULL")
    return aggregates.rolling_percentile(e, "user_id", ["ts", "event_id"], "value", 20, 0.95).select("event_id", "p")


def memory_rank(spark, sf_dir):
    asked = queries(spark, sf_dir).select("query_id", text.query_tokens(F.col("query")).alias("terms"))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    return packing.memory_rank(said, asked, {"system": 0, "assistant": 1, "user": 2}).withColumn("rank", F.col("rank").cast("bigint"))


def index_cycle(spark, sf_dir):
    """Chunks and their vectors after three cycles over the documents: without Spanish files and with other texts of those of even length, then
    as they are without French ones, and the last batch again."""
    live = files(spark, sf_dir, "lang", "n_chars").where("doc_id IS NOT NULL").select("lang", "file_path", F.col("n_chars").cast("long").alias("mtime_ms"), F.octet_length("content").cast("bigint").alias("bytes"), "content")
    even = F.col("mtime_ms") % 2 == 0
    early = live.where("lang <> 'es'").withColumns({"content": F.when(even, F.concat(F.lit("early\n"), "content")).otherwise(F.col("content")), "mtime_ms": F.when(even, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms"))})
    log = SnapshotLog(spark, held_path(spark, "index-log"))
    chunk = lambda df: chunk_by_lines(df, CHUNK_LINES)
    for batch, state in (("early", early), ("late", live.where("lang <> 'fr'")), ("late", early)):
        cycle(log, state.drop("lang"), batch, chunk, stub_embed(8))
    key = ["file_path", "start_line", "end_line"]
    held = log.read("chunks").select(*key, F.sha2("content", 256).alias("doc_hash"), F.md5(F.col("content").cast("binary")).alias("content_md5"))
    both = held.join(log.read("vectors"), [*key, "doc_hash"])
    return both.select("file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "content_md5", F.size("vector").cast("bigint").alias("dimension"))


def _notebook(spark, sf_dir, label) -> DataFrame:
    """Anchors of all suppliers."""
    evidence = F.array(F.struct(F.concat(F.lit("s/"), "s_suppkey").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(None).cast("string").alias("sha256")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("canon").alias("kind"), label.alias("label"), evidence.alias("evidence"), F.lit(None).cast("string").alias("fingerprint"))


def notebook_changes(spark, sf_dir):
    """What a suggestion of anchors for all suppliers would change, after one for two thirds of them, edits of every fifth and anchors of
    nobody's suggestion for every seventh."""
    log = SnapshotLog(spark, held_path(spark, "notebook"))
    own, books = _notebook(spark, sf_dir, F.col("s_name")), spark.createDataFrame([], notebook.RUNBOOKS)
    notebook.apply_suggestion(log, own.where("s_suppkey % 3 <> 0").drop("s_suppkey"), books, "first")
    stored = log.read("anchors")
    notebook.edit(log, "changed", anchors=stored.where("CAST(substr(id, 2) AS BIGINT) % 5 = 0").withColumn("label", F.lit("by hand")))
    notebook.edit(log, "added", anchors=own.where("s_suppkey % 7 = 0").drop("s_suppkey"))
    return notebook.preview(log, _notebook(spark, sf_dir, F.concat("s_name", F.lit("!"))).drop("s_suppkey"), books)


def context_pack(spark, sf_dir):
    """Suppliers of a nation as primaries by balance, their parts as related items."""
    s, l = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    first = s.select(F.col("s_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("s"), "s_suppkey").alias("item"), (-F.col("s_acctbal")).alias("rank"), F.lit(700).cast("long").alias("cost"))
    relation = F.when(F.col("l_linenumber") == 1, "Calls").when(F.col("l_linenumber") == 2, "Extends").otherwise("TestedBy")
    parts = l.join(s.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("s"), "l_suppkey").alias("primary"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("item"), relation.alias("relation"), F.col("l_extendedprice").alias("relevance"), F.lit(300).cast("long").alias("cost"))
    return packing.context_pack(first, parts, max_chars=6000)


#: Paths of a repository, as lines: every rule of orientation has one at least. They are taken at the root and within each source.
LAYOUT = """main.rs src/main.py src/__main__.py crates/a/src/main.rs main.go cmd/tool/main.go lib.rs src/lib.rs crates/a/src/lib.rs src/__init__.py src/pkg/__init__.py
src/pkg/deep/__init__.py server.py src/server.py api/src/app.py svc/cli/src/main.rs data/src/main.py results/contracts/a.json contracts/a.proto proto/readme.txt docs/spec/x.md
docs/specs/readme.md schemas/user.schema.json specs/a.rs b/schema/x.toml a/openapi.ts openapi.yaml api/asyncapi.json asyncapi.yml x/events/asyncapi.yaml Cargo.toml
package.json Makefile .env.example .env .github/workflows/ci.yml .github/workflows/release.yml .gitlab-ci.yml Jenkinsfile k8s/service.yaml k8s/ingress.yml deploy/deployment.yaml
charts/a/Chart.yaml charts/a/values.yaml a/helm/extra.yaml helmfile.yml a/helmrelease.yaml kustomization.yaml argocd/application.yaml clusters/x/applicationset.yml application.yaml
skaffold.yaml Tiltfile werf.yml devspace.yaml main.tf a/variables.tf versions.tf infra/network.tf other/network.tf terraform/x.tfvars terragrunt.hcl migrations/1.sql a/schema.sql
prisma/schema.prisma events/user.json messages/a.txt a/b.avsc artifacts/model.bin runs/1.log corpus/a.txt experiments/run.py baseline/x.json a/eval/x.py a/notebooks/n.ipynb
scripts/build.sh pyproject.toml src/util.cc src/x.TSX c docs/guide.html notes.rst README.md .worktrees/a/main.rs image.png contracts/ a/contract/index.md"""


def layout(spark, sf_dir) -> DataFrame:
    """file_path: LAYOUT, the same within each source, and the pages."""
    listed = F.explode(F.lit(LAYOUT.split()))
    top = spark.range(1).select(listed.alias("file_path"))
    within = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().select("source", listed.alias("p")).select(F.concat_ws("/", "source", "p").alias("file_path"))
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("file_path")).where("file_path IS NOT NULL")
    return top.unionByName(within).unionByName(pages).distinct()


def orient_files(spark, sf_dir):
    return orient.classify_files(layout(spark, sf_dir))


def changed_areas(spark, sf_dir):
    """Areas of paths."""
    return layout(spark, sf_dir).select("file_path", changed_area(F.col("file_path")).alias("area"))


def touched_areas(spark, sf_dir):
    """Areas that changed in working copies, which are told apart by the lengths of paths."""
    return orient.touched_areas(layout(spark, sf_dir).select(F.length("file_path").alias("worktree"), F.col("file_path").alias("path"))).withColumn("areas", F.array_join("areas", ","))


def orient_anchors(spark, sf_dir):
    return orient.select_anchors(files(spark, sf_dir))


def meaning_pack(spark, sf_dir):
    return orient.meaning_pack(files(spark, sf_dir), 4000)


def kind_order(spark, sf_dir):
    """Files in the order of their kind, code first, then length."""
    kind = path_kind(F.col("file_path"))
    f = files(spark, sf_dir).select("doc_id", kind.alias("kind"), F.length("content").cast("bigint").alias("score"))
    place = F.when(F.col("kind") == "code", 0).when(F.col("kind") == "config", 1).when(F.col("kind") == "test", 2).otherwise(3)
    return ranking.top_k(f, ["kind"], 5, place, F.desc("score"), "doc_id").withColumn("rank", F.col("rank").cast("bigint"))


QUERIES = {f.__name__: f for f in (
    eval_cases, eval_summary, eval_compare, precision_at_k, compare_overlap, purge_missing, changed_files, corpus_upsert, drift_repair, fs_watermark, staleness,
    debounce_batch, event_dedup, session_counts, rolling_p95, memory_rank, index_cycle, notebook_changes, context_pack, orient_files, changed_areas, touched_areas, orient_anchors, meaning_pack, kind_order,
)}

_CASES = """{0} AS (SELECT e.case_id, coalesce(1.0::DOUBLE / min(r.rank + 1), 0) AS mrr, count(r.item) / any_value(n) AS recall, count(r.item) / (any_value(n) + any_value(k) - count(r.item)) AS overlap
  FROM e LEFT JOIN {1} r ON r.query_id = e.case_id AND r.item = e.item JOIN (SELECT case_id, count(*) AS n FROM e GROUP BY 1) USING (case_id) JOIN (SELECT query_id AS case_id, count(*) AS k FROM {1} GROUP BY 1) USING (case_id) GROUP BY e.case_id)"""
_EVAL = f"""{_ASKED}, e AS (SELECT DISTINCT CAST(label AS BIGINT) AS case_id, vec_id AS item FROM embeddings WHERE embedding IS NOT NULL),
  ra AS ({_topk_sql('embedding', 'q', 10)}), rb AS ({_topk_sql('embedding[1:32]', 'q[1:32]', 10)}), {_CASES.format('ca', 'ra')}, {_CASES.format('cb', 'rb')}"""
_STATES = f"""{FILES}, st AS (SELECT doc_id, f.file_path, lang, n_chars AS mtime_ms, strlen(content) AS bytes FROM documents JOIN files f USING (doc_id)), live AS (SELECT * FROM st WHERE lang <> 'fr'),
  stored AS (SELECT * REPLACE (CASE WHEN mtime_ms % 2 = 0 THEN mtime_ms - 1 ELSE mtime_ms END AS mtime_ms) FROM st WHERE lang <> 'es'),
  changed AS (SELECT l.* FROM live l LEFT JOIN stored s USING (file_path) WHERE s.file_path IS NULL OR l.mtime_ms > s.mtime_ms)"""


def _when(rules) -> str:
    return " ".join(f"WHEN regexp_matches(low, '{pattern}') THEN {value}" for value, pattern in rules)


_ANCHORS = f"""{FILES}, l AS (SELECT file_path, lower(file_path) AS low FROM files), k AS (SELECT file_path, CASE {_when((f"'{n}'", p) for n, _, p in orient.ANCHORS)} END AS kind, CASE {_when((v, p) for _, v, p in orient.ANCHORS)} END AS priority FROM l),
  anchors AS (SELECT kind, priority, arg_min(file_path, {{'depth': len(string_split(file_path, '/')), 'path': file_path}}) AS file_path FROM k WHERE kind IS NOT NULL GROUP BY ALL ORDER BY priority DESC LIMIT {orient.MAX_ANCHORS})"""
_DESCRIBED = r"regexp_matches(low, '\.(proto|avsc|yaml|yml|json|toml|md|rst|txt)$')"
_LAYOUT = f"""p AS (SELECT unnest(string_split('{" ".join(LAYOUT.split())}', ' ')) AS p),
  f AS (SELECT p AS file_path FROM p UNION SELECT s.source || '/' || p FROM p, (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s
    UNION SELECT regexp_replace(url, '^[a-z]+://', '') FROM pages WHERE url IS NOT NULL),
  n AS (SELECT file_path, {LOWERED.format('file_path')} AS low FROM f),
  l AS (SELECT *, string_split(low, '/')[-1] AS name, string_split(low, '/')[1] IN ('artifacts', 'artifact', 'results', 'runs', 'outputs', 'output', 'checkpoints', 'checkpoint', 'data', 'dataset', 'datasets', 'corpus', 'corpora', 'weights') AS scope FROM n)"""
_AREAS = rf"""{_LAYOUT}, a AS (SELECT file_path, CASE WHEN regexp_matches(low, '^\.worktrees(/|$)') THEN NULL
    WHEN regexp_matches(low, '(^(contracts|proto)|/(contracts?|schemas?|specs?|protocols?))/') AND (name = '' OR {_DESCRIBED}) AND name NOT IN ('readme.md', 'readme.rst', 'readme.txt', 'index.md') THEN 'interfaces'
    WHEN name IN ('.gitlab-ci.yml', 'jenkinsfile') OR starts_with(low, '.github/workflows/') THEN 'ci'
    WHEN regexp_matches(low, '(^|/)(k8s|kubernetes|manifests|gitops|infra|terraform|charts)/') THEN 'infra' WHEN scope THEN 'outputs'
    WHEN regexp_matches(low, '^(experiments?|baselines?|bench|benches)/|/(eval|evaluation|analysis|notebooks)/') THEN 'experiments'
    WHEN name IN ('makefile', 'justfile', 'cargo.toml', 'package.json', 'pyproject.toml') OR starts_with(low, 'scripts/') THEN 'tooling'
    WHEN regexp_matches(low, '(^|\.)(rs|py|js|ts|tsx|go|java|kt|c|cc|cpp|cxx|h|hpp|cs|rb|php|swift)$') THEN 'core'
    WHEN starts_with(low, 'docs/') OR regexp_matches(low, '(^|\.)(md|rst|txt)$') THEN 'docs' END AS area FROM l)"""
ORACLE_SQL = {
    "eval_cases": f"WITH {_EVAL} SELECT case_id, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(overlap, 6) AS overlap FROM ca",
    "eval_summary": f"""WITH {_EVAL} SELECT count(*) AS cases, round(avg(mrr), 6) AS mean_mrr, round(avg(recall), 6) AS mean_recall, round(avg(overlap), 6) AS mean_overlap,
        round(quantile_disc(recall, 0.5), 6) AS p50_recall, round(quantile_disc(recall, 0.95), 6) AS p95_recall FROM ca""",
    "eval_compare": f"""WITH {_EVAL} SELECT case_id, round(cb.mrr - ca.mrr, 6) AS delta_mrr, round(cb.recall - ca.recall, 6) AS delta_recall,
        CASE WHEN cb.mrr > ca.mrr THEN 'b' WHEN cb.mrr < ca.mrr THEN 'a' WHEN cb.recall > ca.recall THEN 'b' WHEN cb.recall < ca.recall THEN 'a' ELSE 'tie' END AS winner FROM ca JOIN cb USING (case_id)""",
    "precision_at_k": f"WITH {_EVAL} SELECT query_id AS case_id, round(count(e.item) / count(*), 6) AS precision FROM ra LEFT JOIN e ON e.case_id = ra.query_id AND e.item = ra.item WHERE rank < 5 GROUP BY 1",
    "compare_overlap": f"WITH {_EVAL} SELECT query_id AS case_id, round(count(*) / 10, 6) AS overlap FROM ra JOIN rb USING (query_id, item) GROUP BY 1",
    "purge_missing": f"WITH {_STATES} SELECT doc_id FROM stored SEMI JOIN live USING (file_path)",
    "changed_files": f"WITH {_STATES} SELECT doc_id, mtime_ms FROM changed",
    "corpus_upsert": f"WITH {_STATES} SELECT file_path, mtime_ms FROM stored ANTI JOIN changed USING (file_path) UNION ALL SELECT file_path, mtime_ms FROM changed",
    "drift_repair": f"WITH {FILES} SELECT doc_id, file_path FROM files WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)",
    "fs_watermark": f"WITH {_STATES} SELECT count(*) AS file_count, max(mtime_ms) AS max_mtime_ms, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM live",
    "staleness": """SELECT o_orderkey, concat_ws(',', CASE WHEN k % 17 = 0 THEN 'index_missing' END, CASE WHEN k % 17 <> 0 AND k % 19 = 0 THEN 'index_corrupt' END,
        CASE WHEN ok AND k % 13 = 0 THEN 'watermark_missing' END, CASE WHEN fresh AND k % 2 = 0 AND k % 3 = 0 THEN 'git_head_mismatch' END,
        CASE WHEN fresh AND k % 2 = 0 AND k % 5 = 0 AND k % 7 = 0 THEN 'git_dirty_mismatch' END, CASE WHEN fresh AND k % 2 = 1 AND k % 11 = 0 THEN 'filesystem_changed' END) AS reasons
        FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS ok, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 13 <> 0 AS fresh FROM orders)""",
    "debounce_batch": f"""WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
        r AS (SELECT key, n, t AS first, t AS last, 1 AS batch FROM o WHERE n = 1 UNION ALL
          SELECT o.key, o.n, CASE WHEN o.t > least(r.last + {GAP_S}000000, r.first + {CAP_S}000000) THEN o.t ELSE r.first END, o.t, r.batch + CASE WHEN o.t > least(r.last + {GAP_S}000000, r.first + {CAP_S}000000) THEN 1 ELSE 0 END FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
        SELECT key, min(first) AS first_us, max(last) AS last_us, count(*) AS events FROM r GROUP BY key, batch""",
    "event_dedup": f"WITH l AS (SELECT event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) SELECT event_id FROM l WHERE b IS NULL OR t - b > {REPEAT_S}000000",
    "session_counts": f"""WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {GAP_S}000000 THEN 1 ELSE 0 END AS f FROM events),
        s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY 1""",
    "rolling_p95": "WITH l AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)) AS v FROM events WHERE value IS NOT NULL) SELECT event_id, v[greatest(CAST(ceil(len(v) * 0.95::DOUBLE) AS BIGINT), 1)] AS p FROM l",
    "notebook_changes": """SELECT 'anchor' AS kind, 's' || s_suppkey AS id, CASE WHEN k % 7 = 0 OR (k % 3 <> 0 AND k % 5 = 0) THEN 'skip' WHEN k % 3 = 0 THEN 'create' ELSE 'update' END AS action,
        CASE WHEN k % 7 = 0 THEN 'not_managed' WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'manual_modified' END AS reason FROM (SELECT *, s_suppkey AS k FROM supplier)""",
    "index_cycle": f"WITH {CHUNKS} SELECT file_path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, md5(content) AS content_md5, 8::BIGINT AS dimension FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')",
    "memory_rank": f"""WITH {QUERY_TABLE}, t AS (SELECT query_id, list_sort(list_distinct({words_sql('query')})) AS terms FROM queries),
        s AS (SELECT query_id, conv_id, turn, role, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 99 END AS p, len(list_filter(terms, lambda x: contains(lower(coalesce(text, '')), x))) AS hits FROM t, conversations),
        c AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY hits > 0 DESC, p, hits DESC, turn DESC, conv_id) AS n FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits > 0 DESC, p, hits DESC, turn DESC, conv_id) AS rank FROM c WHERE n <= 2)
        SELECT query_id, conv_id, turn, rank FROM k WHERE rank <= 3""",
    "kind_order": f"""WITH {FILES}, f AS (SELECT doc_id, CASE WHEN ends_with(file_path, '.md') THEN 'docs' WHEN ends_with(file_path, '.yaml') THEN 'config' ELSE 'code' END AS kind, length(content) AS score FROM files),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, doc_id) - 1 AS rank FROM f) SELECT * FROM r WHERE rank < 5""",
    "orient_files": rf"""WITH {_LAYOUT}, r AS (SELECT *, CASE
          WHEN scope THEN NULL WHEN regexp_matches(low, '^(main\.(rs|py|ts|c|cpp|cc|cxx)|__main__\.py|app\.py|server\.(py|js|ts)|index\.js)$') THEN 0
          WHEN regexp_matches(low, '^src/(main\.(rs|py|c|cpp|cc|cxx)|__main__\.py|app\.py|server\.py|index\.(js|ts))$') THEN 1
          WHEN regexp_matches(low, '/src/(main\.(rs|py|c|cpp|cc|cxx)|__main__\.py|app\.py|server\.py|index\.(js|ts))$') OR regexp_matches(low, '^(cmd/(.*/)?)?main\.go$') THEN 2
          WHEN regexp_matches(low, '^((.*/)?src/)?lib\.rs$') OR low = 'src/__init__.py' THEN 3 WHEN regexp_matches(low, '^src/[^/]*/__init__\.py$') THEN 4 END AS entry_rank,
          NOT scope AND (regexp_matches(low, '(^(contracts|proto|schemas?|specs?|protocols?)|/(contracts?|schemas?|specs?|protocols?))/') AND {_DESCRIBED}
            OR starts_with(low, 'contracts/') OR starts_with(low, 'proto/') OR contains(low, '/openapi.') OR contains(low, '/asyncapi.') OR ends_with(low, '.proto') OR ends_with(low, '.schema.json')
            OR regexp_matches(low, '(openapi|asyncapi)\.(json|ya?ml)$')) AS described,
          CASE WHEN regexp_matches(low, '\.ya?ml$') AND (regexp_matches(low, '(^|/)(k8s|kubernetes|manifests|deploy|kustomize|argocd|argo|flux|gitops|clusters|charts)/|/helm/')
              OR name = 'chart.yaml' OR regexp_matches(name, '^(values|helmfile|helmrelease|kustomization|skaffold|werf|devspace)\.ya?ml$'))
            OR regexp_matches(low, '\.(tf|tfvars|hcl)$') AND (regexp_matches(low, '(^|/)(terraform|infra)/') OR regexp_matches(name, '^(main|variables|versions|providers?|backend|outputs|terraform)\.tf$|^terragrunt\.hcl$'))
            OR low = 'tiltfile' THEN CASE WHEN name = 'chart.yaml' THEN 0 WHEN name IN ('values.yaml', 'values.yml') THEN 1 WHEN name IN ('helmfile.yaml', 'helmfile.yml') THEN 2
              WHEN name IN ('helmrelease.yaml', 'helmrelease.yml') THEN 3 WHEN name IN ('kustomization.yaml', 'kustomization.yml') THEN 4
              WHEN name IN ('application.yaml', 'application.yml', 'applicationset.yaml', 'applicationset.yml') AND regexp_matches(low, '(^|/)(argocd|argo|flux|gitops|clusters)/') THEN 5
              WHEN name = 'terragrunt.hcl' THEN 6 WHEN name IN ('skaffold.yaml', 'skaffold.yml') THEN 7 WHEN low = 'tiltfile' THEN 8 WHEN name IN ('werf.yaml', 'werf.yml') THEN 9
              WHEN name IN ('devspace.yaml', 'devspace.yml') THEN 10 WHEN contains(low, 'ingress') THEN 11 WHEN contains(low, 'service') THEN 12
              WHEN contains(low, 'deployment') OR contains(low, 'statefulset') THEN 13 WHEN name = 'main.tf' THEN 14 WHEN name = 'variables.tf' THEN 15
              WHEN name IN ('versions.tf', 'provider.tf', 'providers.tf', 'backend.tf', 'outputs.tf', 'terraform.tf') THEN 16 WHEN NOT regexp_matches(low, '\.ya?ml$') THEN 17 ELSE 18 END END AS infra FROM l),
        t AS (SELECT *, infra IS NOT NULL AND row_number() OVER (ORDER BY infra NULLS LAST, file_path) <= 8 AS told, described AND entry_rank IS NULL AS contract FROM r),
        k AS (SELECT *, CASE WHEN low IN ('cargo.toml', 'package.json', 'pyproject.toml', 'go.mod', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'makefile', 'justfile', '.github/workflows/ci.yml', '.github/workflows/ci.yaml') THEN 'config 1.0'
          WHEN low IN ('.env.example', '.env.sample', '.env.template', '.env.dist') THEN 'env 1.0' WHEN entry_rank IS NOT NULL AND regexp_matches(low, '/server\.|/api/|/http/') THEN 'http 0.7'
          WHEN entry_rank IS NOT NULL AND regexp_matches(low, '/(cli|cmd|bin)/') THEN 'cli 0.7' WHEN entry_rank IS NOT NULL THEN 'cli 0.55'
          WHEN told THEN 'config ' || [0.9, 0.85, 0.82, 0.83, 0.85, 0.82, 0.85, 0.83, 0.83, 0.82, 0.82, 0.8, 0.78, 0.78, 0.85, 0.82, 0.8, 0.78, 0.75][infra + 1]
          WHEN regexp_matches(low, '(^|/)migrations/|^prisma/|schema\.(sql|prisma)$') THEN 'db 0.85'
          WHEN regexp_matches(low, '^asyncapi\.(ya?ml|json)$|/asyncapi\.|\.avsc$|(^|/)(events|messages)/') THEN CASE WHEN contains(low, 'asyncapi') THEN 'event 1.0' WHEN ends_with(low, '.avsc') THEN 'event 0.9' ELSE 'event 0.75' END END AS b FROM t)
        SELECT file_path, entry_rank, contract, CASE WHEN NOT contract THEN NULL WHEN ends_with(low, '.proto') OR starts_with(low, 'proto/') THEN 'proto' WHEN ends_with(low, '.schema.json') THEN 'jsonschema'
          WHEN regexp_matches(low, 'openapi\.(json|ya?ml)$|/openapi\.') THEN 'openapi' WHEN regexp_matches(low, 'asyncapi\.(json|ya?ml)$|/asyncapi\.') THEN 'asyncapi' ELSE 'contract' END AS contract_kind,
          string_split(b, ' ')[1] AS boundary, CAST(string_split(b, ' ')[2] AS DOUBLE) AS confidence FROM k""",
    "changed_areas": f"WITH {_AREAS} SELECT file_path, area FROM a",
    "touched_areas": f"""WITH {_AREAS}, d AS (SELECT DISTINCT length(file_path) AS worktree, area, list_position(['interfaces', 'core', 'ci', 'docs', 'tooling', 'infra', 'outputs', 'experiments'], area) AS o FROM a WHERE area IS NOT NULL)
        SELECT CAST(worktree AS INTEGER) AS worktree, array_to_string(list(area ORDER BY o)[1:5], ',') AS areas FROM d GROUP BY worktree""",
    "orient_anchors": f"WITH {_ANCHORS} SELECT kind, file_path, priority FROM anchors",
    "meaning_pack": f"""WITH {_ANCHORS}, r AS (SELECT 0 AS s, 'ANCHORS' AS section, -priority AS o, 'A ' || kind || ' ' || file_path AS line FROM anchors
        UNION ALL SELECT 1, 'MAP', -count(*), 'M ' || string_split(file_path, '/')[1] || ' Module ' || count(*) FROM files GROUP BY string_split(file_path, '/')[1]),
        w AS (SELECT section, line, row_number() OVER x AS ord, sum(length(line) + 1) OVER (x ROWS UNBOUNDED PRECEDING) AS used FROM r WINDOW x AS (ORDER BY s, o, line)) SELECT section, ord, line FROM w WHERE used <= 4000""",
}
