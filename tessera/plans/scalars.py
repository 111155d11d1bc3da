"""Queries of the scalar functions and path predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.plans.base import FILES, LOWERED, QUERIES as QUERY_TABLE, files, queries, table, words_sql
from tessera.profile import GENERAL, PathRule

LOW = LOWERED.format("path")
BASE = "regexp_extract(path, '[^/]*$')"
EXT = f"CASE WHEN regexp_matches({BASE}, '^.+\\.[^.]*$') THEN {LOWERED.format(f'regexp_extract({BASE}, ' + chr(39) + '[^.]*$' + chr(39) + ')')} END"
URLS = "urls AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their address without its scheme, as paths."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def rule_sql(rule: PathRule, low: str = LOW) -> str:
    function = {"prefix": "starts_with", "suffix": "ends_with", "contains": "contains"}[rule.kind]
    return f"{function}({low}, '{rule.pattern.lower()}')"


def any_sql(rules, low: str = LOW) -> str:
    return "(" + " OR ".join(rule_sql(r, low) for r in rules) + ")"


def weight_sql(rules, low: str = LOW) -> str:
    return "(" + " * ".join(f"(CASE WHEN {rule_sql(r, low)} THEN {r.weight!r}::DOUBLE ELSE 1.0 END)" for r in rules) + ")"


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.token_estimate(F.col("content")).alias("tokens"), F.size(text.lines_of(F.col("content"))).cast("bigint").alias("n_lines"), F.sha2("content", 256).alias("sha256"))


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return files(spark, sf_dir).select(
        "doc_id", paths.language_of(path).alias("language"), paths.path_kind(path).alias("kind"), paths.directory_key(path, 2).alias("directory"),
        paths.is_secret_file(path).alias("secret"), paths.entrypoint_rank(path).alias("entry_rank"), paths.is_contract(path).alias("contract"),
    )


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return urls(spark, sf_dir).select(
        "page_id", F.round(paths.rule_weight(path, GENERAL.boost), 9).alias("boost"),
        F.round(paths.rule_weight(path, [*GENERAL.boost, *GENERAL.penalty]), 9).alias("weight"),
        paths.any_rule(path, GENERAL.reject).alias("rejected"), paths.any_rule(path, [*GENERAL.reject, *GENERAL.noise]).alias("noise"),
    )


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = paths.path_allowed(F.col("file_path"), ["src0", "src1/en", " "], ["src1/en/doc_1.md", "src0/fr"], "*.md")
    return files(spark, sf_dir).where(allowed).select("doc_id", "file_path")


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = text.query_tokens(F.col("text"))
    return items.select("item_id", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, " ").alias("tokens"), F.array_join(text.content_tokens(F.col("text"), F.slice(tokens, 1, 5), 210), " ").alias("seen"))


#: Queries of every kind: each page's title words, path and identifier.
def query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages")
    forms = F.array(F.col("url"), F.regexp_extract("url", r"([^/.]+)\.", 1), F.concat(F.lit("How does "), F.regexp_extract("url", "([0-9]+)", 1), F.lit(" work")), F.concat(F.lit("page_"), F.col("page_id"), F.lit(" ttl")), F.lit("usage guide"))
    asked = page.select("page_id", F.posexplode(forms).alias("form", "query"))
    q, weights = F.col("query"), text.query_weights(F.col("query"))
    return asked.select("page_id", F.col("form").cast("bigint").alias("form"), text.query_kind(q).alias("kind"), weights["semantic"].alias("semantic"), weights["fuzzy"].alias("fuzzy"), weights["multiplier"].cast("bigint").alias("multiplier"), text.is_docs_intent(q).alias("docs_intent"), text.strategy_of(q).alias("strategy"))


def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select("query_id", F.concat(F.lit("searchIndex error_handling "), F.col("query")).alias("query"))
    expanded = text.expand_query(F.col("query"))
    return asked.select("query_id", F.size(expanded).cast("bigint").alias("n"), F.array_join(expanded, " ").alias("expanded"))


def word_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.word_position(F.col("content"), "the").cast("bigint").alias("word_at"), text.word_position(F.col("content"), "@").cast("bigint").alias("sign_at"), text.has_secret_assignment(F.col("content")).alias("secret"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    values = {"path": path, "language": paths.language_of(path), "text": F.col("content")}
    return files(spark, sf_dir).select("doc_id", F.sha2(text.render_template("Test: {path}\nLanguage: {language}\n\n{text}", values, 8192), 256).alias("rendered"))


QUERIES = {
    "token_estimate": token_estimate, "path_kind": path_kinds, "path_weight": path_rules, "path_filter": path_filter, "query_tokens": query_tokens,
    "query_class": query_class, "query_expand": query_expand, "text_search_word": word_find, "template_render": template_render,
}

_LANG = " ".join(f"WHEN ext IN ({_listed(x)}) THEN '{n}'" for n, x in paths.LANGUAGES.items())
_FORMS = "[url, regexp_extract(url, '([^/.]+)\\.', 1), 'How does ' || regexp_extract(url, '([0-9]+)', 1) || ' work', 'page_' || page_id || ' ttl', 'usage guide']"
_ISPATH = r"(regexp_matches({0}, '[/\\]') OR contains({0}, '::') OR regexp_matches({0}, '\.[A-Za-z0-9]{{1,6}}$'))"
_ISID = "(NOT contains({0}, ' ') AND (contains({0}, '_') OR regexp_matches({0}, '[0-9]') OR (regexp_matches({0}, '[a-z]') AND regexp_matches({0}, '[A-Z]'))))"
_SYN = "MAP {" + ", ".join(f"'{k}': [{_listed(v)}]" for k, v in text.SYNONYMS.items()) + "}"

ORACLE_SQL = {
    "token_estimate": f"""WITH {FILES} SELECT doc_id, greatest(CAST(floor(strlen(content) / 4) AS BIGINT), 1) AS tokens,
        CAST(len(string_split(content, chr(10))) - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines, sha256(content) AS sha256 FROM files""",
    "path_kind": f"""WITH {FILES}, p AS (SELECT doc_id, file_path AS path FROM files), e AS (SELECT *, {EXT} AS ext FROM p)
        SELECT doc_id, CASE {_LANG} ELSE 'unknown' END AS language,
          CASE WHEN ext IN ({_listed(paths.DOCS_EXTENSIONS)}) THEN 'docs' WHEN ext IN ({_listed(paths.CONFIG_EXTENSIONS)}) THEN 'config'
               WHEN len(list_filter(string_split({LOW}, '/'), lambda x: x IN ({_listed(paths.TEST_DIRECTORIES)}))) > 0 THEN 'test' WHEN ext IS NOT NULL THEN 'code' ELSE 'other' END AS kind,
          array_to_string(string_split(path, '/')[1:2], '/') AS directory, coalesce(ext IN ({_listed(paths.SECRET_EXTENSIONS)}), false) AS secret,
          CAST(NULL AS INTEGER) AS entry_rank, false AS contract FROM e""",
    "path_weight": f"""WITH {URLS} SELECT page_id, round({weight_sql(GENERAL.boost)}, 9) AS boost, round({weight_sql([*GENERAL.boost, *GENERAL.penalty])}, 9) AS weight,
        {any_sql(GENERAL.reject)} AS rejected, {any_sql([*GENERAL.reject, *GENERAL.noise])} AS noise FROM urls""",
    "path_filter": f"""WITH {FILES} SELECT doc_id, file_path FROM files WHERE (starts_with(file_path, 'src0/') OR starts_with(file_path, 'src1/en/'))
        AND NOT (file_path = 'src1/en/doc_1.md' OR starts_with(file_path, 'src0/fr/')) AND ends_with(file_path, '.md')""",
    "query_tokens": f"""WITH t AS (SELECT item_id, {words_sql("coalesce(text, '')")} AS w FROM benchmark), d AS (SELECT *, list_sort(list_distinct(w)) AS tokens FROM t)
        SELECT item_id, CAST(len(tokens) AS BIGINT) AS n, array_to_string(tokens, ' ') AS tokens, array_to_string(list_filter(w, lambda x: list_contains(tokens[1:5], x))[1:210], ' ') AS seen FROM d""",
    "query_class": f"""WITH a AS (SELECT page_id, unnest(f) AS query, generate_subscripts(f, 1) - 1 AS form FROM (SELECT page_id, {_FORMS} AS f FROM pages)),
        t AS (SELECT *, regexp_split_to_array(trim(query), '\\s+') AS tokens FROM a),
        c AS (SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda x: {_ISPATH.format('x')})) AS paths, regexp_replace(tokens[1], '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') AS first FROM t),
        k AS (SELECT *, CASE WHEN trim(query) = '' THEN 'conceptual' WHEN paths > 0 AND (paths = n OR n <= 2) THEN 'path'
          WHEN (n > 1 AND first <> '' AND NOT {_ISPATH.format('first')} AND lower(first) NOT IN ({_listed(text.QUESTION_LEADERS)}) AND {_ISID.format('first')}) OR {_ISID.format('trim(query)')} THEN 'identifier' ELSE 'conceptual' END AS kind FROM c)
        SELECT page_id, form, kind, CASE kind WHEN 'identifier' THEN 0.1 WHEN 'path' THEN 0.15 ELSE CASE WHEN n >= 4 THEN 0.9 ELSE 0.8 END END::DOUBLE AS semantic,
          CASE kind WHEN 'identifier' THEN 0.9 WHEN 'path' THEN 0.85 ELSE CASE WHEN n >= 4 THEN 0.1 ELSE 0.2 END END::DOUBLE AS fuzzy,
          CASE kind WHEN 'identifier' THEN 3 WHEN 'path' THEN 4 ELSE 6 END::BIGINT AS multiplier,
          (regexp_matches(lower(query), '[^/]\\.mdx?$') OR {" OR ".join(f"contains(lower(query), '{x}')" for x in text.DOCS_NEEDLES)}) AS docs_intent,
          CASE WHEN regexp_matches(lower(query), 'architecture|overview|design|end-to-end|pipeline') THEN 'deep' WHEN regexp_matches(lower(query), 'flow|how |call|depend|usage|impact') THEN 'extended' ELSE 'direct' END AS strategy FROM k""",
    "query_expand": f"""WITH {QUERY_TABLE}, q AS (SELECT query_id, 'searchIndex error_handling ' || query AS query FROM queries),
        w AS (SELECT *, list_transform(regexp_extract_all(query, '(\\p{{Lu}}+[^\\p{{Lu}}\\s_]*|[^\\p{{Lu}}\\s_]+)', 1), lambda x: lower(x)) AS words FROM q),
        a AS (SELECT query_id, list_concat([query], words, flatten(list_transform(words, lambda x: coalesce({_SYN}[x], [])))) AS terms FROM w),
        u AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS n FROM a), f AS (SELECT query_id, term, min(n) AS n FROM u GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS k FROM f)
        SELECT query_id, count(*) AS n, string_agg(term, ' ' ORDER BY k) AS expanded FROM r WHERE k <= 15 GROUP BY 1""",
    "text_search_word": rf"""WITH {FILES}, s AS (SELECT *, {LOWERED.format('content')} AS low FROM files)
        SELECT doc_id, CASE WHEN regexp_matches(low, '(^|[^a-z0-9_])the($|[^a-z0-9_])') THEN length(regexp_extract(' ' || low || ' ', '(?s)^(.*?[^a-z0-9_])the[^a-z0-9_]', 1)) ELSE 0 END::BIGINT AS word_at,
          CAST(instr(low, '@') AS BIGINT) AS sign_at, regexp_matches(content, '(?i)(password|passwd|secret|token|api_?key)["'']?\s*[:=]\s*["'']?[A-Za-z0-9+/_.\-]{{8,}}') AS secret FROM s""",
    "template_render": f"""WITH {FILES}, p AS (SELECT doc_id, content, file_path AS path FROM files), e AS (SELECT *, {EXT} AS ext FROM p)
        SELECT doc_id, sha256(substr('Test: ' || path || chr(10) || 'Language: ' || CASE {_LANG} ELSE 'unknown' END || chr(10) || chr(10) || content, 1, 8192)) AS rendered FROM e""",
}
