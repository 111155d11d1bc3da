"""Secret scans with multipart credential linking (DataFrame operations only).

Strong patterns are reported as they stand. Weak candidates (bare identifiers, bare keys of 40
characters or more, endpoints) are reported only when complementary parts lie within the same scope, apart
from them: an interval join on position buckets. Parts are runs of characters, so that a scope has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import materialize, table

#: Span kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "id_part", "key_part", "endpoint")
ASSIGN, ACCESS, HEX, ID_PART, KEY_PART, ENDPOINT = range(len(KINDS))
PATTERNS = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]{16,}",
    r"[0-9a-f]{24,}",
    r"[A-Z0-9]{16,}",
    r"[A-Za-z0-9+/]{40,}",
    r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?",
)
#: Characters between the starts of parts that may belong to one credential.
SCOPE = 400
#: What must lie in the scope of a weak candidate, by kind: identifiers need a key, keys an identifier, endpoints both.
NEEDS = ((ID_PART, "key"), (KEY_PART, "id"), (ENDPOINT, "id"), (ENDPOINT, "key"))
IS_ID, IS_KEY = (ACCESS, ID_PART), (ASSIGN, HEX, KEY_PART)


def _may_match(text: Column) -> tuple[Column, ...]:
    """Cheap tests without which a pattern has no match."""
    low = F.lower(text)
    word = F.lit(False)
    for w in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        word = word | F.contains(low, F.lit(w))
    return (
        word,
        F.contains(text, F.lit("AKIA")),
        text.rlike(PATTERNS[HEX]),
        text.rlike(PATTERNS[ID_PART]),
        text.rlike(PATTERNS[KEY_PART]),
        F.contains(text, F.lit("http")) & F.contains(text, F.lit("://")),
    )


def _accepted(kind: int, hit: Column, value: Column) -> Column:
    """Whether a match counts; value is the assigned value for ASSIGN, else the match."""
    if kind == ASSIGN:
        return F.length(value) >= 6
    if kind == ID_PART:
        return (F.length(hit) <= 32) & hit.rlike("[A-Z]") & hit.rlike("[0-9]") & ~F.contains(hit, F.lit("AKIA"))
    if kind == KEY_PART:
        return (F.length(hit) >= 40) & hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]")
    return F.lit(True)


def _matches(text: Column, kind: int) -> Column:
    """All matches in order as (gap before the match, length, accepted), without the texts."""
    pattern = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == ASSIGN else hits
    gaps = F.split(text, PATTERNS[kind], -1)
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")),
        lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("len"), _accepted(kind, m["hit"], m["value"]).alias("ok")),
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Returns a row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links.

    * Positions are code points, end exclusive. A null text is the empty text; texts without spans
      have zero counts, an empty `spans` and the digest of the empty string.
    * Base kinds (assign, access, hex) are always reported; id_part, key_part and endpoint only
      with complementary parts whose start lies within `scope` of theirs and that share no
      character with them: an identifier inside an assigned value does not go with that value.
    * links names what each of those goes with, as `candidate>part` in order of the candidates: of
      identifiers the nearest key, of keys the nearest identifier, of endpoints both, identifier
      first; of parts as near the first.
    * Rows that repeat an id are scanned each on its own, and a null id is passed through. Texts may
      have any length; an empty table gives an empty result, and other columns are not read.
    * Matches of one document are numbered by a window over that document alone; parts meet by
      (document, bucket). Parts of a kind don't overlap, and all of them have 6 characters or more, so a
      candidate meets at most 2 * scope / 6 parts whatever the size of the document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = _may_match(text)
    nothing = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    found = F.array(*(
        F.struct(F.lit(k).alias("kind"), F.when(may[k], _matches(text, k)).otherwise(nothing).alias("hits")) for k in range(len(KINDS))
    ))
    scanned = materialize(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.filter(found, lambda x: F.size(x["hits"]) > 0).alias("found")),
        "secret-matches",
    )
    hits = (
        scanned.select("row", F.explode("found").alias("f"))
        .select("row", F.col("f.kind").alias("kind"), F.posexplode("f.hits").alias("pos", "m"))
    )
    upto = F.sum(F.col("m.gap") + F.col("m.len")).over(W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    spans = materialize(
        hits.withColumn("end", upto).where("m.ok").select("row", "kind", (F.col("end") - F.col("m.len")).alias("start"), "end"), "secret-spans"
    )

    bucket = F.floor(F.col("start") / scope)
    part = F.when(F.col("kind").isin(*IS_ID), "id").when(F.col("kind").isin(*IS_KEY), "key")
    parts = spans.withColumn("part", part).where("part IS NOT NULL").select("row", "part", bucket.alias("bucket"), F.struct("start", "kind", "end").alias("p"))
    needs = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("part")) for k, p in NEEDS))
    near = F.array(*(bucket + i for i in (-1, 0, 1)))
    wanted = (
        spans.where(F.col("kind") >= ID_PART)
        .select("*", F.explode(F.filter(needs, lambda x: x["kind"] == F.col("kind"))["part"]).alias("part"))
        .select("row", "kind", "start", "end", "part", F.explode(near).alias("bucket"))
    )
    distance = F.abs(F.col("p.start") - F.col("start"))
    apart = (F.col("p.end") <= F.col("start")) | (F.col("end") <= F.col("p.start"))
    nearest = (
        wanted.join(parts, ["row", "part", "bucket"]).where((distance <= scope) & apart)
        .groupBy("row", "kind", "start", "end", "part").agg(F.min(F.struct(distance.alias("d"), "p"))["p"].alias("p"))
    )
    linked = (
        nearest.groupBy("row", "kind", "start", "end").agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("with"))
        .where(F.size("with") >= F.when(F.col("kind") == ENDPOINT, 2).otherwise(1))
        .withColumn("with", F.transform("with", lambda x: x["p"]))
    )
    spans = spans.where(F.col("kind") < ID_PART).withColumn("with", F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "with")))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, shown), ",")
    pairs = F.flatten(F.transform("all", lambda s: F.transform(s["with"], lambda p: F.concat_ws(">", shown(s), shown(p)))))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    per_row = (
        spans.unionByName(linked).groupBy("row")
        .agg(count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"), listed.alias("all"))
    )
    base = joined(F.filter("all", lambda s: s["kind"] < ID_PART))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return scanned.select("doc_id", "row").join(per_row, "row", "left").select(
        "doc_id", n("n_assign"), n("n_access"), n("n_hex"),
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("links"),
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret scan of all whole documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rows in DuckDB, the links by plain comparison of all parts of a document."""
    quoted = [p.replace("'", "''") for p in PATTERNS]
    scans = " UNION ALL ".join(
        f"SELECT row, {k} AS kind, regexp_extract_all(text, '{p}', 0) AS hit, regexp_extract_all(text, '{p}', {2 if k == ASSIGN else 0}) AS value, regexp_split_to_array(text, '{p}') AS gap FROM d"
        for k, p in enumerate(quoted)
    )
    has = lambda c: f"regexp_matches(hit, '{c}')"
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    at = "list_value({0})[{1}.kind + 1] || ':' || {1}.start || ':' || {1}.stop"
    near = (
        f"(SELECT min_by({at.format(kinds, 'o')}, [abs(o.start - s.start), o.start, o.kind, o.stop]) FROM s o "
        f"WHERE o.row = s.row AND o.kind IN {{}} AND abs(o.start - s.start) <= {SCOPE} AND (o.stop <= s.start OR s.stop <= o.start))"
    )
    shown = "string_agg([{0}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)".format(kinds)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents), m AS ({scans}),
u AS (SELECT row, kind, unnest(hit) AS hit, unnest(value) AS value, unnest(gap[1:len(hit)]) AS gap, generate_subscripts(hit, 1) AS n FROM m),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY n) AS stop FROM u),
s AS (
  SELECT row, kind, stop - length(hit) AS start, stop FROM p WHERE CASE kind WHEN {ASSIGN} THEN length(value) >= 6
    WHEN {ID_PART} THEN length(hit) <= 32 AND {has("[A-Z]")} AND {has("[0-9]")} AND NOT contains(hit, 'AKIA')
    WHEN {KEY_PART} THEN length(hit) >= 40 AND {has("[A-Z]")} AND {has("[a-z]")} AND {has("[0-9]")} ELSE true END
), w AS (
  SELECT *, CASE WHEN kind IN ({KEY_PART}, {ENDPOINT}) THEN {near.format(IS_ID)} END AS id, CASE WHEN kind IN ({ID_PART}, {ENDPOINT}) THEN {near.format(IS_KEY)} END AS key FROM s
), k AS (
  SELECT * FROM w WHERE kind < {ID_PART} OR ((kind = {ID_PART} OR id IS NOT NULL) AND (kind = {KEY_PART} OR key IS NOT NULL))
), g AS (
  SELECT row, count(*) FILTER (kind = {ASSIGN}) AS n_assign, count(*) FILTER (kind = {ACCESS}) AS n_access, count(*) FILTER (kind = {HEX}) AS n_hex,
         coalesce({shown} FILTER (kind < {ID_PART}), '') AS base, {shown} AS spans,
         string_agg(concat_ws(',', {at.format(kinds, "k")} || '>' || id, {at.format(kinds, "k")} || '>' || key), ',' ORDER BY start, kind, stop) FILTER (id IS NOT NULL OR key IS NOT NULL) AS links FROM k GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM d LEFT JOIN g USING (row)
"""


OP5_SQL = _sql()
