"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Tokens are summed by cell (source, language, topic); the cells' weights are raked to the marginals in
turn until all hold; a document is then drawn at the rate of its cell: whole copies, and one more
by lot. Documents never move: the cells, at most one for each combination, come to them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

DIMENSIONS = ("source", "lang", "topic")
#: Target shares of the languages; other languages share OTHER_LANG.
LANG_TARGET = {"en": 0.5, "fr": 0.17, "de": 0.17, "es": 0.15}
OTHER_LANG = 0.01
#: Target shares of the topics of topic_of().
TOPIC_TARGET = {"notice": 0.05, "table": 0.1, "contact": 0.1, "brief": 0.1, "article": 0.4, "long": 0.25}
#: Sources get shares in proportion to their tokens to this power.
SOURCE_POWER = 0.7
#: Share of all tokens that the sample is to hold.
KEEP_TOKENS = 0.8
#: The raking ends when no marginal is off its target by that share, or after ITERATIONS rounds.
TOLERANCE = 1e-12
ITERATIONS = 20
SEED = 7
#: Cells up to this number are broadcast to the documents (about 64 bytes each); more are joined by shuffle.
BROADCAST_CELLS = 100_000
#: Words of the topics "brief" (fewer) and "long" (more).
BRIEF_WORDS, LONG_WORDS = 60, 1500


def n_words(text: Column) -> Column:
    """Number of words: runs of characters other than blanks and line breaks."""
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).cast("bigint")


def topic_of(text: Column, words: Column) -> Column:
    """Topic by form: licence notices, tables, texts with contact data, and prose by its length."""
    return (
        F.when(F.contains(text, F.lit("icensed under")) | F.contains(text, F.lit("opyright")) | F.contains(text, F.lit("SPDX-")), "notice")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"), "contact")
        .when(words < BRIEF_WORDS, "brief").when(words > LONG_WORDS, "long").otherwise("article")
    )


def hash_uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on seed and id only: 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(16**13)


def _fixed(spark: SparkSession, name: str, shares: dict[str, float]) -> DataFrame:
    return spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for p in shares.items() for x in p))).alias(name, "target"))


def marginals(cells: DataFrame, weight: str, targets: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, target, share: what the weights of cells add up to, as a share of all, for each value with a target."""
    whole = cells.agg(F.sum(weight).cast("double").alias("whole"))  # one row
    found = None
    for name, target in targets.items():
        sums = target.join(cells.groupBy(name).agg(F.sum(weight).cast("double").alias("s")), name, "left")
        rows = sums.select(F.lit(name).alias("dimension"), F.col(name).alias("value"), "target", F.coalesce("s", F.lit(0.0)).alias("s"))
        found = rows if found is None else found.unionByName(rows)
    share = F.when(F.col("whole") > 0, F.col("s") / F.col("whole")).otherwise(0.0)
    return found.join(F.broadcast(whole)).select("dimension", "value", "target", share.alias("share"))


def present_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The targets (dimension, target) spread over the values that have tokens, written."""
    out = {}
    for name, target in targets.items():
        present = cells.groupBy(name).agg(F.sum("tokens").alias("n")).where("n > 0").join(target, name)
        whole = present.agg(F.sum("target")).first()[0] or 1.0
        out[name] = materialize(present.select(name, (F.col("target") / whole).alias("target")), f"target-{name}")
    return out


def _fit(sums: np.ndarray, shares: list[np.ndarray]) -> tuple[np.ndarray, float, float]:
    """Factors that bring the sums, an axis for each dimension, to the shares of one dimension after the other; what they then add up to, and how far they are off."""
    factors = np.ones_like(sums)
    others = lambda axis: tuple(i for i in range(sums.ndim) if i != axis)
    for axis, share in enumerate(shares):
        held = (sums * factors).sum(axis=others(axis), keepdims=True)
        factors *= np.divide(share.reshape(held.shape), held, out=np.zeros_like(held), where=held > 0)
    fitted = sums * factors
    whole = fitted.sum()
    if not whole > 0:
        return factors, 0.0, 1.0
    far = (np.abs(fitted.sum(axis=others(axis))[share > 0] / whole / share[share > 0] - 1).max(initial=0.0) for axis, share in enumerate(shares))
    return factors, float(whole), float(max(far, default=0.0))


def rake(cells: DataFrame, targets: dict[str, DataFrame], bounded: frozenset[str], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (one column for each dimension, tokens) with w, raked to the targets (dimension, target).

    Shares of a target are taken among the values that occur, so they need not add up to 1. A value
    without a target keeps nothing. The first dimension may have any number of values; the others are
    in `bounded`, which have a proven number of them. The cells of a value of the first dimension are one
    row; a round is one aggregate of these rows by the other dimensions, and its sums, as many as
    these have combinations, give their factors. The first dimension's factors follow from those.
    Where cells without tokens make targets impossible the rounds end with what they have reached;
    marginals() tells how far that is.
    """
    first, *rest = targets
    if not bounded.issuperset(rest):
        raise ValueError("only the first dimension may have any number of values")
    targets = present_targets(cells, targets)
    shares, place = [], F.lit(0)
    for name in rest:
        rows = targets[name].collect()  # a bounded number
        shares.append(np.array([0.0, *(r.target for r in rows)]))  # place 0: values without a target
        values = F.array(*(F.lit(r[name]) for r in rows)).cast(f"array<{cells.schema[name].dataType.simpleString()}>")
        place = place * len(shares[-1]) + F.coalesce(F.array_position(values, F.col(name)), F.lit(0))
    cell = F.struct(F.struct("*").alias("cell"), place.cast("int").alias("place"), F.col("tokens").cast("double").alias("n"))
    grouped = materialize(cells.groupBy(first).agg(F.collect_list(cell).alias("_cells")).join(targets[first], first, "left"), "raked")

    def sum_of(factors: np.ndarray) -> Column:
        return F.aggregate("_cells", F.lit(0.0), lambda s, c: s + c["n"] * F.get(F.lit(factors.ravel()), c["place"]))

    def weights(own: Column, factors: np.ndarray) -> Column:
        kept = F.when(own > 0, F.coalesce(F.col("target"), F.lit(0.0)) / own).otherwise(0.0)
        return F.transform("_cells", lambda c: F.struct(c["cell"].alias("cell"), c["place"].alias("place"), (c["n"] * kept * F.get(F.lit(factors.ravel()), c["place"])).alias("w")))

    before, now, whole, off = None, np.ones([len(s) for s in shares]), 0.0, 1.0
    for _ in range(iterations):
        far = F.lit(1.0)
        if before is not None and whole > 0:
            far = F.when(F.col("_before") > 0, F.abs(F.col("_now") / F.col("_before") / whole - 1)).otherwise(1.0)
        sums = grouped.withColumns({"_now": sum_of(now), "_before": F.lit(0.0) if before is None else sum_of(before)})
        sums = sums.select(F.when(F.col("target").isNotNull(), far).alias("far"), F.inline(weights(F.col("_now"), now)))
        found = sums.groupBy("place").agg(F.sum("w").alias("w"), F.max("far").alias("far")).collect()  # combinations of the bounded dimensions
        if before is not None and max([off, *(r.far for r in found if r.far is not None)]) <= tolerance:
            break
        dealt = np.zeros(now.size)
        for r in found:
            dealt[r.place] = r.w
        factors, whole, off = _fit(dealt.reshape(now.shape), shares)
        before, now = now, now * factors
    if before is None:
        return cells.withColumn("w", F.col("tokens").cast("double"))
    raked = grouped.withColumn("_before", sum_of(before)).select(F.inline(weights(F.col("_before"), now)))
    return raked.select("cell.*", "w")


def _cells_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """doc_id, source, lang, topic, tokens and lang_cell of each row, and the row itself as `_row`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    return docs.select(
        F.struct("*").alias("_row"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        lang.alias("lang"), F.when(lang.isin(*LANG_TARGET), lang).otherwise("other").alias("lang_cell"), text.alias("text"), n_words(text).alias("tokens"),
    ).select("_row", "doc_id", "source", "lang", "lang_cell", topic_of(F.col("text"), F.col("tokens")).alias("topic"), "tokens")


def standing_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """The targets of sources, languages and topics for these cells."""
    sources = cells.groupBy("source").agg(F.pow(F.sum("tokens").cast("double"), F.lit(SOURCE_POWER)).alias("target"))
    spark = cells.sparkSession
    return {"source": sources, "lang": _fixed(spark, "lang", LANG_TARGET | {"other": OTHER_LANG}), "topic": _fixed(spark, "topic", TOPIC_TARGET)}


def sample_marginals(mixed: DataFrame) -> DataFrame:
    """dimension, value, target, share: the shares of tokens in the sample that mix_sources() has drawn, beside the targets."""
    lang = F.when(F.col("lang").isin(*LANG_TARGET), F.col("lang")).otherwise("other")
    cells = mixed.groupBy("source", lang.alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    cells = materialize(cells, "drawn-cells")
    return marginals(cells, "drawn", present_targets(cells, standing_targets(cells)))


def _with_rates(rows: DataFrame, drawn: DataFrame, keep_tokens: float, iterations: int, seed: int) -> DataFrame:
    """drawn with `probability`, `copies` and `kept`, from the cells of rows."""
    cells = materialize(rows.groupBy("source", F.col("lang_cell").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens")), "mix-cells")
    targets = standing_targets(cells)
    raked = rake(cells, targets, frozenset({"lang", "topic"}), iterations)
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    rate = F.when(F.col("tokens") > 0, F.col("w") * F.lit(total) * keep_tokens / F.col("tokens")).otherwise(1.0)
    rates = materialize(raked.select("source", F.col("lang").alias("lang_cell"), "topic", rate.alias("rate")), "mix-rates")
    small = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    joined = drawn.join(F.broadcast(rates) if small else rates, ["source", "lang_cell", "topic"])
    whole = F.floor("rate")
    copies = whole + (hash_uniform(F.col("doc_id"), seed) < F.col("rate") - whole).cast("bigint")
    return joined.withColumns({"probability": F.least(F.lit(1.0), F.col("rate")), "copies": copies}).withColumn("kept", F.col("copies") > 0)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    keep_tokens: float = KEEP_TOKENS, iterations: int = ITERATIONS, seed: int = SEED,
) -> DataFrame:
    """Returns a row for each row of docs: doc_id, source, lang, topic, tokens, probability, kept, copies.

    * Tokens are words. Targets: sources by SOURCE_POWER, languages by LANG_TARGET (others together
      OTHER_LANG), topics by TOPIC_TARGET, each taken among the values that occur.
    * The rate of a cell is its raked weight over its share of tokens, times keep_tokens. copies is
      the whole part of the rate and one more with the chance of the rest, so that cells with too
      few tokens for their weight are repeated and the sample has the target weights in expectation.
      probability is the chance of one copy at least, kept whether there is one.
    * The lot is a hash of the id, so it does not depend on other documents or on partitions; rows
      that repeat an id share their lot as far as their cells are equal.
    * The targets are met in expectation as far as cells with tokens allow; sample_marginals() gives
      the shares that a draw has reached.
    * Whole texts are read, of any length; they don't leave their tasks. Null sources and languages are values of their own (""); a null text is empty. Texts without
      words weigh nothing in the raking and have the probability of their cell, 1 if that has no tokens.
    * An empty table gives an empty result.
    """
    rows = materialize(_cells_of(docs, id_col, text_col, source_col, lang_col).drop("_row"), "mix-rows")
    mixed = _with_rates(rows, rows, keep_tokens, iterations, seed)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept", "copies")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    keep_tokens: float = KEEP_TOKENS, iterations: int = ITERATIONS, seed: int = SEED,
) -> DataFrame:
    """The rows of docs that mix_sources() keeps, each as often as it has copies, with all their columns; texts are not shuffled while the cells fit a broadcast."""
    rows = _cells_of(docs, id_col, text_col, source_col, lang_col)
    drawn = _with_rates(rows.drop("_row"), rows, keep_tokens, iterations, seed).where("kept")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to the standing targets."""
    return mix_sources(table(spark, sf_dir, "documents"))


def _sql(relation: str = "documents", keep_tokens: float = KEEP_TOKENS, iterations: int = ITERATIONS, seed: int = SEED) -> str:
    """The same rows in DuckDB: the raking is unrolled, a step of a dimension for each named query."""
    langs = ", ".join(f"'{x}'" for x in LANG_TARGET)
    fixed = lambda shares: ", ".join(f"('{k}', {v})" for k, v in shares.items())
    steps, last = [], "w0"
    for i in range(iterations):
        for name in DIMENSIONS:
            step = f"w{i}_{name}"
            steps.append(
                f"{step} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, coalesce(c.w * t.target / f.s, 0) AS w FROM {last} c "
                f"LEFT JOIN (SELECT {name}, sum(w) AS s FROM {last} GROUP BY 1 HAVING sum(w) > 0) f USING ({name}) LEFT JOIN t_{name} t USING ({name}))"
            )
            last = step
    targets = [
        f"t_{name} AS MATERIALIZED (SELECT {name}, target / sum(target) OVER () AS target FROM {given} g "
        f"SEMI JOIN (SELECT {name} FROM cells GROUP BY 1 HAVING sum(tokens) > 0) USING ({name}))"
        for name, given in (
            ("source", f"(SELECT source, pow(CAST(sum(tokens) AS DOUBLE), {SOURCE_POWER}) AS target FROM cells GROUP BY 1)"),
            ("lang", f"(SELECT * FROM (VALUES {fixed(LANG_TARGET | {'other': OTHER_LANG})}) v(lang, target))"),
            ("topic", f"(SELECT * FROM (VALUES {fixed(TOPIC_TARGET)}) v(topic, target))"),
        )
    ]
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS BIGINT) AS tokens
  FROM {relation}
), r AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END AS lang_cell, tokens,
         CASE WHEN contains(text, 'icensed under') OR contains(text, 'opyright') OR contains(text, 'SPDX-') THEN 'notice'
              WHEN contains(text, ' | ') THEN 'table'
              WHEN regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]') THEN 'contact'
              WHEN tokens < {BRIEF_WORDS} THEN 'brief' WHEN tokens > {LONG_WORDS} THEN 'long' ELSE 'article' END AS topic
  FROM d
), cells AS MATERIALIZED (
  SELECT source, lang_cell AS lang, topic, sum(tokens) AS tokens FROM r GROUP BY 1, 2, 3
), {", ".join(targets)}, w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells), {", ".join(steps)}, rates AS (
  SELECT source, lang AS lang_cell, topic,
         CASE WHEN tokens > 0 THEN w * CAST(sum(tokens) OVER () AS DOUBLE) * {keep_tokens} / tokens ELSE 1.0 END AS rate
  FROM {last}
), drawn AS (
  SELECT doc_id, source, lang, topic, r.tokens, rate,
         CAST(floor(rate) AS BIGINT) + CAST(CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / {float(16**13)!r} < rate - floor(rate) AS BIGINT) AS copies
  FROM r JOIN rates USING (source, lang_cell, topic)
)
SELECT doc_id, source, lang, topic, tokens, round(least(1.0, rate), 6) AS probability, copies > 0 AS kept, copies FROM drawn
"""


OP6_SQL = _sql()
