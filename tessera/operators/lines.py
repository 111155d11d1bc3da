"""Line-level operators: windows, search, hunks, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import lines_of, word_jaccard

WINDOW = 20


def explode_lines(files: DataFrame) -> DataFrame:
    """The columns of files but content, with n (from 1) and line."""
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(lines_of(F.col("content"))).alias("n", "line")).withColumn("n", F.col("n") + 1)


def line_window(files: DataFrame, start: int, max_lines: int, max_chars: int) -> DataFrame:
    """file_path, first, last, content, truncated, sha256: lines from `start`, whole ones as far as the budget of characters goes."""
    kept = F.slice(lines_of(F.col("content")), start, max_lines)
    # cost of a line: its characters and a line feed
    fitted = F.aggregate(
        kept, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda a, line: F.struct(
            F.when(a["full"] | (a["used"] + F.length(line) + 1 > max_chars), a["used"]).otherwise(a["used"] + F.length(line) + 1).alias("used"),
            F.when(a["full"] | (a["used"] + F.length(line) + 1 > max_chars), a["n"]).otherwise(a["n"] + 1).alias("n"),
            (a["full"] | (a["used"] + F.length(line) + 1 > max_chars)).alias("full"),
        ),
    )
    out = files.select("file_path", F.sha2("content", 256).alias("sha256"), kept.alias("_kept"), fitted.alias("_fit"), F.size(lines_of(F.col("content"))).alias("_all"))
    n = F.col("_fit.n")
    return out.where(n > 0).select("file_path", F.lit(start).cast("bigint").alias("first"), (n + start - 1).cast("bigint").alias("last"), F.array_join(F.slice("_kept", 1, n), "\n").alias("content"), (n + start - 1 < F.col("_all")).alias("truncated"), "sha256")


def enclosing_chunks(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each point (file_path, line) with the first chunk of its file that holds the line; points without one keep nulls.

    Points and chunks of a file meet by the file and by blocks of lines, so that a long file does not
    multiply: a chunk is in as many blocks as it spans.
    """
    size = 64
    spread = chunks.select(F.col("file_path"), F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))).alias("_block"), F.col("start_line"), F.col("end_line"))
    at = points.withColumn("_block", F.floor(F.col("line") / size))
    met = at.join(spread, ["file_path", "_block"], "left").where(F.col("start_line").isNull() | F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = met.groupBy("file_path", "line").agg(F.min(F.struct("start_line", "end_line")).alias("c")).select("file_path", "line", "c.start_line", "c.end_line")
    return points.select("file_path", "line").distinct().join(best, ["file_path", "line"], "left")


def literal_search(files: DataFrame, pattern: str, max_results: int = 50) -> DataFrame:
    """file_path, n, column (1-based characters), line: the first match of each line, in path order, max_results at most."""
    found = explode_lines(files).withColumn("column", F.instr("line", pattern)).where("column > 0")
    return found.select("file_path", "n", "column", "line").orderBy("file_path", "n").limit(max(1, min(max_results, 1000)))


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key, intervals that overlap or touch become one: keys, start, end, n (how many there were)."""
    order = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def _matches(line: Column, pattern: str) -> Column:
    """Whether a line holds the pattern. Lines end at line feeds only, so that a dot matches any other character and a dollar only the end."""
    return line.rlike(f"(?d){pattern}")


def grep_hunks(files: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """file_path, first, last, n_matches: matching lines with their context, merged into hunks."""
    lines = files.withColumn("_total", F.size(lines_of(F.col("content"))))
    hits = explode_lines(lines).where(_matches(F.col("line"), pattern))
    ranges = hits.select("file_path", F.greatest(F.col("n") - before, F.lit(1)).alias("first"), F.least(F.col("n") + after, F.col("_total")).alias("last"))
    return merge_intervals(ranges, ["file_path"], "first", "last").withColumnRenamed("n", "n_matches")


def grep_page(files: DataFrame, pattern: str, before: int, after: int, max_matches: int = 200, max_hunks: int = 8, max_chars: int = 2000, start: tuple[str, int] | None = None) -> DataFrame:
    """file_path, first, last, n_matches, content, complete: a page of hunks in the order of files (distinct) and lines, as numbered lines.

    The first max_matches matching lines make hunks, of which max_hunks come, and of these the lines that max_chars characters with their line
    feeds hold; a matching line at the end of the budget is cut, and its hunk not complete. A hunk that is left without a matching line is dropped. `start` is the file and line
    from which on to read, thus the line after `last` of a page's last row, in its file.
    """
    read = files.select("file_path", "content")
    from_line = F.lit(1)
    if start is not None:
        read = read.where(F.col("file_path") >= start[0])
        from_line = F.when(F.col("file_path") == start[0], start[1]).otherwise(1)
    lines = explode_lines(read.withColumn("_total", F.size(lines_of(F.col("content")))))
    hits = lines.where(_matches(F.col("line"), pattern) & (F.col("n") >= from_line)).select("file_path", "n", "_total").orderBy("file_path", "n").limit(max_matches)
    ranges = hits.select("file_path", F.greatest(F.col("n") - before, from_line).alias("first"), F.least(F.col("n") + after, F.col("_total")).alias("last"))
    hunks = merge_intervals(ranges, ["file_path"], "first", "last").drop("n").orderBy("file_path", "first").limit(max_hunks)
    # max_hunks rows of at most max_matches * (before + after + 1) lines
    text = read.join(F.broadcast(hunks), "file_path")
    shown = text.select("file_path", "first", F.col("last").alias("_end"), F.posexplode(F.slice(lines_of(F.col("content")), F.col("first"), F.col("last") - F.col("first") + 1)).alias("_i", "line"))
    hit = _matches(F.col("line"), pattern)
    numbered = shown.select("file_path", "first", "_end", (F.col("first") + F.col("_i")).alias("n"), hit.alias("hit"), F.concat((F.col("first") + F.col("_i")).cast("string"), F.when(hit, ":* ").otherwise(":  "), "line").alias("text"))
    used = F.sum(F.length("text") + 1).over(W.orderBy("file_path", "n")) - F.length("text") - 1
    left = F.lit(max_chars) - F.col("_used") - 1
    fits = F.length("text") <= left
    kept = numbered.withColumn("_used", used).where(fits | (F.col("hit") & (left > 0))).withColumn("_cut", ~fits)
    kept = kept.withColumn("text", F.when(fits, F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), left.cast("int"))))
    by = kept.groupBy("file_path", "first", "_end").agg(F.max("n").alias("last"), F.count_if("hit").alias("n_matches"), F.bool_or("_cut").alias("_cut"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return by.where("n_matches > 0").select("file_path", "first", "last", "n_matches", "content", ((F.col("last") == F.col("_end")) & ~F.col("_cut")).alias("complete"))


def similar_neighbours(chunks: DataFrame, gap: int = 10, least: float = 0.8) -> DataFrame:
    """Neighbouring chunks of a file at most `gap` lines apart, with the similarity of their word sets and whether it is enough to join them."""
    order = W.partitionBy("file_path").orderBy("start_line", "end_line")
    paired = chunks.select("file_path", "start_line", "end_line", "content", F.lead("start_line").over(order).alias("next_start"), F.lead("content").over(order).alias("_next"))
    near = paired.where(F.col("next_start") <= F.col("end_line") + gap)
    similarity = F.round(word_jaccard(F.col("content"), F.col("_next")), 6)
    return near.select("file_path", "start_line", "next_start", similarity.alias("similarity")).withColumn("similar", F.col("similarity") >= least)


def overlap_dedupe(sections: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Of sections (key, file_path, start_line, end_line, tier) of a file that overlap in `share` of the smaller, the one of lower tier goes."""
    other = sections.select(*(F.col(c).alias(f"_{c}") for c in ("file_path", "start_line", "end_line", "tier", key)))
    overlap = F.least("end_line", "_end_line") - F.greatest("start_line", "_start_line") + 1
    smaller = F.least(F.col("end_line") - F.col("start_line"), F.col("_end_line") - F.col("_start_line")) + 1
    better = (F.col("_tier") > F.col("tier")) | ((F.col("_tier") == F.col("tier")) & (F.col(f"_{key}") < F.col(key)))
    return sections.join(other, (F.col("file_path") == F.col("_file_path")) & (overlap >= smaller * share) & better, "left_anti")


def evidence(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """Verbatim lines of pointers (file_path, start_line, end_line, sha256) and whether they are stale; one without a hash never is."""
    text = files.select("file_path", F.col("content").alias("_c"), F.sha2("content", 256).alias("_now"))
    found = pointers.join(text, "file_path", "left")
    cut = F.array_join(F.slice(lines_of(F.col("_c")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    stale: Column = F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("_now"))
    return found.select(*pointers.columns, cut.alias("content"), F.col("_now").isNull().alias("missing"), stale.alias("stale"))
