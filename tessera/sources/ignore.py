"""Rules of ignore files (.gitignore), as tables: rules per directory, paths with their ancestors, the last match wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which they are sent to all tasks; more meet the paths by directory and part.
FEW_RULES, PARTS = 10_000, 32
RULE_FILE, EXCLUDE_FILE = ".gitignore", ".git/info/exclude"


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a rule without its marks: `*` and `?` stay within a name, `**` goes through directories."""
    classes = glob.rlike(r"^[^\[\]]*(\[[^\[\]]+\][^\[\]]*)*$")
    out = F.when(classes, glob).otherwise(F.regexp_replace(glob, r"[\[\]]", r"\\$0"))
    out = F.regexp_replace(out, r"[.+^$(){}|]", r"\\$0")
    for part, mark in ((r"(^|/)\*\*/", "$1\x01"), (r"/\*\*$", "/\x02"), (r"\*+", "\x03"), (r"\?", "\x04"), (r"\[!", "[^")):
        out = F.regexp_replace(out, part, mark)
    for mark, part in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", "[^/]")):
        out = F.replace(out, F.lit(mark), F.lit(part))
    return out


def ignore_rules(files: DataFrame) -> DataFrame:
    """base, line, negated, dir_only, pattern: the rules of ignore files (file_path, content), `base` the directory of the file ('' at the root).

    Blank lines and comments are left out, also spaces at the end; a rule with a slash before its end is held against the path below `base`,
    others against any name there. The exclude file of the version control counts for the root, before all others. An escape
    stands only for a first `#` or `!`.
    """
    excludes = F.col("file_path") == EXCLUDE_FILE
    base = F.when(excludes, F.lit("")).otherwise(F.regexp_replace("file_path", r"/?[^/]*$", ""))
    lines = files.select(base.alias("base"), F.when(excludes, -1_000_000).otherwise(0).alias("first"), F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("line", "text"))
    text = F.regexp_replace("text", r"[ \t]+$", "")
    rule = lines.withColumn("text", text).where((F.col("text") != "") & ~F.startswith("text", F.lit("#")))
    bare = F.regexp_replace(F.regexp_replace("text", r"^!", ""), r"^\\([#!])", "$1")
    glob = F.regexp_replace(bare, r"^/|/$", "")
    anchored = F.contains(F.regexp_replace(bare, "/$", ""), F.lit("/"))
    pattern = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), glob_pattern(glob), F.lit("$"))
    return rule.where(glob != "").select("base", (F.col("first") + F.col("line")).alias("line"), F.startswith("text", F.lit("!")).alias("negated"), F.endswith(bare, F.lit("/")).alias("dir_only"), pattern.alias("pattern"))


def _ancestors(path: Column) -> Column:
    """Directories above a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ignored_entries(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """entry: the files and directories above them (of `file_path`) that the rules ignore by themselves.

    Rules of all directories above an entry are tried; of those that match, one of the deepest directory counts, there the last.
    """
    above = F.filter(_ancestors(F.col("file_path")), lambda d: d != "")
    entries = paths.select("file_path", above.alias("dirs")).select(F.explode(F.concat(F.transform("dirs", lambda d: F.struct(d.alias("entry"), F.lit(True).alias("is_dir"))), F.array(F.struct(F.col("file_path").alias("entry"), F.lit(False).alias("is_dir"))))).alias("e")).select("e.*").distinct()
    at = entries.select("entry", "is_dir", F.explode(_ancestors(F.col("entry"))).alias("base"))
    if rules.limit(FEW_RULES + 1).count() <= FEW_RULES:
        met = at.join(F.broadcast(rules), "base")
    else:  # all paths are below the root, so its rules are dealt out
        dealt = rules.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = at.withColumn("_part", F.pmod(F.hash("entry"), F.lit(PARTS))).join(dealt, ["base", "_part"])
    below = F.when(F.col("base") == "", F.col("entry")).otherwise(F.substring(F.col("entry"), F.length("base") + 2, F.length("entry")))
    hit = met.where((F.col("is_dir") | ~F.col("dir_only")) & F.regexp(below, F.col("pattern")))
    deepest = F.struct(F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", "/"))), F.col("line"))
    return hit.groupBy("entry").agg(F.max_by("negated", deepest).alias("negated")).where("NOT negated").select("entry")


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (file_path, ...) without those that are ignored or lie below an ignored directory, out of which no rule brings a file back."""
    whole = F.concat(_ancestors(F.col("file_path")), F.array("file_path"))
    gone = files.select("file_path", F.explode(whole).alias("entry")).join(ignored_entries(files.select("file_path"), rules), "entry", "left_semi").select("file_path").distinct()
    return files.join(gone, "file_path", "left_anti")


def read_rule_files(paths: DataFrame, root: str) -> DataFrame:
    """file_path, content of the ignore files in the directories of `file_path` below root.

    Spark's file sources leave out hidden files, so the tasks look into each directory themselves; root is a local
    folder of all machines or one that pyarrow's file systems reach.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        for part in parts:
            rows = []
            for name in part["name"]:
                full = f"{base}/{name}"
                if where.get_file_info(full).type == fs.FileType.File:
                    with where.open_input_stream(full) as stream:
                        rows.append((name, stream.read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["file_path", "content"])

    directory = F.explode(_ancestors(F.col("file_path")))
    names = paths.select(directory.alias("d")).distinct().select(F.concat(F.when(F.col("d") == "", "").otherwise(F.concat("d", F.lit("/"))), F.lit(RULE_FILE)).alias("name"))
    exclude = paths.sparkSession.createDataFrame([(EXCLUDE_FILE,)], "name string")
    return names.unionByName(exclude).mapInPandas(run, "file_path string, content string")
