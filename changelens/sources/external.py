"""Steps that call something outside Spark: the caller injects the function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import _c, clean_python, unify_newlines

# Fixed patterns and limits.
COMMIT_URL = r"^https?://github\.com/([^/]+)/([^/]+)/commit/([0-9a-fA-F]+)"
MAX_FILES, MAX_CHARS = 10, 5000
DUMP_LINE = r"^( *)([a-zA-Z_][\w-]*)(?:: (.+?))? \[(\d+),(\d+)\]$"


def commit_parts(url) -> Column:
    """Owner, repository and revision of a commit url; null if it is not one."""
    g = lambda i: F.regexp_extract(_c(url), COMMIT_URL, i)
    return F.when(_c(url).rlike(COMMIT_URL), F.struct(g(1).alias("owner"), g(2).alias("repo"), g(3).alias("sha")))


def fetch_files(requests: DataFrame, fetcher: Callable[[str, str, str, str], str]) -> DataFrame:
    """Fetch ``(url, file_path, version)`` rows with the injected function.

    Duplicate requests are fetched once. A failure becomes an error text and never
    stops the job. Python files are cleaned of comments.
    """
    parts = requests.select("url", "file_path", "version").distinct().withColumn("p", commit_parts("url"))
    ref = F.when(F.col("version") == "before", F.concat("p.sha", F.lit("~1"))).otherwise(F.col("p.sha"))
    todo = parts.select("url", "file_path", "version", F.col("p.owner").alias("owner"), F.col("p.repo").alias("repo"), ref.alias("ref"))

    def run(batches):
        for pdf in batches:
            code, error = [], []
            for r in pdf.itertuples(index=False):
                try:
                    if not r.owner:
                        raise ValueError(f"could not parse commit URL: {r.url}")
                    code.append(fetcher(r.owner, r.repo, r.ref, r.file_path))
                    error.append(None)
                except Exception as exc:  # the injected function may raise anything
                    code.append(None)
                    error.append(str(exc)[:500])
            yield pdf[["url", "file_path", "version"]].assign(code=code, error=error)

    got = todo.mapInPandas(run, "url string, file_path string, version string, code string, error string")
    return got.withColumn("code", clean_python("code"))


def commit_text(fetched: DataFrame) -> DataFrame:
    """Python files of a commit as one text: the first files by name, each cut to a fixed length."""
    py = fetched.where(F.col("file_path").endswith(".py"))
    part = F.concat(F.lit("# "), "file_path", F.lit("\n"), F.coalesce(F.left("code", F.lit(MAX_CHARS)), F.concat(F.lit("Error: "), "error")))
    return py.groupBy("url").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(
        F.struct("file_path", part.alias("t")))), 1, MAX_FILES), lambda x: x["t"]), "\n\n").alias("full_commit"))


# Indented tree dumps of an external parser

def dump_rows(dump) -> Column:
    """``array<struct<pos,depth,type,value,start,end>>`` of a dump, lines that do not fit left out."""
    rows = F.filter(F.split(unify_newlines(dump), "\n"), lambda ln: ln.rlike(DUMP_LINE))
    g = lambda ln, i: F.regexp_extract(ln, DUMP_LINE, i)
    return F.transform(rows, lambda ln, i: F.struct(
        i.alias("pos"), F.floor(F.length(g(ln, 1)) / 4).cast("int").alias("depth"), g(ln, 2).alias("type"),
        F.rtrim(g(ln, 3)).alias("value"), g(ln, 4).cast("int").alias("start"), g(ln, 5).cast("int").alias("end")))


def subtrees(dump, node: str) -> Column:
    """Dump text of every subtree whose root is ``node``: the root line and all deeper lines after it."""
    pattern = rf"(?md)^(?=(( *+){node}(?:: [^\n]*)? \[\d+,\d+\](?:\n\2 [^\n]*+)*+))"
    return F.regexp_extract_all(unify_newlines(dump), F.lit(pattern), F.lit(1))


def children(subtree, node: str | None = None) -> Column:
    """Rows one level below the root of a subtree, optionally of one type."""
    rows = dump_rows(subtree)
    root = F.get(rows, F.lit(0))["depth"]
    return F.filter(rows, lambda r: (r["depth"] == root + 1) & (F.lit(True) if node is None else r["type"] == node))


def parse_with(files: DataFrame, parser: Callable[[str], str]) -> DataFrame:
    """Run an injected parser over ``(case_id, side, file, code)``; failures go to ``error``."""
    def run(batches):
        for pdf in batches:
            dump, error = [], []
            for code in pdf["code"]:
                try:
                    dump.append(parser(code))
                    error.append(None)
                except Exception as exc:  # the injected function may raise anything
                    dump.append(None)
                    error.append(f"{type(exc).__name__}: {str(exc)[:500]}")
            yield pd.DataFrame({**{c: pdf[c] for c in ("case_id", "side", "file")}, "dump": dump, "error": error})

    return files.mapInPandas(run, "case_id string, side string, file string, dump string, error string")
