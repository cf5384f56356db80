"""Where files and commits come from: git and the file system.

Only listings pass through the driver; contents are read by Spark.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.extract import EXTENSIONS


def git(root: str, *args: str, text: bool = True):
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "surrogateescape") if text else done.stdout


def assert_work_tree(root: str) -> None:
    try:
        inside = git(root, "rev-parse", "--is-inside-work-tree").strip()
    except (RuntimeError, OSError):
        inside = ""
    if inside != "true":
        raise ValueError(f"{root} is not inside a git work tree")


def tracked_paths(root: str) -> list[str]:
    """Tracked files and untracked ones that are not ignored."""
    return [p for p in git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0") if p.strip()]


def staged_paths(root: str) -> list[str]:
    return [p for p in git(root, "diff", "--cached", "--name-only", "--diff-filter=ACM", "-z").split("\0") if p]


def staged_blob(root: str, path: str) -> bytes | None:
    try:
        return git(root, "show", f":0:{path}", text=False)
    except RuntimeError:
        return None


def commit_metadata(root: str, commit: str) -> tuple[str, list[str]]:
    """The subject and the files of a commit."""
    subject = git(root, "log", "--format=%s", "-1", commit).strip()
    files = [p for p in git(root, "diff-tree", "--root", "--no-commit-id", "-r", "--name-only", "-z", commit).split("\0") if p]
    if not subject or not files:
        raise ValueError(f"commit {commit} has no subject or no files")
    return subject, files


def go_module(root: str) -> str | None:
    """The module name in go.mod."""
    try:
        with open(os.path.join(root, "go.mod"), encoding="utf-8") as f:
            return next((line.split(None, 1)[1].strip() for line in f if line.startswith("module ")), None)
    except OSError:
        return None


def path_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def scan(spark: SparkSession, root: str, paths: DataFrame, content: bool = True) -> DataFrame:
    """path, mtime, file_size and content of the listed files under root.

    The binary source lists the tree in parallel; without ``content`` no file is
    opened. The path filter comes before any content is used.
    """
    base = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.expr(f"substring(try_url_decode(regexp_replace(path, '[+]', '%2B')), {len('file:') + len(base) + 2})")
    columns = [rel.alias("path"), F.unix_micros(F.col("modificationTime")).cast("double").alias("us"), F.col("length").alias("file_size"), *([F.col("content")] if content else [])]
    rows = files.select(*columns).withColumn("mtime", F.col("us") / 1e6).drop("us")
    return rows.join(paths.select("path").distinct(), "path", "left_semi")


def parseable(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, language of files with a known extension."""
    ext = F.regexp_extract(path, r"[^/]+?(\.[^./]+)$", 1)
    language = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)
    return paths.filter(ext.isin(list(EXTENSIONS))).select(path, language.alias("language"))


def language_counts(paths: DataFrame) -> DataFrame:
    return parseable(paths).groupBy("language").agg(F.count("*").alias("n"))
