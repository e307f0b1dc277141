"""Source trees as tables: local files, and the state of the git working trees they lie in."""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.hashing import git_blob

MOST_BYTES = 1 << 20
UNIT, RECORD = "\x1f", "\x1e"


def scan_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, repo_id: str = "", worktree_id: str = "") -> DataFrame:
    """files(root, repo_id, worktree_id, path, content_hash, size, modified, language, content) below a folder.

    Left out: ignored and secret names, files over 1 MiB, and those that hold a NUL. Executors read the files, so the root
    may be any folder that Spark reads; tests are made on paths relative to it. Bytes that aren't UTF-8 are replaced.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].rstrip("/") if "://" not in root else root.rstrip("/")
    full = F.regexp_replace("path", "^[a-z]+:/+", "/") if "://" not in root else F.col("path")
    path = F.substring(full, len(os.path.abspath(base) if "://" not in root else base) + 2, 1 << 20)
    rows = rows.where(F.col("length") <= MOST_BYTES).withColumn("path", path).where(~P.is_ignored(F.col("path"), tuple(exclude or ())) & ~P.is_secret(F.col("path")))
    for patterns, wanted in ((include, True), (exclude, False)):
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | P.matches(F.col("path"), p)
            rows = rows.where(hit if wanted else ~hit)
    rows = rows.where(~F.contains("content", F.lit(b"\x00")))
    return rows.select(
        F.lit(root).alias("root"), F.lit(repo_id).alias("repo_id"), F.lit(worktree_id).alias("worktree_id"), "path", git_blob(F.col("content")).alias("content_hash"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), P.language(F.col("path")).alias("language"), F.decode(F.col("content"), "UTF-8").alias("content"),
    )


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else None


def worktree_info(root: str) -> dict | None:
    """repo_id and worktree_id from the hashes of the common folder and the top, branch, top, and whether it is the main tree; None outside git."""
    top = _git(root, "rev-parse", "--show-toplevel")
    if top is None:
        return None
    top = top.strip()
    common, own = (os.path.realpath(os.path.join(root, (_git(root, "rev-parse", x) or "").strip())) for x in ("--git-common-dir", "--git-dir"))
    short = lambda s: hashlib.sha1(s.encode()).hexdigest()[:16]
    branch = (_git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip()
    return {"repo_id": short(common), "worktree_id": f"wt-{short(os.path.realpath(top))}", "branch": branch, "top": top, "is_main": common == own}


def worktrees(root: str) -> list[dict]:
    """The linked working trees of a repository, as git lists them."""
    out = []
    for block in (_git(root, "worktree", "list", "--porcelain") or "").strip().split("\n\n"):
        facts = dict(x.partition(" ")[::2] for x in block.splitlines() if x)
        if "worktree" in facts:
            out.append({"path": facts["worktree"], "head": facts.get("HEAD", ""), "branch": facts.get("branch", "").removeprefix("refs/heads/")})
    return out


def _below(root: str, path: str) -> str | None:
    """A repository path relative to a root that may lie below the repository's top; None outside it."""
    prefix = (_git(root, "rev-parse", "--show-prefix") or "").strip()
    return path[len(prefix) :] if path.startswith(prefix) else None


def head_tree(spark: SparkSession, root: str, worktree_id: str) -> DataFrame:
    """tree_entries(worktree_id, path, blob_hash) of HEAD; paths are relative to the root."""
    rows = []
    for entry in (_git(root, "ls-tree", "-r", "-z", "--full-tree", "HEAD") or "").split("\0"):
        meta, _, path = entry.partition("\t")
        if meta.split()[1:2] == ["blob"] and (own := _below(root, path)) is not None:
            rows.append((worktree_id, own, meta.split()[2]))
    return spark.createDataFrame(rows, "worktree_id string, path string, blob_hash string")


def dirty_paths(root: str) -> list[str]:
    """Paths relative to the root that differ from HEAD or aren't tracked; a rename has both of its names."""
    out, entries = [], iter((_git(root, "status", "--porcelain", "-z", "--untracked-files=all") or "").split("\0"))
    for e in entries:
        if len(e) > 3:
            out.append(e[3:])
            if "R" in e[:2] or "C" in e[:2]:
                out.append(next(entries, ""))
    return sorted({p for x in out if x and (p := _below(root, x)) is not None})


COMMITS = "commit string, short_commit string, author string, date_raw string, message string, files array<string>, repo_path string, repo_id string, branch string"


def git_history(spark: SparkSession, root: str, most: int = 1000, since: str | None = None) -> DataFrame:
    """commits(commit, short_commit, author, date_raw, ts, message, files, repo_path, repo_id, branch), newest first in git's order."""
    info = worktree_info(root) or {"repo_id": "", "branch": ""}
    form = RECORD + UNIT.join(("%H", "%h", "%an", "%ad", "%s")) + UNIT
    args = ["log", f"--max-count={most}", "--date=iso-strict", "--name-only", f"--format={form}"] + ([f"--since={since}"] if since else [])
    rows = []
    for record in (_git(root, *args) or "").split(RECORD)[1:]:
        *facts, names = record.split(UNIT)
        rows.append((*facts, [x for x in names.split("\n") if x], root, info["repo_id"], info["branch"]))
    return spark.createDataFrame(rows, COMMITS).withColumn("ts", F.try_to_timestamp("date_raw"))
