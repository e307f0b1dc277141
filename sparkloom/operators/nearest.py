"""The project that a file belongs to: configuration files of a tree as tables, the nearest one by folder, and path patterns by how specific they are."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.projects import read_jsonc
from .rounds import settle

TREE = "worktree_id"
MOST_EXTENDS = 16


def scoped(files: DataFrame) -> DataFrame:
    """files with the working tree that they lie in; one without a name where they have none."""
    return files if TREE in files.columns else files.withColumn(TREE, F.lit(""))


def normal_path(path: Column) -> Column:
    """The path without empty and ``.`` parts; ``..`` takes the part before it, and stays where there is none."""
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folders_above(path: Column) -> Column:
    """All folders above a path, the top ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def nearest(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files(worktree_id, path, ...) with the columns of the deepest of folders(worktree_id, folder, ...) that each lies below; nulls where there is none.

    Each file meets the folders above it, as many as its path has parts, and the longest wins.
    """
    facts = [c for c in folders.columns if c not in (TREE, "folder")]
    place = files.select(TREE, "path").distinct()
    above = place.select(TREE, "path", F.explode(folders_above(F.col("path"))).alias("folder"))
    best = above.join(folders, [TREE, "folder"]).groupBy(TREE, "path").agg(F.max_by(F.struct("folder", *facts), F.length("folder")).alias("_p"))
    return files.join(best, [TREE, "path"], "left").select(*files.columns, F.col("_p.folder").alias("folder"), *[F.col(f"_p.{c}").alias(c) for c in facts])


CONFIG = "extends string, base string, paths array<struct<pattern string, target string>>"


def ts_configs(files: DataFrame) -> DataFrame:
    """(worktree_id, folder, base, from_folder, paths) of each tsconfig or jsconfig of files(path, content): base folder and path patterns, ``extends`` followed.

    A file that can't be read has no settings. A chain that returns to itself ends. A folder with both has its tsconfig.
    """

    @F.pandas_udf(CONFIG)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                data = read_jsonc(t or "")
                own = data.get("compilerOptions") or {}
                up, base, paths = data.get("extends"), own.get("baseUrl"), own.get("paths")
                pairs = None if paths is None else [{"pattern": k, "target": x} for k, v in paths.items() for x in v if isinstance(x, str)]
                rows.append((up if isinstance(up, str) else None, base if isinstance(base, str) else None, pairs))
            except (ValueError, AttributeError, TypeError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["extends", "base", "paths"])

    named = scoped(files).where(P.extension(F.col("path")) == "json")
    rows = named.select(TREE, "path", P.dirname(F.col("path")).alias("folder"), parsed("content").alias("c")).select(TREE, "path", "folder", "c.*")
    inside = lambda folder, x: normal_path(F.concat_ws("/", folder, x))
    rows = rows.withColumn("base", F.when(F.col("base").isNotNull(), inside(F.col("folder"), F.col("base"))))
    rows = rows.withColumn("from_folder", F.when(F.col("paths").isNotNull(), F.col("folder")))
    parent = F.when(F.col("extends").startswith("."), inside(F.col("folder"), F.col("extends")))
    rows = settle(rows.withColumn("parent", F.when(parent.endswith(".json"), parent).otherwise(F.concat(parent, F.lit(".json")))).drop("extends"))
    own = rows.where(P.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json"))
    ups = rows.select(*[F.col(c).alias(f"_{c}") for c in (TREE, "path", "base", "from_folder", "paths", "parent")])
    for _ in range(MOST_EXTENDS):  # a round for each step of the longest chain; configurations are few
        if own.where("parent is not null").isEmpty():
            break
        met = own.join(ups, (F.col(TREE) == F.col(f"_{TREE}")) & (F.col("parent") == F.col("_path")), "left")
        own = settle(met.select(TREE, "path", "folder", F.coalesce("base", "_base").alias("base"), F.coalesce("paths", "_paths").alias("paths"), F.coalesce("from_folder", "_from_folder").alias("from_folder"), F.col("_parent").alias("parent")))
    best = own.groupBy(TREE, "folder").agg(F.max_by(F.struct("base", "from_folder", "paths"), F.col("path")).alias("s"))
    return best.select(TREE, "folder", "s.base", F.coalesce("s.base", "s.from_folder").alias("from_folder"), "s.paths")


def given_configs(trees: DataFrame, projects: list[dict]) -> DataFrame:
    """The same table for trees(worktree_id) from projects that are given: folder, base, paths (pattern to targets) and paths_from."""
    rows = [{"folder": p["folder"], "base": p["base"], "from_folder": p["paths_from"], "paths": [{"pattern": k, "target": x} for k, v in p["paths"].items() for x in v]} for p in projects]
    kind = "array<struct<folder: string, base: string, from_folder: string, paths: array<struct<pattern: string, target: string>>>>"
    return trees.select(TREE).distinct().select(TREE, F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def candidates(specs: DataFrame, configs: DataFrame) -> DataFrame:
    """(..., rank, candidate): the paths without variants that specs(worktree_id, path, spec, ...) may stand for, least rank first.

    A relative one stands for its place alone. Others take the patterns of the file's nearest project, those with the longest
    text before the star first (an exact one counts whole), and then its base folder.
    """
    relative = F.col("spec").startswith(".")
    here = F.array(F.struct(F.lit(0).alias("rank"), normal_path(F.concat_ws("/", P.dirname(F.col("path")), F.col("spec"))).alias("candidate")))
    rows = nearest(specs, configs)
    head = lambda p: F.substring_index(p["pattern"], "*", 1)
    tail = lambda p: F.when(F.contains(p["pattern"], F.lit("*")), F.substring_index(p["pattern"], "*", -1)).otherwise("")
    star = lambda p: F.contains(p["pattern"], F.lit("*"))
    fits = lambda p: F.when(star(p), F.col("spec").startswith(head(p)) & F.col("spec").endswith(tail(p)) & (F.length("spec") >= F.length(head(p)) + F.length(tail(p)))).otherwise(F.col("spec") == p["pattern"])
    middle = lambda p: F.when(star(p), F.substring(F.col("spec"), F.length(head(p)) + 1, F.length("spec") - F.length(head(p)) - F.length(tail(p)))).otherwise("")
    hits = F.filter(F.coalesce("paths", F.array()), fits)
    ordered = F.transform(hits, lambda p, i: F.struct((-F.length(head(p))).alias("k"), i.alias("i"), normal_path(F.concat_ws("/", F.col("from_folder"), F.replace(p["target"], F.lit("*"), middle(p)))).alias("c")))
    mapped = F.transform(F.array_sort(ordered), lambda x, i: F.struct((i + 1).alias("rank"), x["c"].alias("candidate")))
    based = F.when(F.col("base").isNotNull(), F.array(F.struct(F.lit(1 << 20).alias("rank"), normal_path(F.concat_ws("/", "base", "spec")).alias("candidate")))).otherwise(F.array())
    tried = F.when(relative, here).otherwise(F.concat(mapped, based))
    return rows.select(*specs.columns, F.explode(tried).alias("_t")).select(*specs.columns, "_t.rank", "_t.candidate")


def go_modules(files: DataFrame) -> DataFrame:
    """(worktree_id, folder, module) of every go.mod of files(path, content) that names a module."""
    rows = scoped(files).where(P.basename(F.col("path")) == "go.mod")
    module = F.regexp_extract("content", r'(?m)^\s*module\s+"?([^\s"]+)"?', 1)
    return rows.select(TREE, P.dirname(F.col("path")).alias("folder"), module.alias("module")).where("module <> ''")


def go_targets(specs: DataFrame, modules: DataFrame) -> DataFrame:
    """specs(worktree_id, path, spec, ...) with class (internal, stdlib or external) and target, the folder of an internal package.

    A package is internal if it is the module of the nearest go.mod or lies below it.
    """
    rows = nearest(specs, modules)
    below = (F.col("spec") == F.col("module")) | F.col("spec").startswith(F.concat("module", F.lit("/")))
    internal = F.col("module").isNotNull() & below
    kind = F.when(internal, "internal").when(~F.contains(F.substring_index("spec", "/", 1), F.lit(".")), "stdlib").otherwise("external")
    target = F.when(internal, normal_path(F.concat_ws("/", "folder", F.substring(F.col("spec"), F.length("module") + 2, F.length("spec")))))
    return rows.select(*specs.columns, kind.alias("class"), target.alias("target"))
