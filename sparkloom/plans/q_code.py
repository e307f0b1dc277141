"""Queries of the code operators over source trees that stand for whole tables: a file for every document or page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import imports, references, symbols
from .q_text import read

PROJECTS = [{"folder": "web", "base": "web", "paths": {"@/*": ["*"]}, "paths_from": "web"}]
HUB = ("hub/base.py", "class Base:\n    def run(self):\n        return 1\n")


def _with(spark, files, path, content):
    """files and one more."""
    return files.unionByName(spark.createDataFrame([(path, content)], "path string, content string")).withColumn("language", P.language(F.col("path")))


def _id(n=0):
    return (F.col("doc_id") + n).cast("string")


def _python(spark, d):
    """A module for every document in a folder for its source; it imports the next document's and the hub."""
    content = F.concat(
        F.lit("import os\nimport numpy as np\nfrom hub.base import Base\nfrom .d"), _id(1), F.lit(" import run"), _id(1),
        F.lit("\nfrom . import missing\ntry:\n    import yaml\nexcept ImportError:\n    yaml = None\n\nLIMIT = "), F.col("n_chars").cast("string"),
        F.lit("\n\nclass Doc"), _id(), F.lit("(Base):\n    def run(self):\n        return run"), _id(1), F.lit("(LIMIT)\n\ndef run"), _id(), F.lit("(x):\n    return Doc"), _id(), F.lit("().run()\n"),
    )
    path = F.concat(F.lit("p_"), F.regexp_replace("source", "[^A-Za-z0-9]+", "_"), F.lit("/d"), _id(), F.lit(".py"))
    return _with(spark, read(spark, d, "documents").select(path.alias("path"), content.alias("content")), *HUB)


def _typescript(spark, d):
    """A module for every page that imports the next page's."""
    n = F.col("page_id").cast("string")
    content = F.concat(F.lit('import { a } from "./p'), (F.col("page_id") + 1).cast("string"), F.lit('";\nimport React from "react";\nexport * from "@/shared/util";\nimport x from "./gone";\n'))
    return _with(spark, read(spark, d, "pages").select(F.concat(F.lit("web/p"), n, F.lit(".ts")).alias("path"), content.alias("content")), "web/shared/util.ts", "export const one = 1;\n")


def _go(spark, d):
    n = F.col("page_id").cast("string")
    content = F.concat(F.lit('package main\n\nimport (\n\t"fmt"\n\t"example.com/srv/s'), n, F.lit('"\n\t"github.com/x/y'), n, F.lit('"\n)\n'))
    return read(spark, d, "pages").select(F.concat(F.lit("srv/m"), n, F.lit(".go")).alias("path"), content.alias("content"), F.lit("go").alias("language"))


def edge_rows(edges):
    return edges.select("source_file", "raw_specifier", F.coalesce("resolved_target", F.lit("")).alias("target"), "edge_kind", "confidence")


def group_rows(edges):
    return imports.dependency_groups(edges).select("source_file", "group", F.array_join("names", ",").alias("names"))


def class_rows(files):
    return imports.line_edges(files).where("lang = 'go'").select("raw_specifier", imports.go_class(F.col("raw_specifier"), "example.com/srv").alias("class"))


def symbol_rows(files):
    return symbols.symbol_chunks(files).select("path", "kind", "name", "parent", "start_line", "end_line")


def stat_rows(edges):
    return imports.graph_stats(edges).select("total", "resolved", "stdlib", "internal", "internal_resolved", "external", "conditional")


QUERIES = {
    "import_edges_py": lambda s, d: edge_rows(imports.python_edges(_python(s, d))),
    "import_edges_ts": lambda s, d: edge_rows(imports.ts_edges(_typescript(s, d), PROJECTS)),
    "importers": lambda s, d: imports.find_importers(imports.python_edges(_python(s, d)), HUB[0])[0],
    "dep_groups": lambda s, d: group_rows(imports.python_edges(_python(s, d))),
    "go_groups": lambda s, d: class_rows(_go(s, d)),
    "symbol_chunks": lambda s, d: symbol_rows(_python(s, d)),
    "python_references": lambda s, d: references.python_references(_python(s, d), "LIMIT").select("path", "line", "kind"),
    "graph_stats": lambda s, d: stat_rows(imports.python_edges(_python(s, d))),
}

_FILES = """f AS (SELECT DISTINCT doc_id AS n, 'p_' || regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g') AS dir FROM documents),
x AS (SELECT f.*, f.dir || '/d' || f.n || '.py' AS path, '.d' || (f.n + 1) AS spec, CASE WHEN g.n IS NOT NULL THEN f.dir || '/d' || g.n || '.py' ELSE '' END AS next FROM f LEFT JOIN f g ON g.n = f.n + 1 AND g.dir = f.dir)"""

ORACLES = {
    "import_edges_py": f"""WITH {_FILES}
SELECT path AS source_file, 'os' AS raw_specifier, '' AS target, 'import' AS edge_kind, 'medium' AS confidence FROM x UNION ALL SELECT path, 'numpy', '', 'import', 'low' FROM x
UNION ALL SELECT path, 'yaml', '', 'import', 'low' FROM x UNION ALL SELECT path, 'hub.base', 'hub/base.py', 'from', 'high' FROM x
UNION ALL SELECT path, spec, next, 'from', CASE WHEN next = '' THEN 'low' ELSE 'high' END FROM x UNION ALL SELECT path, '.', dir, 'from', 'medium' FROM x""",
    "import_edges_ts": """WITH x AS (SELECT DISTINCT p.page_id AS n, q.page_id AS m FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id + 1)
SELECT 'web/p' || n || '.ts' AS source_file, './p' || (n + 1) AS raw_specifier, CASE WHEN m IS NULL THEN '' ELSE 'web/p' || m || '.ts' END AS target, 'import' AS edge_kind, CASE WHEN m IS NULL THEN 'low' ELSE 'high' END AS confidence FROM x
UNION ALL SELECT 'web/p' || n || '.ts', 'react', 'pkg:react', 'import', 'medium' FROM x UNION ALL SELECT 'web/p' || n || '.ts', './gone', '', 'import', 'low' FROM x
UNION ALL SELECT 'web/p' || n || '.ts', '@/shared/util', 'web/shared/util.ts', 'export', 'high' FROM x""",
    "importers": f"WITH {_FILES} SELECT path AS source_file, 'hub.base' AS via FROM x ORDER BY path LIMIT 100",
    "dep_groups": f"""WITH {_FILES} SELECT path AS source_file, 'internal' AS "group", 'hub/base.py,' || dir || CASE WHEN next <> '' THEN ',' || next ELSE '' END AS names FROM x
UNION ALL SELECT path, 'stdlib', 'os' FROM x UNION ALL SELECT path, 'external', CASE WHEN next = '' THEN spec || ',' ELSE '' END || 'numpy,yaml' FROM x""",
    "go_groups": """WITH p AS (SELECT DISTINCT page_id AS n FROM pages) SELECT 'fmt' AS raw_specifier, 'stdlib' AS "class" FROM p
UNION ALL SELECT 'example.com/srv/s' || n, 'internal' FROM p UNION ALL SELECT 'github.com/x/y' || n, 'external' FROM p""",
    "symbol_chunks": f"""WITH {_FILES} SELECT path, 'variable' AS kind, 'LIMIT' AS name, '' AS parent, 11 AS start_line, 11 AS end_line FROM x UNION ALL SELECT path, 'class', 'Doc' || n, '', 13, 16 FROM x
UNION ALL SELECT path, 'method', 'run', 'Doc' || n, 14, 16 FROM x UNION ALL SELECT path, 'function', 'run' || n, '', 17, 19 FROM x
UNION ALL SELECT 'hub/base.py', 'class', 'Base', '', 1, 4 UNION ALL SELECT 'hub/base.py', 'method', 'run', 'Base', 2, 4""",
    "python_references": f"WITH {_FILES} SELECT path, 11 AS line, 'declaration' AS kind FROM x UNION ALL SELECT path, 15, 'reference' FROM x",
    "graph_stats": f"""WITH {_FILES} SELECT 6 * count(*) AS total, 2 * count(*) + count(*) FILTER (WHERE next <> '') AS resolved, count(*) AS stdlib, 3 * count(*) AS internal,
2 * count(*) + count(*) FILTER (WHERE next <> '') AS internal_resolved, 2 * count(*) AS external, count(*) AS conditional FROM x""",
}
