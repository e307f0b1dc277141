"""A small source tree with one of everything, and the rows that the code operators must give on it."""

from pyspark.sql import functions as F

from sparkloom.functions import paths as P

TREE = {
    "pkg/__init__.py": 'from .base import Shape\n\n__all__ = ["Shape"]\n',
    "pkg/base.py": 'import os\nfrom pkg.tools import area\n\n\nclass Shape:\n    """A Shape has an area."""\n\n    def area(self):\n        return area(self)\n',
    "pkg/square.py": "from .base import Shape\nfrom . import tools\n\n\nclass Square(Shape):\n    def area(self):\n        return tools.area(self) ** 2  # area\n",
    "pkg/tools.py": "try:\n    import numpy\nexcept ImportError:\n    numpy = None\n\n\ndef area(x):\n    return 1\n\n\nLIMIT = [\n    1,\n]\n",
    "pkg/notes.md": "# area\nSquare and area are explained here.\n",
    "web/app.ts": 'import { add } from "./math";\nimport React from "react";\nexport * from "@/shared/util";\nimport x from "./gone";\n\nexport class App {\n  run(): number {\n    return add(1, 2);\n  }\n}\n\nexport interface Props {\n  name: string;\n}\n\nexport type Id = string | number;\n',
    "web/math.ts": "export function add(a: number, b: number) {\n  return a + b;\n}\nexport enum Kind { A, B }\n",
    "web/shared/util.ts": "export const one = 1;\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/srv/store"\n\t"github.com/x/y"\n)\n\ntype Server struct{}\n\nfunc (s *Server) Run() {}\n\nfunc main() { fmt.Println() }\n',
    "srv/lib.rs": "use std::fmt;\npub struct Point;\npub trait Draw {}\npub enum Side { L }\npub fn draw() {}\n",
    "srv/A.kt": "import a.b.C\ndata class User(val n: String)\nobject One\nfun greet() {}\ntypealias Id = String\n",
}
PROJECTS = [{"folder": "web", "base": "web", "paths": {"@/*": ["*"]}, "paths_from": "web"}]


def tree(spark):
    df = spark.createDataFrame(sorted(TREE.items()), "path string, content string")
    return df.withColumn("language", P.language(F.col("path")))


EDGE = ("source_file", "raw_specifier", "target", "edge_kind", "confidence")
ROWS = {
    "import_edges_py": (EDGE, [
        ("pkg/__init__.py", ".base", "pkg/base.py", "from", "high"), ("pkg/base.py", "os", "", "import", "medium"), ("pkg/base.py", "pkg.tools", "pkg/tools.py", "from", "high"),
        ("pkg/square.py", ".base", "pkg/base.py", "from", "high"), ("pkg/square.py", ".", "pkg/__init__.py", "from", "high"), ("pkg/square.py", ".tools", "pkg/tools.py", "child", "high"), ("pkg/tools.py", "numpy", "", "import", "low"),
    ]),
    "import_edges_ts": (EDGE, [
        ("web/app.ts", "./math", "web/math.ts", "import", "high"), ("web/app.ts", "react", "pkg:react", "import", "medium"), ("web/app.ts", "@/shared/util", "web/shared/util.ts", "export", "high"), ("web/app.ts", "./gone", "", "import", "low"),
    ]),
    "importers": (("source_file", "via"), [("pkg/__init__.py", ".base"), ("pkg/square.py", ".base")]),
    "dep_groups": (("source_file", "group", "names"), [
        ("pkg/__init__.py", "internal", "pkg/base.py"), ("pkg/base.py", "internal", "pkg/tools.py"), ("pkg/base.py", "stdlib", "os"), ("pkg/square.py", "internal", "pkg/__init__.py,pkg/base.py,pkg/tools.py"), ("pkg/tools.py", "external", "numpy"),
    ]),
    "go_groups": (("raw_specifier", "class"), [("fmt", "stdlib"), ("example.com/srv/store", "internal"), ("github.com/x/y", "external")]),
    "symbol_chunks": (("path", "kind", "name", "parent", "start_line", "end_line"), [
        ("pkg/__init__.py", "variable", "__all__", "", 3, 4), ("pkg/base.py", "class", "Shape", "", 5, 10), ("pkg/base.py", "method", "area", "Shape", 8, 10), ("pkg/square.py", "class", "Square", "", 5, 8), ("pkg/square.py", "method", "area", "Square", 6, 8),
        ("pkg/tools.py", "function", "area", "", 7, 10), ("pkg/tools.py", "variable", "LIMIT", "", 11, 11), ("srv/A.kt", "class", "User", "", 2, 2), ("srv/A.kt", "class", "One", "", 3, 3), ("srv/A.kt", "function", "greet", "", 4, 4), ("srv/A.kt", "type", "Id", "", 5, 5),
        ("srv/lib.rs", "class", "Point", "", 2, 2), ("srv/lib.rs", "interface", "Draw", "", 3, 3), ("srv/lib.rs", "enum", "Side", "", 4, 4), ("srv/lib.rs", "function", "draw", "", 5, 5),
        ("srv/main.go", "class", "Server", "", 9, 9), ("srv/main.go", "method", "Run", "Server", 11, 11), ("srv/main.go", "function", "main", "", 13, 13),
        ("web/app.ts", "class", "App", "", 6, 10), ("web/app.ts", "method", "run", "App", 7, 9), ("web/app.ts", "interface", "Props", "", 12, 14), ("web/app.ts", "type", "Id", "", 16, 16),
        ("web/math.ts", "function", "add", "", 1, 3), ("web/math.ts", "enum", "Kind", "", 4, 4),
    ]),
    "python_references": (("path", "line", "kind"), [
        ("pkg/base.py", 2, "reference"), ("pkg/base.py", 8, "declaration"), ("pkg/base.py", 9, "reference"), ("pkg/square.py", 6, "override"), ("pkg/square.py", 7, "reference"), ("pkg/tools.py", 7, "declaration"),
    ]),
    "graph_stats": (("total", "resolved", "stdlib", "external", "conditional"), [(7, 5, 1, 1, 1)]),
}
