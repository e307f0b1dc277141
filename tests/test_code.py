"""The code operators on the small tree, row by row."""

from collections import Counter

import pytest
from code_tree import PROJECTS, ROWS, tree

from sparkloom.operators import imports, references, symbols
from sparkloom.plans import q_code

ANSWERS = {
    "import_edges_py": lambda t: q_code.edge_rows(imports.python_edges(t)),
    "import_edges_ts": lambda t: q_code.edge_rows(imports.ts_edges(t, PROJECTS)),
    "importers": lambda t: imports.find_importers(imports.python_edges(t), "pkg/base.py")[0],
    "dep_groups": lambda t: q_code.group_rows(imports.python_edges(t)),
    "go_groups": q_code.class_rows,
    "symbol_chunks": q_code.symbol_rows,
    "python_references": lambda t: references.python_references(t, "area", "pkg/base.py").select("path", "line", "kind"),
    "graph_stats": lambda t: imports.graph_stats(imports.python_edges(t)),
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows(spark, name):
    names, want = ROWS[name]
    got = ANSWERS[name](tree(spark)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_standard_library_comes_before_a_file_of_that_name(spark):
    t = spark.createDataFrame([("json.py", "x = 1\n"), ("a.py", "import json\nimport far\nfrom .gone import y\n")], "path string, content string")
    got = imports.graph_stats(imports.python_edges(t)).first()
    assert (got["stdlib"], got["internal"], got["internal_resolved"], got["external"], got["internal_rate"]) == (1, 1, 0, 1, 0.0)


def test_constants_are_a_line_and_all_runs_on():
    from sparkloom.operators.symbols import scan_python

    text = '__all__ = [\n    "a",\n]\n\n\nLIMIT = [\n    1,\n]\n__all__: list = \\\n    ["b"]\nX = 1\n'
    assert scan_python(text) == [("variable", "__all__", "", 1, 5), ("variable", "LIMIT", "", 6, 6), ("variable", "__all__", "", 9, 10), ("variable", "X", "", 11, 11)]


def test_top_level_declarations(spark):
    code = "export const a = 'class Z'\n  const inner = 1\nexport default class B {\n}\nasync function* c() {}\nconst enum D { x }\n"
    got = imports.ts_declarations(spark.createDataFrame([("a.ts", code), ("b.py", "class X: pass"), ("e.ts", None)], "path string, content string")).collect()
    assert sorted((r["line"], r["name"], r["kind"]) for r in got) == [(1, "a", "variable"), (3, "B", "class"), (5, "c", "function"), (6, "D", "enum")]


def test_paths_suggested_for_a_missing_one(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("lib/user_model.py",), ("src/deep/c.py",)], "path string")
    got = [(r["path"], r["why"]) for r in imports.suggest_paths(files, "src/user.ts").collect()]
    assert sorted(got) == [("lib/user_model.py", "alike"), ("src/a.py", "beside"), ("src/b.py", "beside")]


def test_nearest_declaration_and_exported_names():
    lines = ["def f():", "    pass", "x = f()", "", "def f():", "    return 1"]
    assert references.nearest_declaration(lines, 4, "f", "python") == 5 and references.nearest_declaration(lines, 2, "f", "python") == 1
    assert references.nearest_declaration(lines, 3, "g", "python") is None and references.nearest_declaration([], 1, "f", "python") is None
    assert symbols.exported_names("a = 1\n__all__: list = ['a', \"b\", c]\n") == ["a", "b"]
    assert symbols.exported_names("def (") == symbols.exported_names("x = 1") == []
