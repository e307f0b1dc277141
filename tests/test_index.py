"""The incremental index: changes over a base, trees apart, postings of imports, nearest projects, and what a reopened index answers."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import paths as P
from sparkloom.operators import imports, nearest, reverse, store, summaries
from sparkloom.operators.store import Store
from sparkloom.plans.engine import Engine

FILES = "worktree_id string, repo_id string, path string, content string"


def trees_of(spark, trees):
    """trees: {worktree: {path: content}}."""
    rows = [(w, "r", p, c) for w, files in trees.items() for p, c in files.items()]
    df = spark.createDataFrame(rows, FILES)
    return df.withColumns({"content_hash": F.sha1("content"), "language": P.language(F.col("path")), "modified": F.timestamp_seconds(F.lit(1_000_000)) + F.make_interval(secs=F.length("content").cast("decimal(18,6)"))})


def engine_of(spark, folder):
    return Engine(spark, f"file://{folder}")


SHARED = "def shared(x):\n    return x\n"
TWO = {"wA": {"a.py": "import os\nA = 1\n" + SHARED}, "wB": {"a.py": "import sys\nB = 2\n" + SHARED}}


def names_found(e, query, tree):
    return {(r["path"], r["symbol_name"]) for r in e.semantic_search(query, 10, tree).collect()}


def test_trees_share_a_chunk(spark, tmp_path):
    e = engine_of(spark, tmp_path / "i")
    e.index(trees_of(spark, TWO))
    shared = [r for r in e.store.read("chunks").where("symbol_name = 'shared'").collect()]
    assert len(shared) == 1 and e.store.read("chunk_blobs").where(F.col("chunk_id") == shared[0]["id"]).count() == 2
    assert names_found(e, "shared", "wA") == {("a.py", "A"), ("a.py", "shared")} and names_found(e, "shared", "wB") == {("a.py", "B"), ("a.py", "shared")}
    assert e.index(trees_of(spark, {"wB": TWO["wB"]}))["deleted"] == 1
    assert names_found(e, "shared", "wB") == {("a.py", "B"), ("a.py", "shared")} and e.visible("wA").count() == 0
    assert e.doctor() == {"missing": 0, "orphan": 0, "removed": []}
    assert e.index(trees_of(spark, {"wB": {"a.py": "B = 3\n"}}))["modified"] == 1
    assert [r["symbol_name"] for r in e.store.read("chunks").collect()] == ["B"] and e.store.read("contents").count() == 1


def test_questions_by_tree_on_a_reopened_index(spark, tmp_path):
    commits = spark.createDataFrame([("c1", "c1", "ann", "2001-01-01", "first", ["a.py"], "/r", "r", "main")], "commit string, short_commit string, author string, date_raw string, message string, files array<string>, repo_path string, repo_id string, branch string").withColumn("ts", F.lit("2001-01-01").cast("timestamp"))
    engine_of(spark, tmp_path / "i").index(trees_of(spark, TWO), commits=commits)
    e = engine_of(spark, tmp_path / "i")  # nothing is attached to this one
    groups = lambda w: [(r["group"], r["names"]) for r in e.get_dependencies("a.py", worktree_id=w).collect()]
    assert groups("wA") == [("stdlib", ["os"])] and groups("wB") == [("stdlib", ["sys"])]
    rows, note = e.find_references(None, "B", "a.py", worktree_id="wB")
    assert [(r["path"], r["line"]) for r in rows.collect()] == [("a.py", 2)] and note["files"] == 1
    assert e.in_context(rows, 1, "wB").first()["context"] == "import sys\nB = 2\ndef shared(x):"
    assert [r["message"] for r in e.get_recent_changes(query="ANN").collect()] == ["first"]
    at = e.store.read("changed_at").where("worktree_id = 'wA'").first()["modified"]
    assert at.year == 2001  # the commit is newer than the file
    e.now_ms = int(at.timestamp() * 1000)
    assert e.semantic_search("shared", 1, "wA").first()["recency"] == pytest.approx(0.08)
    with pytest.raises(ValueError):
        engine_of(spark, tmp_path / "none").files()


MANY = {f"pkg/m{i}.py": f"from . import m{(i + 1) % 40}\n\n\ndef f{i}():\n    return {i}\n" for i in range(40)} | {"pkg/__init__.py": ""}


def test_one_changed_file_writes_its_own_buckets(spark, tmp_path):
    e = engine_of(spark, tmp_path / "i")
    e.index(trees_of(spark, {"w": MANY}))
    before = {n: (e.store.version(n), e.store.bytes_of(n, e.store.version(n))) for n in ("chunks", "symbols", "import_edges", "contents", "tree_entries")}
    assert e.index(trees_of(spark, {"w": MANY | {"pkg/m7.py": "from . import m9\n\n\ndef seven():\n    return 7\n"}})) == {"added": 0, "modified": 1, "deleted": 0, "same": 40}
    for name, (v, size) in before.items():
        new = e.store.version(name)
        assert new == v + 1 and e.store.bytes_of(name, new) < 0.7 * size
        folder = tmp_path / "i" / name / f"v{new}"
        assert len([x for x in os.listdir(folder) if x.startswith("_bucket")]) <= 3 and (folder / store.CHANGE).exists()
    assert e.store.version("docs_chunks") == 0
    assert [r["name"] for r in e.store.read("symbols", ["pkg/m7.py"]).collect()] == ["seven"] and e.store.read("symbols").count() == 40
    assert [r["source_file"] for r in e.find_importers("pkg/m9.py")[0].collect()] == ["pkg/m7.py", "pkg/m8.py"]


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    e = engine_of(spark, tmp_path / "i")
    e.index(trees_of(spark, {"w": MANY}))
    plan = e.store.read("import_keys", ["pkg/m9.py"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "pkg/m9.py" in plan.split("PushedFilters: [")[1].split("]")[0]


CODE = {
    "app/main.py": "import lib.core\nfrom . import util\nfrom lib import extra\nimport old.thing\nimport sys\nsys.path.append('vendor')\nimport hinted.deep\n",
    "app/util.py": "import lib\nimport ns.inner\n",
    "lib/__init__.py": "",
    "lib/core.py": "from .extra import x\n",
    "web/a.ts": 'import { b } from "./b";\nimport c from "@/c";\nimport d from "lib/d";\nimport "react";\n',
    "web/b.ts": "export const b = 1;\n",
    "web/lib/d.ts": "export default 1;\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/srv/store"\n)\n',
    "srv/x.rs": "use std::fmt;\n",
    "notes.md": "# notes\n",
}
STEPS = [
    {"lib/extra.py": "x = 1\n", "ns/inner/deep.py": "y = 1\n"},  # a module that two files asked for, and a namespace
    {"vendor/hinted/deep.py": "z = 1\n", "new/thing.py": "t = 1\n", "web/tsconfig.json": '{ // c\n "extends": "../base.json", "compilerOptions": {"baseUrl": "." } }', "base.json": '{"compilerOptions": {"paths": {"@/*": ["web/src/*"],},}}'},
    {"web/src/c/index.ts": "export default 2;\n", "srv/go.mod": "module example.com/srv\n"},
    {"lib/core.py": None, "web/b.ts": None},
    {"lib/core/__init__.py": "", "web/b.d.ts": "export const b: number;\n", "srv/go.mod": "module example.com/other\n"},
    {"base.json": None, "lib/extra.py": None, "app/main.py": CODE["app/main.py"] + "import ns\n"},
]


def stored(e):
    """All that the index holds, but for what says when it was made."""
    tables = ("contents", "chunk_blobs", "blobs", "tree_entries", "symbols", "import_edges", "import_keys")
    out = {n: sorted(str({k: sorted(v) if isinstance(v, list) else v for k, v in r.asDict().items()}) for r in e.store.read(n).collect()) for n in tables}
    return out | {"chunks": sorted(str((r["id"], r["content"], r["symbol_name"])) for r in e.store.read("chunks").collect())}


def test_small_steps_equal_a_full_build(spark, tmp_path):
    config = lambda e: setattr(e.config, "import_aliases", {"old": "new"}) or e
    e, files = config(engine_of(spark, tmp_path / "i")), dict(CODE)
    e.index(trees_of(spark, {"w": files, "other": {"lib/core.py": "", "app/main.py": "import lib.core\n"}}))
    for n, step in enumerate(STEPS):
        files = {p: c for p, c in (files | step).items() if c is not None}
        report = e.index(trees_of(spark, {"w": files, "other": {"lib/core.py": "", "app/main.py": "import lib.core\n"}}))
        assert report["added"] + report["modified"] + report["deleted"] == len(step)
        if n == len(STEPS) - 1:
            whole = config(engine_of(spark, tmp_path / f"whole{n}"))
            whole.index(trees_of(spark, {"w": files, "other": {"lib/core.py": "", "app/main.py": "import lib.core\n"}}))
            got, want = stored(e), stored(whole)
            for name in want:
                assert got[name] == want[name], (n, name)
    edges = {(r["source_file"], r["raw_specifier"]): r["resolved_target"] for r in e.store.read("import_edges").where("worktree_id = 'w'").collect()}
    assert edges["app/main.py", "lib.core"] == "lib/core/__init__.py" and edges["app/main.py", "old.thing"] == "new/thing.py" and edges["app/main.py", "hinted.deep"] == "vendor/hinted/deep.py"
    assert edges["web/a.ts", "./b"] == "web/b.d.ts" and edges["web/a.ts", "@/c"] == "pkg:@" and edges["srv/main.go", "example.com/srv/store"] is None
    for target in ("lib/core/__init__.py", "web/src/c/index.ts", "core.py", "react", "lib.core", "x/app/util.py", "nothing"):
        scan = imports.find_importers(e._edges(), target)
        fast = e.find_importers(target)
        assert [tuple(r) for r in fast[0].collect()] == [tuple(r) for r in scan[0].collect()] and fast[1] == scan[1]


def test_nearest_projects(spark):
    files = spark.createDataFrame([("w", "a/b/tsconfig.json", '{"extends": "../base", "compilerOptions": {"baseUrl": "src"}}'), ("w", "a/base.json", '{"extends": "./loop.json", "compilerOptions": {"paths": {"@/*": ["lib/*", "alt/*"], "@": ["one.ts"], "@/deep/*": ["deep/*"]}}}'), ("w", "a/loop.json", '{"extends": "base.json", "compilerOptions": {}}'), ("w", "jsconfig.json", "{ not json"), ("v", "a/b/jsconfig.json", "{}"), ("w", "x.json", None)], "worktree_id string, path string, content string")
    got = {(r["worktree_id"], r["folder"]): (r["base"], r["from_folder"], {(p["pattern"], p["target"]) for p in r["paths"] or []}) for r in nearest.ts_configs(files).collect()}
    paths = {("@/*", "lib/*"), ("@/*", "alt/*"), ("@", "one.ts"), ("@/deep/*", "deep/*")}
    assert got == {("w", "a/b"): ("a/b/src", "a/b/src", paths), ("w", ""): (None, None, set()), ("v", "a/b"): (None, None, set())}
    specs = spark.createDataFrame([("w", "a/b/c/f.ts", s) for s in ("@/deep/x", "@", "../g", "plain", "@/../q")] + [("w", "a/f.ts", "plain"), ("v", "a/b/f.ts", "./g")], "worktree_id string, path string, spec string")
    tried = {}
    for r in sorted(nearest.candidates(specs, nearest.ts_configs(files)).collect(), key=lambda r: r["rank"]):
        tried.setdefault((r["worktree_id"], r["path"], r["spec"]), []).append(r["candidate"])
    s = "a/b/src/"
    assert tried["w", "a/b/c/f.ts", "@/deep/x"] == [s + "deep/x", s + "lib/deep/x", s + "alt/deep/x", s + "@/deep/x"]
    assert tried["w", "a/b/c/f.ts", "@"] == [s + "one.ts", s + "@"] and tried["w", "a/b/c/f.ts", "../g"] == ["a/b/g"] and tried["w", "a/b/c/f.ts", "plain"] == [s + "plain"]
    assert ("w", "a/f.ts", "plain") not in tried and tried["v", "a/b/f.ts", "./g"] == ["a/b/g"]


def test_go_packages_of_the_nearest_module(spark):
    files = spark.createDataFrame([("srv/go.mod", "// x\nmodule example.com/a // c\n"), ("srv/in/go.mod", 'module "example.com/b"\n'), ("go.mod", "no module")], "path string, content string")
    specs = spark.createDataFrame([("", "srv/m.go", "example.com/a/x/y"), ("", "srv/in/m.go", "example.com/a/x"), ("", "srv/in/m.go", "example.com/b"), ("", "m.go", "fmt")], "worktree_id string, path string, spec string")
    got = {(r["path"], r["spec"]): (r["class"], r["target"]) for r in nearest.go_targets(specs, nearest.go_modules(files)).collect()}
    assert got == {("srv/m.go", "example.com/a/x/y"): ("internal", "srv/x/y"), ("srv/in/m.go", "example.com/a/x"): ("external", None), ("srv/in/m.go", "example.com/b"): ("internal", "srv/in"), ("m.go", "fmt"): ("stdlib", None)}


def test_importers_name_their_backends(spark):
    from code_tree import tree

    t = tree(spark)
    edges = imports.python_edges(t).unionByName(imports.ts_edges(t))
    got = {r["source_file"]: (r["backend"], r["backends"]) for r in reverse.importers_by_backend(edges, "pkg/base.py").collect()}
    assert got == {"pkg/__init__.py": ("python-graph", ["python-graph"]), "pkg/square.py": ("python-graph", ["python-graph"])}
    more = spark.createDataFrame([("x.py", "a", "a", "python"), ("y.py", "a.b", "a/b.py", "python"), ("z.ts", "a/b", "pkg:a", "typescript"), ("a/b.py", "a.b", "a/b.py", "python"), ("y.py", "a", "a", "python")], "source_file string, raw_specifier string, resolved_target string, lang string")
    got = {r["source_file"]: (r["backend"], r["backends"]) for r in reverse.importers_by_backend(more, "a/b.py").collect()}
    assert got == {"x.py": ("namespace", ["namespace"]), "y.py": ("python-graph", ["python-graph", "namespace", "static"]), "z.ts": ("static", ["static"])}


def test_first_spelling_that_has_importers(spark):
    edges = spark.createDataFrame([("x.py", "pkg/a"), ("y.py", "pkg/a.py"), ("y.py", "pkg/a.py"), ("z.py", "pkg/b.py")], "source_file string, resolved_target string").withColumns({"raw_specifier": F.lit("s"), "lang": F.lit("go"), "level": F.lit(0), "imported_names": F.array().cast("array<string>")})
    keys = reverse.import_keys(edges)
    got = lambda *v: sorted(tuple(r) for r in reverse.ranked_importers(lambda k: keys.where(F.col("key").isin(*k)), list(v)).collect())
    assert got("a", "pkg/a.py", "pkg/a") == [("y.py", "pkg/a.py")] and got("none") == []


BLOBS = "blob_hash string, chunk_ids array<string>"


@pytest.mark.parametrize("step", ["data", "kind", "marker", "done"])
def test_a_change_that_dies_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step):
    s = Store(spark, f"file://{tmp_path}/idx")
    s.replace("blobs", spark.createDataFrame([("old", ["1"]), ("kept", [])], BLOBS))
    new, gone = spark.createDataFrame([("new", ["2"])], BLOBS), spark.createDataFrame([("old",)], "blob_hash string")
    mark, fs = Store._mark, Store._fs

    def dies(self, name, v):
        if step == "done":
            mark(self, name, v)
        raise KeyboardInterrupt

    def no_kind(self, path):
        if path.endswith(store.CHANGE) and "v2" in path:
            raise KeyboardInterrupt
        return fs(self, path)

    if step == "data":
        new = new.withColumn("blob_hash", F.raise_error(F.lit("lost")).cast("string"))
    elif step == "kind":
        monkeypatch.setattr(Store, "_fs", no_kind)
    else:
        monkeypatch.setattr(Store, "_mark", dies)
    with pytest.raises(BaseException):
        s.change("blobs", new, gone)
    monkeypatch.undo()
    want = ["kept", "new"] if step == "done" else ["kept", "old"]
    read = lambda: sorted(r["blob_hash"] for r in s.read("blobs").collect())
    assert read() == want
    s.change("blobs", spark.createDataFrame([("next", [])], BLOBS))  # a dead write's folder isn't written again
    assert read() == sorted([*want, "next"])
    assert s.recover("blobs") == ([] if step == "done" else ["v2"]) and read() == sorted([*want, "next"])


def test_changes_are_folded_and_vacuumed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/idx")
    for i in range(2 * store.MOST_CHANGES + 6):  # two folds; the versions before the first go with the second
        s.change("blobs", spark.createDataFrame([(f"b{i % 4}", [str(i)])], BLOBS), spark.createDataFrame([("b3",)], "blob_hash string") if i % 4 == 2 else None)
    assert {r["blob_hash"]: r["chunk_ids"] for r in s.read("blobs").collect()} == {"b0": ["20"], "b1": ["21"], "b2": ["18"], "b3": ["19"]}
    assert len(s._parts("blobs")) < store.MOST_CHANGES and s._versions(f"{s.root}/blobs")[0] > 1
    assert {r["blob_hash"] for r in s.read("blobs", ["b0", "b2", "none"]).collect()} == {"b0", "b2"}


def test_summaries_say_what_heads_of_files_say(spark):
    rows = [
        ("a.py", '#!/x\n# c\n\n"""Doc one.\n  more\n"""\nx=1', "Doc one.\nmore", "Module: a"), ("b.py", "# only\n# this\n\nx", "only\nthis", "Module: b"), ("c/__init__.py", "'''in line''' \n", "in line", "Module: c"),
        ("d.go", "// Package main\n//  does\npackage main\n", "Package main\ndoes", "Package: main"), ("e.ts", "/**\n * Block here.\n * two\n */\nexport 1", "Block here.\ntwo", None), ("f.rs", "use x;", None, None),
        ("g.kt", "\n/* one */ package a.b\npackage a.b.c\n", "one */ package a.b", "Package: a.b.c"), ("h.py", '"""open\nnever', "open\nnever", "Module: h"), ("i.c", "// x", "x", None), ("j.py", None, None, "Module: j"), ("k.md", "", None, None),
    ]
    got = [(r["path"], r["doc"], r["package"]) for r in summaries.described(spark.createDataFrame([r[:2] for r in rows], "path string, content string")).collect()]
    assert got == [(p, d, k) for p, _, d, k in rows]


def test_summary_of_an_indexed_file(spark, tmp_path):
    e = engine_of(spark, tmp_path / "i")
    e.index(trees_of(spark, {"w": {"x/m.go": "// What it does.\npackage m\n\nfunc Run() {}\n", "x/n.go": "package m\n"}}))
    got = e.file_summary("x/m.go")
    assert (got["doc"], got["package"], got["state"], got["symbols"], got["lines"]) == ("What it does.", "Package: m", "indexed", ["function Run:4"], 5)
    assert {(r["path"], r["why"]) for r in e.suggest("x/run.go").collect()} == {("x/m.go", "beside"), ("x/n.go", "beside")}
