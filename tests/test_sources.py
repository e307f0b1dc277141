import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.batch import check_plan, format_references, format_results, format_status, format_summary, run_plan
from sparkloom.plans.engine import Engine, bake_off, head_trees, index_state, scan_roots, watched
from sparkloom.sources import documents, files, projects


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "sub").mkdir(parents=True)
    git(root.parent, "init", "-q", "-b", "main", str(root))
    (root / "a.py").write_text("import os\n\n\ndef first():\n    return os\n")
    (root / "sub" / "b.py").write_text("from a import first\n\n\ndef second():\n    return first()\n")
    (root / "old.txt").write_text("some words that stay the same\nand more\n")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    git(root, "mv", "old.txt", "new.txt")
    (root / "sub" / "c.py").write_text("x = 1\n")
    return root


def test_git_tables(spark, repo):
    info = files.worktree_info(str(repo))
    assert info["is_main"] and info["branch"] == "main" and info["worktree_id"].startswith("wt-")
    tree = files.head_tree(spark, str(repo), info["worktree_id"])
    assert {r["path"] for r in tree.collect()} == {"a.py", "sub/b.py", "old.txt"}
    assert {r["path"] for r in files.head_tree(spark, str(repo / "sub"), "w").collect()} == {"b.py"}  # relative to the root
    assert files.dirty_paths(str(repo)) == ["new.txt", "old.txt", "sub/c.py"] and files.dirty_paths(str(repo / "sub")) == ["c.py"]
    git(repo, "worktree", "add", "-q", "-b", "side", str(repo.parent / "side"))
    side = files.worktree_info(str(repo.parent / "side"))
    assert not side["is_main"] and side["repo_id"] == info["repo_id"] and side["worktree_id"] != info["worktree_id"] and len(files.worktrees(str(repo))) == 2
    assert files.worktree_info(str(repo.parent)) is None
    log = files.git_history(spark, str(repo)).collect()
    assert len(log) == 1 and log[0]["message"] == "one" and sorted(log[0]["files"]) == ["a.py", "old.txt", "sub/b.py"] and log[0]["ts"] is not None


def test_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in (("a.py", b"x"), (".env", b"s"), ("big.txt", b"x" * (1 << 20 | 1)), ("nul.bin", b"a\0b"), ("node_modules/x.js", b"1"), ("skip.md", b"m")):
        (tmp_path / name).write_bytes(data)
    got = files.scan_files(spark, str(tmp_path), exclude=["*.md"]).collect()
    assert [(r["path"], r["language"], r["content"]) for r in got] == [("a.py", "python", "x")]
    assert files.scan_files(spark, str(tmp_path), include=["*.md"]).first()["path"] == "skip.md"


def test_index_is_incremental_and_answers(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/idx")
    trees = lambda: scan_roots(spark, [str(repo)], e.config)
    assert e.index(trees()) == {"added": 4, "modified": 0, "deleted": 0, "same": 0}
    before = e.store.version("chunks")
    assert e.index(trees())["same"] == 4 and e.store.version("chunks") == before  # nothing changed, nothing written
    (repo / "a.py").write_text("def first():\n    return 2\n")
    (repo / "new.txt").unlink()
    assert e.index(trees()) == {"added": 0, "modified": 1, "deleted": 1, "same": 2}
    assert e.doctor() == {"missing": 0, "orphan": 0, "removed": []}
    got = e.semantic_search("first", 3)
    assert got.count() >= 1 and e.semantic_search("  ").count() == 0
    assert [r["path"] for r in e.find_files("*.py").collect()] == ["a.py", "sub/b.py", "sub/c.py"]
    assert [r["name"] for r in e.get_symbols(name="SECOND").collect()] == ["second"]
    assert [r["source_file"] for r in e.find_importers("a.py")[0].collect()] == ["sub/b.py"]
    assert e.get_dependencies("sub/b.py").first()["names"] == ["a.py"] and e.get_dependencies("sub").count() == 1
    s = e.status()
    assert s["files"] == 3 and s["languages"]["python"] == 3 and set(s["latency"]) == {"find_importers", "get_dependencies"} and format_status(s).startswith("files 3")
    summary = e.file_summary("sub/b.py")
    assert summary["state"] == "indexed" and "[imports] a" in format_summary(summary)
    assert e.file_summary("none.py")["state"] == "live-file-not-indexed"
    content = trees().select("path", "content")
    rows, note = e.find_references(content, "first", "a.py")
    assert note["actual"] == "python-static" and "python-static" in format_references([r.asDict() for r in rows.collect()], note)
    out = run_plan(e, json.dumps({"calls": [{"tool": "find_files", "args": {"pattern": "a"}}, {"tool": "status"}]}), threads=2)
    assert out["ok"] and out["calls_executed"] == 2 and out["results"][0]["result"] == [{"path": "a.py"}]
    assert not run_plan(e, [{"tool": "get_dependencies", "args": {"path": "../x"}}])["ok"]
    assert any(p in format_results([r.asDict() for r in got.collect()]) for p in ("a.py", "sub/b.py"))
    every_tool_runs_from_a_plan(e, repo)


def test_two_trees_with_one_path(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/idx")
    rows = [("wA", "a.py", "hA", "def alpha():\n    return 1\n"), ("wB", "a.py", "hB", "def beta():\n    return 2\n"), ("wB", "b.py", "hA", "def alpha():\n    return 1\n")]
    trees = spark.createDataFrame([(w, "r", p, h, "python", c) for w, p, h, c in rows], "worktree_id string, repo_id string, path string, content_hash string, language string, content string")
    assert e.index(trees)["added"] == 3
    named = {(r["worktree_id"], r["file_path"], r["name"]) for r in e.store.read("symbols").collect()}
    assert named == {("wA", "a.py", "alpha"), ("wB", "a.py", "beta"), ("wB", "b.py", "alpha")}
    held = e.store.read("chunk_blobs").join(e.store.read("chunks").withColumnRenamed("id", "chunk_id"), "chunk_id")
    assert sorted((r["blob_hash"], r["symbol_name"]) for r in held.collect()) == [("hA", "alpha"), ("hB", "beta")]
    assert [r["path"] for r in e.semantic_search("alpha", 1, "wA").collect()] == ["a.py"]
    assert {r["path"] for r in e.semantic_search("alpha", 5, "wB").collect()} == {"a.py", "b.py"}
    assert e.doctor() == {"missing": 0, "orphan": 0, "removed": []}


def test_dirty_files_lie_over_the_last_commit(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/idx")
    (repo / "a.py").write_text("def fresh():\n    return 3\n")
    index = lambda: e.index(scan_roots(spark, [str(repo)], e.config), head_trees(spark, [str(repo)]))
    assert index()["added"] == 4
    dirty = lambda: {r["path"]: len(r["chunk_ids"]) for r in e.store.read("dirty_files").collect()}
    assert dirty()["a.py"] == 1 and "sub/b.py" not in dirty() and e.file_summary("a.py")["state"] == "dirty-overlay"
    assert [r["path"] for r in e.semantic_search("fresh", 1).collect()] == ["a.py"]
    git(repo, "add", "-A")
    git(repo, "commit", "-q", "-m", "all")
    assert index()["same"] == 4 and dirty() == {} and e.file_summary("a.py")["state"] == "indexed"
    assert e.doctor()["orphan"] == 0


def test_watched_trees_are_indexed(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/idx")
    w = watched(e, [str(repo)], str(tmp_path / "cp"))
    for changes in ([("r", "a.py", "modified")], []):
        w.waiting = {x[:2]: x[2] for x in changes}
        w._give_out()
    assert [r["path"] for r in e.find_files("*.py").collect()] == ["a.py", "sub/b.py", "sub/c.py"]


def test_changes_wait_for_quiet(spark, tmp_path):
    from sparkloom.streaming.watch import Watcher

    got = []
    w = Watcher(spark, [], got.append, str(tmp_path), 1, 1)
    assert (w.poll_ms, w.quiet_ms) == (50, 25)
    change = lambda *rows: spark.createDataFrame(list(rows), "root string, path string, kind string, poll long")
    w.quiet_ms = 60_000
    w.polled(change(("r", "b", "added", 1), ("r", "a", "added", 1), ("r", "b", "modified", 2)))
    w.polled(change())
    assert got == []  # not quiet for long enough
    w.polled(change(("r", "a", "deleted", 3)))
    w.quiet_ms = 0
    w.polled(change())
    w.polled(change())
    assert got == [[("r", "a", "deleted"), ("r", "b", "modified")]]


def every_tool_runs_from_a_plan(e, repo):
    e.attach(commits=files.git_history(e.spark, str(repo)))
    calls = [
        {"tool": "semantic_search", "args": {"query": "first", "filePattern": "a.py", "codeOnly": True, "minScore": 0}}, {"tool": "find_files", "args": {"pattern": "*.py", "limit": 1}},
        {"tool": "get_symbols", "args": {"name": "sec", "filePath": "sub/b.py", "limit": "many"}}, {"tool": "get_file_summary", "args": {"path": "a.py"}},
        {"tool": "get_recent_changes", "args": {"limit": 3.0, "since": "2001-01-01"}}, {"tool": "get_dependencies", "args": {"path": "sub/b.py", "max_files": 3}},
        {"tool": "find_importers", "args": {"target": "a.py", "limit": 5}}, {"tool": "find_references", "args": {"symbol": "first", "file_path": "a.py", "includeDeclaration": True, "includeContext": True}},
    ]
    out = run_plan(e, json.dumps({"calls": calls}))
    assert out["ok"], out
    by = {r["tool"]: r["result"] for r in out["results"]}
    assert {r["path"] for r in by["semantic_search"]} == {"a.py"} and len(by["find_files"]) == 3  # a limit isn't one of its arguments
    assert [r["name"] for r in by["get_symbols"]] == ["second"] and by["get_file_summary"]["path"] == "a.py"
    assert [r["message"] for r in by["get_recent_changes"]] == ["one"] and by["find_importers"][0] == [{"source_file": "sub/b.py", "via": "a"}]
    assert by["get_dependencies"][0]["names"] == ["a.py"] and ("a.py", 1) in {(r["path"], r["line"]) for r in by["find_references"][0]} and "context" in by["find_references"][0][0]
    assert run_plan(e, [{"tool": "get_recent_changes", "args": {"since": "2999-01-01"}}])["results"][0]["result"] == []
    assert not run_plan(e, [{"tool": "find_references", "args": {"symbol": " "}}])["ok"] and run_plan(e, [{"tool": "status"}])["ok"]


@pytest.mark.parametrize("plan", [[], [{"tool": "x"}], [{"tool": "status"}] * 9, {"calls": "no"}, [{"tool": "status", "args": 1}], [{"tool": "find_files", "args": {"pattern": 3}}], [{"tool": "file_summary", "args": {"path": "a"}}]])
def test_bad_plans(plan):
    with pytest.raises(ValueError):
        check_plan(plan)


@pytest.mark.parametrize("facts, state", [
    ((1, 0, 1, 1), "indexed"), ((1, 0, 1, 0), "indexed-incomplete"), ((1, 0, 0, 0), "manifest-only"), ((0, 0, 0, 0), "live-file-not-indexed"), ((1, 1, 1, 1), "dirty-overlay"), ((0, 1, 0, 0), "dirty-overlay-unstructured"), ((0, 1, 1, 0), "dirty-overlay-incomplete"),
])
def test_states(facts, state):
    assert index_state(*map(bool, facts)) == state


def test_documents(spark, tmp_path):
    (tmp_path / "p.html").write_text("<html><title>T</title><p>" + "A sentence here. " * 200 + "</p></html>")
    got = documents.fetch(spark.createDataFrame([(f"file://{tmp_path}/p.html",), ("file:///none",)], "url string"))
    assert {r["error"] is None for r in got.collect()} == {True, False}
    docs = documents.readable(got.withColumn("content_type", F.lit("text/html")))
    parts = documents.chunked(docs).orderBy("chunk_index").collect()
    assert len(parts) > 1 and parts[0]["title"] == "T" and all(len(p["content"]) <= 1400 for p in parts)


def test_project_files(tmp_path):
    p = projects.read_pyproject('[project]\nname = "n"\ndependencies = ["a>=1", "b"]\n[tool.sparkloom.import-aliases]\nx = "y.z"\n')
    assert p == {"name": "n", "dependencies": ["a", "b"], "include": [], "aliases": {"x": "y.z"}} and projects.read_pyproject("[")["name"] == ""
    (tmp_path / "sparkloom.json").write_text('{"roots": ["src"], "poll_ms": 1}')
    c = projects.load_config(str(tmp_path))
    assert c.roots == [f"{tmp_path}/src"] and c.poll_ms == 50
    (tmp_path / "sparkloom.json").write_text('{"rots": []}')
    with pytest.raises(ValueError):
        projects.load_config(str(tmp_path))


def test_aliases_and_hints(spark):
    from sparkloom.operators import imports

    t = spark.createDataFrame([("lib/core/x.py", ""), ("app/m.py", "import old.x\nfrom ...up import y\nfrom .none import z\n"), ("app/s.py", "import sys\nsys.path.append('lib')\nimport core.x\nimport far\n"), ("ns/p/q.py", ""), ("app/n.py", "import ns.p\n")], "path string, content string")
    got = {(r["source_file"], r["raw_specifier"]): (r["resolved_target"], r["confidence"], r["unresolved_reason"]) for r in imports.python_edges(t, {"old": "lib.core"}).collect()}
    assert got["app/m.py", "old.x"] == ("lib/core/x.py", "medium", "by alias") and got["app/m.py", "...up"][1:] == ("low", "escapes the package root")
    assert got["app/m.py", ".none"][1:] == ("low", "no such relative module") and got["app/s.py", "core.x"] == ("lib/core/x.py", "medium", "by path hint")
    assert got["app/s.py", "far"] == (None, "medium", "external") and got["app/n.py", "ns.p"] == ("ns/p", "medium", None)


def test_watch_stream(spark, tmp_path):
    from sparkloom.streaming.watch import Watcher

    root = tmp_path / "w"
    (root / "node_modules").mkdir(parents=True)
    (root / "a").write_text("1")
    got = []
    w = Watcher(spark, [str(root)], got.append, str(tmp_path / "cp"), 100)
    w.start()
    w.start()

    def until(test):
        for _ in range(300):
            if test():
                return True
            time.sleep(0.1)
        return False

    try:
        assert until(lambda: w.query.lastProgress is not None)
        time.sleep(1)
        (root / "b").write_text("2")
        (root / "node_modules" / "x").write_text("3")
        assert until(lambda: any(x[1:] == ("b", "added") for b in got for x in b))
        (root / "b").write_text("22")
        assert until(lambda: any(x[1:] == ("b", "modified") for b in got for x in b))
        (root / "a").unlink()
        assert until(lambda: any(x[1:] == ("a", "deleted") for b in got for x in b))
        assert all("node_modules" not in x[1] for b in got for x in b)
    finally:
        w.stop()
        w.stop()


def test_bake_off_ranks_and_keeps_failures():
    def evaluate(options):
        return {"mrr": 1 / options["n"], "ndcg": 0.5}

    got = bake_off(evaluate, {"b": {"n": 2}, "a": {"n": 2}, "best": {"n": 1}, "broken": {"n": 0}})
    assert [name for name, _ in got] == ["best", "a", "b", "broken"] and "error" in got[-1][1]


def test_indexed_docs_are_replaced_by_url(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/idx")
    pages = lambda *rows: spark.createDataFrame(list(rows), "url string, content_type string, body string")
    e.index_docs(pages(("u", "text/html", "<html><title>T</title><body>old words</body></html>"), ("v", "text/plain", "other")))
    e.index_docs(pages(("u", "text/plain", "new words")))
    assert [r["content"] for r in e.search_docs("words").collect()] == ["new words"] and e.search_docs("OTHER").count() == 1
