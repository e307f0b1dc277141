import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import overlay, references, search, symbols, tables
from sparkloom.operators.store import Store
from sparkloom.streaming import watch


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_overlay_with_nothing_visible_keeps_all(spark):
    c = spark.createDataFrame([("a", "1")], "path string, blob_hash string")
    none = spark.createDataFrame([], "path string, blob_hash string")
    dirty = spark.createDataFrame([], "path string, content_hash string")
    assert overlay.resolve_candidates(c, overlay.visible_files(none, dirty)).count() == 1


def test_overlay_and_alias_order(spark):
    tree = spark.createDataFrame([("b", "h1"), ("c", "h2")], "path string, blob_hash string")
    dirty = spark.createDataFrame([("a", "h1"), ("c", "h3")], "path string, content_hash string")
    v = overlay.visible_files(tree, dirty)
    assert rows(v, "path", "hash") == [("a", "h1"), ("b", "h1"), ("c", "h3")]
    assert rows(overlay.aliases(v), "hash", "path") == [("h1", "b"), ("h3", "c")]  # tracked before dirty-only
    c = spark.createDataFrame([(1, "c", "h2"), (2, "gone", "h1"), (3, "c", ""), (4, "c", None)], "id int, path string, blob_hash string")
    assert rows(overlay.resolve_candidates(c, v), "id", "path") == [(2, "b"), (3, "c"), (4, "c")]


def test_store_round_trip_and_recovery(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/idx")
    assert s.read("blobs").count() == 0 and s.version("blobs") == 0
    new = spark.createDataFrame([("x", ["1"]), ("y", ["2"])], "blob_hash string, chunk_ids array<string>")
    s.upsert("blobs", new)
    s.upsert("blobs", spark.createDataFrame([("y", ["3"]), ("z", [])], "blob_hash string, chunk_ids array<string>"))
    assert rows(s.read("blobs"), "blob_hash", "chunk_ids") == [("x", ["1"]), ("y", ["3"]), ("z", [])]
    s.delete("blobs", spark.createDataFrame([("x",)], "blob_hash string"))
    assert rows(s.read("blobs"), "blob_hash") == [("y",), ("z",)]
    new.write.parquet(f"file://{tmp_path}/idx/blobs/v9")  # a write that died before the swap
    assert s.version("blobs") == 3 and s.recover("blobs") == ["v9"]
    assert s.vacuum("blobs") == [] and s.compact("blobs") == 4  # two changes over their base
    assert s.vacuum("blobs") == ["v1", "v2", "v3"] and s.read("blobs").count() == 2
    s.put_state(a="1")
    s.put_state(a="2", b="3")
    assert s.state("a") == "2" and s.state("none", "d") == "d"
    syms = spark.createDataFrame([("f", "function", "p", 1, 2, 0), ("f", "class", "p", 1, 3, 1)], "name string, kind string, file_path string, start_line int, end_line int, n int")
    s.upsert("symbols", syms, order="n")
    assert rows(s.read("symbols"), "kind", "end_line") == [("class", 3)]
    docs = spark.createDataFrame([("u", 0), ("u", 1), ("w", 0)], "url string, chunk_index int")
    s.append("docs_chunks", docs)
    s.replace_group("docs_chunks", spark.createDataFrame([("u", 0)], "url string, chunk_index int"), "url")
    assert rows(s.read("docs_chunks"), "url", "chunk_index") == [("u", 0), ("w", 0)]


BLOBS = "blob_hash string, chunk_ids array<string>"


@pytest.mark.parametrize("step", ["data", "marker", "done"])
def test_a_write_that_dies_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step):
    s = Store(spark, f"file://{tmp_path}/idx")
    s.replace("blobs", spark.createDataFrame([("old", ["1"])], BLOBS))
    new = spark.createDataFrame([("new", ["2"])], BLOBS)
    mark = Store._mark

    def dies(self, name, v):
        if step == "done":
            mark(self, name, v)
        raise KeyboardInterrupt

    if step == "data":
        new = new.withColumn("blob_hash", F.raise_error(F.lit("lost")).cast("string"))
    else:
        monkeypatch.setattr(Store, "_mark", dies)
    with pytest.raises(BaseException):
        s.replace("blobs", new)
    monkeypatch.undo()
    want = [("new",)] if step == "done" else [("old",)]
    assert rows(s.read("blobs"), "blob_hash") == want
    s.recover("blobs")
    assert rows(s.read("blobs"), "blob_hash") == want and s.recover("blobs") == []
    s.replace("blobs", spark.createDataFrame([("next", [])], BLOBS))
    assert rows(s.read("blobs"), "blob_hash") == [("next",)]


def test_recovery_keeps_the_only_whole_version(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/idx")
    monkeypatch.setattr(Store, "_mark", lambda self, name, v: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        s.replace("blobs", spark.createDataFrame([("first", [])], BLOBS))
    monkeypatch.undo()
    (tmp_path / "idx" / "blobs" / "v2" / "_temporary").mkdir(parents=True)  # and a second that was never finished
    assert s.read("blobs").count() == 0 and s.recover("blobs") == ["v2"]
    assert rows(s.read("blobs"), "blob_hash") == [("first",)] and s.recover("blobs") == []
    s.compact("blobs", 2)
    assert s.vacuum("blobs", keep=0) == ["v1"] and rows(s.read("blobs"), "blob_hash") == [("first",)]
    with pytest.raises(Exception):
        s._mark("blobs", 2)  # another writer came first


def test_vectors_of_another_length_are_refused(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/idx", dimensions=2)
    s.upsert("chunks", spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "id string, vector array<float>"))
    with pytest.raises(Exception, match="2 values"):
        s.upsert("chunks", spark.createDataFrame([("c", [1.0])], "id string, vector array<float>"))
    assert rows(s.read("chunks"), "id") == [("a",), ("b",)]


def test_scalar_filter_and_knn(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "r", None), ("b", [0.0, 1.0], "r", "w"), ("c", [1.0, 0.1], "s", "w")], "id string, vector array<double>, repo string, tree string")
    near = search.knn(df, [1.0, 0.0], 2, "id")
    assert [r["id"] for r in near.collect()] == ["a", "c"] and near.first()["score"] == 1
    assert [r["id"] for r in search.knn(df, [1.0, 0.0], 2, "id", where={"repo": ["r"], "tree": None}).collect()] == ["a"]
    assert search.knn(df, [1.0, 0.0], 9, "id", where={}).count() == 3


def test_symbol_and_path_beat_a_closer_vector(spark):
    c = spark.createDataFrame([("src/other.ts", 0.90, "other"), ("src/auth/login.ts", 0.82, "loginUser")], "path string, score double, symbol_name string")
    c = c.withColumns({"language": F.lit("typescript"), "start_line": F.lit(1), "end_line": F.lit(5), "modified": F.lit(None).cast("timestamp")})
    best = search.rescore(c, "login user", 0).orderBy(F.desc("final_score")).first()
    assert best["symbol_name"] == "loginUser" and best["symbol_match"] == 1


def test_suggestions(spark):
    s = spark.createDataFrame([("getUser", 3), ("getuser", 1), ("user", 2), ("zzz", 9)], "name string, start_line int").withColumn("file_path", F.lit("f"))
    assert [r["name"] for r in search.suggest_symbols(s, "getUser", 3).collect()] == ["getuser", "getUser", "user"]
    assert search.suggest_symbols(s, "qqqq", 2).count() == 2
    names = [(x,) for x in ("Foo", "fooBar", "aFooB", "fo", "f_o_x", "x foo y z", " ", None)]
    got = {r["name"]: r["m"] for r in spark.createDataFrame(names, "name string").select("name", F.round(search.suggestion_score(F.col("name"), " foo "), 4).alias("m")).collect()}
    assert got == {"Foo": 1.0, "fooBar": 0.95, "aFooB": 0.85, "fo": 0.7, "f_o_x": 0.13, "x foo y z": 0.85, " ": 0.0, None: 0.0}
    two = spark.createDataFrame([("bar_x_foo",)], "name string").select(search.suggestion_score(F.col("name"), "foo bar").alias("m")).first()["m"]
    assert two == 0.75  # both words, in another order


def test_floor_percentile(spark):
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate([5, 1, 3, 2])], "tool string, n int, ms double")
    r = tables.latency_percentiles(df, "tool", "n", "ms").first()
    assert (r["n"], r["p50"], r["p95"]) == (4, 2.0, 3.0)


def test_rates_of_nothing(spark):
    r = tables.rates(spark.createDataFrame([], "a int"), big=F.col("a") > 1).first()
    assert r["total"] == 0 and r["big_rate"] == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 3), ("p", "z", 1)], "query string, path string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("p", "y")], "query string, path string")
    m = tables.retrieval_metrics(ranked, relevant).first()
    assert m["mrr"] == pytest.approx(0.25) and m["recall"] == 0.5 and m["precision"] == pytest.approx(0.1) and m["ndcg"] == pytest.approx(0.5 / 1.584963, rel=1e-5)
    assert tables.regression_gate({"mrr": 0.9}, {"mrr": 1.0}) == ["mrr"] and not tables.regression_gate({"mrr": 0.99}, {"mrr": 1.0})


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "p string, c string")
    assert rows(tables.closure(e, spark.createDataFrame([("a",)], "node string"), "p", "c"), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]


def test_merge_prefers_the_first(spark):
    a = spark.createDataFrame([("k", 1)], "key string, v int")
    b = spark.createDataFrame([("k", 2), ("l", 3)], "key string, v int")
    assert rows(tables.merged(a, b, ["key"], ["v"]), "key", "v") == [("k", 1), ("l", 3)]


def test_docstrings_are_masked():
    text = 'class A:\n    """area\n    area"""\n    def area(self):\n        x = """area"""\n        return 1\n# area\ny = 1\n'
    facts = references.python_line_facts(text)
    assert [m for _, m in facts] == [False, True, True, False, False, False, True, False, False]
    assert facts[4][0] == "A" and facts[7][0] == ""


def test_references_by_anchor(spark):
    from code_tree import tree
    from sparkloom.operators import imports

    t, e = tree(spark), imports.ts_edges(tree(spark))
    got, note = references.find_references(t, "add", "web/math.ts", e)
    assert note["actual"] == "import-scan" and {r["path"] for r in got.collect()} == {"web/app.ts", "web/math.ts"}
    got, note = references.find_references(t, "area", "pkg/base.py")
    assert note["actual"] == "python-static" and ("pkg/square.py", 6, "override") in rows(got, "path", "line", "kind")
    assert references.find_references(t, "add", "web/none.ts", e)[1]["actual"] == "none"
    got, note = references.find_references(t, "Server", symbols=symbols.symbol_chunks(t).withColumnRenamed("path", "file_path"))
    assert note["actual"] == "heuristic" and note["candidates"] == ["srv/main.go:9"]


def test_word_borders(spark):
    f = spark.createDataFrame([("f", "foo_bar foo\nfoobar\nxfoo foo1 (foo)\näfoo")], "path string, content string")
    assert rows(references.word_references(f, "foo"), "line") == [(1,), (3,), (4,)]


def test_locations():
    assert references.location("a/b.py:3:4") == ("a/b.py", 3, 4) and references.location("a.py:7") == ("a.py", 7, None) and references.location("a.py") == ("a.py", None, None)


def test_router_falls_back_to_lines(spark):
    from code_tree import tree

    got = symbols.route_chunks(tree(spark))
    kinds = {r["path"]: r["kind"] for r in got.collect()}
    assert kinds["pkg/notes.md"] == "" and kinds["web/shared/util.ts"] == "" and kinds["pkg/base.py"] != ""


def test_knn_join_with_many_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(500)] + [(1000 + i, [float(i), 1.0]) for i in range(50)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [3.0, 1.0]), (9, None)], "q long, vector array<double>")
    got = sorted((r["q"], r["rank"], r["id"]) for r in search.knn_join(q, v, 3, "id", "q", block=1).collect())
    assert got == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (8, 1, 1003), (8, 2, 1002), (8, 3, 1004)]
    assert search.knn_join(q.limit(0), v, 3, "id", "q").count() == 0


def test_contents_are_counted_and_ids_scrubbed(spark):
    tree = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "k")], "path string, blob_hash string")
    dirty = spark.createDataFrame([("d", "h")], "path string, content_hash string")
    assert overlay.reference_counts("h", tree, dirty).first()["n"] == 3 and overlay.reference_counts("x", tree, dirty).first()["n"] == 0
    blobs = spark.createDataFrame([("h", ["1", "2", "3"]), ("k", []), ("n", None)], "blob_hash string, chunk_ids array<string>")
    assert rows(overlay.scrub_ids(blobs, ["2", "9"]), "blob_hash", "chunk_ids") == [("h", ["1", "3"]), ("k", []), ("n", None)]


def test_snapshot_changes_over_many_polls(spark):
    rng = random.Random(3)
    held, rows, want, before = {}, [], set(), None
    for poll in sorted(rng.sample(range(10_000), 300)):
        for path in "abcdefgh":
            if rng.random() < 0.2:
                held.pop(path, None)
            elif rng.random() < 0.3:
                held[path] = str(rng.randrange(3))
        held["always"] = "1"
        rows += [(p, poll, s) for p, s in held.items()]
        if before is not None:
            want |= {(p, poll, "modified" if p in before else "added") for p, s in held.items() if before.get(p) != s}
            want |= {(p, poll, "deleted") for p in before if p not in held}
        before = dict(held)
    out = watch.snapshot_changes(spark.createDataFrame(rows, "path string, poll long, signature string"), "path", "poll", "signature").collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
