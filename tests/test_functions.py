import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import hashing, paths
from sparkloom.functions import text as T
from sparkloom.operators import chunks, embed


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("pattern, path, fits", [
    ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "x/y/a.ts", True), ("*.py", "deep/a.py", True), ("a?c", "abc", True),
    ("[ab].c", "a.c", True), ("[!ab].c", "a.c", False), ("CORE", "src/core/x", True), ("a{b,c}d*", "acd", True), ("[x", "a[X", True),
])
def test_matches(spark, pattern, path, fits):
    assert one(spark, paths.matches(F.lit(path), pattern)) is fits


@pytest.mark.parametrize("path, secret", [(".env", True), ("a/.env.local", True), ("id_rsa.pub", True), ("x/CREDENTIALS.json", True), ("k.pem", True), ("secrets/a", True), ("a/private/b", True), ("secretary.py", False), ("env", False)])
def test_secret(spark, path, secret):
    assert one(spark, paths.is_secret(F.lit(path))) is secret


@pytest.mark.parametrize("path, name", [("a/b.TSX", "typescript"), ("x.kts", "kotlin"), (".py", "text"), ("Makefile", "text"), ("a.h", "c"), ("a.mts", "text")])
def test_language(spark, path, name):
    assert one(spark, paths.language(F.lit(path))) == name


def test_jail():
    assert paths.jailed("./a/b.py") == "a/b.py" and paths.jailed("/r/a.py", ["/r"]) == "a.py"
    for bad in ("", "../a", "/x/a", "a/.ssh/k", "id_rsa"):
        with pytest.raises(ValueError):
            paths.jailed(bad, ["/r"])


def test_git_blob(spark, tmp_path):
    f = tmp_path / "f"
    f.write_text("hällo\n", encoding="utf-8")
    want = subprocess.run(["git", "hash-object", str(f)], capture_output=True, text=True).stdout.strip()
    assert one(spark, hashing.git_blob(F.lit("hällo\n"))) == want


def test_fnv(spark):
    assert one(spark, hashing.fnv1a(F.lit("token"))) == 2491017778 - (1 << 32)


def test_html(spark):
    html = "<html><title> A &amp;\n B</title><script>x<p></script><h1>Hi</h1><p>one<br>two</p><ul><li>x</li></ul>&lt;z&gt;"
    assert one(spark, T.html_to_text(F.lit(html))) == "A &\nB Hi\n\none\ntwo\n\n- x <z>"
    assert one(spark, T.page_title(F.lit(html), F.lit("u"))) == "A & B" and one(spark, T.page_title(F.lit("<p>"), F.lit("u"))) == "u"


def test_tokens_and_coverage(spark):
    assert one(spark, T.camel_tokens(F.lit("getUserName_v2"))) == ["get", "user", "name", "v2"]
    assert one(spark, T.coverage(T.camel_tokens(F.lit("a a b")), T.camel_tokens(F.lit("a")))) == pytest.approx(2 / 3)
    assert one(spark, T.coverage(T.camel_tokens(F.lit("")), T.camel_tokens(F.lit("a")))) == 0


def test_line_windows(spark):
    def spans(n, w, o):
        df = spark.createDataFrame([("f", "\n".join(map(str, range(n))))], "path string, content string")
        return [(r["start_line"], r["end_line"]) for r in chunks.line_windows(df, w, o).orderBy("start_line").collect()]

    assert spans(7, 4, 1) == [(1, 4), (4, 7)] and spans(70, 32, 8)[-1] == (49, 70) and spans(3, 4, 1) == [(1, 3)]
    with pytest.raises(ValueError):
        chunks.line_windows(spark.createDataFrame([], "path string, content string"), 4, 4)
    blank = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n ")], "path string, content string")
    assert chunks.line_windows(blank).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=900), st.integers(200, 400), st.integers(0, 150))
def test_doc_windows(text, most, overlap):
    parts = list(chunks.split_doc(text, most, overlap))
    assert all(0 < len(p) <= most and p in text for p in parts)
    if text.strip():
        assert text.strip().startswith(parts[0]) and text.strip().endswith(parts[-1])
    else:
        assert not parts


def test_native_and_batched_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "the cat the dog"), (2, ""), (3, None), (4, "x_1 Ünï")], "id long, t string")
    a = {r["id"]: r["vector"] for r in embed.HashEmbedder(32).embed(df, "t").collect()}
    b = {r["id"]: r["vector"] for r in embed.NativeHashEmbedder("id", 32).embed(df, "t").collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k])
    assert a[2][0] == 1 and sum(a[2]) == 1 and a[3] == a[2]


def test_provider_falls_back():
    p, warning = embed.provider("onnx", model="none", tokenizer="none", dimensions=8)
    assert isinstance(p, embed.HashEmbedder) and warning
    with pytest.raises(ValueError):
        embed.provider("other")
