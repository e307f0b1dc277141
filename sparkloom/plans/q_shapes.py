"""Queries of the code operators over files of five languages whose lines follow from the texts, of the import graph's other side, and of projects.

A document's lines become declarations, comments, imports and blank lines by their own first word and length, so symbols,
comments and counts differ from file to file, and the SQL finds them in the same lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports, nearest, overlay, references, reverse, summaries, symbols, tables
from ..operators import chunks as C
from . import q_code
from .q_text import read

#: For each language what a line becomes, by its length; {w} is its first word, and a line without one is blank.
SHAPES = {
    "py": ("# about {w}", "class {w}(Base):", "    def {w}(self):", "        return {w}", "LIMIT_{w} = 1", "@{w}", "def {w}(x):", "from .{w} import {w}"),
    "ts": ("// about {w}", "export class {w} {", "  {w}() {}", "export interface {w} {}", "type {w} = string;", "export function {w}(a) {", "}", "import {w} from './{w}';"),
    "go": ("// about {w}", "func {w}() {", "}", "type {w} struct {", "type {w} interface {", "func (r *T) {w}() {", "package {w}", "type {w} int"),
    "rs": ("// about {w}", "pub fn {w}() {", "struct {w};", "pub trait {w} {}", "enum {w} { A }", "fn {w}(x: i32) {}", "pub struct {w}(i32);", "use {w}::x;"),
    "kt": ("// about {w}", "data class {w}(val x: Int)", "interface {w}", "typealias {w} = Int", "suspend fun T.{w}(x: Int) = x", "object {w}", "package {w}", "fun {w}() {}"),
}
LANGUAGES = dict(zip(SHAPES, ("python", "typescript", "go", "rust", "kotlin")))


def shaped(spark, d):
    """files(doc_id, path, language, content): every document in one of the languages; Python ones are modules or packages."""
    docs = read(spark, d, "documents").select("doc_id", "n_chars", F.split("text", "\n").alias("l"))
    kinds = F.array(*[F.lit(k) for k in SHAPES])
    docs = docs.withColumn("kind", F.element_at(kinds, (F.col("doc_id") % len(SHAPES) + 1).cast("int")))
    shapes = F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    word = lambda x: F.regexp_extract(x, "[A-Za-z]+", 0)
    line = lambda x: F.when(word(x) == "", "").otherwise(F.replace(F.element_at(shapes[F.col("kind")], F.length(x) % 8 + 1), F.lit("{w}"), word(x)))
    name = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"))
    path = F.when((F.col("kind") == "py") & (F.col("n_chars") % 2 == 0), F.concat(name, F.lit("/__init__.py"))).otherwise(F.concat(name, F.lit("."), F.col("kind")))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.col("kind")]
    return docs.select("doc_id", path.alias("path"), lang.alias("language"), F.array_join(F.transform("l", line), "\n").alias("content"))


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


_KINDS = "[" + ", ".join(map(_quoted, SHAPES)) + "]"
_SHAPES = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_quoted, v))}]" for k, v in SHAPES.items()) + " END"
#: code(doc_id, kind, path, l): the lines of each file; ln(path, kind, k, s): each of them.
_CODE = f"""code AS (SELECT doc_id, kind, CASE WHEN kind = 'py' AND n_chars % 2 = 0 THEN 'src/d' || doc_id || '/__init__.py' ELSE 'src/d' || doc_id || '.' || kind END AS path,
 list_transform(l, lambda x: CASE WHEN regexp_extract(x, '[A-Za-z]+') = '' THEN '' ELSE replace(shapes[length(x) % 8 + 1], '{{w}}', regexp_extract(x, '[A-Za-z]+')) END) AS l
 FROM (SELECT *, {_SHAPES} AS shapes FROM (SELECT doc_id, n_chars, ({_KINDS})[(doc_id % {len(SHAPES)} + 1)::INT] AS kind, string_split(text, chr(10)) AS l FROM documents))),
ln AS (SELECT path, kind, unnest(range(1, len(l) + 1))::INT AS k, unnest(l) AS s FROM code WHERE array_to_string(l, chr(10)) <> '')"""


def _any(rules):
    return " UNION ALL ".join(f"SELECT path, '{k}' AS symbol, regexp_extract(s, {_quoted(p)}, 1) AS name, k FROM ln WHERE regexp_matches(s, {_quoted(p)})" for k, p in rules)


_EXTRACTED = f"""{_CODE}, top AS (SELECT *, last_value(CASE WHEN s <> '' AND NOT starts_with(s, ' ') AND NOT starts_with(s, '#') THEN s END IGNORE NULLS) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM ln WHERE kind = 'py'),
x AS (SELECT DISTINCT * FROM ({_any(symbols.ANY_LANGUAGE)}
 UNION ALL SELECT path, CASE WHEN starts_with(s, ' ') AND starts_with(coalesce(above, ''), 'class ') THEN 'method' ELSE 'function' END, regexp_extract(s, 'def (\\w+)', 1), k FROM top WHERE regexp_matches(s, '^ *def ')
 UNION ALL SELECT path, 'module', regexp_extract(s, 'import (\\w+)', 1), k FROM ln WHERE kind = 'py' AND ends_with(path, '__init__.py') AND starts_with(s, 'from ')))"""


def _line_rules():
    """One case for each language of the line scanner: the first rule that fits."""
    out = []
    for ext, lang in LANGUAGES.items():
        for n, (kind, pattern, name, parent) in enumerate(symbols.LINE_RULES.get(lang, ())):
            own = f"regexp_extract(s, {_quoted(pattern)}, {parent})" if parent else "''"
            out.append(f"SELECT path, '{kind}' AS symbol, regexp_extract(s, {_quoted(pattern)}, {name}) AS name, {own} AS parent, k, {n} AS n FROM ln WHERE kind = '{ext}' AND regexp_matches(s, {_quoted(pattern)})")
    return "(SELECT path, arg_min(symbol, n) AS symbol, arg_min(name, n) AS name, arg_min(parent, n) AS parent, k FROM (" + " UNION ALL ".join(out) + ") GROUP BY path, k)"


def _extracted(spark, d):
    return symbols.extracted_symbols(shaped(spark, d)).select("path", "kind", "name", "start_line")


def _declared(spark, d):
    return symbols.line_symbols(shaped(spark, d)).select("path", "kind", "name", "parent", "start_line")


def _merged(spark, d):
    """Go, Rust and Kotlin, whose scanner goes by lines as well."""
    files = shaped(spark, d).where(F.col("language").isin("go", "rust", "kotlin"))
    return symbols.merged_symbols(symbols.symbol_chunks(files), symbols.extracted_symbols(files)).select("path", "kind", "name", "start_line", "origin")


def _summaries(spark, d):
    return summaries.described(shaped(spark, d))


_MARK = "CASE WHEN kind = 'py' THEN '#' ELSE '//' END"
_SUMMARY_SQL = f"""WITH {_CODE}, h AS (SELECT path, kind, l, len(list_filter(range(1, len(l) + 1), lambda i: array_to_string(l[1:i], '') = '')) AS blank FROM code),
t AS (SELECT path, kind, l, l[blank + 1:len(l)] AS rest FROM h), u AS (SELECT *, coalesce(list_min(list_filter(range(1, len(rest) + 1), lambda i: NOT starts_with(rest[i], {_MARK}))), len(rest) + 1) AS stop FROM t)
SELECT path, CASE kind WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE 'kotlin' END AS language,
CASE WHEN stop > 1 THEN array_to_string(list_transform(rest[1:stop - 1], lambda x: trim(substr(x, length({_MARK}) + 1))), chr(10)) END AS doc,
CASE WHEN kind = 'py' THEN 'Module: ' || replace(regexp_replace(path, '/__init__.py$|.py$', ''), '/', '.')
 WHEN kind IN ('go', 'kt') AND len(list_filter(l, lambda x: starts_with(x, 'package '))) > 0 THEN 'Package: ' || substr(list_filter(l, lambda x: starts_with(x, 'package '))[1], 9) END AS package FROM u"""


def _postings(spark, d):
    """Two trees: the documents, and the documents with a line after their end. Chunks of the second, and those that it shares with the first at the same path."""
    docs = read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    two = docs.withColumn("tree", F.lit("a")).unionByName(docs.select("path", F.concat("content", F.lit("\nend")).alias("content"), F.lit("b").alias("tree")))
    cut = C.line_windows(two).select("tree", "path", F.sha1("content").alias("blob_hash"), "chunk_id")
    posted = cut.select("chunk_id", "path", "blob_hash").distinct()
    seen = two.where("tree = 'b'").select("path", F.sha1("content").alias("hash"), F.struct(F.lit(False).alias("dirty_only"), "path").alias("place"))
    mine = overlay.resolve_candidates(posted, seen).withColumn("own", F.lit(True)).select("chunk_id", "path").distinct()
    shared = posted.groupBy("chunk_id").agg(F.count("*").alias("blobs"))
    return mine.join(shared, "chunk_id").groupBy("path").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("blobs") > 1).alias("n_shared"))


def _windows(tree, text):
    return f"""SELECT '{tree}' AS tree, path, blob, a, array_to_string(l[a + 1:a + 80], chr(10)) AS raw, len(l) AS n FROM (SELECT *, unnest(range(0, CASE WHEN len(l) <= 80 THEN 1 ELSE ceil((len(l) - 80) / 60.0)::INT + 1 END)) * 60 AS a
 FROM (SELECT 'doc-' || doc_id AS path, sha1({text}) AS blob, string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE length({text}) > 0))"""


_POSTINGS_SQL = f"""WITH w AS ({_windows('a', 'text')} UNION ALL {_windows('b', "text || chr(10) || 'end'")}),
c AS (SELECT tree, path, blob, a, least(a + 80, n) AS z, regexp_replace(raw, '\\s+$', '') AS chunk FROM w), p AS (SELECT DISTINCT path, blob, a, z, chunk FROM c WHERE chunk <> ''),
s AS (SELECT path, a, z, chunk, count(*) AS blobs FROM p GROUP BY ALL)
SELECT path, count(*) AS n_chunks, count(*) FILTER (blobs > 1) AS n_shared FROM (SELECT DISTINCT path, a, z, chunk FROM c WHERE tree = 'b' AND chunk <> '') JOIN s USING (path, a, z, chunk) GROUP BY 1"""


def _place(col="url"):
    """A page's place as a file path: host and path without what comes behind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "^[a-z]+://", ""), r"[?#].*$", ""), "/+$", "")


def _nearest(spark, d):
    """Every page as a file below its URL; each host is a project, and so is each first folder of two letters."""
    pages = read(spark, d, "pages").select("page_id", F.concat(_place(), F.lit("/f"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), F.lit("w").alias("worktree_id"))
    host, first = F.substring_index("path", "/", 1), F.get(F.split("path", "/"), F.lit(1))
    folders = pages.select("worktree_id", host.alias("folder")).unionByName(pages.where(F.length(first) == 2).select("worktree_id", F.concat_ws("/", host, first).alias("folder"))).distinct()
    return nearest.nearest(pages, folders.withColumn("id", F.md5("folder"))).select("page_id", "folder", "id")


def _ts_candidates(spark, d):
    """What '@/x', './x' and 'x' stand for in each page's file: projects are as in nearest_projects, hosts with a base, folders with patterns."""
    pages = read(spark, d, "pages").select("page_id", F.concat(_place(), F.lit("/f"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"))
    host, first = F.substring_index("path", "/", 1), F.get(F.split("path", "/"), F.lit(1))
    one = pages.select(F.concat(host, F.lit("/tsconfig.json")).alias("path"), F.lit('{"compilerOptions": {"baseUrl": "./src"}} // base').alias("content"))
    two = pages.where(F.length(first) == 2).select(F.concat_ws("/", host, first, F.lit("tsconfig.json")).alias("path"), F.lit('{"extends": "../tsconfig", "compilerOptions": {"paths": {"@/*": ["lib/*", "../*"],}}}').alias("content"))
    configs = nearest.ts_configs(one.unionByName(two).distinct())
    specs = pages.select(F.lit("").alias("worktree_id"), "path", "page_id", F.explode(F.array(F.lit("@/x"), F.lit("./x"), F.lit("x"))).alias("spec"))
    found = nearest.candidates(specs, configs).groupBy("page_id", "spec").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("c"))
    return found.select("page_id", "spec", F.array_join(F.transform("c", lambda x: x["candidate"]), ",").alias("candidates"))


_PLACE_SQL = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"
_NEAREST_SQL = f"""WITH p AS (SELECT page_id, string_split({_PLACE_SQL} || '/f' || page_id || '.ts', '/') AS l FROM pages)
SELECT page_id, f AS folder, md5(f) AS id FROM (SELECT page_id, CASE WHEN len(l) > 2 AND length(l[2]) = 2 THEN l[1] || '/' || l[2] ELSE l[1] END AS f FROM p)"""
_CANDIDATES_SQL = f"""WITH p AS (SELECT page_id, {_PLACE_SQL} AS dir, string_split({_PLACE_SQL}, '/') AS l FROM pages), q AS (SELECT *, length(coalesce(l[2], '')) = 2 AS deep FROM p)
SELECT page_id, './x' AS spec, dir || '/x' AS candidates FROM q UNION ALL SELECT page_id, 'x', l[1] || '/src/x' FROM q
UNION ALL SELECT page_id, '@/x', CASE WHEN deep THEN l[1] || '/src/lib/x,' || l[1] || '/x,' ELSE '' END || l[1] || '/src/@/x' FROM q"""


def _read_of(keys):
    return lambda wanted: keys.where(F.col("key").isin(*wanted))


def _indexed_importers(spark, d):
    keys = reverse.import_keys(imports.python_edges(q_code._python(spark, d)))
    return reverse.find_importers(_read_of(keys), q_code.HUB[0], limit=1 << 30)[0]


def _backends(spark, d):
    edges = imports.python_edges(q_code._python(spark, d))
    rows = reverse.importers_by_backend(edges, q_code.HUB[0])
    return rows.select("source_file", "backend", F.array_join("backends", ",").alias("backends"))


def _concerned(spark, d):
    """The files whose imports may resolve otherwise if a second module came beside each document's: what the next one asked for in vain."""
    files = q_code._python(spark, d)
    keys = reverse.import_keys(imports.python_edges(files))
    new = files.where(F.col("path").startswith("p_")).select(F.regexp_replace("path", "/d([0-9]+)", "/missing$1").alias("path"), F.lit("").alias("worktree_id"))
    new = new.unionByName(files.select(F.concat(F.regexp_extract("path", "^(p_[^/]*)/", 1), F.lit("/missing.py")).alias("path"), F.lit("").alias("worktree_id")).where("path <> '/missing.py'")).distinct()
    return reverse.concerned(keys, new).select("path")


def _candidates(spark, d):
    """References of the hub's class in the files that import it, and no others."""
    files = q_code._python(spark, d)
    keys = reverse.import_keys(imports.python_edges(files))
    users = reverse.postings(_read_of(keys), q_code.HUB[0])
    wanted = references.candidate_files(files, q_code.HUB[0], users)
    return references.python_references(wanted, "Base", q_code.HUB[0]).select("path", "line", "kind")


def _last_changes(spark, d):
    """Orders are commits of their customers' repositories, and parts the files that they change, up to a day."""
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    files = lines.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("files"))
    commits = orders.join(files, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 10).cast("string").alias("repo_id"), F.col("o_orderdate").alias("ts"), "files")
    return tables.last_changes(commits, "1996-01-01")


QUERIES = {
    "extracted_symbols": _extracted,
    "line_declarations": _declared,
    "merged_symbols": _merged,
    "file_summaries": _summaries,
    "chunk_postings": _postings,
    "nearest_projects": _nearest,
    "path_candidates": _ts_candidates,
    "importers_indexed": _indexed_importers,
    "importer_backends": _backends,
    "concerned_files": _concerned,
    "candidate_references": _candidates,
    "last_changes": _last_changes,
}

ORACLES = {
    "extracted_symbols": f"WITH {_EXTRACTED} SELECT path, symbol AS kind, name, k AS start_line FROM x",
    "line_declarations": f"WITH {_CODE} SELECT path, symbol AS kind, name, parent, k AS start_line FROM {_line_rules()}",
    "merged_symbols": f"""WITH {_EXTRACTED}, a AS (SELECT DISTINCT path, symbol, name, k FROM {_line_rules()})
SELECT path, symbol AS kind, name, k AS start_line, 'scanner' AS origin FROM a UNION ALL SELECT path, symbol, name, k, 'pattern' FROM (SELECT path, symbol, name, k FROM x WHERE path NOT LIKE '%.py' AND path NOT LIKE '%.ts' EXCEPT SELECT * FROM a)""",
    "file_summaries": _SUMMARY_SQL,
    "chunk_postings": _POSTINGS_SQL,
    "nearest_projects": _NEAREST_SQL,
    "path_candidates": _CANDIDATES_SQL,
    "importers_indexed": f"WITH {q_code._FILES} SELECT path AS source_file, 'hub.base' AS via FROM x",
    "importer_backends": f"WITH {q_code._FILES} SELECT path AS source_file, 'python-graph' AS backend, 'python-graph,static' AS backends FROM x",
    "concerned_files": f"WITH {q_code._FILES} SELECT path FROM x",
    "candidate_references": f"""WITH {q_code._FILES} SELECT path, 3 AS line, 'reference' AS kind FROM x UNION ALL SELECT path, 13, 'reference' FROM x UNION ALL SELECT 'hub/base.py', 1, 'declaration'""",
    "last_changes": "SELECT (o_custkey % 10)::VARCHAR AS repo_id, l_partkey::VARCHAR AS path, max(o_orderdate) AS modified FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY ALL",
}
