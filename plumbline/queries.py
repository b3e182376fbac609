"""Queries of the core, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import CALL_KINDS, NOISE_CALLEES, is_test_path, module_key, normalise_callee, receiver_of, tail_of
from plumbline.operators import impact, imports, lookup, overview, rank, resolve, search, structure, traverse
from plumbline.operators.heavy_keys import heavy_keys, key_profile
from plumbline.plans.workspace import Workspace
from plumbline.session import stage
from plumbline.sources.tables import load

FLAGSHIP = "q05_who_calls"

# --- views that the SQL shares -------------------------------------------------------------------
_VIEWS = """f AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, sha256 DESC) AS k FROM files) WHERE k = 1),
    s AS (SELECT DISTINCT * FROM symbols), e AS (SELECT DISTINCT * FROM edges), r AS (SELECT DISTINCT * FROM refs), i AS (SELECT DISTINCT * FROM imports),
    v AS (SELECT s.id, s.name, s.qualname, s.kind, s.lang, f.path, s.start_line, s.end_line, s.signature, s.docstring,
          CASE WHEN s.rank IS NULL OR isnan(s.rank) THEN 0.0 ELSE s.rank END AS rank FROM s JOIN f ON f.id = s.file_id),
    calls AS (SELECT * FROM e WHERE kind IN ('calls', 'instantiates') AND dst_id IS NOT NULL)"""
_TOP_SYMBOL = "(SELECT dst_id FROM calls WHERE confidence >= 0.5 GROUP BY dst_id ORDER BY count(*) DESC, dst_id LIMIT 1)"
_TOP_FILE = "(SELECT f.id FROM f JOIN i ON i.dst_file_id = f.id GROUP BY f.id, f.path ORDER BY count(*) DESC, f.path LIMIT 1)"
_SYMBOL = "id, name, qualname, kind, lang, path, start_line, end_line, signature, docstring, rank"


def _sql(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_VIEWS}{body}"


# --- lookup ---------------------------------------------------------------------------------------
def q01_find_symbols(spark, d):
    return lookup.find_symbols(Workspace(spark, d).arrivals, "load", limit=20)


def q01_find_kind(spark, d):
    return lookup.find_symbols(Workspace(spark, d).arrivals, "Pool", kind="class", lang="python", limit=50)


def _find_sql(name: str, where: str, limit: int) -> str:
    return _sql(f"""
        SELECT {_SYMBOL}, CASE WHEN name = '{name}' OR qualname = '{name}' THEN 0 WHEN qualname ILIKE '%{name}' THEN 1 ELSE 2 END AS tier
        FROM v WHERE (name = '{name}' OR qualname = '{name}' OR name ILIKE '{name}%' OR qualname ILIKE '%{name}') {where}
        ORDER BY tier, rank DESC, length(qualname), qualname, id LIMIT {limit}""")


def q02_search(spark, d):
    return search.search_symbols(Workspace(spark, d).view, "lease ledger:gentle retry_", limit=30)


_SEARCH_SQL = _sql(""",
    w AS (SELECT id, regexp_extract_all(lower(strip_accents(coalesce(name, ''))), '[\\p{L}\\p{N}]+') AS w0, regexp_extract_all(lower(strip_accents(coalesce(qualname, ''))), '[\\p{L}\\p{N}]+') AS w1,
           regexp_extract_all(lower(strip_accents(coalesce(signature, ''))), '[\\p{L}\\p{N}]+') AS w2, regexp_extract_all(lower(strip_accents(coalesce(docstring, ''))), '[\\p{L}\\p{N}]+') AS w3 FROM v),
    l AS (SELECT *, len(w0) + len(w1) + len(w2) + len(w3) AS n FROM w),
    g AS (SELECT count(*) AS docs, sum(n) * 1.0 / count(*) AS average FROM l),
    q AS (SELECT unnest(['lease', 'ledger', 'gentle', 'retry']) AS p),
    t AS (SELECT id, p, n, 8.0 * len(list_filter(w0, lambda x: starts_with(x, p))) + 4.0 * len(list_filter(w1, lambda x: starts_with(x, p)))
            + 2.0 * len(list_filter(w2, lambda x: starts_with(x, p))) + 1.0 * len(list_filter(w3, lambda x: starts_with(x, p))) AS tf FROM l, q),
    h AS (SELECT * FROM t WHERE tf > 0),
    d AS (SELECT p, CASE WHEN count(*) * 2 < (SELECT docs FROM g) THEN ln(((SELECT docs FROM g) - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM h GROUP BY p),
    b AS (SELECT h.id, sum(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT average FROM g)))) AS bm FROM h JOIN d USING (p) GROUP BY h.id)
    SELECT v.*, round(bm - 3.0 * rank, 9) AS score FROM v JOIN b USING (id) ORDER BY score, id LIMIT 30""")


def q03_resolve_path_name(spark, d):
    w = Workspace(spark, d)
    return lookup.resolve_selector(w.view, w.top_file() + ":e", limit=5)


_RESOLVE_SQL = _sql(f"""
    SELECT v.* FROM v WHERE path = (SELECT path FROM f WHERE id = {_TOP_FILE}) AND (name = 'e' OR qualname ILIKE '%e') ORDER BY rank DESC, id LIMIT 5""")


def srt_match_files(spark, d):
    return lookup.match_files(Workspace(spark, d).files, "vendor/").select("id", "path", "lang", "module", "lines")


def flt_members(spark, d):
    return lookup.members(Workspace(spark, d).symbols)


def src_symbol_source(spark, d):
    """The source of every symbol."""
    w = Workspace(spark, d)
    return lookup.symbol_source(w.symbols, w.texts)


# --- traversal ------------------------------------------------------------------------------------
def _walk(spark, d, direction: str):
    w = Workspace(spark, d)
    return traverse.neighbours(w.view, w.calls, w.top_symbol(), direction, 3, 0.4, 200)


def q05_who_calls(spark, d):
    return _walk(spark, d, "callers")


def q06_what_it_calls(spark, d):
    return _walk(spark, d, "callees")


def q05_all_callers(spark, d):
    """The callers, up to two calls away, of every symbol, all roots in one plan: a root without rows has no callers."""
    w = Workspace(spark, d)
    return traverse.walk(w.calls, w.symbols.select(F.col("id").alias("root")), "callers", 2, 0.3)


def _walk_sql(near: str, far: str) -> str:
    return _sql(f""",
        u AS (SELECT * FROM calls WHERE confidence >= 0.4),
        w(id, depth, confidence, line, reason) AS (
            SELECT {far}, 1, confidence, line, reason FROM u WHERE {near} = {_TOP_SYMBOL}
            UNION SELECT u.{far}, w.depth + 1, least(w.confidence, u.confidence), u.line, u.reason FROM w JOIN u ON u.{near} = w.id WHERE w.depth < 3),
        a AS (SELECT id, min(depth) AS depth, max(confidence) AS confidence, min(line) AS via_line, min(reason) AS reason FROM w WHERE id <> {_TOP_SYMBOL} GROUP BY id)
        SELECT v.*, depth, confidence, via_line, reason FROM v JOIN a USING (id) ORDER BY depth, rank DESC, qualname, id LIMIT 200""", True)


_ALL_CALLERS_SQL = _sql(""",
    u AS (SELECT * FROM calls WHERE confidence >= 0.3),
    w AS (SELECT dst_id AS root, src_id AS id, 1 AS depth, confidence AS c, line, reason FROM u
          UNION ALL SELECT a.dst_id, b.src_id, 2, least(a.confidence, b.confidence), b.line, b.reason FROM u a JOIN u b ON b.dst_id = a.src_id)
    SELECT root, id, min(depth) AS depth, max(c) AS confidence, min(line) AS via_line, min(reason) AS reason FROM w
    WHERE id <> root AND root IN (SELECT id FROM s) GROUP BY root, id""")


def q07_dependent_files(spark, d):
    w = Workspace(spark, d)
    return traverse.dependent_files(w.files, w.imports, w.top_file(), 4, 500)


_DEPENDENTS_SQL = _sql(f""",
    w(id, depth) AS (SELECT file_id, 1 FROM i WHERE dst_file_id = {_TOP_FILE} UNION SELECT i.file_id, w.depth + 1 FROM w JOIN i ON i.dst_file_id = w.id WHERE w.depth < 4),
    a AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
    SELECT path, depth, is_test FROM f JOIN a USING (id) WHERE id <> {_TOP_FILE} ORDER BY depth, is_test DESC, path LIMIT 500""", True)


def q07_all_dependents(spark, d):
    w = Workspace(spark, d)
    return traverse.dependents(w.imports, w.files.select(F.col("id").alias("root")), 3)


_ALL_DEPENDENTS_SQL = _sql(""",
    p AS (SELECT DISTINCT file_id AS a, dst_file_id AS b FROM i WHERE dst_file_id IS NOT NULL),
    w AS (SELECT b AS root, a AS id, 1 AS depth FROM p UNION ALL SELECT x.b, y.a, 2 FROM p x JOIN p y ON y.b = x.a
          UNION ALL SELECT x.b, z.a, 3 FROM p x JOIN p y ON y.b = x.a JOIN p z ON z.b = y.a)
    SELECT root, id, min(depth) AS depth FROM w WHERE id <> root AND root IN (SELECT id FROM f) GROUP BY root, id""")


# --- impact ---------------------------------------------------------------------------------------
def q08_blast_file(spark, d):
    w = Workspace(spark, d)
    return impact.outside_callers(w.view, w.edges, _called_file(w), 0.3, 60)


def _blast(spark, d, target) -> DataFrame:
    """Files and tests of an impact in one table: part, path, depth."""
    w = Workspace(spark, d)
    found = impact.blast_radius(w.view, w.files, w.imports, w.calls, target(w), 3, 0.3, 60)
    return found.files.select(F.lit("file").alias("part"), "path", "depth").unionByName(found.tests.select(F.lit("test").alias("part"), "path", F.lit(0).alias("depth")))


def q08_blast_file_reach(spark, d):
    return _blast(spark, d, lambda w: w.top_file())


def q08_blast_symbol_reach(spark, d):
    return _blast(spark, d, lambda w: str(w.top_symbol()))


def _called_file(w: Workspace) -> str:
    root = w.top_symbol()
    return w.view.where(F.col("id") == root).first()["path"]


_BLAST_FILE_SQL = _sql(f""",
    own AS (SELECT id AS target, path, start_line AS target_line FROM v WHERE path = (SELECT path FROM v WHERE id = {_TOP_SYMBOL}) ORDER BY start_line, id LIMIT 40),
    c AS (SELECT target, own.path AS own_path, target_line, src_id AS id, max(confidence) AS confidence, min(line) AS via_line, min(reason) AS reason
          FROM calls JOIN own ON dst_id = target WHERE confidence >= 0.3 AND src_id <> target GROUP BY ALL),
    t AS (SELECT v.*, 1 AS depth, confidence, via_line, reason, target, target_line, own_path, row_number() OVER (PARTITION BY target ORDER BY rank DESC, qualname, id) AS k FROM v JOIN c USING (id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, target_line, target) AS j FROM t WHERE k <= 10 AND path <> own_path)
    SELECT {_SYMBOL}, depth, confidence, via_line, reason FROM o WHERE j = 1 ORDER BY confidence DESC, qualname, id LIMIT 60""")


def q08_blast_symbol(spark, d):
    w = Workspace(spark, d)
    return impact.blast_radius(w.view, w.files, w.imports, w.calls, str(w.top_symbol()), 3, 0.3, 60).symbols


_BLAST_SYMBOL_SQL = _walk_sql("dst_id", "src_id").replace("confidence >= 0.4", "confidence >= 0.3").replace("LIMIT 200", "LIMIT 60")


_BLAST_FILE_REACH_SQL = _DEPENDENTS_SQL.replace("w.depth < 4", "w.depth < 3").replace("LIMIT 500", "LIMIT 60")
_BLAST_FILE_REACH_SQL = f"""SELECT 'file' AS part, path, depth FROM ({_BLAST_FILE_REACH_SQL}) UNION ALL SELECT DISTINCT 'test', path, 0 FROM ({_BLAST_FILE_REACH_SQL}) WHERE is_test"""
_IS_TEST = r"(regexp_matches(path, '(^|/)(test|spec|__tests__|fixtures)/') OR regexp_matches(regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', ''), '^test_|_test$|\.test$|\.spec$|_spec$'))"
_TOUCHED = f"SELECT DISTINCT path FROM ({_BLAST_SYMBOL_SQL}) WHERE path <> (SELECT path FROM ({_sql(f'SELECT path FROM v WHERE id = {_TOP_SYMBOL}')}))"
_BLAST_SYMBOL_REACH_SQL = f"SELECT 'file' AS part, path, 1 AS depth FROM ({_TOUCHED}) UNION ALL SELECT 'test', path, 0 FROM ({_TOUCHED}) WHERE {_IS_TEST}"


# --- overviews ------------------------------------------------------------------------------------
def agg_counts(spark, d):
    w = Workspace(spark, d)
    return overview.counts(w.files, w.symbols, w.edges, w.imports, w.refs)


def agg_by_kind(spark, d):
    return overview.counts_by(Workspace(spark, d).symbols, "kind")


def agg_by_lang(spark, d):
    return overview.counts_by(Workspace(spark, d).files, "lang")


def agg_edge_reasons(spark, d):
    return overview.counts_by(Workspace(spark, d).edges, "reason")


def agg_modules(spark, d):
    w = Workspace(spark, d)
    return overview.modules(w.files, w.symbols)


def agg_module_edges(spark, d):
    w = Workspace(spark, d)
    return overview.module_edges(w.files, w.imports)


def q10_import_list(spark, d):
    w = Workspace(spark, d)
    path = w.files.join(w.imports.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n")), "id").orderBy(F.desc("n"), "path").first()["path"]
    return overview.import_list(w.files, w.imports, path)


_IMPORT_LIST_SQL = _sql("""
    SELECT i.id, i.module, t.path AS target, i.external, i.line FROM i LEFT JOIN f t ON t.id = i.dst_file_id
    WHERE i.file_id = (SELECT f.id FROM f JOIN i ON i.file_id = f.id GROUP BY f.id, f.path ORDER BY count(*) DESC, f.path LIMIT 1) ORDER BY i.line, i.id""")


def q12_hotspots(spark, d):
    w = Workspace(spark, d)
    return overview.hotspots(w.view, w.edges, 20)


def q13_entry_points(spark, d):
    w = Workspace(spark, d)
    return overview.entry_points(w.view, w.symbols, w.edges, 20)


def q14_stats(spark, d):
    return overview.resolution(Workspace(spark, d).edges)


# --- ranking and structure ------------------------------------------------------------------------
def _call_links(w: Workspace):
    return w.edges.where(F.col("kind").isin(*CALL_KINDS) & F.col("dst_id").isNotNull()).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("confidence").alias("weight"))


def ga1_pagerank(spark, d):
    """The ranks with the operator's own settings: at most 30 rounds, until they no longer change by 1e-7 in all."""
    w = Workspace(spark, d)
    return rank.pagerank(_call_links(w), w.symbols.select("id")).withColumn("score", F.round("score", 10))


def _pagerank_sql(rounds: int) -> str:
    steps = [f"""k0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM n) AS score, id NOT IN (SELECT src FROM p) AS loose FROM n)"""]
    for k in range(1, rounds + 1):
        steps.append(f"""k{k} AS MATERIALIZED (SELECT k.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(score), 0) FROM k{k - 1} WHERE loose) / (SELECT count(*) FROM n)) AS score, k.loose
            FROM k{k - 1} k LEFT JOIN (SELECT dst, sum(p * score) AS got FROM p JOIN k{k - 1} ON src = id GROUP BY dst) g ON g.dst = k.id)""")
    moved = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.score - b.score)) AS moved FROM k{k} a JOIN k{k - 1} b USING (id)" for k in range(1, rounds + 1))
    steps.append(f"stop AS MATERIALIZED (SELECT coalesce(min(k) FILTER (moved < 1e-7), {rounds}) AS k FROM ({moved}))")
    last = " UNION ALL ".join(f"SELECT id, score FROM k{k} WHERE {k} = (SELECT k FROM stop)" for k in range(1, rounds + 1))
    return _sql(f""",
        n AS MATERIALIZED (SELECT DISTINCT id FROM s),
        c AS (SELECT src_id AS src, dst_id AS dst, sum(greatest(confidence, 1e-6)) AS w FROM calls WHERE src_id <> dst_id AND src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n) GROUP BY 1, 2),
        p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM c), {', '.join(steps)}
        SELECT id, round(score, 10) AS score FROM ({last})""")


def q09_related(spark, d):
    w = Workspace(spark, d)
    return rank.related(w.view, w.edges, w.top_symbol(), 15).withColumn("score", F.round("score", 9))


def _related_sql() -> str:
    steps = [f"k0 AS MATERIALIZED (SELECT {_TOP_SYMBOL} AS id, 1.0 AS score)"]
    for k in range(1, 21):
        steps.append(f"""k{k} AS MATERIALIZED (SELECT id, sum(x) AS score FROM (SELECT dst AS id, 0.7 * score * p AS x FROM k{k - 1} JOIN p ON src = k{k - 1}.id UNION ALL SELECT {_TOP_SYMBOL}, 0.3) GROUP BY id)""")
    return _sql(f""",
        b AS (SELECT src_id AS src, dst_id AS dst, greatest(confidence, 1e-6) AS w FROM calls UNION ALL SELECT dst_id, src_id, greatest(confidence, 1e-6) FROM calls),
        c AS (SELECT src, dst, sum(w) AS w FROM b GROUP BY src, dst), p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM c), {', '.join(steps)}
        SELECT v.*, round(score, 9) AS score FROM v JOIN (SELECT id, round(score, 12) AS score FROM k20 WHERE id <> {_TOP_SYMBOL} ORDER BY 2 DESC, id LIMIT 30) x USING (id) ORDER BY x.score DESC, id LIMIT 15""")


def _links(w: Workspace):
    return overview.module_edges(w.files, w.imports).select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))


def _folder_links(w: Workspace, parts: int):
    """Which folder imports from which, at a depth of the tree where they do so both ways."""
    folder = F.array_join(F.slice(F.split("path", "/"), 1, parts), "/")
    at = w.files.select("id", folder.alias("folder"))
    pairs = w.imports.where("dst_file_id IS NOT NULL").select("file_id", "dst_file_id").distinct()
    return (
        pairs.join(at.selectExpr("id AS file_id", "folder AS src"), "file_id").join(at.selectExpr("id AS dst_file_id", "folder AS dst"), "dst_file_id")
        .where("src <> dst").select("src", "dst").distinct()
    )


def ga3_components(spark, d):
    return structure.strongly_connected(_folder_links(Workspace(spark, d), 2))


def ga3_repository_components(spark, d):
    return structure.strongly_connected(_folder_links(Workspace(spark, d), 1))


def _folder_links_sql(parts: int) -> str:
    folder = lambda t: f"array_to_string(string_split({t}.path, '/')[1:{parts}], '/')"
    return f"m AS MATERIALIZED (SELECT DISTINCT {folder('a')} AS src, {folder('b')} AS dst FROM i JOIN f a ON a.id = i.file_id JOIN f b ON b.id = i.dst_file_id WHERE {folder('a')} <> {folder('b')})"


_NAME_LINKS = "m AS MATERIALIZED (SELECT DISTINCT a.name AS src, b.name AS dst FROM calls JOIN s a ON a.id = src_id JOIN s b ON b.id = dst_id)"
_MODULE_LINKS = """m AS MATERIALIZED (SELECT DISTINCT a.module AS src, b.module AS dst FROM i JOIN f a ON a.id = i.file_id JOIN f b ON b.id = i.dst_file_id WHERE a.module <> b.module)"""
_COMPONENTS = """,
    __LINKS__,
    reach(a, b) AS (SELECT src, dst FROM m WHERE src <> dst UNION SELECT reach.a, m.dst FROM reach JOIN m ON m.src = reach.b WHERE m.src <> m.dst),
    c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component, count(*) AS n FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a)
    SELECT node, component, n + 1 AS size FROM c"""
_COMPONENTS_SQL = _sql(_COMPONENTS.replace("__LINKS__", _folder_links_sql(2)), True)
_REPOSITORY_COMPONENTS_SQL = _sql(_COMPONENTS.replace("__LINKS__", _folder_links_sql(1)), True)


def _name_links(w: Workspace):
    """Which name calls which, over all symbols of a name."""
    named = w.symbols.select("id", "name")
    pairs = w.edges.where(F.col("kind").isin(*CALL_KINDS) & F.col("dst_id").isNotNull()).select("src_id", "dst_id").distinct()
    return pairs.join(named.selectExpr("id AS src_id", "name AS src"), "src_id").join(named.selectExpr("id AS dst_id", "name AS dst"), "dst_id").select("src", "dst").distinct()


def ga4_name_layers(spark, d):
    return structure.layers(_name_links(Workspace(spark, d)))



def q15_cycles(spark, d):
    return structure.cycles(_folder_links(Workspace(spark, d), 2)).select("component", "size", F.array_join("members", " ").alias("members"))


_CYCLES_SQL = f"SELECT component, size, string_agg(node, ' ' ORDER BY node) AS members FROM ({_COMPONENTS_SQL}) GROUP BY component, size ORDER BY size DESC, component"


def ga4_layers(spark, d):
    return structure.layers(_links(Workspace(spark, d)))


_LAYERS = """,
    __LINKS__,
    reach(a, b) AS (SELECT src, dst FROM m UNION SELECT reach.a, m.dst FROM reach JOIN m ON m.src = reach.b),
    looped AS (SELECT DISTINCT a AS node FROM reach WHERE a = b), behind AS (SELECT node FROM looped UNION SELECT b FROM reach JOIN looped ON a = node),
    steps(node, layer) AS (SELECT node, 0 FROM (SELECT src AS node FROM m UNION SELECT dst FROM m)
        UNION SELECT m.dst, steps.layer + 1 FROM steps JOIN m ON m.src = steps.node WHERE steps.node NOT IN (SELECT node FROM behind))
    SELECT node, max(layer) AS layer FROM steps GROUP BY node"""
_LAYERS_SQL = _sql(_LAYERS.replace("__LINKS__", _MODULE_LINKS), True)
_NAME_LAYERS_SQL = _sql(_LAYERS.replace("__LINKS__", _NAME_LINKS), True)


# --- resolution -----------------------------------------------------------------------------------
def res_imports(spark, d):
    w = Workspace(spark, d)
    return imports.resolve_imports(w.imports, w.files)


_RES_IMPORTS = """,
    mm AS MATERIALIZED (SELECT module, max(path) AS path FROM f WHERE module IS NOT NULL GROUP BY module),
    ask AS (SELECT i.id, f.lang, f.path, f.module AS own, coalesce(i.module, '') AS m, i.symbol, regexp_replace(coalesce(i.module, ''), '^\\.+', '') AS rest FROM i JOIN f ON f.id = i.file_id),
    py AS (SELECT *, length(m) - length(rest) AS dots, string_split(own, '.') AS parts FROM ask),
    py2 AS (SELECT *, CASE WHEN dots <= len(parts) THEN array_to_string(parts[1:len(parts) - dots + 1], '.') ELSE '' END AS base FROM py),
    walk AS (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(regexp_replace(path, '/[^/]*$', '') || '/' || m, '/'), lambda x: [x])),
        lambda acc, y: CASE WHEN y[1] IN ('', '.') THEN acc WHEN y[1] = '..' THEN acc[1:len(acc) - 1] ELSE acc || y END) AS steps FROM py2),
    tgt AS MATERIALIZED (SELECT id, lang, symbol, CASE WHEN lang = 'python' THEN '.' ELSE '/' END AS sep,
        CASE WHEN lang = 'python' THEN CASE WHEN starts_with(m, '.') THEN CASE WHEN rest = '' THEN base WHEN base = '' THEN rest ELSE base || '.' || rest END ELSE m END
             WHEN lang = 'go' THEN m WHEN starts_with(m, '.') THEN array_to_string(steps, '/') WHEN regexp_matches(m, '^[@~#]/') THEN substr(m, 3) END AS target FROM walk),
    sx AS (SELECT sep, path, k, n, CASE WHEN sep = '.' THEN array_to_string(p[k:n], '.') ELSE array_to_string(p[k:n], '/') END AS suffix FROM (SELECT sep, path, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS k
        FROM (SELECT '.' AS sep, path, string_split(module, '.') AS p FROM mm UNION ALL SELECT '/', path, string_split(module, '/') FROM mm))),
    s1 AS (SELECT sep, suffix, max(path) AS path FROM sx WHERE k > 1 GROUP BY sep, suffix HAVING count(*) = 1),
    s2 AS (SELECT sep, suffix, max(path) AS path FROM sx WHERE k = n GROUP BY sep, suffix HAVING count(*) = 1),
    hit AS (SELECT t.id, coalesce(CASE WHEN lang = 'python' THEN coalesce(a.path, b.path) WHEN lang <> 'go' THEN coalesce(b.path, c.path) END, s1.path, s2.path) AS path
        FROM tgt t LEFT JOIN mm a ON a.module = t.target || '.' || t.symbol LEFT JOIN mm b ON b.module = t.target LEFT JOIN mm c ON c.module = t.target || '/index'
        LEFT JOIN s1 ON s1.sep = t.sep AND s1.suffix = t.target LEFT JOIN s2 ON s2.sep = t.sep AND s2.suffix = list_last(string_split(t.target, t.sep)) WHERE t.target <> '')"""
_RES_IMPORTS_SQL = _sql(f"""{_RES_IMPORTS}
    SELECT tgt.id, f.id AS dst_file_id, f.id IS NULL AS external FROM tgt LEFT JOIN hit USING (id) LEFT JOIN f ON f.path = hit.path""")


def res_references(spark, d):
    w = Workspace(spark, d)
    return resolve.resolve_references(w.refs, w.symbols, w.files, w.imports).withColumn("confidence", F.round("confidence", 9))


_RES_REFS_SQL = _sql(""",
    sy AS MATERIALIZED (SELECT s.id, s.file_id, s.name, s.qualname, s.kind, f.module, p.name AS parent, s.kind IN ('class', 'interface', 'struct', 'enum', 'type') AS typ FROM s JOIN f ON f.id = s.file_id LEFT JOIN s p ON p.id = s.parent_id),
    own AS (SELECT file_id, substr(qualname, instr(qualname, ':') + 1) AS src_local, max(id) AS src_id FROM sy GROUP BY 1, 2),
    al AS (SELECT * FROM (SELECT file_id, coalesce(alias, symbol) AS key, dst_file_id AS dst, symbol AS sym, row_number() OVER (PARTITION BY file_id, coalesce(alias, symbol) ORDER BY id DESC) AS k FROM i WHERE coalesce(alias, symbol) IS NOT NULL) WHERE k = 1),
    ext AS (SELECT DISTINCT file_id, word FROM (SELECT file_id, unnest([coalesce(alias, symbol), symbol, split_part(split_part(module, '.', 1), '/', 1)]) AS word FROM i WHERE external) WHERE word <> ''),
    base AS MATERIALIZED (SELECT r.id AS ref_id, r.file_id, own.src_id, r.dst_name, r.kind, r.line, f.module, list_last(string_split(r.dst_name, '.')) AS tail, split_part(r.dst_name, '.', 1) AS root,
        CASE WHEN contains(r.dst_name, '.') THEN regexp_replace(r.dst_name, '\\.[^.]*$', '') END AS recv, CASE WHEN contains(r.src_local, '.') THEN regexp_replace(r.src_local, '\\.[^.]*$', '') END AS owner
        FROM r JOIN own USING (file_id, src_local) JOIN f ON f.id = r.file_id),
    cand AS (SELECT b.*, list_last(string_split(b.recv, '.')) AS rt, sy.id AS cid, sy.qualname AS q, sy.kind AS ckind, sy.file_id AS cfile, sy.module AS cmod, sy.parent AS cpar,
        b.kind = 'calls' OR sy.typ OR NOT bool_or(sy.typ) OVER (PARTITION BY b.ref_id) AS g FROM base b JOIN sy ON sy.name = b.tail),
    tiered AS (SELECT c.*, CASE WHEN g AND cfile = c.file_id THEN 10 WHEN g AND cfile = ar.dst THEN 20 WHEN cpar = ar.sym AND cfile = ar.dst THEN 21 WHEN g AND cfile = tl.dst THEN 22 WHEN cpar = tl.sym AND cfile = tl.dst THEN 23
        WHEN cpar = rt AND rt IN (SELECT name FROM sy WHERE kind IN ('class', 'interface', 'struct', 'enum')) THEN 30 WHEN rt IN ('self', 'this', 'cls') AND cpar = owner THEN 31
        WHEN g AND cmod = c.module THEN 40 WHEN g THEN 50 END AS tier
        FROM cand c LEFT JOIN al ar ON ar.file_id = c.file_id AND ar.key = c.recv LEFT JOIN al tl ON tl.file_id = c.file_id AND tl.key = c.tail),
    best AS (SELECT *, min(tier) OVER (PARTITION BY ref_id) AS t, count(*) FILTER (g) OVER (PARTITION BY ref_id) AS n FROM tiered),
    pick AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN t = 50 THEN CASE WHEN ckind = 'function' THEN 0 ELSE 1 END ELSE length(q) END, q, cid) AS k FROM best WHERE tier = t)
    SELECT ref_id, src_id, cid AS dst_id, dst_name, kind, line,
        round(CASE WHEN t = 10 THEN 0.95 WHEN t < 30 THEN 0.9 WHEN t < 40 THEN 0.85 WHEN t = 40 THEN 0.75 WHEN n = 1 THEN CASE WHEN recv IS NULL THEN 0.6 ELSE 0.45 END ELSE least(0.4, 1.0 / n) END, 9) AS confidence,
        CASE WHEN t = 10 THEN 'same-file' WHEN t < 30 THEN 'import' WHEN t < 40 THEN 'receiver-type' WHEN t = 40 THEN 'same-module' WHEN n = 1 THEN CASE WHEN recv IS NULL THEN 'unique-global' ELSE 'name-only' END ELSE 'ambiguous' END AS reason
    FROM pick WHERE k = 1 OR (t = 50 AND k <= 3)
    UNION ALL
    SELECT ref_id, src_id, NULL, dst_name, kind, line, 0.0, CASE WHEN EXISTS (SELECT 1 FROM ext WHERE ext.file_id = b.file_id AND ext.word IN (b.root, b.tail)) THEN 'external' ELSE 'unresolved' END
    FROM base b WHERE tail NOT IN (SELECT name FROM sy WHERE name IS NOT NULL)""")


# --- facts ----------------------------------------------------------------------------------------
def ext_clean_refs(spark, d):
    """References as the extractor keeps them: distinct, at most 20,000 a file, callees normalised, noise dropped."""
    raw = load(spark, d, "refs").where("id IS NOT NULL").groupBy("file_id", "src_local", "dst_name", "kind", "line").agg(F.min("id").alias("id"))
    name = normalise_callee(F.col("dst_name"))
    return raw.withColumn("dst_name", name).where((F.col("dst_name") != "") & ~tail_of(F.col("dst_name")).isin(*NOISE_CALLEES)).select(
        "id", "file_id", "src_local", "dst_name", tail_of(F.col("dst_name")).alias("tail"), receiver_of(F.col("dst_name")).alias("receiver"), "kind", "line"
    )


_CLEAN_REFS_SQL = f"""
    WITH a AS (SELECT file_id, src_local, dst_name AS raw, kind, line, min(id) AS id FROM refs GROUP BY ALL),
    b AS (SELECT id, file_id, src_local, kind, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(raw, '<', 1), '\\s+', '', 'g'), '\\?$', ''), '^\\(', ''), '\\)$', '') AS dst_name FROM a)
    SELECT id, file_id, src_local, dst_name, list_last(string_split(dst_name, '.')) AS tail, CASE WHEN contains(dst_name, '.') THEN regexp_replace(dst_name, '\\.[^.]*$', '') END AS receiver, kind, line
    FROM b WHERE dst_name <> '' AND list_last(string_split(dst_name, '.')) NOT IN ({', '.join(repr(x) for x in NOISE_CALLEES)})"""


def src_path_facts(spark, d):
    w = Workspace(spark, d)
    p = F.col("path")
    return w.files.select("id", is_test_path(p).alias("test_path"), module_key(p, F.col("lang")).alias("key"))


_PATH_FACTS_SQL = _sql(r"""
    SELECT id, regexp_matches(path, '(^|/)(test|spec|__tests__|fixtures)/') OR regexp_matches(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', ''), '^test_|_test$|\.test$|\.spec$|_spec$') AS test_path,
        CASE WHEN lang = 'python' THEN replace(regexp_replace(regexp_replace(path, '\.[^./]*$', ''), '(.)/__init__$', '\1'), '/', '.')
             WHEN lang = 'go' THEN CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END
             ELSE regexp_replace(regexp_replace(path, '(\.d)?\.[^./]*$', ''), '(.)/index$', '\1') END AS key FROM f""")


def inc_delta(spark, d):
    """What an incremental run would do, from the oldest state of all files to the latest one without tests."""
    from plumbline.plans.delta import classify

    rows = load(spark, d, "files")
    old = rows.groupBy("id").agg(F.min(F.struct("indexed_at", "sha256", "path")).alias("m")).select(F.col("m.path").alias("path"), F.col("m.sha256").alias("sha256"), "id")
    return classify(old.select("path", "sha256"), Workspace(spark, d).files.where("NOT is_test").select("path", "sha256"))


_DELTA_SQL = _sql("""
    , o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at, sha256, path) AS k FROM files) WHERE k = 1), n AS (SELECT * FROM f WHERE NOT is_test)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'changed' END AS state
    FROM o FULL JOIN n ON o.path = n.path""")


# --- heavy keys -----------------------------------------------------------------------------------
def p5_found(spark, d):
    found = [
        heavy_keys(load(spark, d, table), key, "id", "kind").select(F.lit(table).alias("table_name"), F.col("key").alias("key_name"))
        for table, key in (("edges", "dst_name"), ("symbols", "name"))
    ]
    return found[0].unionByName(found[1])


def p5_edge_keys(spark, d):
    return key_profile(load(spark, d, "edges"), "dst_name", "reason", "line", "id")


def p5_symbol_keys(spark, d):
    return key_profile(load(spark, d, "symbols"), "name", "kind", "start_line", "id")


def _profile_sql(table: str, key: str, category: str, number: str) -> str:
    return f"""
        WITH r AS (SELECT DISTINCT id, {key} AS k, {category} AS c, {number} AS v FROM {table}),
        a AS (SELECT k, count(*) AS n, count(DISTINCT c) AS n_c FROM r GROUP BY k),
        m AS (SELECT k, c FROM (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, c) AS o FROM r WHERE c IS NOT NULL GROUP BY k, c) WHERE o = 1),
        q AS (SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS o, count(*) OVER (PARTITION BY k) AS z FROM r WHERE v IS NOT NULL)
              WHERE o = greatest(1, CAST(ceil(z * 0.5) AS BIGINT)))
        SELECT a.k AS {key}, a.n AS n, a.n_c AS n_{category}, m.c AS mode_{category}, CAST(q.v AS BIGINT) AS p_{number}
        FROM a LEFT JOIN m ON a.k IS NOT DISTINCT FROM m.k LEFT JOIN q ON a.k IS NOT DISTINCT FROM q.k"""


def agg12_resolution_report(spark, d):
    w = Workspace(spark, d)
    edges = stage(resolve.resolve_references(w.refs, w.symbols, w.files, w.imports), "report-edges")
    return resolve.resolution_report(w.refs, edges)


_REPORT_SQL = f"""
    WITH x AS MATERIALIZED ({_RES_REFS_SQL})
    SELECT reason, count(*) AS n FROM x GROUP BY reason
    UNION ALL SELECT 'module-level', count(*) FROM (SELECT DISTINCT id FROM refs) WHERE id NOT IN (SELECT ref_id FROM x)"""


def _counts_by_sql(table: str, column: str) -> str:
    return _sql(f"SELECT coalesce({column}, 'None') AS key, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, key")


QUERIES = {
    "p5_found": p5_found,
    "p5_edge_keys": p5_edge_keys,
    "p5_symbol_keys": p5_symbol_keys,
    "q01_find_symbols": q01_find_symbols,
    "q01_find_kind": q01_find_kind,
    "q02_search": q02_search,
    "q03_resolve_path_name": q03_resolve_path_name,
    "srt6_match_files": srt_match_files,
    "flt9_members": flt_members,
    "src11_symbol_source": src_symbol_source,
    "q05_who_calls": q05_who_calls,
    "q05_all_callers": q05_all_callers,
    "q06_what_it_calls": q06_what_it_calls,
    "q07_dependent_files": q07_dependent_files,
    "q07_all_dependents": q07_all_dependents,
    "q08_blast_file": q08_blast_file,
    "q08_blast_symbol": q08_blast_symbol,
    "q08_blast_file_reach": q08_blast_file_reach,
    "q08_blast_symbol_reach": q08_blast_symbol_reach,
    "agg1_counts": agg_counts,
    "agg2_by_kind": agg_by_kind,
    "agg2_by_lang": agg_by_lang,
    "agg3_edge_reasons": agg_edge_reasons,
    "agg4_modules": agg_modules,
    "agg5_module_edges": agg_module_edges,
    "q10_import_list": q10_import_list,
    "q12_hotspots": q12_hotspots,
    "q13_entry_points": q13_entry_points,
    "q14_stats": q14_stats,
    "q09_related": q09_related,
    "q15_cycles": q15_cycles,
    "ga1_pagerank": ga1_pagerank,
    "ga3_components": ga3_components,
    "ga3_repository_components": ga3_repository_components,
    "ga4_layers": ga4_layers,
    "ga4_name_layers": ga4_name_layers,
    "res1_imports": res_imports,
    "res6_references": res_references,
    "agg12_resolution_report": agg12_resolution_report,
    "ext8_clean_refs": ext_clean_refs,
    "src8_path_facts": src_path_facts,
    "inc1_delta": inc_delta,
}

ORACLES = {
    "p5_found": """
        SELECT 'edges' AS table_name, dst_name AS key_name FROM edges GROUP BY dst_name
        HAVING count(DISTINCT id) >= 0.01 * (SELECT count(DISTINCT id) FROM edges)
        UNION ALL
        SELECT 'symbols', name FROM symbols GROUP BY name
        HAVING count(DISTINCT id) >= 0.01 * (SELECT count(DISTINCT id) FROM symbols)""",
    "p5_edge_keys": _profile_sql("edges", "dst_name", "reason", "line"),
    "p5_symbol_keys": _profile_sql("symbols", "name", "kind", "start_line"),
    "q01_find_symbols": _find_sql("load", "", 20),
    "q01_find_kind": _find_sql("Pool", "AND kind = 'class' AND lang = 'python'", 50),
    "q02_search": _SEARCH_SQL,
    "q03_resolve_path_name": _RESOLVE_SQL,
    "srt6_match_files": _sql("SELECT id, path, lang, module, lines FROM f WHERE path = 'vendor/' OR path ILIKE '%vendor/%' ORDER BY length(path), path LIMIT 20"),
    "flt9_members": _sql(r"""
        SELECT o.id AS owner_id, c.id FROM s c JOIN s o ON o.file_id = c.file_id AND o.qualname = regexp_replace(c.qualname, '\.[^.:]*$', '')
        WHERE contains(list_last(string_split(c.qualname, ':')), '.')"""),
    "src11_symbol_source": _sql(""",
        t AS (SELECT file_id, max(text) AS text FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY file_id)
        SELECT s.id, array_to_string(string_split(t.text, chr(10))[greatest(1, start_line):end_line], chr(10)) AS source FROM s LEFT JOIN t USING (file_id)"""),
    "q05_who_calls": _walk_sql("dst_id", "src_id"),
    "q05_all_callers": _ALL_CALLERS_SQL,
    "q06_what_it_calls": _walk_sql("src_id", "dst_id"),
    "q07_dependent_files": _DEPENDENTS_SQL,
    "q07_all_dependents": _ALL_DEPENDENTS_SQL,
    "q08_blast_file": _BLAST_FILE_SQL,
    "q08_blast_symbol": _BLAST_SYMBOL_SQL,
    "q08_blast_file_reach": _BLAST_FILE_REACH_SQL,
    "q08_blast_symbol_reach": _BLAST_SYMBOL_REACH_SQL,
    "agg1_counts": _sql("""
        SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM i) AS imports, (SELECT count(*) FROM r) AS refs,
            (SELECT count(dst_id) FROM e) AS resolved_edges, (SELECT count(*) FROM e WHERE reason = 'external') AS external_edges, (SELECT CAST(coalesce(sum(lines), 0) AS BIGINT) FROM f) AS lines"""),
    "agg2_by_kind": _counts_by_sql("s", "kind"),
    "agg2_by_lang": _counts_by_sql("f", "lang"),
    "agg3_edge_reasons": _counts_by_sql("e", "reason"),
    "agg4_modules": _sql("SELECT module, count(DISTINCT f.id) AS files, count(s.id) AS symbols FROM f LEFT JOIN s ON s.file_id = f.id GROUP BY module"),
    "agg5_module_edges": _sql("SELECT a.module AS src_module, b.module AS dst_module, count(*) AS weight FROM i JOIN f a ON a.id = i.file_id JOIN f b ON b.id = i.dst_file_id WHERE a.module <> b.module GROUP BY 1, 2"),
    "q10_import_list": _IMPORT_LIST_SQL,
    "q12_hotspots": _sql("""
        SELECT id, qualname, kind, path, rank, (SELECT count(*) FROM e WHERE e.dst_id = v.id) AS fan_in FROM v ORDER BY rank DESC, fan_in DESC, id LIMIT 20"""),
    "q13_entry_points": _sql("""
        SELECT id, qualname, kind, path, rank FROM v WHERE id IN (SELECT id FROM s WHERE exported AND kind IN ('function', 'class'))
            AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst_id = v.id) AND EXISTS (SELECT 1 FROM e WHERE e.src_id = v.id) ORDER BY rank DESC, qualname, id LIMIT 20"""),
    "q14_stats": _sql("""
        SELECT count(*) AS edges, count(dst_id) AS resolved, count(*) FILTER (reason = 'external') AS external, count(dst_id) / count(*) AS resolution_rate,
            count(dst_id) / (count(*) - count(*) FILTER (reason = 'external')) AS internal_resolution_rate FROM e"""),
    "q09_related": _related_sql(),
    "q15_cycles": _CYCLES_SQL,
    "ga1_pagerank": _pagerank_sql(30),
    "ga3_components": _COMPONENTS_SQL,
    "ga3_repository_components": _REPOSITORY_COMPONENTS_SQL,
    "ga4_layers": _LAYERS_SQL,
    "ga4_name_layers": _NAME_LAYERS_SQL,
    "res1_imports": _RES_IMPORTS_SQL,
    "res6_references": _RES_REFS_SQL,
    "agg12_resolution_report": _REPORT_SQL,
    "ext8_clean_refs": _CLEAN_REFS_SQL,
    "src8_path_facts": _PATH_FACTS_SQL,
    "inc1_delta": _DELTA_SQL,
}
