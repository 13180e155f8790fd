"""One query for each operator over the views, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import new_folder
from ..functions import code
from ..operators import graph, report, resolve, retrieval, traverse
from ..operators.build import build_graph
from ..session import SourceGraph
from ..sources.repository import content_hashes, parse_sources, read_whole
from . import views, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SYMBOL, FILE = "p1", "s1"

STEPS = "SELECT a.l_partkey AS a_part, a.l_suppkey AS a_supp, b.l_partkey AS b_part, b.l_suppkey AS b_supp, a.l_linenumber AS line FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
VIEWS = f"""
steps AS ({STEPS}),
calls AS (SELECT 'p' || a_part AS src, 'p' || b_part AS dst FROM steps),
imports AS (SELECT 's' || a_supp AS src, 's' || b_supp AS dst FROM steps),
methods AS (SELECT p_brand AS src, 'p' || p_partkey AS dst FROM part),
contains_edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
edges AS (
    SELECT 'CALLS' AS type, src, dst, 1.0::DOUBLE AS confidence FROM calls UNION ALL SELECT 'IMPORTS', src, dst, 0.9::DOUBLE FROM imports
    UNION ALL SELECT 'HAS_METHOD', src, dst, 1.0::DOUBLE FROM methods UNION ALL SELECT 'CONTAINS', src, dst, 1.0::DOUBLE FROM contains_edges
),
owners AS (SELECT 'p' || l_partkey AS id, 's' || min(l_suppkey) AS file FROM lineitem GROUP BY l_partkey),
nodes AS (
    SELECT 'File' AS label, 's' || s_suppkey AS id, s_name AS name, 's' || s_suppkey AS file FROM supplier
    UNION ALL SELECT 'Function', 'p' || p_partkey, p_name, coalesce(o.file, '') FROM part LEFT JOIN owners AS o ON o.id = 'p' || p_partkey
    UNION ALL SELECT DISTINCT 'Class', p_brand, p_brand, '' FROM part
),
symbols AS (
    SELECT p_partkey AS seq, p_brand AS module, replace(p_name, ' ', '_') || '_' || p_size AS name,
        CASE p_type WHEN 'SMALL' THEN 'class' WHEN 'ECONOMY' THEN 'method' ELSE 'function' END AS kind,
        CASE WHEN p_type = 'ECONOMY' THEN p_type || '.' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_size AS qualified_name,
        CASE WHEN p_type = 'ECONOMY' THEN p_type END AS parent
    FROM part
),
named AS (SELECT *, module || '.' || qualified_name AS fqn FROM symbols),
import_list AS (
    SELECT 'Brand#' || (s_suppkey % 25) AS module, s_suppkey AS ord, 'Brand#' || s_nationkey AS imported, 'Brand#' || s_nationkey AS name,
        CASE WHEN s_suppkey % 2 = 0 THEN 'm' || s_nationkey END AS alias FROM supplier
),
sites AS (
    SELECT a.module, a.fqn AS caller, CASE s.line % 3 WHEN 0 THEN b.name WHEN 1 THEN p.p_type || '.' || b.name ELSE 'm' || split_part(b.module, '#', 2) || '.' || b.name END AS chain
    FROM steps AS s JOIN named AS a ON a.seq = s.a_part JOIN named AS b ON b.seq = s.b_part JOIN part AS p ON p.p_partkey = s.b_part
),
keys AS (
    SELECT DISTINCT module, chain, split_part(chain, '.', 1) AS head, CASE WHEN contains(chain, '.') THEN substr(chain, instr(chain, '.') + 1) ELSE '' END AS tail,
        split_part(chain, '.', -1) AS callee FROM sites
),
local_one AS (SELECT module, name AS head, min(fqn) AS only FROM named GROUP BY module, name HAVING count(*) = 1),
local_exact AS (SELECT module, name AS head, qualified_name AS chain, arg_min(fqn, seq) AS first FROM named GROUP BY module, name, qualified_name),
tier1 AS (
    SELECT k.module, k.chain, coalesce(o.only, e.first) AS target FROM keys AS k LEFT JOIN local_one AS o ON o.module = k.module AND o.head = k.head
    LEFT JOIN local_exact AS e ON e.module = k.module AND e.head = k.head AND e.chain = k.chain WHERE coalesce(o.only, e.first) IS NOT NULL
),
tier2 AS (
    SELECT k.module, k.chain, arg_min(s.fqn, i.ord * 10000000 + s.seq) AS target FROM keys AS k JOIN import_list AS i ON i.module = k.module AND coalesce(nullif(i.alias, ''), i.name) = k.head
    JOIN named AS s ON s.module = i.imported AND s.name = coalesce(nullif(k.tail, ''), k.callee) GROUP BY k.module, k.chain
),
global_one AS (SELECT name, min(fqn) AS target FROM named GROUP BY name HAVING count(*) = 1),
tier3 AS (SELECT k.module, k.chain, g.target FROM keys AS k JOIN global_one AS g ON g.name = k.callee),
resolved AS (
    SELECT k.module, k.chain, coalesce(a.target, b.target, c.target) AS target, CASE WHEN a.target IS NOT NULL THEN 1 WHEN b.target IS NOT NULL THEN 2 WHEN c.target IS NOT NULL THEN 3 ELSE 0 END AS tier
    FROM keys AS k LEFT JOIN tier1 AS a ON a.module = k.module AND a.chain = k.chain LEFT JOIN tier2 AS b ON b.module = k.module AND b.chain = k.chain LEFT JOIN tier3 AS c ON c.module = k.module AND c.chain = k.chain
),
paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
"""


def query(name: str, sql: str | None = None, extra: str = "", recursive: bool = False):
    """Registers a query, and the SQL for its rows over VIEWS and the CTEs ``extra``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' * recursive}{VIEWS}{',' * bool(extra)}{extra}\n{sql}"
        return f

    return add


def _one(spark: SparkSession, value: str, name: str = "id") -> DataFrame:
    return spark.range(1).select(F.lit(value).alias(name))


def _walk(name: str, edges: str, seed: str, near: str, far: str, depth: int) -> str:
    """CTEs: the least depth of each node that can be reached, and its least predecessor one level nearer."""
    return f"""
{name}_pairs AS (SELECT DISTINCT {near} AS near, {far} AS far FROM {edges}),
{name}_walk(id, depth) AS (
    SELECT id, 0 FROM ({seed}) AS seeds UNION SELECT p.far, w.depth + 1 FROM {name}_walk AS w JOIN {name}_pairs AS p ON p.near = w.id WHERE w.depth < {depth}
),
{name}_least AS (SELECT id, min(depth) AS depth FROM {name}_walk GROUP BY id),
{name} AS (
    SELECT l.id, min(p.near) AS parent, CAST(l.depth AS INTEGER) AS depth FROM {name}_least AS l JOIN {name}_pairs AS p ON p.far = l.id
    JOIN {name}_least AS n ON n.id = p.near AND n.depth = l.depth - 1 WHERE l.depth > 0 GROUP BY l.id, l.depth
)"""


ONE = f"SELECT '{SYMBOL}' AS id"


@query("callers", "SELECT id AS caller, parent AS callee, depth, 1.0::DOUBLE AS confidence FROM w", _walk("w", "calls", ONE, "dst", "src", 2), True)
def _callers(spark, d):
    return traverse.callers(views.calls(spark, d), _one(spark, SYMBOL), 2)


@query("callees", "SELECT parent AS caller, id AS callee, depth, 1.0::DOUBLE AS confidence FROM w", _walk("w", "calls", ONE, "src", "dst", 2), True)
def _callees(spark, d):
    return traverse.callees(views.calls(spark, d), _one(spark, SYMBOL), 2)


BOTH = _walk("u", "calls", ONE, "dst", "src", 2) + "," + _walk("v", "calls", ONE, "src", "dst", 2)
ROWS = "SELECT 'upstream' AS direction, id, depth, 1.0::DOUBLE AS confidence FROM u UNION ALL SELECT 'downstream', id, depth, 1.0::DOUBLE FROM v"


@query("impact_report", ROWS, BOTH, True)
def _impact(spark, d):
    return report.impact_rows(views.calls(spark, d), _one(spark, SYMBOL), 2)


@query(
    "impact_summary",
    """SELECT upstream, downstream, n_files, risk, 'upstream ' || upstream || ', downstream ' || downstream || ', files ' || n_files || ', risk ' || risk AS summary FROM (
    SELECT *, CASE WHEN upstream + downstream >= 10 THEN 'high' WHEN upstream + downstream >= 5 THEN 'medium' ELSE 'low' END AS risk FROM (
    SELECT count(DISTINCT CASE WHEN direction = 'upstream' THEN id END) AS upstream, count(DISTINCT CASE WHEN direction = 'downstream' THEN id END) AS downstream, count(DISTINCT split_part(id, '.', 1)) AS n_files FROM r))""",
    BOTH + f", r AS ({ROWS})",
    True,
)
def _summary(spark, d):
    return report.impact_totals(report.impact_rows(views.calls(spark, d), _one(spark, SYMBOL), 2))


@query("context", "SELECT 'caller' AS side, id FROM u UNION ALL SELECT 'callee', id FROM v", _walk("u", "calls", ONE, "dst", "src", 1) + "," + _walk("v", "calls", ONE, "src", "dst", 1), True)
def _context(spark, d):
    edges, one = views.calls(spark, d), _one(spark, SYMBOL)
    up, down = traverse.callers(edges, one), traverse.callees(edges, one)
    return up.select(F.lit("caller").alias("side"), F.col("caller").alias("id")).union(down.select(F.lit("callee"), "callee"))


@query("importers", "SELECT id FROM w", _walk("w", "imports", f"SELECT '{FILE}' AS id", "dst", "src", 4), True)
def _importers(spark, d):
    return traverse.importers(views.imports(spark, d), _one(spark, FILE))


SEEDS = f"SELECT id FROM owners WHERE file = '{FILE}'"


@query(
    "caller_files",
    f"SELECT DISTINCT o.file FROM calls AS c JOIN (SELECT id FROM w UNION {SEEDS}) AS n ON n.id = c.dst JOIN owners AS o ON o.id = c.src",
    _walk("w", "calls", SEEDS, "dst", "src", 2),
    True,
)
def _caller_files(spark, d):
    return traverse.caller_files(views.calls(spark, d), views.owners(spark, d), _one(spark, FILE, "file"))


@query(
    "write_set_closure",
    f"SELECT id AS file FROM (SELECT id FROM w UNION SELECT '{FILE}' AS id) AS x WHERE id IN (SELECT 's' || s_suppkey FROM supplier)",
    "between_files AS (SELECT a.file AS src, b.file AS dst FROM calls AS c JOIN owners AS a ON a.id = c.src JOIN owners AS b ON b.id = c.dst UNION SELECT src, dst FROM imports),"
    + _walk("w", "between_files", f"SELECT '{FILE}' AS id", "dst", "src", 12),
    True,
)
def _write_set(spark, d):
    present = views.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"))
    return traverse.write_set(views.imports(spark, d), views.calls(spark, d), views.owners(spark, d), _one(spark, FILE, "file"), present)


EGO = "both_ways AS (SELECT src, dst, type FROM edges UNION SELECT dst, src, type FROM edges),"


@query("ego_nodes", f"SELECT id, depth FROM w UNION ALL SELECT '{SYMBOL}', 0", EGO + _walk("w", "both_ways", ONE, "src", "dst", 2), True)
def _ego_nodes(spark, d):
    return traverse.ego_network(views.edges(spark, d), _one(spark, SYMBOL), 2)[0]


@query("ego_edges", f"SELECT src, dst, type FROM both_ways WHERE src = '{SYMBOL}' OR dst = '{SYMBOL}'", EGO.rstrip(","))
def _ego_edges(spark, d):
    return traverse.ego_network(views.edges(spark, d), _one(spark, SYMBOL), 1)[1]


CATALOGUE = """catalogue(rel_table, type, src_label, dst_label) AS (VALUES ('R_CALLS_FF', 'CALLS', 'Function', 'Function'), ('R_CALLS_FC', 'CALLS', 'Function', 'Class'),
    ('R_CONTAINS_FF', 'CONTAINS', 'File', 'Function'), ('R_CONTAINS_FC', 'CONTAINS', 'File', 'Class'), ('R_HAS_METHOD', 'HAS_METHOD', 'Class', 'Function'), ('R_IMPORTS', 'IMPORTS', 'File', 'File')),
routed AS (SELECT c.rel_table, e.type, e.src, e.dst, c.src_label, c.dst_label, e.confidence FROM edges AS e JOIN nodes AS a ON a.id = e.src JOIN nodes AS b ON b.id = e.dst
    JOIN catalogue AS c ON c.type = e.type AND c.src_label = a.label AND c.dst_label = b.label)"""


def _routed(spark, d):
    return graph.route_edges(views.edges(spark, d), views.nodes(spark, d).select("id", "label"))


@query("edge_route", "SELECT rel_table, type, src_label, dst_label, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM routed GROUP BY rel_table, type, src_label, dst_label", CATALOGUE)
def _edge_route(spark, d):
    return _routed(spark, d).groupBy("rel_table", "type", "src_label", "dst_label").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


SHOWN = "shown AS (SELECT label, id, name, file FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rank FROM nodes WHERE label IN ('File', 'Class')) WHERE rank <= 50)"


@query("seed_layer_nodes", "SELECT * FROM shown", SHOWN)
def _seed_nodes(spark, d):
    return graph.seed_layer(views.nodes(spark, d), _routed(spark, d), 50)[0]


@query(
    "seed_layer_edges",
    "SELECT src, dst, type, rel_table FROM (SELECT *, row_number() OVER (PARTITION BY rel_table ORDER BY src, dst) AS place FROM routed WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)) WHERE place <= 150",
    CATALOGUE + "," + SHOWN,
)
def _seed_edges(spark, d):
    return graph.seed_layer(views.nodes(spark, d), _routed(spark, d), 50)[1]


@query("node_counts", "SELECT label, count(*) AS n FROM nodes GROUP BY label")
def _node_counts(spark, d):
    return graph.node_counts(views.nodes(spark, d))


@query("edge_counts", "SELECT coalesce(type, '(all)') AS type, count(*) AS n FROM edges GROUP BY ROLLUP (type)")
def _edge_counts(spark, d):
    return graph.edge_counts(views.edges(spark, d))


@query("graph_signature", "SELECT type, count(*) AS n, count(DISTINCT src || '>' || dst) AS n_distinct FROM edges GROUP BY type")
def _signature(spark, d):
    return graph.graph_signature(views.edges(spark, d))


@query("multi_edges", "SELECT type, src, dst, count(*) AS n FROM edges GROUP BY type, src, dst HAVING count(*) > 1")
def _multi(spark, d):
    return graph.multi_edges(views.edges(spark, d))


CHANGES = "changes AS (SELECT 'Function' AS label, 'p' || l_partkey AS id, 'part of order ' || l_orderkey AS name, 's' || l_suppkey AS file, l_orderkey * 100 + l_linenumber AS ord, l_extendedprice AS price FROM lineitem)"


@query(
    "node_upsert",
    "SELECT label, id, name, file FROM nodes WHERE (label, id) NOT IN (SELECT label, id FROM changes) UNION ALL SELECT label, id, arg_max(name, (ord, price)), arg_max(file, (ord, price)) FROM changes GROUP BY label, id",
    CHANGES,
)
def _upsert(spark, d):
    lines = views.table(spark, d, "lineitem")
    ids = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    changes = lines.select(F.lit("Function").alias("label"), ids[0].alias("id"), F.concat(F.lit("part of order "), F.col("l_orderkey").cast("string")).alias("name"), ids[1].alias("file"), F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_extendedprice").alias("ord"))
    return graph.upsert_nodes(views.nodes(spark, d), changes)


GONE = "gone_files AS (SELECT 's' || s_suppkey AS file FROM supplier WHERE s_acctbal < 0), gone AS (SELECT DISTINCT id FROM nodes WHERE file IN (SELECT file FROM gone_files))"


def _deleted(spark, d):
    files = views.table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"))
    return graph.detach_delete(views.nodes(spark, d), views.edges(spark, d), files)


@query("detach_delete_nodes", "SELECT label, id, name, file FROM nodes WHERE file NOT IN (SELECT file FROM gone_files)", GONE)
def _deleted_nodes(spark, d):
    return _deleted(spark, d)[0]


@query("detach_delete_edges", "SELECT type, src, dst, confidence FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)", GONE)
def _deleted_edges(spark, d):
    return _deleted(spark, d)[1].select("type", "src", "dst", "confidence")


@query("symbol_search", "SELECT id, label, name, file FROM nodes WHERE contains(id, '1') ORDER BY id, label LIMIT 20")
def _search(spark, d):
    return graph.search_symbols(views.nodes(spark, d), "1")


@query(
    "point_lookup",
    "SELECT id, label, name, file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE label WHEN 'File' THEN 1 WHEN 'Function' THEN 2 ELSE 3 END) AS k FROM nodes WHERE id IN (SELECT 's' || s_suppkey FROM supplier UNION SELECT p_brand FROM part)) WHERE k = 1",
)
def _look_up(spark, d):
    ids = views.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).union(views.table(spark, d, "part").select("p_brand")).distinct()
    return graph.look_up(views.nodes(spark, d), ids)


def _snapshots(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    old = docs.where("doc_id % 13 <> 0").select("file", "sha1")
    new = docs.where("doc_id % 11 <> 0").select("file", F.when(F.col("doc_id") % 7 == 0, F.sha1(F.concat("sha1", F.lit("!")).cast("binary"))).otherwise(F.col("sha1")).alias("sha1"))
    return old, new


@query(
    "snapshot_diff",
    """SELECT coalesce(n.file, o.file) AS file, CASE WHEN o.sha1 IS NULL THEN 'added' WHEN n.sha1 IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM (SELECT file, CASE WHEN doc_id % 7 = 0 THEN sha1(sha1 || '!') ELSE sha1 END AS sha1 FROM hashed WHERE doc_id % 11 <> 0) AS n
FULL JOIN (SELECT file, sha1 FROM hashed WHERE doc_id % 13 <> 0) AS o ON n.file = o.file WHERE n.sha1 IS DISTINCT FROM o.sha1""",
    "hashed AS (SELECT doc_id, source || '/' || doc_id AS file, sha1(text) AS sha1 FROM documents)",
)
def _diff(spark, d):
    return graph.snapshot_diff(*_snapshots(spark, d))


@query("content_hash", "SELECT doc_id, sha1(text) AS sha1, strlen(text) AS size FROM documents")
def _content_hash(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.octet_length("text").cast("long").alias("size"))


def _keys(spark, d):
    return resolve.call_keys(views.call_sites(spark, d))


@query("resolve_local", "SELECT module, chain, target FROM tier1")
def _local(spark, d):
    return resolve.resolve_local(_keys(spark, d), views.symbols(spark, d))


@query("resolve_import", "SELECT module, chain, target FROM tier2")
def _import(spark, d):
    return resolve.resolve_import(_keys(spark, d), views.symbols(spark, d), views.import_list(spark, d))


@query("resolve_global", "SELECT module, chain, target FROM tier3")
def _global(spark, d):
    return resolve.resolve_global(_keys(spark, d), views.symbols(spark, d))


@query("resolve_calls", "SELECT s.caller, r.target, CAST(r.tier AS INTEGER) AS tier, count(*) AS n FROM sites AS s JOIN resolved AS r ON r.module = s.module AND r.chain = s.chain GROUP BY s.caller, r.target, r.tier")
def _resolve(spark, d):
    found = resolve.resolve_calls(views.call_sites(spark, d), views.symbols(spark, d), views.import_list(spark, d))
    return found.groupBy("caller", "target", "tier").agg(F.count("*").alias("n"))


@query("unresolved_count", "SELECT count(*) AS calls, count(*) FILTER (WHERE r.target IS NULL) AS unresolved FROM sites AS s JOIN resolved AS r ON r.module = s.module AND r.chain = s.chain")
def _unresolved(spark, d):
    found = resolve.resolve_calls(views.call_sites(spark, d), views.symbols(spark, d), views.import_list(spark, d))
    return found.agg(F.count("*").alias("calls"), F.count_if(F.col("target").isNull()).alias("unresolved"))


@query("import_edges", "SELECT module AS src, imported AS dst FROM import_list WHERE imported IN (SELECT module FROM symbols)")
def _import_edges(spark, d):
    return resolve.import_edges(views.import_list(spark, d), views.symbols(spark, d).select("module"))


@query("contains_edges", "SELECT module AS src, fqn AS dst, CASE WHEN kind = 'class' THEN 'Class' ELSE 'Function' END AS dst_label FROM named")
def _contains(spark, d):
    return resolve.contains_edges(views.symbols(spark, d))


@query("has_method_edges", "SELECT module || '.' || parent AS src, fqn AS dst FROM named WHERE kind = 'method' AND parent IS NOT NULL")
def _has_method(spark, d):
    return resolve.method_edges(views.symbols(spark, d))


def _paths(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(
    "language_counts",
    """SELECT CASE lower(regexp_extract(split_part(path, '/', -1), '(\\.[^.]*)$', 1)) WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.mjs' THEN 'JavaScript' WHEN '.cjs' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript'
    WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.java' THEN 'Java' ELSE 'Other' END AS language, count(*) AS n FROM paths GROUP BY 1""",
)
def _languages(spark, d):
    return graph.language_counts(_paths(spark, d))


@query("module_rollup", "SELECT array_to_string(string_split(path, '/')[1:2], '/') AS module, count(*) AS n FROM paths GROUP BY 1 ORDER BY n DESC, module LIMIT 40")
def _rollup(spark, d):
    return graph.module_rollup(_paths(spark, d))


@query(
    "module_of",
    r"""SELECT page_id, array_to_string(CASE WHEN python AND parts[-1] = '__init__' THEN parts[1:-2] ELSE parts END, '.') AS module FROM (
    SELECT page_id, ends_with(path, '.py') AS python, list_filter(string_split(regexp_replace(path, '\.(py|js|mjs|cjs|jsx|ts|tsx|java)$', ''), '/'), lambda x: x <> '') AS parts FROM sources)""",
    "sources AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN path || '/__init__.py' WHEN 1 THEN path || '.py' WHEN 2 THEN path || '.tsx' ELSE path END AS path FROM paths)",
)
def _module_of(spark, d):
    kind, path = F.col("page_id") % 4, F.col("path")
    file = F.when(kind == 0, F.concat(path, F.lit("/__init__.py"))).when(kind == 1, F.concat(path, F.lit(".py"))).when(kind == 2, F.concat(path, F.lit(".tsx"))).otherwise(path)
    return _paths(spark, d).select("page_id", code.module_of(file).alias("module"))


@query("chain_parts", "SELECT DISTINCT chain, head, tail, callee FROM keys")
def _chain_parts(spark, d):
    return _keys(spark, d).select("chain", "head", "tail", "callee").distinct()


@query("snippets", "SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(1, doc_id % 3):least(doc_id % 20, doc_id % 3 + 8)], chr(10)) AS snippet FROM documents")
def _snippets(spark, d):
    start, end = F.col("doc_id") % 3, F.col("doc_id") % 20
    return views.table(spark, d, "documents").select("doc_id", code.snippet(F.col("text"), start.cast("int"), end.cast("int")).alias("snippet"))


@query("risk_levels", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN 'high' WHEN p_size >= 5 THEN 'medium' ELSE 'low' END AS risk FROM part")
def _risk(spark, d):
    return views.table(spark, d, "part").select("p_partkey", code.risk(F.col("p_size"), F.lit(0)).alias("risk"))


STOP = ", ".join(f"'{w}'" for w in code.STOP_WORDS)
TOKENS = f"tokenized AS (SELECT doc_id AS ord, source AS name, lang AS file, list_filter(regexp_extract_all(lower(text), '{code.TOKEN}'), lambda t: t NOT IN ({STOP})) AS tokens FROM documents)"


@query("tokenize", "SELECT ord, len(tokens) AS dl, array_to_string(tokens, ' ') AS tokens FROM tokenized", TOKENS)
def _tokenize(spark, d):
    return retrieval.tokenized(views.text_docs(spark, d)).select("ord", F.col("dl").cast("long").alias("dl"), F.array_join("tokens", " ").alias("tokens"))


@query("postings", "SELECT term, ord, count(*) AS tf FROM (SELECT ord, unnest(tokens) AS term FROM tokenized) GROUP BY term, ord", TOKENS)
def _postings(spark, d):
    return retrieval.postings(views.text_docs(spark, d))


@query("term_stats", "SELECT term, count(DISTINCT ord) AS df FROM (SELECT ord, unnest(tokens) AS term FROM tokenized) GROUP BY term", TOKENS)
def _term_stats(spark, d):
    return retrieval.term_stats(views.text_docs(spark, d))


@query("doc_stats", "SELECT count(*) AS n, round(avg(len(tokens)), 6) AS avgdl FROM tokenized", TOKENS)
def _doc_stats(spark, d):
    return retrieval.tokenized(views.text_docs(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


#: Terms, one of them twice, a stop word and the names that the bonus looks for.
SEARCH = "that reing anand was reing src1 en"
SCORES = f"""{TOKENS},
terms AS (SELECT unnest(list_filter(regexp_extract_all(lower('{SEARCH}'), '{code.TOKEN}'), lambda t: t NOT IN ({STOP}))) AS term),
wanted AS (SELECT term, count(*) AS times FROM terms GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tokenized),
hits AS (SELECT t.ord, len(t.tokens) AS dl, w.term, w.times, len(list_filter(t.tokens, lambda x: x = w.term)) AS f FROM tokenized AS t, wanted AS w WHERE list_contains(t.tokens, w.term)),
freq AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
parts AS (
    SELECT ord, times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s FROM hits JOIN freq USING (term), corpus
    UNION ALL SELECT ord, 2.0 * times FROM tokenized, wanted WHERE contains(lower(name || ' ' || file), term)
),
scores AS (SELECT ord, sum(s) AS score FROM parts GROUP BY ord HAVING sum(s) > 0)"""


@query("bm25", "SELECT CAST(ord AS VARCHAR) AS id, ord, round(score, 6) AS score FROM scores", SCORES)
def _bm25(spark, d):
    return retrieval.bm25(views.text_docs(spark, d), SEARCH).select("id", "ord", F.round("score", 6).alias("score"))


@query("bm25_topk", "SELECT CAST(ord AS VARCHAR) AS id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, ord) AS INTEGER) AS rank FROM scores QUALIFY rank <= 10", SCORES)
def _bm25_topk(spark, d):
    return retrieval.top(retrieval.bm25(views.text_docs(spark, d), SEARCH), 10).select("id", F.round("score", 6).alias("score"), "rank")


COSINE = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
alike AS (SELECT vec_id AS ord, list_dot_product(CAST(embedding AS DOUBLE[]), q.v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v)) + 1e-9) AS score FROM embeddings, q)"""


def _query_vector(spark, d):
    return [float(x) for x in views.vectors(spark, d).where("ord = 0").first()["vec"]]


@query("cosine", "SELECT CAST(ord AS VARCHAR) AS id, round(score, 6) AS score FROM alike", COSINE)
def _cosine(spark, d):
    return retrieval.cosine(views.vectors(spark, d), _query_vector(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("cosine_topk", "SELECT CAST(ord AS VARCHAR) AS id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, ord) AS INTEGER) AS rank FROM alike QUALIFY rank <= 10", COSINE)
def _cosine_topk(spark, d):
    return retrieval.top(retrieval.cosine(views.vectors(spark, d), _query_vector(spark, d)), 10).select("id", F.round("score", 6).alias("score"), "rank")


FUSED = f"""{SCORES}, {COSINE},
lists AS (
    SELECT ord, rank, 0 AS list, 'bm25' AS source FROM (SELECT ord, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM scores) WHERE rank <= 30
    UNION ALL SELECT ord, rank, 1, 'semantic' FROM (SELECT ord, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM alike) WHERE rank <= 30
),
fused AS (SELECT ord, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first, string_agg(source, ',' ORDER BY list) AS sources FROM lists GROUP BY ord),
best AS (SELECT ord, score, sources, CAST(row_number() OVER (ORDER BY score DESC, first) AS INTEGER) AS rank FROM fused QUALIFY rank <= 10)"""


@query("rrf_fusion", "SELECT CAST(ord AS VARCHAR) AS id, round(score, 6) AS score, sources, rank FROM best", FUSED)
def _rrf(spark, d):
    words = retrieval.top(retrieval.bm25(views.text_docs(spark, d), SEARCH), 30)
    near = retrieval.top(retrieval.cosine(views.vectors(spark, d), _query_vector(spark, d)), 30)
    return retrieval.fuse({"bm25": words, "semantic": near}, 10).select("id", F.round("score", 6).alias("score"), "sources", "rank")


@query("hybrid_search", "SELECT CAST(b.ord AS VARCHAR) AS id, coalesce(source, '') AS name, coalesce(lang, '') AS file, round(score, 4) AS score, sources, rank FROM best AS b LEFT JOIN documents ON doc_id = b.ord", FUSED)
def _hybrid(spark, d):
    return retrieval.hybrid(views.text_docs(spark, d), SEARCH, 10, views.vectors(spark, d), _query_vector(spark, d))


FIRST = """both_ways AS (SELECT src AS node, type AS rel_table, 'out' AS direction, dst AS other, type FROM edges UNION SELECT dst, type, 'in', src, type FROM edges),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY node, rel_table, direction ORDER BY other, type) AS INTEGER) AS place FROM both_ways)"""


@query("first_neighbours", "SELECT node, rel_table, direction, place, other, type FROM placed WHERE place <= 3", FIRST)
def _first_neighbours(spark, d):
    edges = views.edges(spark, d)
    return traverse.first_neighbours(edges.withColumn("rel_table", F.col("type")), 3).select("node", "rel_table", "direction", "place", "other", "type")


# ---- parsing and building, on repositories written from the tables' rows


def _parsed(spark, d):
    return parse_sources(written.sources(written.units(spark, d, "part")))


def of_rows(name: str, table: str, sql: str):
    """Registers a query over the repository that is written from a table's rows, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, f"WITH {written.views_sql(table)}\n{sql}"
        return f

    return add


@of_rows("parse_symbols", "part", "SELECT file, kind, qualified_name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM symbols")
def _parse_symbols(spark, d):
    return _parsed(spark, d).select("file", F.explode("symbols").alias("s")).select("file", "s.kind", "s.qualified_name", "s.start_line", "s.end_line")


@of_rows("parse_imports", "part", "SELECT file, imported AS module, name, alias FROM imported")
def _parse_imports(spark, d):
    return _parsed(spark, d).select("file", F.explode("imports").alias("i")).select("file", "i.module", "i.name", F.coalesce("i.alias", F.lit("")).alias("alias"))


@of_rows("parse_calls", "part", "SELECT file, caller, chain, CAST(line AS INTEGER) AS line FROM called")
def _parse_calls(spark, d):
    return _parsed(spark, d).select("file", F.explode("calls").alias("c")).select("file", "c.caller", F.col("c.callee_chain").alias("chain"), "c.line")


@of_rows(
    "parse_files",
    "part",
    """SELECT file, module, CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'js' WHEN 2 THEN 'ts' ELSE 'java' END AS lang, sha1(content) AS sha1,
    CAST(length(content) AS BIGINT) AS size, CASE WHEN broken THEN 'partial' ELSE 'ok' END AS status FROM texts""",
)
def _parse_files(spark, d):
    return _parsed(spark, d).select("file", "module", "lang", "sha1", "size", "status")


@of_rows("built_call_edges", "part", "SELECT src, dst FROM call_edges")
def _call_edges(spark, d):
    return build_graph(_parsed(spark, d)).edges.where("type = 'CALLS'").select("src", "dst")


# ---- sources in a folder and graphs in a store: files are written from the suppliers' rows, listed, read, built and brought up to date


def _repository(spark, units):
    """The folder of a repository with a file for each of the ``units``."""
    root = new_folder(spark, "repository")
    written.write(written.sources(units), root)
    return root


def _suppliers(spark, d):
    return written.units(spark, d, "supplier")


def _suppliers_before(spark, d):
    """The repository as it was before: files of suppliers in debt weren't there yet, others of their kind were, and those of small accounts had more or fewer steps."""
    accounts = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("account"))
    rows = _suppliers(spark, d).join(accounts.hint("merge"), "k")
    moved = F.when(F.col("account") < 0, F.col("k") + written.APART).otherwise(F.col("k"))
    steps = F.when(F.col("account") < 2000, F.col("n") % 5 + 1).otherwise(F.col("n")).cast("int")
    return rows.select(moved.alias("k"), steps.alias("n"), "m", "broken")


@of_rows("source_scan", "supplier", "SELECT file, CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'js' WHEN 2 THEN 'ts' ELSE 'java' END AS lang, sha1(content) AS sha1 FROM texts")
def _source_scan(spark, d):
    sources, _ = read_whole(spark, _repository(spark, _suppliers(spark, d)))
    return content_hashes(sources).select("file", code.language_of(F.col("file")).alias("lang"), "sha1")


@of_rows(
    "source_changes",
    "supplier",
    f"""SELECT file, 'added' AS change FROM units JOIN supplier ON s_suppkey = k WHERE s_acctbal < 0
UNION ALL SELECT replace(file, CAST(k AS VARCHAR), CAST(k + {written.APART} AS VARCHAR)), 'deleted' FROM units JOIN supplier ON s_suppkey = k WHERE s_acctbal < 0
UNION ALL SELECT file, 'changed' FROM units JOIN supplier ON s_suppkey = k WHERE s_acctbal >= 0 AND s_acctbal < 2000""",
)
def _source_changes(spark, d):
    before, after = (read_whole(spark, _repository(spark, u))[0] for u in (_suppliers_before(spark, d), _suppliers(spark, d)))
    return graph.snapshot_diff(content_hashes(before), content_hashes(after))


@of_rows("stored_edges", "supplier", "SELECT type, src, dst FROM edges")
def _stored_edges(spark, d):
    session = SourceGraph(spark, new_folder(spark, "graph"))
    session.analyze(_repository(spark, _suppliers(spark, d)))
    return session.table("edges").select("type", "src", "dst")


def _updated(spark, d):
    """A graph that was built of the repository as it was before, and then brought up to date."""
    session = SourceGraph(spark, new_folder(spark, "graph"))
    for units in (_suppliers_before(spark, d), _suppliers(spark, d)):
        session.analyze(_repository(spark, units))
    return session


@of_rows("updated_edges", "supplier", "SELECT type, src, dst FROM edges")
def _updated_edges(spark, d):
    return _updated(spark, d).table("edges").select("type", "src", "dst")


@of_rows(
    "updated_nodes",
    "supplier",
    "SELECT 'File' AS label, module AS id, file AS name, file FROM units UNION ALL SELECT CASE kind WHEN 'class' THEN 'Class' ELSE 'Function' END, fqn, name, file FROM symbols",
)
def _updated_nodes(spark, d):
    return _updated(spark, d).table("nodes").select("label", "id", "name", "file")
