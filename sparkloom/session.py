"""A code graph in a folder of versions: building it, keeping it up to date, and asking it.

A version is a manifest over tables in buckets (see ``store``); readers see the old version or the new one and never a part.
Only added and changed files are parsed again. From what differs in their symbols follow the keys of calls that may have another
target now, and only their edges are replaced, in the buckets that hold them (see ``operators.delta``). Edges are stored twice,
by the module they come from and by the symbol they lead to, so that a question reads the buckets of what it asks for. Terms of
documents are stored by term, a segment for each version until they are merged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut_lineage
from .functions import code
from .operators import delta, graph, report, retrieval, traverse
from .operators.build import last_imports
from .schemas import DOC, EDGE, NODE, PARSED, POSTING, STORED_EDGE
from .sources.languages import module_of
from .sources.repository import content_hashes, parse_sources, read_files, read_whole
from .store import Store, at_once, bucket_column, bucket_of, buckets_for

STORED_DOC = f"{DOC}, module string, dl int"
#: Given, so that empty tables can be read.
SCHEMAS = {"parsed": PARSED, "symbols": delta.SYMBOL, "keys": delta.KEY, "nodes": NODE, "edges": STORED_EDGE, "edges_in": STORED_EDGE, "docs": STORED_DOC, "dead": "file string, upto int"}
SHOWN = {"edges": EDGE, "edges_in": EDGE, "docs": DOC}
CALLS = "rel_table in ('R_CALLS_FF', 'R_CALLS_FC')"
#: Rows that a file is reckoned to have in each table, for the number of buckets.
ROWS_A_FILE = 50
#: With more changed files the tables are derived anew, and lists of files stay tables; with more ids the frontier stays a table.
MOST_CHANGED, MOST_IDS = 1000, 2000
#: Segments of the search index before they are merged.
MOST_SEGMENTS = 6


class Files(Sequence):
    """Names of files in order, of a table (file) without repeats that is as long as a repository may be: it is read when asked, a part at a time."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __len__(self) -> int:
        return self.table.count()

    def __iter__(self) -> Iterator[str]:
        return (r["file"] for r in self.table.select("file").orderBy("file").toLocalIterator())

    def __getitem__(self, at):
        return list(self)[at]

    def __contains__(self, name: object) -> bool:
        return not self.table.where(F.col("file") == F.lit(name)).isEmpty()

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, (list, Files)):
            return NotImplemented
        return len(self) == len(other) and all(a == b for a, b in zip(self, other))


class SourceGraph:
    """``db`` is a folder that all executors share. ``model`` makes vectors of texts; ``backend`` answers (query, k) with ids, the best first."""

    def __init__(self, spark: SparkSession, db: str, model: Callable[[list[str]], list[list[float]]] | None = None, backend: Callable[[str, int], list[str]] | None = None):
        self.spark, self.db, self.model, self.backend = spark, db.rstrip("/"), model, backend
        self.store = Store(spark, self.db)

    # ---- versions

    def version(self) -> int | None:
        """The last version that was committed."""
        newest = self.store.newest()
        return None if newest is None else newest["version"]

    def _manifest(self) -> dict:
        newest = self.store.newest()
        if newest is None:
            raise ValueError(f"{self.db} has no graph; analyze a repository first")
        return newest

    def _read(self, manifest: dict, name: str, keys=None, only=None) -> DataFrame:
        return self.store.read(manifest["tables"][name], POSTING if name.startswith("postings") else SCHEMAS[name], keys, only)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of the newest version, or of the one that the manifest names: parsed, symbols, keys, nodes, edges, edges_in or docs."""
        rows = self._read(manifest or self._manifest(), name)
        return rows.select([f.split()[0] for f in SHOWN[name].split(", ")]) if name in SHOWN else rows

    def snapshot(self) -> dict[str, str]:
        """Content hash by file."""
        return {r["file"]: r["sha1"] for r in self.table("parsed").select("file", "sha1").collect()}

    # ---- building

    def analyze(self, root: str, force: bool = False) -> dict:
        """Builds the graph of the sources under ``root``, or brings it up to date; ``force`` builds it anew, and the old one stays until the new one is there.

        The newest version whose files are whole counts; without one the graph is built anew. Where more than MOST_CHANGED files
        are told of, the status has them as Files, else as lists.
        """
        sources, found = read_whole(self.spark, root)
        manifest = None if force else self.store.newest(checked=True)
        if manifest is not None:
            return self._update(manifest, sources, root)
        if not found:
            return {"mode": "full", "files": 0, "symbols": 0, "edges": 0, "calls": 0, "unresolved": 0}
        version, buckets = self.store.next_version(), buckets_for(ROWS_A_FILE * found)
        parsed = self.store.write("parsed", parse_sources(sources), "module", buckets, "file")
        published = self._derive(parsed, version, root)
        if force:
            self.store.vacuum(keep=1)
        return {"mode": "full", **self._counts(published)}

    def _derive(self, parsed_table: dict, version: int, root: str) -> dict:
        """All tables from the parsed files, published."""
        store, buckets = self.store, parsed_table["buckets"]
        parsed = store.read(parsed_table, PARSED)

        def graph_tables() -> dict:
            symbols_table = store.write("symbols", delta.symbols_of(parsed), "module", buckets, "name")
            symbols = store.read(symbols_table, delta.SYMBOL)
            calls = delta.calls_of(parsed)
            keys_table = store.write("keys", delta.resolved(delta.keys_of(calls), symbols, last_imports(parsed)), "module", buckets, "chain")
            edges = delta.call_edges(calls, store.read(keys_table, delta.KEY), delta.labels_of(symbols)).unionByName(delta.own_edges(symbols)).unionByName(delta.import_edges(parsed, parsed.select("module")))
            edges_table = store.write("edges", edges, "module", buckets, "src")
            edges_in = store.write("edges_in", store.read(edges_table, STORED_EDGE), "dst", buckets, "dst")
            return {"symbols": symbols_table, "keys": keys_table, "edges": edges_table, "edges_in": edges_in}

        def nodes() -> dict:
            rows = delta.file_nodes(parsed).unionByName(delta.symbol_nodes(delta.symbols_of(parsed)))
            return {"nodes": store.write("nodes", rows, "id", buckets, "id")}

        def index() -> dict:
            docs = store.write("docs", _documents(parsed), "module", buckets, "ord")
            return {"docs": docs, **self._index(store.read(docs, STORED_DOC), version, buckets)}

        tables = {"parsed": parsed_table}
        for part in at_once(graph_tables, nodes, index):
            tables |= part
        return self._publish(tables, version, root)

    def _index(self, docs: DataFrame, version: int, buckets: int) -> dict:
        """The search index of all documents, as one segment."""
        none = self.spark.range(0).selectExpr("cast(null as string) file", "cast(null as int) upto")
        segment, dead = at_once(lambda: self.store.write("postings", retrieval.stored_postings(docs, version), "term", buckets, "term"), lambda: self.store.write("dead", none, "file", 1))
        return {f"postings{version}": segment, "dead": dead}

    def _publish(self, tables: dict, version: int, root: str) -> dict:
        """Publishes the tables with what is counted over all of them."""
        manifest = {"tables": tables}
        nodes, edges, keys, docs = at_once(
            lambda: graph.node_counts(self._read(manifest, "nodes")).collect(),
            lambda: graph.edge_counts(self._read(manifest, "edges")).collect(),
            lambda: self._read(manifest, "keys").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("tier") == 0, F.col("sites"))), F.lit(0)).alias("unresolved")).first(),
            lambda: self._read(manifest, "docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first(),
        )
        totals = {"nodes": {r["label"]: r["n"] for r in nodes}, "edges": {r["type"]: r["n"] for r in edges}, "keys": keys["n"], "unresolved": keys["unresolved"], "docs": docs["n"], "terms": docs["dl"]}
        return self.store.publish(tables, version=version, totals=totals, repo=root)

    def _counts(self, manifest: dict) -> dict:
        nodes, edges = manifest["totals"]["nodes"], manifest["totals"]["edges"]
        return {"files": nodes.get("File", 0), "symbols": sum(n for k, n in nodes.items() if k != "File"), "edges": edges.get("(all)", 0), "calls": edges.get("CALLS", 0), "unresolved": manifest["totals"]["unresolved"]}

    def _update(self, manifest: dict, sources: DataFrame, root: str) -> dict:
        old = self._read(manifest, "parsed").select("file", "sha1")
        # compared once; what differs stays a table unless it is short
        diff = cut_lineage(graph.snapshot_diff(old, content_hashes(sources)))
        differing, named, version = diff.count(), diff.select("file"), self.store.next_version()
        if not differing:
            return {"mode": "up-to-date", "files": manifest["totals"]["nodes"].get("File", 0)}
        if differing <= MOST_CHANGED:
            found = {r["file"]: r["change"] for r in diff.collect()}
            changes = {kind: sorted(f for f, c in found.items() if c == kind) for kind in ("added", "changed", "deleted")}
            files = sorted(found)
            modules = {module_of(f) for f in files}
            fresh = parse_sources(read_files(diff.where("change <> 'deleted'"), root, differing))
            touched = {bucket_of(m, manifest["tables"]["parsed"]["buckets"]) for m in modules}
            kept = self._read(manifest, "parsed", only=touched).where(~F.col("file").isin(files))
            parsed = self.store.replace("parsed", manifest["tables"]["parsed"], kept.unionByName(fresh), touched, "file")
            affected, (published, stale) = at_once(lambda: self._write_set(manifest, named), lambda: self._refresh(manifest, parsed, files, modules, version, root))
        else:
            changes = {kind: Files(diff.where(F.col("change") == kind)) for kind in ("added", "changed", "deleted")}
            fresh = parse_sources(read_files(diff.where("change <> 'deleted'"), root))
            kept = self._read(manifest, "parsed").join(named.hint("merge"), "file", "left_anti")
            parsed = self.store.write("parsed", kept.unionByName(fresh), "module", manifest["tables"]["parsed"]["buckets"], "file")
            affected, published = at_once(lambda: self._write_set(manifest, named), lambda: self._derive(parsed, version, root))
            stale = published["totals"]["keys"]
        gone = diff.where("change = 'deleted'").select("file")
        reparsed = affected.union(diff.where("change <> 'deleted'").select("file")).distinct().join(gone.hint("merge"), "file", "left_anti")
        importers = affected.join(named.hint("merge"), "file", "left_anti")
        reparsed_files, importers_files = at_once(lambda: self._files(reparsed), lambda: self._files(importers))
        return {
            "mode": "incremental", **changes, "reparsed_files": reparsed_files, "importers_files": importers_files,
            "resolved_keys": stale, "all_keys": published["totals"]["keys"], **self._counts(published),
        }

    def _refresh(self, manifest: dict, parsed_table: dict, files: list[str], modules: set[str], version: int, root: str) -> tuple[dict, int]:
        """The tables that follow from new parsed files, by what changed in them; what is published, and how many keys were resolved again."""
        store, tables, buckets = self.store, manifest["tables"], parsed_table["buckets"]
        own = {bucket_of(m, buckets) for m in modules}
        is_file, is_module = F.col("file").isin(files), F.col("module").isin(sorted(modules))
        parsed = lambda only=None: store.read(parsed_table, PARSED, only=only)
        present = lambda df: {r[0] for r in df.where(is_module).select("module").distinct().collect()}
        symbols_now = delta.symbols_of(parsed(own).where(is_file))
        kept_symbols = self._read(manifest, "symbols", only=own).where(~is_file)

        def changed() -> delta.Changes:
            was = self._read(manifest, "symbols", only=own).where(is_file)
            before, after = present(self._read(manifest, "parsed", only=own)), present(parsed(own))
            return delta.changes_between(was, symbols_now, before, after)

        def docs() -> dict:
            rows = self._read(manifest, "docs", only=own).where(~is_file).unionByName(_documents(parsed(own).where(is_file)))
            table = store.replace("docs", tables["docs"], rows, own, "ord")
            return {"docs": table, **self._segment(manifest, store.read(table, STORED_DOC, only=own).where(is_file), store.read(table, STORED_DOC), files, version)}

        changes, symbols_table, made = at_once(changed, lambda: store.replace("symbols", tables["symbols"], kept_symbols.unionByName(symbols_now), own, "name"), docs)
        symbols = store.read(symbols_table, delta.SYMBOL)

        def nodes() -> dict:
            ids, files_of = F.col("id").isin(sorted(changes.ids)), F.col("id").isin(sorted(modules))
            only = {bucket_of(i, buckets) for i in {*changes.ids, *modules}}
            gone = F.when(F.col("label") == "File", files_of).otherwise(ids)
            fresh = delta.file_nodes(parsed(own).where(is_module)).unionByName(delta.symbol_nodes(symbols.where(F.col("fqn").isin(sorted(changes.ids)))))
            return {"nodes": store.replace("nodes", tables["nodes"], self._read(manifest, "nodes", only=only).where(~gone).unionByName(fresh), only, "id")}

        found: dict = {}

        def edges() -> dict:
            stale = cut_lineage(delta.stale_keys(self._read(manifest, "keys"), changes))
            # numbers of buckets, whatever the input
            others = {r[0] for r in stale.select(bucket_column("module", buckets)).distinct().collect()}
            importers = self.spark.createDataFrame([], "module string")
            if changes.came_or_went:
                importers = cut_lineage(last_imports(parsed()).where(F.col("imported").isin(sorted(changes.came_or_went))).select("module").distinct())
                others |= {r[0] for r in importers.select(bucket_column("module", buckets)).distinct().collect()}
            reach = own | others
            near = parsed(reach)
            calls = delta.calls_of(near)
            named = stale.select("module", F.col("chain").alias("callee_chain"))
            calls = calls.where(is_module).unionByName(calls.where(~is_module).join(named, ["module", "callee_chain"], "left_semi").select(calls.columns))
            fresh = cut_lineage(delta.resolved(delta.keys_of(calls), symbols, last_imports(near)))
            found["n"] = fresh.count()
            pairs = stale.select("module", "chain")
            kept = self._read(manifest, "keys", only=reach).where(~is_module).join(pairs, ["module", "chain"], "left_anti")
            targets = symbols.join(fresh.select(F.col("target").alias("fqn")).distinct(), "fqn", "left_semi")
            importing = near.where(is_module).unionByName(near.where(~is_module).join(importers, "module", "left_semi").select(near.columns))
            added = delta.call_edges(calls, fresh, delta.labels_of(targets)).unionByName(delta.own_edges(store.read(symbols_table, delta.SYMBOL, only=own).where(is_module))).unionByName(delta.import_edges(importing, parsed().select("module")))
            added = cut_lineage(added)
            before = self._read(manifest, "edges", only=reach)
            stay = delta.staying(before, changes.modules, importers, pairs)
            gone = before.select("dst").exceptAll(stay.select("dst"))
            ends = {r[0] for r in added.select("dst").union(gone).select(bucket_column("dst", buckets)).distinct().collect()}
            stay_in = delta.staying(self._read(manifest, "edges_in", only=ends), changes.modules, importers, pairs)
            keys_table, edges_table, in_table = at_once(
                lambda: store.replace("keys", tables["keys"], kept.select(fresh.columns).unionByName(fresh), reach, "chain"),
                lambda: store.replace("edges", tables["edges"], stay.unionByName(added), reach, "src"),
                lambda: store.replace("edges_in", tables["edges_in"], stay_in.unionByName(added), ends, "dst"),
            )
            return {"keys": keys_table, "edges": edges_table, "edges_in": in_table}

        made = {**made, "parsed": parsed_table, "symbols": symbols_table}
        for part in at_once(nodes, edges):
            made |= part
        return self._publish(made, version, root), found["n"]

    def _segment(self, manifest: dict, changed: DataFrame, every: DataFrame, files: list[str], version: int) -> dict:
        """The search index with a segment for the ``changed`` documents, or merged, of ``every`` document, once there are many."""
        old = {name: t for name, t in manifest["tables"].items() if name.startswith("postings")}
        buckets = next(iter(old.values()))["buckets"]
        if len(old) >= MOST_SEGMENTS:
            return self._index(every, version, buckets)
        dead = self._read(manifest, "dead").unionByName(self.spark.createDataFrame([(f, version) for f in files], SCHEMAS["dead"]))
        dead = dead.groupBy("file").agg(F.max("upto").alias("upto"))
        segment, dead_table = at_once(
            lambda: self.store.write("postings", retrieval.stored_postings(changed, version), "term", buckets, "term"), lambda: self.store.write("dead", dead, "file", 1)
        )
        return {**old, f"postings{version}": segment, "dead": dead_table}

    def _files(self, names: DataFrame) -> list[str] | Files:
        """``names`` (file), in order."""
        first = names.limit(MOST_CHANGED + 1).collect()
        return sorted(r["file"] for r in first) if len(first) <= MOST_CHANGED else Files(cut_lineage(names))

    def _write_set(self, manifest: dict, changed: DataFrame) -> DataFrame:
        """(file): those to look at anew, of the version's, when ``changed`` (file) changed."""
        nodes, edges = self._read(manifest, "nodes"), self._read(manifest, "edges")
        file_of = nodes.where("label = 'File'").select(F.col("id").alias("module"), "file")
        imports = edges.where("rel_table = 'R_IMPORTS'").join(file_of.toDF("src", "a").hint("merge"), "src").join(file_of.toDF("dst", "b").hint("merge"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        owners = nodes.where("label <> 'File'").select("id", "file")
        return cut_lineage(traverse.write_set(imports, edges.where(CALLS), owners, changed, self._read(manifest, "parsed").select("file")))

    # ---- asking

    def calls(self) -> DataFrame:
        return self.table("edges").where(CALLS).select("src", "dst", "confidence")

    def reach(self, symbol: str, depth: int, reverse: bool = False) -> list[dict]:
        """{id, parent, depth, confidence} of what is up to ``depth`` calls away, in order of depth and id.

        Each level reads the buckets and rows of its frontier alone. A level of more than MOST_IDS symbols is left to the
        traversal of the whole table.
        """
        manifest = self._manifest()
        near, far, table = ("dst", "src", "edges_in") if reverse else ("src", "dst", "edges")
        seen, frontier, out = {symbol}, [symbol], []
        for level in range(1, depth + 1):
            # what a symbol calls lies with its module: one of its id's beginnings
            keys = frontier if reverse else {".".join(i.split(".")[:n]) for i in frontier for n in range(i.count(".") + 2)}
            edges = self._read(manifest, table, keys).where(CALLS).where(F.col(near).isin(frontier) & (F.col(near) != F.col(far)))
            first = F.min(F.struct(F.col(near).alias("parent"), "confidence")).alias("first")
            rows = edges.groupBy(F.col(far).alias("id")).agg(first).select("id", "first.*").limit(len(seen) + MOST_IDS + 1).collect()
            rows = sorted(({"id": r["id"], "parent": r["parent"], "depth": level, "confidence": r["confidence"]} for r in rows if r["id"] not in seen), key=lambda r: r["id"])
            if len(rows) > MOST_IDS:
                found = traverse.reach(self.calls(), self._one(symbol), depth, reverse).orderBy("depth", "id")
                return [r.asDict() for r in found.collect()]
            out += rows
            frontier = [r["id"] for r in rows]
            seen.update(frontier)
            if not frontier:
                break
        return out

    def _one(self, symbol: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(symbol).alias("id"))

    def callers(self, symbol: str, depth: int = 2) -> list[dict]:
        return [{"caller": r["id"], "callee": r["parent"], "depth": r["depth"], "confidence": r["confidence"]} for r in self.reach(symbol, depth, reverse=True)]

    def callees(self, symbol: str, depth: int = 2) -> list[dict]:
        return [{"caller": r["parent"], "callee": r["id"], "depth": r["depth"], "confidence": r["confidence"]} for r in self.reach(symbol, depth)]

    def impact(self, symbol: str, depth: int = 2) -> dict:
        up, down = at_once(lambda: self.reach(symbol, depth, reverse=True), lambda: self.reach(symbol, depth))
        return report.assembled(symbol, depth, up, down)

    def context(self, symbol: str) -> dict:
        up, down = at_once(lambda: self.reach(symbol, 1, reverse=True), lambda: self.reach(symbol, 1))
        return {"symbol": symbol, "callers": [r["id"] for r in up], "callees": [r["id"] for r in down]}

    def symbols(self, fragment: str = "", limit: int = 50) -> list[dict]:
        nodes = self.table("nodes")
        found = graph.search_symbols(nodes, fragment, limit) if fragment else nodes.where("label <> 'File'").orderBy(F.desc("label"), "id").limit(limit)
        return [{"id": r["id"], "label": r["label"], "name": r["name"], "file": r["file"]} for r in found.collect()]

    def postings(self, terms: list[str], manifest: dict | None = None) -> DataFrame:
        """POSTING of the terms, from all segments; only the terms' buckets are read. Rows of documents that a later segment has, or that are gone, are left out."""
        manifest, terms = manifest or self._manifest(), sorted(set(terms))
        rows = None
        for name in sorted(n for n in manifest["tables"] if n.startswith("postings")):
            found = self._read(manifest, name, keys=terms).where(F.col("term").isin(terms))
            rows = found if rows is None else rows.unionByName(found)
        dead = self._read(manifest, "dead")
        return rows.join(dead, (rows["file"] == dead["file"]) & (rows["seg"] < dead["upto"]), "left_anti")

    def search(self, query: str, k: int = 10) -> dict:
        """Hybrid search; with a model its vectors, with a backend its ids, without either BM25 alone."""
        manifest = self._manifest()
        terms, totals = retrieval.query_terms(query), manifest["totals"]
        docs = self.table("docs", manifest)
        scored = retrieval.bm25_stored(self.postings(terms, manifest), docs, query, totals["docs"], totals["terms"]) if terms else retrieval.bm25(docs, query)
        lists, mode = {"bm25": retrieval.top(scored, 3 * k)}, "bm25"
        if query.strip() and self.backend is not None:
            named = [(i, n) for n, i in enumerate(self.backend(query, 3 * k), 1)]
            lists["semantic"], mode = self.spark.createDataFrame(named, "id string, rank int"), "hybrid"
        elif query.strip() and self.model is not None:
            vectors = retrieval.embed(docs, self.model)
            lists["semantic"], mode = retrieval.top(retrieval.cosine(vectors, [float(x) for x in self.model([query])[0]]), 3 * k), "hybrid"
        found = retrieval.fused_with_names(lists, docs, k)
        return {"query": query, "mode": mode, "results": [r.asDict() for r in found.orderBy("rank").collect()]}

    def stats(self) -> dict:
        manifest = self._manifest()
        nodes, edges = manifest["totals"]["nodes"], dict(manifest["totals"]["edges"])
        languages = graph.language_counts(self.table("parsed", manifest).select(F.col("file").alias("path"))).collect()
        total = edges.pop("(all)", 0)
        return {"files": nodes.get("File", 0), "functions": nodes.get("Function", 0), "classes": nodes.get("Class", 0), "edges": edges, "total_edges": total, "languages": {r["language"]: r["n"] for r in languages}, "db": self.db, "repo": manifest.get("repo", "")}

    def modules(self, most: int = 40) -> list[dict]:
        return [r.asDict() for r in graph.module_rollup(self.table("parsed").select(F.col("file").alias("path")), most).collect()]

    def subgraph(self, seed: str | None = None, depth: int = 1, limit: int = 200) -> dict:
        """Nodes and edges around ``seed``, or the layer of files and classes to begin with.

        Around a seed, each node shows its first ``limit`` neighbours of each table and direction; edges stand in both orientations.
        """
        manifest = self._manifest()
        if seed is None:
            shown, links = graph.seed_layer(self.table("nodes", manifest), self.table("edges", manifest), limit)
            shown = shown.select("id", "label", "name", "file").collect()
            pairs = {(r["src"], r["dst"], r["type"]) for r in links.select("src", "dst", "type").collect()}
        else:
            seen, frontier, pairs = {seed}, [seed], set()
            for _ in range(max(1, depth)):
                found = [(r["node"], r["other"], r["type"]) for r in self._first_neighbours(manifest, frontier, limit).collect()]
                pairs |= {p for a, b, kind in found for p in ((a, b, kind), (b, a, kind))}
                frontier = sorted({b for _, b, _ in found} - seen)
                seen.update(frontier)
                if not frontier:
                    break
            nodes = self._read(manifest, "nodes", seen) if len(seen) <= MOST_IDS else self.table("nodes", manifest)
            shown = graph.look_up(nodes, self._ids(seen)).collect()
        rows = sorted((r["id"], r["label"], r["name"], r["file"]) for r in shown)
        return {"nodes": [dict(zip(("id", "label", "name", "file"), r)) for r in rows], "edges": [dict(zip(("from", "to", "type"), p)) for p in sorted(pairs)]}

    def _ids(self, ids) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in sorted(ids)], "id string")

    def _first_neighbours(self, manifest: dict, nodes: list[str], limit: int) -> DataFrame:
        """Of each of the ``nodes`` its first neighbours of each table and direction; up to MOST_IDS nodes read their own buckets alone."""
        few, ids = len(nodes) <= MOST_IDS, self._ids(nodes)
        modules = {".".join(i.split(".")[:n]) for i in nodes for n in range(i.count(".") + 2)} if few else None
        out, into = self._read(manifest, "edges", modules), self._read(manifest, "edges_in", nodes if few else None)
        if few:
            out, into = out.where(F.col("src").isin(nodes)), into.where(F.col("dst").isin(nodes))
        else:
            out, into = out.join(ids.toDF("src"), "src", "left_semi"), into.join(ids.toDF("dst"), "dst", "left_semi")
        near = traverse.first_neighbours(out.unionByName(into), limit)
        return near.join(ids.toDF("node"), "node", "left_semi")

    # ---- payloads for tools

    def impact_payload(self, symbol: str, depth: int = 2) -> str:
        return json.dumps(self.impact(symbol, depth), ensure_ascii=False)

    def context_payload(self, symbol: str) -> str:
        return json.dumps(self.context(symbol), ensure_ascii=False)

    def query_payload(self, fragment: str, limit: int = 10) -> str:
        return json.dumps({"query": fragment, "matches": self.symbols(fragment, limit)}, ensure_ascii=False)

    def semantic_search_payload(self, query: str, k: int = 8) -> str:
        return json.dumps(self.search(query, k), ensure_ascii=False)

    def tools(self) -> dict[str, Callable[..., str]]:
        """The questions as functions that give JSON, by name, for programs that call tools."""
        return {"impact": self.impact_payload, "context": self.context_payload, "query": self.query_payload, "semantic_search": self.semantic_search_payload}


def _documents(parsed: DataFrame) -> DataFrame:
    return delta.document_rows(parsed).withColumn("dl", F.size(code.tokens(F.col("text"))))
