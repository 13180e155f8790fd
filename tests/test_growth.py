"""Steps whose work must grow with their input: what joins give, what plans read again, what a task holds."""

from __future__ import annotations

import json

import pyarrow as pa

from sparkloom import session as sessions
from sparkloom.operators import graph, resolve, retrieval, traverse
from sparkloom.operators.build import build_graph
from sparkloom.sources import repository


def executed(node):
    """All nodes of a plan that has run, reused exchanges once."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from executed(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from executed(node.plan())
    elif name != "ReusedExchangeExec":
        yield node
        for i in range(node.children().size()):
            yield from executed(node.children().apply(i))


def run(df):
    """The rows of ``df`` and the nodes of its plan."""
    return df.collect(), list(executed(df._jdf.queryExecution().executedPlan()))


def joined_rows(nodes) -> int:
    return max(n.metrics().apply("numOutputRows").value() for n in nodes if "Join" in n.getClass().getSimpleName())


def test_repeated_imports_and_symbols_meet_a_key_once(spark):
    symbols = spark.range(200).selectExpr("id seq", "'b' module", "'f' name", "'function' kind", "concat('C', id, '.f') qualified_name")
    imports = spark.range(200).selectExpr("'a' module", "200 - id ord", "'b' imported", "'b' name", "cast(null as string) alias")
    keys = resolve.call_keys(spark.createDataFrame([("a", "b.f"), ("a", "b.g")], "module string, callee_chain string"))
    rows, nodes = run(resolve.resolve_import(keys, symbols, imports))
    assert [tuple(r) for r in rows] == [("a", "b.f", "b.C0.f")]
    assert joined_rows(nodes) <= 2


def test_files_are_parsed_once(spark):
    parsed = repository.parse_sources(spark.createDataFrame([("a.py", bytearray(b"def f():\n    f()\n"))], "file string, content binary"))
    rows, nodes = run(build_graph(parsed).edges.where("type = 'CALLS'").select("src", "dst"))
    assert [tuple(r) for r in rows] == [("a.f", "a.f")]
    assert not [n for n in nodes if "InArrow" in n.getClass().getSimpleName()]


def test_tables_that_grow_are_not_sent_to_the_driver(spark):
    symbols = spark.range(200).selectExpr("id seq", "'b' module", "concat('f', id) name", "'function' kind", "concat('f', id) qualified_name")
    imports = spark.createDataFrame([("a", 0, "b", "b", None)], "module string, ord int, imported string, name string, alias string")
    calls = spark.range(200).selectExpr("'a' module", "'x' caller", "concat('b.f', id) callee_chain")
    rows, nodes = run(resolve.resolve_calls(calls, symbols, imports).select("callee_chain", "target"))
    assert {tuple(r) for r in rows} == {(f"b.f{i}", f"b.f{i}") for i in range(200)}
    sent = [n.metrics().apply("numOutputRows").value() for n in nodes if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    assert not sent


def test_few_files_are_held_as_rows(monkeypatch):
    found = []

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, rows, _):
            contents = pa.RecordBatch.from_pydict({"file": [f"{i}.py" for i in range(1000)], "content": [b"x = 1\n"] * 1000})
            found.extend(b.num_rows for b in rows(iter([contents])))

    repository.parse_sources(Files())
    assert sum(found) == 1000 and max(found) <= repository.AT_ONCE


def dealt_rows(nodes) -> int:
    return sum(n.metrics().apply("shuffleRecordsWritten").value() for n in nodes if n.getClass().getSimpleName() == "ShuffleExchangeExec")


def test_repeats_and_first_neighbours_take_one_deal(spark):
    edges = spark.range(400).selectExpr("concat('n', id % 20) src", "concat('m', id) dst", "'T' type", "'R' rel_table")
    rows, nodes = run(traverse.first_neighbours(edges, 1))
    assert len(rows) == 420
    # every edge both ways once, and the first ones of each part
    assert dealt_rows(nodes) <= 800 + 20 * traverse.PARTS + 400


def test_edges_away_from_an_ego_network_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(traverse, "cut_lineage", lambda df: written.append(df.count()) or df)
    edges = spark.range(1000).selectExpr("concat('n', id) src", "concat('n', id + 1) dst", "'T' type")
    nodes, links = traverse.ego_network(edges, spark.createDataFrame([("n5",)], "id string"), 2)
    assert {tuple(r) for r in nodes.collect()} == {("n5", 0), ("n4", 1), ("n6", 1), ("n3", 2), ("n7", 2)}
    assert links.count() == 8 and max(written) <= 4


def test_edges_are_dealt_before_they_are_counted(spark):
    edges = spark.range(600).selectExpr("'T' type", "concat('n', id % 500) src", "'m' dst")
    for of, wanted in ((graph.multi_edges, {("T", f"n{i}", "m", 2) for i in range(100)}), (graph.graph_signature, {("T", 600, 500)})):
        rows, nodes = run(of(edges))
        assert {tuple(r) for r in rows} == wanted
        # no task groups edges before the deal, and no partition is put together of several
        deals = [n for n in nodes if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
        first = deals[-1]
        assert not [n for n in executed(first.child()) if "Aggregate" in n.getClass().getSimpleName()]
        assert first.outputPartitioning().numPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edges_of_a_closure_are_derived_once(spark):
    derived = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    edges = spark.range(300).selectExpr("concat('n', id + 1) src", "concat('n', id) dst").mapInArrow(counted, "src string, dst string")
    for one_task in (299, 300):
        derived.value = 0
        found = traverse.closure(edges, spark.createDataFrame([("n290",)], "id string"), one_task)
        assert {r.id for r in found.collect()} == {f"n{i}" for i in range(290, 301)}
        assert derived.value == 300


def test_terms_are_found_once_and_counted_where_their_document_lies(spark):
    texts = [(i, f"{i}", "f", "the red fox and one red fox 9x" if i % 2 else "The only_one " * 3) for i in range(40)] + [(1, "1", "f", "fox"), (41, "41", "f", None), (None, "x", "f", "fox fox")]
    docs = spark.createDataFrame(texts, "ord long, id string, file string, text string").repartition(2)
    rows, nodes = run(retrieval.postings(docs))
    odd = {(t, i, n) for i in range(1, 40, 2) for t, n in (("red", 2), ("fox", 3 if i == 1 else 2), ("one", 1))}
    assert sorted(map(str, rows)) == sorted(f"Row(term={t!r}, ord={i}, tf={n})" for t, i, n in odd | {("only_one", i, 3) for i in range(0, 40, 2)} | {("fox", None, 2)})
    stored, more = run(retrieval.stored_postings(docs, 0).where("ord > 1"))
    assert {(r.term, r.ord, r.tf, r.dl) for r in stored} == {(t, i, n, 5 if i % 2 else 3) for t, i, n in odd | {("only_one", i, 3) for i in range(0, 40, 2)} if i > 1}
    for found in (nodes, more):
        # texts are dealt, not their terms, and no condition finds the terms once more
        assert sum("hashpartitioning" in n.outputPartitioning().toString() for n in found if n.getClass().getSimpleName() == "ShuffleExchangeExec") == 1
        assert dealt_rows(found) <= 2 * len(texts)
        assert not [n for n in found if n.getClass().getSimpleName() == "FilterExec" and "regexp_extract_all" in n.toString()]


def test_many_changed_files_alone_are_opened_again_by_many_tasks(spark, tmp_path, monkeypatch):
    root, parsed = tmp_path / "r", []
    (root / "a").mkdir(parents=True)
    for i in range(12):
        (root / "a" / f"f{i}.py").write_text(f"def g{i}():\n    g{i}()\n")
    graph_of = sessions.SourceGraph(spark, str(tmp_path / "db"))
    graph_of.analyze(str(root))
    monkeypatch.setattr(sessions, "MOST_CHANGED", 2)
    parse = sessions.parse_sources
    monkeypatch.setattr(sessions, "parse_sources", lambda sources: parsed.append(sources) or parse(sources))
    for i in range(3, 9):
        (root / "a" / f"f{i}.py").write_text(f"def h{i}():\n    h{i}()\n")
    (root / "a" / "f11.py").unlink()
    result = graph_of.analyze(str(root))
    assert result["changed"] == [f"a/f{i}.py" for i in range(3, 9)] and result["deleted"] == ["a/f11.py"]
    edges = graph_of.table("edges").where("type = 'CALLS'").collect()
    assert {(r.src, r.dst) for r in edges} == {(f"a.f{i}.{x}{i}",) * 2 for i in range(11) for x in ("h" if 3 <= i < 9 else "g")}
    again = parsed[-1]
    assert {r.file for r in again.collect()} == {f"a/f{i}.py" for i in range(3, 9)}
    plan = again._jdf.queryExecution().toString()
    assert "source_repo" not in plan and "Join" not in plan
    assert again.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_listing_looks_at_each_source_once(tmp_path, monkeypatch):
    (tmp_path / "p" / ".hidden").mkdir(parents=True)
    (tmp_path / "p" / "d.py").mkdir()
    for name in ("p/a.py", "p/d.py/b.ts", "p/.hidden/c.py", "p/.e.py", "p/f.txt", "__init__.py"):
        (tmp_path / name).write_text("x")
    (tmp_path / "p" / "link.py").symlink_to(tmp_path / "p" / "f.txt")
    (tmp_path / "p" / "broken.py").symlink_to(tmp_path / "none")
    (tmp_path / "p" / "folder").symlink_to(tmp_path / "p" / "d.py")
    looked, real = [], repository.Path.stat
    monkeypatch.setattr(repository.Path, "stat", lambda self, **k: looked.append(self) or real(self, **k))
    assert repository.listing(str(tmp_path)) == {"p/a.py": 1, "p/d.py/b.ts": 1, "p/link.py": 1, "__init__.py": 1}
    assert len(looked) <= 5


def sent_since(spark, first: int) -> list[int]:
    """Rows of each broadcast of the SQL executions from number ``first`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows = []
    for at in range(store.executionsList().size()):
        id = store.executionsList().apply(at).executionId()
        nodes, values = store.planGraph(id).allNodes(), store.executionMetrics(id)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if id >= first and node.name() == "BroadcastExchange":
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return rows


def next_execution(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    list_of = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((list_of.apply(i).executionId() for i in range(list_of.size())), default=-1) + 1


def test_levels_are_broadcast_only_while_they_are_short(spark, monkeypatch):
    monkeypatch.setattr(traverse, "MOST_SENT", 50)
    # each node leads to one nearer the middle, so levels double
    edges = spark.range(1, 1000).selectExpr("concat('n', id) src", "concat('n', id div 2) dst").union(spark.range(1, 1000).selectExpr("concat('n', id) src", "concat('n', id div 3) dst"))
    first = next_execution(spark)
    assert traverse.closure(edges, spark.createDataFrame([("n0",)], "id string"), 0).count() == 1000
    near = traverse.reach(edges, spark.createDataFrame([("n1",)], "id string"), 9, reverse=True)
    assert near.count() == 998 and near.where("depth = 1").count() == 4
    assert max(sent_since(spark, first), default=0) <= 50


def test_a_large_update_keeps_files_out_of_the_driver(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    (root / "a" / "b").mkdir(parents=True)
    place = lambda i: root / ("a/b" if i % 2 else "a") / f"f{i}.py"
    for i in range(12):
        place(i).write_text(f"from a.f{i // 4 * 2} import g{i // 4 * 2}\n\ndef g{i}():\n    g{i // 4 * 2}()\n    g{i}()\n")

    def listed(*_):
        raise AssertionError("listed in the driver")

    monkeypatch.setattr(repository.os, "walk", listed)
    monkeypatch.setattr(sessions, "MOST_CHANGED", 2)
    monkeypatch.setattr("sparkloom.operators.delta.MOST_SENT", 0)
    monkeypatch.setattr(traverse, "MOST_SENT", 0)
    first = next_execution(spark)
    graph_of = sessions.SourceGraph(spark, str(tmp_path / "db"))
    assert graph_of.analyze(str(root))["files"] == 12
    for i in range(2, 6):
        place(i).write_text(f"def h{i}():\n    h{i}()\n")
    place(0).unlink()
    place(20).write_text("def g20():\n    g20()\n")
    result = graph_of.analyze(str(root))
    names = lambda *at: sorted(place(i).relative_to(root).as_posix() for i in at)
    assert result["changed"] == names(2, 3, 4, 5) and result["changed"] != names(2, 3, 4, 6) and isinstance(result["changed"], sessions.Files)
    assert len(result["changed"]) == 4 and "a/f2.py" in result["changed"] and "a/f0.py" not in result["changed"] and result["changed"][-1] == names(2, 3, 4, 5)[-1]
    assert result["added"] == ["a/f20.py"] and result["deleted"] == ["a/f0.py"]
    # all others import or call one of them
    assert result["importers_files"] == names(1, 6, 7, 8, 9, 10, 11) and result["reparsed_files"] == names(*range(1, 12), 20)
    assert json.loads(json.dumps(result, default=list))["reparsed_files"] == names(*range(1, 12), 20)
    nodes = graph_of.table("nodes").where("label = 'Function'").collect()
    assert {(r.name, r.file) for r in nodes} == {(f"{'h' if 2 <= i < 6 else 'g'}{i}", names(i)[0]) for i in (*range(1, 12), 20)}
    assert not sent_since(spark, first)
