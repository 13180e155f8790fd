"""Versions, recovery and updates of a stored graph; its index; closures; the source's conditions; parsers of one's own."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, retrieval, traverse
from sparkloom.session import SourceGraph
from sparkloom.sources import languages
from sparkloom.sources.languages import Parsed
from sparkloom.sources.languages.python import parse_python
from sparkloom.sources.repository import RepositoryReader, listing, parse_sources, read_repository, shares
from sparkloom.store import Conflict, Store, bucket_column, bucket_of

SCHEMA = "k string, n int"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def put(store, rows, version):
    return store.publish({"t": store.write("t", store.spark.createDataFrame(rows, SCHEMA), "k", 16)}, version=version)


def rows_of(store, manifest, **chosen):
    return sorted(map(tuple, store.read(manifest["tables"]["t"], SCHEMA, **chosen).collect()))


def test_buckets_and_versions(store):
    rows = [(f"k{i}", i) for i in range(60)] + [("hot", i) for i in range(500)]
    first = put(store, rows, 0)
    assert rows_of(store, store.newest(checked=True)) == sorted(rows)
    mine = rows_of(store, first, keys=["k7"])
    assert ("k7", 7) in mine and {bucket_of(k, 16) for k, _ in mine} == {bucket_of("k7", 16)}
    buckets = {bucket_of("k7", 16)}
    table = store.replace("t", first["tables"]["t"], store.spark.createDataFrame([r if r[0] != "k7" else ("k7", -7) for r in mine], SCHEMA), buckets)
    second = store.publish({"t": table}, version=1)
    assert rows_of(store, second) == sorted(r if r[0] != "k7" else ("k7", -7) for r in rows)
    # buckets that didn't change are the old files
    same = [b for b, files in table["files"].items() if files == first["tables"]["t"]["files"].get(b)]
    assert len(same) == len(table["files"]) - 1
    # old versions stay readable until they are cleared away
    assert rows_of(store, first) == sorted(rows)
    assert store.vacuum(keep=1) == [0] and rows_of(store, store.newest(checked=True)) == rows_of(store, second)


def test_of_two_writers_one_wins(store):
    put(store, [("a", 1)], 0)
    with pytest.raises(Conflict):
        put(store, [("b", 2)], 0)
    assert rows_of(store, store.newest()) == [("a", 1)]


def test_unpublished_rows_are_not_seen(store):
    put(store, [("a", 1)], 0)
    store.write("t", store.spark.createDataFrame([("lost", 9)], SCHEMA), "k", 16)
    assert rows_of(store, store.newest()) == [("a", 1)] and store.next_version() == 1


def test_damage_leads_to_the_version_before(store):
    put(store, [("a", 1)], 0)
    second = put(store, [("b", 2)], 1)
    name = next(iter(second["tables"]["t"]["files"].values()))[0][0]
    with open(f"{store.folder}/{name}", "ab") as f:
        f.write(b"x")
    assert store.newest(checked=True)["version"] == 0
    third = put(store, [("c", 3)], 2)
    with open(glob.glob(f"{store.folder}/manifests/*2.json")[0], "r+") as f:
        f.truncate(40)
    assert third["version"] == 2 and store.newest()["version"] == 1 and store.next_version() == 3


def test_buckets_agree_with_the_driver(spark):
    names = ["", "a", "é.b", "x" * 99]
    got = spark.createDataFrame([(n,) for n in names], "k string").select("k", bucket_column("k", 64).alias("b")).collect()
    assert [(r["k"], r["b"]) for r in got] == [(n, bucket_of(n, 64)) for n in names]


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        if text is None:
            os.remove(path)
            continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def some_file(rng, n):
    """A file that defines, imports and calls some of few names, so that what is unique changes often."""
    names = [f"f{i}" for i in range(8)]
    lines = [f"from m{rng.randrange(n)} import {rng.choice(names)} as {rng.choice(names)}" for _ in range(rng.randrange(3))]
    for _ in range(rng.randrange(1, 4)):
        calls = "\n".join(f"    {rng.choice(['', f'{rng.choice(names)}.'])}{rng.choice(names)}()" for _ in range(3))
        lines.append(rng.choice([f"def {rng.choice(names)}():\n{calls}", f"class {rng.choice(names)}:\n    def {rng.choice(names)}(self):\n" + calls.replace("    ", "        ")]))
    return "\n\n".join(lines) + "\n"


def test_random_updates_equal_full_builds(spark, tmp_path):
    rng, n = random.Random(11), 12
    root = str(tmp_path / "repo")
    write(root, {f"m{i}.py": some_file(rng, n) for i in range(n)} | {"m1/__init__.py": some_file(rng, n)})
    session = SourceGraph(spark, str(tmp_path / "db"))
    session.analyze(root)
    for step in range(2):
        present = sorted(listing(root))
        changed = {rng.choice(present): some_file(rng, n), f"m{rng.randrange(n)}.py": some_file(rng, n)}
        if step % 2:
            changed[rng.choice([p for p in present if p not in changed])] = None
        write(root, changed)
        status = session.analyze(root)
        whole = SourceGraph(spark, str(tmp_path / f"whole{step}"))
        full = whole.analyze(root)
        assert {k: status[k] for k in full if k != "mode"} == {k: v for k, v in full.items() if k != "mode"}
        for name in ("nodes", "edges", "edges_in", "docs", "keys"):
            assert graph.same_rows(session.table(name), whole.table(name)), (step, name)
    # a damaged version is passed over, and the next update starts from the one before
    newest = session.store.newest()
    name = next(iter(newest["tables"]["edges"]["files"].values()))[0][0]
    os.truncate(f"{session.db}/{name}", 3)
    assert session.analyze(root)["mode"] == "incremental"
    assert graph.same_rows(session.table("edges"), whole.table("edges"))


def test_a_small_change_touches_few_keys(spark, tmp_path):
    root = str(tmp_path / "repo")
    write(root, {f"m{i}.py": f"from m{(i + 1) % 60} import g{(i + 1) % 60}\n\ndef g{i}(x):\n    return g{(i + 1) % 60}(x)\n\ndef h{i}(x):\n    return g{i}(h{i}(x))\n" for i in range(60)})
    session = SourceGraph(spark, str(tmp_path / "db"))
    session.analyze(root)
    write(root, {"m3.py": "from m4 import g4\n\ndef g3(x):\n    return g4(x)\n\ndef added():\n    return g3(1)\n"})
    status = session.analyze(root)
    assert status["resolved_keys"] < 0.05 * status["all_keys"]
    assert status["changed"] == ["m3.py"] and len(status["reparsed_files"]) == 60
    # the index has a segment more; what is gone isn't found, what is new is
    assert sum(name.startswith("postings") for name in session.store.newest()["tables"]) == 2
    assert [r["id"] for r in session.search("added", 3)["results"]] == ["m3.added"]
    assert "m3.h3" not in [r["id"] for r in session.search("h3", 5)["results"]]
    # index and texts give the same scores
    docs, totals = session.table("docs"), session.store.newest()["totals"]
    for query in ("g3 return", "def h7 g7 g7", "nothing such"):
        left = retrieval.bm25_stored(session.postings(retrieval.query_terms(query)), docs, query, totals["docs"], totals["terms"])
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, retrieval.bm25(docs, query).collect())), query
    plan = session.postings(["g3"])._jdf.queryExecution().toString()
    assert "EqualTo(term,g3)" in plan
    # buckets of other terms aren't read
    assert len(session.postings(["g3"]).inputFiles()) < len(session._read(session.store.newest(), next(n for n in session.store.newest()["tables"] if n.startswith("postings"))).inputFiles())


def plain_closure(edges, seeds):
    seen = set(seeds)
    while True:
        more = {a for a, b in edges if b in seen} - seen
        if not more:
            return seen
        seen |= more


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_closure_on_random_graphs(spark, one_task):
    rng = random.Random(6)
    for n, m in ((15, 14), (15, 30)):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        edges, seeds = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n0",), ("n1",)], "id string")
        assert {r[0] for r in traverse.closure(edges, seeds, one_task).collect()} == plain_closure([p for p in pairs if p[0] != p[1]], ["n0", "n1"])


@pytest.mark.parametrize("ring", [True, False])
def test_rings_and_paths_close_in_few_rounds(spark, ring, monkeypatch):
    """A thousand files that import each other in turn."""
    rounds, cut = [], traverse.cut_lineage
    monkeypatch.setattr(traverse, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 1000
    edges = spark.range(n if ring else n - 1).select(F.concat(F.lit("f"), "id").alias("src"), F.concat(F.lit("f"), ((F.col("id") + 1) % n).cast("string")).alias("dst"))
    seeds = spark.createDataFrame([("f999",)], "id string")
    assert traverse.closure(edges, seeds, 0).count() == n
    # ten rounds of pointers; the rest is written once each
    assert len(rounds) <= 10 + 9


def test_conditions_reach_the_source(spark, tmp_path):
    write(str(tmp_path / "r"), {f"d{i % 3}/m{i}.py": "x = 1\n" * i for i in range(30)} | {".hidden/x.py": "", "d0/.y.py": "", "d0/notes.txt": "", "d0/__init__.py": ""})
    sources = read_repository(spark, str(tmp_path / "r"))
    assert sources.count() == 31 and len(listing(str(tmp_path / "r"))) == 31
    some = sources.where(F.col("file").isin("d1/m1.py", "d2/m5.py", "none.py"))
    assert sorted(r["file"] for r in some.collect()) == ["d1/m1.py", "d2/m5.py"]
    reader = RepositoryReader(str(tmp_path / "r"), 1 << 20, 4)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert list(reader.pushFilters([IsNotNull(("file",)), EqualTo(("file",), "d1/m1.py")])) == [IsNotNull(("file",))]
    assert [p.files for p in reader.partitions()] == [["d1/m1.py"]]


def test_shares_hold_each_file_once():
    rng = random.Random(1)
    sizes = {f"f{i}": rng.randrange(200_000) for i in range(200)} | {"huge": 5_000_000}
    cut = shares(sizes, 1_000_000, 8)
    assert sorted(f for files in cut for f in files) == sorted(sizes) and 8 <= len(cut) <= 60
    assert shares({}, 10, 4) == []


def test_a_parser_of_ones_own_reaches_executors(spark, monkeypatch):
    def parse_notes(source: bytes, path: str) -> Parsed:
        found = Parsed()
        for i, line in enumerate(source.decode().splitlines(), 1):
            found.add_symbol(line, "function", None, i, i)
        return found

    monkeypatch.setitem(languages.EXTENSIONS, ".note", "note")
    monkeypatch.setitem(languages.PARSERS, "note", parse_notes)
    rows = spark.createDataFrame([("a/b.note", bytearray(b"one\ntwo"))], "file string, content binary")
    got = parse_sources(rows).first()
    assert (got["module"], got["lang"], [s["name"] for s in got["symbols"]]) == ("a.b", "note", ["one", "two"])


BROKEN = '''import os
from a import b

def good(x):
    return b(x)

def bad(x:
    return 1

@decorated
class Left:
    def out(self):
        pass

class C:
    def one(self):
        return good(1)

    def two(self)
        return 2

    def three(self):
        return os.path.join(1)

def texty():
    """text
that begins far out
"""
    return good(3)

def last():
    return good(
        bad(2)
    )
'''


def test_a_broken_file_gives_the_rest():
    found = parse_python(BROKEN.encode(), "m.py")
    assert found.status == "partial"
    assert [(s[2], s[3]) for s in found.symbols] == [("good", 4), ("bad", 7), ("C", 15), ("C.one", 16), ("C.two", 19), ("C.three", 22), ("texty", 25), ("last", 31)]
    assert found.imports == [("os", "os", None, False), ("a", "b", None, True)]
    assert [(c[0], c[2], c[3]) for c in found.calls] == [("good", "b", 5), ("C.one", "good", 17), ("C.three", "os.path.join", 23), ("texty", "good", 29), ("last", "good", 32), ("last", "bad", 33)]
    assert parse_python(b"((((", "m.py").status == "error"


def test_first_neighbours_of_a_hub(spark):
    hub = spark.range(100_000).select(F.lit("hub").alias("src"), F.format_string("n%06d", F.lit(99_999) - F.col("id")).alias("dst"), F.lit("R").alias("rel_table"), F.lit("CALLS").alias("type"))
    got = traverse.first_neighbours(hub.union(hub.limit(5)), 4)
    assert [(r["place"], r["other"]) for r in got.where("node = 'hub'").orderBy("place").collect()] == [(i + 1, f"n{i:06d}") for i in range(4)]
    assert got.where("direction = 'in'").count() == 100_000


def test_subgraph_limits_each_table_and_direction(spark, tmp_path, monkeypatch):
    """A hub shows its first neighbours of each table and direction; the way of many nodes gives the same; an unknown seed gives nothing."""
    root = tmp_path / "repo"
    root.mkdir()
    (root / "hub.py").write_text("".join(f"def part{i}():\n    return 1\n\n\n" for i in range(9)) + "def hub():\n    return " + " + ".join(f"part{i}()" for i in range(9)) + "\n")
    for i in range(7):
        (root / f"user{i}.py").write_text(f"from hub import hub\n\n\ndef use{i}():\n    return hub()\n")
    session = SourceGraph(spark, str(tmp_path / "db"))
    session.analyze(str(root))
    found = session.subgraph("hub.hub", limit=3)
    wanted = {("hub.hub", f"hub.part{i}", "CALLS") for i in range(3)} | {("hub.hub", f"user{i}.use{i}", "CALLS") for i in range(3)} | {("hub.hub", "hub", "CONTAINS")}
    assert {(e["from"], e["to"], e["type"]) for e in found["edges"]} == wanted | {(b, a, kind) for a, b, kind in wanted}
    assert {n["id"] for n in found["nodes"]} == {x for a, b, _ in wanted for x in (a, b)}
    deep = session.subgraph("hub.hub", depth=2, limit=3)
    # at the second level the file shows its first functions and importers, each user its own file
    assert {("user0.use0", "user0", "CONTAINS"), ("hub", "user2", "IMPORTS")} <= {(e["from"], e["to"], e["type"]) for e in deep["edges"]}
    assert ("hub", "user3", "IMPORTS") not in {(e["from"], e["to"], e["type"]) for e in deep["edges"]}
    assert session.subgraph("nowhere") == {"nodes": [], "edges": []}
    monkeypatch.setattr("sparkloom.session.MOST_IDS", 0)
    assert session.subgraph("hub.hub", depth=2, limit=3) == deep
