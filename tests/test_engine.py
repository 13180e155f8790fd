"""The engine from sources to answers, with graphs that are known, and incremental against full builds."""

from __future__ import annotations

import os
import random

import pytest

from sparkloom import cli, server
from sparkloom.operators import graph, resolve, retrieval, traverse
from sparkloom.session import SourceGraph

SAMPLE = {
    "tide.py": "def moon_phase(day):\n    return day % 29\n\n\ndef sea_level(phase, port):\n    return phase * port\n\n\ndef forecast(day, port):\n    phase = moon_phase(day)\n    return sea_level(phase, port)\n",
    "boats.py": "class Dinghy:\n    def __init__(self, draught):\n        self.draught = draught\n\n    def floats(self):\n        return True\n",
    "harbour.py": "from tide import forecast\nfrom boats import Dinghy\n\n\ndef moor(x):\n    return x\n\n\nclass Pier:\n    def take_in(self, draught):\n        b = Dinghy(draught)\n        forecast(draught, 3)\n        return moor(b)\n",
    "season.py": "from harbour import Pier\n\n\ndef open_all():\n    pier = Pier()\n    return pier.take_in(2)\n",
}


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    root, db = tmp_path_factory.mktemp("repo"), tmp_path_factory.mktemp("db")
    write(str(root), SAMPLE)
    session = SourceGraph(spark, f"{db}/graph")
    assert session.version() is None
    status = session.analyze(str(root))
    assert status == {"mode": "full", "files": 4, "symbols": 10, "edges": 23, "calls": 7, "unresolved": 0}
    return session, str(root)


def test_sample_graph(sample):
    session, root = sample
    edges = {(r["type"], r["src"], r["dst"], r["rel_table"]) for r in session.table("edges").collect()}
    assert {e[1:] for e in edges if e[0] == "CALLS"} == {
        ("tide.forecast", "tide.moon_phase", "R_CALLS_FF"), ("tide.forecast", "tide.sea_level", "R_CALLS_FF"), ("season.open_all", "harbour.Pier", "R_CALLS_FC"),
        ("season.open_all", "harbour.Pier.take_in", "R_CALLS_FF"), ("harbour.Pier.take_in", "boats.Dinghy", "R_CALLS_FC"),
        ("harbour.Pier.take_in", "tide.forecast", "R_CALLS_FF"), ("harbour.Pier.take_in", "harbour.moor", "R_CALLS_FF"),
    }
    assert {e[1:3] for e in edges if e[0] == "IMPORTS"} == {("season", "harbour"), ("harbour", "tide"), ("harbour", "boats")}
    assert {e[1:3] for e in edges if e[0] == "HAS_METHOD"} == {("boats.Dinghy", "boats.Dinghy.__init__"), ("boats.Dinghy", "boats.Dinghy.floats"), ("harbour.Pier", "harbour.Pier.take_in")}
    assert session.analyze(root) == {"mode": "up-to-date", "files": 4}
    assert set(session.snapshot()) == set(SAMPLE)


def test_sample_answers(sample):
    session, _ = sample
    report = session.impact("tide.forecast", 2)
    assert report["upstream"]["by_depth"] == {"1": ["harbour.Pier.take_in"], "2": ["season.open_all"]}
    assert report["downstream"]["by_depth"] == {"1": ["tide.moon_phase", "tide.sea_level"]}
    assert (report["files"], report["risk"]) == (["harbour", "season", "tide"], "low")
    assert session.context("tide.forecast") == {"symbol": "tide.forecast", "callers": ["harbour.Pier.take_in"], "callees": ["tide.moon_phase", "tide.sea_level"]}
    assert session.callers("nobody") == []
    found = session.search("forecast", 5)
    assert found["mode"] == "bm25" and found["results"][0]["id"] == "tide.forecast" and {r["sources"] for r in found["results"]} == {"bm25"}
    assert "tide.sea_level" in [r["id"] for r in session.search("sea level", 5)["results"]]
    assert session.search("of the", 5)["results"] == []
    assert [s["id"] for s in session.symbols("Dinghy")] == ["boats.Dinghy", "boats.Dinghy.__init__", "boats.Dinghy.floats"]
    stats = session.stats()
    assert (stats["files"], stats["functions"], stats["classes"], stats["total_edges"], stats["languages"]) == (4, 8, 2, 23, {"Python": 4})
    assert len(session.subgraph()["nodes"]) == 6
    assert {n["id"] for n in session.subgraph("tide.forecast")["nodes"]} == {"tide.forecast", "tide", "tide.moon_phase", "tide.sea_level", "harbour.Pier.take_in"}


def test_vectors(sample, spark):
    session, _ = sample
    other = SourceGraph(spark, session.db, model=lambda texts: [[float("phase" in t), 1.0] for t in texts])
    found = other.search("phase", 5)
    assert found["mode"] == "hybrid" and any("semantic" in r["sources"] for r in found["results"])
    docs = session.table("docs")
    assert retrieval.hashed_vectors(docs.select("ord", "id", "text"), 8).count() == docs.count()


def test_command_line_and_http(sample, spark, capsys, tmp_path):
    session, _ = sample
    assert cli.main(["--db", session.db, "callers", "tide.forecast"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["[depth 1] harbour.Pier.take_in", "[depth 2] season.open_all"]
    assert cli.main(["--db", session.db, "impact", "tide.forecast"], spark) == 0
    assert cli.main(["--db", session.db, "search", "forecast", "--k", "1"], spark) == 0
    assert "tide.forecast (tide.py)" in capsys.readouterr().out
    assert cli.main(["--db", str(tmp_path / "none"), "analyze", str(tmp_path)], spark) == 1
    assert server.answer(session, "/api/stats")[0] == 200
    assert server.answer(session, "/api/callees?symbol=tide.forecast")[1][0]["callee"] == "tide.moon_phase"
    assert server.answer(session, "/api/impact")[0] == 500
    assert server.answer(session, "/none")[0] == 404


ROUNDS = [
    {"shop/__init__.py": "from shop.cart import add_item\n", "shop/cart.py": "from shop.user import who\n\ndef add_item(x):\n    return who(x)\n", "shop/user.py": "def who(x):\n    return x\n", "shop/order.py": "from shop.cart import add_item\n\ndef order():\n    add_item(1)\n    lonely()\n", "web/x.js": "export function lonely() { return 1; }\n"},
    {"shop/cart.py": "from shop.user import who\nfrom shop.promo import cut\n\ndef add_item(x):\n    return cut(who(x))\n\ndef total():\n    return add_item(2)\n"},
    {"shop/promo.py": "def cut(x):\n    return x\n"},
    {"other.py": "def lonely():\n    pass\n"},
    {"shop/user.py": None},
    {"other.py": None, "shop/order.py": "def order():\n    lonely()\n"},
]


def test_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "repo"
    session = SourceGraph(spark, str(tmp_path / "db"))
    for i, changes in enumerate(ROUNDS):
        write(str(root), {k: v for k, v in changes.items() if v is not None})
        for name in (k for k, v in changes.items() if v is None):
            os.remove(root / name)
        status = session.analyze(str(root))
        assert status["mode"] == ("incremental" if i else "full")
        whole = SourceGraph(spark, str(tmp_path / f"full{i}"))
        whole.analyze(str(root))
        for name in ("nodes", "edges"):
            assert graph.same_rows(session.table(name), whole.table(name)), (i, name)
        if i == 1:
            assert status["reparsed_files"] == ["shop/__init__.py", "shop/cart.py", "shop/order.py"]
        if i == 4:
            assert status["deleted"] == ["shop/user.py"]
    assert session.analyze(str(root), force=True)["mode"] == "full"


def test_mixed_languages(spark, tmp_path):
    write(str(tmp_path / "r"), {
        "app.py": "def helper():\n    pass\n\ndef main():\n    helper()\n", "web/util.js": "import { x } from './c';\nexport function greet() { return x(); }\n", "web/c.js": "export const x = () => 1;\n",
        "web/types.ts": "class A { m() { return this.m(); } }\n", "src/com/x/Main.java": "import com.y.Z;\npublic class Main { void run() { new Z().f(); } }\n", "src/com/y/Z.java": "public class Z { void f() {} void g() { f(); } }\n",
    })
    session = SourceGraph(spark, str(tmp_path / "db"))
    session.analyze(str(tmp_path / "r"))
    edges = session.table("edges")
    assert {(r["src"], r["dst"]) for r in edges.where("type = 'CALLS'").collect()} == {
        ("app.main", "app.helper"), ("web.util.greet", "web.c.x"), ("web.types.A.m", "web.types.A.m"), ("src.com.x.Main.Main.run", "src.com.y.Z.Z.f"), ("src.com.y.Z.Z.g", "src.com.y.Z.Z.f"),
    }
    assert [(r["src"], r["dst"]) for r in edges.where("type = 'IMPORTS'").collect()] == [("web.util", "web.c")]


def test_reach_on_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(20)]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        seen, level, expected = {"n0"}, {"n0"}, {}
        for depth in range(1, 4):
            nearer = {d: min(s for s, t in pairs if t == d and s in level) for s, d in pairs if s in level and d not in seen}
            expected |= {d: (p, depth) for d, p in nearer.items()}
            level = set(nearer)
            seen |= level
        got = {r["id"]: (r["parent"], r["depth"]) for r in traverse.reach(edges, spark.createDataFrame([("n0",)], "id string"), 3).collect()}
        assert got == expected


def test_resolution_tiers(spark):
    symbols = spark.createDataFrame([(1, "a", "f", "function", "f"), (2, "b", "f", "function", "f"), (3, "b", "g", "function", "g"), (4, "b", "g", "method", "C.g"), (5, "c", "h", "function", "h"), (6, "", "r", "function", "r")], "seq int, module string, name string, kind string, qualified_name string")
    imports = spark.createDataFrame([("c", 0, "b", "f", "ff"), ("c", 1, "b", "g", None), ("c", 2, "b", "b", None)], "module string, ord int, imported string, name string, alias string")
    calls = spark.createDataFrame([("a", "f.x.y"), ("b", "g"), ("c", "g"), ("c", "ff"), ("c", "b.f"), ("a", "q.h"), ("a", "g"), ("a", "r")], "module string, callee_chain string")
    found = {(r["module"], r["callee_chain"]): (r["target"], r["tier"]) for r in resolve.resolve_calls(calls, symbols, imports).collect()}
    assert found == {("a", "f.x.y"): ("a.f", 1), ("b", "g"): ("b.g", 1), ("c", "g"): ("b.g", 2), ("c", "ff"): (None, 0), ("c", "b.f"): ("b.f", 2), ("a", "q.h"): ("c.h", 3), ("a", "g"): (None, 0), ("a", "r"): ("r", 3)}
