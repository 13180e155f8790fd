"""A small repository in four languages, with the rows that parsing and building it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "app.py": "from web import draw as paint\nimport store.items as items\n\n\ndef helper(x):\n    return paint(x)\n\n\nclass Page:\n    def show(self):\n        helper(self.title())\n        return items.find(1)\n\n    def title(self):\n        return ''\n\n\ndef main():\n    Page().show()\n    unknown_name()\n",
    "store/__init__.py": "from .items import find\n",
    "store/items.py": "async def find(n):\n    def inner():\n        return find(n - 1)\n    return inner()\n",
    "web.py": "def draw(x):\n    return x\n",
    "ui/view.ts": "import { pick as choose } from './pick';\nexport interface Shape { area(): number }\nexport class View { render(): void { choose(`n ${this.count()}`); } private count(): number { return 1; } }\n",
    "ui/pick.js": "export const pick = (x) => { return new Set(x); };\n",
    "java/a/Main.java": "import java.a.Tool;\npublic class Main { void run(Tool t) { t.work(); helper2(); } void helper2() {} }\n",
    "java/a/Tool.java": "class Tool { Tool() { work(); } void work() {} }\n",
}
SYMBOLS = [
    ("app.py", "class", "Page", 9, 15), ("app.py", "function", "helper", 5, 6), ("app.py", "function", "main", 18, 20), ("app.py", "method", "Page.show", 10, 12), ("app.py", "method", "Page.title", 14, 15),
    ("java/a/Main.java", "class", "Main", 2, 2), ("java/a/Main.java", "method", "Main.helper2", 2, 2), ("java/a/Main.java", "method", "Main.run", 2, 2),
    ("java/a/Tool.java", "class", "Tool", 1, 1), ("java/a/Tool.java", "method", "Tool.Tool", 1, 1), ("java/a/Tool.java", "method", "Tool.work", 1, 1),
    ("store/items.py", "function", "find", 1, 4), ("ui/pick.js", "function", "pick", 1, 1), ("ui/view.ts", "class", "Shape", 2, 2), ("ui/view.ts", "class", "View", 3, 3),
    ("ui/view.ts", "method", "View.count", 3, 3), ("ui/view.ts", "method", "View.render", 3, 3), ("web.py", "function", "draw", 1, 2),
]
IMPORTS = [
    ("app.py", "store.items", "store.items", "items"), ("app.py", "web", "draw", "paint"), ("java/a/Main.java", "java.a", "Tool", ""),
    ("store/__init__.py", "store.items", "find", ""), ("ui/view.ts", "ui.pick", "pick", "choose"),
]
CALLS = [
    ("app.py", "Page.show", "helper", 11), ("app.py", "Page.show", "items.find", 12), ("app.py", "Page.show", "self.title", 11), ("app.py", "helper", "paint", 6), ("app.py", "main", "Page", 19),
    ("app.py", "main", "Page().show", 19), ("app.py", "main", "unknown_name", 20), ("java/a/Main.java", "Main.run", "helper2", 2), ("java/a/Main.java", "Main.run", "t.work", 2), ("java/a/Tool.java", "Tool.Tool", "work", 1),
    ("store/items.py", "find", "find", 3), ("store/items.py", "find", "inner", 4), ("ui/view.ts", "View.render", "choose", 3), ("ui/view.ts", "View.render", "this.count", 3),
]
CALL_EDGES = [
    ("app.Page.show", "app.helper"), ("app.Page.show", "app.Page.title"), ("app.Page.show", "store.items.find"), ("app.main", "app.Page"), ("app.main", "app.Page.show"),
    ("java.a.Main.Main.run", "java.a.Main.Main.helper2"), ("java.a.Main.Main.run", "java.a.Tool.Tool.work"), ("java.a.Tool.Tool.Tool", "java.a.Tool.Tool.work"),
    ("store.items.find", "store.items.find"), ("ui.view.View.render", "ui.view.View.count"),
]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, bytearray(t.encode())) for f, t in FILES.items()], "file string, content binary")
