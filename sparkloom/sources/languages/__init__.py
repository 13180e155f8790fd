"""Parsers by language: bytes to symbols, imports and call sites. ``PARSERS`` may be extended by callers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from ...functions.code import LANGUAGES


@dataclass
class Parsed:
    """What a parser finds in one file. Rows are plain tuples in the order of the schemas."""

    symbols: list[tuple] = field(default_factory=list)  # name, kind, qualified_name, start_line, end_line, parent
    imports: list[tuple] = field(default_factory=list)  # module, name, alias, is_from
    calls: list[tuple] = field(default_factory=list)  # caller, callee_name, callee_chain, line
    status: str = "ok"

    def add_symbol(self, name: str, kind: str, parent: str | None, start: int, end: int) -> str:
        qualified = f"{parent}.{name}" if parent else name
        self.symbols.append((name, kind, qualified, start, end, parent))
        return qualified

    def add_call(self, caller: str, chain: str, line: int, name: str | None = None) -> None:
        self.calls.append((caller, name or chain.rsplit(".", 1)[-1], chain, line))


#: May be extended, as PARSERS; both go with the tasks that parse.
EXTENSIONS: dict[str, str] = dict(LANGUAGES)


def language_of(path: str, extensions: dict[str, str] = EXTENSIONS) -> str | None:
    return extensions.get(PurePosixPath(path).suffix)


def module_of(path: str, extensions: dict[str, str] = EXTENSIONS) -> str:
    """Dotted module of a relative path; a Python package is named by its folder."""
    plain = PurePosixPath(path.replace("\\", "/"))
    known = language_of(plain.name, extensions)
    parts = [*plain.parent.parts, plain.stem if known else plain.name]
    if known == "python" and plain.stem == "__init__":
        del parts[-1]
    return ".".join(p for p in parts if p != "/")


def parse(source: bytes, path: str, parsers: dict | None = None, extensions: dict[str, str] = EXTENSIONS) -> Parsed:
    """Parses one file by its extension; an unknown language gives nothing."""
    parser = (PARSERS if parsers is None else parsers).get(language_of(path, extensions) or "")
    return parser(source, path) if parser else Parsed(status="unknown")


from .curly import parse_java, parse_script  # noqa: E402
from .python import parse_python  # noqa: E402

PARSERS: dict[str, Callable[[bytes, str], Parsed]] = {"python": parse_python, "js": parse_script, "ts": parse_script, "tsx": parse_script, "java": parse_java}
