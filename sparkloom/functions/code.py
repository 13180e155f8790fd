"""Scalar expressions over names, paths and texts, all as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "class", "could", "def", "did", "do", "does", "else", "for",
    "from", "get", "had", "has", "have", "i", "if", "import", "in", "into", "is", "it", "make", "new", "no", "not",
    "of", "on", "or", "out", "return", "self", "set", "that", "the", "this", "to", "up", "use", "used", "using", "we",
    "will", "with", "would", "yes", "you",
)
# Languages by file name extension, and their display names.
LANGUAGES = {".py": "python", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".ts": "ts", ".tsx": "tsx", ".java": "java"}
LANGUAGE_NAMES = {".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java"}
TOKEN = "[a-z_][a-z0-9_]+"
#: Lines of a snippet after its first.
SNIPPET_LINES = 8


def head(chain: Column) -> Column:
    """The chain's first segment."""
    return F.substring_index(chain, ".", 1)


def tail(chain: Column) -> Column:
    """The chain without its first segment; empty if there is no other."""
    return F.when(F.instr(chain, ".") > 0, F.substr(chain, F.instr(chain, ".") + 1)).otherwise("")


def last_segment(chain: Column) -> Column:
    return F.substring_index(chain, ".", -1)


def fqn(module: Column, qualified_name: Column) -> Column:
    """Fully qualified name; the module may be empty."""
    return F.when(module == "", qualified_name).otherwise(F.concat_ws(".", module, qualified_name))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension, case-sensitive; null if it isn't known."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), extension(path))


def language_name(path: Column) -> Column:
    """Display name of the language, by the extension in lower case of the last path segment; Other if it isn't known."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.lower(extension(F.substring_index(path, "/", -1)))), F.lit("Other"))


def module_of(path: Column) -> Column:
    """Dotted module of a relative path: without its extension, and for Python without a last ``__init__``."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    plain = F.regexp_replace(slashed, r"\.(py|js|mjs|cjs|jsx|ts|tsx|java)$", "")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    package = (F.element_at(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))), -1) == "__init__") & slashed.endswith(".py")
    return F.array_join(F.when(package, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), ".")


def tokens(text: Column) -> Column:
    """Search tokens of a text: identifiers of two or more characters in lower case that aren't stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), lambda t: ~t.isin(*STOP_WORDS))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1), at most the first nine."""
    low = F.greatest(F.lit(1), start)
    high = F.least(end, start + SNIPPET_LINES)
    return F.array_join(F.slice(F.split(text, "\n", -1), low, F.greatest(F.lit(0), high - low + 1)), "\n")


def risk(upstream: Column, downstream: Column) -> Column:
    reached = upstream + downstream
    return F.when(reached >= 10, "high").when(reached >= 5, "medium").otherwise("low")


def node_label(kind: Column) -> Column:
    return F.when(kind == "class", "Class").otherwise("Function")


def path_group(path: Column) -> Column:
    """The first two segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")
