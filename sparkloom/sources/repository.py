"""Source repositories as a Spark data source, parsed on the executors.

Spark's own binary reader leaves out files whose names begin with an underscore, such as ``__init__.py``, so the listing is one
of its own. A whole repository is listed by tasks, and its files are dealt by name. For a few of them there is a data source that
conditions on ``file`` reach: only the files that they name are opened. Its partitions are planned in the driver; they get like
shares of the bytes, bounded by the session's own setting for files.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterable, Iterator
from contextlib import suppress
from itertools import groupby, islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..checkpoints import cut_lineage
from ..functions.code import SNIPPET_LINES
from ..schemas import PARSED
from .languages import EXTENSIONS, PARSERS, language_of, module_of, parse

#: What opening a file counts as, in bytes.
OPENING = 65_536
#: Files that are parsed before what they hold is handed on: as rows of Python they take many times their size.
AT_ONCE = 128
#: Names that a listing hands on at once, and bytes of contents after which files that are read are.
NAMES_AT_ONCE, BYTES_AT_ONCE = 10_000, 16 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _sources_in(root: str, folder: str, names: list[str], extensions: dict[str, str]) -> Iterator[tuple[str, int]]:
    """Those of the ``names`` in ``folder`` that are sources, by their path under ``root``, and their bytes."""
    inside = Path(folder).relative_to(root).as_posix()
    for name in names:
        if not name.startswith(".") and language_of(name, extensions):
            # one look at a file: its kind and its size
            with suppress(OSError):
                status = os.stat(os.path.join(folder, name))
                if stat.S_ISREG(status.st_mode):
                    yield name if inside == "." else f"{inside}/{name}", status.st_size


def _walk(root: str, top: str, extensions: dict[str, str]) -> Iterator[tuple[str, int]]:
    """The sources in ``top``, a folder under ``root``, and below; what is hidden, or lies in a hidden folder, is left out."""
    for folder, below, names in os.walk(top):
        below[:] = [name for name in below if not name.startswith(".")]
        yield from _sources_in(root, folder, names, extensions)


def listing(root: str) -> dict[str, int]:
    """Bytes of each source under ``root`` by its path there; what is hidden, or lies in a hidden folder, is left out."""
    return dict(_walk(root, root, EXTENSIONS))


def shares(sizes: dict[str, int], most_bytes: int, tasks: int) -> list[list[str]]:
    """The files in order of their paths, cut where multiples of a task's share of all bytes are passed."""
    cost = [OPENING + n for _, n in sorted(sizes.items())]
    share = max(OPENING, min(most_bytes, sum(cost) // max(1, tasks)))
    at = 0
    placed = []
    for name, n in zip(sorted(sizes), cost):
        placed.append((at // share, name))
        at += n
    return [[name for _, name in group] for _, group in groupby(placed, key=lambda p: p[0])]


class _Share(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, most_bytes: int, tasks: int):
        self.root, self.most_bytes, self.tasks, self.only = root, most_bytes, tasks, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over conditions that name files; others stay with Spark."""
        for f in filters:
            if isinstance(f, (In, EqualTo)) and f.attribute == ("file",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        sizes = {name: n for name, n in _walk(self.root, self.root, EXTENSIONS) if self.only is None or name in self.only}
        return [_Share(files) for files in shares(sizes, self.most_bytes, self.tasks)] or [_Share([])]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for name in partition.files:
            yield name, Path(self.root, name).read_bytes()


class RepositorySource(DataSource):
    """``spark.read.format("source_repo").load(root)``: (file, content) of each source under ``root``."""

    @classmethod
    def name(cls) -> str:
        return "source_repo"

    def schema(self) -> str:
        return "file string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options["path"], int(self.options.get("most_bytes", 128 << 20)), int(self.options.get("tasks", 1)))


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """(file, content); the session lets conditions reach Python data sources from here on."""
    spark.dataSource.register(RepositorySource)
    spark.conf.set(PUSHDOWN, "true")
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spark.read.format("source_repo").option("most_bytes", most).option("tasks", spark.sparkContext.defaultParallelism).load(root)


def source_names(spark: SparkSession, root: str) -> DataFrame:
    """(file): the paths that ``listing`` has. The folders right below ``root`` are dealt to tasks that walk them; no process holds more names than one folder has, the driver none."""
    extensions = dict(EXTENSIONS)

    def named(column: str, names: Iterator[str]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(names, NAMES_AT_ONCE)):
            given = pa.array(some, pa.string())
            yield pa.RecordBatch.from_arrays([given if c == column else pa.nulls(len(some), pa.string()) for c in ("folder", "file")], ["folder", "file"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            _, below, names = next(os.walk(root), (root, [], []))
            yield from named("folder", (name for name in below if not name.startswith(".") and not os.path.islink(os.path.join(root, name))))
            yield from named("file", (name for name, _ in _sources_in(root, root, names, extensions)))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["file"]).filter(batch.column("file").is_valid())
            for folder in batch.column("folder").drop_null().to_pylist():
                for found in named("file", (name for name, _ in _walk(root, os.path.join(root, folder), extensions))):
                    yield found.select(["file"])

    first = spark.range(0, 1, 1, 1).mapInArrow(top, "folder string, file string")
    return first.repartition(spark.sparkContext.defaultParallelism).mapInArrow(walked, "file string")


def read_whole(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """(file, content) of each source under ``root``, which is listed now, and how many there are."""
    names = cut_lineage(source_names(spark, root))
    n = names.count()
    return read_files(names, root, n), n


def read_files(names: DataFrame, root: str, n: int | None = None) -> DataFrame:
    """(file, content) of the files under ``root`` that ``names`` (file) lists, ``n`` if that is known. No others are opened; names are dealt first, as a task takes long over a few."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, contents, held = [], [], 0
            for name in batch.column(0).to_pylist():
                files.append(name)
                contents.append(Path(root, name).read_bytes())
                held += len(contents[-1])
                if len(files) == AT_ONCE or held >= BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])
                    files, contents, held = [], [], 0
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])

    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n is not None:
        parts = min(parts, max(names.sparkSession.sparkContext.defaultParallelism, n // AT_ONCE))
    return names.select("file").repartition(parts).mapInArrow(rows, "file string, content binary")


def content_hashes(sources: DataFrame) -> DataFrame:
    """(file, sha1) of ``sources`` (file, content)."""
    return sources.select("file", F.sha1("content").alias("sha1"))


def parse_sources(sources: DataFrame) -> DataFrame:
    """PARSED: one row for each file of ``sources`` (file, content), with its symbols, imports and calls. The parsers known now go with the tasks."""
    parsers, extensions = dict(PARSERS), dict(EXTENSIONS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                yield pa.RecordBatch.from_pylist([_parsed(f, c, parsers, extensions) for f, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], schema=_ARROW)

    return sources.select("file", "content").mapInArrow(rows, PARSED)


_SYMBOL = ("name", "kind", "qualified_name", "start_line", "end_line", "parent", "snippet")
_IMPORT = ("module", "name", "alias", "is_from")
_CALL = ("caller", "callee_name", "callee_chain", "line")
_TYPES = {"start_line": pa.int32(), "end_line": pa.int32(), "line": pa.int32(), "is_from": pa.bool_()}


def _structs(names: tuple[str, ...]) -> pa.DataType:
    return pa.list_(pa.struct([(n, _TYPES.get(n, pa.string())) for n in names]))


_ARROW = pa.schema([*((n, pa.string()) for n in ("file", "module", "lang", "sha1")), ("size", pa.int64()), ("status", pa.string()), ("symbols", _structs(_SYMBOL)), ("imports", _structs(_IMPORT)), ("calls", _structs(_CALL))])


def _parsed(file: str, content: bytes, parsers: dict, extensions: dict) -> dict:
    found, lines = parse(content, file, parsers, extensions), content.decode("utf-8", "replace").splitlines()
    symbols = []
    for row in found.symbols:
        start, end = row[3], row[4]
        symbols.append(dict(zip(_SYMBOL, (*row, "\n".join(lines[max(1, start) - 1 : min(end, start + SNIPPET_LINES)])))))
    return {
        "file": file, "module": module_of(file, extensions), "lang": language_of(file, extensions), "sha1": hashlib.sha1(content).hexdigest(), "size": len(content), "status": found.status,
        "symbols": symbols, "imports": [dict(zip(_IMPORT, r)) for r in found.imports], "calls": [dict(zip(_CALL, r)) for r in found.calls],
    }
