"""A sink for lines whose runs are published as a whole: a lost task, a failed job or a rerun neither doubles nor halves them.

``path/run=<run>`` holds the pieces that tasks wrote and a manifest that names those that count. Tasks write pieces of
their own; the manifest replaces the former one in one step when all of them are done, so that a run appears, or changes,
at once. What a manifest does not name is never read, and goes with the next commit.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "committed_lines"
MANIFEST = "_manifest.json"
#: Bytes that a task holds before they go to its piece.
HELD_BYTES = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which all executors must see, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://?", path) else (fs.LocalFileSystem(), path)


@dataclass
class Piece(WriterCommitMessage):
    name: str
    lines: int


class LineWriter(DataSourceWriter):
    def __init__(self, path: str, run: str):
        self.path, self.folder = path, f"run={run}"

    def _at(self, name: str) -> str:
        return f"{_store(self.path)[1]}/{self.folder}/{name}"

    def write(self, iterator: Iterator[Row]) -> Piece:
        store = _store(self.path)[0]
        store.create_dir(self._at(""), recursive=True)
        name, lines, held, size = f"part-{uuid.uuid4().hex}.txt", 0, [], 0
        with store.open_output_stream(self._at(name)) as out:
            for row in iterator:
                line = (row["value"] or "").encode() + b"\n"
                held.append(line)
                lines, size = lines + 1, size + len(line)
                if size >= HELD_BYTES:
                    out.write(b"".join(held))
                    held, size = [], 0
            out.write(b"".join(held))
        return Piece(name, lines)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store = _store(self.path)[0]
        pieces = [m for m in messages if m is not None]
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        store.create_dir(self._at(""), recursive=True)
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"pieces": [{"name": p.name, "lines": p.lines} for p in pieces]}).encode())
        store.move(draft, self._at(MANIFEST))
        known = {p.name for p in pieces}
        for info in store.get_file_info(fs.FileSelector(self._at(""))):
            if info.base_name not in known and info.base_name != MANIFEST:
                with suppress(OSError):
                    store.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store = _store(self.path)[0]
        for m in messages:
            if m is not None:
                with suppress(OSError):
                    store.delete_file(self._at(m.name))


class CommittedLines(DataSource):
    """Options ``path`` and ``run``; rows have one string column, ``value``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> LineWriter:
        run = self.options.get("run", "")
        if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
            raise ValueError(f"a run is named by letters, digits, '.', '_' and '-', not {run!r}")
        return LineWriter(self.options["path"], run)


def write_lines(lines: DataFrame, path: str, run: str | None = None) -> str:
    """Publish ``lines(value)`` as a run, which replaces a former one of that name; returns its name, a new one by default."""
    run = run or uuid.uuid4().hex
    lines.sparkSession.dataSource.register(CommittedLines)
    lines.select(F.col("value").cast("string")).write.format(FORMAT).option("run", run).mode("append").save(path)
    return run


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(run, value)`` of all published runs."""
    store, home = _store(path)
    pieces = []
    for info in store.get_file_info(fs.FileSelector(home, allow_not_found=True)):
        manifest = f"{info.path}/{MANIFEST}"
        if info.base_name.startswith("run=") and store.get_file_info(manifest).type == fs.FileType.File:
            with store.open_input_stream(manifest) as f:
                pieces += [f"{path}/{info.base_name}/{p['name']}" for p in json.loads(f.read())["pieces"] if p["lines"]]
    if not pieces:
        return spark.createDataFrame([], "run string, value string")
    return spark.read.text(pieces).select(F.regexp_extract("_metadata.file_path", r"/run=([^/]+)/[^/]+$", 1).alias("run"), "value")
