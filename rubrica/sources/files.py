"""Folders at any location of a shared file system as file tables: a Python data source over Arrow's file systems.

    spark.dataSource.register(FileTree)
    spark.read.format("file_tree").option("root", "s3://bucket/repos/one").load()

The driver lists names and sizes; executors read contents, in partitions of bounded bytes, so a lost executor costs its own files only. Dotfiles are listed, links aren't followed. A filter on path is
applied before any file is opened. Files that aren't text, or larger than `max_bytes`, have a row with null content.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from rubrica.config import UserError

# Folders that are passed over, the extensions of text files and their largest size.
IGNORED_DIRS = ("node_modules", ".git", "dist", "coverage")
TEXT_NAME = r"(?i)\.(?:md|mdx|mdc|txt|py|sh|bash|js|mjs|cjs|ts|json|yaml|yml|toml|csv|xml|html)$"
ALWAYS_TEXT = ("SKILL.md", "CLAUDE.md", "AGENTS.md", "GEMINI.md", ".cursorrules", "package.json", "Makefile", "makefile", "GNUmakefile", "justfile", "Justfile", ".justfile")
RULES_DIR = ".cursor/rules"
MAX_BYTES = 262_144
FILES = "repo string, path string, size long, content string"
FILES_ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.string())])


def is_text(path: str, size: int, most: int = MAX_BYTES) -> bool:
    """Whether a file's content is read: artifacts and manifests always, others by extension and size."""
    folder, name = posixpath.split(path)
    return name in ALWAYS_TEXT or bool(re.search(TEXT_NAME, name)) and (size <= most or folder == RULES_DIR or folder.endswith(f"/{RULES_DIR}"))


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        self.names = names


class FileTree(DataSource):
    """Options: root (a URI or path), repo (its name in the table; the root by default), ignore (globs, by commas), max_bytes, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options)


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("root") or options.get("path") or ""
        self.repo = options.get("repo") or self.root
        self.ignore = [g for g in (options.get("ignore") or "").split(",") if g]
        self.most = int(options.get("max_bytes") or MAX_BYTES)
        self.bytes = int(options.get("partition_bytes") or 32 << 20)
        self.wanted: list[Filter] = []

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), posixpath.abspath(self.root))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on path; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def takes(self, path: str) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return path == f.value
            if isinstance(f, In):
                return path in f.value
            return {StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: path.__contains__}[type(f)](f.value)

        return all(map(holds, self.wanted)) and not any(fnmatch(path, g) for g in self.ignore)

    def listed(self) -> Iterator[tuple[str, int]]:
        """(path, size) of each file; a folder at a time, so ignored ones aren't entered."""
        files, base = self.opened()
        if files.get_file_info(base).type != fs.FileType.Directory:
            raise UserError(f"path not found: {self.root}")
        todo = [base]
        local = isinstance(files, fs.LocalFileSystem)
        while todo:
            for info in sorted(files.get_file_info(fs.FileSelector(todo.pop())), key=lambda i: i.path):
                rel = posixpath.relpath(info.path, base)
                if local and _is_link(info.path):
                    continue
                if info.type == fs.FileType.Directory and info.base_name not in IGNORED_DIRS:
                    todo.append(info.path)
                elif info.type == fs.FileType.File and self.takes(rel):
                    yield rel, info.size or 0

    def partitions(self) -> list[Files]:
        out, own, held = [], [], 0
        for rel, size in sorted(self.listed()):
            read = size if is_text(rel, size, self.most) else 0
            if own and (held + read > self.bytes or len(own) >= 10_000):
                out.append(Files(own))
                own, held = [], 0
            own.append((rel, size))
            held += read
        return [*out, Files(own)] if own or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, base = self.opened()
        rows: list[tuple] = []
        held = 0
        for rel, size in partition.names:
            text = None
            if is_text(rel, size, self.most):
                with files.open_input_stream(f"{base}/{rel}") as f:
                    text = f.read().decode("utf-8", "replace")
            rows.append((self.repo, rel, size, text))
            held += len(text or "")
            if held > 4 << 20 or len(rows) >= 1000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _is_link(path: str) -> bool:
    import os

    return os.path.islink(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FILES_ARROW, strict=True)], schema=FILES_ARROW)
