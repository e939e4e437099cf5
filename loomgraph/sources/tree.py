"""Source trees as a data source: folders are listed one level after the other, and what is ignored is never entered or opened."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PARTITION_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
LISTERS = 16  # folders that are listed at once


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file in the folder ``base`` ('' or a path that ends with a slash)."""

    base: str
    pattern: str
    back: bool
    folders: bool

    def matches(self, path: str, is_folder: bool) -> bool:
        return (is_folder or not self.folders) and path.startswith(self.base) and re.fullmatch(self.pattern, path[len(self.base) :]) is not None


def _expression(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i) and i and glob[i - 1] == "/" and i + 2 == len(glob):
            out.append(".+")
            i += 2
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", r"\\")
            out.append(f"[{'^/' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
            i += 1
    return "".join(out)


def rules_of(text: str, base: str = "") -> list[Rule]:
    """Rules of an ignore file, as git reads it."""
    found = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)((?:\\\\)*) +$", r"\1", line)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        rooted = "/" in line
        found.append(Rule(base, ("" if rooted else "(?:.*/)?") + _expression(line.lstrip("/")), back, folders))
    return found


def ignored(rules: Sequence[Rule], path: str, is_folder: bool) -> bool:
    """The last rule that matches decides."""
    return next((not r.back for r in reversed(rules) if r.matches(path, is_folder)), False)


@dataclass(frozen=True)
class Entry:
    name: str
    is_folder: bool
    size: int


class Files:
    """Lists and opens what lies below a root, in whatever file system it names; links are not followed."""

    def __init__(self, root: str):
        root = root.removeprefix("file:") if root.startswith("file:/") else root
        self.local = "://" not in root
        self.system, self.root = (None, "/" + root.strip("/") if root.startswith("/") else root.rstrip("/")) if self.local else fs.FileSystem.from_uri(root)
        self.root = self.root.rstrip("/")

    def list(self, folder: str) -> list[Entry]:
        where = f"{self.root}/{folder}".rstrip("/") or "/"
        try:
            if self.local:
                with os.scandir(where) as found:
                    return sorted((Entry(e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size) for e in found if not e.is_symlink()), key=lambda e: e.name)
            infos = self.system.get_file_info(fs.FileSelector(where))
            return sorted((Entry(i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in infos), key=lambda e: e.name)
        except (FileNotFoundError, PermissionError, NotADirectoryError):
            if not folder:
                raise
            return []  # gone since, or closed to us

    def read(self, path: str) -> bytes | None:
        try:
            if self.local:
                with open(f"{self.root}/{path}", "rb") as f:
                    return f.read()
            with self.system.open_input_stream(f"{self.root}/{path}") as f:
                return f.read()
        except (FileNotFoundError, PermissionError):
            return None


def walk(files: Files, denied: frozenset[str], ignore_files: Sequence[str], first_rules: Sequence[Rule], wanted: Callable[[str], bool], enters: Callable[[str], bool] = lambda folder: True) -> Iterator[tuple[str, int]]:
    """(path, size) of the files that count, level by level; ``wanted`` judges names, ``enters`` folders (paths that end with a slash)."""
    level: list[tuple[str, tuple[Rule, ...]]] = [("", tuple(first_rules))]

    def look(at: tuple[str, tuple[Rule, ...]]) -> tuple[list[tuple[str, int]], list[tuple[str, tuple[Rule, ...]]]]:
        folder, rules = at
        entries = files.list(folder)
        there = {e.name for e in entries if not e.is_folder}
        for name in ignore_files:
            if name in there:
                rules += tuple(rules_of((files.read(folder + name) or b"").decode("utf-8", "replace"), folder))
        found, below = [], []
        for e in entries:
            path = folder + e.name
            if e.name.startswith(".") or (e.is_folder and e.name in denied):
                continue
            if not (enters(f"{path}/") if e.is_folder else wanted(path)) or ignored(rules, path, e.is_folder):
                continue
            if e.is_folder:
                below.append((f"{path}/", rules))
            else:
                found.append((path, e.size))
        return found, below

    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            looked = list(pool.map(look, level))
            for found, _ in looked:
                yield from found
            level = [b for _, below in looked for b in below]


def dealt(sizes: Sequence[tuple[str, int]], partition_bytes: int) -> list[list[str]]:
    """Paths in parts of about ``partition_bytes``: the largest first, each to the part that has least."""
    total = sum(s for _, s in sizes)
    parts = max(1, min(len(sizes), -(-total // partition_bytes)))
    heap = [(0, k) for k in range(parts)]
    out: list[list[str]] = [[] for _ in range(parts)]
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        least, k = heapq.heappop(heap)
        out[k].append(path)
        heapq.heappush(heap, (least + size + 4096, k))  # opening a file costs something too
    return [p for p in out if p]


@dataclass
class Part(InputPartition):
    paths: list[str]


SCHEMA = "path string, lang string, size_bytes long, content binary"


class SourceTree(DataSource):
    """Source files below ``path`` with their language and content.

    Options: ``languages`` (JSON, extension to language), ``denied`` (JSON list of folder
    names), ``ignore_files`` (JSON list, the later ones count more), ``ignore_text`` (rules
    that come before all files'), ``below`` (a folder or file of the root, to which nothing but what lies below it counts), ``partition_bytes``. The driver lists names and sizes, as
    Spark's own file sources do; contents are read by tasks that get about as many bytes each.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SourceTreeReader:
        return SourceTreeReader(self.options)


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root = options["path"]
        self.languages: dict[str, str] = json.loads(options["languages"])
        self.denied = frozenset(json.loads(options.get("denied", "[]")))
        self.ignore_files = json.loads(options.get("ignore_files", "[]"))
        self.ignore_text = options.get("ignore_text", "")
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.below = options.get("below", "").strip("/")

    def language(self, path: str) -> str | None:
        return self.languages.get(path.rpartition("/")[2].rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else None

    def partitions(self) -> list[Part]:
        below = f"{self.below}/" if self.below else ""

        def wanted(path: str) -> bool:
            return self.language(path) is not None and (path.startswith(below) or path == self.below)

        found = walk(Files(self.root), self.denied, self.ignore_files, rules_of(self.ignore_text), wanted, lambda folder: folder.startswith(below) or below.startswith(folder))
        return [Part(p) for p in dealt(list(found), self.partition_bytes)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, rows, size = Files(self.root), [], 0
        for path in partition.paths:
            content = files.read(path)
            if content is None:
                continue  # gone since it was listed
            rows.append((path, self.language(path), len(content), content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("path", pa.string()), ("lang", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary()))
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
