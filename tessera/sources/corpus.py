"""Spark source ``corpus``: the files below a folder that are worth indexing.

The driver lists folders level by level only until it has ``FOLDERS`` of them; executors walk what is below those and read the bytes. Names with
a leading dot or underscore are files like any other, which Spark's own binaryFile source leaves out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that are not entered, and extensions that are read.
IGNORE_DIRS = """.git .hg .svn node_modules vendor bower_components dist build out target bin obj .venv venv __pycache__
.mypy_cache .pytest_cache .next .nuxt .cache .idea .vscode Library Temp Logs Builds MemoryCaptures UserSettings""".split()
EXTENSIONS = """.go .py .js .jsx .mjs .cjs .ts .tsx .java .kt .scala .rs .rb .php .cs .c .h .cc .cpp .hpp .cxx .swift .m .mm
.sh .bash .ps1 .sql .proto .graphql .html .css .scss .md .rst .txt .json .yaml .yml .toml .ini .shader .hlsl .cginc .compute
.asmdef .uxml .uss""".split()
MAX_FILE_SIZE = 1 << 20
#: Files of a partition that the driver has listed, and folders at which it leaves walking to the executors.
FILES_IN_PARTITION, FOLDERS = 200, 64


@dataclass
class Candidate:
    full: str
    path: str
    size: int
    mod_time: int


def extension(name: str) -> str:
    """From the last dot of a name on, in lower case; a name that begins with its only dot is all extension."""
    at = name.rfind(".")
    return name[at:].lower() if at >= 0 else ""


@dataclass(frozen=True)
class Rules:
    """Which files below a root are taken, and which folders are entered."""

    root: str
    extensions: frozenset[str]
    ignored: frozenset[str]
    limit: int

    @classmethod
    def of(cls, root: str, extensions=EXTENSIONS, ignore_dirs=IGNORE_DIRS, max_file_size: int = MAX_FILE_SIZE) -> Rules:
        return cls(os.path.realpath(root), frozenset(e.lower() for e in extensions), frozenset(ignore_dirs), max_file_size if max_file_size > 0 else MAX_FILE_SIZE)

    def inside(self, folder: str) -> Iterator[Candidate | str]:
        """Files and folders (as paths) of one folder that pass, by name; what can't be read or listed is passed over."""
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in self.ignored and not e.name.startswith("."):
                        yield e.path
                elif extension(e.name) in self.extensions:
                    s = e.stat(follow_symlinks=False)
                    if 0 < s.st_size <= self.limit:
                        yield Candidate(e.path, os.path.relpath(e.path, self.root).replace(os.sep, "/"), s.st_size, int(s.st_mtime))
            except OSError:
                continue

    def below(self, folder: str) -> Iterator[Candidate]:
        for x in self.inside(folder):
            if isinstance(x, str):
                yield from self.below(x)
            else:
                yield x

    def dealt(self, folders: int = FOLDERS) -> tuple[list[Candidate], list[str]]:
        """Files met, and folders left to walk, at the first level that has ``folders`` of these or has none."""
        files, level = [], [self.root]
        while level and len(level) < folders:
            found = [x for folder in level for x in self.inside(folder)]
            files += [x for x in found if not isinstance(x, str)]
            level = [x for x in found if isinstance(x, str)]
        return files, level


def walk(root: str, extensions=EXTENSIONS, ignore_dirs=IGNORE_DIRS, max_file_size: int = MAX_FILE_SIZE) -> Iterator[Candidate]:
    """Files below ``root`` in lexical order; what can't be read or listed is passed over."""
    rules = Rules.of(root, extensions, ignore_dirs, max_file_size)
    yield from rules.below(rules.root)


def selects(path: Column, size: Column, extensions=EXTENSIONS, ignore_dirs=IGNORE_DIRS, max_file_size: int = MAX_FILE_SIZE) -> Column:
    """The same choice for a table of slash-separated paths and sizes."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    hidden = F.exists(folders, lambda d: d.isin(list(ignore_dirs)) | d.startswith("."))
    kind = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return kind.isin([e.lower() for e in extensions]) & (size > 0) & (size <= max_file_size) & ~hidden


class _Part(InputPartition):
    """Files to read, or a folder to walk and read."""

    def __init__(self, rules: Rules, files: list[Candidate], folder: str = "") -> None:
        self.rules, self.files, self.folder = rules, files, folder


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self):
        o = self.options
        split = lambda k, default: [x for x in o[k].split(",") if x] if k in o else default
        if not os.path.isdir(o["path"]):
            raise ValueError(f"not a folder: {o['path']}")
        rules = Rules.of(o["path"], split("extensions", EXTENSIONS), split("ignoredirs", IGNORE_DIRS), int(o.get("maxfilesize", MAX_FILE_SIZE)))
        files, folders = rules.dealt(int(o.get("folders", FOLDERS)))
        n = int(o.get("filesinpartition", FILES_IN_PARTITION))
        return [_Part(rules, files[i : i + n]) for i in range(0, len(files), n)] + [_Part(rules, [], x) for x in folders] or [_Part(rules, [])]

    def read(self, partition):
        for c in partition.rules.below(partition.folder) if partition.folder else partition.files:
            try:
                with open(c.full, "rb") as f:
                    yield c.path, c.size, c.mod_time, f.read(), None
            except OSError as e:
                yield c.path, c.size, c.mod_time, None, f"{c.path}: {e}"


class CorpusSource(DataSource):
    """``spark.read.format("corpus").load(folder)``; options extensions, ignoreDirs (comma-separated), maxFileSize, folders."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, size long, mod_time long, content binary, error string"

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})
