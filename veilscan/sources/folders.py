"""Folders and a git index as tables and streams, listed by tasks.

The driver opens only the upper folders, until there are as many as tasks are
wanted, and holds no file names; a task walks whole folders below. Listing and
reading are apart, so that files of one large folder are read by all tasks.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME, INDEX = "veilscan_folders", "veilscan_index"
#: Of each file: its path, bytes, time of its last change in nanoseconds, and the reason it is not read for, or null.
LISTED = "path string, size long, changed long, reason string"
_listed = pa.schema([("path", pa.string()), ("size", pa.int64()), ("changed", pa.int64()), ("reason", pa.string())])
#: A stream leaves files alone that changed in the last so many nanoseconds, as clocks differ and files are still being written.
SETTLE = 2_000_000_000


@dataclass
class Folders(InputPartition):
    """Folders as (path, whether their subfolders belong to them), and files that are roots."""

    folders: list[tuple[str, bool]]
    files: list[str]
    since: int = -1
    until: int = 1 << 62


class Walk:
    """What both readers share: the options, and the walk of one partition."""

    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.exclude = [x.rstrip("/") for x in json.loads(options.get("exclude", "[]"))]
        self.gitignore = options.get("gitignore", "true") == "true"
        self.cwd = options["cwd"]  # relative paths mean the driver's
        self.tasks = int(options.get("tasks", "8"))

    def _absolute(self, path: str) -> str:
        return os.path.join(self.cwd, path)

    def _excluded(self, path: str) -> bool:
        relative = os.path.relpath(self._absolute(path), self.cwd)
        return any(p == x or p.startswith(x + "/") for p in (path, relative) for x in self.exclude)

    def _inside(self, folder: str) -> Iterator[os.DirEntry]:
        """Entries of a folder; one that is gone or closed has none."""
        try:
            with os.scandir(self._absolute(folder)) as entries:
                yield from entries
        except OSError:
            return

    def _below(self, folder: str, entry: os.DirEntry) -> str | None:
        """The path of an entry that is a folder to walk into."""
        from .files import SKIPPED_DIRS

        path = os.path.join(folder, entry.name)
        return path if entry.is_dir(follow_symlinks=False) and entry.name not in SKIPPED_DIRS and not self._excluded(path) else None

    def split(self, since: int = -1, until: int = 1 << 62) -> list[Folders]:
        """Partitions: upper folders one by one, without their subfolders, and as many whole ones as are then left."""
        files = [r for r in self.roots if os.path.isfile(self._absolute(r))]
        wait, alone = deque((r for r in self.roots if r not in files)), []
        while wait and len(wait) < self.tasks:
            folder = wait.popleft()
            alone.append((folder, False))
            wait.extend(sorted(p for e in self._inside(folder) if (p := self._below(folder, e))))
        dealt = alone + [(p, True) for p in wait]
        n = max(1, min(self.tasks, len(dealt)))
        return [Folders(dealt[i::n], files[i::n], since, until) for i in range(n)]

    def _row(self, path: str, ignored: set[str], part: Folders) -> tuple | None:
        from .files import MOST_BYTES, is_agent_file

        try:
            s = os.stat(self._absolute(path))
        except OSError:
            return (path, 0, 0, "unreadable") if part.since < 0 else None
        # moving a file changes st_ctime_ns and not the time of its contents
        if not part.since < s.st_ctime_ns <= part.until:
            return None
        reason = "larger than 8 MB" if s.st_size > MOST_BYTES else "git-ignored" if os.path.abspath(self._absolute(path)) in ignored and not is_agent_file(path) else None
        try:
            path.encode()
        except UnicodeEncodeError:
            path, reason = path.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace"), "name is not UTF-8"
        return path, s.st_size, s.st_ctime_ns, reason

    def _paths(self, part: Folders) -> Iterator[tuple[str, set[str]]]:
        from .files import git_ignored, is_readable

        for path in part.files:
            if not self._excluded(path):
                yield path, set()
        for top, deep in part.folders:
            ignored = git_ignored(self._absolute(top), deep) if self.gitignore else set()
            wait = [top]
            while wait:
                folder = wait.pop()
                for entry in self._inside(folder):
                    below = self._below(folder, entry) if deep else None
                    if below:
                        wait.append(below)
                        continue
                    path = os.path.join(folder, entry.name)
                    if entry.is_file(follow_symlinks=False) and is_readable(path) and not self._excluded(path):
                        yield path, ignored

    def rows(self, part: Folders) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for path, ignored in self._paths(part):
            row = self._row(path, ignored, part)
            if row is not None:
                held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _listed.types, strict=True)], schema=_listed)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _listed.types, strict=True)], schema=_listed)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.walk = Walk(options)

    def partitions(self) -> list[Folders]:
        return self.walk.split()

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.walk.rows(partition)


class FolderStreamReader(DataSourceStreamReader):
    """Files that appeared, changed or were moved in since the last batch.

    An offset is a time, not a list of what was seen, so state does not grow
    with the folders. Each batch has a later one, files or not: give the query a
    trigger with an interval, or ``availableNow``.
    """

    def __init__(self, options: dict) -> None:
        self.walk = Walk(options)

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        return {"changed": time.time_ns() - SETTLE}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.walk.split(start["changed"], end["changed"])

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.walk.rows(partition)


class FolderSource(DataSource):
    """Options: ``roots`` and ``exclude`` as JSON lists, ``gitignore``, ``cwd``, ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(dict(self.options))


class IndexReader(DataSourceReader):
    """One task reads the list of staged files from git as it comes, without their contents."""

    def __init__(self, options: dict) -> None:
        self.repository = options["repository"]

    def read(self, partition) -> Iterator[tuple[str, str]]:
        from .files import is_readable

        command = ["git", "-C", self.repository, "diff", "--cached", "--raw", "-z", "--no-renames", "--diff-filter=ACMT", "--no-abbrev"]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
            rest, head = b"", None
            while chunk := run.stdout.read(1 << 16):
                *fields, rest = (rest + chunk).split(b"\0")
                for part in fields:
                    if head is None:
                        head = part.decode("ascii").split(" ")
                        continue
                    path = part.decode("utf-8", "backslashreplace")
                    if head[1] not in ("120000", "160000") and is_readable(path):
                        yield path, head[3]
                    head = None
        if run.returncode:
            raise RuntimeError(f"git diff ended with {run.returncode} in {self.repository}")


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return INDEX

    def schema(self) -> str:
        return "path string, blob string"

    def reader(self, schema) -> IndexReader:
        return IndexReader(dict(self.options))
