"""A report of any size as one file or as a folder of files, written by a Python data source.

Tasks write the rows they hold to part files of their own and keep a line of
sums; the commit puts a head, the parts in their order and an end together, by
copying streams, and takes the report's place in one step. What an attempt that
failed or ran twice has written lies in the same folder of parts, of which the
commit reads only the files that tasks reported, and which goes with it. So no
finding passes through the driver, and a reader sees a whole report or none.

With ``layout`` ``folder`` each task's part becomes a report of its own, for
logs that no viewer would open as one file. Every row stands on a line of its
own, so Spark reads a report back without parsing it whole.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Columns of what is written. ``value`` is the JSON of one row of a section, null if it is only counted; ``rule`` is what the first row (by path and rank) of each ``rule_id`` says in the end.
ROWS = "section string, path string, rank int, severity int, value string, rule_id string, rule string"
NAME = "veilscan_report"


def shared_folder(spark: SparkSession) -> str:
    """A new folder, as a path, where the driver and all executors see it; it goes when the driver ends.

    It lies in ``spark.checkpoint.dir``. Only a session in local mode may do
    without, as its tasks run on the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.gettempdir() if base is None else base.removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise RuntimeError("files are written to a mounted folder; spark.checkpoint.dir is a remote address")
    folder = f"{base.rstrip('/')}/veilscan-files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@dataclass
class Written(WriterCommitMessage):
    """What a task reports: its part of each section, and sums; no rows."""

    partition: int = 0
    files: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    rules: dict[str, tuple[str, int, str]] = field(default_factory=dict)
    worst: int = -1

    def add(self, other: Written) -> None:
        self.worst = max(self.worst, other.worst)
        for section, n in other.counts.items():
            self.counts[section] = self.counts.get(section, 0) + n
        for rule, first in other.rules.items():
            self.rules[rule] = min(self.rules.get(rule, first), first)


def _sarif(total: Written, options: dict) -> tuple[str, list[str], str]:
    """Head, sections and end of a log; rules stand in the order of their first findings."""
    rules = ",".join(rule for _, _, rule in sorted(total.rules.values()))
    tool = f'{{"driver":{{"name":{json.dumps(options["tool"])},"version":{json.dumps(options["version"])},"rules":[{rules}]}}}}'
    return '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"columnKind":"utf16CodeUnits",', ["results"], f',"tool":{tool}}}]}}'


def _json(total: Written, options: dict) -> tuple[str, list[str], str]:
    worst = json.loads(options["labels"])[total.worst + 1]
    return '{"version":1,', ["files", "skipped"], f',"worst":{json.dumps(worst)},"gitignored":{total.counts.get("gitignored", 0)}}}'


KINDS = {"sarif": _sarif, "json": _json}


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.path = options["path"].removeprefix("file://")
        if "://" in self.path:
            raise ValueError("reports are written to a folder that all executors share, not to a remote address")
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        mine, out = Written(context.partitionId()), {}
        os.makedirs(self.parts, exist_ok=True)
        with ExitStack() as opened:
            for batch in iterator:
                for section, path, rank, severity, value, rule_id, rule in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mine.counts[section] = mine.counts.get(section, 0) + 1
                    mine.worst = max(mine.worst, -1 if severity is None else severity)
                    if rule_id is not None:
                        first = (path or "", rank, rule)
                        mine.rules[rule_id] = min(mine.rules.get(rule_id, first), first)
                    if value is None:
                        continue
                    if section not in out:
                        mine.files[section] = f"{context.partitionId():08d}-{context.taskAttemptId()}-{section}"
                        out[section] = opened.enter_context(open(f"{self.parts}/{mine.files[section]}", "w", encoding="utf-8"))
                        out[section].write(value)
                    else:
                        out[section].write(",\n" + value)
        return mine

    def _join(self, target: str, written: list[Written], total: Written) -> None:
        head, sections, end = KINDS[self.options["kind"]](total, self.options)
        with open(target, "wb") as f:
            f.write(head.encode())
            for n, section in enumerate(sections):
                f.write(f'{"," if n else ""}"{section}":['.encode())
                for k, part in enumerate(w.files[section] for w in written if section in w.files):
                    f.write(b",\n" if k else b"\n")
                    with open(f"{self.parts}/{part}", "rb") as rows:
                        shutil.copyfileobj(rows, f, 1 << 20)
                f.write(b"\n]")
            f.write(end.encode() + b"\n")

    def commit(self, messages: list[Written | None]) -> None:
        written, total = sorted((m for m in messages if m is not None), key=lambda m: m.partition), Written()
        for m in written:
            total.add(m)
        whole = f"{self.parts}.whole"
        if self.options.get("layout") == "folder":
            os.makedirs(whole)
            # every report of the folder has all rules, so that each can be read alone
            for m in [m for m in written if m.files] or [Written()]:
                self._join(f"{whole}/part-{m.partition:08d}.{self.options['kind']}", [m], total)
            if os.path.isdir(self.path):
                os.rename(self.path, f"{self.parts}.before")
            os.rename(whole, self.path)
            shutil.rmtree(f"{self.parts}.before", ignore_errors=True)
        else:
            self._join(whole, written, total)
            os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class Report(DataSource):
    """``df.write.format("veilscan_report").option("kind", "sarif" or "json").mode("append").save(path)``; what stood there is replaced."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options))
