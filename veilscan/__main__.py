"""``python -m veilscan PATH...``: scan files and folders, compare two copies, clean in place.

Exit code 1 if a file is at least as severe as --fail-on (or two copies are
marked), 2 for wrong usage, else 0.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from . import __version__
from .functions.dims import SEVERITIES


def _arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser("veilscan", description=__doc__.splitlines()[0], add_help=True)
    p.add_argument("paths", nargs="*", help="files and folders; - for standard input; the current folder if none")
    p.add_argument("--json", action="store_true", help="one JSON report")
    p.add_argument("--sarif", nargs="?", const="-", metavar="FILE", help="a SARIF 2.1.0 log")
    p.add_argument("--annotations", action="store_true", default=os.environ.get("GITHUB_ACTIONS") == "true", help="workflow commands for each finding; the default within a workflow")
    p.add_argument("--fix", action="store_true", help="rewrite files without what is hidden")
    p.add_argument("--staged", action="store_true", help="files as the git index holds them")
    p.add_argument("--compare", nargs=2, metavar=("A", "B"), help="two copies of a text")
    p.add_argument("--fail-on", type=str.upper, choices=SEVERITIES, help="default HIGH; with --sarif only if given")
    p.add_argument("--ignore", default="", metavar="IDS", help="findings to leave out, by comma")
    p.add_argument("--exclude", action="append", default=[], metavar="PATH")
    p.add_argument("--all", action="store_true", help="clean files too")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--no-annotations", dest="annotations", action="store_false", help="none, even where a workflow runs")
    p.add_argument("--no-color", action="store_true", help="terminal text has no colours anyway")
    p.add_argument("--normalize", default="NFC", choices=("NFC", "NFKC", "none"), help="with --fix")
    p.add_argument("--fold-confusables", action="store_true", help="with --fix: lookalikes become ASCII")
    p.add_argument("--keep-spaces", action="store_true", help="with --fix: other spaces stay")
    p.add_argument("--keep-ansi", action="store_true", help="with --fix: terminal sequences stay")
    p.add_argument("-v", "--version", action="version", version=__version__)
    a = p.parse_args(args)
    if a.sarif not in (None, "-") and os.path.exists(a.sarif) and not a.sarif.lower().endswith((".sarif", ".sarif.json")):
        # what is there already and is no log is to be scanned, not written over
        a.paths.insert(0, a.sarif)
        a.sarif = "-"
    return a


def _session():
    from pyspark.sql import SparkSession

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    builder = SparkSession.builder.appName("veilscan").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR")
    return builder.getOrCreate()


def main(args: list[str] | None = None, spark=None) -> int:
    a = _arguments(args)
    from pyspark.sql import functions as F

    from .operators import scan as ops
    from .sources import files, reports, sinks

    spark = spark or _session()
    if a.compare:
        row = sinks.comparison_json(ops.compare(files.pair(spark, *a.compare))).first()
        print(row.json if a.json else f"{row.relation}: {len(row.differences)} places, {row.differing_codepoints} characters")
        return int(row.relation == "marked")
    skipped = None
    if a.staged:
        read = files.staged(spark, os.getcwd())
    elif a.paths == ["-"]:
        read = files.text_source(spark, sys.stdin.buffer.read().decode("utf-8", "replace"))
    else:
        read, skipped = files.files(spark, a.paths or ["."], a.exclude, not a.no_gitignore)
    ignore = tuple(x.strip() for x in a.ignore.split(",") if x.strip())
    read = read.cache()  # files are few here, and are read once
    if a.fix:
        options = {"normalize": a.normalize, "fold_confusables": a.fold_confusables, "normalize_spaces": not a.keep_spaces, "strip_ansi": not a.keep_ansi}
        here = os.getcwd()
        done = sinks.fix(read, (lambda p: files.differs_from_index(here, p)) if a.staged else (lambda p: False), **options)
        for row in done.orderBy("refused", "path").toLocalIterator():
            print(f"{'left alone, as the working copy differs from the index' if row.refused else 'cleaned'}: {sinks.safe_path(row.path)}", file=sys.stderr)
    total = ops.summary(read, ignore=ignore).first()
    if a.sarif or a.json:
        # what goes to standard output is written by the tasks, too, and copied
        to_file = a.sarif not in (None, "-")
        target = os.path.abspath(a.sarif) if to_file else f"{reports.shared_folder(spark)}/report"
        if a.sarif:
            sinks.write_sarif(read, target, ignore=ignore, version=__version__)
        else:
            sinks.write_json(read, target, skipped, ignore=ignore, all_files=a.all)
        if not to_file:
            with open(target, encoding="utf-8") as f:
                shutil.copyfileobj(f, sys.stdout)
    else:
        rows = ops.scan(read.select("path", "text"), ignore=ignore)
        for row in rows.filter(F.lit(a.all) | (F.col("severity") >= 0)).drop("text").orderBy("path").toLocalIterator():
            print(sinks.terminal(row, row.path))
        if a.annotations:
            for row in sinks.annotations(read, ignore=ignore).orderBy("path", "rank").toLocalIterator():
                print(row.command)
        print(f"{total.n_texts} files scanned, {total.n_flagged} with findings")
    for row in skipped.orderBy("path").toLocalIterator() if skipped is not None else ():
        print(f"not scanned ({row.reason}): {sinks.safe_path(row.path)}", file=sys.stderr)
    return sinks.exit_code(total.worst, a.fail_on, a.sarif is not None)


if __name__ == "__main__":
    sys.exit(main())
