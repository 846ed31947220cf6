"""Command line: init, scan, next, resolve, skip, list, stats, review, fix."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import __version__, triage
from .config import STATE_DIR, Config
from .findings import apply_allowlist, by_detector, to_json, with_hash, with_seq
from .operators.unused_imports import unused_imports
from .parsing.symbols import present_languages
from .plans import fix as fixes
from .plans.incremental import misses, stale
from .plans.rescan import first_scan, rescan
from .plans.scan import parse, review
from .session import command_session, stored
from .sources.changes import changed_files, changed_paths
from .sources.tree import list_tree, read_files, read_tree
from .store import Store, ensure_gitignore

TEMPLATE = """\
# Settings of this project; every key is optional.

# More globs to skip, besides node_modules, dist, build and the like
# ignore:
#   - "generated/**"

# thresholds:
#   max_file_lines: 500
#   max_function_lines: 100
#   max_class_methods: 20
#   duplication_min_copies: 3

# detectors:
#   disabled: [secrets]

# Findings to leave out, per detector: hashes or globs on the file
# allowlist:
#   dead_code: ["src/pages/**"]
"""


def _print_report(found: DataFrame, as_json: bool, scope: str = "") -> None:
    counts = {r["detector"]: r["findings"] for r in by_detector(found).collect()}
    total = sum(counts.values())
    if as_json:
        # the report goes to standard output one finding at a time
        print('{"total": %d, "by_detector": %s, "findings": [' % (total, json.dumps(counts)))
        rows = to_json(found.orderBy("seq")).toLocalIterator()
        for i, row in enumerate(rows):
            print(("," if i else "") + row["json"])
        print("]}")
        return
    for detector, count in counts.items():
        print(f"  {count:6d}  {detector.replace('_', ' ')}")
    print(f"{total} findings{scope}. Run `codevitals next` to start." if total else f"No issues found{scope}.")


def _show(finding) -> None:
    if finding is None:
        print("All clear.")
        return
    place = finding["file"] + (f":{finding['line']}" if finding["line"] else "")
    print(f"[{finding['detector']}] {finding['category']}  {finding['hash']}\n{place}\n{finding['message']}")
    if finding["snippet"]:
        print("\n".join("    " + line for line in finding["snippet"].split("\n")))
    for other in finding["related"] or []:
        print(f"  also: {other}")
    print(f"{finding['remaining']} remaining")


def run_scan(spark: SparkSession, path: str, state: str, fresh: bool) -> DataFrame:
    """Findings of the tree at ``path``; not saved.

    With the tables of an earlier scan in ``state``, only new and changed files are opened.
    """
    config, store = Config.load(path), Store(spark, state)
    settings = hashlib.sha256(repr((config.thresholds, sorted(config.disabled_detectors))).encode()).hexdigest()[:16]
    listing = stored(list_tree(spark, path, config.ignore), "listing")
    old = None if fresh else store.scan_state(settings)
    wanted = listing if old is None else stored(misses(listing, old.listing), "changed-listing")
    files = stored(read_files(wanted, path), "files")
    for row in files.filter("error IS NOT NULL").select("file", "error").toLocalIterator():
        print(f"Not read: {row['file']}: {row['error']}", file=sys.stderr)
    if old is None:
        new = first_scan(files, config, present_languages(files))
    else:
        new = rescan(old, files, stale(listing, old.listing).select("repo_id", "file"), config)
    store.save_scan_state(new, settings)
    return with_seq(apply_allowlist(with_hash(store.scan_state(settings).findings), config.allowlist))


def cmd_init(args) -> int:
    path = Path(args.path) / STATE_DIR / "config.yaml"
    if path.exists():
        print(f"Config already exists: {path}")
        return 0
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(TEMPLATE)
    ensure_gitignore(args.path)
    print(f"Created {path}")
    return 0


def cmd_scan(args) -> int:
    spark = command_session()
    found = Store(spark, args.state).save_findings(run_scan(spark, args.path, args.state, args.fresh))
    _print_report(found, args.json)
    ensure_gitignore(args.state)
    return 0


def cmd_review(args) -> int:
    spark = command_session()
    if args.all:
        return cmd_scan(args)
    paths = changed_paths(args.path, args.base)
    if not paths:
        print('{"total": 0, "by_detector": {}, "findings": []}' if args.json else "No changed files to review.")
        return 0
    found = review(run_scan(spark, args.path, args.state, args.fresh), changed_files(spark, paths))
    _print_report(Store(spark, args.state).save_findings(found), args.json, " in changed files")
    ensure_gitignore(args.state)
    return 0


def cmd_next(args) -> int:
    store = Store(command_session(), args.state)
    _show(store.next(args.detector, store.cursor()))
    return 0


def _cmd_decide(status: str):
    def run(args) -> int:
        store = Store(command_session(), args.state)
        current = store.cursor()
        if not current:
            print("No current finding. Run `codevitals next` first.")
            return 1
        store.decide(current, status)
        print(f"{status.capitalize()} {current}")
        _show(store.next())
        return 0
    return run


def cmd_list(args) -> int:
    store = Store(command_session(), args.state)
    rows = triage.list_findings(store.findings(), store.decisions(), args.pending, args.detector)
    shown = False
    for r in rows.orderBy("seq").toLocalIterator():
        shown = True
        print(f"{r['hash']}  {r['status']:9} {r['detector']:15} {r['file']}:{r['line'] or ''}  {r['message']}")
    if not shown:
        print("No findings match your filters.")
    return 0


def cmd_stats(args) -> int:
    store = Store(command_session(), args.state)
    rows = triage.status_matrix(store.findings(), store.decisions()).orderBy("detector").collect()
    print(f"{'detector':15} {'pending':>8} {'resolved':>8} {'skipped':>8} {'total':>8}")
    for r in rows:
        print(f"{r['detector']:15} {r['pending']:8} {r['resolved']:8} {r['skipped']:8} {r['total']:8}")
    return 0


def cmd_fix(args) -> int:
    spark = command_session()
    if args.detector not in (None, "unused_imports"):
        print("Nothing to fix.")
        return 0
    config = Config.load(args.path)
    files = stored(read_tree(spark, args.path, config.ignore), "files")
    table = parse(files)
    found = stored(with_hash(unused_imports(table)), "findings")
    rewrites = stored(fixes.rewritten(files, found, table), "rewrites")
    lines, count = 0, 0
    # Texts come to the driver only where it writes them, one file at a time.
    wanted = rewrites.drop("text") if args.dry_run else rewrites
    for row in wanted.toLocalIterator():
        lines, count = lines + row["removed"], count + 1
        print(f"  {row['file']}: {row['removed']} line(s)")
        if not args.dry_run:
            (Path(args.path) / row["file"]).write_text(row["text"], encoding="utf-8")
    verb = "Would fix" if args.dry_run else "Fixed"
    print(f"{verb} {lines} unused imports across {count} files.")
    return 0


def parser() -> argparse.ArgumentParser:
    main_ = argparse.ArgumentParser(prog="codevitals", description="Code-health findings of a source tree.")
    main_.add_argument("--version", action="version", version=__version__)
    commands = main_.add_subparsers(dest="command")

    def command(name, run, path=False, **flags):
        sub = commands.add_parser(name)
        if path:
            sub.add_argument("path", nargs="?", default=".")
        sub.add_argument("--state", default=".", help="folder that holds the state")
        for flag, options in flags.items():
            sub.add_argument("--" + flag.replace("_", "-"), **options)
        sub.set_defaults(run=run)

    on = {"action": "store_true"}
    command("init", cmd_init, path=True)
    command("scan", cmd_scan, path=True, fresh=on, json=on)
    command("review", cmd_review, path=True, base={"default": "main"}, all=on, fresh=on, json=on)
    command("next", cmd_next, detector={"default": None})
    command("resolve", _cmd_decide("resolved"))
    command("skip", _cmd_decide("skipped"))
    command("list", cmd_list, pending=on, detector={"default": None})
    command("stats", cmd_stats)
    command("fix", cmd_fix, path=True, dry_run=on, detector={"default": None})
    return main_


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
