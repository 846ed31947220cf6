"""A directory tree as a Spark data source, in two steps: a listing, and the texts of what is wanted of it.

Spark's own file sources hide names that start with ``_`` or ``.`` (``__init__.py``), so the tree is listed here. The listing opens no file: skipped
directories are not descended into, ignored and unsupported names are left out, and so are names outside a wanted folder and files
that are too old. These two are options, not pushed filters: this Spark keeps what was pushed into a Python source for later uses of the same
DataFrame, which would then miss rows. What is left, joined with a cache or not, is dealt to tasks by number and bytes and read there. A directory or file that can't be read
gives a row with its path, a null text and the error. On a cluster the tree must be on storage all executors mount.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import DEFAULT_IGNORE
from ..findings import glob_to_regex
from ..functions.text import unify_newlines
from ..schema import SUPPORTED_SUFFIXES
from ..session import stored
from .filters import SKIPPED_ENDINGS, skipped_directories, suffix

LISTING = "file string, size bigint, mtime double, error string"
#: Directories that the driver looks for before it leaves the rest to tasks.
SHARES = 256
#: Bytes and files that a task reads, about.
TASK_BYTES, TASK_FILES = 64 << 20, 5000
_MOST_BYTES = (1 << 31) - 1024  # of one value in a batch
_BATCH_BYTES = 16 << 20


class _Share(InputPartition):
    """Directories (path below the root, whether what is below it belongs to the share)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        ignore = [g for g in options.get("ignore", "\n".join(DEFAULT_IGNORE)).split("\n") if g]
        self.pruned = set(skipped_directories(ignore))
        self.ignored = [re.compile(glob_to_regex(g)) for g in ignore]
        self.shares = int(options.get("shares", SHARES))
        self.under = options.get("under", "").strip("/")
        self.newer_than = float(options.get("newerThan", "-inf"))

    def _reachable(self, folder: str) -> bool:
        """A folder that is, holds, or lies in the wanted one."""
        return f"{folder}/".startswith(f"{self.under}/") or f"{self.under}/".startswith(f"{folder}/") or not self.under

    def _scan(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        """The folders and files of a folder; OSError if it can't be read."""
        with os.scandir(os.path.join(self.root, folder)) as entries:
            entries = list(entries)
        below = [e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.pruned and not e.name.startswith(".")]
        below = [os.path.join(folder, name) for name in below]
        return sorted(f for f in below if self._reachable(f)), [e for e in entries if e.is_file()]

    def partitions(self):
        """Level by level until there are enough directories; the last level's are walked whole by their tasks."""
        level, inner = [""], []
        while level and len(level) < self.shares:
            inner += level
            below = []
            for folder in level:
                try:
                    below += self._scan(folder)[0]
                except OSError:  # its task reports it
                    continue
            level = below
        folders = [(f, False) for f in inner] + [(f, True) for f in level]
        return [_Share(folders[i::self.shares]) for i in range(min(self.shares, len(folders)))]

    def _ignored(self, file: str) -> bool:
        prefixes = [file[:m.start()] for m in re.finditer("/", file)] + [file]
        return any(glob.search(p) for glob in self.ignored for p in prefixes)

    def read(self, share: _Share) -> Iterator[tuple]:
        pending = list(share.folders)
        while pending:
            folder, deep = pending.pop()
            try:
                below, files = self._scan(folder)
            except OSError as error:
                yield folder, None, None, str(error)
                continue
            if deep:
                pending += [(f, True) for f in below]
            for entry in files:
                file = os.path.join(folder, entry.name).replace(os.sep, "/")
                if os.path.splitext(entry.name)[1] not in SUPPORTED_SUFFIXES or file.endswith(tuple(SKIPPED_ENDINGS)) or self._ignored(file):
                    continue
                if self.under and not file.startswith(f"{self.under}/"):
                    continue
                try:
                    stat = entry.stat()
                except OSError as error:
                    yield file, None, None, str(error)
                    continue
                if stat.st_mtime > self.newer_than:
                    yield file, stat.st_size, stat.st_mtime, None


class TreeDataSource(DataSource):
    """``spark.read.format("source_tree").option("path", root).load()``: the listing."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, repo_id: str | None = None,
              under: str = "", newer_than: float | None = None) -> DataFrame:
    """repo_id, file, size, mtime, error of the source files below ``root``; no file is opened.

    ``under`` keeps to one folder, whose siblings aren't descended into; ``newer_than`` leaves out files with that or an earlier mtime.
    """
    ignore = DEFAULT_IGNORE if ignore is None else ignore
    spark.dataSource.register(TreeDataSource)
    reader = spark.read.format("source_tree").option("path", str(root)).option("ignore", "\n".join(ignore)).option("under", under)
    if newer_than is not None:
        reader = reader.option("newerThan", repr(newer_than))
    return reader.load().select(F.lit(repo_id or os.path.basename(os.path.realpath(root))).alias("repo_id"), "*")


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """The files of a stored listing as a files table, with the ``error`` of what can't be read (its text is null)."""
    root = os.path.realpath(root)
    total = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, total.n // TASK_FILES, total.bytes // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = {"repo_id": pa.string(), "file": pa.string(), "mtime": pa.float64(), "raw": pa.binary(), "error": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        rows, held = [], 0
        for batch in batches:
            for repo_id, file, size, mtime, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = None
                if error is None:
                    try:
                        if size > _MOST_BYTES:
                            raise OSError("file too large")
                        with open(os.path.join(root, file), "rb") as handle:
                            raw = handle.read()
                    except OSError as problem:
                        error = str(problem)
                rows.append((repo_id, file, mtime, raw, error))
                held += len(raw or b"")
                if held >= _BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    spread = listing.select("repo_id", "file", "size", "mtime", "error").repartition(tasks, "file")
    read = spread.mapInArrow(run, "repo_id string, file string, mtime double, raw binary, error string")
    text = F.col("raw").cast("string")
    return read.select(
        "repo_id", "file", suffix(F.col("file")).alias("suffix"), unify_newlines(F.make_valid_utf8(text)).alias("text"),
        F.coalesce(F.is_valid_utf8(text), F.lit(False)).alias("utf8_ok"), "mtime", "error")


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, repo_id: str | None = None) -> DataFrame:
    """The source files below ``root`` as a files table, and ``error``."""
    return read_files(stored(list_tree(spark, root, ignore, repo_id), "listing"), root)
