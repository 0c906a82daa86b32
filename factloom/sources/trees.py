"""A source of files: directory trees read by executors, as rows (repo, file, suffix, content).

Spark's own binary source drops every path with a part that begins with a dot or an underscore, so packages would lose
their ``__init__.py``; this source lists folders itself. Planning lists the tree level by level, the folders of a level side
by side, with names and sizes alone; files are dealt to tasks by bytes, so one folder that holds all is read by as many tasks
as its bytes ask for. Suffixes and repositories are chosen by options and applied to the list, so other files aren't
opened; they aren't taken from filters, as Spark 4.1 keeps a reader that took filters for later reads of the same frame
without them. Paths must be ones that driver and executors see.

Files in folders of other people's or built code, hidden ones, and those of other suffixes aren't read (the rule is
``extract.accepted``, applied to the path below the root). Links to folders aren't followed. A folder without such files
gives no rows; a file that can't be read fails the job.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, file string, suffix string, content binary"
#: Bytes of a task and of a batch at about, what opening a file counts as, and folders listed at once.
TASK_BYTES, BATCH_BYTES, OPENING, LISTED = 64_000_000, 16_000_000, 64_000, 32


def accepts(name: str, suffixes: tuple[str, ...]) -> bool:
    return not name.startswith(".") and os.path.splitext(name)[1] in suffixes


@dataclass
class Share(InputPartition):
    """Files that a task reads: (repo, root, path below it)."""

    files: list[tuple[str, str, str]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        from factloom.operators.extract import LANGUAGES, SKIPPED

        self.path = os.path.abspath(options["path"])
        self.each = options.get("each", "false") == "true"
        self.repo = options.get("repo") or os.path.basename(self.path)
        self.suffixes = tuple(options["suffixes"].split(",")) if options.get("suffixes") else tuple(LANGUAGES)
        self.task_bytes = int(options.get("task_bytes") or TASK_BYTES)
        self.skipped = frozenset(SKIPPED)
        self.repos = frozenset(json.loads(options["repos"])) if options.get("repos") else None
        if not os.path.isdir(self.path):
            raise ValueError(f"{self.path} isn't a folder")

    def listed(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders in a folder that are walked, and its accepted files with their sizes."""
        folders, files = [], []
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in self.skipped:
                        folders.append(e.name)
                elif accepts(e.name, self.suffixes) and e.is_file():
                    files.append((e.name, e.stat().st_size))
        return sorted(folders), sorted(files)

    def walked(self) -> Iterator[tuple[str, str, str, int]]:
        """repo, root, path below the root and size of each file, level by level."""
        roots = [(n, os.path.join(self.path, n)) for n in self.listed(self.path)[0]] if self.each else [(self.repo, self.path)]
        level = [(repo, root, "") for repo, root in roots if self.repos is None or repo in self.repos]
        with ThreadPoolExecutor(LISTED) as pool:
            while level:
                below = []
                for (repo, root, sub), (folders, files) in zip(level, pool.map(lambda x: self.listed(os.path.join(x[1], x[2])), level), strict=True):
                    yield from ((repo, root, os.path.join(sub, name), size) for name, size in files)
                    below += [(repo, root, os.path.join(sub, name)) for name in folders]
                level = below

    def partitions(self) -> list[InputPartition]:
        shares, files, size = [], [], 0
        for repo, root, file, own in self.walked():
            if files and size + own + OPENING > self.task_bytes:
                shares.append(Share(files))
                files, size = [], 0
            files.append((repo, root, file))
            size += own + OPENING
        return [*shares, Share(files)] if files or not shares else shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        names = ["repo", "file", "suffix", "content"]
        held: list[tuple[str, str, str, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in held], pa.binary() if k == 3 else pa.string()) for k in range(4)]
            return pa.RecordBatch.from_arrays(columns, names)

        for repo, root, file in partition.files:
            with open(os.path.join(root, file), "rb") as f:
                data = f.read()
            held.append((repo, file.replace(os.sep, "/"), os.path.splitext(file)[1], data))
            size += len(data)
            if size > BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class SourceTree(DataSource):
    """Format ``source_tree``; options: path, repo (a name; else the folder's), each (every folder in path is a repository),
    repos (a JSON list of those wanted), suffixes (comma-separated) and task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, each: bool = False, suffixes: tuple[str, ...] | None = None, repo: str | None = None, repos: tuple[str, ...] | None = None) -> DataFrame:
    """repo, file, suffix, content (bytes) of the accepted files below path; suffixes and repos are those wanted, if not all."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("each", str(each).lower())
    if suffixes is not None:
        reader = reader.option("suffixes", ",".join(sorted(suffixes)))
    if repo:
        reader = reader.option("repo", repo)
    if repos is not None:
        reader = reader.option("repos", json.dumps(sorted(repos)))
    return reader.load(path)
