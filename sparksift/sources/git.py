"""Git history as a data source, for batches and for streams.

A partition is a range of commits: a number to pass over and a number to read, below tips that the
plan fixes.  So the driver holds tips and a count, never the commits.  A task lists its commits,
asks one `git diff-tree` for what they added or changed, and one `git cat-file --batch` for the contents.
A stream's offset is the set of tips that were read; a batch holds what the tips of now reach and
those don't.  The repository must be on a disk that all tasks see.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Commits of a partition; bytes of an Arrow batch; places for the files of a commit.
RANGE_COMMITS, BATCH_BYTES, PLACES = 500, 4 << 20, 1 << 20
_SCHEMA = "order bigint, file string, text string"
_LINK_TO_REPOSITORY = b"160000"


def run(repo: str, *args: str, given: bytes = b"") -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=given, capture_output=True, check=True).stdout


def tips(repo: str) -> list[str]:
    """The commits and tags that refs and HEAD name."""
    head = subprocess.run(["git", "-C", repo, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True).stdout.decode().split()
    return sorted({*run(repo, "rev-parse", "--all").decode().split(), *head})


def _bounds(new: list[str], old: list[str]) -> bytes:
    return "".join([*(f"{t}\n" for t in new), *(f"^{t}\n" for t in old)]).encode()


class Commits(InputPartition):
    def __init__(self, new: list[str], old: list[str], skip: int, count: int):
        self.new, self.old, self.skip, self.count = new, old, skip, count


def ranges(repo: str, new: list[str], old: list[str], each: int) -> list[Commits]:
    """Ranges of the commits that `new` reaches and `old` doesn't."""
    if not new:
        return []
    n = int(run(repo, "rev-list", "--count", "--stdin", given=_bounds(new, old)))
    return [Commits(new, old, at, min(each, n - at)) for at in range(0, n, each)]


def changed(repo: str, commits: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """(place of the commit, place in the commit, blob, path) of what commits added or changed; none for merges."""
    fields = iter(run(repo, "diff-tree", "--stdin", "-r", "-z", "--root", "--diff-filter=AM", given="".join(f"{c}\n" for c in commits).encode()).split(b"\0"))
    place, at = -1, 0
    number = {c: i for i, c in enumerate(commits)}
    for field in fields:
        if not field.startswith(b":"):
            place, at = number.get(field.strip().decode(), place), 0
            continue
        _, mode, _, blob, _ = field[1:].split(b" ")
        path = next(fields).decode("utf-8", "replace")
        if mode != _LINK_TO_REPOSITORY:
            yield place, at, blob.decode(), path
        at += 1


def contents(repo: str, part: Commits, wanted) -> Iterator[tuple[int, str, str]]:
    """(order, file, text) of the wanted paths that the commits of a range added or changed."""
    commits = run(repo, "rev-list", "--stdin", f"--skip={part.skip}", f"--max-count={part.count}", given=_bounds(part.new, part.old)).decode().split()
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as blobs:
        for place, at, blob, path in changed(repo, commits):
            if not wanted(path):
                continue
            blobs.stdin.write(f"{blob}\n".encode())
            blobs.stdin.flush()
            _, kind, *size = blobs.stdout.readline().split()
            if kind == b"missing":
                continue
            data = blobs.stdout.read(int(size[0]))
            blobs.stdout.read(1)
            yield (part.skip + place) * PLACES + at, f"git:{commits[place][:8]}:{path}", data.decode("utf-8", "replace")
        blobs.stdin.close()


class _Reading:
    def __init__(self, options: dict):
        self.repo, self.each = options["repo"], int(options.get("rangeCommits", RANGE_COMMITS))

    def read(self, part: Commits | None) -> Iterator[pa.RecordBatch]:
        from .files import text_path

        rows: list[tuple[int, str, str]] = []
        size = 0
        for row in contents(self.repo, part, text_path) if part else ():
            rows.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        order, file, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(file), pa.array(text, pa.string())], names=["order", "file", "text"])


class GitReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Commits]:
        return ranges(self.repo, tips(self.repo), [], self.each)


class GitStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"tips": ""}

    def latestOffset(self) -> dict:
        return {"tips": " ".join(tips(self.repo))}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        return ranges(self.repo, end["tips"].split(), start["tips"].split(), self.each)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: Spark's checkpoint holds the offsets."""


class GitSource(DataSource):
    """Options: repo, a path; rangeCommits, commits of a partition."""

    @classmethod
    def name(cls) -> str:
        return "sift_git"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)

    def streamReader(self, schema) -> GitStreamReader:
        return GitStreamReader(self.options)


def git_history(spark: SparkSession, repo: str, commits: int = RANGE_COMMITS) -> DataFrame:
    """(order, file, text) of a repository's history, newest first; file is git:<first 8 of the commit>:<path>."""
    spark.dataSource.register(GitSource)
    return spark.read.format("sift_git").option("repo", repo).option("rangeCommits", str(commits)).load()


def git_stream(spark: SparkSession, repo: str, commits: int = RANGE_COMMITS) -> DataFrame:
    """The same as a stream: first all history, then what refs reach since; order counts within a batch."""
    spark.dataSource.register(GitSource)
    return spark.readStream.format("sift_git").option("repo", repo).option("rangeCommits", str(commits)).load()
