"""Git history in ranges of commits, and as a stream."""

import os
import random
import subprocess

from sparksift.model import ScanOptions
from sparksift.sources import files as sources
from sparksift.sources import git as G

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def commands(repo):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    clock = iter(range(10**9, 2 * 10**9, 60))

    def git(*args):
        at = f"{next(clock)} +0000"
        return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}).stdout.decode()

    return git


def made(repo, n):
    """A history with branches, a merge, changes, removals and odd names; what each commit added or changed."""
    repo.mkdir()
    git, rng, expected = commands(repo), random.Random(1), []
    git("init", "-q", "-b", "main")

    def commit(files, gone=()):
        for name, data in files.items():
            (repo / name).parent.mkdir(parents=True, exist_ok=True)
            (repo / name).write_bytes(data)
        for name in gone:
            (repo / name).unlink()
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-m", "x")
        key = git("rev-parse", "HEAD").strip()
        expected.append((key, {name: data for name, data in files.items() if sources.text_path(name)}))

    for i in range(n):
        commit({f"src/f{rng.randrange(4)}.py": f"line {i}\nk {TOKEN}\n".encode(), "blob.bin": os.urandom(20)})
    commit({"ü ö.txt": b"\xff bad\nx", "empty.md": b"", "with\"quote.cfg": b"q"})
    git("checkout", "-q", "-b", "side", "HEAD~2")
    commit({"side.env": b"S=1"})
    git("checkout", "-q", "main")
    commit({}, gone=["blob.bin"])
    git("merge", "-q", "--no-ff", "-m", "m", "side")
    git("tag", "-a", "v1", "-m", "t")
    return git, commit, expected


def rows(expected):
    return sorted((f"git:{key[:8]}:{name}", data.decode("utf-8", "replace")) for key, files in expected for name, data in files.items())


def test_ranges_of_commits(spark, tmp_path):
    git, _, expected = made(tmp_path / "r", 20)
    for each in (1, 7, 500):
        df = G.git_history(spark, str(tmp_path / "r"), each)
        got = df.collect()
        assert df.rdd.getNumPartitions() == -(-24 // each)
        assert sorted((r.file, r.text) for r in got) == rows(expected)
        place = {key[:8]: i for i, key in enumerate(git("rev-list", "--all").split())}
        ordered = [place[r.file.split(":")[1]] for r in sorted(got, key=lambda r: r.order)]
        assert ordered == sorted(ordered) and len({r.order for r in got}) == len(got)
    found = sources.git_findings(sources.git_history(spark, str(tmp_path / "r")), ScanOptions(entropy=False, decode_base64=False, json=False)).where("rule = 'github_personal_access_token'").collect()
    newest = next(key for key in git("rev-list", "--all").split() if any(k == key and any(TOKEN.encode() in d for d in f.values()) for k, f in expected))
    assert [(r.file.split(":")[1], r.line, r.secret) for r in found] == [(newest[:8], 2, TOKEN)]


def test_a_stream_goes_on_after_the_last_commit(spark, tmp_path):
    git, commit, expected = made(tmp_path / "r", 5)

    def read():
        query = G.git_stream(spark, str(tmp_path / "r"), 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        return sorted((r.file, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert read() == rows(expected)
    before = len(expected)
    assert read() == rows(expected)
    commit({"new.py": b"n1", "src/f1.py": b"changed"})
    commit({"new.py": b"n2"})
    assert read() == rows(expected) and len(expected) == before + 2


def test_a_repository_without_commits(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path / "e")], check=True)
    assert G.git_history(spark, str(tmp_path / "e")).count() == 0
