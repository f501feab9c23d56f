"""Options of the command line that decide which findings come, and folders without end."""

import json
import os

from pyspark.sql import functions as F

from sparksift.api import main
from sparksift.functions import text as X
from sparksift.sources import files as sources

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def test_ignored_and_repeated_findings(spark, tmp_path, capsys, monkeypatch):
    """--no-dedup leaves out the dedup only; --add-ignore adds one fingerprint to the ignore list and scans nothing."""
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    code = tmp_path / "code"
    for name in ("a.py", "b.py", "tests/c.py"):
        (code / name).parent.mkdir(parents=True, exist_ok=True)
        (code / name).write_text(f"k {TOKEN}\n")
    (code / "d.py").write_text("k ghp_" + "q7" * 18 + "\n")

    def found(*more):
        status = main([str(code), "--format", "json", "--no-entropy", "--show-secrets", "-o", str(tmp_path / "out.json"), *more], spark)
        return status, sorted((os.path.basename(r["file"]), r["severity"]) for r in json.loads((tmp_path / "out.json").read_text()) if r["rule"] == "github_personal_access_token")

    assert found() == (1, [("a.py", "CRITICAL"), ("d.py", "CRITICAL")])
    every = found("--no-dedup")[1]
    assert [n for n, _ in every] == ["a.py", "b.py", "c.py", "d.py"] and dict(every)["c.py"] != "CRITICAL"
    mark = spark.createDataFrame([("github_personal_access_token", "ghp_" + "q7" * 18, "d.py")], "r string, s string, f string").select(X.fingerprint(F.col("r"), F.col("s"), F.col("f")).alias("m")).first()["m"]
    (tmp_path / ".sparksiftignore").write_text("# mine\n0123456789abcdef\n")
    capsys.readouterr()
    assert main(["--add-ignore", f" {mark} "], spark) == 0
    assert (tmp_path / ".sparksiftignore").read_text() == f"# mine\n0123456789abcdef\n{mark}\n"
    assert [n for n, _ in found("--no-dedup")[1]] == ["a.py", "b.py", "c.py"]
    assert main(["--add-ignore", mark, "--ignore-file", str(tmp_path / "own")], spark) == 0 and (tmp_path / "own").read_text() == mark + "\n"


def test_decoders_switched_on_and_off(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / "h.txt").write_text(f"key {TOKEN} end".encode().hex())
    def hex_found(*more):
        main([str(tmp_path / "h.txt"), "--no-entropy", "--output", str(tmp_path / "out"), *more], spark)
        return "hex_github_personal_access_token" in (tmp_path / "out").read_text()

    assert [hex_found(), hex_found("--decode-hex"), hex_found("--decode-hex", "--no-decode-hex")] == [False, True, False]


def test_deep_folders_and_circles(spark, tmp_path):
    inner = tmp_path
    for _ in range(104):
        inner = inner / "d"
    inner.mkdir(parents=True)
    (inner / "deep.txt").write_text("x")
    os.symlink(tmp_path, inner / "up")
    os.symlink(tmp_path / "d" / "d", tmp_path / "side")
    files = lambda follow: sorted(r.file[len(str(tmp_path)) :] for r in sources.read_files(spark, str(tmp_path), follow_symlinks=follow).collect())
    plain = "/d" * 104 + "/deep.txt"
    assert files(False) == [plain]
    assert set(files(True)) == {plain, "/side" + plain[4:]}
