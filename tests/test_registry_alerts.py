"""Scan results by id, and alerts that come once."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from sparksift import api
from sparksift.model import FINDING
from sparksift.sinks.registry import ScanRegistry
from sparksift.streaming import alerts

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def table(spark, n, start=0):
    return spark.createDataFrame([(f"f{i % 5}.py", i, "r", ("LOW", "HIGH")[i % 2], f"secret-{i}", "c", 1.5, 1, "", "") for i in range(start, start + n)], FINDING).repartition(3)


def test_scans_are_kept_by_id_and_read_in_pages(spark, tmp_path):
    held = ScanRegistry(spark, str(tmp_path / "r"), seconds=100)
    one, two = held.put(table(spark, 250), 0.0), held.put(table(spark, 0), 50.0)
    pages, after = [], 0
    while page := held.page(one, 60.0, after, 100):
        pages.append(page)
        after = page[-1]["place"]
    assert [len(p) for p in pages] == [100, 100, 50]
    rows = [r for p in pages for r in p]
    assert [r["place"] for r in rows] == list(range(1, 251)) and len({r["secret"] for r in rows}) == 250
    assert [(r["severity"] != "HIGH", r["file"], r["line"]) for r in rows] == sorted((r["severity"] != "HIGH", r["file"], r["line"]) for r in rows)
    assert held.page(two, 60.0) == [] and held.page("nothing", 60.0) is None and held.page("", 60.0) is None
    assert held.page(one, 100.0) is None and held.page(two, 100.0) == []
    three = held.put(table(spark, 1), 120.0)
    assert set(n.split("@")[0] for n in held.tables.current()[1]) == {two, three}
    again = ScanRegistry(spark, str(tmp_path / "r"), seconds=100)
    assert len(again.page(three, 130.0)) == 1 and again.findings(three, 130.0).count() == 1


def test_rest_serves_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"k ghp_{i:036}" for i in range(7)))
    service = api.RestService(spark, registry=ScanRegistry(spark, str(tmp_path / "r")))
    server = api.serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        call = lambda path, body=None: json.loads(urllib.request.urlopen(urllib.request.Request(at + path, body and json.dumps(body).encode()), timeout=120).read())
        assert call("/health") == {"status": "ok"}
        made = call("/scan", {"paths": [str(tmp_path / "a.txt")], "severity": "CRITICAL", "high_entropy_scan": False})
        assert made["summary"]["total"] == len(made["findings"]) >= 7 and all("..." in f["secret"] for f in made["findings"])
        page = call(f"/scan/{made['scan_id']}?after=2&size=3")
        assert [f["place"] for f in page["findings"]] == [3, 4, 5] and page["next"] == 5
        assert call(f"/scan/{made['scan_id']}?after=5&size=1000")["next"] is None
        with pytest.raises(urllib.error.HTTPError, match="404"):
            call("/scan/none")
        with pytest.raises(urllib.error.HTTPError, match="400"):
            call(f"/scan/{made['scan_id']}?after=x")
    finally:
        server.shutdown()
        server.server_close()


def test_rpc_loop(spark):
    out = io.StringIO()
    api.rpc_loop(spark, io.StringIO('{"jsonrpc": "2.0", "id": 1, "method": "nope"}\n\nbroken\n'), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["error"]["code"] for a in answers] == [api.NO_METHOD, api.PARSE_ERROR]


def test_a_batch_that_fails_half_way_sends_nothing_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alerts, "EACH", 10)
    box, got, waits = alerts.Outbox(spark, str(tmp_path / "o")), [], []
    broken = [True]

    def transport(message):
        if broken[0] and len(got) == 2:
            raise OSError("down")
        got.append(message)
        return True

    rows = table(spark, 35).unionByName(table(spark, 5))
    with pytest.raises(OSError):
        alerts.deliver(rows, 4, box, transport, False, waits.append)
    assert waits == [1, 2] and len(got) == 2
    broken[0] = False
    assert alerts.deliver(rows, 4, box, transport, False, waits.append) == 15
    assert alerts.deliver(rows, 4, box, transport, False) == 0
    assert alerts.deliver(table(spark, 10, 30), 5, box, transport, True) == 5
    sent = [f["secret"] for m in got for f in m["findings"]]
    assert len(sent) == len(set(sent)) == 40 and len({m["key"] for m in got}) == len(got)
    assert sorted(sent[:35]) == sorted(f"secret-{i}" for i in range(35)) and all("*" in s for s in sent[35:])
    monkeypatch.setattr(alerts, "MOST_PARTS", 2)
    box.note(["x"], 9)
    assert len(box.tables.current()[1]["sent"]) == 1 and box.sent().count() == 41


def test_alerts_of_a_stream(spark, tmp_path):
    got = []
    folder = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(FINDING).parquet(folder)
        query = alerts.alert(stream, str(tmp_path / "o"), str(tmp_path / "state"), lambda m: got.append(m) or True, redact=False)
        assert query.awaitTermination(120)

    table(spark, 5).write.parquet(folder)
    run()
    table(spark, 8).write.mode("append").parquet(folder)
    run()
    assert sorted(f["secret"] for m in got for f in m["findings"]) == [f"secret-{i}" for i in range(8)]
