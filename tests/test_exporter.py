"""The exporter against a local server: split batches, capacity, bounded history, repeated epochs, retries."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from runweave.sources import exporter, queue


@pytest.fixture
def server():
    """A server that keeps what it gets, and answers by `status` (200 unless told otherwise)."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["content-length"]))
            status = self.server.answers.pop(0) if self.server.answers else 200
            self.server.got.append((status, json.loads(body)))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.got, s.answers = [], []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def spans(spark, n, resource="{}"):
    return spark.range(n).select(F.lit(resource).alias("resource"), F.lit('{"name":"x"}').alias("scope"), (F.lit(n) - F.col("id")).alias("start_ns"), F.format_string("%016x", "id").alias("span_id"), F.struct(F.col("id").alias("n")).alias("span"))


def sent(server):
    return [[s["n"] for s in body["resourceSpans"][0]["scopeSpans"][0]["spans"]] for status, body in server.got if status == 200]


def url(server):
    return f"http://127.0.0.1:{server.server_port}/v1/traces"


def test_batches_are_runs_of_starts_and_go_out_once(spark, server, tmp_path):
    e = exporter.Exporter(spark, str(tmp_path), queue.sender(url(server)), batch_spans=100)
    assert e.export(spans(spark, 950)) == {"state": "queued", "batches": 10, "message": None}
    out = e.flush()
    assert (out["sent"], out["pending"], out["deadline_exceeded"]) == (10, 0, False) and {d["state"] for d in out["deliveries"]} == {"accepted"}
    assert sorted(sent(server), key=max, reverse=True) == [list(range(949 - 100 * k, max(-1, 849 - 100 * k), -1)) for k in range(10)]
    # an epoch that comes again, and a flush with nothing new, send nothing
    e._batch(e._spooled(), 0)
    assert len(server.got) == 10 and e.flush()["sent"] == 0
    assert e.export(spans(spark, 0))["message"] == "no spans to send"
    assert e.export(spans(spark, 3, '{"a":1}'))["batches"] == 1
    assert e.shutdown()["sent"] == 1 and len(server.got) == 11 and not e.stream.isActive


def test_what_fits_is_delivered(spark, server, tmp_path):
    e = exporter.Exporter(spark, str(tmp_path), queue.sender(url(server)), batch_spans=1, max_entries=1)
    assert e.export(spans(spark, 2)) == {"state": "not_queued", "batches": 1, "message": "QUEUE_CAPACITY_EXCEEDED"}
    assert e.shutdown()["pending"] == 0 and sent(server) == [[1]]


def test_history_is_bounded_and_failures_are_tried_again(spark, server, tmp_path):
    server.answers += [400]
    calls = url(server)
    e = exporter.Exporter(spark, str(tmp_path), queue.sender(calls), batch_spans=1, history=5)
    e.export(spans(spark, 9))
    out = e.flush()
    assert out["sent"] == 9 and len(out["deliveries"]) == 5 and out["pending"] == 0 and sorted(s for s, _ in server.got) == [200] * 8 + [400]

    def failing(request):
        raise OSError("down")

    e.send = failing
    e.export(spans(spark, 2, '{"b":1}'))
    out = e.flush()
    assert out["pending"] == 2 and {d["state"] for d in out["deliveries"]} == {"unknown_delivery"} and {d["message"] for d in out["deliveries"]} == {"down"}
    e.send = queue.sender(calls)
    out = e.shutdown()
    assert out["pending"] == 0 and out["sent"] == 2 and len(server.got) == 11
