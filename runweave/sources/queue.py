"""A durable queue of export batches, their delivery, and export to OTLP/JSON."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.places import placed
from ..operators.procedures import settled

#: Limits of a queue and of a sender.
MAX_ENTRIES, MAX_BYTES, RETENTION_S, STALE_LOCK_S = 1000, 64 << 20, 7 * 86400, 300
TIMEOUT_S, MAX_ATTEMPTS, BUDGET_S, MAX_REPLY = 10, 3, 30, 4 << 20
RETRY_STATUS = (429, 502, 503, 504)
SPANS_PER_BATCH = 512


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def requests(spans: DataFrame, limit: int = SPANS_PER_BATCH) -> DataFrame:
    """(resource, scope: JSON; start_ns, span_id, span: struct) -> group, batch, n_spans, request: OTLP/JSON of `limit` spans (the last one of fewer) of one resource and scope.

    Each batch is a run of starts: spans are placed in their group by start and id, spread over ranges, so no task sorts a whole group.
    """
    s = placed(spans, ["resource", "scope"], ["start_ns", "span_id"], settled).withColumn("batch", F.floor(F.col("place") / limit))
    g = s.groupBy("resource", "scope", "batch").agg(F.count("*").alias("n_spans"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "span"))), lambda x: x["span"])).alias("spans"))
    text = F.concat(F.lit('{"resourceSpans":[{"resource":'), "resource", F.lit(',"scopeSpans":[{"scope":'), "scope", F.lit(',"spans":'), "spans", F.lit("}]}]}"))
    return g.select(F.sha2(F.concat_ws("|", "resource", "scope"), 256).alias("group"), F.col("batch").cast("string").alias("batch"), "n_spans", text.alias("request"))


def dry_run(requests_: DataFrame) -> DataFrame:
    """What would be sent: one row a group, nothing leaves."""
    return requests_.groupBy("group").agg(F.count("*").alias("batches"), F.sum("n_spans").alias("spans"), F.sum(F.octet_length("request")).alias("bytes")).withColumn("state", F.lit("dry_run"))


class Full(Exception):
    pass


class Queue:
    """Batches as files of a folder, first in, first out, for one consumer at a time."""

    def __init__(self, folder: str, alias: str, config: dict | None = None, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, retention_s: float = RETENTION_S, now: Callable[[], float] = time.time):
        self.folder, self.alias, self.config, self.now = Path(folder), alias, fingerprint(config or {}), now
        self.max_entries, self.max_bytes, self.retention = max_entries, max_bytes, retention_s
        self.folder.mkdir(parents=True, exist_ok=True)

    def scan(self, drop: bool = False) -> tuple[list[tuple[Path, dict]], dict]:
        """Own entries in order, and counts; with drop, what is malformed or too old goes."""
        mine, n = [], {"pending": 0, "bytes": 0, "expired": 0, "malformed": 0, "foreign": 0}
        for p in sorted(self.folder.glob("batch-*.json")):
            kind = "malformed"
            try:
                e = json.loads(p.read_text())
                if isinstance(e["request"], str):
                    kind = "expired" if self.now() - e["created"] > self.retention else "pending" if (e["alias"], e["config"]) == (self.alias, self.config) else "foreign"
            except (ValueError, KeyError, TypeError, OSError):
                pass
            n[kind] += 1
            if kind in ("pending", "foreign"):
                n["bytes"] += p.stat().st_size
            if kind == "pending":
                mine.append((p, e))
            elif drop and kind in ("malformed", "expired"):
                p.unlink(missing_ok=True)
        mine.sort(key=lambda x: (x[1]["created"], x[1]["batch"]))
        return mine, n

    def _write(self, path: Path, entry: dict) -> None:
        tmp = path.with_suffix(f".{os.getpid()}.tmp")
        with tmp.open("w") as f:
            json.dump(entry, f)
            f.flush()
            os.fsync(f.fileno())
        tmp.replace(path)

    def put(self, batch: str, request: str, n_spans: int) -> Path:
        _, n = self.scan(drop=True)
        if n["pending"] + n["foreign"] >= self.max_entries or n["bytes"] + len(request.encode()) > self.max_bytes:
            raise Full("QUEUE_CAPACITY_EXCEEDED")
        name = hashlib.sha256(batch.encode()).hexdigest()[:32]
        path = self.folder / f"batch-{name}.json"
        if not path.exists():
            self._write(path, {"batch": batch, "alias": self.alias, "config": self.config, "created": self.now(), "attempts": 0, "n_spans": n_spans, "request": request})
        return path

    def _lock(self) -> Path:
        lock = self.folder / "consumer.lock"
        if lock.exists() and self.now() - lock.stat().st_mtime > STALE_LOCK_S:
            lock.unlink(missing_ok=True)
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        return lock

    def flush(self, send: Callable[[str], dict], deadline_s: float | None = None) -> dict:
        """Sends what is pending: what is accepted or rejected goes, the rest stays with its attempts counted."""
        lock, start, reports, late = self._lock(), self.now(), [], False
        try:
            for path, e in self.scan(drop=True)[0]:
                if deadline_s is not None and self.now() - start >= deadline_s:
                    late = True
                    break
                try:
                    r = send(e["request"])
                except Exception as x:  # noqa: BLE001 - a sender that fails leaves the delivery unknown
                    r = {"state": "unknown_delivery", "attempts": 1, "message": str(x)}
                reports.append({"batch": e["batch"], **r})
                if r["state"] in ("accepted", "rejected"):
                    path.unlink(missing_ok=True)
                else:
                    self._write(path, {**e, "attempts": e["attempts"] + r.get("attempts", 1)})
        finally:
            lock.unlink(missing_ok=True)
        return {"deliveries": reports, "pending": self.scan()[1]["pending"], "deadline_exceeded": late}


def wait_s(reply_header: str | None, attempt: int, noise: Callable[[], float] = random.random) -> float:
    """The server's Retry-After in seconds, else 0.25 s doubled at each attempt with up to a fifth more."""
    if reply_header and reply_header.strip().isdigit():
        return float(reply_header)
    return 0.25 * 2 ** (attempt - 1) * (1 + 0.2 * noise())


def sender(url: str, headers: dict[str, str] | None = None, opener=urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> Callable[[str], dict]:
    """A function that posts one request and reports accepted, rejected, partial or retryable."""

    def send(request: str) -> dict:
        start = now()
        for attempt in range(1, MAX_ATTEMPTS + 1):
            after = None
            try:
                q = urllib.request.Request(url, request.encode(), {"content-type": "application/json", **(headers or {})}, method="POST")
                with opener(q, timeout=TIMEOUT_S) as reply:
                    body = reply.read(MAX_REPLY + 1)
                partial = json.loads(body or b"{}").get("partialSuccess") or {} if len(body) <= MAX_REPLY else {}
                lost = int(partial.get("rejectedSpans") or 0)
                return {"state": "accepted", "attempts": attempt, "rejected_spans": lost}
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_STATUS:
                    return {"state": "rejected", "attempts": attempt, "status": e.code}
                after = e.headers.get("Retry-After") if e.headers else None
            except (OSError, ValueError):
                pass
            pause = wait_s(after, attempt)
            if attempt == MAX_ATTEMPTS or now() - start + pause > BUDGET_S:
                break
            sleep(pause)
        return {"state": "unknown_delivery", "attempts": attempt}

    return send
