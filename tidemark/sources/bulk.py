"""Bulk sink of JSON documents: batches by bytes, retries when the receiver is busy.

The receiver is any object with ``send(list of documents) -> status``; status 429 means busy. Offline a
FolderReceiver writes the batches as files.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.scalar import backoff

BUSY = 429


class BulkError(Exception):
    pass


class FolderReceiver:
    """Writes each batch to a file of its own in a shared folder that executors can open."""

    def __init__(self, folder: str):
        self.folder = folder

    def send(self, documents: list[str]) -> int:
        os.makedirs(self.folder, exist_ok=True)
        name = os.path.join(self.folder, f"{uuid.uuid4().hex}.jsonl")
        with open(name + ".part", "w") as f:
            f.write("\n".join(documents) + "\n")
        os.rename(name + ".part", name)
        return 200


class HttpReceiver:
    """Sends batches to the bulk endpoint of a search index, with basic authentication if a user is given."""

    def __init__(self, endpoint: str, index: str, user: str | None = None, password: str | None = None, timeout_s: float = 60.0):
        self.url, self.index, self.timeout_s = f"{endpoint.rstrip('/')}/_bulk", index, timeout_s
        self.headers = {"Content-Type": "application/x-ndjson"}
        if user is not None:
            self.headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode()

    def send(self, documents: list[str]) -> int:
        action = json.dumps({"index": {"_index": self.index}})
        body = "".join(f"{action}\n{d}\n" for d in documents).encode()
        request = urllib.request.Request(self.url, body, self.headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                return answer.status
        except urllib.error.HTTPError as e:
            return e.code


def create_index(spark: SparkSession, name: str, shards: int = 10) -> None:
    """A table for documents, bucketed by series into shards, as the offline form of an index."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (series_id STRING, timestamp BIGINT, data ARRAY<STRING>) USING parquet CLUSTERED BY (series_id) INTO {int(shards)} BUCKETS")


class BulkClient:
    """Collects documents and sends them when they reach batch_bytes. After retries the batch fails."""

    def __init__(self, receiver, batch_bytes: int = 15_000_000, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.receiver, self.batch_bytes, self.retries, self.sleep = receiver, batch_bytes, retries, sleep
        self.pending: list[str] = []
        self.size = self.sent = self.flushes = 0

    def ingest(self, document: str) -> bool:
        """Add a document; True if that sent a batch."""
        self.pending.append(document)
        self.size += len(document.encode())
        return self.size >= self.batch_bytes and self.flush()

    def flush(self) -> bool:
        if not self.pending:
            return False
        waits = backoff()
        for attempt in range(self.retries + 1):
            status = self.receiver.send(self.pending)
            if status < 300:
                break
            if status != BUSY or attempt == self.retries:
                raise BulkError(f"{len(self.pending)} documents refused with status {status}")
            self.sleep(next(waits))
        self.sent += len(self.pending)
        self.flushes += 1
        self.pending, self.size = [], 0
        return True


def write_bulk(df: DataFrame, make_receiver: Callable, batch_bytes: int = 15_000_000, column: str = "document") -> None:
    """Send a column of documents, each task its own partition. A task that is run again sends again, so
    a receiver that must not see a document twice has to know it by its id."""

    def send(rows):
        client = BulkClient(make_receiver(), batch_bytes)
        for r in rows:
            client.ingest(r[column])
        client.flush()

    df.select(column).foreachPartition(send)
