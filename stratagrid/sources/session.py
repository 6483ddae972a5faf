"""Sessions, and the settings that reading object stores needs."""

from __future__ import annotations

import base64
import logging
import os
import random
import socket
from collections.abc import Mapping
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def object_store_options(region: str | None = None, anonymous: bool = False, retries: int = 10, connections: int = 64, endpoint: str | None = None) -> dict[str, str]:
    """Settings of the S3A file system."""
    out = {"fs.s3a.retry.limit": str(retries), "fs.s3a.attempts.maximum": str(retries), "fs.s3a.connection.maximum": str(connections), "fs.s3a.threads.max": str(connections)}
    if region:
        out["fs.s3a.endpoint.region"] = region
    if endpoint:
        out["fs.s3a.endpoint"] = endpoint
    if anonymous:
        out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return out


def session(name: str = "stratagrid", master: str | None = None, options: Mapping[str, str] | None = None, **store) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in object_store_options(**store).items():
        builder = builder.config(f"spark.hadoop.{k}", v)
    for k, v in (options or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def memory_peaks(spark: SparkSession) -> list[dict]:
    """Of the driver and each executor, the most bytes so far of its JVM's heap, of execution memory, and of the whole
    JVM and Python workers where spark.executor.processTreeMetrics.enabled is set. Spark samples them with its
    heartbeats; one row per executor reaches the driver."""
    names = {"heap": "JVMHeapMemory", "execution": "OnHeapExecutionMemory", "jvm": "ProcessTreeJVMRSSMemory", "python": "ProcessTreePythonRSSMemory"}
    found = spark._jsc.sc().statusStore().executorList(False)
    out = []
    for k in range(found.size()):
        e = found.apply(k)
        peaks = e.peakMemoryMetrics()
        out.append({"executor": e.id()} | {k: int(peaks.get().getMetricValue(v)) if peaks.isDefined() else None for k, v in names.items()})
    return out


_TREES = ("alder", "ash", "aspen", "beech", "birch", "cedar", "cypress", "elm", "fir", "hazel", "hemlock", "hickory", "juniper", "larch", "linden", "maple", "oak", "pine", "poplar", "spruce", "willow", "yew")
_MOODS = ("bold", "brisk", "calm", "clear", "early", "fond", "gentle", "grand", "keen", "kind", "late", "light", "mild", "neat", "plain", "proud", "quick", "quiet", "sharp", "steady", "still", "warm")


def random_name() -> str:
    """A name for a run that is easy to say; not unique."""
    pick = random.SystemRandom().choice
    return f"{pick(_MOODS)}-{pick(_TREES)}"


class WebSocketHandler(logging.Handler):
    """Sends each record as a text frame to a ws:// address, which it connects to with the first one. A record that
    can't be sent is left to logging's own error handling, and the next one connects anew."""

    def __init__(self, url: str, timeout: float = 5) -> None:
        super().__init__()
        self.at, self.timeout, self._link = urlsplit(url), timeout, None
        if self.at.scheme != "ws" or not self.at.hostname:
            raise ValueError("the address begins with ws:// and a host")

    def _connect(self) -> socket.socket:
        link = socket.create_connection((self.at.hostname, self.at.port or 80), self.timeout)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (self.at.path or "/") + (f"?{self.at.query}" if self.at.query else "")
        head = (f"GET {path} HTTP/1.1", f"Host: {self.at.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13")
        link.sendall(("\r\n".join(head) + "\r\n\r\n").encode())
        answer = b""
        while b"\r\n\r\n" not in answer:
            more = link.recv(4096)
            if not more or len(answer) > 1 << 16:
                raise ConnectionError("no answer to the handshake")
            answer += more
        if answer.split(b" ", 2)[1:2] != [b"101"]:
            raise ConnectionError("the address speaks no websocket")
        return link

    def _send(self, opcode: int, data: bytes) -> None:
        """One masked frame, as clients send them."""
        n, mask = len(data), os.urandom(4)
        size = bytes([128 | n]) if n < 126 else bytes([254]) + n.to_bytes(2, "big") if n < 1 << 16 else bytes([255]) + n.to_bytes(8, "big")
        self._link.sendall(bytes([128 | opcode]) + size + mask + bytes(b ^ mask[k % 4] for k, b in enumerate(data)))

    def emit(self, record: logging.LogRecord) -> None:
        try:
            self._link = self._link or self._connect()
            self._send(1, self.format(record).encode())
        except Exception:  # as logging's own handlers do
            self._drop()
            self.handleError(record)

    def _drop(self) -> None:
        link, self._link = self._link, None
        if link:
            link.close()

    def close(self) -> None:
        if self._link:
            try:
                self._send(8, b"")
            except OSError:
                pass
        self._drop()
        super().close()


class JsonFormatter(logging.Formatter):
    """One JSON object per record."""

    def format(self, record: logging.LogRecord) -> str:
        import json

        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()})


def logger(level: str = "INFO", file: str | None = None, as_json: bool = False, websocket: str | None = None) -> logging.Logger:
    """The library's logger, to standard error, a file or a websocket."""
    out = logging.getLogger("stratagrid")
    out.setLevel(level)
    out.handlers = [WebSocketHandler(websocket) if websocket else logging.FileHandler(file) if file else logging.StreamHandler()]
    out.handlers[0].setFormatter(JsonFormatter() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    return out
