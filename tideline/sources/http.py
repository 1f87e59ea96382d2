"""A small HTTP front: checks each request, lands its body as it came in a file of the landing folder, then answers.

Requests that come in together share a file, and none is answered before its file is there. A landed file appears under its
final name only when it is complete, so a stream never reads half of one. A request that could not be landed gets a 500 and
leaves nothing. Bodies are decoded here only to refuse bad ones; the stream decodes them again on the executors.
"""

from __future__ import annotations

import datetime
import json
import os
import threading
import uuid
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from ..operators.routing import JSON_TYPE, PROTOBUF_TYPE, SIGNALS
from .payloads import MAX_BODY, TooLarge, check_json, check_text, decompress
from .wire import decode_request

#: Fixed values of the protocol: what an accepted export answers per signal.
ACCEPTED = {"traces": "rejectedSpans", "metrics": "rejectedDataPoints", "logs": "rejectedLogRecords"}
_SCHEMA = pa.schema([("signal", pa.string()), ("contentType", pa.string()), ("contentEncoding", pa.string()), ("received_at", pa.timestamp("us", "UTC")), ("body", pa.binary())])


class Refused(Exception):
    def __init__(self, status: int, code: int, message: str):
        super().__init__(message)
        self.status, self.body = status, {"code": code, "message": message}


def check_head(method: str, path: str, content_type: str | None, encoding: str | None) -> tuple[str, str]:
    """The signal and media type of a request, by its head alone."""
    if method != "POST":
        raise Refused(405, 12, "Method not allowed")
    route = path.split("?", 1)[0]
    if route not in [f"/v1/{s}" for s in SIGNALS]:
        raise Refused(404, 5, "Not found")
    media = (content_type or "").split(";")[0].strip().lower()
    if media not in (JSON_TYPE, PROTOBUF_TYPE):
        raise Refused(415, 3, f"Unsupported Content-Type: expected {JSON_TYPE} or {PROTOBUF_TYPE}")
    if (encoding or "").lower() not in ("", "identity", "gzip", "deflate"):
        raise Refused(415, 3, f"Unsupported Content-Encoding: {(encoding or '').lower()}")
    return route[4:], media


TOO_LARGE = Refused(413, 8, "Payload too large")


def check_body(signal: str, media: str, encoding: str | None, body: bytes) -> None:
    """Refuses a body that can't be read, or not stored."""
    try:
        plain = decompress(encoding, body)
    except TooLarge as e:
        raise TOO_LARGE from e
    except ValueError as e:
        raise Refused(400, 3, str(e)) from e
    try:
        if media == PROTOBUF_TYPE:
            check_text(decode_request(signal, plain))
        else:
            check_json(plain.decode("utf-8", "replace") or "{}")
    except TooLarge as e:
        raise TOO_LARGE from e
    except ValueError as e:
        raise Refused(400, 3, "Invalid protobuf" if media == PROTOBUF_TYPE else "Invalid JSON") from e


def read_body(stream: BinaryIO, headers: Mapping[str, str]) -> bytes:
    """The body of a request, by its chunks or its Content-Length; refuses broken framing and more than MAX_BODY bytes, after which a connection is of no use."""
    broken = Refused(400, 3, "Malformed request body")

    def exactly(n: int) -> bytes:
        if len(got := stream.read(n)) < n:
            raise broken
        return got

    coding = (headers.get("Transfer-Encoding") or "").strip().lower()
    if coding:
        if coding != "chunked":
            raise Refused(501, 12, "Unsupported Transfer-Encoding")
        parts, total = [], 0
        while True:
            size = stream.readline(1 << 16).split(b";")[0].strip()
            if not size or size.strip(b"0123456789abcdefABCDEF"):
                raise broken
            if not (n := int(size, 16)):
                break
            if (total := total + n) > MAX_BODY:
                raise TOO_LARGE
            parts.append(exactly(n))
            if stream.readline(3) not in (b"\r\n", b"\n"):
                raise broken
        # trailers, up to the blank line
        while stream.readline(1 << 16).strip():
            pass
        return b"".join(parts)
    length = (headers.get("Content-Length") or "0").strip()
    if not (length.isascii() and length.isdigit()):
        raise broken
    if int(length[:20]) > MAX_BODY:
        raise TOO_LARGE
    return exactly(int(length))


def local_folder(folder: str) -> Callable[[str, bytes], None]:
    """Saves files in a folder of this machine, under their names once complete."""

    def save(name: str, data: bytes) -> None:
        os.makedirs(folder, exist_ok=True)
        with open(hidden := os.path.join(folder, f".{name}"), "wb") as f:
            f.write(data)
        os.rename(hidden, os.path.join(folder, name))

    return save


def hadoop_folder(spark: SparkSession, folder: str) -> Callable[[str, bytes], None]:
    """Saves files in a folder of any file system that Spark reads, under their names once complete."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    files = path(folder).getFileSystem(conf)

    def save(name: str, data: bytes) -> None:
        try:
            out = files.create(hidden := path(folder, f".{name}"), True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
            done = files.rename(hidden, path(folder, name))
        except Exception as e:
            raise OSError(f"can't write to {folder}") from e
        if not done:
            raise OSError(f"can't write to {folder}")

    return save


class Landing:
    """Lands requests, those that wait at one time in one file; land() returns when its request's file is there."""

    def __init__(self, save: Callable[[str, bytes], None]):
        self._save, self._lock, self._writing, self._waiting = save, threading.Lock(), threading.Lock(), []

    def land(self, signal: str, media: str, encoding: str | None, body: bytes) -> None:
        row = {"signal": signal, "contentType": media, "contentEncoding": encoding, "received_at": datetime.datetime.now(datetime.UTC), "body": body}
        own: dict = {"row": row}
        with self._lock:
            self._waiting.append(own)
        # whoever gets to write takes all that wait along
        with self._writing:
            if "failed" not in own:
                with self._lock:
                    taken, self._waiting = self._waiting, []
                failed = None
                try:
                    out = BytesIO()
                    pq.write_table(pa.Table.from_pylist([t["row"] for t in taken], _SCHEMA), out)
                    self._save(f"{uuid.uuid4().hex}.parquet", out.getvalue())
                # whatever it is, all that wait must hear of it
                except Exception as e:  # noqa: BLE001
                    failed = e if isinstance(e, OSError) else OSError(f"can't land the request: {e}")
                for t in taken:
                    t["failed"] = failed
        if own["failed"]:
            raise own["failed"]


class Front:
    """start() listens on a port (0: any free one), stop() ends; both may be called at any time. save: how files get into the landing folder."""

    def __init__(self, landing: str, port: int = 4318, host: str = "0.0.0.0", save: Callable[[str, bytes], None] | None = None):
        self.landing, self._address, self._server = Landing(save or local_folder(landing)), (host, port), None

    @property
    def port(self) -> int:
        return self._server.server_address[1] if self._server else self._address[1]

    def start(self) -> Front:
        landing = self.landing

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"
            # seconds that a silent connection stays open
            timeout = 60

            def answer(self) -> None:
                body = None
                try:
                    body = read_body(self.rfile, self.headers)
                    encoding = self.headers.get("Content-Encoding")
                    signal, media = check_head(self.command, self.path, self.headers.get("Content-Type"), encoding)
                    check_body(signal, media, encoding, body)
                    landing.land(signal, media, encoding, body)
                    status, out = 200, json.dumps({"partialSuccess": {ACCEPTED[signal]: 0}}).encode()
                    if media == PROTOBUF_TYPE:
                        out = b""
                except Refused as e:
                    status, media, out = e.status, JSON_TYPE, json.dumps(e.body).encode()
                except TimeoutError:
                    status, media, out = 408, JSON_TYPE, json.dumps({"code": 4, "message": "Request timed out"}).encode()
                except OSError as e:
                    status, media, out = 500, JSON_TYPE, json.dumps({"code": 13, "message": str(e)}).encode()
                self.send_response(status)
                self.send_header("Content-Type", media)
                self.send_header("Content-Length", str(len(out)))
                if body is None:
                    # what follows on this connection can't be told from the body
                    self.send_header("Connection", "close")
                    self.close_connection = True
                self.end_headers()
                if self.command != "HEAD":
                    self.wfile.write(out)

            do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = do_OPTIONS = answer

            def log_message(self, *args) -> None:
                pass

        self._server = ThreadingHTTPServer(self._address, Handler)
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        if self._server:
            self._server.shutdown()
            self._server.server_close()
            self._server = None
