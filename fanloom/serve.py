"""A read-only view of stored values over HTTP, for people who watch a query run."""

from __future__ import annotations

import json
import mimetypes
import shutil
import threading
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


class StoreServer:
    """Serves stores by name, one row of JSON per line, named SQL queries with parameters, and the files of a folder.

    Queries are fixed when the server is made; a request only gives values, which are bound and never put into the text.
    Only this machine can connect unless host is set. Answers are whole: rows are sent as they come, a partition at a time.
    A folder's files are given under their path below it; nothing outside it is.
    """

    def __init__(self, spark: SparkSession, stores: dict[str, Callable[[], DataFrame]], queries: dict[str, str] | None = None, host: str = "127.0.0.1", port: int = 0, mime: str = "text/plain", folder: str | None = None):
        self.spark, self.stores, self.queries, self.mime = spark, stores, queries or {}, mime
        self.folder = Path(folder).resolve() if folder else None
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                url = urlsplit(self.path)
                name = unquote(url.path).strip("/")
                lines = outer.answer(name, dict(parse_qsl(url.query)))
                file = outer.file(name) if lines is None else None
                self.send_response(404 if lines is None and file is None else 200)
                self.send_header("Content-Type", outer.mime if file is None else mimetypes.guess_type(file.name)[0] or "application/octet-stream")
                self.end_headers()
                if file is not None:
                    with file.open("rb") as f:
                        shutil.copyfileobj(f, self.wfile)
                for line in lines if lines is not None else [] if file is not None else ["no such store\n"]:
                    self.wfile.write(line.encode())

            def log_message(self, *args) -> None:
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.port = self._server.server_address[1]
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)
        self._thread.start()

    def answer(self, name: str, args: dict[str, str]) -> Iterator[str] | None:
        """The lines for a request; None if there is no store or query of that name."""
        if name in self.stores:
            df = self.stores[name]()
        elif name in self.queries:
            df = self.spark.sql(self.queries[name], args=args)
        else:
            return None
        return (json.dumps(r.asDict(recursive=True), default=str) + "\n" for r in df.toLocalIterator())

    def file(self, name: str) -> Path | None:
        """The file of that path below the folder, if there is one."""
        path = (self.folder / name).resolve() if self.folder else None
        return path if path and path.is_relative_to(self.folder) and path.is_file() else None

    def quit(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        self._thread.join()
