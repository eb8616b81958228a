"""A small HTTP service over stored indices, answering in JSON."""

from __future__ import annotations

import itertools
import json
import os.path
import re
import time
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from lexigram.config import SearchConf
from lexigram.operators.store import open_index
from lexigram.plans.search import SearchArgs, results, search

VERSION = "0.1.0"


class BadRequest(ValueError):
    pass


def answer(spark: SparkSession, conf: SearchConf, target: str) -> tuple[int, dict | Iterator[str]]:
    """Status and body for a request's path and query; a search's body comes piece by piece, a partition of rows at a time."""
    url = urlsplit(target)
    if url.path in ("", "/"):
        return 200, {"name": "lexigram", "version": VERSION}
    if url.path.rstrip("/") != "/search":
        return 404, {"message": f"no such path: {url.path}", "code": 404}
    began, given = time.time(), parse_qs(url.query, keep_blank_values=True)

    def one(name: str, default: str | None = None) -> str:
        value = given.get(name, [default])[0]
        if not value:
            raise BadRequest(f"missing argument: {name}")
        return value

    def number(name: str, default: int) -> int:
        try:
            return int(one(name, str(default)))
        except ValueError:
            raise BadRequest(f"not a number: {name}") from None

    try:
        corpus = one("corpus")
        if not re.fullmatch(r"[^/\\]+", corpus) or corpus in (".", ".."):
            raise BadRequest("corpus is the name of a folder")
        asked = SearchArgs(one("q"), one("qtype", "default"), given.get("attrs", []), number("offset", 0), number("limit", -1))
        index = open_index(spark, os.path.join(conf.data_path, corpus, "ngrams"))
        rows = results(search(index, asked))
        first = next(rows, None)  # what fails does so before the answer begins
    except ValueError as e:
        return 400, {"message": str(e), "code": 400}
    except AnalysisException as e:
        return 404, {"message": str(e).splitlines()[0], "code": 404}

    def body() -> Iterator[str]:
        size = 0
        yield '{"rows": ['
        for row in itertools.chain([first] if first else [], rows):
            yield ", " * bool(size) + json.dumps(row, ensure_ascii=False)
            size += 1
        yield f'], "size": {size}, "searchTime": {time.time() - began}}}'

    return 200, body()


def handler(spark: SparkSession, conf: SearchConf) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        timeout = 20

        def do_GET(self) -> None:
            try:
                status, body = answer(spark, conf, self.path)
            except Exception as e:
                status, body = 500, {"message": str(e).splitlines()[0] if str(e) else type(e).__name__, "code": 500}
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            parts = [json.dumps(body, ensure_ascii=False)] if isinstance(body, dict) else body
            if isinstance(body, dict):
                self.send_header("Content-Length", str(len(parts[0].encode())))
            self.end_headers()  # without a length the body ends with the connection
            for part in parts:
                self.wfile.write(part.encode())

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(spark: SparkSession, conf: SearchConf) -> None:
    ThreadingHTTPServer((conf.address, conf.port), handler(spark, conf)).serve_forever()
