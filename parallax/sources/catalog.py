"""A catalogue of binary functions behind HTTP servers, as a Spark data source.

Each server is one partition: its functions are listed and, if asked for, their code fetched by the task that reads it.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "binary_id string, name string, address string, code string, raw_name string"


class Server(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


def fetch(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


def function_rows(body: str) -> Iterator[tuple[str, str, str]]:
    """(name, address, raw_name) of a listing: JSON, or else a name and an address on each line."""
    try:
        data = json.loads(body)
        for f in data.get("functions", []) if isinstance(data, dict) else data:
            if isinstance(f, dict):
                yield f.get("name", ""), str(f.get("address", "")), f.get("raw_name", f.get("name", ""))
            else:
                yield str(f), "", str(f)
    except ValueError:
        for line in filter(str.strip, body.splitlines()):
            name, _, address = line.strip().partition(" ")
            yield name, address.strip(), name


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split(",") if u]
        self.timeout, self.code = float(options.get("timeout", "5")), options.get("code", "false") == "true"

    def partitions(self):
        return [Server(u) for u in self.urls]

    def read(self, partition: Server):
        base = partition.url.rstrip("/")
        for name, address, raw in function_rows(fetch(f"{base}/functions", self.timeout)):
            code = fetch(f"{base}/decompile?name={urllib.parse.quote(name)}", self.timeout) if self.code else None
            yield base, name, address, code, raw


class FunctionCatalog(DataSource):
    @classmethod
    def name(cls):
        return "function_catalog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FunctionCatalog)
