"""Triples of a SPARQL endpoint, as a Spark data source: pages are partitions.

The endpoint counts first; each page of the ordered result is then read by a
task of its own, once, with a few tries. Only what the requested variables need
is asked for (``pattern``), so the endpoint drops the rest.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import UserInputError
from ..functions.keys import namespaces
from .triples import HAS_CELL, HAS_COLUMN, HAS_VALUE

PAGE_ROWS = 10_000
TRIES = 4
PAUSE = 0.2  # seconds before the second try; each further one waits twice as long
WAIT = 30.0
# The two predicates that are not of the data model.
TYPE_IRI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS_IRI = "http://www.w3.org/2000/01/rdf-schema#subClassOf"


def iri(name: str) -> str:
    """``<...>`` of an IRI or of a name with a known prefix."""
    known: dict[str, list[str]] = {}
    for full, prefix in namespaces().items():
        known.setdefault(prefix, []).append(full)
    prefix, _, local = name.partition(":")
    full = known[prefix][0] + local if prefix in known and not local.startswith("//") else name.strip("<>")
    if not full or any(c in full for c in '<>"{}|\\^` \t\r\n'):
        raise UserInputError("a variable's name is no IRI")
    return f"<{full}>"


def pattern(variables: list[str], model: str) -> str:
    """The triples from patients to the cells of the given variables; model: the IRI under which the data model's predicates are."""
    column, cell, value = (iri(model + p) for p in (HAS_COLUMN, HAS_CELL, HAS_VALUE))
    rdf_type, sub = f"<{TYPE_IRI}>", f"<{SUBCLASS_IRI}>"
    classes = " ".join(iri(v) for v in variables)
    parts = [
        f"?s {column} ?o . ?o {rdf_type} ?k . BIND({column} AS ?p)",
        f"?s {rdf_type} ?k . BIND(?k AS ?o) BIND({rdf_type} AS ?p)",
        f"?s {rdf_type} ?k . ?s {cell} ?o . BIND({cell} AS ?p)",
        f"?c {rdf_type} ?k . ?c {cell} ?s . ?s {value} ?o . BIND({value} AS ?p)",
        f"?c {rdf_type} ?k . ?c {cell} ?s . ?s {rdf_type} ?o . ?o {sub} ?k . BIND({rdf_type} AS ?p)",
        f"?s {sub} ?k . BIND(?k AS ?o) BIND({sub} AS ?p)",
    ]
    return f"VALUES ?k {{ {classes} }} " + " UNION ".join(f"{{ {p} }}" for p in parts)


@dataclass
class Page(InputPartition):
    offset: int
    rows: int


def ask(endpoint: str, query: str, tries: int, wait: float) -> list[dict]:
    """The bindings of a query; again after a pause where the endpoint is busy or does not answer."""
    body = urllib.parse.urlencode({"query": query}).encode()
    for n in range(tries):
        try:
            request = urllib.request.Request(endpoint, body, {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"})
            with urllib.request.urlopen(request, timeout=wait) as answer:
                return json.load(answer)["results"]["bindings"]
        except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as error:
            refused = isinstance(error, urllib.error.HTTPError) and error.code < 500 and error.code != 429
            if refused or n + 1 == tries:
                raise
            time.sleep(PAUSE * 2**n)
    raise UserInputError("tries must be positive")


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoint, self.where = options["endpoint"], options["where"]
        self.page, self.tries, self.wait = int(options.get("page", PAGE_ROWS)), int(options.get("tries", TRIES)), float(options.get("wait", WAIT))

    def partitions(self) -> list[Page]:
        found = ask(self.endpoint, f"SELECT (COUNT(*) AS ?n) WHERE {{ SELECT DISTINCT ?s ?p ?o WHERE {{ {self.where} }} }}", self.tries, self.wait)
        total = int(found[0]["n"]["value"])
        return [Page(at, min(self.page, total - at)) for at in range(0, total, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.rows:
            return
        query = f"SELECT DISTINCT ?s ?p ?o WHERE {{ {self.where} }} ORDER BY ?s ?p ?o LIMIT {partition.rows} OFFSET {partition.offset}"
        got = ask(self.endpoint, query, self.tries, self.wait)
        if len(got) != partition.rows:
            raise RuntimeError("the endpoint's triples changed while they were read")
        for row in got:
            yield tuple(row[c]["value"] for c in "spo")


class TriplesEndpoint(DataSource):
    """Format ``triples-endpoint``; options endpoint, where, page, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return "triples-endpoint"

    def schema(self) -> str:
        return "s string, p string, o string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read_endpoint(spark: SparkSession, endpoint: str, variables: list[str], model: str, page: int = PAGE_ROWS, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """s, p, o of what the variables need; lazily, so bound it in time and keep it with ``collect_bounded`` and ``snapshot``."""
    spark.dataSource.register(TriplesEndpoint)
    options = {"endpoint": endpoint, "where": pattern(variables, model), "page": page, "tries": tries, "wait": wait}
    return spark.read.format("triples-endpoint").options(**options).load()
