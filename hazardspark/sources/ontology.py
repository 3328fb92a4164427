"""Ontology schemas: which variables exist, of what kind, with which codes."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession

from ..config import SchemaChoice, load_schema_choice
from ..errors import AlgorithmError
from ..functions.keys import MISSING_TERM, term_key_of


def index_ontology(schema: dict) -> dict:
    """Key of each variable's class to (data type, keys of its codes); the missing term is a code of each."""
    try:
        out = {}
        for entry in schema["schema"]["variables"].values():
            terms = ((entry.get("valueMapping") or {}).get("terms") or {}).values()
            codes = {term_key_of(t.get("targetClass")) for t in terms} - {None}
            out[term_key_of(entry["class"])] = (entry["dataType"], codes | {MISSING_TERM})
        return out
    except (KeyError, AttributeError, TypeError):
        raise AlgorithmError("the ontology schema cannot be read") from None


def load_ontology(spark: SparkSession, path: str) -> dict:
    """The index of a JSON schema that Spark can reach."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        return index_ontology(json.loads(text))
    except ValueError:
        raise AlgorithmError("the ontology schema cannot be read") from None


WAIT = 30.0  # seconds for a remote schema


def fetch_ontology(url: str, tag: str | None = None) -> dict:
    """The index of a JSON schema at a URL; ``{tag}`` in it stands for the tag."""
    place = url.replace("{tag}", urllib.parse.quote(tag or "", safe=""))
    if urllib.parse.urlsplit(place).scheme not in ("http", "https"):
        raise AlgorithmError("a remote schema is read over http or https")
    with urllib.request.urlopen(place, timeout=WAIT) as answer:
        return index_ontology(json.load(answer))


def configured_ontology(spark: SparkSession, choice: SchemaChoice | None = None) -> dict:
    """The index of the schema that the configuration names.

    A remote one, where it is asked for and can be had, else the one at the path;
    without either the run fails rather than go on with requests that nothing
    has checked. No address is told.
    """
    choice = choice or load_schema_choice(spark)
    if choice.remote and choice.url:
        try:
            return fetch_ontology(choice.url, choice.tag)
        except Exception:
            if not choice.path:
                raise AlgorithmError("the remote ontology schema cannot be read") from None
    if not choice.path:
        raise AlgorithmError("no ontology schema is configured")
    return load_ontology(spark, choice.path)
