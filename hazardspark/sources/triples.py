"""Patients described by triples, flattened to one row each.

patient -has_column-> column (rdf:type a variable) -has_cell-> cell, and the
cell has a value and perhaps a term (an rdf:type that is a subclass of the
variable). The term counts before the value.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_collect_timeout
from ..errors import AlgorithmError
from ..functions.keys import term_key, term_key_of

# Predicates of the data model, by local name, and of RDF.
HAS_COLUMN, HAS_CELL, HAS_VALUE, TYPE, SUBCLASS = "has_column", "has_cell", "has_value", "type", "subClassOf"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of N-Triples files; IRIs without brackets, literals without quotes, type or language."""
    line = F.col("value")
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(.*?)\s*\.\s*$"
    raw = spark.read.text(path).filter(line.rlike(pattern))
    part = lambda i: F.regexp_extract(line, pattern, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.regexp_extract(part(3), r'^"((?:[^"\\]|\\.)*)"', 1)
    for escaped, plain in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")):
        literal = F.replace(literal, F.lit(escaped), F.lit(plain))
    return raw.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(part(3).startswith('"'), literal).otherwise(bare(part(3))).alias("o"))


def flatten_patients(triples: DataFrame, variables: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """patient and one text column per variable (by key of its name), null where a patient has none.

    Joins are on the subject, never on the order of rows. Of several cells of
    one variable the least is taken. by: columns (the site) that keep graphs
    apart; patients have them too.

    The triples are read once: grouped by subject, each subject has its facts,
    and every step along the path from patients to terms joins with that one
    table, whose shuffle Spark reuses.
    """
    by = list(by)
    local = F.regexp_extract("p", r"([^#/]+)$", 1)
    t = triples.withColumn("p", local).filter(F.col("p").isin(HAS_COLUMN, HAS_CELL, HAS_VALUE, TYPE, SUBCLASS))
    for c in [*by, "s", "o"]:
        t = t.filter(F.col(c).isNotNull())
    facts = t.groupBy(*by, "s").agg(F.collect_set(F.struct("p", "o")).alias("facts"))

    def of(predicate: str, facts: str = "facts"):
        return F.transform(F.filter(facts, lambda f: f["p"] == predicate), lambda f: f["o"])

    def joined(rows: DataFrame, subject: str, name: str, how: str) -> DataFrame:
        """``rows`` with the facts of a subject among their columns."""
        own = facts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("s").alias("__s"), F.col("facts").alias(name))
        on = [F.col(c) == F.col(f"__{c}") for c in by] + [F.col(subject) == F.col("__s")]
        return rows.join(own, on, how).drop(*[f"__{c}" for c in by], "__s")

    named = {name: f"v{i}" for i, name in enumerate(variables)}
    key = F.regexp_replace(term_key(F.col("class"), "string"), "^[ns]:", "")
    slot = F.lit(None).cast("string")
    for name, short in named.items():
        slot = F.when(key == str(term_key_of(name)), short).otherwise(slot)
    columns = facts.select(*by, F.col("s").alias("patient"), F.explode(of(HAS_COLUMN)).alias("column"))
    columns = joined(columns, "column", "of_column", "inner").select(*by, "patient", "of_column", F.explode(of(TYPE, "of_column")).alias("class"))
    cells = columns.withColumn("slot", slot).filter("slot is not null").select(*by, "patient", "slot", "class", F.explode(of(HAS_CELL, "of_column")).alias("cell"))
    cells = joined(cells, "cell", "of_cell", "left")
    cells = cells.select(*by, "patient", "slot", "class", "cell", F.array_min(of(HAS_VALUE, "of_cell")).alias("value"), F.explode_outer(of(TYPE, "of_cell")).alias("term"))
    terms = joined(cells, "term", "of_term", "left")
    term = F.when(F.array_contains(of(SUBCLASS, "of_term"), F.col("class")), F.col("term"))
    each = terms.groupBy(*by, "patient", "slot", "class", "cell").agg(F.coalesce(F.min(term), F.min("value")).alias("value"))
    wide = each.groupBy(*by, "patient").pivot("slot", list(named.values())).agg(F.min("value"))
    return wide.select(*by, "patient", *[F.col(short).alias(name) for name, short in named.items()])


MANIFEST = "manifest.json"


def content_key(df: DataFrame, request: object = None) -> str:
    """What a snapshot is of: the request and the files that ``df`` reads, with their sizes."""
    spark = df.sparkSession
    place, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    sources = []
    for name in sorted(df.inputFiles()):
        path = place(name)
        sources.append([name, path.getFileSystem(conf).getFileStatus(path).getLen()])
    return hashlib.sha256(json.dumps([request, sources], sort_keys=True, default=str).encode()).hexdigest()


def snapshot(df: DataFrame, path: str, request: object = None) -> DataFrame:
    """Collected once, then read again by every round: all of them see the same rows.

    A snapshot is a folder with a manifest (its content key and its columns)
    and the rows. It is written beside its place and claimed by a rename that
    fails if something lies there, so it is never seen half-written, and of two
    writers one wins and both read what it wrote. Whatever at ``path`` is no
    snapshot, or one of another request or of other source files, is refused and
    left as it is; nothing is ever deleted but the folder that a failed or
    beaten writer has itself made.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key, columns = content_key(df, request), [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
    if not files.exists(hadoop.Path(path)):
        beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        claimed = False
        try:
            df.write.parquet(f"{beside}/rows")
            out = files.create(hadoop.Path(beside, MANIFEST))
            out.write(bytearray(json.dumps({"key": key, "columns": columns}).encode()))
            out.close()
            claimed = _claim(spark, beside, path)
        finally:
            if not claimed:
                files.delete(hadoop.Path(beside), True)  # our own, by its name
    try:
        known = json.loads("\n".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/{MANIFEST}").collect()))
    except Exception:
        raise AlgorithmError("what lies at the snapshot's place is no snapshot") from None
    if known["key"] != key:
        raise AlgorithmError("the snapshot is of another request or of other sources")
    if [c for c in columns if c not in known["columns"]]:
        raise AlgorithmError("the snapshot lacks a requested variable")
    kept = spark.read.parquet(f"{path.rstrip('/')}/rows")
    if kept.isEmpty():
        raise AlgorithmError("the snapshot is empty")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def _claim(spark: SparkSession, beside: str, path: str) -> bool:
    """Rename without ever replacing; whether it was ours to do."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in path else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = rename.getField("NONE").get(None)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path), how)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or "NotEmpty" in error.java_exception.getClass().getName():
            return False
        raise
    return True


#: Seconds that jobs get to end after they are cancelled.
GRACE = 10.0


def collect_bounded(collect: Callable[[], DataFrame], timeout: float | None = None, spark: SparkSession | None = None) -> DataFrame:
    """``collect()`` within a time; whatever goes wrong is told by its kind alone.

    Its jobs carry a tag. When time is up they are cancelled by it, and what
    ``collect`` cleans up on failure is cleaned up before this returns.
    """
    spark = spark or SparkSession.getActiveSession()
    box: dict = {}
    tag = f"collect-{uuid.uuid4().hex}"

    def work() -> None:
        try:
            if spark is not None:
                spark.sparkContext.addJobTag(tag)
                spark.sparkContext.setInterruptOnCancel(True)  # or tasks that wait for Python would go on
            box["rows"] = collect()
        except Exception as error:  # told below, without its text
            box["error"] = type(error).__name__

    thread = (InheritableThread if spark is not None else threading.Thread)(target=work, daemon=True)
    thread.start()
    thread.join(timeout if timeout is not None else load_collect_timeout(spark))
    if thread.is_alive():
        end = time.monotonic() + GRACE
        while spark is not None and thread.is_alive() and time.monotonic() < end:
            spark.sparkContext.cancelJobsWithTag(tag)  # again and again: between two jobs there is none to cancel
            thread.join(0.2)
        raise AlgorithmError("collecting the triples took too long")
    if "error" in box:
        raise AlgorithmError(f"collecting the triples failed: {box['error']}")
    return box["rows"]
