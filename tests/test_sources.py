"""Tables, triples, ontologies."""

import functools
import http.server
import json
import re
import threading
import time
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.config import OPEN, SchemaChoice, load_schema_choice
from hazardspark.errors import AlgorithmError, UserInputError
from hazardspark.plans.fit import cox_fit
from hazardspark.plans.rdf import cox_fit_triples
from hazardspark.sources.endpoint import read_endpoint
from hazardspark.sources.ontology import configured_ontology, index_ontology, load_ontology
from hazardspark.sources.tables import read_stations, write_partitioned
from hazardspark.sources.triples import collect_bounded, flatten_patients, read_ntriples, snapshot

NCIT = "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#"


def test_station_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,time,event,age,sex\n1,10.9,0,68,F\n2,,1,50,M\n")
    (tmp_path / "b.csv").write_text("id,time,event,age,sex\n1,3.5,1,40,M\n")
    df = read_stations(spark, {1: str(tmp_path / "a.csv"), 2: str(tmp_path / "b.csv")}, "id int, time double, event int, age int, sex string")
    assert sorted((r.site, r.time) for r in df.collect() if r.time) == [(1, 10.9), (2, 3.5)]
    write_partitioned(df, str(tmp_path / "p.parquet"))
    only = spark.read.parquet(str(tmp_path / "p.parquet")).filter(F.col("site") == 2)
    assert only.count() == 1 and "PartitionFilters: [isnotnull(site" in only._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        read_stations(spark, {1: str(tmp_path / "a.csv")})


def final_plan(df):
    """The plan as it ran."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    return qe.executedPlan().toString()


def test_triples(spark, tmp_path):
    lines = []
    for p, sex, age in (("p1", "C16576", "40"), ("p2", "C20197", 'fif"ty'), ("p3", None, "7")):
        for kind, var, value in (("s", "C28421", sex), ("a", "C156420", age)):
            if value is None:
                continue
            lines += [f"<http://d/{p}> <http://m/has_column> <http://d/{kind}{p}> .", f"<http://d/{kind}{p}> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NCIT}{var}> ."]
            lines += [f"<http://d/{kind}{p}> <http://m/has_cell> <http://d/c{kind}{p}> ."]
            text = "raw" if kind == "s" else value.replace('"', '\\"')
            lines += [f'<http://d/c{kind}{p}> <http://m/has_value> "{text}"^^<http://www.w3.org/2001/XMLSchema#string> .']
            if kind == "s":
                lines += [f"<http://d/c{kind}{p}> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NCIT}{value}> .", f"<{NCIT}{value}> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <{NCIT}{var}> ."]
    (tmp_path / "t.nt").write_text("\n".join(["# comment", *lines, ""]))
    wide = flatten_patients(read_ntriples(spark, str(tmp_path / "t.nt")), ["ncit:C28421", "ncit:C156420"])
    got = {r[0]: (r[1], r[2]) for r in wide.collect()}
    assert got == {"http://d/p1": (NCIT + "C16576", "40"), "http://d/p2": (NCIT + "C20197", 'fif"ty'), "http://d/p3": (None, "7")}
    ran = final_plan(wide).partition("== Initial Plan ==")[0]
    assert ran.count("FileScan text") == 1 and "ReusedExchange" in ran
    kept = snapshot(wide, str(tmp_path / "snap"))
    assert kept.count() == 3 and snapshot(wide, str(tmp_path / "snap")).count() == 3
    with pytest.raises(AlgorithmError):
        snapshot(wide.withColumn("more", F.lit(1)), str(tmp_path / "snap"))


def test_a_foreign_folder_is_refused_and_left(spark, tmp_path):
    """Also one that a failed write of another program has left."""
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "part-00000.parquet").write_text("of someone else")
    with pytest.raises(AlgorithmError, match="no snapshot"):
        snapshot(spark.range(4), str(tmp_path / "snap"))
    assert [f.name for f in tmp_path.iterdir()] == ["snap"] and (tmp_path / "snap" / "part-00000.parquet").read_text() == "of someone else"


def test_snapshots_are_of_one_request_and_its_sources(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.read.parquet(str(tmp_path / "in"))
    assert snapshot(read(), str(tmp_path / "snap"), ["x"]).count() == 5 and snapshot(read(), str(tmp_path / "snap"), ["x"]).count() == 5
    with pytest.raises(AlgorithmError, match="another request"):
        snapshot(read(), str(tmp_path / "snap"), ["y"])
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(AlgorithmError, match="other sources"):
        snapshot(read(), str(tmp_path / "snap"), ["x"])
    with pytest.raises(AlgorithmError, match="empty"):
        snapshot(spark.range(0), str(tmp_path / "none"))


def test_two_writers_leave_one_snapshot(spark, tmp_path):
    """Each sees no snapshot, writes rows of its own, and gets those of the one that was first."""
    gate, got = threading.Barrier(2), []
    late = F.udf(lambda x: x, "long")

    def write(n):
        df = spark.range(n).select(late("id").alias("id"))
        gate.wait()
        got.append(snapshot(df, str(tmp_path / "snap")).count())

    threads = [threading.Thread(target=write, args=(n,)) for n in (4, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == 1 and got[0] in (4, 7) and [f.name for f in tmp_path.iterdir()] == ["snap"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="no such"):
        snapshot(spark.range(4).selectExpr("raise_error('no such') AS x"), str(tmp_path / "snap"))
    assert not list(tmp_path.iterdir())


def test_a_fit_from_triples_equals_the_fit_from_the_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    table, triples = [], []
    code = {"time": "C1", "state": "C2", "dose": "C3", "grade": "C4"}
    for site in (1, 2):
        for i in range(120):
            dose, grade = float(rng.normal()), int(rng.integers(0, 2))
            time, event = float(np.round(rng.exponential(10 / np.exp(0.4 * dose + 0.3 * grade)), 3)), int(rng.random() < 0.7)
            table.append((site, time, event, dose, grade))
            cells = {"time": (repr(time), None), "state": ("raw", "D" if event else "A"), "dose": (f" {dose!r}", None), "grade": ("raw", "HI" if grade else "LO")}
            for name, (value, term) in cells.items():
                at, cell = f"http://d/{name}{i}", f"http://d/cell/{name}{i}"  # the same at both sites
                triples += [(site, f"http://d/{i}", "http://m/has_column", at), (site, at, "http://m/type", NCIT + code[name]), (site, at, "http://m/has_cell", cell), (site, cell, "http://m/has_value", value)]
                if term:
                    triples += [(site, cell, "http://m/type", NCIT + term), (site, NCIT + term, "http://m/subClassOf", NCIT + code[name])]
    plain = cox_fit(spark.createDataFrame(table, "site long, time double, event int, dose double, grade int"), "time", "event", ["dose", "grade"], settings=OPEN)
    terms = lambda *names: {"terms": {n: {"targetClass": f"ncit:{n}"} for n in names}}
    kinds = {"C1": "continuous", "C3": "continuous", "C2": "categorical", "C4": "categorical"}
    variables = {c: {"class": f"ncit:{c}", "dataType": k, "valueMapping": terms(*{"C2": "DA", "C4": ("HI", "LO")}.get(c, ()))} for c, k in kinds.items()}
    how = {"ontology": index_ontology({"schema": {"variables": variables}}), "settings": OPEN, "timeout": 300}
    asked = ("ncit:C1", {"ncit:C2": {"event": ["ncit:D"], "censored": ["ncit:A"]}}, ["ncit:C3", {"ncit:C4": {"categories": {"lo": ["ncit:LO"], "hi": ["ncit:HI"]}, "reference": "lo"}}])
    df = spark.createDataFrame(triples, "site long, s string, p string, o string")
    got = cox_fit_triples(df, *asked, str(tmp_path / "snap"), **how)
    for a, b in (("dose", "ncit:C3"), ("grade", "ncit:C4[hi]")):
        assert got["model"][b]["Coef"] == pytest.approx(plain["model"][a]["Coef"], abs=1e-6) and got["model"][b]["SE"] == pytest.approx(plain["model"][a]["SE"], abs=1e-6)
    # the second fit reads the snapshot, and a request that the ontology forbids reads nothing
    again = cox_fit_triples(df.limit(0), *asked, str(tmp_path / "snap"), **how)
    assert again["model"] == got["model"]
    with pytest.raises(UserInputError):
        cox_fit_triples(df.selectExpr("site", "raise_error('read') AS s", "p", "o"), "ncit:C2", *asked[1:], str(tmp_path / "other"), **how)


def test_bounded_collection(spark, tmp_path):
    assert collect_bounded(lambda: spark.range(3), 5).count() == 3
    with pytest.raises(AlgorithmError, match="too long"):
        collect_bounded(lambda: time.sleep(2), 0.05)
    with pytest.raises(AlgorithmError, match="ValueError") as told:
        collect_bounded(lambda: int("secret"), 5)
    assert "secret" not in str(told.value)


def test_what_is_late_is_stopped(spark, tmp_path):
    """No job goes on and no folder is left."""
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    began = time.monotonic()
    with pytest.raises(AlgorithmError, match="too long"):
        collect_bounded(lambda: snapshot(spark.range(8).select(slow("id").alias("id")), str(tmp_path / "snap")), 3, spark)
    assert time.monotonic() - began < 25
    assert not list(tmp_path.iterdir())
    end = time.monotonic() + 20  # the tracker hears of it a little later
    while list(spark.sparkContext.statusTracker().getActiveJobsIds()) and time.monotonic() < end:
        time.sleep(0.2)
    assert not list(spark.sparkContext.statusTracker().getActiveJobsIds())


class Endpoint(http.server.BaseHTTPRequestHandler):
    """Answers a count and pages over ``triples``; each page fails at first."""

    triples: list = []
    seen: list = []

    def do_POST(self):
        query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        first = query not in Endpoint.seen
        Endpoint.seen.append(query)
        page = re.search(r"LIMIT (\d+) OFFSET (\d+)$", query)
        if "nothing" in query:
            self.send_error(400)
        elif first and page:
            self.send_error(503)
        else:
            rows = sorted(Endpoint.triples)[int(page[2]) :][: int(page[1])] if page else []
            kind = lambda v: "uri" if v.startswith("http") else "literal"
            found = [{c: {"type": kind(v), "value": v} for c, v in zip("spo", r)} for r in rows] if page else [{"n": {"type": "literal", "value": str(len(Endpoint.triples))}}]
            body = json.dumps({"results": {"bindings": found}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_an_endpoint_is_read_page_by_page(spark):
    Endpoint.triples = [(f"http://d/{i}", f"http://m/{p}", f"v{i * 7 % 100}") for i in range(95) for p in ("has_column", "has_cell")]
    Endpoint.seen = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/sparql"
    try:
        df = read_endpoint(spark, url, ["ncit:C28421", "http://x/age"], "http://m/", page=30)
        assert df.rdd.getNumPartitions() == 7
        assert sorted(map(tuple, df.collect())) == sorted(Endpoint.triples)
        pages = [q for q in Endpoint.seen if "LIMIT" in q]
        assert all(NCIT + "C28421" in q and "http://x/age" in q and "ORDER BY" in q for q in pages) and {pages.count(q) for q in pages} == {2}
        with pytest.raises(AlgorithmError) as told:
            collect_bounded(lambda: read_endpoint(spark, url, ["http://x/nothing"], "http://m/").count(), 60, spark)
        assert "127.0.0.1" not in str(told.value)
        with pytest.raises(UserInputError):
            read_endpoint(spark, url, ["http://x/a> } DELETE"], "http://m/")
    finally:
        server.shutdown()
    Endpoint.triples = []


def test_ontology_file(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"schema": {"variables": {"x": {"class": NCIT + "C3", "dataType": "categorical", "valueMapping": {"terms": {"m": {"targetClass": "ncit:M"}}}}}}}, indent=1))
    assert load_ontology(spark, str(path)) == {"ncit:C3": ("categorical", {"ncit:M", "ncit:C54031"})}
    path.write_text('{"schema": {}}')
    with pytest.raises(AlgorithmError):
        load_ontology(spark, str(path))


def test_the_configured_ontology(spark, tmp_path):
    schema = lambda c: json.dumps({"schema": {"variables": {"x": {"class": f"ncit:{c}", "dataType": "continuous"}}}})
    (tmp_path / "local.json").write_text(schema("C3"))
    (tmp_path / "v2.json").write_text(schema("C4"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/{{tag}}.json"
    local = str(tmp_path / "local.json")
    try:
        assert list(configured_ontology(spark, SchemaChoice(True, url, "v2", local))) == ["ncit:C4"]
        assert list(configured_ontology(spark, SchemaChoice(True, url, "v9", local))) == ["ncit:C3"] == list(configured_ontology(spark, SchemaChoice(False, url, "v2", local)))
        for choice in (SchemaChoice(True, url, "v9"), SchemaChoice(True, "file://" + local), SchemaChoice()):
            with pytest.raises(AlgorithmError) as told:
                configured_ontology(spark, choice)
            assert "127.0.0.1" not in str(told.value) and local not in str(told.value)
    finally:
        server.shutdown()
    spark.conf.set("spark.hazard.use_remote_schema", "True")
    spark.conf.set("spark.hazard.schema_tag", " v2 ")
    try:
        assert load_schema_choice(spark) == SchemaChoice(True, None, "v2", None)
        spark.conf.set("spark.hazard.use_remote_schema", "maybe")
        with pytest.raises(UserInputError):
            load_schema_choice(spark)
    finally:
        spark.conf.unset("spark.hazard.use_remote_schema")
        spark.conf.unset("spark.hazard.schema_tag")
