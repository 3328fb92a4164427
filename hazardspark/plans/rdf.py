"""A fit on stations that hold their patients as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import load_schema_choice
from ..request import FitRequest, check_against_ontology
from ..sources.ontology import configured_ontology
from ..sources.triples import collect_bounded, flatten_patients, snapshot
from .fit import cox_fit


def cox_fit_triples(
    triples: DataFrame,
    time: str,
    outcome: object,
    covariates: object,
    snapshot_path: str,
    ontology: dict | None = None,
    timeout: float | None = None,
    sites: object = None,
    profiles: object = None,
    selection: object = None,
    **how,
) -> dict:
    """``cox_fit`` over triples (site, s, p, o).

    The request is checked against the ontology (``sources.ontology``; by default
    the configured one, if any is) before any triple is read. Patients are then collected once, within a time, into a
    snapshot that every round reads; how goes to ``cox_fit``.
    """
    request = FitRequest.of(time, outcome, covariates, sites, profiles, selection)
    choice = load_schema_choice(triples.sparkSession)
    if ontology is None and (choice.remote or choice.path):
        ontology = configured_ontology(triples.sparkSession, choice)
    if ontology is not None:
        check_against_ontology(request, ontology)
    flat = flatten_patients(triples, request.columns, ("site",))
    rows = collect_bounded(lambda: snapshot(flat, snapshot_path, request.columns), timeout, triples.sparkSession)
    return cox_fit(rows, time, outcome, covariates, sites, profiles, selection, **how)
