"""What a request may say."""

import math

import pytest

from hazardspark.config import LEVELS, Limits, Settings, load_limits, load_settings
from hazardspark.errors import UserInputError
from hazardspark.request import FitRequest, check_against_ontology, parse_covariates, parse_outcome, parse_selection
from hazardspark.sources.ontology import index_ontology

GRADE = {"grade": {"categories": {"low": ["G1", 1], "mid": ["G2"], "high": ["G3", "G4"]}, "reference": "low", "missing": ["GX"]}}
DOSE = {"dose": {"scores": {"none": 0, "half": 0.5, "full": 1}}}


def changed(spec: dict, **how) -> list:
    """A valid covariate with some keys of its specification replaced; None takes a key away."""
    (name, inner), = spec.items()
    return [{name: {k: v for k, v in {**inner, **how}.items() if v is not None}}]


def test_terms_and_profiles():
    r = FitRequest.of("days", "relapse", [DOSE, GRADE, "weight"], profiles=[{"weight": 80, "grade": "high"}, {"grade": "low", "dose": 0.5}])
    assert r.covariates.terms == ["dose", "grade[mid]", "grade[high]", "weight"] and r.covariates.columns == ["dose", "grade", "weight"]
    assert r.expanded_profiles == [{"weight": 80.0, "grade[mid]": 0.0, "grade[high]": 1.0}, {"grade[mid]": 0.0, "grade[high]": 0.0, "dose": 0.5}]
    assert r.columns == ["days", "relapse", "dose", "grade", "weight"]


def refused(check, *given):
    for x in given:
        with pytest.raises(UserInputError):
            check(x)


def test_lists_of_covariates():
    refused(parse_covariates, "weight", [], [" "], [7], ["weight", "dose", "weight"], [{"weight": None}], [{**GRADE, **DOSE}], ["grade[mid]", GRADE])


def test_categories():
    two = {"a": ["A"], "b": ["B"]}
    for how in (
        {"categories": {"a": ["A"]}, "reference": "a"}, {"categories": {"a": ["A"], "b": []}, "reference": "a"}, {"reference": None}, {"reference": "none of them"},
        {"categories": {**two, "c": ["A"]}, "reference": "a"}, {"categories": {"a": [7], "b": ["7.0"]}, "reference": "a"}, {"categories": {"a b": ["A"], "b": ["B"]}, "reference": "b"},
        {"categories": {"a": [False], "b": ["B"]}, "reference": "b"}, {"scores": {"A": 1, "B": 2}}, {"weights": 1}, {"categories": None},
    ):
        refused(parse_covariates, changed(GRADE, **how))


def test_scores():
    for how in (
        {"scores": {"none": 0}}, {"scores": {"none": 0, "full": "one"}}, {"scores": {"none": 0, "full": math.nan}}, {"scores": {"none": False, "full": 1}},
        {"reference": "none"}, {"missing": ["full"]},
    ):
        refused(parse_covariates, changed(DOSE, **how))


def test_outcomes():
    good = {"event": ["died"], "censored": ["left", "alive"]}
    assert parse_outcome({" state ": good})[0] == "state" and parse_outcome(" relapse ") == ("relapse", None)
    spoilt = [{**good, **how} for how in ({"event": []}, {"censored": ["died"]}, {"event": [2], "censored": ["2.0"]}, {"other": []}, {"event": [True]}, {"censored": [None]})]
    refused(parse_outcome, "", 0, {}, {"state": {}}, {"state": {"event": ["died"]}}, {"state": good, "other": good}, *({"state": x} for x in spoilt))


def test_selections():
    assert parse_selection(None) is None and parse_selection({"sct:77": {"end": 8}, "grade": ["G1", 2]}) == {"sct:77": {"end": 8}, "grade": ["G1", 2]}
    values = ([], [True], [None], 8, {}, {"start": "eight"}, {"start": 9, "end": 8}, {"until": 8}, {"end": math.nan})
    refused(parse_selection, {}, ["grade"], {"two words": ["G1"]}, *({"grade": v} for v in values))


def test_requests():
    ask = lambda how: FitRequest.of(**{"time": "days", "outcome": "relapse", "covariates": ["weight", GRADE]} | how)
    ask({"sites": [4, 0, 4]})
    same = [{"outcome": "days"}, {"covariates": ["days"]}, {"covariates": ["weight", "relapse"]}, {"time": "\t"}]
    sites = [{"sites": x} for x in ([], [2, -3], [False], ["2"], 2)]
    profiles = [{"profiles": [x]} for x in ({"height": 2}, {"weight": "heavy"}, {"weight": False}, "weight", {"grade": "G1"}, {"weight": math.inf})]
    refused(ask, *same, *sites, *profiles)


def test_settings(spark, monkeypatch):
    for level, (factor, m, figures, size) in LEVELS.items():
        s = Settings.at(f" {level.upper()} ", threshold=10)
        assert (s.row_factor, s.time_events, s.figures, s.risk_size) == (factor, m, figures, size)
    assert Settings().admission == 150 and Settings.at("minimal").admission == 5 and Settings.at("strict").admission == 300
    assert Settings(risk_size=None).admission == 50 and Settings().released_figures == 6 and Settings(figures=None).released_figures == 7
    for bad in ({"threshold": 2}, {"level": "x"}, {"bin_width": 0}, {"risk_change": 0}, {"figures": 0}, {"time_events": 0}):
        with pytest.raises(UserInputError):
            Settings(**bad)
    for bad in ({"held_share": 0}, {"held_share": 1.5}, {"grid": 0}, {"curve_figures": 0}):
        with pytest.raises(UserInputError):
            Limits(**bad)
    monkeypatch.setenv("HAZARD_LEVEL", "strict")
    monkeypatch.setenv("HAZARD_FIGURES", "")
    monkeypatch.setenv("HAZARD_HELD_SHARE", "")
    spark.conf.set("spark.hazard.bin_width", "2.5")
    try:
        s = load_settings(spark)
        assert (s.level, s.figures, s.bin_width, s.row_factor) == ("strict", None, 2.5, 20) and load_limits(spark).held_share is None
        monkeypatch.setenv("HAZARD_THRESHOLD", "ten")
        with pytest.raises(UserInputError):
            load_settings(spark)
    finally:
        spark.conf.unset("spark.hazard.bin_width")


ONTOLOGY = {"schema": {"variables": {
    "t": {"class": "ncit:C1", "dataType": "continuous"}, "age": {"class": "ncit:C2", "dataType": "continuous"},
    "sex": {"class": "ncit:C3", "dataType": "categorical", "valueMapping": {"terms": {"m": {"targetClass": "ncit:M"}, "f": {"targetClass": "ncit:F"}}}},
    "status": {"class": "ncit:C4", "dataType": "categorical", "valueMapping": {"terms": {"d": {"targetClass": "ncit:D"}, "a": {"targetClass": "ncit:A"}}}},
    "icd": {"class": "ncit:C5", "dataType": "standardised"}}}}


def test_ontology_rules():
    index = index_ontology(ONTOLOGY)
    outcome = {"ncit:C4": {"event": ["ncit:D"], "censored": ["ncit:A"], "missing": ["ncit:C54031"]}}
    sex = {"ncit:C3": {"categories": {"M": ["ncit:M"], "F": ["http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#F"]}, "reference": "M"}}
    icd = {"ncit:C5": {"scores": {"a": 1, "b": 2}}}
    good = FitRequest.of("ncit:C1", outcome, ["ncit:C2", sex, icd], selection={"ncit:C2": {"start": 18}, "ncit:C3": ["ncit:F"], "ncit:C5": ["x"]})
    check_against_ontology(good, index)
    for kwargs in (
        {"time": "ncit:C3"}, {"time": "ncit:C9"}, {"outcome": "ncit:C4"}, {"outcome": {"ncit:C2": {"event": [1], "censored": [0]}}},
        {"outcome": {"ncit:C4": {"event": ["ncit:X"], "censored": ["ncit:A"]}}}, {"covariates": ["ncit:C3"]}, {"covariates": ["ncit:C5"]},
        {"covariates": [{"ncit:C2": {"scores": {"a": 1, "b": 2}}}]}, {"covariates": [{"ncit:C3": {"scores": {"ncit:M": 1, "ncit:X": 2}}}]},
        {"selection": {"ncit:C2": ["ncit:M"]}}, {"selection": {"ncit:C3": {"start": 1}}}, {"selection": {"ncit:C3": ["ncit:X"]}},
    ):
        with pytest.raises(UserInputError):
            check_against_ontology(FitRequest.of(**{"time": "ncit:C1", "outcome": outcome, "covariates": ["ncit:C2"]} | kwargs), index)
