"""A fit request and its checks; nothing here touches data."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from .errors import UserInputError
from .functions.keys import MISSING_TERM, covariate_key_of, term_key_of

# What labels and names of selection variables may look like.
LABEL = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*")
SELECTION = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9_-]*:[A-Za-z0-9_.-]+")


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _name(x: object, what: str) -> str:
    if not isinstance(x, str) or not x.strip():
        raise UserInputError(f"{what} must be a non-empty name")
    return x.strip()


@dataclass(frozen=True)
class Categorical:
    """One 0/1 term for each label but the reference; codes are listed per label."""

    name: str
    categories: dict
    reference: str
    missing: tuple = ()

    @property
    def labels(self) -> list[str]:
        """All labels but the reference, in the order given."""
        return [x for x in self.categories if x != self.reference]

    @property
    def terms(self) -> list[str]:
        return [f"{self.name}[{x}]" for x in self.labels]


@dataclass(frozen=True)
class Scored:
    """One term: the score of the code."""

    name: str
    scores: dict
    missing: tuple = ()


@dataclass(frozen=True)
class Covariates:
    """Entries in the order given; terms are the columns of the model."""

    entries: tuple

    @property
    def columns(self) -> list[str]:
        return [e if isinstance(e, str) else e.name for e in self.entries]

    @property
    def terms(self) -> list[str]:
        return [t for e in self.entries for t in (e.terms if isinstance(e, Categorical) else [e if isinstance(e, str) else e.name])]

    @property
    def plain(self) -> list[str]:
        return [e for e in self.entries if isinstance(e, str)]

    @property
    def categorical(self) -> list[Categorical]:
        return [e for e in self.entries if isinstance(e, Categorical)]

    @property
    def scored(self) -> list[Scored]:
        return [e for e in self.entries if isinstance(e, Scored)]


def _code(code: object, name: str) -> None:
    if isinstance(code, bool) or not (code is None or isinstance(code, (str, int, float))):
        raise UserInputError(f"covariate '{name}': codes are strings or numbers")


def code_map(entry: Categorical | Scored, key=covariate_key_of) -> dict:
    """Key of each listed code to its label or score; None for codes listed as missing."""
    out: dict = {}

    def put(code, value, where):
        k = key(code)
        if k is None:
            return
        if k in out and out[k] != value:
            raise UserInputError(f"covariate '{entry.name}': a code of {where} is listed twice")
        out[k] = value

    if isinstance(entry, Categorical):
        for label, codes in entry.categories.items():
            for c in codes:
                put(c, label, f"'{label}'")
    else:
        for c, score in entry.scores.items():
            put(c, float(score), "scores")
    for c in entry.missing:
        put(c, None, "'missing'")
    return out


def parse_covariate(name: str, spec: object) -> Categorical | Scored:
    if not isinstance(spec, dict):
        raise UserInputError(f"covariate '{name}' must be given by a mapping")
    unknown = set(spec) - {"categories", "reference", "scores", "missing"}
    if unknown:
        raise UserInputError(f"covariate '{name}' has unknown keys")
    if ("categories" in spec) == ("scores" in spec):
        raise UserInputError(f"covariate '{name}' needs either categories or scores")
    missing = spec.get("missing", [])
    if not isinstance(missing, (list, tuple)):
        raise UserInputError(f"covariate '{name}': missing must be a list of codes")
    for c in missing:
        _code(c, name)
    if "categories" in spec:
        given = spec["categories"]
        if not isinstance(given, dict) or len(given) < 2:
            raise UserInputError(f"covariate '{name}' needs two categories at least")
        for label, codes in given.items():
            if not isinstance(label, str) or not LABEL.fullmatch(label):
                raise UserInputError(f"covariate '{name}': labels are letters, digits and _ . -")
            if not isinstance(codes, (list, tuple)) or not codes:
                raise UserInputError(f"covariate '{name}': category '{label}' needs a list of codes")
            for c in codes:
                _code(c, name)
        if spec.get("reference") not in given:
            raise UserInputError(f"covariate '{name}': reference must be one of its categories")
        entry: Categorical | Scored = Categorical(name, {k: tuple(v) for k, v in given.items()}, spec["reference"], tuple(missing))
    else:
        if "reference" in spec:
            raise UserInputError(f"covariate '{name}': a reference goes with categories")
        given = spec["scores"]
        if not isinstance(given, dict) or len(given) < 2:
            raise UserInputError(f"covariate '{name}' needs two scores at least")
        for c, score in given.items():
            _code(c, name)
            if not _is_number(score) or not math.isfinite(score):
                raise UserInputError(f"covariate '{name}': scores are finite numbers")
        entry = Scored(name, dict(given), tuple(missing))
    code_map(entry)
    return entry


def parse_covariates(given: object) -> Covariates:
    if not isinstance(given, (list, tuple)) or not given:
        raise UserInputError("explanatory variables must be a non-empty list")
    entries: list = []
    for item in given:
        if isinstance(item, dict):
            if len(item) != 1:
                raise UserInputError("an explanatory variable given by a mapping has one name")
            (name, spec), = item.items()
            entries.append(parse_covariate(_name(name, "an explanatory variable"), spec))
        else:
            entries.append(_name(item, "an explanatory variable"))
    found = Covariates(tuple(entries))
    if len(set(found.columns)) < len(found.columns):
        raise UserInputError("an explanatory variable is listed twice")
    if len(set(found.terms)) < len(found.terms):
        raise UserInputError("two explanatory variables make a term of the same name")
    return found


def parse_outcome(given: object) -> tuple[str, dict | None]:
    """The outcome column, and its event, censored and missing codes if given."""
    if isinstance(given, str):
        return _name(given, "the outcome column"), None
    if not isinstance(given, dict) or len(given) != 1:
        raise UserInputError("the outcome is a column name, or one name with its codes")
    (name, codes), = given.items()
    name = _name(name, "the outcome column")
    if not isinstance(codes, dict) or set(codes) - {"event", "censored", "missing"}:
        raise UserInputError(f"outcome '{name}': codes are listed under event, censored and missing")
    seen: dict = {}
    for where in ("event", "censored", "missing"):
        listed = codes.get(where, [])
        if not isinstance(listed, (list, tuple)) or where != "missing" and not listed:
            raise UserInputError(f"outcome '{name}': '{where}' needs a list of codes")
        for c in listed:
            if isinstance(c, bool) or not isinstance(c, (str, int, float)) or term_key_of(c) is None:
                raise UserInputError(f"outcome '{name}': codes are strings or finite numbers")
            if seen.setdefault(term_key_of(c), where) != where:
                raise UserInputError(f"outcome '{name}': a code is listed under '{seen[term_key_of(c)]}' and '{where}'")
    return name, {k: tuple(codes.get(k, ())) for k in ("event", "censored", "missing")}


def parse_selection(given: object) -> dict | None:
    """Which rows take part: for each variable a list of values or a range."""
    if given is None:
        return None
    if not isinstance(given, dict) or not given:
        raise UserInputError("a selection is a non-empty mapping of variables")
    for name, spec in given.items():
        if not isinstance(name, str) or not SELECTION.fullmatch(name):
            raise UserInputError("selection variables are identifiers or prefixed names")
        if isinstance(spec, (list, tuple)):
            if not spec:
                raise UserInputError(f"selection '{name}': the list of values is empty")
            if not all(isinstance(v, str) or _is_number(v) for v in spec):
                raise UserInputError(f"selection '{name}': values are strings or numbers")
        elif isinstance(spec, dict):
            if not spec or set(spec) - {"start", "end"}:
                raise UserInputError(f"selection '{name}': a range has start, end or both")
            if not all(_is_number(v) and math.isfinite(v) for v in spec.values()):
                raise UserInputError(f"selection '{name}': the bounds of a range are numbers")
            if len(spec) == 2 and spec["start"] > spec["end"]:
                raise UserInputError(f"selection '{name}': start is beyond end")
        else:
            raise UserInputError(f"selection '{name}' must be a list of values or a range")
    return {k: list(v) if isinstance(v, (list, tuple)) else dict(v) for k, v in given.items()}


@dataclass(frozen=True)
class FitRequest:
    """What to fit. ``FitRequest.of`` checks and normalises; messages never repeat data."""

    time: str
    outcome: str
    codes: dict | None
    covariates: Covariates
    sites: tuple | None = None
    profiles: tuple = ()
    selection: dict | None = None
    given: dict = field(default_factory=dict, compare=False)

    @property
    def columns(self) -> list[str]:
        """Every column that is read, once."""
        return list(dict.fromkeys([self.time, self.outcome, *self.covariates.columns, *(self.selection or {})]))

    @property
    def expanded_profiles(self) -> list[dict]:
        """Profiles as values of terms: a label is 1 for its own term and 0 for the others."""
        labelled = {e.name: e for e in self.covariates.categorical}
        out = []
        for profile in self.profiles:
            values: dict = {}
            for name, v in profile.items():
                if name in labelled:
                    values |= {t: float(label == v) for t, label in zip(labelled[name].terms, labelled[name].labels)}
                else:
                    values[name] = float(v)
            out.append(values)
        return out

    @classmethod
    def of(cls, time: str, outcome: object, covariates: object, sites: object = None, profiles: object = None, selection: object = None) -> FitRequest:
        given = {"time": time, "outcome": outcome, "covariates": covariates, "sites": sites, "profiles": profiles, "selection": selection}
        time = _name(time, "the time column")
        outcome, codes = parse_outcome(outcome)
        found = parse_covariates(covariates)
        if time == outcome:
            raise UserInputError("time and outcome are the same column")
        for what, names in (("an explanatory variable", found.columns), ("a model term", found.terms)):
            if {time, outcome} & set(names):
                raise UserInputError(f"{what} is the time or outcome column")
        clash = {t for e in found.categorical for t in e.terms} & set(found.columns)
        if clash:
            raise UserInputError("a model term has the name of an explanatory variable")
        if sites is not None:
            if not isinstance(sites, (list, tuple)) or not sites or not all(isinstance(s, int) and not isinstance(s, bool) and s >= 0 for s in sites):
                raise UserInputError("sites are a non-empty list of ids from 0")
            sites = tuple(dict.fromkeys(sites))
        kinds = {e if isinstance(e, str) else e.name: e for e in found.entries}
        for profile in profiles or []:
            if not isinstance(profile, dict):
                raise UserInputError("a profile is a mapping of explanatory variables")
            for name, v in profile.items():
                if name not in kinds:
                    raise UserInputError(f"profile variable '{name}' is not an explanatory variable")
                if isinstance(kinds[name], Categorical):
                    if v not in kinds[name].categories:
                        raise UserInputError(f"profile value of '{name}' is not one of its labels")
                elif not _is_number(v) or not math.isfinite(v):
                    raise UserInputError(f"profile value of '{name}' must be a finite number")
        return cls(time, outcome, codes, found, sites, tuple(dict(p) for p in profiles or []), parse_selection(selection), given)


def check_against_ontology(request: FitRequest, ontology: dict) -> None:
    """A request on coded data may only use what the ontology lists.

    ontology: key of a variable to (data type, keys of its codes), as
    ``sources.ontology`` reads it. Times and plain covariates are continuous,
    the outcome is categorical with codes, others are given by categories or
    scores; codes of categorical variables must be listed there.
    """

    def find(name: str, what: str):
        if term_key_of(name) not in ontology:
            raise UserInputError(f"{what} '{name}' is not a variable of the ontology")
        return ontology[term_key_of(name)]

    def known(code, codes, where: str) -> None:
        if term_key_of(code) not in codes | {MISSING_TERM, None}:
            raise UserInputError(f"{where} lists a code that the ontology does not")

    if find(request.time, "time column")[0] != "continuous":
        raise UserInputError(f"time column '{request.time}' must be continuous")
    kind, codes = find(request.outcome, "outcome column")
    if kind != "categorical":
        raise UserInputError(f"outcome column '{request.outcome}' must be categorical")
    if request.codes is None:
        raise UserInputError(f"outcome column '{request.outcome}' needs its codes")
    for where, listed in request.codes.items():
        for c in listed:
            known(c, codes, f"outcome '{request.outcome}' under '{where}'")
    for entry in request.covariates.entries:
        name = entry if isinstance(entry, str) else entry.name
        kind, codes = find(name, "explanatory variable")
        if isinstance(entry, str):
            if kind != "continuous":
                raise UserInputError(f"explanatory variable '{name}' is {kind}; give its categories or scores")
            continue
        if kind not in ("categorical", "standardised"):
            raise UserInputError(f"explanatory variable '{name}' is {kind}; give it as a plain name")
        if kind == "categorical":
            listed = [c for cs in entry.categories.values() for c in cs] if isinstance(entry, Categorical) else list(entry.scores)
            for c in [*listed, *entry.missing]:
                known(c, codes, f"explanatory variable '{name}'")
    for name, spec in (request.selection or {}).items():
        kind, codes = find(name, "selection variable")
        if isinstance(spec, dict):
            if kind != "continuous":
                raise UserInputError(f"selection variable '{name}' is {kind}; a range needs a continuous one")
        elif kind not in ("categorical", "standardised"):
            raise UserInputError(f"selection variable '{name}' is {kind}; a list of values needs a categorical one")
        elif kind == "categorical":
            for v in spec:
                known(v, codes, f"selection variable '{name}'")
