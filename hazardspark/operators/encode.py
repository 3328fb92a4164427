"""Coercion, recoding, selection and encoding of station columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from ..functions.keys import Key, covariate_key, literal_key, term_key, to_number
from ..request import Categorical, Covariates, Scored, code_map


def q(name: str) -> Column:
    """A column by its literal name; names may hold : . [ and ]."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def coerce_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns as doubles; what is no number becomes null. Absent columns are left to validation."""
    return df.withColumns({n: to_number(q(n), dtype(df, n)) for n in names if n in df.columns})


def _among(key: Column, codes) -> Column:
    listed = sorted({k for k in map(literal_key, codes) if k is not None})
    return key.isin(listed) if listed else F.lit(False)


def recode_outcome(df: DataFrame, name: str, codes: dict) -> DataFrame:
    """1 for event codes, 0 for censored ones, null for missing and unlisted ones."""
    key = term_key(q(name), dtype(df, name))
    return df.withColumn(name, F.when(_among(key, codes["event"]), 1.0).when(_among(key, codes["censored"]), 0.0))


def selected(df: DataFrame, selection: dict | None) -> tuple[DataFrame, Column]:
    """``df`` with the columns of ranges as numbers, and the condition that every entry of the selection admits a row."""
    admits = F.lit(True)
    for name, spec in (selection or {}).items():
        if name not in df.columns:
            raise UserInputError(f"selection variable '{name}' is not a column")
        if isinstance(spec, dict):
            df = df.withColumn(name, to_number(q(name), dtype(df, name)))
            if "start" in spec:
                admits &= q(name) >= float(spec["start"])
            if "end" in spec:
                admits &= q(name) <= float(spec["end"])
        else:
            admits &= _among(term_key(q(name), dtype(df, name)), spec)
    return df, F.coalesce(admits, F.lit(False))


def select_rows(df: DataFrame, selection: dict | None) -> DataFrame:
    """Rows that every entry of a selection admits: values compared by key, ranges closed at both ends."""
    df, admits = selected(df, selection)
    return df.filter(admits)


def _lookup(codes: dict, key: Column) -> Column:
    """The value of a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), key) if codes else F.lit(None)


def encode(df: DataFrame, covariates: Covariates, key: Key | None = None) -> DataFrame:
    """Model terms: 0/1 columns for categories, scores in place; null for missing or unlisted codes.

    key: how codes are compared, a function of (column, Spark type) to a string column.
    """
    key = key or covariate_key
    new: dict[str, Column] = {}
    keys: dict[str, Column] = {}
    for i, entry in enumerate(covariates.entries):
        if isinstance(entry, str):
            continue
        if entry.name not in df.columns:
            raise UserInputError(f"explanatory variable '{entry.name}' is not a column")
        codes = {k: v for k, v in ((literal_key(k), v) for k, v in code_map(entry).items()) if v is not None}
        # a column of its own, so that many conditions on it compute it once
        keys[f"__key{i}"] = key(q(entry.name), dtype(df, entry.name))
        own = F.col(f"__key{i}")
        if isinstance(entry, Scored):
            new[entry.name] = _lookup(codes, own).cast("double")
        else:
            label = _lookup(codes, own)
            for term, name in zip(entry.terms, entry.labels):
                if term in df.columns:
                    raise UserInputError(f"term '{term}' is the name of a column")
                new[term] = (label == name).cast("double")
    return df.withColumns(keys).withColumns(new).drop(*keys) if new else df


def complete(df: DataFrame, names: list[str]) -> Column:
    """That none of the given columns is null or NaN; unknown names are ignored."""
    whole = F.lit(True)
    for n in names:
        if n in df.columns:
            whole &= q(n).isNotNull() & ~F.isnan(q(n)) if dtype(df, n) in ("double", "float") else q(n).isNotNull()
    return whole


def drop_incomplete(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without null or NaN in the given columns; unknown names are ignored."""
    return df.filter(complete(df, names))


def group_masks(covariates: Covariates) -> list[tuple[str, Column]]:
    """The categories of every categorical variable, the reference included, as conditions on its terms."""
    out = []
    for entry in covariates.categorical:
        for term in entry.terms:
            out.append((term, q(term) == 1))
        rest = F.lit(True)
        for term in entry.terms:
            rest &= q(term) == 0
        out.append((f"{entry.name}[{entry.reference}]", rest))
    return out


__all__ = ["Categorical", "coerce_numbers", "complete", "drop_incomplete", "encode", "group_masks", "q", "recode_outcome", "select_rows", "selected"]
