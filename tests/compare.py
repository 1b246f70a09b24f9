"""Equality of two pandas frames as multisets of rows."""

from __future__ import annotations

import math

import pandas as pd


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
