"""Order-insensitive comparison of two small result frames (pandas)."""

from __future__ import annotations

import math

import pandas as pd


def _canon(v):
    if v is None or v is pd.NA:
        return None
    try:
        if v != v:  # NaN / NaT
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):                       # a column of integers with nulls comes as floats
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 9)
    if hasattr(v, "item"):
        return _canon(v.item())
    return v


def canonical(pdf) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    key = lambda r: tuple((x is None, isinstance(x, str), str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r)
    return cols, sorted(rows, key=key)


def diff(left, right) -> str | None:
    """None when equal; otherwise a short description of the difference."""
    lc, lr = canonical(left)
    rc, rr = canonical(right)
    if lc != rc:
        return f"columns differ: {lc} vs {rc}"
    if len(lr) != len(rr):
        return f"row counts differ: {len(lr)} vs {len(rr)}"
    if lr != rr:
        only_l = [r for r in lr if r not in set(rr)][:3]
        only_r = [r for r in rr if r not in set(lr)][:3]
        return f"values differ: left-only {only_l} right-only {only_r}"
    return None
