"""Order-free comparison of a Spark result with rows of DuckDB or of a brute-force version."""

import pandas as pd


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return "NULL"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, float):
        return "NULL" if x != x else repr(round(x, 6))
    return str(x)


def rows_of(pdf):
    names = sorted(pdf.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in pdf[names].astype(object).itertuples(index=False))


def same(a, b):
    na, ra = rows_of(a)
    nb, rb = rows_of(b)
    assert na == nb
    assert ra == rb
