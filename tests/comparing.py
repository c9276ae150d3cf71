"""Rows of either engine in one comparable form."""

from __future__ import annotations

import math


def canon(v):  # noqa: ANN001, ANN201
    if v is None or isinstance(v, str | bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        x = float(v)
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: canon(x) for k, x in sorted(v.items())})
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([canon(x) for x in v])
    return str(v)


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def agree(spark, duck, sf_dir, query, sql) -> None:  # noqa: ANN001
    df = query(spark, sf_dir)
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, found.fetchall())
