from __future__ import annotations

from decimal import Decimal


def _value(x):
    if isinstance(x, float | Decimal):
        return f"{float(x):.9g}"
    return [_value(y) for y in x] if isinstance(x, list | tuple) else x


def table(rows, columns):
    """Rows as sorted strings, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([_value(r[i]) for i in order]) for r in rows)


def of_spark(df):
    return table([tuple(r) for r in df.collect()], df.columns)


def of_duck(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return table(result.fetchall(), columns)
