from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout


def rows(df, *order):
    """Rows as plain tuples, in the order of the given columns or of all."""
    found = [tuple(row) for row in df.select(*(order or df.columns)).collect()]
    return sorted(found, key=repr)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def jan(number: int) -> dt.date:
    return dt.date(2023, 1, number)


def plan(df) -> str:
    """The physical plan as text: after adaptive execution if the frame was run."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()
