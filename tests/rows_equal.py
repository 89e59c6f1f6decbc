"""Comparing results."""


def same_rows(got, want) -> None:
    """Rows of a Spark frame and of a DuckDB result, in any order; floats to nine digits."""
    import pandas as pd

    def plain(v):
        if isinstance(v, float) and v != v or v is None or v is pd.NaT or v is pd.NA:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(tuple(map(plain, r)) for r in f[columns].itertuples(index=False, name=None)) for f in (got, want)]
    assert rows[0] == rows[1]
