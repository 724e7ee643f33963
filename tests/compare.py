import numpy as np
import pandas as pd


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, numbers as rounded floats, in order."""
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "None"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return repr(round(float(v), 6) + 0.0)
        return str(v).replace("+00:00", "")

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
