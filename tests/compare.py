"""Order-insensitive comparison of two results by value."""

import math

import numpy as np


def value(x):
    if x is None or x is np.ma.masked:
        return None
    if isinstance(x, np.ndarray | list | tuple):
        return tuple(value(y) for y in x)
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, float | np.floating | int | np.integer):
        return None if math.isnan(float(x)) else round(float(x), 8) + 0.0
    return None if str(x) in ("NaT", "<NA>") else str(x)


def rows(frame):
    f = frame[sorted(frame.columns)]
    return sorted((tuple(value(x) for x in r) for r in f.itertuples(index=False, name=None)), key=repr)
