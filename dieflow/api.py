"""Maps as NumPy arrays, without Spark: the calls a notebook makes on one map or a stack of them."""

from __future__ import annotations

import numpy as np

from dieflow.functions import kernels
from dieflow.operators.rules import Classifier
from dieflow.patterns import MAX_DIES, PATTERNS, SIGNALS
from dieflow.sources import wmap

__all__ = ["PATTERNS", "SIGNALS", "Classifier", "backend", "classify_batch", "clusters", "features", "features_batch", "hough_line", "read_wmap", "signals", "signals_batch"]


def backend() -> str:
    return "numpy"


def _stack(maps: np.ndarray, ndim: int) -> np.ndarray:
    if not isinstance(maps, np.ndarray) or maps.dtype != np.uint8:
        raise TypeError("maps are uint8 arrays")
    if maps.ndim != ndim or not maps.flags["C_CONTIGUOUS"]:
        raise TypeError(f"expected a C-contiguous array of {ndim} dimensions")
    if not 1 <= maps.shape[-1] * maps.shape[-2] <= MAX_DIES:
        raise TypeError(f"a map has 1 to {MAX_DIES} dies")
    return maps if ndim == 3 else maps[None]


def _one(found: dict[str, np.ndarray]) -> dict:
    return {k: v[0].tolist() for k, v in found.items()}


def features(map_: np.ndarray) -> dict:
    """dies, fails and both by zone, sector and ring."""
    return _one(kernels.features(_stack(map_, 2)))


def features_batch(maps: np.ndarray) -> dict[str, np.ndarray]:
    return kernels.features(_stack(maps, 3))


def clusters(map_: np.ndarray) -> list[dict]:
    """Clusters of failing dies in the order of their first dies, with their shapes."""
    c = kernels.clusters(_stack(map_, 2))
    both = {k: v for k, v in (c | kernels.shape(c)).items() if k != "map"}
    return [{k: v[i].item() for k, v in both.items()} for i in range(len(c["size"]))]


def hough_line(map_: np.ndarray) -> dict:
    return _one(kernels.hough(_stack(map_, 2)))


def signals(map_: np.ndarray) -> dict[str, float]:
    found = kernels.signals(_stack(map_, 2))
    return {s: float(found[s][0]) for s in SIGNALS}


def signals_batch(maps: np.ndarray) -> dict[str, np.ndarray]:
    found = kernels.signals(_stack(maps, 3))
    return {s: found[s] for s in SIGNALS}


def classify_batch(classifier: Classifier, maps: np.ndarray) -> list[tuple[str, int]]:
    found = signals_batch(maps)
    return [classifier.classify_row({s: float(found[s][i]) for s in SIGNALS}) for i in range(len(maps))]


def read_wmap(path: str) -> dict[str, list]:
    """Columns of a map file; bins are arrays of rows and cols."""
    with open(path, "rb") as f:
        rows = wmap.parse(f.read())
    out = {name: [r[i] for r in rows] for i, name in enumerate(wmap.COLUMNS)}
    out["bins"] = [np.frombuffer(b, dtype=np.uint8).reshape(r, c) for b, r, c in zip(out["bins"], out["rows"], out["cols"])]
    return out
