"""Pluggable pairwise aligners, and the functions offered to SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from symloom.model import OptionError

#: name -> function (match, gap_one, gap_two, mode, masked, free_local) -> (score, path); the
#: built-in kernel has no function here, so its score-only batches are used.
_ALIGNERS: dict[str, Callable | None] = {"affine": None}


def register_aligner(name: str, function: Callable) -> None:
    if name in _ALIGNERS:
        raise OptionError(f"aligner {name!r} is registered already")
    _ALIGNERS[name] = function


def unregister_aligner(name: str) -> None:
    if name == "affine":
        raise OptionError("the built-in aligner stays")
    _ALIGNERS.pop(name, None)


def resolve_aligner(name: str) -> Callable | None:
    try:
        return _ALIGNERS[name]
    except KeyError:
        raise OptionError(f"no aligner {name!r}") from None


def register_sql(spark: SparkSession, matrix=None, gaps: tuple[float, float] = (-11.0, -1.0)) -> None:
    """``align_score(a, b, mode)`` and the reader of sequence files as ``fasta``."""
    from symloom.functions.matrices import blosum62
    from symloom.operators.pairwise import _batched, direct_grid
    from symloom.sources.text import FastaSource

    matrix = matrix or blosum62()
    alphabet, dense = matrix.alphabets[0], matrix.dense

    @F.pandas_udf("float")
    def align_score(a: pd.Series, b: pd.Series, mode: pd.Series) -> pd.Series:
        grids = [direct_grid([alphabet.encode(x)], [alphabet.encode(y)], [dense]) for x, y in zip(a, b, strict=True)]
        out = pd.Series(0.0, index=a.index)
        for m in mode.unique():
            at = [k for k, x in enumerate(mode) if x == m]
            out.iloc[at] = _batched([grids[k] for k in at], gaps, m, False)
        return out

    spark.udf.register("align_score", align_score)
    spark.dataSource.register(FastaSource)
