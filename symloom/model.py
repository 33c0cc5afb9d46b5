"""Options, errors and the schemas that all operators share."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

INPUT, PREPROFILE = "input", "preprofile"

SEQUENCES = "family_id long, ord int, name string, track_id string, alphabet_id string, symbols array<int>"
COUNTS = "family_id long, ord int, track_id string, pos int, sym int, cnt long"
PAIRS = "family_id long, a int, b int, score float, path array<array<int>>"
ALIGNMENTS = "family_id long, items array<int>, path array<array<int>>"
TREE = "family_id long, step int, left int, right int"
SCORES = "sym_a string, sym_b string, score float"


class AnalyticsError(Exception):
    """Base of all errors of this package."""


class AlphabetError(AnalyticsError):
    """A symbol or index that an alphabet does not have."""


class DataError(AnalyticsError):
    """Input that breaks an invariant of the data model."""


class OptionError(AnalyticsError):
    """An option that is unknown or has a value that is not allowed."""


class KernelError(AnalyticsError):
    """Inputs that an alignment kernel cannot take."""


PAIR_MODES = ("global", "local", "semiglobal_both", "semiglobal_one", "semiglobal_two")
MERGE_MODES = ("global", "semiglobal", "semiglobal_auto")
LINKAGES = ("single", "complete", "average")


@dataclass(frozen=True)
class Options:
    """Settings of one alignment run. ``merge`` lays options over others: those set there win."""

    gap_series: tuple[float, ...] = (-11.0, -1.0)
    score_threshold: float | None = None
    iterations: int = 2
    linkage: str = "average"
    merge_mode: str = "semiglobal"
    dist_mode: str = "global"
    preprofile_mode: str = "global"
    msa_mode: str = "adhoc"
    strict_local: bool = False
    spill_over: bool = True
    aligner: str = "affine"

    def __post_init__(self) -> None:
        if len(self.gap_series) not in (1, 2):
            raise OptionError("a gap series has one (linear) or two (affine) penalties")
        for name, allowed in (
            ("linkage", LINKAGES),
            ("merge_mode", MERGE_MODES),
            ("dist_mode", MERGE_MODES),
            ("preprofile_mode", ("global", "local", "dummy")),
            ("msa_mode", ("tree", "adhoc")),
        ):
            if getattr(self, name) not in allowed:
                raise OptionError(f"{name} is one of {', '.join(allowed)}")
        if self.iterations < 1:
            raise OptionError("iterations is at least 1")

    @property
    def gaps(self) -> tuple[float, float]:
        """(open, extend); a single penalty is linear."""
        return (self.gap_series[0], self.gap_series[-1])

    def merge(self, **changes) -> Options:
        known = {f.name for f in dataclasses.fields(self)}
        if unknown := set(changes) - known:
            raise OptionError(f"unknown options: {', '.join(sorted(unknown))}")
        return dataclasses.replace(self, **changes)


def resolve(*layers: dict) -> Options:
    """Options from nested layers, the later ones first in precedence."""
    out: dict = {}
    for layer in layers:
        out |= layer
    return Options().merge(**out)


def check_columns(df, *names: str) -> None:
    """Raise if a DataFrame lacks columns that an operator reads."""
    if missing := [n for n in names if n not in df.columns]:
        raise DataError(f"missing columns: {', '.join(missing)}")
