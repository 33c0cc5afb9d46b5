"""Editing the tracks of sequences, a column map<string, array<int>>, without moving a row.

All tracks of a sequence are equally long. Edits that break this, add a track twice or name an absent one raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.model import DataError


def _checked(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def names(tracks: Column) -> Column:
    """The track ids in order."""
    return F.array_sort(F.map_keys(tracks))


def get(tracks: Column, name: str) -> Column:
    return _checked(~F.map_contains_key(tracks, name), f"no track {name}", F.element_at(tracks, F.lit(name)))


def add(tracks: Column, name: str, track: Column) -> Column:
    bad = F.map_contains_key(tracks, name) | F.exists(F.map_values(tracks), lambda t: F.size(t) != F.size(track))
    return _checked(bad, f"track {name} is there already, or its length is another", F.map_concat(tracks, F.create_map(F.lit(name), track)))


def delete(tracks: Column, name: str) -> Column:
    return _checked(~F.map_contains_key(tracks, name), f"no track {name}", F.map_filter(tracks, lambda k, _: k != name))


def replace(tracks: Column, name: str, track: Column) -> Column:
    return add(delete(tracks, name), name, track)


def rename_in_sets(sets: Column, old: str, new: str) -> Column:
    """Sets of track ids (array<array<string>>) that name another track, as an alignment on
    preprofiles reads those in place of its input."""
    if not old or not new:
        raise DataError("track ids are not empty")
    return F.transform(sets, lambda s: F.transform(s, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))
