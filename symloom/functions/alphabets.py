"""Alphabets and the encoding of symbols, as native column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.model import AlphabetError


@dataclass(frozen=True)
class Alphabet:
    """Symbols and their indices. ``size`` is the highest index + 1: indices may have gaps."""

    alphabet_id: str
    symbols: tuple[str, ...]
    indices: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.indices:
            object.__setattr__(self, "indices", tuple(range(len(self.symbols))))
        if len(set(self.symbols)) != len(self.symbols) or len(self.indices) != len(self.symbols):
            raise AlphabetError("symbols and indices must be unique and of one length")

    @property
    def size(self) -> int:
        return max(self.indices, default=-1) + 1

    def index(self, symbol: str) -> int:
        try:
            return self.indices[self.symbols.index(symbol)]
        except ValueError:
            raise AlphabetError(f"symbol {symbol!r} is not in alphabet {self.alphabet_id}") from None

    def symbol(self, index: int) -> str:
        try:
            return self.symbols[self.indices.index(index)]
        except ValueError:
            raise AlphabetError(f"index {index} is not in alphabet {self.alphabet_id}") from None

    def encode(self, text: str) -> list[int]:
        table = dict(zip(self.symbols, self.indices, strict=True))
        try:
            return [table[c] for c in text]
        except KeyError as e:
            raise AlphabetError(f"symbol {e.args[0]!r} is not in alphabet {self.alphabet_id}") from None

    def decode(self, values) -> str:
        table = dict(zip(self.indices, self.symbols, strict=True))
        return "".join(table[int(v)] for v in values)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Alphabet) and other.alphabet_id == self.alphabet_id

    def __hash__(self) -> int:
        return hash(self.alphabet_id)


# Symbols of the built-in alphabets in index order.
AMINO = Alphabet("amino", tuple("ARNDCEQGHILKMFPSTWYVUOBZJX*"))
DNA = Alphabet("dna", tuple("ATGCSWRYKMBVHDN"))
RNA = Alphabet("rna", tuple("AUCG"))
BUILT_IN = {a.alphabet_id: a for a in (AMINO, DNA, RNA)}


def table(spark: SparkSession, *alphabets: Alphabet) -> DataFrame:
    rows = [(a.alphabet_id, s, i) for a in alphabets for s, i in zip(a.symbols, a.indices, strict=True)]
    return spark.createDataFrame(rows, "alphabet_id string, symbol string, idx int")


def _map(keys, values) -> Column:
    return F.create_map(*[F.lit(x) for pair in zip(keys, values, strict=True) for x in pair])


def encode(symbols: Column, alphabet: Alphabet) -> Column:
    """Array of symbols -> array of indices; an unknown symbol raises."""
    known = _map(alphabet.symbols, alphabet.indices)
    bad = F.raise_error(F.concat(F.lit(f"symbol not in alphabet {alphabet.alphabet_id}: "), F.lit("")))
    return F.transform(symbols, lambda s: F.coalesce(F.try_element_at(known, s), bad.cast("int")))


def decode(indices: Column, alphabet: Alphabet) -> Column:
    """Array of indices -> array of symbols; an unknown index raises."""
    known = _map(alphabet.indices, alphabet.symbols)
    bad = F.raise_error(F.lit(f"index not in alphabet {alphabet.alphabet_id}"))
    return F.transform(indices, lambda i: F.coalesce(F.try_element_at(known, i), bad.cast("string")))


def characters(text: Column) -> Column:
    """The characters of a text as an array; none for empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
