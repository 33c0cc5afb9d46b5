"""Readers and writers of sequence, alignment, matrix and annotation text formats.

Readers turn whole files into rows with native string functions; writers turn rows into text columns
that any text sink takes (one row is one file's content)."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symloom.functions.matrices import ScoreMatrix
from symloom.model import DataError

FASTA = "path string, ord int, name string, residues string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, name, residues): records without a name or residues are dropped, as is text before
    the first header; lines are trimmed and joined; nothing is folded."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return parse_fasta(files)


def parse_fasta(files: DataFrame) -> DataFrame:
    """As ``read_fasta``, from rows (path, value) of file contents."""
    text = F.concat(F.lit("\n"), F.regexp_replace("value", r"\r\n?", "\n"))
    records = files.select("path", F.posexplode(F.slice(F.split(text, "\n>"), F.lit(2), F.lit(2**31 - 1))).alias("pos", "record"))
    name = F.rtrim(F.substring_index("record", "\n", 1))
    body = F.when(F.instr("record", "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise(F.lit(""))
    joined = F.array_join(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), "")
    rows = records.select("path", "pos", name.alias("name"), joined.alias("residues")).filter("name <> '' AND residues <> ''")
    earlier = F.row_number().over(_by("path", "pos")) - 1
    return rows.select("path", earlier.cast("int").alias("ord"), "name", "residues")


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(columns[0]).orderBy(*columns[1:])


def paths_from_gapped(rows: DataFrame, keys: Sequence[str], text: str = "gapped", gap: str = "-") -> DataFrame:
    """(keys, col, consumed): residues consumed after each column, by a running count of non-gaps."""
    from pyspark.sql import Window

    chars = rows.select(*keys, F.posexplode(F.split(text, "")).alias("col", "symbol")).filter("symbol <> ''")
    run = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return chars.select(*keys, "col", "symbol", F.sum((F.col("symbol") != gap).cast("int")).over(run).alias("consumed"))


def read_alignment(rows: Iterable[tuple[str, str]], gap: str = "-") -> tuple[list[str], list[str], np.ndarray]:
    """(names, residues, path) of gapped records of one length."""
    rows = [(n, s) for n, s in rows if n and s]
    if not rows or len({len(s) for _, s in rows}) != 1:
        raise DataError("an alignment needs records of one length")
    held = np.array([[c != gap for c in s] for _, s in rows], dtype=np.int64)
    path = np.vstack([np.zeros((1, len(rows)), dtype=np.int64), np.cumsum(held, axis=1).T])
    return [n for n, _ in rows], [s.replace(gap, "") for _, s in rows], path


def wrap(text: str, width: int) -> list[str]:
    return [text[k : k + width] for k in range(0, len(text), width)]


def wrapped(column, width: int):
    """A text column cut into lines of ``width`` characters."""
    n = F.ceil(F.length(column) / width).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(column, k * width + 1, F.lit(width)))
    return F.when(n > 0, F.array_join(parts, "\n")).otherwise(F.lit(""))


def fasta_text(rows: DataFrame, keys: Sequence[str] = (), width: int = 78) -> DataFrame:
    """One text per key: records (ord, name, residues) in order, wrapped, no newline at the end."""
    record = F.struct("ord", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("residues"), width)).alias("text"))
    texts = F.transform(F.sort_array(F.collect_list(record)), lambda r: r["text"])
    return rows.groupBy(*keys).agg(F.array_join(texts, "\n").alias("value"))


def aligned_fasta(names: Sequence[str], rows: Sequence[str], width: int = 72) -> str:
    lines = []
    for name, row in zip(names, rows, strict=True):
        lines += [">" + name[: width - 1], *wrap(row, width)]
    return "".join(line + "\n" for line in lines)


def aligned_fasta_text(rows: DataFrame, keys: Sequence[str] = (), width: int = 72) -> DataFrame:
    """``aligned_fasta`` as one text per key: records (ord, name, gapped) in order."""
    header = F.concat(F.lit(">"), F.substring("name", 1, width - 1), F.lit("\n"))
    body = wrapped(F.col("gapped"), width)
    record = F.struct("ord", F.concat(header, F.when(body != "", F.concat(body, F.lit("\n"))).otherwise("")).alias("text"))
    texts = F.transform(F.sort_array(F.collect_list(record)), lambda r: r["text"])
    return rows.groupBy(*keys).agg(F.array_join(texts, "").alias("value"))


def conservation(rows: Sequence[str], matrix: ScoreMatrix | None, gap: str = "-") -> str:
    """'*' where all ordered pairs of a column score at least 0.9 of the best possible, ':' from 0.4,
    else blank; gaps score 0; blank without a matrix and for columns of gaps."""
    if matrix is None:
        return " " * len(rows[0])
    out = []
    for column in zip(*rows, strict=True):
        present = [c for c in column if c != gap]
        if not present:
            out.append(" ")
            continue
        total = float(np.float32(sum(matrix.score(a, b) for a in present for b in present)))
        most = max(matrix.score(a, a) for a in present) * len(rows) ** 2
        out.append("*" if total >= 0.9 * most else ":" if total >= 0.4 * most else " ")
    return "".join(out)


def clustal(names: Sequence[str], rows: Sequence[str], matrix: ScoreMatrix | None = None, banner: str = "CLUSTAL multiple sequence alignment") -> str:
    wide = min(13, max(map(len, names)))
    block = min(60, 78 - wide - 5)
    named = [*zip((n[:wide].ljust(wide) for n in names), rows, strict=True), (" " * wide, conservation(rows, matrix))]
    out = [banner, "", ""]
    for k in range(0, len(rows[0]), block):
        out += [f"{n}     {r[k : k + block]}" for n, r in named] + [""]
    return "\n".join(out) + "\n"


def pssm(consensus: Sequence[str], master: str, shares: np.ndarray, matrix: ScoreMatrix) -> str:
    """Tab-separated rows: position, consensus, position and master symbol, then per symbol the
    expected score, one decimal."""
    symbols = matrix.alphabets[0].symbols
    if matrix.alphabets[0] != matrix.alphabets[1] or shares.shape[1] != matrix.dense.shape[0]:
        raise DataError("a position-specific matrix needs one alphabet throughout")
    order = [matrix.alphabets[0].index(s) for s in symbols]
    expected = shares @ matrix.dense.T
    lines = ["\t".join(["P", "C", "Master", *symbols])]
    for k, (c, m, row) in enumerate(zip(consensus, master, expected, strict=True), 1):
        lines.append("\t".join([str(k), c, f"{k}-{m}", *(f"{row[i]:.1f}" for i in order)]))
    return "\n".join(lines)


def features(names: Sequence[str], tracks: Sequence[tuple[str, str, dict[str, str], Sequence[str]]]) -> str:
    """Annotation rows: per track (track id, description, colors by symbol, one text per name), color
    lines once per type, then a line for each coloured position."""
    colors: dict[str, str] = {}
    rows = []
    for track, description, shades, texts in tracks:
        for symbol, shade in shades.items():
            colors.setdefault(f"{track}_{symbol}", shade)
        for name, text in zip(names, texts, strict=True):
            first = name.split()[0]
            rows += [
                "\t".join([description, first, "-1", str(k), str(k), f"{track}_{c}"]) for k, c in enumerate(text, 1) if c in shades
            ]
    return "".join(line + "\n" for line in [*(f"{k}\t{v}" for k, v in colors.items()), *rows])


def feature_rows(symbols: DataFrame, colors: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, first, last, type): coloured positions, from 1, of long symbols (keys, track, pos,
    symbol); a type is its track and symbol joined by an underscore."""
    kind, place = F.concat_ws("_", "track", "symbol"), F.col("pos") + 1
    return symbols.filter(kind.isin(*colors)).select(*keys, place.alias("first"), place.alias("last"), kind.alias("type"))


def blast_hits(files: DataFrame) -> DataFrame:
    """(path, rank, hit_id, evalue) of search reports in XML (rows path, value): hits of the last
    iteration in file order, each with its first segment's e-value."""
    body = F.regexp_replace("value", r"(?s)<!DOCTYPE.*?>", "")
    numbers = F.transform(F.xpath(body, F.lit("//Iteration/Iteration_iter-num/text()")), lambda s: s.cast("int"))
    rows = files.select("path", body.alias("body"), F.array_max(numbers).alias("last"))
    parts = rows.select("path", "last", F.explode(F.slice(F.split("body", "<Iteration>"), F.lit(2), F.lit(2**31 - 1))).alias("part"))
    parts = parts.filter(F.regexp_extract("part", r"<Iteration_iter-num>(\d+)<", 1).cast("int") == F.col("last"))
    hits = parts.select("path", F.posexplode(F.slice(F.split("part", "<Hit>"), F.lit(2), F.lit(2**31 - 1))).alias("pos", "hit"))
    return hits.select(
        "path", (F.col("pos") + 1).alias("rank"), F.regexp_extract("hit", r"<Hit_id>([^<]*)<", 1).alias("hit_id"),
        F.regexp_extract("hit", r"<Hsp_evalue>([^<]*)<", 1).cast("double").alias("evalue"),
    )


def best_hits(hits: DataFrame, most: int = 10, evalue: float = 1.0) -> DataFrame:
    """Of the first ``most`` hits those up to an e-value: the limit comes first."""
    return hits.filter((F.col("rank") <= most) & (F.col("evalue") <= evalue))


class FastaSource(DataSource):
    """``spark.read.format("fasta")``: one partition per local file of ``path``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options["path"])


class _FastaReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = [os.path.join(self.path, f) for f in sorted(os.listdir(self.path))] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            k = 0
            for record in ("\n" + f.read()).split("\n>")[1:]:
                name, _, body = record.partition("\n")
                residues = "".join(line.strip() for line in body.split("\n"))
                if name.rstrip() and residues:
                    yield (partition.value, k, name.rstrip(), residues)
                    k += 1
