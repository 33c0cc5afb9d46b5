"""Align the sequences of a FASTA file: python -m symloom IN OUT [options]."""

from __future__ import annotations

import argparse

import numpy as np

from symloom.functions import matrices
from symloom.functions.alphabets import AMINO, DNA
from symloom.model import Options
from symloom.operators import progressive
from symloom.sources import text


def _records(path: str) -> list[tuple[str, str]]:
    out = []
    with open(path, encoding="utf-8") as f:
        for record in ("\n" + f.read()).split("\n>")[1:]:
            name, _, body = record.partition("\n")
            residues = "".join(line.strip() for line in body.split("\n"))
            if name.rstrip() and residues:
                out.append((name.rstrip(), residues))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symloom", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-g", "--gap-penalties", default="11,1", help="open and extend, positive")
    p.add_argument("-m", "--score-matrix", help="a file or a built-in matrix")
    p.add_argument("-s", "--preprofile-score", type=float)
    p.add_argument("-f", "--format", choices=("fasta", "clustal"), default="fasta")
    p.add_argument("--dna", action="store_true")
    p.add_argument("--linkage", choices=("single", "complete", "average"), default="average")
    p.add_argument("--preprofile", choices=("none", "local", "global"), default="none")
    p.add_argument("--preprofile-alignments", type=int, default=2)
    p.add_argument("--msa", choices=("tree", "adhoc"), default="adhoc")
    p.add_argument("--merge", choices=("global", "semiglobal", "semiglobal_auto"), default="global")
    p.add_argument("--dist", choices=("global", "semiglobal", "semiglobal_auto"), default="global")
    p.add_argument("-a", "--annotation", action="append", default=[], metavar="FASTA:MATRIX")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    alphabet = DNA if a.dna else AMINO
    used = [matrices.load(a.score_matrix or ("nucleotide" if a.dna else "blosum62"), alphabet)]
    records = _records(a.input)
    tracks = [records]
    for pair in a.annotation:
        path, matrix = pair.rsplit(":", 1)
        used.append(matrices.load(matrix))
        tracks.append(_records(path))
    opt = Options(
        gap_series=tuple(-float(x) for x in a.gap_penalties.split(",")),
        score_threshold=a.preprofile_score,
        iterations=a.preprofile_alignments,
        linkage=a.linkage,
        merge_mode=a.merge,
        dist_mode=a.dist,
        preprofile_mode="dummy" if a.preprofile == "none" else a.preprofile,
        msa_mode=a.msa,
    )
    sizes = [m.dense.shape[0] for m in used]
    members = [
        progressive.member([np.array(m.alphabets[0].encode(t[k][1])) for t, m in zip(tracks, used, strict=True)], sizes) for k in range(len(records))
    ]
    path, items = progressive.align_family(members, [m.dense for m in used], opt)
    names = [records[k][0] for k in items]
    rows = [progressive.gapped(path, j, records[k][1]) for j, k in enumerate(items)]
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(text.aligned_fasta(names, rows) if a.format == "fasta" else text.clustal(names, rows, used[0]))


if __name__ == "__main__":
    main()
