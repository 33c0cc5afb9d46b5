"""Progressive alignment of one family in numpy: stacking, guide trees, merging.

A family is a list of ``Member``; a member has, per track set, a matrix of counts (positions x
symbols). Alignments are paths: rows of residues consumed per member, -1 where a local path does not
reach."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from symloom.model import DataError, Options
from symloom.operators import dp

Profile = list[np.ndarray]


@dataclass
class Member:
    """Symbols per track set, and the counts that scoring uses."""

    symbols: list[np.ndarray]
    counts: Profile

    def __len__(self) -> int:
        return len(self.symbols[0])


def one_hot(symbols: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(symbols), size), dtype=np.int64)
    out[np.arange(len(symbols)), symbols] = 1
    return out


def member(symbols: list[np.ndarray], sizes: list[int]) -> Member:
    if len({len(s) for s in symbols}) != 1:
        raise DataError("all tracks of a sequence have one length")
    symbols = [np.asarray(s, dtype=np.int64) for s in symbols]
    return Member(symbols, [one_hot(s, n) for s, n in zip(symbols, sizes, strict=True)])


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows as shares of their sum, float32."""
    return (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def grid(one: Profile, two: Profile, matrices: list[np.ndarray]) -> np.ndarray:
    return dp.match_grid([shares(c) for c in one], [shares(c) for c in two], matrices)


def align(one: Profile, two: Profile, matrices: list[np.ndarray], mode: str, opt: Options, masked: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    g = grid(one, two, matrices)
    return dp.align(g, dp.gap_grid(g.shape[0], opt.gaps), dp.gap_grid(g.shape[1], opt.gaps), mode, masked, opt.strict_local)


def score(one: Profile, two: Profile, matrices: list[np.ndarray], mode: str, opt: Options) -> float:
    return dp.scores([grid(one, two, matrices)], opt.gaps, mode, opt.strict_local)[0]


def pair_mode(kind: str, n: int, m: int) -> str:
    return {"global": "global", "semiglobal": "semiglobal_both"}.get(kind) or dp.auto_mode(n, m)


def merge_paths(one: np.ndarray, two: np.ndarray, guide: np.ndarray) -> np.ndarray:
    """Rows of both paths that a guide path over their columns asks for, side by side."""
    def take(path: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = path[np.maximum(at, 0)].copy()
        out[at < 0] = -1
        return out

    return np.hstack([take(one, guide[:, 0]), take(two, guide[:, 1])])


def merge_counts(one: np.ndarray, two: np.ndarray, guide: np.ndarray) -> np.ndarray:
    """Counts of the merged columns: of each side where it advances."""
    step = np.diff(guide, axis=0) > 0
    out = np.zeros((len(step), one.shape[1]), dtype=np.int64)
    out[step[:, 0]] += one[guide[1:, 0][step[:, 0]] - 1]
    out[step[:, 1]] += two[guide[1:, 1][step[:, 1]] - 1]
    return out


def frequencies(path: np.ndarray, symbols: list[np.ndarray], size: int, spill_over: bool = True) -> np.ndarray:
    """Symbol counts per column of an alignment. A step from -1 into a local path counts as well,
    unless ``spill_over`` is off."""
    out = np.zeros((len(path) - 1, size), dtype=np.int64)
    for j, values in enumerate(symbols):
        here, nxt = path[:-1, j], path[1:, j]
        at = np.flatnonzero((nxt > here) & (spill_over | (here >= 0)))
        np.add.at(out, (at, values[nxt[at] - 1]), 1)
    return out


def stack(master: Member, others: list[Member], matrices: list[np.ndarray], opt: Options) -> tuple[np.ndarray, list[Member]]:
    """The path of a master with what is stacked on its columns, and the members in path order."""
    n = len(master)
    path, members = np.arange(n + 1)[:, None], [master]
    for other in others if opt.preprofile_mode != "dummy" else []:
        m, kept = len(other), []
        if opt.preprofile_mode == "global":
            s, p = align(master.counts, other.counts, matrices, "global", opt)
            if opt.score_threshold is None or s >= opt.score_threshold:
                kept.append(dp.compress(p, 0))
        else:
            masked = np.zeros((n + 1, m + 1), dtype=bool)
            for _ in range(opt.iterations):
                s, p = align(master.counts, other.counts, matrices, "local", opt, masked)
                masked[p[:, 0].min() : p[:, 0].max() + 1, p[:, 1].min() : p[:, 1].max() + 1] = True
                if opt.score_threshold is None or s >= opt.score_threshold:
                    kept.append(dp.spread_local(dp.compress(p, 0), n, 0))
        for p in kept:
            path = merge_paths(path, np.arange(m + 1)[:, None], p)
            members.append(other)
    return path, members


def preprofile(master: Member, others: list[Member], matrices: list[np.ndarray], opt: Options) -> Member:
    """The master with its first track set's counts taken from the stack."""
    path, members = stack(master, others, matrices, opt)
    counts = frequencies(path, [x.symbols[0] for x in members], master.counts[0].shape[1], opt.spill_over)
    return Member(master.symbols, [counts, *master.counts[1:]])


def distances(members: list[Member], matrices: list[np.ndarray], opt: Options) -> np.ndarray:
    """Highest score (0 counts as one) minus score."""
    n = len(members)
    d = np.zeros((n, n), dtype=np.float32)
    for i in range(n):
        for j in range(i + 1, n):
            mode = pair_mode(opt.dist_mode, len(members[i]), len(members[j]))
            d[i, j] = d[j, i] = score(members[i].counts, members[j].counts, matrices, mode, opt)
    return d.max(initial=0) - d


def merge_order(distance: np.ndarray, linkage: str) -> list[tuple[int, int]]:
    """(kept, absorbed) by repeatedly joining the first closest pair of clusters. Distances between
    clusters are updated at each merge; average linkage keeps sums and sizes."""
    n = len(distance)
    link = np.asarray(distance, dtype=np.float64).copy()
    size, live, out = np.ones(n), list(range(n)), []
    while len(live) > 1:
        at = np.array(live)
        mean = link[np.ix_(at, at)]
        if linkage == "average":
            mean = mean / np.outer(size[at], size[at])
        mean[np.tril_indices(len(at))] = np.inf
        i, j = (live[int(k)] for k in np.unravel_index(mean.argmin(), mean.shape))
        join = {"single": np.minimum, "complete": np.maximum, "average": np.add}[linkage](link[i], link[j])
        link[i], link[:, i] = join, join
        size[i] += size[j]
        live.remove(j)
        out.append((i, j))
    return out


@dataclass
class Cluster:
    path: np.ndarray
    items: list[int]
    counts: Profile

    def __len__(self) -> int:
        return len(self.counts[0])


def _start(members: list[Member]) -> dict[int, Cluster]:
    return {k: Cluster(np.arange(len(m) + 1)[:, None], [k], m.counts) for k, m in enumerate(members)}


def _join(one: Cluster, two: Cluster, matrices: list[np.ndarray], opt: Options) -> Cluster:
    _, guide = align(one.counts, two.counts, matrices, pair_mode(opt.merge_mode, len(one), len(two)), opt)
    counts = [merge_counts(a, b, guide) for a, b in zip(one.counts, two.counts, strict=True)]
    return Cluster(merge_paths(one.path, two.path, guide), one.items + two.items, counts)


def along_tree(members: list[Member], order: list[tuple[int, int]], matrices: list[np.ndarray], opt: Options) -> Cluster:
    live = _start(members)
    for i, j in order:
        live[i] = _join(live[i], live.pop(j), matrices, opt)
    return next(iter(live.values()))


def greedy(members: list[Member], matrices: list[np.ndarray], opt: Options, known: dict[tuple[int, int], float] | None = None) -> Cluster:
    """Joins the best scoring pair of clusters each round; only pairs of the last join are scored anew.
    ``known`` holds scores of pairs of members that were found before."""
    live, known = _start(members), dict(known or {})
    while len(live) > 1:
        ids = list(live)
        for a, i in enumerate(ids):
            for j in ids[a + 1 :]:
                if (i, j) not in known:
                    mode = pair_mode(opt.dist_mode, len(live[i]), len(live[j]))
                    known[i, j] = score(live[i].counts, live[j].counts, matrices, mode, opt)
        i, j = max(((i, j) for a, i in enumerate(ids) for j in ids[a + 1 :]), key=lambda p: (known[p], -p[0], -p[1]))
        live[i] = _join(live[i], live.pop(j), matrices, opt)
        known = {p: s for p, s in known.items() if not {i, j} & set(p)}
    return next(iter(live.values()))


def align_family(members: list[Member], matrices: list[np.ndarray], opt: Options) -> tuple[np.ndarray, list[int]]:
    """(path, order of its columns' members): stack, then join along a tree or greedily."""
    if not members:
        raise DataError("a family needs a sequence")
    ready = [preprofile(m, members[:k] + members[k + 1 :], matrices, opt) for k, m in enumerate(members)]
    if opt.msa_mode == "tree":
        done = along_tree(ready, merge_order(distances(ready, matrices, opt), opt.linkage), matrices, opt)
    else:
        done = greedy(ready, matrices, opt)
    return done.path, done.items


def gapped(path: np.ndarray, column: int, text: str, gap: str = "-") -> str:
    """One member's row of an alignment."""
    if (path[:, column] < 0).any():
        raise DataError("a path with unfilled positions has no gapped form")
    step = np.diff(path[:, column]) > 0
    return "".join(text[p - 1] if s else gap for s, p in zip(step, path[1:, column], strict=True))
