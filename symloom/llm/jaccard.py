"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of word shingles are grouped in size bands such that a partner is in a set's own band or the
next; each band's instance splits the hash universe into one segment more than the shingles that
two linked sets can differ in, so two linked sets agree on some whole segment. A set indexes the
signatures of its segments, and for a few reserve segments those of one-deletion subsets too. The
allocation weighs costs: a segment that is empty or holds only frequent shingles would meet many
unrelated sets, so the costliest are left out, first within the slack that a set smaller than its
band's largest has, then by probing as many reserve segments to one difference (worth two exact
ones). Frequencies come from all rows, by bounded reports of every task; they only set costs.

Signatures travel in packed blocks, one per map task and target partition. There, sets of a shared
signature become candidate pairs: all of a small bucket; of a larger bucket each member with a few
pivots, and after their links are verified and merged, only members of different components are
still paired. Pairs are verified exactly on the texts' sets. Copies of a set count as one.

Defined results: null, empty and word-less texts have no shingles and are linked with nothing;
repeated rows are copies; an empty table gives an empty table; other columns are not read by
``classes`` and carried whole, inside one struct, by ``representatives``, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.common import materialize, partitions, table, utf8
from symloom.llm.blocks import changes
from symloom.llm.components import components
from symloom.llm.shingles import mix, set_id, shingle_sets, slices
from symloom.llm.sketches import least_difference, same_width, sketch

#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Buckets of at most so many sets pair all of them; in larger ones every set meets so many pivots.
#: A bucket of more than WIDE sets is compared in blocks, each with each, in tasks of their own.
SMALL, PIVOTS, WIDE = 6, 2, 4_096
#: Reserve segments of an instance, besides one in 48.
RESERVE = 3
#: The table of frequent shingles: its most entries, and the share of a task's rows (and the least
#: number of them) from which a shingle is reported. It only sets costs, never results.
FREQUENT, SHARE, REPORTED = 100_000, 0.0005, 4
#: Signatures that a map task holds before it sends its blocks on.
HELD = 4_000_000


class Bands:
    """Size bands and their instances for one threshold."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent, self.tops = percent, [1]

    def of(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))
        return int(np.searchsorted(self.tops, n))

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.of(self.tops[-1] + 1)
        return self.tops[band]

    def differ(self, a: int, b: int) -> int:
        """Most shingles by which linked sets of at most these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)


@dataclass(frozen=True)
class Frequent:
    """Shingles that many sets hold, in order, and in how many; others count as rare."""

    items: np.ndarray
    counts: np.ndarray

    def of(self, items: np.ndarray) -> np.ndarray:
        if not len(self.items):
            return np.zeros(len(items))
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        return np.where(self.items[at] == items, self.counts[at], 0.0)


NONE = Frequent(np.zeros(0, np.uint64), np.zeros(0))


def signatures(items: np.ndarray, bands: Bands, frequent: Frequent = NONE) -> np.ndarray:
    """All signatures of one sorted set, over the instances of its own and the next band.

    A segment costs what its rarest shingle's frequency says, an empty one more than any. Of its
    segments a set may leave out as many as its slack and its usable reserve segments make up for,
    and leaves out the costliest: all above a price that is its own. Of two linked sets, the one
    with the lower price probes only segments that the other indexes as well, equal segments having
    equal costs, so no link is lost whatever the frequencies are."""
    own, out = bands.of(len(items)), []
    often = frequent.of(items)
    for band in (own, own + 1):
        top = bands.top(band)
        count = bands.differ(top, top) + 1
        segment = ((items >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)  # ascending, as items are
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        value = mix(items + np.uint64(band))
        whole = np.add.reduceat(value, first)
        name = mix(segment[first] * np.uint64(0x100000001B3) + np.uint64(band))
        cost = np.minimum.reduceat(often, first)
        size = np.diff(np.append(first, len(items)))
        rare = np.add.reduceat((often == 0).astype(np.int64), first)
        # reserve segments: every subset with one shingle less that still holds a rare one
        held = segment[first] < (RESERVE + count // 48 if count >= 8 else 0)
        for k in np.flatnonzero(held & (size >= 3) & (rare >= 1)):
            part = slice(first[k], first[k] + size[k])
            left = rare[k] - (often[part] == 0) >= 1
            out.append((whole[k] - value[part][left]) ^ name[k])
        usable = int((held & (size >= 3) & (rare >= 2)).sum())
        budget = count - 1 - bands.differ(len(items), top) + usable
        empty = count - len(first)
        price = np.inf
        if empty <= budget:
            left = budget - empty
            price = np.partition(cost, len(cost) - 1 - left)[len(cost) - 1 - left] if left < len(cost) else 0.0
        out.append((whole ^ name)[cost <= price])
        if empty > budget:
            absent = np.setdiff1d(np.arange(count, dtype=np.uint64), segment[first])
            out.append(mix(absent * np.uint64(0x100000001B3) + np.uint64(band)))
    return mix(np.concatenate(out))


KEPT = 6  # bytes of a signature that are sent; a chance match is only one more pair to verify


def _send(held: list[tuple[np.ndarray, int]], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks by target partition: signatures, the set of each, and the sets' names."""
    if not held:
        return
    sigs = np.concatenate([h[0] for h in held])
    names = np.array([h[1] for h in held], dtype=np.int64)
    owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[0]) for h in held])
    target = (((sigs >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    sigs, owner, target = sigs[order], owner[order], target[order]
    cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]]))
    raw = sigs.view(np.uint8).reshape(-1, 8)[:, :KEPT]
    rows = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        used, local = np.unique(owner[a:b], return_inverse=True)
        rows.append((int(target[a]), raw[a:b].tobytes(), local.astype("<u4" if len(used) > 65535 else "<u2").tobytes(), names[used].tobytes()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
        names=["part", "sigs", "owner", "names"],
    )


BLOCKS = "part int, sigs binary, owner binary, names binary"


def _blocks(docs: DataFrame, parts: int, percent: int, frequent: Frequent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, size = Bands(percent), [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                for items in shingle_sets(texts[a:b]):
                    if len(items):
                        held.append((signatures(items, bands, frequent), set_id(items)))
                        size += len(held[-1][0])
                if size >= HELD:
                    yield from _send(held, parts)
                    held, size = [], 0
        yield from _send(held, parts)

    return docs.select(utf8().alias("raw")).mapInArrow(run, BLOCKS)


MET = "part int, a long, b long, buckets array<long>"


def _meet(parts: int):
    """Of one partition's blocks: candidate pairs (a, b) of small buckets; of larger ones, for each
    member a, the buckets that it is in, dealt by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, sets = [], []
        for batch in batches:
            for part, raw, owner, names in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                wide = np.zeros((len(raw) // KEPT, 8), np.uint8)
                wide[:, :KEPT] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT)
                name = np.frombuffer(names, np.int64)
                local = np.frombuffer(owner, "<u4" if len(name) > 65535 else "<u2")
                sigs.append(wide.view(np.uint64).ravel() ^ (np.uint64(part) << np.uint64(48)))
                sets.append(name[local])
        if not sigs:
            return
        sig, who = np.concatenate(sigs), np.concatenate(sets)
        del sigs, sets
        order = np.argsort(sig, kind="stable")
        sig, who = sig[order], who[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        sig, who = sig[shared], who[shared]
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        fresh = changes(sig, who)
        sig, who = sig[fresh], who[fresh]
        first = np.flatnonzero(changes(sig))
        size = np.diff(np.append(first, len(sig)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, SMALL + 1):
            at = first[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    left.append(who[at + i])
                    right.append(who[at + j])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        for a in range(0, len(pairs), 1 << 18):
            some = pairs[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), pa.int32()), pa.array(some[:, 0]), pa.array(some[:, 1]), pa.nulls(len(some), pa.list_(pa.int64()))],
                names=["part", "a", "b", "buckets"],
            )
        bucket, member = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
            group, name = who[a : a + n], sig[a : a + 1]
            if n <= WIDE:
                bucket.append(np.repeat(name, n))
                member.append(group)
                continue
            block = mix(group.view(np.uint64)) % np.uint64(-(-n // WIDE))
            for i in range(-(-n // WIDE)):
                for j in range(i):
                    some = group[(block == i) | (block == j)]
                    bucket.append(np.repeat(mix(name + np.uint64(i * 65_537 + j)), len(some)))
                    member.append(some)
        bucket, member = np.concatenate(bucket), np.concatenate(member)
        part = ((mix(bucket) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.lexsort((member, part))
        bucket, member, part = bucket[order].view(np.int64), member[order], part[order]
        cut = np.flatnonzero(np.append(changes(part, member), True))
        for k in range(0, len(cut) - 1, 1 << 14):
            some = cut[k : k + (1 << 14) + 1]
            start = some[:-1]
            lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(bucket[some[0] : some[-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[start]), pa.array(member[start]), pa.nulls(len(start), pa.int64()), lists], names=["part", "a", "b", "buckets"]
            )

    return run


def _compare(percent: int, pivots: bool):
    """Of one partition's large buckets: the pairs that a bucket's pivots make, or all pairs of
    members whose components differ, that the sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, sketch, root, bucket, owner = [], [], [], [], [], []
        for batch in batches:
            for a, n, s, r, b in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "sketch", "root", "buckets")), strict=True):
                owner += [len(name)] * len(b)
                bucket += b
                name.append(a)
                size.append(n)
                sketch.append(s)
                root.append(r)
        if not name:
            return
        name, size, root = np.array(name), np.array(size), np.array(root)
        bucket, owner = np.array(bucket), np.array(owner)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        edge = np.flatnonzero(np.append(changes(bucket), True))
        found: list[np.ndarray] = []

        def near(x: int, others: np.ndarray, one: np.ndarray, many: np.ndarray) -> None:
            limit = (size[x] + size[others]) * (100 - percent) // (100 + percent)
            some = others[least_difference(one, many) <= limit]
            if len(some):
                pair = np.stack([np.full(len(some), name[x]), name[some]], 1)
                pair.sort(axis=1)
                found.append(pair)

        for a, b in zip(edge[:-1], edge[1:], strict=True):
            group = np.unique(owner[a:b])
            if not pivots and root[group].min() == root[group].max():
                continue
            rows = same_width([sketch[i] for i in group])
            if pivots:
                # pivots differ between a group's buckets, so the members meet many of each other
                turn = np.uint64((int(bucket[a]) >> 7) % 4)
                for p in np.argsort(mix(name[group].view(np.uint64) + turn))[:PIVOTS]:
                    rest = np.delete(np.arange(len(group)), p)
                    near(group[p], group[rest], rows[p], rows[rest])
            else:
                for p in range(len(group) - 1):
                    rest = p + 1 + np.flatnonzero(root[group[p + 1 :]] != root[group[p]])
                    if len(rest):
                        near(group[p], group[rest], rows[p], rows[rest])
            if len(found) > 5000:
                found[:] = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        for a in range(0, len(pairs), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + (1 << 18), k]) for k in (0, 1)], names=["a", "b"])

    return run


def _possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs that the sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, s, t in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
                x, y = same_width([s, t]) if min(n, m) * 100 >= percent * max(n, m) else (None, None)
                keep.append(x is not None and int(least_difference(x, y[None])[0]) <= (n + m) * (100 - percent) // (100 + percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda c: known.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long")


class _Tally:
    """Frequencies of a task's shingles in bounded memory: those met once are forgotten at each fold."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.size = self.rows = 0
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items: np.ndarray) -> None:
        self.new.append(items)
        self.size += len(items)
        self.rows += 1
        if self.size > 4_000_000:
            self.fold()

    def fold(self) -> None:
        items, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.new]), return_counts=True)
        items, counts = np.concatenate([self.items, items[counts > 1]]), np.concatenate([self.counts, counts[counts > 1]])
        self.items, back = np.unique(items, return_inverse=True)
        self.counts = np.bincount(back, weights=counts, minlength=len(self.items)).astype(np.int64)
        self.new, self.size = [], 0

    def reported(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        keep = self.counts >= max(REPORTED, SHARE * self.rows)
        return self.items[keep], self.counts[keep]


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, sketch, met) of every row, no set_id without shingles;
    rows with ``met`` are a task's frequent shingles (as text_key) and how many of its rows hold them."""
    names = ["doc_id", "text_key", "n_shingles", "set_id", "sketch", "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            texts, n, name, drawn = batch.column(2).to_pylist(), [], [], []
            for a, b in slices(texts):
                for items in shingle_sets(texts[a:b]):
                    n.append(len(items))
                    name.append(set_id(items))
                    drawn.append(sketch(items))
                    tally.add(items)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(drawn, pa.binary()), pa.nulls(len(n), pa.int64())],
                names=names,
            )
        items, counts = tally.reported()
        none = pa.nulls(len(items), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(items.view(np.int64)), none, none, pa.nulls(len(items), pa.binary()), pa.array(counts)], names=names)

    raw = utf8()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_key"), raw.alias("raw"))
    return src.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_id long, sketch binary, met long")


def _frequent(found: DataFrame) -> Frequent:
    """The most frequent shingles of all tasks' reports."""
    rows = found.filter("met IS NOT NULL").groupBy("text_key").agg(F.sum("met").alias("n"))
    rows = rows.filter(F.col("n") >= 4 * REPORTED).orderBy(F.desc("n"), "text_key").limit(FREQUENT).toArrow()
    items, counts = rows.column("text_key").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(np.float64)
    order = np.argsort(items)
    return Frequent(items[order], counts[order])


def _links(docs: DataFrame, known: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The verified pairs, written. Texts are read for the sets in ``pairs`` only."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    named = known.filter("set_id IS NOT NULL").select("set_id", "doc_id", "text_key").join(needed, "set_id", "left_semi")
    named = named.dropDuplicates(["set_id"])
    raw = utf8()
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(raw).alias("k"), raw.alias("raw"))
    texts = rows.join(named, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")))
    texts = materialize(texts.select("set_id", "raw").dropDuplicates(["set_id"]), "texts")
    return materialize(verified(pairs, texts, percent), "links")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, ra, rb = (batch.column(k).to_pylist() for k in range(4))
            todo: dict[int, bytes] = {}
            for name, raw in zip(a + b, ra + rb, strict=True):
                if name not in kept:
                    todo[name] = raw
            names, raws = list(todo), list(todo.values())
            for i, j in slices(raws):
                kept.update(zip(names[i:j], shingle_sets(raws[i:j]), strict=True))
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = kept[x], kept[y]
                n, m = len(x), len(y)
                if min(n, m) * 100 < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])
            if sum(len(s) for s in kept.values()) > 4_000_000:
                kept.clear()

    one = pairs.join(texts.select(F.col("set_id").alias("b"), F.col("raw").alias("rb")), "b")
    two = one.join(texts.select(F.col("set_id").alias("a"), F.col("raw").alias("ra")), "a")
    return two.select("a", "b", "ra", "rb").mapInArrow(run, "u long, v long")


def _part(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part"))


#: Shingles whose signatures one partition takes: some 20 MB of them.
SHINGLES = 4_000_000


def _parts(known: DataFrame) -> int:
    """Partitions for signatures: the session's number, more where the sets would make those large."""
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    return max(partitions(known.sparkSession), -(-total // SHINGLES))


def _candidates(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows' sets; the pairs of small buckets; the members of large buckets."""
    found = materialize(_sets(docs), "sets")
    known = found.filter("met IS NULL").drop("met")
    parts = _parts(known)
    drawn = known.filter("set_id IS NOT NULL").select("set_id", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["set_id"])
    met = materialize(_part(_blocks(docs, parts, percent, _frequent(found)), parts).mapInArrow(_meet(parts), MET), "met")
    pairs = _possible(met.filter("part IS NULL").select("a", "b").distinct(), drawn, percent)
    big = met.filter("part IS NOT NULL").select("part", "a", "buckets")
    big = big.groupBy("part", "a").agg(F.flatten(F.collect_list("buckets")).alias("buckets"))
    return known, pairs, materialize(big.join(drawn.withColumnRenamed("set_id", "a"), "a"), "large")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself, every link of distinct sets: (u, v), and (doc_id, text_key, set_id, n_links) of
    every row, where rows of one set are copies and count as one. Large buckets are compared each with
    each, so this grows with the links, of which a group of n near copies has up to n * n / 2."""
    known, pairs, big = _candidates(docs, percent)
    apart = _part(big.withColumn("root", F.col("a")), _parts(known)).mapInArrow(_compare(percent, False), "a long, b long")
    found = _links(docs, known, materialize(pairs.union(apart).distinct(), "pairs"), percent)
    n = found.select(F.explode(F.array("u", "v")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    rows = known.join(n, "set_id", "left").select("doc_id", "text_key", "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found, rows


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, chosen) of every row: the smallest doc_id that links
    reach, and the (doc_id, text_key) that stands for the component, null without shingles."""
    known, pairs, big = _candidates(docs, percent)
    parts = _parts(known)
    stars = _part(big.withColumn("root", F.col("a")), parts).mapInArrow(_compare(percent, True), "a long, b long")
    pairs = materialize(pairs.union(stars).distinct(), "pairs")
    root = components(_links(docs, known, pairs, percent))
    # members of large buckets that are still apart
    now = big.join(root.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rest = _part(now, parts).mapInArrow(_compare(percent, False), "a long, b long").distinct()
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        more = _links(docs, known, rest, percent)
        root = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    first = known.filter("set_id IS NOT NULL").groupBy("set_id")
    first = first.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    named = first.join(root.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("chosen")), "root").select("set_id", "chosen")
    return known.join(named, "set_id", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.coalesce("chosen.doc_id", "doc_id").alias("component_id"),
        "chosen",
    )


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that of the smallest doc_id and among its texts the least by hash, and
    every document without shingles, all columns kept. Groups are told apart by links, not by ids."""
    kept = classes(docs, percent).filter("n_shingles = 0 OR (doc_id <=> chosen.doc_id AND text_key = chosen.text_key)")
    kept = kept.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.max("n_shingles").alias("_n"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(utf8()).alias("key"), whole)
    rows = rows.join(kept, rows["doc"].eqNullSafe(kept["_doc"]) & (rows["key"] == kept["_key"]))
    copy = F.row_number().over(Window.partitionBy("doc", "key").orderBy("key"))
    return rows.withColumn("copy", copy).filter("copy = 1 OR _n = 0").select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
