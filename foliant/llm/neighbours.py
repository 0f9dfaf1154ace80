"""Most similar vectors by randomly rotated one-bit codes (problem 3).

Every vector goes to the list of its nearest centre and, as a visitor, to every
list whose centre is almost as near. Inside a list a vector is its
residual from the centre, randomly rotated and kept as one sign bit per
dimension with two scalars: the residual's length and the inner product of the
unit residual with its own code. Inner products are estimated from the packed
bits and a 4-bit query (bit planes and popcounts); pairs whose estimate plus
its error bound reaches the wanted similarity are reranked exactly.

Equal vectors are one entry with their smallest row ids; they are collapsed
before the shuffle and expanded by a join afterwards, so a group of copies of
any size is never gathered in one place and never turned into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import spread


@dataclass(frozen=True)
class Index:
    """Parameters; the defaults are those of production.

    Lists grow in number with the rows, one for each ``list_rows``, up to ``max_lists``; the
    centres are fitted on at most ``sample_rows`` rows and go to every task (at most
    max_lists x dim x 4 bytes, 16 MB here). Up to ``flat_lists`` a vector meets every centre,
    beyond that those of the nearest ``probes`` groups of centres. ``margin`` says how much worse
    than the nearest a centre may be for its list to be visited too; every list within it is.
    A list of more than ``block`` rows is split into blocks, each a task of its own, and
    meets its visitors ``visitors`` at a time, so a dense region is never gathered.

    Exact, at the price of all comparisons: ``Index(margin=4, epsilon=1e9)`` visits every list
    and reranks every pair (as long as there are no more than ``flat_lists`` lists).
    """

    dim: int = 64
    k: int = 5
    min_similarity: float = 0.9
    list_rows: int = 320
    max_lists: int = 65536
    sample_rows: int = 65536
    iterations: int = 4
    flat_lists: int = 4096
    probes: int = 24
    margin: float = 0.03
    block: int = 65536
    visitors: int = 32768
    epsilon: float = 2.5
    seed: int = 42


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v, k1, k2): rows with an id and a vector of ``dim`` finite values, not all zero; k1, k2 name the vector."""
    v = F.col(vec_col).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sized: Column = F.when(F.size(v) == dim, finite & F.exists(v, lambda x: x != 0)).otherwise(False)
    clean = F.transform(v, lambda x: x + F.lit(0.0).cast("float"))  # -0.0 and 0.0 are one value
    return (
        df.select(F.col(id_col).cast("bigint").alias("id"), clean.alias("v"))
        .filter(F.col("id").isNotNull())
        .withColumnRenamed("v", vec_col)
        .filter(sized)
        .select("id", F.col(vec_col).alias("v"), F.xxhash64(vec_col).alias("k1"), F.xxhash64(F.lit(1), vec_col).alias("k2"))
    )


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Centres:
    """Centres of the lists, grouped around coarser ones where they are many, and into how many blocks each list is split."""

    def __init__(self, centres: np.ndarray, p: Index, blocks: np.ndarray | None = None) -> None:
        self.centres, self.margin, self.probes = centres, p.margin, p.probes
        self.blocks = np.ones(len(centres), np.int64) if blocks is None else blocks
        self.groups: list[np.ndarray] = []
        if len(centres) > p.flat_lists:
            rng = np.random.default_rng(p.seed)
            self.coarse = refined(centres, centres[rng.choice(len(centres), int(len(centres) ** 0.5), replace=False)], p.iterations)
            member = nearest(centres, self.coarse)
            self.groups = [np.flatnonzero(member == g) for g in range(len(self.coarse))]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of every list that a vector visits, and the list at which each vector is at home."""
        if not self.groups:
            near = x @ self.centres.T
            rows, lists = np.nonzero(near >= near.max(axis=1, keepdims=True) - self.margin)
            return rows, lists, near.argmax(axis=1)
        far = x @ self.coarse.T
        probes = min(self.probes, far.shape[1])
        asked = np.argpartition(-far, probes - 1, axis=1)[:, :probes]
        order = np.argsort(asked, axis=None, kind="stable")
        group, owner = asked.reshape(-1)[order], order // probes
        best, home = np.full(len(x), -2.0, np.float32), np.zeros(len(x), np.int64)
        found = []
        for g, rows in zip(*_split(group, owner), strict=True):
            members = self.groups[g]
            if not len(members):
                continue
            near = x[rows] @ self.centres[members].T
            top = near.argmax(axis=1)
            most = near[np.arange(len(rows)), top]
            better = most > best[rows]
            best[rows[better]], home[rows[better]] = most[better], members[top[better]]
            i, j = np.nonzero(near >= most[:, None] - self.margin)
            found.append((rows[i], members[j], near[i, j]))
        rows, lists, near = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = near >= best[rows] - self.margin
        order = np.lexsort((lists[keep], rows[keep]))
        return rows[keep][order], lists[keep][order], home


def _split(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of a sorted key, and the values of each."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[start], np.split(values, start[1:]) if len(key) else []


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])


def refined(x: np.ndarray, centres: np.ndarray, iterations: int) -> np.ndarray:
    """Spherical k-means from the given centres."""
    centres = centres.copy()
    for _ in range(iterations):
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest(x, centres), x)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 1e-6] = sums[norms > 1e-6] / norms[norms > 1e-6, None]
    return centres


def fit_centres(vectors: DataFrame, rows: int, p: Index) -> Centres:
    """Centres from a bounded sample by id hash; they start at sampled points, so dense regions get more.

    More than ``flat_lists`` centres stay the points they start at. ``rows``: about how many vectors there are.
    """
    share = 1.0 if rows <= p.sample_rows else 0.95 * p.sample_rows / rows  # below the bound, so that it cuts nothing
    picked = vectors.filter(F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    taken = picked.select("id", "v").toArrow().sort_by("id").slice(0, p.sample_rows)
    sample = np.asarray(taken.column("v").combine_chunks().flatten(), np.float32).reshape(-1, p.dim)
    if not len(sample):
        return Centres(np.zeros((1, p.dim), np.float32), p)
    sample = _unit(sample)
    rng = np.random.default_rng(p.seed)
    lists = int(np.clip(rows // p.list_rows, 1, min(p.max_lists, len(sample))))
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    if lists > p.flat_lists:
        return Centres(centres, p, np.full(lists, -(-rows // (lists * p.block))))
    centres = refined(sample, centres, p.iterations)
    expected = np.bincount(nearest(sample, centres), minlength=lists) * (rows / len(sample))
    return Centres(centres, p, np.maximum(1, np.ceil(expected / p.block)).astype(np.int64))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit words."""
    pad = -bits.shape[1] % 64
    if pad:
        bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(bits, axis=1).view(np.uint64)


def packed_units(x: np.ndarray) -> np.ndarray:
    """Components of unit vectors as 24-bit fixed point, in rows of bytes; the error of a product is below 1e-7."""
    whole = np.rint((x.astype(np.float64) + 1) * 8388607).astype("<u4")
    return np.ascontiguousarray(whole.view(np.uint8).reshape(*x.shape, 4)[:, :, :3]).reshape(len(x), -1)


def unpacked_units(raw: np.ndarray, dim: int) -> np.ndarray:
    whole = np.zeros((len(raw), dim, 4), np.uint8)
    whole[:, :, :3] = raw.reshape(-1, dim, 3)
    return (whole.reshape(len(raw), -1).view("<u4") / 8388607.0 - 1).astype(np.float32)


@dataclass
class Codes:
    """One-bit codes of rows against one centre."""

    words: np.ndarray
    ones: np.ndarray
    length: np.ndarray
    fit: np.ndarray
    along: np.ndarray

    @staticmethod
    def of(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        r = x - centre
        length = np.linalg.norm(r, axis=1)
        y = (r / np.maximum(length, 1e-12)[:, None]) @ turn
        bits = y > 0
        fit = np.maximum(np.abs(y).sum(axis=1) / np.sqrt(x.shape[1]), 1e-3)
        return Codes(_words(bits), bits.sum(axis=1).astype(np.float32), length, fit, x @ centre)


def estimate(q: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rows ``q`` with the coded rows, and their error bounds."""
    dim = q.shape[1]
    r = q - centre
    y = r @ turn
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / 15, 1e-9)
    level = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    total = np.zeros((len(q), len(codes.ones)), np.uint16)
    for bit in range(4):
        plane = _words((level >> bit) & 1 == 1)
        for w in range(plane.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & codes.words[None, :, w]).astype(np.uint16) << bit
    inside = low[:, None] * codes.ones[None, :] + step[:, None] * total
    dot = (2 * inside - y.sum(axis=1)[:, None]) / np.sqrt(dim)
    scale = codes.length / codes.fit
    guess = dot * scale[None, :] + codes.along[None, :] + ((q @ centre) - float(centre @ centre))[:, None]
    spread_ = np.sqrt(np.maximum(1 - codes.fit**2, 0)) * epsilon / np.sqrt(max(dim - 1, 1))
    bound = np.linalg.norm(r, axis=1)[:, None] * (scale * spread_)[None, :] + (0.75 * step)[:, None] * scale[None, :]
    return guess, bound


def _first(group: np.ndarray, sim: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` most similar entries of each group, ties by smaller id; groups in order."""
    order = np.lexsort((ids, -sim, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < keep]


def list_edges(
    x: np.ndarray, ids: list[np.ndarray], home: np.ndarray, centre: np.ndarray, turn: np.ndarray, p: Index, block: int = 1024, since: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, row id, similarity) of one list: each entry's k + 1 most similar row ids of at least the wanted similarity.

    Entries from ``since`` on are compared with those at home here, block by block; of each block
    only k + 1 per entry are kept, so memory doesn't grow with the matches.
    """
    keep = p.k + 1
    at_home = np.flatnonzero(home)
    size = np.array([len(i) for i in ids])
    flat = np.concatenate(ids)
    offset = np.r_[0, np.cumsum(size)]
    least = np.array([i[0] for i in ids])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in range(0, len(at_home), 4 * block):
        there = at_home[b : b + 4 * block]
        codes = Codes.of(x[there], centre, turn)
        for a in range(since, len(x), block):
            guess, bound = estimate(x[a : a + block], codes, centre, turn, p.epsilon)
            i, j = np.nonzero(guess + bound >= p.min_similarity)
            i, j = i + a, there[j]
            other = i != j
            i, j = i[other], j[other]
            sim = np.einsum("ij,ij->i", x[i].astype(np.float64), x[j].astype(np.float64)).round(9)
            near = sim >= p.min_similarity
            i, j, sim = i[near], j[near], np.minimum(sim[near], 1.0)
            back = ~home[i]
            i, j, sim = np.r_[i, j[back]], np.r_[j, i[back]], np.r_[sim, sim[back]]
            top = _first(i, sim, least[j], keep)
            found.append((i[top], j[top], sim[top]))
            if len(found) > 16:
                i, j, sim = (np.concatenate(c) for c in zip(*found, strict=True))
                top = _first(i, sim, least[j], keep)
                found = [(i[top], j[top], sim[top])]
    i, j, sim = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    own = np.flatnonzero((size > 1) | np.isin(np.arange(len(x)), i))
    i, j, sim = np.r_[i, own], np.r_[j, own], np.r_[sim, np.ones(len(own))]
    n = size[j]
    at = np.repeat(offset[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    i, sim, to = np.repeat(i, n), np.repeat(sim, n), flat[at]
    top = _first(i, sim, to, keep + 1)
    return i[top], to[top], sim[top]


def _assign(centres: Centres, p: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield from part(batch.slice(at, 4096))

    def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rowid, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
        x = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, p.dim)
        # Copies inside the batch become one row with their smallest ids.
        order = np.lexsort((rowid, k2, k1))
        new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
        start = np.flatnonzero(new)
        ids = [np.unique(g)[: p.k + 1] for g in np.split(rowid[order], start[1:])]
        first = order[start]
        x, k1, k2 = _unit(x[first]), k1[first], k2[first]
        rows, lists, home = centres.visits(x)
        # A list that is split has its rows in blocks by their hash; each block is visited, also by the list's other rows.
        blocks = centres.blocks[lists]
        rows, lists = np.repeat(rows, blocks), np.repeat(lists, blocks)
        block = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at_home = (home[rows] == lists) & (block == k1[rows] % centres.blocks[lists])
        number = lists.astype(np.int64) * (1 << 24) + block
        raw = packed_units(x)
        for a in range(0, len(rows), p.visitors):
            row = rows[a : a + p.visitors]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number[a : a + p.visitors]),
                    pa.array(at_home[a : a + p.visitors]),
                    pa.array(k1[row]),
                    pa.array(k2[row]),
                    pa.array([ids[r] for r in row], pa.list_(pa.int64())),
                    pa.array([raw[r].tobytes() for r in row], pa.binary()),
                ],
                ["list", "home", "k1", "k2", "ids", "x"],
            )

    return run


def _search(centres: Centres, p: Index):
    turn = rotation(p.dim, p.seed)

    def entries(parts: list[pa.Table]) -> tuple:
        """(k1, k2, ids, home, x) of each distinct vector."""
        t = pa.concat_tables(parts)
        k1, k2 = (t.column(c).to_numpy() for c in ("k1", "k2"))
        order = np.lexsort((k2, k1))
        start = np.flatnonzero(np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
        first = order[start]
        lists = t.column("ids").to_pylist()
        ids = [np.unique(np.concatenate([lists[r] for r in g]))[: p.k + 1] for g in np.split(order, start[1:])]
        home = t.column("home").to_numpy(zero_copy_only=False)[first].astype(bool)
        raw = t.column("x").combine_chunks().take(pa.array(first))
        x = unpacked_units(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(raw), -1), p.dim)
        return k1[first], k2[first], ids, home, x

    def edges(number: int, e: tuple, since: int) -> pa.RecordBatch:
        k1, k2, ids, home, x = e
        i, to, sim = list_edges(x, ids, home, centres.centres[number >> 24], turn, p, since=since)
        return pa.RecordBatch.from_arrays([pa.array(k1[i]), pa.array(k2[i]), pa.array(to.astype(np.int64)), pa.array(sim)], ["k1", "k2", "to", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, base = -1, [], None

        def met() -> pa.RecordBatch:
            """What was read so far: the list itself and its first visitors, then further visitors with the list."""
            nonlocal parts, base
            e, since = entries(parts), 0
            if base is None:
                base = tuple([c for c, h in zip(v, e[3], strict=True) if h] if isinstance(v, list) else v[e[3]] for v in e)
            else:
                since = len(base[2])
                e = tuple(a + b if isinstance(a, list) else np.concatenate([a, b]) for a, b in zip(base, e, strict=True))
            parts = []
            return edges(number, e, since)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            marks, home = t.column("list").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(marks[1:] != marks[:-1]) + 1, len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if marks[a] != number:
                    if parts:
                        yield met()
                    number, base = int(marks[a]), None
                parts.append(t.slice(a, b - a))
                # Those at home come first; once a visitor was read, none is missing.
                if not home[b - 1] and sum(len(x) for x in parts) >= p.visitors:
                    yield met()
        if parts:
            yield met()

    return run


def similar_pairs(df: DataFrame, id_col: str = "chunk_rowid", vec_col: str = "embedding", params: Index | None = None) -> DataFrame:
    """(rowid_a, rowid_b), a < b: rows of at least ``min_similarity`` of which one is among the other's k most similar.

    Approximate: recall is measured in the tests and given in the README. The similarity of every
    returned pair is exact; where a nearer neighbour was missed, the next one takes its place. Ties go to the smaller row id.

    * null, all-zero, non-finite vectors, vectors of another size and rows without id have no neighbours.
    * a row delivered twice is one vector; equal vectors are each other's most similar, in order of id.
    * empty table: no pairs. Further columns are not read.
    """
    p = params or Index()
    vectors = valid_vectors(df, id_col, vec_col, p.dim)
    rows = df.count()  # from the files' metadata; invalid and repeated rows don't matter for sizes
    centres = fit_centres(vectors, rows, p)
    routed = vectors.select("id", "v", "k1", "k2").mapInArrow(
        _assign(centres, p), "list bigint, home boolean, k1 bigint, k2 bigint, ids array<bigint>, x binary"
    )
    # A vector visits some three lists, with its ids and keys beside it.
    lists = spread(routed, "list", rows * 3 * (3 * p.dim + 60))
    edges = lists.sortWithinPartitions("list", F.desc("home")).mapInArrow(_search(centres, p), "k1 bigint, k2 bigint, to bigint, sim double")
    # One shuffle by vector serves both aggregations; a vector has at most k + 2 edges from each list it visits, and from each block of its own list's visitors.
    best = (
        edges.repartition("k1", "k2")
        .groupBy("k1", "k2", "to")
        .agg(F.max("sim").alias("sim"))
        .groupBy("k1", "k2")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "to"))), 1, p.k + 1).alias("near"))
    )
    others = F.slice(F.filter("near", lambda t: t["to"] != F.col("id")), 1, p.k)
    return (
        vectors.select("k1", "k2", "id")
        .join(best, ["k1", "k2"])
        .select("id", F.explode(others).alias("t"))
        .select(F.least("id", "t.to").alias("rowid_a"), F.greatest("id", "t.to").alias("rowid_b"))
        .distinct()
    )
