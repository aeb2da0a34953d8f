"""N-gram Jaccard join (3): an exact join of the metric space of n-gram sets at Jaccard distance 1 - t, as groups of near duplicates.

Whole documents are poor pivots here: unrelated ones all lie at distance 1, so every document would be on every boundary. The first level's pivots are
therefore the n-grams themselves, as sets of one. A document's home is the region of its rarest gram, and its window holds the regions of its
next ones: |x| - ceil(t |x|) + k grams in all, because two sets within the radius have their first k common grams (rarest first) in
both windows. k grows with the set (SHARE), so a pair must meet in k regions before it counts as a candidate. Regions recurse:

1. A scan counts grams and words in tables of constant size, of which only the order of grams comes (any order gives the same result), and gives
   every row the 64-bit key of its gram set; equal sets are one point from here on.
2. Windows go to hash buckets, packed. Regions with two points or more stay.
3. Neighbours in a region that meet k times make clusters: connected components. Pairs of one cluster are settled inside it, all others
   that meet as often as their sizes demand (_least_meetings) one by one, on the whole sets.
4. A cluster of more than BLOCK points is cut by document pivots, level by level: members of it chosen by hash. A point is at home in the Voronoi region of the nearest pivot if it
   is within r of it; by the triangle inequality it must also be seen, as a guest, by regions j with d(x, p_j) <= radius_j + r, and by no others. Points at home
   nowhere go on to the next level, with other pivots. A region (or a rest after LEVELS levels) that is still larger is compared in tiles, so that no task gets more than two of them.
5. In a region all pairs are compared exactly, by one product of its incidence matrix.

The result is exact: all pairs with Jaccard >= t are found, counted as links of both, and their connected components are the groups. (Keys and grams are 64-bit hashes.)
Links are counted, not listed: copies of a set count as links, but aren't expanded.

Defined cases: a null text, and one without a token, has no grams and is in no group. A text of fewer than n tokens is one gram. Rows that repeat
are copies of each other; the one with the least id (null last), then the first in the table, stays. An empty table has no groups. Extra columns stay;
names beginning with _nj_ are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.llm.common import SEPARATORS_RE, TOKEN_RE, components, cut, gram_hashes, keyed, lowered, mix, pieces, stable, token_hashes

#: Words in a gram; least Jaccard similarity; k's share of a set's size; cells of the counting table; bytes of row numbers to broadcast at most.
N, THRESHOLD, SHARE, CELLS, MAX_BROADCAST = 3, 0.6, 0.05, 1 << 20, 64 << 20
#: Points of a region, and grams of them, that a task compares with each other or with as many of another tile; pivots of a cluster in a level, about; levels.
BLOCK, BLOCK_GRAMS, PIVOTS, LEVELS = 1000, 4_000_000, 64, 6
_SLICES = 16
_SALT = np.uint64(0x5851F42D4C957F2D)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _grams(batch: pa.RecordBatch, text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, firsts, grams, at): hashes with repetitions, in the order of the text."""
    hashes, firsts = token_hashes(lowered(batch.column(text)))
    return hashes, firsts, *gram_hashes(hashes, firsts, n)


def _sets(batch: pa.RecordBatch, text: str, n: int, ranks: tuple[np.ndarray, np.ndarray] | None = None, known: tuple | None = None) -> tuple[np.ndarray, ...]:
    """(grams, firsts, keys): the rows' sets, ascending; the key of an empty set is 0. With ranks, also each gram's place in the order."""
    words, firsts, grams, at = known or _grams(batch, text, n)
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    rank = np.zeros(len(grams), np.uint8)
    if ranks is not None:
        by_word = ranks[1][_cell(words)].astype(np.uint32)
        total = np.zeros(len(words), np.uint32)
        for o in range(n):
            total[: max(0, len(words) - o)] += by_word[o:]
        start = np.arange(len(grams)) + np.repeat(firsts[:-1] - at[:-1], np.diff(at))
        rank = np.maximum(np.where(np.diff(firsts)[row] >= n, total[start] // n, 0).astype(np.uint8), ranks[0][_cell(grams)])
    order = np.lexsort((grams, row))
    grams, row, rank = grams[order], row[order], rank[order]
    if len(grams):
        new = np.ones(len(grams), np.bool_)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row, rank = grams[new], row[new], rank[new]
    at = np.searchsorted(row, np.arange(batch.num_rows + 1))
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ _SALT), out=total[1:])
    keys = mix(total[at[1:]] - total[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))
    keys = np.where(at[1:] > at[:-1], keys, np.uint64(0))
    return (grams, at, keys) if ranks is None else (grams, at, keys, rank)


def _k(size: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(1 + (size * SHARE).astype(np.int64), np.maximum(1, np.ceil(t * size - 1e-9).astype(np.int64)))


def _least_meetings(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Regions in which sets of these sizes within the radius must meet. All their common grams up to where the first of the two windows ends are met; after it, that
    set has ceil(t s) - k left. What is missing of the least overlap, t / (1 + t) (a + b), must have been met. One less is asked for, should two grams of a set share a region."""
    left = lambda s: np.ceil(t * s - 1e-9).astype(np.int64) - _k(s, t)
    return np.maximum(1, np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64) - np.maximum(left(a), left(b)) - 1)


def _jaccard(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return overlap / np.maximum(1, a + b - overlap)


def _scan(docs: DataFrame, text: str, id_col: str, n: int) -> DataFrame:
    """A row for each of docs' (its number, id, key), and the counts of grams and words in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.uint32)
        kind = None
        for whole in batches:
            for batch in pieces(whole, text):
                known = _grams(batch, text, n)
                grams, _, keys = _sets(batch, text, n, known=known)
                for k, x in enumerate((grams, known[0])):
                    counts[k] += np.bincount(_cell(x), minlength=CELLS).astype(np.uint32)
                rows, kind = batch.num_rows, batch.column(id_col).type
                yield pa.RecordBatch.from_arrays([batch.column("_nj_row"), batch.column(id_col), pa.array(keys.view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if kind is not None:
            parts = np.split(counts.ravel(), _SLICES)
            yield pa.RecordBatch.from_arrays([pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, kind), pa.nulls(_SLICES, pa.int64()), pa.array(range(_SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names)

    names = ["_nj_row", "_nj_id", "_nj_key", "slice", "counts"]
    kinds = [T.LongType(), docs.schema[id_col].dataType, T.LongType(), T.IntegerType(), T.BinaryType()]
    return docs.select(text, "_nj_row", id_col).mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in zip(names, kinds)]))


def _ranks(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(of grams, of words): ranks by cell, the rare ones low. A gram's rank is the mean of its words', which tells common words' grams from others at any size of the
    corpus; a gram whose own cell is well above the mean (a passage that many documents share) comes after all of those."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64)
                total[s] = total[s] + x if s in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    found = scan.filter("slice is not null").select("slice", "counts").repartition(_SLICES, "slice").mapInArrow(add, schema).collect()
    counts = np.zeros(2 * CELLS)
    size = len(counts) // _SLICES
    for row in found:
        counts[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.counts, np.uint32)
    grams, words = counts[:CELLS], counts[CELLS:]
    hot = grams > grams.mean() + 5 * np.sqrt(grams.mean()) + 1
    own = np.where(hot, 200 + np.clip(3 * np.log2(np.maximum(1, grams / max(1.0, grams.mean()))), 0, 55), 0)
    return own.astype(np.uint8), np.clip(6 * np.log2(np.maximum(1, words)), 0, 199).astype(np.uint8)


def _once(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of keys come for the first time in this task, the keys seen by now): a hot text's copies count once a task."""
    new, first = np.unique(keys, return_index=True)
    fresh = ~np.isin(new, seen)
    once = np.zeros(len(keys), np.bool_)
    once[first[fresh]] = True
    return once, np.concatenate([seen, new[fresh]])


def _windows(docs: DataFrame, text: str, n: int, t: float, ranks, buckets: int) -> DataFrame:
    """Packed windows: bucket, and for each entry the region (32 bits of the gram besides the bucket), the point's key and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = ranks.value, np.zeros(0, np.uint64)
        for whole in batches:
            held: list[tuple] = []
            for batch in pieces(whole, text):
                grams, at, keys, rank = _sets(batch, text, n, order)
                size = np.diff(at)
                once, seen = _once(keys, seen)
                row = np.repeat(np.arange(len(size)), size)
                grams, rank, row = grams[once[row]], rank[once[row]], row[once[row]]
                spot = (row.astype(np.uint64) << np.uint64(40)) | (rank.astype(np.uint64) << np.uint64(32)) | (mix(grams) & np.uint64(0xFFFFFFFF))
                by = np.argsort(spot, kind="stable")
                grams, row = grams[by], row[by]
                first_of = np.searchsorted(row, np.arange(len(size)))
                place = np.arange(len(row)) - first_of[row]
                length = np.minimum(size, size - np.ceil(t * size - 1e-9).astype(np.int64) + _k(size, t))
                inside = place < length[row]
                g = mix(grams[inside] ^ _SALT)
                held.append((((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), (g & np.uint64(0xFFFFFFFF)).astype(np.uint32), keys[row[inside]], np.minimum(size[row[inside]], 2**31 - 1).astype(np.int32)))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield _packed(held)
                    held = []
            if held:
                yield _packed(held)

    return docs.select(text).mapInArrow(run, "bucket int, h binary, keys binary, sizes binary")


def _packed(held: list[tuple]) -> pa.RecordBatch:
    bucket, h, keys, sizes = (np.concatenate(x) for x in zip(*held))
    by = np.argsort(bucket, kind="stable")
    bucket, h, keys, sizes = bucket[by], h[by], keys[by], sizes[by]
    names, first = np.unique(bucket, return_index=True)
    cut_at = lambda x: pa.array([p.tobytes() for p in np.split(x, first[1:])] if len(names) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), cut_at(h), cut_at(keys), cut_at(sizes)], ["bucket", "h", "keys", "sizes"])


def _regions(windows: DataFrame, buckets: int) -> DataFrame:
    """The regions with two points or more, each a row: the points' keys (ascending) and sizes. Regions of the same points are one, with a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, *x in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.setdefault(b, []).append(x)
        for b in sorted(held):
            parts = held.pop(b)
            h, keys, sizes = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in enumerate((np.uint32, np.uint64, np.int32)))
            by = np.lexsort((keys, h))
            h, keys, sizes = h[by], keys[by], sizes[by]
            new = np.ones(len(h), np.bool_)
            new[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])
            h, keys, sizes = h[new], keys[new], sizes[new]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.diff(np.r_[start, len(h)])
            total = np.add.reduceat(mix(keys), start)
            start, many, total = start[many > 1], many[many > 1], total[many > 1]
            total, pick, weight = np.unique(total, return_index=True, return_counts=True)
            start, many = start[pick], many[pick]
            index = np.arange(many.sum()) + np.repeat(start - np.r_[0, np.cumsum(many)[:-1]], many) if len(many) else np.zeros(0, np.int64)
            at = np.r_[0, np.cumsum(many)].astype(np.int64)
            for k in range(0, len(many), 20000):  # rows of a batch
                part = slice(at[k], at[min(k + 20000, len(many))])
                off = pa.array((at[k : k + 20001] - at[k]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (keys[index[part]].view(np.int64), sizes[index[part]])]
                yield pa.RecordBatch.from_arrays([pa.array(total[k : k + 20000].view(np.int64)), *lists, pa.array(weight[k : k + 20000])], ["region", "keys", "sizes", "weight"])

    packed = windows.repartition(buckets, "bucket").mapInArrow(run, "region long, keys array<long>, sizes array<int>, weight long")
    return packed.groupBy("region").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.sum("weight").alias("weight"))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the run of equal values that each place is in."""
    new = np.ones(len(columns[0]), np.bool_)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return start[which], np.r_[start[1:], len(new)][which]


def _pairs(region: np.ndarray, cluster: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a region: neighbours, or (rows in the order of region, cluster) all pairs that aren't of one cluster. Cluster 0 is none."""
    if not len(region):
        return
    place, (_, end) = np.arange(len(region)), _runs(region)
    first, last = place + 1, np.minimum(place + 2, end)
    if cluster is not None:
        first, last = np.where(cluster == 0, place + 1, _runs(region, cluster)[1]), end
    many = np.maximum(0, last - first)
    total, done = np.cumsum(many), 0
    while done < len(many):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 2_000_000, "right")))
        n = many[done:stop]
        yield np.repeat(place[done:stop], n), np.arange(n.sum()) + np.repeat(first[done:stop] - np.r_[0, np.cumsum(n)[:-1]], n)
        done = stop


def _meetings(regions: DataFrame, t: float, clusters: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(a, b): neighbours that meet in k regions; with clusters (keys, labels), or a column of them, all pairs not of one cluster that meet as often as they must."""
    own = regions.sparkSession.sparkContext.broadcast(clusters) if clusters is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = batch.column("keys"), batch.column("sizes")
            many = np.diff(keys.offsets.to_numpy())
            region = np.repeat(np.arange(len(many)), many)
            key, size, weight = keys.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64), np.repeat(batch.column("weight").to_numpy(), many)
            cluster = None
            if own is not None:
                names, labels = own.value
                at = np.minimum(np.searchsorted(names, key), max(0, len(names) - 1))
                cluster = np.where(names[at] == key, labels[at], 0) if len(names) else np.zeros(len(key), np.int64)
            elif "clusters" in batch.schema.names:
                cluster = batch.column("clusters").flatten().to_numpy()
            if cluster is not None and len(key):
                # regions that lie inside one cluster are settled
                start = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
                mixed = np.add.reduceat(((cluster != np.repeat(cluster[start], many)) | (cluster == 0)).astype(np.int64), start) > 0
                keep = np.flatnonzero(np.repeat(mixed, many))
                keep = keep[np.lexsort((key[keep], cluster[keep], region[keep]))]
                region, key, size, weight, cluster = region[keep], key[keep], size[keep], weight[keep], cluster[keep]
            k = _k(size, t)
            for i, j in _pairs(region, cluster):
                ok = np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - 1e-9
                i, j = i[ok], j[ok]
                need = np.minimum(k[i], k[j]) if cluster is None else _least_meetings(size[i], size[j], t)
                a, b, w = np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), weight[i]
                if len(a):
                    by = np.lexsort((b, a))
                    a, b, need, w = a[by], b[by], need[by], w[by]
                    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(need[start]), pa.array(np.add.reduceat(w, start))], ["a", "b", "need", "n"])

    met = regions.mapInArrow(run, "a long, b long, need long, n long")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need")).filter("n >= need").select("a", "b")


def _small(keys: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(keys, clusters), ascending by key, if they may be broadcast."""
    if keys.count() * 16 > MAX_BROADCAST:
        return None
    table = keys.select("key", "cluster").toArrow()
    key, cluster = table.column("key").to_numpy(), table.column("cluster").to_numpy()
    by = np.argsort(key)
    return key[by], cluster[by]


def _clustered(regions: DataFrame, clusters: DataFrame) -> DataFrame:
    """The way beyond a broadcast: regions with a column of their points' clusters."""
    point = F.explode(F.arrays_zip("keys", "sizes")).alias("p")
    flat = regions.select("region", "weight", point).select("region", "weight", F.col("p.keys").alias("key"), F.col("p.sizes").alias("size"))
    named = flat.join(clusters, "key", "left").select("region", "weight", F.struct("key", "size", F.coalesce("cluster", F.lit(0)).alias("cluster")).alias("p"))
    whole = named.groupBy("region").agg(F.first("weight").alias("weight"), F.collect_list("p").alias("p"))
    return whole.select("region", F.col("p.key").alias("keys"), F.col("p.size").alias("sizes"), "weight", F.col("p.cluster").alias("clusters"))


def _gram_sets(docs: DataFrame, text: str, n: int, keys: DataFrame) -> DataFrame:
    """(key, cluster, grams) of the points in keys (key, cluster), once each. keys are broadcast up to a size; beyond it they are joined."""
    small = _small(keys)
    own = docs.sparkSession.sparkContext.broadcast(small) if small is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for whole in batches:
            for batch in pieces(whole, text):
                grams, at, found = _sets(batch, text, n)
                keep, seen = _once(found, seen)
                found = found.view(np.int64)
                keep, cluster = keep & (found != 0), np.zeros(len(found), np.int64)
                if own is not None:
                    names, labels = own.value
                    spot = np.minimum(np.searchsorted(names, found), max(0, len(names) - 1))
                    keep &= (names[spot] == found) if len(names) else False
                    cluster = labels[spot] if len(names) else cluster
                which = np.flatnonzero(keep)
                sets = pa.array([grams[at[i] : at[i + 1]].tobytes() for i in which], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(found[which]), pa.array(cluster[which]), sets], ["key", "cluster", "grams"])

    found = docs.select(text).mapInArrow(run, "key long, cluster long, grams binary")
    once = found.groupBy("key").agg(F.first("cluster").alias("cluster"), F.first("grams").alias("grams"))
    return once if own is not None else once.drop("cluster").join(keys, "key")


def shared_grams(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(rows, columns): grams in common of the sets at these places, by products of slices of their incidence matrix. Grams of one set alone are left out."""
    size = np.array([len(x) for x in sets], np.int64)
    names, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(often > 1)
    place = np.full(len(names), -1, np.int64)
    place[common] = np.arange(len(common))
    at, row = place[gram], np.repeat(np.arange(len(sets)), size)
    by = np.argsort(at, kind="stable")
    at, row = at[by], row[by]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for lo in range(0, len(common), 4096):
        part = slice(*np.searchsorted(at, (lo, lo + 4096)))
        dense = np.zeros((len(sets), min(4096, len(common) - lo)), np.float32)
        dense[row[part], at[part] - lo] = 1
        out += dense[rows] @ dense[columns].T
    return out


def settle(table: pa.Table, t: float) -> pa.Table:
    """(key, root, links): for each point with a link in this tile or pair of tiles, a point of its component here, and how many documents it is linked with. Guests aren't held against guests."""
    key, weight, home, tile = (table.column(c).to_numpy() for c in ("key", "n", "home", "tile"))
    grams = table.column("grams").combine_chunks()
    sets = [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in range(len(key))]
    size = np.array([len(x) for x in sets], np.float64)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    rows, columns, apart = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi), lo != hi
    overlap = shared_grams(sets, rows, columns)
    near = _jaccard(overlap, size[rows][:, None], size[columns][None]) >= t - 1e-9
    near &= home[rows][:, None] | home[columns][None]
    if not apart:
        np.fill_diagonal(near, False)
    links = np.zeros(len(key), np.int64)
    links[rows] += near @ weight[columns]
    if apart:
        links[columns] += near.T @ weight[rows]
    i, j = np.nonzero(near)
    root = np.arange(len(key))
    while len(i):  # the least place spreads
        least = np.minimum(root[rows[i]], root[columns[j]])
        before = root.copy()
        np.minimum.at(root, rows[i], least)
        np.minimum.at(root, columns[j], least)
        root = root[root]
        if (root == before).all():
            break
    has = np.flatnonzero(links)
    return pa.table({"key": key[has], "root": key[root[has]], "links": links[has]})


def nearest(members: pa.Table, pivots: pa.Table, t: float) -> pa.Table:
    """members (cluster, key, n, grams) with at_home (the place of the nearest pivot if it is within the radius, else -1), its distance, and near: the other pivots within twice the radius and their distances."""
    r, names = 1 - t + 1e-9, ["cluster", "key", "n", "grams"]
    pivots = pivots.sort_by("pivot_key")
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for column in (members.column("grams"), pivots.column("pivot_grams")) for x in column]
    size, m = np.array([len(x) for x in sets], np.float64), members.num_rows
    d = 1 - _jaccard(shared_grams(sets, np.arange(m), np.arange(m, len(sets))), size[:m, None], size[None, m:])
    best = d.argmin(1)
    least = d[np.arange(m), best]
    home = np.where(least <= r, best, -1)
    near = (d <= 2 * r) & (np.arange(d.shape[1])[None] != home[:, None])
    off = pa.array(np.r_[0, np.cumsum(near.sum(1))].astype(np.int32))
    place = pa.array(np.nonzero(near)[1].astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, x) for x in (place, pa.array(d[near]))]
    return pa.table([*(members.column(c) for c in names), pa.array(home.astype(np.int32)), pa.array(least), *lists], [*names, "at_home", "distance", "places", "distances"])


def _parts(sets: DataFrame, t: float) -> DataFrame:
    """(region, level, key, n, grams, home) of sets (cluster, key, n, grams): clusters of up to BLOCK points as they are, larger ones cut by pivots; see above."""
    r = 1 - t + 1e-9
    out = ["region", "level", "key", "n", "grams", "home"]
    counts = cut(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("points"), F.min("key").alias("least")).filter(F.col("points") > BLOCK), "ngram-large")
    whole = lambda df, level: df.select(F.col("cluster").alias("region"), F.lit(level).alias("level"), "key", "n", "grams", F.lit(True).alias("home"))
    if not counts.head(1):
        return whole(sets, -1)
    done = whole(sets.join(counts, "cluster", "left_anti"), -1)
    rest = cut(sets.join(counts.select("cluster"), "cluster", "left_semi"), "ngram-rest")
    for level in range(LEVELS):
        one_in = F.greatest(F.lit(1), F.floor(F.col("points") / PIVOTS))
        salts = counts.withColumn("salts", F.ceil(F.col("points") / BLOCK).cast("int"))
        named = rest.join(salts, "cluster")
        pivots = named.filter((F.col("key") == F.col("least")) | (F.pmod(F.xxhash64("key", F.lit(level)), one_in) == 0))
        pivots = pivots.select(*(F.col(c).alias(f"pivot_{c}") for c in ("cluster", "key", "grams")), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("pivot_salt")).groupBy("pivot_cluster", "pivot_salt")
        members = named.select("cluster", "key", "n", "grams", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt")).groupBy("cluster", "salt")
        found = members.cogroup(pivots).applyInArrow(lambda x, y: nearest(x, y, t), "cluster long, key long, n long, grams binary, at_home int, distance double, places array<int>, distances array<double>")
        held = cut(found, "ngram-homes")
        at_home = held.filter("at_home >= 0")
        radius = at_home.groupBy("cluster", F.col("at_home").alias("place")).agg(F.max("distance").alias("radius"))
        number = lambda place: F.xxhash64("cluster", place)
        guest = held.select("cluster", "key", "n", "grams", "at_home", F.inline(F.arrays_zip("places", "distances"))).withColumnsRenamed({"places": "place", "distances": "d"}).filter("at_home < 0 or place < at_home")
        guest = guest.join(radius, ["cluster", "place"]).filter(F.col("d") <= F.col("radius") + r)
        done = done.unionByName(at_home.select(number("at_home").alias("region"), F.lit(level).alias("level"), "key", "n", "grams", F.lit(True).alias("home")))
        done = done.unionByName(guest.select(number("place").alias("region"), F.lit(level).alias("level"), "key", "n", "grams", F.lit(False).alias("home")))
        rest = held.filter("at_home < 0").select("cluster", "key", "n", "grams")
        counts = cut(rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("points"), F.min("key").alias("least")).filter(F.col("points") > BLOCK), "ngram-large")
        if not counts.head(1):
            break
        done = done.unionByName(whole(rest.join(counts, "cluster", "left_anti"), LEVELS + level))
        rest = rest.join(counts.select("cluster"), "cluster", "left_semi")
    return done.unionByName(whole(rest, 2 * LEVELS)).select(*out)


def _inside(sets: DataFrame, t: float) -> DataFrame:
    """(key, root, links) of all pairs inside clusters: each region in one task, or in tiles if it has more than BLOCK points or BLOCK_GRAMS grams."""
    parts = _parts(sets, t)
    sizes = parts.groupBy("region", "level").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("grams")) / (8 * BLOCK_GRAMS))).cast("int").alias("tiles")).filter("tiles > 1")
    parts = parts.join(sizes, ["region", "level"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    parts = parts.select("region", "level", "key", "n", "grams", "home", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    parts = parts.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    return parts.groupBy("region", "level", "lo", "hi").applyInArrow(lambda table: settle(table, t), "key long, root long, links long")


def links(docs: DataFrame, text: str, id_col: str, n: int, t: float, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points, links): each row's number, id and key; (key, root, links), one row or more for each key with a link: root is a key of the same group, links sum up to the documents
    it is linked with (weighted) or the keys."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = cut(_scan(docs, text, id_col, n), "ngram-scan")
    ranks = spark.sparkContext.broadcast(_ranks(scan))
    regions = cut(_regions(_windows(docs, text, n, t, ranks, buckets), buckets), "ngram-regions")
    clusters = cut(components(_meetings(regions, t)).withColumnsRenamed({"node": "key", "label": "cluster"}), "ngram-clusters")
    small = _small(clusters)
    others = cut(_meetings(regions, t, small) if small is not None else _meetings(_clustered(regions, clusters), t), "ngram-pairs")
    apart = others.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    keys = cut(clusters.select("key", "cluster").unionByName(apart.join(clusters, "key", "left_anti").withColumn("cluster", F.lit(0).cast("long"))), "ngram-keys")
    points = scan.filter("slice is null and _nj_key <> 0").select("_nj_row", "_nj_id", "_nj_key")
    sets = _gram_sets(docs, text, n, keys)
    if weighted:
        crowd = points.groupBy(F.col("_nj_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        sets = sets.join(crowd, "key")
    else:
        sets = sets.withColumn("n", F.lit(1).cast("long"))
    sets = cut(sets, "ngram-sets")
    needed = sets.join(apart, "key", "left_semi").select("key", "n", "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / max(1, len(x) + len(y) - both) >= t - 1e-9)
            yield batch.select(["a", "b", "m", "n"]).filter(pa.array(keep, pa.bool_()))

    inside = _inside(sets.filter("cluster <> 0"), t)
    get = lambda k, v, w: needed.select(F.col("key").alias(k), F.col("grams").alias(v), F.col("n").alias(w))
    across = others.join(get("a", "x", "m"), "a").join(get("b", "y", "n"), "b").select("a", "b", "x", "y", "m", "n").mapInArrow(verify, "a long, b long, m long, n long")
    ends = F.inline(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("root"), F.col("n").alias("links")), F.struct(F.col("b").alias("key"), F.col("a").alias("root"), F.col("m").alias("links"))))
    return points, cut(inside.unionByName(across.select(ends)), "ngram-links")


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    return keyed(stable(docs.drop("_nj_row")), id_col, "_nj_row", "ngram-numbered")


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(_nj_row, _nj_id, _nj_group, n_docs, n_links, _nj_stays) of the rows in groups of two or more; the one that stays gives the group its id. n_links: other rows within the radius."""
    docs = _keyed(docs, id_col)
    points, found = links(docs, text, id_col, n, t)
    grouped = _groups(points, found)
    degree = found.groupBy("key").agg(F.sum("links").alias("links"))
    own = points.groupBy("_nj_key").agg((F.count(F.lit(1)) - 1).alias("equal")).join(degree, F.col("_nj_key") == F.col("key"), "left").drop("key")
    return grouped.join(own, "_nj_key").withColumn("n_links", F.col("equal") + F.coalesce("links", F.lit(0))).drop("_nj_key", "equal", "links")


def _groups(points: DataFrame, found: DataFrame) -> DataFrame:
    label = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    # first by key, then by group, so that neither a text that repeats nor a large group is one task
    place = F.struct(F.col("_nj_id").isNull().alias("none"), F.col("_nj_id").alias("id"), F.col("_nj_row").alias("row"))
    by_key = points.groupBy("_nj_key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).join(label, F.col("_nj_key") == F.col("node"), "left")
    by_key = by_key.select("_nj_key", "n", "first", F.coalesce("label", "_nj_key").alias("_nj_root"))
    crowd = by_key.groupBy("_nj_root").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first")).filter("n_docs > 1")
    named = points.join(by_key.select("_nj_key", "_nj_root").join(crowd, "_nj_root"), "_nj_key")
    return named.select("_nj_row", "_nj_id", "_nj_key", F.col("first.id").alias("_nj_group"), "n_docs", (F.col("_nj_row") == F.col("first.row")).alias("_nj_stays"))


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, t: float = THRESHOLD, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with one row of each group. Numbers of rows that go are broadcast up to a size; beyond it they are joined."""
    numbered = _keyed(docs, id_col)
    gone = cut(_groups(*links(numbered, text, id_col, n, t, weighted=False)).filter("not _nj_stays").select("_nj_row"), "ngram-gone")
    if gone.count() * 32 > max_broadcast:  # as much as a number takes in a broadcast
        return numbered.join(gone, "_nj_row", "left_anti").drop("_nj_row")
    return numbered.join(F.broadcast(gone), "_nj_row", "left_anti").drop("_nj_row")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select(F.col("_nj_id").alias("doc_id"), F.col("_nj_group").alias("group_id"), F.col("n_docs").cast("bigint").alias("n_docs"), F.col("n_links").cast("bigint").alias("n_links"))


#: All pairs that share a gram, and their components by reachability: over a table with doc_id (unique) and text.
GROUPS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '{SEPARATORS_RE}', ' ', 'g'), '{TOKEN_RE}') AS w FROM {{docs}}),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda k: array_to_string(w[k:k + {N - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS gram FROM d),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE shared >= {THRESHOLD} * (a.n + b.n - shared) - 1e-9),
l AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS n, x AS m FROM l UNION SELECT r.n, l.y FROM r JOIN l ON l.x = r.m),
c AS (SELECT n AS doc_id, min(m) AS group_id, count(*) AS n_docs FROM r GROUP BY n)
SELECT c.doc_id, group_id, n_docs, count(*) AS n_links FROM c JOIN l ON l.x = c.doc_id GROUP BY ALL
"""
ORACLE = GROUPS_SQL.replace("{docs}", "documents")
