"""Problem 1: for every vector the most similar vectors of the collection.

An inverted file of coarse centroids. A vector lies in the list of its nearest centroid; each vector asks the lists of
its nearest centroids, whose entries are scored by a matrix product in single precision, and those that may still be
among the best are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import saved, saved_parts

K = 5
SAMPLE = 262_144  # vectors the index is fitted on at most, chosen by the hashes of their keys
LEAST_SAMPLE, A_LIST = 32_768, 8  # sampled as long as so many rows are there, and sampled rows for each list
LISTS = 4  # lists for each root of the number of rows
MEASURED, TARGET = 512, 0.995  # vectors searched by brute force to choose the number of lists asked, and the share of their neighbours that must lie in these
ASKED_AT_ONCE = 4000  # asking vectors whose lists are looked through together
FEW_ROWS, GROUP_ROWS, MOST_GROUP_ROWS, ASK_ROWS = 500, 4000, 65_536, 32_768
GROUPS_A_CORE = 2
COPIES = 5  # of an asking vector, for the groups it asks, that may be on disk at once for each row
SLACK = 1e-5  # more than products of unit vectors in float32 and the rounding to 6 digits can be off


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimensions, unit length
    probes: int
    group: np.ndarray = None  # of a list, the first of the tasks that hold it together with its neighbours
    shares: np.ndarray = None  # of a list, parts into which its entries are dealt, each in tasks of its own
    blocks: np.ndarray = None  # of a list, parts into which those that ask its group are dealt
    copies: float = 1.0  # tasks that a vector asks on average


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, unit: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=column, minlength=k) for column in x.T], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)]).astype(np.float32)
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + block] @ c.T - half).argmax(1) for i in range(0, len(x), block)])


def list_count(n_rows: int, n_sample: int) -> int:
    """Lists near the root of the rows, as far as the sample has ``A_LIST`` vectors for each."""
    return int(np.clip(LISTS * np.sqrt(n_rows), 1, max(1, n_sample // A_LIST)))


def trained(sample: np.ndarray, n_rows: int, seed: int = 7) -> Index:
    """Centroids from a sample of unit vectors of a collection of ``n_rows``.

    Centroids are fitted in two levels, each cell of the first having as many of the second as its share of the sample.
    """
    rng = np.random.default_rng(seed)
    lists = list_count(n_rows, len(sample))
    top = _kmeans(sample, max(1, int(np.sqrt(lists))), rng, unit=True)
    cell = _nearest(sample, top)
    centroids = []
    for c in np.unique(cell):
        own = sample[cell == c]
        centroids.append(_kmeans(own, max(1, round(lists * len(own) / len(sample))), rng, unit=True))
    centroids = np.concatenate(centroids)
    return Index(centroids, len(centroids))


def fit(sample: np.ndarray, n_rows: int, probes: int = 8) -> Index:
    """A whole index with the number of lists asked given."""
    return laid_out(trained(sample, n_rows), sample, n_rows, probes)


def probes_for(index: Index, asking: np.ndarray, near: np.ndarray, target: float = TARGET) -> int:
    """How many lists vectors must ask so that ``target`` of their neighbours ``near``, row by row, lie in these."""
    if not len(asking):
        return 1
    own = _nearest(near, index.centroids)
    score = asking @ index.centroids.T
    rank = (score > score[np.arange(len(own)), own][:, None]).sum(1)
    return int(np.sort(rank)[int(np.ceil(target * len(rank))) - 1]) + 1


def laid_out(index: Index, sample: np.ndarray, n_rows: int, probes: int, group_rows: int = GROUP_ROWS, groups: int = 16) -> Index:
    """``index`` with tasks of about equal work: neighbouring lists share one, a list of much work is dealt to several.

    How many rows a list has and how many will ask it is read from the sample; the work is their product. Lists stay
    together up to a part of ``groups`` of all work; alone, one of more than ``group_rows`` rows is dealt into shares, and
    those that ask it into blocks where they are many or the work is still too much.
    """
    lists = len(index.centroids)
    index.probes = min(probes, lists)
    rows = np.bincount(_nearest(sample, index.centroids), minlength=lists) * (n_rows / max(1, len(sample)))
    some = sample[:: max(1, len(sample) // 4096)]
    each = n_rows / max(1, len(some))
    asked = [np.argpartition(-(some[i : i + 512] @ index.centroids.T), index.probes - 1, axis=1)[:, : index.probes] for i in range(0, len(some), 512)]
    work = rows * sum(np.bincount(a.ravel(), minlength=lists) for a in asked) * each
    limit = work.sum() / groups
    bins, todo = [], [np.arange(lists)]
    while todo:  # halves along the widest direction until a half is small
        own = todo.pop()
        if len(own) == 1 or rows[own].sum() <= FEW_ROWS or work[own].sum() <= limit and rows[own].sum() <= MOST_GROUP_ROWS:
            bins.append(own)
            continue
        x = index.centroids[own] - index.centroids[own].mean(0)
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0])
        cut = int(np.clip(np.searchsorted(np.cumsum(work[own][order]), work[own].sum() / 2), 1, len(own) - 1))
        todo += [own[order[:cut]], own[order[cut:]]]
    which = np.empty(lists, np.int64)
    for b, own in enumerate(bins):
        which[own] = b
    asks = np.zeros(len(bins))
    for a in asked:
        hit = np.zeros((len(a), len(bins)), bool)
        np.put_along_axis(hit, which[a], True, axis=1)
        asks += hit.sum(0) * each
    index.group, index.shares, index.blocks = np.zeros(lists, np.int64), np.ones(lists, np.int64), np.ones(lists, np.int64)
    n, copies = 0, 0.0
    for b, own in enumerate(bins):
        index.group[own] = n
        blocks = asks[b] / ASK_ROWS
        if len(own) == 1:
            index.shares[own] = max(1, int(np.ceil(rows[own[0]] / group_rows)))
            blocks = max(blocks, work[own[0]] / limit / index.shares[own[0]] if rows[own[0]] > FEW_ROWS else 0)
        index.blocks[own] = max(1, int(np.ceil(blocks)))
        n += int(index.shares[own].max() * index.blocks[own].max())
        copies += asks[b] * index.shares[own].max()
    index.copies = copies / max(1, n_rows)
    return index


def usable(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dims`` finite numbers, not all zero, and these as float64; lists are all ``dims`` long."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return ok, x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first, lest squares overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _firsts(k: int, owner: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Positions of the first ``k`` of each owner in the order of the keys, the last being the most important."""
    by = np.lexsort((*order, owner))
    own = owner[by]
    return by[np.arange(len(by)) - np.searchsorted(own, own) < k]


def search_group(index: Index, base: pd.DataFrame, asking: pd.DataFrame, k: int) -> Iterator[tuple[bytes, list[tuple[float, str]]]]:
    """For each asking vector its best ``k`` keys among the lists of this group: (-cosine rounded to 6 digits, key).

    Of entries with their keys in order, those of the best ``k`` by cosine, then first key, hold the best ``k`` keys. An
    entry is compared exactly if by the error of single precision it may be as good as the ``k``-th best; there is no other bound.
    """
    if not len(base) or not len(asking):
        return
    base = base.sort_values("cell", kind="stable")
    vec = _matrix(base["vec"], np.float32)
    cells, first = np.unique(base["cell"].to_numpy(), return_index=True)
    bounds = {int(c): (int(a), int(b)) for c, a, b in zip(cells, first, [*first[1:], len(base)])}
    ids = [sorted(names) for names in base["ids"]]
    place = np.empty(len(ids), np.int64)  # of an entry by its first key
    place[sorted(range(len(ids)), key=lambda i: ids[i][0])] = np.arange(len(ids))
    for low in range(0, len(asking), ASKED_AT_ONCE):
        block = asking.iloc[low : low + ASKED_AT_ONCE]
        q = _matrix(block["vec"], np.float32)
        probes = [np.frombuffer(p, np.int32) for p in block["probes"]]
        flat, owner = np.concatenate(probes), np.repeat(np.arange(len(block)), list(map(len, probes)))
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        near = np.einsum("ij,ij->i", q[owner], index.centroids[flat])
        lead = np.zeros(len(flat), bool)  # the nearest list of each, which tells how good its k-th best is at least
        lead[_firsts(1, owner, -near)] = True
        lows = np.full((len(block), k), -np.inf, np.float32)
        found = []
        for leading in (True, False):
            todo = np.flatnonzero(lead == leading)
            todo = todo[np.isin(flat[todo], cells)]
            starts = np.flatnonzero(np.diff(flat[todo], prepend=-1))
            for some in np.split(todo, starts[1:]) if len(todo) else ():
                who, cell = owner[some], int(flat[some[0]])
                for start in range(*bounds[cell], 2000):
                    stop = min(bounds[cell][1], start + 2000)
                    score = q[who] @ vec[start:stop].T
                    if leading:
                        lows[who] = np.partition(np.concatenate([lows[who], score - SLACK], axis=1), -k, axis=1)[:, -k:]
                    row, at = np.nonzero(score + SLACK >= lows[who, 0][:, None])
                    found.append((who[row], at + start, score[row, at] - SLACK, score[row, at] + SLACK))
        if not found:
            continue
        fq, fb, at_least, at_most = map(np.concatenate, zip(*found))
        order = np.lexsort((-at_least, fq))
        start = np.searchsorted(fq[order], np.arange(len(block) + 1))
        last = np.minimum(start[:-1] + k, start[1:]) - 1
        least = np.where(start[1:] - start[:-1] >= k, at_least[order][np.maximum(last, 0)], -np.inf)  # the k-th best is this good at least
        kept = np.flatnonzero(at_most >= least[fq])
        fq, fb = fq[kept], fb[kept]
        exact = np.concatenate([np.round(np.einsum("ij,ij->i", q[fq[i : i + 50_000]].astype(np.float64), vec[fb[i : i + 50_000]].astype(np.float64)), 6) for i in range(0, len(fq), 50_000)])
        kept = _firsts(k, fq, place[fb], -exact)
        fq, fb, exact = fq[kept], fb[kept], exact[kept]
        start = np.searchsorted(fq, np.arange(len(block) + 1))
        for i, key in enumerate(block["vkey"]):
            s, e = start[i], start[i + 1]
            if s < e:
                yield key, sorted((-float(x), name) for x, j in zip(exact[s:e], fb[s:e]) for name in ids[j])[:k]


def _neighbours(flat: DataFrame, asking: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of few ``asking`` vectors the best ``k`` others by brute force, row by row: asking vectors and neighbours."""
    shared = flat.sparkSession.sparkContext.broadcast(asking)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        held = np.empty((len(q), 0), np.float32), np.empty((len(q), 0, q.shape[1]), np.float32)
        for batch in batches:
            x = _matrix(batch["vec"], np.float32) if len(batch) else np.empty((0, q.shape[1]), np.float32)
            score = q @ x.T
            score[score > 1 - 1e-6] = -np.inf  # itself and its copies
            n = min(k, len(x))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n] if n else np.empty((len(q), 0), np.int64)
            score, near = np.concatenate([held[0], np.take_along_axis(score, at, 1)], axis=1), np.concatenate([held[1], x[at]], axis=1)
            at = np.argsort(-score, axis=1, kind="stable")[:, :k]
            held = np.take_along_axis(score, at, 1), np.take_along_axis(near, at[:, :, None], 1)
        i, j = np.nonzero(np.isfinite(held[0]))
        yield pd.DataFrame({"q": i.astype(np.int32), "score": held[0][i, j].astype(np.float64), "vec": [held[1][a, b].tobytes() for a, b in zip(i, j)]})

    best = flat.select("vec").mapInPandas(search, "q int, score double, vec binary")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec"))).where(F.col("n") <= k)
    rows = best.select("q", "vec").collect()  # k for each of the measured vectors
    return asking[[r["q"] for r in rows]], _matrix([r["vec"] for r in rows], np.float32) if rows else asking[:0]


def most_similar(df: DataFrame, key: str = "id", vector: str = "embedding", dims: int = 64, k: int = K, probes: int | None = None, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """The ``k`` most similar rows of every row by cosine: key, rank, neighbour, similarity (6 digits).

    Ties go to the smaller key. Rows with a null key, a null vector or one that is not ``dims`` finite numbers, or all
    zero, take no part; a repeated key counts once. Vectors of one direction are one entry of the index with its ``k + 1``
    smallest keys, which is all that any row can need of them, and are asked for once; so any number of copies costs no
    more. An empty collection gives no rows.

    The index is fitted on at most ``sample`` vectors and holds every row. Lists grow with the root of the rows; how many
    each vector asks is measured, unless ``probes`` says it: as many as hold ``TARGET`` of the true neighbours of
    ``MEASURED`` vectors, found by brute force. Within the lists asked nothing is left out that may be better. ``exact``
    asks all lists: no loss, and work that grows with the square of the rows. A list of many rows, and those that ask
    it, are dealt to several tasks. A vector is sent to every task that holds a list it asks; so that no more than
    ``COPIES`` for each row are on disk at once, vectors ask in rounds, each of which is finished and written before the next.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dims) & F.col("id").isNotNull())
    kind = dict(rows.dtypes)["id"]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = usable(batch.column("v"), dims)
            u = unit(x)
            names = batch.column("id").filter(pa.array(ok))
            keys = pa.array([xxhash.xxh3_128_digest(np.ascontiguousarray(r).tobytes()) for r in np.round(u, 8) + 0.0], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, names, pa.array([r.tobytes() for r in u.astype(np.float32)], pa.binary())], ["vkey", "id", "vec"])

    flat = saved(rows.mapInArrow(plain, f"vkey binary, id {kind}, vec binary"), "vectors")
    n_rows = flat.count()
    wanted = min(sample, max(LEAST_SAMPLE, A_LIST * list_count(n_rows, sample)))
    part = int(min(1.0, 0.95 * wanted / max(1, n_rows)) * 2**30)  # of all hashes; the limit only guards the bound
    few = flat.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < part).orderBy(F.xxhash64("id", F.lit(1)), "id").select("vec").limit(wanted).toArrow()["vec"].to_pylist()
    if not few:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, neighbour {kind}, similarity double")
    few = _matrix(few, np.float32)
    index = trained(few, n_rows)
    asked = len(index.centroids) if exact else probes or probes_for(index, *_neighbours(flat, few[:MEASURED], k))
    groups = GROUPS_A_CORE * spark.sparkContext.defaultParallelism
    index = laid_out(index, few, n_rows, asked, int(np.clip(n_rows // groups, GROUP_ROWS, MOST_GROUP_ROWS)), groups)
    shared = spark.sparkContext.broadcast(index)  # at most SAMPLE / A_LIST centroids
    rounds = max(1, int(np.ceil(index.copies / COPIES)))

    by_vector = Window.partitionBy("vkey").orderBy("id")
    entries = flat.withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= k + 1).groupBy("vkey").agg(F.collect_set("id").alias("ids"), F.min("vec").alias("vec"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in (whole.iloc[i : i + 1000] for whole in batches for i in range(0, len(whole), 1000)):
            x = _matrix(batch["vec"], np.float32)
            near = x @ index.centroids.T
            cell = near.argmax(1)
            asked = np.argpartition(-near, index.probes - 1, axis=1)[:, : index.probes].astype(np.int32)
            order = np.argsort(index.group[asked], axis=1, kind="stable")
            asked = np.take_along_axis(asked, order, 1)
            yield batch.assign(cell=cell.astype(np.int32), asked=[a.tobytes() for a in asked])

    lists = saved(entries.select("vkey", "ids", "vec").mapInPandas(listed, f"vkey binary, ids array<{kind}>, vec binary, cell int, asked binary"), "lists")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        held = group["cell"].to_numpy() >= 0
        hits = search_group(shared.value, group[held], group[~held], k + 1)
        return pd.DataFrame([(name, [(s, n) for s, n in best]) for name, best in hits], columns=["vkey", "best"])

    def searched(now: int) -> DataFrame:
        """The best of the vectors that ask in this round."""

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in (whole.iloc[i : i + 1000] for whole in batches for i in range(0, len(whole), 1000)):
                vkey, vec, ids, cell = (batch[c].to_numpy() for c in ("vkey", "vec", "ids", "cell"))
                deal = np.array([int.from_bytes(v[:8], "little") for v in vkey], np.uint64) >> np.uint64(1)
                # an entry lies in one share of its list, once for each block of those that ask
                who, block = _times(index.blocks[cell])
                share = (deal[who] % index.shares[cell[who]].astype(np.uint64)).astype(np.int64)
                yield pd.DataFrame({"grp": index.group[cell[who]] + share * index.blocks[cell[who]] + block, "vkey": None, "ids": ids[who], "vec": vec[who], "cell": cell[who], "probes": None})
                # one that asks goes to every share of a list, in its own block
                own = np.flatnonzero(deal // np.uint64(104_729) % np.uint64(rounds) == now)
                if not len(own):
                    continue
                vkey, vec, deal, asked = vkey[own], vec[own], deal[own], _matrix(batch["asked"].iloc[own], np.int32)
                group = index.group[asked]
                first = np.concatenate([np.ones((len(group), 1), bool), group[:, 1:] != group[:, :-1]], axis=1)
                who, at = np.nonzero(first)
                end = np.append(at[1:], 0)
                end[np.append(who[1:] != who[:-1], True)] = index.probes
                cells = asked[who, at]
                i, share = _times(index.shares[cells])  # a list with shares is alone in its groups
                block = (deal[who[i]] // np.uint64(7919) % index.blocks[cells[i]].astype(np.uint64)).astype(np.int64)
                probes = np.array([asked[w, a:b].tobytes() for w, a, b in zip(who, at, end)], object)
                yield pd.DataFrame({"grp": group[who, at][i] + share * index.blocks[cells[i]] + block, "vkey": vkey[who[i]], "ids": None, "vec": vec[who[i]], "cell": np.int32(-1), "probes": probes[i]})

        rows = lists.mapInPandas(dealt, f"grp long, vkey binary, ids array<{kind}>, vec binary, cell int, probes binary")
        part = rows.groupBy("grp").applyInPandas(search, f"vkey binary, best array<struct<far: double, near: {kind}>>")
        return part.groupBy("vkey").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))

    best = saved_parts((searched(now) for now in range(rounds)), "best")  # a round's shuffle files go before the next begins
    members = flat.select("vkey", "id").distinct()
    own = members.join(best, "vkey").select("id", F.slice(F.filter("best", lambda b: b["near"] != F.col("id")), 1, k).alias("best"))
    return own.select(F.col("id").alias(key), F.posexplode("best").alias("rank", "b")).select(key, (F.col("rank") + 1).alias("rank"), F.col("b.near").alias("neighbour"), (-F.col("b.far")).alias("similarity"))


def _times(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position as often as ``n`` says, and the how-manieth of its times it is."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
