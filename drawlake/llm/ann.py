"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Equal vectors are one entry, which keeps its least ids, so a vector that a third of all rows share is searched once. Centroids
and the codebooks of the residuals are fitted on a bounded sample; every vector is indexed. Lists are cells of a two-level
quantiser, a coarse centroid and a second one for its residual, so their number grows with the root of the entries though
the sample is bounded. A query probes the lists whose centroids are nearest; a list holds ids and codes only, and in each a
table of distances between the query's residual and the codebooks' entries ranks the codes (asymmetric distances). The best
codes of all probed lists together, `rerank` of them, are fetched and ranked by exact distance in double precision. The nearest
few lists are ranked first: the distance of their `rerank`-th best code bounds what the other lists need to report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import cut, ship, tidy

SAMPLE = 20_000  # vectors that centroids and codebooks are fitted on, at most: those whose id hashes lowest
LISTS = 4.0  # lists, times the root of the number of entries
PARTS, CODES = 32, 256  # subspaces of a residual, and codes of each
LIST_BLOCK = 1 << 16  # codes of a list that one unit of work ranks
RERANK = 48  # codes of a query that are reranked exactly
TARGET = 0.96  # recall of the coarse probes on held-out vectors of the sample
TUNING = 256  # of them
FIRST = 8  # lists of a query that are ranked first
HELD = 1 << 20  # ranked codes that a task holds before it keeps the best of each query


@dataclass
class Index:
    coarse: np.ndarray  # [k1, d]
    fine: np.ndarray  # [k2, d]: centroids of residuals of the coarse ones
    books: list[np.ndarray]  # per subspace [codes, width]
    cuts: np.ndarray  # where subspaces begin, and d
    probes: int

    def center(self, which: int) -> np.ndarray:
        return self.coarse[which // len(self.fine)] + self.fine[which % len(self.fine)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances, up to a term of the row alone, between vectors and the centers of all lists."""
        far = (self.coarse * self.coarse).sum(1)[None, :] - 2 * x @ self.coarse.T
        near = (self.fine * self.fine).sum(1)[None, :] - 2 * x @ self.fine.T
        return (far[:, :, None] + near[:, None, :] + 2 * (self.coarse @ self.fine.T)[None]).reshape(len(x), -1)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        at = nearest(x, self.coarse)
        return at * len(self.fine) + nearest(x - self.coarse[at], self.fine)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The lists that each query probes [rows, probes], nearest first."""
        step = max(1, (1 << 24) // (len(self.coarse) * len(self.fine)))
        out = [np.argsort(self.distances(x[a : a + step]), 1, kind="stable")[:, : self.probes] for a in range(0, len(x), step)]
        return np.concatenate(out) if out else np.zeros((0, self.probes), np.int64)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of each row's nearest center."""
    out = np.empty(len(x), np.int64)
    half = (centers * centers).sum(1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmin(half - x[a : a + 4096] @ centers.T, 1)
    return out


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; a center that loses all its rows stays where it is."""
    r = np.random.Generator(np.random.PCG64(seed))
    centers = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        count = np.bincount(at, minlength=len(centers))
        sums = np.zeros(centers.shape)
        np.add.at(sums, at, x)
        held = count > 0
        centers[held] = (sums[held] / count[held, None]).astype(x.dtype)
    return centers


def fit(sample: np.ndarray, entries: int, target: float = TARGET, parts: int = PARTS) -> Index:
    """An index for `entries` vectors from a sample of them [rows, d] (float32)."""
    d = sample.shape[1]
    wanted = max(1.0, LISTS * entries**0.5)
    k1 = int(max(1, min(wanted, len(sample) // 8)))
    k2 = int(max(1, min(round(wanted / k1), len(sample) // 8)))
    coarse = k_means(sample, k1, 1)
    residuals = sample - coarse[nearest(sample, coarse)]
    fine = k_means(residuals, k2, 101) if k2 > 1 else np.zeros((1, d), sample.dtype)
    residuals = residuals - fine[nearest(residuals, fine)]
    cuts = np.linspace(0, d, min(parts, d) + 1).astype(int)
    books = [k_means(np.ascontiguousarray(residuals[:, a:b]), min(CODES, len(sample)), 2 + i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    index = Index(coarse, fine, books, cuts, 1)
    # Probes: the least number that finds `target` of the ten nearest rows of the sample, over held-out queries.
    at, ranks = index.lists(sample), []
    for q in sample[:: max(1, len(sample) // TUNING)]:
        distance = ((sample - q) ** 2).sum(1)
        ten = np.argpartition(distance, min(10, len(sample) - 1))[:11]
        order = np.empty(k1 * k2, np.int64)
        order[np.argsort(index.distances(q[None])[0], kind="stable")] = np.arange(k1 * k2)
        ranks.append(order[at[ten]])
    index.probes = max(1, min(k1 * k2, int(np.quantile(np.concatenate(ranks), target, method="higher")) + 1))
    return index


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and codes of each vector."""
    at = index.lists(x)
    r = x - (index.coarse[at // len(index.fine)] + index.fine[at % len(index.fine)])
    codes = np.stack([nearest(np.ascontiguousarray(r[:, a:b]), book) for book, a, b in zip(index.books, index.cuts[:-1], index.cuts[1:], strict=True)], 1)
    return at, codes.astype(np.uint8)


def rank_codes(index: Index, which: int, queries: np.ndarray, codes: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the code and squared distance by the tables, of the `keep` best codes of a list for each query."""
    rows, found, scores = [], [], []
    step = max(1, min(512, (1 << 22) // max(1, len(codes))))
    for s in range(0, len(queries), step):
        residual = queries[s : s + step] - index.center(which)
        distance = np.zeros((len(residual), len(codes)), np.float32)
        for i, (book, a, b) in enumerate(zip(index.books, index.cuts[:-1], index.cuts[1:], strict=True)):
            part = residual[:, a:b]
            table = (part * part).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * part @ book.T
            distance += table[:, codes[:, i]]
        if len(codes) > keep:
            best = np.sort(np.argsort(distance, 1, kind="stable")[:, :keep], 1)
        else:
            best = np.broadcast_to(np.arange(len(codes)), distance.shape)
        rows.append(np.repeat(np.arange(s, s + len(residual)), best.shape[1]))
        found.append(best.reshape(-1))
        scores.append(np.take_along_axis(distance, best, 1).reshape(-1))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def best_of(owner: np.ndarray, entry: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` rows of least score of each owner."""
    order = np.lexsort((entry, score, owner))
    owner, entry, score = owner[order], entry[order], score[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return owner[rank < keep], entry[rank < keep], score[rank < keep]


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part: not null, no null or non-finite component, not all zero. Vectors of
    floats stay floats, all others are doubles."""
    x = F.col(f"`{vector}`")
    kind = df.schema[vector].dataType
    x = x if kind.simpleString() == "array<float>" else x.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & finite & F.exists(x, lambda v: v != 0))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("embedding"))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _singles(column: pa.Array, d: int) -> np.ndarray:
    return _vectors(column, d).astype(np.float32)


def search(
    df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, target: float = TARGET, rerank: int = RERANK, block: int = LIST_BLOCK
) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k nearest found of each query, of all rows but those of its own id.

    is_query: a condition on the column vec_id. Score: Euclidean distance in double precision of the original vectors; ties
    go to the smaller vec_id. A query gets all candidates if they are fewer than k. Vectors that are null, zero, hold null
    or non-finite components or have a null id take no part; vectors of another length than the query's are no candidates
    of it, so each length is searched by itself. Rows that repeat id and vector are one. An empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, id_col, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = sorted(r[0] for r in rows.select(F.size("embedding").alias("d")).distinct().collect())
    found = [_search_length(rows.where(F.size("embedding") == d), is_query, k, d, sample, target, rerank, block) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _search_length(rows: DataFrame, is_query, k: int, d: int, sample: int, target: float, rerank: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    # One entry per distinct vector, with its k + 1 least ids; the limit is taken before the shuffle.
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1)
    entries = cut(least.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0]))
    asked = rows.where(is_query)
    owners = cut(asked.join(entries.select("embedding", "entry"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("owner")).distinct())

    n = entries.count()
    taken = entries.select("entry", "embedding").orderBy(F.xxhash64("entry"), "entry").limit(sample).toArrow()
    index = fit(_singles(taken.column("embedding").combine_chunks(), d), n, target)
    shared = spark.sparkContext.broadcast(index)
    vector_type = entries.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes = encode(shared.value, _singles(batch.column(1), d))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "entry", "code"])

    listed = cut(entries.select("entry", "embedding").mapInArrow(tidy(place), "list int, entry long, code binary"))
    # Lists longer than a block, which only a crowd of near-equal vectors makes, are dealt to several units; their number
    # is at most the entries over the block, a row each.
    long_lists = {c: -(-m // block) for c, m in listed.groupBy("list").count().where(F.col("count") > block).collect()}
    split = spark.sparkContext.broadcast(long_lists)

    def probe(batches: Iterator[pa.RecordBatch], from_: int, to: int | None) -> Iterator[pa.RecordBatch]:
        index, parts = shared.value, split.value
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                lists = index.probed(_singles(batch.column(1), d))[:, from_:to]
                units = [(i, c, p) for i, own in enumerate(lists.tolist()) for c in own for p in range(parts.get(c, 1))]
                if units:
                    row, which, part = (pa.array(x, t) for x, t in zip(zip(*units, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True))
                    yield pa.RecordBatch.from_arrays([which, part, *[batch.column(i).take(row) for i in range(3)]], names=["list", "part", "entry", "embedding", "bound"])

    split_by = F.create_map(*[x for c, m in long_lists.items() for x in (F.lit(c), F.lit(m))]) if long_lists else None
    part_of = F.lit(0) if split_by is None else F.pmod(F.xxhash64("entry"), F.coalesce(F.try_element_at(split_by, F.col("list")), F.lit(1))).cast("int")
    candidates = listed.select("list", part_of.alias("part"), F.lit(0).alias("kind"), "entry", "code", F.lit(None).cast(vector_type).alias("embedding"), F.lit(None).cast("float").alias("bound"))
    wanted = entries.join(owners.select(F.col("owner").alias("entry")).distinct(), "entry", "left_semi").select("entry", "embedding")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        now, held, codes, ids = None, [], None, None
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            if not len(key):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                unit, kind, part = tuple(key[a, :2].tolist()), int(key[a, 2]), batch.slice(a, b - a)
                if unit != now:
                    now, held, codes = unit, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if codes is None:
                    all_ = pa.Table.from_batches(held)
                    codes = np.frombuffer(b"".join(all_.column("code").to_pylist()), np.uint8).reshape(all_.num_rows, -1)
                    ids = all_.column("entry").to_numpy()
                row, near, score = rank_codes(index, unit[0], _singles(part.column(5), d), codes, rerank)
                told = score <= part.column(6).to_numpy()[row]
                out.append((part.column(3).to_numpy()[row[told]], ids[near[told]], score[told]))
                size += int(told.sum())
                if size > HELD:
                    out = [best_of(*map(np.concatenate, zip(*out, strict=True)), rerank)]
                    if (size := len(out[0][0])) > HELD // 2:  # so many queries that keeping their best frees little
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out[0]], names=["owner", "entry", "score"])
                        out, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_of(*map(np.concatenate, zip(*out, strict=True)), rerank)], names=["owner", "entry", "score"])

    def ranked(asked: DataFrame, from_: int, to: int | None) -> DataFrame:
        """owner, entry, score of the best codes in some of the lists of each query (entry, embedding, bound)."""
        probes = asked.mapInArrow(tidy(lambda batches: probe(batches, from_, to)), f"list int, part int, entry long, embedding {vector_type}, bound float")
        asks = probes.select("list", "part", F.lit(1).alias("kind"), "entry", F.lit(None).cast("binary").alias("code"), "embedding", "bound")
        work = candidates.unionByName(asks).repartition("list", "part").sortWithinPartitions("list", "part", "kind", "entry")
        near = work.mapInArrow(tidy(rank), "owner long, entry long, score float")
        return near.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy("score", "entry"))).where(F.col("r") <= rerank)

    none = F.lit(float("inf")).cast("float")
    best = cut(ranked(wanted.withColumn("bound", none), 0, FIRST))
    if index.probes > FIRST:
        bounds = best.where(F.col("r") == rerank).select(F.col("owner").alias("entry"), F.col("score").alias("bound"))
        others = wanted.join(bounds, "entry", "left").withColumn("bound", F.coalesce("bound", none))
        both = best.unionByName(ranked(others, FIRST, None)).withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy("score", "entry")))
        best = both.where(F.col("r") <= rerank)
    best = best.select("owner", "entry")
    itself = owners.select("owner", F.col("owner").alias("entry"))  # the queries' own copies are candidates of each other
    pairs = best.union(itself).distinct()
    fetched = pairs.join(entries.select("entry", "ids", F.col("embedding").alias("theirs")), "entry").join(wanted.select(F.col("entry").alias("owner"), F.col("embedding").alias("own")), "owner")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _vectors(batch.column(2), d).astype(np.float64) - _vectors(batch.column(3), d).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt((apart * apart).sum(1))), batch.column(1)], names=["owner", "score", "ids"])

    with_ids = fetched.select("owner", "ids", "theirs", "own").mapInArrow(tidy(measure), "owner long, score double, ids array<long>").select("owner", "score", F.explode("ids").alias("vec_id"))
    lists = cut(
        with_ids.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy("score", "vec_id")))
        .where(F.col("r") <= k + 1)
        .groupBy("owner")
        .agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    )
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return owners.join(lists, "owner").select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
