"""N-gram Jaccard join through a MinHash LSH forest, with exact verification.

1. One pass over the texts hashes each document's set of word shingles and its MinHash signature: TREES labels of DEPTH
   bytes. Documents with equal sets are one class from here on.
2. Each tree is a prefix trie: the labels sorted, dealt to tasks by the shortest prefix in use. A walk takes the pairs under
   one node level by level, from the whole label upwards, so each pair is met at the longest prefix that it shares. How far
   up a document's pairs are taken is found out from the data: documents of a bounded sample are edited to just above the
   threshold, and for each range of set sizes the matched prefix is shortened until the share of those pairs that meet in
   some tree reaches the target. Sets too small to have any other set within the threshold stop at once.
   Pairs whose whole signatures agree well enough are kept, as a spanning forest of links rather than as pairs.
3. Inside the components of those links the texts are read again, and every pair is verified on its exact shingle sets.
   Only counts and a spanning forest of the verified links leave a task.

A node or component of many documents is split into blocks, and each pair of blocks is a unit of work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.llm import words as W
from drawlake.llm.common import cut, own_name, ship, tidy
from drawlake.llm.components import components

SIMILARITY = 0.8
SHINGLE = 5
TREES, DEPTH = 30, 8
TARGET_RECALL = 0.9999  # share of pairs at the threshold that must meet in some tree
SAMPLE = 1024  # documents that the depths are measured on, those whose node hashes lowest
PAIRS = 4096  # pairs of each range of sizes that are measured
SIZES = (16, 64, 256)  # set sizes at which another range of depths begins
MEASURED_SIZE = 512  # members of a set that are measured; a larger set is represented by a sample of itself
SLACK = 0.2  # a pair whose signatures agree on less than SIMILARITY - SLACK is no candidate: over 7 standard errors
NODE_BLOCK = 512  # documents
TEXT_BLOCK, BLOCK_SHINGLES = 128, 400_000  # documents, and shingles of them


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240229))
    return r.integers(0, 2**32, n, dtype=np.uint32), r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def labels(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """Signature bytes [documents, trees * depth] of non-empty shingle sets."""
    n = trees * depth
    shift, factor = _permutations(n)
    out = np.zeros((len(sets), n), np.uint8)
    for a in range(0, len(sets), 512):
        part = sets[a : a + 512]
        starts = np.cumsum([0, *[len(s) for s in part[:-1]]])
        x = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        for i in range(n):
            least = np.minimum.reduceat((x ^ shift[i]) * factor[i], starts)
            out[a : a + 512, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def edited(members: np.ndarray, similarity: float, r: np.random.Generator) -> np.ndarray:
    """A set whose similarity with this one is the least, by replacing members, that is not below the threshold; if it is
    too small to lose one, it gains one."""
    n = len(members)
    lost = int(np.floor(n * (1 - similarity) / (1 + similarity) + 1e-9))  # (n - lost) / (n + lost) >= similarity
    return np.append(members[r.permutation(n)[lost:]], r.integers(0, 2**64, max(1, lost), dtype=np.uint64))


def shared_prefix(a: np.ndarray, b: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Bytes that labels share from their start on, per pair and tree; a, b: signature bytes [pairs, trees * depth]."""
    same = (a == b).reshape(-1, trees, depth)
    return np.cumprod(same, 2).sum(2)


def measured_depths(sets: list[np.ndarray], similarity: float, trees: int, depth: int, target: float) -> list[int]:
    """For each range of set sizes the longest prefix at which enough pairs at the threshold meet in some tree.

    Measured on the sets given and their edited copies, PAIRS of them or somewhat more. A range without sets that can have
    a partner takes the least depth of the others.
    """
    r = np.random.Generator(np.random.PCG64(7))
    met: dict[int, np.ndarray] = {}
    ranges = np.digitize([len(s) for s in sets], SIZES)
    for k in range(len(SIZES) + 1):
        own = [s for s, g in zip(sets, ranges, strict=True) if g == k and len(s) >= smallest_pair(similarity)]
        if own:
            of = np.arange(-(-PAIRS // len(own)) * len(own)) % len(own)
            one = labels(own, trees, depth)[of]
            two = labels([edited(own[i], similarity, r) for i in of], trees, depth)
            met[k] = shared_prefix(one, two, trees, depth).max(1)
    out = []
    for k in range(len(SIZES) + 1):
        d = depth
        while k in met and d > 1 and (met[k] >= d).mean() < target:
            d -= 1
        out.append(d if k in met else 0)
    least = min((d for d in out if d), default=1)
    return [d or least for d in out]


def smallest_pair(similarity: float) -> int:
    """The least size of a set that can be that similar to another set."""
    n = 1
    while n / (n + 1) < similarity - 1e-9:
        n += 1
    return n


def _long_list(rows: np.ndarray) -> pa.ListArray:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(rows.reshape(-1)))


def sketch(df: DataFrame, text: str = "text", shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of the shingle set, null if the text has no word), n (its size), keys (a
    long per tree)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                found, at = W.hashes(batch.column(2).to_pylist())
                sets = [W.shingles(found[i:j], shingle) for i, j in zip(at[:-1], at[1:], strict=True)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), trees), np.int64)
                if full:
                    keys[full] = labels([sets[i] for i in full], trees, depth).view(">u8").astype(np.int64)
                node = np.array([int(np.sum(W.mix(s), dtype=np.uint64)) ^ len(s) for s in sets], np.uint64).astype(np.int64)
                sizes = np.array([len(s) for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(node, mask=sizes == 0), pa.array(sizes), _long_list(keys)],
                    names=["doc_id", "mark", "node", "n", "keys"],
                )

    body = F.col(f"`{text}`").cast("string")
    return df.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("mark"), body.alias("text")).mapInArrow(
        tidy(run), "doc_id long, mark long, node long, n int, keys array<long>"
    )


def units(blocks: str) -> Column:
    """Pairs of blocks, those of a block with itself included."""
    return F.col(blocks) * (F.col(blocks) + 1) / 2


def dealt(rows: DataFrame, group: list[str], blocks: str, heavy: int, then: Column | str = "node") -> DataFrame:
    """rows once per pair of blocks of its group that it belongs to: plus columns blk, p, q (p <= q); sorted by unit and `then`.

    heavy: the units of groups of several blocks. Those of one group go to partitions one after the other, so that no task
    gets many of them; where there are none, partitions are by hash and adaptive execution joins small ones.
    """
    n = F.col(blocks)
    blk = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(F.col("blk"), j).alias("p"), F.greatest(F.col("blk"), j).alias("q")))
    spread = (
        rows.withColumn("blk", F.when(n > 1, blk).otherwise(F.lit(0)))
        .withColumn("pq", F.explode(F.when(n > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"))))))
        .select("*", "pq.p", "pq.q")
        .drop("pq")
    )
    if heavy:
        session = rows.sparkSession
        parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), max(heavy, session.sparkContext.defaultParallelism))
        at = F.pmod(F.xxhash64(*group) + F.floor(units("q")) + F.col("p"), F.lit(parts)).cast("int")
        placed = spread.repartitionById(parts, at)
    else:
        placed = spread.repartition(*group, "p", "q")
    return placed.sortWithinPartitions(*group, "p", "q", then)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by group; a few thousand rows each, more only if one group has."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in keys]
        same = np.ones(rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= table.column(k).to_numpy() == v
        cut_at = int(np.argmax(same))
        if cut_at:
            yield table.slice(0, cut_at)
            held, rows = table.slice(cut_at).combine_chunks().to_batches(), rows - cut_at
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links and, for each, the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        was = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = np.minimum(root, root[root])
        root = root[root]
        if (was == root).all():
            return nodes, nodes[root]


def trie_pairs(group: np.ndarray, keys: np.ndarray, reach: np.ndarray, depth: int, least: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers i < j of the pairs of a sorted trie, level by level from whole labels up to prefixes of `least` bytes.

    Rows are sorted by group and key (unsigned, one byte a level). A pair comes once, at the longest prefix that it shares,
    if one of the two reaches up to that level; about `most` pairs at a time.
    """
    n = len(keys)
    below = np.arange(1, n + 1)  # where the run of each row's child node ends; at first, the row itself
    for level in range(depth, least - 1, -1):
        prefix = keys >> np.uint64(8 * (depth - level))
        last = np.append((prefix[1:] != prefix[:-1]) | (group[1:] != group[:-1]), True)
        ends = np.flatnonzero(last) + 1
        end = ends[np.searchsorted(ends, np.arange(n), side="right")]
        count = end - below
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            i = np.repeat(np.arange(at, stop), count[at:stop])
            j = np.arange(total[at], total[stop]) - np.repeat(total[at:stop] - below[at:stop], count[at:stop])
            wanted = (reach[i] <= level) | (reach[j] <= level)
            if wanted.any():
                yield i[wanted], j[wanted]
            at = stop
        below = end


def _matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy().reshape(-1, width)


def depths_of(classes: DataFrame, docs: DataFrame, similarity: float, shingle: int, trees: int, depth: int, target: float) -> list[int]:
    """measured_depths() of a sample of the classes (node, rep) of docs (doc_id, text)."""
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "rep")
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("rep"))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = W.hashes(batch.column(1).to_pylist())
            sets = [W.shingles(found[i:j], shingle) for i, j in zip(at[:-1], at[1:], strict=True)]
            short = [s[np.argsort(W.mix(s))[:MEASURED_SIZE]].astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.list_(pa.int64()))], names=["node", "members"])

    rows = texts.select("node", "text").mapInArrow(tidy(run), "node long, members array<long>").orderBy("node").collect()
    return measured_depths([np.array(r["members"], np.int64).astype(np.uint64) for r in rows if r["members"]], similarity, trees, depth, target)


def candidate_links(classes: DataFrame, similarity: float, trees: int, depth: int, reaches: list[int]) -> DataFrame:
    """a, b: a spanning forest of the pairs of classes that meet in the forest and whose signatures agree.

    reaches: for each range of set sizes, the shortest prefix up to which pairs are taken.
    """
    least = min(reaches)
    drop_bits = 8 * (depth - least)
    agree = max(0.0, similarity - SLACK) * trees * depth
    small = smallest_pair(similarity)
    up_to = F.element_at(F.array(*map(F.lit, reaches)), sum((F.col("n") >= s).cast("int") for s in SIZES) + 1)
    reaching = classes.where(F.col("n") >= small).select("node", "keys", up_to.alias("reach"))
    prefixes = reaching.select("node", "reach", F.posexplode(F.transform("keys", lambda x: F.shiftrightunsigned(x, drop_bits))).alias("tree", "prefix"))
    crowded = cut(prefixes.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members"), F.min("reach").alias("least")).where("members > 1"))
    met = prefixes.drop("reach").join(crowded, ["tree", "prefix"])
    members = cut(met.withColumn("blocks", F.ceil(F.col("members") / NODE_BLOCK).cast("int")).select("tree", "prefix", "node", "blocks"))
    labelled = members.join(reaching, "node")
    crowds = crowded.select(F.ceil(F.col("members") / NODE_BLOCK).alias("blocks")).where("blocks > 1")
    heavy = int(crowds.agg(F.sum(units("blocks"))).first()[0] or 0)
    # Sorted by key inside of a unit: one node of the trie at the shortest prefix, or a pair of blocks of it.
    group = ["tree", "prefix", "p", "q"]
    key = F.element_at("keys", F.col("tree") + 1)
    sort_key = F.struct(key < 0, key)  # bytes are compared, so the sign bit is the greatest
    work = dealt(labelled, ["tree", "prefix"], "blocks", heavy, sort_key).select(*group, "blk", "node", "reach", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, group):
            keys = _matrix(table, "keys", trees)
            whole = np.ascontiguousarray(keys).view(np.uint64)
            short = whole >> np.uint64(drop_bits)
            signature = np.ascontiguousarray(keys).view(np.uint8)
            tree, node, blk, p, q, reach = (table.column(c).to_numpy() for c in ("tree", "node", "blk", "p", "q", "reach"))
            bounds = group_bounds(table, group)
            unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            a, b = [], []
            for i, j in trie_pairs(unit, whole[np.arange(len(whole)), tree], reach, depth, least):
                across = (p[i] == q[i]) | (blk[i] != blk[j])
                i, j = i[across], j[across]
                fresh = np.ones(len(i), bool)  # pairs that no earlier tree may have compared
                for t in range(int(tree[i].max(initial=0))):
                    fresh &= ~((short[i, t] == short[j, t]) & (tree[i] > t) & (_levels(whole[i, t] ^ whole[j, t], depth) >= np.minimum(reach[i], reach[j])))
                i, j = i[fresh], j[fresh]
                for s in range(0, len(i), 1 << 14):
                    x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                    good = (signature[x] == signature[y]).sum(1) >= agree
                    a.append(node[x[good]])
                    b.append(node[y[good]])
            if a and len(first := np.concatenate(a)):
                nodes, roots = forest(first, np.concatenate(b))
                own = nodes != roots
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], names=["a", "b"])

    return work.mapInArrow(tidy(run), "a long, b long")


def _levels(differ: np.ndarray, depth: int) -> np.ndarray:
    """Leading equal bytes, from the exclusive or of two labels."""
    out = np.zeros(len(differ), np.int64)
    for k in range(1, depth + 1):
        out += (differ >> np.uint64(8 * (depth - k))) == 0
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of incidence matrices over shared members."""
    n = len(sets)
    members, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], column[at[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    width = max(64, min(4096, (1 << 21) // n))
    edges = np.searchsorted(at, np.arange(0, int(shared.sum()) + width, width))
    for c, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if y > x:
            m = np.zeros((n, width), np.float32)
            m[row[x:y], at[x:y] - c * width] = 1
            out += m @ m.T
    return out


def verified_links(docs: DataFrame, members: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """node, root, links: for each class of a unit of work that has a verified link there, the least class that it is linked
    with through others, and the number of documents in the classes that it is linked with itself.

    members: node, rep (doc_id of one of its documents), copies, comp, n.
    """
    size = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sized = cut(members.join(cut(size), "comp").withColumn("blocks", F.ceil(F.greatest(F.col("members") / TEXT_BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")))
    texts = docs.join(sized, docs["doc_id"] == sized["rep"]).select("comp", "blocks", "node", "copies", "text")
    group = ["comp", "p", "q"]
    heavy = int(sized.select("comp", "blocks").distinct().where("blocks > 1").agg(F.sum(units("blocks"))).first()[0] or 0)
    work = dealt(texts, ["comp"], "blocks", heavy).select(*group, "blk", "node", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, group, 512):
            bounds = group_bounds(table, group)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(a, b - a)
                node, first = np.unique(part.column("node").to_numpy(), return_index=True)  # a repeated row counts in copies
                found, at = W.hashes(part.column("text").take(pa.array(first)).to_pylist())
                sets = [W.shingles(found[i:j], shingle) for i, j in zip(at[:-1], at[1:], strict=True)]
                is_it = np.array([(int(np.sum(W.mix(s), dtype=np.uint64)) ^ len(s)) for s in sets], np.uint64).astype(np.int64) == node
                node, first, sets = node[is_it], first[is_it], [s for s, ok in zip(sets, is_it, strict=True) if ok]
                if len(node) < 2:
                    continue
                blk, copies = (part.column(c).to_numpy()[first] for c in ("blk", "copies"))
                p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
                sizes = np.array([len(s) for s in sets], np.float64)
                both = overlaps(sets).astype(np.float64)
                linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if p != q:
                    linked &= blk[:, None] != blk[None, :]
                i, j = np.nonzero(np.triu(linked))
                if len(i):
                    links = linked @ copies.astype(np.int64)
                    nodes, roots = forest(node[i], node[j])
                    at = np.searchsorted(node, nodes)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(links[at])], names=["node", "root", "links"])

    return work.mapInArrow(tidy(run), "node long, root long, links long")


def _classified(
    df: DataFrame, text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL
) -> DataFrame:
    """The rows of near_duplicates(), with mark, the hash of the row's text."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketched = cut(sketch(docs, "text", shingle, trees, depth).withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))))
    classes = cut(
        sketched.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    reaches = depths_of(classes, docs, similarity, shingle, trees, depth, target)
    loose = components(candidate_links(classes, similarity, trees, depth, reaches)).withColumnRenamed("root", "comp")
    members = classes.drop("keys").join(loose, "node")
    found = cut(verified_links(docs, members, similarity, shingle))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.select("node", "rep", "copies").join(groups, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = cut(placed.groupBy(F.col("root").alias("comp")).agg(F.min("rep").alias("class_id")))
    info = cut(placed.join(ids, F.col("root") == F.col("comp")).select(F.col("node").alias("of"), "class_id", "copies", "links"))
    return sketched.join(info, F.col("node") == F.col("of"), "left").select(
        "doc_id",
        "mark",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def near_duplicates(
    df: DataFrame, text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL
) -> DataFrame:
    """doc_id, class_id, n_links, n_copies (long) for every row of df.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is at least `similarity`. class_id is
    the least doc_id of the component; n_links counts all documents linked with this one, copies included; n_copies those
    with an equal set, itself included. A text of fewer words than a shingle is one shingle. A text without words (null or
    empty included) and a row of null doc_id have no links and a class of their own. A repeated row is a document of its
    own. Only doc_id and `text` are read. An empty df gives an empty result.
    """
    return _classified(df, text, similarity, shingle, trees, depth, target).drop("mark")


def keep_one(df: DataFrame, **options) -> DataFrame:
    """df with one document of each class: the one whose doc_id names it. Of repeated rows of it, one stays.

    Documents of null doc_id or without words all stay. A doc_id on rows of different texts names each of them alone: one
    that goes takes no other along. Columns are those of df.
    """
    lost, mark, own = own_name(df, "__gone"), own_name(df, "__hash"), own_name(df, "__own")
    text = F.xxhash64(F.col(options.get("text", "text")).cast("string"))
    gone = _classified(df, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(lost), F.col("mark").alias(mark)).distinct()
    left = df.join(gone, (F.col("doc_id").cast("long") == F.col(lost)) & (text == F.col(mark)), "left_anti")
    # A repeated row shares doc_id and text; a null doc_id names no document, so such rows each have a key of their own.
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return left.withColumn(mark, text).withColumn(own, alone).dropDuplicates(["doc_id", mark, own]).drop(mark, own)


def sql(similarity: float = SIMILARITY, shingle: int = SHINGLE) -> str:
    """The same over `documents` of distinct doc_ids in DuckDB's SQL: all pairs that share a shingle, so for small tables."""
    return rf"""
with recursive words as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= {shingle} then list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i+{shingle - 1}], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from words),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as materialized (
  select a, b, c = x.n and c = y.n as equal from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= {similarity} * (x.n + y.n - c) - 1e-9),
reached(node, root) as (select doc_id, doc_id from documents union select l.b, r.root from reached r join links l on l.a = r.node),
classes as (select node, min(root) class_id from reached group by node)
select c.node doc_id, c.class_id, count(l.b) n_links, 1 + count(l.b) filter (where l.equal) n_copies from classes c left join links l on l.a = c.node group by c.node, c.class_id
"""
