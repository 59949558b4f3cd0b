"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

The benchmark is the query set. It is read in blocks of bounded size; a block's word hashes are broadcast, and one scan of
the documents counts in how many of them each n-gram of the block stands, a second one looks the rarest n-grams of every
item up and aligns the passages around them with the item. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm import words as W
from drawlake.llm.common import ship, tidy

GRAM = 3  # words of a seed
SHARE, LEAST = 0.5, 12  # of an item's n-grams, the rarest share are seeds, and no fewer than LEAST
HITS = 2  # seeds that a passage must hold, or all that an item has
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
THRESHOLD = 0.5  # of the score that the whole item would reach
BLOCK_WORDS = 250_000  # benchmark words that one pass broadcasts


@dataclass
class Seeds:
    """A block of items: their words, and seeds (ascending) with the items and places that each stands at."""

    item_ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray  # of each seed, where its entries begin; one more than seeds
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray  # hits that a passage of the item needs


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Item ids and word hashes, about block_words at a time; items without words are left out."""
    ids, items, held = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        found, _ = W.hashes([row["text"]])
        if not len(found):
            continue
        if ids and held + len(found) > block_words:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row["item_id"])
        items.append(found)
        held += len(found)
    if ids:
        yield ids, items


def _grams_of(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = [W.grams(w, GRAM) for w in items]
    return np.concatenate(grams), np.repeat(np.arange(len(items)), [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])


def _short(items: list[np.ndarray]) -> bool:
    return any(len(w) < GRAM for w in items)


def _doc_grams(words: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes of a document and the words they start at. Items shorter than a gram are looked up by their whole length."""
    out = [W.grams(words, GRAM)] if len(words) >= GRAM else []
    at = [np.arange(len(out[0]))] if out else []
    if short:
        for k in range(1, GRAM):
            if len(words) >= k:
                out.append(W.grams(words, k))
                at.append(np.arange(len(words) - k + 1))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def _lookup(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values occur in sorted_keys: positions in values, positions in sorted_keys."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == values)
    return hit, at[hit]


def document_frequency(docs: DataFrame, keys: np.ndarray, short: bool, text: str) -> np.ndarray:
    """In how many documents each key (ascending gram hashes) stands: counted per task, summed, one number per key returned."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        count = np.zeros(len(keys), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 256):
                found, at = W.hashes(texts[a : a + 256])
                for i, j in zip(at[:-1], at[1:], strict=True):
                    _, which = _lookup(keys, _doc_grams(found[i:j], short)[0])
                    count[np.unique(which)] += 1
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own])], names=["key", "n"])

    summed = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys), np.int64)
    out[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
    return out


def rare_seeds(docs: DataFrame, ids: list, items: list[np.ndarray], text: str) -> Seeds:
    gram, item, place = _grams_of(items)
    keys = np.unique(gram)
    frequency = document_frequency(docs, keys, _short(items), text)[np.searchsorted(keys, gram)]
    order = np.lexsort((place, frequency, item))
    sizes = np.bincount(item, minlength=len(items))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    quota = np.minimum(sizes, np.maximum(LEAST, np.ceil(SHARE * sizes).astype(np.int64)))
    kept = order[rank < quota[item[order]]]
    kept = kept[np.argsort(gram[kept], kind="stable")]
    seeds, first = np.unique(gram[kept], return_index=True)
    return Seeds(ids, items, seeds, np.append(first, len(kept)), item[kept], place[kept], np.minimum(HITS, quota))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences (Smith-Waterman, linear gaps) and where in the passage it ends."""
    best, end = 0.0, 0
    before = np.zeros(len(passage) + 1)
    slope = -GAP * np.arange(len(passage) + 1)
    for w in item:
        row = np.zeros(len(passage) + 1)
        row[1:] = np.maximum(before[:-1] + np.where(passage == w, MATCH, MISMATCH), before[1:] + GAP)
        row = np.maximum.accumulate(np.maximum(row, 0) + slope) - slope  # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
        before = row
    return best, end


def leaks_of(words: np.ndarray, seeds: Seeds, short: bool, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item, score, first word, end word, seeds hit) of each item that the document holds: its best passage."""
    gram, start = _doc_grams(words, short)
    hit, which = _lookup(seeds.seeds, gram)
    if not len(hit):
        return []
    from_, count = seeds.first[which], seeds.first[which + 1] - seeds.first[which]
    entry = np.repeat(from_ - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    item, diagonal = seeds.item[entry], np.repeat(start[hit], count) - seeds.place[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal, entry = item[order], diagonal[order], entry[order]
    out: dict[int, tuple[int, float, int, int, int]] = {}
    size = np.array([len(seeds.items[i]) for i in item])
    new = np.ones(len(item), bool)  # a passage ends where the next diagonal is more than half an item away
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[1:] // 2 + 1)
    bounds = np.append(np.flatnonzero(new), len(item))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i = int(item[a])
        if b - a < seeds.need[i] or len(np.unique(entry[a:b])) < seeds.need[i]:
            continue
        n = len(seeds.items[i])
        low, high = max(0, int(diagonal[a]) - n // 2 - 1), min(len(words), int(diagonal[b - 1]) + n + n // 2 + 1)
        value, end = align(seeds.items[i], words[low:high])
        value /= MATCH * n
        if value >= threshold and (i not in out or value > out[i][1]):
            out[i] = (i, value, max(low, low + end - n), low + end, int(b - a))
    return list(out.values())


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score (double, 0 to 1), start, stop (int, words), seeds (int): a row per document and item it holds.

    Score: the best alignment of the item with a passage of the document, over that of the item with itself. Words compare
    lower-cased and without punctuation. Null and empty texts, of documents or items, hold and match nothing; an item
    shorter than a seed is looked up whole; a null doc_id is reported as null. A repeated document or item gives repeated
    rows. Nothing but doc_id and the text is read of docs. An empty benchmark or empty docs give no rows.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, start int, stop int, seeds int"
    out = None
    for ids, items in blocks_of(benchmark, block_words):
        block = docs.sparkSession.sparkContext.broadcast((rare_seeds(docs, ids, items, text), _short(items)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds, short = block.value
            for batch in batches:
                rows = []
                names = batch.column(0).to_pylist()
                for a in range(0, len(names), 256):
                    found, at = W.hashes(batch.column(1).slice(a, 256).to_pylist())
                    for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        for leak in leaks_of(found[i:j], seeds, short, threshold):
                            rows.append((names[a + k], seeds.item_ids[leak[0]], *leak[1:]))
                if rows:
                    d, i, s, x, y, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(n, pa.int32())],
                        names=["doc_id", "item_id", "score", "start", "stop", "seeds"],
                    )

        part = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold an item, by the same rule as `leaks`; all columns as they are, whatever their names.

    Null and empty texts stay; repeated rows go or stay together; an empty benchmark drops nothing. No shuffle.
    """
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]  # mapInArrow finds columns by name, so names are plain and distinct
    out = docs.toDF(*names)
    at, schema = docs.columns.index(text), out.schema
    for ids, items in blocks_of(benchmark, block_words):
        block = docs.sparkSession.sparkContext.broadcast((rare_seeds(docs, ids, items, text), _short(items)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds, short = block.value
            for batch in batches:
                clean = []
                column = batch.column(at).cast(pa.string())
                for a in range(0, batch.num_rows, 256):
                    found, cuts = W.hashes(column.slice(a, 256).to_pylist())
                    clean += [not leaks_of(found[i:j], seeds, short, threshold) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(tidy(run), schema)
    return out.toDF(*docs.columns)
