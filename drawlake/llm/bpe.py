"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each pretoken starts as its bytes. A leaf of the tree holds, for the pair that starts at that place, the pair's merge rank
and the place itself; an inner node holds the least of its two children. So the root is the leftmost pair of lowest rank.
Merging it changes three leaves, and each costs one walk to the root: n log n for a pretoken of n bytes, however long.
Pretokens of up to 64 bytes run many at a time, one row of a matrix each; longer ones run alone on the same tree.

Vocabulary: a `tokenizers` JSON file with a byte-level BPE model. The driver reads it and broadcasts it; its size does not
depend on the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.llm.common import drop_if_there, own_name, ship, tidy

# The split of byte-level BPE into pretokens. Spaces are those with the White_Space property.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

WIDEST = 64  # bytes of a pretoken that still runs in the matrix
CACHED = 200_000  # pretokens whose ids a task remembers; a matter of speed only
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable Latin-1, else the next free code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Merge table and token bytes, ready to broadcast."""

    byte_ids: np.ndarray  # id of each single byte
    pairs: np.ndarray  # left << 32 | right, ascending
    ranks: np.ndarray  # rank of the pair at the same index
    merged: np.ndarray  # id that the merge of a rank makes
    token_bytes: list[bytes]
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path} holds a {model['type']} model, not BPE")
        of = byte_alphabet()
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        token_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            token_bytes[i] = bytes(of[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        byte_ids = np.zeros(256, np.int64)
        for c, b in of.items():
            byte_ids[b] = ids[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(byte_ids, keys[order], order.astype(np.int64), merged, token_bytes, special)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no merge exists."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)


def merge_rows(words: list[bytes], width: int, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and how many each has. All words have 1 to `width` bytes, `width` a power of
    two: one segment tree per row of a matrix."""
    n, shift = len(words), width.bit_length() - 1
    sizes = np.fromiter(map(len, words), np.int64, n)
    place = np.arange(width)
    there = place < sizes[:, None]
    token = np.zeros((n, width + 1), np.int64)
    token[:, :width][there] = voc.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after = np.broadcast_to(place + 1, (n, width)).copy()
    before = np.broadcast_to(np.arange(width + 1) - 1, (n, width + 1)).copy()
    alive = there.copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    pairs = place + 1 < sizes[:, None]
    rank = voc.rank_of(token[:, :width][pairs], token[:, 1 : width + 1][pairs])
    tree[:, width:][pairs] = np.where(rank == NONE, NONE, rank << shift | np.broadcast_to(place, (n, width))[pairs])
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(rows: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = key
        for _ in range(shift):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def key_at(rows: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Key of the pair of the symbols at two places; NONE if the right one is past the word's end."""
        rank = voc.rank_of(token[rows, at], token[rows, np.minimum(right, width)])
        return np.where((rank == NONE) | (right >= sizes[rows]), NONE, rank << shift | at)

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & (width - 1)
        gone = after[rows, at]
        token[rows, at] = voc.merged[root >> shift]
        right = after[rows, gone]
        after[rows, at] = right
        before[rows, right] = at
        alive[rows, gone] = False
        put(rows, gone, np.full(len(rows), NONE))
        put(rows, at, key_at(rows, at, right))
        left = before[rows, at]
        has = left >= 0
        put(rows[has], left[has], key_at(rows[has], left[has], at[has]))
        rows = rows[tree[rows, 1] != NONE]
    return token[:, :width][alive], alive.sum(1)


def merge_one(word: bytes, voc: Vocabulary, ranks: dict[int, int]) -> tuple[int, ...]:
    """Ids of one word of any length on its own segment tree. ranks: pair key -> rank."""
    n = len(word)
    token = voc.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    width = 1 << max(1, (n - 1).bit_length())
    shift = width.bit_length() - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = 1 << 62
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if (r := ranks.get(token[i] << 32 | token[i + 1])) is not None:
            tree[width + i] = r << shift | i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, key: int) -> None:
        node = leaf + width
        tree[node] = key
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least

    def key_at(left: int, right: int) -> int:
        if left < 0 or right >= n or (r := ranks.get(token[left] << 32 | token[right])) is None:
            return none
        return r << shift | left

    while tree[1] != none:
        at = tree[1] & (width - 1)
        gone = after[at]
        token[at] = int(voc.merged[tree[1] >> shift])
        token[gone] = -1
        right = after[gone]
        after[at] = right
        if right < n:
            before[right] = at
        put(gone, none)
        put(at, key_at(at, right))
        if before[at] >= 0:
            put(before[at], key_at(before[at], at))
    return tuple(t for t in token if t >= 0)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then the same for each further entry."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class _Numbers(dict):
    """Pretoken -> its number, given at first sight."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Text to ids, in one process. Remembers the ids of pretokens it has met."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.split = regex.compile(PRETOKENS)
        names = sorted(voc.special, key=lambda s: (-len(s), s))
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.ranks: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.begin, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def pretokens(self, text: str) -> list[str]:
        """Special tokens as they stand; what lies between them split as PRETOKENS says."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out, i = [], 0
        for m in self.special.finditer(text):
            out += self.split.findall(text[i : m.start()])
            out.append(m.group())
            i = m.end()
        return out + self.split.findall(text[i:])

    def _store(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[numbers] = self.used + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, words: list[str], first: int) -> None:
        """Store the ids of the words numbered from `first` on."""
        while first + len(words) > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, self.begin]), np.concatenate([self.count, self.count])
        raw = [w.encode() for w in words]
        special = self.voc.special
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            width = -1 if words[i] in special else 0 if len(b) > WIDEST else max(2, 1 << (len(b) - 1).bit_length())
            by_width.setdefault(width, []).append(i)
        for width, at in by_width.items():
            if width > 0:
                for a in range(0, len(at), 1 << 14):
                    part = at[a : a + (1 << 14)]
                    self._store(first + np.array(part), *merge_rows([raw[i] for i in part], width, self.voc))
                continue
            for i in at:
                if width < 0:
                    ids: tuple[int, ...] = (special[words[i]],)
                else:
                    if self.ranks is None:
                        self.ranks = dict(zip(self.voc.pairs.tolist(), self.voc.ranks.tolist(), strict=True))
                    ids = merge_one(raw[i], self.voc, self.ranks)
                self._store(np.array([first + i]), np.array(ids, np.int32), np.array([len(ids)]))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin."""
        if len(self.numbers) > CACHED:
            self.forget()
        split = [self.pretokens(t or "") for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        first = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self._learn(self.numbers.fresh, first)
        self.numbers.fresh.clear()
        count = self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.ids[spread(self.begin[at], count)], ends

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Decoder:
    """Ids to text, in one process. Special tokens stay; bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary vanish."""

    def __init__(self, token_bytes: list[bytes]):
        self.size = len(token_bytes)
        self.count = np.array([*map(len, token_bytes), 0], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        count = self.count[known]
        raw = self.bytes[spread(self.begin[known], count)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(count)])[ends]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` characters or more only as a single row."""
    start, held, i = 0, 0, 0
    for i, s in enumerate(sizes, 1):
        if i - 1 > start and held + s > most:
            yield start, i - 1
            start, held = i - 1, 0
        held += s
    if i > start:
        yield start, i


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) plus the token ids of `text` as ids array<int>, null text as empty.

    Whole texts of any length; an empty text has no ids. Rows are independent, so there is no shuffle. A column of df that
    is already called `ids` is replaced. An empty df gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    rest = [c for c in (df.columns if keep is None else keep) if c.lower() != ids.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(own_name(df, "__text")))
    names = [f"c{i}" for i in range(len(rest))]  # mapInArrow finds columns by name, so names are plain and distinct
    source = source.toDF(*names, "text")
    schema = T.StructType([*[source.schema[i] for i in range(len(rest))], T.StructField("ids", T.ArrayType(T.IntegerType(), False), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(len(rest))
            texts = column.to_pylist()
            for a, b in _slices((len(t or "") for t in texts), 1 << 21):
                flat, ends = encoder.encode_flat(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], lists], names=[*names, "ids"])

    return source.mapInArrow(tidy(run), schema).toDF(*rest, ids)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df plus the text that `ids` stand for, special tokens included; null ids give an empty text, an empty df an empty result.

    Other columns pass through, whatever their names; one that is called like `text` is replaced.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary).token_bytes)
    source = drop_if_there(df, text)
    rest = source.columns
    at, names = rest.index(ids), [f"c{i}" for i in range(len(rest))]
    source = source.toDF(*names)
    schema = T.StructType([*source.schema.fields, T.StructField("text", T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(at)
            sizes = (s or 0 for s in lists.value_lengths().to_pylist())
            for a, b in _slices(sizes, 1 << 19):
                part = batch.slice(a, b - a)
                own = part.column(at)
                ends = np.concatenate([[0], np.cumsum(own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                out = decoder.decode_flat(own.flatten().to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*names, "text"])

    return source.mapInArrow(tidy(run), schema).toDF(*rest, text)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) plus ids and decoded, as decode(encode(df)) has them, in one pass and one worker a task.

    Two passes in one stage would hold two workers with the vocabulary for each task. Odd rows as in encode() and decode().
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    rest = [c for c in (df.columns if keep is None else keep) if c.lower() not in (ids.lower(), decoded.lower())]
    names = [f"c{i}" for i in range(len(rest))]
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))
    fields = [*[source.schema[n] for n in names], T.StructField("ids", T.ArrayType(T.IntegerType(), False), True), T.StructField("decoded", T.StringType(), True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value.token_bytes)
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            for a, b in _slices((len(t or "") for t in texts), 1 << 20):
                flat, ends = encoder.encode_flat(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                back = pa.array(decoder.decode_flat(flat, ends), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], lists, back], names=[*names, "ids", "decoded"])

    return source.mapInArrow(tidy(run), T.StructType(fields)).toDF(*rest, ids, decoded)


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of a table of documents, by encoding and decoding it.

    Null texts are empty and have no ids; a null doc_id stays null; repeated rows give repeated results; an empty table
    none. Only doc_id and text are read.
    """
    coded = round_trip(df, vocabulary, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
