"""Benchmark decontamination by suffix arrays over the training text.

Words are runs of [0-9a-z] and of anything outside ASCII, after A-Z are lower-cased. Each shard of documents
(some million words, read in one go by a task) is turned into word ids of the benchmark's vocabulary; words
outside it part the text, and runs too short for any window drop out, as nothing there can match. A suffix
array over the rest is searched for every suffix of every item: the range that begins with a window gives
all places of it, and the common prefix there the longest verbatim match.

The items travel in blocks of at most block_bytes of text, one pass over the documents for each, so what is
sent to the executors has a fixed bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import suffix

SHARD_WORDS = 1_000_000
NO_ID = -(1 << 63)  # stands for an item without an id: its windows count, but it's not in the lists of items
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class Items:
    """A block of items, ready to be searched for: vocabulary, windows, and the suffixes behind them."""

    def __init__(self, rows: list[tuple[int, str | None]], window: int):
        self.window, self.vocab = window, {}
        texts = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)]) for i, t in rows]
        texts = [(i, w) for i, w in texts if w]
        self.longest = max((len(w) for _, w in texts), default=0)
        self.shortest = min((min(len(w), window) for _, w in texts), default=0)
        suffixes: dict[tuple, list[tuple[int, tuple]]] = {}
        for i, w in texts:
            for p in range(max(1, len(w) - window + 1)):
                suffixes.setdefault(tuple(w[p : p + window]), []).append((i, tuple(w[p:])))
        keys = sorted(suffixes)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.query = np.zeros((len(keys), window), np.int64)
        for r, k in enumerate(keys):
            self.query[r, : len(k)] = k
        self.owners = [np.array(sorted({i for i, _ in suffixes[k]}), np.int64) for k in keys]
        self.tails = [list({t: i for i, t in sorted(suffixes[k], reverse=True)}.items()) for k in keys]


def item_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[Items]:
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if held and size + len(row[1] or "") > block_bytes:
            yield Items(held, window)
            held, size = [], 0
        held.append((NO_ID if row[0] is None else row[0], row[1]))
        size += len(row[1] or "")
    if held:
        yield Items(held, window)


def search_shard(docs: list[bytes], items: Items) -> list[tuple[int, list[int], list[int], tuple[int, int, int]]]:
    """For each document: its words, spans [start, end, start, end, ...] of words hit, items, longest match."""
    get = items.vocab.get
    parts, sizes = [], []
    for d in docs:
        w = words(d)
        sizes.append(len(w))
        parts += map(get, w, [0] * len(w))
        parts.append(0)
    ids = np.array(parts, np.int32)
    sizes = np.array(sizes, np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    out = [(int(n), [], [], (0, -1, -1)) for n in sizes]
    if not len(items.query) or not len(ids):
        return out
    known = ids > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    long_ = hi - lo >= items.shortest
    lo, hi = lo[long_], hi[long_]
    if not len(lo):
        return out
    # each run and the unknown word behind it, which stands between runs
    size = hi - lo + 1
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    text = ids[place]
    sa, _ = suffix.suffix_array(text, items.window)
    a, b = suffix.search(text, sa, items.query, items.length)
    found = np.flatnonzero(b > a)
    if not len(found):
        return out
    count = (b - a)[found]
    which = np.repeat(found, count)
    at_text = sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a[found], count)]
    at = place[at_text]
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + items.length[which], -1)
    hit = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    doc_of = lambda x: np.searchsorted(first, x, "right") - 1
    spans = edge.reshape(-1, 2)
    for d, (s, e) in zip(doc_of(spans[:, 0]).tolist(), spans.tolist(), strict=True):
        out[d][1].extend((s - int(first[d]), e - int(first[d])))
    pairs = np.unique(np.stack([doc_of(at), which]), axis=1)
    owners: dict[int, set[int]] = {}
    for d, q in pairs.T.tolist():
        owners.setdefault(d, set()).update(items.owners[q].tolist())
    for d, own in owners.items():
        out[d][2].extend(sorted(own))
    # the longest match: how far the suffixes behind each window agree with the text there
    best: dict[int, tuple[int, int, int]] = {}
    docs_at = doc_of(at)
    for q in found.tolist():
        rows = np.flatnonzero(which == q)
        for tail, item in items.tails[q]:
            tails = np.broadcast_to(np.array(tail, np.int64), (len(rows), len(tail)))
            got = suffix.common_prefix(text, at_text[rows], tails, np.full(len(rows), len(tail)))
            top = np.lexsort((at[rows], -got, docs_at[rows]))
            lead = np.ones(len(top), bool)
            lead[1:] = docs_at[rows][top][1:] != docs_at[rows][top][:-1]
            for r in top[lead].tolist():
                d = int(docs_at[rows[r]])
                new = (int(got[r]), item, int(at[rows[r]] - first[d]))
                old = best.get(d, (0, -1, -1))
                if (-new[0], new[1], new[2]) < (-old[0], old[1], old[2]):
                    best[d] = new
    return [(n, s, i, best.get(d, m)) for d, (n, s, i, m) in enumerate(out)]


_STATE = [("__n_words", "long"), ("__spans", "array<long>"), ("__items", "array<long>"), ("__longest", "array<long>")]


def _pass(docs: DataFrame, items: Items, text_col: str, first: bool) -> DataFrame:
    """docs with the state columns, for one block of items more."""
    import pyarrow as pa

    names = docs.columns if first else docs.columns[: -len(_STATE)]
    at = names.index(text_col)

    def merge(old, new):
        spans = sorted(zip(old[1][::2] + new[1][::2], old[1][1::2] + new[1][1::2], strict=True))
        flat: list[int] = []
        for s, e in spans:
            if flat and s <= flat[-1]:
                flat[-1] = max(flat[-1], e)
            else:
                flat += [s, e]
        longest = min((tuple(old[3]), tuple(new[3])), key=lambda m: (-m[0], m[1], m[2]))
        return new[0], flat, sorted({*old[2], *new[2]}), longest

    def run(batches):
        for batch in batches:
            raw, start, end = C.string_spans(batch.column(at))
            data = raw.tobytes()
            for i, j in C.byte_slices(start, end, SHARD_WORDS * 6):
                got = search_shard([data[s:e] for s, e in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)], items)
                part = batch.slice(i, j - i)
                if not first:
                    old = zip(*(part.column(len(names) + k).to_pylist() for k in range(len(_STATE))), strict=True)
                    got = [merge(o, g) for o, g in zip(old, got, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(names))]
                    + [pa.array([g[0] for g in got], pa.int64())]
                    + [pa.array([list(g[k]) for g in got], pa.list_(pa.int64())) for k in (1, 2, 3)],
                    names=[*names, *(n for n, _ in _STATE)],
                )

    schema = T.StructType([docs.schema[n] for n in names] + T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in _STATE)).fields)
    return docs.mapInArrow(run, schema)


def annotate(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """docs and, per row, __n_words, __spans (of words hit), __items, __longest (words, item, first word)."""
    out, first = docs, True
    for block in item_blocks(items, window, block_bytes):
        if not first:
            out = C.materialise(out, "searched")
        out, first = _pass(out, block, text_col, first), False
    return out if not first else _pass(out, Items([], window), text_col, True)


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items, spans of words hit, longest match and its place.

    A window is window consecutive words of an item, or a whole item of fewer words. Null texts have no words;
    empty items match nothing; an item id that repeats counts once; the windows of an item without an id count as
    any others, but it isn't among the items; each row of docs gives one row.
    """
    found = annotate(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), items, window)
    pairs = F.expr("transform(sequence(0, size(__spans) div 2 - 1), k -> struct(__spans[2 * k] as start, __spans[2 * k + 1] as end))")
    spans = F.when(F.size("__spans") > 0, pairs).otherwise(F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.filter("__items", lambda i: i != F.lit(NO_ID)).alias("items"), spans.alias("spans"), F.col("__longest")[0].alias("longest"), F.col("__longest")[1].alias("longest_item"), F.col("__longest")[2].alias("longest_at")).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.expr("transform(items, i -> cast(i as string))")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "spans",
        "longest",
        "longest_item",
        "longest_at",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no window of any item occurs, with docs's columns."""
    return annotate(docs, items, window).where("size(__spans) = 0").select(*docs.columns)
