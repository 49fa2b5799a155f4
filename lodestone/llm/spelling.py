"""Spelling variants by full neighbourhood generation.

Every word emits all distinct strings at one deletion, replacement or insertion over the letters that words use;
those that are words themselves are found by a hash join with the vocabulary, and no distance is ever computed.

A word of n letters over an alphabet of 50 has some 100 n neighbours, so they are made as hashes, in numpy: a
polynomial over the letters' values gives every neighbour's hash from sums over what stands before and behind the
edit. Of them only those go on that pass a bit filter of the vocabulary (FILTER_BITS at most, whatever its size);
they carry 128 bits of hash, on which the join is made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN = re.compile("[a-zÀ-ÿ]+")
FILTER_BITS = 26  # 8 MB, as 2 ** FILTER_BITS bits
POSITIONS = 1 << 15  # letters whose neighbours are made at once
_LONG_TEXT = 1 << 22
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEEDS = (0x165667B19E3779F9, 0x27D4EB2F165667C5)
_LENGTH = 0xD6E8FEB86659FD93


def _runs(text: str):
    """Counts of the runs of a lower-cased text; a very long one is read piece by piece."""
    if len(text) <= _LONG_TEXT:
        return Counter(RUN.findall(text))
    return Counter(m.group() for m in RUN.finditer(text))


def vocabulary(docs: DataFrame, least_length: int = 7, least_n: int = 2, one_in: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, where one run in one_in has lost a letter, as its crc32 says."""
    import pyarrow as pa

    def counted(batches):
        total: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                # lower() on bytes touches A-Z alone
                runs = _runs(text.as_py().lower().decode("utf-8"))
                given = doc_id.as_py()
                before = zlib.crc32(f"{'' if given is None else given}:".encode())
                for run, n in runs.items():
                    if len(run) < least_length:
                        continue
                    h = zlib.crc32(run.encode(), before)
                    if h % one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
                if len(total) > 200_000:
                    yield rows()
        if total:
            yield rows()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, where each word begins, with the end)."""
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=ends[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64), ends


class _Hasher:
    """The polynomial hash of one base over the letters of many words, and of their neighbours."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray, which: int):
        self.base, self.seed = _BASES[which] | 1, _SEEDS[which]
        n = len(letters)
        power = np.full(n + 2, self.base, np.uint64)
        power[:1] = 1
        self.power = np.multiply.accumulate(power)
        back = np.full(n + 2, pow(self.base, -1, 1 << 64), np.uint64)
        back[:1] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value(letters) * self.power[:n], out=self.sums[1:])
        self.ends = ends

    def value(self, letters: np.ndarray) -> np.ndarray:
        return C.mix64(letters.astype(np.uint64) + np.uint64(self.seed))

    @staticmethod
    def done(total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return C.mix64(total + length.astype(np.uint64) * np.uint64(_LENGTH))

    def words(self) -> np.ndarray:
        s, e = self.ends[:-1], self.ends[1:]
        return self.done((self.sums[e] - self.sums[s]) * self.back[s], e - s)

    def deleted(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of each word without the letter at the (global) place at."""
        s, e = self.ends[word], self.ends[word + 1]
        rest = (self.sums[e] - self.sums[at + 1]) * self.back[1]
        return self.done((self.sums[at] - self.sums[s] + rest) * self.back[s], e - s - 1)

    def replaced(self, word: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The same with a letter of that value there; value may be a row of all letters."""
        s, e = self.ends[word], self.ends[word + 1]
        rest = (self.sums[at] - self.sums[s] + self.sums[e] - self.sums[at + 1]) * self.back[s]
        return self.done(_add(rest, self.power[at - s], value), _like(e - s, value))

    def inserted(self, word: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The same with one letter more in front of the place at, which may be the word's end."""
        s, e = self.ends[word], self.ends[word + 1]
        rest = (self.sums[at] - self.sums[s] + (self.sums[e] - self.sums[at]) * self.power[1]) * self.back[s]
        return self.done(_add(rest, self.power[at - s], value), _like(e - s + 1, value))


def _add(rest, power, value):
    return rest[:, None] + power[:, None] * value if value.ndim == 2 else rest + power * value


def _like(length, value):
    return length[:, None] if value.ndim == 2 else length


def neighbours(words: list[str], alphabet: np.ndarray, passes):
    """Chunks of (word number, first hash, second hash) of all distinct neighbours that passes(first hash) lets through."""
    letters, ends = _letters(words)
    one, two = _Hasher(letters, ends, 0), _Hasher(letters, ends, 1)
    every = (one.value(alphabet)[None, :], two.value(alphabet))
    for low in range(0, len(letters), POSITIONS):
        at = np.arange(low, min(len(letters), low + POSITIONS))
        word = np.searchsorted(ends, at, "right") - 1
        first = at == ends[word]
        previous = np.where(first, np.uint64(0), letters[at - 1])
        # of a run of equal letters one deletion, and one insertion of that letter, in front
        own = at[letters[at] != previous]
        w = word[letters[at] != previous]
        h = one.deleted(w, own)
        hit = passes(h)
        yield w[hit], h[hit], two.deleted(w[hit], own[hit])
        h = one.replaced(word, at, every[0])
        r, c = np.nonzero((alphabet[None, :] != letters[at][:, None]) & passes(h))
        yield word[r], h[r, c], two.replaced(word[r], at[r], every[1][c])
        h = one.inserted(word, at, every[0])
        r, c = np.nonzero((alphabet[None, :] != previous[:, None]) & passes(h))
        yield word[r], h[r, c], two.inserted(word[r], at[r], every[1][c])
        # behind the last letter
        last = at + 1 == ends[word + 1]
        word, at = word[last], at[last] + 1
        h = one.inserted(word, at, every[0])
        r, c = np.nonzero((alphabet[None, :] != letters[at - 1][:, None]) & passes(h))
        yield word[r], h[r, c], two.inserted(word[r], at[r], every[1][c])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _filter(hashed: DataFrame, bits: int) -> np.ndarray:
    """Two bits a word, set in 64-bit words; the driver gets 2 ** (bits - 6) rows at most."""
    mask = F.lit((1 << bits) - 1)
    places = F.explode(F.array(F.col("h1").bitwiseAND(mask), F.call_function("shiftrightunsigned", "h1", F.lit(32)).bitwiseAND(mask)))
    slots = hashed.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    table = slots.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Given (word, n) with each word once: these with h1 and h2, as a table, and (h1, h2, near, near_n) of all near pairs, both ways."""
    import pyarrow as pa

    spark = words.sparkSession

    def hashes(batches):
        for batch in batches:
            letters, ends = _letters(batch.column(0).to_pylist())
            h = [pa.array(_signed(_Hasher(letters, ends, i).words())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *h], names=["word", "n", "h1", "h2"])

    hashed = C.materialise(words.mapInArrow(hashes, "word string, n long, h1 long, h2 long"), "vocabulary")
    # at most the 90 letters of the class
    alphabet = np.array(sorted(ord(r[0]) for r in hashed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()), np.uint64)
    bits = int(min(FILTER_BITS, max(10, (16 * max(1, hashed.count())).bit_length())))
    held = spark.sparkContext.broadcast(_filter(hashed, bits))

    def emitted(batches):
        table = held.value

        def passes(h):
            low, high = _probes(h.ravel(), bits)
            held_at = lambda p: (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
            some = np.flatnonzero(held_at(low))
            out = np.zeros(h.size, bool)
            out[some[held_at(high[some])]] = True
            return out.reshape(h.shape)

        for batch in batches:
            own = [batch.column(c).to_numpy() for c in (1, 2)]
            for word, h1, h2 in neighbours(batch.column(0).to_pylist(), alphabet, passes):
                if len(word):
                    yield pa.RecordBatch.from_arrays([pa.array(own[0][word]), pa.array(own[1][word]), pa.array(_signed(h1)), pa.array(_signed(h2))], names=["s1", "s2", "h1", "h2"])

    # the table has few files, as words are few beside texts; neighbours are what takes time
    dealt = hashed.select("word", "h1", "h2").repartition(C.partitions(spark))
    found = dealt.mapInArrow(emitted, "s1 long, s2 long, h1 long, h2 long")
    met = found.join(hashed.select("h1", "h2", F.col("word").alias("near"), F.col("n").alias("near_n")), ["h1", "h2"])
    pairs = met.select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), "near", "near_n")
    return hashed, pairs


def spelling_groups(docs: DataFrame, ratio: int = 10, **kw) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ratio times
    its own. Null texts have no words; a row without an id counts with an empty one; repeated rows count each. Other
    columns play no part. An empty table gives an empty result. Words of any length take part.
    """
    hashed, pairs = near_words(vocabulary(docs, **kw))
    # the smallest of (-n, word) is the near word of largest n
    best = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    forms = hashed.join(best, ["h1", "h2"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= ratio * F.col("n"), F.struct(F.col("b.near").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f"))
    forms = C.materialise(forms.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    # n grows ratio-fold along a chain, so it has no cycle and log(n) steps at most; each round doubles what is done
    links = C.materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = C.materialise(links.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        C.drop_scratch(links)
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
