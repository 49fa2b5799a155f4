"""Substring dedup by hashing lines, paragraphs or sentences.

Every unit is normalised (compatibility forms, case, white space, punctuation at
its ends) and hashed to 128 bits. The digests are grouped over the corpus; the occurrence that ranks first,
by document id and then by place, stays, and every other one goes, with its offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NO_ID = (1 << 63) - 1  # stands for a null id, so that rows without one rank last

_SPLIT = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*"), "sentence": re.compile(r"\n|(?<=[.!?])[^\S\n]+|(?<=[。！？])")}
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def normalise(unit: str) -> str:
    return _ENDS.sub("", " ".join((unit if unit.isascii() else unicodedata.normalize("NFKC", unit)).casefold().split()))


def n_words(plain: str) -> int:
    """Words between blanks, or a sixth of the characters where that is more, as some scripts have no blanks."""
    return max(plain.count(" ") + 1, len(plain) // 6)


def units(text: str, kind: str):
    """(start, end) of every unit, without the break behind it."""
    at = 0
    for m in _SPLIT[kind].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def passages(text: str, every: list, lost: set, min_run: int) -> set:
    """Those of the lost units that lie in runs of min_run words or more."""
    out, run, words = set(), [], 0
    for u in [*every, None]:
        plain = normalise(text[u[0] : u[1]]) if u else ""
        if u in lost:
            run.append(u)
            words += n_words(plain)
        elif plain or u is None:
            if words >= min_run:
                out.update(run)
            run, words = [], 0
    return out


def remove_repeats(docs: DataFrame, kind: str = "line", min_words: int = 1, min_run: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n_units, n_removed, n_chars (that stay), n_chars_in, spans (original offsets), text (what stays).

    Units of fewer than min_words words (see n_words), and those without a letter or digit, always stay. With min_run,
    what goes is passages: runs of units one behind the other (those without a letter or digit don't part them), each a
    later occurrence, of min_run words together; a lone heading or refrain within own text stays. A removed unit takes the break behind it along (at the
    end of the text, the break before it). Null text is empty. Equal rows of one id are one occurrence: they
    keep and lose the same units; different texts under one id rank by their place. Rows without an id rank last;
    those of the same text count as one occurrence too. An empty table gives an empty result.
    """
    import pyarrow as pa

    given = F.col("doc_id").cast("long")
    src = docs.select(given.alias("given"), F.coalesce(given, F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))

    def hashed(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                row, start, end, high, low = [], [], [], [], []
                for r, text in enumerate(part.column(2).to_pylist()):
                    for a, b in units(text, kind):
                        plain = normalise(text[a:b])
                        if plain and n_words(plain) >= min_words:
                            d = hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                            row.append(r)
                            start.append(a)
                            end.append(b)
                            high.append(int.from_bytes(d[:8], "big", signed=True))
                            low.append(int.from_bytes(d[8:], "big", signed=True))
                take = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(x, pa.int64()) for x in (start, end, high, low))], names=["doc_id", "sig", "start", "end", "high", "low"])

    found = C.materialise(src.select("doc_id", "sig", "text").mapInArrow(hashed, "doc_id long, sig long, start long, end long, high long, low long"), "units")
    place = F.struct("doc_id", "start", "sig")
    # a table of its own, so that the join below has a shuffle on both sides and a common unit's rows can be split
    first = C.materialise(found.groupBy("high", "low").agg(F.min(place).alias("keep"), F.max(place).alias("last")).where("keep <> last").drop("last"), "units-first")
    gone = (
        found.join(first, ["high", "low"])
        .where(F.struct("doc_id", "start", "sig") != F.col("keep"))
        .groupBy("doc_id", "sig")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone"))
    )

    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, out = batch.slice(i, 500), []
                for text, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lost = {(g["start"], g["end"]) for g in drop or []}
                    every = list(units(text, kind))
                    if min_run > 1 and lost:
                        lost = passages(text, every, lost, min_run)
                    cut = [[a, b] for a, b in every if (a, b) in lost]
                    # a unit goes with the break behind it, up to where the next begins
                    stop = [a for a, _ in every[1:]] + [len(text)]
                    kept = [(a, b, e) for (a, b), e in zip(every, stop, strict=True) if (a, b) not in lost]
                    body = "".join(text[a:e] for a, _, e in kept)
                    if kept and every[-1] in lost:
                        body = body[: len(body) - (kept[-1][2] - kept[-1][1])]
                    out.append((len(every) if text else 0, len(cut), len(body), len(text), cut, body))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.list_(pa.int64()))), pa.array(cols[5], pa.string())],
                    names=["doc_id", "n_units", "n_removed", "n_chars", "n_chars_in", "spans", "text"],
                )

    return src.join(gone, ["doc_id", "sig"], "left").select(F.col("given").alias("doc_id"), "text", "gone").mapInArrow(
        apply, "doc_id long, n_units long, n_removed long, n_chars long, n_chars_in long, spans array<array<long>>, text string"
    )
