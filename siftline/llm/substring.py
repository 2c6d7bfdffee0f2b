"""Substring dedup: repeated word windows by level-wise doubling."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from . import kernel, packed

ADDED = ("n_words", "n_removed", "kept")


class Windows:
    """The windows of one run of documents and what stands for them at each length.

    A window's anchor is its least-hashed run of a quarter of its words (the
    leftmost, of equals): equal windows have equal anchors at the same place.
    Around it lies a run of half the words, to the right where the window
    reaches far enough and else to the left, which they share as well.
    """

    def __init__(self, hasher, buf, offsets, length: int):
        self.length, self.quarter, self.half = length, -(-length // 4), -(-length // 2)
        self.starts, self.ends, self.docs = hasher.split(buf, offsets)
        words = hasher.hash_spans(buf, self.starts, self.ends)
        self.whole = hasher.ngrams(words, length)
        n = len(self.whole)
        self.valid = self.docs[:n] == self.docs[length - 1 :] if n else np.zeros(0, bool)
        self.quarters, self.halves = hasher.ngrams(words, self.quarter), hasher.ngrams(words, self.half)
        span = length - self.quarter + 1
        low = np.uint64((1 << max(1, len(words).bit_length())) - 1)
        least = (self.quarters & ~low) | np.arange(len(self.quarters), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            least, step = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0], 2 * step
        if span > step:
            least = np.minimum(least[: -(span - step)], least[span - step :]) if len(least) > span - step else least[:0]
        self.anchor = (least[:n] & low).astype(np.int64)
        right = self.anchor + self.half <= np.arange(n) + length
        self.middle = np.where(right, self.anchor, self.anchor - (self.half - self.quarter))


def repeated(layout, totals, hashes, at):
    """Which of ``at`` hold hashes that the corpus has at two places or more; ``at`` may repeat."""
    places, back = np.unique(at, return_inverse=True)
    keys, inverse, counts = np.unique(layout.cut(hashes[places]), return_inverse=True, return_counts=True)
    return (totals.of(keys, counts) > 1)[inverse][back]


def substring_dedup(docs: DataFrame, text: str = "text", length: int = 35) -> DataFrame:
    """Remove every word that a repeated window of ``length`` words covers.

    Words are the runs of bytes outside ``\\x20\\x09-\\x0D``, unchanged.  A
    window repeats if its word sequence starts at another place of the corpus,
    in the same document or elsewhere; all of its occurrences go, judged on the
    input.  Levels double: runs of a quarter of the length are counted first
    (one for each window, see Windows); only windows whose run repeats are
    extended to half the length, and of those only the repeated to the whole,
    where the doubling ends, as longer repeats cover no more words.

    Adds n_words, n_removed and kept (kept words joined by one space; null for
    a null text) to the columns of ``docs``, replacing columns so named.  Null
    and blank texts have no words; repeated rows repeat all their windows.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    docs = docs.select(*(f"`{f.name}`" for f in kept))
    blocked, block, layout = packed.in_blocks(docs, text, 0.06)

    def views(table):
        hasher = kernel.Hasher()
        for lo, buf, offsets in kernel.chunks(table.column(text)):
            yield lo, buf, offsets, Windows(hasher, buf, offsets, length)

    def over_block(table, pick):
        """Hashes and their places over all runs of a block; places of runs don't meet."""
        parts = [np.zeros(0, np.uint64), *(pick(v) for *_, v in views(table))]
        return np.concatenate(parts)

    def surviving(table, totals, level):
        """(run, windows whose level repeats) of a block; a level counts places once."""
        held = list(views(table))
        take = {"quarters": lambda v: v.anchor, "halves": lambda v: v.middle}[level]
        at, hashes, base = [], [], 0
        for *_, v in held:
            source = getattr(v, level)
            at.append(take(v)[v.valid] + base)
            hashes.append(source)
            base += len(source)
        if not base:
            return [(v, np.zeros(0, np.int64)) for *_, v in held]
        flags = repeated(layout, totals, np.concatenate(hashes), np.concatenate(at))
        out, lo = [], 0
        for (*_, v), a in zip(held, at):
            out.append((v, np.flatnonzero(v.valid)[flags[lo : lo + len(a)]]))
            lo += len(a)
        return out

    def quarters(table, _):
        return over_block(table, lambda v: v.quarters[np.unique(v.anchor[v.valid])])

    def halves(table, totals):
        return np.concatenate([np.zeros(0, np.uint64), *(v.halves[np.unique(v.middle[w])] for v, w in surviving(table, totals, "quarters"))])

    def wholes(table, totals):
        return np.concatenate([np.zeros(0, np.uint64), *(v.whole[w] for v, w in surviving(table, totals, "halves"))])

    schema = StructType(list(kept)).add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType())
    arrow = to_arrow_schema(schema)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        n = len(table)
        totals, n_words, n_removed, texts = packed.Totals(told), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        held = list(views(table))
        keys = [layout.cut(v.whole[v.valid]) for *_, v in held]
        distinct, inverse, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True, return_counts=True)
        flags, lo = (totals.of(distinct, counts) > 1)[inverse], 0
        for (first, buf, offsets, v), k in zip(held, keys):
            mark = np.zeros(len(v.starts) + 1, np.int64)
            begin = np.flatnonzero(v.valid)[flags[lo : lo + len(k)]]
            lo += len(k)
            mark[begin] += 1
            np.subtract.at(mark, begin + length, 1)
            gone, data = np.cumsum(mark)[:-1] > 0, buf.tobytes()
            edge = kernel.bounds(v.docs, len(offsets) - 1)
            for i in range(len(offsets) - 1):
                words, out = data[offsets[i] : offsets[i + 1]].split(), gone[edge[i] : edge[i + 1]]
                n_words[first + i], n_removed[first + i] = len(words), out.sum()
                texts[first + i] = b" ".join([w for w, x in zip(words, out.tolist()) if not x] if out.any() else words)
        null = table.column(text).is_null().to_pylist()
        texts = pa.array([None if x else t for t, x in zip(texts, null)], pa.binary()).cast(pa.string())
        columns = [table.column(f.name) for f in kept] + [pa.array(n_words), pa.array(n_removed), texts]
        return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    told = packed.count_round(blocked, block, layout, quarters)
    told = packed.count_round(blocked, block, layout, halves, told)
    told = packed.count_round(blocked, block, layout, wholes, told)
    return blocked.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(cut, schema)
