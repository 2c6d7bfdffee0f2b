"""Importance resampling: draw documents whose n-grams look like a target's."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, shared_table

#: Words are runs of digits, lower-case letters and all that isn't ASCII, by bytes after A-Z have been lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
INK = re.compile(rb"[0-9A-Za-z\x80-\xff]*")
#: Bytes of text that one suffix array covers.
CHUNK_BYTES = 2 << 20
#: Documents of one range of scores, which one task sorts; and the most ranges, whose bounds the plan holds.
RANGE_ROWS, RANGES = 1_000_000, 4096


class Suffixes:
    """Suffix array of a sequence of words, ordered as far as ``depth`` words.

    ``words`` has the words in order, ``left`` the words from each to the end of its
    document, itself included.  Words are numbered in order of appearance and ranks of
    runs doubled in length until ``depth`` is reached; ``lcp`` is how many words a
    suffix shares with the one before it in the array, up to ``depth``.
    """

    def __init__(self, words: list[bytes], left, depth: int):
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        self.words, self.left = words, left
        rank, reach = ids, 1
        order = np.argsort(rank, kind="stable")
        while reach < depth:
            # a rank beyond the document is lower than all
            onward = np.where(left > reach, np.append(rank[reach:], np.zeros(min(reach, len(rank)), np.int64))[: len(rank)] + 1, 0)
            pair = rank * (len(rank) + 1) + onward
            order = np.argsort(pair, kind="stable")
            rank = np.empty(len(pair), np.int64)
            rank[order] = np.cumsum(np.append(0, pair[order][1:] != pair[order][:-1]))[: len(pair)]
            reach *= 2
        self.order = order
        self.lcp = np.zeros(len(order), np.int64)
        same = np.ones(max(0, len(order) - 1), bool)
        for d in range(depth):
            a, b = order[:-1] + d, order[1:] + d
            inside = (left[order[:-1]] > d) & (left[order[1:]] > d)
            same &= inside
            same[same] = ids[a[same]] == ids[b[same]]
            self.lcp[1:] += same

    def buckets(self, n: int, buckets: int):
        """(place, bucket) of each run of ``n`` words: runs of LCP n or more are one n-gram, which is hashed once."""
        first = self.lcp < n
        whole = self.left[self.order] >= n
        group = np.cumsum(first) - 1
        heads = np.flatnonzero(first & whole)
        of = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
        of[group[heads]] = [zlib.crc32(b" ".join(self.words[i : i + n])) % buckets for i in self.order[heads].tolist()]
        return self.order[whole], of[group[whole]]


def parts(texts: pa.Array, overlap: int):
    """(row, words, number that the row's part before has passed on) for parts of texts up to CHUNK_BYTES."""
    for row, value in enumerate(texts):
        value = value.as_buffer()
        text, carried, lo = value.to_pybytes() if value else b"", [], 0
        while lo < len(text):
            hi = INK.match(text, lo + CHUNK_BYTES).end() if lo + CHUNK_BYTES < len(text) else len(text)
            words = carried + WORD.findall(text[lo:hi].lower())
            yield row, words, len(carried)
            carried, lo = words[-overlap:] if overlap else [], hi


def features(texts: pa.Array, most: int, buckets: int):
    """(row, bucket) arrays of all runs of 1 to ``most`` words, and (row, words) arrays, chunk by chunk.

    A long text comes in parts, each led by the last words of the one before, of
    which only runs that reach past them count.
    """

    def flush(held):
        words = [w for _, ws, _ in held for w in ws]
        size = np.array([len(ws) for _, ws, _ in held])
        ends = np.cumsum(size)
        doc = np.repeat(np.arange(len(held)), size)
        left = ends[doc] - np.arange(len(words))
        led = np.array([k for *_, k in held])
        rows = np.array([r for r, *_ in held])
        suffixes = Suffixes(words, left, most)
        for n in range(1, most + 1):
            place, bucket = suffixes.buckets(n, buckets)
            new = place + n > (ends - size + led)[doc[place]]
            yield rows[doc[place[new]]], bucket[new], np.zeros(0, int), np.zeros(0, int)
        yield np.zeros(0, int), np.zeros(0, int), rows, size - led

    held, size = [], 0
    for row, words, led in parts(texts, most - 1):
        held.append((row, words, led))
        size += 6 * len(words)
        if size >= CHUNK_BYTES:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def bucket_counts(docs: DataFrame, text: str, most: int, buckets: int) -> dict[int, int]:
    """Features of all texts by bucket; at most ``buckets`` numbers reach the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _, _ in features(batch.column(0), most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    rows = docs.select(col(text).cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln) of how much likelier each bucket is in the target, one occurrence added to each."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = lambda b: (float(target.get(b, 0) + 1) * float(s_all + buckets)) / (float(source.get(b, 0) + 1) * float(t_all + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... of the highest scores among documents of enough words, null for the rest.

    Quantiles of the scores part them into ranges of about RANGE_ROWS.  Totals
    of the ranges, one row each, say where each starts and which hold drawn
    documents; only these are sorted, each by itself.
    """
    spark = scored.sparkSession
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    wanted = percent * n // 100
    out = [*scored.columns, "rank"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS + 1))
    cuts = scored.where(enough).agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)] or [0.5], 4 * ranges)).first()[0]
    cuts = np.unique(np.array(cuts, np.int64))

    def place(batches):
        for batch in batches:
            score = batch.column(batch.schema.get_field_index("score")).to_numpy(zero_copy_only=False)
            at = len(cuts) - np.searchsorted(cuts, score, "right")
            yield batch.append_column("range", pa.array(at, pa.int64()))

    schema = ", ".join(f"`{name}` {kind}" for name, kind in scored.dtypes) + ", range long"
    placed = scored.mapInArrow(place, schema)
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.where(enough).groupBy("range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(before, F.lit(0).cast("long"))).where(F.col("start") < wanted).collect()
    last = max(r["range"] for r in starts)
    start = F.element_at(F.create_map(*(F.lit(x) for r in starts for x in (r["range"], r["start"]))), F.col("range"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    sure = enough & (F.col("range") <= last)
    ranked = placed.where(sure).withColumn("rank", start + inside)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select(*out).union(placed.where(~sure).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Score each document by how likely the target's words are in it, and draw without replacement.

    Words are runs of a-z (A-Z lower-cased), digits and all that isn't ASCII;
    features are all runs of 1 to ``most`` consecutive words, repeats counted,
    hashed by CRC-32 into ``buckets``.  Per chunk of a partition a suffix array over
    word numbers finds equal runs, which are hashed once.  Counts of all
    documents and of all target texts give each bucket a gain, floor(1000 ln of
    their ratio); a document's weight is the sum over its features, its score that
    plus Gumbel noise from the SHA-256 of ``<seed>:<id>``.  Of the documents with
    ``least_words`` words or more, ``percent`` percent are drawn, highest scores
    first, ties to the smaller id, null ids last.

    Returns id, n_words, n_features, weight, score and rank (null if not drawn).
    Null and empty texts have no features and weight 0; a null id reads as
    empty; repeated rows are documents of their own; other columns play no part.
    """
    gain = np.array(gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets), buckets), np.int64)

    def weigh(batches):
        for batch in batches:
            n = len(batch)
            weight, number, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket, doc, size in features(batch.column(1), most, buckets):
                np.add.at(weight, row, gain[bucket])
                number += np.bincount(row, minlength=n)
                np.add.at(words, doc, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (words, number, weight))], names)

    names = ["doc", "n_words", "n_features", "weight"]
    kind = dict(docs.dtypes)[id]
    x = docs.select(col(id).alias("doc"), col(text).cast("binary").alias("text")).mapInArrow(weigh, f"doc {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = shared_table(x.withColumn("score", F.col("weight") + noise))
    return drawn(scored, least_words, percent).withColumnRenamed("doc", id)
