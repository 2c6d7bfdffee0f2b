"""Quality scores: random-indexing word vectors, pooled, and a two-layer network in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from . import kernel
from .common import col

#: Dimensions of index and context vectors, entries of an index vector that aren't 0, words to each side that are context.
DIM, NONZERO, REACH = 64, 4, 2
#: Rows of the table of context vectors; words of equal hash share a row, so that the table is as large for any corpus.
ROWS = 1 << 14
#: Tokens pooled at a time.
BLOCK = 1 << 16
HIDDEN, EPOCHS, BATCH, RATE, SEED = 48, 60, 128, 0.004, 10
#: Bound of the labelled sample.
MAX_ROWS = 12000
#: Rows of a label that are taken at least, as far as there are as many.
LEAST_ROWS = MAX_ROWS // 20
#: One labelled row in this many sets the temperature.
CALIBRATE = 5


def kinds():
    """0 for white space, 1 for letters, digits and bytes beyond ASCII, 2 for marks."""
    out = np.full(256, 2, np.uint8)
    out[[32, 9, 10, 11, 12, 13]] = 0
    out[48:58] = out[65:91] = out[97:123] = out[128:] = 1
    return out


KINDS = kinds()


def tokens(hasher, buf, offsets):
    """(hash, document) of the runs of bytes of one kind, white space aside, A-Z as a-z."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = KINDS[buf]
    edge = np.ones(len(buf), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[(offsets > 0) & (offsets < len(buf))]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(buf))
    word = kind[start] > 0
    start, end = start[word], end[word]
    return hasher.hash_spans(buf, start, end), np.searchsorted(offsets, start, "right") - 1


def row_of(words):
    return (words >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.int64)


def index_vectors(words):
    """(dimension, sign) of each entry of the words' index vectors, drawn from their hashes."""
    h = kernel.mix64(words + np.uint64(DIM))
    for k in range(NONZERO):
        x = h >> np.uint64(16 * k)
        yield (x & np.uint64(0x7FFF)).astype(np.int64) % DIM, np.where(x & np.uint64(0x8000), 1.0, -1.0)


def add_contexts(table, words, doc):
    """Add to each word's row the index vectors of the words up to REACH away in its document."""
    row = row_of(words) * DIM
    for at, sign in index_vectors(words):
        for d in range(1, REACH + 1):
            same = doc[d:] == doc[:-d]
            for left, right in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                table += np.bincount(row[left][same] + at[right][same], sign[right][same], len(table)).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text"):
    """Context vectors by random indexing over all of ``docs``: ROWS unit vectors, zero where no word fell.

    A word has a sparse index vector drawn from its hash; its context vector is
    the sum, over all its places in the corpus, of the index vectors of the
    words near it.  Tasks sum their part and the parts are added by row; the table has
    ROWS x DIM numbers whatever the corpus, and sums of whole numbers, so that
    the order of addition doesn't matter.
    """
    names = [f"c{i}" for i in range(DIM)]

    def gather(batches):
        hasher, table = kernel.Hasher(True), np.zeros(ROWS * DIM, np.int64)
        for batch in batches:
            for _, buf, offsets in kernel.chunks(batch.column(0)):
                add_contexts(table, *tokens(hasher, buf, offsets))
        part = table.reshape(ROWS, DIM)
        some = np.flatnonzero(part.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(part[some, i]) for i in range(DIM))], ["row", *names])

    parts = docs.select(col(text).alias("text")).mapInArrow(gather, "row int, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((ROWS, DIM))
    out[np.array(sums.column("row"), dtype=np.int64)] = np.stack([np.array(sums.column(n), dtype=float) for n in names], 1).reshape(-1, DIM)
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(hasher, buf, offsets, vectors):
    """One row per text: the mean of its words' vectors and of the products of neighbours', with their lengths, and the log of its words."""
    n = len(offsets) - 1
    words, doc = tokens(hasher, buf, offsets)
    row, size = row_of(words), np.bincount(doc, minlength=n)
    mean, beside = np.zeros((n, DIM)), np.zeros((n, DIM))

    def add(total, x, of):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        if len(first):
            total[of[first]] += np.add.reduceat(x, first, 0, np.float64)

    for i in range(0, len(row), BLOCK):
        # one word more, so that no pair is lost between blocks
        v, d = vectors[row[i : i + BLOCK + 1]], doc[i : i + BLOCK + 1]
        add(mean, v[:BLOCK], d[:BLOCK])
        same = d[1:] == d[:-1]
        add(beside, (v[1:] * v[:-1])[same], d[1:][same])
    mean /= np.maximum(size, 1)[:, None]
    beside /= np.maximum(size - 1, 1)[:, None]
    return np.concatenate([mean, 8 * beside, beside.sum(1, keepdims=True), np.sqrt((mean**2).sum(1, keepdims=True)), np.log1p(size)[:, None]], 1).astype(np.float32)


class Scorer:
    """Standardised inputs, one hidden layer of rectifiers, a logistic output with a temperature."""

    #: Log odds added for a sample that took the labels in unequal shares.
    shift = 0.0
    #: The word vectors that its inputs are pooled from.
    vectors = None

    def fit(self, x, y, seed=SEED):
        rng = np.random.default_rng(seed)
        keep = rng.permutation(len(x))
        tune, fit = keep[: len(x) // CALIBRATE], keep[len(x) // CALIBRATE :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        self.temperature = 1.0
        params = self.params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(fit)
            for i in range(0, len(order), BATCH):
                b = order[i : i + BATCH]
                z = np.clip((x[b] - self.mean) / self.scale, -6, 6)
                h = np.maximum(z @ params[0] + params[1], 0) * (rng.random(HIDDEN) > 0.2) / 0.8
                d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[b]) / len(b)
                dh = np.outer(d, params[2]) * (h > 0)
                step += 1
                for k, g in enumerate((z.T @ dh + 1e-3 * params[0] / len(b), dh.sum(0), h.T @ d, d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(tune) >= 20 and 0 < y[tune].mean() < 1:
            logit = self.logit(x[tune])
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, -np.where(y[tune] > 0, 1, -1) * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logit(self, x):
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.params[0] + self.params[1], 0) @ self.params[2] + self.params[3]

    def __call__(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.shift, -30, 30)))


def lot(text: Column) -> Column:
    """The hash by which texts are picked."""
    return F.xxhash64(text, F.lit(SEED))


def train(docs: DataFrame, text: str, label: str, vectors, drawn: str | None = None) -> Scorer | None:
    """A scorer over pooled word ``vectors`` from rows with ``label`` 0 or 1; None without both labels.

    About MAX_ROWS rows at most, picked by hash of the text, and of a rare label
    LEAST_ROWS as far as there are as many, for which the score is put right;
    copies of the same label count once, in the share as in the sample, so that
    a large group of them can neither break the bound nor shrink the sample.
    ``drawn`` may name a column with ``lot`` of the text; texts then aren't read to be counted.
    """
    known = docs.select(col(label).cast("double").alias("y"), col(text).alias("text"), (lot(col(text)) if drawn is None else col(drawn)).alias("h")).where("y in (0, 1)")
    place = F.pmod("h", F.lit(1 << 20))
    counts = known.select("y", "h").distinct().groupBy("y").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
    if len(counts) < 2:
        return None
    n = sum(r["n"] for r in counts)
    share = {r["y"]: max(min(1.0, max(MAX_ROWS / n, LEAST_ROWS / r["n"])), (r["least"] + 1) / (1 << 20)) for r in counts}
    below = F.when(F.col("y") == 1, F.lit(share[1.0])).otherwise(F.lit(share[0.0]))
    # the first condition needs the text alone and so holds back rows before a join
    known = known.where(place < max(share.values()) * (1 << 20)).where(place < below * (1 << 20)).select("y", "text").distinct()

    def gather(batches):
        hasher = kernel.Hasher(True)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for lo, buf, offsets in kernel.chunks(batch.column("text")):
                x = pooled(hasher, buf, offsets, vectors)
                yield pa.RecordBatch.from_arrays([pa.array(y[lo : lo + len(x)]), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    rows = sorted((bytes(r["x"]), r["y"]) for r in known.mapInArrow(gather, "y double, x binary").collect())
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    scorer = Scorer().fit(np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(len(y), -1).astype(float), y)
    scorer.vectors = vectors
    scorer.shift = float(np.log(share[0.0] / share[1.0]))
    return scorer


def score(docs: DataFrame, scorer: Scorer | None, text: str = "text") -> DataFrame:
    """Add the probability ``score`` that a document has label 1 to ``docs``, replacing a column so named.

    Whole texts count; null and blank ones have no words and get the score of
    that.  Without a scorer every score is 0.5.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    schema = StructType(list(kept)).add("score", DoubleType())
    arrow = to_arrow_schema(schema)
    spot = next(i for i, f in enumerate(kept) if f.name == text)

    def mark(batches):
        hasher = kernel.Hasher(True)
        for batch in batches:
            out = np.full(len(batch), 0.5)
            for lo, buf, offsets in kernel.chunks(batch.column(spot)) if scorer is not None else ():
                out[lo : lo + len(offsets) - 1] = scorer(pooled(hasher, buf, offsets, scorer.vectors))
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(out)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return docs.select(*(col(f.name) for f in kept)).mapInArrow(mark, schema)
