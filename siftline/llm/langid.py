"""Language identification by a byte convolutional network in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from . import kernel
from .common import col

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bounds of the training sample: languages up to which each gets as many documents, those, windows of a document.
MAX_LANGS = 64
DOCS_A_LANG = 800
WINDOWS_A_DOC = 6
STEPS, BATCH, RATE, SEED = 500, 192, 0.02, 20
NO_LANGUAGE = "und"


def lower(buf):
    """Lower case in ASCII and in the Latin-1 letters of UTF-8."""
    out = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    latin = np.zeros(len(buf), bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    return np.where(latin, out + 32, out).astype(np.uint8)


def windows_of(buf, offsets):
    """(windows, document of each, bytes in each): each text cut into windows, the last padded with zeros."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][doc] + at * WINDOW
    fill = np.minimum(sizes[doc] - at * WINDOW, WINDOW)
    place = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < fill[:, None]
    return np.where(inside, buf[np.minimum(place, len(buf) - 1)], 0).astype(np.uint8) if len(doc) else np.zeros((0, WINDOW), np.uint8), doc, fill


class Network:
    """Filters of several widths over one-hot bytes, max pooling, softmax.

    A filter of width w is w tables of 256 values, so a convolution is w lookups.
    """

    def __init__(self, langs, rng):
        self.langs = langs
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pool(self, x, where=False):
        """Pooled responses of windows, and with ``where`` the place of each maximum."""
        best, places = [], []
        for tables in self.tables:
            n = WINDOW - len(tables) + 1
            r = tables[0][x[:, :n]]
            for j in range(1, len(tables)):
                r += tables[j][x[:, j : j + n]]
            if where:
                places.append(r.argmax(1))
            best.append(r.max(1))
        h = np.maximum(np.concatenate(best, 1) + self.shift, 0)
        return (h, places) if where else h

    def probabilities(self, h):
        z = h @ self.out + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, x):
        return np.concatenate([np.zeros((0, len(self.langs)), np.float32), *(self.probabilities(self.pool(x[i : i + 256])) for i in range(0, len(x), 256))])

    def fit(self, x, y, rng):
        """Adam on cross entropy; gradients reach the tables through the maxima alone."""
        params = [t for tables in self.tables for t in tables] + [self.shift, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(x), min(BATCH, len(x)))
            xb, yb = x[at], y[at]
            h, places = self.pool(xb, True)
            d = self.probabilities(h)
            d[np.arange(len(at)), yb] -= 1
            d /= len(at)
            dh = (d @ self.out.T) * (h > 0)
            grads, lo = [], 0
            for tables, place in zip(self.tables, places):
                g = dh[:, lo : lo + FILTERS]
                lo += FILTERS
                for j in range(len(tables)):
                    byte = np.take_along_axis(xb, place + j, 1).astype(np.int64)
                    grads.append(np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32))
            grads += [dh.sum(0), h.T @ d, d.sum(0)]
            rate = RATE * (1 - step / (STEPS + 1))
            for i, (p, g) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, text: str, lang: str) -> Network | None:
    """A network for the languages of the labelled ``docs``; None without any.

    All languages are learned.  The sample is bounded by about DOCS_A_LANG
    documents of each, fewer where there are more than MAX_LANGS languages but
    one at least, picked by hash of the text, and WINDOWS_A_DOC windows of a
    document, spread over it.  Copies count once, in the share as in the sample,
    so that a large group of them can neither break the bound nor shrink the
    sample.
    """
    known = docs.select(col(lang).alias("lang"), col(text).alias("text")).where("lang is not null and text is not null")
    place = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 20))
    counts = known.select("lang", F.xxhash64("text", F.lit(SEED)).alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(F.pmod("h", F.lit(1 << 20))).alias("least")).collect()
    if not counts:
        return None
    each = DOCS_A_LANG * min(1.0, MAX_LANGS / len(counts))
    share = docs.sparkSession.createDataFrame([(r["lang"], max(min(1.0, each / r["n"]) * (1 << 20), r["least"] + 1.0)) for r in counts], "lang string, below double")
    picked = known.join(F.broadcast(share), "lang").where(place < F.col("below")).select("lang", "text").distinct()

    def cut(batches):
        for batch in batches:
            for lo, buf, offsets in kernel.chunks(batch.column("text")):
                x, doc, _ = windows_of(lower(buf), offsets)
                n = np.bincount(doc, minlength=len(offsets) - 1)
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                spread = np.maximum(1, -(-n // WINDOWS_A_DOC))[doc]
                keep = np.flatnonzero(rank % spread == 0)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(doc[keep] + lo)), pa.array([x[i].tobytes() for i in keep], pa.binary())], ["lang", "bytes"])

    rows = sorted((r["lang"], bytes(r["bytes"])) for r in picked.mapInArrow(cut, "lang string, bytes binary").collect())
    if not rows:
        return None
    langs = sorted(r["lang"] for r in counts)
    rng = np.random.default_rng(SEED)
    net = Network(langs, rng)
    x = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(-1, WINDOW)
    number = {k: i for i, k in enumerate(langs)}
    y = np.array([number[k] for k, _ in rows])
    # languages count alike, whatever their windows
    weight = 1 / np.bincount(y, minlength=len(langs))[y]
    at = rng.choice(len(y), len(y), p=weight / weight.sum())
    net.fit(x[at], y[at], rng)
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score to ``docs``, replacing columns so named.

    The whole text is cut into windows of fixed length; their class
    probabilities are averaged by bytes.  score is that of the winner, between
    0 and 1.  Texts that are null or hold no letter get ``und`` and score 0,
    as do all without a network.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = StructType(list(kept)).add("lang_pred", StringType()).add("score", DoubleType())
    arrow = to_arrow_schema(schema)
    spot = next(i for i, f in enumerate(kept) if f.name == text)
    names = [NO_LANGUAGE] if net is None else [*net.langs, NO_LANGUAGE]

    def label(batches):
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        for batch in batches:
            n = len(batch)
            pred, score = np.full(n, len(names) - 1), np.zeros(n)
            for lo, buf, offsets in kernel.chunks(batch.column(spot)) if net is not None else ():
                sizes = np.diff(offsets)
                sums = np.zeros((len(sizes), len(net.langs)))
                x, doc, fill = windows_of(lower(buf), offsets)
                p = net.predict(x)
                for k in range(p.shape[1]):
                    sums[:, k] = np.bincount(doc, p[:, k] * fill, len(sizes))
                sums /= np.maximum(sizes, 1)[:, None]
                plain = np.concatenate([[0], np.cumsum(letter[buf])])
                has = plain[offsets[1:]] > plain[offsets[:-1]]
                for i in np.flatnonzero(~has & (sizes > 0)):
                    has[i] = any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                at = lo + np.flatnonzero(has)
                pred[at], score[at] = sums.argmax(1)[has], np.minimum(sums.max(1)[has], 1.0)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array([names[i] for i in pred]), pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return docs.select(*(col(f.name) for f in kept)).mapInArrow(label, schema)


def held_out(id: str, parts: int, part: int):
    """Whether the CRC-32 of the id, as text, leaves the remainder that is kept from training."""
    return F.coalesce(F.crc32(col(id).cast("string")) % parts == part, F.lit(False))
