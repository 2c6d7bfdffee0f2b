"""Language-model scores by stupid backoff."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructType

from . import kernel, packed

ORDER = 3
BACKOFF = 0.4


def block_grams(table, text: str):
    """(hashes, whole) of the 1- to 3-grams that start at each word, by order, and the document of each word.

    A run that leaves its document isn't whole; its hash means nothing.
    """
    hasher, grams, docs = kernel.Hasher(), [[] for _ in range(ORDER)], [np.zeros(0, np.int64)]
    for lo, buf, offsets in kernel.chunks(table.column(text)):
        start, end, d = hasher.split(buf, offsets)
        words = hasher.hash_spans(buf, start, end)
        docs.append(d + lo)
        for n in range(1, ORDER + 1):
            h, whole = words.copy(), np.zeros(len(words), bool)
            g = hasher.ngrams(words, n)
            h[: len(g)] = g
            whole[: len(g)] = d[: len(g)] == d[n - 1 :] if len(g) else False
            grams[n - 1].append((h, whole))
    join = lambda xs, t: np.concatenate([np.zeros(0, t), *xs])
    return [(join((h for h, _ in x), np.uint64), join((w for _, w in x), bool)) for x in grams], np.concatenate(docs)


def counted(layout, grams):
    """(sorted keys, counts, place of each gram's key): places by order, -1 where no gram stands."""
    cut = [layout.cut(h[ok]) for h, ok in grams]
    keys, inverse, counts = np.unique(np.concatenate(cut), return_inverse=True, return_counts=True)
    places, lo = [], 0
    for (_, ok), c in zip(grams, cut):
        at = np.full(len(ok), -1, np.int64)
        at[ok] = inverse[lo : lo + len(c)]
        places.append(at)
        lo += len(c)
    return keys, counts, places


def elsewhere(total, at, doc, n: int):
    """Count, in other documents, of the gram at each place; 0 where none stands."""
    if not len(at):
        return at
    _, inverse, own = np.unique(at * (n + 1) + doc, return_inverse=True, return_counts=True)
    return np.where(at >= 0, total[at] - own[inverse], 0) if len(total) else np.zeros(len(at), np.int64)


def back(x, k):
    """Values of the gram that starts k words earlier."""
    return np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[: max(0, len(x) - k)]])


def lm_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """Mean log stupid-backoff score of a document's words under a trigram model of all others.

    Counts of 1- to 3-grams cover all documents; a document's own are taken off
    when it is scored.  A word scores c(uvw) / c(uv) if c(uvw) > 0, else 0.4
    times the shorter history's score, down to c(w) / N; a word that no other
    document holds counts 1 / (N + 1) there.  Histories stop at the document's
    start.  N-grams are told apart by 64-bit hashes.

    The count tables are partitioned by hash and summed there; a document's
    n-grams meet them and its scores are summed.  Exploded to rows, the n-grams
    would take several times the disk of the texts, so they travel packed, a row for
    each block of documents and hash partition.  Words and pairs go first; a
    triple goes only if other documents hold both of its pairs, without which
    its count there is 0.

    Adds n_tokens and lm_score (null without words) to the columns of
    ``docs``, replacing columns so named.  Words are unchanged; repeated rows
    are documents of their own and so foresee each other.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_tokens", "lm_score")]
    docs = docs.select(*(f"`{f.name}`" for f in kept))
    blocked, block, layout = packed.in_blocks(docs, text, 0.5)
    all_words = (1 << layout.bits) - 1

    def ask(table):
        grams, doc = block_grams(table, text)
        keys, counts, _ = counted(layout, grams[:2])
        if len(keys) and int(keys[-1]) == all_words:
            keys, counts = keys[:-1], counts[:-1]
        return np.append(keys, np.uint64(all_words)), np.append(counts, len(doc))

    def short(table, more):
        """Grams, documents, counts elsewhere of words and pairs, triples that go, and words of the corpus."""
        grams, doc = block_grams(table, text)
        keys, counts, (one, two) = counted(layout, grams[:2])
        words = len(doc) + (int(more[-1]) if len(more) else 0)
        if len(more) == len(keys):  # the last key is that of all words itself
            more = np.append(more[:-1], 0)
        total = counts + more[: len(keys)]
        c1, c2 = (elsewhere(total, at, doc, len(table)) for at in (one, two))
        h, whole = grams[2]
        go = whole & (c2 > 0) & (np.append(c2[1:], 0) > 0)
        return doc, c1, c2, (h, go), words

    def ask_triples(table, told):
        _, _, _, triples, _ = short(table, packed.added(told))
        return counted(layout, [triples])[:2]

    schema = StructType(list(kept)).add("n_tokens", LongType()).add("lm_score", DoubleType())
    arrow = to_arrow_schema(schema)

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        n, first = len(table), np.array(told.column("first"))
        doc, c1, c2, triples, words = short(table, packed.added(told.filter(pa.array(first))))
        _, counts, (three,) = counted(layout, [triples])
        c3 = elsewhere(counts + packed.added(told.filter(pa.array(~first))), three, doc, n)
        size = np.bincount(doc, minlength=n)
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        rest = words - size[doc]
        with np.errstate(divide="ignore", invalid="ignore"):
            s1 = np.where(c1 > 0, c1 / rest, 1.0 / (rest + 1))
            b2 = back(c2, 1)
            s2 = np.where((place >= 1) & (b2 > 0), b2 / back(c1, 1), np.where(place >= 1, BACKOFF, 1.0) * s1)
            b3 = back(c3, 2)
            s3 = np.where((place >= 2) & (b3 > 0), b3 / back(c2, 2), np.where(place >= 2, BACKOFF, 1.0) * s2)
        sums = np.bincount(doc, np.log(s3), minlength=n)
        means = pa.array(sums / np.maximum(size, 1), mask=size == 0)
        columns = [table.column(f.name) for f in kept] + [pa.array(size.astype(np.int64)), means]
        return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    told = packed.count_all(blocked, block, layout, ask)
    more = packed.count_all(blocked, block, layout, ask_triples, told)
    both = told.withColumn("first", F.lit(True)).union(more.withColumn("first", F.lit(False)))
    return blocked.groupBy(block).cogroup(both.groupBy("block")).applyInArrow(score, schema)
