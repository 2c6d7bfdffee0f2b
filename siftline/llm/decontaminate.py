"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import SPACE, col, fresh, let

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of equal weight at similarity 0.8 lie 9.7 of 64 bits apart on average, deviation 2.9.
RADIUS = 19
#: Any two fingerprints within RADIUS differ in at most RADIUS // BLOCKS bits of one block.
BLOCKS = 10
#: Benchmark shingles up to which they travel inside the plan; beyond, they are joined.
INLINE = 50_000
#: Texts of more bytes are cut into pieces of STEP words that overlap by the longest item, each a row of its own.
LONG, STEP = 1 << 20, 1 << 15


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), "")


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hash of the k words from each place of an array of words."""

    def run(w):
        last = F.size(w) - (k - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))

    return let(w, run)


#: One bit in each of four lanes of 16; a lane counts up to LANE shingles.
LANES = 0x0001000100010001
LANE = (1 << 14) - 1


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint: each bit is that of most hashes, repeats counted.

    Four bits at a time are counted, in lanes of a long: a lane, moved up so
    that more than half of the hashes reach its bit 14, gives the bit.  Arrays
    of more than LANE hashes are counted bit by bit.
    """

    def lanes(hs):
        lift = (F.lit(LANE) - F.floor(F.size(hs) / 2)).cast("bigint") * F.lit(LANES)

        def four(acc, j):
            total = F.aggregate(hs, F.lit(0).cast("bigint"), lambda c, h: c + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(LANES)))
            return acc.bitwiseOR(F.call_function("shiftleft", F.shiftright(total + lift, 14).bitwiseAND(F.lit(LANES)), j))

        return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("bigint"), four)

    def bits(hs):
        def bit(acc, j):
            ones = F.aggregate(hs, F.lit(0), lambda c, h: c + F.getbit(h, j).cast("int"))
            return acc.bitwiseOR(F.when(ones * 2 > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)

    return let(hashes, lambda hs: F.when(F.size(hs) <= LANE, lanes(hs)).otherwise(bits(hs)))


def masks() -> list[int]:
    edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [sum(1 << j for j in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, a shingle's weight its count."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    shared = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda c, h: c + F.least(count(a, h), count(b, h)))
    return shared / (F.size(a) + F.size(b) - shared)


def items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, size, grams, print) of the items with words; items under SHINGLE words are one shingle."""
    w = benchmark.select(col(item).alias("item_id"), words(col(text)).alias("w")).where("size(w) > 0")
    short = F.array(F.xxhash64("w"))
    k = F.least(F.size("w"), F.lit(SHINGLE))
    ends = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(F.xxhash64(F.get("w", i)).alias("first"), F.xxhash64(F.get("w", i + k - 1)).alias("last")))
    w = w.select("item_id", F.size("w").alias("size"), F.when(F.size("w") < SHINGLE, short).otherwise(shingles(F.col("w"))).alias("grams"), ends.alias("ends"))
    return w.withColumn("print", simhash(F.col("grams")))


def pieces(docs: DataFrame, id: str, text: str, longest: int) -> DataFrame:
    """(id, th, base, last, text): whole texts, and the pieces of long ones with the place of their first word."""
    t = col(text)

    def cut(w):
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(STEP))
        return F.transform(starts, lambda s: F.struct(s.alias("base"), (s + STEP >= F.size(w)).alias("last"), F.array_join(F.slice(w, s + 1, STEP + longest), " ").alias("text")))

    whole = F.array(F.struct(F.lit(0).alias("base"), F.lit(True).alias("last"), t.alias("text")))
    x = docs.select(col(id).alias("id"), F.xxhash64(t).alias("th"), F.explode(F.when(F.octet_length(t) > LONG, let(words(t), cut)).otherwise(whole)).alias("p"))
    return x.select("id", "th", "p.base", "p.last", "p.text")


def inline(x: DataFrame, rows: list, k: int) -> DataFrame:
    """Pieces with hits, from a benchmark small enough to travel in the plan.

    The first and last words of a place are looked up before its shingle is
    hashed; the hashes of all shingles are made only where there is a hit.
    """
    listed = lambda xs: ", ".join(f"{x}L" for x in sorted(set(xs))) or "NULL"
    first, last = listed(r["ends"]["first"] for r in rows), listed(r["ends"]["last"] for r in rows)
    table = json.dumps({str(r["h"]): r["sizes"] for r in rows})
    made = f"""element_at(transform(array(array_remove(split(lower(coalesce(text, '')), r'{SPACE}+'), '')), w ->
      element_at(transform(array(if(size(w) >= {k}, filter(sequence(0, size(w) - {k}), i ->
          xxhash64(w[i]) IN ({first}) AND xxhash64(w[i + {k - 1}]) IN ({last}) AND xxhash64(slice(w, i + 1, {k})) IN ({listed(r["h"] for r in rows)})), array())), h ->
        if(size(h) > 0, named_struct(
          'grams', transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k}))),
          'hits', transform(h, i -> named_struct('at', i, 'sizes', try_element_at(from_json('{table}', 'map<string,array<int>>'), cast(xxhash64(slice(w, i + 1, {k})) AS string))))), NULL)), 1)), 1)"""
    x = x.select("id", "th", "base", "last", F.explode(F.array_compact(F.array(F.expr(made)))).alias("m"))
    return x.select("id", "th", "base", "last", "m.grams", "m.hits")


def seeded(x: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(id, th, base, last, grams, hits): pieces with a benchmark shingle of ``k`` words; a hit is (place, sizes of items with it)."""
    sizes = known.where(F.least("size", F.lit(SHINGLE)) == k).select(F.explode(F.arrays_zip("grams", "ends")).alias("g"), "size")
    sizes = sizes.groupBy(F.col("g.grams").alias("h")).agg(F.sort_array(F.collect_set("size")).alias("sizes"), F.first("g.ends").alias("ends"))
    rows = sizes.limit(INLINE + 1).collect()
    if len(rows) <= INLINE:
        return inline(x, rows, k)
    x = x.select("id", "th", "base", "last", shingles(words(F.col("text")), k).alias("grams"))
    found = x.select("th", "base", F.posexplode("grams").alias("at", "h")).join(sizes, "h").groupBy("th", "base").agg(F.array_sort(F.collect_set(F.struct("at", "sizes"))).alias("hits"))
    return x.join(found, ["th", "base"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The pairs of documents and benchmark items of which the document holds a near copy.

    Words are lower-cased.  A window of a document has as many words as an
    item, or is the whole of a document that has fewer; a window that shares no shingle of five words with the benchmark has
    similarity 0 with all of it and is passed over, every other one gets a
    64-bit SimHash of its shingles.  The fingerprints of items of its size
    within Hamming distance RADIUS are found by blocks of bits, complete by the
    pigeonhole principle, and verified by exact weighted Jaccard similarity of
    the shingles (weight: count), SIMILARITY or more.

    Returns id, text_hash, item_id, similarity (the best), at (first word of the
    best window, from 0) and n_windows, one row per document and item.  Null
    and blank texts and items match nothing; items of fewer than five words are
    one shingle and match only as they are; rows alike in id and text count as
    one document.  Texts of more than LONG bytes are searched in overlapping
    pieces, so that the work of a row has a bound and that of a text grows with
    its length.  Only matches are shuffled.
    """
    known = items(benchmark, item, item_text)
    sizes = known.groupBy(F.least("size", F.lit(SHINGLE)).alias("k")).agg(F.max("size").alias("longest")).collect()
    cut = pieces(docs, id, text, max((r["longest"] for r in sizes), default=1))
    parts = [windows(seeded(cut, known, k), known, k) for k in sorted(r["k"] for r in sizes)]
    found = parts[0] if parts else windows(seeded(cut, known, SHINGLE), known, SHINGLE)
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.max(F.struct("similarity", (-F.col("at")).alias("at"))).alias("best")
    found = found.groupBy("id", "th", "item_id").agg(best, F.count("*").alias("n_windows"))
    return found.select(F.col("id").alias(id), F.col("th").alias("text_hash"), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).alias("at"), "n_windows")


def windows(x: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(id, th, at, item_id, similarity) of the windows around the hits that match an item."""
    wide = 1 << 32

    def starts(hit):
        def of(size):
            lo = F.greatest(F.lit(0), hit["at"] - (size - k))
            hi = F.least(hit["at"], F.size("grams") - (size - k) - 1)
            # a shorter text is one window, unless it is too short to reach SIMILARITY
            whole = (F.col("base") == 0) & F.col("last") & (hi < 0) & (F.size("grams") / (size - (k - 1)) >= SIMILARITY)
            hi = F.when(whole, F.lit(0)).when(F.col("last"), hi).otherwise(F.least(hi, F.lit(STEP - 1)))
            lo = F.when(F.size("grams") < size - (k - 1), F.lit(0)).otherwise(lo)
            return F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda s: s.cast("bigint") + size.cast("bigint") * wide)).otherwise(F.array().cast("array<bigint>"))

        return F.flatten(F.transform(hit["sizes"], of))

    # a window takes its own shingles along, not those of the text
    own = lambda at, size: F.struct(at.alias("at"), size.alias("size"), F.slice("grams", at + 1, size - (k - 1)).alias("part"))
    part = F.transform(F.array_distinct(F.flatten(F.transform("hits", starts))), lambda c: own((c % wide).cast("int"), (c / wide).cast("int")))
    x = x.select("id", "th", "base", F.explode(part).alias("w")).select("id", "th", (F.col("base") + F.col("w.at")).alias("at"), F.col("w.size").alias("size"), F.col("w.part").alias("part"))
    x = x.withColumn("mark", simhash(F.col("part")))
    cut = F.array(*(F.lit(signed(m)).cast("bigint") for m in masks()))
    bits = F.array(*(F.array(*(F.lit(signed(1 << j)).cast("bigint") for j in range(64) if m >> j & 1)) for m in masks()))
    near = RADIUS // BLOCKS
    assert near == 1, "the index lists single-bit neighbours"
    index = known.where(F.least("size", F.lit(SHINGLE)) == k).select("item_id", F.col("size").alias("i_size"), F.col("grams").alias("i_grams"), F.col("print").alias("i_print"), F.posexplode(cut).alias("b", "mask"))
    base = F.col("i_print").bitwiseAND(F.col("mask"))
    index = index.select("item_id", "i_size", "i_grams", "i_print", F.col("b").alias("i_b"), F.explode(F.concat(F.array(base), F.transform(F.element_at(bits, F.col("b") + 1), lambda y: base.bitwiseXOR(y)))).alias("i_v"))
    if known.count() * BLOCKS * 8 <= INLINE:
        index = broadcast(index)
    x = x.select("*", F.posexplode(F.transform(cut, lambda m: F.col("mark").bitwiseAND(m))).alias("b", "v"))
    apart = F.col("mark").bitwiseXOR(F.col("i_print"))
    first = F.array_position(F.transform(cut, lambda m: F.bit_count(apart.bitwiseAND(m)) <= near), True) == F.col("b") + 1
    x = x.join(index, (F.col("size") == F.col("i_size")) & (F.col("b") == F.col("i_b")) & (F.col("v") == F.col("i_v")) & (F.bit_count(apart) <= RADIUS) & first)
    return x.withColumn("similarity", similarity(F.col("part"), F.col("i_grams"))).where(F.col("similarity") >= SIMILARITY).select("id", "th", "at", "item_id", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the rows that hold a near copy of a benchmark item."""
    h, = fresh(docs, "text_hash")
    bad = decontaminate(docs, benchmark, id, text, **names).select("text_hash").distinct()
    if h != "text_hash":
        bad = bad.withColumnRenamed("text_hash", h)
    return docs.withColumn(h, F.xxhash64(col(text))).join(bad, h, "left_anti").select(*(col(c) for c in docs.columns))
