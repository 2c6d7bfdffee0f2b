"""N-gram Jaccard join: prefix filtering, rarest shingles first."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from . import kernel, packed
from .common import col, drop_tables, shared_table
from .components import components

#: Text hashes (8 bytes each) up to which a list of texts is broadcast.
BROADCAST_ROWS = 1 << 20
PARITY_WORDS = 4
SUFFIX = [f"suffix{i}" for i in range(PARITY_WORDS)]


def doc_sets(hasher, batch_texts, k):
    """The sorted shingle set of each text of an Arrow array, in order."""
    for _, buf, offsets in kernel.chunks(batch_texts):
        start, end, docs = hasher.split(buf, offsets)
        words = hasher.hash_spans(buf, start, end)
        edge = kernel.bounds(docs, len(offsets) - 1)
        for i in range(len(offsets) - 1):
            yield kernel.shingle_set(hasher, words[edge[i] : edge[i + 1]], k)


def class_of(s) -> int:
    """64-bit name of a shingle set."""
    x = kernel.mix64(s)
    parts = np.array([np.bitwise_xor.reduce(x), x.sum(dtype=np.uint64), len(s)], np.uint64)
    return int(kernel.mix64(kernel.mix64(parts)[:1] ^ kernel.mix64(parts + np.uint64(1))[1:2] ^ parts[2:])[0].astype(np.int64))


def behind(s, order):
    """Parity by bucket of the set behind each place of its order: (places, PARITY_WORDS) words of bits."""

    def bits(x):
        out = np.zeros((len(x), PARITY_WORDS), np.uint64)
        out[np.arange(len(x)), ((x >> np.uint64(6)) & np.uint64(PARITY_WORDS - 1)).astype(np.int64)] = np.uint64(1) << (x & np.uint64(63))
        return out

    whole = np.packbits(np.bincount((s & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS).astype(np.uint8) & 1, bitorder="little").view("<u8")
    return np.bitwise_xor.accumulate(bits(s[order]), 0) ^ whole if len(order) else np.zeros((0, PARITY_WORDS), np.uint64)


def prefixes(docs: DataFrame, id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(id, th, n, cls, places, tokens, suffix0..3): set size, class, and the shingles of its prefix, rarest
    in the corpus first, that stand in another row too, with their places and the parity, by bucket, of what lies behind each.

    Document counts come from the packed exchange over the whole corpus, with
    few spare bits: a count that is too high by chance spoils no result.
    """
    kind = docs.schema[id].dataType.simpleString()
    x = docs.select(col(id).alias("id"), F.xxhash64(col(text)).alias("th"), col(text).alias("text"))
    blocked, block, layout = packed.in_blocks(x, "text", 0.16, 10)
    schema = f"id {kind}, th long, n long, cls long, places array<int>, tokens array<long>, {', '.join(f'suffix{i} array<long>' for i in range(PARITY_WORDS))}"

    def ask(table):
        sets = list(doc_sets(kernel.Hasher(True), table.column("text"), k))
        return np.unique(layout.cut(np.concatenate([np.zeros(0, np.uint64), *sets])), return_counts=True)

    def make(table: pa.Table, told: pa.Table) -> pa.Table:
        sets = list(doc_sets(kernel.Hasher(True), table.column("text"), k))
        keys, inverse, counts = np.unique(layout.cut(np.concatenate([np.zeros(0, np.uint64), *sets])), return_inverse=True, return_counts=True)
        df = (counts + packed.added(told))[inverse] if len(keys) else np.zeros(0, np.int64)
        sizes, classes, suffix, cut, places, tokens, lo = [], [], [], [0], [], [], 0
        for s in sets:
            n, own = len(s), df[lo : lo + len(s)]
            lo += n
            sizes.append(n)
            classes.append(class_of(s) if n else 0)
            order = np.lexsort((s, own))[: n - -(-num * n // den) + 1 if n else 0]
            at = np.flatnonzero(own[order] > 1)
            places.append(at)
            tokens.append(s[order[at]])
            suffix.append(behind(s, order)[at])
            cut.append(cut[-1] + len(at))
        cut = pa.array(cut, pa.int32())
        lists = lambda parts, t, kind: pa.ListArray.from_arrays(cut, pa.array(np.concatenate([np.zeros(0, t), *parts]).view(kind)))
        suffix = [lists([x[:, i] for x in suffix], np.uint64, np.int64) for i in range(PARITY_WORDS)]
        columns = [table.column("id"), table.column("th"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists([x.astype(np.int32) for x in places], np.int32, np.int32), lists(tokens, np.uint64, np.int64), *suffix]
        return pa.table(columns, ["id", "th", "n", "cls", "places", "tokens", *SUFFIX])

    told = packed.count_all(blocked, block, layout, ask)
    return blocked.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(make, schema)


def verified(pairs: DataFrame, base: DataFrame, docs: DataFrame, text: str, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity, each counted once from whole texts."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    source = shared_table(base.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("th").alias("th")))
    wanted = source.select("th").distinct()
    if source.count() <= BROADCAST_ROWS:
        wanted = broadcast(wanted)

    def sets(batches):
        hasher = kernel.Hasher(True)
        for batch in batches:
            found = list(doc_sets(hasher, batch.column(0), k))
            cut = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) if len(s) else 0 for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))],
                ["cls", "set"],
            )

    texts = docs.select(col(text).alias("text"), F.xxhash64(col(text)).alias("th")).join(wanted, "th", "left_semi")
    s = texts.select("text").mapInArrow(sets, "cls long, set array<long>").groupBy("cls").agg(F.first("set").alias("set"))
    both = pairs.join(s.withColumnsRenamed({"cls": "b", "set": "sb"}), "b").join(s.withColumnsRenamed({"cls": "a", "set": "sa"}), "a")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(den * same >= num * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def close(num: int, den: int, one: str, two: str, first: bool):
    """Length, positional and suffix filters on two postings of a shared shingle, ``first`` if no earlier one is shared.

    A link needs an overlap of at least ``least``.  Lengths bound it; so do the
    words that can still agree from the shared place on; and so do the suffixes behind the
    place, in which each bucket of differing parity holds a shingle that isn't shared.
    What lies before a place that isn't the first shared one counts as shared as far as it can.
    """
    a, b = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{two}.{c}"))
    both = a("n") + b("n")
    least = (num * both + F.pmod(-num * both, F.lit(num + den))) / (num + den)
    length = (den * a("n") >= num * b("n")) & (den * b("n") >= num * a("n"))
    place = F.least(a("n") - a("i"), b("n") - b("i")) >= least
    apart = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in SUFFIX), F.lit(0))
    before = F.lit(0) if first else F.least(a("i"), b("i"))
    return length & place & (both - a("i") - b("i") - apart + 2 * before >= 2 * least)


def ngram_join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles of num / den or more.

    Words are lower-cased in A-Z; a set holds the distinct ``k``-word shingles,
    with fewer words the whole sequence; without words it is empty and links
    with nothing.  Sets are ordered by rarity over the whole corpus, and only
    prefixes are joined, behind length, positional and suffix filters.
    Documents of equal sets form one class beforehand.  Each shared shingle
    first links its classes to one of them, drawn by lot (a star, so as many pairs
    as postings), and only classes that are still apart then are paired, all of
    them; every pair is verified once, on whole texts.

    Returns id, n_shingles, class_id (smallest id of an equal set) and
    component_id (smallest id reachable by links), one row per row of
    ``docs``.  Null ids keep their rows, and are a group's id only if it has no
    other; repeated rows are equal sets.  Classes are told apart by 64-bit
    hashes.
    """
    base = shared_table(prefixes(docs, id, text, k, num, den))
    marks = ["places", "tokens", *SUFFIX]
    classes = base.where("n > 0").groupBy("cls").agg(F.first(F.struct("n", *marks)).alias("c")).select("cls", "c.*")
    posts = classes.select("cls", "n", F.explode(F.arrays_zip(*marks)).alias("t")).select("cls", "n", F.col("t.places").alias("i"), F.col("t.tokens").alias("token"), *(F.col(f"t.{c}") for c in SUFFIX))
    shared = posts.groupBy("token").count().where("count > 1").select("token")
    own = posts.join(shared, "token", "left_semi").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("i", "token", *SUFFIX))).alias("tokens"))
    own = shared_table(own)
    posts = own.select("cls", "n", F.col("tokens.token").alias("all"), F.posexplode("tokens").alias("at", "t")).select(
        "cls", "n", "t.*", F.slice("all", F.lit(1), F.col("at")).alias("before")
    )
    head = posts.groupBy("token").agg(F.min(F.struct(F.xxhash64("cls", "token").alias("lot"), "cls", "n", "i", *SUFFIX)).alias("h")).select("token", "h.*")
    near = close(num, den, "p", "h", False)
    star = posts.alias("p").join(head.alias("h"), (F.col("p.token") == F.col("h.token")) & (F.col("p.cls") != F.col("h.cls")) & near)
    star = shared_table(star.select(F.least("p.cls", "h.cls").alias("a"), F.greatest("p.cls", "h.cls").alias("b")).distinct())
    links = shared_table(verified(star, base, docs, text, k, num, den))
    rooted = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    posts = posts.join(rooted.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    apart = posts.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token")
    posts = posts.join(apart, "token", "left_semi")
    pair = (F.col("p.token") == F.col("h.token")) & (F.col("p.cls") < F.col("h.cls")) & (F.col("p.root") != F.col("h.root")) & close(num, den, "p", "h", True) & ~F.arrays_overlap("p.before", "h.before")
    rest = posts.alias("p").join(posts.alias("h"), pair).select(F.col("p.cls").alias("a"), F.col("h.cls").alias("b"))
    rest = shared_table(rest.join(star, ["a", "b"], "left_anti"))
    more = verified(rest, base, docs, text, k, num, den)
    edges = rooted.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    final = components(edges)
    drop_tables(own, star, links, rest)
    named = base.groupBy("cls").agg(F.min("id").alias("class_id"))
    named = named.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "class_id", "component_id")
    full = base.select("id", "n", "cls").join(named, "cls")
    alone = F.col("n") == 0
    return full.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
