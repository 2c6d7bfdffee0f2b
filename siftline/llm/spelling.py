"""Spelling variants: words of the corpus grouped by one edit."""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_tables, shared_table

#: Letters are A-Z, a-z and U+00C0 to U+00FF, in UTF-8 the bytes after C3.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LETTER = re.compile(rb"[A-Za-z\xc3\x80-\xbf]*")
#: Bytes of a text handled at a time, and distinct words that a task holds before it passes them on.
PIECE_BYTES, HELD_WORDS = 4 << 20, 400_000
#: Index rows of one segment that a task meets; more are dealt to further tasks.
SEGMENT_ROWS = 4096


def pieces(text: bytes):
    """Parts of about PIECE_BYTES, none of which ends inside a run of letters."""
    lo = 0
    while lo < len(text):
        hi = LETTER.match(text, lo + PIECE_BYTES).end() if lo + PIECE_BYTES < len(text) else len(text)
        yield text[lo:hi]
        lo = hi


def without(run: bytes, place: int) -> bytes:
    """``run`` without the code point at ``place``."""
    s = run.decode()
    return (s[:place] + s[place + 1 :]).encode()


def word_counts(docs: DataFrame, id: str, text: str, least_length: int, least_count: int, misspell: int | None) -> DataFrame:
    """(word, n) of the words of all texts; see ``spelling_variants``."""

    def count(batches):
        held = Counter()

        def rows():
            long_enough = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= least_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in long_enough], pa.string()), pa.array([n for _, n in long_enough], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                value = value.as_buffer()
                for piece in pieces(value.to_pybytes() if value else b""):
                    found = Counter(RUN.findall(piece.lower()))
                    if misspell:
                        for w, n in list(found.items()):
                            h = zlib.crc32(w, start)
                            if h % misspell == 0:
                                del found[w]
                                # a run that another is turned into may stand in the piece too
                                w = without(w, h % (len(w) - w.count(b"\xc3")))
                                held[w] += n
                    held.update(found)
                    if len(held) > HELD_WORDS:
                        yield rows()
        yield rows()

    counted = docs.select(col(id).cast("string"), col(text).cast("binary")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def segment(word: Column, number: int, length: Column, shift=0) -> Column:
    """Segment 1 or 2 of the even partition of words of ``length``, read from ``word`` at ``shift``."""
    half = F.floor(length / 2).cast("int")
    return F.substring(word, F.lit(1 + shift), half) if number == 1 else F.substring(word, half + 1 + shift, length - half)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of words that one edit parts, once.

    Words are cut into two halves, and one edit leaves one of them whole.  The
    halves are the index, by length, number and letters.  A word looks up its
    own halves among words of its length, and among words one shorter the
    halves that an added letter leaves: the first at its place, the second a
    place further right.  A pair is found by one half alone, unless a letter
    stands between both; then the first finds it.  Segments of more than
    SEGMENT_ROWS words are split: their probes are dealt to several tasks, to each of
    which their index rows go.
    """
    w, n, long = F.col("word"), F.col("n"), F.length("word")
    entry = lambda number, length, shift, longer: F.struct(length.alias("length"), F.lit(number).alias("number"), segment(w, number, length, shift).alias("letters"), F.lit(longer).alias("longer"))
    own = [entry(1, long, 0, False), entry(2, long, 0, False)]
    index = words.select(w.alias("a"), n.alias("n_a"), F.explode(F.array(*own)).alias("k")).select("a", "n_a", "k.length", "k.number", "k.letters")
    probes = words.select(w.alias("b"), n.alias("n_b"), F.explode(F.array(*own, entry(1, long - 1, 0, True), entry(2, long - 1, 1, True))).alias("k")).select("b", "n_b", "k.*")
    key = ["length", "number", "letters"]
    hot = shared_table(index.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > SEGMENT_ROWS))
    if hot.isEmpty():
        index, probes = index.withColumn("lot", F.lit(0)), probes.withColumn("lot", F.lit(0))
    else:
        lots = F.coalesce(F.ceil(F.col("size") / SEGMENT_ROWS).cast("int"), F.lit(1))
        index = index.join(hot, key, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("size")
        probes = probes.join(hot, key, "left").withColumn("lot", F.pmod(F.xxhash64("b"), lots).cast("int")).drop("size")
    half = F.floor(F.col("length") / 2).cast("int")
    one_edit = F.levenshtein("a", "b", 1) == 1
    once = F.when(F.col("longer"), (F.col("number") == 1) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))).otherwise(F.col("a") < F.col("b"))
    return index.join(probes, [*key, "lot"]).where(once & one_edit).select("a", "b", "n_a", "n_b")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, root), each root followed to its last: a step doubles the links followed."""
    now = shared_table(forms)
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = shared_table(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        more = not new.where("moved").isEmpty()
        drop_tables(now)
        now = new.select("word", "root")
        if not more:
            return now


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2, misspell: int | None = None) -> DataFrame:
    """Each frequent word of the corpus with the more frequent spelling it may stand for.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased,
    of at least ``least_length`` letters and ``least_count`` occurrences in all
    texts.  Two are near if one letter put in, left out or replaced parts them.
    A word's form is its near word of largest count (ties: smallest by code
    point), if that is at least ``ratio`` times its own; its root is where forms
    lead in the end.  ``misspell`` plants errors to measure by: where it divides
    the CRC-32 h of ``<id>:<run>``, the run loses its letter h % length.

    Returns word, form, root, n, n_near, form_n, a row a word.  Null and empty
    texts have no words, a null id reads as empty, repeated rows count each, and other
    columns play no part.
    """
    words = shared_table(word_counts(docs, id, text, least_length, least_count, misspell))
    pairs = near_pairs(words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    near = pairs.select(F.explode(ways).alias("p")).select("p.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    formed = words.join(best, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    formed = shared_table(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    drop_tables(words)
    roots = last_forms(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

