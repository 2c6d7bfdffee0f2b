"""Token ids of documents in compressed shard files with an offset index."""

import hashlib
import json
import os
import re
import struct
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import col, drop_tables, shared_table

#: White space as the tokenizer's pattern has it.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of Latin-1 that spell words, and what may be a letter too.
LATIN, OTHER = "A-Za-zÀ-ÖØ-öø-ÿ", "ªµºĀ-\U0010ffff"
#: Pieces that no token of a byte-level pattern reaches out of: a word, with a space before it, that ends where no letter
#: follows; a line break before a word; or all ink up to white space, with the white space before it.
PIECE = re.compile(f" ?[{LATIN}]++(?![{OTHER}])|\n(?= ?[{LATIN}])|[{WS}]*[^{WS}]+|[{WS}]+")
BORDER = re.compile(f"(?<=[^{WS}])(?=[{WS}])")
#: Pieces that the pattern takes as one word.
WORD = re.compile(f" ?[{LATIN}]+")
#: Characters of a text handled at a time; pieces held, and the longest such.
PART_CHARS, HELD_PIECES, HELD_CHARS = 4 << 20, 400_000, 48
#: Documents, of at most so many bytes of text, that the dictionary is trained on, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16 << 10, 64 << 10
#: Compressed bytes of a shard, about.
SHARD_BYTES = 128 << 20
LEVEL = 3
#: Fixed values of the file format: start and end mark; header: mark, version, bytes of an id, SHA-256 of the dictionary; trailer: place of the index, documents, ids, mark.
MARK = b"STOK"
HEADER, TRAILER = "<4sHH32s", "<QQQ4s"
HEADER_BYTES, TRAILER_BYTES = struct.calcsize(HEADER), struct.calcsize(TRAILER)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Held(dict):
    """Ids of pieces of text, as bytes; a new piece is encoded, and held if it is short."""

    def __init__(self, tokenizer: Tokenizer, type: str):
        super().__init__()
        self.tokenizer, self.type, self.stands = tokenizer, type, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        if WORD.fullmatch(piece):
            spelt = piece.replace(" ", self.stands[32]) if piece.isascii() else "".join([self.stands[b] for b in piece.encode()])
            ids = [t.id for t in self.tokenizer.model.tokenize(spelt)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        out = array(self.type, ids).tobytes()
        if len(piece) <= HELD_CHARS:
            if len(self) >= HELD_PIECES:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Ids of whole texts, as bytes, little-endian.

    A byte-level BPE without normaliser is asked for each distinct piece of
    text once while it is held; any other tokenizer for each text.
    """

    def __init__(self, vocabulary: str, width: int, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.type, self.end = {2: "H", 4: "I"}[width], self.put(width, [end_id])
        self.width, self.held = width, Held(self.tokenizer, self.type)
        spec = json.loads(vocabulary)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens") or []
        self.by_piece = (
            model.get("type") == "BPE" and not model.get("dropout") and spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding")
            and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{WS}]|^[{LATIN}]", t["content"]) for t in added)
        )

    @staticmethod
    def put(width: int, ids) -> bytes:
        return array({2: "H", 4: "I"}[width], ids).tobytes()

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.held.__getitem__, PIECE.findall(text)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_piece:
            return array(self.type, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        if len(text) <= PART_CHARS:
            return self.pieces(text) + self.end
        out, lo = [], 0
        while lo < len(text):
            border = BORDER.search(text, lo + PART_CHARS)
            hi = border.start() if border else len(text)
            out.append(self.pieces(text[lo:hi]))
            lo = hi
        return b"".join(out) + self.end


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str, width: int, end_id: int) -> Encoder:
    """The encoder of a Python worker, kept with the pieces it holds for the tasks that follow."""
    return Encoder(vocabulary, width, end_id)


def sampled(docs: DataFrame) -> list[str]:
    """Texts of about SAMPLE_DOCS documents of at most SAMPLE_BYTES, those of least hash of id and text; fewer if there aren't as many."""
    size = F.octet_length("text")
    short = docs.where((size > 0) & (size <= SAMPLE_BYTES))
    n = short.count()
    least = -(1 << 63) + min((1 << 64) - 1, (SAMPLE_DOCS << 64) // max(n, 1))
    few = short.where(F.xxhash64("id", "text") <= F.lit(least))  # so that tasks send few to the driver
    return [r["text"] for r in few.select("text").orderBy("text").limit(2 * SAMPLE_DOCS).collect()]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of serialized id arrays; too few of them are its content themselves."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def shared(dictionary: bytes):
    """The dictionary for (de)compressors, None if empty."""
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def opened(folder: str):
    """(file system, path) of a folder that all executors reach."""
    return pyarrow.fs.FileSystem.from_uri(folder)


class Shard:
    """One shard file: header, a zstandard frame a document, index, trailer.

    The index has three arrays of 8-byte integers: places of the frames (one more than
    documents), ids before each (one more as well), and document ids, followed by
    a byte a document that is 1 where its id is null.
    """

    def __init__(self, file, dictionary: bytes):
        self.file, size = file, file.size()
        mark, version, self.width, held = struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))
        at, self.docs, self.ids, end = struct.unpack(TRAILER, file.read_at(TRAILER_BYTES, size - TRAILER_BYTES))
        if mark != MARK or end != MARK or version != 1:
            raise ValueError("not a whole shard of token ids")
        if held != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was compressed with another dictionary")
        index = file.read_at(size - TRAILER_BYTES - at, at)
        n = self.docs
        numbers = np.frombuffer(index, "<i8", 3 * n + 2)
        self.place, self.start, self.names = numbers[: n + 1], numbers[n + 1 : 2 * n + 2], numbers[2 * n + 2 :]
        self.null = np.frombuffer(index, np.uint8, n, 8 * (3 * n + 2)).astype(bool)
        self.plain = zstandard.ZstdDecompressor(dict_data=shared(dictionary))

    def get(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the shard, from its frame alone."""
        frame = self.file.read_at(int(self.place[i + 1] - self.place[i]), int(self.place[i]))
        raw = self.plain.decompress(frame, max_output_size=int(self.start[i + 1] - self.start[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, write them as shard files in ``folder`` and return the table of shards.

    ``vocabulary`` is the path of a tokenizer file, ``end_id`` the id put behind
    each document.  Ids are serialized in 2 or 4 bytes, as the vocabulary
    needs.  A dictionary is trained on at most SAMPLE_DOCS documents of up to SAMPLE_BYTES;
    each document is compressed alone with it.  Compressed documents are ranged
    by id, ties by content, and each range becomes a file of about SHARD_BYTES; a null
    or empty text has the end id alone, null ids come last, ids are integers,
    and other columns play no part.

    A task writes a file under a name of its own; only files that the table
    ``shards`` lists count, so that a task run twice does no harm, and what
    lost tasks left behind is deleted in the end.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spelt = f.read()
    tokenizer = Tokenizer.from_str(spelt)
    width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    told = spark.sparkContext.broadcast(spelt)
    docs = docs.select(col(id).cast("long").alias("id"), col(text).alias("text"))
    encoder = Encoder(spelt, width, end_id)
    dictionary = train_dictionary([encoder(x) for x in sampled(docs)])
    digest = hashlib.sha256(dictionary).digest()
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)

    def encode(batches):
        encoder = encoder_of(told.value, width, end_id)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared(dictionary), write_checksum=True)
        for batch in batches:
            n, frames = [], []
            for value in batch.column(1):
                ids = encoder(value.as_py())
                n.append(len(ids) // width)
                frames.append(packer.compress(ids))
            size = [len(f) for f in frames]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(frames, pa.binary())], ["id", "n", "size", "frame"])

    packed = docs.mapInArrow(encode, "id long, n long, size long, frame binary")
    packed = shared_table(packed.withColumn("row", F.monotonically_increasing_id()))
    total = packed.agg(F.sum("size")).first()[0] or 0
    order = [F.col("id").asc_nulls_last(), F.col("n"), F.xxhash64("frame"), F.col("row")]
    ordered = packed.repartitionByRange(total // SHARD_BYTES + 1, *order).sortWithinPartitions(*order)

    def write(batches):
        name, out, at = f"tokens-{uuid.uuid4().hex}", None, HEADER_BYTES
        place, count, names = [], [], []
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                files, path = opened(folder)
                out = files.open_output_stream(f"{path}/{name}")
                out.write(struct.pack(HEADER, MARK, 1, width, digest))
            sizes = batch.column(2).to_numpy()
            place.append(at + np.cumsum(sizes) - sizes)
            count.append(batch.column(1).to_numpy())
            names += batch.column(0).to_pylist()
            at += int(sizes.sum())
            for frame in batch.column(3):
                out.write(frame.as_buffer())
        if out is None:
            return
        place, count = np.append(np.concatenate(place), at), np.concatenate(count)
        start, null = np.append(0, np.cumsum(count)), np.array([x is None for x in names])
        known = np.array([0 if x is None else x for x in names])
        out.write(b"".join(np.ascontiguousarray(x, "<i8").tobytes() for x in (place, start, known)) + null.astype(np.uint8).tobytes())
        out.write(struct.pack(TRAILER, at, len(names), int(start[-1]), MARK))
        out.close()
        some = known[~null]
        row = {"shard": TaskContext.get().partitionId(), "file": name, "first": int(some[0]) if len(some) else None, "last": int(some[-1]) if len(some) else None, "docs": len(names), "ids": int(start[-1])}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    shards = ordered.mapInArrow(write, "shard long, file string, first long, last long, docs long, ids long").withColumn("dictionary", F.lit(digest.hex()))
    shards.write.mode("overwrite").parquet(f"{folder}/shards")
    drop_tables(packed)
    table = spark.read.parquet(f"{folder}/shards")
    listed = {r["file"] for r in table.select("file").toLocalIterator()}
    for found in files.get_file_info(pyarrow.fs.FileSelector(path)):
        if found.base_name.startswith("tokens-") and found.base_name not in listed:
            files.delete_file(found.path)
    return table


def dictionary_of(files, path: str, name: str) -> bytes:
    with files.open_input_stream(f"{path}/dictionary-{name}") as f:
        return f.read()


#: Documents that a reader passes on at a time, by ids.
BATCH_IDS = 2 << 20


def batches_of(rows):
    """Record batches of (id, start, n_tokens, ids) rows."""
    held, size = [], 0
    names = ["id", "start", "n_tokens", "ids"]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)

    for name, start, ids in rows:
        held.append((name, start, len(ids), ids.tobytes()))
        size += len(ids)
        if size >= BATCH_IDS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


ROW = "id long, start long, n_tokens long, ids binary"


def with_starts(shards: DataFrame) -> DataFrame:
    """The table of shards, a row a file, with the ids before each."""
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of all documents of a folder, read from its files.

    ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the
    ids of all documents before.  A shard is one task's; a file that isn't whole, or
    whose dictionary is another, is an error.
    """
    shards = with_starts(spark.read.parquet(f"{folder}/shards")).select("file", "before", "dictionary")
    n = max(1, shards.count())

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = opened(folder)
                with files.open_input_file(f"{path}/{row['file']}") as f:
                    shard = Shard(f, dictionary_of(files, path, row["dictionary"]))
                    yield from batches_of((None if shard.null[i] else int(shard.names[i]), row["before"] + int(shard.start[i]), shard.get(i)) for i in range(shard.docs))

    return shards.repartition(n).mapInArrow(read, ROW)


def find_tokens(spark: SparkSession, folder: str, wanted: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of ``read_tokens`` whose id is among ``wanted``, from the frames of these documents alone.

    Ids go to the shards whose range holds them; a shard's index names the
    frames.  Ids that no document has give no row, nor do null ones.
    """
    shards = with_starts(spark.read.parquet(f"{folder}/shards")).where("first IS NOT NULL").orderBy("shard").select("file", "before", "dictionary", "first", "last").collect()
    firsts, lasts = np.array([r["first"] for r in shards]), np.array([r["last"] for r in shards])

    def place(batches):
        for batch in batches:
            name = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(lasts, name, "left"), np.searchsorted(firsts, name, "right")
            times = np.maximum(hi - lo, 0)
            shard = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, times), pa.int64()), pa.array(shard, pa.int64())], ["id", "shard"])

    def read(table: pa.Table) -> pa.Table:
        row = shards[table.column("shard")[0].as_py()]
        names = np.unique(table.column("id").to_numpy())
        files, path = opened(folder)
        with files.open_input_file(f"{path}/{row['file']}") as f:
            shard = Shard(f, dictionary_of(files, path, row["dictionary"]))
            hits = np.flatnonzero(np.isin(shard.names, names) & ~shard.null).tolist()
            return pa.Table.from_batches(list(batches_of((int(shard.names[i]), row["before"] + int(shard.start[i]), shard.get(i)) for i in hits)), pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    asked = wanted.select(col(id).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return asked.mapInArrow(place, "id long, shard long").groupBy("shard").applyInArrow(read, ROW)
