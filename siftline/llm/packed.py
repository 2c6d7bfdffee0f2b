"""Counting hashes across the corpus in packed form.

Documents are dealt to blocks of some megabytes.  A block sends, for each hash
partition, one row with the sorted distinct hashes it holds (delta-coded) and
their counts; a partition adds up the rows of all blocks and answers each block
with the totals of those hashes that occur outside it too.  A hash thus costs
about five bytes a block however often it occurs, and a hot one is one entry a
block.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

ROW = "part long, block long, keys binary, counts binary"
ROW_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOCK_BYTES = 6 << 20
PART_KEYS = 1 << 21


class Layout:
    """Number of blocks, of hash partitions, and of hash bits kept.

    With ``spare`` bits, a hash agrees by chance with one of the others in
    about one of 2**spare cases.
    """

    def __init__(self, total_bytes: int, hashes_a_byte: float, spare: int = 64):
        total = max(1, int(total_bytes * hashes_a_byte))
        self.blocks = max(1, math.ceil(total_bytes / BLOCK_BYTES))
        self.part_bits = max(0, math.ceil(math.log2(total / PART_KEYS))) if total > PART_KEYS else 0
        self.bits = min(64, spare + math.ceil(math.log2(total + 1)))

    def cut(self, hashes):
        return hashes >> np.uint64(64 - self.bits)


def pack_ints(x) -> bytes:
    """Non-negative integers, byte by byte of equal place: the low bytes, which are as good as random, as they are, the rest compressed."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    plain = max(0, min(width, (int(x.mean()).bit_length() - 1) // 8)) if len(x) else 0
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    rest = pa.compress(planes[plain:].tobytes(), codec="zstd", asbytes=True) if plain < width and len(x) else b""
    return bytes([width, plain]) + len(x).to_bytes(8, "little") + planes[:plain].tobytes() + rest


def unpack_ints(b: bytes):
    width, plain, n = b[0], b[1], int.from_bytes(b[2:10], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        at = 10 + plain * n
        rest = pa.decompress(b[at:], (width - plain) * n, codec="zstd", asbytes=True) if plain < width else b""
        out[:, :width] = np.frombuffer(b[10:at] + rest, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def pack_sorted(x) -> bytes:
    """Sorted distinct integers: the first, then the differences."""
    return int(x[0]).to_bytes(8, "little") + pack_ints(np.diff(x))


def unpack_sorted(b: bytes):
    d = unpack_ints(b[8:])
    out = np.empty(len(d) + 1, np.uint64)
    out[0] = int.from_bytes(b[:8], "little")
    np.cumsum(d, out=out[1:])
    out[1:] += out[0]
    return out


def send(layout: Layout, block: int, keys, counts):
    """Rows of a block's sorted distinct keys."""
    edges = np.arange(1, 1 << layout.part_bits, dtype=np.uint64) << np.uint64(layout.bits - layout.part_bits)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(p, block, pack_sorted(keys[i:j]), pack_ints(counts[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROW_ARROW)], schema=ROW_ARROW) if rows else pa.RecordBatch.from_pylist([], ROW_ARROW)


def answer(table: pa.Table) -> pa.Table:
    """Totals for one partition, to each block those that exceed its own."""
    blocks, keys, counts = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
    keys, counts = [unpack_sorted(k) for k in keys], [unpack_ints(c).astype(np.int64) for c in counts]
    at = np.cumsum([0, *map(len, keys)])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)[inverse]
    part, rows = table.column("part")[0].as_py(), []
    for b, k, c, i, j in zip(blocks, keys, counts, at, at[1:]):
        t = total[i:j]
        if (more := t > c).any():
            rows.append((part, b, pack_sorted(k[more]), pack_ints(t[more])))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROW_ARROW)], schema=ROW_ARROW) if rows else ROW_ARROW.empty_table()


def answer_all(table: pa.Table) -> pa.Table:
    """For one partition, what others add to each count of each block, in the block's own order."""
    blocks, keys, counts = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
    keys, counts = [unpack_sorted(k) for k in keys], [unpack_ints(c).astype(np.int64) for c in counts]
    at = np.cumsum([0, *map(len, keys)])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate(counts)
    more = np.bincount(inverse, own).astype(np.int64)[inverse] - own
    part = table.column("part")[0].as_py()
    rows = [(part, b, b"", pack_ints(more[i:j])) for b, i, j in zip(blocks, at, at[1:])]
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROW_ARROW)], schema=ROW_ARROW)


def added(table: pa.Table):
    """What others add to a block's counts, for all of its sorted keys."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("counts").to_pylist()))
    return np.concatenate([np.zeros(0, np.int64), *(unpack_ints(c).astype(np.int64) for _, c in rows)])


class Totals:
    """What a block has been told: totals of the keys that others have too."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table.column("part").to_pylist(), table.column("keys").to_pylist(), table.column("counts").to_pylist()))
        self.keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(k) for _, k, _ in rows)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(unpack_ints(c).astype(np.int64) for _, _, c in rows)])

    def of(self, keys, counts):
        """Corpus-wide counts of ``keys``, of which the block has ``counts``."""
        out = counts.astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.counts[at[hit]]
        return out


def in_blocks(docs: DataFrame, text: str, hashes_a_byte: float, spare: int = 64) -> tuple[DataFrame, str, Layout]:
    """``docs`` with a block number, its name, and the layout for their size."""
    size = docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    layout = Layout(size, hashes_a_byte, spare)
    block, = fresh(docs, "block")
    number = F.pmod(F.xxhash64(*(col(c) for c in docs.columns)), F.lit(layout.blocks))
    return docs.withColumn(block, number), block, layout


def count_round(docs: DataFrame, block: str, layout: Layout, extract, told: DataFrame | None = None) -> DataFrame:
    """One exchange: ``extract(table, totals)`` gives a block's hashes, repeats included."""

    def ask(table: pa.Table, totals) -> pa.Table:
        if not len(table):
            return ROW_ARROW.empty_table()
        keys, counts = np.unique(layout.cut(extract(table, totals)), return_counts=True)
        return pa.Table.from_batches([send(layout, table.column(block)[0].as_py(), keys, counts)])

    if told is None:
        sent = docs.groupBy(block).applyInArrow(lambda table: ask(table, None), ROW)
    else:
        sent = docs.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(lambda table, t: ask(table, Totals(t)), ROW)
    return sent.groupBy("part").applyInArrow(answer, ROW)


def count_all(docs: DataFrame, block: str, layout: Layout, extract, told: DataFrame | None = None) -> DataFrame:
    """One exchange that answers every key: ``extract(table)``, or ``extract(table, told)``, gives sorted keys, cut, and their counts."""

    def ask(table: pa.Table, *more) -> pa.Table:
        if not len(table):
            return ROW_ARROW.empty_table()
        keys, counts = extract(table, *more)
        return pa.Table.from_batches([send(layout, table.column(block)[0].as_py(), keys, counts)])

    sent = docs.groupBy(block).applyInArrow(lambda table: ask(table), ROW) if told is None else docs.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(lambda table, t: ask(table, t), ROW)
    return sent.groupBy("part").applyInArrow(answer_all, ROW)
