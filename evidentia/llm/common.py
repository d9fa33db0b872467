"""Helpers shared by the corpus operators: vectorised tokenising and hashing of Arrow text batches, and shared storage."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_root

#: Bytes that end a word: space and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once inside a Python worker; one text is never split.
BLOCK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(base: int, n: int, slot: int) -> np.ndarray:
    if len(_powers[slot]) < n:
        steps = np.full(max(n, BLOCK_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        _powers[slot] = np.multiply.accumulate(steps)
    return _powers[slot][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(column: pa.ChunkedArray | pa.Array, limit: int = BLOCK_BYTES):
    """Yield (first row, last row, bytes, offsets from 0) of runs of rows of about `limit` bytes; null texts are empty."""
    for chunk, base in _chunks(column):
        n = len(chunk)
        if not n:
            continue
        wide = pa.types.is_large_string(chunk.type)
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = chunk.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield base + i, base + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def _chunks(column):
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not (pa.types.is_string(chunk.type) or pa.types.is_large_string(chunk.type)):
            chunk = chunk.cast(pa.string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        yield chunk, base
        base += len(chunk)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes that aren't white space; rows never share a word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = ~WHITE[data]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = ink[at]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = ink[last]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, equal for equal bytes wherever they stand: differences of one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_ODD, len(data), 0), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INV, len(data), 1)[starts] + (ends - starts).astype(np.uint64))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the storage that all executors share, the session's spark.checkpoint.dir."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch to or from a Python worker, where the session has Spark's own default of 64 MB.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Let the session send batches of BATCH_BYTES: a task holds several at once, on either side. A session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m", "64MB", "67108864"):
        spark.conf.set(name, BATCH_BYTES)


def tidy(run):
    """run, for mapInArrow, giving the memory that it no longer uses back to the system when it ends: an idle Python worker would keep it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows as a table written to shared storage, so that later steps neither recompute them nor depend on an executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Texts, null ones as empty, as compressed UTF-8: less to write and to shuffle."""
    import zstandard

    packer, out = zstandard.ZstdCompressor(level=1), []
    for _, _, data, offsets in blocks(column):
        raw = data.tobytes()
        out += [packer.compress(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    """The texts that packed() made of them."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    return pa.array([unpacker.decompress(x) for x in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


#: Bits of an id filter: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame, column: str):
    """A function (table, its id column, held) that gives the rows whose ids the filter holds, or else all others; two more arguments hand their batches to a function, and name its schema, within the same worker.

    A Bloom filter of FILTER_BITS bits, put together by an aggregation of at most FILTER_BITS / 64 rows and broadcast; it
    holds all ids of the table and few others. Rows that it turns away need not be shuffled for a join on the ids; with far
    more ids than bits it turns none away, and the join, which decides in any case, does without.
    """
    hashes = lambda c: [F.xxhash64(F.lit(k), c.cast("bigint")).bitwiseAND(FILTER_BITS - 1) for k in (1, 2)]
    one, two = hashes(F.col(column))
    places = F.array(*((one + two * k).bitwiseAND(FILTER_BITS - 1) for k in range(4)))
    words = ids.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(table)

    def rows(df: DataFrame, id_column: str, held: bool, then=None, schema=None) -> DataFrame:
        width = len(df.columns)

        def chosen(batches):
            own = shared.value
            for batch in batches:
                h, step = (batch.column(width + k).to_numpy() for k in (0, 1))
                found = np.full(batch.num_rows, True)
                for k in range(4):
                    at = (h + step * k) & (FILTER_BITS - 1)
                    found &= (own[at >> 6] >> (at & 63)) & 1 == 1
                yield batch.select(list(range(width))).filter(pa.array(found == held))

        run = (lambda batches: then(chosen(batches))) if then else chosen
        one, two = hashes(F.col(id_column))
        return df.select(*(F.col(f"`{c}`") for c in df.columns), one.alias("__one"), two.alias("__two")).mapInArrow(tidy(run), schema or df.schema)

    return rows


def columns(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns: others, whatever their names, can't clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in wanted))
