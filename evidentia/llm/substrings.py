"""Deduplication of passages by content-defined chunks.

A gear hash (h = 2h + G[byte], 16 bits, so that it depends on the last 16 bytes) rolls over every text. A word end is a cut
where its hash is the least among the word ends within two words on either side. Inside a run of over LONG_WORD bytes without
white space (Chinese, base64, minified code) the beginnings of characters compete in the same way, within REACH of them. A cut
thus depends on the bytes around it alone: text inserted elsewhere shifts no other cut, and a repeated passage is cut alike
wherever it stands, but for its margins. Chunks hold at least three words, about five on average. Only periodic text ("the
the the"), where no hash is the least, leaves chunks of over MAX_CHUNK bytes; those are divided at fixed distances from their
beginning, which is a cut itself.

Chunks are deduplicated by a 64-bit digest. A passage is a run of neighbouring chunks that all occur in several documents
and that has at least `least_bytes` bytes. So a few common words that happen to agree are no passage, and
neither is a collision of digests. Whole chunks are what a run consists of: a repeated passage of 100 bytes holds 60 bytes of
them in nine cases of ten, one of 200 bytes nearly always (tests/llm measures both against brute force).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, blocks, columns, id_filter, keep, tidy

GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)
GEAR[0] = 0
RADIUS = 2
#: Bytes without white space beyond which characters compete, and how many on either side.
LONG_WORD, REACH = 64, 16
MAX_CHUNK = 1024
LEAST_BYTES = 60


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after every byte, by doubling: the hash of 2k bytes joins two of k bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k)
        h = h + shifted
    return h


def _minima(h: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Where h is the least of a full window within its group: less than what follows, and no more than nothing before."""
    least = np.zeros(len(h), bool)
    if len(h) <= 2 * radius:
        return least
    n = len(h) - 2 * radius
    own = h[radius : radius + n]
    least[radius : radius + n] = group[:n] == group[2 * radius :]
    for k in range(1, radius + 1):
        least[radius : radius + n] &= (h[radius - k : radius - k + n] > own) & (h[radius + k : radius + k + n] >= own)
    return least


def _inside_long_words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Cuts inside runs without white space: before a character whose 16 bytes before it, all of its text, have the least hash near by."""
    edge = np.unique(np.concatenate([offsets, np.flatnonzero(white[1:] != white[:-1]) + 1]))
    long_ = np.flatnonzero(np.diff(edge) > LONG_WORD)
    found = []
    for a, b in zip(edge[long_].tolist(), edge[long_ + 1].tolist()):
        if not white[a]:
            low = max(a, int(offsets[np.searchsorted(offsets, a, "right") - 1]) + 16)
            at = low + np.flatnonzero(data[low:b] & 0xC0 != 0x80)
            at = at[at > a]
            found.append(at[_minima(h[at - 1].astype(np.int64), np.zeros(len(at), np.int8), REACH)])
    return found


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the chunks of consecutive texts, in order; empty texts have none."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = WHITE[data]
    end = white.copy()
    end[:-1] &= ~white[1:]  # the last of a run of white space
    at = np.flatnonzero(end)
    row = np.searchsorted(offsets, at, "right") - 1
    # A window may not reach into the text before: what stands there counts as bytes of hash 0.
    every = gear_hashes(data)
    h = every[at].astype(np.int64)
    near = np.flatnonzero(at - offsets[row] < 15)
    for k in near.tolist():
        a = int(offsets[row[k]])
        value = 0
        for c in data[a : at[k] + 1].tolist():
            value = (value << 1) + int(GEAR[c]) & 0xFFFF
        h[k] = value
    least = _minima(h, row, RADIUS)
    bounds = np.unique(np.concatenate([offsets, at[least] + 1, *_inside_long_words(data, offsets, white, every)]))
    begins, ends = bounds[:-1], bounds[1:]
    long_ = ends - begins > MAX_CHUNK
    if long_.any():
        extra = []
        for a, b in zip(begins[long_].tolist(), ends[long_].tolist()):
            p = a + MAX_CHUNK
            while p < b:
                q = p
                while q > p - 4 and data[q] & 0xC0 == 0x80:  # never inside a character
                    q -= 1
                extra.append(q)
                p += MAX_CHUNK
        bounds = np.unique(np.concatenate([bounds, np.array(extra, np.int64)]))
        begins, ends = bounds[:-1], bounds[1:]
    return begins, ends


def chunks(docs: DataFrame, place: bool = True) -> DataFrame:
    """(doc_id, digest) of every chunk; with `place` also (text_nth, at_size): the text's 32-bit hash and the chunk's number in it, and its byte range, each pair as one number.

    Rows of a batch that are equal in doc_id and text are cut once.
    """

    def run(batches):
        for batch in batches:
            keys, names = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            _, first = np.unique(np.stack([keys.astype(np.int64), names]), axis=1, return_index=True)
            if len(first) < len(keys):
                once = np.sort(first)
                batch, keys, names = batch.take(pa.array(once)), keys[once], names[once]
            for i, j, data, offsets in blocks(batch.column(2)):
                begins, ends = cuts(data, offsets)
                row = np.searchsorted(offsets, begins, "right") - 1
                raw, hash_ = data.tobytes(), xxhash.xxh3_64_intdigest
                digest = np.fromiter((hash_(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins)).view(np.int64)
                out = {"doc_id": pa.array(keys[i:j][row].astype(np.int64)), "digest": pa.array(digest)}
                if place:
                    head = np.searchsorted(row, np.arange(j - i))
                    out["text_nth"] = pa.array((names[i:j][row] << 32) + np.arange(len(row)) - head[row])
                    out["at_size"] = pa.array(((begins - offsets[row]) << 32) + ends - begins)
                yield pa.RecordBatch.from_pydict(out)

    source = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("name"), "text").where("doc_id is not null and length(text) > 0")
    return source.mapInArrow(tidy(run), "doc_id bigint, digest bigint" + ", text_nth bigint, at_size bigint" * place)


def passages(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, at, size, n_chunks, first_doc_id, removable) of every passage that several documents hold.

    at and size are bytes of the UTF-8 text; text_hash (Spark's hash of it) tells apart the texts of rows that share a
    doc_id. Every document that holds a passage has its row. The chunks of a passage whose least doc_id is the document's
    own are its first copy; a run of those and a run of later copies are told apart by `removable`, and both count towards
    the length that makes a passage. first_doc_id is the least document of the run's chunks. Rows whose doc_id or text is
    null, and empty texts, hold none; rows that share a doc_id are one document, which repeats nothing by itself, and those
    equal in text too are one row. Ties between copies go to the least doc_id. Texts of any length are read whole; an empty
    table gives no rows; other columns are ignored.
    """
    # Digests are random, so that a hot one is all that map-side combining can shrink, and what it must.
    common = chunks(docs, place=False).groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id")).where("first_doc_id <> last_doc_id").select("digest", "first_doc_id")
    found = chunks(docs).join(common, "digest").select(
        "doc_id", F.shiftright("text_nth", 32).cast("int").alias("text_hash"), (F.col("text_nth").bitwiseAND((1 << 32) - 1)).cast("int").alias("nth"),
        F.shiftright("at_size", 32).cast("int").alias("at"), F.col("at_size").bitwiseAND((1 << 32) - 1).cast("int").alias("size"), "first_doc_id", (F.col("first_doc_id") != F.col("doc_id")).alias("removable"),
    )
    # One exchange by text serves all windows and the last grouping.
    text = ["doc_id", "text_hash"]
    order = Window.partitionBy(*text).orderBy("nth")
    once = found.withColumn("before", F.lag("nth").over(order)).where("before is null or before <> nth").drop("before")
    runs = once.withColumn("run", F.col("nth") - F.row_number().over(order))
    runs = runs.withColumn("run_bytes", F.sum("size").over(Window.partitionBy(*text, "run"))).where(F.col("run_bytes") >= least_bytes)
    side = runs.withColumn("part", F.col("nth") - F.row_number().over(Window.partitionBy(*text, "run", "removable").orderBy("nth")))
    return (
        side.groupBy(*text, "run", "removable", "part")
        .agg(F.min("at").alias("at"), F.sum("size").cast("int").alias("size"), F.count("*").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
        .select(*text, "at", "size", "n_chunks", "first_doc_id", "removable")
    )


def without_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """docs with every later copy of a passage cut out of its text, and n_chars, if there is such a column, brought up to date.

    A document left blank by a cut goes; all others stay, with docs' own columns. Cuts are made in the text that they were
    found in: rows that share a doc_id and differ in text keep their own. Rows without a doc_id are left as they are, as
    are null and empty texts; repeated rows are cut alike; an empty table gives no rows.
    """
    found = passages(docs, least_bytes).where("removable").groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_hash").alias("__cut_text")).agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("__cuts"))
    found = keep(found, "cuts")
    # Only rows that may have cuts are shuffled with their texts.
    touched = id_filter(found, "__cut_id")
    # A broadcast would put the filter's and the cuts' Python workers into one task: two more processes an executor, for good.
    joined = touched(docs, "doc_id", True).join(found.hint("shuffle_merge"), (F.col("doc_id").cast("bigint") == F.col("__cut_id")) & (F.hash("text") == F.col("__cut_text")), "left")
    place = docs.schema.names.index("text")
    counts = [k for k, f in enumerate(docs.schema) if f.name == "n_chars" and f.dataType.simpleString() in ("bigint", "int")]

    def run(batches):
        for batch in batches:
            for i, j, _, _ in blocks(batch.column(place)):
                yield cut(batch.slice(i, j - i))

    def cut(batch):
        texts, spans = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        stay, size = [True] * len(texts), [None] * len(texts)
        for k, own in enumerate(spans):
            if own:
                raw, parts, at = texts[k].encode(), [], 0
                for span in own:
                    parts.append(raw[at : max(at, span["at"])])
                    at = max(at, span["at"] + span["size"])
                texts[k] = b"".join([*parts, raw[at:]]).decode()
                stay[k], size[k] = bool(texts[k].strip()), len(texts[k])
        arrays = list(batch.columns[:-1])
        arrays[place] = pa.array(texts, batch.schema.field(place).type)
        for c in counts:
            arrays[c] = pa.array([o if s is None else s for o, s in zip(arrays[c].to_pylist(), size)], arrays[c].type)
        return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1]).filter(pa.array(stay))

    changed = columns(joined, *docs.columns, "__cuts").mapInArrow(tidy(run), docs.schema)
    return touched(docs, "doc_id", False).unionByName(changed)
