"""Document lengths of flat token files by a separator scan.

A token file holds fixed-width little-endian ids and nothing else; documents end with an end-of-document id, and there is
no index. Files are read in blocks that know nothing of documents; a vectorised search finds a block's separators, and a
prefix scan over the blocks' few figures gives each block the documents before it and the tokens that its first document
already has. So a file of any size is read in parallel, and a document may span any number of blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, keep, shared_dir

BLOCK_TOKENS = 2 << 20
END = 50256


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


_encodings: dict = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    from .byte_bpe import load_ranks

    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _encodings[path, pattern]


def write_token_files(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """Write docs as flat token files of 16-bit ids in shared storage; (file, ordinal, doc_id) of what was written.

    Each task attempt writes a file of its own name, so that a repeated attempt disturbs nothing; only files of attempts
    whose rows were kept are named in the result. A null or empty text is a document without tokens.
    """
    root = shared_dir(docs.sparkSession, "tokens")

    def run(batches):
        own, name, out, n = _encoding(path, pattern), f"{root}/{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            if out is None:
                system, place = _filesystem(name)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            for text in batch.column(1).to_pylist():
                out.write(np.array([*own.encode_ordinary(text or ""), end], "<u2").tobytes())
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(n, n + rows)), batch.column(0)], names=["file", "ordinal", "doc_id"])
            n += rows
        if out is not None:
            out.close()

    key = docs.schema["doc_id"].dataType.simpleString()
    return keep(columns(docs, "doc_id", "text").mapInArrow(run, f"file string, ordinal bigint, doc_id {key}"), "written")


def count_tokens(files: DataFrame, end: int = END, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files named in files (file).

    n_tokens is without the separator. Tokens after the last separator are a document too; an empty file has none. A file
    named twice is read once; null names are passed over. A length that isn't a multiple of the width is an error.
    """

    def measure(batches):
        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                system, place = _filesystem(name)
                size = system.get_file_info(place).size
                if size % width:
                    raise ValueError(f"{name} has {size} bytes, no multiple of {width}")
                sizes.append(size // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "tokens"])

    def scan(batches):
        for batch in batches:
            for name, number, tokens in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, place = _filesystem(name)
                with system.open_input_file(place) as source:
                    raw = source.read_at(width * min(block, tokens - number * block), width * number * block)
                ids = np.frombuffer(raw, f"<u{width}")
                at = np.flatnonzero(ids == end)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - 1 - int(at[-1]) if len(at) else len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "head", "tail", "inner"],
                )

    spark = files.sparkSession
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = columns(files, "file").where("file is not null").distinct().repartition(n, "file").mapInArrow(measure, "file string, tokens bigint").where("tokens > 0")
    parts = names.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("tokens") / block) - 1)).alias("block"), "tokens").repartition(n, "file", "block")
    found = keep(parts.mapInArrow(scan, "file string, block bigint, ends bigint, head bigint, tail bigint, inner array<bigint>"), "blocks")
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # Blocks since the last that holds a separator add up; one that holds any starts anew with its tail.
    figures = found.select("file", "block", "ends", "tail").withColumn("group", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(order))
    within = Window.partitionBy("file", "group").orderBy("block")
    figures = figures.withColumn("open", F.sum("tail").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    scanned = figures.select("file", "block", F.coalesce(F.sum("ends").over(past), F.lit(0)).alias("before"), F.coalesce(F.lag("open").over(order), F.lit(0)).alias("carry"), "open", F.lead("block").over(order).isNull().alias("last"))
    joined = found.join(scanned, ["file", "block"])
    first = joined.where("ends > 0").select("file", F.col("before").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"))
    inner = joined.select("file", "before", F.posexplode("inner").alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k") + 1).alias("ordinal"), "n_tokens")
    rest = joined.where("last and open > 0").select("file", (F.col("before") + F.col("ends")).alias("ordinal"), F.col("open").alias("n_tokens"))
    return first.unionByName(inner).unionByName(rest)


def document_token_counts(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, counted by scanning the token files written from them.

    A null or empty text has no tokens; repeated rows, and rows that share a doc_id or have none, are counted each; a text may
    be longer than a block of the scan; an empty table writes no file and gives no rows; other columns are ignored.
    """
    written = write_token_files(docs, path, pattern, end)
    counts = count_tokens(written.select("file"), end)
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
