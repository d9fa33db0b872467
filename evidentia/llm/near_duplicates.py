"""Near-duplicate documents by min-max hashing.

Each distinct 2-word shingle is hashed once under each permutation, and both the least and the greatest value are kept: 64
evaluations give 128 signature values. Bands of four values (least and greatest under two permutations) propose links;
every proposed link is confirmed on the full shingle sets. Before texts are fetched for that, a pair is refused if its sets'
sizes are too far apart, or if its signatures, of four bits a value, agree as if the similarity were below 0.6: the estimate
of a similarity of 0.8 falls so low with probability below exp(-128 * KL(0.625, 0.8125)) < 5e-6. A pair at the threshold shares none of the 32 bands with
probability below 1e-7. So in practice no link is lost.

Documents with equal sets are one class from the start. In a band's bucket, members are compared with leaders rather than
with each other (graphs.linked): no bucket is gathered into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, columns, id_filter, keep, mix, packed, span_hashes, tidy, tokens, unpacked
from .graphs import components, linked

PERMUTATIONS, BANDS = 64, 32
_RNG = np.random.default_rng(97)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members compared with a home's leaders in one group, about.
MEMBERS_A_TASK = 400
#: Estimated similarity, as a share of the one asked for, below which a pair is refused.
REFUSED_BELOW = 0.75


def shingle_sets(column: pa.ChunkedArray | pa.Array):
    """Yield (first row, list of sorted arrays of distinct 64-bit shingle hashes) for blocks of rows."""
    for i, j, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, row = tokens(data, offsets)
        own = span_hashes(data, starts, ends)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        pairs = mix(own[:-1] * np.uint64(0xD6E8FEB86659FD93) + (own[1:] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            sets.append(np.unique(pairs[a : b - 1]) if b - a > 1 else mix(own[a:b]))
        yield i, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): the least value under each permutation, then the greatest; zeros for an empty set."""
    out = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint64)
    full = [k for k, s in enumerate(sets) if len(s)]
    i = 0
    while i < len(full):  # stretches that stay in the processor's cache
        j, size = i, 0
        while j < len(full) and (j == i or size + len(sets[full[j]]) <= 1 << 14):
            size += len(sets[full[j]])
            j += 1
        flat = np.concatenate([sets[k] for k in full[i:j]])
        begins = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full[i : j - 1]])]).astype(np.int64)
        for p, m in enumerate(_MULTIPLIERS):
            x = flat * m
            out[full[i:j], p] = np.minimum.reduceat(x, begins)
            out[full[i:j], PERMUTATIONS + p] = np.maximum.reduceat(x, begins)
        i = j
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit band keys of signatures."""
    low, high = values[:, :PERMUTATIONS], values[:, PERMUTATIONS:]
    key = mix(low[:, 0::2] + np.uint64(1))
    for part in (high[:, 0::2], low[:, 1::2], high[:, 1::2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + part)
    return mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimates of sets' Jaccard similarity from rows of signature values: unbiased, or a little high where the values are shortened."""
    return (a == b).mean(axis=-1)


def _sign(batches):
    for batch in batches:
        for i, sets in shingle_sets(batch.column(1)):
            n = len(sets)
            values = signatures(sets)
            keys, short = bands(values).reshape(-1), mix(values).astype(np.uint8) & np.uint8(15)
            sketch = short[:, 0::2] | short[:, 1::2] << np.uint8(4)  # four bits of each value
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32)), pa.array(keys)),
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "bands", "sketch"],
            )


def _pack(batches):
    """(id, packed) of (id, text); rows of a batch that are equal in both are one."""
    for batch in batches:
        rows = pa.table([batch.column(0), packed(batch.column(1))], names=["id", "packed"])
        places = {row: k for k, row in enumerate(zip(rows["id"].to_pylist(), rows["packed"].to_pylist()))}
        yield from rows.take(pa.array(sorted(places.values()), pa.int64())).combine_chunks().to_batches()


def _verify(similarity: int):
    def run(batches):
        group, own = None, {}  # several sets where rows share an id
        for batch in batches:
            groups, role, ids, leaders = (batch.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for first, sets in shingle_sets(unpacked(batch.column(4))):  # the sets of a block at a time
                for k, s in enumerate(sets, first):
                    if groups[k] != group:
                        group, own = groups[k], {}
                    if role[k] == 0:
                        own.setdefault(ids[k], []).append(s)
                        continue
                    for leader in leaders[k]:
                        if any(100 * (n := len(np.intersect1d(x, s, assume_unique=True))) >= similarity * (len(x) + len(s) - n) and n for x in own.get(leader, ())):
                            a.append(ids[k])
                            b.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Those of pairs (id, leader, home) whose sets are similar enough, as (src, dst); texts: (id, packed).

    A home's leaders and a part of its members, MEMBERS_A_TASK of them or so, meet in one task: each text is sent once for
    all pairs that it has there.
    """
    sizes = pairs.groupBy("home").agg(F.ceil(F.countDistinct("id") / MEMBERS_A_TASK).cast("int").alias("parts"))
    placed = keep(pairs.join(sizes, "home").select(F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("g"), "id", "leader"), "placed")
    members = placed.groupBy("g", "id").agg(F.collect_list("leader").alias("leaders")).select("g", F.lit(1).alias("role"), "id", "leaders")
    heads = placed.select("g", F.col("leader").alias("id")).distinct().select("g", F.lit(0).alias("role"), "id", F.array().cast("array<bigint>").alias("leaders"))
    rows = heads.unionByName(members).join(texts, "id").select("g", "role", "id", "leaders", "packed")
    n = max(12, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "g").sortWithinPartitions("g", "role").mapInArrow(tidy(_verify(similarity)), "src bigint, dst bigint")


def _hopeful(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """Those of pairs (id, leader, home) whose estimated similarity isn't far below the one asked for; of an id with several sets, any."""
    least = REFUSED_BELOW * similarity / 100
    least += (1 - least) / 16  # values that differ may have the same four bits

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, PERMUTATIONS) for k in (2, 3))
            alike = (estimate(a & 15, b & 15) + estimate(a >> 4, b >> 4)) / 2
            yield batch.select([0, 1, 4]).filter(pa.array(alike >= least))

    of = lambda name: sketches.select(F.col("id").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    both = pairs.join(of("id"), "id").join(of("leader"), "leader").select("id", "leader", "id_sketch", "leader_sketch", "home")
    return both.mapInArrow(tidy(run), "id bigint, leader bigint, home int").distinct()


def near_duplicates(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Rows are linked when 100 * intersection >= similarity * union of their shingle sets. A null, empty or blank text has the
    empty set and is linked with nothing; a single word is its own shingle. component_id is the smallest doc_id reachable.
    Repeated rows and rows that share a doc_id are one document of that id and each returned. A row whose doc_id is null
    can't be named: it is linked with nothing, its component_id is null and it is kept. Texts are read whole, whatever their
    length; an empty table gives no rows. Other columns are ignored. Shingles are told apart by 64-bit hashes.
    """
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = keep(docs.mapInArrow(tidy(_sign), "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>, sketch binary"), "signatures")
    named = signed.where("doc_id is not null and set_id is not null")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    # An id that several texts share has several sets: its size is a range.
    sizes = named.groupBy(F.col("doc_id").alias("id")).agg(F.min("n_shingles").alias("small"), F.max("n_shingles").alias("large"))
    members = keep(_shared_buckets(classes).join(sizes, "id").select("bucket", "id", "small", "large"), "buckets")
    wanted = keep(members.select("id").distinct(), "wanted")
    sketches = keep(named.select(F.col("doc_id").alias("id"), "sketch").join(wanted, "id", "left_semi").distinct(), "sketches")
    # Only rows that the filter lets through are shuffled with their texts.
    own = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    texts = keep(id_filter(wanted, "id")(own, "id", True, _pack, "id bigint, packed binary").join(wanted, "id", "left_semi"), "texts")
    links = _class_links(signed)
    labels = keep(components(links), "labels") if links is not None else None

    def near(_):
        # Sets whose sizes are too far apart can't be similar enough.
        return (100 * F.col("large") >= similarity * F.col("leader_small")) & (100 * F.col("leader_large") >= similarity * F.col("small"))

    def verify(pairs):
        hopeful = keep(_hopeful(pairs, sketches, similarity), "hopeful")
        if hopeful.isEmpty():
            return None
        asked = id_filter(hopeful.select("id").unionByName(hopeful.select(F.col("leader").alias("id"))), "id")
        return keep(_confirmed(hopeful, asked(texts, "id", True), similarity), "links")

    labels = linked(members, verify, labels, near)
    rows = signed.select("doc_id", "n_shingles", "set_id")
    first = classes.select("set_id", F.col("id").alias("first_id"))
    rows = rows.join(first, "set_id", "left").withColumn("first_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id")))
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("id", "first_id"), "first_id", "left").withColumn("first_id", F.coalesce("label", "first_id"))
    return rows.select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(True)).alias("kept"))


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id), each once, of the buckets that several ids of classes (id, bands) share.

    Most buckets are one id's. All are shuffled once, as ids alone, for the count and for the join with it.
    """
    spread = classes.select(F.explode("bands").alias("bucket"), "id").repartition("bucket")
    shared = spread.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    return spread.join(shared, "bucket").distinct()


def _class_links(signed: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that share a doc_id; None where ids are unique, as they should be."""
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"), F.count("*").alias("n")).where("n > 1 and a <> b").select("doc_id")
    several = keep(signed.join(several, "doc_id", "left_semi").where("set_id is not null").select("doc_id", "set_id"), "shared")
    if several.isEmpty():
        return None
    first = signed.where("doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("dst"))
    return several.join(first, "set_id").select(F.col("doc_id").alias("src"), "dst").distinct()


def one_of_each(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each group of near duplicates does, with docs' own columns.

    Rows equal in doc_id and text count as one. Rows whose doc_id is null all stay. An empty table gives no rows.
    """
    found = keep(near_duplicates(docs, similarity).where("doc_id is not null").groupBy(F.col("doc_id").alias("__kept_id")).agg(F.bool_and("kept").alias("__kept"), F.count("*").alias("__rows")), "found")
    # Most ids are kept and have one row: theirs stay where they are. All others, and what the filter takes for them, are joined.
    odd = id_filter(found.where("not __kept or __rows > 1"), "__kept_id")
    with_id = docs.where("doc_id is not null")
    sure = odd(with_id, "doc_id", False)
    named = odd(with_id, "doc_id", True).join(found.where("__kept"), F.col("doc_id").cast("bigint") == F.col("__kept_id"))
    once, several = named.where("__rows = 1"), named.where("__rows > 1")
    # Only ids that several rows share are sorted out by text, of which a digest of 128 bits is the key.
    several = several.withColumn("__text", F.coalesce(F.md5("text"), F.lit(""))).dropDuplicates(["__kept_id", "__text"])
    return sure.unionByName(columns(once, *docs.columns)).unionByName(columns(several, *docs.columns)).unionByName(docs.where("doc_id is null"))
