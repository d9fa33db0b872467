"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the walker writes the character under it and moves on if a random bit of (j,
character) says so, else it writes the same character again. Two texts that differ by an edit fall out of step for a while
and, the walk being shared, fall in again, so that edit distance becomes Hamming distance of what is written (Chakraborty,
Goldenberg, Koucky 2016). A fingerprint samples what is written at 64 shared steps spread over the whole walk, at two
scales, a text's own power of two and the next, so that texts of up to twice the length share a scale. Each sample is a byte
that hashes the character and its two successors; 00 stands for steps past the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, keep, mix, packed, tidy
from .graphs import linked

SAMPLES, PERIOD, BLOCK_CHARS = 64, 4096, 2 << 20
_RNG = np.random.default_rng(2016)
_BITS = _RNG.integers(0, 2, (256, PERIOD), dtype=np.uint8)
_BITS[:, ::64] = 1  # no walk stays for ever
_STAY = np.zeros((256, PERIOD), np.int32)
_run = np.full(256, 1, np.int32)
for _ in range(2):
    for _j in range(PERIOD - 1, -1, -1):
        _run = np.where(_BITS[:, _j] == 1, 1, _run + 1).astype(np.int32)
        _STAY[:, _j] = _run
_FLAT = _STAY.reshape(-1)
_AT = {s: np.sort(np.random.default_rng(1000 + s).integers(0, 2 << s, SAMPLES)) for s in range(5, 42)}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int32)


def walk(own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character (class) of each text is reached, and the step after each text; begin: the first steps."""
    at, done = np.zeros(len(own), np.int32), begin.astype(np.int32).copy()
    order = np.argsort(-sizes, kind="stable")
    first, size, step = starts[order], sizes[order], done[order]
    i, m = 0, int((size > 0).sum())
    while m > 8:
        upto = int(size[m - 1])
        here, now = first[:m] + i, step[:m]
        for _ in range(i, upto):
            at[here] = now
            now = now + _FLAT[(own[here] << 12) + (now & (PERIOD - 1))]
            here += 1
        step[:m] = now
        i = upto
        m = int((size > i).sum())
    for k in range(m):  # few and long
        a, b, now, out = int(first[k]) + i, int(first[k] + size[k]), int(step[k]), []
        table = _stay_lists()
        for c in own[a:b].tolist():
            out.append(now)
            now += table[c][now & (PERIOD - 1)]
        at[a:b] = out
        step[k] = now
    done[order] = step
    return at, done


def _stay_lists():
    global _LISTS
    if _LISTS is None:
        _LISTS = _STAY.tolist()
    return _LISTS


_LISTS = None


def scale(n: int) -> int:
    return max(5, (max(n, 1) - 1).bit_length())


def _symbols(codes: np.ndarray) -> np.ndarray:
    """A byte from 1 to 255 for each character and its two successors."""
    padded = np.concatenate([codes, np.zeros(2, np.uint32)]).astype(np.uint64)
    h = mix((padded[:-2] << np.uint64(42)) ^ (padded[1:-1] << np.uint64(21)) ^ padded[2:])
    return (h % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _sample(at: np.ndarray, symbols: np.ndarray, n: int, end: int) -> str:
    s = scale(n)
    steps = np.concatenate([_AT[s], _AT[s + 1]])
    out = np.zeros(len(steps), np.uint8)
    if n:
        inside = steps < end
        out[inside] = symbols[np.searchsorted(at, steps[inside], "right") - 1]
    return f"{s:02x}" + out.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of agreeing samples, at a common scale, of those steps that either text reaches; 0 without a common scale."""
    if a == b:
        return 1.0
    s, t = int(a[:2], 16), int(b[:2], 16)
    if abs(s - t) > 1:
        return 0.0
    part = lambda x, own: np.frombuffer(bytes.fromhex(x[2:]), np.uint8)[SAMPLES * (max(s, t) - own) :][:SAMPLES]
    x, y = part(a, s), part(b, t)
    reached = (x > 0) | (y > 0)
    return float(((x == y) & reached).sum() / max(1, reached.sum()))


def fingerprint(texts: list[str], following: list[str] | None = None) -> list[tuple]:
    """[(fingerprint,)] of texts, or with their next texts [(fingerprint, edited text, edited fingerprint)]."""
    out: list[tuple] = []
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= BLOCK_CHARS):
            total += len(texts[j])
            j += 1
        own = texts[i:j]
        sizes = np.array([len(t) for t in own], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = _codes("".join(own))
        at, ends = walk(_classes(codes), starts, sizes, np.zeros(len(own), np.int32))
        if following is None:
            for k, t in enumerate(own):
                a, b = int(starts[k]), int(starts[k] + sizes[k])
                out.append((_sample(at[a:b], _symbols(codes[a:b]), b - a, int(ends[k])),))
            i = j
            continue
        quarter = sizes // 4
        extra = [following[i + k][: int(q)] for k, q in enumerate(quarter)]
        more = np.array([len(t) for t in extra], np.int64)
        begins = np.cumsum(more) - more
        cut = np.array([int(at[starts[k] + sizes[k] - q]) if q else int(ends[k]) for k, q in enumerate(quarter.tolist())], np.int32)
        codes2 = _codes("".join(extra))
        at2, ends2 = walk(_classes(codes2), begins, more, cut)
        for k, t in enumerate(own):
            a, b = int(starts[k]), int(starts[k] + sizes[k])
            c, d = int(begins[k]), int(begins[k] + more[k])
            kept = b - int(quarter[k])
            mine = _sample(at[a:b], _symbols(codes[a:b]), b - a, int(ends[k]))
            edited = t[: kept - a] + extra[k]
            joined = np.concatenate([codes[a:kept], codes2[c:d]])
            steps = np.concatenate([at[a:kept], at2[c:d]])
            out.append((mine, edited, _sample(steps, _symbols(joined), len(joined), int(ends2[k]))))
        i = j
    return out


def _tree(bounds: list[int], column, low: int = 0):
    """Number of bounds that are at most the column's value, as a binary decision."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(column < bounds[mid], _tree(bounds[:mid], column, low)).otherwise(_tree(bounds[mid + 1 :], column, low + mid + 1))


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), packed(batch.column(3))], names=["doc_id", "id", "h", "packed"])


def with_next(docs: DataFrame) -> DataFrame:
    """(part, tail, id, h, doc_id, packed), sorted within partitions so that each row's successor is the next document of its part.

    Parts are ranges of (id, h), h being a hash of the text, between quantiles of the ids; an id that holds several quantiles'
    rows is divided by h, so that no id, null included, need fit one task. Each part ends with the first document of the
    next part that has any (tail = 1; the last: of the first). Two passes read ids and hashes alone, one row a part comes to
    the driver, and the texts, compressed, are shuffled once. Null ids come first; rows that share an id are ordered by h.
    """
    spark = docs.sparkSession
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    found = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(found))
    own = _tree(bounds, F.col("id"))
    hot = {b: m for b in bounds if (m := found.count(b)) > 1}
    # A hot id is the least of its range: its rows go to m slots by their hash, those of other ids of the range to a last one.
    slots = 1 + max(hot.values(), default=0)
    slot = F.lit(slots - 1)
    for b, m in hot.items():
        slot = F.when(F.col("id") == b, F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * m).cast("int")).otherwise(slot)
    placed = lambda d: d.withColumn("own", own * slots + (slot if hot else F.lit(slots - 1)))
    heads = sorted((r["own"], r["head"]["id"], r["head"]["h"]) for r in placed(rows.select("id", "h")).groupBy("own").agg(F.min(F.struct("id", "h")).alias("head")).collect())
    if not heads:
        heads = [(0, 0, 0)]
    size = slots * (len(bounds) + 1)
    first, mark, before = [0] * size, [0] * size, [0] * size
    for k, (p, i, h) in enumerate(heads):
        first[p], mark[p], before[p] = i, h, heads[k - 1][0]
    at = lambda xs: F.element_at(F.array(*(F.lit(x).cast("bigint") for x in xs)), F.col("own") + 1)
    targets = F.when((F.col("id") == at(first)) & (F.col("h") == at(mark)), F.array(F.col("own"), at(before).cast("int"))).otherwise(F.array(F.col("own")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = rows.select("doc_id", "id", "h", "text").mapInArrow(tidy(_packed), f"doc_id {kind}, id bigint, h bigint, packed binary")
    spread = placed(small).select("doc_id", "packed", "id", "h", F.posexplode(targets).alias("tail", "part"))
    return spread.select("part", "tail", "id", "h", "doc_id", "packed").repartition(n, "part").sortWithinPartitions("part", "tail", "id", "h")


_COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    A null text is the empty one, whose edited text is empty too. A fingerprint depends on the text alone. Rows that share
    an id follow each other in the order of their texts' hashes, repeated rows among them; a single row is its own next
    document. Texts of any length are read whole. Other columns are ignored; an empty table gives no rows.
    """
    import zstandard

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()

        def give(rows):
            """rows: [(part, tail, id, packed text)] with the successor of each but the last, which is left."""
            own = [k for k in range(len(rows) - 1) if rows[k][1] == 0]
            i = 0
            while i < len(own):
                part, size, open_ = [], 0, {}
                while i < len(own) and (not part or size <= BLOCK_CHARS):
                    for k in (own[i], own[i] + 1):
                        if k not in open_:
                            open_[k] = unpacker.decompress(rows[k][3]).decode("utf-8", "surrogatepass")
                    size += len(open_[own[i]])
                    part.append(own[i])
                    i += 1
                texts, after = [open_[k] for k in part], [open_[k + 1] for k in part]
                prints = fingerprint(texts, after)
                lacking = [k for k in range(len(part)) if k + 1 == len(part) or part[k + 1] != part[k] + 1]
                others = {k: f[0] for k, f in zip(lacking, fingerprint([after[k] for k in lacking]))}
                nexts = [others[k] if k in others else prints[k + 1][0] for k in range(len(part))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([rows[k][2] for k in part], key_type),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(p[1].encode("utf-8", "surrogatepass")).hexdigest() for p in prints]),
                        "fingerprint": pa.array([p[0] for p in prints]),
                        "edited_fingerprint": pa.array([p[2] for p in prints]),
                        "near_edited": pa.array([likeness(p[0], p[2]) for p in prints]),
                        "near_next": pa.array([likeness(p[0], q) for p, q in zip(prints, nexts)]),
                    }
                )

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)))
            yield from give(held)
            held = held[-1:]

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, key = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs).select("part", "tail", "doc_id", "packed").mapInArrow(tidy(run), f"doc_id {key}, {_COLUMNS}")


#: Classes of pairs by the larger number of samples that either text reaches at their common scale: least and most.
REACHES = ((1, 4), (5, 9), (10, 14), (15, 19), (20, 24), (25, 31), (32, 39), (40, 49), (50, 64))
_MARKS = np.random.default_rng(2017).integers(0, 1 << 63, (SAMPLES, 256), dtype=np.uint64)
_HEX = 2 + 4 * SAMPLES


def most_unlike(reach: int, least: float) -> int:
    """How many of so many samples may differ in a link."""
    return max(m for m in range(reach + 1) if m == 0 or (reach - m) / reach >= least)


def _values(prints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), _HEX // 2)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """likeness() of each pair of fingerprints that aren't the same."""
    x, y = _values(a), _values(b)
    s, t = x[:, 0].astype(int), y[:, 0].astype(int)
    common, places = np.maximum(s, t), np.arange(SAMPLES)
    part = lambda v, own: np.take_along_axis(v, 1 + SAMPLES * np.minimum(common - own, 1)[:, None] + places, 1)
    x, y = part(x, s), part(y, t)
    reached = (x > 0) | (y > 0)
    return np.where(np.abs(s - t) > 1, 0.0, ((x == y) & reached).sum(1) / np.maximum(1, reached.sum(1)))


def _reaches(batches):
    """(level, reach): the fewest samples that a text of each scale reaches at its own scale."""
    for batch in batches:
        values = _values(batch.column(0).to_pylist())
        least = np.full(64, SAMPLES + 1)
        np.minimum.at(least, values[:, 0], (values[:, 1 : 1 + SAMPLES] > 0).sum(1))
        at = np.flatnonzero(least <= SAMPLES)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(least[at], pa.int32())], names=["level", "reach"])


def _banded(least: float, lowest: dict[int, int]):
    """(id, bucket, longer) of the bands of fingerprints; longer: the text may be the one of its pairs that reaches more. lowest: from _reaches()."""
    unlike = np.array([most_unlike(r, least) for r in range(SAMPLES + 1)])
    # A text that reaches r has links with those that reach up to upto[r]: what both agree on, the shorter one reaches.
    upto = np.array([max(k for k in range(SAMPLES + 1) if k - unlike[k] <= r) for r in range(SAMPLES + 1)])
    floor = np.array([lowest.get(s, SAMPLES + 1) for s in range(64)])

    def run(batches):
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), _values(batch.column(1).to_pylist())
            out: list[list[np.ndarray]] = [[], [], []]
            for other in (0, 1):
                level = values[:, 0].astype(np.int64) + other
                own = values[:, 1 + SAMPLES * other :][:, :SAMPLES]
                reach, marks = (own > 0).sum(1), _MARKS[np.arange(SAMPLES), own]
                # At the next scale a text meets only those whose own scale that is: pairs of one scale meet at it.
                from_ = np.maximum(reach, floor[level]) if other else reach
                for k, (low, high) in enumerate(REACHES):
                    at = np.flatnonzero((reach > 0) & (from_ <= high) & (upto[reach] >= low))
                    bands = min(high, 1 + int(unlike[low : high + 1].max()))
                    longer = (reach[at] >= low) & (reach[at] <= high) & (other == 0)
                    for band in range(bands):
                        salt = ((level[at].astype(np.uint64) << np.uint64(16)) + np.uint64((k << 8) + band)) * np.uint64(0xD6E8FEB86659FD93)
                        out[0].append(ids[at])
                        out[1].append(mix(marks[at, band::bands].sum(1, dtype=np.uint64) + salt).view(np.int64))
                        out[2].append(longer)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "bucket", "longer"])

    return run


def buckets(own: DataFrame, least: float = 0.8) -> DataFrame:
    """(bucket, id, longer) of the bands that fingerprints (print_id, fingerprint) share with others that they may have links with.

    A pair whose texts reach at most r of the samples may differ in m = most_unlike(r) of them. Its class of r has m + 1
    bands, so one of them at least has no such sample and is shared: no link is lost. A band's samples are spread over the
    text with a stride, so that texts which share a beginning, an end or a passage alone don't share a band. A text is filed
    in the classes that its reach allows; only a pair whose longer text has the bucket's scale and class is compared there.
    """
    lowest = own.select("fingerprint").mapInArrow(tidy(_reaches), "level int, reach int").groupBy("level").agg(F.min("reach").alias("reach")).collect()
    banded = tidy(_banded(least, {r["level"]: r["reach"] for r in lowest}))
    spread = own.select("print_id", "fingerprint").mapInArrow(banded, "id bigint, bucket bigint, longer boolean")
    whole = Window.partitionBy("bucket")
    several = spread.select("bucket", "id", "longer", F.count("*").over(whole).alias("n"), F.max("longer").over(whole).alias("any_longer"))
    return several.where("n > 1 and any_longer").select("bucket", "id", "longer")


def classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(print_id, fingerprint, label) of each distinct fingerprint: label is the least print_id of those that links join.

    Links are between fingerprints that are alike by at least `least`, above 0. Bit-sampled bands propose them, all of them
    (buckets()); each proposal is verified on the whole fingerprints, and every bucket compared to its end. print_id is a
    64-bit hash. Null fingerprints are left out; an empty table gives no rows.
    """
    own = keep(prints.select("fingerprint").where("fingerprint is not null").groupBy(F.xxhash64("fingerprint").alias("print_id")).agg(F.min("fingerprint").alias("fingerprint")), "prints")
    members = keep(buckets(own, least), "buckets")

    def alike(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select([0, 1]).filter(pa.array(likenesses(a, b) >= least, pa.bool_()))

    def verify(pairs):
        of = lambda name: own.select(F.col("print_id").alias(name), F.col("fingerprint").alias(f"{name}_print"))
        both = pairs.join(of("id"), "id").join(of("leader"), "leader").select(F.col("id").alias("src"), F.col("leader").alias("dst"), "id_print", "leader_print")
        return keep(both.mapInArrow(tidy(alike), "src bigint, dst bigint"), "links")

    labels = linked(members, verify, near=lambda _: F.col("longer") | F.col("leader_longer"))
    if labels is None:
        return own.withColumn("label", F.col("print_id"))
    return own.join(labels.withColumnRenamed("id", "print_id"), "print_id", "left").select("print_id", "fingerprint", F.coalesce("label", "print_id").alias("label"))


def linked_fingerprints(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """fingerprints() with class_id, the least doc_id of the documents whose fingerprints links join (of those that have one), and class_size, their number, repeated rows included."""
    prints = keep(fingerprints(docs), "fingerprints")
    named = prints.select("doc_id", F.xxhash64("fingerprint").alias("print_id"))
    label = classes(prints, least).select("print_id", "label")
    of = keep(named.groupBy("print_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(label, "print_id"), "named")
    whole = of.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    result = of.select("print_id", "label").join(whole, "label").select(F.col("print_id").alias("__print"), "class_id", "class_size")
    return prints.join(result, F.xxhash64("fingerprint") == F.col("__print")).select(*prints.columns, "class_id", "class_size")
