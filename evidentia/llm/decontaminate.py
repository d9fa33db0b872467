"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by k edits, k = m * ERRORS // 100. Cut into k + 1 pieces, at least one
piece must then occur in the passage unchanged. One Aho-Corasick automaton finds all exact hits of all pieces; at a hit, the
window that can hold the item is verified by Myers' bit-parallel distance.

Texts and items are compared in lower case with runs of white space as one space. Items with fewer than SHORT characters
allow no edit and must stand between word boundaries; blank ones match nothing.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns, tidy

ERRORS, SHORT = 5, 20
#: Characters of items that one automaton holds; longer lists of items are matched block by block.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, errors: int = ERRORS) -> int:
    return 0 if len(item) < SHORT else len(item) * errors // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    bounds = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def distance(pattern: str, text: str) -> int:
    """The least edit distance between the pattern and any part of the text (Myers 1999, on one integer of any length)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, now = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | full & ~(xh | plus)
        mh = plus & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | full & ~(xv | ph), ph & xv
    return best


class Finder:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: int = ERRORS):
        import ahocorasick

        self.items = [(i, t, budget(t, errors)) for i, t in ((i, normal(t or "")) for i, t in items) if t]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for place, piece in pieces(text, k):
                owners.setdefault(piece, []).append((n, place))
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def find(self, text: str) -> dict[int, int]:
        """item number -> least distance, of the items that the text holds."""
        best: dict[int, int] = {}
        if not self.any or not text:
            return best
        text = normal(text)
        tried: set[tuple[int, int]] = set()
        for end, (size, own) in self.automaton.iter(text):
            for n, place in own:
                if best.get(n) == 0:
                    continue
                _, item, k = self.items[n]
                begin = end - size + 1 - place
                if 0 <= begin and text.startswith(item, begin):
                    after = begin + len(item)
                    if len(item) >= SHORT or (begin == 0 or not text[begin - 1].isalnum()) and (after == len(text) or not text[after].isalnum()):
                        best[n] = 0
                    continue
                if k and (n, begin // (k + 1)) not in tried:  # hits of one passage lie within k of each other
                    tried.add((n, begin // (k + 1)))
                    # The window holds all passages whose place differs by up to 2k, so that near hits need no other.
                    d = distance(item, text[max(0, begin - 2 * k - 1) : max(0, begin + len(item) + 2 * k + 1)])
                    if d <= k and d < best.get(n, k + 1):
                        best[n] = d
        return best


def _blocks(benchmark: DataFrame):
    """Yield a broadcast of (number, items) for each block of at most about BLOCK_CHARS characters of items; the benchmark's size is measured first."""
    spark = benchmark.sparkSession
    items = columns(benchmark, "item_id", "text").where("item_id is not null and length(trim(text)) > 0").dropDuplicates(["item_id", "text"])
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))
    for b in range(n):
        own = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).sort("item_id", "text").collect()]
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, own))


_FINDERS: dict[tuple, Finder] = {}


def _finder(block, errors: int) -> Finder:
    """The block's automaton, built once a worker."""
    name, items = block.value
    if (name, errors) not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name, errors] = Finder(items, errors)
    return _FINDERS[name, errors]


def matches(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance) for every document and item that it holds within the item's error budget.

    Rows without a text, and items without an id or a text, match nothing; a null doc_id is returned as it is, repeated rows
    match each on its own, and items that share an id count by their least distance. Texts are searched whole, whatever
    their length. Items are sent out block by block of at most BLOCK_CHARS characters, and each block is one pass over
    docs, without a shuffle. Other columns are ignored; an empty table on either side gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key, item = (d.schema[c].dataType for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    item_type = to_arrow_type(item)
    source, out = columns(docs, "doc_id", "text").where("length(text) > 0"), None

    def finding(block):
        def run(batches):
            finder = _finder(block, errors)
            for batch in batches:
                for i, j, _, _ in blocks(batch.column(1)):
                    at, found, far = [], [], []
                    for k, text in enumerate(batch.column(1).slice(i, j - i).to_pylist(), i):
                        near: dict = {}
                        for n, d in finder.find(text).items():
                            near[finder.items[n][0]] = min(d, near.get(finder.items[n][0], d))
                        for one, d in sorted(near.items()):
                            at.append(k)
                            found.append(one)
                            far.append(d)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, item_type), pa.array(far, pa.int32())], names=["doc_id", "item_id", "distance"])

        return run

    for block in _blocks(benchmark):
        part = source.mapInArrow(tidy(finding(block)), f"doc_id {key.simpleString()}, item_id {item.simpleString()}, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """The rows of docs, with their own columns, that hold no item; no shuffle. Null and empty texts hold none and stay, as do repeated rows."""
    place = docs.schema.names.index("text")

    def keeping(block):
        def run(batches):
            finder = _finder(block, errors)
            for batch in batches:
                for i, j, _, _ in blocks(batch.column(place)):
                    part = batch.slice(i, j - i)
                    yield part.filter(pa.array([not finder.find(t) for t in part.column(place).to_pylist()], pa.bool_()))

        return run

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(tidy(keeping(block)), docs.schema)
    return docs
