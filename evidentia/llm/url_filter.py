"""URL verdicts by rules and, where no rule fits, by the likelihood ratio of two character language models.

Each model is a smoothed variable-order Markov model: the probability of a character after its longest known context
interpolates all shorter ones (Witten-Bell), down to a uniform one. One is fitted on accepted URLs, one on rejected ones; the
difference of their log-likelihoods per character, less a threshold calibrated on labelled URLs left out of the fit, decides.

All labelled URLs count. The models are a table of counts, one row a context or character in its context, which no task need
hold whole: a block of URLs asks for the contexts and characters that it has, each once, and is scored with those alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, columns, keep, mix, tidy

#: (host, path, verdict) as the rule's text and what it decides.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 5
#: One labelled URL of a class in so many is left out of the fit, for the threshold.
HELD = 5
#: Bytes of URLs that ask for their counts together; one URL is never split.
BLOCK_URLS = 256 << 10
_SYMBOLS = 256


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):  # longer ones later, so that they win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


_STEPS = np.random.default_rng(7).integers(1, 1 << 63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Grams:
    """The characters (bytes) of some texts and of their ends, with hashes of the contexts before them."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8).astype(np.uint64)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        place = np.arange(len(self.data)) - np.repeat(self.begins, sizes)
        self.most = np.minimum(place, ORDER)

    def keys(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n characters before each place, and of these with the character itself."""
        h = np.full(len(at), (n + 1) << 56, np.uint64)
        for k in range(1, n + 1):
            h += (self.data[at - k] + np.uint64(1)) * _STEPS[k]
        context = mix(h)
        return context, mix(context + (self.data[at] + np.uint64(1)) * _STEPS[0])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct character in its longest context, and for each place the number of its kind."""
        longest = np.zeros(len(self.data), np.uint64)
        for n in range(ORDER + 1):
            at = np.flatnonzero(self.most == n)
            longest[at] = self.keys(at, n)[1]
        _, first, number = np.unique(longest, return_index=True, return_inverse=True)
        return first, number

    def all_keys(self) -> np.ndarray:
        """Distinct hashes of all contexts of the characters and of these with them."""
        first, _ = self.distinct()
        return np.unique(np.concatenate([k for n in range(ORDER + 1) for k in self.keys(first[self.most[first] >= n], n)]))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Markov:
    """Variable-order Markov model of bytes with Witten-Bell smoothing: counts of all contexts in sorted tables of 64-bit hashes."""

    def __init__(self, texts: list[bytes]):
        grams = Grams(texts)
        contexts, characters, owner = [], [], []
        for n in range(ORDER + 1):
            context, character = grams.keys(np.flatnonzero(grams.most >= n), n)
            contexts.append(context)
            kinds, first = np.unique(character, return_index=True)
            owner.append(context[first])
            characters.append(character)
        self.contexts, self.seen = np.unique(np.concatenate(contexts), return_counts=True)
        self.characters, self.counts = np.unique(np.concatenate(characters), return_counts=True)
        self.kinds = np.bincount(np.searchsorted(self.contexts, np.concatenate(owner)), minlength=len(self.contexts))

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> Markov:
        """A model, or what some texts need of one, from sorted hashes, their numbers and, of contexts, those of characters seen after them (others: 0)."""
        own, context = cls.__new__(cls), kinds > 0
        own.contexts, own.seen, own.kinds = keys[context], counts[context], kinds[context]
        character = ~context & (counts > 0)
        own.characters, own.counts = keys[character], counts[character]
        return own

    def logprobs(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihoods of texts and their ends. Each distinct character in its context is worked out once."""
        if not texts:
            return np.zeros(0)
        grams = Grams(texts)
        first, number = grams.distinct()
        p, live = np.full(len(first), 1 / _SYMBOLS), np.arange(len(first))
        for n in range(ORDER + 1):
            live = live[grams.most[first[live]] >= n]
            context, character = grams.keys(first[live], n)
            at, known = _find(self.contexts, context)
            live, at, character = live[known], at[known], character[known]
            own, hit = _find(self.characters, character)
            p[live] = (np.where(hit, self.counts[own], 0) + self.kinds[at] * p[live]) / (self.seen[at] + self.kinds[at])
        return np.add.reduceat(np.log(p)[number], grams.begins)


class Ratio:
    """Two models and the calibrated threshold of their length-normalised difference."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        fit, held = ([[t.encode() for k, t in enumerate(texts) if bool(k % HELD) == part] for texts in (accepted, rejected)] for part in (True, False))
        self.good, self.bad, self.threshold = Markov(fit[0]), Markov(fit[1]), 0.0
        if held[0] and held[1]:
            values = np.concatenate([self.values(t) for t in held])
            ys = np.repeat([1, 0], [len(t) for t in held])
            order = np.argsort(values, kind="stable")
            values, ys = values[order], ys[order]
            # The threshold of best balanced accuracy; the middle of the gap where several have it.
            right = 1 - np.concatenate([[0], np.cumsum(ys)]) / ys.sum()
            wrong = 1 - np.concatenate([[0], np.cumsum(1 - ys)]) / (1 - ys).sum()
            low = int(np.argmax(np.round(right + 1 - wrong, 12)))
            self.threshold = float(values[low - 1] + values[low]) / 2 if 0 < low < len(values) else 0.0

    def values(self, urls: list[bytes]) -> np.ndarray:
        """Differences of log-likelihoods per character: high for what is like the accepted URLs."""
        return (self.good.logprobs(urls) - self.bad.logprobs(urls)) / (np.array([len(u) for u in urls]) + 1)


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.string()).fill_null("").cast(pa.binary()).to_pylist()


def _counted(batches):
    """(accepted, context, character, n) of URLs (url, accepted): how often a character follows a context, in all lengths of it."""
    for batch in batches:
        for i, j, _, _ in blocks(batch.column(0), BLOCK_URLS):
            rows = batch.slice(i, j - i)
            accepted = np.array(rows.column(1).to_pylist(), bool)
            texts = _texts(rows.column(0))
            for kind in (True, False):
                grams = Grams([t for t, a in zip(texts, accepted) if a == kind])
                for n in range(ORDER + 1):
                    context, character = grams.keys(np.flatnonzero(grams.most >= n), n)
                    character, first, times = np.unique(character, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.bool_()), pa.array(context[first].view(np.int64)), pa.array(character.view(np.int64)), pa.array(times, pa.int64())], names=["accepted", "context", "character", "n"])


def models(urls: DataFrame) -> DataFrame:
    """(key, accepted_n, accepted_kinds, rejected_n, rejected_kinds): both models' counts, fitted on URLs (url, accepted). kinds: Markov.of()."""
    grams = keep(urls.select("url", "accepted").mapInArrow(tidy(_counted), "accepted boolean, context bigint, character bigint, n bigint").groupBy("accepted", "context", "character").agg(F.sum("n").alias("n")), "grams")
    contexts = grams.groupBy("accepted", F.col("context").alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    rows = contexts.unionByName(grams.select("accepted", F.col("character").alias("key"), "n", F.lit(0).cast("bigint").alias("kinds")))
    figure = lambda kind, c: F.sum(F.when(F.col("accepted") == kind, F.col(c)).otherwise(0)).alias(f"{'accepted' if kind else 'rejected'}_{c}")
    return rows.groupBy("key").agg(figure(True, "n"), figure(True, "kinds"), figure(False, "n"), figure(False, "kinds"))


def _blocked(batches):
    """Rows with url as their second column, with the number of their block before them."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j, _, _ in blocks(batch.column(1), BLOCK_URLS):
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block)), *rows.columns], names=["block", *rows.schema.names])
            block += 1


def _asked(batches):
    """(block, key) of (block, url): each key that a block's URLs need once, or once for each of its batches."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(bounds, bounds[1:]):
            if j > i:
                keys = Grams(_texts(batch.column(1).slice(i, j - i))).all_keys()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block[i])), pa.array(keys.view(np.int64))], names=["block", "key"])


def _judged(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """rows of a block without block and url, with value: the difference of log-likelihoods per character."""
    key, *figures = (counts[c].to_numpy() for c in ("key", "accepted_n", "accepted_kinds", "rejected_n", "rejected_kinds"))
    key, first = np.unique(key.view(np.uint64), return_index=True)
    good_n, good_kinds, bad_n, bad_kinds = (f[first] for f in figures)
    urls = _texts(rows["url"].combine_chunks())
    ratio = (Markov.of(key, good_n, good_kinds).logprobs(urls) - Markov.of(key, bad_n, bad_kinds).logprobs(urls)) / (np.array([len(u) for u in urls]) + 1)
    return rows.drop_columns(["block", "url"]).append_column("value", pa.array(ratio))


def _with_totals(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """rows with the totals, named before_…, of some columns over all rows that precede in the order, which no two share."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    parts = placed.groupBy("__part").agg(*(F.sum(c).alias(c) for c in sums))  # as many rows as partitions
    parts = parts.select("__part", *(total(c, Window.orderBy("__part")).alias(f"__{c}") for c in sums))
    own = Window.partitionBy("__part").orderBy(*order)
    return placed.join(F.broadcast(parts), "__part").select(*rows.columns, *((F.col(f"__{c}") + total(c, own)).alias(f"before_{c}") for c in sums))


def _threshold(held: DataFrame) -> float:
    """The value, of (value, accepted), from which on accepting gives the best balanced accuracy: the middle of the gap, the first where several have it."""
    by = held.groupBy("value").agg(F.sum(F.col("accepted").cast("bigint")).alias("good"), F.sum((~F.col("accepted")).cast("bigint")).alias("bad"))
    placed = keep(_with_totals(by, ["value"], ["good", "bad"]), "totals")
    good, bad = placed.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return 0.0
    whole = lambda c: c.cast("decimal(18,0)")
    score = whole(F.lit(good) - F.col("before_good")) * whole(F.lit(bad)) + whole(F.col("before_bad")) * whole(F.lit(good))
    best = placed.select("value", score.alias("score")).orderBy(F.desc("score"), "value").first()
    if best["score"] <= good * bad:  # no better than to accept all
        return 0.0
    return (best["value"] + placed.where(F.col("value") < best["value"]).agg(F.max("value")).first()[0]) / 2


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) for every row of pages.

    Rules label the URLs that they fit. Of each class's distinct URLs, in order of their hashes, every HELD-th is left for
    the threshold and all others fit the models, whatever their number and length. A null URL, or one without ://, has an
    empty host and path, fits no rule and is judged by the models like any other text (null: as the empty one). Without
    labelled URLs of both classes ratios are null, which allows. Contexts and characters are told apart by 64-bit hashes.
    Equal URLs get equal verdicts; an empty table gives no rows; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    pages = columns(pages, "page_id", "url").withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("rule", name).withColumn("verdict", verdict)
    none = F.lit(None).cast("double").alias("ratio")
    by_rule = ruled.where("verdict is not null").select("page_id", "host", "path", "rule", "verdict", none)
    open_ = ruled.where("verdict is null").select("page_id", "url", "host", "path")
    by_class = ruled.where("verdict is not null").select("url", (F.col("verdict") == "allow").alias("accepted")).distinct()
    labelled = by_class.withColumn("hash", F.xxhash64("url")).withColumn("good", F.col("accepted").cast("bigint")).withColumn("bad", 1 - F.col("good"))
    nth = F.when(F.col("accepted"), F.col("before_good")).otherwise(F.col("before_bad"))
    labelled = keep(_with_totals(labelled, ["hash", "url"], ["good", "bad"]).select("url", "accepted", (nth % HELD == 0).alias("held")), "labelled")
    if labelled.select("accepted").distinct().count() < 2:
        return by_rule.unionByName(open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), none))

    model = keep(models(labelled.where("not held")), "models")
    # Those left out and those to be judged are valued alike.
    rows = labelled.where("held").select("url", "accepted").unionByName(open_.withColumn("accepted", F.lit(None).cast("boolean")), allowMissingColumns=True).select("page_id", "url", "host", "path", "accepted")
    kind = lambda *names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    rows = keep(rows.mapInArrow(tidy(_blocked), f"block bigint, {kind(*rows.columns)}"), "blocks")
    counts = rows.select("block", "url").mapInArrow(tidy(_asked), "block bigint, key bigint").join(model, "key")
    judged = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_judged, f"{kind('page_id', 'host', 'path', 'accepted')}, value double")
    judged = keep(judged, "judged")
    ratio = F.col("value") - _threshold(judged.where("accepted is not null"))
    by_model = judged.where("accepted is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(ratio >= 0, "allow").otherwise("block").alias("verdict"), ratio.alias("ratio"))
    return by_rule.unionByName(by_model)
