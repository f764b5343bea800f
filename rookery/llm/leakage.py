"""Evaluation passages inside a corpus: a prefix-filtered join of word shingles with exact verification.

A text that holds enough of an item shares at least t of the item's shingles, so it shares one of any S - t + 1 of
them; the rarest in the corpus are taken. Texts and items that share such a shingle, at places that leave room for a
long enough run, are verified word by word on item-sized windows of the whole text.

Items and texts both stay distributed. The corpus is cut into shingles once; a Bloom filter of the items' shingles, whose
size is fixed, keeps shingles that no item has from being written. It only saves work: false hits fall out in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from rookery.llm.mapping import salted_join
from rookery.llm.passages import contains, drift_of, words
from rookery.operators.blocks import with_blocks
from rookery.session import cut

SHINGLE = 5
SHARE, CHANGED = 0.4, 0.1
#: Bits of the Bloom filter for each shingle, and at most (8 MB); the filter is sent to every worker.
BLOOM_EACH, BLOOM_BITS = 16, 1 << 26
#: Texts to verify whose ids are broadcast to the second scan of the corpus; with more, the texts are shuffled.
FEW_TEXTS = 200_000
#: Occurrences of one shingle in texts that are joined as one unit; a shingle with more is dealt to blocks.
SHINGLE_ROWS = 20_000
#: Items whose hashed words a worker keeps at once.
ITEM_MEMORY = 10_000

_known: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    out = []
    if len(_known) > 1_000_000:
        _known.clear()
    for w in words(text):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
    return out


def least_shared(n: int, share: float = SHARE, changed: float = CHANGED, k: int = SHINGLE) -> int:
    """Shingles of an item of n words that survive in any run of its share or more with the allowed changes; 1 at least.

    A longer run may hold one change more and share less, so all lengths count.
    """
    return max(1, _survivors(n, share, changed, k))


def _survivors(n: int, share: float, changed: float, k: int) -> int:
    run = np.arange(int(np.ceil(share * n - 1e-9)), n + 1)
    return int(np.min(run - k + 1 - k * np.floor(run * changed + 1e-9), initial=n))


def shingle_length(n: int, share: float = SHARE, changed: float = CHANGED) -> int:
    """The most words, SHINGLE or fewer, of which a shingle is sure to survive in any such run."""
    return next((k for k in range(SHINGLE, 1, -1) if _survivors(n, share, changed, k) >= 1), 1)


def item_shingles(items: DataFrame, share: float, changed: float) -> DataFrame:
    """``item``, ``n`` words, ``t`` shingles shared at least, ``drift``, ``k`` words a shingle, ``at``, ``sh`` of ``item``, ``text``."""
    kind = dict(items.dtypes)["item"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["item"], pdf["text"]):
                h = word_hashes(text)
                n = len(h)
                k = shingle_length(n, share, changed)
                t, drift = least_shared(n, share, changed, k), drift_of(n, changed)
                out += [(i, n, t, drift, k, at, s) for at, s in enumerate(shingles(h, k).astype(np.int64))]
            yield pd.DataFrame(out, columns=["item", "n", "t", "drift", "k", "at", "sh"])

    return items.mapInPandas(run, f"item {kind}, n int, t int, drift int, k int, at int, sh long")


def bloom_filter(values: DataFrame, column: str, rows: int) -> np.ndarray:
    """Words of 64 bits of a Bloom filter of a column of hashes; at most BLOOM_BITS, whatever the number of rows."""
    bits = 1 << 16
    while bits < min(BLOOM_BITS, rows * BLOOM_EACH):
        bits <<= 1
    low = F.expr(f"{column} & {bits - 1}L")
    high = F.expr(f"shiftrightunsigned({column}, 32) & {bits - 1}L")
    at = values.select(F.explode(F.array(low, high)).alias("b"))
    filled = at.groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[filled["w"].to_numpy(np.int64)] = filled["v"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    mask = np.uint64((len(bloom) << 6) - 1)
    one = lambda b: (bloom[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)
    got = one(h & mask).astype(bool)
    got[got] = one((h[got] >> np.uint64(32)) & mask).astype(bool)
    return got


def shingle_hits(docs: DataFrame, bloom: np.ndarray, lengths: list[int]) -> DataFrame:
    """``doc``, ``size`` in words, ``k``, ``pos``, ``sh`` of the shingles of ``doc``, ``text`` that the filter lets through."""
    doc_type = dict(docs.dtypes)["doc"]
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, size, length, pos, sh = [], [], [], [], []
            for d, t in zip(pdf["doc"], pdf["text"]):
                h = word_hashes(t)
                for k in lengths:
                    s = shingles(h, k)
                    got = np.nonzero(passes(shared.value, s))[0]
                    if len(got):
                        ids += [d] * len(got)
                        size.append(np.full(len(got), len(h)))
                        length.append(np.full(len(got), k))
                        pos.append(got)
                        sh.append(s[got].astype(np.int64))
            if ids:
                yield pd.DataFrame({"doc": ids, "size": np.concatenate(size), "k": np.concatenate(length), "pos": np.concatenate(pos), "sh": np.concatenate(sh)})

    return docs.mapInPandas(run, f"doc {doc_type}, size int, k int, pos int, sh long")


def candidates(hits: DataFrame, index: DataFrame, share: float) -> DataFrame:
    """``doc``, ``item``, ``diagonals``: places where a text shares one of an item's rarest shingles and has room for a run.

    A shingle in very many texts is dealt to blocks; the items that have it are repeated per block.
    """
    rarity = hits.select("doc", "k", "sh").distinct().groupBy("k", "sh").agg(F.count(F.lit(1)).alias("df"))
    # the rarest S - t + 1 shingles of each item; an item's shingles are few
    ranked = index.join(rarity, ["k", "sh"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.groupBy("item", "n", "t", "drift", "k").agg(F.sort_array(F.collect_list(F.struct("df", "sh", "at"))).alias("s"))
    rare = F.slice("s", F.lit(1), F.greatest(F.lit(1), F.size("s") - F.col("t") + 1).cast("int"))
    prefix = ranked.select("item", "n", "drift", "k", F.explode(rare).alias("s")).select("item", "n", "drift", "k", F.col("s.at").alias("at"), F.col("s.sh").alias("sh"))
    dealt = cut(with_blocks(hits.join(prefix.select("k", "sh").distinct(), ["k", "sh"], "left_semi"), ["k", "sh"], "doc", SHINGLE_ROWS))
    big = dealt.where("_blocks > 1").select("k", "sh", F.col("_blocks").alias("_nb")).distinct()
    prefix = prefix.join(big, ["k", "sh"], "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1))).drop("_nb")
    j = dealt.drop("_blocks").join(prefix, ["k", "sh", "_block"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    # length and position: the text must have room for the run around this place
    room = F.least(F.col("n"), F.col("size") - F.col("diagonal") + F.col("drift")) - F.greatest(F.lit(0), -F.col("diagonal") - F.col("drift"))
    j = j.where(room >= F.ceil(F.lit(share) * F.col("n") - 1e-9))
    return j.groupBy("doc", "item").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"))


def verified(cases: DataFrame, share: float, changed: float) -> DataFrame:
    """``doc``, ``item`` of the rows ``doc``, ``text``, ``item``, ``item_text``, ``diagonals`` in which the text holds enough of the item."""
    kinds = dict(cases.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, own, known = None, {}, {}
        for pdf in batches:
            out = []
            for d, t, i, it, places in zip(pdf["doc"], pdf["text"], pdf["item"], pdf["item_text"], pdf["diagonals"]):
                if t != text:  # rows of one text follow each other
                    text, own = t, {0: word_hashes(t)}
                if it not in known:
                    if len(known) >= ITEM_MEMORY:
                        known.clear()
                    h = word_hashes(it)
                    k = shingle_length(len(h), share, changed)
                    known[it] = (h, shingles(h, k), k, least_shared(len(h), share, changed, k))
                h, sh, k, least = known[it]
                if k not in own:
                    own[k] = shingles(own[0], k)
                if contains(h, own[0], sh, own[k], list(places), share, changed, least):
                    out.append((d, i))
            yield pd.DataFrame(out, columns=["doc", "item"])

    return cases.select("doc", "text", "item", "item_text", "diagonals").mapInPandas(run, f"doc {kinds['doc']}, item {kinds['item']}")


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, share: float = SHARE, changed: float = CHANGED) -> DataFrame:
    """``doc``, ``item`` for each text that holds at least ``share`` of an item in one run with at most ``changed`` changes.

    Null ids, null and empty texts match nothing; repeated rows count once, and of several texts of one item id the least
    holds; texts are read whole, whatever their length. Items too short for five words in a row to be sure are searched for
    by shorter shingles. Nothing that grows with the items or the corpus is collected.
    """
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    i = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_id).alias("item")).agg(F.min(item_text).alias("text"))
    index = cut(item_shingles(i, share, changed))
    lengths = sorted(r["k"] for r in index.select("k").distinct().collect())  # at most SHINGLE numbers
    hits = cut(shingle_hits(d, bloom_filter(index, "sh", index.count()), lengths))
    near = cut(candidates(hits, index, share))
    ids = near.select("doc").distinct()
    if ids.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS:
        d = d.join(F.broadcast(ids), "doc", "left_semi")
    cases = salted_join(near, i.withColumnRenamed("text", "item_text"), ["item"], "inner")
    return verified(cases.join(d, "doc"), share, changed).distinct()
