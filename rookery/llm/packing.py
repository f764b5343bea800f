"""Items of varying length put into containers of fixed capacity.

The lengths in tokens give a histogram of at most ``capacity`` bars. Dynamic programming over it chooses the boundaries
of length buckets that minimise the padding of items to their bucket's bound. Batches within the token budget form inside
each bucket, the longest first; the room that a batch leaves is filled from shorter buckets. That plan is made for counts,
on the driver, in a number of steps bounded by the buckets. Items find their place in it by their position in the order by
length, which comes from a range-partitioned sort with partition offsets, so that no bucket has to fit into one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rookery.operators.ranks import global_order
from rookery.session import cut

CAPACITY = 2048
BUCKETS = 256
#: Folder of the public tokenizers' files, and the one used.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how texts are cut before merging, as published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """``id``, ``tokens`` of each text; null and empty texts have none and take no space. Texts are encoded whole."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "tokens": np.array(n, np.int64)})

    d = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    return d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, tokens long")


def bucket_bounds(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding, by dynamic programming.

    The best bucketing of the first j bars into k buckets extends the best of some first i bars into k - 1 by a bucket
    whose items are all padded to the length of bar j.
    """
    lengths = sorted(n for n in histogram if 0 < n <= capacity)
    if len(lengths) <= buckets:
        return lengths
    count = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths])]).astype(float)
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    came = np.zeros((buckets + 1, m + 1), np.int32)
    for b in range(1, buckets + 1):
        now = np.full(m + 1, np.inf)
        for j in range(b, m + 1):
            cost = best[:j] + (count[j] - count[:j]) * lengths[j - 1]
            i = int(np.argmin(cost))
            now[j], came[b, j] = cost[i], i
        best = now
    bounds, j = [], m
    for b in range(buckets, 0, -1):
        bounds.append(lengths[j - 1])
        j = int(came[b, j])
    return sorted(bounds)


def fill_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, items taken from each bucket) of batches within the budget, the longest bucket first."""
    left, plan = list(counts), []
    for first in range(len(bounds) - 1, -1, -1):
        while left[first]:
            room, take = capacity, {}
            for b in range(first, -1, -1):
                k = min(room // bounds[b], left[b])
                if k:
                    take[b] = k
                    room -= k * bounds[b]
                if room < bounds[0]:
                    break
            times = min(left[b] // k for b, k in take.items())
            for b, k in take.items():
                left[b] -= times * k
            plan.append((times, take))
    return plan


def pack(sizes: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``id``, ``piece``, ``tokens``, ``container``, ``unused`` for items ``id``, ``tokens``.

    An item longer than the capacity is cut into full pieces, each a container of its own, and a rest that is packed like
    an item; no other item is cut. Items without tokens take no space and get no container. The same id with the same size
    counts once. ``unused`` is the space left in the container.
    """
    s = cut(sizes.where("id is not null and tokens > 0").distinct())
    full = F.floor(F.col("tokens") / capacity).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.ceil(F.col("tokens") / capacity).cast("int")), lambda k: F.struct((k - 1).alias("piece"), F.when(k <= full, F.lit(capacity)).otherwise(F.col("tokens") % capacity).cast("long").alias("n")))
    p = s.select("id", F.explode(pieces).alias("x")).select("id", "x.piece", F.col("x.n").alias("tokens"))
    # at most capacity rows reach the driver
    histogram = {int(r["tokens"]): int(r["n"]) for r in p.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = bucket_bounds(histogram, capacity, buckets)
    counts = [sum(histogram.get(n, 0) for n in range(low + 1, high + 1)) for low, high in zip([0, *bounds], bounds)]
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)  # a bucket's first position in the order by length
    taken, base, steps = [0] * len(bounds), 0, []
    for times, take in fill_plan(bounds, counts, capacity):
        for b, k in take.items():
            steps.append((int(first[b]) + taken[b], k, base))
            taken[b] += times * k
        base += times
    steps.sort()
    start, fit, number = (np.array([x[i] for x in steps] or [0], np.int64) for i in range(3))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(start, pdf["_pos"].to_numpy(), side="right") - 1
            yield pdf.assign(container=number[at] + (pdf["_pos"].to_numpy() - start[at]) // fit[at]).drop(columns="_pos")

    ordered = global_order(p, [F.col("tokens"), F.xxhash64("id", "piece"), F.col("id"), F.col("piece")])
    d = ordered.select("id", "piece", "tokens", "_pos").mapInPandas(place, f"id {dict(p.dtypes)['id']}, piece int, tokens long, container long")
    d = cut(d)
    used = d.groupBy("container").agg((F.lit(capacity) - F.sum("tokens")).alias("unused"))
    return d.join(used, "container").select("id", "piece", "tokens", "container", "unused")
