"""Prefix-filtered set-similarity join, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rookery.operators.blocks import with_blocks
from rookery.session import cut as cut_lineage


def by_rarity(df: DataFrame, id_cols: list[str], tokens: str, freq: DataFrame) -> DataFrame:
    """``tokens`` (array of distinct strings) in the global order: rarest first, then by text; adds ``n``."""
    e = df.select(*id_cols, F.explode(tokens).alias("tok")).join(freq, "tok")
    return e.groupBy(*id_cols).agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("_t")).select(*id_cols, F.transform("_t", lambda x: x["tok"]).alias("toks"), F.size("_t").alias("n"))


def token_frequency(*columns: tuple[DataFrame, str]) -> DataFrame:
    """``tok``, ``f``: in how many sets of all given columns a token occurs."""
    each = [df.select(F.explode(c).alias("tok")) for df, c in columns]
    u = each[0]
    for x in each[1:]:
        u = u.unionByName(x)
    return u.groupBy("tok").agg(F.count(F.lit(1)).alias("f"))


#: Rows of one prefix token that are joined as one unit; a token with more is dealt to blocks.
TOKEN_ROWS = 20_000


def jaccard_join(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], threshold: float, tokens: str = "tokens", token_rows: int = TOKEN_ROWS) -> DataFrame:
    """Pairs of rows whose token sets have a Jaccard similarity of ``threshold`` or more: both ids and ``jaccard``.

    Tokens are ordered by their rarity in both tables. Two sets that are similar enough share a token among the first
    n - ceil(t n) + 1 of each, so only these are joined; pairs whose sizes or positions rule the similarity out are
    dropped in the join, the rest is verified exactly. Sets that are too small or large for any set of the other side go
    first. Empty and null sets pair with nothing. The left rows of a token with very many are dealt to blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    freq = token_frequency((left, tokens), (right, tokens))
    t = F.lit(threshold)
    sizes = right.where(F.size(tokens) > 0).agg(F.min(F.size(tokens)).alias("_lo"), F.max(F.size(tokens)).alias("_hi"))  # one row
    left = left.crossJoin(F.broadcast(sizes)).where((F.size(tokens) >= t * F.col("_lo") - 1e-9) & (t * F.size(tokens) <= F.col("_hi") + 1e-9)).drop("_lo", "_hi")

    def prefix(df: DataFrame, ids: list[str], side: str) -> DataFrame:
        d = by_rarity(df, ids, tokens, freq)
        cut = F.slice("toks", F.lit(1), (F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1).cast("int"))
        return d.select(*[F.col(c).alias(f"{side}_{c}") for c in ids], F.col("toks").alias(f"{side}_toks"), F.col("n").alias(f"{side}_n"), F.posexplode(cut).alias(f"{side}_pos", "tok"))

    a, b = prefix(left, left_id, "l"), prefix(right, right_id, "r")
    a = cut_lineage(with_blocks(a.withColumn("_h", F.xxhash64(*[f"l_{c}" for c in left_id])), ["tok"], "_h", token_rows).drop("_h"))
    big = a.where("_blocks > 1").select("tok", F.col("_blocks").alias("_nb")).distinct()
    b = b.join(big, "tok", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1))).drop("_nb")
    need = t / (1 + t) * (F.col("l_n") + F.col("r_n")) - 1e-9
    j = a.drop("_blocks").join(b, ["tok", "_block"]).where((F.col("r_n") >= t * F.col("l_n") - 1e-9) & (F.col("l_n") >= t * F.col("r_n") - 1e-9))
    # the shared token is at l_pos and r_pos: a pair is taken where its first shared tokens meet, so at most once
    j = j.where(F.least(F.col("l_n") - F.col("l_pos"), F.col("r_n") - F.col("r_pos")) >= need)
    j = j.where(F.size(F.array_intersect(F.slice("l_toks", F.lit(1), F.col("l_pos")), F.slice("r_toks", F.lit(1), F.col("r_pos")))) == 0)
    common = F.size(F.array_intersect("l_toks", "r_toks"))
    j = j.select(*[f"l_{c}" for c in left_id], *[f"r_{c}" for c in right_id], (common / (F.col("l_n") + F.col("r_n") - common)).alias("jaccard"))
    return j.where(F.col("jaccard") >= threshold - 1e-9)
