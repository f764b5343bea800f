"""Work on groups of any size: pairs by blocks, and joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 2000


def with_blocks(df: DataFrame, keys: list[str], id_col: str, block_rows: int = BLOCK_ROWS, salts: int = 16) -> DataFrame:
    """Add ``_block`` (0 … ``_blocks`` - 1) and ``_blocks``: rows of a key are dealt to ceil(count / block_rows) blocks.

    The count is a plain aggregate (combined before its shuffle). Only keys of more than one block are looked up,
    and that lookup is salted, so that a key holding a third of all rows isn't joined in one task.
    """
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    big = big.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.ceil(F.col("_n") / block_rows).cast("int").alias("_nb"),
                     F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s2"))
    d = df.withColumn("_s1", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_s1") == F.col("_s2")]
    d = d.join(big, on, "left").withColumn("_blocks", F.coalesce("_nb", F.lit(1)))
    d = d.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), id_col), F.col("_blocks")).cast("int"))
    return d.select(*df.columns, "_block", "_blocks")


def pairs_in_groups(df: DataFrame, keys: list[str], id_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every unordered pair of different ids that share all ``keys``: columns ``a`` < ``b``.

    ``id_col`` must be distinct within a key. Rows with a null key take no part. A group is dealt to blocks; each
    pair of blocks is one unit of work, so no task sees more than two blocks of a group at once.
    """
    d = df.select(*keys, id_col).dropna()
    d = with_blocks(d, keys, id_col, block_rows)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")
    r = d.select(*keys, F.col(id_col).alias("_id"), "_block", "_blocks", other)
    # each row goes to the units (low block, high block) that hold its block
    r = r.select(*keys, "_id", "_block", F.least("_block", "_o").alias("_lo"), F.greatest("_block", "_o").alias("_hi"))
    left = r.where(F.col("_block") == F.col("_lo")).select(*keys, "_lo", "_hi", F.col("_id").alias("_x"))
    right = r.where(F.col("_block") == F.col("_hi")).select(*keys, "_lo", "_hi", F.col("_id").alias("_y"))
    j = left.join(right, [*keys, "_lo", "_hi"])
    j = j.where((F.col("_x") != F.col("_y")) & ((F.col("_lo") != F.col("_hi")) | (F.col("_x") < F.col("_y"))))
    return j.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join by ``keys``, null being a value like others, to a side with one row a key: that side is repeated per salt, so that
    a key with very many rows on the left isn't joined in one task. ``right`` has the keys and columns that ``left`` lacks.
    """
    rest = [c for c in right.columns if c not in keys]
    # a hash of the row, so that a task that runs again gives rows the same salt
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in left.dtypes if "map<" not in t]), F.lit(salts)).cast("int"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *rest, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt2"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_salt2")]
    return a.join(b, on, how).select(*left.columns, *rest)
