"""Statistics of each text that tell natural prose from lists, tables and junk, and outlier scores from exact ranks.

Ranks are exact per language: distinct values are counted, sorted by range partitions, and summed with partition
offsets. Tail probabilities of the statistics combine into outlier scores: their sum, and the greatest of them measured by
the tail at a statistic's limit (the tail of a text that is just no prose), which decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rookery.llm.mapping import salted_join
from rookery.operators.ranks import cumulative
from rookery.session import cut

# Common English words.
COMMON_EN = """the a an and of to in is it its for that when i we my you your he she they was were are be been as on at by from with this
these those but so if or not no nor there has had have do does did which who whom what where why how until because though although than
then while will would may might can could should shall must all any some more most every each our us me him her their them into over
under out up about after before again except whatever whoever yet both only just very too also""".split()
_COMMON = frozenset(COMMON_EN)
# Common Chinese characters that link words.
COMMON_ZH = "的了是在有我你他她们不这那很就也都和与或会个着过来去说要把从向以为因而其之则若每者须被让得吗呢吧但可还没到后却再又将并且何凡于及即"
# Marks that end a sentence or clause at the end of a line.
LINE_END = "。．！？!?.…;；:：,，~～)）”\"'」』"
#: Common words expected of running text, as a share of its Latin words and of its Chinese characters.
RUN_EN, RUN_ZH = 0.14, 0.05
#: Words that a line of running text has at least.
RUN_WORDS = 4
#: Words between two bars that running text has on average at least.
BAR_WORDS = 4

#: The texts of a language up to this rank show what is usual.
USUAL = 0.9
#: Limits of the statistics that decide: no words, half of the characters in running text, and a quarter of the usual share of
#: common words, as (value, part of what is usual). The other statistics are only reported.
LIMITS = {"words": (0.0, 0.0), "running_share": (0.5, 0.0), "common_share": (0.0, 0.25)}

# name, and the tail that is unusual: low, high or both
STATISTICS = {"words": "low", "mean_word_len": "both", "symbol_share": "high", "punct_line_share": "low", "common_share": "low", "running_share": "low"}

_LATIN, _ALONE = re.compile("[A-Za-z]+"), re.compile(r"(?<![\w/\-])[a-z]+(?![\w/\-])")
_HAN, _LINK = re.compile("[一-鿿]"), re.compile(f"[{COMMON_ZH}]")
_ENDS = re.compile(rf"[{re.escape(LINE_END)}]\s*$")
_BAR = re.compile(r"(?<=\s)[|>/·•»](?=\s)")
_SYMBOL = re.compile(r"""[^\w\s.,!?;:'"()。，！？；：、“”‘’（）…\-]|_""")
_FIELDS = "words long, mean_word_len double, symbol_share double, punct_line_share double, common_share double, running_share double"


def _share(a: float, b: float) -> float:
    return round(a / b, 6) if b else 0.0


def statistics_of(text: str) -> tuple[str, int, float, float, float, float, float]:
    """(script, statistics) of one text, see text_statistics."""
    words = han = letters = common = chars = run = lines = ends = 0
    for line in re.split(r"\r\n|\r|\n", text):
        solid = sum(map(len, line.split()))
        if not solid:
            continue
        latin = _LATIN.findall(line)
        z = len(_HAN.findall(line))
        c = sum(w in _COMMON for w in _ALONE.findall(line.lower())) + len(_LINK.findall(line))
        w = len(latin) + z
        lines, chars, words, han, letters, common = lines + 1, chars + solid, words + w, han + z, letters + sum(map(len, latin)), common + c
        ends += bool(_ENDS.search(line))
        bars = len(_BAR.findall(line))  # a line of labels between bars is a menu or table
        if w >= RUN_WORDS and bars * BAR_WORDS < w and c >= RUN_EN * len(latin) + RUN_ZH * z:
            run += solid
    script = "none" if not words else "zh" if han * 2 >= letters else "en"
    return script, words, _share(letters + han, words), _share(len(_SYMBOL.findall(text)), chars), _share(ends, lines), _share(common, words), _share(run, chars)


def language(script: Column, declared: Column | None) -> Column:
    """The declared language (its first part, in lower case) where the script bears it out, else the script's usual one."""
    if declared is None:
        return script
    d = F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,3})(?:[-_]|$)", 1)
    fits = F.when(script == "zh", d == "zh").when(script == "en", (d != "") & (d != "zh")).otherwise(F.lit(False))
    return F.when(fits, d).otherwise(script)


def text_statistics(df: DataFrame, id_col: str, text: str, lang: str | None = None) -> DataFrame:
    """``id``, ``lang`` (as declared in the column ``lang`` if the script bears it out; by script without one; none for texts
    without words) and the statistics of each text; null texts count as empty.

    ``words`` (Latin words and Chinese characters), ``mean_word_len``, ``symbol_share`` (characters, blanks aside, that are
    neither letters nor digits nor common punctuation), ``punct_line_share`` (lines ending in punctuation), ``common_share``
    (common words among words), ``running_share`` (characters, blanks aside, in lines that read as running text). Shares of
    nothing are 0. Repeated rows count once; extra columns are ignored; texts are read whole, in Arrow batches.
    """
    declared = F.col(lang) if lang else F.lit(None).cast("string")
    d = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"), declared.alias("declared"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, c, *statistics_of(t)) for i, t, c in zip(pdf["id"], pdf["t"], pdf["declared"])], columns=["id", "declared", "script", *STATISTICS])

    out = d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, declared string, script string, {_FIELDS}")
    return out.select("id", language(F.col("script"), F.col("declared") if lang else None).alias("lang"), *STATISTICS).distinct()


def _tails(stats: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """``stat``, ``lang``, ``value``, ``n``, ``upto`` (texts of the language up to the value) and ``s``, -ln of the tail's share."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).cast("double").alias("value")) for k in of])).alias("x")
    counts = stats.select("lang", long).groupBy("x.stat", "lang", "x.value").agg(F.count(F.lit(1)).alias("w"))
    up = cut(cumulative(counts, ["stat", "lang", "value"], "w"))
    groups = up.groupBy("stat", "lang").agg(F.sum("w").alias("n"), F.min(F.col("_upto") - F.col("w")).alias("start"))
    up = up.join(F.broadcast(groups), ["stat", "lang"])  # one row per statistic and language
    low = (F.col("_upto") - F.col("start")) / F.col("n")
    high = (F.col("n") - (F.col("_upto") - F.col("start") - F.col("w"))) / F.col("n")
    tails = {"low": low, "high": high, "both": F.least(F.lit(1.0), 2 * F.least(low, high))}
    p = F.coalesce(*[F.when(F.col("stat") == k, tails[STATISTICS[k]]) for k in of])
    return up.select("stat", "lang", "value", "n", (F.col("_upto") - F.col("start")).alias("upto"), (-F.log(p)).alias("s"))


def _each(stats: DataFrame, of: tuple[str, ...]) -> DataFrame:
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).cast("double").alias("value")) for k in of])).alias("x")
    return stats.select("id", "lang", long).select("id", "lang", "x.stat", "x.value")


def outlier_scores(stats: DataFrame) -> DataFrame:
    """``id``, ``lang``, statistics and ``score``: the sum over statistics of -ln of the share of texts of the language that
    are at least as unusual. Ranks are exact, ties share theirs.
    """
    of = tuple(STATISTICS)
    tails = _tails(stats, of).select("stat", "lang", "value", "s")
    score = salted_join(_each(stats, of), tails, ["stat", "lang", "value"], "inner").groupBy("id", "lang").agg(F.sum("s").alias("score"))
    return stats.join(score, ["id", "lang"])


def limit_scores(stats: DataFrame, least: float = 0.0) -> DataFrame:
    """``id`` and ``beyond``: the greatest of the tails of the statistics in LIMITS, as parts of the tail at their limits; 1 or more
    is at least as unusual as the limit. Ids whose ``beyond`` is below ``least`` may be missing.

    A limit is a rank: all texts of the language up to it count. Texts of a language that has none up to the limit stay below
    1, and those of one whose texts all are reach 1.
    """
    of = tuple(LIMITS)
    t = cut(_tails(stats, of))
    usual = t.where(F.col("upto") >= F.col("n") * USUAL).groupBy("stat", "lang").agg(F.min("value").alias("usual"))
    at = F.coalesce(*[F.when(F.col("stat") == k, F.lit(v) + F.lit(part) * F.col("usual")) for k, (v, part) in LIMITS.items()])
    limits = t.join(F.broadcast(usual), ["stat", "lang"]).groupBy("stat", "lang").agg(F.max("n").alias("_n"), F.max(F.when(F.col("value") <= at, F.col("upto"))).alias("_upto"))
    # one row per statistic and language; without a text up to the limit it lies before the first
    t = t.join(F.broadcast(limits), ["stat", "lang"])
    edge = -F.log(F.coalesce("_upto", F.lit(0.5)) / F.col("_n"))
    beyond = F.when(edge > 0, F.col("s") / edge).otherwise(F.lit(1.0))
    t = t.select("stat", "lang", "value", beyond.alias("b")).where(F.col("b") >= least - 1e-9)
    return salted_join(_each(stats, of), t, ["stat", "lang", "value"], "inner").groupBy("id").agg(F.max("b").alias("beyond"))


def not_prose(df: DataFrame, id_col: str, text: str, lang: str | None = None) -> DataFrame:
    """``id`` of texts that aren't natural prose: by its ranks a text is at least as unusual for its language as the limit of no
    words, of half of the characters in running text, or of a quarter of the usual share of common words.

    Limits are found by rank, so they hold whatever else the texts of a language are.
    """
    return limit_scores(cut(text_statistics(df, id_col, text, lang)), 1.0).where(F.col("beyond") >= 1 - 1e-9).select("id").distinct()
