"""Rules on texts and on the hosts they come from, in built-in expressions only.

Each text is judged by rules. Failures are counted per host, the host's failure rate is shrunk toward the rate
of all hosts by a beta prior fitted to the hosts themselves, and the host's verdict is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions.once import once
from rillworks.llm import shared

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MAX_RATE = 0.5


def split_words(text: Column) -> Column:
    """The words of a text; an empty array if it has none."""
    return F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE))


def measures(docs: DataFrame, key: str, text: str, host: str, window: int = WINDOW) -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text; NULL has no words.

    n_repeat_words counts the words under a run of `window` words that occurs twice or more in the text. Runs
    are compared by 64-bit hash; only texts with an equal pair have their runs sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), t.alias("t"))
    rows = once(rows, words=split_words(F.col("t")), lines=F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.withColumn("n", F.size("words"))
    starts = F.when(F.col("n") >= window, F.sequence(F.lit(1), F.col("n") - (window - 1))).otherwise(F.array().cast("array<int>"))
    rows = once(rows, runs=F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, window))))
    twice = F.size(F.array_distinct("runs")) < F.size("runs")
    order = F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = once(rows, sorted=F.when(twice, order).otherwise(none))
    again = F.filter("sorted", lambda r, i: F.coalesce(F.get("sorted", i - 1)["h"] == r["h"], F.lit(False)) | F.coalesce(F.get("sorted", i + 1)["h"] == r["h"], F.lit(False)))
    rows = once(rows, places=F.sort_array(F.transform(again, lambda r: r["i"])))
    gap = F.transform("places", lambda p, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get("places", i - 1))))
    return rows.select(
        "key", "host", F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gap, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or over 30 % of them in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def failed() -> Column:
    """The base rules, over one symbol per five words, over 30 % repeated lines per ten words, or words of over 15 characters on average."""
    return base_failed() | (5 * F.col("n_symbols") > F.col("n_words")) | (F.col("n_dup_lines") * 10 > 3 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, host_rate): failures among a host's rows, shrunk toward all hosts' by an empirical beta prior.

    The prior has the mean m of all rows; its weight is m(1-m)/v - 1, held within 1 and 1000, where v is the
    variance of the hosts' rates around m less what chance gives. With one host, or no such variance, it is 1000.
    The rate is (failures + weight * m) / (rows + weight). NULL is no host.
    """
    counts = shared.stored(rows.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        return counts.select("host", F.lit(0.0).alias("host_rate"))
    m = total["bad"] / total["n"]
    spread = counts.agg(F.avg(F.pow(F.col("bad") / F.col("n") - m, 2) - m * (1 - m) / F.col("n")).alias("v")).first()["v"]
    weight = min(1000.0, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1000.0
    return counts.select("host", ((F.col("bad") + weight * m) / (F.col("n") + weight)).alias("host_rate"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", window: int = WINDOW, max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of every row with base_failed, host_rate and kept.

    A row is kept if it passes the base rules and its host's shrunk failure rate is at most `max_rate`. Hosts
    are counted before the join, and one row of each meets its rows again. Rows without a host are judged by
    the base rules alone. NULL keys and repeated rows stay.
    """
    rows = shared.stored(measures(docs, key, text, host, window).withColumn("base_failed", base_failed()).withColumn("failed", failed()))
    verdict = rows.join(host_rates(rows), "host", "left")
    return verdict.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate))
