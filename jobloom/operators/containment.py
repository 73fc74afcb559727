"""Which of many values contain which of many words, as an equi-join."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.runtime import broadcast_if_small, hot_join

GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, n)))


def holding(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, word) wherever a value contains a word; both distinct and lower case.

    A word meets the values that have its rarest run of up to three characters.
    """
    sizes = range(1, GRAM + 1)
    every = F.flatten(F.array(*[_grams(F.col("value"), n) for n in sizes]))
    posts = values.select("value", F.explode(every).alias("gram"))
    own = F.when(F.length("word") >= GRAM, _grams(F.col("word"), GRAM)).otherwise(F.array("word"))
    asked = words.filter("word <> ''").select("word", F.explode(own).alias("gram"))
    counts = posts.join(broadcast_if_small(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return hot_join(posts, rarest, "gram", F.col("value")).filter(F.col("value").contains(F.col("word"))).select("value", "word")
