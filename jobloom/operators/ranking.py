"""Orders, pages and bounded lists."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import origin
from jobloom.runtime import top_per_key


def certainty() -> Column:
    return F.when(F.col("posted_at").isNotNull(), 0).otherwise(1)


def relevance_order(rank: str = "rank"):
    return [F.desc(rank), origin.source_rank(F.col("source")).asc(), certainty().asc(), F.desc_nulls_last("posted_at"), F.asc("id")]


def newest_order():
    return [
        F.desc_nulls_last("posted_at"), F.desc("first_seen_at"), origin.source_rank(F.col("source")).asc(),
        certainty().asc(), F.asc("id"),
    ]


def company_order():
    return [F.lower("company_name").asc(), F.desc_nulls_last("posted_at"), F.asc("id")]


def page(df: DataFrame, order, number: int = 1, size: int = 20) -> DataFrame:
    """One page with its list score; the sort and cut plan as one top-k."""
    number, size = max(1, number), min(max(1, size), 100)
    cut = df.orderBy(*order).offset((number - 1) * size).limit(size)
    from pyspark.sql import Window

    # Ranks at most one page of rows, so a single task is enough.
    place = F.row_number().over(Window.orderBy(*order))
    return cut.withColumn("score", (F.lit(size) + 1 - place).cast("double"))


def page_per_query(df: DataFrame, order, size: int) -> DataFrame:
    """The first page of every query at once."""
    cut = top_per_key(df, ["query_id"], order, size)
    return cut.withColumn("score", (F.lit(size) + 1 - F.col("position")).cast("double"))


def recent_per_user(notices: DataFrame, n: int = 50) -> DataFrame:
    return top_per_key(notices, ["user_id"], [F.desc("created_at"), F.desc("notification_id")], n)


def match_order():
    return [F.desc("total"), F.desc("skill"), F.asc("listing_id")]


def matches_per_user(scored: DataFrame, n: int) -> DataFrame:
    return top_per_key(scored, ["user_id"], match_order(), n)


def top_per_category(scored: DataFrame, max_total: int = 36, max_per_group: int = 10) -> DataFrame:
    """Best items of a document overall, then the best of each category."""
    order = [F.desc("relevance"), F.asc("pos")]
    best = top_per_key(scored, ["doc_id"], order, max_total, "overall")
    return top_per_key(best, ["doc_id", "category"], [F.asc("overall")], max_per_group, "in_category")
