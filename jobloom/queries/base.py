"""Registry of runnable queries and the SQL that checks them."""

from pyspark.sql import DataFrame, functions as F, types as T

from jobloom.runtime import plain_unions

QUERIES, ORACLES, INVENTORY = {}, {}, {}


def present(df: DataFrame) -> DataFrame:
    """Times without zone and lists as text, so results compare by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under a name, with the inventory rows it covers."""

    def keep(fn):
        def run(spark, sf):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            plain_unions(spark)
            return present(fn(spark, sf))

        run.area = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name], INVENTORY[name] = run, covers.split()
        if sql:
            ORACLES[name] = sql
        return fn

    return keep
