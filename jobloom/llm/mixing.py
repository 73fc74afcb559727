"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream: its documents in a shuffled order, again and again
up to the words its target calls for, cut into blocks of equally many words.
Slot i of the schedule has the golden-ratio point frac(i * phi), which falls
into one source's interval of the cumulative targets; the k-th slot of a
source takes its k-th block.  So every stretch of the schedule holds the
sources close to their weights.

Targets share all words by weight; a source stops at ``repeats`` times its
size and the excess is shared anew by weight until none is above.

Edge cases: null texts and texts without words have size 0 and are never
taken; the null source is a source of its own, last in order; equal rows each
count and are taken like any other; one source or a third of the rows in one
source only adds parts; no words at all make all targets 0; an empty table
gives an empty mix.
"""

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobloom.llm.common import word_count
from jobloom.llm.prefix import ranked, running_total
from jobloom.runtime import broadcast_if_small, settle

PART_ROWS = 4096
HALF = 1 << 20


def targets(rows: DataFrame, weights=(1, 2, 3), repeats: int = 3) -> DataFrame:
    """source, number, source_docs, source_size, weight, target of ``rows(source, size)``.

    Weights go round in the order of source names by code point, null last.
    Sharing anew takes one small aggregate per round.
    """
    sums = rows.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    numbered = ranked(sums, [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    table = settle(numbered.withColumns({"weight": weight, "most": repeats * F.col("source_size")}), "sources")
    share, known = 0.0, -1
    while True:  # a source that is capped at one share per weight stays so at a greater one
        capped = F.col("weight") * F.lit(share) >= F.col("most")
        left = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("most"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if not left["open"] or left["n"] == known:
            break
        share, known = ((left["all"] or 0) - (left["full"] or 0)) / left["open"], left["n"]
    target = F.least(F.col("weight") * F.lit(share), F.col("most").cast("double"))
    return table.withColumn("target", target).drop("most")


def streams(rows: DataFrame, weights=(1, 2, 3), repeats: int = 3) -> DataFrame:
    """Add to ``rows(row, source, size, order)`` the source's figures, its quota of words, and where the row starts in its stream."""
    sources = targets(rows, weights, repeats).withColumn("quota", F.least(F.round("target").cast("long"), repeats * F.col("source_size")))
    side = broadcast_if_small(sources.withColumnRenamed("source", "_source"))
    placed = rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    part = F.floor(F.col("order") * F.ceil(F.col("source_docs") / PART_ROWS)).cast("long")
    return running_total(placed, "number", part, ["order", "row"], F.col("size"), "start")


def golden_point(i: Column) -> Column:
    """frac(i * phi) for whole i, in two halves to keep the digits."""
    getcontext().prec = 60
    phi = (Decimal(5).sqrt() - 1) / 2
    high, low = float(phi * HALF % 1), float(phi)
    value = F.floor(i / HALF) * F.lit(high) % 1 + (i % HALF) * F.lit(low) % 1
    return value % 1


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(number, block, slot): the place of every block of every source.

    ``sources`` has number and quota.  The slots of a source are numbered by a
    running count over runs of slots.  A block that the schedule's end leaves
    without a slot follows after the last; a slot without a block stays empty.
    """
    spark = sources.sparkSession
    quotas = settle(sources.select("number", "quota").filter("quota > 0").withColumn("blocks", F.ceil(F.col("quota") / block).cast("long")), "quotas")
    total = quotas.agg(F.sum("quota"), F.sum("blocks"), F.count("*")).first()
    slots, cells = total[1] or 0, max(1024, total[2])
    numbered = ranked(quotas, [F.col("number")], "place")
    upto = running_total(numbered.withColumn("_all", F.lit(0)), "_all", F.floor(F.col("place") / PART_ROWS), ["place"], F.col("quota"), "before")
    bounds = upto.select("number", "blocks", (F.col("before") / F.lit(total[0] or 1)).alias("low"), ((F.col("before") + F.col("quota")) / F.lit(total[0] or 1)).alias("high"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("long")
    parts = bounds.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = spark.range(slots).withColumn("u", golden_point(F.col("id"))).withColumn("cell", cell(F.col("u")))
    drawn = points.join(parts, "cell").filter("u >= low and u < high").select("number", "id")
    order = running_total(drawn, "number", F.floor(F.col("id") / HALF).cast("long"), ["id"], F.lit(1), "block")
    wanted = quotas.select("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return wanted.join(order, ["number", "block"], "left").select("number", "block", F.coalesce("id", F.lit(slots) + F.col("block")).alias("slot"))


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """(row, repeat, first, last, slot): stretches of words, from 0, end exclusive, by slot."""
    size, total, quota = F.col("size"), F.col("source_size"), F.col("quota")
    passes = placed.filter((size > 0) & (quota > 0)).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((quota - 1) / total))))
    begin = F.col("repeat") * total + F.col("start")
    spans = passes.withColumn("begin", begin).withColumn("end", F.least(begin + size, quota)).filter("begin < end")
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest(F.col("begin"), F.col("block") * block) - F.col("begin")
    last = F.least(F.col("end"), (F.col("block") + 1) * block) - F.col("begin")
    slots = schedule(placed.select("number", "quota").distinct(), block)
    return cut.withColumn("first", first).withColumn("last", last).join(slots, ["number", "block"]).select("row", "repeat", "first", "last", "slot")


def slim(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(row, doc_id, source, size, order) of ``docs`` with their columns ``row``, doc_id, source and text.

    ``order`` in [0, 1) is a hash of the row's contents, so reruns agree.
    """
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    order = F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53))
    return docs.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order"))


def mix(docs: DataFrame, weights=(1, 2, 3), repeats: int = 3, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their figures, and the mix as pieces by slot."""
    rows = settle(slim(docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())), "rows")
    placed = settle(streams(rows, weights, repeats), "placed")
    return placed, pieces(placed, block)


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, the words that the mix takes of every row, and its place in the schedule.

    The place is the first slot that holds words of the row (null if none is
    taken) and the number of its stretches in slots, repeats included.
    """
    placed, mixed = mix(docs, **how)
    sums = mixed.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return placed.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", number("taken"), "first_slot", number("n_slots"))


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), repeats: int = 3, block: int = 4096) -> DataFrame:
    """``docs`` as the mix takes them: a row per repeat, with all columns.

    A repeat that the quota ends within keeps that many words of the text,
    joined by single spaces; n_chars, where there is one, follows the text.
    """
    whole = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "mixing")
    rows = settle(slim(whole.select("doc_id", "source", "text", F.col("_row").alias("row"))), "rows")
    mixed = pieces(settle(streams(rows, weights, repeats), "placed"), block)
    words = mixed.groupBy("row", "repeat").agg(F.sum(F.col("last") - F.col("first")).alias("_words")).drop("repeat")
    out = whole.join(words.withColumnRenamed("row", "_row"), "_row")
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("_words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("_words") < word_count(F.col("text")), some).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
