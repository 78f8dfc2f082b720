"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: sources in order of their names (by code point, null last) get the weights of a cycle, and
by weight a share of ``SHARE`` times all words.  No source gives more than ``EPOCHS`` times its size; what
it cannot give goes to the others by weight.  With sources in order of size per weight the ones that stop
are the first ones, so running sums of sizes and weights find the level in one pass.

Blocks: the documents of a source, shuffled by a hash of their ids, lie end to end and are cut into
blocks of ``BLOCK`` words, the last one shorter.  A source needs as many slots as its target has
blocks; the last of them takes only part of its block, so that the words taken equal the target, rounded.

Schedule: slot k lies at the k-th multiple of the golden ratio modulo 1, and the source whose
interval of cumulative slots covers that point gets it, so every stretch of the mix holds the sources in
proportion.  The intervals are looked up by equal cells of the unit interval, an equi-join.  Slots are
ranked per source; the n-th one takes block n, again from the first when all are used.  Counts per
source differ from the need by a few slots: the last ones too many are left out and those that lack
follow at the end.

Ranks and running sums go over written runs of sorted rows, so a source that holds a third of
all words is cut like any other range, and equal rows are told apart by a number.  Slots and pieces meet
by source and block, at most two slots and a block of words each.  Per run of the program only
totals over all sources come to the driver.

A null text has size 0 and, as any text of size 0, is never taken; a null id is shuffled as an empty one.
Equal rows are interchangeable: which of them lies first in a block shows in no result.  Very long texts
are cut over many blocks.  An empty table gives an empty mix.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import documents
from tidemark.operators.ranking import ordered_rank, run_offsets, sorted_runs
from tidemark.session import stored

WEIGHTS, SHARE, EPOCHS, BLOCK = (5, 2, 1), 1.5, 2, 1000
WORD = r"[^\x20\x09-\x0D]+"
#: Points have 40 bits; the step is the odd number next to 2**40 times the golden ratio's fraction.
BITS = 40
STEP = int(2**BITS * (math.sqrt(5) - 1) / 2) | 1


def sums_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], **sums: str) -> DataFrame:
    """For each name the sum of a column over the earlier rows of the key; ``order`` tells all rows apart."""
    runs = sorted_runs(df, [*keys, *order])
    earlier = Window.partitionBy(*keys, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name, value in sums.items():
        offsets = run_offsets(runs, keys, F.sum(value)).select(*keys, "run", F.col("offset").alias(f"_{name}"))
        df = runs.join(offsets, [*keys, "run"])
        runs = df.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)) + F.col(f"_{name}")).drop(f"_{name}")
    return runs.drop("run")


def golden(k: Column) -> Column:
    """The first bits of the fraction of ``k`` times the golden ratio, in whole numbers that never overflow."""
    half = BITS // 2
    low = F.lit((1 << half) - 1)
    high = (F.shiftright(k, half).bitwiseAND(low) * F.lit(STEP)).bitwiseAND(low)
    return (F.shiftleft(high, half) + k.bitwiseAND(low) * F.lit(STEP)).bitwiseAND(F.lit((1 << BITS) - 1))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source of ``sizes`` (``source``, ``size``): ``s`` (its number), ``source_size``, ``weight`` and ``target``."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = ordered_rank(each, [], "source", rank="s").withColumn("s", F.col("s").cast("long"))
    each = each.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), ((F.col("s") - 1) % len(weights) + 1).cast("int")).cast("long"))
    each = each.withColumns({"most": epochs * F.col("source_size"),
                             "fill": F.col("source_size") / F.col("weight")})
    each = stored(sums_before(each, [], ["fill", "s"], most_before="most", weight_before="weight"), "levels")
    total = each.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget = share * (total.words or 0)
    stops = ((F.lit(budget) - F.col("most_before")) * F.col("weight")
             > F.col("most") * (F.lit(total.weight or 0) - F.col("weight_before")))
    left = each.agg(F.sum(F.when(stops, F.col("most")).otherwise(0)).alias("given"),
                    F.sum(F.when(stops, 0).otherwise(F.col("weight"))).alias("weight")).first()
    level = F.lit(budget - (left.given or 0)) * F.col("weight") / F.lit(float(left.weight or 1))
    return each.select("source", "s", "source_size", "weight",
                       F.when(stops, F.col("most").cast("double")).otherwise(level).alias("target"))


@dataclass
class Mix:
    """A mix: its sources, and its slots in order."""

    sources: DataFrame
    slots: DataFrame


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> Mix:
    """Slots in order (``slot`` from 0) with ``s``, ``epoch``, ``block`` and ``n_words``, the words they take.

    ``sources`` is that of ``targets``; it comes back with its need.
    """
    size, quota = F.col("source_size"), F.col("quota")
    need = sources.withColumn("quota", F.least(epochs * size, F.floor(F.col("target") + 0.5))) \
        .withColumn("n_blocks", F.ceil(size / block)) \
        .withColumn("rest", F.when(size > 0, quota % size).otherwise(0)) \
        .withColumn("n_slots", F.when(size > 0, F.expr("quota div source_size") * F.col("n_blocks")
                                      + F.ceil(F.col("rest") / block)).otherwise(0))
    need = stored(sums_before(need, [], ["s"], first="n_slots"), "need")
    total = need.agg(F.sum("n_slots").alias("slots"), F.count(F.lit(1)).alias("sources")).first()
    n_slots = total.slots or 0
    shift = BITS - max(total.sources - 1, 1).bit_length()
    edge = lambda at: F.floor(at / F.lit(float(max(n_slots, 1))) * F.lit(float(1 << BITS))).cast("long")
    cells = need.select("s", edge(F.col("first")).alias("low"), edge(F.col("first") + F.col("n_slots")).alias("high")) \
        .filter("low < high") \
        .withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden(F.col("id")).alias("point")) \
        .withColumn("cell", F.shiftright("point", shift))
    drawn = points.join(cells, "cell").filter("low <= point AND point < high").select("slot", "s")
    ranked = stored(ordered_rank(drawn, ["s"], "slot", rank="nth").select("slot", "s", (F.col("nth") - 1).alias("nth")), "slots")
    given = need.join(ranked.groupBy("s").agg(F.count(F.lit(1)).alias("given")), "s", "left") \
        .withColumn("given", F.least(F.coalesce("given", F.lit(0)), "n_slots")) \
        .withColumn("lacking", F.col("n_slots") - F.col("given"))
    late = sums_before(given.filter("lacking > 0"), [], ["s"], late="lacking") \
        .select("s", F.posexplode(F.sequence(F.col("given"), F.col("n_slots") - 1)).alias("i", "nth"), "late") \
        .select((F.lit(n_slots) + F.col("late") + F.col("i")).alias("slot"), "s", "nth")
    every = ranked.unionByName(late).join(need, "s").filter("nth < n_slots")
    whole = F.least(F.lit(block).cast("long"), size - F.col("block") * block)
    full = F.expr("quota div source_size")
    slots = every.withColumns({"epoch": F.expr("nth div n_blocks"), "block": F.expr("nth % n_blocks")}) \
        .select("slot", "s", "epoch", "block", F.when(F.col("epoch") < full, whole).otherwise(
            F.least(whole, F.col("rest") - F.col("block") * block)).alias("n_words"))
    return Mix(need, slots)


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with ``at``, the words before it in the shuffled stream of its source."""
    names = sources.select(F.col("source").alias("name"), "s", "source_size", "target")
    items = sizes.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source") \
        .withColumn("key", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
                                              1, 15), 16, 10).cast("long")) \
        .withColumn("row", F.monotonically_increasing_id())
    return sums_before(items, ["s"], ["key", "doc_id", "size", "row"], at="size").drop("key", "row")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
          block: int = BLOCK) -> DataFrame:
    """The mix as pieces of documents, and every document that gives none once.

    ``doc_id``, ``size``, ``source_size``, ``target``, ``s`` and ``at`` (which tell equal rows apart), and of a piece ``slot``,
    ``first`` (the number of its first word in the document) and ``n_words``; the last three are null
    of a document that gives nothing, ``at`` of one without words.
    """
    sizes = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"),
                               F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    mix = schedule(docs.sparkSession, targets(sizes, weights, share, epochs), block, epochs)
    items = streams(sizes, mix.sources)
    end = F.col("at") + F.col("size")
    # a document without words lies in no block, and its place in the stream is that of the next one
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block)))
    cut = items.withColumn("block", F.explode_outer(blocks)) \
        .withColumn("start", F.greatest("at", F.col("block") * block))
    slots = mix.slots.select("slot", F.col("s").alias("_s"), F.col("block").alias("_block"), F.col("n_words").alias("_n"))
    stop = F.least(end, (F.col("block") + 1) * block, F.col("block") * block + F.col("_n"))
    joined = cut.join(slots, (F.col("s") == F.col("_s")) & (F.col("block") == F.col("_block")), "left") \
        .withColumn("n_words", stop - F.col("start"))
    gives = F.col("slot").isNotNull() & (F.col("n_words") > 0)
    return joined.select("doc_id", "size", "source_size", "target", "s", F.when(F.col("size") > 0, F.col("at")).alias("at"),
                         F.when(gives, F.col("slot")).alias("slot"),
                         F.when(gives, F.col("start") - F.col("at")).alias("first"), F.when(gives, F.col("n_words")).alias("n_words"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    pieces = mixed(documents(spark, sf_dir))
    own = ["doc_id", "size", "source_size", "target"]
    taken = pieces.filter("size > 0").groupBy(*own, "s", "at").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"))
    empty = pieces.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*own, "taken").unionByName(empty.select(*own, "taken"))


#: The words that a document gives follow from its place in the stream of its source alone.
OP13_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, coalesce(sum(2 * source_size) OVER earlier, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights
      FROM w WINDOW earlier AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (budget - given) * weight > 2 * source_size * weights AS stops FROM l),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE) ELSE
        CAST(budget - sum(CASE WHEN stops THEN 2 * source_size ELSE 0 END) OVER () AS DOUBLE) * weight
        / CAST(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM c),
q AS (SELECT *, CAST(least(2 * source_size, floor(target + 0.5)) AS BIGINT) AS quota FROM t),
a AS (SELECT d.doc_id, d.size, q.source_size, q.target, quota, coalesce(sum(size) OVER (
        PARTITION BY d.source ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT), doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size
            + greatest(0, least(size, quota % source_size - earlier)) END AS BIGINT) AS taken FROM a
"""
