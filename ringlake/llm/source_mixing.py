"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlake.llm.common import WORD, checkpoint

#: A document is taken so many times at most.
MAX_COPIES = 3

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)

KEY_BITS = 60
LEAST_ID = -(2**63)


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of the md5 of seed and id: the order in which a source's documents come."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, rank, n, source_size, target) for each source.

    Targets share the total size by weight; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight, until none is above. Sources fill in
    order of capacity a weight unit, so one running sum finds the level at which all others
    stand. One row per source goes through one task here; no documents do.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("unit", "rank")
    total = F.sum("source_size").over(Window.partitionBy())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        .withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("unit", F.col("cap").cast("double") / F.col("weight").cast("double"))
    )
    filled = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = sources.withColumn("level", (total - filled).cast("double") / open_weight.cast("double"))
    # `level` falls from the first source that is not full onwards, so that one is the largest of them
    level = F.max(F.when(F.col("unit") >= F.col("level"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("unit") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return levels.select("source", "rank", "n", "source_size", target.alias("target"))


def _cut(copies: DataFrame, total: int) -> tuple | None:
    """The first copy, in order of virtual finish, that the budget does not reach.

    The order is cut into ranges of virtual time, and the range in which the running size
    passes the budget is cut again; only the last range is sorted row by row. Each step
    sends a few thousand sums, never documents, to one task.
    """
    steps, before = 4096, 0
    within, coarse = F.lit(True), F.least(F.floor(F.col("vt") * steps), F.lit(2 * steps))
    fine = F.least(F.floor((F.col("vt") * steps - F.floor(F.col("vt") * steps)) * steps), F.lit(steps - 1))
    for bucket in (coarse, fine):
        sums = copies.where(within).groupBy(bucket.alias("b")).agg(F.sum("size").alias("s"))
        running = sums.select("b", "s", F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
        row = running.where(F.col("c") + before > total).orderBy("b").first()
        if row is None:
            return None
        before += row["c"] - row["s"]
        within = within & (bucket == row["b"])
    order = ["vt", "rank", "key", "id", "size", "copy"]
    running = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    row = copies.where(within).withColumn("c", running).where(F.col("c") + before > total).orderBy(*order).first()
    return None if row is None else tuple(row[c] for c in order)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (and copies).

    The size of a document is its number of words. Each source puts its documents in a
    hashed order and repeats that order up to ``most`` times; a copy's virtual finish time
    is the source's words up to its end divided by the source's target. Copies of all
    sources, ordered by finish time, are taken until their words reach the total.

    The running sums are two-level: rows are sorted by range over (source, key, id, size) and
    their place in the table, so that neither a source nor an id of any share, nor equal rows,
    meet in one task; sums of ranges are added up first and each range then adds its own
    rows. Results don't depend on the number of ranges or partitions.

    Null texts have size 0. The null source is a source and comes last. Documents of size 0
    take nothing. Rows with equal or null ids are ordered by size too; equal rows are
    interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    return _mix(docs, seed, weights, most).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, row: Column | None = None) -> DataFrame:
    """`mix` with a column ``row`` if one is given; rows of equal id and size come in its order."""
    more = [] if row is None else ["row"]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = checkpoint(docs.select("doc_id", "source", size.alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key"), F.monotonically_increasing_id().alias("place"), *([] if row is None else [row.alias("row")])))
    sources = checkpoint(source_targets(sized, weights, most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    order = ["key", "id", "size", *more, "place"]
    ranged = checkpoint(sized.withColumn("id", F.coalesce("doc_id", F.lit(LEAST_ID))).repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), before.alias("before"))
    placed = sources.select(F.col("source").alias("s_source"), "rank", "source_size", "target")
    offsets = offsets.join(placed, F.col("o_source").eqNullSafe(F.col("s_source"))).drop("s_source")
    inside = Window.partitionBy("part", "rank").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queue = checkpoint(
        ranged.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("part") == F.col("o_part")))
        .withColumn("end", F.col("before") + F.sum("size").over(inside))
    )

    def finish(copy: int) -> Column:
        return (F.col("end") + F.lit(copy) * F.col("source_size")).cast("double") / F.col("target")

    queued = queue.where("size > 0").select("rank", "key", "id", "size", F.explode(F.array(*[F.struct(finish(i).alias("vt"), F.lit(i).alias("copy")) for i in range(most)])).alias("c"))
    cut = _cut(queued.select("rank", "key", "id", "size", "c.vt", "c.copy"), total)
    fields = ["rank", "key", "id", "size"]
    if cut is None:
        copies = F.lit(most)
    else:
        limit = F.struct(F.lit(cut[0]), F.lit(cut[1]).cast("int"), F.lit(cut[2]).cast("long"), F.lit(cut[3]).cast("long"), F.lit(cut[4]).cast("long"), F.lit(cut[5]).cast("int"))
        taken = [F.struct(finish(i), *map(F.col, fields), F.lit(i)) < limit for i in range(most)]
        copies = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("long")
    return queue.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *more)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken; all columns.

    The key is the whole row (doc_id and a hash of all columns), so each row takes its own
    copies where ids are null or repeated; of equal rows one stands for all their copies. The
    mix has a key for each copy, so that copies of one row spread over tasks where they are
    many. Null texts take no copies; an empty table gives no rows.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    copies = _mix(docs, **options, row=row).where("copies > 0").select(F.struct("doc_id", "row").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = docs.select(F.struct("doc_id", row.alias("row")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    joined = copies.join(rows.groupBy("key").agg(F.first("r").alias("r")).hint("merge"), F.col("key").eqNullSafe(F.col("id")))
    return joined.select("r.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM by_source),
weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap,
         (source_size * 3)::DOUBLE / ((rank - 1) % 3 + 1)::DOUBLE AS unit
  FROM ranked),
levels AS (
  SELECT *,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY unit, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / (sum(weight) OVER (ORDER BY unit, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, rank, source_size,
    CASE WHEN unit < level THEN cap::DOUBLE
         ELSE weight * max(CASE WHEN unit >= level THEN level END) OVER () END AS target
  FROM levels),
queue AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, d.key, row_number() OVER () AS row_id,
    sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, coalesce(d.doc_id, {LEAST_ID + 1} - 1), d.size ROWS UNBOUNDED PRECEDING) AS stop
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (stop + copy * source_size)::DOUBLE / target AS vt
  FROM queue, (VALUES (0), (1), (2)) AS c(copy) WHERE size > 0),
running AS (
  SELECT row_id, size,
    sum(size) OVER (ORDER BY vt, rank, key, coalesce(doc_id, {LEAST_ID + 1} - 1), size, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM copies),
taken AS (
  SELECT row_id, sum(size)::BIGINT AS taken FROM running
  WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY row_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken,
       CASE WHEN q.size > 0 THEN coalesce(t.taken, 0) // q.size ELSE 0 END::BIGINT AS copies
FROM queue q LEFT JOIN taken t USING (row_id)
"""
