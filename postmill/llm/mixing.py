"""Mix sources to target weights with nested hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: A hash has 60 bits; the first two histograms have 2^10 buckets each, and the last takes the hashes of one bucket of a source.
HASH_BITS, BUCKET_BITS = 60, 10
#: Rounds that fill what the first threshold leaves, with documents that fit.
ROUNDS = 3
_END = 1 << HASH_BITS


#: Sources whose plan is broadcast; a longer plan meets the rows in a join that deals each source to SALTS tasks.
BROADCAST_SOURCES, SALTS = 10_000, 64


def document_hash(id_col: str, text_col: str):
    """60 bits of the md5 of id and text; only rows that repeat both have the same."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def _meet(rows: DataFrame, plan: DataFrame, small: bool, key: str, of: str, spread: str) -> DataFrame:
    """Rows with the plan of their source: broadcast where its size allows it, else each source's rows are dealt by ``spread``."""
    same = F.col(of).eqNullSafe(F.col(key))
    if small:
        return rows.join(F.broadcast(plan), same)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = plan.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("salt") == F.col("salt_of"))).drop("salt", "salt_of")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above ``most`` times its source.

    Sources in the order of their code points, null last, take the weights in turn. A source is full when its limit for a weight
    of one is below the level that the others would then share, so the full ones come first in the order of that limit; this is
    where resharing the excess ends. One row per source goes through the windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    taken_in_turn = F.array(*(F.lit(w) for w in weights))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(taken_in_turn, (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("limit", most * F.col("source_size"))
        .withColumns({
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
            "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        })
        .withColumn("level", F.col("left").cast("double") / F.col("heavy").cast("double"))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
        .withColumn("shared", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "nth", "level"))).over(everything)["level"])
        .select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"))
    )


def _cut(rows: DataFrame, small: bool) -> DataFrame:
    """nth, cut, got, one: of the rows (nth, hash, size, room), the first hash of each source with which the words pass ``room``, the words before, and
    the size of the document that has it.

    A source whose rows all fit has no row. Three histograms: each sums words by source and bucket, finds the bucket in which the
    room ends, and only that bucket's rows are summed again. Sums are combined before they are shuffled.
    """
    part = Window.partitionBy("nth")

    def boundary(summed: DataFrame, key: str) -> DataFrame:
        run = Window.partitionBy("nth").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = summed.withColumn("upto", F.sum("words").over(run) + F.col("got")).where("upto > room")
        return passed.withColumn("least", F.min(key).over(part)).where(F.col("least") == F.col(key)).withColumn("got", F.col("upto") - F.col("words"))

    def inside(found: DataFrame, key: str, bucket) -> DataFrame:
        met = _meet(rows.withColumn("bucket", bucket), found.withColumnsRenamed({"nth": "at"}), small, "at", "nth", "hash")
        return met.where(F.col("bucket") == F.col(key)).drop("at", key)

    first, second = F.shiftright("hash", HASH_BITS - BUCKET_BITS), F.shiftright("hash", HASH_BITS - 2 * BUCKET_BITS)
    coarse = boundary(rows.groupBy("nth", "room", first.alias("b")).agg(F.sum("size").alias("words")).withColumn("got", F.lit(0)), "b").select("nth", "b", "got")
    fine = boundary(inside(coarse, "b", first).groupBy("nth", "room", "got", second.alias("c")).agg(F.sum("size").alias("words")), "c").select("nth", "c", "got")
    last = inside(fine, "c", second).groupBy("nth", "room", "got", "hash").agg(F.sum("size").alias("words"), F.max("size").alias("one"))
    return boundary(last, "hash").select("nth", F.col("hash").alias("cut"), "got", "one")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``, and its columns named in ``carry``.

    size counts the words of the text (null: 0). target is that of the row's source (``source_targets``; null is a source). Every
    document is taken floor(target / source_size) times, and once more if its hash, of id and text, is below its source's threshold, the largest
    one that keeps the words within the rest of the target. Up to two further rounds fill what the boundary document left with
    documents beyond it that fit. So no document exceeds ``most`` times its size, reruns agree, and the words of a source miss its target by
    less than a document, also where ids are null or repeat. Rows that repeat id and text are told apart by a number only where the threshold
    falls among them: as many of them as fit are taken. Empty texts take 0; sources of no words have target 0.
    An empty table gives an empty result. Other columns are not read, and no text is shuffled, but for those repeats.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    measured = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("of"), document_hash(id_col, text_col).alias("hash"), words.alias("size"),
        F.struct(F.lit(0).alias("_"), *[F.col(x).alias(f"c{n}") for n, x in enumerate(carry)]).alias("carried"),
    )
    sizes = measured.select("doc_id", "of", "hash", "size").checkpoint()
    plan = (
        source_targets(sizes.withColumnRenamed("of", "source"), weights, most)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("room1", F.floor(F.col("target") - F.col("base") * F.col("source_size")))
        .withColumn("nth", F.xxhash64("source", F.lit(1)))
        .withColumn("nth", F.row_number().over(Window.orderBy("nth", F.col("source").asc_nulls_last())))
        .checkpoint()
    )
    small = plan.count() <= BROADCAST_SOURCES
    rows = _meet(sizes, plan.select("source", "nth"), small, "source", "of", "hash").select("nth", "hash", "size").where("size > 0")
    state = plan.select(F.col("nth").alias("at"), F.col("room1").alias("room"), F.lit(-1).cast("long").alias("since"))
    end = F.lit(_END).cast("long")
    for n in range(1, ROUNDS + 1):
        fit = _meet(rows, state, small, "at", "nth", "hash").where("room > 0 AND hash > since" + (" AND size <= room" if n > 1 else ""))
        found = _cut(fit.select("nth", "hash", "size", "room"), small)
        # Of the rows that share the boundary's hash, the first few that fit are taken: ``some`` of them.
        some = F.coalesce(F.floor((F.col("room") - F.col("got")) / F.col("one")), F.lit(0))
        found = state.join(found, F.col("at") == F.col("nth"), "left").select(
            "at", F.coalesce("cut", end).alias("since"), some.alias("some"), F.when(F.col("cut").isNotNull(), F.col("room") - F.col("got") - some * F.col("one")).otherwise(0).alias("rest")).checkpoint()
        plan = plan.join(found.select("at", F.col("since").alias(f"cut{n}"), F.col("some").alias(f"some{n}"), F.col("rest").alias(f"room{n + 1}")), F.col("nth") == F.col("at")).drop("at")
        state = found.select("at", F.col("rest").alias("room"), "since")
    plan = plan.checkpoint()
    once, among = F.lit(False), F.lit(0).cast("long")
    for n in range(ROUNDS, 0, -1):
        open_ = F.col(f"room{n}") > 0
        if n > 1:
            open_ &= (F.col("hash") > F.col(f"cut{n - 1}")) & (F.col("size") <= F.col(f"room{n}"))
        once |= open_ & (F.col("hash") < F.col(f"cut{n}"))
        among = F.when(open_ & (F.col("hash") == F.col(f"cut{n}")), F.col(f"some{n}")).otherwise(among)
    met = _meet(measured if carry else sizes, plan, small, "source", "of", "hash").withColumns({"once": once, "among": among})
    # Repeated rows at a boundary, of which some are taken: numbered by the task they lie in, and within it.
    repeats = met.where("among > 0 AND NOT once").withColumn("lies", F.spark_partition_id()).checkpoint()
    before = repeats.groupBy("nth", "hash", "lies").count().select(
        F.col("nth").alias("at"), F.col("hash").alias("of_hash"), F.col("lies").alias("in"), F.coalesce(F.sum("count").over(Window.partitionBy("nth", "hash").orderBy("lies").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("nth", "hash", "lies").orderBy("size"))
    numbered = repeats.withColumn("number", here).join(before, (F.col("nth") == F.col("at")) & (F.col("hash") == F.col("of_hash")) & (F.col("lies") == F.col("in")))
    taken = lambda more: (F.col("size") * (F.col("base") + more.cast("long"))).cast("long").alias("taken")
    out = lambda df, more: df.select("doc_id", "size", "source_size", "target", taken(more), *(F.col("carried")[f"c{n}"].alias(x) for n, x in enumerate(carry)))
    return out(met.where("among = 0 OR once"), F.col("once")).union(out(numbered, F.col("before") + F.col("number") <= F.col("among")))


def mixing_sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> str:
    """DuckDB SQL for ``mix_sources`` over ``documents``: sorted running sums in place of histograms."""
    case = " ".join(f"WHEN {n} THEN {w}" for n, w in enumerate(weights))
    return rf"""
WITH hashed AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS hash,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sizes AS (SELECT *, row_number() OVER (ORDER BY hash) AS id FROM hashed),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sizes GROUP BY source),
caps AS (SELECT *, CASE nth % {len(weights)} {case} END AS weight, {most} * source_size AS lim FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM caps WINDOW b AS (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT level FROM levels WHERE NOT lim <= level * weight ORDER BY lim / weight, nth LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN lim <= level * weight THEN lim::DOUBLE ELSE (SELECT level FROM shared) * weight END AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM targets),
r1 AS (
  SELECT s.*, p.source_size, p.target, p.base, floor(p.target - p.base * p.source_size)::BIGINT AS room1,
         sum(s.size) OVER (PARTITION BY p.source ORDER BY s.id ROWS UNBOUNDED PRECEDING) AS upto1
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
r2 AS (
  SELECT *, room1 - coalesce(max(CASE WHEN upto1 <= room1 THEN upto1 END) OVER (PARTITION BY source), 0) AS room2, upto1 <= room1 AS in1 FROM r1),
f2 AS (SELECT id, sum(size) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto2 FROM r2 WHERE NOT in1 AND size <= room2 AND size > 0),
r3 AS (
  SELECT r2.*, upto2, room2 - coalesce(max(CASE WHEN upto2 <= room2 THEN upto2 END) OVER (PARTITION BY source), 0) AS room3,
         coalesce(upto2 <= room2, FALSE) AS in2, min(CASE WHEN upto2 > room2 THEN hash END) OVER (PARTITION BY source) AS cut2
  FROM r2 LEFT JOIN f2 USING (id)),
f3 AS (SELECT id, sum(size) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto3 FROM r3 WHERE hash >= cut2 AND size <= room3 AND size > 0)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN in1 OR in2 OR coalesce(upto3 <= room3, FALSE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r3 LEFT JOIN f3 USING (id)"""
