"""Mixing sources to target weights by entropy balancing.

Every document has a rate between 0 and `MOST`, the expected copies of it. Of all rates that give each source its target
of words, those nearest to one copy each in bounded relative entropy are sought. Their dual is convex, with one
multiplier for each source's word constraint; its solution tilts a document's odds exponentially with its words:
rate = MOST * sigmoid(log(1 / (MOST - 1)) + multiplier * words / mean words). Newton's method solves it for all sources
at once, as sums over a table of (source, size, documents): documents of one source and size have one rate, so the
iterations read that table and never the documents. A bracket holds each step.

Rates become whole copies by systematic rounding over sizes, largest first, and a few single copies then move to bring
each source's words nearer its target. Documents of one source and size share the copies evenly, in the order of a hash of
id and text. Rows with one hash are counted for each input partition first; these counts are numbered within blocks of about
`BLOCK` hashes, and rows within their count. So no source and no group of equal rows is gathered in one task.

Texts are read once, for their sizes; a row's number joins its copies back to it.

Defined cases: a null or empty text has size 0, takes 0 words and keeps one copy of itself; a very long one counts whole; a
null source is a source, the last; rows that repeat are documents of their own, and it's all the same which of equal rows has
a copy more; an empty table gives no rows. `mix` keeps other columns, but for those named as its own results, which it
replaces; `repeated` keeps all. Windows without a hash key run over one row for each source, or each source's distinct sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, discard, salted_join, staged

MOST, BLOCK, STEPS, MOVES = 3, 500, 60, 4


def targets(sources: DataFrame) -> DataFrame:
    """(source_key, source_size) -> and target: weights 1, 2, 3, repeating, share the sum of all sizes; MOST times its own
    size stops a source. With sources ordered by that bound over weight, one level serves all that it doesn't stop."""
    every = Window.partitionBy()
    ranked = sources.withColumn("weight", ((F.row_number().over(Window.orderBy("source_key")) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("bound", (F.lit(MOST) * F.col("source_size")).cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    upto = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    common = F.min(F.when(F.col("free"), F.struct("ratio", "source_key", "level"))).over(every)["level"]
    return ranked.select("source_key", "source_size", F.when(common.isNull() | (F.col("ratio") < common), F.col("bound")).otherwise(common * F.col("weight")).alias("target"))


def _rate(multiplier: str = "multiplier"):
    tilt = F.col(multiplier) * F.col("size") / F.col("mean")
    odds = F.least(F.greatest(tilt - F.log(F.lit(MOST - 1.0)), F.lit(-600.0)), F.lit(600.0))
    return F.when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), F.lit(float(MOST))).otherwise(MOST / (1 + F.exp(-odds)))


def multipliers(table: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with the multiplier that brings each source's expected words to its target, by safeguarded Newton steps."""
    state = staged(sources.select("*", F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        rate, words = _rate(), F.col("n") * F.col("size")
        sums = table.join(state, "source_key").groupBy("source_key").agg(F.sum(words * rate).alias("got"), F.sum(words * F.col("size") / F.col("mean") * rate * (1 - rate / MOST)).alias("slope"))
        s = state.join(sums, "source_key").withColumn("gap", F.col("got") - F.col("target"))
        s = s.withColumn("lo", F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") >= 0, F.col("multiplier")).otherwise(F.col("hi")))
        newton = F.col("multiplier") - F.col("gap") / F.greatest("slope", F.lit(1e-300))
        wide = F.when(F.col("gap") < 0, F.greatest(2 * F.abs("multiplier"), F.lit(1.0))).otherwise(-F.greatest(2 * F.abs("multiplier"), F.lit(1.0)))
        inside = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.col("multiplier") + F.greatest(F.least(newton - F.col("multiplier"), F.abs(wide)), -F.abs(wide)))
        inside = inside.otherwise(F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        still = (F.abs("gap") > 1e-9 * F.greatest("target", F.lit(1.0))) & (F.col("target") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-12))
        last, state = state, staged(s.select("source_key", "source_size", "mean", "target", F.when(still, inside).otherwise(F.col("multiplier")).alias("multiplier"), "lo", "hi", (~still).alias("done")))
        discard(last)
        if state.where("not done").limit(1).count() == 0:
            break
    return state


RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def _mixed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns in keep), and RESULTS."""
    key = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col("source"), F.lit("")))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    every = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias("id"), size.alias("size"), key.alias("source_key"), F.xxhash64("doc_id", "text").alias("order")))
    sized = every.select("id", "size", "source_key", "order", F.shiftright("id", 33).alias("part"))
    table = staged(sized.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = table.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents"))
    mean = sources.select("source_key", F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9)).alias("mean"))
    solved = multipliers(table, targets(sources).join(mean, "source_key"))
    upto = Window.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    rated = table.join(solved.drop("lo", "hi", "done"), "source_key").withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate()))
    upper = F.floor(F.sum(F.col("n") * F.col("rate")).over(upto) + 0.5)
    rated = rated.withColumn("upper", upper)
    previous = F.coalesce(F.lag("upper").over(Window.partitionBy("source_key").orderBy(F.desc("size"))), F.lit(0))
    plan = staged(rated.withColumn("total", F.greatest(F.lit(0), F.least(F.col("upper") - previous, MOST * F.col("n")))).drop("upper", "multiplier", "mean"))
    for _ in range(MOVES):
        gaps = plan.groupBy("source_key").agg((F.max("target") - F.sum(F.col("total") * F.col("size"))).alias("gap"))
        offers = plan.join(gaps, "source_key").where("size > 0").withColumn("step", F.when((F.col("gap") > 0) & (F.col("total") < MOST * F.col("n")), 1).when((F.col("gap") < 0) & (F.col("total") > 0), -1))
        best = offers.where("step is not null").groupBy("source_key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("step") * F.col("size")).alias("rest"), "size", "step", F.abs("gap").alias("was"))).alias("m")).where("m.rest < m.was")
        plan = staged(plan.join(best, "source_key", "left").withColumn("total", F.col("total") + F.when(F.col("m.size") == F.col("size"), F.col("m.step")).otherwise(F.lit(0))).drop("m"))
    parts = plan.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    cell = ["source_key", "size", "order", "part"]
    cells = staged(sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("c")))
    block = F.pmod(F.col("order"), F.col("blocks")).alias("block")
    blocked = staged(salted_join(cells, parts.select("source_key", "size", "blocks"), ["source_key", "size"], ["order", "part"]).select(*cell, "c", block))
    keys = ["source_key", "size", "block"]
    before = Window.partitionBy("source_key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy(*keys).agg(F.sum("c").alias("here")).select(*keys, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(*keys).orderBy("order", "part").rowsBetween(Window.unboundedPreceding, -1)
    # a count for each hash and input partition: equal rows are as many rows here as there are partitions
    starts = blocked.withColumn("start", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(counts, keys).select(*cell, (F.col("start") + F.col("earlier")).alias("start"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("id"))
    placed = staged(sized.withColumn("place", place).join(starts, cell).select("id", "source_key", "size", (F.col("place") + F.col("start")).alias("place")))
    rest = parts.select("source_key", "size", "n", "total", "rate", "source_size", "target")
    each = (F.floor(F.col("total") / F.col("n")) + F.when(F.col("place") <= F.col("total") % F.col("n"), 1).otherwise(0)).cast("long")
    done = salted_join(placed, rest, ["source_key", "size"], ["id"]).select("id", "source_size", "target", "rate", each.alias("copies"))
    return every.select("row", "id", "size").join(done, "id").select("row", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns in keep, with size, source_size, target, rate, copies and taken = copies * size."""
    names = [c for c in keep or docs.columns if c not in RESULTS]
    return _mixed(docs, names).select(*[F.col("row")[c].alias(c) for c in names], *RESULTS)


def repeated(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of docs."""
    times = _mixed(docs, docs.columns).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return times.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
