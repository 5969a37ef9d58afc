"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, their weights the counts. For each of `SAMPLES` hashes, a term draws two gamma(2, 1)
variables r and c and a uniform b from its own hash, quantises its log weight to t = floor(log(w) / r + b), and gets the
value log(c) - r * (t - b) - r; the term and t with the smallest value are the sample. Two texts have equal samples with a
chance that equals their generalised Jaccard similarity: the sum of the smaller weights over that of the larger.

All is done in DataFrame expressions: counts and minima in hash aggregates, samples in generated code, as packed 63-bit
numbers (value above, sample below). Rows stay where the join by doc_id dealt them, so terms are never shuffled; they carry
no more than that id, and what else belongs to a document joins at the end.

Defined cases: a null text is empty; a text without words has the fingerprint '', alike (1.0) to another such and unlike
(0.0) to any with words; a very long text counts whole; a null doc_id has no place in the order and no row; rows that repeat an id count once (the text
with the smallest hash); a table of one document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, text_of

SAMPLES, WIDE, CODE_BITS = 64, 4, 16
#: Code points of a part's texts, about.
PART = 4_000_000


def neighbours(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """meta with next_id: the largest smaller key, and for the smallest the largest. A range sort deals the keys; each part
    looks back within itself, and only its first key at the table of parts' last keys, a row for each part."""
    dealt = staged(meta.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max(key).alias("last"))
    ends = ends.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.partitionBy())).alias("before"))
    inside = F.lag(key).over(Window.partitionBy("part").orderBy(key))
    return dealt.withColumn("inside", inside).join(F.broadcast(ends), "part").select(*meta.columns, F.coalesce("inside", "before").alias("next_id"))


def counted_terms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mask, term, n: the words of columns a and b of texts, by hash, with their counts. A word as frequent in both
    gives one row of mask 3, else each text has a row of its own, mask 1 or 2.

    texts are dealt by the first key, so the counts are summed up where the rows are."""
    both = texts.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("t")), F.struct(F.lit(2).alias("side"), F.col("b").alias("t")))).alias("x"))
    words = both.select(*keys, "x.side", F.explode(F.split("x.t", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*[F.coalesce(F.sum((F.col("side") == k).cast("long")), F.lit(0)).alias(c) for k, c in ((1, "p"), (2, "q"))])
    pair = lambda mask, n: F.struct(F.lit(mask).alias("mask"), F.col(n).alias("n"))
    rows = F.when(F.col("p") == F.col("q"), F.array(pair(3, "p"))).when(F.col("q") == 0, F.array(pair(1, "p"))).when(F.col("p") == 0, F.array(pair(2, "q"))).otherwise(F.array(pair(1, "p"), pair(2, "q")))
    return counts.select(*keys, "term", F.explode(rows).alias("x")).select(*keys, "x.mask", "term", "x.n")


def _uniform(x: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) * (1.0 / (1 << bits))


def samples(frame: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of keys and each part of the hashes, the smallest packed (value, code of the sample) of WIDE hashes.

    frame has a row for each term. It is repeated for each part, as the code of all hashes in one row is more than the JVM
    compiles. A code is made of the bits of the term's hash that matter least to its draws, and of t."""
    log_w = F.log(F.col("n").cast("double"))
    base = frame.select(*keys, "term", log_w.alias("log_w"), F.explode(F.array(*[F.lit(k) for k in range(SAMPLES // WIDE)])).alias("part"))
    base = base.withColumn("h", F.xxhash64("term", "part"))
    out = []
    for k in range(WIDE):
        x, y = F.xxhash64("h", F.lit(2 * k)), F.xxhash64("h", F.lit(2 * k + 1))
        r, c, b = -F.log(_uniform(x, 0, 32) * _uniform(x, 32, 32)), -F.log(_uniform(y, 0, 21) * _uniform(y, 21, 21)), _uniform(y, 42, 21)
        t = F.floor(F.col("log_w") / r + b)
        value = F.log(c) - r * (t - b) - r
        code = x.bitwiseXOR(t).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
        out.append(F.shiftleft(((value + 1024.0) * float(1 << 35)).cast("long"), CODE_BITS).bitwiseOR(code).alias(f"s{k}"))
    return base.select(*keys, "part", *out).groupBy(*keys, "part").agg(*[F.min(f"s{k}").alias(f"s{k}") for k in range(WIDE)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal codes."""
    same = F.size(F.filter(F.zip_with(a, b, lambda p, q: p == q), lambda e: e)) / F.greatest(F.size(a), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) != F.size(b), 0.0).otherwise(same)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, codes, edited_codes, next_id: codes are arrays of SAMPLES ints, empty without words."""
    texts = text_of(docs).where("doc_id is not null")
    meta = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    if meta.groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
        texts = staged(texts.withColumn("first", first).where("first = 1").drop("first"))
        meta = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    links = staged(neighbours(meta).withColumn("need", F.floor(F.col("n_chars") / 3)))
    # dealt once for all that follows, in parts small enough for the counts of their terms to stay in memory
    texts = texts.repartition(max(8, int((links.agg(F.sum("n_chars")).first()[0] or 0) // PART)), "doc_id")
    lent = texts.join(links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "need"), "doc_id")
    lent = lent.select("for_id", F.substr("text", F.lit(1), F.col("need").cast("int")).alias("prefix"))
    both = texts.join(links, "doc_id").join(lent, F.col("doc_id") == F.col("for_id"))
    both = both.select("doc_id", "next_id", "n_chars", "text", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("need")).cast("int")), "prefix").alias("edited"))
    keys = ["doc_id"]
    texts = both.select("doc_id", F.col("text").alias("a"), F.col("edited").alias("b"))
    digests = both.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    least = samples(counted_terms(texts, keys), [*keys, "mask"])
    pick = lambda k, bit: F.min(F.when(F.col("mask").bitwiseAND(F.lit(bit)) > 0, F.col(f"s{k}")))
    merged = least.groupBy(*keys, "part").agg(*[pick(k, bit).alias(f"{v}{k}") for v, bit in (("a", 1), ("b", 2)) for k in range(WIDE)])
    code = lambda v: F.when(F.col(f"{v}0").isNull(), F.array().cast("array<int>")).otherwise(F.array(*[F.col(f"{v}{k}").bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("int") for k in range(WIDE)]))
    none = F.array().cast("array<int>")
    parts = merged.select(*keys, F.struct("part", code("a").alias("a"), code("b").alias("b")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return staged(digests.join(parts, "doc_id", "left").select("doc_id", "next_id", "n_chars", "edited_sha256", *[F.coalesce(F.flatten(f"x.{v}"), none).alias(n) for v, n in (("a", "codes"), ("b", "edited_codes"))]))


def fingerprints_query(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
    after = found.select(F.col("doc_id").alias("next_id"), F.col("codes").alias("next_codes"))
    return found.join(after, "next_id").select("doc_id", "n_chars", "edited_sha256", text(F.col("codes")).alias("fingerprint"), text(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
