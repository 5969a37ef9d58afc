"""Near-duplicates by HyperMinHash.

A document's set of word shingles becomes `REGISTERS` compressed registers: for each bucket of hashes, the leading-zero
count of the smallest one and the mantissa bits after its leading one. A bucket without a shingle takes the smallest of
hashes of its own, so short texts fill every register too. Four registers, 64 bits, are a band.

Texts with equal sets form a class, of which the smallest id goes on alone. Classes that share a band are candidates. Each
one is first compared with the most central of its bands' members, the one that shares the largest bands, then with those
leaders of its bands that it isn't joined to yet. So a large group of copies costs a comparison for each member and not for
each pair. What is still apart in a band is compared pair by pair in small bands. Large ones are joined to clusters, of which
blocks of members that aren't joined up yet meet each other and the rest. A candidate pair is weighed by its equal
registers, less the collisions expected of such short registers, and what is left is confirmed on the full sets. Every join
that a large band, class, hub or cluster could gather in one task deals its rows in shares.

Defined cases: a null or empty text has an empty set and no links; fewer words than a shingle's make one shingle; a very long
text is one set like others; equal ids of two rows make one document, that of the smallest set; a null id is a document like
others, but never linked; of ties the smallest id counts; an empty table gives no rows; other columns are ignored.
Two documents at a similarity of 0.85 share none of the 32 bands with a chance of about 6e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..operators.graphs import reached
from ._common import TOGETHER, WordHasher, arrow, chunks, discard, frames, hot_keys, mix, salted_join, share_of, staged, text_of

REGISTERS, PER_BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // PER_BAND
_SLOTS = np.arange(REGISTERS, dtype=np.uint64)
_EDGES = _SLOTS << np.uint64(57)
_SALTS = mix(_SLOTS + np.uint64(0xABCDEF))
#: A pair goes to the full sets if its corrected estimate is no further below the threshold than this: six deviations.
SLACK = 0.2
#: Bands of so few members are settled pair by pair; of larger ones, blocks of so many members and shingles meet.
SMALL, MEMBERS, SHINGLES = 16, 256, 200_000
#: Ids that may be broadcast: 8 MB.
FEW = 500_000


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    hasher = WordHasher()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for a, b in chunks(raw, 500_000):
        words, at = hasher(raw[a:b])
        m = len(words) - size + 1
        rolled = sum((words[j : j + m] * factors[j] for j in range(1, size)), words[:m] * factors[0]) if m > 0 else words[:0]
        rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= size:
                s = np.sort(rolled[lo : hi - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                yield mix(np.array([(words[lo:hi] * factors[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
            else:
                yield words[:0]


def _compress(values: np.ndarray, width: int) -> np.ndarray:
    """Of each value below 2**width: its leading zeros, and the bits after its leading one."""
    length = np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0)
    length -= (values < (np.uint64(1) << np.maximum(length - 1, 0).astype(np.uint64))) & (length > 0)  # rounded up in float64
    rest = np.where(length > MANTISSA, values >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), values << np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64))
    return (np.minimum(width - length, 31).astype(np.uint64) << np.uint64(MANTISSA) | rest & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def registers(s: np.ndarray) -> np.ndarray:
    """The compressed registers of a non-empty sorted set."""
    at = np.minimum(np.searchsorted(s, _EDGES), len(s) - 1)
    least = s[at]
    full = least >> np.uint64(57) == _SLOTS
    out = np.empty(REGISTERS, np.uint16)
    out[full] = _compress(least[full] & np.uint64((1 << 57) - 1), 57)
    if not full.all():
        own = mix(s[None, :] ^ _SALTS[~full][:, None]).min(1) >> np.uint64(7)
        out[~full] = _compress(own, 57) | np.uint16(1 << 15)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, class (128 bits of the whole set), registers (2 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column("text").to_pylist(), size)
                rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s) else (0, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary())))], ["doc_id", "n_shingles", "class", "registers"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class binary, registers binary")


@pandas_udf(DoubleType())
def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity by equal registers, less the expected share of registers that collide by chance.

    Two different minima agree if they have one leading-zero count and one mantissa: with k values in a bucket, the
    count's distribution gives at most 1/3, the mantissa 2**-MANTISSA.
    """
    left, right = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
    same, chance = (left == right).mean(1), 2.0**-MANTISSA / 3
    return pd.Series((same - chance) / (1 - chance))


def similar(pairs: DataFrame, docs: DataFrame, size: int, percent: int, hot: DataFrame | None) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union of the full sets of their texts.

    An `a` of very many pairs, which are in `hot`, has its text copied to several shares of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames(batches, 128):
            codes, texts = pd.factorize(pd.concat([part["x"], part["y"]]))
            sets, keep = list(shingle_sets(texts.tolist(), size)), []
            for p, q in zip(codes[: len(part)], codes[len(part) :]):
                s, t = sets[p], sets[q]
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield arrow(part.loc[keep, ["a", "b"]], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    left = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    right = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    met = pairs.join(left, "b")
    return salted_join(met, right, ["a"], ["b"], hot=hot).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those that aren't among ids, if so few are (their number is counted) that a broadcast can tell; else docs,
    as the joins that follow leave them out as well."""
    return docs.join(F.broadcast(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi") if ids.count() <= FEW else docs


def block_links(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members (cluster, id, label, n_shingles) of one cluster that have different labels.

    Members of a cluster's commonest label, already joined up, are never compared with each other: its other members meet
    each other and them, block by block. A block is bounded in members and in shingles, and a task holds two of them. It
    gives a spanning forest of its links, at most one for each member.
    """
    common = members.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", -F.col("label"))).alias("m"))
    hot = hot_keys(members, ["cluster"])
    sided = salted_join(members, common.select("cluster", (-F.col("m.col2")).alias("most")), ["cluster"], ["id"], hot=hot).withColumn("main", F.col("label") == F.col("most"))
    totals = sided.groupBy("cluster").agg(*[F.greatest(F.ceil(F.count(F.when(c, 1)) / MEMBERS), F.ceil(F.coalesce(F.sum(F.when(c, F.col("n_shingles"))), F.lit(0)) / SHINGLES)).cast("int").alias(n) for n, c in (("mains", F.col("main")), ("others", ~F.col("main")))])
    placed = salted_join(sided, totals, ["cluster"], ["id"], hot=hot).withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")), F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    with_main = F.transform(F.when(F.col("mains") > 0, F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.col("block").alias("i"), (-k - 1).alias("j")))
    meets = F.when(F.col("main"), F.transform(others, lambda i: F.struct(i.alias("i"), (-F.col("block") - 1).alias("j")))).otherwise(F.concat(F.transform(others, lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))), with_main))
    rows = placed.where("others > 0").join(narrowed(docs, members.select("id").distinct()).withColumnRenamed("doc_id", "id"), "id").select("cluster", "id", "label", "text", F.explode(F.array_distinct(meets)).alias("m")).select("cluster", "m.i", "m.j", "id", "label", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, labels, sets = group["id"].to_numpy(), group["label"].to_numpy(), list(shingle_sets(group["text"].tolist(), size))
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        words, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(inverse, kind="stable")
        inverse, owner = inverse[order], owner[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, len(words), 8192):
            a, b = np.searchsorted(inverse, (lo, lo + 8192))
            x = np.zeros((len(sets), 8192), np.float32)
            x[owner[a:b], inverse[a:b] - lo] = 1
            both += x @ x.T
        i, j = np.nonzero((100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & (labels[:, None] != labels[None]) & (both > 0))
        parent = {int(x): int(x) for x in labels}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = root(int(labels[x])), root(int(labels[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    texts = text_of(docs)
    signed = staged(signatures(texts, size))
    one = staged(signed.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "class", "registers")).alias("s")).select("doc_id", "s.*"))
    some = one.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    found = staged(some.groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("s")).select("class", "s.*"))
    size_of = found.select(F.col("doc_id").alias("id"), "n_shingles", "registers")  # a row for each class: its smallest id
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.cast("byte").alias("band"), F.substr("registers", i * 8 + 1, F.lit(8)).alias("key")))
    bands = found.select(F.col("doc_id").alias("id"), F.explode(each).alias("x")).select("id", "x.band", "x.key")
    counted = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # members of bands with more than one; a large band's are dealt in shares from here on
    shares = lambda: F.ceil(F.col("n") / TOGETHER).cast("int")
    shared = staged(salted_join(bands, counted, ["band", "key"], ["id"]).withColumn("share", share_of(["id"], shares())))
    on = ["band", "key", "share"]
    spread = lambda table: table.withColumn("share", F.explode(F.sequence(F.lit(0), shares() - 1))).drop("n")
    # of a large group of edited copies, the one nearest to what they were made from shares the largest bands
    central = shared.groupBy("id").agg(F.sum("n").alias("met"))
    ranked = shared.join(central, "id").withColumn("rank", F.struct((-F.col("met")).alias("met"), F.col("id").alias("a")))
    leaders = staged(ranked.groupBy("band", "key").agg(F.min("rank").alias("rank"), F.max("n").alias("n")))

    def confirm(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that are links. Only an `a`, a leader, can have many: an id has BANDS bands."""
        pairs = staged(pairs)
        hot = hot_keys(pairs, ["a"])
        sides = [size_of.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("registers").alias(f"r{k}")) for k in "ab"]
        weighed = salted_join(pairs.join(sides[1], "b"), sides[0], ["a"], ["b"], hot=hot).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        likely = staged(weighed.where(estimate("ra", "rb") >= percent / 100 - SLACK).select("a", "b"))
        ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return staged(similar(likely, narrowed(texts, ids), size, percent, hot))

    led = shared.join(spread(leaders), on).where(F.col("id") != F.col("rank.a"))
    links = confirm(led.groupBy("id").agg(F.min("rank")["a"].alias("a")).select("a", F.col("id").alias("b")))
    labels = reached(links)
    labelled = lambda: staged(shared.join(labels, "id", "left").select("id", "band", "key", "n", "share", F.coalesce("label", "id").alias("label")))
    apart = lambda rows: rows.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("n").alias("n")).where("lo <> hi").select("band", "key", "n")
    members = labelled()
    still = members.join(spread(apart(members)), on)  # bands whose members are apart
    x, y = (still.where(F.col("n") <= SMALL).select("band", "key", F.col("id").alias(k), F.col("label").alias(f"l{k}")) for k in "ab")
    few = x.join(y, ["band", "key"]).where("a < b and la <> lb").select("a", "b")
    led = still.where(F.col("n") > SMALL).join(spread(leaders), on).select(F.col("rank.a").alias("a"), F.col("id").alias("b")).where("a <> b")
    links = staged(links.union(confirm(few.union(led).distinct().join(links, ["a", "b"], "left_anti"))))
    labels = reached(links)
    members = labelled()
    large = staged(members.where(F.col("n") > SMALL).join(spread(apart(members)), on))
    if large.limit(1).count():
        hubs = large.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("n").alias("n"))
        clusters = reached(large.join(spread(hubs), on).select("a", F.col("id").alias("b")).distinct())
        crowd = large.select("id", "label").distinct().join(clusters.withColumnRenamed("label", "cluster"), "id").join(size_of.drop("registers"), "id")
        labels = reached(links.union(block_links(staged(crowd), texts, size, percent)))
    reps = found.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("class", F.coalesce("label", "doc_id").alias("component_id"))
    linked = salted_join(some, reps, ["class"], ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    alone = one.where(F.col("class").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def near_duplicates_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
