"""What the operators of this subpackage share: staged tables, deterministic samples, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import TOGETHER, hot_keys, salted_join, share_of
from ..operators.storage import discard, shared_dir, staged

#: The six bytes that separate words everywhere in this subpackage: space, and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
_POWER_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_POWER_BASE, -1, 1 << 64)


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, a null text as an empty one; clashing extra columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(doc_id="doc_id"):
    """True for the fifth of the rows that no model learns from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled rows outside the held-out fifth, chosen by a hash of the id.

    Ids beyond `most` are left out before any text is touched, so the broadcast side has a fixed bound. Rows that repeat
    an id count once in labels (their largest label).
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return text_of(docs).join(F.broadcast(picked), "doc_id")


def frames(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches as small frames, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows).to_pandas()


def arrow(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done, step = 1, base % (1 << 64)
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done, step = done + m, step * step % (1 << 64)
    return out


class WordHasher:
    """64-bit hashes of the words of many texts at once, A-Z taken as a-z; no loop over words."""

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self.lower[65:91] += np.uint64(32)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes in order, for each text the number of words before it and after the last)."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_POWER_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        gap = self.space[data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.lower[data] * self.up[: len(data)], out=total[1:])
        words = mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        return words, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def chunks(texts: list[bytes], most: int = 2_000_000):
    """Slices of consecutive texts of about `most` bytes; a longer text has a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
