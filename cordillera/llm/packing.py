"""Packing: concatenate and cut.

Two passes. The first encodes every document once, and each partition keeps the running token count of its documents;
the partition totals, a row for each partition, are summed up to offsets. In the second, a document's global offset is
its partition's offset plus what stands before it there, so each document is cut at the multiples of the window by
itself: a piece is a boundary record of one document in one window. No text or token is shuffled.

Defined cases: a null or empty text has the end id alone; a very long text is encoded whole, and spans many windows; rows that
repeat, and null ids, are packed as often as they occur; an empty table gives no pieces; other columns are ignored. Only the
last sequence can need padding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, text_of

_ENCODERS: dict = {}
#: Runs that the faster library's pattern can't be trusted with: on white space without end it runs out of stack.
_LONG = re.compile(r"\s{10000}|\S{10000}")


def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> ids as numpy array. With ranks_path, the same vocabulary by a faster library; texts that hold the name of
    a special token, which is one id, or a very long run of white space or of other characters go to the first one."""
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        names = [t.content for t in slow.get_added_tokens_decoder().values()]
        plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[key] = lambda text: plain(text) if any(n in text for n in names) or _LONG.search(text) else np.array(fast.encode_ordinary(text), np.uint32)
        else:
            _ENCODERS[key] = plain
    return _ENCODERS[key]


def encoded(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, part, before (tokens before it in its partition), n, ids (little-endian unsigned, 2 or 4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(json_path, ranks_path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of = batch.column(0)
            text = batch.column(1)
            rows, n, at = [], [], []
            for t in text:
                ids = np.append(encode(t.as_py()), np.uint32(end_id))
                wide = ids.max() > 0xFFFF
                rows.append((b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes())
                n.append(len(ids))
                at.append(before)
                before += len(ids)
            yield pa.RecordBatch.from_arrays([ids_of, pa.array([part] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, window: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    table = staged(encoded(docs, json_path, ranks_path, pattern, end_id))
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    # a row for each input partition, 12 bytes each: this window and this broadcast are bounded by the scheduler's tasks
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc_id, first, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = memoryview(np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype("<u4").tobytes())
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, window)
                    length = min(window - offset, n - at)
                    for k, v in zip(out, (doc_id, at, length, n, sequence, offset, bytes(raw[4 * at : 4 * (at + length)]))):
                        out[k].append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))

    rows = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (window ids, padded), used: the windows themselves, a group of at most `window` pieces each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = pieces.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("used"))
    raw = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").decode("latin-1")), (window - F.col("used")).cast("int")).cast("binary")
    power = F.col("used").cast("int").bitwiseAND((F.col("used") - 1).cast("int")) == 0
    return joined.select("sequence_id", F.when(power, raw).otherwise(F.concat(raw, pad)).alias("ids"), "used")


def pack_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC of their ids in their stead."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


__all__ = ["digest", "encoded", "pack", "pack_query", "sequences"]
