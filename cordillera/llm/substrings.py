"""Suffix-array dedup: bytes covered by a string of `LENGTH` bytes that also starts in a document of a smaller id go.

1. Every window of LENGTH bytes belongs to the smallest hash of the strings of `GRAM` bytes in it; equal windows have equal
   ones. Windows of one hash in a row are a stretch. Each batch of documents sends its distinct hashes, without texts, to
   shards of the hash range, which send back those that occur in two documents; a frequent hash is there once for each batch.
2. Batches cut their stretches of repeated hashes, each distinct one with its smallest and largest document.
3. Stretches meet by hash. A shard sorts all suffixes of its distinct stretches by induced sorting, compares permuted common
   prefixes, and gives every group of suffixes with LENGTH bytes in common its smallest document. Where a hash has only one
   stretch, all its windows have the stretch's smallest document.
4. Occurrences get their stretch's windows, windows of smaller documents are merged to runs, and the runs are cut out.

Defined cases: a null text is empty; texts shorter than LENGTH stay; matches within one document, or with rows of the same
id, remove nothing; a null id neither removes nor loses bytes; rows that repeat are treated alike; an empty table gives no
rows; other columns are ignored. Texts are never cut: a batch holds whole documents, of about `BATCH` bytes or one longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow, chunks, discard, frames, mix, staged, text_of
from .suffixes import common_prefix_at_least, suffix_array

LENGTH, GRAM, BATCH, SHARD = 50, 16, 4_000_000, 8_000_000
KEPT = np.uint64(24)  # low bits of a hash that are left out: 40 remain
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_STEPS = mix(np.arange(1000, 1008, dtype=np.uint64)) | np.uint64(1)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def stretches(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: (40-bit hash, number of the text, start in it, windows) of every stretch, in order."""
    out = []
    for a, b in chunks(raw, 1_000_000):
        data = np.frombuffer(b"\0".join(raw[a:b]), np.uint8)
        if len(data) < LENGTH:
            continue
        h, done = _TABLE[data], 1
        for k in range(GRAM.bit_length() - 1):
            h, done = h[:-done] * _STEPS[k] + h[done:], 2 * done
        low = mix(_smallest(mix(h), LENGTH - GRAM + 1)) >> KEPT  # mixed again, as minima crowd the low end of the shards' range
        size = np.fromiter(map(len, raw[a:b]), np.int64, b - a)
        first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        doc = np.repeat(np.arange(b - a), size + 1)[: len(low)]
        good = np.arange(len(low)) + LENGTH <= (first + size)[doc]
        begin = np.flatnonzero(good & np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1])))
        if len(begin):
            windows = np.add.reduceat(good.astype(np.int64), begin)
            out.append((low[begin], doc[begin] + a, begin - first[doc[begin]], windows))
    if not out:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0].astype(np.uint64)


def _batched(docs: DataFrame) -> DataFrame:
    """doc_id, text, batch, row: batches of whole texts, and a number for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, row, size = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32, 0
        for part in parts:
            lengths = [len(t) for t in part["text"]]
            batches = []
            for n in lengths:
                if size and size + n > BATCH:
                    batch, size = batch + 1, 0
                size += n
                batches.append(batch)
            yield part.assign(batch=batches, row=range(row, row + len(part)))
            row += len(part)

    # an id without a value leaves as a flag, as numbers with gaps would turn to floats
    return text_of(docs).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("lost"), "text").mapInPandas(run, "doc_id long, lost boolean, text string, batch long, row long")


def _repeated(table: DataFrame, shards: int) -> DataFrame:
    """(batch, hashes): of each batch's hashes, those that occur in two documents."""

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(i << 40) // shards for i in range(shards + 1)], np.uint64)

        def rows(batch: int, own: list[pd.DataFrame]) -> pd.DataFrame:
            frame = pd.concat(own)
            h, doc, _, _ = stretches([t.encode("utf-8", "surrogatepass") for t in frame["text"]])
            ids = frame["doc_id"].to_numpy()[doc]
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            fresh = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
            many = np.bincount(np.cumsum(fresh)[1:][(h[1:] == h[:-1]) & (ids[1:] != ids[:-1])] - 1, minlength=fresh.sum()) > 0 if len(h) else fresh
            u = h[fresh]
            cut = np.searchsorted(u, edges)
            return pd.DataFrame([(batch, s, _pack(u[a:b]), np.packbits(many[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a], columns=["batch", "shard", "hashes", "many"])

        at, own = None, []
        for part in parts:
            for batch, rest in part.groupby("batch", sort=True):
                if batch != at:
                    if own:
                        yield rows(at, own)
                    at, own = batch, []
                own.append(rest)
        if own:
            yield rows(at, own)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        sets = [_unpack(x) for x in group["hashes"]]
        every = np.concatenate(sets)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(s)).astype(bool) for m, s in zip(group["many"], sets)])
        ordered = np.sort(every)
        hot = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], every[many])
        answers = [s[np.isin(s, hot, assume_unique=True)] for s in sets]
        return pd.DataFrame([(b, _pack(x)) for b, x in zip(group["batch"], answers) if len(x)], columns=["batch", "hashes"])

    sent = table.where("not lost").select("batch", "doc_id", "text").mapInPandas(send, "batch long, shard int, hashes binary, many binary")
    return sent.groupBy("shard").applyInPandas(judge, "batch long, hashes binary")


def _cut(table: DataFrame, repeated: DataFrame, shards: int) -> DataFrame:
    """kind 0: a document's stretches (row, doc_id, sids, starts); kind 1: a batch's distinct stretches of one shard, packed."""
    import xxhash
    import zstandard

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "row", "doc_id", "sids", "starts", "shard", "packed"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        hot = np.sort(np.concatenate([_unpack(x) for x in right["hashes"]]))
        raw = [t.encode("utf-8", "surrogatepass") for t in left["text"]]
        h, doc, start, windows = stretches(raw)
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        mine = hot[at] == h
        h, doc, start, windows = h[mine], doc[mine], start[mine], windows[mine]
        pieces = [raw[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), (start + windows + LENGTH - 1).tolist())]
        sids = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)).view(np.int64)
        ids, rows = left["doc_id"].to_numpy(), left["row"].tolist()
        lead = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
        out = [(0, rows[doc[a]], int(ids[doc[a]]), sids[a:b], start[a:b].astype(np.int32), 0, None) for a, b in zip(lead, [*lead[1:], len(doc)])]
        order = np.lexsort((sids, h))
        if len(order):
            first = np.concatenate(([0], np.flatnonzero(sids[order][1:] != sids[order][:-1]) + 1))
            own = order[first]
            lo, hi = (f.reduceat(ids[doc[order]], first) for f in (np.minimum, np.maximum))
            shard = (h[own] * np.uint64(shards) >> np.uint64(40)).astype(np.int64)
            squeeze = zstandard.ZstdCompressor(level=3).compress
            lead = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            for a, b in zip(lead, [*lead[1:], len(own)]):
                texts = [pieces[k] for k in own[a:b].tolist()]
                steps = np.diff(h[own[a:b]].astype(np.int64), prepend=0)
                head = np.concatenate([[b - a], steps, lo[a:b], hi[a:b] - lo[a:b], [len(t) for t in texts]]).astype("<i8").tobytes()
                out.append((1, 0, 0, None, None, int(shard[a]), squeeze(head + b"".join(texts))))
        return pd.DataFrame(out, columns=columns)

    schema = "kind int, row long, doc_id long, sids array<long>, starts array<int>, shard int, packed binary"
    return table.where("not lost").select("batch", "row", "doc_id", "text").groupBy("batch").cogroup(repeated.groupBy("batch")).applyInPandas(run, schema)


def _unpacked(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a shard's packed stretches, each distinct one: sid, hash, smallest and largest document, bytes; by hash."""
    import xxhash
    import zstandard

    columns, texts = [], []
    for part in parts:
        part = zstandard.ZstdDecompressor().decompress(part)
        n = int(np.frombuffer(part, "<i8", 1)[0])
        step, lo, more, size = np.frombuffer(part, "<i8", 4 * n, 8).reshape(4, n)
        ends = np.cumsum(size) + 8 * (4 * n + 1)
        texts += [part[e - k : e] for e, k in zip(ends.tolist(), size.tolist())]
        columns.append(np.stack([np.cumsum(step), lo, lo + more]))
    h, lo, hi = np.concatenate(columns, 1)
    sid = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
    order = np.lexsort((sid, h))
    s = sid[order]
    first = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
    own = order[first]
    return sid[own], h[own], np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first), [texts[k] for k in own.tolist()]


def shard_windows(pieces: list[bytes], lo: np.ndarray) -> np.ndarray:
    """For every byte of the pieces, one after another with a byte between: the smallest document of the window of LENGTH
    bytes that starts there, if one does. lo: each piece's smallest document."""
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = data.astype(np.int64) + 1
    symbols[np.cumsum(size + 1) - 1] = 0
    sa = suffix_array(symbols, 257)
    stop = np.repeat(np.cumsum(size + 1) - 1, size + 1)
    whole = np.arange(len(data)) + LENGTH <= stop
    same = common_prefix_at_least(data, sa, LENGTH) & whole[sa] & np.concatenate(([False], whole[sa[:-1]]))
    doc = np.repeat(lo, size + 1)
    first = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc[sa], first)
    out = np.empty(len(data), np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(first, len(data))))
    return out


def _windows(strings: DataFrame) -> DataFrame:
    """(sid, runs): of each stretch with windows that start in a document smaller than its largest, the runs of windows with
    one smallest document, as (first window, windows, document) triples of longs."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sid, h, lo, hi, texts = _unpacked(group["packed"])
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        edge = np.concatenate(([True], h[1:] != h[:-1], [True]))
        several = ~(edge[1:] & edge[:-1])  # where a hash has more stretches than one
        one = ~several & (lo < hi)
        whole = np.zeros((int(one.sum()), 3), np.int64)
        whole[:, 1], whole[:, 2] = length[one] - LENGTH + 1, lo[one]
        raw = whole.tobytes()
        out = [(s, raw[24 * k : 24 * k + 24]) for k, s in enumerate(sid[one].tolist())]
        many = np.flatnonzero(several)
        total, hashes = np.cumsum(length[many] + 1), h[many]
        a = 0
        while a < len(many):  # slices of whole hashes, so that a task's arrays stay small
            b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + 1_000_000, side="right")), a + 1)
            b = int(np.searchsorted(hashes, hashes[b - 1], side="right"))
            own = many[a:b]
            size = length[own]
            least = shard_windows([texts[k] for k in own.tolist()], lo[own])
            n = size - LENGTH + 1
            of = np.repeat(np.arange(len(own)), n)  # the piece of every window
            window = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            least = least[(np.cumsum(size + 1) - size - 1)[of] + window]
            cut = np.flatnonzero((window == 0) | (np.diff(least, prepend=-1) != 0))
            runs = np.stack([window[cut], np.diff(np.append(cut, len(of))), least[cut]], 1)
            good = least[cut] < hi[own][of[cut]]
            runs, of = runs[good], of[cut][good]
            lead = np.flatnonzero(np.diff(of, prepend=-1))
            ids = sid[own][of[lead]].tolist()
            out += [(i, runs[x:y].tobytes()) for i, x, y in zip(ids, lead.tolist(), [*lead[1:].tolist(), len(of)])]
            a = b
        return pd.DataFrame(out, columns=["sid", "runs"])

    return strings.groupBy("shard").applyInPandas(run, "sid long, runs binary")


def repeated_runs(table: DataFrame, shards: int) -> DataFrame:
    """(row, runs): of each batched row that loses bytes, an array of (start, end)."""
    cut = staged(_cut(table, _repeated(table, shards), shards))
    windows = staged(_windows(cut.where("kind = 1").select("shard", "packed")))
    met = cut.where("kind = 0").select("row", "doc_id", F.explode(F.arrays_zip("sids", "starts")).alias("x")).select("row", "doc_id", F.col("x.sids").alias("sid"), F.col("x.starts").alias("start"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            counts = part["runs"].map(len).to_numpy() // 24
            runs = np.frombuffer(b"".join(part["runs"]), np.int64).reshape(-1, 3)
            row, doc, start = (np.repeat(part[c].to_numpy(), counts) for c in ("row", "doc_id", "start"))
            lost = runs[:, 2] < doc
            begin = (start + runs[:, 0])[lost]
            yield pd.DataFrame({"row": row[lost], "start": begin, "end": begin + runs[lost, 1] + LENGTH - 1})

    found = met.join(windows, "sid").select("row", "doc_id", "start", "runs").mapInPandas(run, "row long, start long, end long")
    runs = staged(found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("runs")))
    discard(cut)
    discard(windows)
    return runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row for each row of docs."""
    table = staged(_batched(docs))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = repeated_runs(table, max(8, int(size // SHARD)))

    schema = pa.schema([("doc_id", pa.int64()), ("lost", pa.bool_()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames(batches, 256):
            out = []
            for doc_id, lost, text, start, end in zip(part["doc_id"], part["lost"], part["text"], part["start"], part["end"]):
                raw = text.encode("utf-8", "surrogatepass")
                if start is None or not len(start):
                    out.append((doc_id, lost, len(raw), 0, 0, raw))
                    continue
                order = np.argsort(start)
                s, reach = start[order], np.maximum.accumulate(end[order])
                fresh = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
                first, last = s[fresh], reach[np.append(fresh[1:], len(s)) - 1]
                kept = b"".join(raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(raw)]))
                out.append((doc_id, lost, len(raw), len(raw) - len(kept), len(fresh), kept))
            yield arrow(pd.DataFrame(out, columns=schema.names), schema)

    done = table.join(runs, "row", "left").select("doc_id", "lost", "text", F.col("runs.start").alias("start"), F.col("runs.end").alias("end")).mapInArrow(run, "doc_id long, lost boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.when(~F.col("lost"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def repeats_query(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


