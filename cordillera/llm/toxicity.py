"""Toxicity: a learned lexicon met by Levenshtein automata, and hits weighed by their context.

From a bounded sample of labelled documents come terms (words, and stems that several words share) that toxic documents
hold and others don't, with their log odds as weights. The automaton of all strings within one edit of a term, and the trie
of all terms, are intersected state by state into one table, which reads every word of a batch of texts in step: most words
leave it after a few letters. A hit is then weighed by the words around it, whose log odds between hits in toxic and in
other labelled documents tell quotation from abuse, and by whether it stands within quotation marks, which are counted from
the start of the text. A word is a run of letters; one with a digit or sign inside, such as id1ot, is read as a whole too. A
logistic regression of a document's hits gives the score. The model learns from at most `ROWS` labelled rows, and its size is
bounded: `TERMS` terms by weight and support, `BUCKETS` context weights. The automaton is built once and sent to all tasks.

Defined cases: a null or empty text, and any without a hit, gets the score of no hits; a very long text is read whole; rows
that repeat are scored each; a
null doc_id counts as not held out; without labelled rows, or with one class alone, the score is the share of that class,
0.0 without any; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frames, held_out, labelled_sample, staged, text_of

#: Bounds of what is learned from: labelled rows, terms of the lexicon, buckets of context words, words on either side.
ROWS, TERMS, BUCKETS, SIDE = 6000, 600, 4096, 4
QUOTES = '"“”„«»‹›'
FUZZY_FROM = 5  # letters that a term needs to be met within one edit
_CODES: dict = {}


class Automaton:
    """The union of the terms' automata within `edits` edits, as a table over (state, letter); state 0 has no way on.

    stems: a term is met by every word that begins with it; else by words within the edits."""

    def __init__(self, terms: list[str], edits: int, stems: bool = False) -> None:
        self.stems = stems
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        for i, term in enumerate(terms):
            at = 0
            for c in term:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = i
        letters = sorted({c for t in terms for c in t})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}

        def closed(items: dict[int, int]) -> frozenset:
            todo = list(items.items())
            while todo:
                node, e = todo.pop()
                if e < edits:
                    for child in children[node].values():
                        if items.get(child, edits + 1) > e + 1:
                            items[child] = e + 1
                            todo.append((child, e + 1))
            return frozenset(items.items())

        def after(state: frozenset, c: str | None) -> frozenset:
            out: dict[int, int] = {}
            for node, e in state:
                if c in children[node]:
                    out[children[node][c]] = min(e, out.get(children[node][c], edits + 1))
                if e < edits:
                    for to in (node, *children[node].values()):
                        out[to] = min(e + 1, out.get(to, edits + 1))
            return closed(out)

        start = closed({0: 0})
        number, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
        at = 0
        while at < len(order):
            state, row = order[at], np.zeros(len(letters) + 1, np.int32)
            moves = {None: after(state, None)} if state else {}
            for c in {c for node, _ in state for c in children[node]}:
                moves[c] = after(state, c)
            for c, to in moves.items():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
            row[:] = number[moves[None]] if moves else 0
            for c, to in moves.items():
                if c is not None:
                    row[self.letters[c]] = number[to]
            table.append(row)
            at += 1
        self.table = np.array(table)
        best = [min(((e, ends[node]) for node, e in s if ends[node] >= 0 and (e == 0 or len(terms[ends[node]]) >= FUZZY_FROM)), default=(0, -1)) for s in order]
        self.distance, self.term = (np.array(x, np.int32) for x in zip(*best))

    def read(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words that it meets, their terms and distances. codes: the text by letter_codes."""
        alive, at, stop, state = np.arange(len(starts)), starts.copy(), ends, np.ones(len(starts), np.int32)
        found = []
        while len(alive):
            state = self.table[state, codes[at]]
            at = at + 1
            done = at == stop
            hit = self.term[state] >= 0
            over = hit if self.stems else hit & done
            if over.any():
                found.append((alive[over], self.term[state[over]], self.distance[state[over]]))
            on = (state > 0) & ~done
            if self.stems:
                on &= ~over
            alive, at, stop, state = alive[on], at[on], stop[on], state[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (alive, alive, alive)


def _class_table(kind: str, letters: dict[str, int]) -> np.ndarray:
    """Of every code point: 1 if a letter (kind 'alpha'); 0 to 3 for spaces, signs, digits and letters (kind 'word'); else its
    number among letters."""
    key = (kind, "".join(letters))
    if key not in _CODES:
        out = np.zeros(0x110000, np.int16)
        if kind == "alpha":
            out[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = 1
        elif kind == "word":
            out[:] = 1 + 2 * _class_table("alpha", {})
            out[[i for i in range(0x30000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]] = 0
            out[[i for i in range(0x30000) if not 0xD800 <= i < 0xE000 and chr(i).isdigit()]] = 2
        else:
            out[[ord(c) for c in letters]] = list(letters.values())
        _CODES[key] = out
    return _CODES[key]


class Scanner:
    """The hits of a batch of texts, one row each: document, weight, distance, quoted, context (hash buckets of the words
    around it)."""

    def __init__(self, lexicon: list[tuple[str, bool, float]]) -> None:
        words, stems = ([(t, w) for t, s, w in lexicon if s is kind] for kind in (False, True))
        self.longest = max((len(t) for t, _, _ in lexicon), default=0)
        self.parts = [(Automaton([t for t, _ in own], edits, kind), np.array([w for _, w in own])) for own, edits, kind in ((words, 1, False), (stems, 0, True)) if own]

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, dict[str, list]]]:
        """(first document, number of documents, their hits with numbers of words), a slice of the batch at a time."""
        at, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > 1_000_000:
                yield at, i - at, self.slice(texts[at:i])
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield at, len(texts) - at, self.slice(texts[at:])

    def with_mixed(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, and with them each run without spaces, between its outermost letters or digits, that holds both
        letters and something else, and is short enough to be within one edit of a term."""
        word = _class_table("word", {})[points]  # 0: space, 1: sign, 2: digit, 3: letter
        edge = np.flatnonzero(np.diff((word > 0).view(np.int8), prepend=np.int8(0)))
        strong = np.flatnonzero(word > 1)
        if not len(strong):
            return starts, ends
        lo, hi = np.searchsorted(strong, edge[0::2]), np.searchsorted(strong, edge[1::2])
        some = hi > lo
        a, b = strong[lo[some]], strong[hi[some] - 1] + 1
        letters = np.concatenate(([0], np.cumsum(word == 3)))
        own = letters[b] - letters[a]
        mixed = (own > 0) & (own < b - a) & (b - a <= self.longest + 1) & (b - a >= FUZZY_FROM - 1)
        order = np.argsort(np.concatenate([starts, a[mixed]]), kind="stable")
        return np.concatenate([starts, a[mixed]])[order], np.concatenate([ends, b[mixed]])[order]

    def inside(self, t: int, best: dict, starts: np.ndarray, ends: np.ndarray) -> bool:
        """A hit on a run of letters stands for the longer word that it is part of, and the other way round if it is worse."""
        for other in (t - 1, t + 1):
            if other in best and starts[other] <= starts[t] and ends[t] <= ends[other]:
                return best[other] > best[t] or (best[other] == best[t] and other < t)
            if other in best and starts[t] <= starts[other] and ends[other] <= ends[t] and best[other] >= best[t]:
                return True
        return False

    def slice(self, texts: list[str]) -> dict:
        low = [t.lower() for t in texts]
        whole = "\n".join(low) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.flatnonzero(np.diff(_class_table("alpha", {})[points], prepend=np.int16(0)))
        starts, ends = edge[0::2], edge[1::2]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)))
        starts, ends = self.with_mixed(points, starts, ends)
        first = np.searchsorted(starts, bounds)
        best: dict[int, tuple[float, int]] = {}
        for automaton, weights in self.parts:
            codes = _class_table("letters", automaton.letters)[points]
            for token, term, distance in zip(*(x.tolist() for x in automaton.read(codes, starts, ends))):
                new = (-distance, weights[term])
                if token not in best or new > best[token]:
                    best[token] = new
        import xxhash

        hits = [t for t in sorted(best) if not self.inside(t, best, starts, ends)]
        doc = np.searchsorted(first, np.array(hits, np.int64), side="right") - 1
        out = {"words": np.diff(first), "doc": doc, "weight": np.array([best[t][1] for t in hits]), "distance": np.array([-best[t][0] for t in hits]), "quoted": [], "context": []}
        for t, d in zip(hits, doc.tolist()):
            lo, hi = max(first[d], t - SIDE), min(first[d + 1], t + SIDE + 1)
            out["context"].append([xxhash.xxh32_intdigest(whole[starts[j] : ends[j]].encode("utf-8", "surrogatepass")) % BUCKETS for j in range(lo, hi) if j != t])
        marks = np.flatnonzero(np.isin(points, [ord(q) for q in QUOTES]))
        at = np.array(hits, np.int64)
        before = np.searchsorted(marks, starts[at]) - np.searchsorted(marks, bounds[doc])
        after = np.searchsorted(marks, bounds[doc + 1]) - np.searchsorted(marks, ends[at])
        out["quoted"] = ((before % 2 == 1) & (after > 0)).tolist()
        return out


def features(hits: dict, context: np.ndarray) -> np.ndarray:
    """A row for each document: exact, fuzzy and quoted weights, the largest, hits a word, context, number of hits."""
    n, doc = len(hits["words"]), hits["doc"]
    quoted, exact = np.array(hits["quoted"], bool), hits["distance"] == 0
    around = np.array([context[c].mean() if c else 0.0 for c in hits["context"]])
    put = lambda mask, w: np.bincount(doc[mask], w[mask], n)
    most = np.zeros(n)
    np.maximum.at(most, doc[~quoted], (hits["weight"] * np.where(exact, 1.0, 0.5))[~quoted])
    count = np.bincount(doc, minlength=n)
    ones = np.ones(len(doc))
    return np.stack([np.log1p(put(exact & ~quoted, hits["weight"])), np.log1p(put(~exact & ~quoted, hits["weight"])), np.log1p(put(quoted, hits["weight"])), most, np.minimum(count / np.maximum(hits["words"], 1), 1.0), np.tanh(put(np.ones(len(doc), bool), around)), np.log1p(put(exact & ~quoted, ones))], 1)


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight) of at most TERMS terms; sample: doc_id, text, label."""
    words = sample.select("doc_id", "label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).where("length(word) between 3 and 40")
    stems = [words.where(F.length("word") > k).select("doc_id", "label", F.substring("word", 1, k).alias("word"), F.lit(True).alias("stem")).distinct() for k in (4, 5, 6)]
    every = words.withColumn("stem", F.lit(False))
    for s in stems:
        every = every.union(s.select(every.columns))
    totals = sample.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = totals["p"] or 0, (totals["n"] or 0) - (totals["p"] or 0)
    if not pos or not neg:
        return []
    counted = every.groupBy("word", "stem").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).where("p >= 3")
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    ranked = counted.select("word", "stem", odds.alias("w"), "p").where(F.col("w") > F.when(F.col("stem"), 4.0).otherwise(3.0)).orderBy(F.desc(F.col("w") * F.sqrt("p")), "word", "stem").limit(TERMS)
    return [(r["word"], r["stem"], float(r["w"])) for r in ranked.collect()]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights with the intercept last, by Newton's method with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * len(x) * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """The model: lexicon, context, weights. It learns from at most ROWS labelled rows outside the held-out fifth."""
    sample = staged(labelled_sample(docs, labels, label, ROWS).repartition(12))
    lexicon = learn_lexicon(sample)
    mean = sample.agg(F.avg("label")).first()[0] or 0.0
    if not lexicon:
        return {"lexicon": [], "scanner": Scanner([]), "context": np.zeros(BUCKETS), "weights": None, "mean": float(mean)}

    scanner = Scanner(lexicon)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            label = batch["label"].to_numpy()
            for at, n, hits in scanner(batch["text"].tolist()):
                yield pd.DataFrame([(int(label[at + d]), b) for d, c in zip(hits["doc"], hits["context"]) for b in c], columns=["label", "bucket"])

    seen = sample.mapInPandas(contexts, "label int, bucket int").groupBy("label", "bucket").count().collect()  # 2 * BUCKETS rows at most
    counts = np.zeros((2, BUCKETS))
    for r in seen:
        counts[r["label"], r["bucket"]] = r["count"]
    totals = counts.sum(1, keepdims=True)
    prior = 20.0  # hits of each class that every bucket is given beforehand
    rates = (counts + prior * (totals + 1) / (totals.sum() + 2)) / (totals + prior)
    context = np.log(rates[1] / rates[0]) if totals.min() > 100 else np.zeros(BUCKETS)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, n, hits in scanner(batch["text"].tolist()):
                yield pd.DataFrame({"label": batch["label"].to_numpy()[at : at + n], "x": list(features(hits, context))})

    table = sample.mapInPandas(rows, "label int, x array<double>").toPandas()  # ROWS rows of 7 numbers at most
    y = table["label"].to_numpy(float)
    return {"lexicon": lexicon, "scanner": scanner, "context": context, "weights": logistic(np.array(table["x"].tolist()), y), "mean": float(y.mean())}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = model["scanner"]
        for batch in frames(batches):
            out = []
            for _, n, hits in scanner(batch["text"].tolist()):
                x = np.hstack([features(hits, model["context"]), np.ones((n, 1))])
                out.append(1 / (1 + np.exp(-np.clip(x @ model["weights"], -30, 30))) if model["weights"] is not None else np.full(n, model["mean"]))
            yield pa.RecordBatch.from_arrays([pa.array(batch["doc_id"], pa.int64(), from_pandas=True), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return text_of(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on)."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns; no join, the score is made beside the row."""
    model, schema = train(docs, labels), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = model["scanner"]
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            keep = []
            for _, n, hits in scanner([t or "" for t in batch.column("text").to_pylist()]):
                x = np.hstack([features(hits, model["context"]), np.ones((n, 1))])
                keep.append(x @ model["weights"] < 0 if model["weights"] is not None else np.full(n, model["mean"] < 0.5))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, schema)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
