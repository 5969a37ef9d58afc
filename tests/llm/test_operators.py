"""Every operator against a brute-force version on small inputs, with nulls, empty texts, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cordillera.llm import fingerprints, mixing, neardup, neighbors, packing, quality, registry, secrets, substrings, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 5):  # edited copies, and one passage in many
        t = texts[i].split()
        t[len(t) // 2] = "edited"
        texts[(i + 7) % n] = " ".join(t)
        texts[(i + 3) % n] += "\n" + "the very same passage of more than fifty characters stands here in each of them"
    texts[4] = texts[9]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t), True) for i, t in enumerate(texts)]
    return [*rows, (n, None, None, None, None, None), (n + 1, "", "en", "src1", 0, True), (n + 2, "one", "en", "src1", 3, True), (n + 3, " \n ", "en", "src0", 3, True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_packing(docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    paths = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    pieces = packing.pack(docs, *paths, window=64).cache()
    rows = packing.digest(pieces).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in texts_of(docs).items():
        ids, at = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    packed = sorted(packing.sequences(pieces, 64).collect(), key=lambda r: r["sequence_id"])
    assert [r["used"] for r in packed[:-1]] == [64] * (len(packed) - 1)
    assert len(packed[-1]["ids"]) == 4 * (packed[-1]["used"] if packed[-1]["used"] & (packed[-1]["used"] - 1) == 0 else 64)
    assert packing.pack(empty, *paths).count() == 0


def test_special_token_text():
    import public_tokenizers as P

    both = [packing.encoder(P.path("byte_bpe_50k.json"), *more) for more in ((None, None), (P.path("byte_bpe_50k.tiktoken"), P.PATTERN))]
    for t in ("", " a  b  c\x1c\x85d ", "<|endoftext|> x", "don't\r\n\t  1½٣ ﬁ 日本語 🎉🎉", "a" * 3000):
        assert both[0](t).tolist() == both[1](t).tolist()


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


def test_near_duplicates(docs, empty):
    sets, label = brute_components(texts_of(docs))
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (label[i] == i) for i, r in found.items())
    assert neardup.near_duplicates(empty).count() == 0


def test_large_band(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, label = brute_components(dict(rows))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=85).collect()} == label


def test_registers():
    a = np.sort(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:4000], np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)]))
    assert abs((neardup.registers(a) == neardup.registers(b)).mean() - 4000 / 6000) < 0.15


def test_secrets(spark, empty):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [(0, None), (1, ""), (2, f'é Password = "abc.def1" {key} {"0a" * 13}'), (3, "token: short secret=token: abcdefgh"), (4, "run 8fK2mQz7Lx9RtY4wBv3N here, get_user_name_of_table_1"), (5, "4111111111111111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs.union(prose)).collect()}
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in rows:
        t = t or ""
        base = [(m.start(), m.end(), "assign") for m in pattern.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(base) == sorted(tuple(s) for s in found[i] if s["kind"] != "markov")
    assert [s["kind"] for s in found[4]] == ["markov"] and found[5] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    sample = secrets.labelled(prose)
    table = secrets.markov_table(sample)
    told = sample.where("held_out and length(s) >= 16").selectExpr("label", f"{secrets.likely('s', table)} as flagged").groupBy("label").agg(F.avg(F.col("flagged").cast("int")).alias("share"))
    share = {r["label"]: r["share"] for r in told.collect()}
    assert share[1] > 0.95 and share[0] < 0.01
    assert clean[2] == "é [SECRET]\" [SECRET] [SECRET]" and clean[0] is None and clean[5] == rows[5][1]
    assert secrets.scan(empty).count() == 0


def long_texts():
    rng = random.Random(2)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(400_000))
    return [" " * 1_000_000, "\n" * 1_000_000, "a" * 400_000, blob, "\n".join(blob[i : i + 76] for i in range(0, len(blob), 76)), "token=abcdefgh1 é " * 20_000, ("0a" * 13 + " ") * 20_000]


def test_secrets_in_long_texts(spark):
    rows = list(enumerate(long_texts()))
    found = {r["doc_id"]: r for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        out, at = [], 0
        for s in spans[i]:
            if s["start"] >= at:
                out += [t[at : s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        assert found[i]["text"] == "".join(out) + t[at:]
    assert len(spans[5]) == 20_000 and [tuple(s) for s in spans[5][:2]] == [(0, 15, "assign"), (18, 33, "assign")]
    assert len(spans[6]) == 20_000 and not spans[0] and [tuple(s) for s in spans[2]] == [(0, 400_000, "hex")]


def test_packing_of_long_texts(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = list(enumerate(long_texts()))
    pieces = packing.digest(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()
    for i, t in rows:
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    texts = texts_of(docs)
    assert all(r["size"] == len(texts[r["doc_id"]].encode().split()) and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in rows)
    got = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        got[r["source"]][0] += r["size"]
        got[r["source"]][1] = r["target"]
        got[r["source"]][2] += r["taken"]
    names = sorted((s for s in got if s is not None)) + [None]
    size, weight = np.array([got[s][0] for s in names], float), np.array([1 + i % 3 for i in range(len(names))], float)
    free, target = np.ones(len(names), bool), np.zeros(len(names))
    while True:
        level = (size.sum() - 3 * size[~free].sum()) / weight[free].sum()
        over = free & (level * weight > 3 * size)
        target = np.where(free, level * weight, 3 * size)
        if not over.any():
            break
        free &= ~over
    assert np.allclose(target, [got[s][1] for s in names])
    assert np.abs(np.array([got[s][2] for s in names]) - target).max() <= 5
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(2)).collect()}
    assert mixing.mix(empty).count() == 0
    assert mixing.repeated(docs).count() == sum(r["copies"] for r in rows)


def test_pipeline_similarity(spark):
    import corpus_pipeline

    rows = []
    for k in range(4):
        t = [f"w{k}x{i}" for i in range(50)]
        changed = list(t)
        changed[25] = "other"  # 5 of 46 shingles: 41 / 51
        rows += [(10 * k, " ".join(t)), (10 * k + 1, " ".join(changed))]
        apart = list(t)
        apart[10], apart[30] = "this", "that"  # 10 of 46: 36 / 56
        rows.append((10 * k + 2, " ".join(apart)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {10 * k + d for k in range(4) for d in (0, 2)}


def test_pipeline_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(6)]
    edit = lambda t: " ".join(["edited", *t.split()[1:]])
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, edit(t)) for i, t in enumerate(base)]
    rows += [(3, base[3]), (3, base[3]), (20, base[0]), (20, "another text under the id of a copy"), (21, "a text of its own here"), (21, base[1])]
    rows += [(None, base[0]), (None, base[0]), (None, None), (None, "alone without an id"), (30, ""), (30, ""), (31, None), (32, ""), (40, edit(base[5])), (1, base[5])]
    sets = [shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows):
                both = len(sets[i] & sets[j])
                linked = a is not None and b is not None and both and 100 * both >= 80 * len(sets[i] | sets[j])
                if linked or (a == b and a is not None and not sets[i] and not sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (a, _), k in zip(rows, label):
        least[k] = a if k not in least else min(least[k], a)
    docs = spark.createDataFrame([(a, t, k) for k, (a, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = collections.Counter((label[r["row"]], r["doc_id"]) for r in got.collect())
    assert kept == collections.Counter(least.items())


def test_fingerprints(docs, spark):
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        n = len(t) // 3
        assert found[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert found[d]["next_id"] == order[(i + 1) % len(order)]
        assert len(found[d]["codes"]) == (fingerprints.SAMPLES if t.split() else 0)
    assert found[4]["codes"] == found[9]["codes"]
    gap = []
    for d, t in texts.items():
        a, b = collections.Counter(t.split()), collections.Counter(texts[found[d]["next_id"]].split())
        if a and b and found[d]["codes"] and found[found[d]["next_id"]]["codes"]:
            true = sum((a & b).values()) / sum((a | b).values())
            gap.append(np.mean(np.array(found[d]["codes"]) == np.array(found[found[d]["next_id"]]["codes"])) - true)
    assert abs(np.mean(gap)) < 0.05
    assert fingerprints.fingerprints(spark.createDataFrame([(1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, n_chars long")).count() == 1


def test_suffix_array():
    rng = np.random.default_rng(1)
    for t in range(300):
        s = rng.integers(0, rng.integers(1, 5) if t % 2 else 10**6, rng.integers(1, 60))
        s = np.tile(s, 3) if t % 3 == 0 else np.sort(s)[:: 1 if t % 2 else -1] if t % 7 == 0 else s
        assert suffixes.suffix_array(s, int(s.max()) + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array_with_many_names(monkeypatch):
    rng = np.random.default_rng(2)
    called = []
    for name in ("_induce", "_induce_runs", "_induce_each"):
        plain = getattr(suffixes, name)
        monkeypatch.setattr(suffixes, name, lambda s, *a, plain=plain, name=name: called.append((name, a[2])) or plain(s, *a))
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(4000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 4000, 20_000)), bytes(range(1, 256)) * 300 + b"\x01" * 3000, b"".join(b"x" * int(k) + b"y" for k in rng.integers(0, 400, 300))]
    for t in texts:
        got = suffixes.suffix_array(np.frombuffer(t, np.uint8).astype(np.int64), 256)
        assert np.array_equal(np.sort(got), np.arange(len(t))) and all(t[a:] < t[b:] for a, b in zip(got[:-1], got[1:]))
    assert max(letters for _, letters in called) > 2048 and {name for name, _ in called} == {"_induce", "_induce_runs", "_induce_each"}


def test_repeats(docs, empty):
    texts, seen = texts_of(docs), set()
    found = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    for d in sorted(texts):
        raw = texts[d].encode()
        lost = [False] * len(raw)
        own = [raw[p : p + 50] for p in range(len(raw) - 49)]
        for p, w in enumerate(own):
            if w in seen:
                lost[p : p + 50] = [True] * 50
        seen |= set(own)
        assert bytes(found[d]["kept"]) == bytes(c for c, x in zip(raw, lost) if not x)
        assert found[d]["n_removed"] == sum(lost) and found[d]["n_spans"] == sum(x and not (p and lost[p - 1]) for p, x in enumerate(lost))
    assert sum(r["n_spans"] for r in found.values()) > 5
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("module,run", [(toxicity, "toxicity"), (quality, "quality")])
def test_classifiers(spark, docs, empty, module, run):
    rows = [(i, ("you worthless clown " if i % 3 == 0 else "a friendly kind word ") * 4 + (" ### %%%" * 30 if i % 2 else ""), "x") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    found = getattr(module, run)(table, labels).collect()
    truth = {i: (i % 2 if run == "quality" else int(i % 3 == 0)) for i in range(300)}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"]]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    assert getattr(module, run)(docs, labels.limit(0)).count() == docs.count()
    assert getattr(module, run)(empty, labels).count() == 0


def test_automaton():
    auto = toxicity.Automaton(["clown", "idiot"], 1)
    words = ["clown", "clwn", "cloown", "clpwn", "cl", "idioten", "idiot", "xidiot", "clowmn", "cclownn"]
    text = " ".join(words) + " "
    codes = np.array([auto.letters.get(c, 0) for c in text])
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    met, _, distance = auto.read(codes, starts, starts + np.array([len(w) for w in words]))
    assert {words[i]: int(d) for i, d in zip(met, distance)} == {"clown": 0, "clwn": 1, "cloown": 1, "clpwn": 1, "idiot": 0, "xidiot": 1, "clowmn": 1}


def test_fingerprint_deviation(spark):
    rows = [(i, " ".join([*(f"s{k}" for k in range(40)), *(f"d{i}x{k}" for k in range(20))])) for i in range(120)]  # 40 of 80 words
    codes = {r["doc_id"]: (r["next_id"], r["codes"]) for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(c) == 64 for _, c in codes.values())
    gap = [np.mean(np.array(c) == np.array(codes[n][1])) - 0.5 for n, c in codes.values()]
    assert np.sqrt(np.mean(np.square(gap))) < 0.078


def test_neighbors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    v[300:330] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    base = neighbors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    found = collections.defaultdict(list)
    for r in neighbors.search(base, base.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(600), -s))[:5]) & set(found[q]))
    assert hits / 60 >= 0.9 and found[0] == [300, 301, 302, 303, 304]
    assert neighbors.search(base.limit(0), base.limit(0)).count() == 0


def test_neighbors_of_near_copies():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 64))
    v[1::3] = v[1] + rng.normal(0, 1e-3, (3000, 64))
    ids = rng.permutation(9000) * 2
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    block = neighbors.Block(ids, v, *neighbors.fit(unit[:1000]))
    for q in [*range(1, 240, 12), *range(0, 240, 12)]:
        s = unit @ unit[q]
        s[q] = -2
        best, scores = block.search(int(ids[q]), v[q], 5)
        assert best.tolist() == ids[np.lexsort((ids, -s))[:5]].tolist() and np.allclose(scores, np.sort(s)[:-6:-1])
    few, many = (block.search(int(ids[1]), v[1], k)[0].tolist() for k in (5, 200))
    assert len(many) == 200 and many[:5] == few


def test_revisits(spark):
    records = spark.createDataFrame([(1, "http://A.com/x?utm_source=q", 1, True, "e1", {"date": "1", "content-type": "t"}), (2, "https://www.a.com/x/", 5, True, "e2", {"date": "5"}), (3, "a.com/x#f", 5, False, "e1", {"date": "9", "content-length": "0"}), (4, "a.com/x", 9, False, "W/e2", {}), (5, "a.com/y", 9, False, "e", None), (6, None, 9, False, None, None), (7, "a.com/x", 9, False, "e9", {})], "record_id long, url string, ts long, full boolean, etag string, headers map<string,string>")
    full = records.selectExpr("*", "cast(null as string) last_modified", "cast(null as string) digest", "'b' body")
    for span in (1, 4, 1 << 16):
        got = {r["record_id"]: (r["found"], r["status"], r["headers"]) for r in warc.resolve(full, span).collect()}
        assert got[3] == (1, "resolved", {"date": "9", "content-type": "t"}) and got[4][:2] == (2, "resolved")
        assert got[5][:2] == (None, "missing") and got[6][:2] == (None, "missing") and got[7][:2] == (2, "changed")


def test_revisits_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    ours = sorted(tuple(map(str, r)) for r in warc.revisits_query(spark, "/root/testdata/sf0.001").select("record_id", "url_key", "response_id", "status", "headers", "body_md5").collect())
    assert ours == sorted(tuple(map(str, r)) for r in con.execute(warc.REVISITS_SQL).fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, sf = source, "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == source.columns, name
    assert 0 < docs.count() and set(registry.QUERIES) and corpus_pipeline.run(spark, sf).count() > 0


def test_scanner_reads_mixed_words_and_long_quotations():
    scanner = toxicity.Scanner([("idiot", False, 2.0), ("clown", False, 1.0)])
    texts = ["an id1ot, a cl-wn; 12345 x2 idiot's", '"' + "calm words\n" * 200 + "idiot " + "more words " * 200 + '" clown', "no one", "", "clown-idiot"]
    (_, n, hits), = list(scanner(texts))
    assert n == 5 and hits["doc"].tolist() == [0, 0, 0, 1, 1, 4, 4]
    assert hits["distance"].tolist() == [1, 1, 0, 0, 0, 0, 0]
    assert hits["quoted"] == [False, False, False, True, False, False, False]
