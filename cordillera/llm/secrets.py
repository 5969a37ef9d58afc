"""Secret scans: fixed patterns, and two character Markov models compared by their log-likelihood ratio.

Everything is a DataFrame or SQL expression; the nested ones are SQL text, which is planned in a fraction of the time. The lengths of a pattern's matches and of the gaps between them, from one split
of the text by the same pattern, sum up to every match's code points. For the method, each long run of token characters is
scored: the mean over its bigrams of log P(next | previous) in random strings less that in ordinary identifiers. Both models
are bigram counts of a labelled sample, with add-one smoothing over the token alphabet, so they have at most 2 * 67 * 67
entries. Random strings are hashes in hexadecimal, base64 and base36; ordinary identifiers join words that stand alone in at
most `TEXTS` texts of the scanned table, chosen by a hash. A fifth of the sample is held out from the counts.

Costs are in proportion to a text's length, whatever it holds: sums over matches are kept in blocks, the bigrams of a run are
read once, and texts are cut in blocks of `PIECE` code points.

Defined cases: a null or empty text has no span and the hash of the empty string; a very long text or run is scanned whole;
overlapping spans of two kinds are all reported; rows that repeat are scanned each; a table without words teaches no model and
has no `markov` span; an empty table gives no rows. Other columns are kept, whatever their names; `scan` replaces a column
named spans, `redacted` keeps it and, where there is one, sets n_chars to the new length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns with their least lengths. A run of one class holds its least length or has no match in
# it at all, so that length stands in the two patterns of runs; an assignment's does not, as a short one still uses up text.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the models score. Shorter ones are too few bigrams to tell.
NAMED = r"[pPsStTaA](?i:assword|asswd|ecret|oken|pi_?key)[\x22\x27]?\x20*[:=]"  # what every assignment holds
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
LEAST_RUN = 16
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Bounds of the sample: texts that lend words, words, and random strings.
TEXTS, SAMPLES = 2000, 4000
#: Mean log-likelihood ratio a bigram from which a run is a secret.
THRESHOLD = 0.6
#: Numbers and code points of a block.
BLOCK, PIECE = 64, 4096
_LOW, _WIDE = 43, 80  # token characters are the code points from 43 to 122


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scanned(values: str, merge: str, levels: int = 2) -> str:
    """SQL: of ints x1, x2, ..: x1, merge(x1, x2), .. up to each; merge holds {s} and {x}. Growing an array copies it, so long
    ones are done in blocks: each by itself, then joined to what the blocks before it come to, found in the same way."""
    met = lambda s, x: f"if({s} is null, {x}, {merge.format(s=s, x=x)})"
    plain = lambda v: f"aggregate({v}, named_struct('s', cast(null as int), 'out', cast(array() as array<int>)), (a, x) -> named_struct('s', {met('a.s', 'x')}, 'out', concat(a.out, array({met('a.s', 'x')}))), a -> a.out)"
    if not levels:
        return plain(values)
    v, own, upto = f"v{levels}", f"own{levels}", f"upto{levels}"
    blocks = f"transform(sequence(0, int(floor((size({v}) - 1) / {BLOCK}))), k -> {plain(f'slice({v}, k * {BLOCK} + 1, {BLOCK})')})"
    before = _scanned(f"transform({own}, b -> element_at(b, -1))", merge, levels - 1)
    moved = _let(upto, before, f"flatten(zip_with({own}, {_before(upto, 'cast(null as int)')}, (b, s) -> transform(b, x -> {met('s', 'x')})))")
    return _let(v, values, f"if(size({v}) <= {BLOCK}, {plain(v)}, {_let(own, blocks, moved)})")


def _before(values: str, first: str) -> str:
    """SQL: values moved on by one, first in front."""
    return f"concat(array({first}), slice({values}, 1, greatest(size({values}) - 1, 0)))"


def _matches(text: str, pattern: str, group: int, least: int, rank: int) -> str:
    """SQL: array of (start, rank, end, found) of the matches whose group has `least` characters, in code points."""
    whole = f"regexp_extract_all({text}, r'{pattern}', 0)"
    part = f"regexp_extract_all({text}, r'{pattern}', {group})" if group else "cast(null as array<string>)"
    gaps = f"transform(split({text}, r'{pattern}', -1), g -> length(g))"
    ends = _scanned("zip_with(slice(m.gap, 1, size(m.whole)), m.whole, (g, w) -> g + length(w))", "{s} + {x}")
    size = "length(x.part)" if group else "length(x.whole)"
    every = f"zip_with({ends}, zip_with(m.whole, {'m.part' if group else 'm.whole'}, (w, p) -> named_struct('whole', w, 'part', p)), (e, x) -> named_struct('start', e - length(x.whole), 'rank', {rank}, 'end', e, 'found', x.whole, 'size', {size}))"
    kept = f"transform(filter({every}, x -> x.size >= {least}), x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'found', x.found))"
    return _let("m", f"named_struct('gap', {gaps}, 'whole', {whole}, 'part', {part})", kept)


def labelled(docs: DataFrame) -> DataFrame:
    """(label, s, held_out): random strings are 1, ordinary identifiers of words in docs 0. At most 2 * SAMPLES rows."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("t")).where("t <> ''")
    chosen = texts.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(TEXTS)
    alone = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z]{2,20}(?![A-Za-z0-9+/_=-])"
    lent = texts.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), "h", "left_semi")
    words = lent.select(F.explode(F.regexp_extract_all("t", F.lit(alone), F.lit(0))).alias("w")).distinct()
    words = words.orderBy(F.xxhash64("w"), "w").limit(SAMPLES)
    one = Window.orderBy(F.xxhash64("w"), "w")  # SAMPLES rows at most
    three = words.select(F.xxhash64("w").alias("h"), "w", F.lag("w", 1, "").over(one).alias("v"), F.lag("w", 2, "").over(one).alias("u"))
    forms = (F.concat_ws("_", "w", "v", "u"), F.concat("w", F.initcap("v"), F.initcap("u")), F.concat_ws("-", "w", "v", "u"), F.concat_ws("/", "w", "v", "u"), F.upper(F.concat_ws("_", "w", "v")), F.concat("w", "v", "u"))
    plain = three.select(F.lit(0).alias("label"), F.element_at(F.array(*forms), (F.pmod("h", F.lit(6)) + 1).cast("int")).alias("s"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    forms = (digest, F.base64(F.unhex(digest)), F.lower(F.conv(F.substring(digest, 1, 15), 16, 36)), F.translate(F.base64(F.unhex(digest)), "+/=", "-_0"), F.upper(F.conv(F.substring(digest, 16, 15), 16, 36)))
    random = docs.sparkSession.range(0, SAMPLES, 1, 4).select(F.lit(1).alias("label"), F.element_at(F.array(*forms), (F.col("id") % 5 + 1).cast("int")).alias("s"))
    return plain.union(random).withColumn("held_out", F.pmod(F.xxhash64("s", F.lit(1)), F.lit(5)) == 0)


def markov_table(sample: DataFrame) -> list[float]:
    """Log-likelihood ratios of the bigrams, at (first - _LOW) * _WIDE + second - _LOW; all 0.0 without both classes."""
    rows = sample.where("not held_out")
    pairs = rows.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda j: F.substr(F.col("s"), j, F.lit(2)))).alias("pair"))
    counts: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "pair").count().collect():  # at most two rows for each pair of the alphabet
        counts[r["label"]][r["pair"]] = r["count"]
    out = [0.0] * (_WIDE * _WIDE)
    if counts[0] and counts[1]:
        firsts = {k: {a: sum(v.get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for k, v in counts.items()}
        chance = lambda k, a, b: (counts[k].get(a + b, 0) + 1) / (firsts[k][a] + len(ALPHABET))
        for a in ALPHABET:
            for b in ALPHABET:
                out[(ord(a) - _LOW) * _WIDE + ord(b) - _LOW] = math.log(chance(1, a, b) / chance(0, a, b))
    return out


def likely(run: str, table: list[float]) -> str:
    """SQL: the run's mean log-likelihood ratio passes, and it has a letter and a digit: words have none, numbers no letter."""
    ratios = f"cast(split('{','.join(map(repr, table))}', ',') as array<double>)"
    add = f"named_struct('last', ascii(c) - {_LOW}, 'sum', a.sum + if(a.last < 0, 0.0D, get({ratios}, a.last * {_WIDE} + ascii(c) - {_LOW})))"
    mean = f"aggregate(split({run}, ''), named_struct('last', -1, 'sum', 0.0D), (a, c) -> {add}, a -> a.sum) / (length({run}) - 1)"
    return f"{run} rlike '[0-9]' and {run} rlike '[A-Za-z]' and {mean} >= {THRESHOLD}"


def _spans(text: str, table: list[float]) -> str:
    """SQL: array of (start, rank of the kind, end), sorted. A run of token characters is scored unless a base span covers it."""
    none = "cast(array() as array<struct<start:int,rank:int,end:int,found:string>>)"
    # access keys and long hexadecimal numbers stand in runs of token characters
    access = f"if(exists(runs, r -> contains(r.found, 'AKIA')), {_matches(text, ACCESS, 0, 20, 1)}, {none})"
    digits = f"if(exists(runs, r -> r.found rlike r'{HEX}'), {_matches(text, HEX, 0, 24, 2)}, {none})"
    assign = f"if({text} rlike r'{NAMED}', {_matches(text, ASSIGN, 2, 6, 0)}, {none})"
    # by start, base spans first: the furthest end of a base span up to a run tells whether one covers it
    reach = _scanned("transform(every, s -> if(s.rank < 3, s.end, -1))", "greatest({s}, {x})")
    uncovered = _let("every", "array_sort(concat(found.base, found.runs))", f"transform(filter(zip_with(every, {reach}, (s, reach) -> named_struct('s', s, 'reach', reach)), y -> y.s.rank = 3 and y.reach < y.s.end), y -> y.s)")
    open_runs = f"if(size(found.runs) = 0 or size(found.base) = 0, found.runs, {uncovered})"
    judged = f"array_sort(transform(concat(found.base, filter({open_runs}, r -> {likely('r.found', table)})), s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end)))"
    runs = f"if({text} rlike r'{TOKEN}', {_matches(text, TOKEN, 0, LEAST_RUN, 3)}, {none})"
    return _let("found", _let("runs", runs, f"named_struct('base', concat({assign}, {access}, {digits}), 'runs', runs)"), judged)


def _with_spans(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text (empty for null), s (spans): internal names can't clash with those of docs."""
    table = markov_table(labelled(docs))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("s", F.expr(_spans("text", table)))


def scan(docs: DataFrame) -> DataFrame:
    """docs with spans: an array of (start, end, kind), by start and then as the kinds are listed, `markov` last."""
    kind = F.array(*map(F.lit, KINDS))
    spans = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(kind, x["rank"] + 1).alias("kind")))
    return _with_spans(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: str, spans: str, mark: str) -> str:
    """SQL: text with mark in place of each run of overlapping spans."""
    blocks = f"transform(sequence(0, int(floor((length({text}) - 1) / {PIECE}))), k -> substr({text}, k * {PIECE} + 1, {PIECE}))"
    inner = f"substr(get(c.blocks, k), greatest(g.lo - k * {PIECE}, 0) + 1, least(g.hi - k * {PIECE}, {PIECE}) - greatest(g.lo - k * {PIECE}, 0))"
    piece = f"if(g.lo >= g.hi, '', array_join(transform(sequence(int(floor(g.lo / {PIECE})), int(floor((g.hi - 1) / {PIECE}))), k -> {inner}), ''))"
    gaps = f"zip_with({spans}, {_before('c.reach', '0')}, (s, at) -> named_struct('lo', at, 'hi', s.start))"
    # a span that begins in another one adds nothing
    ends = f"concat(filter({gaps}, g -> g.hi >= g.lo), array(named_struct('lo', element_at(c.reach, -1), 'hi', length({text}))))"
    reach = _scanned(f"transform({spans}, s -> s.end)", "greatest({s}, {x})")
    return _let("c", f"named_struct('blocks', {blocks}, 'reach', {reach})", f"array_join(transform({ends}, g -> {piece}), '{mark}')")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the scan replaced by mark, overlapping ones by one; n_chars follows where it exists."""
    clean = F.when(F.size("s") > 0, F.expr(_cut("text", "s", mark))).otherwise(F.col("row")["text"])
    done = _with_spans(docs).select("row", clean.alias("clean"))
    value = lambda c: F.col("clean") if c == "text" else F.length("clean").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row")[c]
    return done.select(*[value(c).alias(c) for c in docs.columns])


def secrets_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    many = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs).select("doc_id", *many, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
