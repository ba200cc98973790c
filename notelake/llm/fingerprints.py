"""Operator 2, document fingerprints: improved consistent weighted sampling, with DataFrame functions only.

The terms of a text are its words, weighted by their number. For sample k every term draws r, c ~ Gamma(2, 1)
(minus the logarithm of a product of two uniforms) and beta ~ U(0, 1) from hashes of (term, k); with
t = floor(ln(w) / r + beta) the term's rank is ln(a) = ln(c) - r (t - beta + 1), and the smallest one is the sample
(term, t). Two texts agree in a sample with probability sum(min(w)) / sum(max(w)), the generalised Jaccard similarity
of their weighted terms.

Plan: the texts move once, dealt out by key; words are counted, samples folded (one min() per sample: rank in the high
bits, sample identity in the low ones) and fingerprints put together in the same stage, without another shuffle.

The key of a row is its doc_id and a hash of its text, so that different texts under one doc_id stay apart. Rows with equal
keys are equal: they are computed once and returned as often as they occur.

Defined cases: null text is the empty text; a text without words has the fingerprint of all zeros, and is like
another such text only (likeness 1); in the ring rows of one doc_id follow each other by the hash of their texts, equal
ones side by side, and rows without a doc_id come after all others; a single row is its own next one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.llm.common import WORD_GAP, documents, stage, text_or_empty

#: Samples in a fingerprint.
SAMPLES = 64
#: Bits of a fingerprint's sample.
SAMPLE_BITS = 16
#: Samples that one row of the fold makes; with more the generated methods get too long for the JIT compiler.
GROUP = 2
_TAG = 20  # low bits of a folded sample: its identity; the 40 above: its rank


def _fold_samples(rows: DataFrame, keys: list[str], weights: list[str], samples: int) -> DataFrame:
    """Rows (keys, h, ln_ of weights) to (keys, g, s0, s1): the folded samples of each group g, an array for each weight.

    Two hashes of (term, sample) give the four uniforms of r and c (24 bits each), beta and the identity; each is a column of its own,
    used by all weights. A weight of zero is null and takes no part in the minima; equal weights have equal samples.
    """
    bits = lambda z, at, n: F.shiftrightunsigned(z, at).bitwiseAND((1 << n) - 1)
    uniform = lambda z, at, n: (bits(F.col(z), at, n) + F.lit(0.5)) / F.lit(float(1 << n))
    js = range(GROUP)
    x = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // GROUP - 1))).alias("g"))
    x = x.withColumns({f"y{j}": F.xxhash64("h", "g", F.lit(2 * j)) for j in js} | {f"z{j}": F.xxhash64("h", "g", F.lit(2 * j + 1)) for j in js})
    x = x.withColumns(
        {f"r{j}": -F.log(uniform(f"y{j}", 0, 24) * uniform(f"y{j}", 24, 24)) for j in js}
        | {f"c{j}": F.log(-F.log(uniform(f"z{j}", 0, 24) * uniform(f"z{j}", 24, 24))) for j in js}
        | {f"b{j}": uniform(f"y{j}", 48, 16) for j in js}
    )

    for i, w in enumerate(weights):  # equal weights have equal samples
        t, same = F.col(f"ln_{w}"), F.col(f"ln_{w}") == F.col(f"ln_{weights[0]}")
        x = x.withColumns({f"t{j}": F.floor(t / F.col(f"r{j}") + F.col(f"b{j}")) for j in js})
        rank = lambda j: F.floor((F.col(f"c{j}") - F.col(f"r{j}") * (F.col(f"t{j}") - F.col(f"b{j}") + F.lit(1.0)) + F.lit(128.0)) * F.lit(float(1 << 32)))
        identity = lambda j: (bits(F.col(f"z{j}"), 48, 16) + F.col(f"t{j}") * F.lit(40503)).bitwiseAND((1 << _TAG) - 1)
        key = lambda j: F.shiftleft(rank(j), _TAG).bitwiseOR(identity(j))
        x = x.withColumns({f"k{j}_{i}": F.when(same, F.col(f"k{j}_0")).otherwise(key(j)) if i else key(j) for j in js})
    least = x.groupBy(*keys, "g").agg(*[F.min(f"k{j}_{i}").alias(f"m{j}_{i}") for j in js for i in range(len(weights))])
    return least.select(*keys, "g", *[F.when(F.col(f"m0_{i}").isNotNull(), F.array(*[F.col(f"m{j}_{i}") for j in js])).alias(f"s{i}") for i in range(len(weights))])


def term_weights(docs: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Rows (keys, h, w0, ...): the hash of each distinct word and its number in each text column.

    Rows that are dealt out by their keys already are not shuffled again.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(texts)])
    x = docs.select(*keys, F.explode(sides).alias("x")).select(*keys, "x.side", F.explode(F.split("x.text", WORD_GAP)).alias("word"))
    counts = [F.sum((F.col("side") == i).cast("int")).alias(f"w{i}") for i in range(len(texts))]
    return x.where(F.col("word") != "").groupBy(*keys, F.xxhash64("word").alias("h")).agg(*counts)


def weighted_samples(docs: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each text column, an array of folded samples named after it (null or no row: no terms)."""
    weights = [f"w{i}" for i in range(len(texts))]
    rows = term_weights(docs, keys, texts).select(*keys, "h", *[F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(f"ln_{w}") for w in weights])
    parts = _fold_samples(rows, keys, weights, samples)
    whole = lambda i: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("g", f"s{i}"))), lambda p: p[f"s{i}"]))
    return parts.groupBy(*keys).agg(*[whole(i).alias(c) for i, c in enumerate(texts)])


def fingerprint_text(folded: Column, samples: int = SAMPLES) -> Column:
    """The fingerprint as lower-case hex, SAMPLE_BITS a sample; all zeros for a text without terms."""
    digits = SAMPLE_BITS // 4
    one = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND((1 << SAMPLE_BITS) - 1))), digits, "0")
    return F.coalesce(F.array_join(F.transform(folded, one), ""), F.lit("0" * digits * samples))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree; a fingerprint without terms agrees with its like only."""
    digits = SAMPLE_BITS // 4
    none = F.lit("0" * digits * samples)
    part = lambda c, i: F.substr(c, i * digits + 1, F.lit(digits))
    hits = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: part(a, i) == part(b, i)))
    return F.when(a == b, F.lit(1.0)).when((a == none) | (b == none), F.lit(0.0)).otherwise(hits / F.lit(float(samples)))


KEY = ["id", "tie"]


def keyed(docs: DataFrame) -> DataFrame:
    """(id, tie, missing, text): the key of each row, and whether its doc_id is missing."""
    text, missing = text_or_empty(), F.col("doc_id").isNull()
    tie = F.when(missing, F.xxhash64(F.lit("missing"), text)).otherwise(F.xxhash64(text))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), tie.alias("tie"), missing.alias("missing"), text.alias("text"))


def ring(keys: DataFrame) -> DataFrame:
    """keys (id, tie, missing, ...) with next_id and next_tie, around the ring of descending ids.

    The keys are range-sorted; a partition's last key is followed by the first one of the next partition.
    """
    order = [F.col("missing"), F.desc("id"), F.col("tie")]
    ranked = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ring")
    here, chain = W.partitionBy("part").orderBy("place"), W.orderBy("part")
    # a row for each partition
    heads = ranked.groupBy("part").agg(F.min_by(F.struct(*KEY), "place").alias("head"))
    first = F.first("head").over(chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(chain), first).alias("then"))
    x = ranked.withColumn("next", F.lead(F.struct(*KEY)).over(here)).join(F.broadcast(heads), "part")
    x = x.withColumn("next", F.coalesce("next", "then"))
    return x.select(*keys.columns, F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie"))


def op2_fingerprints(spark: SparkSession, sf_dir: str, samples: int = SAMPLES) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir), samples)


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint against that of its edited text and that of the next document."""
    rows = keyed(docs)
    texts = rows.select(*KEY, "text").dropDuplicates(KEY)
    keys = rows.groupBy(*KEY, "missing").agg(F.count("*").alias("rows"), F.max(F.char_length("text").cast("long")).alias("n_chars"))
    # equal rows stand side by side: all but the last are followed by their like
    then = lambda twin, times, id_, tie: F.struct(F.lit(twin).alias("twin"), times.cast("long").alias("times"), F.col(id_).alias("next_id"), F.col(tie).alias("next_tie"))
    twin = F.array(then(False, F.lit(1), "next_id", "next_tie"), then(True, F.col("rows") - 1, "id", "tie"))
    pairs = ring(keys).select(*KEY, "missing", "n_chars", F.explode(twin).alias("p")).select(*KEY, "missing", "n_chars", "p.*").where(F.col("times") > 0)
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    # what each text lends to the one before it in the ring
    need = pairs.select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.struct(*KEY, "twin", "missing", "n_chars", "times", cut.alias("cut")).alias("to"))
    lent = texts.join(need.hint("shuffle_hash"), KEY).select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), "to.*", F.substr("text", F.lit(1), F.col("to.cut")).alias("lent"))
    both = texts.join(lent.hint("shuffle_hash"), KEY)
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.col("lent"))
    both = both.select(*KEY, "twin", "missing", "n_chars", "times", "next_id", "next_tie", "text", edited.alias("edited"))
    folded = weighted_samples(both, [*KEY, "twin"], ["text", "edited"], samples).withColumnsRenamed({"text": "own", "edited": "other"})
    about = both.select(*KEY, "twin", "missing", "n_chars", "times", "next_id", "next_tie", F.sha2("edited", 256).alias("edited_sha256"))
    # by the key the texts are dealt out by already; a row and its twin are told apart by a condition that isn't a key
    folded = folded.select(F.col("id").alias("id_"), F.col("tie").alias("tie_"), F.col("twin").cast("int").alias("twin_"), "own", "other")
    same = (F.col("id") == F.col("id_")) & (F.col("tie") == F.col("tie_")) & (F.col("twin").cast("int") - F.col("twin_") == 0)
    out = about.join(folded.hint("shuffle_hash"), same, "left").select(
        *about.columns, fingerprint_text(F.col("own"), samples).alias("fingerprint"), fingerprint_text(F.col("other"), samples).alias("edited_fingerprint")
    )
    out = stage(out, "fingerprints")
    after = out.where(~F.col("twin")).select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("fingerprint").alias("next_fingerprint"))
    return out.join(after, ["next_id", "next_tie"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        F.when(~F.col("missing"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
