"""Operator 4, best-fit packing: documents into sequences of at most `capacity` tokens, bulk-synchronously.

1. Tokenise: one pass gives each document's pieces (a document longer than a sequence is cut, nothing else is). The ids
   themselves are only measured and check-summed; they are not shuffled.
2. Range-sort the pieces by length, longest first; a row's rank is its partition's base and its place in it. Pieces of
   one length are interchangeable, so what the rounds work on are run-length tables, whose size depends on `capacity`
   and not on the corpus: runs of documents (length, first rank, number) and of gaps (gap, first sequence, number).
3. Rounds over these tables: a sweep down the sizes matches documents with their successors, the smallest gaps that take
   them. Where more documents than gaps meet, longer documents and lower ranks come first and the rest go on to the next
   larger gaps. Gaps are updated, and rounds repeat; when no document fits any gap, as many new sequences as the tokens
   left over need are opened with the longest documents.
4. A piece finds its sequence by its rank among the pieces of its length and the run that holds this rank: a broadcast
   of the runs by length, no shuffle.

Defined cases: null or empty text is its separator alone; equal lengths are ranked by doc_id and piece, nulls first, then by
row, so that rows with a repeated or null doc_id are packed once each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.llm.common import documents, stage

CAPACITY = 2048
#: Words whose ids a worker remembers.
MEMORY = 600_000
_SEPARATOR = (0).to_bytes(4, "little")
#: Bytes that byte-level vocabularies write as the character of the same number; the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class WordCoder:
    """Ids of whole texts by a tokenizer whose pieces never cross ASCII white space, a word at a time.

    Words seen before are looked up. The tokenizer lower-cases and cuts between letters and other signs, so a new word that is
    letters and then punctuation is put together from its parts, which are often known already; new parts
    are encoded by the vocabulary's merges alone, as nothing is left to normalise or to cut. Every other word goes through the
    whole tokenizer, with the end-of-text token between words.
    """

    _LETTERS = regex.compile(r"(\p{L}+)([^\s\p{L}\p{M}\p{N}'\x1c-\x1f\x85]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.parts = Tokenizer.from_file(path), {}, {}
        self.mark = self.tokenizer.token_to_id("<|endoftext|>")
        with open(path, encoding="utf-8") as f:
            bare = json.load(f)
        suffix = bare["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in bare["model"]["vocab"].items() if token.endswith(suffix)]] = True
        bare |= {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None}
        self.merges = Tokenizer.from_str(json.dumps(bare))

    @staticmethod
    def _split(ids: np.ndarray, cuts: np.ndarray, gap: int) -> Iterator[bytes]:
        raw, lo = ids.tobytes(), 0
        for hi in cuts.tolist():
            yield raw[4 * lo : 4 * hi]
            lo = hi + gap

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" <|endoftext|> ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(cuts) != len(part):
                raise ValueError("the tokenizer joined words across white space")
            yield from self._split(ids, cuts, 1)

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        signs = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_SIGNS) for p in parts]
        for at in range(0, len(signs), 4000):
            part = signs[at : at + 4000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not end words as expected")
            yield from self._split(ids, cuts, 0)

    def _learn(self, new: list[bytes]) -> None:
        whole, split, parts = [], [], self.parts
        for w in new:
            text = w.decode()
            if text.isalpha():  # the usual cases without a pattern
                letters, sign = text, ""
            elif text[-1] in ".,!?;:" and text[:-1].isalpha():
                letters, sign = text[:-1], text[-1]
            else:
                letters, sign = m.groups() if (m := self._LETTERS.fullmatch(text)) else ("", "")
            if letters and "Σ" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)) and len(low := letters.lower()) == len(letters):
                split.append((w, low, sign))
            elif "<|" in text:  # a special token's own text takes part in no joined call
                self.ids[w] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                whole.append((w, text))
        fresh = list({x for _, *both in split for x in both if x and x not in parts and "<|" not in x})
        parts.update(zip(fresh, self._encode_parts(fresh)))
        for w, low, sign in split:
            if sign in parts or not sign:
                self.ids[w] = parts[low] + (parts[sign] if sign else b"")
            else:
                self.ids[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self.ids.update(zip([w for w, _ in whole], self._encode_words([x for _, x in whole])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.ids) > MEMORY:
            self.ids.clear()
        if len(self.parts) > MEMORY:
            self.parts.clear()
        words = [t.split() for t in texts]
        if new := set().union(*words).difference(self.ids):
            self._learn(list(new))
        get = self.ids.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


_coders: dict[str, WordCoder] = {}


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name := path) is None:
            import public_tokenizers

            name = public_tokenizers.path("word_bpe_49k.json")
        coder = _coders.get(name) or _coders.setdefault(name, WordCoder(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, piece, start, length, crc = [], [], [], [], []
                raws = coder.encode([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                for i, raw in enumerate(raws):
                    raw += _SEPARATOR
                    for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[lo : lo + 4 * capacity]
                        own.append(i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                of = pa.array(own, pa.int32())
                columns = [part.column("doc_id").take(of), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)], part.column("row").take(of)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row), staged; row: a number of the document's row, as ids may repeat.

    tokenizer_path: a file on every executor, by default the public one.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return stage(rows.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, row long"), "pieces")




#: New sequences, each begun with a longest document: {need} of them, or more if more documents are over half a sequence.
_OPEN = """
with d as (select *, sum(n) over (order by size desc) - n as before from {t} where kind = 'doc'),
e as (select *, if(2 * size > {capacity}, n, least(n, greatest({need} - before, 0))) as take from d),
f as (select *, {opened} + sum(take) over (order by size desc) - take as start from e)
select kind, size, first, n, cast(null as bigint) as sequence, cast(null as bigint) as offset from {t} where kind = 'gap'
union all select 'gap', {capacity} - size, start, take, null, null from f where take > 0 and size < {capacity}
union all select 'out', size, first, take, start, 0 from f where take > 0
union all select 'doc', size, first + take, n - take, null, null from f where n > take"""

_RUNS = "kind string, size long, first long, n long, sequence long, offset long"


def _sweep(capacity: int):
    """A round over the runs, in order of size. Their number depends on `capacity`, not on the corpus, so they are one task's.

    Down the sizes, gaps are laid on a stack and documents take from its top: the smallest gap that takes them and that
    no longer document has. Each gap takes one document at most; what is left waits for the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RUNS.split(", ")]
        runs = [r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in names[:4]])]
        stack: list[list[int]] = []
        out: list[tuple] = []
        for kind, size, first, n in sorted(runs, key=lambda r: (-r[1], r[0] == "doc", r[2])):
            if kind == "gap":
                stack.append([size, first, n])
                continue
            while n and stack:
                gap = stack[-1]
                take = min(n, gap[2])
                gap[2] -= take
                sequence = gap[1] + gap[2]
                out.append(("out", size, first, take, sequence, capacity - gap[0]))
                if gap[0] > size:
                    out.append(("gap", gap[0] - size, sequence, take, None, None))
                first, n = first + take, n - take
                if not gap[2]:
                    stack.pop()
            if n:
                out.append(("doc", size, first, n, None, None))
        out += [("gap", *gap, None, None) for gap in stack]
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names)

    return run


def best_fit_rounds(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(length, lo, n, sequence, offset): documents of ranks lo to lo + n go to as many consecutive sequences, at offset.

    counts: (length, n), how many documents there are of each length.
    """
    spark = counts.sparkSession
    columns = ["'doc' as kind", "cast(length as bigint) as size", "cast(0 as bigint) as first", "n", "cast(null as bigint) as sequence", "cast(null as bigint) as offset"]
    table = stage(counts.coalesce(1).selectExpr(*columns), "runs")
    tables, opened, fresh = [table], 0, True
    while True:
        doc, out = F.col("kind") == "doc", F.col("kind") == "out"
        left, placed, begun = table.agg(
            F.sum(F.when(doc, F.col("size") * F.col("n"))), F.count(F.when(out, 1)), F.coalesce(F.max(F.when(out, F.col("sequence") + F.col("n"))), F.lit(0))
        ).first()
        opened = max(opened, begun)
        if not left:
            break
        if fresh or not placed:
            table = spark.sql(_OPEN, t=table.coalesce(1), need=-(-left // capacity), opened=opened, capacity=capacity)
        else:
            table = table.where("kind <> 'out'").coalesce(1).mapInArrow(_sweep(capacity), _RUNS)
        table = stage(table.coalesce(1), "runs")
        fresh = False
        tables.append(table)
    out = spark.read.schema(table.schema).parquet(*[f for t in tables for f in t.inputFiles()]) if opened else table
    return out.where(F.col("kind") == "out").select(F.col("size").alias("length"), F.col("first").alias("lo"), "n", "sequence", "offset")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    order = [F.desc("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("row")]
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranked = stage(pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(*pieces.columns, part.alias("part"), place.alias("place")), "sorted")
    before = lambda w: F.sum("n").over(w) - F.col("n")
    bases = ranked.groupBy("part").agg(F.count("*").alias("n")).select("part", before(W.orderBy("part")).alias("base"))
    counts = stage(ranked.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    runs = best_fit_rounds(counts, capacity).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "sequence", "offset"))).alias("runs"))
    runs = runs.join(counts.select("length", before(W.orderBy(F.desc("length"))).alias("longer")), "length")
    # a row for each partition, and for each length of at most `capacity`
    found = ranked.join(F.broadcast(bases), "part").join(F.broadcast(runs), "length").withColumn("rank", F.col("base") + F.col("place") - F.col("longer"))
    run = F.element_at(F.filter("runs", lambda r: r["lo"] <= F.col("rank")), -1)
    found = found.select(*pieces.columns, "rank", run.alias("run"))
    return found.select(*pieces.columns, (F.col("run.sequence") + F.col("rank") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir)))
