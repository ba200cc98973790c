"""Operator 6, substring dedup: repeated-phrase automata.

A window is `window` consecutive words of one document. A window whose words also start earlier in the corpus (smaller
doc_id, or the same document before) is a repeat, and the words it covers go.

1. Anchors: of the `gram`-word runs in a window, the one with the smallest hash; equal windows have the same anchor, at
   the same place. Anchors are counted over the corpus, and only documents with an anchor that occurs again go on.
2. Passages: the words around each recurring anchor that its windows span. Equal passages of a batch of documents become
   one row, the earliest, before anything is shuffled; the later ones are repeats whatever comes.
3. Shards: passages are dealt out by anchor (an anchor with more than HOT occurrences: window by window, by the words), so
   that all that may be equal meets. There equal passages are folded again; of anchors with different ones left, the
   windows that recur are confirmed word by word, compiled into an Aho-Corasick automaton with a letter for each word, and
   every passage is streamed through it to locate all occurrences; each one that isn't the earliest is a repeat. An automaton holds at most PATTERNS windows or the
   passages of one anchor.
4. Ranges of repeated words return to their documents.

Defined cases: null text has no words; rows with a null doc_id are returned as they are, and nothing is a repeat of them;
different texts under one doc_id come in the order of their hashes; equal texts under one doc_id are one place and don't
remove each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import documents, stage
from notelake.llm.vector_text import ngram_hashes, text_chunks, word_hashes, word_spans

WINDOW, GRAM = 20, 8
#: Occurrences from which an anchor's windows are dealt out one by one.
HOT = 1000
#: Windows in an automaton.
PATTERNS = 50_000
#: Bytes of text whose equal passages are folded together before the shuffle.
FOLD_BYTES = 24 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(starts, ends) of words, first word of each text, and for each window: its first word, its anchor's word, the anchor."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(words) - window + 1
    if n <= 0:
        return starts, ends, first, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = ngram_hashes(words, gram)
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window - gram + 1):
        other = grams[i : i + n]
        less = other < least  # the leftmost of equal ones stays
        least[less], place[less] = other[less], i
    lens = np.diff(first)
    at = np.arange(n)
    inside = np.repeat(first[1:], lens)[:n] - at >= window
    at = at[inside]
    return starts, ends, first, at, at + place[inside], least[inside]


def _count_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column("doc_id"), batch.column("tie")
            for row, data, offsets in text_chunks(batch.column("text")):
                _, _, first, at, place, anchor = anchors(data, offsets, window, gram)
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                doc = np.searchsorted(first, at[new], "right") - 1
                order = np.lexsort((anchor[new], doc))
                doc, key = doc[order], anchor[new][order]
                edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
                count = np.diff(np.append(edge, len(doc)))
                own = pa.array(doc[edge] + row)
                yield pa.RecordBatch.from_arrays([ids.take(own), ties.take(own), pa.array(key[edge].view(np.int64)), pa.array(count, pa.int64())], ["doc_id", "tie", "anchor", "n"])

    return run


#: What a row is known by: its doc_id and the hash of its text.
ROW = ["doc_id", "tie"]
PASSAGE = "key long, doc_id long, tie long, at int, size int, n long, words string"


def _passages(window: int, gram: int):
    """Rows (doc_id, tie, text, cold, hot) to passages; a row without words is a folded later one: all of it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PASSAGE.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        seen: dict[tuple, list] = {}
        later: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(key, *doc, at, size, n, words.decode()) for (key, words), (doc, at, size, n) in seen.items()]
            ranges: list[list[int]] = []
            for doc, at, size in sorted(later):
                if ranges and ranges[-1][0] == doc and at <= ranges[-1][2]:
                    ranges[-1][2] = max(ranges[-1][2], at + size)
                else:
                    ranges.append([doc, at, at + size])
            rows += [(doc[0] * 31 + at & 0xFFFFFFFF, *doc, at, end - at, 0, None) for doc, at, end in ranges]
            for lo in range(0, len(rows), 20_000):
                cols = list(zip(*rows[lo : lo + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def add(key: int, words: bytes, doc: tuple[int, int], at: int, size: int) -> None:
            old = seen.get((key, words))
            if old is None:
                seen[key, words] = [doc, at, size, 1]
            elif (doc, at) < (old[0], old[1]):
                later.append((old[0], old[1], size))
                old[:2] = doc, at
                old[3] += 1
            elif (doc, at) > (old[0], old[1]):
                later.append((doc, at, size))
                old[3] += 1

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("cold")))
            ids = list(zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()))
            cold, hot = batch.column("cold").to_pylist(), batch.column("hot").to_pylist()
            for row, data, offsets in text_chunks(batch.column("text")):
                starts, ends, first, at, place, anchor = anchors(data, offsets, window, gram)
                raw = data.tobytes()
                held += len(raw)
                for i in range(len(offsets) - 1):
                    lo, hi = np.searchsorted(at, [first[i], first[i + 1]])
                    if lo == hi:
                        continue
                    doc, base = ids[row + i], int(first[i])
                    own, where, spot = anchor[lo:hi].view(np.int64), at[lo:hi], place[lo:hi]
                    words = raw[int(offsets[i]) : int(offsets[i + 1])].split()
                    warm = np.isin(own, np.array(cold[row + i] or [], np.int64))
                    edge = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
                    stop = np.append(edge[1:], hi - lo)
                    for a, b in zip(edge[warm[edge]].tolist(), stop[warm[edge]].tolist()):
                        s, size = int(where[a]) - base, b - a + window - 1
                        add(int(own[a]), b" ".join(words[s : s + size]), doc, s, size)
                    if hot[row + i]:
                        for a in np.flatnonzero(np.isin(own, np.array(hot[row + i], np.int64))).tolist():
                            s = int(where[a]) - base
                            part = b" ".join(words[s : s + window])
                            add(int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), part, doc, s, window)
                if held >= FOLD_BYTES:
                    yield from flush()
                    seen, later, held = {}, [], 0
        yield from flush()

    return run


class _Letters(dict):
    """A letter for each word, given out as words come; a ValueError beyond a million words, which PATTERNS and HOT rule out."""

    def __missing__(self, word: str) -> str:
        self[word] = letter = chr(0x10000 + len(self))
        return letter


def fold_equal(passages: list[tuple[tuple[int, int], int, int, str]]) -> tuple[list, list]:
    """(different, later): the passages of one anchor with equal ones as the earliest, and the ranges of words of the later ones.

    Windows of one passage have one anchor at one place and differ, and equal windows have equal anchors, so where only one
    passage is left nothing else repeats, and none is different from it.
    """
    first: dict[str, list] = {}
    later = []
    for doc, at, n, words in passages:
        f = first.get(words)
        if f is None:
            first[words] = [doc, at, n]
            continue
        if (doc, at) != (f[0], f[1]):
            size = words.count(" ") + 1
            old = max((doc, at), (f[0], f[1]))
            later.append((old[0], old[1], old[1] + size))
            f[:2] = min((doc, at), (f[0], f[1]))
        f[2] += n
    if len(first) == 1:
        return [], later
    return [(*f, words) for words, f in first.items()], later


def locate_repeats(passages: list[tuple[tuple[int, int], int, int, str]], window: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """passages: (doc, first word, number, words). (doc, from, to): ranges of words in windows that also start earlier."""
    import ahocorasick

    letters = _Letters()
    coded = [(doc, at, n, "".join(map(letters.__getitem__, words.split(" ")))) for doc, at, n, words in passages]
    first: dict[str, list] = {}
    for doc, at, _, s in coded:
        for o in range(len(s) - window + 1):
            w = s[o : o + window]
            f = first.get(w)
            if f is None:
                first[w] = [doc, at + o, 1]
            else:
                f[2] += 1  # passages that were folded into one are not counted: of those the earliest is here
                if (doc, at + o) < (f[0], f[1]):
                    f[:2] = doc, at + o
    automaton = ahocorasick.Automaton()
    for w, f in first.items():
        if f[2] > 1:
            automaton.add_word(w, (f[0], f[1]))
    if not len(automaton):
        return
    automaton.make_automaton()
    for doc, at, _, s in coded:
        lo = hi = -1
        for end, earliest in automaton.iter(s):
            start = at + end - window + 1
            if earliest == (doc, start):
                continue
            if start > hi:
                if hi > lo:
                    yield doc, lo, hi
                lo = start
            hi = start + window
        if hi > lo:
            yield doc, lo, hi


def _locate(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int], int, int, str]] = []
        same: list[tuple[tuple[int, int], int, int, str]] = []
        patterns, last = 0, None
        names, kinds = [*ROW, "lo", "hi"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                flat = zip(*[(*doc, lo, hi) for doc, lo, hi in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)], names)

        def settle(rows: list[tuple]) -> int:
            """The passages of an anchor, all read, to held and rows; how many windows go to held."""
            nonlocal same
            different, later = fold_equal(same) if len(same) > 1 else ([], [])
            same = []
            rows += later
            held.extend(different)
            return sum(words.count(" ") + 2 - window for *_, words in different)

        for batch in batches:
            rows = []
            for key, doc_id, tie, at, size, n, words in zip(*[batch.column(c.split()[0]).to_pylist() for c in PASSAGE.split(", ")]):
                doc = (doc_id, tie)
                if words is None:
                    rows.append((doc, at, at + size))
                    continue
                if key != last:
                    patterns += settle(rows)
                    if patterns >= PATTERNS:
                        yield from out(list(locate_repeats(held, window)))
                        held, patterns = [], 0
                last = key
                same.append((doc, at, n, words))
            yield from out(rows)
        rows = []
        settle(rows)
        yield from out(rows)
        yield from out(list(locate_repeats(held, window)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges) to (doc_id, n_words, n_removed, kept)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            total, gone, kept = [], [], []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                words = (text or "").encode().split()
                total.append(len(words))
                if ranges:
                    stay = np.ones(len(words), bool)
                    for r in ranges:
                        stay[r["lo"] : r["hi"]] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs; kept: the words that stay, joined by one space."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    able = docs.where(F.col("doc_id").isNotNull())
    found = stage(able.mapInArrow(_count_anchors(window, gram), "doc_id long, tie long, anchor long, n long"), "anchors")
    again = found.groupBy("anchor").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    own = found.select(*ROW, "anchor").join(again, "anchor")
    own = own.groupBy(*ROW).agg(
        F.collect_set(F.when(F.col("all") <= hot, F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("all") > hot, F.col("anchor"))).alias("hot")
    )
    # a left join, here as at the end, so that both read one shuffle of the texts
    passages = docs.join(own.hint("shuffle_hash"), ROW, "left").select(*ROW, "text", "cold", "hot").mapInArrow(_passages(window, gram), PASSAGE)
    dealt = passages.repartition("key").sortWithinPartitions("key")
    ranges = dealt.mapInArrow(_locate(window), "doc_id long, tie long, lo int, hi int").groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return docs.join(ranges.hint("shuffle_hash"), ROW, "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, unnest(range(1, len(ws) - {WINDOW} + 2)) as spot, ws from w),
v as (select doc_id, spot, array_to_string(ws[spot:spot + {WINDOW - 1}], ' ') as words from p),
again as (select doc_id, spot from (select doc_id, spot, row_number() over (partition by words order by doc_id, spot) as n from v) where n > 1),
gone as (select distinct doc_id, spot + i as spot from again, range(0, {WINDOW}) as r(i)),
word as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as spot from w),
kept as (select doc_id, string_agg(word, ' ' order by spot) as kept, count(*) as n from word anti join gone using (doc_id, spot) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)
"""
