"""Operator 13, suffix-array dedup: merged Burrows-Wheeler transforms.

A window is `window` consecutive bytes (UTF-8) of one document. A window whose bytes also start anywhere else, in another
document or at another place of the same one, is repeated, and every byte that such a window covers goes.

1. Anchors: the `gram` bytes with the smallest hash in a window, the leftmost of equal ones, stand at the same place in
   equal windows. Neighbouring windows with one anchor are a passage, so each window is in one passage. Equal passages of
   a batch of documents become one row with their number before anything is shuffled.
2. Passages are dealt out by anchor, as hashes. Where an anchor has passages of different content, one of each content
   goes on with its bytes; a passage whose whole content (128 bits of hashes) occurs twice is repeated throughout.
3. Shards: the passages of an anchor meet in one task, which cuts what it gets into shards, transforms each and merges the
   transforms (llm/bwt.py); windows in an interval with `window` bytes in common are repeated. The passages of an anchor
   with over HOT_BYTES of different passages are dealt out window by window instead, by the windows' hashes.
4. Ranges return to their documents and the bytes go.

Memory: a task holds one batch, one merge (at most 2 million symbols) and one row; no group is collected. Defined cases:
null text is empty; texts shorter than a window are kept whole; null doc_ids are ids like others; rows that repeat doc_id
and text are two documents, so that both lose what they share; an empty table gives an empty result; other columns are
ignored. `kept` is binary: a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.bwt import MOST, merge, transform
from notelake.llm.common import documents, stage
from notelake.llm.vector_text import mix, text_chunks

WINDOW, GRAM = 200, 64
#: Bytes of text whose equal passages are folded together before the shuffle.
FOLD_BYTES = 24 << 20
#: Bytes of different passages from which an anchor's windows are dealt out one by one.
HOT_BYTES = 1 << 20
#: Symbols of a shard, and of shards that are merged once their anchors are complete.
SHARD, ENOUGH = 1 << 18, 1 << 20
#: Windows of a text that are looked at together.
SLICE = 1 << 23
ROW = ["doc_id", "tie"]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """uint64 hash of the `size` (8 or more) bytes that start at each place."""
    n = len(data) - 7
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    x = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        x[k::8] = padded[k : k + 8 * ((n - k + 7) // 8)].view("<u8")
    held = 8
    while held < size:
        step = min(held, size - held)
        left = x[: len(x) - step] * np.uint64(0x9E3779B97F4A7C15)
        left ^= left >> np.uint64(29)
        left += x[step:]
        x = left
        held += step
    return mix(x)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    held = 1
    while held < width:
        step = min(held, width - held)
        x = np.minimum(x[: len(x) - step], x[step:])
        held += step
    return x


def passages(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in data, windows, anchor) of the passages of some texts; offsets: where the texts start, and the end."""
    parts = []
    for lo in range(0, max(len(data) - window + 1, 0), SLICE):
        part = data[lo : lo + SLICE + window - 1]
        n = len(part) - window + 1
        hashes = gram_hashes(part, gram)
        place = np.uint64(24)  # SLICE + window fit in 24 bits
        least = _least((hashes >> place << place) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = np.arange(lo, lo + n)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + window <= offsets[text + 1]
        at, text, anchor = at[inside], text[inside], anchor[inside]
        edge = np.ones(len(at), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        edge = np.flatnonzero(edge)
        parts.append((text[edge], at[edge], np.diff(np.append(edge, len(at))), hashes[anchor[edge]]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents sorted and, where they touch, joined."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    far = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + doc * far)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] + doc[1:] * far > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.append(reach[first[1:] - 1], reach[-1]) - doc[first] * far


#: A passage, or with n = 0 a range that is known to be repeated. lo, hi: of the passage's windows.
PASSAGE = "anchor long, content long, doc_id long, tie long, lo int, hi int, n int"
_KINDS = [pa.int64()] * 4 + [pa.int32()] * 3
_NAMES = [c.split()[0] for c in PASSAGE.split(", ")]


def _find(window: int, gram: int):
    """Rows (doc_id, tie, text) to PASSAGE rows, equal passages of a batch as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ids: list[pa.Array] = []
        ties: list[pa.Array] = []
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, lo, n, anchor, content = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((lo, doc, content, anchor))
            doc, lo, n, anchor, content = (x[order] for x in (doc, lo, n, anchor, content))
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            first = np.flatnonzero(new)
            again = ~new
            d, a, b = _ranges(doc[again], lo[again], (lo + n)[again])
            every = np.concatenate([doc[first], d])
            spread = mix(d.astype(np.uint64) + xxhash.xxh3_64_intdigest(repr(len(held)).encode()))
            columns = [
                np.concatenate([anchor[first], spread]).view(np.int64), np.concatenate([content[first], np.zeros(len(d), np.uint64)]).view(np.int64), None, None,
                np.concatenate([lo[first], a]), np.concatenate([(lo + n)[first], b]), np.concatenate([np.diff(np.append(first, len(doc))), np.zeros(len(d), np.int64)]),
            ]
            at = pa.array(every)
            columns[2], columns[3] = pa.chunked_array(ids).take(at).combine_chunks(), pa.chunked_array(ties).take(at).combine_chunks()
            table = pa.table([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, _KINDS)], names=_NAMES)
            yield from table.to_batches(max_chunksize=50_000)

        for batch in batches:
            ids.append(batch.column("doc_id"))
            ties.append(batch.column("tie"))
            for row, data, offsets in text_chunks(batch.column("text")):
                text, start, n, anchor = passages(data, offsets, window, gram)
                raw = memoryview(data)
                content = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + window - 1).tolist())]
                held.append((text + row + rows, start - offsets[text], n, anchor, np.array(content, np.uint64)))
                size += len(data)
            rows += batch.num_rows
            if size >= FOLD_BYTES:
                yield from flush()
                held, ids, ties, size, rows = [], [], [], 0, 0
        if held:
            yield from flush()

    return run


#: anchor null: the windows lo..hi-1 are repeated. Else the passage's bytes are needed.
MARK = "doc_id long, tie long, lo int, hi int, anchor long"


def _recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PASSAGE rows sorted by anchor and content to MARK rows. Of the group at the end of a batch, one row is carried on."""
    carry, carried_group, carried_rest = None, False, False  # its group, and its own passage, have been reported
    for batch in batches:
        known = pc.equal(batch.column("n"), 0)
        done = batch.filter(known)
        rows = batch.filter(pc.invert(known))
        if carry is not None:
            rows = pa.Table.from_batches([carry, rows]).combine_chunks().to_batches()[0]
        out = [[done.column(c) for c in ("doc_id", "tie", "lo", "hi")] + [pa.nulls(done.num_rows, pa.int64())]]
        if rows.num_rows:
            anchor, content, n = (rows.column(c).to_numpy() for c in ("anchor", "content", "n"))
            group, run = np.ones(len(n), bool), np.ones(len(n), bool)
            group[1:] = anchor[1:] != anchor[:-1]
            run[1:] = group[1:] | (content[1:] != content[:-1])
            first = np.flatnonzero(run)
            total = np.add.reduceat(n.astype(np.int64), first)
            of_run = np.cumsum(run) - 1
            of_group = (np.cumsum(group) - 1)[first]
            mixed = np.bincount(of_group) > 1
            repeated, needed = total[of_run] > 1, mixed[of_group]
            if carry is not None:
                repeated[0] &= not carried_rest
                needed[0] &= not carried_group
                carried_group = (carried_group or bool(mixed[0])) if of_group[-1] == 0 else bool(mixed[-1])
            else:
                carried_group = bool(mixed[-1])
            carried_rest = bool(total[-1] > 1)
            whole, part = pa.array(np.flatnonzero(repeated)), pa.array(first[needed])
            out.append([rows.column(c).take(whole) for c in ("doc_id", "tie", "lo", "hi")] + [pa.nulls(len(whole), pa.int64())])
            out.append([rows.column(c).take(part) for c in ("doc_id", "tie", "lo", "hi", "anchor")])
            carry = rows.slice(int(first[-1]), 1)
            spot = carry.schema.get_field_index("n")
            carry = carry.set_column(spot, carry.schema.field(spot), pa.array([min(int(total[-1]), 2)], pa.int32()))
        for columns in out:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "lo", "hi", "anchor"])


#: key: the anchor, or the hash of a window of a hot anchor.
PIECE = "key long, doc_id long, tie long, lo int, bytes binary"


def _cut_out(window: int):
    """Rows (doc_id, tie, text, wanted) to PIECE rows."""
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("wanted")))
            rows: list[tuple] = []
            for doc_id, tie, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "tie", "text", "wanted"))):
                raw, doc = text.as_py().encode(), (doc_id.as_py(), tie.as_py())
                for w in wanted.as_py():
                    if not w["hot"]:
                        rows.append((w["anchor"], *doc, w["lo"], raw[w["lo"] : w["hi"] + window - 1]))
                        continue
                    for at in range(w["lo"], w["hi"]):
                        part = raw[at : at + window]
                        rows.append((xxhash.xxh3_64_intdigest(part) - (1 << 63), *doc, at, part))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECE.split(", ")])
                            rows = []
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECE.split(", ")])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECE.split(", ")])

    return run


def repeated_windows(pieces: list[bytes], window: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to): runs of window starts whose window starts at two places of the pieces at least."""
    shards: list[list[bytes]] = [[]]
    held = 0
    for p in pieces:
        if held + len(p) > shard and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(p)
        held += len(p)
    transforms, places, start = [], [], 0
    for s in shards:
        t, at = transform(np.frombuffer(b"".join(s), np.uint8), window)
        transforms.append(t)
        places.append(at + start)
        start += len(t)
    order, common = merge(transforms, window)
    place = np.concatenate(places)[order]
    ends = np.cumsum([len(p) for p in pieces])
    owner = np.searchsorted(ends, place, "right")
    valid = place + window <= ends[owner]
    interval = np.cumsum(common < window) - 1
    often = np.bincount(interval, weights=valid)[interval] > 1
    found = np.zeros(start + 1, bool)
    found[place[valid & often]] = True
    edge = np.flatnonzero(found[:-1] & ~np.concatenate([[False], found[:-2]]))
    stop = np.flatnonzero(found[:-1] & ~found[1:]) + 1
    # a run ends with its piece: the last `window - 1` starts of a piece are never valid
    piece = np.searchsorted(ends, edge, "right")
    base = ends[piece] - np.array([len(p) for p in pieces])[piece]
    return piece, edge - base, stop - base


def _merge_pieces(window: int, hot_bytes: int):
    """PIECE rows sorted by key to MARK rows; all pieces of a key meet in one merge, or else are equal windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        rows: list[tuple] = []
        held, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            piece, lo, hi = repeated_windows(pieces, window)
            if len(piece):
                base = np.array([r[2] for r in rows], np.int64)[piece]
                own = [[rows[i][c] for i in piece.tolist()] for c in (0, 1)]
                columns = [pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), pa.array(lo + base, pa.int32()), pa.array(hi + base, pa.int32()), pa.nulls(len(piece), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "lo", "hi", "anchor"])

        for batch in batches:
            for key, doc_id, tie, lo, raw in zip(*(batch.column(c.split()[0]).to_pylist() for c in PIECE.split(", "))):
                if held >= ENOUGH and key != last or held + len(raw) > MOST:
                    yield from flush()
                    # within a key all pieces are one window: the next ones only need one of them beside them
                    same = key == last
                    pieces, rows = ([pieces[-1]], [rows[-1]]) if same else ([], [])
                    held = sum(map(len, pieces))
                last = key
                pieces.append(raw)
                rows.append((doc_id, tie, lo))
                held += len(raw)
        if pieces:
            yield from flush()

    return run


def _drop(window: int):
    """(doc_id, text, marks) to (doc_id, n_bytes, n_removed, n_spans, kept)."""
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [None, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, marks in zip(part.column("text"), part.column("marks")):
                    raw = (text.as_py() or "").encode()
                    spans: list[list[int]] = []
                    if marks.is_valid:
                        lo, hi = (marks.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
                        _, lo, hi = _ranges(np.zeros(len(lo), np.int64), lo, hi + window - 1)
                        spans = list(zip(lo.tolist(), hi.tolist()))
                    cut = [0, *(x for s in spans for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2]))
                    rows.append((len(raw), len(raw) - len(kept), len(spans), kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], names)

    return run


def _of_rows(docs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """docs with the rows of found that have their doc_id and tie, as they are; both uses share one shuffle of the texts."""
    right = found.withColumnsRenamed({c: f"__{c}" for c in ROW}).hint("shuffle_hash")
    return docs.join(right, docs["doc_id"].eqNullSafe(right["__doc_id"]) & (docs["tie"] == right["__tie"]), "left").select(*ROW, "text", column)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs."""
    if not 8 <= gram <= window:
        raise ValueError("an anchor has 8 bytes at least and fits in a window")
    docs = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    found = docs.mapInArrow(_find(window, gram), PASSAGE).repartition("anchor").sortWithinPartitions("anchor", "content")
    marks = stage(found.mapInArrow(_recur, MARK), "marks")
    needed = marks.where(F.col("anchor").isNotNull())
    hot = needed.groupBy("anchor").agg(F.sum(F.col("hi") - F.col("lo") + window - 1).alias("bytes")).where(F.col("bytes") > min(hot_bytes, MOST - ENOUGH)).select("anchor", F.lit(True).alias("hot"))
    wanted = needed.join(hot, "anchor", "left").groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    pieces = _of_rows(docs, wanted, "wanted").mapInArrow(_cut_out(window), PIECE)
    merged = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_merge_pieces(window, hot_bytes), MARK)
    ranges = marks.where(F.col("anchor").isNull()).unionByName(merged).groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    return _of_rows(docs, ranges, "marks").mapInArrow(_drop(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select r, b, h[2 * b + 1:2 * b + {2 * (500 + WINDOW - 1)}] as part from d, unnest(range(0, length(h) // 2 - {WINDOW - 1}, 500)) as u(b)),
w as (select r, b + i as i, md5(part[2 * i + 1:2 * i + {2 * WINDOW}]) as m from b, unnest(range(0, length(part) // 2 - {WINDOW - 1})) as u(i)),
often as (select m from w group by m having count(*) > 1),
hit as (select r, i from w semi join often using (m)),
mark as (select r, i, i > coalesce(lag(i) over (partition by r order by i) + {WINDOW}, -1) as new from hit),
span as (select r, n, min(i) as lo, max(i) + {WINDOW} as hi from (select r, i, sum(new::int) over (partition by r order by i) as n from mark) group by r, n),
cut as (select r, n, lo, hi, coalesce(lag(hi) over (partition by r order by n), 0) as since from span),
part as (select r, n, h[2 * since + 1:2 * lo] as h, hi - lo as gone from cut join d using (r)
         union all select r, 1e9, h[2 * coalesce(m, 0) + 1:], 0 from d left join (select r, max(hi) as m from span group by r) using (r)),
k as (select r, string_agg(h, '' order by n) as h, sum(gone)::bigint as gone, count(*) - 1 as spans from part group by r)
select doc_id, length(d.h)::bigint // 2 as n_bytes, gone as n_removed, spans as n_spans, sha256(unhex(k.h)) as kept_sha256 from d join k using (r)
"""
