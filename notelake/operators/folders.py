"""Paths of folders from the root down, with tables that grow with the folders and not with their paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.scratch import Rounds, staged

#: Folders in a range of ids, which one task walks through.
RANGE = 50_000
#: Titles that a task gives back at once.
CELLS = 1 << 20


def _group(table: pa.Table, every: bool) -> Iterator[pa.RecordBatch]:
    """One range: rows with titles are folders (one title each, and `next`) or paths known already (`done`, root first).

    Gives (id, next, path, cyclic) of every folder that is in no circle; or of those that rows without titles ask for, and
    then of those in or below circles too, without a path. next: what the path goes on with, outside the range.
    """
    titles = table.column("titles").combine_chunks()
    valid = titles.is_valid()
    known, asked = table.filter(valid), table.filter(pc.invert(valid)).column("id").to_pylist()
    sizes = known.column("titles").combine_chunks().value_lengths().to_numpy()
    words = known.column("titles").combine_chunks().flatten()
    ids, nexts, done, circles = (known.column(c).to_pylist() for c in ("id", "next", "done", "cyclic"))
    # each title is a place; that of a row is its last one, whose way up leads through its other ones
    place = np.cumsum(sizes) - 1
    at = dict(zip(ids, place.tolist()))
    up = np.arange(len(words)) - 1
    up[place - sizes + 1] = [at.get(x, -1) for x in nexts]
    bad = np.zeros(len(words), bool)
    bad[place] = circles
    # length of the way up and its end, by doubling; who is still on the way after as many steps as there are places is in a circle
    far, steps = up.copy(), np.ones(len(words), np.int64)
    end = np.arange(len(words))
    for _ in range(len(words).bit_length() + 1):
        go = far >= 0
        bad[go] |= bad[far[go]]
        end[go] = end[far[go]]
        steps[go] += steps[far[go]]
        far[go] = far[far[go]]
    bad |= far >= 0
    out_of = dict(zip(place.tolist(), nexts))
    kind, names = table.schema.field("id").type, ["id", "next", "path", "cyclic"]
    own = [(x, p) for x, p, d in zip(ids, place.tolist(), done) if not d]
    if not every:
        if circled := [x for x, p in own if bad[p]]:
            n = len(circled)
            yield pa.RecordBatch.from_arrays([pa.array(circled, kind), pa.nulls(n, kind), pa.array([[]] * n, pa.list_(pa.string())), pa.array([True] * n)], names)
        own = [(x, at[x]) for x in asked]
    own = [(x, p) for x, p in own if not bad[p]]
    name, mine = [x for x, _ in own], np.array([p for _, p in own], np.int64)
    total = np.cumsum(steps[mine])
    lo = 0
    while lo < len(mine):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CELLS, "right")))
        now, length = mine[lo:hi], steps[mine[lo:hi]]
        stop = np.cumsum(length)
        cells = np.empty(int(stop[-1]), np.int64)
        to = stop - 1
        while len(now):
            cells[to] = now
            now, to = up[now], to - 1
            stay = now >= 0
            now, to = now[stay], to[stay]
        path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), words.take(pa.array(cells)))
        beyond = [out_of.get(e) for e in end[mine[lo:hi]].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(name[lo:hi], kind), pa.array(beyond, kind), path, pa.array(np.zeros(hi - lo, bool))], names)
        lo = hi


def _walk(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and part[a] != last:
                    yield from _group(pa.Table.from_batches(held), every)
                    held = []
                last = part[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _group(pa.Table.from_batches(held), every)

    return run


def hierarchy(folders: DataFrame, size: int = RANGE) -> DataFrame:
    """folders (id, parent_id, title) to (id, path): titles from the root down, whatever the depth.

    Folders are cut into ranges of about `size` ids, and each way up is walked within its range in one task. Only the
    folders that another range's ways enter by are joined with each other: their paths double in rounds (_doubled). In the
    end every range gets the paths that its ways go on with, and whole paths are made row by row and never written here.
    Where parents have ids near those of their folders, as exports number them, few folders are entered; where ids are
    random nearly all are, and their paths are written in each round.

    A missing parent ends a path. A path that meets a folder for the second time is in a cycle and ends before it: folders
    below or in cycles are left to _doubled alone. Of folders with one id the one with the smallest parent_id and title
    counts, null first; a null id is no folder.
    """
    one = folders.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("parent_id", "title")).alias("f"))
    one = staged(one.select("id", F.col("f.parent_id").cast(folders.schema["id"].dataType).alias("next"), "f.title"), "folders")
    parts = one.count() // size + 1
    ranged = staged(one.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranges")
    kind = folders.schema["id"].dataType.simpleString()
    shape = f"id {kind}, next {kind}, path array<string>, cyclic boolean"
    no = F.lit(False)
    none = F.lit(None).cast("array<string>")

    def row(next_: Column, titles: Column, done: Column, cyclic: Column) -> list:
        return ["part", "id", next_.cast(kind).alias("next"), titles.alias("titles"), done.alias("done"), cyclic.alias("cyclic")]

    def walked(more: DataFrame, every: bool) -> DataFrame:
        rows = ranged.select(*row(F.col("next"), F.array("title"), no, no)).unionByName(more)
        return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_walk(every), shape)

    ends = ranged.groupBy("part").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    outside = ranged.join(F.broadcast(ends), "part").where((F.col("next") < F.col("lo")) | (F.col("next") > F.col("hi")))
    outside = staged(outside.select("part", F.col("next").alias("id")).distinct(), "outside")
    entered = staged(ranged.select("part", "id").join(outside.select("id").distinct(), "id", "left_semi"), "entered")
    ways = staged(walked(entered.select(*row(F.lit(None), none, no, no)), False), "ways")
    # of one that is in a circle no path is needed, only that it is one
    nothing = F.array(F.lit(None).cast("string"))
    done = _doubled(ways.select("id", "next", F.array("id").alias("ids"), F.when(F.col("cyclic"), nothing).otherwise(F.col("path")).alias("titles"), "cyclic"), True)
    known = outside.join(done.select("id", "titles", "cyclic"), "id").select(*row(F.lit(None), F.col("titles"), F.lit(True), F.col("cyclic")))
    paths = walked(known, True).select("id", "path")
    below = not done.where("cyclic").isEmpty()
    circles = staged(walked(known, False).where("cyclic").select("id"), "circles") if below else ways.where("cyclic").select("id")
    if not below:
        return paths
    rest = one.join(circles, "id", "left_semi").select("id", "next", F.array("id").alias("ids"), F.array("title").alias("titles"), no.alias("cyclic"))
    return paths.unionByName(_doubled(rest, False).select("id", F.col("titles").alias("path")))


def _doubled(start: DataFrame, mark: bool) -> DataFrame:
    """(id, next, ids, titles, cyclic): each path on to where it ends; ids from the folder up, titles from the root down.

    Each round joins every open path with the path of the folder it ends at, so paths double, each round staged. A path
    that meets an id for the second time is cut before it, or, by `mark`, ends there as cyclic with what goes on to it.
    """
    rounds = Rounds(start.sparkSession, "folders")
    up = rounds.put(start)
    while not (going := up.where(F.col("next").isNotNull())).isEmpty():
        higher = up.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("ids").alias("more_ids"), F.col("titles").alias("more"), F.col("cyclic").alias("circle"))
        x = going.join(higher, "next", "left").select(
            "id", "further", F.concat("ids", F.coalesce("more_ids", F.array().cast(up.schema["ids"].dataType))).alias("ids"),
            F.concat(F.coalesce("more", F.array().cast("array<string>")), "titles").alias("titles"), (F.col("cyclic") | F.coalesce("circle", F.lit(False))).alias("cyclic"),
        )
        # both halves are free of repeats; the first id of the second half that the first one has closes the cycle
        again = F.size(F.array_distinct("ids")) < F.size("ids")
        stops = F.lit(None).cast(up.schema["next"].dataType)
        if mark:
            circle = again | F.col("cyclic")
            whole = x.select("id", F.when(~circle, F.col("further")).alias("next"), F.when(circle, F.array("id")).otherwise(F.col("ids")).alias("ids"), F.when(circle, F.array(F.lit(None).cast("string"))).otherwise(F.col("titles")).alias("titles"), circle.alias("cyclic"))
            up = rounds.put(up.where(F.col("next").isNull()).unionByName(whole))
            continue
        whole = x.where(~again).select("id", F.col("further").alias("next"), "ids", "titles", "cyclic")
        at = F.posexplode("ids").alias("at", "step")
        first = x.where(again).select("id", at).groupBy("id", "step").agg(F.sort_array(F.collect_list("at")).alias("at")).where(F.size("at") > 1).groupBy("id").agg(F.min(F.col("at")[1]).cast("int").alias("stop"))
        cut = x.where(again).join(first, "id").select("id", stops.alias("next"), F.slice("ids", 1, F.col("stop")).alias("ids"), F.slice("titles", F.size("titles") - F.col("stop") + 1, F.col("stop")).alias("titles"), "cyclic")
        up = rounds.put(up.where(F.col("next").isNull()).unionByName(whole).unionByName(cut))
    return up
