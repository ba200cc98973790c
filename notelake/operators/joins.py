"""Joins of notes with files, tags, folders and links, each with the first-match rule where more than one row fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.operators.folders import hierarchy  # noqa: F401


def first_match(joined: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key, the first in order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return joined.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key, the last in order: one aggregation, combined on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


#: Bytes of short passages that are sent to all tasks at most.
SHORT_BYTES = 4 << 20


def contains_join(texts: DataFrame, passages: DataFrame, text_key: str, passage_key: str) -> DataFrame:
    """(text_key, passage_key) where text contains passage, as an equi-join.

    A word of a passage that has words on both sides is a whole word of any text that contains the passage: its longest
    such word is the key. Passages of fewer than three words have no such word; where all of them fit in SHORT_BYTES, each
    text is scanned for them once, in its row, by the pieces of exactly their lengths; more of them are joined by their
    first letters, as many as the shortest one has (8 at most).
    """
    gap = r"\s+"
    inner = F.expr("slice(w, 2, greatest(size(w) - 2, 0))")
    p = passages.select(passage_key, F.col("text").alias("passage")).where(F.col("passage") != "").withColumn("w", F.split("passage", gap)).withColumn("inner", inner)
    longest = F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    keyed = p.where(F.size("inner") > 0).select(passage_key, "passage", longest.alias("word"))
    t = texts.select(text_key, F.col("text"))
    words = t.select(text_key, F.explode(F.array_distinct(F.split("text", gap))).alias("word"))
    # candidate pairs carry no text; it is joined back for them only
    pairs = words.join(keyed.select(passage_key, "word"), "word").select(text_key, passage_key).distinct()
    found = pairs.join(t, text_key).join(keyed.select(passage_key, "passage"), passage_key).where(F.col("text").contains(F.col("passage"))).select(text_key, passage_key)
    few = p.where(F.size("inner") == 0).select(passage_key, "passage")
    n, held, least = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)), F.coalesce(F.min(F.char_length("passage")), F.lit(1))).first()
    if not n:
        return found
    if held <= SHORT_BYTES and n <= SHORT_BYTES // 64:
        each = few.groupBy("passage").agg(F.collect_list(passage_key).alias("__keys"))
        one = each.agg(F.collect_list(F.struct("passage", "__keys")).alias("l")).scalar()
        hits = t.withColumn("__few", one).select(text_key, F.explode(F.filter("__few", lambda x: F.col("text").contains(x["passage"]))).alias("x"))
        return found.unionByName(hits.select(text_key, F.explode("x.__keys").alias(passage_key)))
    size = min(least, 8)
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text") - size + 1, F.lit(1))), lambda i: F.substr("text", i, F.lit(size)))
    grams = t.select(text_key, F.explode(F.array_distinct(letters)).alias("gram"))
    pairs = grams.join(few.select(passage_key, F.substring("passage", 1, size).alias("gram")), "gram").select(text_key, passage_key).distinct()
    return found.unionByName(pairs.join(t, text_key).join(few, passage_key).where(F.col("text").contains(F.col("passage"))).select(text_key, passage_key))


def pieces_join(texts: DataFrame, words: DataFrame, text: str, word: str, *same: str) -> DataFrame:
    """Pairs with equal `same` columns where a short text contains a word: its pieces of the lengths that words have are the keys.

    Only those lengths come to the driver.
    For texts such as paths: a text of n characters makes n pieces for each length.
    """
    sizes = sorted(r[0] for r in words.select(F.char_length(word).alias("n")).where("n > 0").distinct().collect())
    each = F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"), lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))))
    return texts.withColumn("__piece", F.explode(F.array_distinct(each))).join(words.withColumnRenamed(word, "__piece"), ["__piece", *same]).withColumnRenamed("__piece", word)


def suffix_join(files: DataFrame, links: DataFrame, path: str, suffix: str, width: int) -> DataFrame:
    """Pairs whose path ends with suffix: equal last `width` characters (all of a shorter suffix), then the whole suffix.

    Only the lengths below `width` that suffixes have, at most `width` of them, come to the driver. An empty suffix fits nothing.
    """
    b = links.withColumn("__n", F.least(F.char_length(suffix), F.lit(width))).where(F.col("__n") > 0).withColumn("__k", F.expr(f"right({suffix}, __n)"))
    sizes = sorted(r[0] for r in b.select("__n").distinct().collect())
    if not sizes:
        return files.join(links, F.lit(False))
    a = files.withColumn("__n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.char_length(path) >= F.col("__n")).withColumn("__k", F.expr(f"right({path}, __n)"))
    return a.join(b, ["__n", "__k"]).where(F.col(path).endswith(F.col(suffix))).drop("__n", "__k")


def lookup_left(rows: DataFrame, others: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of the first of the others that has the same key, or nulls: metadata by path, lists by name."""
    return rows.join(first_match(others, [key], [order]).drop(order), key, "left")


def sibling_file(rows: DataFrame, files: DataFrame, name: str, *columns: str) -> DataFrame:
    """rows (dir, ...) with columns of the file of that name in the same folder, the first entry where there are several; else nulls."""
    named = files.where(F.col("name") == name).select("dir", "entry_ord", *columns)
    return rows.join(first_match(named, ["dir"], ["entry_ord"]).drop("entry_ord"), "dir", "left")


def token_contains(files: DataFrame, ids: DataFrame, path: str, id_: str, pattern: str) -> DataFrame:
    """Pairs where the path contains the id (J6, J13): ids match the pattern, so those cut out of the path are the keys.

    pattern finds ids wherever they stand, overlapping ones too.
    """
    cut = files.withColumn("__id", F.explode(F.array_distinct(F.regexp_extract_all(path, F.lit(f"(?=({pattern}))"), F.lit(1)))))
    return cut.join(ids, F.col("__id") == F.col(id_)).drop("__id")


def relative_path_join(files: DataFrame, links: DataFrame, path: str, relative: str) -> DataFrame:
    """Pairs where the path contains the relative path (J14): a relative path of folders and a name, so the name is the key."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    a, b = files.withColumn("__name", last(F.col(path))), links.withColumn("__name", last(F.col(relative)))
    return a.join(b, "__name").where(F.col(path).contains(F.col(relative))).drop("__name")


def tasks_of(tasks: Column, group: Column) -> Column:
    """The tasks of a group, in their order (J15). tasks: array<struct<group, ...>>."""
    return F.filter(tasks, lambda t: t["group"] == group)


def many_to_many(notes: DataFrame, pairs: DataFrame, tags: DataFrame, note: str, tag: str, name: str) -> DataFrame:
    """(note, tags): names of a note's tags, distinct and in order."""
    rows = notes.select(note).join(pairs.select(note, tag).distinct(), note).join(tags.select(tag, name), tag)
    return rows.groupBy(note).agg(F.sort_array(F.collect_set(name)).alias("tags"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
