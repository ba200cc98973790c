"""The training-data operators against brute force, on a small table with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import bisect
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import chat, exact_dedup, fingerprints, mixing, near_dedup, packing, quality, repeats, toxicity, warc
from notelake.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n long"


def _corpus() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(150)
    texts = [None, "", "   \n", "One", "ONE", "one two", "É one", "é one", "x" * 5000, "same " * 300, text(3000)]
    texts += [text(rng.randint(1, 120)) for _ in range(40)]
    texts += [f"{text(30)}\n{passage}  {text(25)}" for _ in range(12)]
    for _ in range(15):
        words = base.split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [base, base.upper(), base] + [texts[-1]] * 3
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", None]), len(t or ""), "x", "y", 7) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, and ids with equal and with different texts."""
    rows = [(None, "a b c d e f", "en", "src1", 11), (None, None, None, None, None), (3, "a b c d e f", "en", "src1", 11), (3, "a b c d e f", "en", "src1", 11)]
    rows += [(3, "another text x", "de", "src0", 14), (None, "another text x", None, "src2", 14), (5, "", "en", "", 0)]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def _sql(sql: str, **tables) -> pd.DataFrame:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()


def _same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    one = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    rows = lambda d: sorted(str([one(v) for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def _frame(rows) -> pa.Table:
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], pa.int64() if c.endswith("long") else pa.string()) for i, c in enumerate(SCHEMA.split(", "))})


# ---- 1


def test_mixture_equals_sql(docs, rows, empty, odd):
    got = mixing.mix(mixing.token_counts(docs), F.expr("total div 2")).toPandas()
    _same(got, _sql(mixing.OP1_SQL, documents=_frame(rows)))
    assert mixing.mix(mixing.token_counts(empty), F.expr("total div 2")).count() == 0
    assert mixing.mix(mixing.token_counts(odd), F.expr("total")).count() >= 3


def test_shortage_goes_to_siblings_first(spark):
    tokens = spark.createDataFrame([(i, "web", "en", "a", 10) for i in range(2)] + [(i + 10, "web", "en", "b", 10) for i in range(50)] + [(i + 100, "books", "en", "c", 10) for i in range(50)], "doc_id long, domain string, lang string, source string, tokens long")
    got = {r.source: r.share for r in mixing.leaf_budgets(tokens, F.lit(300), 1, {"domain": {"web": 1, "books": 1}}).collect()}
    assert got == {"a": 20, "b": 130, "c": 150}
    taken = mixing.mix(tokens, F.lit(300), 1, {}, digits=1)
    assert {r.source: r.t for r in taken.groupBy("source").agg(F.sum("tokens").alias("t")).collect()} == got


def test_mixture_of_all_epochs(spark):
    tokens = spark.createDataFrame([(i, "web", "en", "a", 5) for i in range(7)], "doc_id long, domain string, lang string, source string, tokens long")
    got = mixing.mix(tokens, F.lit(10_000), 3)
    assert got.count() == 21 and got.select("epoch").distinct().count() == 3


# ---- 2


def test_fingerprints_estimate_weighted_jaccard(docs, rows, empty, odd):
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    ring = sorted((r[:2] for r in rows), reverse=True)
    bag = lambda t: collections.Counter(WORD.findall(t))
    like = lambda a, b: 1.0 if not (a | b) else sum((a & b).values()) / sum((a | b).values())
    errors, by_text = [], {}
    for k, (i, text) in enumerate(ring):
        text, after = text or "", ring[(k + 1) % len(ring)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - like(bag(text), bag(edited)), r.near_next - like(bag(text), bag(after))]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07 and max(map(abs, errors)) < 0.3
    assert fingerprints.edited_likeness(empty).count() == 0
    got = fingerprints.edited_likeness(odd).collect()
    assert len(got) == odd.count()
    texts = collections.defaultdict(set)
    for r in got:
        texts[r.n_chars, r.doc_id].add(r.fingerprint)
    assert texts[11, 3] == texts[11, None] and len(texts[11, 3]) == len(texts[14, 3]) == 1 and texts[11, 3] != texts[14, 3]
    twins = [r for r in got if (r.doc_id, r.n_chars) == (3, 11)]
    assert sorted(r.near_next for r in twins)[1] == 1.0  # the first of two equal rows is followed by its like


def test_fingerprints_of_long_texts(spark):
    """One word of weight m shared, m other words on each side: a third, drawn from far in the tails."""
    rows = []
    for pair in range(12):
        for side in range(2):
            words = [f"s{pair}"] * 3000 + [f"w{pair}.{side}.{i}" for i in range(3000)]
            rows.append((2 * pair + side, " ".join(words)))
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1").collect()
    assert abs(np.mean([r.near_next for r in got]) - 1 / 3) < 0.04


def test_ring(spark):
    ids = random.Random(1).sample(range(10**12), 500)
    keys = spark.createDataFrame([(i, i % 7, False) for i in ids] + [(0, 5, True)], "id long, tie long, missing boolean").repartition(4)
    got = {(r.id, r.missing): r.next_id for r in fingerprints.ring(keys).collect()}
    order = [(i, False) for i in sorted(ids, reverse=True)] + [(0, True)]
    assert got == {x: order[(k + 1) % len(order)][0] for k, x in enumerate(order)}


# ---- 3


def test_chat_equals_sql(spark):
    rng, rows = random.Random(3), []
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "a\nb", "", None])) for _ in range(rng.randint(1, 5))]
        rows += [(conv, t, *x, "extra") for t, x in enumerate(turns)]
    rows += [(None, 0, "user", "alone", ""), (None, 1, "user", "alone", ""), (99, None, "user", "hi", ""), (99, None, "user", "hi", "")]
    schema = "conv_id long, turn long, role string, text string, rendered string"
    table = pa.table({c.split()[0]: pa.array([r[i] for r in rows], pa.int64() if c.endswith("long") else pa.string()) for i, c in enumerate(schema.split(", "))})
    got = chat.format_chats(spark.createDataFrame(rows, schema).repartition(3)).toPandas()
    _same(got, _sql(chat.OP3_SQL, conversations=table))
    assert len(got) < 60
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


# ---- 4


def test_packing(docs, rows, empty, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(packing.token_pieces(docs), 2048).toPandas()
    at = {(r.doc_id, r.piece): r for r in got.itertuples()}
    n = total = 0
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, lo in enumerate(range(0, len(ids), 2048)):
            r = at[i, k]
            assert (r.start, r.length, r.ids_crc32) == (lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes()))
            n += 1
    assert n == len(got)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-total // 2048) + 1
    assert packing.pack(packing.token_pieces(empty)).count() == 0
    assert packing.pack(packing.token_pieces(odd)).select("row", "sequence_id", "offset").distinct().count() == odd.count()


def _best_fit(counts: dict[int, int], capacity: int) -> int:
    """Sequences of the same rounds, a document at a time."""
    left, gaps, sequences = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True), [], 0
    while left:
        new, rest, free = [], [], sorted(gaps)
        for x in left:
            at = bisect.bisect_left(free, x)
            if at < len(free):
                new.append(free.pop(at) - x)
            else:
                rest.append(x)
        if not new:
            take = max(-(-sum(rest) // capacity), sum(2 * x > capacity for x in rest))
            new, rest, sequences = [capacity - x for x in rest[:take]], rest[take:], sequences + len(rest[:take])
        left, gaps = rest, free + new
    return sequences


@pytest.mark.parametrize("seed", range(2))
def test_best_fit_rounds(spark, seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 20), 50]) for _ in range(600))
    runs = packing.best_fit_rounds(spark.createDataFrame(list(counts.items()), "length long, n long"), 100).collect()
    fill, placed = collections.Counter(), collections.Counter()
    for r in sorted(runs, key=lambda r: r.offset):
        for q in range(r.sequence, r.sequence + r.n):
            assert fill[q] == r.offset
            fill[q] += r.length
    for r in sorted(runs, key=lambda r: r.lo):
        assert r.lo == placed[r.length]
        placed[r.length] += r.n
    assert placed == counts and max(fill.values()) <= 100 and len(fill) == _best_fit(counts, 100)


def test_word_coder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, coder, rng = Tokenizer.from_file(path), packing.WordCoder(path), random.Random(2)
    texts = ["".join(rng.choice("abAB éÉß's!?.,-_12́ ẞΣσ<|>\n\t日İ\x1c\x85") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "ΟΔΟΣ ΑΣ", "don't dogs' it's, b'd"]
    for text, raw in zip(texts, coder.encode([t.encode() for t in texts])):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


# ---- 5 and 10


def _labelled(spark, sf: str, kind: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    run = quality.op5_quality if kind == "quality" else toxicity.op10_toxicity
    got = run(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    return got, got.merge(labels, on="doc_id")


def test_quality_held_out(spark):
    got, x = _labelled(spark, "/root/testdata/sf0.1", "quality")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    x = x[x.held_out]
    assert (x.predicted == x.quality).mean() > 0.97 and x[x.quality == 1].predicted.mean() > 0.99


def test_toxicity_held_out(spark):
    got, x = _labelled(spark, "/root/testdata/sf0.1", "toxic")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    x = x[x.held_out]
    assert x[x.toxic == 1].predicted.mean() >= 0.9 and x[x.toxic == 0].predicted.mean() < 0.02


def test_scores_of_odd_rows(spark, docs, empty):
    x = np.array([[0.0], [1.0]] * 50)
    trees = quality.fit_trees(np.repeat(x, len(quality.STATISTICS), axis=1), x[:, 0])
    assert trees.score(np.repeat(x[:2], len(quality.STATISTICS), axis=1))[1] > 0.9
    out = quality.score_quality(docs, trees)
    assert out.count() == docs.count() and out.columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert quality.score_quality(empty, trees).count() == 0
    assert quality.fit_trees(np.empty((0, len(quality.STATISTICS))), np.empty(0)).score(np.zeros((1, len(quality.STATISTICS))))[0] == 0.5
    column = pa.array(["you idiot", "nice day", None, ""] * 30)
    model = toxicity.fit(column, np.array([1, 0, 0, 0] * 30))
    score = model.score(pa.array(["an idiiot", "nice", None]))
    assert score[0] > score[1]
    assert toxicity.score_toxicity(docs, model).count() == docs.count() and toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit(pa.array([], pa.string()), np.empty(0, int)).score(pa.array(["x"]))[0] == 0.5


# ---- 6


def _repeats(rows, n: int) -> dict:
    seen, out = set(), {}
    for i, text, *_ in sorted((r for r in rows), key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            if key in seen:
                gone[a : a + n] = True
            seen.add(key)
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(20, 8, 1000), (20, 8, 3), (6, 3, 2)])
def test_repeats(docs, rows, window, gram, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, window, gram, hot).collect()}
    assert got == _repeats(rows, window)


def test_equal_passages_pass_no_automaton(monkeypatch):
    passed = []
    plain = repeats.locate_repeats
    monkeypatch.setattr(repeats, "locate_repeats", lambda held, window: passed.extend(held) or plain(held, window))
    rows = [(1, 5, 0, 2, 4, 2, "a b c d"), (1, 3, 0, 7, 4, 1, "a b c d"), (1, 3, 0, 7, 4, 1, "a b c d"), (1, 9, 0, 4, 6, 0, None), (2, 8, 0, 0, 4, 1, "e f g h"), (3, 1, 0, 0, 4, 1, "i j k l"), (3, 2, 0, 5, 4, 1, "j k l m"), (3, 4, 0, 5, 4, 1, "j k l m")]
    names = [c.split()[0] for c in repeats.PASSAGE.split(", ")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part]) for part in (rows[:2], rows[2:6], rows[6:])]
    got = sorted((r["doc_id"], r["lo"], r["hi"]) for b in repeats._locate(3)(iter(batches)) for r in b.to_pylist())
    assert got == [(2, 5, 8), (4, 5, 9), (5, 2, 6), (9, 4, 10)]
    assert sorted(p[3] for p in passed) == ["i j k l", "j k l m"]


def test_repeats_of_odd_rows(odd, empty):
    got = repeats.remove_repeats(odd, 4, 2).collect()
    assert len(got) == odd.count() and all(r.n_removed == 0 for r in got if r.doc_id is None)
    texts = {"a b c d e f": [1, 3, 3], "o p q r s t": [3], None: [2]}
    some = odd.sparkSession.createDataFrame([(i, t) for t, ids in texts.items() for i in ids], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in repeats.remove_repeats(some, 4, 2).collect()) == [(1, 0, "a b c d e f"), (2, 0, ""), (3, 0, "o p q r s t"), (3, 6, ""), (3, 6, "")]
    assert repeats.remove_repeats(empty).count() == 0


# ---- 7


def test_warc_round_trip(spark):
    page = "<html><head><title>A &amp; B</title><meta charset=utf-8></head><body><script>x</script><p>Hé<p>llo<br>w <a href='/q?a=1&amp;b'>l</a></body>"
    schema = "page_id long, url string, html string, record string"
    rows = [(1, "http://h.example/d/p", page, "x"), (2, None, None, "x"), (1, "http://h.example/d/p", page, "x")]
    got = warc.build_derivatives(warc.responses(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 6
    response = next(warc.parse_records(warc.response_record(*rows[0][:3])))
    for r in got:
        headers, block = next(warc.parse_records(bytes(r.record)))
        assert headers["warc-type"] == r.record_type and headers["warc-refers-to"] == r.refers_to and len(block) == r.content_length
        assert headers["warc-block-digest"] == r.block_digest == warc.digest(block)
        if r.page_id == 1:
            assert r.refers_to == response[0]["warc-record-id"] and r.source_payload_digest == warc.digest(page.encode())
            text = block.decode()
            assert text == "Hé\nllo\nw l" if r.record_type == "conversion" else "title: A & B\r\n" in text and "outlink: http://h.example/q?a=1&b\r\n" in text and "source-header: Content-Type: text/html; charset=utf-8\r\n" in text
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "page_id long, record binary")
    assert [r.record_type for r in warc.build_derivatives(bad).collect()] == ["error", "error"]
    assert warc.build_derivatives(warc.responses(spark.createDataFrame([], schema))).count() == 0
    assert len(list(warc.parse_records(__import__("gzip").compress(warc.response_record(1, "u", "h") * 2)))) == 2


# ---- 8


def _near(rows, n: int) -> dict:
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("shingle", "block"), [(4, 4096), (5, 4096), (4, 3)])
def test_near_duplicates(docs, rows, shingle, block):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, shingle, block=block).collect()}
    assert got == _near(rows, shingle)


def test_near_duplicates_of_large_families(spark, tmp_path, monkeypatch):
    """A common passage ties documents that are not alike, and one cluster is larger than a block: texts are not shipped once for every block."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, base = " ".join(word() for _ in range(24)), [word() for _ in range(120)]
    texts = [f"{passage} {' '.join(word() for _ in range(24))}" for _ in range(70)]
    texts += [f"{t} {word()}" for t in texts[:5]]
    for _ in range(30):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    confirm, waves = near_dedup._confirm, []

    def counted(n: int, percent: int):
        run, place = confirm(n, percent), tmp_path / str(len(waves))
        place.mkdir()
        waves.append(place)

        def count(batches):
            for batch in batches:
                (place / f"{batch.num_rows}-{random.SystemRandom().random()}").touch()
                yield batch

        return lambda batches: run(count(batches))

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, block=8, crowd=5).collect()}
    assert got == _near(rows, 4) and sum(not kept for *_, kept in got.values()) > 30
    shipped = [sum(int(p.name.split("-")[0]) for p in place.iterdir()) for place in waves]
    assert len(shipped) > 1 and max(shipped) <= 2 * len(texts) and sum(shipped) <= 4 * len(texts)


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 12])
def test_waves_take_each_distance_of_blocks_once(blocks):
    waves = list(near_dedup._waves([(blocks, 100), (1, 50)]))
    assert [d for a, b in waves for d in range(a, b)] == list(range(blocks // 2 + 1))
    for a, b in waves:
        assert sum((100 if d == 0 or 2 * d == blocks else 200) + 50 * (d == 0) for d in range(a, b)) <= 2 * 150
    assert list(near_dedup._waves([])) == [(0, 1)]


def test_likely_partners_connect_as_all_pairs_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (6, 128), dtype=np.uint16)
    signs = base[rng.integers(0, 6, 120)]
    signs = np.where(rng.random(signs.shape) < rng.uniform(0.05, 0.4, (120, 1)), rng.integers(0, 1 << 16, signs.shape, dtype=np.uint16), signs)
    size, block = rng.integers(80, 130, 120), np.zeros(120, np.int64)

    def components(pairs):
        label = np.arange(120)
        for u, v in pairs:
            label[label == label[u]] = label[v]
        return {tuple(np.flatnonzero(label == x)) for x in label}

    every = [(u, v) for u in range(120) for v in range(u) if 100 * min(size[u], size[v]) >= 80 * max(size[u], size[v]) and (signs[u] == signs[v]).mean() >= 0.8 - near_dedup.DOUBT * np.sqrt(0.16 / 128)]
    links = near_dedup._likely(size, signs, np.arange(120), block, 80)
    assert set(links) <= {*every, *((v, u) for u, v in every)} and len(links) < 120
    assert 6 < len(components(every)) < 120 and components(links) == components(every)
    assert near_dedup._likely(size, signs, np.zeros(120, np.int64), block, 80) == []


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r.kept for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in list(root)}


# ---- 9


@pytest.mark.parametrize("fit", [exact_dedup.FIT_BYTES, 12_000])
def test_exact_dedup(docs, rows, fit):
    got = exact_dedup.dedup_groups(docs, fit).toPandas()
    _same(got, _sql(exact_dedup.OP9_SQL, documents=_frame(rows)))
    stay = exact_dedup.dedup_rows(docs, fit)
    assert stay.columns == docs.columns
    assert sorted(stay.collect()) == sorted(docs.join(spark_ids(got, docs), "doc_id").select(*docs.columns).collect())


def spark_ids(got: pd.DataFrame, docs):
    return docs.sparkSession.createDataFrame([(int(i),) for i in got[got.kept].doc_id], "doc_id long")


def test_exact_dedup_of_odd_rows(odd, empty):
    got = exact_dedup.dedup_groups(odd).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == 3 and {r.keep_id for r in got if r.group_size == 3} == {3}
    assert exact_dedup.dedup_groups(empty).count() == 0 and exact_dedup.dedup_rows(empty).count() == 0


def test_content_table_compares_contents():
    table = exact_dedup.ContentTable()
    assert [table.index(7, c) for c in (b"a", b"b", b"a")] == [0, 1, 0]
    assert [table.index(i, b"%d" % i) for i in range(3000)] == list(range(2, 3002))
