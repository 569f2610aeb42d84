"""Operators on small fixtures with nulls, ties, repeated rows and clashing names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import _util, chat, ctw, cws, decontaminate, merkle, ngram_join, quality, vectorbins

LONG = " ".join(f"w{i % 97}x{i}" for i in range(3000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all today"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all today"),
    (3, None), (4, ""), (5, "  \t\n "), (6, "word"), (7, LONG), (8, LONG + " end"), (9, "Größe 東京 ñandú"),
    (9, "Größe 東京 ñandú"), (None, "no id here at all"), (10, "a\\b <|im_end|> c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_scores(docs, none):
    got = ctw.score_documents(docs.withColumn("train", F.lit(True)), least_chunks=3, buckets=4, chunks_per_salt=2)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.n_known == r.n_tokens for r in rows)
    one = ctw.score_documents(docs.withColumn("train", F.lit(True)), least_chunks=1, buckets=1)
    key = lambda rs: sorted((r.doc_id or -1, round(r.score, 4), round(r.base_score, 9), r.n_tokens) for r in rs)
    assert key(rows) == key(one.collect())
    assert ctw.score_documents(none.withColumn("train", F.lit(True))).count() == 0
    untaught = ctw.score_documents(docs.withColumn("train", F.lit(False)), least_chunks=2, buckets=2)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untaught.collect())


def test_shards(docs, none):
    rows = vectorbins.shard(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for k in range(3):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((dict(ROWS)[r.doc_id] or "").encode()) + 8 for r in rows)
    assert vectorbins.shard(none, 3).count() == 0


def test_hot_group_is_divided(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same text for all").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = vectorbins.shard(df, 6, bundles=64).collect()
    sums = [sum(r["size"] for r in rows if r.shard == k) for k in range(6)]
    assert max(sums) < 1.25 * min(sums)
    assert len({(r.shard, r.slot) for r in rows}) == 900


def test_shards_against_plain_placement(spark):
    """Few groups, each a bundle of its own: the plan is that of a plain loop over groups."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "bb", "c1", "."], k=rng.randrange(1, 60))) for _ in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(160)]
    got = vectorbins.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5, bundles=1 << 20, single=1 << 20).collect()
    groups = {}
    for r in got:
        g = groups.setdefault(dict(rows)[r.doc_id], [0, 0, 0])
        for k, v in enumerate((r["size"], r.tokens, 1)):
            g[k] += v
    total = [sum(g[k] for g in groups.values()) for k in range(3)]
    share = {t: [g[k] / total[k] for k in range(3)] for t, g in groups.items()}
    left = [[1 / 5] * 3 for _ in range(5)]
    sums = []
    for t in sorted(share, key=lambda t: -sum(share[t])):
        v = share[t]
        able = [k for k in range(5) if left[k][0] >= v[0]]
        if able:
            k = max(able, key=lambda k: (sum(max(a, 0) * b for a, b in zip(left[k], v, strict=True)), -k))
        else:
            k = max(range(5), key=lambda k: (left[k][0], -k))
        left[k] = [a - b for a, b in zip(left[k], v, strict=True)]
        sums.append((k, groups[t][0]))
    shard = {}
    for r in got:
        assert shard.setdefault(dict(rows)[r.doc_id], r.shard) == r.shard  # groups stay whole
    want = sorted(sum(n for k, n in sums if k == j) for j in range(5))
    assert sorted(sum(r["size"] for r in got if r.shard == j) for j in range(5)) == want


def test_many_small_copies_stay_together(spark):
    """400 empty texts among 2,400 rows are a trifle in bytes: one shard holds them, and sizes stay equal."""
    df = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "").otherwise(F.concat(F.repeat(F.lit("word "), 20), F.col("id").cast("string"))).alias("text"))
    rows = vectorbins.shard(df, 24).collect()
    assert len({r.shard for r in rows if r.doc_id < 400}) == 1
    sums = [sum(r["size"] for r in rows if r.shard == k) for k in range(24)]
    assert max(sums) < 1.1 * min(sums)


def test_fingerprints(docs, none, spark):
    rows = cws.compare(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint == by[5].fingerprint
    assert by[2].near_next == 1.0 and by[8].near_next > 0.9
    order = sorted({(d, t or "") for d, t in ROWS if d is not None}, reverse=True) + [(None, "no id here at all")]
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        m = len(t) // 2
        assert by[d].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
    assert cws.compare(none).count() == 0
    assert cws.compare(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first().near_next == 1.0


def test_classes(docs, none, spark):
    rows = {(r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.classes(docs, least_buckets=2, block=2).collect()}
    comp = {d: c for d, c, _ in rows}
    assert comp[2] == comp[1] == 1 and comp[8] == comp[7] == 7 and comp[3] == 3 and comp[4] == 4 and comp[None] is None
    assert ngram_join.classes(none).count() == 0
    kept = ngram_join.dedupe(docs.withColumn("_turn2", F.lit(1)))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 9, 10]


def test_large_component_in_blocks(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(base[: 59 - k % 3] + [f"e{k}"])) for k in range(40)] + [(99, "something else entirely is here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.classes(df, least_buckets=3, block=7).collect()}
    assert all(got[k] == 0 for k in range(40)) and got[99] == 99


def test_frequent_shingle_in_pairs_of_blocks(spark):
    rng = random.Random(5)
    kinds = [rng.sample([f"v{i}" for i in range(20)], 8) for _ in range(30)]
    texts = {k: [*kinds[k % 30], f"own{k}"] for k in range(60)}
    near = lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
    want = {k: min(j for j in texts if near(texts[j], texts[k])) for k in texts}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    for most in (2, 4, 8192):
        got = {r.doc_id: r.component_id for r in ngram_join.classes(df, width=1, least_buckets=3, most=most).collect()}
        assert got == want and sum(got[k] == k for k in got) == 30


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(5, "quick brown fox jumps over the lazy dog and runs away from it all"), (50, None), (6, "word")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.scan(docs, bench)).collect()}
    assert got[1].contaminated and got[1].n_hit == 14 and got[6].contaminated and not got[3].contaminated and got[3].n_words == 0
    assert got[1].items_sha256 == hashlib.sha256(b"5").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    parts = decontaminate.report(decontaminate.scan(docs, bench, block_bytes=20))
    assert sorted(map(str, parts.collect())) == sorted(map(str, decontaminate.report(decontaminate.scan(docs, bench)).collect()))
    named = bench.withColumn("item_id", F.concat(F.lit("item "), "item_id"))
    assert {r.items_sha256 for r in decontaminate.report(decontaminate.scan(docs, named)).collect() if r.doc_id == 1} == {hashlib.sha256(b"item 5").hexdigest()}
    kept = decontaminate.clean(docs.withColumn("n_chars", F.length("text")), bench)
    assert kept.count() == len(ROWS) - 3
    assert decontaminate.scan(docs, bench.limit(0)).where("size(_hits) > 0").count() == 0
    assert decontaminate.scan(none, bench).count() == 0


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (-1, 0, "user", hard), (-1, 1, "assistant", hard), (1, 0, "system", "s" * 50), (2, 0, "system", "only"), (3, None, None, None),
        (3, 0, "odd\\n\nrole", "a\\|b\\\\"), (3, 1, "assistant", ""), (None, 0, "assistant", "x\\"), (4, 0, "assistant", "<"), (4, 0, "assistant", "<"),
    ] + [(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "é|<\\" * (i * 7 % 40)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, budget=200, history=40)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    conv = {}
    for c, t, role, text in rows:
        conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    spans = out.where("conv_id = 1").orderBy("window").collect()
    assert len(spans) > 3 and all(w.text.startswith("<|im_start|>system") for w in spans) and all(w.repeated >= 1 for w in spans[1:]) and any(w.repeated > 1 for w in spans)
    assert all(w.tokens <= 200 for w in spans)
    assert chat.windows(df.limit(0)).count() == 0


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (6, None), (None, 1), (1, 1)], "doc_id long, quality int")
    w = quality.train(docs, labels, bits=10)
    got = {r.doc_id: r._score for r in quality.score(docs, w, bits=10).collect()}
    assert got[1] > 0.5 > got[8] and all(0 < v < 1 for v in got.values()) and len(got) == len({d for d, _ in ROWS})
    blank = quality.train(docs, labels.limit(0), bits=10)
    assert {r._score for r in quality.score(docs, blank, bits=10).collect()} == {0.5}
    assert quality.score(none, w, bits=10).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}" * (i % 5 + 1)) for i in range(300)] + [(None, None, None), (7, "http://x/7", "<p>7" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = merkle.archive(pages, segment=64)
    assert a.count() == len(rows)
    for seg in a.orderBy("position").collect():
        assert len(seg.record) == seg.length
    assert merkle.audit(a, a, fanout=4).count() == 0
    bad = a.where("position <> 17").withColumn("record", F.when(F.col("position") == 200, F.concat(F.lit(b"X"), F.expr("substring(record, 2)"))).when(F.col("position") == 41, F.expr("substring(record, 1, 10)")).otherwise(F.col("record")))
    got = {(r.position, r.fault) for r in merkle.audit(a, bad, fanout=4).collect()}
    assert got == {(17, "missing"), (41, "truncated"), (200, "altered")}
    assert merkle.audit(a, a.limit(0), fanout=4).count() == len(rows)
    empty = merkle.archive(pages.limit(0))
    assert merkle.audit(empty, empty).count() == 0


def test_warc_files(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>" + "é" * (i % 7) + str(i)) for i in range(200)] + [(None, None, None), (7, "http://x/7", "<p>7"), (7, "http://x/7", "<p>7"), (900, "u", "x" * 300_000)]
    stored = merkle.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=64)
    folders = [f"file://{tmp_path}/{k}" for k in "ab"]
    for folder in folders:
        merkle.write_files(stored, folder)
    names = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert names == [f"segment-{k:08d}.warc" for k in range(4)]
    # a plain reader by headers alone finds every record, with an id of its own and a date
    seen = []
    for name in names:
        data, at = (tmp_path / "a" / name).read_bytes(), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            block = rest[:n]
            assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Date"] and rest[n : n + 4] == b"\r\n\r\n"
            assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            seen.append((fields["WARC-Record-ID"], block.partition(b"\r\n\r\n")[2].decode()))
            at += len(head) + 4 + n + 4
    assert sorted(b for _, b in seen) == sorted(h or "" for _, _, h in rows) and len({i for i, _ in seen}) == len(rows)
    a, b = (merkle.read_files(stored, f) for f in folders)
    assert merkle.audit(stored, a, fanout=4).count() == 0
    third = tmp_path / "b" / names[2]
    third.write_bytes(third.read_bytes()[:-3])
    first = bytearray((tmp_path / "b" / names[0]).read_bytes())
    first[500] ^= 1
    (tmp_path / "b" / names[0]).write_bytes(first)
    (tmp_path / "b" / names[3]).unlink()
    hurt = {r.position for r in stored.where("segment = 0 and start <= 500 and start + length > 500").collect()}
    got = {(r.position, r.fault) for r in merkle.audit(stored, b, fanout=4).collect()}
    assert got == {(p, "altered") for p in hurt} | {(191, "truncated")} | {(p, "missing") for p in range(192, len(rows))}


def test_stages_keep_columns_of_any_name(docs, none, spark):
    extra = ["_score", "_turn", "_hits", "_items", "_n_words", "n", "sid", "component_id", "_s"]
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    item = spark.createDataFrame([(1, "an item that no document holds")], "item_id long, text string")
    weights = quality.train(docs, docs.limit(0).select("doc_id", F.lit(1).alias("quality")))
    for f in (ngram_join.dedupe, lambda d: decontaminate.clean(d, item), lambda d: quality.accept(d, weights)):
        got = f(wide)
        assert got.columns == wide.columns
        assert all(tuple(r)[2:] == tuple(range(len(extra))) for r in got.collect())


def test_only_texts_with_a_kept_copy_go(spark):
    """Rows without id stay; of one id, a text without a copy stays when another text has one."""
    rows = [(None, "one and the same text"), (None, "one and the same text"), (None, None), (4, "one and the same text"), (4, "another text with this id")]
    got = ngram_join.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in got) == sorted((d is None, t or "") for d, t in rows)
    rows = [(1, "a copied text of some words"), (2, "a copied text of some words"), (2, "a wholly other text"), (2, "a wholly other text"), (1, "A copied text of some words"), (5, ""), (5, ""), (5, None), (6, " ")]
    wide = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = ngram_join.dedupe(wide).collect()
    assert sorted((r.doc_id, (r.text or "").lower(), r.text is None) for r in got) == [(1, rows[0][1], False), (2, rows[2][1], False), (5, "", False), (5, "", True), (6, " ", False)]


def test_component_in_blocks_by_bytes(spark):
    base = [f"t{i}" for i in range(80)]
    rows = [(k, " ".join(base[: 79 - k % 3] + [f"e{k}"])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.component_id for r in ngram_join.classes(df, least_buckets=3, block_bytes=30_000).collect()}
    assert got == {0}


def test_totals_in_parts(spark):
    df = spark.createDataFrame([(7, i) for i in range(500)] + [(i, i) for i in range(20)], "k long, v long")
    got = _util.with_total(df, "k", "v", F.count("*"), F.sum("_p"), "n").collect()
    assert len(got) == 520 and all(r.n == (501 if r.k == 7 else 1) for r in got)
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, 999) for i in range(400, 700)] + [(10_000, 10_001)], "a long, b long")
    roots = {r.node: r.root for r in _util.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(300)) and all(roots[i] == 400 for i in [*range(400, 700), 999]) and roots[10_001] == 10_000


@pytest.fixture(scope="module")
def long(spark):
    """One text of two megabytes, a copy of it with a few other words, and a short one."""
    words = [f"w{i % 9973}x{i % 7}" for i in range(300_000)]
    return spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-3], "three", "other", "words"])), (3, "short one")], "doc_id long, text string")


def test_very_long_texts(long, spark):
    scored = {r.doc_id: r for r in ctw.score_documents(long.withColumn("train", F.lit(True)), least_chunks=2, buckets=8).collect()}
    assert scored[1].n_tokens == 300_001 and 0 < scored[1].bits_per_byte < scored[3].bits_per_byte
    assert {r.doc_id: r.component_id for r in ngram_join.classes(long, least_buckets=2).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in ngram_join.dedupe(long).collect()} == {1, 3}
    bench = spark.createDataFrame([(7, "three other words"), (8, " ".join(f"w{i}x{i % 7}" for i in range(500, 520)))], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(decontaminate.scan(long, bench)).collect()}
    assert found[1][0] == 300_000 and found[2][2] == 2 and found[2][1] == found[1][1] + 3 and found[3] == (2, 0, 0)
    assert {r.doc_id: r.shard for r in vectorbins.shard(long, 2).collect()}.keys() == {1, 2, 3}
    weights = quality.train(long, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int"), bits=12)
    assert {r.doc_id: r._score > 0.5 for r in quality.score(long, weights, bits=12).collect()} == {1: False, 2: False, 3: True}
    turns = long.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    row = chat.read_back(chat.windows(turns)).first()
    assert row.n_turns == 3 and row.loss_chars == sum(len(r.text) for r in long.collect())


def test_extra_columns_of_any_name(docs):
    names = ["train", "chunk", "vals", "_id", "_h", "_text", "_sig", "size", "shard", "sid", "h", "bucket", "_tie", "turns", "idx"]
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    assert cws.compare(wide).count() == vectorbins.shard(wide, 2).count() == ngram_join.classes(wide, least_buckets=2).count() == len(ROWS)
    assert ctw.score_documents(wide.withColumn("train", F.lit(True)), least_chunks=2, buckets=4).count() == len(ROWS)
    turns = wide.select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"))
    assert chat.windows(turns).count() == len({d for d, _ in ROWS})
