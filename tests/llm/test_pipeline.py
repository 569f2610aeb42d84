import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import _util, bitpack, decontaminate, ngram_join, quality

TABLE = decontaminate.TABLE


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert new.columns == names and 0 < new.count() <= docs.count()
            docs = new
        if k == 1:
            got = ngram_join.classes(docs)
            assert got.where("doc_id <> component_id").count() == 0
        if k == 2:
            assert decontaminate.scan(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(_hits) > 0").count() == 0
    assert new.select(F.explode("doc_ids")).distinct().count() == docs.count()


# ---------------------------------------------------------------- against plain Python

RNG = random.Random(2)
WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(f"q{i}" for i in range(20))


def fixture_rows():
    good = lambda n: " ".join(RNG.choices(WORDS, k=n))
    rows = [(i, good(40), "en") for i in range(30)]
    rows += [(100 + i, rows[i][1] + " more", "en") for i in range(8)]  # near copies
    rows += [(200 + i, "buy $$$ now " * RNG.randrange(2, 9), None) for i in range(20)]  # bad ones
    rows += [(300, good(5) + " " + PASSAGE, "en"), (301, good(900) + " " + PASSAGE + " " + good(300), "en")]
    rows += [(400, None, "en"), (401, "", None), (402, " \t ", "x"), (403, "two words", "en"), (404, "two words", "en"), (405, good(9000), "en")]
    rows += [rows[0], (0, good(30), "again"), (None, good(30), "no id"), (None, None, None)]
    return rows


def plain_shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_kept(rows):
    """One text of each class that links make; the least doc_id stays."""
    rows = list(dict.fromkeys(rows))
    sets = [plain_shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return sorted((min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()))


def plain_clean(rows, items, width=13):
    out = []
    for d, text, lang in rows:
        words = (text or "").encode().translate(TABLE).split()
        hit = set()
        for item in items:
            w = item.encode().translate(TABLE).split()
            n = min(width, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(words):
            out.append((d, [w for i, w in enumerate(words) if i not in hit], lang))
    return out


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder of tables: documents with nulls, ties, repeated rows and clashing columns; benchmark; labels."""
    folder = tmp_path_factory.mktemp("world")
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for i, c in enumerate(("_score", "_hits", "_n", "piece", "ids", "n", "sid")):
        docs = docs.withColumn(c, F.lit(i))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d, int(not (t or "").startswith("buy"))) for d, t, _ in rows if d is not None and d % 3]
    spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_quality_stage(spark, world):
    folder, rows = world
    docs = _util.read(spark, folder, "documents")
    kept = corpus_pipeline.good_quality(spark, docs, folder)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert not any(t.startswith("buy") for _, t in got)
    assert [x for x in got if len(x[1]) > 60] == sorted((d or -1, t) for d, t, _ in rows if t and len(t) > 60 and not t.startswith("buy"))
    weights = quality.train(docs, _util.read(spark, folder, "labels"))
    assert [x[0] for x in got] == sorted(r.doc_id or -1 for r in quality.score(docs, weights).where("_score >= 0.5").collect())


def test_near_duplicate_stage(spark, world):
    folder, rows = world
    docs = _util.read(spark, folder, "documents")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    got = kept.collect()
    # rows without doc_id all stay, and repeated rows count once elsewhere
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == plain_kept(rows)


def test_decontamination_stage(spark, world):
    folder, rows = world
    docs = _util.read(spark, folder, "documents")
    kept = corpus_pipeline.benchmark_free(spark, docs, folder)
    assert kept.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, (r.text or "").encode().translate(TABLE).split(), r.lang) for r in kept.collect()), key=order)
    assert got == sorted(plain_clean(rows, [PASSAGE, "", ""]), key=order)


def test_whole_run(spark, world):
    folder, rows = world
    out = corpus_pipeline.run(spark, folder).collect()
    t = bitpack.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for r in out:
        for p in r.pieces:
            found.setdefault((p.doc.doc_id, p.doc.lang), []).append((p.piece, r.ids[p.offset : p.offset + p.length]))
        assert sum(p.length for p in r.pieces) == r.n_tokens <= r.capacity
    texts = {}
    for d, w, lang in plain_clean(rows, [PASSAGE, "", ""]):
        texts.setdefault((d, lang), []).append(w)
    for key, pieces in found.items():
        ids = [i for _, x in sorted(pieces) for i in x]
        assert ids[-1] == 1 and ids.count(1) == len(set(map(tuple, texts[key]))) or key[0] in (0, None)
        if key[0] == 405:
            assert len(pieces) > 1 and len(ids) == len(t.encode(b" ".join(texts[key][0]).decode(), add_special_tokens=False).ids) + 1
    ids = {d for d, _ in found}
    assert set(range(30)) <= ids and 301 in ids and not ids & {300, *range(100, 108), *range(200, 220)}


def test_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
