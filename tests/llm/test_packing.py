"""Token ids: packed files, the tokenizer guard, and best-fit bins that hold the documents' ids."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lattica.llm import _util, bestfit, bitpack

RNG = np.random.default_rng(9)
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 97}x{i}" for i in range(9000))
ROWS = [(1, "the quick brown fox"), (2, None), (3, ""), (4, LONG), (4, "twice the same id"), (5, "Größe 東京 ñandú"), (5, "Größe 東京 ñandú"), (None, "no id"), (-(1 << 63), "least id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def wanted(text):
    return [*bitpack.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 1]


# ---------------------------------------------------------------- packed files

def test_files_hold_all_ids_and_read_ranges(docs, spark):
    files = bitpack.encode(docs, PATH, file_ids=50)
    rows = files.orderBy("part", "seq").collect()
    assert len(rows) > 1 and sum(r.n_docs for r in rows) == len(ROWS)
    found = []
    for r in rows:
        assert r.path.endswith(".ltbp")
        asked = []
        p = bitpack.Packed.open(r.path)
        whole, read = p.ids(), p.read
        p.read = lambda at, n, read=read, asked=asked: asked.append(n) or read(at, n)
        for k in range(p.docs):
            one = p.document(k)
            assert (one == whole[int(p.starts[k]) : int(p.starts[k + 1])]).all()
            found.append((p.doc_ids[k], one.tolist()))
        if p.docs > 1:
            assert max(asked) <= 2 * (-(-len(p.document(0)) // p.block) + 1) * p.block * p.bits // 8 or p.docs
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(((d, wanted(t)) for d, t in ROWS), key=key)
    assert [d for d, _ in found] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))


def test_decoded_rows(docs):
    got = sorted(map(tuple, bitpack.decode(bitpack.encode(docs, PATH, file_ids=50)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    crc = Counter(zlib.crc32(np.array(wanted(t), "<u4").tobytes()) for _, t in ROWS)
    assert Counter(r[3] for r in got) == crc


def test_other_tokenizers_are_not_taken_for_word_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bitpack.parts_at_blanks(bitpack.tokenizer(PATH)) and not bitpack.parts_at_blanks(bitpack.tokenizer(path))
    with pytest.raises(ValueError, match="words in turn"):
        bitpack.Words(path, by_words=True)
    texts = ["Two  words, ONE", " x\n\ty"]
    t = bitpack.tokenizer(path)
    for text, raw in zip(texts, bitpack.Words(path).encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


HARD = [
    "It's 12ab, foo.bar %%% x's y'll", "ÀÉ ΟΔΟΣ é İstanbul ﬁ", "a<|endoftext|>b <|startoftext|>", "क़ ab.c, ..", "x" * 300, "", "   ", "^ a^b ^^ ~", "e\u0301. e\u0301 Å",
    "end. end, end., end.,. end... e. .e .,. '. a'. 's. it's. … x…. 7. 7,", "\u00a0a\u2003b\u0085c", "tab\tnew\nline\vv\fform\rcr", "ß.ẞ, ǅ ŉ", "\x00a \x7f.",
]


def check_words(texts):
    t = bitpack.tokenizer(PATH)
    for text, got in zip(texts, bitpack.Words(PATH).encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_words_match_whole_texts(monkeypatch):
    check_words(HARD)
    check_words(HARD * 3)
    monkeypatch.setattr(bitpack, "PIECE", 7)  # texts parted at every blank, long words alone
    check_words(HARD)
    monkeypatch.setattr(bitpack, "CACHE_WORDS", 3)  # a table that is emptied all the time
    check_words(HARD)


def test_words_with_one_hash_are_told_apart(monkeypatch):
    bitpack.Words(PATH).known.clear()
    monkeypatch.setattr(bitpack, "_powers", lambda: ((np.zeros(256, np.uint64), np.ones(1 << 12, np.uint64), np.ones(1 << 12, np.uint64)),) + bitpack_powers()[1:])
    check_words(["one two three", "four one", "two"])
    bitpack.Words(PATH).known.clear()


def bitpack_powers(kept=bitpack._powers):
    return kept()


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = np.random.default_rng(seed)
    signs = list("abcXYZ.,'^~ 09 \t\n-éÉßİσΣ…ñ中")
    check_words(["".join(rng.choice(signs, int(rng.integers(0, 80)))) for _ in range(60)])


# ---------------------------------------------------------------- best fit

def plain_best_fit(lengths, sizes, overhead):
    """Item by item, as the method says, without groups of equal bins or searches; of bins with equal
    room the one filled last."""
    left = sorted(lengths, reverse=True)
    made = []
    while left:
        n = left[0]
        open_ = [b for b in made if b["size"] - sum(b["items"]) >= n]
        if open_:
            b = min(open_, key=lambda b: (b["size"] - sum(b["items"]), -b["turn"]))
        else:
            best = None
            for c in sizes:
                if c < n:
                    continue
                room, held = c - n, n
                for m in left[1:]:
                    if m <= room:
                        room, held = room - m, held + m
                if best is None or (c + overhead) / held < best[0]:
                    best = ((c + overhead) / held, c)
            b = {"size": best[1], "items": []}
            made.append(b)
        b["items"].append(left.pop(0))
        b["turn"] = len(left) * -1
    return sorted((next(c for c in sizes if c >= sum(b["items"])), *sorted(b["items"])) for b in made)


@pytest.mark.parametrize("seed", range(12))
def test_plan_of_distinct_lengths_is_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(1, 256), int(rng.integers(1, 90)), replace=False).tolist()
    groups = bestfit.plan(Counter(lengths), (32, 64, 128, 256), 3)
    got = sorted((g.size, *sorted(n for n, _, _ in g.items)) for g in groups)
    assert all(g.bins == 1 for g in groups)
    assert got == plain_best_fit(lengths, (32, 64, 128, 256), 3)


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_repeated_lengths_is_as_good(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(256, rng.geometric(0.03, 300)).tolist()
    groups = bestfit.plan(Counter(lengths), (32, 64, 128, 256), 3)
    assert Counter({n: c for n, c in Counter(lengths).items()}) == sum((Counter({n: g.bins}) for g in groups for n, _, _ in g.items), Counter())
    room = sum(g.size * g.bins for g in groups)
    plain = sum(b[0] for b in plain_best_fit(lengths, (32, 64, 128, 256), 3))
    assert room <= 1.02 * plain


def test_many_lengths_without_a_prefix():
    """Far more lengths than any window: the last of them count in the choice of a size."""
    lengths = list(range(1, 8193))
    groups = bestfit.plan(dict.fromkeys(lengths, 1))
    assert sorted(n for g in groups for n, _, _ in g.items) == lengths
    assert sum(g.used for g in groups) / sum(g.size * g.bins for g in groups) > 0.99


def unpacked(rows):
    """Each (doc_id, extra) and its ids, put together from the bins' pieces."""
    found = {}
    for r in rows:
        at = 0
        assert sum(p.length for p in r.pieces) == r.n_tokens == len(r.ids) <= r.capacity
        assert [p.doc.doc_id for p in r.pieces] == r.doc_ids
        for p in r.pieces:
            assert p.offset == at
            at += p.length
            found.setdefault(p.doc, []).append((p.piece, p.start, r.ids[p.offset : p.offset + p.length]))
    return found


@pytest.mark.parametrize("buffer", [1, 300, 1 << 20])
def test_bins_hold_the_documents_ids(docs, buffer):
    wide = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.lit("x")).withColumn("ids", F.lit(3)).withColumn("bin_id", F.col("text"))
    wide = _util.materialize(wide, "wide")
    rows = bestfit.pack(wide, PATH, sizes=(16, 64, 256), buffer_tokens=buffer).collect()
    assert len({r.bin_id for r in rows}) == len(rows)
    found = unpacked(rows)
    assert len(found) == len(ROWS)
    for doc, pieces in found.items():
        pieces.sort()
        assert [k for k, _, _ in pieces] == list(range(len(pieces))) and doc.piece == "x" and doc.ids == 3
        assert all(start == 256 * k for k, start, _ in pieces)
        assert [i for _, _, ids in pieces for i in ids] == wanted(doc.bin_id)


def test_empty_table(docs):
    assert bestfit.pack(docs.limit(0), PATH).count() == 0
    assert bitpack.decode(bitpack.encode(docs.limit(0), PATH)).count() == 0
