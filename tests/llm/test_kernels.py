"""Parts without Spark, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from lattica.llm import bestfit, bitpack, ctw, decontaminate, ngram_join, quality, vectorbins

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
@pytest.mark.parametrize("block", [8, 100, 4096])
def test_bits_round_trip(bits, block):
    ids = RNG.integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    lengths = [0, 1, 2, 1000]
    s = bitpack.Packed.of(bitpack.pack_file([None, -5, 7, 8], lengths, ids, bits, block))
    assert (s.ids() == ids).all()
    assert len(s.document(0)) == 0 and (s.document(3) == ids[3:]).all()
    for i, j in ((0, 1), (99, 101), (500, 1003), (7, 7)):
        assert (s.ids(i, j) == ids[i:j]).all()


def test_empty_shard():
    assert len(bitpack.Packed.of(bitpack.pack_file([], [], np.zeros(0, np.uint32), 16)).ids()) == 0


def kt(n0, n1):
    p = 1.0
    for i in range(n0):
        p *= (i + 0.5) / (i + 1)
    for i in range(n1):
        p *= (i + 0.5) / (n0 + i + 1)
    return p


def test_kt_block():
    for n0, n1 in ((0, 0), (1, 0), (3, 5), (20, 1)):
        assert ctw.kt_log_block(np.array([float(n0)]), np.array([float(n1)]))[0] == pytest.approx(math.log(kt(n0, n1)), abs=1e-9)


def brute_ctw(train, depth):
    """The tree by its definition: log weights by recursion over contexts, then mixed predictions."""
    counts = Counter()
    for t in train:
        s = bytes([255]) * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    counts[s[i - d : i], (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1] += 1
    n = lambda c, b: (counts[c, b, 0], counts[c, b, 1])
    seen = {(c, b) for c, b, _ in counts}

    def log_weight(c, b):
        own = math.log(kt(*n(c, b)))
        if len(c) == depth:
            return own
        inner = sum(log_weight(bytes([x]) + c, b) for x in range(256) if (bytes([x]) + c, b) in seen)
        return math.log(0.5 * math.exp(own) + 0.5 * math.exp(inner))

    def predict(s, i, j, d=0):
        c, b = s[i - d : i], (1 << j) | (s[i] >> (8 - j))
        if (c, b) not in seen:
            return None
        a = n(c, b)
        own = (a[(s[i] >> (7 - j)) & 1] + 0.5) / (sum(a) + 1)
        if d == depth or (deeper := predict(s, i, j, d + 1)) is None:
            return own
        mine = kt(*a)
        inner = math.exp(sum(log_weight(bytes([x]) + c, b) for x in range(256) if (bytes([x]) + c, b) in seen))
        return (mine * own + inner * deeper) / (mine + inner)

    def score(t):
        s = bytes([255]) * depth + t + b"\xff"
        return sum(math.log10(predict(s, i, j) or 0.5) for i in range(depth, len(s)) for j in range(8))

    return score


def test_context_tree_against_definition():
    depth, train = 3, [b"abab", b"abc", b"", b"bca\xc3\xa9"]
    keys, counts = ctw.gram_counts(train, np.ones(len(train), bool), depth)
    tree = ctw.Tree(keys, counts, depth, 2)
    top = ctw.upper(*tree.top())
    score = brute_ctw(train, depth)
    for t in [*train, b"zz", b"abx", b"cab"]:
        k, _ = ctw.gram_counts([t], np.zeros(1, bool), depth)
        logp = dict(zip(k.tolist(), ctw.log10_probability(k, tree, top), strict=True))
        got = sum(logp[x] for _, _, ks in ctw.batches([t], depth) for x in ks.tolist())
        assert got == pytest.approx(score(t), abs=1e-9)


def test_squeeze():
    a = np.unique(RNG.integers(0, 1 << 48, 500, dtype=np.uint64))
    assert (ctw.expand(ctw.squeeze(a, True), np.uint64, True) == a).all()
    assert len(ctw.expand(ctw.squeeze(np.zeros(0, np.uint64)), np.uint64)) == 0
    assert ctw.unpack_words(ctw.pack_words([b"a", b" "])) == [b"a", b" "] and ctw.unpack_words(ctw.pack_words([])) == []


def test_best_fit_holds_every_item():
    for n in (0, 1, 50, 3000):
        x = np.minimum(512, RNG.geometric(0.01, n))
        hist = dict(Counter(x.tolist()))
        groups = bestfit.plan(hist, (64, 128, 512), 4)
        look = bestfit.Lookup(groups)
        seen = Counter()
        rank = np.array([seen.update([v]) or seen[v] - 1 for v in x.tolist()], np.int64)
        if not n:
            assert groups == []
            continue
        b, cap, used, off = look.find(x.astype(np.int64), rank)
        fill = np.bincount(b, weights=x)
        assert (fill[b] == used).all() and (used <= cap).all()
        assert all(c == next(s for s in (64, 128, 512) if s >= u) for c, u in zip(cap, used, strict=True))
        spans = sorted(zip(b.tolist(), off.tolist(), x.tolist(), strict=True))
        for (b0, o0, n0), (b1, o1, _) in zip(spans, spans[1:], strict=False):
            assert b0 != b1 or o0 + n0 == o1


def test_vector_placement():
    v = RNG.lognormal(size=(500, 3))
    at = vectorbins.place(v, 7)
    sums = np.array([v[at == k].sum(axis=0) for k in range(7)])
    assert (sums.max(axis=0) < 1.1 * sums.min(axis=0)).all()
    assert len(vectorbins.place(np.zeros((0, 3)), 7)) == 0


def brute_groups(sets, num, den):
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(np.intersect1d(a, sets[j]))
            if den * o >= num * (len(a) + len(sets[j]) - o):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_tree_loses_no_link():
    sets = []
    for _ in range(40):
        base = RNG.integers(0, 1 << 63, int(RNG.integers(1, 900)), dtype=np.uint64)
        for k in range(int(RNG.integers(1, 6))):
            keep = base[RNG.random(len(base)) > RNG.choice([0.0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate((keep, RNG.integers(0, 1 << 63, k, dtype=np.uint64)))))
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])

    def verify(i, found):
        o = np.array([len(np.intersect1d(sets[i], sets[j])) for j in found.tolist()])
        return 100 * o >= 80 * (sizes[i] + sizes[found] - o)

    for each in (4, 16):
        groups = ngram_join.linked([ngram_join.point(s, each, 8, 256) for s in sets], sizes, 80, 100, verify)
        got = list(range(len(sets)))
        for g in groups:
            for i in g:
                got[i] = min(g)
        assert got == brute_groups(sets, 80, 100)


def test_prefixes_of_similar_sets_meet():
    sketch = RNG.integers(0, 9, 1 << 18)
    for _ in range(200):
        a = np.unique(RNG.integers(0, 1 << 63, int(RNG.integers(1, 60)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[RNG.random(len(a)) > 0.1], RNG.integers(0, 1 << 63, 2, dtype=np.uint64))))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 80 * (len(a) + len(b) - o):
            assert len(np.intersect1d(ngram_join.prefix(a, sketch, 80, 100), ngram_join.prefix(b, sketch, 80, 100)))


def test_windows():
    w = decontaminate.WindowSet([(1, b"one two three four"), (2, b"Two, three"), (3, b""), (4, b"one two three four")], width=3)
    get = w.vocabulary.get
    ids = lambda t: np.array([get(x, 0) for x in t.translate(decontaminate.TABLE).split()], np.int64)
    mask, _, which = w.search(ids(b"x ONE two-three y two four"))
    assert mask.tolist() == [False, True, True, True, False, False, False]
    assert {w.items[k] for k in which} == {1, 2, 4}
    assert decontaminate.cut(b"a ONE, two b", {1, 2}) == b"a  b"
    assert decontaminate.cut(b"one", {0}) == b"" and decontaminate.cut(b"", set()) == b""


def test_classifier_learns_and_bounds():
    good = [b"the cat sat on the mat %d" % i for i in range(60)]
    bad = [b"buy buy buy $$$ now %d" % i for i in range(60)]
    rows = [(quality.features([t], 12)[0], y) for g, b in zip(good, bad, strict=True) for t, y in ((g, 1), (b, 0))]
    w = quality.fit(rows, 12, 3)
    s = quality.logits([b"the mat sat", b"buy $$$ buy", b""], w, 12)
    assert s[0] > 0 > s[1] and np.isfinite(s).all()
    one, n = quality.features([b"a a b", b"", b"c"], 12)
    two = [quality.features([t], 12)[0] for t in (b"a a b", b"", b"c")]
    assert (one == np.concatenate(two)).all() and n.tolist() == [6, 0, 2]


def brute_hits(words, items, width):
    hit, found = set(), set()
    for k, text in enumerate(items):
        item = text.translate(decontaminate.TABLE).split()
        n = min(width, len(item))
        grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(k)
    return hit, found


@pytest.mark.parametrize("width", [1, 2, 5])
def test_windows_against_brute_force(width):
    for _ in range(60):
        words = [b"a", b"b", b"c", "é".encode(), b"d"]
        some = lambda most: b" ".join(words[i] for i in RNG.integers(0, 5, int(RNG.integers(0, most))))
        items = [some(9) for _ in range(int(RNG.integers(0, 6)))] * int(RNG.integers(1, 3))
        w = decontaminate.WindowSet(list(enumerate(items)), width)
        doc = some(40).translate(decontaminate.TABLE).split()
        mask, _, which = w.search(np.array([w.vocabulary.get(x, 0) for x in doc], np.int64))
        hit, found = brute_hits(doc, items, width)
        assert set(np.flatnonzero(mask).tolist()) == hit and set(which.tolist()) == found


@pytest.mark.parametrize("hot_share", [1, 10_000])
def test_scores_against_definition(spark, hot_share):
    """The whole query: base and tree scores by their definitions, with and without divided pairs."""
    rows = [(1, "abab A"), (2, "ab c"), (3, ""), (4, None), (5, "bca é a"), (2, "ab c"), (None, "zz b"), (6, "unseen b"), (7, "ab c")]
    train = [d is not None and d < 6 for d, _ in rows]
    df = spark.createDataFrame([(d, t, f) for (d, t), f in zip(rows, train, strict=True)], "doc_id long, text string, train boolean").repartition(3)
    got = ctw.score_documents(df, depth=3, least_chunks=3, buckets=5, chunks_per_salt=2, hot_share=hot_share).collect()
    texts = [(t or "").encode() for _, t in rows]
    score = brute_ctw([t for t, f in zip(texts, train, strict=True) if f], 3)
    tokens = lambda t: [*t.lower().split(), b" "]
    c = Counter(w for t, f in zip(texts, train, strict=True) if f for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = [(d, not f, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), score(t), -score(t) * math.log2(10) / (len(t) + 1)) for (d, _), t, f in zip(rows, texts, train, strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[6])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def plain_ftrl(rows, bits, epochs, alpha=0.3, beta=1.0, l1=0.02, l2=0.5):
    """Follow the regularised leader, one coordinate at a time, as published."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for slots, y in rows:
            x = {i: c / math.sqrt(len(slots)) for i, c in Counter(slots).items()} | {1 << bits: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_classifier_is_ftrl():
    words = [b"alpha", b"beta", b"gamma", b"$$", b"1", b"delta"]
    texts = [(b" ".join(words[i] for i in RNG.integers(0, 6, int(RNG.integers(1, 20)))), int(RNG.integers(0, 2))) for _ in range(60)]
    rows = [(quality.features([t], 10)[0].tolist(), y) for t, y in texts]
    want = plain_ftrl(rows, 10, 3)
    got = quality.fit(((np.array(s), y) for s, y in rows), 10, 3)
    assert {i: pytest.approx(w, abs=1e-4) for i, w in want.items()} == {i: float(got[i]) for i in want}
    assert set(np.flatnonzero(got).tolist()) <= set(want)
    for t, _ in texts[:10]:
        s = quality.features([t], 10)[0]
        score = sum(want.get(i, 0.0) for i in s.tolist()) / math.sqrt(len(s)) + want[1 << 10]
        assert quality.logits([t], got, 10)[0] == pytest.approx(score, abs=1e-3)
