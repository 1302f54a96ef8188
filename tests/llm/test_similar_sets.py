"""The near-dedup stage against all pairs, on planted near copies whose fingerprints lie far apart."""

from __future__ import annotations

import random

from loreweave.llm import similar_sets


def _shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(texts, similarity=0.8):
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(texts))}


def _corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(12))
    out = [None, "", "  ", "one two", "one two", "a b c d e"]
    for _ in range(n):
        own = [word() for _ in range(rng.randint(40, 160))]
        out.append(" ".join(own))
        for _ in range(rng.choice([0, 1, 1, 4])):  # Jaccard about 0.65 to 1
            near = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
        if rng.random() < 0.5:
            out[-1] = f"{line} {out[-1]}"
    own = [word() for _ in range(60)]
    for _ in range(90):  # a large group, in which many are only linked through others
        near = list(own)
        near[rng.randrange(60)] = word()
        out.append(" ".join(near))
    rng.shuffle(out)
    return out


def test_every_similar_pair_is_linked(spark):
    import corpus_pipeline

    texts = _corpus(1, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == _kept(texts) and kept.columns == docs.columns
    assert similar_sets.one_of_each_similar(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "other words stand in this text"), (None, "A b c\td e")], "doc_id long, text string")
    assert sorted(r.text for r in similar_sets.one_of_each_similar(again).collect()) == ["a b c d e", "other words stand in this text"]


def test_parities_never_tell_more_than_the_sets_differ_by():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for n in (3, 900, 1020, 1030, 2040, 2060, 9000, 9100):
        own = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        sets += [own, np.unique(np.r_[own[n // 20 :], rng.integers(-(1 << 62), 1 << 62, n // 9)]), own[: n - n // 8]]
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    told = similar_sets._differing(*[[similar_sets.parities(p[i]) for p in pairs] for i in (0, 1)])
    apart = [len(np.setxor1d(a, b)) for a, b in pairs]
    assert all(t <= x and t % 2 == x % 2 for t, x in zip(told.tolist(), apart))
    # unlike sets of many shingles are told apart
    far = [t for t, (a, b) in zip(told.tolist(), pairs) if min(len(a), len(b)) > 7000 and len(np.intersect1d(a, b)) == 0]
    assert far and all(t > 0.25 * 7000 for t in far) and not similar_sets._differing([], []).size


def test_long_near_copies_are_linked_across_lengths_of_parities(spark):
    rng = random.Random(8)
    texts = []
    for n in (1026, 2050, 2046, 4100):
        own = [f"w{rng.randrange(90000)}" for _ in range(n)]
        cut = own[: n - n // 12]
        near = [f"w{rng.randrange(90000)}" if i % 60 == 7 else x for i, x in enumerate(own)]
        texts += [" ".join(own), " ".join(cut), " ".join(near), " ".join(own[n // 2 :])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in similar_sets.one_of_each_similar(docs).collect()} == _kept(texts)


def test_fingerprints_link_first(spark, monkeypatch):
    import corpus_pipeline
    from loreweave.llm import simhash

    texts = _corpus(4, 40)
    fp = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in enumerate(texts)}
    close = [(i, j) for i in fp for j in range(i) if 0 < (fp[i] ^ fp[j]).bit_count() <= 4 and _shingles(texts[i]) and _shingles(texts[j])]
    asked, plain = [], similar_sets.fingerprint_pairs

    def told(nodes, distance):
        out = plain(nodes, distance)
        asked.append((distance, {r.own: r.fp % (1 << 64) for r in nodes.collect()}, {(r.u, r.v) for r in out.collect()}))
        return out

    monkeypatch.setattr(similar_sets, "fingerprint_pairs", told)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == _kept(texts)
    [(distance, held, pairs)] = asked
    assert distance == 4 and set(held.values()) == set(fp.values()) and pairs
    root = {x: x for x in held.values()}  # by fingerprint

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        assert (held[u] ^ held[v]).bit_count() <= 4
        root[find(held[u])] = find(held[v])
    assert close and all(find(fp[i]) == find(fp[j]) for i, j in close)
