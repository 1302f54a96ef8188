"""Every stage of the pipeline against a plain version, on what the stage before it kept of documents with planted copies, lines and passages."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    bullets = sum(bool(re.match(r"[\x20\x09-\x0d]*[•*-]", x)) for x in lines)
    dots = sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0d]*$", x)) for x in lines)
    n, k = len(words), len(lines)
    return not (n < 10 or 100 * len(twice) > 20 * n or 100 * symbols > 20 * chars or 100 * (k - len(set(lines))) > 30 * k or chars < 1.5 * n or chars > 25 * n or 100 * bullets > 90 * k or 100 * dots > 30 * k)


def _lines(rows):
    key = lambda x: x.strip(BLANK).translate(LOW)
    held = {}
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            held.setdefault(k, []).append(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(k := key(x)) < 40 or len(held[k]) < 5 or max(held[k]) == i)) for i, t in rows]


def _near(rows):
    def shingles(t):
        w = t.translate(LOW).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def _clean(rows, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    grams = set()
    for t in bench:
        w = words(t)
        n = min(len(w), 10)
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(g) for g in grams}
    return [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in grams for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared, bench = [some(14).capitalize() for _ in range(3)], [some(25), some(40), some(6)]
    texts = []
    for i in range(60):
        body = "\n".join(some(rng.randint(8, 30)) for _ in range(rng.randint(2, 6)))
        texts.append(body)
        if i % 4 == 0:  # copies and near copies
            near = body.split(" ")
            near[rng.randrange(len(near))] = word()
            texts += [body, " ".join(near)]
        if i % 3 == 0:  # lines that many share
            texts.append(f"{some(30)}\n {rng.choice(shared).upper()}\t\n{some(25)}")
        if i % 6 == 0:  # passages of the benchmark
            cut = bench[i // 6 % 2].split(" ")
            texts.append(f"{some(20)}, {' '.join(cut[5:17]).upper()}! {some(20)}")
            texts.append(f"{some(20)} {' '.join(cut[5:13])} {some(20)}")
    texts += [None, "", "too short", "again and again and " * 20, "# $ % & " * 20, *["- " + some(4) + "..."] * 2, "\n".join(["same line here"] * 9), f"{some(12)} {bench[2]} {some(12)}"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame([(i, t) for i, t in enumerate([*bench, None])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = [
        [(i, t) for i, t in rows if _quality(t)],
    ]
    want.append(_lines(want[-1]))
    want.append(_near(want[-1]))
    want.append(_clean(want[-1], bench))
    assert [len(x) for x in want] == sorted((len(x) for x in want), reverse=True) and len(rows) > len(want[0]) > len(want[2]) > len(want[3]) > 50 and want[0] != want[1]
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows), name
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    got, filled = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in want[-1]}
    for spans in filled.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
