"""Licence windows against all windows of a text."""

from __future__ import annotations

import random
from collections import Counter

from loreweave.llm import license_scan


def _best(words, template, threshold):
    grams = Counter(zip(template, template[1:]))
    best = max(license_scan.dice(Counter(zip(words[i:j], words[i + 1 : j])), grams) for i in range(len(words)) for j in range(i + 2, len(words) + 1))
    return best if best >= threshold - 1e-12 else None


def test_shorter_and_longer_notices_are_found():
    index = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    longer = license_scan.normalised("Licensed under the terms of the Apache License, Version 2.0")
    assert {k: s for k, s, *_ in index.found(longer)}["Apache-2.0"] >= 14 / 17
    rng = random.Random(3)
    names = ["Apache-2.0", "MIT", "GPL-3.0", "CC-BY-4.0", "BSD-grant", "Apache-2.0-header"]
    for _ in range(60):
        k = rng.choice(names)
        own = [w for w in index.words[k] if rng.random() > 0.08]
        for _ in range(rng.randint(0, 2)):
            own.insert(rng.randrange(len(own)), rng.choice(["the", "license", "x"]))
        text = ["before", "the", *own[: rng.choice([len(own), len(own) * 3 // 4])], "and", "after", "the", "license"]
        got = {name: s for name, s, *_ in index.found(text)}
        for name in names:
            want = _best(text, index.words[name], 0.8)
            assert (got.get(name) is None and want is None) or abs(got[name] - want) < 1e-9, (name, text)
