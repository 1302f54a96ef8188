"""PII in long texts, and contexts that vary or mislead."""

from __future__ import annotations

import random
import time

from loreweave.llm import pii


def test_a_megabyte_of_numbers_and_mails(spark):
    rng = random.Random(1)
    part = [lambda: f"user{rng.randrange(10**6)}@mail{rng.randrange(99)}.example.org", lambda: str(rng.randrange(10**12)), lambda: f"10.{rng.randrange(300)}.2.{rng.randrange(256)}", lambda: f"word {rng.choice('abc')}"]
    out, size = [], 0
    while size < 1_000_000:
        out.append(rng.choice(part)())
        size += len(out[-1]) + 1
    docs = spark.createDataFrame([(1, " ".join(out)), (2, "1" * 300_000), (3, "a@b.c " * 50_000)], "doc_id long, text string")
    pii.pii_spans(docs.where("doc_id = 0")).count()
    began = time.time()
    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    assert time.time() - began < 120  # seconds; the square of the length would take hours
    assert len(got[1].base) > 20_000 and len(got[3].base) == 50_000 and not got[2].base


def test_candidates_overlap_no_base_span(spark):
    rng = random.Random(2)
    part = ["a@b.c", "1.2.3.4", "+1 555 123 4567", "4111 1111 1111 1111", "12345678", "x99-88-77", "(", ")", ".", "-", " ", "word", "é", "😀"]
    texts = ["".join(rng.choices(part, k=rng.randint(1, 30))) for _ in range(150)] + [" ".join(rng.choices(part, k=2000))]
    d = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("spans", pii.F.concat(*pii.KINDS))
    for r in pii._places(d).select("doc_id", "text", "places").collect():
        base = [p for p in r.places if p.kind]
        for p in r.places:
            assert r.text[p.start : p.end] == p.token
            before = [w for w in __import__("re").split(r"[^a-zé]+", r.text[max(0, p.start - pii.NEAR) : p.start].lower()) if w]
            assert [c for c in p.contexts if c.startswith("<")] == ([f"< {before[-1]}"] if before else []) + ([f"< {' '.join(before[-2:])}"] if len(before) > 1 else [])
            assert p.kind or not any(b.start < p.end and p.start < b.end for b in base)


def test_five_leads_a_kind_and_a_decoy(spark):
    """Identifiers behind many phrases, and numbers behind phrases of their own that no seed shares."""
    rng = random.Random(5)
    n = lambda k: "".join(rng.choices("123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    seen = {"email": lambda: f"{word()}{n(2)}@{word()}.org", "ip": lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7", "phone": lambda: f"+1 (555) {n(3)}-{n(4)}"}
    unseen = {"email": lambda: f"{word()}{n(3)}@{word()}", "ip": lambda: f"fe80::{n(4)}:{n(2)}", "phone": lambda: f"({n(3)}) {n(3)}-{n(4)}"}
    leads = {"email": ["reach mailbox", "my inbox", "mail goes", "reply address", "send letters"], "ip": ["from host", "seen server", "client node", "the router", "proxy machine"], "phone": ["my mobile", "call handset", "ring telephone", "text cell", "dial extension"]}
    decoys = ["invoice number", "parcel tracking", "order reference", "chapter verse", "serial plate"]
    rows, hidden = [], {}
    for i in range(900):
        kind = ("email", "ip", "phone", None)[i % 4]
        lead = rng.choice(leads[kind] if kind else decoys)
        new = kind and i % 10 < 3
        item = (unseen if new else seen)[kind]() if kind else f"{n(4)}-{n(6)}"
        text = f"{word()} {word()} {lead} "
        if new:
            hidden[i] = (kind, len(text), len(text) + len(item))
        rows.append((i, f"{text}{item} {word()} {word()}"))
    got = pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r.doc_id, *s) for r in got for s in r.spans if s not in r.base}
    want = {(i, *v) for i, v in hidden.items()}
    assert len(added & want) >= 0.95 * len(want) and len(added & want) >= 0.95 * len(added)
