from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loreweave.functions.text import recency, spans, tokens
from loreweave.operators import dedupe, entities, gates, graph
from loreweave.operators.segment import segment
from loreweave.plans import corpus
from loreweave.plans.queries import corpus_tables
from loreweave.plans.run import Config, run, tables
from loreweave.sources import documents

SCHEMA = "source_id string, order_hint int, raw_text string"


@pytest.fixture(scope="module")
def t(spark):
    return corpus_tables(spark)


def test_paragraph_offsets(t):
    got = {r.passage_id: (r.char_start, r.char_end) for r in t["passages"].collect()}
    assert {k: got[k] for k in ("book1_ch01:0", "book1_ch01:1", "book1_ch01:2", "book1_ch02:0", "book1_ch02:1")} == {"book1_ch01:0": (0, 69), "book1_ch01:1": (71, 136), "book1_ch01:2": (143, 216), "book1_ch02:0": (0, 62), "book1_ch02:1": (64, 137)}
    assert not any(k.startswith("notes") for k in got)


def test_offsets_are_those_of_the_text(spark):
    texts = {f"d{i}": x for i, x in enumerate(["é a\n\n😀 b\r\n\r\n c ", "", "\n\n", "one", None, " \t x \n \n y"])}
    rows = segment(spark.createDataFrame([(k, 0, v) for k, v in texts.items()], SCHEMA)).collect()
    for r in rows:
        assert texts[r.source_id][r.char_start : r.char_end].replace("\r\n", "\n") == r.text
    assert sorted({r.source_id for r in rows}) == ["d0", "d3", "d5"]


def test_spans_beyond_ascii(spark):
    r = spark.createDataFrame([("é Jon Snow, 😀 Jon Snow x",)], "text string").select(spans(F.col("text"), r"(?U)\bJon\sSnow\b").alias("s")).collect()[0]
    assert [(x["start"], x["end"], x["excerpt"]) for x in r["s"]] == [(2, 10, "Jon Snow"), (14, 22, "Jon Snow")]


def test_entities(t):
    got = {r.canonical_name: (r.entity_type, r.mention_count) for r in t["entities"].collect()}
    assert got["The Grey Gull"][0] == "vehicle" and got["Winterfell"] == ("place", 2) and got["House Rook"][0] == "group" and got["Ann the Bold"] == ("person", 4)


def test_first_corpus_by_hand(spark):
    own = tables(spark.createDataFrame(list(corpus.CORPUS[:3]), SCHEMA))
    assert sorted((r.canonical_name, r.mention_count) for r in own["entities"].collect()) == [("Far Isles", 1), ("Grey Gull", 1), ("House Rook", 1), ("Mira Vale", 3), ("Queen of the Far Isles", 1), ("Tor Hale", 1), ("Winterfell", 2)]


def test_excerpts_lie_at_their_offsets(t):
    bad = t["anchors"].join(t["passages"].select("passage_id", "text"), "passage_id").where(F.expr("substring(text, char_start + 1, char_end - char_start) <> excerpt"))
    assert bad.count() == 0


def test_vehicle_threshold_and_overrides(spark, t):
    found = t["mentions"]
    assert "The Grey Gull" not in {r.canonical_name for r in entities.entities(found, 99).collect()}
    forced = spark.createDataFrame([("The Grey Gull", "ship1")], "canonical_name string, entity_id string")
    assert "ship1" in {r.entity_id for r in entities.entities(found, 99, forced).collect()}


def test_tokens_and_recency(spark):
    r = spark.createDataFrame([("(Dream) dream, 'the' -- Gull!",)], "x string").select(tokens(F.col("x")).alias("t")).collect()[0]
    assert r["t"] == ["dream", "gull", "the"]
    rows = spark.createDataFrame([("b:10",), ("passage-10",), ("a_7-x",)], "x string").select(recency(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in rows] == [0, 10, 7]


def _python_similarity(a, b):
    jac = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    s = jac(a["t"], b["t"]) + 0.1 * (a["category"] == b["category"])
    for k, w in (("related_entity_ids", 0.1), ("evidence_anchor_ids", 0.05)):
        if a[k] and b[k]:
            s += w * jac(set(a[k]), set(b[k]))
    return min(1.0, s)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_duplicates_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(3)
    rows = [(f"o{i:02d}", rng.choice("ab"), " ".join(rng.choices("red blue old new sea king".split(), k=rng.randint(0, 4))), rng.sample(["e1", "e2"], rng.randint(0, 2)), rng.sample(["x", "y", "z"], rng.randint(0, 2))) for i in range(40)]
    df = spark.createDataFrame(rows, "obligation_id string, category string, description string, related_entity_ids array<string>, evidence_anchor_ids array<string>")
    got = {(r.i, r.j) for r in dedupe.find_duplicates(df, threshold).collect()}
    d = [dict(zip(("obligation_id", "category", "description", "related_entity_ids", "evidence_anchor_ids"), r)) | {"t": set(r[2].split())} for r in rows]
    want = {(a["obligation_id"], b["obligation_id"]) for i, a in enumerate(d) for b in d[i + 1 :] if _python_similarity(a, b) >= threshold - 1e-12}
    assert got == want


def test_merging_keeps_every_id_once(spark, t):
    o = t["obligations"].drop("seq")
    m = dedupe.merges(o, 0.5)
    merged = dedupe.merge_obligations(o, m=m).collect()
    ids = [x for r in merged for x in [r.obligation_id, *r.absorbed]]
    assert sorted(ids) == sorted(r.obligation_id for r in o.collect())
    assert len(merged) < len(ids)
    assert dedupe.duplicate_edges(m).count() == len(ids) - len(merged)


def test_duplicate_join_has_no_cross_join(t):
    plan = dedupe.find_duplicates(t["obligations"], 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_gates(spark, t):
    assert gates.referential_integrity(t["passages"], t["anchors"], t["entities"], t["aliases"], t["obligations"]).count() == 0
    assert gates.verdict(t["findings"]).collect()[0].passed
    assert gates.contradictions(t["obligations"]).count() == 1
    assert gates.verdict(t["findings"].limit(0)).collect()[0].passed


def test_graph_queries(t):
    assert graph.connected_edges(t["edges"], t["nodes"]).count() == t["edges"].count()
    assert graph.uniqueness(t["nodes"], t["edges"]).count() == 0
    entity = t["entities"].where("canonical_name = 'Mira Vale'").collect()[0].entity_id
    own = graph.query_graph("timeline_for_entity", t, entity_id=entity).collect()
    assert own and [r.story_order_index for r in own] == sorted(r.story_order_index for r in own)
    with pytest.raises(ValueError):
        graph.query_graph("timeline_for_entity", t)
    with pytest.raises(ValueError):
        graph.query_graph("nothing", t)


def test_active_during(spark):
    rows = [("r1", "x", "2", None, None, 1), ("r2", "x", None, "1", "3", None), ("r3", "x", None, "1", None, 0), ("r4", "x", None, "3", "4", 2)]
    df = spark.createDataFrame(rows, "relationship_id string, k string, l string, s string, e string, o int").selectExpr("relationship_id", "k relation_type", "k source_entity_id", "k target_entity_id", "named_struct('time_label', l, 'time_start', s, 'time_end', e) story_time", "named_struct('order_index', o) story_order")
    assert [r.relationship_id for r in graph.active_during(df, "2").collect()] == ["r3", "r1", "r2"]


def test_run_writes_stores_and_can_run_again(spark, tmp_path):
    docs = spark.createDataFrame(list(corpus.CORPUS[:2]), SCHEMA)
    for _ in range(2):
        assert run(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/dossier")).count() > 0
    with pytest.raises(ValueError):
        Config(similarity_threshold=2)


def test_files(spark, tmp_path):
    (tmp_path / "book1_ch01.txt").write_bytes(b"a\r\nb\rc")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "pic.png").write_bytes(b"x")
    d = documents.scan_documents(spark, str(tmp_path))
    rows = {r.source_id: r for r in d.collect()}
    assert set(rows) == {"book1_ch01", "bad"} and rows["book1_ch01"].raw_text == "a\nb\nc" and rows["book1_ch01"].order_hint == 1
    assert (rows["book1_ch01"].book_label, rows["book1_ch01"].chapter_label) == ("book1", "ch01") and documents.quarantine(d).count() == 1
    wanted = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b.md")], "upload_id int, name string")
    taken = spark.createDataFrame([("a.txt",)], "name string")
    assert sorted(r.stored_name for r in documents.free_names(wanted, taken).collect()) == ["a (2).txt", "a (3).txt", "b.md"]


def test_stream_of_changes(spark, tmp_path):
    from loreweave.streaming.changes import watch

    folder, root, check = (tmp_path / x for x in ("in", "out", "check"))
    folder.mkdir()
    (folder / "a.txt").write_text("Mira Vale came.\n\nA secret.")
    (folder / "b.txt").write_text("Tor Hale left.")
    watch(spark, str(folder), str(root), str(check)).awaitTermination()
    (folder / "b.txt").unlink()
    (folder / "sub").mkdir()
    (folder / "c.txt").write_text("Ann Gray stays.")
    watch(spark, str(folder), str(root), str(check)).awaitTermination()
    got = {r.source_id: r.n for r in spark.read.parquet(str(root / "passages")).groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_empty_input(spark):
    own = tables(spark.createDataFrame([], SCHEMA))
    assert all(own[k].count() == 0 for k in ("passages", "entities", "obligations", "events", "nodes", "edges", "findings"))


def _greedy(rows: list[tuple], threshold: float) -> set[tuple]:
    """Every pair scored by the rows as they came, then merged one after another."""
    share = lambda a, b: len({*a} & {*b}) / len({*a, *b}) if a or b else 1.0
    both = lambda a, b, w: w * share(a, b) if a and b else 0.0
    pairs = []
    for x in rows:
        for y in rows:
            if x[0] < y[0] and (s := min(1.0, share(x[1].split(), y[1].split()) + 0.1 + both(x[2], y[2], 0.1) + both(x[3], y[3], 0.05))) >= threshold:
                pairs.append((-s, x[0], y[0]))
    left = {r[0]: (list(r[3]), []) for r in rows}
    for _, i, j in sorted(pairs):
        if i in left and j in left:
            a, b = (i, j) if len(left[i][0]) >= len(left[j][0]) else (j, i)
            other = left.pop(b)
            left[a] = (list(dict.fromkeys(left[a][0] + other[0])), [*left[a][1], b, *other[1]])
    return {(k, tuple(v[0]), tuple(sorted(v[1]))) for k, v in left.items()}


MERGE_SCHEMA = "obligation_id string, category string, description string, evidence_anchor_ids array<string>, last_seen_passage_id string, confidence double, is_resolved boolean, resolution_passage_id string, related_entity_ids array<string>"


@pytest.mark.parametrize("partners", [1000, 2])
def test_merging_is_the_greedy_one(spark, partners, monkeypatch):
    """200 tables at once: they share no word, so that no pair joins two of them."""
    monkeypatch.setattr(dedupe, "PARTNERS", partners)
    rng = random.Random(11)
    every, want = [], set()
    for trial in range(200):
        words = [f"{w}{trial}" for w in ("sea", "king", "oath", "gate", "dream", "crown")][: rng.choice([4, 6])]
        anchors = [f"a{trial}.{k}" for k in range(rng.choice([6, 60]))]
        rows = [(f"o{trial:03d}.{i:02d}", " ".join(rng.sample(words, 3)), sorted(rng.sample(["e1", "e2", "e3"], rng.randint(0, 2))), rng.sample(anchors, rng.choice([0, 1, 1, 2, 5]))) for i in range(rng.choice([1, 5, 20]))]
        want |= _greedy(rows, 0.65)
        every += rows
    o = spark.createDataFrame([(i, "mystery", d, a, "p:1", 0.7, False, None, e) for i, d, e, a in every], MERGE_SCHEMA).repartition(5)
    m = dedupe.merges(o, 0.65)
    got = {(r.obligation_id, tuple(r.evidence_anchor_ids), tuple(r.absorbed)) for r in dedupe.merge_obligations(o, m=m).collect()}
    assert got == want
    assert m.edges.count() == len(every) - len(want) and m.edges.where("weight < 0.65 - 1e-9 or weight > 1").count() == 0


def test_merging_takes_the_best_of_both(spark):
    rows = [("b", "mystery", "the sea", ["2"], "p_9", 0.5, True, "r2", ["e2"]), ("a", "mystery", "the Sea!", ["1"], "p_10", 0.9, False, None, ["e1"]), ("c", "plot_thread", "", [], "q", 0.1, False, None, []), ("d", "plot_thread", None, [], "q", 0.1, False, None, [])]
    o = spark.createDataFrame(rows, MERGE_SCHEMA)
    got = {r.obligation_id: r for r in dedupe.merge_obligations(o).collect()}
    assert set(got) >= {"a", "c"} and "b" not in got
    a = got["a"]
    assert (a.evidence_anchor_ids, a.last_seen_passage_id, a.confidence, a.is_resolved, a.resolution_passage_id, a.related_entity_ids, a.absorbed) == (["1", "2"], "p_10", 0.9, True, "r2", ["e1", "e2"], ["b"])
    assert dedupe.merge_obligations(o.limit(0)).count() == 0


def test_running_sums_of_a_hot_group(spark):
    from loreweave.functions.ranking import running

    rows = [("hot", i, i % 7) for i in range(500)] + [(f"g{i % 9}", i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {(r.g, r.o): r.before for r in running(df, "g", "o", "v", "before").collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}


def test_duplicates_meet_by_size_and_parities(spark):
    rng = random.Random(4)
    often, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(60)]
    rows = [(f"o{i:03}", rng.choice(["a", "b", None]), " ".join(rng.sample(often, rng.randint(0, 9)) + rng.sample(rare, rng.randint(0, 2))), rng.sample(["x", "y", "z"], rng.randint(0, 2)), rng.sample(["k", "l", "m"], rng.randint(0, 2))) for i in range(120)]
    d = spark.createDataFrame(rows, "obligation_id string, category string, description string, related_entity_ids array<string>, evidence_anchor_ids array<string>")
    t = d.withColumn("tokens", tokens(F.col("description")))
    for least in (0.8, 0.5, 0.2):
        got = dedupe.find_duplicates(d, least)
        want = t.alias("a").join(t.alias("b"), F.col("a.obligation_id") < F.col("b.obligation_id")).select(F.col("a.obligation_id").alias("i"), F.col("b.obligation_id").alias("j"), dedupe.similarity("a", "b").alias("similarity")).where(F.col("similarity") >= least - 1e-12)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
        # what meets by a token is no more than sizes, places and parities
        assert "bit_count" in got._jdf.queryExecution().optimizedPlan().toString()


def test_story_tables_are_made_when_asked_for(spark):
    made = []
    t = tables(corpus.docs(spark), Config(vehicle_min_mentions=2), keep=lambda name, rows: made.append(name) or rows, lazy=True)
    assert not made and t["mentions"].count() > 0 and made == ["passages", "mentions"]
    other = t | {"entities": t["mentions"].limit(0)}
    assert other["by_passage"] is not None and "entities" in other and made[:2] == ["passages", "mentions"]
    assert set(tables(corpus.docs(spark), Config(vehicle_min_mentions=2), keep=lambda name, rows: rows)) >= {"passages", "links", "edges", "findings"}


def test_patterns_led_by_a_letter_match_alike(spark):
    from loreweave.functions.lexicons import EVENT_RULES, MENTION_RULES, OBLIGATION_RULES, RELATION_RULES
    from loreweave.functions.text import led

    texts = [x for _, _, x in corpus.CORPUS] + ["ſecret SECRET xsecret KEPT it hidden kept ıt hidden KEPT İT HIDDEN", "the Ship The Ship Iceland Ice éIce Ice9 _Ice", "", "A SWORD of steel\nsword x hung WAR was coming", "\U0001d400House House Rook's Lord of the Isles Far"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    cased = [p for r in OBLIGATION_RULES for p in r.patterns] + [p for _, p in EVENT_RULES + RELATION_RULES]
    plain = [("(?U)", r.pattern) for r in MENTION_RULES] + [("(?U)", "|".join(r.pattern for r in MENTION_RULES))] + [("(?iuU)", p) for p in cased]
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    for r in rows.select(*[F.struct(found(f + p), found(f + led(p))) for f, p in plain]).collect():
        assert all(a == b for a, b in r)
    assert all(led(p) != p for _, p in plain) and [led(p) for p in (r"\ba?b", "[^a]b", r"a|\d", "(a|b)?c")] == [r"\ba?b", "[^a]b", r"a|\d", "(a|b)?c"]
    assert led(r"\b(sword|blade)\b.*x") == r"(?=[sb])(?:\b(sword|blade)\b.*x)"
