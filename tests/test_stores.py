"""Keyed logs, the graph's log, content hashes and contradictions on hot keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loreweave.operators import gates, graph, metrics
from loreweave.sources.keyed_log import KeyedLog
from loreweave.sources.stores import Stores

SCHEMA = "k int, v string, t int, dead boolean"


def _read(log):
    return sorted(map(tuple, log.read().select("k", "v").collect()))


def test_the_last_write_wins_in_either_order(spark, tmp_path):
    one = spark.createDataFrame([(1, "z", 0, False), (2, "b", 0, False), (2, "a", 1, False), (None, "n", 0, False)], SCHEMA)
    two = spark.createDataFrame([(1, "a", 0, False), (3, "c", 0, False)], SCHEMA)
    for name, order in (("x", ((1, one), (2, two))), ("y", ((2, two), (1, one), (2, two)))):
        log = KeyedLog(spark, f"file://{tmp_path}/{name}", ["k"])
        for n, rows in order:
            log.write(n, rows, ["t"], gone="dead")
        assert sorted(map(tuple, log.read().select("k", "v").collect()), key=str) == sorted([(1, "a"), (2, "a"), (3, "c"), (None, "n")], key=str)


def test_deletes_bases_and_repeats(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/l", ["k"])
    write = lambda n, *rows: log.write(n, spark.createDataFrame(list(rows), SCHEMA), ["t"], gone="dead")
    write(1, (1, "a", 0, False), (2, "b", 0, False))
    write(2, (1, "x", 5, True), (3, "c", 0, False))
    assert _read(log) == [(2, "b"), (3, "c")]
    log.compact()
    assert _read(log) == [(2, "b"), (3, "c")]
    write(2, (2, "changed", 0, False))  # the base has this write in it
    write(3, (1, "again", 0, False))
    assert _read(log) == [(1, "again"), (2, "b"), (3, "c")]
    log.vacuum()
    log.compact()
    log.compact()
    log.vacuum()
    assert _read(log) == [(1, "again"), (2, "b"), (3, "c")] and len(list((tmp_path / "l" / "delta").glob("_seq*"))) == 0
    (tmp_path / "l" / "delta" / "_sequence=9").mkdir(parents=True)  # a write that broke off
    assert _read(log) == [(1, "again"), (2, "b"), (3, "c")]


def test_graph_log(spark, tmp_path):
    log = graph.GraphLog(spark, f"file://{tmp_path}/g")
    nodes = lambda *rows: spark.createDataFrame(list(rows), "label string, node_id string, properties string")
    edges = lambda *rows: spark.createDataFrame(list(rows), "edge_id string, rel_type string, source_label string, source_id string, target_label string, target_id string")
    log.upsert(2, nodes(("Entity", "e1", "new")), edges(("x", "R", "Entity", "e1", "Event", "v1"), ("y", "R", "Entity", "e1", "Event", "v2")))
    log.upsert(1, nodes(("Entity", "e1", "old"), ("Event", "v1", "p")), edges(("x", "OLD", "Entity", "e1", "Event", "v1")))
    n, e = log.read()
    assert {(r.node_id, r.properties) for r in n.collect()} == {("e1", "new"), ("v1", "p")}
    assert [(r.edge_id, r.rel_type) for r in e.collect()] == [("x", "R")]


def test_later_passages_win(spark):
    p = "passage_id string, source_id string, order_hint int, paragraph_index int, text string, char_start int, char_end int"
    passages = spark.createDataFrame([("a:0", "a", 1, 0, "zz", 0, 2), ("a:0", "a", 2, 0, "aa", 0, 2)], p)
    none = lambda schema: spark.createDataFrame([], schema)
    story = "story_time struct<time_label:string,time_start:string,time_end:string>, story_order struct<order_index:int,order_label:string,source_id:string,passage_id:string>"
    n = graph.graph_nodes(
        passages, none("anchor_id string, passage_id string, char_start int, char_end int, excerpt string"), none("entity_id string, canonical_name string, entity_type string, first_seen_passage string, mention_count long"),
        none("obligation_id string, category string, description string, last_seen_passage_id string, confidence double, is_resolved boolean, resolution_passage_id string"), none(f"event_id string, event_type string, title string, description string, {story}"),
        none(f"relationship_id string, relation_type string, source_entity_id string, target_entity_id string, description string, {story}"),
    )
    assert [(r.node_id, '"text":"aa"' in r.properties) for r in n.collect()] == [("a:0", True)] and "write" not in n.columns


def test_content_hash_depends_on_order_alone(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE", 4)
    rows = [(i, f"s{i}", f"text {i}" if i % 5 else None) for i in range(70)]
    of = lambda rows, n: metrics.dataset_manifest(spark.createDataFrame(rows, "order_hint int, source_id string, raw_text string").repartition(n)).collect()[0]
    first = of(rows, 1)
    assert first.documents == 70 and first.sources == 70 and of(rows, 7) == first == of(random.Random(1).sample(rows, 70), 3)
    swapped = [(1, *rows[0][1:]), (0, *rows[1][1:]), *rows[2:]]
    assert of(swapped, 3).content_hash not in (None, first.content_hash)
    assert of([(*r[:2], r[2] or "") for r in rows], 3).content_hash != first.content_hash
    assert metrics.content_hash(spark.createDataFrame([], "order_hint int, source_id string, raw_text string")).collect()[0][0] is None


def test_contradictions_on_hot_keys(spark):
    rng = random.Random(1)
    said = ["will live", "WILL DIE", "will live or will die", "is good", "is evil", "nothing", "will return", "will never return"]
    rows = [(f"o{i}", rng.choice(["a", "b", None]), rng.choice(said)) for i in range(90)]
    df = spark.createDataFrame(rows, "obligation_id string, category string, description string")
    n = gates.contradictions(df).count()
    assert n == gates.contradictions(df, cell=3).count() == sum(r.n for r in gates.contradiction_counts(df).collect()) / 2
    assert {r.finding_id for r in gates.contradictions(df).collect()} == {r.finding_id for r in gates.contradictions(df, cell=3).collect()}
    hot = spark.range(100_000).select(F.col("id").cast("string").alias("obligation_id"), F.lit("mystery").alias("category"), F.when(F.col("id") % 10 == 0, "he will die").otherwise("he will live").alias("description"))
    told = gates.contradiction_counts(hot).groupBy("n").count().collect()
    assert {(r.n, r["count"]) for r in told} == {(90_000, 10_000), (10_000, 90_000)}


def test_review_items_are_queued_once(spark, tmp_path):
    stores = Stores(spark, f"file://{tmp_path}")
    items = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "item_id string, description string")
    for ids in ("aab", "bc", "bc"):
        stores.append_new("review_queue", items(*ids), "item_id")
    assert sorted(r.item_id for r in stores.read("review_queue").collect()) == ["a", "b", "c"]


def test_contracts_over_json(spark):
    contract = [gates.Field("k", "integer", True), gates.Field("s", "string"), gates.Field("o.n", "number", True), gates.Field("any", "unknown")]
    texts = {
        '{"k": 1, "o": {"n": 1.5}}': [], '{"k": true, "o": {"n": 2}, "s": "x", "more": 1}': [], "{": ["Invalid JSON"], None: ["Invalid JSON"], "": ["Invalid JSON"],
        "[]": ["Missing required field: k", "Missing required field: o.n"], '{"k": null, "o": 5}': ["Field 'k' has wrong type: expected integer, got NoneType", "Missing required field: o.n"],
        '{"k": 1.5, "s": 2, "o": {"n": "1"}, "any": []}': ["Field 'k' has wrong type: expected integer, got float", "Field 's' has wrong type: expected string, got int", "Field 'o.n' has wrong type: expected number, got str"],
        '{"k": [1], "s": {}, "o": {"n": false}}': ["Field 'k' has wrong type: expected integer, got list", "Field 's' has wrong type: expected string, got dict"],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    assert [r.faults for r in gates.contract_faults(rows, "body", contract).orderBy("id").collect()] == list(texts.values())
    assert gates.contract_gate(rows, "body", contract, "id", "Row").count() == sum(map(len, texts.values()))
    assert gates.contract_faults(rows.limit(0), "body", contract).count() == 0 and gates.contract_faults(rows, "body", []).where("size(faults) > 0").count() == 3


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    from loreweave.streaming.firsts import running_firsts

    schema, log = "name string, at long, id long", KeyedLog(spark, f"file://{tmp_path}/log", ["name"])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
    run = lambda: running_firsts(stream, ["name"], f"file://{tmp_path}/log", f"file://{tmp_path}/check").awaitTermination()
    told = lambda: sorted((r["name"] or "", r.n, r.first_at, r.first_id) for r in log.read().collect())
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    write([("a", 5, 1), ("b", 4, 2), ("a", 3, 3), (None, 9, 4)])
    run()
    write([("a", 3, 2), ("c", 1, 9), ("b", 7, 5)])
    run()
    want = [("", 1, 9, 4), ("a", 3, 3, 2), ("b", 2, 4, 2), ("c", 1, 1, 9)]
    assert told() == want
    last = max((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert told() == want


def test_a_streams_state_calls_no_python_by_key(spark, tmp_path):
    from loreweave.streaming.firsts import running_firsts

    rows = spark.range(20_000).select((F.col("id") % 9_999).cast("string").alias("name"), (-F.col("id")).alias("at"), "id")
    rows.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    run = running_firsts(stream, ["name"], f"file://{tmp_path}/log", f"file://{tmp_path}/check")
    run.awaitTermination()
    assert [x["operatorName"] for x in run.lastProgress["stateOperators"]] == ["stateStoreSave"]
    told = {r["name"]: (r.n, r.first_at, r.first_id) for r in KeyedLog(spark, f"file://{tmp_path}/log", ["name"]).read().collect()}
    assert told == {str(i): (2 + (i < 2), -(i + 9_999 * (1 + (i < 2))), i + 9_999 * (1 + (i < 2))) for i in range(9_999)}


def test_a_lookup_opens_its_buckets_alone(spark, tmp_path):
    from loreweave.sources.lookup import LookupTable

    table = LookupTable(spark, f"file://{tmp_path}/t", "k", buckets=16)
    table.write(spark.range(500).select(F.concat(F.lit("p"), (F.col("id") % 400).cast("string")).alias("k"), F.col("id").alias("v")))
    found = table.get("p7", "p399", "nothing")
    assert sorted((r.k, r.v) for r in found.collect()) == [("p399", 399), ("p7", 7), ("p7", 407)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters")[1] and "In(k, " in plan.split("PushedFilters")[1]
    read = next(m.value() for m in (x._2() for x in _metrics(spark, found)) if m.name().isDefined() and m.name().get() == "number of files read")
    assert 0 < read <= 3
    assert sorted(r.v for r in table.among(spark.createDataFrame([("p7",), ("p7",), ("x",)], "k string")).collect()) == [7, 407]


def _metrics(spark, df):
    """The metrics of a scan that ran."""
    def leaf(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return leaf(plan.executedPlan())
        return leaf(plan.children().head()) if plan.children().nonEmpty() else plan

    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    it = leaf(plan).metrics().iterator()
    while it.hasNext():
        yield it.next()


def test_a_run_that_breaks_off_leaves_a_finding(spark, tmp_path, monkeypatch):
    import pytest

    from loreweave.plans import run

    def broken(*_):
        raise ValueError("no such thing")

    monkeypatch.setattr(run, "tables", broken)
    docs = spark.createDataFrame([("a", 0, "x")], "source_id string, order_hint int, raw_text string")
    with pytest.raises(ValueError, match="no such thing"):
        run.run(docs, f"file://{tmp_path}/o")
    got = spark.read.parquet(f"file://{tmp_path}/o/findings").collect()
    assert [(r.severity, r.category, r.message) for r in got] == [("error", "pipeline_error", "no such thing")] and got[0].finding_id.startswith("error_2")
