"""An incremental update gives what a whole run gives, and opens only the shards that it must."""

from __future__ import annotations

import random

from loreweave.operators.entities import entities, mentions
from loreweave.operators.linking import links
from loreweave.operators.segment import segment
from loreweave.plans.upkeep import Upkeep

FIRST, LAST = ["Mira", "Tor", "Ann", "Zed", "Ola"], ["Vale", "Hale", "Rook", "Fenn"]
SCHEMA = "source_id string, order_hint int, raw_text string"


def _doc(rng, i):
    said = lambda: f"{rng.choice(FIRST)} {rng.choice(LAST)} saw the Grey Gull"
    text = "\n\n".join(rng.choice([f"{said()}. {said()}, aboard.", f"they met {rng.choice(FIRST).lower()} {rng.choice(LAST).lower()}", "the Grey Gull sailed", "nothing at all", ""]) for _ in range(rng.randint(0, 4)))
    return (f"s{i}", rng.randint(0, 5), rng.choice([text, text, text, None]))


def _whole(spark, docs):
    passages = segment(spark.createDataFrame(list(docs.values()), SCHEMA))
    named = entities(mentions(passages), 3)
    return sorted(map(tuple, named.collect())), sorted(map(tuple, links(passages, named).collect()))


def _kept(stores):
    return sorted(map(tuple, stores.entities().collect())), sorted(map(tuple, stores.links().collect()))


def test_updates_equal_a_whole_run(spark, tmp_path):
    rng = random.Random(1)
    docs = {f"s{i}": _doc(rng, i) for i in range(14)}
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=4)
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    assert _kept(stores) == _whole(spark, docs)
    for version in (1,):
        changed = {k: _doc(rng, k[1:]) for k in [*rng.sample(sorted(docs), 3), f"s{20 + version}"]}
        gone = [k for k in rng.sample(sorted(docs), 3) if k not in changed]
        docs = {k: v for k, v in docs.items() if k not in gone} | changed
        update = lambda: stores.update(version, spark.createDataFrame(list(changed.values()), SCHEMA), spark.createDataFrame([(k,) for k in gone], "source_id string"))  # noqa: B023, E731
        update()
        assert _kept(stores) == _whole(spark, docs)
        update()  # again: nothing happens
        assert stores.stores.version == version
    again = Upkeep(spark, f"file://{tmp_path}/u", shards=4)
    assert _kept(again) == _whole(spark, docs)


def test_a_first_mention_that_is_taken_back(spark, tmp_path):
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=4)
    docs = {k: (k, o, "Mira Vale spoke.") for k, o in (("a", 0), ("b", 1), ("c", 2))}
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    stores.update(1, spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",)], "source_id string"))
    assert [(r.first_seen_passage, r.mention_count) for r in stores.entities().collect()] == [("b:0", 2)]
    stores.update(2, spark.createDataFrame([("b", 9, "Mira Vale. and Mira Vale")], SCHEMA))
    assert [(r.first_seen_passage, r.mention_count) for r in stores.entities().collect()] == [("c:0", 3)]
    stores.update(3, spark.createDataFrame([("b", 0, "mira vale"), ("c", 0, None)], SCHEMA))
    assert stores.entities().count() == 0 and stores.links().count() == 0
    stores.update(4, spark.createDataFrame([("d", 0, "Mira Vale")], SCHEMA))  # also found where it stood all the time
    assert sorted(r.passage_id for r in stores.links().collect()) == ["b:0", "d:0"]


def test_only_changed_shards_are_read(spark, tmp_path):
    from pyspark.sql import functions as F

    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=8)
    stores.load(spark.createDataFrame([(f"s{i}", i, f"Mira Vale met Tor Hale{'.' * i}") for i in range(40)], SCHEMA))
    one = spark.createDataFrame([("s3",)], "source_id string").select(stores.stores.shard(F.col("source_id")).alias("shard")).collect()[0]["shard"]
    assert {f.split("shard=")[1].split("/")[0] for f in stores.stores.read("counts", [one]).inputFiles()} == {str(one)}
    stores.update(1, spark.createDataFrame([("s3", 3, "Mira Vale met nobody")], SCHEMA))
    kept = {f.split("counts/version=")[1].split("/part")[0] for f in stores.stores.read("counts").inputFiles()}
    assert f"1/shard={one}" in kept and sum(k.startswith("1/") for k in kept) == 1 and sum(k.startswith("0/") for k in kept) == len(kept) - 1


def test_a_version_that_broke_off_is_not_seen(spark, tmp_path):
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=4)
    docs = {"a": ("a", 0, "Mira Vale."), "b": ("b", 1, "Tor Hale.")}
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    spark.createDataFrame([("x", "Ola Rook", 1)], "source_id string, canonical_name string, n int").write.parquet(f"file://{tmp_path}/u/counts/version=1/shard=0")
    again = Upkeep(spark, f"file://{tmp_path}/u", shards=4)
    assert _kept(again) == _whole(spark, docs)
    again.update(1, spark.createDataFrame([("a", 0, "Ann Fenn.")], SCHEMA))
    assert _kept(again) == _whole(spark, docs | {"a": ("a", 0, "Ann Fenn.")})


def test_entities_need_no_links(spark, tmp_path, monkeypatch):
    import pytest

    from loreweave.plans import upkeep

    monkeypatch.setattr(upkeep, "links", lambda *a, **k: pytest.fail("links were made"))
    rng = random.Random(3)
    docs = {f"s{i}": _doc(rng, i) for i in range(12)}
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=4, linked=False)
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    changed = {k: _doc(rng, k[1:]) for k in [*rng.sample(sorted(docs), 3), "s30"]}
    stores.update(1, spark.createDataFrame(list(changed.values()), SCHEMA), spark.createDataFrame([("s5",)], "source_id string") if "s5" not in changed else None)
    docs = {k: v for k, v in docs.items() if k != "s5" or k in changed} | changed
    assert sorted(map(tuple, stores.entities().collect())) == _whole(spark, docs)[0]
    with pytest.raises(ValueError):
        stores.links()


def _tables(monkeypatch):
    """Columns of the tables that an upkeep makes beside its stores."""
    from loreweave.plans import upkeep

    made, written = [], upkeep.written
    monkeypatch.setattr(upkeep, "written", lambda df: (made.append(df.columns), written(df))[1])
    return made


def test_entities_keep_no_texts(spark, tmp_path, monkeypatch):
    made, rng = _tables(monkeypatch), random.Random(4)
    docs = {f"s{i}": _doc(rng, i) for i in range(8)}
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=4, linked=False)
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    docs["s2"] = ("s2", 0, "Ann Fenn saw the Grey Gull.")
    stores.update(1, spark.createDataFrame([docs["s2"]], SCHEMA))
    assert not [x for x in made if "text" in x] and sorted(p.name for p in (tmp_path / "u").iterdir()) == ["counts", "manifests", "names"]
    assert sorted(map(tuple, stores.entities().collect())) == _whole(spark, docs)[0]


def test_an_earlier_version_shuffles_no_texts(spark, tmp_path):
    from loreweave.plans import corpus

    d = [(i, f"Text {i}." if i % 7 else None) for i in range(30)]
    spark.createDataFrame(d, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = [(i, q, t) for i, q, t in [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, None, 0), (6, 1, None), (6, 0, 0), (7, 1, 0)]]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, changed, removed = corpus.annotated_before(spark, str(tmp_path))
        for rows in (before, changed):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and plan.count("FileScan parquet") == 2  # texts and labels, once each
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    now = {r.source_id: r for r in corpus.annotated(spark, str(tmp_path)).collect()}
    old, new, gone = {r.source_id: r for r in before.collect()}, {r.source_id: r for r in changed.collect()}, {r.source_id for r in removed.collect()}
    assert before.count() == len(old) and set(new) == {"d2", "d3", "d4", "d6"} and gone == {"x1", "x3", "x7"}
    assert set(old) == {k for k in now if k not in ("d3", "d4")} | gone and {k: r for k, r in old.items() if k not in gone} | new == now | {}
    assert all(old[f"x{k[1:]}"].raw_text == now[f"d{k[1:]}"].raw_text and old[k].order_hint == -1 for k in gone)
    assert {k for k in old if k not in gone and old[k] != now[k]} == {"d2", "d6"}


def test_passages_lie_in_the_stores_alone(spark, tmp_path, monkeypatch):
    made, rng = _tables(monkeypatch), random.Random(5)
    docs = {f"s{i}": _doc(rng, i) for i in range(8)}
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=4)
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    assert not [x for x in made if "text" in x]
    assert _kept(stores) == _whole(spark, docs)


def test_what_stays_is_not_shuffled(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    dealt, hint = [], DataFrame.hint
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *a: (dealt.append((self.columns, self.count())) if name == "rebalance" else None, hint(self, name, *a))[1])
    stores = Upkeep(spark, f"file://{tmp_path}/u", shards=2)
    docs = {f"s{i}": (f"s{i}", i, f"Mira Vale met Tor Hale.\n\nNumber {i}") for i in range(20)}
    stores.load(spark.createDataFrame(list(docs.values()), SCHEMA))
    dealt.clear()
    docs["s3"] = ("s3", 3, "Ann Fenn met Mira Vale.")
    stores.update(1, spark.createDataFrame([docs["s3"]], SCHEMA))
    assert [n for columns, n in dealt if "text" in columns] == [1]
    assert _kept(stores) == _whole(spark, docs)
