"""Registered queries: the operators over the driver's tables and over the small corpus."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.lexicons import MENTION_RULES
from loreweave.functions.lineage import cut, shared_dir, written
from loreweave.functions.text import digest, jaccard, recency, tokens
from loreweave.operators import dedupe, entities, gates, graph, incremental, intervals, linking, metrics, obligations, planning
from loreweave.operators.segment import segment
from loreweave.operators.wiki import event_class, event_obligations, participants, relationship_class
from loreweave.plans import corpus
from loreweave.plans.run import Config, tables
from loreweave.plans.upkeep import Upkeep
from loreweave.sources import documents
from loreweave.sources.artifacts import Artifacts
from loreweave.sources.keyed_log import KeyedLog
from loreweave.sources.lookup import LookupTable
from loreweave.sources.stores import Stores
from loreweave.streaming.firsts import running_firsts

#: Texts that keep a contract, or do not, each in its way.
FAULTS = ('{"k": "x"}', "{}", '{"k": null}', '{"k": 1.5}', '{"k": true}', "not json", "[1]", '{"k": {"y": 1}}', '{"k": 2, "z": {"y": [1]}}', '{"k": 3, "z": {"y": {}}}', "", '{"k": [], "z": {"y": "s"}}', '{"k": 4, "z": 5}')
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Vehicles need two mentions here, as the corpus is small.
CONFIG = Config(vehicle_min_mentions=2)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_corpus_tables: dict[str, dict[str, DataFrame]] = {}
_story_tables: dict[str, dict[str, DataFrame]] = {}


def corpus_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of the small corpus, computed once for an application and cut off from their lineage."""
    app = spark.sparkContext.applicationId
    if app not in _corpus_tables:
        _corpus_tables.clear()
        _corpus_tables[app] = tables(corpus.docs(spark), CONFIG, keep=lambda name, rows: cut(rows.coalesce(1)))
    return _corpus_tables[app]


#: Queries that are answered over a text for each document too, at the size of the driver's table.
STORY = (
    "corpus_passages", "mentions_vehicle", "mentions_capitalized", "entities", "alias_table", "entity_with_aliases", "entity_anchors", "link_entities", "obl_prophecy", "obl_chekhov", "obl_mystery",
    "obl_plot_thread", "evidence_index", "anchors_by_passage", "resolve_evidence", "stats", "event_participants", "event_location", "events", "event_obligations", "relationships", "graph_nodes", "graph_properties", "graph_edges",
    "entity_context", "g_events_for_entity", "g_timeline", "g_evidence_for_relationship", "outline_beats", "convergence", "coverage_map", "reveal_ledger", "twist_bank", "dossier_lines",
    "mentions_title", "mentions_house", "mentions_artifact", "mentions_place", "mentions_epithet", "entities_overridden", "override_assign", "passage_recency", "obligations_by_category", "referential_integrity", "evidence_gate",
    "integrity_report", "event_class", "relationship_class", "graph_uniqueness", "g_active_during", "g_obligations_resolved", "bridging_beats",
)


def story_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables over a text for each document, each computed when it is first asked for, once for an application and folder."""
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if key not in _story_tables:
        _story_tables.clear()
        _story_tables[key] = tables(corpus.story(spark, sf_dir), CONFIG, keep=lambda name, rows: written(rows), lazy=True)
    return _story_tables[key]


def of_corpus(name: str):
    """Registers a query over the tables of the small corpus."""

    def register(f: Callable[[dict[str, DataFrame], SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(corpus_tables(spark), spark)
        if name in STORY:
            QUERIES[f"{name}_story"] = lambda spark, sf_dir: f(story_tables(spark, sf_dir), spark)
        return f

    return register


def _joined(rows: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        rows = rows.withColumn(a, F.array_join(a, ";"))
    return rows


# Over the driver's tables, at their size.


@query
def segment_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(documents.documents_table(spark, sf_dir), r"\n").select("passage_id", "source_id", "paragraph_index", "text")


@query
def passage_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(documents.documents_table(spark, sf_dir), r"\n").select("passage_id", "char_start", "char_end")


@query
def entities_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named entities of the documents, how often and where first: the flagship."""
    passages = segment(documents.documents_table(spark, sf_dir), r"\n")
    return entities.entities(entities.mentions(passages), CONFIG.vehicle_min_mentions)


@query
def mentions_capitalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.mentions(segment(documents.documents_table(spark, sf_dir), r"\n"), [r for r in MENTION_RULES if r.seq == 6])
    return found.select("passage_id", "canonical_name", "char_start", "char_end")


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.documents_table(spark, sf_dir)
    return d.agg(F.count("*").alias("documents"), F.sum(F.length("raw_text")).cast("long").alias("characters"), F.countDistinct("source_id").alias("sources"))


@query
def find_duplicates_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part descriptions that share most of their words, by the blocked join."""
    none = F.array().cast("array<string>")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type").alias("description")).distinct()
    p = p.select(F.col("description").alias("obligation_id"), F.lit("mystery").alias("category"), "description", none.alias("related_entity_ids"), none.alias("evidence_anchor_ids"))
    return dedupe.find_duplicates(p, 0.6).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query
def label_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document exists, and documents without a label, as integrity counters."""
    d, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gates.integrity_report({"label_document": (n, "doc_id", d, "doc_id"), "document_label": (d, "doc_id", n, "doc_id")})


@query
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of page addresses as source ids."""
    return documents.source_ids(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path")))


@query
def speaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as passages with natural order: turns and characters by speaker, and each speaker's first turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("characters"), F.min("turn").alias("first_turn"))


@query
def link_names_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long capitalised words of the documents as names, and the paragraphs that hold them in any case."""
    docs = documents.documents_table(spark, sf_dir)
    words = docs.select(F.explode(F.regexp_extract_all("raw_text", F.lit("[A-Z][a-z]{8,}"), F.lit(0))).alias("canonical_name")).distinct()
    named = cut(words.select(digest("name_", 12, F.col("canonical_name")).alias("entity_id"), "canonical_name", F.lit("person").alias("entity_type")))
    return linking.links(segment(docs, r"\n"), named).select("passage_id", "entity_id", "canonical_name", "position")


@query
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents as obligations, their commas as evidence: what each is part of after merging, what took it in, and at which similarity."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_id"), "lang", "source")
    p = segment(documents.documents_table(spark, sf_dir), r"\n").join(d, "source_id")
    anchors = F.transform(F.sequence(F.lit(1), F.size(F.split("text", ","))), lambda i: F.concat_ws(":", "passage_id", i.cast("string")))
    m = dedupe.merges(p.select(
        F.col("passage_id").alias("obligation_id"), F.col("lang").alias("category"), F.col("text").alias("description"), anchors.alias("evidence_anchor_ids"),
        F.lit(None).cast("string").alias("resolution_passage_id"), F.array_compact(F.array("source")).alias("related_entity_ids"),
    ), 0.8)
    into = m.edges.select(F.col("target").alias("obligation_id"), F.col("source").alias("taken_by"), F.round("weight", 6).alias("weight"))
    return m.owners.join(into, "obligation_id", "left")


@query
def content_ranges_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of ranges of all paragraphs in order."""
    p = segment(documents.documents_table(spark, sf_dir), r"\n")
    return metrics.content_ranges(p.select("order_hint", "paragraph_index", F.col("passage_id").alias("source_id"), F.col("text").alias("raw_text")), "order_hint", "paragraph_index")


@query
def dataset_manifest_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dataset_manifest(documents.documents_table(spark, sf_dir))


@query
def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as six writes of a log by user and properties, the later days first and one of them twice, with a new base
    halfway: each key's last event, unless that is an error, which deletes the key."""
    log = KeyedLog(spark, f"{shared_dir(spark)}/events-log-{uuid.uuid4().hex}", ["user_id", "props"])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.least(F.floor((F.dayofmonth("ts") - 1) / 5).cast("int") + 1, F.lit(6)))
    for n in (3, 2, 1, 2):
        log.write(n, e.where(F.col("part") == n).drop("part"), ["ts", "event_id"], gone="event_type = 'error'")
    log.compact()
    for n in (6, 5, 4, 1):
        log.write(n, e.where(F.col("part") == n).drop("part"), ["ts", "event_id"], gone="event_type = 'error'")
    log.vacuum()
    return log.read().select("user_id", "props", "event_id", "event_type", "value")


@query
def contradictions_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents with a prediction each: how many of their language contradict it. Half of all say one phrase."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_id"), "lang")
    p = segment(documents.documents_table(spark, sf_dir), r"\n").join(d, "source_id")
    said = F.element_at(F.array(*[F.lit(x) for x in ("will live", "Will Live", "will die", "will live, will die", "is good", "is evil", "is true", "")]), (F.length("text") % 8 + 1).cast("int"))
    return gates.contradiction_counts(p.select(F.col("passage_id").alias("obligation_id"), F.col("lang").alias("category"), F.concat_ws(" ", "text", said).alias("description")))


@query
def artifact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a JSON artifact, read back by name: nulls and every character of every text stay."""
    root = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    Stores(spark, root).write_json("documents.jsonl", d)
    return Artifacts(spark, root).records("documents", d.schema).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source")


@query
def passages_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two paragraphs of every labelled document, from a table of all paragraphs laid out by their ids."""
    table = LookupTable(spark, f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}", "passage_id")
    table.write(segment(documents.documents_table(spark, sf_dir), r"\n").select("passage_id", "source_id", "paragraph_index", "text"))
    asked = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.explode(F.array(*[F.concat(F.col("doc_id").cast("string"), F.lit(f":{i}")) for i in (0, 1)])).alias("passage_id"))
    return table.among(asked)


@query
def stream_firsts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, the last batch of which is run twice: how often each user had each properties, and when first."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    e.repartition(3, "id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run = lambda: running_firsts(stream, ["user_id", "props"], f"{at}/log", f"{at}/checkpoint").awaitTermination()
    run()
    jvm = spark.sparkContext._jvm
    commits = jvm.org.apache.hadoop.fs.Path(f"{at}/checkpoint/commits")
    fs = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(x.getPath().getName()) for x in fs.listStatus(commits) if x.getPath().getName().isdigit())
    fs.delete(jvm.org.apache.hadoop.fs.Path(commits, str(last)), False)
    run()
    return KeyedLog(spark, f"{at}/log", ["user_id", "props"]).read()


@query
def contract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, and as many with a fault made beside each, against a contract: findings by row."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    made = F.element_at(F.array(*[F.lit(x) for x in FAULTS]), (F.col("event_id") % len(FAULTS) + 1).cast("int"))
    both = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("row_id"), "props").unionByName(e.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("row_id"), made.alias("props")))
    return gates.contract_gate(both, "props", [gates.Field("k", "integer", True), gates.Field("z.y", "array")], "row_id", "Event")


_upkeep: dict[str, Upkeep] = {}


def upkeep(spark: SparkSession, sf_dir: str, linked: bool = True) -> Upkeep:
    """Stores loaded with an earlier version of the annotated documents and then brought up to date, once for an application and
    folder; with links, unless none are asked for and none are there."""
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if key not in _upkeep or linked and not _upkeep[key].linked:
        before, changed, removed = corpus.annotated_before(spark, sf_dir)
        stores = Upkeep(spark, f"{shared_dir(spark)}/upkeep-{uuid.uuid4().hex}", vehicle_min=CONFIG.vehicle_min_mentions, linked=linked)
        stores.load(before)
        stores.update(1, changed, removed)
        _upkeep.clear()
        _upkeep[key] = stores
    return _upkeep[key]


@query
def inc_entities_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after an incremental update, as a whole run over the later version has them."""
    return upkeep(spark, sf_dir, linked=False).entities()


@query
def inc_links_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after an incremental update, as a whole run over the later version has them."""
    return upkeep(spark, sf_dir).links()


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events.ts by user, parted by six hours of silence; each user's last one is still open."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    own = Window.partitionBy("user_id").orderBy("at")
    e = e.withColumn("session", F.sum(F.when(F.col("at") - F.lag("at").over(own) <= 6 * 3600 * 1_000_000, 0).otherwise(1)).over(own.rangeBetween(Window.unboundedPreceding, 0)))
    s = e.groupBy("user_id", "session").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return s.withColumn("last", F.when(F.col("session") < F.max("session").over(Window.partitionBy("user_id")), F.col("last")))


@query
def sessions_open_at_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase, how many sessions are open when it happens, both ends included, and the earliest begun of these."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    met = points.join(intervals.open_at(_sessions(spark, sf_dir), points), "at")
    return met.groupBy("event_id").agg(F.sum("n_open").alias("n_open"), F.min("earliest").alias("earliest"))


@query
def relationships_active_at_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as relationships labelled by their day, with start and end as text, and each day's beginning, noon and label at which they are active."""
    text = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm")
    s = _sessions(spark, sf_dir).select(F.concat_ws(":", "user_id", "session").alias("relationship_id"), text("first").alias("time_start"), text("last").alias("time_end"))
    related = s.select("relationship_id", F.struct(F.substring("time_start", 1, 10).alias("time_label"), "time_start", "time_end").alias("story_time"))
    day = F.date_format("ts", "yyyy-MM-dd")
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.array(day, F.concat(day, F.lit(" 00:00")), F.concat(day, F.lit(" 12:00")))).alias("time_value"))
    return intervals.active_at(related, times)


# Over the small corpus.


@of_corpus("corpus_passages")
def _(t, spark):
    return t["passages"]


def _mention_query(name: str, seq: int) -> None:
    @of_corpus(name)
    def _(t, spark):
        return t["mentions"].where(F.col("rule_seq") == seq).select("passage_id", "canonical_name", "entity_type", "char_start", "char_end", "excerpt")


for _name, _seq in (("mentions_title", 1), ("mentions_house", 2), ("mentions_artifact", 3), ("mentions_place", 4), ("mentions_vehicle", 5), ("mentions_capitalized", 6), ("mentions_epithet", 7)):
    _mention_query(_name, _seq)


@of_corpus("entities")
def _(t, spark):
    return t["entities"]


@of_corpus("entities_overridden")
def _(t, spark):
    ignored = spark.createDataFrame([("Far Isles",)], "canonical_name string")
    forced = spark.createDataFrame([("Mira Vale", "entity_mira")], "canonical_name string, entity_id string")
    return entities.entities(entities.mentions(t["passages"], ignored=ignored), CONFIG.vehicle_min_mentions, forced)


@of_corpus("alias_table")
def _(t, spark):
    return t["aliases"]


@of_corpus("override_assign")
def _(t, spark):
    forced = spark.createDataFrame([("The Grey Gull", "entity_gull"), ("Nobody", "entity_none")], "canonical_name string, entity_id string")
    return entities.entities(t["mentions"], 99, forced).where("entity_id = 'entity_gull' or entity_type = 'vehicle'")


@of_corpus("entity_with_aliases")
def _(t, spark):
    return entities.with_aliases(t["entities"], t["aliases"])


@of_corpus("entity_anchors")
def _(t, spark):
    return entities.entity_anchors(t["mentions"], t["entities"])


@of_corpus("link_entities")
def _(t, spark):
    return t["links"]


def _obligation_query(name: str, category: str) -> None:
    @of_corpus(name)
    def _(t, spark):
        return _joined(t["obligations"].where(F.col("category") == category).drop("seq", "resolution_passage_id"), "evidence_anchor_ids", "related_entity_ids")


for _name, _category in (("obl_prophecy", "prophecy_vision"), ("obl_chekhov", "chekhov_gun"), ("obl_mystery", "mystery"), ("obl_plot_thread", "plot_thread")):
    _obligation_query(_name, _category)


@of_corpus("evidence_index")
def _(t, spark):
    return obligations.evidence_index(t["obligations"])


@of_corpus("anchors_by_passage")
def _(t, spark):
    return _joined(t["by_passage"], "anchor_ids")


@of_corpus("resolve_evidence")
def _(t, spark):
    return obligations.resolve_evidence(t["obligations"], t["anchors"])


@of_corpus("jaccard")
def _(t, spark):
    o = t["obligations"].select("obligation_id", tokens(F.col("description")).alias("tokens"))
    a, b = o.select(F.col("obligation_id").alias("i"), F.col("tokens").alias("x"), F.explode("tokens").alias("k")), o.select(F.col("obligation_id").alias("j"), F.col("tokens").alias("y"), F.explode("tokens").alias("k"))
    return a.join(b, "k").where("i < j").select("i", "j", "x", "y").distinct().select("i", "j", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@of_corpus("find_duplicates")
def _(t, spark):
    return dedupe.find_duplicates(t["obligations"], 0.5).select("i", "j", F.round("similarity", 6).alias("similarity"))


@of_corpus("similarity")
def _(t, spark):
    """Similarity of pairs that can reach 0.3, the cost of a shared word and the bonuses."""
    return dedupe.find_duplicates(t["obligations"], 0.3).select("i", "j", F.round("similarity", 6).alias("similarity"))


@of_corpus("dedupe_rate")
def _(t, spark):
    rows = t["obligations"].drop("seq")
    return dedupe.dedupe_rate(rows, dedupe.merge_obligations(rows, 0.5)).withColumn("dedupe_rate", F.round("dedupe_rate", 6))


@of_corpus("passage_recency")
def _(t, spark):
    extra = spark.createDataFrame([("b:9",), ("b:10",), ("passage-9",), ("passage-10",), ("a_7-x",)], "passage_id string")
    return t["passages"].select("passage_id").unionByName(extra).select("passage_id", recency(F.col("passage_id")).alias("recency"))


@of_corpus("merge_obligations")
def _(t, spark):
    return _joined(dedupe.merge_obligations(t["obligations"].drop("seq"), 0.5), "evidence_anchor_ids", "related_entity_ids", "absorbed")


@of_corpus("obligations_by_category")
def _(t, spark):
    return metrics.by_category(t["obligations"])


@of_corpus("stats")
def _(t, spark):
    return metrics.stats(t["obligations"], t["entities"])


@of_corpus("metrics")
def _(t, spark):
    return metrics.metrics(t["passages"], t["obligations"], t["entities"], t["findings"])


@of_corpus("contradictions")
def _(t, spark):
    return gates.contradictions(t["obligations"])


def _broken(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The corpus' tables with rows missing: no anchors of one source, no persons, and an obligation without evidence."""
    lost = t["obligations"].withColumn("evidence_anchor_ids", F.when(F.col("category") == "plot_thread", F.array().cast("array<string>")).otherwise(F.col("evidence_anchor_ids")))
    return t | {"anchors": t["anchors"].where(~F.col("passage_id").startswith("book2")), "entities": t["entities"].where("entity_type <> 'person'"), "passages": t["passages"].where("source_id <> 'appendix'"), "obligations": lost}


@of_corpus("referential_integrity")
def _(t, spark):
    b = _broken(t)
    return gates.referential_integrity(b["passages"], b["anchors"], b["entities"], b["aliases"], b["obligations"])


@of_corpus("evidence_gate")
def _(t, spark):
    return gates.evidence_gate(_broken(t)["obligations"])


@of_corpus("gate_verdict")
def _(t, spark):
    b = _broken(t)
    return gates.verdict(gates.evidence_gate(b["obligations"]).unionByName(gates.contradictions(t["obligations"])))


@of_corpus("integrity_report")
def _(t, spark):
    b = _broken(t)
    used = b["obligations"].select("obligation_id", F.explode("evidence_anchor_ids").alias("anchor_id"))
    related = b["obligations"].select(F.explode("related_entity_ids").alias("entity_id"))
    nodes = t["nodes"].where("label <> 'Event'").select(F.concat_ws(":", "label", "node_id").alias("key"))
    return gates.integrity_report({
        "obligation_anchor": (used, "anchor_id", b["anchors"], "anchor_id"),
        "obligation_last_seen": (b["obligations"], "last_seen_passage_id", b["passages"], "passage_id"),
        "obligation_resolution": (b["obligations"], "resolution_passage_id", b["passages"], "passage_id"),
        "obligation_entity": (related, "entity_id", b["entities"], "entity_id"),
        "alias_entity": (b["aliases"], "entity_id", b["entities"], "entity_id"),
        "anchor_passage": (b["anchors"], "passage_id", b["passages"], "passage_id"),
        "entity_first_seen": (b["entities"], "first_seen_passage", b["passages"], "passage_id"),
        **{f"edge_{end}": (t["edges"].select(F.concat_ws(":", f"{end}_label", f"{end}_id").alias("key")), "key", nodes, "key") for end in ("source", "target")},
    })


@of_corpus("schema_gate")
def _(t, spark):
    rows = spark.createDataFrame([("a", "1", "0.5"), ("b", "x", "0.5"), ("c", None, "high"), ("d", "4", None)], "row_id string, n string, share string")
    return gates.schema_gate(rows, T.StructType([T.StructField("n", T.IntegerType(), False), T.StructField("share", T.DoubleType(), True)]), "row_id", "Row")


@of_corpus("review_items")
def _(t, spark):
    return gates.review_items(gates.contradictions(t["obligations"]).unionByName(gates.evidence_gate(_broken(t)["obligations"])))


@of_corpus("missing_artifacts")
def _(t, spark):
    required = spark.createDataFrame([("canon/passages",), ("kb/entities",), ("qa/findings",)], "path string")
    return gates.missing_artifacts(required, spark.createDataFrame([("kb/entities",)], "path string"))


@of_corpus("event_class")
def _(t, spark):
    return event_class(t["passages"]).select("passage_id", "event_type")


@of_corpus("relationship_class")
def _(t, spark):
    return relationship_class(t["passages"]).select("passage_id", "relation_type")


@of_corpus("event_participants")
def _(t, spark):
    found = event_class(t["passages"]).select("passage_id", "event_type").join(participants(t["links"]), "passage_id")
    return found.select("passage_id", "event_type", F.array_join(F.transform("who", lambda w: w["entity_id"]), ";").alias("participant_entity_ids"))


@of_corpus("event_location")
def _(t, spark):
    found = event_class(t["passages"]).select("passage_id", "event_type").join(participants(t["links"]), "passage_id", "left")
    return found.select("passage_id", "event_type", F.col("place.entity_id").alias("location_entity_id"))


@of_corpus("event_obligations")
def _(t, spark):
    found = event_obligations(t["events"].select("event_id", F.col("evidence_anchor_ids").alias("anchor_ids")), t["obligations"])
    return _joined(found, "obligation_ids")


@of_corpus("events")
def _(t, spark):
    return _joined(t["events"].drop("story_time", "story_order", "description"), "participant_entity_ids", "related_obligation_ids", "evidence_anchor_ids")


@of_corpus("relationships")
def _(t, spark):
    return _joined(t["relationships"].drop("story_time", "story_order"), "evidence_anchor_ids")


@of_corpus("graph_nodes")
def _(t, spark):
    return t["nodes"].select("label", "node_id", "story_order_index", "story_order_source_id", "story_order_passage_id")


@of_corpus("graph_properties")
def _(t, spark):
    """What every node holds, whole."""
    return t["nodes"].select("label", "node_id", "properties")


@of_corpus("graph_edges")
def _(t, spark):
    return t["edges"]


@of_corpus("graph_uniqueness")
def _(t, spark):
    return graph.uniqueness(t["nodes"].unionByName(t["nodes"].where("label = 'Event'")), t["edges"])


@of_corpus("g_events_for_entity")
def _(t, spark):
    return graph.events_for_entity(t["edges"], t["events"])


@of_corpus("entity_context")
def _(t, spark):
    return graph.entity_context(t["events"], t["relationships"], t["obligations"])


@of_corpus("g_active_during")
def _(t, spark):
    return graph.active_during(t["relationships"], "unknown")


@of_corpus("g_obligations_resolved")
def _(t, spark):
    return graph.obligations_resolved(t["edges"], t["obligations"])


@of_corpus("g_evidence_for_relationship")
def _(t, spark):
    return graph.evidence_for_relationship(t["edges"], t["anchors"], t["passages"])


@of_corpus("g_timeline")
def _(t, spark):
    return graph.timeline(t["edges"], t["events"], t["relationships"])


@of_corpus("outline_beats")
def _(t, spark):
    return planning.outline_beats(t["obligations"], t["entities"])


@of_corpus("convergence")
def _(t, spark):
    return planning.convergence(planning.outline_beats(t["obligations"], t["entities"]))


@of_corpus("bridging_beats")
def _(t, spark):
    return planning.bridging_beats(planning.convergence(planning.outline_beats(t["obligations"], t["entities"])))


@of_corpus("coverage_map")
def _(t, spark):
    return planning.coverage_map(t["obligations"], planning.outline_beats(t["obligations"], t["entities"]).where("book_number = 7"))


@of_corpus("reveal_ledger")
def _(t, spark):
    return planning.reveal_ledger(t["obligations"], t["anchors"])


@of_corpus("twist_bank")
def _(t, spark):
    return planning.twist_bank(t["obligations"], t["anchors"])


@of_corpus("dossier_lines")
def _(t, spark):
    return planning.dossier_lines(t["obligations"], obligations.resolve_evidence(t["obligations"], t["anchors"]))


@of_corpus("inc_payload")
def _(t, spark):
    return incremental.payload(spark.createDataFrame([("book2_ch01",)], "source_id string"), t)


@of_corpus("inc_graph")
def _(t, spark):
    r = incremental.touched(spark.createDataFrame([("book2_ch01",)], "source_id string"), t)
    return graph.graph_edges(r["anchors"], r["entities"], r["obligations"], r["events"], r["relationships"]).groupBy("rel_type", "source_label", "target_label").agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id")).distinct()


@query
def inc_payload_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labelled documents touch, of the tables over all."""
    return incremental.payload(_labelled(spark, sf_dir), story_tables(spark, sf_dir))


@query
def inc_graph_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of what the labelled documents touch."""
    r = incremental.touched(_labelled(spark, sf_dir), story_tables(spark, sf_dir))
    return graph.graph_edges(r["anchors"], r["entities"], r["obligations"], r["events"], r["relationships"])


PATHS = ("/in/book1_ch01.txt", "/in/bookish_x.md", "/in/book_intro.txt", "/in/book2_7.MD", "/in/notes.markdown", "/in/scan.pdf", "/in/image.png", "/out/book1_ch01.txt", "/in/.txt")


def _paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


@query
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.filename_metadata(_paths(spark))


@query
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as files, read back with line ends made equal."""
    return documents.scan_documents(spark, corpus.files(spark)).drop("source_path", "order_hint")


@query
def folder_order_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.scan_documents(spark, corpus.files(spark)).select("source_id", F.col("order_hint").cast("long").alias("order_hint"))


@query
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.changed_files(_paths(spark), "/in")


UPLOADS = ("a.txt", "a.txt", "b.MD", "a.txt", "b.MD", "c (2).md", "c.md", "c.md", "noend", "noend", ".txt")
STORED = ("a.txt", "a (2).txt", "a (4).txt", "c.md", "b (x).MD")


@query
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame(list(enumerate(UPLOADS)), "upload_id int, name string")
    return documents.free_names(wanted, spark.createDataFrame([(x,) for x in STORED], "name string"))


@query
def source_ids_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.source_ids(_paths(spark))
