"""A whole run: documents to stores, with the gate's verdict before anything is exported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions.lineage import cut
from loreweave.operators import dedupe, entities, gates, graph, linking, metrics, obligations, planning, wiki
from loreweave.operators.segment import BLANK_LINE, segment
from loreweave.sources.stores import Stores


@dataclass(frozen=True)
class Config:
    vehicle_min_mentions: int = 3
    similarity_threshold: float = 0.8
    delimiter: str = BLANK_LINE

    def __post_init__(self) -> None:
        if self.vehicle_min_mentions < 1 or not 0 <= self.similarity_threshold <= 1:
            raise ValueError("vehicle_min_mentions is 1 or more, similarity_threshold from 0 to 1")


class Tables(dict):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], made: dict[str, DataFrame] | None = None) -> None:
        super().__init__(made or {})
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]

    def __or__(self, other: dict[str, DataFrame]) -> Tables:
        return Tables(self.makers, {**self, **other})


def tables(docs: DataFrame, config: Config = Config(), ignored: DataFrame | None = None, forced: DataFrame | None = None, keep=lambda name, rows: cut(rows), lazy: bool = False) -> dict[str, DataFrame]:
    """Every table of a run up to the graph; keep cuts the lineage of those that are read more than once. Obligations are those before merging.
    All are made here or, lazy, those that are asked for and what these need."""
    kept: dict[str, Callable[[], DataFrame]] = {
        "passages": lambda: segment(docs, config.delimiter),
        "mentions": lambda: entities.mentions(t["passages"], ignored=ignored),
        "entities": lambda: entities.entities(t["mentions"], config.vehicle_min_mentions, forced),
        "aliases": lambda: entities.aliases(t["entities"]),
        "links": lambda: linking.links(t["passages"], t["entities"]),
        "matches": lambda: obligations.with_ids(obligations.obligation_matches(t["passages"])),
        "obligations": lambda: obligations.obligations(t["matches"], t["links"]),
        "anchors": lambda: entities.entity_anchors(t["mentions"], t["entities"]).unionByName(obligations.obligation_anchors(t["matches"])),
        "events": lambda: wiki.events(t["passages"], t["links"], t["by_passage"], t["obligations"]),
        "relationships": lambda: wiki.relationships(t["passages"], t["links"], t["by_passage"]),
    }
    planned: dict[str, Callable[[], DataFrame]] = {
        "by_passage": lambda: obligations.anchors_by_passage(t["anchors"]),
        "nodes": lambda: graph.graph_nodes(t["passages"], t["anchors"], t["entities"], t["obligations"], t["events"], t["relationships"]),
        "edges": lambda: graph.graph_edges(t["anchors"], t["entities"], t["obligations"], t["events"], t["relationships"]),
        "findings": lambda: gates.referential_integrity(t["passages"], t["anchors"], t["entities"], t["aliases"], t["obligations"]).unionByName(gates.evidence_gate(t["obligations"])).unionByName(gates.contradictions(t["obligations"])),
    }
    t = Tables({name: (lambda name=name, made=made: keep(name, made())) for name, made in kept.items()} | planned)
    if not lazy:
        for name in t.makers:
            t[name]
    return t


def run(docs: DataFrame, root: str, config: Config = Config(), ignored: DataFrame | None = None, forced: DataFrame | None = None) -> bool:
    """Runs everything into stores below root; returns the verdict. Nothing is exported if a gate fails. An error is added to the
    findings before it is passed on."""
    stores = Stores(docs.sparkSession, root)
    try:
        return _run(docs, stores, config, ignored, forced)
    except Exception as e:
        stores.append("findings", gates.pipeline_error(docs.sparkSession, str(e)))
        raise


def _run(docs: DataFrame, stores: Stores, config: Config, ignored: DataFrame | None, forced: DataFrame | None) -> bool:
    t = tables(docs, config, ignored, forced, stores.write)
    merges = dedupe.merges(t["obligations"], config.similarity_threshold)
    merged = stores.write("merged_obligations", dedupe.merge_obligations(t["obligations"].drop("seq"), m=merges))
    stores.write("duplicate_edges", dedupe.duplicate_edges(merges))
    stores.write("evidence_index", obligations.evidence_index(merged))
    findings = stores.write("findings", gates.referential_integrity(t["passages"], t["anchors"], t["entities"], t["aliases"], merged).unionByName(gates.evidence_gate(merged)).unionByName(gates.contradictions(merged)))
    stores.write("metrics", metrics.metrics(t["passages"], merged, t["entities"], findings))
    stores.write_json("dataset_manifest", metrics.dataset_manifest(docs))
    stores.append_new("review_queue", gates.review_items(findings), "item_id")
    passed = bool(gates.verdict(findings).collect()[0]["passed"])
    if not passed:
        return False
    stores.write("nodes", t["nodes"])
    stores.write("edges", graph.connected_edges(t["edges"], stores.read("nodes")))
    beats = stores.write("outline", planning.outline_beats(merged, t["entities"]))
    points = stores.write("convergences", planning.convergence(beats))
    stores.write("bridging", planning.bridging_beats(points))
    stores.write_csv("reveals", planning.reveals_csv(planning.reveal_ledger(merged, t["anchors"])))
    stores.write("twists", planning.twist_bank(merged, t["anchors"]))
    lines = planning.dossier(merged, obligations.resolve_evidence(merged, t["anchors"]))
    stores.write("dossier", lines.orderBy("section", "obligation_id", F.monotonically_increasing_id()))
    return True
