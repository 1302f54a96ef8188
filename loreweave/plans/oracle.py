"""SQL that says what the registered queries return, written for DuckDB and independent of the operators' code."""

from __future__ import annotations

from loreweave.functions.lexicons import CATEGORIES, COMMON_WORDS, CONTRADICTIONS, DOSSIER_ORDER, EVENT_RULES, MENTION_RULES, OBLIGATION_RULES, PLACES, RELATION_RULES, REVIEW_CATEGORIES, VEHICLE_WORDS
from loreweave.plans import corpus
from loreweave.plans.queries import FAULTS, PATHS, STORY


def q(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "true" if x is True else "false" if x is False else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) AS v({columns}))"


def total(list_sql: str) -> str:
    return f"coalesce(list_sum(list_transform({list_sql}, lambda x: length(x))), 0)"


def digest(prefix: str, size: int, content: str) -> str:
    return f"'{prefix}' || substr(sha256({content}), 1, {size})"


def passages_of(name: str, source: str, delimiter: str) -> str:
    return rf"""
{name}_parts AS (SELECT source_id, order_hint, string_split_regex(raw_text, '{delimiter}') AS p, regexp_extract_all(raw_text, '{delimiter}') AS g FROM {source} WHERE raw_text IS NOT NULL),
{name}_bare AS (
  SELECT source_id, order_hint, i, {total("p[1:i - 1]")} + {total("g[1:i - 1]")} + length(p[i]) - length(regexp_replace(p[i], '^\s+', '')) AS s, regexp_replace(regexp_replace(p[i], '^\s+', ''), '\s+$', '') AS b
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM {name}_parts)),
{name} AS (
  SELECT source_id || ':' || paragraph_index AS passage_id, source_id, order_hint, paragraph_index, replace(b, chr(13) || chr(10), chr(10)) AS text, CAST(s AS INTEGER) AS char_start, CAST(s + length(b) AS INTEGER) AS char_end
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS INTEGER) AS paragraph_index FROM {name}_bare WHERE b <> ''))"""


def spans_of(name: str, passages: str, rules: str) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (m, g, k), m[k] AS x, CAST({total("g[1:k]")} + {total("m[1:k - 1]")} AS INTEGER) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT p.passage_id, p.source_id, p.order_hint, p.paragraph_index, p.text, r.*, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS g FROM {passages} AS p, {rules} AS r)))"""


def mentions_of(name: str, passages: str) -> str:
    rules = values([(r.seq, i, r.kind, r.pattern) for i, r in enumerate(MENTION_RULES)], "rule_seq, pattern_seq, kind, pattern")
    listed = lambda xs: ", ".join(map(q, xs))
    return (
        spans_of(f"{name}_spans", passages, rules)
        + rf""",
{name} AS (
  SELECT passage_id, source_id, order_hint, paragraph_index, rule_seq, pattern_seq, CASE WHEN kind = 'vehicle' THEN 'The ' || substr(x, 5) ELSE x END AS canonical_name,
    CASE WHEN rule_seq = 6 AND x IN ({listed(PLACES)}) THEN 'place' ELSE kind END AS entity_type, s AS char_start, CAST(s + length(x) AS INTEGER) AS char_end, x AS excerpt
  FROM {name}_spans
  WHERE (kind <> 'vehicle' OR regexp_matches(lower(substr(text, greatest(1, s - 99), least(s, 100)) || ' ' || x || ' ' || substr(text, s + length(x) + 1, 100)), '{"|".join(VEHICLE_WORDS)}'))
    AND (rule_seq <> 6 OR (regexp_extract(x, '^\S+') NOT IN ({listed(COMMON_WORDS)}) AND NOT starts_with(x, 'House '))))"""
    )


def entities_of(name: str, mentions: str, least: int, forced: str = "(SELECT NULL AS forced_name, NULL AS forced_id WHERE false)") -> str:
    return f"""
{name} AS (
  SELECT coalesce(forced_id, {digest("entity_", 12, "lower(trim(canonical_name)) || '|' || entity_type")}) AS entity_id, canonical_name, entity_type, passage_id AS first_seen_passage, mention_count
  FROM (SELECT *, count(*) OVER (PARTITION BY canonical_name) AS mention_count, row_number() OVER (PARTITION BY canonical_name ORDER BY order_hint, source_id, paragraph_index, rule_seq, pattern_seq, char_start) AS n FROM {mentions})
  LEFT JOIN {forced} ON canonical_name = forced_name
  WHERE n = 1 AND (entity_type <> 'vehicle' OR mention_count >= {least} OR forced_id IS NOT NULL))"""


def _obligation_rules() -> str:
    rows = [(r.category, CATEGORIES.index(r.category), r.family, i, r.head, r.confidence, r.link, r.fragment, "(?i)" + p) for r in OBLIGATION_RULES for i, p in enumerate(r.patterns)]
    return values(rows, "category, category_seq, family, pattern_seq, head, confidence, link, fragment, pattern")


def _case(rules: tuple, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {q('(?i)' + p)}) THEN {q(k)}" for k, p in rules) + " END"


def _common(column: str) -> str:
    return f"{column} NOT IN ({', '.join(map(q, COMMON_WORDS))})"


def finding(severity: str, category: str, message: str, related: str) -> str:
    return f"SELECT {digest('fnd_', 12, f"'{category}' || '|' || ({message}) || '|' || ({related})")} AS finding_id, '{severity}' AS severity, '{category}' AS category, {message} AS message, {related} AS related_ids"


BASE = ",\n".join([
    passages_of("passages", "corpus", r"\n\s*\n"),
    mentions_of("mentions", "passages"),
    entities_of("entities", "mentions", 2),
    f"""
aliases AS (
  SELECT {digest("alias_", 12, "lower(trim(alias_text)) || '|' || entity_id")} AS alias_id, alias_text, entity_id, confidence FROM (
    SELECT canonical_name AS alias_text, entity_id, 1.0::DOUBLE AS confidence FROM entities
    UNION ALL SELECT w[1], entity_id, 0.8 FROM (SELECT *, regexp_split_to_array(canonical_name, '\\s+') AS w FROM entities) WHERE len(w) > 1 AND {_common("w[1]")} AND w[1] NOT IN (SELECT canonical_name FROM entities)
    UNION ALL SELECT w[-1], entity_id, 0.7 FROM (SELECT *, regexp_split_to_array(canonical_name, '\\s+') AS w FROM entities) WHERE len(w) > 1 AND entity_type = 'person' AND {_common("w[-1]")}))""",
    """
links AS (SELECT passage_id, entity_id, canonical_name, entity_type, CAST(strpos(lower(text), lower(canonical_name)) AS INTEGER) AS position FROM passages, entities WHERE contains(lower(text), lower(canonical_name)))""",
    spans_of("found", "passages", _obligation_rules()),
    f"""
matches AS (
  SELECT *, head || ': ''' || x || '''' AS description, {digest("obl_", 12, "category || ':' || passage_id || ':' || lower(x)")} AS obligation_id, {digest("anc_", 12, "passage_id || ':' || s || ':' || (s + length(x))")} AS anchor_id
  FROM found AS f WHERE NOT fragment OR NOT EXISTS (SELECT 1 FROM found AS a WHERE a.passage_id = f.passage_id AND a.category = 'mystery' AND a.family = 1 AND a.s <= f.s AND f.s + length(f.x) <= a.s + length(a.x)))""",
    """
first_match AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obligation_id ORDER BY category_seq, order_hint, source_id, paragraph_index, family, pattern_seq, s) AS n FROM matches) WHERE n = 1),
own_anchors AS (SELECT obligation_id, list(anchor_id ORDER BY s, e) AS anchor_list FROM (SELECT DISTINCT obligation_id, anchor_id, s, s + length(x) AS e FROM matches) GROUP BY obligation_id),
obligations AS (
  SELECT obligation_id, category, description, anchor_list, passage_id AS last_seen_passage_id, confidence::DOUBLE AS confidence, false AS is_resolved,
    coalesce((SELECT list(DISTINCT entity_id ORDER BY entity_id) FROM links AS l WHERE l.passage_id = f.passage_id AND l.entity_type = f.link), []::VARCHAR[]) AS related
  FROM first_match AS f JOIN own_anchors USING (obligation_id))""",
    f"""
entity_anchors AS (SELECT DISTINCT {digest("anchor_", 12, "lower(passage_id) || '|' || char_start || '|' || char_end")} AS anchor_id, passage_id, char_start, char_end, excerpt FROM mentions WHERE canonical_name IN (SELECT canonical_name FROM entities)),
anchors AS (SELECT * FROM entity_anchors UNION ALL SELECT DISTINCT anchor_id, passage_id, s, CAST(s + length(x) AS INTEGER), x FROM matches),
by_passage AS (SELECT passage_id, list(anchor_id ORDER BY anchor_id) AS anchor_list FROM anchors GROUP BY passage_id),
who AS (SELECT passage_id, list(entity_id ORDER BY position, entity_id) AS ids, list(canonical_name ORDER BY position, entity_id) AS names, min(entity_id) FILTER (entity_type = 'place') AS place FROM links GROUP BY passage_id),
classed AS (SELECT *, {_case(EVENT_RULES, "text")} AS event_type, {_case(RELATION_RULES, "text")} AS relation_type FROM passages)""",
    f"""
titled AS (
  SELECT c.*, b.anchor_list, w.ids, w.place, CASE WHEN n.canonical_name IS NULL THEN upper(event_type[1]) || event_type[2:] WHEN event_type = 'battle' THEN 'Battle of ' || n.canonical_name ELSE upper(event_type[1]) || event_type[2:] || ' at ' || n.canonical_name END AS title
  FROM classed AS c JOIN by_passage AS b USING (passage_id) LEFT JOIN who AS w USING (passage_id) LEFT JOIN entities AS n ON n.entity_id = w.place WHERE event_type IS NOT NULL),
events AS (
  SELECT {digest("evt_", 12, "event_type || '|' || passage_id || '|' || anchor_list[1] || '|' || title")} AS event_id, event_type, title, coalesce(ids, []) AS participants, place AS location_entity_id, anchor_list,
    coalesce((SELECT list(DISTINCT obligation_id ORDER BY obligation_id) FROM obligations AS o WHERE list_has_any(o.anchor_list, t.anchor_list)), []) AS resolved, passage_id, source_id, paragraph_index FROM titled AS t),
relationships AS (
  SELECT {digest("rel_", 12, "relation_type || '|' || passage_id || '|' || anchor_list[1] || '|' || ids[1] || '|' || ids[2]")} AS relationship_id, relation_type, ids[1] AS source_entity_id, ids[2] AS target_entity_id,
    upper(relation_type[1]) || relation_type[2:] || ' between ' || names[1] || ' and ' || names[2] || '.' AS description, anchor_list, passage_id, source_id, paragraph_index
  FROM classed JOIN by_passage USING (passage_id) JOIN who USING (passage_id) WHERE relation_type IS NOT NULL AND len(ids) >= 2)""",
])


def _edge(kind: str, source: str, source_id: str, target: str, target_id: str, rows: str) -> str:
    content = f"'{kind}|{source}|' || a || '|{target}|' || b"
    return f"SELECT {digest('edge_', 16, content)} AS edge_id, '{kind}' AS rel_type, '{source}' AS source_label, a AS source_id, '{target}' AS target_label, b AS target_id FROM (SELECT DISTINCT {source_id} AS a, {target_id} AS b FROM {rows}) WHERE a IS NOT NULL AND b IS NOT NULL"


def edges_of(t: dict[str, str]) -> str:
    return "\nUNION ALL ".join([
        _edge("APPEARS_IN", "EvidenceAnchor", "anchor_id", "Passage", "passage_id", t["anchors"]),
        _edge("APPEARS_IN", "Entity", "entity_id", "Passage", "first_seen_passage", t["entities"]),
        _edge("APPEARS_IN", "Obligation", "obligation_id", "Passage", "last_seen_passage_id", t["obligations"]),
        _edge("RELATES_TO", "Obligation", "obligation_id", "Entity", "unnest(related)", t["obligations"]),
        _edge("SUPPORTED_BY", "Obligation", "obligation_id", "EvidenceAnchor", "unnest(anchor_list)", t["obligations"]),
        _edge("APPEARS_IN", "Event", "event_id", "Passage", "passage_id", t["events"]),
        _edge("PARTICIPATES_IN", "Entity", "unnest(participants)", "Event", "event_id", t["events"]),
        _edge("LOCATED_AT", "Event", "event_id", "Entity", "location_entity_id", t["events"]),
        _edge("RESOLVES", "Event", "event_id", "Obligation", "unnest(resolved)", t["events"]),
        _edge("SUPPORTED_BY", "Event", "event_id", "EvidenceAnchor", "unnest(anchor_list)", t["events"]),
        _edge("APPEARS_IN", "Relationship", "relationship_id", "Passage", "passage_id", t["relationships"]),
        _edge("RELATES_TO", "Relationship", "relationship_id", "Entity", "unnest([source_entity_id, target_entity_id])", t["relationships"]),
        _edge("SUPPORTED_BY", "Relationship", "relationship_id", "EvidenceAnchor", "unnest(anchor_list)", t["relationships"]),
    ])


EDGES = "edges AS (" + edges_of({k: k for k in ("anchors", "entities", "obligations", "events", "relationships")}) + ")"
NODES = """nodes AS (
  SELECT 'Passage' AS label, passage_id AS node_id, paragraph_index AS story_order_index, source_id AS story_order_source_id, passage_id AS story_order_passage_id FROM passages
  UNION ALL SELECT 'EvidenceAnchor', anchor_id, NULL, NULL, NULL FROM (SELECT DISTINCT anchor_id FROM anchors) UNION ALL SELECT 'Entity', entity_id, NULL, NULL, NULL FROM entities
  UNION ALL SELECT 'Obligation', obligation_id, NULL, NULL, NULL FROM obligations UNION ALL SELECT 'Event', event_id, paragraph_index, source_id, passage_id FROM events
  UNION ALL SELECT 'Relationship', relationship_id, paragraph_index, source_id, passage_id FROM relationships)"""
TOKENS = r"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '\s+'), lambda w: trim(w, '.,!?;:""''()-[]{{}}')), lambda w: w <> '')))".replace('""', '"')
JACCARD = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y))::DOUBLE / greatest(1, len(list_distinct(list_concat(x, y)))) END"
BROKEN = """
b_anchors AS (SELECT * FROM anchors WHERE NOT starts_with(passage_id, 'book2')), b_entities AS (SELECT * FROM entities WHERE entity_type <> 'person'), b_passages AS (SELECT * FROM passages WHERE source_id <> 'appendix'),
b_obligations AS (SELECT * REPLACE (CASE WHEN category = 'plot_thread' THEN []::VARCHAR[] ELSE anchor_list END AS anchor_list) FROM obligations)"""
CONTRADICTED = f"""
contradicted AS ({finding("warn", "contradiction", "'Potential contradiction between ''' || a.obligation_id || ''' and ''' || b.obligation_id || ''': ''' || a.description || ''' vs ''' || b.description || ''''", "a.obligation_id || ';' || b.obligation_id")}
  FROM obligations AS a JOIN obligations AS b ON a.category = b.category AND a.obligation_id < b.obligation_id, {values(list(CONTRADICTIONS), "yes, no")} AS c
  WHERE (contains(lower(a.description), yes) AND contains(lower(b.description), no)) OR (contains(lower(a.description), no) AND contains(lower(b.description), yes)))"""
GATED = f"gated AS ({finding('error', 'evidence_gate', "'Obligation ''' || obligation_id || ''' has no evidence anchors'", 'obligation_id')} FROM b_obligations WHERE len(anchor_list) = 0)"
BEATS = """
halved AS (SELECT *, row_number() OVER (ORDER BY obligation_id) AS r, greatest(1, count(*) OVER () // 2) AS h FROM obligations),
beats AS (
  SELECT printf('book%d_beat_%03d', CASE WHEN r <= h THEN 6 ELSE 7 END, CASE WHEN r <= h THEN r ELSE r - h END) AS beat_id, CASE WHEN r <= h THEN 6 ELSE 7 END AS book_number, obligation_id, description, canonical_name AS pov_character, array_to_string(related, ';') AS entity_ids, related
  FROM halved LEFT JOIN entities ON entity_id = related[1]),
points AS (
  SELECT 'conv_' || entity_id AS convergence_id, entity_id, string_agg(DISTINCT obligation_id, ';' ORDER BY obligation_id) AS obligations, CASE WHEN count(DISTINCT book_number) >= 2 THEN 'Between books 6 and 7' ELSE 'Book ' || min(book_number) || ' midpoint' END AS suggested_placement, round(least(1.0, 0.3 + 0.1 * count(DISTINCT obligation_id))::DOUBLE, 6) AS dramatic_weight
  FROM (SELECT *, unnest(related) AS entity_id FROM beats) GROUP BY entity_id HAVING count(DISTINCT obligation_id) >= 2),
convergences AS (SELECT *, CASE WHEN contains(suggested_placement, 'Book 7') THEN 'book7' ELSE 'book6' END AS section_id FROM points)"""
EVIDENCE = "coalesce((SELECT string_agg(u.a, ';' ORDER BY u.i) FROM (SELECT unnest(anchor_list) AS a, generate_subscripts(anchor_list, 1) AS i) AS u WHERE u.a IN (SELECT anchor_id FROM anchors)), '')"


def integrity(name: str, rows: str, key: str, known: str, known_key: str) -> str:
    return f"SELECT '{name}' AS \"check\", count(*) AS checked, count(*) FILTER (k NOT IN (SELECT {known_key} FROM {known})) AS missing FROM (SELECT {key} AS k FROM {rows}) WHERE k IS NOT NULL"


def on_corpus(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([corpus.sql(), BASE, *more]) + "\n" + select


def on_documents(select: str, *more: str) -> str:
    source = "(SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id AS order_hint, text AS raw_text FROM documents)"
    return "WITH " + ",\n".join([passages_of("passages", source, r"\n"), *more]) + "\n" + select


#: One ASCII letter for each character beyond ASCII, so that RE2's word borders fall where Unicode's do.
ASCII_PASSAGES = r"letters AS (SELECT * REPLACE (regexp_replace(text, '[^\x00-\x7F]', '0', 'g') AS text) FROM passages)"


def on_annotated(select: str) -> str:
    return "WITH " + ",\n".join([corpus.annotated_sql(), passages_of("passages", "corpus", r"\n\s*\n"), ASCII_PASSAGES, mentions_of("found_mentions", "letters"), entities_of("found_entities", "found_mentions", 2)]) + "\n" + select


def _json_kind(column: str) -> str:
    return f"CASE {column} WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' END"


MERGE_STEPS = "SELECT id AS obligation_id, owner, src AS taken_by, round(w, 6) AS weight FROM ends LEFT JOIN edges ON dst = id WHERE owner NOT IN (SELECT dst FROM edges)"
SESSIONS = """numbered AS (
  SELECT user_id, epoch_us(ts) AS us, sum(CASE WHEN gap <= 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS session
  FROM (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)
), sessions AS (
  SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS first, CASE WHEN session < max(session) OVER (PARTITION BY user_id) THEN max(us) END AS last FROM numbered GROUP BY user_id, session)"""
_TABLES = {"passages": "passage_id", "anchors": "anchor_id", "obligations": "obligation_id", "events": "event_id", "relationships": "relationship_id", "entities": "entity_id"}
TOUCHED = """
t_passages AS (SELECT * FROM passages WHERE source_id = 'book2_ch01'),
t_anchors AS (SELECT * FROM anchors WHERE passage_id IN (SELECT passage_id FROM t_passages)),
t_known AS (SELECT list(DISTINCT anchor_id) AS ids FROM t_anchors),
t_obligations AS (SELECT * FROM obligations WHERE last_seen_passage_id IN (SELECT passage_id FROM t_passages) OR list_has_any(anchor_list, (SELECT ids FROM t_known))),
t_events AS (SELECT * FROM events WHERE source_id = 'book2_ch01' OR list_has_any(anchor_list, (SELECT ids FROM t_known)) OR list_has_any(resolved, (SELECT list(obligation_id) FROM t_obligations))),
t_relationships AS (SELECT * FROM relationships WHERE source_id = 'book2_ch01' OR list_has_any(anchor_list, (SELECT ids FROM t_known))),
t_entities AS (SELECT * FROM entities WHERE first_seen_passage IN (SELECT passage_id FROM t_passages) OR entity_id IN (
  SELECT unnest(related) FROM t_obligations UNION SELECT unnest(participants) FROM t_events UNION SELECT location_entity_id FROM t_events WHERE location_entity_id IS NOT NULL UNION SELECT source_entity_id FROM t_relationships UNION SELECT target_entity_id FROM t_relationships))"""
_MENTION_COLUMNS = "passage_id, canonical_name, entity_type, char_start, char_end, excerpt"
_OBLIGATION_COLUMNS = "obligation_id, category, description, array_to_string(anchor_list, ';') AS evidence_anchor_ids, last_seen_passage_id, confidence, is_resolved, array_to_string(related, ';') AS related_entity_ids"
_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_FILES = values([(p,) for p in PATHS], "path")


def _review() -> str:
    kinds = "CASE category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in REVIEW_CATEGORIES.items()) + " END"
    return f"SELECT {digest('review_', 12, 'finding_id')} AS item_id, {kinds} AS category, CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END AS severity, message AS description, related_ids, 'pending' AS status FROM (SELECT * FROM contradicted UNION ALL SELECT * FROM gated)"


def _duplicates(threshold: float) -> str:
    bonus = lambda f, w: f"CASE WHEN len(a.{f}) > 0 AND len(b.{f}) > 0 THEN {w} * len(list_intersect(a.{f}, b.{f}))::DOUBLE / len(list_distinct(list_concat(a.{f}, b.{f}))) ELSE 0 END"
    same = f"SELECT a.obligation_id AS i, b.obligation_id AS j, round(least(1.0, {JACCARD.replace('x', 'a.t').replace('ma.t', 'max').replace('y)', 'b.t)').replace('(y', '(b.t').replace(', y', ', b.t')} + CASE WHEN a.category = b.category THEN 0.1 ELSE 0 END + {bonus('related', 0.1)} + {bonus('anchor_list', 0.05)})::DOUBLE, 6) AS similarity FROM told AS a JOIN told AS b ON a.obligation_id < b.obligation_id"
    return f"SELECT * FROM ({same}) WHERE similarity >= {threshold}"


#: Greedy merging as a recursion over the ordered pairs: s has a struct for each row that is left.
TOLD = f"told AS (SELECT *, {TOKENS.format('description')} AS t FROM obligations)"
MERGED = f"""
pairs AS ({_duplicates(0.5)}),
ordered AS (SELECT coalesce(list({{'i': i, 'j': j}} ORDER BY similarity DESC, i, j), []) AS ps FROM pairs),
steps AS (
  SELECT 0 AS k, (SELECT list({{'id': obligation_id, 'a': anchor_list, 'r': related, 'c': confidence, 'l': last_seen_passage_id, 'x': []::VARCHAR[]}}) FROM obligations) AS s
  UNION ALL
  SELECT k + 1, CASE WHEN a IS NULL OR b IS NULL THEN s ELSE list_concat(list_filter(s, lambda y: y.id <> a.id AND y.id <> b.id), [{{
    'id': w.id, 'a': list_concat(w.a, list_filter(o.a, lambda y: NOT list_contains(w.a, y))), 'r': list_concat(w.r, list_filter(o.r, lambda y: NOT list_contains(w.r, y))),
    'c': greatest(w.c, o.c), 'l': greatest(w.l, o.l), 'x': list_concat(w.x, [o.id], o.x)}}]) END
  FROM (SELECT *, CASE WHEN len(a.a) >= len(b.a) THEN a ELSE b END AS w, CASE WHEN len(a.a) >= len(b.a) THEN b ELSE a END AS o
    FROM (SELECT k, s, list_filter(s, lambda y: y.id = ps[k + 1].i)[1] AS a, list_filter(s, lambda y: y.id = ps[k + 1].j)[1] AS b FROM steps, ordered WHERE k < len(ps)))),
survivors AS (SELECT unnest(s) AS u FROM (SELECT s FROM steps ORDER BY k DESC LIMIT 1))"""

ORACLE_SQL: dict[str, str] = {
    "scan_documents": "WITH " + corpus.sql() + " SELECT source_id, replace(raw_text, chr(13) || chr(10), chr(10)) AS raw_text, nullif(regexp_extract(source_id, '^(book[0-9]+)_', 1), '') AS book_label, regexp_replace(source_id, '^book[0-9]+_', '') AS chapter_label FROM corpus",
    "folder_order_hint": "WITH " + corpus.sql() + " SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS order_hint FROM corpus",
    "segment_paragraphs": on_documents("SELECT passage_id, source_id, paragraph_index, text FROM passages"),
    "passage_offsets": on_documents("SELECT passage_id, char_start, char_end FROM passages"),
    "entities_documents": on_documents("SELECT entity_id, canonical_name, entity_type, first_seen_passage, mention_count FROM found_entities", ASCII_PASSAGES, mentions_of("found_mentions", "letters"), entities_of("found_entities", "found_mentions", 2)),
    "link_names_documents": on_documents(
        f"SELECT passage_id, {digest('name_', 12, 'name')} AS entity_id, name AS canonical_name, CAST(strpos(low, lower(name)) AS INTEGER) AS position FROM (SELECT passage_id, lower(text) AS low FROM passages), names WHERE contains(low, lower(name))",
        "names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{8,}')) AS name FROM documents)",
    ),
    "merge_documents": on_documents(MERGE_STEPS, f"""
obliged AS (
  SELECT passage_id AS id, lang AS c, source AS s, len(string_split(p.text, ',')) AS n, {TOKENS.format("p.text")} AS t FROM passages AS p JOIN documents AS d ON p.source_id = CAST(d.doc_id AS VARCHAR)
), classed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY t, c ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM obliged
), ahead AS (SELECT *, n > before OR before = 0 AND id = min(id) OVER (PARTITION BY t, c) AS wins FROM classed
), told AS (
  SELECT *, max(CASE WHEN wins THEN id END) OVER (PARTITION BY t, c) AS rep, sum(n) OVER (PARTITION BY t, c) AS total,
    CASE WHEN wins THEN min(CASE WHEN wins THEN id END) OVER (PARTITION BY t, c ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
      ELSE max(CASE WHEN wins THEN id END) OVER (PARTITION BY t, c ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS into_id FROM ahead
), reps AS (SELECT id, c, s, CAST(total AS BIGINT) AS n, t FROM told WHERE rep = id
), spread AS (SELECT id, unnest(t) AS w, len(t) AS size FROM reps
), often AS (SELECT w, count(*) AS df FROM spread GROUP BY w
), blocks AS (
  SELECT id, w FROM (SELECT id, w, size, row_number() OVER (PARTITION BY id ORDER BY df, w) AS k FROM spread JOIN often USING (w)) WHERE k <= size - ceil(0.55 * size - 1e-9) + 1
  UNION ALL SELECT id, '' FROM reps WHERE len(t) = 0
), met AS (SELECT DISTINCT a.id AS i, b.id AS j FROM blocks a JOIN blocks b ON a.w = b.w AND a.id < b.id
), scored AS (
  SELECT i, j, least(1.0::DOUBLE, CASE WHEN len(a.t) = 0 AND len(b.t) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.t, b.t))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.t, b.t)))) END
    + CASE WHEN a.c = b.c THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN a.s = b.s THEN 0.1::DOUBLE ELSE 0 END) AS sim FROM met JOIN reps a ON a.id = i JOIN reps b ON b.id = j
), pairs AS (SELECT i, j, sim, row_number() OVER (ORDER BY sim DESC, i, j) AS k FROM scored WHERE sim >= 0.8 - 1e-12
), sizes AS (SELECT map(list(id), list(n)) AS m FROM reps WHERE id IN (SELECT i FROM pairs UNION SELECT j FROM pairs)
), step AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS dead, m, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS w FROM sizes
  UNION ALL
  SELECT k, CASE WHEN skip THEN dead ELSE list_append(dead, b) END, CASE WHEN skip THEN m ELSE map_concat(m, MAP {{a: m[a] + m[b]}}) END, CASE WHEN NOT skip THEN a END, CASE WHEN NOT skip THEN b END, CASE WHEN NOT skip THEN sim END
  FROM (SELECT p.k, dead, m, sim, list_contains(dead, i) OR list_contains(dead, j) AS skip, CASE WHEN m[i] >= m[j] THEN i ELSE j END AS a, CASE WHEN m[i] >= m[j] THEN j ELSE i END AS b FROM step JOIN pairs AS p ON p.k = step.k + 1)
), edges AS (
  SELECT src, dst, w FROM step WHERE src IS NOT NULL UNION ALL SELECT into_id, id, 1.0 FROM told WHERE into_id IS NOT NULL
), ends AS (SELECT id, id AS owner FROM obliged UNION ALL SELECT ends.id, src FROM ends JOIN edges ON dst = owner)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "content_ranges_paragraphs": on_documents(
        'SELECT i // 1024 AS "range", count(*) AS "rows", sha256(string_agg(h, \'\' ORDER BY i)) AS hash FROM leaves GROUP BY i // 1024',
        "leaves AS (SELECT row_number() OVER (ORDER BY order_hint, paragraph_index) - 1 AS i, sha256(strlen(passage_id) || ':' || passage_id || strlen(text) || ':' || text) AS h FROM passages)",
    ),
    "dataset_manifest_ordered": """WITH leaves AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, text, sha256(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS h FROM documents),
one AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM leaves GROUP BY i // 1024),
two AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM one GROUP BY i // 1024)
SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT doc_id) AS sources, (SELECT CASE WHEN (SELECT count(*) FROM one) = 1 THEN (SELECT h FROM one) ELSE (SELECT h FROM two) END) AS content_hash FROM leaves""",
    "events_log": "SELECT user_id, props, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    "contradictions_documents": on_documents(
        "SELECT id AS obligation_id, c AS category, pair, CASE WHEN yes AND no THEN n_yes + n_no - n_both - 1 WHEN yes THEN n_no ELSE n_yes END AS n FROM (SELECT *, count(*) FILTER (yes) OVER (PARTITION BY c, pair) AS n_yes, count(*) FILTER (no) OVER (PARTITION BY c, pair) AS n_no, count(*) FILTER (yes AND no) OVER (PARTITION BY c, pair) AS n_both FROM held) WHERE CASE WHEN yes AND no THEN n_yes + n_no - n_both - 1 WHEN yes THEN n_no ELSE n_yes END > 0",
        f"""told AS (
  SELECT passage_id AS id, lang AS c, lower(p.text || ' ' || ['will live', 'Will Live', 'will die', 'will live, will die', 'is good', 'is evil', 'is true', ''][length(p.text) % 8 + 1]) AS t FROM passages AS p JOIN documents AS d ON p.source_id = CAST(d.doc_id AS VARCHAR) WHERE lang IS NOT NULL
), held AS (SELECT id, c, CAST(pair AS INTEGER) AS pair, contains(t, a) AS yes, contains(t, b) AS no FROM told, {values([(i, a, b) for i, (a, b) in enumerate(CONTRADICTIONS)], "pair, a, b")} WHERE contains(t, a) OR contains(t, b))""",
    ),
    "artifact_documents": "SELECT doc_id, sha256(text) AS text_sha256, lang, source FROM documents",
    "passages_looked_up": on_documents("SELECT passage_id, source_id, paragraph_index, text FROM passages WHERE paragraph_index < 2 AND source_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"),
    "stream_firsts_events": "SELECT user_id, props, count(*) AS n, epoch_us(min(ts)) AS first_at, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY user_id, props",
    "contract_events": f"""WITH both_kinds AS (
  SELECT 'e' || event_id AS id, props FROM events UNION ALL SELECT 'm' || event_id, [{", ".join(map(q, FAULTS))}][event_id % {len(FAULTS)} + 1] FROM events
), typed AS (SELECT id, json_valid(props) AND props <> '' AS ok, CASE WHEN json_valid(props) THEN json_type(props, '$.k') END AS k, CASE WHEN json_valid(props) THEN json_type(props, '$.z.y') END AS y FROM both_kinds
), named AS (SELECT id, ok, {_json_kind('k')} AS k, {_json_kind('y')} AS y FROM typed
), bad AS (
  SELECT id, unnest(CASE WHEN NOT ok THEN ['Invalid JSON'] ELSE list_filter([CASE WHEN k IS NULL THEN 'Missing required field: k' WHEN k NOT IN ('int', 'bool') THEN 'Field ''k'' has wrong type: expected integer, got ' || k END, CASE WHEN y <> 'list' THEN 'Field ''z.y'' has wrong type: expected array, got ' || y END], lambda x: x IS NOT NULL) END) AS fault FROM named
) {finding("error", "schema", "'Event Q' || id || 'Q: ' || fault".replace("Q", "''"), "id")} FROM bad""",
    "inc_entities_documents": on_annotated("SELECT entity_id, canonical_name, entity_type, first_seen_passage, mention_count FROM found_entities"),
    "inc_links_documents": on_annotated("SELECT passage_id, entity_id, canonical_name, entity_type, CAST(strpos(low, lower(canonical_name)) AS INTEGER) AS position FROM (SELECT passage_id, lower(text) AS low FROM passages), found_entities WHERE contains(low, lower(canonical_name))"),
    "sessions_open_at_purchases": f"WITH {SESSIONS} SELECT event_id, count(*) AS n_open, min(first) AS earliest FROM (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') JOIN sessions ON first <= us AND (last >= us OR last IS NULL) GROUP BY event_id",
    "relationships_active_at_days": f"""WITH {SESSIONS}, related AS (
  SELECT user_id || ':' || session AS relationship_id, strftime(make_timestamp(first), '%Y-%m-%d %H:%M') AS s, strftime(make_timestamp(last), '%Y-%m-%d %H:%M') AS e FROM sessions
), times AS (SELECT DISTINCT unnest([d, d || ' 00:00', d || ' 12:00']) AS time_value FROM (SELECT strftime(ts, '%Y-%m-%d') AS d FROM events))
SELECT DISTINCT relationship_id, time_value FROM related JOIN times ON time_value = substr(s, 1, 10) OR s <= time_value AND (e >= time_value OR e IS NULL)""",
    "mentions_capitalized_documents": on_documents("SELECT passage_id, canonical_name, char_start, char_end FROM found_mentions WHERE rule_seq = 6", ASCII_PASSAGES, mentions_of("found_mentions", "letters")),
    "tokenize": f"SELECT conv_id, turn, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM conversations",
    "dataset_manifest": "SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT doc_id) AS sources FROM documents",
    "find_duplicates_parts": f"WITH told AS (SELECT DISTINCT p_name || ' ' || p_type AS obligation_id, 'mystery' AS category, {TOKENS.format("p_name || ' ' || p_type")} AS t, []::VARCHAR[] AS related, []::VARCHAR[] AS anchor_list FROM part) {_duplicates(0.6)}",
    "label_integrity": "SELECT 'label_document' AS \"check\", count(*) AS checked, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS missing FROM labels UNION ALL SELECT 'document_label', count(*), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) FROM documents",
    "page_files": f"SELECT DISTINCT source_id FROM (SELECT {_STEM} AS source_id FROM (SELECT url AS path FROM pages)) WHERE source_id <> ''",
    "speaker_timeline": "SELECT conv_id, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role",
    "corpus_passages": on_corpus("SELECT * FROM passages"),
    **{name: on_corpus(f"SELECT {_MENTION_COLUMNS} FROM mentions WHERE rule_seq = {seq}") for name, seq in (("mentions_title", 1), ("mentions_house", 2), ("mentions_artifact", 3), ("mentions_place", 4), ("mentions_vehicle", 5), ("mentions_capitalized", 6), ("mentions_epithet", 7))},
    "entities": on_corpus("SELECT * FROM entities"),
    "entities_overridden": on_corpus("SELECT * FROM ruled", "heard AS (SELECT * FROM mentions WHERE canonical_name <> 'Far Isles')", entities_of("ruled", "heard", 2, "(SELECT 'Mira Vale' AS forced_name, 'entity_mira' AS forced_id)")),
    "alias_table": on_corpus("SELECT * FROM aliases"),
    "override_assign": on_corpus("SELECT * FROM ruled WHERE entity_id = 'entity_gull' OR entity_type = 'vehicle'", entities_of("ruled", "mentions", 99, "(SELECT 'The Grey Gull' AS forced_name, 'entity_gull' AS forced_id)")),
    "entity_with_aliases": on_corpus("SELECT entity_id, canonical_name, coalesce((SELECT string_agg(DISTINCT alias_text, ';' ORDER BY alias_text) FROM aliases AS a WHERE a.entity_id = e.entity_id), '') AS aliases FROM entities AS e"),
    "entity_anchors": on_corpus("SELECT * FROM entity_anchors"),
    "link_entities": on_corpus("SELECT * FROM links"),
    **{name: on_corpus(f"SELECT {_OBLIGATION_COLUMNS} FROM obligations WHERE category = '{c}'") for name, c in (("obl_prophecy", "prophecy_vision"), ("obl_chekhov", "chekhov_gun"), ("obl_mystery", "mystery"), ("obl_plot_thread", "plot_thread"))},
    "evidence_index": on_corpus(f"SELECT {digest('idx_', 16, "'obligation|' || obligation_id")} AS index_id, 'obligation' AS target_type, obligation_id AS target_id, array_to_string(anchor_list, ';') AS anchor_ids FROM obligations WHERE len(anchor_list) > 0"),
    "anchors_by_passage": on_corpus("SELECT passage_id, array_to_string(anchor_list, ';') AS anchor_ids FROM by_passage"),
    "resolve_evidence": on_corpus("SELECT obligation_id, CAST(i - 1 AS INTEGER) AS position, anchor_id, passage_id, excerpt FROM (SELECT obligation_id, unnest(anchor_list) AS anchor_id, generate_subscripts(anchor_list, 1) AS i FROM obligations) JOIN anchors USING (anchor_id)"),
    "jaccard": on_corpus(f"SELECT i, j, round(({JACCARD})::DOUBLE, 6) AS jaccard FROM (SELECT a.obligation_id AS i, b.obligation_id AS j, a.t AS x, b.t AS y FROM told AS a JOIN told AS b ON a.obligation_id < b.obligation_id AND list_has_any(a.t, b.t))", f"told AS (SELECT obligation_id, {TOKENS.format('description')} AS t FROM obligations)"),
    "find_duplicates": on_corpus(_duplicates(0.5), f"told AS (SELECT *, {TOKENS.format('description')} AS t FROM obligations)"),
    "similarity": on_corpus(_duplicates(0.3), TOLD),
    "merge_obligations": on_corpus("SELECT u.id AS obligation_id, category, description, array_to_string(u.a, ';') AS evidence_anchor_ids, u.l AS last_seen_passage_id, u.c AS confidence, is_resolved, NULL::VARCHAR AS resolution_passage_id, array_to_string(u.r, ';') AS related_entity_ids, array_to_string(list_sort(u.x), ';') AS absorbed FROM survivors JOIN obligations ON obligation_id = u.id", TOLD, MERGED),
    "dedupe_rate": on_corpus("SELECT b AS before, a AS after, round((b - a)::DOUBLE / b, 6) AS dedupe_rate FROM (SELECT (SELECT count(*) FROM obligations) AS b, (SELECT count(*) FROM survivors) AS a)", TOLD, MERGED),
    "passage_recency": on_corpus("SELECT passage_id, coalesce(list_filter(regexp_split_to_array(passage_id, '[_-]'), lambda p: regexp_matches(p, '^[+-]?[0-9]+$'))[-1]::BIGINT, 0) AS recency FROM (SELECT passage_id FROM passages UNION ALL VALUES ('b:9'), ('b:10'), ('passage-9'), ('passage-10'), ('a_7-x'))"),
    "obligations_by_category": on_corpus("SELECT category, count(*) AS n FROM obligations GROUP BY category"),
    "stats": on_corpus("SELECT count(*) AS total, count(*) FILTER (NOT is_resolved) AS open, (SELECT count(*) FROM entities) AS entities, count(*) FILTER (confidence > 0.8) AS high_confidence FROM obligations"),
    "metrics": on_corpus(r"SELECT (SELECT count(*) FROM passages) AS total_passages, (SELECT count(*) FROM entities) AS total_entities, (SELECT count(*) FROM obligations) AS total_obligations, 1.0::DOUBLE AS evidence_rate, 0.0::DOUBLE AS ambiguity_rate, round(((SELECT count(*) FROM contradicted) * 10000 / (SELECT sum(len(regexp_extract_all(text, '\S+'))) FROM passages))::DOUBLE, 6) AS contradiction_rate", CONTRADICTED),
    "contradictions": on_corpus("SELECT * FROM contradicted", CONTRADICTED),
    "referential_integrity": on_corpus(
        finding("error", "referential_integrity", "'Obligation ''' || obligation_id || ''' references non-existent anchor: ' || a", "obligation_id || ';' || a") + " FROM (SELECT obligation_id, unnest(anchor_list) AS a FROM b_obligations) WHERE a NOT IN (SELECT anchor_id FROM b_anchors) UNION ALL "
        + finding("error", "referential_integrity", "'Alias ''' || alias_id || ''' references non-existent entity: ' || entity_id", "alias_id || ';' || entity_id") + " FROM aliases WHERE entity_id NOT IN (SELECT entity_id FROM b_entities) UNION ALL "
        + finding("error", "referential_integrity", "'Anchor ''' || anchor_id || ''' references non-existent passage: ' || passage_id", "anchor_id || ';' || passage_id") + " FROM b_anchors WHERE passage_id NOT IN (SELECT passage_id FROM b_passages)", BROKEN),
    "evidence_gate": on_corpus("SELECT * FROM gated", BROKEN, GATED),
    "gate_verdict": on_corpus("SELECT (SELECT count(*) FROM gated) = 0 AS passed, (SELECT count(*) FROM gated) AS errors, (SELECT count(*) FROM contradicted) AS warnings", BROKEN, GATED, CONTRADICTED),
    "integrity_report": on_corpus(" UNION ALL ".join([
        integrity("obligation_anchor", "(SELECT unnest(anchor_list) AS a FROM b_obligations)", "a", "b_anchors", "anchor_id"), integrity("obligation_last_seen", "b_obligations", "last_seen_passage_id", "b_passages", "passage_id"), "SELECT 'obligation_resolution', 0, 0",
        integrity("obligation_entity", "(SELECT unnest(related) AS e FROM b_obligations)", "e", "b_entities", "entity_id"), integrity("alias_entity", "aliases", "entity_id", "b_entities", "entity_id"), integrity("anchor_passage", "b_anchors", "passage_id", "b_passages", "passage_id"), integrity("entity_first_seen", "b_entities", "first_seen_passage", "b_passages", "passage_id"),
        *[integrity(f"edge_{end}", "edges", f"{end}_label || ':' || {end}_id", "(SELECT label || ':' || node_id AS nk FROM nodes WHERE label <> 'Event') AS n", "nk") for end in ("source", "target")],
    ]), BROKEN, NODES, EDGES),
    "schema_gate": finding("error", "schema", "'Row ''' || id || ''' fails ' || rule || ': ' || field", "id") + " FROM (VALUES ('b', 'type', 'n'), ('c', 'required', 'n'), ('c', 'type', 'share')) AS v(id, rule, field)",
    "review_items": on_corpus(_review(), BROKEN, GATED, CONTRADICTED),
    "missing_artifacts": finding("error", "missing_artifact", "'Missing artifact: ' || path", "path") + " FROM (VALUES ('canon/passages'), ('qa/findings')) AS v(path)",
    "event_class": on_corpus("SELECT passage_id, event_type FROM classed WHERE event_type IS NOT NULL"),
    "relationship_class": on_corpus("SELECT passage_id, relation_type FROM classed WHERE relation_type IS NOT NULL"),
    "event_participants": on_corpus("SELECT passage_id, event_type, array_to_string(ids, ';') AS participant_entity_ids FROM classed JOIN who USING (passage_id) WHERE event_type IS NOT NULL"),
    "event_location": on_corpus("SELECT passage_id, event_type, place AS location_entity_id FROM classed LEFT JOIN who USING (passage_id) WHERE event_type IS NOT NULL"),
    "event_obligations": on_corpus("SELECT event_id, array_to_string(resolved, ';') AS obligation_ids FROM events WHERE len(resolved) > 0"),
    "events": on_corpus("SELECT event_id, event_type, title, array_to_string(participants, ';') AS participant_entity_ids, location_entity_id, array_to_string(resolved, ';') AS related_obligation_ids, array_to_string(anchor_list, ';') AS evidence_anchor_ids FROM events"),
    "relationships": on_corpus("SELECT relationship_id, relation_type, source_entity_id, target_entity_id, description, array_to_string(anchor_list, ';') AS evidence_anchor_ids FROM relationships"),
    "graph_nodes": on_corpus("SELECT * FROM nodes", NODES),
    "graph_properties": on_corpus(" UNION ALL ".join(
        f"SELECT '{label}' AS label, {key} AS node_id, CAST(json_object({', '.join(f"'{k}', {v}" for k, v in sorted(own.items()))}) AS VARCHAR) AS properties FROM {rows}"
        for label, key, rows, own in (
            ("Passage", "passage_id", "passages", {k: k for k in ("source_id", "paragraph_index", "text", "char_start", "char_end")}),
            ("EvidenceAnchor", "anchor_id", "anchors", {k: k for k in ("passage_id", "char_start", "char_end", "excerpt")}),
            ("Entity", "entity_id", "entities", {k: k for k in ("canonical_name", "entity_type", "first_seen_passage", "mention_count")}),
            ("Obligation", "obligation_id", "obligations", {k: k for k in ("category", "description", "last_seen_passage_id", "confidence", "is_resolved")} | {"resolution_passage_id": "NULL"}),
            ("Event", "event_id", "events JOIN passages USING (passage_id)", {"event_type": "event_type", "title": "title", "description": "text"}),
            ("Relationship", "relationship_id", "relationships", {k: k for k in ("relation_type", "source_entity_id", "target_entity_id", "description")}),
        )
    )),
    "graph_edges": on_corpus("SELECT * FROM edges", EDGES),
    "graph_uniqueness": on_corpus("SELECT 'Event' AS kind, event_id AS key, 2::BIGINT AS n FROM events"),
    "g_events_for_entity": on_corpus("SELECT p AS entity_id, event_id, title, event_type, 'unknown' AS story_time_label, paragraph_index AS story_order_index, location_entity_id FROM (SELECT *, unnest(participants) AS p FROM events)"),
    "entity_context": on_corpus("SELECT unnest(participants) AS entity_id, 'event' AS kind, event_id AS item_id FROM events UNION SELECT unnest([source_entity_id, target_entity_id]), 'relationship', relationship_id FROM relationships UNION SELECT unnest(related), 'obligation', obligation_id FROM obligations"),
    "g_active_during": on_corpus("SELECT relationship_id, relation_type, source_entity_id, target_entity_id, 'unknown' AS story_time_label, NULL::VARCHAR AS story_time_start, NULL::VARCHAR AS story_time_end, paragraph_index AS story_order_index FROM relationships"),
    "g_obligations_resolved": on_corpus("SELECT event_id, obligation_id, category, description, confidence, is_resolved FROM (SELECT event_id, unnest(resolved) AS obligation_id FROM events) JOIN obligations USING (obligation_id)"),
    "g_evidence_for_relationship": on_corpus("SELECT relationship_id, anchor_id, excerpt, passage_id, p.source_id, p.paragraph_index FROM (SELECT relationship_id, unnest(anchor_list) AS anchor_id FROM relationships) JOIN anchors USING (anchor_id) JOIN passages AS p USING (passage_id)"),
    "g_timeline": on_corpus("SELECT p AS entity_id, 'event' AS item_type, event_id AS item_id, title AS label, 'unknown' AS story_time_label, paragraph_index AS story_order_index FROM (SELECT *, unnest(participants) AS p FROM events) UNION ALL SELECT e, 'relationship', relationship_id, description, 'unknown', paragraph_index FROM (SELECT *, unnest(list_distinct([source_entity_id, target_entity_id])) AS e FROM relationships)"),
    "outline_beats": on_corpus("SELECT * EXCLUDE (related) FROM beats", BEATS),
    "convergence": on_corpus("SELECT * FROM convergences", BEATS),
    "bridging_beats": on_corpus("SELECT 'bridge_' || section_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY section_id ORDER BY convergence_id) AS VARCHAR), 2, '0') AS beat_id, section_id, convergence_id FROM convergences", BEATS),
    "coverage_map": on_corpus("SELECT o.obligation_id, coalesce(beat_id, '') AS beat_ids FROM obligations AS o LEFT JOIN beats AS b ON o.obligation_id = b.obligation_id AND book_number = 7", BEATS),
    "reveal_ledger": on_corpus(f"SELECT {digest('reveal_', 12, "'reveal:' || obligation_id")} AS reveal_id, obligation_id AS mystery_obligation_id, description AS mystery_description, {digest('truth_', 12, "'truth:' || obligation_id")} AS candidate_truth_ids, {EVIDENCE} AS evidence_for, 0.5::DOUBLE AS likelihood, array_to_string(related, ';') AS characters_who_learn, 'moderate' AS dramatic_impact FROM obligations WHERE category = 'mystery'"),
    "twist_bank": on_corpus(f"SELECT {digest('twist_', 12, "'twist:' || obligation_id")} AS twist_id, 'Twist proposal derived from obligation ' || obligation_id AS description, 'revelation' AS twist_type, obligation_id AS affected_obligations, array_to_string(related, ';') AS affected_entities, {EVIDENCE} AS evidence_support, 0.5::DOUBLE AS reader_predictability, 0.5::DOUBLE AS thematic_alignment FROM obligations"),
    "dossier_lines": on_corpus(f"SELECT CAST(list_position([{', '.join(map(q, DOSSIER_ORDER))}], category) AS BIGINT) AS section, obligation_id, '### ' || description || chr(10) || 'Confidence: ' || printf('%.2f', confidence) || chr(10) || (SELECT string_agg('> ' || a.excerpt || ' (' || a.passage_id || ')', chr(10) ORDER BY u.i) FROM (SELECT unnest(anchor_list) AS id, generate_subscripts(anchor_list, 1) AS i) AS u JOIN anchors AS a ON a.anchor_id = u.id) AS block FROM obligations"),
    "inc_payload": on_corpus(" UNION ALL ".join(f"SELECT DISTINCT '{k}' AS store, {v} AS id FROM t_{k}" for k, v in _TABLES.items()), TOUCHED),
    "inc_graph": on_corpus(f"SELECT rel_type, source_label, target_label, count(*) AS n FROM ({edges_of({k: f't_{k}' for k in _TABLES})}) GROUP BY ALL", TOUCHED),
    "filename_metadata": rf"SELECT path, CASE WHEN split THEN string_split(s, '_')[1] END AS book_label, CASE WHEN split THEN substr(s, instr(s, '_') + 1) ELSE s END AS chapter_label FROM (SELECT *, starts_with(s, 'book') AND contains(s, '_') AND (regexp_matches(substr(string_split(s, '_')[1], 5), '^[0-9]+$') OR length(string_split(s, '_')[1]) > 4) AS split FROM (SELECT path, {_STEM} AS s FROM {_FILES}))",
    "changed_files": rf"SELECT path FROM {_FILES} WHERE starts_with(path, '/in/') AND regexp_matches(lower(path), '[^/]\.(txt|md|markdown|docx|pdf)$')",
    # by hand: taken are a.txt, a (2), a (4), c.md, b (x).MD, and an upload is itself named c (2).md
    "upload_names": "SELECT * FROM " + values([(0, 'a.txt', 'a (3).txt'), (1, 'a.txt', 'a (5).txt'), (2, 'b.MD', 'b.MD'), (3, 'a.txt', 'a (6).txt'), (4, 'b.MD', 'b (2).MD'), (5, 'c (2).md', 'c (2).md'), (6, 'c.md', 'c (3).md'), (7, 'c.md', 'c (4).md'), (8, 'noend', 'noend'), (9, 'noend', 'noend (2)'), (10, '.txt', '.txt')], "upload_id, name, stored_name"),
    "source_ids_from_paths": f"SELECT DISTINCT source_id FROM (SELECT {_STEM} AS source_id FROM {_FILES}) WHERE source_id <> ''",
}

ORACLE_SQL |= {f"{name}_story": ORACLE_SQL[name].replace(corpus.sql(), corpus.story_sql()) for name in STORY}
_LABELLED = lambda sql: sql.replace(corpus.sql(), corpus.story_sql()).replace("source_id = 'book2_ch01'", "source_id IN (SELECT 'd' || doc_id FROM labels)")
ORACLE_SQL |= {"inc_payload_story": _LABELLED(ORACLE_SQL["inc_payload"]), "inc_graph_story": _LABELLED(on_corpus(edges_of({k: f"t_{k}" for k in _TABLES}), TOUCHED))}
