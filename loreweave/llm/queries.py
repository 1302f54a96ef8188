"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import decontaminate, importance, language_id, license_scan, line_dedup, merkle, packing, pii, quality, secret_scan, simhash, token_files, warc
from loreweave.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, _byte_bpe(), end_id=2)
    return token_files.read_tokens(spark, path)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    samples = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, samples)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "dice", F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(_table(spark, sf_dir, "documents"))
    counts = [_count("base", k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _byte_bpe(), capacity=2048, end_id=1, with_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    counts = [_count("spans", k) for k in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), least_chars=40, least_docs=5, counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf(F.col("text")))
    found = merkle.merkle_manifest(d.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered")))
    told = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).drop("fault")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
}



def _crc_table() -> str:
    """The 256 remainders by which CRC-32 goes through a string byte by byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(f"{c}::BIGINT")
    return f"[{', '.join(out)}]"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, in SQL."""
    each = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])))"


def _merkle_sql(levels: int = 12, upper: int = 4) -> str:
    """Trees of up to 3 ** levels leaves each, over up to 3 ** upper sources."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    out = [f"""d AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM documents)"""]

    def grow(name: str, first: str, steps: int) -> str:
        """Levels by (grp, pos) until one node is left: h is the digest, n the nodes of the level."""
        out.append(f"{name}0 AS ({first})")
        for i in range(steps):
            out.append(f"{name}{i + 1} AS (SELECT grp, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, CAST(ceil(any_value(n) / 3.0) AS BIGINT) AS n FROM {name}{i} GROUP BY grp, pos // 3)")
        return f"{name}{steps}"

    top = grow("t", "SELECT grp, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM d", levels)
    root = grow("u", f"SELECT 0 AS grp, grp AS pos, h, count(*) OVER () AS n FROM {top}", upper)
    state = "SELECT doc_id, grp, pos, leaf, changed AS f, '' AS p FROM d"
    for name, steps, at in (("t", levels, "pos"), ("u", upper, "pos")):
        if name == "u":
            state = f"SELECT s.doc_id, s.grp AS own, 0 AS grp, s.grp AS pos, s.leaf, s.f, s.p FROM ({state}) s"
        for i in range(steps):
            run = f"(SELECT grp, pos // 3 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {name}{i} GROUP BY grp, pos // 3)"
            own = "s.own, " if name == "u" else ""
            out.append(f"{name}p{i} AS (SELECT s.doc_id, {own}s.grp, s.pos // 3 AS pos, s.leaf, CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(hs[1:s.pos % 3], '') || f || array_to_string(hs[s.pos % 3 + 2:], '')) END AS f, CASE WHEN n = 1 THEN p ELSE p || array_to_string(hs[1:s.pos % 3], '') || array_to_string(hs[s.pos % 3 + 2:], '') END AS p FROM ({state}) s JOIN {run} r ON s.grp = r.grp AND s.pos // 3 = r.run)")
            state = f"SELECT * FROM {name}p{i}"
    return f"""WITH {', '.join(out)}
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u.h AS verified FROM ({state}) s JOIN {top} t ON s.own = t.grp CROSS JOIN {root} u"""


def _base32(hexes: str) -> str:
    """A 40-digit hex string in base 32, in SQL."""
    each = "list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr({0}, {1}, 10) AS BIGINT) >> (35 - 5 * j)) & 31) + 1 AS BIGINT), 1))"
    return " || ".join(f"array_to_string({each.format(hexes, 10 * i + 1)}, '')" for i in range(4))


ORACLE_SQL: dict[str, str] = {
    "op11_importance_resampling": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), own AS (
  SELECT doc_id, f, count(*) AS n FROM (
    SELECT doc_id, unnest(ws) AS f FROM d UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) > 1)) GROUP BY doc_id, f
), aim AS (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(ws) AS f FROM b UNION ALL SELECT ws[i] || ' ' || ws[i + 1] FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM b WHERE len(ws) > 1)) GROUP BY f
), known AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM own UNION SELECT f FROM aim)
), s AS (SELECT bucket, sum(n) AS n FROM own JOIN known USING (f) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM aim JOIN known USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM own JOIN known USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), told AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(floor(total::DOUBLE / n_features), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN sums USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM told WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM told LEFT JOIN ranked USING (doc_id)
""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), first AS (SELECT html, min(page_id) AS of FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, {_base32("upper(sha1(html))")} AS payload_digest, CASE WHEN page_id = of THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> of THEN of END AS refers_to
FROM p JOIN first USING (html)
""",
    "op2_decontamination": r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM grams
), spots AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM norm, lens)
), hits AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN grams USING (n, gram)
), inside AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN inside USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op9_line_dedup": r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), told AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
""",
    "op10_quality_rules": r"""
WITH norm AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), spots AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM norm WHERE len(ws) >= 5)
), twice AS (
  SELECT doc_id, i FROM spots JOIN (SELECT doc_id, gram FROM spots GROUP BY doc_id, gram HAVING count(*) > 1) USING (doc_id, gram)
), inside AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
    count(*) FILTER (regexp_matches(x, '^[\x20\x09-\x0D]*[•*-]')) AS n_bullets, count(*) FILTER (regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipses FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM norm) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses
  FROM norm LEFT JOIN inside USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 1.5 * n_words OR word_chars > 25 * n_words OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 30 * n_lines) AS kept
FROM m
""",
}
