"""PII (operator 6): fixed patterns seed a bootstrapped search for identifiers in the same contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import dropped, power_of_two, written
from loreweave.llm.ngrams import with_window_hashes

#: Kinds in their order, and a Java pattern for each. Possessive loops and look-behinds leave the matches as
#: they are and keep long runs linear and off the stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A string that can be an identifier: what blanks part, where a digit or @ is near its start, with the groups of digits
#: that follow behind single blanks. Once the punctuation around it is gone it has SIZES characters, and three digits or an @.
CANDIDATE = r"(?<![A-Za-z0-9@._+()/#:-])(?=[A-Za-z._+(/#:-]{0,63}[0-9@])[A-Za-z0-9@._+()/#:-]++(?:\x20[0-9(][0-9@._+()/#:-]*+(?![A-Za-z]))*+"
SIZES = (6, 64)
_AROUND = r"^[._/#:)-]+|[._+(/#:-]+$"
#: Characters before and behind a place in which its context words, runs of letters, are sought.
NEAR = 80
_BLOCK = 256
#: Characters of a piece of a text; a place's surroundings lie in two.
_PIECE = 256
#: The bit table of contexts that is sent to every task has so many bits at most; fuller, it only prunes less.
MOST_BITS = 1 << 22


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _with_sums(d: DataFrame, size: str) -> DataFrame:
    """Adds block and before, the sums of each block of _BLOCK sizes and of all blocks before it."""
    last = F.floor((F.size(size) - 1) / _BLOCK).cast("int")
    d = d.withColumn("block", F.when(F.size(size) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(size, b * _BLOCK + 1, _BLOCK)))))
    return d.withColumn("before", F.transform("block", lambda x, b: _sum(F.slice("block", 1, b))))


def _ahead(size: str, i: Column) -> Column:
    """The sum of the sizes before place i: by blocks, so that a text with very many places stays cheap."""
    b = F.floor(i / _BLOCK).cast("int")
    return F.get("before", b) + _sum(F.slice(size, b * _BLOCK + 1, i % _BLOCK))


def _with_spans(d: DataFrame, kind: str, pattern: str, maybe: Column) -> DataFrame:
    """Adds the kind's (kind, start, end, match) in order of start, told from the lengths of the gaps between matches."""
    none = F.array().cast("array<string>")
    d = d.withColumn("m", F.when(maybe, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    d = d.withColumn("gap", F.when(F.size("m") > 0, F.split("text", pattern, -1)).otherwise(none))
    d = d.withColumn("size", F.zip_with(F.slice("gap", 1, F.size("m")), "m", lambda g, m: F.length(g) + F.length(m)))
    d = _with_sums(d, "size")

    def span(m: Column, i: Column) -> Column:
        start = _ahead("size", i) + F.length(F.get("gap", i))
        return F.when(_valid(kind, m), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match")))

    spans = F.filter(F.transform("m", span), lambda x: x.isNotNull())
    return d.withColumn(kind, F.when(F.size("m") > 0, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>"))).drop("m", "gap", "size", "block", "before")


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        n = F.length(digits)
        twice = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        return F.when(n.between(13, 19), _sum(F.transform(twice, lambda x: F.when(x > 9, x - 9).otherwise(x))) % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _text_mark() -> Column:
    """What a text is, as equal rows have equal spans wherever they lie."""
    return F.sha2("text", 256)


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null as empty) and an array of (kind, start, end, match) for each kind."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind in KINDS:
        maybe = F.contains("text", F.lit(NEEDS[kind])) if kind == "email" else F.col("text").rlike(NEEDS[kind])
        d = _with_spans(d, kind, PATTERNS[kind], maybe)
    return d


def _words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _near(start: Column, end: Column) -> Column:
    """The characters from start to end, NEAR at most: from the two pieces of the text where they lie, as reading on from the
    text's begin for each place would take the square of its length."""
    i = F.floor(start / _PIECE).cast("int")
    two = F.concat(F.coalesce(F.get("pieces", i), F.lit("")), F.coalesce(F.get("pieces", i + 1), F.lit("")))
    return F.substring(two, start - i * _PIECE + 1, end - start)


def _contexts(start: Column, end: Column) -> Column:
    """The lexical patterns of a place: side, and the word or two words next to it on that side."""
    before, behind = _words(_near(F.greatest(F.lit(0), start - NEAR), start)), _words(_near(end, end + NEAR))
    n = F.size(before)
    pair = lambda side, a, b: F.concat_ws(" ", F.lit(side), a, b)
    each = [F.when(n > 0, pair("<", F.get(before, n - 1), F.lit(None))), F.when(n > 1, pair("<", F.get(before, n - 2), F.get(before, n - 1)))]
    each += [F.when(F.size(behind) > 0, pair(">", F.get(behind, F.lit(0)), F.lit(None))), F.when(F.size(behind) > 1, pair(">", F.get(behind, F.lit(0)), F.get(behind, F.lit(1))))]
    return F.filter(F.array(*each), lambda c: c.isNotNull())


def _overlaps(kind: str, c: Column) -> Column:
    """Whether a kind's spans, which stand apart and in order, overlap c: the block of spans is found first, then the span."""
    at = F.greatest(F.size(F.filter(f"{kind}_heads", lambda h: h < c["end"])) - 1, F.lit(0))
    return F.exists(F.slice(kind, at * _BLOCK + 1, _BLOCK), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _places(d: DataFrame) -> DataFrame:
    """Adds places (kind, token, start, end, contexts): the base spans, and strings that can be identifiers and overlap none, whose kind is null."""
    d = _with_spans(d, "candidate", CANDIDATE, F.col("text").rlike("[0-9@]"))
    d = d.withColumn("pieces", F.when((F.size("spans") > 0) | (F.size("candidate") > 0), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    for kind in KINDS:
        last = F.floor((F.size(kind) - 1) / _BLOCK).cast("int")
        d = d.withColumn(f"{kind}_heads", F.when(F.size(kind) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.get(kind, b * _BLOCK)["start"])).otherwise(F.array().cast("array<int>")))  # noqa: B023

    def trimmed(c: Column) -> Column:
        token = F.regexp_replace(c["match"], _AROUND, "")
        start = c["start"] + F.length(F.regexp_extract(c["match"], r"^[._/#:)-]*", 0))
        return F.struct(F.lit(None).cast("string").alias("kind"), token.alias("token"), start.alias("start"), (start + F.length(token)).alias("end"))

    def fits(c: Column) -> Column:
        shaped = F.length(c["token"]).between(*SIZES) & c["token"].rlike(r"@|[0-9][^0-9]*[0-9][^0-9]*[0-9]")
        for kind in KINDS:
            shaped = shaped & ~_overlaps(kind, c)
        return shaped

    base = F.transform("spans", lambda b: F.struct(b["kind"].alias("kind"), b["match"].alias("token"), b["start"].alias("start"), b["end"].alias("end")))
    both = F.concat(base, F.filter(F.transform("candidate", trimmed), fits))
    placed = F.transform(both, lambda p: F.struct(p["kind"].alias("kind"), p["token"].alias("token"), p["start"].alias("start"), p["end"].alias("end"), _contexts(p["start"], p["end"]).alias("contexts")))
    return d.withColumn("places", placed).drop("candidate", "pieces", *[f"{kind}_heads" for kind in KINDS])


def _frequencies(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """context, total: how often the words of each pattern stand in the corpus, whatever is next to them."""
    own = patterns.select("context", F.split("context", " ").alias("w")).select("context", F.when(F.size("w") == 2, F.xxhash64(F.col("w")[1])).otherwise(F.xxhash64(F.xxhash64(F.col("w")[1]), F.xxhash64(F.col("w")[2]))).alias("h"))
    own = written(own, "pattern-hashes")
    bits = min(MOST_BITS, max(64, power_of_two(16 * own.count())))
    rows = own.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).collect()
    longs = [0] * (bits // 64)
    for r in rows:
        longs[r["at"]] = r["v"]
    table = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")

    def known(h: Column) -> Column:
        return F.call_function("shiftright", F.get(table, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    d = with_window_hashes(docs.select(_words(F.col("text")).alias("low")), "low", [1, 2], "h_")
    met = d.select(F.explode(F.concat(F.filter("h_1", known), F.filter("h_2", known))).alias("h")).groupBy("h").agg(F.count("*").alias("total"))
    out = written(own.join(met, "h").select("context", "total"), "pattern-totals")
    dropped(own)
    return out


def _scores(graph: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """kind, context, confidence, support, places of the patterns of graph (kind, context, token, n).

    In turn, a pattern's confidence is the share of its places that hold believed instances, and an instance's score
    the chance that any of its patterns is right; seeds are certain.
    """
    score = written(seeds.select("kind", "token", F.lit(1.0).alias("score")), "instance-scores")
    patterns = None
    for step in range(rounds):
        told = graph.join(score, ["kind", "token"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        told = told.groupBy("kind", "context").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"), F.count_if(F.col("score") == 1.0).alias("support"), F.sum("n").alias("places"))
        if patterns is not None:
            dropped(patterns)
        patterns = written(told, "pattern-scores")
        dropped(score)
        if step < rounds - 1:
            found = graph.join(patterns, ["kind", "context"]).groupBy("kind", "token").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("found"))
            both = found.join(seeds.withColumn("seed", F.lit(1.0)), ["kind", "token"], "left")
            score = written(both.select("kind", "token", F.coalesce("seed", F.least("found", F.lit(0.999))).alias("score")), "instance-scores")
    return patterns


def discovered(docs: DataFrame, places: DataFrame, least_seeds: int = 5, least_confidence: float = 0.5, least_selectivity: float = 0.05, rounds: int = 3) -> DataFrame | None:
    """doc_id, mark, kind, start, end of identifiers in high-confidence patterns; None where there is no such pattern.

    docs: text. places: doc_id, mark, places. Contexts of least_seeds different seeds of a kind become patterns. A
    pattern is good if least_confidence of the identifier-like places it has hold believed instances, and
    least_selectivity of all places of its words in the corpus are such places: function words are not.
    """
    one = places.where(F.size("places") > 0).select("doc_id", "mark", F.explode("places").alias("p")).select("doc_id", "mark", "p.*")
    each = one.select("kind", "token", F.explode("contexts").alias("context")).groupBy("kind", "token", "context").agg(F.count("*").alias("n"))
    edges = written(each, "context-instances")
    patterns = written(edges.where(F.col("kind").isNotNull()).groupBy("kind", "context").agg(F.count("*").alias("k")).where(F.col("k") >= least_seeds).select("kind", "context"), "patterns")
    if patterns.isEmpty():
        dropped(edges)
        dropped(patterns)
        return None
    counted = edges.groupBy("context", "token").agg(F.sum("n").alias("n"))
    graph = written(counted.join(patterns, "context").select("kind", "context", "token", "n"), "pattern-graph")
    seeds = written(edges.where(F.col("kind").isNotNull()).select("kind", "token").distinct(), "seed-instances")
    scores = _scores(graph, seeds, rounds)
    sure = written(scores.where((F.col("confidence") >= least_confidence) & (F.col("support") >= least_seeds)), "sure-patterns")
    for x in (edges, patterns, graph, seeds, scores):
        dropped(x)
    if sure.isEmpty():
        dropped(sure)
        return None
    total = _frequencies(docs, sure.select("context").distinct())
    good = sure.join(total, "context").where(F.col("places") >= least_selectivity * F.col("total")).groupBy("context").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    good = written(good.select("context", "best"), "good-patterns")
    met = one.where(F.col("kind").isNull()).select("doc_id", "mark", "start", "end", F.explode("contexts").alias("context")).join(good, "context")
    found = written(met.groupBy("doc_id", "mark", "start", "end").agg(F.max("best").alias("best")).select("doc_id", "mark", F.col("best.kind").alias("kind"), "start", "end"), "found-identifiers")
    for x in (sure, total, good):
        dropped(x)
    return found


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_seeds: int = 5, least_confidence: float = 0.5, least_selectivity: float = 0.05, rounds: int = 3) -> DataFrame:
    """doc_id, base and spans, arrays of (kind, start, end) by kind as in KINDS, then start: a row per row of docs.

    base are the fixed patterns, leftmost and not overlapping within a kind, less those that fail (address parts above
    255, card numbers not of 13 to 19 digits or not passing Luhn, telephone numbers not of 9 to 15 digits); spans has
    those too, and what bootstrapping adds: identifier-like strings (see CANDIDATE) in contexts that mostly hold
    identifiers, where they overlap no base span, under the kind of that context. A context is the word, or two words, to
    the left or right within NEAR characters, lower-cased, punctuation and digits passed over. Offsets are code points,
    ends exclusive. Null and empty texts have none; equal rows have equal spans; an empty table gives no rows; other
    columns play no part.
    """
    found = base_spans(docs, doc_id, text).withColumn("mark", _text_mark()).withColumn("spans", F.concat(*KINDS))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = written(_places(found).drop(*KINDS).select("doc_id", "mark", bare("spans").alias("base"), "places"), "base-spans")
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    new = discovered(plain, base, least_seeds, least_confidence, least_selectivity, rounds)
    out = base.select("doc_id", "mark", "base")
    if new is None:
        return out.select("doc_id", "base", F.col("base").alias("spans"))
    more = new.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")).select(F.struct("doc_id", "mark").alias("of"), "more")
    out = out.withColumn("own", F.struct("doc_id", "mark"))
    out = out.join(more, out["own"].eqNullSafe(more["of"]), "left")
    fresh = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    ranked = F.array_sort(F.transform(F.concat("base", fresh), lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.select("doc_id", "base", bare(ranked).alias("spans"))
