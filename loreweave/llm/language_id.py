"""Language ID (operator 3): cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of labelled text per language that its automaton is built from, and documents they come from at most.
TRAIN_CHARS, TRAIN_DOCS = 12_000, 400
#: Texts are parsed in blocks of so many characters; a phrase does not cross blocks.
BLOCK = 1024
UNKNOWN = "und"


def folded(text: str) -> str:
    """Letters lower-cased, runs of anything else as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str, codes: dict[str, int], width: int) -> np.ndarray:
    """Transitions (state, code) of the automaton of all substrings; state 0 is none and state 1 the root."""
    rows: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in (codes[x] for x in text):
        new = len(rows)
        rows.append({})
        link.append(1)
        length.append(length[last] + 1)
        at = last
        while at and c not in rows[at]:
            rows[at][c] = new
            at = link[at]
        if at:
            to = rows[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(rows)
                rows.append(dict(rows[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at and rows[at].get(c) == to:
                    rows[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    out = np.zeros((len(rows), width), np.int32)
    for i, row in enumerate(rows):
        for c, to in row.items():
            out[i, c] = to
    return out


class Parser:
    """Cross-parsing against several automata at once."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        alphabet = sorted({c for s in samples.values() for c in s})
        self.codes = {c: i + 1 for i, c in enumerate(alphabet)}  # code 0: a character no language has
        self.width = len(alphabet) + 1
        tables, self.roots, n = [], [], 0
        for k in self.languages:
            own = suffix_automaton(samples[k], self.codes, self.width)
            tables.append(np.where(own > 0, own + n, 0))
            self.roots.append(n + 1)
            n += len(own)
        self.next = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        self.lut = np.zeros(1 << 16, np.int32)
        for c, i in self.codes.items():
            if ord(c) < len(self.lut):
                self.lut[ord(c)] = i
        self.root = np.array(self.roots, np.int64)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language: from where the last phrase ended, the longest match, or one unknown character."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        blocks, owner = [], []
        for i, text in enumerate(texts):
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            own = np.where(points < len(self.lut), self.lut[np.minimum(points, len(self.lut) - 1)], 0)
            for at in range(0, len(own), BLOCK):
                blocks.append(own[at : at + BLOCK])
                owner.append(i)
        if not blocks or not self.languages:
            return out
        order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
        size = np.array([len(blocks[i]) for i in order])
        codes = np.zeros((size[0], len(order)), np.int64)
        for row, i in enumerate(order):
            codes[: size[row], row] = blocks[i]
        count = np.zeros((len(order), len(self.languages)), np.int64)
        state = np.zeros((len(order), len(self.languages)), np.int64)  # 0: a new phrase is about to begin
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # blocks longer than the place
        for place in range(size[0]):
            n = alive[place]
            c, now = codes[place, :n, None], state[:n]
            went = self.next[now * self.width + c]
            ended = went == 0
            count[:n] += ended  # a phrase begins at this character
            begun = self.next[self.root * self.width + c]
            state[:n] = np.where(ended, begun, went)
        np.add.at(out, np.array([owner[i] for i in order]), count)
        return out


def learn(labelled: DataFrame, chars: int = TRAIN_CHARS, docs: int = TRAIN_DOCS, text: str = "text", lang: str = "lang") -> dict[str, str]:
    """A sample of text per language: chars characters at most, in equal shares from docs distinct texts with letters (or
    all, where there are fewer) whose hashes are the least of those that pass a rate."""
    d = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    d = d.withColumn("h", F.xxhash64("text"))
    n = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}  # a row per language
    if not n:
        return {}
    rate = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, 2 * docs / v)))])
    picked = d.where(F.pmod("h", F.lit(1 << 40)) < rate[F.col("lang")] * (1 << 40))  # twice as many as are wanted, so that too few are improbable
    size = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(2 * chars // min(docs, v) + 1))])
    per_doc = size[F.col("lang")]
    # of each chosen text a slice from anywhere in it is enough; what reaches the driver is bounded by languages and chars
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - per_doc + 1)) + 1
    rows = picked.select("lang", "h", F.substring("text", begin.cast("int"), per_doc).alias("text")).distinct().groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "text"))), 1, docs).alias("rows")).collect()
    out = {}
    for r in rows:
        told = [x for x in (folded(y["text"]) for y in r["rows"]) if x]
        share = max(1, chars // len(told) - 1) if told else 0  # and a space
        whole = " ".join(x[:share].rstrip() for x in told)[:chars]
        if whole:
            out[r["lang"]] = whole
    return out


def identify(docs: DataFrame, samples: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1): a row per row of docs, each whole text parsed against every language.

    The language that needs fewest phrases wins, each count being normalised by what the others need: score is how far
    it lies below the second, as a share of that (1 with a single language). Ties go to the language first by name. A
    null text, or one without a letter, is und with score 0, and so is all where nothing was learned. Equal rows are
    told alike; an empty table gives no rows; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # TRAIN_CHARS characters a language
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = [folded(x.as_py()) for x in batch.column("text")]
                count = parser.phrases(texts)
                lang, score = [], []
                for text, own in zip(texts, count):
                    if not text or not len(own):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    best = int(own.argmin())
                    second = min((int(x) for i, x in enumerate(own) if i != best), default=0)
                    lang.append(parser.languages[best])
                    score.append(1.0 if len(own) == 1 else 1 - own[best] / second)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return d.mapInArrow(told, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 by 4. A null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
