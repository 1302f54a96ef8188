"""Secret scans (operator 8): fixed patterns, and strings near sensitive words that zstandard cannot shorten from what it knows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order that spans at one place take.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 or more
#: Words that make the text after them sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "privatekey", "credential", "auth", "bearer", "signature", "client_id", "session", "akia")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
#: Characters that a candidate has at least, and signs that it consists of; a sentence's last sign is not its own.
_LEAST = 16
_SIGNS = "A-Za-z0-9+/_=.!@#$%^&*~?-"
_CANDIDATE = re.compile(rf"[{_SIGNS}]{{{_LEAST},}}")
#: Characters beyond which a candidate's cost is measured against its alphabet.
_LONG = 64
_SIGN = re.compile(rf"[{_SIGNS}]")
#: Shapes that carry no secret however new they are: dates and times, e-mail addresses, versions.
_HARMLESS = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T.+Z-]*|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|v?[0-9]+(\.[0-9]+)+(-[a-z]+[0-9.]*)?")
#: Identifiers and words of code and configuration that prime the compressor.
IDENTIFIERS = (
    "abstract access_token account address admin algorithm api_key application arguments array assert async attribute authorization "
    "await backend base64 basic bearer boolean branch break bucket buffer build bytes cache callback catch certificate class client "
    "client_id client_secret close cluster code column command comment commit config configuration connect connection const constructor "
    "container content context continue controller cookie create credentials cursor data database datetime debug decode default define "
    "delete deploy description development directory docker document domain download element else email enabled encode encoding "
    "encryption endpoint environment error event example exception execute export extends false file filter finally float folder "
    "format from function generate github global group handler hash header hostname html http https identifier image implements "
    "import index information init input insert instance integer interface internal invalid item json key language length library "
    "list load local localhost location logger login main manager master message method model module name namespace network null "
    "number object option output package parameter parse password path pattern payload permission platform plugin port prefix "
    "private process production profile project property protected protocol provider public python query queue random read record "
    "redirect reference region register release remote repository request required resource response result return role root route "
    "sample schema script secret secret_key section select self sender server service session settings signature size socket source "
    "start state static status storage stream string struct style subject submit success super switch system table target task temp "
    "template test text thread throw timeout timestamp title token tools transaction transform true type undefined unique update "
    "upload url user username utils valid value variable vector version view void warning while window worker write xml yaml "
    "changeme dummy fake foo goes here insert my none placeholder put replace sample some unset with your"
)


@lru_cache(maxsize=2)
def _primed(identifiers: str, level: int) -> zstandard.ZstdCompressor:
    words = identifiers.split()
    primed = " ".join(words) + "_".join(words) + "".join(w.capitalize() for w in words) + "_".join(words).upper() + "0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(primed.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str, identifiers: str = IDENTIFIERS, level: int = 9) -> float:
    """Bytes that the candidate adds to its surroundings once compressed, for each of its characters."""
    compress = _primed(identifiers, level).compress
    around = (before + after).encode("utf-8", "replace")
    return (len(compress(around + b"\n" + candidate.encode("utf-8", "replace"))) - len(compress(around + b"\n"))) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()  # a superset of ASCII folding, to pass over texts without any of the words
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def novel_spans(text: str, base: list[tuple[str, int, int]], least: float, reach: int, context: int) -> list[tuple[str, int, int]]:
    """Candidates that begin within reach behind a sensitive word or end within reach before one, outside base spans, and add least bytes a character."""
    low, out = text.lower(), []
    if not any(w in low for w in SENSITIVE):
        return out
    taken = sorted((s, e) for _, s, e in base)
    upto = 0
    for word in _SENSITIVE.finditer(text):
        at, last = max(upto, word.start() - reach), word.end() + reach
        while at > upto and _SIGN.match(text, at - 1):  # a candidate has its whole length, however long it is
            at -= 1
        while found := _CANDIDATE.search(text, at, last + _LEAST):
            m = _CANDIDATE.match(text, found.start())
            at, string = m.end(), m[0].rstrip(".!?")
            end = m.start() + len(string)
            if len(string) < _LEAST or _HARMLESS.fullmatch(string) or any(s < end and m.start() < e for s, e in taken):
                continue
            # the compressor writes so long a string in the bits that its alphabet needs, a shorter one as it is
            bits = 8 if len(string) <= _LONG else log2(max(2, len(set(string))))
            if novelty(text[max(0, m.start() - context) : m.start()], string, text[end : end + context]) >= least * bits / 8:
                out.append(("novel", m.start(), end))
        upto = max(upto, at, last)
    return out


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_novelty: float = 0.8, reach: int = 40, context: int = 1024) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then kind as in KINDS: a row per row of docs.

    Offsets are code points of the text as it is, ends exclusive. Kinds assign, access and hex are the fixed patterns;
    novel are strings of 16 or more letters, digits and signs, at most reach characters from a sensitive word on either
    side, which cost least_novelty compressed bytes a character beside context characters around them and an identifier
    dictionary (beyond 64 characters, that share of the bits that their alphabet needs): random strings cost 0.8 to 1, and words that the text or the dictionary knows seldom so much. Null and empty texts have no spans; equal rows have equal spans; an empty table gives no rows; other
    columns play no part.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([d.schema["doc_id"], T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column("text"):
                body = body.as_py()
                base = base_spans(body)
                found = base + novel_spans(body, base, least_novelty, reach, context)
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(found, key=lambda x: (x[1], rank[x[0]]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, arrow)], schema.names)

    return d.mapInArrow(scanned, schema)
