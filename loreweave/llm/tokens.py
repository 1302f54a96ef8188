"""Token ids by the tokenizers library, with each distinct word encoded once while a worker remembers it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers, past which it starts anew, and characters of text that are looked up together.
CACHED, CHARS = 700_000, 4_000_000
#: White space or separators beyond ASCII, where words need not be encoded alike alone and together.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Where one of these is, or a blank is first or last, a space or line end need not stand alone between words: the same.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\f", "\v", "\x1c", "\x1d", "\x1e", "\x1f")


class WordEncoder:
    """encode() gives the ids of texts as little-endian unsigned integers of self.width bytes.

    The ids are those of Tokenizer.encode(text, add_special_tokens=False). Byte-level BPE parts a text before each single
    space, and around each single line end, so that words are encoded alike alone and together; texts where that need not
    hold, other kinds of tokenizers and texts with the string of an added token go to the library whole.
    special_as_text: strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self.by_words = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = tuple(t["content"] for t in spec.get("added_tokens", ()) if t["content"])
        if self.by_words and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each word comes here once; only speed depends on it
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[:1] in ("Ġ", "Ċ")]] = True  # ids that start with a space or line end
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 16, self.kind), np.zeros(1, np.int64), 0

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, words: list[str]) -> None:
        """Encodes words in one call; one that starts with a line end has that in front of it, any other a space. Each
        begins with an id that starts so, and no other id does."""
        behind = [w if w[0] == "\n" else f" {w}" for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(behind)], add_special_tokens=False)[0].ids, self.kind)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(words):
            each = [self._whole(x) for x in behind]
            ids, at = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])[:-1]]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends = np.concatenate([self.ends, np.r_[at[1:], len(ids)] + self.used])
        self.used += len(ids)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))

    def _fits(self, text: str) -> bool:
        """Whether words of the text are encoded alike alone and together."""
        if not text or not self.by_words or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RUNS) or any(x in text for x in self.added):
            return False
        return text.isascii() or not _ODD.search(text)

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        split = pc.split_pattern(pa.array(["\n" + x.replace("\n", " \n") for x in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.place) + len(words) > CACHED:
            self._forget()
        if new := [w for w in words if w not in self.place]:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        begin = self.ends[place]
        size = self.ends[place + 1] - begin
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(begin - upto + size, size) + np.arange(upto[-1])]
        cut = np.r_[0, upto][split.offsets.to_numpy()]
        line_end = len(self._whole("\n"))  # that was put in front of each text
        return [ids[i + line_end : j] for i, j in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        for some in _portions(texts):
            fit = [i for i in some if self._fits(texts[i])]
            for i in set(some).difference(fit):
                out[i] = self._whole(texts[i]).tobytes()
            if fit:
                for i, ids in zip(fit, self._by_words([texts[i] for i in fit])):
                    out[i] = ids.tobytes()
        return out


def _portions(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, in portions of about CHARS characters."""
    some, size = [], 0
    for i, x in enumerate(texts):
        some.append(i)
        size += len(x)
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One for each worker and vocabulary file."""
    return WordEncoder(path, special_as_text)
