"""Ids of a word-level BPE tokenizer, each distinct word encoded once per task.

The tokenizer drops white space and splits the rest into words before it
merges, so the ids of a text are those of its space-separated strings in order.
Distinct words are encoded by the library and kept in a bounded dictionary.
Texts for which that shortcut could differ from the library (characters whose
normalisation depends on neighbours, or special tokens) go to the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from cladewise.llm.common import by_size, interned, rows_of

#: Words kept by a task; strings encoded at a time; characters whose distinct strings are looked up together.
CACHED_WORDS, BATCH, RUN_CHARS = 400_000, 512, 8_000_000

#: Plain Latin text: no combining marks, no spaces but these, no letter whose lower case depends on its place.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-įĲ-ɏ]*")


def _part(text: str, name: str) -> dict | list:
    """One entry of a tokenizer's file, without making objects of its vocabulary."""
    at = regex.search(rf'"{name}"\s*:\s*', text).end()
    return json.JSONDecoder().raw_decode(text, at)[0]


class WordEncoder:
    """``ids(texts)``: for each text the ids that the library gives for it, without added tokens."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, run_chars: int = RUN_CHARS) -> None:
        from tokenizers import Tokenizer

        self.cached_words, self.run_chars = cached_words, run_chars
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            text = file.read()
        split = next(p for p in _part(text, "pre_tokenizer")["pretokenizers"] if p["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the tokenizer must keep the matches of one pattern")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in _part(text, "added_tokens")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode new words, many at a time; the library tells which word each id belongs to."""
        ids, sizes = [self.flat], [self.size]
        for i in range(0, len(words), BATCH):
            some = words[i:i + BATCH]
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            per_word = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(some))
            if len(per_word) != len(some):
                raise ValueError("the tokenizer splits words otherwise than its pattern")
            ids.append(np.array(found.ids, dtype="<u4"))
            sizes.append(per_word)
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.flat, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        strings, codes, bounds = interned(pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string()))))
        findall = self.word.findall
        words = [[s] if s.isalpha() else findall(s) for s in strings]
        count = np.fromiter(map(len, words), np.int64, len(words))
        words = list(chain.from_iterable(words))
        if len(self.known) > self.cached_words:
            self.forget()
        if missing := [w for w in dict.fromkeys(words) if w not in self.known]:
            self.learn(missing)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        flat = rows_of(self.flat, self.start, self.size, at)
        before = np.concatenate([[0], np.cumsum(self.size[at])])
        ends = np.cumsum(count)
        start = before[ends - count]
        size = before[ends] - start
        return [rows_of(flat, start, size, codes[a:b]) for a, b in zip(bounds, bounds[1:])]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for some in by_size(texts, self.run_chars):
            plain = [i for i in some if PLAIN.fullmatch(texts[i]) and not any(s in texts[i] for s in self.special)]
            for i, ids in zip(plain, self.plain_ids([texts[i] for i in plain])):
                out[i] = ids
            for i in set(some).difference(plain):
                out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> WordEncoder:
    """An encoder that a Python worker keeps between its tasks: less to encode, more memory."""
    return WordEncoder(path)
