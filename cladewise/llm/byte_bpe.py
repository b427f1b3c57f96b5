"""Byte-level BPE, encoding and decoding, by replaying merges over a corpus of words.

The distinct words of many documents are laid out as one array of symbols.  An
inverted index holds, for each mergeable pair, the positions where it stands.
Pairs are taken in rank order; a merge is applied to all its positions at once
and only the pairs left and right of a merged position are looked up anew and
entered into the index.  Words stay in a bounded dictionary, so that a task only
replays the merges for words it has not met.

Ids are those of the rank file: a pair of neighbours can merge if the bytes of
both together are a token, the lowest rank first, the leftmost first among
equals.  Where a merge opens a pair of a lower rank than its own, the order of
positions could matter; such words are replayed one merge at a time.

Defined cases: a null or empty text has no ids and decodes to no bytes; strings
that name special tokens are ordinary text; each row is encoded by itself, also
where rows repeat or have no doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cladewise.llm.common import by_size, interned, map_runs, rows_of, text_or_empty

#: Words kept by a task; characters whose distinct words are replayed together.
CACHED_WORDS, RUN_CHARS = 300_000, 8_000_000
NONE = np.int32(1 << 30)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class MergeReplay:
    """Ids of words (bytes) by merge replay."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(ranks.values()) + 1
        pairs = [
            (ranks[token[:cut]] * self.width + ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [int(NONE)], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that merging each pair gives; NONE where the pair can't merge."""
        key = left * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], int(NONE))

    def alone(self, word: bytes) -> list[int]:
        """One word, one merge at a time."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, int(NONE)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; all words are merged together, pair by pair in rank order."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = int(size.sum())
        symbol = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        right[ends[size > 0] - 1] = -1
        left[(ends - size)[size > 0]] = -1
        alive = np.ones(n, dtype=bool)
        pair_rank = np.full(n, int(NONE), dtype=np.int64)  # of the pair that starts at a position
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            """Add positions to the index, each under the rank of its pair."""
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for some, rank in zip(np.split(at, cuts), ranks[np.concatenate([[0], cuts])].tolist()):
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heapq.heappush(heap, rank)

        def look(at: np.ndarray) -> None:
            """Look up the pairs that start at the positions, and enter those that can merge."""
            pair_rank[at] = int(NONE)
            at = at[right[at] >= 0]
            ranks = self.rank_of(symbol[at], symbol[right[at]])
            pair_rank[at] = ranks
            can = ranks < NONE
            if can.any():
                enter(at[can], ranks[can])

        look(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            runs = index.pop(rank)
            at = np.unique(np.concatenate(runs)) if len(runs) > 1 else runs[0]
            at = at[alive[at] & (pair_rank[at] == rank)]
            if not len(at):
                continue
            # Of pairs that overlap in a run (aaa), every second one merges, from the left.
            chained = np.flatnonzero(right[at[:-1]] == at[1:]) + 1
            if len(chained):
                taken = np.ones(len(at), dtype=bool)
                for i in chained.tolist():
                    taken[i] = not taken[i - 1]
                at = at[taken]
            gone = right[at]
            after = right[gone]
            # Where one merge stands right before another, the pair of the two could have come first.
            close = np.flatnonzero(right[gone[:-1]] == at[1:])
            if len(close):
                between = self.rank_of(np.full(len(close), rank), symbol[after[close]])
                odd.update(word[at[close[between < rank]]].tolist())
            symbol[at] = rank
            alive[gone] = False
            right[at] = after
            inner = after >= 0
            left[after[inner]] = at[inner]
            before = left[at]
            touched = np.concatenate([at, before[before >= 0]])
            touched = np.unique(touched)
            look(touched)
            lower = touched[pair_rank[touched] < rank]
            if len(lower):
                odd.update(word[lower].tolist())
        kept = symbol[alive]
        counts = np.bincount(word[alive], minlength=len(words))
        out = np.split(kept, np.cumsum(counts)[:-1])
        for i in odd:
            out[i] = np.array(self.alone(words[i]), dtype=np.int64)
        return out


#: A space stands before each token that follows one, so a text may be cut before a space and a visible character.
CUT = re.compile(r"(?= \S)")
IRREGULAR = re.compile(r" (?:\s|$)|\x01")


class ByteEncoder:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.replay = MergeReplay(self.ranks).replay
        self.word = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        fresh = self.replay([w.encode() for w in words])
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, *fresh])
        self.size = np.concatenate([self.size, np.fromiter(map(len, fresh), np.int64, len(fresh))])
        self.start = np.cumsum(self.size) - self.size

    def strings(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Cut each text where a token is sure to begin: distinct strings, their places, bounds of the texts."""
        if any(IRREGULAR.search(t) for t in texts):
            return interned(pa.array([CUT.split(t) if t else [] for t in texts], pa.large_list(pa.large_string())))
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\x01 ")
        return interned(pc.split_pattern(marked, "\x01"))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for some in by_size(texts, RUN_CHARS):
            strings, codes, bounds = self.strings([texts[i] for i in some])
            findall = self.word.findall
            words = [[s] if s.isalpha() or s[:1] == " " and s[1:].isalpha() else findall(s) for s in strings]
            count = np.fromiter(map(len, words), np.int64, len(words))
            words = list(chain.from_iterable(words))
            if len(self.known) > CACHED_WORDS:
                self.forget()
            if missing := [w for w in dict.fromkeys(words) if w not in self.known]:
                self.learn(missing)
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            flat = rows_of(self.flat, self.start, self.size, at)
            before = np.concatenate([[0], np.cumsum(self.size[at])])
            ends = np.cumsum(count)
            start = before[ends - count]
            size = before[ends] - start
            for a, b in zip(bounds, bounds[1:]):
                yield rows_of(flat, start, size, codes[a:b])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int), no special tokens; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ByteEncoder(path, pattern)
        for batch in batches:
            ids = [x.astype(np.int32) for x in encoder.encode(batch["text"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids})

    return map_runs(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, ids array<int>", RUN_CHARS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ByteEncoder(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "bytes": [encoder.decode(np.asarray(i)) for i in batch["ids"]]})

    return map_runs(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ByteEncoder(path, pattern)
        for batch in batches:
            out = []
            for ids in encoder.encode(batch["text"].tolist()):
                joined = ",".join(map(str, ids.tolist())).encode()
                out.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield frame

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_runs(docs.select("doc_id", text_or_empty().alias("text")), run, schema, RUN_CHARS)
