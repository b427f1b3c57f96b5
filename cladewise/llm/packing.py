"""Packing of tokenised documents into fixed windows by multiway differencing.

Documents are cut at whole windows; each full window is a sequence of its own.
What is left of a document is cut into pieces of at most ``grain`` tokens, and
the pieces of a group are dealt to k windows by Karmarkar-Karp differencing:
partial partitions are merged two at a time, always the two with the largest
imbalance, the fullest windows of one on the emptiest of the other.  The result
is k nearly equal windows; k starts at the least number that could hold the
tokens, with a little room where windows are many, and rises whenever a window exceeds the capacity.

Groups are salted by document digest, so that no key gathers in one: each holds
about ``group_tokens`` tokens, however many there are, and their number follows
from the total.  Ids are never shuffled: a piece carries its range and checksum.

Defined cases: a null or empty text is one piece that holds the end id only;
rows that repeat a doc_id, or have none, are documents of their own (told apart
by ``row``); an empty table gives no pieces.  Of pieces of equal length the
smaller doc_id comes first.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import map_runs, text_or_empty
from cladewise.llm.word_ids import RUN_CHARS, WordEncoder, kept_encoder
from cladewise.session import written

WINDOW, GRAIN, GROUP_TOKENS, END_ID = 2048, 512, 1 << 20, 1
#: Room that windows start with; near-equal windows hardly ever fit into less.
SPARE = 0.004

PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame, path: str, window: int = WINDOW, grain: int = GRAIN, end_id: int = END_ID, small: bool = False,
) -> DataFrame:
    """The ranges that each document's ids (and the end id) are cut into, with their checksums.

    ``row`` tells rows apart that repeat a doc_id.  ``small`` keeps fewer words
    and frees them with each task, where memory matters more than time.
    """
    run_chars = RUN_CHARS // 4 if small else RUN_CHARS

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path, 150_000, run_chars) if small else kept_encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for row, doc, ids in zip(batch["row"], batch["doc_id"], encoder.ids(batch["text"].tolist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                whole = len(ids) - len(ids) % window
                bounds = [*range(0, whole, window), *range(whole, len(ids), grain), len(ids)]
                for start, stop in zip(bounds, bounds[1:]):
                    out.append((row, doc, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids)))
            frame = pd.DataFrame(out, columns=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
    )
    return map_runs(rows, cut, PIECES, run_chars)


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0..k-1) of each size, by Karmarkar-Karp multiway differencing.

    A partial partition is a descending array of sums and, for each sum, a chain
    of items.  Only the non-empty parts are held; merging adds the largest sums
    of one to the smallest of the other.  Ties go to the earlier item.
    """
    n = len(sizes)
    follow, last = np.full(n, -1, dtype=np.int64), np.arange(n)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes):
        spread = int(size)
        heap.append((-spread, i, np.array([size], dtype=np.int64), np.array([i])))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, heads = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        if len(sums) < len(more):
            sums, heads, more, others = more, others, sums, heads
        room = k - len(sums)
        # The largest sums of the smaller side go to empty parts first, the rest opposite to the fullest.
        fresh = min(room, len(more))
        meet = len(more) - fresh
        if meet:
            tail = np.arange(len(sums) - 1, len(sums) - 1 - meet, -1)
            sums = sums.copy()
            sums[tail] += more[fresh:][np.arange(meet)]
            for a, b in zip(heads[tail].tolist(), others[fresh:].tolist()):
                follow[last[a]], last[a] = b, last[b]
        sums = np.concatenate([sums, more[:fresh]])
        heads = np.concatenate([heads, others[:fresh]])
        order = np.argsort(-sums, kind="stable")
        sums, heads = sums[order], heads[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, serial, sums, heads))
        serial += 1
    part = np.zeros(n, dtype=np.int64)
    for p, head in enumerate(heap[0][3].tolist() if heap else []):
        while head >= 0:
            part[head], head = p, follow[head]
    return part


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece: as few near-equal windows as the differencing can fill within the capacity."""
    least = max(1, -(-int(sizes.sum()) // capacity))
    k = least + int(least * SPARE)
    while True:
        part = differenced(sizes, k)
        if np.bincount(part, weights=sizes, minlength=1).max() <= capacity:
            return part
        k += 1


def packed(cut: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces with sequence_id and offset: their window and their place in it."""
    cut = written(cut, "pieces")
    loose = cut.where(F.col("length") < window)
    total = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / group_tokens))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True], ignore_index=True)
        part = windows(frame["length"].to_numpy(), window)
        frame["sequence_id"] = key[0] * (1 << 24) + part
        order = np.lexsort((frame["start"], frame["row"], frame["doc_id"].fillna(-1), part))
        frame = frame.iloc[order]
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame.drop(columns="_group")

    schema = PIECES + ", sequence_id long, offset long"
    salted = loose.withColumn("_group", F.pmod(F.xxhash64("row", "doc_id", "start"), F.lit(groups)))
    filled = salted.groupBy("_group").applyInPandas(fill, schema)
    # A full window needs no partner: its number is drawn from the negative ids, one per row and start.
    full = cut.where(F.col("length") == window).withColumn(
        "sequence_id", -1 - (F.monotonically_increasing_id())
    ).withColumn("offset", F.lit(0).cast("long"))
    return filled.unionByName(full)
