"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length, pieces are dealt by hash to blocks of about
``BLOCK_PIECES``, and each block is packed on its own, so no task sees more than a block however large the table is.
Inside a block pieces go by falling size: a piece goes to the open bin that it fills best; if none has room, a bin is
opened, and its length is chosen jointly over all permitted lengths: for each one, the pieces still unplaced are laid
out greedily, and the length with the least cost per token wins (see ``cost``).  In the end
every bin is downsized to the smallest permitted length that holds its contents.

Cases: an empty or NULL text is one piece with the end token only; equal rows are pieces of their own; rows with NULL key
are dealt by text length; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import staged, word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
ATTENTION = 65_536
BLOCK_PIECES = 5_000


def cost(length: int) -> float:
    """Of one sequence: a fixed overhead, its tokens padding included, and attention, which grows with the square."""
    return OVERHEAD + length + length * length / ATTENTION


class Remaining:
    """Sizes that are still unplaced, with the largest one up to a limit."""

    def __init__(self, sizes: Sequence[int], top: int):
        self.count = [0] * (top + 1)
        for s in sizes:
            self.count[s] += 1
        self.below = list(range(top + 1))  # the next candidate at or under a size, paths are shortened as they are used

    def largest(self, limit: int) -> int:
        """0 if nothing fits."""
        path, s = [], limit
        while s > 0 and not self.count[s]:
            path.append(s)
            s = self.below[s] if self.below[s] != s else s - 1
        for p in path:
            self.below[p] = s
        return s

    def take(self, size: int) -> None:
        self.count[size] -= 1

    def fill(self, room: int) -> int:
        """Tokens that a greedy layout of what remains puts into ``room``."""
        left = room
        limit = room
        while left > 0 and (s := self.largest(min(left, limit))):
            n = min(self.count[s], left // s)
            left -= n * s
            limit = s - 1
        return room - left


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, offset in the bin, length of the bin) for each size, in the given order."""
    lengths = sorted(lengths)
    top = lengths[-1]
    rest = Remaining(sizes, top)
    free: list[tuple[int, int]] = []  # (room, bin) of open bins, by room
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        rest.take(size)
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, number = free.pop(at)
        else:
            room = min((c for c in lengths if c >= size),
                       key=lambda c: (cost(c) / (size + rest.fill(c - size)), c))
            number = len(used)
            used.append(0)
        out[i] = (number, used[number])
        used[number] += size
        if room > size:
            insort(free, (room - size, number))
    fitted = [lengths[bisect_left(lengths, u)] for u in used]
    return [(number, offset, fitted[number]) for number, offset in out]


def pieces(docs: DataFrame, key: str, size: Column, longest: int) -> DataFrame:
    """(key, piece, start, size): documents cut at ``longest``."""
    rows = docs.select(F.col(key).alias("key"), size.alias("total"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / longest))
    rows = rows.withColumn("piece", F.explode(numbers)).withColumn("start", F.col("piece") * longest)
    return rows.withColumn("size", F.least(F.lit(longest).cast("bigint"), F.col("total") - F.col("start")))


def best_fit(docs: DataFrame, key: str = "doc_id", text: str = "text", size: Column | None = None,
             lengths: Sequence[int] = LENGTHS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: key, piece, start (token of the document it begins at), size, block, bin, offset, capacity.
    A document's size is ``size``, or its number of words, and one end token."""
    total = (word_count(F.col(text)) if size is None else size) + 1
    # rows are numbered once and kept: equal rows must not fall into one block together
    cut = staged(pieces(docs, key, total, max(lengths)).withColumn("row_no", F.monotonically_increasing_id()),
                 "pack-pieces")
    blocks = F.lit(max(1, -(-cut.count() // block_pieces)))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("key", "piece", "row_no"), blocks))

    def pack_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "piece", "row_no"])
        placed = pack(frame["size"].tolist(), lengths)
        frame["bin"], frame["offset"], frame["capacity"] = zip(*placed, strict=True)
        return frame[["key", "piece", "start", "size", "block", "bin", "offset", "capacity"]]

    kind = dict(cut.dtypes)["key"]
    packed = dealt.select("key", "piece", "start", "size", "row_no", "block").groupBy("block").applyInPandas(
        pack_block, f"key {kind}, piece bigint, start bigint, size bigint, block bigint, bin bigint, offset bigint, "
                    f"capacity bigint")
    return packed.withColumnRenamed("key", key)
