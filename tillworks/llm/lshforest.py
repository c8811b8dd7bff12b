"""Near-duplicate documents: Jaccard join on word 5-grams with a MinHash LSH forest.

A document is the set of its word 5-grams (lower case, words are runs without white space; a shorter text is one gram).  Each of
``TREES`` tries files a document under a path of ``DEEPEST`` min-hash values, one byte a level, packed into one integer: sorted
integers are the trie's leaves, and the first d bytes are a prefix.

1. Documents with equal sets become one class with a number of its own and a weight; ids only name the result.
2. All paths are sorted by trie.  A path's neighbours in that order tell the longest prefix that it shares with any other; paths
   that share fewer levels than could ever be asked for leave here, without a shuffle.
3. Matched prefixes start at ``DEEPEST`` levels.  One trie at a time is shortened by a level, the one that adds the fewest pairs
   of classes for its gain, counted on the tries themselves, until a pair at the threshold is found with probability ``RECALL``
   or more.  A trie in which a passage of many documents rules the prefixes stays long; others make up for it.
4. Each class has a home, the smallest class in ``STEPS`` steps of shared prefixes (one step leaves a group of near copies in
   many homes that all meet), and homes are cut by hash into blocks of bounded size.  Two blocks meet if classes of theirs share a prefix in some trie, so what is only connected through others never meets.
5. Blocks that meet are verified exactly, each pair of classes once, tile by tile: intersections are products of 0/1 matrices.  A task returns
   link counts and a spanning forest, so a home of g near copies costs g rows for each of its blocks, not g squared.
6. Components of the forest edges are the near-duplicate classes.

Texts are read again only for classes that share a prefix; a bit filter of fixed size keeps all others out of that shuffle.
Grams are told apart by 54-bit hashes of their words.

Cases: texts without words (NULL, empty) link with nothing; rows that repeat id and text are copies; if an id comes with
several texts, each is compared and judged on its own; rows with NULL id are not compared; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import bit_filter, bounded_batches, in_filter, staged
from tillworks.llm.components import components, forest, smallest_keys
from tillworks.llm.words import mix, slices, words

GRAM = 5
SIMILARITY = 0.8
TREES = 32
DEEPEST = 8
RECALL = 0.9999
BLOCK_DOCS = 4096
TILE = 256  # sets of a block that are compared with as many others at once
BLOCK_GRAMS = 1 << 19
STEPS = 3  # shared prefixes that lie between a class and its home at most
TASK_BYTES = 16 << 20
FILTER_BITS = 24
HASH_BITS = 54
SPARE = 2  # levels that a trie may be shortened below the depth at which all tries alike reach the recall
BATCH_BYTES = 4 << 20  # rows of a task that are in Python at once
PIECE = 1 << 20  # bytes of text whose words are told at once, or one longer text
_GRAM_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                          0xA0761D6478BD642F], np.uint64)


def prefix_depth(similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEEPEST,
                 recall: float = RECALL) -> int:
    """Levels at which all tries alike find a pair at the threshold with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


def tree_depths(pairs: dict[tuple[int, int], int], similarity: float = SIMILARITY, trees: int = TREES,
                deepest: int = DEEPEST, shortest: int = 1, recall: float = RECALL) -> list[int]:
    """Levels that the prefixes of each trie keep; ``pairs`` counts the pairs of classes that share d levels of trie t by (t, d).
    The trie with the fewest new pairs for its gain is shortened first, until the chance that all tries miss a pair at the
    threshold is ``1 - recall`` or less, or all are at ``shortest``."""
    def miss(depth: int) -> float:
        return float(np.log1p(-min(similarity ** depth, 1 - 1e-12)))

    def price(tree: int) -> float:
        d = depths[tree]
        return (pairs.get((tree, d - 1), 0) - pairs.get((tree, d), 0) + 1) / (miss(d) - miss(d - 1))

    depths = [deepest] * trees
    while sum(map(miss, depths)) > np.log(max(1 - recall, 1e-12)):
        able = [t for t in range(trees) if depths[t] > shortest]
        if not able:
            break
        depths[min(able, key=price)] -= 1
    return depths


def gram_sets(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, sorted and distinct within each text; first of each text and the end).  At most 1024 texts."""
    w = words(texts)
    h = w.hashes()
    sizes = np.diff(w.docs)
    n_grams = np.where(sizes > 0, np.maximum(sizes - gram + 1, 1), 0)
    ends = np.cumsum(n_grams)
    doc = np.repeat(np.arange(len(sizes)), n_grams)
    at = np.repeat(w.docs[:-1] - (ends - n_grams), n_grams) + np.arange(ends[-1] if len(ends) else 0)
    value = np.zeros(len(at), np.uint64)
    for i in range(gram):  # a short text has fewer words than a gram
        inside = at + i < w.docs[1:][doc]
        value += np.where(inside, h[np.minimum(at + i, max(len(h) - 1, 0))] if len(h) else 0, 0).astype(
            np.uint64) * _GRAM_FACTORS[i % len(_GRAM_FACTORS)] * np.uint64(2 * (i // len(_GRAM_FACTORS)) + 1)
    key = doc.astype(np.uint64) << np.uint64(HASH_BITS) | mix(value) >> np.uint64(64 - HASH_BITS)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    docs = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return key & np.uint64((1 << HASH_BITS) - 1), docs


def set_keys(grams: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart; 0 for a text without words."""
    some = np.diff(docs) > 0
    out = []
    for salt in (1, 2):
        total = np.zeros(len(docs) - 1, np.uint64)
        if some.any():
            total[some] = np.add.reduceat(mix(grams * np.uint64(2) + np.uint64(salt)), docs[:-1][some])
        out.append(total.view(np.int64))
    return out[0], out[1]


def signatures(grams: np.ndarray, docs: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Trie paths, one integer per document and tree; the first level is the highest byte used."""
    n = len(docs) - 1
    paths = np.zeros((n, trees), np.uint64)
    some = np.diff(docs) > 0
    if not some.any():
        return paths.view(np.int64)
    first = docs[:-1][some]
    x = (mix(grams) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint32)
    for t in range(trees):
        path = np.zeros(len(first), np.uint64)
        for d in range(depth):
            y = x * factors[t, d]
            y += shifts[t, d]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(y, first)
            path = path << np.uint64(8) | ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint64)
        paths[some, t] = path
    return paths.view(np.int64)


def _file_documents(docs: DataFrame, key: str, text: str, gram: int, trees: int, depth: int) -> DataFrame:
    """(key, digest, set_a, set_b, n, paths) of every row with an id and words; key and digest tell texts apart."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, b in slices(batch.column(1), PIECE):
                for at in range(a, b, 1024):
                    some = batch.slice(at, min(1024, b - at))
                    grams, first = gram_sets(some.column(1), gram)
                    set_a, set_b = set_keys(grams, first)
                    paths = signatures(grams, first, trees, depth)
                    yield pa.RecordBatch.from_arrays([
                        some.column(0), some.column(2), pa.array(set_a), pa.array(set_b), pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(np.arange(0, paths.size + 1, trees, dtype=np.int32), paths.ravel())],
                        ["key", "digest", "set_a", "set_b", "n", "paths"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.lower(F.coalesce(
        F.col(text), F.lit(""))).alias("text"), F.xxhash64(text).alias("digest"))
    return rows.mapInArrow(run, "key bigint, digest bigint, set_a bigint, set_b bigint, n bigint, paths array<bigint>").where("n > 0")


def shared_levels(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Levels that each path shares with the next one of a sorted list; 0 across tries."""
    differ = path[1:] ^ path[:-1]
    levels = np.zeros(len(differ), np.int32)
    for d in range(1, DEEPEST + 1):
        levels += differ >> np.uint64(8 * (DEEPEST - d)) == 0
    return np.where(tree[1:] == tree[:-1], levels, 0)


def _sorted_tries(classes: DataFrame, shortest: int) -> DataFrame:
    """(tree, path, id, reach): the paths in trie order that share ``shortest`` levels with a neighbour; reach is the number
    of levels shared.  Ranges are cut by id too, so no prefix is too frequent for a task; the first and last path of a range,
    whose other neighbour lies elsewhere, count as shared in full and are told by the counts that follow."""
    def run(batches: Iterator[pa.RecordBatch]):
        def out(rows: list[np.ndarray], reach: np.ndarray) -> pa.RecordBatch:
            some = reach >= shortest
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in rows] + [pa.array(reach[some].astype(np.int32))],
                                              ["tree", "path", "id", "reach"])

        held, before = None, DEEPEST  # the last path so far and what it shares with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            levels = np.concatenate([[before], shared_levels(rows[0], rows[1].view(np.uint64))])
            if len(levels) > 1:
                yield out([c[:-1] for c in rows], np.maximum(levels[:-1], levels[1:]))
            held, before = [c[-1:] for c in rows], levels[-1]
        if held is not None:
            yield out(held, np.array([DEEPEST]))

    paths = classes.select(F.posexplode("paths").alias("tree", "path"), "id")
    return paths.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path").mapInArrow(
        run, "tree int, path bigint, id bigint, reach int")


def _measured_depths(tries: DataFrame, similarity: float, trees: int, shortest: int, recall: float) -> list[int]:
    """Depths of the tries from the pairs that their prefixes hold: one count for each trie and depth reaches the driver."""
    depths = F.array(*[F.lit(d) for d in range(shortest, DEEPEST + 1)])
    nodes = tries.select("tree", "path", "reach", F.explode(depths).alias("depth")).where("reach >= depth").groupBy(
        "tree", "depth", F.expr(f"shiftrightunsigned(path, 8 * ({DEEPEST} - depth))").alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"))
    found = nodes.groupBy("tree", "depth").agg(F.sum(F.expr("cast(n as double) * (n - 1) / 2")).alias("pairs")).collect()
    return tree_depths({(r.tree, r.depth): r.pairs for r in found}, similarity, trees, DEEPEST, shortest, recall)


def _blocks(classes: DataFrame, tries: DataFrame, depths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(wanted: id, key, digest, weight, n, block; meetings: block, lo, hi) of classes that share a prefix with another one."""
    depth = F.element_at(F.array(*[F.lit(d) for d in depths]), F.col("tree") + 1)
    paths = tries.withColumn("depth", depth).where("reach >= depth").select("id", F.xxhash64("tree", F.expr(
        f"shiftrightunsigned(path, 8 * ({DEEPEST} - depth))")).alias("bucket"))
    buckets = staged(paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where(
        "n > 1").drop("n"), "lsh-buckets")
    members = staged(paths.join(buckets, "bucket"), "lsh-members")
    homes = members.groupBy("id").agg(F.min("least").alias("home"))
    for _ in range(STEPS - 1):
        around = staged(members.join(homes, "id").groupBy("bucket").agg(F.min("home").alias("around")), "lsh-around")
        homes = members.select("id", "bucket").join(around, "bucket").groupBy("id").agg(F.min("around").alias("home"))
    known = staged(classes.select("id", "key", "digest", "weight", "n").join(homes, "id"), "lsh-homes")
    sizes = staged(known.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(
        F.sum("n") / BLOCK_GRAMS)).cast("bigint").alias("parts")), "lsh-sizes")
    wanted = staged(known.join(sizes, "home").withColumn("block", F.xxhash64("home", F.pmod(
        F.xxhash64("id"), "parts"))).drop("home", "parts"), "lsh-wanted")
    inside = members.select("id", "bucket").join(wanted.select("id", "block"), "id").select("bucket", "block").distinct()
    inside = staged(inside, "lsh-inside")
    several = staged(inside.groupBy("bucket").agg(F.min("block").alias("a"), F.max("block").alias("b")).where(
        "a <> b").select("bucket"), "lsh-several")
    inside = staged(inside.join(several, "bucket"), "lsh-across")
    across = inside.select("bucket", F.col("block").alias("lo")).join(
        inside.select("bucket", F.col("block").alias("hi")), "bucket").where("lo < hi").select("lo", "hi")
    alone = wanted.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("block").alias("lo"), F.col("block").alias("hi"))
    pairs = staged(across.distinct().unionByName(alone), "lsh-pairs")
    return wanted, staged(pairs.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"), "lo", "hi"),
                          "lsh-meetings")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other: 0/1 matrices over the grams that occur
    on both sides, some columns at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    doc_a, doc_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    places = []
    for values, doc in ((a, doc_a), (b, doc_b)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], doc[hit][order]))
    width = 4096
    for start in range(0, len(shared), width):
        parts = []
        for (at, doc), n in zip(places, out.shape, strict=True):
            lo, hi = np.searchsorted(at, [start, start + width])
            matrix = np.zeros((n, min(width, len(shared) - start)), np.float32)
            matrix[doc[lo:hi], at[lo:hi] - start] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def block_links(left: list[np.ndarray], right: list[np.ndarray], similarity: float, same: bool
                ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets whose Jaccard similarity reaches the threshold; i < j if both lists are the same."""
    common = _intersections(left, right).astype(np.float64)
    size_a, size_b = (np.array([len(s) for s in x], np.float64) for x in (left, right))
    linked = common >= similarity * (size_a[:, None] + size_b[None, :] - common) - 1e-9
    linked &= common > 0
    if same:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def _read_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, gram: int) -> DataFrame:
    """(block, id, weight, grams) of the classes in ``wanted`` (id, key, digest, weight, block); key and digest say which text
    stands for a class."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, b in slices(batch.column(0), PIECE):
                for at in range(a, b, 1024):
                    some = batch.slice(at, min(1024, b - at))
                    grams, first = gram_sets(some.column(0), gram)
                    sets = [grams[i:j].astype("<u8").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column("block"), some.column("id"), some.column("weight"),
                                                      pa.array(sets, pa.binary())], ["block", "id", "weight", "grams"])

    may = in_filter(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias(
        "text")), F.col("key"), bit_filter(wanted, "key", FILTER_BITS), FILTER_BITS, "may").where("may").drop("may")
    rows = may.withColumn("digest", F.xxhash64("text")).join(wanted, ["key", "digest"]).select(
        F.lower("text").alias("text"), "id", "weight", "block")
    return rows.mapInArrow(run, "block bigint, id bigint, weight bigint, grams binary").dropDuplicates(["id"])


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, gram: int = GRAM,
          trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows: key, digest and set; classes: id, set, key, weight; counts: id, n linked rows of other classes; edges: u, v)."""
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    rows = staged(_file_documents(docs, key, text, gram, trees, DEEPEST), "lsh-rows")
    classes = staged(rows.groupBy("set_a", "set_b").agg(
        F.min(F.struct("key", "digest")).alias("one"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"),
        F.first("paths").alias("paths")).select("set_a", "set_b", "one.key", "one.digest", "weight", "n", "paths").withColumn(
            "id", F.monotonically_increasing_id()), "lsh-classes")  # numbered once, as it is written
    shortest = max(1, prefix_depth(similarity, trees, DEEPEST, recall) - SPARE)
    tries = staged(_sorted_tries(classes, shortest), "lsh-tries")
    wanted, meetings = _blocks(classes, tries, _measured_depths(tries, similarity, trees, shortest, recall))
    volume = meetings.join(wanted.groupBy("block").agg(F.sum("n").alias("n")), "block").agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-volume * 8 // TASK_BYTES))

    tile = TILE

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (lo, hi), block in frame.groupby(["lo", "hi"], sort=False):
            block = block.sort_values("id")
            ids, weight = block["id"].to_numpy(), block["weight"].to_numpy()
            sets = [np.frombuffer(g, "<u8") for g in block["grams"]]
            left, right = (np.flatnonzero(block["block"].to_numpy() == m) for m in (lo, hi))
            n, u, v = np.zeros(len(ids), np.int64), [], []
            for x in range(0, len(left), tile):
                for y in range(x if lo == hi else 0, len(right), tile):
                    a, b = left[x:x + tile], right[y:y + tile]
                    i, j = block_links([sets[k] for k in a], [sets[k] for k in b], similarity, lo == hi and x == y)
                    i, j = a[i], b[j]
                    n += (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
                    i, j = forest(len(ids), i, j)  # links of a tile leave fewer edges than it has sets
                    u.append(i)
                    v.append(j)
            if not n.any():
                continue
            some = np.flatnonzero(n)
            a, b = forest(len(ids), np.concatenate(u), np.concatenate(v))
            out.append(pd.DataFrame({"u": np.concatenate([ids[some], ids[a]]),
                                     "v": np.concatenate([np.full(len(some), -1), ids[b]]),
                                     "n": np.concatenate([n[some], np.full(len(a), -1)])}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")

    sets = staged(_read_sets(docs, wanted.drop("n"), key, text, gram), "lsh-sets").join(meetings, "block")
    found = staged(sets.withColumn("task", F.pmod(F.xxhash64("lo", "hi"), F.lit(int(tasks)))).groupBy(
        "task").applyInPandas(lambda frame: verify(frame), "u bigint, v bigint, n bigint"), "lsh-links")
    counts = found.where("n >= 0").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n_linked"))
    return rows, classes, counts, found.where("n < 0").select("u", "v")


def _decisions(docs: DataFrame, key: str, text: str, similarity: float, **settings) -> DataFrame:
    """(key, digest, class_id, text_id, n_links) of every row with an id and words."""
    rows, classes, counts, edges = links(docs, key, text, similarity, **settings)
    least = smallest_keys(components(edges), classes, "id", "key", "least")
    known = staged(classes.select("set_a", "set_b", "id", "key", "weight").join(counts, "id", "left").join(
        least, "id", "left").select("set_a", "set_b", F.col("key").alias("text_id"), (
            F.col("weight") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"),
            F.coalesce("least", "key").alias("class_id")), "lsh-result")
    return rows.select("key", "digest", "set_a", "set_b").join(known, ["set_a", "set_b"]).select(
        "key", "digest", "class_id", "text_id", "n_links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    **settings) -> DataFrame:
    """One row per row of ``docs``: key, class_id (smallest id reachable by links), text_id (smallest id with equal grams),
    n_links (other rows linked directly, copies included), kept (this row's id is the class id)."""
    linked = _decisions(docs, key, text, similarity, **settings).drop("digest")
    other = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where(
        F.col("key").isNull() | ~F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))).select(
        "key", F.col("key").alias("class_id"), F.col("key").alias("text_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(other).select(
        F.col("key").alias(key), "class_id", "text_id", "n_links",
        F.coalesce(F.col("key") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those whose id is not the smallest of their class; other texts of the same id stay.  Rows
    that cannot be among them by the bit filter pass without a shuffle."""
    gone = staged(_decisions(docs, key, text, similarity).where("key <> class_id").select(
        F.col("key").alias("gone"), F.col("digest").alias("gone_digest")).distinct(), "lsh-gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias(
        "digest"))
    rows = in_filter(rows, F.col("id"), bit_filter(gone, "gone", FILTER_BITS), FILTER_BITS, "may")
    stay = rows.where("not may").select("row.*")
    checked = rows.where("may").join(gone, (F.col("id") == F.col("gone")) & (F.col("digest") == F.col("gone_digest")),
                                     "left_anti").select("row.*")
    return stay.unionByName(checked)
