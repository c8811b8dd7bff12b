"""Spelling variants: words one edit apart, found in a trie of letter counts.

A word is the vector of its counts by letter group (code point modulo ``GROUPS``).  One inserted letter adds one to one
group, a deleted one takes one, a replaced one does both or neither: along the vector a near word spends a surplus and a
deficit of at most one each.  The trie branches by length, then by one group's count after the other, the groups that vary most
first.  A search goes down it depth first with all words that may still reach a node, each with what is left of its
budget, and verifies them against the words of a leaf letter by letter.

The trie is cut at a depth: the nodes there are blocks of words that tasks search on their own, and a word is sent to its own
block and to those that its budget reaches.  The depth is the first at which no block holds more than ``BLOCK`` words;
where the full depth is not enough (words with equal counts), a block is split, and every part of its words meets every part
of its guests.  Each pair is looked for from one side only, the shorter word or the earlier block; what leaves a task is,
for each word, its number of near words there and the most frequent of them, not the pairs.

Corpus counts cover all texts: tasks count the distinct words of a piece before the shuffle, Spark adds up.

Cases: NULL and empty texts have no words, NULL ids count as empty; rows that repeat count as often as they stand there; equal
counts of candidate forms go to the smaller word in code-point order; words without near words have no form and are their own
root; an empty table gives no rows; texts longer than a piece are read in parts that end where no word runs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import bounded_batches, staged
from tillworks.llm.tokens import PIECE_BYTES, crc32, encoded, pieces, split_words, string_bytes

#: Runs of Latin letters, once A-Z are lower case; all of them are single bytes in Latin-1.
BETWEEN_LETTERS = r"[^a-z\x{C0}-\x{FF}]+"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10  # a form stands so many times as often as its variant
DROP_EVERY = 31
GROUPS = 16
BLOCK = 20_000
GUESTS = 100_000
LEAF = 24
PAIRS = 1 << 17
WIDTH = 48  # longer words are compared one by one


def drop_letter(run: str, at: int) -> str:
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences.  With ``drop_every``, a run loses one letter where that
    number divides the CRC-32 h of ``key:run``: the letter h % length."""
    bounded_batches(docs.sparkSession, PIECE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column(0).fill_null("").to_pylist()
            for first, texts, _ in pieces(batch.column(1)):
                flat, bounds = split_words(texts, BETWEEN_LETTERS)
                words, word = encoded(flat)
                if not len(words):
                    continue
                held = pc.value_counts(pa.array(np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(words) + word))
                doc, word = np.divmod(held.field("values").to_numpy(zero_copy_only=False), len(words))
                n = held.field("counts").to_numpy(zero_copy_only=False)
                data, offsets = string_bytes(words)
                heads = np.array([zlib.crc32(f"{names[first + i]}:".encode()) for i in range(len(texts))], np.uint32)
                sums = crc32(data, offsets[word], offsets[word + 1], heads[doc])
                hit = sums % np.uint32(drop_every) == 0 if drop_every else np.zeros(len(sums), bool)
                whole = np.bincount(word[~hit], n[~hit], len(words)).astype(np.int64)
                cut = Counter()
                lost, at, times = words.take(pa.array(word[hit])).to_pylist(), sums[hit].tolist(), n[hit].tolist()
                for w, h, k in zip(lost, at, times, strict=True):
                    cut[drop_letter(w, h % len(w))] += k
                out = pa.concat_arrays([words, pa.array(list(cut), pa.string())])
                n = pa.array(np.concatenate([whole, np.array(list(cut.values()), np.int64)]))
                enough = pc.and_(pc.greater_equal(pc.utf8_length(out), least_letters), pc.greater(n, 0))
                yield pa.RecordBatch.from_arrays([out.filter(enough), n.filter(enough)], ["word", "n"])

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_groups(words: list[str]) -> np.ndarray:
    """Counts by letter group, a row for each word."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * GROUPS + letters % GROUPS, minlength=len(words) * GROUPS).astype(np.int32).reshape(-1, GROUPS)


def _reach(depth: int) -> list[tuple[int, ...]]:
    """Steps from a node to those where a near word of the same or one more letter may be: changes of (length, count, ...)."""
    def step(**at):
        return tuple(at.get(f"l{i}", 0) for i in range(depth + 1))

    longer = [step(l0=1), *[step(l0=1, **{f"l{i}": 1}) for i in range(1, depth + 1)]]
    up = [step(**{f"l{i}": 1}) for i in range(1, depth + 1)]
    down = [step(**{f"l{i}": -1}) for i in range(1, depth + 1)]
    both = [step(**{f"l{i}": 1, f"l{j}": -1}) for i in range(1, depth + 1) for j in range(1, depth + 1) if i != j]
    return longer + [s for s in [*up, *down, *both] if s > step()]  # of two nodes, the smaller one asks


class Trie:
    """Words as sorted rows (length, counts by group): a node is a range of rows with equal first columns."""

    def __init__(self, words: list[str], order: list[int]):
        vectors = _vectors(words, order)
        rows = np.lexsort(vectors.T[::-1])
        self.rows, self.vectors = rows, vectors[rows]

    def search(self, guests: np.ndarray, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(guest, word) pairs whose letter counts differ by a surplus and a deficit of one at most; ``guests`` are vectors, and
        all words share the first ``at`` columns but for what the guests' budgets allow."""
        n = len(guests)
        stack = [(0, len(self.rows), at, np.arange(n), np.zeros(n, np.int8), np.zeros(n, np.int8))]
        while stack:
            lo, hi, level, alive, surplus, deficit = stack.pop()
            if hi - lo <= LEAF or level == self.vectors.shape[1]:
                for a in range(0, len(alive), max(1, PAIRS // (hi - lo))):
                    some = slice(a, a + max(1, PAIRS // (hi - lo)))
                    gap = self.vectors[None, lo:hi, level:] - guests[alive[some], None, level:]
                    more, less = surplus[some, None].astype(np.int32), deficit[some, None].astype(np.int32)
                    if level == 0:  # the length follows from the counts
                        gap = gap[:, :, 1:]
                    fits = (more + np.maximum(gap, 0).sum(2) <= 1) & (less + np.maximum(-gap, 0).sum(2) <= 1)
                    g, w = np.nonzero(fits)
                    yield alive[some][g], self.rows[lo + w]
                continue
            column = self.vectors[lo:hi, level]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [hi - lo]])
            wanted = guests[alive, level]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                gap = int(column[a]) - wanted
                if level == 0:
                    stays = np.abs(gap) <= 1
                    more, less = surplus[stays], deficit[stays]
                else:
                    more, less = surplus + np.maximum(gap, 0), deficit + np.maximum(-gap, 0)
                    stays = (more <= 1) & (less <= 1)
                    more, less = more[stays].astype(np.int8), less[stays].astype(np.int8)
                if stays.any():
                    stack.append((lo + int(a), lo + int(b), level + 1, alive[stays], more, less))


def _vectors(words: list[str], order: list[int]) -> np.ndarray:
    counts = letter_groups(words)[:, order]
    return np.concatenate([counts.sum(1, keepdims=True), counts], axis=1).astype(np.int32)


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)):] == b[same + 1:]


class Letters:
    """Words as rows of bytes for comparing many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words])
        self.table = np.zeros((len(words), WIDTH + 1), np.uint8)
        for i, w in enumerate(words):
            if len(w) <= WIDTH:
                self.table[i, :len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)

    def near(self, a: np.ndarray, other: Letters, b: np.ndarray) -> np.ndarray:
        """Is word a[i] here one edit from word b[i] there?"""
        out = np.zeros(len(a), bool)
        wide = (self.size[a] > WIDTH) | (other.size[b] > WIDTH)
        for i in np.flatnonzero(wide):
            out[i] = one_edit(self.words[a[i]], other.words[b[i]])
        step = other.size[b] - self.size[a]
        here = np.flatnonzero(~wide & (step == 0))
        out[here] = (self.table[a[here]] != other.table[b[here]]).sum(1) == 1
        for one, x, that, y, gap in ((self, a, other, b, 1), (other, b, self, a, -1)):
            here = np.flatnonzero(~wide & (step == gap))
            short, long = one.table[x[here]], that.table[y[here]]
            first = np.logical_and.accumulate(short == long, axis=1).sum(1)
            last = np.logical_and.accumulate((short[:, :-1] == long[:, 1:])[:, ::-1], axis=1).sum(1)
            out[here] = first + last >= WIDTH  # what follows the words is equal too
        return out


def search_block(members: pd.DataFrame, guests: pd.DataFrame, order: list[int]) -> pd.DataFrame:
    """(word, n_near, form_n, form) of all words with a near word here.  Members are compared with each other where they are
    among the guests as well (``home``), the smaller row asking."""
    words, others = members["word"].tolist(), guests["word"].tolist()
    trie, vectors = Trie(words, order), _vectors(others, order)
    ours, theirs = Letters(words), Letters(others)
    home = guests["home"].to_numpy(bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def verify():
        g, w = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        # a pair inside a block comes up from both sides
        once = ~home[g] | (vectors[g, 0] < ours.size[w])
        same = np.flatnonzero(home[g] & (vectors[g, 0] == ours.size[w]))
        once[same] = [others[i] < words[j] for i, j in zip(g[same], w[same], strict=True)]
        g, w = g[once], w[once]
        near = theirs.near(g, ours, w)
        found.append((g[near], w[near]))

    waiting = 0
    for pair in trie.search(vectors):
        held.append(pair)
        waiting += len(pair[0])
        if waiting >= PAIRS:
            verify()
            waiting = 0
    if held:
        verify()
    g, w = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
    n_words, n_others = members["n"].to_numpy(), guests["n"].to_numpy()
    word_of, other_of = members["word"].to_numpy(object), guests["word"].to_numpy(object)
    links = pd.DataFrame({"word": np.concatenate([other_of[g], word_of[w]]), "form": np.concatenate([word_of[w], other_of[g]]),
                          "form_n": np.concatenate([n_words[w], n_others[g]])})
    links = links.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    best = links.drop_duplicates("word").assign(n_near=links.groupby("word", sort=True).size().to_numpy())
    return best[["word", "n_near", "form_n", "form"]]


def _path(depth: int, order: list[int]):
    """First columns of the trie's rows of a word table, as an array of numbers."""
    return F.concat(F.array(F.char_length("word")), *[F.array(F.col("groups")[g]) for g in order[:depth]])


def near_words(words: DataFrame, block: int = BLOCK, guests: int = GUESTS) -> DataFrame:
    """(word, n_near, form_n, form) of the words of (word, n) that have near words; ``form`` is the most frequent near one."""
    def vectors(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts = letter_groups(batch.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, GROUPS, dtype=np.int32)), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["word", "n", "groups"])

    table = staged(words.select("word", "n").mapInArrow(vectors, "word string, n bigint, groups array<int>"), "variant-words")
    spread = table.agg(*[F.coalesce(F.variance(F.col("groups")[g]), F.lit(0.0)).alias(str(g)) for g in range(GROUPS)]).first()
    order = sorted(range(GROUPS), key=lambda g: (-spread[g], g))
    depth = 0
    while depth < GROUPS and (table.groupBy(_path(depth, order).alias("path")).count().agg(F.max("count")).first()[0] or 0) > block:
        depth += 1
    rows = table.select("word", "n", _path(depth, order).alias("path"))
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _reach(depth)])
    reached = F.transform(steps, lambda s: F.zip_with("path", s, lambda a, b: a + b))
    own = rows.select("word", "n", "path", F.lit(True).alias("member"), F.lit(True).alias("home"))
    away = rows.select("word", "n", F.explode(F.filter(reached, lambda p: F.forall(p, lambda c: c >= 0))).alias("path"),
                       F.lit(False).alias("member"), F.lit(False).alias("home"))
    sent = own.unionByName(away).withColumn("path", F.array_join("path", "|"))
    sizes = sent.groupBy("path").agg(F.count_if("member").alias("n_members"), F.count(F.lit(1)).alias("n_guests"))
    sizes = staged(sizes.where("n_members > 0").select(
        "path", F.ceil(F.col("n_members") / block).alias("parts"), F.ceil(F.col("n_guests") / guests).alias("guest_parts")),
        "variant-blocks")
    dealt = sent.join(sizes, "path").withColumn("salt", F.xxhash64("word"))
    whole = F.expr("pmod(salt, parts)"), F.expr("pmod(salt, guest_parts)")
    members = dealt.where("member").select("path", whole[0].alias("part"), F.explode(F.expr(
        "sequence(0L, guest_parts - 1)")).alias("guest_part"), "word", "n", "home", F.lit(True).alias("as_member"))
    asking = dealt.select("path", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), whole[1].alias("guest_part"),
                          "word", "n", "home", F.lit(False).alias("as_member"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(rows[rows["as_member"]], rows[~rows["as_member"]], order)

    found = members.unionByName(asking).groupBy("path", "part", "guest_part").applyInPandas(
        run, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): follow forms to the last, in steps that double.  A form stands ten times as often as its
    variant, so paths are short and have no circles."""
    jumps = staged(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = jumps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        jumps = staged(jumps.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "variant-roots")
        if not jumps.where("moved").limit(1).count():
            return jumps.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, **choices) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word of the corpus."""
    words = staged(word_counts(docs, key, text, **choices), "variant-counts")
    near = staged(near_words(words), "variant-near")
    is_form = F.col("form_n") >= ratio * F.col("n")
    judged = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("form_n")).alias("form_n")), "variant-forms")
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                    "form_n")
