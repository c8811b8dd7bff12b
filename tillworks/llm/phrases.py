"""Exact phrases and close words by a positional inverted index that is distributed by documents.

Index.  Documents are taken in shards of bounded size.  A shard is one row of a Parquet table: the keys and lengths of its
documents, its distinct terms, and for each term the ascending positions at which it stands in the shard (stored as
differences).  All words of all texts are stored; nothing is shuffled to build it, and a passage that a third of the corpus
holds is spread as its documents are.

Search.  Phrases come in blocks of bounded size, one block at a time travels to all shards.  In a shard the terms of a phrase
are ordered by their number of postings; the list of the rarest one, moved by its place in the phrase, gives the candidate
starts, and each further list cuts them down.  Phrases with a term that the shard lacks drop out before any list is read.  Terms
are compared as text, so matches are exact.  With ``within``, a phrase matches where all its terms stand, in any order, in
so many consecutive words.

Decontamination.  The phrases of an item are all its runs of ``WINDOW`` words, or the whole of it when it has fewer; the
words of a document that lie in an occurrence of any of them are hit.

Cases: NULL and empty texts have no words, items without words no phrases; NULL keys of items count as empty; items that share
a key are one item; rows that repeat a document key are judged one by one; empty tables give no rows or no hits; texts
longer than a shard are indexed in parts that overlap by a window, so phrases across a border are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import bounded_batches, staged
from tillworks.llm.tokens import PIECE_BYTES, encoded, pieces, split_words

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
CANDIDATES = 1 << 20
RUNS = "array<struct<start:bigint,end:bigint>>"


def _shard(texts: pa.Array, ahead: list[str], overlap: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(terms, postings by term, their first differences, words of each text, last words); ``ahead`` are the words before a text
    that is carried on."""
    words, bounds = split_words(texts)
    if ahead:
        words, bounds = pa.concat_arrays([pa.array(ahead, pa.string()), words]), bounds + len(ahead)
        bounds[0] = 0
    terms, term = encoded(words)
    postings = np.argsort(term, kind="stable")
    counts = np.bincount(term, minlength=len(terms))
    return terms, counts.astype(np.int32), np.diff(postings, prepend=0).astype(np.int32), np.diff(bounds), \
        words[max(0, len(words) - overlap):].to_pylist() if overlap else []


def build(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, overlap: int = WINDOW - 1) -> DataFrame:
    """The index of all texts, written to the shared folder.  A row is a shard: the rows it covers (all columns but the text)
    with a row number, the first word, number of words and end mark of each text or part of a text in it; terms, postings
    per term, and their positions.  Parts of a long text overlap by ``overlap`` words: phrases of one word more are found."""
    bounded_batches(docs.sparkSession, PIECE_BYTES)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text], F.monotonically_increasing_id().alias("_row_no")).alias(
        "row"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), *T.StructType.fromDDL(
        "firsts array<bigint>, n_words array<bigint>, lasts array<boolean>, terms array<string>, counts binary, postings binary")])

    def one_list(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held = [*pieces(batch.column(1), shard_bytes), (len(batch), None, False)]
            done, ahead = 0, []
            for (first, part, carries_on), (following, _, goes_on) in zip(held[:-1], held[1:], strict=True):
                done, ahead = (done, ahead) if carries_on else (0, [])
                terms, counts, gaps, sizes, last = _shard(part, ahead, overlap)
                firsts = np.zeros(len(part), np.int64) + (done - len(ahead))
                ends = np.ones(len(part), bool)
                ends[-1] = not (goes_on and following == first)
                done, ahead = int(firsts[0] + sizes[0]), last
                lists = [batch.column(0).slice(first, len(part)), pa.array(firsts), pa.array(sizes), pa.array(ends), terms]
                yield pa.RecordBatch.from_arrays(
                    [*map(one_list, lists), pa.array([counts.tobytes()]), pa.array([gaps.tobytes()])], schema.names)

    return staged(rows.mapInArrow(run, schema), "phrase-index")


def lengths(index: DataFrame) -> DataFrame:
    """(row, n_words) of all indexed rows, from the index; ``row._row_no`` is the row number."""
    parts = index.select(F.explode(F.arrays_zip("rows", "firsts", "n_words", "lasts")).alias("p")).where("p.lasts")
    return parts.select(F.col("p.rows").alias("row"), (F.col("p.firsts") + F.col("p.n_words")).alias("n_words"))


def windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, phrase) of all windows of the items, words joined by one space."""
    bounded_batches(items.sparkSession, PIECE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words, bounds = split_words(batch.column(1))
            words = words.to_pylist()
            for i, name in enumerate(batch.column(0).fill_null("").to_pylist()):
                own = words[bounds[i]:bounds[i + 1]]
                if own:
                    found = [" ".join(own[k:k + window]) for k in range(max(1, len(own) - window + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found)], ["item", "phrase"])

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, phrase string").distinct()


class Shard:
    """The posting lists of one row of the index."""

    def __init__(self, row: dict):
        self.terms, self.counts = row["terms"], np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(row["postings"], np.int32).astype(np.int64))
        self.starts = np.cumsum(self.counts) - self.counts
        self.size = int(self.counts.sum())
        self.bounds = np.concatenate([[0], np.cumsum(row["n_words"])])
        term = np.repeat(np.arange(len(self.counts)), self.counts)
        self.keys = term * (self.size + 1) + self.positions  # ascending: all lists one after the other

    def next(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """First posting of each term at or after a position; the shard's size where there is none."""
        at = np.searchsorted(self.keys, term * (self.size + 1) + np.clip(position, 0, self.size))
        found = np.full(len(at), self.size)
        inside = at < self.starts[term] + self.counts[term]
        found[inside] = self.positions[at[inside]]
        return found

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, "right") - 1


class Block:
    """Phrases as rows of word numbers, filled up with -1."""

    def __init__(self, phrases: list[str]):
        lists = pc.split_pattern(pa.array(phrases, pa.string()), " ")
        flat, bounds = pc.list_flatten(lists), lists.offsets.to_numpy()
        self.vocabulary, word = encoded(flat)
        self.sizes = np.diff(bounds)
        self.words = np.full((len(phrases), int(self.sizes.max(initial=1))), -1, np.int64)
        self.words[np.repeat(np.arange(len(phrases)), self.sizes), np.arange(len(word)) - np.repeat(bounds[:-1], self.sizes)] = word

    def _alive(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases whose words all stand in the shard, their terms, places of the terms from the rarest on)."""
        place = pc.index_in(self.vocabulary, value_set=shard.terms).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
        terms = np.where(self.words >= 0, place[self.words], -1)
        alive = np.flatnonzero((terms != -2).all(1))
        terms = terms[alive]
        often = np.where(terms >= 0, shard.counts[terms], np.iinfo(np.int64).max)
        return alive, terms, np.argsort(often, axis=1, kind="stable")

    def _starts(self, shard: Shard, terms: np.ndarray, order: np.ndarray, move: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position) for all postings of each row's rarest term, some rows at a time; moved to the start of the phrase."""
        rarest = terms[np.arange(len(terms)), order[:, 0]]
        often = shard.counts[rarest]
        total, at = np.cumsum(often), 0
        while at < len(rarest):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
            row = np.repeat(np.arange(at, end), often[at:end])
            inside = np.arange(len(row)) - np.repeat(np.cumsum(often[at:end]) - often[at:end], often[at:end])
            yield row, shard.positions[shard.starts[rarest[row]] + inside] - (order[row, 0] if move else 0)
            at = end

    def exact(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, end) of all occurrences."""
        alive, terms, order = self._alive(shard)
        out = []
        for row, start in self._starts(shard, terms, order, True):
            stays = start >= 0
            row, start = row[stays], start[stays]
            for step in range(1, self.words.shape[1]):
                place = order[row, step]
                term = terms[row, place]
                stays = (term < 0) | (shard.next(np.maximum(term, 0), start + place) == start + place)
                row, start = row[stays], start[stays]
            end = start + self.sizes[alive[row]]
            stays = shard.doc_of(start) == shard.doc_of(np.maximum(end, 1) - 1)
            out.append((alive[row[stays]], start[stays], end[stays]))
        return tuple(np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3))

    def close(self, shard: Shard, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, end) of stretches of at most ``within`` words that hold all words of a phrase and start with one of
        them; a phrase's repeated word counts once."""
        alive, terms, order = self._alive(shard)
        out = []
        for row, rare in self._starts(shard, terms, order, False):
            row, start = np.repeat(row, within), (rare[:, None] - np.arange(within)[None]).ravel()
            stays = start >= 0
            row, start = row[stays], start[stays]
            end, begins = start + 1, np.zeros(len(start), bool)
            for step in range(self.words.shape[1]):
                term = terms[row, order[row, step]]
                found = np.where(term < 0, start, shard.next(np.maximum(term, 0), start))
                end, begins = np.maximum(end, found + 1), begins | ((term >= 0) & (found == start))
                stays = end - start <= within
                row, start, end, begins = row[stays], start[stays], end[stays], begins[stays]
            stays = begins & (shard.doc_of(start) == shard.doc_of(end - 1))
            out.append((alive[row[stays]], start[stays], end[stays]))
        found = np.unique(np.stack([np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3)]), axis=1)
        return found[0], found[1], found[2]


def _search_block(index: DataFrame, wanted: pd.DataFrame, within: int | None) -> DataFrame:
    """(row_no, items, runs): items with a match in a text or part of a text, and the words that matches cover."""
    phrases, phrase = np.unique(wanted["phrase"].to_numpy(object), return_inverse=True)
    names, item = np.unique(wanted["item"].to_numpy(object), return_inverse=True)
    order = np.argsort(phrase, kind="stable")
    phrases, names, item_of = phrases.tolist(), names.tolist(), item[order]
    first = np.searchsorted(phrase[order], np.arange(len(phrases) + 1))

    def run(batches: Iterator[pa.RecordBatch]):
        block = Block(phrases)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("row_nos", "firsts", "n_words", "counts", "postings")}
                shard = Shard(row | {"terms": batch.column("terms")[i].values})
                which, start, end = block.exact(shard) if within is None else block.close(shard, within)
                if not len(which):
                    continue
                doc = shard.doc_of(start)
                n = np.diff(first)[which]
                owner = np.repeat(doc, n)
                item = item_of[np.repeat(first[which], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
                owner, item = np.divmod(np.unique(owner * len(names) + item), len(names))
                depth = np.zeros(shard.size + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                covered = np.concatenate([[False], np.cumsum(depth) > 0])
                edge = np.diff(covered.astype(np.int8))
                edge[shard.bounds[:-1][covered[shard.bounds[:-1] + 1]]] = 1  # a run ends where its text does
                run_start = np.flatnonzero(edge == 1)
                stops = np.unique(np.concatenate([np.flatnonzero(edge == -1), shard.bounds]))
                run_end = stops[np.searchsorted(stops, run_start, "right")]
                run_doc = shard.doc_of(run_start)
                docs = np.unique(doc)
                shift = np.array(row["firsts"]) - shard.bounds[:-1]
                items = [[names[k] for k in item[a:b]] for a, b in zip(np.searchsorted(owner, docs), np.searchsorted(
                    owner, docs, "right"), strict=True)]
                runs = [[{"start": int(s + shift[d]), "end": int(e + shift[d])} for s, e in zip(
                    run_start[run_doc == d], run_end[run_doc == d], strict=True)] for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(row["row_nos"])[docs]), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(
                        pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["row_no", "items", "runs"])

    return index.select(F.transform("rows", lambda r: r["_row_no"]).alias("row_nos"), "firsts", "n_words", "terms", "counts", "postings").mapInArrow(
        run, T.StructType.fromDDL(f"row_no bigint, items array<string>, runs {RUNS}"))


def _joined(runs: Column) -> Column:
    """Runs in order, those that touch or overlap as one."""
    zero = F.struct(F.expr(f"cast(array() as {RUNS})").alias("out"), F.lit(None).cast("bigint").alias("start"),
                    F.lit(None).cast("bigint").alias("end"))

    def shut(a: Column) -> Column:
        return F.when(a["start"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(
            a["start"].alias("start"), a["end"].alias("end")))))

    def step(a: Column, r: Column) -> Column:
        apart = a["start"].isNull() | (r["start"] > a["end"])
        return F.struct(F.when(apart, shut(a)).otherwise(a["out"]).alias("out"), F.when(apart, r["start"]).otherwise(
            a["start"]).alias("start"), F.when(apart, r["end"]).otherwise(F.greatest(a["end"], r["end"])).alias("end"))

    return F.aggregate(F.array_sort(runs), zero, step, shut)


def search(index: DataFrame, wanted: DataFrame, within: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_no, items, runs) of the texts in which a phrase of (item, phrase) occurs: sorted keys of such items, and the runs
    of words in matches (start and end in words, end exclusive).  One scan of the index for each block of phrases."""
    wanted = staged(wanted.select("item", "phrase"), "phrase-wanted")
    size = wanted.agg(F.sum(F.octet_length("item") + F.octet_length("phrase") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = None
    for number in range(blocks):
        one = wanted.where(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == number).toPandas()
        if len(one):
            hits = staged(_search_block(index, one, within), "phrase-hits")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return index.sparkSession.createDataFrame([], f"row_no bigint, items array<string>, runs {RUNS}")
    merged = found.groupBy("row_no").agg(F.flatten(F.collect_list("items")).alias("items"),
                                         F.flatten(F.collect_list("runs")).alias("runs"))
    return merged.select("row_no", F.array_sort(F.array_distinct("items")).alias("items"), _joined(F.col("runs")).alias("runs"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """(row: all columns of docs but the text, n_words, items, runs) of every row; items and runs are NULL without a match."""
    index = build(docs, text, overlap=window - 1)
    found = search(index, windows(items, item_key, item_text, window))
    return lengths(index).join(found, F.col("row._row_no") == F.col("row_no"), "left").drop("row_no")
