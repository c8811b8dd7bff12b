"""Token ids in wavelet matrices: one succinct, compressed file per shard that answers access, count and position queries.

A shard holds whole documents in key order as one sequence of ids, numbered by rank among the ids that occur in it, so it has
as few levels as its alphabet needs.  Level by level the sequence is split by one bit of
the ranks, highest first, and stably rearranged; only the bits are kept, with a directory of ones per 512 bits.  Token
access, the number of occurrences in a range and the place of the k-th occurrence walk the levels once.

Rows are range-partitioned by key and sorted, so shards are in key order and as large as ``SHARD_TOKENS`` wants, or one
document if that is longer.  A shard is a row of a Parquet table with one row per file, so writing is committed by Spark and
works on any file system.  Starts are prefix sums: in the shard, of shards in a partition, of partitions in the table.

Cases: NULL and empty texts are the end id alone; rows that repeat a key lie side by side, ordered by text; NULL keys come
first; an empty table gives no shards.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillworks.llm.common import bounded_batches
from tillworks.llm.words import FOLD, LETTER, MARK, SPACE, slices, text_bytes
from tillworks.session import scratch

END_ID = 1
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 800_000
WORD_END = "</w>"  # fixed value: mark of the tokens that end a word
BLOCK = 512
MAGIC = b"WVM2"


class WaveletMatrix:
    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], ones: list[np.ndarray],
                 zeros: Sequence[int]):
        """alphabet: the ids that occur, ascending; planes: 64-bit words per level; ones: set bits before each block;
        zeros: clear bits per level."""
        self.n, self.alphabet, self.planes, self.ones, self.zeros = n, alphabet, planes, ones, list(zeros)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        used = np.zeros(int(ids.max()) + 1 if n else 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype("<u4")
        levels = max(1, (len(alphabet) - 1).bit_length())
        seq = (np.cumsum(used) - 1).astype(np.uint16 if levels <= 16 else np.uint32)[ids]
        planes, ones, zeros = [], [], []
        for level in reversed(range(levels)):
            bit = (seq >> level) & 1 == 1
            packed = np.zeros(-(-max(n, 1) // BLOCK) * BLOCK // 8, np.uint8)
            packed[:(n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            per_block = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(words)
            ones.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)]))
            seq = np.concatenate([seq[np.flatnonzero(~bit)], seq[np.flatnonzero(bit)]])
            zeros.append(n - int(per_block.sum()))
        return cls(n, alphabet, planes, ones, zeros)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 6]) >> (i & 63) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Set bits before position i."""
        block, words = i // BLOCK, self.planes[level]
        total = int(self.ones[level][block])
        first = block * (BLOCK // 64)
        total += int(np.bitwise_count(words[first:i >> 6]).sum())
        return total + ((int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else 0)

    def _select(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            before = self._rank1(level, mid + 1)
            if (before if bit else mid + 1 - before) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = z + ones if bit else i - ones
        return int(self.alphabet[value])

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        levels = len(self.zeros)
        rank = int(np.searchsorted(self.alphabet, symbol))
        if rank == len(self.alphabet) or self.alphabet[rank] != symbol:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (z + a, z + b) if rank >> (levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences in [lo, hi)."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        at, rank = self._range(symbol, 0, self.n)[0] + k, int(np.searchsorted(self.alphabet, symbol))
        for level in reversed(range(len(self.zeros))):
            bit = rank >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        values = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for step, (words, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~bit)] = values[:z]
            above[np.flatnonzero(bit)] = values[z:] | values.dtype.type(1 << step)
            values = above
        return self.alphabet[values]

    def dump(self) -> bytes:
        head = MAGIC + struct.pack("<QIB", self.n, len(self.alphabet), len(self.zeros))
        head += self.alphabet.tobytes() + np.array(self.zeros, "<u4").tobytes()
        return head + b"".join(p.tobytes() + o.astype("<u4").tobytes() for p, o in zip(self.planes, self.ones, strict=True))

    @classmethod
    def load(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, size, levels = struct.unpack_from("<QIB", data, 4)
        alphabet = np.frombuffer(data, "<u4", size, 17)
        at = 17 + 4 * size
        zeros = np.frombuffer(data, "<u4", levels, at).tolist()
        at += 4 * levels
        blocks = -(-max(n, 1) // BLOCK)
        planes, ones = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(data, "<u8", blocks * BLOCK // 64, at))
            at += blocks * BLOCK // 8
            ones.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, alphabet, planes, ones, zeros)


class Encoder:
    """Ids of texts.  Tokens of this vocabulary never cross white space, nor the place where an ASCII letter meets ASCII
    punctuation, and case is folded, so the ids of a text are those of its pieces one after the other.  Arrow tells the
    distinct pieces of a batch; those not seen before go to the tokenizer, the others come from a cache of bounded size."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks of an executor side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words, self.cache = Tokenizer.from_file(vocabulary), cache_words, {}
        known = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.ends_word[[i for token, i in known.items() if token.endswith(WORD_END)]] = True

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces one by one."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _fresh_letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces made of letters, many in one call: such a piece ends with its only end-of-word token.  Where the
        number of those tokens is not the number of pieces, the pieces go one by one."""
        found = self.tokenizer.encode_batch_fast([" ".join(pieces[i:i + 500]) for i in range(0, len(pieces), 500)],
                                                 add_special_tokens=False)
        out = []
        for i, x in enumerate(found):
            part = pieces[500 * i:500 * i + 500]
            ids = np.array(x.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._fresh(part)
                continue
            data, places = ids.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *places], places, strict=False)]
        return out

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.cache) > self.cache_words:
            self.cache = {}
        found = list(map(self.cache.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        texts = [pieces[i].decode() for i in missing]
        letters = list(map(str.isalpha, texts))
        for some, encode in ((True, self._fresh_letters), (False, self._fresh)):
            places = [i for i, yes in zip(missing, letters, strict=True) if yes == some]
            if places:
                fresh = encode([t for t, yes in zip(texts, letters, strict=True) if yes == some])
                for i, ids in zip(places, fresh, strict=True):
                    found[i] = self.cache[pieces[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; first id of each text and the end)."""
        data, offsets = text_bytes(texts)
        plain = b"<|" not in data.tobytes()  # special tokens are told by case and hold marks
        if plain:
            data = FOLD[data]
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (LETTER[data[:-1]] & MARK[data[1:]]) if plain else ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        before = np.cumsum(inside, dtype=np.int32)
        places = np.append(before[starts] - 1, before[-1]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
        _, bounds, distinct = pieces.dictionary.buffers()
        distinct = distinct.to_pybytes()
        bounds = np.frombuffer(bounds, np.int64)[:len(pieces.dictionary) + 1].tolist()
        known = self._ids([distinct[a:b] for a, b in pairwise(bounds)])
        which = pieces.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        n = sizes[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per Python worker, so its cache serves the next task as well."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()),
                    ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("matrix", pa.binary())])
SHARDS_DDL = ("part int, shard int, shard_start bigint, n_tokens bigint, keys array<bigint>, lengths array<int>, "
              "matrix binary")


def write_shards(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                 end_id: int | None = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write them as shards in key order."""
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        keys, ids, held, shard, start = [], [], 0, 0, 0

        def flush():
            lengths = [len(x) for x in ids]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (part, shard, start, held, keys, lengths, WaveletMatrix.build(np.concatenate(ids)).dump()), SHARDS,
                strict=True)], schema=SHARDS)

        coder = encoder(vocabulary)
        for batch in batches:
            for at, to in slices(batch.column(1), 16 << 20):
                some = batch.slice(at, to - at)
                found, first = coder.encode(some.column(1))
                for k, x in zip(some.column(0).to_pylist(), np.split(found, first[1:-1]), strict=True):
                    if held and held + len(x) + len(tail) > shard_tokens:
                        yield flush()
                        shard, start, keys, ids, held = shard + 1, start + held, [], [], 0
                    keys.append(k)
                    ids.append(np.concatenate([x, tail]))
                    held += len(ids[-1])
        if keys:
            yield flush()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie")
               .sortWithinPartitions("key", "tie", "text").select("key", "text"))
    (ordered.mapInArrow(encode, SHARDS_DDL).write.option("compression", "zstd")
     .option("parquet.compression.codec.zstd.level", 1).option("maxRecordsPerFile", 1).parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.schema(SHARDS_DDL).parquet(path)


def part_starts(shards: DataFrame) -> DataFrame:
    """(part, part_start): tokens before each partition of the writer; one row per partition."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def documents(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, part, shard) of each document, from the ids in the files."""
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("in_part", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.load(row["matrix"]).decode()
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - row["lengths"]
                n = len(ends)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(
                    (row["keys"], [row["part"]] * n, [row["shard"]] * n, starts + row["shard_start"], row["lengths"], crc),
                    schema, strict=True)], schema=schema)

    found = shards.mapInArrow(decode, "key bigint, part int, shard int, in_part bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(part_starts(shards), "part").select(
        "key", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def token_counts(shards: DataFrame, symbols: Sequence[int]) -> DataFrame:
    """(token, n): occurrences of some ids, counted on the bit-planes without decoding."""
    wanted = [int(s) for s in symbols]

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for matrix in batch.column(0):
                m = WaveletMatrix.load(matrix.as_py())
                yield pa.RecordBatch.from_pydict({"token": wanted, "n": [m.count(s) for s in wanted]})

    return shards.select("matrix").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(
        F.sum("n").alias("n"))


def occurrences(shards: DataFrame, symbol: int) -> DataFrame:
    """(key, position): every place of an id, position from 0 within its document."""
    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix.load(row["matrix"])
                places = np.array([m.select(symbol, k) for k in range(m.count(symbol))], np.int64)
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                doc = np.searchsorted(ends, places, "right")
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["keys"][i] for i in doc], pa.int64()), pa.array(places - starts[doc], pa.int64())],
                    ["key", "position"])

    return shards.mapInArrow(find, "key bigint, position bigint")


def encode_and_read(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write shards to a new folder and describe every document from what the files hold."""
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, path, vocabulary, key, text)
    return documents(read_shards(docs.sparkSession, path)).withColumnRenamed("key", key)
