"""Importance resampling, spelling variants and the phrase index against brute force, on odd and on planted texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENTS, with_clashes
from tillworks.llm import importance, phrases, tokens, variants
from tillworks.llm.common import share_code

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [*(r[:2] for r in DOCUMENTS), (20, "İstanbul ÀÉ×÷ 𝄞𝄞 x\x00y"), (21, "z" * 300 + " " + "z" * 300 + " q"), (22, "42 1999 42 1999")]


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    share_code(spark)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(folded(text))


def spark_docs(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(3)


# tokens

@given(st.lists(st.binary(max_size=90), max_size=8), st.integers(0, 2 ** 32 - 1))
@settings(max_examples=60, deadline=None)
def test_crc32(strings, before):
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
    starts = ends - np.array([len(s) for s in strings], np.int64)
    got = tokens.crc32(np.frombuffer(b"".join(strings), np.uint8), starts, ends, before)
    assert got.tolist() == [zlib.crc32(s, before) for s in strings]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .é\x00ñ𝄞_", max_size=40)), max_size=6), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_pieces_hold_all_words(texts, most):
    column = pa.array(texts, pa.string())
    got = [[] for _ in texts]
    for first, part, _ in tokens.pieces(column, most):
        words, bounds = tokens.split_words(part)
        for i in range(len(part)):
            got[first + i] += words[bounds[i]:bounds[i + 1]].to_pylist()
    assert got == [words_of(t) for t in texts]


# importance resampling

def features(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def plain_importance(rows, targets, least_words=20, share=25):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([r[1] for r in rows], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, (key, text) in enumerate(rows):
        f = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, f)]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, None, len(words_of(text)), i])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:len(able) * share // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


def test_importance(spark, monkeypatch):
    rng = random.Random(5)
    rows = ODD + [(100 + i, " ".join(rng.choice(["alpha", "beta", "Gamma", "é", "42"]) for _ in range(rng.randint(10, 60))))
                  for i in range(80)]
    targets = ["alpha alpha beta", None, "", "Gamma é"]
    docs, target = spark_docs(spark, rows), spark.createDataFrame([(t,) for t in targets], "text string")
    def run(**choices):
        found = importance.importance(docs, target, **choices).select("row.doc_id", "n_features", "weight", "score", "rank")
        return Counter(map(tuple, found.collect()))
    assert run() == plain_importance(rows, targets)
    assert run(least_words=0, share=100) == plain_importance(rows, targets, 0, 100)  # ties, NULL and repeated ids are ranked
    monkeypatch.setattr(tokens.pieces, "__defaults__", (64,))  # parts of texts: pairs across them count
    w, p, d, last = importance.piece_buckets(pa.array(["one two"]), 10_000)
    w2, p2, _, _ = importance.piece_buckets(pa.array([" three"]), 10_000, last)
    assert [*w, *w2] == [bucket(x) for x in ("one", "two", "three")]
    assert [*p, *p2] == [-1, bucket("one two"), bucket("two three")]


def test_resample_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(60)]
    docs, target = spark_docs(spark, rows), spark.createDataFrame([("a b c",)], "text string")
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns
    want = plain_importance(rows, ["a b c"])
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(k[0] for k in want if k[4] is not None)


def test_importance_of_nothing(spark):
    none, some = (spark.createDataFrame(r, "doc_id bigint, text string") for r in ([], [(1, "a b")]))
    assert importance.importance(none, some).count() == importance.resample(none, some).count() == 0
    assert [tuple(r)[1:] for r in importance.importance(some, none).select("row.doc_id", "n_features").collect()] == [(3,)]


# spelling variants

def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = folded(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[variants.drop_letter(run, h % len(run)) if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    near = {w: [o for o in counts if variants.one_edit(w, o)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


@given(st.text("aéb", max_size=7), st.text("aéb", max_size=7))
@settings(max_examples=300, deadline=None)
def test_one_edit(a, b):
    made = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + k:] for i in range(len(a) + 1) for c in "aéb" for k in (
        0, 1) if i + k <= len(a)}
    assert variants.one_edit(a, b) == (b in made - {a})
    if a and b:
        one, other = variants.Letters([a]), variants.Letters([b])
        assert one.near(np.zeros(1, int), other, np.zeros(1, int))[0] == variants.one_edit(a, b)


def spellings(seed, size=150, alphabet="abcdeorstnéñ÷"):
    rng = random.Random(seed)
    out = set()
    for _ in range(size):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 10)))
        out.add(w)
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            out.add(rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]]))
    return sorted(out | {"a" * 60, "a" * 61, "a" * 59 + "b", "a" * 47 + "b", "a" * 48 + "b", "a" * 49})


def test_trie_finds_all_near_words():
    words = spellings(1)
    table = pd.DataFrame({"word": words, "n": [1 + i % 7 for i in range(len(words))]})
    n = dict(zip(words, table["n"], strict=True))
    got = {r.word: (r.n_near, r.form) for r in variants.search_block(table, table.assign(home=True), [*range(16)]).itertuples()}
    want = {}
    for w in words:
        near = [o for o in words if variants.one_edit(w, o)]
        if near:
            want[w] = (len(near), min(near, key=lambda o: (-n[o], o)))
    assert got == want


@pytest.mark.parametrize(("block", "guests"), [(20_000, 100_000), (60, 40), (3, 5)])
def test_blocks_split_and_deepen(spark, block, guests):
    """However small the blocks are, no pair is lost and none counts twice."""
    words = spellings(2, 60)
    counts = {w: 1 + (i * 37) % 90 for i, w in enumerate(words)}
    frame = spark.createDataFrame([*counts.items()], "word string, n bigint")
    got = {r.word: (r.n_near, r.form_n, r.form) for r in variants.near_words(frame, block, guests).collect()}
    near = {w: [o for o in words if variants.one_edit(w, o)] for w in words}
    assert got == {w: (len(f), max(counts[o] for o in f), min(f, key=lambda o: (-counts[o], o))) for w, f in near.items() if f}


def test_variants(spark):
    rng = random.Random(7)
    chain = ["wordword"] * 300 + ["wordwird"] * 25 + ["wurdwird"] * 2
    pool = spellings(3, 40)
    rows = ODD + [(200 + i, "; ".join(rng.choice(pool).title() for _ in range(30))) for i in range(40)]
    rows += [(300 + i, " ".join(chain[i::12])) for i in range(12)]
    got = variants.variants(spark_docs(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain_variants(plain_words(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert ("wurdwird", "wordwird", "wordword") in {tuple(r)[:3] for r in got}  # forms are followed to the last


def test_variants_of_nothing(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 0


# phrases

def plain_contamination(rows, items, window=10):
    out = Counter()
    for key, text in rows:
        w, hit, names = words_of(text), set(), set()
        for name, item in items:
            own = words_of(item)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                part = own[k:k + window]
                for i in range(len(w) - len(part) + 1):
                    if w[i:i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        names.add("" if name is None else str(name))
        runs = tuple((i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit)
        out[key, len(w), tuple(sorted(names)), runs] += 1
    return out


def texts_with_passages(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("abcde") + rng.choice("xyz") for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 14]))))
             for i in range(30)] + [(None, "Null item"), (None, "second NULL item"), (50, None), (51, " .. "), (2, "one key, two texts")]
    rows = []
    for i in range(60):
        w = [rng.choice("abcde") + rng.choice("xyz") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = words_of(rng.choice(items)[1])
        rows.append((500 + i, rng.choice([" ", ". ", "\n-"]).join(w)))
    return rows, items


def collected(found):
    return Counter((r.doc_id, r.n_words, tuple(r["items"] or ()), tuple((s.start, s.end) for s in r.runs or ())) for r in found.select(
        "row.doc_id", "n_words", "items", "runs").collect())


def test_contamination(spark, monkeypatch):
    rows, items = texts_with_passages(8)
    rows = ODD + rows + [rows[3], rows[3], (None, items[0][1])]
    docs = spark_docs(spark, rows)
    wanted = with_clashes(spark.createDataFrame(items, "item_id bigint, text string"))
    want = plain_contamination(rows, items)
    assert sum(bool(k[2]) for k in want) > 20
    assert collected(phrases.contamination(docs, wanted)) == want
    index = phrases.build(docs.select("doc_id", "text"), shard_bytes=40)  # most texts in parts
    assert index.where("size(firsts) = 1 and firsts[0] > 0").count() > 20
    found = phrases.search(index, phrases.windows(wanted), block_bytes=400)  # phrases in many blocks
    again = phrases.lengths(index).join(found, F.col("row._row_no") == F.col("row_no"), "left")
    assert collected(again) == want


def test_close_words(spark):
    rows, items = texts_with_passages(9)
    wanted = phrases.windows(spark.createDataFrame(items, "item_id bigint, text string"), window=4)
    index = phrases.build(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = phrases.search(index, wanted, within=6)
    got = {(r.doc_id, name) for r in phrases.lengths(index).join(found, F.col("row._row_no") == F.col("row_no")).select(
        "row.doc_id", "items").collect() for name in r["items"]}
    want = set()
    for key, text in rows:
        w = words_of(text)
        for name, item in items:
            own = words_of(item)
            for k in range(max(1, len(own) - 3) if own else 0):
                if any(set(own[k:k + 4]) <= set(w[i:i + 6]) for i in range(len(w))):
                    want.add((key, "" if name is None else str(name)))
    assert got == want and len(want) > 50


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert phrases.contamination(none, items).count() == 0
    assert [tuple(r) for r in phrases.contamination(some, items.limit(0)).select("n_words", "items").collect()] == [(2, None)]
