"""Cores of the operators against brute force, without tables."""

import sys
import subprocess
import os
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillworks.llm import arc, covertree, crf, factorisation, lshforest, packing, wavelet
from tillworks.llm.components import forest
from tillworks.llm.words import NO_LETTER, slices, words


@given(st.lists(st.text(alphabet="ab \n.é", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_a_split(texts):
    w = words(pa.array(texts, pa.string()))
    found = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)]
             for i, j in zip(w.docs[:-1], w.docs[1:], strict=True)]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    by_word = {}
    for h, word in zip(w.hashes().tolist(), itertools.chain(*found), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_all_rows():
    column = pa.array(["x" * 10, "", "y" * 100, None, "z"])
    assert list(slices(column, 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices(column.slice(0, 0))) == []


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (700, 2), (5000, 300)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    m = wavelet.WaveletMatrix.load(wavelet.WaveletMatrix.build(ids).dump())
    assert m.decode().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, n, 13)] == ids[::13].tolist()
    for s in {0, 1, top // 2, top, 5 * top}:
        places = np.flatnonzero(ids == s)
        assert m.count(s) == len(places)
        assert [m.select(s, k) for k in range(0, len(places), 5)] == places[::5].tolist()
        assert m.count(s, n // 4, n // 2) == ((places >= n // 4) & (places < n // 2)).sum()


ODD_TEXTS = ["It's <|endoftext|> foo<|ENDOFTEXT|>Bar, I'LL x'sab 'tis don't-stop…... a.b.c 'S 1,234.5 Ünï—ok Å é́'", None,
             "", " ", "'s't A'", "Σας ΟΔΟΣ. İstanbul I.", "a̧'b ź.,q\x85w\x1cx", "日本語。テスト!abc《x》", "a\x7fb \x00x",
             "x" * 5000 + ".." + "1" * 300]


def test_encoder_gives_the_ids_of_the_tokenizer():
    import public_tokenizers
    coder = wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"), cache_words=3)
    for texts in (ODD_TEXTS, [t for t in ODD_TEXTS if not t or "<|" not in t], [], ["", None]):
        ids, first = coder.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[first[i]:first[i + 1]].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n, spread, cosine", [(1, 0.1, 0.98), (300, 0.02, 0.98), (400, 0.3, 0.9), (200, 1.0, 0.2)])
def test_cover_trees_find_all_pairs(n, spread, cosine):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(6, 16))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = n // 3
    for left, right, same in ((x, x, True), (x[:half + 1], x[half:], False)):
        a = covertree.CoverTree(left)
        b = a if same else covertree.CoverTree(right)
        for level, nodes in enumerate(a.nodes[:-1]):
            assert set(nodes) <= set(a.nodes[level + 1])  # nested
        got = set(zip(*(v.tolist() for v in covertree.dual_pairs(a, b, cosine, same)), strict=True))
        wanted = left @ right.T >= cosine
        wanted = np.triu(wanted, 1) if same else wanted
        assert got == set(zip(*(v.tolist() for v in np.nonzero(wanted)), strict=True))


def test_forest_connects_like_the_links():
    rng = random.Random(3)
    for n, m in ((1, 0), (10, 4), (60, 50), (60, 400)):
        a, b = ([rng.randrange(n) for _ in range(m)] for _ in range(2))
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in zip(a, b, strict=True):
            x, y = sorted((find(x), find(y)))
            root[y] = x
        x, y = forest(n, np.array(a, int), np.array(b, int))
        least = dict(zip(x.tolist(), y.tolist(), strict=True))
        assert [least.get(i, i) for i in range(n)] == [find(i) for i in range(n)]


def _grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_gram_sets_and_block_links():
    rng = random.Random(5)
    base = [str(rng.randrange(500)) for _ in range(60)]
    texts = ["", "one", "two words", "a b c d e", "a b c d f"]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = "x" + str(rng.randrange(99))
        texts.append(" ".join(w * rng.choice([1, 1, 2])))
    grams, first = lshforest.gram_sets(pa.array(texts))
    sets = [grams[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    true = [_grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in true]

    def close(i, j):
        both = len(true[i] & true[j])
        return both > 0 and both >= 0.8 * len(true[i] | true[j])

    n = len(texts)
    i, j = lshforest.block_links(sets, sets, 0.8, True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(n) for b in range(a + 1, n) if close(a, b)}
    i, j = lshforest.block_links(sets[:20], sets[20:], 0.8, False)
    assert set(zip(i.tolist(), (j + 20).tolist(), strict=True)) == {
        (a, b) for a in range(20) for b in range(20, n) if close(a, b)}


def test_prefix_depth_reaches_the_recall():
    for trees, recall in ((8, 0.9), (32, 0.9999), (64, 0.99)):
        d = lshforest.prefix_depth(0.8, trees, 8, recall)
        assert d == 1 or 1 - (1 - 0.8 ** d) ** trees >= recall
        assert d == 8 or 1 - (1 - 0.8 ** (d + 1)) ** trees < recall


def test_tries_are_shortened_until_the_recall_where_it_adds_least():
    pairs = {(t, d): 100 * (9 - d) for t in range(32) for d in range(4, 9)}
    for t in (3, 17):  # a passage of many documents rules these tries below 7 levels
        pairs |= {(t, d): 10**9 for d in (4, 5, 6)}
    depths = lshforest.tree_depths(pairs, 0.8, 32, 8, 4, 0.9999)
    assert 1 - math.prod(1 - 0.8 ** d for d in depths) >= 0.9999
    assert depths[3] >= 7 and depths[17] >= 7 and min(depths) < 7
    longer = [depths[:t] + [depths[t] + 1] + depths[t + 1:] for t in range(32) if depths[t] == min(depths)]
    assert all(1 - math.prod(1 - 0.8 ** d for d in some) < 0.9999 for some in longer)
    assert lshforest.tree_depths({}, 0.8, 2, 8, 1, 0.9999) == [1, 1]  # out of reach: as short as allowed
    assert 8 >= lshforest.tree_depths({}, 1.0, 4, 8, 1, 0.9999)[0] >= 1


def test_shared_levels_of_sorted_paths():
    path = np.array([0x0102030405060708, 0x0102030405060708, 0x0102030405060799, 0x01FF000000000000, 0x02FF000000000000,
                     0x02FF000000000000], np.uint64)
    assert lshforest.shared_levels(np.array([0, 0, 0, 0, 0, 1]), path).tolist() == [8, 7, 1, 0, 0]


def test_signatures_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(2)
    both = np.sort(rng.integers(0, 1 << 54, 800).astype(np.uint64))
    mine, other = (rng.integers(0, 1 << 54, 100).astype(np.uint64) for _ in range(2))
    grams = np.concatenate([both, mine, both, other])
    paths = lshforest.signatures(grams, np.array([0, 900, 1800]), 400, 2).view(np.uint64)
    same = (paths[0] >> np.uint64(8) == paths[1] >> np.uint64(8)).mean()
    assert abs(same - 0.8) < 0.07


def test_marginals_are_sums_over_all_taggings():
    rng = np.random.default_rng(0)
    docs = np.array([0, 4, 4, 5, 11])
    emission, start, moves = rng.normal(size=11) * 2, rng.normal(size=2), rng.normal(size=(2, 2))
    p, pairs = crf.Chains(docs).marginals(emission, start, moves, True)
    wanted, wanted_pairs = np.zeros(11), np.zeros((2, 2))
    for a, b in zip(docs[:-1], docs[1:], strict=True):
        if a == b:
            continue
        total, marked, moved = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=b - a):
            s = start[tags[0]] + sum(emission[a + i] for i, t in enumerate(tags) if t)
            s = math.exp(s + sum(moves[x, y] for x, y in itertools.pairwise(tags)))
            total += s
            marked += s * np.array(tags)
            for x, y in itertools.pairwise(tags):
                moved[x, y] += s
        wanted[a:b] = marked / total
        wanted_pairs += moved / total
    assert np.allclose(p, wanted)
    assert np.allclose(pairs, wanted_pairs)


def toxic_sample(n=600, seed=1):
    rng = random.Random(seed)
    letters = random.Random(77)
    vocabulary = ["".join(letters.choice("abcdefghiklmnopqrstu") for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rotter", "grubby", "zorq" + rng.choice(vocabulary)]))
        rows.append((" ".join(w), int(i % 5 == 0)))
    return pd.DataFrame(rows, columns=["text", "label"])


def test_field_learns_words_and_stems():
    model = crf.train(toxic_sample())
    lookup = crf.Lookup(model.features)
    texts = pa.array(["abcd efgh vilest qrst", "abcd efgh qrst", "zorqunseen abcd efgh", "", "efgh grubby"])
    scores, w, p = crf.tag_batch(model, lookup, texts)
    assert (scores[[0, 2, 4]] > 0.5).all()
    assert (scores[[1, 3]] < 0.5).all()
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[p >= 0.5], w.ends[p >= 0.5], strict=True)]
    assert found == ["vilest", "zorqunseen", "grubby"]
    held = toxic_sample(400, 9)
    scores = crf.tag_batch(model, lookup, pa.array(held["text"]))[0]
    assert ((scores >= 0.5) == (held["label"] == 1)).mean() > 0.97


def test_long_chains_are_carried_from_piece_to_piece():
    rng = np.random.default_rng(3)
    docs = np.array([0, 700, 700, 701, 957, 1300])
    emission, start, moves = rng.normal(size=1300) * 3, rng.normal(size=2), rng.normal(size=(2, 2)) * 2
    held, crf.SEGMENT = crf.SEGMENT, 1300
    try:
        whole = crf.Chains(docs).marginals(emission, start, moves, True)
        for crf.SEGMENT in (1, 7, 128, 343):
            for got, wanted in zip(crf.Chains(docs).marginals(emission, start, moves, True), whole, strict=True):
                assert np.allclose(got, wanted)
    finally:
        crf.SEGMENT = held
    p = crf.Chains(np.array([0, 4])).marginals(np.array([900.0, -900, 900, -900]), start, moves)
    assert np.allclose(p, [1, 0, 1, 0])


def test_field_is_fitted_to_all_texts_of_the_sample():
    rng = random.Random(4)
    rows = [(f"alpha{i} {rng.choice('bcdefg') * 4} rotter", 1) for i in range(1250)]
    rows += [(f"zulu{i} {rng.choice('bcdefg') * 4} vilest", 1) for i in range(150)]
    rows += [(f"{rng.choice(['alpha', 'zulu'])}{i} {rng.choice('bcdefg') * 4} plain", 0) for i in range(3000)]
    sample = pd.DataFrame(rows, columns=["text", "label"]).sort_values(["label", "text"]).reset_index(drop=True)
    model = crf.train(sample)
    texts = pa.array(["bbbb vilest", "bbbb rotter", "bbbb plain"])
    assert (crf.tag_batch(model, crf.Lookup(model.features), texts)[0] >= 0.5).tolist() == [True, True, False]


def test_training_without_both_classes():
    one = pd.DataFrame({"text": ["a b"], "label": [1]})
    assert crf.train(one).constant == 1.0
    assert crf.train(one.iloc[:0]).constant == 0.0
    assert factorisation.train(one, 1.0).constant == 1.0


def test_toxic_spans_keep_their_places():
    """Letters whose lower case is longer, and characters of two UTF-16 units, move no span."""
    model = crf.train(toxic_sample())
    lookup = crf.Lookup(model.features)
    text = "İİİİ 𝄞 vilest place, VILEST again"
    _, spans = crf.score_column(model, lookup, pa.array([None, "", text]))
    assert spans[:2] == [[], []]
    assert {text[s["start"]:s["end"]].lower() for s in spans[2]} == {"vilest"} and len(spans[2]) == 2


def test_long_texts_score_as_short_ones(monkeypatch):
    """A text in parts has the scores and spans of the whole one."""
    model = crf.train(toxic_sample())
    lookup = crf.Lookup(model.features)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["é", "plain", "vilest", "words", "rotter", "𝄞", "x" * 90]) for _ in range(rng.randint(0, 400)))
             for _ in range(20)] + [None, "", "vilest"]
    whole = crf.score_column(model, lookup, pa.array(texts))
    monkeypatch.setattr(crf, "PIECE", 100)
    scores, spans = crf.score_column(model, lookup, pa.array(texts))
    assert np.allclose(scores, whole[0], rtol=1e-9, atol=1e-12) and spans == whole[1]


def test_long_text_takes_little_memory():
    """64 MB of text: the arrays beside it are those of a part."""
    code = (
        "import resource, sys; import numpy as np, pyarrow as pa; from tillworks.llm import crf;"
        "f = np.sort(np.arange(1, 200, dtype=np.uint64) << np.uint64(55));"
        "m = crf.Model(f, np.ones(len(f)), -4.0, np.zeros(2), np.zeros((2, 2)), np.array([-1.0, 1, 1]));"
        "texts = pa.array(['many words of a text. ' * (3 << 20)]); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
        "crf.score_column(m, crf.Lookup(f), texts); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300, check=True).stdout
    assert int(out) < 160  # MB: the text once more in parts, and one part's arrays


def test_factorisation_identity():
    rng = np.random.default_rng(4)
    x = factorisation.vectors(pa.array(["a b a c", "", "ONE!! two, three. 3", "x" * 200]))
    size = factorisation.BUCKETS + factorisation.STATISTICS
    model = factorisation.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 3)))
    for d, z in enumerate(factorisation.raw_scores(model, x)):
        at = x.places[x.docs[d]:x.docs[d + 1]]
        v = x.values[x.docs[d]:x.docs[d + 1]].astype(float)
        slow = 0.3 + (model.linear[at] * v).sum() + sum(
            (model.factors[at[i]] @ model.factors[at[j]]) * v[i] * v[j] for i in range(len(at)) for j in range(i))
        assert math.isclose(z, slow, rel_tol=1e-4, abs_tol=1e-4)


def test_factorisation_learns_an_interaction():
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice("abcdefgh") * 3 for _ in range(6)] + ["north" if a else "south", "red" if b else "blue"]
        rng.shuffle(w)
        rows.append((" ".join(w), int(a == b)))
    frame = pd.DataFrame(rows, columns=["text", "label"])
    model = factorisation.train(frame.iloc[:1200], 0.5)
    z = factorisation.raw_scores(model, factorisation.vectors(pa.array(frame["text"].iloc[1200:])))
    assert ((z > 0) == (frame["label"].iloc[1200:] == 1)).mean() > 0.9


def _slow_fill(rest, room):
    """Greedy layout of a multiset: always the largest size that fits, each size as often as it goes."""
    left = room
    for s in sorted(set(rest), reverse=True):
        if s <= left:
            left -= s * min(rest.count(s), left // s)
    return room - left


@given(st.lists(st.integers(1, 64), max_size=40))
@settings(max_examples=80, deadline=None)
def test_packing_against_a_plain_search(sizes):
    lengths = (8, 16, 32, 64)
    bins, placed, rest = [], {}, list(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        rest.remove(s)
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= s]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], b))
        else:
            c = min((c for c in lengths if c >= s), key=lambda c: (packing.cost(c) / (s + _slow_fill(rest, c - s)), c))
            b = len(bins)
            bins.append([c, 0])
        placed[i] = (b, bins[b][1])
        bins[b][1] += s
    fitted = [min(c for c in lengths if c >= used) for _, used in bins]
    assert packing.pack(sizes, lengths) == [(b, o, fitted[b]) for b, o in (placed[i] for i in range(len(sizes)))]


def test_packing_beats_one_length():
    rng = random.Random(1)
    sizes = [min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    bins = {b: c for b, _, c in packing.pack(sizes)}
    assert sum(sizes) / sum(bins.values()) > 0.99
    assert len(set(bins.values())) > 1


ARC_1 = (b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 77\n1 0 Alexa Internet\nURL IP-address Archive-date "
         b"Content-type Archive-length\n\n")
ARC_2 = (b"filedesc://new.arc 0.0.0.0 20010923142103 text/plain 122\n2 0 Some Crawler\nURL IP-address Archive-date "
         b"Content-type Result-code Checksum Location Offset Filename Archive-length\n")


def arc_file(version, records):
    head, _, rest = (ARC_1, ARC_2)[version - 1].partition(b"\n")
    first = head.rsplit(b" ", 1)[0] + b" %d\n" % len(rest)
    out = first + rest + b"\n"
    for url, body in records:
        middle = b"" if version == 1 else b"200 abc - 17 new.arc "
        out += url + b" 10.0.0.1 19970101120000 text/html " + middle + b"%d\n" % len(body) + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    records = [(b"http://a/b c", http + "é\n\nhttp://x 1 2 3 4\n".encode()), (b"http://b/", b""), (b"dns:c", b"plain")]
    got = list(arc.arc_records(arc_file(version, records)))
    assert [(v, h["url"].encode(), body) for v, _, h, body in got] == [(version, u, b) for u, b in records]
    header = got[0][2]
    assert header["ip"] == "10.0.0.1"
    text = arc.warc_record(header, records[0][1], 7)
    (fields, block), = arc.parse_warc((text + arc.END).encode())
    assert block == records[0][1]
    assert fields["WARC-Date"] == "1997-01-01T12:00:00Z"
    assert arc.payload_of(block)[1].decode().startswith("é")
    (fields, block), = arc.parse_warc((arc.warc_record(header, records[0][1], 7, 9, True) + arc.END).encode())
    assert (fields["WARC-Type"], block) == ("revisit", http)


@pytest.mark.parametrize("bad", [b"http://a 1.1.1.1 2001 text/html x\nabc", b"http://a 10\nabc",
                                 b"http://a 1.1.1.1 2001 text/html 10\nabc"])
def test_arc_records_that_do_not_fit(bad):
    with pytest.raises(ValueError):
        arc.split_record(bad, 0, 1)


def test_arc_date_shapes():
    assert arc._iso("1997") == "1997-01-01T00:00:00Z"
    assert arc._iso("19970305112233") == "1997-03-05T11:22:33Z"
    assert arc._iso("?") == "1970-01-01T00:00:00Z"
