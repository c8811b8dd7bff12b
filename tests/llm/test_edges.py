"""Every operator and stage with NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.conftest import CLASHES, DOCUMENTS, LONG, with_clashes
from tillworks.llm import arc, covertree, crf, exact_dedup, factorisation, lshforest, mixing, packing, sanitise, wavelet
from tillworks.llm.common import share_code
from tillworks.llm.components import components
from tillworks.llm.queries import VOCABULARY


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    share_code(spark)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(documents, no_documents):
    rows = exact_dedup.decisions(documents, digests=True).collect()
    assert len(rows) == len(DOCUMENTS)
    groups = {}
    for r in DOCUMENTS:
        groups.setdefault(hashlib.sha256(folded(r[1]).encode()).hexdigest(), []).append(r[0])
    assert {r.text_sha256: r.group_size for r in rows} == {h: len(ids) for h, ids in groups.items()}
    assert all(r.keep_id == max((i for i in groups[r.text_sha256] if i is not None), default=None) for r in rows)
    assert sum(r.kept for r in rows) == len(groups)  # one of each group, repeated rows too
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    texts = [folded(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({folded(r[1]) for r in DOCUMENTS})
    assert {r.doc_id for r in kept.collect() if not r.text} == {4}  # NULL and empty are one group
    assert exact_dedup.decisions(no_documents).count() == exact_dedup.drop_copies(no_documents).count() == 0


def test_exact_dedup_reads_on_only_where_needed(documents):
    rows = exact_dedup.refine(documents).select("row.doc_id", "_full").collect()
    assert {r.doc_id for r in rows if r._full} == {1, 2, 3, 4, 10, None}  # 7 and 8 share the beginning, not the length


def test_filters_may_be_small(documents):
    """A saturated filter costs hashes, not results."""
    rows = exact_dedup.refine(documents, prefix=2, length_bits=1, group_bits=1).where("_full is not null")
    assert rows.count() > 6
    assert rows.groupBy("_full").count().where("count > 1").count() == 3


def test_mixing(spark, documents, no_documents):
    rows = mixing.mix_words(documents).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(DOCUMENTS)}
    assert Counter(r.size for r in rows) == Counter(size.values())
    by_source = Counter()
    for i, r in enumerate(DOCUMENTS):
        by_source[r[3]] += size[i]
    taken, targets = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.source_size == by_source[r.source]
    total = sum(by_source.values())
    assert math.isclose(sum(targets.values()), total)
    weights = {s: 1 + i % 3 for i, s in enumerate(["a", "b", "c", "d", None])}
    assert targets["a"] == 3 * by_source["a"] and targets["d"] == 3 * by_source["d"]  # small ones stop
    assert math.isclose(targets["c"] / weights["c"], targets[None] / weights[None])
    assert all(taken[s] == math.floor(t) for s, t in targets.items())
    again = mixing.mix_words(documents.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    mixed = mixing.mix_rows(documents)
    assert mixed.columns == documents.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies[5] == 3 and copies[10] == 2 * 3
    assert mixing.mix_words(no_documents).count() == mixing.mix_rows(no_documents).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert [r.target for r in mixing.mix_words(blank).collect()] == [0.0, 0.0]



@pytest.mark.parametrize("kind", ["no ids", "one id", "equal rows"])
def test_mixed_rows_meet_their_budget(spark, kind):
    """Rows that share an id, or have none, are cut one by one."""
    rows = [(i if i >= 1_800 else None if kind == "no ids" else 7, " ".join(["w"] * 10) + ("" if kind == "equal rows" else f" {i}"),
             f"s{i % 2}" if i >= 1_800 or kind != "equal rows" else "s1") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    want = {r.source: r.target for r in mixing.mix_words(docs).collect()}
    taken = Counter()
    for r in mixing.mix_rows(docs).collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 11 for s, t in want.items())


def test_mixing_cuts_ranges_like_one_sort(spark):
    rows = [(i, " ".join("w" * 1 for _ in range(i % 17)), "s" if i % 3 else "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.start for r in mixing.prefix_sums(df, range_rows=50).collect()}
    for source in "st":
        at = 0
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(
                f"mix:{r[0]}".encode()).hexdigest()):
            assert got[i] == at
            at += len(text.split())


def test_packing(documents, no_documents):
    rows = packing.best_fit(documents, lengths=(64, 256, 1024), block_pieces=40).collect()
    size = Counter()
    bins = {}
    for r in rows:
        size[r.doc_id] += r.size
        bins.setdefault((r.block, r.bin), []).append(r)
    wanted = Counter()
    for r in DOCUMENTS:
        wanted[r[0]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1
    assert size == wanted
    for found in bins.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.size
        assert {r.capacity for r in found} == {min(c for c in (64, 256, 1024) if c >= at)}
    assert len({b for b, _ in bins}) > 1
    assert packing.best_fit(no_documents).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15}[kind]():  # noqa: B023
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = ["a@b.c_d@e.f", "x@y.z@w.v.u", "@a.b a@.b a@b. a@b..c", "%+-@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3",
          "00000000000000000000255.1.1.1", "99999999999.1.1.1", "4111 1111-1111 1111 4111111111111111", "4111  111111111111",
          "0" * 13, "0" * 19, "0" * 20, "1" * 12, "+1 (555) 123-4567", "+1 2", "+12345678", "+123456789 +1234567890123456",
          "++1 22 33 44 55 66 7)", "é𝄞 +33 1 23 45 67 89 é a@b.co", "10.0.0.1@x.y", "+1.2.3.4.5.6.7.8.9", "4" * 3_000,
          "a" * 3_000, "a@" * 30_000, "1." * 30_000, "1 " * 40_000, "+1" + "(" * 60_000, "a.b@c.d " * 200, ""]


def test_sanitise_spans(spark, documents, no_documents):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    for frame in (df, documents.select("doc_id", "text")):
        texts = [(r.doc_id, r.text or "") for r in frame.collect()]
        rows = sanitise.report(frame).collect()
        got = Counter((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in rows)
        assert got == Counter((i, hashlib.sha256(s.encode()).hexdigest(), len(s.split(",")) if s else 0)
                              for i, t in texts for s in [plain_spans(t)])
    assert sanitise.report(documents).count() == len(DOCUMENTS)
    assert sanitise.report(no_documents).count() == 0


def test_sanitise_writes_few_files(spark):
    """A file per part of the input at most, whatever the number of shuffle partitions: each one written costs the executor
    several child processes on a local disk."""
    rows = [(40 * c + j, f"the{chr(97 + c)} treasurer{chr(97 + j // 10)}{chr(97 + j % 10)} account ann{j}@bank.org again")
            for c in range(6) for j in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    written = {os.path.join(d, x) for d, _, names in os.walk(shared) for x in names}
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert sanitise.report(df).where("spans like '%removed%'").count() == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    new = {os.path.join(d, x) for d, _, names in os.walk(shared) for x in names} - written
    assert 1 <= sum(x.endswith(".parquet") for x in new) <= 3


def test_sanitise_terms(spark):
    rows = [(i, f"{'Filler ' * 20}{w} treasurer account ann@bank.org today{i} again") for i, w in enumerate(
        ["the", "a", "one", "our"])]
    rows += [(10 + i, f"the again account number{i}") for i in range(40)] + [(60 + i, "again the") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sanitise.find(df)
    told = {r.term: r for r in sanitise.disclosure(df, found).collect()}
    n = len(rows)
    for term, both, everywhere in (("treasurer", 4, 4), ("account", 4, 44), ("again", 4, n)):
        r = told[term]
        assert (r.n_both, r.n_term, r.n_value) == (both, everywhere, 4)
        assert math.isclose(r.disclosed, math.log2(both * n / (everywhere * 4)) / math.log2(n / 4), abs_tol=1e-9)
    assert "today0" not in told
    spans = {r.doc_id: r.spans for r in sanitise.all_spans(df, generalise=0.3).collect()}
    text = rows[0][1]
    shown = [(sanitise.KINDS[s.kind], text[s.start:s.end]) for s in spans[0]]
    assert shown[0] == ("email", "ann@bank.org")
    told_by = {x for x in shown if x[1] not in ("Filler", "ann@bank.org")}
    assert told_by == {("generalised", "account"), ("removed", "treasurer"), ("removed", "today")}
    marked = sanitise.all_spans(df, generalise=0.3).where("doc_id = 0").join(df, "doc_id")
    from pyspark.sql import functions as F
    out = marked.select(sanitise.masked(F.col("text"), F.col("spans")).alias("t")).first().t
    assert "ann@bank.org" not in out and "treasurer" not in out and "<EMAIL>" in out and "<WORD>" in out
    assert out.endswith("<EMAIL> 0 again")


def test_wavelet_shards(spark, documents, no_documents, folder):
    wavelet.write_shards(documents, folder + "/a", VOCABULARY, shard_tokens=500)
    shards = wavelet.read_shards(spark, folder + "/a")
    rows = wavelet.documents(shards).collect()
    coder = wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], np.append(np.array(coder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, "<u4"), 1).astype(
        "<u4")) for r in DOCUMENTS]
    assert Counter((r.key, r.n_tokens, r.ids_crc32) for r in rows) == Counter(
        (k, len(x), zlib.crc32(x.tobytes())) for k, x in ids)
    ordered = sorted(rows, key=lambda r: r.start)
    keys = [r.key for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    counts = Counter(t for _, x in ids for t in x.tolist())
    some = [1, 320, *[t for t, _ in counts.most_common(3)]]
    assert {r.token: r.n for r in wavelet.token_counts(shards, some).collect()} == {t: counts.get(t, 0) for t in some}
    rare = min(counts, key=lambda t: (counts[t], t))
    places = Counter((k, i) for k, x in ids for i, t in enumerate(x.tolist()) if t == rare)
    assert Counter(map(tuple, wavelet.occurrences(shards, rare).collect())) == places
    assert wavelet.encode_and_read(no_documents, VOCABULARY).count() == 0


def test_archives(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "", "small"), (4, "http://d", "small"), (5, "u", None),
            (6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (7, "http://e", big), (7, "http://e", big),
            (None, "http://f", "no id"), (8, "http://g", LONG), (9, "http://g", LONG)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = Counter((arc_key(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, arc_key(r.refers_to_id))
                  for r in arc.round_trip(pages).collect())
    wanted = Counter()
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        of = max(same) if len(data) >= 1000 and max(same) != key else None
        wanted[(key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if of else "response", of)] += 1
    assert got == wanted
    assert arc.round_trip(pages.limit(0)).count() == 0


def arc_key(record):
    found = record and re.fullmatch("<urn:x-arc:(.*):[0-9a-f]*>", record)[1]
    return int(found) if found else None


def test_arc_files(spark, folder):
    from tests.llm.test_methods import arc_file
    body = b"HTTP/1.0 200 OK\r\n\r\n" + b"z" * 1500
    for version in (1, 2):
        with open(f"{folder}/v{version}.arc", "wb") as f:
            f.write(arc_file(version, [(b"http://a/%d" % version, body), (b"dns:x", b"1.2.3.4"), (b"http://b", b"")]))
    records = arc.read_arc(spark, folder)
    assert records.count() == 6
    arc.write_warc(records, folder + "/warc", segment_bytes=10, file_segments=1)
    rows = arc.read_warc(spark, folder + "/warc").collect()
    assert Counter(r.record_type for r in rows) == {"response": 5, "revisit": 1}
    revisit = next(r for r in rows if r.record_type == "revisit")
    whole = next(r for r in rows if r.record_id == revisit.refers_to_id)
    assert whole.payload_digest == revisit.payload_digest == hashlib.sha1(b"z" * 1500).hexdigest()



def test_arc_files_of_any_bytes(spark, folder):
    """Images, Latin-1 pages and gzip members: blocks come back byte by byte."""
    import gzip

    from tests.llm.test_methods import arc_file
    image, page = bytes(range(256)) * 8, "HTTP/1.0 200 OK\r\n\r\ncaf\xe9 \r\n\r\n".encode("latin-1") + b"\xff" * 1200
    with open(f"{folder}/a.arc", "wb") as f:
        f.write(arc_file(1, [(b"http://a/i", image), (b"http://a/p", page)]))
    with open(f"{folder}/b.arc.gz", "wb") as f:
        whole = arc_file(2, [(b"http://b/i", image)])
        f.write(gzip.compress(whole[:200]) + gzip.compress(whole[200:]))
    arc.write_warc(arc.read_arc(spark, folder), folder + "/warc")
    blocks = [b for r in spark.read.format("binaryFile").load(folder + "/warc").collect() for b in arc.parse_warc(r.content)]
    assert Counter(b for _, b in blocks) == Counter([image, b"", page])
    rows = arc.read_warc(spark, folder + "/warc").collect()
    assert Counter((r.record_type, r.payload_digest) for r in rows) == Counter([
        ("response", hashlib.sha1(image).hexdigest()), ("revisit", hashlib.sha1(image).hexdigest()),
        ("response", hashlib.sha1(arc.payload_of(page)[1]).hexdigest())])


def test_near_duplicates(spark, documents, no_documents):
    rows = lshforest.near_duplicates(documents).collect()
    assert len(rows) == len(DOCUMENTS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[i].class_id for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)] == [1, 1, 3, 4, 5, 5, 9, 10, 11]
    assert (got[1].n_links, got[5].n_links, got[10].n_links, got[3].n_links) == (1, 1, 1, 0)
    assert got[8].class_id == 7  # long texts that differ in the last word
    kept = lshforest.keep_one(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 7, 9, 10, 10, 11, None, None])
    assert lshforest.near_duplicates(no_documents).count() == lshforest.keep_one(no_documents).count() == 0


def test_near_duplicates_against_brute_force(spark):
    import random

    from tests.llm.test_methods import _grams
    rng = random.Random(8)
    texts = []
    for base in range(6):
        words = [f"b{base}w{rng.randrange(300)}" for _ in range(70)]
        for _ in range(70):
            w = list(words)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(70)] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [" ".join(f"solo{i}w{j}" for j in range(30)) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [_grams(t) for t in texts]
    n = len(sets)
    near = [[j for j in range(n) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
    old = lshforest.BLOCK_DOCS, lshforest.TILE
    lshforest.BLOCK_DOCS, lshforest.TILE = 20, 7  # several blocks in a home, several tiles in a block
    try:
        rows = lshforest.near_duplicates(df).collect()
    finally:
        lshforest.BLOCK_DOCS, lshforest.TILE = old
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows} == {i: (len(near[i]), label[i]) for i in range(n)}


def test_sorted_tries_keep_what_shares_a_prefix(spark):
    import random
    rng = random.Random(4)
    paths = [[int.from_bytes(bytes(rng.choice([0, 7, 255]) for _ in range(8)), "big", signed=True) for _ in range(2)]
             for _ in range(300)] + [[5, -5]] * 40
    df = spark.createDataFrame(list(enumerate(paths)), "id bigint, paths array<bigint>").repartition(5)
    got = {(r.tree, r.id): r.reach for r in lshforest._sorted_tries(df, 4).collect()}
    for tree in (0, 1):
        keys = [p[tree].to_bytes(8, "big", signed=True) for p in paths]
        for i, mine in enumerate(keys):
            most = max(len(os.path.commonprefix([mine, k])) for j, k in enumerate(keys) if j != i)
            assert got.get((tree, i), 0) >= (most if most >= 4 else 0)
    depths = lshforest._measured_depths(lshforest._sorted_tries(df, 4), 0.8, 2, 4, 0.5)
    assert 1 - (1 - 0.8 ** depths[0]) * (1 - 0.8 ** depths[1]) >= 0.5


def test_chained_documents_link_only_where_they_are_near(spark):
    # every text shares half of its words with the next one: candidates of chance, no links
    from tests.llm.test_methods import _grams
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[i * 12:i * 12 + 60]) for i in range(120)]
    texts += [" ".join(words[i * 12:i * 12 + 60] + ["end"]) for i in range(0, 120, 3)]
    sets = [_grams(t) for t in texts]
    near = [sum(1 for j, b in enumerate(sets) if j != i and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    old, lshforest.BLOCK_DOCS = lshforest.BLOCK_DOCS, 3
    try:
        assert {r.doc_id: r.n_links for r in lshforest.near_duplicates(df).collect()} == dict(enumerate(near))
    finally:
        lshforest.BLOCK_DOCS = old


def test_texts_of_one_id_are_judged_one_by_one(spark):
    base = {b: [f"{b}{i}" for i in range(60)] for b in "abc"}

    def text(b, at=None):
        return " ".join("other" if i == at else w for i, w in enumerate(base[b]))

    rows = [(7, text("a")), (7, text("b")), (7, "a text of its own"), (1, text("a", 20)), (2, text("b", 30)), (7, text("b", 5)),
            (3, text("c")), (3, text("c", 9))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id, r.text_id, r.n_links) for r in lshforest.near_duplicates(df).collect())
    assert got == Counter([(7, 1, 7, 1), (7, 2, 7, 2), (7, 7, 7, 0), (1, 1, 1, 1), (2, 2, 2, 1), (7, 2, 7, 1), (3, 3, 3, 1),
                           (3, 3, 3, 1)])
    assert Counter(map(tuple, lshforest.keep_one(df).collect())) == Counter(rows[2:5] + rows[6:])


def test_embeddings_without_or_with_one_id(spark):
    near, far = [[1.0, 0.01 * i, 0.0] for i in range(4)], [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]]
    rows = [(None, near[0]), (5, near[1]), (9, near[2]), (None, near[3]), (9, far[0]), (None, far[1]), (None, far[2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int")
    for block, pivots in ((2048, 2048), (2, 2)):
        got = covertree.near_duplicates(df, block=block, pivots=pivots).collect()
        assert Counter(map(tuple, got)) == Counter([
            (None, 3, 5, False), (5, 3, 5, True), (9, 3, 5, False), (None, 3, 5, False), (9, 0, 9, True),
            (None, 1, None, True), (None, 1, None, True)])


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.06 * rng.normal(size=8)).tolist(), 1 + i % 2) for i in range(120)]
    rows += [(200 + i, rng.normal(size=8).tolist(), 1) for i in range(80)]
    rows += [(300 + i, rows[0][1], 1) for i in range(40)]  # equal vectors
    rows += [(400, [c * 1e200 for c in rows[0][1]], 1), (401, [c * 1e-200 for c in rows[0][1]], 1)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [1.0, None], 1), (504, [float("nan")] * 8, 1),
           (505, [float("inf")] + [0.0] * 7, 1), (506, rows[0][1], None), (507, rows[0][1][:4], 1), (None, None, None),
           (300, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    df = with_clashes(df)
    good = rows + [odd[-1]]
    x = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tag = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.98) & (tag[:, None] == tag[None])
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in good])
    label = ids.copy()
    for _ in range(len(good)):
        label = np.array([min(label[i], label[link[i]].min() if link[i].any() else label[i]) for i in range(len(good))])
    for block, pivots in ((2048, 2048), (16, 8)):
        got = covertree.near_duplicates(df, block=block, pivots=pivots).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(
            [(int(i), int(k.sum()), int(c)) for i, k, c in zip(ids, link, label, strict=True)]
            + [(r[0], 0, r[0]) for r in odd[:-1]])
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 400)]
    edges = spark.createDataFrame(path + star + [(500, 499), (499, 500), (7, 7), (700, 700)], "u bigint, v bigint")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, 499: 499, 500: 499}
    assert components(edges.limit(0)).count() == 0


def test_classifiers(documents, no_documents, labels):
    for module in (crf, factorisation):
        rows = module.classify(documents, labels).collect()
        assert len(rows) == len(DOCUMENTS)
        assert all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
        assert module.classify(no_documents, labels).count() == 0
        none = module.classify(documents, labels.limit(0)).collect()
        assert len(none) == len(DOCUMENTS) and {r.score for r in none} == {0.0}
    scored = crf.score(documents, crf.fit(documents, labels))
    assert scored.select("row.*").columns == documents.columns


def test_sample_takes_texts_of_all_lengths(spark):
    from tillworks.llm.sample import held_out, labelled_sample
    texts = {i: f"{i} " + ("long " * 3_000 if i % 2 else "short") for i in range(200)} | {i: "" for i in range(200, 400)}
    texts[400] = texts[399] = "same"
    docs = spark.createDataFrame(list(texts.items()) + [(1, "another text of 1"), (2, texts[2])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(420)] + [(None, 1)], "doc_id bigint, toxic int")
    learned = {r.doc_id for r in labels.where(~held_out()).collect()}
    wanted = {(texts[i], i % 2) for i in learned if texts.get(i)} | ({("another text of 1", 1)} if 1 in learned else set())
    got = labelled_sample(docs, labels, "toxic", {0: 1_000, 1: 1_000}, 20_000)
    assert Counter(zip(got["text"], got["label"], strict=True)) == Counter(wanted)
    # empty texts and ids without text do not use up the number; the bytes bound whole texts, the last one passes it
    got = labelled_sample(docs, labels, "toxic", {0: 50, 1: 40}, 10_000)
    sizes = [len(t) for t in got["text"][got["label"] == 1]]
    assert (got["label"] == 0).sum() == 50
    assert sum(sizes) >= 400_000 > sum(sizes) - max(sizes)


def test_chain_is_trained_in_a_task(spark, monkeypatch):
    import pyarrow as pa
    from tests.llm.test_methods import toxic_sample
    from tillworks.llm.sample import label_share, labelled_sample
    sample = toxic_sample(800)
    docs = spark.createDataFrame([(i, t.title() + " É") for i, t in enumerate(sample["text"])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(sample["label"])], "doc_id bigint, toxic int")
    here = labelled_sample(docs, labels, "toxic", crf.SAMPLE, crf.SAMPLE_BYTES)
    here["text"] = crf.folded(pa.array(here["text"], pa.string())).to_pandas()
    wanted = crf.train(here, label_share(labels, "toxic"))
    monkeypatch.setattr(crf, "train", None)  # the driver does not train, so it needs no texts
    got = crf.fit(docs, labels)
    assert len(wanted.features) > 200 and wanted.constant is None
    for name in ("features", "weights", "bias", "start", "moves", "document", "constant"):
        a, b = getattr(got, name), getattr(wanted, name)
        assert type(a) is type(b) and (a == b if a is None or isinstance(a, float) else (
            a.dtype == b.dtype and a.shape == b.shape and (a == b).all())), name


def test_constant_is_the_share_of_all_labels(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else f"plain {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 1 - i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    for module in (crf, factorisation):
        scores = {r.score for r in module.classify(docs, labels).collect()}
        assert len(scores) == 1 and 0.3 < scores.pop() < 0.7


def test_spans_are_code_points(spark):
    from tests.llm.test_methods import toxic_sample
    model = crf.train(toxic_sample())
    df = spark.createDataFrame([(1, "𝄞é VILEST, abcd")], "doc_id bigint, text string")
    r = crf.score(df, model).first()
    assert [(s.start, s.end) for s in r.spans] == [(3, 9)]


def test_stages(spark, documents, no_documents, labels, folder):
    labels.write.parquet(f"{folder}/labels.parquet")
    for docs in (documents, no_documents):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns, name
            out.collect()
    assert set(CLASHES) <= set(documents.columns)
