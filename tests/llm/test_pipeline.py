"""run() against the same stages written plainly, on planted documents."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_edges import folded
from tests.llm.test_methods import _grams, toxic_sample

WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Labelled documents to learn from, clean ones with exact and near copies, toxic ones without label."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    sample = toxic_sample(800)
    rng = random.Random(4)
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(sample["text"])]
    labels = [(i, 1, int(y)) for i, y in enumerate(sample["label"])]
    clean = [" ".join(f"Doc{i}word{rng.randrange(90)}" for _ in range(80)) for i in range(60)]
    at = 10_000
    for i, text in enumerate(clean):
        docs.append((at + i, text, "en", "s0" if i % 3 else None, len(text)))
    for i, text in enumerate(clean[:20]):
        docs.append((at + 100 + i, text.upper() if i % 2 else text, "en", "s1", len(text)))  # exact copies
    near = {}
    for i, text in enumerate(clean[20:40]):
        w = text.split()
        w[40] = "changed"
        near[at + 200 + i] = at + 20 + i
        docs.append((at + 200 + i, " ".join(w), "en", "s2", len(text)))
    toxic = [at + 300 + i for i in range(10)]
    docs += [(k, f"abcd efgh rotter {k} klmn vilest", "en", "s3", 30) for k in toxic]
    docs += [(at + 400, None, "en", "s0", 0), (at + 401, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, near, toxic


def test_run(spark, corpus):
    folder, docs, near, toxic = corpus
    stages, current = [], spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, folder).cache()
        stages.append(current.collect())
    clean, unique, apart, mixed, packed = stages

    ids = {r.doc_id for r in clean}
    assert not ids & set(toxic)
    assert {d[0] for d in docs if d[0] >= 10_000} - set(toxic) <= ids
    wrong = sum((r[0] in ids) == bool(re.search("vilest|rotter|grubby|zorq", r[1] or "")) for r in docs)
    assert wrong <= 0.02 * len(docs)

    groups = {}
    for r in clean:
        groups.setdefault(folded(r.text), []).append(r.doc_id)
    assert {r.doc_id for r in unique} == {max(g) for g in groups.values()}

    texts = {r.doc_id: _grams((r.text or "").lower()) for r in unique}
    gone = {b for a in texts for b in texts if a < b and texts[a] and
            len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])}
    assert {r.doc_id for r in apart} == set(texts) - gone
    assert set(near) <= gone

    size = {r.doc_id: len(re.findall(WORDS, r.text or "")) for r in apart}
    sources = {}
    for r in apart:
        sources.setdefault(r.source, []).append(r.doc_id)
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    whole = {s: sum(size[d] for d in sources[s]) for s in names}
    while True:
        left = (total - sum(capped.values())) / sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and weight[s] * left > 3 * whole[s]]
        if not over:
            break
        capped.update({s: 3 * whole[s] for s in over})
    copies = Counter()
    for s in names:
        budget = math.floor(capped.get(s, weight[s] * left))
        epochs, rest = divmod(budget, whole[s]) if whole[s] else (0, 0)
        start = 0
        for d in sorted(sources[s], key=lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()):
            copies[d] += epochs + (2 * start + size[d] <= 2 * rest)
            start += size[d]
    got = Counter(r.doc_id for r in mixed)
    assert {d: n for d, n in got.items() if size[d]} == {d: n for d, n in copies.items() if n and size[d]}

    placed = Counter()
    bins = Counter()
    for r in packed:
        placed[r.doc_id] += r.size
        bins[r.block, r.bin, r.capacity] += r.size
    assert placed == Counter({d: n * (size[d] + 1) for d, n in got.items()})
    assert all(used <= capacity for (_, _, capacity), used in bins.items())

    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.size) for r in final) == Counter((r.doc_id, r.size) for r in packed)
