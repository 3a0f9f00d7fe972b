"""The pipeline against a version that looks at every pair and every place."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import decontaminate, quality
from ledgerloom.llm.common import read, tokenizer_file
from tests.llm.frames import documents, stored

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_distance(item, text):
    """Row by row, all columns of the edit table at once but for insertions."""
    a = np.array([ord(c) for c in item])
    row = np.arange(len(a) + 1)
    best = row[-1]
    steps = np.arange(len(a) + 1)
    for c in text:
        moved = np.minimum(row[1:] + 1, row[:-1] + (a != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[0], moved]) - steps) + steps
        best = min(best, row[-1])
    return best


def brute(rows, items, machine):
    """Rows are (doc_id, text, n_chars) without repeated or null ids."""
    kept = []
    for d, t, n in rows:
        ids, stats = quality.features(t or "", n, machine.buckets)
        if machine.scores([ids], np.array([stats]))[0] >= 0.3:
            kept.append((d, t or ""))
    last = {}
    for d, t in kept:
        last[t] = max(d, last.get(t, d))
    kept = [(d, t) for d, t in kept if last[t] == d]
    sets = [shingles(t) for _, t in kept]
    up = list(range(len(kept)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, t) in enumerate(kept):
        groups[root(i)].append((d, t))
    kept = [min(g) for g in groups.values()]
    items = [x for _, t in items if (x := decontaminate.normal(t or ""))]
    return [(d, t) for d, t in kept if not any(least_distance(x, decontaminate.normal(t)) <= int(0.08 * len(x)) for x in items)]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.n_chars) for r in read(spark, FOLDER, "documents").collect()]


def test_pipeline_equals_brute_force(spark, rows):
    from tokenizers import Tokenizer

    docs = read(spark, FOLDER, "documents")
    machine = quality.train(docs, read(spark, FOLDER, "labels"))
    items = [(r.item_id, r.text) for r in read(spark, FOLDER, "benchmark").collect()]
    # edit distances at all places of all texts take minutes: exact hits here, edited ones below
    short = brute(rows, [], machine)
    exact = [x for _, t in items if (x := decontaminate.normal(t))]
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {}
    for d, t in short:
        if not any(x in decontaminate.normal(t) for x in exact):
            raw = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            want[d] = (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) <= set(want)
    texts = dict(short)
    for d in set(want) - set(got):  # found with edits
        assert any(least_distance(x, decontaminate.normal(texts[d])) <= int(0.08 * len(x)) for x in exact)
    assert {d: want[d] for d in got} == got


def test_stages_on_awkward_rows(spark, tmp_path):
    """Every stage keeps the columns of documents, and no stage fails on nulls, ties or empty tables."""
    docs = stored(documents(spark), tmp_path / "docs")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= n, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, FOLDER).count() == n


def test_copies_edited_copies_and_items_go_and_clean_rows_stay(spark, tmp_path):
    texts = [t for r in read(spark, FOLDER, "documents").collect() if 100 < len((t := r.text).split()) < 300]
    item = read(spark, FOLDER, "benchmark").first().text
    clean = brute([(i, t, len(t)) for i, t in enumerate(texts[:20])], [(0, item)], quality.fit([], np.zeros((0, quality.STATS)), np.zeros(0)))
    (d, base), *_ = clean
    words = base.split(" ")
    rows = [(i, t) for i, t in clean]
    rows += [(1000, base), (1001, " ".join([*words[:50], "changed", *words[51:]])), (1002, f"{texts[30]} {item.upper()} end")]
    df = stored(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), tmp_path / "d")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = stage(spark, df, FOLDER)
    got = Counter(r.doc_id for r in df.collect())
    # the larger id of equal texts stays, then the smaller id of near ones
    assert {x: got[x] for x in (d, 1000, 1001, 1002)} == {d: 0, 1000: 1, 1001: 0, 1002: 0}
    assert all(got[i] == 1 for i, _ in clean if i != d)
