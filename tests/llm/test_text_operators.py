"""Tokens, counts, scores and quality against plain Python versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lm_score, quality
from ledgerloom.llm.bpe import Vocabulary, encode_documents
from ledgerloom.llm.common import read, tokenizer_file
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.token_counts import UnigramCounter, read_pieces, token_counts
from tests.llm.frames import documents, stored

FOLDER = "/root/testdata/sf0.001"
BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return stored(documents(spark), tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def random_texts(n=400):
    rng = random.Random(5)
    letters = "ab cé\n  \t's12.#<|endoftext|> 漢\u0085 ß'll▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_bpe_equals_library(library):
    texts = [*random_texts(), "x" * 30_000, "ab" * 2_000, " " * 500, "", "<|endoftext|><|endoftext|> a"]
    vocab = Vocabulary(BPE)
    for text, packed in zip(texts, vocab.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(packed).cast("I")) == ids
        assert vocab.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_lower_rank_comes_first_inside_a_word():
    """A merge that brings up a lower rank must wait for it before its next place."""
    vocab = Vocabulary(BPE)
    a, b, c, abc, x = (vocab.first[i] for i in b"abcde")
    made = max(i for _, i in vocab.merges.values()) + 1
    vocab.merges = {(a, b): (50, made), (made, a): (30, made + 1)}
    vocab.bytes += [b""] * 10
    packed = vocab.encode_words(["abab"])["abab"]
    assert list(memoryview(packed).cast("I")) == [made + 1, b]


def test_bpe_frame(spark, docs, library):
    rows = encode_documents(docs, BPE).collect()
    want = documents(spark).collect()
    assert len(rows) == len(want)
    told = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    for w in want:
        ids = library.encode(w.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        told[(w.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((w.text or "").encode()).hexdigest())] -= 1
    assert not +told and not -told
    assert encode_documents(docs.limit(0), BPE).count() == 0


def test_counts_equal_library(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = read_pieces(PIECES)
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [*random_texts(), "", " ", "▁", "<s> <unk>", "y" * 5_000]
    assert UnigramCounter(pieces).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = {(r.doc_id, r.n_tokens) for r in token_counts(docs, PIECES).collect()}
    assert {(1, 0), (2, 0)} <= rows
    assert token_counts(docs.limit(0), PIECES).count() == 0


def test_counts_tie_keeps_the_longest_last_piece():
    c = UnigramCounter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0)])
    assert c.count("ab") == 1  # equal scores: one piece of two characters stays
    assert c.count("é") == 2  # unknown: its bytes


def words_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), "\n"]


def brute_scores(rows):
    """Every number of the contract, and the automaton's weight token by token."""
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for i, (d, _) in enumerate(rows)}
    texts = [words_of(t) for _, t in rows]
    learnt = [t for i, t in enumerate(texts) if not held[i]]
    c = Counter(itertools.chain.from_iterable(learnt))
    pairs = Counter(p for t in learnt for p in zip(["\x00", *t], t, strict=False))
    triples = Counter(p for t in learnt for p in zip(["\x00", *t], t, t[1:], strict=False))
    n, v, starts = sum(c.values()), len(c), len(learnt)
    once = lambda x, k: sum(1 for y in x.values() if y == k)
    share = lambda x: min(0.999, once(x, 1) / (once(x, 1) + 2 * once(x, 2))) if once(x, 1) and once(x, 2) else 0.5
    d1, d2, d3 = share(c), share(pairs), share(triples)

    def growth(counts, different):
        bins = {}
        for k in counts.values():
            b = bins.setdefault(math.floor(math.log2(k) * 8), [0, 0])
            b[0] += 1
            b[1] += k
        return lm_score.Weights._growth([(m, t / m) for m, t in bins.values()], different)

    g2, g3 = growth(c, len(pairs)), growth(pairs, len(triples))

    def one(w):
        return max(c[w] - d1, 1e-9) / n if c[w] else d1 * v / n

    def two(h, w):
        count = starts if h == "\x00" else c[h]
        fail = d2 * count ** (g2 - 1) if count else 1.0
        return (1 - fail) * pairs[h, w] / max(count, 1) + fail * one(w)

    def three(u, h, w):
        count = pairs[u, h]
        fail = d3 * count ** (g3 - 1) if count else 1.0
        return (1 - fail) * triples[u, h, w] / max(count, 1) + fail * two(h, w)

    out = []
    for i, (d, _) in enumerate(rows):
        t = ["\x00", *texts[i]]
        score = math.log10(two(*t[:2]))
        score += sum(math.log10(three(*t[k : k + 3])) for k in range(len(t) - 2))
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in texts[i])
        out.append((d, held[i], len(texts[i]), sum(c[w] > 0 for w in texts[i]), n, base, score))
    return out


def compare_scores(rows, found):
    key = lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 6)) for x in r)
    want, got = sorted(brute_scores(rows), key=key), sorted(map(tuple, found), key=key)
    assert len(want) == len(got)
    for a, b in zip(want, got, strict=True):
        assert a[:5] == b[:5]
        assert b[5:] == pytest.approx(a[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block_chars", [1, 50_000, 10**7])
def test_scores_are_the_same_for_any_blocks(spark, docs, block_chars):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    compare_scores(rows, lm_score.score_documents(docs, block_chars=block_chars).collect())


def test_scores_of_the_query(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, FOLDER, "documents").collect()]
    found = QUERIES["op4_lm_score"](spark, FOLDER).collect()
    compare_scores(rows, found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_without_training_rows(spark, tmp_path):
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = stored(spark.createDataFrame([(alone, "some text")], "doc_id long, text string"), tmp_path / "a")
    (row,) = lm_score.score_documents(df).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)
    assert lm_score.score_documents(df.limit(0)).count() == 0


def test_root_and_states_are_distributions():
    facts = [(1, "types", 3, 7), (1, "once", 1, 0), (1, "twice", 1, 0), (1, "bin0", 1, 1), (1, "bin8", 1, 2), (1, "bin16", 1, 4),
             (2, "types", 4, 7), (2, "once", 2, 0), (2, "twice", 1, 0), (2, "bin0", 2, 2), (2, "bin8", 1, 2), (2, "bin12", 1, 3),
             (3, "types", 5, 6), (3, "once", 4, 0), (3, "twice", 1, 0)]
    w = lm_score.Weights(facts)
    root = w.root(np.array([1, 2, 4, 0]))
    assert root.sum() == pytest.approx(1.0)
    fail = w.failure(lm_score.PAIRS, np.array([4]))[0]
    shorter = (1 - fail) * np.array([1, 1, 2, 0]) / 4 + fail * root
    assert shorter.sum() == pytest.approx(1.0)
    fail = w.failure(lm_score.TRIPLES, np.array([3]))[0]
    assert ((1 - fail) * np.array([1, 0, 2, 0]) / 3 + fail * shorter).sum() == pytest.approx(1.0)


def test_the_walk_carries_its_state_over_slices(monkeypatch):
    """Slices of one token and of all tokens take the same arcs, failure arcs included."""
    t = lm_score.BlockTokens(["a b c a b d", "", "b c x a b c"])
    rng = np.random.default_rng(1)
    words = np.array([3, 0, *rng.integers(1, 5, len(t.hashes) - 2)])
    counts = {1: words, 2: rng.integers(0, 2, len(t.pair_hashes)), 3: np.zeros(len(t.triple_hashes), np.int64)}
    counts[3] += (counts[2][t.triple_history] > 0) & (counts[2][t.triple_pair] > 0)
    w = lm_score.Weights([(1, "types", 5, int(words.sum())), (2, "types", 4, 9), (1, "bin0", 5, 5), (2, "bin0", 4, 4)])
    whole = lm_score.Automaton(t, counts, w).walk()
    monkeypatch.setattr(lm_score, "WALK_TOKENS", 1)
    assert lm_score.Automaton(t, counts, w).walk() == whole
    assert len(whole) == 3


def test_factorisation_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    size = 50 + quality.STATS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros(quality.STATS), np.ones(quality.STATS))
    ids, stats = [np.array([1, 5, 9], np.int32), np.array([], np.int32)], rng.normal(size=(2, quality.STATS))
    index, value, starts = m.inputs(ids, stats)
    got, _ = m.raw(index, value, starts)
    for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(index)], strict=True)):
        y = m.bias + sum(m.linear[index[i]] * value[i] for i in range(s, e))
        y += sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i in range(s, e) for j in range(i + 1, e))
        assert got[k] == pytest.approx(y)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in read(spark, folder, "labels").collect()}
    rows = QUERIES["op5_quality"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame(
        [(3, 1), (3, 0), (8, 0), (9, 0), (4, None), (None, 1), (99, 1), (6, 1)], "doc_id long, quality int"
    )
    machine = quality.train(docs, labels)
    rows = quality.score(docs, machine).collect()
    assert len(rows) == documents(spark).count()
    assert quality.good_rows(docs, machine).columns == docs.columns
    assert quality.score(docs.limit(0), machine).count() == 0
    untaught = quality.train(docs.limit(0), labels)
    assert {r.predicted for r in quality.score(docs, untaught).collect()} == {1}
