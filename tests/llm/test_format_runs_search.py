"""Chat formats, periodic runs and ranked search against plain Python versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import lexical_search
from ledgerloom.llm.chat_format import TEMPLATE, format_conversations, pieces, read_back, turns
from ledgerloom.llm.chat_template import BEGIN, END, For, If, TemplateError, Text, compiled, folded_block, parse, unescape
from ledgerloom.llm.common import read
from ledgerloom.llm.lexical_search import top_k
from ledgerloom.llm.periodic_runs import periodic_runs, runs
from ledgerloom.llm.queries import QUERIES, planted
from tests.llm.frames import documents, stored

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return stored(documents(spark), tmp_path_factory.mktemp("docs"))


def rendered(source, **names):
    return "".join({BEGIN: "<", END: ">"}.get(p, p) if not isinstance(p, str) else p for p in compiled(source)(names))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{{ 1 + 2 }}b{{ 'x' ~ 3 }}", "a3bx3"),
        ("{{ m.role }}|{{ m['text'] }}|{{ m.missing }}|{{ l[0] }}{{ l[9] }}", "user|hi||5"),
        ("{% for x in l %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "15,26"),
        ("{% for x in l -%}\n {{ x }} \n{%- endfor %}.", "56."),
        ("{% if m.role == 'user' and 5 in l %}a{% elif true %}b{% else %}c{% endif %}", "a"),
        ("{% if none or '' %}a{% elif 'z' not in 'abc' %}b{% endif %}", "b"),
        ("{% set x = m.text | upper %}{{ x }}{{ x | length }}{{ y | default('-') }}", "HI2-"),
        ("{% generation %}{{ m.text }}{% endgeneration %}{# no #}!", "<hi>!"),
        ("{{ 'a' if l[0] > 4 else 'b' }}{{ m | tojson }}", 'a{"role": "user", "text": "hi"}'),
        ("{{ ' p\\n' | trim }}{{ 'a.b' | replace('.', '-') }}{{ -3 }}{{ not 0 }}", "pa-b-3true"),
        ("{% for x in [] %}a{% endfor %}", ""),
    ],
)
def test_template_language(source, want):
    assert rendered(source, m={"role": "user", "text": "hi"}, l=[5, 6]) == want


@pytest.mark.parametrize(
    "source",
    [
        "{{ _x }}", "{{ m.__class__ }}", "{{ f() }}", "{{ m | eval }}", "{% import os %}", "{{ 1 ", "{% if a %}", "{% endfor %}",
        "{{ a b }}", "{{ 'a' + 1 }}", "{{ 1 < 'a' }}", "{{ 'abc'.x }}", "{% for x in 'abc' %}{% endfor %}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}",
        "{{ m }}", "{{ $ }}", "{% if a %}" * 99,
    ],
)
def test_template_refuses(source):
    with pytest.raises(TemplateError):
        rendered(source, m={}, a=1)


def test_template_folds_constants():
    assert folded_block(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{{ 2 + 3 }}{% else %}d{% endif %}{% if false %}e{% endif %}")) == (Text("aBc5"),)
    (loop,) = folded_block(parse("{% for x in y %}{% if x %}a{{ 'b' }}{% elif 0 %}c{% endif %}{% endfor %}"))
    assert isinstance(loop, For) and isinstance(loop.block[0], If) and len(loop.block[0].cases) == 1
    assert loop.block[0].cases[0][1] == (Text("ab"),)


awkward = st.text(alphabet="\\#</turn>: \n漢a", max_size=30)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", ""]) | awkward, awkward), max_size=6), st.integers(1, 60))
def test_format_is_reversible(said, most):
    made = list(pieces(TEMPLATE, ({"role": r, "text": t} for r, t in said), most))
    assert list(turns(t for t, _ in made)) == said
    assert "".join(unescape(t[a:b]) for t, spans in made for a, b in spans) == "".join(t for r, t in said if r == "assistant")
    assert "".join(t for t, _ in made) == "".join(t for t, _ in pieces(TEMPLATE, ({"role": r, "text": t} for r, t in said)))


def test_format_streams_a_long_conversation():
    """A conversation of any length passes through with one turn of look-ahead."""
    taken = itertools.count()
    said = ({"role": "user", "text": f"t{next(taken)}"} for _ in range(100_000))
    first = next(pieces(TEMPLATE, said, 50))
    assert len(first[0]) < 100 and next(taken) < 10


def plain_conversation(rows):
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
    said = [(r or "", t or "") for _, r, t in rows]
    learned = "".join(t for r, t in said if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in said)
    return len(said), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_conversations(spark, tmp_path):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "\\</turn>\n"),
        (3, 0, "assistant", ""), (None, 5, "user", "x"), (None, 5, "user", "x"), (4, 0, "assistant", "é#### " * 50_000),
        (4, 0, "a: ", "tie"), (5, -1, "user", "漢\r\n"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("piece", "spans", "loop"):
        frame = frame.withColumn(name, frame["role"])
    frame.write.parquet(str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    want = {i: plain_conversation([r[1:] for r in rows if r[0] == i]) for i in {r[0] for r in rows}}
    for most in (10, 1_000_000):
        made = format_conversations(table, most_chars=most)
        for got in (read_back(made, ordered=True), read_back(made)):
            assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == want
    assert read_back(format_conversations(table.limit(0))).count() == 0
    total = made.selectExpr("sum(length(text))").first()[0]
    assert read_back(made).selectExpr("sum(formatted_chars)").first()[0] == total
    with pytest.raises(TemplateError):
        format_conversations(table, template="{{ os.system('x') }}")


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rng):
    kind, n = rng.randrange(5), rng.randrange(160)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(rng.randrange(1, 4)) for _ in range(n)]
    if kind == 2:  # stretches of short periods side by side
        return list(itertools.chain.from_iterable([rng.randrange(2) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 9) for _ in range(n // 12)))
    if kind == 3:  # a long period with some words changed
        v = [rng.randrange(3) for _ in range(rng.randrange(1, 30))] * rng.randrange(2, 5)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = rng.randrange(3)
        return v * rng.randrange(1, 4)
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [repeating(rng) for _ in range(rng.randrange(1, 12))]
        least = rng.choice([12, 12, 12, 4, 5, 7, 8, 20, 33])
        symbols = np.array([x + 1000 * i for i, t in enumerate(texts) for x in t], np.int64)
        offsets = np.cumsum([0, *map(len, texts)])
        want = [[s + int(o), n, q] for t, o in zip(texts, offsets, strict=False) for s, n, q in plain_runs(t, least)]
        assert runs(symbols, np.array([len(t) for t in texts]), least).tolist() == want


def test_runs_of_one_word_repeated():
    """Progressions keep a text of one word cheap; its only run is found."""
    assert runs(np.zeros(100_000, np.int64), np.array([100_000])).tolist() == [[0, 100_000, 1]]
    word = np.tile(np.arange(700), 90)
    assert runs(word, np.array([len(word)])).tolist() == [[0, len(word), 700]]


def plain_row(doc_id, text, places):
    w = (text or "").encode().split()
    place = places(len(w), doc_id) if places else None
    w = w if place is None else [w[i] for i in place]
    found = plain_runs(w) if len(w) < 3000 else [(0, len(w), 1)] if len(set(w)) == 1 else []
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lost = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in lost)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(w), len(found), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode(), [list(r) for r in found])


def test_runs_frame(spark, docs):
    got = Counter(map(repr, map(tuple, periodic_runs(docs).collect())))
    assert got == Counter(repr(plain_row(r.doc_id, r.text, None)) for r in documents(spark).collect())
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="four"):
        periodic_runs(docs, least=3)


def test_runs_query(spark):
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, FOLDER).collect()))
    rows = read(spark, FOLDER, "documents").select("doc_id", "text").collect()
    assert got == sorted(plain_row(*r, planted)[:9] for r in rows)
    assert sum(r[2] for r in got) >= len(rows) // 20


def plain_search(docs, items, k=10):
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(words.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(words.findall((text or "").translate(LOWER)))}
        scores = []
        for i, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("bucket", "share", "chars"), [(1024, 1 / 64, 2_000_000), (3, 0.3, 2_000_000), (7, 0.0, 60)])
def test_search_equals_brute_force(spark, docs, monkeypatch, bucket, share, chars):
    monkeypatch.setattr(lexical_search, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(lexical_search, "FIRST_SHARE", share)
    items = [(1, "one two"), (2, "LONG w1 w2 w39 w40"), (2, "one two"), (3, None), (4, "?? !"), (5, "x é 漢字 a b ll"), (None, "w1"), (6, "nowhere")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 2, 10):
        got = top_k(docs, frame, k, block_chars=chars).collect()
        assert Counter(map(tuple, got)) == plain_search([(r.doc_id, r.text) for r in documents(spark).collect()], items, k)
    assert top_k(docs.limit(0), frame).count() == 0
    assert top_k(docs, frame.limit(0)).count() == 0


def test_search_with_many_ties_and_one_common_text(spark, tmp_path):
    """A third of all rows are one text; buckets, thresholds and ranges cut through it."""
    rng = random.Random(3)
    rows = [(i, "hot passage of seven common words here") for i in range(0, 600, 2)]
    rows += [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(1, 60)))) for i in range(1, 1200, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    items = [(0, "hot passage"), (1, "w1 w2 w3 words"), (2, "w200 w1"), (3, " ".join(f"w{i}" for i in range(40)))]
    got = top_k(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_search(rows, items)


def test_search_query(spark):
    got = Counter(map(tuple, QUERIES["op13_lexical_search"](spark, FOLDER).collect()))
    docs, items = (read(spark, FOLDER, n) for n in ("documents", "benchmark"))
    assert got == plain_search(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())


def test_bounds_prune(spark):
    """With thresholds known, a bucket of short vectors is skipped and few rows are scored exactly."""
    queries = lexical_search.Queries([(0, "rare common")])
    weights = queries.weigh(np.array([2, 900]), 1000)
    import pyarrow as pa

    pack = lambda *x: np.array(x, "<u4").tobytes()
    rows = [(i, 0.0, 100, pack(1), pack(3)) for i in range(50)] + [(99, 0.0, 100, pack(0, 1), pack(1, 3))]
    names = ["doc_id", "norm", "m", "terms", "tfs"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    bucket = lexical_search.Bucket(batch, weights, queries)
    everything, scores = bucket.survivors(0, 2, 1)
    assert len(everything) == 51
    rows, best = bucket.survivors(0, 2, int(scores.max()))
    assert rows.tolist() == [50] and best.tolist() == [scores.max()]
    assert not len(bucket.survivors(0, 2, int(scores.max()) * 3)[0])
