"""Copies, near copies, repeated lines and benchmark items against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, exact_dedup, line_dedup, ngram_join
from ledgerloom.llm.common import read
from ledgerloom.llm.components import components
from ledgerloom.llm.queries import ORACLES, QUERIES
from ledgerloom.workload import check
from tests.llm.frames import documents, stored

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return stored(documents(spark), tmp_path_factory.mktemp("docs"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(check, "load", lambda: (QUERIES, ORACLES))
    told, _, _ = check.compare(spark, check.connect(FOLDER), FOLDER, name)
    assert told.startswith("ok"), told


# ------------------------------------------------------------------ exact copies


def test_exact_copies(spark, docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.text_sha256].append(r)
    words = " ".join(f"w{i}" for i in range(40))
    of = lambda t: found[hashlib.sha256(t.encode()).hexdigest()]
    assert {(r.doc_id, r.keep_id, r.kept) for r in of("")} == {(1, 2, False), (2, 2, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in of(words)} == {(3, 3, True), (None, 3, False)}
    assert sorted((r.doc_id, r.group_size, r.kept) for r in of(words + " x")) == [(4, 2, False), (4, 2, True)]
    assert all(sum(r.kept for r in g) == 1 for g in found.values())
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_rows_that_stay_keep_their_columns(spark, docs):
    stay = exact_dedup.without_copies(docs)
    assert stay.columns == docs.columns
    assert stay.count() == sum(r.kept for r in exact_dedup.exact_dedup(docs).collect())
    assert exact_dedup.without_copies(docs.limit(0)).count() == 0


def test_texts_with_one_digest_are_told_apart(spark, docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))
    stay = sorted(map(str, exact_dedup.without_copies(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(
        exact_dedup, "named", lambda rows: rows.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_digest", F.unhex(F.lit("00")))
    )
    got = sorted(map(str, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == want
    assert sorted(map(str, exact_dedup.without_copies(docs).select("doc_id", "text").collect())) == stay


# ------------------------------------------------------------------ repeated lines


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    low = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(low(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if not (len(held[key(x)]) >= 5 and max(held[key(x)]) != low(d))]
        out.append((d, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (3, 2), (7, 3)])
def test_lines(spark, tmp_path, batches, fan_in):
    rng = random.Random(batches)
    common = [f"This is the common line number {i} with enough letters" for i in range(4)] + ["É" * 40, "é" * 40, "short"]
    rows = [(None, common[0]), (7, None), (7, "")]
    for i in range(60):
        lines = [rng.choice([*common, f"own {i} " * 9, "  " + common[1].upper() + "\t"]) for _ in range(rng.randrange(8))]
        rows.append((rng.randrange(50), "\n".join(lines)))
    df = stored(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "d")
    got = line_dedup.line_dedup(df, batches=batches, fan_in=fan_in).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines(rows)


def test_lines_edges(docs):
    assert line_dedup.line_dedup(docs).count() == docs.count()
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ near copies


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    name = lambda g: min((d for d in g if d is not None), default=None)
    return sorted(str((d, len(sets[i]), name(least[root(i)]))) for i, (d, _) in enumerate(rows))


def near_rows(seed, groups=12, most=25):
    """Groups of texts that drift apart word by word, around the threshold, with common passages."""
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = []
    for g in range(groups):
        words = [f"g{g}x{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 40, 90, 200]))]
        for _ in range(rng.randrange(1, most)):
            if rng.random() < 0.5 and len(words) > 3:
                words = words[:]
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"n{rng.randrange(9)}"] * rng.randrange(3)
            text = " ".join(words) + (" " + passage if rng.random() < 0.3 else "")
            rows.append((len(rows) * 7 % 1009, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("seed", "frequent", "rounds"), [(1, 2, 0), (2, 2, 3), (3, 4, 1), (4, 32, 3), (5, 1, 2)])
def test_near_copies(spark, tmp_path, seed, frequent, rounds):
    rows = near_rows(seed)
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path / "d")
    got = ngram_join.near_duplicates(df, frequent=frequent, rounds=rounds, block_chars=5_000).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_components(rows)


def test_hub_that_fits_one_of_two_similar_texts(spark, tmp_path):
    """Texts 1 and 2 are similar and meet in the passage's entries alone; its hub, text 3, is too long for text 1."""
    some = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage, common, more, hub = some("p", 25), some("c", 54), some("m", 20), some("h", 105)
    rows = [(1, passage + common + some("x", 1)), (2, passage + common + more + some("y", 1)), (3, passage + hub)]
    rows += [(10 + i, common + more + hub + some(f"u{i}x", 400)) for i in range(5)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(stored(df, tmp_path / "d"), words=1).collect()}
    assert got == {d: 1 if d == 2 else d for d, _ in rows}


def shared_passages(seed, texts=90):
    """Texts of mixed lengths from passages that many of them hold, few of which are similar."""
    rng = random.Random(seed)
    passages = [[f"s{k}w{i}" for i in range(rng.choice([8, 20, 45]))] for k in range(14)]
    rows = []
    for d in range(texts):
        if rows and rng.random() < 0.3:
            words = rng.choice(rows)[1].split()
            at = rng.randrange(len(words))
            words[at:at] = [f"e{d}w{i}" for i in range(rng.randrange(1, 2 + len(words) // 4))]
        else:
            words = [w for p in rng.sample(passages, rng.randrange(1, 6)) for w in p]
            words += [f"o{d}w{i}" for i in range(rng.randrange(1 + len(words) // 4))]
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "frequent"), [(2, 4)])
def test_texts_of_shared_passages(spark, tmp_path, seed, frequent):
    rows = shared_passages(seed)
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path / "d")
    got = ngram_join.near_duplicates(df, frequent=frequent).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_components(rows)


def passage_texts(texts, passages, each):
    """Texts that hold ``each`` of the passages of 60 words and a short tail of their own."""
    rng = random.Random(texts)
    shared = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(passages)]
    tail = lambda n: " ".join(f"t{n}x{i}" for i in range(14))
    return [(n, " ".join([*(shared[k] for k in sorted(rng.sample(range(passages), each))), tail(n)])) for n in range(texts)]


@pytest.mark.parametrize("passages, each", [(1, 1), (12, 4)])
def test_pairs_met_on_shared_passages_do_not_grow_with_the_square(spark, tmp_path, monkeypatch, passages, each):
    real, frames = ngram_join.stored, {}

    def recorded(df, name):
        frames[name] = real(df, name)
        return frames[name]

    monkeypatch.setattr(ngram_join, "stored", recorded)
    met = {}
    for texts in (500, 1000, 2000):
        frames.clear()
        rows = passage_texts(texts, passages, each)
        df = stored(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / str(texts))
        got = ngram_join.near_duplicates(df).collect()
        if texts == 500:
            assert sorted(str(tuple(r)) for r in got) == brute_components(rows)
        open_rows, outside = frames.get("open-entries"), frames.get("tokens-outside-hubs")
        met[texts] = 0
        if open_rows is not None:
            small, large = ngram_join.contained((75, 100)), ngram_join.reaching((75, 100))
            per_entry = open_rows.groupBy("entry").agg(
                F.count_if(small).alias("a"), F.count_if(large).alias("b"), F.count_if(F.col("i").isNull()).alias("u"), F.count("*").alias("m")
            )
            per_token = outside.groupBy("hub", "token").count()
            met[texts] += per_entry.agg(F.sum(F.expr("a * b + u * m"))).first()[0] or 0
            met[texts] += per_token.agg(F.sum(F.expr("count * count"))).first()[0] or 0
    print(met)
    assert met[2000] <= 2.2 * max(met[1000], 500)


def test_near_copies_edges(spark, docs):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sorted(str(tuple(r)) for r in ngram_join.near_duplicates(docs).collect()) == brute_components(rows)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 6, 8, 9, 10, 11} <= {r.doc_id for r in kept.collect()}


def test_prefixes_share_an_entry_when_sets_are_similar():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in [2, 3, 4, 5, 7, 8, 12, 20, 50, 200, 700]:
        for _ in range(60):
            tokens = rng.integers(1, 2**63, n + 200, dtype=np.uint64)
            df = rng.integers(1, 8, n + 200)
            lost = ngram_join.spare(n, (75, 100))
            added = rng.integers(0, max(1, n - lost) // 3 + 1)
            x = np.arange(n)
            y = np.concatenate([rng.permutation(n)[: n - rng.integers(0, lost + 1)], n + np.arange(added)])
            both = len(np.intersect1d(x, y))
            if 100 * both < 75 * (len(x) + len(y) - both):
                continue
            entries = []
            for s in (x, y):
                order = s[np.lexsort((tokens[s], df[s]))]
                rare = int((df[order] < 4).sum())
                need = ngram_join.spare(len(s), (75, 100)) + 1
                entries.append(set(ngram_join.prefix_entries(tokens[order], rare, need, len(s), (75, 100)).tolist()))
            assert entries[0] & entries[1] or set(x) == set(y)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}


# ------------------------------------------------------------------ benchmark items


def least_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[:], 0
        for i, x in enumerate(item, 1):
            row[i] = min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (x != c))
        best = min(best, row[-1])
    return best


def test_items(spark, tmp_path):
    rng = random.Random(2)
    letters = "abcde "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(20, 120)))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "  "), (103, items[0][1].upper())]
    rows = [(None, items[0][1]), (1, None), (2, "")]
    for d in range(3, 60):
        _, item = rng.choice(items[:12])
        changed = list(item)
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = rng.choice(["", "x", " Y", "\n"])
            changed = changed or [""]
        rows.append((d, "noise " * rng.randrange(20) + "".join(changed) + " tail" * rng.randrange(9)))
    df = stored(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "d")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            item = decontaminate.normal(x or "")
            if item and (e := least_distance(item, decontaminate.normal(t or ""))) <= int(0.08 * len(item)):
                want.add((d, i, e))
    for block in (10, 10**6):
        got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(df, bench, block_chars=block).collect()}
        assert got == want
        clean = decontaminate.without_contaminated(df, bench, block_chars=block)
        hit = {d for d, _, _ in want}
        assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d) for d, _ in rows if d not in hit)
    assert len({e for _, _, e in want}) > 3
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_query_of_items(spark):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in read(spark, FOLDER, "benchmark").collect()]
    want = {(r.doc_id, i) for r in read(spark, FOLDER, "documents").collect() for i, x in items if x in decontaminate.normal(r.text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    assert want and want <= got


def test_buckets_of_counts_grow_with_the_text_of_a_partition(spark, tmp_path):
    """A bucket stays small where one partition holds much text; the sets do not depend on it."""
    texts = [(i, f"{'shared words of all the texts here ' * 3}own {i % 4} tail {i % 4} end") for i in range(40)]
    docs = stored(spark.createDataFrame([*texts, (40, None)], "doc_id long, text string").coalesce(1), tmp_path)
    chars = sum(len(t) for _, t in texts)
    assert ngram_join.bucket_count(docs) == 1 and ngram_join.bucket_count(docs, 100) == -(-chars // 100)
    assert ngram_join.bucket_count(docs.limit(0)) >= 1
    few, many = (
        ngram_join.document_sets(docs, ngram_join.WORDS, ngram_join.THRESHOLD, ngram_join.FREQUENT, 500, n) for n in (10**9, 100)
    )
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
