"""Near duplicates by an n-gram Jaccard join with token-combination prefixes.

The tokens of a text are its different word n-grams. All tokens have one order:
rare ones first, by the number of documents that hold them. A text of n tokens
can lose at most t = floor(n / 4) of them to a text with a Jaccard similarity of
0.75, so its prefix is extended until more than t tokens would have to be lost
before nothing of the prefix is shared:

* a rare token is indexed alone and counts one;
* frequent tokens fall into sub-classes and are indexed as pairs of the same
  sub-class; n of them count n - 1, since one may be shared without a pair.

A token that one document alone holds counts one as well but needs no index
entry; a text with more than t of them has no partner at all. The number of
sub-classes follows from a size level, and texts are indexed on their own level
and the next, so two similar texts share one. Candidates are verified on the
exact sets. Texts with equal sets are one node of the join.

Groups of candidates are linked through hubs first: every text of a group is
verified against the group's hub, and linked texts become one component. Only
pairs that are still in different components are then verified one by one, so a
large group of copies costs a few comparisons per text and no link between
components is missed (``open_pairs``).
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import slices
from ledgerloom.llm.common import scan_partitions, stored
from ledgerloom.llm.components import components
from ledgerloom.llm.packed import PART, REPLY, SENT, BlockWords, added_up, answered, blocks_of, met, mixed, packed_texts, sent

WORDS = 5
#: Similarity as a fraction, compared in whole numbers.
THRESHOLD = (75, 100)
#: A token in this many documents or more is indexed in pairs.
FREQUENT = 32
#: Frequent tokens of a text per sub-class, about.
PER_CLASS = 8
BLOCK_CHARS = 4_000_000
#: A bucket of counts gets the tokens of about so many characters, however large a partition is.
BUCKET_CHARS = 8_000_000
HUB_ROUNDS = 2
TOKENS, TEXTS = 1, 2
#: Bytes of a token's key in counting; a clash only makes a token look less rare.
COUNT_KEY = 4
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(run: list[int], hashes: np.ndarray, words: int) -> np.ndarray:
    """The sorted different n-grams of one text; with fewer words the whole sequence is one."""
    n = len(run)
    if not n:
        return np.zeros(0, np.uint64)
    h = hashes[np.array(run)]
    width = min(n, words)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * STEP + h[k : k + len(out)])
    return np.unique(out)


def block_sets(texts: list[str], words: int) -> list[np.ndarray]:
    block = BlockWords(texts)
    return [shingles(r, block.hashes, words) for r in block.runs]


def spare(n: int, threshold: tuple[int, int]) -> int:
    """How many of n tokens a similar text may lack."""
    return n - -(-n * threshold[0] // threshold[1])


def level(n: int, threshold: tuple[int, int]) -> int:
    """A size level; similar texts are on the same or on neighbouring levels."""
    return int(np.log(n) / np.log(threshold[1] / threshold[0]) + 1e-9)


def classes(at: int, threshold: tuple[int, int]) -> int:
    """The number of sub-classes on a level."""
    return max(1, int((threshold[1] / threshold[0]) ** at / PER_CLASS))


def prefix_entries(tokens: np.ndarray, rare: int, need: int, n: int, threshold: tuple[int, int]) -> np.ndarray:
    """Index entries of one text: ``tokens`` in order, the first ``rare`` of them rare, ``need`` still to be counted."""
    single = mixed(tokens[: min(rare, need)] ^ STEP)
    if need <= rare:
        return single
    frequent, need = tokens[rare:], need - rare
    out = [single]
    for at in (level(n, threshold), level(n, threshold) + 1):
        of = mixed(frequent + np.uint64(at)) % np.uint64(classes(at, threshold))
        _, first = np.unique(of, return_index=True)
        counts = np.ones(len(of), np.int64)
        counts[first] = 0
        end = int(np.searchsorted(np.cumsum(counts), need)) + 1
        order = np.argsort(of[:end], kind="stable")
        g, t = of[:end][order], frequent[:end][order]
        for gap in range(1, len(t)):
            same = g[gap:] == g[:-gap]
            if not same.any():
                break
            out.append(mixed(mixed(t[:-gap][same] * STEP + np.uint64(at)) + t[gap:][same]))
    return np.unique(np.concatenate(out))


def bucket_count(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> int:
    """One bucket for each partition, and more where partitions hold more text than a worker should meet at once."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(scan_partitions(docs), -(-chars // bucket_chars))


def document_sets(
    docs: DataFrame, words: int, threshold: tuple[int, int], frequent: int, block_chars: int, bucket_chars: int = BUCKET_CHARS
) -> DataFrame:
    """``doc_id, n_shingles, node, rare, tokens`` of every row, stored.

    ``node`` names the set (null where no partner can exist); ``tokens`` are
    those that several documents hold, in the order of the join.
    """
    buckets = bucket_count(docs, bucket_chars)
    rows = docs.select(PART().alias("part"), "doc_id", "text")

    def counted(batches):
        for block, held in blocks_of(batches, 2, block_chars):
            sets = block_sets([r[2] or "" for r in held], words)
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield sent(TOKENS, block, tokens, counts, buckets, COUNT_KEY)

    def texts(batches):
        for block, held in blocks_of(batches, 2, block_chars):
            yield packed_texts(
                block, TEXTS, id=pa.array([r[1] for r in held], pa.int64()), text=pa.array([r[2] or "" for r in held])
            )

    def weighed(table: pa.Table) -> pa.Table:
        held, parts = met(table, TEXTS)
        sets = block_sets(held.column("text").to_pylist(), words)
        tokens = np.unique(np.concatenate(sets))
        counts = answered(tokens, parts[TOKENS], buckets)
        nodes, rares, shared = [], [], []
        for s in sets:
            c = counts[np.searchsorted(tokens, s)]
            common = c > 1
            if len(s) and len(s) - int(common.sum()) <= spare(len(s), threshold):
                s, c = s[common], c[common]
                order = np.lexsort((s, c))
                nodes.append(s)
                rares.append(int((c < frequent).sum()))
                shared.append(s[order].astype("<u8").tobytes())
            else:
                nodes.append(None)
                rares.append(None)
                shared.append(None)
        # the whole set names the node, its unshared tokens included
        names = [
            None if n is None else int.from_bytes(blake2b(s.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)
            for n, s in zip(nodes, sets, strict=True)
        ]
        return pa.table(
            {
                "doc_id": held.column("id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array(names, pa.int64()),
                "rare": pa.array(rares, pa.int32()),
                "tokens": pa.array(shared, pa.binary()),
            }
        )

    replies = added_up(rows.mapInArrow(counted, SENT), width=COUNT_KEY).where("block <> -1")
    met_rows = replies.unionByName(rows.mapInArrow(texts, REPLY)).groupBy("block")
    schema = "doc_id long, n_shingles long, node long, rare int, tokens binary"
    return stored(met_rows.applyInArrow(weighed, schema), "shingle-sets")


def index_entries(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``entry, node, n, s``: every node's prefix entries, its tokens, and how many of them others hold too."""

    def run(batches):
        for batch in batches:
            for node, n, rare, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(raw, "<u8")
                need = spare(n, threshold) + 1 - (n - len(tokens))
                found = prefix_entries(tokens, rare, need, n, threshold).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, pa.int64()),
                        pa.array(np.full(len(found), node), pa.int64()),
                        pa.array(np.full(len(found), n), pa.int64()),
                        pa.array(np.full(len(found), len(tokens)), pa.int64()),
                    ],
                    names=["entry", "node", "n", "s"],
                )

    def gathered(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 100_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    wanted = sets.select("node", F.col("n_shingles").alias("n"), "rare", "tokens")
    return wanted.mapInArrow(gathered, "entry long, node long, n long, s long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar enough."""

    def run(batches):
        for batch in slices(batches):
            a, b, na, nb, ta, tb = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                common = len(
                    np.intersect1d(np.frombuffer(ta[i], "<u8"), np.frombuffer(tb[i], "<u8"), assume_unique=True)
                )
                good.append(threshold[1] * common >= threshold[0] * (na[i] + nb[i] - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, g in zip(c, good, strict=True) if g], pa.int64()) for c in (a, b)], names=["a", "b"]
            )

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, ta, tb``: pairs with both nodes' sizes and tokens."""
    left = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")


def compared_with_hubs(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a, b, common, similar, rest``: how node ``a`` compares with its hub ``b``, and its tokens that the hub lacks."""

    def run(batches):
        for batch in slices(batches):
            a, b, na, nb, ta, tb = (c.to_pylist() for c in batch.columns)
            common, similar, rest = [], [], []
            for i in range(len(a)):
                own = np.frombuffer(ta[i], "<u8")
                shared = np.isin(own, np.frombuffer(tb[i], "<u8"), assume_unique=True)
                n = int(shared.sum())
                common.append(n)
                similar.append(threshold[1] * n >= threshold[0] * (na[i] + nb[i] - n))
                rest.append(own[~shared].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(common, pa.int64()),
                    pa.array(similar, pa.bool_()),
                    pa.array(rest, pa.list_(pa.int64())),
                ],
                names=["a", "b", "common", "similar", "rest"],
            )

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long, common long, similar boolean, rest array<long>")


def could_be_similar(common: Column, threshold: tuple[int, int]) -> Column:
    """Whether ``common`` tokens in common make sets of ``n`` and ``nb`` tokens similar."""
    return threshold[1] * common >= threshold[0] * (F.col("n") + F.col("nb") - common)


def hub_order(turn: int) -> Column:
    """Which text of a group the others are verified against first.

    The source of a group of edited copies has few tokens of its own, so the
    least such share comes first; later rounds take texts without a link, the
    last of them in a random order.
    """
    own = (F.col("n") - F.col("s")) / F.col("n")
    mark = F.xxhash64(F.lit(turn), "node")
    return [F.struct(own, mark), F.struct("linked", own, mark), F.struct("linked", mark)][min(turn, 2)]


def ordered_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def other_side(rows: DataFrame, *key: str) -> DataFrame:
    """The same rows as the second node of a pair."""
    return rows.select(*key, *(F.col(c).alias("b" if c == "node" else f"{c}b") for c in rows.columns if c not in key))


def contained(threshold: tuple[int, int]) -> Column:
    """Whether the overlap ``i`` with the hub could alone make a row similar to another one at least as large."""
    return F.col("i") * (threshold[0] + threshold[1]) >= 2 * threshold[0] * F.col("n")


def reaching(threshold: tuple[int, int]) -> Column:
    """Whether the overlap ``i`` with the hub could alone make a row similar to any other one."""
    return F.col("i") * threshold[1] >= F.col("n") * threshold[0]


def open_entries(placed: DataFrame, hubs: DataFrame, tested: DataFrame) -> DataFrame:
    """``entry, node, n, s, c, hub, i``: the rows of open entries and what they share with the entry's first hub."""
    overlap = tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("common").alias("i"))
    rows = placed.select("entry", "node", "n", "s", "c").join(hubs.select("entry", F.col("b").alias("hub")), "entry")
    rows = rows.join(overlap, ["node", "hub"], "left")
    return rows.withColumn("i", F.when(F.col("node") == F.col("hub"), F.col("s")).otherwise(F.col("i")))


def tokens_outside(rows: DataFrame, tested: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``node, n, c, hub, i, o, p, token``: of each node's ``o`` tokens that a hub lacks, the prefix a partner must share.

    A node similar to another shares ``threshold`` of its own tokens with it,
    at most ``i`` of them in the hub. So of the ``o`` others it may lack only
    as many as leave the rest enough, and one of the first of them is shared.
    """
    least = F.floor((F.col("n") * threshold[0] + threshold[1] - 1) / threshold[1])
    need = F.greatest(F.lit(1), least - F.col("i"))
    nodes = rows.select("node", "n", "c").distinct()
    of = nodes.join(tested.where(F.size("rest") > 0), nodes["node"] == tested["a"])
    of = of.select("node", "n", "c", F.col("b").alias("hub"), F.col("common").alias("i"), F.size("rest").alias("o"), "rest")
    of = of.withColumn("need", need.cast("int")).where("o >= need")
    prefix = F.posexplode(F.slice("rest", F.lit(1), F.col("o") - F.col("need") + 1)).alias("p", "token")
    return of.select("node", "n", "c", "hub", "i", "o", prefix)


def open_pairs(placed: DataFrame, hubs: DataFrame, tested: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs ``a, b`` of different components that may still be similar.

    Nodes that share an entry have been compared with the entry's first hub; in
    an entry of few nodes only where sizes fit, so a node that was not compared
    meets the others there. What two compared nodes have in common lies in the
    hub, at most the smaller of their overlaps with it, or outside.

    Either those overlaps alone could make them similar: then the smaller node
    lies in the hub nearly as a whole (``contained``) and the other one for the
    most part, so only such rows meet. Or they share tokens that the hub lacks:
    they meet in a prefix of these, and the places of the last one that they
    share bound how many more there can be.
    """
    rows = stored(open_entries(placed, hubs, tested), "open-entries")
    by_size = could_be_similar(F.least("s", "sb"), threshold)
    in_hub = could_be_similar(F.least("i", "ib"), threshold)
    apart = F.col("c") != F.col("cb")
    others = other_side(rows.drop("hub"), "entry")
    alone = rows.where("i is null").join(others, "entry").where(apart & by_size)
    larger = other_side(rows.where(reaching(threshold)).drop("hub"), "entry")
    inside = rows.where(contained(threshold)).join(larger, "entry").where(apart & by_size & in_hub & (F.col("n") <= F.col("nb")))
    outside = stored(tokens_outside(rows, tested, threshold), "tokens-outside-hubs")
    met = outside.join(other_side(outside, "hub", "token"), ["hub", "token"]).where(F.col("c") < F.col("cb"))
    both, later = F.least("i", "ib"), F.least(F.col("o") - F.col("p"), F.col("ob") - F.col("pb")) - 1
    counted = (
        met.where(could_be_similar(both + F.least("o", "ob"), threshold))
        .groupBy("hub", "node", "b", "n", "nb", both.alias("i"))
        .agg(F.count(F.lit(1)).alias("more"), F.min(later).alias("later"))
    )
    beside = counted.where(could_be_similar(F.col("i") + F.col("more") + F.col("later"), threshold))
    return ordered_pairs(alone).unionByName(ordered_pairs(inside)).unionByName(ordered_pairs(beside)).distinct()


def followers(linked: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``node, head``: nodes that need no search, since a linked node has the same partners.

    Nodes with the same shared tokens differ in tokens of their own only. The
    one with the fewest, the head, is similar to all that any of the others is
    similar to. So those that are similar to the head itself just follow it.
    """
    core = F.md5("tokens").alias("core")
    nodes = linked.select("node", F.col("n_shingles").alias("n"), F.expr("length(tokens) div 8").alias("s"), core).distinct()
    head = F.min(F.struct("n", "node"))
    heads = nodes.groupBy("core").agg(head.alias("head"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    met = nodes.join(heads.select("core", F.col("head.node").alias("head"), F.col("head.n").alias("nb")), "core")
    return met.where(F.col("node") != F.col("head")).where(could_be_similar(F.col("s"), threshold)).select("node", "head")


def node_components(sets: DataFrame, threshold: tuple[int, int], rounds: int, few: int = FREQUENT) -> DataFrame:
    """``node, component`` of all nodes that have a link.

    In an entry of more than ``few`` nodes all are compared with the hub, in a
    smaller one those whose sizes fit.
    """
    entries = stored(index_entries(sets, threshold), "index-entries")
    known: DataFrame | None = None
    first_hubs: DataFrame | None = None
    tested: DataFrame | None = None
    for turn in range(max(1, rounds) + 1):
        if known is None:
            placed = entries.withColumn("c", F.col("node")).withColumn("linked", F.lit(False))
        else:
            placed = (
                entries.join(known, "node", "left")
                .withColumn("c", F.coalesce("component", "node"))
                .withColumn("linked", F.col("component").isNotNull())
                .drop("component")
            )
        ranked = placed.withColumn("o", hub_order(turn))
        hub = F.min(F.struct("o", "node", "n", "s", "c")).alias("hub")
        hubs = ranked.groupBy("entry").agg(
            F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("rows"), hub
        ).where("low < high")
        named = (("node", "b"), ("n", "nb"), ("s", "sb"), ("c", "cb"))
        hubs = stored(hubs.select("entry", "rows", *(F.col(f"hub.{x}").alias(y) for x, y in named)), "entry-hubs")
        if hubs.isEmpty():
            break
        by_size = could_be_similar(F.least("s", "sb"), threshold)
        with_hub = placed.join(hubs, "entry").where(F.col("c") != F.col("cb"))
        crowded = F.lit(turn == 0) & (F.col("rows") > few)
        with_hub = with_hub.where(by_size | crowded)
        if turn == 0:
            pairs = with_hub.select(F.col("node").alias("a"), "b").distinct()
            first_hubs, tested = hubs, stored(compared_with_hubs(pairs, sets, threshold), "compared")
            links = tested.where("similar").select("a", "b")
        elif turn < rounds:
            links = stored(verified(ordered_pairs(with_hub), sets, threshold), "links")
        else:
            still = placed.join(hubs.select("entry"), "entry", "left_semi")
            links = stored(verified(open_pairs(still, first_hubs, tested, threshold), sets, threshold), "links")
        if not links.isEmpty():
            known = stored(joined(known, links), "node-components")
    return known if known is not None else sets.sparkSession.createDataFrame([], "node long, component long")


def joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links between nodes of known ones."""
    if known is None:
        return components(links)
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = (
        links.join(of("a"), "a", "left")
        .join(of("b"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    fresh = stored(components(between).withColumnRenamed("component", "merged"), "merged")
    moved = known.join(fresh.withColumnRenamed("node", "component"), "component", "left").select(
        "node", F.coalesce("merged", "component").alias("component")
    )
    new = fresh.join(known.select("node"), "node", "left_anti").select("node", F.col("merged").alias("component"))
    return moved.unionByName(new)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    threshold: tuple[int, int] = THRESHOLD,
    frequent: int = FREQUENT,
    rounds: int = HUB_ROUNDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    A-Z is lower-cased; words are runs of characters other than blanks. Two
    texts are linked when their sets of word n-grams have a Jaccard similarity
    of the threshold or more; ``component_id`` is the smallest id reachable by
    links. A null or empty text has no set and no links. A null id is linked
    like any other but is no smallest id unless all of its component are null.
    Repeated rows are one text seen again. Other columns are ignored; an empty
    table gives an empty result. ``docs`` is read three times and must be stored.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    sets = document_sets(rows, words, threshold, frequent, block_chars)
    linked = sets.where("node is not null")
    follow = stored(followers(linked, threshold), "followers")
    nodes = stored(linked.dropDuplicates(["node"]).drop("doc_id").join(follow, "node", "left_anti"), "nodes")
    known = node_components(nodes, threshold, rounds, frequent)
    ids = linked.groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(follow, "node", "left").withColumn("head", F.coalesce("head", "node"))
    placed = ids.join(known.withColumnRenamed("node", "head"), "head", "left")
    placed = placed.select("node", "least", F.coalesce("component", "head").alias("component"))
    placed = stored(placed, "placed-nodes")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(least, "component").select("node", "component_id"), "named-nodes")
    return (
        sets.where("node is null")
        .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        .unionByName(linked.join(named, "node").select("doc_id", "n_shingles", "component_id"))
    )


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Rows that share an id are one document and stay or go together; rows
    without an id go only where their component has one.
    """
    found = near_duplicates(docs, id_column, text_column)
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_lost"))
    return docs.join(lost.distinct(), docs[id_column].eqNullSafe(F.col("_lost")), "left_anti")
