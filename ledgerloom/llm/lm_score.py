"""Language-model scores by a weighted backoff automaton.

The model holds smoothed n-grams of up to three words. A state is a history the
training texts know: none (the root), one word (or the start of a text), or two
words. From state h the arc of a word w that followed h in training weighs

    log10((1 - f(h)) * c(hw) / c(h) + f(h) * P(w | h without its first word))

and leads to the longest known history that ends in w; for all other words
the failure arc of h, of weight log10 f(h), leads to the state of the shorter
history. The root has an arc for every word, of weight log10 p(w): the word
distribution with absolute discounting, whose freed mass goes to unknown words.
f(h) = d * c(h)^(g - 1), where d is the discount of the n-grams that are one word
longer than h and g is chosen so that c(h)^g adds up to the number of different
ones. All of it is computed from counts over all training texts.

No machine holds the whole model. A block of texts asks for the counts of its
own n-grams, which gives the part of the automaton that its texts can reach, and
walks it once over its tokens from left to right, carrying the state and
adding up the weights of the arcs taken.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import scan_partitions, stored
from ledgerloom.llm.packed import PART, REPLY, SENT, BlockWords, added_up, answered, blocks_of, met, mixed, packed_texts, sent

BLOCK_CHARS = 4_000_000
WALK_TOKENS = 100_000  # arcs are looked up for so many tokens at once
END, START = 0, 1
WORDS, PAIRS, TRIPLES, TEXTS = 1, 2, 3, 4
ORDERS = {WORDS: "words", PAIRS: "pairs", TRIPLES: "triples"}
BINS_PER_DOUBLING = 8
ROOT = 0
FACTS = "array<struct<name:string,n:bigint,total:bigint>>"


class BlockTokens:
    """The tokens of a block's texts as numbers of the block's own vocabulary, and its n-grams."""

    def __init__(self, texts: list[str]) -> None:
        words = BlockWords(texts, reserved=2)
        runs = words.runs
        self.sizes = np.array([len(r) + 1 for r in runs])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.token = np.zeros(int(self.sizes.sum()), np.int64)  # END stands last in every text
        for r, s in zip(runs, self.starts, strict=True):
            self.token[s : s + len(r)] = r
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.starts] = START
        self.hashes = words.hashes
        n = len(self.hashes)
        pairs, self.pair = np.unique(before * n + self.token, return_inverse=True)
        self.pair_history, self.pair_token = pairs // n, pairs % n
        self.inner = np.ones(len(self.token), bool)  # tokens with a history of two
        self.inner[self.starts] = False
        history = np.concatenate([[0], self.pair[:-1]])
        triples, first, inverse = np.unique(
            (history * n + self.token)[self.inner], return_index=True, return_inverse=True
        )
        self.triple_history, self.triple_token = triples // n, triples % n
        self.triple_pair = self.pair[self.inner][first]  # its last two words
        self.triple = np.full(len(self.token), -1)
        self.triple[self.inner] = inverse
        self.pair_hashes = longer(self.hashes[self.pair_history], self.hashes[self.pair_token])
        self.triple_hashes = longer(self.pair_hashes[self.triple_history], self.hashes[self.triple_token])

    def learnt(self, learns: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """The hashes and counts of the n-grams of each order in the texts marked by ``learns``."""
        use = np.repeat(learns, self.sizes)
        return [
            (WORDS, self.hashes, np.bincount(self.token[use], minlength=len(self.hashes))),
            (PAIRS, self.pair_hashes, np.bincount(self.pair[use], minlength=len(self.pair_hashes))),
            (TRIPLES, self.triple_hashes, np.bincount(self.triple[use & self.inner], minlength=len(self.triple_hashes))),
        ]


def longer(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of histories followed by one more token."""
    return mixed(mixed(history) * np.uint64(0x9E3779B97F4A7C15) + token)


def facts_of(kind: int, totals: np.ndarray) -> str:
    """What the discounts need of a bucket's counts, as JSON of type ``FACTS``."""
    totals = totals[totals > 0]
    told = [
        ("types", len(totals), int(totals.sum())),
        ("once", int((totals == 1).sum()), 0),
        ("twice", int((totals == 2).sum()), 0),
    ]
    if kind != TRIPLES and len(totals):
        bins, of = np.unique(np.floor(np.log2(totals) * BINS_PER_DOUBLING).astype(int), return_inverse=True)
        sums = np.bincount(of, weights=totals)
        told += [(f"bin{b}", int(n), int(t)) for b, n, t in zip(bins, np.bincount(of), sums, strict=True)]
    return json.dumps([{"name": name, "n": n, "total": t} for name, n, t in told])


class Weights:
    """Root and failure weights of the automaton, from corpus-wide facts ``(kind, name, n, total)``."""

    def __init__(self, facts: list[tuple[int, str, int, int]]) -> None:
        known = {(kind, name): (n, total) for kind, name, n, total in facts}
        types = {kind: known.get((kind, "types"), (0, 0)) for kind in ORDERS}
        self.types, self.tokens = types[WORDS]

        def discount(kind: int) -> float:
            once, twice = (known.get((kind, name), (0, 0))[0] for name in ("once", "twice"))
            return min(0.999, once / (once + 2 * twice)) if once and twice else 0.5

        self.discounts = {kind: discount(kind) for kind in ORDERS}
        bins = {
            kind: [(n, t / n) for (k, name), (n, t) in sorted(known.items()) if k == kind and name.startswith("bin")]
            for kind in (WORDS, PAIRS)
        }
        self.growth = {kind + 1: self._growth(bins[kind], types[kind + 1][0]) for kind in bins}

    @staticmethod
    def _growth(counts: list[tuple[int, float]], different: int) -> float:
        """The g in (0, 1] at which the sum of c^g is the number of different pairs."""
        low, high = 0.0, 1.0
        for _ in range(50):
            g = (low + high) / 2
            low, high = (g, high) if sum(n * c**g for n, c in counts) < different else (low, g)
        return high

    def root(self, c: np.ndarray) -> np.ndarray:
        """p(w) by the word's count; 0 is an unknown word."""
        if not self.tokens:
            return np.ones(len(c))
        d = self.discounts[WORDS]
        return np.where(c > 0, np.maximum(c - d, 1e-9) / self.tokens, d * self.types / self.tokens)

    def failure(self, kind: int, c: np.ndarray) -> np.ndarray:
        """f(h) by the history's count, for n-grams of ``kind``; an unknown history only fails."""
        return np.where(c > 0, self.discounts[kind] * np.maximum(c, 1.0) ** (self.growth[kind] - 1), 1.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


class Automaton:
    """The states and arcs that a block's texts can reach.

    States are numbered: the root, the block's words, its pairs of words.
    """

    def __init__(self, t: BlockTokens, counts: dict[int, np.ndarray], weights: Weights) -> None:
        self.tokens = t
        words, pairs, triples = (counts[k] for k in (WORDS, PAIRS, TRIPLES))
        n = len(words)
        self.width = n
        after = words.copy()
        after[START] = words[END]  # as many texts start as end
        fail2, fail3 = weights.failure(PAIRS, after), weights.failure(TRIPLES, pairs)
        h = t.pair_history
        p1 = weights.root(words)
        p2 = (1 - fail2[h]) * pairs / np.maximum(after[h], 1) + fail2[h] * p1[t.pair_token]
        h = t.triple_history
        p3 = (1 - fail3[h]) * triples / np.maximum(pairs[h], 1) + fail3[h] * p2[t.triple_pair]
        self.arc_weights = {WORDS: np.log10(p1), PAIRS: np.log10(p2), TRIPLES: np.log10(p3)}
        word_state, pair_state = 1 + np.arange(n), 1 + n + np.arange(len(pairs))
        self.origins = {
            WORDS: np.full(n, ROOT),
            PAIRS: word_state[t.pair_history],
            TRIPLES: pair_state[t.triple_history],
        }
        self.labels = {WORDS: np.arange(n), PAIRS: t.pair_token, TRIPLES: t.triple_token}
        self.targets = {
            WORDS: np.where(words > 0, word_state, ROOT),
            PAIRS: pair_state,
            TRIPLES: pair_state[t.triple_pair],
        }
        # The order of the arc each token takes: a word after a known state that has no arc for it
        # fails until one has, so shorter arcs are looked up only where longer ones are missing.
        known2 = ((pairs > 0) & (after[t.pair_history] > 0))[t.pair]
        known3 = np.zeros(len(t.token), bool)
        known3[t.inner] = (triples > 0)[t.triple[t.inner]]
        known3[1:] &= known2[1:] & known2[:-1]
        self.taken = {TRIPLES: known3, PAIRS: known2 & ~known3, WORDS: ~known2}
        self.failure_state = array("q", np.concatenate([[ROOT], np.full(n, ROOT), word_state[t.pair_token]]).tobytes())
        self.failure_weight = array("d", np.log10(np.concatenate([[1.0], fail2, fail3])).tobytes())
        self.start = START + 1 if after[START] else ROOT

    def arcs(self, a: int, b: int) -> tuple[dict[int, int], list[int], list[float]]:
        """The arcs that tokens a to b take: state * width + token to a number, by it targets and weights."""
        t = self.tokens
        keys, targets, weights = [], [], []
        for kind, ngram in ((WORDS, t.token), (PAIRS, t.pair), (TRIPLES, t.triple)):
            ids = np.unique(ngram[a:b][self.taken[kind][a:b]])
            keys.append(self.origins[kind][ids] * self.width + self.labels[kind][ids])
            targets.append(self.targets[kind][ids])
            weights.append(self.arc_weights[kind][ids])
        numbered = {key: k for k, key in enumerate(np.concatenate(keys).tolist())}
        return numbered, np.concatenate(targets).tolist(), np.concatenate(weights).tolist()

    def walk(self) -> list[float]:
        """The score of every text, in one pass over all tokens."""
        scores: list[float] = []
        width, failure_state, failure_weight = self.width, self.failure_state, self.failure_weight
        state, score = self.start, 0.0
        for a in range(0, len(self.tokens.token), WALK_TOKENS):
            arcs, targets, weights = self.arcs(a, a + WALK_TOKENS)
            for token in self.tokens.token[a : a + WALK_TOKENS].tolist():
                while (arc := arcs.get(state * width + token)) is None:
                    score += failure_weight[state]
                    state = failure_state[state]
                state = targets[arc]
                score += weights[arc]
                if token == END:
                    scores.append(score)
                    state, score = self.start, 0.0
        return scores


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")))


def score_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    folds: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from all rows outside fold 0 and scores every whole text.
    A null or empty text has the end token only; a null id is held out; each
    repeated row counts and is scored; other columns are ignored; an empty
    table gives an empty result. With nothing to learn from every token is
    unknown and has probability 1. ``docs`` is read twice and must be stored.
    """
    buckets = scan_partitions(docs)
    rows = docs.select(
        PART().alias("part"),
        docs[id_column].cast("long").alias("doc_id"),
        (fold(docs[id_column]) % folds == 0).alias("held_out"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"),
    )

    def counted(batches):
        for block, held in blocks_of(batches, 3, block_chars):
            for kind, hashes, counts in BlockTokens([r[3] for r in held]).learnt(np.array([not r[2] for r in held])):
                yield sent(kind, block, hashes, counts, buckets)

    replies = stored(added_up(rows.mapInArrow(counted, SENT), facts_of), "lm-counts")
    each_fact = F.explode(F.from_json("facts", FACTS))
    facts = replies.where("block = -1").select("kind", each_fact.alias("f")).groupBy("kind", "f.name")
    added = facts.agg(F.sum("f.n").alias("n"), F.sum("f.total").alias("total"))
    weights = Weights([tuple(r) for r in added.collect()])  # some hundred rows at any size of the corpus

    def texts(batches):
        for block, held in blocks_of(batches, 3, block_chars):
            _, ids, flags, bodies = (list(x) for x in zip(*held, strict=True))
            yield packed_texts(
                block, TEXTS, id=pa.array(ids, pa.int64()), held=pa.array(flags, pa.bool_()), text=pa.array(bodies)
            )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

    def traversed(table: pa.Table) -> pa.Table:
        held, parts = met(table, TEXTS)
        t = BlockTokens(held.column("text").to_pylist())
        counts = {
            kind: answered(hashes, parts[kind], buckets)
            for kind, hashes in ((WORDS, t.hashes), (PAIRS, t.pair_hashes), (TRIPLES, t.triple_hashes))
        }
        words = counts[WORDS]
        each = lambda x: np.add.reduceat(x, t.starts)
        return pa.table(
            {
                "doc_id": held.column("id"),
                "held_out": held.column("held"),
                "n_tokens": pa.array(t.sizes, pa.int64()),
                "n_known": pa.array(each((words > 0).astype(np.int64)[t.token]), pa.int64()),
                "train_tokens": pa.array([weights.tokens] * len(t.sizes), pa.int64()),
                "base_score": pa.array(each(weights.base(words)[t.token])),
                "score": pa.array(Automaton(t, counts, weights).walk()),
            }
        )

    asked = replies.where("block <> -1").unionByName(rows.mapInArrow(texts, REPLY))
    return asked.groupBy("block").applyInArrow(traversed, schema)
