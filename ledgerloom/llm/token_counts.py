"""Token counts under a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton finds every vocabulary piece in a word. For each end
position the search carries the best score and the piece count of the path that
has it; no segmentation is built. Words are cut before every space sign, as the
tokenizer does, so each different word is searched once per worker cache.

Tie rule: among paths of equal score to a position the one whose last piece
starts first, the longest piece, stays. A character no single-character piece
covers costs the lowest score less ten and counts as its UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.bpe import CACHE_WORD_CHARS, chunks, slices

SPACE = "▁"
CACHE_WORDS = 400_000
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Piece counts of words under ``pieces``: (piece, score) in id order."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in reversed(pieces):  # of equal pieces the first stays
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        best[0] = 0.0
        found = self.automaton.iter(word)
        end, hit = next(found, (n, None))
        for i in range(n):
            top, made = None, 0
            while end == i:  # longest piece first, so a later equal score loses
                length, score = hit
                start = i + 1 - length
                reached = best[start] + score
                if top is None or reached > top:
                    top, made = reached, pieces[start] + 1
                end, hit = next(found, (n, None))
            if word[i] not in self.single:
                reached = best[i] + self.unknown
                if top is None or reached > top:
                    top, made = reached, pieces[i] + len(word[i].encode("utf-8"))
            best[i + 1], pieces[i + 1] = top, made
        return pieces[n]

    def words(self, text: str) -> list[str]:
        """The text's words, each led by the space sign."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        return marked.split(SPACE)[1:]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        known = self.known
        long: dict[str, int] = {}
        for w in set(chain.from_iterable(split)).difference(known):
            (known if len(w) <= CACHE_WORD_CHARS else long)[w] = self.count(SPACE + w)
        if long:
            out = [sum(known[w] if w in known else long[w] for w in words) for words in split]
        else:
            out = [sum(map(known.__getitem__, words)) for words in split]
        if len(known) > CACHE_WORDS:
            known.clear()
        return out


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(path))


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_words, n_bytes`` of the whole text.

    A null or empty text has none of them; a null id stays null; repeated rows
    are counted each; other columns are ignored; an empty table gives an empty
    result. ``path`` must name the vocabulary on every machine.
    """

    def run(batches):
        count = counter(path)
        for batch in slices(batches):
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(count.counts(texts), pa.int64()),
                        pa.array([len(count.words(t)) for t in texts], pa.int64()),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "n_words", "n_bytes"],
                )

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_words long, n_bytes long")
