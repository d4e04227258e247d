"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches, Viterbi over score and pieces."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, read, small

MARK = "▁"
#: How far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: A worker's memo of counts by word is emptied beyond this many words.
MEMO = 1_000_000
#: White space of the tokenizer's word splitter (Unicode White_Space).
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")


class CountingViterbi:
    """Counts pieces of words for a unigram vocabulary [(piece, score)] with byte fallback.

    The best path has the highest score; among equal scores the one that reached a place first stays, which is the
    one whose last piece begins earliest. Characters without a piece score the vocabulary's least less
    UNKNOWN_PENALTY; a run of them is one unknown, which byte fallback spells as its UTF-8 bytes if the vocabulary
    has them all.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, byte_fallback: bool = True):
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in {p for p, _ in vocabulary}} if byte_fallback else set()
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.memo: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of a word that already carries its mark."""
        n = len(w)
        matches = self.machine.iter(w)  # by where they end
        last, match = next(matches, (n, None))
        # per place: the best score, the pieces that reach it, where a run of unknowns that ends there began (-1: none does) and its bytes (-1: some have no piece)
        best, count, run, spelled = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            found = []
            while last == end - 1:
                found.append(match)
                last, match = next(matches, (n, None))
            top, start, single = -math.inf, -1, False
            for size, score in sorted(found, reverse=True):  # the earliest start first
                single |= size == 1
                if (x := score + best[end - size]) > top or start < 0:
                    top, start = x, end - size
            if not single and ((x := self.unknown + best[end - 1]) > top or start < 0):
                best[end], old = x, run[end - 1] >= 0
                run[end] = run[end - 1] if old else end - 1
                raw = w[end - 1].encode("utf-8", "surrogatepass")
                spelled[end] = spelled[end - 1] * old + len(raw) if self.bytes.issuperset(raw) and (spelled[end - 1] >= 0 or not old) else -1
                count[end] = count[run[end]] + (spelled[end] if spelled[end] >= 0 else 1)
            else:
                best[end], count[end] = top, count[start] + 1
        return count[n]

    def text(self, text: str | None) -> int:
        """Pieces of a text whose words, split at white space, are marked and counted one by one."""
        if not text:
            return 0
        words = text.split() if not _ODD_SPACES.search(text) else [w for w in _SPACES.split(text) if w]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            # a mark inside a word begins a piece of its own, and a leading one stands for the mark
            parts = re.findall(f"{MARK}[^{MARK}]*", w if w.startswith(MARK) else MARK + w) if MARK in w else [MARK + w]
            memo[w] = sum(map(self.word, parts))
        return int(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)).sum())


@functools.lru_cache(maxsize=2)
def counter(path: str) -> CountingViterbi:
    """The counter of a sentencepiece file's pieces and scores, one a worker process."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return CountingViterbi([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id())


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_words) for every row of docs(doc_id, text, ...).

    n_tokens is what a unigram tokenizer with the file's pieces and scores gives: white space split off, a mark
    before each word, byte fallback. A file of another kind of model (byte-pair merges) is read as unigram too: its
    scores are its merges' ranks, and its own library counts otherwise. A word is scored once a worker and looked up
    after that; of equal scores the path whose last piece begins earliest counts. Null, empty and blank texts have 0
    tokens; a very long text costs its distinct words. Repeated rows keep a row each; other columns are not used; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        c = counter(vocabulary)
        for b in small(batches):
            texts = [t.as_py() for t in b.column(1)]
            yield {"doc_id": b.column(0), "n_tokens": [c.text(t) for t in texts], "n_words": [len(t.split()) if t else 0 for t in texts]}

    return map_rows(documents(docs), "doc_id long, n_tokens long, n_words long", run)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
