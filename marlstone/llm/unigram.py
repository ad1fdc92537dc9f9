"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece in a word; dynamic programming carries, for each end,
the best score and the number of pieces on its path, nothing else. Ties and unknown characters follow the
public ``tokenizers`` library's unigram model: a path replaces another only if its score is higher, paths
arrive by start from the left; a character that is no piece costs the least score less ten; unknown
characters in a row are one, and become one piece for each of their bytes where the vocabulary has byte pieces.

No public unigram vocabulary ships here, so the pieces of a public byte-fallback vocabulary get scores by
rule: Zipf's law over their rank. ``model`` gives the same vocabulary to the library, for comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Cache, small_batches
from marlstone.llm.tokens import vocabulary_path

VOCABULARY, SPACE, UNKNOWN_COST = "piece_bpe_32k.model", "▁", 10.0
#: Noncharacters, which no text holds.
UNKNOWN = "\ufdd0\ufdd1"


@lru_cache(2)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores; id 0 is the unknown piece. Score: minus the logarithm of rank times the harmonic number."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    n = file.get_piece_size()
    harmonic = math.log(sum(1 / (i + 1) for i in range(n)))
    # control pieces stand for no text: they are left out, and the unknown piece, which must be there, has a name
    # that is no text and the least score
    kept = [(file.id_to_piece(i), -math.log(i + 1) - harmonic) for i in range(n) if not file.is_control(i) and not file.is_unknown(i)]
    return [(UNKNOWN, min(score for _, score in kept)), *kept]


def model(path: str | None = None):
    """The same vocabulary as a tokenizer of the public library."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary(path or vocabulary_path(VOCABULARY)), 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(SPACE, "always", True)
    return t


class Counter:
    """Counts pieces of a text; words are looked up in a bounded cache."""

    def __init__(self, path: str):
        pieces = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        self.known = {piece for piece, _ in pieces}
        self.words = Cache(self.word)

    def cost(self, run: str) -> int:
        """Pieces that a run of unknown characters becomes."""
        raw = run.encode()
        return len(raw) if all(f"<0x{b:02X}>" in self.known for b in raw) else 1

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through one word, which carries its leading mark."""
        n = len(word)
        best, count, run = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0], seen = 0.0, 0

        def close(end: int) -> None:
            # the one-character path comes last: it starts furthest right
            if word[end - 1] not in self.known and best[end - 1] + self.unknown > best[end]:
                best[end], run[end] = best[end - 1] + self.unknown, run[end - 1] + 1
                start = end - run[end]
                count[end] = count[start] + self.cost(word[start:end])

        for at, (size, score) in self.automaton.iter(word):
            end = at + 1
            while seen < end - 1:
                seen += 1
                close(seen)
            if best[end - size] + score > best[end]:
                best[end], count[end], run[end] = best[end - size] + score, count[end - size] + 1, 0
        while seen < n:
            seen += 1
            close(seen)
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        head, *tail = marked.split(SPACE)
        found = [self.words[SPACE + head]] if head else []
        found += map(self.words.__getitem__, map(SPACE.__add__, tail))
        return sum(c for c, _ in found), math.fsum(s for _, s in found)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens (bigint), score (log-probability of the best path).

    Null and empty texts have no tokens and score 0. Texts, and words in them, may be of any length and are counted
    whole. Of paths that tie the first found stays, as in the library. Repeated rows stay; rows without an id have a
    null one. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    file = path or vocabulary_path(VOCABULARY)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(file)
        for b in batches:
            n, score = zip(*map(own.text, b["text"]), strict=True) if len(b) else ((), ())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": n, "score": score})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, n_tokens bigint, score double")
