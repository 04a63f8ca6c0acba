"""Token counts of a unigram vocabulary without the tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists, for each end position, the pieces that end there. Dynamic programming over the characters carries the best
score and the number of pieces of the path that has it; neither the path nor the pieces are kept. The rules are those of the
tokenizers library's Unigram model:

* scores are added from the left as doubles; a later piece replaces an earlier one only if its score is strictly greater, and longer pieces (which start
  earlier) come first, so the longest piece wins a tie;
* a character that no piece of its own length matches gets the unknown piece, at the least score minus 10;
* neighbouring unknown pieces count as one; with byte fallback (and all byte pieces in the vocabulary) a run counts as its UTF-8 bytes unless it is itself a piece.

Texts are first cut as the Metaspace pre-tokenizer does: spaces become U+2581, one is put in front, and a piece never reaches across the front of a U+2581. Each word thus
counts by itself, and counts of words are remembered (at most ``MAX_WORDS`` in a worker; others are counted each time).

Edge cases: a null text has a null count, an empty one 0. All other white space is ordinary text. Repeated rows count alike; extra columns pass through, but an input column named n_tokens gives way to the count.
An empty table gives an empty result. Time is linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, UNKNOWN_PENALTY, MAX_WORDS = "▁", 10.0, 600_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: Iterable[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = False):
        import ahocorasick

        vocabulary = list(vocabulary)
        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.trie.add_word(piece, (len(piece), float(score)))  # of equal pieces the last one counts
        self.trie.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.unk_piece = vocabulary[unk_id][0]
        self.names, self.longest = names, max(map(len, names))
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.words: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Number of pieces of a text that has no U+2581 but in front.

        Only the last ``longest`` places are kept; an unknown run carries its start, the count before it and its bytes, so the work is linear in the text."""
        n, size = len(text), self.longest + 1
        score, count, run = [0.0] * size, [0] * size, [None] * size  # run: (start, count before, bytes) of the unknown run that ends here
        matches = self.trie.iter(text)
        next_end, match = next(matches, (n, None))
        for end in range(1, n + 1):
            here = []
            while next_end == end - 1:
                here.append(match)
                next_end, match = next(matches, (n, None))
            best, at, unknown, single = None, 0, False, False
            for length, s in sorted(here, reverse=True):  # from the left
                x = s + score[(end - length) % size]
                single = single or length == 1
                if best is None or x > best:
                    best, at, unknown = x, end - length, text[end - length : end] == self.unk_piece
            if not single:
                x = self.unknown + score[(end - 1) % size]
                if best is None or x > best:
                    best, at, unknown = x, end - 1, True
            here, before = end % size, at % size
            if not unknown:
                score[here], count[here], run[here] = best, count[before] + 1, None
                continue
            first, base, octets = run[before] or (at, count[before], 0)
            octets += len(text[at:end].encode("utf-8", "surrogatepass"))
            known = not self.bytes or end - first <= self.longest and text[first:end] in self.names
            score[here], count[here], run[here] = best, base + (1 if known else octets), (first, base, octets)
        return count[n % size]

    def text(self, text: str | None) -> int | None:
        if text is None:
            return None
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        # What precedes the first space gets a front of its own; a text that starts with a space has it already.
        words = words[1:] if text[0] in (" ", SPACE) else words
        get = self.words.get
        counts = list(map(get, words))
        if None in counts:
            for i, c in enumerate(counts):
                if c is None:
                    counts[i] = c = self.word(SPACE + words[i])
                    if len(self.words) < MAX_WORDS:
                        self.words[words[i]] = c
        return sum(counts)


_counters: dict[tuple, Counter] = {}


def add_counts(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens", unk_id: int = 0, byte_fallback: bool = False) -> DataFrame:
    """``docs`` with the number of tokens of each text. The vocabulary is read by each worker from ``model_path``."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        key = (model_path, unk_id, byte_fallback)
        if key not in _counters:
            _counters[key] = Counter(read_vocabulary(model_path), unk_id, byte_fallback)
        return pd.Series([_counters[key].text(t) for t in texts], dtype="Int64")

    return docs.withColumn(out_col, count(F.col(text_col)))
