"""Token counts of a unigram tokenizer, without its tokens.

A text's score-best division into vocabulary pieces is found by dynamic programming over
its characters: an Aho-Corasick automaton lists the pieces that end at each place, and
the best score and the piece count that goes with it are carried on. Ties fall as in the
tokenizer: of divisions with equal scores up to a place the one whose last piece begins
first wins. A character that no piece of its own matches may stand alone, at ten below
the lowest score; it counts as one token for each of its UTF-8 bytes.

White space is a mark of its own, set before the text and in place of each blank. Where
no piece of the vocabulary reaches over the start of a mark, divisions of the stretches
between are independent, and each distinct stretch is counted once for each worker. That
adds scores in another order, which changes nothing if sums are exact, so it is done only
with a vocabulary whose scores are whole numbers; else whole texts are divided.

A null or empty text has no tokens. Repeated rows give repeated results.
"""

import re

import pyspark.sql.types as T

from maskwright.llm.common import map_texts, table

MARK = "▁"
#: How far a lone unknown character lies below the lowest score; fixed in the tokenizer.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000


def default_vocabulary():
    """(piece, score) list of the public piece vocabulary, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class UnigramCounter:
    """Counts the tokens of the best division; made once per task."""

    def __init__(self, vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.lowest = min([s for _, s in vocabulary], default=0.0) - UNKNOWN_PENALTY
        self.single = set()
        for piece, score in vocabulary:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), float(score)))
                if len(piece) == 1:
                    self.single.add(piece)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()
        whole = all(float(s).is_integer() and abs(s) < 2 ** 31 for _, s in vocabulary)
        crossing = any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if whole and not crossing else None
        self.known = {}

    def divide(self, text):
        """Pieces in the best division of a marked text; unknown characters as their bytes."""
        size = len(text)
        best, count = [0.0] + [float("-inf")] * size, [0] * (size + 1)
        odd = [] if self.single.issuperset(text) else [i for i, c in enumerate(text) if c not in self.single]
        odd.reverse()
        # matches come by end and, for one end, the longest first: the first to begin
        for end, (length, score) in self.automaton.iter(text) if self.any else ():
            while odd and odd[-1] < end:
                self._alone(text, odd.pop(), best, count)
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        while odd:
            self._alone(text, odd.pop(), best, count)
        return count[size]

    def _alone(self, text, at, best, count):
        """A character without a piece of its own stands alone, if that is better."""
        total = best[at] + self.lowest
        if total > best[at + 1]:
            best[at + 1], count[at + 1] = total, count[at] + len(text[at].encode("utf-8"))

    def count(self, text):
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.split is None:
            return self.divide(marked)
        known, total = self.known, 0
        for stretch in self.split(marked):
            n = known.get(stretch)
            if n is None:
                n = self.divide(stretch)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(stretch) <= 64:
                    known[stretch] = n
            total += n
        return total


def token_counts(df, text="text", vocabulary=None):
    """`df` with `n_tokens` of each whole text. `vocabulary` is a list of (piece, score); by
    default each task reads the public one."""

    def make():
        counter = UnigramCounter(default_vocabulary() if vocabulary is None else vocabulary)
        return lambda texts: [[counter.count(t) for t in texts.to_pylist()]]

    return map_texts(df, text, [("n_tokens", T.LongType())], make)


def op1_token_counts(spark, sf_dir):
    """Number of unigram tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
