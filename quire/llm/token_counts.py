"""Token counts of a unigram model by dynamic programming shared over a trie of pre-tokens.

The distinct pre-tokens of a chunk of texts are visited in sorted order, which walks their trie depth
first: the stack holds one node for each prefix of the current pre-token, and only the nodes below
the longest prefix shared with the one before are new. A node's forward score is the best sum of
piece scores over segmentations of its prefix; a terminal node stores how many tokens its best
segmentation has. Counts are kept by pre-token in a bounded cache, then summed per document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import with_fields

CACHED = 400_000
MARK = "▁"


class Unigram:
    """Scores by piece, with every suffix of a piece known so that a search can stop early."""

    def __init__(self, pieces: list[str]):
        #: Zipf's law over the vocabulary's order stands for the log probability of a piece.
        self.scores = {p: -math.log(rank + 2) for rank, p in reversed(list(enumerate(pieces))) if p}
        self.suffixes: dict[str, float | None] = dict(self.scores)
        for p in self.scores:
            for i in range(1, len(p)):
                self.suffixes.setdefault(p[i:], None)
        #: A character without a piece is written as its UTF-8 bytes, each a token of this score.
        self.byte_score = -math.log(len(pieces) + 2) - 1
        self.counts: dict[str, int] = {}

    def visit(self, pretokens: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(pre-token, tokens) of sorted distinct pre-tokens."""
        best, tokens, last = [0.0], [0], ""
        known, fallback = self.suffixes, self.byte_score
        for word in pretokens:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                score, count = best[end - 1] + n * fallback, tokens[end - 1] + n
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in known:
                        break
                    own = known[piece]
                    if own is not None and best[start] + own >= score:
                        score, count = best[start] + own, tokens[start] + 1
                best.append(score)
                tokens.append(count)
            yield word, tokens[-1]
            last = word

    def learn(self, words: set[str]) -> None:
        if len(self.counts) > CACHED:
            self.counts.clear()
        new = sorted(MARK + w for w in words if w not in self.counts)
        for word, n in self.visit(new):
            self.counts[word[len(MARK) :]] = n


_loaded: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        keep = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _loaded[path] = Unigram([model.id_to_piece(i) for i in keep])
    return _loaded[path]


_SCHEMA = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
_ARROW = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
_PRETOKEN = re.compile(r"[^ \t\n\v\f\r]+")


def _counter(path: str):
    @F.arrow_udf(_SCHEMA)
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = unigram(path)
        for column in columns:
            out, chunk, size = [], [], 0

            def some():
                model.learn({w for doc in chunk for w in doc})
                get = model.counts.__getitem__
                out.extend({"n_pretokens": len(doc), "n_tokens": sum(map(get, doc))} for doc in chunk)

            for x in column:
                text = x.as_py() or ""
                chunk.append(_PRETOKEN.findall(text))
                size += len(text)
                if size > 1 << 20:
                    some()
                    chunk, size = [], 0
            some()
            yield pa.array(out, _ARROW)

    return count


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with n_pretokens (runs between ASCII blanks) and n_tokens (tokens of their best unigram
    segmentations, each pre-token marked at its start; among equal scores the longest last piece).

    Null, empty and blank texts have none of either. Characters outside the vocabulary count as their
    UTF-8 bytes. Other columns stay, columns of these names are replaced, repeated rows are counted
    each, very long texts whole, an empty table gives no rows."""
    return with_fields(docs, ["n_pretokens", "n_tokens"], _counter(model_path)(F.col("text").cast("string")))
