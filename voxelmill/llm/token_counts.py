"""Token counts under a unigram model, by dynamic programming over a trie.

Distinct pre-tokens are inserted in a trie of bytes. Every trie node is a prefix, and
its forward score, the best sum of piece scores that spells it, is worked out once,
whichever pre-tokens share it. The number of pieces of the best path is stored at the
nodes where pre-tokens end; a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxelmill.llm.bpe import read_ranks

#: Pieces are scored as by the Zipf-Mandelbrot law over their ranks: -ln(rank + this).
ZIPF_SHIFT = 2.7
#: Trie nodes that a worker keeps before it starts afresh.
MOST_NODES = 600_000


def piece_scores(content: bytes) -> dict[bytes, float]:
    """Scores of the pieces of a rank file (one base64 piece and its rank a line)."""
    return {base64.b64decode(piece): -math.log(int(rank) + ZIPF_SHIFT) for piece, rank in map(bytes.split, content.splitlines())}


class PrefixTrie:
    """Forward scores and piece counts of all prefixes inserted so far."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.children: list[dict[int, int]] = [{}]
        self.best, self.pieces = [0.0], [0]

    def __len__(self) -> int:
        return len(self.best)

    def count(self, token: bytes) -> int:
        """Pieces of the best path that spells ``token``; of equal scores the one of fewer pieces counts."""
        children, best, pieces, scores = self.children, self.best, self.pieces, self.scores
        path, node = [0], 0
        for end, byte in enumerate(token, 1):
            after = children[node].get(byte)
            if after is None:
                score, number = -math.inf, 0
                for begin in range(max(0, end - self.longest), end):
                    own = scores.get(token[begin:end])
                    if own is not None:
                        before = path[begin]
                        reached = best[before] + own
                        if reached > score or reached == score and pieces[before] + 1 < number:
                            score, number = reached, pieces[before] + 1
                after = len(best)
                best.append(score)
                pieces.append(number)
                children.append({})
                children[node][byte] = after
            node = after
            path.append(node)
        return pieces[node]


class _Counts(dict):
    """Counts of pre-tokens, worked out when first asked for."""

    def __init__(self, trie: PrefixTrie) -> None:
        self.trie = trie

    def __missing__(self, token: str) -> int:
        self[token] = number = self.trie.count(token.encode())
        return number


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", pre_tokens: str = "n_pre_tokens", tokens: str = "n_tokens") -> DataFrame:
    """Add the numbers of pre-tokens and of tokens of every whole text.

    A null or empty text has none. Every single byte must be a piece, so that each text
    can be spelled. All rows and columns stay; the new columns must not exist yet. The
    rank file is read on the driver and broadcast (64 MB at most).
    """
    clash = {pre_tokens, tokens} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; name others")
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    column = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = piece_scores(content.value)
        cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        counts = _Counts(PrefixTrie(scores))
        for batch in batches:
            cuts, sums = [], []
            for text in batch.column(column).to_pylist():
                if len(counts.trie) > MOST_NODES:
                    counts = _Counts(PrefixTrie(scores))
                own = cut(text or "")
                cuts.append(len(own))
                sums.append(sum(map(counts.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, type=pa.int64()), pa.array(sums, type=pa.int64())], names=[*batch.schema.names, pre_tokens, tokens])

    return docs.mapInArrow(run, f"{fields}, `{pre_tokens}` long, `{tokens}` long")
