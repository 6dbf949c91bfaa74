"""Alignment of the tokens of two tokenizers over the same bytes.

Texts are first brought together in full, so that each distinct one is tokenized and
aligned once and counts with its multiplicity; the measures are joined back to all
identifiers.

Statistics of the corpus are needed for every text again (how many documents hold its
linked id pairs). Pairs aren't exchanged text by text: a chunk of some megabytes of texts
sends each of its distinct pairs once with the documents that hold it, and gets the
corpus-wide counts back. So the commonest pair of all makes one row a chunk, and what
moves is a fraction of the input.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.words import pieces
from voxelmill.session import bucketed_table, shuffle_partitions

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Bits of the second tokenizer's ids in a packed pair.
B_BITS = 31

_TEXT = "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
#: Rows of texts have the fields of ``_TEXT``, the last row of a chunk has what it asks for.
_SCHEMA = f"chunk string, {_TEXT}, asked array<long>, documents array<long>"


def byte_level_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """The first tokenizer: merges of a byte-level vocabulary file over pieces that ``pattern`` cuts, without special tokens."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        described = json.loads(vocabulary)
        special = {t["id"] for t in described.get("added_tokens", [])}
        byte_of = byte_level_table()
        ranks = {bytes(byte_of[c] for c in token): number for token, number in described["model"]["vocab"].items() if number not in special}
        self.table: list[bytes] = [b""] * (1 + max(ranks.values()))
        for token, number in ranks.items():
            self.table[number] = token
        # in such files tokens are numbered in the order of their merges, so that numbers are ranks
        self._encode = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self._vocabulary = vocabulary

    def encode(self, text: str) -> list[int]:
        try:
            return self._encode(" " + text)
        except BaseException as lost:  # a panic of the library is no Exception
            if type(lost).__name__ != "PanicException":
                raise
            # a million blanks in a row exhaust its pattern's stack; the vocabulary's own library is slower and gives the same ids
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(self._vocabulary)
            own.encode_special_tokens = True
            return own.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """The second tokenizer: a piece model that itself puts a space before a text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        made = [self._processor.id_to_piece(k) for k in range(self._processor.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self._processor.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(made)]

    def encode(self, text: str) -> list[int]:
        return self._processor.encode(text)


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of tokens of either side up to the end of each group, and the places of the two tokens of every link.

    Both sides spell the same bytes. A group ends where tokens of both sides end; each
    stretch between neighbouring token ends of either side is what two tokens share, so
    it is one link. Ends are marked on the bytes themselves, so that nothing is sorted.
    """
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    marks = np.zeros(int(ends_a[-1]) + 1, dtype=np.uint8)
    marks[ends_a] = 1
    marks[ends_b] += 2
    marks = marks[np.flatnonzero(marks)].astype(np.int64)
    ended_a, ended_b = np.cumsum(marks & 1), np.cumsum(marks >> 1)
    cuts = np.flatnonzero(marks == 3)
    # the token that a stretch belongs to is the first that hasn't ended before it
    return ended_a[cuts], ended_b[cuts], ended_a - (marks & 1), ended_b - (marks >> 1)


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, names: list[str], offset: int) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group.

    ``names`` hold each id with the mark behind it, inside a group and at its end, those
    of the second side from ``offset`` on. A token stands behind those of its own side
    and those of the other side's groups that come first.
    """
    code_a, code_b = ids_a * 2, ids_b * 2 + offset
    code_a[upto_a - 1] += 1
    code_b[upto_b - 1] += 1
    code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    code[np.arange(len(ids_a)) + np.repeat(upto_b - np.diff(upto_b, prepend=0), np.diff(upto_a, prepend=0))] = code_a
    code[np.arange(len(ids_b)) + np.repeat(upto_a, np.diff(upto_b, prepend=0))] = code_b
    return "".join([names[k] for k in code.tolist()])[:-1]


def _names(size: int, end: str) -> list[str]:
    return [f"{k}{mark}" for k in range(size) for mark in (",", end)]


@lru_cache(maxsize=1)
def _aligner(vocabulary: str, pattern: str, model: bytes) -> _Aligner:
    """One for all tasks of a Python worker."""
    return _Aligner(vocabulary, pattern, model)


class _Aligner:
    """Both tokenizers with their tables."""

    def __init__(self, vocabulary: str, pattern: str, model: bytes) -> None:
        self.a, self.b = ByteLevel(vocabulary, pattern), Pieces(model)
        self.size_a, self.size_b = (np.array([len(t) for t in side.table], dtype=np.int64) for side in (self.a, self.b))
        self.names, self.offset = _names(len(self.a.table), "|") + _names(len(self.b.table), ";"), 2 * len(self.a.table)

    def measure(self, text: str | None) -> tuple[list, np.ndarray, np.ndarray]:
        """The text's own measures, its distinct packed pairs and how often it has each."""
        none = [0, 0, 0, 0, ""], np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        ids_a, ids_b = self.a.encode(text), self.b.encode(text)
        whole = b" " + text.encode()
        if b"".join([self.a.table[k] for k in ids_a]) != whole or b"".join([self.b.table[k] for k in ids_b]) != whole:
            return none
        a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
        # tokens without bytes have no end of their own
        a, b = a[self.size_a[a] > 0], b[self.size_b[b] > 0]
        upto_a, upto_b, link_a, link_b = align(self.size_a[a], self.size_b[b])
        groups = spelled(a, b, upto_a, upto_b, self.names, self.offset)
        pairs, times = np.unique((a[link_a] << B_BITS) | b[link_b], return_counts=True)
        return [len(a), len(b), len(upto_a), len(link_a), hashlib.sha256(groups.encode()).hexdigest()], pairs, times


def aligned_texts(docs: DataFrame, vocabulary_file: str, pattern: str, model_file: str, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Distinct texts with their own measures and pairs, by chunk, and a row for each chunk with what it asks the corpus.

    Written to the shared folder in buckets of ``chunk``: a lost executor repeats no
    tokenizing of other tasks, and pairs, kept as differences, are small and stay where
    they were written. Both vocabulary files are read on the driver (a few megabytes each) and broadcast.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        vocabulary = file.read()
    with open(model_file, "rb") as file:
        model = file.read()
    content = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern, model))
    distinct = docs.select(F.col(text_col).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
        aligner, schema = _aligner(*content.value), pa.schema([(n, kind[k]) for n, k in map(str.split, _SCHEMA.split(", "))])
        task, number, size = TaskContext.get().partitionId(), 0, 0
        asked: list[np.ndarray] = []
        weights: list[np.ndarray] = []

        def condensed() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate(asked)
            # runs that are in order already are only merged
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            return keys[first], np.add.reduceat(np.concatenate(weights)[order], first) if len(first) else keys

        def question() -> pa.RecordBatch:
            keys, sums = condensed()
            row = {n: [None] for n in schema.names} | {"chunk": [f"{task}-{number}"], "asked": [keys], "documents": [sums]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in pieces(batches, 64):
            made = {n: [] for n in schema.names}
            for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                own, pairs, times = aligner.measure(text)
                digest = hashlib.sha256(text.encode()).digest() if text is not None else None
                for name, value in zip(schema.names, [f"{task}-{number}", digest, *own, np.diff(pairs, prepend=0).tobytes(), times.astype(np.int32).tobytes(), None, None], strict=True):
                    made[name].append(value)
                asked.append(pairs)
                weights.append(np.full(len(pairs), copies, dtype=np.int64))
                size += len(text or "")
            yield pa.RecordBatch.from_pydict(made, schema=schema)
            if size >= chunk_bytes:
                yield question()
                number, size, asked, weights = number + 1, 0, [], []
            elif len(asked) > 1 << 10:
                keys, sums = condensed()
                asked, weights = [keys], [sums]
        if asked:
            yield question()

    return docs.sparkSession.table(bucketed_table(distinct.mapInArrow(run, _SCHEMA), "chunk", shuffle_partitions(docs.sparkSession)))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n_docs, best``: how many documents hold two ids linked, and whether no other pair of the first id is in more."""
    asked = aligned.where(F.col("asked").isNotNull()).select(F.explode(F.arrays_zip("asked", "documents")).alias("q"))
    counted = asked.groupBy(F.col("q.asked").alias("pair")).agg(F.sum("q.documents").alias("n_docs"))
    counted = counted.withColumn("a", F.shiftright("pair", B_BITS)).withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    # one row for each id of the first vocabulary at most
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(F.broadcast(most), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


_MEASURED = "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _weigh(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of one chunk with the sums over their links."""
    pairs = answers.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs, counts, best = pairs[order], answers.column("n_docs").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for own, times in zip(texts.column("pairs"), texts.column("times"), strict=True):
        at, k = np.searchsorted(pairs, np.cumsum(np.frombuffer(own.as_py(), dtype=np.int64))), np.frombuffer(times.as_py(), dtype=np.int32).astype(np.int64)
        n_best.append(int(k[best[at]].sum()) if len(k) else 0)
        count_sum.append(int((k * counts[at]).sum()) if len(k) else 0)
    kept = texts.select(["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def measure(docs: DataFrame, vocabulary_file: str, pattern: str, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The measures of every text: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each input row.

    * a null or empty text, and one whose tokens of either side spell other bytes than a space and the text, has zeros and the digest ``''``;
    * repeated rows and copies are documents of their own in the counts; rows without identifier keep their row;
    * an empty table gives an empty one; other columns are ignored.

    Measures come back to the identifiers by the SHA-256 digest of the text.
    """
    aligned = aligned_texts(docs, vocabulary_file, pattern, model_file, text_col, chunk_bytes)
    asked = aligned.where(F.col("asked").isNotNull()).select(F.col("chunk").alias("home"), F.explode("asked").alias("pair"))
    answers = asked.join(pair_counts(aligned).select("pair", "n_docs", "best"), "pair")
    texts = aligned.where(F.col("asked").isNull()).drop("asked", "documents")
    weighed = texts.groupBy("chunk").cogroup(answers.groupBy("home")).applyInArrow(_weigh, _MEASURED)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("digest"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    numbers = [zero(n) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(weighed, "digest", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
