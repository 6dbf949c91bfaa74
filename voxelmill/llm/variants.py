"""Spelling variants by an index of grams of variable length.

Words at distance one (a code point inserted, deleted or replaced) are found by the grams
they share. The gram dictionary is pruned by frequency: from every place of a word a gram
of two code points is lengthened, up to ``longest``, while it is a frequent one, so that
lists of rare grams stay and crowded ones are split. A word's decomposition has one gram
for each place but the last.

One edit changes only the grams whose making looked at the edited place. The most grams
that any single edit of a word can reach is its bound of affected grams: the rest, one at
least, are the same in every near word, at the same distance from the start or from the
end. So of a word's grams its (bound + 1) rarest are enough: two near words share one of
them, in any fixed order of all grams. Their lists are merged by an equi-join on gram,
place and length, and every pair that meets is verified.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.session import cut_lineage

#: Most frequent grams in the dictionary: a gram is frequent if it makes up more than one in so many of all grams, so there can't be more.
MOST_FREQUENT = 1 << 16
#: A gram is never frequent below this count.
LEAST_FREQUENT = 64
#: Longest gram, and what a word must have more than that, so that one gram at least outlives any edit.
LONGEST, SHORTEST = 4, 2
#: Code points up to which Spark's bounded edit distance is the faster check; its time grows with the square of the length.
BOUNDED_CHARS = 255


def runs(text: Column, characters: str, least: int) -> Column:
    """Maximal runs of at least ``least`` of the characters, in order; A-Z are lowered, nothing else is."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"[{characters}]{{{least},}}"), F.lit(0))


def count_words(words: DataFrame, least_chars: int, least_count: int) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough; a null word is none."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, longest: int) -> dict[str, int]:
    """Counts of the frequent grams over distinct words; at most ``MOST_FREQUENT`` of them, however many words there are."""
    total = sum((F.greatest(F.length("word") - (q - 1), F.lit(0)) for q in range(SHORTEST, longest + 1)), F.lit(0))
    limit = max(LEAST_FREQUENT, (words.agg(F.sum(total)).first()[0] or 0) // MOST_FREQUENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(w[p : p + q] for w in batch.column(0).to_pylist() for q in range(SHORTEST, longest + 1) for p in range(len(w) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "k"])

    grams = words.select("word").mapInArrow(run, "gram string, k long").groupBy("gram").agg(F.sum("k").alias("k"))
    return {r.gram: r.k for r in grams.where(F.col("k") > limit).collect()}


def decompose(word: str, frequent: dict[str, int], longest: int) -> tuple[list[str], int]:
    """The gram that begins at each place of a word but the last, and the most of them that one edit can change."""
    size, grams = len(word), []
    # how many more grams have looked at a place than at the one before; the place after the last stands for the word's end
    step = [0] * (size + 2)
    for p in range(size - 1):
        e = p + SHORTEST
        while e < size and e - p < longest and word[p:e] in frequent:
            e += 1
        gram = word[p:e]
        grams.append(gram)
        stopped_at_end = e - p < longest and gram in frequent
        step[p] += 1
        step[(size if stopped_at_end else e - 1) + 1] -= 1
    most = at = 0
    for change in step:
        at += change
        most = max(most, at)
    return grams, most


def signature(word: str, frequent: dict[str, int], longest: int) -> list[tuple[str, int]]:
    """The grams of a word whose lists are merged, with their places: one more than an edit can change, the rarest first."""
    grams, most = decompose(word, frequent, longest)
    order = sorted(range(len(grams)), key=lambda p: (frequent.get(grams[p], 0), grams[p], p))
    return [(grams[p], p) for p in order[: most + 1]]


def one_edit(a: Column, b: Column) -> Column:
    """Whether ``b``, no shorter than ``a``, is ``a`` with one code point replaced or inserted; in time linear in the length."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), True)
    at = F.when(differs == 0, F.length(a) + 1).otherwise(differs).cast("int")
    rest = lambda text, begin: F.substring(text, begin, F.length(text))
    replaced = (F.length(a) == F.length(b)) & (differs > 0) & (rest(a, at + 1) == rest(b, at + 1))
    return replaced | ((F.length(a) + 1 == F.length(b)) & (rest(a, at) == rest(b, at + 1)))


def near_pairs(words: DataFrame, least_chars: int = 6) -> DataFrame:
    """``a, n_a, b, n_b`` of all words of ``word, n`` that differ by one code point inserted, deleted or replaced, each pair once.

    ``words`` holds distinct words, none null, of at least ``least_chars`` (four at least) code points.
    """
    if least_chars < SHORTEST + 2:
        raise ValueError("words of under four code points have no gram that outlives an edit")
    longest = min(LONGEST, least_chars - 2)
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32())]))
        for batch in batches:
            made = [[{"gram": g, "at": p} for g, p in signature(w, frequent.value, longest)] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(made, type=kind)], names=["word", "n", "grams"])

    signed = words.select("word", "n").mapInArrow(run, "word string, n long, grams array<struct<gram:string,at:int>>")
    entries = cut_lineage(signed).select("word", "n", F.length("word").alias("size"), F.explode("grams").alias("g")).select("word", "n", "size", "g.gram", "g.at")

    # one edit leaves the first or the last half of the shorter word as it was: two hashes to compare before the edit is looked for
    def halves(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [F.xxhash64(F.substring("word", F.lit(1), half)), F.xxhash64(F.substring("word", F.length("word") - (size - half) + 1, F.length("word")))]

    own, shorter = halves(F.col("size")), halves(F.col("size") - 1)
    key = lambda at, size: F.xxhash64(F.col("gram"), at, size)
    lists = entries.select(key(F.col("at"), F.col("size")).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), own[0].alias("b_head"), own[1].alias("b_tail"), shorter[0].alias("b_head1"), shorter[1].alias("b_tail1"))
    # a gram before the edit keeps its place, one behind it moves by the code point that is inserted
    asked = F.explode(F.array(*[F.struct(key(F.col("at") + by, F.col("size") + more).alias("key"), F.lit(more == 1).alias("longer")) for by, more in ((0, 0), (0, 1), (1, 1))]))
    probes = entries.select(F.col("word").alias("a"), F.col("n").alias("n_a"), own[0].alias("a_head"), own[1].alias("a_tail"), asked.alias("q")).select("a", "n_a", "a_head", "a_tail", F.col("q.key").alias("q_key"), "q.longer")
    same_half = (~F.col("longer") & (F.col("a") < F.col("b")) & ((F.col("a_head") == F.col("b_head")) | (F.col("a_tail") == F.col("b_tail")))) | (
        F.col("longer") & ((F.col("a_head") == F.col("b_head1")) | (F.col("a_tail") == F.col("b_tail1")))
    )
    a, b = F.col("a"), F.col("b")
    verified = F.when(F.length(b) <= BOUNDED_CHARS, F.levenshtein(a, b, 1) == 1).otherwise(one_edit(a, b))
    met = probes.join(lists, (F.col("q_key") == F.col("key")) & same_half & verified)
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame, longest_chain: int) -> DataFrame:
    """``word, root`` for every ``word, form``: the last word that following forms leads to.

    Links are doubled, so that a chain of n forms takes log2(n) joins; ``longest_chain``
    bounds them. Forms must not run in a circle.
    """
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest_chain))))):
        links = cut_lineage(links)
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return links


def group_variants(words: DataFrame, least_chars: int = 6, ratio: int = 5) -> DataFrame:
    """The form and the root of every word of ``word, n``.

    Returns ``word, n, n_near, form, form_n, root``: ``n_near`` counts the words at
    distance one; ``form`` is the most frequent of them (of equals the first in
    code-point order) if it is at least ``ratio`` times as frequent as the word, else null.

    * words that are null or shorter than ``least_chars`` are no words; a word told twice counts with the sum of both;
    * an empty table gives an empty one; other columns are ignored;
    * no pair is lost: lists have no cap, a crowded list is split by Spark's skew join.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = cut_lineage(words.where(F.length("word") >= least_chars).groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = cut_lineage(near_pairs(words, least_chars))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("k")).unionAll(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("k")).alias("down"), "near")).alias("best"))
    top = -F.col("best.down")
    told = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(top >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(top >= ratio * F.col("n"), top).cast("long").alias("form_n"),
    )
    told = cut_lineage(told)
    ends = told.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    # every form is ``ratio`` times as frequent as its word
    chain = 1 if not ends.least else 1 + math.floor(math.log(ends.most / max(1, ends.least), ratio) + 1e-9)
    found = roots(told.where(F.col("form").isNotNull()), chain)
    return told.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
