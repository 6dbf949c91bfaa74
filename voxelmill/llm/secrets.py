"""Secret scan by corpus-wide ownership frequency.

Each text is scanned once for candidates; only their places and hashes go on. Every hash
is then counted over the whole corpus by distinct repositories and owners: a value that
several owners hold is a copied example, one that a single owner holds and that looks
drawn at random is a live credential. The counts decide which of the loose candidates
(strings without a telling name or form) are secrets at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.words import pieces
from voxelmill.session import cut_lineage

#: Kinds that count by form alone, in the order in which spans with the same start are listed.
BASE = ("assign", "access", "hex")
#: Kinds of the method: a known vendor's form, and any string that looks drawn at random.
ADDED = ("vendor", "random")
KINDS = BASE + ADDED

#: Pattern, group that is the secret itself, least length of that group. Alternatives and lengths are tried after the match, so that a match that fails isn't shortened into one that passes.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # a run of so many is the whole of a maximal run, as no shorter one can be
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
    # How the tokens of some public services and signed web tokens begin.
    "vendor": (re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG\.|npm_|eyJ)[A-Za-z0-9_.-]+"), 0, 24),
    "random": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 0, 20),
}
#: A value held by so many owners is an example that people copy.
EXAMPLE_OWNERS = 3
#: Least bits a character for a string that looks drawn at random, and the longest such string.
LEAST_BITS, MOST_CHARS = 3.5, 256
#: Words that name a value as a stand-in. Fixed values.
STAND_INS = ("example", "changeme", "dummy", "placeholder", "your", "test", "sample", "xxxx", "1234567890")

_SPAN = "struct<kind:string,start:int,end:int,value_hash:binary,random:boolean,stand_in:boolean>"


def bits_per_char(value: str) -> float:
    """Entropy of a string's own characters."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Lower and upper case and digits mixed (or long hex), no long words inside, and many different characters for its length."""
    if not 16 <= len(value) <= MOST_CHARS:
        return False
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return bits_per_char(value) >= 3.0
    mixed = all(re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return mixed and not re.search(r"[a-z]{8}|[A-Z]{12}", value) and bits_per_char(value) >= LEAST_BITS


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of every candidate of a text, by start and then kind; a loose one that a stricter one covers is left out."""
    found = []
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "random":
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    pattern, _, _ = PATTERNS["random"]
    loose = [("random", m.start(), m.end(), m[0]) for m in pattern.finditer(text) if looks_random(m[0])]
    if loose:
        strict = sorted((start, end) for _, start, end, _ in found)
        reach, k = 0, 0
        for one in loose:  # both in order of their starts
            while k < len(strict) and strict[k][0] <= one[1]:
                reach, k = max(reach, strict[k][1]), k + 1
            if reach < one[2]:
                found.append(one)
    return sorted(found, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.binary()), ("random", pa.bool_()), ("stand_in", pa.bool_())]
    kind_of = pa.list_(pa.struct(fields))
    for batch in pieces(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            rows.append(
                [
                    {
                        "kind": kind,
                        "start": start,
                        "end": end,
                        "value_hash": hashlib.blake2b(value.encode(), digest_size=16).digest(),
                        "random": looks_random(value),
                        "stand_in": any(word in value.lower() for word in STAND_INS),
                    }
                    for kind, start, end, value in candidates(text or "")
                ]
            )
        columns = [batch.column(n) for n in ("doc_id", "owner", "repository")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, type=kind_of)], names=["doc_id", "owner", "repository", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, n_owners, n_repositories, n_places`` of every candidate value of ``value_hash, owner, repository`` rows.

    A missing owner or repository is one of its own. Rows are first reduced to distinct
    (value, owner, repository), so that a value copied into a third of the corpus has
    been counted in the tasks that found it before anything meets.
    """
    per_repository = found.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    per_owner = per_repository.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("places").alias("places"))
    return per_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("places").alias("n_places"))


def verdict(n_owners: Column, random: Column, stand_in: Column) -> Column:
    """``example`` if several owners hold the value or it names itself a stand-in, ``live`` if one owner does and it looks drawn at random, else ``unclear``."""
    return F.when(stand_in | (n_owners >= EXAMPLE_OWNERS), "example").when((n_owners == 1) & random, "live").otherwise("unclear")


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text: ``doc_id, spans``, one row for each input row.

    ``spans`` is an array of ``kind, start, end, value_hash, verdict, n_owners,
    n_repositories`` by start and then kind; places are code points, ends exclusive. Spans
    of the base kinds are all there, whatever their verdict; vendor forms are there unless
    they are examples, and loose strings only if they are live.

    * a null or empty text has no spans; rows without identifier keep their row;
    * repeated rows are told apart, each with its spans; they are one repository, so they add no owner;
    * an empty table gives an empty one; other columns, ``owner`` and ``repository`` among them, may clash freely.

    The values themselves never leave the task that found them, only 128-bit hashes do.
    """
    taken = docs.select(F.col(id_col).alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col(text_col).alias("text"))
    id_type = taken.schema["doc_id"].dataType.simpleString()
    scanned = taken.mapInArrow(_scan, f"doc_id {id_type}, owner string, repository string, found array<{_SPAN}>")
    # written, so that row numbers stand and the texts are read once
    rows = cut_lineage(scanned).withColumn("row", F.monotonically_increasing_id())
    places = rows.select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*")
    counted = places.join(ownership(places), "value_hash")
    span = F.struct("start", "kind_at", "end", "kind", "value_hash", "verdict", "n_owners", "n_repositories")
    kept = (F.col("kind").isin(*BASE)) | ((F.col("kind") == "vendor") & (F.col("verdict") != "example")) | ((F.col("kind") == "random") & (F.col("verdict") == "live"))
    judged = (
        counted.withColumn("verdict", verdict(F.col("n_owners"), F.col("random"), F.col("stand_in")))
        .where(kept)
        .withColumn("kind_at", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(span)).alias("told"))
    )
    plain = lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "start", "end", "value_hash", "verdict", "n_owners", "n_repositories")])
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value_hash:binary,verdict:string,n_owners:bigint,n_repositories:bigint>>")
    return rows.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce(F.transform("told", plain), none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
