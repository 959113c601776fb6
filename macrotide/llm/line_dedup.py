"""Line dedup by MinHash of character shingles, with DataFrame functions only.

A line is a part of the text between line feeds. Its normal form is lower-case, with
each run of white space one space, trimmed. Lines with a normal form of ``min_chars``
characters or more take part, by default all but blank lines.
The character shingles of a line are the ``SHINGLE`` characters from each of its characters on,
as far as there are that many; a shorter line is one shingle.

Lines are signed within the scan: each gets 16 minima of its shingle hashes, permuted by
rotation and exclusive-or with fixed numbers, and equal normal forms are one line from
the first shuffle on, which moves keys and minima but no text. The minima are the points of the
affine plane of order 4 and 18 of its 20 lines are the bands: 4 minima each, of which two bands
share one at most. Two lines of similarity 0.8 share a band with a
probability of 0.99 or more, as measured over random pairs. Lines that share a band are
verified by the Jaccard similarity of their whole shingle sets (0.8 or more), of which 32 bits of each shingle's
hash are compared: sets of 100,000 shingles agree in about one more by chance. Linked lines are joined by
distributed union-find (``components``). Of each component the first occurrence stays,
in the order of doc_id and line number; all other occurrences are removed.

Null and empty texts have no line that takes part. A null doc_id comes first. A document is
its doc_id (or null) and the hash of its text: rows that share a doc_id but not the text are
documents of their own, in the order of that hash, and rows equal in both are one document,
with the same lines removed. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import similar_components
from .storage import NULL_ID, discard, materialise

MIN_CHARS, SHINGLE, THRESHOLD = 1, 8, 0.8
#: Minima of a band, and values of each coordinate of the plane of minima.
WIDTH = 4
#: Products in the field of four elements, whose sum is exclusive-or.
_TIMES = ((0, 0, 0, 0), (0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 1, 2))
#: Shingles that are hashed side by side before a row of them reaches the minima. At 32 the generated
#: method passes the 8,000 bytes above which the JVM leaves code interpreted.
STEP = 16
#: In buckets of up to ``PAIRED`` lines all are compared with each other at once; of more than ``CROWD``, random partners meet first.
PAIRED, CROWD = 8, 32
#: A character is as many bytes in the form that shingles are cut from, whatever it is.
_BYTES = 4


def normal_form(line: Column) -> Column:
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    plain = F.lower(line)  # few lines need the pattern
    return F.trim(F.when(odd, F.regexp_replace(plain, r"[ \t\x0b\f\r]+", " ")).otherwise(plain))


def codes(norm: Column) -> Column:
    """The characters of a line as binary of fixed width."""
    return F.encode(norm, "UTF-32")


def shingle_hash(code: Column, at: Column) -> Column:
    """The hash of the shingle that starts at the character ``at`` (from 0)."""
    return F.xxhash64(F.substr(code, _BYTES * at + 1, F.lit(_BYTES * SHINGLE)))


def shingle_rows(coded: DataFrame, *keep: str) -> DataFrame:
    """Of rows with chars and code: the columns of ``keep``, first (whether the line begins here) and
    h0, h1, ..., the hashes of ``STEP`` shingles side by side; past the last shingle that one is repeated."""
    ended = coded.withColumn("last", F.greatest(F.col("chars") - SHINGLE, F.lit(0)))
    starts = ended.select(*keep, "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    hashes = [shingle_hash(F.col("code"), F.least(F.col("i") + g, F.col("last"))).alias(f"h{g}") for g in range(STEP)]
    return starts.select(*keep, (F.col("i") == 0).alias("first"), *hashes)


_HASHES = [f"h{g}" for g in range(STEP)]


def _seed(i: int) -> int:
    """Fixed random numbers from a linear congruential rule."""
    x = 0x2545F4914F6CDD1D
    for _ in range(i + 2):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
    return x - 2**63


def _mask(i: int) -> int:
    """Random but for the two upper bits, which differ among the minima of one rotation: in that order each begins with other hashes."""
    x = (_seed(i) & (2**62 - 1)) | (i % WIDTH) << 62
    return x - 2**64 if x >= 2**63 else x


def _permuted(h: Column, i: int) -> Column:
    by = 16 * (i // WIDTH)
    turned = F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h
    return turned.bitwiseXOR(F.lit(_mask(i)))


def band_members() -> list[list[int]]:
    """Which minima each band takes: the points of a line y = slope * x + b of the plane, one of each
    rotation, and of the lines x = 0 and x = 1."""
    sloped = [[WIDTH * x + (_TIMES[slope][x] ^ b) for x in range(WIDTH)] for slope in range(WIDTH) for b in range(WIDTH)]
    return sloped + [[WIDTH * x + y for y in range(WIDTH)] for x in (0, 1)]


def row_key() -> list[Column]:
    """What tells documents apart: doc_id, with a place for null, and the hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("text_hash")]


def _line_keys() -> list[Column]:
    return [F.xxhash64("norm").alias("k1"), F.hash("norm", F.lit(7)).alias("k2"), F.length("norm").alias("chars")]


def signed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, n, bands) of the distinct lines that take part; n counts the occurrences."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(normal_form(F.col("line")).alias("norm"))
    rows = shingle_rows(lines.select(*_line_keys(), codes(F.col("norm")).alias("code")), "k1", "k2", "chars")
    counted = F.sum((F.col("first") & (F.col("chars") >= min_chars)).cast("long")).alias("n")
    minima = [F.min(F.least(*(_permuted(F.col(h), m) for h in _HASHES))).alias(f"m{m}") for m in range(WIDTH * WIDTH)]
    # all of fixed width: summed up by hash within the scan, then once for each line
    summed = rows.groupBy("k1", "k2").agg(counted, *minima).filter("n > 0")
    bands = [F.xxhash64(F.lit(b), *(f"m{m}" for m in taken)) for b, taken in enumerate(band_members())]
    return summed.select("k1", "k2", "n", F.array(*bands).alias("bands"))


def shingle_sets(lines: DataFrame) -> DataFrame:
    """(node, items): the distinct shingle hashes of each node's line; lines: (node, norm), one row for each node."""
    coded = lines.select("node", codes(F.col("norm")).alias("code"), F.greatest(F.length("norm") - SHINGLE, F.lit(0)).alias("last"))
    # half of each hash does: the sets that are compared are small, and the table of them is not
    # the line is an argument itself, else it is copied out of its row for each shingle
    each = F.transform(F.array("code"), lambda c: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.shiftright(shingle_hash(c, i), 32).cast("int")))
    return coded.select("node", F.array_distinct(each[0]).alias("items"))


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, place, chars) of the line occurrences to remove, once each."""
    # written, a line keeps its number
    signed = materialise(signed_lines(docs, min_chars).withColumn("node", F.monotonically_increasing_id()))
    held: list[DataFrame] = []

    def features(nodes: DataFrame) -> DataFrame:
        """Finds, in one more scan, the occurrences of all lines that may matter, with the texts of candidates."""
        asked = nodes.select(F.col("id").alias("node"), F.lit(True).alias("candidate"))
        wanted = materialise(signed.join(asked, "node", "left").filter("n > 1 OR candidate").select("k1", "k2", "node", "n", "candidate"))
        lines = docs.select(*row_key(), F.posexplode(F.split("text", "\n")).alias("place", "line")).select("id", "text_hash", "place", normal_form(F.col("line")).alias("norm"))
        found = lines.select("id", "text_hash", "place", *_line_keys(), "norm").join(wanted.hint("shuffle_hash"), ["k1", "k2"])
        held.append(materialise(found.select("node", "n", "id", "text_hash", "place", "chars", F.when(F.col("candidate"), F.col("norm")).alias("norm"))))
        discard(wanted)
        texts = held[0].filter("norm IS NOT NULL")
        again = texts.filter("n > 1").groupBy("node").agg(F.any_value("norm").alias("norm"))
        return shingle_sets(texts.filter("n = 1").select("node", "norm").unionByName(again)).withColumnRenamed("node", "id")

    roots = similar_components(signed.select(F.explode("bands").alias("bucket"), F.col("node").alias("id")), features, threshold, one_exchange=True, paired=PAIRED, crowd=CROWD)
    linked = roots.withColumnRenamed("id", "node")
    rows = held[0].drop("norm").join(linked, "node", "left").filter("n > 1 OR root IS NOT NULL")
    rows = rows.select(F.coalesce("root", "node").alias("root"), "id", "text_hash", "place", "chars")
    stays = rows.groupBy("root").agg(F.min(F.struct("id", "text_hash", "place")).alias("stays"))
    gone = rows.join(stays, "root").filter(F.struct("id", "text_hash", "place") != F.col("stays")).select("id", "text_hash", "place", "chars").distinct()
    gone = materialise(gone)
    discard(signed, roots, *held)
    return gone


def report(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, removed_chars (of the normal forms)."""
    gone = repeated_lines(docs, threshold, min_chars).groupBy("id", "text_hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"), *row_key())
    return keyed.join(gone, ["id", "text_hash"], "left").select("doc_id", "n_lines", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("chars", F.lit(0)).cast("long").alias("removed_chars"))


def remove(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the removed lines; all other columns as they are (n_chars, if any, is counted anew)."""
    gone = repeated_lines(docs, threshold, min_chars).groupBy("id", "text_hash").agg(F.collect_list("place").alias("places"))
    # the input's columns travel in one struct, so that none of their names can clash
    keyed = docs.select(*row_key(), F.struct(*docs.columns).alias("row")).join(gone, ["id", "text_hash"], "left")
    kept = F.filter(F.transform(F.split("row.text", "\n"), lambda x, i: F.when(~F.array_contains("places", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    changed = keyed.select("row", text.alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return changed.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
