"""Quality rules with cross-document line frequency, with DataFrame functions only.

Words are ``[^\\x20\\x09-\\x0D]+``. The base rules are counts within a text. Beyond them,
lines are normalised (``line_dedup.normal_form``) and hashed, and for each host the
documents that hold a line are counted. A line is above the limit if it is in at least
``MIN_DOCS`` documents of its host and in more than ``MAX_SHARE`` of them. Lines above
the limit are removed; a document is depleted, and rejected, if they make up more than
half of its characters.

The host of a document is its column ``source``; null is a host of its own. Null texts
have no words and fail the base rules. Lines without a word are neither counted nor
removed. A document is its doc_id, or the hash of its text where that is null: rows that
share it count once, for lines as for hosts, and each row gets its own verdict. Other columns
are kept by ``apply_rules``, whatever their names, and ignored by ``assess``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import normal_form
from .storage import materialise

MIN_DOCS, MAX_SHARE, MIN_WORDS = 5, 0.1, 50
_SPACES = "\t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES + " ", "")) > 0)
    step = docs.withColumns(
        {
            "_words": F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), ""),
            "word_chars": F.length(F.translate(text, _SPACES + " ", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
            "_lines": lines,
        }
    )
    word = lambda i: F.get(F.col("_words"), i)
    windows = F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": windows,
        }
    ).drop("_lines", "_words")
    # sorted with their places, equal windows are neighbours; most texts have none
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    same = lambda x, j: F.coalesce(F.get(F.col("_sorted"), j)["h"] == x["h"], F.lit(False))
    found = F.sort_array(F.transform(F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    step = step.withColumn("_at", found).drop("_sorted")
    fresh = F.transform("_at", lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get(F.col("_at"), j - 1))))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_at")
    # the row number keeps filters on the verdict above these columns: pushed below, they would be computed anew for each word
    step = step.withColumn("_row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.withColumn("base_failed", failed & (F.col("_row") >= 0)).drop("_row")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, host, place, line, chars) of the lines with a word; line is the hash."""
    each = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.xxhash64("source").alias("host"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    norm = each.withColumn("_norm", normal_form(F.col("line"))).filter("_norm <> ''")
    return norm.select("doc", "text_hash", "host", "place", F.xxhash64("_norm").alias("line"), F.length("line").alias("chars"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line) hashes of the lines above the limit."""
    norm = F.transform(F.split("text", "\n"), normal_form)
    held = F.array_distinct(F.transform(F.filter(norm, lambda x: x != ""), lambda x: F.xxhash64(x)))
    host, document = F.xxhash64("source").alias("host"), F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).alias("document")
    counts = docs.select(host, document, F.explode(held).alias("line")).groupBy("host", "line").agg(F.count_distinct("document").alias("n")).filter(F.col("n") >= min_docs)
    hosts = docs.select(host, document).groupBy("host").agg(F.count_distinct("document").alias("docs"))
    return counts.join(hosts, "host").filter(F.col("n") > max_share * F.col("docs")).select("host", "line")


def _removed(docs: DataFrame, limits: dict) -> DataFrame:
    """(doc, text_hash, place, chars) of the lines to remove, once each."""
    frequent = materialise(frequent_lines(docs, **limits))
    return _lines(docs).join(frequent, ["host", "line"], "left_semi").select("doc", "text_hash", "place", "chars").distinct()


def _sound(total: Column, removed: Column) -> Column:
    return 2 * F.coalesce(removed, F.lit(0)) <= total


def assess(docs: DataFrame, **limits) -> DataFrame:
    """Per document row: doc_id, the base counts, base_failed, kept, n_lines_removed, removed_chars."""
    gone = _removed(docs, limits).groupBy("doc", "text_hash").agg(F.count("*").alias("n_lines_removed"), F.sum("chars").alias("removed_chars"))
    rows = base_counts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.length(F.coalesce("text", F.lit(""))).alias("_chars"))).drop("text")
    on = rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["text_hash"] == gone["text_hash"])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.join(gone, on, "left").select(
        *names,
        (~F.col("base_failed") & _sound(F.col("_chars"), F.col("removed_chars"))).alias("kept"),
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        F.coalesce("removed_chars", F.lit(0)).cast("long").alias("removed_chars"),
    )


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, without their lines above the limit; n_chars, if there, is counted anew."""
    gone = _removed(docs, limits).groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places"), F.sum("chars").alias("removed"))
    # the input's columns travel in one struct, so that none of their names can clash
    passed = base_counts(docs.select(F.struct(*docs.columns).alias("row"), "text")).filter(~F.col("base_failed")).select("row")
    keyed = passed.select("row", F.col("row.doc_id").alias("own_doc"), F.xxhash64("row.text").alias("own_hash"))
    joined = keyed.join(gone, keyed["own_doc"].eqNullSafe(gone["doc"]) & (keyed["own_hash"] == gone["text_hash"]), "left").filter(_sound(F.length("row.text"), F.col("removed")))
    kept = F.filter(F.transform(F.split("row.text", "\n"), lambda x, i: F.when(~F.array_contains("places", i), x)), lambda x: x.isNotNull())
    out = joined.select("row", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
