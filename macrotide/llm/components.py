"""Links between similar things and their connected components, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise

#: Buckets of more members than this are thinned out in rounds before the final comparison.
CROWD = 8
#: Partners that each member of such a bucket meets in a round, and the share of them that must be
#: linked for another round to pay.
PARTNERS, PAYS = 6, 0.1


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable from each id that has an edge; edges has the long columns a and b.

    Distributed union-find by alternating large-star and small-star rounds: every
    round hangs neighbours below the least one, and the number of rounds grows with
    the logarithm of the longest path. Each round is a written table, so lineage stays
    short; the one before it is deleted. Empty edges give an empty table.
    """
    mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = now.agg(*mark).first()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = large.filter("a <> b").distinct()
        # small star: only the smaller neighbours, and the node itself, hang below the least
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(now)
        now, before, seen = after, seen, after.agg(*mark).first()
        if seen == before:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    named = materialise(roots.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()))
    discard(now)
    return named


def similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs (a, b); features: (id, items) with distinct items."""
    left = features.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = features.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard"))


def parity_sketches(features: DataFrame, longs: int) -> DataFrame:
    """(id, size, s0, s1, ...): each item flips one of 64 * longs bits, so that the bits in which
    two sketches differ are at most as many as the items that only one of the two sets has.
    Rows that share an id keep a sketch each."""
    rows = features.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("id", "_row", F.size("items").alias("size"), F.explode("items").alias("h")).withColumn("h", F.xxhash64("h"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 16) & 63 as int))")
    word = F.pmod("h", F.lit(longs))
    flips = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(longs)]
    return each.groupBy("id", "_row", "size").agg(*flips).drop("_row")


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links (a, b); the tables of both are deleted."""
    after = connected(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b")))
    discard(roots, links)
    return after


def _may_link(threshold: float, longs: int):
    """Of rows x and y of one bucket: in different components, and no bound rules a link out."""
    pivot = F.abs(F.col("x.near") - F.col("y.near")) <= 1 - threshold + 1e-9
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(longs)), F.lit(0))
    close = differ <= (F.col("x.size") + F.col("y.size")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    return (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & pivot & close


def _pairs(x: DataFrame, y: DataFrame, on) -> DataFrame:
    return x.alias("x").join(y.alias("y"), on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _meetings(open_: DataFrame, turn: int, may_link) -> DataFrame:
    """Pairs (a, b) of members of one bucket but different components that meet in a slot.

    Each member takes ``PARTNERS`` random slots of its bucket, which has half as many slots as
    members, so a round forms a few pairs for each member, whatever the bucket's size.
    """
    tries = open_.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(PARTNERS - 1))))
    slotted = tries.withColumn("slot", F.pmod(F.xxhash64("id", "t", F.lit(turn)), (F.col("n") / 2).cast("long")))
    return _pairs(slotted, slotted, (F.col("x.t") == F.col("y.t")) & (F.col("x.slot") == F.col("y.slot")) & may_link)


def similar_components(
    buckets: DataFrame, features_of, threshold: float, longs: int = 16, one_exchange: bool = False, paired: int = 1, crowd: int = CROWD
) -> DataFrame:
    """(id, root) of all ids that are linked: those that share a bucket and have Jaccard of ``threshold`` or more.

    buckets: (bucket, id), long, distinct. features_of(ids) gives (id, items) for a table of ids.
    No group is expanded into all its pairs. First each member is compared with the
    least id of its bucket. In crowded buckets, members that this leaves in different
    components meet random partners, a few in each round, as long as enough of them are linked: a
    group of near copies grows together in a few rounds, however large it is. Last,
    members of one bucket that are still in different components are
    candidates, unless a bound rules a link out: the triangle inequality
    of the Jaccard distance with the least id as the pivot, or the parity sketches (of
    ``longs`` times 64 bits), which differ in no more bits than the sets in items. Both
    bounds are exact and part of the join's condition, so only pairs that are linked or
    nearly so become rows, and every pair of one bucket that could be linked is either
    compared or already connected.

    one_exchange: for many buckets of one member, of which little is left. The rows are dealt and sorted by
    bucket once, and a window counts them; a hot bucket's rows then
    pass through one task, 16 bytes each.

    paired: in buckets of up to as many members, all are compared with each other in the first step, not
    only with the least; these buckets are done with then. crowd: in buckets of more than as many, members
    meet random partners before the last comparison.
    """
    if one_exchange:
        whole = Window.partitionBy("bucket")
        counted = buckets.select("bucket", F.min("id").over(whole).alias("a"), F.count("*").over(whole).alias("n"), "id")
        members = materialise(counted.filter("n > 1"))
    else:
        # the least ids are aggregated before the shuffle and joined back, so a hot bucket's rows can be split over tasks
        shared = materialise(buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1"))
        members = materialise(buckets.join(shared, "bucket").select("bucket", "a", "n", "id"))
        discard(shared)
    features = materialise(features_of(members.select("id").distinct()))
    others = members.filter("a <> id")
    star = others.select("a", F.col("id").alias("b"))
    if paired > 2:
        few = others.filter(F.col("n").between(3, paired))
        star = star.unionByName(_pairs(few, few, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id"))))
    first = materialise(similarity(star.distinct(), features))
    roots = connected(first.filter(F.col("jaccard") >= threshold).select("a", "b"))
    # members of buckets that lie in one component are done with
    larger = members.filter(F.col("n") > paired)
    placed = _with_roots(larger.join(first.withColumnRenamed("b", "id"), ["a", "id"], "left").withColumn("near", F.coalesce("jaccard", F.lit(1.0))), roots)
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    left = materialise(placed.join(mixed, "bucket").select("bucket", "n", "id", "near"))
    sought = features.join(left.select("id").distinct(), "id", "left_semi")
    if paired > 1:  # few are left: from here on, only their sets are dealt out
        sought = materialise(sought)
        discard(features)
        features = sought
    sketched = materialise(left.join(parity_sketches(sought, longs), "id"))
    discard(left, members)
    may_link, turn, pays = _may_link(threshold, longs), 0, True
    while pays:
        met = materialise(similarity(_meetings(_with_roots(sketched.filter(F.col("n") > crowd), roots), turn, may_link), features))
        links = materialise(met.filter(F.col("jaccard") >= threshold))
        found, turn = links.count(), turn + 1
        pays = found > PAYS * met.count()
        discard(met)
        if found:
            roots = _merged(roots, links)
        else:
            discard(links)
    rest = materialise(_with_roots(sketched, roots))
    second = _pairs(rest, rest, may_link).join(first, ["a", "b"], "left_anti")
    more = materialise(similarity(second, features).filter(F.col("jaccard") >= threshold))
    discard(rest, sketched, features, first)
    if more.isEmpty():
        discard(more)
        return roots
    return _merged(roots, more)
