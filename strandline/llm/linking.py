"""Links into groups: connected components, and the pairs of bucketed members that decide them.

Both work on tables in the shared folder and never on the driver; a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut, sieve, sieve_bits, sift


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row a key, over an exchange of both sides, so that adaptive execution splits hot keys of `left`.

    Joined on a hash besides the keys: an aggregate's own partitioning, which could not be split, then doesn't serve.
    """
    a = left.withColumn("_jk", F.xxhash64(*keys))
    b = right.withColumn("_jk", F.xxhash64(*keys))
    return a.join(b, ["_jk", *keys], how).drop("_jk")


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): one row per vertex, id and component (its smallest id).

    Large-star and small-star steps in turn until nothing changes: a number of rounds in the logarithm of the longest
    path, each of two aggregations. Edges with a null end or equal ends link nothing.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    e = cut(edges.where("a is not null and b is not null and a <> b").select(u, v).distinct(), "edges")
    seen = _sum(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = cut(small.where("u <> v").distinct(), "edges")
        drop_cut(e)
        e, before, seen = new, seen, _sum(new)
        if seen == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Buckets of at most so many members give all their open pairs at once: at most half as many as this for each member.
SMALL = 16


def live_buckets(members: DataFrame, head: Column | None = None) -> DataFrame:
    """bucket, id, size, n (members) and head (of id and size; by default the smallest id) of the buckets that more than one id shares; cut.

    `members` has bucket, id and size, each id once a bucket. A bitmap of the shared buckets comes first, so that members
    of others are not shuffled; buckets with the same members count once.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("id") if head is None else head).alias("head"), F.bit_xor(F.xxhash64("id")).alias("mark")).where("n > 1")
    sizes = cut(sizes.groupBy("n", "head", "mark").agg(F.min("bucket").alias("bucket")).drop("mark"), "sizes")
    bits = sieve_bits(sizes.count())
    near = sift(members, F.col("bucket"), sieve(sizes, F.col("bucket"), bits), "hit", bits).where("hit").select("bucket", "id", "size")
    live = cut(spread_join(near, sizes, ["bucket"]), "buckets")
    drop_cut(sizes)
    return live


def link_groups(live: DataFrame, confirm: Callable[[DataFrame], DataFrame], within: Callable[[DataFrame], DataFrame], fits: Callable[[Column, Column], Column], block: int, weight: Callable[[Column], Column] = lambda size: F.lit(1)) -> DataFrame:
    """Components of the links among bucket mates (live_buckets): id, component, for ids with a link.

    Every pair of one bucket for which fits(size, size) holds is confirmed, refused, or left out because its ends are in
    one component already; so no link is lost that matters. First each member meets one head, the smallest of its buckets'
    heads, by confirm(pairs a, b) -> links a, b; as a rule that makes a bucket one component. Of the buckets that are still
    mixed small ones give their open pairs, and in large ones members meet their own bucket's head. Large ones that stay
    mixed even then are dealt in blocks of about `block` by weight(size), each block meeting each other once, and within(rows) -> links a, b looks at the pairs
    of different labels in place: no row is sent for a pair that isn't a link. Its rows have bucket, i, j (the blocks that
    meet), part (i or j: pairs of one part count only where i = j), id, size and label.
    """
    heads = live.where("id = head").select("bucket", F.col("size").alias("head_size"))
    star = spread_join(live.where("id <> head"), heads, ["bucket"]).where(fits(F.col("size"), F.col("head_size"))).groupBy("id").agg(F.min("head").alias("head"))
    first = cut(star.select(F.col("head").alias("a"), F.col("id").alias("b")), "pairs")
    links = cut(confirm(first), "links")
    rest = _mixed(live, components(links))
    if not rest.isEmpty():
        heads = rest.where("id = head").select("bucket", F.col("size").alias("head_size"), F.col("label").alias("head_label"))
        star = spread_join(rest.where(F.col("n") > SMALL).where("id <> head"), heads, ["bucket"]).where(fits(F.col("size"), F.col("head_size")) & (F.col("label") != F.col("head_label")))
        little = rest.where(F.col("n") <= SMALL)
        other = little.select("bucket", F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b"))
        open_ = little.join(other, "bucket").where((F.col("id") < F.col("b")) & (F.col("label") != F.col("label_b")) & fits(F.col("size"), F.col("size_b")))
        ordered = [F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")]
        pairs = star.select(*ordered).unionByName(open_.select(F.col("id").alias("a"), "b")).distinct()
        seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = cut(links.unionByName(confirm(pairs.join(seen, ["a", "b"], "left_anti"))), "links")
    found = components(links)
    rest = _mixed(rest.where(F.col("n") > SMALL), found)
    if rest.isEmpty():
        return found
    totals = rest.groupBy("bucket").agg(F.ceil(F.sum(weight(F.col("size"))) / block).cast("int").alias("blocks"))
    dealt = spread_join(rest, totals, ["bucket"]).withColumn("part", F.pmod(F.xxhash64("bucket", "id"), "blocks").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part", "id", "size", "label")
    return components(_edges(found).unionByName(within(dealt)))


def _edges(found: DataFrame) -> DataFrame:
    """Links that make the same components: each member's to its component's smallest id."""
    return found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _mixed(live: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with label (component or own id), of the buckets in which more than one label is left; cut."""
    columns = ["bucket", "id", "size", "n", "head"]
    labelled = spread_join(live.select(*columns), found, ["id"], "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return cut(spread_join(labelled, mixed, ["bucket"]).select(*columns, "label"), "mixed")
