"""Listings of several sources that are the same property: candidates by blocks, scores, one-to-one
assignment and merging.

A block is a city with one locality and number of bedrooms. For thresholds above 0.51 that loses nothing: two
localities that differ give 0.51 at most, two numbers of bedrooms 0.45. Listings that lack one of the two
fields meet those that agree in what both have: each listing comes once for each state that the other one may be in (with or
without locality, with or without bedrooms), so that every pair meets under one key of all that both have. How many of a
city lack the fields decides what that costs. Skewed keys are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.functions.columns import rounded
from loanloom.functions.graph import components
from loanloom.functions.lineage import cut, spread
from loanloom.operators.listings import empty, scored

if TYPE_CHECKING:
    import pyarrow as pa

#: Fields that a listing can take from another one, in order.
MERGEABLE = ("locality", "pincode", "bathrooms", "furnishing", "floor", "total_floors", "property_age", "parking", "price_inr", "price_per_sqft", "area_sqft", "bedrooms", "property_type")
LEAST = 0.6
#: Pairs of a component that one task walks through; larger components are taken by rounds.
MOST = 200_000
#: Listings of a city, of both sides, that one task of matched() takes; larger cities go by rounds until they have as few.
FEW = 2_000_000
#: Ids from 0 to below this one fit in a whole number together with a score of three places.
IDS = 1 << 52


def plain(text: Column) -> Column:
    """Lower case, without punctuation, single spaces; null where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")
    return F.nullif(clean, F.lit(""))


def match_score(a: str, b: str) -> Column:
    """0 to 1 for two listings whose columns have the prefixes a and b: locality, area, bedrooms and price, each
    where both have it, less where localities or bedrooms differ."""
    x, y = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    ratio = lambda n: F.when((x(n) > 0) & (y(n) > 0), F.least(x(n), y(n)) / F.greatest(x(n), y(n)))
    p, q = F.split(x("plain"), " "), F.split(y("plain"), " ")
    words = F.size(F.array_intersect(p, q)) / F.greatest(F.size(F.array_distinct(p)), F.size(F.array_distinct(q))) * 0.3
    here = x("plain").isNotNull() & y("plain").isNotNull()
    rooms = x("bedrooms").isNotNull() & y("bedrooms").isNotNull()
    locality = F.when(here, F.when(x("plain") == y("plain"), 1.0).when(F.contains(y("plain"), x("plain")) | F.contains(x("plain"), y("plain")), 0.7).otherwise(words))
    bedrooms = F.when(rooms, F.when(x("bedrooms") == y("bedrooms"), 1.0).when(F.abs(x("bedrooms") - y("bedrooms")) == 1, 0.3).otherwise(0.0))
    base = _weighed((locality, ratio("area_sqft"), bedrooms, ratio("price_inr")))
    penalty = F.when(rooms & (x("bedrooms") != y("bedrooms")), 0.5).otherwise(1.0) * F.when(here & (x("plain") != y("plain")), 0.6).otherwise(1.0)
    return F.coalesce(rounded(base * penalty, 3), F.lit(0.0))


def _weighed(parts: tuple[Column, Column, Column, Column]) -> Column:
    """The weighted mean of locality, area, bedrooms and price over those that aren't null."""
    weighed = tuple(zip(parts, (0.50, 0.25, 0.15, 0.10), strict=True))
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in weighed), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(s * w, F.lit(0.0)) for s, w in weighed), F.lit(0.0)), total)


_COMPARED = ("city", "plain", "bedrooms", "area_sqft", "price_inr")


def _keyed(df: DataFrame, mine: str, p: str) -> DataFrame:
    """df with a row for each of the four states of the other side (which of locality and bedrooms it has) and as keys
    both states, the city and what both sides have of the two."""
    c = F.col
    has = F.when(c(f"{p}plain").isNotNull(), 1).otherwise(0) + F.when(c(f"{p}bedrooms").isNotNull(), 2).otherwise(0)
    df = df.where(c(f"{p}city").isNotNull()).withColumn("_own", has).withColumn("_other", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    shared = c("_own").bitwiseAND(c("_other"))
    first, second = (c("_own"), c("_other")) if mine == "a" else (c("_other"), c("_own"))
    rooms = F.when(shared >= 2, c(f"{p}bedrooms").cast("long")).otherwise(-1)
    place = F.when(shared.bitwiseAND(F.lit(1)) == 1, c(f"{p}plain")).otherwise("")
    keys = {"_a": first, "_b": second, "_city": c(f"{p}city"), "_place": place, "_rooms": rooms}
    return df.withColumns(keys).drop("_own", "_other")


def candidates(left: DataFrame, right: DataFrame, least: float = LEAST, left_id: str = "listing_id", right_id: str = "listing_id") -> DataFrame:
    """a, b and score of all pairs of left and right listings of one city with at least that score. Listings without a
    city have no candidates."""
    _sound(least)
    named = lambda df, key: df.withColumn("plain", plain(F.col("locality"))).select(F.col(key).alias("id"), *_COMPARED)
    return _pairs(named(left, left_id), named(right, right_id), least)


def _sound(least: float) -> None:
    if least <= 0.51:
        raise ValueError("blocks lose pairs for thresholds of 0.51 and below")


def _pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """candidates() of listings whose localities are plain()."""
    side = lambda df, p: _keyed(df.select(F.col("id").alias(p[0]), *[F.col(n).alias(f"{p}{n}") for n in _COMPARED]), p[0], p)
    keys = ["_a", "_b", "_city", "_place", "_rooms"]
    pairs = spread(side(left, "a_"), *keys).join(spread(side(right, "b_"), *keys), keys)
    # a filter on what explode gives stays behind the join; one on the score itself would be tested in it, for every pair
    pairs = pairs.select("a", "b", F.explode_outer(F.array(_alike_score("a_", "b_"))).alias("score"))
    return pairs.withColumn("score", _thousandths(F.col("score"))).where(F.col("score") >= least)


def _alike_score(a: str, b: str) -> Column:
    """match_score(), not rounded, of two listings under one key of candidates(): where both have a locality or a number
    of bedrooms it is the same one, so that nothing is left to compare but area and price."""
    x, y = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    ratio = lambda n: F.when((x(n) > 0) & (y(n) > 0), F.least(x(n), y(n)) / F.greatest(x(n), y(n)))
    both = lambda n: F.when(x(n).isNotNull() & y(n).isNotNull(), 1.0)
    return _weighed((both("plain"), ratio("area_sqft"), both("bedrooms"), ratio("price_inr")))


def _thousandths(x: Column) -> Column:
    """rounded(x, 3) of what isn't negative, by decimals only where they can decide: within a ten-millionth of a half."""
    apart = F.abs(x * 1000 - F.floor(x * 1000) - 0.5)
    return F.coalesce(F.when(apart > 1e-4, F.floor(x * 1000 + 0.5) / F.lit(1000.0)).otherwise(rounded(x, 3)), F.lit(0.0))


def assigned(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """The one-to-one assignment that takes the best remaining pair again and again, by score, then a, then b,
    largest first. Pairs of different components of the graph don't bear on each other: each component is walked once in
    that order, which takes one pass however long its chains of preferences are. Components of more than most pairs are
    taken by rounds instead (assigned_in_rounds), spread over all tasks. a and b are whole numbers; repeated pairs count
    once, with their best score; pairs with a null take no part."""
    rows = pairs.where("a is not null and b is not null and score is not null").groupBy("a", "b").agg(F.max("score").alias("score"))
    rows = cut(rows)
    left, right = F.col("a").cast("long") * 2, F.col("b").cast("long") * 2 + 1
    label = components(rows.select(left.alias("a"), right.alias("b")))
    rows = rows.join(label.select(F.col("id").alias("_left"), "component"), left == F.col("_left")).drop("_left")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    rows = cut(rows.join(sizes, "component"))
    taken = _walked(rows.where(F.col("n") <= most).repartition("component"))
    large = rows.where(F.col("n") > most)
    return taken if large.isEmpty() else taken.unionByName(assigned_in_rounds(large.select("a", "b", "score"), most))


def _walked(rows: DataFrame) -> DataFrame:
    """The pairs that a walk through each component takes, best first; all rows of a component are in one partition."""
    order = [F.col("component"), F.desc("score"), F.desc("a"), F.desc("b")]
    return rows.select("component", "a", "b", "score").sortWithinPartitions(*order).mapInArrow(_walk(), rows.select("a", "b", "score").schema)


def _walk() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (component, a, b, score) in the order of assigned(): the pairs whose ends are both free."""

    def run(batches):
        import pyarrow as pa

        at, lefts, rights = None, set(), set()
        for batch in batches:
            keep = []
            for k, (component, a, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if component != at:
                    at, lefts, rights = component, set(), set()
                if a not in lefts and b not in rights:
                    lefts.add(a)
                    rights.add(b)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b", "score"])

    return run


def assigned_in_rounds(pairs: DataFrame, most: int = 0) -> DataFrame:
    """The pairs of assigned(): in each round all that are the best of both their ends are taken at once, which gives the
    same ones, since the order is strict; the best pair left always is one, so every round takes some. Once most pairs
    or fewer are left, however many rounds they would need, they are walked through like a component of that size."""
    order = F.struct("score", "a", "b")
    rest, taken = cut(pairs.select("a", "b", "score")), None
    while (n := rest.count()) > 0:
        if n <= most:
            walked = _walked(rest.withColumn("component", F.lit(0)).coalesce(1))
            return walked if taken is None else taken.unionByName(walked)
        best_a = rest.groupBy("a").agg(F.max(order).alias("of_a"))
        best_b = rest.groupBy("b").agg(F.max(order).alias("of_b"))
        ranked = rest.join(best_a, "a").join(best_b, "b")
        mutual = cut(ranked.where((F.col("of_a") == order) & (F.col("of_b") == order)).select("a", "b", "score"))
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = cut(rest.join(mutual.select("a"), "a", "left_anti").join(mutual.select("b"), "b", "left_anti"))
    return taken if taken is not None else rest


def _slim(df: DataFrame, key: str) -> DataFrame:
    """What candidates() needs of the listings that can have any."""
    return df.where(F.col(key).isNotNull() & F.col("city").isNotNull()).select(F.col(key).cast("long").alias("id"), "city", "locality", "bedrooms", "area_sqft", "price_inr")


def _packs(*sides: DataFrame) -> bool:
    """Whether the ids of all sides fit beside a score."""
    bounds = [side.agg(F.min("id"), F.max("id")).first() for side in sides]
    return all(low is None or (low >= 0 and high < IDS) for low, high in bounds)


def _best(pairs: DataFrame) -> DataFrame:
    """For each a (b is null) and each b (a is null) of candidates() how many pairs it has, and its best one as a number: the
    score in thousandths above the other id. Both sides are counted where the pairs arise; no pair is sent or sorted."""
    packed = lambda other: F.round(F.col("score") * 1000).cast("long") * IDS + F.col(other)
    each = pairs.select("a", "b", packed("b").alias("to_b"), packed("a").alias("to_a"))
    return each.groupingSets([["a"], ["b"]], "a", "b").agg(F.count("*").alias("n"), F.max("to_b").alias("to_b"), F.max("to_a").alias("to_a"))


def _mutual(best: DataFrame) -> DataFrame:
    """The pairs of _best() that are the best of both their ends: a, b and score."""
    of_a = best.where("a is not null").select("a", F.pmod("to_b", F.lit(IDS)).alias("b"), F.floor(F.col("to_b") / F.lit(IDS)).alias("thousandths"))
    of_b = best.where("b is not null").select(F.pmod("to_a", F.lit(IDS)).alias("a"), "b")
    return of_a.join(of_b, ["a", "b"]).select("a", "b", (F.col("thousandths") / 1000.0).alias("score"))


def mutual_best(left: DataFrame, right: DataFrame, least: float = LEAST, left_id: str = "listing_id", right_id: str = "listing_id") -> DataFrame:
    """best_of_both() of the candidates."""
    a, b = _slim(left, left_id), _slim(right, right_id)
    pairs = candidates(a, b, least, "id", "id")
    return _mutual(_best(pairs)) if _packs(a, b) else best_of_both(pairs)


def _linked(a: DataFrame, b: DataFrame) -> DataFrame:
    """The listings of two _slim() sides (side 0 and 1) as pairing reads them, with link: what can have pairs with each other is
    one link, a city, or several cities that share an id."""
    has = lambda n: F.when(F.col(n) > 0, F.col(n).cast("double"))
    side = lambda df, k: df.select(F.lit(k).alias("side"), "id", "city", plain(F.col("locality")).alias("plain"), F.col("bedrooms").cast("long").alias("bedrooms"), has("area_sqft").alias("area_sqft"), has("price_inr").alias("price_inr"))
    rows = cut(side(a, 0).unionByName(side(b, 1)))
    both = cut(rows.groupBy("side", "id").agg(F.min("city").alias("a"), F.max("city").alias("b")).where("a <> b"))
    if both.isEmpty():
        return rows.withColumn("link", F.col("city"))
    edges = rows.join(both.drop("b"), ["side", "id"]).select("a", F.col("city").alias("b"))
    label = components(edges).select(F.col("id").alias("city"), "component")
    return cut(rows.join(label, "city", "left").withColumn("link", F.coalesce("component", "city")).drop("component"))


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with all of a link in one partition; the largest links have one each, as far as there are so many."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = [(r["link"], k) for k, r in enumerate(sizes.orderBy(F.desc("n"), "link").limit(parts).collect())]
    own = F.broadcast(spark.createDataFrame(largest, "link string, slot int"))
    slot = F.coalesce("slot", F.pmod(F.hash("link"), F.lit(parts)))
    return rows.join(own, "link", "left").repartitionById(parts, slot).drop("slot").sortWithinPartitions("link")


def _paired(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over whole links, one after the other: the pairs that assigned() takes of all their candidates."""

    def of(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from loanloom.operators import pairing

        table = pa.Table.from_batches(batches)

        codes = lambda name: pc.fill_null(table[name].dictionary_encode().combine_chunks().indices, -1).to_numpy().astype(np.int64)
        number = lambda name: pc.fill_null(table[name], 0.0).to_numpy()
        a, b, a_ids, b_ids = pairing.sides(table["side"].to_numpy(), table["id"].to_numpy(), *(codes(n) for n in ("city", "plain", "bedrooms")), number("area_sqft"), number("price_inr"))
        left, right, score = pairing.assigned(a, b, len(a_ids), len(b_ids), least)
        out = pa.table({"a": a_ids[left], "b": b_ids[right], "score": score / 1000.0})
        yield from out.to_batches(10_000)

    def run(batches):
        import numpy as np

        kept = []
        for batch in batches:
            link = batch.column("link")
            codes = link.dictionary_encode().indices.to_numpy()
            at = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for start, end in zip(at, at[1:], strict=False):
                if kept and kept[-1].column("link")[-1] != link[start]:
                    yield from of(kept)
                    kept = []
                kept.append(batch.slice(start, end - start))
        if kept:
            yield from of(kept)

    return run


def matched(left: DataFrame, right: DataFrame, least: float = LEAST, left_id: str = "listing_id", right_id: str = "listing_id", few: int = FEW) -> DataFrame:
    """assigned() of the candidates, without a table of all of them. What has no candidates in common, as listings of different
    cities, is taken by tasks of its own, where listings look their best partners up (pairing.assigned). Cities of more than few
    listings go by rounds until they have fewer: the pairs that are the best of both their ends are taken and their listings
    leave, and the pairs of the next round arise anew from those that are left and had any."""
    _sound(least)
    rows, taken = _linked(_slim(left, left_id), _slim(right, right_id)), []
    while True:
        sizes = cut(rows.groupBy("link").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > few).select("link")
        if large.isEmpty():
            break
        rest, rows = rows.join(large, "link", "left_semi"), rows.join(large, "link", "left_anti")
        a, b = rest.where("side = 0"), rest.where("side = 1")
        if not _packs(a, b):
            taken.append(assigned(_pairs(a, b, least)))
            continue
        best = cut(_best(_pairs(a, b, least)))
        mutual = cut(_mutual(best))
        taken.append(mutual)
        left_over = lambda df, side: df.join(best.select(F.col(side).alias("id")), "id", "left_semi").join(mutual.select(F.col(side).alias("id")), "id", "left_anti")
        rows = cut(reduce(DataFrame.unionByName, [rows, left_over(a, "a"), left_over(b, "b")]))
    walked = cut(_dealt(rows, sizes).mapInArrow(_paired(least), "a long, b long, score double"))
    return reduce(DataFrame.unionByName, [*taken, walked])


def best_of_both(pairs: DataFrame) -> DataFrame:
    """One round of assigned(): the pairs that are the best of both their ends."""
    of = lambda key: F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), F.desc("a"), F.desc("b")))
    return pairs.withColumns({"rank_a": of("a"), "rank_b": of("b")}).where("rank_a = 1 and rank_b = 1").select("a", "b", "score")


def largest_source(listings: DataFrame) -> DataFrame:
    """The source with the most listings, of equal ones the first by name: source and n."""
    return listings.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1)


def _fill(base: str, other: str) -> list[Column]:
    """The mergeable fields of base, from other where base has none, and the names of those taken."""
    x, y = (lambda n: F.col(f"{base}.{n}")), (lambda n: F.col(f"{other}.{n}"))
    takes = {n: empty(x(n)) & ~empty(y(n)) for n in MERGEABLE}
    names = F.filter(F.array(*[F.when(F.coalesce(takes[n], F.lit(False)), F.lit(n)) for n in MERGEABLE]), lambda v: v.isNotNull())
    return [F.when(F.coalesce(takes[n], F.lit(False)), y(n)).otherwise(x(n)).alias(n) for n in MERGEABLE] + [names.alias("taken")]


def merged_pair(base: DataFrame, other: DataFrame, key: str = "listing_id") -> DataFrame:
    """Listings of two tables with the same key as one: base's fields filled from other's, imputed_fields and
    sources united. Keys of one table alone stay as they are."""
    both = base.alias("x").join(other.alias("y"), key, "full")
    rest = [n for n in base.columns if n not in (*MERGEABLE, key, "sources", "imputed_fields")]
    none = F.array().cast("array<string>")
    of = lambda p, n: F.coalesce(F.col(f"{p}.{n}"), none)
    out = both.select(key, *[F.coalesce(F.col(f"x.{n}"), F.col(f"y.{n}")).alias(n) for n in rest], *_fill("x", "y"), F.array_sort(F.array_union(of("x", "sources"), of("y", "sources"))).alias("sources"), of("x", "imputed_fields").alias("imputed_fields"), F.col("x.sources").isNotNull().alias("known"))
    out = out.withColumn("imputed_fields", F.when(F.col("known"), F.array_union("imputed_fields", "taken")).otherwise(F.col("imputed_fields")))
    return out.drop("taken", "known").withColumn("source_count", F.size("sources"))


def merged(listings: DataFrame, sources: list[str], least: float = LEAST) -> DataFrame:
    """Listings of all sources as one table: those of the first source (the largest one, by largest_source) are
    filled from the matching ones of each further source in turn, and what matches none is added. With sources,
    imputed_fields, source_count and the quality of the result. place orders listings as they were added."""
    none = F.array().cast("array<string>")
    own = lambda name, turn: listings.where(F.col("source") == name).withColumns({"place": F.lit(turn << 40) + F.col("listing_id"), "sources": F.array(F.lit(name)), "imputed_fields": none})
    out = own(sources[0], 0)
    for turn, name in enumerate(sources[1:], 1):
        more = own(name, turn)
        pairs = matched(out, more, least, "place", "place").select("a", "b")
        rest = [n for n in out.columns if n not in (*MERGEABLE, "sources", "imputed_fields")]
        other = more.select(F.col("place").alias("b"), F.struct(*MERGEABLE).alias("y"))
        filled = out.join(pairs, out["place"] == pairs["a"], "left").join(other, "b", "left").withColumn("x", F.struct(*MERGEABLE))
        found = F.col("b").isNotNull()
        filled = filled.select(*rest, *_fill("x", "y"), F.when(found, F.array_union("sources", F.array(F.lit(name)))).otherwise(F.col("sources")).alias("sources"), "imputed_fields")
        filled = filled.withColumn("imputed_fields", F.array_union("imputed_fields", "taken")).drop("taken")
        out = cut(filled.unionByName(more.join(pairs.select(F.col("b").alias("place")), "place", "left_anti")))
    out = out.withColumn("source_count", F.size("sources"))
    return scored(out, F.col("source_count"), F.size("imputed_fields"))
