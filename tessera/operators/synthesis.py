"""Intent cards, training constraints, simulated messages and folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.sources.stored import stored

NONE = "array<string>"


def _first(x: Column, rx: str) -> Column:
    return F.lower(F.regexp_extract(x, f"(?i){rx}", 1))


def intent_card(limit: int = 180) -> tuple[Column, Column]:
    """(hard, soft): the first two constraints of a product, and the next two, or the first if there are none.

    Features and details come after the first material; the first colour comes second, or first if nothing else is there; the
    price is last. Repeats go; a product without any has its title."""
    features = F.filter(F.coalesce("features", F.array().cast(NONE)), lambda e: e.isNotNull() & (e != ""))
    corpus = T.searchable_text()
    material, color = _first(corpus, V.CARD_MATERIAL), _first(corpus, V.CARD_COLOR)
    rest = F.concat(features, T.pairs(F.col("details")))
    rest = F.when(material != "", F.concat(F.array(material), rest)).otherwise(rest)
    named = F.array(F.concat(F.lit("color: "), color))
    rest = F.when(color == "", rest).when(F.size(rest) == 0, named).otherwise(F.concat(F.slice(rest, 1, 1), named, F.slice(rest, 2, 1000)))
    priced = F.coalesce("price", F.lit("")) != ""
    rest = F.when(priced, F.concat(rest, F.array(F.concat(F.lit("budget around $"), F.col("price"))))).otherwise(rest)
    clean = F.array_distinct(F.filter(F.transform(rest, lambda v: T.squeeze(v, limit)), lambda v: v != ""))
    title = T.squeeze(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("product"), limit)
    clean = F.when(F.size(clean) > 0, clean).otherwise(F.array(title))
    return F.slice(clean, 1, 2), F.when(F.size(clean) > 2, F.slice(clean, 3, 2)).otherwise(F.slice(clean, 1, 1))


def train_constraints() -> Column:
    corpus = T.product_text(800, 600, 800, 3000, True)
    material, color = _first(corpus, V.TRAIN_MATERIAL), _first(corpus, V.TRAIN_COLOR)
    none = F.array().cast(NONE)
    some = lambda x, v: F.when(x != "", F.array(v)).otherwise(none)
    features = F.transform(F.slice(F.coalesce("features", none), 1, 4), lambda v: T.squeeze(v, 180))
    details = F.transform(F.slice(F.coalesce("details", F.array().cast("array<struct<key:string,value:string>>")), 1, 4), lambda e: T.squeeze(F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))), 180))
    price = F.coalesce("price", F.lit(""))
    all_ = F.concat(some(material, material), some(color, F.concat(color, F.lit(" color"))), features, details, some(price, F.concat(F.lit("around $"), price)))
    return F.array_distinct(F.filter(all_, lambda v: v != ""))


def opening_message(scenario: Column, category: Column, hard: Column, soft: Column) -> Column:
    """What the simulated customer says first."""
    start = F.concat(F.lit("I'm looking for "), category)
    return (
        F.when((scenario == "buying") & (F.size(hard) > 0), F.concat(start, F.lit(". A key requirement is: "), F.get(hard, F.lit(0)), F.lit(".")))
        .when(scenario == "intent_override", F.concat(start, F.lit(". "), F.coalesce(F.try_element_at(soft, F.lit(-1)), F.lit("I prefer a different style."))))
        .otherwise(F.concat(start, F.lit(", but I'm still exploring.")))
    )


def emulated_query(scenario: Column, coin: Column) -> Column:
    """A customer's turns for a product as one text."""
    values = train_constraints()
    first = F.coalesce(F.get(values, F.lit(0)), T.squeeze(F.col("title"), 180))
    second = F.coalesce(F.get(values, F.lit(1)), first)
    brand = T.squeeze(F.col("store"), 100)
    phrase = T.category_phrase(F.col("categories"))
    hello = F.concat(F.when(coin < 0.5, "Please help me find ").otherwise("I'm looking for "), phrase, F.lit("."))
    old = F.when(brand != "", brand).otherwise("a simple everyday style")
    return (
        F.when(scenario == "buying", F.concat(hello, F.lit(" A key requirement is "), first, F.lit(".")))
        .when(scenario == "browsing", F.concat(F.lit("I'm exploring options for "), phrase, F.lit(". I tend to prefer "), first, F.lit(".")))
        .when(scenario == "intent_override", F.concat(F.lit("I need "), phrase, F.lit(" and was initially considering "), old, F.lit(". Actually, ignore that earlier preference; prioritize "), first, F.lit(" and "), second, F.lit(".")))
        .otherwise(F.concat(hello, F.lit(" I don't have a preference for the other details; use your judgment. The one thing that matters is "), first, F.lit(".")))
    )


def valid_top(lists: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """lists: query, ids (array). query, rank, id: the first k ids that are known, each once, in their order."""
    rows = lists.select("query", F.posexplode("ids").alias("pos", "id")).select("query", "pos", F.btrim("id").alias("id")).where("id <> ''")
    once = rows.groupBy("query", "id").agg(F.min("pos").alias("pos")).join(catalog.select("id").distinct(), "id", "left_semi")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where(F.col("rank") <= k).select("query", "rank", "id")


def first_hit(ranked: DataFrame, k: int = 10) -> DataFrame:
    """ranked: sample, turn, rank of the target (null if absent), active. sample, hit_turn, best_rank of the first turn
    that ranks it within k, turns before an override is applied left out."""
    ok = F.col("active") & (F.col("rank") <= k)
    return ranked.groupBy("sample").agg(F.min(F.when(ok, F.col("turn"))).alias("hit_turn"), F.min_by("rank", F.when(ok, F.col("turn"))).alias("best_rank")).withColumn("best_rank", F.when(F.col("hit_turn").isNotNull(), F.col("best_rank")))


def profile_query(query: Column, summary: Column, tags: Column) -> Column:
    """A query with the shopper's profile behind it: the summary, or else the preference tags, if there is either."""
    short = T.squeeze(summary, 220)
    liked = F.array_join(F.coalesce(tags, F.array().cast(NONE)), ", ", "None")
    said = F.when(short != "", short).when(liked != "", F.concat(F.lit("Past preferences: "), liked, F.lit(".")))
    return F.concat(query, F.coalesce(F.concat(F.lit(" Shopper profile: "), said), F.lit("")))


def places(rows: DataFrame, order: Column, *by: str, digits: int = 3) -> DataFrame:
    """rows with nth (from 1, in the order of a hexadecimal hash) and n (rows) of their group. A group is cut by the hash's first digits; ranks
    within a part and counts of the parts before give the place, so that no group is one task's window."""
    part = [*by, "part"]
    cut = rows.withColumn("hash", order).withColumn("part", F.substring("hash", 1, digits))
    sizes = cut.groupBy(*part).agg(F.count("*").alias("own"))
    line = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("own").over(line.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*part, before.alias("before"), F.sum("own").over(line).alias("n"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("hash"))
    return cut.withColumn("own", own).join(sizes, part).withColumn("nth", F.col("before") + F.col("own")).drop("before", "own", "part", "hash")


def negatives(rows: DataFrame, count: int = 7, seed: int = 2026) -> DataFrame:
    """rows: id, category. id, k (from 1), negative: `count` other ids for each, the next of its category on a ring in hash order;
    where the category has too few, the next ids of other categories on the ring of all. Fewer only if there are no more ids. Pairs
    grow with the rows alone."""
    rows = rows.select("id", F.coalesce(F.col("category").cast("string"), F.lit("")).alias("category"))  # null is a category as the empty one is
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    steps = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    own = places(rows.select("id", "category"), order, "category")
    ask = own.select("id", "category", "n", "nth", steps(count).alias("k")).where("k < n").withColumn("want", (F.col("nth") - 1 + F.col("k")) % F.col("n") + 1)
    same = ask.join(own.select("category", F.col("nth").alias("want"), F.col("id").alias("negative")), ["category", "want"]).select("id", "k", "negative")
    # a small category holds no more than `count` ids, so among twice as many on the other ring enough are of others
    few = own.where(F.col("n") <= count).select("id", "category", F.col("n").alias("own"))
    ring = places(rows.select("id", "category"), order)
    more = few.join(ring.select("id", "nth", "n"), "id").select("id", "category", "own", "nth", "n", steps(2 * count).alias("step")).where("step < n").withColumn("want", (F.col("nth") - 1 + F.col("step")) % F.col("n") + 1)
    other = more.join(ring.select(F.col("nth").alias("want"), F.col("id").alias("negative"), F.col("category").alias("of")), "want").where(~F.col("category").eqNullSafe(F.col("of")))
    k = F.col("own") - 1 + F.row_number().over(Window.partitionBy("id").orderBy("step"))
    filled = other.withColumn("k", k).where(F.col("k") <= count).select("id", F.col("k").cast("int").alias("k"), "negative")
    return same.select("id", F.col("k").cast("int").alias("k"), "negative").union(filled)


def joined_or_fail(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """rows joined to the catalog's row of their key; reading a row that the catalog lacks fails."""
    found = rows.join(catalog.withColumn("found", F.lit(True)), key, "left")
    checked = F.assert_true(F.coalesce("found", F.lit(False)), F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(checked.isNull()).drop("found")


@F.pandas_udf(StringType())
def blake_hash(text: pd.Series) -> pd.Series:
    """The first 8 bytes of BLAKE2b, in hexadecimal digits."""
    return text.map(lambda t: hashlib.blake2b(t.encode(), digest_size=8).hexdigest(), na_action="ignore")


def grouped_folds(samples: DataFrame, folds: int = 5, seed: int = 2026) -> DataFrame:
    """samples: sample, target, scenario, difficulty. sample, fold: all samples of a target are in one fold. Targets are placed along
    strata (scenario and difficulty of their first sample) and hash order, each in the fold that is smallest then, the first of
    several.

    Each choice depends on those before, so one task passes over the targets in order: it reads a number for each and holds a number for each fold. Samples
    themselves are not gathered."""
    first = F.min(F.struct("sample", F.coalesce("scenario", F.lit("")).alias("scenario"), F.coalesce("difficulty", F.lit("")).alias("difficulty")))
    groups = samples.groupBy("target").agg(first.alias("first"), F.count("*").alias("n"))
    line = groups.select("target", "n", "first.scenario", "first.difficulty", blake_hash(F.concat(F.lit(f"{seed}\0"), F.col("target").cast("string"))).alias("hash"))
    line = line.orderBy("scenario", "difficulty", "hash", "target").select(F.col("target").cast("string").alias("target"), "n").coalesce(1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [0] * folds
        for b in batches:
            chosen = []
            for n in b.column(1).to_pylist():
                chosen.append(sizes.index(min(sizes)))
                sizes[chosen[-1]] += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chosen, pa.int32())], ["target", "fold"])

    placed = stored(line.mapInArrow(place, "target string, fold int"), "folds")
    return samples.select("sample", F.col("target").cast("string").alias("target")).join(placed, "target").select("sample", "fold")


def selected(scores: DataFrame, folds: int = 5) -> DataFrame:
    """scores: config, fold, n, score (of the fold's sessions). fold, config, train_score, valid_score: for each fold the config of the highest mean score
    of the other folds, the first by name in a tie."""
    whole = scores.groupBy("config").agg(F.sum(F.col("n") * F.col("score")).alias("all"), F.sum("n").alias("rows"))
    each = scores.join(whole, "config").withColumn("train_score", F.round((F.col("all") - F.col("n") * F.col("score")) / (F.col("rows") - F.col("n")), 6))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("train_score"), "config"))
    return each.withColumn("nth", best).where("nth = 1").select("fold", "config", "train_score", F.col("score").alias("valid_score"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 2026) -> DataFrame:
    """The n rows of the smallest hashes of seed and key, ties by key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def even_folds(samples: DataFrame, folds: int = 5) -> DataFrame:
    """samples: sample, scenario, difficulty, one for each target. Folds in turn along strata and hash order, as the greedy choice of the
    smallest fold gives when all groups have one member. Positions come from counts of strata, not from one sorted task."""
    strata = samples.groupBy("scenario", "difficulty").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("scenario", "difficulty").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("scenario", "difficulty").orderBy(F.md5(F.concat(F.lit("2026:"), F.col("sample").cast("string")))))
    return samples.withColumn("nth", own).join(strata.withColumn("before", before), ["scenario", "difficulty"]).select("sample", ((F.col("before") + F.col("nth") - 1) % folds).cast("int").alias("fold"))
