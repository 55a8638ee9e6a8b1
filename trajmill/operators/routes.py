"""Routes of one and two legs on a day, the cheapest of them, and the chains of calls that find it.

legs: flight, origin, destination, date, departs, arrives, price (any type that adds up). Pairs of legs are formed only on request
(`two_legs`); the cheapest route needs none: a first leg meets, for each place that can be reached from where it lands, the cheapest
second leg that departs from then on, which is a running minimum over departures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHERE = ["origin", "destination", "date"]


def two_legs(legs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(origin, destination, date, first, second, price) of every connection of a day that does not lead back; of the trips `wanted`
    (origin, destination, date), if given, whose legs are picked before they meet."""
    first = legs.select("origin", "date", F.col("destination").alias("__hub"), F.col("flight").alias("first"), "arrives", F.col("price").alias("__p"))
    second = legs.select("destination", "date", F.col("origin").alias("__hub"), F.col("flight").alias("second"), "departs", F.col("price").alias("__q"))
    if wanted is not None:
        trips = wanted.select(*WHERE).distinct()
        first = first.join(trips.select("origin", "date").distinct(), ["origin", "date"], "left_semi")
        second = second.join(trips.select("destination", "date").distinct(), ["destination", "date"], "left_semi")
    both = first.join(second, ["date", "__hub"]).where((F.col("departs") >= F.col("arrives")) & (F.col("origin") != F.col("destination")))
    out = both.select(*WHERE, "first", "second", (F.col("__p") + F.col("__q")).alias("price"))
    return out if wanted is None else out.join(trips, WHERE, "left_semi")


def cheapest(legs: DataFrame) -> DataFrame:
    """(origin, destination, date, price, legs, first, second): the cheapest route of every trip; of equal prices that of fewer legs, then of
    the first flights. second is '' for one leg. Legs without a price, or that lead nowhere, are no part of a route."""
    legs = legs.where(F.col("price").isNotNull() & (F.col("origin") != F.col("destination")))
    route = lambda price, n, a, b: F.struct(price.alias("price"), F.lit(n).alias("legs"), a.alias("first"), b.alias("second"))
    direct = legs.groupBy(*WHERE).agg(F.min(route(F.col("price"), 1, F.col("flight"), F.lit(""))).alias("route"))

    leg = F.struct("price", "flight")
    onward = legs.groupBy("date", F.col("origin").alias("hub"), F.col("destination").alias("to"), F.col("departs").alias("t")).agg(F.min(leg).alias("best"))
    onward = onward.select("date", "hub", "to", "t", F.lit(1).alias("leaves"), "best", F.lit(None).cast(dict(legs.dtypes)["origin"]).alias("start"), F.lit(None).cast(onward.schema["best"].dataType).alias("came"))
    landed = legs.groupBy("date", F.col("destination").alias("hub"), F.col("origin").alias("start"), F.col("arrives").alias("t")).agg(F.min(leg).alias("came"))
    places = legs.select("date", F.col("origin").alias("hub"), F.col("destination").alias("to")).distinct()
    landed = landed.join(places, ["date", "hub"]).where("start != to").select("date", "hub", "to", "t", F.lit(0).alias("leaves"), F.lit(None).cast(onward.schema["best"].dataType).alias("best"), "start", "came")
    later = Window.partitionBy("date", "hub", "to").orderBy(F.desc("t"), F.desc("leaves")).rowsBetween(Window.unboundedPreceding, 0)
    met = onward.unionByName(landed).withColumn("next", F.min("best").over(later)).where("leaves = 0 and next is not null")
    joined = met.groupBy(F.col("start").alias("origin"), F.col("to").alias("destination"), "date").agg(F.min(route(F.col("came.price") + F.col("next.price"), 2, F.col("came.flight"), F.col("next.flight"))).alias("route"))
    return direct.unionByName(joined).groupBy(*WHERE).agg(F.min("route").alias("route")).select(*WHERE, "route.*")


def search_chain(found: DataFrame, direct: Column) -> DataFrame:
    """A chain of messages for each route of cheapest() (`chain`, `i`, `role`, `content`, `tool`, `arguments`): the wish, the search for one leg
    and its reply (`direct`: the least price of one leg, null if there is none), that for two, and the answer."""
    chain = F.concat_ws("_", *WHERE)
    asked = F.to_json(F.struct(*WHERE))
    one = F.coalesce(F.to_json(F.array(F.struct(direct.alias("price")))), F.lit("[]"))
    one = F.when(direct.isNull(), "[]").otherwise(one)
    two = F.when(F.col("legs") == 2, F.to_json(F.array(F.struct("first", "second", "price")))).otherwise("[]")
    said = F.concat(F.lit("Take "), F.concat_ws(" and ", "first", F.nullif(F.col("second"), F.lit(""))), F.lit(" for "), F.col("price").cast("string"), F.lit("."))
    wish = F.concat(F.lit("The cheapest way from "), "origin", F.lit(" to "), "destination", F.lit(" on "), F.col("date").cast("string"), F.lit(", please."))
    none = F.lit("")
    message = lambda role, content, tool="", arguments=none: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(tool).alias("tool"), arguments.alias("arguments"))
    messages = [message("user", wish), message("assistant", none, "search_direct_flight", asked), message("tool", one), message("assistant", none, "search_onestop_flight", asked), message("tool", two), message("assistant", said)]
    return found.select(chain.alias("chain"), F.posexplode(F.array(*messages)).alias("i", "m")).select("chain", "i", "m.*")
