"""Entity resolution: names, coordinates, clusters of stops."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import text
from tramline.functions.geo import distance_m
from tramline.operators.relational import distinct_on, top_n
from tramline.operators.spatial import Bands
from tramline.session import cut


def name_rank(name: Column, wanted: str, unlocated: Column, aliases: Column | None = None, unserved: Column | None = None) -> Column:
    """0 the name itself, 1 in normal form, 2 an alias, else 3 and more for each thing that is missing."""
    key = "".join(c for c in wanted.lower() if c.isascii() and c.isalnum())
    other = F.lit(3) + 2 * (~name.startswith(wanted.split()[0])).cast("int") + unlocated.cast("int")
    if unserved is not None:
        other = other + 4 * unserved.cast("int")
    rank = F.when(name == wanted, 0).when(text.name_key(name) == key, 1)
    return (rank.when(F.array_contains(aliases, wanted), 2) if aliases is not None else rank).otherwise(other)


def donate_coordinates(stops: DataFrame) -> DataFrame:
    """For each unlocated stop, the located stop of its name with the smallest id, and that stop's coordinates."""
    key = F.lower("name").alias("k")
    donors = stops.filter("lat is not null").groupBy(key).agg(F.min("id").alias("donor"), F.min_by("lat", "id").alias("lat"), F.min_by("lng", "id").alias("lng"))
    return stops.filter("lat is null").select("id", key).join(donors, "k").select("id", "donor", "lat", "lng")


def grid_survivors(stops: DataFrame, snap: int = 1000) -> DataFrame:
    """id and survivor: the smallest id of its name, state and grid point. Pre-aggregated, so a crowded point is no hot key."""
    point = [F.floor(F.col(c) * snap + 0.5).cast("bigint").alias(f"k_{c}") for c in ("lat", "lng")]
    keyed = stops.select("id", "name", "state", *point)
    keys = ["name", "state", "k_lat", "k_lng"]
    low = keyed.groupBy(*keys).agg(F.min("id").alias("survivor")).select(*[F.col(k).alias(f"_{k}") for k in keys], "survivor")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return keyed.join(low, same[0] & same[1] & same[2] & same[3]).select("id", "survivor")


def _segments(name: Column, parts: Column) -> Column:
    """(place, segment) of `name` cut into `parts` nearly equal segments, counted from 0."""
    n = F.length(name)
    bound = lambda i: F.floor(i * n / parts).cast("int")
    each = F.sequence(F.lit(0), parts - 1)
    return F.transform(each, lambda i: F.struct(bound(i).alias("at"), name.substr(bound(i) + 1, bound(i + 1) - bound(i)).alias("s")))


def similar_names(wanted: DataFrame, names: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs (wanted, name, s) of similarity `least` or more; nothing is missed.

    Names of that similarity are at most k = floor((1 - least) x longer length) edits apart. If a wanted name is cut
    into k + 1 segments for the longest name that it can match, an edit spoils one segment at most, so one of them
    stands unchanged in the other name, at most k places further or back. So both sides meet on equal segments of equal
    place; a hot segment is a key like any other and is split by adaptive execution. Names of up to k characters, whose
    segments would be empty, don't occur while least is more than one half.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be more than one half")
    ratio = 1 - least
    edits = lambda n: F.floor(F.floor(n / least + 1e-9) * ratio + 1e-9).cast("int")  # noqa: E731  of the longest partner
    n = F.length("wanted")
    left = wanted.select("wanted").distinct().withColumn("k", edits(n))
    left = left.select("wanted", "k", F.explode(_segments(F.col("wanted"), F.least(F.col("k") + 1, F.greatest(n, F.lit(1))))).alias("g"))
    left = left.select("wanted", F.col("g.s").alias("seg"), F.explode(F.sequence(F.col("g.at") - F.col("k"), F.col("g.at") + F.col("k"))).alias("at"))
    # The other side's segments: of every length that a partner may cut, at every place.
    m = F.length("name")
    least_n, most_n = F.ceil(m * least - 1e-9).cast("int"), F.floor(m / least + 1e-9).cast("int")
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(least_n, most_n), lambda x: F.array(F.floor(x / F.least(edits(x) + 1, F.greatest(x, F.lit(1)))).cast("int"), F.ceil(x / F.least(edits(x) + 1, F.greatest(x, F.lit(1)))).cast("int")))))
    right = names.select("name").distinct().select("name", F.explode(sizes).alias("z")).filter((F.col("z") <= m))
    right = right.select("name", F.explode(F.transform(F.sequence(F.lit(0), m - F.col("z")), lambda i: F.struct(i.alias("at"), F.col("name").substr(i + 1, F.col("z")).alias("seg")))).alias("g")).select("name", "g.at", "g.seg")
    pairs = left.join(right, ["seg", "at"]).filter(F.abs(n - m) <= ratio * F.greatest(n, m) + 1e-9).select("wanted", "name").distinct()
    return pairs.withColumn("s", text.similarity(F.col("wanted"), F.col("name"))).filter(F.col("s") >= least)


def resolve_names(wanted: DataFrame, places: DataFrame, aliases: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """For each distinct wanted name: place, place_id and how: exact, alias, fuzzy, merged or created.

    In this order: a place of the name itself (smallest id); one that `aliases` (alias, place_id) has for it; the most
    similar place at `least` or more, ties to the smallest id. What is left is created, but for names that are near an
    earlier one that is created: these are merged into the most similar of them (ties to the first by name), as if the
    names came in their order. Null names are left out. The last step makes the pairs of similar names among those that
    are created, which is the square of the largest family of such names.
    """
    w = cut(wanted.select("wanted").filter("wanted is not null").distinct())
    known = places.filter("name is not null").groupBy("name").agg(F.min("id").alias("place_id"))
    same = w.join(known.withColumnRenamed("name", "wanted"), "wanted").select("wanted", F.col("wanted").alias("place"), "place_id", F.lit("exact").alias("how"))
    rest, out = w.join(same, "wanted", "left_anti"), same
    if aliases is not None:
        listed = aliases.groupBy(F.col("alias").alias("wanted")).agg(F.min("place_id").alias("place_id"))
        meant = rest.join(listed, "wanted").join(places.select(F.col("id").alias("place_id"), F.col("name").alias("place")), "place_id")
        meant = meant.select("wanted", "place", "place_id", F.lit("alias").alias("how"))
        rest, out = rest.join(meant, "wanted", "left_anti"), out.unionByName(meant)
    rest = cut(rest)
    near = similar_names(rest, known, least).join(known, "name")
    best = cut(distinct_on(near, ["wanted"], [F.desc("s"), F.col("place_id")]).select("wanted", F.col("name").alias("place"), "place_id", F.lit("fuzzy").alias("how")))
    left = cut(rest.join(best, "wanted", "left_anti"))
    pairs = similar_names(left, left.select(F.col("wanted").alias("name")), least).filter("name < wanted").select(F.col("wanted").alias("late"), F.col("name").alias("early"), "s")
    heads = first_come(left.select(F.col("wanted").alias("node")), pairs)
    joined = pairs.join(heads.select(F.col("node").alias("early")), "early")
    merged = distinct_on(joined.join(heads.select(F.col("node").alias("late")), "late", "left_anti"), ["late"], [F.desc("s"), F.col("early")])
    none = F.lit(None).cast(known.schema["place_id"].dataType).alias("place_id")
    out = out.unionByName(best).unionByName(merged.select(F.col("late").alias("wanted"), F.col("early").alias("place"), none, F.lit("merged").alias("how")))
    return out.unionByName(heads.select(F.col("node").alias("wanted"), F.lit(None).cast("string").alias("place"), none, F.lit("created").alias("how")))


def first_come(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that a pass in order would keep, if each kept node took those after it that it has a pair with.

    `pairs` has early and late. Each round keeps the undecided nodes without an undecided earlier partner and drops
    their partners; in any but an adverse order the rounds grow with the logarithm of the longest chain.
    """
    kept = None
    left, links = cut(nodes), cut(pairs.select("early", "late"))
    while not left.isEmpty():
        waiting = links.select(F.col("late").alias("node")).distinct()
        now = cut(left.join(waiting, "node", "left_anti"))
        taken = links.join(now.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node")).distinct()
        gone = cut(taken.unionByName(now))
        left = cut(left.join(gone, "node", "left_anti"))
        links = cut(links.join(gone.select(F.col("node").alias("early")), "early", "left_anti").join(gone.select(F.col("node").alias("late")), "late", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
    return nodes.limit(0) if kept is None else cut(kept)


def geocode(stops: DataFrame) -> DataFrame:
    """Candidates for unlocated stops among located names with the same first five characters, by similarity.

    Both sides are reduced to their distinct names and states before they meet, however many stops share them.
    """
    block = F.substring("name", 1, 5).alias("block")
    known = stops.filter("lat is not null").groupBy("name", "state").agg(F.min("id").alias("candidate"))
    known = known.select(block, F.col("name").alias("name_2"), F.col("state").alias("state_2"), "candidate")
    s = text.similarity(F.col("name"), F.col("name_2")) - F.when(F.col("state") == F.col("state_2"), F.lit(0.0)).otherwise(0.3)
    lost = stops.filter("lat is null")
    pairs = lost.select("name", "state").distinct().select("name", "state", block).join(known, "block").withColumn("s", s).filter("s >= 0.6")
    best = distinct_on(pairs, ["name", "state"], [F.desc("s"), F.col("candidate")]).select(F.col("name").alias("_name"), F.col("state").alias("_state"), "candidate", "s")
    found = lost.join(best, (F.col("name") == F.col("_name")) & F.col("state").eqNullSafe(F.col("_state")))
    return found.select("id", "candidate", F.when(F.col("s") >= 1, 0.98).when(F.col("s") >= 0.8, 0.92).otherwise(0.84).alias("confidence"))


def source_confidence(sources: DataFrame, key: str) -> DataFrame:
    """Confidence of a place by the kinds of its sources (columns key, kind, verified)."""
    # The weight of each kind of source.
    weights = {"GOVERNMENT": 40, "GOVERNMENT_GIS": 38, "GOVERNMENT_APP": 35, "OPERATOR": 30, "OPEN_DATA": 25, "COMMUNITY": 20, "THIRD_PARTY": 15}
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    kinds = sources.groupBy(key, "kind").agg(F.count("*").alias("n"), F.sum(F.col("verified").cast("int")).alias("verified"))
    weight = F.coalesce(F.try_element_at(known, F.col("kind")), F.lit(15))
    cents = F.least(F.lit(99), 40 + F.sum(weight + 5 * (F.col("n") - 1)) + 8 * F.sum("verified"))
    return kinds.groupBy(key).agg(cents.cast("bigint").alias("percent")).withColumn("high", F.col("percent") >= 85)


def merge_by_name(stops: DataFrame) -> DataFrame:
    """For each stop the one that survives among its name: located first, then the smallest id."""
    order = F.struct(F.col("lat").isNull().cast("int"), F.col("id"))
    low = stops.groupBy(F.lower("name").alias("k")).agg(F.min_by("id", order).alias("survivor"), F.count("*").alias("members"))
    return stops.select("id", F.lower("name").alias("k")).join(low, "k").select("id", "survivor", F.when(F.col("id") == F.col("survivor"), "ACTIVE").otherwise("MERGED").alias("status"))


def seed_aliases(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stop names in another spelling than the place of the same key: (place, alias), without repeats of case."""
    p = places.select(F.col("id").alias("place"), text.name_key(F.col("name")).alias("k"), F.col("name").alias("canonical"))
    found = stops.select(text.name_key(F.col("name")).alias("k"), "name").join(p, "k").filter(F.col("name") != F.col("canonical"))
    return found.groupBy("place", F.lower("name").alias("low")).agg(F.min("name").alias("alias")).select("place", "alias")


def lifecycle(stops: DataFrame, calls: DataFrame, age_days: Column, stale_days: int = 180) -> DataFrame:
    """ACTIVE with calls; else PENDING without coordinates, STALE if older than stale_days, ORPHAN otherwise."""
    used = calls.select(F.col("stop_id").alias("id")).distinct().withColumn("used", F.lit(True))
    status = F.when(F.col("used"), "ACTIVE").when(F.col("lat").isNull(), "PENDING").when(age_days > stale_days, "STALE").otherwise("ORPHAN")
    return stops.join(used, "id", "left").select("id", status.alias("status"))


def cluster_greedy(stops: DataFrame, services: DataFrame, limit_m: float = 150.0) -> DataFrame:
    """id and survivor: each stop joins the first survivor of its name within limit_m and of a compatible state.

    Stops come in the order of services (most first), with a state before without, then id; a stop that joins none
    becomes a survivor; states are compatible if equal or one is missing. The rounds below give what one pass in that
    order would: stops that share name, state and place have one fate and are taken together; in each round the first
    undecided stop of each state of a cell becomes a survivor if no undecided stop near it is earlier, and then takes
    the undecided stops near it. All of it is joins by name key and cell: a stop meets one stop of each state of the
    cells around, and a cell is little wider than limit_m, so only a few survivors stand in it; no pairs of a crowded
    name are made. Rounds grow with the longest chain of stops in falling order, in practice a few. Stops without place
    stay alone; null names are one name.
    """
    busy = services.select(F.col("stop_id").alias("id"), "services")
    s = stops.join(busy, "id", "left").select("id", F.coalesce(text.name_key(F.col("name")), F.lit("")).alias("k"), F.coalesce("state", F.lit("")).alias("state"), "lat", "lng", F.coalesce("services", F.lit(0)).alias("services"))
    s = s.withColumn("o", F.struct((-F.col("services")).alias("s"), (F.col("state") == "").alias("none"), "id"))
    s = cut(s)
    place = ["k", "state", "lat", "lng"]
    bands = Bands(limit_m)
    first = s.filter("lat is not null and lng is not null").groupBy(*place).agg(F.min("o").alias("o"))
    first = first.withColumn("y", bands.band(F.col("lat")))
    first = cut(first.withColumn("x", bands.cell(F.col("lng"), F.col("y"))))
    cell = ["k", "y", "x"]
    fits = (F.col("state") == F.col("h_state")) | (F.col("state") == "") | (F.col("h_state") == "")
    close = distance_m(F.col("lat"), F.col("lng"), F.col("h_lat"), F.col("h_lng")) <= limit_m

    def meet(heads: DataFrame, others: DataFrame) -> DataFrame:
        """Each of `heads` (h_...) beside the others that are near it and compatible."""
        named = heads.select("k", *[F.col(c).alias(f"h_{c}") for c in ("state", "lat", "lng", "o")], F.explode(bands.near(F.col("lat"), F.col("lng"))).alias("c"))
        return named.select("*", "c.y", "c.x").drop("c").join(others, cell).filter(fits & close)

    left, heads = first, None
    while not left.isEmpty():
        lead = left.groupBy(*cell, "state").agg(F.min_by(F.struct("lat", "lng", "o"), "o").alias("f"))
        lead = cut(lead.select("k", "state", "f.*"))
        blocked = meet(lead, left).filter(F.col("o") < F.col("h_o")).select(F.col("h_o").alias("o")).distinct()
        now = cut(lead.join(blocked, "o", "left_anti").select("k", "state", "lat", "lng", "o"))
        left = cut(left.join(meet(now, left).select("o").distinct(), "o", "left_anti"))
        heads = now if heads is None else heads.unionByName(now)
    if heads is None:
        return s.select("id", F.col("id").alias("survivor"))
    taken = meet(cut(heads), first).filter(F.col("h_o") <= F.col("o")).groupBy(*place).agg(F.min("h_o").alias("h_o"))
    taken = cut(taken.select(*place, F.col("h_o.id").alias("survivor")))
    return s.join(taken, place, "left").select("id", F.coalesce("survivor", "id").alias("survivor"))


def enrich(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Stops of both feeds by key: the first known coordinates, all sources, and a confidence."""
    both = old.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)))
    best = lambda c: F.min_by(c, F.struct(F.col(c).isNull().cast("int"), F.col("rank"), F.col("id")))
    merged = both.groupBy(*keys).agg(best("lat").alias("lat"), best("lng").alias("lng"), F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("providers"), F.count("*").alias("records"))
    cents = F.least(F.lit(99), F.lit(50) + 30 * F.col("lat").isNotNull().cast("int") + 15 * (F.col("records") > 1).cast("int") + 5 * (F.instr("providers", ",") > 0).cast("int"))
    return merged.withColumn("percent", cents.cast("int"))


def top_places(stops: DataFrame, n: int = 3) -> DataFrame:
    return top_n(stops, ["name"], [F.col("id")], n)


def near_twins(stops: DataFrame, limit_m: float) -> Column:
    return distance_m(F.col("lat"), F.col("lng"), F.col("lat_2"), F.col("lng_2")) <= limit_m
