"""Actions, identities and records: label sources, prefixes, silver sets, dossiers."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import haversine_km, number_valid
from .features import end_of, known


def action_table(*sources: DataFrame) -> DataFrame:
    """Actions(source, action, date, number, ...) of all sources in one table, by name, without the
    rows that lack a number, a date or an action."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources).where("number is not null and date is not null and action is not null")


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("source", "action").agg(F.count("*").alias("n"), F.count_distinct("number").alias("n_numbers"), F.min("date").alias("first"), F.max("date").alias("last"))


def dated(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows(date, listed, reference, ...) with `on`, the first date that there is, and `via`:
    the start, the listing, or the reference's publication, references(reference, published).
    Rows without any stay undated."""
    r = references.select(F.upper("reference").alias("_r"), "published")
    out = rows.join(r, F.upper("reference") == F.col("_r"), "left").drop("_r")
    via = F.when(F.col("date").isNotNull(), "start").when(F.col("listed").isNotNull(), "listing").when(F.col("published").isNotNull(), F.concat(F.lit("reference:"), F.upper("reference")))
    return out.withColumns({"on": F.coalesce("date", "listed", "published"), "via": via}).drop("published")


def modal_population(days: DataFrame, statics: DataFrame, cutoffs: DataFrame, lookback: int) -> DataFrame:
    """(cutoff, number): valid numbers that transmitters seen in the look-back window reported most
    often by the cutoff; of equally frequent ones the least."""
    seen = days.join(F.broadcast(cutoffs), (F.col("day") <= F.col("cutoff")) & (F.col("day") >= F.date_sub("cutoff", lookback))).select("cutoff", "mmsi").distinct()
    said = statics.where("number > 0").join(F.broadcast(cutoffs), F.col("observed_at") <= end_of("cutoff"))
    modal = said.groupBy("cutoff", "mmsi", "number").agg(F.count("*").alias("n")).groupBy("cutoff", "mmsi").agg(F.max_by("number", F.struct("n", -F.col("number"))).alias("number"))
    return seen.join(modal, ["cutoff", "mmsi"]).where(number_valid("number")).select("cutoff", "number").distinct()


def prefix_table(rows: DataFrame, shared: dict) -> DataFrame:
    """(prefix, country), one row a prefix. A prefix of several countries has the one that `shared`
    declares; one that isn't declared raises."""
    rows = rows.where("country is not null")
    clash = rows.groupBy("prefix").agg(F.array_sort(F.collect_set("country")).alias("countries")).where((F.size("countries") > 1) & ~F.col("prefix").isin(list(shared) or [-1])).orderBy("prefix").limit(20).collect()
    if clash:
        raise ValueError("prefixes of several countries: " + ", ".join(f"{r['prefix']} {list(r['countries'])}" for r in clash))
    said = F.create_map(*[F.lit(x) for kv in shared.items() for x in kv])[F.col("prefix")] if shared else F.lit(None).cast("string")
    return rows.groupBy("prefix").agg(F.min("country").alias("country")).withColumn("country", F.coalesce(said, "country"))


def flag_by_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """rows(mmsi) with `flag`: the country of the first three digits of nine that begin with 2 to 7.
    Prefixes are three digits, so there are at most 1000 to broadcast."""
    text = F.col("mmsi").cast("string")
    key = F.when((F.length(text) == 9) & F.substring(text, 1, 1).between("2", "7"), F.substring(text, 1, 3).cast("int"))
    p = prefixes.where("prefix between 0 and 999").select(F.col("prefix").alias("_p"), F.col("country").alias("flag"))
    return rows.withColumn("_k", key).join(F.broadcast(p), F.col("_k") == F.col("_p"), "left").drop("_k", "_p")


def clean_name(name, placeholders=("", "0", "NONE", "UNKNOWN")) -> F.Column:
    """A name in upper case; null for placeholders and for names with signs that no name has."""
    up = F.upper(F.trim(F.col(name)))
    return F.when(~up.isin(*placeholders) & ~up.rlike(r"[^A-Z0-9 .,'&()/+\-]"), up)


def silver_agreement(pairs: DataFrame, entities: DataFrame, method: str = "vote") -> DataFrame:
    """One row: of third-party pairs(number, mmsi) with an entity by `method`, how many agree."""
    p = pairs.where("number is not null and mmsi is not null").select("number", "mmsi").distinct()
    e = entities.where(F.col("method") == method).select(F.col("mmsi").alias("_m"), F.col("entity").try_cast("bigint").alias("voted"))
    each = p.join(e, F.col("mmsi") == F.col("_m"), "left").groupBy("number", "mmsi").agg(F.count("_m").alias("n"), F.coalesce(F.bool_or(F.col("voted") == F.col("number")), F.lit(False)).alias("ok"))
    out = each.agg(F.count(F.when(F.col("n") > 0, 1)).alias("pairs"), F.count(F.when(F.col("ok"), 1)).alias("agree"), F.count(F.when((F.col("n") > 0) & ~F.col("ok"), 1)).alias("disagree"))
    return out.withColumn("precision", F.when(F.col("pairs") > 0, F.round(F.col("agree") / F.col("pairs"), 4)))


def population_crosscheck(days: DataFrame, actions: DataFrame, least: float = 100.0) -> DataFrame:
    """One row: transmitters of a carrier's size that never told a carrier's type, days(mmsi, length,
    ship_type, carrier_today, number), and how many of their modal numbers were later added."""
    odd = days.where((F.col("length") >= least) & (F.col("ship_type").isNull() | F.lower("ship_type").isin("undefined", "unknown", "other")))
    odd = odd.groupBy("mmsi").agg(F.mode("number", True).alias("number"), F.bool_or("carrier_today").alias("carrier"), F.count("*").alias("n_days")).where(~F.coalesce("carrier", F.lit(False)))
    added = actions.where("action = 'add'").select(F.col("number").alias("_n")).distinct()
    return odd.join(added, F.col("number") == F.col("_n"), "left").agg(F.count("*").alias("n_transmitters"), F.count_distinct("_n").alias("n_later_added"))


def vessels_of(parties: DataFrame) -> DataFrame:
    """parties(id, name, kind, remarks): the vessels with the first number of seven digits after IMO
    in their remarks."""
    number = F.regexp_extract(F.coalesce("remarks", F.lit("")), r"(?i)\bIMO\s*(\d{7})\b", 1)
    return parties.where(F.lower(F.trim("kind")) == "vessel").select("id", "name", F.nullif(number, F.lit("")).cast("bigint").alias("number"))


def names_in_force(intervals: DataFrame, at: DataFrame) -> DataFrame:
    """(cutoff, entity, name, flag) of the interval that began last by each cutoff."""
    rows = known(intervals.withColumn("observed_at", F.col("start")), at, None)
    order = F.struct("start", "mmsi")
    return rows.groupBy("cutoff", "entity").agg(F.max_by("name", F.when(F.col("name").isNotNull(), order)).alias("name"), F.max_by("flag", F.when(F.col("flag").isNotNull(), order)).alias("flag"))


def dossiers(events: DataFrame, at: DataFrame, most: int = 200) -> DataFrame:
    """(cutoff, entity, n, events): the last `most` events(mmsi, observed_at, kind, event_id) of
    each entity by each cutoff, in order of time. The bound holds before rows are gathered."""
    rows = known(events, at, None)
    w = Window.partitionBy("cutoff", "entity").orderBy(F.desc("observed_at"), F.desc("kind"), F.desc("event_id"))
    every = Window.partitionBy("cutoff", "entity")
    last = rows.withColumns({"_n": F.row_number().over(w), "n": F.count("*").over(every)}).where(F.col("_n") <= most)
    return last.groupBy("cutoff", "entity", "n").agg(F.array_sort(F.collect_list(F.struct("observed_at", "kind", "event_id"))).alias("events"))


def partners(meetings: DataFrame, at: DataFrame) -> DataFrame:
    """(cutoff, entity, partner, observed_at, hours) of meetings(a, b, observed_at, hours), one row for
    each side, where the two are different entities by the cutoff: sides are rows, so joins are equi-joins."""
    sides = meetings.select("observed_at", "hours", F.explode(F.array(F.struct(F.col("a").alias("mmsi"), F.col("b").alias("other")), F.struct(F.col("b").alias("mmsi"), F.col("a").alias("other")))).alias("s")).select("observed_at", "hours", "s.mmsi", "s.other")
    o = at.select(F.col("cutoff").alias("_c"), F.col("mmsi").alias("_m"), F.col("entity").alias("partner"))
    rows = known(sides, at, None).join(o, (F.col("cutoff") == F.col("_c")) & (F.col("other") == F.col("_m")))
    return rows.where("entity <> partner").select("cutoff", "entity", "partner", "observed_at", "hours")


def verdicts(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """findings(brief, claim) with the verdict on the same claim of the same brief, whatever the case
    and white space of the two texts."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    j = judged.select(F.col("brief").alias("_b"), norm("claim").alias("_k"), "verdict").dropDuplicates(["_b", "_k"])
    return findings.join(j, (F.col("brief") == F.col("_b")) & (norm("claim") == F.col("_k")), "left").drop("_b", "_k")


def verifier_summary(results: DataFrame, rules: list) -> DataFrame:
    """One row of results(passes, first_pass, repaired, a count for each rule)."""
    n = lambda c: F.count(F.when(c, 1))
    out = results.agg(F.count("*").alias("briefs"), n(F.col("passes")).alias("clean"), n(F.coalesce("first_pass", "passes")).alias("clean_first"), n(F.col("repaired")).alias("repaired"), *[n(F.col(r) > 0).alias(f"with_{r}") for r in rules])
    return out.withColumn("share_clean", F.when(F.col("briefs") > 0, F.round(F.col("clean") / F.col("briefs"), 4)))


def coverage(events: DataFrame, requested: DataFrame) -> DataFrame:
    """(type, n, n_ids, share): events by type and the share of the requested ids that have any."""
    total = requested.select("id").distinct().agg(F.count("*").alias("total"))
    got = events.join(requested.select("id").distinct(), "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))
    return got.join(F.broadcast(total)).select("type", "n", "n_ids", F.round(F.col("n_ids") / F.col("total"), 4).alias("share"))


def tag_profile(rows: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """(value, n) of a column of lists in texts: rows that name each value."""
    each = rows.select(F.explode(F.array_distinct(F.transform(F.split(F.coalesce(column, F.lit("")), sep), lambda x: F.trim(x)))).alias("value"))
    return each.where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def meeting_readiness(positions: DataFrame, *, box, metres: float = 500.0, max_kn: float = 2.0, least: int = 120) -> DataFrame:
    """One row: pairs of slow transmitters in a box that are nearer than `metres` in at least `least`
    minutes; slow minutes, transmitters and rows in the box. Pairs meet within a minute and a cell."""
    from .spatial import pair_join

    inside = positions.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    slow = inside.where(F.col("sog") < max_kn).groupBy("mmsi", F.date_trunc("minute", "observed_at").cast("timestamp_ntz").alias("minute"))
    slow = slow.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    met = pair_join(slow, "mmsi", "minute", metres, places=False).groupBy("a", "b").agg(F.count("*").alias("minutes"))
    pairs = met.agg(F.count(F.when(F.col("minutes") >= least, 1)).alias("pairs"))
    told = slow.agg(F.count("*").alias("slow_minutes"), F.count_distinct("mmsi").alias("slow_transmitters"))
    rows = inside.agg(F.count("*").alias("rows_in_box"), F.count_distinct("mmsi").alias("transmitters_in_box"))
    return pairs.join(F.broadcast(told)).join(F.broadcast(rows))  # one row each


def jump_km(rows: DataFrame) -> DataFrame:
    """rows(mmsi, observed_at, lat, lon) with `km` from the row before of the same transmitter."""
    w = Window.partitionBy("mmsi").orderBy("observed_at", "event_id")
    before = {f"_{c}": F.lag(c).over(w) for c in ("lat", "lon")}
    return rows.withColumns(before).withColumn("km", haversine_km("_lat", "_lon", "lat", "lon")).drop("_lat", "_lon")
