"""Runs of meetings, without a table of all meetings: they grow with the square of the input."""

import math
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EARTH_KM
from .reuse import settled

#: Candidates that are looked at together.
STEP = 1 << 19


def pair_runs(df: DataFrame, key: str, slot: str, metres: float, tolerance_s: float, *, least: int = 1, distance: bool = False, rows_per_block: int = 100_000) -> DataFrame:
    """(a, b, start, end, n): the meetings of spatial.pair_join as runs in which each slot (a time) is
    within the tolerance of the one before; runs of at least `least` meetings. With `distance` also the
    least distance of a run, min_distance_m.

    Keys are dealt to g groups, and a task gets all rows of two groups. So it has all meetings of
    its pairs and forms their runs itself: what is shuffled is g copies of the rows, never the
    meetings. g grows with the root of the rows, until a task has 3,000,000 rows; from there on it
    grows with the rows. A task holds its rows and the candidates of a few keys at a time."""
    rows = df.select(F.col(key).alias("k"), F.col(slot).alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    each = settled(rows.groupBy("k").agg(F.collect_list(F.struct("t", "lat", "lon")).alias("r")).select("k", "r.t", "r.lat", "r.lon"))
    n = each.agg(F.sum(F.size("t"))).first()[0] or 0
    g = max(1, math.ceil(math.sqrt(2 * n / rows_per_block)), math.ceil(n / 1_500_000))
    own = F.pmod(F.xxhash64("k"), F.lit(g)).cast("int")
    dealt = each.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # blocks (low, high) in the order of high
    dealt = dealt.withColumn("block", (high * (high + 1) / 2).cast("int") + low).withColumn("first", F.col("own") == low)
    dealt = dealt.select("block", "first", (low == high).alias("alone"), "k", "t", "lat", "lon")
    blocks = dealt.repartitionById(g * (g + 1) // 2, "block").sortWithinPartitions("block")
    return blocks.mapInArrow(partial(_tasks, metres=metres, tolerance=int(tolerance_s * 1e6), least=least, distance=distance), f"a {kinds['k']}, b {kinds['k']}, start {kinds['t']}, end {kinds['t']}, n bigint" + (", min_distance_m double" if distance else ""))


def _tasks(batches, metres, tolerance, least, distance):
    """Blocks of a task, one after the other."""
    import numpy as np
    import pyarrow as pa

    now, parts = None, []
    for batch in batches:
        ids = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if ids[i] != now and parts:
                yield from _runs(pa.Table.from_batches(parts), metres, tolerance, least, distance)
                parts = []
            now = ids[i]
            parts.append(batch.slice(i, j - i))
    if parts:
        yield from _runs(pa.Table.from_batches(parts), metres, tolerance, least, distance)


def _runs(table, metres, tolerance, least, distance):
    """Runs of the pairs of one block: first with second keys, or all with all where it is alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.take(pc.sort_indices(table.column("k"))).combine_chunks()
    keys, alone = table.column("k").combine_chunks(), table.column("alone")[0].as_py()
    first = table.column("first").to_numpy()
    if not alone and (first.all() or not first.any()):
        return
    user = np.repeat(np.arange(len(first)), pc.list_value_length(table.column("t")).to_numpy())
    flat = {c: pc.list_flatten(table.column(c)).combine_chunks() for c in ("t", "lat", "lon")}
    kind, lat, lon = flat["t"].type, flat["lat"].to_numpy(), flat["lon"].to_numpy()
    times, slot = np.unique(flat["t"].cast(pa.int64()).to_numpy(), return_inverse=True)
    del table, flat
    lr, gr = np.radians(lat), np.radians(lon)
    xyz = [np.cos(lr) * np.cos(gr), np.cos(lr) * np.sin(gr), np.sin(lr)]
    limit = (2 * math.sin(min(metres / 1000.0 / EARTH_KM, math.pi) / 2)) ** 2

    def apart_m(p, o):
        """Distances as haversine_km has them."""
        h = np.sin(np.radians(lat[o] - lat[p]) / 2) ** 2 + np.cos(lr[p]) * np.cos(lr[o]) * np.sin(np.radians(lon[o] - lon[p]) / 2) ** 2
        return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))) * 1000.0

    sure, never = limit * (1 - 1e-6) - 1e-14, limit * (1 + 1e-6) + 1e-14

    # second rows in the order of slot, band of latitude and longitude (in steps of 360 / 2**25 degrees)
    reach = math.degrees(metres / 1000.0 / EARTH_KM) * (1 + 1e-9) + 1e-9
    height = max(reach, 0.005)
    band = np.floor(lat / height).astype(np.int64)
    base = band.min() - 1
    n_bands = int(band.max() - base + 2)
    step = lambda x: np.clip(np.floor(x / 360.0 * 2**25), 0, 2**25 - 1).astype(np.int64)
    around = np.mod(lon, 360.0)
    second = np.arange(len(user)) if alone else np.flatnonzero(~first[user])
    name = ((slot[second] * n_bands + band[second] - base) << 25) + step(around[second])
    order = np.argsort(name, kind="stable")
    name, second = name[order], second[order]
    s_xyz, s_user = [c[second] for c in xyz], user[second]

    # where first rows look: three bands, and over the ends of the circle of longitude
    a = np.arange(len(user)) if alone else np.flatnonzero(first[user])
    cos = np.cos(np.radians(np.minimum(90.0, np.abs(lat[a]) + reach)))
    with np.errstate(divide="ignore"):
        wide = np.degrees(2 * np.arcsin(np.minimum(1.0, math.sin(math.radians(min(reach, 180.0)) / 2) / cos))) * (1 + 1e-9) + 1e-9
    lo, hi, row = around[a] - wide, around[a] + wide, a
    over, under = np.flatnonzero((hi >= 360) & (wide < 180)), np.flatnonzero((lo < 0) & (wide < 180))
    row = np.concatenate([a, a[over], a[under]])
    lo, hi = np.concatenate([lo, np.zeros(len(over)), lo[under] + 360]), np.concatenate([hi, hi[over] - 360, np.full(len(under), 360.0)])
    whole = hi - lo >= 360
    lo, hi = step(np.where(whole, 0.0, lo)), step(np.where(whole, 360.0, hi))
    begin, end, rows = [], [], []
    for d in (-1, 0, 1):
        on = np.floor((lat[row] + d * reach) / height).astype(np.int64) - band[row] == d
        head = (slot[row[on]] * n_bands + band[row[on]] + d - base) << 25
        begin.append(np.searchsorted(name, head + lo[on], "left"))
        end.append(np.searchsorted(name, head + hi[on], "right"))
        rows.append(row[on])
    begin, end, rows = map(np.concatenate, (begin, end, rows))
    some = end > begin
    begin, end, rows = begin[some], end[some], rows[some]
    order = np.argsort(rows, kind="stable")  # rows are in the order of keys
    begin, count, rows = begin[order], (end - begin)[order], rows[order]
    who = user[rows]
    stops = np.append(np.flatnonzero(np.diff(who)) + 1, len(who)) if len(who) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    n_users, bits = len(first), max(1, int(len(times) - 1).bit_length())

    i = 0
    while i < len(who):
        # all candidates of some keys
        at = np.searchsorted(total[stops], total[i] + STEP, "right") - 1
        j = int(stops[max(at, np.searchsorted(stops, i, "right"))])
        c, q = count[i:j], rows[i:j]
        near = np.arange(total[j] - total[i]) + np.repeat(begin[i:j] - (total[i:j] - total[i]), c)
        apart = sum((np.repeat(f[q], c) - s[near]) ** 2 for f, s in zip(xyz, s_xyz))
        hit = apart < sure
        edge = np.flatnonzero((apart <= never) & ~hit)
        if len(edge):
            hit[edge] = apart_m(np.repeat(q, c)[edge], second[near[edge]]) < metres
        left, right = np.repeat(who[i:j] - who[i], c)[hit], s_user[near[hit]]
        met = ((left * n_users + right) << bits) + np.repeat(slot[q], c)[hit]
        if alone:
            one = left + who[i] < right
            met, hit[hit] = met[one], one
        if distance:
            order = np.argsort(met)
            met, metres_of = met[order], apart_m(np.repeat(q, c)[hit], second[near[hit]])[order]
        else:
            met.sort()
        pair, t = met >> bits, times[met & ((1 << bits) - 1)]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(met)), bool), (pair[1:] != pair[:-1]) | (t[1:] - t[:-1] > tolerance)]))
        n = np.diff(np.append(new, len(met)))
        closest = np.minimum.reduceat(metres_of, new)[n >= least] if distance and len(new) else None
        new, n = new[n >= least], n[n >= least]
        left, right = pair[new] // n_users + who[i], pair[new] % n_users
        columns = [keys.take(pa.array(f(left, right))) for f in (np.minimum, np.maximum)]
        columns += [pa.array(t[x]).cast(kind) for x in (new, new + n - 1)] + [pa.array(n)]
        if len(n):
            names = ["a", "b", "start", "end", "n"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(closest)], names=[*names, "min_distance_m"]) if distance else pa.RecordBatch.from_arrays(columns, names=names)
        i = j
