import datetime as dt

from pyspark.sql import functions as F

from tidemark import functions as C
from tidemark.operators import detect as D
from tidemark.operators import evidence as E
from tidemark.operators import identity as R
from tidemark.operators import ingest as I
from tidemark.operators import labels as L
from tidemark.operators import meetings as H
from tidemark.operators import models as N
from tidemark.operators import score as M
from tidemark.operators import spatial as S
from tidemark.operators import temporal as T

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sessionize_splits_beyond_tolerance(spark):
    df = spark.createDataFrame([(1, at(m), i) for i, m in enumerate([0, 30, 61, 200])], "k int, ts timestamp_ntz, i int")
    assert [r.session for r in T.sessionize(df, "k", "ts", "i", 1860).orderBy("i").collect()] == [1, 1, 1, 2]
    assert [r.session for r in T.sessionize(df, "k", "ts", "i", 1800).orderBy("i").collect()] == [1, 1, 2, 3]


def test_asof_left_takes_the_last_at_or_before_even_if_null(spark):
    left = spark.createDataFrame([(1, at(10)), (1, at(0)), (2, at(10))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(5), "a"), (1, at(10), None), (1, at(11), "c")], "k int, s timestamp_ntz, v string")
    out = T.asof_left(left, right, "k", "t", "s", ["v"]).collect()
    assert {(r.k, r.t): r.v for r in out} == {(1, at(10)): None, (1, at(0)): None, (2, at(10)): None}
    out = T.asof_left(left.withColumn("t", F.col("t") - F.expr("interval 1 minute")), right, "k", "t", "s", ["v"])
    assert [r.v for r in out.orderBy("k", "t").collect()] == [None, "a", None]


def test_change_points_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", None])], "k int, i int, v string")
    assert rows(T.change_points(df, "k", ["i"], ["v"]), "i") == [(0,), (2,), (4,)]


def test_downsample_by_speed(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=s), 10.0 if s < 600 else 1.0, s) for s in range(1200)], "k int, ts timestamp_ntz, sog double, i int")
    assert T.downsample(df, "k", "ts", "sog", "i").count() == 10 + 20


def test_jump_in_no_time(spark):
    df = spark.createDataFrame([(1, at(0), 55.0, 10.0, 0), (1, at(0), 56.0, 10.0, 1), (1, at(600), 56.0, 10.0, 2)], "k int, ts timestamp_ntz, lat double, lon double, i int")
    assert [r.j for r in T.movement(df, "k", "ts", "i").orderBy("i").select(T.is_jump().alias("j")).collect()] == [False, True, False]


def test_monthly_cutoffs(spark):
    out = T.monthly_cutoffs(spark, "2023-06-01", "2025-12-31", "2025-12-31").orderBy("cutoff").collect()
    assert out[0].cutoff == dt.date(2023, 11, 30) and out[-1].cutoff == dt.date(2025, 6, 30)
    assert [r.supervised for r in out].index(True) == 6


def test_pair_join_over_bucket_edges(spark):
    df = spark.createDataFrame([(1, 0, 54.9999, 9.9999), (2, 0, 55.0001, 10.0001), (3, 0, 55.05, 10.0), (1, 1, 55.0, 10.0)], "k int, slot int, lat double, lon double")
    assert rows(S.pair_join(df, "k", "slot", 500.0), "a", "b", "slot") == [(1, 2, 0)]


def test_pair_join_matches_a_loop_at_poles_and_the_date_line(spark):
    import math
    import random

    random.seed(5)

    def metres(p, q):
        f = math.radians
        h = math.sin(f(q[0] - p[0]) / 2) ** 2 + math.cos(f(p[0])) * math.cos(f(q[0])) * math.sin(f(q[1] - p[1]) / 2) ** 2
        return 2000 * C.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    near, points = math.degrees(3 / C.EARTH_KM), []
    for lat in (-90, -89.0, -75, 0, 55, 70, 88.99, 89.9):
        for lon in (180, 10):
            for _ in range(25):
                y = max(-90.0, lat + random.uniform(-3, 3) * near)
                x = lon + random.uniform(-4, 4) * near / max(0.005, math.cos(math.radians(lat)))
                points.append((len(points), random.choice([0, 1]), y, (x + 180) % 360 - 180))
    want = sorted((p[0], q[0]) for i, p in enumerate(points) for q in points[i + 1 :] if p[1] == q[1] and metres(p[2:], q[2:]) < 3000)
    df = spark.createDataFrame(points, "k int, slot int, lat double, lon double")
    assert len(want) > 100 and rows(S.pair_join(df, "k", "slot", 3000.0), "a", "b") == want
    assert rows(S.pair_join(df, "k", "slot", 3000.0, 0.1), "a", "b") == want


def test_pair_join_looks_into_five_cells_at_most_and_prints_no_numbers(spark):
    import random

    import duckdb

    random.seed(2)
    df = spark.createDataFrame([(i, 0, random.uniform(-80, 80), random.uniform(-180, 180)) for i in range(500)], "k int, slot int, lat double, lon double")
    assert S._cells(df, 1000.0, 0.0)[1].groupBy("k").count().agg(F.max("count")).first()[0] <= 5
    values = [random.uniform(0, 1000) for _ in range(500)] + [0.0, 0.00005, 0.00015, 2.5, 999.99995]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.round_positive("v", 4).alias("v")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in values]


def _shuffled(spark):
    """Rows that the session has written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pair_join_shuffles_rows_once_and_nothing_of_the_cells_around(spark):
    import random

    random.seed(4)
    data = [(i, i % 5, random.uniform(55, 55.1), random.uniform(10, 10.1)) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, slot int, lat double, lon double")
    met = S.pair_join(df, "k", "slot", 1000.0)
    before = _shuffled(spark)
    assert met.count() > 3000
    # a copy at the edge of a tile, and the counts of tiles; the cells ahead were some 4 copies of them
    assert _shuffled(spark) - before < 1.5 * 3000


def test_pair_join_splits_crowded_tiles_and_leaves_odd_rows_out(spark, monkeypatch):
    """Against a loop: blocks of two groups, few candidates at a time, text keys, keys that repeat in a slot."""
    import math
    import random

    random.seed(6)

    def metres(p, q):
        f = math.radians
        h = math.sin(f(q[2] - p[2]) / 2) ** 2 + math.cos(f(p[2])) * math.cos(f(q[2])) * math.sin(f(q[3] - p[3]) / 2) ** 2
        return 2000 * C.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    points = []
    for lat, lon in ((-90.0, 0.0), (55.0, 180.0), (0.0, 0.0)):
        for _ in range(80):
            x = lon + random.uniform(-0.1, 0.1) / max(0.002, math.cos(math.radians(lat)))
            points.append((f"k{random.randrange(90):02}", random.choice([0, 1]), max(-90.0, lat + random.uniform(-0.1, 0.1)), (x + 180) % 360 - 180))
    odd = [("k00", 0, math.nan, 0.0), ("k00", 0, math.inf, 0.0), ("k00", 0, 0.0, math.nan), ("k00", 0, None, 0.0), ("k00", None, 0.0, 0.0), (None, 0, 0.0, 0.0)]
    df = spark.createDataFrame(points + odd, "k string, slot int, lat double, lon double")
    for limit in (3000.0, 2e7):
        pairs = [sorted((p, q)) for i, p in enumerate(points) for q in points[i + 1 :] if p[1] == q[1] and p[0] != q[0] and metres(p, q) < limit]
        want = sorted((p[0], q[0], p[1], *p[2:], *q[2:]) for p, q in pairs)
        for crowd, step in ((50_000, 1 << 16), (30, 100)):
            monkeypatch.setattr(S, "CROWD", crowd)
            monkeypatch.setattr(S, "STEP", step)
            assert len(want) > 300 and rows(S.pair_join(df, "k", "slot", limit), "a", "b", "slot", "lat_a", "lon_a", "lat_b", "lon_b") == want
    assert rows(S.pair_join(df, "k", "slot", 2e7, places=False), "a", "b", "slot") == [r[:3] for r in want]


def test_pair_runs_are_those_of_all_meetings_and_shuffle_none(spark, monkeypatch):
    """Against sessions of the pair join: poles, the date line, many blocks, few candidates at a time."""
    import random

    random.seed(7)
    places = [(lat, lon) for lat in (-89.99, 0.0, 55.0, 89.5) for lon in (180.0, 0.0, 10.0)]
    data = []
    for k in range(60):
        lat, lon = random.choice(places)
        for slot in sorted(random.sample(range(24), 12)):
            x = lon + random.uniform(-0.02, 0.02) / max(0.005, abs(90 - abs(lat)) / 57)
            data.append((f"k{k:02}", at(60 * slot), lat + random.uniform(-0.01, 0.01), (x + 180) % 360 - 180))
    df = spark.createDataFrame(data, "k string, slot timestamp_ntz, lat double, lon double")
    met = T.sessionize(S.pair_join(df, "k", "slot", 1000.0), ["a", "b"], "slot", "slot", 3 * 3600.0).groupBy("a", "b", "session")
    closest = met.agg(F.round(F.min("distance_m"), 5).alias("m"), F.min("slot").alias("start"))
    want = rows(met.agg(F.min("slot").alias("start"), F.max("slot").alias("end"), F.count("*").alias("n")), "a", "b", "start", "end", "n")
    monkeypatch.setattr(H, "STEP", 50)
    for per_block in (100_000, 100):
        assert rows(H.pair_runs(df, "k", "slot", 1000.0, 3 * 3600.0, rows_per_block=per_block), "a", "b", "start", "end", "n") == want
    assert len(want) > 100 and rows(H.pair_runs(df, "k", "slot", 1000.0, 3 * 3600.0, least=2), "a", "b", "n") == sorted((a, b, n) for a, b, _, _, n in want if n > 1)
    got = H.pair_runs(df, "k", "slot", 1000.0, 3 * 3600.0, distance=True, rows_per_block=300).withColumn("m", F.round("min_distance_m", 5))
    assert rows(got, "a", "b", "start", "m") == rows(closest, "a", "b", "start", "m")
    assert H.pair_runs(df.where("k < ''"), "k", "slot", 1000.0, 60.0).count() == 0


def test_pair_sessions_keep_pairs_out_of_shuffles(spark):
    from tidemark import plans

    plan = plans.QUERIES["pair_sessions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_nearest_near_the_pole_matches_a_loop(spark):
    import math
    import random

    random.seed(3)
    a = [(i, random.uniform(70, 79.5), random.uniform(0, 3)) for i in range(60)]
    b = [(random.uniform(70, 79.5), random.uniform(0, 3)) for _ in range(60)]

    def km(p, q):
        f = math.radians
        h = math.sin(f(q[0] - p[0]) / 2) ** 2 + math.cos(f(p[0])) * math.cos(f(q[0])) * math.sin(f(q[1] - p[1]) / 2) ** 2
        return 2 * C.EARTH_KM * math.asin(math.sqrt(h))

    want = {i: min((d for q in b if (d := km((x, y), q)) <= 25), default=None) for i, x, y in a}
    got = S.nearest(spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "lat double, lon double"), 25.0, "i").collect()
    assert {r.i: r.nearest_km and round(r.nearest_km, 6) for r in got} == {k: v and round(v, 6) for k, v in want.items()}


def _pair(spark, hours, metres, sog=0.5, nav="under way"):
    step = metres / 111_195.0
    data = [(k, at(m), 55.0 + (step if k == 2 else 0) + (0.05 if k == 3 else 0), 10.0, sog, nav) for m in range(int(hours * 60) + 1) for k in (1, 2, 3)]
    return spark.createDataFrame(data, "mmsi int, observed_at timestamp_ntz, lat double, lon double, sog double, nav_status string")


def test_transfers_fire_and_near_misses(spark):
    assert rows(D.transfers(_pair(spark, 3, 200)), "a", "b", "hours") == [(1, 2, 3.0)]
    for near in (_pair(spark, 1.5, 400), _pair(spark, 3, 200, nav="Moored"), _pair(spark, 3, 200, sog=5.0), _pair(spark, 3, 700)):
        assert D.transfers(near).count() == 0


def test_transfers_of_pairs_further_apart_than_a_small_cell(spark):
    """2.5 km to the east are five cells of 0.01 degrees at 65 degrees of latitude."""
    east = 2500 / (111_195.0 * 0.42262)
    df = spark.createDataFrame([(k, at(m), 65.0, 10.0 + east * (k == 2), 0.5, None) for m in range(181) for k in (1, 2)], "mmsi int, observed_at timestamp_ntz, lat double, lon double, sog double, nav_status string")
    assert rows(D.transfers(df, metres=3000.0), "a", "b", "minutes") == [(1, 2, 181)]


def test_transfers_with_just_the_cover(spark):
    """Half of the minutes of a run is enough for any length, though hours are fractions."""
    for span in (125, 249):
        seen = [*range(0, span - 2, 2), span]
        df = spark.createDataFrame([(k, at(m), 55.0, 10.0, 0.5, None) for m in seen for k in (1, 2)], "mmsi int, observed_at timestamp_ntz, lat double, lon double, sog double, nav_status string")
        assert rows(D.transfers(df, min_hours=0.0), "a", "b", "minutes") == [(1, 2, (span + 1) // 2)]


def test_loitering_hours(spark):
    p = _pair(spark, 13, 200)
    assert D.loitering(p).count() == 3 and D.loitering(p, min_hours=20.0).count() == 0


def test_value_changes_and_conflicts(spark):
    read = spark.createDataFrame([(1, at(0), 10.0), (1, at(60), 14.0), (1, at(120), 14.0), (1, at(120), 9.0)], "mmsi int, observed_at timestamp_ntz, value double")
    moored = spark.createDataFrame([(1, at(60))], "mmsi int, observed_at timestamp_ntz")
    meet = spark.createDataFrame([(9, 1, at(30), at(200))], "a int, b int, start timestamp_ntz, end timestamp_ntz")
    assert rows(D.value_changes(read, moored, meet), "delta", "moored_between", "met_between") == [(4.0, False, True)]


def test_excess_incidence(spark):
    days = spark.createDataFrame([(1, "d", [("c", 4, 1)]), (2, "d", [("c", 4, 0)])], "mmsi int, day string, cells array<struct<cell:string,n_rows:int,n_jumps:int>>")
    base = spark.createDataFrame([("c", "d", 0.25)], "cell string, day string, share double")
    assert rows(D.excess_incidence(days, base), "mmsi", "excess") == [(1, 0.75), (2, -0.25)]


def test_churn_counts_established_values_once(spark):
    days = [("A", range(0, 6)), ("C", range(6, 7)), ("B", range(7, 13))]
    df = spark.createDataFrame([(1, at(1440 * d), v) for v, r in days for d in r], "mmsi int, observed_at timestamp_ntz, v string")
    assert rows(D.churn(df, "v"), "old_value", "new_value", "observed_at") == [("A", "B", at(1440 * 11))]


def test_entity_map_and_as_of(spark):
    data = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=d), 9074729 if d >= 2 else None, 100.0, 20.0) for d in range(8)]
    m = R.entity_map(spark.createDataFrame(data, "mmsi int, day date, number bigint, length double, width double"), "2024-01-01", window_days=2, min_days=2)
    cuts = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 5),)], "cutoff date")
    got = {r.cutoff.day: r.entity for r in R.entity_at(m, cuts).collect()}
    assert got[3].startswith("syn:") and len(got[3]) == 20 and got[5] == "9074729"


def test_number_checksum(spark):
    df = spark.createDataFrame([(9074729,), (9074728,), (123,), (None,)], "n bigint")
    assert [r.v for r in df.select(C.number_valid("n").alias("v")).collect()] == [True, False, False, False]


ACTIONS = [(1, "2025-01-10", "add", "A"), (2, "2024-05-01", "add", "A"), (2, "2024-12-01", "remove", "A"), (3, "2024-06-25", "add", "B"), (1, "2025-02-20", "add", "C")]


def _actions(spark):
    return spark.createDataFrame(ACTIONS, "id int, d string, action string, source string").select("id", F.to_date("d").alias("date"), "action", "source")


def test_replay_and_labels(spark):
    cut = spark.createDataFrame([(dt.date(2024, 12, 31),), (dt.date(2024, 6, 30),)], "cutoff date")
    assert rows(L.listed_as_of(_actions(spark), cut), "cutoff", "id") == [(dt.date(2024, 6, 30), 2), (dt.date(2024, 6, 30), 3), (dt.date(2024, 12, 31), 3)]
    people = cut.join(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"))
    got = rows(L.labels(people, _actions(spark), cut, 182), "cutoff", "id", "label")
    assert got == [(dt.date(2024, 6, 30), 1, 0), (dt.date(2024, 6, 30), 4, 0), (dt.date(2024, 12, 31), 1, 1), (dt.date(2024, 12, 31), 2, 0), (dt.date(2024, 12, 31), 4, 0)]


def test_first_add_window_is_half_open(spark):
    day = lambda s: spark.createDataFrame([(dt.date.fromisoformat(s),)], "cutoff date")
    assert L.first_add_in_window(_actions(spark), day("2025-01-10"), 30).count() == 0
    assert L.first_add_in_window(_actions(spark), day("2025-01-09"), 1).count() == 1


def test_metrics_by_hand(spark):
    s = spark.createDataFrame([("t", i, float(10 - i), int(i in (0, 3))) for i in range(10)], "cutoff string, id int, score double, label int")
    r = M.at_k(s, 2).first()
    assert (r.precision, r.recall, r.alerts_half) == (0.5, 0.5, 1) and M.at_k(s, 99).first().precision == 0.2
    assert M.average_precision(s).first().average_precision == round(0.5 + 0.5 * 2 / 4, 6)
    assert M.average_precision(s.withColumn("score", F.lit(1.0))).first().average_precision == 0.2
    assert M.at_k(s.withColumn("label", F.lit(0)), 2).first().precision is None


def test_psi_of_same_and_shifted(spark):
    data = [(side, float(i + (300 if side and shift else 0)), float(i)) for shift in (1,) for side in (0, 1) for i in range(1000)]
    got = {r.feature: r.psi for r in M.psi(spark.createDataFrame(data, "side int, moved double, same double"), "side", ["moved", "same"]).collect()}
    assert got["same"] == 0 and got["moved"] > 0.25


def test_kappa(spark):
    df = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    assert M.kappa(df).first().kappa == 0.4
    assert M.kappa(df.where("a = 'y' and b = 'y'")).first().kappa is None


def test_violations_of_lists(spark):
    df = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 8, 0.95), (1, 4, 9, 0.1)], "cutoff int, rank int, id int, score double")
    assert rows(M.list_violations(df), "rank", "broken") == [(2, "score"), (4, "rank")]


def test_thinning_matches_a_loop(spark):
    import random

    random.seed(5)
    track, t = [], 0
    for i in range(300):
        t += random.choice([60, 200, 900])
        track.append((i % 2, T0 + dt.timedelta(seconds=t), i))
    want = []
    for m in (0, 1):
        own, held = [x for x in track if x[0] == m], None
        for j, x in enumerate(own):
            gap = j + 1 == len(own) or (own[j + 1][1] - x[1]).total_seconds() >= 600
            if held is None or gap or (x[1] - held).total_seconds() >= 600:
                want.append(x)
                held = x[1]
    got = E.thin(spark.createDataFrame(track, "mmsi int, observed_at timestamp_ntz, event_id int"))
    assert rows(got, "mmsi", "observed_at", "event_id") == sorted(want)


def test_ungrounded_numbers_and_positions(spark):
    said = spark.createDataFrame([(1, "12 gaps of 3.5 hours")], "k int, text string")
    known = spark.createDataFrame([(1, "3.5 hours")], "k int, text string")
    assert rows(E.ungrounded_numbers(said, known, "k"), "number") == [("12",)]
    track = spark.createDataFrame([(1, at(0), 0.0, 0.0), (1, at(10), 10.0, 20.0)], "mmsi int, observed_at timestamp_ntz, lat double, lon double")
    ask = spark.createDataFrame([(1, at(5)), (1, at(10)), (1, at(20))], "mmsi int, at timestamp_ntz")
    assert rows(E.position_at(track, ask).where("lat is not null"), "at", "lat", "lon") == [(at(5), 5.0, 10.0), (at(10), 10.0, 20.0)]


def test_day_tables(spark):
    def line(m, mmsi, lat, kind="Tanker", length="180", draught="10"):
        return (at(m).strftime("%d/%m/%Y %H:%M:%S"), "Class A", str(mmsi), str(lat), "10.5", "1.0", kind, length, draught, "AIS")

    raw = [line(m, 1, 55.0, draught="10" if m < 30 else "14") for m in range(60)] + [line(m, 2, 55.0, kind="Fishing", length="20") for m in range(5)]
    raw += [line(0, 1, 55.0), ("bad", "Class A", "1", "x", "y", "", "", "", "", "AIS"), line(70, 1, 0.0)[:4] + ("0.0",) + line(70, 1, 0.0)[5:]]
    t = I.day_tables(spark.createDataFrame(raw, "timestamp string, mobile_type string, mmsi string, lat string, lon string, sog string, ship_type string, length string, draught string, data_source string"))
    assert rows(t["vessel_day"], "mmsi", "n_rows", "n_bad_positions", "kept") == [(1, 61, 1, True), (2, 5, 0, False)]
    assert t["dynamic"].count() == 60 and rows(t["static"], "draught") == [(10.0,), (10.0,), (14.0,)]
    assert {r[0] for r in rows(t["static"], "mmsi")} == {1}


def test_models_find_planted_signals(spark):
    import random

    random.seed(1)
    data = [(c, i, float(i % 5 == 0) * 3 + random.random(), random.random(), int(i % 5 == 0)) for c in (1, 2) for i in range(200)]
    df = spark.createDataFrame(data, "cutoff int, id int, a double, b double, label int")
    train, test = df.where("cutoff = 1"), df.where("cutoff = 2")
    for out in (N.logistic(train, test, ["a", "b"]), N.boosted(train, test, ["a", "b"], seeds=(1,))):
        assert M.average_precision(out.select("cutoff", "id", "score", "label")).first().average_precision > 0.99
    assert N.logistic(train.withColumn("label", F.lit(0)), test, ["a"]).agg(F.max("score")).first()[0] == 0
    odd = df.withColumn("a", F.when(F.col("id") == 7, 50.0).otherwise(F.col("a")))
    top = N.isolation_forest(odd, ["a", "b"], trees=30).orderBy(F.desc("score")).limit(2).collect()
    assert {r.id for r in top} == {7}


def test_decimated_tracks_keep_gap_starts_and_the_last_fix(spark):
    t0 = dt.datetime(2024, 1, 1)
    minutes = [10 * i + (120 if i >= 22 else 0) for i in range(41)]
    track = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=x), i) for i, x in enumerate(minutes)], "mmsi int, observed_at timestamp_ntz, event_id int")
    for most in (40, 7):
        got = [r.event_id for r in E.thin(track, most=most).orderBy("event_id").collect()]
        assert got == sorted({int(j * (41 / most)) for j in range(most)} | {22, 40})
