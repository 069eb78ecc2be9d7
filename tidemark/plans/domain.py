"""Queries of identity, features, labels, scores and evidence."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers_in, upper_median
from ..operators import detect as D
from ..operators import evidence as E
from ..operators import features as X
from ..operators import identity as R
from ..operators import labels as L
from ..operators import score as M
from ..operators.reuse import settled
from .adapter import ACT, CUT, HORIZON, LOOKBACK, POS, actions, cutoffs, positions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MAP = """vot AS (SELECT mmsi, datediff('day', DATE '2024-01-01', day) // 5 AS wi, number, count(DISTINCT day) AS votes FROM pos WHERE number IS NOT NULL GROUP BY 1, 2, 3),
win AS (SELECT DISTINCT mmsi, datediff('day', DATE '2024-01-01', day) // 5 AS wi FROM pos),
grd AS (SELECT w.mmsi, w.wi, n.number, coalesce(v.votes, 0) AS votes FROM win w LEFT JOIN (SELECT DISTINCT mmsi, number FROM vot) n ON w.mmsi = n.mmsi LEFT JOIN vot v ON v.mmsi = w.mmsi AND v.wi = w.wi AND v.number = n.number),
cum AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY mmsi, number ORDER BY wi) AS BIGINT) AS cum FROM grd),
bst AS (SELECT *, CASE WHEN tot > 0 THEN cum / tot::DOUBLE ELSE 0 END AS share FROM (SELECT *, sum(cum) OVER (PARTITION BY mmsi, wi) AS tot, row_number() OVER (PARTITION BY mmsi, wi ORDER BY cum DESC, number NULLS LAST) AS n FROM cum) WHERE n = 1),
shp AS (SELECT mmsi, max(length) AS length, max(width) AS width FROM pos GROUP BY mmsi),
ent AS (SELECT mmsi, wi, CAST(DATE '2024-01-01' + CAST((wi + 1) * 5 AS INTEGER) AS DATE) AS effective_from,
  CASE WHEN share >= 0.55 AND cum >= 2 THEN CAST(number AS VARCHAR) ELSE 'syn:' || substr(sha256(concat_ws('|', mmsi, length, width)), 1, 16) END AS entity,
  CASE WHEN share >= 0.55 AND cum >= 2 THEN 'vote' ELSE 'synthetic' END AS method, round(share, 6) AS support, cum AS n_votes FROM bst JOIN shp USING (mmsi))"""
AT = "atc AS (SELECT cutoff, mmsi, entity FROM (SELECT cutoff, mmsi, entity, row_number() OVER (PARTITION BY cutoff, mmsi ORDER BY effective_from DESC, entity DESC) AS n FROM ent JOIN cut ON effective_from <= cutoff) WHERE n = 1)"


def _entities(spark, sf):
    return R.entity_map(positions(spark, sf).select("mmsi", "day", "number", "length", "width"), "2024-01-01", window_days=5, min_share=0.55, min_days=2)


def _at(spark, sf):
    return R.entity_at(_entities(spark, sf), cutoffs(spark))


@query(f"WITH {POS}, {MAP} SELECT mmsi, CAST(wi AS BIGINT) AS wi, effective_from, entity, method, support, n_votes FROM ent")
def cumulative_vote(spark, sf):
    return _entities(spark, sf)


@query(f"WITH {POS}, {MAP}, {CUT}, {AT} SELECT * FROM atc")
def hull_at(spark, sf):
    return _at(spark, sf)


@query(f"WITH {POS}, {MAP}, {CUT}, {AT} SELECT cutoff, entity, count(*) AS n, count(DISTINCT mmsi) AS n_mmsi FROM pos JOIN cut ON day <= cutoff LEFT JOIN atc USING (cutoff, mmsi) GROUP BY 1, 2")
def attribution_join(spark, sf):
    rows = R.attributed(positions(spark, sf).select("mmsi", "observed_at"), _entities(spark, sf), cutoffs(spark))
    return rows.groupBy("cutoff", "entity").agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("n_mmsi"))


@query(f"""WITH {POS}, {MAP}, g(min_share, min_days) AS (VALUES (0.5::DOUBLE, 1), (0.55::DOUBLE, 2), (0.6::DOUBLE, 5))
SELECT min_share, min_days, count(*) AS n, count(*) FILTER (WHERE support >= min_share AND n_votes >= min_days) AS n_named FROM ent, g GROUP BY 1, 2""")
def threshold_sweep(spark, sf):
    grid = spark.createDataFrame([(0.5, 1), (0.55, 2), (0.6, 5)], "min_share double, min_days int")
    return R.threshold_sweep(_entities(spark, sf), grid)


INTERVALS = """cln AS (SELECT mmsi, observed_at, CASE WHEN upper(trim(name)) NOT IN ('', '0', 'NONE', 'UNKNOWN') THEN upper(trim(name)) END AS name, flag FROM pos),
one AS (SELECT mmsi, observed_at, CASE WHEN count(DISTINCT name) = 1 THEN max(name) END AS name, CASE WHEN count(DISTINCT flag) = 1 THEN max(flag) END AS flag FROM cln GROUP BY 1, 2),
lng AS (SELECT mmsi, observed_at, 'name' AS field, name AS value FROM one WHERE name IS NOT NULL UNION ALL SELECT mmsi, observed_at, 'flag', flag FROM one WHERE flag IS NOT NULL),
est AS (SELECT mmsi, field, value, since FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, field, value ORDER BY d) AS n FROM (SELECT mmsi, field, value, CAST(observed_at AS DATE) AS d, min(observed_at) AS since FROM lng GROUP BY 1, 2, 3, 4)) WHERE n = 2),
knw AS (SELECT l.mmsi, l.observed_at, max(CASE WHEN field = 'name' THEN value END) AS name, max(CASE WHEN field = 'flag' THEN value END) AS flag FROM lng l JOIN est USING (mmsi, field, value) WHERE l.observed_at >= since GROUP BY 1, 2),
fil AS (SELECT mmsi, observed_at, last_value(name IGNORE NULLS) OVER w AS name, last_value(flag IGNORE NULLS) OVER w AS flag FROM knw WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at ROWS UNBOUNDED PRECEDING)),
run AS (SELECT * FROM (SELECT *, row_number() OVER w AS n, lag(name) OVER w AS pn, lag(flag) OVER w AS pf FROM fil WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at)) WHERE n = 1 OR name IS DISTINCT FROM pn OR flag IS DISTINCT FROM pf),
itv AS (SELECT mmsi, name, flag, observed_at AS start_at, lead(observed_at) OVER (PARTITION BY mmsi ORDER BY observed_at) AS end_at FROM run)"""


def _intervals(spark, sf):
    return R.identity_intervals(positions(spark, sf), ["name", "flag"])


@query(f"WITH {POS}, {INTERVALS} SELECT * FROM itv")
def identity_intervals(spark, sf):
    return _intervals(spark, sf).withColumnsRenamed({"start": "start_at", "end": "end_at"})


WIN = f"knn AS (SELECT cutoff, entity, pos.* FROM pos JOIN atc USING (mmsi) WHERE observed_at <= cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND AND observed_at >= cutoff - {LOOKBACK})"


@query(f"WITH {POS}, {MAP}, {CUT}, {AT}, {WIN} SELECT DISTINCT cutoff, entity FROM knn")
def population_asof(spark, sf):
    return X.population(positions(spark, sf), _at(spark, sf), LOOKBACK)


TYPES = {"view": "gap", "click": "encounter", "purchase": "loitering", "error": "port_visit"}


def _third_party(p):
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("nav_status")]
    more = [c for c in ("cutoff", "entity") if c in p.columns]
    return p.select(*more, "mmsi", "observed_at", "event_id", kind.alias("type"), F.col("sog").alias("hours"), (F.col("sog") * 2).alias("km"), F.col("k").cast("double").alias("shore_km"), (F.col("k") % 9 == 0).alias("listed"), (F.col("flag") == "PA").alias("interest"))


DEC = "CAST(sum(CAST({} AS DECIMAL(18,6))) AS DECIMAL(38,6))"
#: A mean in decimals: neither the order of rows nor the engine decides its last digit.
MEAN = "CAST(round(CAST(CAST(sum(CAST({} AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS DECIMAL(20,12)), 6) AS DOUBLE)"
SIDES = """mtg AS (SELECT mmsi AS a, 1 + mmsi % 150 AS b, observed_at, sog AS hours FROM pos WHERE nav_status = 'view'),
sid AS (SELECT a AS mmsi, b AS other, observed_at, hours FROM mtg UNION ALL SELECT b, a, observed_at, hours FROM mtg),
prt AS (SELECT x.cutoff, x.entity, y.entity AS partner, observed_at, hours FROM sid JOIN atc x ON x.mmsi = sid.mmsi JOIN atc y ON y.cutoff = x.cutoff AND y.mmsi = other
  WHERE x.entity <> y.entity AND observed_at <= x.cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND)"""


def _meetings(spark, sf):
    p = positions(spark, sf).where("nav_status = 'view'")
    return p.select(F.col("mmsi").alias("a"), (1 + F.col("mmsi") % 150).alias("b"), "observed_at", F.col("sog").alias("hours"))


def _detections(p):
    """Loitering and draught changes of rows p, with what else p has."""
    more = [c for c in ("cutoff", "entity") if c in p.columns]
    loiter = p.where("nav_status = 'purchase'").select("mmsi", "observed_at", F.col("sog").alias("hours"), *more)
    draught = p.where("nav_status = 'click'").select("mmsi", "observed_at", (F.col("k") % 2 == 0).alias("moored_between"), (F.col("k") % 3 == 0).alias("met_between"), *more)
    return loiter, draught


FEATURES = f"""evt AS (SELECT mmsi, observed_at, event_id, CASE nav_status WHEN 'view' THEN 'gap' WHEN 'click' THEN 'encounter' WHEN 'purchase' THEN 'loitering' WHEN 'error' THEN 'port_visit' END AS type,
  sog AS hours, sog * 2 AS km, CAST(k AS DOUBLE) AS shore_km, k % 9 = 0 AS listed, flag = 'PA' AS interest FROM pos),
kev AS (SELECT cutoff, entity, evt.* FROM evt JOIN atc USING (mmsi) WHERE observed_at <= cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND),
wev AS (SELECT * FROM kev WHERE observed_at >= cutoff - {LOOKBACK}),
f_pop AS (SELECT DISTINCT cutoff, entity FROM knn),
isl AS (SELECT *, sum(new) OVER (PARTITION BY cutoff, entity ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER (PARTITION BY cutoff, entity ORDER BY observed_at, event_id) <= 43200000000 THEN 0 ELSE 1 END AS new FROM knn)),
f_ais AS (SELECT cutoff, entity, CAST(max(session) AS BIGINT) AS n_transits, count(DISTINCT day) AS n_days_observed, round(CAST(sum(CASE WHEN sog >= 3 THEN CAST(sog AS DECIMAL(18,6)) END) AS DOUBLE) / count(*) FILTER (WHERE sog >= 3), 6) AS mean_transit_speed_kn FROM isl GROUP BY 1, 2),
trn AS (SELECT cutoff, entity, session, CAST(min(observed_at) AS DATE) AS d0, CAST(max(observed_at) AS DATE) AS d1 FROM isl GROUP BY 1, 2, 3),
dly AS (SELECT cutoff, entity, day, max(sog) AS deep FROM knn WHERE nav_status = 'click' AND sog > 0 GROUP BY 1, 2, 3),
p75 AS (SELECT cutoff, entity, quantile_cont(deep, 0.75) AS p75 FROM dly GROUP BY 1, 2),
tdp AS (SELECT t.cutoff, t.entity, t.session, max(d.deep) AS deep FROM trn t LEFT JOIN dly d ON d.cutoff = t.cutoff AND d.entity = t.entity AND d.day BETWEEN d0 AND d1 GROUP BY 1, 2, 3),
f_lod AS (SELECT cutoff, entity, count(*) FILTER (WHERE deep > p75) AS n_laden_transits, count(*) FILTER (WHERE deep <= p75) AS n_ballast_transits FROM tdp LEFT JOIN p75 USING (cutoff, entity) GROUP BY 1, 2),
f_dst AS (SELECT cutoff, entity, round(avg(share), 6) AS share_destination_of_interest FROM (SELECT cutoff, entity, day, avg(CAST(k % 4 = 0 AS INTEGER)) AS share FROM knn GROUP BY 1, 2, 3) GROUP BY 1, 2),
f_evt AS (SELECT cutoff, entity, count(*) FILTER (WHERE type = 'gap') AS n_gaps, round(coalesce(sum(hours) FILTER (WHERE type = 'gap'), 0), 6) AS gap_hours_total, max(km) FILTER (WHERE type = 'gap') AS max_gap_distance_km,
  count(*) FILTER (WHERE type = 'gap' AND shore_km > 92.6) AS n_gaps_offshore, count(*) FILTER (WHERE type = 'encounter') AS n_encounters, count(DISTINCT event_id) FILTER (WHERE type = 'encounter' AND listed) AS n_encounters_with_listed_partner,
  count(*) FILTER (WHERE type = 'loitering') AS n_loitering, round(coalesce(sum(hours) FILTER (WHERE type = 'loitering'), 0), 6) AS loitering_hours, count(*) FILTER (WHERE type = 'port_visit') AS n_port_visits,
  count(*) FILTER (WHERE type = 'port_visit' AND interest) AS n_port_visits_of_interest FROM wev GROUP BY 1, 2),
f_prt AS (SELECT cutoff, entity, datediff('day', CAST(max(observed_at) AS DATE), cutoff) AS days_since_last_port_visit_of_interest FROM kev WHERE type = 'port_visit' AND interest GROUP BY 1, 2, cutoff),
kid AS (SELECT cutoff, entity, itv.*, (mmsi <> lag(mmsi) OVER w) AS cm, (flag <> lag(flag) OVER w) AS cf, (name <> lag(name) OVER w) AS cn FROM itv JOIN atc USING (mmsi) WHERE start_at <= cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND WINDOW w AS (PARTITION BY cutoff, entity ORDER BY start_at, mmsi)),
f_idn AS (SELECT cutoff, entity, greatest(count(DISTINCT name) - 1, 0) AS n_name_changes, count(*) FILTER (WHERE cm) AS n_mmsi_changes, count(*) FILTER (WHERE cf) AS n_flag_changes,
  CAST(coalesce(bool_or(cf AND flag IN ('PA', 'LR')), false) AS INTEGER) AS flag_to_convenience_registry, datediff('day', CAST(max(start_at) FILTER (WHERE cm OR cf OR cn) AS DATE), cutoff) AS days_since_last_identity_change,
  arg_max(coalesce(flag, '-'), (start_at, mmsi)) AS current_flag FROM kid GROUP BY 1, 2, cutoff),
chd AS (SELECT mmsi, number, day, min(observed_at) AS t FROM pos WHERE number IS NOT NULL GROUP BY 1, 2, 3),
che AS (SELECT mmsi, number, t FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, number ORDER BY day) AS n FROM chd) WHERE n = 5),
chc AS (SELECT * FROM (SELECT mmsi, t AS observed_at, lag(number) OVER (PARTITION BY mmsi ORDER BY t, number) AS old_value FROM che) WHERE old_value IS NOT NULL),
f_chn AS (SELECT cutoff, entity, count(DISTINCT mmsi) - 1 + (SELECT count(*) FROM chc JOIN atc b ON b.mmsi = chc.mmsi WHERE b.cutoff = atc.cutoff AND b.entity = atc.entity AND observed_at <= b.cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND) AS n_mmsi_number_churn FROM atc GROUP BY 1, 2),
f_spf AS (SELECT cutoff, entity, {MEAN.format('sog')} AS spoof_jump_rate_excess FROM knn GROUP BY 1, 2),
{SIDES},
f_mtg AS (SELECT cutoff, entity, count(*) AS n_sts_candidates FROM prt WHERE observed_at >= cutoff - {LOOKBACK} GROUP BY 1, 2),
f_loi AS (SELECT cutoff, entity, round(CAST({DEC.format('sog')} AS DOUBLE), 6) AS anchorage_loitering_hours FROM knn WHERE nav_status = 'purchase' GROUP BY 1, 2),
f_drf AS (SELECT cutoff, entity, count(*) FILTER (WHERE k % 3 = 0) AS n_sts_with_draught_change, count(*) FILTER (WHERE k % 2 <> 0 AND k % 3 <> 0) AS n_draught_inconsistencies FROM knn WHERE nav_status = 'click' GROUP BY 1, 2),
lgt AS (SELECT cutoff, entity, length, row_number() OVER (PARTITION BY cutoff, entity ORDER BY count(*) DESC, length) AS n FROM knn GROUP BY 1, 2, 3)"""
WIDE = """SELECT p.cutoff, p.entity, coalesce(n_transits, 0) AS n_transits, coalesce(n_days_observed, 0) AS n_days_observed, mean_transit_speed_kn, coalesce(n_laden_transits, 0) AS n_laden_transits, coalesce(n_ballast_transits, 0) AS n_ballast_transits,
  share_destination_of_interest, coalesce(n_gaps, 0) AS n_gaps, coalesce(gap_hours_total, 0) AS gap_hours_total, max_gap_distance_km, coalesce(n_gaps_offshore, 0) AS n_gaps_offshore, coalesce(n_encounters, 0) AS n_encounters,
  coalesce(n_encounters_with_listed_partner, 0) AS n_encounters_with_listed_partner, coalesce(n_loitering, 0) AS n_loitering, coalesce(loitering_hours, 0) AS loitering_hours, coalesce(n_port_visits, 0) AS n_port_visits,
  coalesce(n_port_visits_of_interest, 0) AS n_port_visits_of_interest, days_since_last_port_visit_of_interest, coalesce(n_name_changes, 0) AS n_name_changes, coalesce(n_mmsi_changes, 0) AS n_mmsi_changes, coalesce(n_flag_changes, 0) AS n_flag_changes,
  coalesce(flag_to_convenience_registry, 0) AS flag_to_convenience_registry, days_since_last_identity_change, current_flag, coalesce(n_mmsi_number_churn, 0) AS n_mmsi_number_churn, spoof_jump_rate_excess,
  coalesce(n_sts_candidates, 0) AS n_sts_candidates, coalesce(anchorage_loitering_hours, 0) AS anchorage_loitering_hours, coalesce(n_sts_with_draught_change, 0) AS n_sts_with_draught_change, coalesce(n_draught_inconsistencies, 0) AS n_draught_inconsistencies, l.length AS length_m,
  CAST(NULL AS DOUBLE) AS vessel_age_years, CAST(NULL AS DOUBLE) AS dwt
FROM f_pop p LEFT JOIN f_ais USING (cutoff, entity) LEFT JOIN f_lod USING (cutoff, entity) LEFT JOIN f_dst USING (cutoff, entity) LEFT JOIN f_evt USING (cutoff, entity) LEFT JOIN f_prt USING (cutoff, entity)
LEFT JOIN f_idn USING (cutoff, entity) LEFT JOIN f_chn USING (cutoff, entity) LEFT JOIN f_spf USING (cutoff, entity) LEFT JOIN f_mtg USING (cutoff, entity) LEFT JOIN f_loi USING (cutoff, entity) LEFT JOIN f_drf USING (cutoff, entity) LEFT JOIN lgt l ON l.cutoff = p.cutoff AND l.entity = p.entity AND l.n = 1"""


@query(f"WITH {POS}, {MAP}, {CUT}, {AT}, {WIN}, {INTERVALS}, {FEATURES} {WIDE}")
def features_wide(spark, sf):
    at = settled(_at(spark, sf))
    p = settled(X.known(positions(spark, sf), at, None))  # once; families then read their columns
    families = [
        X.ais(p, at, LOOKBACK),
        X.loads(p, p.where("nav_status = 'click'").withColumn("draught", F.col("sog")), at, LOOKBACK),
        X.destinations(p.withColumn("interest", (F.col("k") % 4 == 0).cast("int")), at, LOOKBACK),
        X.third_party(_third_party(p), at, LOOKBACK),
        X.identity(_intervals(spark, sf), at, ["PA", "LR"]).withColumn("current_flag", F.coalesce("current_flag", F.lit("-"))),
        X.churned(D.churn(positions(spark, sf), "number", min_days=5), at),
        X.spoof(p.withColumn("excess", F.col("sog")), at, LOOKBACK),
        X.meetings(_meetings(spark, sf), at, LOOKBACK),
        X.detections(*_detections(p), at, LOOKBACK),
        X.static(p, at, LOOKBACK),
    ]
    return X.assemble(X.population(p, at, LOOKBACK), families)


REPLAY = "lst AS (SELECT cutoff, id, min(date) AS since FROM (SELECT cutoff, a.*, max(CASE WHEN action = 'remove' THEN (date, source, action) END) OVER (PARTITION BY cutoff, id) AS gone FROM act a JOIN cut ON date <= cutoff) WHERE action = 'add' AND (gone IS NULL OR (date, source, action) > gone) GROUP BY 1, 2)"


@query(f"WITH {ACT}, {CUT}, {REPLAY} SELECT * FROM lst")
def listed_asof(spark, sf):
    return L.listed_as_of(actions(spark, sf), cutoffs(spark))


FIRST = f"fst AS (SELECT cutoff, id, date, source FROM (SELECT cutoff, a.*, row_number() OVER (PARTITION BY cutoff, id ORDER BY date, source) AS n FROM act a JOIN cut ON date > cutoff AND date <= cutoff + {HORIZON} WHERE action = 'add') WHERE n = 1)"


@query(f"WITH {ACT}, {CUT}, {FIRST} SELECT * FROM fst")
def first_add_window(spark, sf):
    return L.first_add_in_window(actions(spark, sf), cutoffs(spark), HORIZON)


PEOPLE = "ppl AS (SELECT DISTINCT cutoff, user_id AS id FROM events, cut WHERE CAST(ts AS DATE) <= cutoff)"
LABELS = "lab AS (SELECT p.cutoff, p.id, CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS label, f.source FROM ppl p LEFT JOIN fst f USING (cutoff, id) WHERE NOT EXISTS (SELECT 1 FROM lst l WHERE l.cutoff = p.cutoff AND l.id = p.id))"


def _people(spark, sf):
    return positions(spark, sf).select(F.col("mmsi").alias("id"), "day").join(F.broadcast(cutoffs(spark)), F.col("day") <= F.col("cutoff")).select("cutoff", "id").distinct()


@query(f"WITH {ACT}, {CUT}, {REPLAY}, {FIRST}, {PEOPLE}, {LABELS} SELECT cutoff, id, label FROM lab")
def labels(spark, sf):
    return L.labels(_people(spark, sf), actions(spark, sf), cutoffs(spark), HORIZON)


@query(f"""WITH {ACT}, {CUT}, {REPLAY}, {FIRST}, {PEOPLE}, {LABELS},
fa AS (SELECT DISTINCT cutoff, id FROM act JOIN cut ON date > cutoff AND date <= cutoff + {HORIZON} WHERE action = 'add' AND source = 'A')
SELECT cutoff, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_union, count(fa.id) AS n_sources, (SELECT count(*) FROM ppl JOIN lst USING (cutoff, id) WHERE ppl.cutoff = lab.cutoff) AS n_listed
FROM lab LEFT JOIN fa USING (cutoff, id) GROUP BY cutoff""")
def positives_table(spark, sf):
    return L.positives(_people(spark, sf), actions(spark, sf), cutoffs(spark), HORIZON, ["A"])


SCORES = """sco AS (SELECT cutoff, user_id AS id, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS score, CAST(max(CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS label FROM events, cut WHERE CAST(ts AS DATE) <= cutoff GROUP BY 1, 2)"""


def _scores(spark, sf):
    p = positions(spark, sf).join(F.broadcast(cutoffs(spark)), F.col("day") <= F.col("cutoff"))
    g = p.groupBy("cutoff", F.col("mmsi").alias("id")).agg(F.count(F.when(F.col("nav_status") == "error", 1)).cast("double").alias("score"))
    return g.withColumn("label", (F.col("id") % 6 == 0).cast("int"))


RANKED = "rnk AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY score DESC, id) AS rank FROM sco)"
METRICS = f"""{RANKED}, hit AS (SELECT *, sum(label) OVER (PARTITION BY cutoff ORDER BY rank) AS hits, sum(label) OVER (PARTITION BY cutoff) AS pos FROM rnk),
met AS (SELECT cutoff, count(*) AS n, CAST(max(pos) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN rank <= 20 THEN label ELSE 0 END) AS BIGINT) AS tp, min(CASE WHEN hits * 2 >= pos AND pos > 0 THEN rank END) AS alerts_half FROM hit GROUP BY cutoff),
prk AS (SELECT cutoff, n, n_pos, CASE WHEN n_pos > 0 THEN round(tp / least(20, n)::DOUBLE, 6) END AS precision, CASE WHEN n_pos > 0 THEN round(tp / n_pos::DOUBLE, 6) END AS recall,
  CASE WHEN n > n_pos THEN round((least(20, n) - tp) / (n - n_pos)::DOUBLE, 6) END AS fpr, alerts_half FROM met)"""


@query(f"WITH {CUT}, {SCORES}, {METRICS} SELECT * FROM prk")
def precision_at_k(spark, sf):
    return M.at_k(_scores(spark, sf), 20)


@query(f"""WITH {CUT}, {SCORES}, g AS (SELECT cutoff, score, sum(label) AS p, count(*) AS c FROM sco GROUP BY 1, 2),
w AS (SELECT *, sum(p) OVER (PARTITION BY cutoff ORDER BY score DESC) AS tp, sum(c) OVER (PARTITION BY cutoff ORDER BY score DESC) AS n, sum(p) OVER (PARTITION BY cutoff) AS pos FROM g)
SELECT cutoff, round(sum(p / pos::DOUBLE * tp / n), 6) AS average_precision FROM w GROUP BY cutoff""")
def average_precision(spark, sf):
    return M.average_precision(_scores(spark, sf))


@query(f"WITH {CUT}, {SCORES} SELECT cutoff, round(avg(pow(score / 100 - label, 2)), 6) AS brier FROM sco GROUP BY cutoff")
def brier(spark, sf):
    return M.brier(_scores(spark, sf).withColumn("score", F.col("score") / 100))


@query(f"""WITH {CUT}, {SCORES}, x AS (SELECT *, min(cutoff) OVER (PARTITION BY id) AS first FROM sco),
s AS (SELECT *, 'all' AS stratum FROM x UNION ALL SELECT *, 'first_seen' FROM x WHERE cutoff = first)
SELECT stratum, cutoff, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM s GROUP BY 1, 2""")
def first_seen_stratum(spark, sf):
    return M.strata(_scores(spark, sf)).groupBy("stratum", "cutoff").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query(f"WITH {CUT}, {SCORES}, {METRICS} SELECT 'b' AS model, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, count(*) AS n_cutoffs FROM prk")
def macro_average(spark, sf):
    return M.macro_average(M.at_k(_scores(spark, sf), 20).withColumn("model", F.lit("b")), ["model"], ["precision", "recall"])


@query(f"""WITH {ACT}, {CUT}, {SCORES}, {RANKED}, a AS (SELECT id, min(date) AS date FROM act WHERE action = 'add' GROUP BY id)
SELECT a.id, a.date, min(cutoff) AS cutoff, round(datediff('day', min(cutoff), a.date) / 7.0::DOUBLE, 6) AS weeks FROM a JOIN rnk ON rnk.id = a.id AND rank <= 100 AND cutoff < a.date AND a.date <= cutoff + 14 GROUP BY a.id, a.date""")
def lead_time(spark, sf):
    return L.lead_times(_scores(spark, sf), actions(spark, sf), 100, 14)


@query(f"WITH {CUT}, {SCORES}, {RANKED} SELECT cutoff, id, score, label, rank FROM rnk WHERE rank <= 25")
def watchlist(spark, sf):
    return M.watchlist(_scores(spark, sf), 25).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {CUT}, {SCORES}, {RANKED}, l AS (SELECT cutoff, CASE WHEN id % 50 = 0 THEN rank + 1 ELSE rank END AS rank, id, score FROM rnk WHERE rank <= 60),
s AS (SELECT *, row_number() OVER w AS n, lag(score) OVER w AS was FROM l WINDOW w AS (PARTITION BY cutoff ORDER BY rank, id))
SELECT cutoff, rank, id, score, CASE WHEN rank <> n THEN 'rank' ELSE 'score' END AS broken FROM s WHERE rank <> n OR score > was""")
def contract_violations(spark, sf):
    lists = M.watchlist(_scores(spark, sf), 60).select("cutoff", F.when(F.col("id") % 50 == 0, F.col("rank") + 1).otherwise(F.col("rank")).cast("long").alias("rank"), "id", "score")
    return M.list_violations(lists)



@query(f"""WITH {POS}, {MAP}, {CUT}, {AT}, {WIN}, {INTERVALS}, {FEATURES}, wid AS ({WIDE}), t AS (
SELECT cutoff, entity, CAST(n_port_visits_of_interest > 0 OR coalesce(share_destination_of_interest, 0) > 0 AS INTEGER) AS a, CAST(gap_hours_total > 24 AS INTEGER) AS b, CAST(n_encounters_with_listed_partner > 0 AS INTEGER) AS c,
  CAST(flag_to_convenience_registry > 0 AS INTEGER) AS d, CAST(n_name_changes >= 1 AS INTEGER) AS e FROM wid)
SELECT cutoff, entity, CAST(a AS DOUBLE) AS b1, CAST(3 * a + 2 * b + 2 * c + d + e AS DOUBLE) AS b2 FROM t""")
def b1_b2_score(spark, sf):
    names = {"visits": "n_port_visits_of_interest", "share": "share_destination_of_interest", "gap_hours": "gap_hours_total", "partners": "n_encounters_with_listed_partner", "convenience": "flag_to_convenience_registry", "age": "vessel_age_years", "names": "n_name_changes"}
    f = features_wide(spark, sf).select("cutoff", "entity", *[F.col(v).alias(k) for k, v in names.items()], F.lit(None).cast("double").alias("excess"))
    return M.rule_scores(f).select("cutoff", "entity", "b1", "b2")


@query(f"""WITH {POS}, s AS (SELECT CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS side, 'sog' AS feature, sog AS value FROM pos UNION ALL SELECT CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END, 'k', CAST(k AS DOUBLE) FROM pos),
e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM s WHERE side = 0 GROUP BY feature),
b AS (SELECT s.feature, side, len(list_filter(edges, lambda x: x <= value)) AS bin FROM s JOIN e USING (feature)),
n AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM b GROUP BY 1, 2),
p AS (SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature)::DOUBLE, 1e-6::DOUBLE) AS pa, greatest(b / sum(b) OVER (PARTITION BY feature)::DOUBLE, 1e-6::DOUBLE) AS pb FROM n)
SELECT feature, round(sum((pb - pa) * ln(pb / pa)), 4) AS psi FROM p GROUP BY feature""")
def psi(spark, sf):
    side = (F.col("day") >= F.lit("2024-01-16").cast("date")).cast("int")
    return M.psi(positions(spark, sf).select(side.alias("side"), "sog", F.col("k").cast("double").alias("k")), "side", ["sog", "k"])


@query("""WITH p AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE a = b) AS same FROM p),
e AS (SELECT sum(ra * rb::DOUBLE) AS e FROM (SELECT a, count(*) AS ra FROM p GROUP BY a) x JOIN (SELECT b, count(*) AS rb FROM p GROUP BY b) y ON a = b)
SELECT total, round(same / total::DOUBLE, 6) AS agreement, round((same / total::DOUBLE - e / (total::DOUBLE * total)) / (1 - e / (total::DOUBLE * total)), 6) AS kappa FROM n, e""")
def kappa(spark, sf):
    return M.kappa(spark.read.parquet(f"{sf}/labels.parquet").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


@query(f"""WITH {POS} SELECT entity, family, event_id, rank FROM (SELECT mmsi AS entity, nav_status AS family, event_id, row_number() OVER (PARTITION BY mmsi, nav_status ORDER BY sog DESC, observed_at DESC, event_id) AS rank FROM pos) WHERE rank <= 6""")
def evidence_topk(spark, sf):
    p = positions(spark, sf).select(F.col("mmsi").alias("entity"), F.col("nav_status").alias("family"), "observed_at", F.col("sog").alias("weight"), F.col("event_id").alias("tie"))
    return E.evidence_top(p).select("entity", "family", F.col("tie").alias("event_id"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {POS}, t AS (SELECT * FROM (SELECT mmsi AS entity, nav_status AS family, event_id, CAST(k AS BIGINT) AS size, row_number() OVER (PARTITION BY mmsi, nav_status ORDER BY sog DESC, observed_at DESC, event_id) AS rank FROM pos) WHERE rank <= 6),
s AS (SELECT *, sum(size) OVER w AS total, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY entity ORDER BY rank, family ROWS UNBOUNDED PRECEDING))
SELECT entity, event_id, 'E' || n AS evidence_id, CAST(total AS BIGINT) AS total FROM s WHERE total <= 600""")
def evidence_bundle(spark, sf):
    p = positions(spark, sf).select(F.col("mmsi").alias("entity"), F.col("nav_status").alias("family"), "observed_at", F.col("sog").alias("weight"), F.col("event_id").alias("tie"), F.col("k").cast("long").alias("size"))
    return E.bundles(E.evidence_top(p), 600).select("entity", F.col("tie").alias("event_id"), "evidence_id", "total")


@query(f"""WITH {POS} SELECT mmsi, time_bucket(INTERVAL 10 MINUTE, observed_at) AS slot, min(event_id) FILTER (WHERE n = 1) AS event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi, time_bucket(INTERVAL 10 MINUTE, observed_at) ORDER BY observed_at, event_id) AS n FROM pos) GROUP BY 1, 2""")
def track_bucket(spark, sf):
    return E.first_fixes(positions(spark, sf)).select("mmsi", "slot", "event_id")


@query()
def track_thinned(spark, sf):
    """Greedy, so without SQL; tests hold it against a plain loop."""
    return E.thin(positions(spark, sf).select("mmsi", "observed_at", "event_id", "lat", "lon"), spacing_s=6 * 3600.0)


@query(f"""WITH {POS}, i AS (SELECT DISTINCT mmsi, TIMESTAMP '2024-01-12 12:00:00' AS t FROM pos),
b AS (SELECT i.mmsi, t, p.lat AS la, p.lon AS lo, epoch_us(p.observed_at) AS u, row_number() OVER (PARTITION BY i.mmsi ORDER BY p.observed_at DESC, event_id DESC) AS n FROM i JOIN pos p ON p.mmsi = i.mmsi AND p.observed_at <= t),
a AS (SELECT i.mmsi, p.lat AS la, p.lon AS lo, epoch_us(p.observed_at) AS u, row_number() OVER (PARTITION BY i.mmsi ORDER BY p.observed_at, event_id) AS n FROM i JOIN pos p ON p.mmsi = i.mmsi AND p.observed_at > t)
SELECT i.mmsi, i.t AS instant, round(b.la + (epoch_us(i.t) - b.u) / (a.u - b.u)::DOUBLE * (a.la - b.la), 6) AS lat, round(b.lo + (epoch_us(i.t) - b.u) / (a.u - b.u)::DOUBLE * (a.lo - b.lo), 6) AS lon
FROM i LEFT JOIN b ON i.mmsi = b.mmsi AND b.n = 1 LEFT JOIN a ON i.mmsi = a.mmsi AND a.n = 1""")
def position_at(spark, sf):
    p = positions(spark, sf)
    instants = p.select("mmsi").distinct().withColumn("at", F.lit("2024-01-12 12:00:00").cast("timestamp_ntz"))
    return E.position_at(p, instants).withColumnRenamed("at", "instant")


@query("""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS found FROM documents)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_numbers FROM n WHERE len(found) > 0""")
def text_numbers(spark, sf):
    found = F.array_distinct(numbers_in("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(found).cast("long").alias("n_numbers")).where("n_numbers > 0")


@query("""SELECT o_custkey, list_sort(list(o_totalprice))[CAST(count(*) // 2 + 1 AS INTEGER)] AS upper_median FROM orders GROUP BY o_custkey""")
def upper_median_price(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(upper_median(F.collect_list("o_totalprice")).alias("upper_median"))


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01')
SELECT o_custkey, d, o_orderkey FROM o WHERE n = 1""")
def first_order_after(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderdate > timestamp_ntz'1996-01-01'")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey")


@query()
def isolation_scores(spark, sf):
    """Trees are random, so without SQL; tests hold it against planted outliers."""
    from ..operators.models import isolation_forest

    f = features_wide(spark, sf).withColumnRenamed("entity", "id")
    return isolation_forest(f, ["n_gaps", "gap_hours_total", "n_port_visits", "n_transits"], trees=50).withColumn("score", F.round("score", 6))


@query()
def logistic_scores(spark, sf):
    """Fitted, so without SQL; tests hold it against a planted signal."""
    from ..operators.models import logistic

    f = features_wide(spark, sf).withColumnRenamed("entity", "id").withColumn("label", (F.col("n_gaps") >= 4).cast("int"))
    last = F.lit("2024-01-20").cast("date")
    out = logistic(f.where(F.col("cutoff") < last), f.where(F.col("cutoff") == last), ["n_gaps", "gap_hours_total", "n_port_visits"])
    return out.select("cutoff", "id", F.round("score", 6).alias("score"))
