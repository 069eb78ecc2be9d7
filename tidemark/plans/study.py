"""Queries of evaluation studies, labels, identities, records and listings."""

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import features as X
from ..operators import records as P
from ..operators import score as M
from ..operators import study as Y
from ..sources import listing as G
from .adapter import ACT, CUT, HORIZON, LOOKBACK, POS, actions, cutoffs, positions
from .domain import AT, DEC, INTERVALS, MAP, MEAN, METRICS, RANKED, SCORES, SIDES, WIN, _at, _detections, _entities, _intervals, _meetings, _scores
from .series import HAV

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {POS}, m AS (SELECT mmsi, date_trunc('minute', observed_at) AS minute, avg(lat) AS lat, avg(lon) AS lon FROM pos WHERE sog < 300 GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT a.mmsi AS a, b.mmsi AS b, a.minute, 1000 * {HAV.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} AS d FROM m a JOIN m b ON a.minute = b.minute AND a.mmsi < b.mmsi) WHERE d < 3000),
n AS (SELECT *, CASE WHEN epoch_us(minute) - lag(epoch_us(minute)) OVER (PARTITION BY a, b ORDER BY minute) <= 600000000 THEN 0 ELSE 1 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY a, b ORDER BY minute ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT a, b, min(minute) AS start_at, max(minute) AS end_at, count(*) AS minutes, round(min(d), 2) AS min_distance_m FROM s GROUP BY a, b, session
HAVING count(*) >= 0.5 * ((epoch_us(max(minute)) - epoch_us(min(minute))) / 6e7 + 1)""")
def transfers(spark, sf):
    out = D.transfers(positions(spark, sf), metres=3000.0, max_kn=300.0, min_hours=0.0)
    return out.select("a", "b", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "minutes", F.round("min_distance_m", 2).alias("min_distance_m"))


@query(f"WITH {POS}, {MAP}, {CUT}, {AT}, {SIDES} SELECT cutoff, entity, count(*) AS n_sts_candidates FROM prt WHERE observed_at >= cutoff - {LOOKBACK} GROUP BY 1, 2")
def features_meetings(spark, sf):
    return X.meetings(_meetings(spark, sf), _at(spark, sf), LOOKBACK)


@query(f"WITH {POS}, {MAP}, {CUT}, {AT}, {SIDES} SELECT cutoff, entity, partner, count(*) AS n, max(hours) AS longest FROM prt GROUP BY 1, 2, 3")
def partners(spark, sf):
    out = P.partners(_meetings(spark, sf), _at(spark, sf))
    return out.groupBy("cutoff", "entity", "partner").agg(F.count("*").alias("n"), F.max("hours").alias("longest"))


@query(f"""WITH {POS}, {MAP}, {CUT}, {AT}, {WIN},
a AS (SELECT cutoff, entity, round(CAST({DEC.format('sog')} AS DOUBLE), 6) AS anchorage_loitering_hours FROM knn WHERE nav_status = 'purchase' GROUP BY 1, 2),
d AS (SELECT cutoff, entity, count(*) FILTER (WHERE k % 3 = 0) AS n_sts_with_draught_change, count(*) FILTER (WHERE k % 2 <> 0 AND k % 3 <> 0) AS n_draught_inconsistencies FROM knn WHERE nav_status = 'click' GROUP BY 1, 2)
SELECT cutoff, entity, anchorage_loitering_hours, n_sts_with_draught_change, n_draught_inconsistencies FROM a FULL JOIN d USING (cutoff, entity)""")
def features_detections(spark, sf):
    return X.detections(*_detections(positions(spark, sf)), _at(spark, sf), LOOKBACK)


@query(f"WITH {POS}, {MAP}, {CUT}, {AT}, {WIN} SELECT cutoff, entity, {MEAN.format('sog')} AS spoof_jump_rate_excess FROM knn GROUP BY 1, 2")
def features_spoof(spark, sf):
    return X.spoof(positions(spark, sf).select("mmsi", "observed_at", F.col("sog").alias("excess")), _at(spark, sf), LOOKBACK)


@query(f"""WITH {CUT}, {SCORES}, {METRICS}, g AS (SELECT cutoff, score, sum(label) AS p, count(*) AS c FROM sco GROUP BY 1, 2),
w AS (SELECT *, sum(p) OVER (PARTITION BY cutoff ORDER BY score DESC) AS tp, sum(c) OVER (PARTITION BY cutoff ORDER BY score DESC) AS n, sum(p) OVER (PARTITION BY cutoff) AS pos FROM g),
a AS (SELECT cutoff, round(sum(p / pos::DOUBLE * tp / n), 6) AS average_precision FROM w GROUP BY cutoff),
t AS (SELECT cutoff, sum(CASE WHEN rank <= 10 THEN label ELSE 0 END) AS t10, sum(CASE WHEN rank <= 25 THEN label ELSE 0 END) AS t25 FROM rnk GROUP BY cutoff)
SELECT cutoff, n, n_pos, round(n_pos / n::DOUBLE, 6) AS base_rate, alerts_half, round(t10 / least(10, n)::DOUBLE, 6) AS precision_10, round(t10 / n_pos::DOUBLE, 6) AS recall_10,
round(t25 / least(25, n)::DOUBLE, 6) AS precision_25, round(t25 / n_pos::DOUBLE, 6) AS recall_25, average_precision FROM prk JOIN t USING (cutoff) JOIN a USING (cutoff)""")
def metric_summary(spark, sf):
    return Y.summary(_scores(spark, sf), (10, 25))


@query(f"WITH {CUT}, {SCORES}, {METRICS} SELECT 'b' AS model, round(avg(precision), 4) AS precision, count(*) AS n_cutoffs FROM prk WHERE cutoff <> DATE '2024-01-10'")
def matched_cutoffs(spark, sf):
    m = M.at_k(_scores(spark, sf), 20).withColumns({"model": F.lit("b"), "label_set": F.lit("union")})
    skipped = m.where("cutoff = '2024-01-10'").select("cutoff", "label_set")
    return M.macro_average(Y.matched(m, skipped), ["model"], ["precision"])


@query(f"WITH {CUT}, {SCORES}, {METRICS} SELECT CASE WHEN cutoff >= DATE '2024-01-15' THEN 'post_break' ELSE 'pre_break' END AS side, 'b' AS model, round(avg(precision), 4) AS precision, count(*) AS n_cutoffs FROM prk GROUP BY 1")
def regime_split(spark, sf):
    return Y.by_regime(M.at_k(_scores(spark, sf), 20).withColumn("model", F.lit("b")), "2024-01-15", ["model"], ["precision"])


FAMILIES = (("n_gaps", "events", "third"), ("gap_hours_total", "events", "third"), ("n_transits", "ais", "own"), ("n_name_changes", "identity", "own"), ("n_sts_candidates", "meetings", "own"))


@query("WITH f(feature, family, origin) AS (VALUES " + ", ".join(str(x) for x in FAMILIES) + """)
SELECT 'full' AS arm, feature FROM f UNION ALL SELECT 'drop_' || k.family, feature FROM f JOIN (SELECT DISTINCT family FROM f) k ON f.family <> k.family UNION ALL SELECT origin || '_only', feature FROM f""")
def ablation_arms(spark, sf):
    return Y.ablation_arms(spark.createDataFrame(FAMILIES, "feature string, family string, origin string"))


@query(f"""WITH {POS}, s AS (SELECT CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS side, 'sog' AS feature, sog AS value FROM pos UNION ALL SELECT CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END, 'k', CAST(k AS DOUBLE) FROM pos),
e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM s WHERE side = 0 GROUP BY feature),
b AS (SELECT s.feature, side, len(list_filter(edges, lambda x: x <= value)) AS bin FROM s JOIN e USING (feature)),
n AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM b GROUP BY 1, 2),
p AS (SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature)::DOUBLE, 1e-6::DOUBLE) AS pa, greatest(b / sum(b) OVER (PARTITION BY feature)::DOUBLE, 1e-6::DOUBLE) AS pb FROM n),
f AS (SELECT feature, round(sum((pb - pa) * ln(pb / pa)), 4) AS psi FROM p GROUP BY feature)
SELECT 'motion' AS family, CAST(round(sum(CAST(psi AS DECIMAL(20,10))) / 2, 4) AS DOUBLE) AS psi FROM f""")
def family_psi(spark, sf):
    side = (F.col("day") >= F.lit("2024-01-16").cast("date")).cast("int")
    rows = positions(spark, sf).select(side.alias("side"), "sog", F.col("k").cast("double").alias("k"))
    return Y.family_psi(rows, "side", {"sog": "motion", "k": "motion"})


@query(f"WITH {POS}, {MAP} SELECT method, count(*) AS n, NOT contains(lower(method), 'gfw') AS passes FROM ent GROUP BY 1")
def resolution_delta(spark, sf):
    return Y.resolution_delta(_entities(spark, sf))


@query(f"WITH {POS}, {MAP}, {CUT}, {SCORES}, {METRICS} SELECT cutoff, precision FROM prk WHERE NOT EXISTS (SELECT 1 FROM ent WHERE contains(lower(method), 'gfw'))")
def gated_metrics(spark, sf):
    return Y.gated(M.at_k(_scores(spark, sf), 20), Y.resolution_delta(_entities(spark, sf))).select("cutoff", "precision")


@query(f"WITH {ACT}, {CUT} SELECT id, min(date) AS date FROM act WHERE action = 'add' AND date > (SELECT min(cutoff) FROM cut) AND date <= (SELECT max(cutoff) FROM cut) + {HORIZON} GROUP BY id")
def designations_in_span(spark, sf):
    return Y.designations_in_span(actions(spark, sf), cutoffs(spark), HORIZON)


TERMS = """trm AS (SELECT cutoff, user_id AS id, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS errors, CAST(2 * count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS views, CAST(-count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS clicks,
  CAST(max(CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS label FROM events, cut WHERE CAST(ts AS DATE) <= cutoff GROUP BY 1, 2),
sct AS (SELECT *, errors + views + clicks AS score FROM trm), rkt AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY score DESC, id) AS rank FROM sct)"""


def _terms(spark, sf):
    p = positions(spark, sf).join(F.broadcast(cutoffs(spark)), F.col("day") <= F.col("cutoff"))
    n = lambda t: F.count(F.when(F.col("nav_status") == t, 1)).cast("double")
    g = p.groupBy("cutoff", F.col("mmsi").alias("id")).agg(n("error").alias("errors"), (n("view") * 2).alias("views"), (-n("click")).alias("clicks"))
    return g.withColumns({"label": (F.col("id") % 6 == 0).cast("int"), "score": F.col("errors") + F.col("views") + F.col("clicks")})


@query(f"""WITH {CUT}, {TERMS}, t AS (SELECT cutoff, rank, id, label, unnest([{{'f': 'errors', 'v': errors}}, {{'f': 'views', 'v': views}}, {{'f': 'clicks', 'v': clicks}}]) AS x FROM rkt WHERE rank <= 100),
n AS (SELECT *, row_number() OVER (PARTITION BY cutoff, id ORDER BY abs(x.v) DESC, x.f) AS n FROM t WHERE x.v <> 0)
SELECT r.cutoff, r.rank, r.id, r.score, r.label, coalesce(string_agg(n.x.f || '=' || printf('%.3f', n.x.v), ';' ORDER BY n.n) FILTER (WHERE n.n <= 2), '') AS drivers FROM rkt r LEFT JOIN n ON n.cutoff = r.cutoff AND n.id = r.id WHERE r.rank <= 100 GROUP BY ALL""")
def flagged_list(spark, sf):
    out = Y.flagged(_terms(spark, sf), ["errors", "views", "clicks"], 100, 2)
    return out.select("cutoff", F.col("rank").cast("long").alias("rank"), "id", "score", "label", F.array_join("drivers", ";").alias("drivers"))


@query(f"""WITH {CUT}, {SCORES}, {RANKED}, q AS (SELECT *, strftime(cutoff, '%Y') || '-Q' || quarter(cutoff) AS quarter FROM rnk WHERE label = 0),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quarter, id ORDER BY rank, cutoff) AS n FROM q) WHERE n = 1)
SELECT quarter, cutoff, rank, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY rank, cutoff, id) AS place FROM o) WHERE place <= 20""")
def review_sheet(spark, sf):
    return Y.review_sheet(_scores(spark, sf)).select("quarter", "cutoff", F.col("rank").cast("long").alias("rank"), "id", "score", F.col("place").cast("long").alias("place"))


@query(f"""WITH {CUT}, {SCORES}, {RANKED}, l AS (SELECT * FROM rnk WHERE rank <= 50),
g AS (SELECT cutoff, sha256(string_agg(rank || ',' || id || ',' || printf('%.6f', score), chr(10) ORDER BY rank)) AS sha256, count(DISTINCT round(score, 6)) AS kinds FROM l GROUP BY cutoff)
SELECT cutoff, rank, id, score, sha256 FROM l JOIN g USING (cutoff) WHERE kinds > 1""")
def forward_list(spark, sf):
    return Y.forward_list(_scores(spark, sf)).select("cutoff", F.col("rank").cast("long").alias("rank"), "id", "score", "sha256")


@query(f"""WITH {CUT}, {SCORES}, {RANKED}, {ACT}, l AS (SELECT cutoff, id FROM rnk WHERE rank <= 50),
h AS (SELECT cutoff, l.id, datediff('day', cutoff, min(date)) AS days FROM l LEFT JOIN act ON act.id = l.id AND action = 'add' AND date <= DATE '2024-01-25' AND date > cutoff AND date <= cutoff + {HORIZON} GROUP BY 1, 2)
SELECT cutoff, count(*) AS listed, count(days) AS designated, quantile_cont(days, 0.5) AS median_lead_days FROM h GROUP BY 1""")
def forward_evaluation(spark, sf):
    return Y.evaluate_forward(Y.forward_list(_scores(spark, sf)), actions(spark, sf), "2024-01-25", HORIZON)


@query()
def permutation_leakage(spark, sf):
    """Fitted, so without SQL; tests hold it against labels that leak and labels that don't."""
    from ..operators.models import logistic

    rows, last = _terms(spark, sf).drop("score"), F.lit("2024-01-20").cast("date")
    fit = lambda a, b: logistic(a, b, ["errors", "views", "clicks"])
    return Y.permutation_check(rows.where(F.col("cutoff") < last), rows.where(F.col("cutoff") == last), fit)


def _sources(spark, sf):
    a = actions(spark, sf).withColumn("number", F.when(F.col("id") % 11 != 0, F.col("id"))).drop("id")
    one = lambda s: a.where(F.col("source") == s)
    late = one("C").select("source", "date", "number", F.when(F.col("action") == "add", "add").alias("action"), F.lit("p").alias("program"))
    return P.action_table(one("A"), one("B"), late)


@query(f"""WITH {ACT}, t AS (SELECT source, CASE WHEN source = 'C' AND action <> 'add' THEN NULL ELSE action END AS action, date, CASE WHEN id % 11 <> 0 THEN id END AS number FROM act)
SELECT source, action, count(*) AS n, count(DISTINCT number) AS n_numbers, min(date) AS first, max(date) AS last FROM t WHERE action IS NOT NULL AND number IS NOT NULL GROUP BY 1, 2""")
def action_table(spark, sf):
    return P.action_summary(_sources(spark, sf))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 1 END AS listed, 'c' || o_custkey % 7 AS reference FROM orders),
p AS (SELECT 'C' || i AS reference, DATE '2020-01-01' + CAST(i AS INTEGER) AS published FROM range(5) t(i))
SELECT id, coalesce(date, listed, published) AS day, CASE WHEN date IS NOT NULL THEN 'start' WHEN listed IS NOT NULL THEN 'listing' WHEN published IS NOT NULL THEN 'reference:' || upper(r.reference) END AS via
FROM r LEFT JOIN p ON upper(r.reference) = p.reference""")
def dated_rows(spark, sf):
    o, d = spark.read.parquet(f"{sf}/orders.parquet"), F.to_date("o_orderdate")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, d).alias("date"), F.when(F.col("o_orderkey") % 4 == 0, F.date_add(d, 1)).alias("listed"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("reference"))
    refs = spark.range(5).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("reference"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("published"))
    return P.dated(rows, refs).select("id", F.col("on").alias("day"), "via")


VALID = "((n // 1000000 % 10) * 7 + (n // 100000 % 10) * 6 + (n // 10000 % 10) * 5 + (n // 1000 % 10) * 4 + (n // 100 % 10) * 3 + (n // 10 % 10) * 2) % 10 = n % 10"


@query(f"""WITH {POS}, {CUT}, s AS (SELECT DISTINCT cutoff, mmsi FROM pos JOIN cut ON day <= cutoff AND day >= cutoff - {LOOKBACK}),
c AS (SELECT cutoff, mmsi, number AS n, count(*) AS c FROM pos JOIN cut ON observed_at <= cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND WHERE number > 0 GROUP BY 1, 2, 3),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cutoff, mmsi ORDER BY c DESC, n) AS r FROM c) WHERE r = 1)
SELECT DISTINCT cutoff, n AS number FROM s JOIN m USING (cutoff, mmsi) WHERE n BETWEEN 1000000 AND 9999999 AND {VALID}""")
def modal_population(spark, sf):
    p = positions(spark, sf)
    return P.modal_population(p.select("mmsi", "day"), p.select("mmsi", "observed_at", "number"), cutoffs(spark), LOOKBACK)


@query("""WITH c AS (SELECT c_custkey, 200000000 + c_custkey * 7919 % 900000000 AS mmsi FROM customer), p AS (SELECT 200 + n_nationkey * 20 AS prefix, n_name AS country FROM nation)
SELECT c_custkey, mmsi, CASE WHEN CAST(mmsi AS VARCHAR)[1] BETWEEN '2' AND '7' AND length(CAST(mmsi AS VARCHAR)) = 9 THEN country END AS flag FROM c LEFT JOIN p ON CAST(substr(CAST(mmsi AS VARCHAR), 1, 3) AS INTEGER) = prefix""")
def flag_by_prefix(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select((200 + F.col("n_nationkey") * 20).cast("int").alias("prefix"), F.col("n_name").alias("country"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.lit(200000000) + F.col("c_custkey").cast("long") * 7919 % 900000000).alias("mmsi"))
    return P.flag_by_prefix(c, P.prefix_table(n, {}))


@query(f"""WITH {POS}, {MAP}, p AS (SELECT DISTINCT number, mmsi FROM pos WHERE number IS NOT NULL),
r AS (SELECT p.number, p.mmsi, count(e.mmsi) AS n, coalesce(bool_or(TRY_CAST(entity AS BIGINT) = p.number), false) AS ok FROM p LEFT JOIN ent e ON e.mmsi = p.mmsi AND method = 'vote' GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE n > 0) AS pairs, count(*) FILTER (WHERE ok) AS agree, count(*) FILTER (WHERE n > 0 AND NOT ok) AS disagree, round(count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE n > 0)::DOUBLE, 4) AS precision FROM r""")
def silver_agreement(spark, sf):
    return P.silver_agreement(positions(spark, sf).select("number", "mmsi"), _entities(spark, sf))


@query(f"""WITH {POS}, {ACT}, d AS (SELECT mmsi, length, CASE k % 4 WHEN 0 THEN 'Undefined' WHEN 1 THEN NULL WHEN 2 THEN 'other' ELSE 'Tanker' END AS ship_type, mmsi % 3 = 0 AS carrier_today, mmsi // 2 AS number FROM pos),
o AS (SELECT mmsi, min(number) AS number FROM d WHERE length >= 100 AND (ship_type IS NULL OR lower(ship_type) IN ('undefined', 'unknown', 'other')) GROUP BY mmsi HAVING NOT bool_or(carrier_today))
SELECT count(*) AS n_transmitters, count(DISTINCT a.id) AS n_later_added FROM o LEFT JOIN (SELECT DISTINCT id FROM act WHERE action = 'add') a ON a.id = o.number""")
def population_crosscheck(spark, sf):
    k = F.col("k") % 4
    days = positions(spark, sf).select("mmsi", "length", F.when(k == 0, "Undefined").when(k == 2, "other").when(k == 3, "Tanker").alias("ship_type"), (F.col("mmsi") % 3 == 0).alias("carrier_today"), F.floor(F.col("mmsi") / 2).alias("number"))
    return P.population_crosscheck(days, actions(spark, sf).withColumnRenamed("id", "number"))


@query("""SELECT s_suppkey AS id, s_name AS name, TRY_CAST(nullif(regexp_extract(x, '(?i)\\bIMO\\s*([0-9]{7})\\b', 1), '') AS BIGINT) AS number FROM
(SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Vessel; IMO ' || (9000000 + s_suppkey) || ' flag' WHEN s_suppkey % 3 = 1 THEN 'imo' || (8000000 + s_suppkey) ELSE NULL END AS x, s_suppkey % 2 AS kind FROM supplier) WHERE kind = 0""")
def vessels_of(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    remarks = F.when(k % 3 == 0, F.concat(F.lit("Vessel; IMO "), (k + 9000000).cast("string"), F.lit(" flag"))).when(k % 3 == 1, F.concat(F.lit("imo"), (k + 8000000).cast("string")))
    return P.vessels_of(s.select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, " Vessel ").otherwise("entity").alias("kind"), remarks.alias("remarks")))


@query(f"""WITH {POS}, {MAP}, {CUT}, {AT}, {INTERVALS}, j AS (SELECT cutoff, entity, itv.* FROM itv JOIN atc USING (mmsi) WHERE start_at <= cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND)
SELECT cutoff, entity, arg_max(name, (start_at, mmsi)) FILTER (WHERE name IS NOT NULL) AS name, arg_max(flag, (start_at, mmsi)) FILTER (WHERE flag IS NOT NULL) AS flag FROM j GROUP BY 1, 2""")
def names_in_force(spark, sf):
    return P.names_in_force(_intervals(spark, sf), _at(spark, sf))


@query(f"""WITH {POS}, {MAP}, {CUT}, {AT}, e AS (SELECT cutoff, entity, observed_at, nav_status AS kind, event_id FROM pos JOIN atc USING (mmsi) WHERE observed_at <= cutoff + INTERVAL 1 DAY - INTERVAL 1 SECOND),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cutoff, entity ORDER BY observed_at DESC, kind DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY cutoff, entity) AS n FROM e) WHERE r <= 30)
SELECT cutoff, entity, n, string_agg(kind || ':' || event_id, ' ' ORDER BY observed_at, kind, event_id) AS events FROM l GROUP BY 1, 2, 3""")
def dossiers(spark, sf):
    out = P.dossiers(positions(spark, sf).select("mmsi", "observed_at", F.col("nav_status").alias("kind"), "event_id"), _at(spark, sf), 30)
    return out.select("cutoff", "entity", "n", F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["kind"], e["event_id"].cast("string"))), " ").alias("events"))


@query("""SELECT l.doc_id AS brief, 'The  Claim ' || (l.doc_id % 5) AS claim, j.verdict FROM labels l LEFT JOIN (SELECT doc_id AS brief, 'the claim ' || (doc_id % 4) AS claim, CASE toxic WHEN 1 THEN 'no' ELSE 'yes' END AS verdict FROM labels) j
ON j.brief = l.doc_id AND j.claim = 'the claim ' || (l.doc_id % 5)""")
def verdict_join(spark, sf):
    d = spark.read.parquet(f"{sf}/labels.parquet")
    f = d.select(F.col("doc_id").alias("brief"), F.concat(F.lit("The  Claim "), (F.col("doc_id") % 5).cast("string")).alias("claim"))
    j = d.select(F.col("doc_id").alias("brief"), F.concat(F.lit("the claim "), (F.col("doc_id") % 4).cast("string")).alias("claim"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("verdict"))
    return P.verdicts(f, j)


@query("""SELECT count(*) AS briefs, count(*) FILTER (WHERE quality = 1) AS clean, count(*) FILTER (WHERE toxic = 0) AS clean_first, count(*) FILTER (WHERE doc_id % 3 = 0) AS repaired, count(*) FILTER (WHERE doc_id % 5 > 0) AS with_dates, count(*) FILTER (WHERE toxic > 0) AS with_names,
round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 4) AS share_clean FROM labels""")
def verifier_summary(spark, sf):
    d = spark.read.parquet(f"{sf}/labels.parquet")
    r = d.select((F.col("quality") == 1).alias("passes"), (F.col("toxic") == 0).alias("first_pass"), (F.col("doc_id") % 3 == 0).alias("repaired"), (F.col("doc_id") % 5).alias("dates"), F.col("toxic").alias("names"))
    return P.verifier_summary(r, ["dates", "names"])


@query(f"""WITH {POS}, r AS (SELECT DISTINCT c_custkey AS id FROM customer) SELECT nav_status AS type, count(*) AS n, count(DISTINCT mmsi) AS n_ids, round(count(DISTINCT mmsi) / (SELECT count(*) FROM r)::DOUBLE, 4) AS share FROM pos JOIN r ON r.id = mmsi GROUP BY 1""")
def coverage(spark, sf):
    asked = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return P.coverage(positions(spark, sf).select(F.col("mmsi").alias("id"), F.col("nav_status").alias("type")), asked)


@query("""SELECT trim(v) AS value, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(string_split(replace(p_name, ' ', ' ; '), ';'), lambda x: trim(x)))) AS v FROM part) WHERE trim(v) <> '' GROUP BY 1""")
def tag_profile(spark, sf):
    return P.tag_profile(spark.read.parquet(f"{sf}/part.parquet").select(F.regexp_replace("p_name", " ", " ; ").alias("p_name")), "p_name")


@query(f"""WITH {POS}, i AS (SELECT * FROM pos WHERE lat BETWEEN 55.01 AND 55.08 AND lon BETWEEN 10.01 AND 10.07),
s AS (SELECT mmsi, date_trunc('minute', observed_at) AS minute, avg(lat) AS lat, avg(lon) AS lon FROM i WHERE sog < 300 GROUP BY 1, 2),
p AS (SELECT a.mmsi AS a, b.mmsi AS b, count(*) AS m FROM s a JOIN s b ON a.minute = b.minute AND a.mmsi < b.mmsi WHERE 1000 * {HAV.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} < 1500 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM p WHERE m >= 1) AS pairs, (SELECT count(*) FROM s) AS slow_minutes, (SELECT count(DISTINCT mmsi) FROM s) AS slow_transmitters, (SELECT count(*) FROM i) AS rows_in_box, (SELECT count(DISTINCT mmsi) FROM i) AS transmitters_in_box""")
def meeting_readiness(spark, sf):
    return P.meeting_readiness(positions(spark, sf), box=(55.01, 55.08, 10.01, 10.07), metres=1500.0, max_kn=300.0, least=1)


@query("""WITH f AS (SELECT 'aisdk-' || strftime(x, '%Y-%m-%d') || '.zip' AS name, 'daily' AS kind, CAST(x AS DATE) AS s, CAST(x AS DATE) AS e FROM unnest(generate_series(DATE '2024-02-10', DATE '2024-03-05', INTERVAL 3 DAY)) t(x)
UNION ALL SELECT 'aisdk-2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '.zip', 'monthly', make_date(2024, m, 1), last_day(make_date(2024, m, 1)) FROM (SELECT CAST(i AS INTEGER) AS m FROM range(1, 4) t(i))),
d AS (SELECT CAST(unnest(generate_series(greatest(s, DATE '2024-01-15'), least(e, DATE '2024-03-20'), INTERVAL 1 DAY)) AS DATE) AS day, name, kind FROM f)
SELECT day, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY kind <> 'daily', name) AS n FROM d) WHERE n = 1""")
def files_for_days(spark, sf):
    days = spark.range(9).select(F.date_format(F.date_add(F.lit("2024-02-10").cast("date"), (F.col("id") * 3).cast("int")), "yyyy-MM-dd").alias("d"))
    months = spark.range(1, 4).select(F.concat(F.lit("2024-0"), F.col("id").cast("string")).alias("d"))
    text = days.unionByName(months).select(F.concat(F.lit('<a href="/data/aisdk-'), "d", F.lit('.zip">x</a> <a HREF="readme.txt">r</a>')).alias("text"))
    return G.files_for_days(G.listed(text), "2024-01-15", "2024-03-20").drop("link")
