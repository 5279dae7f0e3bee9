"""Queries on markers, drift, matching, timelines, offsets and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.catalog import Catalog
from tempoweave.functions.times import hms_seconds, offset_list
from tempoweave.operators import crop, drift, matching
from tempoweave.operators import markers as ops
from tempoweave.sources.driver_tables import FS, MARKERS_SQL, SIGNALS_SQL, TRIGGER_SQL, markers, signals, table, trigger

C = Catalog()
SERIES = ["subject", "device"]
HOUR = 3600.0
GAP, BAND, SIGMA = 6 * HOUR, 12 * HOUR, 3 * HOUR

CLEAN_SQL = f"""WITH RECURSIVE {MARKERS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY subject, device ORDER BY t) AS rn FROM mk),
g AS (SELECT subject, device, rn, t, t AS last, true AS keep FROM o WHERE rn = 1
  UNION ALL SELECT o.subject, o.device, o.rn, o.t, CASE WHEN o.t - g.last >= {GAP} THEN o.t ELSE g.last END, o.t - g.last >= {GAP} FROM g JOIN o ON o.subject = g.subject AND o.device = g.device AND o.rn = g.rn + 1),
kept AS (SELECT subject, device, t FROM g WHERE keep)"""


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean_greedy(markers(spark, d), SERIES, min_interval=GAP)


@C.query(CLEAN_SQL + " SELECT subject, device, count(*) AS n_markers, round(min(t), 6) AS start_time, round(max(t), 6) AS end_time, round(max(t) - min(t), 6) AS duration FROM kept GROUP BY ALL")
def marker_clean_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.marker_metrics(_kept(spark, d), SERIES)


@C.query(f"WITH {MARKERS_SQL} SELECT subject, device, count(*) AS n_markers, round(min(t), 6) AS start_time, round(max(t), 6) AS end_time, round(max(t) - min(t), 6) AS duration FROM mk WHERE value IS NOT NULL GROUP BY ALL")
def marker_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.marker_metrics(markers(spark, d), SERIES, value="value")


@C.query(CLEAN_SQL + " SELECT subject, device, round(t, 6) AS t FROM kept")
def marker_clean_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).withColumn("t", F.round("t", 6))


STATUS_SQL = CLEAN_SQL.replace("kept AS (", "kept0 AS (") + """, c AS (SELECT subject, device, count(*) AS n_rows FROM mk GROUP BY ALL), k AS (SELECT subject, device, count(*) AS n FROM kept0 GROUP BY ALL),
s AS (SELECT c.subject, c.device, CASE WHEN n_rows < 10 THEN 'deleted_too_few_rows' WHEN coalesce(n, 0) < 10 THEN 'deleted_after_clean' ELSE 'cleaned' END AS status, n_rows, n FROM c LEFT JOIN k ON c.subject = k.subject AND c.device = k.device)"""


@C.query(STATUS_SQL + " SELECT subject, device, status, n_rows, CASE WHEN status = 'cleaned' THEN n ELSE 0 END AS n_kept FROM s")
def marker_clean_status(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean_status(markers(spark, d), SERIES, min_rows=10, min_interval=GAP)


@C.query(STATUS_SQL + """, dom AS (SELECT unnest(['cleaned', 'deleted_empty', 'deleted_too_few_rows', 'missing_time_col', 'deleted_invalid_time', 'deleted_after_clean', 'read_error']) AS status)
SELECT dom.status, count(s.status) AS n FROM dom LEFT JOIN s ON s.status = dom.status GROUP BY dom.status""")
def marker_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ops.status_histogram(ops.clean_status(markers(spark, d), SERIES, min_rows=10, min_interval=GAP))


@C.query(f"""WITH {TRIGGER_SQL}, l AS (SELECT source, i, CASE WHEN abs(v) <= 0.2 THEN 0.0 WHEN abs(v - 5.0) <= 0.2 THEN 5.0 END::DOUBLE AS level FROM tr),
p AS (SELECT *, lag(level) OVER (PARTITION BY source ORDER BY i) AS before FROM l)
SELECT source, i, round(i * (1 / 500.0::DOUBLE), 4) AS reference_time, level FROM p WHERE i = 0 OR level IS NULL OR before IS NULL OR level <> before""")
def marker_edge_detect(spark: SparkSession, d: str) -> DataFrame:
    return ops.edge_markers(trigger(spark, d), ["source"])


@C.query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0') || '.25' END AS hms FROM events)
SELECT event_id, hms, CASE WHEN hms <> 'bad' THEN (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 59) + 0.25::DOUBLE END AS seconds FROM x""")
def hms_to_seconds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 11 == 0, "bad").otherwise(F.format_string("%02d:%02d:%02d.25", k % 24, k % 60, k % 59))
    return table(spark, d, "events").select("event_id", text.alias("hms")).select("event_id", "hms", hms_seconds(F.col("hms")).alias("seconds"))


@C.query("SELECT user_id AS recording, event_id AS mk, round((event_id * 7 + 1 - 1) * (2000.0 + user_id % 5) / 1e6, 6) AS reference_time, 'S ' || (event_id % 4) AS value FROM events WHERE event_id <> 1 AND event_id % 13 <> 0")
def vmrk_positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    position = F.when(k % 13 == 0, "x").otherwise((k * 7 + 1).cast("string"))
    line = F.concat(F.lit("Mk"), k.cast("string"), F.lit("=Stimulus,S "), (k % 4).cast("string"), F.lit(","), position, F.lit(",1,0"))
    lines = table(spark, d, "events").select(F.col("user_id").alias("recording"), k.alias("mk"), line.alias("line"), (F.lit(2000.0) + F.col("user_id") % 5).alias("interval_us"))
    return ops.vmrk_markers(lines).select("recording", "mk", "reference_time", "value")


@C.query(f"WITH {MARKERS_SQL} SELECT subject, 'Mark_' || trim(device) AS stim, round(t, 6) AS onset, 0.0::DOUBLE AS duration, 1.0::DOUBLE AS amplitude FROM mk WHERE device <> 'view'")
def stim_from_mark(spark: SparkSession, d: str) -> DataFrame:
    rows = markers(spark, d).withColumn("mark", F.when(F.col("device") == "view", "0Z").otherwise(F.col("device")))
    return ops.stim_from_marks(rows).select("subject", "stim", F.round("t", 6).alias("onset"), "duration", "amplitude")


@C.query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN user_id % 4 = 0 AND event_id % 5 = 1 THEN 'n/a' ELSE CAST(event_id % 17 AS VARCHAR) END AS c FROM events),
f AS (SELECT *, bool_and(c = '' OR try_cast(c AS DOUBLE) IS NOT NULL) OVER (PARTITION BY user_id) AS fine FROM x)
SELECT user_id, event_id, try_cast(nullif(c, '') AS DOUBLE) AS x FROM f WHERE fine""")
def aux_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 3 == 0, "").when((F.col("user_id") % 4 == 0) & (k % 5 == 1), "n/a").otherwise((k % 17).cast("string"))
    return ops.aux_numeric(table(spark, d, "events").select("user_id", "event_id", text.alias("count")), ["user_id"]).select("user_id", "event_id", "x")


@C.query("SELECT event_id, value FROM events WHERE round_even(value * 2.5, 0) >= 0 AND round_even(value * 2.5, 0) < 100")
def annotation_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "value", F.lit(2.5).alias("sfreq"), F.lit(100).alias("n_times"))
    return ops.annotations_inside(rows, onset="value").select("event_id", "value")


# ---------------------------------------------------------------- drift


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = markers(spark, d)
    side = lambda name: m.filter(F.col("device") == name).select("subject", "t")
    return side("view"), side("click")


ENDS_SQL = f"""WITH {MARKERS_SQL}, r AS (SELECT subject, min(t) AS lo, max(t) AS hi, count(*) AS n FROM mk WHERE device = 'view' GROUP BY ALL), v AS (SELECT subject, min(t) AS lo, max(t) AS hi, count(*) AS n FROM mk WHERE device = 'click' GROUP BY ALL),
be AS (SELECT r.subject, r.lo AS rlo, r.hi AS rhi, v.lo AS vlo, v.hi AS vhi, r.n >= 2 AND v.n >= 2 AS ok FROM r JOIN v ON r.subject = v.subject),
s AS (SELECT *, CASE WHEN NOT ok OR vhi = vlo THEN 1.0 ELSE (rhi - rlo) / (vhi - vlo) END AS scale FROM be),
dr AS (SELECT subject, CASE WHEN ok THEN rlo - scale * vlo ELSE 0.0 END AS "offset", scale, CASE WHEN ok AND rhi > rlo THEN 1.0 ELSE 0.0 END AS r_squared, CASE WHEN ok THEN 2 ELSE 0 END AS n_matches FROM s)"""


@C.query(ENDS_SQL + ' SELECT subject, round("offset", 4)::DOUBLE AS "offset", round(scale, 8)::DOUBLE AS scale, r_squared::DOUBLE AS r_squared, n_matches::BIGINT AS n_matches FROM dr')
def drift_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_endpoints(*_two(spark, d), ["subject"]).select("subject", F.round("offset", 4).alias("offset"), F.round("scale", 8).alias("scale"), "r_squared", "n_matches")


@C.query(ENDS_SQL + ' SELECT mk.subject, round(mk.t, 6) AS t, round((mk.t - dr."offset") / dr.scale, 4) AS reference_t, round(dr.scale * mk.t + dr."offset", 4) AS forward_t, round(mk.t * dr.scale + dr."offset", 4) AS device_t FROM mk JOIN dr ON mk.subject = dr.subject WHERE mk.device = \'click\'')
def drift_apply(spark: SparkSession, d: str) -> DataFrame:
    ref, dev = _two(spark, d)
    both = dev.join(drift.drift_endpoints(ref, dev, ["subject"]), "subject")
    t, o, s = F.col("t"), F.col("offset"), F.col("scale")
    return both.select("subject", F.round("t", 6).alias("t"), F.round(drift.corrected(t, o, s), 4).alias("reference_t"), F.round(drift.corrected(t, o, s, convention="forward"), 4).alias("forward_t"), F.round(drift.device_time(t, o, s), 4).alias("device_t"))


def _assign_sql(source: str, p: str = "") -> str:
    """The optimal assignment of the lists a and b of each subject, as a program over lists: best costs by number of the longer series' events, then back through the choices. Gives {p}hp: subject, i, j, ta, tb."""
    return f"""{p}z AS (SELECT subject, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS x, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS y, len(a) > len(b) AS flip FROM {source}),
{p}dp AS (SELECT subject, 0 AS i, [0.0::DOUBLE for k in range(len(y) + 1)] AS best, []::BIGINT[][] AS choice, x, y, flip FROM {p}z
  UNION ALL SELECT subject, i + 1, list_concat(['inf'::DOUBLE], least_), list_append(choice, [list_position(pair, v)::BIGINT for v in least_]), x, y, flip FROM
    (SELECT *, [list_min(pair[1:k]) for k in range(1, len(y) + 1)] AS least_ FROM (SELECT *, [best[k] + abs(x[i + 1] - y[k]) for k in range(1, len(y) + 1)] AS pair FROM {p}dp WHERE i < len(x)))),
{p}bk AS (SELECT subject, len(x)::BIGINT AS i, choice[len(x)][len(y)] AS j, choice, x, y, flip FROM {p}dp WHERE i = len(x) UNION ALL SELECT subject, i - 1, choice[i - 1][j - 1], choice, x, y, flip FROM {p}bk WHERE i > 1),
{p}hp AS MATERIALIZED (SELECT subject, CASE WHEN flip THEN j ELSE i END - 1 AS i, CASE WHEN flip THEN i ELSE j END - 1 AS j, CASE WHEN flip THEN y[j] ELSE x[i] END AS ta, CASE WHEN flip THEN x[i] ELSE y[j] END AS tb FROM {p}bk)"""


ASSIGN_SQL = f"""WITH RECURSIVE {MARKERS_SQL}, a AS (SELECT subject, t FROM mk WHERE device = 'view'), b AS (SELECT subject, t FROM mk WHERE device = 'click'),
la AS (SELECT subject, list(t ORDER BY t) AS a FROM a GROUP BY subject), lb AS (SELECT subject, list(t ORDER BY t) AS b FROM b GROUP BY subject), ab AS (SELECT la.subject, la.a, lb.b FROM la JOIN lb ON la.subject = lb.subject), {_assign_sql("ab")}"""
NEAR_SQL = f"exp(-((ta - tb) * (ta - tb)) / (2 * {SIGMA} * {SIGMA}))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Events of both devices paired by the optimal assignment."""
    return matching.match_events(*_two(spark, d), ["subject"], band=float("inf")).select("subject", "i", F.col("t_left").alias("ref"), F.col("t_right").alias("dev"))


def _slope_sql(name: str, source: str) -> str:
    return f"""{name}s AS (SELECT a.subject, median((b.ref - a.ref) / (b.dev - a.dev)) AS scale FROM {source} a JOIN {source} b ON a.subject = b.subject AND a.i < b.i AND abs(b.dev - a.dev) > 1e-10 GROUP BY ALL),
{name} AS (SELECT p.subject, coalesce(any_value(s.scale), 1.0) AS scale, median(p.ref - coalesce(s.scale, 1.0) * p.dev) AS o FROM {source} p LEFT JOIN {name}s s ON s.subject = p.subject GROUP BY p.subject)"""


def _round_sql(k: int, p: str = "") -> str:
    b = f"{p}l{k}"
    return f"""{p}o{k} AS (SELECT p.*, abs(p.ref - ({b}.scale * p.dev + {b}.o)) AS off FROM {p}p p JOIN {b} ON p.subject = {b}.subject),
{p}q{k} AS (SELECT *, median(off) OVER (PARTITION BY subject) AS mid FROM {p}o{k}), {p}w{k} AS (SELECT *, sum(CASE WHEN off <= 2 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY subject) AS near FROM {p}q{k}),
{p}c{k} AS (SELECT subject, i, ref, dev FROM {p}w{k} WHERE mid > 0 AND near >= 5 AND off <= 2 * mid), {_slope_sql(f"{p}t{k}", f"{p}c{k}")},
{p}l{k + 1} AS MATERIALIZED (SELECT {b}.subject, coalesce({p}t{k}.scale, {b}.scale) AS scale, coalesce({p}t{k}.o, {b}.o) AS o FROM {b} LEFT JOIN {p}t{k} ON {p}t{k}.subject = {b}.subject)"""


def _line_sql(pairs: str, p: str = "") -> str:
    """The robust line {p}l2 (subject, scale, o) through the pairs of subjects that have five at least."""
    return f"""{p}p0 AS (SELECT subject, i, ta AS ref, tb AS dev FROM {pairs}), {p}p AS MATERIALIZED (SELECT * FROM {p}p0 WHERE subject IN (SELECT subject FROM {p}p0 GROUP BY subject HAVING count(*) >= 5)),
{_slope_sql(f"{p}l0", f"{p}p")}, {_round_sql(0, p)}, {_round_sql(1, p)}"""


LINE_SQL = f"""{ASSIGN_SQL}, {_line_sql("hp")},
th AS (SELECT p.subject, any_value(l2.o) AS o, any_value(l2.scale) AS scale, CASE WHEN var_pop(ref) > 0 THEN greatest(0.0, 1 - var_pop(ref - (l2.scale * dev + l2.o)) / var_pop(ref)) ELSE 0.0 END AS r_squared, count(*) AS n_matches
FROM p JOIN l2 ON l2.subject = p.subject GROUP BY p.subject)"""


@C.query(LINE_SQL + ' SELECT subject, round(o, 3) AS "offset", round(scale, 7) AS scale, round(r_squared, 6) AS r_squared, n_matches FROM th')
def drift_theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_theil_sen(_pairs(spark, d), ["subject"]).select("subject", F.round("offset", 3).alias("offset"), F.round("scale", 7).alias("scale"), F.round("r_squared", 6).alias("r_squared"), "n_matches")


@C.query(LINE_SQL + ENDS_SQL.removeprefix(f"WITH {MARKERS_SQL}") + """ SELECT dr.subject, round(CASE WHEN th.subject IS NULL THEN dr."offset" ELSE th.o END, 3)::DOUBLE AS "offset", round(CASE WHEN th.subject IS NULL THEN dr.scale ELSE th.scale END, 7)::DOUBLE AS scale,
CASE WHEN th.subject IS NULL THEN 'endpoints' ELSE 'theil_sen' END AS method, coalesce(th.n_matches, dr.n_matches)::BIGINT AS n_matches FROM dr LEFT JOIN th ON th.subject = dr.subject""")
def drift_of_devices(spark: SparkSession, d: str) -> DataFrame:
    """The robust line where there are pairs enough, else the line through the end points."""
    out = matching.device_drift(*_two(spark, d), ["subject"], method="theil_sen")
    return out.select("subject", F.round("offset", 3).alias("offset"), F.round("scale", 7).alias("scale"), "method", "n_matches")


# ---------------------------------------------------------------- matching

PAIR_SQL = f"WITH {MARKERS_SQL}, a AS (SELECT subject, t FROM mk WHERE device = 'view'), b AS (SELECT subject, t FROM mk WHERE device = 'click')"


@C.query(PAIR_SQL + f" SELECT a.subject, round(a.t, 6) AS t_left, round(b.t, 6) AS t_right, round(abs(a.t - b.t), 6) AS dt, round(exp(-((a.t - b.t) * (a.t - b.t)) / (2 * {SIGMA} * {SIGMA})), 6) AS confidence FROM a JOIN b ON a.subject = b.subject AND abs(a.t - b.t) <= {BAND}")
def match_band_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = matching.match_candidates(*_two(spark, d), ["subject"], sigma=SIGMA, band=BAND)
    return out.select("subject", *(F.round(c, 6).alias(c) for c in ("t_left", "t_right", "dt", "confidence")))


@C.query(PAIR_SQL + " SELECT a.subject, round(a.t, 6) AS t_left, round(b.t, 6) AS t_right, round(abs(a.t - b.t), 4) AS cost FROM a JOIN b ON a.subject = b.subject")
def match_cost_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matching.cost_matrix(*_two(spark, d), ["subject"]).select("subject", F.round("t_left", 6).alias("t_left"), F.round("t_right", 6).alias("t_right"), F.round("cost", 4).alias("cost"))


def _first_events(spark: SparkSession, d: str) -> list[DataFrame]:
    """Of both devices as many first events as the shorter series has."""
    two = _two(spark, d)
    least = two[0].groupBy("subject").count().join(two[1].groupBy("subject").agg(F.count(F.lit(1)).alias("other")), "subject").select("subject", F.least("count", "other").alias("n"))
    nth = F.row_number().over(W.partitionBy("subject").orderBy("t"))
    return [x.withColumn("nth", nth).join(least, "subject").filter("nth <= n").select("subject", "t") for x in two]


@C.query(f"""{PAIR_SQL}, x AS (SELECT subject, t AS ta, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS i FROM a), y AS (SELECT subject, t AS tb, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS i FROM b)
SELECT x.subject, x.i, round(ta, 6) AS t_left, round(tb, 6) AS t_right, round({NEAR_SQL}, 6) AS confidence FROM x JOIN y ON x.subject = y.subject AND x.i = y.i WHERE abs(ta - tb) <= {BAND}""")
def match_zip_equal_n(spark: SparkSession, d: str) -> DataFrame:
    out = matching.match_in_order(*_first_events(spark, d), ["subject"], sigma=SIGMA, band=BAND)
    return out.select("subject", "i", *(F.round(c, 6).alias(c) for c in ("t_left", "t_right", "confidence")))


def _matched(method: str, scale: float = 1.0):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ref, dev = (x.withColumn("t", F.col("t") / scale) for x in _two(spark, d))
        out = matching.match_events(ref, dev, ["subject"], method=method, sigma=SIGMA / scale, band=BAND / scale)
        return out.select("subject", "i", "j", *(F.round(c, 5).alias(c) for c in ("t_left", "t_right", "confidence")))

    return run


MATCH_SQL = "round(ta, 5) AS t_left, round(tb, 5) AS t_right"


@C.query(f"{ASSIGN_SQL} SELECT subject, i, j, {MATCH_SQL}, round({NEAR_SQL}, 5) AS confidence FROM hp WHERE abs(ta - tb) <= {BAND}")
def match_hungarian(spark: SparkSession, d: str) -> DataFrame:
    return _matched("hungarian")(spark, d)


@C.query(f"""{ASSIGN_SQL}, fl AS (SELECT subject, a AS x, b AS y, ({int(BAND * 1000)}::BIGINT) * (least(len(a), len(b)) + 1) + 1 AS worth FROM ab),
fd AS (SELECT subject, 0 AS i, [[0::BIGINT for k in range(len(y) + 1)]] AS rows_, x, y, worth FROM fl
  UNION ALL SELECT subject, i + 1, list_append(rows_, [list_max(top[1:k]) for k in range(1, len(y) + 2)]), x, y, worth FROM
    (SELECT *, list_concat([0::BIGINT], [greatest(rows_[i + 1][k + 1], CASE WHEN abs(x[i + 1] - y[k]) <= {BAND} THEN rows_[i + 1][k] + worth - CAST(trunc(abs(x[i + 1] - y[k]) * 1000) AS BIGINT) ELSE -1 END) for k in range(1, len(y) + 1)]) AS top FROM fd WHERE i < len(x))),
fw AS (SELECT subject, len(x)::BIGINT AS i, len(y)::BIGINT AS j, false AS hit, rows_, x, y FROM fd WHERE i = len(x)
  UNION ALL SELECT subject, CASE WHEN left_ THEN i ELSE i - 1 END, CASE WHEN left_ OR rows_[i + 1][j + 1] > rows_[i][j + 1] THEN j - 1 ELSE j END, NOT left_ AND rows_[i + 1][j + 1] > rows_[i][j + 1], rows_, x, y
    FROM (SELECT *, rows_[i + 1][j + 1] = rows_[i + 1][j] AS left_ FROM fw WHERE i > 0 AND j > 0)),
fp AS (SELECT subject, i, j, x[i + 1] AS ta, y[j + 1] AS tb FROM fw WHERE hit)
SELECT subject, i, j, {MATCH_SQL}, round({NEAR_SQL}, 5) AS confidence FROM fp""")
def match_min_cost_flow(spark: SparkSession, d: str) -> DataFrame:
    return _matched("min_cost_flow")(spark, d)


@C.query(f"""{ASSIGN_SQL}, sk AS (SELECT subject, 0 AS n, [t / {4 * HOUR} for t in a] AS x, [t / {4 * HOUR} for t in b] AS y, [1.0::DOUBLE for t in a] AS u, [1.0::DOUBLE for t in b] AS v FROM ab
  UNION ALL SELECT subject, n + 1, x, y, u2, [1 / (list_sum([exp(-abs(x[i] - y[j]) / 0.1) * u2[i] for i in range(1, len(x) + 1)]) + 1e-16) for j in range(1, len(y) + 1)] FROM
    (SELECT *, [1 / (list_sum([exp(-abs(x[i] - y[j]) / 0.1) * v[j] for j in range(1, len(y) + 1)]) + 1e-16) for i in range(1, len(x) + 1)] AS u2 FROM sk WHERE n < 100)),
si AS (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM sk WHERE n = 100), sj AS (SELECT *, unnest(range(1, len(y) + 1)) AS j FROM si),
sp AS (SELECT subject, i - 1 AS i, j - 1 AS j, x[i] AS ta, y[j] AS tb, u[i] * exp(-abs(x[i] - y[j]) / 0.1) * v[j] AS plan FROM sj)
SELECT subject, i, j, {MATCH_SQL}, round(plan, 5) AS confidence FROM sp WHERE plan > 0.1 AND abs(ta - tb) <= {BAND / (4 * HOUR)}""")
def match_sinkhorn(spark: SparkSession, d: str) -> DataFrame:
    return _matched("sinkhorn", 4 * HOUR)(spark, d)


TWO_SQL = f"""{ASSIGN_SQL}, mt AS (SELECT subject, ta, tb, {NEAR_SQL} AS w FROM hp WHERE abs(ta - tb) <= {BAND}),
tl0 AS (SELECT subject, (ta + tb * w) / (1 + w) AS cons_t, 1 + w AS confidence, ta, tb, w FROM mt UNION ALL SELECT a.subject, a.t, 1.0, a.t, NULL, NULL FROM a JOIN ab ON ab.subject = a.subject ANTI JOIN mt ON mt.subject = a.subject AND mt.ta = a.t
  UNION ALL SELECT b.subject, b.t, 1.0, NULL, b.t, 1.0 FROM b JOIN ab ON ab.subject = b.subject ANTI JOIN mt ON mt.subject = b.subject AND mt.tb = b.t),
tl AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY cons_t) - 1 AS cons_id FROM tl0)"""


def _two_timeline(spark: SparkSession, d: str) -> DataFrame:
    return matching.consensus_timeline(markers(spark, d), ["subject"], ["view", "click"], sigma=SIGMA, band=BAND, drift=None)


@C.query(TWO_SQL + " SELECT subject, cons_id, round(cons_t, 4) AS cons_t, round(confidence, 6) AS confidence FROM tl")
def timeline_two_devices(spark: SparkSession, d: str) -> DataFrame:
    """The consensus of two devices: matched events averaged by their weights, the others appended."""
    return _two_timeline(spark, d).filter("device = 'view'").select("subject", "cons_id", F.round("cons_t", 4).alias("cons_t"), F.round("confidence", 6).alias("confidence"))


@C.query(TWO_SQL + """ SELECT subject, cons_id, round(cons_t, 4) AS consensus_time, round(confidence, 6) AS consensus_confidence, round(ta, 4) AS view_time, round(CASE WHEN ta IS NULL THEN 0.0 ELSE 1.0 END, 6)::DOUBLE AS view_weight,
round(tb, 4) AS click_time, round(coalesce(w, 0.0), 6) AS click_weight FROM tl""")
def timeline_wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = matching.wide_timeline(_two_timeline(spark, d), ["subject"], ["view", "click"])
    numbers = {"consensus_time": 4, "consensus_confidence": 6, "view_time": 4, "view_weight": 6, "click_time": 4, "click_weight": 6}
    return wide.select("subject", "cons_id", *(F.round(c, k).alias(c) for c, k in numbers.items()))


@C.query(TWO_SQL + " SELECT subject, count(*) AS n_consensus_events, 2::BIGINT AS n_devices, round(min(cons_t), 4) AS lo, round(max(cons_t), 4) AS hi, count(ta) AS n_view, count(tb) AS n_click FROM tl GROUP BY subject")
def timeline_metadata(spark: SparkSession, d: str) -> DataFrame:
    out = matching.timeline_metadata(_two_timeline(spark, d), ["subject"])
    return out.select("subject", "n_consensus_events", "n_devices", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), *(F.col("events_by_device")[c].alias(f"n_{c}") for c in ("view", "click")))


DEVICES = ["view", "click", "purchase", "signup", "error"]


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return matching.consensus_timeline(markers(spark, d), ["subject"], DEVICES, sigma=SIGMA, band=BAND)


def _fold_sql(devices: list[str]) -> str:
    """Rows {tl}k (subject, cid, t, conf) and {at}k (subject, cid, device, t, w) after each device: drift by assignment, then matches within the band, then weighted means."""
    parts = [f"""tl0 AS MATERIALIZED (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS cid, t, 1.0::DOUBLE AS conf FROM mk WHERE device = '{devices[0]}'),
at0 AS MATERIALIZED (SELECT subject, cid, '{devices[0]}' AS device, t, 1.0::DOUBLE AS w FROM tl0)"""]
    for k, device in enumerate(devices[1:], 1):
        p = f"s{k}_"
        parts.append(f"""{p}ab AS MATERIALIZED (SELECT x.subject, x.a, y.b FROM (SELECT subject, list(t ORDER BY t) AS a FROM tl{k - 1} GROUP BY subject) x JOIN (SELECT subject, list(t ORDER BY t) AS b FROM mk WHERE device = '{device}' GROUP BY subject) y ON x.subject = y.subject),
{_assign_sql(f"{p}ab", f"{p}d_")}, {_line_sql(f"{p}d_hp", p)},
{p}e AS (SELECT subject, CASE WHEN len(a) >= 2 AND len(b) >= 2 AND b[-1] > b[1] THEN (a[-1] - a[1]) / (b[-1] - b[1]) ELSE 1.0 END AS scale, a, b FROM {p}ab),
{p}dr AS (SELECT e.subject, coalesce(l.scale, e.scale) AS scale, CASE WHEN l.subject IS NOT NULL THEN l.o WHEN len(a) >= 2 AND len(b) >= 2 THEN a[1] - e.scale * b[1] ELSE 0.0 END AS o, a, b FROM {p}e e LEFT JOIN {p}l2 l ON l.subject = e.subject),
{p}mv AS MATERIALIZED (SELECT subject, a, [(v - o) / scale for v in b] AS b FROM {p}dr), {_assign_sql(f"{p}mv", f"{p}m_")},
{p}x AS MATERIALIZED (SELECT subject, i, j, tb, {NEAR_SQL} AS c FROM {p}m_hp WHERE abs(ta - tb) <= {BAND}),
{p}old AS (SELECT subject, cid, t, conf, row_number() OVER (PARTITION BY subject ORDER BY t, cid) - 1 AS i FROM tl{k - 1}),
{p}got AS MATERIALIZED (SELECT o.subject, o.cid, o.t, o.conf + coalesce(x.c, 0.0) AS conf, x.tb, x.c FROM {p}old o LEFT JOIN {p}x x ON x.subject = o.subject AND x.i = o.i),
{p}all AS (SELECT subject, len(a) AS n, b, unnest(range(len(b))) AS j FROM {p}mv),
{p}new AS MATERIALIZED (SELECT e.subject, e.n + row_number() OVER (PARTITION BY e.subject ORDER BY e.j) - 1 AS cid, e.b[e.j + 1] AS t FROM {p}all e ANTI JOIN {p}x x ON x.subject = e.subject AND x.j = e.j),
at{k} AS MATERIALIZED (SELECT * FROM at{k - 1} UNION ALL SELECT subject, cid, '{device}', tb, c FROM {p}got WHERE c IS NOT NULL UNION ALL SELECT subject, cid, '{device}', t, 1.0 FROM {p}new),
tl{k} AS MATERIALIZED (SELECT r.subject, r.cid, CASE WHEN sum(q.w) > 0 THEN sum(q.t * q.w) / sum(q.w) ELSE any_value(r.t) END AS t, any_value(r.conf) AS conf FROM (SELECT subject, cid, t, conf FROM {p}got UNION ALL SELECT subject, cid, t, 1.0 FROM {p}new) r
  JOIN at{k} q ON q.subject = r.subject AND q.cid = r.cid GROUP BY r.subject, r.cid)""")
    last = len(devices) - 1
    return f"WITH RECURSIVE {MARKERS_SQL}, {', '.join(parts)}, tl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS cons_id FROM tl{last}), own AS (SELECT * FROM at{last})"


FIVE_SQL = _fold_sql(DEVICES)


@C.query(FIVE_SQL + f""" SELECT tl.subject, tl.cons_id, round(tl.t, 3) AS cons_t, round(tl.conf, 5) AS confidence, v.device, round(own.t, 3) AS t, round(coalesce(own.w, 0.0), 5) AS weight
FROM tl CROSS JOIN (SELECT unnest({DEVICES}) AS device) v LEFT JOIN own ON own.subject = tl.subject AND own.cid = tl.cid AND own.device = v.device""")
def timeline_consensus(spark: SparkSession, d: str) -> DataFrame:
    numbers = {"cons_t": 3, "confidence": 5, "t": 3, "weight": 5}
    return _timeline(spark, d).select("subject", "cons_id", "device", *(F.round(c, k).alias(c) for c, k in numbers.items()))


@C.query(FIVE_SQL + " SELECT tl.subject, tl.cons_id, round(any_value(tl.t), 3) AS consensus_time, round(any_value(tl.conf), 5) AS consensus_confidence, "
         + ", ".join(f"round(any_value(CASE WHEN own.device = '{c}' THEN own.t END), 3) AS {c}_time, round(coalesce(any_value(CASE WHEN own.device = '{c}' THEN own.w END), 0.0), 5) AS {c}_weight" for c in DEVICES)
         + " FROM tl JOIN own ON own.subject = tl.subject AND own.cid = tl.cid GROUP BY tl.subject, tl.cons_id")
def timeline_wide_five(spark: SparkSession, d: str) -> DataFrame:
    wide = matching.wide_timeline(_timeline(spark, d), ["subject"], DEVICES)
    numbers = {"consensus_time": 3, "consensus_confidence": 5} | {f"{c}_time": 3 for c in DEVICES} | {f"{c}_weight": 5 for c in DEVICES}
    return wide.select("subject", "cons_id", *(F.round(c, k).alias(c) for c, k in numbers.items()))


# ---------------------------------------------------------------- offsets and crops


def _devices(spark: SparkSession, d: str) -> DataFrame:
    """Range and place of each subject's devices."""
    out = markers(spark, d).groupBy("subject", "device").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return out.withColumn("position", (F.row_number().over(W.partitionBy("subject").orderBy("device")) - 1).cast("long"))


DEVICES_SQL = f"{MARKERS_SQL}, r AS (SELECT subject, device, min(t) AS lo, max(t) AS hi FROM mk GROUP BY ALL), dv AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY device) - 1 AS position FROM r)"


@C.query(f"WITH {DEVICES_SQL} SELECT subject, device, position, coalesce(CASE position WHEN 0 THEN 1.5 WHEN 1 THEN -0.5 WHEN 2 THEN 0.25 + subject END, 0.0)::DOUBLE AS \"offset\" FROM dv")
def offset_map(spark: SparkSession, d: str) -> DataFrame:
    spec = F.concat(F.lit("1.5, -0.5, ,"), (F.lit(0.25) + F.col("subject")).cast("string"))
    specs = _devices(spark, d).select("subject").distinct().withColumn("offsets", offset_list(spec))
    return crop.offsets_of_devices(_devices(spark, d).select("subject", "device", "position"), specs, ["subject"]).select("subject", "device", "position", "offset")


def _adjusted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = _devices(spark, d).select("subject", "device", F.round("lo", 3).alias("offset"), F.when(F.col("position") != 3, 1.0 + F.col("position") / 10).alias("scale"), F.when(F.col("position") != 3, "theil_sen").alias("method"))
    changes = _devices(spark, d).filter("position % 2 = 0").select("subject", "device", (F.col("position") * 0.5 + 1).alias("change"))
    return old, crop.adjusted_offsets(old, changes, ["subject", "device"], add=True)


ADJUST_SQL = f"""WITH {DEVICES_SQL}, old AS (SELECT subject, device, position, round(lo, 3) AS o, CASE WHEN position <> 3 THEN 1.0 + position / 10.0::DOUBLE END AS s, CASE WHEN position <> 3 THEN 'theil_sen' END AS m FROM dv),
new AS (SELECT subject, device, CASE WHEN position % 2 = 0 THEN o + position * 0.5 + 1 ELSE o END AS o2, coalesce(s, 1.0)::DOUBLE AS s2, coalesce(m, 'no_correction') || CASE WHEN position % 2 = 0 THEN '_manual_adjust' ELSE '' END AS m2 FROM old)"""


@C.query(ADJUST_SQL + ' SELECT subject, device, round(o2, 3)::DOUBLE AS "offset", round(s2, 6)::DOUBLE AS scale, m2 AS method FROM new')
def offset_adjust(spark: SparkSession, d: str) -> DataFrame:
    return _adjusted(spark, d)[1].select("subject", "device", F.round("offset", 3).alias("offset"), F.round("scale", 6).alias("scale"), "method")


@C.query(ADJUST_SQL + " SELECT old.subject, old.device, round(o, 3)::DOUBLE AS old_offset, round(s, 6)::DOUBLE AS old_scale, round(o2, 3)::DOUBLE AS new_offset, round(s2, 6)::DOUBLE AS new_scale, round(o2 - o, 3)::DOUBLE AS change FROM old JOIN new ON old.subject = new.subject AND old.device = new.device")
def offset_diff(spark: SparkSession, d: str) -> DataFrame:
    out = crop.offset_report(*_adjusted(spark, d), ["subject", "device"])
    return out.select("subject", "device", *(F.round(c, k).alias(c) for c, k in (("old_offset", 3), ("old_scale", 6), ("new_offset", 3), ("new_scale", 6), ("change", 3))))


@C.query(f"WITH {DEVICES_SQL}, g AS (SELECT subject, max(lo) AS lo, min(hi) AS hi FROM dv GROUP BY ALL) SELECT subject, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g WHERE lo < hi")
def aligned_range(spark: SparkSession, d: str) -> DataFrame:
    rows = _devices(spark, d).withColumn("consensus_lo", F.lit(None).cast("double")).withColumn("consensus_hi", F.lit(None).cast("double"))
    return crop.aligned_range(rows, ["subject"]).select("subject", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@C.query(f"""WITH {DEVICES_SQL}, ref AS (SELECT subject, arg_min(device, (hi - lo, position)) AS rd, arg_min(lo, (hi - lo, position)) AS rlo, arg_min(hi, (hi - lo, position)) AS rhi FROM dv GROUP BY ALL),
m AS (SELECT mk.subject, mk.device, CASE WHEN mk.device = rd THEN t ELSE t + (rlo - dv.lo) END AS t, rlo, rhi FROM mk JOIN dv ON mk.subject = dv.subject AND mk.device = dv.device JOIN ref ON ref.subject = mk.subject)
SELECT subject, device, count(CASE WHEN t >= rlo AND t <= rhi THEN 1 END) AS n_kept, round(sum(CASE WHEN t >= rlo AND t <= rhi THEN t END), 2) AS sum_t, sum(CASE WHEN t >= rlo AND t <= rhi THEN 1.0::DOUBLE ELSE 0.0 END) AS weight FROM m GROUP BY ALL""")
def crop_shortest(spark: SparkSession, d: str) -> DataFrame:
    rows = markers(spark, d).select("subject", "device", F.lit(0).alias("cons_id"), "t", F.lit(1.0).alias("weight"))
    out = crop.crop_to_shortest(rows, _devices(spark, d), ["subject"])
    return out.groupBy("subject", "device").agg(F.count("t").alias("n_kept"), F.round(F.sum("t"), 2).alias("sum_t"), F.sum("weight").alias("weight"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("recording") % 4
    return signals(spark, d).withColumn("t", F.col("sample_idx") / FS).withColumn("start", 3.1 + k).withColumn("end", F.when(k == 3, 3.0).otherwise(9.25 + k)).withColumn("offset", F.lit(0.5)).withColumn("sfreq", F.lit(FS)).withColumn("i", F.col("sample_idx"))


WINDOWS_SQL = f"WITH {SIGNALS_SQL}, x AS (SELECT *, sample_idx / 4.0::DOUBLE AS t, 3.1::DOUBLE + recording % 4 AS s, CASE WHEN recording % 4 = 3 THEN 3.0::DOUBLE ELSE 9.25::DOUBLE + recording % 4 END AS e, 0.5::DOUBLE AS o FROM sig)"


@C.query(WINDOWS_SQL + " SELECT recording, channel, round(t - (s - o), 6) AS t, round(x, 6) AS x FROM x WHERE t >= s - o AND t <= e - o")
def crop_ecg(spark: SparkSession, d: str) -> DataFrame:
    return crop.crop_closed(_windows(spark, d), ["recording", "channel"]).select("recording", "channel", F.round("t", 6).alias("t"), F.round("x", 6).alias("x"))


@C.query(WINDOWS_SQL + " SELECT recording, channel, sample_idx - greatest(0, CAST(trunc((s - o) * 4) AS BIGINT)) AS new_i, round(x, 6) AS x FROM x WHERE sample_idx >= greatest(0, CAST(trunc((s - o) * 4) AS BIGINT)) AND sample_idx < CAST(trunc((e - o) * 4) AS BIGINT)")
def crop_eeg(spark: SparkSession, d: str) -> DataFrame:
    return crop.crop_by_index(_windows(spark, d), ["recording", "channel"]).select("recording", "channel", "new_i", F.round("x", 6).alias("x"))


@C.query(WINDOWS_SQL + """, f AS (SELECT *, t >= s - o AND t < e - o AS inside, bool_or(t >= s - o AND t < e - o) OVER (PARTITION BY recording, channel) AS has_any FROM x), k AS (SELECT * FROM f WHERE inside OR NOT has_any)
SELECT recording, channel, round(t - min(t) OVER (PARTITION BY recording, channel), 6) AS t, round(x, 6) AS x FROM k""")
def crop_fnirs(spark: SparkSession, d: str) -> DataFrame:
    return crop.crop_half_open(_windows(spark, d), ["recording", "channel"]).select("recording", "channel", F.round("t", 6).alias("t"), F.round("x", 6).alias("x"))
