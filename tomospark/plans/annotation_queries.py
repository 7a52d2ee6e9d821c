"""Queries over annotations: confidence, pivots, clusters, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import epanechnikov
from ..operators import annotations as ann
from ..operators import confidence as conf
from ..operators import merging
from .surrogates import HISTORY, INFO, NODULES, OVERLAP, history, info_sql, nodules, q6, r6, scan_info

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


PAIRS = f"""WITH {NODULES}, pairs AS (
  SELECT a."NoduleID" AS id, a."NoduleID" = b."NoduleID" AS own, a."DoctorID" AS da, b."DoctorID" AS db, a."DoctorConfidence" AS ca, b."DoctorConfidence" AS cb,
    (a."coordX" - b."coordX") ** 2 + (a."coordY" - b."coordY") ** 2 + (a."coordZ" - b."coordZ") ** 2 AS d2 FROM nodules a JOIN nodules b USING (seriesuid))"""


def _confidence_sql(weight: str) -> str:
    return f"""{PAIRS} SELECT id AS "NoduleID", {q6(f"sum(CASE WHEN own OR da <> db THEN {weight} ELSE 0.0 END)")} AS "NoduleConfidence" FROM pairs WHERE d2 <= 400 GROUP BY id"""


@query(_confidence_sql("0.75::DOUBLE * (1 - d2 / 400) * cb * ca"))
def nodule_confidence(spark, d):
    return conf.finding_confidence(nodules(spark, d)).select("NoduleID", r6(F.col("NoduleConfidence")).alias("NoduleConfidence"))


@query(_confidence_sql("0.75::DOUBLE * (1 - d2 / 400) * cb * ca * (CASE WHEN own THEN 0.5::DOUBLE / 0.75::DOUBLE ELSE 0.5::DOUBLE END)"))
def nodule_confidence_alpha(spark, d):
    return conf.finding_confidence(nodules(spark, d), alpha=0.5).select("NoduleID", r6(F.col("NoduleConfidence")).alias("NoduleConfidence"))


@query(_confidence_sql("0.75::DOUBLE * (1 - d2 / 400) * cb"))
def nodule_confidence_unweighted(spark, d):
    return conf.finding_confidence(nodules(spark, d), weight_by_doctor=False).select("NoduleID", r6(F.col("NoduleConfidence")).alias("NoduleConfidence"))


@query(f"""WITH {NODULES}, c AS (SELECT *, 0.75::DOUBLE * "DoctorConfidence" AS confidence FROM nodules)
SELECT seriesuid, "NoduleID", {q6('confidence')} AS confidence FROM c WHERE confidence > 0.6""")
def confidence_filter(spark, d):
    rows = nodules(spark, d).withColumn("confidence", epanechnikov(F.lit(0.0)) * F.col("DoctorConfidence"))
    return rows.where("confidence > 0.6").select("seriesuid", "NoduleID", r6(F.col("confidence")).alias("confidence"))


@query(f"""WITH {NODULES}, p AS (SELECT DISTINCT seriesuid, "DoctorID" AS doc FROM nodules)
SELECT seriesuid, {", ".join(f'max(CASE WHEN doc = {k} THEN 1 ELSE 0 END)::INT AS doctor_{k:03d}' for k in range(15))} FROM p GROUP BY seriesuid""")
def annotators_pivot(spark, d):
    return ann.annotators_pivot(nodules(spark, d), range(15))


@query(f"""WITH {NODULES} SELECT seriesuid, count(DISTINCT "DoctorID") AS n_annotators FROM nodules GROUP BY seriesuid HAVING count(DISTINCT "DoctorID") >= 3""")
def annotators_count(spark, d):
    return nodules(spark, d).groupBy("seriesuid").agg(F.count_distinct("DoctorID").alias("n_annotators")).where("n_annotators >= 3")


@query(f"""WITH {info_sql('o_custkey')}, r AS (SELECT *, row_number() OVER (PARTITION BY seriesuid ORDER BY "SpacingZ", "ScanID") AS n FROM info)
SELECT seriesuid, "ScanID", "SpacingZ" FROM r WHERE n = 1""")
def best_spacing(spark, d):
    return ann.best_spacing(scan_info(spark, d, "o_custkey"), tie="ScanID").select("seriesuid", "ScanID", "SpacingZ")


def _moved(rule: str) -> str:
    """SQL of a rule on each axis; @ stands for the axis."""
    columns = ", ".join(f'{q6(rule.replace("@", a))} AS "coord{a}"' for a in "XYZ")
    return f'WITH {NODULES}, {INFO} SELECT "NoduleID", {columns} FROM nodules n JOIN info i USING (seriesuid)'


@query(_moved('n."coord@" * i."Spacing@" + i."Origin@"'))
def transform_annotation(spark, d):
    rows = ann.to_millimetres(nodules(spark, d), scan_info(spark, d))
    return rows.select("NoduleID", *[r6(F.col(f"coord{a}")).alias(f"coord{a}") for a in "XYZ"])


@query(_moved('(n."coord@" - i."Origin@") / i."Spacing@"'))
def millimetres_to_pixels(spark, d):
    rows = ann.to_pixels(nodules(spark, d), scan_info(spark, d))
    return rows.select("NoduleID", *[r6(F.col(f"coord{a}")).alias(f"coord{a}") for a in "XYZ"])


#: Raw codes by l_partkey mod 8.
RAW_TYPES = (" G ", "Каверна", "", "м", "V", "к2", "nc", "с 3")


def _type_sql() -> str:
    out = "lower(trim(raw))"
    for pattern, to in ann.TYPE_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{', '.join(f"'{x}'" for x in RAW_TYPES)}][(l_partkey % 8)::INT + 1] AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {out} AS nodule_type FROM t"""


@query(_type_sql())
def nodule_type_normalize(spark, d):
    from .surrogates import table

    raw = F.element_at(F.array(*map(F.lit, RAW_TYPES)), (F.col("l_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ann.normalized_type(raw).alias("nodule_type"))


@query(f"""WITH {NODULES}, n AS (SELECT * FROM nodules WHERE "DoctorID" < 10), p AS (SELECT DISTINCT seriesuid, "DoctorID" FROM nodules)
SELECT seriesuid, "DoctorID", n."NoduleID" AS "NoduleID", n."coordX" AS "coordX" FROM n FULL JOIN p USING (seriesuid, "DoctorID")""")
def include_annotators_outer(spark, d):
    rows = nodules(spark, d)
    return ann.with_annotators(rows.where("DoctorID < 10"), rows).select("seriesuid", "DoctorID", "NoduleID", "coordX")


MEETINGS = f"""{NODULES}, p AS (SELECT DISTINCT seriesuid, "DoctorID" AS doc FROM nodules),
met AS (SELECT a.doc AS doc_i, b.doc AS doc_j, count(*) AS meetings FROM p a JOIN p b ON a.seriesuid = b.seriesuid AND a.doc < b.doc GROUP BY 1, 2)"""


@query(f"WITH {MEETINGS} SELECT doc_i, doc_j, meetings, {q6('meetings / (SELECT sum(meetings) FROM met)')} AS probability FROM met")
def pair_meetings(spark, d):
    return conf.pair_probability(nodules(spark, d)).select("doc_i", "doc_j", "meetings", r6(F.col("probability")).alias("probability"))


@query(f"""WITH {NODULES}, p AS (SELECT DISTINCT seriesuid, "DoctorID" AS doc FROM nodules)
SELECT a.seriesuid, a.doc AS "DoctorID", b.doc AS doc_i, c.doc AS doc_j FROM p a JOIN p b ON a.seriesuid = b.seriesuid AND a.doc <> b.doc
JOIN p c ON a.seriesuid = c.seriesuid AND c.doc <> a.doc AND b.doc < c.doc""")
def consiliums(spark, d):
    return conf.consiliums(nodules(spark, d))


OVERLAPS = f"""{NODULES}, near AS (
  SELECT a.seriesuid, a."NoduleID" AS id_1, b."NoduleID" AS id_2, a.diameter_mm AS d1, b.diameter_mm AS d2,
    sqrt((a."coordX" - b."coordX") ** 2 + (a."coordY" - b."coordY") ** 2 + (a."coordZ" - b."coordZ") ** 2) AS d FROM nodules a JOIN nodules b ON a.seriesuid = b.seriesuid AND a."NoduleID" <> b."NoduleID"),
ovl AS (SELECT *, {OVERLAP} AS overlap FROM near)"""


@query(f"WITH {OVERLAPS} SELECT id_1, id_2, {q6('overlap')} AS overlap, {q6('d')} AS distance FROM ovl WHERE overlap > 0.1")
def sphere_overlap_pairs(spark, d):
    return merging.overlaps(nodules(spark, d)).select("id_1", "id_2", r6(F.col("overlap")).alias("overlap"), r6(F.col("distance")).alias("distance"))


GROUPS = f"""WITH RECURSIVE {OVERLAPS}, edges AS (SELECT id_1 AS a, id_2 AS b FROM ovl WHERE overlap > 0.1 UNION SELECT id_2, id_1 FROM ovl WHERE overlap > 0.1),
reach AS (SELECT "NoduleID" AS a, "NoduleID" AS b FROM nodules UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
grouped AS (SELECT a AS "NoduleID", min(b) AS "GroupNoduleID" FROM reach GROUP BY a)"""


@query(f'{GROUPS} SELECT "NoduleID", "GroupNoduleID" FROM grouped')
def nodule_groups(spark, d):
    return merging.groups(nodules(spark, d))


Q = 1.2815515655446004


@query(f"""{GROUPS}, w AS (SELECT g."GroupNoduleID" AS id, "DoctorConfidence" AS w, "coordX" AS x, "coordY" AS y, "coordZ" AS z, diameter_mm / (2 * {Q}::DOUBLE) AS s, n.seriesuid FROM grouped g JOIN nodules n USING ("NoduleID")),
m AS (SELECT id, min(seriesuid) AS seriesuid, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz, max(w) AS mw FROM w GROUP BY id)
SELECT id AS "GroupNoduleID", m.seriesuid, {q6('any_value(mx)')} AS "coordX", {q6('any_value(my)')} AS "coordY", {q6('any_value(mz)')} AS "coordZ",
  {q6(f'2 * {Q}::DOUBLE * sqrt(sum(w * (s * s + (z - mz) * (z - mz))) / sum(w))')} AS diameter_mm, {q6('any_value(mw)')} AS "NoduleConfidence" FROM w JOIN m USING (id) GROUP BY id, m.seriesuid""")
def group_merge(spark, d):
    rows = nodules(spark, d).withColumn("NoduleConfidence", F.col("DoctorConfidence"))
    merged = merging.nodule_groups(rows)
    return merged.select("GroupNoduleID", "seriesuid", *[r6(F.col(c)).alias(c) for c in ("coordX", "coordY", "coordZ", "diameter_mm", "NoduleConfidence")])


@query(f"""{GROUPS}, c AS (SELECT "DoctorID", count(*) OVER (PARTITION BY "GroupNoduleID") AS verifications FROM grouped JOIN nodules USING ("NoduleID"))
SELECT "DoctorID", verifications, count(*) AS n FROM c WHERE verifications <= 3 GROUP BY 1, 2""")
def verification_counts(spark, d):
    rows = merging.with_groups(nodules(spark, d))
    return ann.verification_counts(rows).where("verifications <= 3")


@query(f'WITH {NODULES} SELECT "DoctorID", count(*) AS n FROM nodules GROUP BY 1')
def nodules_per_doctor(spark, d):
    return nodules(spark, d).groupBy("DoctorID").agg(F.count("*").alias("n"))


def _sides(spark, d):
    rows = nodules(spark, d).select(F.col("seriesuid").alias("source_id"), F.col("NoduleID").alias("nodule_id"), F.col("coordZ").alias("z"), F.col("coordY").alias("y"), F.col("coordX").alias("x"), F.col("diameter_mm").alias("diam"), "DoctorID")
    return rows.where("DoctorID < 8").drop("DoctorID"), rows.where("DoctorID >= 8").drop("DoctorID")


def _match_sql(true: bool) -> str:
    own, other = ("t", "p") if true else ("p", "t")
    side = "<" if true else ">="
    return f"""WITH {NODULES}, near AS (
  SELECT a."NoduleID" AS t, b."NoduleID" AS p, a.diameter_mm AS d1, b.diameter_mm AS d2, sqrt((a."coordX" - b."coordX") ** 2 + (a."coordY" - b."coordY") ** 2 + (a."coordZ" - b."coordZ") ** 2) AS d
  FROM nodules a JOIN nodules b ON a.seriesuid = b.seriesuid AND a."DoctorID" < 8 AND b."DoctorID" >= 8),
o AS (SELECT t, p, {OVERLAP} AS overlap FROM near), r AS (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY round(overlap, 9) DESC, {other}) AS n FROM o WHERE overlap > 0)
SELECT x."NoduleID" AS nodule_id, x.seriesuid AS source_id, {q6('r.overlap')} AS overlap FROM nodules x LEFT JOIN r ON r.{own} = x."NoduleID" AND n = 1 WHERE x."DoctorID" {side} 8"""


@query(_match_sql(True))
def overlap_match_true(spark, d):
    return merging.match(*_sides(spark, d))[0].select("nodule_id", "source_id", r6(F.col("overlap")).alias("overlap"))


@query(_match_sql(False))
def overlap_match_pred(spark, d):
    return merging.match(*_sides(spark, d))[1].select("nodule_id", "source_id", r6(F.col("overlap")).alias("overlap"))


BALLS = f"""{NODULES}, sc AS (SELECT seriesuid, "DoctorID" AS doc, diameter_mm * 0.1::DOUBLE AS d, "coordX" * 0.1::DOUBLE AS x, "coordY" * 0.1::DOUBLE AS y, "coordZ" * 0.1::DOUBLE AS z FROM nodules),
sh AS (SELECT seriesuid, doc, d, x - (min(x) OVER s - max(d) OVER s) AS x, y - (min(y) OVER s - max(d) OVER s) AS y, z - (min(z) OVER s - max(d) OVER s) AS z FROM sc WINDOW s AS (PARTITION BY seriesuid)),
sz AS (SELECT *, ceil(max(x + d + 10) OVER s)::INT AS nx, ceil(max(y + d + 10) OVER s)::INT AS ny, ceil(max(z + d + 10) OVER s)::INT AS nz FROM sh WINDOW s AS (PARTITION BY seriesuid)),
it AS (SELECT seriesuid, doc, trunc(d)::INT AS r, trunc(x)::INT AS x, trunc(y)::INT AS y, trunc(z)::INT AS z, nx, ny, nz FROM sz),
balls AS (SELECT DISTINCT seriesuid, doc, vx, vy, vz FROM it, range(-3, 4) a(i), range(-3, 4) b(j), range(-3, 4) c(k), LATERAL (SELECT x + i AS vx, y + j AS vy, z + k AS vz) v
  WHERE i * i + j * j + k * k < r * r AND vx BETWEEN 0 AND nx - 1 AND vy BETWEEN 0 AND ny - 1 AND vz BETWEEN 0 AND nz - 1)"""


@query(f"""WITH {BALLS} SELECT seriesuid, doc AS "DoctorID", count(*) AS voxels FROM balls GROUP BY 1, 2""")
def annotation_mask_sizes(spark, d):
    return conf.mask_sizes(nodules(spark, d), 0.1)


TABLE = f"""{BALLS}, n AS (SELECT seriesuid, doc, count(*) AS n FROM balls GROUP BY 1, 2),
pd AS (SELECT DISTINCT seriesuid, "DoctorID" AS doc FROM nodules),
cm AS (SELECT a.seriesuid, a.doc AS p, b.doc AS q, count(*) AS c FROM balls a JOIN balls b USING (seriesuid, vx, vy, vz) WHERE a.doc <> b.doc GROUP BY 1, 2, 3)"""


@query(f"""WITH {TABLE} SELECT a.doc AS doc_i, b.doc AS doc_j, {q6('avg((2 * coalesce(c, 0) + 1e-6::DOUBLE) / (coalesce(x.n, 0) + coalesce(y.n, 0) + 1e-6::DOUBLE))')} AS mean_dice, count(*) AS meetings
FROM pd a JOIN pd b ON a.seriesuid = b.seriesuid AND a.doc < b.doc LEFT JOIN n x ON x.seriesuid = a.seriesuid AND x.doc = a.doc LEFT JOIN n y ON y.seriesuid = b.seriesuid AND y.doc = b.doc
LEFT JOIN cm ON cm.seriesuid = a.seriesuid AND p = a.doc AND q = b.doc GROUP BY 1, 2""")
def doctors_pair_dice(spark, d):
    return conf.pair_table(nodules(spark, d), 0.1).select("doc_i", "doc_j", r6(F.col("mean_dice")).alias("mean_dice"), "meetings")


SCORES = f"""{TABLE}, cons AS (SELECT a.seriesuid, a.doc, b.doc AS i, c.doc AS j FROM pd a JOIN pd b ON a.seriesuid = b.seriesuid AND a.doc <> b.doc JOIN pd c ON a.seriesuid = c.seriesuid AND c.doc <> a.doc AND b.doc < c.doc),
scores AS (SELECT cons.*, ((coalesce(c1.c, 0) + coalesce(c2.c, 0)) + 1e-6::DOUBLE) / (coalesce(n0.n, 0) + (coalesce(n1.n, 0) + coalesce(n2.n, 0)) / 2.0::DOUBLE + 1e-6::DOUBLE) AS score FROM cons
  LEFT JOIN n n0 ON n0.seriesuid = cons.seriesuid AND n0.doc = cons.doc LEFT JOIN n n1 ON n1.seriesuid = cons.seriesuid AND n1.doc = i LEFT JOIN n n2 ON n2.seriesuid = cons.seriesuid AND n2.doc = j
  LEFT JOIN cm c1 ON c1.seriesuid = cons.seriesuid AND c1.p = cons.doc AND c1.q = i LEFT JOIN cm c2 ON c2.seriesuid = cons.seriesuid AND c2.p = cons.doc AND c2.q = j)"""


@query(f'WITH {SCORES} SELECT seriesuid, doc AS "DoctorID", i AS doc_i, j AS doc_j, {q6("score")} AS score FROM scores')
def consilium_dice(spark, d):
    return conf.consilium_scores(nodules(spark, d), 0.1).select("seriesuid", "DoctorID", "doc_i", "doc_j", r6(F.col("score")).alias("score"))


@query(f"""WITH RECURSIVE {SCORES.replace('FROM lineitem)', 'FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 15) >= 3))')},
met AS (SELECT a.doc AS i, b.doc AS j, count(*) AS m FROM pd a JOIN pd b ON a.seriesuid = b.seriesuid AND a.doc < b.doc GROUP BY 1, 2),
w AS (SELECT s.doc, sum(t / m) AS w, sum(t / m * score) AS s FROM scores s JOIN met USING (i, j), (SELECT sum(m)::DOUBLE AS t FROM met) GROUP BY 1),
steps AS (SELECT doc, 0 AS iteration, 0.5::DOUBLE AS confidence FROM (SELECT DISTINCT doc FROM pd) UNION ALL
  SELECT steps.doc, iteration + 1, coalesce(0.7::DOUBLE * confidence + (1 - 0.7::DOUBLE) * (confidence + s) / w, confidence) FROM steps LEFT JOIN w ON w.doc = steps.doc WHERE iteration < 5)
SELECT doc AS "DoctorID", iteration, {q6('confidence')} AS confidence FROM steps""")
def doctor_confidences(spark, d):
    return conf.doctor_confidences(nodules(spark, d), n_iters=5, factor=0.1).select("DoctorID", "iteration", r6(F.col("confidence")).alias("confidence"))


@query(f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY "DoctorID" ORDER BY iteration DESC) AS n FROM history)
SELECT "DoctorID", {q6('CASE WHEN count(*) = 5 THEN avg(confidence) END')} AS confidence FROM r WHERE n <= 5 GROUP BY 1""")
def rolling_confidence(spark, d):
    return conf.rolling_confidence(history(spark, d), 5).select("DoctorID", r6(F.col("confidence")).alias("confidence"))


@query(f"""WITH {HISTORY} SELECT "DoctorID", iteration, {q6('CASE WHEN count(*) OVER w = 32 THEN avg(confidence) OVER w END')} AS mean FROM history
WINDOW w AS (PARTITION BY "DoctorID" ORDER BY iteration ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)""")
def rolling_loss(spark, d):
    return conf.moving_mean(history(spark, d), 32, "DoctorID", "iteration", "confidence").select("DoctorID", "iteration", r6(F.col("mean")).alias("mean"))


@query(f"""WITH {HISTORY}, a AS (SELECT "DoctorID", round(avg(confidence), 9) AS confidence FROM history GROUP BY 1) SELECT "DoctorID", row_number() OVER (ORDER BY confidence DESC, "DoctorID") AS rating FROM a""")
def doctor_rating(spark, d):
    means = history(spark, d).groupBy("DoctorID").agg(F.round(F.avg("confidence"), 9).alias("confidence"))
    return conf.rating(means).select("DoctorID", "rating")


@query(f"""WITH {NODULES}, {INFO} SELECT seriesuid, "NoduleID" FROM nodules WHERE seriesuid IN (SELECT seriesuid FROM info WHERE "SpacingZ" < 1.5)""")
def nodules_of_scans(spark, d):
    """Findings of the scans at hand (a semi-join)."""
    ids = scan_info(spark, d).where("SpacingZ < 1.5").select("seriesuid")
    return nodules(spark, d).join(ids, "seriesuid", "left_semi").select("seriesuid", "NoduleID")


@query(f"""WITH {NODULES} SELECT DISTINCT seriesuid FROM nodules INTERSECT SELECT o_orderkey FROM orders""")
def common_ids(spark, d):
    return nodules(spark, d).select("seriesuid").intersect(scan_info(spark, d).select("seriesuid"))
