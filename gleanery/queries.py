"""Registered queries of the audit engine and their SQL twins.

The tables hold no photos, so the operators run on what stands in for them:
``embeddings`` as vectors and as 8 x 8 rasters, ``events`` as shots of cameras,
``documents`` and ``pages`` as file contents, ``lineitem`` as labels, ``orders``
as stored objects.  Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, AuditConfig
from .functions import boxes as bx
from .functions import markers as mk
from .functions import names as nm
from .functions import rasters as rs
from .functions import vectors as vec
from .operators import bursts, control, edits, evaluation, findings, labels, overlay, pairs, review, shift, templates
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OFFSET = 1_000_000


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, v, label)``."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), vec.doubles(F.col("embedding")).alias("v"), "label")


def copies(v: DataFrame) -> DataFrame:
    """Every tenth vector with its last three components negated."""
    return v.where("id % 10 = 0").select((F.col("id") + OFFSET).alias("id"), evaluation.edited(F.col("v"), F.lit("negated_tail")).alias("v"), "label")


def hashed(v: DataFrame) -> DataFrame:
    return v.select("id", rs.mean_hash(F.col("v")).alias("hash"))


# The tables' vectors in SQL: v(id, v, label), c (the planted copies), h(id, b) (lists of hash bits).
_V = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
c AS (SELECT id + 1000000 AS id, list_concat(v[1:61], [-x for x in v[62:64]]) AS v, label FROM v WHERE id % 10 = 0),
"""
_V = _V.replace("v[1:61]", "v[1:len(v)-3]").replace("v[62:64]", "v[len(v)-2:len(v)]")
_H = "(SELECT id, [CASE WHEN x >= list_sum(v) / len(v) THEN 1 ELSE 0 END for x in v] AS b FROM {})"
_DIST = "CAST(list_sum([abs(z[1] - z[2]) for z in list_zip(x.b, y.b)]) AS INTEGER)"


@register(f"WITH {_V} a AS (SELECT * FROM v UNION ALL SELECT * FROM c), h AS {_H.format('a')} SELECT x.id AS a, y.id AS b, {_DIST} AS distance FROM h x JOIN h y ON x.id < y.id WHERE {_DIST} <= 5")
def hash_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return pairs.hamming_join(hashed(v.union(copies(v))), None, DEFAULT.hash_distance)


@register(f"WITH {_V} hv AS {_H.format('v')}, hc AS {_H.format('c')} SELECT x.id AS a, y.id AS b, {_DIST} AS distance FROM hv x JOIN hc y ON true WHERE {_DIST} <= 5")
def hash_leak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return pairs.hamming_join(hashed(v), hashed(copies(v)), DEFAULT.hash_distance)


_COS = "list_inner_product(x.v, y.v)"


@register(f"WITH {_V} q AS (SELECT 1) SELECT x.id AS a, y.id AS b, round({_COS}, 4) AS similarity FROM v x JOIN v y ON x.id < y.id WHERE {_COS} >= 0.4")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cosine_join(vectors(spark, sf_dir), None, 0.4).withColumn("similarity", F.round("similarity", 4))


@register(f"WITH {_V} q AS (SELECT 1) SELECT x.id AS a, y.id AS b, round({_COS}, 4) AS similarity FROM v x JOIN c y ON true WHERE {_COS} >= 0.4")
def cosine_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return pairs.cosine_join(v, copies(v), 0.4).withColumn("similarity", F.round("similarity", 4))


@register(f"""WITH {_V} a AS (SELECT * FROM v UNION ALL SELECT * FROM c), h AS (SELECT x.id, x.v, y.b FROM a x JOIN {_H.format('a')} y USING (id))
SELECT x.id AS a, y.id AS b, round({_COS}, 4) AS similarity FROM h x JOIN h y ON x.id < y.id WHERE {_COS} >= 0.4 AND {_DIST} > 5""")
def similar_minus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    both = v.union(copies(v))
    near = pairs.cosine_join(both, None, 0.4)
    return pairs.minus_pairs(near, pairs.hamming_join(hashed(both), None, DEFAULT.hash_distance)).withColumn("similarity", F.round("similarity", 4))


@register(f"""WITH {_V} a AS (SELECT * FROM v UNION ALL SELECT * FROM c), h AS (SELECT x.id, x.v, y.b FROM a x JOIN {_H.format('a')} y USING (id)),
p AS (SELECT x.id AS a, y.id AS b, {_DIST} AS distance, {_COS} AS s FROM h x JOIN h y ON x.id < y.id WHERE {_DIST} <= 5)
SELECT a, b, distance FROM p WHERE (s >= 0.85 AND NOT (a % 30 = 0)) OR (a + b) % 16 >= 8""")
def confirm_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    both = v.union(copies(v))
    found = pairs.hamming_join(hashed(both), None, DEFAULT.hash_distance)
    va, vb = both.select(F.col("id").alias("a"), F.col("v").alias("va")), both.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    sims = found.join(va, "a").join(vb, "b").select("a", "b", vec.dot(F.col("va"), F.col("vb")).alias("similarity"))
    points = found.select("a", "b", ((F.col("a") + F.col("b")) % 16).alias("points"), (F.col("a") % 30 == 0).alias("fixed_camera"))
    return pairs.confirm_hash_pairs(found, sims, points, DEFAULT.confirm_similarity, DEFAULT.confirm_points)


# -- capture bursts ---------------------------------------------------------------------------------------------------

_RUNS = """t AS (SELECT user_id AS camera, epoch_us(ts) AS taken_us, event_id AS file, event_type = 'view' AS is_test FROM events),
l AS (SELECT *, CASE WHEN taken_us - lag(taken_us) OVER w <= 600000000 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY camera ORDER BY taken_us, file)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY camera ORDER BY taken_us, file ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM l)"""
_GROUP = """camera, run, string_agg(CAST(file AS VARCHAR), ',' ORDER BY taken_us, file) AS files, count(*) AS n, round((max(taken_us) - min(taken_us)) / 1e6, 1) AS span"""
BURSTS = AuditConfig(burst_gap_seconds=600.0)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("camera"), F.unix_micros(F.col("ts").cast("timestamp")).alias("taken_us"), F.col("event_id").alias("file"), (F.col("event_type") == "view").alias("is_test"))


def _joined(files: str) -> Column:
    return F.array_join(F.transform(files, lambda x: x.cast("string")), ",")


@register(f"WITH {_RUNS} SELECT {_GROUP} FROM r GROUP BY camera, run HAVING count(*) >= 2")
def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.find_bursts(shots(spark, sf_dir), config=BURSTS).select("camera", "run", _joined("files").alias("files"), "n", "span")


@register(f"WITH {_RUNS}, g AS (SELECT {_GROUP} FROM r GROUP BY camera, run HAVING count(*) >= 2) SELECT * FROM g ORDER BY n DESC, camera, run LIMIT 20")
def burst_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.find_bursts(shots(spark, sf_dir), config=BURSTS, limit=BURSTS.burst_groups).select("camera", "run", _joined("files").alias("files"), "n", "span")


@register(f"""WITH {_RUNS} SELECT camera, run, string_agg(CAST(file AS VARCHAR), ',' ORDER BY taken_us, file) FILTER (is_test) AS test_files, count(*) AS n
FROM r GROUP BY camera, run HAVING count(*) >= 2 AND count(*) FILTER (is_test) BETWEEN 1 AND count(*) - 1""")
def burst_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bursts.find_bursts(shots(spark, sf_dir), config=BURSTS)
    return g.where((F.size("test_files") > 0) & (F.size("test_files") < F.col("n"))).select("camera", "run", _joined("test_files").alias("test_files"), "n")


@register(f"""WITH {_RUNS}, k AS (SELECT x.file AS a, y.file AS b FROM t x JOIN t y ON x.camera = y.camera AND x.file < y.file AND abs(x.taken_us - y.taken_us) <= 300000000),
g AS (SELECT {_GROUP} FROM r GROUP BY camera, run HAVING count(*) >= 2),
i AS (SELECT x.camera, x.run, count(*) AS c FROM k JOIN r x ON k.a = x.file JOIN r y ON k.b = y.file WHERE x.camera = y.camera AND x.run = y.run GROUP BY 1, 2)
SELECT g.* FROM g LEFT JOIN i USING (camera, run) WHERE 2 * coalesce(c, 0) < n * (n - 1)""")
def burst_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    # Pairs within five minutes: each shot meets those of its own and the next five-minute slot.
    slot = F.floor(F.col("taken_us") / 300_000_000)
    x = s.select("camera", slot.alias("slot"), F.col("file").alias("fx"), F.col("taken_us").alias("tx"))
    y = s.select("camera", F.explode(F.array(slot - 1, slot)).alias("slot"), F.col("file").alias("fy"), F.col("taken_us").alias("ty"), slot.alias("own"))
    near = x.join(y, ["camera", "slot"]).where((F.abs(F.col("tx") - F.col("ty")) <= 300_000_000) & ((F.col("own") > F.col("slot")) | (F.col("fx") < F.col("fy"))))
    known = near.select(F.col("fx").alias("a"), F.col("fy").alias("b"))
    return bursts.find_bursts(s, known, BURSTS).select("camera", "run", _joined("files").alias("files"), "n", "span")


# -- rasters ----------------------------------------------------------------------------------------------------------

_PX = """px AS (SELECT id, i AS p, i // 8 AS y, i % 8 AS x, v[i + 1] * 1000 AS g FROM (SELECT id, v, unnest(range(64)) AS i FROM v)),
ras AS (SELECT id, list(g ORDER BY p) AS g FROM px GROUP BY id),
rf AS (SELECT px.*, ras.g AS a, CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS u, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS d, CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS l, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS r FROM px JOIN ras USING (id)),
lap AS (SELECT id, p, a[u*8+x+1] + a[d*8+x+1] + a[y*8+l+1] + a[y*8+r+1] - 4 * g AS e FROM rf),
sob AS (SELECT id, p, (a[u*8+r+1] + 2*a[y*8+r+1] + a[d*8+r+1] - a[u*8+l+1] - 2*a[y*8+l+1] - a[d*8+l+1]) / 4 AS gx, (a[d*8+l+1] + 2*a[d*8+x+1] + a[d*8+r+1] - a[u*8+l+1] - 2*a[u*8+x+1] - a[u*8+r+1]) / 4 AS gy FROM rf)"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.transform("v", lambda x: x * 1000).alias("g"), "label")


@register(f"WITH {_V} {_PX} SELECT id, round(var_pop(e), 2) AS sharpness FROM lap GROUP BY id")
def laplacian_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("id", F.round(rs.sharpness(F.col("g"), 8, 8), 2).alias("sharpness"))


@register(f"WITH {_V} {_PX} SELECT id, round(var_pop(e), 1) AS sharpness FROM lap GROUP BY id HAVING var_pop(e) <= 280000")
def blurry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rasters(spark, sf_dir).select("id", rs.sharpness(F.col("g"), 8, 8).alias("sharpness"))
    return s.where("sharpness <= 280000").withColumn("sharpness", F.round("sharpness", 1))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(rasters(spark, sf_dir))


def edges_of(r: DataFrame) -> DataFrame:
    quarter = lambda taps: [(dy, dx, w / 4) for dy, dx, w in taps]
    both = r.select("id", (F.col("label") % 2).alias("shape"), rs.stencil(F.col("g"), 8, 8, quarter(rs.SOBEL_X)).alias("gx"), rs.stencil(F.col("g"), 8, 8, quarter(rs.SOBEL_Y)).alias("gy"))
    return both.select("id", "shape", F.posexplode(F.arrays_zip("gx", "gy")).alias("place", "e")).select("id", "shape", "place", "e.gx", "e.gy")


_VOTES = """sh AS (SELECT sob.*, label % 2 AS shape FROM sob JOIN v USING (id)),
vt AS (SELECT shape, p AS place, avg(CASE WHEN gx >= 60 THEN 1.0 ELSE 0.0 END) AS ux, avg(CASE WHEN gx <= -60 THEN 1.0 ELSE 0.0 END) AS dx, avg(CASE WHEN gy >= 60 THEN 1.0 ELSE 0.0 END) AS uy, avg(CASE WHEN gy <= -60 THEN 1.0 ELSE 0.0 END) AS dy FROM sh GROUP BY 1, 2),
vo AS (SELECT shape, place, greatest(ux, dx) >= greatest(uy, dy) AS use_x, greatest(greatest(ux, dx), greatest(uy, dy)) AS agree,
  CASE WHEN greatest(ux, dx) >= greatest(uy, dy) THEN CASE WHEN ux >= dx THEN 1.0 ELSE -1.0 END ELSE CASE WHEN uy >= dy THEN 1.0 ELSE -1.0 END END AS sign FROM vt)"""


@register(f"WITH {_V} {_PX}, {_VOTES} SELECT shape, CAST(place AS INTEGER) AS place, round(agree, 4) AS agree, CAST(sign AS INTEGER) AS sign, use_x FROM vo")
def overlay_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = overlay.votes(edges(spark, sf_dir), 60.0)
    return v.select("shape", "place", F.round("agree", 4).alias("agree"), F.col("sign").cast("int").alias("sign"), "use_x")


@register(f"""WITH {_V} {_PX}, {_VOTES}, pat AS (SELECT * FROM vo WHERE agree >= 0.36),
m AS (SELECT s.shape, s.id, avg(CASE WHEN (CASE WHEN use_x THEN gx ELSE gy END) * sign >= 30 THEN 1.0 ELSE 0.0 END) AS share FROM sh s JOIN pat ON s.shape = pat.shape AND s.p = pat.place GROUP BY 1, 2)
SELECT shape, id, round(share, 4) AS share FROM m WHERE share >= 0.7""")
def overlay_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    config = AuditConfig(overlay_edge=60.0)
    m = overlay.members(e, overlay.votes(e, config.overlay_edge).where("agree >= 0.36"), config)
    return m.select("shape", "id", F.round("share", 4).alias("share"))


@register("""WITH s AS (SELECT label AS shape, vec_id AS id, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
k AS (SELECT unnest(range(20)) AS k)
SELECT DISTINCT shape, id FROM s LEFT JOIN k ON n > 20 AND floor(k * (n - 1) / 19) = r WHERE n <= 20 OR k IS NOT NULL""")
def overlay_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.even_sample(vectors(spark, sf_dir).select(F.col("label").alias("shape"), "id"), 20)


@register(f"""WITH {_V} q AS (SELECT id, [v[(i // 8) * 8 + (7 - i % 8) + 1] for i in range(64)] AS f, v FROM v), s AS (SELECT id, [z[1] + z[2] for z in list_zip(v, f)] AS s FROM q)
SELECT id, round(s[1] / sqrt(list_inner_product(s, s)), 4) AS first, round(s[20] / sqrt(list_inner_product(s, s)), 4) AS twentieth FROM s""")
def mirror_invariant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", vec.mirror_invariant(F.col("v"), vec.mirrored(F.col("v"), 8)).alias("m"))
    return v.select("id", F.round(F.get("m", F.lit(0)), 4).alias("first"), F.round(F.get("m", F.lit(19)), 4).alias("twentieth"))


@register(f"""WITH {_V} p AS (SELECT x.id AS a, y.id AS b, x.v AS xv, y.v AS yv FROM v x JOIN v y ON y.id = x.id + 1), s AS (SELECT a, b, list_sum([CASE WHEN abs(z[1] - z[2]) > 0.025 THEN 1.0 ELSE 0.0 END for z in list_zip(xv, yv)]) / len(xv) AS share FROM p)
SELECT a, b, round(share, 4) AS share, share BETWEEN 0.001 AND 0.8 AS plausible FROM s""")
def changed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "v")
    p = v.toDF("a", "x").join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("v").alias("y")), "a")
    s = p.select("a", "b", rs.changed_share(F.col("x"), F.col("y"), 0.025).alias("share"))
    return s.select("a", "b", F.round("share", 4).alias("share"), F.col("share").between(0.001, 0.8).alias("plausible"))


# -- distribution shift -----------------------------------------------------------------------------------------------


@register(f"""WITH {_V} d AS (SELECT unnest(range(1, 65)) AS d), m AS (SELECT d, avg(v[d]) FILTER (label < 7) AS a, avg(v[d]) FILTER (label >= 7) AS b FROM v, d GROUP BY d)
SELECT round(sum((a - b) * (a - b)), 6) AS distance FROM m""")
def shift_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("d", "x"))
    m = each.groupBy("d").agg(F.avg(F.when(F.col("label") < 7, F.col("x"))).alias("a"), F.avg(F.when(F.col("label") >= 7, F.col("x"))).alias("b"))
    return m.agg(F.round(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))), 6).alias("distance"))


@register(f"""WITH {_V} s AS ((SELECT id, v, 0 AS t FROM v WHERE label < 7 ORDER BY md5('train#' || id), id LIMIT 200) UNION ALL (SELECT id, v, 1 AS t FROM v WHERE label >= 7 ORDER BY md5('test#' || id), id LIMIT 200)),
cn AS (SELECT count(*) AS n, sum(t) AS m FROM s), d AS (SELECT unnest(range(1, 65)) AS d), tot AS (SELECT d, sum(v[d]) AS total FROM s, d GROUP BY d),
k AS (SELECT p, id, v, row_number() OVER (PARTITION BY p ORDER BY md5(p || '#' || id), id) AS k FROM s, (SELECT unnest(range(1, 2001)) AS p)),
ch AS (SELECT p, v FROM k, cn WHERE k <= m UNION ALL SELECT 0 AS p, v FROM s WHERE t = 1),
g AS (SELECT p, round(sum(pow(x / m - (total - x) / (n - m), 2)), 6) AS gap FROM (SELECT p, d, sum(v[d]) AS x FROM ch, d GROUP BY p, d) JOIN tot USING (d), cn GROUP BY p),
o AS (SELECT gap AS distance FROM g WHERE p = 0)
SELECT round(max(distance), 4) AS distance, round((1 + count(*) FILTER (gap >= distance)) / 2001.0, 4) AS p_value FROM g, o WHERE p > 0""")
def shift_pvalue_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    n = DEFAULT.shift_sample
    train, test = shift.sampled(v.where("label < 7"), n, "train#"), shift.sampled(v.where("label >= 7"), n, "test#")
    return shift.permutation_test(train, test, DEFAULT.shift_permutations)


@register(f"WITH {_V} m AS (SELECT y.id, max({_COS}) AS closest FROM v x JOIN v y ON x.label < 7 AND y.label >= 7 GROUP BY y.id) SELECT id, round(closest, 3) AS closest FROM m ORDER BY round(closest, 3), id LIMIT 3")
def shift_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return shift.outliers(v.where("label < 7"), v.where("label >= 7"), DEFAULT.shift_outliers)


# -- labels -----------------------------------------------------------------------------------------------------------

_LINE = """CASE WHEN l_linenumber = 7 THEN 'x ' || CAST(l_orderkey % 10 AS VARCHAR) WHEN l_linenumber = 6 THEN CAST(l_partkey % 3 AS VARCHAR) || ' 0.1 0.1 0.4 0.1 0.4 0.5'
WHEN l_linenumber = 5 THEN CASE WHEN l_orderkey % 2 = 0 THEN '-1' ELSE '-0.5' END || ' 0.5 0.5 0.2 0.2' ELSE CAST(l_partkey % 3 AS VARCHAR) || ' ' || CAST(l_suppkey % 10 / 10 AS VARCHAR) || ' 0.5 ' || CAST(l_partkey % 5 / 10 AS VARCHAR) || ' 0.25' END"""


def yolo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file for each order: a line for each of its items."""
    li = read(spark, sf_dir, "lineitem")
    text = F.expr(_LINE.replace("AS VARCHAR", "AS STRING"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")))).alias("all"))
    return lines.select(F.col("l_orderkey").cast("string").alias("file"), F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("text"))


_YOLO = f"""ln AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, {_LINE} AS t FROM lineitem),
ps AS (SELECT file, line, string_split(t, ' ') AS s FROM ln), vs AS (SELECT file, line, [TRY_CAST(x AS DOUBLE) for x in s] AS v, len(s) AS n FROM ps),
gd AS (SELECT *, list_count(v) = n AND v[1] > -1 AND (n IN (5, 6) OR (n >= 7 AND n % 2 = 1)) AS good FROM vs),
yo AS (SELECT file, line, CASE WHEN good THEN CAST(trunc(v[1]) AS BIGINT) END AS cls,
 CASE WHEN good THEN CASE WHEN n <= 6 THEN v[2] - v[4] / 2 ELSE least(v[2], v[4], v[6]) END END AS x1, CASE WHEN good THEN CASE WHEN n <= 6 THEN v[3] - v[5] / 2 ELSE least(v[3], v[5], v[7]) END END AS y1,
 CASE WHEN good THEN CASE WHEN n <= 6 THEN v[2] + v[4] / 2 ELSE greatest(v[2], v[4], v[6]) END END AS x2, CASE WHEN good THEN CASE WHEN n <= 6 THEN v[3] + v[5] / 2 ELSE greatest(v[3], v[5], v[7]) END END AS y2,
 NOT good AS malformed FROM gd),
bo AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS box_no FROM yo WHERE NOT malformed)"""
_IOU = """CASE WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) <= 0 OR least(a.y2, b.y2) - greatest(a.y1, b.y1) <= 0 THEN 0 ELSE
 (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) END"""


@register(f"WITH {_YOLO} SELECT file, line, CAST(cls AS VARCHAR) AS cls, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, malformed FROM yo")
def yolo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labels.parse_yolo(yolo_files(spark, sf_dir))
    return p.select("file", "line", F.col("cls").cast("string").alias("cls"), *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")], "malformed")


@register(f"WITH {_YOLO} SELECT file, count(*) AS bad, min(line) AS first_bad FROM yo WHERE malformed GROUP BY file")
def yolo_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.malformed_lines(labels.parse_yolo(yolo_files(spark, sf_dir)))


def _yolo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labels.parse_yolo(yolo_files(spark, sf_dir)).where("not malformed")
    return p.select("file", F.col("file").alias("photo"), "box_no", F.col("cls").cast("string").alias("cls"), "x1", "y1", "x2", "y2", F.lit(640).alias("fw"), F.lit(480).alias("fh"))


_EMPTY = "(x2 - x1 < 1e-9 OR y2 - y1 < 1e-9 OR (x2 - x1) * 640 < 1 OR (y2 - y1) * 480 < 1)"


@register(f"""WITH {_YOLO}, e AS (SELECT *, {_EMPTY} AS is_empty FROM bo),
rp AS (SELECT DISTINCT a.file, a.box_no FROM e a JOIN e b ON a.file = b.file AND a.cls = b.cls AND b.box_no < a.box_no AND NOT a.is_empty AND NOT b.is_empty WHERE {_IOU} >= 0.95)
SELECT e.file AS photo, count(*) AS total, count(*) FILTER (NOT is_empty AND (least(x1, y1) < -0.01 OR greatest(x2, y2) > 1.01)) AS outside, count(*) FILTER (is_empty) AS empty, count(rp.box_no) AS repeated
FROM e LEFT JOIN rp USING (file, box_no) GROUP BY e.file""")
def yolo_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.box_problems(_yolo_boxes(spark, sf_dir)).select("photo", "total", "outside", "empty", "repeated")


@register(f"""WITH {_YOLO}, e AS (SELECT *, {_EMPTY} AS is_empty FROM bo) SELECT DISTINCT a.file, a.box_no FROM e a JOIN e b ON a.file = b.file AND a.cls = b.cls AND b.box_no < a.box_no AND NOT a.is_empty AND NOT b.is_empty WHERE {_IOU} >= 0.95""")
def iou_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _yolo_boxes(spark, sf_dir)
    solid = (F.col("x2") - F.col("x1") >= 1 / 640) & (F.col("y2") - F.col("y1") >= 1 / 480)
    return labels.repeated_boxes(b.where(solid)).select("file", "box_no")


@register(f"""WITH {_YOLO}, e AS (SELECT *, {_EMPTY} AS is_empty FROM bo),
rp AS (SELECT DISTINCT a.file, a.box_no FROM e a JOIN e b ON a.file = b.file AND a.cls = b.cls AND b.box_no < a.box_no AND NOT a.is_empty AND NOT b.is_empty WHERE {_IOU} >= 0.95),
c AS (SELECT e.file AS photo, count(*) AS total, count(*) FILTER (NOT is_empty AND (least(x1, y1) < -0.01 OR greatest(x2, y2) > 1.01)) AS outside, count(*) FILTER (is_empty) AS empty, count(rp.box_no) AS repeated FROM e LEFT JOIN rp USING (file, box_no) GROUP BY e.file)
SELECT photo AS subject, 'outside' AS kind, outside || ' of ' || total || ' boxes extend outside the photo' AS detail FROM c WHERE outside > 0
UNION ALL SELECT photo, 'empty', empty || ' of ' || total || ' boxes have no area' FROM c WHERE empty > 0
UNION ALL SELECT photo, 'repeated', repeated || ' of ' || total || ' boxes repeat another box (same class, same place)' FROM c WHERE repeated > 0""")
def label_problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.problem_rows(labels.box_problems(_yolo_boxes(spark, sf_dir)))


@register("""SELECT CAST(c_custkey AS VARCHAR) AS image_id, 'p' || c_custkey || '.jpg' AS file_name, CAST(count(o_orderkey) AS INTEGER) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS x_total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def coco_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One JSON file a nation and market segment, whose boxes are the orders.
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    file = F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("file")
    image = F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("file_name"))
    note = F.struct(F.col("o_custkey").alias("image_id"), F.lit(1).alias("category_id"), F.array(F.col("o_totalprice"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"))
    images = c.groupBy(file).agg(F.collect_list(image).alias("images"))
    notes = o.join(c, o.o_custkey == c.c_custkey).groupBy(file).agg(F.collect_list(note).alias("annotations"))
    told = images.join(notes, "file", "left").withColumn("annotations", F.coalesce("annotations", F.array()))
    files = told.select("file", F.to_json(F.struct("images", "annotations")).alias("text"))
    parsed = labels.parse_coco(files)
    total = F.aggregate(F.coalesce("boxes", F.array()), F.lit(0.0), lambda acc, b: acc + b["x1"])
    return parsed.select("image_id", "file_name", F.size(F.coalesce("boxes", F.array())).alias("n"), F.round(total, 2).alias("x_total"))


@register("SELECT CAST(doc_id AS VARCHAR) || '.txt' AS subject, 'orphan' AS kind, 'no photo has this label file''s name' AS detail FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en' GROUP BY doc_id HAVING count(*) = 1) USING (doc_id)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.lit(None).cast("string").alias("file_name"))
    photos = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("photo"))
    return labels.orphans(labels.photo_for(files, photos))


@register("SELECT CAST(doc_id AS VARCHAR) || '.jpg' AS subject, 'missing' AS kind, 'no label for this photo (fine if it has nothing to label)' AS detail FROM documents ANTI JOIN labels USING (doc_id) WHERE EXISTS (SELECT 1 FROM labels) ORDER BY 1 LIMIT 10")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    photo = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("photo")
    return labels.missing_labels(read(spark, sf_dir, "documents").select(photo), read(spark, sf_dir, "labels").select(photo))


_SIZE = "p_partkey AS photo, p_size AS dw, p_size + p_partkey % 3 AS dh, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + p_partkey % 3 END AS aw, CASE WHEN p_partkey % 2 = 0 THEN p_size + p_partkey % 3 ELSE p_size END AS ah, CAST(1 + p_partkey % 8 AS INTEGER) AS orientation"


@register(f"""WITH s AS (SELECT {_SIZE} FROM part), d AS (SELECT *, CASE WHEN dw = aw AND dh = ah THEN NULL
 WHEN dw = ah AND dh = aw AND orientation >= 5 THEN format('the labels are for the rotated photo ({{}}x{{}}) but the file stores it as {{}}x{{}} with an EXIF rotation tag ({{}}); any tool that ignores the tag puts every box in the wrong place', dw, dh, aw, ah, orientation)
 WHEN dw = ah AND dh = aw THEN format('the labels say {{}}x{{}} but the photo is {{}}x{{}}: width and height look swapped', dw, dh, aw, ah)
 ELSE format('the labels say {{}}x{{}} but the photo is {{}}x{{}}: was it resized after labeling?', dw, dh, aw, ah) END AS detail FROM s WHERE least(dw, dh) > 0)
SELECT photo AS subject, 'size' AS kind, detail FROM d WHERE detail IS NOT NULL""")
def size_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.size_problems(read(spark, sf_dir, "part").selectExpr(*[c.strip() for c in _SIZE.replace("CAST(1 + p_partkey % 8 AS INTEGER)", "int(1 + p_partkey % 8)").split(",")]))


@register("""SELECT p_partkey AS photo, CAST(round_even(ln((200 + p_size) / CAST(100 + p_partkey % 300 AS DOUBLE)) / 0.05, 0) AS INTEGER) AS key FROM part""")
def shape_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("photo"), bx.shape_key((200 + F.col("p_size")).cast("double"), (100 + F.col("p_partkey") % 300).cast("double")).alias("key"))


@register("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 - 0.2 AS p, l_tax * 10 AS q FROM lineitem), c AS (SELECT *, least(greatest(least(p, q), 0), 1) AS lo, least(greatest(greatest(p, q), 0), 1) AS hi FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN hi - lo >= 0.05 THEN lo ELSE least(greatest((lo + hi - 0.05) / 2, 0), 0.95) END, 6) AS x1,
 round(CASE WHEN hi - lo >= 0.05 THEN hi ELSE least(greatest((lo + hi - 0.05) / 2, 0), 0.95) + 0.05 END, 6) AS x2 FROM c""")
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    p, q = F.col("l_discount") * 10 - 0.2, F.col("l_tax") * 10
    b = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bx.clamped(F.struct(p.alias("x1"), p.alias("y1"), q.alias("x2"), q.alias("y2"))).alias("b"))
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("b.x1", 6).alias("x1"), F.round("b.x2", 6).alias("x2"))


# -- provenance -------------------------------------------------------------------------------------------------------

NEEDLES = (("apache license", "Apache"), ("mit license", "MIT"), ("license", "other licence"), ("@mail", "mail"), ("secret", "secret"), ("href", "link"))
_FIRST = "CASE " + " ".join(f"WHEN contains(t, '{n}') THEN '{label}'" for n, label in NEEDLES) + " END"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _marker_sql(markers) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{n}') THEN '{label}'" for n, label in markers) + " END"


@register(f"SELECT doc_id, {_FIRST} AS marker FROM (SELECT doc_id, {_LOWER.format('text')} AS t FROM documents) WHERE {_FIRST} IS NOT NULL")
def marker_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", mk.first_marker(mk.ascii_lower(F.col("text")), NEEDLES).alias("marker"))
    return d.where("marker is not null")


@register(f"""WITH p AS (SELECT page_id, {_LOWER.format("html || CASE page_id % 7 WHEN 0 THEN ' Steps: 20, Sampler: Euler' WHEN 1 THEN ' MidJourney v6' WHEN 2 THEN ' credit: Getty Images' WHEN 3 THEN ' NovelAI via Alamy' ELSE '' END")} AS t FROM pages)
SELECT page_id, coalesce({_marker_sql(mk.AI_MARKERS)}, CASE WHEN regexp_matches(t, 'steps: [0-9]+, sampler: ') THEN 'Stable Diffusion settings (Steps, Sampler)' END, CASE WHEN contains(t, '"class_type"') AND contains(t, '"inputs"') THEN 'ComfyUI workflow' END) AS ai, {_marker_sql(mk.STOCK_MARKERS)} AS stock FROM p""")
def provenance_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.expr("CASE page_id % 7 WHEN 0 THEN ' Steps: 20, Sampler: Euler' WHEN 1 THEN ' MidJourney v6' WHEN 2 THEN ' credit: Getty Images' WHEN 3 THEN ' NovelAI via Alamy' ELSE '' END")
    t = mk.ascii_lower(F.concat("html", tails))
    return read(spark, sf_dir, "pages").select("page_id", mk.ai_marker(t).alias("ai"), mk.stock_marker(t).alias("stock"))


# -- templates --------------------------------------------------------------------------------------------------------

_PAIRS = "pr AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_REFS = """pl AS (SELECT vec_id AS ref, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings),
dr AS (SELECT a, b, k, (CAST('0x' || substr(md5(a || '|' || b), 1, 12) AS BIGINT) + k) % (SELECT max(n) FROM pl) AS place FROM pr, (SELECT unnest(range(42)) AS k)),
rf AS (SELECT a, b, ref, row_number() OVER (PARTITION BY a, b ORDER BY k) AS r FROM dr JOIN pl USING (place) WHERE ref <> a AND ref <> b QUALIFY r <= 40)"""


def _template_pairs(v: DataFrame) -> DataFrame:
    return v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b")).join(v.select(F.col("id").alias("a")), "a", "left_semi")


@register(f"WITH {_PAIRS}, {_REFS} SELECT a, b, ref FROM rf")
def reference_sample_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return templates.reference_sample(_template_pairs(v), v.select("id"), DEFAULT.template_references)


_NEAR = "round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, y.v)]), 9)"


@register(f"""WITH {_V} n AS (SELECT x.id AS q, y.id, {_NEAR} AS d FROM v x JOIN v y ON x.id % 5 = 0 AND y.id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM n)
SELECT q, max(d) FILTER (r = 1) < 0.75 * max(d) FILTER (r = 2) AS matched FROM r WHERE r <= 2 GROUP BY q""")
def knn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "v")
    return templates.ratio_matches(pairs.nearest(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 2), DEFAULT.ratio)


@register(f"WITH {_V} n AS (SELECT x.id AS q, y.id, {_NEAR} AS d FROM v x JOIN v y ON x.id <> y.id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM n) SELECT q, id, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 3")
def top3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.other_nearest(vectors(spark, sf_dir).select("id", "v"), 3).select("q", "id", "rank")


@register(f"""WITH {_PAIRS}, {_REFS}, m AS (SELECT a, b, k, ref, (a + b + k * 7 + ref * 3) % 11 = 0 AS matched FROM rf, (SELECT unnest(range(30)) AS k)),
s AS (SELECT a, b, k, count(*) FILTER (matched) AS seen FROM m GROUP BY a, b, k), d AS (SELECT a, b, count(*) FILTER (seen < 3) AS "distinct" FROM s GROUP BY a, b) SELECT a, b, "distinct", "distinct" >= 20 AS kept FROM d""")
def distinct_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    refs = templates.reference_sample(_template_pairs(v), v.select("id"), DEFAULT.template_references)
    m = refs.select("a", "b", "ref", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("keypoint"))
    m = m.withColumn("matched", (F.col("a") + F.col("b") + F.col("keypoint") * 7 + F.col("ref") * 3) % 11 == 0)
    return templates.distinct_inliers(m).withColumn("kept", F.col("distinct") >= DEFAULT.least_distinct)


# -- findings and decisions -------------------------------------------------------------------------------------------

_FINDINGS = """f AS (
 SELECT 0 AS type_rank, 'train_test_leak' AS type, o_orderkey AS seq, [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)] AS files, CAST(NULL AS BIGINT) AS matching_keypoints, CAST(NULL AS DOUBLE) AS coverage FROM orders WHERE o_orderkey % 1500 = 1
 UNION ALL SELECT 1, 'train_test_leak_edited_copy', o_orderkey, [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)], 25 + o_custkey % 20, (o_custkey % 100) / 100.0 FROM orders WHERE o_orderkey % 1000 = 2
 UNION ALL SELECT 3, 'edited_copy', o_orderkey, [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)], 25 + o_custkey % 20, (o_custkey % 100) / 100.0 FROM orders WHERE o_orderkey % 700 = 3
 UNION ALL SELECT 4, 'blurry', o_orderkey, [CAST(o_orderkey AS VARCHAR)], NULL, NULL FROM orders WHERE o_orderkey % 900 = 4)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    two = F.array(key.cast("string"), cust.cast("string")).alias("files")
    points, cover = (25 + cust % 20).alias("matching_keypoints"), ((cust % 100) / 100.0).alias("coverage")
    return findings.findings({
        "train_test_leak": o.where(key % 1500 == 1).select(key.alias("seq"), two),
        "train_test_leak_edited_copy": o.where(key % 1000 == 2).select(key.alias("seq"), two, points, cover),
        "edited_copy": o.where(key % 700 == 3).select(key.alias("seq"), two, points, cover),
        "blurry": o.where(key % 900 == 4).select(key.alias("seq"), F.array(key.cast("string")).alias("files")),
    })


_LISTED = "array_to_string(files, ',') AS files"


@register(f"WITH {_FINDINGS} SELECT type, seq, {_LISTED}, CAST(row_number() OVER (ORDER BY type_rank, seq) - 1 AS INTEGER) AS finding, (SELECT count(*) FROM f) > 30 AS truncated FROM f ORDER BY type_rank, seq LIMIT 30")
def findings_union_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.capped(_findings(spark, sf_dir)).select("type", "seq", F.array_join("files", ",").alias("files"), "finding", "truncated")


_GATE = """SELECT type, seq, matching_keypoints FROM f WHERE type IN ('train_test_leak_edited_copy', 'edited_copy') AND (matching_keypoints < 35 OR coverage < 0.25) {} ORDER BY type <> 'train_test_leak_edited_copy', matching_keypoints, type_rank, seq LIMIT 2"""


@register(f"WITH {_FINDINGS} {_GATE.format('')}")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = AuditConfig(review_if_at_most=1_000_000_000)
    return findings.for_review(_findings(spark, sf_dir), config).select("type", "seq", "matching_keypoints")


@register(f"WITH {_FINDINGS} {_GATE.format('AND (SELECT count(*) FROM f) <= 8')}")
def review_gate_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.for_review(_findings(spark, sf_dir)).select("type", "seq", "matching_keypoints")


# A rule's reviewer and what it decides, on the capped findings: pairs of one removal target each, but for those under review.
_SHOWN = f"""WITH {_FINDINGS}, s AS (SELECT * FROM f ORDER BY type_rank, seq LIMIT 30),
rp AS (SELECT * FROM s WHERE type IN ('train_test_leak_edited_copy', 'edited_copy') AND (matching_keypoints < 35 OR coverage < 0.25) ORDER BY type <> 'train_test_leak_edited_copy', matching_keypoints, type_rank, seq LIMIT 2),
rv AS (SELECT file, file IN (SELECT CASE WHEN type_rank <= 1 THEN files[1] ELSE files[2] END FROM rp) AS gone FROM (SELECT DISTINCT unnest(files) AS file FROM rp)),
tg AS (SELECT CASE WHEN type_rank <= 1 THEN files[1] ELSE files[2] END AS file, min(type) AS type FROM s WHERE len(files) = 2 GROUP BY 1)"""


@register(f"""{_SHOWN} SELECT file, CASE WHEN gone THEN 'quarantine' ELSE 'keep' END AS action FROM rv UNION ALL SELECT file, 'quarantine' FROM tg WHERE file NOT IN (SELECT file FROM rv)""")
def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = AuditConfig(review_if_at_most=30)
    return review.decide(_findings(spark, sf_dir), review.RuleReviewer(config), config).select("file", "action")


@register("""WITH r AS (SELECT o_orderkey AS seq, 'pair' || (o_custkey % 900) AS pair, CASE o_orderkey % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'b' ELSE 'a' END AS image, o_orderkey % 7 <> 0 AS boxed FROM orders),
k AS (SELECT *, CAST(substr(pair, 5) AS BIGINT) < 600 AS known FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY pair, known ORDER BY seq) AS nth FROM k)
SELECT seq, pair, CASE WHEN NOT known THEN 'unknown pair' WHEN nth > 2 THEN 'no zooms left' WHEN image = 'c' OR NOT boxed THEN 'invalid request' END AS error, CASE WHEN known AND nth <= 2 AND image <> 'c' AND boxed THEN 0.3 END AS x2 FROM n""")
def zoom_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    box = F.when(key % 7 != 0, F.struct(F.lit(0.3).alias("x1"), F.lit(0.9).alias("y1"), F.lit(-2.0).alias("x2"), F.lit(0.1).alias("y2")))
    image = F.when(key % 5 == 0, "c").when(key % 5 == 1, "b").otherwise("a")
    asked = o.select(key.alias("seq"), F.concat(F.lit("pair"), (F.col("o_custkey") % 900).cast("string")).alias("pair"), image.alias("image"), box.alias("box"))
    known = spark.range(600).select(F.concat(F.lit("pair"), F.col("id").cast("string")).alias("pair"))
    return review.granted_zooms(asked, known).select("seq", "pair", "error", F.round("region.x2", 6).alias("x2"))


@register(f"WITH {_FINDINGS} SELECT type, seq, CASE WHEN type_rank <= 1 THEN files[1] ELSE files[2] END AS target FROM f WHERE type_rank < 4")
def removal_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.removal_targets(_findings(spark, sf_dir).where("type_rank < 4")).select("type", "seq", "target")


@register(f"WITH {_FINDINGS}, u AS (SELECT DISTINCT unnest(files) AS file FROM (SELECT files FROM f ORDER BY type_rank, seq LIMIT 30)) SELECT file, 'img' || (row_number() OVER (ORDER BY file) - 1) AS image FROM u")
def photo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.photo_ids(findings.capped(_findings(spark, sf_dir)))


@register("""WITH p AS (SELECT o_orderkey AS pair_no, 'f' || o_custkey AS a, 'g' || (o_custkey % 50) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_custkey ELSE 'g' || (o_custkey % 50) END AS target,
 CASE o_orderkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'unsure' END AS v FROM orders),
s AS (SELECT pair_no, a AS file, a = target AS t, coalesce(v, 'unsure') AS v FROM p UNION ALL SELECT pair_no, b, b = target, coalesce(v, 'unsure') FROM p),
g AS (SELECT file, bool_or(t) AS q, min(pair_no) AS first_pair, min(pair_no) FILTER (t) AS first_target, max(pair_no) FILTER (t AND v = 'same') AS last_same FROM s GROUP BY file)
SELECT g.file, CASE WHEN q THEN 'quarantine' ELSE 'keep' END AS action, s.v AS verdict, q AND last_same IS NULL AS disputed FROM g JOIN s ON s.file = g.file AND s.pair_no = CASE WHEN NOT q THEN first_pair WHEN last_same IS NOT NULL THEN last_same ELSE first_target END""")
def verdict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    b = F.concat(F.lit("g"), (F.col("o_custkey") % 50).cast("string"))
    key = F.col("o_orderkey")
    reviewed = o.select(key.alias("pair_no"), a.alias("a"), b.alias("b"), F.when(key % 2 == 0, a).otherwise(b).alias("target"))
    verdict = F.when(key % 4 == 0, "same").when(key % 4 == 1, "different").when(key % 4 == 2, "unsure")
    verdicts = o.select(key.alias("pair_no"), verdict.alias("verdict"), F.lit("said so").alias("reason")).where("verdict is not null")
    return findings.resolve_verdicts(reviewed, verdicts).select("file", "action", "verdict", "disputed")


# -- evaluation -------------------------------------------------------------------------------------------------------


@register(f"WITH {_V} n AS (SELECT x.id AS q, x.label, y.label AS guess, row_number() OVER (PARTITION BY x.id ORDER BY {_NEAR}, y.id) AS r FROM v x JOIN v y ON x.id % 5 = 0 AND y.id % 5 <> 0) SELECT round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM n WHERE r = 1")
def knn_accuracy_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return evaluation.one_nn_accuracy(v.where("id % 5 <> 0"), v.where("id % 5 = 0"))


@register(f"WITH {_V} n AS (SELECT x.id AS q, x.label, y.label AS guess, row_number() OVER (PARTITION BY x.id ORDER BY {_NEAR}, y.id) AS r FROM v x JOIN (SELECT * FROM v WHERE id % 5 <> 0 UNION ALL SELECT * FROM c) y ON x.id % 5 = 0) SELECT round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM n WHERE r = 1")
def knn_accuracy_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return evaluation.one_nn_accuracy(v.where("id % 5 <> 0").union(copies(v)), v.where("id % 5 = 0"))


_SCORED = "sc AS (SELECT o_custkey % 60 AS inliers, (o_orderkey % 100) / 100.0 AS coverage, o_orderstatus = 'F' AS truth FROM orders)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 60).alias("inliers"), ((F.col("o_orderkey") % 100) / 100.0).alias("coverage"), (F.col("o_orderstatus") == "F").alias("truth"))


@register(f"WITH {_SCORED}, b AS (SELECT unnest([25.0, 30.0, 40.0, 50.0, 60.0, 80.0]) AS bar) SELECT CAST(bar AS DOUBLE) AS bar, count(*) FILTER (inliers >= bar AND truth) AS hits, count(*) FILTER (inliers >= bar AND NOT truth) AS others FROM b, sc GROUP BY bar")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).select(F.col("inliers").cast("double").alias("score"), "truth")
    return evaluation.threshold_sweep(s, [25, 30, 40, 50, 60, 80])


@register(f"""WITH {_SCORED}, g AS (SELECT * FROM (SELECT unnest([30, 35, 40]) AS i), (SELECT unnest([-1.0, 0.25, 0.5]) AS c))
SELECT i AS max_inliers, CASE c WHEN 0.25 THEN '0.25' WHEN 0.5 THEN '0.5' END AS max_coverage, count(*) AS reviewed, count(*) FILTER (NOT truth) AS false_reviewed FROM g, sc WHERE inliers < i OR coverage < c GROUP BY i, c""")
def gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.gate_grid(_scored(spark, sf_dir), [30, 35, 40], [None, 0.25, 0.5])
    text = F.when(F.col("max_coverage") == 0.25, "0.25").when(F.col("max_coverage") == 0.5, "0.5")
    return g.select("max_inliers", text.alias("max_coverage"), "reviewed", "false_reviewed")


@register(f"WITH {_SCORED} SELECT count(*) FILTER (truth AND inliers >= 25) AS tp, count(*) FILTER (truth AND inliers < 25) AS fn, count(*) FILTER (NOT truth AND inliers >= 25) AS fp, count(*) FILTER (NOT truth AND inliers < 25) AS tn FROM sc")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_scored(spark, sf_dir).select("truth", (F.col("inliers") >= 25).alias("flagged")))


@register("WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT max(x) FILTER (r = n // 4) AS q1, max(x) FILTER (r = 2 * n // 4) AS q2, max(x) FILTER (r = 3 * n // 4) AS q3 FROM s")
def quartiles_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.index_quartiles(read(spark, sf_dir, "orders"), "o_totalprice")


@register("SELECT min(o_totalprice) AS least, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, max(o_totalprice) AS greatest FROM orders")
def spread_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.spread(read(spark, sf_dir, "orders"), "o_totalprice").select("least", F.round("median", 4).alias("median"), F.round("p99", 4).alias("p99"), "greatest")


@register(f"""WITH {_V} k AS (SELECT id, CAST(floor(id / 10) AS BIGINT) % 4 AS k, v FROM v WHERE id % 10 = 0),
e AS (SELECT id + 1000000 AS id, id AS origin, ['exact', 'negated_tail', 'mirror', 'darker'][k + 1] AS kind, CASE k WHEN 1 THEN list_concat(v[1:61], [-x for x in v[62:64]]) WHEN 2 THEN [v[(i // 8) * 8 + (7 - i % 8) + 1] for i in range(64)] WHEN 3 THEN [x * 0.5 for x in v] ELSE v END AS v FROM k),
hv AS {_H.format('v')}, he AS {_H.format('e')}, f AS (SELECT x.id AS a, y.id AS b FROM hv x JOIN he y ON true WHERE {_DIST} <= 5)
SELECT kind, count(*) AS planted, count(f.a) AS found, round(count(f.a) / count(*), 4) AS recall FROM e LEFT JOIN f ON f.a = origin AND f.b = id GROUP BY kind""")
def recall_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "v")
    planted = evaluation.plant(v, 10, OFFSET)
    return evaluation.recall_by_kind(planted, pairs.hamming_join(hashed(v), hashed(planted), DEFAULT.hash_distance))


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def most_common_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.most_common(read(spark, sf_dir, "events"), "event_type", 3)


@register("""WITH b AS (SELECT p_partkey AS photo, p_size % 5 AS box_no, 0.1 AS x1, 0.1 AS y1, p_size / 100.0 AS x2, 0.6 AS y2 FROM part), k AS (SELECT l_partkey AS photo, l_discount * 5 AS x, l_tax * 10 AS y FROM lineitem)
SELECT photo, box_no, count(*) FILTER (x >= x1 AND x <= x2 AND y >= y1 AND y <= y2) AS inside FROM b LEFT JOIN k USING (photo) GROUP BY 1, 2""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("photo"), (F.col("p_size") % 5).alias("box_no"), F.lit(0.1).alias("x1"), F.lit(0.1).alias("y1"), (F.col("p_size") / 100.0).alias("x2"), F.lit(0.6).alias("y2"))
    k = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("photo"), (F.col("l_discount") * 5).alias("x"), (F.col("l_tax") * 10).alias("y"))
    return evaluation.points_in_boxes(k, b)


@register("SELECT CAST(sum(p_size) AS BIGINT) AS tokens_in, CAST(sum(p_partkey) AS BIGINT) AS tokens_out, round((sum(p_size) * 3.0 + sum(p_partkey) * 15.0) / 1e6, 6) AS cost FROM part")
def review_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cost(read(spark, sf_dir, "part").select(F.col("p_size").alias("tokens_in"), F.col("p_partkey").alias("tokens_out")), 3.0, 15.0)


# -- the upload service's tables --------------------------------------------------------------------------------------

_OBJECTS = "ob AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'uploads/' WHEN 1 THEN 'results/sessions/' ELSE 'saved/' END || 'o' || (o_custkey % 40) || '/s' || (o_custkey % 7) || '/' || CASE o_orderkey % 3 WHEN 0 THEN 'images' WHEN 1 THEN 'test' ELSE 'labels' END || '/' || (o_orderkey % 20) || '/p' || o_orderkey || '.jpg' AS key, o_orderdate AS modified FROM orders)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _OBJECTS[_OBJECTS.index("CASE") : _OBJECTS.index(" AS key")]
    return read(spark, sf_dir, "orders").select(F.expr(key).alias("key"), F.col("o_orderdate").alias("modified"))


@register(f"""WITH {_OBJECTS}, p AS (SELECT key, modified, string_split(key, '/') AS s FROM ob WHERE starts_with(key, 'saved/')), f AS (SELECT key, modified, s[2] AS owner, s[3] AS session, s[4] AS folder FROM p WHERE len(s) = 6 AND s[4] IN ('images', 'test'))
SELECT owner, session, count(*) AS photos, epoch_us(max(modified)) AS saved_us, array_to_string((list(key ORDER BY key) FILTER (folder = 'images'))[1:3], ',') AS previews FROM f GROUP BY 1, 2""")
def library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.library(_objects(spark, sf_dir)).select("owner", "session", "photos", F.unix_micros(F.col("saved").cast("timestamp")).alias("saved_us"), F.when(F.size("previews") > 0, F.array_join("previews", ",")).alias("previews"))


@register("WITH l AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey % 30 AS session FROM orders) SELECT day, count(*) AS started, count(*) >= 5 AS full_day FROM l GROUP BY day")
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_custkey") % 30).alias("session"))
    return control.quota(log, 5).withColumnRenamed("full", "full_day")


@register(f"""WITH {_OBJECTS} SELECT key FROM ob WHERE modified > DATE '1998-06-01' - CASE WHEN starts_with(key, 'uploads/') THEN 1 ELSE 30 END""")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return control.retained(_objects(spark, sf_dir), datetime.date(1998, 6, 1)).select("key")


@register("""WITH r AS (SELECT o_orderkey AS request, o_orderkey % 25 AS photos, o_custkey % 23 AS labels, o_orderkey % 11 = 0 AS bad, o_orderkey % 2 = 0 AS keep, o_custkey % 3 = 0 AS guest FROM orders)
SELECT request, CASE WHEN photos + labels < 1 OR photos + labels > 40 OR photos < 1 OR photos > 20 THEN 'Pick between 1 and 20 photos.' WHEN labels > 20 THEN 'Pick at most 20 label files.'
 WHEN keep AND NOT guest THEN 'Keeping photos needs a valid guest id.' WHEN bad THEN 'Only JPEG and PNG photos are supported.' END AS error FROM r""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 11 == 0, "image/gif").otherwise("image/png")
    photo = F.struct(F.lit("x").alias("name"), kind.alias("type"), F.lit("train").alias("split"))
    label = F.struct(F.lit("x").alias("name"), F.lit("text/plain").alias("type"), F.lit("labels").alias("split"))
    files = F.concat(F.array_repeat(photo, (key % 25).cast("int")), F.array_repeat(label, (cust % 23).cast("int")))
    guest = F.when(cust % 3 == 0, F.sha2(cust.cast("string"), 256))
    return control.upload_errors(o.select(key.alias("request"), files.alias("files"), (key % 2 == 0).alias("keep"), guest.alias("guest")))


@register("""WITH n AS (SELECT p_partkey AS photo, p_name || CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN ' (1).png' WHEN 2 THEN '/../x' ELSE '...' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS t FROM part),
c AS (SELECT photo, t, coalesce(nullif(left(trim(regexp_replace(name, '[^A-Za-z0-9.-]+', '_', 'g'), '._'), 80), ''), 'photo') AS s FROM n)
SELECT photo, CASE WHEN regexp_matches(lower(s), '\\.(jpg|jpeg|png)$') THEN s ELSE s || CASE WHEN t = 'image/jpeg' THEN '.jpg' ELSE '.png' END END AS name FROM c""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.expr("CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN ' (1).png' WHEN 2 THEN '/../x' ELSE '...' END")
    kind = F.when(F.col("p_partkey") % 2 == 0, "image/jpeg").otherwise("image/png")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("photo"), nm.safe_name(F.concat("p_name", tail), kind).alias("name"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN left(sha256(sha256(CAST(c_custkey AS VARCHAR))), 32) END AS owner FROM customer")
def owner_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select("c_custkey", nm.owner_of(F.when(F.col("c_custkey") % 3 != 0, F.sha2(key, 256)).otherwise(F.upper(F.sha2(key, 256)))).alias("owner"))


@register(f"WITH {_OBJECTS} SELECT key, CASE WHEN starts_with(key, 'saved/o1/') THEN 'uploads/s/' || substr(key, 10) ELSE key END AS public, replace(key, '/', '__') AS local, split_part(key, '/', -1) AS name FROM ob")
def public_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    return _objects(spark, sf_dir).select("key", nm.public_key(k, F.lit("saved/o1/"), F.lit("uploads/s/")).alias("public"), nm.local_name(k, F.lit(""), F.lit(None).cast("string")).alias("local"), nm.display_name(k).alias("name"))


# -- text twins -------------------------------------------------------------------------------------------------------


@register("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return d.where("n > 1")


@register("SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.contained_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register(f"""WITH {_V} hv AS {_H.format('v')}, hc AS {_H.format('c')}, gone AS (SELECT DISTINCT y.id FROM hv x JOIN hc y ON x.id % 5 = 0 WHERE {_DIST} <= 5),
n AS (SELECT x.id AS q, x.label, y.label AS guess, row_number() OVER (PARTITION BY x.id ORDER BY {_NEAR}, y.id) AS r FROM v x JOIN (SELECT * FROM v WHERE id % 5 <> 0 UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM gone)) y ON x.id % 5 = 0)
SELECT round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM n WHERE r = 1""")
def knn_accuracy_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    test = v.where("id % 5 = 0")
    leaks = pairs.hamming_join(hashed(test), hashed(copies(v)), DEFAULT.hash_distance).select(F.col("b").alias("id")).distinct()
    return evaluation.one_nn_accuracy(v.where("id % 5 <> 0").union(copies(v).join(leaks, "id", "left_anti")), test)


@register("""SELECT 'p' || p_partkey || '.xml' AS file, CASE WHEN p_partkey % 9 <> 0 THEN p_name || '.jpg' END AS file_name, CASE WHEN p_partkey % 9 <> 0 THEN p_size ELSE -1 END AS width,
CASE WHEN p_partkey % 9 <> 0 THEN CAST(1 + p_partkey % 2 AS INTEGER) ELSE -1 END AS n, CASE WHEN p_partkey % 9 <> 0 THEN p_size + 0.5 END AS x2, p_partkey % 9 = 0 AS unreadable FROM part""")
def voc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    one = F.concat(F.lit("<object><name>a</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>"), size, F.lit(".5</xmax><ymax>9</ymax></bndbox></object>"))
    head = F.when(F.col("p_partkey") % 9 == 0, "<!DOCTYPE x>").otherwise("")
    text = F.concat(head, F.lit("<annotation><filename>"), "p_name", F.lit(".jpg</filename><size><width>"), size, F.lit("</width><height>3</height></size>"), F.repeat(one, (1 + F.col("p_partkey") % 2).cast("int")), F.lit("</annotation>"))
    p = labels.parse_voc(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("file"), text.alias("text")))
    n = F.when(F.col("boxes").isNotNull(), F.size("boxes")).otherwise(-1)
    return p.select("file", "file_name", F.coalesce("width", F.lit(-1)).alias("width"), n.alias("n"), F.get("boxes", F.lit(0))["x2"].alias("x2"), "unreadable")


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS file, 'k/' || o_custkey || '/' || o_orderkey || '.jpg' AS source, 'quarantine/' || o_orderkey || '.jpg' AS target FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0""")
def quarantine_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    file = F.col("o_orderkey").cast("string").alias("file")
    decided = o.select(file, F.when(F.col("o_orderstatus") == "F", "quarantine").otherwise("keep").alias("action"))
    keys = o.where("o_orderkey % 2 = 0").select(file, F.concat(F.lit("k/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("key"))
    return findings.quarantine_manifest(decided, keys, "quarantine/")


@register(f"WITH {_FINDINGS} SELECT type, seq, CASE WHEN type_rank <= 1 THEN 0 WHEN type_rank = 3 THEN 2 ELSE 3 END AS severity FROM f")
def severity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity(_findings(spark, sf_dir)).select("type", "seq", "severity")


@register("""WITH k AS (SELECT p_partkey, 1 + p_size % 8 AS tag FROM part)
SELECT p_partkey, tag <> 1 AS risky, tag IN (5, 6, 7, 8) AS swaps FROM k""")
def orientation_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = 1 + F.col("p_size") % 8
    return read(spark, sf_dir, "part").select("p_partkey", bx.risky_orientation(tag).alias("risky"), bx.swaps_dimensions(tag).alias("swaps"))


# -- edits, perturbations, marks --------------------------------------------------------------------------------------

_CROP = "[v[(1 + (i // 8) * 6 // 8) * 8 + 1 + (i % 8) * 6 // 8 + 1] for i in range(64)]"
_FLIP = "[{0}[(i // 8) * 8 + (7 - i % 8) + 1] for i in range(64)]"
_GAIN = "[greatest(least(x * 1.15, 0.4), -0.4) for x in {0}]"
_JPEG = "[floor((v[(i // 16) * 16 + (i % 8 // 2) * 2 + 1] + v[(i // 16) * 16 + (i % 8 // 2) * 2 + 2] + v[(i // 16) * 16 + (i % 8 // 2) * 2 + 9] + v[(i // 16) * 16 + (i % 8 // 2) * 2 + 10]) / 4 / 0.02 + 0.5) * 0.02 for i in range(64)]"
_EDITED = f"""k AS (SELECT id, CAST(floor(id / 5) AS BIGINT) % 6 AS k, v, {_CROP} AS w FROM v WHERE id % 5 = 0), w AS (SELECT id, k, v, w, {_FLIP.format('w')} AS u FROM k),
e AS (SELECT id + 1000000 AS id, id AS origin, ['exact', 'recompressed', 'cropped', 'mirror', 'recoloured', 'composed'][k + 1] AS kind,
 CASE k WHEN 1 THEN {_JPEG} WHEN 2 THEN w WHEN 3 THEN {_FLIP.format('v')} WHEN 4 THEN {_GAIN.format('v')} WHEN 5 THEN {_GAIN.format('u')} ELSE v END AS v FROM w)"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.plant_rasters(vectors(spark, sf_dir).select("id", "v"), 5, OFFSET, 8, 8, 0.4, 0.02)


@register(f"WITH {_V} {_EDITED} SELECT id, origin, kind, round(list_sum([x * i for x, i in v]), 6) AS digest FROM (SELECT id, origin, kind, list_zip(v, range(64)) AS v FROM e)".replace("[x * i for x, i in v]", "[z[1] * z[2] for z in v]"))
def edited_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return _planted(spark, sf_dir).select("id", "origin", "kind", F.round(digest, 6).alias("digest"))


@register(f"""WITH {_V} {_EDITED}, f AS (SELECT x.id AS a, y.id AS b FROM v x JOIN e y ON list_cosine_similarity(x.v, y.v) >= 0.8)
SELECT kind, count(*) AS planted, count(f.a) AS found, round(count(f.a) / count(*), 4) AS recall FROM e LEFT JOIN f ON f.a = origin AND f.b = id GROUP BY kind""")
def recall_by_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda df: df.select("id", vec.normalized(F.col("v")).alias("v"))
    planted = _planted(spark, sf_dir)
    found = pairs.cosine_join(unit(vectors(spark, sf_dir)), unit(planted), DEFAULT.candidate_similarity)
    return evaluation.recall_by_kind(planted, found)


_BYTE = "v2 AS (SELECT id, label, [127.5 + x * 300 for x in v] AS g FROM v)"


def byte_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as rasters of about 0..255."""
    return vectors(spark, sf_dir).select("id", "label", F.transform("v", lambda x: 127.5 + x * 300).alias("g"))


@register(f"""WITH {_V} {_BYTE}, p AS (SELECT id, 'darker' AS kind, [pow(greatest(x, 0) / 255, 2.5) * 255 for x in g] AS g FROM v2 UNION ALL SELECT id, 'flat', [127.5 + (x - 127.5) / 2 for x in g] FROM v2 UNION ALL SELECT id, 'coarse', [floor(x / 32 + 0.5) * 32 for x in g] FROM v2)
SELECT kind, id, round(list_avg(g), 5) AS mean, round(list_var_pop(g), 3) AS spread FROM p""")
def perturbed_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = byte_rasters(spark, sf_dir)
    out = None
    for kind in ("darker", "flat", "coarse"):
        g = F.transform("g", lambda x: F.greatest(x, F.lit(0.0))) if kind == "darker" else F.col("g")
        one = r.select(F.lit(kind).alias("kind"), "id", edits.perturbed(g, kind, 8, 8).alias("g"))
        out = one if out is None else out.union(one)
    return out.select("kind", "id", F.round(vec.mean(F.col("g")), 5).alias("mean"), F.round(rs.variance(F.col("g")), 3).alias("spread"))


@register(f"""WITH {_V} {_PX.replace("v[i + 1] * 1000 AS g", "v[i + 1] * 300 + 127.5 AS g")}, b AS (SELECT id, p, (a[u*8+l+1] + a[u*8+x+1] + a[u*8+r+1] + a[y*8+l+1] + g + a[y*8+r+1] + a[d*8+l+1] + a[d*8+x+1] + a[d*8+r+1]) / 9 AS m FROM rf)
SELECT id, round(avg(m), 5) AS mean, round(var_pop(m), 3) AS spread FROM b GROUP BY id""")
def blurred_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = byte_rasters(spark, sf_dir).select("id", edits.perturbed(F.col("g"), "blurred", 8, 8).alias("g"))
    return r.select("id", F.round(vec.mean(F.col("g")), 5).alias("mean"), F.round(rs.variance(F.col("g")), 3).alias("spread"))


# Rasters under a corner mark, but for each fifth one; shapes are even and odd labels.
_MARKED = _PX.replace("v[i + 1] * 1000 AS g FROM (SELECT id, v, unnest(range(64)) AS i FROM v)", "CASE WHEN id % 5 <> 0 AND i // 8 >= 6 AND i % 8 >= 3 THEN (v[i + 1] * 1000) * 0.2 + 1000 * 0.8 ELSE v[i + 1] * 1000 END AS g FROM (SELECT id, v, unnest(range(64)) AS i FROM sv)")
_SAMPLE = """sn AS (SELECT id, v, label % 2 AS shape, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY label % 2) AS n FROM v WINDOW w AS (PARTITION BY label % 2 ORDER BY id)),
sv AS (SELECT DISTINCT id, v, label FROM (SELECT sn.id, sn.v, sn.shape AS label, n, r FROM sn) LEFT JOIN (SELECT unnest(range(200)) AS k) ON n > 200 AND floor(k * (n - 1) / 199) = r WHERE n <= 200 OR k IS NOT NULL)"""


@register(f"""WITH RECURSIVE {_V} {_SAMPLE}, {_MARKED}, {_VOTES.replace('JOIN v USING (id)', 'JOIN sv USING (id)')},
cn AS (SELECT label AS shape, count(*) AS n FROM sv GROUP BY 1), st AS (SELECT vo.* FROM vo JOIN cn USING (shape) WHERE n >= 8 AND agree >= greatest(7, ceil(0.7 * n)) / n - 1e-9),
pt AS (SELECT shape, place AS root, place FROM st UNION SELECT pt.shape, pt.root, st.place FROM pt JOIN st ON pt.shape = st.shape AND abs(pt.place % 8 - st.place % 8) <= 5 AND abs(pt.place // 8 - st.place // 8) <= 5),
rt AS (SELECT shape, place, min(root) AS root FROM pt GROUP BY 1, 2), sz AS (SELECT shape, root, count(*) AS c FROM rt GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY shape ORDER BY count(*) DESC, root) = 1),
pn AS (SELECT st.* FROM st JOIN rt USING (shape, place) JOIN sz USING (shape, root)),
me AS (SELECT s.shape, s.id, avg(CASE WHEN (CASE WHEN use_x THEN gx ELSE gy END) * sign >= 30 THEN 1.0 ELSE 0.0 END) AS share FROM sh s JOIN pn ON s.shape = pn.shape AND s.p = pn.place GROUP BY 1, 2),
fi AS (SELECT shape, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS files, count(*) AS c FROM me WHERE share >= 0.7 GROUP BY 1 HAVING count(*) >= 7)
SELECT files, round(min(place % 8) / 8, 3) AS x1, round(min(place // 8) / 8, 3) AS y1, round((max(place % 8) + 1) / 8, 3) AS x2, round((max(place // 8) + 1) / 8, 3) AS y2, round(avg(agree), 2) AS strength FROM fi JOIN pn USING (shape) GROUP BY shape, files""")
def overlays_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rasters(spark, sf_dir)
    marked = r.withColumn("g", F.when(F.col("id") % 5 != 0, edits.stamped(F.col("g"), 8, 8, False, 0.8, 1000.0)).otherwise(F.col("g")))
    quarter = lambda taps: [(dy, dx, w / 4) for dy, dx, w in taps]
    flat = marked.select((F.col("label") % 2).alias("shape"), "id", F.lit(8).alias("height"), F.lit(8).alias("width"), rs.stencil(F.col("g"), 8, 8, quarter(rs.SOBEL_X)).alias("gx"), rs.stencil(F.col("g"), 8, 8, quarter(rs.SOBEL_Y)).alias("gy"))
    found = overlay.find_overlays(flat, AuditConfig(overlay_edge=60.0))
    return found.select(F.array_join("files", ",").alias("files"), *[F.col("box")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], "strength")


# -- scoring tables ---------------------------------------------------------------------------------------------------

_FLAGGED = """fl AS (SELECT 'train/' || CASE WHEN o_custkey % 4 = 0 THEN 'n' || (o_custkey % 7) ELSE 'c1' END || '/' || o_orderkey || '.jpg' AS a, 'val/' || CASE WHEN o_custkey % 3 = 0 THEN 'n' || (o_custkey % 7) ELSE 'c1' END || '/' || (o_custkey % 500) || '.jpg' AS b,
 CASE WHEN o_orderkey % 3 = 0 THEN 'hash' ELSE 'keypoints' END AS method, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 6 ELSE 25 + o_custkey % 90 END AS score FROM orders)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    folder = lambda n: F.when(cust % n == 0, F.concat(F.lit("n"), (cust % 7).cast("string"))).otherwise("c1")
    rows = o.select(F.concat_ws("/", F.lit("train"), folder(4), F.concat(key.cast("string"), F.lit(".jpg"))).alias("a"), F.concat_ws("/", F.lit("val"), folder(3), F.concat((cust % 500).cast("string"), F.lit(".jpg"))).alias("b"), (key % 3 == 0).alias("h"), cust)
    return tables.ranked(rows.where("h").select("a", "b", (cust % 6).alias("distance")), rows.where("not h").select("a", "b", (25 + cust % 90).alias("score")))


_SAME = "split_part(a, '/', 2) = split_part(b, '/', 2)"


@register(f"WITH {_FLAGGED} SELECT CAST(row_number() OVER (ORDER BY method <> 'hash', CASE WHEN method = 'hash' THEN score ELSE -score END, a, b) - 1 AS INTEGER) AS id, a, b, method, score, {_SAME} AS same_class FROM fl")
def flagged_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir)


@register(f"""WITH {_FLAGGED} SELECT count(*) AS pairs, count(*) FILTER (method = 'hash') AS by_hash, count(*) FILTER (method = 'keypoints') AS by_keypoints, count(DISTINCT b) AS matched, count(*) FILTER (NOT {_SAME}) AS across,
 (SELECT count(DISTINCT c_custkey) FROM customer) AS tests, round(count(DISTINCT b) / (SELECT count(DISTINCT c_custkey) FROM customer), 4) AS share FROM fl""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.audit_summary(_flagged(spark, sf_dir), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@register("""WITH c AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'val' END AS split, p_partkey % 200 AS page, lower(trim(' ' || p_name || ' ')) AS name FROM part), p AS (SELECT DISTINCT o_orderkey % 200 AS a, o_custkey % 200 AS b FROM orders)
SELECT a, b FROM p WHERE EXISTS (SELECT 1 FROM c x JOIN c y ON x.name = y.name AND x.split = 'train' AND y.split = 'val' WHERE x.page = p.a AND y.page = p.b AND x.name <> '')""")
def pages_sharing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("val")
    cards = read(spark, sf_dir, "part").select(side.alias("split"), (F.col("p_partkey") % 200).alias("page"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"))
    found = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200).alias("a"), (F.col("o_custkey") % 200).alias("b")).distinct()
    return evaluation.sharing_names(found, cards)


@register("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x/train__' ELSE 'x/val__' END || o_orderkey AS a, CASE WHEN o_custkey % 2 = 0 THEN 'train__' ELSE 'train__/val__' END || o_custkey AS b FROM orders)
SELECT a, b FROM p WHERE starts_with(split_part(a, '/', -1), 'train__') <> starts_with(split_part(b, '/', -1), 'train__')""")
def cross_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    a = F.concat(F.when(key % 3 == 0, "x/train__").otherwise("x/val__"), key.cast("string"))
    b = F.concat(F.when(cust % 2 == 0, "train__").otherwise("train__/val__"), cust.cast("string"))
    return evaluation.cross_split(o.select(a.alias("a"), b.alias("b")))


_DRAW = "CAST('0x' || substr(md5('{0}#{1}#' || k), 1, 12) AS BIGINT)"


def _drawn_sql(left: str, right: str, taken: str, n: int, draws: int, salt: str) -> str:
    number = "row_number() OVER (PARTITION BY grp ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS n, count(*) OVER (PARTITION BY grp) AS c"
    h = [_DRAW.format(salt, what) for what in ("g", "a", "b")]
    return f"""l AS (SELECT grp, id, {number} FROM ({left})), r AS (SELECT grp, id, {number} FROM ({right})),
g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS g, ca, cb FROM (SELECT DISTINCT grp, c AS ca FROM l) JOIN (SELECT DISTINCT grp, c AS cb FROM r) USING (grp)),
k AS (SELECT k, {h[0]} % (SELECT count(*) FROM g) AS g, {h[1]} AS ha, {h[2]} AS hb FROM (SELECT unnest(range({draws})) AS k)),
d AS (SELECT g.grp, l.id AS a, r.id AS b, min(k) AS k FROM k JOIN g USING (g) JOIN l ON l.grp = g.grp AND l.n = ha % ca JOIN r ON r.grp = g.grp AND r.n = hb % cb GROUP BY 1, 2, 3)
SELECT grp, a, b FROM d WHERE NOT EXISTS (SELECT 1 FROM ({taken}) t WHERE t.a = d.a AND t.b = d.b) ORDER BY k LIMIT {n}"""


@register("WITH " + _drawn_sql("SELECT label AS grp, vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0", "SELECT label AS grp, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0", "SELECT vec_id AS a, vec_id + 2 AS b FROM embeddings", 300, 2000, "class"))
def same_class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", F.col("label").alias("grp"))
    return evaluation.drawn_pairs(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), v.select(F.col("id").alias("a"), (F.col("id") + 2).alias("b")), 300, 2000, "class")


@register("WITH " + _drawn_sql("SELECT 0 AS grp, vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0", "SELECT 0 AS grp, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0", "SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings UNION ALL SELECT vec_id, vec_id + 2 FROM embeddings", 500, 3000, "any"))
def unrelated_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", F.lit(0).alias("grp"))
    key, flags = (v.select(F.col("id").alias("a"), (F.col("id") + n).alias("b")) for n in (1, 2))
    return evaluation.drawn_pairs(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), key.union(flags), 500, 3000, "any")


@register("SELECT count(*) AS photos, count(*) FILTER (p_retailprice > 1000) AS over, round(count(*) FILTER (p_retailprice > 1000) / count(*), 4) AS share FROM part")
def cap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cap_share(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("photo"), F.col("p_retailprice").alias("n")), 1000)


@register("SELECT round(avg(p_retailprice) / avg(least(p_retailprice, 1000)), 4) AS ratio, CAST(round_even(20 * avg(p_retailprice) / avg(least(p_retailprice, 1000)), 0) AS BIGINT) AS bar FROM part")
def scaled_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("n"))
    return evaluation.scaled_bar(DEFAULT.least_distinct, p.select(F.least("n", F.lit(1000)).alias("n")), p)


@register("SELECT array_to_string(list_reverse_sort(list(x)), ',') AS greatest FROM (SELECT CAST(o_custkey * 3 + o_orderkey % 5 AS BIGINT) AS x FROM orders ORDER BY x DESC LIMIT 5)")
def greatest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") * 3 + F.col("o_orderkey") % 5).cast("long").alias("x"))
    return evaluation.greatest(o, "x", 5).select(F.array_join(F.transform("greatest", lambda x: x.cast("string")), ",").alias("greatest"))


@register(f"""WITH {_V} t AS (SELECT p AS trial, id, v, CASE WHEN r <= 12 THEN 0 ELSE 1 END AS t FROM (SELECT p, id, v, row_number() OVER (PARTITION BY p ORDER BY md5(p || '@' || id), id) AS r FROM v, (SELECT unnest(range(20)) AS p)) WHERE r <= 20),
z AS (SELECT trial, p, id, v, row_number() OVER (PARTITION BY trial, p ORDER BY md5(p || '#' || id), id) AS k FROM t, (SELECT unnest(range(1, 101)) AS p)),
ch AS (SELECT trial, p, v FROM z WHERE k <= 8 UNION ALL SELECT trial, 0 AS p, v FROM t WHERE t = 1), dd AS (SELECT unnest(range(1, 65)) AS d), tot AS (SELECT trial, d, sum(v[d]) AS total FROM t, dd GROUP BY 1, 2),
g AS (SELECT trial, p, round(sum(pow(x / 8 - (total - x) / 12, 2)), 6) AS gap FROM (SELECT trial, p, d, sum(v[d]) AS x FROM ch, dd GROUP BY 1, 2, 3) JOIN tot USING (trial, d) GROUP BY 1, 2),
pv AS (SELECT g.trial, round((1 + count(*) FILTER (g.gap >= o.gap)) / 101.0, 4) AS p_value FROM g JOIN g o ON g.trial = o.trial AND o.p = 0 AND g.p > 0 GROUP BY 1)
SELECT count(*) AS trials, count(*) FILTER (p_value <= 0.05) AS flagged, round(count(*) FILTER (p_value <= 0.05) / count(*), 4) AS rate FROM pv""")
def false_alarm_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    v = vectors(spark, sf_dir).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("trial"))
    order = Window.partitionBy("trial").orderBy(F.md5(F.concat(F.col("trial").cast("string"), F.lit("@"), F.col("id").cast("string"))), "id")
    drawn = v.withColumn("r", F.row_number().over(order)).where("r <= 20")
    return shift.alarm_rates(drawn.select("trial", "id", (F.col("r") > 12).cast("int").alias("t"), "v"), 100, DEFAULT.shift_alpha)


@register(f"""WITH {_OBJECTS}, p AS (SELECT key, string_split(substr(key, length('saved/o1/s1/') + 1), '/') AS s FROM ob WHERE starts_with(key, 'saved/o1/s1/')) SELECT s[1] || '/' || s[2] AS photo, max(key) AS key FROM p WHERE len(s) = 3 AND s[1] IN ('images', 'test') GROUP BY 1""")
def photo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.photo_keys(_objects(spark, sf_dir), "o1", "s1")


@register(f"""WITH {_OBJECTS}, a AS (SELECT CASE WHEN length(key) % 7 = 0 THEN key || '/' ELSE key END AS key FROM ob) SELECT key, replace('uploads/s/' || substr(key, length('saved/o2/') + 1), '/', '__') AS local FROM a WHERE starts_with(key, 'saved/o2/') AND NOT ends_with(key, '/')""")
def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.char_length("key") % 7 == 0, F.concat("key", F.lit("/"))).otherwise(F.col("key")).alias("key")
    return control.scan_manifest(_objects(spark, sf_dir).select(key), "saved/o2/", "uploads/s/")


@register(f"""WITH {_OBJECTS}, p AS (SELECT key, modified, string_split(key, '/') AS s FROM ob WHERE starts_with(key, 'saved/o3/')), f AS (SELECT s[3] AS session, max(modified) AS saved FROM p WHERE len(s) = 6 AND s[4] IN ('images', 'test') GROUP BY 1)
SELECT session, CAST(row_number() OVER (ORDER BY saved DESC, session) - 1 AS BIGINT) AS place FROM f""")
def library_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.newest_first(control.library(_objects(spark, sf_dir))).where("owner = 'o3'").select("session", "place")
