"""Registered queries over the warehouse tables, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import contours as fc
from undula.functions import sql
from undula.operators import agreement, art, pairs, predict, summaries, weights
from undula.sources import files, sinks, tables
from undula.storage import materialize, scratch

#: Vigilance of the identity-warp assignment, and of training.
VIGILANCE, TRAINING = 88.5, 90.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _nullable():
    """A category that may be null, as a double, so that both engines hand out one type."""
    return F.col("category").cast("double").alias("category")


def six(column: str | None = None, *names: str) -> list:
    return [F.round(c, 6).alias(c) for c in ((column, *names) if column else names)]


# contours, prototypes (one per label) and the assignment by identity warp ---------------------------------------------------------------------------------

emb, orders, events = tables.embedding_contours, tables.order_contours, tables.event_contours


def prototypes(spark, sf_dir) -> DataFrame:
    """category (label), weight: the first vector of each label."""
    e = emb(spark, sf_dir).filter("label is not null")
    return e.groupBy("label").agg(F.min_by("freq", "contour_id").alias("weight")).select(F.col("label").alias("category"), "weight")


def identity(spark, sf_dir) -> DataFrame:
    """contour_id, label, category, activation, match along the identity warp."""
    both = emb(spark, sf_dir).join(F.broadcast(prototypes(spark, sf_dir)))  # one prototype per label
    return both.select("contour_id", "label", "category", F.round(fc.match(F.col("freq"), F.col("weight")), 9).alias("match")).withColumn("activation", F.col("match"))


def assigned(spark, sf_dir) -> DataFrame:
    """contour_id, label, name, category (null unless above VIGILANCE), match."""
    top = identity(spark, sf_dir).groupBy("contour_id").agg(F.any_value("label").alias("label"), F.max_by(F.struct("category", "match"), F.struct("match", (-F.col("category")).alias("c"))).alias("x"))
    return top.select("contour_id", "label", fc.auto_name(F.col("contour_id")).alias("name"), F.when(F.col("x.match") > VIGILANCE, F.col("x.category")).alias("category"), F.col("x.match").alias("match"))


_EVENTS = """WITH ev AS (SELECT user_id AS contour_id, list(value ORDER BY ts, event_id) AS freq,
  CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1) ELSE 0.0 END AS tempres FROM events WHERE value IS NOT NULL GROUP BY 1)"""
_ORDERS = "WITH oc AS (SELECT o_custkey AS contour_id, list(CAST(o_totalprice AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS freq FROM orders GROUP BY 1)"
_EMB = """WITH RECURSIVE emb AS (SELECT vec_id AS contour_id, label, list_transform(embedding, lambda x: 1000 * (1 + CAST(x AS DOUBLE))) AS freq FROM embeddings),
proto AS (SELECT label AS category, arg_min(freq, contour_id) AS weight FROM emb WHERE label IS NOT NULL GROUP BY 1),
ident AS (SELECT contour_id, label, category, round(list_sum(list_transform(range(1, len(freq) + 1), lambda i: least(freq[i], weight[i]) / greatest(freq[i], weight[i]))) / len(freq) * 100, 9) AS match FROM emb, proto)"""
_ASSIGNED = f"""{_EMB},
assigned AS (SELECT contour_id, label, 'contour_' || lpad(CAST(contour_id AS VARCHAR), CAST(greatest(4, len(CAST(contour_id AS VARCHAR))) AS INTEGER), '0') AS name, CASE WHEN match > {VIGILANCE} THEN category END AS category, match
  FROM ident QUALIFY row_number() OVER (PARTITION BY contour_id ORDER BY match DESC, category) = 1)"""


def _lerp(values: str, at: str) -> str:
    """SQL of a value at a fractional position."""
    left = f"CAST(greatest(least(floor({at}), len({values}) - 2), 0) AS BIGINT)"
    return f"({values}[{left} + 1] + (coalesce({values}[{left} + 2], {values}[{left} + 1]) - {values}[{left} + 1]) * ({at} - {left}))"


# sources and array kernels ---------------------------------------------------------------------------------------------------------------------------------


@query(f"{_EVENTS} SELECT contour_id, CAST(p AS INTEGER) AS pos, freq[p + 1] AS value FROM (SELECT contour_id, freq, unnest(range(len(freq))) AS p FROM ev)")
def contour_scan_long(spark, sf_dir):
    return events(spark, sf_dir).select("contour_id", F.posexplode("freq").alias("pos", "value"))


@query(f"{_ORDERS} SELECT contour_id, CAST(len(freq) AS INTEGER) AS n, list_min(freq) AS lo, list_max(freq) AS hi, round(list_sum(freq), 2) AS total FROM oc")
def contour_stats(spark, sf_dir):
    total = F.aggregate("freq", F.lit(0.0), lambda a, x: a + x)
    return orders(spark, sf_dir).select("contour_id", F.size("freq").alias("n"), F.array_min("freq").alias("lo"), F.array_max("freq").alias("hi"), F.round(total, 2).alias("total"))


@query(f"{_EVENTS} SELECT contour_id, round(tempres, 6) AS tempres FROM ev")
def tempres_infer(spark, sf_dir):
    return events(spark, sf_dir).select("contour_id", *six("tempres"))


_HURT = "CASE contour_id % 3 WHEN 0 THEN NULL WHEN 1 THEN -tempres ELSE tempres END"


@query(f"{_EVENTS} SELECT contour_id, round(CASE WHEN {_HURT} > 0 THEN {_HURT} ELSE 0.01 END, 6) AS tempres FROM ev")
def tempres_sanitised(spark, sf_dir):
    return events(spark, sf_dir).withColumn("tempres", F.expr(_HURT)).select("contour_id", F.round(fc.safe_tempres(F.col("tempres"), 0.01), 6).alias("tempres"))


def _raw(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("contour_id"), F.transform("embedding", lambda x: 0.45 + x.cast("double")).alias("freq"))


_FAULT = "SELECT vec_id AS contour_id, CASE WHEN len(embedding) = 0 THEN 'empty' WHEN list_min(list_transform(embedding, lambda x: 0.45 + CAST(x AS DOUBLE))) <= 0 THEN 'not_positive' END AS fault FROM embeddings"


@query(_FAULT)
def contour_validate(spark, sf_dir):
    return _raw(spark, sf_dir).select("contour_id", fc.first_fault(F.col("freq")).alias("fault"))


@query(f"SELECT min(contour_id) AS contour_id, arg_min(fault, contour_id) AS fault FROM ({_FAULT}) WHERE fault IS NOT NULL")
def first_invalid(spark, sf_dir):
    return contour_validate(spark, sf_dir).filter("fault is not null").agg(F.min("contour_id").alias("contour_id"), F.min_by("fault", "contour_id").alias("fault"))


_SQL_RESAMPLED = "greatest(1, CAST(round_even(1 + (len(freq) - 1) / 1.7, 0) AS BIGINT))"


@query(f"""{_EVENTS}, r AS (SELECT contour_id, freq, l, unnest(range(l)) AS p FROM (SELECT contour_id, freq, CASE WHEN len(freq) < 2 THEN len(freq) ELSE {_SQL_RESAMPLED} END AS l FROM ev))
SELECT contour_id, CAST(p AS INTEGER) AS pos, round({_lerp("freq", "(CASE WHEN l = 1 THEN 0.0 ELSE p * CAST(len(freq) - 1 AS DOUBLE) / (l - 1) END)")}, 6) AS value FROM r""")
def resample_linear(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("freq", fc.resample(F.col("freq"), F.lit(1.0), F.lit(1.7)))
    return e.select("contour_id", F.posexplode("freq").alias("pos", "value")).select("contour_id", "pos", *six("value"))


@query(f"""{_EVENTS}, r AS (SELECT contour_id, freq, unnest(range(CASE WHEN len(freq) > 20 THEN 20 ELSE len(freq) END)) AS p FROM ev)
SELECT contour_id, CAST(p AS INTEGER) AS pos, round(CASE WHEN len(freq) > 20 THEN {_lerp("freq", "(p * CAST(len(freq) - 1 AS DOUBLE) / 19)")} ELSE freq[p + 1] END, 6) AS value FROM r""")
def cap_length(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("freq", fc.cap_length(F.col("freq"), 20))
    return e.select("contour_id", F.posexplode("freq").alias("pos", "value")).select("contour_id", "pos", *six("value"))


@query(f"""{_EVENTS}, l AS (SELECT len(freq) AS a, CASE WHEN len(freq) < 2 THEN len(freq) ELSE {_SQL_RESAMPLED} END AS b, tempres FROM ev)
SELECT count(*) AS n, CAST(min(a) AS INTEGER) AS min_before, CAST(max(a) AS INTEGER) AS max_before, round(avg(a), 6) AS mean_before, CAST(min(b) AS INTEGER) AS min_after, CAST(max(b) AS INTEGER) AS max_after, round(avg(b), 6) AS mean_after,
count(*) FILTER (b < a) AS n_down, count(*) FILTER (b > a) AS n_up, count(*) FILTER (a = b) AS n_same, count(*) FILTER (tempres > 0) AS n_tempres, CAST(least(600, greatest(500, max(a))) AS INTEGER) AS suggested_cap FROM l""")
def length_before_after(spark, sf_dir):
    e = events(spark, sf_dir)
    after = e.withColumn("freq", fc.resample(F.col("freq"), F.lit(1.0), F.lit(1.7)))
    d = summaries.resampling_diagnostics(e, after).drop("mean_tempres")
    return d.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


@query(f"{_ORDERS} SELECT contour_id, CAST(len(freq) AS INTEGER) AS length FROM oc ORDER BY length DESC, contour_id LIMIT 3")
def longest_contours(spark, sf_dir):
    return summaries.longest(orders(spark, sf_dir))


@query("""SELECT doc_id, 'contour_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, len(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS auto_name, regexp_replace(trim(' ' || source || '.CSV'), '(?i)[.](ctr|csv|txt)$', '') AS name FROM documents""")
def name_normalise(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", fc.auto_name(F.col("doc_id")).alias("auto_name"), fc.strip_extension(F.concat(F.lit(" "), "source", F.lit(".CSV"))).alias("name"))


@query(f"""{_EVENTS}, w AS (SELECT contour_id, list_transform(range(len(freq)), lambda i: CAST(floor(i * 1.7) AS BIGINT)) AS warp FROM ev),
r AS (SELECT contour_id, warp, unnest(range(warp[-1] + 1)) AS p FROM w)
SELECT contour_id, CAST(p AS INTEGER) AS pos, CAST(coalesce(last_value(nullif(list_position(warp, p), 0) - 1 IGNORE NULLS) OVER (PARTITION BY contour_id ORDER BY p), 0) AS INTEGER) AS value FROM r""")
def unwarp(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("warp", F.transform(F.sequence(F.lit(0), F.size("freq") - 1), lambda i: F.floor(i * 1.7).cast("int")))
    return e.select("contour_id", F.posexplode(fc.unwarp(F.col("warp"))).alias("pos", "value"))


@query(f"{_EVENTS} SELECT contour_id, CAST(p AS INTEGER) AS pos, freq[CAST(floor(p * 0.6) AS BIGINT) + 1] AS value FROM (SELECT contour_id, freq, unnest(range(len(freq))) AS p FROM ev)")
def warp_gather(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("warp", F.transform(F.sequence(F.lit(0), F.size("freq") - 1), lambda i: F.floor(i * 0.6).cast("int")))
    return e.select("contour_id", F.posexplode(fc.gather(F.col("freq"), F.col("warp"))).alias("pos", "value"))


# joins, warps, search ---------------------------------------------------------------------------------------------------------------------------------------


@query(f"""{_EMB}, p AS (SELECT a.category AS a, b.category AS b, a.weight AS x, b.weight AS y FROM proto a, proto b), q AS (SELECT *, unnest(range(len(x))) AS i FROM p), r AS (SELECT *, unnest(range(len(y))) AS j FROM q)
SELECT a, b, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(least(x[i + 1], y[j + 1]) / greatest(x[i + 1], y[j + 1]) * 100, 6) AS similarity FROM r""")
def similarity_matrix_long(spark, sf_dir):
    p = prototypes(spark, sf_dir)
    both = pairs.every_pair(p.select(F.col("category").alias("a"), F.col("weight").alias("x")), p.select(F.col("category").alias("b"), F.col("weight").alias("y")), pairs.is_few(p))
    return pairs.similarity_long(both, "x", "y").select("a", "b", "i", "j", *six("similarity"))


@query(f"""{_ORDERS}, n AS (SELECT DISTINCT len(freq) AS n FROM oc)
SELECT CAST(a.n AS INTEGER) AS m, CAST(b.n AS INTEGER) AS n, CASE WHEN a.n = 1 AND b.n = 1 THEN true WHEN least(a.n, b.n) <= 1 THEN false ELSE greatest(a.n, b.n) / (least(a.n, b.n) - 1) < 3 END AS near FROM n a, n b""")
def length_ratio_reject(spark, sf_dir):
    n = orders(spark, sf_dir).select(F.size("freq").alias("n")).distinct()
    both = pairs.every_pair(n.withColumnRenamed("n", "m"), n, n.count() <= pairs.FEW)
    return both.select("m", "n", fc.length_ratio_ok(F.col("m"), F.col("n"), 3).alias("near"))


@query(f"{_EMB} SELECT contour_id, category, round(match, 6) AS match FROM ident")
def identity_match(spark, sf_dir):
    return identity(spark, sf_dir).select("contour_id", "category", *six("match"))


_W = 3


def _dtw(pairs: str) -> str:
    """SQL of the warp of every row of `pairs` (contour_id, freq, category, weight): dp (a row of each table a row), dtw (similarity)."""
    return f"""{_EMB}, pr AS (SELECT contour_id, category, weight AS a, freq AS b, len(weight) AS m, len(freq) AS n FROM {pairs}),
dp AS (SELECT contour_id, category, a, b, m, n, 0 AS i, list_transform(range(n), lambda j: CASE WHEN j = 0 THEN least(a[1], b[1]) / greatest(a[1], b[1]) * 100 END) AS v, list_transform(range(n), lambda j: 1) AS k, list_transform(range(n), lambda j: 0) AS p FROM pr
UNION ALL SELECT contour_id, category, a, b, m, n, i,
  list_transform(range(n), lambda j: c[j + 1].top + least(a[i + 1], b[j + 1]) / greatest(a[i + 1], b[j + 1]) * 100), list_transform(range(n), lambda j: CASE WHEN c[j + 1].s0 = c[j + 1].top THEN k[j + 1] + 1 ELSE 1 END),
  list_transform(range(n), lambda j: CASE c[j + 1].top WHEN c[j + 1].s0 THEN 0 WHEN c[j + 1].s1 THEN 1 WHEN c[j + 1].s2 THEN 2 WHEN c[j + 1].s3 THEN 3 ELSE 0 END)
FROM (SELECT *, list_transform(s, lambda x: {{'s0': x.s0, 's1': x.s1, 's2': x.s2, 's3': x.s3, 'top': greatest(x.s0, x.s1, x.s2, x.s3)}}) AS c
FROM (SELECT contour_id, category, a, b, m, n, i, v, k, list_transform(range(n), lambda j: CASE WHEN
    CASE WHEN i < least({_W * (_W + 1) - 1}, m) THEN (j < {_W} AND i // {_W} <= j + 1) OR (j >= {_W} AND j <= least({_W} * i, trunc((i - m) / {_W} + n)))
    ELSE j >= greatest(0, (i + 1) // {_W} - 1, (i - m) * {_W} + n) AND j < least({_W} * (i + 1), round_even((i - m) / {_W} + n, 0)) END
  THEN {{'s0': CASE WHEN k[j + 1] < CASE WHEN j = 0 AND i < least({_W * (_W + 1) - 1}, m) THEN {_W + 1} ELSE {_W} END THEN v[j + 1] END, 's1': CASE WHEN j >= 1 THEN v[j] END, 's2': CASE WHEN j >= 2 THEN v[j - 1] END, 's3': CASE WHEN j >= 3 THEN v[j - 2] END}} END) AS s
FROM (SELECT contour_id, category, a, b, m, n, i + 1 AS i, v, k FROM dp WHERE i + 1 < m)))),
dtw AS (SELECT contour_id, category, coalesce(v[n], 0) / m AS similarity FROM dp WHERE i = m - 1)"""


_DTW = _dtw("emb, proto")
#: The steps of a pair's rows, and the path that they give from the last row back.
_PATH = f"""{_DTW}, st AS (SELECT contour_id, category, any_value(a) AS a, any_value(b) AS b, any_value(m) AS m, any_value(n) AS n, list(p ORDER BY i) AS p FROM dp GROUP BY 1, 2),
back AS (SELECT *, list_reduce([[n - 1]] || list_transform(range(m - 1), lambda x: [m - 1 - x]), lambda path, x: list_append(path, path[-1] - p[x[1] + 1][path[-1] + 1])) AS path FROM st),
cells AS (SELECT contour_id, category, a, b, m, unnest(path) AS j, unnest(range(m)) AS r FROM back)
SELECT contour_id, category, CAST(m - 1 - r AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(least(a[m - r], b[j + 1]) / greatest(a[m - r], b[j + 1]) * 100, 6) AS similarity FROM cells"""
#: The best prototype along the warp; on a path that reaches the end the match is the similarity.
_PREDICTED = f"""SELECT contour_id, CAST(CASE WHEN match > {VIGILANCE} THEN category END AS DOUBLE) AS category, round(match, 6) AS match
FROM (SELECT contour_id, arg_max(category, struct_pack(s := similarity, c := -category)) AS category, max(similarity) AS match FROM dtw GROUP BY 1)"""


def _compared(spark, sf_dir):
    return pairs.compare(emb(spark, sf_dir), prototypes(spark, sf_dir), _W)


@query(f"{_DTW} SELECT contour_id, category, round(similarity, 6) AS similarity FROM dtw")
def dtw_similarity(spark, sf_dir):
    return pairs.similarities(emb(spark, sf_dir), prototypes(spark, sf_dir), _W).select("contour_id", "category", *six("similarity"))


@query(_PATH)
def dtw_path(spark, sf_dir):
    return pairs.path_rows(_compared(spark, sf_dir), "contour_id", "category").select("contour_id", "category", "i", "j", *six("similarity"))


@query(f"{_DTW} SELECT contour_id, arg_max(category, struct_pack(s := round(similarity, 9), c := -category)) AS category FROM dtw GROUP BY 1")
def best_category(spark, sf_dir):
    return predict.best(pairs.similarities(emb(spark, sf_dir), prototypes(spark, sf_dir), _W).withColumn("activation", F.round("activation", 9))).select("contour_id", "category")


@query(f"{_EMB} SELECT contour_id, category, CAST(row_number() OVER (PARTITION BY contour_id ORDER BY match DESC, category) - 1 AS INTEGER) AS rank FROM ident")
def activation_rank(spark, sf_dir):
    return predict.rank(identity(spark, sf_dir)).select("contour_id", "category", "rank")


@query(f"{_ASSIGNED} SELECT contour_id, CAST(category AS DOUBLE) AS category, round(match, 6) AS match FROM assigned")
def predict_identity(spark, sf_dir):
    return assigned(spark, sf_dir).select("contour_id", _nullable(), *six("match"))


@query(f"{_DTW} {_PREDICTED}")
def predict_vigilance(spark, sf_dir):
    return predict.predict(emb(spark, sf_dir), prototypes(spark, sf_dir), VIGILANCE).select("contour_id", _nullable(), *six("match"))


@query(f"""{_EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY contour_id ORDER BY match DESC, category) AS k FROM ident)
SELECT contour_id, CAST(arg_min(category, k) FILTER (match > {VIGILANCE}) AS DOUBLE) AS category, round(coalesce(arg_min(match, k) FILTER (match > {VIGILANCE}), max(match)), 6) AS match FROM r GROUP BY 1""")
def first_resonance(spark, sf_dir):
    return predict.first_resonating(predict.rank(identity(spark, sf_dir)), VIGILANCE).select("contour_id", _nullable(), *six("match"))


_PROTO_DTW = _dtw("(SELECT category AS contour_id, weight AS freq FROM proto) e, proto")


@query(f"{_PROTO_DTW} SELECT category AS i, contour_id AS j, round(CASE WHEN category = contour_id THEN 100 ELSE similarity END, 6) AS similarity FROM dtw")
def prototype_similarity(spark, sf_dir):
    return pairs.prototype_pairs(prototypes(spark, sf_dir), _W).select("i", "j", *six("similarity"))


@query(f"{_PROTO_DTW} SELECT category AS i, contour_id AS j, round(similarity, 6) AS similarity FROM dtw WHERE category < contour_id")
def prototype_pairs_lt(spark, sf_dir):
    return pairs.prototype_pairs(prototypes(spark, sf_dir), _W, ordered=False).select("i", "j", *six("similarity"))


@query("""SELECT CAST(i AS INTEGER) AS i, CAST(greatest(0, (i + 1) // 3 - 1, (i - 90) * 3 + 64) AS INTEGER) AS j_lo, CAST(least(least(3 * (i + 1), round_even((i - 90) / 3 + 64, 0)) - 1, 63) AS INTEGER) AS j_hi FROM range(90) t(i)""")
def warp_band(spark, sf_dir):
    return pairs.warp_band(90, 64, 3, spark)


@query(f"""{_ORDERS}, c AS (SELECT contour_id, len(freq) AS n FROM oc ORDER BY 1 LIMIT 50)
SELECT a.contour_id AS a, CAST(a.n AS INTEGER) AS n_a, b.contour_id AS b, CAST(b.n AS INTEGER) AS n_b FROM c a JOIN c b ON a.contour_id < b.contour_id AND greatest(a.n, b.n) / least(a.n, b.n) < 3 ORDER BY 1, 3 LIMIT 1""")
def first_compatible(spark, sf_dir):
    return pairs.first_compatible(orders(spark, sf_dir))


# ragged contours: lengths decide which pairs are warped ---------------------------------------------------------------------------------------------------


def national(spark, sf_dir) -> DataFrame:
    """category (nation), weight: the contour of the nation's first customer that has orders."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("contour_id"), F.col("c_nationkey").alias("category"))
    return orders(spark, sf_dir).join(c, "contour_id").groupBy("category").agg(F.min_by("freq", "contour_id").alias("weight"))


_RAGGED = """, emb AS (SELECT contour_id, freq FROM oc), proto AS (SELECT c_nationkey AS category, arg_min(freq, contour_id) AS weight FROM oc JOIN customer ON c_custkey = contour_id GROUP BY 1)"""
_NEAR = "((len(weight) = 1 AND len(freq) = 1) OR (least(len(weight), len(freq)) > 1 AND greatest(len(weight), len(freq)) < 3 * (least(len(weight), len(freq)) - 1)))"
_RAGGED_DTW = _dtw(f"(SELECT * FROM emb JOIN proto ON {_NEAR})").replace(_EMB, _ORDERS.replace("WITH ", "WITH RECURSIVE ", 1) + _RAGGED)


@query(f"{_RAGGED_DTW} SELECT contour_id, category, round(similarity, 6) AS similarity FROM dtw")
def ragged_similarity(spark, sf_dir):
    return pairs.similarities(orders(spark, sf_dir), national(spark, sf_dir), _W).select("contour_id", "category", *six("similarity"))


@query(f"""{_RAGGED_DTW}, n AS (SELECT contour_id, count(*) AS n, max(round(similarity, 9)) AS top FROM dtw GROUP BY 1)
SELECT contour_id, round(top, 6) AS similarity, coalesce(n, 0) AS n_candidates FROM emb LEFT JOIN n USING (contour_id)""")
def ragged_nearest(spark, sf_dir):
    return predict.nearest(orders(spark, sf_dir), national(spark, sf_dir), w=_W).select("contour_id", *six("similarity"), "n_candidates")


@query(f"""{_ORDERS}, x AS (SELECT contour_id AS a, len(freq) AS m FROM oc), y AS (SELECT contour_id AS b, len(freq) AS n FROM oc)
SELECT a, count(*) AS n_near, CAST(min(n) AS INTEGER) AS shortest, CAST(max(n) AS INTEGER) AS longest FROM x JOIN y ON a <> b AND ((m = 1 AND n = 1) OR (least(m, n) > 1 AND greatest(m, n) < 3 * (least(m, n) - 1))) GROUP BY a""")
def orders_that_may_meet(spark, sf_dir):
    """Which customers' contours could be warped onto each one's, of all pairs of customers."""
    return pairs.near_counts(tables.order_lengths(spark, sf_dir), _W)


_NATION_DTW = _dtw(f"(SELECT e.contour_id, e.freq, p.category, p.weight FROM (SELECT category AS contour_id, weight AS freq FROM proto) e JOIN proto p ON {_NEAR})").replace(_EMB, _ORDERS.replace("WITH ", "WITH RECURSIVE ", 1) + _RAGGED)


@query(f"""{_NATION_DTW} SELECT a.category AS i, b.category AS j, round(CASE WHEN a.category = b.category THEN 100 ELSE coalesce(similarity, 0) END, 6) AS similarity
FROM proto a CROSS JOIN proto b LEFT JOIN dtw ON dtw.category = a.category AND dtw.contour_id = b.category""")
def ragged_prototype_pairs(spark, sf_dir):
    return pairs.prototype_pairs(national(spark, sf_dir), _W).select("i", "j", *six("similarity"))


# the same in SQL, by the registered functions -----------------------------------------------------------------------------------------------------------------


def _sql(spark, text: str, **frames: DataFrame) -> DataFrame:
    sql.register(spark)
    return spark.sql(text, **frames)


@query(ORACLES["similarity_matrix_long"])
def sql_similarity_matrix(spark, sf_dir):
    text = """WITH m AS (SELECT a.category AS a, b.category AS b, similarity_matrix(a.weight, b.weight) AS m FROM {p} a CROSS JOIN {p} b),
    r AS (SELECT a, b, posexplode(m) AS (i, row) FROM m) SELECT a, b, i, j, round(x, 6) AS similarity FROM r LATERAL VIEW posexplode(row) AS j, x"""
    return _sql(spark, text, p=F.broadcast(prototypes(spark, sf_dir)))  # labels


@query(ORACLES["identity_match"])
def sql_art_match(spark, sf_dir):
    text = "SELECT contour_id, category, round(round(art_match(freq, valid_weight(weight)), 9), 6) AS match FROM {e} JOIN {p} ON length_ratio_ok(size(weight), size(freq), 3)"
    return _sql(spark, text, e=emb(spark, sf_dir), p=F.broadcast(prototypes(spark, sf_dir)))  # labels


@query(ORACLES["dtw_similarity"])
def sql_dtw(spark, sf_dir):
    text = "SELECT contour_id, category, round(dtw(weight, freq, 3).similarity, 6) AS similarity FROM {e} JOIN {p} ON length_ratio_ok(size(weight), size(freq), 3)"
    return _sql(spark, text, e=emb(spark, sf_dir), p=F.broadcast(prototypes(spark, sf_dir)))  # labels


@query(ORACLES["unwarp"])
def sql_unwarp(spark, sf_dir):
    text = "SELECT contour_id, posexplode(back) AS (pos, value) FROM (SELECT contour_id, unwarp(transform(sequence(0, size(freq) - 1), i -> cast(floor(i * 1.7D) AS int))) AS back FROM {e})"
    return _sql(spark, text, e=events(spark, sf_dir))


@query(ORACLES["warp_gather"])
def sql_warp_gather(spark, sf_dir):
    text = "SELECT contour_id, posexplode(taken) AS (pos, value) FROM (SELECT contour_id, warp_gather(freq, transform(sequence(0, size(freq) - 1), i -> cast(floor(i * 0.6D) AS int))) AS taken FROM {e})"
    return _sql(spark, text, e=events(spark, sf_dir))


@query(ORACLES["resample_linear"])
def sql_resample_linear(spark, sf_dir):
    text = "WITH r AS (SELECT contour_id, resample_linear(freq, 1.0D, 1.7D) AS freq FROM {e}), p AS (SELECT contour_id, posexplode(freq) AS (pos, value) FROM r) SELECT contour_id, pos, round(value, 6) AS value FROM p"
    return _sql(spark, text, e=events(spark, sf_dir))


@query(ORACLES["cap_length"])
def sql_cap_length(spark, sf_dir):
    text = "WITH r AS (SELECT contour_id, cap_length(freq, 20) AS freq FROM {e}), p AS (SELECT contour_id, posexplode(freq) AS (pos, value) FROM r) SELECT contour_id, pos, round(value, 6) AS value FROM p"
    return _sql(spark, text, e=events(spark, sf_dir))


@query(ORACLES["contour_scan_long"])
def sql_ctr_round_trip(spark, sf_dir):
    """Every contour as the bytes of a MATLAB file, read by the table function."""
    text = "SELECT e.contour_id, posexplode(c.freq) AS (pos, value) FROM (SELECT contour_id, write_ctr(freq, tempres) AS content FROM {e}) e, LATERAL read_ctr(e.content) c"
    return _sql(spark, text, e=events(spark, sf_dir))


# files and models that Spark writes from the tables and reads again -------------------------------------------------------------------------------------


@query(f"{_EVENTS} SELECT contour_id, CAST(CASE WHEN len(freq) > 1 THEN 0.005 ELSE 0 END AS DOUBLE) AS tempres, CAST(p AS INTEGER) AS pos, freq[p + 1] AS value FROM (SELECT contour_id, freq, unnest(range(len(freq))) AS p FROM ev)")
def csv_files(spark, sf_dir):
    """Every contour as the text of a CSV file with a time column of 5 ms steps after others, read by the table function."""
    text = """WITH f AS (SELECT contour_id, concat('no,Time [ms], Peak Frequency [Hz] \n', array_join(transform(freq, (x, i) -> concat(i, ',', 5 * i, ',', x)), '\n')) AS content FROM {e}),
    c AS (SELECT f.contour_id, c.tempres, c.freq FROM f, LATERAL read_contour('a/b.csv', cast(f.content AS binary)) c)
    SELECT contour_id, round(tempres, 6) AS tempres, posexplode(freq) AS (pos, value) FROM c"""
    return _sql(spark, text, e=events(spark, sf_dir))


@query(f"""{_EVENTS}, t AS (SELECT contour_id, CASE WHEN len(freq) > 1 THEN freq[1:-2] ELSE freq END AS freq FROM ev)
SELECT contour_id, CAST(len(freq) AS INTEGER) AS n, round(freq[-1] / 1000, 6) AS ctrlength, round(freq[-1] / 1000 / len(freq), 6) AS tempres, round(list_sum(freq), 6) AS total FROM t""")
def text_files(spark, sf_dir):
    """Every contour as a tab-separated file: the last value goes, and the last that stays is the length."""
    text = """WITH f AS (SELECT contour_id, array_join(transform(freq, x -> concat(x, '\t0')), '\n') AS content FROM {e})
    SELECT f.contour_id, size(c.freq) AS n, round(c.ctrlength, 6) AS ctrlength, round(c.tempres, 6) AS tempres, round(aggregate(c.freq, 0D, (a, x) -> a + x), 6) AS total FROM f, LATERAL read_contour('b.txt', cast(f.content AS binary)) c"""
    return _sql(spark, text, e=events(spark, sf_dir))


@query(f"""{_EVENTS} SELECT row_number() OVER (ORDER BY contour_id % 2 = 0 DESC, CAST(contour_id AS VARCHAR)) - 1 AS contour_id, 'user' || contour_id AS name, CASE WHEN contour_id % 2 = 0 THEN 'csv' ELSE 'txt' END AS source_format,
CAST(CASE WHEN contour_id % 2 = 0 OR len(freq) = 1 THEN len(freq) ELSE len(freq) - 1 END AS INTEGER) AS n FROM ev""")
def directory_scan(spark, sf_dir):
    """A directory of a file for each contour, written by the tasks, then scanned: numbers follow the format, then the path."""
    e = events(spark, sf_dir)
    csv = F.col("contour_id") % 2 == 0
    lines = F.transform("freq", lambda x: F.concat(x.cast("string"), F.when(csv, "").otherwise("\t0")))
    rows = e.select(F.concat(F.lit("user"), F.col("contour_id").cast("string"), F.when(csv, ".csv").otherwise(".txt")).alias("file"), F.concat(F.when(csv, "hz\n").otherwise(""), F.array_join(lines, "\n")).alias("value"))
    folder = scratch(spark)
    sinks.export_files(rows, folder)
    return files.load_contours(spark, folder)[0].select("contour_id", "name", "source_format", F.size("freq").alias("n"))


@query(f"{_EMB} SELECT category, CAST(p AS INTEGER) AS pos, weight[p + 1] AS value FROM (SELECT category, weight, unnest(range(len(weight))) AS p FROM proto)")
def saved_model(spark, sf_dir):
    """Prototypes of a model that is saved and loaded."""
    folder = scratch(spark)
    sinks.save_model({"prototypes": prototypes(spark, sf_dir), "assignments": assigned(spark, sf_dir)}, folder)
    return sinks.load_model(spark, folder)["prototypes"].select("category", F.posexplode("weight").alias("pos", "value"))


@query(f"""{_ASSIGNED}, a AS (SELECT label % 3 AS source, contour_id, name || ',' || coalesce(CAST(category + 1 AS VARCHAR), '') || ',' || CAST(round_even(match, 3) AS VARCHAR) AS line FROM assigned WHERE label IS NOT NULL)
SELECT 'set' || source || '_assignments.csv' AS file, CAST(0 AS INTEGER) AS pos, 'contour_name,category,match' AS line FROM a GROUP BY source
UNION ALL SELECT 'set' || source || '_assignments.csv', CAST(row_number() OVER (PARTITION BY source ORDER BY contour_id) AS INTEGER), line FROM a
UNION ALL SELECT 'set' || source || '_weights.csv', CAST(0 AS INTEGER), string_agg('cat_' || (category + 1), ',' ORDER BY category) FROM (SELECT category % 3 AS source, category FROM proto) GROUP BY source
UNION ALL SELECT 'set' || source || '_weights.csv', CAST(p + 1 AS INTEGER), string_agg(CAST(v AS VARCHAR), ',' ORDER BY category) FROM (SELECT category % 3 AS source, category, p, weight[p + 1] AS v FROM (SELECT category, weight, unnest(range(len(weight))) AS p FROM proto)) GROUP BY source, p""")
def extracted_files(spark, sf_dir):
    """The lines of both CSV files of three saved categorisations."""
    source = lambda c: F.concat(F.lit("set"), (F.col(c) % 3).cast("string")).alias("source")
    tables = {"assignments": assigned(spark, sf_dir).filter("label is not null").select(source("label"), "contour_id", "name", "category", "match"), "prototypes": prototypes(spark, sf_dir).select(source("category"), "category", "weight")}
    rows = sinks.categorisation_files(tables).select("file", F.posexplode(F.split(F.expr("left(value, length(value) - 1)"), "\n")).alias("pos", "line"))
    return rows


# learning one step and keeping prototypes --------------------------------------------------------------------------------------------------------------


@query(f"{_EMB} SELECT contour_id, CAST(p AS INTEGER) AS pos, round(weight[p + 1] + 0.25 * (freq[p + 1] - weight[p + 1]), 6) AS value FROM (SELECT contour_id, freq, weight, unnest(range(len(freq))) AS p FROM emb JOIN proto ON category = label)")
def update_identity(spark, sf_dir):
    """The prototype of its label after it learnt from each vector along the straight warp."""
    text = """WITH u AS (SELECT contour_id, update_weights(freq, weight, 0.25D, sequence(0, size(freq) - 1)) AS new FROM {e} JOIN {p} ON category = label), r AS (SELECT contour_id, posexplode(new) AS (pos, value) FROM u)
    SELECT contour_id, pos, round(value, 6) AS value FROM r"""
    return _sql(spark, text, e=emb(spark, sf_dir), p=F.broadcast(prototypes(spark, sf_dir)))  # labels


@query(f"{_ORDERS} SELECT contour_id, count(*) AS n_prototypes, count(*) FILTER (NOT ((len(freq) = 1 AND n = 1) OR (least(len(freq), n) > 1 AND greatest(len(freq), n) < 3 * (least(len(freq), n) - 1)))) AS n_refused FROM oc, (SELECT unnest([1, 2, 5, 12, 30]) AS n) GROUP BY 1")
def refused_warps(spark, sf_dir):
    """How many of five straight prototypes have no warp at all onto each contour."""
    text = """SELECT contour_id, count(*) AS n_prototypes, count_if(size(dtw(weight, freq, 3).warp) = 0) AS n_refused
    FROM (SELECT contour_id, freq, explode(array(1, 2, 5, 12, 30)) AS n FROM {o}) LATERAL VIEW explode(array(transform(sequence(1, n), i -> 1000D * i))) AS weight GROUP BY contour_id"""
    return _sql(spark, text, o=orders(spark, sf_dir))


@query(f"{_EMB} SELECT category - CASE WHEN category > 4 THEN 1 ELSE 0 END AS category, CAST(p AS INTEGER) AS pos, weight[p + 1] AS value FROM (SELECT category, weight, unnest(range(len(weight))) AS p FROM proto WHERE category <> 4)")
def deleted_prototype(spark, sf_dir):
    return weights.delete(prototypes(spark, sf_dir), 4).select("category", F.posexplode("weight").alias("pos", "value"))


@query(f"{_EMB} SELECT CAST(n AS INTEGER) AS category, CAST(p AS INTEGER) AS pos, [5.0, 6.5, 8.0][p + 1]::DOUBLE AS value FROM (SELECT max(category) + 1 AS n, unnest(range(3)) AS p FROM proto) UNION ALL SELECT category, CAST(p AS INTEGER), weight[p + 1] FROM (SELECT category, weight, unnest(range(len(weight))) AS p FROM proto)")
def added_prototype(spark, sf_dir):
    return weights.add(prototypes(spark, sf_dir), [5.0, 6.5, 8.0]).select("category", F.posexplode("weight").alias("pos", "value"))


@query(f"""{_ORDERS}{_RAGGED}, n AS (SELECT c_nationkey AS category, greatest(1, CAST(round_even(avg(len(freq)), 0) AS BIGINT)) AS n FROM oc JOIN customer ON c_custkey = contour_id GROUP BY 1),
r AS (SELECT category, weight, n, unnest(range(n)) AS p FROM proto JOIN n USING (category))
SELECT category, CAST(p AS INTEGER) AS pos, round(CASE WHEN len(weight) = 1 THEN weight[1] ELSE {_lerp("weight", "(CASE WHEN n = 1 THEN 0.0 ELSE p * CAST(len(weight) - 1 AS DOUBLE) / (n - 1) END)")} END, 6) AS value FROM r""")
def averaged_prototypes(spark, sf_dir):
    """National prototypes brought to the mean length of their customers' contours."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("contour_id"), F.col("c_nationkey").alias("category"))
    a = weights.average(national(spark, sf_dir), orders(spark, sf_dir), c)
    return a.select("category", F.posexplode("weight").alias("pos", "value")).select("category", "pos", *six("value"))


# summaries --------------------------------------------------------------------------------------------------------------------------------------------------


@query(f"{_ASSIGNED} SELECT category, count(*) AS n FROM assigned WHERE category IS NOT NULL GROUP BY 1")
def category_sizes(spark, sf_dir):
    return summaries.category_sizes(assigned(spark, sf_dir))


@query(f"{_ASSIGNED} SELECT count(*) FILTER (category IS NULL) AS n_uncategorised FROM assigned")
def uncategorised(spark, sf_dir):
    return summaries.uncategorised(assigned(spark, sf_dir))


@query(f"{_ASSIGNED} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY contour_id) - 1 AS INTEGER) AS pos, name FROM assigned WHERE category IS NOT NULL")
def provenance(spark, sf_dir):
    return summaries.provenance(assigned(spark, sf_dir)).select("category", F.posexplode("names").alias("pos", "name"))


@query(f"{_ASSIGNED} SELECT coalesce(CAST(category AS VARCHAR), 'Uncategorized') AS label, count(*) AS n FROM assigned GROUP BY 1")
def distribution(spark, sf_dir):
    return summaries.distribution(assigned(spark, sf_dir))


@query(f"""{_ASSIGNED} SELECT count(*) AS n_contours, count(category) AS n_categorised, count(*) - count(category) AS n_uncategorised, count(DISTINCT category) AS n_categories,
round(avg(match) FILTER (category IS NOT NULL), 6) AS mean_match, round(quantile_cont(match, 0.5) FILTER (category IS NOT NULL), 6) AS median_match FROM assigned""")
def stats_table(spark, sf_dir):
    return summaries.stats_table(assigned(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_match", "median_match")})


@query(f"{_ASSIGNED} SELECT count(category) AS n_categorised, count(*) - count(category) AS n_uncategorised FROM assigned")
def prediction_summary(spark, sf_dir):
    return summaries.prediction_summary(assigned(spark, sf_dir))


def _sql_histogram(rows: str, bins: str) -> str:
    return f""", x AS ({rows}), s AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, CAST({bins} AS BIGINT) AS bins FROM x),
c AS (SELECT least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS bin, count(*) AS n FROM x, s GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / bins), 6) AS lo, round(lo + (b + 1) * ((hi - lo) / bins), 6) AS hi, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(bins)) AS b FROM s) LEFT JOIN c ON bin = b"""


def _rounded(h: DataFrame) -> DataFrame:
    return h.select("bin", *six("lo", "hi"), F.col("n").cast("long").alias("n"))


@query(_ASSIGNED + _sql_histogram("SELECT match AS x FROM assigned", "30"))
def match_histogram(spark, sf_dir):
    return _rounded(summaries.match_histogram(assigned(spark, sf_dir)))


@query(_ORDERS + _sql_histogram("SELECT CAST(len(freq) AS DOUBLE) AS x FROM oc", "least(50, greatest(10, count(DISTINCT x)))"))
def length_histogram(spark, sf_dir):
    return _rounded(summaries.length_histogram(orders(spark, sf_dir)))


@query(_EVENTS + _sql_histogram("SELECT round(tempres, 6) AS x FROM ev WHERE tempres > 0", "CASE WHEN count(DISTINCT x) <= 1 THEN 1 ELSE least(30, greatest(3, count(DISTINCT x))) END"))
def tempres_histogram(spark, sf_dir):
    return _rounded(summaries.tempres_histogram(events(spark, sf_dir)))


@query(f"{_ASSIGNED} SELECT category, count(*) AS n, round(avg(match), 6) AS mean, round(quantile_cont(match, 0.5), 6) AS median, round(min(match), 6) AS lo, round(max(match), 6) AS hi FROM assigned WHERE category IS NOT NULL GROUP BY 1")
def match_by_category(spark, sf_dir):
    return summaries.match_by_category(assigned(spark, sf_dir)).select("category", "n", *six("mean", "median", "lo", "hi"))


@query(f"""{_ASSIGNED}, f AS (SELECT *, CASE WHEN category IS NOT NULL AND row_number() OVER (PARTITION BY category ORDER BY contour_id) = 1 THEN 1 ELSE 0 END AS new FROM assigned)
SELECT contour_id, CAST(sum(new) OVER (ORDER BY contour_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS n_seen FROM f""")
def discovery_curve(spark, sf_dir):
    return summaries.discovery_curve(assigned(spark, sf_dir))


@query(f"""{_ASSIGNED}, c AS (SELECT label, category, count(*) AS n, min(contour_id) AS first FROM assigned WHERE category IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
a AS (SELECT label, CAST(row_number() OVER (ORDER BY min(first)) - 1 AS INTEGER) AS row FROM c GROUP BY 1), b AS (SELECT category, CAST(row_number() OVER (ORDER BY min(first)) - 1 AS INTEGER) AS col FROM c GROUP BY 1)
SELECT label, category, n, row, col FROM c JOIN a USING (label) JOIN b USING (category)""")
def confusion_long(spark, sf_dir):
    return summaries.confusion(assigned(spark, sf_dir))


@query(f"{_ASSIGNED} SELECT category, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS share FROM assigned WHERE category IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2")
def label_proportion(spark, sf_dir):
    return summaries.label_proportion(assigned(spark, sf_dir)).select("category", "label", "n", *six("share"))


@query(f"""{_ASSIGNED}, m AS (SELECT contour_id FROM assigned WHERE category = 0 ORDER BY 1 LIMIT 20)
SELECT contour_id, CAST(p AS INTEGER) AS pos, freq[p + 1] AS value FROM (SELECT contour_id, freq, unnest(range(len(freq))) AS p FROM emb JOIN m USING (contour_id))""")
def category_members(spark, sf_dir):
    return summaries.members(emb(spark, sf_dir), assigned(spark, sf_dir), 0)


_SWEEP = ", ".join(f"({v})" for v in (86.0, 88.5, 91.0))


@query(f"""{_EMB}, best AS (SELECT contour_id, category, match FROM ident QUALIFY row_number() OVER (PARTITION BY contour_id ORDER BY match DESC, category) = 1)
SELECT CAST(v AS DOUBLE) AS vigilance, count(DISTINCT CASE WHEN match > v THEN category END) AS n_categories, round(avg(match), 6) AS mean_match FROM best, (VALUES {_SWEEP}) t(v) GROUP BY 1""")
def vigilance_sweep(spark, sf_dir):
    top = predict.best(identity(spark, sf_dir))
    v = spark.createDataFrame([(86.0,), (88.5,), (91.0,)], "vigilance double")
    runs = top.crossJoin(F.broadcast(v)).select("vigilance", F.when(F.col("activation") > F.col("vigilance"), F.col("category")).alias("category"), F.col("activation").alias("match"))  # three rows
    return summaries.vigilance_sweep(runs).select("vigilance", "n_categories", *six("mean_match"))


# agreement --------------------------------------------------------------------------------------------------------------------------------------------------

_TABLE = f"""{_ASSIGNED}, t AS (SELECT label AS a, category AS b, count(*) AS n FROM assigned WHERE category IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
ta AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), tb AS (SELECT b, sum(n) AS n, max(n) AS most FROM t GROUP BY 1), tot AS (SELECT sum(n) AS n FROM t),
z AS (SELECT tot.n AS n, (SELECT sum(n * (n - 1) / 2) FROM t) AS same, (SELECT sum(n * (n - 1) / 2) FROM ta) AS pa, (SELECT sum(n * (n - 1) / 2) FROM tb) AS pb, tot.n * (tot.n - 1) / 2 AS alls,
  (SELECT -sum(n / tot.n * ln(n / tot.n)) FROM ta) AS ha, (SELECT -sum(n / tot.n * ln(n / tot.n)) FROM tb) AS hb, (SELECT sum(t.n / tot.n * ln(t.n * tot.n / (ta.n * tb.n))) FROM t JOIN ta USING (a) JOIN tb USING (b)) AS mi, (SELECT sum(most) FROM tb) AS pure FROM tot)"""


@query(f"""{_TABLE} SELECT CAST(n AS BIGINT) AS n, round((same - pa * pb / alls) / ((pa + pb) / 2 - pa * pb / alls), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(same / sqrt(pa * pb), 6) AS fowlkes_mallows,
round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure, round(pure / n, 6) AS purity,
CAST(same AS BIGINT) AS both_same, CAST(pa - same AS BIGINT) AS left_only, CAST(pb - same AS BIGINT) AS right_only, CAST(alls - pa - pb + same AS BIGINT) AS both_different,
CASE WHEN round((same - pa * pb / alls) / ((pa + pb) / 2 - pa * pb / alls), 6) >= 0.8 THEN 'excellent' WHEN round((same - pa * pb / alls) / ((pa + pb) / 2 - pa * pb / alls), 6) >= 0.6 THEN 'good' WHEN round((same - pa * pb / alls) / ((pa + pb) / 2 - pa * pb / alls), 6) >= 0.4 THEN 'moderate' WHEN round((same - pa * pb / alls) / ((pa + pb) / 2 - pa * pb / alls), 6) >= 0.2 THEN 'weak' ELSE 'poor' END AS verdict FROM z""")
def agreement_scores(spark, sf_dir):
    s = agreement.scores(assigned(spark, sf_dir), "label", "category")
    s = s.withColumns({c: F.round(c, 6) for c in ("ari", "nmi", "fowlkes_mallows", "homogeneity", "completeness", "v_measure", "purity")})
    return s.withColumn("verdict", agreement.verdict(F.col("ari")))


@query(f"""{_ASSIGNED}, n AS (SELECT category, label, count(*) AS n FROM assigned WHERE category IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)
SELECT category, CAST(sum(n) OVER w AS BIGINT) AS size, label AS dominant, count(*) OVER w AS n_labels, round(n / sum(n) OVER w, 6) AS purity FROM n WINDOW w AS (PARTITION BY category) QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, label) = 1""")
def per_category_purity(spark, sf_dir):
    return agreement.category_purity(assigned(spark, sf_dir), "label", "category").withColumn("purity", F.round("purity", 6))


@query(f"""{_ASSIGNED}, n AS (SELECT category, label, count(*) AS n FROM assigned WHERE category IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
p AS (SELECT category, n / sum(n) OVER (PARTITION BY category) AS purity FROM n QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, label) = 1) SELECT category, round(purity, 6) AS purity FROM p ORDER BY p.purity, category LIMIT 20""")
def most_impure(spark, sf_dir):
    return agreement.most_impure(agreement.category_purity(assigned(spark, sf_dir), "label", "category")).select("category", *six("purity"))


#: The best total over one-to-one namings, category by category, for every set of labels that may be used up.
_NAMING = f"""{_ASSIGNED}, t AS (SELECT label AS a, category AS b, count(*) AS n FROM assigned WHERE category IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
la AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM t)), lb AS (SELECT b, row_number() OVER (ORDER BY b) AS k FROM (SELECT DISTINCT b FROM t)),
g AS (SELECT k, list(coalesce(n, 0) ORDER BY i) AS w FROM la CROSS JOIN lb LEFT JOIN t USING (a, b) GROUP BY k),
h AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(CAST(pow(2, count(*)) AS BIGINT)), lambda x: CAST(0 AS BIGINT)) AS v FROM la
UNION ALL SELECT g.k, list_transform(range(len(v)), lambda m: greatest(v[m + 1], list_max(list_transform(range(len(w)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN v[m - (1 << i) + 1] + w[i + 1] END)))) FROM h JOIN g ON g.k = h.k + 1)
SELECT coalesce(v[-1] / (SELECT sum(n) FROM t), 0) AS accuracy, v[-1] AS n_agreeing FROM h ORDER BY k DESC LIMIT 1"""


@query(_NAMING)
def hungarian_accuracy(spark, sf_dir):
    return agreement.best_match_accuracy(assigned(spark, sf_dir), "label", "category")


def _two_sides(spark, sf_dir):
    a = assigned(spark, sf_dir)
    left = a.select(F.concat("name", F.lit(".csv")).alias("contour_name"), F.col("label").alias("category"), (F.col("match") * 100).alias("match"))
    right = a.filter("category is not null").select(F.concat("name", F.lit(".CTR")).alias("contour_name"), "category", "match")
    return agreement.shared(left, right)


_SHARED = f"""{_ASSIGNED}, sh AS (SELECT name AS contour_name, label AS category_left, CASE WHEN (SELECT max(match * 100) FROM assigned) > 200 THEN match * 100 / 100 ELSE match * 100 END AS match_left, category AS category_right, match AS match_right FROM assigned WHERE category IS NOT NULL)"""


@query(f"{_SHARED} SELECT contour_name, category_left, round(match_left, 6) AS match_left, category_right, round(match_right, 6) AS match_right FROM sh")
def inner_join_shared(spark, sf_dir):
    return _two_sides(spark, sf_dir).select("contour_name", "category_left", *six("match_left"), "category_right", *six("match_right"))


@query(f"""{_SHARED}, l AS (SELECT category_left AS c, count(*) AS n, sum(match_left) AS m FROM sh WHERE category_left IS NOT NULL GROUP BY 1), r AS (SELECT category_right AS c, count(*) AS n, sum(match_right) AS m FROM sh GROUP BY 1)
SELECT 'left' AS side, count(*) AS n_categories, round(sum(m) / sum(n), 6) AS mean_match, round(avg(n), 6) AS mean_size, count(*) FILTER (n = 1) AS singletons FROM l
UNION ALL SELECT 'right', count(*), round(sum(m) / sum(n), 6), round(avg(n), 6), count(*) FILTER (n = 1) FROM r""")
def overview(spark, sf_dir):
    return agreement.overview(_two_sides(spark, sf_dir)).select("side", "n_categories", *six("mean_match", "mean_size"), "singletons")


@query(f"""{_ASSIGNED}, l AS (SELECT name, count(*) AS a FROM assigned GROUP BY 1), r AS (SELECT name, count(*) AS b FROM assigned WHERE category IS NOT NULL GROUP BY 1), x AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM l FULL JOIN r USING (name))
SELECT CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right, CAST(sum(a * b) AS BIGINT) AS n_shared, CAST(sum(a) - sum(a * b) AS BIGINT) AS left_only, CAST(sum(b) - sum(a * b) AS BIGINT) AS right_only,
count(*) FILTER (b = 0) AS n_left_names_only, count(*) FILTER (a = 0) AS n_right_names_only FROM x""")
def shared_counts(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return agreement.sides(a.select(F.concat("name", F.lit(".csv")).alias("contour_name")), a.filter("category is not null").select(F.concat("name", F.lit(".CTR")).alias("contour_name")))


# prototypes' tables and exports -----------------------------------------------------------------------------------------------------------------------------


@query(f"""{_ASSIGNED}, u AS (SELECT DISTINCT category FROM assigned WHERE category IS NOT NULL), n AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS new FROM u)
SELECT contour_id, CAST(new AS DOUBLE) AS category FROM assigned LEFT JOIN n USING (category)""")
def purge_reindex(spark, sf_dir):
    _, again, _ = weights.purge(prototypes(spark, sf_dir), assigned(spark, sf_dir))
    return again.select("contour_id", _nullable())


@query(f"{_ASSIGNED} SELECT contour_id, CAST(category - CASE WHEN category > 4 THEN 1 ELSE 0 END AS DOUBLE) AS category FROM assigned WHERE category IS NULL OR category <> 4")
def delete_reindex(spark, sf_dir):
    a = assigned(spark, sf_dir).filter("category is null or category <> 4")
    return weights.delete_reindex(prototypes(spark, sf_dir), a, 4)[1].select("contour_id", _nullable())


@query(f"{_ORDERS} SELECT contour_id % 25 AS category, round(avg(len(freq)), 6) AS mean_length, CAST(round_even(avg(len(freq)), 0) AS INTEGER) AS new_length FROM oc GROUP BY 1")
def average_length(spark, sf_dir):
    o = orders(spark, sf_dir)
    return summaries.mean_length(o.select("contour_id", (F.col("contour_id") % 25).alias("category")), o).withColumn("mean_length", F.round("mean_length", 6))


@query(f"""{_ASSIGNED} SELECT name AS contour_name, coalesce(CAST(category + 1 AS VARCHAR), 'uncategorized') AS category, printf('%.3f', match) AS match FROM assigned""")
def assignments_export_format(spark, sf_dir):
    return sinks.assignment_rows(assigned(spark, sf_dir), one_based=True)


_ID = f"sha1(unhex('{fc.NAMESPACE.replace('-', '')}') || encode('label/' || CAST(category AS VARCHAR)))"


@query(f"""{_ASSIGNED}, h AS (SELECT category, {_ID} AS h FROM (SELECT DISTINCT category FROM assigned WHERE category IS NOT NULL)),
ids AS (SELECT category, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS ref_contour_id FROM h)
SELECT category + 1 AS category, ref_contour_id, name AS parent_contour_name FROM assigned JOIN ids USING (category)""")
def provenance_export(spark, sf_dir):
    return sinks.provenance_rows(summaries.provenance(assigned(spark, sf_dir)), one_based=True, run="label")


@query(f"{_ASSIGNED} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY contour_id) - 1 AS INTEGER) AS pos, contour_id, name FROM assigned WHERE category IS NOT NULL")
def member_rows(spark, sf_dir):
    return summaries.member_rows(assigned(spark, sf_dir))


@query(f"""{_EMB} SELECT 'refContour_' || (category + 1) || '.csv' AS file, list_aggregate(list_transform(weight, lambda x: printf('%7.1f', x)), 'string_agg', chr(10)) || chr(10) AS value FROM proto WHERE category <> 3""")
def reference_export(spark, sf_dir):
    """The files of all prototypes; that of label 3 has no value left and so no file."""
    p = prototypes(spark, sf_dir).withColumn("weight", F.when(F.col("category") == 3, F.transform("weight", lambda x: F.lit(float("nan")))).otherwise(F.col("weight")))
    return sinks.prototype_text(p)


@query(f"""{_EMB}, q AS (SELECT contour_id, category, list_filter(range(1, len(freq) + 1), lambda i: (i - 1) % 7 <> 0 AND (i - 1) % 11 <> 1) AS ok, freq, weight FROM emb, proto)
SELECT contour_id, category, round(list_sum(list_transform(ok, lambda i: least(freq[i], weight[i]) / greatest(freq[i], weight[i]))) / len(ok) * 100, 6) AS match FROM q""")
def match_valid_positions(spark, sf_dir):
    """The match with prototypes that are zero at every seventh point and missing at every eleventh after the first."""
    hurt = F.transform("weight", lambda x, i: F.when(i % 7 == 0, 0.0).when(i % 11 == 1, float("nan")).otherwise(x))
    both = emb(spark, sf_dir).join(F.broadcast(prototypes(spark, sf_dir).withColumn("weight", hurt)))  # one prototype per label
    return both.select("contour_id", "category", F.round(fc.match(F.col("freq"), F.col("weight")), 6).alias("match"))


@query(f"{_RAGGED_DTW} SELECT contour_id, category, round(similarity * (1 - CAST(0.2 AS DOUBLE)), 6) AS activation FROM dtw")
def ragged_activation(spark, sf_dir):
    return pairs.similarities(orders(spark, sf_dir), national(spark, sf_dir), _W, bias=0.2).select("contour_id", "category", *six("activation"))


@query(f"""{_EVENTS}, b AS (SELECT contour_id, freq, CASE WHEN tempres > 0 THEN tempres ELSE 0.01 END AS t, CASE WHEN len(freq) > 20 THEN 20 ELSE len(freq) END AS l FROM ev),
r AS (SELECT *, unnest(range(len(freq))) AS p FROM b), a AS (SELECT *, unnest(range(l)) AS p FROM b)
SELECT contour_id, 'before' AS side, CAST(p AS INTEGER) AS pos, round(p * t, 4) AS seconds, round(freq[p + 1], 6) AS value FROM r
UNION ALL SELECT contour_id, 'after', CAST(p AS INTEGER), round(CASE WHEN l > 1 THEN p * ((len(freq) - 1) * t / (l - 1)) ELSE 0 END, 4), round(CASE WHEN len(freq) > 20 THEN {_lerp("freq", "(p * CAST(len(freq) - 1 AS DOUBLE) / 19)")} ELSE freq[p + 1] END, 6) FROM a""")
def before_after(spark, sf_dir):
    e = events(spark, sf_dir)
    out = summaries.before_after(e, e.withColumn("freq", fc.cap_length(F.col("freq"), 20)), 1.0)
    return out.select("contour_id", "side", "pos", F.round("seconds", 4).alias("seconds"), *six("value"))


@query()
def prototype_embedding(spark, sf_dir):
    return summaries.mds(pairs.prototype_pairs(prototypes(spark, sf_dir), _W))


@query()
def prototype_dendrogram(spark, sf_dir):
    return summaries.dendrogram(pairs.prototype_pairs(prototypes(spark, sf_dir), _W))


# training ---------------------------------------------------------------------------------------------------------------------------------------------------


def _trained(spark, sf_dir, **flags):
    """Two runs over all event contours as they are, with the default limits on categories and iterations."""
    return art.fit(events(spark, sf_dir), {f"v{TRAINING:g}s{s}": art.Params(vigilance=TRAINING, seed=s, **flags) for s in (1, 2)})


@query()
def train_assignments(spark, sf_dir):
    return art.assignments(_trained(spark, sf_dir))


@query()
def train_prototypes(spark, sf_dir):
    return art.prototypes(_trained(spark, sf_dir, purge_empty=True)).select("run_id", "category", F.posexplode("weight").alias("pos", "value"))


@query()
def train_history(spark, sf_dir):
    return summaries.new_per_round(art.history(_trained(spark, sf_dir, recat_single=True, deprioritize_lone=True)))


@query()
def run_stability(spark, sf_dir):
    results = materialize(_trained(spark, sf_dir, compare_warped=True))
    return summaries.run_stability(art.meta(results), art.assignments(results))


def _sql_spread(values: str, length: str) -> str:
    """SQL of values at evenly spaced positions, ends kept."""
    return f"list_transform(range({length}), lambda p: {_lerp(values, f'(p * CAST(len({values}) - 1 AS DOUBLE) / ({length} - 1))')})"


_HALVED = f"""(SELECT contour_id, {_sql_spread("freq", "CAST(round_even(1 + (len(freq) - 1) / 2.0, 0) AS BIGINT)")} AS freq FROM emb) e, (SELECT category, CASE WHEN len(weight) > 32 THEN {_sql_spread("weight", "32")} ELSE weight END AS weight FROM proto) p"""


@query(f"{_dtw(_HALVED)} {_PREDICTED}")
def flagship(spark, sf_dir):
    """Scan, resample, warp against the prototypes, take the best, assign above vigilance."""
    e = emb(spark, sf_dir).select("contour_id", fc.resample(F.col("freq"), F.lit(0.005), F.lit(0.01)).alias("freq"))
    return predict.predict(e, prototypes(spark, sf_dir).withColumn("weight", fc.cap_length(F.col("weight"), 32)), VIGILANCE).select("contour_id", _nullable(), *six("match"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["oracle_sql", "queries"]
