"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bpe, importance, langid, lines, media, packing, quality, simhash, spelling, substring, toxicity, urls, vectors
from undula.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, toxicity.trained_apart(labels)))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.word_digests(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(langid.trained_apart(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), radius=None, min_words=1, digest=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, labels)).withColumn("llr", F.round("llr", 6))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    items = urls.labelled_tokens(urls.labelled_pages(pages, labels))
    return urls.judge(pages, urls.mine(items), urls.rare(items))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_media, op3_substring, op4_language, op5_bpe, op6_lines, op7_simhash, op8_quality, op9_urls, op10_packing, op11_spelling, op12_vectors, op13_importance)}


#: The windows of 20 words in full; every one after the first of its equals takes its words along.
OP3_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) AS s FROM w)),
lost AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM lost)),
word AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word.x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


#: The n-gram ratios over all four-byte runs of all texts, as long as labels name at most quality.TRUSTED trusted documents.
OP8_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS trusted FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT r, p, array_to_string(ws[p + 1 : p + 3], ' ') AS g FROM (SELECT r, ws, unnest(range(greatest(len(ws) - 2, 0))) AS p FROM w)),
again AS (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM (SELECT r, p FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1)),
repeated AS (SELECT r, count(DISTINCT q) AS n FROM again GROUP BY 1),
x AS (SELECT r, trusted, hex(encode(chr(10) || t || chr(10))) AS x FROM d),
f AS (SELECT r, trusted, unnest(regexp_extract_all(substr(x, 2 * o + 1), '.{{8}}')) AS g FROM x, range({quality.GRAM}) offsets(o)),
g AS (SELECT g, CAST(CAST('0x' || g AS UBIGINT)::HUGEINT * {0x9E3779B97F4A7C15} % {1 << 64} // {1 << 64 - quality.BITS} AS BIGINT) AS bucket, count(*) AS raw, count(*) FILTER (trusted) AS target FROM f GROUP BY g),
b AS (SELECT bucket, sum(raw) AS raw, sum(target) AS target FROM g GROUP BY 1), s AS (SELECT sum(raw) AS raw, sum(target) AS target FROM b),
ratio AS (SELECT bucket, CASE WHEN s.target = 0 THEN 0 ELSE ln((b.target + {quality.SMOOTHING}) / (b.raw * (s.target / s.raw) + {quality.SMOOTHING})) END AS v FROM b, s),
llr AS (SELECT r, sum(v) / count(*) AS llr FROM f JOIN g USING (g) JOIN ratio USING (bucket) GROUP BY 1),
base AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN repeated USING (r)),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed, coalesce(llr, 0) AS v FROM base LEFT JOIN llr USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(v, 6) AS llr, NOT base_failed AND v >= {quality.THRESHOLD} AS kept FROM j"""


#: Every pair compared; components by following links.
OP12_SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT r, vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_max(list_transform(x, lambda y: abs(y))) > 0),
e AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {vectors.COSINE}),
reach AS (SELECT a AS r, b AS o FROM e UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.o = e.a),
c AS (SELECT reach.r AS r, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.o GROUP BY 1), n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, low) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, low) AS kept FROM v LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""


#: crc32 byte by byte: `t` is its table of 256 entries, made from the polynomial.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i)))"


def _crc(text: str) -> str:
    """SQL of a text's crc32, where crc.t is at hand."""
    byte = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {byte}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _runs(table: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"(SELECT *, ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS fs FROM (SELECT row_number() OVER () AS r, *, {words} AS ws FROM {table}))"


#: Near words by equi-joins: equal but for the code point at one place, or equal after one is left out.
OP11_SQL = rf"""WITH {_CRC_TABLE}, x AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id, run, count(*) AS n FROM x WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY 1, 2),
h AS (SELECT run, n, {_crc("id")} AS h FROM r, crc),
w AS (SELECT CASE WHEN h % {spelling.HURT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE n >= {spelling.LEAST_COUNT} AND length(word) >= {spelling.LEAST_LENGTH}),
p AS (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM p x JOIN p y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT y.word, x.word, x.n FROM p x JOIN v y ON x.a || x.b = y.word UNION SELECT x.word, y.word, y.n FROM p x JOIN v y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(m := -m, other := other)) AS other, max(m) AS m FROM near GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.FACTOR} * n THEN other END AS form, CASE WHEN m >= {spelling.FACTOR} * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last FROM f UNION ALL SELECT chain.word, form FROM chain JOIN f ON f.word = chain.last WHERE form IS NOT NULL),
root AS (SELECT chain.word, last FROM chain JOIN f ON f.word = chain.last WHERE form IS NULL)
SELECT word, form, last AS root, n, n_near, form_n FROM f JOIN root USING (word)""".replace("WITH ", "WITH RECURSIVE ", 1)


OP13_SQL = f"""WITH {_CRC_TABLE}, d AS {_runs("documents")}, e AS {_runs("benchmark")},
fd AS (SELECT r, g, count(*) AS n FROM (SELECT r, unnest(fs) AS g FROM d) GROUP BY 1, 2), fe AS (SELECT g, count(*) AS n FROM (SELECT unnest(fs) AS g FROM e) GROUP BY 1),
h AS (SELECT g, {_crc("g")} % {importance.BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM fd UNION SELECT g FROM fe), crc),
s AS (SELECT bucket, sum(n) AS s FROM fd JOIN h USING (g) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM fe JOIN h USING (g) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + {importance.BUCKETS}) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + {importance.BUCKETS})))) AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT r, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM fd JOIN h USING (g) JOIN gain USING (bucket) GROUP BY 1),
z AS (SELECT r, doc_id, CAST(len(fs) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= {importance.LEAST_WORDS} AS may,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM z WHERE may)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.PERCENT} * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": OP3_SQL, "op8_quality": OP8_SQL, "op11_spelling": OP11_SQL, "op12_vectors": OP12_SQL, "op13_importance": OP13_SQL}
