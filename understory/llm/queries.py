"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.llm.bitsliced import top_k
from understory.llm.chat import Costs, format_chats
from understory.llm.decontaminate import benchmark_hits, contaminated
from understory.llm.filter_audit import audit_filters
from understory.llm.html_text import extract_text
from understory.llm.jaccard import jaccard_components, link_counts
from understory.llm.packing import Limits, pack
from understory.llm.quality import FactorisationMachine, learn, score_quality
from understory.llm.secrets import BASE_KINDS, scan_secrets, span_list
from understory.llm.suffixes import repeated_strings
from understory.llm.token_counts import token_counts
from understory.llm.url_rules import judge_urls
from understory.llm.zone_clusters import cluster_vectors
from understory.session import scratch_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

#: Documents of more tokens than this are flagged.
TOKEN_LIMIT = 1024
#: The closing id of a packed document.
END_ID = 2
PACK_LIMITS = Limits(tokens=4096, segments=1024, loss_tokens=4096)
#: Fixed values: host, path and verdict of the URL rules.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"), Costs(merge=1, relabel=3, insert=2, unknown=1))


@_query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership, _ = jaccard_components(_table(spark, sf_dir, "documents"), percent=75)
    return membership.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


LLM_ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS t FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d JOIN (SELECT v, min(t) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@_query
def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_jaccard_join with every link: the number of other documents each document links to."""
    counted = link_counts(*jaccard_components(_table(spark, sf_dir, "documents"), percent=75, complete=True))
    return counted.select(F.col("id").alias("doc_id"), "n_shingles", "n_links", "component_id")


LLM_ORACLES["op2_jaccard_links"] = LLM_ORACLES["op2_jaccard_join"].replace(
    "c.component_id\n", "CAST((SELECT count(*) FROM e WHERE e.a = d.doc_id) AS BIGINT) AS n_links, c.component_id\n")


def held_out(id_col: str = "doc_id"):
    """Rows that no label may be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learnt_quality(spark: SparkSession, sf_dir: str, docs: DataFrame) -> FactorisationMachine:
    """The classifier of these documents' labels, held-out rows apart."""
    return learn(docs, _table(spark, sf_dir, "labels").filter(~held_out()))


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learnt_quality(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)
    return found.withColumnRenamed("id", "vec_id")


LLM_ORACLES["op4_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), span=13)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


LLM_ORACLES["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n),
h AS (SELECT dp.doc_id, dp.i, dp.n, bg.item_id FROM dp JOIN bg ON bg.n = dp.n AND bg.g = array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id"""


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated_strings(_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(F.col("id").alias("doc_id"), (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
                       F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _number_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("id").alias("doc_id"),
        *[_number_of(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          scratch_path(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACK_LIMITS, END_ID)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@_query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules, default="allow").withColumnRenamed("id", "page_id")


LLM_ORACLES["op11_url_filter"] = r"""
WITH r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, v)),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT n, rh || rp AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) b ON b.n = p.n"""


@_query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256).withColumnRenamed("id", "vec_id")


def _nearest_sql(n: int, columns: str) -> str:
    """Nearest of the centroids c{n} for each vector."""
    distance = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return (f"SELECT {columns} FROM (SELECT v.r, v.vec_id, v.v, c.k, CAST({distance} AS BIGINT) AS d FROM v, c{n} c) t "
            "QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1")


def _clusters_sql(k: int, rounds: int, dims: int, scale: int) -> str:
    parts = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v AS c FROM v QUALIFY k < {k})"""]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({_nearest_sql(n, 'k, v')})")
        parts.append(f"m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {dims} + 1)) AS i FROM a{n}) GROUP BY k, i)")
        parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN
    (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{n} GROUP BY k) m ON m.k = c.k)""")
    parts.append(f"z AS MATERIALIZED ({_nearest_sql(rounds, 'vec_id, k, d')})")
    return ",\n".join(parts) + f"""
SELECT z.vec_id, CAST(z.k AS INTEGER) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c ON c.k = z.k"""


LLM_ORACLES["op12_centroid_clusters"] = _clusters_sql(40, 5, 64, 256)


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


LLM_ORACLES["op13_filter_audit"] = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END,
                    CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
                    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
                    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                    CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, o, step, f, n, good, toxic, fails, contains(fails, f) AS bad, earlier <> '' AND length(translate(earlier, fails, '')) < length(earlier) AS gone FROM n, s),
a AS (SELECT part, o, step, f, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY part, o, step, f)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a"""
