"""The operators over the test tables: thin queries that derive the digest columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, langid, linkgraph, mixing, ngram_join, pii, pseudolikelihood, sharding, spelling, toxicity, warc, whitening

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(m: int):
    """Remainder of the checksum of a key's decimal text."""
    return lambda k: F.crc32(F.encode(k.cast("string"), "UTF-8")) % m


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lambda k: fold(4)(k) == 2
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=held)
    out = toxicity.score(docs, weights)
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op2_pseudo_likelihood")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudolikelihood.score(docs, pseudolikelihood.fit(docs), keep_text=False).select("doc_id", "n_words", "log_likelihood", "mean_log_likelihood")


@query("op3_byte_shards")
def op3(spark, sf_dir):
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL["op4_dual_tree_top5"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op4_dual_tree_top5")
def op4(spark, sf_dir):
    return covertree.top_inner_products(table(spark, sf_dir, "embeddings"), lambda k: k % 50 == 0)


@query("op5_disclosing_terms")
def op5(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"), everywhere=True)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(F.encode(pii.span_list(pii.KINDS), "UTF-8"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.span_list().alias("spans"))


@query("op6_benchmark_leaks")
def op6(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_pivotal_mix")
def op7(spark, sf_dir):
    return mixing.mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op8_warc_zstd")
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    records = warc.all_sound(warc.archived(pages), pages.count())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_language_spans")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = lambda k: fold(3)(k) == 1
    model = langid.fit(docs, held_out=held)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_ngram_jaccard")
def op10(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def _spelling_sql() -> str:
    """Spelling variants as SQL: the checksum byte by byte over a table made by its rule, near words by what one deletion leaves."""
    byte = list(range(256))
    for _ in range(8):
        byte = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in byte]
    digit = "instr('0123456789ABCDEF', substr(hx, {}, 1)) - 1"
    left_out = "left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2)"
    return f"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) WHERE length(r) >= 5 GROUP BY ALL),
coded AS (SELECT run, c, hex(CAST(doc_id AS VARCHAR) || ':' || run) AS hx FROM runs),
summed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda i: CAST(16 * ({digit.format("i")}) + {digit.format("i + 1")} AS BIGINT))),
  lambda a, b: xor(a >> 8, CAST(list_extract({byte}, (xor(a, b) & 255) + 1) AS BIGINT))), 4294967295::BIGINT) AS h FROM coded),
words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM summed),
known AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS MATERIALIZED (SELECT word, n, i, {left_out} AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM known)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN known b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN known b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT k.word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM known k LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""


@query("op12_spelling_trie", _spelling_sql())
def op12(spark, sf_dir):
    return spelling.spelling_variants(spelling.letter_runs(table(spark, sf_dir, "documents")))


@query("op13_qdwh_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _url_sql() -> str:
    """The judgement of URLs as SQL: the rounds are written out one below the other, in the same whole numbers."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    last = "array_to_string(string_split(host, '.')[-{}:], '.')"
    link = linkgraph.LINK.replace("'", "''")
    steps = " UNION ".join(f"SELECT CASE WHEN labels > {j + 1} AND {j} < 8 THEN {last.format(j + 1)} ELSE host END AS a, {last.format(j)} AS b FROM named WHERE labels > {j}" for j in range(2, 9))
    rounds = "".join(f"""
r{i} AS MATERIALIZED (SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
  SELECT f.kind, f.dst AS host, CAST(floor(r.mass * f.share) AS BIGINT) AS mass FROM flow f JOIN r{i - 1} r ON f.kind = r.kind AND f.src = r.host
  UNION ALL SELECT kind, host, CAST(floor(mass * (1::DOUBLE - {linkgraph.DAMPING}::DOUBLE)) AS BIGINT) FROM r0) GROUP BY kind, host),""" for i in range(1, linkgraph.ROUNDS + 1))
    return f"""
WITH parts AS MATERIALIZED (SELECT page_id, html, {lower.format(f"regexp_extract(coalesce(url, ''), '{linkgraph.URL}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{linkgraph.URL}', 2) AS path FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
keys AS MATERIALIZED (SELECT DISTINCT host, path FROM parts),
fits AS MATERIALIZED (SELECT host, path, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule, first(rule_verdict ORDER BY length(rule_host || rule_path) DESC) AS verdict
  FROM keys JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
seeds AS MATERIALIZED (SELECT host, CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM parts JOIN fits USING (host, path) WHERE host <> '' GROUP BY ALL),
links AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {lower.format("x")}))) AS dst FROM parts) WHERE src <> '' AND src <> dst GROUP BY src, dst),
named AS MATERIALIZED (SELECT host, len(string_split(host, '.')) AS labels FROM (SELECT host FROM keys UNION SELECT src FROM links UNION SELECT dst FROM links) WHERE NOT regexp_matches(host, '{linkgraph.NUMERIC}')),
pairs AS MATERIALIZED ({steps}),
every AS (SELECT * FROM links UNION ALL SELECT a, b, 1 FROM pairs UNION ALL SELECT b, a, 1 FROM pairs),
weights AS (SELECT kind, src, dst, sum(w) AS w FROM (SELECT 'trust' AS kind, src, dst, w FROM every UNION ALL SELECT 'distrust', dst, src, w FROM every) GROUP BY kind, src, dst),
flow AS MATERIALIZED (SELECT kind, src, dst, {linkgraph.DAMPING}::DOUBLE * (w::DOUBLE / sum(w) OVER (PARTITION BY kind, src)::DOUBLE) AS share FROM weights),
r0 AS MATERIALIZED (SELECT kind, host, CAST(floor({linkgraph.UNIT}::DOUBLE * (n::DOUBLE / sum(n) OVER (PARTITION BY kind)::DOUBLE)) AS BIGINT) AS mass FROM seeds),{rounds}
shares AS (SELECT host, sum(CASE kind WHEN 'trust' THEN p ELSE 0 END) AS t, sum(CASE kind WHEN 'distrust' THEN p ELSE 0 END) AS s
  FROM (SELECT host, kind, mass::DOUBLE / sum(mass) OVER (PARTITION BY kind)::DOUBLE AS p FROM r{linkgraph.ROUNDS}) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN s / (s + t) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (host, path) LEFT JOIN shares USING (host)"""


@query("op11_link_graph", _url_sql())
def op11(spark, sf_dir):
    judged = linkgraph.judged_urls(table(spark, sf_dir, "pages"), linkgraph.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")
