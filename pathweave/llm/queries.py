"""Queries over the corpus tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import alignment, decontam, fingerprint, html_main, line_dedup, ngram_join, packing, pii, quality, scratch, suffix_dedup, url_filter, vector_codes, warc

URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "doc_id", (quality.remainder() == quality.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=False))
    refers = F.regexp_extract(F.element_at("response.fields", "warc-refers-to"), r"^<urn:page:(-?\d+)>$", 1)
    return captures.select(
        F.element_at("metadata.fields", "pageId").cast("bigint").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(refers != "", refers).cast("bigint").alias("refers_to"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the base spans; ``spans`` are all."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return pii.find_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(kind) for kind in pii.KINDS], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    own, other = made.rows.alias("own"), made.rows.groupBy("label").agg(F.sum("error").alias("label_error")).alias("other")
    return own.join(other, F.col("own.label").eqNullSafe(F.col("other.label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op10_fingerprint": op10_fingerprint, "op11_alignment": op11_alignment, "op12_pii": op12_pii, "op13_vector_codes": op13_vector_codes, "op2_decontam": op2_decontam, "op3_line_dedup": op3_line_dedup, "op4_html_main": op4_html_main, "op5_suffix_dedup": op5_suffix_dedup, "op6_packing": op6_packing, "op7_warc": op7_warc, "op8_url_filter": op8_url_filter, "op9_ngram_join": op9_ngram_join}


ORACLE = {
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, k, line, list_filter(regexp_split_to_array(lower(line), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)),
s AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, i, i + 4), ' ') AS t FROM (SELECT doc_id, k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM l WHERE len(w) >= 1)),
n AS (SELECT doc_id, k, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT a.doc_id, a.k, b.doc_id AS d2, b.k AS k2, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.k < a.k) GROUP BY ALL),
g AS (SELECT DISTINCT o.doc_id, o.k FROM o JOIN n x ON x.doc_id = o.doc_id AND x.k = o.k JOIN n y ON y.doc_id = d2 AND y.k = k2 WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL) AS text, count(*) AS n_lines, count(g.k) AS n_removed
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op2_decontam": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op8_url_filter": r"""
WITH r(verdict, host, path) AS (VALUES ('block','com','/en/'),('allow','example.com','/en/7'),('allow','net','/de/'),('block','example.net','/de/8'),('block','org','/es/')),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT q.page_id, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM q LEFT JOIN m ON m.page_id = q.page_id AND m.k = 1""",
}


def _vector_codes_sql(rounds: int = 2) -> str:
    """Plain Lloyd rounds: every distance of every part."""
    distance = "list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "SELECT p.r, p.s, min(64 * {d} + c.e) AS m FROM p JOIN c{k} c ON c.s = p.s GROUP BY p.r, p.s"
    moved = """SELECT c.s, c.e, coalesce(q.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT s, e, list(CAST((t - (t % n + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p.s, m % 64 AS e, i, sum(p.x[i]) AS t, count(*) AS n FROM p JOIN a{k} a ON a.r = p.r AND a.s = p.s, w, range(1, w.w + 1) u(i) GROUP BY ALL) GROUP BY s, e) q ON q.s = c.s AND q.e = c.e"""
    steps = "".join(f", a{k} AS ({nearest.format(d=distance, k=k)}), c{k + 1} AS ({moved.format(k=k)})" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // 16 AS w FROM kept), p AS MATERIALIZED (SELECT r, s, list_slice(v, s * w + 1, (s + 1) * w) AS x FROM kept, w, range(16) t(s)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64), c0 AS (SELECT p.s, first.e, p.x AS c FROM p JOIN first ON first.r = p.r){steps},
a AS ({nearest.format(d=distance, k=rounds)}), f AS (SELECT r, string_agg(format('{{:02x}}', m % 64), '' ORDER BY s) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY s, e)) FROM c{rounds}) AS codebooks_sha256 FROM f JOIN kept ON kept.r = f.r"""


ORACLE["op13_vector_codes"] = _vector_codes_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
