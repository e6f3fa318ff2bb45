"""The corpus operators' queries: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, table
from .contexttree import score_texts
from .jaccard import link_documents
from .licences import scan_licences
from .mixing import mix_sources
from .pieces import encode_samples
from .quality import classify_quality
from .rules import quality_rules
from .toxicity import grade_toxicity
from .vectors import link_vectors
from .warc import archive


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say once read back; of stored payloads, length and digest are taken anew."""
    back = archive(table(spark, sf_dir, "pages"))
    return back.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"), F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", "refers_to", "url")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and sample; the pieces as their number and a hash, the text decoded from them as length and digest."""
    rows = encode_samples(table(spark, sf_dir, "documents"), spelled=True)
    return rows.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("pieces_hash"), "log_prob", "perturbed", "inclusion", "text_bytes", "text_digest")


def _on_executors(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_licences": op1_licences,
    "op2_vectors": op2_vectors,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_rules": op6_rules,
    "op7_context_tree": op7_context_tree,
    "op8_jaccard": op8_jaccard,
    "op9_warc": op9_warc,
    "op10_pieces": op10_pieces,
}
QUERIES = {name: _on_executors(query) for name, query in QUERIES.items()}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NUMBER = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"

ORACLE_SQL: dict[str, str] = {
    # All pairs, and reachability by recursion.
    "op2_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings),
        good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id a, b.vec_id b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.c = l.a),
        head AS (SELECT vec_id, min(c) c FROM reach GROUP BY 1), n AS (SELECT a, count(*) k FROM links GROUP BY 1)
        SELECT v.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v JOIN head ON v.vec_id = head.vec_id LEFT JOIN n ON v.vec_id = n.a""",
    # Blocks are given out one by one over all quotients; a shard's blocks likewise.
    "op5_mixing": rf"""
        WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) ss, row_number() OVER (ORDER BY source IS NULL, source) rk FROM z GROUP BY source),
        w AS (SELECT *, (rk - 1) % 3 + 1 AS weight, 3 * ss AS cap, CAST(sum(ss) OVER () AS BIGINT) tot FROM s),
        u AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, rk ROWS UNBOUNDED PRECEDING) - cap AS fb, sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) wf FROM w),
        f AS (SELECT *, CAST(tot - fb AS DOUBLE) / CAST(wf AS DOUBLE) lev FROM u),
        t AS (SELECT *, CASE WHEN cap / weight <= lev THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT min_by(lev, cap / weight) FROM f WHERE cap / weight > lev) END target FROM f),
        p AS (SELECT *, CAST(greatest(1, least(64, floor((SELECT min(ss) FROM t WHERE ss > 0) / 100))) AS BIGINT) b, CAST(greatest(1, ceil(ss / greatest(65536, tot / 50000))) AS BIGINT) shards FROM t),
        seat AS (SELECT rk, tot // b AS n, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rk, k) pos FROM p, LATERAL (SELECT unnest(generate_series(0, tot // b)) k) WHERE target > 0),
        won AS (SELECT rk, count(*) seats FROM seat WHERE pos <= n GROUP BY rk),
        d AS (SELECT z.doc_id, size, p.*, md5(concat_ws(':', '17', CAST(z.doc_id AS VARCHAR))) h, {_NUMBER.format("concat_ws(':', '17', CAST(z.doc_id AS VARCHAR))")} % shards AS shard FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source),
        q AS (SELECT rk, shard, any_value(source) source, any_value(b) b, any_value(ss) ss, any_value(target) target, CAST(sum(size) AS BIGINT) AS words, (CAST(sum(size) AS BIGINT) + any_value(b) - 1) // any_value(b) AS blocks FROM d GROUP BY rk, shard),
        qs AS (SELECT q.rk, shard, k, row_number() OVER (PARTITION BY q.rk ORDER BY blocks / (2 * k + 1) DESC, shard, k) pos
               FROM q, LATERAL (SELECT unnest(generate_series(0, 3 * blocks)) k)),
        lim AS (SELECT q.rk, CASE WHEN any_value(target) >= 3 * any_value(ss) THEN 3 * CAST(sum(blocks) AS BIGINT) ELSE least(any_value(coalesce(seats, 0)), 3 * CAST(sum(blocks) AS BIGINT)) END lim FROM q LEFT JOIN won ON q.rk = won.rk GROUP BY q.rk),
        quota AS (SELECT q.rk, q.shard, q.blocks, q.source, q.words, q.b, count(pos) FILTER (pos <= lim.lim) seats FROM q JOIN lim ON q.rk = lim.rk LEFT JOIN qs ON q.rk = qs.rk AND q.shard = qs.shard GROUP BY ALL),
        r AS (SELECT *, least(seats * b, 3 * words) // greatest(words, 1) AS full_passes, least(seats * b, 3 * words) % greatest(words, 1) // b AS picked,
                     {_NUMBER.format("concat_ws(':', '17-start', coalesce(source, ''), CAST(shard AS VARCHAR))")} % greatest(blocks, 1) AS start FROM quota),
        o AS (SELECT d.*, r.blocks, full_passes, picked, start, CAST(sum(size) OVER (PARTITION BY d.rk, d.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) hi FROM d JOIN r ON d.rk = r.rk AND d.shard = r.shard),
        x AS (SELECT *, hi - size AS lo FROM o),
        y AS (SELECT *, {{hi}} AS before_hi, {{lo}} AS before_lo FROM x)
        SELECT doc_id, size, ss AS source_size, target, CAST(full_passes * size + before_hi - before_lo AS BIGINT) AS taken, source, weight FROM y""".format(
        **{at: f"CASE WHEN picked = 0 THEN 0 WHEN {at} >= blocks * b THEN picked * b ELSE ((({at} // b) * picked + start) // blocks) * b + CASE WHEN ((({at} // b) + 1) * picked + start) // blocks > (({at} // b) * picked + start) // blocks THEN {at} % b ELSE 0 END END" for at in ("hi", "lo")}
    ),
    "op8_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END g FROM d),
        e AS (SELECT doc_id, len(g) n, unnest(g) g FROM s),
        pair AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n) + any_value(b.n) m, count(*) k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pair WHERE 100 * k >= 80 * (m - k)),
        reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.c = l.a)
        SELECT s.doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> head THEN head END AS refers_to, url
        FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest""",
}
