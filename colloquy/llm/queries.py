"""The thin queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether language ID keeps this document for the test: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    rows = assign_shards(_read(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), "words_sha256").alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    coded = encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import dedup_lines

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_records, resolve_revisits
    from .common import written

    pages = _read(spark, sf_dir, "pages")
    index = archive(pages)
    records = resolve_revisits(written(read_records(index.captures(spark), index.record_bytes), "warc-records"), index)
    id_type = pages.schema["page_id"].dataType
    return records.select(
        F.col("page_id").cast(id_type).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_neighbours

    return compare_neighbours(_read(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import find_components

    found = find_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_read(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(_read(spark, sf_dir, "embeddings")).drop("scanned")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, k, size FROM dw JOIN iw USING (size, win)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, sha256(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN first USING (h) WHERE least < doc_id)),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM lists)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT r, pos, text, ls[pos] AS line FROM (SELECT r, text, ls, unnest(range(1, len(ls) + 1)) AS pos FROM docs) WHERE trim(ls[pos], ' ') <> ''),
lf AS (SELECT r, pos, text, line, list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ms FROM ln),
leafed AS (SELECT r, pos, text, line, ms, concat(len(ms), ' ', array_to_string(ms[1:3], ' ')) AS leaf FROM lf),
leaves AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT text) >= 3),
own AS (SELECT * FROM leafed SEMI JOIN leaves USING (leaf)),
seen AS (SELECT DISTINCT leaf, line, ms, text FROM own),
words AS (SELECT leaf, line, text, i, ms[i] AS w FROM (SELECT leaf, line, text, ms, unnest(range(1, len(ms) + 1)) AS i FROM seen)),
constants AS (SELECT leaf, i, w FROM words WHERE w <> '<*>' GROUP BY leaf, i, w HAVING count(DISTINCT text) >= 3),
placed AS (SELECT d.leaf, d.line, d.i, c.w AS c FROM (SELECT DISTINCT leaf, line, i, w FROM words) d LEFT JOIN constants c USING (leaf, i, w)),
lines AS (SELECT leaf, line, string_agg(coalesce(c, '<*>'), ' ' ORDER BY i) AS template FROM placed GROUP BY leaf, line HAVING count(c) >= 0.7 * count(*)),
templates AS (SELECT leaf, template FROM seen JOIN lines USING (leaf, line) GROUP BY leaf, template HAVING count(DISTINCT text) >= 3),
gone AS (SELECT r, pos FROM own JOIN lines USING (leaf, line) SEMI JOIN templates USING (leaf, template)),
kept AS (SELECT r, string_agg(ls[p], chr(10) ORDER BY p) AS t FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS p FROM docs) a ANTI JOIN gone g ON a.r = g.r AND a.p = g.pos GROUP BY r),
n AS (SELECT r, count(*) AS n FROM ln GROUP BY r), g AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN n USING (r) LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (d)
"""

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM c GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
cs AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(cs.n, 0) AS c, 1 + (1000000000 * (coalesce(cs.n, 0) + 1)) // (coalesce(ns.n, 0) + v.v) AS p
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM cs GROUP BY ALL) ns USING (lang, source)
      LEFT JOIN cs USING (lang, source, term)),
q AS (SELECT cs.lang, cs.term, 1 + (1000000000 * (sum(n)::HUGEINT + 1)) // (any_value(total) + any_value(v)) AS q
      FROM cs JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM cs GROUP BY lang) USING (lang) GROUP BY cs.lang, cs.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
         UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200
"""


def _rounds_sql(rounds: int = 3) -> str:
    steps = [
        """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
vec AS (SELECT row_number() OVER () AS r, vec_id, x FROM kept),
e AS (SELECT r, unnest(x) AS v, unnest(range(64)) AS i FROM vec),
f AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM vec QUALIFY k < 16),
c0 AS (SELECT k, unnest(x) AS v, unnest(range(64)) AS i FROM f)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (SELECT r, k, s FROM (SELECT r, k, sum((e.v - c{n}.v) * (e.v - c{n}.v)) AS s FROM e JOIN c{n} USING (i) GROUP BY r, k)
       QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, k) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT k, i, sum(v) AS s, count(*) AS n FROM a{n} JOIN e USING (r) GROUP BY k, i),
c{n + 1} AS (SELECT k, i, CAST(coalesce((s - ((s % n) + n) % n) // n, v) AS BIGINT) AS v FROM c{n} LEFT JOIN m{n} USING (k, i))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN vec USING (r) JOIN (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) USING (k)
"""


OP13_SQL = _rounds_sql()

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_decontaminate": op3_decontaminate,
    "op4_remove_repeats": op4_remove_repeats,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_line_templates": op7_line_templates,
    "op8_warc_index": op8_warc_index,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash_components": op10_simhash_components,
    "op11_source_divergence": op11_source_divergence,
    "op12_packing": op12_packing,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLES = {
    "op3_decontaminate": OP3_SQL,
    "op4_remove_repeats": OP4_SQL,
    "op7_line_templates": OP7_SQL,
    "op8_warc_index": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
