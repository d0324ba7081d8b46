"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .url_filter import SUFFIXES

#: The rules of op1 (host/path, verdict).
OP1_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else empirical-Bayes host reputation, for every page; the outcome of page p is the quality label of id p."""
    from .url_filter import filter_urls

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, OP1_RULES)


OP1_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rule_host, rule_path, rule, rule_verdict) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
    ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
hp AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT host, path, rule, rule_verdict FROM hp JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) = 1),
l AS (SELECT *, string_split(host, '.') AS labels, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) AS long FROM p),
h AS (SELECT host, list_aggregate(list_slice(labels, CASE WHEN long THEN -3 ELSE -2 END, -1), 'string_agg', '.') AS domain, list_aggregate(list_slice(labels, CASE WHEN long THEN -2 ELSE -1 END, -1), 'string_agg', '.') AS suffix,
    count(quality) AS n, coalesce(sum(quality), 0) AS k FROM l LEFT JOIN (SELECT * FROM labels WHERE quality IS NOT NULL) v ON v.doc_id = l.page_id GROUP BY 1, 2, 3),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY 1),
a AS (SELECT sum(n) AS an, sum(k) AS ak FROM h),
q0 AS (SELECT sn AS n, sk / sn AS x, ak / an AS r FROM s, a WHERE sn > 0),
q1 AS (SELECT dn AS n, dk / dn AS x, sk / sn AS r FROM d JOIN s USING (suffix) WHERE dn > 0),
q2 AS (SELECT n, k / n AS x, dk / dn AS r FROM h JOIN d USING (domain) WHERE n > 0),
q AS (SELECT 0 AS level, * FROM q0 UNION ALL SELECT 1, * FROM q1 UNION ALL SELECT 2, * FROM q2),
e AS (SELECT level, CASE WHEN sum((n - 1) * r * (1 - r)) > 0
    THEN least(0.5::DOUBLE, greatest(0.0001::DOUBLE, (sum(n * (x - r) * (x - r)) - sum(r * (1 - r))) / sum((n - 1) * r * (1 - r)))) ELSE 0.1::DOUBLE END AS rho FROM q GROUP BY 1),
c AS (SELECT 1 / coalesce(max(rho) FILTER (level = 0), 0.1::DOUBLE) - 1 AS s0, 1 / coalesce(max(rho) FILTER (level = 1), 0.1::DOUBLE) - 1 AS s1,
    1 / coalesce(max(rho) FILTER (level = 2), 0.1::DOUBLE) - 1 AS s2 FROM e),
m1 AS (SELECT suffix, (sk + s0 * ((ak + 0.5::DOUBLE) / (an + 1))) / (sn + s0) AS m1 FROM s, a, c),
m2 AS (SELECT domain, (dk + s1 * m1) / (dn + s1) AS m2 FROM d JOIN m1 USING (suffix), c),
m3 AS (SELECT host, n + s2 AS w, (k + s2 * m2) / (n + s2) AS m FROM h JOIN m2 USING (domain), c),
b0 AS (SELECT host, m, m * w AS a, (1 - m) * w AS b FROM m3), b1 AS (SELECT *, ln(a / b) - greatest(sqrt(1 / a + 1 / b) * 8, 16 / a) AS low, ln(a / b) + greatest(sqrt(1 / a + 1 / b) * 8, 16 / b) AS high FROM b0),
b2 AS (SELECT *, i, low + (high - low) / 256 * i AS u FROM b1, range(0, 257) g(i)), b3 AS (SELECT *, exp(a * (-ln(1 + exp(-u)) - ln(m)) + b * (-ln(1 + exp(u)) - ln(1 - m))) AS f FROM b2),
b4 AS (SELECT host, m, low, high, i, (f + lead(f) OVER (PARTITION BY host ORDER BY i)) / 2 AS part FROM b3 QUALIFY i < 256),
b5 AS (SELECT *, sum(part) OVER (PARTITION BY host ORDER BY i) AS upto, sum(part) OVER (PARTITION BY host) * 0.95::DOUBLE AS goal FROM b4),
rep AS (SELECT host, m AS good_rate, 1 / (1 + exp(-(low + (high - low) / 256 * (i + (goal - (upto - part)) / part)))) AS bound FROM b5 WHERE upto >= goal QUALIFY row_number() OVER (PARTITION BY host ORDER BY i) = 1)
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, CASE WHEN bound < 0.75 * (SELECT (ak + 0.5::DOUBLE) / (an + 1) FROM a) THEN 'block' ELSE 'allow' END) AS verdict,
    round(good_rate, 6) AS good_rate, round(bound, 6) AS bound
FROM p LEFT JOIN best USING (host, path) LEFT JOIN rep ON rep.host = p.host
"""

def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, looks the captures of all their urls up in the index, and reads the records by their ranges."""
    from .warc import archive, find, keyed, read_records

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    directory = archive(pages, min_bytes=0)
    return read_records(find(keyed(pages), directory)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32: every five hexadecimal digits are four letters.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, k // 4 * 5 + 1, 5))::INT >> (15 - k % 4 * 5)) % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of every hundredth vector with all others."""
    from .topk import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 100 = 0"))


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM e q JOIN e d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    from .language import identify, learn_profiles

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = learn_profiles(docs.where("not held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def held_out():
    """crc32 of the doc_id's text (empty if null) leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    from .simhash import hexed, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hexed().alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and network findings in every document; the network learns from at most 4,000 of them, in about 100,000 documents, and
    from plants in 4,000 contexts."""
    from .secrets import labelled_findings, scan_secrets, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = labelled_findings(docs)
    found = scan_secrets(docs, train([w for w, _ in examples], [y for _, y in examples])).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"] != "net")
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in every document, with matched coverage and spans."""
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets by the cube method."""
    from .mixing import mix, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(docs.withColumnRenamed("size", "words"), size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huffman-coded token files of all documents, written and read back."""
    import public_tokenizers

    from .token_output import read_files, token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_files(token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, remembered=1_200_000))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document, with its alignment score."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled documents that aren't held out (20,000 at most)."""
    from .quality import learn_quality, score_quality

    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~out)
    found = score_quality(docs.withColumn("held_out", out), learn_quality(docs, labels))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, with corpus-wide counts of id pairs."""
    import public_tokenizers

    from .alignment import align_tokenizers

    found = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations by their keys' CRC-32 and repairs them at least cost."""
    from .conversations import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"))


#: The same by a recursive query: by state the least text of cost and audit, row by row, an insert before each row and one at the end.
OP13_SQL = r"""
WITH RECURSIVE
c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b FROM conversations),
c1 AS (SELECT * EXCLUDE (b), list_transform(range(0, octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::INT + 1, 2))::BIGINT) AS bytes FROM c0),
c2 AS (SELECT * EXCLUDE (bytes), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: list_reduce(list_prepend(xor(c, v), range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 20 AS kind FROM c1),
c3 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c2),
c4 AS (SELECT *, row_number() OVER w AS k, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM c3 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c5 AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM c4),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM c5 GROUP BY conv_id),
nxt(s, i, t, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
wanted AS (SELECT s, t, role FROM nxt WHERE i <> 's'),
lead0 AS (SELECT s, s AS m, 0 AS cost, '' AS let, NULL::VARCHAR AS ins FROM (SELECT DISTINCT s FROM nxt) UNION ALL SELECT s, t, 3, 'I', role FROM wanted),
step AS (
    SELECT l.s, l.m AS t, l.cost + 4 AS cost, l.let || 'D' AS let, ['b', 'd', 't', ''] AS faults, NULL::VARCHAR AS initial, l.ins, NULL::VARCHAR AS new FROM lead0 l
    UNION ALL SELECT l.s, n.t, l.cost, l.let || 'K', ['t', ''], n.i, l.ins, NULL FROM lead0 l JOIN nxt n ON n.s = l.m
    UNION ALL SELECT l.s, w.t, l.cost + 3, l.let || 'R', ['t', ''], NULL, l.ins, w.role FROM lead0 l JOIN wanted w ON w.s = l.m),
walk AS (
    SELECT conv_id, 0::BIGINT AS k, 0 AS s, '00000000' AS best, []::VARCHAR[] AS lines FROM facts
    UNION ALL
    (SELECT c.conv_id, c.k, p.t, min(lpad((left(w.best, 8)::INT + p.cost + CASE WHEN c.fault = 't' AND p.let NOT LIKE '%D' THEN 3 ELSE 0 END)::VARCHAR, 8, '0') || substr(w.best, 9) || p.let),
        arg_min(w.lines || CASE WHEN p.ins IS NULL THEN [] ELSE [p.ins || ':'] END || CASE WHEN p.let LIKE '%D' THEN [] ELSE [coalesce(p.new, c.role) || ':' || c.text] END,
            lpad((left(w.best, 8)::INT + p.cost + CASE WHEN c.fault = 't' AND p.let NOT LIKE '%D' THEN 3 ELSE 0 END)::VARCHAR, 8, '0') || substr(w.best, 9) || p.let)
    FROM walk w JOIN c5 c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.k = w.k + 1 JOIN step p ON p.s = w.s AND list_contains(p.faults, c.fault) AND (p.initial IS NULL OR p.initial = c.initial)
    GROUP BY c.conv_id, c.k, p.t)),
done AS (
    SELECT conv_id, best, lines FROM walk w JOIN facts f USING (conv_id) WHERE w.k = f.n AND w.s IN (0, 3)
    UNION ALL SELECT conv_id, lpad((left(best, 8)::INT + 3)::VARCHAR, 8, '0') || substr(best, 9) || 'I', lines || ['assistant:'] FROM walk w JOIN facts f USING (conv_id) WHERE w.k = f.n AND w.s = 2),
picked AS (SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM done GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(left(best, 8)::BIGINT, 0) AS cost, coalesce(substr(best, 9), '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN facts f USING (conv_id) LEFT JOIN picked p USING (conv_id)
"""


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_warc, op3_topk, op4_language, op5_simhash, op6_secrets, op7_licenses, op8_mix, op9_token_output, op10_decontaminate, op11_quality, op12_alignment, op13_conversations)}
ORACLES = {"op1_url_filter": OP1_SQL, "op2_warc": OP2_SQL, "op3_topk": OP3_SQL, "op13_conversations": OP13_SQL}
