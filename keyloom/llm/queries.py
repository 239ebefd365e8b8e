"""The registered query of each operator, with production parameters over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, jaccard, language, media, packing, preference, secrets, toxicity, urls, wordpiece


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int):
    """crc32 of the id as text, by which rows are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_toxicity(spark, sf_dir):
    """See ``toxicity``; learns from labelled rows of two folds of three, scores every document and locates its offending sentences."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = toxicity.score(docs, model, bits=18, sentences=True)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", "sentences")


def op2_ngram_jaccard_join(spark, sf_dir):
    """See ``jaccard.join``: 4-word shingles, Jaccard of 0.85 or more; one row per document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    """See ``language``; learns from three folds of four, and predicts every document."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, remainder(4) != 2)
    return language.predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_preference_formatting(spark, sf_dir):
    """See ``preference``. The table has no rejected replies: a conversation's rejected side repeats its reply before the last."""
    talks = preference.conversations(table(spark, sf_dir, "conversations"))
    pairs = talks.select("id", F.col("turns").alias("chosen"), preference.stale_reply(F.col("turns")).alias("rejected"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(spans)

    return preference.format_pairs(pairs).select(F.col("id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


def op5_secret_scans(spark, sf_dir):
    """See ``secrets``; one row per document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, words=secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_best_fit_packing(spark, sf_dir):
    """See ``packing.pack``; one row per piece."""
    tokenizer_file, rank_file = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), rank_file, tokenizer_file=tokenizer_file)


def op10_benchmark_decontamination(spark, sf_dir):
    """See ``decontaminate.scan``; one row per document."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_token_counts(spark, sf_dir):
    """See ``wordpiece.counts``; one row per document."""
    return wordpiece.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filter(spark, sf_dir):
    """See ``urls.judge``; one row per page."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op9_media_columns(spark, sf_dir):
    """See ``media.media_rows``; one row per document."""
    return media.media_rows(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard_join, op3_language_id, op4_preference_formatting, op5_secret_scans, op6_best_fit_packing, op7_token_counts, op8_url_filter, op9_media_columns, op10_benchmark_decontamination)}

WORDS10 = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL10 = rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS10.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iwin AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
dw AS (SELECT doc_id, {WORDS10.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM iwin),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
hit AS (SELECT doc_id, dwin.m, i, item FROM dwin JOIN iwin USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i) WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""

SQL4 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
n AS (SELECT conv_id, max(i) AS n, max(i) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
before AS (SELECT conv_id, max(i) AS i FROM t JOIN n USING (conv_id) WHERE role = 'assistant' AND i < last GROUP BY conv_id),
rej AS (SELECT t.conv_id, t.i, t.role, CASE WHEN t.i = last THEN coalesce((SELECT o.text FROM before JOIN t o USING (conv_id, i) WHERE o.conv_id = t.conv_id), '') ELSE t.text END AS text
  FROM t JOIN n USING (conv_id) WHERE last IS NULL OR t.i <= last),
differ AS (SELECT conv_id, min(i) AS i FROM t FULL JOIN rej r USING (conv_id, i) WHERE t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(differ.i - 1, n) AS k FROM n LEFT JOIN differ USING (conv_id)),
parts AS (SELECT conv_id, i, CASE WHEN i <= k THEN 'prompt' ELSE 'chosen' END AS side, role, text FROM t JOIN p USING (conv_id) UNION ALL
  SELECT conv_id, i, 'rejected', role, text FROM rej JOIN p USING (conv_id) WHERE i > k),
made AS (SELECT conv_id, i, side, role, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(text, '<|', '< |') AS body FROM parts),
placed AS (SELECT *, head || body || '<|end|>' || chr(10) AS whole, length(head) + coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM made),
sides AS (SELECT conv_id, side, string_agg(whole, '' ORDER BY i) AS whole, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(body) + 7 AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (role = 'assistant') AS spans FROM placed GROUP BY ALL)
SELECT p.conv_id, CAST(k AS INTEGER) AS prompt_turns, coalesce(a.whole, '') AS prompt, coalesce(b.whole, '') AS chosen, coalesce(c.whole, '') AS rejected, coalesce(b.spans, '') AS chosen_spans, coalesce(c.spans, '') AS rejected_spans
FROM p LEFT JOIN sides a ON a.conv_id = p.conv_id AND a.side = 'prompt' LEFT JOIN sides b ON b.conv_id = p.conv_id AND b.side = 'chosen' LEFT JOIN sides c ON c.conv_id = p.conv_id AND c.side = 'rejected'
"""

SQL8 = r"""
WITH rules(verdict, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
r0 AS (SELECT page_id, row_number() OVER () AS id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r1 AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM r0),
r2 AS (SELECT page_id, id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM r1),
fit AS (SELECT id, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS ruled FROM r2 JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id),
b AS (SELECT r2.*, rule, ruled, substr(md5(host || path), 1, 1) < '4' AS held, '^^' || regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9./\-_~%=&+]', '*', 'g') || '$' AS s FROM r2 LEFT JOIN fit USING (id)),
g AS (SELECT id, ruled, held, substr(s, i, 3) AS g FROM b, LATERAL (SELECT unnest(range(1, length(s) - 1)) AS i)),
seen AS (SELECT g, substr(g, 1, 2) AS ab, substr(g, 2, 2) AS bc, count(*) FILTER (ruled = 'allow' AND NOT held) AS a, count(*) FILTER (ruled = 'block' AND NOT held) AS k FROM g GROUP BY g),
pairs AS (SELECT bc, substr(bc, 1, 1) AS b, substr(bc, 2, 1) AS c, sum(a) AS a, sum(k) AS k FROM seen GROUP BY bc),
singles AS (SELECT c, sum(a) AS ca, sum(k) AS ck FROM pairs GROUP BY c),
whole AS (SELECT sum(ca) AS na, sum(ck) AS nk FROM singles),
ub AS (SELECT b, sum(a) AS ba, sum(k) AS bk, count(*) FILTER (a > 0) AS ta, count(*) FILTER (k > 0) AS tk FROM pairs GROUP BY b),
uab AS (SELECT ab, sum(a) AS aa, sum(k) AS ak, count(*) FILTER (a > 0) AS taa, count(*) FILTER (k > 0) AS tak FROM seen GROUP BY ab),
low AS (SELECT bc, CASE WHEN ba > 0 THEN (a + ta * ((ca + 1.0::DOUBLE) / (na + 47))) / (ba + ta) ELSE (ca + 1.0::DOUBLE) / (na + 47) END AS pa, CASE WHEN bk > 0 THEN (k + tk * ((ck + 1.0::DOUBLE) / (nk + 47))) / (bk + tk) ELSE (ck + 1.0::DOUBLE) / (nk + 47) END AS pk
  FROM pairs JOIN ub USING (b) JOIN singles USING (c), whole),
v AS (SELECT g, CAST(round((ln(CASE WHEN aa > 0 THEN (a + taa * pa) / (aa + taa) ELSE pa END) - ln(CASE WHEN ak > 0 THEN (k + tak * pk) / (ak + tak) ELSE pk END)) * 1000000) AS BIGINT) AS v FROM seen JOIN uab USING (ab) JOIN low USING (bc)),
sc AS (SELECT id, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS ratio FROM g JOIN v USING (g) GROUP BY id),
bins AS (SELECT CAST(floor(ratio / 10000.0) AS BIGINT) AS bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS k FROM sc JOIN b USING (id) WHERE ruled IS NOT NULL AND held GROUP BY 1),
cum AS (SELECT bin, sum(a) OVER () AS sa, sum(k) OVER () AS sk, coalesce(sum(a) OVER w, 0) AS ua, coalesce(sum(k) OVER w, 0) AS uk FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT arg_max(bin, (uk * sa - ua * sk, -bin)) * 10000 AS t FROM cum WHERE sa > 0 AND sk > 0),
lim AS (SELECT CASE WHEN na > 0 AND nk > 0 THEN coalesce((SELECT max(t) FROM best), 0) END AS t FROM whole)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN t IS NULL OR ratio >= t THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN ruled IS NULL AND t IS NOT NULL THEN ratio END AS ratio
FROM b JOIN sc USING (id), (SELECT max(t) AS t FROM lim)
"""

ORACLE = {"op4_preference_formatting": SQL4, "op8_url_filter": SQL8, "op2_ngram_jaccard_join": SQL2, "op10_benchmark_decontamination": SQL10}
