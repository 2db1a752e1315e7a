"""The registered queries of the corpus operators, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, codes, fill_middle, fingerprint, html_text, jaccard, langid, licenses, lm, packing, pii, topk, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), n=3, p=90, q=100)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("id") % 20 == 0), k=20)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"), order=3)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_document_fingerprints,
        op3_ngram_jaccard_join,
        op4_license_scan,
        op5_personal_data,
        op6_main_text,
        op7_exact_top_k,
        op8_byte_bpe,
        op9_packing,
        op10_url_filter,
        op11_vector_codes,
        op12_lm_scores,
        op13_fill_middle,
    )
}

def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rounds of op11 one after the other, each from all parts anew."""
    apart = "CAST(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(parts.v, b.v)]) AS BIGINT)"
    steps = [
        f"""kept AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT vec_id, label, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS v FROM kept, range({parts}) AS t(p)
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT p, entry, v FROM parts JOIN firsts USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, p, any_value(label) AS label, any_value(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT vec_id, label, parts.p, parts.v, entry, {apart} AS d FROM parts JOIN b{r} b ON b.p = parts.p) GROUP BY vec_id, p
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT p, entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 4096) AS t(i) WHERE i <= len(v) GROUP BY p, entry, i) GROUP BY p, entry
), b{r + 1} AS (SELECT b.p, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.entry = b.entry)""")
    return f"""WITH {", ".join(steps)},
rows AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM rows, books"""


def url_filter_sql() -> str:
    """Rules, and decisions that reach aliases; links are read in their plain form (absolute, in double quotes, none in comments)."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = lambda x: f"CASE WHEN {x} LIKE '%://%' THEN substr({x}, strpos({x}, '://') + 3) ELSE '' END"
    host, path = lambda x: lower(f"regexp_extract({x}, '^([^/?#]*)', 1)"), lambda x: f"regexp_extract({x}, '^[^/?#]*([^?#]*)', 1)"
    node = lambda x: f"{host(x)} || coalesce(nullif({path(x)}, ''), '/') || regexp_extract({x}, '^[^?#]*(\\?[^#]*)', 1)"
    fits = lambda h, p: f"({h} = h OR ends_with({h}, '.' || h)) AND starts_with({p}, p)"
    return f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
cut AS (SELECT page_id, url, html, {rest("url")} AS rest FROM pages),
links AS (
  SELECT rest, unnest([regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), regexp_extract(html, '<meta http-equiv="refresh" content="[0-9]+; *url=([^"]*)"', 1)]) AS link FROM cut WHERE rest <> '' AND html IS NOT NULL
), pairs AS (SELECT {node("rest")} AS a, {node("goal")} AS b FROM (SELECT rest, {rest("link")} AS goal FROM links) WHERE goal <> ''),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
judged AS (
  SELECT node, verdict, row_number() OVER (PARTITION BY node ORDER BY length(h || p) DESC) AS r FROM (SELECT DISTINCT b AS node FROM edges) JOIN rules ON {fits(host("node"), path("node"))}
), inherited AS (
  SELECT a AS node FROM reach JOIN judged ON judged.node = reach.b AND r = 1 GROUP BY a HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
), own AS (
  SELECT page_id, url, rule, verdict FROM (
    SELECT DISTINCT page_id, url, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id, url ORDER BY length(h || p) DESC) AS r
    FROM (SELECT DISTINCT page_id, url, rest FROM cut) JOIN rules ON {fits(host("rest"), path("rest"))}) WHERE r = 1
)
SELECT cut.page_id, {host("cut.rest")} AS host, {path("cut.rest")} AS path, rule, coalesce(verdict, CASE WHEN inherited.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM cut LEFT JOIN own ON own.page_id = cut.page_id AND own.url IS NOT DISTINCT FROM cut.url LEFT JOIN inherited ON cut.rest <> '' AND inherited.node = {node("cut.rest")}"""


ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sizes
  UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(r.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT node, min(seen) AS least FROM reach GROUP BY node) r ON r.node = d.doc_id
""",
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op10_url_filter": url_filter_sql(),
    "op11_vector_codes": vector_codes_sql(),
    "op13_fill_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM units
), places AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), pieces AS (
  SELECT doc_id, t, n, form, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM places
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM pieces
""",
}
