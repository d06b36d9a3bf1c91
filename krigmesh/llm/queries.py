"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(spark, table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_digests

    return repeat_digests(spark, table(spark, sf_dir, "documents"), length=400, passage=200)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_store_digests

    return token_store_digests(spark, table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(spark, table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import link_counts

    return link_counts(spark, table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_ids": op3_token_ids,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
}

#: DuckDB SQL for the operators that SQL can express.
ORACLES: dict[str, str] = {
    "op1_ngram_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
i AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.at)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT n_shingles, min(r.at) component_id FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op2_suffix_dedup": """
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) x FROM documents), z AS (SELECT unnest([200, 400]) z),
p AS (SELECT doc_id, z, unnest(range(0, len(x) // 2 - z + 1)) i FROM h, z WHERE len(x) >= 2 * z),
k AS (SELECT p.doc_id, z, i, md5(substring(x, 2 * i + 1, 2 * z)) m FROM p JOIN h USING (doc_id)),
m AS (SELECT z, m FROM k GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT doc_id, z, i FROM k JOIN m USING (z, m)),
e AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id, z ORDER BY i) + z, true)::INT new FROM c),
g AS (SELECT doc_id, z, i, sum(new) OVER (PARTITION BY doc_id, z ORDER BY i) g FROM e),
r AS (SELECT doc_id, z, g, min(i) lo, max(i) + z hi FROM g GROUP BY 1, 2, 3),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) after, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) nxt FROM r WHERE z = 400),
t AS (SELECT doc_id, string_agg(substring(x, 2 * after + 1, 2 * (lo - after)) || CASE WHEN nxt IS NULL THEN substring(x, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) kept, sum(hi - lo)::BIGINT gone, count(*) n FROM q JOIN h USING (doc_id) GROUP BY 1),
s AS (SELECT doc_id, sum(hi - lo)::BIGINT b, count(*) n FROM r WHERE z = 200 GROUP BY 1)
SELECT doc_id, (len(x) // 2)::BIGINT n_bytes, coalesce(gone, 0)::BIGINT n_removed, coalesce(t.n, 0)::BIGINT n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256,
 coalesce(b, 0)::BIGINT passage_bytes, coalesce(s.n, 0)::BIGINT passage_spans, b IS NOT NULL repeats_passage FROM h LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
r AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT vec_id, min(node) component_id FROM r GROUP BY 1), d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)""",
}
