"""The registered queries: each applies one operator to its whole table and gives its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, find_secrets, span_text

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    kinds = [kind for kind, *_ in BASE]
    base = F.filter("secret_spans", lambda s: s["kind"].isin(kinds))

    def number(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("secret_spans")).alias("spans"),
    )


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import find_contamination

    return find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similar import component_ids

    return component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, remainder(10) != 0, keep=["doc_id"]).withColumn("held_out", remainder(10) == 0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality, with_features

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder(3) != 1)
    model = fit_quality(with_features(docs).join(labels, "doc_id"))
    return score_quality(docs, model).select(
        "doc_id",
        (remainder(3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
        "quality_strength",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(4) != 2)
    return score_toxicity(docs, fit_toxicity(docs, labels)).select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_language, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.where(remainder(4) != 2))
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_accepted").alias("accepted"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restore

    turned = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tailward.session import stage

    from .codebooks import books_digest, compress, label_totals

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = stage(coded, "coded")
    return label_totals(coded).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .bytepairs import Ranks, decode_ids, encode_texts, load_ranks

    ranks = Ranks(load_ranks(path("byte_bpe_multi_50k.tiktoken")))
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ranks.little_endian(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_secret_scan, op3_contamination, op4_similar_texts, op5_class_model, op6_quality, op7_packing, op8_toxicity, op9_language_id, op10_main_text, op11_fill_in_middle, op12_vector_codes, op13_byte_pairs)}
def vector_codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The codebooks' rounds as chained tables; a squared distance is x.x - 2 x.e + e.e, exact on whole numbers."""
    steps = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, vec) AS row, * FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec FROM embeddings
                WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))
        )""",
        f"""cut AS MATERIALIZED (
            SELECT row, p, vec[p * len(vec) // {parts} + 1:(p + 1) * len(vec) // {parts}] AS x FROM kept, range({parts}) AS parts(p)
        )""",
        f"book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS y FROM cut WHERE row <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
            SELECT row, p, x, min_by(e, d * {entries} + e) AS e, min(d) AS d FROM (
                SELECT row, p, x, e, list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS d FROM cut JOIN book{k} USING (p))
            GROUP BY row, p, x
        )""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
                SELECT p, e, list(m ORDER BY pos) AS y FROM (
                    SELECT p, e, pos, floor(sum(v) / count(*)) AS m FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM near{k}) GROUP BY p, e, pos)
                GROUP BY p, e
            )""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.y, book{k}.y) AS y FROM book{k} LEFT JOIN mean{k} USING (p, e))")
    return f"""
        WITH {", ".join(steps)}, coded AS (
            SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (row), digest
    """


ORACLES: dict[str, str] = {
    "op11_fill_in_middle": """
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                sha256('1:' || CAST(doc_id AS VARCHAR)) AS digest
            FROM documents
        ), drawn AS (
            SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
                CAST('0x' || digest[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || digest[9:16] AS BIGINT) % (len(units) + 1) AS b,
                CAST('0x' || digest[17:24] AS BIGINT) % 100 AS c, CAST('0x' || digest[25:32] AS BIGINT) % 100 AS d
            FROM units
        ), parts AS (
            SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
                array_to_string(units[greatest(a, b) + 1:], '') AS suffix,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
                    WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        )
        SELECT doc_id, n, form,
            CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
    "op12_vector_codes": vector_codes_sql(),
}
