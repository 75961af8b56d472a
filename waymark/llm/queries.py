"""Registered queries of the operators in this folder, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.mixing import QUERY_TARGETS, draw
from waymark.llm.mixing import oracle_sql as mixing_sql
from waymark.llm.secret_scan import oracle_sql as secrets_sql

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its name; ``sql`` is what DuckDB must agree with."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 85 % of their 4-word shingles, by component."""
    from waymark.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by models of the labelled ones outside fold 2."""
    from waymark.llm.toxicity import fold, with_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles at 80 % of its words."""
    from waymark.llm.line_dedup import without_repeated_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs, removed="n_removed")


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its equals."""
    from waymark.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the token files written of all."""
    import public_tokenizers

    from waymark.llm.token_files import read_token_files, write_token_files
    from waymark.session import scratch_path

    path = scratch_path(spark, "token-files")
    write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1, by_word=True
    )
    return read_token_files(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text decoded from them."""
    import public_tokenizers

    from waymark.llm.piece_transducer import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return encoded.select("doc_id", "ids", "decoded")


@query(mixing_sql(QUERY_TARGETS))
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and kinds of text have their target shares."""
    return draw(table(spark, sf_dir, "documents"), QUERY_TARGETS, details=True)


@query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from waymark.llm.html_extract import with_main_text

    pages = with_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
 FROM embeddings WHERE embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
 vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth, by integer inner product."""
    from waymark.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS last FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
 CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to FROM m
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the archives written of all pages."""
    from waymark.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on the first four components."""
    from waymark.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256.0)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by crc32 of the id) repeat a stretch of words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"case when h % 10 = 0 then filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '') end")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", words).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(size(w) > 0, int(g % size(w)), null)"))
    rows = rows.withColumn("p", F.expr("int(1 + (size(w) - a) div (3 + g % 8))"))
    again = "flatten(array_repeat(slice(w, a + 1, p), int((size(w) - a + p - 1) div p)))"
    planted = F.expr(f"array_join(concat(slice(w, 1, a), slice({again}, 1, size(w) - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods and six words in every document, a tenth of which have a planted one."""
    from waymark.llm.period_runs import with_runs

    found = with_runs(with_planted_periods(table(spark, sf_dir, "documents")), exponent=4, shortest=6)
    # Runs come by start, then period, so a later one must be longer in periods to win.
    best = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> "
    best += "if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.withColumn("best", F.expr(best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(secrets_sql(fdr=0.01))
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: those of the base patterns, and random strings."""
    from waymark.llm.secret_scan import secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"), fdr=0.01)
    joined = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(secrets, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(joined.format("filter(secrets, x -> x.kind <> 'random')")), 256).alias("base_sha256"),
        F.expr(joined.format("secrets")).alias("spans"),
    )
