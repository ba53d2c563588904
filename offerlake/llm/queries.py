"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import ExactDedup
from .line_dedup import LineDedup
from .mixing import CURRICULUM, Mix
from .ngram_join import NgramJoin
from .packing import pack
from .quality import RULES, QualityRules
from .resampling import Resampling
from .secrets import find_secrets, report
from .substring_dedup import SubstringDedup
from .token_files import TokenFiles
from .toxicity import Toxicity
from .warc import archive_pages
from .whitening import Whitening


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents"), carry=["doc_id"]).schedule.drop("positions").withColumn("position", F.round("position", 9))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup(table(spark, sf_dir, "documents")).result.drop("kept_text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_secrets(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = QualityRules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    rules = [c for c in RULES.names if c != "score"]
    return found.judged.select("doc.doc_id", *[f"rules.{c}" for c in rules], "kept", "rules.score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).scored


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(table(spark, sf_dir, "documents"), n=3, percent=90, carry=["doc_id"]).docs


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LineDedup(table(spark, sf_dir, "documents")).result.drop("kept_text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactDedup(table(spark, sf_dir, "documents")).decisions


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenFiles.write(table(spark, sf_dir, "documents")).documents


def op12_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Whitening(table(spark, sf_dir, "embeddings")).rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).ranked.drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_mix_sources": op2_mix_sources,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_files": op11_token_files,
    "op12_whiten_embeddings": op12_whiten_embeddings,
    "op13_importance_resampling": op13_importance_resampling,
}

_ONE_SPACE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _position_sql() -> str:
    """The time at which ``done`` of a source's demand is met, by the two halves of its weight schedule: where the integral of a
    straight line from a to b over half the time reaches x, t = 2x / (a + sqrt(a^2 + 4 (b - a) x))."""
    half = lambda a, b, x: f"2 * {x} / ({a} + sqrt(greatest({a} * {a} + 4 * ({b} - {a}) * {x}, 0)))"
    whole = lambda a, b, c: f"CASE WHEN done * ({a} + 2 * {b} + {c}) / 4 < ({a} + {b}) / 4 THEN least(0.5, {half(a, b, f'(done * ({a} + 2 * {b} + {c}) / 4)')}) ELSE least(1.0, 0.5 + {half(b, c, f'greatest(done * ({a} + 2 * {b} + {c}) / 4 - ({a} + {b}) / 4, 0)')}) END"
    return "CASE rk % 3 " + " ".join(f"WHEN {i} THEN {whole(*[f'{float(x)}::DOUBLE' for x in knots])}" for i, knots in enumerate(CURRICULUM)) + " END"


ORACLE_SQL: dict[str, str] = {
    "op1_warc_archives": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest, body FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first_id FROM d)
        SELECT page_id, url, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
        FROM w""",
    "op2_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(doc_id::VARCHAR) AS m FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][rk % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most FROM s),
        o AS (SELECT *, row_number() OVER q AS pos,
                     (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(most) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                     / sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM w WINDOW q AS (ORDER BY most / weight, source NULLS LAST)),
        f AS (SELECT min(pos) AS free FROM o WHERE level * weight <= most),
        t AS (SELECT source, source_size, rk, CASE WHEN pos >= free THEN (SELECT level FROM o, f WHERE pos = free) * weight ELSE most END AS target FROM o, f),
        l AS (SELECT doc_id, size, source_size, target, rk, floor(target)::BIGINT AS whole, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY m, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        g AS (SELECT *, greatest(0, least(size, whole - epochs * source_size - start))::BIGINT AS rest FROM l),
        h AS (SELECT *, CASE WHEN epochs > 0 THEN size ELSE rest END AS words FROM g),
        p AS (SELECT *, (start + words / 2) / target AS done FROM h)
        SELECT doc_id, size, source_size, target, (size * epochs + rest)::BIGINT AS taken, CASE WHEN words > 0 THEN round({_position_sql()}, 9) END AS position FROM p""",
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM d),
        h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS hash FROM l),
        r AS (SELECT *, (hash + 3 * coalesce(lag(hash, 1) OVER w, 0) + 9 * coalesce(lag(hash, 2) OVER w, 0)) % 4 = 0 OR i = n - 1 AS ends
              FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r),
        k AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS size FROM c GROUP BY doc_id, chunk),
        g AS (SELECT *, size >= 2 AND regexp_matches(body, '[^\x20\x09-\x0D]') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM k)
        SELECT doc_id, sum(size)::BIGINT AS n_lines, count(*) AS n_chunks, coalesce(sum(size) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
               sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_ONE_SPACE} AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY body)""",
}
