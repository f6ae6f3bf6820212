"""The queries of this folder, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import leaks, packing, pairs, percentiles, reading, scans, splits, splitting
from quotemill.session import table


def _p2_found(s: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(splitting.quotes(table(s, d, "examples"))).select("example_no", "quote_id", "boundary").distinct()


def _p2_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(splitting.quotes(table(s, d, "examples")).select("example_no", "quote_id", "text"))


def _p2_rebuilt(s: SparkSession, d: str) -> DataFrame:
    return splitting.rebuilt(_p2_pieces(s, d), "example_no", "quote_id")


def _p3_percentiles(s: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(table(s, d, "timings"), table(s, d, "summaries"), grid=None)


def _p3_combined(s: SparkSession, d: str) -> DataFrame:
    return percentiles.combine(percentiles.percentiles(table(s, d, "timings"), table(s, d, "summaries")), "pruning_mode", "metric")


def _p3_error(s: SparkSession, d: str) -> DataFrame:
    return percentiles.merged_error(table(s, d, "timings"), table(s, d, "summaries"))


def _p4_found(s: SparkSession, d: str) -> DataFrame:
    return splits.same_documents(table(s, d, "examples"))


def _p4_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.split_examples(table(s, d, "examples"))


def _p4_together(s: SparkSession, d: str) -> DataFrame:
    """How many splits the rows of each question and of each document name are in."""
    placed = splits.split_examples(table(s, d, "examples")).join(table(s, d, "examples").select("example_no", "q_id", "doc_name"), "example_no")
    own = placed.select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("q_id", "doc_name")])).alias("x")).where("x.key is not null")
    return own.select("x.kind", "x.key", "split").distinct().groupBy("kind", "key").agg(F.count("*").alias("splits"))


def _p5_found(s: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(table(s, d, "examples"))


def _p5_repair(s: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(s, d, "examples"))


def _p6_found(s: SparkSession, d: str) -> DataFrame:
    return pairs.flag_pairs(table(s, d, "predictions"))


def _p7_found(s: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(s, d, "documents")).where("pieces > 1").select("doc_id").distinct()


def _p7_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(s, d, "documents")))


def _p7_room(s: SparkSession, d: str) -> DataFrame:
    return packing.room(packing.pack_documents(table(s, d, "documents")), "doc_id")


def _p8_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(s, d, "documents"), table(s, d, "eval_items"))


def _p9_found(s: SparkSession, d: str) -> DataFrame:
    return reading.clear_cases(table(s, d, "documents"))


def _p9_levels(s: SparkSession, d: str) -> DataFrame:
    return reading.graded(table(s, d, "documents")).select("doc_id", "level", F.round("posterior", 6).alias("posterior"))


def _p9_agreement(s: SparkSession, d: str) -> DataFrame:
    return reading.agreement(table(s, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": _p2_found, "p2_pieces": _p2_pieces, "p2_rebuilt": _p2_rebuilt, "p3_percentiles": _p3_percentiles, "p3_combined": _p3_combined, "p3_error": _p3_error, "p4_found": _p4_found, "p4_splits": _p4_splits, "p4_together": _p4_together, "p5_found": _p5_found, "p5_repair": _p5_repair, "p6_found": _p6_found,
    "p7_found": _p7_found, "p7_fill": _p7_fill, "p7_room": _p7_room, "p8_found": _p8_found, "p9_found": _p9_found, "p9_levels": _p9_levels, "p9_agreement": _p9_agreement,
}

_WS = r"[\x{e000}\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _longest(c: str) -> str:
    return f"list_max(list_transform(string_split({c}, chr(1)), lambda s: length(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g'))))"


_TIMES = """WITH o AS (SELECT timing_id, arg_max(run_id, received_at) AS run_id, arg_max(started_at, received_at)::DATE AS day, arg_max(timing, received_at) AS t FROM timings GROUP BY timing_id),
m AS (SELECT run_id, nullif(regexp_replace(lower(trim(pruning_mode)), '[\\s-]+', '_', 'g'), '') AS mode FROM summaries),
v AS (SELECT coalesce(mode, 'unknown') AS pruning_mode, day, unnest(['ttft_sec', 'total_sec']) AS metric, unnest([t.ttft_sec, t.total_sec]) AS v FROM o LEFT JOIN m USING (run_id)),
w AS (SELECT * FROM v WHERE v > 0 AND NOT isnan(v) AND v < 'infinity'::DOUBLE)"""

#: A break of two characters counts as one: its first is put aside as a mark that is white space, which keeps lengths.
_BREAK = r"(\x{e000}?\n|\r)"

SQL: dict[str, str] = {
    "p2_found": rf"""WITH t AS (SELECT example_no, q.quote_id AS quote_id, replace(q.text, chr(13) || chr(10), chr(57344) || chr(10)) AS text FROM (SELECT example_no, unnest(text_quotes) AS q FROM examples) WHERE length(q.text) > 1500),
p AS (SELECT *, regexp_replace(text, '{_BREAK}([ \t]*{_BREAK})+', chr(1), 'g') AS a FROM t),
s AS (SELECT *, regexp_replace(regexp_replace(a, '([.!?]){_WS}+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g') AS b, regexp_replace(text, '{_WS}+', chr(1), 'g') AS c FROM p)
SELECT DISTINCT example_no, quote_id, CASE WHEN {_longest('a')} <= 1500 THEN 'paragraph' WHEN {_longest('b')} <= 1500 THEN 'sentence' WHEN {_longest('c')} <= 1500 THEN 'word' ELSE 'none' END AS boundary FROM s""",
    "p2_rebuilt": """SELECT example_no, q.quote_id AS quote_id, md5(coalesce(q.text, '')) AS digest, coalesce(length(q.text), 0)::BIGINT AS chars, TRUE AS fits, TRUE AS repeats, count(*) AS times
FROM (SELECT example_no, unnest(text_quotes) AS q FROM examples) WHERE q IS NOT NULL GROUP BY ALL""",
    "p3_percentiles": _TIMES + """, r AS (SELECT *, row_number() OVER (PARTITION BY pruning_mode, day, metric ORDER BY v) AS rk, count(*) OVER (PARTITION BY pruning_mode, day, metric) AS n FROM w)
SELECT pruning_mode, day, metric, n, p, v AS value FROM r, (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS p) WHERE rk = greatest(1, ceil(p * n - 1e-9))""",
    "p3_error": _TIMES + """ SELECT pruning_mode, metric, p, count(*) AS n, TRUE AS within FROM w, (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS p) GROUP BY ALL""",
    "p4_together": "SELECT 'q_id' AS kind, q_id AS key, 1::BIGINT AS splits FROM examples WHERE q_id IS NOT NULL GROUP BY q_id UNION ALL SELECT 'doc_name', doc_name, 1::BIGINT FROM examples WHERE doc_name IS NOT NULL GROUP BY doc_name",
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 4096",
    "p7_room": "SELECT count(*) FILTER (octet_length(encode(text)) > 0) AS items, sum(octet_length(encode(text)))::BIGINT AS tokens, sum(ceil(octet_length(encode(text)) / 4096.0))::BIGINT AS pieces, TRUE AS fits, TRUE AS whole FROM documents",
}
