"""All queries of the core by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import judge, text
from quotemill.operators import encoders, nested, prompting, pruning, request, retrieval
from quotemill.plans import pipeline, summary
from quotemill.session import table
from quotemill.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.lstrip("_")] = f
        if sql:
            SQL[f.__name__.lstrip("_")] = sql
        return f

    return add


WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g')), '[^\p{{L}}\p{{N}}_ ]', '', 'g')"


def strip(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '\[[^\]]+\]', '', 'g'), '{WS}+', ' ', 'g'))"


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def text_normalize(s, d):
    return table(s, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT pred_id, {strip('pred_answer')} AS clean FROM predictions")
def strip_citations(s, d):
    return table(s, d, "predictions").select("pred_id", text.strip_citations(F.col("pred_answer")).alias("clean"))


@query(f"""
WITH t AS (SELECT pred_id, {norm(strip('pred_answer'))} AS p, {norm('gold_answer')} AS g FROM predictions),
pt AS (SELECT pred_id, unnest(list_filter(string_split(p, ' '), lambda x: x <> '')) AS w FROM t),
gt AS (SELECT pred_id, unnest(list_filter(string_split(g, ' '), lambda x: x <> '')) AS w FROM t),
pc AS (SELECT pred_id, w, count(*) AS n FROM pt GROUP BY ALL), gc AS (SELECT pred_id, w, count(*) AS n FROM gt GROUP BY ALL),
np AS (SELECT pred_id, sum(n) AS n FROM pc GROUP BY ALL), ng AS (SELECT pred_id, sum(n) AS n FROM gc GROUP BY ALL),
same AS (SELECT pc.pred_id, sum(least(pc.n, gc.n)) AS n FROM pc JOIN gc USING (pred_id, w) GROUP BY ALL)
SELECT t.pred_id, CAST(p = g AS DOUBLE) AS em,
  CASE WHEN p IS NULL OR g IS NULL THEN NULL WHEN np.n IS NULL AND ng.n IS NULL THEN 1.0 WHEN same.n IS NULL THEN 0.0
    ELSE round(2 * (same.n::DOUBLE / np.n) * (same.n::DOUBLE / ng.n) / (same.n::DOUBLE / np.n + same.n::DOUBLE / ng.n), 9) END::DOUBLE AS f1
FROM t LEFT JOIN np USING (pred_id) LEFT JOIN ng USING (pred_id) LEFT JOIN same USING (pred_id)""")
def answer_metrics(s, d):
    p = table(s, d, "predictions").select("pred_id", "pred_answer", "gold_answer")
    return text.answer_scores(p, "pred_answer", "gold_answer").select("pred_id", "em", F.round("f1", 9).alias("f1"))


@query("""SELECT pred_id, CASE WHEN coalesce(len(gold_quotes), 0) = 0 THEN 0.0
  ELSE len(list_intersect(list_distinct(gold_quotes), list_distinct(retrieved_quote_ids)))::DOUBLE / len(list_distinct(gold_quotes)) END::DOUBLE AS recall FROM predictions""")
def retrieval_recall(s, d):
    return table(s, d, "predictions").select("pred_id", text.retrieval_recall(F.col("retrieved_quote_ids"), F.col("gold_quotes")).alias("recall"))


TOPK = """WITH c AS (SELECT vec_id, vec_id % 20 AS example, label, embedding FROM embeddings WHERE vec_id >= 20),
q AS (SELECT vec_id % 20 AS example, label AS qlabel, embedding AS qe FROM embeddings WHERE vec_id < 20),
r AS (SELECT example, vec_id, label, qlabel, round(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS sim FROM c JOIN q USING (example)),
k AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY sim DESC, vec_id) AS rk FROM r)
"""


def _ranked(s, d, k):
    e = table(s, d, "embeddings").withColumn("example", F.col("vec_id") % 20)
    return retrieval.top_k(e.where("vec_id >= 20"), e.where("vec_id < 20"), k, order="vec_id")


@query(TOPK + "SELECT example, vec_id, rk, sim FROM k WHERE rk <= 4")
def topk_evidence(s, d):
    return _ranked(s, d, 4).select("example", "vec_id", "rk", "sim")


@query(TOPK + """, g AS (SELECT example, count(*) FILTER (label = qlabel) AS gold, count(*) FILTER (label = qlabel AND rk <= 4) AS hit, count(*) FILTER (label = qlabel AND rk <= 2) AS kept FROM k GROUP BY example)
SELECT example, CASE WHEN gold = 0 THEN 0.0 ELSE hit::DOUBLE / gold END::DOUBLE AS recall, CASE WHEN gold = 0 THEN 0.0 ELSE kept::DOUBLE / gold END::DOUBLE AS recall_pruned FROM g""")
def recall_at_k(s, d):
    e = table(s, d, "embeddings").withColumn("example", F.col("vec_id") % 20)
    asked = e.where("vec_id < 20").select("example", F.col("label").alias("q"))
    right = F.col("label") == F.col("q")
    gold = e.where("vec_id >= 20").join(asked, "example").groupBy("example").agg(F.count_if(right).alias("gold"))
    got = _ranked(s, d, 4).join(asked, "example").groupBy("example").agg(F.count_if(right).alias("hit"), F.count_if(right & (F.col("rk") <= pruning.keep_count(F.lit(4), 0.5))).alias("kept"))
    share = lambda c: F.when(F.col("gold") == 0, 0.0).otherwise(F.col(c).cast("double") / F.col("gold"))
    return gold.join(got, "example").select("example", share("hit").alias("recall"), share("kept").alias("recall_pruned"))


def _kept(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE least({n}, greatest(1, trunc({n} * 0.5::DOUBLE)::BIGINT)) END"


def _prune_sql(texts: bool, images: bool, patches: bool = False) -> str:
    t, i = "len(t)", "len(i)"
    after = "list_sum(list_transform(i, lambda q: CASE WHEN q.layout_id % 4 = 0 THEN 16 ELSE 8 END))" if patches else f"list_sum(list_transform(i[1:({_kept(i) if images else i})], lambda q: coalesce(q.visual_pruning.tokens_after, 16)))"
    return f"""SELECT pred_id, {t}::BIGINT AS text_before, ({_kept(t) if texts else t})::BIGINT AS text_after, {i}::BIGINT AS images_before, ({_kept(i) if images else i})::BIGINT AS images_after,
      coalesce(list_sum(list_transform(i, lambda q: coalesce(q.visual_pruning.tokens_after, 16))), 0)::BIGINT AS visual_tokens_before, coalesce({after}, 0)::BIGINT AS visual_tokens_after
      FROM (SELECT pred_id, coalesce(selected_text_quotes, []) AS t, coalesce(selected_img_quotes, []) AS i FROM predictions)"""


def _tiles(question: Column, images: Column) -> Column:
    """A double of a tile scorer: scores from the place of the tile and the layout of the image, none for every fourth layout."""
    score = lambda q: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((k * 7 + F.coalesce(q["layout_id"], F.lit(1))) % 16).cast("double") / 16)
    return F.transform(images, lambda q: F.struct(F.when(F.coalesce(q["layout_id"] % 4, F.lit(1)) != 0, score(q)).alias("scores"), (F.coalesce(q["layout_id"], F.lit(1)) % 700 + 300).cast("int").alias("width"), F.lit(801).alias("height")))


def _policy(mode, s, d):
    images = F.col("selected_img_quotes")
    p = table(s, d, "predictions").withColumn("_t", _tiles(F.col("question"), F.coalesce(images, F.array())))
    return p.withColumn("k", pruning.apply_policy(mode, 0.5, F.col("selected_text_quotes"), images, F.col("_t"), key=F.col("q_id")))


def _pruned(mode):
    def run(s, d):
        return _policy(mode, s, d).select("pred_id", *[f"k.pruning.{c}" for c in ("text_before", "text_after", "images_before", "images_after", "visual_tokens_before", "visual_tokens_after")])

    return run


for _name, _mode, _t, _i in (("prune_none", "no_pruning", False, False), ("prune_uniform", "uniform_pruning", True, True), ("prune_visual_only", "visual_only_pruning", False, True), ("prune_patch", "visual_patch_pruning", False, False), ("prune_internal", "model_internal_visual_pruning", False, False)):
    QUERIES[_name], SQL[_name] = _pruned(_mode), _prune_sql(_t, _i, _mode in pruning.PATCH_MODES).replace("q.layout_id % 4", "coalesce(q.layout_id, 1) % 4")


@query(r"""WITH i AS (SELECT pred_id, q_id, unnest(selected_img_quotes) AS q, generate_subscripts(selected_img_quotes, 1) - 1 AS pos FROM predictions),
l AS (SELECT pred_id, pos, q_id, q.quote_id AS quote_id, q.local_img_path AS path, coalesce(q.layout_id, 1) AS l FROM i),
t AS (SELECT l.*, k, ((k * 7 + l) % 16) / 16.0::DOUBLE AS s, l % 700 + 300 AS w FROM l, (SELECT unnest(generate_series(0, 15)) AS k) WHERE l % 4 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY pred_id, pos ORDER BY s DESC, k) AS rk FROM t),
b AS (SELECT pred_id, pos, string_agg(k::VARCHAR, ',' ORDER BY k) AS kept, string_agg(round(s, 4)::VARCHAR, ',' ORDER BY k) AS scores,
  string_agg(floor((k % 4) * (w::DOUBLE / 4))::BIGINT || ' ' || floor((k // 4) * 200.25::DOUBLE)::BIGINT || ' ' || (CASE WHEN k % 4 = 3 THEN w ELSE floor((k % 4 + 1) * (w::DOUBLE / 4)) END)::BIGINT || ' ' || (CASE WHEN k // 4 = 3 THEN 801 ELSE floor((k // 4 + 1) * 200.25::DOUBLE) END)::BIGINT, ';' ORDER BY k) AS boxes
  FROM r WHERE rk <= 8 GROUP BY ALL)
SELECT pred_id, pos::BIGINT AS pos, coalesce(kept, '-') AS kept, coalesce(scores, '-') AS scores, coalesce(boxes, '-') AS boxes, CASE WHEN kept IS NULL THEN 'missing_image' ELSE '-' END AS reason,
  CASE WHEN kept IS NULL OR path IS NULL THEN path ELSE 'pruned_images/' || coalesce(q_id, 'None') || '_' || coalesce(quote_id, 'None') || '_' || regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') || '_pruned_visual_patch_pruning_50' || regexp_extract(path, '\.[^./]*$') END AS shown
FROM l LEFT JOIN b USING (pred_id, pos)""")
def patch_rewrite(s, d):
    q = _policy("visual_patch_pruning", s, d).select("pred_id", F.posexplode("k.selected_img_quotes").alias("pos", "q"))
    v = "q.visual_pruning"
    text_of = lambda c: F.coalesce(F.array_join(F.col(f"{v}.{c}").cast("array<string>"), ","), F.lit("-"))
    scores = F.array_join(F.transform(f"{v}.scores", lambda x: F.round(x, 4).cast("string")), ",")
    boxes = F.array_join(F.transform(f"{v}.keep_boxes", lambda b: F.array_join(b.cast("array<string>"), " ")), ";")
    return q.select("pred_id", F.col("pos").cast("long").alias("pos"), text_of("keep_indices").alias("kept"), F.coalesce(scores, F.lit("-")).alias("scores"), F.coalesce(boxes, F.lit("-")).alias("boxes"), F.coalesce(f"{v}.reason", F.lit("-")).alias("reason"), F.col("q.local_img_path").alias("shown"))


@query("""WITH t AS (SELECT vec_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rk FROM t)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS kept FROM r WHERE rk <= least(n, greatest(4, trunc(n * 0.5::DOUBLE))) GROUP BY vec_id""")
def patch_select(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_join(pruning.patch_keep(F.col("embedding"), 0.5).cast("array<string>"), ",").alias("kept"))


@query("""WITH k AS (SELECT p_partkey, p_size + 200 AS w, p_size * 2 + 100 AS h, unnest(generate_series(0, 15)) AS k FROM part),
b AS (SELECT p_partkey, k, floor((k % 4) * (w::DOUBLE / 4))::BIGINT AS l, floor((k // 4) * (h::DOUBLE / 4))::BIGINT AS t,
  CASE WHEN k % 4 = 3 THEN w ELSE floor((k % 4 + 1) * (w::DOUBLE / 4)) END::BIGINT AS r, CASE WHEN k // 4 = 3 THEN h ELSE floor((k // 4 + 1) * (h::DOUBLE / 4)) END::BIGINT AS u FROM k)
SELECT p_partkey, string_agg(l || ' ' || t || ' ' || r || ' ' || u, ';' ORDER BY k) AS boxes FROM b GROUP BY p_partkey""")
def grid_boxes(s, d):
    boxes = pruning.grid_boxes(F.col("p_size") + 200, F.col("p_size") * 2 + 100)
    return table(s, d, "part").select("p_partkey", F.array_join(F.transform(boxes, lambda b: F.array_join(b.cast("array<string>"), " ")), ";").alias("boxes"))


@query("""WITH n AS (SELECT p_partkey, (p_size % 16 + 1)::BIGINT AS n FROM part)
SELECT p_partkey, least(4, n)::BIGINT AS cols, ceil(n::DOUBLE / least(4, n))::BIGINT AS rows, (least(4, n) * 224)::BIGINT AS width, (ceil(n::DOUBLE / least(4, n)) * 224)::BIGINT AS height FROM n""")
def montage_layout(s, d):
    m = table(s, d, "part").select("p_partkey", pruning.montage_layout(F.col("p_size") % 16 + 1).alias("m"))
    return m.select("p_partkey", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("cols", "rows", "width", "height")])


@query("""WITH k AS (SELECT vec_id, unnest([(vec_id % 16)::BIGINT, ((vec_id * 7 + 3) % 16)::BIGINT]) AS c FROM embeddings),
e AS (SELECT DISTINCT vec_id, a.v * 10 + b.v AS f FROM k, (SELECT unnest(generate_series(0, 9)) AS v) a, (SELECT unnest(generate_series(0, 9)) AS v) b
  WHERE a.v >= round_even((c // 4) * 10.0::DOUBLE / 4, 0) AND a.v < round_even((c // 4 + 1) * 10.0::DOUBLE / 4, 0) AND b.v >= round_even((c % 4) * 10.0::DOUBLE / 4, 0) AND b.v < round_even((c % 4 + 1) * 10.0::DOUBLE / 4, 0))
SELECT vec_id, string_agg(f::VARCHAR, ',' ORDER BY f) AS patches FROM e GROUP BY vec_id""")
def coarse_to_fine(s, d):
    kept = F.array((F.col("vec_id") % 16).cast("int"), ((F.col("vec_id") * 7 + 3) % 16).cast("int"))
    return table(s, d, "embeddings").select("vec_id", F.array_join(F.array_sort(pruning.coarse_to_fine(kept, 10)).cast("array<string>"), ",").alias("patches"))


_LINE = "'- [' || coalesce(q.quote_id, 'None') || '] (page ' || coalesce(q.page_id::VARCHAR, 'None') || ', layout ' || coalesce(q.layout_id::VARCHAR, 'None') || '): ' || coalesce(q.{}, '')"


@query(f"""SELECT pred_id, array_to_string(list_concat(
  ['{prompting.HEAD[0]}', '{prompting.HEAD[1]}', '{prompting.HEAD[2]}', '', 'Question: ' || coalesce(question, 'None'), ''],
  CASE WHEN coalesce(len(selected_text_quotes), 0) > 0 THEN list_concat(['{prompting.TEXTS}'], list_transform(selected_text_quotes, lambda q: {_LINE.format('text')}), ['']) ELSE [] END,
  CASE WHEN coalesce(len(selected_img_quotes), 0) > 0 THEN list_concat(['{prompting.IMAGES}'], list_transform(selected_img_quotes, lambda q: {_LINE.format('img_description')}), ['']) ELSE [] END,
  ['{prompting.LAST}']), chr(10)) AS prompt FROM predictions""")
def prompt_build(s, d):
    return table(s, d, "predictions").select("pred_id", prompting.build_prompt(F.col("question"), F.col("selected_text_quotes"), F.col("selected_img_quotes")).alias("prompt"))


@query("""SELECT pred_id, array_to_string(list_concat(
  coalesce(list_transform(selected_text_quotes, lambda q: '[' || coalesce(q.quote_id, 'None') || '] TEXT: ' || coalesce(q.text, '')), []),
  coalesce(list_transform(selected_img_quotes, lambda q: '[' || coalesce(q.quote_id, 'None') || '] IMAGE: ' || coalesce(q.img_description, '')), [])), chr(10)) AS evidence FROM predictions""")
def evidence_text(s, d):
    return table(s, d, "predictions").select("pred_id", prompting.evidence_text(F.col("selected_text_quotes"), F.col("selected_img_quotes")).alias("evidence"))


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


_EVIDENCE = """array_to_string(list_concat(
  coalesce(list_transform(selected_text_quotes, lambda q: '[' || coalesce(q.quote_id, 'None') || '] TEXT: ' || coalesce(q.text, '')), []),
  coalesce(list_transform(selected_img_quotes, lambda q: '[' || coalesce(q.quote_id, 'None') || '] IMAGE: ' || coalesce(q.img_description, '')), [])), chr(10))"""


@query(f"""WITH e AS (SELECT *, {_EVIDENCE} AS e FROM predictions)
SELECT pred_id, {_quoted(judge.RUBRIC)} || '\n    Question:\n    ' || coalesce(question, '') || '\n\n    Gold answer:\n    ' || coalesce(gold_answer, '') || '\n\n    Predicted answer:\n    ' || coalesce({strip('pred_answer')}, '')
  || '\n\n    Evidence:\n    ' || CASE WHEN regexp_replace(e, '{WS}+', '', 'g') = '' THEN 'No evidence provided.' ELSE e END || '\n' AS prompt FROM e""")
def judge_prompt(s, d):
    evidence = prompting.evidence_text(F.col("selected_text_quotes"), F.col("selected_img_quotes"))
    return table(s, d, "predictions").select("pred_id", judge.judge_prompt(F.col("question"), F.col("gold_answer"), F.col("pred_answer"), evidence).alias("prompt"))


#: Replies of all kinds: as sent, and what they come to (correct, score, reason, faithful, faithfulness_score, faithfulness_reason; None for the reason of a reply that is no JSON object).
REPLIES = (
    ('{"correct":1,"score":5,"reason":"r","faithful":1,"faithfulness_score":4,"faithfulness_reason":"f"}', (1, 5, "r", 1, 4, "f")),
    ('\xa0\n{"correct":"1","score":"3","faithful":true,"faithfulness_score":4.7}\n', (1, 3, "", 1, 4, "")),
    ('```json\n{"correct":1}\n```', None), ('{"correct":null,"score":"high","reason":7,"faithful":false}', (0, 0, "7", 0, 0, "")), ('[{"correct":1}]', None),
    ('{"correct":1} {"correct":0}', None), ("", None), ('{"correct":0,"score":0,"reason":"é \\n x"}\r\n\t', (0, 0, "é \n x", 0, 0, "")), ("Sure! " + "very " * 50, None), ("{}", (0, 0, "", 0, 0, "")),
)


def _reply_sql(i: int, field: int) -> str:
    case = " ".join(f"WHEN {k} THEN {_quoted(v[field]) if isinstance(v[field], str) else v[field]}" for k, (_, v) in enumerate(REPLIES) if v is not None)
    other = "0" if i in (0, 1, 3, 4) else "'Judge returned invalid JSON'" if i == 5 else "'Judge returned invalid JSON: ' || substring(regexp_replace(reply, '^" + WS + "+|" + WS + "+$', '', 'g'), 1, 200)"
    return f"CASE k {case} ELSE {other} END"


_FIELDS = ("correct", "score", "reason", "faithful", "faithfulness_score", "faithfulness_reason")


@query(f"""WITH t AS (SELECT event_id, event_id % {len(REPLIES)} AS k, [{', '.join(_quoted(r) for r, _ in REPLIES)}][(event_id % {len(REPLIES)})::INT + 1] AS reply FROM events)
SELECT event_id, {', '.join(f"({_reply_sql(i, i)})::{'BIGINT' if i in (0, 1, 3, 4) else 'VARCHAR'} AS {f}" for i, f in enumerate(_FIELDS))} FROM t""")
def judge_parse(s, d):
    reply = F.element_at(F.array(*[F.lit(r) for r, _ in REPLIES]), (F.col("event_id") % len(REPLIES)).cast("int") + 1)
    v = table(s, d, "events").select("event_id", judge.judge_verdict(reply).alias("v"))
    return v.select("event_id", *[F.col(f"v.{f}").cast("long").alias(f) if i in (0, 1, 3, 4) else F.col(f"v.{f}") for i, f in enumerate(_FIELDS)])


@query(f"""WITH e AS (SELECT pred_id, trim(lower({strip('pred_answer')})) AS said, lower(trim(coalesce(gold_answer, ''))) AS gold, {_EVIDENCE} AS e FROM predictions),
v AS (SELECT pred_id, CASE WHEN contains(coalesce(said, ''), gold) AND gold <> '' THEN 1 ELSE 0 END AS c, CASE WHEN contains(lower(CASE WHEN regexp_replace(e, '{WS}+', '', 'g') = '' THEN 'No evidence provided.' ELSE e END) || '\n', coalesce(said, '')) THEN 1 ELSE 0 END AS f FROM e)
SELECT pred_id, c::BIGINT AS judge_correct, (c * 5)::BIGINT AS judge_score, f::BIGINT AS judge_faithful, (f * 5)::BIGINT AS judge_faithfulness_score FROM v""")
def judge_rows(s, d):
    out = pipeline.judged(table(s, d, "predictions"), encoders.same_words)
    return out.select("pred_id", *[f"metrics.{c}" for c in ("judge_correct", "judge_score", "judge_faithful", "judge_faithfulness_score")])


_AVG = ", ".join(f"round(avg(timing.{t}) + 3e-12, 10) AS avg_{t}" for t in summary.TIMINGS) + ", " + ", ".join(f"round(avg(metrics.{m}) + 3e-12, 10) AS avg_{m}" for m in summary.METRICS)


def _rounded(df):
    return df.select(*[F.round(F.col(c) + 3e-12, 10).alias(c) if c.startswith("avg_") else F.col(c) for c in df.columns])


@query(f"SELECT count(*) AS num_examples, {_AVG} FROM predictions")
def eval_summary(s, d):
    return _rounded(summary.summarize(table(s, d, "predictions")))


@query(f"SELECT run_id, count(*) AS num_examples, {_AVG} FROM predictions GROUP BY run_id")
def eval_summary_by_run(s, d):
    return _rounded(summary.summarize(table(s, d, "predictions"), "run_id"))


@query(f"SELECT count(*) AS num_examples, {_AVG} FROM predictions WHERE pred_id < 0")
def eval_summary_empty(s, d):
    return _rounded(summary.summarize(table(s, d, "predictions").where("pred_id < 0")))


@query("""SELECT user_id, min(epoch_us(ts)) FILTER (event_type <> '') - min(epoch_us(ts)) AS ttft, string_agg(event_type, '' ORDER BY ts, event_id) AS answer
FROM (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type FROM events) GROUP BY user_id""")
def chunk_ttft(s, d):
    e = table(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("piece"))
    return io.chunk_ttft(e, "user_id", "seq", "at", "piece", "at").select("user_id", "ttft", "answer")


#: Every event becomes lines of a metrics text: a counter that is wanted, one that isn't, comments, blanks and what is no number.
@query(f"""WITH e AS (SELECT event_id, value, [{', '.join(_quoted(w) for w in io.WANTED)}, 'other:counter'][(event_id % 8)::INT + 1] AS name FROM events)
SELECT name, arg_max(value, event_id) AS value FROM e WHERE event_id % 5 <> 0 AND name <> 'other:counter' AND value IS NOT NULL GROUP BY name""")
def promscrape(s, d):
    e = table(s, d, "events").withColumn("name", F.element_at(F.array(*map(F.lit, io.WANTED), F.lit("other:counter")), (F.col("event_id") % 8).cast("int") + 1))
    number = F.coalesce(F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")), F.lit("n/a"))
    line = F.concat(F.when(F.col("event_id") % 3 == 0, " ").otherwise(""), "name", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"}'))).otherwise(""), F.lit("  "), number)
    lines = e.select(F.explode(F.array(line, F.concat(F.lit("# HELP "), "name"), F.lit("  "))).alias("line"), F.col("event_id").alias("ord"))
    return io.metrics_text(lines)


@query("SELECT example_no, q_id FROM examples ORDER BY example_no LIMIT 50")
def first_n_examples(s, d):
    return io.first_n(table(s, d, "examples").select("example_no", "q_id"), 50, "example_no")


@query("""SELECT q_id, doc_name, question, coalesce(answer_short, '') AS answer_short, len(coalesce(gold_quotes, []))::BIGINT AS gold, len(coalesce(text_quotes, []))::BIGINT AS texts, len(coalesce(evidence_modality_type, []))::BIGINT AS kinds,
  array_to_string(list_transform(coalesce(img_quotes, []), lambda q: coalesce('data/images/' || q.img_path, '-')), ';') AS paths FROM examples""")
def example_normalize(s, d):
    size = lambda c: F.size(c).cast("long")
    paths = F.array_join(F.transform("img_quotes", lambda q: F.coalesce(q["local_img_path"], F.lit("-"))), ";")
    e = io.normalize(table(s, d, "examples"), "data/images")
    return e.select("q_id", "doc_name", "question", "answer_short", size("gold_quotes").alias("gold"), size("text_quotes").alias("texts"), size("evidence_modality_type").alias("kinds"), paths.alias("paths"))


_UNIT = "list_transform(range(97, 123), lambda c: (length({0}) - length(replace({0}, chr(c::INT), '')))::DOUBLE)"


def _nearest(source: str, k: int, text: str, where: str = "") -> str:
    """The quotes of a list, ranked by the angle between their letter counts and the question's, as (example_no, rk, q)."""
    v = _UNIT.format(f"lower(coalesce(q.{text}, ''))")
    return f"""(SELECT example_no, rk, q FROM (SELECT example_no, q, row_number() OVER (PARTITION BY example_no ORDER BY sim DESC, pos) AS rk FROM (
      SELECT example_no, q, pos, round(list_dot_product(v, w) / greatest(sqrt(list_dot_product(v, v)), 1e-300) / greatest(sqrt(list_dot_product(w, w)), 1e-300), 6) AS sim
      FROM (SELECT example_no, q, pos, {v} AS v, {_UNIT.format("lower(coalesce(question, ''))")} AS w FROM (SELECT example_no, question, unnest({source}) AS q, generate_subscripts({source}, 1) AS pos FROM examples)) {where})) WHERE rk <= {k})"""


#: The images that a run has shown are those that exist.
_THERE = "WHERE 'data/images/' || q.img_path IN (SELECT q.local_img_path FROM (SELECT unnest(selected_img_quotes) AS q FROM predictions) WHERE q.local_img_path IS NOT NULL)"
_T4, _I2 = _nearest("text_quotes", 4, "text"), _nearest("img_quotes", 2, "img_description", _THERE)


def _with_files(s, d):
    """The normalised examples, and which of their images exist."""
    files = table(s, d, "predictions").select(F.explode("selected_img_quotes").alias("q")).select(F.col("q.local_img_path").alias("path"))
    e = table(s, d, "examples")
    e = e.withColumn("img_quotes", F.transform("img_quotes", lambda q: q.withField("local_img_path", io.resolve_path("data/images", q["img_path"]))))
    e = io.with_existing(e, files.where("path is not null"), "example_no")
    shown = F.transform("img_quotes", lambda q: q.withField("seen", F.when(F.array_contains("existing", q["local_img_path"]), F.coalesce(q["img_description"], F.lit("")))))
    return e.withColumn("img_quotes", shown)  # `seen` stands for the pixels


def _seen(texts: Column) -> Column:
    return F.zip_with(texts, encoders.letters(texts), lambda t, v: F.when(t.isNotNull(), v))


@query(f"""WITH t AS (SELECT example_no, string_agg(coalesce(q.quote_id, '-'), ',' ORDER BY rk) AS texts FROM {_T4} GROUP BY example_no), i AS (SELECT example_no, string_agg(coalesce(q.quote_id, '-'), ',' ORDER BY rk) AS images FROM {_I2} GROUP BY example_no)
SELECT example_no, coalesce(texts, '') AS texts, coalesce(images, '') AS images FROM examples LEFT JOIN t USING (example_no) LEFT JOIN i USING (example_no)""")
def topk_two_modality(s, d):
    out = retrieval.retrieve(_with_files(s, d), encoders.letters, encoders.letters, _seen, image_key="seen")
    ids = lambda c: F.array_join(F.transform(c, lambda q: F.coalesce(q["quote_id"], F.lit("-"))), ",")
    return out.select("example_no", ids("selected_text_quotes").alias("texts"), ids("selected_img_quotes").alias("images"))


_FEW = "CASE WHEN n = 0 THEN 0 ELSE greatest(1, trunc(n * 0.5::DOUBLE)) END"


@query(f"""WITH t AS (SELECT example_no, rk, q.quote_id AS id, coalesce(q.text, '') AS line, count(*) OVER (PARTITION BY example_no) AS n FROM {_T4}),
i AS (SELECT example_no, rk, q.quote_id AS id, coalesce(q.img_description, '') AS line, count(*) OVER (PARTITION BY example_no) AS n FROM {_I2}),
b AS (SELECT example_no, 0 AS kind, rk, id, line FROM t WHERE rk <= {_FEW} UNION ALL SELECT example_no, 1, rk, id, line FROM i WHERE rk <= {_FEW}),
g AS (SELECT example_no, list(id ORDER BY kind, rk) AS ids, first(id ORDER BY kind, rk) AS cited, first(line ORDER BY kind, rk) AS line FROM b GROUP BY example_no),
e AS (SELECT x.example_no, x.q_id, coalesce(x.answer_short, '') AS gold_answer, x.gold_quotes, coalesce(ids, []) AS ids,
  CASE WHEN cited IS NULL THEN 'The evidence is insufficient.' ELSE array_to_string(list_filter(string_split(string_split(line, chr(10))[1], ' '), lambda w: w <> '')[1:8], ' ') || ' [' || cited || ']' END AS pred_answer FROM examples x LEFT JOIN g USING (example_no))
SELECT example_no, q_id, gold_answer, pred_answer, array_to_string(ids, ',') AS retrieved, CAST({norm(strip('pred_answer'))} = {norm('gold_answer')} AS DOUBLE) AS em,
  CASE WHEN coalesce(len(gold_quotes), 0) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(gold_quotes), list_distinct(ids)))::DOUBLE / len(list_distinct(gold_quotes)) END::DOUBLE AS recall FROM e""")
def rag_run(s, d):
    """From examples to prediction rows: retrieve, prune, prompt, answer, score, with doubles for the models."""
    stages = pipeline.Stages(encoders.letters, encoders.letters, _seen, encoders.first_evidence)
    e = _with_files(s, d)
    e = e.withColumn("img_quotes", F.transform("img_quotes", lambda q: q.withField("local_img_path", q["seen"])))  # the double sees descriptions
    rows = pipeline.run(e, pipeline.Config(mode="uniform_pruning"), stages, "example_no")
    return rows.select("example_no", "q_id", "gold_answer", "pred_answer", F.array_join("retrieved_quote_ids", ",").alias("retrieved"), "metrics.em", F.col("metrics.retrieval_recall").alias("recall"))


@query("""SELECT pred_id, array_to_string(list_concat(coalesce(list_transform(selected_text_quotes, lambda q: q.quote_id), []), coalesce(list_transform(selected_img_quotes, lambda q: q.quote_id), [])), ',') AS ids,
  coalesce(len(list_filter(selected_img_quotes, lambda q: q.visual_pruning IS NOT NULL)), 0)::BIGINT AS metas,
  coalesce(list_aggregate(list_transform(list_filter(selected_img_quotes, lambda q: q.visual_pruning.keep_indices IS NOT NULL), lambda q: array_to_string(q.visual_pruning.keep_indices, ' ')), 'string_agg', ';'), '') AS kept, 0.5::DOUBLE AS ratio,
  (1 + coalesce(len(list_filter(selected_img_quotes, lambda q: q.local_img_path IS NOT NULL)), 0))::BIGINT AS parts FROM predictions""")
def request_build(s, d):
    images = F.coalesce("selected_img_quotes", F.array())
    p = table(s, d, "predictions").withColumn("i", images)
    files = F.map_from_arrays(F.array_distinct(F.filter(F.transform("i", lambda q: q["local_img_path"]), lambda x: x.isNotNull())), F.array_distinct(F.filter(F.transform("i", lambda q: q["local_img_path"]), lambda x: x.isNotNull())))
    extras = request.request_extras("model_internal_visual_pruning", 0.5, F.col("i"))
    parts = request.message_parts(F.col("question"), request.image_parts(F.transform("i", lambda q: q["local_img_path"]), files))
    made = p.select("pred_id", F.array_join(prompting.retrieved_ids(F.col("selected_text_quotes"), F.col("i")), ",").alias("ids"), F.size(request.visual_meta(F.col("i"))).cast("long").alias("metas"), extras.alias("x"), F.size(parts).cast("long").alias("parts"))
    kept = F.array_join(F.transform("x.image_keep_indices", lambda k: F.array_join(k.cast("array<string>"), " ")), ";")
    return made.select("pred_id", "ids", "metas", F.coalesce(kept, F.lit("")).alias("kept"), F.col("x.image_keep_ratio").alias("ratio"), "parts")


@query("""WITH i AS (SELECT pred_id, unnest(selected_img_quotes) AS q, generate_subscripts(selected_img_quotes, 1) - 1 AS pos FROM predictions),
s AS (SELECT pred_id, pos, q.visual_pruning.grid_rows AS r, q.visual_pruning.grid_cols AS c, q.visual_pruning.keep_indices AS kept, [49, 50, 9, 1, 196][(pred_id % 5)::INT + 1] AS n, pred_id % 7 AS x FROM i),
k AS (SELECT *, CASE WHEN x = 0 THEN 'missing_image' WHEN x = 1 THEN 'no_last_hidden_state' WHEN x = 2 THEN 'unexpected_hidden_shape' WHEN n = 50 THEN 'non_square_patch_grid' END AS why FROM s),
m AS (SELECT pred_id, pos, count(DISTINCT a.v * g + b.v) AS after FROM (SELECT pred_id, pos, unnest(kept) AS u, coalesce(r, 1) AS r, coalesce(c, 1) AS c, sqrt(n)::INT AS g FROM k WHERE why IS NULL), (SELECT unnest(generate_series(0, 13)) AS v) a, (SELECT unnest(generate_series(0, 13)) AS v) b
  WHERE u >= 0 AND u < r * c AND a.v >= round_even((u // c) * g::DOUBLE / r, 0) AND a.v < round_even((u // c + 1) * g::DOUBLE / r, 0) AND b.v >= round_even((u % c) * g::DOUBLE / c, 0) AND b.v < round_even((u % c + 1) * g::DOUBLE / c, 0) GROUP BY ALL)
SELECT pred_id, pos::BIGINT AS pos, why IS NULL AND after IS NOT NULL AS applied, coalesce(why, CASE WHEN after IS NULL THEN 'empty_keep_indices' ELSE '-' END) AS reason, CASE WHEN why IS NULL OR why = 'non_square_patch_grid' THEN n ELSE -1 END::BIGINT AS tokens_before, coalesce(after, -1)::BIGINT AS tokens_after
FROM k LEFT JOIN m USING (pred_id, pos)""")
def probe_outcomes(s, d):
    q = table(s, d, "predictions").select("pred_id", F.posexplode("selected_img_quotes").alias("pos", "q"))
    n, x = F.element_at(F.array(*map(F.lit, (49, 50, 9, 1, 196))), (F.col("pred_id") % 5).cast("int") + 1), F.col("pred_id") % 7
    shape = F.when(x == 1, None).when(x == 2, F.array(F.lit(2), n + 1, F.lit(64))).otherwise(F.array(F.lit(1), n + 1, F.lit(64)))
    out = q.select("pred_id", F.col("pos").cast("long").alias("pos"), request.probe(x != 0, shape, F.col("q.visual_pruning")).alias("o"))
    return out.select("pred_id", "pos", "o.applied", F.coalesce("o.reason", F.lit("-")).alias("reason"), F.coalesce("o.tokens_before", F.lit(-1).cast("long")).alias("tokens_before"), F.coalesce("o.tokens_after", F.lit(-1).cast("long")).alias("tokens_after"))


def _dec(x: str) -> str:
    """A JSON value; a text that holds a JSON container is read, up to two levels deep."""
    once = lambda y: f"CASE WHEN json_type({y}) = 'VARCHAR' AND json_valid({y} ->> '$') AND left(ltrim({y} ->> '$'), 1) IN ('{{', '[', '\"') THEN json({y} ->> '$') ELSE {y} END"
    return f"list_transform(list_transform([{x}], lambda y1: {once('y1')}), lambda y2: {once('y2')})[1]"


def _many(x: str) -> str:
    return f"list_transform([{_dec(x)}], lambda z: CASE json_type(z) WHEN 'ARRAY' THEN from_json(z, '[\"JSON\"]') WHEN 'OBJECT' THEN [z] ELSE [] END)[1]"


_LINES = f"""j AS (SELECT line_id, json(line) AS j FROM prediction_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
w AS (SELECT line_id, CASE WHEN list_contains(json_keys(j), 'rows') AND json_type({_dec("j -> 'rows'")}) IN ('ARRAY', 'OBJECT') THEN {_many("j -> 'rows'")} ELSE [j] END AS r FROM j),
u AS (SELECT line_id, generate_subscripts(r, 1) - 1 AS row_pos, unnest(r) AS r FROM w),
r AS (SELECT line_id, row_pos, r FROM (SELECT line_id, row_pos, {_dec('r')} AS r FROM u) WHERE json_type(r) = 'OBJECT'),
p AS (SELECT line_id, row_pos, r, {_many("r -> 'selected_img_quotes'")} AS i, list_transform({_many("r -> 'visual_pruning'")}, lambda e: {_dec('e')}) AS v FROM r),
q AS (SELECT line_id, row_pos, v, generate_subscripts(i, 1) - 1 AS pos, unnest(i) AS i FROM p),
i AS (SELECT line_id, row_pos, pos, i ->> 'quote_id' AS name, {_dec("i -> 'visual_pruning'")} AS own, list_filter(v, lambda e: json_type(e) = 'OBJECT' AND e ->> 'quote_id' = i ->> 'quote_id')[1] AS e FROM (SELECT line_id, row_pos, pos, v, {_dec('i')} AS i FROM q) WHERE json_type(i) = 'OBJECT'),
k AS (SELECT line_id, row_pos, pos, name, CASE WHEN coalesce(json_type(own), 'NULL') = 'NULL' THEN {_dec("e -> 'visual_pruning'")} ELSE own END AS x FROM i),
t AS (SELECT line_id, row_pos, pos, name, CASE WHEN json_type(x) = 'OBJECT' AND json_type({_dec("x -> 'keep_indices'")}) = 'ARRAY' THEN json_array_length({_dec("x -> 'keep_indices'")}) ELSE 0 END AS n FROM k),
m AS (SELECT line_id, row_pos, 'timing' AS child, {_dec("r -> 'timing'")} AS o FROM r UNION ALL SELECT line_id, row_pos, 'metric', {_dec("r -> 'metrics'")} FROM r),
n AS (SELECT line_id, row_pos, child, o, unnest(json_keys(o)) AS name FROM m WHERE json_type(o) = 'OBJECT')"""


def _has(x: str, key: str) -> str:
    return f"coalesce(json_type({x} -> '{key}'), 'NULL') <> 'NULL'"


@query(f"""WITH {_LINES}
SELECT line_id, row_pos::BIGINT AS row_pos, 'image' AS child, pos::BIGINT AS pos, -1::BIGINT AS sub_pos, name FROM i
UNION ALL SELECT line_id, row_pos::BIGINT, 'tile', pos::BIGINT, unnest(generate_series(0, n::BIGINT - 1))::BIGINT, name FROM t WHERE n > 0
UNION ALL SELECT line_id, row_pos::BIGINT, child, -1::BIGINT, -1::BIGINT, name FROM n WHERE json_type(json_extract(o, '$."' || name || '"')) <> 'NULL'""")
def p1_found(s, d):
    return nested.child_index(table(s, d, "prediction_lines"))


@query("""WITH i AS (SELECT pred_id, visual_pruning AS vp, unnest(selected_img_quotes) AS q, generate_subscripts(selected_img_quotes, 1) - 1 AS pos FROM predictions),
k AS (SELECT pred_id, pos, q.quote_id AS name, CASE WHEN q.visual_pruning IS NOT NULL THEN q.visual_pruning.keep_indices ELSE list_filter(vp, lambda e: e.quote_id = q.quote_id)[1].visual_pruning.keep_indices END AS kept FROM i),
f AS (SELECT pred_id, 'timing' AS child, unnest(['retrieval_sec', 'request_build_sec', 'ttft_sec', 'generation_sec', 'total_sec']) AS name, unnest([timing.retrieval_sec, timing.request_build_sec, timing.ttft_sec, timing.generation_sec, timing.total_sec]) AS v FROM predictions
  UNION ALL SELECT pred_id, 'metric', unnest(['em', 'f1', 'retrieval_recall', 'judge_correct', 'judge_score', 'judge_faithful', 'judge_faithfulness_score']),
    unnest([metrics.em, metrics.f1, metrics.retrieval_recall, metrics.judge_correct::DOUBLE, metrics.judge_score::DOUBLE, metrics.judge_faithful::DOUBLE, metrics.judge_faithfulness_score::DOUBLE]) FROM predictions)
SELECT pred_id, 'image' AS child, pos::BIGINT AS pos, -1::BIGINT AS sub_pos, q.quote_id AS name FROM i
UNION ALL SELECT pred_id, 'tile', pos::BIGINT, (generate_subscripts(kept, 1) - 1)::BIGINT, name FROM k WHERE len(kept) > 0
UNION ALL SELECT pred_id, child, -1::BIGINT, -1::BIGINT, name FROM f WHERE v IS NOT NULL""")
def p1_typed(s, d):
    return nested.flatten_predictions(table(s, d, "predictions"))


def _state(x: str) -> str:
    """The state of a visual pruning; null for what is no object."""
    kept = _dec(f"{x} -> 'keep_indices'")
    return f"""CASE WHEN json_type({x}) IS DISTINCT FROM 'OBJECT' THEN NULL WHEN json_type({kept}) = 'ARRAY' THEN CASE WHEN {_has(x, 'rendered_image_path')} THEN 'pruning_rendered' WHEN {_has(x, 'hook_required')} THEN 'pruning_hooked' ELSE 'pruning_kept' END
  WHEN {_has(x, 'skipped')} THEN 'pruning_skipped' WHEN {_has(x, 'mode')} AND {_has(x, 'tokens_before')} THEN 'pruning_bare' ELSE 'other' END"""


@query(f"""WITH {_LINES},
o AS (SELECT line_id, row_pos, {_dec("r -> 'timing'")} AS t, {_dec("r -> 'metrics'")} AS m, r FROM r),
x AS (SELECT q.line_id, q.row_pos, q.pos, {_dec('q.i')} AS i FROM q),
y AS (SELECT line_id, row_pos, pos, i, i ->> 'quote_id' AS name, {_dec("i -> 'visual_pruning'")} AS own FROM x WHERE json_type(i) = 'OBJECT'),
e AS (SELECT line_id, row_pos, generate_subscripts(v, 1) - 1 AS nth, unnest(v) AS e FROM p),
f AS (SELECT line_id, row_pos, nth, e ->> 'quote_id' AS name, {_dec("e -> 'visual_pruning'")} AS x FROM e WHERE json_type(e) = 'OBJECT'),
g AS (SELECT line_id, row_pos, name, min(nth) AS nth FROM f GROUP BY ALL),
h AS (SELECT y.line_id, y.row_pos, y.pos, CASE WHEN coalesce(json_type(y.own), 'NULL') = 'NULL' THEN g.nth END AS nth, CASE WHEN coalesce(json_type(y.own), 'NULL') = 'NULL' THEN f.x ELSE y.own END AS x FROM y LEFT JOIN g USING (line_id, row_pos, name) LEFT JOIN f ON f.line_id = y.line_id AND f.row_pos = y.row_pos AND f.nth = g.nth),
z AS (SELECT line_id, row_pos, x, TRUE AS shown FROM h WHERE json_type(x) = 'OBJECT' UNION ALL SELECT line_id, row_pos, x, FALSE FROM f WHERE json_type(x) = 'OBJECT' AND (line_id, row_pos, nth) NOT IN (SELECT line_id, row_pos, nth FROM h WHERE json_type(x) = 'OBJECT' AND nth IS NOT NULL)),
s AS (SELECT {_state('x')} AS variant, shown, CASE WHEN json_type({_dec("x -> 'keep_indices'")}) = 'ARRAY' THEN json_array_length({_dec("x -> 'keep_indices'")}) ELSE 0 END AS n FROM z),
c AS (SELECT 'record' AS child, CASE WHEN NOT {_has('r', 'q_id')} THEN 'other' WHEN json_type(t) = 'OBJECT' AND {_has('t', 'total_sec')} AND json_type(m) = 'OBJECT' AND {_has('m', 'em')} THEN 'record_measured' ELSE 'record' END AS variant, 1 AS n FROM o
  UNION ALL SELECT 'image', CASE WHEN {_has('i', 'quote_id')} AND {_has('i', 'layout_id')} AND {_state('own')} LIKE 'pruning%' THEN 'image_pruned' WHEN {_has('i', 'quote_id')} AND NOT {_has('i', 'visual_pruning')} THEN 'image_plain' ELSE 'other' END, 1 FROM y
  UNION ALL SELECT 'pruning', variant, 1 FROM s UNION ALL SELECT 'tile', CASE WHEN variant IN ('pruning_rendered', 'pruning_hooked', 'pruning_kept') THEN variant ELSE 'other' END, n FROM s WHERE shown
  UNION ALL SELECT child, CASE WHEN child = 'timing' AND {_has('o', 'total_sec')} THEN 'timing' WHEN child = 'metric' AND {_has('o', 'em')} THEN 'metrics' ELSE 'other' END, 1 FROM n WHERE json_type(json_extract(o, '$."' || name || '"')) <> 'NULL')
SELECT child, variant, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(n) > 0""")
def p1_variants(s, d):
    typed = nested.tables(nested.flatten_lines(table(s, d, "prediction_lines")))
    return nested.supertype(typed, "record", "image", "pruning", "tile", "timing", "metric").groupBy("child", "variant").agg(F.count("*").alias("n"))


_PRUNINGS = """n AS (SELECT pred_id, list_transform(visual_pruning, lambda e: e.quote_id) AS ids, list_transform(visual_pruning, lambda e: e.visual_pruning) AS vps, list_transform(selected_img_quotes, lambda q: q.quote_id) AS imgs, selected_img_quotes AS i FROM predictions),
i AS (SELECT pred_id, ids, vps, unnest(i) AS q, generate_subscripts(i, 1) - 1 AS pos FROM n),
j AS (SELECT pred_id, pos, q.quote_id AS name, q.visual_pruning AS own, CASE WHEN q.visual_pruning IS NULL THEN list_position(ids, q.quote_id) END AS e, vps FROM i),
t AS (SELECT pred_id, pos, coalesce(e - 1, -1) AS sub_pos, name, coalesce(own, vps[e]) AS v FROM j),
u AS (SELECT pred_id, coalesce(list_position(imgs, name) - 1, -1) AS pos, sub_pos, name, v FROM (SELECT pred_id, imgs, unnest(ids) AS name, unnest(vps) AS v, generate_subscripts(ids, 1) - 1 AS sub_pos FROM n)),
p AS (SELECT * FROM t WHERE v IS NOT NULL UNION ALL SELECT * FROM u WHERE v IS NOT NULL AND (pred_id, sub_pos) NOT IN (SELECT pred_id, sub_pos FROM t WHERE v IS NOT NULL AND sub_pos >= 0)),
s AS (SELECT *, CASE WHEN v.keep_indices IS NOT NULL AND v.rendered_image_path IS NOT NULL THEN 'pruning_rendered' WHEN v.keep_indices IS NOT NULL AND v.hook_required IS NOT NULL THEN 'pruning_hooked' WHEN v.keep_indices IS NOT NULL THEN 'pruning_kept'
  WHEN v.skipped IS NOT NULL THEN 'pruning_skipped' WHEN v.mode IS NOT NULL AND v.tokens_before IS NOT NULL THEN 'pruning_bare' ELSE 'other' END AS variant FROM p)"""


@query()
def p1_prunings(s, d):
    return nested.subtype(nested.tables(nested.flatten_lines(table(s, d, "prediction_lines"))), "pruning")


_TEXTS, _WHOLE, _FLAGS = ("mode", "reason", "rendered_image_path", "hook_point"), ("tokens_before", "tokens_after", "grid_rows", "grid_cols"), ("skipped", "hook_required")


@query(f"""WITH {_PRUNINGS} SELECT pred_id, pos::BIGINT AS pos, sub_pos::BIGINT AS sub_pos, name, variant, {', '.join(f"coalesce(v.{c}, '-') AS {c}" for c in _TEXTS)}, {', '.join(f"coalesce(v.{c}, -1)::BIGINT AS {c}" for c in _WHOLE)},
  {', '.join(f"CASE WHEN v.{c} THEN 'yes' WHEN NOT v.{c} THEN 'no' ELSE '-' END AS {c}" for c in _FLAGS)}, coalesce(array_to_string(v.keep_indices, ','), '-') AS keep_indices,
  coalesce(array_to_string(list_transform(v.keep_boxes, lambda b: array_to_string(b, ' ')), ';'), '-') AS keep_boxes, coalesce(len(v.scores), -1)::BIGINT AS scores, coalesce(round(list_sum(v.scores), 6), 0)::DOUBLE AS score FROM s""")
def p1_typed_prunings(s, d):
    p = nested.subtype(nested.tables(nested.prediction_nodes(table(s, d, "predictions"))), "pruning")
    boxes = F.array_join(F.transform("keep_boxes", lambda b: F.array_join(b.cast("array<string>"), " ")), ";")
    sums = F.when(F.size("scores") > 0, F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6))
    made = {"keep_indices": F.array_join(F.col("keep_indices").cast("array<string>"), ","), "keep_boxes": boxes, "score": F.coalesce(sums, F.lit(0.0)), "scores": F.coalesce(F.size("scores"), F.lit(-1)).cast("long")}
    flags = {c: F.when(F.col(c), "yes").when(~F.col(c), "no").otherwise("-") for c in _FLAGS}
    whole = {c: F.coalesce(F.col(c), F.lit(-1).cast("long")) for c in _WHOLE}
    return p.withColumnRenamed("line_id", "pred_id").withColumns(made | flags | whole).withColumns({c: F.coalesce(F.col(c), F.lit("-")) for c in (*_TEXTS, "keep_indices", "keep_boxes")}).drop("row_pos", "rest")


@query(f"""WITH {_PRUNINGS},
q AS (SELECT pred_id, q_id, timing, metrics, unnest(selected_img_quotes) AS q FROM predictions),
a AS (SELECT 'image' AS child, CASE WHEN q.quote_id IS NOT NULL AND q.layout_id IS NOT NULL AND (q.visual_pruning.keep_indices IS NOT NULL OR q.visual_pruning.skipped IS NOT NULL OR (q.visual_pruning.mode IS NOT NULL AND q.visual_pruning.tokens_before IS NOT NULL)) THEN 'image_pruned' WHEN q.quote_id IS NOT NULL AND q.visual_pruning IS NULL THEN 'image_plain' ELSE 'other' END AS variant FROM q
  UNION ALL SELECT 'pruning', variant FROM s
  UNION ALL SELECT 'record', CASE WHEN q_id IS NULL THEN 'other' WHEN timing.total_sec IS NOT NULL AND metrics.em IS NOT NULL THEN 'record_measured' ELSE 'record' END FROM predictions)
SELECT child, variant, count(*) AS n FROM a GROUP BY ALL""")
def p1_typed_variants(s, d):
    typed = nested.tables(nested.prediction_nodes(table(s, d, "predictions")))
    return nested.supertype(typed, "record", "image", "pruning").groupBy("child", "variant").agg(F.count("*").alias("n"))
