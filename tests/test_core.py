import json

import pytest
from pyspark.sql import functions as F

from quotemill.functions import judge, text
from quotemill.operators import nested, prompting, pruning, retrieval
from quotemill.plans import summary
from quotemill.sources import io


def one(spark, column, **cells):
    cols = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in cells.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("  The Cat,  sat. ", "the cat sat"), ("a - b", "a  b"), ("foo !", "foo "), ("Don't 50%", "dont 50"), ("!!!", ""), ("", ""), ("\xa0Café\xa0x", "café x"), ("x²½", "x²½"), ("ΟΔΟΣ", "οδος")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_text(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("42% [text3] [image2]", "42%"), ("a[t1]b", "ab"), ("[]", "[]"), ("[[a]b]", "b]"), ("A [x\ny] B", "A B")])
def test_strip_citations(spark, raw, want):
    assert one(spark, text.strip_citations(F.col("a")), a=raw) == want


@pytest.mark.parametrize("p, g, em, f1", [("a a b", "a a a c", 0.0, 0.5714285714285715), ("", "", 1.0, 1.0), ("!", "x", 0.0, 0.0), ("x", "y", 0.0, 0.0), ("foo !", "foo", 0.0, 1.0), ("It is 42 [text1]", "42", 0.0, 0.5)])
def test_lexical(spark, p, g, em, f1):
    got = one(spark, text.lexical_metrics(F.col("p"), F.col("g")), p=p, g=g)
    assert (got["em"], round(got["f1"], 12)) == (em, round(f1, 12))


def test_recall(spark):
    assert one(spark, text.retrieval_recall(F.col("p"), F.col("g")), p=["a", "a", "b"], g=["a", "a", "c"]) == 0.5
    assert spark.sql("select cast(null as array<string>) p, cast(null as array<string>) g").select(text.retrieval_recall(F.col("p"), F.col("g"))).first()[0] == 0.0


@pytest.mark.parametrize("n, ratio, want", [(0, 0.5, 0), (1, 0.5, 1), (2, 0.5, 1), (3, 0.5, 1), (4, 0.5, 2), (10, 0.29, 2), (100, 0.29, 28), (7, 1, 7), (4, 0.01, 1)])
def test_keep_count(spark, n, ratio, want):
    assert one(spark, pruning.keep_count(F.col("n"), ratio), n=n) == want


def test_patch_keep(spark):
    scores = [0.1, 0.9, 0.5, 0.7, 0.3, 0.2, 0.8, 0.4]
    assert one(spark, pruning.patch_keep(F.col("s"), 0.5), s=scores) == [1, 2, 3, 6]
    for n, ratio, least, want in ((16, 0.5, 4, 8), (16, 0.1, 4, 4), (4, 0.5, 4, 4), (2, 0.5, 4, 2), (16, 1, 4, 16), (9, 0.5, 0, 4)):
        assert len(one(spark, pruning.patch_keep(F.col("s"), ratio, least), s=[float(i) for i in range(n)])) == want


@pytest.mark.parametrize("kept, fine, grid, want", [([0, 5], 7, 4, [0, 1, 7, 8, 16, 17, 23, 24]), ([0], 2, 1, [0, 1, 2, 3]), ([0, 1, 2, 3, 5, 15], 2, 4, [0]), ([16], 7, 4, [])])
def test_coarse_to_fine(spark, kept, fine, grid, want):
    assert one(spark, pruning.coarse_to_fine(F.col("k"), fine, grid, grid), k=kept) == want


def test_boxes_tile_the_image(spark):
    boxes = one(spark, pruning.grid_boxes(F.col("w"), F.col("h")), w=1001, h=3)
    assert [b[0] for b in boxes[:4]] + [boxes[3][2]] == [0, 250, 500, 750, 1001]
    assert sum((b[2] - b[0]) * (b[3] - b[1]) for b in boxes) == 1001 * 3


def test_parameters_are_checked():
    for bad in (("x", 0.5), ("no_pruning", 0), ("no_pruning", 1.1)):
        with pytest.raises(ValueError):
            pruning.check(*bad)


def test_judge(spark):
    v = lambda s: one(spark, judge.judge_verdict(F.col("r")), r=s)
    assert v('{"correct":"1","faithful":true,"faithfulness_score":4.7}')[0] == 1
    assert v('{"faithful":true,"faithfulness_score":4.7}')["faithfulness_score"] == 4
    assert v('{"correct":null}')["correct"] == 0
    assert v("not json")["reason"] == "Judge returned invalid JSON: not json"


def test_top_k_ties_nan_and_plan(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (0, 3, [float("nan"), 0.0]), (0, 4, None), (1, 5, [0.5, 0.0])]
    c = spark.createDataFrame(rows, "example long, pos long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "example long, embedding array<double>")
    out = retrieval.top_k(c, q, 3)
    assert [r["pos"] for r in out.orderBy("rk").collect()] == [1, 2, 3]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_prompt_of_nulls(spark):
    t = "array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>"
    i = "array<struct<quote_id:string,img_description:string,page_id:long,layout_id:long>>"
    df = spark.createDataFrame([("q", [("text1", None, None, 2)], None)], f"question string, t {t}, i {i}")
    got = df.select(prompting.build_prompt(F.col("question"), F.col("t"), F.col("i")).alias("p"), prompting.evidence_text(F.col("t"), F.col("i")).alias("e")).first()
    assert "- [text1] (page None, layout 2): \n\nReturn a short answer." in got["p"] and got["e"] == "[text1] TEXT: "


def test_summary_of_nothing(spark):
    schema = "timing struct<retrieval_sec:double,ttft_sec:double,generation_sec:double,total_sec:double>, metrics struct<em:double,f1:double,retrieval_recall:double,judge_correct:long,judge_score:long,judge_faithful:long,judge_faithfulness_score:long>"
    r = summary.summarize(spark.createDataFrame([], schema)).first()
    assert r["num_examples"] == 0 and r["avg_total_sec"] is None


def test_metrics_text(spark):
    lines = ["# HELP x", "", 'a{l="1"} 1.5', 'a{l="2"} 2', "b nope", "c 3 4"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    assert {r["name"]: r["value"] for r in io.metrics_text(df, wanted=None).collect()} == {"a": 2.0, "c": 4.0}


def test_examples_round_trip(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"q_id": "1", "doc_name": "d", "question": "?", "img_quotes": [{"quote_id": "i", "img_path": "/abs.png"}], "other": 1}) + "\n\n")
    r = io.read_examples(spark, str(tmp_path / "x.jsonl"), "root", 5).first()
    assert r["img_quotes"][0]["local_img_path"] == "/abs.png" and r["gold_quotes"] == [] and r["answer_short"] == ""
    (tmp_path / "y.jsonl").write_text('{"q_id": "1", "question": "?"}\n')
    with pytest.raises(Exception, match="missing doc_name"):
        io.read_examples(spark, str(tmp_path / "y.jsonl"), "root").collect()


def test_nested_children(spark):
    image = {"quote_id": "i1", "layout_id": 1, "visual_pruning": '{"keep_indices": ["3", 5]}'}
    record = {"selected_img_quotes": image, "timing": {"a": 1, "b": None}, "metrics": None}
    second = {"selected_img_quotes": [{"quote_id": "i2"}, None], "visual_pruning": json.dumps([{"quote_id": "i2", "visual_pruning": {"keep_indices": [7]}}])}
    lines = [json.dumps(record), json.dumps({"summary": {}, "rows": [record, None, second]}), "{broken", "[]", "null", None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = {tuple(r) for r in nested.child_index(df).collect()}
    first = {("image", 0, -1, "i1"), ("tile", 0, 0, "i1"), ("tile", 0, 1, "i1"), ("timing", -1, -1, "a")}
    assert got == {(0, 0, *x) for x in first} | {(1, 0, *x) for x in first} | {(1, 2, "image", 0, -1, "i2"), (1, 2, "tile", 0, 0, "i2")}
    assert nested.child_index(df.limit(0)).count() == 0
    typed = nested.tables(nested.flatten_lines(df))
    assert set(typed) == set(nested.TABLES) and nested.supertype(typed, "record").count() == 3
    tile = typed["tile", "pruning_kept"].orderBy("line_id", "row_pos", "sub_pos").first()
    assert (tile["keep_index"], tile["score"], tile["box"]) == (3, None, None)


def test_lines_that_are_hard_to_read(spark):
    deep = "[" * 100_000
    hard = {"q_id": "\ud800x", "question": deep, "selected_img_quotes": [{"quote_id": "i", "page_id": 1e30, "layout_id": 10**400, "img_path": deep, "visual_pruning": {"keep_indices": [10**400, "1e30", {"a": 1}, None], "scores": [10**400]}}], "timing": {"total_sec": 10**400, "\udc00": "x"}, "metrics": deep}
    lines = [json.dumps(hard), '{"q_id":' + "9" * 5000 + ',"timing":{"total_sec":1}}', deep, '{"a":' + deep + "]" * 100_000 + "}", '{"rows":[1,"x",[],{"timing":"{}"}]}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = sorted(tuple(r)[0:5] for r in nested.child_index(df).collect())
    assert got == [(0, 0, "image", 0, -1), *[(0, 0, "tile", 0, k) for k in range(4)], (0, 0, "timing", -1, -1), (0, 0, "timing", -1, -1), (1, 0, "timing", -1, -1)]
    image = nested.subtype(nested.tables(nested.flatten_lines(df)), "image").first()
    assert image["page_id"] is None and image["layout_id"] is None and image["variant"] == "image_pruned"


def test_requests(spark):
    from quotemill.operators import request
    from quotemill.sources import telemetry

    df = spark.sql("select array(named_struct('quote_id', 'a', 'visual_pruning', named_struct('keep_indices', array(1, 2))), named_struct('quote_id', 'b', 'visual_pruning', null)) i, array('QQ', null) e")
    r = df.select(request.request_extras("model_internal_visual_pruning", 0.5, F.col("i")).alias("x"), request.message_parts(F.lit("hi"), F.col("e")).alias("m"), F.size(request.visual_meta(F.col("i"))).alias("n")).first()
    assert r["x"]["image_keep_indices"] == [[1, 2]] and r["x"]["image_keep_ratio"] == 0.5 and [p["type"] for p in r["m"]] == ["text", "image_url"] and r["n"] == 1
    for image, n, kept, want in ((False, 4, [1], "missing_image"), (True, 5, [1], "non_square_patch_grid"), (True, 9, [], "empty_keep_indices"), (True, 9, [1], "applied")):
        assert one(spark, request.probe_outcome(F.col("a"), F.col("n"), F.col("k")), a=image, n=n, k=kept) == want
    assert telemetry.host_memory(spark).first()["total_gib"] > 0


def test_every_pruning_has_a_row(spark):
    skipped = {"mode": "m", "skipped": True, "reason": "small", "tokens_before": 5, "tokens_after": 5, "probe": {"a": 1}}
    kept = {"mode": "m", "tokens_before": 9, "tokens_after": "2", "keep_indices": "[1, 2]", "keep_boxes": [[0, 0, 1, 1]], "rendered_image_path": "p.png"}
    record = {"selected_img_quotes": [{"quote_id": "i1", "visual_pruning": skipped}, {"quote_id": "i2", "visual_pruning": kept}, {"quote_id": "i3"}]}
    record["visual_pruning"] = [{"quote_id": "i3", "visual_pruning": {"mode": "b", "tokens_before": 7}}, {"quote_id": "lost", "visual_pruning": {"keep_indices": [4], "hook_required": False}}]
    typed = nested.tables(nested.flatten_lines(spark.createDataFrame([(1, json.dumps(record))], "line_id long, line string")))
    got = {r["name"]: r for r in nested.subtype(typed, "pruning").collect()}
    assert {n: (r["variant"], r["pos"], r["sub_pos"]) for n, r in got.items()} == {"i1": ("pruning_skipped", 0, -1), "i2": ("pruning_rendered", 1, -1), "i3": ("pruning_bare", 2, 0), "lost": ("pruning_hooked", -1, 1)}
    assert got["i1"]["reason"] == "small" and got["i1"]["skipped"] is True and "probe" in got["i1"]["rest"] and got["i2"]["keep_boxes"] == [[0, 0, 1, 1]] and got["i2"]["tokens_after"] == 2 and got["i2"]["keep_indices"] == [1, 2]
    assert "reason" not in typed["pruning", "pruning_rendered"].columns and got["lost"]["hook_required"] is False and got["i3"]["rest"] is None


def test_states_come_from_below():
    assert nested.PREDICTIONS.state({"quote_id": "i", "layout_id": 1, "visual_pruning": {"keep_indices": "[1]"}}) == "image_pruned"
    assert nested.PREDICTIONS.state({"q_id": "1", "timing": {"total_sec": 1}, "metrics": {"em": 1}}) == "record_measured"
    assert nested.PREDICTIONS.state({"quote_id": "i", "layout_id": 1, "visual_pruning": "none"}) == nested.PREDICTIONS.state({"keep_indices": 3}) == "other"
