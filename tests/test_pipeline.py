import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.functions import judge, pixels, text
from quotemill.operators import encoders, pruning, request, retrieval
from quotemill.plans import pipeline, summary
from quotemill.sources import io, telemetry

TEXT = "array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>"
IMAGE = "array<struct<quote_id:string,img_path:string,local_img_path:string,img_description:string,page_id:long,layout_id:long>>"


@pytest.fixture
def examples(spark):
    texts = [("t1", "the mill by the river", 1, 101), ("t2", None, None, None), ("t3", "zzz zzz", 2, 201), ("t4", "the mill", 3, 301), ("t5", "river mill town", 4, 401)]
    images = [("i1", "a.png", "img/a.png", "mill", 1, 1), ("i2", "", "", "zz", 2, 4), ("i3", "b.png", "img/b.png", None, 3, 3)]
    rows = [("q1", "where is the mill", texts, images, ["t1", "i1"], "the river"), ("q2", None, [], None, None, None), ("q3", "mill", None, [], [], "mill")]
    return spark.createDataFrame(rows, f"q_id string, question string, text_quotes {TEXT}, img_quotes {IMAGE}, gold_quotes array<string>, answer_short string")


def tiles(question, images):
    one = lambda q: F.struct(F.when(q["layout_id"] != 4, F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: k.cast("double"))).alias("scores"), F.lit(100).alias("width"), F.lit(40).alias("height"))
    return F.transform(images, one)


def stages(answer=encoders.first_evidence):
    missing = lambda paths: F.transform(paths, lambda p: F.when(p != "", encoders.letters(F.array(p))[0]))
    return pipeline.Stages(encoders.letters, encoders.letters, missing, answer, tiles)


@pytest.mark.parametrize("mode", pruning.MODES)
def test_run(spark, examples, mode):
    rows = {r["q_id"]: r for r in pipeline.run(examples, pipeline.Config(mode=mode), stages()).collect()}
    first, empty = rows["q1"], rows["q2"]
    assert set(first.asDict()) == {*pipeline.ROW, "metrics"} and empty["pred_answer"] == "The evidence is insufficient." and empty["retrieved_quote_ids"] == []
    listed = mode in ("uniform_pruning", "visual_only_pruning")
    assert len(first["selected_img_quotes"]) == (1 if listed else 2) and len(first["selected_text_quotes"]) == (2 if mode == "uniform_pruning" else 4)
    assert first["pruning"]["visual_tokens_after"] == {"no_pruning": 32}.get(mode, 16) and "i2" not in first["retrieved_quote_ids"]
    assert (first["selected_img_quotes"][0]["local_img_path"].startswith("pruned_images/q1_")) == (mode == "visual_patch_pruning")
    assert [m["quote_id"] for m in first["visual_pruning"]] == ([] if mode not in pruning.PATCH_MODES else [q["quote_id"] for q in first["selected_img_quotes"]])
    plan = pipeline.run(examples, pipeline.Config(mode=mode), stages())._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_patch_modes_need_a_scorer(examples):
    with pytest.raises(ValueError):
        pipeline.run(examples, pipeline.Config(), pipeline.Stages(*[encoders.letters] * 3, encoders.first_evidence))


def test_skipped_image(spark):
    df = spark.sql(f"select array(named_struct('quote_id', 'a', 'local_img_path', 'x/a.b.png', 'visual_pruning', cast(null as {pruning.META}))) i, array(named_struct('scores', cast(null as array<double>), 'width', 1, 'height', 1)) t")
    q = df.select(pruning.apply_policy("visual_patch_pruning", 0.29, F.array().cast(TEXT), F.col("i"), F.col("t")).alias("k")).first()["k"]["selected_img_quotes"][0]
    assert (q["local_img_path"], q["visual_pruning"]["reason"], q["visual_pruning"]["tokens_after"], q["visual_pruning"]["keep_indices"]) == ("x/a.b.png", "missing_image", 16, None)
    assert df.select(pruning.montage_name(F.lit("x/a.b.png"), "m", 0.29, F.lit("q"))).first()[0] == "q_a.b_pruned_m_28.png"


def test_encoders_in_batches(spark, examples):
    both = retrieval.retrieve(examples, encoders.hashed(16), encoders.hashed(16), encoders.hashed(16))
    got = {r["q_id"]: r for r in both.collect()}
    assert [q["quote_id"] for q in got["q1"]["selected_text_quotes"]][0] in ("t1", "t4") and got["q2"]["selected_text_quotes"] == [] and len(got["q1"]["selected_img_quotes"]) == 2
    reply = encoders.chat(lambda: lambda p: p.upper())
    assert [r[0] for r in spark.sql("select explode(array('a', null)) p").select(reply("p")).collect()] == ["A", None]


def test_judging_saved_rows(spark, examples, tmp_path):
    config = pipeline.Config(mode="uniform_pruning")
    rows = pipeline.run(examples, config, stages())
    io.write_results(rows, pipeline.summarized(rows, config), str(tmp_path))
    again = io.read_rows(spark, str(tmp_path), rows.schema)
    order = lambda df: sorted(str(r["q_id"]) + str(r["metrics"]) + str(r["timing"]) for r in df.collect())
    assert order(again) == order(rows)
    saved = json.loads(next((tmp_path / "summary").glob("part-*")).read_text())
    assert saved["num_examples"] == 3 and saved["avg_ttft_sec"] is None and "avg_judge_score" not in saved and saved["pruning_mode"] == "uniform_pruning" and "avg_em" in saved
    after = pipeline.judged(again, encoders.same_words)
    judged = {r["q_id"]: r for r in after.collect()}
    assert judged["q3"]["metrics"]["judge_correct"] == 0 and judged["q1"]["metrics"]["judge_faithful"] == 1 and judged["q1"]["metrics"]["em"] == 0.0 and judged["q1"]["evidence_text"].startswith("[t")
    none = telemetry.utilization(*[spark.createDataFrame([("a", 1.0)], "name string, value double")] * 2, *[telemetry.host_memory(spark)] * 2, io.folder_gib(spark, str(tmp_path / "no")), io.folder_gib(spark, str(tmp_path)))
    assert none.first()["folder_gib_before"] == 0.0 and none.first()["folder_gib_delta"] > 0
    io.write_report(after, pipeline.summarized(after, config), none, str(tmp_path / "report"))
    assert json.loads(next((tmp_path / "report" / "system_utilization").glob("part-*")).read_text())["metrics_after"] == {"a": 1.0}


def test_summary_of_nothing_keeps_its_keys(spark):
    schema = "timing struct<retrieval_sec:double,ttft_sec:double,generation_sec:double,total_sec:double>, metrics struct<em:double,f1:double,retrieval_recall:double,judge_correct:long,judge_score:long,judge_faithful:long,judge_faithfulness_score:long>"
    r = summary.as_json(summary.summarize(spark.createDataFrame([], schema))).first()["json"]
    assert json.loads(r) == {"num_examples": 0, "avg_retrieval_sec": None, "avg_ttft_sec": None, "avg_generation_sec": None, "avg_total_sec": None}


def test_files(spark, tmp_path):
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b+c.png").write_bytes(pixels.encode_png(image))
    (tmp_path / "in" / "b.ppm").write_bytes(b"P6\n7 5\n255\n" + image.tobytes())
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    assert {(r["name"], r["length"] > 0) for r in io.list_files(spark, str(tmp_path / "in")).collect()} == {("a b+c.png", True), ("b.ppm", True), ("c.png", True)}
    images = io.scan_images(spark, str(tmp_path / "in"))
    assert sorted((r["width"], r["height"]) for r in images.collect()) == [(7, 5), (7, 5)]
    kept = images.withColumn("keep_boxes", F.array(F.array(*map(F.lit, (0, 0, 3, 5))), F.array(*map(F.lit, (3, 0, 7, 5))))).withColumn("path", F.concat(F.lit(str(tmp_path / "out") + "/"), F.md5("path"), F.lit(".png")))
    assert [r["written"] for r in io.write_montages(io.render_montages(kept, 8)).collect()] == [True, True]
    shown = pixels.decode(next((tmp_path / "out").iterdir()).read_bytes())
    assert shown.shape == (8, 16, 3) and (shown[0, 0] == 255).all() and (shown[4, 9] < 255).any()
    e = spark.createDataFrame([(1, [("x",), ("",), (None,), ("y",)]), (2, None)], "k long, img_quotes array<struct<local_img_path:string>>")
    got = io.with_existing(e, spark.createDataFrame([("x",), ("x",), ("z",)], "path string"), "k").collect()
    assert {r["k"]: r["existing"] for r in got} == {1: ["x"], 2: []}


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import struct
    import zlib

    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (6, 9, 3)).astype(np.uint8)
    flat, lines = image.reshape(6, 27).astype(int), []
    for y in range(6):
        up = flat[y - 1] if y else np.zeros(27, int)
        left, corner = np.r_[0, 0, 0, flat[y, :-3]], np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines.append(bytes([kind]) + ((flat[y] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (pixels.decode(png) == image).all()


def test_file_order_over_several_files(spark, tmp_path):
    for k, name in enumerate("ba"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"q_id": f"{name}{i}", "doc_name": "d", "question": "?", "pad": "x" * 300 * k}) + "\n" for i in range(300)))
    assert [r["q_id"] for r in io.read_examples(spark, str(tmp_path), "root", 302).collect()] == [f"a{i}" for i in range(300)] + ["b0", "b1"]
    assert io.read_examples(spark, str(tmp_path), "root", 0).count() == 0


def test_replies_in_white_space(spark):
    v = spark.createDataFrame([('\n {"correct":1,"score":5}\n',), ('{"correct":1}\n{"correct":1}',), (None,)], "r string").select(judge.judge_verdict(F.col("r")).alias("v")).collect()
    assert [(r["v"]["correct"], r["v"]["score"]) for r in v] == [(1, 5), (0, 0), (0, 0)]


def test_scores_of_long_and_dirty_texts(spark):
    rng = np.random.default_rng(0)
    pairs = [(" ".join(f"w{x}" for x in rng.integers(0, 400, n)), " ".join(f"w{x}" for x in rng.integers(0, 400, m))) for n, m in ((3000, 2000), (5, 9), (1, 1))] + [("", ""), ("!", "x"), (None, "x"), ("x", None)]
    df = spark.createDataFrame([(i, p, g, 1.0) for i, (p, g) in enumerate(pairs)], "i long, p string, g string, f double")
    got = {r["i"]: (r["em"], r["f1"]) for r in text.answer_scores(df, "p", "g").collect()}
    for i, (p, g) in enumerate(pairs[:5]):
        a, b = p.replace("!", "").split(), g.split()
        same = sum(min(a.count(w), b.count(w)) for w in set(a))
        want = 1.0 if not a and not b else 0.0 if not same else 2 * same / (len(a) + len(b))
        assert abs(got[i][1] - want) < 1e-12 and got[i][0] == float(a == b)
    assert got[5] == got[6] == (None, None)


def test_probe(spark):
    meta = "named_struct('grid_rows', 4L, 'grid_cols', 4L, 'keep_indices', array(0L, 5L))"
    cases = {"true, array(1L, 50L, 8L)": None, "false, array(1L, 50L, 8L)": "missing_image", "true, cast(null as array<bigint>)": "no_last_hidden_state", "true, array(2L, 50L, 8L)": "unexpected_hidden_shape", "true, array(1L, 51L, 8L)": "non_square_patch_grid", "true, array(1L, 2L, 8L)": "empty_keep_indices"}
    for case, want in cases.items():
        ok, shape = case.split(", ", 1)
        o = spark.sql(f"select {ok} e, {shape} s, {meta} m").select(request.probe(F.col("e"), F.col("s"), F.col("m")).alias("o")).first()["o"]
        assert o["reason"] == want and o["applied"] == (want is None)
        if want is None:
            assert o["mapped_patch_indices"] == [0, 1, 7, 8, 16, 17, 23, 24] and o["pruned_shape"] == [1, 9, 8] and o["tokens_before"] == 49
    h = spark.sql("select array(array(0D), array(1D), array(2D)) h, array(1) m").select(request.prune_hidden(F.col("h"), F.col("m"))).first()[0]
    assert h == [[0.0], [2.0]]


def test_tile_scores(spark):
    df = spark.sql("select array(array(1D, 0D), array(1D, 1D), array(0D, 0D)) t, array(2D, 0D) q, cast(null as array<array<double>>) n")
    r = df.select(retrieval.tile_scores(F.col("t"), F.col("q")).alias("s"), retrieval.tile_scores(F.col("n"), F.col("q")).alias("n")).first()
    assert r["s"][0] == 1.0 and abs(r["s"][1] - 0.5**0.5) < 1e-12 and r["s"][2] != r["s"][2] and r["n"] is None
