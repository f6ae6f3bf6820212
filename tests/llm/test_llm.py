import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotemill.llm import leaks, packing, pairs, percentiles, reading, scans, splits, splitting


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_is_whole_and_fits(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    out = packing.harmonic_fill(sizes, 64)
    used = np.bincount(out, weights=sizes) if len(sizes) else np.array([])
    assert len(out) == len(sizes) and (used <= 64).all() and (used > 0).all()


def test_packing_table(spark):
    df = spark.createDataFrame([(1, 5000, "x"), (2, None, "x"), (3, 0, "x"), (4, 4096, "x"), (4, 4096, "x"), (5, 10, "x")], "doc_id long, size long, container string")
    out = packing.pack(df, "doc_id", "size").collect()
    assert sum(r["size"] for r in out) == 5000 + 2 * 4096 + 10
    assert {r["doc_id"] for r in out if r["pieces"] > 1} == {1}
    assert packing.pack(df.limit(0), "doc_id", "size").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n\r\t。é", max_size=300))
def test_pieces_cover_the_text(text):
    at = splitting.boundaries(text)
    pieces = splitting.piece_offsets(text, at, 20, 5)
    end = 0
    for a, b, _ in pieces:
        assert a <= end < b and b - a <= 20 and end - a <= 5
        end = b
    assert end == len(text)


@pytest.mark.parametrize("text, want", [("a" * 10 + "\n \t\n" + "b" * 10, "paragraph"), ("a" * 8 + ". " + "b" * 9 + ".", "sentence"), ("aaaa bbbb cccc", "word"), ("a" * 30, "none"), ("漢字。" * 6, "sentence"), ("aaaa\r\nbbbb\r\ncccc", "word"), ("a" * 10 + "\r\n \r\n" + "b" * 10, "paragraph"), ("a" * 10 + "\r\r\n" + "b" * 10, "paragraph")])
def test_boundary_levels(text, want):
    assert splitting.sufficient_level(text, splitting.boundaries(text), 12) == want


def test_split_table(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "word " * 400, 7)], "id long, text string, start long").drop("start")
    rows = splitting.split_oversized(df).collect()
    assert {r["id"] for r in rows} == {1, 2, 3} and all(len(r["piece"] or "") <= 1500 for r in rows)


def test_pieces_make_the_text_again(spark):
    texts = [None, "", "word\r\n" * 700, "a. " * 600 + "\n\n" + "b" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in splitting.rebuilt(splitting.split_oversized(df), "id").collect()}
    assert all(got[i]["chars"] == len(t or "") and got[i]["digest"] == hashlib.md5((t or "").encode()).hexdigest() and got[i]["fits"] and got[i]["repeats"] for i, t in enumerate(texts))


def test_document_keys():
    same = ["scans/b/Falégate_Guía 2000.pdf", "in\\FALÉGATE-GUÍA-2000.TIFF", "falégate guía 2000 .pdf "]
    assert len({splits.document_key(s) for s in same}) == 1
    assert splits.document_key("a_v2.pdf") != splits.document_key("a.pdf") and splits.document_key(None) is None


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 120, (90, 2))] + [("hub", f"h{i}") for i in range(50)] + [(None, "x"), ("y", "y")]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in splits.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: find(x) for x in up}


def test_splits_keep_groups(spark):
    rows = [(i, f"q{i // 2}", None if i % 17 == 0 else f"Doc_{0 if i % 3 == 0 else i // 5}.pdf", ["a", "b", None][i % 3], "t") for i in range(600)]
    df = spark.createDataFrame(rows, "example_no long, q_id string, doc_name string, domain string, question_type string")
    out = splits.split_examples(df).toPandas()
    assert len(out) == 600 and out.example_no.is_unique
    m = out.merge(pd.DataFrame(rows, columns=["example_no", "q_id", "doc_name", "domain", "t"]))
    assert (m.groupby("q_id").split.nunique() == 1).all() and (m.dropna().groupby("doc_name").split.nunique() == 1).all()
    assert splits.same_documents(df.limit(0)).count() == 0


DEFECTS = [
    ("What was the wage in 2005?", None, "4", "empty"), ("What was the wage in 2005?", " [text1] ​…", "4", "empty"),
    ("What was the wage in 2005?", "WHAT WAS THE WAGE IN 2005 [text1]", "4", "copy"), ("What was the wage in 2005?", "What was the wage in 2005? It was 4.", "4", None),
    ("What was the wage in 2005?", "I'm sorry, but I can't help with that.", "4", "refusal"), ("What was the wage in 2005?", "Not answerable.", "The document does not say.", None),
    ("What was the wage in 2005?", "I cannot be fully certain, but it was 4 in the town.", "4", None), ("What was the wage in 2005?", "The wage was 4 in 2005 [te", "4", "truncated"),
    ("What was the wage in 2005?", "The wage was 4. The town of the", "4", "truncated"), ("What was the wage in 2005?", "The wage was 4 in 2005", "4", None),
    ("What was the wage in 2005?", "Der Lohn von Ulm lag im Jahr bei 4.", "4", "language"), ("What was the wage in 2005?", "4", None, None), (None, "4", None, None),
]


@pytest.mark.parametrize("q, a, g, want", DEFECTS)
def test_defects(q, a, g, want):
    assert pairs.defect(q, a, g)[0] == want


def test_flagged_table(spark):
    rows = [(i, q, a, g) for i, (q, a, g, _) in enumerate(DEFECTS)] + [(99, "How was it?", "The mills joined the low-cost resort joi", "x"), (0, *DEFECTS[0][:3])]
    df = spark.createDataFrame(rows, "pred_id long, question string, pred_answer string, gold_answer string")
    got = {(r[0], r[1]) for r in pairs.flag_pairs(df).collect()}
    assert got == {(i, w) for i, (_, _, _, w) in enumerate(DEFECTS) if w} | {(99, "truncated")}
    assert pairs.flag_pairs(df.limit(0)).count() == 0


def _item(n, seed=3):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_leaks(spark):
    words = _item(60)
    changed = [("zz" if i % 7 == 3 else w) for i, w in enumerate(words)]
    often = [("zz" if i % 4 == 3 else w) for i, w in enumerate(words)]
    docs = [(1, "x " + " ".join(words[10:30])), (2, " ".join(words[10:29])), (3, " ".join(changed)), (4, " ".join(often)), (5, None), (6, ""), (7, "a\n> " + " ".join(words[:25]).upper().replace(" ", ",\n", 3))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "short one")], "item_id long, text string")
    assert {tuple(r) for r in leaks.find_leaks(d, i).collect()} == {(1, 1), (3, 1), (7, 1)}
    assert leaks.find_leaks(d, i.limit(0)).count() == 0 and leaks.find_leaks(d.limit(0), i).count() == 0


def test_word_comparison_ignores_dress():
    assert leaks.words_of("“Long-\n> term” d’Été 3,050​") == leaks.words_of("longterm d'été 3050")


def test_reading_levels(spark):
    easy = "The cat sat on the mat. It was a hot day for us. " * 5
    hard = "Heteroscedasticity under administrative constraints instantiates precisely those categorical properties that infinitesimal parameterisation presupposes and correspondingly underdetermination of the institutional methodology that legitimises contemporaneous phenomenological configuration. " * 3
    docs = [(1, easy), (2, hard), (3, None), (4, ""), (5, "| a | b |\n" * 40), (6, "Der Hund und die Katze sind auf dem Weg. " * 8)]
    got = {tuple(r) for r in reading.clear_cases(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "easy"), (2, "hard")}


def test_held_out_agreement(spark):
    rng = np.random.default_rng(7)
    short, long = "the cat sat on a mat in the hot sun and ran to us".split(), [w + x for w in ("administrat", "institut", "categoric", "parameter") for x in ("ionality", "ionalised", "isations")] + ["the", "of"]
    docs = [(i, " ".join(" ".join(rng.choice(w, n)) + "." for _ in range(8))) for i, (w, n) in enumerate([(short, 9), (long, 25)] * 40)]
    got = {(r["formula"], r["lean"]): r["texts"] for r in reading.agreement(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("formula", "lean").agg(F.sum("texts").alias("texts")).collect()}
    assert set(got) == {("easy", "easy"), ("hard", "hard")} and 20 < sum(got.values()) < 60


def test_prose_only():
    text = "5.7 Spare sensor\n| a | 1 |\nTable 3. Thin rules, 2001–2004\n* point\ndoc://a/b?c=1\n[text7] (page 7, layout 47)\nThe cat sat. It ran."
    assert reading.prose_paragraphs(text) == ["The cat sat. It ran."]


def test_anagram_corrections(spark):
    rows = [("modern", 500), ("modem", 3), ("rnodern", 2), ("moclern", 4), ("m0dern", 1), ("zzzz", 1), ("under", 400), ("uncler", 2)]
    got = {tuple(r) for r in scans.corrections(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {("moclern", "modern"), ("m0dern", "modern"), ("rnodern", "modern"), ("uncler", "under")} <= got and not any(w == "zzzz" for w, _ in got)


def test_scan_noise(spark):
    text1 = "Ularithorn Fielcl Manual 2015\nThe gar-\nden was open and the"
    rows = [(1, "ularithorn_field_manual_2015_0000000.pdf", [("t1", text1, 9, 901), ("t2", "Page 10 of 20\nboats were there.", 10, 1001), ("t3", None, None, None)]), (2, None, None)]
    df = spark.createDataFrame(rows, "example_no long, doc_name string, text_quotes array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>")
    assert {tuple(r) for r in scans.find_noise(df).collect()} == {(1, "t1", "header"), (1, "t1", "hyphen"), (1, "t1", "continues"), (1, "t2", "pageno")}
    assert scans.find_noise(df, most=-1).exceptAll(scans.find_noise(df)).count() == 0
    assert scans.repair(df).where("example_no = 1").first()["text"] == "The garden was open and the boats were there."


@pytest.mark.parametrize("block", [500_000, 3])
def test_multi_select_against_sorting(spark, monkeypatch, block):
    monkeypatch.setattr(percentiles, "PART_ROWS", 700)
    rng = np.random.default_rng(5)
    values = {1: rng.lognormal(size=3000), 2: np.repeat([1.0, 2.0, 3.0], 400), 3: np.array([4.0]), 4: rng.normal(size=90), 5: np.r_[np.full(900, 7.0), rng.normal(size=50)]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g long, v double").repartition(6)
    parts, trace = (0.0, 0.01, 1 / 3, 0.5, 0.9, 0.99, 1.0), []
    got = {(r[0], r[1]): r[2] for r in percentiles.select_ranks(df, parts, finish=8, block=block, trace=trace).collect()}
    ranks = {(g, max(1, int(np.ceil(p * len(vs) - 1e-9)))) for g, vs in values.items() for p in parts}
    assert got == {(g, r): float(np.sort(values[g])[r - 1]) for g, r in ranks}
    assert len(trace) >= 6 and trace[-1][1] < 400
    assert percentiles.select_ranks(df.limit(0), parts).count() == 0


def test_percentiles_of_dirty_rows(spark):
    t = "timing_id long, run_id string, started_at string, received_at string, timing struct<ttft_sec:double,total_sec:double>"
    day, late = "2025-01-01 10:00:00", "2025-01-02 00:00:00"
    rows = [(1, "r", day, day, (9.0, 9.0)), (1, "r", day, late, (1.0, float("nan"))), (2, "r", day, None, (2.0, 0.0)), (None, "r", day, day, (3.0, -1.0)), (None, "r", day, day, (3.0, None)), (3, None, None, day, None)]
    times = spark.createDataFrame(rows, t).selectExpr("timing_id", "run_id", "cast(started_at as timestamp) started_at", "cast(received_at as timestamp) received_at", "timing")
    runs = spark.createDataFrame([("r", " No-Pruning"), (None, None)], "run_id string, pruning_mode string")
    got = {(r["pruning_mode"], r["metric"], r["p"]): (r["n"], r["value"]) for r in percentiles.percentiles(times, runs).collect()}
    assert got["no_pruning", "ttft_sec", 0.5] == (4, 2.0) and got["no_pruning", "ttft_sec", 0.99] == (4, 3.0) and {k[1] for k in got} == {"ttft_sec"}
    assert percentiles.percentiles(times.limit(0), runs).count() == 0


def test_combined_days_stay_within_the_bound(spark):
    rng = np.random.default_rng(2)
    days = {f"d{i}": rng.lognormal(i, 1, size=500 * (i + 1)) for i in range(3)}
    rows = [("m", d, len(v), i / 50, float(np.sort(v)[max(1, -(-len(v) * i // 50)) - 1])) for d, v in days.items() for i in range(51)]
    got = percentiles.combine(spark.createDataFrame(rows, "mode string, day string, n long, p double, value double"), "mode").first()
    every = np.sort(np.concatenate(list(days.values())))
    for p in (0.5, 0.9, 0.95, 0.99):
        assert abs(np.searchsorted(every, got[f"p{round(p * 1000)}"]) / len(every) - p) <= 1 / 50 + 0.001


def test_combined_tail_against_exact(spark):
    rng = np.random.default_rng(4)
    times = [(d, float(v)) for d in range(20) for v in rng.lognormal(0, 1 + d / 20, size=1000)]
    t = "timing_id long, run_id string, started_at timestamp, received_at timestamp, timing struct<ttft_sec:double,total_sec:double>"
    df = spark.createDataFrame([(i, "r", pd.Timestamp(2025, 1, 1 + d).to_pydatetime(), None, (None, v)) for i, (d, v) in enumerate(times)], t)
    got = percentiles.combine(percentiles.percentiles(df, spark.createDataFrame([("r", "m")], "run_id string, pruning_mode string")), "pruning_mode", "metric").first()
    every = np.sort([v for _, v in times])
    for p in (0.5, 0.9, 0.95, 0.99):
        assert abs(np.searchsorted(every, got[f"p{round(p * 1000)}"], side="right") / len(every) - p) <= min(1 / percentiles.GRID, (1 - p) / percentiles.TAIL) + percentiles.LAST + 1e-4


def _has_stretch(item, doc):
    """By brute force: every beginning, the edits of every length against any part of the document."""
    for a in range(len(item) - 39):
        row = [0] * (len(doc) + 1)
        for n, w in enumerate(item[a:], 1):
            new = [n]
            for k, x in enumerate(doc):
                new.append(min(row[k] + (w != x), row[k + 1] + 1, new[k] + 1))
            row = new
            if n >= 40 and 6 * min(row) <= n:
                return True
    return False


def _runs(words, runs, head=0):
    out, at = [f"h{i}" for i in range(head)], head
    for n in runs:
        out += words[at : at + n] + ["zz"]
        at += n + 1
    return out[:-1]


@pytest.mark.parametrize("runs", [(4, 5, 5, 5, 5, 5, 5), (4, 4, 4, 19, 4, 4), (19, 4, 4, 4, 3, 1), (5, 5, 5, 5, 5, 5, 4)])
def test_stretch_around_any_tile(runs):
    words = [f"w{i}" for i in range(60)]
    doc = _runs(words, runs, head=3)
    assert _has_stretch(words, doc) == bool(leaks.Items([(1, " ".join(words))]).leaks(" ".join(doc)))


def test_stretches_against_brute_force():
    rng = np.random.default_rng(8)
    seen = []
    for case in range(60):
        words = [f"w{i}" for i in range(55)]
        n, a = int(rng.integers(40, 46)), int(rng.integers(0, 10))
        part = words[a : a + n]
        for at in sorted(rng.choice(n, n // 6 + case % 2, replace=False), reverse=True):
            part[at : at + 1] = [["zz"], [], [part[at], "yy"]][rng.choice(3, p=[0.8, 0.1, 0.1])]
        doc = ["x"] * 30 + part + ["y"] * 30
        seen.append(want := _has_stretch(words, doc) or any(doc[k : k + 20] == words[b : b + 20] for k in range(len(doc)) for b in range(36)))
        assert bool(leaks.Items([(1, " ".join(words))]).leaks(" ".join(doc))) == want
    assert 10 < sum(seen) < 60


def test_stretch_with_the_fewest_seeds():
    words = [f"w{i}" for i in range(60)]
    doc = _runs(words, (4, 5, 4, 5, 4, 5, 4, 4), head=2)
    assert _has_stretch(words, doc) and leaks.Items([(1, " ".join(words))]).leaks(" ".join(doc)) == [1]
    assert leaks.LEAST_SEEDS == min(n - n // 6 - 4 * (n // 6 + 1) for n in range(40, 1000))


def test_sentence_ends_do_not_hang_on_the_partitions(spark):
    rows = [(0, "It was by the mill.")] + [(i, "The mill is old.") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "pred_id long, pred_answer string")
    got = [sorted(tuple(r) for r in pairs.sentence_ends(df.repartition(n, "pred_id")).collect()) for n in (1, 9)]
    assert got[0] == got[1] == [("mill", 1, 9), ("old", 8, 8)]


SCANNED = [(1, None, [("t1", "A low-\ncost gar-\nden of the town.", 1, 101)]), (2, None, [("t1", "The low-cost house and the low-cost garden, a garclen.", 1, 101)]), (3, None, [("t1", "garden " * 40, 1, 101)])]


def _scanned(spark):
    return spark.createDataFrame(SCANNED, "example_no long, doc_name string, text_quotes array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>")


def test_repair_keeps_the_hyphen_of_compounds(spark):
    got = {r["example_no"]: r["text"] for r in scans.repair(_scanned(spark)).collect()}
    assert got[1] == "A low-cost garden of the town."


def test_repair_beyond_the_bound_of_corrections(spark):
    got = {r["example_no"]: r["text"] for r in scans.repair(_scanned(spark), most=0).collect()}
    assert got == {r["example_no"]: r["text"] for r in scans.repair(_scanned(spark)).collect()}
    assert got[1] == "A low-cost garden of the town." and got[2].endswith("a garden.")


def test_codes_are_no_words():
    assert scans.words_in("Be1arilith's") == ["be1arilith"] and scans.words_in("fDi/3Dkb+H/x16vbq") == [] and scans.words_in("(LOW-C0ST)") == ["low", "c0st"]
    assert scans._fixed("fDi/3Dkb+H/x16vbq", {}) == "fDi/3Dkb+H/x16vbq" and scans._fixed("“Low-c0st,", {"c0st": "cost"}) == "“Low-cost,"


def test_titles_in_any_case():
    for line, name in (("Pelidell Guide pratique 1998", "pelidell_guide_pratique_1998_0000059.pdf"), ("ULARITHORN FIELD MANUAL 2015", "Ularithorn-Field-Manual-2015-0000000.PDF")):
        assert scans.is_title(line, scans.document_key(name)) and not scans.is_title(line + " was printed", scans.document_key(name))
    assert not scans.is_title("Pelidell guide", scans.document_key("pelidell_guide_pratique_1998.pdf"))


def test_headers_by_repetition_and_words_over_quotes(spark):
    page = lambda i: [("t1", f"The Old Mill Today\nThe boats were in the gar-\nden of page {i} and the har-", i, i * 100 + 1), ("t2", "bour was open.", i, i * 100 + 2)]
    rows = [(i, "river_guide_0000001.pdf", page(i)) for i in range(1, 4)] + [(9, "another.pdf", [("t1", "The Old Mill Today\nIt was open.", 1, 101)])]
    df = spark.createDataFrame(rows, "example_no long, doc_name string, text_quotes array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>")
    for most in (2_000_000, -1):
        got = {tuple(r) for r in scans.find_noise(df, most=most).collect()}
        assert got == {(i, "t1", k) for i in range(1, 4) for k in ("header", "hyphen", "continues")}
        assert scans.repair(df, most=most).where("example_no = 2").first()["text"] == "The boats were in the garden of page 2 and the harbour was open."


def test_every_misread_word_is_corrected(spark):
    rows = [("modern", 500), ("m0c1ern5", 1), ("moderns", 90), ("zuq1vant", 1), ("lumawick", 4), ("lurnawick", 1), ("eat", 300), ("cat", 100)]
    got = {tuple(r) for r in scans.corrections(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {("m0c1ern5", "moderns"), ("lurnawick", "lumawick")} <= got and not any(w in ("cat", "eat") for w, _ in got)
    assert scans._fixed("Zuq1vant", dict(got)) == "Zuqivant"


@pytest.mark.parametrize("answer", ["Sadly, I could not possibly respond to that.", "There is insufficient data for this.", "Ich möchte dazu lieber nicht antworten.", "Je ne peux hélas rien lire ici.", "Yo prefiero, la verdad, no responder.", "That is outside of all I may do."])
def test_refusals_in_other_words(answer):
    assert not pairs._REFUSED.found(pairs._words(pairs._plain(answer))) and pairs.defect("What was the wage in 2005?", answer, "4")[0] == "refusal"


@pytest.mark.parametrize("answer", ["The mill could not open in 2005.", "No answer was given by the town, it kept 4 mills.", "There was not enough water for the mill.", "Der Ort kann keine Schule bauen."])
def test_no_refusals(answer):
    assert pairs.defect("What was the wage in 2005?", answer, "4")[0] in (None, "language")


@pytest.mark.parametrize("giants", [1000, 5])
def test_splits_keep_to_the_proportions(spark, giants):
    rng = np.random.default_rng(3)
    sizes = [400, 90, 60, *rng.integers(1, 12, 400)]
    rows = [(f"c{c}", "abcd"[c % 4] if c % 7 else "rare") for c, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "component string, label string")
    placed = splits.assign_splits(df, "component", [F.col("label")], giants=giants, shard_rows=700).toPandas()
    assert placed.component.is_unique and len(placed) == len(sizes)
    m = pd.DataFrame(rows, columns=["component", "label"]).merge(placed)
    for p, split in zip(splits.PROPORTIONS, splits.SPLITS):
        assert abs((m.split == split).mean() - p) < 0.01
        for _, g in m.groupby("label"):
            assert abs((g.split == split).mean() - p) < 0.03


def test_proportions_as_far_as_components_allow(spark):
    df = spark.createDataFrame([("a", None)] * 9 + [("b", "x")], "component string, label string")
    got = {r["component"]: r["split"] for r in splits.assign_splits(df, "component", [F.col("label")]).collect()}
    assert got["a"] == "train" and got["b"] != "train"
    assert splits.assign_splits(df.limit(0), "component", []).count() == 0


BIG = 2**60 + 1


def test_null_ids_and_clashing_columns(spark):
    clash = ", ".join(f"{c} string" for c in ("e", "d", "q", "k", "w", "n", "v", "g", "id", "size", "shard", "piece", "start", "stop", "word", "level", "item_id", "_keep", "_fix", "_head", "split", "component", "label", "defect"))
    width = len(clash.split(","))
    extra = ("x",) * width
    words = " ".join(_item(60))
    docs = spark.createDataFrame([(BIG, words, *extra), (None, words, *extra), (BIG, words, *extra)], f"doc_id long, text string, {clash}")
    items = spark.createDataFrame([(7, words, "x"), (None, words, "x")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leaks.find_leaks(docs, items).collect()} == {(BIG, 7)}
    assert sorted((r["doc_id"] or 0) for r in packing.pack_documents(docs, 100).select("doc_id").distinct().collect()) == [0, BIG]
    easy = spark.createDataFrame([(BIG, "The cat sat on the mat. " * 9, *extra), (None, "The cat sat on the mat. " * 9, *extra)], docs.schema)
    assert {tuple(r) for r in reading.clear_cases(easy).collect()} == {(BIG, "easy")}
    assert {(r["piece"], r["start"], r["stop"]) for r in splitting.split_oversized(docs.limit(1), limit=200, overlap=10).where("piece_no = 0").collect()} == {(words[: len(r["piece"])], 0, len(r["piece"])) for r in splitting.split_oversized(docs.limit(1), limit=200, overlap=10).where("piece_no = 0").collect()}
    pairs_ = spark.createDataFrame([(None, None, None, None, *extra), (BIG, "Was it?", "", "4", *extra)], f"pred_id long, question string, pred_answer string, gold_answer string, {clash}")
    assert {tuple(r) for r in pairs.flag_pairs(pairs_).collect()} == {(None, "empty"), (BIG, "empty")}
    examples = spark.createDataFrame([(BIG, "a", "doc.pdf", None, None, [("t", "gar-\nden", 1, None), None], *extra), (None, None, None, None, None, None, *extra), (3, "a", "b.pdf", None, None, [], *extra)], f"example_no long, q_id string, doc_name string, domain string, question_type string, text_quotes array<struct<quote_id:string,text:string,page_id:long,layout_id:long>>, {clash}")
    for most in (10, -1):
        assert {tuple(r) for r in scans.find_noise(examples, most=most).collect()} == {(BIG, "t", "hyphen")}
        assert {(r["example_no"], r["text"]) for r in scans.repair(examples, most=most).collect()} == {(BIG, "garden"), (3, "")}
    assert {tuple(r) for r in splits.same_documents(examples).collect()} == {("b.pdf", "doc.pdf")}
    assert splits.split_examples(examples).select("split").count() == 3
    lines = spark.createDataFrame([(BIG, '{"timing":{"total_sec":1}}', *extra), (None, '{"timing":{"total_sec":1}}', *extra)], f"line_id long, line string, {clash}")
    from quotemill.operators import nested

    assert {tuple(r) for r in nested.child_index(lines).collect()} == {(BIG, 0, "timing", -1, -1, "total_sec")}


def test_repetitive_texts(monkeypatch):
    monkeypatch.setattr(leaks, "SHARED", 500)
    rng = np.random.default_rng(11)
    items = [" ".join(["a"] * 60), " ".join(["a", "b"] * 30), " ".join((["a"] * 6 + ["x"]) * 9), " ".join(_item(60))]
    index = leaks.Items(list(enumerate(items)))
    docs = [["a"] * 400, ["a", "b"] * 100, ["a"] * 19 + ["q"] + ["a"] * 19, (["a"] * 6 + ["y"]) * 40, (["a"] * 4 + ["y"]) * 40, items[3].split()[:30] + ["a"] * 300, list(rng.choice(["a", "b", "x"], 150))]
    got = set(index.search([" ".join(d) for d in docs]))
    want = {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) for w in [item.split()] if _has_stretch(w, doc) or leaks.longest_run(np.array([hash(x) for x in w]), np.array([hash(x) for x in doc])) >= 20}
    assert got == want and (3, 2) in got
