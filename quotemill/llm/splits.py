"""Train, validation and test splits that keep related records together.

find components -> aggregate label vectors -> grouped iterative stratification.

Components come from alternating large-star / small-star contraction over edges between document keys, as
DataFrame joins and aggregates: no link or component list reaches the driver. Only keys that share a `q_id`
with another key make edges, so the edge table is a small part of the rows; a key or `q_id` that holds a
third of all rows is one row after the first (partially aggregated) distinct.

The stratification places components that hold at least 1/`giants` of the rows first, in one task (there are
at most `giants` of them, whatever the size of the data); all others are placed by hash shard, each shard
serving its share of what the giants left outstanding. Each placement is followed by moves that bring the
shares of the labels nearer to the proportions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.session import cut

SPLITS = ("train", "validation", "test")
PROPORTIONS = (0.8, 0.1, 0.1)

_FOLDER = re.compile(r"^.*[/\\]", re.S)
_EXTENSION = re.compile(r"\.(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{1,5}\s*$")


def document_key(name: str | None) -> str | None:
    """The letters and digits of a document name, without folder, extension, case and Unicode form.

    None stays None. Names without any letter or digit all have the empty key.
    """
    if name is None:
        return None
    stem = _EXTENSION.sub("", _FOLDER.sub("", name.strip()))
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", stem).casefold())
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


@F.pandas_udf(T.StringType())
def _document_keys(names: pd.Series) -> pd.Series:
    return names.map(document_key, na_action="ignore")


def with_document_key(df: DataFrame, name: str = "doc_name", into: str = "doc_key") -> DataFrame:
    """Adds the key of each row's name; Python sees every distinct name once, not every row."""
    names = df.select(F.col(name).alias("_n")).where("_n is not null").distinct().withColumn(into, _document_keys("_n"))
    return df.join(names, df[name] == names["_n"], "left").drop("_n")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(`node`, `component`) for every node of the edges (`u`, `v`); a component is named by its smallest node.

    Self-loops and repeated edges do no harm, null ends are ignored, an empty table gives an empty one. A hub is
    aggregated map-side before its minimum is joined back, and that join is left to the adaptive skew join.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(now)
    sign = None
    for _ in range(max_rounds):
        around = _both_ways(now)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == sign:
            break
        sign = row
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def document_components(examples: DataFrame, name: str = "doc_name", link: str = "q_id") -> DataFrame:
    """(`doc_name`, `doc_key`, `component`), one row per distinct name: names of one key or joined through shared links.

    Null names have no row, null links join nothing.
    """
    pairs = with_document_key(examples.select(F.col(name).alias("doc_name"), F.col(link).alias("link")).distinct())
    pairs = cut(pairs.where("doc_key is not null"))
    by_link = pairs.where("link is not null").select("link", "doc_key").distinct()
    first = by_link.groupBy("link").agg(F.min("doc_key").alias("v"), F.count("*").alias("n")).where("n > 1")
    edges = by_link.join(first, "link").select(F.col("doc_key").alias("u"), "v").where("u <> v").distinct()
    parts = connected_components(edges)
    names = pairs.select("doc_name", "doc_key").distinct()
    return names.join(parts, names["doc_key"] == parts["node"], "left").select("doc_name", "doc_key", F.coalesce("component", "doc_key").alias("component"))


def same_documents(examples: DataFrame, name: str = "doc_name", link: str = "q_id") -> DataFrame:
    """(`doc_a`, `doc_b`): for each group of names that belong together, every name but the smallest beside the smallest."""
    parts = document_components(examples, name, link)
    least = parts.groupBy("component").agg(F.min("doc_name").alias("doc_a"))
    return parts.join(least, "component").where("doc_name <> doc_a").select("doc_a", F.col("doc_name").alias("doc_b"))


def _stratify(members: list[tuple[str, dict[str, int]]], wanted: list[dict[str, float]]) -> list[int]:
    """The split of each component: rarest outstanding label first, its largest components first, each to the split that needs the label most."""
    left: dict[str, set[int]] = {}
    outstanding: dict[str, int] = {}
    for i, (_, labels) in enumerate(members):
        for label, n in labels.items():
            left.setdefault(label, set()).add(i)
            outstanding[label] = outstanding.get(label, 0) + n
    place = [-1] * len(members)
    total = [sum(w.values()) for w in wanted]
    while outstanding:
        label = min(outstanding, key=lambda x: (outstanding[x], x))
        for i in sorted(left[label], key=lambda k: (-members[k][1][label], members[k][0])):
            s = max(range(len(wanted)), key=lambda k: (wanted[k].get(label, 0.0), total[k], -k))
            place[i] = s
            for other, n in members[i][1].items():
                wanted[s][other] = wanted[s].get(other, 0.0) - n
                total[s] -= n
                outstanding[other] -= n
                if other != label:
                    left[other].discard(i)
        del outstanding[label], left[label]
        for gone in [x for x, rest in left.items() if not rest]:
            del outstanding[gone], left[gone]
    return place


def _evened(members: list[tuple[str, dict[str, int]]], place: list[int], wanted: list[dict[str, float]], proportions: Sequence[float], rounds: int = 20) -> list[int]:
    """The places after moves that bring the labels' shares, and the sizes, nearer to their proportions; small components last, until a round moves none.

    `wanted` is what the placement left outstanding. What others will place later counts as if it were dealt out in proportion.
    """
    left = {label: sum(w.get(label, 0.0) for w in wanted) for label in {x for w in wanted for x in w}}
    off = [{label: w.get(label, 0.0) - p * n for label, n in left.items()} for w, p in zip(wanted, proportions)]
    total = [sum(o.values()) for o in off]
    weight: dict[str, float] = {}
    for _, labels in members:
        for label, n in labels.items():
            weight[label] = weight.get(label, 0.0) + n
    scale = max(1.0, sum(weight.values()))
    order = sorted(range(len(members)), key=lambda i: (-sum(members[i][1].values()), members[i][0]))
    for _ in range(rounds):
        moved = False
        for i in order:
            labels, s = members[i][1], place[i]
            size = sum(labels.values())

            def gain(t: int, labels: dict[str, int] = labels, s: int = s, size: int = size) -> float:
                own = sum(n * (off[s].get(x, 0.0) - off[t].get(x, 0.0) + n) / weight[x] for x, n in labels.items())
                return own + 4 * size * (total[s] - total[t] + size) / scale

            t = min((k for k in range(len(off)) if k != s), key=lambda k: (gain(k), k))
            if gain(t) < -1e-9:
                for x, n in labels.items():
                    off[s][x] = off[s].get(x, 0.0) + n
                    off[t][x] = off[t].get(x, 0.0) - n
                total[s] += size
                total[t] -= size
                place[i], moved = t, True
        if not moved:
            break
    return place


def _stratified(pdf: pd.DataFrame, wanted: list[dict[str, float]], proportions: Sequence[float]) -> pd.DataFrame:
    members = [(c, dict(zip(g["label"], g["n"].astype(int)))) for c, g in pdf.groupby("component", sort=True)]
    place = _evened(members, _stratify(members, wanted), wanted, proportions)
    out = [(c, SPLITS[s], label, n) for (c, labels), s in zip(members, place) for label, n in labels.items()]
    return pd.DataFrame(out, columns=["component", "split", "label", "n"])


def assign_splits(records: DataFrame, component: str, labels: Sequence[Column], proportions: Sequence[float] = PROPORTIONS, giants: int = 1000, shard_rows: int = 200_000) -> DataFrame:
    """(`component`, `split`): grouped iterative stratification of the records by the given label columns.

    Null labels count as a label of their own. A component is never divided, so a split misses its share by
    what the largest components force. An empty table gives an empty result.
    """
    tagged = [F.concat(F.lit(f"{i}="), F.coalesce(c.cast("string"), F.lit("\0"))) for i, c in enumerate(labels)] or [F.lit("all")]
    vectors = records.select(F.col(component).alias("component"), F.explode(F.array(*tagged)).alias("label")).groupBy("component", "label").agg(F.count("*").alias("n"))
    vectors = cut(vectors)
    width = len(tagged)
    sized = vectors.withColumn("size", F.sum("n").over(Window.partitionBy("component")) / width)
    rows = (vectors.agg(F.sum("n")).first()[0] or 0) / width
    totals = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row per label value, not per record
    wanted = [{label: n * p for label, n in totals.items()} for p in proportions]
    big = sized.where(F.col("size") * giants >= rows).select("component", "label", "n")
    schema = "component string, split string, label string, n long"
    first = cut(big.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: _stratified(pdf, [dict(w) for w in wanted], proportions), schema))
    for r in first.groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
        wanted[SPLITS.index(r["split"])][r["label"]] -= r["n"]
    shards = max(1, int(rows // shard_rows))
    share = [{label: n / shards for label, n in w.items()} for w in wanted]
    rest = sized.where(F.col("size") * giants < rows).withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)))
    rest = rest.groupBy("shard").applyInPandas(lambda pdf: _stratified(pdf[["component", "label", "n"]], [dict(w) for w in share], proportions), schema)
    return first.unionByName(rest).select("component", "split").distinct()


def split_shares(examples: DataFrame, placed: DataFrame, label: str) -> DataFrame:
    """(`label`, `split`, `n`, `share`): how the rows of each label value are shared out."""
    n = placed.join(examples.select("example_no", F.col(label).alias("label")), "example_no").groupBy("label", "split").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def split_examples(examples: DataFrame, proportions: Sequence[float] = PROPORTIONS) -> DataFrame:
    """(`example_no`, `component`, `split`) for every row of the examples.

    Rows of one `doc_name`, in whatever spelling, and rows of one `q_id` share a split. A row without a name goes
    with its `q_id`; a row with neither stands alone; those that have no
    `example_no` either stand together.
    """
    parts = document_components(examples)
    spelled = parts.select(F.col("doc_name").alias("_name"), "component")
    placed = examples.select("example_no", "q_id", "doc_name", "domain", "question_type").join(spelled, F.col("doc_name") == F.col("_name"), "left").drop("_name")
    through = placed.where("component is not null and q_id is not null").groupBy("q_id").agg(F.min("component").alias("_by_q"))
    alone = placed.where("component is null").drop("component").join(through, "q_id", "left").withColumn("component", F.coalesce("_by_q", F.concat(F.lit("q:"), "q_id"), F.concat(F.lit("row:"), F.coalesce(F.col("example_no").cast("string"), F.lit(""))))).drop("_by_q")
    placed = placed.where("component is not null").unionByName(alone)
    splits = assign_splits(placed, "component", [F.col("domain"), F.col("question_type")], proportions)
    return placed.select("example_no", "component").join(splits, "component").select("example_no", "component", "split")
