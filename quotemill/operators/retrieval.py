"""Ranking of each example's own candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.encoders import Encoder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tile_scores(tiles: Column, query: Column) -> Column:
    """The cosine between the query's vector and that of each tile of an image; NaN for a zero vector, null for an image without tiles."""
    norm = lambda v: F.sqrt(dot(v, v))

    def scored(w: Column) -> Column:  # the query and its length are bound, so that they are made once
        return F.transform(tiles, lambda v: F.when(norm(v) * w["n"] > 0, dot(v, w["v"]) / (norm(v) * w["n"])).otherwise(float("nan")))

    return F.transform(F.array(F.struct(query.alias("v"), norm(query).alias("n"))), scored)[0]


def top_k(candidates: DataFrame, queries: DataFrame, k: int, key: str = "example", vector: str = "embedding", order: str = "pos", digits: int = 6) -> DataFrame:
    """The k candidates of each query with the largest inner product: an equi-join on the key and a partitioned top-k.

    NaN ranks last, ties go by `order`. Candidates without a vector are no candidates.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    both = candidates.where(F.col(vector).isNotNull()).join(queries.select(key, F.col(vector).alias("_q")), key)
    ranked = both.withColumn("sim", F.round(dot(F.col(vector), F.col("_q")), digits)).drop("_q")
    w = Window.partitionBy(key).orderBy(F.isnan("sim"), F.desc("sim"), order)
    return ranked.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


def best(quotes: Column, vectors: Column, query: Column, k: int, digits: int = 6) -> Column:
    """The k quotes nearest to the query vector, best first, from the row's own lists: no row leaves its partition.

    `vectors` go with `quotes` by place; a quote without a vector is no candidate, NaN ranks last, ties go by place. A
    null or empty list, or a null query, gives an empty list.
    """
    if k < 0:
        raise ValueError("k must not be negative")

    def ranked(w: Column) -> Column:  # the query and the pairs are bound, so that they are made once and not for every quote
        pairs = F.zip_with(quotes, vectors, lambda q, v: F.struct(q.alias("q"), v.alias("v")))
        scored = F.transform(pairs, lambda x, i: F.struct(F.round(dot(x["v"], w), digits).alias("sim"), i.alias("i"), x["q"].alias("q")))
        near = F.filter(scored, lambda x: x["sim"].isNotNull())
        return F.array_sort(F.transform(near, lambda x: F.struct(F.isnan(x["sim"]).alias("nan"), (-x["sim"]).alias("far"), x["i"].alias("i"), x["q"].alias("q"))))

    first = F.slice(F.coalesce(F.transform(F.array(query), ranked)[0], F.array()), 1, k)
    return F.transform(first, lambda x: x["q"])


def retrieve(examples: DataFrame, text_encoder: Encoder, image_query_encoder: Encoder, image_encoder: Encoder, text_k: int = 4, image_k: int = 2, question: str = "question", texts: str = "text_quotes", images: str = "img_quotes", image_key: str = "local_img_path") -> DataFrame:
    """The examples with `selected_text_quotes` and `selected_img_quotes`, ranked independently.

    A missing text is an empty one and stays a candidate; an image the encoder has no vector for (missing, unreadable)
    is none, so fewer than `image_k` may come out. Encoders are evaluated once per row.
    """
    ask = F.array(F.col(question))
    vectors = examples.withColumns({
        "_t": text_encoder(F.transform(texts, lambda q: F.coalesce(q["text"], F.lit("")))), "_i": image_encoder(F.transform(images, lambda q: q[image_key])),
        "_qt": text_encoder(ask), "_qi": image_query_encoder(ask),
    })
    chosen = vectors.withColumns({"selected_text_quotes": best(F.col(texts), F.col("_t"), F.col("_qt")[0], text_k), "selected_img_quotes": best(F.col(images), F.col("_i"), F.col("_qi")[0], image_k)})
    return chosen.drop("_t", "_i", "_qt", "_qi")
