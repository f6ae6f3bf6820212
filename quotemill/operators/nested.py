"""Deeply nested prediction records as related flat tables.

A bottom-up tree automaton gives every JSON node a state: leaves by kind, objects by the keys they have and the states
below them. The state of an object decides the typed table its row goes to (`TABLES`); a shape no rule knows goes to the
table `other` of its kind with all it has. The keys all variants share (`LINKS`), which lead back to the record and the
image, stand in every table, and the rows are written once, a folder per table. Parts that were encoded again as text
are decoded where a container is expected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import stored

CHILD_SCHEMA = "line_id long, row_pos long, child string, pos long, sub_pos long, name string, variant string, value string, number double"


class TreeAutomaton:
    """States of JSON nodes, bottom-up. A rule (state, needed, forbidden) takes an object; the first that fits counts.

    What a rule needs is a key, or `key:state` for one whose node's state begins so.
    """

    def __init__(self, rules: list[tuple[str, frozenset[str], frozenset[str]]], default: str = "other") -> None:
        self.rules, self.default = rules, default
        self.seen: dict[frozenset[tuple[str, str]], str] = {}  # one transition per set of keys and states below, worked out once

    def leaf(self, node: object) -> str:
        if node is None:
            return "null"
        return "bool" if isinstance(node, bool) else "number" if isinstance(node, (int, float)) else "text"

    def _fits(self, below: dict[str, str], need: frozenset[str], no: frozenset[str]) -> bool:
        return not no & below.keys() and all(below.get(k, "null").startswith(s) if s else k in below for k, _, s in (x.partition(":") for x in need))

    def state(self, node: object, depth: int = 50) -> str:
        node = decoded(node)
        if isinstance(node, (dict, list)) and not depth:
            return "deep"
        if isinstance(node, dict):
            below = {k: self.state(v, depth - 1) for k, v in node.items() if v is not None}  # a null field is an absent one
            key = frozenset(below.items())
            if key not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[key] = next((s for s, need, no in self.rules if self._fits(below, need, no)), self.default)
            return self.seen[key]
        if isinstance(node, list):
            return "list<" + "|".join(sorted({self.state(x, depth - 1) for x in node})) + ">"
        return self.leaf(node)


def _rule(state: str, need: str, no: str = "") -> tuple[str, frozenset[str], frozenset[str]]:
    return state, frozenset(need.split()), frozenset(no.split())


PREDICTIONS = TreeAutomaton([
    _rule("result", "rows"),
    _rule("pruning_rendered", "keep_indices:list rendered_image_path"), _rule("pruning_hooked", "keep_indices:list hook_required"), _rule("pruning_kept", "keep_indices:list"),
    _rule("pruning_skipped", "skipped"), _rule("pruning_bare", "mode tokens_before"),
    _rule("image_pruned", "quote_id visual_pruning:pruning layout_id"), _rule("pruning_entry", "quote_id visual_pruning:pruning"), _rule("image_plain", "quote_id", "visual_pruning"),
    _rule("record_measured", "q_id timing:timing metrics:metrics"), _rule("record", "q_id"), _rule("timing", "total_sec"), _rule("metrics", "em"),
])


def _load(text: str) -> object:
    """Parsed JSON; a number of thousands of digits is read as a float. Raises ValueError for what is none, or is nested too deeply."""
    try:
        return json.loads(text, parse_int=lambda s: int(s) if len(s) < 4000 else float(s))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def decoded(node: object) -> object:
    """A text that holds a JSON container, decoded; anything else as it is."""
    while isinstance(node, str) and node.lstrip()[:1] in ("{", "[", '"'):
        try:
            node = _load(node)
        except ValueError:
            break
    return node


def _several(node: object) -> list:
    node = decoded(node)
    return node if isinstance(node, list) else [node] if isinstance(node, dict) else []


def _dumped(x: object) -> str:
    try:
        return json.dumps(x, ensure_ascii=True)
    except RecursionError:
        return '"nested too deeply"'


def _text(x: object) -> str | None:
    """A text as it is, with what can't be encoded (half a surrogate pair) replaced; other values as JSON."""
    if x is None:
        return None
    if not isinstance(x, str):
        return _dumped(x)
    return x if x.isascii() else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _float(x: object) -> float | None:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")
    except (TypeError, ValueError):
        return None


def _long(x: object) -> int | None:
    """A number, also as a text, without its fraction; None for what is none or has no place in 64 bits."""
    if isinstance(x, int):
        n = int(x)
    else:
        f = _float(x) if not isinstance(x, (list, dict)) else None
        n = int(f) if f is not None and abs(f) < 2**63 else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def _bool(x: object) -> bool | None:
    return x if isinstance(x, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(x).strip().lower()) if isinstance(x, (str, int)) else None


def _listed(read: Callable[[object], object]) -> Callable[[object], list | None]:
    def several(x: object) -> list | None:
        x = decoded(x)
        return [read(y) for y in x] if isinstance(x, list) else None

    return several


def _object(x: object) -> object:
    x = decoded(x)
    return x if isinstance(x, dict) else None


#: The fields of each kind of node: how each is read, and its type.
_STATS = "struct<mode:string,text_before:long,text_after:long,images_before:long,images_after:long,visual_tokens_before:long,visual_tokens_after:long>"
FIELDS = {
    "pruning": {
        "mode": (_text, "string"), "skipped": (_bool, "boolean"), "reason": (_text, "string"), "tokens_before": (_long, "long"), "tokens_after": (_long, "long"), "grid_rows": (_long, "long"), "grid_cols": (_long, "long"),
        "keep_indices": (_listed(_long), "array<long>"), "keep_boxes": (_listed(_listed(_long)), "array<array<long>>"), "scores": (_listed(_float), "array<double>"),
        "rendered_image_path": (_text, "string"), "hook_required": (_bool, "boolean"), "hook_point": (_text, "string"),
    },
    "image": {"img_path": (_text, "string"), "local_img_path": (_text, "string"), "img_description": (_text, "string"), "page_id": (_long, "long"), "layout_id": (_long, "long")},
    "record": {
        "q_id": (_text, "string"), "question": (_text, "string"), "gold_answer": (_text, "string"), "pred_answer": (_text, "string"), "gold_quotes": (_listed(_text), "array<string>"),
        "retrieved_quote_ids": (_listed(_text), "array<string>"), "pruning": (_object, _STATS),
    },
    "tile": {"keep_index": (_long, "long"), "score": (_float, "double"), "box": (_listed(_long), "array<long>")},
}
#: The parts of a node that have rows of their own, or are named in the links.
_APART = {"record": {"selected_img_quotes", "visual_pruning", "timing", "metrics", "rows"}, "image": {"visual_pruning", "quote_id"}, "pruning": set(), "tile": set()}

_FULL = ("mode", "tokens_before", "tokens_after", "grid_rows", "grid_cols", "keep_indices", "keep_boxes", "scores")
#: The typed columns of the table of each kind and variant, besides the links; `other` has all of its kind.
TABLES: dict[tuple[str, str], tuple[str, ...]] = {
    ("record", "record_measured"): tuple(FIELDS["record"]), ("record", "record"): tuple(FIELDS["record"]), ("record", "other"): tuple(FIELDS["record"]),
    ("image", "image_pruned"): tuple(FIELDS["image"]), ("image", "image_plain"): tuple(FIELDS["image"]), ("image", "other"): tuple(FIELDS["image"]),
    ("pruning", "pruning_rendered"): (*_FULL, "rendered_image_path"), ("pruning", "pruning_hooked"): (*_FULL, "hook_required", "hook_point"), ("pruning", "pruning_kept"): _FULL,
    ("pruning", "pruning_skipped"): ("mode", "skipped", "reason", "tokens_before", "tokens_after"), ("pruning", "pruning_bare"): ("mode", "tokens_before", "tokens_after"), ("pruning", "other"): tuple(FIELDS["pruning"]),
    ("tile", "pruning_rendered"): ("keep_index", "score", "box"), ("tile", "pruning_hooked"): ("keep_index", "score", "box"), ("tile", "pruning_kept"): ("keep_index", "score", "box"), ("tile", "other"): ("keep_index", "score", "box"),
    ("timing", "timing"): ("value", "number"), ("timing", "other"): ("value", "number"), ("metric", "metrics"): ("value", "number"), ("metric", "other"): ("value", "number"),
}
LINKS = ("line_id", "row_pos", "pos", "sub_pos", "name")


def _row(kind: str, row_pos: int, pos: int, sub: int, name: str | None, node: dict, variant: str) -> tuple:
    """The row of an object: its fields as read, and those of other names in `rest`, as JSON."""
    fields = {k: read(node.get(k)) for k, (read, _) in FIELDS[kind].items()}
    rest = {k: v for k, v in node.items() if k not in FIELDS[kind] and k not in _APART[kind] and v is not None}
    fields["rest"] = _dumped(rest) if rest else None
    return row_pos, kind, pos, sub, name, variant if (kind, variant) in TABLES else "other", _dumped(fields), None


def children(line: str | None, automaton: TreeAutomaton = PREDICTIONS) -> Iterator[tuple]:
    """The rows of a line, in the order of CHILD_SCHEMA without line_id. What is no JSON object has none."""
    try:
        top = _load(line) if line else None
    except ValueError:
        return
    if not isinstance(top, dict):
        return
    rows = decoded(top["rows"]) if "rows" in top else None
    for row_pos, record in enumerate(rows if isinstance(rows, list) else [rows] if isinstance(rows, dict) else [top]):
        record = decoded(record)
        if not isinstance(record, dict):
            continue
        yield _row("record", row_pos, -1, -1, _text(record.get("q_id")), record, automaton.state(record))
        parts = [(sub, _text(e.get("quote_id")), decoded(e.get("visual_pruning"))) for sub, e in enumerate(map(decoded, _several(record.get("visual_pruning")))) if isinstance(e, dict)]
        entries = {name: (sub, part) for sub, name, part in reversed(parts)}
        taken, places = set(), {}
        for pos, image in enumerate(map(decoded, _several(record.get("selected_img_quotes")))):
            if not isinstance(image, dict):
                continue
            name = _text(image.get("quote_id"))
            places.setdefault(name, pos)
            yield _row("image", row_pos, pos, -1, name, image, automaton.state(image))
            pruning = decoded(image.get("visual_pruning"))
            entry = -1
            if pruning is None and name in entries:
                entry, pruning = entries[name]
            if not isinstance(pruning, dict):
                continue
            taken.add(entry)
            state = automaton.state(pruning)
            yield _row("pruning", row_pos, pos, entry, name, pruning, state)
            kept, scores, boxes = (decoded(pruning.get(k)) for k in ("keep_indices", "scores", "keep_boxes"))
            for sub, index in enumerate(kept if isinstance(kept, list) else []):
                tile = {"keep_index": index, "score": scores[sub] if isinstance(scores, list) and sub < len(scores) else None, "box": boxes[sub] if isinstance(boxes, list) and sub < len(boxes) else None}
                yield _row("tile", row_pos, pos, sub, name, tile, state)
        for entry, name, pruning in parts:  # those no image takes up
            if entry not in taken and isinstance(pruning, dict):
                yield _row("pruning", row_pos, places.get(name, -1), entry, name, pruning, automaton.state(pruning))
        for child, field in (("timing", "timing"), ("metric", "metrics")):
            part = decoded(record.get(field))
            if isinstance(part, dict):
                state = automaton.state(part)
                for name, value in part.items():
                    if value is not None:
                        yield row_pos, child, -1, -1, _text(name), state if (child, state) in TABLES else "other", _text(value), _float(value)


_COLUMNS = [c.split()[0] for c in CHILD_SCHEMA.split(", ")]


def flatten_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """Every node of every line that has a row, with its variant and the way back (`line_id`, `row_pos`, `pos`); its fields are JSON in `value`.

    Null, broken and foreign lines have no rows, nor have those without an id. Repeated lines have their own `line_id` and come out each.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                yield pd.DataFrame([(i, *c) for i, line in zip(part["i"], part["l"]) for c in children(line)], columns=_COLUMNS)

    return lines.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(line_col).alias("l")).mapInPandas(explode, CHILD_SCHEMA)


def tables(nodes: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """The typed table of every kind and variant: the links, its own columns and, in `rest`, what a node has besides, as JSON.

    `pos` is the image's place, -1 where the record has no such image; `sub_pos` of a pruning is its place in the
    record's `visual_pruning`, -1 where the image has it itself. The nodes are written once; a table reads its own only.
    """
    kept = stored(nodes, "child", "variant")
    out = {}
    for (kind, variant), cols in TABLES.items():
        own = kept.where((F.col("child") == kind) & (F.col("variant") == variant))
        if kind not in FIELDS:
            out[kind, variant] = own.select(*LINKS, *cols)
            continue
        read = own.withColumn("f", F.from_json("value", ", ".join(f"{k} {t}" for k, (_, t) in FIELDS[kind].items()) + ", rest string"))
        besides = F.to_json(F.struct(*[F.col(f"f.{c}").alias(c) for c in (*FIELDS[kind], "rest") if c not in cols]))
        out[kind, variant] = read.select(*LINKS, *[F.col(f"f.{c}").alias(c) for c in cols], F.nullif(besides, F.lit("{}")).alias("rest"))
    return out


def supertype(typed: dict[tuple[str, str], DataFrame], *kinds: str) -> DataFrame:
    """What the tables of some kinds have in common: (the links, `child`, `variant`)."""
    out = None
    for (kind, variant), df in typed.items():
        if kind in kinds:
            df = df.select(*LINKS, F.lit(kind).alias("child"), F.lit(variant).alias("variant"))
            out = df if out is None else out.unionByName(df)
    return out


def subtype(typed: dict[tuple[str, str], DataFrame], kind: str) -> DataFrame:
    """The tables of all variants of one kind, one below the other, with a column for each field any of them has."""
    out = None
    for (k, variant), df in typed.items():
        if k == kind:
            df = df.withColumn("variant", F.lit(variant))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    cols = [*FIELDS[kind], "rest"] if kind in FIELDS else ["value", "number"]
    return out.select(*LINKS, "variant", *cols)


def prediction_nodes(predictions: DataFrame) -> DataFrame:
    """The nodes of typed predictions, as `flatten_lines` has them; `line_id` is the `pred_id`."""
    return flatten_lines(predictions.select("pred_id", F.to_json(F.struct("q_id", "question", "gold_answer", "pred_answer", "gold_quotes", "retrieved_quote_ids", "selected_img_quotes", "pruning", "visual_pruning", "timing", "metrics")).alias("line")), "pred_id")


def child_index(lines: DataFrame) -> DataFrame:
    """(`line_id`, `row_pos`, `child`, `pos`, `sub_pos`, `name`): the images, tiles, timings and metrics, from their typed tables."""
    return supertype(tables(flatten_lines(lines)), "image", "tile", "timing", "metric").select("line_id", "row_pos", "child", "pos", "sub_pos", "name")


def flatten_predictions(predictions: DataFrame) -> DataFrame:
    """The same child records of typed predictions: (`pred_id`, `child`, `pos`, `sub_pos`, `name`), in the JVM throughout."""
    images = predictions.select("pred_id", "visual_pruning", F.posexplode("selected_img_quotes").alias("pos", "q"))
    image = images.select("pred_id", F.lit("image").alias("child"), F.col("pos").cast("long").alias("pos"), F.lit(-1).cast("long").alias("sub_pos"), F.col("q.quote_id").alias("name"))
    entry = F.filter("visual_pruning", lambda e: e.quote_id == F.col("q.quote_id"))
    kept = F.when(F.col("q.visual_pruning").isNotNull(), F.col("q.visual_pruning.keep_indices")).otherwise(F.try_element_at(entry, F.lit(1)).visual_pruning.keep_indices)
    tile = images.select("pred_id", "pos", "q.quote_id", F.posexplode(kept).alias("sub_pos", "k")).select(
        "pred_id", F.lit("tile").alias("child"), F.col("pos").cast("long").alias("pos"), F.col("sub_pos").cast("long").alias("sub_pos"), F.col("quote_id").alias("name")
    )
    parts = [image, tile]
    for child, field in (("timing", "timing"), ("metric", "metrics")):
        names = predictions.schema[field].dataType.names
        given = F.filter(F.array(*[F.when(F.col(f"{field}.{n}").isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())
        parts.append(predictions.select("pred_id", F.lit(child).alias("child"), F.lit(-1).cast("long").alias("pos"), F.lit(-1).cast("long").alias("sub_pos"), F.explode(given).alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
