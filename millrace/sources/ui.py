"""Screen captures: pairing of trees and pictures, tree files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.jsonl import InputError

#: File names, picture heads, and the names that each node field goes by, first present wins.
TREE_NAME, IMAGE_NAME = r"^uitree_(\d+)\.(?i:jsonl)$", r"^image_(\d+)\.(?i:png|jpg|jpeg)$"
PNG, JPEG = "89504E470D0A1A0A", "FFD8FF"
ALIASES = {
    "node_id": ("id", "node_id"),
    "parent_id": ("parent", "parent_id"),
    "role": ("class", "className", "type", "role"),
    "text": ("text", "label"),
    "content_desc": ("content_desc", "contentDescription", "desc"),
    "bounds": ("bounds",),
    "visible": ("visible", "visible_to_user"),
}
NODE = (
    T.StructType().add("node_id", T.StringType()).add("parent_id", T.StringType()).add("depth", T.IntegerType()).add("role", T.StringType())
    .add("text", T.StringType()).add("content_desc", T.StringType()).add("bounds", T.ArrayType(T.IntegerType())).add("visible", T.BooleanType())
    .add("extra", T.MapType(T.StringType(), T.StringType()))
)
_BOUNDS = re.compile(r"\s*\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]\s*\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]\s*")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def index_of(name: Column, pattern: str) -> Column:
    """The number in a file name; leading zeros don't count, null where the name doesn't fit."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).cast("decimal(38,0)").cast("long"))


def pair(trees: DataFrame, images: DataFrame, index: str = "idx", path: str = "path") -> DataFrame:
    """(index, tree, image, state): pair, missing_image, missing_tree, or conflict where a side has several."""
    sides = [df.groupBy(index).agg(F.count("*").alias(f"_n{s}"), F.min(path).alias(s)) for df, s in ((trees, "tree"), (images, "image"))]
    both = sides[0].join(sides[1], index, "full_outer")
    state = F.when((F.col("_ntree") > 1) | (F.col("_nimage") > 1), "conflict").when(F.col("_nimage").isNull(), "missing_image").when(F.col("_ntree").isNull(), "missing_tree").otherwise("pair")
    return both.select(index, "tree", "image", state.alias("state"))


def required_pairs(pairs: DataFrame, on_missing: str = "skip", on_conflict: str = "fail") -> DataFrame:
    """The sound pairs; a missing side or a conflict ends the run where the policy is to fail."""
    for state, policy in (("conflict", on_conflict), ("missing_%", on_missing)):
        if policy == "fail" and (first := pairs.where(F.col("state").like(state)).orderBy("idx").first()):
            raise InputError(f"index {first['idx']}: {first['state']} ({first['tree'] or first['image']})")
    return pairs.where("state = 'pair'")


def image_problem(content: Column, length: Column, max_mb: float) -> Column:
    """image_too_large or image_decode_error by size and first bytes; null for a sound picture."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(length > int(max_mb * 1024 * 1024), "image_too_large").when(~(head.startswith(PNG) | head.startswith(JPEG)), "image_decode_error")


def _node(obj: dict, default_id: str, parent: str | None, structural: tuple[str, ...]) -> dict:
    used, got = set(structural), {}
    for field, names in ALIASES.items():
        key = next((n for n in names if n in obj), None)
        used.add(key)
        got[field] = (key is not None, obj.get(key) if key else None)
    text = lambda f, missing: str(got[f][1]) if got[f][1] is not None else missing
    box = got["bounds"][1]
    if isinstance(box, str) and (m := _BOUNDS.fullmatch(box)):
        box = [int(x) for x in m.groups()]
    sound = isinstance(box, list) and len(box) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in box)
    seen = got["visible"][1]
    hidden = seen.strip().lower() in ("false", "0", "no", "") if isinstance(seen, str) else seen is not None and not seen
    spell = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return {
        "node_id": text("node_id", default_id),
        "parent_id": (text("parent_id", None) if got["parent_id"][0] else parent),
        "depth": 0,
        "role": text("role", "unknown"),
        "text": text("text", ""),
        "content_desc": text("content_desc", ""),
        "bounds": [int(x) for x in box] if sound else [0, 0, 0, 0],
        "visible": not hidden,
        "extra": {k: spell(v) for k, v in obj.items() if k not in used},
    }


def parse_tree(data: str) -> list[dict] | None:
    """Nodes of a tree file in depth-first order; None where no line is an object.

    A first line with a list of children makes the file nested; otherwise each line is a node that names its
    parent. Nodes whose parents form a ring become roots. Walks are by stack, so that depth is no limit.
    """
    rows = []
    for no, line in enumerate(data.splitlines(), 1):
        try:
            obj = json.loads(line) if line.strip() else None
        except ValueError:
            obj = None
        if isinstance(obj, dict):
            rows.append((no, obj))
    first = next((line for line in data.splitlines() if line.strip()), "")
    out: list[dict] = []
    if rows and json_children(first):
        stack = [(obj, None, 0) for _, obj in reversed(rows)]
        while stack:
            obj, parent, depth = stack.pop()
            node = _node(obj, str(len(out) + 1), parent, ("children",)) | {"depth": depth}
            out.append(node)
            below = obj.get("children")
            stack += [(c, node["node_id"], depth + 1) for c in reversed(below if isinstance(below, list) else []) if isinstance(c, dict)]
        return out
    return _in_depth_order([_node(obj, str(no), None, ()) for no, obj in rows]) or None


def _in_depth_order(nodes: list[dict]) -> list[dict]:
    """Nodes that name their parents, each before what is below it and after what is below its earlier siblings.

    A node's place is that of its parent, and one, and the sizes of its earlier siblings with all below them. Of nodes
    with one id the first is the parent. Where the way up ends in a ring, a node is a root if it comes before all above it
    in the file; such roots come last.
    """
    named = {n["node_id"]: k for k, n in reversed(list(enumerate(nodes)))}
    above = [named.get(n["parent_id"], -1) if n["parent_id"] is not None else -1 for n in nodes]
    level = [k for k in range(len(nodes)) if above[k] < 0]
    met = [-1] * len(nodes)  # the walk in which a node was met last
    least: dict[int, int] = {}  # the first in the file of those above a node whose way up ends in a ring
    for start in range(len(nodes)):
        way, at = [], start
        while at >= 0 and met[at] < 0:
            met[at] = start
            way.append(at)
            at = above[at]
        if at >= 0 and met[at] == start:  # a new ring
            ring = way[way.index(at) :]
            least |= dict.fromkeys(ring, min(ring))
        for k in reversed(way):
            if k not in least and above[k] in least:
                least[k] = min(above[k], least[above[k]])
    cut = [k for k, first in sorted(least.items()) if k <= first]
    for k in cut:
        above[k] = -1
    level += cut
    below: list[list[int]] = [[] for _ in nodes]
    for k, parent in enumerate(above):
        if parent >= 0:
            below[parent].append(k)
    by_depth, depth = [], 0
    while level:
        by_depth += [(k, depth) for k in level]
        level, depth = [c for k in level for c in below[k]], depth + 1
    size = [1] * len(nodes)
    for k, _ in reversed(by_depth):
        if above[k] >= 0:
            size[above[k]] += size[k]
    taken = [1] * len(nodes)  # places from a node on that it and its placed children have
    out: list[dict] = [{}] * len(nodes)
    place, free = [0] * len(nodes), 0
    for k, depth in by_depth:
        if above[k] < 0:
            place[k], free = free, free + size[k]
        else:
            place[k] = place[above[k]] + taken[above[k]]
            taken[above[k]] += size[k]
        out[place[k]] = nodes[k] | {"depth": depth}
    return out


def json_children(line: str) -> bool:
    try:
        obj = json.loads(line)
    except ValueError:
        return False
    return isinstance(obj, dict) and isinstance(obj.get("children"), list)


@F.pandas_udf(T.ArrayType(NODE))
def tree_nodes(files: pd.Series) -> pd.Series:
    """Column form of parse_tree; null for files without a node or that are no UTF-8."""
    def one(data) -> list[dict] | None:
        try:
            return parse_tree(data.decode() if isinstance(data, (bytes, bytearray)) else data) if data is not None else None
        except UnicodeDecodeError:
            return None
    return files.map(one)


def ui_records(spark: SparkSession, path: str, max_mb: float = 20) -> DataFrame:
    """(idx, id, nodes, image, state) of every index below a folder; only rows of state `pair` are records."""
    files = list_files(spark, path)
    trees = files.withColumn("idx", index_of(F.col("name"), TREE_NAME)).where("idx is not null")
    images = files.withColumn("idx", index_of(F.col("name"), IMAGE_NAME)).where("idx is not null")
    pairs = pair(trees, images)
    full = pairs.join(trees.select("path", F.col("content").alias("_t")), pairs["tree"] == F.col("path"), "left").drop("path")
    full = full.join(images.select("path", F.col("content").alias("_i"), F.col("length").alias("_n")), full["image"] == F.col("path"), "left").drop("path")
    full = full.withColumn("nodes", tree_nodes(F.col("_t")))
    problem = F.coalesce(image_problem(F.col("_i"), F.col("_n"), max_mb), F.when(F.col("nodes").isNull(), F.lit("bad_input_line")))
    state = F.when((F.col("state") == "pair") & problem.isNotNull(), problem).otherwise(F.col("state"))
    return full.select("idx", F.substring(F.sha2(F.concat("_t", "_i"), 256), 1, 16).alias("id"), "nodes", "image", state.alias("state"))
