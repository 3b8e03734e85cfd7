"""Orders and trees: topological order, all paths from roots, directory trees."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, layer of all nodes that lie on no cycle and behind none (edges: from_id needs to_id): layer 0 needs nothing. Peels a layer a
    round until none is free, so the rounds are as many as the layers."""
    left = cut(nodes.select(F.col("id").alias("node")).distinct())
    needs = cut(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("need")).distinct())
    done = None
    for k in count():
        free = cut(left.join(needs, "node", "left_anti").withColumn("layer", F.lit(k)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free, "node", "left_anti"))
        needs = cut(needs.join(free.select(F.col("node").alias("need")), "need", "left_anti").select("node", "need"))
    return done if done is not None else left.limit(0).withColumn("layer", F.lit(0))


def trees(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, node, level, path, via, cycle: every path of up to depth edges from each root (id); one ends where it meets a node of its
    own again (cycle). Parallel edges make paths of their own. Paths grow with the product of degrees, so depth has no default."""
    steps = cut(edges.select(F.col("from_id").alias("s"), F.col("to_id").alias("t"), F.col("type").alias("via")))
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("level"), F.array("id").alias("path"),
        F.lit("").alias("via"), F.lit(False).alias("cycle"))
    found = front
    for k in range(1, depth + 1):
        open_ = front.where("NOT cycle")
        front = open_.drop("via").join(steps, F.col("node") == F.col("s")).select(
            "root", F.col("t").alias("node"), F.lit(k).alias("level"), F.concat("path", F.array("t")).alias("path"), "via", F.array_contains("path", F.col("t")).alias("cycle"))
        front = cut(front)
        found = found.unionByName(front)
        if front.isEmpty():
            break
    return found


def folder_id(path):
    """A diagram's id of a folder."""
    return F.regexp_replace(F.concat(F.lit("dir_"), F.regexp_replace(path, "[^A-Za-z0-9_-]", "_")), "__+", "_")


def directories(files: DataFrame) -> DataFrame:
    """Containment links parent, child, label (of a folder; null for a file) of files (id, path, project_id): projects hold top folders,
    folders their folders, and the last folder, or else the project, the file. Folders of one path are one, in all projects."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    f = files.select("id", "project_id", F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>")).alias("dirs"))
    last = F.when(F.size("dirs") > 0, folder_id(F.element_at("dirs", -1))).otherwise(F.col("project_id"))
    leaves = f.select(last.alias("parent"), F.col("id").alias("child"), F.lit(None).cast("string").alias("label"))
    inner = f.select("project_id", "dirs", F.posexplode("dirs").alias("n", "dir"))
    above = F.when(F.col("n") > 0, folder_id(F.try_element_at("dirs", F.col("n")))).otherwise(F.col("project_id"))
    return inner.select(above.alias("parent"), folder_id(F.col("dir")).alias("child"),
        F.element_at(F.split("dir", "/"), -1).alias("label")).unionByName(leaves).distinct()
