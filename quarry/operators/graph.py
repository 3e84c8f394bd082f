"""Property graph: neighbourhoods, activation spreading, entity and alias resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import written


def cut(df: DataFrame) -> DataFrame:
    """Writes an intermediate round to the shared folder and reads it back."""
    return written(df, "round")


def both_ways(edges: DataFrame) -> DataFrame:
    """src, tgt, weight of each edge in both directions."""
    return edges.select("src", "tgt", "weight").unionAll(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, depth of every node at most ``depth`` steps from a seed (column id), edges taken both ways; seeds are left out.

    Each round joins the frontier with the edges and takes off what was visited; rounds are written out.
    """
    links = both_ways(edges).select("src", "tgt").distinct()
    visited = cut(seeds.select("id", F.lit(0).alias("depth")).distinct())
    frontier = visited
    for step in range(1, depth + 1):
        reached = frontier.join(links, frontier["id"] == links["src"]).select(F.col("tgt").alias("id")).distinct().join(visited, "id", "left_anti")
        frontier = cut(reached.select("id", F.lit(step).alias("depth")))
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges both of whose ends are a seed or at most ``depth`` steps from one."""
    nodes = bfs(edges, seeds, depth).select("id").union(seeds.select("id")).distinct()
    return edges.join(nodes, edges["src"] == nodes["id"], "left_semi").join(nodes, edges["tgt"] == nodes["id"], "left_semi")


def spread(edges: DataFrame, seeds: DataFrame, steps: int = 3, decay: float = 0.5, least: float = 0.01) -> DataFrame:
    """id, activation after ``steps`` rounds from seeds (id, activation).

    In each round every node with ``least`` or more gives each neighbour activation x weight x decay, for each edge, if that is ``least`` or more.
    """
    links = both_ways(edges)
    now = seeds.select("id", F.col("activation").cast("double").alias("activation"))
    for _ in range(steps):
        sent = now.where(F.col("activation") >= least).join(links, now["id"] == links["src"])
        sent = sent.select(F.col("tgt").alias("id"), (F.col("activation") * F.col("weight") * decay).alias("activation")).where(F.col("activation") >= least)
        now = cut(now.unionByName(sent).groupBy("id").agg(F.sum("activation").alias("activation")))
    return now


def resolved(mentions: DataFrame, entities: DataFrame, most: int = 2) -> DataFrame:
    """mention, id (null: a new entity) and distance of the entity whose name is nearest, ``most`` edits away at most.

    Lengths of names that are within ``most`` edits differ by no more, so that pairs come from a join on the length.
    """
    names = entities.select("id", F.lower("name").alias("name")).withColumn("n", F.length("name"))
    asked = mentions.select("mention").distinct().withColumn("n", F.explode(F.sequence(F.length("mention") - most, F.length("mention") + most)))
    pairs = asked.join(names, "n").withColumn("distance", F.levenshtein(F.lower("mention"), F.col("name"), most)).where("distance >= 0")
    best = pairs.groupBy("mention").agg(F.min(F.struct("distance", "id")).alias("best"))
    return mentions.select("mention").distinct().join(best, "mention", "left").select("mention", F.col("best.id").alias("id"), F.col("best.distance").alias("distance"))


def aliases_resolved(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """The lower-cased text with every alias replaced by its entity's lower-cased name, longest alias first."""
    out = F.lower(text)
    for alias, name in sorted(aliases, key=lambda x: (-len(x[0]), x[0])):
        out = F.replace(out, F.lit(alias.lower()), F.lit(name.lower()))
    return out


def entity_context(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """id, context: a line for the entity, then its outgoing and incoming relations in order."""
    named = entities.select("id", "name")
    line = lambda side: F.format_string(side + " %s %s (%.3f)", "relation", "other", "weight")
    ends = (("src", "tgt", "->"), ("tgt", "src", "<-"))
    sides = [
        relations.join(named.withColumnRenamed("name", "other").withColumnRenamed("id", far), far).select(F.col(own).alias("id"), F.lit(k).alias("k"), line(arrow).alias("line"))
        for k, (own, far, arrow) in enumerate(ends)
    ]
    lines = sides[0].unionByName(sides[1]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    head = F.concat(F.lit("Entity: "), "name", F.lit(" ("), "entity_type", F.lit(")"))
    return entities.join(lines, "id", "left").select("id", F.concat_ws("\n", head, F.transform(F.coalesce("lines", F.array().cast("array<struct<k:int,line:string>>")), lambda x: x["line"])).alias("context"))


def relation_label(raw: Column) -> Column:
    """The canonical label, or what was given for any other."""
    plain = F.lower(F.trim(raw))
    return F.when(plain.isin("related_to", "part_of", "depends_on", "caused_by"), plain).otherwise(raw)


def first_within(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row of each key: the first by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
