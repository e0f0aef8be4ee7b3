"""The co-occurrence graph as tables: nodes (id, label, count), edges (src < dst, weight, type, chunks).

Traversals take the symmetric view (src, dst, weight) and unroll their hops as
joins; a start column keeps many traversals apart in one plan. Levels are
checkpointed, so a plan does not repeat the ones before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.extract import least_of
from marlstone.sources.shared import cut, kept

# Mentions a node needs, hops of a traversal, decay per hop, least weight of an edge in a score.
MIN_COUNT, MAX_HOPS, DECAY, FLOOR = 2, 3, 0.7, 0.01
#: Edges of a graph, as given or contracted, whose communities one task finishes.
ONE_TASK = 200_000


def build_nodes(mentions: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, label, count, num_chunks): the label is the most frequent type, then the first by name."""
    usable = mentions.where(F.length("name") >= 2)
    by_type = usable.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    label = by_type.groupBy("name").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("label"))
    total = usable.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("chunk_id").alias("num_chunks")).where(F.col("count") >= min_count)
    return total.join(label, "name").select(F.col("name").alias("id"), "label", "count", "num_chunks")


def build_edges(mentions: DataFrame, nodes: DataFrame, keep_chunks: int | None = None, kind: str = "mentioned_with") -> DataFrame:
    """(src, dst, weight, type): pairs of nodes by the chunks that mention both; keep_chunks adds the first ids of these."""
    m = mentions.select(F.col("name").alias("id"), "chunk_id").distinct().join(nodes.select("id"), "id")
    pairs = m.select(F.col("id").alias("src"), "chunk_id").join(m.select(F.col("id").alias("dst"), "chunk_id"), "chunk_id").where("src < dst")
    out = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    if keep_chunks is not None:
        out = out.join(least_of(pairs, ["src", "dst"], "chunk_id", "chunks", keep_chunks), ["src", "dst"])
    return out.withColumn("type", F.lit(kind))


def symmetric(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def usable(edges: DataFrame, min_weight: int = 0, types: list[str] | None = None) -> DataFrame:
    """Edge filters, applied before any traversal."""
    edges = edges.where(F.col("weight") >= min_weight)
    return edges.where(F.col("type").isin(types)) if types else edges


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def path_score(weights: Column, top: Column | None = None) -> Column:
    """Product of the weights by the path's largest (or ``top``), each at least FLOOR, times DECAY for each hop after the first."""
    most = F.array_max(weights) if top is None else top
    product = F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * F.greatest(F.coalesce(F.try_divide(w.cast("double"), most.cast("double")), F.lit(0.0)), F.lit(FLOOR)))
    return F.when(F.size(weights) > 0, product * F.pow(F.lit(DECAY), F.size(weights) - 1)).otherwise(0.0)


def multi_hop(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, targets: DataFrame | None = None, simple: bool = False) -> DataFrame:
    """(start, path, weights, hops, score) of a breadth-first search from starts (id).

    Each node is expanded once, by its least path among those of its first level;
    every edge it has gives a path, also back to nodes seen before, unless
    ``simple``. targets (id): only paths that end in one.
    """
    hops = MAX_HOPS if max_hops is None else max_hops
    both = symmetric(edges.select("src", "dst", "weight"))
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<long>").alias("weights"))
    seen = front.select("start", "node")
    parts = None
    for hop in range(1, hops + 1):
        out = front.join(both, front.node == both.src).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("weights", F.array(F.col("weight").cast("long"))).alias("weights"))
        if hop < hops:
            out = cut(out)
        parts = out if parts is None else parts.unionByName(out)
        if hop < hops:
            new = out.join(seen, ["start", "node"], "left_anti")
            best = new.groupBy("start", "node").agg(F.min(F.struct("path", "weights")).alias("b"))
            front = cut(best.select("start", "node", "b.path", "b.weights"))
            seen = seen.unionByName(front.select("start", "node"))
    if parts is None:
        parts = front.where("false")
    if simple:
        parts = parts.where(F.size(F.array_distinct("path")) == F.size("path"))
    if targets is not None:
        parts = parts.join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return parts.select("start", "path", "weights", F.size("weights").alias("hops"), path_score(F.col("weights")).alias("score"))


def simple_paths(edges: DataFrame, source: str, target: str, cutoff: int = MAX_HOPS, limit: int = 20) -> DataFrame:
    """(path, weights, hops, score): simple paths between two nodes, best first."""
    both = symmetric(edges.select("src", "dst", "weight"))
    front = both.where(F.col("src") == source).select(F.col("dst").alias("node"), F.array("src", "dst").alias("path"), F.array(F.col("weight").cast("long")).alias("weights"))
    parts = front.where(F.col("node") == target)
    for _ in range(1, cutoff):
        open_ = front.where(F.col("node") != target)
        front = open_.join(both, open_.node == both.src).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("weights", F.array(F.col("weight").cast("long"))).alias("weights"))
        parts = parts.unionByName(front.where(F.col("node") == target))
    scored = parts.select("path", "weights", F.size("weights").alias("hops"), path_score(F.col("weights")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "path").limit(limit)


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 6) -> DataFrame:
    """(path): the least of the paths with the fewest edges, one row or none."""
    both = symmetric(edges.select("src", "dst"))
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front.select("node")
    for _ in range(max_hops):
        step = front.join(both, front.node == both.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        found = front.where(F.col("node") == target)
        if not found.isEmpty():
            return found.select("path")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
    return spark.createDataFrame([], "path array<string>")


def relationship(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(kind, weight, path): the direct edge, else a shortest path, else kind none."""
    direct = edges.where(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)))
    row = direct.select("weight").head()
    spark = edges.sparkSession
    if row:
        return spark.createDataFrame([("direct", int(row[0]), [a, b])], "kind string, weight long, path array<string>")
    path = shortest_path(edges, a, b).head()
    return spark.createDataFrame([("path", None, list(path[0])) if path else ("none", None, None)], "kind string, weight long, path array<string>")


def neighborhood(edges: DataFrame, start: str, depth: int = 2, min_weight: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) within reach and the edges (src, dst, weight) of each expanded node."""
    both = symmetric(usable(edges, min_weight).select("src", "dst", "weight"))
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, 0)], "id string, depth int")
    nodes, links = front, None
    for d in range(1, depth + 1):
        out = both.join(front.select(F.col("id").alias("src")), "src").select("src", "dst", "weight")
        links = out if links is None else links.unionByName(out)
        front = cut(out.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        nodes = nodes.unionByName(front)
    return nodes, links


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that can be reached. Contracts until no edge is left."""
    labels = nodes.select("id", F.col("id").alias("component"))
    left = cut(edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")))
        top = cut(parent.join(parent.select(F.col("a").alias("p"), F.col("p").alias("top")), "p").select("a", "top"))
        labels = cut(labels.join(top.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("top", "component").alias("component")))
        moved = left.join(top.select("a", F.col("top").alias("x")), "a").join(top.select(F.col("a").alias("b"), F.col("top").alias("y")), "b")
        left = cut(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): each round a node takes the label with the most edge weight around it, itself counting as its
    heaviest edge; ties go to the least label. All nodes move at once; it stops when none moves."""
    both = cut(symmetric(edges.select("src", "dst", "weight")))
    own = both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    votes = cut(both.unionByName(own))
    labels = nodes.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        heard = votes.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = heard.groupBy("src").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("new"))
        moved = cut(labels.join(best.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("new", "community").alias("community"), (F.coalesce("new", "community") != F.col("community")).alias("moved")))
        labels = moved.select("id", "community")
        if moved.where("moved").isEmpty():
            break
    return labels


def communities(edges: DataFrame, resolution: float = 1.0, one_task: int = ONE_TASK, levels: int = 10, rounds: int = 12) -> DataFrame:
    """(id, community): multi-level modularity communities, each connected; a community is named by its least id.

    A level moves nodes between communities until none gains, cuts communities into connected parts (the refinement
    that Leiden adds to Louvain), and contracts these to the nodes of the next level, until no level changes anything.
    Levels run as joins and aggregations over all edges. A graph of at most one_task edges, given so or contracted to
    that, is finished in a single task by the same steps.
    """
    ids = kept(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    labels = ids.select("id", F.col("id").alias("community"))
    # Contracted edges (a <= b, w); a loop holds what lies within a node, counted once.
    left = kept(edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w")))
    for _ in range(levels):
        if left.count() <= one_task:
            found = left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_finish(resolution), f"id {ids.schema['id'].dataType.simpleString()}, community {ids.schema['id'].dataType.simpleString()}")
            return labels.join(found.select(F.col("id").alias("community"), F.col("community").alias("to")), "community", "left").select("id", F.coalesce("to", "community").alias("community"))
        moved = _parts_of_communities(left, _moved(left, resolution, rounds))
        labels = kept(labels.join(moved.select(F.col("id").alias("community"), F.col("community").alias("to")), "community").select("id", F.col("to").alias("community")))
        if moved.where("id != community").isEmpty():
            break
        a, b = (moved.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b"))
        ends = left.join(a, "a").join(b, "b")
        left = kept(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    return labels


def _moved(edges: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(id, community) after rounds in which every second node, by a hash of id and round, may go to the neighbouring
    community with the largest gain; ties go to the least. As only these move, two nodes seldom swap for ever."""
    loops = edges.where("a = b").select(F.col("a").alias("id"), (2 * F.col("w")).alias("w"))
    both = edges.where("a != b").select(F.col("a").alias("id"), F.col("b").alias("near"), "w")
    both = kept(both.unionByName(both.select(F.col("near").alias("id"), F.col("id").alias("near"), "w")))
    nodes = kept(both.select("id", "w").unionByName(loops).groupBy("id").agg(F.sum("w").alias("k")))
    total = nodes.agg(F.sum("k")).first()[0] or 1.0
    labels = nodes.select("id", "k", F.col("id").alias("community"))
    for r in range(rounds):
        mass = labels.groupBy("community").agg(F.sum("k").alias("mass"))
        ties = both.join(labels.select(F.col("id").alias("near"), "community"), "near").groupBy("id", "community").agg(F.sum("w").alias("tie"))
        own = labels.select("id", "community", F.lit(0.0).alias("tie"))
        options = ties.unionByName(own).groupBy("id", "community").agg(F.sum("tie").alias("tie"))
        rated = options.join(mass, "community").join(labels.select("id", "k", F.col("community").alias("now")), "id")
        others = F.col("mass") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("tie") - resolution * F.col("k") * others / total, 9)
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        best = rated.groupBy("id").agg(F.max("k").alias("k"), F.max("now").alias("now"), F.max(F.when(F.col("community") == F.col("now"), gain)).alias("stay"), F.min(F.struct((-gain).alias("g"), F.col("community").alias("c"))).alias("best"))
        goes = turn & (-F.col("best.g") > F.col("stay"))
        step = kept(best.select("id", "k", F.when(goes, F.col("best.c")).otherwise(F.col("now")).alias("community"), (-F.col("best.g") > F.col("stay")).alias("open")))
        labels = step.select("id", "k", "community")
        if step.where("open").isEmpty():
            break
    return labels.select("id", "community")


def _parts_of_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, community): the connected parts of each community, by its inner edges, named by their least id."""
    a, b = (labels.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b"))
    inner = edges.where("a != b").join(a, "a").join(b, "b").where("ca = cb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return kept(connected_components(labels.select("id"), inner).withColumnRenamed("component", "community"))


def _finish(resolution: float):
    """The same steps over all levels, in one task, nodes one by one in order of their ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, flat = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        rows, cols, w = flat[: len(pdf)], flat[len(pdf) :], pdf["w"].to_numpy(float)
        place = np.arange(len(names))  # of each name, its node on the level
        while True:
            n = int(max(rows.max(), cols.max())) + 1
            near: list[dict[int, float]] = [{} for _ in range(n)]
            k = np.bincount(rows, w, n) + np.bincount(cols, w, n)
            for a, b, x in zip(rows.tolist(), cols.tolist(), w.tolist()):
                if a != b:
                    near[a][b] = near[a].get(b, 0.0) + x
                    near[b][a] = near[b].get(a, 0.0) + x
            label = _sweeps(near, k, resolution)
            part = _connected(near, label)
            if len(set(part)) == n:
                break
            number = np.unique(part, return_inverse=True)[1]
            place, rows, cols = number[place], number[rows], number[cols]
        least: dict[int, object] = {}
        for name, p in zip(names.tolist(), place.tolist()):
            least.setdefault(p, name)
        return pd.DataFrame({"id": names, "community": [least[p] for p in place.tolist()]})

    return run


def _sweeps(near: list[dict[int, float]], k: np.ndarray, resolution: float) -> list[int]:
    label, mass, scale = list(range(len(near))), k.copy(), resolution / max(k.sum(), 1e-300)
    for _ in range(50):
        changed = 0
        for i, links in enumerate(near):
            tie: dict[int, float] = {label[i]: 0.0}
            for j, x in links.items():
                tie[label[j]] = tie.get(label[j], 0.0) + x
            mass[label[i]] -= k[i]
            rated = sorted((-round(x - scale * k[i] * mass[c], 9), c) for c, x in tie.items())
            stay = -round(tie[label[i]] - scale * k[i] * mass[label[i]], 9)
            if rated[0][0] < stay:
                label[i] = rated[0][1]
                changed += 1
            mass[label[i]] += k[i]
        if not changed:
            break
    return label


def _connected(near: list[dict[int, float]], label: list[int]) -> list[int]:
    """The connected parts of each label's nodes: a part is named by its least node."""
    part = [-1] * len(near)
    for i in range(len(near)):
        if part[i] < 0:
            part[i], open_ = i, [i]
            while open_:
                for j in near[open_.pop()]:
                    if part[j] < 0 and label[j] == label[i]:
                        part[j] = i
                        open_.append(j)
    return part


def louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) by modularity; see communities."""
    return communities(edges, resolution)


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (id, community)."""
    l1, l2 = (labels.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    e = edges.join(l1, "src").join(l2, "dst")
    total = edges.agg(F.sum("weight").alias("m"))
    inside = e.where("c_src = c_dst").groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = symmetric(edges.select("src", "dst", "weight")).join(l1, "src").groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("ends"))
    per = ends.join(inside, "c", "left").crossJoin(total)  # total is one row
    return per.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)).alias("modularity"))


def community_stats(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, density) of communities with two nodes or more."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    l1, l2 = (labels.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inside = edges.join(l1, "src").join(l2, "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.count(F.lit(1)).alias("m"))
    n = F.col("size")
    return sizes.join(inside, "community", "left").select("community", "size", F.round(2.0 * F.coalesce("m", F.lit(0)) / (n * (n - 1)), 3).alias("density"))


def relevant_communities(labels: DataFrame, summaries: DataFrame, query: str, top: int = 3) -> DataFrame:
    """(community, score): 2 for each query word in a node's name, 1 for each in the summary (community, summary)."""
    words = F.array(*(F.lit(w) for w in sorted({w for w in query.lower().split() if len(w) > 2}))).cast("array<string>")
    per_node = labels.select("community", F.size(F.array_intersect(words, F.split(F.lower("id"), r"\s+"))).alias("n")).groupBy("community").agg(F.sum("n").alias("n"))
    summary = summaries.select("community", F.size(F.filter(words, lambda w: F.contains(F.lower("summary"), w))).alias("s"))
    scored = per_node.join(summary, "community", "left").select("community", (2 * F.col("n") + F.coalesce("s", F.lit(0))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "community").limit(top)


def community_context(summaries: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: the summaries of chosen communities (community, score) as one text."""
    rows = chosen.join(summaries.where("summary is not null and summary != ''"), "community")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("community").alias("c"), F.concat(F.lit("- Community "), F.col("community"), F.lit(": "), F.col("summary")).alias("t"))))
    return rows.agg(F.array_join(lines["t"], "\n").alias("context"))


def community_prompts(labels: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 50, max_nodes: int = 20, max_edges: int = 10) -> DataFrame:
    """(community, prompt) for the largest communities: their most mentioned nodes and heaviest inner edges."""
    large = community_stats(labels, edges).orderBy(F.desc("size"), "community").limit(top).select("community")
    own = labels.join(large, "community").join(nodes, "id")
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("count"), "id"))).where(F.col("r") <= max_nodes)
    lines = ranked.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", F.format_string("- %s (%s, %d mentions)", "id", "label", "count").alias("t"))))["t"].alias("n"))
    a, b = (ranked.select("community", F.col("id").alias(x)) for x in ("src", "dst"))
    inner = edges.join(a, "src").join(b, ["dst", "community"])
    rel = inner.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("weight"), "src", "dst"))).where(F.col("r") <= max_edges)
    links = rel.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", F.format_string("- %s / %s (%d)", "src", "dst", "weight").alias("t"))))["t"].alias("e"))
    body = F.concat(F.lit("Entities:\n"), F.array_join("n", "\n"), F.lit("\nLinks:\n"), F.coalesce(F.array_join("e", "\n"), F.lit("")))
    return lines.join(links, "community", "left").select("community", body.alias("prompt"))


def node_detail(nodes: DataFrame, edges: DataFrame, name: str, top: int = 50) -> DataFrame:
    """(id, label, count, degree, neighbor, weight, type): a node with its heaviest edges."""
    own = nodes.where(F.lower("id") == name.lower())
    near = symmetric(edges.select("src", "dst", "weight", "type")).join(own.select(F.col("id").alias("src")), "src")
    best = near.orderBy(F.desc("weight"), "dst").limit(top)
    n = near.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return own.join(n, own.id == n.src, "left").drop("src").join(best, own.id == best.src, "left").select("id", "label", "count", F.coalesce("degree", F.lit(0)).alias("degree"), F.col("dst").alias("neighbor"), "weight", "type")


def export(nodes: DataFrame, edges: DataFrame, max_nodes: int = 500, max_edges: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree and the edges among them."""
    best = nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(max_nodes)
    inner = edges.join(best.select(F.col("id").alias("src")), "src").join(best.select(F.col("id").alias("dst")), "dst")
    return best, inner.select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst").limit(max_edges)


def export_communities(labels: DataFrame, nodes: DataFrame, edges: DataFrame, summaries: DataFrame | None = None, most: int = 50, top: int = 5) -> DataFrame:
    """(community, size, density, summary, top_nodes) of the largest communities; top_nodes by mentions."""
    large = community_stats(labels, edges).orderBy(F.desc("size"), "community").limit(most)
    ranked = labels.join(large.select("community"), "community").join(nodes.select("id", "count"), "id").withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("count"), "id"))).where(F.col("r") <= top)
    lists = ranked.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", "id")))["id"].alias("top_nodes"))
    out = large.join(lists, "community", "left")
    out = out.join(summaries.select("community", "summary"), "community", "left") if summaries is not None else out.withColumn("summary", F.lit(None).cast("string"))
    return out.select("community", "size", "density", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("top_nodes", F.array().cast("array<string>")).alias("top_nodes"))


def export_json(nodes: DataFrame, edges: DataFrame, labels: DataFrame, summaries: DataFrame | None = None, max_nodes: int = 500, max_edges: int = 2000, most: int = 50) -> DataFrame:
    """(json): one row, an object of the best nodes, the edges among them and the largest communities; bounded by its limits."""
    best, links = export(nodes, edges, max_nodes, max_edges)
    n = best.join(labels, "id", "left").select(F.struct((-F.col("degree")).alias("o"), "id", "label", "count", "degree", "community").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("nodes"))
    e = links.select(F.struct((-F.col("weight")).alias("o"), "src", "dst", "weight").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("edges"))
    c = export_communities(labels, nodes, edges, summaries, most).select(F.struct((-F.col("size")).alias("o"), "community", "size", "density", "summary", "top_nodes").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("communities"))
    plain = lambda c, *names: F.transform(c, lambda x: F.struct(*(x[k].alias(to) for k, to in names))).alias(c)
    one = n.crossJoin(e).crossJoin(c)  # one row each
    same = lambda *names: [(k, k) for k in names]
    return one.select(F.to_json(F.struct(plain("nodes", *same("id", "label", "count", "degree", "community")), plain("edges", ("src", "source"), ("dst", "target"), ("weight", "weight")), plain("communities", *same("community", "size", "density", "summary", "top_nodes")))).alias("json"))


GRAPH_TABLES = ("nodes", "edges", "labels")


def save_graph(path: str, nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> None:
    """Nodes, edges and communities (id, community) as Parquet."""
    for name, table in zip(GRAPH_TABLES, (nodes, edges, labels)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in GRAPH_TABLES}
