"""Sample networks: building, communities, modularity, topology.

Construction, degrees, components and triangles are DataFrame plans for any size. Modularity optimisation and path
centralities are sequential: they run on the driver over the collected edges of a sample network, whose number is
checked (`MAX_EDGES`), and raise beyond it.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict, deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalar import similarity
from cellweave.plans.random_plan import materialize, with_row_id

#: Edges that a sequential method takes at most.
MAX_EDGES = 5_000_000


@dataclass
class Network:
    """vertices (id, name[, group]) and edges (i < j, distance, weight), with results added to them."""

    vertices: DataFrame
    edges: DataFrame
    results: dict = field(default_factory=dict)

    @cached_property
    def topology(self) -> dict:
        """Counted when it is first asked for."""
        return topology(self)


def check_distances(d: DataFrame) -> None:
    """d (i, j, d): finite or null, not negative, symmetric, zero on the diagonal."""
    row = d.agg(F.count_if((F.col("d") < 0) | (F.abs("d") == float("inf"))).alias("bad"), F.count_if((F.col("i") == F.col("j")) & (F.coalesce("d", F.lit(0.0)) != 0)).alias("diagonal")).first()
    if row["bad"] or row["diagonal"]:
        raise ValueError("a distance is negative or infinite, or not 0 from a sample to itself")
    pairs = d.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    if not pairs.where("n <> 2 OR abs(high - low) > 1e-8").isEmpty():
        raise ValueError("a pair of samples has two distances")


def cutoff_of(s: DataFrame, method: str, value: float, min_edges: int) -> float:
    """The similarity from which on a pair is an edge."""
    if method == "fixed":
        return float(value)
    if method not in ("adaptive", "percentile"):
        raise ValueError(f"no way {method!r} to a cutoff: adaptive, percentile or fixed")
    if not 0 <= value <= 100:
        raise ValueError(f"{value} is no percentile")
    n, level = s.agg(F.count("s"), F.percentile("s", F.lit(value / 100))).first()
    if not n:
        return float("inf")
    if method == "percentile" or min_edges <= 0:
        return level
    k = min(min_edges, n)
    return min(level, s.orderBy(F.desc("s")).limit(k).agg(F.min("s")).first()[0])


def build(d: DataFrame, names: Sequence[str] | None = None, groups: Sequence[str] | None = None, *, method: str = "adaptive", value: float = 75.0, min_edges: int = 10, weighted: bool = True, transform: str = "inverse") -> Network:
    """The network of a symmetric distance table d (i, j, d)."""
    if min_edges < 0:
        raise ValueError("fewer than 0 edges")
    d = materialize(d)
    check_distances(d)
    ids = with_row_id(d.select(F.col("i").cast("long").alias("id")).union(d.select(F.col("j").cast("long"))).distinct(), "id")
    n = ids.count()
    for given, what in ((names, "names"), (groups, "groups")):
        if given is not None and len(given) != n:
            raise ValueError(f"{what}: {len(given)} for {n} samples")
    pairs = d.where("i < j AND d IS NOT NULL AND NOT isnan(d)").select("i", "j", F.col("d").cast("double").alias("d"))
    scale = 1.0
    if transform == "negative_exp":
        scale = pairs.where("d > 0").agg(F.median("d")).first()[0] or 1.0
    elif transform == "complement":
        scale = pairs.agg(F.max("d")).first()[0] or 0.0
    scored = pairs.withColumn("s", similarity(F.col("d"), transform, scale))
    edges = scored.where(F.col("s") >= cutoff_of(scored, method, value, min_edges)).select("i", "j", F.col("d").alias("distance"), *([F.col("s").alias("weight")] if weighted else []))
    vertices = ids.select("row_id", "id", F.concat(F.lit("sample_"), F.col("row_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("group"))
    for column, given in (("name", names), ("group", groups)):
        if given is not None:
            told = d.sparkSession.createDataFrame([(k, str(x)) for k, x in enumerate(given)], f"row_id long, {column} string")
            vertices = vertices.drop(column).join(told, "row_id")
    return Network(materialize(vertices.select("id", "name", "group")), materialize(edges))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, by label propagation with shortcuts."""
    both = edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    now = materialize(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(now, both["j"] == now["id"]).groupBy("i").agg(F.min("component").alias("m"))
        step = now.join(near, now["id"] == near["i"], "left").select("id", "component", F.least("component", F.coalesce("m", F.col("component"))).alias("l"))
        # A label's own label: halves the way to the root.
        jump = step.join(step.select(F.col("id").alias("l"), F.col("l").alias("ll")), "l").select("id", F.col("component").alias("was"), F.least("l", "ll").alias("component"))
        jump = materialize(jump)
        if jump.where("was <> component").isEmpty():
            return jump.select("id", "component")
        now = jump.select("id", "component")


def component_sizes(labelled: DataFrame) -> dict:
    """num_components and component_sizes, (size, how many) from the largest down: of n nodes at most sqrt(2 n) such pairs."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    return {"num_components": sum(r["n"] for r in sizes), "component_sizes": [(r["size"], r["n"]) for r in sizes]}


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering): each wedge is opened at its end of the lowest degree, so hubs make few."""
    both = edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    degree = both.groupBy("i").agg(F.count("*").alias("degree"))
    ranked = both.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("degree").alias("dj")), "j")
    up = ranked.where("degree < dj OR (degree = dj AND i < j)").select("i", "j")
    a, b = up.select(F.col("i").alias("o"), F.col("j").alias("p")), up.select(F.col("i").alias("o"), F.col("j").alias("q"))
    wedge = a.join(b, "o").where("p < q")
    closed = wedge.join(edges.select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")), ["p", "q"])
    t = closed.select(F.explode(F.array("o", "p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = nodes.join(degree.withColumnRenamed("i", "id"), "id", "left").join(t, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def topology(net: Network) -> dict:
    n, m = net.vertices.count(), net.edges.count()
    sizes = component_sizes(components(net.vertices.select("id"), net.edges))
    return {"num_nodes": n, "num_edges": m, "density": 2 * m / (n * (n - 1)) if n > 1 else 0.0, "is_connected": sizes["num_components"] == 1, **sizes, "average_degree": 2 * m / n if n else 0.0}


Graph = dict[int, dict[int, float]]


def _graph(net: Network) -> Graph:
    if (size := net.vertices.count() + net.edges.count()) > MAX_EDGES:
        raise ValueError(f"a network of {size} vertices and edges is too large for a sequential method")
    out: Graph = {r["id"]: {} for r in net.vertices.select("id").orderBy("id").collect()}
    weight = "weight" if "weight" in net.edges.columns else None
    for r in net.edges.collect():
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = float(r[weight]) if weight else 1.0
    return out


def partition_modularity(graph: Graph, label: dict[int, object], resolution: float = 1.0) -> float:
    """Newman's Q of an undirected weighted graph."""
    m2 = sum(sum(v.values()) for v in graph.values())
    if not m2:
        return 0.0
    inside, strength = defaultdict(float), defaultdict(float)
    for i, near in graph.items():
        strength[label[i]] += sum(near.values())
        inside[label[i]] += sum(w for j, w in near.items() if label[j] == label[i])
    return sum(inside[c] / m2 - resolution * (strength[c] / m2) ** 2 for c in strength)


def _louvain(graph: Graph, resolution: float, rng: random.Random) -> dict[int, int]:
    """Local moves to the neighbour community of the best gain, then the communities become vertices, until none moves."""
    label = {i: k for k, i in enumerate(graph)}
    members = {k: [i] for i, k in label.items()}
    coarse: dict[int, dict[int, float]] = {label[i]: {label[j]: w for j, w in near.items()} for i, near in graph.items()}
    loops = dict.fromkeys(coarse, 0.0)
    m2 = sum(sum(v.values()) for v in coarse.values())
    if not m2:
        return label
    while True:
        community = {i: i for i in coarse}
        strength = {i: sum(near.values()) + 2 * loops[i] for i, near in coarse.items()}
        total = dict(strength)
        moved = False
        while True:
            order, changed = list(coarse), False
            rng.shuffle(order)
            for i in order:
                toward = defaultdict(float)
                for j, w in coarse[i].items():
                    toward[community[j]] += w
                own = community[i]
                total[own] -= strength[i]
                gain = lambda c: toward[c] - resolution * strength[i] * total.get(c, 0.0) / m2  # noqa: B023, E731
                best = max([own, *sorted(toward)], key=lambda c: (gain(c) + (1e-12 if c == own else 0.0)))
                total[best] = total.get(best, 0.0) + strength[i]
                if best != own:
                    community[i], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        number = {c: k for k, c in enumerate(dict.fromkeys(community.values()))}
        merged, new_loops, edges = defaultdict(list), dict.fromkeys(number.values(), 0.0), {k: defaultdict(float) for k in number.values()}
        for i, c in community.items():
            merged[number[c]] += members[i]
            new_loops[number[c]] += loops[i]
            for j, w in coarse[i].items():
                a, b = number[c], number[community[j]]
                if a == b:
                    new_loops[a] += w / 2
                else:
                    edges[a][b] += w
        members, loops, coarse = dict(merged), new_loops, {k: dict(v) for k, v in edges.items()}
    return {i: k for k, own in members.items() for i in own}


def _label_propagation(graph: Graph, rng: random.Random) -> dict[int, int]:
    label = {i: i for i in graph}
    for _ in range(100):
        order, changed = list(graph), False
        rng.shuffle(order)
        for i in order:
            votes = defaultdict(float)
            for j, w in graph[i].items():
                votes[label[j]] += w
            if votes:
                top = max(votes.values())
                best = [c for c, v in votes.items() if v >= top - 1e-12]
                if label[i] not in best:
                    label[i], changed = rng.choice(sorted(best)), True
        if not changed:
            break
    return label


def _by_package(graph: Graph, algorithm: str, resolution: float, seed: int) -> dict[int, int]:
    """Leiden or Infomap by their own packages, which are no dependencies: ImportError without them."""
    order = list(graph)
    place = {i: k for k, i in enumerate(order)}
    edges = [(place[i], place[j], w) for i, near in graph.items() for j, w in near.items() if i < j]
    if algorithm == "leiden":
        import igraph
        import leidenalg

        drawn = igraph.Graph(n=len(order), edges=[e[:2] for e in edges])
        parts = leidenalg.find_partition(drawn, leidenalg.RBConfigurationVertexPartition, weights=[e[2] for e in edges], resolution_parameter=resolution, seed=seed)
        return dict(zip(order, parts.membership, strict=True))
    from infomap import Infomap

    walk = Infomap(silent=True, two_level=True, seed=seed + 1)
    for k in range(len(order)):
        walk.add_node(k)
    for a, b, w in edges:
        walk.add_link(a, b, w)
    walk.run()
    found = walk.get_modules()
    return {i: found[place[i]] for i in order}


def _canonical(label: dict[int, int]) -> dict[int, int]:
    """Communities numbered from the largest down, ties by least member."""
    groups = defaultdict(list)
    for i, c in label.items():
        groups[c].append(i)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {i: k for k, g in enumerate(order) for i in g}


def _agreement(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of pairs that both partitions treat alike, from the counts of their parts."""
    two = lambda counts: sum(k * (k - 1) // 2 for k in counts.values())
    every = len(a) * (len(a) - 1) // 2
    together = two(Counter((a[i], b[i]) for i in a))
    return (every + 2 * together - two(Counter(a.values())) - two(Counter(b.values()))) / every if every else 1.0


def silhouette(distances: DataFrame, label: DataFrame) -> float:
    """Mean silhouette of labels (id, community) on distances (i, j, d); 0 for singletons or fewer than two communities."""
    if label.select("community").distinct().count() < 2:
        return 0.0
    d = distances.where("i <> j AND d IS NOT NULL").join(label.select(F.col("id").alias("i"), F.col("community").alias("ci")), "i").join(label.select(F.col("id").alias("j"), F.col("community").alias("cj")), "j")
    mean = d.groupBy("i", "ci", "cj").agg(F.avg("d").alias("m"))
    each = mean.groupBy("i").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("m"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return float(each.agg(F.avg(s)).first()[0] or 0.0)


def detect_communities(net: Network, algorithm: str = "louvain", *, resolution: float = 1.0, random_state: int = 0, iterations: int = 10, distances: DataFrame | None = None) -> dict:
    """The partition of the highest modularity among `iterations` seeds (the first of equals), and how stable they are."""
    if algorithm not in ("louvain", "label_propagation", "leiden", "infomap"):
        raise ValueError(f"no algorithm {algorithm!r}")
    if iterations <= 0:
        raise ValueError("one run at least is needed")
    graph = _graph(net)
    runs = []
    for k in range(iterations):
        rng = random.Random(random_state + k)
        if algorithm in ("leiden", "infomap"):
            label = _by_package(graph, algorithm, resolution, random_state + k)
        else:
            label = _louvain(graph, resolution, rng) if algorithm == "louvain" else _label_propagation(graph, rng)
        runs.append(_canonical(label))
    scores = [partition_modularity(graph, r, resolution) for r in runs]
    best = scores.index(max(scores))
    pairs = [_agreement(runs[a], runs[b]) for a in range(len(runs)) for b in range(a)]
    label = net.vertices.sparkSession.createDataFrame(sorted(runs[best].items()), "id long, community int")
    out = {"communities": label, "num_communities": len(set(runs[best].values())), "modularity": scores[best], "stability": sum(pairs) / len(pairs) if pairs else 1.0, "algorithm": algorithm}
    if distances is not None:
        out["silhouette"] = silhouette(distances, label)
    net.results["communities"] = out
    return out


def group_modularity(net: Network, *, nulls: int = 100, plan: Sequence[Sequence[int]] | None = None, resolution: float = 1.0, random_state: int = 0) -> dict:
    """Modularity of the vertices' groups against permutations of their labels (a plan of them, or seeded ones)."""
    rows = net.vertices.orderBy("id").collect()
    if any(r["group"] is None for r in rows):
        raise ValueError("a sample has no group")
    if plan is None and nulls <= 0:
        raise ValueError("one null network at least is needed")
    graph, labels = _graph(net), [r["group"] for r in rows]
    ids = [r["id"] for r in rows]
    observed = partition_modularity(graph, dict(zip(ids, labels, strict=True)), resolution)
    rng = random.Random(random_state)
    steps = plan if plan is not None else [rng.sample(range(len(ids)), len(ids)) for _ in range(nulls)]
    null = [partition_modularity(graph, dict(zip(ids, (labels[k] for k in step), strict=True)), resolution) for step in steps]
    mean = sum(null) / len(null)
    sd = (sum((x - mean) ** 2 for x in null) / len(null)) ** 0.5
    out = {"observed": observed, "null": null, "p_value": (1 + sum(x >= observed for x in null)) / (len(null) + 1), "z_score": (observed - mean) / sd if sd else float("nan"), "null_model": "label_permutation"}
    net.results["modularity"] = out
    return out


def _betweenness(graph: Graph) -> dict[int, float]:
    score = dict.fromkeys(graph, 0.0)
    for s in graph:
        order, before, paths, depth = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in graph[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    n = len(graph)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def _closeness(graph: Graph) -> dict[int, float]:
    out, n = {}, len(graph)
    for s in graph:
        depth, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in graph[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
        total = sum(depth.values())
        out[s] = (len(depth) - 1) / total * (len(depth) - 1) / (n - 1) if total and n > 1 else 0.0
    return out


def pagerank(net: Network, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, pagerank) by weighted power iteration; vertices without edges spread evenly."""
    graph = _graph(net)
    n = len(graph)
    rank = dict.fromkeys(graph, 1 / n) if n else {}
    strength = {i: sum(v.values()) for i, v in graph.items()}
    for _ in range(rounds):
        loose = sum(rank[i] for i in graph if not strength[i])
        new = {i: (1 - damping) / n + damping * (loose / n + sum(rank[j] * w / strength[j] for j, w in graph[i].items())) for i in graph}
        done = sum(abs(new[i] - rank[i]) for i in graph) < n * tolerance
        rank = new
        if done:
            break
    return net.vertices.sparkSession.createDataFrame(sorted(rank.items()), "id long, pagerank double")


def analyze(net: Network, measures: Sequence[str] | None = None) -> dict:
    """Topology, and centralities of the vertices as a table."""
    measures = list(measures or ["degree", "betweenness", "closeness"])
    unknown = sorted(set(measures) - {"degree", "betweenness", "closeness", "pagerank"})
    if unknown:
        raise ValueError(f"no centralities {unknown}")
    out = net.vertices.select("id")
    spark = out.sparkSession
    n = net.topology["num_nodes"]
    if "degree" in measures:
        d = net.edges.select(F.col("i").alias("id")).union(net.edges.select("j")).groupBy("id").agg((F.count("*") / max(1, n - 1)).alias("degree"))
        out = out.join(d, "id", "left").fillna({"degree": 0.0})
    for name, run in (("betweenness", _betweenness), ("closeness", _closeness)):
        if name in measures:
            out = out.join(spark.createDataFrame(sorted(run(_graph(net)).items()), f"id long, {name} double"), "id")
    if "pagerank" in measures:
        out = out.join(pagerank(net), "id")
    net.results["centrality"] = out
    return {"basic_stats": net.topology, "centrality": out}


