"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import components, numbered, star_edges, stored, tune

THRESHOLD = 0.93
#: Neighbours in a list, random-projection orders that start the graph, members of a starting block.
WIDTH = 8
ORDERS = 10
BLOCK = 96
BITS = 32
#: A pass ends when a round changes less than this share of the list entries, or after so many rounds.
CHANGE = 0.005
MOST_ROUNDS = 6
#: Queries with links that the audit wants to see (compared with every vector), in small components and in
#: those of more than CROWD nodes apart; the recall it asks for; bytes of vectors sent along at once.
AUDIT = 256
CROWD = 64
RECALL = 0.995
AUDIT_BYTES = 1 << 22
#: Hash values among which nodes are drawn.
SPACE = 1 << 40
#: Members of a component compared in one piece when its links are counted.
COUNT_BLOCK = 256
#: What single precision may be off.
SLACK = 1e-4

GROUP = ["label", "dim"]


def unit_rows(rows):
    """Unit vectors in double precision (scaled first, so that no square overflows)."""
    import numpy as np

    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(blobs, kind):
    import numpy as np

    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1)


def valid(col: str = "embedding"):
    """Neither null nor zero, and every component a finite number."""
    inf = float("inf")
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.coalesce(F.col("label").isNotNull() & F.col(col).isNotNull() & (F.size(col) > 0) & ~bad
                      & F.exists(col, lambda x: x != 0), F.lit(False))


def starting_pairs(nodes: DataFrame, seed: int, width: int, orders: int) -> DataFrame:
    """(a, b, sim): the best ``width`` of each node's block in each of ``orders`` projection orders.

    In an order, nodes are sorted by the signs of random projections and cut into blocks of BLOCK
    neighbours; a crowd of near copies simply fills several blocks.  Pairs within a component are skipped.
    """
    def coded(frames):
        import numpy as np
        import pandas as pd

        planes = {}
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                u = _matrix(part["u"].tolist(), np.float32)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, orders * BITS)).astype(np.float32)
                bits = (u @ planes[dim] > 0).reshape(len(u), orders, BITS)
                code = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for t in range(orders):
                    yield pd.DataFrame({"label": part["label"], "dim": part["dim"], "turn": t, "code": code[:, t],
                                        "node": part["node"], "comp": part["comp"], "u": part["u"]})

    def blocks(frames):
        import numpy as np
        import pandas as pd

        def best(pdf):
            for _, part in pdf.groupby(["label", "dim", "turn"], sort=False):
                for s in range(0, len(part), BLOCK):
                    p = part.iloc[s:s + BLOCK]
                    if len(p) < 2:
                        continue
                    u, node, comp = _matrix(p["u"].tolist(), np.float32), p["node"].to_numpy(), p["comp"].to_numpy()
                    sim = u @ u.T
                    sim[comp[:, None] == comp] = -2
                    k = min(width, len(p) - 1)
                    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    value = np.take_along_axis(sim, top, axis=1)
                    a, b = np.repeat(node, k), node[top.ravel()]
                    keep = value.ravel() > -1.5
                    yield a[keep], b[keep], value.ravel()[keep]

        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = len(pdf) // BLOCK * BLOCK
            rest = pdf.iloc[whole:]
            got = list(best(pdf.iloc[:whole])) if whole else []
            if got:
                yield pd.DataFrame({"a": np.concatenate([g[0] for g in got]), "b": np.concatenate([g[1] for g in got]),
                                    "sim": np.concatenate([g[2] for g in got]).astype(np.float32)})
        if rest is not None and len(rest):
            for a, b, v in best(rest):
                yield pd.DataFrame({"a": a, "b": b, "sim": v.astype(np.float32)})

    n_parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.mapInPandas(coded, "label int, dim int, turn int, code long, node long, comp long, u binary")
    order = ["label", "dim", "turn", "code", "node"]
    return (rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
            .mapInPandas(blocks, "a long, b long, sim float"))


def best_lists(pairs: DataFrame, width: int) -> DataFrame:
    """(a, nbrs): the ``width`` most similar b of each a, in two steps so that a hub's candidates are spread."""
    def cut(frame, *keys):
        return frame.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "b")), asc=False), 1, width).alias("nbrs"))
    part = cut(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8))), "a", "salt")
    return cut(part.select("a", F.explode("nbrs").alias("n")).select("a", "n.*"), "a")


def join_neighbours(lists: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """New candidates (a, b, sim): members of one list meet each other, if that would enter a's list."""
    worst = lists.select(F.col("a").alias("node"), F.when(F.size("nbrs") < width, F.lit(-2.0)).otherwise(
        F.element_at("nbrs", -1)["sim"]).cast("float").alias("worst"))
    held = nodes.join(worst, "node", "left").select(F.col("node").alias("b"), "comp", "u", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    member = lists.select(F.col("a").alias("host"), F.explode(F.array_append(F.transform("nbrs", lambda n: n["b"]), F.col("a"))).alias("b"))
    groups = member.join(held, "b").groupBy("host").agg(F.collect_list(F.struct("b", "comp", "worst", "u")).alias("m"))

    def meet(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for m in pdf["m"]:
                if len(m) < 2:
                    continue
                u = _matrix([x["u"] for x in m], np.float32)
                node = np.array([x["b"] for x in m])
                comp = np.array([x["comp"] for x in m])
                worst_ = np.array([x["worst"] for x in m], dtype=np.float32)
                sim = u @ u.T
                take = (sim > worst_[:, None]) & (comp[:, None] != comp)
                i, j = np.nonzero(take)
                out.append((node[i], node[j], sim[i, j]))
            if out:
                yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out]),
                                    "sim": np.concatenate([o[2] for o in out]).astype(np.float32)}).drop_duplicates(["a", "b"])

    return groups.select("m").mapInPandas(meet, "a long, b long, sim float")


def neighbour_graph(nodes: DataFrame, seed: int, width: int, orders: int, n: int) -> DataFrame:
    """NN-descent: lists from projection orders, refined until few entries change."""
    lists = stored(best_lists(starting_pairs(nodes, seed, width, orders), width), "op1")
    for _ in range(MOST_ROUNDS):
        flat = lists.select("a", F.explode("nbrs").alias("n")).select("a", "n.b", "n.sim")
        new = stored(best_lists(flat.union(join_neighbours(lists, nodes, width).select("a", "b", "sim")), width), "op1")
        changed = new.select("a", F.explode("nbrs").alias("n")).select("a", "n.b").join(
            flat.select("a", "b"), ["a", "b"], "left_anti").count()
        lists = new
        if changed < CHANGE * n * width:
            break
    return lists


def exact_links(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches the threshold."""
    one = nodes.select(F.col("node").alias("a"), F.col("embedding").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("embedding").alias("y"))

    def check(frames):
        import numpy as np

        for pdf in frames:
            if len(pdf):
                for _, part in pdf.groupby(pdf["x"].map(len)):
                    cos = np.einsum("ij,ij->i", unit_rows(part["x"]), unit_rows(part["y"]))
                    yield part.loc[cos >= threshold, ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, near): vectors, copies counted and itself included, that reach the threshold within its component.

    ``members``: node, comp, copies, embedding, size (nodes of the component).  This is the enlarged
    neighbour list of every node of a component, held as pairs of blocks of COUNT_BLOCK members: a large
    component is many tasks, and only a count leaves each.
    """
    n_blocks = F.ceil(F.col("size") / COUNT_BLOCK).cast("int")
    rows = members.withColumn("nb", n_blocks).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.select("node", "comp", "copies", "embedding", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    n_parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n_parts, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")

    def count(frames):
        import numpy as np
        import pandas as pd

        def one(p):
            u, copies = unit_rows(p["embedding"]), p["copies"].to_numpy()
            lo, blk = int(p["lo"].iloc[0]), p["blk"].to_numpy()
            near = u @ u.T >= threshold
            np.fill_diagonal(near, True)
            if lo != int(p["hi"].iloc[0]):
                near &= blk[:, None] != blk
            return pd.DataFrame({"node": p["node"].to_numpy(), "near": (near * copies).sum(axis=1)})

        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["comp", "lo", "hi"]].to_numpy()
            if not len(key):
                continue
            tail = (key == key[-1]).all(axis=1)
            rest = pdf[tail]
            out = [one(p) for _, p in pdf[~tail].groupby(["comp", "lo", "hi"], sort=False)]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest):
            yield one(rest)

    return rows.select("node", "comp", "copies", "embedding", "blk", "lo", "hi").mapInPandas(
        count, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))


def audit(nodes: DataFrame, comps: DataFrame, threshold: float, queries: int, seed: int) -> float:
    """Share of a node's links that lie within its component, on average over drawn nodes that have links."""
    return audited(nodes, comps, threshold, queries, seed)[0]


def audited(nodes: DataFrame, comps: DataFrame, threshold: float, queries: int, seed: int) -> tuple[float, bool, DataFrame | None]:
    """(recall, whether every node was drawn, a star forest (a, b) of the links between components), against brute force.

    Nodes of small components and of crowds are judged apart, every node with links counts the same, and
    the lower average is returned.  Nodes are drawn by hash until ``queries`` with links have been seen, or
    all are drawn: no links seen means that there are none.  They are compared with every node in blocks,
    and only AUDIT_BYTES of their vectors are sent along at once.
    """
    import numpy as np

    spark = nodes.sparkSession
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    held = stored(nodes.select(*GROUP, "node", "embedding").join(comps, "node").join(sizes, "comp").select(
        *GROUP, "node", "comp", "embedding", (F.col("size") > CROWD).alias("crowd"),
        F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(SPACE)).alias("h")), "op1")

    def scan(drawn):
        by = {}
        for r in drawn:
            by.setdefault((r["label"], r["dim"]), []).append(r)
        sent = spark.sparkContext.broadcast({k: (np.array([r["node"] for r in v]), np.array([r["comp"] for r in v]),
                                                 unit_rows([r["embedding"] for r in v])) for k, v in by.items()})

        def compare(frames):
            import pandas as pd

            for pdf in frames:
                for key, part in pdf.groupby(GROUP):
                    if key not in sent.value:
                        continue
                    u, node, comp = unit_rows(part["embedding"]), part["node"].to_numpy(), part["comp"].to_numpy()
                    for s in range(0, len(sent.value[key][0]), 1024):
                        q_node, q_comp, q = (x[s:s + 1024] for x in sent.value[key])
                        i, j = np.nonzero(u @ q.T >= threshold)
                        other = node[i] != q_node[j]
                        i, j = i[other], j[other]
                        inside = comp[i] == q_comp[j]
                        links = np.bincount(j, minlength=len(q_node))
                        hit = np.flatnonzero(links)
                        if len(hit):
                            yield pd.DataFrame({"node": q_node[hit], "links": links[hit], "b": -1,
                                                "found": np.bincount(j[inside], minlength=len(q_node))[hit]})
                            a, b = star_edges(node[i[~inside]], q_node[j[~inside]])
                            yield pd.DataFrame({"node": a, "links": 0, "b": b, "found": 0})

        return stored(held.select(*GROUP, "node", "comp", "embedding").mapInPandas(
            compare, "node long, links long, b long, found long"), "op1")

    worst, whole, missed = 1.0, True, None
    for kind in held.groupBy("crowd").agg(F.count("*").alias("n"), F.max("dim").alias("dim")).orderBy("crowd").collect():
        at, want, linked, share = 0, 2 * queries, 0, 0.0
        while at < SPACE and linked < queries:
            to = min(SPACE, at + max(1, SPACE * min(want, max(1, AUDIT_BYTES // (8 * kind["dim"]))) // kind["n"]))
            seen = scan(held.where((F.col("crowd") == kind["crowd"]) & (F.col("h") >= at) & (F.col("h") < to)).collect())
            got = (seen.where("b < 0").groupBy("node").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
                   .agg(F.count("*"), F.sum(F.col("found") / F.col("links"))).first())
            linked, share = linked + got[0], share + (got[1] or 0.0)
            lost = seen.where("b >= 0").select(F.col("node").alias("a"), "b")
            missed = lost if missed is None else missed.union(lost)
            at, want = to, 4 * want
        worst = min(worst, share / linked) if linked else worst
        whole = whole and at >= SPACE
    return worst, whole, missed


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, orders: int = ORDERS,
                 seed: int = 7, recall: float = RECALL) -> DataFrame:
    """Links between vectors of one label with cosine >= ``threshold``: counts, components, one kept each.

    1. Equal vectors of a label are one node with its number of copies.
    2. NN-descent builds lists of ``width`` neighbours; the pairs near the threshold are checked in double
       precision and joined into components.
    3. Lists that are full of links (saturated) are enlarged: their component's members are counted in
       blocks, and a further pass searches with lists that hold only nodes outside the own component,
       until no list brings two components together.
    4. An audit compares drawn nodes with all; the links that it finds between components are joined too,
       and below ``recall`` another pass runs with wider lists and more orders, unless every node was drawn.

    Returns vec_id, n_links, component_id, kept.  Vectors that are null, zero, empty, or hold null or
    non-finite components, and those without a label, link with nothing (their own component).  Vectors
    of different lengths do not link.  Repeated rows are separate vectors, linked with each other.  A
    null vec_id is ignored in the minimum; such a row is kept only if its component has no vec_id.  An
    empty table gives no rows; extra columns are not read.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = stored(vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
                  .withColumn("ok", valid()).select(
                      "vec_id", "ok", "label", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("k1"),
                      F.hash("embedding").alias("k2"), F.when(F.col("ok"), F.col("embedding")).alias("embedding")), "op1")
    key = ["label", "dim", "k1", "k2"]  # 96 bits stand for the vector
    classes = rows.where("ok").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes, n = numbered(classes, key, "node", "op1")

    def single(frames):
        import numpy as np

        for pdf in frames:
            if len(pdf):
                pdf["u"] = None
                for _, part in pdf.groupby("dim"):
                    u = unit_rows(part["embedding"]).astype(np.float32)
                    pdf.loc[part.index, "u"] = [x.tobytes() for x in u]
                yield pdf

    nodes = nodes.select("node", *key, "least", "copies", "embedding")
    schema = ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + ", u binary"
    nodes = stored(nodes.mapInPandas(single, schema), "op1")

    def joined(links):
        comp = components(links, "op1")
        return stored(nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "op1")

    comps, links, turn = nodes.select("node", F.col("node").alias("comp")), None, 0
    while n:
        held = stored(nodes.join(comps, "node"), "op1")
        lists = neighbour_graph(held.select("node", *GROUP, "comp", "u"), seed + turn, width, orders, n)
        near = lists.select("a", F.explode("nbrs").alias("n")).select("a", "n.*").where(F.col("sim") >= threshold - SLACK)
        pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = stored(exact_links(pairs, nodes, threshold), "op1")
        n_found = found.count()
        links = found if links is None else links.union(found)
        if n_found:
            comps = joined(links)
        saturated = lists.where((F.size("nbrs") == width) & (F.element_at("nbrs", -1)["sim"] >= threshold - SLACK)).limit(1).count()
        turn += 1
        if n_found and saturated:
            continue
        reached, whole, missed = audited(nodes, comps, threshold, AUDIT, seed + turn)
        if missed is not None and not missed.isEmpty():
            links = links.union(missed)
            comps = joined(links)
        if reached >= recall or whole:
            break
        width, orders = 2 * width, 2 * orders
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    members = nodes.select("node", "copies", "least", "embedding").join(comps, "node").join(sizes, "comp")
    several = count_links(members.where("size > 1"), threshold)
    low = members.groupBy("comp").agg(F.min("least").alias("component_id"))
    label = (nodes.select("node", *key, "copies").join(comps, "node").join(low, "comp").join(several, "node", "left")
             .select(*key, (F.coalesce("near", "copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("ok")))
    out = rows.join(label, [*key, "ok"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
