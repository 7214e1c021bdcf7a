"""Density clustering in space, or space and time, without listing all pairs of a dense place.

Points fall into cells so small that all points of a cell are neighbours. A cell with enough points
is all core, with no pair formed. Points of thin cells (fewer than `min_pts` each) are compared with
the points of the cells around them where these hold few. Of a crowded cell they meet a pyramid of counted
boxes instead: a box wholly in reach counts as a number, one out of reach is dropped, and only those on the
border are opened into their sub-cells, until `min_pts` are counted. Two full cells are linked by
comparing boxes of ever finer sub-cells, and point pairs only where the boxes cannot decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.operators.spatial import connected_components
from busloom.session import cut_round

LEVELS, BITS = 3, 3  # sub-cells: 3 levels, each splits an axis in 8
CROWD = 64  # points from which on a full cell is met as boxes


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def st_dbscan(
    df: DataFrame, pid: str, x: str, y: str, eps, min_pts, by: list[str] = (), t: str | None = None, eps_t=None
) -> DataFrame:
    """(by, pid, nucleo, rotulo): rotulo is the smallest core id of the cluster, -1 for noise.

    `t` in seconds. `by` clusters each group apart (days, parameter sets, replicates). `eps`,
    `eps_t` and `min_pts` may be columns, so a whole parameter grid is one job. The point itself
    counts. A border point goes to the cluster with the smallest core id.
    """
    by = list(by)
    side = _c(eps) * (0.999999 / 2**0.5)
    fine = 1 << (LEVELS * BITS)
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(pid).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        (F.col(t).cast("double") if t else F.lit(0.0)).alias("t"),
        _c(eps).alias("_e"), (_c(eps_t) if t else F.lit(1.0)).alias("_et"), _c(min_pts).alias("_m"),
        F.floor(F.col(x) / side * fine).alias("fx"), F.floor(F.col(y) / side * fine).alias("fy"),
        (F.floor(F.col(t) / (_c(eps_t) * 0.999999) * fine) if t else F.lit(0).cast("long")).alias("ft"),
    )
    sh = LEVELS * BITS
    p = p.withColumns({c: F.shiftright("f" + c[1], sh) for c in ("cx", "cy", "ct")})
    cell = [*by, "cx", "cy", "ct"]
    n = p.groupBy(*cell).agg(F.count("*").alias("_n"))
    p = cut_round(p.join(n, cell).withColumns({"cheia": F.col("_n") >= F.col("_m"), "lotada": (F.col("_n") >= F.col("_m")) & (F.col("_n") > CROWD)}).drop("_n"))
    def beside(c, k):
        return F.explode(F.sequence(F.col(c) - k, F.col(c) + k))

    around = p.withColumn("qx", beside("cx", 2)).withColumn("qy", beside("cy", 2)).withColumn("qt", beside("ct", 1) if t else F.col("ct"))
    near = (F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)) <= F.col("_e") * F.col("_e")) & (
        F.abs(F.col("t") - F.col("t2")) <= F.col("_et"))
    thin = around.where(~F.col("cheia"))
    crowded = p.where("lotada")
    other = p.where("NOT lotada").select(*by, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"),
                     F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("ct").alias("qt"))
    qcell = [*by, "qx", "qy", "qt"]
    met = thin.join(other, qcell).where(near).groupBy(*by, "id").agg(F.count("*").alias("_k"))
    reach = None if crowded.isEmpty() else cut_round(_reach_of_crowded(thin, crowded, by))
    if reach is not None:
        met = met.unionByName(reach.select(*by, "id", "_k")).groupBy(*by, "id").agg(F.sum("_k").alias("_k"))
    core = p.join(met, [*by, "id"], "left").withColumn("nucleo", F.col("cheia") | (F.coalesce("_k", F.lit(0)) >= F.col("_m"))).drop("_k")
    core = cut_round(core)
    # nodes: cells with core points, named by their smallest core id
    cores = core.where("nucleo")
    nodes = cores.groupBy(*cell).agg(F.min("id").alias("no"))
    full = cores.where("cheia")
    slim = cores.where("NOT cheia")
    named = cores.where("NOT lotada").join(nodes, cell).select(*by, F.col("no").alias("no2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"),
                                          F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("ct").alias("qt"))
    near_slim = around.drop("cheia").join(slim.select(*by, "id"), [*by, "id"], "left_semi").join(nodes, cell)
    e1 = near_slim.join(named, qcell).where(near & (F.col("no") != F.col("no2"))).select(*by, "no", "no2").distinct()
    if reach is not None:
        far = nodes.select(*by, F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("ct").alias("qt"), F.col("no").alias("no2"))
        near_crowd = reach.join(slim.select(*by, "id", "cx", "cy", "ct"), [*by, "id"]).join(nodes, cell).join(far, qcell)
        e1 = e1.unionByName(near_crowd.select(*by, "no", "no2")).distinct()
    e2 = _links_of_full_cells(full, by, cell, t is not None)
    # ids are unique inside a group, so components are computed on group-qualified names
    key = lambda c: F.struct(*by, F.col(c).alias("n"))
    edges = e1.unionByName(e2).select(key("no").alias("a"), key("no2").alias("b"))
    comp = connected_components(edges, "a", "b", nodes.select(key("no").alias("v")))
    comp = comp.select(*[F.col("v." + b).alias(b) for b in by], F.col("v.n").alias("no"), F.col("component.n").alias("rotulo"))
    label = nodes.join(comp, [*by, "no"])
    in_core = cores.join(label, cell).select(*by, "id", "nucleo", "rotulo")
    hub = cores.where("NOT lotada").join(label, cell).select(*by, F.col("rotulo").alias("r2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"),
                                         F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("ct").alias("qt"))
    rest = core.where("NOT nucleo")
    edge = thin.join(rest.select(*by, "id"), [*by, "id"], "left_semi").join(hub, qcell).where(near)
    edge = edge.select(*by, "id", "r2")
    if reach is not None:
        far = label.select(*by, F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("ct").alias("qt"), F.col("rotulo").alias("r2"))
        edge = edge.unionByName(reach.join(rest.select(*by, "id"), [*by, "id"], "left_semi").join(far, qcell).select(*by, "id", "r2"))
    edge = edge.groupBy(*by, "id").agg(F.min("r2").alias("rotulo"))
    out = rest.select(*by, "id", "nucleo").join(edge, [*by, "id"], "left").withColumn("rotulo", F.coalesce("rotulo", F.lit(-1).cast(df.schema[pid].dataType)))
    return in_core.unionByName(out).withColumnRenamed("id", pid)


def _boxes(full: DataFrame, by, cell, level: int) -> DataFrame:
    """Bounding box and one real point of every sub-cell of a level."""
    s = BITS * (LEVELS - level)
    d = full.withColumns({f"s{a}": F.shiftright("f" + a, s) for a in "xyt"})
    aggs = [f(c).alias(f"{n}{c}") for c in "xyt" for n, f in (("lo", F.min), ("hi", F.max))]
    return d.groupBy(*by, *cell[len(by):], "sx", "sy", "st").agg(
        *aggs, F.min(F.struct("x", "y", "t")).alias("rep"), F.max(F.struct("x", "y", "t")).alias("rep2"), F.count("*").alias("n"),
        F.first("_e").alias("_e"), F.first("_et").alias("_et"))


def _reach_of_crowded(thin: DataFrame, crowded: DataFrame, by) -> DataFrame:
    """(by, id, qx, qy, qt, _k): points of each crowded cell within reach of a thin point, if any; exact below `min_pts`.

    A row is a thin point and a box, never one of a crowded cell's points unless its finest sub-cell lies on the border of reach.
    """
    pair, quad = [*by, "id"], ["qx", "qy", "qt"]
    spot = ["x", "y", "t", "_e", "_et", "_m"]
    todo = thin.select(*pair, *quad, *spot)
    found = None
    for level in range(LEVELS + 1):
        box = _boxes(crowded, by, [*by, "cx", "cy", "ct"], level).drop("_e", "_et", "rep", "rep2")
        box = box.withColumns({f"p{a}": F.shiftright(f"s{a}", BITS) for a in "xyt"}).withColumnsRenamed({f"c{a}": f"q{a}" for a in "xyt"})
        if level == 0:
            box = box.drop("px", "py", "pt")
        met = todo.join(box, [*by, *quad, *([] if level == 0 else ["px", "py", "pt"])])
        near = {a: F.greatest(F.lit(0.0), F.col("lo" + a) - F.col(a), F.col(a) - F.col("hi" + a)) for a in "xyt"}
        far = {a: F.greatest(F.abs(F.col("lo" + a) - F.col(a)), F.abs(F.col(a) - F.col("hi" + a))) for a in "xyt"}
        within = lambda g: (g["x"] * g["x"] + g["y"] * g["y"] <= F.col("_e") * F.col("_e")) & (g["t"] <= F.col("_et"))
        met = cut_round(met.where(within(near)).select(*pair, *quad, *spot, "sx", "sy", "st", "n", within(far).alias("sure")))
        got = met.where("sure").groupBy(*pair, *quad).agg(F.sum("n").alias("_k"))
        found = got if found is None else found.unionByName(got).groupBy(*pair, *quad).agg(F.sum("_k").alias("_k"))
        enough = found.withColumnRenamed("_k", "_have")
        todo = met.where("NOT sure").join(enough, [*pair, *quad], "left").where(F.coalesce("_have", F.lit(0)) < F.col("_m"))
        todo = cut_round(todo.select(*pair, *quad, *spot, *[F.col(f"s{a}").alias(f"p{a}") for a in "xyt"]))
        if todo.isEmpty():
            return found
    last = crowded.select(*by, *[F.col(f"c{a}").alias(f"q{a}") for a in "xyt"], *[F.col(f"f{a}").alias(f"p{a}") for a in "xyt"], *[F.col(a).alias(a + "2") for a in "xyt"])
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    hit = todo.join(last, [*by, *quad, "px", "py", "pt"]).where((dx * dx + dy * dy <= F.col("_e") * F.col("_e")) & (F.abs(F.col("t") - F.col("t2")) <= F.col("_et")))
    return found.unionByName(hit.groupBy(*pair, *quad).agg(F.count("*").alias("_k"))).groupBy(*pair, *quad).agg(F.sum("_k").alias("_k"))


def near_components(df: DataFrame, pid: str, x: str, y: str, radius: float) -> DataFrame:
    """(pid, component): components of points within `radius` of each other, named by their smallest id; no pair is listed.

    With one point enough every cell is full, so cells are the nodes, linked by their boxes. Points without a place are alone.
    """
    got = st_dbscan(df.select(pid, x, y), pid, x, y, radius, 1).select(pid, F.col("rotulo").alias("component"))
    lost = df.where(F.col(x).isNull() | F.col(y).isNull()).select(pid, F.col(pid).alias("component"))
    return got.unionByName(lost)


def _links_of_full_cells(full: DataFrame, by, cell, timed: bool) -> DataFrame:
    """Pairs of neighbouring full cells holding two points within reach, exactly."""
    names = full.groupBy(*cell).agg(F.min("id").alias("no"))
    side = ["cx", "cy", "ct", "sx", "sy", "st", *[n + c for c in "xyt" for n in ("lo", "hi")], "rep", "rep2"]

    def gap(c, far):
        a, b = F.col("hi" + c + "_b") - F.col("lo" + c), F.col("hi" + c) - F.col("lo" + c + "_b")
        if far:
            return F.greatest(a, b)
        return F.greatest(F.lit(0.0), F.col("lo" + c) - F.col("hi" + c + "_b"), F.col("lo" + c + "_b") - F.col("hi" + c))

    def dist2(far):
        return gap("x", far) * gap("x", far) + gap("y", far) * gap("y", far)

    def reps(a, b):
        dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
        return (dx * dx + dy * dy <= F.col("_e") * F.col("_e")) & (F.abs(F.col(f"{a}.t") - F.col(f"{b}.t")) <= F.col("_et"))

    ids = ["cx", "cy", "ct", "cx_b", "cy_b", "ct_b"]
    sub = ["sx", "sy", "st", "sx_b", "sy_b", "st_b"]
    linked, open_pairs = None, None
    for level in range(LEVELS + 1):
        box = _boxes(full, by, cell, level)
        right = box.select(*by, *[F.col(c).alias(c + "_b") for c in side])
        if level == 0:
            def beside(c, k):
                return F.explode(F.sequence(F.col(c) - k, F.col(c) + k))

            l = box.withColumn("cx_b", beside("cx", 2)).withColumn("cy_b", beside("cy", 2)).withColumn("ct_b", beside("ct", 1 if timed else 0))
            pairs = l.join(right, [*by, "cx_b", "cy_b", "ct_b"]).where(F.struct("cx", "cy", "ct") < F.struct(F.col("cx_b").alias("cx"), F.col("cy_b").alias("cy"), F.col("ct_b").alias("ct")))
        else:
            def up(suffix):
                return [F.shiftright("s" + a + suffix, BITS).alias("p" + a + suffix) for a in "xyt"]
            todo = open_pairs.select(*by, *ids, *[F.col(c).alias("p" + c[1:]) for c in sub])
            l = box.select("*", *up(""))
            r = right.select("*", *up("_b"))
            pairs = todo.join(l, [*by, "cx", "cy", "ct", "px", "py", "pt"]).join(r, [*by, "cx_b", "cy_b", "ct_b", "px_b", "py_b", "pt_b"])
        e2 = F.col("_e") * F.col("_e")
        sure = (dist2(True) <= e2) & (gap("t", True) <= F.col("_et"))
        for a, b in (("rep", "rep_b"), ("rep2", "rep_b"), ("rep", "rep2_b"), ("rep2", "rep2_b")):
            sure = sure | reps(a, b)
        maybe = (dist2(False) <= e2) & (gap("t", False) <= F.col("_et"))
        pairs = cut_round(pairs.where(maybe).withColumn("sim", sure).select(*by, *ids, *sub, "sim"))
        yes = pairs.where("sim").select(*by, *ids).distinct()
        linked = yes if linked is None else linked.unionByName(yes)
        open_pairs = cut_round(pairs.where("NOT sim").join(yes, [*by, *ids], "left_anti"))
        if not open_pairs.limit(1).count():
            break
    else:
        # boxes cannot decide: exact pairs between the finest sub-cells that are left
        pts = full.select(*by, "cx", "cy", "ct", F.col("fx").alias("sx"), F.col("fy").alias("sy"), F.col("ft").alias("st"), "x", "y", "t", "_e", "_et").distinct()
        b = pts.drop("_e", "_et").select(*by, *[F.col(c).alias(c + "_b") for c in ("cx", "cy", "ct", "sx", "sy", "st", "x", "y", "t")])
        d = open_pairs.select(*by, *ids, *sub).join(pts, [*by, "cx", "cy", "ct", "sx", "sy", "st"]).join(b, [*by, "cx_b", "cy_b", "ct_b", "sx_b", "sy_b", "st_b"])
        ok = (F.pow(F.col("x") - F.col("x_b"), F.lit(2)) + F.pow(F.col("y") - F.col("y_b"), F.lit(2)) <= F.col("_e") * F.col("_e")) & (F.abs(F.col("t") - F.col("t_b")) <= F.col("_et"))
        linked = linked.unionByName(d.where(ok).select(*by, *ids).distinct())
    out = linked.distinct().join(names, cell)
    nb = names.select(*by, F.col("cx").alias("cx_b"), F.col("cy").alias("cy_b"), F.col("ct").alias("ct_b"), F.col("no").alias("no2"))
    return out.join(nb, [*by, "cx_b", "cy_b", "ct_b"]).select(*by, "no", "no2")


def level_sweep(df: DataFrame, pid: str, x: str, y: str, levels: list[float], min_pts: int) -> DataFrame:
    """Clusters at several radii; each point keeps the cluster of its longest-lived membership.

    Life of a cluster = how many levels hold a cluster with the same smallest core point.
    """
    d = df.select(pid, x, y, F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("raio"))
    lab = cut_round(st_dbscan(d, pid, x, y, F.col("raio"), min_pts, by=["raio"]))
    life = lab.where("rotulo <> -1").groupBy("rotulo").agg(F.countDistinct("raio").alias("vida"))
    best = lab.join(life, "rotulo").groupBy(pid).agg(F.max_by("rotulo", F.struct("vida", -F.col("raio"))).alias("rotulo"))
    return df.select(pid).join(best, pid, "left").withColumn("rotulo", F.coalesce("rotulo", F.lit(-1)))
