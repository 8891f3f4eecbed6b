"""The layered supply graph: checks, edge weights, shock propagation, transmission coefficients, paths.

``nodes(node_id, label, layer, kind, ticker)``, ``edges(source, target, substitutability, cost_share, lead_time_months)``; where edges
have a ``source_layer`` too, a round reads only those of the layers that it starts from.
Edges go from one layer to the next, so shocks need four rounds at most, and each round is one join on the edge source and one
aggregate: state never exceeds shocks x nodes of a layer, whatever the number of paths. Each round is written to the shared folder, so
that the next one reads it instead of computing all rounds before it again, and its shuffle files go. A small state is sent to every
task, so that the edges stay where they are; a large one is joined by key with adaptive skew handling for hubs.
The shocks of a node lie in the columns of one row, eight at a time, where there are few: an edge is then one row of a shuffle, not one
for each shock.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.quality import finite, together, violation
from ..functions.ranges import running
from ..functions.strings import blank

LAYERS = 5
TERMINAL = LAYERS - 1
#: Rows of a state that is sent to every task; shocks that may lie in columns, and in how many at a time; targets in one row of a list,
#: and in the lists that are sent to the shocks at a time.
SMALL, FEW, ABREAST, LISTED, AT_ONCE = 300_000, 32, 8, 1000, 250_000_000
KINDS = ["raw", "intermediate", "component", "subassembly", "equity"]


def weighted(edges: DataFrame) -> DataFrame:
    """Edges with ``transmission_factor = (1 - substitutability) * cost_share``."""
    return edges.withColumn("transmission_factor", (1 - F.col("substitutability")) * F.col("cost_share"))


def node_violations(nodes: DataFrame) -> DataFrame:
    expected = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("layer") + 1)
    in_range = F.col("layer").between(0, TERMINAL)
    twice = nodes.groupBy("node_id").count().where("count > 1")
    return together(
        [
            violation(nodes, "blank_id", blank("node_id"), F.col("label")),
            violation(nodes, "blank_label", blank("label"), F.col("node_id")),
            violation(nodes, "layer_range", ~F.coalesce(in_range, F.lit(False)), F.col("node_id"), F.col("layer")),
            violation(nodes, "kind_mismatch", in_range & ~F.when(in_range, expected).eqNullSafe(F.col("kind")), F.col("node_id"), F.col("kind")),
            violation(nodes, "ticker_layer", in_range & ((F.col("layer") == TERMINAL) == blank("ticker")), F.col("node_id"), F.col("ticker")),
            violation(twice, "duplicate_node", F.lit(True), F.col("node_id"), F.col("count")),
        ]
    )


def edge_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is wrong with the values of each edge, its ends, and edges that stand twice.

    Equal ends are one row with their number; they are dealt by source and then by target, and names are made of what is found only.
    """
    name = F.concat_ws("->", "source", "target")
    share = lambda c: ~F.coalesce(finite(F.col(c)) & F.col(c).between(0, 1), F.lit(False))
    known = nodes.select(F.col("node_id"), "layer").dropDuplicates(["node_id"])
    ends = edges.select("source", "target").repartition("source").groupBy("source", "target").agg(F.count("*").alias("n"))
    ends = ends.join(known.select(F.col("node_id").alias("source"), F.col("layer").alias("ls")), "source", "left")
    ends = ends.join(known.select(F.col("node_id").alias("target"), F.col("layer").alias("lt")), "target", "left")
    rules = {"unknown_source": (F.col("ls").isNull(), F.lit("")), "unknown_target": (F.col("lt").isNull(), F.lit("")), "layer_skip": (F.col("lt") != F.col("ls") + 1, F.concat_ws("->", "ls", "lt")), "duplicate_edge": (F.col("n") > 1, F.col("n").cast("string"))}
    # Each edge breaks a rule on its own, but a pair of ends stands twice once.
    found = [F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"), (F.lit(1) if rule == "duplicate_edge" else F.col("n")).cast("int").alias("times"))) for rule, (bad, detail) in rules.items()]
    placed = ends.where(F.coalesce(*found).isNotNull()).select("source", "target", F.explode(F.array_compact(F.array(*found))).alias("v"))
    placed = placed.select("source", "target", "v.rule", "v.detail", F.explode(F.sequence(F.lit(1), "v.times")).alias("_"))
    return together(
        [
            violation(edges, "substitutability_range", share("substitutability"), name, F.col("substitutability")),
            violation(edges, "cost_share_range", share("cost_share"), name, F.col("cost_share")),
            violation(edges, "lead_time_range", ~F.coalesce(finite(F.col("lead_time_months")) & (F.col("lead_time_months") >= 0), F.lit(False)), name, F.col("lead_time_months")),
            placed.select("rule", name.alias("entity"), "detail"),
        ]
    )


def layer_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, n_nodes, n_edges): edges are counted at the layer that they leave."""
    n = nodes.groupBy("layer").agg(F.count("*").alias("n_nodes"))
    e = edges.join(nodes.select(F.col("node_id").alias("source"), "layer"), "source").groupBy("layer").agg(F.count("*").alias("n_edges"))
    return n.join(e, "layer", "left").select("layer", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def shock_errors(nodes: DataFrame, shocks: DataFrame) -> DataFrame:
    """(shock_id, error) of shocks on unknown nodes or of non-finite size."""
    unknown = shocks.join(nodes.select("node_id").distinct(), "node_id", "left_anti").select("shock_id", F.lit("unknown_node").alias("error"))
    return unknown.unionByName(shocks.where(~F.coalesce(finite(F.col("shock")), F.lit(False))).select("shock_id", F.lit("non_finite_shock").alias("error")))


def salted(steps: DataFrame, hub_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """(steps with a salt, hubs(node_id, salts) or None): the edges of a source with over ``hub_edges`` of them are dealt to salts by
    their target; other sources have the salt 0."""
    hubs = written(steps.groupBy("node_id").agg(F.ceil(F.count("*") / hub_edges).cast("int").alias("salts")).where("salts > 1"), "hubs")
    if hubs.isEmpty():
        return steps.withColumn("salt", F.lit(0)), None
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("target"), F.col("salts")).cast("int")).otherwise(0)
    return steps.join(hubs, "node_id", "left").withColumn("salt", salt).drop("salts"), hubs


def _steps(edges: DataFrame) -> DataFrame:
    """(node_id, target, transmission_factor, and source_layer where the edges have it)."""
    return weighted(edges).select(F.col("source").alias("node_id"), "target", "transmission_factor", *(c for c in edges.columns if c == "source_layer"))


def _round(state: DataFrame, steps: DataFrame, by: list[str], sums: dict[str, Column], below: int | None, hub_edges: int) -> DataFrame | None:
    """The next state: ``state(by..., node_id, layer, ...)`` over one edge, ``sums`` by target; None if nothing is under the layer ``below``.

    A source with over ``hub_edges`` edges is dealt to salts where the state is joined by key, and its rows are copied to them.
    """
    here = state if below is None else state.where(F.col("layer") < below)
    sizes = {r.layer: r["count"] for r in here.groupBy("layer").count().collect()}
    if not sizes:
        return None
    if "source_layer" in steps.columns:
        steps = (steps.where(F.col("source_layer").isin([k for k in sizes if k is not None])) if None not in sizes else steps).drop("source_layer")
    if sum(sizes.values()) <= SMALL:
        step = steps.join(F.broadcast(here), "node_id")
    else:
        steps, hubs = salted(steps, hub_edges)
        here = here.withColumn("salt", F.lit(0))
        if hubs is not None:
            last = F.coalesce("salts", F.lit(1)) - 1
            here = here.drop("salt").join(F.broadcast(hubs), "node_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
        step = here.join(steps, ["node_id", "salt"])
    step = step.groupBy(*by, F.col("target").alias("node_id"), (F.col("layer") + 1).alias("layer"))
    return written(step.agg(*[F.sum(c).alias(k) for k, c in sums.items()]), "shocks")


def _rounds(state: DataFrame, steps: DataFrame, by: list[str], sums: dict[str, Column], below: int | None, hub_edges: int) -> list[DataFrame]:
    """The state and what follows from it, a table a round."""
    out = [state]
    while len(out) <= TERMINAL and (then := _round(out[-1], steps, by, sums, below, hub_edges)) is not None:
        out.append(then)
    return out


def _in_layers(nodes: DataFrame, shocks: DataFrame) -> DataFrame:
    layers = nodes.select("node_id", "layer").dropDuplicates(["node_id"])
    return written(shocks.join(layers, "node_id").groupBy("shock_id", "node_id", "layer").agg(F.sum("shock").alias("shock")), "shocks")


def _few(df: DataFrame, column: str) -> list | None:
    """The values of a column, if there are few."""
    ids = [r[0] for r in df.select(column).distinct().limit(FEW + 1).collect()]
    return sorted(ids, key=str) if len(ids) <= FEW else None


def _propagated(good: DataFrame, edges: DataFrame, below: int, hub_edges: int) -> list[DataFrame]:
    """``good(shock_id, node_id, layer, shock)`` and its rounds, long."""
    steps, factor = _steps(edges), F.col("transmission_factor")
    ids = _few(good, "shock_id")
    if not ids or not steps.where(factor.isNull()).isEmpty():  # a null in a column means that the node isn't reached
        return _rounds(good, steps, ["shock_id"], {"shock": F.col("shock") * factor}, below, hub_edges)
    out = []
    for part in (ids[i : i + ABREAST] for i in range(0, len(ids), ABREAST)):
        cols = {f"s{k}": F.col("shock_id").eqNullSafe(F.lit(i)) for k, i in enumerate(part)}
        wide = good.groupBy("node_id", "layer").agg(*[F.sum(F.when(c, F.col("shock"))).alias(k) for k, c in cols.items()])
        wide = wide.where(F.coalesce(*cols).isNotNull())
        rows = F.array(*[F.struct(F.lit(i).cast(good.schema["shock_id"].dataType).alias("shock_id"), F.col(k).alias("shock")) for k, i in zip(cols, part)])
        for table in _rounds(wide, steps, [], {k: F.col(k) * factor for k in cols}, below, hub_edges):
            long = table.select("node_id", "layer", F.explode(rows).alias("r")).where("r.shock IS NOT NULL")
            out.append(long.select("r.shock_id", "node_id", "layer", "r.shock"))
    return out


def propagate(nodes: DataFrame, edges: DataFrame, shocks: DataFrame, *, below: int = TERMINAL, hub_edges: int = 1_000_000) -> DataFrame:
    """``shocks(shock_id, node_id, shock)`` -> (shock_id, node_id, layer, shock) for all nodes that are reached, the source included.

    Signed and linear; a zero shock stays as rows of zero; bad shocks give no rows (see ``shock_errors``). Edges of sources under the layer
    ``below`` are followed. A source with over ``hub_edges`` edges is shared by as many tasks as it fills, each of which gets a copy
    of its shocks.
    """
    good = _in_layers(nodes, shocks.where(F.coalesce(finite(F.col("shock")), F.lit(False))))
    return together(_propagated(good, edges, below, hub_edges)).select("shock_id", "node_id", "layer", "shock")


def layer_totals(nodes: DataFrame, edges: DataFrame, shocks: DataFrame, *, hub_edges: int = 1_000_000) -> DataFrame:
    """(shock_id, layer, n_nodes, total): how many rows ``propagate`` has for each shock and layer, and their sum.

    The state of the last layer, shocks x listed nodes, is never made: a node's edges are a list of numbered targets and the sum of their
    factors. Lists are sent to the shocks that reach the node, ``AT_ONCE`` targets at a time, and a shock's targets are counted
    with one bit for each number, shock after shock.
    """
    last = TERMINAL - 1
    names = running(shocks.select("shock_id").distinct(), [], ["shock_id"], {"number": F.lit(1)}, "shock-names")
    names = written(names, "shock-names")
    numbered = shocks.join(names, F.col("number").isNotNull() & shocks["shock_id"].eqNullSafe(names["shock_id"])).select(F.col("number").alias("shock_id"), "node_id", "shock")
    good = _in_layers(nodes, numbered.where(F.coalesce(finite(F.col("shock")), F.lit(False))))
    rounds = [r.withColumn("round", F.lit(k)) for k, r in enumerate(_rounds(good, _steps(edges), ["shock_id"], {"shock": F.col("shock") * F.col("transmission_factor")}, last, hub_edges))]
    held = together([r.select("shock_id", "round", "node_id", "layer", "shock") for r in rounds])
    found = [held.groupBy("shock_id", "layer").agg(F.count("*").alias("n_nodes"), F.sum("shock").alias("total"))]
    front = held.where(F.col("layer") == last)
    steps = _steps(edges)
    steps = steps.where(F.col("source_layer") == last).drop("source_layer") if "source_layer" in steps.columns else steps.join(front.select("node_id").distinct(), "node_id", "left_semi")
    targets = running(steps.select("target").distinct(), [], ["target"], {"number": F.lit(1)}, "targets")
    place = Window.partitionBy("node_id").orderBy("number")
    lists = steps.join(targets, "target").select("node_id", F.col("number").cast("int").alias("number"), "transmission_factor")
    lists = lists.withColumn("piece", F.floor((F.row_number().over(place) - 1) / LISTED))
    lists = written(lists.groupBy("node_id", "piece").agg(F.collect_list("number").alias("targets"), F.sum("transmission_factor").alias("factor")), "lists")
    sizes = lists.groupBy("node_id").agg(F.sum(F.size("targets")).alias("k"))
    sent = front.groupBy("node_id").count().join(sizes, "node_id").agg(F.sum(F.col("count") * F.col("k"))).first()[0] or 0
    n = lists.agg(F.max(F.array_max("targets"))).first()[0]
    chunks = -(-sent // AT_ONCE)
    for i in range(chunks):
        some = front.where(F.pmod(F.xxhash64("shock_id"), F.lit(chunks)) == i).select("shock_id", "round", "node_id", "shock")
        pieces = some.join(lists, "node_id").select("shock_id", "round", (F.col("shock") * F.col("factor")).alias("total"), "targets")
        pieces = pieces.repartition("shock_id").sortWithinPartitions("shock_id", "round")
        counted = written(pieces.mapInArrow(_counter(n + 1), "shock_id long, layer int, n_nodes long, total double"), "layer-totals")
        found.append(counted)
    out = together(found).groupBy("shock_id", "layer").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("total").alias("total"))
    out = out.withColumnRenamed("shock_id", "number").join(names, "number")
    return out.select("shock_id", "layer", "n_nodes", "total")


def _counter(n: int):
    """Counts the different targets of each (shock_id, round) in sorted rows; targets are under ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last_at, marked = np.zeros(n, bool), np.empty(n, np.int64), []
        key, size, total = None, 0, None
        row = lambda: pa.RecordBatch.from_pydict({"shock_id": pa.array([key[0]], pa.int64()), "layer": pa.array([TERMINAL], pa.int32()), "n_nodes": pa.array([size], pa.int64()), "total": pa.array([total], pa.float64())})
        for batch in batches:
            if not batch.num_rows:
                continue
            shock, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shock_id", "round"))
            lists, totals = batch.column("targets"), batch.column("total")
            ends = [*(np.flatnonzero((np.diff(shock) != 0) | (np.diff(nth) != 0)) + 1).tolist(), len(shock)]
            start = 0
            for end in ends:
                if key != (now := (int(shock[start]), int(nth[start]))):
                    if key is not None:
                        yield row()
                    for m in marked:
                        seen[m] = False
                    key, size, total, marked = now, 0, None, []
                to = lists.slice(start, end - start).flatten().to_numpy(zero_copy_only=False)
                to = to[~seen[to]]
                at = np.arange(len(to))
                last_at[to] = at
                to = to[last_at[to] == at]  # each once
                seen[to] = True
                marked.append(to)
                size += len(to)
                part = pc.sum(totals.slice(start, end - start)).as_py()
                total = part if total is None else total + (part or 0.0)
                start = end
        if key is not None:
            yield row()

    return count


def signal_values(nodes: DataFrame, edges: DataFrame, signals: DataFrame, tickers: DataFrame) -> DataFrame:
    """(snapshot_id, ticker, value): the active candidates' ``s_raw * weight``, summed by listed node.

    ``signals(snapshot_id, node_id, s_raw, active)``. As shocks add up, one shock for each snapshot gives what the matrix of all candidates would,
    with a state of snapshots x nodes; the matrix is used where there are fewer candidates' nodes than snapshots.
    """
    active = written(signals.where("active").select("snapshot_id", "node_id", "s_raw").groupBy("snapshot_id", "node_id").agg(F.sum("s_raw").alias("shock")), "signals")
    listed = tickers.select("node_id", "ticker")
    n = active.agg(F.count_distinct("snapshot_id").alias("snapshots"), F.count_distinct("node_id").alias("nodes")).first()
    if n.snapshots <= n.nodes:
        out = together(_propagated(_in_layers(nodes, active.withColumnRenamed("snapshot_id", "shock_id")), edges, TERMINAL, 1_000_000))
        return out.join(listed, "node_id").select(F.col("shock_id").alias("snapshot_id"), "ticker", F.col("shock").alias("value"))
    weights = transmission_matrix(nodes, edges, active.select("node_id")).join(listed, "node_id").select(F.col("source").alias("node_id"), "ticker", "weight")
    return active.join(weights, "node_id").select("snapshot_id", "ticker", (F.col("shock") * F.col("weight")).alias("value"))


def terminal_shocks(propagated: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shock_id, ticker, shock) of the listed nodes."""
    tickers = nodes.where(F.col("layer") == TERMINAL).select("node_id", "ticker")
    return propagated.where(F.col("layer") == TERMINAL).join(tickers, "node_id").select("shock_id", "ticker", "shock")


def ticker_violations(nodes: DataFrame) -> DataFrame:
    twice = nodes.where(F.col("layer") == TERMINAL).groupBy("ticker").count().where("count > 1")
    return violation(twice, "duplicate_ticker", F.lit(True), F.col("ticker"), F.col("count"))


def transmission_matrix(nodes: DataFrame, edges: DataFrame, sources: DataFrame, *, below: int = TERMINAL) -> DataFrame:
    """``sources(node_id)`` -> (source, node_id, layer, weight): the response of each node to a unit shock; see ``propagate`` for ``below``."""
    unit = sources.select("node_id").distinct().select(F.col("node_id").alias("shock_id"), "node_id", F.lit(1.0).alias("shock"))
    return propagate(nodes, edges, unit, below=below).select(F.col("shock_id").alias("source"), "node_id", "layer", F.col("shock").alias("weight"))


def transmission(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(source, target)`` -> with ``weight``: 1.0 to itself, 0.0 if unreachable, NULL and ``error`` for an unknown node.

    Shocks go no further than the deepest target. Pairs are dealt by target once, for their distinct rows and to see if it is known; the few sources
    are sent to every task.
    """
    known = nodes.groupBy("node_id").agg(F.max("layer").alias("layer"))
    sources = pairs.select("source").distinct().join(known.select(F.col("node_id").alias("source"), F.lit(True).alias("has_source")), "source")
    sources = written(sources, "sources")
    ends = known.join(pairs.select(F.col("target").alias("node_id")).distinct(), "node_id", "left_semi")
    deepest = ends.agg(F.max("layer")).first()[0]
    matrix = transmission_matrix(nodes, edges, sources.select(F.col("source").alias("node_id")), below=0 if deepest is None else deepest)
    df = pairs.select("source", "target").repartition("target").distinct()
    df = df.join(known.select(F.col("node_id").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    df = df.join(F.broadcast(sources) if sources.count() <= SMALL else sources, "source", "left")
    df = df.join(matrix.select("source", F.col("node_id").alias("target"), "weight"), ["source", "target"], "left")
    known_both = F.col("has_source").isNotNull() & F.col("has_target").isNotNull()
    return df.select("source", "target", F.when(known_both, F.coalesce("weight", F.lit(0.0))).alias("weight"), F.when(~known_both, F.lit("unknown_node")).alias("error"))


def path_totals(edges: DataFrame, pairs: DataFrame, *, hub_edges: int = 1_000_000) -> DataFrame:
    """``pairs(source, target)`` -> (source, target, n_paths, n_nodes, weight): how many paths ``paths`` lists for a pair, the nodes of the
    shortest one, and the sum of their weights. Pairs without a path have no row.

    No path is listed: what leads to a node is counted and summed round by round, so the state is sources x nodes of a layer.
    """
    steps, factor = _steps(edges), F.col("transmission_factor")
    asked = pairs.select("source", "target").where("source <> target")
    starts = written(asked.select("source").distinct(), "sources")
    ids = _few(starts, "source")
    groups = [None] if ids is None else [ids[i : i + ABREAST // 2] for i in range(0, len(ids), ABREAST // 2)]
    found = []
    for part in groups:
        if part is None:
            state = starts.select("source", F.col("source").alias("node_id"), F.lit(1).cast("long").alias("n0"), F.lit(1.0).alias("w0"))
        else:
            cols = [c for k, i in enumerate(part) for c in (F.when(F.col("source") == F.lit(i), F.lit(1)).cast("long").alias(f"n{k}"), F.when(F.col("source") == F.lit(i), F.lit(1.0)).alias(f"w{k}"))]
            state = starts.where(F.col("source").isin(part)).select(F.col("source").alias("node_id"), *cols)
        k = 1 if part is None else len(part)
        sums = {f"n{i}": F.col(f"n{i}") for i in range(k)} | {f"w{i}": F.col(f"w{i}") * factor for i in range(k)}
        if "source_layer" in steps.columns:
            state = state.join(steps.select("node_id", F.col("source_layer").alias("layer")).distinct(), "node_id")
        else:
            state = state.withColumn("layer", F.lit(None).cast("int"))
        for r, table in enumerate(_rounds(written(state, "paths"), steps, ["source"] if part is None else [], sums, None, hub_edges)[1:], 1):
            rows = [F.struct((F.col("source") if part is None else F.lit(part[i])).alias("source"), F.col(f"n{i}").alias("n_paths"), F.col(f"w{i}").alias("weight")) for i in range(k)]
            long = table.select(F.col("node_id").alias("target"), F.explode(F.array(*rows)).alias("r")).where("r.n_paths IS NOT NULL")
            found.append(long.select("r.source", "target", "r.n_paths", F.lit(r + 1).alias("n_nodes"), "r.weight"))
    if not found:
        return asked.limit(0).select("source", "target", F.lit(0).cast("long").alias("n_paths"), F.lit(0).alias("n_nodes"), F.lit(0.0).alias("weight"))
    out = together(found).join(asked, ["source", "target"], "left_semi").groupBy("source", "target")
    return out.agg(F.sum("n_paths").alias("n_paths"), F.min("n_nodes").alias("n_nodes"), F.sum("weight").alias("weight"))


def ancestors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets(target)`` -> (target, node_id) of all nodes from which a target can be reached, itself included."""
    back = edges.select(F.col("target").alias("node_id"), F.col("source"))
    frontier = targets.select("target").distinct().withColumn("node_id", F.col("target"))
    rounds = [frontier]
    for _ in range(TERMINAL):
        step = rounds[-1].join(back, "node_id").select("target", F.col("source").alias("node_id")).distinct()
        rounds.append(written(step, "ancestors"))
    return together(rounds).distinct()


def paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(source, target)`` -> (source, target, path, transmission_weight), one row a path; a node has no path to itself.

    Each step keeps only nodes from which the asked target can still be reached.
    """
    reach = written(ancestors(edges, pairs), "ancestors")
    steps = weighted(edges).select(F.col("source").alias("node_id"), F.col("target").alias("next"), "transmission_factor")
    df = pairs.select("source", "target").distinct().where("source <> target")
    df = df.select("source", "target", F.col("source").alias("node_id"), F.array("source").alias("path"), F.lit(1.0).alias("transmission_weight"))
    found = []
    for _ in range(TERMINAL):
        df = df.join(steps, "node_id").select("source", "target", F.col("next").alias("node_id"), F.concat("path", F.array("next")).alias("path"), (F.col("transmission_weight") * F.col("transmission_factor")).alias("transmission_weight"))
        df = written(df.join(reach, ["target", "node_id"], "left_semi"), "paths")
        found.append(df.where("node_id = target").select("source", "target", "path", "transmission_weight"))
    return together(found)
