"""Residue graphs: construction, normalisation, aggregation, diffusion (GR11-GR16, ST01-ST04, AG08,
AG16-AG19, AG24, AG25, JN11, PF12, PF21, WN12). Edges are ``entry_id, src, dst, weight``; nodes are
``entry_id, pos`` with a confidence ``conf`` or a vector ``vec``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, finite
from ..lineage import cut
from .ranking import nearest, top_contacts
from .relational import mutual as keep_mutual

WIDTH = 64  # elements of a vector that are summed as columns at once


def vector_sum(df: DataFrame, keys: Sequence[str], vec: Column, dim: int | None = None, out: str = "vec") -> DataFrame:
    """Element-wise sum of arrays per group, with map-side combine.

    A vector is cut into chunks of ``WIDTH`` elements and a chunk's elements are columns of one
    aggregation, whatever the width. The vectors of a group must have one width (``dim`` when it is
    given); a NULL vector is left out.
    """
    keys = list(keys)
    held = df.select(*keys, vec.alias("_v")).withColumn("_n", F.size("_v")).filter("_v IS NOT NULL")
    chunk = F.sequence(F.lit(0), F.greatest(F.floor((F.col("_n") - 1) / WIDTH), F.lit(0)).cast("int"))
    chunks = held.select("*", F.explode(chunk).alias("_c"))
    element = lambda i: F.get(F.col("_v"), F.col("_c") * WIDTH + i).cast("double")
    sums = [F.sum(element(i)).alias(f"_s{i}") for i in range(WIDTH)]
    parts = chunks.groupBy(*keys, "_c").agg(*sums, F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    row = F.struct("_c", F.array(*[F.col(f"_s{i}") for i in range(WIDTH)]).alias("_x"))
    packed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_p"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    sound = (F.col("_lo") == F.col("_hi")) & (F.lit(True) if dim is None else F.col("_hi") == dim)
    wrong = F.raise_error(F.concat(F.lit(f"vectors of {dim or 'one'} elements expected, found "), F.col("_lo"), F.lit(" to "), F.col("_hi")))
    whole = F.when(sound, F.slice(F.flatten("_p._x"), F.lit(1), F.col("_hi"))).otherwise(wrong.cast("array<double>"))
    return packed.select(*keys, whole.alias(out))


def pairs_within(coords: DataFrame, cutoff: float, carry: Sequence[str] = ()) -> DataFrame:
    """JN11: ordered residue pairs of one entry at most ``cutoff`` apart -> entry_id, i, j, dist.

    The distance join becomes a grouping by grid cells of side ``cutoff``: a residue offers itself to its own
    cell and to the half of the neighbouring cells that meets every unordered pair once; whom a cell holds meets whom it was
    offered. A grouping, unlike a join, leaves rows that were dealt by entry where they are.
    ``carry`` columns come along as ``<name>_i`` and ``<name>_j``.
    """
    axes = ("x", "y", "z")
    cell = [F.floor(F.col(a) / F.lit(float(cutoff))).cast("bigint").alias(f"h{a}") for a in axes]
    half = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, axes)]) for o in half])
    residue = F.struct("pos", *axes, *carry).alias("_a")
    held = coords.select("entry_id", residue, *cell).dropna(subset=["entry_id", "hx", "hy", "hz"])
    offered = held.select("entry_id", "_a", "hx", "hy", "hz", F.explode(offsets).alias("_o")).select(
        "entry_id", "_a", *[(F.col(f"h{a}") - F.col(f"_o.d{a}")).alias(f"c{a}") for a in axes],
        ((F.col("_o.dx") == 0) & (F.col("_o.dy") == 0) & (F.col("_o.dz") == 0)).alias("_same"),
    )
    cells = offered.groupBy("entry_id", "cx", "cy", "cz").agg(
        F.collect_list(F.when(F.col("_same"), F.col("_a"))).alias("_i"), F.collect_list(F.struct("_same", "_a")).alias("_j")
    )
    met = cells.filter(F.size("_i") > 0).select("entry_id", F.explode("_i").alias("_i"), "_j").select("entry_id", "_i", F.inline("_j"))
    of = {"i": F.col("_i"), "j": F.col("_a")}
    square = sum((of["i"][a] - of["j"][a]) * (of["i"][a] - of["j"][a]) for a in axes)
    met = met.withColumn("dist", F.sqrt(square))
    met = met.filter((F.col("dist") <= cutoff) & (~F.col("_same") | (of["i"]["pos"] < of["j"]["pos"])))

    def view(a: str, b: str) -> Column:
        swapped = [of[a][c].alias(f"{c}_i") for c in carry] + [of[b][c].alias(f"{c}_j") for c in carry]
        return F.struct(of[a]["pos"].alias("i"), of[b]["pos"].alias("j"), "dist", *swapped)

    return met.select("entry_id", F.inline(F.array(view("i", "j"), view("j", "i"))))


def normalise_confidence(df: DataFrame, by: str = "entry_id", col: str = "conf") -> DataFrame:
    """PF12: NaN/Inf to 0; when the group's maximum exceeds 1 divide all by 100; clamp to [0, 1]."""
    clean = df.withColumn(col, finite(F.col(col)))
    peak = clean.groupBy(by).agg(F.max(col).alias("_m"))
    scaled = F.when(F.col("_m") > 1, F.col(col) / 100.0).otherwise(F.col(col))
    return clean.join(peak, by).withColumn(col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).select(*df.columns)


def symmetrise_union(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """ST01: (i, j) union (j, i)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    both = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    turned = edges.select(*rest, F.explode(both).alias("_e"))
    return turned.select(*rest, F.col("_e.a").alias(a), F.col("_e.b").alias(b)).distinct().select(*edges.columns)


def symmetrise_mean(contacts: DataFrame, a: str = "i", b: str = "j", w: str = "p") -> DataFrame:
    """ST02: half the sum of both directions, a missing direction counts 0.

    Both directions meet under the ordered pair, so each contact travels once; the result is mirrored afterwards.
    """
    rest = [c for c in contacts.columns if c not in (a, b, w)]
    forward = F.col(a).isNull() | (F.col(a) <= F.col(b))
    low, high = F.when(forward, F.col(a)).otherwise(F.col(b)), F.when(forward, F.col(b)).otherwise(F.col(a))
    met = contacts.select(*rest, low.alias("_lo"), high.alias("_hi"), w).groupBy(*rest, "_lo", "_hi").agg(F.sum(w).alias("_s"))
    own = F.col("_lo").eqNullSafe(F.col("_hi"))
    pair = lambda x, y: F.struct(F.col(x).alias(a), F.col(y).alias(b))
    both = F.when(own, F.array(pair("_lo", "_hi"))).otherwise(F.array(pair("_lo", "_hi"), pair("_hi", "_lo")))
    half = F.when(own, F.col("_s")).otherwise(F.col("_s") / 2).alias(w)
    return met.select(*rest, half, F.inline(both)).select(*contacts.columns)


def unit_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ST03: graphs with any self edge get 1 added to those; others get a unit self edge per node."""
    loops = edges.groupBy("entry_id").agg(F.max((F.col("src") == F.col("dst")).cast("int")).alias("_has"))
    raised = edges.withColumn("weight", F.col("weight") + F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0))
    bare = nodes.join(loops.filter("_has = 1"), "entry_id", "left_anti")
    added = bare.select("entry_id", F.col("pos").alias("src"), F.col("pos").alias("dst"), F.lit(1.0).alias("weight"))
    return raised.select("entry_id", "src", "dst", "weight").unionByName(added)


def confidence_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ST04: existing self edges replaced by one per node weighted with its confidence."""
    loops = nodes.select("entry_id", F.col("pos").alias("src"), F.col("pos").alias("dst"), F.col("conf").alias("weight"))
    return edges.filter(F.col("src") != F.col("dst")).select("entry_id", "src", "dst", "weight").unionByName(loops)


def row_normalise(edges: DataFrame, by: Sequence[str] = ("parent",), weight: str = "weight") -> DataFrame:
    """AG08: weights divided by their row sum; rows without mass stay as they are."""
    sums = edges.groupBy(*by).agg(F.sum(weight).alias("_t"))
    scaled = F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(F.col(weight))
    return edges.join(sums, list(by)).withColumn(weight, scaled).select(*edges.columns)


def symmetric_normalise(edges: DataFrame, eps: float = 1e-6) -> DataFrame:
    """AG18: ``w / sqrt(d_i d_j)`` with row degrees floored at ``eps``."""
    degree = edges.groupBy("entry_id", F.col("src").alias("_n")).agg(F.sum("weight").alias("_d"))
    left = degree.withColumnRenamed("_n", "src").withColumnRenamed("_d", "_di")
    right = degree.withColumnRenamed("_n", "dst").withColumnRenamed("_d", "_dj")
    joined = edges.join(left, ["entry_id", "src"], "left").join(right, ["entry_id", "dst"], "left")
    di = F.greatest(F.coalesce("_di", F.lit(0.0)), F.lit(eps))
    dj = F.greatest(F.coalesce("_dj", F.lit(0.0)), F.lit(eps))
    return joined.select("entry_id", "src", "dst", (F.col("weight") / F.sqrt(di * dj)).alias("weight"))


def neighbour_sum(edges: DataFrame, nodes: DataFrame, dim: int | None = None) -> DataFrame:
    """AG19: one hop, ``out[i] = sum_j w_ij x_j`` -> entry_id, pos, vec; nodes without edges get zeros."""
    sources = nodes.select("entry_id", F.col("pos").alias("dst"), "vec")
    sent = edges.select("entry_id", "src", "dst", "weight").join(sources, ["entry_id", "dst"])
    scaled = F.transform("vec", lambda x: x.cast("double") * F.col("weight"))
    summed = vector_sum(sent, ["entry_id", "src"], scaled, dim, "_out").withColumnRenamed("src", "pos")
    zeros = F.transform("vec", lambda x: F.lit(0.0))
    return nodes.join(summed, ["entry_id", "pos"], "left").select("entry_id", "pos", F.coalesce("_out", zeros).alias("vec"))


def pool(residues: DataFrame, how: str = "mean", dim: int | None = None) -> DataFrame:
    """AG16: residue vectors of an entry to one: mean, masked_mean (column ``mask``), or the first."""
    if how == "first":
        return residues.groupBy("entry_id").agg(F.min_by("vec", "pos").alias("vec"))
    if how not in ("mean", "masked_mean"):
        raise ValueError(f"unknown reduction {how!r}")
    flag = F.lit(1.0) if how == "mean" else F.col("mask").cast("double")
    widened = F.concat(F.transform("vec", lambda x: x.cast("double") * flag), F.array(flag))
    sums = vector_sum(residues, ["entry_id"], widened, None if dim is None else dim + 1, "_v")
    count = F.greatest(F.element_at("_v", -1), F.lit(1.0))
    body = F.slice(F.col("_v"), F.lit(1), F.size("_v") - 1)
    return sums.select("entry_id", F.transform(body, lambda x: x / count).alias("vec"))


def softmax_pool(residues: DataFrame, weights: Sequence[float], dim: int | None = None) -> DataFrame:
    """AG17: softmax-weighted mean by a scoring vector; masked residues are left out, all masked gives 0."""
    score = dot(F.col("vec"), F.array(*[F.lit(float(w)) for w in weights]))
    live = (F.col("mask") > 0) if "mask" in residues.columns else F.lit(True)
    scored = residues.withColumn("_s", F.when(live, score))
    peak = scored.groupBy("entry_id").agg(F.max("_s").alias("_m"))
    mass = scored.join(peak, "entry_id").withColumn("_e", F.coalesce(F.exp(F.col("_s") - F.col("_m")), F.lit(0.0)))
    widened = F.concat(F.transform("vec", lambda x: x.cast("double") * F.col("_e")), F.array("_e"))
    sums = vector_sum(mass, ["entry_id"], widened, None if dim is None else dim + 1, "_v")
    total = F.element_at("_v", -1)
    body = F.slice(F.col("_v"), F.lit(1), F.size("_v") - 1)
    return sums.select("entry_id", F.transform(body, lambda x: F.when(total > 0, x / total).otherwise(0.0)).alias("vec"))


def mean_contact(contacts: DataFrame, lengths: DataFrame) -> DataFrame:
    """AG24: mean contact per residue over all L columns (absent pairs are 0) -> entry_id, pos, conf."""
    sums = contacts.groupBy("entry_id", F.col("i").alias("pos")).agg(F.sum("p").alias("_t"))
    slots = lengths.filter("length > 0").select(
        "entry_id", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length").cast("bigint") - 1)).alias("pos")
    )
    return slots.join(sums, ["entry_id", "pos"], "left").select(
        "entry_id", "pos", (F.coalesce("_t", F.lit(0.0)) / F.col("length")).alias("conf")
    )


def match_isoforms(fragments: DataFrame, lengths: DataFrame) -> DataFrame:
    """AG25: accessions whose fragment lengths add up to the expected length -> entry_id, accession, total."""
    totals = fragments.groupBy("entry_id", "accession").agg(F.sum("length").alias("total"))
    held = totals.join(lengths.select("entry_id", F.col("length").alias("_expected")), "entry_id")
    return held.filter(F.col("total") == F.col("_expected")).select("entry_id", "accession", "total")


def drop_band(df: DataFrame, band: int, a: str = "i", b: str = "j") -> DataFrame:
    """PF21: drop pairs with ``abs(i - j) <= band``, the diagonal included."""
    return df.filter(F.abs(F.col(a) - F.col(b)) > band)


def node_offsets(nodes: DataFrame, batches: DataFrame) -> DataFrame:
    """WN12: first node number of every entry inside its batch (``node_splits``).

    A batch holds a fixed number of entries, so the running sum is over a bounded group.
    """
    sizes = nodes.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    placed = batches.select("batch_id", "pos", "entry_id").join(sizes, "entry_id", "left").fillna(0, ["n_nodes"])
    before = Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("first_node", F.coalesce(F.sum("n_nodes").over(before), F.lit(0)))


def merge_graphs(edges: DataFrame, nodes: DataFrame, batches: DataFrame) -> DataFrame:
    """WN12: block-diagonal merge of the graphs of a batch -> batch_id, src, dst, weight."""
    offsets = node_offsets(nodes, batches).select("batch_id", "entry_id", "first_node")
    moved = edges.join(offsets, "entry_id")
    return moved.select(
        "batch_id", (F.col("src") + F.col("first_node")).alias("src"), (F.col("dst") + F.col("first_node")).alias("dst"), "weight"
    )


def stochastic_prior(edges: DataFrame, nodes: DataFrame, backward: bool = False, eps: float = 1e-6) -> DataFrame:
    """GR11: adjacency plus identity, NaN to 0, floored at ``eps``, rows scaled to sum 1.

    Absent pairs also hold ``eps``; they stay implicit: every stored row carries ``background``, the
    weight of each absent pair of its row. ``backward`` adds ``S[r, c] / colsum[r]`` and its
    background as two more columns.
    """
    loops = nodes.select("entry_id", F.col("pos").alias("src"), F.col("pos").alias("dst"), F.lit(1.0).alias("weight"))
    stored = edges.select("entry_id", "src", "dst", "weight").unionByName(loops)
    stored = stored.groupBy("entry_id", "src", "dst").agg(F.sum("weight").alias("weight"))
    stored = stored.withColumn("weight", F.greatest(finite(F.col("weight")), F.lit(eps)))
    sizes = nodes.groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n"))

    def sums(end: str, out: str) -> DataFrame:
        found = stored.groupBy("entry_id", F.col(end).alias("src")).agg(F.sum("weight").alias("_s"), F.count(F.lit(1)).alias("_c"))
        return found.join(sizes, "entry_id").select(
            "entry_id", "src", (F.col("_s") + F.lit(eps) * (F.col("_n") - F.col("_c"))).alias(out)
        )

    out = stored.join(sums("src", "_row"), ["entry_id", "src"])
    columns = ["entry_id", "src", "dst", (F.col("weight") / F.col("_row")).alias("weight"), (F.lit(eps) / F.col("_row")).alias("background")]
    if backward:
        out = out.join(sums("dst", "_col"), ["entry_id", "src"])
        columns += [(F.col("weight") / F.col("_col")).alias("backward"), (F.lit(eps) / F.col("_col")).alias("backward_background")]
    return out.select(*columns)


def diffuse(edges: DataFrame, nodes: DataFrame, steps: int, dim: int | None = None) -> DataFrame:
    """GR12: ``steps`` rounds of ``x = W x`` over the node vectors -> entry_id, pos, vec.

    With a ``background`` column (see :func:`stochastic_prior`) absent pairs count too, through the
    graph's total vector instead of through rows.
    """
    state = nodes.select("entry_id", "pos", "vec")
    dense = "background" in edges.columns
    if dense:
        base = edges.groupBy("entry_id", F.col("src").alias("pos")).agg(F.first("background").alias("_bg"))
        moved = edges.select("entry_id", "src", "dst", (F.col("weight") - F.col("background")).alias("weight"))
    else:
        moved = edges
    for step in range(steps):
        nxt = neighbour_sum(moved, state, dim)
        if dense:
            totals = vector_sum(state, ["entry_id"], F.col("vec"), dim, "_total")
            held = nxt.join(totals, "entry_id").join(base, ["entry_id", "pos"], "left")
            nxt = held.select("entry_id", "pos", F.zip_with("vec", "_total", lambda a, t: a + t * F.coalesce("_bg", F.lit(0.0))).alias("vec"))
        state = cut(nxt) if step + 1 < steps else nxt
    return state


def coordinate_graph(coords: DataFrame, cutoff: float = 10.0, k: int = 20, dense: bool = False) -> DataFrame:
    """GR13: neighbours within the cutoff, at most k per node (self counted), made symmetric;
    weight is the smaller normalised confidence. The dense form also has each node's confidence on
    the diagonal."""
    clean = normalise_confidence(coords)
    pairs = nearest(pairs_within(clean, cutoff, carry=["conf"]), k)
    edges = pairs.select(
        "entry_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.least("conf_i", "conf_j").alias("weight")
    )
    both = symmetrise_union(edges)
    return confidence_loops(both, clean) if dense else both


def contact_graph(
    contacts: DataFrame,
    lengths: DataFrame,
    k: int = 30,
    min_prob: float = 0.0,
    band: int = 0,
    symmetrise: bool = True,
    mutual: bool = False,
) -> DataFrame:
    """GR14: contact probabilities to a sparse graph -> entry_id, i, j, p."""
    graph = symmetrise_mean(contacts) if symmetrise else contacts
    graph = drop_band(graph, band)
    if min_prob > 0:
        graph = graph.filter(F.col("p") >= min_prob)
    kept = top_contacts(graph, k, lengths)
    return keep_mutual(kept) if mutual else kept


def fit_graph(edges: DataFrame, nodes: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR15: crop or pad graphs to given lengths: edges beyond are dropped, missing confidences are 0.
    An entry without a graph gets an empty one."""
    held = edges.join(lengths.select("entry_id", "length"), "entry_id")
    cropped = held.filter((F.col("src") < F.col("length")) & (F.col("dst") < F.col("length"))).select(*edges.columns)
    slots = lengths.filter("length > 0").select(
        "entry_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length").cast("bigint") - 1)).alias("pos")
    )
    fitted = slots.join(nodes.select("entry_id", "pos", "conf"), ["entry_id", "pos"], "left").fillna(0.0, ["conf"])
    return cropped, fitted


def mask_nodes(edges: DataFrame, nodes: DataFrame, eps: float = 1e-12) -> DataFrame:
    """GR16: rows of invalid nodes become identity rows, then all rows of the graph are rescaled.

    Columns of invalid nodes stay. Graphs without an invalid node are returned as they are.
    ``nodes`` has ``entry_id, pos, valid`` (0/1).
    """
    invalid = nodes.filter(F.col("valid") == 0)
    touched = invalid.select("entry_id").distinct()
    loops = invalid.select("entry_id", F.col("pos").alias("src"), F.col("pos").alias("dst"), F.lit(1.0).alias("weight"))
    rows = edges.select("entry_id", "src", "dst", "weight")
    untouched = rows.join(touched, "entry_id", "left_anti")
    kept = rows.join(touched, "entry_id", "left_semi").join(
        invalid.select("entry_id", F.col("pos").alias("src")), ["entry_id", "src"], "left_anti"
    )
    changed = kept.unionByName(loops)
    sums = changed.groupBy("entry_id", "src").agg(F.sum("weight").alias("_t"))
    scaled = changed.join(sums, ["entry_id", "src"]).select(
        "entry_id", "src", "dst", (F.col("weight") / F.greatest(F.col("_t"), F.lit(eps))).alias("weight")
    )
    return untouched.unionByName(scaled)
