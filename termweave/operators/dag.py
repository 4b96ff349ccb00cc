"""Ontology (DAG) operators GR01-GR10: closures and everything propagated along them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import shuffled, written
from .ranking import top_terms

LEVELS = 32  # levels that a vocabulary climbs one by one


def reach(edges: DataFrame) -> DataFrame:
    """All (term, ancestor) pairs of a DAG given ``child, parent`` rows.

    Path doubling over a frontier: the pairs found last are joined with all pairs so far, so a DAG of
    depth d needs about log2(d) rounds and a pair is extended once. Pairs that end at a root (the
    hottest ancestors) are marked and never shuffled to meet a partner. Every round is written as
    Parquet to the shared folder; only the number of its pairs reaches the driver.
    """
    links = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct()
    inner = links.select(F.col("term").alias("ancestor")).distinct().withColumn("_up", F.lit(True))
    fresh = written(links.join(shuffled(inner), "ancestor", "left").select("term", "ancestor", F.coalesce("_up", F.lit(False)).alias("_up")), "closure")
    pairs = fresh
    while fresh.count():
        onward = pairs.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("_up").alias("_on"))
        longer = fresh.filter("_up").drop("_up").join(shuffled(onward), "ancestor").select(
            "term", F.col("_next").alias("ancestor"), F.col("_on").alias("_up")
        )
        fresh = written(longer.distinct().join(shuffled(pairs.select("term", "ancestor")), ["term", "ancestor"], "left_anti"), "closure")
        pairs = pairs.unionByName(fresh)
    return pairs.select("term", "ancestor")


def ancestors(edges: DataFrame, terms: DataFrame, same_aspect: bool = True) -> DataFrame:
    """GR01: reachable parents. The walk passes through nodes of other aspects but emits only
    nodes of the term's own aspect; parents missing from ``terms`` stop the walk."""
    pairs = reach(_walkable(edges, terms))
    if not same_aspect:
        return pairs
    return _same_aspect(pairs, terms, "term", "ancestor")


def _walkable(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges between known terms."""
    known = shuffled(terms.select("term"))
    return edges.join(known.withColumnRenamed("term", "parent"), "parent", "left_semi").join(
        known.withColumnRenamed("term", "child"), "child", "left_semi"
    )


def _same_aspect(pairs: DataFrame, terms: DataFrame, a: str, b: str) -> DataFrame:
    left = terms.select(F.col("term").alias(a), F.col("aspect").alias("_aa"))
    right = terms.select(F.col("term").alias(b), F.col("aspect").alias("_ab"))
    joined = pairs.join(shuffled(left), a).join(shuffled(right), b)
    return joined.filter(F.col("_aa") == F.col("_ab")).select(a, b)


def descendants(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """GR02: reachable children over edges whose two ends share a (non-null) aspect."""
    inside = _same_aspect(edges.select("child", "parent").distinct(), terms, "child", "parent")
    return reach(inside).select(F.col("ancestor").alias("term"), F.col("term").alias("descendant"))


def close_vocabulary(
    frequencies: DataFrame,
    edges: DataFrame,
    terms: DataFrame,
    top_k: int | Mapping[str, int] | None,
    closure: DataFrame | None = None,
) -> DataFrame:
    """GR03: per aspect the ``top_k`` most frequent known terms and their same-aspect ancestors.

    ``frequencies`` has ``term, n``; the aspect is the ontology's. ``top_k`` may differ by aspect. Without a
    ``closure`` the chosen terms climb level by level, so only what lies above them is looked at.
    """
    known = frequencies.select("term", "n").join(shuffled(terms), "term")
    chosen = top_terms(known, top_k).select("aspect", "term")
    if closure is None:
        return _climbed(chosen, edges, terms)
    above = chosen.join(closure, "term").select("aspect", F.col("ancestor").alias("term"))
    return chosen.union(above).distinct()


def _climbed(chosen: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """The chosen ``aspect, term`` rows and their same-aspect ancestors, reached through terms of any aspect.

    A level is a join of the terms found last with the edges; there are at most as many rows as terms for each
    aspect. What lies above ``LEVELS`` levels comes from the closure.
    """
    links = written(_walkable(edges, terms).select("child", "parent").distinct(), "links")
    first = written(chosen.distinct(), "climbed")
    fresh = seen = first.filter("aspect IS NOT NULL")
    for _ in range(LEVELS):
        up = fresh.join(links, F.col("term") == F.col("child")).select("aspect", F.col("parent").alias("term")).distinct()
        fresh = written(up.join(seen, ["aspect", "term"], "left_anti"), "climbed")
        if not fresh.limit(1).count():
            break
        seen = seen.unionByName(fresh)
    else:
        far = fresh.join(reach(links), "term").select("aspect", F.col("ancestor").alias("term"))
        seen = seen.unionByName(far)
    return first.union(seen.join(shuffled(terms.select("aspect", "term")), ["aspect", "term"], "left_semi")).distinct()


def vocab_adjacency(vocab: DataFrame, edges: DataFrame) -> DataFrame:
    """GR04: parent-to-child edges inside the vocabulary, no self edge, each parent's row sums to 1."""
    members = shuffled(vocab.select("aspect", "term").distinct())
    inside = (
        edges.select("child", "parent")
        .distinct()
        .filter(F.col("child") != F.col("parent"))
        .join(members.withColumnRenamed("term", "child"), "child")
        .join(members.withColumnRenamed("term", "parent"), ["aspect", "parent"])
    )
    fan = inside.groupBy("aspect", "parent").agg(F.count(F.lit(1)).alias("_n"))
    return inside.join(fan, ["aspect", "parent"]).select(
        "aspect", "parent", "child", (F.lit(1.0) / F.col("_n")).alias("weight")
    )


def parents(adjacency: DataFrame) -> DataFrame:
    """GR10: direct parents of every term, from the positive entries of the adjacency."""
    return adjacency.filter(F.col("weight") > 0).select("aspect", F.col("child").alias("term"), "parent")


def vocab_closure(adjacency: DataFrame) -> DataFrame:
    """Ancestor pairs along the vocabulary adjacency."""
    return reach(adjacency.filter(F.col("weight") > 0).select("child", "parent"))


def chained(first: DataFrame, then: DataFrame) -> DataFrame:
    """Ancestors by ``first``, by ``then``, and by ``then`` of those by ``first``."""
    onward = then.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("_next"))
    both = first.join(onward, "ancestor").select("term", F.col("_next").alias("ancestor"))
    return first.select("term", "ancestor").union(then.select("term", "ancestor")).union(both).distinct()


def _above(closure: DataFrame) -> DataFrame:
    """term, _up: all ancestors of a term as one array."""
    # a struct, as the list would drop a NULL
    listed = closure.groupBy("term").agg(F.collect_list(F.struct("ancestor")).alias("_up"))
    return listed.select("term", F.col("_up.ancestor").alias("_up"))


def _with_ancestors(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """``rows`` with the array ``_up`` of their term's ancestors, dealt by entry.

    The arrays travel, not a row for each ancestor; what an entry's rows say about one term meets inside the
    entry, so that nothing is shuffled or hashed once for each (entry, ancestor).
    """
    held = rows.join(_above(closure), "term", "left")
    none = F.array().cast(_above(closure).schema["_up"].dataType)
    return held.withColumn("_up", F.coalesce("_up", none)).repartition("entry_id")


def _largest(rows: DataFrame, pairs: Callable[[Column], Column], name: str, k: int | None = None) -> DataFrame:
    """Largest value of each term of an entry -> entry_id, term and the value as ``name``.

    ``pairs`` gives the array of (term, value) structs of one element of the rows' struct ``_s``; they are
    sorted inside the entry. With ``k`` only the first k terms by (-value, term) stay.
    """
    packed = rows.groupBy("entry_id").agg(F.collect_list("_s").alias("_s"))
    ordered = packed.select("entry_id", F.sort_array(F.flatten(F.transform("_s", pairs)), asc=False).alias("_p"))
    first = lambda x, i: (i == 0) | ~x["term"].eqNullSafe(F.get("_p", i - 1)["term"])
    kept = ordered.select("entry_id", F.filter("_p", first).alias("_p"))
    if k is not None:
        best = F.slice(F.sort_array(F.transform("_p", lambda x: F.struct((-x["value"]).alias("value"), x["term"].alias("term")))), 1, k)
        kept = kept.select("entry_id", F.transform(best, lambda x: F.struct(x["term"].alias("term"), (-x["value"]).alias("value"))).alias("_p"))
    return kept.select("entry_id", F.inline("_p")).withColumnRenamed("value", name)


def propagate_labels(labels: DataFrame, closure: DataFrame) -> DataFrame:
    """GR05: every vocabulary ancestor of a positive term becomes positive."""
    own = _with_ancestors(labels.select("entry_id", "term").distinct(), closure)
    rows = own.select("entry_id", F.concat(F.array("term"), "_up").alias("_t"))
    sets = rows.groupBy("entry_id").agg(F.collect_list("_t").alias("_t"))
    return sets.select("entry_id", F.explode(F.array_distinct(F.flatten("_t"))).alias("term"))


def propagate_scores(scores: DataFrame, closure: DataFrame, k: int | None = None) -> DataFrame:
    """GR06/GR08: every ancestor gets at least the largest score below it, also terms absent before.

    One join with the closure replaces the fixpoint. Which ancestors count is decided by the
    closure: the vocabulary's (GR06) or the whole ontology's within an aspect (GR08).

    With ``k`` only the k best of an entry by (-score, term) are returned. A score then travels with the k
    smallest of its terms alone: any other has k terms before it that score at least as much.
    """
    own = _with_ancestors(scores.select("entry_id", "term", "score"), closure)
    terms = F.concat(F.array("term"), "_up")
    if k is not None:
        terms = F.slice(F.sort_array(F.array_distinct(terms)), 1, k)
    rows = own.select("entry_id", F.struct("score", terms.alias("terms")).alias("_s"))

    def pairs(s: Column) -> Column:
        return F.transform(s["terms"], lambda t: F.struct(t.alias("term"), s["score"].alias("value")))

    return _largest(rows, pairs, "score", k)


def propagate_targets(targets: DataFrame, closure: DataFrame) -> DataFrame:
    """GR07: 0/1 targets; an ancestor of a positive target is positive."""
    own = _with_ancestors(targets.select("entry_id", "term", "label"), closure)
    above = F.when(F.col("label") > 0, F.col("_up")).otherwise(F.slice("_up", 1, 0))
    rows = own.select("entry_id", F.struct("term", "label", above.alias("above")).alias("_s"))

    def pairs(s: Column) -> Column:
        positive = F.transform(s["above"], lambda t: F.struct(t.alias("term"), F.lit(1).alias("value")))
        return F.concat(F.array(F.struct(s["term"].alias("term"), s["label"].alias("value"))), positive)

    return _largest(rows, pairs, "label")


def propagate_ontology(scores: DataFrame, closure: DataFrame, k: int | None = None) -> DataFrame:
    """GR08: propagation over the whole ontology; ``closure`` comes from :func:`ancestors`."""
    return propagate_scores(scores, closure, k)


def most_specific(scores: DataFrame, below: DataFrame) -> DataFrame:
    """GR09: keep a term unless a scored descendant reaches its score.

    ``below`` comes from :func:`descendants`. Absent descendants count as 0, so a term with
    descendants needs a positive score. An entry's scores meet inside the entry: a score goes on only to
    those ancestors that the entry scores, too.
    """
    up = below.select(F.inline(F.array(
        F.struct(F.col("descendant").alias("term"), F.col("term").alias("_top"), F.lit(False).alias("_inner")),
        F.struct("term", F.lit(None).cast(below.schema["term"].dataType).alias("_top"), F.lit(True).alias("_inner")),
    )))
    known = up.groupBy("term").agg(F.collect_list("_top").alias("_up"), F.max("_inner").alias("_inner"))
    dealt = scores.select("entry_id", "term", "score").join(known, "term", "left").repartition("entry_id")
    scored = F.collect_set("term").over(Window.partitionBy("entry_id"))
    met = dealt.withColumn("_up", F.array_intersect("_up", scored))
    none = F.array().cast(known.schema["_up"].dataType)
    own = F.struct("term", F.lit(True).alias("_own"), "score")
    tops = F.transform(F.coalesce("_up", none), lambda t: F.struct(t.alias("term"), F.lit(False).alias("_own"), F.col("score")))
    rows = met.select("entry_id", "_inner", F.inline(F.concat(F.array(own), tops)))
    best = F.max(F.when(~F.col("_own"), F.col("score"))).over(Window.partitionBy("entry_id", "term"))
    judged = rows.withColumn("_best", best).filter("_own")
    floor = F.greatest(F.coalesce(F.col("_best"), F.lit(0.0)), F.lit(0.0))
    outer = ~F.coalesce("_inner", F.lit(False))
    return judged.filter(outer | (F.col("score") > floor)).select("entry_id", "term", "score")
