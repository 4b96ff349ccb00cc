"""Composite pipelines PL01-PL09: the public end-to-end API."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import finite
from ..functions.text import artefact_key, aspect_name, score_text
from ..lineage import cut, written
from ..operators import dag, graph, labels, metrics, quality, ranking, relational, reports, similarity
from ..sources import sinks
from ..sources.tables import dealt_by

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
# Vocabulary sizes per aspect of the evaluation sets.
TOP_K = {"F": 528, "P": 1024, "C": 528}
ASPECTS = tuple(TOP_K)
TASK_ATOMS = 100_000  # atoms whose pairs one task makes


class Prepared(NamedTuple):
    """Result of :func:`prepare_manifests`."""

    manifest: DataFrame
    vocab: DataFrame
    adjacency: DataFrame
    splits: DataFrame


class EvalSets(NamedTuple):
    """Result of :func:`build_eval_sets`; all tables are keyed by aspect, the last two by set as well."""

    vocab: DataFrame
    priors: DataFrame
    selection: DataFrame
    manifests: DataFrame


class StructureGraphs(NamedTuple):
    """Result of :func:`structure_graphs`."""

    edges: DataFrame
    nodes: DataFrame
    source: DataFrame


def vocabulary_targets(annotations: DataFrame, vocab: DataFrame, adjacency: DataFrame) -> DataFrame:
    """JN05 and GR05 for all aspects at once -> aspect, entry_id, targets: the sorted vocabulary indices of an
    entry's terms, ancestors within the vocabulary included.

    ``annotations`` has ``aspect, entry_id, term``, ``vocab`` ``aspect, term, idx``. A term counts under
    its own aspect; it has one, so the closure along the adjacency needs no aspect.
    """
    known = annotations.join(vocab.select("aspect", "term"), ["aspect", "term"], "left_semi")
    positive = dag.propagate_labels(known, dag.vocab_closure(adjacency))
    indexed = positive.join(vocab.select("aspect", "term", "idx"), "term")
    return indexed.groupBy("aspect", "entry_id").agg(F.sort_array(F.collect_list("idx")).alias("targets"))


def prepare_manifests(
    sequences: DataFrame,
    annotations: DataFrame,
    terms: DataFrame,
    edges: DataFrame,
    aspects: Sequence[str] = ASPECTS,
    ratios: Mapping[str, float] = RATIOS,
    seed: object = 1337,
    top_k: int | Mapping[str, int] | None = None,
    artefacts: DataFrame | None = None,
) -> Prepared:
    """PL01: splits, vocabulary, adjacency and manifest records of all aspects in one plan.

    Everything is keyed by aspect: an aspect has its own entries (those it annotates), split, vocabulary
    and indices; the closure of the ontology is computed once. A record has ``entry_id, split, aspect,
    length, targets`` (sorted vocabulary indices, ancestors included) and the artefact columns of
    ``artefacts``; an entry without its artefact raises.
    """
    held = relational.restrict(annotations, sequences).filter(F.col("aspect").isin(*aspects))
    held = written(held.select("aspect", "entry_id", "term"), "annotations")
    inside = terms.filter(F.col("aspect").isin(*aspects))
    freq = labels.term_frequency(held.join(inside.select("aspect", "term"), ["aspect", "term"], "left_semi"), by_aspect=False)
    members = cut(dag.close_vocabulary(freq, edges, terms, top_k).filter(F.col("aspect").isin(*aspects)))
    vocab = written(labels.vocabulary(members), "vocabulary")
    adjacency = dag.vocab_adjacency(members, edges)
    targets = vocabulary_targets(held, vocab, adjacency)
    lengths = sequences.select("entry_id", F.length("sequence").cast("bigint").alias("length"))
    records = held.select("aspect", "entry_id").distinct().join(lengths, "entry_id").select("entry_id", "length", "aspect")
    splits = ranking.split(records, ratios, seed, ["aspect"])
    if artefacts is not None:
        records = relational.assemble(records, {"artefact": artefacts}, on_missing="error")
    records = records.join(targets, ["aspect", "entry_id"], "left")
    records = records.withColumn("targets", F.coalesce("targets", F.array().cast("array<bigint>")))
    manifest = sinks.manifest_records(records, splits, list(ranking.SPLITS), keys=["aspect"])
    return Prepared(manifest, vocab, adjacency, splits)


def finalize_predictions(
    predictions: DataFrame,
    terms: DataFrame,
    edges: DataFrame,
    propagate: bool = True,
    k: int = 1500,
    floor: float = 0.01,
    vocab_closure: DataFrame | None = None,
) -> DataFrame:
    """PL02: scores of all aspects -> entry_id, term, score, score_text.

    With ``propagate`` ancestors take the best score below them, otherwise only the most specific
    terms stay. ``vocab_closure`` (see :func:`termweave.operators.dag.vocab_closure`) first
    propagates inside the vocabulary, as the scorer's own terms do: the two closures are chained term by term,
    so that scores travel once.
    """
    best = relational.combine_aspects(relational.noise_floor(predictions.select("entry_id", "term", "score"), floor))
    if propagate:
        closure = dag.ancestors(edges, terms)
        if vocab_closure is not None:
            closure = dag.chained(vocab_closure, closure)
        spread = dag.propagate_ontology(best, closure, k)
    else:
        spread = dag.most_specific(best, dag.descendants(edges, terms))
    chosen = ranking.top_predictions(spread, k, floor)
    text = chosen.select("entry_id", "term", "score", score_text(F.col("score")).alias("score_text"))
    return text.filter("score_text IS NOT NULL")


def evaluate(
    scored: DataFrame, n_entries: int, thresholds: Sequence[float] = metrics.DEFAULT_THRESHOLDS, weights: DataFrame | None = None
) -> DataFrame:
    """PL03: every metric per aspect -> aspect, metric, value (non-finite scores count as 0).

    ``scored`` has ``aspect, entry_id, term, score, label``.
    """
    keys = ["aspect"]
    clean = scored.withColumn("score", finite(F.col("score")))
    plain = metrics.fmax(metrics.pr_curve(clean, thresholds, n_entries, keys=keys), keys)
    if weights is None:
        weighed = plain
    else:
        weighed = metrics.fmax(metrics.pr_curve(clean, thresholds, n_entries, weights, keys=keys), keys)
    weighed = weighed.select(
        "aspect", F.col("fmax").alias("ia_fmax"), F.col("precision").alias("ia_precision"), F.col("recall").alias("ia_recall"), F.col("tau").alias("ia_threshold")
    )
    by_term = metrics.term_ranking(clean, n_entries, keys)
    ranked = by_term.groupBy("aspect").agg(F.avg("ap").alias("pr_auc"), F.avg("ap").alias("ap"), F.avg("auc").alias("roc_auc"))
    wide = plain.drop("tau").join(weighed, "aspect").join(ranked, "aspect", "left")
    names = [c for c in wide.columns if c != "aspect"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), finite(F.col(n)).alias("value")) for n in names])
    return wide.select("aspect", F.inline(pairs)).filter("value IS NOT NULL")


def eval_priors(
    train_annotations: DataFrame, terms: DataFrame, edges: DataFrame, top_k: int | Mapping[str, int] | None = TOP_K
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (aspect, term, idx) and sparse prior (aspect, parent, child, weight; each parent's row
    sums to 1) of the evaluation sets, from the frequencies of the training annotations (GR03, GR04)."""
    members = cut(dag.close_vocabulary(labels.term_frequency(train_annotations, by_aspect=False), edges, terms, top_k))
    return written(labels.vocabulary(members), "vocabulary"), dag.vocab_adjacency(members, edges)


def eval_selection(
    train_sequences: DataFrame,
    full_sequences: DataFrame,
    train_annotations: DataFrame,
    full_annotations: DataFrame,
    taxonomy: DataFrame,
    fracs: Sequence[float] | None = None,
    ratios: Mapping[str, float] = RATIOS,
    seed: object = 0,
    aspects: Sequence[str] = ASPECTS,
) -> DataFrame:
    """Six evaluation sets per aspect (annotation frequency and similarity, low/med/high)
    -> aspect, set_name, draw_no, entry_id, tax_id, go_freq_score, similarity_score.

    Sets of one kind come from disjoint buckets, so the pool of already chosen entries only matters
    from the frequency to the similarity sets: two keyed draws replace eighteen. Similarities are
    rounded to 9 digits so that equal sequences tie.
    """
    train_ids = written(train_sequences.select("entry_id").distinct(), "train-ids")
    candidates = relational.not_in(full_sequences, train_ids)
    size = train_ids.agg(ranking.split_size(F.count(F.lit(1)), ratios)).scalar()
    similar = similarity.centroid_similarity(candidates, train_sequences).withColumn("similarity", F.round("similarity", 9))
    freq = labels.term_frequency(train_annotations).withColumnRenamed("n", "_f")
    counted = relational.restrict(full_annotations, candidates).groupBy("aspect", "entry_id", "term").agg(F.count(F.lit(1)).alias("_c"))
    weighed = counted.join(freq, ["aspect", "term"], "left").withColumn("_w", F.log1p(F.coalesce("_f", F.lit(0)).cast("double")))
    means = weighed.groupBy("aspect", "entry_id").agg(F.round(F.sum(F.col("_c") * F.col("_w")) / F.sum("_c"), 9).alias("_s"))
    wide = similar.select("entry_id", "similarity", F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"))
    scores = wide.join(means, ["aspect", "entry_id"], "left").select(
        "aspect", "entry_id", F.coalesce("_s", F.lit(0.0)).alias("frequency"), "similarity"
    )
    scores = written(scores, "eval-scores")
    by_freq = ranking.rank_buckets(scores, "frequency", fracs, ["aspect"]).select("aspect", "bucket", "entry_id")
    by_sim = ranking.rank_buckets(scores, "similarity", fracs, ["aspect"]).select("aspect", "bucket", "entry_id")
    keys = ["aspect", "bucket"]
    first = written(ranking.bucket_sample(by_freq, size, seed=seed, keys=keys), "eval-first")
    liked = by_sim.join(first.select("aspect", "entry_id").distinct(), ["aspect", "entry_id"], "left_semi")
    second = ranking.bucket_sample(by_sim, size, liked, seed=seed, keys=keys)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("aspect", F.concat(F.lit(prefix), F.col("bucket")).alias("set_name"), "draw_no", "entry_id")

    drawn = named(first, "go_freq_").unionByName(named(second, "sim_"))
    joined = relational.with_taxonomy(drawn.join(scores, ["aspect", "entry_id"]), taxonomy)
    return joined.select(
        "aspect", "set_name", "draw_no", "entry_id", "tax_id",
        F.col("frequency").alias("go_freq_score"), F.col("similarity").alias("similarity_score"),
    )


def eval_manifests(selection: DataFrame, annotations: DataFrame, vocab: DataFrame, priors: DataFrame, feature_dim: int) -> DataFrame:
    """Manifest records of all sets -> aspect, set_name, draw_no, entry_id, embedding, prior, targets,
    num_functions, feature_dim.

    Targets are those of :func:`vocabulary_targets`, computed once per selected (aspect, entry) however
    many sets and draws it is in; ``num_functions`` is the size of the aspect's vocabulary.
    """
    chosen = selection.select("aspect", "entry_id").distinct()
    own = annotations.join(chosen, ["aspect", "entry_id"], "left_semi")
    targets = vocabulary_targets(own, vocab, priors)
    sizes = vocab.groupBy("aspect").agg(F.count(F.lit(1)).alias("num_functions"))
    rows = selection.select("aspect", "set_name", "draw_no", "entry_id").join(targets, ["aspect", "entry_id"], "left").join(sizes, "aspect", "left")
    name = F.lower(aspect_name(F.col("aspect")))
    return rows.select(
        "aspect", "set_name", "draw_no", "entry_id", artefact_key(F.col("entry_id")).alias("embedding"),
        F.concat(F.lit("priors/"), name).alias("prior"), F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"),
        F.coalesce("num_functions", F.lit(0)).alias("num_functions"), F.lit(feature_dim).alias("feature_dim"),
    )


def build_eval_sets(
    train_sequences: DataFrame,
    full_sequences: DataFrame,
    train_annotations: DataFrame,
    full_annotations: DataFrame,
    taxonomy: DataFrame,
    terms: DataFrame,
    edges: DataFrame,
    fracs: Sequence[float] | None = None,
    ratios: Mapping[str, float] = RATIOS,
    seed: object = 0,
    aspects: Sequence[str] = ASPECTS,
    top_k: int | Mapping[str, int] | None = TOP_K,
    feature_dim: int = 1280,
) -> EvalSets:
    """PL04: vocabulary, priors, selection and manifests of all 18 evaluation sets, in tables keyed by
    aspect and set; write them with :func:`write_eval_sets`."""
    vocab, priors = eval_priors(train_annotations, terms, edges, top_k)
    selection = eval_selection(
        train_sequences, full_sequences, train_annotations, full_annotations, taxonomy, fracs, ratios, seed, aspects
    )
    selection = written(selection, "eval-selection")
    manifests = written(eval_manifests(selection, full_annotations, vocab, priors, feature_dim), "eval-manifests")
    return EvalSets(vocab, priors, selection, manifests)


def write_eval_sets(sets: EvalSets, train_annotations: DataFrame, path: str) -> None:
    """SC16, SC20, SC21: manifests and selections below aspect and set folders, vocabulary and prior below
    aspect folders, the training terms, and the index of the manifests."""
    sinks.write_term_lists(train_annotations, f"{path}/raw/train_split_cache")
    for name, table in (("priors/terms", sets.vocab), ("priors/adjacency", sets.priors)):
        table.write.mode("overwrite").partitionBy("aspect").parquet(f"{path}/{name}")
    sets.manifests.write.mode("overwrite").partitionBy("aspect", "set_name").json(f"{path}/manifests")
    sinks.write_selection(sets.selection, f"{path}/selections")
    listed = sets.manifests.groupBy("aspect", "set_name").agg(F.count(F.lit(1)).alias("records"), F.any_value("num_functions").alias("num_functions"))
    listed.coalesce(1).write.mode("overwrite").json(f"{path}/manifest_index")


def train_slice(annotations: DataFrame, fraction: float = 0.15, seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """PL05: exact stratified sample of the annotated entries by their set of aspects, and its summary.

    Write the slice with :func:`termweave.sources.sinks.write_subset`.
    """
    chosen = ranking.stratified_sample(labels.stratum_key(annotations), fraction, seed)
    return chosen, labels.stratum_counts(chosen)


def smoke_subset(sequences: DataFrame, annotations: DataFrame, n: int = 64) -> tuple[DataFrame, DataFrame]:
    """PL06: the first n annotated sequences in file order, and their annotations."""
    first = relational.first_annotated(sequences, annotations, n)
    return first, relational.restrict(annotations, first)


def structure_graphs(
    entries: DataFrame,
    fragments: DataFrame,
    atoms: DataFrame,
    fallback_edges: DataFrame,
    fallback_nodes: DataFrame,
    cutoff: float = 10.0,
    k: int = 20,
) -> StructureGraphs:
    """PL07: one residue graph per entry from its structure fragments, or its contact graph.

    ``entries`` has ``entry_id, length``; ``fragments`` one row per fragment with ``accession,
    model_id, start, length``; ``atoms`` ``model_id, pos, x, y, z, conf``. The accession whose
    fragments add up to the length is taken; its fragment graphs are merged in start order. Entries
    without metadata, without a matching accession or with a fragment lacking atoms fall back.
    Confidences of the nodes stay 0-100, edge weights use the per-fragment normalised ones.
    """
    # the few fragments and models that can be used, before anything else is done with fragments and atoms
    picked = written(ranking.pick_isoform(graph.match_isoforms(fragments, entries)).select("entry_id", "accession"), "picked")
    likely = relational.sieved(fragments, picked, ["entry_id", "accession"])
    chosen = written(likely.join(picked, ["entry_id", "accession"]), "fragments")
    likely = relational.sieved(atoms, chosen, ["model_id"])
    atoms = written(likely.join(chosen.select("model_id").distinct(), "model_id", "left_semi"), "atoms")
    # a written table of atoms is so small that a scan would leave their many pairs to a few tasks
    atoms = dealt_by(atoms, "model_id", TASK_ATOMS)
    sizes = atoms.groupBy("model_id").agg(F.count(F.lit(1)).alias("_atoms"))
    sized = chosen.join(sizes, "model_id", "left")
    wrong = F.raise_error(F.concat(F.lit("length mismatch in model "), F.col("model_id")))
    sized = sized.withColumn("model_id", F.when(F.col("_atoms").isNull() | (F.col("_atoms") == F.col("length")), F.col("model_id")).otherwise(wrong))
    complete = sized.groupBy("entry_id").agg(F.min(F.col("_atoms").isNotNull()).alias("file_ok"))
    listed = fragments.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_items"))
    primary = listed.join(picked.select("entry_id", F.lit(True).alias("_m")), "entry_id", "left").join(complete, "entry_id", "left")
    primary = primary.select(
        "entry_id", "n_items", F.coalesce("_m", F.lit(False)).alias("length_ok"), F.coalesce("file_ok", F.lit(False)).alias("file_ok")
    )
    source = written(relational.with_fallback(entries, primary, fallback_nodes), "sources")

    usable = sized.join(source.filter("source = 'primary'").select("entry_id"), "entry_id", "left_semi")
    before = Window.partitionBy("entry_id").orderBy("start", "model_id").rowsBetween(Window.unboundedPreceding, -1)
    # fragments of the one picked isoform: their lengths add up to the entry's own length
    offsets = usable.select("entry_id", "model_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_first"))
    models = atoms.join(usable.select("model_id").distinct(), "model_id", "left_semi").withColumnRenamed("model_id", "entry_id")
    local = graph.coordinate_graph(models, cutoff, k).withColumnRenamed("entry_id", "model_id")
    edges = local.join(offsets, "model_id").select(
        "entry_id", (F.col("src") + F.col("_first")).alias("src"), (F.col("dst") + F.col("_first")).alias("dst"), "weight"
    )
    nodes = atoms.join(offsets, "model_id").select("entry_id", (F.col("pos") + F.col("_first")).alias("pos"), "conf")
    second = source.filter("source = 'secondary'").select("entry_id")
    edges = edges.unionByName(fallback_edges.join(second, "entry_id", "left_semi").select(*edges.columns))
    nodes = nodes.unionByName(fallback_nodes.join(second, "entry_id", "left_semi").select(*nodes.columns))
    return StructureGraphs(edges, nodes, source)


def check_manifests(
    records: DataFrame,
    manifests: DataFrame | None = None,
    configured_width: int | None = None,
    term_prior: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    pair_prior: tuple[DataFrame, DataFrame] | None = None,
    edges: DataFrame | None = None,
    score_terms: tuple[DataFrame, DataFrame] | None = None,
    partitions: tuple[DataFrame, Sequence[str]] | None = None,
    meta: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """PL08: issue rows of all checks over manifests in one table.

    Records are always checked (DQ01-DQ03, DQ06, DQ07). Given the inputs of the check of that name, so
    are term priors (DQ04), pair priors (DQ05), edge lists (DQ08), the vocabulary against scored terms
    (DQ09), expected partitions (DQ10) and manifest metadata (DQ11).
    """
    known = records.select("manifest") if manifests is None else manifests
    parts = [
        quality.check_embeddings(records),
        quality.check_labels(records),
        quality.check_lengths(records),
        quality.check_label_sizes(records, known),
        quality.check_width(records.filter(F.col("embedding").isNotNull()), configured_width),
    ]
    for inputs, check in (
        (term_prior, quality.check_term_prior),
        (pair_prior, quality.check_pair_prior),
        ((edges,) if edges is not None else None, quality.check_edges),
        (score_terms, quality.check_score_terms),
        (partitions, quality.check_partitions),
        (meta, quality.check_meta),
    ):
        if inputs is not None:
            parts.append(check(*inputs))
    return quality.union_issues(parts)


def run_report(
    log: DataFrame, trials: DataFrame, modes: Mapping[str, str], metric: str, loss: str, k: int = 3,
    max_failures: int = 10, target: int = 40,
) -> DataFrame:
    """PL09: best and final values, best epochs, top trials and the stop test in one long table
    -> section, item, metric, value."""
    def rows(df: DataFrame, section: str, item: str, **columns: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in columns.items()])
        prefix = F.concat(F.col("metric"), F.lit("_")) if "metric" in df.columns else F.lit("")
        return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), prefix.alias("_p"), F.inline(pairs)).select(
            "section", "item", F.concat("_p", "name").alias("metric"), "value"
        )

    parts = [
        rows(reports.metric_summary(log, modes), "run", "run_id", best="best", final="final"),
        rows(reports.best_epoch(log, metric, loss), "best_epoch", "run_id", epoch="epoch", value="metric_value", loss="loss"),
        rows(ranking.top_trials(trials, k), "top_trial", "rank", trial="trial_id", value="value"),
        rows(reports.trial_stop(trials, max_failures, target).withColumn("_i", F.lit("all")), "stop", "_i", failed="failed", completed="completed", stop="stop"),
    ]
    return quality.union_issues(parts)
