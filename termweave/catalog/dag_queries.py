"""GR01-GR10 and the prediction post-processing around them."""

from pyspark.sql import functions as F

from ..functions.text import score_text
from ..operators import dag, labels, ranking, relational
from .registry import Inputs, query

TOP_K = 100


def _anc(t: Inputs):
    return dag.ancestors(t.ontology_edges(), t.ontology_terms())


def _freq(t: Inputs):
    return labels.term_frequency(t.annotations(), by_aspect=False)


def _vocab(t: Inputs):
    return dag.close_vocabulary(_freq(t), t.ontology_edges(), t.ontology_terms(), TOP_K)


def _adjacency(t: Inputs):
    return dag.vocab_adjacency(_vocab(t), t.ontology_edges())


@query("gr01_ancestors", "anc", "SELECT term, ancestor FROM anc")
def _(t):
    return _anc(t)


@query("gr01_ancestors_all_aspects", "reach", "SELECT term, ancestor FROM reach")
def _(t):
    return dag.ancestors(t.ontology_edges(), t.ontology_terms(), same_aspect=False)


@query("gr02_descendants", "descend", "SELECT term, descendant FROM descend")
def _(t):
    return dag.descendants(t.ontology_edges(), t.ontology_terms())


@query("gr03_close_vocabulary", "vocab", "SELECT aspect, term FROM vocab")
def _(t):
    return _vocab(t)


@query("gr04_vocab_adjacency", "adjacency", "SELECT aspect, parent, child, round(weight, 9) AS weight FROM adjacency")
def _(t):
    return _adjacency(t).withColumn("weight", F.round("weight", 9))


@query("gr05_propagate_labels", "vclose annotations vocab", """
SELECT entry_id, term FROM own UNION SELECT o.entry_id, c.ancestor AS term FROM own o JOIN vclose c ON c.term = o.term
""", own="SELECT DISTINCT a.entry_id, a.term FROM annotations a JOIN vocab v ON v.term = a.term")
def _(t):
    vocab = _vocab(t)
    held = t.annotations().join(vocab.select("term"), "term", "left_semi")
    closure = dag.vocab_closure(dag.vocab_adjacency(vocab, t.ontology_edges()))
    return dag.propagate_labels(held, closure)


@query("gr06_propagate_scores", "vclose predictions vocab", """
SELECT entry_id, term, max(score) AS score FROM (SELECT entry_id, term, score FROM own UNION ALL
SELECT o.entry_id, c.ancestor, o.score FROM own o JOIN vclose c ON c.term = o.term) GROUP BY entry_id, term
""", own="SELECT p.* FROM predictions p JOIN (SELECT DISTINCT term FROM vocab) v ON v.term = p.term")
def _(t):
    vocab = _vocab(t)
    held = t.predictions().join(vocab.select("term"), "term", "left_semi")
    closure = dag.vocab_closure(dag.vocab_adjacency(vocab, t.ontology_edges()))
    return dag.propagate_scores(held, closure)


@query("gr07_propagate_targets", "anc", """
SELECT entry_id, term, CAST(max(label) AS INT) AS label FROM (SELECT entry_id, term, label FROM own UNION ALL
SELECT o.entry_id, c.ancestor, 1 FROM own o JOIN anc c ON c.term = o.term WHERE o.label > 0) GROUP BY entry_id, term
""", own="SELECT l_orderkey AS entry_id, l_partkey AS term, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY 1, 2")
def _(t):
    own = t.table("lineitem").groupBy(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("term")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("label")
    )
    return dag.propagate_targets(own, _anc(t))


_GR08 = """SELECT entry_id, term, max(score) AS score FROM (SELECT entry_id, term, score FROM predictions UNION ALL
SELECT p.entry_id, a.ancestor, p.score FROM predictions p JOIN anc a ON a.term = p.term) GROUP BY entry_id, term"""


@query("gr08_propagate_ontology", "anc predictions", _GR08)
def _(t):
    return dag.propagate_ontology(t.predictions(), _anc(t))


@query("gr09_most_specific", "descend predictions", """
SELECT p.entry_id, p.term, p.score FROM predictions p LEFT JOIN best b ON b.entry_id = p.entry_id AND b.term = p.term
WHERE p.term NOT IN (SELECT term FROM descend) OR p.score > coalesce(b.best, 0)
""", best="SELECT p.entry_id, d.term, max(p.score) AS best FROM predictions p JOIN descend d ON d.descendant = p.term GROUP BY 1, 2")
def _(t):
    return dag.most_specific(t.predictions(), dag.descendants(t.ontology_edges(), t.ontology_terms()))


@query("gr10_parents", "adjacency", "SELECT aspect, child AS term, parent FROM adjacency WHERE weight > 0")
def _(t):
    return dag.parents(_adjacency(t))


@query("wn05_top_predictions", "predictions", """
SELECT entry_id, term, score FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, term) AS r
FROM predictions WHERE score >= 0.1) WHERE r <= 3""")
def _(t):
    return ranking.top_predictions(t.predictions(), k=3, floor=0.1)


@query("pf09_noise_floor", "", """
SELECT l_orderkey AS entry_id, l_linenumber AS term, least(l_quantity * 1.1 / 50.0, 1.0) AS score
FROM lineitem WHERE l_quantity * 1.1 / 50.0 >= 0.1""")
def _(t):
    scores = t.table("lineitem").select(
        F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("term"), (F.col("l_quantity") * 1.1 / 50.0).alias("score")
    )
    return relational.noise_floor(scores, 0.1)


@query("pf10_score_text", "", """
SELECT l_orderkey AS entry_id, l_linenumber AS line,
CASE WHEN x <= 0 THEN NULL ELSE format('{:.3g}', least(x, 1.0)) END AS score_text
FROM (SELECT *, l_extendedprice / 100000.0 * l_discount * l_tax AS x FROM lineitem)""")
def _(t):
    x = F.col("l_extendedprice") / 100000.0 * F.col("l_discount") * F.col("l_tax")
    return t.table("lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("line"), score_text(x).alias("score_text"))


@query("ag23_combine_aspects", "aspect_predictions", "SELECT entry_id, term, max(score) AS score FROM aspect_predictions GROUP BY entry_id, term")
def _(t):
    return relational.combine_aspects(t.aspect_predictions())
