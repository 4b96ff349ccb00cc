"""PL01-PL09 and SI01."""

from pyspark.sql import functions as F

from ..functions.text import aspect_name
from ..lineage import scratch_path, written
from ..operators import dag, labels, similarity
from ..plans import pipelines
from ..streaming.incremental import incremental_finalize, read_finished
from .metric_queries import MODES, _curve_sql
from .quality_queries import (
    _ALL, _DQ06, _LANGUAGES, _edge_rows, _meta, _pair_prior_inputs, _records, _score_term_inputs, _term_prior_inputs,
)
from .ranking_queries import _QUOTA
from .registry import SQL, Inputs, query
from .text_queries import _CENTRE

_FINAL = "SELECT entry_id, term, score, format('{:.3g}', least(score, 1.0)) AS score_text FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, term) AS r FROM spread WHERE score >= 0.01) WHERE r <= 10"
_NF = "SELECT entry_id, term, max(score) AS score FROM aspect_predictions WHERE score >= 0.01 GROUP BY 1, 2"


def _vocabulary_sql(notes: str, limit: str) -> dict[str, str]:
    """Vocabulary, prior and closure of all aspects from the frequencies of ``notes`` (aspect, term)."""
    return {
        "fq": f"SELECT o.aspect, a.term, count(*) AS n FROM {notes} a JOIN ontology_terms o ON o.term = a.term GROUP BY 1, 2",
        "top": f"SELECT aspect, term FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term) AS r FROM fq) WHERE r <= {limit}",
        "mem": "SELECT aspect, term FROM top UNION SELECT top.aspect, a.ancestor FROM top JOIN anc a ON a.term = top.term",
        "voc": "SELECT aspect, term, row_number() OVER (PARTITION BY aspect ORDER BY term) - 1 AS idx FROM mem",
        "adj": "SELECT DISTINCT m.aspect, e.parent, e.child FROM ontology_edges e JOIN mem m ON m.term = e.child JOIN mem p ON p.term = e.parent AND p.aspect = m.aspect WHERE e.child <> e.parent",
        "cl": "SELECT child AS term, parent AS ancestor FROM adj UNION SELECT cl.term, adj.parent FROM cl JOIN adj ON adj.child = cl.ancestor",
        "own": "SELECT DISTINCT a.aspect, a.entry_id, a.term FROM doc_annotations a JOIN mem ON mem.aspect = a.aspect AND mem.term = a.term",
        "pos": "SELECT * FROM own UNION SELECT own.aspect, own.entry_id, cl.ancestor FROM own JOIN cl ON cl.term = own.term",
        "tgt": "SELECT pos.aspect, entry_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total FROM pos JOIN voc ON voc.aspect = pos.aspect AND voc.term = pos.term GROUP BY 1, 2",
    }


def _targets_summary():
    total = F.aggregate("targets", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.size("targets").cast("bigint").alias("n_targets"), total.alias("total")


@query("pl01_prepare_manifests", "doc_annotations ontology_terms ontology_edges anc entries", """
SELECT s.entry_id, s.aspect, length(e.sequence) AS length, CASE WHEN s.r <= e1 THEN 'train' WHEN s.r <= e2 THEN 'val' ELSE 'test' END AS split,
coalesce(p.n, 0) AS n_targets, coalesce(p.total, 0) AS total FROM ids s JOIN edges x ON x.aspect = s.aspect JOIN entries e ON e.entry_id = s.entry_id
LEFT JOIN tgt p ON p.entry_id = s.entry_id AND p.aspect = s.aspect
""", ann="SELECT a.* FROM doc_annotations a JOIN ontology_terms o ON o.term = a.term AND o.aspect = a.aspect",
    ids="SELECT aspect, entry_id, row_number() OVER (PARTITION BY aspect ORDER BY md5(concat(entry_id, '|1337')), entry_id) AS r FROM (SELECT DISTINCT aspect, entry_id FROM doc_annotations)",
    edges="SELECT aspect, a + CASE WHEN rest >= 1 THEN 1 ELSE 0 END AS e1, a + b + rest AS e2 FROM (SELECT aspect, a, b, n - a - 2 * b AS rest FROM (SELECT aspect, count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS a, CAST(floor(count(*) * 0.1) AS BIGINT) AS b FROM ids GROUP BY 1))",
    **_vocabulary_sql("ann", "200"))
def _(t):
    done = pipelines.prepare_manifests(t.entries(), t.doc_annotations(), t.ontology_terms(), t.ontology_edges(), top_k=200)
    return done.manifest.select("entry_id", "aspect", "length", "split", *_targets_summary())


@query("pl02_finalize_predictions", "anc aspect_predictions", _FINAL, nf=_NF,
       spread="SELECT entry_id, term, max(score) AS score FROM (SELECT * FROM nf UNION ALL SELECT nf.entry_id, anc.ancestor, nf.score FROM nf JOIN anc ON anc.term = nf.term) GROUP BY 1, 2")
def _(t):
    return pipelines.finalize_predictions(t.aspect_predictions(), t.ontology_terms(), t.ontology_edges(), k=10)


@query("pl02_finalize_specific", "descend aspect_predictions", _FINAL, nf=_NF,
       best="SELECT nf.entry_id, d.term, max(nf.score) AS best FROM nf JOIN descend d ON d.descendant = nf.term GROUP BY 1, 2",
       spread="SELECT nf.* FROM nf LEFT JOIN best b ON b.entry_id = nf.entry_id AND b.term = nf.term WHERE nf.term NOT IN (SELECT term FROM descend) OR nf.score > coalesce(b.best, 0)")
def _(t):
    return pipelines.finalize_predictions(t.aspect_predictions(), t.ontology_terms(), t.ontology_edges(), propagate=False, k=10)


@query("pl02_finalize_with_vocabulary", "anc vclose aspect_predictions", _FINAL,
       vp="SELECT entry_id, term, score FROM aspect_predictions UNION ALL SELECT p.entry_id, c.ancestor, p.score FROM aspect_predictions p JOIN vclose c ON c.term = p.term",
       nf="SELECT entry_id, term, max(score) AS score FROM vp WHERE score >= 0.01 GROUP BY 1, 2",
       spread="SELECT entry_id, term, max(score) AS score FROM (SELECT * FROM nf UNION ALL SELECT nf.entry_id, anc.ancestor, nf.score FROM nf JOIN anc ON anc.term = nf.term) GROUP BY 1, 2")
def _(t):
    freq = labels.term_frequency(t.annotations(), by_aspect=False)
    vocab = dag.close_vocabulary(freq, t.ontology_edges(), t.ontology_terms(), 100)
    closure = dag.vocab_closure(dag.vocab_adjacency(vocab, t.ontology_edges()))
    return pipelines.finalize_predictions(t.aspect_predictions(), t.ontology_terms(), t.ontology_edges(), k=10, vocab_closure=closure)


_ASPECTS = "CASE term % 3 WHEN 0 THEN 'MF' WHEN 1 THEN 'BP' ELSE 'CC' END"
_NE = "(SELECT count(DISTINCT l_orderkey) FROM lineitem)"


def _eval_sql() -> dict[str, str]:
    out = {"sa": f"SELECT {_ASPECTS} AS aspect, * FROM scored"}
    for tag, weight, source in (("p", "1", "sa s"), ("i", "coalesce(ia.ia, 0)", "sa s LEFT JOIN ia ON ia.term = s.term")):
        out |= {
            f"{tag}sw": f"SELECT s.*, CAST({weight} AS DOUBLE) AS w FROM {source}",
            f"{tag}tr": f"SELECT aspect, entry_id, sum(w * label) AS tr FROM {tag}sw GROUP BY 1, 2",
            f"{tag}e": f"SELECT s.aspect, tau, s.entry_id, sum(w) AS pr, sum(w * label) AS hit, any_value(tr) AS tr FROM {tag}sw s JOIN {tag}tr x ON x.entry_id = s.entry_id AND x.aspect = s.aspect JOIN (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS tau) ON score >= tau GROUP BY 1, 2, 3",
            f"{tag}c": f"SELECT aspect, tau, sum(hit / pr) FILTER (pr > 0) / count(*) FILTER (pr > 0) AS p, coalesce(sum(hit / tr) FILTER (tr > 0), 0) / {_NE} AS r FROM {tag}e GROUP BY 1, 2",
            f"{tag}b": f"SELECT aspect, 2 * p * r / (p + r) AS f, p, r, tau FROM {tag}c WHERE p + r > 0 QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY 2 * p * r / (p + r) DESC, tau) = 1",
        }
    out |= {
        "cells": f"SELECT aspect, term, score, count(*) AS n, sum(label) AS pos FROM sa GROUP BY 1, 2, 3 UNION ALL SELECT aspect, term, 0.0, {_NE} - count(*), 0 FROM sa GROUP BY 1, 2",
        "cum": "SELECT aspect, term, n, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY term) AS p, sum(n) OVER (PARTITION BY term) AS nn FROM cells WINDOW w AS (PARTITION BY term ORDER BY score DESC)",
        "ap": "SELECT aspect, term, sum(CAST(pos AS DOUBLE) / p * (CAST(cp AS DOUBLE) / cn)) AS v FROM cum WHERE p > 0 GROUP BY 1, 2",
        "auc": "SELECT aspect, term, sum(pos * ((nn - p) - (cn - cp) + 0.5 * (n - pos))) / (any_value(p) * any_value(nn - p)) AS v FROM cum WHERE p > 0 AND nn > p GROUP BY 1, 2",
    }
    return out


@query("pl03_evaluate", "scored ia", """
SELECT aspect, metric, round(value, 9) AS value FROM (
SELECT aspect, unnest(['fmax', 'precision', 'recall']) AS metric, unnest([f, p, r]) AS value FROM pb
UNION ALL SELECT aspect, unnest(['ia_fmax', 'ia_precision', 'ia_recall', 'ia_threshold']), unnest([f, p, r, tau]) FROM ib
UNION ALL SELECT aspect, unnest(['pr_auc', 'ap']), unnest([v, v]) FROM (SELECT aspect, avg(v) AS v FROM ap GROUP BY 1)
UNION ALL SELECT aspect, 'roc_auc', avg(v) FROM auc GROUP BY 1)""", **_eval_sql())
def _(t):
    k = F.col("term") % 3
    scored = t.scored().withColumn("aspect", F.when(k == 0, "MF").when(k == 1, "BP").otherwise("CC"))
    return pipelines.evaluate(scored, t.scored_entries(), weights=t.ia()).withColumn("value", F.round("value", 9))


def _drawn(prefix: str, bk: str, pf: str | None) -> dict[str, str]:
    late = f"CASE WHEN p.entry_id IS NULL THEN 1 ELSE 0 END FROM {bk} b LEFT JOIN {pf} p ON p.aspect = b.aspect AND p.entry_id = b.entry_id" if pf else f"1 FROM {bk} b"
    head, tail = late.split(" FROM ", 1)
    s = prefix
    return {
        f"{s}mk": f"SELECT b.*, {head} AS late FROM {tail}",
        f"{s}rk": f"SELECT *, row_number() OVER (PARTITION BY aspect, bucket, late ORDER BY md5(concat(entry_id, '|0')), entry_id) AS r, count(*) OVER (PARTITION BY aspect, bucket) AS n_all, count(*) FILTER (late = 0) OVER (PARTITION BY aspect, bucket) AS n_pref FROM {s}mk",
        f"{s}pl": f"SELECT *, CASE WHEN late = 0 THEN r ELSE n_pref + r END AS draw_no FROM {s}rk",
        f"{s}dr": f"SELECT aspect, bucket, d AS draw_no, CAST(concat('0x', substr(md5(concat(CAST(d AS VARCHAR), '|0')), 1, 8)) AS BIGINT) % pool + 1 AS r FROM (SELECT g.*, unnest(range(n_pref + 1, (SELECT val FROM vs) + 1)) AS d FROM (SELECT DISTINCT aspect, bucket, n_all, n_pref, CASE WHEN n_all > n_pref THEN n_all - n_pref ELSE n_all END AS pool FROM {s}rk) g WHERE n_all < (SELECT val FROM vs))",
        f"{s}out": f"SELECT aspect, bucket, entry_id, draw_no FROM {s}pl WHERE draw_no <= (SELECT val FROM vs) AND (n_all >= (SELECT val FROM vs) OR late = 0) UNION ALL SELECT d.aspect, d.bucket, p.entry_id, d.draw_no FROM {s}dr d JOIN {s}pl p ON p.aspect = d.aspect AND p.bucket = d.bucket AND p.r = d.r AND (p.late = 1 OR p.n_all = p.n_pref)",
    }


_BUCKET = "SELECT aspect, entry_id, CASE WHEN r <= CAST(floor(n * (1 / 3.0::DOUBLE)) AS BIGINT) THEN 'low' WHEN r <= CAST(floor(n * (1 / 3.0::DOUBLE + 1 / 3.0::DOUBLE)) AS BIGINT) THEN 'med' ELSE 'high' END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY {0}, md5(entry_id), entry_id) AS r, count(*) OVER (PARTITION BY aspect) AS n FROM sc)"


_TOP_K = "CASE aspect WHEN 'P' THEN 1024 ELSE 528 END"
_TRAIN_NOTES = "SELECT a.* FROM doc_annotations a WHERE entry_id IN (SELECT entry_id FROM train_ids)"
_DRAWN = _CENTRE | dict(
    sim="SELECT e.entry_id, round(coalesce(s.v, 0.0), 9) AS similarity FROM entries e LEFT JOIN (SELECT vec.entry_id, sum(vec.w * centre.w) AS v FROM vec JOIN centre ON centre.gram = vec.gram GROUP BY 1) s ON s.entry_id = e.entry_id WHERE e.entry_id NOT IN (SELECT entry_id FROM train_ids)",
    tf="SELECT aspect, term, count(*) AS f FROM doc_annotations WHERE entry_id IN (SELECT entry_id FROM train_ids) GROUP BY 1, 2",
    mean="SELECT a.aspect, a.entry_id, round(avg(ln(1 + coalesce(f, 0))), 9) AS s FROM doc_annotations a LEFT JOIN tf ON tf.aspect = a.aspect AND tf.term = a.term WHERE a.entry_id NOT IN (SELECT entry_id FROM train_ids) GROUP BY 1, 2",
    sc="SELECT a.aspect, sim.entry_id, coalesce(mean.s, 0.0) AS frequency, sim.similarity FROM sim CROSS JOIN (SELECT unnest(['F', 'P', 'C']) AS aspect) a LEFT JOIN mean ON mean.aspect = a.aspect AND mean.entry_id = sim.entry_id",
    vs="SELECT CAST(floor(n * 0.1) AS BIGINT) + CASE WHEN n - CAST(floor(n * 0.8) AS BIGINT) - 2 * CAST(floor(n * 0.1) AS BIGINT) >= 2 THEN 1 ELSE 0 END AS val FROM (SELECT count(*) AS n FROM train_ids)",
    fb=_BUCKET.format("frequency"), sb=_BUCKET.format("similarity"), **_drawn("f", "fb", None),
    fpool="SELECT DISTINCT aspect, entry_id FROM fout", **_drawn("s", "sb", "fpool"),
    sets="SELECT aspect, concat('go_freq_', bucket) AS set_name, draw_no, entry_id FROM fout UNION ALL SELECT aspect, concat('sim_', bucket), draw_no, entry_id FROM sout",
)


def _train_notes(t: Inputs):
    return t.doc_annotations().join(t.train_ids(), "entry_id", "left_semi")


def _selection_inputs(t: Inputs):
    train = t.entries().join(t.train_ids(), "entry_id", "left_semi")
    notes = written(t.doc_annotations(), "annotations")  # read many times
    return train, t.entries(), notes.join(t.train_ids(), "entry_id", "left_semi"), notes, t.taxonomy()


@query("pl04_build_eval_sets", "entries train_ids taxonomy doc_annotations", """
SELECT CASE d.aspect WHEN 'F' THEN 'MF' WHEN 'P' THEN 'BP' ELSE 'CC' END AS aspect, set_name, draw_no, d.entry_id, coalesce(x.tax_id, '') AS tax_id, round(sc.frequency, 8) AS go_freq_score, round(sc.similarity, 7) AS similarity_score FROM
sets d JOIN sc ON sc.aspect = d.aspect AND sc.entry_id = d.entry_id LEFT JOIN taxonomy x ON x.entry_id = d.entry_id
""", **_DRAWN)
def _(t):
    sets = pipelines.eval_selection(*_selection_inputs(t)).withColumn("aspect", aspect_name(F.col("aspect")))
    return sets.withColumn("go_freq_score", F.round("go_freq_score", 8)).withColumn("similarity_score", F.round("similarity_score", 7))


@query("pl04_eval_vocabulary", "doc_annotations train_ids ontology_terms ontology_edges anc", "SELECT aspect, term, idx FROM voc",
       notes=_TRAIN_NOTES, **_vocabulary_sql("notes", _TOP_K))
def _(t):
    return pipelines.eval_priors(_train_notes(t), t.ontology_terms(), t.ontology_edges())[0]


@query("pl04_eval_priors", "doc_annotations train_ids ontology_terms ontology_edges anc",
       "SELECT aspect, parent, child, round(1.0 / count(*) OVER (PARTITION BY aspect, parent), 9) AS weight FROM adj",
       notes=_TRAIN_NOTES, **_vocabulary_sql("notes", _TOP_K))
def _(t):
    return pipelines.eval_priors(_train_notes(t), t.ontology_terms(), t.ontology_edges())[1].withColumn("weight", F.round("weight", 9))


@query("pl04_eval_manifests", "entries train_ids taxonomy doc_annotations ontology_terms ontology_edges anc", """
SELECT d.aspect, set_name, draw_no, d.entry_id, concat(d.entry_id, '_', substr(md5(d.entry_id), 1, 8)) AS embedding,
concat('priors/', CASE d.aspect WHEN 'F' THEN 'mf' WHEN 'P' THEN 'bp' ELSE 'cc' END) AS prior, coalesce(g.n, 0) AS n_targets, coalesce(g.total, 0) AS total, z.n AS num_functions, 64 AS feature_dim
FROM sets d LEFT JOIN tgt g ON g.aspect = d.aspect AND g.entry_id = d.entry_id JOIN (SELECT aspect, count(*) AS n FROM voc GROUP BY 1) z ON z.aspect = d.aspect
""", notes=_TRAIN_NOTES, **_vocabulary_sql("notes", _TOP_K), **_DRAWN)
def _(t):
    path = scratch_path(t.spark, "eval-sets")
    inputs = _selection_inputs(t)
    sets = pipelines.build_eval_sets(*inputs, t.ontology_terms(), t.ontology_edges(), feature_dim=64)
    pipelines.write_eval_sets(sets, inputs[2], path)
    kinds = "draw_no BIGINT, entry_id STRING, embedding STRING, prior STRING, targets ARRAY<BIGINT>, num_functions BIGINT, feature_dim INT, aspect STRING, set_name STRING"
    return t.spark.read.schema(kinds).json(f"{path}/manifests").select(
        "aspect", "set_name", "draw_no", "entry_id", "embedding", "prior", *_targets_summary(), "num_functions", "feature_dim"
    )


@query("pl05_train_slice", "annotations", """
SELECT s.entry_id, s.stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(entry_id AS VARCHAR), '|0')), entry_id) AS r FROM st) s JOIN more m ON m.stratum = s.stratum WHERE s.r <= m.q""", **_QUOTA)
def _(t):
    return pipelines.train_slice(t.annotations())[0]


@query("pl05_train_slice_summary", "annotations", "SELECT stratum, CAST(q AS BIGINT) AS n, round(q / CAST(sum(q) OVER () AS DOUBLE), 9) AS share FROM more WHERE q > 0", **_QUOTA)
def _(t):
    return pipelines.train_slice(t.annotations())[1].withColumn("share", F.round("share", 9))


@query("pl06_smoke_subset", "entries doc_annotations", """
SELECT a.entry_id, a.term, a.aspect FROM doc_annotations a WHERE entry_id IN (SELECT entry_id FROM entries WHERE length(sequence) > 0 AND entry_id IN (SELECT entry_id FROM doc_annotations)
ORDER BY CAST(substr(entry_id, 2) AS BIGINT) LIMIT 64)""")
def _(t):
    seqs = t.entries().withColumn("ord", F.substring("entry_id", 2, 20).cast("bigint"))
    return pipelines.smoke_subset(seqs, t.doc_annotations())[1]


def _model():
    """A line number repeats inside an order, so the part and the price in cents tell lines apart."""
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return F.concat_ws("/", *parts, F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))


def _fragment_atoms(t: Inputs):
    """Every fragment unrolled to one atom row per residue on a bent chain."""
    length = F.col("l_quantity").cast("int") % 12 + 1
    rows = t.table("lineitem").filter("l_discount > 0").select(_model().alias("model_id"), "l_quantity", "l_discount", F.explode(F.sequence(F.lit(0), length - 1)).alias("pos"))
    pos = F.col("pos").cast("bigint")
    return rows.select(
        "model_id", pos.alias("pos"), (3.8 * pos).alias("x"), ((F.col("l_quantity") * pos) % 7).alias("y"), ((F.col("l_quantity") * pos * pos) % 5).alias("z"),
        ((F.col("l_discount") * 1000 + pos * 7) % 100).alias("conf"),
    )


_PL07 = {
    "fr": "SELECT l_orderkey AS entry_id, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_suppkey % 3 AS VARCHAR)) AS accession, concat_ws('/', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS model_id, 10 * l_linenumber AS start, CAST(l_quantity AS INT) % 12 + 1 AS length, l_discount > 0 AS has FROM lineitem",
    "tot": "SELECT entry_id, accession, sum(length) AS total FROM fr GROUP BY 1, 2",
    "mt": "SELECT tot.entry_id, min(accession) AS accession FROM tot JOIN expected_lengths x ON x.entry_id = tot.entry_id AND x.length = tot.total GROUP BY 1",
    "pk": "SELECT fr.*, sum(fr.length) OVER (PARTITION BY fr.entry_id ORDER BY start, model_id) - fr.length AS off FROM fr JOIN mt ON mt.entry_id = fr.entry_id AND mt.accession = fr.accession",
    "st": "SELECT e.entry_id, CASE WHEN a.n IS NULL THEN 'metadata not found' WHEN mt.entry_id IS NULL THEN 'no length match' WHEN NOT f.ok THEN 'file not found' END AS reason FROM expected_lengths e LEFT JOIN (SELECT entry_id, count(*) AS n FROM fr GROUP BY 1) a ON a.entry_id = e.entry_id LEFT JOIN mt ON mt.entry_id = e.entry_id LEFT JOIN (SELECT entry_id, min(has) AS ok FROM pk GROUP BY 1) f ON f.entry_id = e.entry_id",
    "src": "SELECT st.entry_id, reason, CASE WHEN reason IS NULL THEN 'primary' WHEN s.entry_id IS NOT NULL THEN 'secondary' ELSE 'none' END AS source FROM st LEFT JOIN (SELECT DISTINCT entry_id FROM contacts) s ON s.entry_id = st.entry_id",
    "atm": "SELECT entry_id, model_id, off, pos, 3.8::DOUBLE * pos AS x, (q * pos) % 7 AS y, (q * pos * pos) % 5 AS z, (l_discount * 1000 + pos * 7) % 100 AS conf FROM (SELECT pk.entry_id, pk.model_id, CAST(pk.off AS BIGINT) AS off, l_quantity AS q, l_discount, unnest(range(pk.length)) AS pos FROM pk JOIN src ON src.entry_id = pk.entry_id AND src.source = 'primary' JOIN lineitem ON concat_ws('/', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) = pk.model_id)",
    "nc": "SELECT *, greatest(0.0, least(1.0, CASE WHEN max(conf) OVER (PARTITION BY model_id) > 1 THEN conf / 100.0 ELSE conf END)) AS c FROM atm",
    "prs": "SELECT a.entry_id, a.model_id, a.off, a.pos AS i, b.pos AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist, least(a.c, b.c) AS w FROM nc a JOIN nc b ON a.model_id = b.model_id AND a.pos <> b.pos",
    "nn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, i ORDER BY dist, j) AS r FROM prs WHERE dist <= 10) WHERE r <= 3",
}


def _structures(t: Inputs):
    frags = t.table("lineitem").select(
        F.col("l_orderkey").alias("entry_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_suppkey") % 3).cast("string")).alias("accession"),
        _model().alias("model_id"), (10 * F.col("l_linenumber")).alias("start"), (F.col("l_quantity").cast("int") % 12 + 1).alias("length"),
    )
    contacts = t.contacts().select("entry_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("p").alias("weight"))
    nodes = t.contacts().groupBy("entry_id", F.col("i").alias("pos")).agg(F.max("p").alias("conf"))
    return pipelines.structure_graphs(t.expected_lengths(), frags, _fragment_atoms(t), contacts, nodes, k=4)


@query("pl07_structure_sources", "expected_lengths contacts", "SELECT entry_id, source, reason FROM src", **_PL07)
def _(t):
    return _structures(t).source


@query("pl07_structure_edges", "expected_lengths contacts", """
SELECT entry_id, i + off AS src, j + off AS dst, round(w, 9) AS weight FROM nn UNION SELECT entry_id, j + off, i + off, round(w, 9) FROM nn
UNION ALL SELECT entry_id, i, j, round(p, 9) FROM contacts WHERE entry_id IN (SELECT entry_id FROM src WHERE source = 'secondary')""", **_PL07)
def _(t):
    return _structures(t).edges.withColumn("weight", F.round("weight", 9))


@query("pl07_structure_nodes", "expected_lengths contacts", """
SELECT entry_id, pos + off AS pos, round(conf, 7) AS conf FROM atm
UNION ALL SELECT entry_id, i, round(max(p), 7) FROM contacts WHERE entry_id IN (SELECT entry_id FROM src WHERE source = 'secondary') GROUP BY 1, 2""", **_PL07)
def _(t):
    return _structures(t).nodes.withColumn("conf", F.round("conf", 7))


_OTHER_CHECKS = ("dq04_check_term_prior", "dq05_check_pair_prior", "dq08_check_edges", "dq09_check_score_terms", "dq10_check_partitions", "dq11_check_meta")


@query("pl08_check_manifests", "", f"""
SELECT * FROM iss UNION ALL SELECT * FROM ({_DQ06}) UNION ALL
SELECT manifest, '', 'width_not_configured', '16..16' FROM (SELECT DISTINCT manifest FROM rec WHERE fault <> 'missing')"""
       + "".join(f" UNION ALL SELECT manifest, record, code, detail FROM ({SQL[name]})" for name in _OTHER_CHECKS), **_ALL)
def _(t):
    records = _records(t)
    known = records.select("manifest").unionByName(t.table("nation").select(F.col("n_name").alias("manifest")))
    return pipelines.check_manifests(
        records,
        known,
        configured_width=64,
        term_prior=_term_prior_inputs(t),
        pair_prior=_pair_prior_inputs(t),
        edges=_edge_rows(t),
        score_terms=_score_term_inputs(t),
        partitions=(t.table("documents").select(F.col("lang").alias("manifest")), _LANGUAGES),
        meta=(_meta(t), "MF"),
    )


@query("pl09_run_report", "trials", """
SELECT 'run' AS section, CAST(run_id AS VARCHAR) AS item, metric || unnest(['_best', '_final']) AS metric, unnest([CASE WHEN metric IN ('error', 'signup') THEN lo ELSE hi END, fin]) AS value
FROM (SELECT run_id, metric, min(value) AS lo, max(value) AS hi, arg_max(value, step) AS fin FROM ep GROUP BY 1, 2)
UNION ALL SELECT 'best_epoch', CAST(run_id AS VARCHAR), unnest(['epoch', 'value', 'loss']), unnest([CAST(step AS DOUBLE), m, l]) FROM
 (SELECT a.run_id, a.step, a.value AS m, b.value AS l FROM ep a JOIN ep b ON b.run_id = a.run_id AND b.step = a.step WHERE a.metric = 'purchase' AND b.metric = 'error' QUALIFY row_number() OVER (PARTITION BY a.run_id ORDER BY a.value DESC, a.step) = 1)
UNION ALL SELECT 'top_trial', CAST(r AS VARCHAR), unnest(['trial', 'value']), unnest([CAST(trial_id AS DOUBLE), value]) FROM
 (SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, trial_id) AS r, trial_id, value FROM trials WHERE state = 'COMPLETE' ORDER BY 1 LIMIT 3)
UNION ALL SELECT 'stop', 'all', unnest(['failed', 'completed', 'stop']), unnest([CAST(f AS DOUBLE), CAST(c AS DOUBLE), CASE WHEN f >= 10 OR c >= 40 THEN 1.0 ELSE 0.0 END]) FROM
 (SELECT count(*) FILTER (state = 'FAIL') AS f, count(*) FILTER (state = 'COMPLETE') AS c FROM trials)
""", ep="SELECT user_id AS run_id, event_id // 500 AS step, event_type AS metric, max(value) AS value FROM events GROUP BY 1, 2, 3")
def _(t):
    from .metric_queries import _epochs

    return pipelines.run_report(_epochs(t), t.trials(), MODES, "purchase", "error")


@query("si01_incremental_finalize", "anc aspect_predictions", _FINAL, nf=_NF,
       spread="SELECT entry_id, term, max(score) AS score FROM (SELECT * FROM nf UNION ALL SELECT nf.entry_id, anc.ancestor, nf.score FROM nf JOIN anc ON anc.term = nf.term) GROUP BY 1, 2")
def _(t):
    base = scratch_path(t.spark, "stream")
    schema = "entry_id BIGINT, term BIGINT, score DOUBLE"
    rows = t.aspect_predictions().select("entry_id", "term", "score")
    rows.repartition(3).write.parquet(f"{base}/in")  # an entry's rows come in several batches
    closure = dag.ancestors(t.ontology_edges(), t.ontology_terms())
    incremental_finalize(t.spark, f"{base}/in", f"{base}/out", f"{base}/state", closure, schema, max_files=1)
    return read_finished(t.spark, f"{base}/out", k=10)
