"""AG01-AG07, JN01-JN10, JN14-JN16, PF01-PF03, PF08, ST05-ST08, WN01, AG08."""

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import dag, graph, labels, order, ranking, relational
from .registry import Inputs, query

TERM_TEXT = "concat('GO:', lpad(CAST(term AS VARCHAR), 7, '0'))"


@query("ag01_terms_per_entry", "annotations", """
SELECT entry_id, string_agg(CAST(term AS VARCHAR), ',' ORDER BY term) AS terms, string_agg(CAST(n AS VARCHAR), ',' ORDER BY term) AS counts
FROM (SELECT entry_id, term, count(*) AS n FROM annotations GROUP BY 1, 2) GROUP BY entry_id""")
def _(t):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return labels.terms_per_entry(t.annotations()).select("entry_id", text("terms"), text("counts"))


@query("ag01_terms_per_entry_by_aspect", "annotations", """
SELECT entry_id, aspect, string_agg(CAST(term AS VARCHAR), ',' ORDER BY term) AS terms
FROM (SELECT DISTINCT entry_id, aspect, term FROM annotations) GROUP BY entry_id, aspect""")
def _(t):
    lists = labels.terms_per_entry(t.annotations(), by_aspect=True)
    return lists.select("entry_id", "aspect", F.array_join(F.transform("terms", lambda x: x.cast("string")), ",").alias("terms"))


@query("ag02_term_frequency", "annotations", "SELECT aspect, term, count(*) AS n FROM annotations GROUP BY 1, 2")
def _(t):
    return labels.term_frequency(t.annotations())


@query("ag02_term_frequency_global", "annotations", "SELECT term, count(*) AS n FROM annotations GROUP BY 1")
def _(t):
    return labels.term_frequency(t.annotations(), by_aspect=False)


_VOC = "SELECT aspect, term, row_number() OVER (PARTITION BY aspect ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT aspect, term FROM annotations)"


@query("ag03_vocabulary", "annotations", f"{_VOC}")
def _(t):
    return labels.vocabulary(t.annotations())


@query("ag04_multi_hot", "annotations", """
SELECT e.entry_id, string_agg(CASE WHEN h.entry_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.idx) AS labels
FROM (SELECT DISTINCT entry_id FROM annotations) e CROSS JOIN voc v LEFT JOIN hits h ON h.entry_id = e.entry_id AND h.idx = v.idx GROUP BY e.entry_id
""", voc="SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM annotations WHERE aspect = 'P')",
    hits="SELECT DISTINCT a.entry_id, v.idx FROM annotations a JOIN voc v ON v.term = a.term")
def _(t):
    vocab = labels.vocabulary(t.annotations()).filter("aspect = 'P'")
    return labels.label_text(labels.side_by_side(labels.label_indices(t.annotations(), vocab)))


@query("ag04_label_indices", "annotations", """
SELECT e.entry_id, CAST((SELECT count(*) FROM voc) AS INT) AS size, coalesce(h.n, 0) AS n_on, coalesce(h.line, '') AS line FROM (SELECT DISTINCT entry_id FROM annotations) e
LEFT JOIN (SELECT entry_id, count(*) AS n, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY idx) AS line FROM hits GROUP BY 1) h ON h.entry_id = e.entry_id
""", voc="SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM annotations WHERE aspect = 'C')",
    hits="SELECT DISTINCT a.entry_id, v.idx FROM annotations a JOIN voc v ON v.term = a.term")
def _(t):
    sparse = labels.label_indices(t.annotations(), labels.vocabulary(t.annotations()).filter("aspect = 'C'"))
    return sparse.select("entry_id", "size", F.size("indices").cast("bigint").alias("n_on"), F.array_join("indices", " ").alias("line"))


_STRATUM = "SELECT entry_id, string_agg(aspect, '' ORDER BY aspect) AS stratum FROM (SELECT DISTINCT entry_id, aspect FROM annotations) GROUP BY entry_id"


@query("ag05_stratum_key", "annotations", """
SELECT o_orderkey AS entry_id, coalesce(s.stratum, 'NA') AS stratum FROM orders LEFT JOIN s ON s.entry_id = o_orderkey""", s=_STRATUM)
def _(t):
    return labels.stratum_key(t.annotations(), t.table("orders").select(F.col("o_orderkey").alias("entry_id")))


@query("ag06_stratum_counts", "annotations", """
SELECT stratum, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM s GROUP BY stratum""", s=_STRATUM)
def _(t):
    return labels.stratum_counts(labels.stratum_key(t.annotations())).withColumn("share", F.round("share", 9))


@query("ag07_frequency_score", "annotations", """
SELECT o_orderkey AS entry_id, round(coalesce(m.s, 0.0), 9) AS score FROM orders LEFT JOIN m ON m.entry_id = o_orderkey
""", fr="SELECT l_partkey AS term, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1",
    m="SELECT entry_id, avg(ln(1 + coalesce(fr.n, 0))) AS s FROM annotations a LEFT JOIN fr ON fr.term = a.term GROUP BY entry_id")
def _(t):
    freq = t.table("lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    entries = t.table("orders").select(F.col("o_orderkey").alias("entry_id"))
    return labels.frequency_score(t.annotations(), freq, entries).withColumn("score", F.round("score", 9))


@query("ag08_row_normalise", "", """
SELECT child, parent, rel, round(w / sum(w) OVER (PARTITION BY parent), 9) AS weight FROM
(SELECT p_partkey AS child, CAST(floor(p_partkey / 4.0) AS BIGINT) AS parent, p_brand AS rel, p_size * 1.0 AS w FROM part)""")
def _(t):
    part = t.table("part").select(
        F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 4.0).cast("bigint").alias("parent"),
        F.col("p_brand").alias("rel"), F.col("p_size").cast("double").alias("weight"),
    )
    return graph.row_normalise(part).withColumn("weight", F.round("weight", 9))


@query("wn01_top_terms", "annotations", """
SELECT aspect, term, n FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term) AS r
FROM (SELECT aspect, term, count(*) AS n FROM annotations GROUP BY 1, 2)) WHERE r <= 50""")
def _(t):
    return ranking.top_terms(labels.term_frequency(t.annotations()), 50)


_ASPECT_TEXT = "CASE l_linenumber WHEN 1 THEN 'cellular component' WHEN 2 THEN 'mfo' WHEN 3 THEN ' BP ' WHEN 4 THEN 'Molecular_Function' WHEN 5 THEN 'b' ELSE lower(l_shipmode) END"


def _aspect_text():
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, "cellular component").when(n == 2, "mfo").when(n == 3, " BP ").when(n == 4, "Molecular_Function")
        .when(n == 5, "b").otherwise(F.lower(F.col("l_returnflag")))
    )


_ASPECT_TEXT = _ASPECT_TEXT.replace("l_shipmode", "l_returnflag")
_KEY = "upper(regexp_replace(raw, '[^A-Za-z]', '', 'g'))"


@query("pf01_normalise_aspect", "", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN {_KEY} IN ('C','CC','CCO','CELLULARCOMPONENT') THEN 'C' WHEN {_KEY} IN ('F','MF','MFO','MOLECULARFUNCTION','M') THEN 'F'
WHEN {_KEY} IN ('P','BP','BPO','BIOLOGICALPROCESS','B') THEN 'P' ELSE raw END AS aspect FROM (SELECT *, {_ASPECT_TEXT} AS raw FROM lineitem)""")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", fx.normalise_aspect(_aspect_text()).alias("aspect"))


_KEY2 = "upper(trim(raw))"


@query("pf02_normalise_aspect_letter", "", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN {_KEY2} IN ('C','CC','CELLULARCOMPONENT') THEN 'C' WHEN {_KEY2} IN ('F','MF','MOLECULARFUNCTION') THEN 'F'
WHEN {_KEY2} IN ('P','BP','BIOLOGICALPROCESS') THEN 'P' ELSE substr({_KEY2}, 1, 1) END AS aspect FROM (SELECT *, {_ASPECT_TEXT} AS raw FROM lineitem)""")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", fx.normalise_aspect_letter(_aspect_text()).alias("aspect"))


@query("pf03_aspect_name", "annotations", """
SELECT entry_id, term, CASE aspect WHEN 'F' THEN 'MF' WHEN 'P' THEN 'BP' WHEN 'C' THEN 'CC' ELSE aspect END AS name, aspect AS code FROM annotations""")
def _(t):
    name = fx.aspect_name(F.col("aspect"))
    return t.annotations().select("entry_id", "term", name.alias("name"), fx.aspect_code(name).alias("code"))


@query("jn01_candidates", "entries train_ids", "SELECT entry_id FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM train_ids)")
def _(t):
    return relational.not_in(t.entries().select("entry_id"), t.train_ids())


_FINISHED = "SELECT o_orderkey AS entry_id FROM orders WHERE o_orderstatus = 'F'"


def _finished(t: Inputs):
    return t.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entry_id"))


@query("jn02_restrict", "annotations", "SELECT entry_id, term, aspect FROM annotations WHERE aspect = 'F' AND entry_id IN (SELECT entry_id FROM fin)", fin=_FINISHED)
def _(t):
    return relational.restrict(t.annotations(), _finished(t), "F")


@query("jn03_only_in", "annotations", "SELECT entry_id, term, aspect FROM annotations WHERE entry_id IN (SELECT entry_id FROM fin)", fin=_FINISHED)
def _(t):
    return relational.only_in(t.annotations(), _finished(t))


@query("jn04_with_taxonomy", "entries taxonomy", "SELECT e.entry_id, coalesce(x.tax_id, '') AS tax_id FROM entries e LEFT JOIN taxonomy x ON x.entry_id = e.entry_id")
def _(t):
    return relational.with_taxonomy(t.entries().select("entry_id"), t.taxonomy())


@query("jn05_project_labels", "annotations", """
SELECT o_orderkey AS entry_id, h.term, h.idx FROM orders LEFT JOIN h ON h.entry_id = o_orderkey
""", voc="SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM annotations WHERE aspect = 'F')",
    h="SELECT DISTINCT a.entry_id, a.term, v.idx FROM annotations a JOIN voc v ON v.term = a.term")
def _(t):
    vocab = labels.vocabulary(t.annotations()).filter("aspect = 'F'")
    return relational.project_labels(t.annotations(), vocab, t.table("orders").select(F.col("o_orderkey").alias("entry_id")))


_TERM_FREQ = "SELECT l_partkey + l_suppkey AS term, count(*) AS n FROM lineitem GROUP BY 1"


def _shifted_freq(t: Inputs):
    return t.table("lineitem").groupBy((F.col("l_partkey") + F.col("l_suppkey")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("jn06_known_terms", "ontology_terms", "SELECT f.term, f.n, o.aspect FROM fq f JOIN ontology_terms o ON o.term = f.term", fq=_TERM_FREQ)
def _(t):
    return relational.split_known_terms(_shifted_freq(t), t.ontology_terms())[0]


@query("jn06_missing_terms", "ontology_terms", "SELECT term, n FROM fq WHERE term NOT IN (SELECT term FROM ontology_terms)", fq=_TERM_FREQ)
def _(t):
    return relational.split_known_terms(_shifted_freq(t), t.ontology_terms())[1]


@query("jn07_reconcile", "entries train_ids", """
SELECT entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM train_ids) THEN 1 ELSE 0 END AS is_cached FROM entries""")
def _(t):
    return relational.reconcile(t.entries(), t.train_ids())


def _structure_sources(t: Inputs):
    """Primary: orders with lines; total decides whether lengths match and the file is there."""
    o, l = t.table("orders"), t.table("lineitem")
    primary = l.groupBy(F.col("l_orderkey").alias("entry_id")).agg(
        F.count_if(F.col("l_quantity") > 10).alias("n_items"), F.max(F.col("l_linenumber") >= 3).alias("length_ok"),
        F.max(F.col("l_returnflag") != "R").alias("file_ok"),
    )
    entries = o.select(F.col("o_orderkey").alias("entry_id"))
    return entries, primary, o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("entry_id"))


@query("jn08_with_fallback", "", """
SELECT o_orderkey AS entry_id, reason, CASE WHEN reason IS NULL THEN 'primary' WHEN o_orderstatus <> 'P' THEN 'secondary' ELSE 'none' END AS source
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN n_items IS NULL THEN 'metadata not found' WHEN n_items = 0 THEN 'empty metadata'
WHEN NOT length_ok THEN 'no length match' WHEN NOT file_ok THEN 'file not found' END AS reason FROM orders LEFT JOIN p ON p.entry_id = o_orderkey)
""", p="SELECT l_orderkey AS entry_id, count(*) FILTER (l_quantity > 10) AS n_items, max(l_linenumber >= 3) AS length_ok, max(l_returnflag <> 'R') AS file_ok FROM lineitem GROUP BY 1")
def _(t):
    return relational.with_fallback(*_structure_sources(t))


@query("jn09_resume", "", """
SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def _(t):
    earlier = t.table("lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("entry_id"))
    return relational.resume(t.table("orders").select(F.col("o_orderkey").alias("entry_id")), earlier)


@query("jn10_first_annotated", "entries taxonomy", """
SELECT entry_id, length(sequence) AS n FROM (SELECT e.*, d.doc_id FROM entries e JOIN documents d ON concat('D', CAST(d.doc_id AS VARCHAR)) = e.entry_id)
WHERE length(sequence) > 0 AND entry_id IN (SELECT entry_id FROM taxonomy) ORDER BY doc_id LIMIT 64""")
def _(t):
    seqs = t.entries().withColumn("ord", F.substring("entry_id", 2, 20).cast("bigint"))
    return relational.first_annotated(seqs, t.taxonomy(), 64).select("entry_id", F.length("sequence").cast("bigint").alias("n"))


_ASM = {
    "embedding": "SELECT vec_id AS entry_id, label FROM embeddings",
    "structure": "SELECT doc_id AS entry_id, quality FROM labels",
}


@query("jn14_assemble", "", """
SELECT d.doc_id AS entry_id, d.n_chars, e.label, s.quality FROM documents d JOIN e ON e.entry_id = d.doc_id JOIN s ON s.entry_id = d.doc_id
""", e=_ASM["embedding"], s=_ASM["structure"])
def _(t):
    entries = t.table("documents").select(F.col("doc_id").alias("entry_id"), "n_chars")
    sources = {
        "embedding": t.table("embeddings").select(F.col("vec_id").alias("entry_id"), "label"),
        "structure": t.table("labels").select(F.col("doc_id").alias("entry_id"), "quality"),
    }
    return relational.assemble(entries, sources)


@query("jn14_assemble_checked", "", """
SELECT d.doc_id AS entry_id, d.n_chars, length(d.text) AS n FROM documents d""")
def _(t):
    entries = t.table("documents").select(F.col("doc_id").alias("entry_id"), "n_chars")
    texts = t.table("documents").select(F.col("doc_id").alias("entry_id"), F.length("text").cast("bigint").alias("n"))
    return relational.assemble(entries, {"text": texts}, on_missing="error")


def _term_batches(t: Inputs):
    ranked = order.global_rank(t.ontology_terms().select("term"), "term", seed=7, out="r")
    return ranked.select(
        F.floor((F.col("r") - 1) / 256).alias("batch_id"), ((F.col("r") - 1) % 256).alias("pos"), F.col("term").alias("entry_id")
    )


@query("jn15_batch_submatrix", "ontology_terms ontology_edges", """
SELECT x.batch_id, x.pos AS i, y.pos AS j, 1.0 AS weight FROM (SELECT DISTINCT child, parent FROM ontology_edges) e
JOIN b x ON x.entry_id = e.child JOIN b y ON y.entry_id = e.parent AND y.batch_id = x.batch_id
""", b="SELECT CAST(floor((r - 1) / 256) AS BIGINT) AS batch_id, (r - 1) % 256 AS pos, term AS entry_id FROM (SELECT term, row_number() OVER (ORDER BY md5(concat(CAST(term AS VARCHAR), '|7')), term) AS r FROM ontology_terms)")
def _(t):
    pairs = t.ontology_edges().select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct().withColumn("weight", F.lit(1.0))
    return relational.batch_submatrix(pairs, _term_batches(t))


@query("jn16_join_truth", "predictions", """
SELECT coalesce(p.entry_id, l.entry_id) AS entry_id, coalesce(p.term, l.term) AS term, coalesce(p.score, 0.0) AS score, CASE WHEN l.term IS NULL THEN 0 ELSE 1 END AS label
FROM (SELECT * FROM predictions WHERE score >= 0.3) p FULL OUTER JOIN l ON l.entry_id = p.entry_id AND l.term = p.term
""", l="SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS term FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    truth = t.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("term"))
    return relational.join_truth(t.predictions().filter("score >= 0.3"), truth)


@query("st05_concat_first", "", """
SELECT entry_id, tag, amount FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY src, tag, amount) AS r FROM
(SELECT 0 AS src, l_orderkey AS entry_id, l_returnflag AS tag, l_quantity AS amount FROM lineitem UNION ALL
 SELECT 1, o_orderkey, o_orderstatus, o_totalprice FROM orders)) WHERE r = 1""")
def _(t):
    first = t.table("lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_returnflag").alias("tag"), F.col("l_quantity").alias("amount"))
    second = t.table("orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderstatus").alias("tag"), F.col("o_totalprice").alias("amount"))
    return relational.concat_first([first, second])


def _returned(t, flag):
    return t.table("lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("entry_id"))


@query("st06_union_distinct", "", "SELECT DISTINCT l_orderkey AS entry_id FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def _(t):
    return relational.union_distinct([_returned(t, "R"), _returned(t, "A")])


@query("st07_intersect_ids", "", "SELECT l_orderkey AS entry_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    return relational.intersect_ids(_returned(t, "R"), _returned(t, "A"))


@query("st08_minus_ids", "", "SELECT l_orderkey AS entry_id FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    return relational.minus_ids(_returned(t, "R"), _returned(t, "A"))


_LEN = "SELECT d.doc_id AS entry_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.n_chars END AS length FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _known_lengths(t: Inputs):
    known = t.table("labels").select("doc_id", F.lit(True).alias("known"))
    return t.table("documents").join(known, "doc_id", "left").select(
        F.col("doc_id").alias("entry_id"), F.when(F.col("known"), F.col("n_chars")).alias("length")
    )


@query("pf08_min_length", "", "SELECT entry_id, length FROM x WHERE length IS NULL OR length >= 200", x=_LEN)
def _(t):
    return relational.min_length(_known_lengths(t), 200)[0]


@query("pf08_min_length_dropped", "", "SELECT count(*) AS dropped FROM x WHERE length < 200", x=_LEN)
def _(t):
    return relational.min_length(_known_lengths(t), 200)[1]


@query("so01_ordered", "vocab", "SELECT aspect, term FROM vocab ORDER BY aspect, term")
def _(t):
    freq = labels.term_frequency(t.annotations(), by_aspect=False)
    return order.ordered(dag.close_vocabulary(freq, t.ontology_edges(), t.ontology_terms(), 100), ["aspect", "term"])
