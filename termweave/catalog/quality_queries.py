"""DQ01-DQ11, PF07."""

from pyspark.sql import functions as F

from ..operators import quality
from .registry import Inputs, query

WIDTH = 16
# Records: each vector cut into rows of 16, with faults injected by id, so every check has hits.
_REC = f"""SELECT concat('m', CAST(label % 3 AS VARCHAR)) AS manifest, CAST(vec_id AS VARCHAR) AS record, vec_id, label,
CASE WHEN vec_id % 41 = 0 THEN 'missing' WHEN vec_id % 53 = 0 THEN 'ragged' WHEN vec_id % 50 = 0 THEN 'nan' WHEN vec_id % 70 = 0 THEN 'short' ELSE 'good' END AS fault,
CASE WHEN vec_id % 61 = 0 THEN 'none' WHEN vec_id % 67 = 0 THEN 'nan' WHEN label = 4 THEN 'long' ELSE 'good' END AS lfault FROM embeddings"""


def _records(t: Inputs):
    v = F.col("vec_id")
    fault = F.when(v % 41 == 0, "missing").when(v % 53 == 0, "ragged").when(v % 50 == 0, "nan").when(v % 70 == 0, "short").otherwise("good")
    lfault = F.when(v % 61 == 0, "none").when(v % 67 == 0, "nan").when(F.col("label") == 4, "long").otherwise("good")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = F.array(*[F.slice("w", 1 + WIDTH * i, WIDTH) for i in range(4)])
    embedding = (
        F.when(F.col("fault") == "ragged", F.array(F.slice("w", 1, WIDTH), F.slice("w", 1, WIDTH - 1)))
        .when(F.col("fault") == "nan", F.array(F.array(F.lit(float("nan")), *[F.lit(0.0)] * (WIDTH - 1))))
        .when(F.col("fault") == "short", F.slice(rows, 1, 3))
        .when(F.col("fault") == "good", rows)
    )
    labels = (
        F.when(F.col("lfault") == "nan", F.array(F.lit(1.0), F.lit(float("inf")), F.lit(0.0)))
        .when(F.col("lfault") == "long", F.array(*[F.lit(0.0)] * 4))
        .when(F.col("lfault") == "good", F.array(*[F.lit(1.0)] * 3))
    )
    lengths = F.when(v % 71 == 0, F.array(F.lit(4), F.lit(4))).otherwise(F.array(F.lit(4))).cast("array<bigint>")
    held = t.table("embeddings").select(
        F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("manifest"), v.cast("string").alias("record"), "vec_id", "label",
        wide.alias("w"), fault.alias("fault"), lfault.alias("lfault"),
    )
    return held.select("manifest", "record", "vec_id", embedding.alias("embedding"), labels.alias("labels"), lengths.alias("lengths"))


_DQ01 = """SELECT manifest, record, CASE fault WHEN 'missing' THEN 'embedding_missing' WHEN 'ragged' THEN 'embedding_not_2d' ELSE 'embedding_nonfinite' END AS code, '' AS detail
FROM rec WHERE fault IN ('missing', 'ragged', 'nan')"""
_DQ02 = "SELECT manifest, record, CASE lfault WHEN 'none' THEN 'labels_missing' ELSE 'labels_nonfinite' END AS code, '' AS detail FROM rec WHERE lfault IN ('none', 'nan')"
_DQ03 = """SELECT manifest, record, 'lengths_shape' AS code, '2' AS detail FROM rec WHERE vec_id % 71 = 0
UNION ALL SELECT manifest, record, 'length_mismatch', concat(CASE fault WHEN 'ragged' THEN '2' WHEN 'nan' THEN '1' ELSE '3' END, ' vs 4') FROM rec WHERE vec_id % 71 <> 0 AND fault IN ('ragged', 'nan', 'short')"""
_DQ06 = """SELECT manifest, '' AS record, 'label_sizes_differ' AS code, concat(CAST(min(s) AS VARCHAR), '..', CAST(max(s) AS VARCHAR)) AS detail
FROM (SELECT manifest, CASE WHEN lfault = 'long' THEN 4 ELSE 3 END AS s FROM rec WHERE lfault <> 'none') GROUP BY manifest HAVING count(DISTINCT s) > 1
UNION ALL SELECT n_name, '', 'manifest_empty', '' FROM nation"""


@query("dq01_check_embeddings", "", _DQ01, rec=_REC)
def _(t):
    return quality.check_embeddings(_records(t))


@query("dq02_check_labels", "", _DQ02, rec=_REC)
def _(t):
    return quality.check_labels(_records(t))


@query("dq03_check_lengths", "", _DQ03, rec=_REC)
def _(t):
    return quality.check_lengths(_records(t))


def _term_prior(t: Inputs):
    weight = F.when(F.col("p_size") == 7, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return t.table("part").select(
        F.col("p_brand").alias("manifest"), (F.col("p_partkey") % 83).alias("parent"), (F.col("p_partkey") % 79).alias("child"), weight.alias("weight")
    )


@query("dq04_check_term_prior", "", """
SELECT manifest, '' AS record, 'term_prior_not_square' AS code, CAST(o AS VARCHAR) AS detail FROM pr WHERE o > 0
UNION ALL SELECT manifest, '', 'term_prior_nonfinite', CAST(b AS VARCHAR) FROM pr WHERE b > 0
UNION ALL SELECT manifest, '', 'term_prior_size', concat(CAST(n AS VARCHAR), ' vs ', CAST(label_size AS VARCHAR)) FROM pr WHERE n <> label_size
""", vz="SELECT p_brand AS manifest, count(*) AS n FROM part GROUP BY 1", lz="SELECT p_brand AS manifest, count(DISTINCT p_partkey) - CASE WHEN max(p_size) >= 50 THEN 1 ELSE 0 END AS label_size FROM part GROUP BY 1",
    pr="SELECT p_brand AS manifest, count(*) FILTER (greatest(p_partkey % 83, p_partkey % 79) >= n) AS o, count(*) FILTER (p_size = 7) AS b, any_value(n) AS n, any_value(label_size) AS label_size FROM part JOIN vz ON vz.manifest = p_brand JOIN lz ON lz.manifest = p_brand GROUP BY p_brand")
def _(t):
    return quality.check_term_prior(*_term_prior_inputs(t))


def _term_prior_inputs(t: Inputs):
    part = t.table("part")
    vocab = part.select(F.col("p_brand").alias("manifest"), F.col("p_partkey").alias("idx"))
    sizes = part.groupBy(F.col("p_brand").alias("manifest")).agg(
        (F.count_distinct("p_partkey") - F.when(F.max("p_size") >= 50, 1).otherwise(0)).alias("label_size")
    )
    return _term_prior(t), vocab, sizes


@query("dq05_check_pair_prior", "", """
SELECT manifest, '' AS record, 'pair_prior_not_square' AS code, CAST(o AS VARCHAR) AS detail FROM pr WHERE o > 0
UNION ALL SELECT manifest, '', 'pair_prior_nonfinite', CAST(b AS VARCHAR) FROM pr WHERE b > 0
UNION ALL SELECT c_mktsegment, CAST(c_custkey AS VARCHAR), 'pair_index_out_of_bounds', CAST(c_custkey AS VARCHAR) FROM customer JOIN sz ON sz.manifest = c_mktsegment WHERE c_custkey >= n
""", sz="SELECT c_mktsegment AS manifest, count(*) AS n FROM customer GROUP BY 1",
    pr="SELECT c_mktsegment AS manifest, count(*) FILTER (greatest(o_orderkey % 307, o_custkey % 311) >= n) AS o, count(*) FILTER (o_totalprice < 2000) AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN sz ON sz.manifest = c_mktsegment GROUP BY 1")
def _(t):
    return quality.check_pair_prior(*_pair_prior_inputs(t))


def _pair_prior_inputs(t: Inputs):
    customers = t.table("customer")
    weight = F.when(F.col("o_totalprice") < 2000, F.lit(float("inf"))).otherwise(F.lit(1.0))
    pairs = t.table("orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("manifest"), (F.col("o_orderkey") % 307).alias("i"), (F.col("o_custkey") % 311).alias("j"), weight.alias("weight")
    )
    members = customers.select(F.col("c_mktsegment").alias("manifest"), F.col("c_custkey").alias("record"), F.col("c_custkey").alias("prior_index"))
    return pairs, members


@query("dq06_check_label_sizes", "", _DQ06, rec=_REC)
def _(t):
    records = _records(t)
    known = records.select("manifest").unionByName(t.table("nation").select(F.col("n_name").alias("manifest")))
    return quality.check_label_sizes(records, known)


@query("dq07_check_width", "", """
SELECT mf AS manifest, '' AS record, 'width_not_constant' AS code, concat(CAST(lo AS VARCHAR), '..', CAST(hi AS VARCHAR)) AS detail FROM x WHERE lo <> hi
UNION ALL SELECT mf, '', 'width_not_configured', concat(CAST(lo AS VARCHAR), '..', CAST(hi AS VARCHAR)) FROM x WHERE lo <> 8 OR hi <> 8
""", x="SELECT concat('w', CAST(label AS VARCHAR)) AS mf, min(w) AS lo, max(w) AS hi FROM (SELECT label, CASE WHEN label > 7 AND vec_id % 2 = 0 THEN 16 WHEN label = 0 THEN 4 ELSE 8 END AS w FROM embeddings) GROUP BY 1")
def _(t):
    width = F.when((F.col("label") > 7) & (F.col("vec_id") % 2 == 0), 16).when(F.col("label") == 0, 4).otherwise(8)
    records = t.table("embeddings").select(
        F.concat(F.lit("w"), F.col("label").cast("string")).alias("manifest"), F.array(F.slice("embedding", F.lit(1), width)).alias("embedding")
    )
    return quality.check_width(records, configured=8)


@query("dq08_check_edges", "", """
SELECT manifest, record, 'edge_index_shape' AS code, '' AS detail FROM e WHERE k = 1
UNION ALL SELECT manifest, record, 'edge_weight_count', '1' FROM e WHERE k = 2 UNION ALL SELECT manifest, record, 'edge_weight_nonfinite', '' FROM e WHERE k = 3
""", e="SELECT o_orderstatus AS manifest, CAST(o_orderkey AS VARCHAR) AS record, CASE WHEN o_custkey % 17 = 0 THEN 1 WHEN o_custkey % 19 = 0 THEN 2 WHEN o_custkey % 23 = 0 THEN 3 ELSE 0 END AS k FROM orders")
def _(t):
    return quality.check_edges(_edge_rows(t))


def _edge_rows(t: Inputs):
    c = F.col("o_custkey")
    k = F.when(c % 17 == 0, 1).when(c % 19 == 0, 2).when(c % 23 == 0, 3).otherwise(0)
    two = F.array(c, F.col("o_orderkey"))
    return t.table("orders").select(
        F.col("o_orderstatus").alias("manifest"), F.col("o_orderkey").alias("record"),
        F.when(k == 1, F.array(two)).otherwise(F.array(two, two)).alias("edge_index"),
        F.when(k == 2, F.array(F.lit(0.5))).when(k == 3, F.array(F.lit(0.5), F.lit(float("nan")))).otherwise(F.array(F.lit(0.5), F.lit(1.0))).alias("edge_weight"),
    )


@query("dq09_check_score_terms", "", """
SELECT '' AS manifest, CAST(p_partkey AS VARCHAR) AS record, 'term_not_scored' AS code, '' AS detail FROM part WHERE p_partkey NOT IN (SELECT l_partkey + l_suppkey FROM lineitem)
UNION ALL SELECT DISTINCT '', CAST(l_partkey + l_suppkey AS VARCHAR), 'term_unknown', '' FROM lineitem WHERE l_partkey + l_suppkey NOT IN (SELECT p_partkey FROM part)""")
def _(t):
    return quality.check_score_terms(*_score_term_inputs(t))


def _score_term_inputs(t: Inputs):
    scores = t.table("lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("term"))
    return t.table("part").select(F.col("p_partkey").alias("term")), scores


_LANGUAGES = ["en", "fr", "de", "es", "it", "pt"]


@query("dq10_check_partitions", "", """
SELECT m AS manifest, '' AS record, 'partition_missing' AS code, '' AS detail FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it', 'pt']) AS m) WHERE m NOT IN (SELECT lang FROM documents)""")
def _(t):
    return quality.check_partitions(t.table("documents").select(F.col("lang").alias("manifest")), _LANGUAGES)


def _issues(t: Inputs):
    records = _records(t)
    return quality.union_issues([quality.check_embeddings(records), quality.check_labels(records), quality.check_lengths(records)])


_ALL = {"rec": _REC, "iss": f"{_DQ01} UNION ALL {_DQ02} UNION ALL {_DQ03}"}


@query("dq10_quality_report", "", """
SELECT m.manifest, count(iss.code) AS n_issues FROM (SELECT DISTINCT manifest FROM rec UNION SELECT r_name FROM region) m LEFT JOIN iss ON iss.manifest = m.manifest GROUP BY 1
UNION ALL SELECT '*', count(*) FROM iss""", **_ALL)
def _(t):
    known = _records(t).select("manifest").unionByName(t.table("region").select(F.col("r_name").alias("manifest")))
    return quality.quality_report(_issues(t), known)


@query("dq11_check_meta", "", """
SELECT n_name AS manifest, '' AS record, 'aspect_mismatch' AS code, CASE WHEN n_regionkey = 0 THEN 'MF' ELSE 'BP' END AS detail FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_name, '', 'num_functions_missing', '' FROM nation WHERE n_nationkey % 4 = 0""")
def _(t):
    return quality.check_meta(_meta(t), "MF")


def _meta(t: Inputs):
    return t.table("nation").select(
        F.col("n_name").alias("manifest"), F.when(F.col("n_regionkey") == 0, "MF").otherwise("BP").alias("aspect"),
        F.when(F.col("n_nationkey") % 4 != 0, F.lit(528)).alias("num_functions"),
    )


@query("pf07_length_issues", "entries", """
SELECT source AS manifest, CAST(d.doc_id AS VARCHAR) AS record, 'length_mismatch' AS code, concat(CAST(length(e.sequence) AS VARCHAR), '/', CAST(d.n_chars AS VARCHAR), '/', CASE WHEN l.doc_id IS NULL THEN '-' ELSE CAST(d.n_chars AS VARCHAR) END) AS detail
FROM documents d JOIN entries e ON e.entry_id = concat('D', CAST(d.doc_id AS VARCHAR)) LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE length(e.sequence) <> d.n_chars""")
def _(t):
    lab = t.table("labels").select("doc_id", F.lit(True).alias("has"))
    docs = t.table("documents").join(lab, "doc_id", "left").select(
        F.col("source").alias("manifest"), F.col("doc_id").alias("record"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence_length"),
        F.col("n_chars").alias("embedding_length"), F.when(F.col("has"), F.col("n_chars")).alias("structure_length"),
    )
    return quality.length_issues(docs)
