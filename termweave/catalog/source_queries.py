"""SC01-SC24, UD03: text and array formats are written from the views into the shared scratch folder by
Spark, then scanned back; the oracle is the view itself."""

import io

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from ..lineage import scratch_path
from ..operators import labels, ranking
from ..sources import arrays, fasta, manifests, ontology, sinks, structures, synthetic, tables
from .registry import Inputs, query
from .ranking_queries import _BATCH, _lengths


def _fold(col, width=60):
    """Sequence text in lines of 60, as FASTA files have it."""
    return F.regexp_replace(col, f"(.{{{width}}})", "$1\n")


def _fasta(t: Inputs, header, name: str) -> str:
    path = scratch_path(t.spark, name)
    rows = t.entries().select(header.alias("header"), _fold("sequence").alias("sequence"))
    sinks.write_fasta(rows, path)
    return path


_SEQ = "md5(sequence) AS digest, length(sequence) AS n"


def _digest(df):
    return df.select("entry_id", "header", F.md5("sequence").alias("digest"), F.length("sequence").cast("bigint").alias("n"))


@query("sc01_read_fasta", "entries", f"SELECT entry_id, header, {_SEQ} FROM entries")
def _(t):
    return _digest(fasta.read_fasta(t.spark, _fasta(t, F.col("header"), "fasta")))


@query("sc02_read_fasta_flexible", "entries", f"""
SELECT CASE WHEN length(sequence) % 2 = 0 THEN entry_id ELSE concat('X', entry_id) END AS entry_id,
CASE WHEN length(sequence) % 2 = 0 THEN header ELSE concat('X', entry_id, ' some text') END AS header, {_SEQ} FROM entries""")
def _(t):
    even = F.length("sequence") % 2 == 0
    header = F.when(even, F.col("header")).otherwise(F.concat(F.lit("X"), F.col("entry_id"), F.lit(" some text")))
    return _digest(fasta.read_fasta(t.spark, _fasta(t, header, "fasta"), "flexible"))


@query("sc03_read_fasta_loose", "entries", f"SELECT entry_id, concat('||tr||', entry_id, '|x y') AS header, {_SEQ} FROM entries")
def _(t):
    header = F.concat(F.lit("||tr||"), F.col("entry_id"), F.lit("|x y"))
    return _digest(fasta.read_fasta(t.spark, _fasta(t, header, "fasta"), "loose"))


_DUP = "SELECT concat('sp|', source, '|') AS header, source AS entry_id, substr(sequence, 1, 0) || sequence AS sequence, doc_id FROM (SELECT e.sequence, d.source, d.doc_id FROM entries e JOIN documents d ON e.entry_id = concat('D', CAST(d.doc_id AS VARCHAR)))"


def _ordered_fasta(t: Inputs) -> str:
    """One source per id, so ids repeat; the files are written in document order."""
    path = scratch_path(t.spark, "fasta")
    docs = t.table("documents").select(
        "doc_id", F.concat(F.lit("sp|"), F.col("source"), F.lit("|")).alias("header"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"),
    )
    sinks.fasta_records(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")).write.text(path)
    return path


@query("sc04_duplicates_last", "entries", "SELECT entry_id, header, md5(sequence) AS digest, length(sequence) AS n FROM d QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY doc_id DESC) = 1", d=_DUP)
def _(t):
    return _digest(fasta.read_fasta(t.spark, _ordered_fasta(t), duplicates="last"))


@query("sc04_duplicates_first", "entries", "SELECT entry_id, header, md5(sequence) AS digest, length(sequence) AS n FROM d QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY doc_id) = 1", d=_DUP)
def _(t):
    return _digest(fasta.read_fasta(t.spark, _ordered_fasta(t), duplicates="first"))


@query("sc04_duplicates_checked", "entries", f"SELECT entry_id, header, {_SEQ} FROM entries")
def _(t):
    path = scratch_path(t.spark, "fasta")
    rows = t.entries().select("header", _fold("sequence").alias("sequence"))
    sinks.write_fasta(rows.unionByName(rows), path)
    return _digest(fasta.read_fasta(t.spark, path, duplicates="error"))


def _go(col):
    return F.concat(F.lit("GO:"), F.lpad(col.cast("string"), 7, "0"))


_GO = "concat('GO:', lpad(CAST({} AS VARCHAR), 7, '0'))"


@query("sc05_read_annotations", "annotations", f"SELECT CAST(entry_id AS VARCHAR) AS entry_id, {_GO.format('term')} AS term, aspect FROM annotations")
def _(t):
    path = scratch_path(t.spark, "annotations")
    long_name = F.when(F.col("aspect") == "F", "mfo").when(F.col("aspect") == "P", "Biological_Process").otherwise("cc")
    rows = t.annotations().select("entry_id", _go(F.col("term")).alias("term"), long_name.alias("aspect"))
    foreign = t.table("region").select(F.col("r_name").alias("entry_id"), F.lit("GO:0").alias("term"), F.lit("unknown").alias("aspect"))
    sinks.write_annotations(rows.withColumn("entry_id", F.col("entry_id").cast("string")).unionByName(foreign), path)
    return tables.read_annotations(t.spark, path)


@query("sc06_read_taxonomy", "taxonomy", "SELECT entry_id, tax_id FROM taxonomy")
def _(t):
    path = scratch_path(t.spark, "taxonomy")
    t.taxonomy().select(F.concat("entry_id", F.lit(" \t "), "tax_id")).write.text(path)
    return tables.read_taxonomy(t.spark, path)


@query("sc06_read_taxonomy_missing", "", "SELECT o_orderkey AS entry_id, '' AS tax_id FROM orders")
def _(t):
    from ..operators.relational import with_taxonomy

    none = tables.read_taxonomy(t.spark, scratch_path(t.spark, "absent"))
    orders = t.table("orders").select(F.col("o_orderkey").alias("entry_id"))
    return with_taxonomy(orders, none.withColumn("entry_id", F.col("entry_id").cast("bigint")))


@query("sc07_read_term_weights", "ia", f"SELECT {_GO.format('term')} AS term, CASE WHEN term % 10 = 3 THEN 0.0 ELSE ia END AS ia FROM ia")
def _(t):
    path = scratch_path(t.spark, "weights")
    value = F.when(F.col("term") % 10 == 3, "").otherwise(F.col("ia").cast("string"))
    t.ia().select(F.concat(_go(F.col("term")), F.lit("  "), value)).write.text(path)
    return tables.read_term_weights(t.spark, path)


def _obo(t: Inputs) -> str:
    path = scratch_path(t.spark, "obo")
    name = F.when(F.col("aspect") == "F", "molecular_function").when(F.col("aspect") == "P", "biological_process").otherwise("cellular_component")
    edges = t.ontology_edges().groupBy(F.col("child").alias("term")).agg(F.sort_array(F.collect_list(F.struct("rel", "parent"))).alias("links"))
    line = lambda x: F.when(x["rel"] == "is_a", F.concat(F.lit("is_a: "), _go(x["parent"]), F.lit(" ! name"))).otherwise(
        F.concat(F.lit("relationship: part_of "), _go(x["parent"]), F.lit(" ! name")))
    lines = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<struct<rel:string,parent:bigint>>")), line), "\n")
    stanza = F.concat(
        F.lit("[Term]\nid: "), _go(F.col("term")), F.lit("\nname: x\nnamespace: "), name,
        F.lit("\nrelationship: regulates GO:9999999 ! other\n"), lines, F.lit("\n"),
    )
    gone = F.concat(F.lit("[Term]\nid: GO:OLD"), F.col("term").cast("string"), F.lit("\nnamespace: molecular_function\nis_obsolete: true\n"))
    kind = F.concat(F.lit("[Typedef]\nid: rel"), F.col("term").cast("string"), F.lit("\nis_a: GO:0000000\n"))
    rows = t.ontology_terms().join(edges, "term", "left")
    rows.select(F.explode(F.array(stanza, gone, kind))).write.text(path)
    return path


@query("sc08_read_ontology_terms", "ontology_terms", f"SELECT {_GO.format('term')} AS term, aspect FROM ontology_terms")
def _(t):
    return ontology.read_ontology(t.spark, _obo(t))[0]


@query("sc08_read_ontology_edges", "ontology_edges", f"SELECT {_GO.format('child')} AS child, {_GO.format('parent')} AS parent, rel FROM ontology_edges")
def _(t):
    return ontology.read_ontology(t.spark, _obo(t))[1]


@query("sc09_explode_term_cells", "", f"""
SELECT l_orderkey, l_linenumber, {_GO.format('l_partkey')} AS term FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, {_GO.format('l_suppkey')} FROM lineitem WHERE l_linenumber <> 6""")
def _(t):
    a, b, n = _go(F.col("l_partkey")), _go(F.col("l_suppkey")), F.col("l_linenumber")
    cell = (
        F.when(n == 1, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("', 'X']"))).when(n == 2, F.concat(a, F.lit("; "), b, F.lit(";other")))
        .when(n == 3, F.concat(a, F.lit(","), b)).when(n == 4, F.concat(a, F.lit(" | "), b)).when(n == 6, a)
        .otherwise(F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]')))
    )
    return tables.explode_term_cells(t.table("lineitem").select("l_orderkey", "l_linenumber", cell.alias("go_terms")))


@query("sc10_read_ids", "", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS entry_id FROM lineitem")
def _(t):
    path = scratch_path(t.spark, "ids")
    ids = t.table("lineitem").select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("entry_id"), "l_linenumber")
    ids.write.option("header", True).csv(path)
    return tables.read_ids(t.spark, path)


@query("sc11_read_atoms", "coords", """
SELECT concat('model', CAST(entry_id AS VARCHAR)) AS model_id, pos, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(conf, 2) AS conf FROM coords""")
def _(t):
    path = scratch_path(t.spark, "atoms")
    held = t.coords().repartition("entry_id").sortWithinPartitions("entry_id", "pos")
    num = lambda c, w, d: F.lpad(F.round(c, d).cast(f"decimal(10,{d})").cast("string"), w, " ")

    def row(atom):
        return F.concat(
            F.lit("ATOM  "), F.lpad(F.col("pos").cast("string"), 5, " "), F.lit(f" {atom:^4} ALA A"), F.lpad(F.col("pos").cast("string"), 4, " "), F.lit("    "),
            num("x", 8, 3), num("y", 8, 3), num("z", 8, 3), F.lit("  1.00"), num("conf", 6, 2), F.lit("           C"),
        )

    held.select("entry_id", F.explode(F.array(row("N"), row("CA"))).alias("value")).write.partitionBy("entry_id").text(path)
    files = t.spark.read.text(path)  # partition folders name the model; file names are Spark's
    return structures.read_atoms_from(files, F.concat(F.lit("model"), F.col("entry_id").cast("string")))


@query("sc12_read_fragments", "fragments", """
SELECT accession AS entry_id, CASE WHEN frag_no % 2 = 0 THEN accession ELSE concat('AF-', accession) END AS accession,
concat('F', CAST(frag_no AS VARCHAR)) AS model_id, 'https://example.org/x.pdb' AS url, start_pos AS start, end_pos AS "end", length FROM fragments""")
def _(t):
    item = F.struct(
        F.when(F.col("frag_no") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("AF-"), F.col("accession"))).alias("uniprotAccession"),
        F.concat(F.lit("F"), F.col("frag_no").cast("string")).alias("modelEntityId"), F.col("start_pos").alias("sequenceStart"),
        F.col("end_pos").alias("uniprotEnd"), F.lit("https://example.org/x.pdb").alias("pdbUrl"),
    )
    rows = t.fragments().groupBy(F.col("accession").alias("entry_id")).agg(F.to_json(F.collect_list(item)).alias("metadata"))
    return structures.read_fragments(rows)


@query("sc13_read_manifest", "annotations", "SELECT manifest, record, CAST(entry_id AS VARCHAR) AS entry_id, CAST(n AS DOUBLE) AS label, n AS length FROM r",
       r="SELECT aspect || CAST(entry_id // 100 AS VARCHAR) AS manifest, row_number() OVER (PARTITION BY aspect, entry_id // 100 ORDER BY entry_id) - 1 AS record, entry_id, n FROM (SELECT aspect, entry_id, count(*) AS n FROM annotations GROUP BY 1, 2)")
def _(t):
    counted = t.annotations().groupBy("aspect", "entry_id").agg(F.count(F.lit(1)).alias("n"))
    record = F.struct(F.col("entry_id").cast("string").alias("entry_id"), F.array(F.col("n").cast("double")).alias("labels"), F.array("n").alias("lengths"))
    # one manifest per aspect and 100 consecutive entries: manifests are bounded, their number grows
    name = F.concat("aspect", F.floor(F.col("entry_id") / 100).cast("string"))
    packed = counted.groupBy(name.alias("manifest")).agg(F.array_sort(F.collect_list(F.struct(F.col("entry_id").alias("k"), record.alias("r")))).alias("_s"))
    body = F.to_json(F.struct(F.col("_s.r").alias("records")))
    text = F.when(F.startswith("manifest", F.lit("C")), F.to_json(F.col("_s.r"))).otherwise(body)
    rows = manifests.parse_manifests(packed.select("manifest", text.alias("text")))
    return rows.select("manifest", "record", "entry_id", F.get("labels", F.lit(0)).alias("label"), F.get("lengths", F.lit(0)).alias("length"))


def _array_files(t: Inputs):
    """Vectors as .npy bytes, .npz bytes under two key names, and unreadable bytes."""

    def encode(frames):
        for frame in frames:
            contents = []
            for key, vec in zip(frame["vec_id"], frame["embedding"]):
                out, a = io.BytesIO(), np.asarray(vec, dtype=np.float32).reshape(4, 16)
                if key % 4 == 0:
                    np.save(out, a)
                elif key % 4 == 1:
                    np.savez(out, embeddings=a, other=np.zeros(3))
                elif key % 4 == 2:
                    np.savez(out, strange=a)
                else:
                    out.write(b"not an array")
                contents.append(out.getvalue())
            yield pd.DataFrame({"artefact": frame["vec_id"].astype(str), "content": contents})

    return t.table("embeddings").select("vec_id", "embedding").mapInPandas(encode, "artefact string, content binary")


_DECODED = """SELECT CAST(vec_id AS VARCHAR) AS artefact, CASE WHEN vec_id % 4 < {n} THEN '4x16' END AS shape,
CASE WHEN vec_id % 4 < {n} THEN round(list_sum(CAST(embedding AS DOUBLE[])), 6) END AS total, CASE WHEN vec_id % 4 < {n} THEN 0 ELSE 1 END AS failed FROM embeddings"""


def _decoded(df):
    shape = F.array_join(F.transform("shape", lambda x: x.cast("string")), "x")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return df.select("artefact", shape.alias("shape"), F.round(total, 6).alias("total"), F.col("error").isNotNull().cast("int").alias("failed"))


@query("ud03_decode_arrays", "", _DECODED.format(n=2))
def _(t):
    return _decoded(arrays.decode_arrays(_array_files(t)))


def _put_files(path: str):
    """One file per row below the shared folder, whatever store that is."""

    def put(frames):
        store, place = pafs.FileSystem.from_uri(path)
        store.create_dir(place, recursive=True)
        for frame in frames:
            for name, content in zip(frame["artefact"], frame["content"]):
                kind = "npy" if bytes(content).startswith(b"\x93NUMPY") else "npz"
                with store.open_output_stream(f"{place}/{name}.{kind}", compression=None) as sink:
                    sink.write(content)
            yield frame[["artefact"]]

    return put


@query("sc14_ingest_arrays", "", _DECODED.format(n=3))
def _(t):
    path, table = scratch_path(t.spark, "array-files"), scratch_path(t.spark, "arrays")
    _array_files(t).mapInPandas(_put_files(path), "artefact string").count()
    arrays.ingest_arrays(t.spark, path, priority=[*arrays.KEY_PRIORITY, "strange"]).write.parquet(table)
    return _decoded(t.spark.read.parquet(table))


@query("sc15_write_splits", "", """
SELECT entry_id, CASE WHEN r <= e1 THEN 'train' WHEN r <= e2 THEN 'val' ELSE 'test' END AS split FROM
(SELECT entry_id, row_number() OVER (ORDER BY md5(concat(entry_id, '|7')), entry_id) AS r FROM ids), edges
""", ids="SELECT CAST(o_orderkey AS VARCHAR) AS entry_id FROM orders",
    edges="SELECT CAST(floor(count(*) * 0.7) AS BIGINT) AS e1, CAST(floor(count(*) * 0.7) AS BIGINT) + CAST(floor(count(*) * 0.2) AS BIGINT) AS e2 FROM ids")
def _(t):
    path = scratch_path(t.spark, "splits")
    sinks.write_splits(ranking.split(t.table("orders").select(F.col("o_orderkey").alias("entry_id")), {"train": 0.7, "val": 0.2, "test": 0.1}, 7), path)
    return t.spark.read.schema("entry_id STRING, split STRING").option("header", True).csv(path)


_MANIFEST = "SELECT CAST(entry_id AS VARCHAR) AS entry_id, aspect, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM annotations JOIN orders ON o_orderkey = entry_id GROUP BY 1, 2, 3"


def _manifest_parts(t: Inputs):
    records = t.annotations().groupBy(F.col("entry_id").cast("string").alias("entry_id"), "aspect").agg(F.count(F.lit(1)).alias("n"))
    split = F.when(F.col("o_orderstatus") == "F", "train").otherwise("val")
    return records, t.table("orders").select(F.col("o_orderkey").cast("string").alias("entry_id"), split.alias("split"))


@query("sc16_write_manifest", "annotations", "SELECT entry_id, n, split, aspect FROM m", m=_MANIFEST)
def _(t):
    path = scratch_path(t.spark, "manifest")
    records, splits = _manifest_parts(t)
    sinks.write_manifest(sinks.manifest_records(records, splits, ["train", "val", "test"]), path)
    return t.spark.read.schema("entry_id STRING, n BIGINT, split STRING, aspect STRING").json(path)


@query("sc16_manifest_on_empty_all", "annotations", "SELECT split, aspect, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'test', aspect, count(*) FROM m GROUP BY 2", m=_MANIFEST)
def _(t):
    records, splits = _manifest_parts(t)
    rows = sinks.manifest_records(records, splits, ["train", "val", "test"], on_empty="all")
    return rows.groupBy("split", "aspect").agg(F.count(F.lit(1)).alias("n"))


@query("sc17_write_predictions", "predictions", """
SELECT CAST(entry_id AS VARCHAR) AS entry_id, CAST(term AS VARCHAR) AS term, format('{:.3g}', score) AS score_text FROM predictions""")
def _(t):
    from ..functions.text import score_text

    path = scratch_path(t.spark, "predictions")
    rows = t.predictions().select("entry_id", "term", score_text(F.col("score")).alias("score_text"))
    sinks.write_predictions(rows.filter(F.col("entry_id") < 5000), path, "overwrite")
    sinks.write_predictions(rows.filter(F.col("entry_id") >= 5000), path, "append")
    return t.spark.read.schema("entry_id STRING, term STRING, score_text STRING").option("sep", "\t").csv(path)


_METRICS = ("click", "error", "purchase", "signup", "view")


@query("sc18_write_metrics", "run_metrics",
       "SELECT CAST(run_id AS VARCHAR) AS aspect, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in _METRICS) + " FROM run_metrics GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "metrics")
    best = t.run_metrics().groupBy(F.col("run_id").cast("string").alias("aspect"), "metric").agg(F.max("value").alias("value"))
    sinks.write_metrics(best, path, list(_METRICS))
    schema = "aspect STRING, " + ", ".join(f"{m} DOUBLE" for m in _METRICS)
    return t.spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


@query("sc19_write_subset", "entries train_ids doc_annotations", """
SELECT e.entry_id, length(e.sequence) AS n, coalesce(a.n, 0) AS n_terms FROM entries e LEFT JOIN (SELECT entry_id, count(*) AS n FROM doc_annotations GROUP BY 1) a ON a.entry_id = e.entry_id
WHERE e.entry_id IN (SELECT entry_id FROM train_ids)""")
def _(t):
    path = scratch_path(t.spark, "subset")
    sinks.write_subset(t.entries(), t.doc_annotations(), t.train_ids(), path)
    seqs = fasta.read_fasta(t.spark, f"{path}/sequences")
    terms = tables.read_annotations(t.spark, f"{path}/annotations").groupBy("entry_id").agg(F.count(F.lit(1)).alias("k"))
    return seqs.join(terms, "entry_id", "left").select("entry_id", F.length("sequence").cast("bigint").alias("n"), F.coalesce("k", F.lit(0)).alias("n_terms"))


@query("sc20_write_selection", "entries taxonomy", """
SELECT e.entry_id, x.tax_id, CAST(length(sequence) AS DOUBLE) AS go_freq_score, CAST(length(header) AS DOUBLE) AS similarity_score, 'MF' AS aspect, coalesce(x.tax_id, 'none') AS set_name FROM entries e LEFT JOIN taxonomy x ON x.entry_id = e.entry_id""")
def _(t):
    path = scratch_path(t.spark, "selection")
    rows = t.entries().join(t.taxonomy(), "entry_id", "left").select(
        "entry_id", "tax_id", F.length("sequence").cast("double").alias("go_freq_score"), F.length("header").cast("double").alias("similarity_score"),
        F.lit("MF").alias("aspect"), F.coalesce("tax_id", F.lit("none")).alias("set_name"),
    )
    sinks.write_selection(rows, path)
    schema = "entry_id STRING, tax_id STRING, go_freq_score DOUBLE, similarity_score DOUBLE, aspect STRING, set_name STRING"
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("sc21_write_term_lists", "annotations", f"SELECT CAST(entry_id AS VARCHAR) AS entry_id, {_GO.format('term')} AS term FROM annotations")
def _(t):
    path = scratch_path(t.spark, "terms")
    sinks.write_term_lists(t.annotations().withColumn("term", _go(F.col("term"))), path)
    rows = t.spark.read.schema("entry_id STRING, go_terms STRING").option("header", True).option("escape", '"').csv(path)
    return tables.explode_term_cells(rows)


@query("sc22_read_batches", "entries", "SELECT batch_id, pos, entry_id FROM b", b=_BATCH)
def _(t):
    path = scratch_path(t.spark, "batches")
    lengths = _lengths(t)
    sinks.read_batches(t.spark, path, lambda: ranking.length_batches(lengths, 32), 32, lengths)
    return sinks.read_batches(t.spark, path, None, 32, lengths)


@query("sc23_read_predicted_ids", "predictions", "SELECT DISTINCT CAST(entry_id AS VARCHAR) AS entry_id FROM predictions")
def _(t):
    path = scratch_path(t.spark, "predicted")
    sinks.write_predictions(t.predictions().select("entry_id", "term", F.lit("0.5").alias("score_text")), path)
    return tables.read_predicted_ids(t.spark, path)


_DRAW = "CAST(concat('0x', substr(md5(concat(CAST(id AS VARCHAR), '|11|{}')), 1, 8)) AS BIGINT)"


@query("sc24_synthetic_entries", "", f"""
SELECT concat('S', CAST(id AS VARCHAR)) AS entry_id, 20 + {_DRAW.format('len')} % 41 AS n, 'GO:' || lpad(CAST({_DRAW.format('t|1')} % 50 AS VARCHAR), 7, '0') AS first_term,
substr('ACDEFGHIKLMNPQRSTVWY', CAST({_DRAW.format('aa|1')} % 20 + 1 AS INT), 1) AS first_letter FROM (SELECT o_orderkey AS id FROM orders)""")
def _(t):
    rows = synthetic.synthetic_entries(t.spark, seed=11, ids=t.table("orders").select(F.col("o_orderkey").alias("id")))
    first = F.concat(F.lit("GO:"), F.lpad((F.conv(F.substring(F.md5(F.concat(F.substring("entry_id", 2, 20), F.lit("|11|t|1"))), 1, 8), 16, 10).cast("bigint") % 50).cast("string"), 7, "0"))
    return rows.select(
        "entry_id", F.length("sequence").cast("bigint").alias("n"), F.when(F.array_contains("terms", first), first).alias("first_term"),
        F.substring("sequence", 1, 1).alias("first_letter"),
    )
