"""Fixed schemas of the data model; readers never infer."""

from pyspark.sql import types as T

SEQUENCES = "entry_id STRING, header STRING, sequence STRING"
ANNOTATIONS = "entry_id STRING, term STRING, aspect STRING"
TAXONOMY = "entry_id STRING, tax_id STRING"
TERM_WEIGHTS = "term STRING, ia DOUBLE"
TERMS = "term STRING, aspect STRING"
EDGES = "child STRING, parent STRING, rel STRING"
PREDICTIONS = "entry_id STRING, term STRING, score DOUBLE"
BATCHES = "batch_id BIGINT, pos BIGINT, entry_id STRING"

ISSUES = "manifest STRING, record STRING, code STRING, detail STRING"

FRAGMENT_ITEM = T.StructType(
    [
        T.StructField("uniprotAccession", T.StringType()),
        T.StructField("entryId", T.StringType()),
        T.StructField("uniprotId", T.StringType()),
        T.StructField("modelEntityId", T.StringType()),
        T.StructField("sequenceStart", T.StringType()),
        T.StructField("sequenceEnd", T.StringType()),
        T.StructField("uniprotStart", T.StringType()),
        T.StructField("uniprotEnd", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("pdbUrl", T.StringType()),
    ]
)

MANIFEST_RECORD = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("embedding_path", T.StringType()),
        T.StructField("structure_path", T.StringType()),
        T.StructField("labels", T.ArrayType(T.DoubleType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
    ]
)

ARRAY_ROWS = "artefact STRING, shape ARRAY<BIGINT>, values ARRAY<DOUBLE>, error STRING"
