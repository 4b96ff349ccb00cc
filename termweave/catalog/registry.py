"""Query registry and the stand-in views over the driver tables.

Every view exists twice: as DataFrames (``Inputs``) and as SQL (``VIEWS``) for the oracle. Views read
whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt_by, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """Driver tables and the domain views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entries(self) -> DataFrame:
        """Sequence table: letters of the whole document, upper case."""
        entry = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
        return spread(self.table("documents").select("doc_id", "source", "text"), "doc_id").select(
            entry.alias("entry_id"),
            F.concat(F.lit("sp|"), entry, F.lit("|"), F.col("source")).alias("header"),
            F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"),
        )

    def train_ids(self) -> DataFrame:
        """Entries that carry a quality label are the train side."""
        return self.table("labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("entry_id")).distinct()

    def taxonomy(self) -> DataFrame:
        """Taxonomy is known for the labelled entries only."""
        return self.table("labels").select(
            F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("entry_id"),
            F.concat(F.lit("T"), (F.col("quality") * 2 + F.col("toxic")).cast("string")).alias("tax_id"),
        )

    @staticmethod
    def _aspect(key: str):
        k = F.col(key)
        return F.when(k == 0, "C").when(k % 11 == 0, "F").when(k % 13 == 0, "P").otherwise("C")

    def ontology_terms(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("term"), self._aspect("p_partkey").alias("aspect"))

    def ontology_edges(self) -> DataFrame:
        key = F.col("p_partkey")
        pick = lambda n: F.floor(key / float(n)).cast("bigint")
        part = self.table("part").filter(key > 0)
        links = F.array(
            F.struct(pick(4).alias("parent"), F.lit("is_a").alias("rel")),
            F.when(key % 3 == 0, F.struct(pick(7).alias("parent"), F.lit("part_of").alias("rel"))),
        )
        return part.select(key.alias("child"), F.inline(F.array_compact(links)))

    def annotations(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("term"), self._aspect("l_partkey").alias("aspect")
        )

    def doc_annotations(self) -> DataFrame:
        """Annotations of the document entries: those of the order with the document's number."""
        held = self.annotations().join(self.table("documents").select(F.col("doc_id").alias("entry_id")), "entry_id", "left_semi")
        return held.withColumn("entry_id", F.concat(F.lit("D"), F.col("entry_id").cast("string")))

    def predictions(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("term")).agg(
            (F.max("l_quantity") / 50.0).alias("score")
        )

    def aspect_predictions(self) -> DataFrame:
        """The same (entry, term) scored under several aspects: one per line status."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("term"),
            F.col("l_linestatus").alias("aspect"), (F.col("l_quantity") / 50.0).alias("score"),
        )

    def scored(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            F.col("l_orderkey").alias("entry_id"), (F.col("l_partkey") % 20).alias("term")
        ).agg((F.max("l_quantity") / 50.0).alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))

    def scored_entries(self) -> int:
        return self.table("lineitem").select("l_orderkey").distinct().count()

    def ia(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("term"), (F.col("p_retailprice") / 1000.0).alias("ia"))

    def vectors(self) -> DataFrame:
        """Embeddings in file-order batches of 32."""
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 32.0).cast("bigint").alias("batch_id"), F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vec")
        )

    def residues(self) -> DataFrame:
        """Chains of embeddings: one entry per label and block of 500 vectors, in vector order."""
        block = F.floor(F.col("vec_id") / 500.0).cast("bigint")
        entry = F.col("label").cast("bigint") + 10 * block
        w = Window.partitionBy("entry_id").orderBy("vec_id")
        held = self.table("embeddings").select(entry.alias("entry_id"), "vec_id", F.col("embedding").alias("vec"))
        return held.select("entry_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "vec_id", "vec")

    def coords(self) -> DataFrame:
        """Positions and confidence from sums over the four quarters of the whole vector."""

        def quarter(i: int):
            part = F.slice("vec", 16 * i + 1, 16)
            return F.aggregate(part, F.lit(0.0), lambda total, x: total + x.cast("double"))

        axis = lambda i, name: F.round(25 * quarter(i), 6).alias(name)
        conf = F.round(F.least(F.lit(100.0), 100 * F.abs(quarter(3))), 6).alias("conf")
        return self.residues().select("entry_id", "pos", axis(0, "x"), axis(1, "y"), axis(2, "z"), conf)

    def contacts(self) -> DataFrame:
        """Contact probabilities of 64-residue entries, one entry per supplier, dealt by entry."""
        rows = self.table("lineitem").select(
            F.col("l_suppkey").alias("entry_id"), (F.col("l_partkey") % 64).alias("i"), (F.col("l_orderkey") % 64).alias("j"), "l_extendedprice"
        )
        return dealt_by(rows, "entry_id").groupBy("entry_id", "i", "j").agg(F.least(F.lit(1.0), F.max("l_extendedprice") / 100000.0).alias("p"))

    def contact_lengths(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("entry_id"), F.lit(64).cast("bigint").alias("length"))

    def fragments(self) -> DataFrame:
        start = 10 * F.col("l_linenumber")
        end = start + F.col("l_quantity").cast("int") % 12
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("entry_id"),
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_suppkey") % 3).cast("string")).alias("accession"),
            F.col("l_linenumber").alias("frag_no"), start.alias("start_pos"), end.alias("end_pos"),
            (end - start + 1).alias("length"),
        )

    def expected_lengths(self) -> DataFrame:
        """Expected chain length of an entry, from its order total."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("entry_id"), (F.floor(F.col("o_totalprice")).cast("bigint") % 40).alias("length")
        )

    def run_metrics(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value"
        )

    def trials(self) -> DataFrame:
        kind = F.col("event_type")
        state = F.when(kind == "error", "FAIL").when(kind == "view", "PRUNED").otherwise("COMPLETE")
        return self.table("events").select(
            F.col("event_id").alias("trial_id"), state.alias("state"), F.when(~kind.isin("error", "view"), F.col("value")).alias("value")
        )


_ASPECT = "CASE WHEN {k} = 0 THEN 'C' WHEN {k} % 11 = 0 THEN 'F' WHEN {k} % 13 = 0 THEN 'P' ELSE 'C' END"
_DOC = "concat('D', CAST(doc_id AS VARCHAR))"

VIEWS = {
    "entries": f"SELECT {_DOC} AS entry_id, concat('sp|', {_DOC}, '|', source) AS header, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents",
    "train_ids": f"SELECT DISTINCT {_DOC} AS entry_id FROM labels",
    "taxonomy": f"SELECT {_DOC} AS entry_id, concat('T', CAST(quality * 2 + toxic AS VARCHAR)) AS tax_id FROM labels",
    "ontology_terms": f"SELECT p_partkey AS term, {_ASPECT.format(k='p_partkey')} AS aspect FROM part",
    "ontology_edges": "SELECT p_partkey AS child, CAST(floor(p_partkey / 4.0) AS BIGINT) AS parent, 'is_a' AS rel FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, CAST(floor(p_partkey / 7.0) AS BIGINT), 'part_of' FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0",
    "annotations": f"SELECT l_orderkey AS entry_id, l_partkey AS term, {_ASPECT.format(k='l_partkey')} AS aspect FROM lineitem",
    "doc_annotations": f"SELECT concat('D', CAST(l_orderkey AS VARCHAR)) AS entry_id, l_partkey AS term, {_ASPECT.format(k='l_partkey')} AS aspect FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM documents)",
    "predictions": "SELECT l_orderkey AS entry_id, l_partkey AS term, max(l_quantity) / 50.0 AS score FROM lineitem GROUP BY l_orderkey, l_partkey",
    "aspect_predictions": "SELECT l_orderkey AS entry_id, l_partkey AS term, l_linestatus AS aspect, l_quantity / 50.0 AS score FROM lineitem",
    "scored": "SELECT l_orderkey AS entry_id, CAST(l_partkey % 20 AS BIGINT) AS term, max(l_quantity) / 50.0 AS score, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY l_orderkey, l_partkey % 20",
    "ia": "SELECT p_partkey AS term, p_retailprice / 1000.0 AS ia FROM part",
    "vectors": "SELECT CAST(floor(vec_id / 32.0) AS BIGINT) AS batch_id, vec_id AS entry_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "residues": "SELECT label + 10 * CAST(floor(vec_id / 500.0) AS BIGINT) AS entry_id, CAST(row_number() OVER (PARTITION BY label + 10 * CAST(floor(vec_id / 500.0) AS BIGINT) ORDER BY vec_id) - 1 AS BIGINT) AS pos, vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "coords": """SELECT entry_id, pos, round(25 * list_sum(v[1:16]), 6) AS x, round(25 * list_sum(v[17:32]), 6) AS y, round(25 * list_sum(v[33:48]), 6) AS z,
        round(least(100.0, 100 * abs(list_sum(v[49:64]))), 6) AS conf FROM (SELECT entry_id, pos, CAST(vec AS DOUBLE[]) AS v FROM residues)""",
    "contacts": "SELECT l_suppkey AS entry_id, l_partkey % 64 AS i, l_orderkey % 64 AS j, least(1.0, max(l_extendedprice) / 100000.0) AS p FROM lineitem GROUP BY l_suppkey, l_partkey % 64, l_orderkey % 64",
    "contact_lengths": "SELECT s_suppkey AS entry_id, CAST(64 AS BIGINT) AS length FROM supplier",
    "fragments": "SELECT l_orderkey AS entry_id, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_suppkey % 3 AS VARCHAR)) AS accession, l_linenumber AS frag_no, 10 * l_linenumber AS start_pos, 10 * l_linenumber + CAST(l_quantity AS INT) % 12 AS end_pos, CAST(l_quantity AS INT) % 12 + 1 AS length FROM lineitem",
    "expected_lengths": "SELECT o_orderkey AS entry_id, CAST(floor(o_totalprice) AS BIGINT) % 40 AS length FROM orders",
    "run_metrics": "SELECT user_id AS run_id, event_id AS step, event_type AS metric, value FROM events",
    "trials": "SELECT event_id AS trial_id, CASE WHEN event_type = 'error' THEN 'FAIL' WHEN event_type = 'view' THEN 'PRUNED' ELSE 'COMPLETE' END AS state, CASE WHEN event_type IN ('error','view') THEN NULL ELSE value END AS value FROM events",
    # closures
    "reach": "SELECT child AS term, parent AS ancestor FROM ontology_edges UNION SELECT r.term, e.parent FROM reach r JOIN ontology_edges e ON r.ancestor = e.child",
    "anc": "SELECT r.term, r.ancestor FROM reach r JOIN ontology_terms a ON a.term = r.term JOIN ontology_terms b ON b.term = r.ancestor WHERE a.aspect = b.aspect",
    "same_edges": "SELECT DISTINCT e.child, e.parent FROM ontology_edges e JOIN ontology_terms a ON a.term = e.child JOIN ontology_terms b ON b.term = e.parent WHERE a.aspect = b.aspect",
    "descend": "SELECT parent AS term, child AS descendant FROM same_edges UNION SELECT d.term, e.child FROM descend d JOIN same_edges e ON d.descendant = e.parent",
    "freq": "SELECT term, count(*) AS n FROM annotations GROUP BY term",
    "chosen": "SELECT aspect, term FROM (SELECT t.aspect, f.term, row_number() OVER (PARTITION BY t.aspect ORDER BY f.n DESC, f.term) AS r FROM freq f JOIN ontology_terms t ON t.term = f.term) WHERE r <= 100",
    "vocab": "SELECT aspect, term FROM chosen UNION SELECT c.aspect, a.ancestor FROM chosen c JOIN anc a ON a.term = c.term",
    "adjacency": "SELECT v.aspect, e.parent, e.child, 1.0 / count(*) OVER (PARTITION BY v.aspect, e.parent) AS weight FROM (SELECT DISTINCT child, parent FROM ontology_edges WHERE child <> parent) e JOIN vocab v ON v.term = e.child JOIN vocab w ON w.term = e.parent AND w.aspect = v.aspect",
    "vclose": "SELECT child AS term, parent AS ancestor FROM adjacency UNION SELECT c.term, a.parent FROM vclose c JOIN adjacency a ON a.child = c.ancestor",
}
NEEDS = {
    "coords": ["residues"],
    "reach": ["ontology_edges"],
    "anc": ["reach", "ontology_terms"],
    "same_edges": ["ontology_edges", "ontology_terms"],
    "descend": ["same_edges"],
    "freq": ["annotations"],
    "chosen": ["freq", "ontology_terms"],
    "vocab": ["chosen", "anc"],
    "adjacency": ["vocab", "ontology_edges"],
    "vclose": ["adjacency"],
}


def with_views(views: str, body: str, **more: str) -> str:
    """SQL text: the named views (and what they need) as CTEs, extra CTEs, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def query(name: str, views: str | None = None, body: str | None = None, **more: str):
    """Register ``fn(Inputs) -> DataFrame``; with a body also its oracle."""

    def keep(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if body is not None:
            SQL[name] = with_views(views or "", body, **more)
        return fn

    return keep
