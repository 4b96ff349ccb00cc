"""WN02, WN06-WN11, WN13-WN15, WN17, SO03-SO05."""

from pyspark.sql import functions as F

from ..operators import labels, order, ranking, relational
from .registry import Inputs, query

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
_SIZES = """SELECT n, CAST(floor(n * 0.8) AS BIGINT) AS a, CAST(floor(n * 0.1) AS BIGINT) AS b, n - CAST(floor(n * 0.8) AS BIGINT) - 2 * CAST(floor(n * 0.1) AS BIGINT) AS rest FROM (SELECT count(*) AS n FROM ids)"""
# remainder 1 goes to train, 2 to train and val
_EDGES = "SELECT a + CASE WHEN rest >= 1 THEN 1 ELSE 0 END AS e1, a + b + rest AS e2, b + CASE WHEN rest >= 2 THEN 1 ELSE 0 END AS val FROM sizes"


@query("wn02_rank_buckets", "", """
SELECT entry_id, CASE WHEN r <= CAST(floor(n * 0.25) AS BIGINT) THEN 'low' WHEN r <= CAST(floor(n * 0.75) AS BIGINT) THEN 'med' ELSE 'high' END AS bucket FROM
(SELECT l_orderkey AS entry_id, row_number() OVER (ORDER BY sum(l_quantity), md5(CAST(l_orderkey AS VARCHAR))) AS r, count(*) OVER () AS n FROM lineitem GROUP BY 1)""")
def _(t):
    scores = t.table("lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.sum("l_quantity").alias("score"))
    return ranking.rank_buckets(scores, fracs=(1, 2, 1)).select("entry_id", "bucket")


@query("wn06_split", "", """
SELECT entry_id, CASE WHEN r <= e1 THEN 'train' WHEN r <= e2 THEN 'val' ELSE 'test' END AS split FROM
(SELECT entry_id, row_number() OVER (ORDER BY md5(concat(entry_id, '|1337')), entry_id) AS r FROM ids), edges
""", ids="SELECT DISTINCT trim(CAST(o_orderkey AS VARCHAR)) AS entry_id FROM orders", sizes=_SIZES, edges=_EDGES)
def _(t):
    return ranking.split(t.table("orders").select(F.col("o_orderkey").alias("entry_id")), RATIOS, 1337)


@query("wn07_split_size", "", "SELECT val AS n_val FROM edges", ids="SELECT l_linenumber, l_orderkey FROM lineitem", sizes=_SIZES, edges=_EDGES)
def _(t):
    return t.table("lineitem").agg(ranking.split_size(F.count(F.lit(1)), RATIOS).alias("n_val"))


_STRATA = "SELECT entry_id, string_agg(aspect, '' ORDER BY aspect) AS stratum FROM (SELECT DISTINCT entry_id, aspect FROM annotations) GROUP BY entry_id"
_QUOTA = {
    "st": _STRATA,
    "cnt": "SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM st GROUP BY 1",
    "tgt": "SELECT *, greatest(1, CAST(round_even(total * 0.15, 0) AS BIGINT)) AS target FROM cnt",
    "base": "SELECT *, least(n, CAST(floor(n * target / CAST(total AS DOUBLE)) AS BIGINT)) AS b FROM tgt",
    "frac": "SELECT *, n * target / CAST(total AS DOUBLE) - b AS f, target - sum(b) OVER () AS left_over FROM base",
    "more": "SELECT *, b + CASE WHEN b < n AND row_number() OVER (ORDER BY CASE WHEN b < n THEN 0 ELSE 1 END, f DESC, stratum) <= left_over THEN 1 ELSE 0 END AS q FROM frac",
}


@query("wn08_stratified_sample", "annotations", """
SELECT s.entry_id, s.stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(entry_id AS VARCHAR), '|42')), entry_id) AS r FROM st) s
JOIN more m ON m.stratum = s.stratum WHERE s.r <= m.q""", **_QUOTA)
def _(t):
    return ranking.stratified_sample(labels.stratum_key(t.annotations()), 0.15, 42)


@query("wn08_stratum_quotas", "annotations", "SELECT stratum, n, q AS quota FROM more", **_QUOTA)
def _(t):
    strata = labels.stratum_counts(labels.stratum_key(t.annotations()))
    return ranking.stratum_quotas(strata.select("stratum", "n"), 0.15)


_BS = {
    "bk": "SELECT DISTINCT l_returnflag AS bucket, l_suppkey AS entry_id FROM lineitem",
    "pf": "SELECT DISTINCT l_returnflag AS bucket, l_suppkey AS entry_id FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08",
    "mk": "SELECT bk.*, CASE WHEN pf.entry_id IS NULL THEN 1 ELSE 0 END AS late FROM bk LEFT JOIN pf ON pf.bucket = bk.bucket AND pf.entry_id = bk.entry_id",
    "rk": "SELECT *, row_number() OVER (PARTITION BY bucket, late ORDER BY md5(concat(CAST(entry_id AS VARCHAR), '|5')), entry_id) AS r, count(*) OVER (PARTITION BY bucket) AS n_all, count(*) FILTER (late = 0) OVER (PARTITION BY bucket) AS n_pref FROM mk",
}


def _bucket_sql(size: int) -> dict[str, str]:
    return {
        **_BS,
        "pl": "SELECT *, CASE WHEN late = 0 THEN r ELSE n_pref + r END AS draw_no FROM rk",
        "grp": "SELECT DISTINCT bucket, n_all, n_pref, CASE WHEN n_all > n_pref THEN n_all - n_pref ELSE n_all END AS pool FROM rk",
        "dr": f"SELECT bucket, d AS draw_no, CAST(concat('0x', substr(md5(concat(CAST(d AS VARCHAR), '|5')), 1, 8)) AS BIGINT) % pool + 1 AS r FROM (SELECT *, unnest(range(n_pref + 1, {size} + 1)) AS d FROM grp WHERE n_all < {size})",
    }


def _bucket_body(size: int) -> str:
    return f"""SELECT bucket, entry_id, draw_no FROM pl WHERE draw_no <= {size} AND (n_all >= {size} OR late = 0)
UNION ALL SELECT dr.bucket, pl.entry_id, dr.draw_no FROM dr JOIN pl ON pl.bucket = dr.bucket AND pl.r = dr.r AND (pl.late = 1 OR pl.n_all = pl.n_pref)"""


def _bucket_inputs(t: Inputs):
    rows = t.table("lineitem").select(F.col("l_returnflag").alias("bucket"), F.col("l_suppkey").alias("entry_id"), "l_quantity", "l_discount")
    return rows.select("bucket", "entry_id").distinct(), rows.filter("l_quantity > 49 AND l_discount > 0.08").select("bucket", "entry_id")


@query("wn09_bucket_sample", "", _bucket_body(40), **_bucket_sql(40))
def _(t):
    bucket, prefer = _bucket_inputs(t)
    return ranking.bucket_sample(bucket, 40, prefer, seed=5, keys=["bucket"])


@query("wn09_bucket_sample_short", "", _bucket_body(5000), **_bucket_sql(5000))
def _(t):
    bucket, prefer = _bucket_inputs(t)
    return ranking.bucket_sample(bucket, 5000, prefer, seed=5, keys=["bucket"])


_BATCH = "SELECT entry_id, length, r, n, CAST(floor((r - 1) / 32) AS BIGINT) AS batch_id, (r - 1) % 32 AS pos FROM (SELECT *, row_number() OVER (ORDER BY length, md5(entry_id), entry_id) AS r, count(*) OVER () AS n FROM (SELECT entry_id, length(sequence) AS length FROM entries))"


def _lengths(t: Inputs):
    return t.entries().select("entry_id", F.length("sequence").cast("bigint").alias("length"))


@query("wn10_length_batches", "entries", "SELECT batch_id, pos, entry_id, length FROM b", b=_BATCH)
def _(t):
    return ranking.length_batches(_lengths(t), 32)


@query("wn10_length_batches_drop_last", "entries", "SELECT batch_id, pos, entry_id, length FROM b WHERE (batch_id + 1) * 32 <= n", b=_BATCH)
def _(t):
    return ranking.length_batches(_lengths(t), 32, drop_last=True)


@query("wn11_shuffle_batches", "entries", """
SELECT batch_id, row_number() OVER (ORDER BY md5(concat(CAST(batch_id AS VARCHAR), '|9')), batch_id) - 1 AS position FROM (SELECT DISTINCT batch_id FROM b)""", b=_BATCH)
def _(t):
    return ranking.shuffle_batches(ranking.length_batches(_lengths(t), 32), 9)


@query("wn13_fragment_gaps", "fragments", """
SELECT accession, CASE WHEN nxt <= end_pos THEN 'overlap' ELSE 'gap' END AS kind, end_pos AS from_pos, nxt AS to_pos FROM
(SELECT *, lead(start_pos) OVER (PARTITION BY accession ORDER BY start_pos, end_pos, frag_no) AS nxt FROM fragments) WHERE nxt <= end_pos OR nxt > end_pos + 1""")
def _(t):
    return ranking.fragment_gaps(t.fragments())


@query("wn14_pick_isoform", "fragments", """
SELECT entry_id, accession, priority FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY priority, accession) AS r FROM
(SELECT DISTINCT entry_id, accession, CASE WHEN accession = CAST(entry_id AS VARCHAR) THEN 0 WHEN starts_with(accession, CAST(entry_id AS VARCHAR)) THEN 1 ELSE 2 END AS priority FROM fragments)) WHERE r = 1""")
def _(t):
    return ranking.pick_isoform(t.fragments())


@query("wn15_top_p", "contacts", """
SELECT entry_id, src, dst, round(e / sum(e) OVER (PARTITION BY entry_id, src), 9) AS weight FROM
(SELECT *, sum(pr) OVER (PARTITION BY entry_id, src ORDER BY w DESC, md5(CAST(dst AS VARCHAR)), dst ROWS UNBOUNDED PRECEDING) - pr AS ahead FROM
 (SELECT *, e / sum(e) OVER (PARTITION BY entry_id, src) AS pr FROM
  (SELECT entry_id, i AS src, j AS dst, 5 * p AS w, exp(5 * p - max(5 * p) OVER (PARTITION BY entry_id, i)) AS e FROM contacts))) WHERE ahead < 0.6""")
def _(t):
    edges = t.contacts().select("entry_id", F.col("i").alias("src"), F.col("j").alias("dst"), (5 * F.col("p")).alias("weight"))
    return ranking.top_p(edges, 0.6).withColumn("weight", F.round("weight", 9))


@query("wn17_pad_batches", "entries", """
SELECT b.batch_id, b.pos, b.entry_id, CAST(max(len(w.v)) OVER (PARTITION BY b.batch_id) AS BIGINT) AS width, CAST(len(w.v) AS BIGINT) AS live, round(list_sum(w.v), 3) AS total
FROM b JOIN w ON w.entry_id = b.entry_id
""", b=_BATCH, w="SELECT concat('D', CAST(doc_id AS VARCHAR)) AS entry_id, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS DOUBLE)) AS v FROM documents")
def _(t):
    vec = F.transform(F.split("text", " ", -1), lambda x: F.length(x).cast("double"))
    rows = t.table("documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("entry_id"), vec.alias("vec"))
    padded = ranking.pad_batches(rows, ranking.length_batches(_lengths(t), 32))
    return padded.select(
        "batch_id", "pos", "entry_id", F.size("padded").cast("bigint").alias("width"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("live"),
        F.round(F.aggregate("padded", F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
    )


@query("so03_sample_split", "", """
SELECT entry_id, CASE WHEN r <= 300 THEN 'train' WHEN r <= 350 THEN 'val' ELSE 'test' END AS split FROM
(SELECT o_orderkey AS entry_id, row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '|3')), o_orderkey) AS r FROM orders) WHERE r <= 420""")
def _(t):
    return ranking.sample_split(t.table("orders").select(F.col("o_orderkey").alias("entry_id")), {"train": 300, "val": 50, "test": 70}, 3)


@query("so04_by_length", "entries", "SELECT entry_id, length(sequence) AS length FROM entries")
def _(t):
    return order.by_length(_lengths(t))


@query("so05_sample_missing", "entries train_ids", """
SELECT entry_id, count(*) OVER () AS n_missing FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM train_ids) ORDER BY entry_id LIMIT 5""")
def _(t):
    return ranking.sample_missing(relational.not_in(t.entries().select("entry_id"), t.train_ids()))
