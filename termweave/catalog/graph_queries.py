"""JN11, JN12, PF12, PF19, PF21, ST01-ST04, WN03, WN04, WN12, AG16-AG19, AG24, AG25, GR11-GR16."""

from pyspark.sql import functions as F

from ..operators import graph, ranking, relational
from ..sources.structures import fragment_bounds
from .registry import Inputs, query

CUTOFF, K = 10.0, 6
_CONF = {"cf": "SELECT *, greatest(0.0, least(1.0, CASE WHEN max(conf) OVER (PARTITION BY entry_id) > 1 THEN conf / 100.0 ELSE conf END)) AS nc FROM coords"}
_PAIRS = {
    **_CONF,
    "pr": f"SELECT * FROM (SELECT a.entry_id, a.pos AS i, b.pos AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist, least(a.nc, b.nc) AS w FROM cf a JOIN cf b ON a.entry_id = b.entry_id AND a.pos <> b.pos) WHERE dist <= {CUTOFF}",
}
_NEAR = {**_PAIRS, "nr": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, i ORDER BY dist, j) AS r FROM pr) WHERE r <= {K - 1}"}
_GRAPH = {**_NEAR, "g": "SELECT entry_id, i AS src, j AS dst, w AS weight FROM nr UNION SELECT entry_id, j, i, w FROM nr"}


def _graph(t: Inputs):
    return graph.coordinate_graph(t.coords(), CUTOFF, K)


def _nodes(t: Inputs):
    return t.coords().select("entry_id", "pos", "conf")


def _vec(t: Inputs):
    return t.coords().select("entry_id", "pos", F.array("x", "y", "z").alias("vec"))


def _xyz(df, digits=6):
    parts = [F.round(F.get("vec", F.lit(i)), digits).alias(n) for i, n in enumerate("xyz")]
    return df.select(*[c for c in df.columns if c != "vec"], *parts)


def _r(df, *names, digits=9):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("jn11_pairs_within", "coords", "SELECT entry_id, i, j, round(dist, 8) AS dist FROM pr", **_PAIRS)
def _(t):
    return _r(graph.pairs_within(t.coords(), CUTOFF), "dist", digits=8)


@query("pf12_normalise_confidence", "coords", "SELECT entry_id, pos, round(nc, 9) AS conf FROM cf", **_CONF)
def _(t):
    return _r(graph.normalise_confidence(_nodes(t)), "conf")


@query("wn03_nearest", "coords", "SELECT entry_id, i, j, round(dist, 8) AS dist FROM nr", **_NEAR)
def _(t):
    return _r(ranking.nearest(graph.pairs_within(t.coords(), CUTOFF), K), "dist", digits=8)


@query("st01_symmetrise_union", "coords", "SELECT entry_id, i AS src, j AS dst FROM nr UNION SELECT entry_id, j, i FROM nr", **_NEAR)
def _(t):
    near = ranking.nearest(graph.pairs_within(t.coords(), CUTOFF), K)
    return graph.symmetrise_union(near.select("entry_id", F.col("i").alias("src"), F.col("j").alias("dst")))


@query("gr13_coordinate_graph", "coords", "SELECT entry_id, src, dst, round(weight, 9) AS weight FROM g", **_GRAPH)
def _(t):
    return _r(_graph(t), "weight")


@query("gr13_coordinate_graph_dense", "coords", "SELECT entry_id, src, dst, round(weight, 9) AS weight FROM g UNION ALL SELECT entry_id, pos, pos, round(nc, 9) FROM cf", **_GRAPH)
def _(t):
    return _r(graph.coordinate_graph(t.coords(), CUTOFF, K, dense=True), "weight")


# A graph with loops in some entries only: position 0 of odd entries.
_LOOPY = {**_GRAPH, "lg": "SELECT * FROM g UNION ALL SELECT entry_id, pos, pos, nc FROM cf WHERE entry_id % 2 = 1 AND pos = 0"}


def _loopy(t: Inputs):
    own = graph.normalise_confidence(_nodes(t)).filter("entry_id % 2 = 1 AND pos = 0")
    return _graph(t).unionByName(own.select("entry_id", F.col("pos").alias("src"), F.col("pos").alias("dst"), F.col("conf").alias("weight")))


@query("st03_unit_loops", "coords", """
SELECT entry_id, src, dst, round(weight + CASE WHEN src = dst THEN 1 ELSE 0 END, 9) AS weight FROM lg
UNION ALL SELECT entry_id, pos, pos, 1.0 FROM cf WHERE entry_id NOT IN (SELECT entry_id FROM lg WHERE src = dst)""", **_LOOPY)
def _(t):
    return _r(graph.unit_loops(_loopy(t), _nodes(t)), "weight")


@query("st04_confidence_loops", "coords", """
SELECT entry_id, src, dst, round(weight, 9) AS weight FROM lg WHERE src <> dst UNION ALL SELECT entry_id, pos, pos, round(nc, 9) FROM cf""", **_LOOPY)
def _(t):
    return _r(graph.confidence_loops(_loopy(t), graph.normalise_confidence(_nodes(t))), "weight")


_SYM = {
    **_GRAPH,
    "gl": "SELECT * FROM g UNION ALL SELECT entry_id, pos, pos, nc FROM cf",
    "dg": "SELECT entry_id, src AS n, sum(weight) AS d FROM gl GROUP BY 1, 2",
    "sn": "SELECT gl.entry_id, gl.src, gl.dst, gl.weight / sqrt(greatest(coalesce(a.d, 0), 1e-6) * greatest(coalesce(b.d, 0), 1e-6)) AS weight FROM gl LEFT JOIN dg a ON a.entry_id = gl.entry_id AND a.n = gl.src LEFT JOIN dg b ON b.entry_id = gl.entry_id AND b.n = gl.dst",
}


def _normalised(t: Inputs):
    return graph.symmetric_normalise(graph.coordinate_graph(t.coords(), CUTOFF, K, dense=True))


@query("ag18_symmetric_normalise", "coords", "SELECT entry_id, src, dst, round(weight, 9) AS weight FROM sn", **_SYM)
def _(t):
    return _r(_normalised(t), "weight")


@query("ag19_neighbour_sum", "coords", """
SELECT c.entry_id, c.pos, round(coalesce(o.x, 0.0), 6) AS x, round(coalesce(o.y, 0.0), 6) AS y, round(coalesce(o.z, 0.0), 6) AS z FROM coords c LEFT JOIN
(SELECT s.entry_id, s.src, sum(s.weight * c.x) AS x, sum(s.weight * c.y) AS y, sum(s.weight * c.z) AS z FROM sn s JOIN coords c ON c.entry_id = s.entry_id AND c.pos = s.dst GROUP BY 1, 2) o
ON o.entry_id = c.entry_id AND o.src = c.pos""", **_SYM)
def _(t):
    return _xyz(graph.neighbour_sum(_normalised(t), _vec(t), 3))


_HOP = "SELECT s.entry_id, s.src AS pos, sum(s.weight * c.x) AS x, sum(s.weight * c.y) AS y, sum(s.weight * c.z) AS z FROM sn s JOIN {prev} c ON c.entry_id = s.entry_id AND c.pos = s.dst GROUP BY 1, 2"


@query("gr12_diffuse", "coords", "SELECT entry_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM h3",
       **_SYM, h1=_HOP.format(prev="coords"), h2=_HOP.format(prev="h1"), h3=_HOP.format(prev="h2"))
def _(t):
    return _xyz(graph.diffuse(_normalised(t), _vec(t), 3, 3))


_PRIOR = {
    **_GRAPH,
    "sz": "SELECT entry_id, count(*) AS n FROM coords GROUP BY 1",
    "ss": "SELECT entry_id, src, dst, greatest(sum(weight), 1e-6) AS s FROM (SELECT * FROM g UNION ALL SELECT entry_id, pos, pos, 1.0 FROM coords) GROUP BY 1, 2, 3",
    "rs": "SELECT ss.entry_id, src, sum(s) + 1e-6 * (any_value(n) - count(*)) AS t FROM ss JOIN sz ON sz.entry_id = ss.entry_id GROUP BY 1, 2",
    "cs": "SELECT ss.entry_id, dst AS src, sum(s) + 1e-6 * (any_value(n) - count(*)) AS t FROM ss JOIN sz ON sz.entry_id = ss.entry_id GROUP BY 1, 2",
}


@query("gr11_stochastic_prior", "coords", """
SELECT ss.entry_id, ss.src, ss.dst, round(s / rs.t, 9) AS weight, round(1e-6 / rs.t, 12) AS background, round(s / cs.t, 9) AS backward, round(1e-6 / cs.t, 12) AS backward_background
FROM ss JOIN rs ON rs.entry_id = ss.entry_id AND rs.src = ss.src JOIN cs ON cs.entry_id = ss.entry_id AND cs.src = ss.src""", **_PRIOR)
def _(t):
    prior = graph.stochastic_prior(_graph(t), _nodes(t), backward=True)
    return _r(_r(prior, "weight", "backward"), "background", "backward_background", digits=12)


@query("gr12_diffuse_prior", "coords", """
SELECT a.entry_id, a.pos, round(sum(coalesce(ss.s, 1e-6) / rs.t * b.x), 6) AS x, round(sum(coalesce(ss.s, 1e-6) / rs.t * b.y), 6) AS y, round(sum(coalesce(ss.s, 1e-6) / rs.t * b.z), 6) AS z
FROM coords a JOIN coords b ON b.entry_id = a.entry_id JOIN rs ON rs.entry_id = a.entry_id AND rs.src = a.pos
LEFT JOIN ss ON ss.entry_id = a.entry_id AND ss.src = a.pos AND ss.dst = b.pos GROUP BY 1, 2""", **_PRIOR)
def _(t):
    return _xyz(graph.diffuse(graph.stochastic_prior(_graph(t), _nodes(t)), _vec(t), 1, 3))


_CROP = "SELECT label + 10 * (vec_id // 500) AS entry_id, CAST(max(vec_id % 97) AS BIGINT) - 40 AS length FROM embeddings GROUP BY 1"


def _crop_lengths(t: Inputs):
    entry = F.col("label").cast("bigint") + 10 * F.floor(F.col("vec_id") / 500.0).cast("bigint")
    return t.table("embeddings").groupBy(entry.alias("entry_id")).agg(
        (F.max(F.col("vec_id") % 97) - 40).alias("length")
    )


@query("gr15_fit_graph_edges", "coords", """
SELECT g.entry_id, src, dst, round(weight, 9) AS weight FROM g JOIN ln ON ln.entry_id = g.entry_id WHERE src < length AND dst < length""", **_GRAPH, ln=_CROP)
def _(t):
    return _r(graph.fit_graph(_graph(t), _nodes(t), _crop_lengths(t))[0], "weight")


@query("gr15_fit_graph_nodes", "coords", """
SELECT s.entry_id, s.pos, round(coalesce(c.conf, 0.0), 6) AS conf FROM (SELECT entry_id, unnest(range(length)) AS pos FROM ln) s LEFT JOIN coords c ON c.entry_id = s.entry_id AND c.pos = s.pos""", ln=_CROP)
def _(t):
    return _r(graph.fit_graph(_graph(t), _nodes(t), _crop_lengths(t))[1], "conf", digits=6)


@query("gr16_mask_nodes", "coords", """
SELECT entry_id, src, dst, round(weight, 9) AS weight FROM g WHERE entry_id NOT IN (SELECT entry_id FROM iv)
UNION ALL SELECT entry_id, src, dst, round(weight / greatest(sum(weight) OVER (PARTITION BY entry_id, src), 1e-12), 9) FROM
(SELECT g.* FROM g WHERE entry_id IN (SELECT entry_id FROM iv) AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.entry_id = g.entry_id AND iv.pos = g.src)
 UNION ALL SELECT entry_id, pos, pos, 1.0 FROM iv)""", **_GRAPH, iv="SELECT entry_id, pos FROM coords WHERE conf < 10 AND entry_id % 3 <> 0")
def _(t):
    valid = t.coords().select("entry_id", "pos", F.when((F.col("conf") < 10) & (F.col("entry_id") % 3 != 0), 0).otherwise(1).alias("valid"))
    return _r(graph.mask_nodes(_graph(t), valid), "weight")


@query("wn12_merge_graphs", "coords", """
SELECT e.entry_id // 4 AS batch_id, src + o.off AS src, dst + o.off AS dst, round(weight, 9) AS weight FROM g e JOIN o ON o.entry_id = e.entry_id
""", **_GRAPH, o="SELECT entry_id, CAST(coalesce(sum(count(*)) OVER (PARTITION BY entry_id // 4 ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM coords GROUP BY entry_id")
def _(t):
    batches = t.coords().select("entry_id").distinct().select(
        F.floor(F.col("entry_id") / 4).alias("batch_id"), (F.col("entry_id") % 4).alias("pos"), "entry_id"
    )
    return _r(graph.merge_graphs(_graph(t), _nodes(t), batches), "weight")


@query("wn12_node_offsets", "coords", """
SELECT entry_id // 4 AS batch_id, entry_id % 4 AS pos, entry_id, count(*) AS n_nodes, CAST(coalesce(sum(count(*)) OVER (PARTITION BY entry_id // 4 ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_node FROM coords GROUP BY entry_id""")
def _(t):
    batches = t.coords().select("entry_id").distinct().select(
        F.floor(F.col("entry_id") / 4).alias("batch_id"), (F.col("entry_id") % 4).alias("pos"), "entry_id"
    )
    return graph.node_offsets(_nodes(t), batches)


_POOL = "round(sum(list_sum(v)), 6) AS total, round(any_value(v[1]), 9) AS head"


def _pooled(df):
    return df.select("entry_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("vec", F.lit(0)), 8).alias("head"))


_DIMS = "SELECT entry_id, pos, unnest(vec) AS x, unnest(range(1, 65)) AS d FROM residues"


@query("ag16_pool_mean", "residues", """
SELECT entry_id, round(sum(m), 6) AS total, round(max(m) FILTER (d = 1), 8) AS head FROM (SELECT entry_id, d, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1""", dims=_DIMS)
def _(t):
    return _pooled(graph.pool(t.residues(), "mean", 64))


@query("ag16_pool_masked_mean", "residues", """
SELECT entry_id, round(sum(m), 6) AS total, round(max(m) FILTER (d = 1), 8) AS head FROM
(SELECT entry_id, d, sum(CASE WHEN pos % 3 > 0 THEN x ELSE 0 END) / greatest(count(*) FILTER (pos % 3 > 0), 1) AS m FROM dims GROUP BY 1, 2) GROUP BY 1""", dims=_DIMS)
def _(t):
    return _pooled(graph.pool(t.residues().withColumn("mask", (F.col("pos") % 3 > 0).cast("int")), "masked_mean", 64))


@query("ag16_pool_first", "residues", "SELECT entry_id, round(list_sum(vec), 6) AS total, round(vec[1], 8) AS head FROM residues WHERE pos = 0")
def _(t):
    return _pooled(graph.pool(t.residues(), "first").withColumn("vec", F.transform("vec", lambda x: x.cast("double"))))


_WEIGHTS = [round(0.5 * (i % 7) - 1.0, 2) for i in range(64)]


@query("ag17_softmax_pool", "residues", """
SELECT entry_id, round(sum(m), 6) AS total, round(max(m) FILTER (d = 1), 8) AS head FROM
(SELECT dims.entry_id, d, sum(x * e) / sum(e) AS m FROM dims JOIN sx ON sx.entry_id = dims.entry_id AND sx.pos = dims.pos GROUP BY 1, 2) GROUP BY 1
""", dims=_DIMS, sc=f"SELECT entry_id, pos, list_dot_product(vec, {_WEIGHTS}::DOUBLE[]) AS s FROM residues", sx="SELECT entry_id, pos, exp(s - max(s) OVER (PARTITION BY entry_id)) AS e FROM sc")
def _(t):
    return _pooled(graph.softmax_pool(t.residues(), _WEIGHTS, 64))


# ---- contact graphs -------------------------------------------------------------------------

_MEAN = {"sm": "SELECT entry_id, i, j, sum(p) / 2 AS p FROM (SELECT * FROM contacts UNION ALL SELECT entry_id, j, i, p FROM contacts) GROUP BY 1, 2, 3"}
_KEPT = {**_MEAN, "kp": "SELECT entry_id, i, j, p FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, i ORDER BY p DESC, j) AS r FROM sm WHERE abs(i - j) > 3 AND p >= 0.2) WHERE r <= 5"}


@query("st02_symmetrise_mean", "contacts", "SELECT entry_id, i, j, round(p, 9) AS p FROM sm", **_MEAN)
def _(t):
    return _r(graph.symmetrise_mean(t.contacts()), "p")


@query("pf21_drop_band", "contacts", "SELECT entry_id, i, j, round(p, 9) AS p FROM contacts WHERE abs(i - j) > 3")
def _(t):
    return _r(graph.drop_band(t.contacts(), 3), "p")


@query("wn04_top_contacts", "contacts", """
SELECT entry_id, i, j, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, i ORDER BY p DESC, j) AS r FROM contacts WHERE p > 0) WHERE r <= 4""")
def _(t):
    return _r(ranking.top_contacts(t.contacts(), 4, t.contact_lengths()), "p")


@query("jn12_mutual", "contacts", "SELECT a.entry_id, a.i, a.j, round(a.p, 9) AS p FROM contacts a WHERE EXISTS (SELECT 1 FROM contacts b WHERE b.entry_id = a.entry_id AND b.i = a.j AND b.j = a.i)")
def _(t):
    return _r(relational.mutual(t.contacts()), "p")


@query("gr14_contact_graph", "contacts", "SELECT entry_id, i, j, round(p, 9) AS p FROM kp", **_KEPT)
def _(t):
    return _r(graph.contact_graph(t.contacts(), t.contact_lengths(), k=5, min_prob=0.2, band=3), "p")


@query("gr14_contact_graph_mutual", "contacts", """
SELECT entry_id, r.i AS i, r.j AS j, round(r.p, 9) AS p FROM
(SELECT entry_id, unnest(list({'i': i, 'j': j, 'p': p})) AS r FROM kp GROUP BY entry_id, least(i, j), greatest(i, j) HAVING count(*) = 2)""", **_KEPT)
def _(t):
    return _r(graph.contact_graph(t.contacts(), t.contact_lengths(), k=5, min_prob=0.2, band=3, mutual=True), "p")


@query("ag24_mean_contact", "contacts contact_lengths", """
SELECT l.entry_id, l.pos, round(coalesce(s.t, 0.0) / 64, 13) AS conf FROM (SELECT entry_id, unnest(range(64)) AS pos FROM contact_lengths) l
LEFT JOIN (SELECT entry_id, i, sum(p) AS t FROM contacts GROUP BY 1, 2) s ON s.entry_id = l.entry_id AND s.i = l.pos""")
def _(t):
    return _r(graph.mean_contact(t.contacts(), t.contact_lengths()), "conf", digits=13)


@query("ag25_match_isoforms", "fragments expected_lengths", """
SELECT f.entry_id, f.accession, CAST(f.total AS BIGINT) AS total FROM (SELECT entry_id, accession, sum(length) AS total FROM fragments GROUP BY 1, 2) f
JOIN expected_lengths x ON x.entry_id = f.entry_id WHERE f.total = x.length""")
def _(t):
    return graph.match_isoforms(t.fragments(), t.expected_lengths())


@query("pf19_fragment_bounds", "", """
SELECT l_orderkey, l_linenumber, s AS start_pos, e AS end_pos, e - s + 1 AS length FROM (SELECT *, CASE WHEN s0 <> 0 THEN s0 ELSE l_linenumber END AS s,
CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 100 + CAST(l_quantity AS INT) ELSE (CASE WHEN s0 <> 0 THEN s0 ELSE l_linenumber END) + length(l_returnflag) + length(l_linestatus) - 1 END AS e
FROM (SELECT *, CAST(l_quantity AS INT) % 5 AS s0 FROM lineitem))""")
def _(t):
    q = F.col("l_quantity").cast("int")
    item = F.struct(
        (q % 5).cast("string").alias("sequenceStart"), F.col("l_linenumber").cast("string").alias("uniprotStart"),
        F.when(q % 2 == 0, (100 + q).cast("string")).otherwise("n/a").alias("sequenceEnd"), F.lit(None).cast("string").alias("uniprotEnd"),
        F.concat("l_returnflag", "l_linestatus").alias("sequence"),
    )
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", item.alias("m")).select("*", fragment_bounds(F.col("m")).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.col("b.start").alias("start_pos"), F.col("b.end").alias("end_pos"), F.col("b.length").alias("length"))
