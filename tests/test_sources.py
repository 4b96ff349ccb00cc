"""Readers and writers on small hand-made files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.sources import arrays, fasta, manifests, ontology, sinks, structures, synthetic, tables


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_fasta_strict(spark, tmp_path, rows):
    path = _write(tmp_path / "a.fasta", ">sp|P1|DESC\nAA\nAA\n\n>sp|P2|DESC\nTTTT\n")
    assert rows(fasta.read_fasta(spark, path), "entry_id", "sequence") == [("P1", "AAAA"), ("P2", "TTTT")]


def test_fasta_bad_header_raises(spark, tmp_path):
    with pytest.raises(Exception, match="unexpected FASTA header"):
        fasta.read_fasta(spark, _write(tmp_path / "b.fasta", ">badheader\nAAAA\n")).collect()


def test_fasta_flexible_and_loose(spark, tmp_path, rows):
    path = _write(tmp_path / "c.fasta", ">sp|P1|x\nAA\n>sp| |y z\nCC\n>Q9 text\nGG\n")
    assert rows(fasta.read_fasta(spark, path, "flexible"), "entry_id") == [("P1",), ("Q9",), ("sp|",)]
    path = _write(tmp_path / "d.fasta", ">|tr|P7|x rest\nAA\n>P8 rest\nCC\n>P9|\nGG\n")
    assert rows(fasta.read_fasta(spark, path, "loose"), "entry_id") == [("P7",), ("P8",), ("P9|",)]


def test_fasta_duplicates(spark, tmp_path, rows):
    path = _write(tmp_path / "e.fasta", ">a|P1|x\nAA\n>a|P2|x\nCC\n>a|P1|x\nGG\n")
    assert rows(fasta.read_fasta(spark, path, duplicates="last"), "entry_id", "sequence") == [("P1", "GG"), ("P2", "CC")]
    assert rows(fasta.read_fasta(spark, path, duplicates="first"), "entry_id", "sequence") == [("P1", "AA"), ("P2", "CC")]
    with pytest.raises(Exception, match="conflicting rows for P1"):
        fasta.read_fasta(spark, path, duplicates="error").collect()


def test_annotations(spark, tmp_path, rows):
    text = "EntryID\tterm\taspect\nP1\tGO:1\tc\nP2\tGO:1\tBPO\nP3\tGO:1\tmf\nP4\tGO:1\tCCO\nP5\tGO:1\tunknown\n"
    found = rows(tables.read_annotations(spark, _write(tmp_path / "t.tsv", text)), "entry_id", "aspect")
    assert found == [("P1", "C"), ("P2", "P"), ("P3", "F"), ("P4", "C")]
    with pytest.raises(ValueError, match="aspect"):
        tables.read_annotations(spark, _write(tmp_path / "u.tsv", "EntryID\tterm\nP1\tGO:1\n"))


def test_term_weights_and_taxonomy(spark, tmp_path, rows):
    path = _write(tmp_path / "ia.txt", "GO:1 0.5\nGO:2 1.0\nGO:3\nGO:4 nan\n")
    assert rows(tables.read_term_weights(spark, path)) == [("GO:1", 0.5), ("GO:2", 1.0), ("GO:3", 0.0), ("GO:4", 0.0)]
    assert rows(tables.read_taxonomy(spark, _write(tmp_path / "tax.tsv", "P1\t9606\n P2 \t 10090\n"))) == [("P1", "9606"), ("P2", "10090")]
    assert tables.read_taxonomy(spark, str(tmp_path / "none.tsv")).count() == 0


def test_term_cells(spark, rows):
    df = spark.createDataFrame([(1, "['GO:3', 'X']"), (2, "GO:4; GO:5"), (3, None), (4, "go:6")], "id INT, go_terms STRING")
    assert rows(tables.explode_term_cells(df)) == [(1, "GO:3"), (2, "GO:4"), (2, "GO:5"), (4, "go:6")]
    with pytest.raises(ValueError):
        tables.explode_term_cells(spark.createDataFrame([(1,)], "id INT"))


def test_ontology(spark, tmp_path, rows):
    text = (
        "format-version: 1.2\n\n[Term]\nid: GO:0001\nnamespace: molecular_function\nis_a: GO:0003 ! root\n\n"
        "[Term]\nid: GO:0002\nnamespace: molecular_function\nrelationship: part_of GO:0001 ! x\nrelationship: regulates GO:0009 ! y\n\n"
        "[Term]\nid: GO:0003\nnamespace: molecular_function\n\n[Term]\nid: GO:0004\nnamespace: unknown\nis_obsolete: true\n\n"
        "[Term]\nid: GO:0005\nnamespace: other\n\n[Typedef]\nid: part_of\nis_a: GO:0003\n"
    )
    terms, edges = ontology.read_ontology(spark, _write(tmp_path / "g.obo", text))
    assert rows(terms.na.fill("-")) == [("GO:0001", "F"), ("GO:0002", "F"), ("GO:0003", "F"), ("GO:0005", "-")]
    assert rows(edges) == [("GO:0001", "GO:0003", "is_a"), ("GO:0002", "GO:0001", "part_of")]


def _atom(serial, name, residue, number, x, y, z, b, record="ATOM"):
    """One fixed-width atom row."""
    return f"{record:<6}{serial:>5} {name:^4} {residue:>3} B{number:>4}    {x:>8.3f}{y:>8.3f}{z:>8.3f}{1.0:>6.2f}{b:>6.2f}\n"


ATOMS = "".join(
    [_atom(1, "CA", "GLY", 11, 0.125, -3.5, 40.0, 88.5), _atom(2, "CB", "GLY", 11, 1.0, -3.0, 41.0, 88.5), _atom(3, "CA", "TRP", 12, -7.25, 2.0, 36.5, 61.25)]
)


def test_atoms(spark, tmp_path, rows):
    found = rows(structures.read_atoms(spark, _write(tmp_path / "P1.pdb", ATOMS)))
    assert found == [("P1", 0, 0.125, -3.5, 40.0, 88.5), ("P1", 1, -7.25, 2.0, 36.5, 61.25)]
    with pytest.raises(Exception, match="unreadable atom row"):
        structures.read_atoms(spark, _write(tmp_path / "P2.pdb", ATOMS.splitlines()[0][:40] + "\n")).collect()
    with pytest.raises(Exception, match="no CA atoms in model P3"):
        structures.read_atoms(spark, _write(tmp_path / "P3.pdb", "REMARK x\n")).collect()


def test_fragments(spark, rows):
    items = [
        {"uniprotAccession": "P12345-2", "modelEntityId": "m1", "sequenceStart": 1, "sequenceEnd": 3, "pdbUrl": "u1"},
        {"entryId": "E", "sequenceStart": 0, "uniprotStart": 4, "uniprotEnd": 5, "pdbUrl": "u2"},
        {"sequence": "MKV", "pdbUrl": "u3"},
    ]
    df = spark.createDataFrame([("P12345", json.dumps(items))], "entry_id STRING, metadata STRING")
    assert rows(structures.read_fragments(df)) == [
        ("P12345", "E", "E", "u2", 4, 5, 2), ("P12345", "P12345", "P12345", "u3", 1, 3, 3), ("P12345", "P12345-2", "m1", "u1", 1, 3, 3),
    ]
    for bad, text in (([{"sequenceStart": 5, "sequenceEnd": 2, "pdbUrl": "u"}], "invalid fragment bounds"), ([{"sequence": "A"}], "pdbUrl"), ([{"pdbUrl": "u"}], "neither")):
        with pytest.raises(Exception, match=text):
            structures.read_fragments(spark.createDataFrame([("P", json.dumps(bad))], "entry_id STRING, metadata STRING")).collect()


def test_fragment_files(spark, tmp_path, rows):
    item = {"uniprotAccession": "A", "modelEntityId": "m", "sequenceStart": 2, "sequenceEnd": 4, "pdbUrl": "u"}
    _write(tmp_path / "P5.json", json.dumps([item], indent=2))
    assert rows(structures.read_fragment_files(spark, str(tmp_path))) == [("P5", "A", "m", "u", 2, 4, 3)]


def test_manifest(spark, tmp_path, rows):
    record = {"entry_id": "P1", "embedding_path": "e.npy", "labels": [1, 0], "lengths": [3]}
    _write(tmp_path / "a_manifest.json", json.dumps([record, record]))
    _write(tmp_path / "b_manifest.json", json.dumps({"meta": {"aspect": "MF"}, "records": [record]}, indent=2))
    found = rows(manifests.read_manifest(spark, str(tmp_path)), "manifest", "record", "entry_id", F.element_at("labels", 1))
    assert found == [("a_manifest.json", 0, "P1", 1.0), ("a_manifest.json", 1, "P1", 1.0), ("b_manifest.json", 0, "P1", 1.0)]
    meta = manifests.manifest_meta(spark, str(tmp_path / "b_manifest.json")).first()["meta"]
    assert meta == {"aspect": "MF"}
    with pytest.raises(Exception, match="not a manifest"):
        manifests.read_manifest(spark, _write(tmp_path / "c.json", '"text"')).collect()


def test_array_ingest(spark, tmp_path, rows):
    np.save(tmp_path / "one.npy", np.arange(6.0).reshape(2, 3))
    np.savez(tmp_path / "two.npz", other=np.zeros(2), matrix=np.ones((1, 2)))
    np.savez(tmp_path / "three.npz", odd=np.ones(3))
    (tmp_path / "four.npy").write_bytes(b"junk")
    found = {r["artefact"]: r for r in arrays.ingest_arrays(spark, str(tmp_path)).collect()}
    assert found["one"]["shape"] == [2, 3] and found["one"]["values"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert found["two"]["values"] == [1.0, 1.0]
    assert found["three"]["values"] is None and "odd" in found["three"]["error"]
    assert found["four"]["error"]
    keyed = {r["artefact"]: r for r in arrays.ingest_arrays(spark, str(tmp_path), key="odd").collect()}
    assert keyed["three"]["values"] == [1.0, 1.0, 1.0]


def test_batch_plan_is_reused(spark, tmp_path):
    path, calls = str(tmp_path / "plan"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "batch_id BIGINT, pos BIGINT, entry_id STRING")

    assert sinks.read_batches(spark, path, build).count() == 2
    assert sinks.read_batches(spark, path, build).count() == 2
    assert len(calls) == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_batches(spark, str(tmp_path / "absent"))


def test_synthetic_is_independent_of_partitioning(spark, rows):
    one = rows(synthetic.synthetic_entries(spark, 50, seed=3).repartition(1))
    many = rows(synthetic.synthetic_entries(spark, 50, seed=3).repartition(7))
    assert one == many
    assert all(20 <= len(s) <= 60 and 1 <= len(t) <= 3 for _, s, t in one)
    assert one != rows(synthetic.synthetic_entries(spark, 50, seed=4))


def test_weight_vector(spark, tmp_path, rows):
    import numpy as np

    vocab = spark.createDataFrame([("GO:1", 0), ("GO:2", 1), ("GO:3", 2), ("GO:4", 3)], "term STRING, idx INT")
    np.savez(tmp_path / "w.npz", weights=np.array([0.5, np.nan, 2.0]), other=np.zeros(1))
    assert rows(tables.read_weight_vector(spark, str(tmp_path), vocab)) == [("GO:1", 0.5), ("GO:2", 0.0), ("GO:3", 2.0), ("GO:4", 0.0)]
    with pytest.raises(Exception, match="no weights in w"):
        tables.read_weight_vector(spark, str(tmp_path), vocab, "absent").collect()


def test_large_lists_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(5)
    pieces = ['"', "{", "}", "[", "]", "\\", "é", "\n", " ", '\\"', "a,b", "}{"]

    def record(i):
        tricky = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        return {"entry_id": f"{i}{tricky}", "labels": [float(i)], "meta": {"x": [{"y": tricky}, {}]}, "lengths": [i] * rng.randint(0, 9)}

    files = {"a.json": [record(i) for i in range(300)], "b.json": [], "c.json": [record(1)], "e.json": {"meta": {"k": "}]\"{"}, "records": [record(i) for i in range(40)]}}
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body, indent=rng.choice([None, 2]), ensure_ascii=False) + rng.choice(["", "\n"]))
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    assert manifests.manifest_pieces(spark, str(tmp_path / "a.json")).select("block").distinct().count() > 20
    ranged = sorted(map(str, manifests.read_manifest(spark, str(tmp_path)).drop("record_json").collect()))
    cut = tmp_path.parent / f"{tmp_path.name}-cut"
    cut.mkdir()
    for k, end in enumerate((-1, -40, 200)):
        broken = _write(cut / f"{k}.json", json.dumps(files["a.json"])[:end])
        with pytest.raises(Exception, match="not a manifest"):
            manifests.read_manifest(spark, broken).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    texts = spark.createDataFrame([(n, json.dumps(b)) for n, b in files.items()], "manifest STRING, text STRING")
    assert ranged == sorted(map(str, manifests.parse_manifests(texts).drop("record_json").collect()))
    assert len(ranged) == 341


def test_manifest_keeps_unknown_fields(spark):
    df = spark.createDataFrame([("m", '[{"entry_id": "a", "prior": {"index": 3}}]')], "manifest STRING, text STRING")
    row = manifests.parse_manifests(df).collect()[0]
    assert row["entry_id"] == "a" and json.loads(row["record_json"])["prior"]["index"] == 3


def test_batch_plan_path_and_reuse(spark, tmp_path):
    assert sinks.batch_plan_path("/d/train.json", 32) == "/d/train_batches_bs32"
    assert sinks.batch_plan_path("/d/train.json", 32, "plans", "val") == "/d/plans/val_batches_bs32"
    assert sinks.batch_plan_path("/d/train.json", 32, "/plans") == "/plans/batches_bs32"
    path, made = str(tmp_path / "plan"), []

    def build(size):
        made.append(size)
        return spark.range(6).selectExpr(f"id div {size} AS batch_id", f"id % {size} AS pos", "string(id) AS entry_id")

    for size, want in ((3, [3]), (3, [3]), (2, [3, 2])):
        assert sinks.read_batches(spark, path, lambda n=size: build(n), size).count() == 6
        assert made == want
    (tmp_path / "plan" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        sinks.read_batches(spark, path)


def test_a_batch_plan_belongs_to_its_entries(spark, tmp_path):
    path, made = str(tmp_path / "plan"), []

    def plan(rows, size, drop_last=False):
        df = spark.createDataFrame(rows, "entry_id STRING, length INT")

        def build():
            made.append(size)
            return df.selectExpr("0L AS batch_id", "0L AS pos", "entry_id")

        return sorted(r["entry_id"] for r in sinks.read_batches(spark, path, build, size, df, drop_last).collect())

    first = [("a", 3), ("b", 5), ("c", 5)]
    assert plan(first, 4) == plan(first[::-1], 4) == ["a", "b", "c"] and made == [4]
    for rows, size, drop in (([("a", 3), ("b", 4), ("c", 5)], 4, False), (first, 4, False), (first, 2, False), (first, 2, True), ([*first, ("c", 5)], 2, True)):
        before = len(made)
        plan(rows, size, drop)
        assert len(made) == before + 1, (rows, size)
    sinks.write_batches(spark.createDataFrame([(0, 0, "a")], "batch_id BIGINT, pos BIGINT, entry_id STRING"), path)
    assert plan(first, 4) == ["a", "b", "c"]  # one without a fingerprint is not trusted
    with pytest.raises(ValueError):
        sinks.read_batches(spark, path, None, None, spark.createDataFrame(first, "entry_id STRING, length INT"))


def test_concat_first_by_place(spark, rows):
    from termweave.operators import relational

    a = spark.createDataFrame([("x", "late", 2), ("x", "early", 1), ("y", "a", 3)], "entry_id STRING, v STRING, line INT")
    b = spark.createDataFrame([("x", "other", 0), ("z", "b", 1)], "entry_id STRING, v STRING, line INT")
    assert rows(relational.concat_first([a, b], order=["line"])) == [("x", "early"), ("y", "a"), ("z", "b")]
