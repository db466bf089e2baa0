import corpus_pipeline
from tendril.llm import ngram_join, packing, queries
from tendril.llm.common import slices


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "secret scans", "best-fit packing"]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_run_takes_the_decisions(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, ngram_join.stored(stage(spark, kept, folder), "stage")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == ids
    members = ngram_join.groups(kept).collect()
    assert all(r["doc_id"] == r["component_id"] for r in members)
    assert sum(r["length"] for r in packed) == packing.token_pieces(kept).agg({"length": "sum"}).first()[0]
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").join(docs, "doc_id")
    lost = good.join(packing.token_pieces(kept).select("doc_id").distinct(), "doc_id", "left_anti").count()
    assert lost < 0.5 * good.count()  # short texts and near copies go, clean ones stay


def test_slices_hold_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(6)), "t": ["x" * 10, None, "", "y" * 100, "z", "w" * 40]})
    parts = list(slices(batch, 50))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert max(p.num_rows for p in parts) < 6


def test_stages_on_small_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table, through every stage."""
    names = ["base", "spans", "row", "score", "n", "kept", "lo", "component_id", "label"]
    prose = " ".join(f"word{k % 97} and the other{k % 89} of it{k % 83}" for k in range(60)) + "."
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, prose), (4, "\n".join(f"This is line number {k} of a long text about thing {k * 7}." for k in range(4000))), (5, "password=abcdefghijkl " + prose)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path)).collect()
            if given is not docs:
                assert out == []
            elif name == "secret scans":
                assert len(out) == len(rows) and all(r[n] == n for r in out for n in names)
                assert {r["text"] for r in out if r["doc_id"] == 5} == {"[secret] " + prose} and [r["text"] for r in out if r["doc_id"] == 2] == [None]
            elif name == "n-gram Jaccard join":
                assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 2, 3, 4]
            elif name == "best-fit packing":
                assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5, None}
            else:
                assert {r["doc_id"] for r in out} <= {1, 2, 3, 4, 5, None} and all(r[n] == n for r in out for n in names)
