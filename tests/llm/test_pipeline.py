import re

import corpus_pipeline
from rarefold.llm import mixing, packing, quality, simhash, tokens


def test_each_stage_against_its_operator(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
            assert out.select("doc_id", "text").exceptAll(docs.select("doc_id", "text").union(docs.select("doc_id", "text"))).count() == 0 or name == "mixture"
        kept[name] = (docs, out)
        docs = out
    before, after = kept["quality"]
    machine = quality.train(before, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, machine).where("predicted = 1").collect()}
    assert good == {r.doc_id for r in after.collect()}
    before, after = kept["language"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert len(gone) <= 0.02 * before.count()
    before, after = kept["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in simhash.near_duplicates(before).collect()})
    before, after = kept["mixture"]
    assert after.count() == mixing.mix(before).count()
    before, after = kept["packing"]
    assert after.agg({"length": "sum"}).first()[0] == tokens.encoded_lengths(before, tokens.tokenizer_path(), 1).agg({"length": "sum"}).first()[0]
    assert packing.CAPACITY == 2048


def test_awkward_rows_pass_every_stage(spark, docs, no_docs, tmp_path):
    d = "/root/testdata/sf0.001"
    for k, start in enumerate((docs, no_docs)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, d)
            if name == "near_duplicates":
                left = out.collect()
                assert len({(r.doc_id, r.text) for r in left}) == len(left)
            if name != "packing":
                assert out.columns == start.columns
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            now = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (now.count() == 0) == (k == 1)


def test_mixture_keeps_rows_that_differ_in_any_column(spark):
    """Two sources of equal size take every row once: null, clash and repeat cases come out as they went in."""
    rows = [(1, None, "en", "x"), (2, "y", "en", "x"), (2, "y", "de", "x"), (1, "x", "en", None), (3, "z", None, None), (3, "z", None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.mixture_stage(spark, table, "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)


def test_duplicate_stage_chooses_by_the_whole_row(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(5, text, "en"), (5, text, "de"), (None, text, "en"), (7, text, "en"), (None, "", "en"), (None, None, "de"), (None, None, "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = [sorted(map(tuple, corpus_pipeline.duplicate_stage(spark, table.repartition(n), "").collect()), key=str) for n in (1, 5)]
    assert left[0] == left[1] and len(left[0]) == 2 and [r[0] for r in left[0]] == [5, None]


def test_registered_names(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert sorted(int(m[1]) for x in names if (m := re.match(r"op(\d+)_", x))) == list(range(1, 14))
    assert "pipeline" in names
