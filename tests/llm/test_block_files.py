"""Count blocks lie few to a file, as a reader decodes whole files of so few rows at once."""

from undula.llm import importance


def test_files_hold_few_blocks(spark, monkeypatch):
    held = []
    real = importance.materialize
    monkeypatch.setattr(importance, "FILE_BLOCKS", 3)
    monkeypatch.setattr(importance, "materialize", lambda df, *most: held.append(real(df, *most)) or held[-1])
    rows = [(i, "some words of text " * 60_000) for i in range(7)]  # a block each
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = importance.resample(docs, docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(7)) and {r.n_features for r in got} == {2 * 240_000 - 1}
    files = held[0].inputFiles()
    assert held[0].count() == 7 and len(files) == 3
    assert all(spark.read.parquet(f).count() <= 3 for f in files)
