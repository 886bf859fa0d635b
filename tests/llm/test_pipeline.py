import pytest

from tests.llm.helpers import SCHEMA, rng
from tests.llm.test_models import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def made(spark, folder, n=40):
    r = rng(8)
    texts = [(i, prose(r, lang, 80) + f"\n{prose(r, lang, 20)}", lang, f"s{i % 3}") for i, lang in enumerate(["aa", "bb", "cc"] * n)]
    item = prose(r, "aa", 30)
    texts.append((500, "12 34 !", "aa", "s0"))  # no language
    texts.append((501, texts[4][1], "bb", "s1"))  # a copy: all its lines go
    words = texts[6][1].replace("\n", " ").split(" ")
    texts.append((502, " ".join(words[:50] + ["kamilo"] + words[51:]), "aa", "s1"))  # a near copy, on one line
    texts.append((503, prose(r, "aa", 40) + " " + item + " " + prose(r, "aa", 40), "aa", "s2"))  # a test item
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_every_stage_decides(spark, tmp_path):
    made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in (docs, out))
        gone[name] = before - after
        out.write.parquet(f"{tmp_path}/{len(gone)}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{len(gone)}.parquet")
    assert gone == {"language ID": {500}, "line dedup": {501}, "near dedup": {502}, "decontamination": {503}}
    assert docs.count() == 120
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(mixed) == 120 and sum(r.taken for r in mixed) > 0.9 * sum(r.size for r in mixed)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))


def test_every_stage_like_brute_force(spark, tmp_path):
    """Each stage beside a plain restatement of what it decides, on what the stage before kept."""
    import duckdb

    from tests.llm import test_decontaminate, test_lines, test_minhash
    from waymill.llm.decontaminate import ERROR_RATE, normalise
    from waymill.llm.langid import train_on_documents
    from waymill.llm.mixing import OP4_SQL

    made(spark, tmp_path, 14)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        if name == "language ID":
            model = train_on_documents(docs)
            expected = {}
            for i, t in texts.items():
                (bits,), (letters,) = model.entropies([t])
                best = int(bits.argmin())
                if letters and bits[best] <= model.centre[best] + model.tolerance * model.spread[best] / letters**0.5:
                    expected[i] = t
        elif name == "line dedup":
            left = dict(test_lines.brute(list(texts.items())))
            expected = {i: t for i, t in left.items() if t.strip() or not texts[i].strip()}
        elif name == "near dedup":
            labels = test_minhash.brute(list(texts.items()))
            expected = {i: t for i, t in texts.items() if labels[i] == i}
        else:
            (item,) = (normalise(r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect())
            expected = {i: t for i, t in texts.items() if test_decontaminate.least(item, normalise(t)) > int(len(item) * ERROR_RATE)}
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = texts = {r.doc_id: r.text for r in docs.collect()}
        assert texts == expected, name
    assert len({len(x) for x in kept.values()}) == 4  # every stage drops something
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/decontamination/*.parquet')")
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, mixed)) == sorted(tables.execute(OP4_SQL).fetchall())


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "mixing"]
    assert len([q for q in entry.queries() if q.startswith("op")]) == 10


@pytest.mark.parametrize("texts", [[], [(None, None), (1, None), (2, ""), (3, " \t\n")], [(7, "ka lo mi\nka lo mi")] * 3 + [(None, "ka lo mi ne"), (8, "ka lo " * 20_000), (9, "x" * 50_000)]])
def test_odd_tables(spark, tmp_path, texts):
    """Empty tables, nulls everywhere, repeated rows, very long words and texts, and columns with names of our own."""
    rows = [(i, t, None, None, None) for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS chunk", "'x' AS blob", "2 AS label", "3 AS size", "4 AS score", "5 AS n_words", "6 AS answers", "7 AS rep")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "ka lo mi ne"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert len(found) <= len(rows), name
        if name != "mixing":
            assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []  # nothing to learn a language from
    import __spark_entry__ as entry

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in ("op2_langid", "op4_mixing", "op6_near_dups", "op7_substrings", "op9_line_dedup", "op10_toxicity"):
        assert entry.queries()[query](spark, str(tmp_path)).count() == len(rows), query
