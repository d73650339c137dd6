"""Registered queries: SQL where there is some, contracts elsewhere, and the pipeline against its parts."""

import hashlib
from collections import Counter

import pytest
from compare import difference, duck

import __spark_entry__ as entry
import corpus_pipeline
from sitewright.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    got = queries.JOBS[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(queries.SQL[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in queries.JOBS if n not in queries.SQL])
def test_one_row_per_input_row(spark, con, name):
    table = "pages" if name.startswith("op4") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = queries.JOBS[name](spark, FOLDER).toPandas()
    assert sorted(got[key]) == sorted(con.execute(f"select {key} from {table}").df()[key])


def test_thirteen_operators_and_the_pipeline():
    numbers = Counter(int(n[2:].split("_")[0]) for n in queries.JOBS)
    assert numbers == Counter(range(1, 14))
    assert set(queries.JOBS) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark, con):
    from sitewright.llm import decontaminate, pieces
    from sitewright.llm.registry import tokenizer_file

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(docs.toPandas(), before.schema)  # as if written and read again
        assert docs.columns == given, name
        assert docs.exceptAll(before).count() == 0 or name == "line_dedup"
    assert decontaminate.contained_items(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    model = pieces.PieceModel(tokenizer_file())
    want = {
        (r.doc_id, hashlib.sha256(",".join(map(str, model.encode(r.text))).encode()).hexdigest()) for r in docs.collect()
    }
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(got) < 200
