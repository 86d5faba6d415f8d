"""The pipeline against its stages in plain Python, and the registered queries."""

import re
import sys
from pathlib import Path

import pytest
import sentencepiece
from llm_frames import edited, near_components, prose, repeats

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

from ferrybook.llm.sentence_pieces import MODEL  # noqa: E402


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(700 + i, 30, words=5000)) for i in range(5)]
    shared = prose(800, 60, words=5000)
    rows = []
    for i in range(60):
        text = prose(i, 150, words=800)
        if i % 10 == 3:
            text = f"{text} {items[i % 5][1]} {text[::-1]}"
        if i % 10 == 5:
            text = f"{prose(i, 70)} {shared} {prose(i + 900, 60)}"
        rows.append((i, text))
    rows += [(100 + i, edited(rows[i][1], i, 2)) for i in range(8)]
    rows += [(120 + i, " ".join(f"{w}$$ |" for w in prose(i, 80).split())) for i in range(10)]
    rows += [(140, "too short"), (141, None), (142, rows[0][1])]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    write(spark, path, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(60)]
    write(spark, path, "labels", labels, "doc_id long, quality int, toxic int")
    write(spark, path, "benchmark", items, "item_id long, text string")
    return path, rows, items


def tokens(text):
    return re.findall(r"[0-9a-z]+", text.lower())


def test_run_equals_plain_stages(spark, small):
    path, rows, items = small
    texts = {i: t for i, t in rows if i < 120 or i == 142}  # quality rules
    groups = near_components(list(texts.items()), 80)
    texts = {i: texts[i] for i, (_, c) in groups.items() if i == c}
    left = repeats(list(texts.items()), 200, True)
    texts = {i: left[i][3].decode("utf-8", "ignore") for i in texts}
    runs = {tuple(tokens(t)[j : j + 13]) for _, t in items for j in range(len(tokens(t)) - 12)}
    clean = {
        i: t
        for i, t in texts.items()
        if not runs & {tuple(tokens(t)[j : j + 13]) for j in range(len(tokens(t)) - 12)}
    }
    assert 0 < len(clean) < len(texts) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {i: library.encode(t) for i, t in clean.items()}


def test_stages_return_the_columns_of_documents(spark, small):
    path, _, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 14)) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n.startswith("op")))
def test_queries_equal_sql(spark, sf_dir, duck, name):
    got = queries()[name](spark, sf_dir)
    rows = duck(sf_dir).sql(oracle_sql()[name]).select(*(f'"{c}"' for c in got.columns)).fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.collect())
