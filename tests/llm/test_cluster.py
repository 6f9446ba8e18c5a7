"""The corpus queries on a cluster whose shared folder has a plain path, as that of a mount is."""

import random

import corpus_rows as cases
import pytest

import corpus_pipeline
from tillroll.llm import registry

QUERIES = registry.QUERIES | {"pipeline": corpus_pipeline.run}
DOCUMENTS = cases.unique(cases.rows())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    pages = [
        (i, f"https://a.org/{i}", f"<body><nav>Home</nav><p>{cases.prose(rng, 40)}</p></body>")
        for i in range(12)
    ]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(150)]
    tables = {
        "documents": (DOCUMENTS, cases.SCHEMA),
        "benchmark": ([(1, "th er on")], "item_id long, text string"),
        "pages": (pages, "page_id long, url string, html string"),
        "embeddings": (vectors, "vec_id long, embedding array<double>, label int"),
    }
    out = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ("op2_language_id", "op10_fingerprints")])
def test_queries_run(cluster, folder, name):
    rows = QUERIES[name](cluster, folder).count()
    given = {"op13_html_text": 12, "op11_hard_negatives": None, "op9_packing": None, "pipeline": None}
    assert rows > 0 and given.get(name, len(DOCUMENTS)) in (None, rows)
