import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_rows as cases  # noqa: E402


@pytest.fixture(scope="session")
def corpus(spark):
    """The awkward table, with columns of clashing names."""
    from tillroll.llm.common import prepare

    prepare(spark)
    return cases.table(spark, cases.rows(), clashing=True).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return cases.table(spark, [])


@pytest.fixture
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
