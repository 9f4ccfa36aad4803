import pytest

from merchloom.llm.queries import vocabulary

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())
