import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, fp string, cell int, score double, bucket int, url string, rule string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and blank texts, ties, repeats, one very long text, and extra columns with names that operators use."""
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two three four five six seven"),
        (None, None), (7, "Mail me at a.b@c.org or +1 555 123 4567.\nReleased under the MIT License."), (8, "🙂 ünï \x00 codé\x1c # # #"),
        (9, "lorem ipsum dolor sit amet " * 20_000), (10, "lorem ipsum dolor sit amet " * 20_000),
    ]
    rows = [(i, t, None if k % 3 == 0 else "en", "s", None, "x", "y", k, 0.5, 3, "u", "r") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


class Sets:
    """Union-find for brute-force components."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture
def sets():
    return Sets
