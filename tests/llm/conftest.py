import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table like ``documents`` from texts, (id, text) or (id, text, lang) tuples."""

    def make(*rows, schema=SCHEMA):
        full = []
        for number, row in enumerate(rows):
            own, text, lang = (number, row, None) if row is None or isinstance(row, str) else (*row, None)[:3]
            full.append((own, text, lang, "src", None if text is None else len(text)))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def clashing(spark):
    """Adds columns named like those that the operators use themselves."""
    names = ("id", "row", "text_", "fp", "k", "key", "component", "spans", "items", "ids", "kept", "measures", "slot", "shard", "n_words", "own", "root", "n", "s", "d", "pattern", "lookup")

    def make(table):
        return table.selectExpr("*", *[f"'x' as `{n}`" for n in names])

    return make
