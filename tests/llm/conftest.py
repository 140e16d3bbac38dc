import pytest
from planted import make, prose

@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and blank texts, copies, near copies, shared passages, one long text."""
    base, shared = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "changed"
    return [
        base,
        None,
        "",
        " \t\n ",
        "one",
        "one two",
        base,
        " ".join(near),
        prose(3, 40) + "\n" + shared + "\n\n" + prose(4, 30),
        prose(5, 20) + " " + shared,
        shared.upper() + " É ü ß",
        prose(6, 30_000),
        " leading  double\r\nspaces \x0b and\ttabs  ",
        "one two",
        (None, base),
        (6, base),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    return make(spark, edge_texts).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("doc_id = -1")
