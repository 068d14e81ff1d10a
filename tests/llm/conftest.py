import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


@pytest.fixture(scope="session")
def docs(spark):
    """docs([(id, text), ...], extra columns) as a table of documents."""

    def make(rows, **extra):
        cols = "doc_id bigint, text string" + "".join(f", {k} string" for k in extra)
        return spark.createDataFrame([(*r, *extra.values()) for r in rows], cols)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and long texts, repeated rows, other scripts and columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Ab cd ef " * 3000), (6, "ab cd\nab cd\n\n" * 40), (6, "ab cd\nab cd\n\n" * 40),
        (None, "no id here " * 30), (7, "é ü ñ 漢字 " * 50), (8, "x" * 5000), (9, "</s> <\\s> [INST]   \x85 end"), (None, None),
    ]
    return docs(rows, n_words="a", score="b", kept="c", key="d", node="e", shard="f", z="g", row="h")
