from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sigs string, spans string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of", "and"]
    line = " ".join(rng.choices(vocab, k=60))
    texts = [None, "", " \t\n", "one", "A b c", line, line, line.upper(), line + " extra tail words", " ".join(rng.choices(vocab, k=30000)), "x" * 50000, "same\nsame\n\nsame other", "é ü ñ — 東京   nbsp", "word " * 400]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 90))) for _ in range(40)]
    base = " ".join(f"t{i}" for i in range(120))
    texts += [base.replace(f"t{i} ", f"z{i} ", 1) for i in range(1, 60, 3)]
    rows = [(i * 3 + 1, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "clash", None) for i, t in enumerate(texts)]
    rows += [(None, line, None, None, None, None, None), (None, None, None, None, None, None, None), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
