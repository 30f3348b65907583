from __future__ import annotations

import pytest

# Columns beside the documents' own, with names that operators use inside.
EXTRA = "class long, n int, part string, key string, token string, rank int, kind string, row_key long, `__key` string, halo boolean"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture
def documents(rows):
    """``documents([(id, text) or (id, text, lang)])`` with clashing extra columns; some of them null."""

    def make(pairs):
        data = []
        for i, (doc_id, text, *lang) in enumerate(pairs):
            data.append(
                (doc_id, text, lang[0] if lang else None, "s" if i % 2 else None, len(text) if text else None,
                 i, None, "p", None, "t", i, "k", i, "x", None)
            )
        return rows(DOCUMENTS, data)

    return make


LONG = "alpha beta gamma delta epsilon zeta eta theta " * 30_000


@pytest.fixture
def odd_documents(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return documents(
        [
            (1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten"),
            (2, None), (3, ""), (4, LONG), (None, "one two three four five six seven eight nine ten"), (None, None),
            (5, " \n\t"), (6, "\U0001f600 é ß 漢字"), (7, "a"), (7, "a"),
        ]
    )


@pytest.fixture
def no_documents(documents):
    return documents([])
