import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
    return make


@pytest.fixture
def prose():
    """Deterministic invented prose: prose(n_words, seed)."""
    vocabulary = ["".join(random.Random(i).choices("abcdefghilmnoprstuv", k=random.Random(-i).randint(2, 8)))
                  for i in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
