import pytest
from pyspark.sql import functions as F

LONG = "lang text of many words " * 8000
ROWS = [
    (1, "One two three four five six seven. " * 12, "en", "a", 10),
    (1, "One two three four five six seven. " * 12, "en", "a", 10),
    (2, "One two three four five six seven. " * 12, "en", "b", 10),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (5, " \t\n\x0b\x0c\r ", None, "a", 7),
    (6, LONG, "de", "a", len(LONG)),
    (7, "x" * 30_000, "de", "b", 30_000),
    (None, "Ünï cödé   tëxt 😀 token = \"0123456789abcdef01\"", "fr", None, 3),
    (None, None, "fr", "c", None),
    (8, "single", "en", "c", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = (
    "fingerprint component component_id size source_size target copies secrets statistics score "
    "n_words n_tokens n_symbols kept distance base_failed text_hash _row _doc"
).split()


@pytest.fixture
def odd(spark):
    """Null, empty and long texts, repeated rows and columns with clashing names."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture
def none(odd):
    return odd.limit(0)
