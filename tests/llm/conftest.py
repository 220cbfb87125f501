import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"word{k % 977}x{k // 977}" for k in range(60_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, equal ids."""
    near = [f"near copy of one text number with many common words {' '.join(f't{j}' for j in range(80))} end{k}" for k in range(4)]
    texts = [
        None, "", " \t\n", "one", "one  two\nthree", "one two\tthree", "one two three", LONG, LONG, f"first {PASSAGE} tail a b c", f"second start {PASSAGE} other end", *near,
        "Ünï çödé text über alles ünd noch mehr", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "line one of five words\nline two of five words\nunique ending here now",
        "other beginning of text\nline one of five words\nline two of five words",
    ]
    out = [(k, t, "en", ["a", "b", None][k % 3], k % 2) for k, t in enumerate(texts)]
    return [*out, (3, "one", "en", "a", 1), (3, "one", "en", "a", 1), (4, "a different text with an old id", None, None, None), (None, "no id at all", "en", "a", 0), (None, None, None, None, None)]


#: Columns that operators add or use themselves.
CLASH = ["row", "key", "n", "marks", "spans", "items", "n_words", "n_removed", "kept", "size", "target", "taken", "score", "n_tokens", "label", "digest", "fp", "component_id", "keep_id", "_salt", "_hash", "_d", "own_0"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id LONG, text STRING, lang STRING, source STRING, n_chars INT").coalesce(3)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [("i1", "shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13"), ("i2", "ONE two"), ("i3", None), ("i4", ""), ("i5", "never seen words in any of the texts of this fixture at all"), ("i2", "ONE two"), (None, "über alles")]
    return spark.createDataFrame(items, "item_id STRING, text STRING")
