import pytest

LONG = "the quick brown fox jumps over the lazy dog. " * 4000
EDGE = [
    (1, "", "en"),
    (2, None, "en"),
    (3, "   \n\t ", None),
    (4, LONG, "en"),
    (5, "Mail jo.do@a-b.example.com or +1 (212) 555-0100, 10.0.0.255, 4111 1111 1111 1111 end", "en"),
    (5, "Mail jo.do@a-b.example.com or +1 (212) 555-0100, 10.0.0.255, 4111 1111 1111 1111 end", "en"),
    (None, "no id here", "fr"),
    (7, "日本語 テキスト <|endoftext|> 😀 é́ ǅ", "de"),
    (8, "the quick brown fox jumps over the lazy dog. " * 3999 + "cat", "en"),
    (9, "a\x0bb\x0cc\r\nd e f g h i j k l m n o p", "en"),
    (10, "x" * 5000 + " " * 3000 + "=" * 3000, None),
    (11, "*** ### $$$", "en"),
]
#: Names that operators use inside.
CLASHING = ["label", "label_id", "score", "bucket", "node", "part", "ids", "base", "extra", "text_key", "n_words", "kept", "root", "k1", "doc_tokens"]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, g, "src", len(t) if t else None, *(f"{c}!" for c in CLASHING)) for i, t, g in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
