import pytest

#: Texts at the edges: null, empty, blank, repeated rows, near copies, shared passages, other scripts.
BASE = " ".join(f"word{i}" for i in range(120))
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def rows():
    out = [(1, BASE), (2, BASE), (3, BASE.replace("word60", "other")), (4, f"intro a b {PASSAGE} outro c"), (5, f"{PASSAGE} tail"), (6, None), (7, ""), (8, "  \t\n "), (9, "three little words"),
           (10, "three little words"), (11, "Straße naïve 中文字 ́x\U0001F600"), (12, "<|endoftext|> it's we'll 12 345 don''t"), (13, "x" * 5000), (14, "la " * 3000), (14, "la " * 3000), (15, BASE.upper())]
    return out + [(100 + i, " ".join(f"t{(i * 7919 + j * (i % 13 + 1)) % 977}" for j in range(20 + 5 * i))) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names clash with what operators return
    extra = [(*r, "en", i, float(i), "x") for i, r in enumerate(rows())]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, n_words int, score double, ids string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")
