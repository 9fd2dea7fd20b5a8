import random

import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n int, band string, hits long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null keys and texts, empty and very long texts, repeated rows, columns with clashing names."""
    words = random.Random(7)
    long_text = " ".join(words.choice(["the", "river", "of", "words", "runs", "été", "7", "x@y.zz"]) for _ in range(30_000))
    rows = [(1, None, "en"), (2, "", "en"), (None, "a lone text without a key", None), (3, "short", "de"), (3, "short", "de"),
            (4, long_text, "en"), (5, "z" * 60_000, "fr"), (6, "  \n\t ", "en"), (7, "日本語のテキスト 🎉", None), (8, "1234567 89", "es")]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", 1, "y", 2) for i, t, lang in rows], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def copies():
    """Texts with shared passages, near and exact copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(120) for _ in range(4)] + ["aa " * 300]
    out = []
    for i in range(40):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                w = p.split(" ")
                w[rng.randrange(len(w))] = "ZZ"
                p = " ".join(w)
            t += p[rng.randint(0, 100):] + text(rng.randint(0, 10))
        out.append((i, t))
    base = text(150).split(" ")
    for i in range(60, 90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = "q"
        out.append((i, " ".join(w)))
    return out + [(95, None), (96, ""), (97, "y" * 1000), (98, "y" * 1000), (99, out[3][1])]
