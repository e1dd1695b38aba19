import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, s int, spans string, _items string, host string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, repeated words, odd white space, special strings, nulls and empty ones."""
    rng = random.Random(4)
    words = [f"{rng.choice('abcdefgh')}{rng.choice(['är', 'on', 'ti', 'ing', 'é'])}{rng.randrange(40)}" for _ in range(120)]
    out = [prose(rng, rng.randrange(1, 160), words) for _ in range(24)]
    passage = prose(rng, 60, words)
    out += [f"{prose(rng, 30, words)} {passage} {prose(rng, 20, words)}" for _ in range(4)]
    base = prose(rng, 120, words).split(" ")
    for k in range(4):
        copy = list(base)
        copy[10 + 9 * k] = f"edit{k}"
        out.append(" ".join(copy))
    out += [out[3], out[3], "the " * 90, "the " * 140 + "end", "x", "", None, None, "  \n\t ", "a b\x0b\x0cc\x1cd e f", "<|endoftext|> It's I'LL 12 naïve é <|startoftext|>x"]
    out += [(prose(rng, 31, words) + " ") * 4, "z" * 1500, "line\nline\nother\nline\n" * 5, prose(rng, 6000, words)]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """With nulls in every column, an id twice, and a row repeated."""
    out = [(k, x, "en", f"src{k % 3}", len(x or ""), "k", 1, "sp", "it", "h") for k, x in enumerate(texts)]
    out[5] = (None, texts[5], None, None, None, None, None, None, None, None)
    out.append(out[7])
    out.append((8, texts[9], "en", "src1", 3, "k", 1, "sp", "it", "h"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
