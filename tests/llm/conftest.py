import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _mark string, base string, n long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeéf") for _ in range(r.randint(1, 7))) for _ in range(n))


def rows() -> list[tuple]:
    """Documents with nulls, repeated rows, empty and long texts, near copies, and columns that operators might use."""
    r = random.Random(5)
    texts = [words(r, r.randint(1, 90)) for _ in range(60)]
    for k in range(12):  # near copies, longer ones first
        w = texts[k].split()
        w[len(w) // 2 : len(w) // 2 + 1] = ["other"]
        texts.append(" ".join(w) + (" tail" if k % 2 else ""))
    for k in range(20, 30):  # copies that differ in a word at their end
        texts.append(texts[k] + " end")
    texts += [texts[3], texts[3], texts[3].upper(), " \n\t ", "", "one", "one two three four", "É é \x00 ünï", words(r, 12_000), "a" * 3000, "ab " * 2000]
    out = [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts)]
    out += [(200, None, "en", "s0"), (None, texts[5], "en", "s0"), (None, None, None, None), (7, texts[7], "en", "s0"), (7, texts[7], "en", "s0"), (8, "another text of the same number " * 3, "fr", "s1")]
    r.shuffle(out)
    return [(*x, None if x[1] is None else len(x[1]), "k", "m", "b", 1) for x in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
