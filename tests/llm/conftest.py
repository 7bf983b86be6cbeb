import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for on as with by at from this be or an it red green blue stone river house tree night light over under after before".split()


def prose(rnd, n, per_line=12):
    out = [rnd.choice(WORDS) + rnd.choice(["", "", "a", "er", "ing", "ed"]) for _ in range(n)]
    return "\n".join(" ".join(out[k : k + per_line]).capitalize() + "." for k in range(0, n, per_line))


@pytest.fixture(scope="session")
def texts():
    """Prose, exact and near copies, repeats, junk, nulls, empties and a very long text."""
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randint(30, 300)) for _ in range(40)]
    out = list(base)
    out += [base[0], base[0], base[1].upper(), base[2] + " more", base[3].replace("the", "a", 1)]
    for _ in range(25):
        words = base[4].split(" ")
        for _ in range(rnd.randint(1, 8)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append(" ".join(words))
    passage = prose(rnd, 70)
    out += [prose(rnd, 60) + "\n" + passage + "\n" + prose(rnd, 40) for _ in range(6)]
    out += [None, "", " \n\t ", "one", "three short words", "a b c d e", "%%% ### ***", "same line\n" * 40, prose(rnd, 40_000), "héé ß 日本語 🙂 " * 30]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(spark, texts):
    """Nulls in every column, repeated rows, and extra columns with names that operators use inside."""
    rows = [(None, None, None, None, None, "x", "y", 1, 2), (1, "one two three four five six", "en", None, 3, None, None, None, None)]
    rows += [(1, "one two three four five six", "en", None, 3, None, None, None, None), (2, texts[0], None, "s", 0, "n", "k", 5, 6), (None, texts[0], "en", "s", 0, "n", "k", 5, 6)]
    return spark.createDataFrame(rows, SCHEMA + ", node string, id string, kept int, key int")
