from __future__ import annotations

import random

import pytest

WORDS = "the of and lake stone river bright morning forest walk table seven quiet garden window letter under green winter summer paper cloud music street harbor candle mountain silver yellow engine".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Documents of every awkward kind: null, empty, blank, long, copies, near copies, shared passages and lines, other scripts."""
    rng = random.Random(4)
    passage, line = prose(rng, 80), prose(rng, 14)
    out: list[str | None] = [None, "", "  \n\t ", "one", "One two  three", "one two three", "é" * 300, "ab" * 400, "x" * 500 + " " + "x" * 500]
    base = [prose(rng, rng.randint(30, 200)) for _ in range(12)]
    out += base + base[:3]
    for text in base[:6]:
        words = text.split()
        for k in range(0, len(words), 45):
            words[k] = "changed"
        out.append(" ".join(words))
        out.append(text + " " + prose(rng, 6))
    out += [f"{prose(rng, 30)}\n{passage} {prose(rng, 20)}" for _ in range(4)] + [f"{line}\n{prose(rng, 25)}\n{line}" for _ in range(8)]
    out += ["".join(rng.choice("日本語テキスト ") for _ in range(400)), passage.upper(), f"{passage} {passage}", prose(rng, 9000)]
    wide = prose(rng, 60).split()
    for k in range(40):  # a group of near copies that are not copies of each other
        out.append(" ".join(wide[:k] + ["w" + str(k)] + wide[k + 1 :]))
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(order[k] + 1, t) for k, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with a repeated row and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, "k", 2.0) for i, t in texts]
    rows.append(rows[12])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gram int, key string, size double").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
