from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest string, part int, bucket int, _gone long, queue string, anchor long, shard long"


def corpus(seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeated rows, nulls, blanks, odd characters and ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts: list[str | None] = [prose(rng.randint(1, 120)) for _ in range(30)]
    passage = prose(60)
    texts += [f"{prose(5)} {passage} {prose(9)}" for _ in range(6)]
    texts += [texts[0], texts[0].upper(), texts[1] + " tail", None, "", "   ", "one", "two words", "été É \U0001f600" * 9, "a" * 700, passage[:99], "x  y\n\n z\t w", passage + passage]
    texts += [texts[3].replace(" ", "  ")] + [prose(200) + "\n" + prose(3)] * 3
    rows = [(i * 7 % 101, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", "src12", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [(*r, "f", "d", 1, 2, 3, "q", 4, 5) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts() -> dict[int, str]:
    return {r[0]: r[1] or "" for r in corpus()}


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
