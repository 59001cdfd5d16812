from __future__ import annotations

import random

import pytest

WORDS = [f"w{n}" for n in range(400)] + ["Été", "straße", "ñu", "a", "the", "of"]


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t "]) for _ in range(n))
