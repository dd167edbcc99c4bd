import random

import numpy as np
import pytest


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(7)


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(4000)]
