import math
import random

import pytest


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def close():
    return lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
