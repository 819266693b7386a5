import numpy as np
import pytest

LONG = " ".join(f"word{i}" for i in range(400_000))


@pytest.fixture(scope="session")
def odd():
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(["la", "le", "Un", "do", "ka", "re", "ti"], 60)) for _ in range(12)]
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \t\n", None), (4, "One two", "b"), (5, "one  TWO", "b"), (6, "one two", "b"), (7, "x", "c"), (8, "x", "c"), (8, "x", "c"), (None, "x", "c"), (None, None, None), (9, LONG, "b")]
    rows += [(100 + 10 * i + k, b if not k else b.replace("la", "LA", k) + " end" * k, f"s{i % 3}") for i, b in enumerate(base) for k in range(4)]
    rows += [(500 + i, base[0] + f" tail{i}", "hot") for i in range(60)] + [(900 + i, base[1], "hot") for i in range(40)]
    return rows
