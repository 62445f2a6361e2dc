"""Long candidates and many matches in one text take linear work and don't end the JVM."""

import time

import pytest

from promptquarry.llm import secrets

TEXTS = {
    "kebab": ("ab-" * 330_000, 0, 0, 0),
    "path": ("/usr/Lib" * 120_000, 0, 0, 0),
    "numbered": ("Ab_cd_" * 160_000 + "123", 0, 0, 0),
    "many": ("password=abcdef12 " * 100_000, 100_000, 0, 0),
    "hex": ("0a1b2c3d0a1b2c3d0a1b2c3d " * 5_000, 0, 5_000, 5_000),
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_long(name, spark):
    text, *expected = TEXTS[name]
    began = time.time()
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [row["n_assign"], row["n_hex"]] == expected[:2] and time.time() - began < 60
    spans = [tuple(s.split(":")) for s in row["spans"].split(",") if s]
    if name == "many":
        assert [s for s in spans if s[0] == "assign"] == [("assign", str(18 * i), str(18 * i + 17)) for i in range(100_000)]


def test_forms_agree():
    """Possessive groups match what plain ones do."""
    import random
    import re

    r = random.Random(3)
    for plain, java in zip(secrets.ALLOWED, secrets.ALLOWED_JAVA):
        for _ in range(20_000):
            text = "".join(r.choice(["a", "b", "A", "-", "_", "/", "1", "+"]) for _ in range(r.randint(1, 12)))
            assert bool(re.search(plain, text)) == bool(re.search(java, text)), (plain, text)
