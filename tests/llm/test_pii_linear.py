"""The finders and transducers of op5 on long repetitive texts, and against the plain patterns."""

import random
import re
import time

import pytest

from loomfield.llm import pii

SHAPES = {
    "numbers after a word": "one " + "12 34 " * 160_000, "numbers before a word": "12 34 " * 160_000 + "one", "bars": "|" * 1_000_000, "blanks beside a sign": "@" + " " * 1_000_000 + "@",
    "bars and letters": "O|" * 500_000, "bars, letters, digits": "O|1" * 330_000, "words for times": "double " * 140_000, "signs apart": "a @ b" * 200_000, "numbers apart": "1 . " * 250_000,
    "signs in brackets": "[at]" * 250_000, "spelled": "one " * 250_000, "commas": "one" + "," * 1_000_000, "blanks around at": (" " * 50 + "at") * 19_000,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_a_megabyte_takes_seconds(shape):
    began = time.process_time()
    pii.spans(SHAPES[shape])
    assert time.process_time() - began < 8  # about 2 on a slow machine; quadratic ones took minutes to hours


WORD = rf"(?:(?:{'|'.join(pii.TIMES)})\x20+)?(?:{'|'.join(pii.SPELLED)})"
PLAIN_SPELLED = re.compile(rf"(?i)\b(?:[0-9]+[\x20,-]+)*{WORD}\b(?:[\x20,-]+(?:{WORD}\b|[0-9]+))*")
PLAIN_LIKES = re.compile(r"(?<![A-Za-z0-9])(?=[OolI|]*[0-9])(?=[0-9]*[OolI|])[0-9OolI|]+(?![A-Za-z0-9])")
PARTS = ["one", "two", "oh", "double", "triple", "12", "3", "0", "O", "o", "l", "I", "|", "||", " ", "  ", ",", "-", "a", "x_", "_", "é", "٣", "½", ".", "+"]


def test_walks_find_what_the_patterns_do():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        assert [(a, z) for a, z, _ in pii._likes(t)] == [m.span() for m in PLAIN_LIKES.finditer(t)], t
        long = [m.span() for m in PLAIN_SPELLED.finditer(t)]
        assert [(a, z) for a, z, _ in pii._spelled(t)] == [x for x in long if (x in [(a, z) for a, z, _ in pii._spelled(t)])], t
        assert {(a, z) for a, z, _ in pii._spelled(t)} <= set(long), t
        for a, z in set(long) - {(a, z) for a, z, _ in pii._spelled(t)}:  # shorter than three digits
            assert len(re.findall(r"[0-9]", t[a:z])) < 3
