"""Matching blocks by runs against difflib, and long texts that pairs of characters would take too long for."""

import random
import time
from difflib import SequenceMatcher

from corpusmill.functions import matching as M


def odd_pairs():
    rnd = random.Random(3)
    for n in range(1500):
        alphabet = rnd.choice(["ab", "abc", "abcdefgh", "the law of sea ,.XYZ0123456789", "".join(chr(0x4E00 + i) for i in range(500)), "é\U0001f600ab\n"])
        a = [rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 5, 30, 199, 200, 201, 600]))]
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            p = rnd.randint(0, len(b))
            lot = rnd.random()
            if lot < 0.3:
                del b[p : p + rnd.randint(0, 20)]
            elif lot < 0.6:
                b[p:p] = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))]
            elif lot < 0.8 and b:
                b[p:p] = b[rnd.randrange(len(b)) :][:30]
        if rnd.random() < 0.2:
            b = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))]
        yield (a, b) if n % 3 == 0 else ("".join(a), "".join(b))


def test_blocks_are_those_of_difflib():
    for a, b in odd_pairs():
        m, blocks = SequenceMatcher(None, a, b), M.matching_blocks(a, b)
        assert blocks == [tuple(x) for x in m.get_matching_blocks()]
        assert M.opcodes(blocks) == [o for o in m.get_opcodes() if o[0] != "equal"] and M.ratio(blocks) == m.ratio()


def test_long_texts_take_no_pairs():
    """20 million pairs of equal characters in the first part, for which alone difflib took 8 s; some 100 parts follow."""
    rnd = random.Random(5)
    a = "".join(chr(0x4E00 + rnd.randrange(200)) for _ in range(64_000))
    b = "".join(c for i, c in enumerate(a) if i % 640) + "x"
    began = time.monotonic()
    assert M.ratio(M.matching_blocks(a, b)) > 0.99 and time.monotonic() - began < 20
