"""The narrow splitting classes against the wide ones."""

import random

import regex

from chronoloom.llm.pieces import BYTE_LEVEL, resident, splitter


def test_latin_texts_split_alike():
    narrow, wide, chars = splitter(BYTE_LEVEL), regex.compile(BYTE_LEVEL).findall, [chr(i) for i in range(256)]
    for a in chars:
        for b in chars:
            text = f"x{a}{b} {a}'s{b}12{a}{a} {b}"
            assert narrow(text) == wide(text)
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choices([*chars, "œ", "–", "漢", " "], k=30))
        assert narrow(text) == wide(text)


def test_one_state_at_a_time():
    assert resident("a", list) is resident("a", list)
    first = resident("a", list)
    resident("b", dict)
    assert resident("a", list) is not first
