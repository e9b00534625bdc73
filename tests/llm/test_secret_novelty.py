import random

import pytest

from lithoframe.llm import secret_scan as ss

HEX, B32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def found(text):
    return [text[s:e] for s, _, e in ss.scan_text(text, ss.Novelty())[1]]


@pytest.mark.parametrize("signs,length", [(HEX, 64), (HEX, 128), (B32, 200), (B64, 800), (B64, 1600), (B64, 40)])
def test_long_keys_are_found(signs, length):
    r = random.Random(5)
    keys = ["".join(r.choices(signs, k=length)) for _ in range(40)]
    assert [found(f"Authorization: Bearer {k}\n") for k in keys] == [[k] for k in keys]


@pytest.mark.parametrize("gap", [0, 5, 1000, 1015, 1040])
def test_keys_that_stand_twice_are_found_twice(gap):
    k = "".join(random.Random(9).choices(B64[:62], k=28))
    text = f"Authorization: Bearer {k}\n" + "a word " * (gap // 7) + f"Authorization: Bearer {k}\n"
    assert found(text) == [k, k]
    assert found(f"see {k} here: Authorization: Bearer {k}") == [k]


def test_long_words_are_left():
    slug = "-".join(["the", "bearer", "of", "this", "letter", "walked", "along", "the", "river", "until", "evening", "in", "the", "year", "1984", "and", "then", "rested"])
    assert found(f"bearer {slug}") == [] and found("bearer " + "abc1" * 50) == []
