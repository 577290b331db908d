"""Disguises longer than a word, and spaced words beside others."""

import time

import numpy as np
import pytest

from corvane.llm import toxicity


@pytest.fixture(scope="module")
def restorer():
    total = np.zeros(toxicity.GRAMS, np.int64)
    toxicity.count_grams("you are an idiot and a fool but i am not the one who is a rude idiot today à y o " * 50, total)
    return toxicity.Restorer(total)


@pytest.mark.parametrize("token", ["i" * 20 + "di" + "o" * 25 + "t", "i" + "." * 15 + "d" + "-" * 15 + "i" + "_" * 15 + "ot", "1" * 30 + "d1" + "0" * 30 + "t", "you-are-an-idiot-and-a-fool-but-i-am-not-the-one"])
def test_long_tokens(restorer, token):
    assert "idiot" in restorer.words(f"so {token} so")


@pytest.mark.parametrize("text", ["a i d i o t", "y o u i d i o t", "i i d i o t", "à i d i o t", "y o u   i d i o t", "a  i d i o t", "i  d i o t", "i d i o t   f o o l", "i d i o t", "who is a i d i o t today"])
def test_spaced_words_beside_others(restorer, text):
    assert "idiot" in restorer.words(text)


def test_codes_and_addresses_stay(restorer):
    code = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    for t in (code, "https://example.org/a-very-long-path/that-goes-on-and-on/and-on", "example.org/a-very-long-path/that-goes-on-and-on/and-on", "somebody.with.a.very.long.name.indeed@mail.example.org"):
        assert restorer.restored(t) == (t,)


def test_long_tokens_in_linear_time(restorer):
    began = time.time()
    restorer.words("ab1c" * 20_000 + " " + "a" * 1_000_000 + " " + "@a" * 20_000 + " " + "x y " * 10_000)
    assert time.time() - began < 60
