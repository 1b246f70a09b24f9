"""Random keys of every encoding are reported whole, wherever they stand."""

from __future__ import annotations

import random
import string

import pytest

from quarry.llm import secrets

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase


@pytest.mark.parametrize("alphabet", [LOWER + string.digits, UPPER + string.digits, LOWER + "234567", UPPER + "234567", secrets.B64])
@pytest.mark.parametrize("length", [32, 64])
def test_keys_of_any_alphabet(alphabet, length):
    rng = random.Random(3)
    keys = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(200)]
    assert sum(secrets.random_spans(f"see {k} here", []) == [(4, 4 + length)] for k in keys) > 190


def test_keys_in_paths():
    rng = random.Random(4)
    for signs, front in (("-_", "web_hooks/123/"), ("+/", "my-app_")):
        keys = ["".join(rng.choice(secrets.B64 + signs) for _ in range(40)) for _ in range(200)]
        found = [[t[a:b] for a, b in secrets.random_spans(t, [])] for t in (f"at https://example.org/{front}{k} now" for k in keys)]
        assert sum([k] == f for k, f in zip(keys, found, strict=True)) > 150, signs


def test_words_of_any_case_stay():
    for x in ("monthly_report/2024-01-01/final-version-of-the-text", "getuserbyaccountid2fromtherepository", "GETUSERBYACCOUNTID2FROMTHEREPOSITORY", LOWER + string.digits, UPPER + string.digits):
        assert not secrets.random_spans(f"see {x} here", []), x


ENGLISH = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people too little state good very make world still own see men work long here get both between life being under".split()


def names(rng, style):
    w = [rng.choice(ENGLISH) for _ in range(rng.randint(5, 12))]
    return {"lower": "".join(w), "camel": "".join(x.capitalize() for x in w), "snake": "_".join(w), "kebab": "-".join(w), "number": "".join(x.capitalize() for x in w) + str(rng.randint(1, 99))}[style]


@pytest.mark.parametrize("style, most", [("lower", 0.08), ("camel", 0.08), ("snake", 0.01), ("kebab", 0.01), ("number", 0.17)])
def test_false_discoveries(style, most):
    """Names of 20 letters and more, of common English words. Joined without a sign they are a little over FDR (0.07; 0.15 with a number), since they repeat letters less than the margin says."""
    rng = random.Random(6)
    made = [x for x in (names(rng, style) for _ in range(2000)) if len(x) >= 20]
    assert sum(bool(secrets.random_spans(f"see {x} here", [])) for x in made) <= most * len(made)


@pytest.mark.parametrize("alphabet, shares", [(UPPER[:6] + string.digits, (0.7, 0.9)), (LOWER, (0.3, 0.85)), (LOWER + UPPER, (0.3, 0.85)), (secrets.B64, (0.6, 0.95)), (secrets.B64 + "-_", (0.6, 0.95))])
def test_recall_grows_with_length(alphabet, shares):
    """At 20 and at 40 symbols, with or without a digit among them; at 128 nearly all."""
    rng = random.Random(7)
    for length, share in zip((20, 40, 128), (*shares, 0.97), strict=True):
        keys = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(300)]
        assert sum(bool(secrets.random_spans(f"see {k} here", [])) for k in keys) >= share * 300, length
