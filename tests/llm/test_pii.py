"""Added kinds and scores of personal data, worked by hand."""

import pytest

from gridloom.llm import pii

IBAN = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("text, want", [
    (f"pay to {IBAN} now", [("iban", 7, 34, 0.9)]),
    (f"bank account {IBAN}", [("iban", 13, 40, 1.0)]),
    ("DE89 3704 0044 0532 0130 01", []),
    ("GB29NWBK60161331926819", [("iban", 0, 22, 0.9)]),
    ("ssn 123-45-6789.", [("ssn", 4, 15, 0.6)]),
    ("part 123-45-6789", []), ("123-45-6789", []), ("ssn 000-45-6789 666-45-6789 123-00-6789 123-45-0000", []),
    ("a@example.org", [("email", 0, 13, 0.8)]), ("contact: a@b.cd", [("email", 9, 15, 1.0)]), ("noreply write to a@b.cd", [("email", 17, 23, 0.8)]),
    ("version 1.2.3.4", [("ip", 8, 15, 0.3)]), ("host 1.2.3.4", [("ip", 5, 12, 0.9)]), ("1.2.3.256", []),
    ("card 4111 1111 1111 1111", [("card", 5, 24, 1.0)]), ("4111 1111 1111 1112", []), ("order 4111111111111111", [("card", 6, 22, 0.4)]),
    ("call +1 (555) 123-4567", [("phone", 5, 22, 0.9)]), ("+12345678", []), ("", []),
])
def test_spans_and_scores(text, want):
    assert pii.find_spans(text) == want


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97(IBAN) and not pii.mod97(IBAN.replace("3", "4", 1)) and not pii.mod97("GB29")


def test_redaction_joins_overlapping_spans():
    assert pii.redact("ab 1234 cd", [(3, 7, "<x>"), (5, 9, "<y>")]) == "ab <x> cd"


def test_long_hostile_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("a" * 500_000 + "@", "1 " * 300_000, "+1" * 200_000, "1." * 300_000, "a@" * 200_000, "DE89 " * 100_000):
        pii.find_spans(t)
    assert time.time() - began < 30
