"""IBANs with text right after them."""

import pytest

from tidemark.llm import pii


@pytest.mark.parametrize(
    "text, want",
    [
        ("iban DE89370400440532013000, x", "DE89370400440532013000"),
        ("iban DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
        ("IBAN: DE89 3704 0044 0532 0130 00 Bank", "DE89 3704 0044 0532 0130 00"),
        ("iban DE89370400440532013000\nAccount", "DE89370400440532013000"),
        ("iban DE89370400440532013000BIC", "DE89370400440532013000"),
        ("iban NO93 8601 1117 947 1 2 3", "NO93 8601 1117 947"),
        ("iban MT84MALT011000012345MTLCAST001S 7", "MT84MALT011000012345MTLCAST001S"),
        ("iban DE88370400440532013000 BIC", None),
        ("iban DE8937040044053201300", None),
    ],
)
def test_iban(text, want):
    found = [text[a:b] for kind, a, b in pii.find(text, pii.automaton()) if kind == "iban"]
    assert found == ([want] if want else [])


def test_two_ibans():
    text = "iban GB82 WEST 1234 5698 7654 32 IBAN DE89 3704 0044 0532 0130 00 X"
    assert [text[a:b] for kind, a, b in pii.find(text, pii.automaton()) if kind == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]


def test_country_without_a_listed_length():
    flat = "ZZ00" + "12345678901234"
    check = 98 - int("12345678901234" + "3535" + "00") % 97
    iban = f"ZZ{check:02d}" + flat[4:]
    text = f"iban {iban} 77 Bank"
    assert [text[a:b] for kind, a, b in pii.find(text, pii.automaton()) if kind == "iban"] == [iban]
