"""Precision and recall of added spans on sentences of another generator than the one that made the training labels: other wordings, other
layouts of numbers, other look-alikes. The figures of the README are this test's."""

import random

import pytest

from corpusloom.llm import pii
from corpusloom.llm.common import table


def digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def card(rng):
    d = "4" + digits(rng, 14)
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def iban(rng, country="DE"):
    body = digits(rng, 18)
    number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
    return f"{country}{98 - number % 97:02d}{body}"


def personal(rng):
    """(kind, sentence, value)."""
    name, house = rng.choice(["olga.petrova", "j_mueller", "tanaka77", "maria-lopez"]), rng.choice(["posteo", "uni-ulm", "acme"])
    yield "spelt mail", f"write me under {name} (at) {house} (dot) net please", f"{name} (at) {house} (dot) net"
    yield "spelt mail", f"Kontakt: {name} [at] {house} [dot] de", f"{name} [at] {house} [dot] de"
    area, line = digits(rng, 3).replace("0", "2"), digits(rng, 4)
    phone = f"({area}) 555-{line}"
    yield "phone", f"Her cell number is {phone}, call after six.", phone
    phone = f"{area}.555.{line}"
    yield "phone", f"phone {phone} (home)", phone
    phone = f"0049 {digits(rng, 2)} {digits(rng, 7)}"
    yield "phone", f"Telefon: {phone}", phone
    c = card(rng)
    spaced = f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"
    yield "card", f"paid with Visa {spaced} exp 04/29", spaced
    ssn = f"{rng.randrange(101, 599)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
    yield "ssn", f"Employee SSN {ssn} on file", ssn
    i = iban(rng)
    spaced = " ".join(i[k : k + 4] for k in range(0, len(i), 4))
    yield "iban", f"bitte auf {spaced} überweisen", spaced
    six = ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8))
    yield "ipv6", f"login from {six} failed", six


def clean(rng):
    a, b, c = rng.randrange(10, 99), rng.randrange(100, 999), rng.randrange(1000, 9999)
    return [
        f"ISBN 978-3-{a}-{digits(rng, 6)}-{rng.randrange(10)} is out of print",
        f"on {rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1990, 2030)} at {rng.randrange(10, 24)}:{a % 60:02d}:{b % 60:02d}",
        f"part no. {b}-{a}-{c}-{b} in stock",
        f"release {a}.{b}.{rng.randrange(9)} fixes {c} bugs",
        f"the score was {a}-{b % 100} after {c} minutes",
        f"GPS {a}.{digits(rng, 5)}, {b % 90}.{digits(rng, 5)}",
        f"order {digits(rng, 8)} costs {a},{b}.00 dollars",
        f"they met at the dot on page {a}",
        f"commit {digits(rng, 3)}ab{digits(rng, 4)}cd",
        f"ratio {a}:{b % 60:02d}:{c % 60:02d} in {c} tests",
    ]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_on_sentences_of_another_generator(model):
    rng, found, total, wrong, right = random.Random(20), {}, {}, 0, 0
    for _ in range(60):
        for kind, text, value in personal(rng):
            start = text.index(value)
            hit = any(a < start + len(value) and start < e for a, _, _, e in pii.spans_of(text, model))
            total[kind] = total.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + hit
            right += hit
        for text in clean(rng):
            wrong += bool([s for s in pii.spans_of(text, model) if s[2] not in pii.BASE_KINDS])
    recall = {k: found[k] / total[k] for k in total}
    print("recall", recall, "precision", right / (right + wrong), "clean sentences marked", wrong)
    assert right / sum(total.values()) > 0.95 and right / (right + wrong) > 0.95
