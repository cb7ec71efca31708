"""Surrogates of entities of any length, at the calendar's edges, and drawn again in any number."""

import random
import time
from datetime import date

import pytest
from conftest import SF

pytest.importorskip("public_tokenizers")

from textmill.llm import pii  # noqa: E402

EDGES = [n for n in range(1, date.max.toordinal() + 1) if n < 3652 or n >= date.max.toordinal() // 3652 * 3652]


def test_every_day_of_the_edge_blocks():
    k = pii.Keyed(b"key")
    made = [k.surrogate("birth", date.fromordinal(n).isoformat()) for n in EDGES]
    assert {date.fromisoformat(x).toordinal() for x in made} == set(EDGES)
    out = k.replace("born 9999-12-31, born 0001-01-01, DOB: 31.12.9999, née 1/1/0001")[0].split(", ")
    assert out[0].startswith("born 9999-") and out[1].startswith("born 000") and out[2].endswith(".9999")


HUGE = {
    "hex": "0a" * 5_000_000,
    "digits": "7" * 10_000_000,
    "key": "sk-" + "aB3_" * 2_500_000,
    "mail": "x7" * 5_000_000 + "@" + "host" * 1000 + ".example.com",
    "name": "Mr W" + "eber" * 500_000,
    "hyphens": "Mrs " + "Ab-" * 100_000 + "Cd Weber",
}


@pytest.mark.parametrize("kind", sorted(HUGE))
def test_entities_of_any_length(kind):
    k, began = pii.Keyed(b"key"), time.time()
    text = f"it was {HUGE[kind]} there"
    out, found = k.replace(text)
    assert found and out != text and out.endswith(" there") and time.time() - began < 60
    if kind != "name":
        assert HUGE[kind] not in out
    again = k.replace(f"it was {HUGE[kind]} there")[0]
    assert again == out
    if kind in ("hex", "digits", "key"):
        other = k.replace(f"it was {HUGE[kind][:-1]}{'1' if kind != 'key' else 'Q'} there")[0]
        assert len(other) == len(out) and sum(a != b for a, b in zip(out[:4000], other[:4000], strict=True)) > 1000  # all of it moves


def test_huge_entities_on_spark(spark):
    rows = [(i, f"a {own} b") for i, own in enumerate(HUGE.values())] + [(98, "born 9999-12-31"), (99, "born 0001-01-01")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), b"key").collect()}
    k = pii.Keyed(b"key")
    assert got == {i: k.replace(t)[0] for i, t in rows}


@pytest.mark.parametrize("n", [2, 3, 47, 48, 49, 96, 97, 145, 300])
def test_long_words_stay_apart(n):
    k, r = pii.Keyed(b"key"), random.Random(n)
    words = {"".join(r.choice("abc") for _ in range(n + i % 3)) for i in range(3000)}
    made = {k.word(w) for w in words}
    assert len(made) == len(words)


@pytest.mark.parametrize("radix", [2, 10, 16, 26, 33])
def test_long_permutation_is_a_bijection(radix):
    """Each half is moved by a stream of the other, so every step can be undone: undoing all gives the values back."""
    import hashlib

    import numpy as np

    k, r = pii.Keyed(b"key"), random.Random(radix)
    values = [r.randrange(radix) for _ in range(pii.LONG + 45)]
    made = np.array(k.permute(values, radix, "t"), np.int16)
    u = len(values) // 2
    a, b = made[:u], made[u:]
    head = k.key + hashlib.blake2b(repr(("t", radix)).encode(), key=k.key, digest_size=32).digest()
    for i in reversed(range(10)):
        a, b = (b - np.frombuffer(hashlib.shake_256(head + bytes([i]) + a.astype(np.uint8).tobytes()).digest(len(b)), np.uint8)) % radix, a
    assert np.concatenate((a, b)).tolist() == values


def test_random_entities_of_all_types_stay_apart():
    k, r = pii.Keyed(b"key"), random.Random(11)
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    digits, small, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    makers = {
        "email": lambda: f"{draw(small, r.randrange(1, 300))}{draw(digits, 3)}@{draw(small, r.randrange(1, 20))}.com",
        "hex": lambda: "a" + draw(hexa, r.randrange(32, 600)),
        "key": lambda: "ghp_" + draw(small + digits, r.randrange(20, 700)),
        "card": lambda: draw("4", 1) + draw(digits, r.choice([12, 15, 18])),
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "birth": lambda: date.fromordinal(r.randrange(1, date.max.toordinal() + 1)).isoformat(),
        "name": lambda: draw(small, r.randrange(3, 120)),
        "iban": lambda: "DE" + draw(digits, 20),
        "ssn": lambda: draw(digits, 9),
        "phone": lambda: draw(digits[1:], 9),
    }
    for kind, make in makers.items():
        own = {make() for _ in range(500)}
        made = {x: k.surrogate(kind, x) for x in own}
        assert len(set(made.values())) == len(own), kind
        assert sum(a == b for a, b in made.items()) == 0, kind
        assert all(len(a) == len(b) for a, b in made.items() if kind not in ("name", "ip"))


def test_surrogates_drawn_again_by_table(spark, monkeypatch):
    """A text gets the draws of its own entities, the same ones in every text."""
    rows = [(1, "to a.b@c.com and x.y@c.com"), (2, "A.B@c.com"), (3, None), (4, "plain"), (5, "of 169.122.221.182, a.b@c.com"), (5, "of 169.122.221.182, a.b@c.com")]
    drawn = spark.createDataFrame([("email", "a.b@c.com", 3), ("ip", "169.122.221.182", 1), ("ip", "1.1.1.1", 1)], "type string, original string, epoch int")
    monkeypatch.setattr(pii, "repairs", lambda *_: drawn)
    got = sorted((r["doc_id"], r["text"]) for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect() if r["text"])
    k = pii.Keyed(b"key")
    a, x, ip = k.surrogate("email", "a.b@c.com", 3), k.surrogate("email", "x.y@c.com", 0), k.surrogate("ip", "169.122.221.182", 1)
    assert got == [(1, f"to {a} and {x}"), (2, a), (4, "plain"), (5, f"of {ip}, {a}"), (5, f"of {ip}, {a}")]


def test_entities_and_surrogates_are_one_to_one(spark):
    """Over all documents; and every mention of the forms below is gone, with its surrogate in its place."""
    k = pii.Keyed(b"textmill surrogate key")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = {r["doc_id"]: r for r in pii.pseudonymize(spark.read.parquet(f"{SF}/documents.parquet"), b"textmill surrogate key").collect()}
    pairs = set()
    for i, text in docs.items():
        found = k.replace(text or "")[1]
        pairs |= set(found)
        assert made[i]["n_entities"] == len(found) and made[i]["types"] == ",".join(sorted({f[0] for f in found}))
        for m in pii.ENTITY.finditer(text or ""):
            if m.lastgroup in ("email", "ip", "hex", "key"):
                own = k.surrogate(m.lastgroup, m[0].lower() if m.lastgroup == "email" else m[0], 0)
                assert own in made[i]["text"] and m[0] not in made[i]["text"]
    assert len({(a, b) for a, b, _ in pairs}) == len({(a, c) for a, _, c in pairs}) == len(pairs)
