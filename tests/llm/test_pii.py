import hashlib
import re

from evalsweep.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_pattern(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(number):
        total = 0
        for i, d in enumerate(map(int, reversed(number))):
            total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
        return total % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_spans_equal_the_patterns(rng):
    automaton = pii.anchors()
    alphabets = ["a1.@-+ ", "12. ", "+12()- .", "0123456789 -", "aB.@%_é日", "4 1-", "://a:@b.c0"]
    cases = [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        for alphabet in alphabets
        for _ in range(400)
    ]
    cases += ["4111 1111 1111 1111", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "+12345678", "00000255.1.1.1", "é" * 9 + "a@b.cc"]
    for text in cases:
        found = pii.spans(text, automaton)
        assert {kind: found[kind] for kind in pii.BASE_KINDS} == by_pattern(text), text


def test_the_method_adds_cued_spans():
    automaton = pii.anchors()
    text = 'token = "0123456789abcdef0123", IBAN: DE89370400440532013000, Account no 12345678 ftp://me:pw@host.org'
    found = pii.spans(text, automaton)
    assert [text[a:b] for a, b in found["secret"]] == ["0123456789abcdef0123"]
    assert [text[a:b] for a, b in found["account"]] == ["DE89370400440532013000", "12345678"]
    assert [text[a:b] for a, b in found["login"]] == ["me:pw@host.org"]
    assert pii.redacted(text, found).count("[") == 4 and "12345678" not in pii.redacted(text, found)


def test_long_secrets_are_whole():
    automaton = pii.anchors()
    for size in (512, 513, 700, 5000):
        secret = ("eyJ0oken.-_/+Ab9" * size)[:size]
        text = f"before token: {secret} after, password='{secret}'"
        found = pii.spans(text, automaton)
        assert [text[a:b] for a, b in found["secret"]] == [secret, secret]
        assert pii.redacted(text, found) == "before token: [SECRET] after, password='[SECRET]'"
    pii.spans("token=" * 100_000 + "token1" * 100_000, automaton)


def test_very_long_runs_end_quickly():
    automaton = pii.anchors()
    for unit in ("1.", "a@", "+1", "1 ", "://a:", "a.b@"):
        pii.spans(unit * 100_000, automaton)
    pii.spans("0" * 100_000 + ".1.1.1", automaton)


def test_odd_tables(odd_docs, no_docs):
    rows = pii.find(odd_docs, with_text=True).collect()
    assert len(rows) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {row["doc_id"]: row for row in rows}
    assert by_id[0]["base_sha256"] == empty and by_id[0]["redacted"] == "" and by_id[0]["spans"] == ""
    assert [by_id[8][f"n_{kind}"] for kind in pii.BASE_KINDS] == [1, 1, 1, 1]
    assert None in by_id
    assert pii.find(no_docs).count() == 0
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert {r["text"] for r in clean.filter("doc_id = 8").collect()} == {"[EMAIL]; [PHONE]; [CARD]; [IP]"}
    assert clean.filter("doc_id = 0 and text is null").count() == 1
