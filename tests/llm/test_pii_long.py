"""Mentions of any length are found whole, in time that grows with the text."""

import time

from tidemark.llm import pii


def spans(text):
    return [(k, text[a:b]) for k, _, a, b in pii.entities(text)]


def test_long_mentions_are_found_whole():
    for mail in ("a@" + "x" * 450 + ".com", "999" + "x" * 450 + "@host.org", "y" * 5000 + "@" + "h" * 5000 + ".de"):
        for before, after in (("", ""), ("text ", " text"), ("(", ")"), ("see\t", "\nline")):
            assert spans(before + mail + after) == [("email", mail)]


def test_mentions_beside_each_other():
    text = "call 079 123 45 67 or 030/1234567, +49 30 1234 5678 9;a@b.org,c@d.org 10.0.0.1 4111 1111 1111 1111"
    assert [k for k, _ in spans(text)] == ["phone", "phone", "phone", "email", "email", "ip", "card"]
    far = "x1 " + "word " * 40 + "4111 1111 1111 1111 " + "word " * 12 + "2 " + "w" * 300 + "@host.org"
    assert spans(far) == [("card", "4111 1111 1111 1111"), ("email", "w" * 300 + "@host.org")]
    assert spans("12" + "x" * 200 + "3 +49 30 123456") == [("phone", "+49 30 123456")]


def test_titles_in_capitals():
    assert [k for k, _ in spans("MRS. ANNA SCHMIDT CAME")] == ["given", "surname"]


def test_time_grows_with_the_text():
    for unit in ("user@host.org,", "12 34 56 ", "a1b2c3", "abcdef", "10.1.2.3 ", "ab:", "word ", "1."):
        took = []
        for n in (20_000, 200_000):
            text = "a@" + unit * (n // len(unit))
            best = min(_timed(text) for _ in range(3))
            took.append(best)
        assert took[1] < 40 * took[0] + 0.2, unit  # ten times the text; a square would take a hundred times


def _timed(text):
    began = time.process_time()
    list(pii.entities(text))
    return time.process_time() - began
