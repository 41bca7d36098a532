"""License notices near the start of a text, against an alignment of all windows."""

from __future__ import annotations

import pytest

from tidemark.llm import licenses

LONG = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts if len(licenses.words_of(t)) > 20]
STARTS = ["", "Copyright (c) 2020 Foo. ", "License: ", "Copyright (c) 2020 Foo. All rights reserved. License and permission: "]


def best(text, template):
    """The largest share of the template that a window of its length and slack covers, wherever it starts."""
    plain, words = ([w for w, _, _ in licenses.words_of(t)] for t in (text, template))
    slack = max(1, int(licenses.SLACK * len(words)))
    return max(len(licenses.patience(words, plain[max(0, at - slack) : at + len(words) + slack])) / len(words) for at in range(-len(words), len(plain)))


@pytest.mark.parametrize("start", STARTS)
@pytest.mark.parametrize(("name", "template"), LONG)
def test_op5_notice_after_a_copyright_line(name, template, start):
    text = start + template + " Some prose follows the notice here."
    assert best(text, template) >= licenses.COVERAGE
    found = [hit for hit in licenses.scan(text) if hit[0] == name]
    assert found and found[0][1] >= best(text, template) - 1e-9


def test_licenses_that_share_clauses_keep_their_names():
    two, three = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    assert [h[:2] for h in licenses.scan(f"Foo. {two} Bar.")] == [("BSD-2-Clause", 1.0)]
    assert [h[:2] for h in licenses.scan(f"Foo. {three} Bar.")] == [("BSD-3-Clause", 1.0)]
    assert [h[0] for h in licenses.scan(f"{two}\nsome words in between of no meaning at all\n{three}")] == ["BSD-2-Clause", "BSD-3-Clause"]


@pytest.mark.parametrize(("name", "template"), [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts])
def test_every_wording_is_its_license(name, template):
    text = f"Foo bar baz. {template} Quux corge grault."
    assert [h[0] for h in licenses.scan(text)] == [name] and licenses.scan(text)[0][1] == 1.0
    low = licenses.PLAIN.findall(text.lower().encode())
    assert not licenses._templates()[2].isdisjoint(low)  # what settles texts without notices lets it through


@pytest.mark.parametrize("share", [0.35, 0.5, 0.75, 0.95])
@pytest.mark.parametrize(("name", "template"), [x for x in LONG if len(licenses.words_of(x[1])) >= 90])
def test_parts_have_the_coverage_of_a_plain_alignment(name, template, share):
    """Parts from the start, the end and the middle: the coverage is that of an alignment with the whole text."""
    words = template.split()
    n = int(len(words) * share)
    for at in (0, (len(words) - n) // 2, len(words) - n):
        text = "Foo bar baz qux. " + " ".join(words[at : at + n]) + " Quux corge grault."
        found = licenses.scan(text)
        plain = [w for w, _, _ in licenses.words_of(text)]
        want = len(licenses.patience([w for w, _, _ in licenses.words_of(template)], plain)) / len(licenses.words_of(template))
        own = [h for h in found if h[0] == name]
        if own:
            assert own[0][1] == pytest.approx(want, abs=0.02)
        else:  # the same words are a larger part of another wording
            assert found and max(h[1] for h in found) >= want - 0.02


def test_other_prose_has_no_license():
    for text in ("", "The software was used without restriction of any kind, and the following conditions were met by the copyright office.", "licensed under", "spdx license identifier", "x " * 5000):
        assert licenses.scan(text) == []
