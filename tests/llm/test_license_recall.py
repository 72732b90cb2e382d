"""License scans of altered notices, against the alignment of the whole text."""

import random
import time

import pytest

from gridloom.llm import licenses

from .test_scores import brute_scan

SHORT = {k: v for k, v in licenses.TEMPLATES.items() if len(licenses.words_of(v)) < licenses.SHORT}


def found(index, text):
    return {m[0] for m in index.scan(text)}


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_one_word_edits(name):
    template = licenses.TEMPLATES[name]
    words, index = template.replace("-", " ").split(), licenses.LicenseIndex(licenses.TEMPLATES)
    for k in range(len(words)):
        for middle in ([], ["other"], ["other", words[k]]):  # left out, replaced, one put before it
            text = " ".join(["head", *words[:k], *middle, *words[k + 1 :], "tail"])
            enough = name not in SHORT or brute_scan(text, template) >= licenses.COVERAGE * len(licenses.words_of(template))
            assert not enough or name in found(index, text), text


@pytest.mark.parametrize("text,name", [
    ("Released under an MIT License.", "mit-notice"), ("Released under the MIT open License.", "mit-notice"),
    ("Licensed under CC BY-NC version 4.0.", "cc-by-nc-4.0-notice"), ("All the rights are reserved.", "all-rights-reserved"),
])
def test_altered_notices(text, name):
    assert found(licenses.LicenseIndex(licenses.TEMPLATES), text) == {name}


def test_random_edits():
    rnd, hits = random.Random(7), 0
    for name, template in SHORT.items():
        index, own = licenses.LicenseIndex({name: template}), licenses.words_of(template)
        for _ in range(400):
            words = [w.decode() for w in own]
            for _ in range(rnd.randrange(1, 5)):
                k = rnd.randrange(len(words))
                words[k : k + 1] = rnd.choice([[], ["x"], [words[k], "x", "x"], [words[k], rnd.choice(own).decode()]])
                words = words or ["x"]
            filler = [rnd.choice(["x", "y", rnd.choice(own).decode()]) for _ in range(rnd.randrange(30))]
            text = " ".join(filler + words + filler[::-1])
            if brute_scan(text, template) >= licenses.COVERAGE * len(own):
                hits += 1
                assert found(index, text) == {name}, text
    assert hits > 500


def test_recall_of_long_templates():
    """Of whole texts with up to a fifth of their words edited, those that the alignment of the whole text accepts."""
    rnd, hits, reach = random.Random(11), 0, 0
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        own = [w.decode() for w in licenses.words_of(template)]
        if name in SHORT:
            continue
        for _ in range(12):
            words = list(own)
            for _ in range(rnd.randrange(len(own) // 5)):
                k = rnd.randrange(len(words))
                words[k : k + 1] = rnd.choice([[], ["x"], [words[k], "x"], [words[k], rnd.choice(own)]])
            filler = [rnd.choice(["x", "y", rnd.choice(own)]) for _ in range(20)]
            text = " ".join(filler + words + filler)
            if brute_scan(text, template) >= licenses.COVERAGE * len(own):
                reach += 1
                hits += name in found(index, text)
    assert reach > 100 and hits / reach >= 0.97, (hits, reach)


def test_many_matches_in_one_text():
    """Tens of thousands of notices, and thousands of altered ones, take seconds."""
    index, began = licenses.LicenseIndex(licenses.TEMPLATES), time.monotonic()
    assert len(index.scan("É All rights reserved.\n" * 80_000)) == 80_000
    cut = licenses.words_of(licenses.TEMPLATES["mpl-2.0-header"])
    altered = " ".join(w.decode() for k, w in enumerate(cut) if k != 9)
    got = index.scan((altered + " and so on ") * 300)
    assert [m[0] for m in got] == ["mpl-2.0-header"] * 300 and len({m[3] for m in got}) == 300
    assert time.monotonic() - began < 60


def test_spans_within_earlier_ones():
    rnd = random.Random(4)
    spans = [(a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(60) for _ in range(300))]
    assert licenses.within_earlier(spans) == [any(a <= x and y <= b for a, b in spans[:k]) for k, (x, y) in enumerate(spans)]


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "own").write_text("You may use this text as you like, but say where it comes from. " * 3, encoding="utf-8")
    index = licenses.LicenseIndex(licenses.templates_in(str(tmp_path)))
    assert [m[0] for m in index.scan("Head. " + "you may use this text as you like but say where it comes from " * 3)] == ["own"]


def test_each_of_several_altered_notices_is_found():
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    one = "Released under the very open MIT License. "
    text = one + "Released under an MIT License. " + "Released under the MIT License. " + one * 3 + "and so on " * 50 + one
    got = sorted((m for m in index.scan(text) if m[0] == "mit-notice"), key=lambda m: m[3])
    assert len(got) == 7 and all(a[4] <= b[3] for a, b in zip(got, got[1:], strict=False))
