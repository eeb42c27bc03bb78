"""Licence scans against all rules on all texts, suppression pair by pair, and base phrases word by word."""

from __future__ import annotations

import random
import re
import re._parser as sre

import pytest

from tests.llm.helpers import ROWS, awkward, empty
from watchloom.llm import licenses
from watchloom.llm.license_rules import BASE, rules

RULES = rules()


def words(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plainly(text: str | None) -> tuple:
    """Every rule on the text, without prefilter; every pair of detections compared."""
    w = words(text)
    line = "".join(f" {x}" for x in w) + " "
    found = [(m.start(), m.end(), k) for k, r in enumerate(RULES) for m in r.pattern.finditer(line)]

    def goes(d):
        rank = lambda x: (RULES[x[2]].priority, x[1] - x[0], -x[2])
        return not RULES[d[2]].base and any(o != d and o[0] <= d[0] and o[1] >= d[1] and rank(o) > rank(d) for o in found)

    kept = [d for d in found if not goes(d)]
    places = sorted(k for p in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    base = sorted({label for p, label in BASE.items() if f" {p} " in line})
    return (
        len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base),
        ",".join(sorted({RULES[k].label for *_, k in kept})), max((RULES[k].confidence for *_, k in kept), default=0.0),
    )


def sample(tree, rng: random.Random) -> str:
    """A string that a pattern matches, each branch and repetition by chance."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += rng.choice("abcxyz019")
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += rng.choice("abcxyz019") if arg[0][0] == sre.NEGATE else chr(rng.randint(*value)) if kind == sre.RANGE else chr(value)
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name not in ("ASSERT", "AT"):
            raise AssertionError(name)
    return out


def texts(n: int, seed: int) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        parts = [sample(sre.parse(rng.choice(RULES).pattern.pattern), rng) if rng.random() < 0.6 else rng.choice(["und", "License", "the GPL", "cc by", "2.0", "v3", "é"]) for _ in range(rng.randrange(1, 14))]
        out.append(rng.choice([" ", ", ", "\n", " / "]).join(p.title() if rng.random() < 0.3 else p for p in parts))
    return out


def test_rules():
    assert len(RULES) > 300 and sum(not r.keyword.startswith("spdx") for r in RULES) > 250
    assert all(0 < r.confidence <= 1 and r.label and " " not in r.label and "," not in r.label for r in RULES)


@pytest.mark.parametrize("k", range(0, len(RULES), 40))
def test_every_match_has_its_keyword(k):
    rng = random.Random(k)
    for rule in RULES[k : k + 40]:
        for _ in range(60):
            text = f" {sample(sre.parse(rule.pattern.pattern), rng)} "
            if rule.pattern.search(text):  # samples keep no look-around, so some aren't matches
                assert f" {rule.keyword} " in text.replace("licence", "license"), (rule.pattern.pattern, text)


def test_against_all_rules():
    for text in texts(400, 5):
        got = licenses.scan_text(text.encode())
        assert tuple(got[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == plainly(text), text


def test_suppression():
    scan = lambda t: licenses.scan_text(t.encode())
    assert scan("Licensed under the Apache License, Version 2.0")["labels"] == "apache-2.0,license"
    assert scan("GNU General Public License v3.0")["labels"] == "gpl,gpl-3.0"  # the base label stays inside
    assert scan("Attribution: CC BY-NC-SA 4.0")["labels"] == "cc-by,cc-by-nc-sa"
    assert scan("SPDX-License-Identifier: GPL-2.0-or-later")["labels"] == "gpl-2.0-or-later"
    assert scan("All rights reserved. all RIGHTS reserved!")["n_base"] == 2
    assert scan("a submit license and some permits")["labels"] == ""
    got = scan("see the MIT license here")["detections"]
    assert got == [{"label": "mit", "priority": 40, "first_word": 1, "last_word": 3}]


def test_whole_long_text():
    text = "word " * 300_000 + "all rights reserved " + "é" * 100_000 + " cc-by" * 20_000
    got = licenses.scan_text(text.encode())
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (340_004, 20_001, 300_000, 340_002)
    assert len(got["detections"]) == 20_001


def test_licenses_awkward(session):
    rows = licenses.scan_licenses(awkward(session)).drop("detections").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(((r[0], *plainly(r[1])) for r in ROWS), key=str)
    assert licenses.scan_licenses(empty(session)).count() == 0
