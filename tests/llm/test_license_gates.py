"""The keyword filter in front of the license rules loses no match."""

import random
import re
from re import _parser as parser

import pytest

from numera.llm import licenses


def _sample(nodes, rng) -> str:
    out = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(rng.choice(arg)[1])
        elif name == "BRANCH":
            out += _sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += _sample(arg[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(_sample(arg[2], rng) for _ in range(rng.randint(arg[0], arg[1])))
        else:
            raise ValueError(name)
    return out


def test_every_sample_passes_its_own_gate():
    rng = random.Random(12)
    for rule in licenses.rules():
        assert rule.keywords, rule
        for _ in range(40):
            text = _sample(parser.parse(rule.pattern), rng)
            assert re.fullmatch(rule.pattern, text)
            assert set(rule.keywords) & set(text.split()), (rule.label, text)


@pytest.mark.parametrize("text, label", [
    ("licensed under the Open Software License 3.0", "osl-3.0"), ("Q Public License 1.0", "qpl-1.0"), ("GPLv2", "gpl-2"), ("GPLv3 or later", "gpl-3-or-later"),
    ("LGPLv2.1", "lgpl-2.1"), ("GNU AGPLv3", "agpl-3"), ("GPL3", "gpl-3"), ("MPLv2.0", "mpl-2.0"),
])
def test_names_without_acronyms_and_glued_versions(text, label):
    assert [p[0] for p in licenses.scanner().scan(text.encode())[2]] == [label]


def test_scan_equals_an_ungated_scan():
    gated, free = licenses.Scanner(), licenses.Scanner()
    rng = random.Random(13)
    free.by_key = {b"and": list(range(len(free.rules)))}
    free.keys = frozenset(free.by_key)
    for _ in range(60):
        text = " and ".join(_sample(parser.parse(r.pattern), rng) for r in rng.sample(licenses.rules(), 5)).encode()
        assert gated.scan(text)[2] == free.scan(text)[2], text
    assert not gated.scan(b"sudo apt install apache2 php3 artistic1")[2]
