import hashlib
import random
import re

from cubeloom.llm.automaton import Anchored, compile_rules
from cubeloom.llm.secret_scan import BASE_RULES, EXTRA_RULES, Scanner, find_secrets, span_digests

import pytest

from .shared import no_documents, odd_documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.fixture(scope="module")
def scanner():
    return Scanner(BASE_RULES + EXTRA_RULES)


def test_random_texts_equal_regular_expressions(scanner):
    rng = random.Random(3)
    parts = ["token", "Secret", "API_key", "apikey", "pass", "wd", "word", "=", ":", " ", '"', "'", "a", "AKIA", "AK", "0123456789abcdef", "deadbeef", "X9", "é", "\n", "-", ".", "A" * 9, "z", "中", "ſecret", "toKen"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    found = scanner.scan([t.encode() for t in texts])
    for text, spans in zip(texts, found, strict=True):
        assert [s for s in spans if s[2] < 3] == brute(text), text


def test_extra_kinds(scanner):
    text = "x ghp_" + "a1B2" * 9 + " y xoxb-123456789012-abcdef z -----BEGIN RSA PRIVATE KEY----- eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl"
    kinds = [(BASE_RULES + EXTRA_RULES)[s[2]].kind for s in scanner.scan([text.encode()])[0]]
    assert kinds == ["forge", "chat", "pem", "jwt"]


def test_long_lane_is_walked_whole(scanner):
    text = "a" * 50_000 + "g" + "f" * 30_000 + "token=" + "b" * 20_000
    assert [s for s in scanner.scan([text.encode()])[0] if s[2] < 3] == brute(text)


def test_rules_that_need_look_ahead_are_refused():
    with pytest.raises(ValueError):
        compile_rules(["ab(cd)?"])
    with pytest.raises(ValueError):
        compile_rules(["a*"])
    with pytest.raises(ValueError):
        compile_rules(["abcd+|bc"])


def test_minimisation_merges_equal_states():
    one = compile_rules(["(ab|cb)d"])
    assert one.quiet == 4  # start, after a or c, after b, matched


def test_anchored_longest():
    assert Anchored("ab+").longest(b"abbbc") == 4
    assert Anchored("ab+").longest(b"xab") == -1
    assert Anchored("ab+c", reverse=True).longest(b"cbba") == 4


def test_query_form_over_odd_rows(spark):
    docs = odd_documents(spark)
    rows = span_digests(find_secrets(docs)).collect()
    assert len(rows) == 10
    assert rows[0].asDict().keys() == {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].spans == "" and by_id[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = next(r.text for r in docs.collect() if r.doc_id == 8)
    start, end, _ = brute(text)[0]
    assert by_id[8].spans == f"assign:{start}:{end}" and by_id[8].n_assign == 1
    assert by_id[8].base_sha256 == hashlib.sha256(f"assign:{start}:{end}".encode()).hexdigest()
    assert find_secrets(no_documents(spark)).collect() == []
