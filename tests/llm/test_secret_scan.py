import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import edge_rows
from tokenloom.llm import automaton, secret_scan
from tokenloom.llm.queries import QUERIES

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         re.IGNORECASE | re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_spans(texts):
    return [[s for s in found if s[1] < 3] for found in secret_scan.text_spans([t.encode() for t in texts])]


PARTS = ["token", "Secret", "PASSWORD", "api", "_", "key", "AKIA", "A", "K", "0", "deadbeef", "ab", "é", "=", ":", " ",
         "'", '"', "\n", "abcdef123456", "ABCDEFGH12345678", ".", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "eyJ"]


def test_random_texts_match_the_patterns():
    draw = random.Random(3)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(50))) for _ in range(3000)]
    assert base_spans(texts) == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS)).map("".join), max_size=5))
def test_any_texts_match_the_patterns(texts):
    assert base_spans(texts) == [plain(t) for t in texts]


def test_lanes_give_the_states_of_one_byte_at_a_time(monkeypatch):
    monkeypatch.setattr(automaton, "LANE", 16)
    auto = secret_scan.combined()
    data = ("token=abc\n" * 20 + "f" * 200 + " AKIA" + "Z9" * 40 + "\n" + "x" * 300).encode()
    state, want = 0, []
    for b in data:
        state = auto.moves[state * auto.classes + auto.class_of[b]]
        want.append(state)
    assert automaton.scan(auto, np.frombuffer(data, dtype=np.uint8)).tolist() == want


def test_minimal_automaton_has_no_equal_states():
    auto = automaton.compile_rules([automaton.some(automaton.byte_set("ab")), automaton.literal("abc")])
    rows = auto.moves.reshape(-1, auto.classes)
    looks = {(int(a), int(b), tuple(r)) for a, b, r in zip(auto.accepts, auto.active, rows.tolist(), strict=True)}
    assert len(looks) == len(rows)


def test_added_kinds():
    text = "-----BEGIN EC PRIVATE KEY----- ghp_" + "a1B" * 12 + " xoxb-1234567890 eyJabc.eyJdef.0123456789 gho_short"
    kinds = [secret_scan.RULES[k].kind for _, k, _ in secret_scan.text_spans([text.encode()])[0]]
    assert kinds == ["key", "forge", "chat", "webtoken"]


def test_query_matches_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    kinds = list(PATTERNS)
    for r in QUERIES["op3_secret_automaton"](spark, sf).collect():
        spans = plain(texts[r["doc_id"]])
        joined = ",".join(f"{kinds[k]}:{b}:{e}" for b, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in spans) for i in range(3)]


def test_odd_rows(edge, no_docs):
    rows = secret_scan.scan_secrets(edge).collect()
    assert len(rows) == len(edge_rows()) and {r["spans"] for r in rows} == {""}
    assert secret_scan.scan_secrets(no_docs).count() == 0
