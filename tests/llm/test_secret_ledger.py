import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import secret_ledger as sl
from freshet.llm.secret_ledger import BASE_RULES, RULES, Rule, compile_rules, find_spans, rule_version, scan_history


def brute(text):
    """The base spans as they are defined."""
    kinds = [
        ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
    return [(name, a, b) for a, _, name, b in sorted(found)]


@given(st.lists(st.sampled_from(["token", "Secret", "API_KEY", "paſſword", "=", ": ", "'", '"', "AKIA", "0123456789abcdef", "XYZ9", "a1", " ", "_", "é"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert find_spans(text, BASE_RULES, compile_rules(BASE_RULES)) == brute(text)


def test_marked_formats_are_added_and_base_stays():
    key = "ghp_" + "A1b2" * 6
    text = f"x {key} token={key} -----BEGIN RSA PRIVATE KEY----- " + "0a" * 14
    spans = find_spans(text, RULES, compile_rules(RULES))
    assert [s for s in spans if s[0] in ("assign", "access", "hex")] == brute(text)
    assert [k for k, *_ in spans if k in ("prefixed", "private_key")] == ["prefixed", "prefixed", "private_key"]


def test_web_tokens_of_any_length():
    compiled = compile_rules(RULES)
    for head, load, sign in ((8, 8, 8), (700, 30, 43), (30, 5000, 43), (30, 700, 683)):
        token = f"eyJ{'a' * head}.eyJ{'B_' * (load // 2)}.{'-9' * (sign // 2)}"
        for before in ("", "Bearer ", "x=", "run-of_text", "eyJ."):
            assert ("jwt", len(before), len(before) + len(token)) in find_spans(f"{before}{token} end", RULES, compiled), (head, load, sign, before)


@given(st.lists(st.sampled_from(["eyJ", "eyJabcdefgh", ".", "abcdefgh", "a", "-", " ", "eyJabcdefgh.eyJabcdefgh.abcdefgh"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_web_tokens_are_those_of_the_plain_pattern(text):
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    assert [s for s in find_spans(text, RULES, compile_rules(RULES)) if s[0] == "jwt"] == [("jwt", *m.span()) for m in plain.finditer(text)]


def test_web_tokens_are_sought_in_linear_time():
    for text in ("eyJ" * 300_000, "eyJabcdefgh." * 60_000, "a-" * 300_000 + "eyJ", "eyJaaaaaaaa." + "eyJ" * 300_000):
        find_spans(text, RULES, compile_rules(RULES))


def test_linear_on_hostile_texts():
    compiled = compile_rules(RULES)
    for text in ("eyJ" * 100_000, "token" * 60_000, "AKIA" * 60_000, "0" * 300_000, "-----BEGIN " * 30_000, "secret" + " " * 300_000):
        find_spans(text, RULES, compiled)


def test_every_version_gets_its_findings(table, hard_rows, tmp_path):
    secret = "password = hunter2hunter2"
    rows = [*hard_rows, (20, secret, "en", "x"), (21, secret, "en", "y"), (22, secret, "en", "y"), (None, secret, "en", None), (20, secret, "en", "x")]
    out = scan_history(table(rows), str(tmp_path / "ledger")).collect()
    assert len(out) == len(rows)
    by_blob = {r.blob: r.spans for r in out}
    assert len(by_blob) == len({t or "" for _, t, *_ in rows})
    spans = by_blob[hashlib.sha256(secret.encode()).hexdigest()]
    assert [(s.kind, s.start, s.stop) for s in spans] == brute(secret)
    assert sum(len(r.spans) for r in out) == 5


def test_only_unseen_pairs_are_scanned(spark, table, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    version = rule_version(RULES)
    scan_history(table([(1, "token: abcdef0", "en", "x"), (2, "plain", "en", "x")]), ledger).collect()
    assert sl.read_ledger(spark, ledger, version).count() == 2
    out = scan_history(table([(3, "plain", "en", "x"), (4, "new", "en", "x"), (5, "token: abcdef0", "en", "y")]), ledger)
    assert {r.doc_id: len(r.spans) for r in out.collect()} == {3: 0, 4: 0, 5: 1}
    # Two blobs were known: only the third was added.
    assert sl.read_ledger(spark, ledger, version).count() == 3
    # A changed rule set is a new version and scans all blobs again; the old version's findings stay.
    other = (Rule("plain", "plain", 1),)
    assert {r.doc_id: len(r.spans) for r in scan_history(table([(3, "plain", "en", "x")]), ledger, rules=other).collect()} == {3: 1}
    assert sl.read_ledger(spark, ledger, version).count() == 3


def test_empty(table, tmp_path):
    assert scan_history(table([]), str(tmp_path / "ledger")).count() == 0
