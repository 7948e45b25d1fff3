import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import secrets

RULES = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.I), 2, 8),
         (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]


def base(text):
    out = []
    for kind, (rule, group, least) in enumerate(RULES):
        out += [(m.start(), kind, m.end()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


PARTS = ["password", "PassWord", "ſecret", "secret", "token", "api_key", "apikey", "toKen", "=", ": ", " = \"", "'", "AKIA", "AKIAABCDEFGH123456", "deadbeef" * 4, "0123456789abcdef", "abc12345",
         "aB3/" * 10, "user=", "bob", "https://host/x", " ", "\n", "é", "😀", "passwd:xxxxxxxxx", "k=v"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_findings_stay(text):
    found = secrets.findings(text)
    assert [f for f in found if f[1] < 3] == base(text)
    assert found == sorted(set(found))


def test_weak_parts_need_their_complement():
    key = "aB3" * 10
    assert secrets.findings(f"commit {key} done") == []
    assert secrets.findings("see https://example.org/docs and user=alice") == []
    kinds = [secrets.KINDS[k] for _, k, _ in secrets.findings(f"https://db.example.org user=alice\n{key}")]
    assert kinds == ["endpoint", "login", "key"]
    apart = f"user=alice {'. ' * secrets.SCOPE} {key}"
    assert secrets.findings(apart) == []


def test_messy_table(messy):
    out = secrets.scan(messy)
    assert out.count() == messy.count() and {len(r["secrets"]) for r in out.collect()} == {0}
    assert secrets.scan(messy.limit(0)).count() == 0
