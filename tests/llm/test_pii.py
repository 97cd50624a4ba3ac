import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    v = [int(c) for c in digits][::-1]
    return (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m.group())] for k, p in BASE.items()}


FINDER = pii.Finder()


def check(text):
    got = FINDER.find(text)
    assert {k: got[k] for k in BASE} == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@._-+1 0()25:/é\n", max_size=50))
def test_random_texts(text):
    check(text)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="0123456789- .+", max_size=60))
def test_digit_texts(text):
    check(text)


def test_tables(docs):
    for r in docs.collect():
        check(r["text"])


def test_query_columns(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.digest(docs).collect():
        b = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [len(b[k]) for k in BASE]
        base = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in b[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["spans"] + ",").startswith(base and base + ",") and not base or r["spans"].startswith(base)


def test_added_kinds():
    find = lambda t: {k: [t[s:e] for s, e in v] for k, v in FINDER.find(t).items() if v}
    assert find('token = "24be64439e3e49cf46b2"')["secret"] == ["24be64439e3e49cf46b2"]
    assert "secret" not in find("the token was lost; password: none") and "secret" not in find("tokens = 12345678x")
    assert find("IBAN: DE89 3704 0044 0532 0130 00.")["account"] == ["DE89 3704 0044 0532 0130 00"]
    assert "account" not in find("on account of rain 2020") and "account" not in find("subaccount 12345678")
    assert find("ssn 078-05-1120")["account"] == ["078-05-1120"]
    assert find("http://joe:pw1@host.org/x")["url_user"] == ["joe:pw1"] and "url_user" not in find("http://host.org/a@b")


def test_redaction(odd, empty, docs):
    text = "é a@b.co, call +1 555 123 4567 now 10.0.0.1"
    assert pii.masked(text, FINDER.find(text)) == "é [EMAIL], call [PHONE] now [IP]"
    clean = pii.redact(docs).collect()
    assert len(clean) == docs.count() and pii.redact(docs).columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in clean:
        if not any(FINDER.find(before[r["doc_id"]]).values()):
            assert r["text"] == before[r["doc_id"]]
        else:
            assert not any(before[r["doc_id"]][s:e] in r["text"] for s, e in FINDER.find(before[r["doc_id"]])["email"])
    out = pii.redact(odd).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert [r["text"] for r in out if r["doc_id"] == 1] == [None] and pii.redact(empty).count() == 0
    assert pii.digest(odd).count() == odd.count() and pii.digest(empty).count() == 0


def test_very_long_runs():
    for t in ("a" * 50_000 + "@", "1" * 50_000, "0" * 9000 + ".1.1.1", "+1" + " " * 50_000, "1.1." * 20_000):
        check(t)


def test_accounts_are_validated():
    find = lambda t: [t[a:b] for a, b in pii.Finder().find(t)["account"]]
    assert find("IBAN: DE89 3704 0044 0532 0130 00.") == ["DE89 3704 0044 0532 0130 00"] and find("iban GB82WEST12345698765432") == ["GB82WEST12345698765432"]
    assert find("IBAN: DE88 3704 0044 0532 0130 00.") == [] and find("IBAN 1234567890123456") == []
    assert find("ssn 078-05-1120 x") == ["078-05-1120"] and find("SSN: 666-12-3456") == [] and find("ssn 912-34-5678") == [] and find("ssn 123-00-4567") == []
    assert find("account no. 12345678") == ["12345678"] and find("passport: X1234567") == ["X1234567"]
