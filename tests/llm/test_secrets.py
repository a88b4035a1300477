import hashlib
import itertools
import re

import numpy as np
import pytest

from presswire.llm import secrets as S


def brute_base(text):
    out = []
    for k, (kind, rx, group, least) in enumerate((
            ("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)))""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(rx, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


@pytest.fixture(scope="module")
def model(docs):
    return S.train(docs)


def check(rows, given):
    assert len(rows) == len(given)
    want = sorted((d or -1, hashlib.sha256(brute_base(t or "").encode()).hexdigest(),
                   *(brute_base(t or "").count(f"{k}:") for k in ("assign", "access", "hex"))) for d, t in given)
    assert sorted((r.doc_id or -1, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in rows) == want
    base = {(r.doc_id, r.base_sha256): set(filter(None, r.spans.split(","))) for r in rows}
    for d, t in given:
        spans = base[d, hashlib.sha256(brute_base(t or "").encode()).hexdigest()]
        assert set(filter(None, brute_base(t or "").split(","))) <= spans  # base spans stay


def test_documents(docs, odd, odd_rows, empty, model):
    check(S.scan_secrets(docs, model).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check(S.scan_secrets(odd, model).collect(), [r[:2] for r in odd_rows])
    assert S.scan_secrets(empty).collect() == []  # fitted on generated lines alone


def test_base_patterns():
    text = 'PassWord = "abc12" token:abcdef secret=x é ſecret=abcdefgh API_KEY="a.b=c-d" ' + "f" * 23 + " " + "0af" * 8 + " AKIA" + "Z" * 15
    got = ",".join(f"{k}:{a}:{b}" for a, k, b in S.base_spans(text))
    assert got == brute_base(text) and got.count("assign") == 2 and got.count("hex") == 1 and "access" not in got


def test_held_out_accuracy(model):
    right = total = clean = false = 0
    for text, secrets in S.generated(1200, seed=77):
        got = model.spans(text)
        total += 1
        right += got == secrets
        clean += not secrets
        false += bool(got) and not secrets
    assert right / total > 0.95 and false / clean < 0.02


def test_method_finds_more_than_the_base_patterns(model):
    text = "set the auth_key := 'xK9dLq27TzPw3mBv81Rn' before noon"
    assert S.base_spans(text) == []
    assert [text[a:b] for a, _, b in S.all_spans(text, model)] == ["xK9dLq27TzPw3mBv81Rn"]


def test_method_leaves_documents_without_secrets_alone(docs, model):
    for r in docs.collect():
        if not brute_base(r.text):
            assert S.all_spans(r.text, model) == [], r.text[:80]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    moves = rng.normal(size=(3, 3))
    moves[0, 2] = -np.inf
    for n in (1, 2, 5):
        scores = rng.normal(size=(n, 3))

        def value(path, scores=scores):
            return sum(scores[i, x] + moves[path[i - 1] if i else 0, x] for i, x in enumerate(path))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert tuple(S.viterbi(scores, moves)) == best


def test_redaction(docs, odd, empty, model):
    rows = {r.doc_id: r for r in docs.collect()}
    out = S.redact_secrets(docs, model)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        spans = S.all_spans(rows[r.doc_id].text, model)
        assert (r.text == rows[r.doc_id].text) == (not spans) and not brute_base(r.text)
        assert r.n_chars == (len(r.text) if spans else rows[r.doc_id].n_chars)
    assert S.redact_secrets(odd, model).count() == odd.count() and S.redact_secrets(empty, model).count() == 0
    assert S.replaced("ab cd ef", [(0, "x", 4), (1, "y", 2), (6, "z", 8)], "*") == "*d *"


def test_method_spans_that_overlap_base_spans_stay():
    class Whole:
        def __init__(self, *spans):
            self.spans = lambda text: list(spans)

    text = 'password="Xk9dLq$27TzPw3mBv81Rn" next'
    base = S.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ['password="Xk9dLq']
    got = S.all_spans(text, Whole((10, 31)))
    assert got == [*base, (10, "crf", 31)] and S.replaced(text, got, "*") == '*" next'
    assert S.all_spans(text, Whole((10, 16))) == base  # covered already
    key = "zq" + "0af1" * 6 + "XYZ"
    assert S.replaced(f"a {key} b", S.all_spans(f"a {key} b", Whole((2, 2 + len(key)))), "*") == "a * b"


@pytest.mark.parametrize("text,secret", [
    ("set passphrase: qTbwLkZrmXv before noon", "qTbwLkZrmXv"), ('auth_key="kwzqhgbtrxm"', "kwzqhgbtrxm"),
    ("the credential => 'MorvaLintekSuhol' is old", "MorvaLintekSuhol")])
def test_announced_secrets_of_letters(model, text, secret):
    assert S.base_spans(text) == []
    assert [text[a:b] for a, _, b in S.all_spans(text, model)] == [secret]
