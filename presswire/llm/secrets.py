"""Secret scans: base patterns plus a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import tune

#: kind, pattern, group whose length counts, least length.  Letters of the first in either case.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Finds the same hex runs faster: a run shorter than the least length can't match.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
METHOD = "crf"
KINDS = (*(b[0] for b in BASE), METHOD)

#: Labelled rows that the model is fitted on: documents of the table (by hashed id) of at most so many
#: bytes, and generated lines.
SAMPLE_DOCS = 600
SAMPLE_BYTES = 20_000
GENERATED = 2500
OUTSIDE, BEGIN, INSIDE = range(3)
#: Tokens of a chain kept for fitting; decoding takes chains whole.
FIT_TOKENS = 24

_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\x20\x09-\x0DA-Za-z0-9+/_-]")
#: A chain: the run without white space around a digit, or around a long token.
_WITH_DIGIT = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]{20,}+(?![0-9])")
_WORD_BEFORE = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that announce a secret (own list).
HINTS = frozenset("password passwd pwd pass passphrase secret token key apikey api_key auth authorization bearer "
                  "credential credentials private signature access access_key secret_key".split())
#: A link mark before letters, and an announcing word right before that mark.
_LINKED = re.compile(r"""(?::=|=>|[:=])\x20*["']?(?=[A-Za-z][A-Za-z+/_-]{5})""")
_SAID = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(HINTS)) + r""")["']?\x20*\Z""", re.ASCII | re.IGNORECASE)
ANNOUNCED = "announced"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base matches, by start, then kind as listed."""
    found = []
    for kind, rx, group, least in BASE:
        for m in (_HEX if kind == "hex" else rx).finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


# --- features ---------------------------------------------------------------

def _step(n: float, edges) -> int:
    return sum(n >= e for e in edges)


def shape(token: str) -> list[str]:
    """What a token looks like: kinds of characters, length, digits, changes between kinds."""
    if not token[0].isascii() or (len(token) == 1 and not token.isalnum()):
        return ["mark=" + (token if token.isascii() else "other")]
    digits = sum(c.isdigit() for c in token)
    mix = ("d" if digits else "") + ("l" if re.search("[a-z]", token) else "") + (
        "u" if re.search("[A-Z]", token) else "") + ("s" if re.search("[+/_-]", token) else "")
    kinds = re.sub("[+/_-]", "s", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "d", token)))
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    size = _step(len(token), (4, 6, 8, 12, 16, 20, 24, 32, 40, 64))
    return ["mix=" + mix, f"len={size}", f"mixlen={mix},{size}", f"turns={_step(turns, (1, 2, 4, 7, 12))}",
            f"digits={_step(digits / len(token), (0.01, 0.15, 0.4, 0.7, 1.0))}",
            *(["hex"] if len(token) >= 8 and re.fullmatch("[0-9a-f]+", token) else [])]


def _announces(token: str) -> bool:
    t = token.lower().strip("_-")
    return t in HINTS or t.rsplit("_", 1)[-1] in HINTS or t.rsplit("-", 1)[-1] in HINTS


def file_features(text: str) -> list[str]:
    """Of the whole text: how much it looks like code or settings, and how many digits it has."""
    n = len(text) + 1
    marks = sum(text.count(c) for c in "={};\"'_")
    digits = sum(text.count(c) for c in "0123456789")
    return [f"file_marks={_step(marks / n, (0.002, 0.01, 0.03, 0.08))}",
            f"file_digits={_step(digits / n, (0.002, 0.01, 0.05, 0.2))}"]


def chain_features(tokens: list[str], before: list[str], after: str, of_file: list[str]) -> list[list[str]]:
    """Feature names of each token of a chain: own shape, neighbouring tokens and words, file."""
    shapes = [shape(t) for t in tokens]
    out = []
    said = any(_announces(w.strip("\"':=,;()[]{}")) for w in before[-2:])
    link = bool(before) and before[-1][-1:] in ":="
    for i, t in enumerate(tokens):
        said_here = any(_announces(x) for x in tokens[max(0, i - 4):i])
        names = ["bias", *shapes[i], f"first={i == 0}", f"last={i == len(tokens) - 1}"]
        names += ["prev:" + (shapes[i - 1][0] if i else "start"), "next:" + (shapes[i + 1][0] if i + 1 < len(tokens) else "end")]
        names += [f"word_said={said}", f"word_link={link}", f"said={said_here}", f"any_said={said or said_here}"]
        names += [f"said,{x}" for x in shapes[i][:3] if said or said_here]
        names += [f"after_mark={after[:1] in '.,;:' if after else False}", f"chain={_step(len(tokens), (2, 4, 8, 16))}"]
        out.append(names + of_file)
    return out


def may_be_secret(token: str) -> bool:
    """Lattice constraint: other tokens are outside whatever the weights, unless they are announced."""
    return token[0].isascii() and (len(token) >= 20 or (len(token) >= 6 and any(c.isdigit() for c in token)))


def announced(text: str) -> set[int]:
    """Starts of the tokens of six or more letters right behind an announcing word and a link mark."""
    return {m.end() for m in _LINKED.finditer(text) if _SAID.search(text, max(0, m.start() - 40), m.start())}


def chains(text: str):
    """(start, tokens, their starts, features) of every chain of the text."""
    said = announced(text)
    if not said and not any(c in text for c in "0123456789") and not _LONG.search(text):
        return
    of_file = None
    spans = [m.span() for m in _WITH_DIGIT.finditer(text)]
    for a, b in [*(m.span() for m in _LONG.finditer(text)), *((s, s + 1) for s in said)]:
        while a and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        while b < len(text) and text[b] not in " \t\n\x0b\x0c\r":
            b += 1
        spans.append((a, b))
    for a, b in sorted(set(spans)):
        found = [(m[0], m.start()) for m in _TOKEN.finditer(text, a, b)]
        if not any(may_be_secret(t) or s in said for t, s in found):
            continue
        if of_file is None:
            of_file = file_features(text)
        before = _WORD_BEFORE.findall(text[max(0, a - 60):a])
        after = _WORD_BEFORE.search(text, b, b + 40)
        tokens = [t for t, _ in found]
        features = chain_features(tokens, before, after[0] if after else "", of_file)
        for names, (_, s) in zip(features, found, strict=True):
            if s in said:
                names.append(ANNOUNCED)
        yield a, tokens, [s for _, s in found], features


# --- model ------------------------------------------------------------------

def allowed(tokens: list[str], features: list[list[str]]):
    """0 where a label is possible, else minus infinity: a mark can only go on with a secret."""
    import numpy as np

    bar = np.zeros((len(tokens), 3))
    for i, t in enumerate(tokens):
        if not may_be_secret(t) and ANNOUNCED not in features[i]:
            bar[i, BEGIN] = -np.inf
            if len(t) > 1 and not t.isalnum() or not t.isascii() or t in "\"'<>(){}[],;":
                bar[i, INSIDE] = -np.inf
    return bar


def viterbi(scores, moves):
    """Best label sequence of one chain: scores (n, 3), moves (3, 3); it starts as if after an outside token."""
    import numpy as np

    best, back = scores[0] + moves[OUTSIDE], []
    for s in scores[1:]:
        every = best[:, None] + moves
        back.append(every.argmax(axis=0))
        best = every.max(axis=0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Crf:
    """Weights by feature and label, and moves between labels."""

    def __init__(self, names: dict, weights, moves):
        self.names, self.weights, self.moves = names, weights, moves

    def scores(self, tokens, features):
        import numpy as np

        known = self.names
        rows = [self.weights[[known[f] for f in fs if f in known]].sum(axis=0) for fs in features]
        return np.array(rows).reshape(-1, 3) + allowed(tokens, features)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that the decoded labels mark as secrets."""
        out = []
        for _, tokens, at, features in chains(text):
            path = viterbi(self.scores(tokens, features), self.moves)
            for t, s, label in zip(tokens, at, path, strict=True):
                if label == BEGIN:
                    out.append([s, s + len(t)])
                elif label == INSIDE and out:
                    out[-1][1] = s + len(t)
        return [tuple(x) for x in out]


def fit(examples, rounds: int = 150, rate: float = 0.1, l2: float = 0.02) -> Crf:
    """Maximum likelihood (forward-backward, Adam) over (tokens, features, labels) chains."""
    import numpy as np

    names: dict[str, int] = {}
    for _, features, _ in examples:
        for fs in features:
            for f in fs:
                names.setdefault(f, len(names))
    n, top = len(examples), max(len(t) for t, _, _ in examples)
    flat = np.zeros((sum(len(t) for t, _, _ in examples), len(names)), dtype=np.float32)  # a row per token
    at = 0
    bar, gold, live = np.zeros((n, top, 3)), np.zeros((n, top), dtype=int), np.zeros((n, top), dtype=bool)
    for i, (tokens, features, labels) in enumerate(examples):
        for fs in features:
            flat[at, [names[f] for f in fs]] = 1
            at += 1
        bar[i, :len(tokens)] = allowed(tokens, features)
        gold[i, :len(tokens)], live[i, :len(tokens)] = labels, True
    bar = np.where(np.isinf(bar), -30.0, bar)
    stop = np.array([[0, 0, -30.0], [0, 0, 0], [0, 0, 0]])
    w, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    want_w = flat.T @ np.eye(3)[gold[live]]
    prev = np.concatenate([np.zeros((n, 1), dtype=int), gold[:, :-1]], axis=1)
    want_m = np.zeros((3, 3))
    np.add.at(want_m, (prev[live], gold[live]), 1)
    m1, m2 = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for turn in range(1, rounds + 1):
        s = bar.copy()
        s[live] += flat @ w.astype(np.float32)
        mv = moves + stop
        f = [s[:, 0] + mv[OUTSIDE]]
        for t in range(1, top):
            f.append(np.where(live[:, t, None], lse(f[-1][:, :, None] + mv, 1) + s[:, t], f[-1]))
        z = lse(f[-1], 1)
        b, marg, moved = np.zeros((n, 3)), np.zeros((n, top, 3)), np.zeros((3, 3))
        for t in range(top - 1, -1, -1):
            marg[:, t] = np.exp(f[t] + b - z[:, None]) * live[:, t, None]
            if t:
                pair = np.exp(f[t - 1][:, :, None] + mv + (s[:, t] + b)[:, None, :] - z[:, None, None])
                moved += (pair * live[:, t, None, None]).sum(axis=0)
                b = np.where(live[:, t, None], lse(mv + (s[:, t] + b)[:, None, :], 2), b)
            else:
                moved[OUTSIDE] += marg[:, 0].sum(axis=0)
        grads = [(want_w - flat.T @ marg[live]) - l2 * w, (want_m - moved) - l2 * moves]
        for k, (value, grad) in enumerate(zip((w, moves), grads, strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.99 * m2[k] + 0.01 * grad**2
            value += rate * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.99**turn)) + 1e-6)
    return Crf(names, w, moves + np.where(stop < 0, -np.inf, 0))


# --- labelled rows ------------------------------------------------------------

def labelled(text: str, secrets: list[tuple[int, int]]):
    """Fitting examples of a text whose secrets (start, end) are known."""
    for _, tokens, at, features in chains(text):
        labels, inside = [], None
        for t, s, names in zip(tokens, at, features, strict=True):
            hit = next((k for k, (a, b) in enumerate(secrets) if a <= s < b), None)
            can = may_be_secret(t) or ANNOUNCED in names
            labels.append(OUTSIDE if hit is None else INSIDE if hit == inside else BEGIN if can else OUTSIDE)
            inside = hit if labels[-1] != OUTSIDE else None
        yield tokens[:FIT_TOKENS], features[:FIT_TOKENS], labels[:FIT_TOKENS]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secret itself of each base match: of an assignment the value."""
    return [m.span(group) for _, rx, group, least in BASE for m in rx.finditer(text) if len(m[group]) >= least]


def generated(count: int, seed: int = 11):
    """Lines with known secrets and with numbers that are none (text, secrets)."""
    import random

    rng = random.Random(seed)
    low, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    run = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    digits = lambda a, b=None: run("0123456789", a, b or a)
    word = lambda: run(low, 2, 9)
    key = lambda: rng.choice(sorted(HINTS)) if rng.random() < 0.6 else f"{word()}_{rng.choice(sorted(HINTS))}"
    strong = [lambda: run("0123456789abcdef", 24, 64), lambda: run(alnum, 20, 48), lambda: run(alnum + "+/", 28, 64),
              lambda: "AKIA" + run("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 16),
              lambda: run(low, 2, 4) + rng.choice("_-") + run(alnum, 24, 40)]
    weak = [lambda: run("0123456789abcdef", 10, 20), lambda: run(alnum, 8, 18), lambda: word() + digits(2, 5) + run(alnum, 3, 6),
            lambda: run(low, 8, 18), lambda: run(low + low.upper(), 8, 18), lambda: "".join(word().capitalize() for _ in range(3))]
    plain = [lambda: f"{word()}.{digits(1, 3)}@{word()}{digits(1)}.{word()}.com", lambda: ".".join(digits(1, 3) for _ in range(4)),
             lambda: f"+{digits(1, 2)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: digits(16), lambda: digits(1, 8),
             lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1, 2)}",
             lambda: f"{word()}{digits(1, 3)}", lambda: word().upper() + digits(2, 4), lambda: f"${digits(1, 3)},{digits(3)}.{digits(2)}",
             lambda: f"https://{word()}.org/{word()}/{digits(2, 6)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
             lambda: "-".join(word() for _ in range(4)), lambda: word() + word() + word() + word(), lambda: digits(18, 22),
             lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{word()}_{word()}_{digits(1, 3)}"]
    for _ in range(count):
        left, right = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
        kind = rng.random()
        if kind < 0.25:  # announced
            k, q, value = key(), rng.choice(["", '"', "'"]), rng.choice(strong + weak)()
            gap = rng.choice([" ", ""]), rng.choice(["=", ":", ":=", "=>"]), rng.choice([" ", ""])
            middle = f"{k}{gap[0]}{gap[1]}{gap[2]}{q}"
            tail = q
        elif kind < 0.4:  # bare, but nothing else looks so
            middle, value, tail = "", rng.choice(strong)(), rng.choice(["", "", ",", "."])
        else:
            middle, value, tail = rng.choice(["", "", "no. ", f"{word()}: ", f"{word()} = "]), rng.choice(plain)(), rng.choice(["", "", ",", "."])
        start = len(left) + bool(left) + len(middle)
        text = f"{left}{' ' if left else ''}{middle}{value}{tail}{' ' if right else ''}{right}"
        yield text, [(start, start + len(value))] if kind < 0.4 else []


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES,
          made: int = GENERATED) -> Crf:
    """Fit on at most ``sample_docs`` documents labelled by the base patterns, and on generated lines.

    The sample is drawn by the hash of doc_id among texts of at most ``sample_bytes`` bytes, so reruns
    agree; it bounds what the driver holds (sample_docs * sample_bytes).
    """
    h = F.xxhash64(F.lit(3), "doc_id")
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id", h.alias("h"))
           .distinct().orderBy("h", "doc_id").limit(sample_docs).collect()]
    texts = [] if not ids else [r[0] for r in docs.where(F.col("doc_id").isin(ids))
                                .where(F.octet_length("text") <= sample_bytes)
                                .groupBy("doc_id").agg(F.min("text").alias("t")).orderBy("doc_id").select("t").collect()]
    examples = [x for t in texts for x in labelled(t, secret_parts(t))]
    examples += [x for t, s in generated(made) for x in labelled(t, s)]
    return fit(examples)


# --- scan ---------------------------------------------------------------------

def all_spans(text: str, model: Crf) -> list[tuple[int, str, int]]:
    """Base spans, and the model's spans that reach beyond them; the two may overlap."""
    base, extra = base_spans(text), []
    for a, b in model.spans(text):
        at = a
        for s, _, e in base:
            if s <= at < e:
                at = e
        if at < b:
            extra.append((a, METHOD, b))
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[1])))


def digest_row(spans) -> dict:
    import hashlib

    join = lambda some: ",".join(f"{k}:{a}:{b}" for a, k, b in some)
    base = [s for s in spans if s[1] != METHOD]
    return {f"n_{k}": sum(s[1] == k for s in spans) for k in KINDS} | {
        "base_sha256": hashlib.sha256(join(base).encode()).hexdigest(), "spans": join(spans)}


def scan_secrets(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans of every document, row by row.

    Spans are kind:start:end in code points, by start, then kind.  A null text counts as empty (no
    spans).  Repeated rows each give a row, an empty table none; extra columns are not read.  The
    model is small (a weight for each feature seen in the sample) and goes with the tasks.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model or train(docs))
    columns = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{c} long" for c in columns) + ", base_sha256 string, spans string")
    def scan(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([digest_row(all_spans(t or "", held.value)) for t in text],
                            columns=[*columns, "base_sha256", "spans"])

    return docs.select("doc_id", scan.asNondeterministic()("text").alias("s")).select("doc_id", "s.*")


def redact_secrets(docs: DataFrame, model: Crf | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones joined) replaced by ``mark``; n_chars follows the new text.

    Every document stays; texts without secrets, and null texts, are unchanged.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("string")
    def redact(text: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else replaced(t, all_spans(t, held.value), mark) for t in text], dtype=object)

    out = docs.withColumn("_clean", redact.asNondeterministic()("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_clean") == F.col("text"), F.col("n_chars")).otherwise(
            F.length("_clean")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("_clean")).select(docs.columns)


def replaced(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
