import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from presswire.llm import alignment
from presswire.llm.tokens import vocabulary

PATHS = (vocabulary(), vocabulary("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """The contract in plain Python, token by token: rows (doc_id, text) to rows of COLUMNS."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        spell_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        spell_b = [bytes_b(i) for i in ids_b]
        if not text or b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            docs.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:p], ids_b[j:q]))
            i, j = p, q
        docs.append(groups)
    counts = Counter(p for groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), groups in zip(rows, docs, strict=True):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def same(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_same_groups(work):
    rng = np.random.default_rng(work)
    for _ in range(200):
        top = int(rng.integers(2, 60))
        a, b = (np.append(np.unique(rng.integers(1, top, rng.integers(1, 40))), top) for _ in range(2))
        i, j = alignment.diagonals(a, b, work)
        assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
        common = np.intersect1d(a, b)
        got = alignment.group_sizes(a, b, work)
        for ends, sizes in zip((a, b), got, strict=True):
            assert sizes.tolist() == np.diff(np.searchsorted(ends, common, side="right"), prepend=0).tolist()


def test_lists_without_a_common_last_end_are_an_error():
    with pytest.raises(ValueError):
        alignment.group_sizes(np.array([1, 2]), np.array([1, 3]))


def test_whole_table_equals_brute_force(docs):
    same(alignment.align_tokens(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(odd, odd_rows, spark, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 64)
    same(alignment.align_tokens(odd), [r[:2] for r in odd_rows])
    more = [(1, "▁ mark"), (2, "a" * 5000), (3, " "), (4, "<s></s><unk><0x41>"), (5, "é😀\0\r\n"), (6, "=" * 777 + "-" * 345),
            (7, "<|endoftext|>"), (7, "<|endoftext|>")]
    same(alignment.align_tokens(spark.createDataFrame(more, "doc_id long, text string")), more)


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(0)
    size_a, size_b = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    ids_a, ids_b = rng.integers(0, 5, size_a.sum()), rng.integers(0, 5, size_b.sum())
    doc = np.sort(rng.integers(0, 4, 50))
    plain = alignment.link_pairs(ids_a, ids_b, size_a, size_b, doc, 10)
    monkeypatch.setattr(alignment, "WIDE", 6)
    wide = alignment.link_pairs(ids_a, ids_b, size_a, size_b, doc, 10)
    assert [x.tolist() for x in plain] == [x.tolist() for x in wide]


def test_groups_are_given_on_request(spark):
    got = alignment.align_tokens(spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string"), groups=True)
    rows = {r.doc_id: r.groups for r in got.collect()}
    assert [g.count("|") for g in rows[1].split(";")] == [1] * len(rows[1].split(";")) and rows[2] == ""


def test_empty_table(empty):
    assert alignment.align_tokens(empty).collect() == []
