"""The pipeline against its stages in plain Python, each judged on what its predecessor kept."""

import zlib
from collections import Counter

import numpy as np
import zstandard

import corpus_pipeline as C
from presswire.llm import mixing, quality, secrets, simhash
from tests.llm.test_secrets import brute_base
from tests.llm.test_simhash import brute_print, roots
from tests.llm.test_tokens import ids_of


def test_stages(spark, sf, docs):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "secret scans", "mixing", "packing"]
    kept, rows = [], docs
    for _, stage in C.STAGES:
        rows = stage(spark, rows, sf)
        if stage is not C.STAGES[-1][1]:
            assert rows.columns == docs.columns
        rows = C.stored(rows, "test-pipeline")
        kept.append(rows.collect())
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    want = [r for r in docs.collect() if quality.measure(r.text, compress)[-1]]
    assert sorted(kept[0]) == sorted(want) and len(want) < docs.count()

    prints = {r.doc_id: brute_print(r.text) for r in want}
    arr = np.array(sorted(set(prints.values())), dtype=np.uint64)
    links = [(int(arr[i]), int(arr[j])) for i in range(len(arr))
             for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1:]) <= simhash.MAX_BITS) + i + 1]
    group = roots(arr.tolist(), links)
    first = {}
    for d, p in prints.items():
        first[group[p]] = min(d, first.get(group[p], d))
    want = [r for r in want if first[group[prints[r.doc_id]]] == r.doc_id]
    assert sorted(kept[1]) == sorted(want)

    old = {r.doc_id: r for r in want}
    assert sorted(r.doc_id for r in kept[2]) == sorted(old)
    for r in kept[2]:
        assert not brute_base(r.text) and not secrets.base_spans(r.text)
        assert r.source == old[r.doc_id].source and (r.text == old[r.doc_id].text or "[SECRET]" in r.text)
        if not brute_base(old[r.doc_id].text):
            assert r == old[r.doc_id]

    shares = mixing.sainte_lague_mix(spark.createDataFrame(kept[2], docs.schema)).collect()
    times = {r.doc_id: min(2, int(r.taken / r.size + 0.5)) for r in shares}
    assert Counter(r.doc_id for r in kept[3]) == Counter({d: n for d, n in times.items() if n})
    text = {r.doc_id: r.text for r in kept[2]}
    assert all(r.text == text[r.doc_id] for r in kept[3])

    want = Counter()
    for r, ids in zip(kept[3], ids_of([r.text for r in kept[3]]), strict=True):
        ids = np.array([*ids, 1], dtype="<u4")
        for s in range(0, len(ids), 2048):
            want[r.doc_id, s, ids[s:s + 2048].tobytes()] += 1
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in kept[4]) == want
    used = Counter()
    for r in kept[4]:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))


def test_run_and_empty_tables(spark, sf, empty, tmp_path):
    assert C.run(spark, sf).count() > 0
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, odd):
    for _, stage in C.STAGES:
        assert stage(spark, odd, "").count() >= 0


def test_null_and_repeated_ids_are_rows_of_their_own(spark, tmp_path):
    def prose(k):
        return " ".join(f"w{k}x{i}" for i in range(40))

    rows = [(1, prose(1)), (1, prose(1)), (2, prose(2)), (2, prose(3)), (3, prose(3)), (None, prose(4)), (None, prose(4)),
            (None, prose(1)), (None, prose(5))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/rows")
    for given in (docs, spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/rows").repartition(3)):
        got = Counter((r.doc_id, r.text) for r in C.near_dedup(spark, given, "").collect())
        assert got == Counter([(1, prose(1)), (2, prose(2)), (2, prose(3)), (None, prose(4)), (None, prose(5))])

        # one source of 360 words: its target of 1.5 x 360 = 540 words, in whole documents of 40 words but for the ends
        shares = mixing.sainte_lague_mix(C.with_row_key(given, "test"), row=("_row",)).collect()
        assert len({r._row for r in shares}) == len(rows)
        want = Counter(r.doc_id for r in shares for _ in range(min(2, int(r.taken / r.size + 0.5))))
        mixed = C.mix(spark, given, "").collect()
        assert Counter(r.doc_id for r in mixed) == want and abs(len(mixed) - 1.5 * len(rows)) <= 1
        assert all(n <= 2 * rows.count(k) for k, n in Counter((r.doc_id, r.text) for r in mixed).items())


def test_rows_taken_twice_come_twice(spark, monkeypatch):
    monkeypatch.setattr(C, "sainte_lague_mix", lambda docs, row=(): docs.select(
        *row, C.F.lit(3).alias("size"), C.F.when(docs.text == "d e f", 3).otherwise(6).alias("taken")))
    rows = [(1, "a b c")] * 2 + [(None, "a b c"), (2, "d e f"), (2, "g h i")]
    docs = spark.createDataFrame([(i, t, "en", "a", 5) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in C.mix(spark, docs, "").collect())
    assert got == {(1, "a b c"): 4, (None, "a b c"): 2, (2, "d e f"): 1, (2, "g h i"): 2}
