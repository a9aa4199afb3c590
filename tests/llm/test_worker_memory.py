"""What workers hold at a time, and that they give it back."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations, content_sort, near_dedup, token_alignment, tokens
from tidemark.llm.tokens import vocabulary

PATHS = {"a_path": vocabulary(token_alignment.A_FILE), "b_path": vocabulary(token_alignment.B_FILE)}


def test_freed_memory_goes_back_at_a_tasks_end(monkeypatch):
    released = []
    monkeypatch.setattr(tokens.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(1)))
    run = tokens.gives_back(lambda batches, more: (b + more for b in batches))
    assert list(run([1, 2], more=5)) == [6, 7] and released == [1]
    for f in (near_dedup._sign, near_dedup._linked, near_dedup._blocks_link, content_sort._walk, token_alignment._encode,
              token_alignment._score, collocations._stripes, collocations._merge):
        assert hasattr(f, "__wrapped__")


@pytest.mark.parametrize("rows", [8, 2000])
def test_batches_are_bounded_by_rows_and_bytes(spark, rows):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with near_dedup._small_batches(spark, rows):
        assert int(spark.conf.get(key)) == near_dedup.BATCH_BYTES
        texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 4096) as t")
        n = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert spark.conf.get(key) == before
    assert sum(n) == 3000 and max(n) <= min(rows, near_dedup.BATCH_BYTES // 4096 + 1)


def test_alignment_takes_texts_and_ids_in_small_blocks():
    text = "some words of a text that go on, again and again " * 20
    docs = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array([text] * 3000)], ["row", "doc_id", "text"])
    encoded = list(token_alignment._encode(iter([docs]), **PATHS, work=1 << 20))
    assert sum(b.num_rows for b in encoded) == 3000
    assert max(b.num_rows for b in encoded) * len(text) <= 1 << 20
    whole = pa.Table.from_batches(encoded).combine_chunks().to_batches()[0]
    [count] = token_alignment._count(iter([whole]))
    pairs, n = (c.to_numpy() for c in count.columns)
    held = SimpleNamespace(value=(pairs, n, n > 0))
    out = list(token_alignment._score(iter([whole]), held, 60_000, 40_000))
    assert len(out) > 1 and [r for b in out for r in b.column("row").to_pylist()] == list(range(3000))
    assert sum(sum(b.column("n_links").to_pylist()) for b in out) == n.sum()


def test_stripes_are_built_by_turns(monkeypatch):
    monkeypatch.setattr(collocations, "_WINDOWS", 100)
    codes = np.random.default_rng(3).integers(0, 30, 3000).astype(np.uint64)
    nothing = collocations.Bits(np.zeros(8, np.uint8), 6)
    for size in (1, 2):
        out = list(collocations.stripes(codes, "en", size, None, nothing))
        assert len(out) > 10
        keys = [k for b in out for k in b.column("key").to_pylist()]
        assert len(keys) == len(set(keys))
        got = Counter()
        for b in out:
            for k, n in zip(b.column("key").to_pylist(), b.column("counts").to_pylist()):
                got[tuple(np.frombuffer(k[:8 * size], ">u8").tolist())] += sum(n)
        c = codes.tolist()
        assert got == Counter(w for w in (tuple(c[i:i + size]) for i in range(len(c) - size + 1)) if all(w))


def test_codes_are_written_in_short_rows():
    text = b"one two three. " * 40_000
    docs = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text], pa.binary())], ["lang", "text"])
    every = SimpleNamespace(value=collocations.Bits(np.full(8, 255, np.uint8), 6))
    rows = [r for b in collocations._encode(iter([docs]), 0, every) for r in b.column("codes").to_pylist()]
    assert max(map(len, rows)) <= 8 * (4096 + 4)  # a reader takes 64 of them, a page of Parquet 100: 3 MB
    three = [collocations._code_of(w, 0) for w in (b"one", b"two", b"three")]
    assert np.frombuffer(b"".join(rows), np.uint64).tolist() == [*three, 0] * 40_000


def test_tables_of_phrases_are_read_by_few_rows_and_kept_in_few_files(spark, monkeypatch):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before, write, jobs = spark.conf.get(key), collocations.materialize, []

    def seen(df, **options):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        jobs.append(("MapInArrow" in plan, int(spark.conf.get(key)), "RebalancePartitions" in plan, options))
        return write(df, **options)

    monkeypatch.setattr(collocations, "materialize", seen)
    docs = spark.createDataFrame([("en", "a b c d e f. " * 50), ("en", "a b c. " * 50), (None, None)], "lang string, text string")
    got = {r.phrase: r.a for r in collocations.phrases(docs, least=50, longest=3).collect()}
    assert got == {"a b c": 100, "b c d": 50, "c d e": 50, "d e f": 50}
    python = [j for j in jobs if j[0]]
    assert [rows for _, rows, _, _ in python] == [64] * 4 and spark.conf.get(key) == before
    # the words and the merged stripes of each length, which leave few rows of many tasks; codes are as many as the texts' tasks
    assert [even for _, _, even, _ in python] == [True, False, True, True]
    assert int(python[1][3]["parquet.block.size"]) <= 16 << 20
