"""The pipeline's stages on their own input, and the SQL of the queries."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipe
from tidemark.llm import queries
from tidemark.llm.common import table
from tidemark.session import materialize

MID = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, MID, "documents")
    columns = docs.columns
    held = [docs]
    for _, stage in pipe.STAGES:
        held.append(materialize(stage(spark, held[-1], MID)))
    assert [name for name, _ in pipe.STAGES] == ["quality rules", "exact dedup", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    assert all(df.columns == columns for df in held[:-1])
    n = [df.count() for df in held]
    assert n[0] > n[1] > n[2] > n[3] and n[4] != n[3]
    assert held[2].select("text").distinct().count() == n[2]
    mixed = held[4].groupBy("doc_id").count()
    assert mixed.agg({"count": "max"}).first()[0] <= 3
    packed = held[5]
    assert packed.where("piece = 0").count() == n[4]
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def five_word_components(texts):
    """Smallest identifier of each component at five words and 0.8, all pairs compared."""
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    above = {i: i for i in sets}

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a > b else 0
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                above[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def test_near_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for k in range(60):
        base = draw(200)
        block = draw(rng.randrange(30, 60))  # 5-word similarity of about 0.76 to 0.86, 3-word similarity nearly the same
        edited = list(base)
        for at in rng.sample(range(200), rng.randrange(3, 8)):  # scattered edits: 3-word similarity is the higher one
            edited[at] = f"x{at}"
        texts += [(10 * k + 1, " ".join(base)), (10 * k + 2, " ".join(base + block)), (10 * k + 3, " ".join(edited))]
    left = pipe.near(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(3), MID)
    want = five_word_components(texts)
    assert 60 < len(want) < 180
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(want)


def test_a_run_owns_its_tables(spark, scratch):
    """Two runs, read in either order, also lazily."""
    small = "/root/testdata/sf0.001"
    a, b = pipe.run(spark, small), pipe.run(spark, small)
    want = sorted(map(tuple, b.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert want and sorted(map(tuple, a.select("doc_id", "piece", "length", "ids_crc32").collect())) == want


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_rows(spark, odd, empty, kind):
    docs = odd if kind == "odd" else empty
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = materialize(stage(spark, docs, MID))
        assert k == len(pipe.STAGES) - 1 or out.columns == docs.columns, name
        assert kind == "odd" or out.count() == 0, name
        docs = out if k < len(pipe.STAGES) - 1 else docs


def test_queries_are_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == [n for n in queries.QUERIES if n != "pipeline"] and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same(spark, name):
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{small}/{f}'")
    got = queries.QUERIES[name](spark, small)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert clean(got.select(columns).collect()) == clean(want.project(", ".join(columns)).fetchall())
