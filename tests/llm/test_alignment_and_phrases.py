"""SimHash groups, token alignment and collocations against plain Python, on
the driver's documents and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import collocations, queries, simhash_dedup, token_alignment
from tidemark.llm.common import table
from tidemark.llm.tokens import vocabulary

SMALL = "/root/testdata/sf0.001"


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module", params=["driver", "odd"])
def both(request, spark, odd):
    return table(spark, SMALL, "documents") if request.param == "driver" else odd


def test_empty_tables(empty):
    assert simhash_dedup.groups(empty).count() == 0
    aligned = token_alignment.align(empty)
    assert token_alignment.scored(aligned, token_alignment.pair_counts(aligned)).count() == 0
    assert collocations.best(collocations.phrases(empty)).count() == 0


# --- 11: SimHash, vantage-point trees ---

def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    n = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + n]).encode(), 42) for k in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps):
    """Smallest identifier of each one's component; all pairs compared."""
    above = list(range(len(fps)))

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 4:
                above[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(fps):
        least[find(i)].append(doc)
    return [min(least[find(i)]) for i in range(len(fps))]


def test_groups(both):
    held = [(r["doc_id"], plain_fingerprint(r["text"])) for r in both.collect()]
    want = Counter((d, f, c) for (d, f), c in zip(held, components_of(held)))
    out = simhash_dedup.groups(both)
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in out.collect()) == want
    left = simhash_dedup.dedup(both)
    assert left.columns == both.columns and left.count() == len({c for _, _, c in want})


def test_identifiers_may_be_missing(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (5, "a b c d e"), (None, "quite another text it is"), (9, "")]
    out = simhash_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter([(None, 5), (7, 5), (5, 5), (None, None), (9, 9)])


@pytest.mark.parametrize("leaf, block", [(16, 4096), (64, 8)])
def test_no_link_is_lost_in_deep_trees_and_crowded_shards(spark, monkeypatch, leaf, block):
    """Random fingerprints, families a few bits apart and pairs at exactly 4 and 5 bits."""
    monkeypatch.setattr(simhash_dedup, "LEAF", leaf)
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rng = random.Random(leaf)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {rng.getrandbits(64) for _ in range(1200)} | {0}
    for f in rng.sample(sorted(fps), 60):
        fps |= {flip(f, 4), flip(f, 5), flip(f, 1)}
    seed = rng.getrandbits(64)
    fps |= {flip(seed, rng.choice([1, 2, 3])) for _ in range(500)}
    signed = [(int(np.array(f, np.uint64).view(np.int64)),) for f in fps]
    links = simhash_dedup.linked(spark.createDataFrame(signed, "fp long").repartition(4)).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    assert len(links) < 60 * len(fps)  # a family of 500 has over 100,000 linked pairs
    at = {f: i for i, (f,) in enumerate(signed)}
    above = list(range(len(signed)))

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    for r in links:
        above[find(at[r["a"]])] = find(at[r["b"]])
    want = components_of([(i, f & (1 << 64) - 1) for i, (f,) in enumerate(signed)])
    assert len({find(i) for i in range(len(signed))}) == len(set(want))


def test_triangle_bounds_prune():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, 4096, dtype=np.uint64)
    tree = simhash_dedup.plant(fps, 1 << 20, 0, 21)
    at, leaf = tree.visits(fps, 1)
    homes = tree.homes(fps)
    assert (leaf > homes[at]).all() and np.bincount(homes).max() < 200
    assert len(at) < 0.1 * len(fps) * 2 ** len(tree.points)


# --- 12: merge-path alignment ---

def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    one, other = token_alignment.vocabularies(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    out = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(one.bytes[k] for k in x) != whole or b"".join(other.bytes[k] for k in y) != whole:
            x = y = []
        ends = dict(zip(np.cumsum([len(one.bytes[k]) for k in x]).tolist(), range(len(x))))
        groups, links, at, i, j = [], [], 0, 0, 0
        for n, k in enumerate(y):
            at += len(other.bytes[k])
            if at in ends:
                m = ends[at]
                links.append((x[m], k))
                groups.append(",".join(map(str, x[i:m + 1])) + "|" + ",".join(map(str, y[j:n + 1])))
                i, j = m + 1, n + 1
        out.append((len(x), len(y), links, ";".join(groups)))
    return out


@pytest.mark.parametrize("work", [token_alignment.WORK, 50])
def test_alignment(both, spark, work):
    extra = [(90, "<|endoftext|> <s> <unk> <0x41>"), (91, "a▁b"), (92, "tab\tline\n\n日本語 😀 é\0"), (None, "none  of   it"), (92, " ")]
    docs = both.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = plain_alignment([t for _, t in held])
    n = Counter(p for _, _, links, _ in plain for p in links)
    most = defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    want = Counter((d, a, b, len(links), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), text.encode())
                   for (d, _), (a, b, links, text) in zip(held, plain))
    aligned = token_alignment.align(docs, work=work)
    out = token_alignment.scored(aligned, token_alignment.pair_counts(aligned))
    assert Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r[1:]) for r in out.collect()) == want


def test_query_hashes_the_groups(spark):
    out = queries.QUERIES["op12_merge_path_alignment"](spark, SMALL).collect()
    plain = plain_alignment([r["text"] for r in table(spark, SMALL, "documents").collect()])
    assert sorted(r["groups_sha256"] for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() if a else "" for a, _, _, t in plain)


def test_merge_path_cuts_equal_work():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(2))
        work = int(rng.integers(1, 40))
        i, j = token_alignment.merge_path(a, b, work)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (i[-1], j[-1]) == (len(a), len(b))
        assert (np.diff(i) + np.diff(j) <= work + 1).all()
        common = [x for p, q, r, s in zip(i, i[1:], j, j[1:]) for x in a[p:q][token_alignment.common_ends(a[p:q], b[r:s])[0]]]
        assert common == sorted(set(a) & set(b))


def test_pairs_have_a_bound():
    assert token_alignment.most_pairs([b"a", b"ba"], [b"a", b"cba", b"x"]) == 4  # a-a, ba-a, a-cba, ba-cba


# --- 13: collocations ---

def plain_phrases(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    long = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    over = defaultdict(int)
    for (lang, p), c in long.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                over[lang, p[i:i + k]] = max(over[lang, p[i:i + k]], c)
    out = defaultdict(list)
    for (lang, p), a in long.items():
        if over[lang, p] < a:
            s, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((" ".join(p), a, l, r, n[lang], s))
    return {(lang, k + 1, *x) for lang, held in out.items()
            for k, x in enumerate(sorted(held, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top])}


@pytest.mark.parametrize("least, top", [(5, 50), (20, 2000)])
def test_phrases(both, least, top):
    rows = [(r["lang"], r["text"]) for r in both.collect()]
    out = collocations.best(collocations.phrases(both, least=least), top)
    assert {tuple(r) for r in out.collect()} == plain_phrases(rows, least, top)


def test_hot_prefixes_are_split_and_missing_columns_count(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HEAVY", 50)
    monkeypatch.setattr(collocations, "_ROW", 64)
    monkeypatch.setattr(collocations, "_CODES", 500)
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "the", "The", "of", "a", *(f"w{k}" for k in range(12)), "été", "rare" + str(rng.random())])
    rows = [(None if i % 9 == 0 else "en" if i % 3 else "fr", None if i % 50 == 7 else " ".join(
        word() + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(0, 60)))) for i in range(500)]
    docs = spark.createDataFrame([(None, *r) for r in rows], "doc_id long, lang string, text string").repartition(5)
    out = collocations.best(collocations.phrases(docs, least=10), 500)
    assert {tuple(r) for r in out.collect()} == plain_phrases(rows, 10, 500)


def test_scores_pass_64_bits(spark):
    docs = spark.createDataFrame([(1, "en", "x y z " * 150)], "doc_id long, lang string, text string")
    big = collocations.phrases(docs)
    assert {(r["phrase"], r["a"], r["score"]) for r in big.collect()} == {(p, a, s) for _, _, p, a, _, _, _, s in plain_phrases([("en", "x y z " * 150)], 100, 99)}
    exact = spark.sql("""select (cast(3000000000000 as decimal(19,0)) * cast(9000000000000 as decimal(16,0)) * cast(1000 as decimal(4,0)))
                         div (cast(4000000000007 as decimal(19,0)) * cast(3000000000001 as decimal(19,0))) as s""").first()["s"]
    assert exact == 1000 * 3000000000000 * 9000000000000 // (4000000000007 * 3000000000001)
