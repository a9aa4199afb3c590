"""The operators against plain Python, on the driver's documents and on odd
rows (NULLs, empty and very long texts, ties, repeated rows, name clashes)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import content_sort, line_quality, mixing, near_dedup, packing, pii, secret_scan, sharding, url_rules
from tidemark.llm.common import table
from tidemark.llm.token_files import Shard, read_token_files, write_token_files
from tidemark.llm.tokens import encoder, vocabulary

MID = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, MID, "documents")


@pytest.fixture(scope="module", params=["driver", "odd"])
def both(request, docs, odd):
    return docs if request.param == "driver" else odd


def test_empty_tables_give_empty_results(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string")
    for out in (content_sort.copies(empty), line_quality.judge(empty), near_dedup.near_groups(empty),
                mixing.mix(empty), secret_scan.scan(empty), pii.personal_data(empty), packing.pack(packing.cut(empty)),
                read_token_files(write_token_files(empty)), url_rules.judge(pages)):
        assert out.count() == 0
    assert sharding.shuffle(empty, shard="of").count() == 0


# --- 9: content sort ---

def test_content_sort(both):
    held = defaultdict(list)
    for r in rows(both):
        held[lower(r["text"] or "")].append(r["doc_id"])
    out = rows(content_sort.copies(both))
    assert len(out) == sum(map(len, held.values()))
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in held.items()}
    kept = Counter()
    for r in out:
        ids = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (max(ids), len(ids)) and r["doc_id"] in ids
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) <= {1}
    left = content_sort.dedup(both)
    assert left.columns == both.columns and left.count() == len(held)


def test_content_sort_splits_a_hot_text(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same\ntext")).otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    out = content_sort.copies(hot)
    group = out.where("group_size > 1")
    assert group.count() == 1334 and group.where("kept").collect()[0]["doc_id"] == 3999
    assert group.where("keep_id = 3999 and group_size = 1334").count() == 1334


# --- 2: token files; 10: packing ---

def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_encoder_equals_library():
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["a\x0bb\x0cc d\te\r\nf", "it's 'stop O'Neil's don't!!x", "<|endoftext|> <|ENDOFTEXT|> <a|b>", "", None,
             "Ünïcode…. straße ΣΑΣ. İx! Ǆ é! a\xa0b c \x1cq", "日本語、テスト。 한국어!", "ﬁne K Ω ı. i̇. e.́x"]
    texts += ["".join(rng.choice("ab'. sL,é…́İ<|>9\x1c\x85 Σ-!") for _ in range(40)) for _ in range(500)]
    ids, ends = encoder(vocabulary(), 1).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library_ids(texts)


def test_token_files_round_trip(both):
    held = rows(both)
    want = sorted((r["doc_id"], ids) for r, ids in zip(held, library_ids([r["text"] for r in held])))
    shards = write_token_files(both)
    out = sorted(rows(read_token_files(shards)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [i for i, _ in want]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(
        (i, len(t), zlib.crc32(np.array(t, "<u4"))) for i, t in want)
    starts = np.cumsum([0] + [r["n_tokens"] for r in out])
    assert [r["start"] for r in out] == starts[:-1].tolist()
    first = shards.orderBy("base").first()
    held = Shard(first["folder"], first["name"], first["dtype"])
    assert len(held) == first["n_docs"] and held[0].tolist() in [t for i, t in want if i == want[0][0]]


def test_packing(both):
    pieces = packing.cut(both)
    out = rows(packing.pack(pieces))
    want = Counter()
    source = rows(both)
    for r, ids in zip(source, library_ids([r["text"] for r in source])):
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[r["doc_id"], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4"))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        assert np.frombuffer(r["ids"], "<u2").size == r["length"]
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    floor = -(-sum(r["length"] for r in out) // 4096)
    assert len(held) <= math.ceil(1.01 * floor) + 1


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(3)
    length = rng.integers(1, 4096, 300).tolist()
    a = packing.best_fit([], list(range(300)), length, 4096)
    b = packing.best_fit([], list(range(299, -1, -1)), length, 4096)
    for child in (packing.crossover(a, b, length, 4096, rng), packing.mutate(a, length, 4096, rng),
                  packing.evolve(length, [a, b], 4096, 1)[0]):
        assert sorted(p for _, held in child for p in held) == list(range(300))
        assert all(fill == sum(length[p] for p in held) <= 4096 for fill, held in child)
    assert len(packing.evolve(length, [a, b], 4096, 1)[0]) <= min(len(a), len(b))


# --- 5: near duplicates ---

def shingle_set(t):
    w = [x for x in SPACE.findall(lower(t or ""))]
    n = min(3, len(w))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    above = {i: i for i in sets}

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((max(a, b), min(a, b)) for ids in holders.values() for n, a in enumerate(ids) for b in ids[:n])
    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            above[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


def test_near_groups(both):
    sets, component = brute_components({(r["doc_id"], r["text"]) for r in rows(both)})
    for r in rows(near_dedup.near_groups(both)):
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), component[i], component[i] == i)


def test_family_with_few_links_among_many_near_misses(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((i * 3 + 1, " ".join(w)))
    _, component = brute_components(texts)
    assert 1 < len(set(component.values())) < 250
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in rows(got)} == component
    assert near_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).count() == len(set(component.values()))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(40)]
    b = [np.concatenate([x[:460], rng.integers(0, 2**63, 40, dtype=np.uint64)]) for x in a]
    agree = (near_dedup.superminhash(a) == near_dedup.superminhash(b)).mean()
    assert abs(agree - 460 / 540) < 0.02


# --- 8: sharding ---

def test_uniform_shards(both):
    narrow = both.select("doc_id", "text")
    out = rows(sharding.shuffle(narrow))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in rows(narrow))
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(16)) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))


def test_communication_matrix_has_exact_margins():
    ends = np.array([0, 5, 5 + 90, 5 + 90 + 33, 5 + 90 + 33 + 400])
    totals = sharding.shard_sizes(int(ends[-1]), 16)
    m = np.array([sharding.matrix_row(p, ends, totals, 9) for p in range(4)])
    assert (m.sum(axis=0) == totals).all() and (m.sum(axis=1) == np.diff(ends)).all() and (m >= 0).all()
    mean = np.mean([sharding.matrix_row(1, ends, totals, s) for s in range(400)], axis=0)
    assert np.allclose(mean, 90 / 16, atol=0.5)


# --- 1: personal data; 3: secrets ---

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) \
                    or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) \
                    or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end(), True))
    return sorted(out)


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e, *_ in spans).encode()).hexdigest()


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.0123 -+(é1") for _ in range(40))
        assert pii.base_spans(t) == brute_pii(t), t


def test_personal_data(both):
    want = Counter((r["doc_id"], digest(brute_pii(r["text"] or ""), pii.KINDS)) for r in rows(both))
    out = rows(pii.personal_data(both))
    assert Counter((r["doc_id"], r["base_sha256"]) for r in out) == want
    text = {r["doc_id"]: r["text"] or "" for r in rows(both)}
    for r in out:
        base = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in brute_pii(text[r["doc_id"]])}
        assert base <= set(filter(None, r["spans"].split(",")))


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    good = [np.where(rng.random(4000) < acc, truth, ~truth) * 2 - 1 for acc in (0.9, 0.9, 0.85, 0.85, 0.5)]
    votes, counts = np.unique(np.stack(good, 1), axis=0, return_counts=True)
    likely, tables = pii.reliabilities(np.zeros(len(votes), int), votes, counts)
    right = tables[0][:, 1, 2] - tables[0][:, 0, 2]
    assert right[:4].min() > 0.5 and abs(right[4]) < 0.15
    assert (likely[votes[:, :4].sum(axis=1) == 4] > 0.95).all()


SECRET = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
          ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def brute_secrets(t):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(SECRET) for m in p.finditer(t) if ok(m))


def entropy(w):
    return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())


def test_secrets(both):
    kinds = [k for k, _, _ in SECRET]
    out = rows(secret_scan.scan(both))
    text = {r["doc_id"]: r["text"] or "" for r in rows(both)}
    assert len(out) == both.count()
    for r in out:
        spans = brute_secrets(text[r["doc_id"]])
        assert r["base_sha256"] == digest(spans, kinds)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in spans) for i in range(3)]


def test_secrets_of_random_strings(spark):
    rng = random.Random(2)
    parts = ["password", "Token", "SECRET", " ", "=", ":", '"', "'", "é", "😀", "abcdef0123456789", "AKIA", "AKIA7ZQ2", "x", "/",
             "0f", "api_key", "apikey", "\n", "zQ9", "_", "-"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(25))) for i in range(1000)]
    kinds = [k for k, _, _ in SECRET]
    for r, (_, t) in zip(sorted(rows(secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"))),
                                key=lambda r: r["doc_id"]), texts):
        assert r["base_sha256"] == digest(brute_secrets(t), kinds)


def test_incremental_entropy(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("abcdef0123456789") for _ in range(n)) for n in (1, 5, 19, 20, 21, 40, 300)] + ["a" * 50]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.highest_entropy(F.col("v")).alias("h"))
    for v, h in got.collect():
        assert abs(h - max(entropy(v[i:i + 20]) for i in range(max(1, len(v) - 19)))) < 1e-9


def test_entropy_span_and_allow_list(spark):
    found = "k9Xz3QpLm7Rt2Vb8Ws4Y"
    texts = [(1, f"a {found} b"), (2, "550e8400-e29b-41d4-a716-446655440000"), (3, "my-example-of-a-Key-1234567890"), (4, "path/to/Some1/long2/file3.txt")]
    out = {r["doc_id"]: r for r in rows(secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert out[1]["spans"] == f"entropy:2:{2 + len(found)}"
    assert [out[k]["spans"] for k in (2, 3, 4)] == ["", "", ""]


def test_slashes_and_fillers_do_not_hide_keys(spark):
    rng = random.Random(12)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda n, of=base64: "".join(rng.choice(of) for _ in range(n))
    keys = []
    while len(keys) < 300:
        k = draw((40, 88)[len(keys) % 2])
        if k.count("/") >= 2 or k.startswith("/"):
            keys.append(("aws_secret_access_key=", "key ")[len(keys) % 3 == 0] + k)
    keys += [f"https://hooks.example.org.com/services/T00/B00/{draw(24, base64[:62])}" for _ in range(50)]
    keys += [draw(42, base64[:62]) + filler + draw(42, base64[:62]) for filler in ("xxxx", "dummy", "Sample", "deadbeef")]
    # no secrets
    plain = ["/usr/lib/python3/dist-packages/numpy/core2", "path/to/Some1/long2/file3", "https://x.org/docs/2024/06/12/releaseNotes/version2/index",
             "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", base64, "my-sample-key-1234567890-abcdefgh", "xxxxxxxxxxxxxxxxxxxxxxxx1234"]
    texts = list(enumerate(keys + plain))
    got = {r["doc_id"]: r["n_entropy"] for r in rows(secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert [t for i, t in texts[:len(keys)] if not got[i]] == []
    assert [t for i, t in texts[len(keys):] if got[i]] == []


# --- 4: mixing ---

def test_mix(both):
    held = defaultdict(int)
    for r in rows(both):
        held[r["source"]] += len(SPACE.findall(r["text"] or ""))
    names = sorted((s for s in held if s is not None)) + ([None] if None in held else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # share out, hold what is full, share the rest again
        left = sum(held.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * held[s]}
        target |= {s: 3 * held[s] if full else share[s] for s in (full or open_)}
        open_ -= full or open_
    out = rows(mixing.mix(both))
    assert len(out) == both.count()
    taken, largest = Counter(), Counter()
    for r in out:
        s = r["source"]
        assert r["source_size"] == held[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= min(largest[s], 0.06 * target[s] + 20), s
    again = rows(mixing.mix(both.repartition(5)))
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in out)
    copies = Counter()
    for r in out:
        copies[r["doc_id"]] += r["copies"]
    mix = mixing.mixed(both)
    assert mix.columns == both.columns
    assert Counter(r["doc_id"] for r in mix.select("doc_id").collect()) == +copies


def test_mix_goes_on_after_a_long_document_at_the_edge(spark):
    # source a misses a third of its words; its long document's u of about 0.33 lies at the edge
    def u(i):
        return int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48

    long_id = min(range(10**6, 10**6 + 3000), key=lambda i: abs(u(i) - 0.36))
    texts = [(i, 20, "a") for i in range(3000)] + [(long_id, 50_000, "a")] + [(10**7 + i, 55, "b") for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, n int, source string").select(
        "doc_id", "source", F.expr("repeat('w ', n)").alias("text")).repartition(4)
    out = rows(mixing.mix(docs, weights=(1, 3)))
    assert len(out) == len(texts)
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 55, s
    assert sum(r["copies"] for r in out if r["doc_id"] == long_id) == 0


# --- 6: lines ---

def test_line_quality(both):
    def keys(r):
        return [((r["source"], " ".join(SPACE.findall(re.sub("[0-9]", "0", lower(x))))), len(SPACE.findall(x)))
                for x in (r["text"] or "").split("\n") if SPACE.search(x)]

    text = {r["doc_id"]: r for r in rows(both)}
    for r in rows(line_quality.judge(both)):
        t = text[r["doc_id"]]["text"] or ""
        w = SPACE.findall(t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i:i + 8])].append(i)
        repeat = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeat) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"]) and r["n_removed_words"] <= sum(n for _, n in keys(text[r["doc_id"]]))
    left = line_quality.clean(both)
    assert left.columns == both.columns


def test_boilerplate_is_removed_copies_are_not(spark):
    words = [f"word{k}" for k in range(400)]
    rng = random.Random(6)
    own = lambda n: " ".join(rng.choice(words).replace(str(0), "o") + rng.choice("abcdefgh") for _ in range(n))
    notice = "this notice stands below every page of the site and says nothing that anyone would ever want to read again"
    copy = own(30) + "\n" + own(30) + "\n" + own(30)
    texts = [(i, own(40) + "\n" + notice, "h") for i in range(60)] + [(100 + i, copy, "h") for i in range(80)]
    texts += [(200, notice.upper() + "\n" + notice, "h"), (201, notice + " ", "other")]
    out = {r["doc_id"]: r for r in rows(line_quality.judge(spark.createDataFrame(texts, "doc_id long, text string, source string")))}
    assert all(out[i]["kept"] for i in (*range(60), *range(100, 180), 201))
    assert not out[200]["kept"] and out[200]["n_removed_words"] == 40 and out[0]["n_removed_words"] == 20


def test_lines_that_occur_together_are_each_counted(spark):
    rng = random.Random(8)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n))
    template = [letters(4) for _ in range(20)]
    texts = [(i, "\n".join([*template[:10], letters(4), *template[10:]]), "h") for i in range(300)]
    texts += [(1000 + i, letters(30) + "\n" + template[0], "h") for i in range(5)]
    copy = "\n".join(letters(12) for _ in range(4))
    texts += [(2000 + i, (copy + "\n\n", copy.upper())[i % 2], "h") for i in range(90)]  # true copies count once
    texts += [(3000 + i, "\n".join([copy.split("\n")[0], letters(30)]), "h") for i in range(49)]  # with the copy: 50 documents
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(4)
    out = {r["doc_id"]: r for r in rows(line_quality.judge(docs))}
    assert all((out[i]["n_removed_words"], out[i]["kept"]) == (80, False) for i in range(300))
    assert all((out[1000 + i]["n_removed_words"], out[1000 + i]["kept"]) == (4, True) for i in range(5))
    assert all((out[i]["n_removed_words"], out[i]["kept"]) == (0, True) for i in (*range(2000, 2090), *range(3000, 3049)))


# --- 7: URLs ---

def test_url_rules(spark):
    urls = [None, "", "no scheme", "https://x.org/a", "HTTPS://WWW.Example.ORG/es/1?q", "http://example.org/en/12#t", "http://a.com/fr/",
            "http://a.com/de", "http://a.com/de/#x", "http://notexample.org", "https://a.b.net/ads/x", "https://trusted.example.net/ads/x",
            "http://www.SPAM-farm.net/x", "http://nospam-farm.net/", "x://h/tracker/a/b.gif", "x://h/tracker/b.gif?c", "x://h/?popup=1",
            "x://h/phishing", "x://h/phishingly", "x://h?a/b"]
    want = [("", "", None, "allow")] * 3 + [("x.org", "/a", "org/", "allow"), ("www.example.org", "/es/1", "example.org/es/", "block"),
            ("example.org", "/en/12", "example.org/en/1", "block"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "/de", None, "allow"),
            ("a.com", "/de/", "com/de/", "block"), ("notexample.org", "", None, "allow"), ("a.b.net", "/ads/x", None, "block"),
            ("trusted.example.net", "/ads/x", None, "allow"), ("www.spam-farm.net", "/x", None, "block"), ("nospam-farm.net", "/", None, "allow"),
            ("h", "/tracker/a/b.gif", None, "block"), ("h", "/tracker/b.gif", None, "allow"), ("h", "/", None, "block"), ("h", "/phishing", None, "block"),
            ("h", "/phishingly", None, "allow"), ("h", "", None, "allow")]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").withColumn("host", F.lit(1))
    out = sorted(rows(url_rules.judge(pages)), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [*want[:4], *want[3:]]


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = spark.createDataFrame([("||spam-farm.", "block"), ("a*b^", "block"), ("|http://x/y.gif|", "allow")], "pattern string, verdict string")
    got = {r["pattern"]: r["tokens"] for r in url_rules.compile_patterns(rules).collect()}
    assert got == {"||spam-farm.": ["spam", "farm"], "a*b^": [], "|http://x/y.gif|": ["http", "x", "y", "gif"]}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(559, 400), (7, 7)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)]
    links += links[:40] + [(b, a) for a, b in links[:40]]  # repeated and turned round
    above = {}

    def find(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            above[max(x, y)] = min(x, y)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(above))
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("side", [3, 128])
def test_chains_through_blocks_of_one_component(spark, monkeypatch, side):
    """Long chains of edits: a centre links few of them, and the blocks of large components and of the rest meet."""
    monkeypatch.setattr(near_dedup, "SIDE", side)
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    rng = random.Random(8)
    texts = []
    for f in range(3):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for k in range(36):
            texts.append((100 * f + rng.randrange(10**6) * 1000 + k, " ".join(words)))
            for at in rng.sample(range(200), 2 if k % 9 else 30):  # at times too many: the chain ends
                words[at] = f"x{f}_{k}_{at}"
    _, component = brute_components(texts)
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: component[i] for i, _ in texts}
    assert 6 < len(set(component.values())) < 60
