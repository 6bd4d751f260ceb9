"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontam, embed_dup, ftrl, graph, lang_id, near_dup, secret_scan, sharding, token_store, toxicity, warc_zip
from lexmill.llm.common import ascii_words
from lexmill.session import Workspace

LONG = "one two three four five six seven eight nine ten eleven twelve " * 3000
TEXTS = ["", None, "a", "Hello, World!  It's 42 naïve ¹²³ 中文 \U0001f600\n\n tabs\t", LONG, "Hello", "Hello", "x" * 20000, " \n ", "The quick brown fox jumps over the lazy dog again and again."]
#: Names that operators use inside.
CLASH = ("rid", "id", "n", "t", "k1", "key", "size", "shard", "r", "o", "comp", "rep", "sig", "bands", "v", "f", "part", "at", "u", "c", "h", "x", "start")


def docs(spark, texts=None, extra=True):
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(TEXTS if texts is None else texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for c in CLASH if extra else ():
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def empty(spark):
    return docs(spark, [])


# 1


def test_bpe_equals_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.roundtrip(docs(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id", "id"], outputs=tuple(bpe.OUTPUTS)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        t = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and bytes(r.decoded) == t.encode() and r.id == "own id"
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.roundtrip(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"]).count() == 0


def test_rank_queue_on_random_bytes():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc, mine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 100, 1000):
        for alphabet in ("ab", "aeiou the'", "é中\n 1!s'"):
            s = "".join(rng.choice(list(alphabet), n))
            assert mine.encode_all([s]) == [enc.encode_ordinary(s)]


# 2


def test_shards(spark):
    texts = [None, "", "same", "same", "same", *[f"text {i} " * (i % 17) for i in range(300)], LONG]
    got = sharding.shard(docs(spark, texts), keep=["doc_id", "shard", "size"]).collect()
    assert len(got) == len(texts)
    size, group = Counter(), {}
    for r in got:
        t = texts[r.doc_id]
        assert r["__size"] == len((t or "").encode()) + 1 and r["__crc32"] == zlib.crc32((t or "").encode()) and r["shard"] == "own shard"
        size[r["__shard"]] += r["__size"]
        group.setdefault(t, set()).add(r["__shard"])
    assert all(len(s) == 1 for s in group.values()) and set(size) <= set(range(16))
    for k in size:
        assert sorted(r["__slot"] for r in got if r["__shard"] == k) == list(range(sum(r["__shard"] == k for r in got)))
    assert sharding.shard(empty(spark)).count() == 0


def brute_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, n, held = (low + high) // 2, 1, 0
        for s in sizes:
            n, held = (n + 1, s) if held + s > mid else (n, held + s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 40, 2000])
def test_minimax_capacity(spark, n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, n)).tolist()
    sizes = (rng.pareto(1, len(keys)) * 50 + 1).astype(int).tolist()
    df = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key bigint, size bigint")
    capacity, starts = sharding.boundaries(df, 16)
    assert capacity == brute_capacity(sizes, 16)
    cuts = [k for k in starts if k is not None]
    held = Counter()
    for k, s in zip(keys, sizes, strict=True):
        held[sum(k >= c for c in cuts)] += s
    assert max(held.values()) <= capacity


# 3


def test_secrets(spark):
    aws, hexed, loose = "AKIA" + "ABCD1234EFGH5678", "0123456789abcdef" * 2, "aB3dE6gH9jK2mN5pQ8sT1vW4xY7z"
    texts = [f'api_key = "{loose}" and {aws}', f"PassWord: hunter22 {hexed}", f"see {hexed} {hexed}", f"{hexed}", None, "", "token=abc", f"it is {loose} here", LONG]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.verdict) for s in r["__spans"]] for r in secret_scan.scan(docs(spark, texts), keep=["doc_id", "o"]).collect()}
    assert len(got) == len(texts)
    assert [s[:3] for s in got[0]] == [("assign", 0, texts[0].index('" and')), ("access", texts[0].index("AKIA"), len(texts[0]))]
    assert [s[0] for s in got[1]] == ["assign", "hex"] and got[2][0][0] == "hex" and len(got[2]) == 2
    assert got[4] == got[5] == got[6] == got[8] == []
    assert {s[3] for s in got[3]} == {"example"}  # the hex value has three owners
    assert secret_scan.scan(empty(spark)).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, texts).withColumn("n_chars", F.length("text"))).collect()}
    assert clean[3] == hexed and aws not in clean[0] and loose not in clean[0] and clean[4] is None and clean[6] == "token=abc" and "hunter22" not in clean[1]
    base = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)]
    for t in [x for x in texts if x]:
        want = [(m.start(), i, m.end()) for i, (_, p, least) in enumerate(base) for m in re.finditer(p, t) if len(m[2] if i == 0 else m[0]) >= least]
        assert sorted(want) == [(a, k, b) for k, a, b, _ in secret_scan.find(t) if k < 3]


# 4


def test_token_store(spark):
    ws = Workspace(spark, "test-store")
    store = token_store.write(docs(spark), ws.path, P.path("byte_bpe_50k.json"), P.PATTERN)
    got = {r.id: r for r in token_store.read_back(store).collect()}
    enc = token_store.Encoder(P.path("byte_bpe_50k.json"), None)
    at = 0
    back = {r.id: r.ids for r in token_store.reconstruct(store, docs(spark).select(F.col("doc_id").alias("id"))).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*enc.encode_all([t])[0].tolist(), 2]
        assert (got[i].start, got[i].n, got[i].crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and list(back[i]) == ids
        at += len(ids)
    assert store.chunks.count() == store.chunks.select("d").distinct().count()
    bad = store.chunks.withColumn("data", F.lit(token_store.pack(np.array([1, 2, 3], np.uint32))))
    bad.write.parquet(ws.at("bad/chunks"))
    store.recipes.write.parquet(ws.at("bad/recipes"))
    store.manifest.write.parquet(ws.at("bad/manifest"))
    with pytest.raises(Exception, match="digest"):
        token_store.read_back(token_store.Store(spark, ws.at("bad"))).collect()
    none = token_store.write(empty(spark), Workspace(spark, "test-store").path, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_store.read_back(none).count() == 0


@pytest.mark.parametrize("pattern", [P.PATTERN, None])
def test_added_tokens_are_encoded_as_such(pattern):
    got = token_store.Encoder(P.path("byte_bpe_50k.json"), pattern).encode_all(["a<|endoftext|>b", None, "a b", "<|endoftext|>"])
    assert [x.tolist() for x in got] == [[64, 50256, 65], [], [64, 275], [50256]]


def test_crc_joined_and_cuts():
    a, b = b"hello", b"other bytes" * 99
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    ids = np.random.default_rng(1).integers(0, 50000, 30000).astype(np.uint32)
    ends = token_store.cuts(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.MAX_CHUNK
    later = token_store.cuts(np.concatenate([ids[:777], ids]))
    assert len({e + 777 for e in ends} & set(later)) > len(ends) / 2  # an insertion moves few cuts
    assert token_store.merkle([]) != token_store.merkle([b"a"])


# 5


def brute_windows(texts, items, window):
    wins = {}
    for k, t in items:
        w = ascii_words(t)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[i : i + window]), set()).add(k)
    out = []
    for t in texts:
        w, hit, ids = ascii_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (k := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= k
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("block", [10**6, 15])
def test_decontamination(spark, block):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    items = [("7", item), ("10", "Tiny item"), ("3", None), ("4", " .. "), ("8", "beta gamma delta epsilon zeta eta theta iota kappa lambda other end"), ("7", item)]
    clean = "Nothing of that kind stands in this text, beta gamma delta."
    texts = [None, "", clean, f"Before it: {item.upper()}! after all of this, some more words follow here so that most of the document is not a test item at all.", item, "a tiny item, tiny ITEM.", "öl " + item[6:] + " ça", LONG, clean]
    table = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(decontam.scan(docs(spark, texts), table, keep=["doc_id", "n"], max_block_words=block).collect())
    want = brute_windows(texts, [(k, t) for k, t in items if t], 10)
    assert [(r["__n_words"], sum(h.b - h.a for h in r["__hits"]), list(r["__items"])) for r in got] == want
    kept = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts).withColumn("n_chars", F.length("text")), table, n_chars="n_chars", max_block_words=block).collect()}
    assert set(kept) == {0, 1, 2, 3, 7, 8} and kept[2].text == clean and "KAPPA" not in kept[3].text and kept[3].text.startswith("Before it: !") and kept[3].n_chars == len(kept[3].text)
    assert decontam.scan(empty(spark), table).count() == 0
    assert decontam.scan(docs(spark), spark.createDataFrame([], "item_id string, text string")).where("size(__hits) > 0").count() == 0


# 6


def brute_groups(texts):
    tab = {i: i + 32 for i in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(tab))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [None, "", "  ", "one two", "ONE two", "one two", LONG]
    base = rng.choice(words, 200).tolist()
    for k in range(60):  # a group of near copies, some of which only hang together over others
        w = list(base)
        for at in rng.choice(200, k % 9, replace=False):
            w[at] = f"new{k}"
        texts.append(" ".join(w))
    passage = rng.choice(words, 60).tolist()
    texts += [" ".join([*passage, *rng.choice(words, 40)]) for _ in range(40)]  # a shared passage is no copy
    texts += [" ".join(rng.choice(words, n)) for n in rng.integers(1, 300, 60)]
    n, comp = brute_groups(texts)
    got = sorted(near_dup.groups(docs(spark, texts), keep=["doc_id", "k1", "sig"]).collect())
    assert [r["__n_shingles"] for r in got] == n and [r["__component"] for r in got] == comp
    assert [r["__kept"] for r in got] == [c == i for i, c in enumerate(comp)]
    assert near_dup.groups(empty(spark)).count() == 0
    twice = docs(spark, ["some words that come twice here"] * 2).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert sorted((r["__component"], r["__kept"]) for r in near_dup.groups(twice).collect()) == [(None, False), (None, True)]


def test_posterior_bounds():
    assert all(m <= n * 0.75 for n, m in near_dup.least_matches(240, 32, 0.75, 1e-6))
    assert 40 < near_dup.most_differing(240, 0.75, 1e-6) < 80


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5), (7, 3)]
    ws = Workspace(spark, "test-graph")
    got = dict(graph.components(ws.write(spark.createDataFrame(edges, "a bigint, b bigint"), "edges"), ws, "c").collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3, 5: 5}


# 7 and 10


def language(rng, lang, n):
    parts = {"en": ["the", "ing", "th", "and"], "de": ["der", "sch", "ung", "ein"], "fr": ["eau", "oix", "ent", "les"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def test_language(spark):
    rng = np.random.default_rng(2)
    rows = [(i, language(rng, ("en", "de", "fr")[i % 3], int(rng.integers(5, 80))), ("en", "de", "fr")[i % 3]) for i in range(300)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", None), (903, "the and thing", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("t", F.lit(1)).withColumn("__score", F.lit("x"))
    model = lang_id.train(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in lang_id.predict(df, model, keep=["doc_id", "t", "__score"]).collect()}
    held = [r for r in rows[:300] if r[0] % 4 == 2]
    assert sum(got[i]["__lang_pred"] == k for i, _, k in held) >= 0.98 * len(held)
    assert all(got[i]["__lang_pred"] == "und" and got[i]["__score"] == 0 for i in (900, 901, 902)) and got[903]["__lang_pred"] == "en"
    assert all(0 <= r["__score"] <= 1 for r in got.values())
    none = lang_id.train(df, F.lit(False))
    assert {r["__lang_pred"] for r in lang_id.predict(df, none).collect()} == {"und"}
    assert lang_id.predict(df.limit(0), model).count() == 0


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(lang_id.MAX_LANGS + 1)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        lang_id.train(df, F.lit(True))


def test_temperature():
    logits = np.array([[8.0, 0.0]] * 100)
    labels = np.array([0] * 70 + [1] * 30)
    p = ftrl.softmax(logits / ftrl.temperature(logits, labels))[0, 0]
    assert abs(p - 0.7) < 0.05


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 7 == 0
        words = language(rng, "en", int(rng.integers(20, 60))).split()
        if bad:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["dolt", "nitwit"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 > 0), int(bad)))
    rows += [(900, None), (901, ""), (902, "the thing " * 5000 + "dolt"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__rejected", F.lit(7))
    lab = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(df, lab, ["quality", "toxic"])
    got = toxicity.predict(df, chain).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r["__rejected"] for r in got}
    assert sum(by[i] == bool(y) for i, _, y in labels if i % 2) >= 0.97 * 200 and by[902] and not by[900] and not by[901]
    assert len(chain.models) == 2 and len(chain.models[1][2]) == 1
    none = toxicity.train(df, lab.limit(0), ["quality", "toxic"])
    assert not any(r["__rejected"] for r in toxicity.predict(df, none).collect())
    assert toxicity.predict(df.limit(0), chain).count() == 0


# 8


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    x[50:120] = x[0] + rng.standard_normal((70, 16)) * 0.25 * np.linalg.norm(x[0]) / 4
    x[120:140] = x[1]
    vectors = [v.astype(np.float32).tolist() for v in x]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors + odd)], "vec_id bigint, embedding array<float>")
    for c in ("rep", "v", "f", "u", "c", "id"):
        df = df.withColumn(c, F.lit("own"))
    unit = np.array(vectors, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    m = unit @ unit.T >= 0.9
    got = sorted(embed_dup.groups(df, keep=["vec_id", "rep"]).collect())
    links = m.sum(1) - 1
    mine = np.array([r["__n_links"] for r in got])
    assert (mine[:400] <= links).all() and mine[:400].sum() >= 0.99 * links.sum() and not mine[400:].any()
    assert [r["__component"] for r in got[400:]] == list(range(400, 407)) and all(r["__kept"] for r in got[400:])
    assert {r["__component"] for r in got[120:140]} == {1} and got[1]["__n_links"] >= 20
    assert embed_dup.groups(df.limit(0)).count() == 0


def isolated_pairs(n, cosine, dim=64):
    """n unit vectors, and one more for each at that cosine."""
    x, z = np.random.default_rng(12).standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [500, 10_256, 51_282, 1_000_000, 1_000_000_000])
@pytest.mark.parametrize("dim", [1, 2, 4, 8, 16, 64, 768])
def test_embedding_pairs_meet_at_any_size(n, dim):
    by = embed_dup.plan(n, 0.9, dim)
    x, y = isolated_pairs(300, 0.9, dim) if dim > 1 else (np.ones((9, 1)), np.ones((9, 1)))
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(embed_dup.filters(x, by), embed_dup.filters(y, by), strict=True)]
    assert np.mean(met) >= 0.99 and by.codes > 0 and by.blocks >= (2 if dim >= 8 else 1)
    if dim >= 16 and n <= 1_000_000:
        assert n * embed_dup.share_of(dim, by.bound) < 600  # few vectors a filter


@pytest.mark.parametrize("lo_hi", [True, False])
def test_pairs_count_in_their_first_filter(lo_hi):
    rng = np.random.default_rng(8)
    before = [np.sort(rng.choice(40, rng.integers(0, 6), replace=False)).astype(np.uint16) for _ in range(60)]
    p, q = (np.arange(60), np.arange(60)) if lo_hi else (np.arange(25), np.arange(25, 60))
    for share in (0.02, 0.9):  # few pairs, and many
        near = rng.random((len(p), len(q))) < share
        if lo_hi:
            near = np.triu(near, 1)
        want = np.array([[near[i, j] and set(before[a]).isdisjoint(before[b]) for j, b in enumerate(q)] for i, a in enumerate(p)])
        embed_dup.first_only(near, before, p, q)
        assert (near == want).all()
        top = embed_dup.roots(60, p, q, near)
        full = np.eye(60, dtype=bool)
        full[np.ix_(p, q)] |= near
        full |= full.T
        for _ in range(6):
            full = full @ full
        assert (top == full.argmax(axis=1)).all()


@pytest.mark.parametrize("n,dim", [(2, 64), (40, 64), (900, 16), (4000, 64)])
def test_embedding_groups_equal_brute_force(spark, n, dim):
    """Dense clusters, chains and pairs just above and below the least cosine, at sizes small and large, all through filters."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim))
    for k in range(max(1, n // 100)):
        at = rng.choice(n, min(n, 12), replace=False)
        x[at] = x[at[0]] + rng.standard_normal((len(at), dim)) * (0.2 + 0.3 * (k % 3) / 2) * np.linalg.norm(x[at[0]]) / np.sqrt(dim)
    for k in range(0, n // 4, 2):
        a, b = isolated_pairs(1, 0.9 + 1e-4 * (-1) ** (k // 2), dim)
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        x[n // 2 + k], x[n // 2 + k + 1] = a[0] @ turn, b[0] @ turn
    x = x.astype(np.float32)
    u = embed_dup.unit(x)
    near = u @ u.T >= 0.9
    comp = np.arange(n)
    while True:
        new = np.array([comp[r].min() for r in near])
        if (new == comp).all():
            break
        comp = new
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embed_dup.groups(df, keep=["vec_id"]).collect()}
    assert near.sum() > n or n == 2
    assert [got[i]["__n_links"] for i in range(n)] == (near.sum(axis=1) - 1).tolist() and [got[i]["__component"] for i in range(n)] == comp.tolist()


def test_long_runs_of_one_word_take_linear_time():
    import time

    n, began = 100_000, time.time()
    made = decontam.SuffixAutomaton([("x", [b"w"] * n), ("s", [b"w"] * 3), ("y", [b"w", b"v"] * (n // 2))], 10)
    assert made.matches([b"w"] * n) == ([(0, n)], {0, 1}, n)
    assert made.matches([b"v", b"w"] * (n // 2))[1] == {2} and made.matches([b"w"] * 4)[:2] == ([(0, 4)], {1})
    assert time.time() - began < 10


def test_reconstruction_fails_on_lost_or_altered_chunks(spark):
    import glob
    import os

    ws = Workspace(spark, "test-lost")
    texts = [" ".join(f"w{i * k}" for i in range(900)) for k in range(1, 9)] + ["", None]
    store = token_store.write(docs(spark, texts), ws.path, P.path("byte_bpe_50k.json"), P.PATTERN)
    every = spark.range(12).withColumnRenamed("id", "id")
    got = {r.id: r.ids for r in token_store.reconstruct(store, every).collect()}
    assert len(got) == 10 and all(len(v) > 100 for k, v in got.items() if k < 8)
    assert [r["first"] for r in store.manifest.orderBy("part").collect()][0] == 0
    root = ws.path.removeprefix("file://")
    lost = max(glob.glob(f"{root}/chunks/*.parquet"), key=os.path.getsize)
    os.remove(lost)
    with pytest.raises(Exception, match="is missing"):
        token_store.reconstruct(store, every).collect()


def test_isolated_embedding_pairs_are_linked(spark):
    x, y = isolated_pairs(8000, 0.901)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(16000), "embedding": np.vstack([x, y]).astype(np.float32).tolist()}), "vec_id bigint, embedding array<float>")
    got = embed_dup.groups(df, keep=["vec_id"]).groupBy("__n_links").count().collect()
    assert {r["__n_links"]: r["count"] for r in got}.get(0, 0) <= 16


def test_embeddings_of_mixed_lengths(spark):
    vectors = [[1.0, 0.0, 0.0]] * 3 + [[1.0, 2.0], [1.0, 2.1], [-1.0, 2.0], [4.0], [5.0], [-1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: (r["__n_links"], r["__component"]) for r in embed_dup.groups(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_list_decoding_is_complete(blocks):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    by = embed_dup.Plan(1.5 / 8, blocks, 8, 2)
    for number in range(2):
        parts = embed_dup.code(64, blocks, 8, number)
        every = np.zeros((64, 1))
        for c in parts:  # all directions, the last block's codeword running fastest
            every = (every[:, :, None] + c[:, None, :]).reshape(64, -1)
        assert np.allclose(np.linalg.norm(every, axis=0), 1, atol=1e-5)
        row, ids = embed_dup.decode(x, by, number)
        want = np.argwhere(x.astype(np.float32) @ every >= 1.5 / 8)
        assert set(map(tuple, want.tolist())) == set(zip(row.tolist(), ids.tolist(), strict=True))


# 9


@pytest.mark.parametrize("least", [0, 4])
def test_warc(spark, least):
    html = ["<p>a</p>", None, "", "<p>a</p>", "abc", "abc", LONG, "<p>ä\r\n\r\nb</p>", "<p>a</p>"]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\n", h) for i, h in enumerate(html)], "page_id bigint, url string, html string").withColumn("rid", F.lit(0)).withColumn("k", F.lit(""))
    listing = warc_zip.write(df, Workspace(spark, "test-warc").path, min_bytes=least)
    got = {r.id: r for r in warc_zip.read(spark, listing, payloads=True).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        b = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        again = last != i and len(b) >= least
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) and r.url == f"http://x/{i}\r\n"
        assert (r.record_type, r.refers_to) == (("revisit", last) if again else ("response", None)) and (again or bytes(r.payload) == b)
    assert warc_zip.read(spark, warc_zip.write(df.limit(0), Workspace(spark, "test-warc").path)).count() == 0


def test_zip64_directory(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as m:
            m.write(b"content")
        for i in range(70000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
        z.comment = b"a note"
    with open(path, "rb") as f:
        r = warc_zip.ZipReader(f, path.stat().st_size)
        at, n = r.stored("big")
        assert r.read(at, n) == b"content" and len(r.members) == 70001
