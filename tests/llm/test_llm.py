"""Each operator against a brute-force version on small tables: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from loomspan.llm import anchors, bpe, common, embeddings, graph, induced, langid, mixing, pii, quality, simhash, substring, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, toxicity string, lang_pred string, n_tokens string, block string, src string, h string, _row string"


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "ne", "so") for c in ("", "x", "n", "ling")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, n) for n in (30, 60, 90, 200, 45)]
    passage = words(rng, 55)
    out = [*base, base[0], base[0], base[3], f"{base[1]} {passage} tail end", f"{passage} {base[2]}", "ha " * 300, "", None, "   \n\t ", "%%% ### $$$", "one", "one two", base[4].upper()]
    out += [base[3].replace("kara", "zzz", 1), "line a b c\nline a b c\n\nother\nline a b c", words(rng, 6000), "é😀 " * 40 + passage, "\x1c\x85\xa0 x"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("aa", "bb", None)[i % 3], ("s0", "s1", None, "")[i % 4 if i % 5 else 0], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "aa", "s0", 1), (None, "only here with a null id " * 5, None, None, None), rows[0], rows[3]]
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 9), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 20), (None, 4)]
    out = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(5, 11), 5), 20: 20, 21: 20}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)]
    ends = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(ends)}
    near = {frozenset(map(place.get, e)) for e in edges if e[0] != e[1]}
    want = dict(zip(ends, (ends[r] for r in joined(list(range(len(ends))), lambda a, b: frozenset((a, b)) in near))))
    for small in (graph.SMALL, 0):  # in one task, and by rounds of joins
        got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7), small=small).collect()
        assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


def test_anchors_are_functions_of_the_window():
    rng = np.random.default_rng(1)
    for values in (rng.integers(1, 1 << 62, 400, dtype=np.uint64), np.ones(400, np.uint64), np.tile(rng.integers(1, 99, 7, dtype=np.uint64), 60)):
        places, starts, hashes = anchors.canonical(values, 8, 20)
        h = anchors.gram_hashes(values, 8)
        for s in range(len(values) - 19):
            i = np.searchsorted(starts, s, "right") - 1
            best = max(range(s, s + 13), key=lambda p: (-int(h[p]), p))
            assert places[i] == best and hashes[i] == h[best]


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(keys, near):
    """Least index reachable over pairs that are near."""
    par = list(range(len(keys)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = sorted((find(i), find(j)))
                par[b] = a
    return [find(i) for i in range(len(keys))]


def test_simhash(spark, docs, empty):
    rows = pairs(docs)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = joined(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    want = Counter((i, f, least[r]) for (i, _), f, r in zip(rows, fps, root))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({v for v in least.values() if v is not None})
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_hot_and_cold(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(12)} | {0, (1 << 64) - 1, 1})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    want = Counter(frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2)
    for cell in (48, 2, 1):  # no crowded cell, some, all: the last step decides
        assert Counter(frozenset((r["src"] % (1 << 64), r["dst"] % (1 << 64))) for r in simhash.links(df, cell=cell).collect()) == want
    assert [len(simhash.grids(2, *step)) for step in simhash.STEPS] == [10, 120, 2016]


def test_embedding_of_fingerprints_bounds_distance(spark):
    rng = random.Random(5)
    rows = [(simhash.signed(rng.getrandbits(64)), simhash.signed(rng.getrandbits(64))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"))
    assert all(r["m"] <= r["h"] for r in df.collect())
    assert df.where("m < h").count()


def test_substring(spark, docs, empty):
    rows = pairs(docs)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).digest()))
    seen, want = {}, Counter()
    for k in order:
        w = (rows[k][1] or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first = seen.setdefault(key, (rows[k], s))
            if first != (rows[k], s):  # rows that repeat share the result of the first
                gone[s : s + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[rows[k][0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs).collect())
    assert got == want
    values = substring.dedup(docs, output="values").collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in values)
    assert substring.dedup(empty).count() == 0


def test_suffix(spark, docs, empty):
    rows = pairs(docs)
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    want = Counter()
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    for memory, crowd in ((suffix.MEMORY, suffix.CROWD), (1000, suffix.CROWD), (1000, 2)):  # in memory, through the disk, and with crowded anchors
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs, memory=memory, crowd=crowd).collect())
        assert got == want
    assert suffix.dedup(empty).count() == 0


@pytest.mark.parametrize("memory", [200, 5000, induced.MEMORY])  # queues on disk and recursion to the end, some of both, in memory
def test_induced_sort_orders_suffixes_with_common_prefixes(memory):
    rng = np.random.default_rng(2)
    for k in range(60):
        text = np.append(rng.integers(1, (2, 3, 5, 258)[k % 4] + (k % 4 < 3), rng.integers(1, 300)), 0).astype(np.uint16)
        if k % 7 == 0:
            text = np.append(np.tile(text[:-1], 5), 0).astype(np.uint16)
        length, n = (4, 20, 200)[k % 3], len(text)
        found = list(induced.shared_prefixes(text, 259, length, memory))
        order, common = (np.concatenate(x).tolist() for x in zip(*found))
        assert sorted(order) == list(range(n - 1))
        symbols = text.tolist()
        for a, b, c in zip(order, order[1:], common[1:]):
            same = next((i for i in range(length) if symbols[a + i : a + i + 1] != symbols[b + i : b + i + 1]), length)
            assert min(c, length) == same and symbols[a : a + length] >= symbols[b : b + length]


def test_a_shard_ten_times_the_memory():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, 300_000, dtype=np.uint8).tobytes()
    pieces = [base, base[1000:1400] + b"-" + base[:150], b"\0" * 500, base[5000:5199], b"\xff" * 199]
    found = suffix.repeats(pieces, 200, 50_000)
    assert found[0].tolist() == list(range(1000, 1201)) and found[1].tolist() == list(range(201))
    assert found[2].tolist() == list(range(301)) and not len(found[3]) and not len(found[4])


def test_pii(spark, docs, empty):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(s))) % 10 == 0

    def ok(k, v):
        g = re.sub("[^0-9]", "", v)
        return all(int(x) <= 255 for x in v.split(".")) if k == "ip" else 12 <= len(g) <= 19 and luhn(g) if k == "card" else 9 <= len(g) <= 15 if k == "phone" else True

    texts = ["mail a@b.c_d@e.f or é😀 x.y+z@q-1.co.uk.", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 010.0.0.1", "card 4111 1111 1111 1111 and 4111111111111112, 5500-0000-0000-0004", "+1 (555) 010-2030 +44 20 7946 0958x +1", "call 555-123-4567 or (212) 555 1234", "bob [at] mail [dot] com", None, "", "1" * 5000 + "." * 5000 + "a" * 5000 + "@", "a@b" + ".c" * 3000, "+" + "1 " * 3000]
    texts += ["card 4111 1111 1111 1112"] * 3
    # kinds that begin at the same place, the earlier kind ending later
    texts += ["4111111111111111@mail.example.com", "+4915112345678@mail.example.com", "0000000000000.1.2.3 and 4111111111111111.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.detect(df).select("doc_id", "text", "spans", pii.redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("masked")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = sorted((m.start(), list(base).index(k), k, m.end()) for k, p in base.items() for m in re.finditer(p, t) if ok(k, m[0]))
        spans = out[i]["spans"]
        assert [(s["s"], s["o"], s["kind"], s["e"]) for s in spans if s["base"]] == want
        assert [(s["s"], s["o"]) for s in spans] == sorted((s["s"], s["o"]) for s in spans)
        if len(want) == 1 and len(spans) == 1:
            assert out[i]["masked"] == t[: want[0][0]] + f"[{want[0][2].upper()}]" + t[want[0][3] :]
        if not spans:
            assert out[i]["masked"] == t
    assert pii.detect(docs).count() == docs.count() and pii.detect(empty).count() == 0
    assert [c for c in pii.detect(docs).columns if c != "spans"] == [c for c in docs.columns if c != "spans"]


@pytest.mark.parametrize("piece", [lambda i: f"u{i}@mail{i % 7}.example.com 10.0.{i % 256}.{i % 300} call (212) 555-{i % 10000:04d}; ", lambda i: f"é {4111111111110000 + i % 10000} 😀 {i % 10000:04d}, "])
def test_pii_of_nine_megabytes(spark, piece):
    """A very long text full of matches takes time in proportion; every base span and the text between is right."""
    text = "".join(map(piece, range(9_000_000 // len(piece(5000)))))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = pii.detect(df)
    r = found.select("spans", pii.redacted(F.col("text"), F.col("spans")).alias("masked")).first()
    assert time.time() - began < 120
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert [(s["s"], s["e"]) for s in r["spans"] if s["kind"] == "email"] == want
    out, at = [], 0
    for s in r["spans"]:
        if s["s"] >= at:
            out += [text[at : s["s"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["e"])
    assert r["masked"] == "".join(out) + text[at:]


def test_scans(spark):
    rng = random.Random(5)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 9000):
        x = [rng.randint(0, 100) for _ in range(n)]
        df = spark.createDataFrame([(x,)], "x array<int>")
        total, most = df.select(pii.scan(F.col("x"), lambda a, b: a + b, 0), pii.scan(F.col("x"), lambda a, b: F.greatest(a, b), 0)).first()
        assert total == list(itertools.accumulate(x, initial=0))[:n] and most == list(itertools.accumulate(x, max, initial=0))[:n]


def test_columns_of_any_name(spark, docs, tmp_path):
    odd = ["a.b", "back`tick", "Slot", "SPANS", "Lang_Pred", "n_tokens", "own_", "c d"]
    df = docs.limit(30)
    for c in odd:
        df = df.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) if c not in df.columns else df
    df = common.materialize(df, "test-odd")
    for out in (mixing.mix(df), pii.detect(df), bpe.encode(df), langid.identify(df)):
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower) and out.count() == df.count()
        assert all(r["a.b"] == "a.b" + ("" if r["doc_id"] is None else str(r["doc_id"])) for r in out.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[c] == c + ("" if r["doc_id"] is None else str(r["doc_id"])) for c in ("a.b", "back`tick", "Slot", "SPANS", "Lang_Pred", "c d"))
    assert corpus_pipeline.encode(spark, df, str(tmp_path)).count() == df.count()


def test_em_separates():
    patterns = [(("email", 1, 1, 1, 0), 90), (("email", 0, 0, 0, 1), 60), (("email", 0, 1, 1, 1), 10), (("email", 1, 0, 1, 0), 10)]
    post, rates = pii.estimate(patterns)
    assert post["email", 1, 1, 1, 0] > 0.9 > 0.5 > post["email", 0, 0, 0, 1] and all(a >= b for a, b in rates.values())
    w = pii.train(patterns, post)
    z = lambda k: sum(a * b for a, b in zip(w, pii.features(k)))
    assert z(("email", 1, 1, 1, 0)) > 0 > z(("email", 0, 0, 0, 1))


def test_bpe(spark, docs, empty):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    own = bpe.encoder("word_bpe_49k.json")
    rng = random.Random(9)
    parts = ["a", "the", "'s", "'LL", "É", "İ", "Σ", "ς", "ß", "中文", "😀", "\x00", "\x1c", "\x85", "\xa0", " ", "\n", "1", "²", "_", "%%%", "<|endoftext|>", "<|startoftext|>", "<|", "é", "́", "​", "ǅ", "ﬁ", "x" * 40, "qzxjv"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        e = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == (" ".join(map(str, e)), lib.decode(e, skip_special_tokens=False))
    assert own.fragments("qzxj") != ["qzxj"] and "".join(own.fragments("qzxjthe")) == "qzxjthe"
    out = bpe.encode(docs.drop("n_chars"), output="values").collect()
    for r in out:
        assert r["ids"] == lib.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == lib.decode(r["ids"], skip_special_tokens=False)
    assert bpe.encode(empty).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(11)
    a, b = ["the", "and", "with", "there", "which"], ["und", "nicht", "schön", "über", "zwischen"]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(40)), "en" if i % 2 else "de", None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score string")
    out = langid.identify(df).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 < r["lang_score"] <= 1 for r in out)
    edge = {r["text"]: r["lang_pred"] for r in langid.predict(docs, langid.profiles(df)).collect()}
    assert edge[None] == edge[""] == edge["%%% ### $$$"] == "und" and edge["one"] in ("en", "de")
    assert langid.identify(empty).count() == 0 and langid.profiles(empty) == {}
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    codes = langid.gram_codes("abab")
    assert Counter(langid.gram_codes("ab ab").tolist()) == Counter(langid.gram_codes("ab-ab").tolist()) and len(codes) == 4 + 5 + 4


def test_toxicity(spark, docs, empty):
    rng = random.Random(13)
    calm = [words(rng, 40) for _ in range(300)]
    rude = [f"{words(rng, 10)}. You vilx{rng.randint(0, 9)}! {words(rng, 10)} {rng.choice(['idiot', 'vilxan'])} you." for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(calm + rude)), "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i >= 300)) for i in range(450)] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, y.where("doc_id % 3 <> 0 OR doc_id IS NULL"))
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d, model).collect()}
    assert np.mean([(out[i] >= 0.5) == (i >= 300) for i in range(0, 450, 3)]) > 0.95 and any("vilx".startswith(s.strip("=")[:4]) for s in model.stems)
    edge = toxicity.score(docs, model)
    assert edge.count() == docs.count() and all(0 <= r["toxicity"] <= 1 for r in edge.collect())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(d, y.where("false"))
    rank = [r["toxicity"] for r in toxicity.score(spark.createDataFrame([(1, "you are an idiot"), (2, "you are not an idiot"), (3, "hello")], "doc_id long, text string"), none).orderBy("doc_id").collect()]
    assert rank[0] > rank[1] > rank[2]


def test_grammar_states():
    run = lambda *symbols: [toxicity.machine()[s, x][1] for s, x in [((0, 0, 0), symbols[0])]] if len(symbols) == 1 else None
    assert run(toxicity.INSULT) == ["insult_bare"]
    s, _ = toxicity.step((0, 0, 0), toxicity.TARGET)
    assert toxicity.step(s, toxicity.INSULT)[1] == "insult_directed"
    s, _ = toxicity.step(s, toxicity.NEGATION)
    assert toxicity.step(s, toxicity.INSULT)[1] == "insult_negated"
    for _ in range(toxicity.REACH):
        s, _ = toxicity.step(s, toxicity.OTHER)
    assert toxicity.step(s, toxicity.INSULT)[1] == "insult_directed"
    s, _ = toxicity.step(s, toxicity.REPORT)
    assert toxicity.step(s, toxicity.INSULT)[1] == "insult_reported" and toxicity.step(s, toxicity.END)[0] == (0, 0, 0)


def test_quality(spark, docs, empty):
    out = quality.judge(docs).collect()
    texts = Counter()
    for _, t in pairs(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        texts[len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == texts
    assert all(not (r["base_failed"] and r["kept"]) for r in out) and quality.judge(empty).count() == 0
    hosts = spark.createDataFrame([("bad", True)] * 900 + [("bad", False)] * 100 + [("ok", True)] * 10 + [("ok", False)] * 990 + [("new", True)], "host string, f boolean")
    v = {r["host"]: r for r in quality.host_verdicts(hosts, "host", "f").collect()}
    assert v["bad"]["host_bad"] and not v["ok"]["host_bad"] and v["new"]["host_rate"] < 1


def test_hosts_of_one_document_are_not_condemned_by_it(spark):
    rng = random.Random(41)
    small = spark.createDataFrame([(f"h{i}", rng.random() < 0.2) for i in range(2000)], "host string, f boolean")
    assert not any(r["host_bad"] for r in quality.host_verdicts(small, "host", "f").collect())
    # hosts of three documents whose true rates are equal: the spread is noise, the prior is strong
    even = spark.createDataFrame([(f"h{i // 3}", rng.random() < 0.2) for i in range(6000)], "host string, f boolean")
    assert not any(r["host_bad"] for r in quality.host_verdicts(even, "host", "f").collect())
    # hosts that differ: half always fails
    split = spark.createDataFrame([(f"h{i // 10}", i // 10 % 2 == 0) for i in range(6000)], "host string, f boolean")
    v = {r["host"]: r["host_bad"] for r in quality.host_verdicts(split, "host", "f").collect()}
    assert all(bad == (int(h[1:]) % 2 == 0) for h, bad in v.items())


def test_the_host_of_a_url_is_its_domain(spark):
    urls = ["https://A.example/x?y", "http://user@a.example:80/", "a.example", None]
    df = spark.createDataFrame([(i, "word " * 60, u, "kept") for i, u in enumerate(urls)], "doc_id long, text string, source string, w string")
    assert [r["host"] for r in quality.judge(df).orderBy("doc_id").collect()] == ["a.example"] * 3 + [None]
    assert [r["w"] for r in quality.measured(df).collect()] == ["kept"] * 4 and "n_words" in quality.measured(quality.measured(df)).columns


def test_mixing(spark, docs, empty, monkeypatch):
    sizes = {"a": 700, "b": 200, "c": 40, "": 3}
    rows = [(i, s if s else None) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "": 0.05}
    out = mixing.mix(df, weights, block=4, period=40).toPandas().fillna({"source": ""})
    assert len(out) == len(rows) and not out.duplicated(["slot", "place"]).any() and set(out.slot) == set(range(out.slot.max() + 1))
    assert out.groupby("slot").source.nunique().max() == 1
    order = out.sort_values("slot").drop_duplicates("slot")
    for phase, part in order.groupby("phase"):
        left = [s for s in weights if (order[order.phase >= phase].source == s).any()]
        for s in left:
            lag = np.cumsum(part.source.values == s) - np.arange(1, len(part) + 1) * weights[s] / sum(weights[t] for t in left)
            assert np.abs(lag).max() < 1
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0
    monkeypatch.setattr(mixing, "SMALL_PLAN", 0)
    again = mixing.mix(df, weights, block=4, period=40).toPandas()
    assert set(zip(again.doc_id, again.slot, again.place)) == set(zip(out.doc_id, out.slot, out.place))
    one = mixing.mix(df, {"a": 1e-9, "b": 1e-9}, block=4).toPandas().fillna({"source": ""})
    named = one[one.source.isin(["a", "b"])]
    assert one[~one.source.isin(["a", "b"])].slot.min() > named.slot.max()  # sources without a weight come last
    assert mixing.mix(df.withColumn("row", F.lit(1)).withColumn("at", F.lit(2))).count() == len(rows)


@pytest.mark.parametrize("weights", [{"a": 1 / 3, **{f"s{i}": 2 / 57 for i in range(19)}}, {"a": 0.999, "b": 0.001}, {"a": 0.6137, "b": 0.2511, "c": 0.1352}])
def test_mixing_keeps_to_the_target_weights(spark, weights):
    rows = [(s, k) for s, w in weights.items() for k in range(round(9000 * w) + 3)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, source string")
    out = mixing.mix(df, weights, block=1).toPandas()
    assert sorted(out.slot) == list(range(len(rows))) and sorted(out.doc_id) == list(range(len(rows)))
    order = out.sort_values("slot")
    for phase, part in order.groupby("phase"):
        left = [s for s in weights if (order[order.phase >= phase].source == s).any()]
        for s in left:
            lag = np.cumsum(part.source.values == s) - np.arange(1, len(part) + 1) * weights[s] / sum(weights[t] for t in left)
            assert np.abs(lag).max() < 1


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.0999, "c": 0.0001}, {"a": 0.5021, "b": 0.4979}, {"a": 0.1, "b": 0.7 / 3, "c": 2 / 3}])
def test_a_schedule_of_a_million_slots_never_leaves_the_weights(weights):
    target = mixing.targets(dict.fromkeys(weights, 1), weights)
    slots = mixing.schedule(dict.fromkeys(weights, 1 << 40), mixing.shares(target), 1_000_000)
    assert sum(map(len, slots.values())) == 1_000_000
    for s, w in weights.items():
        at, k = np.array(slots[s], float), np.arange(len(slots[s]))
        share = w / sum(weights.values())
        # just before its k-th block a source has k of share * slot, just after it k + 1 of share * (slot + 1)
        assert np.abs(k - share * at).max() < 1 + 1e-6 and np.abs(k + 1 - share * (at + 1)).max() < 1 + 1e-6


def test_blocks_grow_before_the_plan_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    out = mixing.mix(spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"))).toPandas()
    assert out.slot.nunique() == 10 and out.place.max() == 99


def test_mixing_of_default_weights_keeps_to_them(spark):
    sizes = {"a": 5000, **{f"s{i}": 300 + 37 * i for i in range(8)}}
    df = spark.range(sum(sizes.values())).select(F.col("id").alias("doc_id"), F.element_at(F.array(*(F.lit(s) for s, n in sizes.items() for _ in range(n // 10))), (F.col("id") % sum(n // 10 for n in sizes.values()) + 1).cast("int")).alias("source"))
    out = mixing.mix(df, block=1).toPandas().sort_values("slot")
    counts = out.source.value_counts()
    assert sorted(out.slot) == list(range(len(out)))
    first = out[out.phase == 0]
    for s, n in counts.items():
        lag = np.cumsum(first.source.values == s) - np.arange(1, len(first) + 1) * n**0.7 / (counts**0.7).sum()
        assert np.abs(lag).max() < 1


def test_mixing_drops_no_source_of_weight_zero(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, source string")
    out = mixing.mix(df, {"a": 0.0, "b": 1.0}, block=4).toPandas()
    assert sorted(zip(out.slot, out.place)) == [(i, j) for i in range(10) for j in range(4)]
    assert set(out[out.slot < 5].source) == {"b"}


def test_vectors(spark):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(120, 16))
    rows = [list(map(float, v)) for v in base] + [list(map(float, v + rng.normal(size=16) * 0.1)) for v in base[:30]] + [list(map(float, base[0]))] * 3 + [list(map(float, 2 * base[1]))]
    rows += [None, [0.0] * 16, [], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)] + [(5, rows[5], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    x = np.array([np.asarray(r, np.float32).astype(float) if r is not None and len(r) == 16 and None not in r and np.isfinite(r).all() and any(r) else np.full(16, np.nan) for r in [*rows, rows[5]]])
    ids = [*range(len(rows)), 5]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.nan_to_num(u @ u.T, nan=-1) >= 0.9
    np.fill_diagonal(near, False)
    root = joined(list(range(len(ids))), lambda a, b: near[a, b])
    want = sorted((i, int(near[k].sum()), min(ids[j] for j in range(len(ids)) if root[j] == root[k]), None) for k, i in enumerate(ids))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == (g[0] == g[2]) for g in got)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [6000, 60])  # whole shards, and shards dealt in parts
def test_graph_search_reaches_recall(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "MOST_SHARD", most)
    rng = np.random.default_rng(19)
    c = rng.normal(size=(300, 24))
    x = np.concatenate([c, *(c[:60] + rng.normal(size=(60, 24)) * 0.12 for _ in range(6))])
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, v array<float>")
    cents = embeddings.centroids_of(embeddings.unit(x), 4)
    links = embeddings.verified(v, embeddings.graph_links(v, cents, 2, 0.9)[0], 0.9)
    assert embeddings.audit(v, links, 0.9, 10_000) >= 0.9


def bunches(rng, n, dim=16):
    """Pairs of bunches of n nearly equal vectors each; the two of a pair are at a cosine of 0.95."""
    out = []
    for _ in range(3):
        p, q = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        for m in (p, 0.95 * p + (1 - 0.95**2) ** 0.5 * q):
            out.append(m + rng.normal(size=(n, dim)) * 1e-4)
    return np.concatenate(out).astype(np.float32)


def exact(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.triu(u @ u.T >= 0.9, 1)
    return {(int(a), int(b)) for a, b in np.argwhere(near)}


def test_bunches_keep_their_links(spark):
    x = bunches(np.random.default_rng(23), 100)
    df = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    degree = Counter(i for pair in exact(x) for i in pair)
    assert got == {i: (degree[i], i // 200 * 200) for i in range(len(x))}


@pytest.mark.parametrize("most", [6000, 60])
def test_exact_links_whatever_the_centroids(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "MOST_SHARD", most)
    rng = np.random.default_rng(29)
    x = np.concatenate([bunches(rng, 20), rng.normal(size=(100, 16)).astype(np.float32)])
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, v array<float>")
    for c in (embeddings.unit(x[::20]), embeddings.unit(rng.normal(size=(7, 16)))):
        assert {(r["a"], r["b"]) for r in embeddings.verified(v, embeddings.exact_links(v, c, 0.9), 0.9).collect()} == exact(x)


def test_the_expansion_leaves_the_shards(spark):
    # two shards hold a chain each; the only way from 0 to 4 is the merged graph
    rng = np.random.default_rng(37)
    p, q = np.linalg.qr(rng.normal(size=(12, 2)))[0].T
    x = [np.cos(a) * p + np.sin(a) * q for a in (0, 0.1, 0.2, 0.3, 0.4)]
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, v array<double>")
    shards = {0: [0], 1: [0, 1], 2: [0, 1], 3: [1], 4: [1]}
    near = {0: [1, 2], 1: [0, 2, 3], 2: [1, 3, 4], 3: [1, 2, 4], 4: [2, 3]}
    graph = spark.createDataFrame([(i, near[i], shards[i]) for i in near], "id long, near array<long>, shards array<int>")
    known = [(a, b) for a in near for b in near if a < b and set(shards[a]) & set(shards[b])]
    links = spark.createDataFrame(known, "a long, b long")
    got = {(r["a"], r["b"]) for r in embeddings.expanded(v, graph, links, 0.9).collect()}
    assert got == exact(np.array(x)) and got - set(known) == {(0, 3), (0, 4)}


def test_doubles_are_compared_as_doubles(spark):
    a = [1.0] + [0.0] * 7
    just = [0.9 + 1e-12, (1 - 0.9**2) ** 0.5] + [0.0] * 6
    below = [0.9 - 1e-12, (1 - 0.9**2) ** 0.5] + [0.0] * 6
    for other, n in ((just, 1), (below, 0)):
        df = spark.createDataFrame([(0, a, "x"), (1, other, "y")], "vec_id long, embedding array<double>, recall string")
        rows = embeddings.near_duplicates(df).collect()
        assert [r["n_links"] for r in rows] == [n, n] and rows[0]["recall"] == 1.0


def test_low_recall_is_not_silent(spark, monkeypatch):
    x = bunches(np.random.default_rng(31), 10)
    df = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    none = lambda v, *_: v.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    graph = lambda v: v.select("id", F.lit(None).cast("array<long>").alias("near"), F.lit(None).cast("array<int>").alias("shards"))
    monkeypatch.setattr(embeddings, "graph_links", lambda v, *_: (none(v), graph(v)))
    assert embeddings.near_duplicates(df).agg(F.sum("n_links")).first()[0] == 2 * len(exact(x))
    monkeypatch.setattr(embeddings, "exact_links", none)
    with pytest.raises(RuntimeError, match="recall"):
        embeddings.near_duplicates(df)


def test_pipeline_keeps_mixing_slots(spark, docs, tmp_path):
    some = common.materialize(docs.limit(60), "test-some")
    want = sorted((str(r["doc_id"]), r["slot"], r["place"]) for r in mixing.mix(some).select("doc_id", "slot", "place").collect())
    assert sorted((str(r["doc_id"]), r["slot"], r["place"]) for r in corpus_pipeline.encode(spark, some, str(tmp_path)).collect()) == want


def test_pipeline_keeps_documents_without_labels(spark, docs, tmp_path):
    df = spark.createDataFrame([(1, "a clean text", None), (2, None, None), (3, "123 --", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.identify(spark, df, str(tmp_path)).collect()] == [1]


def test_pipeline(spark, docs, empty, tmp_path):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = common.materialize(stage(spark, out, str(tmp_path)), f"test-{name}")
        if name != "bpe":
            assert out.columns == docs.columns
        assert out.count() <= before.count()
    texts = [r["text"] for r in out.collect()]
    assert None not in texts and "" not in texts and len(texts) == len(set(texts))
    last = empty
    for _, stage in corpus_pipeline.STAGES:
        last = stage(spark, last, str(tmp_path))
    assert last.count() == 0
    assert isinstance(docs.schema, T.StructType)
