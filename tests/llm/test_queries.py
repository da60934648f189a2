"""Each registered query over tables on disk, against its SQL or a brute-force version."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomspan.llm import common, langid, mixing, pii, queries, toxicity
from tests.llm.test_llm import joined, slow_fingerprint, words

EXTRA = ("spans", "toxicity", "lang_pred", "n_tokens", "block", "src", "h", "_row", "row", "own", "place", "w", "kept", "fp", "digest", "a.b", "Slot", "back`tick", "Lang_Score", "own_0", "c d")
INSULTS = ("idiot", "vilxan", "vilxon")


def library():
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(101)
    latin = ["the", "and", "with", "there", "which", "house", "water"]
    german = ["und", "nicht", "schön", "über", "zwischen", "haus", "wasser"]
    out = []
    for i in range(160):
        lang, pool = (("en", latin), ("de", german))[i % 2]
        text = " ".join(rng.choice(pool) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(5, 120)))
        if i % 5 == 1:
            text += f". You {rng.choice(INSULTS)}! {words(rng, 5)}. He said they are {rng.choice(INSULTS)}. You are not an {rng.choice(INSULTS)}."
        if i % 7 == 3:
            text += f" mail a{i}@b.org or call +1 (555) 010-{2000 + i}, card 4111 1111 1111 1111 at 10.0.0.{i}"
        out.append([i, text, lang if i % 3 else None, f"s{0 if i < 60 else i % 6}", i % 5 == 1])
    passage = words(rng, 60)
    for i in (3, 50, 90):
        out[i][1] += " " + passage
    for i in range(160, 190):  # exact and near copies
        out.append([i, out[i - 150][1] if i % 2 else out[i - 150][1] + " tail", None, None, None])
    out += [[i, t, None, "s1", 0] for i, t in enumerate(["", None, " \n\t ", "%%% ###", "one", "a b c\na b c\n\nx\na b c"], 190)]
    return out


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    table = [(i, t, lang, s, len(t or ""), *["x"] * len(EXTRA)) for i, t, lang, s, _ in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in EXTRA)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, None, None if y is None else int(y)) for i, *_, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(103)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 16)) * 0.1, x[:5] + rng.normal(size=(5, 16)) * 0.3, x[7:8]]).astype(np.float32)
    vectors = [(i, [float(z) for z in r], "x") for i, r in enumerate(x)] + [(len(x), None, "x"), (len(x) + 1, [0.0] * 16, "x"), (len(x) + 2, [float("nan")] * 16, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").write.parquet(f"{folder}/embeddings.parquet")
    items = [(i, (t or "")[10:150], *["x"] * len(EXTRA)) for i, t, *_ in rows[::9]] + [(7, None, *["x"] * len(EXTRA)), (None, "the und THE", *["x"] * len(EXTRA)), (8, "zzz qqq", *["x"] * len(EXTRA))]
    spark.createDataFrame(items, "item_id long, text string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in EXTRA)).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def run(spark, sf, name):
    return queries.QUERIES[next(q for q in queries.QUERIES if q.startswith(f"{name}_"))](spark, sf).collect()


def hexed(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r[c] for c in rel.columns)) for r in df.collect()) == want and want
    if name.startswith("op1_"):
        assert sum(r["n_links"] for r in df.collect()) >= 40


def test_op2(spark, sf, rows):
    """Scores again by a clause-by-clause reading of the grammar, with the fitted stems and weights."""
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(common.bucket("doc_id", 5) != 0).select("doc_id", "toxic"))
    known = {w: s for s in reversed(toxicity.SYMBOLS) for w in toxicity.SYMBOLS[s].split()}

    def symbol(word):
        if word in known:
            return known[word]
        return toxicity.INSULT if any(word == x[1:] if x[0] == "=" else word.startswith(x) for x in model.stems) else toxicity.OTHER

    def features(text):
        found, said, matched = Counter(), set(), 0
        for clause in re.split(r"[.!?;:\n]", text.lower()):
            tokens = [t for t in toxicity.TOKEN.findall(clause)]
            marks = [symbol(t) for t in tokens]
            outs = set()
            for i, m in enumerate(marks):
                if m not in (toxicity.INSULT, toxicity.THREAT):
                    continue
                negated, reported, target = toxicity.NEGATION in marks[max(0, i - 3) : i], toxicity.REPORT in marks[:i], toxicity.TARGET in marks[:i]
                if m == toxicity.INSULT:
                    out = "insult_negated" if negated else "insult_reported" if reported else "insult_directed" if target else "insult_bare"
                    if not negated and not reported:
                        said.add(tokens[i])
                else:
                    out = "threat_excused" if negated or reported else "threat_directed" if target else "threat_bare"
                outs.add(out)
            found.update(outs)
            matched += bool(outs)
        return [*(np.log1p(found[k]) for k in toxicity.OUTPUTS), np.log1p(len(said)), float(matched > 1)]

    got = {r["doc_id"]: r for r in run(spark, sf, "op2")}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, z = got[i], float(np.dot(features(t or ""), model.weights[:-1]) + model.weights[-1])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert np.mean([got[i]["predicted"] == y for i, *_, y in rows if y is not None and got[i]["held_out"]]) > 0.8


def test_negated_and_reported_insults_are_not_counted_alone():
    own = toxicity.Grammar([])
    assert own.features("They said he is an idiot. I am not a moron.")[len(toxicity.OUTPUTS)] == 0.0
    assert own.features("You idiot. You moron.")[len(toxicity.OUTPUTS)] == pytest.approx(np.log(3))


def test_op3(spark, sf, rows):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    root = joined(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{f:016x}", least[r], i == least[r]) for (i, *_), f, r in zip(rows, fps, root, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"], r["kept"]) for r in run(spark, sf, "op3")) == want


def test_op4(spark, sf, rows):
    lib = library()
    want = set()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hexed(" ".join(map(str, ids))), hexed(lib.decode(ids, skip_special_tokens=False))))
    got = run(spark, sf, "op4")
    assert len(got) == len(rows) and {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def base_spans(text):
    def luhn(s):
        return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(s))) % 10 == 0

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (True, all(int(x) <= 255 for x in m[0].split(".") if x.isdigit()), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def test_op5(spark, sf, rows):
    got = {r["doc_id"]: r for r in run(spark, sf, "op5")}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        spans, r = base_spans(t or ""), got[i]
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hexed(",".join(listed)) and set(listed) <= set(r["spans"].split(","))
        assert {k: r[f"n_{k}"] for k in pii.KINDS} == {k: sum(x[0] == k for x in spans) for k in pii.KINDS}
        # what the method adds overlaps no base span and is a candidate of its kind
        for x in set(filter(None, r["spans"].split(","))) - set(listed):
            k, a, b = x.split(":")
            assert k in ("email", "phone", "card") and all(int(b) <= s or e <= int(a) for _, s, e in spans)


def test_op6(spark, sf, rows):
    raw = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    want = set()
    for (i, *_), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.add((i, len(b), int(gone.sum()), runs, hexed(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    got = run(spark, sf, "op6")
    assert len(got) == len(rows) and {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def grams(text):
    """All 1- to 3-grams of the words of a text, a blank at each end, none across a blank."""
    spaced = " " + " ".join("".join(c if unicodedata.category(c)[0] in "LM" or c == "'" else " " for c in text.lower()).split()) + " "
    return [g for n in (1, 2, 3) for g in (spaced[i : i + n] for i in range(len(spaced) - n + 1)) if g.strip() and not (n == 3 and g[1] == " ")]


def places(counts):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.TOP])}


def test_op10(spark, sf, rows):
    """Out-of-place distances of ranked lists, gram by gram."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = {}
    for i, t, lang, *_ in rows:
        if lang and t is not None and not held(i):
            learned.setdefault(lang, Counter()).update(grams(t))
    ranks = {lang: places(c) for lang, c in learned.items()}
    got = {r["doc_id"]: r for r in run(spark, sf, "op10")}
    assert len(got) == len(rows)
    for i, t, lang, *_ in rows:
        own = places(Counter(grams(t or "")))
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cost = {x: sum(abs(k - r[g]) if g in r else langid.TOP for g, k in own.items()) for x, r in ranks.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[i]["lang_pred"] == best and got[i]["held_out"] == held(i)
        assert got[i]["score"] == pytest.approx(1 - cost[best] / (langid.TOP * len(own)))
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if lang and held(i)]) > 0.95


def test_pipeline(spark, sf, rows):
    """Rows, languages, tokens and slots by brute force; personal data as the operator finds it in each text alone."""
    kept = [(i, t, lang, s) for i, t, lang, s, _ in rows if any(c.isalpha() for c in t or "")]
    fps = [slow_fingerprint(t) for _, t, *_ in kept]
    root = joined(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), r in zip(kept, root, strict=True):
        least[r] = min(i, least.get(r, i))
    kept = [x for x in kept if x[0] in set(least.values())]
    frame = spark.createDataFrame([x[:2] for x in kept], "doc_id long, text string")
    masked = {r["doc_id"]: r["t"] for r in pii.detect(frame).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, t, *_ in kept:
        for _, a, b in base_spans(t):
            assert t[a:b] not in masked[i]
    # earliest deadline first, slot by slot
    blocks, lined = {}, {}
    for i, _, _, s in sorted(kept, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
        lined.setdefault(s or "", []).append(i)
    weight = {s: round(len(x) ** 0.7 * mixing.PRECISION) for s, x in sorted(lined.items())}
    blocks = {s: -(-len(lined[s]) // 16) for s in weight}
    want, slot, done, left = {}, 0, dict.fromkeys(weight, 0), dict(blocks)
    while any(left.values()):
        live, t, k = {s: w for s, w in weight.items() if left[s]}, 0, dict.fromkeys(weight, 0)
        total = sum(live.values())
        while True:
            ready = [(-(-(k[s] + 1) * total // w), n, s) for n, (s, w) in enumerate(live.items()) if k[s] * total // w <= t]
            s = min(ready)[2]
            if not left[s]:
                break
            for place, i in enumerate(lined[s][16 * done[s] : 16 * done[s] + 16]):
                want[i] = (slot, place)
            k[s], done[s], left[s], t, slot = k[s] + 1, done[s] + 1, left[s] - 1, t + 1, slot + 1
            if not any(left.values()):
                break
    lib = library()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: (r["slot"], r["place"]) for r in got} == want and len(got) == len(want)
    given = {i: lang for i, _, lang, _ in kept}
    for r in got:
        ids = lib.encode(masked[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hexed(" ".join(map(str, ids)))
        assert r["lang"] == given[r["doc_id"]] if given[r["doc_id"]] else r["lang"] in ("en", "de")


def test_texts_beyond_a_slice(spark, tmp_path):
    """A text of 9 MB crosses the borders of slices and pieces; a part of it is found in another."""
    rng = np.random.default_rng(107)
    pool = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(50_000)])
    tokens = pool[rng.integers(0, len(pool), 1_150_000)].tolist()
    long, part = " ".join(tokens), " ".join(tokens[100_000:160_000])
    texts = [long, f"\x01{part}\x01", "a short one"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {n: {r["doc_id"]: r for r in run(spark, str(tmp_path), n)} for n in ("op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10")}
    size = len(part)
    assert [(out["op6"][i]["n_bytes"], out["op6"][i]["n_removed"], out["op6"][i]["n_spans"]) for i in range(3)] == [(len(long), size, 1), (size + 2, size, 1), (11, 0, 0)]
    assert out["op6"][0]["kept_sha256"] == hexed(long.replace(part, "")) and out["op6"][1]["kept_sha256"] == hexed("\x01\x01")
    # the part's first and last words carry a mark there, so they are others
    assert [out["op8"][i]["n_removed"] for i in range(3)] == [0, 60_000 - 2, 0] and out["op8"][0]["n_words"] == len(tokens)
    lib = library()
    ids = lib.encode(long, add_special_tokens=False).ids
    assert out["op4"][0]["n_tokens"] == len(ids) and out["op4"][0]["ids_sha256"] == hexed(" ".join(map(str, ids)))
    assert out["op9"][0]["n_words"] == len(tokens) and out["op9"][0]["word_chars"] == 7 * len(tokens)
    assert out["op10"][0]["lang_pred"] == "aa" and all(len(x) == 3 for x in out.values())
    grams3 = [" ".join(tokens[i : i + 3]).encode() for i in range(len(tokens) - 2)]
    assert out["op3"][0]["fingerprint"] == f"{majority(grams3):016x}"


def majority(shingles):
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
