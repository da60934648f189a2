"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from the base patterns and from wider ones. Labelers vote on each candidate: the pattern (is it a
base match), a gazetteer (known top-level domains, dialling codes, card prefixes, address ranges) and the context (cue
words before it). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; the
posteriors of the patterns then train a logistic span classifier over votes and shape. Base matches always stay; the
classifier decides which wider candidates join them.

Votes are binary or absent and shape has two values, so there are at most 4 x 2 x 3 x 3 x 2 = 144 patterns however many
spans there are; these counts are all that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import materialize, named, read

KINDS = ("email", "ip", "card", "phone")

#: The base patterns of the contract. Possessive repeats and look-behind give the same leftmost matches in linear time:
#: a match cannot begin inside a run of its own first class unless the match before ended there.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates: spelled-out addresses, and numbers in national form.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?[\[(][\x20]?at[\x20]?[\])][\x20]?[A-Za-z0-9-]++(?:[\x20]?[\[(][\x20]?dot[\x20]?[\])][\x20]?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?<![0-9+().-][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for a pattern to be worth a search.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel|adresse|reach",
    "ip": r"\bip\b|server|host|address|addr|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta|account",
    "phone": r"phone|\btel|call|mobile|\bfax|anruf|appel|llam|cell",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\x20\])]+)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|example|test|invalid)$",
    "ip": r"^(?:10|127|172|192|198|203|8|1)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|33|34|44|49|39|31|41|43|61|81|86|91)|\(?[2-9][0-9]{2})",
}
#: Characters before a span that the context labeler reads.
CONTEXT = 40


#: Values that a scan takes in one stretch; longer arrays are scanned stretch by stretch, and those again.
STRETCH = 64


def let(x: Column, f) -> Column:
    """f of x, which is made once however often f names it."""
    return F.transform(F.array(x), f)[0]


def scan(values: Column, join, zero: int, levels: int = 2) -> Column:
    """What join gives of all values before each one (`zero` before the first), in linear time.

    Appending to an array copies it, so stretches of STRETCH values are scanned alone, and what a stretch comes to is scanned in turn.
    """
    begin = F.lit(zero)

    def short(a):
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    if not levels:
        return let(values, short)

    def long(a):
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / STRETCH).cast("int") - 1, F.lit(0))), lambda i: F.slice(a, i * STRETCH + 1, STRETCH))

        def over(parts):
            sums = F.transform(parts, lambda b: F.aggregate(b, begin, join))
            return F.flatten(F.zip_with(parts, scan(sums, join, zero, levels - 1), lambda b, at: F.transform(short(b), lambda x: join(at, x))))

        return let(cuts, over)

    return let(values, lambda a: F.when(F.size(a) <= STRETCH, short(a)).otherwise(long(a)))


def matches(text: Column, pattern: str, passing) -> Column:
    """Leftmost non-overlapping matches that pass, as array<struct<s, e, v, before>>: code points, end exclusive, and the CONTEXT characters before.

    Splitting on the pattern gives the gaps between the matches, so running sums of both lengths give the places. A match
    has two characters at least, so what stands before it lies in its gap and half as many pieces as characters.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))
    back = CONTEXT // 2

    def placed(p):
        size = F.transform(p, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0)))
        tails = F.transform(p, lambda x: F.right(F.concat(F.right(x["g"], F.lit(CONTEXT)), F.coalesce(x["v"], F.lit(""))), F.lit(CONTEXT)))

        def each(tail):
            def one(x, at, i):
                s = at + F.length(x["g"])
                near = F.concat(F.array_join(F.slice(tail, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), ""), F.right(x["g"], F.lit(CONTEXT)))
                return F.struct(s.alias("s"), (s + F.length(x["v"])).alias("e"), x["v"].alias("v"), F.right(near, F.lit(CONTEXT)).alias("before"))

            held = F.zip_with(p, scan(size, lambda a, b: a + b, 0), lambda x, at: F.struct(x.alias("x"), at.alias("at")))
            numbered = F.transform(held, lambda y, i: F.struct(y["x"].alias("x"), y["at"].alias("at"), i.alias("i")))
            kept = F.filter(numbered, lambda y: y["x"]["v"].isNotNull() & passing(y["x"]["v"]))
            return F.transform(kept, lambda y: one(y["x"], y["at"], y["i"]))

        return let(tails, each)

    return let(pieces, placed)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    places = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits(v))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus `spans` (a column of that name, in any case, is replaced): array<struct<s, o, e, kind, base, gaz, ctx, shape>>, by start and kind (o: its place in KINDS).

    base spans pass the contract's checks. Wide ones overlap no base span of any kind. gaz and ctx are votes 1 or 0;
    shape is 1 for a span with separators. The time goes with the text, however many spans it holds.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<struct<s:int,e:int,v:string,before:string>>")
    out = docs.select(F.struct(*(named(c) for c in docs.columns if c.lower() != "spans")).alias("_row"), text.alias("t"))
    # numbers of card length that fail are candidates too
    passing = {k: (lambda v: F.length(digits(v)).between(12, 19)) if k == "card" else (lambda v, k=k: valid(k, v)) for k in KINDS}
    for kind in KINDS:
        needed = F.contains("t", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        out = out.withColumn(f"b_{kind}", F.when(needed & F.col("t").rlike(BASE[kind]), matches(F.col("t"), BASE[kind], passing[kind])).otherwise(empty))

    def votes(kind: str, column: Column, base: int) -> Column:
        def one(x):
            return F.struct(
                x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                x["v"].rlike(GAZETTEER[kind]).cast("int").alias("gaz"), F.lower(x["before"]).rlike(CUES[kind]).cast("int").alias("ctx"), x["v"].rlike(r"[\x20().-]").cast("int").alias("shape"),
            )

        return F.transform(column, one)

    good = {k: F.col(f"b_{k}") if k != "card" else F.filter("b_card", lambda x: valid("card", x["v"])) for k in KINDS}
    base = F.concat(*(votes(k, good[k], 1) for k in KINDS))
    wide = [votes(k, F.when(F.col("t").rlike(p), matches(F.col("t"), p, lambda v: F.lit(True))).otherwise(empty), 0) for k, p in WIDE.items()]
    wide.append(votes("card", F.filter("b_card", lambda x: F.length(digits(x["v"])).between(15, 16) & ~valid("card", x["v"])), 0))
    out = out.withColumn("base", base).withColumn("wide", F.concat(*wide)).select("_row", "base", "wide")
    spans = F.when(F.size("wide") == 0, F.array_sort("base")).otherwise(let(F.array_sort(F.concat("base", "wide")), apart))
    return out.select("_row.*", spans.alias("spans"))


def apart(spans: Column) -> Column:
    """Of spans in order the base ones, and of the others those that overlap none of them: the furthest end of those before and the next start decide."""
    ends = scan(F.transform(spans, lambda x: F.when(x["base"] == 1, x["e"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
    far = (1 << 31) - 1
    starts = F.reverse(scan(F.transform(F.reverse(spans), lambda x: F.when(x["base"] == 1, x["s"]).otherwise(far)), lambda a, b: F.least(a, b), far))
    held = F.zip_with(F.zip_with(spans, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda y, s: F.struct(y["x"].alias("x"), y["e"].alias("e"), s.alias("s")))
    free = F.filter(held, lambda y: (y["x"]["base"] == 1) | ((y["e"] <= y["x"]["s"]) & (y["s"] >= y["x"]["e"])))
    return F.transform(free, lambda y: y["x"])


def estimate(patterns: list[tuple[tuple, int]], rounds: int = 200) -> tuple[dict, dict]:
    """EM for two classes with labelers that err independently: posteriors by pattern, (hit, false) rates by labeler.

    patterns: ((kind, base, gaz, ctx, shape), count). Each kind has its own prior; smoothing is one vote a side.
    """
    rates = {"base": (0.9, 0.1), "gaz": (0.8, 0.3), "ctx": (0.6, 0.2)}
    prior = dict.fromkeys(KINDS, 0.5)
    post: dict = {}
    for _ in range(rounds):
        for key, _n in patterns:
            kind, *vote = key
            a, b = prior[kind], 1 - prior[kind]
            for name, v in zip(("base", "gaz", "ctx"), vote, strict=False):
                hit, false = rates[name]
                a *= hit if v else 1 - hit
                b *= false if v else 1 - false
            post[key] = a / (a + b) if a + b else 0.5
        for kind in KINDS:
            own = [(post[k], n) for k, n in patterns if k[0] == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for j, name in enumerate(("base", "gaz", "ctx")):
            pos, neg = sum(post[k] * n for k, n in patterns), sum((1 - post[k]) * n for k, n in patterns)
            hit = (1 + sum(post[k] * n for k, n in patterns if k[j + 1])) / (2 + pos)
            false = (1 + sum((1 - post[k]) * n for k, n in patterns if k[j + 1])) / (2 + neg)
            rates[name] = (max(hit, false), min(hit, false))  # a labeler is no worse than chance
    return post, rates


def features(key: tuple) -> list[float]:
    kind, base, gaz, ctx, shape = key
    return [1.0, float(base), float(gaz), float(ctx), float(shape), *(float(kind == k) for k in KINDS[1:])]


def train(patterns: list[tuple[tuple, int]], post: dict, rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic regression of the posteriors on the features by gradient descent, patterns weighted by log(1 + count)."""
    rows = [(features(k), post[k], math.log1p(n)) for k, n in patterns]
    total = sum(n for *_, n in rows) or 1.0
    w = [0.0] * len(features(("email", 0, 0, 0, 0)))
    for _ in range(rounds):
        grad = [0.001 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, v in enumerate(x):
                grad[i] += (p - y) * v * n / total
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def detect(docs: DataFrame, text_col: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """docs plus `spans`: the base spans and the wide ones that the classifier accepts (probability 0.5 or more).

    A null text counts as empty, an empty one has no spans; texts of any length are read whole, rows that repeat get the
    same spans, an empty table gives an empty table. Kinds that begin at one place stand in the order of KINDS. A column
    named spans, in any case, is replaced, others are passed through, whatever their names. Candidates are written once to the
    shared folder, less the columns in `without`; the classifier is fitted on counts of all of them.
    """
    found = candidates(docs, text_col)
    found = materialize(found.select(*(named(c) for c in found.columns if c not in without)), "pii")
    votes = found.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.base", "x.gaz", "x.ctx", "x.shape").agg(F.count("*").alias("n"))
    patterns = sorted(((r["kind"], r["base"], r["gaz"], r["ctx"], r["shape"]), r["n"]) for r in votes.collect())
    post, _ = estimate(patterns)
    w = train(patterns, post)

    def accepted(x):
        z = F.lit(w[0]) + x["base"] * w[1] + x["gaz"] * w[2] + x["ctx"] * w[3] + x["shape"] * w[4]
        for i, k in enumerate(KINDS[1:]):
            z = z + F.when(x["kind"] == k, w[5 + i]).otherwise(0.0)
        return (x["base"] == 1) | (z >= 0)

    return found.withColumn("spans", F.filter("spans", accepted))


#: Characters of the pieces that a text is cut into before it is cut at spans.
PIECES = (1 << 18, 1 << 9)


def cut(text: Column, sizes: tuple[int, ...] = PIECES) -> Column:
    """The text in pieces of the last of the sizes; each size is cut from pieces of the one before, since a substring reads all that stands before it."""
    size, *rest = sizes
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    pieces = F.transform(places, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.flatten(F.transform(pieces, lambda p: cut(p, tuple(rest)))) if rest else pieces


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND]; of overlapping spans the first by start and kind counts, and all they cover goes."""
    size = PIECES[-1]

    def part(pieces, a, b):
        first = F.floor(a / size).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(b / size).cast("int") - first + 1), "")
        return F.substring(near, (a - first * size).cast("int") + 1, b - a)

    def masked(order):
        ends = scan(F.transform(order, lambda x: x["e"]), lambda a, b: F.greatest(a, b), 0)
        # a span that begins where all before it have ended stands for those that overlap it; what is before it and after their ends stays
        held = F.filter(F.zip_with(order, ends, lambda x, e: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), e.alias("from"))), lambda y: y["s"] >= y["from"])
        last = F.array_max(F.transform(order, lambda x: x["e"]))

        def joined(p):
            body = F.array_join(F.transform(held, lambda y: F.concat(part(p, y["from"], y["s"]), F.lit("["), F.upper(y["kind"]), F.lit("]"))), "")
            return F.concat(body, F.substring(text, last + 1, F.length(text)))

        return let(cut(text), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, masked))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; nulls, empty and very long texts, ties, repeats, empty tables and other columns as in detect."""
    out = detect(read(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))
    base = F.filter("spans", lambda x: x["base"] == 1)
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
