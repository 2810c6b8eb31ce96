"""Document fingerprints, source divergence and hard negatives against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scrapelake.llm import divergence, fingerprint, negatives
from scrapelake.llm.common import stored

# op11


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def hashed(parts):
    """Hash of a row: each part with the hash of those before it as seed."""
    value = 42
    for part in parts:
        value = xxhash.xxh64_intdigest(part if isinstance(part, bytes) else part.to_bytes(4, "little"), value)
    return value


def words_of(text):
    return text.encode().translate(bytes(32 if 9 <= c <= 13 else c for c in range(256))).split()


def shingles(text):
    found = words_of(text)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def print_by_hand(text):
    bins = {}
    for shingle in shingles(text):
        value = hashed(shingle)
        # Bins are numbered in signed order.
        number = (value >> 56) ^ 128
        bins[number] = min(bins.get(number, 1 << 64), value)
    if not bins:
        return ""
    digits = []
    for i in range(256):
        tries = [hashed([i, t]) & 255 for t in range(fingerprint.ATTEMPTS)]
        ranked = sorted(bins, key=lambda j: signed(hashed([i, j])))
        source = i if i in bins else next(b for b in [*tries, *ranked] if b in bins)
        digits.append(f"{bins[source] & 15:x}")
    return "".join(digits)


def near_by_hand(one, other):
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    share = sum(a == b for a, b in zip(one, other, strict=True)) / 256
    return max(0.0, (share - 1 / 16) / (1 - 1 / 16))


def edits_by_hand(rows):
    order = sorted(
        ((r[0], r[1] or "") for r in rows),
        key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed([r[1].encode()]))),
    )
    out = []
    for (doc_id, text), (_, following) in zip(order, [*order[1:], *order[:1]], strict=True):
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        a, b, c = map(print_by_hand, (text, changed, following))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc_id, len(text), sha, a, b, near_by_hand(a, b), near_by_hand(a, c)))
    return out


@pytest.mark.parametrize("parts", ["1", "8", "211"])
def test_fingerprints(spark, docs, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.edited(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(map(tuple, got)) == Counter(edits_by_hand(rows))


def test_fingerprints_of_few_rows(spark, no_docs):
    assert fingerprint.edited(no_docs).count() == 0
    for rows in ([(3, "a b c d e f")], [(3, "a")] * 4, [(-(1 << 63), "x y"), ((1 << 63) - 1, None), (None, "é\x85z")]):
        frame = spark.createDataFrame([(*r, "no") for r in rows], "doc_id bigint, text string, range string")
        assert Counter(map(tuple, fingerprint.edited(frame).collect())) == Counter(edits_by_hand(rows))


def test_likeness_is_the_jaccard_similarity(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 400, 3000]))]
        cut = rng.randrange(len(own) + 1)
        pairs.append((i, " ".join(own), " ".join(own[:cut] + [f"v{rng.randrange(10**6)}" for _ in own[cut:]])))
    frame = spark.createDataFrame(pairs, "i int, a string, b string")
    found = fingerprint.with_fingerprints(frame, x="a", y="b").withColumn("near", fingerprint.likeness(F.col("x"), F.col("y")))
    errors = []
    for r in found.collect():
        a, b = shingles(pairs[r.i][1]), shingles(pairs[r.i][2])
        errors.append(r.near - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045


def test_fingerprints_run_no_python(spark, docs):
    plan = fingerprint.edited(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# op12


def terms_by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    kept = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in lowered)
    return [t for t in kept.split(" ") if t]


def audit_by_hand(rows, least, top):
    found = defaultdict(Counter)
    docs = Counter()
    for text, lang, source in rows:
        terms = terms_by_hand(text or "")
        found[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= least:
            kept[lang].append(term)

    def prices(counts, terms):
        n = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(terms)) for t in terms}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang in {k[0] for k in found}:
        terms, sources = kept[lang], [s for g, s in found if g == lang]
        whole = prices(sum((found[lang, s] for s in sources), Counter()), terms)
        own = {s: prices(found[lang, s], terms) for s in sources}
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in terms), o) for o in sources if o != s]
            more = [(f(own[s][t], whole[t]), t) for t in terms if found[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", more, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(items[:most], 1)]
    return Counter(out)


@pytest.mark.parametrize(("terms", "tile", "held"), [(64, 32, 200_000), (4, 2, 5), (1, 3, 50)])
def test_divergence(spark, docs, rows, monkeypatch, terms, tile, held):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", held)
    extra = [(1, "Éa éA x1y É", "en", "zz", 1), (2, "lonely", "xx", "a", 1), (3, None, "xx", "b", 1), (4, "ab ab ab", None, None, 1)]
    given = [(r[1], r[2], r[3]) for r in [*rows, *extra]]
    more = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in extra], docs.schema)
    for least in (1, 10):
        got = divergence.audit(docs.unionByName(more), least, 3)
        assert Counter(map(tuple, got.collect())) == audit_by_hand(given, least, 3)


def test_divergence_of_nothing(spark, no_docs):
    assert divergence.audit(no_docs).count() == 0


def test_joint_tables_count_shared_terms():
    rng = np.random.default_rng(1)
    n = 40
    sides = []
    for _ in range(2):
        slots = rng.permutation(divergence.TERMS)[:n]
        items = {"slot": slots, "source": np.zeros(n, np.int64), "count": rng.integers(1, 4, n), "p": rng.integers(1, 9, n), "zero": np.ones(n, np.int64)}
        sides.append((items, divergence.Indicators(items)))
    one, other, counts = divergence.joint_tables(sides[0][1], sides[1][1])
    level = [dict(zip(i["slot"].tolist(), i["count"].tolist(), strict=True)) for i, _ in sides]
    want = Counter((level[0][s], level[1][s]) for s in level[0] if s in level[1])
    values = [np.unique(i["count"]) for i, _ in sides]
    assert {(int(values[0][a]), int(values[1][b])): int(c) for a, b, c in zip(one, other, counts, strict=True)} == want


# op13


def negatives_by_hand(rows, scale, every, n_pos, n_neg, low, high):
    usable = [
        (i, label, tuple(int(np.floor(scale * x)) for x in e))
        for i, e, label in rows
        if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = []
    for anchor, label, a in {r for r in usable if r[0] % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i, own) for i, own, v in usable if i != anchor)
        for p, positive, _ in [s for s in scored if s[2] == label][:n_pos]:
            inside = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(anchor, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(inside[:n_neg], 1)]
    return Counter(out)


@pytest.mark.parametrize(("block", "asked"), [(8, 3), (50, 200), (4096, 256)])
def test_negatives(spark, monkeypatch, block, asked):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", asked)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(size=5) / 5).tolist(), i % 4) for i in range(150)]
    rows += [(200 + i, rows[10][1], 1 + i % 2) for i in range(30)] + [rows[10], rows[20], rows[21], (300, [0.0] * 5, 1), (310, [], 2), (320, [1.5, -2.25], 3)]
    rows += [(400, None, 1), (410, [1.0, None, 0.0], 1), (420, [float("nan")] * 5, 2), (430, [float("inf")] * 5, 2), (None, [1.0] * 5, 1), (440, [1.0] * 5, None), (20, rows[3][1], 2), (450, rows[4][1], 77)]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id bigint, embedding array<double>, label int, key string, rank int")
    got = negatives.mine(frame, every=10)
    assert Counter(map(tuple, got.collect())) == negatives_by_hand(rows, 256, 10, 5, 3, 50, 95)


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mine(frame).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], frame.schema)
    assert negatives.mine(alone).count() == 0
    assert negatives.mine(alone.filter("vec_id = 51")).count() == 0


def test_anchors_are_never_broadcast(spark, monkeypatch):
    plans = []

    def kept(frame, purpose):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return stored(frame, purpose)

    monkeypatch.setattr(negatives, "stored", kept)
    rows = [(i, [float(i % 7), 1.0], i % 3) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    plans.append(negatives.mine(frame, every=10)._jdf.queryExecution().executedPlan().toString())
    met = [p for p in plans if "explode(" in p]
    assert len(met) == 2
    for text in met:
        assert "SortMergeJoin [block" in text and "HashJoin [block" not in text


def test_tiles_of_anchors_tell_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    kind = pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("norm", pa.float64()), ("angles", pa.binary())])
    matrix = rng.integers(-90, 90, (60, 6))
    norms, held = negatives.angles(matrix, negatives.choose_references(matrix))
    rows = [
        {"vec_id": i, "label": i % 3, "vector": matrix[i].astype("<i8").tobytes(), "norm": norms[i], "angles": held[i].tobytes()}
        for i in range(len(matrix))
    ]
    block, anchors = (negatives.Rows(pa.scalar(some, pa.list_(kind)), 6) for some in (rows, rows[::2]))
    windows = [[{"place": p, "score": 9000 * p} for p in range(-1, 4)]] * len(anchors.ids)
    found = []
    for tile in (1, 7, 128):
        monkeypatch.setattr(negatives, "TILE", tile)
        better = list(negatives.positives(anchors, block, 4))
        worse = [(i, w["place"], *more) for i, w, *more in negatives.negatives(anchors, windows, block, 3, 50, 95)]
        assert better and worse
        found.append((better, worse))
    assert found[0] == found[1] == found[2]


def test_score_bounds_hold():
    rng = np.random.default_rng(9)
    rows, others = rng.integers(-90, 90, (70, 6)), rng.integers(-90, 90, (40, 6))
    rows[3], others[5], others[6] = 0, rows[4] * 3, -rows[4]
    references = negatives.choose_references(rows)
    low, high = negatives.bounds(negatives.angles(rows, references), negatives.angles(others, references))
    exact = rows @ others.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < np.median(2 * np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(others, axis=1))
