"""Fill-in-middle, shards and product codes against direct definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import kdtree, middle, vafile

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "the cat sat on the mat", "the cat sat on the mat", "日本語 😀 x", "a <P> b", "ends with <", "<S", "é" * 900, "ab" * 20_000, "😀" * 70_000, "line\n\tline \x00 end", "<<P", "M>"]
SCHEMA = "doc_id long, text string, lang string, source string, n string, form int, output string, size string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", None)[i % 2], ("s", None, "é")[i % 3], "x", i, "y", "z", "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "null id text here", "en", "s", "x", 0, "y", "z", "w")], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Fill-in-middle


def plain_middle(doc_id, text):
    """The digest columns of a text, with Python's strings."""
    t, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return n, *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_middle_is_the_plain_definition(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for frame in (docs, odd, none):
        made = middle.fill_in_middle(frame, every=7)
        got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect())
        assert got == Counter((r["doc_id"], *plain_middle(r["doc_id"], r["text"])) for r in frame.select("doc_id", "text").collect())
        back = made.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t"))
        assert Counter(map(tuple, back.collect())) == Counter((r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect())


def test_middle_query_digests(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in middle.query(spark, DATA).collect():
        n, form, prefix, mid, out = plain_middle(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, prefix, mid, sha(out), sha(texts[r["doc_id"]]))


@pytest.mark.parametrize("every", [1, 3, 64])
def test_checkpoints_find_every_cut(every):
    rng = np.random.default_rng(every)
    for size in (0, 1, 2, 63, 64, 65, 500):
        t = "".join(rng.choice(list("ab é日😀\n "), size))
        data = t.encode()
        index = middle.Points(data, every)
        assert index.n == len(t) and len(index.bytes) == -(-len(t) // every)
        assert all(index.cut(u) == (len(t[:u].encode()), u) for u in range(len(t) + 2) if u <= len(t))
        for pattern in (r"\w+", r"(?s).", r"\s"):
            found = [m.start() for m in re.finditer(pattern, t)]
            words = middle.Matches(data, re.compile(pattern), every)
            assert words.n == len(found) and len(words.bytes) == -(-len(found) // every)
            ends = [0, *found[1:], len(t)] if found else [len(t)]
            assert [words.cut(u) for u in range(words.n + 1)] == [(len(t[:c].encode()), c) for c in ends]


def test_checkpoints_of_a_text_longer_than_a_block():
    t = "é😀a" * 40_000
    index = middle.Points(t.encode(), 1000)
    assert len(t.encode()) > 3 * middle.BLOCK and len(index.bytes) == 120
    assert all(index.cut(u) == (len(t[:u].encode()), u) for u in range(0, len(t) + 1, 997))


def test_middle_by_words_and_own_sentinels(spark, odd):
    made = middle.fill_in_middle(odd, unit=r"\S+", plain=0, spm=50, seed=9, sentinels=("{pre}", "{suf}", "{mid}"))
    back = made.select("doc_id", "form", middle.restored(F.col("output"), F.col("form"), ("{pre}", "{suf}", "{mid}")).alias("t")).collect()
    assert Counter((r["doc_id"], r["t"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert {"psm", "spm"} <= {r["form"] for r in back}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aa", "b", "c"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            middle.check_sentinels(bad)
    with pytest.raises(ValueError):
        middle.fill_in_middle(odd, unit="x*")


# Shards


def plain_split(units, dims, shards):
    """Leaf of each (bytes, tie, dims...) by sorting, one node after another."""
    out = [0] * len(units)
    ranges = [max(1, max(u[2 + d] for u in units) - min(u[2 + d] for u in units)) for d in range(dims)]

    def cut(rows, first, n):
        if n == 1 or not rows:
            for i in rows:
                out[i] = first
            return
        widths = [(max(units[i][2 + d] for i in rows) - min(units[i][2 + d] for i in rows)) / ranges[d] for d in range(dims)]
        d = widths.index(max(widths))
        by_key = defaultdict(list)
        for i in rows:
            by_key[units[i][2 + d], units[i][1]].append(i)
        want = max(1, sum(units[i][0] for i in rows) * (n // 2) // n)
        left, right, weight = [], [], 0
        for k in sorted(by_key):
            w = sum(units[i][0] for i in by_key[k])
            if weight + w < want or (weight < want and 2 * (want - weight) > w):
                left += by_key[k]
            else:
                right += by_key[k]
            weight += w
        cut(left, first, n // 2)
        cut(right, first + n // 2, n - n // 2)

    cut(list(range(len(units))), 0, shards)
    return out


@pytest.mark.parametrize(("shards", "seed"), [(2, 0), (5, 1), (24, 2)])
def test_tree_is_that_of_sorted_rows(spark, shards, seed):
    rng = np.random.default_rng(seed)
    n = 400
    units = [(int(rng.integers(1, 500)), int(rng.integers(1 << 40)) if i % 5 else 7, int(rng.integers(4)), int(rng.integers(3)) * 1000, int(i % 50)) for i in range(n)]
    frame = spark.createDataFrame([(i, *u) for i, u in enumerate(units)], "i long, bytes long, tie long, a long, b long, c long")
    got = {r["i"]: r["shard"] for r in kdtree.kd_split(frame, ["a", "b", "c"], shards, error=0.0, bins=64).collect()}
    assert [got[i] for i in range(n)] == plain_split(units, 3, shards)


def shard_facts(frame, made):
    """Rows are those of the frame, sizes and checksums theirs, slots gapless."""
    body = lambda t: (t or "").encode()
    rows = made.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len(body(r["text"])) + 8, zlib.crc32(body(r["text"]))) for r in frame.select("doc_id", "text").collect())
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, sizes


def test_shards_are_nearly_equal_and_keep_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, sizes = shard_facts(docs, kdtree.shard_documents(docs, shards=8))
    largest = max(r["size"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 7  # a cut splits one group at most
    by_bytes = kdtree.shard_documents(docs, target_bytes=sum(sizes.values()) // 3)
    assert len(shard_facts(docs, by_bytes)[1]) == 4


def test_shards_of_odd_hot_and_empty_tables(spark, odd, none):
    rows, sizes = shard_facts(odd, kdtree.shard_documents(odd, shards=3))
    assert set(sizes) <= {0, 1, 2}
    assert kdtree.shard_documents(none, shards=3).count() == 0
    # A text and a row that hold more than a third of all rows each.
    hot = [(i, "the same words", "en", "s") for i in range(3000)] + [(7, "x", None, "t")] * 3000 + [(10_000 + i, f"text {i} " * (i % 9), "de", f"s{i % 5}") for i in range(2000)]
    frame = spark.createDataFrame(hot, "doc_id long, text string, lang string, source string").repartition(8)
    rows, sizes = shard_facts(frame, kdtree.shard_documents(frame, shards=6))
    assert len(sizes) == 6 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_slots_over_many_buckets_and_no_python(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SLOTS", 50)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = kdtree.shard_documents(docs, shards=4)
    shard_facts(docs, made)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Codes


def test_va_file_bounds_and_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-900, 900, (16, 8))
    entries[5] = entries[2]
    queries = np.concatenate([rng.integers(-2000, 2000, (500, 8)), entries, entries[:3] + 1])
    file = vafile.VAFile(entries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = file.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    which, far, refined = file.nearest(queries)
    assert (which == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert len(queries) <= refined < exact.size / 2


def plain_codes(rows, parts=8, entries=16, rounds=6, dim=16):
    """{(id, vector): (code, error)} and codebooks, by direct loops."""
    kept = [(i, tuple(int(np.floor(4096 * x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) <= 8192 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = dim // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v in kept[:entries]] for p in range(parts)]
    nearest = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), j) for j, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v in kept:
                of[nearest(part(v, p), books[p])[1]].append(part(v, p))
            for j, xs in of.items():
                books[p][j] = tuple(sum(c) // len(xs) for c in zip(*xs))
    found = [(i, *zip(*[nearest(part(v, p), books[p]) for p in range(parts)])) for i, v in kept]
    return Counter((i, tuple(codes), sum(far)) for i, far, codes in found), books


def test_codes_are_those_of_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 16))]) for i in range(120)]
    odd = [(3, None), (500, [1.0] * 15 + [None]), (501, [float("nan")] * 16), (502, [float("inf")] + [0.0] * 15), (503, [1.0] * 8), (504, []), (505, [9e30] + [0.0] * 15), (None, [0.5] * 16), vectors[4], vectors[4], (4, [0.25] * 16)]
    rows = [(i, v, (1, 2, None)[n % 3], "x", 3) for n, (i, v) in enumerate(vectors + odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    want, books = plain_codes([r[:2] for r in rows])
    fitted = vafile.fit(frame)
    assert fitted.tolist() == [[list(e) for e in b] for b in books]
    codes = vafile.encode(frame, fitted, keep=("label",))
    got = codes.collect()
    assert Counter((r["vec_id"], tuple(r["code"]), r["error"]) for r in got) == want
    sums = Counter()
    for r in got:
        sums[r["label"]] += r["error"]
    for most in (vafile.LABELS, 0):  # broadcast, and under salted keys
        monkeypatch.setattr(vafile, "LABELS", most)
        told = vafile.with_label_error(codes).collect()
        assert len(told) == len(got) and all(r["label_error"] == sums[r["label"]] for r in told)
    back = codes.where("vec_id = 7").select(vafile.decoded(F.col("code"), fitted).alias("v"), "code").first()
    assert back["v"] == [x for p, e in enumerate(back["code"]) for x in fitted[p][e].tolist()]


def test_codes_of_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(i, [float(i)] * 8) for i in range(3)], "vec_id long, embedding array<double>")
    books = vafile.fit(frame)
    assert books.shape == (8, 3, 1) and [r["error"] for r in vafile.encode(frame, books).collect()] == [0, 0, 0]
    assert vafile.fit(frame.limit(0)) is None and vafile.fit(frame.select("vec_id", F.slice("embedding", 1, 7).alias("embedding"))) is None
    assert vafile.encode(frame.limit(0), books).count() == 0
