"""The corpus operators against brute force, round trips and held-out accuracy, and their defined cases."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import Row, functions as F

from clickloom.llm import bpe, components, fingerprint, html_text, jaccard, langid, licenses, packing, pii, pretokens, topk, url_filter
from clickloom.llm.common import BATCH_BYTES, BATCH_BYTES_KEY
from clickloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, salt int, component string"
ODD = ["", None, " \n\t ", "word", "two words", "a" * 30_000, "x y z " * 4000, "two words", "naïve café 東京 \U0001f600", "1 2 3", "\n\n", "٣٤"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, null ids, and columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, None, None, "k", i, "c") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "no id at all", None, "s", 3, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, docs):
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(odd, none, docs):
    model = langid.fit(docs)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 9, 10, 11)} == dict.fromkeys((0, 1, 2, 9, 10, 11), "und")
    assert not langid.identify(none, model).collect() and langid.fit(none) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    kept = langid.accepted_documents(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id = 0").count() == 0
    one = langid.predict(model, ["der die das und nicht", "der die das und nicht"])
    assert one[0][0] == one[0][1] and one[1][0] == one[1][1]


def test_language_rare_labels(spark):
    """A label of one row is learned beside twenty of three hundred, and bounds hold."""
    rows = [(i, f"{'abcdefghijklmnopqrst'[i % 20] * 6} {i} word", f"l{i % 20:02d}") for i in range(6000)]
    for rare in range(4):
        some = next(j for j in range(10_000 + 100 * rare, 20_000) if zlib.crc32(str(j).encode()) % 5)
        model = langid.fit(spark.createDataFrame([*rows, (some, "zzz zzz zzz", "rare")], "doc_id long, text string, lang string"), most_rows=210)
        assert "rare" in model.labels and len(model.labels) == 21


# --- 2 ---------------------------------------------------------------------------------------------------------------


def brute_edits(rows):
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    texts = [r["text"] or "" for r in ordered]
    for r, text, after in zip(ordered, texts, texts[1:] + texts[:1]):
        yield r["doc_id"], len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()


@pytest.mark.parametrize("size", [16 << 20, 4000])
def test_fingerprint_edits(spark, docs, odd, size):
    for table in (docs, odd):
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprints(table, partition_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(brute_edits(table.collect()), key=str)


def test_fingerprint_likeness(spark, docs, none):
    rows = fingerprint.fingerprints(docs).collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.15
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    same = {}
    for r in rows:
        same.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(len({tuple(sorted(texts[i].split("\n"))) for i in ids}) == 1 for ids in same.values())
    assert not fingerprint.fingerprints(none).collect()


def test_fingerprint_likeness_against_jaccard():
    """Texts of different words that share a part: the estimate against the exact similarity of their shingles."""
    draw = random.Random(3)
    errors = []
    for trial in range(60):
        words = [f"w{trial}x{i}" for i in range(600)]
        share = draw.randrange(0, 301)
        a, b = words[:300], words[:share] + words[300 : 600 - share]
        sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a, b)]
        x, y = (fingerprint.sums([" ".join(w)]) for w in (a, b))
        errors.append(float(fingerprint.likeness(x, y)[0]) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert np.abs(errors).max() < 0.2 and np.abs(errors).mean() < 0.06 and abs(np.mean(errors)) < 0.03


def test_fingerprint_of_equal_lines(spark):
    draw = random.Random(4)
    rows = []
    for group in range(20):
        lines = [f"line {group} {i} " + "w " * draw.randrange(5) for i in range(12)] + [f"twice {group}"] * 2
        for copy in range(3):
            draw.shuffle(lines)
            rows.append((10 * group + copy, "\n".join(lines)))
        rows.append((10 * group + 3, "\n".join(lines[:-1])))
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for group in range(20):
        assert len({got[10 * group + copy] for copy in range(3)}) == 1 and got[10 * group + 3] != got[10 * group]
    assert len(set(got.values())) == 40


def test_fingerprint_algebra():
    whole, a, b = (fingerprint.sums([t]) for t in ("one two three four\nx y\n\nz", "one two three four", "x y\n\nz"))
    both = fingerprint.combine(a, b)
    assert fingerprint.encoded(both) == fingerprint.encoded(whole)
    assert fingerprint.encoded(fingerprint.combine(whole, b, -1)) == fingerprint.encoded(a)
    assert fingerprint.encoded(fingerprint.sums(["x\ny"])) == fingerprint.encoded(fingerprint.sums(["y\nx"])) != fingerprint.encoded(fingerprint.sums(["x\ny\n"]))


# --- 3 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, n, p, q):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    at = {}
    ids = [r["doc_id"] for r in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    seen = set()
    for group in at.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen and ids[a] is not None and ids[b] is not None:
                    seen.add((a, b))
                    if q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                        x, y = find(ids[a]), find(ids[b])
                        root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets)), key=str)


@pytest.mark.parametrize("n, p, q", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(spark, docs, odd, none, n, p, q):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 1000
    for size in (3, 5, 9, 12, 20, 35, 60, 120, 400):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(25):
                text = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    text[rng.randrange(size)] = rng.choice(words)
                rows.append(Row(doc_id=i, text=" ".join(text)))
                i += 1
    for copies, size, most in ((150, 130, 6), (100, 60, 3)):  # large groups in which many copies link with few others
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, most)):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append(Row(doc_id=i, text=" ".join(text)))
            i += 1
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for table in (docs, odd, made):
        got = [tuple(r) for r in jaccard.similarity_components(table, n, p, q).collect()]
        assert sorted(got, key=str) == brute_components(table.collect(), n, p, q)
    assert not jaccard.similarity_components(none, n, p, q).collect()


@pytest.mark.parametrize("changed", [{}, {"DIRECT": 0.02}, {"DIRECT": 0.02, "SMALL": 2}, {"LARGE": 4}, {"BROADCAST_ROWS": 0, "GROUP": 3}, {"ONE_TURN": 0}], ids=str)
def test_jaccard_routes(spark, monkeypatch, changed):
    """Every route (direct or further rounds, small or led buckets, broadcast or shuffle) gives the same components."""
    for name, value in changed.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(4)
    rows = []
    for size, copies in ((40, 60), (90, 60), (14, 30)):
        base = [f"w{rng.randrange(900)}" for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 18))):
                text[rng.randrange(size)] = f"w{rng.randrange(900)}"
            rows.append(Row(doc_id=len(rows), text=" ".join(text)))
    got = [tuple(r) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80, 100).collect()]
    assert sorted(got, key=str) == brute_components(rows, 3, 80, 100)


def test_jaccard_large_group(spark):
    """A group of near copies far beyond any bound of a bucket, and a larger one of exact copies."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for _ in range(700):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"x{rng.randrange(5000)}"
        rows.append(Row(doc_id=len(rows), text=" ".join(text)))
    rows += [Row(doc_id=i, text="the very same text of some words") for i in range(2000, 3500)]
    got = [tuple(r) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90, 100).collect()]
    near, same = [r for r in rows if r["doc_id"] < 2000], [r for r in rows if r["doc_id"] >= 2000]
    assert sorted(got, key=str) == sorted(brute_components(near, 3, 90, 100) + [(r["doc_id"], 5, 2000) for r in same], key=str)


@pytest.mark.parametrize("copies", [8, 120])
def test_jaccard_common_passage(spark, monkeypatch, copies):
    """Texts that share half of their words meet in many buckets, but are not compared all with all."""
    rng = random.Random(9)
    common = [f"w{i}" for i in range(100)]
    rows = [Row(doc_id=i, text=" ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(100)])) for i in range(copies)]
    rows += [Row(doc_id=1000 + i, text=f"{rows[i]['text']} and more") for i in (0, 1)]
    asked, verified = [], jaccard.verified

    def counted(pairs, *others):
        asked.append(pairs.filter("not deep").count())
        return verified(pairs, *others)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = [tuple(r) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)
    assert sum(asked) <= 4


def test_jaccard_buckets_by_sketches(spark, monkeypatch):
    """Texts that only share a passage meet in buckets of middle size; their sketches rule all pairs out before any text is read again."""
    rng = random.Random(12)
    common = [f"w{i}" for i in range(100)]
    rows = [Row(doc_id=i, text=" ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(100)])) for i in range(40)]
    rows += [Row(doc_id=1000 + i, text=f"{rows[i]['text']} and more") for i in (0, 1)]
    asked, verified = [], jaccard.verified

    def counted(pairs, *others):
        asked.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = [tuple(r) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)
    assert sum(asked) <= 4


def test_jaccard_long_texts_by_sketches(spark, monkeypatch):
    """Long texts that only share a passage may differ in more places than BITS; wider sketches rule their pairs out before any text is read again."""
    rng = random.Random(14)
    common = [f"w{i}" for i in range(1500)]
    rows = [Row(doc_id=i, text=" ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(1200 + 60 * i)])) for i in range(12)]
    rows += [Row(doc_id=1000 + i, text=f"{rows[i]['text']} and more") for i in (0, 1)]
    asked, verified = [], jaccard.verified

    def counted(pairs, *others):
        asked.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = [tuple(r) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)
    assert sum(asked) <= 2


def test_jaccard_wide_sketches(spark):
    """Parity bits differ in at most as many places as the sets, also where one sketch is twice as wide as the other; far sets are told apart."""
    rng = np.random.default_rng(15)
    x = rng.integers(0, 2**63, 5000).astype(np.uint64)
    pairs = []
    for apart, m1, m2 in ((300, 4096, 8192), (300, 4096, 4096), (3000, 4096, 8192), (3000, 4096, 4096), (3000, 512, 4096)):
        y = np.concatenate([x[apart:], rng.integers(0, 2**63, 100).astype(np.uint64)])
        pairs.append((*[jaccard.parity(s) + (jaccard.parity(s, m) if m > jaccard.BITS else []) for s, m in ((x, m1), (y, m2))], apart + 100))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x array<long>, y array<long>, apart int")
    fits = lambda most: [r[0] for r in df.orderBy("i").select(jaccard.wide_sketches_fit(F.col("x"), F.col("y"), most)).collect()]
    assert fits(F.col("apart")) == [True] * 5
    assert fits(F.lit(1000)) == [True, True, False, False, True]


def test_jaccard_keys_in_turns(spark, monkeypatch):
    """A turn reads the columns of its own keys only, and of the common keys only a turn's are sent to all executors at once."""
    rng = random.Random(16)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(90)] + [(100 + i, " ".join(f"y{j}" for j in range(200 + i))) for i in range(9)], "doc_id long, text string")
    sketches = jaccard.written(jaccard.sketch(docs, 3, 80, 100), "sketches")
    plan = jaccard.keys_in(sketches, 5, 16, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert {c for c in range(16) if re.search(rf"keys[12]_{c}\b", plan)} == {5}
    sent, small = [], jaccard.small
    monkeypatch.setattr(jaccard, "ONE_TURN", 0)
    monkeypatch.setattr(jaccard, "small", lambda df: sent.append(df.count()) or small(df))
    buckets, members = ([sorted(map(tuple, t.collect())) for t in tables] for tables in jaccard.met_keys(sketches))
    assert len(sent) == 16 and sum(sent) > 100 and max(sent) < sum(sent) / 4
    monkeypatch.setattr(jaccard, "ONE_TURN", 10**9)
    assert [sorted(sum(x, [])) for x in (buckets, members)] == [sorted(map(tuple, t[0].collect())) for t in jaccard.met_keys(sketches)]


def test_jaccard_leaves_largest_buckets(spark):
    """A document leaves as many of its largest buckets as it can do without; one that can do without none stays in all."""
    members = [(key, n, doc, 1, slack) for doc, slack in ((1, 2), (2, 1), (3, -1), (4, 9)) for key, n in ((10, 3), (11, 70), (12, 5), (13, 70))]
    left = jaccard.staying(spark.createDataFrame(members, "key long, n long, doc long, part int, slack int"))
    assert sorted(map(tuple, left.collect())) == [(10, 1), (10, 2), (10, 3), (11, 2), (11, 3), (12, 1), (12, 2), (12, 3), (13, 3)]


def test_jaccard_shared_leads(spark):
    """Buckets of one group share a lead, also if it is in few of them; a bucket of strangers that one member of the group is in keeps its own."""
    wide = spark.createDataFrame([(1, d) for d in range(1, 9)] + [(2, d) for d in range(3, 9)] + [(3, 2), (3, 3), (3, 5)] + [(4, d) for d in (8, 20, 21, 22)], "key long, doc long")
    leads = spark.createDataFrame([(1, 1, 90), (2, 4, 50), (3, 3, 50), (4, 20, 4)], "key long, lead long, company long")
    assert sorted(map(tuple, jaccard.shared_leads(wide, leads).collect())) == [(1, 1), (2, 1), (3, 1), (4, 20)]


def test_jaccard_turns_join_nothing(spark, monkeypatch):
    """The documents whose keys are counted are picked once, in a written table, however many turns there are."""
    seen, met_keys = [], jaccard.met_keys
    monkeypatch.setattr(jaccard, "met_keys", lambda one: seen.append(one._jdf.queryExecution().optimizedPlan().toString()) or met_keys(one))
    monkeypatch.setattr(jaccard, "ONE_TURN", 0)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40 + i // 2))) for i in range(6)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.similarity_components(docs, 3, 80, 100).collect()) == [0] * 6
    assert len(seen) == 1 and "Join" not in seen[0]


def test_jaccard_sketches_pass_no_driver(spark):
    """The sketches of the sets are joined by shuffles, and of the tables that go to all executors wide ones have fewer rows."""
    rng = random.Random(13)
    texts = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate([*texts, texts[0] + " more"])], "doc_id long, text string")
    sizes = jaccard.sketch(docs, 3, 80, 100).select("doc_id", "n_shingles", "bits").cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = jaccard.fitting(spark.createDataFrame([(0, i) for i in range(1, 7)], "a long, b long"), sizes, 80, 100)
        met = jaccard.met_within(spark.createDataFrame([(1, i) for i in range(7)], "key long, doc long"), sizes, 80, 100)
        for found in (pairs, met):
            assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
            assert [tuple(r) for r in found.collect()] == [(0, 6)]
        rows = jaccard.BROADCAST_ROWS // 2
        sent = [jaccard.small(spark.range(rows).select(*[F.col("id").alias(f"c{i}") for i in range(n)]))._jdf.queryExecution().analyzed().toString() for n in (2, 5)]
        assert ["broadcast" in x for x in sent] == [True, False]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sizes.unpersist()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_texts_differ(spark, n):
    """Texts that collide under polynomial hashing modulo 2^64 are told apart."""
    a, b = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"x y {a}"), (4, f"x y {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.similarity_components(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    assert len({r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}) == 4


@pytest.mark.parametrize("second", ["the same", "another set"])
def test_jaccard_repeated_ids(spark, second):
    """Buckets {1, 2, 2, 4} and {1, 3, 3, 4} have other members, though the hashes of 2 and of 3 cancel."""
    base = [f"w{i}" for i in range(60)]
    text = {i: " ".join([*base, f"x{i}"]) for i in (1, 2, 3, 4)}
    keys = {1: [11, 12], 2: [11], 3: [12], 4: [11, 12]}
    rows = [(i, i, text[i], keys[i]) for i in (1, 2, 3, 4)] + [(i, i if second == "the same" else -i, text[i], keys[i]) for i in (2, 3)]
    docs = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, text string")
    sketches = spark.createDataFrame([(i, 59, sig, sig, k, -1, [], -1) for i, sig, _, k in rows], jaccard.SKETCH)
    found = jaccard.links(docs, sketches, spark.createDataFrame([], "doc_id long"), 3, 90, 100).collect()
    assert {x for r in found for x in (r["a"], r["b"])} == {1, 2, 3, 4}


def test_jaccard_components_of_repeated_rows(spark):
    rng = random.Random(8)
    rows, i = [], 0
    for size in (12, 40, 90):
        for _ in range(6):
            base = [f"w{rng.randrange(500)}" for _ in range(size)]
            for _ in range(12):
                for _ in range(rng.choice((1, 1, 2, 3))):
                    text = list(base)
                    for _ in range(rng.randint(0, max(1, size // 25))):
                        text[rng.randrange(size)] = f"w{rng.randrange(500)}"
                    rows += [Row(doc_id=i, text=" ".join(text))] * rng.choice((1, 2))
                i += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard.similarity_components(table, 3, 80, 100).collect()]
    assert sorted(got, key=str) == brute_components(rows, 3, 80, 100)


def test_one_of_each_group(spark, odd):
    kept = jaccard.one_of_each_group(odd, 5, 90, 100)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(4) == 1 and 7 not in ids and ids.count(None) == 2
    assert {0, 1, 2, 10} <= set(ids)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


# --- 4 ---------------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        sought = phrase.split()
        for i in range(len(words) - len(sought) + 1):
            if words[i : i + len(sought)] == sought:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(docs, odd, none):
    for table in (docs, odd):
        texts = sorted((r["doc_id"], r["text"] or "") for r in table.filter("doc_id is not null").collect())
        rows = sorted(licenses.license_scan(table).filter("doc_id is not null").collect(), key=lambda r: r["doc_id"])
        for (i, text), r in zip(texts, rows):
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(text), i
            assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert not licenses.license_scan(none).collect()


def test_fuzzy_licenses():
    text = "Copyright. Undr the MIT-licence; cc by nc, cc by nc by nc; GNU general  public licens v3, ceci n'est pas"
    found = licenses.scan(text)
    spans = {(s["label"], text[s["start"] : s["end"]]) for s in found[7]}
    assert ("mit", "Undr the MIT-licence") in spans and ("gpl", "GNU general  public licens") in spans
    assert found[1] == 2 and licenses.scan("permission to speak, all rights of the people")[5] == ""


@pytest.mark.parametrize(
    "text, labels",
    [
        ("under the bsd license", "bsd"),
        ("under the gpl license", ""),
        ("under the isc license", "isc"),
        ("under the new license", ""),
        ("under the site license", ""),
        ("under the submit license", ""),
        ("apache license version 1", ""),
        ("creative commons attribution commercial", ""),
        ("under the site license, undr teh mit license", "mit"),
        ("undr the mit licence", "mit"),
        ("under themit license", "mit"),
        ("under the mitlicense", "mit"),
        ("apach licence version 2.0", "apache-2"),
        ("apache license version two", "apache-2"),
        ("apache license version2", "apache-2"),
        ("creative commons attribution non commercial", "cc-by-nc"),
        ("gnv general public license", "gpl"),
        ("gnu leser general public license", "lgpl"),
    ],
)
def test_telling_words(text, labels):
    for whole in (text, f"one two {text} three four"):
        assert licenses.scan(whole)[5] == labels


@pytest.mark.parametrize("gap", [" ", " or ", " version "])
def test_notices_in_a_row(gap):
    text = f"mozila public license{gap}mozilla public license{gap}mozilla public licence"
    found = licenses.scan(text)
    assert [(text[s["start"] : s["end"]], s["edits"]) for s in found[7]] == [("mozila public license", 1), ("mozilla public license", 0), ("mozilla public licence", 1)]
    assert found[6] == 1.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_notices(words):
    """label -> (edits, first word, end word) of every run of words within the edits of a notice that has its telling words."""
    found = {}
    for (text, label, tell), notice in zip(licenses.NOTICES, licenses.compiled()[0]):
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if abs(len(run) - len(text)) > notice.edits:
                    continue
                edits = distance(text, run)
                if edits <= notice.edits and all(t.search(run.encode()) for t in notice.telling):
                    found.setdefault(label, []).append((edits, i, j))
    return found


def test_licenses_against_edit_distance():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            text = list(rng.choice(licenses.NOTICES)[0])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text))
                kind = rng.randrange(3)
                text[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(letters)]
            parts += ["".join(text), rng.choice(["", "or any later", "see the file", "x"])]
        text = " ".join(" ".join(parts).split())
        words = text.split()
        want, found = brute_notices(words), licenses.scan(text)
        base = set(found[4].split(",")) - {""}
        assert set(found[5].split(",")) - {""} == set(want) | base, text
        for label in want:
            least = min(want[label])[0]
            assert min(s["edits"] for s in found[7] if s["label"] == label) == least, (text, label)
        for s in found[7]:
            edits = [e for e, i, j in want[s["label"]] if " ".join(words[i:j]) == text[s["start"] : s["end"]]]
            assert edits and s["edits"] >= min(edits), (text, s)


@pytest.mark.parametrize(
    "text, label",
    [("Apache License 2.0", "apache-2"), ("Apache License, Version 2.0", "apache-2"), ("GNU GPL v3", "gpl"), ("bsd-3-clause", "bsd"), ("SPDX-License-Identifier: MIT", "mit"),
     ("SPDX-License-Identifier: Apache-2.0", "apache-2"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"), ("SPDX-License-Identifier: LGPL-2.1", "lgpl"), ("creative commons attribution 4.0", "cc-by")],
)
def test_names_of_licenses(text, label):
    assert licenses.scan(f"see {text} here")[5] == label and licenses.scan(text)[5] == label


def test_many_notices_in_one_text_are_linear():
    import time

    took = []
    for n in (2000, 16_000):
        began = time.process_time()
        found = licenses.scan("under the mit license and gnu general public license " * n)
        took.append(time.process_time() - began)
        assert found[1] == n and len(found[7]) >= 2 * n
    assert took[1] < 24 * took[0]


def test_ties_of_labels():
    """Overlapping matches of one label give one span, those of two labels one each."""
    spans = licenses.scan("licensed under the apache license version 2 and under the mit license")[7]
    assert [s["label"] for s in spans] == ["apache-2", "mit"] and all(s["edits"] == 0 for s in spans)


def test_licenses_repeated_and_long(spark):
    text = "word " * 200_000 + "under the mit license " + "word " * 200_000 + "mozila public license"
    rows = [(1, text), (1, text), (2, "apache license version 2 " * 3)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["n_base"], r["first_word"], r["labels"]) for r in got if r["doc_id"] == 1] == [(1, 200_000, "mit,mpl")] * 2
    assert [(r["n_base"], r["first_word"], r["last_word"], len(r["spans"])) for r in got if r["doc_id"] == 2] == [(3, 0, 8, 3)]


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_pii(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


TRICKY = [
    "a@b.c@d.e x.@y-z.q a@b a@b. ..@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3.4444", "4111-1111 1111 1111 4111  1111 4111111111111111111111",
    "+1 (415) 555-0000 +123 +12345678 +1.2.3.4.5.6.7.8.9 +12345678901234567", "é+49 30 1234567é user.name+tag@sub.example.co.uk, 10.0.0.1:80",
]


def test_pii_base(docs, odd, none):
    for text in TRICKY:
        assert [(k, *s) for k in pii.KINDS for s in pii.plain(text)[k]] == brute_pii(text), text
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in pii.personal_data(table).collect():
            want = brute_pii(texts[r["doc_id"]]) if r["doc_id"] is not None else []
            spans = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            if r["doc_id"] is not None:
                assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
                assert set(spans.split(",")) <= set(r["spans"].split(",")) | {""}
    assert not pii.personal_data(none).collect()


@pytest.mark.parametrize(
    "text, span",
    [
        ("write to jane [at] site (dot) org now", "jane [at] site (dot) org"),
        ("write to jane at site dot co dot uk now", "jane at site dot co dot uk"),
        ("call plus four one five five five five zero one two three now", "plus four one five five five five zero one two three"),
        ("jоhn@exаmple.com!", "jоhn@exаmple.com"),
        ("host 10 dot 0 dot 0 dot 1 is up", "10 dot 0 dot 0 dot 1"),
        ("host 10[.]0[.]0[.]1 is up", "10[.]0[.]0[.]1"),
        ("host 10 . 0 . 0 . 1, up", "10 . 0 . 0 . 1"),
        ("host 192.168 dot 0.1!", "192.168 dot 0.1"),
        ("to jane_at_site_dot_org now", "jane_at_site_dot_org"),
        ("to jane@site[.]org now", "jane@site[.]org"),
        ("to j a n e @site.org now", "j a n e @site.org"),
        ("pay four 1 one one one one one one one one one one one one one one ok", "four 1 one one one one one one one one one one one one one one"),
    ],
)
def test_pii_disguises(text, span):
    _, every = pii.find(text)
    assert [text[a:b] for k in pii.KINDS for a, b in every[k]] == [span]


def test_pii_leaves_clean_text_alone(odd):
    for text in ("we met at noon dot", "one or two of them, one at a time", "look at this. Dot your i", ""):
        assert pii.redact(text) == text
    for text in ("1 dot 2 dot 3 dot 4 dot 5", "1 . 2 . 3 . 4 . 5", "version 1 . 2 . 3 . 4", "300 dot 1 dot 1 dot 1", "one dot two dot"):
        assert pii.redact(text) == text
    out = pii.redacted(odd)
    assert out.columns == odd.columns and sorted(out.collect(), key=str) == sorted(odd.collect(), key=str)
    assert pii.redact("a@b.cc and 10.0.0.1") == "<EMAIL> and <IP>"


@pytest.mark.parametrize("piece", ["1 dot ", "1 . ", "1.1 dot ", "a at b dot ", "a@b dot ", "x_dot_", "[at] (dot) ", "one two ", "j @ ", "a b c "])
def test_pii_long_disguises_are_linear(piece):
    import time

    took = []
    for n in (100_000, 1_000_000):
        text = piece * (n // len(piece)) + " @ "
        began = time.process_time()
        pii.find(text)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5 and took[1] < 20


def test_pii_repeated_rows_and_spans(spark):
    texts = ["mail a@b.cc or jane [at] site (dot) org", "host 10 dot 0 dot 0 dot 1", "", None, "x " * 300_000 + "a@b.cc"]
    rows = [(i % 3, t) for i, t in enumerate(texts * 3)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, pii.span_list(pii.find(t or "")[1])) for i, t in rows]
    assert sorted((r["doc_id"], r["spans"]) for r in got) == sorted(want)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_pages(spark):
    import html

    for r in html_text.page_texts(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; & more", "plain <text> & more"),
        ("<p>unclosed <b>bold<br>next<p>second", "unclosed bold next second"),
        ("a<!-- never closed", "a"),
        ("<body><div class='page'><div><a href=x>Home</a> <a href=y>About</a></div><div><h2>Title</h2><p>Hello <b>w</b>orld, a long text of many words.<p>And more text.</div><div class='comment-list'><p>first!</div></div>", "Title Hello world, a long text of many words. And more text."),
        ("<main><header><h1>T</h1></header><p>x</p><form>f</form><aside>s</aside><div id=cookie-notice>c</div><footer>f</footer></main>", "x"),
        ("<article><header><h1>T</h1></header><p>one</p><section class=comments><p>c</p></section></article><div class=sidebar>s</div>", "T one"),
        ("<script>if (a < b) document.write('<p>no</p>')</script><p>yes</p>", "yes"),
    ],
)
def test_page_cases(spark, page, want):
    rows = html_text.page_texts(spark.createDataFrame([(1, None, page, "x")], "page_id long, url string, html string, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, None, want, len(want))]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<ul><li class="share">Share<li>Item</ul><p>the article', "Item the article"),
        ('<body><ul><li>Item<li class="share">Share</ul><p>the article</body>', "Item the article"),
        ('<article><p class="ad">buy<p>the article</article>', "the article"),
        ('<div><p class="ad">buy <b>now<div>the article</div></div>', "the article"),
        ('<p class="ad">' + "<b>" * 12 + "buy<p>the article", "the article"),
        ('<article><p>one <span class="ad">buy</p><p>two</article>', "one two"),
        ('<table><tr class="ad"><td>buy<tr><td>the article</table>', "the article"),
        ('<table><thead class="banner"><tr><th>buy<tbody><tr><td>the article</table>', "the article"),
        ("<html><head><title>T</title><meta charset=utf-8><body><p>the article", "the article"),
        ("<head><title>T</title> the article", "the article"),
        ('<span class="ad"><div>buy</span>the article', "the article"),
    ],
)
def test_page_implied_ends(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "attributes, beside",
    [
        ('href="/hidden-gems"', False),
        ('title="The hidden cost"', False),
        ("title='role = menu'", False),
        ('data-hidden="false"', False),
        ('data-class="ad"', False),
        ('href="/q?id=search"', False),
        ("href=/q?a=1&id=ad", False),
        ('title="the hidden cost', False),
        ("title= hidden", False),
        ("hidden", True),
        ('HIDDEN=""', True),
        ("title=x hidden", True),
        ('title="a>b"hidden', True),
        ('href="/x"class="ad"', True),
        ("class = 'big ad'", True),
        ("id=search", True),
        ('aria-hidden="true"', True),
        ("style='color:red; display: none'", True),
    ],
)
def test_page_marks(attributes, beside):
    assert html_text.is_beside("p", " " + attributes, False) == beside


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div><p class="ad">Buy<p>More</div><article><h1>T</h1><p>long article text of many words<p>and more words</article>', "T long article text of many words and more words"),
        ('<div class="content no-sidebar"><p>The article is here with many words.<p>And here.</div>', "The article is here with many words. And here."),
        ('<nav><a href=x>a</a></nav><article class="post hentry category-social"><p>The article is here with many words.<p>And here.</article>', "The article is here with many words. And here."),
        ('<div id="long-form"><p>The article is here with many words.<p>And here.</div><div class=sidebar><p>Buy this and that</div>', "The article is here with many words. And here."),
        ('<form action=x><div><p>The article is here with many words.<p>And here.</div></form>', "The article is here with many words. And here."),
        ('<div class="comment-list">' + "<p>I do not agree with a word of it.</p>" * 5 + "</div><div><p>The article is here with many words.<p>And here.</div>", "The article is here with many words. And here."),
        ("<body><article><p>First article with its text.<p>More of it here.</article><article><p>Second article with text.<p>And more text.</article></body>", "First article with its text. More of it here. Second article with text. And more text."),
        ("<body><h1>Headline</h1><div><p>The article is here with many words.<p>And here with some more.</div><div>short</div></body>", "Headline The article is here with many words. And here with some more."),
        ("<body><div>" + "<a href=x>link text</a> " * 30 + "</div><div><p>The article is here.<p>And <a href=y>here</a> it ends.</div></body>", "The article is here. And here it ends."),
    ],
)
def test_page_density_chooses(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("name", ["related-work", "search-results", "banner-story", "share-article", "login-guide", "social-studies", "menu-planning"])
def test_page_marks_that_name_the_article(name):
    page = f'<body><h1>Headline</h1><div class="{name}"><p>The article is here with many words of its own.<p>And here with some more of them.</div><div>the end</div></body>'
    assert "The article is here with many words of its own. And here with some more of them." in html_text.main_text(page)


@pytest.mark.parametrize("page, want", [
    ('<p data-x="' + "a>" * 5000 + '">the article', "the article"),
    ("<p data-x='" + 'a>"' * 5000 + "' class=x>the article", "the article"),
    ('<p title="it"s>the article</p>', "the article"),
    ('<p title="open>the article', "the article"),
    ("the article <b", "the article <b"),
])
def test_page_long_and_odd_attributes(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<i><div>" * 20_000 + "</i>" * 20_000 + "the article", "<div>" * 5000 + "<li>x</li>" * 20_000, "<a x='>' " * 20_000, "<a " * 50_000, "</b>" * 50_000 + "<p>" * 20_000])
def test_page_odd_nesting_is_linear(page):
    import time

    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 5


def brute_measure(page):
    """Densities and sums of a well-formed page's blocks in page order, straight from their definition."""
    import math
    import xml.etree.ElementTree as T

    root = T.fromstring(page)

    def text(e, skip=()):
        return sum(len("".join(x.split())) for x in [e.text or "", *(c.tail or "" for c in e)]) + sum(text(c) for c in e if c not in skip)

    def blocks(e):  # the blocks right below, through inline tags
        return [y for c in e for y in ([c] if is_block(c) else blocks(c))]

    def is_block(e):
        return e.tag not in html_text.INLINE or any(is_block(c) for c in e)

    def numbers(e):
        inner = list(e.iter())[1:]
        return text(e), sum(is_block(x) or x.tag == "a" for x in inner), sum(text(x) for x in e.iter("a")), len(list(e.iter("a")))

    c, t, lc, lt = numbers(root)
    share = lc / max(1, c)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        t, lt, l1 = max(1, t), max(1, lt), max(1, lc)
        return c / t * max(0.0, math.log(c / l1 * t / lt) / math.log(math.log(c / max(1, c - lc) * l1 + share * c + math.e)))

    out = []
    for e in root.iter():
        if is_block(e):
            below = blocks(e)
            own = [text(e) - sum(text(b) for b in below), sum(1 for x in e.iter("a") if not any(x in b.iter() for b in below) and x is not e)]
            links = sum(text(x) for x in e.iter("a") if not any(x in b.iter() for b in below))
            total = sum(density(*numbers(b)) for b in below) + density(own[0], own[1], links, own[1]) if below else 0.0
            out.append((e.tag, density(*numbers(e)), total))
    return out


def test_page_measure():
    rng = random.Random(9)

    def make(depth):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.choice(["text", "p", "div", "a", "b", "section", "ul"] if depth else ["text", "p", "a", "b"])
            words = " ".join("word"[: rng.randint(1, 4)] for _ in range(rng.randint(1, 12)))
            if kind == "text":
                parts.append(words)
            elif kind in ("p", "a", "b") or not depth:
                parts.append(f"<{kind}>{words}{' <i>x y</i> z' if rng.random() < 0.3 else ''}</{kind}>")
            elif kind == "ul":
                parts.append("<ul>" + "".join(f"<li>{make(0) if rng.random() < 0.2 else words}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            else:
                parts.append(f"<{kind}>{make(depth - 1)}</{kind}>")
        return " ".join(parts)

    for _ in range(300):
        page = f"<body>{make(3)}</body>"
        nodes = html_text.prune(html_text.parse(page)[1])
        html_text.measure(nodes)
        got = [(x.tag, x.density, x.total) for x in nodes[1:] if x.block]
        want = brute_measure(page)
        assert [x[0] for x in got] == [x[0] for x in want]
        assert np.allclose([x[1:] for x in got], [x[1:] for x in want]), page


def test_page_repeated_and_long(spark):
    page = "<article>" + "<p>some words of the article</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, 5), (1, "u", page, 5), (2, None, "<div>" * 30_000 + "deep", 5)]
    got = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert [r["n_chars"] for r in got if r["page_id"] == 1] == [20_000 * 26 - 1] * 2
    assert [r["text"] for r in got if r["page_id"] == 2] == ["deep"]


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    vecs = [(r["id"], [int(np.floor(64 * float(x))) for x in r["v"]]) for r in rows if r["id"] is not None and r["v"] is not None and all(x is not None and np.isfinite(x) for x in r["v"])]
    out = []
    for i, q in vecs:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vecs if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(i, [0.5, 0.5, -0.5, 0.0, 0.0, 0.0]) for i in range(150, 260)]
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (380, [1.0, 2.0]), (381, [3.0, 1.0]), (400, []), (401, []), (None, [0.0] * 6), (420, [1e6] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    v = topk.whole_vectors(table)
    got = [tuple(r) for r in topk.top_k(v, v.filter("id % 20 = 0"), 20).collect()]
    assert sorted(got) == brute_top([{"id": i, "v": x} for i, x in rows], 20)
    none = topk.whole_vectors(table.limit(0))
    assert not topk.top_k(none, none, 20).collect()


def test_top_k_repeated_rows(spark):
    """Equal rows count once; a common vector does not hide other ids; vectors that share an id stand for themselves."""
    rng = np.random.default_rng(4)
    common = [0.25, 0.5, 0.75]
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [rows[20]] * 3 + [(20, common)] * 25 + [(41, common), (43, common)] + [(60, common)] * 2 + [(7, [0.5, 0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = topk.whole_vectors(table)
    got = [tuple(r) for r in topk.top_k(v, v.filter("id % 20 = 0"), 20).collect()]
    once = sorted({(i, tuple(x)) for i, x in rows})
    assert sorted(got) == brute_top([{"id": i, "v": x} for i, x in once], 20)


@pytest.mark.parametrize("scale, dims", [(1, 1), (3, 8), (1e6, 5), (1e12, 4), (2.0**61, 3)])
def test_bounds_and_reads(scale, dims):
    """No exact score exceeds its bound, and few exact vectors are read of a large block."""
    rng = np.random.default_rng(dims)
    x = np.floor(rng.normal(size=(3000, dims)) * scale)
    q = np.floor(rng.normal(size=(40, dims)) * scale)
    cells, low, width = topk.approximated(x)
    bound = topk.upper_bounds(cells.astype(np.float32), low, width, q)
    exact = [[sum(int(a) * int(b) for a, b in zip(u, w)) for w in x[:300]] for u in q]
    assert all(b >= e for got, want in zip(bound, exact) for b, e in zip(got, want))
    search = topk.Search(np.full(40, -1), q, 5)
    for a in range(0, 3000, 1000):
        search.block(np.arange(a, a + 1000), *topk.approximated(x[a : a + 1000]), topk.smallest(x[a : a + 1000]))
    for i, (ids, scores) in enumerate(search.best):
        every = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], w)), j) for j, w in enumerate(x))[:5]
        assert [(-int(s), int(v)) for v, s in zip(ids, scores)] == every
    assert search.read < 0.2 * 40 * 3000 or scale == 1


# --- 8 and 9 ---------------------------------------------------------------------------------------------------------

TIKTOKEN, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def test_split_and_encode():
    import regex
    import tiktoken

    pattern, rng = regex.compile(P.PATTERN), random.Random(5)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(TIKTOKEN).ranks, special_tokens={})
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "1", "٣", "a", "é", "日", "!", "?", "_", "\u00a0", "\u3000", "\u0301", "\U0001f600", "I've", "'S", "\r\n", "\x85", "\u200b", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for t in texts:
        code, edges = pretokens.split(t)
        assert [t[a:b] for a, b in zip(edges[:-1], edges[1:])] == pattern.findall(t)
    texts += ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdeth") for _ in range(40_000)), "=" * 10_000, "".join(rng.choice("аб日本") for _ in range(3000))]
    assert bpe.encode(texts, TIKTOKEN) == [whole.encode_ordinary(t) for t in texts]
    words = bpe.vocabulary(TIKTOKEN)
    long = [list(range(256)) * 200]
    given = [words.single[b] for b in long[0]]
    assert words._merge_many([-2, *given, -2]) == words._merge([-2, *given, -2])


def test_token_digests(docs, odd, none):
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(TIKTOKEN).ranks, special_tokens={})
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.filter("doc_id is not null").collect()}
        for r in bpe.token_digests(table, TIKTOKEN).filter("doc_id is not null").collect():
            ids = np.array(whole.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert not bpe.token_digests(none, TIKTOKEN).collect()
    back = bpe.decoded_documents(bpe.encoded_documents(odd, TIKTOKEN), TIKTOKEN)
    assert sorted((r["text"] for r in back.collect())) == sorted((r["text"] or "") for r in odd.collect())


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    for table in (docs, odd):
        texts = sorted(((r["doc_id"], r["text"] or "") for r in table.collect() if r["doc_id"] is not None))
        rows = packing.packed(table, JSON).collect()
        pieces = {}
        for r in rows:
            pieces.setdefault(r["doc_id"], []).append(r)
        for doc_id, text in texts:
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
            own = sorted(pieces[doc_id], key=lambda r: r["start"])
            if doc_id == 4 and table is odd:
                own = own[::2]  # a repeated row
            at = 0
            for r in own:
                assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
                at += r["length"]
            assert at == len(ids)
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append(r)
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048
        if table is docs:
            total = sum(r["length"] for r in rows)
            assert total / (2048 * len(sequences)) > 0.98
    assert not packing.packed(none, JSON).collect()


def test_windows():
    rng = random.Random(2)
    for n in (0, 1, 2, 50, 400):
        lengths = [rng.randint(1, 512) for _ in range(n)]
        found = packing.windows(lengths)
        assert sorted(i for w in found for i in w) == list(range(n))
        sums = [sum(lengths[i] for i in w) for w in found]
        assert all(s <= 2048 for s in sums) and (n < 50 or max(sums) - min(sums) < 64)


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?y#z", "x://net", "x://net/", "https://subnet/", "http://example.com/de/1", "http://org/fr/", "http://b.org/fr?x", "http://e.com#f/de/"]
    want = [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "", None, "allow"), ("net", "/", "net/", "block"), ("subnet", "/", None, "allow"),
            ("example.com", "/de/1", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow"), ("b.org", "/fr", None, "allow"), ("e.com", "", None, "allow")]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in url_filter.judge(pages).collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
    assert not url_filter.judge(pages.limit(0)).collect()


def test_url_aliases(spark):
    link = "<html><head><link href='{}' rel=\"canonical\"></head>".format
    rows = [
        (1, "http://a.com/x", link("https://evil.net/y")),  # an alias of a blocked address
        (2, "http://b.com/x", "<meta http-equiv=refresh content='0; url=/z'>"),
        (3, "http://b.com/z", link("http://a.com/x#part")),  # over two edges
        (4, "http://c.com/x", link("http://evil.net/q")),
        (5, "http://c.com/y", link("http://c.com/x")),
        (6, "http://c.org/fr/1", link("../../x")),  # its own rule; a relative link
        (7, "http://d.com/x", "<p>no links, though canonical"),
        (8, "http://e.com/x", link("http://evil.net/r")),
        (9, "http://e.org/fr/x", link("http://evil.net/r")),  # an explicit allow among the aliases
        (10, "http://f.com/x", "<!-- " + link("http://evil.net/t") + " --><script>'" + link("http://evil.net/t") + "'</script>"),
        (11, "http://g.com/a/b/x", link("../y")),
        (12, "http://g.com/a/./c/../y", link("http://evil.net/u")),
        (12, "http://g.com/a/./c/../y", link("http://evil.net/u")),  # a repeated row
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "block"}
    assert url_filter.judge(pages).count() == len(rows)
    more = spark.createDataFrame([("http://d.com/x", "http://evil.net/s"), (None, "x")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, more).collect()}[7] == "block"


def test_url_aliases_against_reachability(spark):
    """Chains, stars and cycles of canonical links and refreshes over allowed and blocked hosts, against recursive SQL."""
    import duckdb
    import pandas as pd

    from clickloom.llm.queries import ORACLE_SQL

    draw = random.Random(5)
    hosts = ["a.com", "B.com", "example.com", "evil.net", "example.net", "c.org", "d.io", "e.io"]
    url = lambda i: f"http://{hosts[i % len(hosts)]}/{('de', 'en', 'fr', 'x')[i // 8 % 4]}/{i}" + "?q=1" * (i % 7 == 0)
    rows = []
    for i in range(600):
        goal = draw.choice([None, None, i + 1, i + 40, draw.randrange(600)])
        kind = draw.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'])
        rows.append((i, url(i), "<p>x" if goal is None else "<head>" + kind.format(url(goal) + "#top" * (i % 5 == 0)) + "</head>"))
    rows += [rows[7], (601, None, rows[3][2]), (602, "no host", rows[3][2]), (603, "http://f.io", None)]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql(ORACLE_SQL["op10_url_filter"]).fetchall(), key=str)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got.collect()), key=str) == want
    inherited = [r for r in want if r[3] is None and r[4] == "block"]
    assert len(inherited) > 30 and any(r[3] is None and r[4] == "allow" for r in want)


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    import corpus_pipeline as C

    at, sizes = docs, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.schema.names == docs.schema.names, name
        at = spark.createDataFrame(at.collect(), docs.schema)
        sizes.append(at.count())
    groups = brute_components(spark.read.parquet(f"{SF}/documents.parquet").collect(), C.WORDS, C.P, C.Q)
    assert sizes[1] >= 0.99 * sizes[0] and sizes[2] == sizes[3]
    if sizes[1] == sizes[0]:
        assert {r["doc_id"] for r in at.select("doc_id").collect()} == {i for i, n, c in groups if c == i}
    assert not any(pii.plain(r["text"])["email"] for r in at.collect())
    out = C.run(spark, SF)
    assert out.agg(F.count_distinct("doc_id")).first()[0] == sizes[3]


def traced(steps):
    """MB that going through the steps takes at most, as Python and numpy see it."""
    tracemalloc.start()
    try:
        for _ in steps:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pipeline_worker_memory(spark, docs, monkeypatch):
    """What a worker takes beside its executor's JVM does not follow the batch, and the classifier's table starts no workers of another kind."""
    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("rows through Python workers"))
        model = langid.fit(docs)
    assert len(model.labels) > 1
    texts = [f"{i} einige words de un texte " * 80 for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    runs = []
    monkeypatch.setattr(langid, "tidied", lambda run: runs.append(run) or run)
    langid.accepted_documents(spark.createDataFrame([], "doc_id long, text string"), model)
    assert traced(runs[0](iter([batch]))) < 15
    cache = pretokens.IdCache(lambda pieces: [[0]] * len(pieces))
    pretokens.classes()
    assert traced(cache.batches(batch.column("text"))) < 48
    import corpus_pipeline as C

    for _, stage in C.STAGES[:3:2]:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
        stage(spark, docs, SF)
        assert int(spark.conf.get(BATCH_BYTES_KEY)) == C.BATCH
    spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
