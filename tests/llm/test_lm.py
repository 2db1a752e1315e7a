"""Language-model scores against counts in dictionaries, and the sequences below them."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import lm
from clickloom.llm.elias_fano import Monotone, from_buffer, packed, to_bytes
from clickloom.llm.queries import QUERIES

from .test_corpus import docs, none, odd  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


class Brute:
    """Witten-Bell n-grams in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count, self.after = order, Counter(), defaultdict(Counter)
        for text in texts:
            t = tokens(text)
            self.count.update(t)
            padded = ["<s>", *t]
            for k in range(2, order + 1):
                for i in range(k - 1, len(padded)):
                    self.after[tuple(padded[i - k + 1 : i])][padded[i]] += 1
        self.n, self.v = sum(self.count.values()), len(self.count)

    def p(self, context, word):
        if not self.n:
            return 1.0
        p = (self.count[word] + self.v / (self.v + 1)) / (self.n + self.v)
        for k in range(1, self.order):
            h = tuple(context[-k:])
            if len(h) == k and h in self.after:
                c, t = sum(self.after[h].values()), len(self.after[h])
                p = (self.after[h][word] + t * p) / (c + t)
        return p

    def score(self, text):
        padded = ["<s>", *tokens(text)]
        return sum(math.log10(self.p(padded[max(0, i - self.order + 1) : i], padded[i])) for i in range(1, len(padded)))

    def base(self, text):
        return sum(math.log10((self.count[t] + 1) / (self.n + self.v + 1)) for t in tokens(text))


@pytest.mark.parametrize("order, block", [(2, 300), (3, 200), (4, 1500), (1, 1 << 20), (2, 1 << 20)])
def test_against_dictionaries(docs, odd, order, block):  # noqa: F811
    for table in (docs.filter("doc_id % 3 = 0"), odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        want = Brute([t for i, t in rows if not held(i)], order)
        got = lm.held_out_scores(table, order, block).collect()
        key = lambda r: (r[0] is not None, r[0] or 0, *map(lambda x: round(x, 6), r[1:]))
        found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
        right = sorted(((i, len(tokens(t)), sum(x in want.count for x in tokens(t)), want.base(t), want.score(t)) for i, t in rows), key=key)
        assert len(found) == len(right) and all(r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == want.n for r in got)
        for a, b in zip(found, right):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)
            assert abs(a[4] - b[4]) <= a[1] * 0.002 * order  # 16-bit logarithms


def test_query_learns_triples(spark, docs):  # noqa: F811
    """The query's scores are those of three levels, in which words stand as relative successors."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = Brute([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for r in QUERIES["op12_lm_scores"](spark, SF).filter("doc_id % 5 = 0").collect():
        assert abs(r["score"] - model.score(texts[r["doc_id"]])) <= r["n_tokens"] * 0.006


def test_searches_in_uneven_chunks():
    """Searches agree with a set where many numbers share a high part, and where few do."""
    rng = np.random.default_rng(5)
    for parts in ((np.arange(127), [10**12]), (rng.integers(0, 300, 200), rng.integers(0, 10**9, 700)), (rng.integers(0, 10**15, 3000),)):
        values = np.unique(np.concatenate(parts))
        asked = np.unique(np.concatenate([values, values + 1, values - 1, rng.integers(0, values[-1] + 2, 500)]))
        places = {int(x): i for i, x in enumerate(values)}
        assert Monotone(packed(values)).find(asked).tolist() == [places.get(int(x), -1) for x in asked]


def test_query(spark, docs):  # noqa: F811
    rows = QUERIES["op12_lm_scores"](spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held and len({r["train_tokens"] for r in rows}) == 1
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(0 <= r["n_known"] <= r["n_tokens"] and r["score"] <= 0 for r in rows)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "a b d", "b a", "c c c c", "", "a b c d e f g"]
    trie = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), 3, 5)
    for context in ("", "a", "a b", "zz", "c c", "zz a", "A\tB"):
        total = 0
        for w in ["a", "b", "c", "d", "e", "f", "g", "", "never"]:
            keys, sizes = lm.text_keys([f"{context} {w}"], trie.seed)
            count, p = lm.probabilities(trie, keys, sizes)
            total += p[-2] if w else p[-1]
        assert abs(total - 1) < 0.01


def test_keys_of_words(monkeypatch):
    texts = ["", "a b", " \n", "x" * 300 + " y", "naïve  東京\ta", "Q" * 300, "a " * 50, "", "b" * 256, "b" * 257]

    def same_everywhere():
        keys, sizes = lm.text_keys(texts, 5)
        assert sizes.tolist() == [len(tokens(t)) for t in texts]
        by_word = defaultdict(set)
        for word, key in zip((w for t in texts for w in tokens(t)), keys.tolist(), strict=True):
            by_word[word].add(key)
        assert all(len(x) == 1 for x in by_word.values()) and len({*map(min, by_word.values())}) == len(by_word)
        return keys.tolist()

    first = same_everywhere()
    monkeypatch.setattr(lm, "STEP_BYTES", 7)
    assert same_everywhere() == first
    assert lm.text_keys(texts, 6)[0].tolist() != first


def test_nothing_to_learn(none, odd):  # noqa: F811
    assert not lm.held_out_scores(none).collect()
    rows = lm.scored(odd, lm.learn(none)).collect()
    assert len(rows) == odd.count() and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in rows)


def test_a_very_common_context_is_parted(spark):
    """One word before a third of all words and one text for many rows: no file holds much more than its share."""
    texts = [" ".join(f"the w{i}x{j}" for j in range(20)) for i in range(100)] + ["the same words again and again"] * 300
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    trie = lm.learn(table, 3, 250)
    want = Brute(texts, 3)
    for level, k in zip(trie.levels[1:], (2, 3)):
        sizes = np.diff(level.entries)
        assert sizes.sum() == sum(len(x) for h, x in want.after.items() if len(h) == k - 1) and sizes.max() <= 400 and len(sizes) >= 5
    ids = np.array([0, trie.v])
    assert (np.diff(trie.levels[0].pointers(np.arange(trie.v + 1))) >= 0).all() and len(trie.levels[0].pointers(ids)) == 2
    got = {r["score"] for r in lm.scored(table.withColumn("doc_id", F.lit(1)).filter("text like 'the same%'"), trie).collect()}
    assert len(got) == 1 and abs(got.pop() - want.score(texts[-1])) < 0.05


def test_files_take_a_final_name_only(tmp_path):
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        lm.save(f"{folder}/x/keys-1", packed(np.arange(9)))
        lm.save(f"{folder}/x/keys-1", packed(np.arange(9)))
        assert [p.name for p in (tmp_path / "x").iterdir()] == ["keys-1"]
        assert Monotone(lm.load(f"{folder}/x/keys-1")).values().tolist() == list(range(9))


@pytest.mark.parametrize("n, most", [(0, 10), (1, 1 << 62), (127, 1 << 62), (128, 1 << 20), (1000, 1 << 40), (5000, 6000), (3000, 1 << 62)])
def test_sequences(n, most):
    draw = np.random.default_rng(n)
    values = np.unique(draw.integers(0, most, n))
    m = Monotone(from_buffer(np.frombuffer(b"".join(to_bytes(packed(values))), dtype=np.uint8)))
    assert (m.values() == values).all() and (m.at(np.arange(len(values))[::-1]) == values[::-1]).all()
    keys = np.unique(np.concatenate([values, values + 1, values - 1, [0, most]]))
    place = {v: i for i, v in enumerate(values.tolist())}
    assert m.find(keys).tolist() == [place.get(k, -1) for k in keys.tolist()]
    again = np.sort(draw.integers(0, 30, n))
    assert (Monotone(packed(again)).values() == again).all()
    clusters = np.unique(np.concatenate([np.arange(300), (1 << 61) + np.arange(n) * 3]))
    assert (Monotone(packed(clusters)).find(clusters) == np.arange(len(clusters))).all()


def test_work_of_a_lookup_does_not_grow_with_the_blocks():
    """Places of many blocks are dealt to them once, not compared with every block."""

    def seconds(blocks):
        ends = np.arange(blocks + 1) * (1_000_000 // blocks)
        level = lm.Level("", np.arange(blocks), ends[:-1], ends, ends)
        places, least = np.arange(0, 1_000_000, 2), math.inf
        for _ in range(3):
            began = time.process_time()
            assert (level.take(places, lambda b, i: i + ends[b]) == places).all()
            least = min(least, time.process_time() - began)
        return least

    assert seconds(1000) < 10 * seconds(10) + 0.03


def test_words_of_all_lengths_by_eight_bytes():
    """Words that agree in their first bytes, or but for their length, have keys of their own wherever they stand."""
    words = ["a" * n for n in range(1, 260)] + ["a" * n + "b" for n in range(259)] + ["é" * n for n in range(1, 130)]
    keys = lm.text_keys([" ".join(words)], 3)[0].tolist()
    assert len({*keys}) == len(words) + 1
    assert [lm.text_keys([f"x\n{w}"], 3)[0].tolist()[1] for w in words] == keys[:-1]
