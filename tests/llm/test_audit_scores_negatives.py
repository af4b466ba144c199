"""Operators 11 to 13 against brute force, and on awkward tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import filter_audit, hard_negatives, kneser_ney

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)


def words(text):
    return WORD.findall(text or "")


# Operator 11

VECTORS = "label int, vec_id bigint, embedding array<float>, v string, key string"


def brute_negatives(rows):
    held = {}
    for label, vid, x, *_ in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vid is not None and vid % 7 == 0:
            label = (label + 1) % 10
        held[(vid, label, tuple(math.floor(256 * float(np.float32(c))) for c in x))] = None
    held = list(held)
    late = lambda v: (v is None, v)
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in held:
        if a[0] is None or a[0] % 100:
            continue
        others = sorted(((-score(a, b), late(b[0]), b) for b in held if b is not a), key=lambda t: t[:2])
        for s, _, p in [t for t in others if t[2][1] == a[1]][:5]:
            fit = [t for t in others if t[2][1] != a[1] and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(a[0], p[0], k + 1, n[0], -s, -t) for k, (t, _, n) in enumerate(fit)]
    return sorted(out, key=repr)


def told(df):
    return sorted([tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=repr)


def vectors(n, width, labels=4, spread=0.3, seed=1):
    g = np.random.default_rng(seed)
    centres = g.normal(0, spread, (labels, width))
    return [(int(k % labels), int(k), [float(x) for x in np.float32(centres[k % labels] * 0.6 + g.normal(0, spread, width))], None, "x") for k in range(n)]


def test_negatives_match_brute_force(spark):
    rows = vectors(1500, 6)
    rows += [(2, 1500 + k, rows[300][2], "v", None) for k in range(40)]  # ties, of another label than some
    df = spark.createDataFrame(rows, VECTORS)
    got = told(hard_negatives.mine(df))
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_on_awkward_rows(spark):
    rows = vectors(220, 3, labels=3)
    rows += [rows[100], rows[100], (0, 100, [0.5, 0.1, 0.2], None, None)]  # repeated, and an id twice
    rows += [(None, 300, [1.0, 1.0, 1.0], None, None), (1, 400, None, None, None), (1, 500, [1.0, None, 1.0], None, None), (1, 600, [float("nan"), 1.0, 1.0], None, None), (1, 700, [float("inf"), 1.0, 1.0], None, None)]
    rows += [(1, None, [0.4, 0.4, 0.4], None, None), (2, 800, [], None, None), (1, 900, [0.3], None, None), (0, -100, [-0.3, -0.2, 0.4], None, None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert told(hard_negatives.mine(df)) == brute_negatives(rows)


def test_negatives_of_large_components_and_of_nothing(spark):
    big = [(k % 2, 10 * k, [1e6 * (1 + k % 3), 2e6 + k, 1.0], None, None) for k in range(40)]
    df = spark.createDataFrame(big, VECTORS)
    assert told(hard_negatives.mine(df)) == brute_negatives(big)
    assert hard_negatives.mine(df.filter("vec_id % 100 <> 0")).count() == 0
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_str_tiles_are_whole_and_tight():
    g = np.random.default_rng(3)
    rows = g.normal(size=(5000, 2))
    by = hard_negatives.str_order(rows, 64)
    assert sorted(by.tolist()) == list(range(5000))
    low, high = hard_negatives.boxes(rows[by], rows[by], 64)
    loose_low, loose_high = hard_negatives.boxes(rows, rows, 64)
    assert (high - low).prod(axis=1).mean() < 0.1 * (loose_high - loose_low).prod(axis=1).mean()


def test_search_prunes_boxes(monkeypatch):
    """Of 4,096 rows on a line, a search that wants the best five opens few leaves."""
    v = np.stack([np.arange(4096.0), np.ones(4096)], axis=1)
    tree = hard_negatives.Tree(np.arange(4096), np.zeros(4096, np.int64), v)
    opened = []
    labels = tree.labels

    class Watched:
        def __getitem__(self, at):
            opened.append(at)
            return labels[at]

    tree.labels = Watched()
    anchor = np.array([1.0, 0.0])
    bounds = [(u[0], d[0]) for u, d in tree.bounds(anchor[None])]
    best = tree.search(anchor, 0, True, None, [[-float("inf"), float("inf")], [100, 200]], 5, bounds)
    assert [i for _, i in best[0]] == [4095, 4094, 4093, 4092, 4091] and [i for _, i in best[1]] == [200, 199, 198, 197, 196]
    assert len(opened) <= 3


# Operator 12

DOCS = "n bigint, doc_id bigint, text string, source string, mask string, good string, part int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def brute_audit(docs, labels):
    quality, toxic = {x[0] for x in labels if x[1] == 1}, {x[0] for x in labels if x[2] == 1}
    quality.discard(None)
    toxic.discard(None)
    least = {}
    for _, i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        w = words(t)
        return {
            f
            for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and t in least and i > least[t]), strict=True)
            if bad
        }

    parts = defaultdict(list)
    for _, i, t, s, *_ in docs:
        parts[s or ""].append((fails(i, t or ""), i in quality, i in toxic))
    out = {}
    for part, held in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                all_f = sum(f in d[0] for d in held)
                out[part, "".join(order), step] = [len(left), len(here), all_f - len(here), sum(d[0] == {f} for d in held), sum(d[1] for d in here), sum(d[2] for d in here)]
                sums[f] += len(here)
        for key in out:
            if key[0] == part:
                out[key].append(sums[key[1][key[2] - 1]])
    return out


def test_audit_matches_brute_force(spark):
    base = ["", None, "A B C", "plain words " * 150, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " 100%", "UP " * 300, " ".join(f"é{k} #" for k in range(220)), "x" * 100_000]
    docs = [(0, k, rng.choice(base), rng.choice([None, "", "a", "b", "c"]), "m", "g", k) for k in range(160)]
    docs += [docs[5], docs[5], (0, None, base[4], "a", None, None, None), (0, None, base[4], "a", None, None, None), (0, 3, base[3], "d", None, None, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "p") for k in range(0, 160, 2)] + [(4, 1, 0, None), (4, 0, 1, None), (None, 1, 1, None)]
    rows = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    want = brute_audit(docs, labels)
    assert len(rows) == len(want) == 600 * 5
    for r in rows:
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] == want[r["part"], r["filter_order"], r["step"]]


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(0, 1, "a b", None, None, None, None)], DOCS), labels)
    assert one.count() == 600 and {r["part"] for r in one.collect()} == {""}


def test_gray_walk_equals_plain_sums():
    counts = np.random.default_rng(2).integers(0, 9, (3, 32, 2))
    states = filter_audit.gray_states(counts)
    for subset in range(32):
        assert (states[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


# Operator 13

TEXTS = "doc_id bigint, text string, hashes string, train string, n_tokens int"


BEGIN, END = " begin", " end"  # no words


class Plain:
    """The model with dictionaries and strings."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            x = [BEGIN] * (order - 1) + t + [END]
            top.update(tuple(x[k : k + order]) for k in range(len(x) - order + 1))
        self.raw = Counter(w for t in texts for w in [*t, END])
        self.tokens, self.words = sum(self.raw.values()), len(self.raw)
        self.counts = {order: top}
        for level in range(order, 1, -1):
            low = Counter()
            for g, c in self.counts[level].items():
                low[g[1:]] += c if level > 2 and g[1] == BEGIN else 1
            self.counts[level - 1] = low
        self.discounts, self.follow = {}, {}
        for level, grams in self.counts.items():
            n = [sum(c == k for c in grams.values()) for k in (1, 2, 3, 4)]
            self.discounts[level] = kneser_ney.discounts_of(n)
            f = self.follow[level] = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in grams.items():
                f[g[:-1]][0] += c
                f[g[:-1]][min(c, 3)] += 1

    def p(self, gram):
        level = len(gram)
        if level == 0:
            return 1 / (self.words + 1)
        t, *n = self.follow[level].get(gram[:-1], [0, 0, 0, 0])
        low = self.p(gram[1:])
        if not t:
            return low
        c, d = self.counts[level][gram], self.discounts[level]
        return max(c - ([0, *d][min(c, 3)]), 0) / t + sum(x * y for x, y in zip(d, n, strict=True)) / t * low

    def score(self, t):
        x = [BEGIN] * (self.order - 1) + t + [END]
        logs = [math.log10(self.p(tuple(x[k : k + self.order]))) for k in range(len(t) + 1)]
        base = sum(math.log10((self.raw[w] + 0.5) / (self.tokens + 0.5 * (self.words + 1))) for w in [*t, END])
        return len(t) + 1, sum(self.raw[w] > 0 for w in [*t, END]), self.tokens, base, sum(logs)


def lowered(text):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in words(text)]


def sentences(n):
    names = [f"w{k}é" if k % 5 else f"W{k}" for k in range(60)]
    out = []
    for _ in range(n):
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(0, 40)):
            text.append(names[at])
            at = (3 * at + rng.choice([1, 1, 1, 2, 7, rng.randrange(60)])) % 60
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_brute_force(spark, order):
    texts = [*sentences(120), None, "", " \t", "<s> </s> É É", "only here", "x " * 3000, "w1é \x0b w2é w3é"]
    rows = [(k, t, "h", "t", 0) for k, t in enumerate(texts)] + [(7, texts[7], None, None, None), (None, "w1é w2é", None, None, None)]
    is_train = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1
    plain = Plain([lowered(t) for i, t, *_ in rows if is_train(i)], order)
    want = sorted(((i is None, i or 0, not is_train(i)), plain.score(lowered(t))) for i, t, *_ in rows)
    out = kneser_ney.train_and_score(spark.createDataFrame(rows, TEXTS).repartition(4), order).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"]), (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in out)
    assert len(got) == len(rows) and any(k[2] for k, _ in got)
    for (k, g), (w, h) in zip(got, want, strict=True):
        assert k == w and g[:3] == h[:3] and g[3:] == pytest.approx(h[3:], rel=1e-9)
    for context in [("w1é",), ("unseen",), (BEGIN,)]:  # probabilities of all words and the unknown class sum to one
        gram = (BEGIN,) * (order - 2) + context
        assert sum(plain.p((*gram, w)) for w in [*plain.raw, "no such word"]) == pytest.approx(1)


def test_words_are_hashed_alike_in_any_slice(monkeypatch):
    texts = ["", " Ab c\x0bAB", "C", "\tab ab", "é É \x00 \x00x", "x" * 300, " "]
    batch = pa.record_batch([pa.array(texts)], names=["text"]).slice(1)
    whole, n = kneser_ney.hashed_words(batch.column(0))
    told = [w for t in texts for w in lowered(t)]
    assert n.tolist() == [len(words(t)) for t in texts[1:]] and len(set(whole.tolist())) == len(set(told))
    named = dict(zip(told, whole.tolist(), strict=True))
    assert [named[w] for w in told] == whole.tolist()
    monkeypatch.setattr(kneser_ney, "SLICE_TOKENS", 3)
    monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 4)
    cut = list(kneser_ney.slices(iter([batch])))
    assert len(cut) > 3 and sum(rows.num_rows for rows, _, _ in cut) == 6
    assert [h for _, x, _ in cut for h in x.tolist() if h != 2] == whole.tolist() and np.concatenate([s for *_, s in cut]).tolist() == (n + 1).tolist()


def test_scores_without_training_rows(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    out = kneser_ney.train_and_score(spark.createDataFrame([(i, "a b", None, None, None) for i in held], TEXTS)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out] == [(3, 0, 0, 0.0, 0.0)] * len(held)
    assert kneser_ney.train_and_score(spark.createDataFrame([], TEXTS)).count() == 0


def test_stored_shards_read_back(tmp_path):
    columns = [np.arange(5, dtype=np.uint64), np.array([1, 2, 255, 3, 4]), np.array([1, 1 << 40, 0, 0, 0]), np.zeros(5, np.int64)]
    kneser_ney.store(str(tmp_path / "1-0"), columns)
    back = kneser_ney.mapped(str(tmp_path / "1-0"))
    assert all((a == b).all() for a, b in zip(columns, back, strict=True)) and [c.itemsize for c in back] == [8, 1, 8, 1]
    assert [p.name for p in tmp_path.iterdir()] == ["1-0"]


def test_a_search_leaves_no_shard_mapped(tmp_path):
    """A worker's memory holds the shard it reads, not all shards that it ever read."""
    keys = np.sort(np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64))
    for s in range(4):
        mine = keys[kneser_ney.shard(keys, 2) == s]
        kneser_ney.store(f"{tmp_path}/2-{s}", [mine, np.arange(len(mine))])
    place, found = kneser_ney.search(str(tmp_path), "2", 2, keys, 1)
    assert (place >= 0).all() and (found[0] == place).all()
    with open("/proc/self/maps") as f:
        assert str(tmp_path) not in f.read()
