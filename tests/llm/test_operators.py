"""Each operator against a brute-force version, and on awkward tables."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from dialoom.llm import chat, exact_dedup, html_wrappers, licenses, mixing, packing, prob_minhash, quality, secret_scan, token_ids
from dialoom.llm.components import components
from dialoom.llm.tokenizing import Encoder, public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, n_words string, cid string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(9000)
NEAR = prose(200).split()


def near(k):
    out = list(NEAR)
    out[k] = "changed"
    return " ".join(out)


TEXTS = [
    None, "", " \t\n", "one", "\x0bwide \u00a0 nbsp\u2003gap", LONG, LONG, LONG.replace(" ", "\n", 5), "line a\nline a\n\nline b\nline a", "x " * 300,
    'password = "hunter2hunter" token: abc secret=tok password=token: abcdefgh\nAKIA' + "A1" * 10 + " deadbeef" * 4 + " é " + "0f" * 16 + " API_KEY='q1W2e3R4'",
    "ghp_" + "a1B2" * 6 + " and more words to make this text pass the ten words", "It's <|endoftext|> <|startoftext|> 'S don't \U0001f600 ﬁ Σς ÀÉ  double\n\nlines\ttabs 12345 a_b --- é",
    " leading space", "trailing space ", "\nleading line", "trailing line\n", "Released under the MIT License.\nMore text.",
    *[near(k) for k in range(0, 200, 40)], *[prose(rng.randint(5, 120)) for _ in range(40)],
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4 if i % 3 else 0}", None if t is None else len(t), "x", "y", None, "z") for i, t in enumerate(TEXTS)]
    return [*out, out[10], out[30], (None, "no id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_empty_tables(spark, empty):
    assert mixing.taken_words(mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(empty).columns == empty.columns
    assert quality.judge(empty).count() == 0 and secret_scan.scan(empty).count() == 0
    assert exact_dedup.dedup_report(empty).count() == 0 and prob_minhash.near_report(empty).count() == 0
    assert licenses.scan(empty).count() == 0 and packing.packed(empty).count() == 0
    assert token_ids.read_all(token_ids.write_shards(empty)).count() == 0
    assert html_wrappers.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert chat.format_and_read(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: weights[i % 3] for i, k in enumerate(keys)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(keys, 0.0), set(keys)
    left = total
    while open_:
        all_w = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / all_w > cap * sizes[k]}
        if not over:
            for k in open_:
                target[k] = left * weight[k] / all_w
            break
        for k in over:
            target[k] = cap * sizes[k]
            left -= target[k]
        open_ -= over
    return target


def test_mix(docs, rows):
    out = mixing.taken_words(mixing.mix(docs)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target, taken = brute_targets(sizes), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 128 for s in sizes)
    again = mixing.taken_words(mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    got = Counter()
    for r in texts.collect():
        got[r["source"]] += len(words(r["text"]))
    assert got == taken


def test_mix_shards(spark):
    """Blocks lie in shards by their draws; another seed deals them otherwise, sums stay."""
    rows = [(i, prose(400 + i % 50), f"s{i % 3}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plans = [mixing.mix(docs, shard_slots=32, seed=k) for k in (20, 21)]
    shards = [Counter((r["shard"], r["skey"]) for r in p.slots.collect()) for p in plans]
    assert shards[0] != shards[1] and len({s for s, _ in shards[0]}) > 3
    drawn = [c for s in {s for s, _ in shards[0]} if (c := sum(n for (t, _), n in shards[0].items() if t == s))]
    assert max(drawn) <= 32
    out = mixing.taken_words(plans[0]).collect()
    held = mixing.shard_blocks(docs, plans[0]).collect()
    assert sum(len(words(r["text"])) for r in held) == sum(r["taken"] for r in out) and len(held) == sum(shards[0].values())
    assert any(r["first_shard"] != r["last_shard"] for r in out)


def test_permutation(spark):
    n = 1000
    x = mixing.permuted
    from pyspark.sql import functions as F

    out = [r[0] for r in spark.range(n).select(x(F.col("id"), F.lit(n), F.lit(7))).collect()]
    assert sorted(out) == list(range(n)) and out != list(range(n))


def brute_quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality(docs, rows):
    out = quality.judge(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert all(not (r["base_failed"] and r["kept"]) for r in out)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(map(str, (r["doc_id"] for r in kept.collect()))) == Counter(str(r["doc_id"]) for r in out if r["kept"])


def test_bad_host(spark):
    rows = [(i, "short", "bad") for i in range(400)] + [(1000, prose(50), "bad")] + [(2000 + i, prose(50), f"h{i % 20}") for i in range(400)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[1000]["host_rejected"] and not out[1000]["kept"] and out[2000]["kept"]


def test_junk_host_and_junk_document(spark):
    """Most of one host's pages are symbols: all its pages go; a lone junk page elsewhere goes alone."""
    junk = lambda i: " ".join(f"w{i}x{k}$$$#" for k in range(30))
    lines = "\n".join(["the same line of seven plain words here"] * 3 + [prose(60), prose(60)])
    rows = [(i, junk(i) if i % 3 else prose(60), "junk") for i in range(300)] + [(1000 + i, prose(60), f"h{i % 20}") for i in range(1000)]
    rows += [(5000, junk(1), "h1"), (5001, lines, "h2")]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(out[i]["kept"] for i in range(300)) and not out[0]["failed"] and out[0]["host_rejected"]
    assert all(out[1000 + i]["kept"] for i in range(1000)) and not out[5000]["kept"] and not out[5000]["host_rejected"] and out[5001]["kept"]


PATTERNS = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def brute_secrets(text):
    spans = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            if len(m[2 if kind == "assign" else 0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((m.start(), k, m.end(), kind))
    spans.sort()
    return [sum(s[3] == k for s in spans) for k in PATTERNS], hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()


def test_secrets(docs, rows):
    out = secret_scan.scan(docs).collect()
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out)
    assert got == Counter((r[0], *(b := brute_secrets(r[1]))[0], b[1]) for r in rows)
    by = {r["doc_id"]: r for r in out}
    assert by[11]["spans"].startswith("token:0:28") and by[10]["n_assign"] == 2 and by[10]["n_live"] > 0


def test_secret_ownership(spark):
    rows = [(i, "token=abcdef123456", f"s{i % 5}") for i in range(20)] + [(99, "token=zzzzzz999", "s1"), (100, "token=zzzzzz999", "s1")]
    out = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[3]["n_shared"] == 1 and out[3]["n_live"] == 0 and out[99]["n_live"] == 1 and out[3]["most_repositories"] == 20


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, rows):
    out = exact_dedup.dedup_report(docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(spaced(r[1]), []).append(r[0])
    assert len(out) == len(rows)
    for r in out:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[key] if i is not None]
        assert r["group_size"] == len(groups[key]) and r["keep_id"] == (min(ids) if ids else None)
    assert sum(r["kept"] for r in out) == len(groups)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_dedup_increments(spark):
    index = exact_dedup.DigestIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    exact_dedup.dedup_report(frame([(5, "a b"), (6, "c")]), index).collect()
    out = {r["doc_id"]: r for r in exact_dedup.dedup_report(frame([(1, "a  b"), (2, "d")]), index).collect()}
    assert out[1]["keep_id"] == 5 and not out[1]["kept"] and out[2]["kept"] and index.rows().count() == 3


def test_index_outlives_its_catalogue(spark, tmp_path):
    """A session whose catalogue does not know the table finds the index by its path, goes on with it and
    writes over nothing; dropping it deletes the files."""
    at = f"file://{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first = exact_dedup.DigestIndex(spark, at, 4)
    exact_dedup.dedup_report(frame([(1, "x y"), (2, "z")]), first).collect()
    files = {p for p in tmp_path.rglob("*.parquet")}
    spark.sql(f"DROP TABLE {first.name}")
    later = exact_dedup.DigestIndex(spark, at)
    out = {r["doc_id"]: r for r in exact_dedup.dedup_report(frame([(5, "x  y"), (6, "new")]), later).collect()}
    assert out[5]["keep_id"] == 1 and not out[5]["kept"] and out[6]["kept"] and later.buckets == 4
    assert files < set(tmp_path.rglob("*.parquet")) and {r["keep_id"] for r in later.rows().collect()} == {1, 2, 6}
    later.drop()
    assert not (tmp_path / "index").exists() and not exact_dedup.DigestIndex(spark, at).exists()
    with pytest.raises(ValueError, match="no index"):
        exact_dedup.DigestIndex(spark, at).rows()


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)"])
def test_dedup_of_ids_of_any_type(spark, kind):
    docs = spark.range(60).selectExpr(f"cast({'date_add(DATE' + repr('2020-01-01') + ', cast(id as int))' if kind == 'date' else 'id'} as {kind}) AS doc_id", "cast(id % 7 as string) AS text")
    out = exact_dedup.dedup_report(docs).collect()
    least = {r["text"]: r["m"] for r in docs.groupBy("text").agg(F.min("doc_id").alias("m")).collect()}
    assert len(out) == 60 and {r["keep_id"] for r in out} == set(least.values()) and sum(r["kept"] for r in out) == 7
    assert exact_dedup.kept_documents(docs).count() == 7


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_classes(rows):
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [sets_of(r[1]) for r in rows]
    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    classes = {}
    for i in range(n):
        classes.setdefault(find(i), []).append(i)
    least = {i: min((rows[k][0] for k in c if rows[k][0] is not None), default=None) for c in classes.values() for i in c}
    return [least[i] for i in range(n)], len(classes)


def test_near_duplicates(spark, docs, rows):
    expected, n = brute_classes(rows)
    out = prob_minhash.near_report(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in out) == Counter((r[0], e) for r, e in zip(rows, expected, strict=True))
    kept = prob_minhash.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == n


def test_near_families(spark):
    """Copies that are near to their base but not to each other, under many seeds."""
    rows, i = [], 0
    for _ in range(30):
        base = prose(120).split()
        for c in range(6):
            t = list(base)
            for k in range(1 if c else 0):
                t[(20 * c + k) % 120] = f"edit{c}"
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    expected, _ = brute_classes(rows)
    out = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {r[0]: e for r, e in zip(rows, expected, strict=True)}


def test_near_copies_that_repeat_a_passage(spark):
    """Weights by count would hide these: the sets' similarity is 0.82 to 0.84, whatever the repeats."""
    own = random.Random(11)
    fresh = lambda n: " ".join(f"w{own.randrange(10**9)}" for _ in range(n))
    rows = []
    for k in range(40):
        base, passage = fresh(300), fresh(58)
        rows += [(2 * k, base), (2 * k + 1, " ".join([base] + [passage] * (1, 5, 10, 30)[k % 4]))]
    expected, n = brute_classes(rows)
    assert n == 40 and expected[1] == 0
    out = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {r[0]: e for r, e in zip(rows, expected, strict=True)}


def test_recall_against_brute_force(spark):
    """5,000 texts with edits, cuts, appended and repeated passages: every pair of the threshold found by counting shared shingles."""
    own = random.Random(23)
    rows = []
    for _ in range(500):
        base = [f"w{own.randrange(3000)}" for _ in range(own.randint(20, 220))]
        for k in range(10):
            t = list(base)
            for _ in range(own.randint(0, max(1, len(t) // 40))):
                t[own.randrange(len(t))] = f"e{own.randrange(10**6)}"
            if k % 5 == 1:
                t = t[: own.randint(int(0.75 * len(t)), len(t))]
            elif k % 5 == 2:
                t += [f"a{own.randrange(10**6)}" for _ in range(own.randint(1, max(1, len(t) // 4)))]
            elif k % 5 == 3:
                t += t[: len(t) // 2] * own.randint(1, 20)
            elif k % 5 == 4:
                t = t[len(t) // 2 :] * own.randint(1, 9) + t
            rows.append((len(rows), " ".join(t)))
    sets, holders = [sets_of(t) for _, t in rows], {}
    for i, one in enumerate(sets):
        for x in one:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for held in holders.values() for n, a in enumerate(held) for b in held[n + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    met = sum(out[a] == out[b] for a, b in links) / len(links)
    print(f"{len(links)} links, recall {met:.5f}, same class {sum(out[i] == find(i) for i in out) / len(out):.5f}")
    assert len(links) > 5000 and met >= 0.99
    assert all(find(i) == find(c) for i, c in out.items())  # nothing joined that is not linked


def test_register_estimate_drops_no_class(spark, monkeypatch):
    """If the estimate drops every pair, the last turn still joins a chain of texts, those far from its pivot too."""
    monkeypatch.setattr(prob_minhash, "likely_pairs", lambda pairs, sig: pairs.limit(0))
    own = random.Random(12)
    text = [f"w{own.randrange(10**9)}" for _ in range(400)]
    rows = [(i, " ".join(text[18 * i : 18 * i + 200])) for i in range(9)]
    out = prob_minhash.near_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert brute_classes(rows)[1] == 1 and {r["class_id"] for r in out} == {0}


def test_beyond_pivot_loses_no_pair(spark):
    """One bucket of all texts, none joined yet: the last turn alone must give every component."""
    families = []
    for _ in range(3):
        base = prose(90).split()
        for c in range(60):
            t = list(base)
            for _ in range(rng.randrange(8)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[f"x{rng.randrange(9)}"], [], [t[at], "more"]])
            families.append(" ".join(t[: rng.choice([len(t), len(t), rng.randrange(40, 90)])] + [f"tail{c % 7}-{k}" for k in range(rng.choice([0, 0, 6, 15]))]))
    texts = [(i, t) for i, t in enumerate(dict.fromkeys(families))]
    sets = [sets_of(t) for _, t in texts]
    number = {x: n for n, x in enumerate(sorted(set().union(*sets)))}
    held = spark.createDataFrame([(i, [number[x] for x in s]) for (i, _), s in zip(texts, sets, strict=True)], "cid bigint, set array<bigint>")
    members = held.select(F.lit(1).cast("long").alias("bucket"), "cid", F.size("set").alias("n_shingles"), F.col("cid").alias("root"))
    degrees = held.select("cid", F.lit(1).cast("long").alias("degree"))
    links, pairs = prob_minhash.beyond_pivot(members, prob_minhash.spanning(members, degrees), held)
    found = {(r["a"], r["b"]) for r in prob_minhash.verify(pairs.union(links), held).collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    sure = {(r["a"], r["b"]) for r in links.collect()}
    assert sure <= near and found <= near

    def classes(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    assert classes(found) == classes(near) and len(set(classes(near))) > 20
    assert pairs.count() < len(sets) * (len(sets) - 1) // 2


def test_prob_minhash_estimates():
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(21, 121, dtype=np.uint64)
    with np.errstate(over="ignore"):
        e = prob_minhash.mixed(np.concatenate([a, b]))
        who = prob_minhash.prob_minhash(e, np.ones(200), np.repeat([0, 1], 100), 2, 4096)
    assert abs((who[0] == who[1]).mean() - 80 / 120) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    out = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["root"], set()).add(r["id"])
    assert sorted(map(len, groups.values())) == [40, 61]


ARTICLE = "<article><h1>Head &amp; tail</h1><p>First<br>line <b>bold</b></p><ul><li>x<li>y</ul></article>"
PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div>{}<section class='comments'><article class='comment'><p>Me too</p></article></section><footer>&copy; x</footer><script>var t='</p>';</script></body></html>"


def test_html(spark):
    rows = [(i, f"http://h/{i}", PAGE.replace("{}", ARTICLE)) for i in range(5)]
    loose = "<body><div class=menu>M</div><div>Same everywhere</div><div><p>Own text {}</p><p>More</p></div><form>f</form></body>"
    rows += [(10 + i, "https://u@other.org:80/x", loose.replace("{}", str(i))) for i in range(4)]
    rows += [(20, None, None), (21, "x", ""), (22, "x", "plain text < 3 & more"), (0, "http://h/0", PAGE.replace("{}", ARTICLE))]
    out = html_wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert text[3] == "Head & tail\n\nFirst line bold\n\nx\n\ny"
    assert text[12] == "Same everywhere\n\nOwn text 2\n\nMore"  # nothing tells the first block from the article: it stays
    assert text[20] == "" and text[21] == "" and text[22] == "plain text < 3 & more"


def test_template_of_copies(spark):
    """Copies of a page are no template; blocks of most distinct pages are, unless a page has nothing else."""
    page = lambda *blocks: "<body>" + "<hr>".join(blocks) + "</body>"
    rows = [(i, None, page("Alpha text", "Beta text")) for i in range(4)] + [(4, None, page("Gamma")), (5, None, page("Delta"))]
    rows += [(10 + i, "http://t/x", page("Shared", f"Own {i}")) for i in range(4)] + [(14, "http://t/y", page("Shared"))]
    rows += [(20 + i, "http://copies/x", page("One", "Two")) for i in range(5)]
    text = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [text[i] for i in range(6)] == ["Alpha text\n\nBeta text"] * 4 + ["Gamma", "Delta"]
    assert [text[10 + i] for i in range(5)] == [f"Own {i}" for i in range(4)] + ["Shared"]
    assert {text[20 + i] for i in range(5)} == {"One\n\nTwo"}


def test_main_region_by_text(spark):
    """Without article or main, a div of many paragraphs beats one of a few differently tagged links."""
    body = lambda i, n: [f"Paragraph {k} of page {i}." for k in range(n)]
    links = "<div class=tools><h2>Up</h2><p>Back</p><section>Next</section></div>"
    page = lambda i, n: f"<body>{links}<div class=text>{''.join(f'<p>{x}</p>' for x in body(i, n))}</div></body>"
    rows = [(i, f"http://plain/{i}", page(i, 20 - i)) for i in range(5)]
    text = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert text == {i: "\n\n".join(body(i, 20 - i)) for i in range(5)}


def test_classes_inside_an_article(spark):
    """Inside an article a class is furniture only as a whole; outside any part of it tells."""
    inside = "<h1>T</h1><div class='search-results'>Found</div><p class=notice-board>Board</p><p class='share-price'>Price</p>"
    off = "<div class=ad-slot>A</div><div class='comment-list'><p>C</p></div><p class='cookie-notice-2'>N</p><div id=comments>D</div><div class='x newsletter_form'>E</div>"
    page = f"<body><div class=search-results>menu</div><article>{inside}{off}<p>End</p></article></body>"
    rows = [(i, f"http://c/{i}", page) for i in range(3)]
    text = {r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert text == {"T\n\nFound\n\nBoard\n\nPrice\n\nEnd"}


def test_html_of_long_pages_and_extra_columns(spark, sf_dir):
    """A page of many blocks is kept whole; columns that clash with working names are not read."""
    blocks = [f"Block {i} of text" for i in range(5000)]
    rows = [(i, "http://long/x", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>", "h", "p", "r") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, pattern string, region string")
    assert {(r["text"], r["n_chars"]) for r in html_wrappers.extract(frame).collect()} == {("\n\n".join(blocks), len("\n\n".join(blocks)))}


def test_wrapper_alignment():
    fold = html_wrappers.folded
    assert fold(["a", "p", "#", "/p", "p", "#", "/p", "b"]) == ["a", "(p # /p)+", "b"]
    assert html_wrappers.aligned(["a", "b", "c"], ["a", "c", "d"]) == ["a", "(b)?", "c", "(d)?"]


def test_licences(docs, spark):
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert out[17]["licences"] == "MIT" and out[17]["n_sentences"] == 1 and out[0]["licences"] == ""
    s = licenses.SENTENCES
    wrapped = s["mit-grant"].replace(" ", "  ", 3).replace(" copy ", "\ncopy ")
    texts = [(1, f"{wrapped}. Other. {s['mit-notice']}: yes.\n{s['mit-asis']}."), (2, f"{s['mit-asis']}. {s['mit-grant']}."), (3, "a license.")]
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found == {1: "MIT", 2: "", 3: ""}
    own = licenses.scan(spark.createDataFrame([(1, "Yours. Do as you like! Bye."), (2, "a 1.0 b\n1.0")], "doc_id bigint, text string"), {"like": "do as you like", "no": "1 0"}, [("Own", ["like"]), ("One", ["no"])])
    assert {r["doc_id"]: (r["licences"], r["sentence_ids"]) for r in own.collect()} == {1: ("Own", "like"), 2: ("One", "no")}


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
NOTICES = [
    ("GPL-3.0", GPL.format(":", ",", 3)), ("GPL-3.0", GPL.format(";", ";", 3)), ("GPL-2.0", GPL.format(";", ";", 2)), ("GPL-2.0", GPL.format(":", ",", 2)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def test_verbatim_notices(spark):
    """Each notice as it is published, plain and in comments of several languages."""
    commented = lambda t, lead: "\n".join((lead + x).rstrip() for x in ["Copyright (c) 2020 Somebody", "", *t.split("\n")])
    shapes = [lambda t: t, lambda t: "/*\n" + commented(t, " * ") + "\n */\nint x;"] + [lambda t, k=k: commented(t, k) + "\n\ncode()" for k in ("# ", "// ", ";; ", "-- ")]
    texts = [(i * 10 + k, shape(t)) for i, (_, t) in enumerate(NOTICES) for k, shape in enumerate(shapes)]
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found == {d: NOTICES[d // 10][0] for d, _ in texts}


def test_license_tags_and_families(spark):
    """Tag lines in comments of several languages; notices of the lesser and the network licences, and of three clauses."""
    lesser = GPL.replace("General Public", "Lesser General Public").replace("This program", "This library")
    tags = [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0-or-later"), ("BSD", "BSD-2-Clause"), ("EPL-2.0", "EPL-2.0")]
    shapes = ("// SPDX-License-Identifier: {}", "/* SPDX-License-Identifier: {} */\nint x;", "#!/bin/sh\n# SPDX-License-Identifier:  {}\n\necho a.", " * SPDX-License-Identifier: {}\r\n */")
    cases = [(name, shape.format(tag)) for name, tag in tags for shape in shapes]
    cases += [("LGPL-2.1", lesser.format(";", ";", "2.1")), ("LGPL-3.0", lesser.format(":", ",", "3")), ("AGPL-3.0", GPL.replace("General Public", "Affero General Public").format(":", ",", 3))]
    third = "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    cases += [("BSD,BSD-3-Clause", next(t for name, t in NOTICES if name == "BSD") + third), ("", "SPDX-License-Identifier"), ("", "SPDX-License-Identifier:\nsee MIT")]
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")).collect()}
    assert found == {i: name for i, (name, _) in enumerate(cases)}


def brute_licences(text):
    """Identifiers by place and licences, by plain regular expressions over one text."""
    hits = set()
    for end in licenses.WAYS.values():
        at = begin = 0
        spans = [(m.start(), m.end()) for m in regex.finditer(end, text)]
        for a, b in [*spans, (len(text), len(text))]:
            for piece in (text[begin:a], text[a:b]):
                plain = regex.sub(r"[^\p{L}\p{N}]+", " ", piece.lower()).strip()
                hits |= {(at, k) for k, s in licenses.SENTENCES.items() if s == plain}
                at += len(plain.replace(" ", ""))
            begin = b
    ids = [k for _, k in sorted(hits)]
    inside = lambda rule: all(x in it for it in [iter(ids)] for x in rule)
    return ",".join(ids), ",".join(sorted({name for name, rule in licenses.RULES if inside(rule)}))


def test_licences_equal_brute_force(spark, sf_dir):
    """The given documents, whole, and shuffled mixtures of the dictionary's sentences."""
    own = random.Random(3)
    parts = [*licenses.SENTENCES.values(), "", "other words", "# x", "1) y", "é ü"]
    mixed = [(10**6 + i, "".join(own.choice(parts) + own.choice([". ", ".\n", "\n", "; ", "\n\n", "\n * ", ": ", " "]) for _ in range(own.randint(0, 25)))) for i in range(400)]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(mixed, "doc_id bigint, text string"))
    out = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licenses.scan(frame).collect()}
    assert out == {r["doc_id"]: brute_licences(r["text"] or "") for r in frame.collect()} and sum(bool(v[1]) for v in out.values()) > 100


def test_licences_of_both_splits(spark):
    """A licence told on a line and another wrapped over lines, and a rule of which each split sees a part."""
    line, mit = "Licensed under CC BY 4.0\nand more text without a full stop\n\n", next(t for name, t in NOTICES if name == "MIT")
    bsd = [licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    parts = f"Note\n{bsd[0]}\nsome line\n\n" + bsd[1].replace(" above ", "\nabove ") + ".\n" + bsd[2] + "\nend"
    texts = [(1, line + mit), (2, mit + "\n\n" + line), (3, parts), (4, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [out[k]["licences"] for k in (1, 2, 3)] == ["CC-BY-4.0,MIT", "CC-BY-4.0,MIT", "BSD"]
    assert out[1]["sentence_ids"] == "cc-by,mit-grant,mit-notice,mit-asis" and out[2]["sentence_ids"].endswith(",cc-by")
    assert out[4]["sentence_ids"] == "cc-by,cc-by"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = Encoder(public_path(name))
    for text in [t or "" for t in TEXTS]:
        assert e.encode(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


def test_packing(docs, rows):
    e = Encoder(public_path("word_bpe_49k.json"))
    ids = [np.frombuffer(e.whole(r[1] or "") + np.array([2], "<u4").tobytes(), "<u4") for r in rows]
    out = packing.packed(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, r in enumerate(rows):
        mine = [p for p in by_doc[r[0]] if p["doc_tokens"] == len(ids[i])]
        held = Counter()
        for p in mine:
            held.update(range(p["start"], p["start"] + p["length"]))
            assert p["ids_crc32"] == zlib.crc32(ids[i][p["start"] : p["start"] + p["length"]].tobytes())
        copies = sum(x[0] == r[0] for x in rows)
        assert held == dict.fromkeys(range(len(ids[i])), copies)  # each id in one piece of each copy
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0 and len(by_sequence) == max(by_sequence) + 1
    whole = packing.sequences(docs).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(map(len, ids)) and all(sum(r["lengths"]) == len(r["ids"]) for r in whole)


def test_least_squares():
    a = np.random.default_rng(1).random((20, 40))
    x = np.maximum(0, np.random.default_rng(2).normal(size=40))
    got = packing.least_squares(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_token_ids(spark, docs, rows):
    e = Encoder(public_path("byte_bpe_50k.json"))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, expected = 0, []
    for r in ordered:
        raw = e.whole(r[1] or "") + np.array([2], "<u4").tobytes()
        expected.append((r[0], at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    shards = token_ids.write_shards(docs, shard_bytes=4000)
    assert shards.count() > 3
    assert Counter(map(tuple, token_ids.read_all(shards).collect())) == Counter(expected)
    keys = spark.createDataFrame([(3,), (10,), (10**9,), (None,)], "doc_id bigint")
    found = token_ids.lookup(shards, keys).collect()
    assert Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in found) == Counter((d, s, c) for d, s, n, c in expected if d in (3, 10, None))


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 7, 60, 5000):
        keys = np.array(random.Random(n).sample(range(-(10**12), 10**12), n))
        moves, slots = token_ids.build_index(keys)
        assert sorted(slots.tolist()) == list(range(n)) and token_ids.slots_of(keys, moves, n).tolist() == slots.tolist()


def test_chunked_ids_equal_the_library():
    alpha = "abÉéİßñ .,!'\n  sS\t&%#9$-ÀŻⅡǅtre中"
    fuzz = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "<|endoftext|> a", "x" * 5000, "a, b. " * 3000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(public_path(name))
        ids = [v[a:b].tolist() for _, v, at in e.encode_batch(pa.array(fuzz), 2) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert ids == [e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in fuzz]


def test_chat(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be <brief>"), (1, 3, "assistant", "\\l<\\b" + prose(300)), (1, 1, "user", prose(400)), (1, 4, "user", None), (1, 5, "assistant", prose(20)), (1, 5, "assistant", "tie"),
            (-7, 0, "user", odd), (-7, 1, "assistant", odd), (None, None, None, None), (2, 0, "assistant", ""), (3, 1, "a\nb<", "<again x<text>")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_windows(frame).collect()
    assert sum(r["conv_id"] == 1 for r in windows) >= 2 and all(r["formatted"].startswith(("<turn ", "<again ")) for r in windows)
    second = next(r for r in windows if r["conv_id"] == 1 and r["window"] > 0)
    assert second["formatted"].startswith("<again system<text>be \\lbrief></turn>\n")
    out = {r["conv_id"]: r for r in chat.format_and_read(frame).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        got = out[conv]
        assert (got["n_turns"], got["turns_sha256"]) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_windows_keep_the_budget(spark, sf_dir):
    tokens = lambda line: len(words(line)) + chat.PER_TURN
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], prose(rng.choice([1, 5, 40, 120, 300]))) for c in range(30) for t in range(25)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    for budget, history in ((512, 128), (200, 60)):
        seen = Counter()
        for w in chat.format_windows(frame, budget, history).collect():
            parts = w["formatted"].split(chat.CLOSE)[:-1]
            own = [p.split(chat.TEXT, 1)[1] for p in parts if p.startswith(chat.OPEN)]
            first = [p.split(chat.TEXT, 1)[1] for p in parts if p.startswith(chat.AGAIN + "system")]
            total = sum(tokens(p.split(chat.TEXT, 1)[1]) for p in parts)
            assert own and (total <= budget or (len(own) == 1 and len(parts) == 1 + len(first)))
            seen[w["conv_id"]] += len(own)
        assert all(n == 25 for n in seen.values()) and len(seen) == 30


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    state = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        state = stage(spark, state, sf_dir)
        assert state.columns == docs.columns
        if name == "quality":
            junk = lambda q, t: 10 * q[2] > q[1] or 10 * q[3] > 4 * sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
            rows = [r for r in rows if not (q := brute_quality(r[1]))[5] and not junk(q, r[1])]
        elif name == "exact_dedup":
            first = {}
            for r in sorted(rows):
                first.setdefault(spaced(r[1]), r)
            rows = list(first.values())
        else:
            least, _ = brute_classes(rows)
            rows = [r for r, m in zip(rows, least, strict=True) if r[0] == m]
        assert sorted(r["doc_id"] for r in state.collect()) == sorted(r[0] for r in rows)
    mixed = corpus_pipeline.STAGES[3][1](spark, state, sf_dir)
    assert mixed.columns == docs.columns
    target, got = brute_targets(Counter(n for r in rows for n in [r[3]] for _ in words(r[1]))), Counter()
    for r in mixed.collect():
        got[r["source"]] += len(words(r["text"]))
    assert {x: (got[x], target[x]) for x in target if abs(got[x] - target[x]) > 192} == {}  # half a block by rounding, one by the last block's shortness
    e = Encoder(public_path("word_bpe_49k.json"))
    total = sum(len(e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir).collect()) == total
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
