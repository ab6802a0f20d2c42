"""Exact and near duplicates, components, leaks and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from oracle import check
from pyspark.sql import functions as F

from tramline.llm import bloom, decontaminate, exact, quality, queries, simhash, toxicity
from tramline.llm.text import LOWER, UPPER, ascii_lower
from tramline.operators import components

CLASH = "doc_id bigint, text string, h string, maybe string, fp int, keep_id int, _h string, i int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", "m", 1, 2, "x", 3) for i, t in rows], CLASH)


def test_sql_of_the_queries(spark, sf_dir):
    for name, sql in queries.SQL.items():
        assert check(queries.QUERIES[name](spark, sf_dir), sql, sf_dir)


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉÎ abc ÄÖ", "ΑΣ Σ", "İI", "ǅ ⅧⒶ", "", "K Å"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()]
    assert got == [t.translate(str.maketrans(UPPER, LOWER)) for t in texts]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(str.maketrans(UPPER, LOWER))].append(i)
    out, kept = [], set()
    for i, t in rows:
        key = (t or "").translate(str.maketrans(UPPER, LOWER))
        ids = [x for x in groups[key] if x is not None]
        keep = max(ids) if ids else None
        stays = i == keep and (key, i) not in kept
        if stays:
            kept.add((key, i))
        out.append((i, keep, len(groups[key]), stays, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, None), (2, ""), (3, "Same"), (4, "sAME"), (5, "sAMÉ"), (6, "samé"), (7, "other"), (7, "other"), (7, "OTHER"), (8, "x" * 200_000), (9, "X" * 200_000), (None, "lone"), (None, "lone"), (10, "single"), (11, "same"), *[(100 + i, "hot") for i in range(400)]]


def test_exact_dedup(spark):
    got = sorted((tuple(r) for r in exact.exact_dedup(docs(spark, ROWS).repartition(5)).collect()), key=repr)
    assert got == brute_exact(ROWS)
    assert exact.exact_dedup(docs(spark, [])).count() == 0
    kept = exact.drop_exact_copies(docs(spark, ROWS).repartition(5))
    assert kept.columns == docs(spark, []).columns
    assert sorted(((r["doc_id"]) for r in kept.collect()), key=repr) == sorted((r[0] for r in brute_exact(ROWS) if r[3]), key=repr)
    assert exact.drop_exact_copies(docs(spark, [])).count() == 0


def test_a_filter_that_is_joined_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BROADCAST", 0)
    rows = [(i, f"t{i % 3000}") for i in range(4000)]
    got = sorted((tuple(r) for r in exact.exact_dedup(docs(spark, rows)).collect()), key=repr)
    assert got == brute_exact(rows)
    kept = exact.drop_exact_copies(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r[0] for r in brute_exact(rows) if r[3])


@pytest.mark.parametrize("n", [5000, 50_000])
def test_only_rows_that_may_repeat_are_grouped(spark, n):
    """A twentieth of the rows repeats; of the others, about one in 250 passes the filter, at any number of rows."""
    slim = spark.range(n).select(F.sha2(F.when(F.col("id") < n // 20, F.floor(F.col("id") / 2)).otherwise(F.col("id")).cast("string").cast("binary"), 256).alias("h"))
    maybe = exact.maybe_repeated(slim, "h", "m").filter("m").count()
    assert n // 20 <= maybe <= n // 20 + n // 50


def test_rows_without_a_key_that_goes_stay_where_they_are(spark):
    rows = docs(spark, [(i, f"t{i}") for i in range(20_000)] + [(None, "x")])
    keys = spark.createDataFrame([(i,) for i in range(0, 20_000, 100)] + [(None,)], "k bigint")
    touched, rest = bloom.split_by(rows, "doc_id", keys)
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "SortMergeJoin" not in plan
    some = {r["doc_id"] for r in touched.collect()}
    assert some >= {r["k"] for r in keys.collect()} and len(some) < 400 and rest.count() + touched.count() == 20_001
    assert rest.columns == touched.columns == rows.columns


def test_covering_masks_meet_every_pair():
    masks, rng = simhash.covering_masks(), random.Random(1)
    assert len(masks) == 31
    differences = [1 << a | 1 << b for a, b in combinations(range(64), 2)] + [sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(40_000)]
    assert all(any(d & m == 0 for m in masks) for d in differences)


def slow_fingerprint(text):
    words = "".join(c.lower() if c in UPPER else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", " \n", "one", "One two", "a b c d", "a B c d e\x0bf g " * 40, "ÉTÉ été x y z"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def brute_components(items, linked):
    label = dict(items)
    parent = {k: k for k in label}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(label, 2):
        if linked(label[a], label[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in label}


@pytest.mark.parametrize("most", [8192, 3])
def test_links_connect_what_brute_force_connects(spark, most):
    rng, fps = random.Random(6), set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7)))
    signed = {x: x - 2**64 if x >> 63 else x for x in fps}
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed.values()], "fp bigint"), most=most)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = brute_components({v: x for x, v in signed.items()}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {v: roots.get(v, v) for v in signed.values()} == want


def test_near_groups(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 50)) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(50 + i, t.replace(t.split()[150], "zzz", 1)) for i, t in enumerate(base)] + [(90, None), (91, ""), (92, "A B"), (93, "a  b"), (93, "a b"), (94, "x " * 100_000)]
    out = simhash.near_groups(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in out}
    want = brute_components({i: slow_fingerprint(t or "") for i, t in rows}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == want and got[91] == 90 and got[93] == 92
    kept = simhash.keep_one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 5000
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_long_chains_in_any_order(spark):
    shuffled, falling = random.Random(2).sample(range(500), 500), [1000 + (k // 2 if k % 2 == 0 else 299 - k // 2) for k in range(300)]
    edges = [e for ids in (shuffled, falling, range(2499, 1999, -1)) for e in zip(ids, ids[1:], strict=False)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(500)} | {i: 1000 for i in range(1000, 1300)} | {i: 2000 for i in range(2000, 2500)}


def test_edit_distance_to_any_part():
    def slow(item, text):
        best = len(item)
        for s in range(len(text) + 1):
            row = list(range(len(item) + 1))
            best = min(best, row[-1])
            for w in text[s:]:
                new = [row[0] + 1]
                for j, x in enumerate(item, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != w)))
                row = new
                best = min(best, row[-1])
        return best

    rng = random.Random(4)
    for _ in range(150):
        item, text = [rng.randint(0, 4) for _ in range(rng.randint(1, 7))], [rng.randint(0, 4) for _ in range(rng.randint(0, 9))]
        assert decontaminate.edit_distance(np.array(item), np.array(text, int))[0] == slow(item, text)


def test_leaks_against_all_positions(spark, sf_dir):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(901, "short four word item"), (902, "Single"), (903, ""), (904, None)]
    rng, rows, want = random.Random(12), [(1, None), (2, ""), (3, "nothing here at all"), (4, "the the the " * 3000)], 0
    filler = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()
    planted = set()
    for k in range(300):
        item, text = bench[rng.randrange(40)]
        words = text.split()
        for _ in range(rng.randint(0, len(words) // 8)):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.__setitem__(at, "zz"), lambda: words.pop(at), lambda: words.insert(at, "qq")])()
        rows.append((1000 + k, " ".join([*rng.choices(filler, k=rng.randint(0, 40)), *words, *rng.choices(filler, k=rng.randint(0, 40))])))
        planted.add((1000 + k, item))
    rows += [(2000, "x Short, FOUR word item. y"), (2001, "single")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    out = decontaminate.find_leaks(docs(spark, rows), items)
    got = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    words = {i: decontaminate.item_words(t) for i, t in bench}
    ids = {w: n for n, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
    truth = set()
    for d, t in rows:
        own = np.array([ids.get(decontaminate.normal(w), -1) for w in (t or "").split()], int)
        truth |= {(d, i) for i, ws in words.items() if ws and decontaminate.edit_distance(np.array([ids[w] for w in ws]), own)[0] <= 0.2 * len(ws)}
    assert got == truth and planted <= truth
    want = {d for d, _ in rows} - {d for d, _ in got}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, rows), items).collect()} == want
    none = items.limit(0)
    assert decontaminate.find_leaks(docs(spark, rows), none).count() == 0 and decontaminate.drop_leaks(docs(spark, rows), none).count() == len(rows)
    assert decontaminate.find_leaks(docs(spark, []), items).count() == 0


def test_every_item_with_all_its_edits_is_found():
    rng, items, texts = random.Random(3), [], []
    for n in [*range(1, 31), 40, 60, 100] * 12:
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        items.append(list(words))
        for _ in range(n // 5):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.__setitem__(at, "zz"), lambda: words.pop(at), lambda: words.insert(at, "qq")])()
        texts.append(" ".join(["xx"] * rng.randint(0, 30) + words + ["yy"] * rng.randint(0, 30)))
    found = decontaminate.Matcher(items).find(texts)
    assert [i for i, f in enumerate(found) if i not in f] == []
    ids = {w: k for k, w in enumerate(sorted({w for x in items for w in x}))}
    for i in range(0, len(items), 7):
        own = np.array([ids.get(w, -1) for w in texts[i].split()])
        assert found[i][i][0] == decontaminate.edit_distance(np.array([ids[w] for w in items[i]]), own)[0]


def with_edits(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(at, "zz"), lambda: words.pop(at), lambda: words.insert(at, "qq")])()
    return words


@pytest.mark.parametrize("n", [4, 5, 7, 10, 12, 15, 20, 24, 30, 40, 60, 100])
def test_tables_alone_reach_their_recall(n):
    """Without the check of parts, at the most edits that an item of n words may have."""
    rng = random.Random(n)
    items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(200)]
    matcher = decontaminate.Matcher(items, parts=False)
    texts = [" ".join(["xx"] * rng.randint(0, 30) + with_edits(rng, x, n // 5) + ["yy"] * rng.randint(0, 30)) for x in items]
    assert np.mean([i in f for i, f in enumerate(matcher.find(texts))]) >= decontaminate.TARGET


def test_items_and_texts_of_one_phrase():
    """Items that share a phrase, in a text that repeats it: work grows with the items and the text, not with their product in tuples."""
    rng, phrase = random.Random(1), [f"p{i}" for i in range(7)]
    items = [phrase + [f"q{rng.randrange(5000)}" for _ in range(13)] for _ in range(300)]
    matcher = decontaminate.Matcher(items)
    bare, scattered = " ".join(phrase * 5000), " ".join([*phrase * 5000, *[w for x in items for w in x[7:]], *phrase * 500, *with_edits(rng, items[17], 3)])
    start = time.perf_counter()
    found = matcher.find([bare, scattered])
    assert time.perf_counter() - start < 60
    words = scattered.split()
    ids = {w: k for k, w in enumerate(sorted(set(words)))}
    own = np.array([ids[w] for w in words])
    want = {i for i in (0, 1, 17, 298, 299) if decontaminate.edit_distance(np.array([ids[w] for w in items[i]]), own)[0] <= 4}
    assert found[0] == {} and 17 in want and {i for i in (0, 1, 17, 298, 299) if i in found[1]} == want


def test_distinct_words_around_each_place():
    rng = random.Random(5)
    words = np.array([rng.randrange(12) for _ in range(200)])
    for width in (1, 4, 30):
        got = decontaminate._distinct(np.isin(words, [1, 5, 7]), decontaminate._before(words), width)
        assert got.tolist() == [len({1, 5, 7} & set(words[k : k + width].tolist())) for k in range(200)]


def test_words_of_marks_only_count_in_no_text():
    item = decontaminate.item_words("one - two three -- four five")
    text = "- so: one - two *** three\n-- four ; five ... and more"
    assert decontaminate.Matcher([item]).find([text, "- -"]) == [{0: (0, text.split().index("five") + 1)}, {}]


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / n / (len(y) - n)


@pytest.mark.parametrize(("label", "score", "least"), [("toxic", toxicity.score_toxicity, 0.85), ("quality", quality.score_quality, 0.95)])
def test_held_out_accuracy(spark, label, score, least):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    some = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = score(some, labels).join(labels, "doc_id").filter("held_out").select("score", label).toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_on_odd_rows(spark, score):
    rows = [(1, None), (2, ""), (3, "idiot " * 50_000), (4, "fine"), (4, "fine"), (None, "no id"), *[(100 + i, f"word{i} calm text") for i in range(30)]]
    labels = spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    out = score(docs(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert score(docs(spark, []), labels).count() == 0
    same = {round(r["score"], 9) for r in score(docs(spark, rows), labels.limit(0)).collect()}
    assert len(same) == 1 and 0 < min(same) < 0.01  # the prior without labels
    ones = {round(r["score"], 9) for r in score(docs(spark, rows), labels.filter("toxic = 1")).collect()}
    assert len(ones) == 1 and min(ones) > 0.99


ODD_TEXTS = ["", "  ", "one", "An idiot! an IDIOT, an 1d10t...", "Ünï çode İ Σ 한글 Ⅷ", "x" * 5000, "a b " * 4000, "n1 | n2 | n3\n\nLine two.\nLine two.\n", "\ud800 lone", "***", " ".join(f"w{i}" for i in range(3000))]


def slow_toxicity(model, text):
    """The bag of each word's n-grams, one by one, and spans of distinct words, averaged with weights that grow with their logits."""

    def bag(word):
        chars, out = [ord(c) for c in f"<{word}>"], [zlib.crc32(word.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS]
        for n in (3, 4, 5):
            for i in range(len(chars) - n + 1):
                h = chars[i] + 1
                for c in chars[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
                out.append(((h * 0xC2B2AE3D27D4EB4F) % 2**64 >> 32) % toxicity.BUCKETS)
        return out

    words = []
    for w in toxicity.WORD.findall(text.lower()):
        if w not in words:
            words.append(w)
    z = model.bias
    if words:
        bags = [bag(w) for w in words]
        logits = []
        for start in range(0, max(1, len(words) - toxicity.SPAN // 2), toxicity.SPAN // 2):
            ids = [b for x in bags[start : start + toxicity.SPAN] for b in x]
            logits.append(sum(float(model.weight[b]) for b in ids) / len(ids))
        share = [math.exp(x - max(logits)) for x in logits]
        z += sum(s * x for s, x in zip(share, logits, strict=True)) / sum(share)
    return 1 / (1 + math.exp(-(model.slope * z + model.shift)))


def test_toxicity_scores_equal_a_plain_scorer():
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.3, 1.7, 0.2)
    assert np.allclose(toxicity.Scorer(model)(ODD_TEXTS), [slow_toxicity(model, t) for t in ODD_TEXTS], atol=1e-6)


def test_quality_scores_equal_all_pairs():
    """The sum of squares against every pair of features, and the words' part against counts made one by one."""
    rng = np.random.default_rng(4)
    m = quality.FactorisationMachine(0.1, rng.normal(0, 0.5, quality.SIZE), rng.normal(0, 0.3, (quality.SIZE, quality.RANK)))
    for text in ["", "one", "An idiot! an IDIOT, an 1d10t...", "Ünï çode İ Σ 한글 Ⅷ", "n1 | n2 | n3\n\nLine two.\nLine two.\n", "\ud800 lone", "***"]:
        ids, x = quality.features(text)
        slow = m.w0 + sum(m.w[i] * a for i, a in zip(ids, x, strict=True))
        slow += sum(float(m.v[ids[i]] @ m.v[ids[j]]) * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert m.logit(ids, x) == pytest.approx(slow, abs=1e-9)
        counts = defaultdict(int)
        for w in text.split():
            if key := w.strip(quality.STRIP).lower():
                counts[zlib.crc32(key.encode("utf-8", "surrogatepass")) % quality.WORDS] += 1
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
        own = {int(i): a for i, a in zip(ids, x, strict=True) if i < quality.WORDS}
        assert own == pytest.approx({i: math.log1p(n) / norm for i, n in counts.items()})
        bins = sorted(int(i) for i in ids if i >= quality.WORDS)
        assert [(i - quality.WORDS) // quality.BINS for i in bins] == list(range(len(quality.STATS)))


def test_misspelt_words_share_ngrams():
    texts = ["you are an idiot today", "such a moron there", "calm sea and sky", "green fields and rain"] * 40
    y = np.array([1, 1, 0, 0] * 40)
    model = toxicity.train(texts, y, 0.5)
    scores = toxicity.Scorer(model)(["an idiiot came", "a quiet evening"])
    assert scores[0] > scores[1]


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs_]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == docs_.columns for s in seen[:5])
    text = {r["doc_id"]: r["text"] for r in docs_.collect()}
    model = toxicity.fit(docs_, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    order = sorted(text)
    scores = dict(zip(order, toxicity.Scorer(model)([text[i] for i in order]), strict=True))
    assert ids[1] == {i for i in text if scores[i] < toxicity.THRESHOLD}
    last = {}
    for i in sorted(ids[1]):
        last[text[i].translate(str.maketrans(UPPER, LOWER))] = i
    assert ids[2] == set(last.values())
    fps = {i: slow_fingerprint(text[i]) for i in ids[2]}
    assert ids[3] == set(brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4).values())
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    items = [" ".join(decontaminate.item_words(r["text"])) for r in bench]
    flat = {i: f" {' '.join(map(decontaminate.normal, text[i].split()))} " for i in ids[3]}
    exact_hit = {i for i in ids[3] if any(f" {x} " in flat[i] for x in items)}
    words = {w: k for k, w in enumerate(sorted({w for x in items for w in x.split()}))}
    coded = [np.array([words[w] for w in x.split()]) for x in items]
    own = {i: np.array([words.get(w, -1) for w in flat[i].split()], int) for i in ids[3]}
    leaked = {i for i in ids[3] if any(decontaminate.edit_distance(x, own[i])[0] <= int(0.2 * len(x) + 1e-9) for x in coded if len(x))}
    assert exact_hit and exact_hit <= leaked and ids[4] == ids[3] - leaked
    assert ids[5] == ids[4]


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, fp int, i int, k int, __id string, score string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, columns with names that operators use; then no rows."""
    import corpus_pipeline
    from tramline.session import path_exists

    rng = random.Random(8)
    plain = [" ".join(f"word{rng.randrange(4000)}" for _ in range(80)) for _ in range(60)]
    texts = [*[(i, t) for i, t in enumerate(plain)], (100, plain[3]), (101, plain[3].upper()), (102, plain[5] + " tail"), (103, None), (104, ""), (105, "x" * 200_000), (105, "x" * 200_000), (None, "an id is missing here"), (None, None), (106, "before " + " ".join(f"item{i}" for i in range(20)) + " after")]
    rows = [(i, t, None, None, None, None, None, None, None, None, None) for i, t in texts]
    for name, schema, data in (("documents", CLASHING, rows), ("labels", "doc_id bigint, quality int, toxic int", [(1, 1, 0), (None, None, None)]), ("benchmark", "item_id bigint, text string", [(1, " ".join(f"item{i}" for i in range(20))), (None, None), (3, "")])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = str(tmp_path / "run")
    out = corpus_pipeline.run(spark, str(tmp_path), folder).collect()
    left = spark.read.parquet(f"{folder}/3-decontaminate")
    assert [f.name for f in left.schema] == [c.split()[0] for c in CLASHING.split(", ")]
    ids = [r["doc_id"] for r in left.collect()]
    assert 106 not in ids and 3 not in ids and 100 not in ids and 105 in ids and ids.count(105) == 1 and None in ids
    assert {r["doc_id"] for r in out} == set(ids)
    again = corpus_pipeline.run(spark, str(tmp_path), folder)  # goes on after its last stage
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out)) and path_exists(spark, f"{folder}/0-toxicity/_SUCCESS")
    none = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(none / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
