"""MinHash groups, spelling variants and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tramline.llm import minhash, queries, spelling, trie
from tramline.session import table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    by_shingle = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in enumerate(sets):
        met = Counter(j for x in s for j in by_shingle[x] if j < k)
        for j, both in met.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    lows = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        lows[find(k)].append(i)
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in lows.items()}
    return sorted(((i, len(s), low[find(k)], i == low[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def doc_rows(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, "k", "x") for i, t in rows], "doc_id bigint, text string, d string, n int, k string, label string")


def groups_of(spark, rows, parts=5):
    return sorted((tuple(r) for r in minhash.near_groups(doc_rows(spark, rows).repartition(parts)).collect()), key=repr)


def test_minhash_on_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    agree(sorted((tuple(r) for r in queries.op11_minhash(spark, sf_dir).collect()), key=repr), brute_groups(rows))


def test_minhash_odd_rows(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0btwo "), (6, "one two three"), (7, "É é"), (8, "é É"), (9, "one two"), (None, "one two"), (None, None), (None, "lone row"),
        (10, " ".join(words)), (10, " ".join(words)), (11, " ".join([*words[:150], "x", *words[150:]])), (12, "a b c d " * 100_000), (13, "a b c d " * 99_999 + "a"), (14, "y" * 500_000), (15, "a b c d e"),
    ]
    agree(groups_of(spark, rows), brute_groups(rows))
    assert groups_of(spark, []) == []


def test_minhash_at_the_threshold(spark):
    """Sets of 4 of 5 equal shingles are linked; less by one of 12 aren't: exact, whatever the signatures say."""
    rows, k = [], 0
    for n in (10, 20, 45, 90):
        for cut in range(0, n // 4):
            words = [f"v{n}.{cut}.{j}" for j in range(n)]
            rows += [(k, " ".join(words)), (k + 1, " ".join(words[cut:]))]
            k += 2
    agree(groups_of(spark, rows), brute_groups(rows))


def chained(n, size, step, seed):
    """Texts of one family: each changes a few words of an earlier one, so that links form chains and stars."""
    r = random.Random(seed)
    family = [[f"{seed}.{r.randrange(10**6)}" for _ in range(size)]]
    for _ in range(n - 1):
        words = list(r.choice(family))
        for _ in range(r.randrange(1, step)):
            words[r.randrange(size)] = f"n{r.randrange(10**6)}"
        family.append(words)
    return [" ".join(w) for w in family]


@pytest.mark.parametrize("by_blocks", [False, True])
def test_minhash_families(spark, monkeypatch, by_blocks):
    """Many sets in one bucket, some linked only through others; with small blocks too, and with no round of leaders after the first."""
    if by_blocks:
        monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    texts = [t for s in range(4) for t in chained(60, 80, 5, s)]
    rows = list(enumerate(random.Random(1).sample(texts, len(texts))))
    agree(groups_of(spark, rows), brute_groups(rows))
    if by_blocks:
        sets = spark.createDataFrame([(hashlib.md5((f := minhash.shingle_set(t)).tobytes()).digest(), len(f), minhash.signature(f).tobytes(), t) for _, t in rows], "d binary, n bigint, sig binary, text string").dropDuplicates(["d"])
        buckets = sets.selectExpr("d", "1L AS k")
        labels = spark.createDataFrame([], "node binary, root binary")
        links = minhash._block_links(buckets, labels, sets.select("d", "n", "sig"), sets.select("d", "text")).collect()
        whole = {hashlib.md5(minhash.shingle_set(t).tobytes()).digest(): t for _, t in rows}
        assert links and all(minhash.similar(minhash.shingle_set(whole[bytes(a)]), minhash.shingle_set(whole[bytes(b)])) for a, b in links)


def test_bayesian_pruning():
    """Estimates: minima match as often as the sets are similar; hardly a pair at the threshold is pruned, and most far pairs are at the first batch."""
    rng = np.random.default_rng(3)
    near, far = [], []
    for share, out in ((0.8, near), (0.3, far)):
        for _ in range(300):
            n = 400
            both = int(2 * n * share / (1 + share))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate((a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)))
            out.append((minhash.signature(a), minhash.signature(b)))
    for share, pairs in ((0.8, near), (0.3, far)):
        x, y = np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])
        assert abs((x == y).mean() - share) < 0.02
        assert minhash.plausible(x, y).mean() == (1 if share == 0.8 else 0)
    assert minhash.LEAST == sorted(minhash.LEAST) and minhash.LEAST[0] > 0


def brute_words(rows):
    counted = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}
    letters, forms, out = sorted({c for w in words for c in w}), {}, []
    for w, n in words.items():
        near = {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in [*letters, ""]}
        near = [(-words[x], x) for x in near if x != w and x in words]
        best = min(near, default=None)
        forms[w] = (best[1] if best and -best[0] >= 5 * n else None, len(near))
    for w, (form, near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, words[w], near, words[form] if form else None))
    return sorted(out)


def test_spelling_on_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op12_spelling(spark, sf_dir).collect())
    assert got == brute_words(rows) and any(r[1] for r in got)


def test_words_are_counted_by_slices(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 16)
    monkeypatch.setattr(spelling, "HELD", 3)
    frame = pd.DataFrame({"i": ["1", ""], "text": ["one Two three, four five " * 40 + "x" * 100, "tWo"]})
    out = pd.concat(spelling._counted(iter([frame, frame.iloc[:0]]))).groupby("word")["n"].sum()
    assert len(list(spelling._counted(iter([frame])))) > 1
    want = Counter(spelling.word_of(i, w) for i, t in zip(frame["i"], frame["text"], strict=True) for w in re.findall("[a-z]+", t.lower()))
    assert out.to_dict() == want


def test_spelling_odd_rows(spark):
    chain = [("receive", 2000), ("recieve", 300), ("recieves", 40), ("recievez", 40), ("recievs", 7), ("lrecieves", 6), ("aaaaaaa", 60), ("aaaaaa", 300), ("aaaaab", 5), ("Überall", 50), ("überall", 9), ("Ueberall", 10), ("a×b÷cdef", 6), ("short", 99), ("*recei", 5)]
    r = random.Random(2)
    bag = [w for w, n in chain for _ in range(n)]
    r.shuffle(bag)
    rows = [(k % 37 if k % 11 else None, r.choice([" ", ", ", "\n", "1"]).join(bag[k * 50 : k * 50 + 50])) for k in range(len(bag) // 50 + 1)]
    rows += [(5, None), (6, ""), (7, "z" * 100_000), (8, "recieve " * 3000), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, t, "w", 1, "b") for i, t in rows], "doc_id bigint, text string, word string, n int, best string").repartition(4)
    got = sorted(tuple(x) for x in spelling.group_variants(docs).collect())
    assert got == brute_words(rows)
    assert {x[0]: x[2] for x in got}["lrecieves"] == "recieve"
    assert spelling.group_variants(docs.limit(0)).count() == 0


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full, members, kids = {}, defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r) for r in df.select(TRIE).collect()), key=repr)


def agree(got, want):
    """Like ==, but shows only what differs."""
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []


def test_trie_on_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    agree(nodes_of(queries.op13_trie(spark, sf_dir)), brute_trie(rows))


@pytest.mark.parametrize("bucket_rows", [20, 50_000])
def test_trie_split_or_whole(spark, bucket_rows):
    """A hot first turn, a hot conversation, copies, long chains, forks at any depth, and odd values."""
    r, rows = random.Random(4), []
    for c in [*range(0, 320, 4), 100, 200, 300, 401]:
        hot = ["hello"] * r.randrange(1, 4) + [f"t{r.randrange(2)}" for _ in range(r.randrange(5))]
        rows += [(c, k, "user", t) for k, t in enumerate(hot)]
    rows += [(c, k, "bot", f"same {k}") for c in (501, 502, 601, 602, 777) for k in range(12)]
    rows += [(902, k, "user", "again") for k in range(60)] + [(903, k, "user", "again") for k in range(40)]
    rows += [(1000, None, None, None), (1000, 0, "user", None), (1000, 0, "user", None), (1001, 5, "a", "ü" * 50_000), (1001, None, "b", "ü"), (1002, 1, "a:", "b"), (1003, 1, "a", ":b"), (None, 1, "x", "y"), (1004, 2, "", "")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, key string, d int").repartition(3)
    agree(nodes_of(trie.prefix_trie(df, bucket_rows)), brute_trie(rows))


def test_trie_of_little(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert nodes_of(trie.prefix_trie(spark.createDataFrame([], schema))) == []
    turnless = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 > 1]
    rows = [(c, 0, "user", "only") for c in turnless]
    agree(nodes_of(trie.prefix_trie(spark.createDataFrame(rows, schema))), brute_trie(rows))
    assert len(brute_trie(rows)) == 1


def test_pairs_helper_agrees():
    """brute_groups() itself, against all pairs of a few texts."""
    texts = chained(12, 30, 4, 9)
    linked = [len(shingles(a) & shingles(b)) * 100 >= 80 * len(shingles(a) | shingles(b)) for a, b in combinations(texts, 2)]
    assert any(linked) and not all(linked)
