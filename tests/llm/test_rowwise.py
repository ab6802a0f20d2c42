"""Operators that look at each row alone: licences, personal data, HTML, packing, sharding."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import html, licenses, packing, pii, shards

ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "x" * 300_000), (5, "same text"), (5, "same text"), (None, "no id"), (7, "Ünï\u0000 İ Σ 한글")]
SCHEMA = "doc_id bigint, text string, h string, i int, s string, k int, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, "c") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def found(spark, text):
    return licenses.scan_licenses(docs(spark, [(1, text)])).first()


def test_licences_by_rule(spark):
    mit = "Copyright X.\n\n" + "\n\n".join(licenses.SENTENCES[k] for k in ("S01", "S02", "S03"))
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    assert found(spark, mit)["rules"] == found(spark, wrapped)["rules"] == "mit-text"
    swapped = "\n\n".join(licenses.SENTENCES[k] for k in ("S03", "S02", "S01"))
    assert found(spark, swapped)["rules"] == "" and found(spark, swapped)["n_sentences"] == 3  # order matters
    r = found(spark, "junk | here\nRELEASED under the  MIT License.\nLicensed under CC BY-NC 4.0.")
    assert (r["licenses"], r["license_class"]) == ("MIT,CC-BY-NC-4.0", "permissive,non-commercial")
    bsd = "\n".join(licenses.SENTENCES[k] for k in ("S15", "S16", "S17", "S18"))
    assert found(spark, bsd)["rules"] == "bsd-3-clause-text"  # it hides the rule that is part of it
    assert found(spark, bsd.rsplit("\n", 1)[0])["licenses"] == "BSD-2-Clause"
    assert found(spark, "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;")["licenses"] == "LGPL-2.1-or-later"
    assert found(spark, "# SPDX-License-Identifier: unheard-of\n")["n_sentences"] == 0


def test_every_licence_sentence_holds_a_cue_and_rules_name_known_ones():
    assert all(re.search(licenses.CUES, s, re.I) for s in licenses.SENTENCES.values())
    assert all(set(r[3]) <= set(licenses.SENTENCES) for r in licenses.RULES)
    assert len({parts for parts, _ in licenses.sentence_names()}) == len(licenses.SENTENCES) == len(licenses.sentence_names())
    assert len({r[0] for r in licenses.RULES}) == len(licenses.RULES)


def test_every_licence_sentence_and_rule_is_found_in_its_own_text(spark):
    def listed(ids, gap, wrap):
        return gap.join(re.sub(r"(.{30}\S*) ", r"\1\n", licenses.SENTENCES[k]) if wrap else licenses.SENTENCES[k] for k in ids)

    cases = [[k] for k in licenses.SENTENCES] + [r[3] for r in licenses.RULES]
    forms = [("\n", False), ("\n\n", False), ("\n\n", True)]  # the last only as wrapped
    rows = [(i * 3 + j, listed(ids, *form)) for i, ids in enumerate(cases) for j, form in enumerate(forms)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, ids in enumerate(cases):
        assert [got[i * 3 + j]["sentence_ids"] for j in range(3)] == [",".join(ids)] * 3
        assert all(got[i * 3 + j]["n_sentences"] == len(ids) for j in range(3))
    for i, r in enumerate(licenses.RULES, len(licenses.SENTENCES)):
        assert all(r[0] in got[i * 3 + j]["rules"].split(",") and r[1] in got[i * 3 + j]["licenses"].split(",") for j in range(3))


def test_licences_match_sql_where_the_texts_hold_them(spark, tmp_path):
    rng, texts = random.Random(5), [None, "", "nothing licensed"]
    for _ in range(400):
        ids = rng.choices(list(licenses.SENTENCES), k=rng.randint(1, 5)) if rng.random() < 0.6 else list(rng.choice(licenses.RULES)[3])
        if rng.random() < 0.3:
            ids.insert(rng.randrange(len(ids) + 1), rng.choice(list(licenses.SENTENCES)))
        texts.append(rng.choice(["\n", "\n\n", "  "]).join(rng.choice(["", "Some words here. "]) + licenses.SENTENCES[k] for k in ids))
    texts.append("Released under the MIT License.\n" * 5000 + licenses.SENTENCES["S15"])
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next((tmp_path / "d").glob("*.parquet"))
    sql = licenses.licenses_sql().replace("FROM documents", f"FROM '{part}'")
    import duckdb

    got = licenses.scan_licenses(spark.read.parquet(str(tmp_path / "d")))
    want = duckdb.sql(sql)
    assert want.columns == got.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_licences_in_a_very_long_text(spark):
    many = "Permission is granted. " + "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n" * 50_000
    r = found(spark, licenses.SENTENCES["S15"] + "\n" + many + licenses.SENTENCES["S18"])
    assert r["n_sentences"] == 50_002 and r["rules"] == ""
    assert found(spark, many + "Released under the MIT License.\n" * 50_000)["licenses"] == "MIT"


def test_parts_of_a_licence_sentence_count_only_together(spark):
    first, second = "This program is free software: ", licenses.SENTENCES["S12"].split(": ", 1)[1]
    assert found(spark, first)["n_sentences"] == found(spark, second)["n_sentences"] == found(spark, f"{first}or not. {second}")["n_sentences"] == 0
    assert found(spark, "Under the GNU License, v. 2.0.")["n_sentences"] == 0 and found(spark, first + first + second)["sentence_ids"] == "S12"


def test_licences_on_odd_rows(spark):
    out = licenses.scan_licenses(docs(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r["n_sentences"] == 0 and r["licenses"] == "" for r in out)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def base(t):
    """The four base kinds by their patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.BASE.index(x[0])))


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(["0", "1", "25", "4", "@", ".", "-", " ", "+", "a", "B", "(", ")", "é", "İ", "@a.b", "4111 1111 1111 1111", "+1 555", "256."]), max_size=24).map("".join))
def test_base_spans_equal_their_patterns(t):
    assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == base(t)


def test_added_spans():
    t = "see HTTPS://a.example.com/x?y=1). token = \"0123456789abcdef01\" IBAN: GB82 WEST 1234 5698 7654 32 end"
    assert [(k, t[s:e]) for k, s, e in pii.find_spans(t) if k not in pii.BASE] == [("url", "HTTPS://a.example.com/x?y=1"), ("secret", "0123456789abcdef01"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert pii.redact("a@b.co or +1 (555) 010-2030") == "<EMAIL> or <PHONE>"


def test_pii_on_odd_rows(spark):
    out = pii.find_pii(docs(spark, [*ODD, (9, "a@b.co " * 20_000)])).collect()
    assert len(out) == len(ODD) + 1 and max(r["n_email"] for r in out) == 20_000
    none = {r["base_sha256"] for r in out if not r["n_email"]}
    assert none == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert pii.find_pii(empty(spark)).count() == 0


def test_time_grows_with_the_text_alone():
    """Texts of a megabyte that would take hours if each anchor or tag looked at the whole of them."""
    start = time.perf_counter()
    for t in ("http://." * 125_000, "token" * 200_000, "_token" * 80_000 + "=" + "a" * 500_000, "a@" * 500_000, "1." * 500_000, "+1" * 500_000):
        assert all(s[0] in ("url", "phone", "ip") for s in pii.find_spans(t))
    for p in ("<b>" * 130_000 + "</i>" * 130_000, "<i><div>" + "<b>" * 130_000 + "</i>" * 130_000, "<!x" * 300_000, "<p " + "data-" * 200_000 + ">x", '<a "' * 250_000):
        assert len(html.parse(p)) < 10
    assert len(html.parse("<div>" * 200_000 + "x")) == 200_001 and len(html.parse("<ul>" * 20_000 + "<li>x" * 20_000)) == 40_001
    assert time.perf_counter() - start < 60


def test_main_text_of_held_out_pages():
    maker, right, n = html.Maker(4242), 0, 150
    for _ in range(n):
        page = maker.page()
        marked = [x for x in html.in_page_order(html.parse(page)) if any("\x02" in p for p in x.pieces)]
        want = "\n".join(" ".join(re.sub("[\x02\x03]", "", html.html.unescape("".join(x.pieces))).split()) for x in marked)
        right += html.extract([re.sub("[\x02\x03]", "", page)], html.trained())[0] == want
    assert right >= 0.85 * n


def test_pages(spark, sf_dir):
    rows = html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_on_odd_pages(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    odd = [None, "", "plain text only", "<", "<p", "<a <b <i", "<!-- open", "<div>" * 3000 + "deep", "<p>a<p>b" * 5000, "<article><h1>T</h1><p>one &amp; two\n\n three<script>var x='<p>no'</script></p><ul><li>x<li>y</ul><footer>f</footer></article>", "</div></p></article>", '<p title="a>b">x</p>']
    df = spark.createDataFrame([(i, "u", h, "a", "b") for i, h in enumerate(odd)], schema)
    out = {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()}
    assert len(out) == len(odd) and out[0] == out[1] == "" and out[9].split("\n")[:2] == ["T", "one & two three"]
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0


BODY = "Heavy rain closed the mountain road on Monday. Crews expect to clear the slide by the end of the week, said the county."
MORE = "Drivers are asked to use the valley road. The detour takes about forty minutes longer than the usual way."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>'
LAYOUTS = [
    f"<html><head><title>T</title></head><body><nav>{MENU}</nav><main><article><h1>Road closed</h1><p>{BODY}</p><p>{MORE}</p></article></main><footer>&copy; 2024 The Paper</footer></body></html>",
    f'<html><body><div id="header"><a href="/">The Paper</a></div><div class="menu">{MENU}</div><div id="content"><div class="post"><h1>Road closed</h1><p>{BODY}</p><p>{MORE}</p></div></div><div class="sidebar"><h3>Popular</h3>{MENU}</div><div class="footer">All content is ours. Contact us.</div></body></html>',
    f"<!doctype html><html><head><title>T</title><meta charset=utf-8><article><h1>Road closed</h1><p>{BODY}</p><p>{MORE}</p></article><footer>&copy; 2024</footer>",
    f'<head><title>T</title>\n<div class="cookie-banner"><p>We use cookies to make this site better.</p><button>OK</button></div><article><h1>Road closed</h1><p>{BODY}<p>{MORE}</article>',
    f'<body><div class="ad">Buy two, get one free today</div><article class="story"><h1>Road closed</h1><p>{BODY}</p><div class="ad-slot"><a href="x">Sponsored: cheap tyres</a></div><p>{MORE}</p></article><section id="comments"><h3>Comments</h3><div class="comment"><b>ann</b><p>I drove there last week and it was awful.</p></div></section></body>',
    f'<body><header><h1>The Paper</h1></header><article><h1>Road closed</h1><p>{BODY}</p><p>{MORE}</p></article><form class="newsletter"><p>Get our letter every morning</p><input name=mail><button>Subscribe</button></form><aside><h3>Related</h3>{MENU}</aside></body>',
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts_written_by_hand(page):
    assert html.extract([page], html.trained()) == ["\n".join(["Road closed", BODY, MORE])]


def test_nodes_features_and_choice_equal_plain_ones():
    """Subtree sums, sibling statistics and the best choice along the tree, each made the slow way."""
    rng, maker = random.Random(6), html.Maker(77)
    for _ in range(25):
        nodes = html.parse(re.sub("[\x02\x03]", "", maker.page()))
        rows = html.measure(nodes)

        def below(n):
            return [n, *[x for c in n.children for x in below(c)]]

        for n, row in zip(nodes, rows, strict=True):
            size = sum(x.size for x in below(n))
            beside = n.parent.children if n.parent else [n]
            sizes = [sum(x.size for x in below(s)) for s in beside]
            want = {0: np.log1p(size), 8: np.log1p(len(below(n))), 9: (beside.index(n) if n.parent else 0) / len(beside), 10: np.log1p(len(beside)), 11: sum(s.tag == n.tag for s in beside) / len(beside), 12: np.log1p(sum(sizes) / len(beside)), 13: size / max(1, *sizes), 14: size / max(1, sum(x.size for x in nodes))}
            assert all(abs(row[k] - x) < 1e-9 for k, x in want.items())
        logits = np.array([rng.uniform(-3, 3) for _ in nodes])

        def best(n, i=dict((id(x), k) for k, x in enumerate(nodes))):  # noqa: B006
            own = 0.0 if n is nodes[0] else float(logits[i[id(n)]])
            return own + sum(max(0.0, best(c)) for c in n.children)

        keep = html.decode(nodes, logits)
        chosen = {id(n) for n, k in zip(nodes, keep, strict=True) if k}
        assert all(n.parent is None or id(n.parent) in chosen for n in nodes if id(n) in chosen)
        assert abs(sum(x for n, x in zip(nodes[1:], logits[1:], strict=True) if id(n) in chosen) - best(nodes[0])) < 1e-6


def test_tree_scores_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 6)), rng.integers(0, 2, 400).astype(float)
    model = html.fit_trees(x, y, trees=7)
    for row, got in zip(x, model.logits(x), strict=True):
        want = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            want += leaf[at - len(feature)]
        assert abs(got - want) < 1e-9


def test_a_dropped_ancestor_drops_all_below():
    nodes = html.parse("<div><nav><p>in</p></nav><p>out</p></div>")
    names = [n.tag for n in nodes]
    keep = html.decode(nodes, np.array([{"nav": -5.0, "p": 2.0}.get(t, 1.0) for t in names]))
    assert [n.text or n.tag for n, k in zip(nodes, keep, strict=True) if not k] == ["nav", "p"]


def check_packed(rows, tokens):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["context"], r["step_group"]))
    for key, parts in pieces.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and length > 0 and total == len(tokens[key])
            assert crc == zlib.crc32(np.array(tokens[key][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(tokens[key])
    steps, used = defaultdict(set), defaultdict(int)
    for key, parts in sequences.items():
        at = 0
        for offset, length, context, step in sorted(parts):
            assert offset == at
            at += length
            steps[step].add((key, context))
        assert at == context and context & (context - 1) == 0 and context <= 4096  # full, so nothing is padded
    for step, members in steps.items():
        used[step >> packing.ID_BITS] += sum(c for _, c in members) < packing.STEP_TOKENS
        assert sum(c for _, c in members) <= packing.STEP_TOKENS
    assert max(used.values()) <= 1  # of a task's step groups, all but one hold as many tokens
    assert set(pieces) == set(tokens)


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 2] for r in df.collect()}
    check_packed(packing.pack_documents(df.repartition(3)).collect(), tokens)


def test_packing_on_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, x) for i, x in ODD if i not in (5, None)]
    tokens = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    check_packed(packing.pack_documents(docs(spark, rows)).collect(), tokens)
    assert packing.pack_documents(docs(spark, ODD)).count() >= len(ODD)
    assert packing.pack_documents(empty(spark)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\x0b\x85\xa0 　\x1cabcAÉéH̱.'s1²ΣςİıͅΑßẞ한ﬁ!?*_-|<", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "***", "'.", ".'s", "Word"]), max_size=25).map("".join))
def test_words_give_the_tokenizers_ids(text):
    encode = packing.encoder(packing.default_tokenizer())
    assert next(iter(encode([text]))).tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def one_by_one(key: int, shards_: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < shards_:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    rng = random.Random(3)
    keys = np.array([rng.randint(-(2**63), 2**63 - 1) for _ in range(3000)] + [0, 1, -1], np.int64)
    for n in (1, 2, 8, 9, 100):
        assert shards.jump_hash(keys, n).tolist() == [one_by_one(int(k), n) for k in keys]
    a, b = shards.jump_hash(keys, 8), shards.jump_hash(keys, 9)
    assert set(b[a != b]) == {8} and abs((a != b).mean() - 1 / 9) < 0.03
    with pytest.raises(ValueError):
        shards.jump_hash(keys, 0)


def test_shards(spark):
    rows = [*ODD, *[(i, f"t{i}é") for i in range(100, 1500)]]
    out = shards.shard_rows(docs(spark, rows), chunks=16).collect()
    assert len(out) == len(rows)
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == want
    for r in out:
        assert r["shard"] == one_by_one(r["doc_id"] or 0, 8) and r["grown_shard"] == one_by_one(r["doc_id"] or 0, 9) and r["law"] == "key"
    for k in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert shards.shard_rows(empty(spark)).count() == 0
