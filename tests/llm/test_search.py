"""Nearest neighbours, near duplicates, decontamination, HTML extraction, the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.llm import ann, decontaminate, near_duplicates, words, wrappers
from drawlake.llm.components import components

ODD = [(None, "no id", "s"), (900, None, "s"), (901, "", "s"), (902, "   \n\n ", None), (903, "x" * 50_000, "s"), (904, "one two", "s"), (904, "one two", "s"), (None, None, None)]


def test_ann_against_brute_force(spark):
    r = np.random.Generator(np.random.PCG64(1))
    centers = r.normal(size=(20, 32)) * 3
    x = (centers[r.integers(0, 20, 1500)] + r.normal(size=(1500, 32))).astype(np.float32)
    x[700:1100] = x[700]  # one vector shared by many
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(1500)]
    bad = [(2000, None, "c"), (2100, [0.0] * 32, "c"), (2200, [float("nan")] + [1.0] * 31, "c"), (2300, [None] + [1.0] * 31, "c"), (2400, [float("inf")] + [1.0] * 31, "c"), (None, [1.0] * 32, "c"), (2500, [1.0], "c"), (2501, [3.0], "c"), rows[100]]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, list string")
    out = ann.search(df, F.col("vec_id") % 50 == 0, k=10, block=16).collect()
    got = defaultdict(list)
    for y in sorted(out, key=lambda y: (y["query_id"], y["rank"])):
        got[y["query_id"]].append((y["vec_id"], y["score"]))
        assert y["rank"] == len(got[y["query_id"]])
    assert got.pop(2500) == [(2501, 2.0)]  # vectors of another length are searched among themselves
    assert sorted(got) == list(range(0, 1500, 50))
    recall = []
    d64 = x.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        recall.append(len(set(order) & {i for i, _ in found}) / 10)
        assert all(s == pytest.approx(d[i], rel=1e-12, abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda z: (z[1], z[0]))
        if 700 <= q < 1100:
            assert [i for i, _ in found] == order
    assert np.mean(recall) >= 0.9
    few = ann.search(spark.createDataFrame(rows[:4], df.schema), F.col("vec_id") % 2 == 0, k=10).collect()
    assert Counter(y["query_id"] for y in few) == {0: 3, 2: 3}
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_keeps_doubles(spark):
    far = 2.0**30
    rows = [(0, [far, 1.0]), (1, [far, 2.0]), (2, [far + 1, 1.0 + 1e-9]), (3, [far, 1.0 + 1e-12])]
    out = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    assert [(y["vec_id"], y["score"]) for y in sorted(out, key=lambda y: y["rank"])] == [(3, 1.0 + 1e-12 - 1), (1, 1.0), (2, float(np.hypot(1, 1 + 1e-9 - 1)))]


def searched(x, target=ann.TARGET, queries=100):
    """Recall@10 through tables and reranking, and the shares of vectors whose codes and whose vectors are read."""
    index = ann.fit(x[:20_000], len(x), target)
    at, codes = ann.encode(index, x)
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(len(index.coarse) * len(index.fine) + 1))
    recall, read, kept = [], [], []
    asked = np.arange(0, len(x), max(1, len(x) // queries))
    for q, lists in zip(asked, index.probed(x[asked]), strict=True):
        ids, scores = [], []
        for c in lists:
            own = order[start[c] : start[c + 1]]
            if len(own):
                _, found, score = ann.rank_codes(index, c, x[q : q + 1], codes[own], ann.RERANK)
                ids.append(own[found])
                scores.append(score)
            read.append(len(own) / len(x))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        best = ids[np.argsort(scores)[: ann.RERANK]]
        kept.append(len(best) / len(x))
        near = best[np.argsort(((x[best] - x[q]) ** 2).sum(1))][:11]
        true = np.argsort(((x - x[q]) ** 2).sum(1))[:11]
        recall.append(len(np.intersect1d(near, true)) / 11)
    return np.mean(recall), np.sum(read) / len(asked), np.mean(kept)


def test_ann_reads_few_vectors_where_vectors_have_clusters():
    r = np.random.Generator(np.random.PCG64(2))
    centers = r.normal(size=(300, 32)) * 2
    x = (centers[r.integers(0, 300, 30_000)] + r.normal(size=(30_000, 32))).astype(np.float32)
    recall, codes, vectors = searched(x)
    assert recall >= 0.9 and codes <= 0.2 and vectors <= 0.01


def test_ann_recall_on_the_test_vectors():
    """The test vectors are spread evenly over a sphere, where lists can't separate them: codes of half are read, few vectors."""
    import duckdb

    found = duckdb.connect().execute("select embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchnumpy()["embedding"]
    x = np.unique(np.array([v for v in found if v is not None and len(v) == 64], np.float32), axis=0)
    recall, codes, vectors = searched(x)
    assert recall >= 0.9 and codes <= 0.65 and vectors <= 0.05


def test_ann_lists_grow_beyond_the_sample():
    r = np.random.Generator(np.random.PCG64(3))
    x = r.normal(size=(800, 8)).astype(np.float32)
    index = ann.fit(x, 10**6)
    assert len(index.coarse) == 100 and len(index.fine) == 40
    centers = np.array([index.center(c) for c in range(4000)])
    exact = ((x[:5, None, :] - centers[None]) ** 2).sum(2)
    assert np.allclose(index.distances(x[:5]) + (x[:5] ** 2).sum(1)[:, None], exact, atol=1e-3)


def test_best_codes_are_kept():
    owner, entry, score = ann.best_of(np.array([2, 1, 2, 2, 1]), np.array([5, 6, 7, 8, 9]), np.array([3.0, 1, 1, 2, 1]), 2)
    assert list(zip(owner, entry, score, strict=True)) == [(1, 6, 1), (1, 9, 1), (2, 7, 1), (2, 8, 2)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links[:-2]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {n for a, b in links[:-2] if a != b for n in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_near_duplicates_against_brute_force(documents, prose, monkeypatch):
    monkeypatch.setattr(near_duplicates, "NODE_BLOCK", 40)
    monkeypatch.setattr(near_duplicates, "TEXT_BLOCK", 30)
    r = random.Random(9)
    base = prose(120).split()
    rows = [(i, prose(r.randrange(1, 60)), "s") for i in range(150)]
    for i in range(160):  # one group of near copies, and chains that end outside of it
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w), "s"))
    rows += [(2000 + i, rows[i][1].upper() + "!!", "s") for i in range(30)] + ODD + [(7, "another text of that id entirely", "s")]
    got = near_duplicates.near_duplicates(documents(rows)).collect()
    found, at = words.hashes([t for _, t, _ in rows])
    sets = [set(words.shingles(found[a:b]).tolist()) if d is not None else set() for (d, _, _), a, b in zip(rows, at[:-1], at[1:], strict=True)]
    n_links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                n_links[i] += 1
                n_links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    want = []
    for own in classes.values():
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        want += [repr((rows[i][0], least, n_links[i])) for i in own]
    assert sorted(repr(tuple(x)[:3]) for x in got) == sorted(want)
    kept = near_duplicates.keep_one(documents(rows))
    assert kept.columns == documents([]).columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(Counter(c for c in (min((rows[i][0] for i in own if rows[i][0] is not None), default=None) for own in classes.values()) if c is not None).elements())
    assert ids.count(None) == 2
    assert near_duplicates.near_duplicates(documents([])).count() == 0


def test_edited_sets_stand_at_the_threshold():
    r = np.random.Generator(np.random.PCG64(5))
    assert near_duplicates.smallest_pair(0.8) == 4
    for n in range(4, 200):
        own = np.arange(n, dtype=np.uint64)
        e = near_duplicates.edited(own, 0.8, r)
        both = len(np.intersect1d(own, e))
        assert both / (2 * n - both + len(e) - n) >= 0.8 - 1e-9
        lost = n - both
        assert lost == 0 or (n - lost - 1) / (n + lost + 1) < 0.8


def test_measured_depths():
    r = np.random.Generator(np.random.PCG64(6))
    sets = [np.sort(r.integers(0, 2**64, n, dtype=np.uint64)) for n in [2, 3, 10, 40, 100, 300, 2000] * 40]
    depths = near_duplicates.measured_depths(sets, 0.8, 30, 8, 0.999)
    assert len(depths) == len(near_duplicates.SIZES) + 1 and all(5 <= d <= 8 for d in depths)
    assert near_duplicates.measured_depths(sets, 0.95, 30, 8, 0.999) == [8] * 4  # what is measured sets the depth
    assert max(near_duplicates.measured_depths(sets, 0.8, 5, 8, 0.999)) < min(depths)
    assert near_duplicates.measured_depths([], 0.8, 30, 8, 0.999) == [1] * 4


def test_trie_pairs_meet_once_at_their_longest_prefix():
    r = np.random.Generator(np.random.PCG64(7))
    group = np.sort(r.integers(0, 3, 300))
    keys = np.array([int.from_bytes(bytes(r.integers(0, 3, 4, dtype=np.uint8)), "big") for _ in range(300)], np.uint64)
    order = np.lexsort((keys, group))
    keys, reach = keys[order], r.integers(2, 5, 300)
    level = np.array([near_duplicates._levels(k ^ keys, 4) for k in keys])
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and level[i, j] >= max(2, min(reach[i], reach[j]))}
    got, before = [], 5
    for i, j in near_duplicates.trie_pairs(group, keys, reach, 4, 2, most=50):
        got += zip(i.tolist(), j.tolist(), strict=True)
        assert len(set(level[i, j])) == 1 and level[i[0], j[0]] <= before  # from the longest prefix upwards
        before = level[i[0], j[0]]
    assert len(got) == len(set(got)) and set(got) == want


def test_recall_on_test_documents():
    """All pairs of a part of sf0.1 that reach the threshold meet in the forest."""
    import duckdb

    texts = [t for (t,) in duckdb.connect().execute("select text from '/root/testdata/sf0.1/documents.parquet' where doc_id < 4000").fetchall()]
    found, at = words.hashes(texts)
    sets = {s.tobytes(): s for a, b in zip(at[:-1], at[1:], strict=True) if len(s := words.shingles(found[a:b]))}
    sets = list(sets.values())
    depths = near_duplicates.measured_depths(sets, 0.8, 30, 8, near_duplicates.TARGET_RECALL)
    signature = near_duplicates.labels(sets, 30, 8)
    reach = np.array(depths)[np.digitize([len(s) for s in sets], near_duplicates.SIZES)]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders[x].append(i)
    shared = Counter((i, j) for own in holders.values() for k, i in enumerate(own) for j in own[k + 1 :])
    links = [(i, j) for (i, j), c in shared.items() if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9]
    one, two = np.array(links).T
    level = near_duplicates.shared_prefix(signature[one], signature[two], 30, 8).max(1)
    assert len(links) > 10 and (level >= np.minimum(reach[one], reach[two])).all()


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_smith_waterman():
    r = np.random.Generator(np.random.PCG64(3))
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)).astype(np.uint64), r.integers(0, 4, r.integers(1, 25)).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == smith_waterman(a, b)


def test_decontamination_equals_exhaustive_alignment(spark, sf):
    """Every document aligned with every item."""
    from drawlake.llm.common import table

    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    pairs = {}
    for d in docs.collect():
        body, _ = words.hashes([d["text"]])
        for b in bench.collect():
            item, _ = words.hashes([b["text"]])
            score = decontaminate.align(item, body)[0] / (decontaminate.MATCH * len(item)) if len(item) else 0
            if score >= decontaminate.THRESHOLD:
                pairs[d["doc_id"], b["item_id"]] = score
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.leaks(docs, bench).collect()}
    assert len(pairs) > 0 and got == pytest.approx(pairs)


def test_decontamination(spark, documents, prose):
    r = random.Random(10)
    items = [(i, " ".join(f"q{i}w{k}" if k % 3 else prose(1) for k in range(r.randrange(15, 50)))) for i in range(25)] + [(100, "zz yy"), (101, ""), (102, None)]
    rows, want = [], set()
    for i in range(200):
        text = prose(80)
        if i % 5 == 0:
            item = items[r.randrange(25)]
            w = item[1].split()
            if i % 10:  # an edited copy
                for _ in range(len(w) // 10):
                    w[r.randrange(len(w))] = "changed"
                del w[r.randrange(len(w))]
                w.insert(r.randrange(len(w)), "more")
            text = f"{prose(20)}. {' '.join(w).upper() if i % 15 else ' '.join(w)}, {prose(20)}"
            want.add((i, item[0]))
        rows.append((i, text, "s"))
    rows += [(300, f"{prose(5)} zz yy {prose(5)}", "s"), *ODD]
    want.add((300, 100))
    docs, bench = documents(rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()} == want
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench, block_words=100).collect()} == want
    clean = decontaminate.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(documents([]), bench).count() == 0


SHELL = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>if (a<b) x='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- <p>no</p> --><div class=\"cookie-notice\">We use cookies.</div>{main}"
    "<aside class=sidebar><p>Read more</p></aside><form><label>Mail</label><input></form><section id='comments'><article><p>First!</p></article></section><footer>&copy; {host}</footer></body></html>"
)


def test_extraction_with_an_article(spark):
    body = "<article><h1>A  head\n</h1><p>One <b>bo</b>ld &lt;x&gt; &eacute;.<br>Two</p><p>Three <a href=x>link</a><ul><li>i<li>ii</ul><div class='advert'>Buy</div><p title='a > b'>Four</article>"
    rows = [(1, "http://h.example/a", SHELL.format(main=body, host="h"), "x"), (2, "http://h.example/b", SHELL.format(main="<article><p>Other</p></article>", host="h"), "x"), (3, None, None, "x"), (4, "odd", "", "x"), (5, "http://H.example/c", "plain <", "x"), (5, "http://H.example/c", "plain <", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = sorted((x["page_id"], x["text"], x["host"]) for x in wrappers.extract(df).collect())
    assert got == [(1, "A head One bold <x> é. Two Three link i ii Four", "x"), (2, "Other", "x"), (3, "", "x"), (4, "", "x"), (5, "plain <", "x"), (5, "plain <", "x")]
    assert wrappers.main_texts(df.limit(0)).count() == 0


def test_extraction_without_an_article_uses_what_differs(spark):
    rows = [(i, f"https://n.example/{i}", SHELL.format(main=f"<div class=wrap><div class=tagline>The same everywhere</div><div class=body><p>Story {i} begins.</p>{'<p>It goes on.</p>' * (i % 4)}</div></div>", host="n")) for i in range(12)]
    got = {x["page_id"]: x["text"] for x in wrappers.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: " ".join([f"Story {i} begins."] + ["It goes on."] * (i % 4)) for i in range(12)}


def test_names_of_containers():
    apart = lambda html: wrappers._element(*html)[1]
    assert not any(apart(x) for x in (("body", ' class="page has-sidebar"'), ("div", ' class="with-sidebar"'), ("div", ' class="section-header"'), ("article", ' class="post share"'), ("div", ' id="content"'), ("div", ' class="platform"')))
    assert all(apart(x) for x in (("div", ' class="site-header"'), ("div", " id=footer"), ("article", ' class="comment"'), ("div", ' class="ad-slot-3"'), ("p", " hidden"), ("div", ' style="display: none"'), ("div", ' role="search"'), ("aside", "")))


def shape(node):
    own = node.key if node.kind != "e" else f"{node.key}[{' '.join(map(shape, node.items))}]"
    own = f"({' '.join(map(shape, node.items))})" if node.kind == "g" else own
    return own + "+" * node.repeats + "?" * node.optional


def test_wrappers_align_and_fold():
    a, b = (wrappers.wrapper_of(h) for h in ("<ul><li>x<li>y<li>z</ul><p>t</p>", "<ul><li>x</ul><div>d</div><p>t</p>"))
    merged = wrappers.merge(a, b)
    assert shape(merged) == "[ul[li[#]+] div[#]? p[#]]"
    assert shape(wrappers.merge(merged, wrappers.wrapper_of("<ul><li>q</ul><p>t</p>"))) == shape(merged)
    rows = "".join(f"<dt>{i}</dt><dd>d</dd>" for i in range(4))
    assert shape(wrappers.wrapper_of(f"<dl>{rows}</dl>")) == "[dl[(dt[#] dd[#])+]]"
    assert shape(wrappers.merge(wrappers.wrapper_of("<dl><dt>a</dt><dd>b</dd></dl>"), wrappers.wrapper_of(f"<dl>{rows}</dl>"))) == "[dl[(dt[#] dd[#])+]]"
    for node in (merged, wrappers.wrapper_of(f"<dl>{rows}</dl>")):
        assert wrappers.Node.load(node.dump()).dump() == node.dump()


def folded(pages, merge=wrappers.merge):
    node = wrappers.wrapper_of(pages[0])
    for p in pages[1:]:
        node = merge(node, wrappers.wrapper_of(p))
    return wrappers.Parser(node)


def site(prose, r, n=30):
    """Pages of a host without article elements or telling names, and what is their main text."""
    pages, want = [], []
    for i in range(n):
        paras = [prose(r.randrange(20, 60)) for _ in range(r.randrange(1, 5))]
        lead = f"<div class=q>{prose(12)}</div>" if i % 2 else ""
        menu = "".join(f"<li><a href=/{k}>{prose(1)}</a>" for k in range(r.randrange(1, 6)))
        side = f"<div class=s><p>{prose(3)}</p></div>" if i % 3 else ""
        pages.append(
            f"<html><body><div class=a><ul>{menu}</ul></div>{side}<div class=b><h2>Story of {i}</h2><h4>Written for you</h4>{lead}"
            + "".join(f"<p>{x}</p>" for x in paras)
            + f"</div><div class=c>{prose(4)}</div><div class=d>All rights</div></body></html>"
        )
        want.append(" ".join([f"Story of {i}", *([lead[13:-6]] if lead else []), *paras]))
    return pages, want


def test_wrapper_finds_the_article_without_names_or_article_elements(prose, monkeypatch):
    for name in ("APART_WORDS", "ARTICLE_APART", "ARTICLE", "APART_ROLES"):
        monkeypatch.setattr(wrappers, name, set())
    wrappers._element.cache_clear()
    pages, want = site(prose, random.Random(3))
    parser = folded(pages)
    assert parser.main.key == "div.b" and [parser.text(p) for p in pages] == want
    # The result is the alignment's: without it, or without folding, texts change.
    alone = folded(pages, lambda a, b: a)
    assert sum(alone.text(p) != w for p, w in zip(pages, want, strict=True)) > len(pages) / 2
    monkeypatch.setattr(wrappers, "align", lambda a, b: [*a, *b])
    assert any(folded(pages).text(p) != w for p, w in zip(pages, want, strict=True))
    monkeypatch.undo()
    wrappers._element.cache_clear()


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark, prose, monkeypatch):
    pages, want = site(prose, random.Random(4), 24)
    other, _ = site(prose, random.Random(5), 24)
    rows = [x for i in range(24) for x in ((i, f"http://a.example/{i}", pages[i]), (100 + i, f"http://b.example/{i}", other[i].replace("class=b", "class=z")))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for most in (1, 256):  # one host at a time, two hosts sharing a task
        monkeypatch.setattr(wrappers, "MOST_HOSTS", most)
        for size in (0, 1 << 20):
            got = {x["page_id"]: x["text"] for x in wrappers.extract(df, broadcast_bytes=size).collect()}
            assert [got[i] for i in range(24)] == want


def test_pages_are_read_by_the_wrapper(spark, sf):
    """At sf0.1 no class names, roles or article elements are needed on any host; its texts are the SQL's."""
    import duckdb

    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    want = {i: t for i, _, t, _ in con.execute(wrappers.TEST_PAGES_SQL).fetchall()}
    hosts = defaultdict(list)
    for i, url, html in con.execute("select page_id, url, coalesce(html, '') from pages").fetchall():
        hosts[url.split("/")[2].lower()].append((i, html.replace("<article>", "<div>").replace("</article>", "</div>")))
    for own in hosts.values():
        parser = folded([h for _, h in own])
        if parser.told:
            assert [parser.text(h) for _, h in own] == [want[i] for i, _ in own]


def test_broken_markup():
    for page in ("<p", "<!-- x", "<script>x", "<a href='", "a <b c", "</", "<" * 500, "<p>" * 2000, "<div>" * 5000 + "deep", "&#x110000; &bogus;", "<i></i>" * 3000):
        wrappers.article_text(page, None)
        wrappers.read_page(page)
        wrappers._dumped(wrappers.merge(wrappers.wrapper_of(page), wrappers.wrapper_of("<div>" * 300 + "x")))
    assert wrappers.article_text("<div>" * 5000 + "deep", None) == "deep"
    assert [s.text for s in wrappers.texts_of(wrappers.read_page("<p>a <!-- b --> c</p><p>d"))] == ["a c", "d"]


def test_extraction_tells_hidden_from_plain_texts_of_one_path(spark):
    one = "<article><p hidden>x</p><p>text</p><div class='a b c advert'>Buy</div><div class='a b c'>more</div></article>"
    rows = [(i, f"http://h.example/{i}", one if i % 2 else f"<article><p>plain {i}</p></article>") for i in range(6)]
    for order in (rows, rows[::-1]):
        got = wrappers.main_texts(spark.createDataFrame(order, "page_id bigint, url string, html string").coalesce(1)).collect()
        assert {x["page_id"]: x["text"] for x in got} == {i: "text more" if i % 2 else f"plain {i}" for i in range(6)}


def test_keep_one_drops_rows_rather_than_ids(documents, prose):
    copied, other = prose(40), prose(40)
    rows = [(1, copied, "s"), (5, copied, "s"), (5, other, "s"), (6, other, "s")]
    assert sorted((x["doc_id"], x["text"]) for x in near_duplicates.keep_one(documents(rows)).collect()) == [(1, copied), (5, other)]
