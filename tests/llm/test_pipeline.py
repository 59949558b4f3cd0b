"""The corpus pipeline against plain Python, stage by stage, and its odd rows."""

import hashlib
from collections import Counter, defaultdict

from drawlake.llm import decontaminate, line_dedup, near_duplicates, toxicity, words
from drawlake.llm.common import table


def plain_lines(docs):
    pages, counts = Counter(), Counter()
    for source, text in {(d["source"], d["text"]) for d in docs}:
        pages[source] += 1
        counts.update((source, line) for line in {x.strip(" ") for x in (text or "").split("\n")} - {""})
    for d in docs:
        if d["text"] is not None:
            kept = [x for x in d["text"].split("\n") if not (x.strip(" ") and counts[d["source"], x.strip(" ")] > max(1, line_dedup.RATIO * pages[d["source"]]))]
            yield d | {"text": "\n".join(kept)}
        else:
            yield d


def plain_copies(docs):
    found, at = words.hashes([d["text"] for d in docs])
    sets = [frozenset(words.shingles(found[a:b]).tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((i, j) for own in holders.values() for k, i in enumerate(own) for j in own[k + 1 :])
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), c in shared.items():
        if c >= near_duplicates.SIMILARITY * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    return [d for i, d in enumerate(docs) if not sets[i] or least[find(i)] == d["doc_id"]]


def test_pipeline_equals_plain_python(spark, vocabulary, sf):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = [d.asDict() for d in table(spark, sf, "documents").orderBy("doc_id").collect()]
    model = toxicity.fit_on_folds(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scanner = model.scanner()
    score = lambda t: 1 / (1 + 2.718281828459045 ** -(scanner.emitted(t) @ model.weights))
    left = [d for d in docs if score(d["text"]) < toxicity.THRESHOLD]
    left = plain_copies(list(plain_lines(left)))
    items = [words.hashes([b["text"]])[0] for b in table(spark, sf, "benchmark").collect()]

    def clean(d):
        body = words.hashes([d["text"]])[0]
        return not any(len(i) and decontaminate.align(i, body)[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(i) for i in items)

    left = [d for d in left if clean(d)]
    t = Tokenizer.from_file(vocabulary)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d in left:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, sf).collect()}
    assert 0 < len(got) < len(docs) and got == want


def test_stages_and_odd_rows(spark, sf, prose):
    """Nulls in every column, empty and long texts, repeated rows, columns of clashing and dotted names."""
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, n_dropped int, `a.b` string, score string, ids string, node string, decoded string"
    extra = ("L", 7, "dot", "s", "i", "n", "d")
    long = prose(20_000)
    plain = [(1, "you idiot, you moron", "en", "s", 20), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id", "en", "s", 5), (4, long, "en", "t", len(long)), (5, "one two three four five six", "en", "s", 27), (5, "one two three four five six", "en", "s", 27), (None, None, None, None, None)]
    plain = [(x[0] and 10**9 + x[0], *x[1:]) for x in plain]  # ids that no label names
    docs = spark.createDataFrame([(*x, *extra) for x in plain], schema)
    kept = [x for x in plain if x[0] != 10**9 + 1]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = sorted(out.collect(), key=repr)
        assert all(tuple(r)[5:] == extra for r in rows)
        if name == "toxicity":
            assert sorted(repr(tuple(r)[:5]) for r in rows) == sorted(map(repr, kept))
        elif name == "near duplicates":
            assert Counter(r["doc_id"] for r in rows) == Counter({x[0]: 1 for x in plain} | {None: 2})
        else:
            assert Counter(r["doc_id"] for r in rows) == Counter(x[0] for x in plain)
            assert [r["text"] for r in rows if r["doc_id"] == 10**9 + 4] == [long]
        assert stage(spark, docs.limit(0), sf).count() == 0
    coded = corpus_pipeline.encode(spark, docs, sf).collect()
    assert len(coded) == len(plain) and {x["n_tokens"] for x in coded if x["doc_id"] in (10**9 + 2, 10**9 + 3)} == {0}
    assert corpus_pipeline.encode(spark, docs.limit(0), sf).count() == 0


def test_pipeline_keeps_the_lines_of_a_group_of_copies(spark, documents, sf):
    import corpus_pipeline

    copy = "the text of the copies\nin two lines of its own"
    rows = [(i, copy if i < 30 else f"page {i} says this\nfooter", "a") for i in range(300)]
    docs = documents(rows).cache()
    out = {x["doc_id"]: x["text"] for x in corpus_pipeline.drop_lines(spark, docs, sf).collect()}
    assert all(out[i] == copy for i in range(30)) and all(out[i] == f"page {i} says this" for i in range(30, 300))
    assert [x["doc_id"] for x in corpus_pipeline.drop_copies(spark, docs, sf).where("doc_id < 30").collect()] == [0]
