"""Line dedup, chat formatting, secret scans."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from drawlake.llm import chat_format, line_dedup, secret_scan
from drawlake.llm.queries import ORACLE_SQL, QUERIES

ODD = [(None, "no id", "s"), (900, None, "s"), (901, "", "s"), (902, "   \n\n ", None), (903, "x" * 50_000, "s"), (904, "one two", "s"), (904, "one two", "s"), (None, None, None)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op7_line_dedup", "op8_chat_format", "op10_secret_scan"])
def test_native_plans_hold_no_python(name, spark, sf):
    assert not re.search("Python|Pandas|Arrow", plan_of(QUERIES[name](spark, sf)))


def test_line_dedup(documents):
    r = random.Random(2)
    rows = [(i, "\n".join([f"own {i}", "  footer " if i % 2 else f"body {r.randrange(10**6)}", "footer", "", "twice", "twice"][: 3 + i % 4]), "a" if i % 3 else "b") for i in range(60)] + ODD
    pages, counts = {}, {}
    for t, s in dict.fromkeys((t, s) for _, t, s in rows):
        pages[s] = pages.get(s, 0) + 1
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            counts[s, line] = counts.get((s, line), 0) + 1
    for size in (0, 1 << 20):
        got = {}
        for x in line_dedup.drop_boilerplate(documents(rows), ratio=0.3, broadcast_bytes=size).collect():
            got.setdefault((x["doc_id"], x["source"]), []).append((x["text"], x["n_lines"], x["n_dropped"], x["lines"]))
        for d, t, s in rows:
            if t is None:
                assert (None, 0, 0, "l") in got[d, s]
                continue
            lines = t.split("\n")
            kept = [x for x in lines if not (x.strip(" ") and counts[s, x.strip(" ")] >= 2 and counts[s, x.strip(" ")] > 0.3 * pages[s])]
            assert ("\n".join(kept), len(lines), len(lines) - len(kept), "l") in got[d, s]
        assert sum(map(len, got.values())) == len(rows)
    assert line_dedup.drop_boilerplate(documents([])).count() == 0


def test_copies_are_one_page(documents):
    rows = [(i, "shared by copies\nfooter" if i < 6 else f"own {i}\nfooter", "s") for i in range(10)]
    out = {x["doc_id"]: x["text"] for x in line_dedup.drop_boilerplate(documents(rows), ratio=0.5).collect()}
    assert out == {i: "shared by copies" if i < 6 else f"own {i}" for i in range(10)}
    each = {x["text"] for x in line_dedup.drop_boilerplate(documents(rows), ratio=0.5, copies_once=False).collect()}
    assert each == {""} | {f"own {i}" for i in range(6, 10)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_format_reads_back(spark):
    r = random.Random(3)
    texts = ["hi", "", None, "much " * 20_000, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x <| y", "a\nb\n", "long " * 900, "ünïcödé 🙂 text", "word " * 100]
    rows = []
    for c in range(40):
        roles = (["system"] if r.random() < 0.5 else []) + [r.choice(["user", "assistant", "assistant", None, "to\nol<|"]) for _ in range(r.randrange(1, 30))]
        rows += [(c, i, role, r.choice(texts), "x") for i, role in enumerate(roles)]
    rows += [(77, 0, "user", "same", "x"), (77, 0, "user", "same", "x"), (77, None, "assistant", "first", "x"), (None, 0, "user", "nobody", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window string")
    windows = chat_format.format_conversations(df, budget=200, history=60, history_turns=2)
    got = {x["conv_id"]: x for x in chat_format.digests(windows).collect()}
    turns = {}
    for c, t, role, text, _ in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == turns.keys()
    for c, own in turns.items():
        own.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        lost = "".join(text for _, _, role, text in own if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha(said), len(lost), sha(lost))
    for w in windows.collect():
        assert w["n_tokens"] <= 200 or w["oversize"]
        assert w["formatted"].count("<|im_start|>") == w["formatted"].count("<|im_end|>") == w["n_turns"]
        if w["window"] and w["conv_id"] is not None and w["conv_id"] < 40 and turns[w["conv_id"]][0][2] == "system":
            assert w["formatted"].startswith("<|im_start|>system\n") and w["n_repeated"] >= 1
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_windows_are_full(spark):
    """Greedy spans: no window could have taken the next turn, and long conversations fill theirs."""
    r = random.Random(5)
    rows = [(c, i, "system" if i == 0 and c % 2 else "user" if i % 2 else "assistant", "x" * r.randrange(20, 400), None) for c in range(4) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint")
    for tokens, stretch in ((None, 16), ("n", 3)):
        df = df.withColumn("n", F.length("text") % 50)
        windows = chat_format.format_conversations(df, budget=500, history=100, tokens=tokens, stretch=stretch).orderBy("conv_id", "window").collect()
        assert not any(w["oversize"] for w in windows) and sum(w["n_turns"] - w["n_repeated"] for w in windows) == len(rows)
        fill = [w["n_tokens"] / 500 for w in windows]
        assert sum(fill) / len(fill) >= 0.8
        sizes = {(c, i): (len(t) % 50 if tokens else -(-len(t) // 4)) + chat_format.TURN_TOKENS for c, i, _, t, _ in rows}
        short = [w for w in windows if w["n_tokens"] + sizes.get((w["conv_id"], w["window"] + w["n_turns"] - w["n_repeated"]), 10**6) <= 500]
        ends = sum(sum(v for (c, _), v in sizes.items() if c == k) // (stretch * 500) for k in range(4))
        assert len(short) <= ends  # only where a segment ends
        shares = [w["n_repeated"] for w in windows if w["window"]]
        assert max(shares) == 3 and min(shares) >= 0


def spans_of(text):
    found = []
    for order, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def test_secret_scan(documents):
    r = random.Random(4)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc", "hunter22", "deadbeef" * 3, "0" * 23, "AKIA", "AKIA" + "Q" * 16, "\n", "é🙂", "ghp_" + "a1" * 18, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60))), "s") for i in range(400)] + ODD
    rows += [(500, "token=token:abcdefgh", "s"), (501, ("secret=abcdef " * 700), "s"), (None, "token: abcdefgh", "s"), (502, "tokens", "s"), (502, "token=12345678", "s")]
    found = secret_scan.digests(secret_scan.scan(documents(rows))).collect()
    assert len(found) == len(rows)
    names = [x.kind for x in secret_scan.RULES]
    text = lambda s: ",".join(f"{names[o]}:{a}:{b}" for a, o, b in s)
    want = sorted((str(d), text(spans_of(t or "")), sha(text([x for x in spans_of(t or "") if x[1] < 3]))) for d, t, _ in rows)
    assert sorted((str(x["doc_id"]), x["spans"], x["base_sha256"]) for x in found) == want
    assert secret_scan.scan(documents([])).count() == 0


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("abc") == "abc" and q("[0-9a-f]+") is True and q("a|bcd") is True
    assert q("(?i:abcd)x?") == ("and", frozenset({"abc", "bcd"}))
    assert q("(abc|xyz)+q") == ("and", frozenset({("or", frozenset({"abc", "xyz"})), ("or", frozenset({"bcq", "yzq"}))}))


def test_narrowed_queries_are_weaker():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    small = secret_scan.narrowed(q)
    assert small["hex"] is True and small["jwt"] is not True
    grams = set().union(*map(secret_scan.trigrams, small.values()))
    assert len(grams) < len(set().union(*map(secret_scan.trigrams, q.values()))) / 2

    def holds(query, text):
        if query is True:
            return True
        return query in text if isinstance(query, str) else (all if query[0] == "and" else any)(holds(x, text) for x in query[1])

    r = random.Random(21)
    for _ in range(3000):
        text = "".join(r.choice(["pass", "wor", "d", "wd", "sec", "ret", "tok", "en", "api", "_", "key", "ghp", "gho_", "xox", "b-", "eyj", ".ey", "j", "aki", "a", "---", "begin", " private", "aiza"]) for _ in range(5))
        assert all(holds(small[k], text) or not holds(q[k], text) for k in q)


def test_sieve_lets_every_candidate_through(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"))
    ids = spark.range(0, 20_000, 97).select(F.col("id").alias("doc_id"))
    out = secret_scan.with_sieve(rows, ids, "candidate").groupBy("doc_id", "candidate").count().collect()
    through = {x["doc_id"] for x in out if x["candidate"]}
    assert sum(x["count"] for x in out) == 20_000 and None in through
    assert set(range(0, 20_000, 97)) - {7 + 1000 * k for k in range(20)} <= through and len(through) < 400
    assert not any(x["candidate"] and x["doc_id"] is not None for x in secret_scan.with_sieve(rows, ids.limit(0), "candidate").collect())
