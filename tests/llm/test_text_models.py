"""BPE, toxicity, token counts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.llm import bpe, token_scan, toxicity, words

ODD = [(None, "no id", "s"), (900, None, "s"), (901, "", "s"), (902, "   \n\n ", None), (903, "x" * 50_000, "s"), (904, "one two", "s"), (904, "one two", "s"), (None, None, None)]


def odd_texts():
    r = random.Random(5)
    pick = "ab c\n'sé日 \x1f\x0b😀<|>endoftext|1²\x85　"
    return ["", " ", "it's we'll", "x<|endoftext|>y<|endoftext|>", "a" * 3000, "\n\n\n x\t\t", "١٢٣ ½"] + ["".join(r.choice(pick) for _ in range(r.randrange(80))) for _ in range(600)]


def test_bpe_equals_the_tokenizers_library(documents, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rows = [(i, x, "s") for i, x in enumerate(odd_texts())] + ODD
    got = bpe.decode(bpe.encode(documents(rows), vocabulary), vocabulary).select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(got) == len(rows)
    for x in got:
        ids = t.encode(x["text"] or "", add_special_tokens=False).ids
        assert x["ids"] == ids and x["decoded"] == t.decode(ids, skip_special_tokens=False) and x["score"] == "s"
    one = bpe.round_trip(documents(rows), vocabulary).select("doc_id", "text", "ids", "decoded", "score").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, got))
    assert bpe.digests(documents([]), vocabulary).count() == 0


def test_bpe_long_word_and_broken_bytes(vocabulary):
    from tokenizers import Tokenizer

    t, voc = Tokenizer.from_file(vocabulary), bpe.Vocabulary.load(vocabulary)
    r = random.Random(6)
    word = "".join(r.choice("etaoinshr") for _ in range(20_000))
    assert bpe.Encoder(voc).encode_batch([word])[0] == t.encode(word, add_special_tokens=False).ids
    ids = t.encode("é日🙂", add_special_tokens=False).ids
    cut = [ids[:k] for k in range(len(ids) + 1)]
    flat, ends = np.array([i for c in cut for i in c] + [10**6]), np.cumsum([0, *map(len, cut), 1])
    assert bpe.Decoder(voc.token_bytes).decode_flat(flat, ends) == [t.decode(c, skip_special_tokens=False) for c in cut] + [""]


def test_words_equal_a_regular_expression():
    texts = [*odd_texts(), None, "ÀÉ_x9 “y” z", "w " * 200_000, "q" * (words.CHUNK + 5) + " end"]
    found, at = words.hashes(texts)
    want = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert [len(w) for w in want] == np.diff(at).tolist()
    seen = {}
    for w, h in zip([w for ws in want for w in ws], found.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_token_counts(spark, documents):
    rows = [(i, "word " * (i * 37 % 200), "s") for i in range(300)] + ODD
    blocks, order = token_scan.flat_stream(documents(rows), block_tokens=64)
    got = token_scan.count_tokens(blocks).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, len(re.findall(r"\w+", (t or "").lower())))) for d, t, _ in rows)
    assert token_scan.count_tokens(blocks.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "openable"), [(1, True), (3, True), (7, False), (1000, True)])
def test_separator_scan(spark, tmp_path, block, openable, monkeypatch):
    monkeypatch.setattr(token_scan, "SUPER", 4)
    monkeypatch.setattr(token_scan, "SPLIT", 16)  # so that several tasks read ranges of one file
    if not openable:
        monkeypatch.setattr(token_scan, "_openable", lambda path: False)
    r = random.Random(block)
    want = {}
    for f in range(4):
        ids = [9 if r.random() < 0.2 else r.randrange(5) for _ in range(r.randrange(90))] if f else []
        (tmp_path / f"f{f}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        size, docs = 0, []
        for x in ids:
            if x == 9:
                docs.append((size, True))
                size = 0
            else:
                size += 1
        want[f"f{f}.bin"] = docs + [(size, False)] * (size > 0)
    out = token_scan.count_tokens(token_scan.read_files(spark, str(tmp_path / "*.bin"), block_tokens=block), end=9).collect()
    got = {k: [] for k in want}
    for x in sorted(out, key=lambda x: x["ordinal"]):
        got[x["file"].rsplit("/", 1)[1]].append((x["n_tokens"], x["ended"]))
    assert got == want


def grammar(lexicon, text):
    return dict(zip(["bias", "weight", *toxicity.SYMBOLS], toxicity.Scanner(lexicon).emitted(text).tolist(), strict=True))


def test_grammar():
    lex = {"zorg": 5.0, "blar*": 4.0}
    once = pytest.approx(np.log1p(1))
    nothing = {**dict.fromkeys(toxicity.SYMBOLS, 0), "bias": 1, "weight": 0}
    for lone in ("zorg", "a zorg here", "a zorg plot twist", "blarf!", "i kill time", "zorgon xzorg blar", "you. a zorg", "they beat them", None):
        assert grammar(lex, lone) == nothing
    assert grammar(lex, "you zorg")["insult+"] == grammar(lex, "what a zorg you are")["insult+"] == once
    assert grammar(lex, "you blarf.")["weight"] == 4.0
    assert grammar(lex, "a zorg, a blarf")["insult"] == grammar(lex, "so. a zorg. such a blarf")["insult"] == once
    assert grammar(lex, "i will kill you")["threat+"] == grammar(lex, "you he kills, kill")["threat+"] == once


@pytest.mark.parametrize(
    ("negated", "reported", "direct", "threat"),
    [
        ("you are not a zorg", "he said you zorg", "you zorg", "i will kill you"),
        ("du bist kein zorg", "er sagte du zorg", "du zorg", "ich will dich töten"),
        ("tu n'es pas un zorg", "il dit tu es un zorg", "tu es un zorg", "je vais te tuer toi"),
        ("tú nunca eres zorg", "dijo tú zorg", "tú zorg", "voy a matar a ustedes"),
    ],
)
def test_grammar_of_four_languages(negated, reported, direct, threat):
    lex, once = {"zorg": 5.0}, pytest.approx(np.log1p(1))
    for text, symbol in ((negated, "negated"), (reported, "reported"), (direct, "insult+"), (threat, "threat+"), ('you "zorg" b', "reported")):
        got = grammar(lex, text)
        assert got[symbol] == once and sum(got[s] for s in toxicity.SYMBOLS) == got[symbol]
        score = 1 / (1 + np.exp(-toxicity.Scanner(lex).emitted(text) @ toxicity.PRIOR))
        assert (score >= toxicity.THRESHOLD) == (symbol in ("insult+", "threat+"))


def test_composed_machine_equals_a_plain_reading():
    """Random strings of word classes: the composed table against rules applied one after the other."""
    r = random.Random(12)
    for _ in range(3000):
        word_classes = [r.choice(toxicity.WORD_CLASSES) for _ in range(r.randrange(12))]
        marked, reach, inside = [], 0, False
        for c in word_classes:
            if c == "N":
                reach = toxicity.SCOPE
                marked.append("")
                continue
            negated, reach = c in "IT" and reach > 0, max(0, reach - 1)
            inside = True if c == "R" else inside != (c == "Q")
            marked.append("reported" if c in "IT" and inside else "negated" if negated else c)
        want, targets, insult, threat = [], "", False, False
        for m in marked:
            out = m if m in ("negated", "reported") else ""
            if m in ("G", "Y"):
                targets += m
                if threat and m == "Y":
                    out, threat = "threat+", False
                else:
                    out, insult = "insult+" if insult else "", False
            elif m == "I":
                out, insult = ("insult+", False) if targets else ("bare", True)
            elif m == "T":
                out, threat = ("threat+", False) if "Y" in targets else ("", True)
            want.append(out)
        state, got = 0, []
        for c in word_classes:
            state, out = toxicity.GRAMMAR[state][c]
            got.append(out)
        assert got == want


def test_toxicity_of_held_out_rows(spark):
    """Held-out recall and precision on the labelled rows of sf0.1."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    out = toxicity.scored(read("documents"), read("labels")).join(read("labels").select("doc_id", "toxic"), "doc_id").where("held_out")
    n = {(x["toxic"], x["predicted"]): x["count"] for x in out.groupBy("toxic", "predicted").count().collect()}
    found, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert found / (found + missed) >= 0.9 and found / (found + wrong) >= 0.9


def test_equal_texts_of_different_labels(spark):
    rows = [(i, "you zorg" if i % 2 else "fine words", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for deal in (1, 7):
        kept = toxicity._kept_rows(docs.withColumn("label", (F.col("doc_id") % 4 == 1).cast("int")).repartition(deal), "text", "label")
        assert {tuple(x) for x in kept.collect()} == {("you zorg", 1), ("fine words", 0)}


def test_toxicity_learns_words_and_stems(spark, documents, prose):
    r = random.Random(8)
    bad = ["glorp", "snarfing", "snarfed", "snarfest", "snarfum", "snarfol"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = prose(60), int(i % 6 == 0)
        if toxic:
            text = f"{text} {r.choice(bad)} {prose(3)}. {r.choice(bad)}"
        rows.append((i, text, "s"))
        labels.append((i, toxic))
    docs = documents(rows + ODD)
    marks = spark.createDataFrame([*labels, (None, 1), (10**6, 1), (900, None)], "doc_id bigint, toxic int")
    out = {x["doc_id"]: x for x in toxicity.scored(docs, marks).collect() if x["doc_id"] is not None}
    import zlib

    for d, toxic in labels:
        assert out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert out[d]["predicted"] == toxic and 0 <= out[d]["score"] <= 1
    assert out[900]["predicted"] == out[901]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 500 + len(ODD)
    untrained = toxicity.scored(docs, marks.limit(0))
    assert untrained.count() == len(rows) + len(ODD)
    assert toxicity.scored(documents([]), marks).count() == 0
    model = toxicity.fit(docs, marks)
    assert "glorp" in model.lexicon and any(e.startswith("snar") and e.endswith("*") for e in model.lexicon)
    assert toxicity.score(docs.select("doc_id", F.lit("you idiot").alias("text")), model).where("predicted = 0").count() == 0


def test_stem_and_word_of_one_key():
    once = pytest.approx(np.log1p(1))
    for lex in ({"kill*": 4.0, "scum": 5.0, "scum*": 3.0}, {"scum*": 3.0, "scum": 5.0, "kill*": 4.0}):
        assert grammar(lex, "you killer here")["insult+"] == once and grammar(lex, "you killer here")["weight"] == 4.0
        assert grammar(lex, "you scummy")["weight"] == 3.0 and grammar(lex, "you scum")["weight"] == 5.0
