"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is analysed on the driver into a Boolean query over lower-case trigrams that every match must
satisfy; the index holds the trigrams that narrow such a query most, two of each conjunction. Documents fall into segments by
a hash of their id; a segment's postings list, per indexed trigram, the documents that hold it, so no list grows with the
corpus. Queries intersect and unite postings segment by segment. The candidates that come out go back to the texts as a bitmap
of bounded size rather than by a join of the texts, and a candidate is searched with the expressions where its row is read. A
bit that two ids share costs a search and changes no result. A rule without mandatory trigrams searches every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import cut

SEGMENT = 2048  # documents of a segment
GRAMS = 2  # trigrams of a conjunction that are indexed
BITS_A_CANDIDATE, LEAST_BITS, MOST_BITS = 16, 1 << 17, 1 << 28  # of the bitmap; at most 32 MB, however many candidates
COMMON = "etaoinshrdlucmfwypvbgkjqxz"  # fixed value: letters from frequent to rare


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # means the same to Java and to Python
    group: int = 0  # the group whose length `least` bounds
    least: int = 1
    base: bool = False


# The expressions of the base kinds, then those that the method adds.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]

# A Boolean query: True (every document), a trigram, or ("and" | "or", frozenset of queries).
ALL = True
MOST_STRINGS = 32


def _join(op: str, parts) -> object:
    flat: set = set()
    for p in parts:
        if p is ALL:
            if op == "or":
                return ALL
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if op == "or":  # a branch that asks for all that another asks for adds nothing
        needs = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
        flat = {p for p in flat if not any(needs[q] < needs[p] for q in flat)}
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_strings(strings: frozenset[str]) -> object:
    """What a text that holds one of the strings must satisfy."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass(frozen=True)
class _Facts:
    """exact: all strings that match, or None if they are too many; heads and tails: what a match starts and ends with."""

    exact: frozenset[str] | None
    heads: frozenset[str]
    tails: frozenset[str]
    query: object

    def settle(self) -> _Facts:
        return self if self.exact is None else _Facts(None, self.exact, self.exact, _join("and", [self.query, _of_strings(self.exact)]))


_ANY = _Facts(None, frozenset({""}), frozenset({""}), ALL)
_EMPTY = _Facts(frozenset({""}), frozenset({""}), frozenset({""}), ALL)


def _literal(strings) -> _Facts:
    s = frozenset(strings)
    return _Facts(s, s, s, ALL)


def _then(a: _Facts, b: _Facts) -> _Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _literal(x + y for x, y in product(a.exact, b.exact))
    heads_a, tails_b = a.exact, b.exact
    a, b = a.settle(), b.settle()
    seam = frozenset(x[-2:] + y[:2] for x, y in product(a.tails, b.heads))
    heads = frozenset(x + y for x, y in product(heads_a, b.heads)) if heads_a is not None else a.heads
    tails = frozenset(x + y for x, y in product(a.tails, tails_b)) if tails_b is not None else b.tails
    heads = heads if len(heads) <= MOST_STRINGS else frozenset({""})
    tails = tails if len(tails) <= MOST_STRINGS else frozenset({""})
    return _Facts(None, heads, tails, _join("and", [a.query, b.query, _of_strings(seam)]))


def _either(a: _Facts, b: _Facts) -> _Facts:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _literal(a.exact | b.exact)
    a, b = a.settle(), b.settle()
    return _Facts(None, a.heads | b.heads, a.tails | b.tails, _join("or", [a.query, b.query]))


def _facts(tree) -> _Facts:
    out = _EMPTY
    for op, arg in tree:
        if op is sre.LITERAL:
            one = _literal([chr(arg).lower()] if arg < 128 else [chr(arg)])
        elif op is sre.IN:
            chars = [chr(v).lower() for k, v in arg if k is sre.LITERAL]
            one = _literal(chars) if len(chars) == len(arg) and len(chars) <= 6 else _ANY
        elif op is sre.SUBPATTERN:
            one = _facts(arg[3])
        elif op is sre.BRANCH:
            one = None
            for branch in arg[1]:
                f = _facts(branch)
                one = f if one is None else _either(one, f)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            f = _facts(body)
            if low == 0:
                one = _literal(f.exact | {""}) if high == 1 and f.exact is not None else _ANY
            elif low == high and low <= 8:
                one = _EMPTY
                for _ in range(low):
                    one = _then(one, f)
            else:
                f = f.settle()
                one = _Facts(None, f.heads, f.tails, f.query)
        elif op is sre.AT:
            continue
        else:
            one = _ANY
        out = _then(out, one)
    return out


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that a text must satisfy to match; ALL if there is none."""
    return _facts(sre_parser.parse(pattern)).settle().query


def trigrams(query: object) -> set[str]:
    return set() if query is ALL else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _conjunctions(query: object) -> list[set[str]]:
    """The sets of trigrams of which each conjunction asks for all."""
    if query is ALL:
        return []
    if isinstance(query, str):
        return [{query}]
    own = [{q for q in query[1] if isinstance(q, str)}] if query[0] == "and" else [{q} for q in query[1] if isinstance(q, str)]
    return [x for x in own if x] + [c for q in query[1] if isinstance(q, tuple) for c in _conjunctions(q)]


def narrowed(queries: dict[str, object], grams: int = GRAMS) -> dict[str, object]:
    """The queries with at most `grams` trigrams of each conjunction: those that most conjunctions share, then the rarest.

    What satisfies a query satisfies the narrowed one.
    """
    all_ = [c for q in queries.values() for c in _conjunctions(q)]
    rare = lambda g: sum([COMMON.find(c) if c in COMMON else len(COMMON) for c in g])
    worth = lambda g: (-sum([g in c for c in all_]), -rare(g), g)

    def narrow(q: object) -> object:
        if q is ALL or isinstance(q, str):
            return q
        if q[0] == "or":
            return _join("or", [narrow(x) for x in q[1]])
        own = sorted((x for x in q[1] if isinstance(x, str)), key=worth)[:grams]
        return _join("and", own or [narrow(x) for x in q[1]])

    return {k: narrow(q) for k, q in queries.items()}


def candidates(df: DataFrame, queries: dict[str, object], text: str = "text") -> DataFrame:
    """doc_id, kinds array<string>: the rules whose query the document's trigrams satisfy, through the postings.

    Rows of null doc_id or text are in no posting; rows that share a doc_id are one document; a rule that every document
    satisfies is not named; an empty df, or no rule with trigrams, gives no rows.
    """
    grams = sorted(set().union(*map(trigrams, queries.values())))
    asked = {k: q for k, q in queries.items() if q is not ALL}
    if not asked:
        return df.sparkSession.createDataFrame([], f"doc_id {df.schema['doc_id'].dataType.simpleString()}, kinds array<string>")
    segments = max(1, -(-df.count() // SEGMENT))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))
    found = (
        df.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.lower(F.col(text)).alias("folded"))
        .select("doc_id", F.expr(f"pmod(xxhash64(doc_id), {segments})").alias("segment"), F.explode(held).alias("gram"))
    )
    postings = found.repartition("segment").groupBy("segment", "gram").agg(F.collect_set("doc_id").alias("docs"))
    index = postings.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("index"))
    none = F.array().cast(f"array<{df.schema['doc_id'].dataType.simpleString()}>")

    def answer(q: object) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("index", F.lit(q)), none)
        first, *more = sorted(q[1], key=str)
        out = answer(first)
        for p in more:
            out = (F.array_intersect if q[0] == "and" else F.array_union)(out, answer(p))
        return out

    def named(kind: str, docs: Column) -> Column:
        return F.transform(docs, lambda d: F.struct(d.alias("doc_id"), F.lit(kind).alias("kind")))

    hits = index.select(F.explode(F.flatten(F.array(*[named(k, answer(q)) for k, q in asked.items()]))).alias("hit"))
    return hits.groupBy("hit.doc_id").agg(F.collect_set("hit.kind").alias("kinds"))


def with_sieve(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """df plus a boolean column: False only if the row's doc_id is not among ids (doc_id, none null); True if it is or is null.

    The ids are a bitmap of a bit per hash value, whose size follows their number up to MOST_BITS; it is broadcast.
    """
    bits = LEAST_BITS
    wanted = ids.count() * BITS_A_CANDIDATE
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    spot = F.expr(f"pmod(xxhash64(doc_id), {bits}) + 1")
    marks = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap"))
    own, theirs, bitmap = "__spot", "__bucket", "__bitmap"
    rows = df.withColumn(own, spot)
    joined = rows.join(F.broadcast(marks.select(F.col("bucket").alias(theirs), F.col("bitmap").alias(bitmap))), F.bitmap_bucket_number(own) == F.col(theirs), "left")
    at = F.bitmap_bit_position(F.col(own)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at % 8) == 1
    return joined.withColumn(name, F.col("doc_id").isNull() | F.coalesce(hit, F.lit(False))).drop(own, theirs, bitmap)


_CHUNK = 128


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, stop>> of a rule's matches, in code points. The lengths of what lies between matches and of
    the matches themselves, summed over chunks and then over the chunks' totals, give the places."""
    between = F.split(text, F.lit(rule.pattern), -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.transform(
        F.arrays_zip(between.alias("b"), whole.alias("w"), group.alias("g")),
        lambda z: F.struct(F.length(z["b"]).alias("gap"), F.length(z["w"]).alias("size"), (F.length(z["g"]) >= rule.least).alias("ok")),
    )
    steps = F.filter(steps, lambda z: z["size"].isNotNull())
    span = "array<struct<start:int,stop:int,ok:boolean>>"

    def walk(chunk: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))
        step = lambda acc, z: F.struct(
            (acc["at"] + z["gap"] + z["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + z["gap"]).alias("start"), (acc["at"] + z["gap"] + z["size"]).alias("stop"), z["ok"].alias("ok")))).alias("out"),
        )
        return F.aggregate(chunk, zero, step)

    # A fold over chunks; inside, a fold over each chunk's matches with places relative to the chunk.
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(_CHUNK)), lambda i: walk(F.slice(steps, i + 1, _CHUNK)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    moved = lambda acc, c: F.transform(
        c["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["stop"] + acc["at"]).alias("stop"), s["ok"].alias("ok"))
    )
    all_spans = F.flatten(
        F.aggregate(chunks, zero, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved(acc, c))).alias("out")))["out"]
    )
    kept = F.filter(all_spans, lambda s: s["ok"])
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["stop"].alias("stop")))


def scan(df: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """doc_id and, per rule, a column of its kind with array<struct<start, ord, stop>>, one row per row of df.

    Spans count code points, stop exclusive. Null text is empty and matches nothing; a null doc_id is searched with every
    rule, since the postings can't name it; rows that share a doc_id are each searched if one of them is a candidate.
    Other columns of df are not read. An empty df gives no rows. Texts are read where they lie, never shuffled.
    """
    docs = df.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    found = cut(candidates(docs, narrowed(queries)).select("doc_id"))
    sieved = with_sieve(docs, found, "candidate")
    nothing = F.array().cast("array<struct<start:int,ord:int,stop:int>>")
    columns = []
    for i, r in enumerate(rules):
        asked = F.lit(True) if queries[r.kind] is ALL else F.col("candidate")
        hit = asked & F.rlike("text", F.lit(r.pattern))
        columns.append(F.when(hit, spans(F.col("text"), r, i)).otherwise(nothing).alias(r.kind))
    return sieved.select("doc_id", *columns)


def digests(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans (text) of a scan, a row per row of it."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def written(which: list[Rule]) -> Column:
        merged = F.array_sort(F.concat(*[F.col(r.kind) for r in which]))
        return F.array_join(
            F.transform(merged, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
        )

    base = [r for r in rules if r.base]
    return found.select(
        "doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(written(base), 256).alias("base_sha256"), written(rules).alias("spans")
    )


def sql(rules: list[Rule] = RULES) -> str:
    """The digests over `documents` in DuckDB's SQL."""
    lists = []
    for i, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        lists.append(f"""
  list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
    'start': cast(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda x: length(x))), 0) as bigint),
    'ord': {i}, 'size': length(regexp_extract_all(t, '{pattern}')[i]), 'ok': length(regexp_extract_all(t, '{pattern}', {r.group})[i]) >= {r.least}}}), lambda s: s.ok) {r.kind}""")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    written = lambda which: f"array_to_string(list_transform(list_sort(flatten([{', '.join(r.kind for r in which)}])), lambda s: concat({kinds}[s.ord + 1], ':', s.start, ':', s.start + s.size)), ',')"
    base = [r for r in rules if r.base]
    counts = ", ".join(f"cast(len({r.kind}) as bigint) n_{r.kind}" for r in base)
    return f"""
with texts as (select doc_id, coalesce(text, '') t from documents),
found as (select doc_id,{",".join(lists)} from texts)
select doc_id, {counts}, sha256({written(base)}) base_sha256, {written(rules)} spans from found
"""
