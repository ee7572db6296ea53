"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex is parsed into a Boolean query of trigrams that every match
must contain.  One pass over the texts makes postings (trigram, text key) for
the trigrams the rules ask for, and at the same time scans fully for rules
without mandatory trigrams.  The postings are merged by key, the queries are
evaluated, and only candidate texts are read again and verified.  Positions are
code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, join_small, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count where group ``group`` (0: all) has ``least`` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order they are listed.  The runs of the last two are
#: written with their least length: a run is matched whole either way.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds, each with a mark of its own.
MORE_RULES = (
    # with its body and end where they follow
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:\s*Proc-Type:[^\n]*\n\s*DEK-Info:[^\n]*\n)?[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\s[A-Za-z0-9+/=]{60,76}){1,200})?"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings kept side by side while a regex is read; trigrams asked for of one string.
MOST_STRINGS = 48
MOST_TRIGRAMS = 4

#: A query is a set of alternatives, each a set of trigrams that go together; the empty alternative holds for every text.
Query = frozenset


def _all_of(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x, y in product(a, b))
    kept = frozenset(x for x in both if not any(y < x for y in both))
    return kept if len(kept) <= MOST_STRINGS else a


def _any_of(queries: list[Query]) -> Query:
    every = frozenset().union(*queries)
    return frozenset(x for x in every if not any(y < x for y in every))


def _of_strings(strings: set[str]) -> Query:
    """Trigrams of each string, spread over it; one that is too short asks for none."""
    found = []
    for s in strings:
        grams = [s[i : i + 3] for i in range(len(s) - 2)]
        step = max(1, -(-len(grams) // MOST_TRIGRAMS))
        found.append(frozenset([frozenset(grams[::step])]))
    return _any_of(found)


def _read(nodes) -> tuple[set[str] | None, Query]:
    """(the strings that the nodes match, if they are few and known, else None; the query)."""
    always: Query = frozenset([frozenset()])
    run, query, exact = {""}, always, True
    for op, value in nodes:
        name = str(op)
        strings, own = None, always
        if name == "LITERAL":
            strings = {chr(value).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            strings = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            strings, own = _read(value[-1])
        elif name == "BRANCH":
            parts = [_read(x) for x in value[1]]
            own = _any_of([q for _, q in parts])
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            s, q = _read(inner)
            own = q if low else always
            if s is not None and high == 1 and (low or len(s) == 1):  # an optional class would only blur the string it ends
                strings = s | {""} if not low else s
            elif s is not None and low == high and low <= 8 and len(s) == 1:
                strings = {next(iter(s)) * low}
        elif name == "AT":
            continue
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:  # what is known so far is asked for, and a new run of strings begins
            query = _all_of(query, _of_strings(run))
            if strings is None or len(strings) > MOST_STRINGS:
                query, run = _all_of(query, own), {""}
            else:
                run = strings
            exact = False
    return (run, _of_strings(run)) if exact else (None, _all_of(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that every text with a match holds: alternatives of sets."""
    return _read(re._parser.parse(pattern))[1]


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _running(steps: Column, start: Column, add, give) -> Column:
    """give(state before the step, step) for each of the steps, the state going on by add(state, step).

    Arrays can only be appended to by copying, so the steps are cut into blocks
    of about their count's cube root: the cost is its power 4/3, not 2.
    """

    def in_blocks(s: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(s)))).cast("int")
        return _bound(size, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(s), F.lit(1)) - 1) / b).cast("int")), lambda i: F.slice(s, i * b + 1, b)))

    def walk(items: Column, first: Column, on, tell) -> Column:
        zero = F.struct(first.alias("now"), F.filter(F.array(tell(first, items[0])), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct(on(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(tell(acc["now"], x))).alias("out")), lambda acc: acc["out"])

    def whole(blocks: Column) -> Column:
        totals = walk(blocks, start, lambda now, block: F.aggregate(block, now, add), lambda now, block: now)
        return F.flatten(F.zip_with(blocks, totals, lambda block, now: walk(block, now, add, give)))

    return F.when(F.size(steps) > 0, _bound(in_blocks(steps), whole))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's leftmost non-overlapping matches that are long enough."""
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), kept.alias("kept"))

    def sizes(x: Column) -> Column:
        size = F.coalesce(F.length(x["match"]), F.lit(0)).cast("long")
        return F.struct(F.length(x["piece"]).cast("long").alias("before"), size.alias("size"), (x["match"].isNotNull() & (F.length(x["kept"]) >= rule.least)).alias("counts"))

    def found(steps: Column) -> Column:
        span = lambda at, x: F.struct((at + x["before"]).alias("start"), (at + x["before"] + x["size"]).alias("end"), x["counts"].alias("counts"))
        every = _running(steps, F.lit(0).cast("long"), lambda at, x: at + x["before"] + x["size"], span)
        return F.transform(F.filter(every, lambda x: x["counts"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return _bound(F.transform(rows, sizes), found)


def _none() -> Column:
    return F.array().cast("array<struct<start:long,end:long>>")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column per rule kind: its array of (start, end) spans.

    A null text counts as empty.  Rows with equal texts are verified alike, and
    repeated rows keep a row each; the columns of docs stay, whatever their
    names; an empty table gives an empty one.
    """
    columns = docs.columns
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if frozenset() not in queries[r.kind]]
    scanned = [r for r in rules if r not in indexed]
    vocabulary = sorted({g for r in indexed for q in queries[r.kind] for g in q})
    if len(vocabulary) > 63:
        raise ValueError("more than 63 trigrams: split the rules")

    inner = [f"_c{i}" for i in range(len(columns))]
    text = F.coalesce(F.col(inner[columns.index("text")]).cast("string"), F.lit(""))
    rows = docs.toDF(*inner).withColumn("_text", text).withColumn("_low", F.lower("_text")).withColumn("_key", F.md5("_text"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(1 << i).cast("long")) for i, g in enumerate(vocabulary)])) if vocabulary else F.array().cast("array<long>")
    light = [c for c, name in zip(inner, columns) if name != "text"]  # the text is read again rather than stored; a trigram is stored as its bit
    full = [F.when(F.col("_text").rlike(r.pattern), spans(F.col("_text"), r)).otherwise(_none()).alias(f"_s_{r.kind}") for r in scanned]
    seen = stored(rows.select(*light, "_key", *full, present.alias("_grams")), "scan")
    if not indexed:
        return _named(seen, columns, inner, rules)

    postings = seen.select("_key", F.explode("_grams").alias("_gram"))
    bits = postings.groupBy("_key").agg(F.bit_or("_gram").alias("_bits"))
    place = {g: 1 << i for i, g in enumerate(vocabulary)}
    held = []
    for n, rule in enumerate(indexed):
        asked = [sum(place[g] for g in q) for q in queries[rule.kind]]
        test = F.lit(False)
        for mask in sorted(asked):
            test = test | (F.col("_bits").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        held.append(F.when(test, F.lit(1 << n)).otherwise(F.lit(0)))
    sum_held = held[0]
    for h in held[1:]:
        sum_held = sum_held + h
    candidates = stored(bits.select("_key", sum_held.alias("_rules")).where("_rules != 0"), "candidates")

    again = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_key", F.md5("_text"))
    again = join_small(again, candidates, ["_key"], "inner")
    checked = [F.when(F.col("_rules").bitwiseAND(F.lit(1 << n)) != 0, spans(F.col("_text"), r)).otherwise(_none()).alias(f"_s_{r.kind}") for n, r in enumerate(indexed)]
    some = F.lit(0)
    for r in indexed:
        some = some + F.size(f"_s_{r.kind}")
    verified = again.select("_key", *checked).where(some > 0)
    verified = stored(verified.groupBy("_key").agg(*[F.first(f"_s_{r.kind}").alias(f"_s_{r.kind}") for r in indexed]), "verified")
    joined = join_small(seen, verified, ["_key"], "left")
    for r in indexed:
        joined = joined.withColumn(f"_s_{r.kind}", F.coalesce(F.col(f"_s_{r.kind}"), _none()))
    return _named(joined, columns, inner, rules)


def _named(rows: DataFrame, columns: list[str], inner: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    kept = [F.col(c).alias(name) for c, name in zip(inner, columns) if name != "text"]
    return rows.select(*kept, F.col("_key").alias("text_key"), F.struct(*[F.col(f"_s_{r.kind}").alias(r.kind) for r in rules]).alias("secrets"))


def span_list(secrets: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the rules' spans by start, then kind as listed, comma-joined."""
    def said(n: int, kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("said"))

    parts = [F.transform(secrets[r.kind], said(n, r.kind)) for n, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["said"]), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs.

    Null and empty texts have no spans (the hash of no bytes); a null doc_id
    stays null; repeated rows keep a row each; an empty table has none.
    """
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    counts = [F.size(F.col("secrets")[r.kind]).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("secrets"), BASE_RULES).cast("binary"), 256).alias("base_sha256"), span_list(F.col("secrets"), rules).alias("spans"))


def _marked(text: Column, spans: Column, mark: str, chunk: int = 1024) -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by the mark; what stands between is read from chunks, as a place in a long string is found by walking to it."""
    far = F.lit(2**31 - 1).cast("long")

    def between(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / chunk).cast("int"), F.floor(F.least(b, F.size(chunks).cast("long") * chunk) / chunk).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substr(near, (a - first * chunk + 1).cast("int"), F.least(F.greatest(b - a, F.lit(0)), far).cast("int"))

    def piece(chunks: Column):
        return lambda at, x: F.when(x["start"] >= at, F.concat(between(chunks, at, x["start"]), F.lit(mark))).otherwise(F.lit(""))

    def whole(chunks: Column) -> Column:
        zero = F.lit(0).cast("long")
        end = F.aggregate(spans, zero, lambda at, x: F.greatest(at, x["end"]))
        pieces = _running(spans, zero, lambda at, x: F.greatest(at, x["end"]), piece(chunks))
        return F.concat(F.array_join(pieces, ""), between(chunks, end, far))

    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), whole)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span in text replaced by a mark; overlapping spans share one.

    Null texts stay null and empty ones empty; repeated rows are treated alike;
    an empty table stays empty; other columns stay, whatever their names.
    """
    key, own = fresh(docs.columns, "key", "spans")
    found = scan(docs.select("text"), rules)
    merged = F.array_sort(F.concat(*[F.col("secrets")[r.kind] for r in rules]))
    hits = found.select(F.col("text_key").alias(key), merged.alias(own)).where(F.size(own) > 0)
    hits = stored(hits.groupBy(key).agg(F.first(own).alias(own)), "redact")
    text = F.col("text")
    new = _marked(text.cast("string"), F.col(own), mark)
    joined = join_small(docs.withColumn(key, F.md5(text.cast("string"))), hits, [key], "left")
    return joined.select(*[F.when(F.col(own).isNotNull(), new).otherwise(text).alias("text") if c == "text" else col(c) for c in docs.columns])
