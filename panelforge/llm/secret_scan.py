"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is read on the driver and turned into a Boolean query: alternatives, each a set of
trigrams that every match must hold. Documents are scanned once for the trigrams that any rule names; the postings
(trigram, document) are intersected per alternative, and only documents that satisfy a rule's query are searched with
its expression. A rule from which no trigram follows (a run of hexadecimal digits) is searched in every document.

Positions come from the pieces between matches: a match starts after the lengths, in code points, of all pieces and
matches before it. Defined cases: a null or empty text has no spans; rows without doc_id can't be in the index and are
searched with every rule; rows with equal doc_id are judged each on its text; other columns are kept by scan(); no rows
give no rows. A match may be found by several rules; all are told.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_parser = re._parser  # the standard library's reader of regular expressions
_ANY_CASE = re.IGNORECASE


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group (0: the match) for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, then those that the method adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
#: What follows a private key's header, to its end line or, without one, to the end of its base64 lines.
KEY_BODY = (
    r"(?:[^-]*(?:-[^-]+){0,40}-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:\\[nr]|\s)+[A-Za-z-]+: [^\r\n]*)*(?:(?:(?:\\[nr]|\s)+[A-Za-z0-9+/]{20,}={0,2})+(?:[\r\n]+[A-Za-z0-9+/]+={0,2}(?=\s*(?:[\r\n]|$)))?)?)"
)
#: The rules by which texts are cleaned: a private key goes with its body.
CLEANING = tuple(Rule(r.kind, r.pattern + KEY_BODY) if r.kind == "private_key" else r for r in RULES)
#: Texts that an expression's finite parts may be expanded into; beyond that, what is known so far becomes a condition.
EXPANSIONS = 64
CLASS = 8


def _strings(item, fold: bool) -> list[str] | None:
    """All texts an item can match, lower-cased where case is free; None if they're many or without end."""
    kind, value = item
    name = str(kind)
    if name == "LITERAL":
        return [chr(value).lower() if fold else chr(value)]
    if name == "IN":
        found = []
        for k, v in value:
            if str(k) == "LITERAL":
                found.append(chr(v))
            elif str(k) == "RANGE" and v[1] - v[0] < CLASS:
                found += [chr(c) for c in range(v[0], v[1] + 1)]
            else:
                return None
        return found if len(found) <= CLASS else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[3], fold or bool(value[1] & _ANY_CASE))
    if name == "BRANCH":
        parts = [_sequence_strings(p, fold) for p in value[1]]
        return None if None in parts else [s for p in parts for s in p]
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] is not _parser.MAXREPEAT and value[1] <= 2:
        inner = _sequence_strings(value[2], fold)
        return None if inner is None else ["".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)]
    return None


def _sequence_strings(items, fold: bool) -> list[str] | None:
    out = [""]
    for item in items:
        more = _strings(item, fold)
        if more is None or len(out) * len(more) > EXPANSIONS:
            return None
        out = [a + b for a in out for b in more]
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _conditions(items, fold: bool) -> list[list[frozenset[str]]]:
    """Conditions that all must hold; each is a list of alternatives, each the trigrams it needs."""
    out, known = [], [""]

    def flush() -> None:
        if all(len(s) >= 3 for s in known):
            out.append([_trigrams(s) for s in known])

    for item in items:
        more = _strings(item, fold)
        if more is not None and len(known) * len(more) <= EXPANSIONS:
            known = [a + b for a in known for b in more]
            continue
        flush()
        known = [""]
        if more is not None:
            known = more
        elif str(item[0]) == "SUBPATTERN":
            out += _conditions(item[1][3], fold or bool(item[1][1] & _ANY_CASE))
        elif str(item[0]) in ("MAX_REPEAT", "MIN_REPEAT") and item[1][0] >= 1:
            out += _conditions(item[1][2], fold)
    flush()
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that the folded text must hold; None: nothing follows."""
    parts = _conditions(_parser.parse(pattern), False)
    if not parts:
        return None
    query = [frozenset()]
    for part in parts:
        if len(query) * len(part) <= EXPANSIONS:
            query = [a | b for a in query for b in part]
    query = {frozenset(t.lower() for t in q) for q in query}
    return sorted((q for q in query if not any(p < q for p in query)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: rows (trigram, doc_id), folded to lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, rules): which rules' queries a document satisfies, as bits."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for alternative in q for t in alternative})
    number = {t: i for i, t in enumerate(trigrams)}
    clauses = [(i, a) for i, q in queries.items() for a in q]
    index = postings(docs.filter("doc_id IS NOT NULL"), trigrams)
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    met = F.lit(0)
    for i, alternative in clauses:
        needs = F.array(*(F.lit(number[t]) for t in sorted(alternative)))
        met = met.bitwiseOR(F.when(F.size(F.array_intersect("held", needs)) == len(alternative), F.lit(1 << i)).otherwise(0))
    return held.select("doc_id", met.alias("rules")).filter("rules <> 0")


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as an array of (start, kind, end), in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    kind = "array<struct<start:int,kind:int,end:int>>"
    walked = F.aggregate(
        F.arrays_zip(matches.alias("m"), tested.alias("t"), F.slice(between, 1, F.size(matches)).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")),
        lambda acc, x: _step(acc, x, rule, order),
        lambda acc: acc["found"],
    )
    return F.when(F.rlike(text, pattern), walked).otherwise(F.array().cast(kind))


def _step(acc: Column, x: Column, rule: Rule, order: int) -> Column:
    start = acc["at"] + F.length(x["b"])
    end = start + F.length(x["m"])
    one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
    found = F.when(F.length(x["t"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"])
    return F.struct(end.alias("at"), found.alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: (start, kind, end) in code points by start, then kind's number in rules.

    Candidates are met where the texts lie, as long as they are few enough to be broadcast; texts move only beyond that.
    """
    every = (1 << len(rules)) - 1
    free = sum(1 << i for i, r in enumerate(rules) if trigram_query(r.pattern) is None)
    texts = docs.select("doc_id", common.text_of().alias("text"))
    id_, bits, spans = (_unused(c, docs.columns) for c in ("candidate_id", "candidate_rules", "secret_spans"))
    named = common.small_side(candidates(texts, rules), "secret-candidates").withColumnRenamed("doc_id", id_).withColumnRenamed("rules", bits)
    both = docs.join(named, F.col("doc_id") == F.col(id_), "left")
    both = both.withColumn(bits, F.when(F.col("doc_id").isNull(), every).otherwise(F.coalesce(bits, F.lit(0)).bitwiseOR(F.lit(free)))).drop(id_)
    text, none = common.text_of(), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = [F.when(F.col(bits).bitwiseAND(F.lit(1 << i)) != 0, _spans(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return both.withColumn(spans, F.array_sort(F.concat(*parts))).drop(bits), spans


def _unused(name: str, taken: list[str]) -> str:
    """name, or name with underscores in front where a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def told(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """Per document the number of spans of each base kind, the digest of the base spans, and all spans."""
    found, name = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rules)
    spans = F.col(name)
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return found.select("doc_id", *counts, F.sha2(told(F.filter(spans, lambda s: s["kind"] < base), rules), 256).alias("base_sha256"), told(spans, rules).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = CLEANING, mark: str = "[secret]") -> DataFrame:
    """docs with every found span replaced by a mark (overlapping spans by one), private keys with their bodies; texts without spans are unchanged."""
    found, spans = scan(docs, rules)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    cleaned = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size(spans) > 0, cleaned).otherwise(text)).drop(spans)
