"""Secret scans by a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression (planning, on the driver, from the parsed pattern).
The index has a posting list of document ids for each trigram that a query names, cut into blocks of about `block` documents by a hash of the id,
so that no list and no task grows with a common trigram, whatever the ids are. Within a block the lists are intersected and united as the query says; the
rule is then verified on the candidates' texts only. A rule without mandatory trigrams scans every text.
Trigrams are of ASCII-lower-cased text, so one index serves rules with and without case.

Everything that runs on the cluster is DataFrame functions.

Spans are [start, end) in code points of the whole match. Cases: a null text is the empty one (no spans); a document without an
id is scanned fully; rows that repeat an id give a row each; an empty table gives no rows; other columns are ignored. If matches of
several rules start at the same place, they stand in the rules' order.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, id_text, quoted, spare


@dataclass(frozen=True)
class Rule:
    """`pattern` is read alike by Java and RE2, in time linear in the text; `nocase`: ASCII letters in either case; a match counts if
    group `group` has `least` characters or more. `asks`: what a match that counts must match besides, for its trigrams."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    nocase: bool = False
    asks: str = ""

    @property
    def java(self) -> str:
        return ("(?i)" if self.nocase else "") + self.pattern


# The base rules first, in the order that ties follow.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # the first part is taken whatever follows, so that no part is read again from each place that looks like a start
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}((?:\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?)", 21, 1, asks=r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\."),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

# A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
_FEW = 16  # strings kept as an exact set
_RUN = 512  # characters of a run of text


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    parts: list[Query] = []
    for x in (a, b):
        parts += x[1] if isinstance(x, tuple) and x[0] == "and" else [x]
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(queries: list[Query]) -> Query:
    if any(q is True for q in queries):
        return True
    parts = list(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text must have if it has one of the strings."""
    out = []
    for s in sorted(strings):
        q: Query = True
        for i in range(len(s) - 2):
            q = _both(q, s[i : i + 3])
        out.append(q)
    return _either(out)


def _walk(items, flush) -> None:
    """Feeds `flush` the sets of strings that follow one another in a match, None where anything may stand."""
    for op, arg in items:
        if op is rc.LITERAL:
            flush({chr(arg)})
        elif op is rc.IN:
            letters: set[str] | None = set()
            for kind, x in arg:
                if kind is rc.LITERAL:
                    letters.add(chr(x))
                elif kind is rc.RANGE and x[1] - x[0] < _FEW:
                    letters.update(map(chr, range(x[0], x[1] + 1)))
                else:
                    letters = None
                    break
            flush(letters if letters and len(letters) <= 8 else None)
        elif op is rc.SUBPATTERN:
            _walk(arg[3], flush)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            for _ in range(min(low, 8)):
                _walk(inner, flush)
            if low == 0 and high == 1 and (found := _exact(inner)):
                flush(found | {""})
            elif high > low:
                flush(None)
        elif op is rc.BRANCH:
            found = [_exact(x) for x in arg[1]]
            if all(found) and len(set().union(*found)) <= _FEW:
                flush(set().union(*found))
            else:
                flush(("query", _either([_query(x) for x in arg[1]])))
        elif op is rc.AT:
            continue
        else:
            flush(None)


def _exact(items) -> set[str] | None:
    """All strings that the items match, if they are few."""
    now: set[str] | None = {""}

    def flush(x):
        nonlocal now
        now = None if now is None or not isinstance(x, set) else {a + b for a in now for b in x}
        if now is not None and len(now) > _FEW:
            now = None

    _walk(items, flush)
    return now


def _query(items) -> Query:
    whole: Query = True
    now: set[str] = {""}

    def flush(x):
        nonlocal whole, now
        if isinstance(x, set):
            joined = {a + b for a in now for b in x}
            if len(joined) > _FEW:
                whole = _both(whole, _of_strings(now))
                joined = {s[-2:] for s in joined}
            now = joined if len(joined) <= _FEW else {""}
            return
        whole = _both(whole, _of_strings(now))
        now = {""}
        if isinstance(x, tuple):
            whole = _both(whole, x[1])

    _walk(items, flush)
    return _both(whole, _of_strings(now))


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies; True if nothing is mandatory."""
    return _query(rp.parse(pattern.lower() if not re.search(r"\\[A-Z]", pattern) else pattern))


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def build_index(docs: DataFrame, wanted: set[str], block: int = 1024) -> DataFrame:
    """The inverted index of the trigrams wanted: (block, trigram, docs), docs being the posting list within a block of about `block` ids."""
    blocks = -(-docs.count() // block) or 1
    # translate() lowers ASCII only, as the patterns read it
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(wanted)))
    return (
        docs.where("doc_id is not null")
        .select("doc_id", low.alias("low"))
        .select("doc_id", F.explode(F.array_compact(has)).alias("trigram"))
        .groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "trigram")
        .agg(F.collect_set("doc_id").alias("docs"))
    )


def _tagged(kind: str):
    return lambda d: F.struct(d.alias("doc_id"), F.lit(kind).alias("kind"))


def _is(*kinds: str):
    return lambda x: x["kind"].isin(*kinds)


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, kinds): the rules whose query the posting lists admit."""
    none = F.array().cast("array<bigint>")

    def lists(q: Query) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.col("lists")[q], none)
        parts = [lists(x) for x in q[1]]
        out = parts[0]
        for x in parts[1:]:
            out = F.array_intersect(out, x) if q[0] == "and" else F.array_union(out, x)
        return out

    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    hits = [F.transform(lists(q), _tagged(k)) for k, q in queries.items()]
    return blocks.select(F.explode(F.flatten(F.array(*hits))).alias("hit")).groupBy(F.col("hit.doc_id").alias("doc_id")).agg(F.collect_set("hit.kind").alias("kinds"))


_HITS = "array<struct<rank:int,n:int,gap:bigint,size:bigint,counts:boolean>>"


def hits(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in order, as _HITS: how far each is from the one before, its length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(found.alias("hit"), F.slice(F.split(text, rule.java, -1), 1, F.size(found)).alias("gap"), counted.alias("counted"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["counted"]) >= rule.least).alias("counts"))).cast(_HITS)


def _spans(docs: DataFrame, rules: tuple[Rule, ...], block: int, work: Tables) -> DataFrame:
    """(doc_id, h, start, ends_at, rank), a row a span, h being the text's hash: rows may repeat an id with another text. Equal rows count
    once. Rows of one text are together, so what follows by text needs no shuffle; places are running sums, so time is linear in the matches."""
    texts = id_text(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    queries = {r.kind: trigram_query(r.asks or r.pattern) for r in rules}
    keyed = {r.kind: (i, r) for i, r in enumerate(rules) if queries[r.kind] is not True}
    none = F.array().cast(_HITS)

    def listed(rows: DataFrame, when: dict[int, Column]) -> DataFrame:
        return rows.select("doc_id", "h", F.concat(none, *(F.when(c, hits(F.col("text"), rules[i], i)).otherwise(none) for i, c in when.items())).alias("hits"))

    # without an id there is no posting, so all rules scan
    asked = {i: F.rlike("text", F.lit(r.java)) if r.kind not in keyed else F.col("doc_id").isNull() for i, r in enumerate(rules)}
    found = listed(texts.where(reduce(or_, asked.values(), F.lit(False))), asked)
    if keyed:
        wanted = set().union(*(trigrams(queries[kind]) for kind in keyed))
        index = work.put("index", build_index(texts, wanted, block))
        picked = work.put("candidates", candidates(index, {kind: queries[kind] for kind in keyed}))
        found = found.unionByName(listed(texts.join(picked, "doc_id"), {i: F.array_contains("kinds", kind) for kind, (i, _) in keyed.items()}))
    one = found.where(F.size("hits") > 0).repartition("doc_id", "h").distinct().select("doc_id", "h", F.explode("hits").alias("hit")).select("doc_id", "h", "hit.*")
    ends = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("doc_id", "h", "rank").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))
    return one.withColumn("ends_at", ends).where("counts").select("doc_id", "h", (F.col("ends_at") - F.col("size")).alias("start"), "ends_at", "rank")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block: int = 1024) -> DataFrame:
    """(doc_id, found): for each row of docs all spans of all rules, by start and then by rule."""
    work = Tables(docs.sparkSession, "secrets")
    kind = F.array(*(F.lit(r.kind) for r in rules))[F.col("rank")].alias("kind")
    one = F.struct("start", "rank", "ends_at", kind)
    found = work.put("found", _spans(docs, rules, block, work).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(one)).alias("found")))
    work.drop("index", "candidates")
    rows = id_text(docs).select("doc_id", F.xxhash64("text").alias("h"))
    # null-safe, as documents without an id are scanned too
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["h"] == found["h"])
    return rows.join(found, same, "left").select(rows["doc_id"], F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def said(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["ends_at"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("found", _is(*(r.kind for r in BASE)))
    counts = [F.size(F.filter("found", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", block: int = 1024) -> DataFrame:
    """The documents with each secret (overlapping ones as one) replaced by `mark`; n_chars, if there, is counted anew."""
    names = docs.columns
    h, kept, last, key = (spare(names, n) for n in ("h", "kept", "last", "key"))
    work = Tables(docs.sparkSession, "redact")
    # what is kept before each span, from where the spans before it end
    order = W.partitionBy("doc_id", "h").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)
    spans = _spans(docs, rules, block, work).withColumn("reached", F.coalesce(F.max("ends_at").over(order), F.lit(0)))
    before = F.when(F.col("start") >= F.col("reached"), F.struct("reached", "start"))
    some = work.put("kept", spans.groupBy(F.col("doc_id").alias(key), F.col("h").alias(h)).agg(F.array_sort(F.collect_list(before)).alias(kept), F.max("ends_at").alias(last)))
    work.drop("index", "candidates")

    def rest(runs: Column, start: Column, end: Column) -> Column:
        near = F.array_join(F.slice(runs, (start / _RUN).cast("int") + 1, ((end - start) / _RUN).cast("int") + 2), "")
        return F.substring(near, (start % _RUN + 1).cast("int"), (end - start).cast("int"))

    def marked(runs: Column) -> Column:
        parts = F.transform(kept, lambda x: F.concat(rest(runs, x["reached"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), rest(runs, F.col(last), F.length("text")))

    # the text is cut into runs once, so that a piece is found without counting from its start
    where = F.transform(F.array(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_RUN}}}"), F.lit(0))), marked)[0]
    # null-safe, as documents without an id are scanned too
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(h))
    hit = F.col(last).isNotNull()
    out = docs.join(some, same, "left").withColumn("text", F.when(hit, where).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*map(quoted, names))
