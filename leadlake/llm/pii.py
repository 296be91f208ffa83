"""Personal data by bootstrapped contextual extraction.

Expressions find emails, IP addresses, card and phone numbers. These are the seeds: the words around
them are lexical patterns, and patterns and identifier-like tokens form a graph. Each round
scores a pattern by the share of its tokens that are known to be of one kind, and a token by its
best pattern; tokens in trusted patterns become spans of that kind, if they look like it.

Spark does the scoring with aggregates over distinct (pattern, token) edges, so a pattern found in very
many documents is counted before it is shuffled.

Defined cases: a null text is the empty text, without spans. Spans count code points. Matches that fail
the checks are dropped without another try. Repeated rows get the same spans each. Texts are
searched whole, in time linear in their length. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.session import materialize

KINDS = ("email", "ip", "card", "phone")
# Rounds of scoring; what a pattern's score must reach; what is added to its count of tokens.
ROUNDS, TRUST, DOUBT = 3, 0.8, 1.0
# Distinct known values a pattern needs.
SEEDS = 4

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: later starts in a run that failed fail too.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CONTEXT = 80
# Signs that do not belong to a token they stand around.
AROUND = ".,;:!?\"'()[]<>"
# Groups of digits joined by a space, dot, hyphen or bracket, at most one of each kind in turn; and the digits such a number can have.
GROUPS = re.compile(r"[+(]{0,2}[0-9]++(?:(?:[\x20.-]\(?|\)[\x20.-]?\(?|\()[0-9]++)*+")
GROUPED_DIGITS = range(7, 20)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ the local part is read backwards and the domain forwards, so long runs are read once."""
    spans, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append((start, domain.end()))
            after = domain.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", max(at + 1, after))
    return spans


def ascii_digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    spans = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0")[:3] or 0) <= 255 for part in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = ascii_digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(ascii_digits(m.group())) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


def digit_groups(text: str) -> list[tuple[int, int]]:
    """Maximal runs of digit groups that no single token covers. Groups glued to other characters stay with their token."""
    runs = []
    for m in GROUPS.finditer(text):
        start, end = m.span()
        left, right = start, end
        while left and text[left - 1] in AROUND:
            left -= 1
        while right < len(text) and text[right] in AROUND:
            right += 1
        if left and not text[left - 1].isspace():
            start = text.find(" ", start, end) + 1 or end
        if right < len(text) and not text[right].isspace():
            end = max(start, text.rfind(" ", start, end))
        if text.startswith("(", start) and text.find(")", start, end) < 0:
            start += 1
        run = text[start:end]
        if text.startswith(")", end) and run.count("(") > run.count(")"):
            end += 1
        if (" " in run or "(" in run) and len(ascii_digits(run)) in GROUPED_DIGITS:
            runs.append((start, end))
    return runs


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(value, left2, left1, right1, kind or None, start, end, late) of the seeds, of other tokens with digits or @, and of runs of digit groups.

    A run that goes on from such a token is late: patterns mark it, but it does not count in them beside its token.
    """
    taken = sorted((a, b) for _, a, b in spans)
    found = [(text[a:b].lower(), *around(text, a, b), kind, a, b, False) for kind, a, b in spans]
    i, tokens = 0, {}
    for m in re.finditer(r"\S+", text):
        raw = m.group()
        token = raw.strip(AROUND)
        if len(token) < 5 or not ("@" in token or sum(c.isdigit() for c in token) >= 3):
            continue
        start = m.start() + raw.index(token)
        end = start + len(token)
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue
        tokens[start] = end
        found.append((token.lower(), *around(text, start, end), None, start, end, False))
    i = 0
    for start, end in digit_groups(text):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if (i == len(taken) or taken[i][0] >= end) and tokens.get(start) != end:
            found.append((text[start:end].lower(), *around(text, start, end), None, start, end, start in tokens))
    return found


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    left = text[max(0, start - CONTEXT) : start].lower().split()[-2:]
    right = text[end : end + CONTEXT].lower().split()[:1]
    left = [""] * (2 - len(left)) + left
    return left[0], left[1], right[0] if right else ""


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each (doc_id, text) a row number, its base spans and its candidates."""
    part, n = TaskContext.get().partitionId(), 0
    some = re.compile("[0-9@]").search
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    candidate = pa.struct([
        ("value", pa.string()), ("left2", pa.string()), ("left1", pa.string()), ("right1", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("late", pa.bool_()),
    ])
    for batch in batches:
        rows, spans, tokens = [], [], []
        for text in batch.column(1).to_pylist():
            rows.append(part << 40 | n)
            n += 1
            base = base_spans(text) if text and some(text) else []
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
            tokens.append([dict(zip(("value", "left2", "left1", "right1", "kind", "start", "end", "late"), c)) for c in candidates(text, base)] if text and some(text) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(tokens, pa.list_(candidate))],
            names=["doc_id", "row", "base", "tokens"])


def looks_like(kind: Column, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == 0, value.contains("@"))
        .when(kind == 1, value.rlike(r"^[0-9a-f]{1,4}([.:][0-9a-f]{0,4}){3,7}$"))
        .when(kind == 2, (digits >= 12) & (digits <= 19) & value.rlike("^[0-9 -]+$"))
        .otherwise((digits >= 7) & (digits <= 15) & value.rlike("^[+0-9 ().-]+$"))
    )


def score_graph(tokens: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """(row, kind, start, end, confidence) of tokens that trusted patterns give a kind; ``tokens`` has one row per candidate."""
    left, pair = F.col("left1"), F.concat_ws(" ", "left2", "left1")
    patterns = F.array(F.concat(F.lit("l "), left), F.concat(F.lit("ll "), pair), F.concat(F.lit("lr "), left, F.lit(" _ "), F.col("right1")))
    marked = tokens.where("left1 <> ''").withColumn("pattern", F.explode(patterns))
    named = marked.where("not late")
    # A pattern with fewer different values than it needs known ones can never be trusted; all others stay, as later rounds may reach them.
    sizes = named.groupBy("pattern").agg(F.count_distinct("value").alias("size")).where(F.col("size") >= seeds)
    edges = materialize(named.select("pattern", "value", "kind").distinct().join(sizes, "pattern"), "pii-edges")
    pairs = edges.select("pattern", "value", "size").distinct()
    known = tokens.where("kind is not null").select("value", F.col("kind").alias("of"), F.lit(1.0).alias("confidence")).distinct()
    belief, scores = known, None
    for _ in range(rounds):
        # Patterns need enough values among the seeds and all that was discovered so far.
        met = pairs.join(belief, "value")
        enough = met.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= seeds).select("pattern")
        support = met.groupBy("pattern", "of").agg(F.sum("confidence").alias("support"), F.first("size").alias("size")).join(enough, "pattern")
        scores = support.select("pattern", "of", (F.col("support") / (F.col("size") + DOUBT)).alias("score")).where(F.col("score") >= trust)
        scores = materialize(scores, "pii-patterns")
        reached = edges.where("kind is null").join(scores, "pattern").where(looks_like(F.col("of"), F.col("value")))
        belief = known.union(reached.select("value", "of", F.col("score").alias("confidence"))).groupBy("value", "of").agg(F.max("confidence").alias("confidence"))
    open_tokens = marked.where("kind is null").join(scores, "pattern").where(looks_like(F.col("of"), F.col("value")))
    best = open_tokens.groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("of")).alias("kind"))).alias("best"))
    return best.select("row", (-F.col("best.kind")).alias("kind"), "start", "end", F.col("best.score").alias("confidence"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added, spans) for every row: arrays of (kind number, start, end); ``spans`` holds all."""
    span = "array<struct<kind: int, start: bigint, end: bigint>>"
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    tokens = "array<struct<value: string, left2: string, left1: string, right1: string, kind: int, start: bigint, end: bigint, late: boolean>>"
    rows = materialize(narrow.mapInArrow(search, f"doc_id {kind}, row long, base {span}, tokens {tokens}"), "pii-rows")
    added = score_graph(rows.select("row", F.inline("tokens"))).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    # Of a run and a token in it the run stays.
    wider = F.filter("added", lambda s: ~F.exists("added", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])))
    added = added.select("row", wider.alias("added"))
    nothing = F.array().cast(span)
    return rows.select("doc_id", "row", "base").join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", nothing).alias("added"), F.array_sort(F.concat("base", F.coalesce("added", nothing))).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one.

    Spans depend on the text alone, so they are found again by its digest, whatever the ids and the other columns are.
    """
    key = F.sha2(F.col(text), 256).alias("key")
    found = find_personal_data(docs.select(key, F.col(text).alias("text")), "key").where(F.size("spans") > 0)
    spans = materialize(found.groupBy(F.col("doc_id").alias("key")).agg(F.first("spans").alias("found")), "pii-spans")
    body, names = F.col("document").getField(text), F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.when(fresh, F.concat(state["done"], F.substring(body, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int")), F.get(names, span["kind"])))
            .otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    by_start = F.transform(F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: s)
    clean = F.aggregate(by_start, F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")), step,
                        lambda s: F.concat(s["done"], F.substring(body, s["at"].cast("int") + 1, 1 << 30)))
    marked = docs.select(key, F.struct("*").alias("document")).join(spans, "key", "left")
    replaced = F.when(F.col("found").isNull(), body).otherwise(clean)
    return marked.select(*[(replaced if c == text else F.col("document").getField(c)).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))
