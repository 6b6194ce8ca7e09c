"""Conversation structure repair by a retained-subsequence dynamic program.

A repaired conversation reads `s?(ua)+` by its roles' initials, or is empty. Each turn is kept, given another role or
deleted; turns are inserted. The program runs over the turns that stay: the cheapest way to keep or rerole turn j as role
t is the cheapest state p before it, plus the deletions between, plus the insertions that the pair of roles (p, t) asks
for. Prefix sums of deletion prices make the gap's price a difference, so one running minimum for each state replaces
the search for the turn before. Among equally cheap ways the smallest audit (the edits' initials) wins. Insertions
stand right before the turn that needs them and after the deletions of their gap: that is the smallest order, and it
leaves no audit that is the beginning of another, so that a comparison of beginnings decides.

Turns are dealt by ranges of (conversation, turn) and sorted. A task walks its range and cuts it into segments of at
most SEGMENT turns or BYTES of text. A conversation inside one segment, with others on both sides in the range, is
finished there. For any other segment the program runs from every state that the turns before may leave, and each
conversation's few segments are chained afterwards by their costs and audits; then the chosen turns of each segment are
written in parallel and the pieces are hashed in order, streamed. So a conversation of any length is spread over many
tasks; only its audit and its hash, one value each, pass through one.

Defined cases: null role or text counts as one space, as does a null turn or conv_id in the damage's key; null turns
come first, rows with an equal turn are ordered by a digest of their role and text; rows without conv_id are one
conversation; conversations whose rows are all dropped are returned with zeros; repeated rows are duplicates; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import scratch, table

#: Turns and bytes of text of a segment.
SEGMENT, BYTES = 1024, 1 << 22
#: Prices of the edits and of an undeleted truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What the turns so far end with: nothing, a system, a user, an assistant turn.
STATES = "-sua"
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, 2: repeated) of every row, by a hash of conv_id and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.col("__kind")
    held = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("__kind"))
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return held.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def inserts(before: int, after: int) -> int | None:
    """Turns that must be put between two states; None if none can help."""
    if after == 1:
        return 0 if before == 0 else None
    return int(after == 3) if before != 2 else int(after == 2)


#: Turns that must be put at the end, by the state.
CLOSING = [0, 2, 1, 0]


def cheapest(turns: list[tuple[str, bool, bool]], entry: int) -> dict[int, tuple[int, str]]:
    """Cost and smallest audit of the cheapest edits of turns, for each state they can leave.

    turns: (initial of the role, whether it must be deleted, whether it is truncated).
    """
    # for each state: least price less the deletions before it, its audit, and the turns it has seen
    least: dict[int, tuple[int, str, int]] = {entry: (0, "", 0)}
    for j, (initial, gone, short) in enumerate(turns):
        if gone:
            continue
        sums = DELETE * j
        kept = STATES.find(initial, 1) if initial else -1
        found = []
        for after, letter, own in ([(kept, "K", 0)] if kept > 0 else []) + [(t, "R", REROLE) for t in (2, 3) if t != kept]:
            best = None
            for before, (price, audit, seen) in least.items():
                n = inserts(before, after)
                if n is None:
                    continue
                cost = price + sums + n * INSERT + own + short * TRUNCATED
                if best is None or cost <= best[0]:
                    way = (cost, audit + "D" * (j - seen) + "I" * n + letter)
                    best = way if best is None else min(best, way)
            if best:
                found.append((after, best))
        for after, (cost, audit) in found:
            price, had = cost - DELETE * (j + 1), least.get(after)
            if had is None or price < had[0] or (price == had[0] and audit < had[1] + "D" * (j + 1 - had[2])):
                least[after] = (price, audit, j + 1)
    n = len(turns)
    return {state: (price + DELETE * n, audit + "D" * (n - seen)) for state, (price, audit, seen) in least.items()}


def written(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """Lines `role:text` that the edits leave, and the state after them."""
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = STATES.index(role[:1], 1)
        out.append(f"{role}:{text}")
    return out, state


class _Segment:
    """Turns of one conversation that lie side by side."""

    def __init__(self, conv, key: int):
        self.conv, self.key, self.size = conv, key, 0
        self.rows: list[tuple[str, str]] = []
        self.turns: list[tuple[str, bool, bool]] = []
        self.counts = [0, 0, 0, 0]
        self.first = self.last = None  # turns that aren't null
        self.distinct = 0

    def add(self, turn, role: str, text: str, duplicate: bool) -> None:
        body = text.rstrip(SPACE)
        blank, short = not body, body[-1:] not in (".", "!", "?")
        fault = 0 if blank else 1 if duplicate else 2 if short else None
        if fault is not None:
            self.counts[fault] += 1
        if self.turns and self.turns[-1][0] + role[:1] not in LEGAL:
            self.counts[3] += 1
        self.rows.append((role, text))
        self.turns.append((role[:1], blank or duplicate, short and not blank))
        self.size += len(role) + len(text)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1


def _finished(s: _Segment) -> dict:
    ways = [(cost + INSERT * CLOSING[state], audit + "I" * CLOSING[state]) for state, (cost, audit) in cheapest(s.turns, 0).items()]
    cost, audit = min(ways)
    gaps = 0 if s.first is None else s.last - s.first + 1 - s.distinct
    sha = hashlib.sha256("\n".join(written(s.rows, audit, 0)[0]).encode()).hexdigest()
    return {"conv_id": s.conv, "gaps": gaps, **dict(zip(COUNTS, s.counts, strict=True)), "cost": cost, "audit": audit, "repaired_sha256": sha}


def _piece(s: _Segment) -> dict:
    ways = [cheapest(s.turns, entry) for entry in range(4)]
    return {
        "conv_id": s.conv, "segment": s.key, **dict(zip(COUNTS, s.counts, strict=True)), "first": s.first, "last": s.last, "distinct": s.distinct, "n": len(s.rows),
        "initials": [s.turns[0][0], s.turns[-1][0]] if s.turns else None,
        "costs": [w[x][0] if x in w else -1 for w in ways for x in range(4)], "audits": [w[x][1] if x in w else "" for w in ways for x in range(4)],
        "roles": [r for r, _ in s.rows], "texts": [t for _, t in s.rows],
    }


def _fields(conv: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    return pa.schema([("conv_id", conv), ("gaps", long), *((c, long) for c in COUNTS), ("cost", long), ("audit", text), ("repaired_sha256", text), ("segment", long), ("first", long), ("last", long), ("distinct", long), ("n", long),
        ("initials", pa.list_(text)), ("costs", pa.list_(long)), ("audits", pa.list_(text)), ("roles", pa.list_(text)), ("texts", pa.list_(text))])


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECES = "segment long, first long, last long, distinct long, n long, initials array<string>, costs array<long>, audits array<string>, roles array<string>, texts array<string>"


def _segments(most: int, most_bytes: int):
    """Sorted turns to finished conversations and, for those that may go on elsewhere, segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, schema, out, held = None, False, None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            held = 0
            return batch

        for batch in batches:
            schema = schema or _fields(batch.schema.field("conv_id").type)
            for conv, turn, at, copies, role, text, duplicate in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        # the range's first conversation may have begun before it
                        out.append(_finished(now) if whole else _piece(now))
                        held += 200 if whole else now.size
                    whole, now = now is not None, _Segment(conv, 2 * at)
                for copy in range(copies):
                    if len(now.rows) >= most or now.size > most_bytes:
                        out.append(_piece(now))
                        held += now.size
                        whole, now = False, _Segment(conv, 2 * at + copy)
                    now.add(turn, role, text, duplicate or copy > 0)
                if len(out) >= 2000 or held > most_bytes:
                    yield flush()
        if now is not None:
            out.append(_piece(now))  # it may go on after the range
            yield flush()

    return run


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments, without their turns, to its counts and the edits chosen for each segment."""
    rows = frame.sort_values("place").to_dict("records")
    ways: list[dict] = []
    reached: dict[int, tuple[int, str]] = {0: (0, "")}
    for r in rows:
        after: dict[int, tuple[int, str]] = {}
        back: dict[int, int] = {}
        for entry, (cost, audit) in reached.items():
            for state in range(4):
                own = int(r["costs"][4 * entry + state])
                if own < 0 or (state in after and cost + own > after[state][0]):
                    continue
                way = (cost + own, audit + r["audits"][4 * entry + state])
                if state not in after or way < after[state]:
                    after[state], back[state] = way, entry
        reached = after
        ways.append(back)
    cost, audit, state = min((cost + INSERT * CLOSING[s], audit + "I" * CLOSING[s], s) for s, (cost, audit) in reached.items())
    chosen, closing, at = [], CLOSING[state], state
    for r, back in zip(reversed(rows), reversed(ways), strict=True):
        entry = back[state]
        chosen.append((entry, r["audits"][4 * entry + state]))
        state = entry
    chosen.reverse()
    counts = {c: sum(int(r[c]) for r in rows) for c in COUNTS}
    ends = [list(r["initials"]) for r in rows if r["n"]]
    counts["illegal"] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
    spans = [(int(r["first"]), int(r["last"]), int(r["distinct"])) for r in rows if not pd.isna(r["first"])]
    distinct = sum(d for _, _, d in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    gaps = spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0
    made = [{"segment": r["segment"], "number": i, "entry": e, "edits": edits, "closing": closing if i + 1 == len(rows) else 0, "last_state": at} for i, (r, (e, edits)) in enumerate(zip(rows, chosen, strict=True))]
    made[0] |= {"gaps": gaps, **counts, "cost": cost, "audit": audit}
    return pd.DataFrame(made, columns=["segment", "number", "entry", "edits", "closing", "last_state", "gaps", *COUNTS, "cost", "audit"]).astype({c: "Int64" for c in ["gaps", *COUNTS, "cost"]})


CHOSEN = "segment long, number long, entry long, edits string, closing long, last_state long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their edits to the text they leave, line ends after every line."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            lines, _ = written(list(zip(r.pop("roles"), r.pop("texts"), strict=True)), r.pop("edits"), r.pop("entry"))
            state = r.pop("last_state")
            for _ in range(r.pop("closing")):
                lines.append(f"{'assistant' if state == 2 else 'user'}:")
                state = 5 - state if state > 1 else 2
            text = "".join(f"{x}\n" for x in lines).encode()
            yield pa.RecordBatch.from_pylist([r | {"bytes": text}], schema=pa.schema([*(batch.schema.field(c) for c in r), ("bytes", pa.binary())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (conv_id, number) to a row for each conversation; the hash streams through them."""
    now = digest = tail = schema = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([now | {"repaired_sha256": digest.hexdigest()}], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            part, number = r.pop("bytes"), r.pop("number")
            if schema is None:
                schema = pa.schema([*(batch.schema.field(c) for c in r), ("repaired_sha256", pa.string())])
            if number == 0:
                if now is not None:
                    yield done()
                now, digest, tail = r, hashlib.sha256(), b""
            if part:
                digest.update(tail + part[:-1])  # no line end after the last line of all
                tail = b"\n"
    if now is not None:
        yield done()


def repaired(rows: DataFrame, segment: int = SEGMENT, segment_bytes: int = BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text, and copies as damaged() makes them.
    """
    spark = rows.sparkSession
    conv = rows.schema["conv_id"].dataType.simpleString()
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    path = scratch(spark, "turns")
    # `at` tells rows apart; written once, so that every later step sees the same
    rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", digest.alias("digest"), F.monotonically_increasing_id().alias("at")).write.parquet(path)
    held = spark.read.parquet(path)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "at")
    seen = held.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("earliest"), F.count("*").alias("same")).where("same > 1")
    flagged = held.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    flagged = flagged.select("conv_id", "turn", "at", "copies", "role", "text", "digest", F.coalesce(F.col("earliest") < place, F.lit(False)).alias("duplicate"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("at")]
    dealt = flagged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "at", "copies", "role", "text", "duplicate")
    found_path = scratch(spark, "repaired")
    dealt.mapInArrow(_segments(segment, segment_bytes), f"conv_id {conv}, {RESULT}, {PIECES}").write.parquet(found_path)
    found = spark.read.parquet(found_path)
    names = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))]
    pieces = found.where("segment is not null")
    # a segment's place is that of its first row
    starts = held.select((F.col("at") * 2).alias("a"), F.col("turn").alias("start"), "digest", "at")
    light = pieces.drop("roles", "texts", "gaps", "cost", "audit", "repaired_sha256").join(starts, F.col("segment") - F.pmod("segment", F.lit(2)) == F.col("a"))
    numbers = light.withColumn("place", F.format_string("%s%s%s%020d", F.when(F.col("start").isNull(), "0").otherwise("1"), F.lpad((F.coalesce("start", F.lit(0)).cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"), "digest", "segment"))
    chosen = numbers.drop("a", "at", "start", "digest").groupBy("conv_id").applyInPandas(_chained, CHOSEN)
    both = pieces.select("conv_id", "segment", "roles", "texts").join(chosen, "segment")
    kept = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    texts = both.select("conv_id", "number", "entry", "edits", "closing", "last_state", *(x.split()[0] for x in kept.split(", ")), "roles", "texts").mapInArrow(_texts, f"conv_id {conv}, number long, {kept}, bytes binary")
    hashed = texts.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(_hashed, f"conv_id {conv}, {kept}, repaired_sha256 string")
    return found.where("segment is null").select(names).unionByName(hashed.select(names))


def query(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
