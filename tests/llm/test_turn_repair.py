import hashlib
import heapq
import itertools
import random
import re
import zlib

from readloom.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """Rows by conversation, after damage, in order."""
    convs = {}
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        got = convs.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        got += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2]))) for c, v in convs.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def shortest(rows):
    """Cheapest edits by a search over single edits, smallest audit first."""
    flaw = faults(rows)
    steps = {"": "sua", "s": "ua", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, last) in done:
            continue
        if audit[-1:] != "I":
            done.add((i, last))
        ok = lambda c: c in ("u", "s") if not last else c == ("a" if last == "u" else "u")
        for role in ("user", "assistant"):
            if ok(role[0]) and audit[-3:] != "III":
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if flaw[i] not in ("b", "d"):
                short = flaw[i] == "t"
                if role[:1] and role[0] in steps and ok(role[0]):
                    heapq.heappush(heap, (cost + short, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if ok(new[0]):
                        heapq.heappush(heap, (cost + 2 + short, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))


def expected(rows):
    out = {}
    for conv, held in damage(rows).items():
        turns = [t for t, _, _ in held if t is not None]
        flaw = faults(held)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        cost, audit, text = shortest(held)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, flaw.count("b"), flaw.count("d"), flaw.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def sample(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, 5, 8, 12])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Hello there.", "What?", "no end", "  \t\n", "", None, "same.", "é!\n", f"t {turn}.", f"u {conv} {turn}!"])
            rows.append((conv, r.choice([turn, turn, turn + r.randint(0, 2), None]), role, text))
    r.shuffle(rows)
    return rows


def check(spark, rows, **how):
    df = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA).repartition(4)
    found = tr.repaired(tr.damaged(df), **how).collect()
    want = expected(rows)
    assert len(found) == len(want)
    for x in found:
        assert tuple(x)[1:] == want[x["conv_id"]], (x, want[x["conv_id"]])


def test_against_search(spark):
    rows = sample(1, 400)
    rows += [(None, 0, "user", "Null conversation."), (None, 1, "assistant", "Yes."), (1000, None, "user", "A."), (1000, None, "user", "A."), (1001, 0, "user", "x" * 300_000)]
    rows += [(2000, 5, "user", "Same row.")] * 40
    check(spark, rows)


def test_segments_are_chained(spark):
    r = random.Random(5)
    rows = sample(2, 60)
    for conv in (500, 501):
        rows += [(conv, t * r.choice([1, 1, 2]), r.choice(["user", "assistant", "system"]), r.choice([f"{t} text.", "no end", "dup.", " "])) for t in range(150)]
    check(spark, rows, segment=3)
    check(spark, rows, segment=1024, segment_bytes=20)


def test_empty_table(spark):
    assert tr.repaired(tr.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_program_against_every_edit():
    """All ways of editing up to four turns."""
    r = random.Random(8)
    for _ in range(300):
        rows = [(i, r.choice(["user", "assistant", "system", "x"]), r.choice([f"{i}.", f"{i}", ""])) for i in range(r.randint(0, 4))]
        flaw = faults(rows)
        best = None
        for inserts in itertools.product(["", "u", "a", "ua"], repeat=len(rows) + 1):
            for edits in itertools.product("DKUA", repeat=len(rows)):
                cost, audit, roles = 2 * len(inserts[0]), "I" * len(inserts[0]), inserts[0]
                for (_, role, _), f, e, more in zip(rows, flaw, edits, inserts[1:], strict=True):
                    if e != "D" and f == "b":
                        break
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and f == "t") + 2 * len(more)
                    audit += ("R" if e in "UA" else e) + "I" * len(more)
                    roles += ("" if e == "D" else role[0] if e == "K" else e.lower()) + more
                else:
                    if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        turns = [(role[:1], f in ("b", "d"), f == "t") for (_, role, _), f in zip(rows, flaw, strict=True)]
        assert min((c + 2 * tr.CLOSING[s], a + "I" * tr.CLOSING[s]) for s, (c, a) in tr.cheapest(turns, 0).items()) == best
