import random

from brute import components_of, simhash

from readloom.llm.components import components
from readloom.llm.simhash import fingerprint, links, near_duplicates


def expected(rows, k, t):
    prints = [(i, simhash(x, k)) for i, x in rows]
    nodes = range(len(rows))
    linked = [(a, b) for a in nodes for b in range(a) if bin(prints[a][1] ^ prints[b][1]).count("1") <= t]
    root = components_of(nodes, linked)
    least = {}
    for n in nodes:
        ids = [prints[n][0]] if prints[n][0] is not None else []
        least[root[n]] = min(least.get(root[n], []) + ids, default=None)
        least[root[n]] = [] if least[root[n]] is None else [least[root[n]]]
    return sorted(((prints[n][0], f"{prints[n][1]:016x}", (least[root[n]] or [None])[0]) for n in nodes), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(25):
        text = rng.choices(words, k=rng.choice([2, 30, 200]))
        for _ in range(4):
            copy = [*text]
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (203, "One"), (None, "one"), (204, "É é\x0bX"), (205, "a" * 200_000), (206, "x y " * 40_000)]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "doc_id long, text string, component_id string, key int").repartition(5)
    assert got(near_duplicates(df, 3, 3)) == expected(rows, 3, 3)


def test_links_find_every_pair_within_t(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for d in range(1, 8):
            y = x
            for bit in rng.sample(range(64), d):
                y ^= 1 << bit
            prints.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "__rl_fp long")
    for t in (1, 3, 5, 7):
        found = {tuple(sorted(r)) for r in links(df, t).collect()}
        want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= t}
        # beyond t = 3 the key holds only the first two segments' budget, which is still a necessary condition
        assert found == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_components_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3), (9, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = {**dict.fromkeys(range(100, 181), 100), **dict.fromkeys(range(500, 560), 500), 8: 8, 9: 8}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_long_text_goes_by_steps():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text, 3) == simhash(text, 3)
