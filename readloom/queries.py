"""Queries of the read engine and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.sequence import reverse_complement
from readloom.operators import amos, dedup, extend, overlap, routes, search, trie
from readloom.plans.fixtures import DOCS_SQL, SYNTH_SQL, reads_docs, reads_synth
from readloom.sources import binary, fastq, text
from readloom.sources.tables import cut, scratch, written

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, sql: str | None = None, reads: str = SYNTH_SQL):
    def keep(f):
        QUERIES[name] = f
        if sql and sql.startswith("WITH"):  # that of another query
            SQL[name] = sql
        elif sql:
            start = "WITH RECURSIVE" if "FROM path" in sql else "WITH"
            SQL[name] = f"{start} {reads},\n{sql}" if not sql.startswith("SELECT") else f"{start} {reads}\n{sql}"
        return f

    return keep


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return dedup.unique_reads(reads_synth(spark, d))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches: every read whose id is divisible by 100."""
    return reads_synth(spark, d).where("read_id % 100 = 0").select(F.col("read_id").alias("target_id"), F.col("seq").alias("target"))


U = "u AS MATERIALIZED (SELECT min(read_id) AS read_id, seq, count(*) AS mult FROM reads GROUP BY seq)"
#: Proper prefixes with the numbers that inserting reads one after the other would give.
P = f"{U},\nx AS MATERIALIZED (SELECT prefix, length(prefix) AS depth, min(read_id) AS first_read FROM (SELECT read_id, substr(seq, 1, unnest(range(1, 37))) AS prefix FROM u) GROUP BY prefix),\nnd AS MATERIALIZED (SELECT 1 + row_number() OVER (ORDER BY first_read, depth) AS node_id, depth, prefix, first_read FROM x)"
V = f"""{U},
nv AS MATERIALIZED (SELECT substr(seq, 1, CAST(m AS BIGINT)) AS prefix, {", ".join(f"CAST(sum(CASE WHEN substr(seq, CAST(m AS BIGINT) + 1, 1) = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS n{x}" for x in "ACGTN")}
  FROM (SELECT seq, unnest(range(0, 37)) AS m FROM u) GROUP BY 1)"""
O = """sx AS MATERIALIZED (SELECT read_id, k, substr(seq, CAST(k AS BIGINT) + 1) AS suffix FROM (SELECT read_id, seq, unnest(range(1, 37)) AS k FROM u))"""  # noqa: E741
PAIRS = """op AS MATERIALIZED (SELECT a_id, b_id, k FROM (
  SELECT s.read_id AS a_id, b.read_id AS b_id, s.k, row_number() OVER (PARTITION BY s.read_id, s.k ORDER BY translate(b.seq, 'N', 'Z')) AS r
  FROM sx s JOIN u b ON substr(b.seq, 1, 14) = substr(s.suffix, 1, 14) AND starts_with(b.seq, s.suffix) WHERE length(s.suffix) >= 14) WHERE r <= 8)"""
COST = """list_sum(list_transform(range(1, least(length({t}), length({r})) + 1), lambda i: CASE WHEN substr({t}, CAST(i AS BIGINT), 1) <> substr({r}, CAST(i AS BIGINT), 1)
  AND substr({t}, CAST(i AS BIGINT), 1) <> 'N' AND substr({r}, CAST(i AS BIGINT), 1) <> 'N' THEN 1 ELSE 0 END))"""


@_query("reads_synth", "SELECT read_id, seq FROM reads")
def q_reads_synth(spark, d):
    return reads_synth(spark, d)


@_query("reads_docs", "SELECT read_id, seq FROM reads", DOCS_SQL)
def q_reads_docs(spark, d):
    return reads_docs(spark, d)


@_query("unique_reads", f"{U} SELECT read_id, seq, mult FROM u")
def q_unique(spark, d):
    return _unique(spark, d)


@_query("unique_reads_docs", f"{U} SELECT read_id, seq, mult FROM u", DOCS_SQL)
def q_unique_docs(spark, d):
    return dedup.unique_reads(reads_docs(spark, d))


DUPS = "SELECT first_id, read_id AS dup_id FROM (SELECT read_id, min(read_id) OVER (PARTITION BY seq) AS first_id FROM reads) WHERE read_id <> first_id"


@_query("duplicates", DUPS)
def q_duplicates(spark, d):
    return dedup.duplicates(reads_synth(spark, d))


@_query("duplicates_docs", DUPS, DOCS_SQL)
def q_duplicates_docs(spark, d):
    return dedup.duplicates(reads_docs(spark, d))


@_query("duplicate_lines", f"SELECT concat(first_id, ':0 ', dup_id) AS line FROM ({DUPS})")
def q_duplicate_lines(spark, d):
    return text.duplicate_lines(dedup.duplicates(reads_synth(spark, d)))


@_query("sorted_lines", f"{U} SELECT concat(seq, ' ', lpad(CAST(read_id AS VARCHAR), 12, ' ')) AS line FROM u")
def q_sorted_lines(spark, d):
    return text.sorted_lines(cut(_unique(spark, d)))


@_query("sorted_scan", f"{U} SELECT read_id, seq FROM u")
def q_sorted_scan(spark, d):
    """The sorted reads written as text, read back and parsed."""
    path = scratch(spark, "sorted")
    text.write_lines(text.sorted_lines(cut(_unique(spark, d))), path)
    return text.parse_sorted(text.read_lines(spark, path))


@_query("sorted_order", f"{U} SELECT read_id, row_number() OVER (ORDER BY translate(seq, 'N', 'Z')) - 1 AS place FROM u")
def q_sorted_order(spark, d):
    from readloom.functions.sequence import alphabet_key
    from readloom.sources.tables import numbered

    return numbered(_unique(spark, d).select("read_id", alphabet_key(F.col("seq")).alias("key")), F.col("key"), name="place").select("read_id", "place")


@_query("base_freq", "SELECT base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM reads) GROUP BY base")
def q_base_freq(spark, d):
    return dedup.base_frequency(reads_synth(spark, d))


@_query("length_hist", "SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY 1")
def q_length_hist(spark, d):
    return dedup.length_histogram(reads_synth(spark, d))


@_query("read_totals", "SELECT count(*) AS reads, count(DISTINCT seq) AS uniq, count(*) - count(DISTINCT seq) AS dups, CAST(floor((count(*) - count(DISTINCT seq)) * 100.0 / count(*) + 0.5) AS BIGINT) AS dup_pct FROM reads")
def q_totals(spark, d):
    return dedup.totals(reads_synth(spark, d))


@_query("trie_nodes", f"{P} SELECT node_id, depth, prefix, first_read FROM nd")
def q_nodes(spark, d):
    return trie.nodes(cut(_unique(spark, d)))


@_query("trie_cells", f"""{P}, a AS MATERIALIZED (SELECT 1 AS node_id, '' AS prefix UNION ALL SELECT node_id, prefix FROM nd),
e AS MATERIALIZED (SELECT left(prefix, length(prefix) - 1) AS prefix, right(prefix, 1) AS letter, false AS terminal, node_id AS ref FROM nd
  UNION ALL SELECT left(seq, length(seq) - 1), right(seq, 1), true, read_id FROM u)
SELECT a.node_id, e.letter, e.terminal, e.ref FROM e JOIN a USING (prefix)""")
def q_cells(spark, d):
    return trie.cells(cut(_unique(spark, d)))


@_query("trie_size", f"{P} SELECT count(*) + 1 AS last_cell FROM nd")
def q_size(spark, d):
    return trie.size(cut(_unique(spark, d)))


@_query("trie_dump", f"{P} SELECT node_id, depth, prefix, first_read FROM nd")
def q_dump(spark, d):
    """The index written to the shared folder and loaded again."""
    path = scratch(spark, "nodes")
    trie.nodes(cut(_unique(spark, d))).write.parquet(path)
    return spark.read.parquet(path)


@_query("overlap_nodes", f"{P},\n{O} SELECT s.read_id, s.k, nd.node_id FROM sx s JOIN nd ON nd.prefix = s.suffix")
def q_overlap_nodes(spark, d):
    return overlap.overlap_nodes(cut(_unique(spark, d)))


@_query("overlap_node_lines", f"{P},\n{O} SELECT concat(s.read_id, ':', s.k, ' @', nd.node_id) AS line FROM sx s JOIN nd ON nd.prefix = s.suffix")
def q_overlap_node_lines(spark, d):
    return text.overlap_node_lines(q_overlap_nodes(spark, d))


@_query("overlap_pairs_top8", f"{U},\n{O},\n{PAIRS} SELECT a_id, b_id, k FROM op")
def q_pairs(spark, d):
    return overlap.overlap_pairs(cut(_unique(spark, d)))


@_query("overlap_pairs_all", f"""{U},\n{O} SELECT s.read_id AS a_id, b.read_id AS b_id, s.k FROM sx s JOIN u b ON substr(b.seq, 1, 14) = substr(s.suffix, 1, 14)
  AND starts_with(b.seq, s.suffix) WHERE length(s.suffix) >= 14""")
def q_pairs_all(spark, d):
    return overlap.overlap_pairs(cut(_unique(spark, d)), max_overlaps=None)


@_query("overlap_pairs_docs", f"{U},\n{O},\n{PAIRS} SELECT a_id, b_id, k FROM op", DOCS_SQL)
def q_pairs_docs(spark, d):
    return overlap.overlap_pairs(cut(dedup.unique_reads(reads_docs(spark, d))))


@_query("overlap_hist", f"{P},\n{O} SELECT s.k, count(*) AS n FROM sx s JOIN nd ON nd.prefix = s.suffix GROUP BY s.k")
def q_overlap_hist(spark, d):
    return overlap.overlap_histogram(unique=cut(_unique(spark, d)))


@_query("exact_lookup", f"{U} SELECT t.read_id AS target_id, u.read_id, false AS too_long FROM reads t JOIN u ON u.seq = t.seq WHERE t.read_id % 100 = 0")
def q_exact(spark, d):
    return search.exact(cut(_unique(spark, d)), _targets(spark, d))


@_query("prefix_lookup", f"{U} SELECT t.read_id AS target_id, u.read_id FROM reads t JOIN u ON starts_with(u.seq, substr(t.seq, 1, 12)) WHERE t.read_id % 100 = 0")
def q_prefix(spark, d):
    return search.by_prefix(cut(_unique(spark, d)), _targets(spark, d).withColumn("target", F.expr("substring(target, 1, 12)")))


NEAR = "NNNNNNNNNACGTACGTNNNNNNNNNNNNNNNNNNNN"


@_query("near_single", f"{U}, k AS (SELECT read_id, seq, CAST({COST.format(t=f"'{NEAR}'", r='seq')} AS BIGINT) AS cost FROM u) SELECT read_id, seq, cost FROM k WHERE cost <= 3")
def q_near(spark, d):
    return search.near(_unique(spark, d), NEAR)


@_query("near_batch", f"{U}, k AS (SELECT t.read_id AS target_id, u.read_id, CAST({COST.format(t='t.seq', r='u.seq')} AS BIGINT) AS cost FROM reads t, u WHERE t.read_id % 100 = 0) SELECT target_id, read_id, cost FROM k WHERE cost <= 3")
def q_near_batch(spark, d):
    return search.near_batch(cut(_unique(spark, d)), _targets(spark, d))


@_query("revcomp", "SELECT read_id, CASE WHEN regexp_full_match(seq, '[ACGTacgt]*') THEN reverse(translate(upper(seq), 'ACGT', 'TGCA')) END AS rc FROM reads")
def q_revcomp(spark, d):
    return reads_synth(spark, d).select("read_id", reverse_complement(F.col("seq"), strict=False).alias("rc"))


@_query("node_votes", f"{V} SELECT prefix, nA, nC, nG, nT, nN FROM nv")
def q_node_votes(spark, d):
    return extend.node_votes(cut(_unique(spark, d)))


def _sql_rule() -> str:
    cases = []
    for b in "CGAT":
        others = [f"v{o}" for o in "CGAT" if o != b]
        cases.append(f"WHEN greatest({', '.join(others)}) + v{b} // 8 < v{b} AND {' + '.join(others)} <= v{b} - v{b} // 8 THEN '{b}'")
    return f"CASE {' '.join(cases)} END"


@_query("first_step_vote", f"""{V},
h AS (SELECT s.read_id AS seed_id, s.m, nv.* FROM (SELECT read_id, seq, unnest(range(0, 37)) AS m FROM u) s JOIN nv ON nv.prefix = right(s.seq, CAST(s.m AS BIGINT))),
f AS (SELECT seed_id, max(m) AS m FROM h WHERE m < 16 GROUP BY seed_id),
q AS (SELECT h.seed_id, {", ".join(f"CAST(sum(n{x}) AS BIGINT) AS v{x}" for x in "ACGTN")} FROM h LEFT JOIN f ON f.seed_id = h.seed_id WHERE h.m >= 16 OR h.m = f.m GROUP BY h.seed_id)
SELECT seed_id, vA AS nA, vC AS nC, vG AS nG, vT AS nT, vN AS nN, {_sql_rule()} AS chosen FROM q""")
def q_first_step(spark, d):
    u = cut(_unique(spark, d))
    return extend.step_votes(u, u.select(F.col("read_id").alias("seed_id"), F.col("seq").alias("window")))


#: Doublings of the walks in SQL: enough for walks of 4 million letters.
DOUBLINGS = 22


def _graph_sql(votes: str = "nv", name: str = "") -> str:
    """st: votes of every state and its letter; d0: the state after it."""
    vote = ", ".join(f"CAST(coalesce(sum(n{x}) FILTER (m >= 16), 0) + coalesce(arg_max(n{x}, m) FILTER (m < 16), 0) AS BIGINT) AS v{x}" for x in "ACGTN")
    return f"""ix{name} AS MATERIALIZED (SELECT row_number() OVER () AS id, prefix FROM {votes}),
st{name} AS MATERIALIZED (SELECT id, state, vA, vC, vG, vT, vN, {_sql_rule()} AS letter FROM (SELECT id, any_value(state) AS state, {vote}
  FROM (SELECT id, prefix AS state, unnest(range(0, length(prefix) + 1)) AS m FROM ix{name}) s JOIN {votes} ON {votes}.prefix = right(s.state, CAST(m AS BIGINT)) GROUP BY id)),
d0{name} AS MATERIALIZED (SELECT c.id, arg_max(j.id, c.m) AS nxt FROM (SELECT id, concat(state, letter) AS t, unnest(range(0, least(37, length(state) + 2))) AS m FROM st{name} WHERE letter IS NOT NULL) c
  JOIN ix{name} j ON j.prefix = right(c.t, CAST(c.m AS BIGINT)) GROUP BY c.id)"""


def _walk_sql(seeds: str, name: str = "", votes: str = "nv") -> str:
    """met: the states that each seed's walk meets, by place, each once; con: the contigs."""
    rounds = [f"""w{k + 1}{name} AS MATERIALIZED (SELECT seed_id, id, min(pos) AS pos FROM (SELECT seed_id, id, pos FROM w{k}{name} UNION ALL SELECT seed_id, nxt, pos + {1 << k} FROM w{k}{name} JOIN d{k}{name} USING (id)) GROUP BY seed_id, id),
d{k + 1}{name} AS MATERIALIZED (SELECT a.id, b.nxt FROM d{k}{name} a JOIN d{k}{name} b ON b.id = a.nxt)""" for k in range(DOUBLINGS)]
    return f"""{_graph_sql(votes, name)},
seeds{name} AS MATERIALIZED ({seeds}),
w0{name} AS MATERIALIZED (SELECT seed_id, arg_max(j.id, m) AS id, CAST(0 AS BIGINT) AS pos FROM (SELECT seed_id, seq, unnest(range(0, 37)) AS m FROM seeds{name}) s JOIN ix{name} j ON j.prefix = right(s.seq, CAST(m AS BIGINT)) GROUP BY seed_id),
{(","+chr(10)).join(rounds)},
con{name} AS MATERIALIZED (SELECT s.seed_id, any_value(s.seq) AS seed, coalesce(string_agg(st{name}.letter, '' ORDER BY w.pos), '') AS letters,
  CASE WHEN arg_max(coalesce(st{name}.letter, ''), w.pos) = '' THEN 'vote' ELSE 'loop' END AS stop, max(w.pos) AS last_pos
  FROM seeds{name} s JOIN w{DOUBLINGS}{name} w ON w.seed_id = s.seed_id JOIN st{name} ON st{name}.id = w.id GROUP BY s.seed_id)"""


SEEDS = "SELECT read_id AS seed_id, seq FROM reads WHERE read_id % 100 = 0"
WALK = f"{V},\n{_walk_sql(SEEDS)}"


def _tiles_sql(name: str = "") -> str:
    return f"""win{name} AS (SELECT seed_id AS contig_id, t, substr(concat(seed, letters), CAST(t + 1 AS BIGINT), 37) AS w FROM (SELECT *, unnest(range(0, length(letters) + 1)) AS t FROM con{name})),
sp{name} AS MATERIALIZED (SELECT read_id, m, substr(seq, 1, CAST(m AS BIGINT)) AS prefix FROM (SELECT read_id, seq, unnest(range(0, 38)) AS m FROM u)),
hit{name} AS MATERIALIZED (SELECT contig_id, t, m, prefix FROM (SELECT contig_id, t, m, right(w, CAST(m AS BIGINT)) AS prefix FROM (SELECT *, unnest(range(0, 38)) AS m FROM win{name})) SEMI JOIN sp{name} USING (prefix)),
used{name} AS (SELECT * FROM hit{name} WHERE m >= 16 UNION ALL SELECT h.* FROM hit{name} h JOIN (SELECT contig_id, t, max(m) AS m FROM hit{name} WHERE m < 16 GROUP BY ALL) USING (contig_id, t, m)),
til{name} AS MATERIALIZED (SELECT contig_id, s.read_id, CAST(t + 37 - x.m AS BIGINT) AS off, CAST(0 AS BIGINT) AS clr_lo, CAST(x.m AS BIGINT) AS clr_hi FROM used{name} x JOIN sp{name} s ON s.prefix = x.prefix)"""


TILES = f"{WALK},\n{_tiles_sql()}"
BEST = f"{TILES},\nbest AS (SELECT contig_id, read_id, max({{'h': clr_hi, 'o': -off}}) AS b FROM til GROUP BY ALL)"
RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
CTG = r"concat('{CTG', chr(10), 'iid:', seed_id, chr(10), 'eid:', seed_id, '-0', chr(10), 'seq:', chr(10), seed, regexp_replace(letters, '(.{80})', '\1' || chr(10), 'g'), chr(10), '.', chr(10), 'qlt:', chr(10), repeat('@', length(seed)), rtrim(regexp_replace(repeat('@', length(letters)), '(.{80})', '\1' || chr(10), 'g'), chr(10)), chr(10), '.', chr(10), '}')"
TLE = "concat('{TLE src:', read_id, ' off:', -b.o, ' clr:0,', lpad(CAST(b.h AS VARCHAR), 3, '0'), ' }')"
RED = "concat('{RED iid:', read_id, ' eid:', read_id, ' seq: ', seq, ' . qlt: ', repeat('I', length(seq)), ' . }')"


def _seeds(spark, d):
    return _targets(spark, d).select(F.col("target_id").alias("seed_id"), F.col("target").alias("seq"))


def _contigs(spark, d, u):
    return extend.extend(u, _seeds(spark, d))


@_query("extend_contigs", f"{WALK}\nSELECT seed_id, concat(seed, letters) AS seq, length(letters) AS ext_len, stop FROM con")
def q_extend(spark, d):
    return _contigs(spark, d, cut(_unique(spark, d)))


LEFT_V = V.split(",\n", 1)[1].replace("nv AS MATERIALIZED", "nvl AS MATERIALIZED").replace("FROM u)", "FROM ul)")


@_query("extend_both", f"""{V},
ul AS MATERIALIZED (SELECT read_id, {RC.format('seq')} AS seq FROM u WHERE seq NOT LIKE '%N%'),
{LEFT_V},
{_walk_sql(SEEDS + " AND seq NOT LIKE '%N%'")},
{_walk_sql(f"SELECT seed_id, {RC.format('seq')} AS seq FROM seeds", "l", "nvl")}
SELECT r.seed_id, concat({RC.format('l.letters')}, r.seed, r.letters) AS seq, length(l.letters) AS left_len, length(r.letters) AS right_len, l.stop AS left_stop, r.stop AS right_stop FROM con r JOIN conl l ON l.seed_id = r.seed_id
UNION ALL {SEEDS.replace("seq FROM", "seq, 0, 0, 'has_n', 'has_n' FROM")} AND seq LIKE '%N%'""")
def q_extend_both(spark, d):
    return extend.extend_both(cut(_unique(spark, d)), _seeds(spark, d))


@_query("vote_trail", f"""{WALK},
tr AS (SELECT seed_id, pos, id FROM w{DOUBLINGS} UNION ALL SELECT seed_id, pos + 1, nxt FROM w{DOUBLINGS} w JOIN d0 USING (id) JOIN con USING (seed_id) WHERE con.stop = 'loop' AND w.pos = con.last_pos)
SELECT seed_id, pos AS step, vA AS nA, vC AS nC, vG AS nG, vT AS nT, vN AS nN, letter AS chosen FROM tr JOIN st USING (id)""")
def q_trail(spark, d):
    u = cut(_unique(spark, d))
    return extend.vote_trail(u, cut(_contigs(spark, d, u)))


@_query("contig_text", f"{WALK}\nSELECT concat(seed, letters) AS line FROM con")
def q_contig_text(spark, d):
    """The contigs written as text and read back."""
    path = scratch(spark, "contigs")
    text.write_lines(text.contig_lines(_contigs(spark, d, cut(_unique(spark, d)))), path)
    return text.read_lines(spark, path)


def _tiled(spark, d, longest=True):
    u = cut(_unique(spark, d))
    contigs = cut(_contigs(spark, d, u))
    return u, contigs, extend.tiles(u, contigs.select(F.col("seed_id").alias("contig_id"), "seq"), longest=longest)


@_query("tiles", f"{TILES}\nSELECT contig_id, read_id, off, clr_lo, clr_hi FROM til")
def q_tiles(spark, d):
    return _tiled(spark, d, longest=False)[2]


@_query("tiles_best", f"{BEST}\nSELECT contig_id, read_id, -b.o AS off, CAST(0 AS BIGINT) AS clr_lo, b.h AS clr_hi FROM best")
def q_tiles_best(spark, d):
    return extend.best_tiles(_tiled(spark, d)[2])


@_query("unused_reads", f"{TILES}\nSELECT read_id, seq, mult FROM u WHERE read_id NOT IN (SELECT read_id FROM til)")
def q_unused(spark, d):
    u, _, t = _tiled(spark, d)
    return extend.unused_reads(u, t)


#: Reads and rounds of the assembly that is held against SQL.
BATCH, ROUNDS = 20, 2
_ROUND_2 = f"SELECT read_id AS seed_id, seq FROM u WHERE read_id NOT IN (SELECT read_id FROM til) ORDER BY read_id LIMIT {BATCH}"


@_query("assembly", f"""{V},
{_walk_sql(f"SELECT read_id AS seed_id, seq FROM u ORDER BY read_id LIMIT {BATCH}")},
{_tiles_sql()},
{_walk_sql(_ROUND_2, "_b")}
SELECT CAST(0 AS BIGINT) AS round, seed_id, concat(seed, letters) AS seq, length(letters) AS ext_len FROM con
UNION ALL SELECT 1, seed_id, concat(seed, letters), length(letters) FROM con_b""")
def q_assembly(spark, d):
    return extend.assemble(cut(_unique(spark, d)), None, BATCH, ROUNDS)


@_query("contig_alignment", f"""{WALK},
w AS MATERIALIZED (SELECT seed_id AS contig_id, t AS off, substr(concat(seed, letters), CAST(t + 1 AS BIGINT), 37) AS w FROM (SELECT *, unnest(range(0, length(letters) + 1)) AS t FROM con)),
x AS MATERIALIZED (SELECT DISTINCT w FROM w),
k AS (SELECT i, 1 + 9 * i AS a, CASE WHEN i = 3 THEN 10 ELSE 9 END AS n FROM (SELECT unnest(range(0, 4)) AS i)),
cd AS (SELECT DISTINCT x.w, r.read_id, r.seq FROM (SELECT w, i, substr(w, CAST(a AS BIGINT), CAST(n AS BIGINT)) AS s FROM x, k WHERE w NOT LIKE '%N%') x
  JOIN (SELECT read_id, seq, i, substr(seq, CAST(a AS BIGINT), CAST(n AS BIGINT)) AS s FROM u, k WHERE seq NOT LIKE '%N%') r ON r.i = x.i AND r.s = x.s
  UNION ALL SELECT x.w, u.read_id, u.seq FROM x, u WHERE (x.w LIKE '%N%' OR u.seq LIKE '%N%')
    AND hamming(x.w, u.seq) <= 3 + 74 - length(replace(x.w, 'N', '')) - length(replace(u.seq, 'N', ''))),
co AS (SELECT w, read_id, CAST({COST.format(t='w', r='seq')} AS BIGINT) AS cost FROM cd)
SELECT w.contig_id, CAST(w.off AS BIGINT) AS off, co.read_id, co.cost FROM co JOIN w ON w.w = co.w WHERE co.cost <= 3""")
def q_align(spark, d):
    u = cut(_unique(spark, d))
    return extend.align(u, cut(_contigs(spark, d, u)).select(F.col("seed_id").alias("contig_id"), "seq"))


@_query("afg_red", f"SELECT read_id, {RED} AS record FROM reads")
def q_red(spark, d):
    return amos.red(reads_synth(spark, d).withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))))


@_query("afg_ovl", f"{U},\n{O},\n{PAIRS} SELECT concat('{{OVL', chr(10), 'adj:N', chr(10), 'rds:', a_id + 1, ',', b_id + 1, chr(10), 'scr:0', chr(10), 'ahg:', k, chr(10), 'bhg:', k, chr(10), '}}') AS record FROM op")
def q_ovl(spark, d):
    return amos.ovl(overlap.overlap_pairs(cut(_unique(spark, d))))


def _ctg(c):
    return amos.ctg(c.select(F.col("seed_id").alias("contig_id"), F.expr("left(seq, length(seq) - ext_len)").alias("seed"), F.expr("right(seq, ext_len)").alias("letters")))


@_query("afg_ctg", f"{WALK}\nSELECT seed_id AS contig_id, {CTG} AS record FROM con")
def q_ctg(spark, d):
    return _ctg(_contigs(spark, d, cut(_unique(spark, d))))


@_query("afg_tle", f"{BEST}\nSELECT contig_id, read_id, {TLE} AS record FROM best")
def q_tle(spark, d):
    return amos.tle(extend.best_tiles(_tiled(spark, d)[2]))


@_query("afg_file", f"""{BEST},
f AS (SELECT min(seed_id) AS one FROM con)
SELECT 0 AS part, read_id AS n, {RED} AS line FROM reads
UNION ALL SELECT 1, seed_id, regexp_replace({CTG}, chr(10) || '[}}]$', '') FROM con, f WHERE seed_id = one
UNION ALL SELECT 2, read_id, translate({TLE}, ' ', chr(10)) FROM best, f WHERE contig_id = one
UNION ALL SELECT 3, seed_id, '}}' FROM con, f WHERE seed_id = one""")
def q_afg(spark, d):
    """The parts of the assembled file of one contig, the first: its format holds one."""
    u = cut(_unique(spark, d))
    first = _seeds(spark, d).orderBy("seed_id").limit(1)
    c = cut(extend.extend(u, first))
    best = extend.best_tiles(extend.tiles(u, c.select(F.col("seed_id").alias("contig_id"), "seq"), longest=True))
    return amos.afg(q_red(spark, d), _ctg(c), amos.tle(best))


@_query("overlap_paths", f"""{U},\n{O},\n{PAIRS},
ed AS MATERIALIZED (SELECT a_id, b_id, min(k) AS k FROM op GROUP BY ALL),
path AS (SELECT read_id AS source_id, read_id, CAST(0 AS BIGINT) AS cost, 0 AS hops FROM u WHERE read_id % 1000 = 0
  UNION SELECT source_id, b_id, cost + k, hops + 1 FROM path JOIN ed ON a_id = read_id WHERE hops < 4)
SELECT source_id, read_id, CAST(min(cost) AS BIGINT) AS cost FROM path GROUP BY ALL""")
def q_paths(spark, d):
    """Cheapest paths of up to four overlaps from every thousandth read."""
    u = cut(_unique(spark, d))
    return overlap.cheapest_paths(overlap.overlap_pairs(u), u.where("read_id % 1000 = 0"), 4)


@_query("overlap_tree", f"""{U},\n{O},\n{PAIRS},
ed AS MATERIALIZED (SELECT a_id, b_id, CAST(min(k) AS BIGINT) AS k FROM op WHERE a_id <> b_id GROUP BY ALL),
path(source_id, read_id, cost) USING KEY (source_id, read_id) AS (SELECT read_id, read_id, CAST(0 AS BIGINT) FROM u WHERE read_id % 1000 = 0
  UNION SELECT p.source_id, e.b_id, min(p.cost + e.k) FROM path p JOIN ed e ON e.a_id = p.read_id
    LEFT JOIN recurring.path o ON o.source_id = p.source_id AND o.read_id = e.b_id WHERE o.cost IS NULL OR p.cost + e.k < o.cost GROUP BY ALL),
tight AS (SELECT b.source_id, b.read_id, arg_min(a.read_id, (e.k, a.read_id)) AS before_id
  FROM path a JOIN ed e ON e.a_id = a.read_id JOIN path b ON b.source_id = a.source_id AND b.read_id = e.b_id WHERE a.cost + e.k = b.cost GROUP BY ALL)
SELECT p.source_id, p.read_id, p.cost, t.before_id FROM path p LEFT JOIN tight t ON t.source_id = p.source_id AND t.read_id = p.read_id""")
def q_tree(spark, d):
    """Cheapest paths of any number of overlaps from every thousandth read to all that it reaches, each with the read before."""
    u = cut(_unique(spark, d))
    edges = cut(routes.edges_of(overlap.overlap_pairs(u)))
    return routes.grown(edges, u.where("read_id % 1000 = 0"))


@_query("near_percent", f"{U}, k AS (SELECT t.read_id AS target_id, u.read_id, CAST({COST.format(t='t.seq', r='u.seq')} AS BIGINT) AS cost FROM reads t, u WHERE t.read_id % 100 = 0 AND hamming(t.seq, u.seq) <= 2 + 74 - length(replace(t.seq, 'N', '')) - length(replace(u.seq, 'N', ''))) SELECT target_id, read_id, cost FROM k WHERE cost <= 37 * 6 // 100")
def q_near_percent(spark, d):
    """Reads within six percent of mismatches of each target."""
    return search.near_batch(cut(_unique(spark, d)), _targets(spark, d), max_percent=6)


@_query("checked_targets", "SELECT read_id AS target_id, regexp_replace(replace(seq, 'GG', 'xG'), '[^ACGT]', 'N', 'g') AS target, regexp_matches(replace(seq, 'GG', 'xG'), '[^ACGTN]') AS warned FROM reads WHERE read_id % 100 = 0")
def q_checked(spark, d):
    return search.checked_targets(_targets(spark, d).withColumn("target", F.expr("replace(target, 'GG', 'xG')")))


@_query("unique_quality", "SELECT min(read_id) AS read_id, seq, count(*) AS mult, repeat(chr(CAST(65 + min(read_id) % 20 AS INT)), 37) AS qual FROM reads GROUP BY seq")
def q_quality(spark, d):
    return dedup.unique_with_quality(reads_synth(spark, d).withColumn("qual", F.expr("repeat(char(65 + read_id % 20), 37)")))


@_query("sorted_lines_from_1", f"{U} SELECT concat(seq, ' ', lpad(CAST(read_id + 1 AS VARCHAR), 12, ' ')) AS line FROM u")
def q_sorted_from_1(spark, d):
    return text.sorted_lines(cut(_unique(spark, d)), first_number=1)


@_query("fastq_scan", """q AS (SELECT read_id, concat('@', read_id) AS header, seq, repeat('I', length(seq)) AS qual FROM reads)
SELECT read_id, header, seq, qual, CAST(coalesce(sum(length(header) + 2 * length(seq) + 5) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM q""")
def q_fastq(spark, d, ends=False):
    """The reads written as FASTQ and scanned."""
    path = scratch(spark, "fastq")
    fastq.write_fastq(reads_synth(spark, d), path)
    return fastq.read_fastq(spark, path, ends)


@_query("read_offsets", """q AS (SELECT read_id, length(concat('@', read_id)) + 2 * length(seq) + 5 AS n FROM reads)
SELECT read_id AS entry, CAST(coalesce(sum(n) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM q
UNION ALL SELECT max(read_id) + 1, CAST(sum(n) AS BIGINT) FROM q""")
def q_offsets(spark, d):
    return fastq.offset_index(cut(q_fastq(spark, d, ends=True)))


@_query("fetch_records", "SELECT read_id, concat(seq, ';', repeat('I', length(seq))) AS record FROM reads WHERE read_id % 100 = 0")
def q_fetch(spark, d):
    return fastq.fetch(q_fastq(spark, d), _targets(spark, d).select(F.col("target_id").alias("read_id")))


#: Mismatches can't be fewer than differing letters less those that are wild.
CLOSE = "hamming(t.seq, u.seq) <= 3 + 74 - length(replace(t.seq, 'N', '')) - length(replace(u.seq, 'N', ''))"


@_query("near_docs", f"{U}, k AS (SELECT t.read_id AS target_id, u.read_id, CAST({COST.format(t='t.seq', r='u.seq')} AS BIGINT) AS cost FROM reads t, u WHERE t.read_id % 100 = 0 AND {CLOSE}) SELECT target_id, read_id, cost FROM k WHERE cost <= 3", DOCS_SQL)
def q_near_docs(spark, d):
    """Near matches among reads that are full of N."""
    reads = reads_docs(spark, d)  # made twice: as a table it would take more room than all that follows
    unique = written(dedup.unique_reads(reads), "unique")
    return search.near_batch(unique, written(reads.where("read_id % 100 = 0").select(F.col("read_id").alias("target_id"), F.col("seq").alias("target")), "targets"))


WAY = """array_to_string(list_transform(range(1, 38), lambda i: CASE WHEN substr(t.seq, CAST(i AS BIGINT), 1) = substr(u.seq, CAST(i AS BIGINT), 1) THEN '0' WHEN substr(u.seq, CAST(i AS BIGINT), 1) = 'N' THEN '1'
  ELSE translate(substr(u.seq, CAST(i AS BIGINT), 1), 'ACGT', '2345') END), '')"""


@_query("near_order", f"{U}, k AS (SELECT t.read_id AS target_id, u.read_id, CAST({COST.format(t='t.seq', r='u.seq')} AS BIGINT) AS cost, {WAY} AS way FROM reads t, u WHERE t.read_id % 100 = 0 AND {CLOSE}) SELECT target_id, read_id, cost, row_number() OVER (PARTITION BY target_id ORDER BY way) - 1 AS place FROM k WHERE cost <= 3")
def q_near_order(spark, d):
    """Near matches in the order in which a descent of the index meets them."""
    u, t = cut(_unique(spark, d)), cut(_targets(spark, d))
    return search.in_descent_order(u, t, search.near_batch(u, t))


_BAD = "read_id % 50 = 7"


@_query("fastq_rejects", f"""fq AS (SELECT read_id, concat('@', read_id, chr(10), seq, chr(10), CASE WHEN {_BAD} THEN '-' ELSE '+' END, chr(10), repeat('I', length(seq))) AS record FROM reads),
fp AS (SELECT read_id, record, CAST(coalesce(sum(length(record) + 1) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM fq)
SELECT read_id, byte_offset, 'third line' AS reason, record FROM fp WHERE {_BAD}""")
def q_rejects(spark, d):
    """The reads written as FASTQ, some with a bad third line; the records that a scan leaves out."""
    path = scratch(spark, "rejects")
    lines = F.concat(F.lit("@"), F.col("read_id"), F.lit("\n"), F.col("seq"), F.lit("\n"), F.when(F.expr(_BAD), "-").otherwise("+"), F.lit("\n"), F.expr("repeat('I', length(seq))"))
    reads_synth(spark, d).select("read_id", lines.alias("value")).orderBy("read_id").select("value").write.text(path)
    return fastq.read_rejects(spark, path)


@_query("afg_files", f"""{BEST},
us AS (SELECT DISTINCT contig_id, read_id FROM best)
SELECT contig_id, 0 AS part, read_id AS n, {RED} AS line FROM us JOIN reads USING (read_id)
UNION ALL SELECT seed_id, 1, seed_id, regexp_replace({CTG}, chr(10) || '[}}]$', '') FROM con
UNION ALL SELECT contig_id, 2, read_id, translate({TLE}, ' ', chr(10)) FROM best
UNION ALL SELECT seed_id, 3, seed_id, '}}' FROM con""")
def q_afg_files(spark, d):
    """The parts of the assembled files of all contigs, a file for each."""
    u, c, t = _tiled(spark, d)
    reads = reads_synth(spark, d).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    contigs = c.select(F.col("seed_id").alias("contig_id"), F.expr("left(seq, length(seq) - ext_len)").alias("seed"), F.expr("right(seq, ext_len)").alias("letters"))
    return amos.afg_files(reads, contigs, cut(extend.best_tiles(t)))


@_query("assembly_all", f"""{V},
{_graph_sql()},
bg AS MATERIALIZED (SELECT read_id, arg_max(j.id, m) AS id FROM (SELECT read_id, seq, unnest(range(0, 37)) AS m FROM u) s JOIN ix j ON j.prefix = right(s.seq, CAST(m AS BIGINT)) GROUP BY read_id),
r0 AS MATERIALIZED (SELECT DISTINCT id FROM bg),
{(","+chr(10)).join(f"r{k + 1} AS MATERIALIZED (SELECT id FROM r{k} UNION SELECT nxt FROM r{k} JOIN d{k} USING (id)), d{k + 1} AS MATERIALIZED (SELECT a.id, b.nxt FROM d{k} a JOIN d{k} b ON b.id = a.nxt)" for k in range(DOUBLINGS))},
mn AS MATERIALIZED (SELECT d0.nxt AS id, arg_min(d0.id, {{'l': -length(st.state), 's': st.state}}) AS pred FROM d0 JOIN r{DOUBLINGS} r ON r.id = d0.id JOIN st ON st.id = d0.id GROUP BY d0.nxt),
k0 AS MATERIALIZED (SELECT pred AS id, id AS nxt FROM mn),
hd AS MATERIALIZED (SELECT id, min(read_id) AS seed_id FROM bg WHERE id NOT IN (SELECT id FROM mn) GROUP BY id),
p0 AS MATERIALIZED (SELECT seed_id, id, CAST(0 AS BIGINT) AS pos FROM hd),
{(","+chr(10)).join(f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT seed_id, nxt, pos + {1 << k} FROM p{k} JOIN k{k} USING (id)), k{k + 1} AS MATERIALIZED (SELECT a.id, b.nxt FROM k{k} a JOIN k{k} b ON b.id = a.nxt)" for k in range(DOUBLINGS))},
con AS MATERIALIZED (SELECT w.seed_id, any_value(u.seq) AS seed, coalesce(string_agg(st.letter, '' ORDER BY w.pos) FILTER (w.id IN (SELECT id FROM k0)), '') AS letters,
  CASE WHEN arg_max(coalesce(st.letter, ''), w.pos) = '' THEN 'vote' ELSE 'joined' END AS stop FROM p{DOUBLINGS} w JOIN st USING (id) JOIN u ON u.read_id = w.seed_id GROUP BY w.seed_id),
{_tiles_sql()}
SELECT seed_id, concat(seed, letters) AS seq, length(letters) AS ext_len, stop FROM con
UNION ALL SELECT read_id, seq, 0, 'single' FROM u WHERE read_id NOT IN (SELECT read_id FROM til)""")
def q_assembly_all(spark, d):
    """Contigs that leave no read unused."""
    return extend.assemble_all(cut(_unique(spark, d)))


@_query("offset_file", SQL["read_offsets"])
def q_offset_file(spark, d):
    """The offset index written as fixed-width binary files and read by byte ranges."""
    path = scratch(spark, "index")
    binary.write_offsets(q_offsets(spark, d), path)
    return binary.read_offsets(spark, path)


@_query("cell_file", SQL["trie_cells"])
def q_cell_file(spark, d):
    """The cells of the prefix index written as five words each and read by byte ranges."""
    path = scratch(spark, "edges")
    binary.write_cells(trie.cells(cut(_unique(spark, d))), path)
    return binary.read_cells(spark, path)
