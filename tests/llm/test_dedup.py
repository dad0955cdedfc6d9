import hashlib
import random
import re
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from engrama.llm import exact_dedup, licenses, line_dedup, near_dedup
from engrama.llm.common import components
from engrama.llm.queries import QUERIES
from tests.llm.data import TEXTS, awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def classes_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize(("nodes", "edges"), [(60, 40), (60, 90), (80, 0)])
def test_components(spark, nodes, edges):
    rng = random.Random(edges)
    e = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] or [(i, i + 1) for i in range(nodes - 1)]
    want = classes_of(nodes, e)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: want[x] for a, b in e if a != b for x in (a, b)}


def index(spark):
    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)


def test_exact_awkward(spark):
    got = index(spark).dedup(awkward(spark)).collect()
    assert len(got) == len(TEXTS)
    groups = defaultdict(list)
    for i, t, *_ in TEXTS:
        groups[hashlib.sha256(SPACE.sub(" ", t or "").encode()).digest()].append(i)
    for r in got:
        ids = groups[bytes(r["digest"])]
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_exact_is_incremental(spark):
    x = index(spark)
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = {r["doc_id"]: r["kept"] for r in x.dedup(batch((5, "a"), (6, "b"))).collect()}
    assert first == {5: True, 6: True}
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in x.dedup(batch((1, "a"), (2, "c"), (3, "c"))).collect()}
    assert second == {1: (5, False), 2: (2, True), 3: (2, False)}
    again = {r["doc_id"]: r["kept"] for r in x.dedup(batch((5, "a"), (6, "b"))).collect()}
    assert again == first
    assert x.known().count() == 3
    assert x.dedup(empty(spark)).count() == 0


def shingles(text, n=2):
    w = WORD.findall((text or "").translate(LOWER))
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def near_brute(rows, n=2):
    """Component of each row: rows of one id are one document; null ids and empty sets are linked with nothing."""
    sets = [shingles(t, n) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] == rows[b][0]
            inter = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and (same_id or 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter)):
                links.append((a, b))
    found = classes_of(len(rows), links)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if found[j] == found[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids and sets[k] and i is not None else i))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_near_awkward(spark):
    got = near_dedup.near_duplicates(awkward(spark)).collect()
    want = near_brute([(i, t) for i, t, *_ in TEXTS])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in words)


def test_near_large_group_of_copies(spark):
    """Copies with edits around the threshold, enough for lists that are compared in blocks."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.08]))) for i in range(220)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(100)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in near_brute(rows)}


@pytest.mark.parametrize("n", [2, 5])
def test_near_query(spark, sf, n):
    rows = [(r["doc_id"], r["text"]) for r in documents(sf)]
    got = near_dedup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), shingle=n).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(near_brute(rows, n))


def line_set(line):
    return {line[k : k + 8] for k in range(len(line) - 7)} if len(line) >= 8 else {line}


def lines_brute(rows):
    """Texts without the lines that go."""
    ids, sets = {}, []
    split = [[] if t is None else t.split("\n") for _, t in rows]
    norm = lambda x: x.lower().strip(" \t\r\x0b\x0c")
    for lines in split:
        for x in map(norm, lines):
            if x and x not in ids:
                ids[x] = len(sets)
                sets.append(line_set(x))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = classes_of(len(sets), links)
    seen, out = set(), [None] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        left = []
        for x in split[k]:
            c = found[ids[norm(x)]] if norm(x) else None
            if c is None or c not in seen:
                left.append(x)
            seen.add(c)
        out[k] = None if rows[k][1] is None else "\n".join(left)
    return out


def test_lines_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(sf)]
    got = {r["doc_id"]: r["text"] for r in QUERIES["op4_line_dedup"](spark, sf).collect()}
    want = lines_brute(rows)
    assert sum(got[i] != w for (i, _), w in zip(rows, want, strict=True)) == 0


def test_lines_awkward(spark):
    got = line_dedup.dedup_lines(awkward(spark))
    assert got.columns.count("n_lines") == 1 and set(awkward(spark).columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[4][0]["text"] is None and by[4][0]["n_lines"] == 0
    assert by[5][0]["text"] == "" and by[6][0]["text"] == " \n\t "
    assert by[1][0]["text"] == TEXTS[0][1] and by[2][0]["text"] == by[2][1]["text"] == by[3][0]["text"] == by[8][0]["text"] == ""
    assert by[11][0]["text"] == "first line here that is long enough\nsecond line here that is long enough\n"
    assert by[12][0]["text"] == "third" and by[12][0]["n_dropped"] == 1
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_large_group(spark):
    """Enough similar lines for lists that are compared in blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.03, 0.06]))) for i in range(150)] + [(200 + i, edited(rng, base, 1.0)) for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = lines_brute(rows)
    assert sum(got[i] != w for (i, _), w in zip(rows, want, strict=True)) <= 1  # bands miss a pair in two hundred at 0.8


def test_lines_one_insertion(spark):
    """One character put in near the start of a long line without spaces, or in a line of two scripts."""
    rng = random.Random(8)
    cell = lambda: str(rng.randrange(10 ** rng.randrange(2, 9)))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    han = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(1, 4)))
    kinds = {
        "csv": lambda: ",".join(cell() for _ in range(40)),
        "tab": lambda: "\t".join(cell() for _ in range(40)),
        "url": lambda: "https://" + "/".join(word() for _ in range(25)) + "?q=" + "&".join(f"{word()}={cell()}" for _ in range(6)),
        "mixed": lambda: "".join(f"{word()}{word()}{cell()}{han()}" for _ in range(12)),
    }
    rows = []
    for make in kinds.values():
        for _ in range(25):
            line, at, put = make(), rng.randrange(1, 12), rng.choice(["7", "x", "\u00e9"])
            rows += [(len(rows), line), (len(rows) + 1, line[:at] + put + line[at:])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = lines_brute(rows)
    assert want.count("") == 100
    assert [got[i] for i, _ in rows] == want


def near_pair(rng, low, high, other):
    """A line of low to high characters and an edit of it with other(length), of similarity 0.80 to 0.85."""
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10)))
    while True:
        line = " ".join(word() for _ in range(high // 3))[: rng.randrange(low, high + 1)].strip()
        edit = line
        for _ in range(rng.randrange(1, 1 + max(2, len(line) // 40))):
            at = rng.randrange(len(edit))
            edit = edit[:at] + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(0, 5))) + edit[at + rng.randrange(0, 5) :]
        edit = edit.strip()
        a, b = line_set(line), line_set(edit)
        if low <= len(line) and other(len(edit)) and 0.8 <= len(a & b) / len(a | b) <= 0.85:
            return line, edit


def test_lines_recall_by_length(spark):
    """Pairs just over the threshold are found as bands_for says, in every band of length and across 64 characters."""
    rng = random.Random(17)
    kinds = {"to 64": (40, 64, lambda n: n <= 64), "across 64": (56, 64, lambda n: n > 64), "65 to 96": (65, 96, lambda n: n > 64), "97 to 400": (97, 400, lambda n: n > 96)}
    rows = [(kind, *near_pair(rng, *how)) for kind, how in kinds.items() for _ in range(400)]
    docs = [(2 * k + side, row[1 + side]) for k, row in enumerate(rows) for side in (0, 1)]
    places, classes = line_dedup.line_components(spark.createDataFrame(docs, "doc_id long, text string"))
    of = {r["doc"]: r["component"] for r in places.join(classes, places["lid"] == classes["id"]).collect()}
    found = {kind: sum(2 * k in of and of[2 * k] == of.get(2 * k + 1) for k, row in enumerate(rows) if row[0] == kind) / 400 for kind in kinds}
    assert min(found.values()) >= 0.985, found


def test_bands():
    assert line_dedup.bands_for(0.8, 4, 0.994) == 10
    assert licenses.bands_for(0.5, 0.999) == 10


def test_postings_of_lines_are_dealt_once(spark):
    signs = spark.createDataFrame([(i, k) for i in range(200) for k in (i % 150, 1000 + i)], "id long, key long").coalesce(2)
    got = line_dedup._postings(signs)
    assert sorted(got.collect()) == sorted((i % 150, i) for i in range(200) if i % 150 < 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and "hashpartitioning(bucket" in final


def test_lines_of_a_pair_are_cut_once(spark):
    """Each side is hashed once for a pair, sets are compared outside lambdas, and the outcome is exact, repeats included."""
    rng = random.Random(23)
    rows = []
    for k in range(300):
        line = "".join(rng.choices(["ab", "the ", "\u00e9a", "ing "], k=rng.randrange(1, 60)))
        at = rng.randrange(len(line))
        rows.append((k, -k, line, line[:at] + rng.choice(["", "x", line]) + line[at + rng.randrange(3) :]))
    got = line_dedup.compared(spark.createDataFrame(rows, "a long, b long, line_a string, line_b string"), 0.8)
    want = {a: len(line_set(x) & line_set(y)) >= 0.8 * len(line_set(x) | line_set(y)) for a, _, x, y in rows}
    assert {r["a"]: r["same"] for r in got.collect()} == want and 50 < sum(want.values()) < 250
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(xxhash64") == 2 and "lambdafunction(size" not in plan


def test_fewest_common_members(spark):
    """The bound is the least number that passes the very test of the similarity."""
    for similarity in (0.5, 0.8, 0.9):
        got = spark.range(2, 400).select(F.col("id").cast("int").alias("t")).select("t", line_dedup.least_common(F.col("t"), similarity).alias("n")).collect()
        assert all(r["n"] == next(n for n in range(r["t"] + 1) if n >= similarity * (r["t"] - n)) for r in got)
