"""Spelling variants, ranked search and held-out leaks against brute force, on the project's records and on the queries' tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from fairline.llm import leakage, queries, search, spelling

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


# -- spelling variants ------------------------------------------------------------------

def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def variants(counts, chars=5, least=3, ratio=2):
    words = {w: n for w, n in counts.items() if len(w) >= chars and n >= least}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    close = {w: [y for d in (-1, 0, 1) for y in by_size[len(w) + d] if near(w, y)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda y: (-words[y], y), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items()),
                  key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("pairs", [3, 10_000])
def test_team_spellings_find_their_form(spark, pairs):
    rng = random.Random(7)
    teams = ["Sheffield Wednesday", "Sheffield Wednesdey", "Sheffeld Wednesdey", "Malmö FF", "Malmo FF", "x" * 40, "x" * 39]
    teams += ["".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    counts = Counter({t: rng.choice([1, 3, 4, 7, 7, 20, 60]) for t in teams})
    data = [(t, "other" if i % 2 else None, n, f"m{i}") for i, (t, n) in enumerate(counts.items())] + [(None, None, 5, "m"), ("empty?", None, None, "m")]
    named = spark.createDataFrame(data, "team string, form string, n bigint, `near.n` string")
    found = spelling.variants(named, pairs=pairs)
    assert found.columns == ["team", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(found) == variants(counts)


def test_spellings_are_counted_from_match_rows(spark):
    matches = spark.createDataFrame([("Leeds Utd", "Hull City"), ("Leeds Utd", None), ("Hull City", "Leeds Utd"), ("Leds Utd", "Hull City")],
                                    "home_team string, away_team string")
    counted = spelling.spellings(matches)
    assert {tuple(r) for r in counted.collect()} == {("Leeds Utd", 3), ("Hull City", 3), ("Leds Utd", 1)}
    found = {r["team"]: r["form"] for r in spelling.variants(counted, min_n=1).collect()}
    assert found == {"Leeds Utd": None, "Hull City": None, "Leds Utd": "Leeds Utd"}
    assert spelling.variants(counted.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(counted, ratio=1)


def test_links_are_followed_to_the_last(spark):
    chain = [f"n{i}" for i in range(12)]
    links = spark.createDataFrame(list(zip(chain, chain[1:])) + [("a", "b")], "team string, form string")
    assert {tuple(r) for r in spelling.roots(links).collect()} == {(t, "n11") for t in chain[:-1]} | {("a", "b")}


def test_variants_of_the_documents(spark):
    counts = Counter()
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", doc["text"] or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc['doc_id']}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    found = queries.op11_spelling_variants(spark, SF)
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert rows_of(found) == variants(counts)


# -- ranked search ----------------------------------------------------------------------

def ranked(matches, fixtures, best=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(term.findall((t or "").translate(LOW)))) for i, t in matches]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in fixtures:
        asked, scores = Counter(term.findall((text or "").translate(LOW))), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(k * weight[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, at + 1, x[-1], -x[0]) for at, x in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


MATCHES = [(1, "Leeds Utd v Hull City"), (2, "Leeds v HULL"), (3, None), (4, ""), (5, "Leeds v HULL"), (6, "Real Betis – Málaga CF"), (7, "málaga v Betis"),
           (8, "Leeds " * 3000 + "Betis"), (9, "!!! ???"), (None, "Hull City v Betis"), (10, "City City City v Utd"), (5, "Leeds v HULL")]
FIXTURES = [(100, "leeds v hull"), (101, "LEEDS v hull city"), (102, None), (103, "zzz"), (104, "Betis v málaga betis betis"), (105, "leeds v hull city utd"),
            (106, ""), (107, "leeds v hull city utd")]


@pytest.mark.parametrize("lots", [1, 3, 2048])
def test_matches_of_fixture_names(spark, lots, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    matches = spark.createDataFrame([(*m, "x", 1) for m in MATCHES], "match_id bigint, match string, score string, `a.b` int")
    fixtures = spark.createDataFrame([(*f, "x") for f in FIXTURES], "fixture_id bigint, match string, rank string")
    found = search.rank_matches(matches, fixtures, best=4, queries=lots)
    assert found.columns == ["fixture_id", "rank", "match_id", "score"] and rows_of(found) == ranked(MATCHES, FIXTURES, 4)
    assert search.rank_matches(matches.limit(0), fixtures).count() == 0 and search.rank_matches(matches, fixtures.limit(0)).count() == 0


def test_shared_sums_add_up_to_the_queries():
    rng = random.Random(3)
    asked = [[rng.choice([b"v", b"leeds", b"hull", b"utd", b"city", b"fc", b"real"]) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    found = search.mine(asked)
    under = [Counter({t: 1}) for t in found.terms]
    for one, other in found.parts:
        under.append(under[one] + under[other])
    assert [sum((under[n] for n in nodes), Counter()) for nodes in found.queries] == [Counter(q) for q in asked]
    assert len(found.parts) and sum(map(len, found.queries)) + len(found.parts) < sum(map(len, asked))
    pairs = Counter(p for nodes in found.queries for p in set(zip(nodes, nodes[1:])))
    assert max(pairs.values(), default=1) == 1  # nothing two queries share side by side is left


# -- held-out leaks ---------------------------------------------------------------------

def leaks(files, held, span=10):
    word = re.compile(leakage.WORD)
    windows = defaultdict(set)
    for name, body in held:
        words = word.findall((body or "").translate(LOW))
        n = min(span, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i:i + n])].add("" if name is None else str(name))
    out = []
    for name, body in files:
        words, hit, who = word.findall((body or "").translate(LOW)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i:i + n])):
                    hit |= set(range(i, i + n))
                    who |= found
        out.append((name, len(words), len(hit), sorted(who), bool(hit)))
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


HEAD = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\n"
SEASON = HEAD + "".join(f"E0,{d:02d}/08/2023,Team{d},Team{d + 1},{d % 4},{d % 3}\n" for d in range(1, 29))
HELD = [("E0-2324", SEASON), ("E0-copy", SEASON), (None, HEAD + "E0,01/02/2024,Leeds,Hull,2,1\n"), ("short", "Cup final replay"), ("none", None), ("blank", " ,;"),
        ("same", "a a a a a a a a a a a a"), ("E0-2324", SEASON)]
FILES = [("E0-all", SEASON.replace(",", ";")), ("E0-2223", HEAD + "E0,01/08/2022,Leeds,Hull,0,0\n"), ("part", "x y z " + SEASON[200:330].upper() + " and the cup FINAL replay"),
         (None, SEASON[300:500]), (None, "nothing"), ("empty", ""), ("null", None), ("long", "w " * 30_000 + SEASON[100:400] + " a" * 40),
         ("E0-2223", HEAD + "E0,01/08/2022,Leeds,Hull,0,0\n"), ("nearly", "a a a a a a a a a b a a a a a a a a a"), ("one", "E0")]


def test_held_out_results_in_training_files(spark):
    files = spark.createDataFrame([(*f, "x", "y") for f in FILES], "file string, body string, key string, `n words` string")
    held = spark.createDataFrame([(*h, 1) for h in HELD], "file string, body string, context int")
    found = leakage.held_out_leaks(files, held)
    assert found.columns == ["file", "n_words", "n_hit", "held_out", "contaminated"] and rows_of(found) == leaks(FILES, HELD)
    assert rows_of(leakage.held_out_leaks(files, held, span=6, gram=6)) == leaks(FILES, HELD, 6)
    assert rows_of(leakage.held_out_leaks(files, held.limit(0))) == leaks(FILES, [])
    assert leakage.held_out_leaks(files.limit(0), held).count() == 0


def test_parts_of_a_long_text_choose_the_same_fingerprints(spark):
    rng = random.Random(5)
    bodies = [("a", " ".join(rng.choice("abc") for _ in range(500))), ("b", "x " * 40), ("c", " ".join(map(str, range(9))))]
    rows = leakage.rows_of(spark.createDataFrame(bodies, "file string, body string"), "file", "body")
    whole = {tuple(r) for r in leakage.fingerprints(rows).select("key", "at", "mark").collect()}
    parts = {tuple(r) for r in leakage.fingerprints(rows, places=16).select("key", "at", "mark").collect()}
    assert whole == parts and not any(r[0] == "c" for r in whole) and len([r for r in whole if r[0] == "a"]) < 300


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_decontamination"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found, relation = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert relation.columns == found.columns
    assert sorted(relation.fetchall()) == sorted(tuple(r) for r in found.collect())
