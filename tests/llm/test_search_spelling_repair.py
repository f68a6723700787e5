"""Operators 11 to 13 against brute force: top-k search, spelling variants, conversation repair."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import conversation_repair as R
from lexmill.llm import metric_tree as M
from lexmill.llm import queries as Q
from lexmill.llm import spelling as S


def same_as_sql(spark, data, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    theirs = c.execute(Q.ORACLE[name])
    names = [d[0] for d in theirs.description]
    mine = Q.QUERIES[name](spark, data).select(*names).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, theirs.fetchall()))


# --- 11 ------------------------------------------------------------------------------------


def nearest(vectors, every, k):
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors.items()}
    out = []
    for q in whole:
        if q % every == 0:
            found = [(-max(min(sum(a * b for a, b in zip(whole[q], v)), 2**63 - 1), -(2**63)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def searched(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string, dim int")
    return sorted(tuple(r) for r in M.top_k(df, **options).collect())


@pytest.mark.parametrize("kind", ["clusters", "copies", "random", "few"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(M, "TREE", 64)
    monkeypatch.setattr(M, "PAGE", 8)
    rng = np.random.default_rng(len(kind))
    n = 7 if kind == "few" else 400
    centres = rng.standard_normal((6, 12))
    x = {"clusters": lambda: centres[rng.integers(6, size=n)] + 0.05 * rng.standard_normal((n, 12)), "copies": lambda: centres[np.where(np.arange(n) % 3, 0, rng.integers(6, size=n))]}.get(kind, lambda: rng.standard_normal((n, 12)))()
    vectors = dict(enumerate(x.tolist()))
    assert searched(spark, [(i, v, 1, "x", 2) for i, v in vectors.items()], every=5) == nearest(vectors, 5, 10)


def test_stored_distances_spare_products():
    rng = np.random.default_rng(3)
    centres = 2000 * rng.standard_normal((40, 16))
    x = np.floor(centres[np.arange(2000) % 40] + 5 * rng.standard_normal((2000, 16)))
    tree = M.Tree(np.arange(2000), x)
    found, products = tree.top(x[:1], np.zeros(1, dtype=np.int64), 10, *M.anything(1))
    assert [i for _, i in found[0]] == sorted(range(1, 2000), key=lambda i: (-int(x[i] @ x[0]), i))[:10]
    assert products < 500
    packed = M.Tree.unpack({"ids": tree.ids.astype("<i8").tobytes()} | tree.pack(), 16)
    assert packed.top(x[:1], np.zeros(1, dtype=np.int64), 10, *M.anything(1)) == (found, products)


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = {0: [1.0, 2.0], 5: [1e200, -1e200], 10: [1e-200, 5e-4], 15: [1e15, 1e15], 20: [-1e15, -1e15], 3: [0.0, 0.0], 4: [0.5, 0.5], 6: [0.5, 0.5], 25: [1.0, 2.0, 3.0], 26: [1.0, 1.0, 1.0], 30: [], 31: []}
    rows = [(i, v, 0, "", 0) for i, v in vectors.items()]
    rows += [(35, None, 0, "", 0), (40, [1.0, None], 0, "", 0), (45, [nan, 1.0], 0, "", 0), (50, [inf, 1.0], 0, "", 0), (None, [1.0, 1.0], 0, "", 0), (4, [0.5, 0.5], 0, "", 0), (4, [0.75, 0.5], 0, "", 0)]
    found = searched(spark, rows, every=5, k=3)
    assert found == nearest(vectors, 5, 3)
    assert searched(spark, [], every=5) == []


def test_search_sql(spark, data):
    same_as_sql(spark, data, "op11_metric_tree", "embeddings")


# --- 12 ------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_position_index_equals_brute_force():
    r = random.Random(1)
    words = list({"".join(r.choice("abé") for _ in range(r.randint(5, 7))) for _ in range(300)})
    index = S.PositionIndex(words)
    for w in [*words, "abcde", "aaaa", "bbbbbbbb", "aéaéaéaé"]:
        assert {words[k] for k in S.bits_of(index.near(w))} == {v for v in words if one_edit(w, v)}
    assert S.PositionIndex([]).near("abcde") == 0


def spelt(rows, least=3):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], form.get(w), n.get(form.get(w)), len(near[w]), root(w)) for w in n)


DOCS = "doc_id long, text string, word string, n long, form string, part int"


@pytest.mark.parametrize("block", [4096, 8])
def test_spelling_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(block)
    stems = ["color", "colour", "Éclat", "analyse", "analyze", "banana", "bananas", "straßen", "naïveté"]

    def word():
        w = list(r.choice(stems))
        if r.random() < 0.3:
            w[r.randrange(len(w))] = r.choice("abcé")
        return "".join(w).upper() if r.random() < 0.05 else "".join(w)

    rows = [(k if k % 20 else None, " ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", "x-y_z1234", ", "]), "w", 1, "f", 0) for k in range(200)]
    rows += [(1, None, "", 0, "", 0), (2, "", "", 0, "", 0), rows[5], rows[5], (3, "colour " * 20000 + "×÷×÷× ×÷×÷× ×÷×÷×", "", 0, "", 0)]
    found = sorted(tuple(x[c] for c in ("word", "n", "form", "form_n", "n_near", "root")) for x in S.group(spark.createDataFrame(rows, DOCS)).collect())
    assert found == spelt(rows) and any(f[2] and f[5] != f[2] for f in found)


def test_spelling_of_nothing(spark):
    assert S.group(spark.createDataFrame([], DOCS)).count() == 0


def test_spelling_sql(spark, data):
    same_as_sql(spark, data, "op12_spelling", "documents")


# --- 13 ------------------------------------------------------------------------------------


def cheapest(rows):
    """All audits of (initial, fault) rows with at most two turns inserted at each place; the cheapest, then the least."""
    best = (10**9, "")
    choices = ["".join(p) + e for p in itertools.chain.from_iterable(itertools.product("I", repeat=k) for k in range(3)) for e in "DKR"]
    for combo in itertools.product(choices, repeat=len(rows)):
        for end in ("", "I", "II"):
            letters = [*combo, end]
            cost, state, ok = 0, 0, True
            for (initial, fault), part in itertools.zip_longest(rows, letters, fillvalue=("", 0)):
                for c in part:
                    if c == "D":
                        cost += 2
                        continue
                    if c in "KR" and fault in (1, 2):
                        ok = False
                        break
                    to = R.NEXT[state].get(initial) if c == "K" else R.TURN[state][1]
                    if to is None:
                        ok = False
                        break
                    cost, state = cost + {"K": 0, "R": 1, "I": 5}[c] + (5 if c in "KR" and fault == 3 else 0), to
                if not ok:
                    break
            if ok and state in (0, 3):
                best = min(best, (cost, "".join(letters)))
    return best


def plain_search(rows):
    """The same by whole strings, state by state."""
    def insert(now):
        for s in (0, 1, 3, 2):
            if s in now:
                to = R.TURN[s][1]
                here = (now[s][0] + 5, now[s][1] + "I")
                now[to] = min(now.get(to, here), here)
        return now

    now = insert({0: (0, "")})
    for initial, fault in rows:
        new = {}
        for s, (cost, text) in now.items():
            moves = [(s, cost + 2, "D")]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                moves.append((R.TURN[s][1], cost + 1 + extra, "R"))
                if initial in R.NEXT[s]:
                    moves.append((R.NEXT[s][initial], cost + extra, "K"))
            for to, c, letter in moves:
                new[to] = min(new.get(to, (c, text + letter)), (c, text + letter))
        now = insert(new)
    return min(now[s] for s in (0, 3) if s in now)


def searched_audit(rows, audits=R.Audits):
    search = R.Search(audits)
    out = ""
    for initial, fault in rows:
        search.row(initial, fault)
        out += search.certain()
    cost, rest = search.end()
    return cost, out + rest


class Colliding(R.Audits):
    def __init__(self):
        super().__init__(base=3, modulus=2)


def test_audits_equal_brute_force(monkeypatch):
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suaux"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 3))]
        assert searched_audit(rows) == cheapest(rows) == plain_search(rows)
    for flush in (4096, 16):
        monkeypatch.setattr(R, "FLUSH", flush)
        for _ in range(150):
            rows = [(r.choice(["s", "u", "a", "t", ""]) if r.random() < 0.5 else "u", r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 60))]
            assert searched_audit(rows) == searched_audit(rows, Colliding) == plain_search(rows)


def test_linked_strings():
    r = random.Random(9)
    for make in (R.Audits, Colliding):
        audits = make()
        strings = {0: ""}
        for _ in range(600):
            parent = r.choice(list(strings)[-40:])
            letter = r.choice("DK")
            strings[audits.add(parent, letter)] = strings[parent] + letter
        nodes = list(strings)
        for _ in range(3000):
            a, b = r.choice(nodes), r.choice(nodes)
            assert audits.less(a, b) == (strings[a] < strings[b])
            assert audits.path(audits.above(a, len(strings[a]) // 2)) == strings[a][: len(strings[a]) // 2]


def plainly(rows):
    """Damage, faults and repair of (conv_id, turn, role, text) rows."""
    named = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r[:4] for r in rows if r[0] == conv]:
            h = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
            role, text = named(role), named(text)
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = plain_search([(r[1][:1], f) for r, f in zip(kept, faults)])
        repaired, state, todo = [], 0, iter(kept)
        for c in audit:
            row = None if c == "I" else next(todo)
            if c == "D":
                continue
            role = row[1] if c == "K" else {"u": "user", "a": "assistant"}[R.TURN[state][0]]
            state = R.NEXT[state][role[:1]]
            repaired.append(f"{role}:{'' if c == 'I' else row[2]}")
        turns = {r[0] for r in kept if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, at int, edits string, gone string"


def some_turns():
    r = random.Random(2)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn if r.random() < 0.9 else None, r.choice(["user", "assistant", "assistant", "system", "tool", None, "", "Über"]), r.choice(["Yes.", "No!", "half", " \t", None, "a. b?", "", "é…", "Yes. \x0b", "x\x85"])))
    rows += [rows[3], rows[3], (7, 2, "user", "a"), (7, 2, "assistant", "b."), (7, 2**62, "user", "late."), (7, -(2**62), "user", "early")]
    rows += [(500, t, ("user", "assistant")[t % 3 % 2], f"turn {t % 50}." if t % 7 else "cut") for t in range(3000)]
    rows += [(501, 1, "user", "long. " * 300_000)]
    return [(*row, 1, "x", "y") for row in rows]


def test_repair_equals_a_plain_walk(spark):
    rows = some_turns()
    found = {r[0]: tuple(r)[1:] for r in R.audit(R.damage(spark.createDataFrame(rows, TURNS))).collect()}
    assert found == plainly(rows)


def test_repaired_rows_alternate(spark):
    rows = some_turns()
    damaged = R.damage(spark.createDataFrame(rows, TURNS))
    audits = {r["conv_id"]: r for r in R.audit(damaged).collect()}
    by = {}
    for r in R.repair(damaged).orderBy("conv_id", "step").collect():
        by.setdefault(r["conv_id"], []).append(r)
    for conv, steps in by.items():
        assert "".join(s["edit"] for s in steps) == audits[conv]["audit"] and [s["step"] for s in steps] == list(range(1, len(steps) + 1))
        kept = [s for s in steps if s["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(s["role"][:1] for s in kept))
        assert hashlib.sha256("\n".join(f"{s['role']}:{s['text']}" for s in kept).encode()).hexdigest() == audits[conv]["repaired_sha256"]


def test_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = R.audit(R.damage(spark.createDataFrame([(gone, 0, "user", "x", 0, "", "")], TURNS))).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.audit(R.damage(spark.createDataFrame([], TURNS))).count() == 0 == R.repair(R.damage(spark.createDataFrame([], TURNS))).count()


def test_memory_stays_with_long_conversations(monkeypatch):
    monkeypatch.setattr(R, "FLUSH", 256)
    search = R.Search()
    out = ""
    for k in range(5000):
        search.row("ua"[k % 2], 3 if k % 11 == 0 else 0)
        out += search.certain()
        assert len(search.audits.up) < 256 + 32
    assert len(out + search.end()[1]) >= 5000


def test_repair_sql(spark, data):
    same_as_sql(spark, data, "op13_conversation_repair", "conversations")


def test_string_ids(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), (None, 1, "user", "x")], "conv_id string, turn int, role string, text string").withColumn("gone", F.lit(False))
    assert {r["conv_id"]: r["audit"] for r in R.audit(rows).collect()} == {"a": "KK", None: "D"}
